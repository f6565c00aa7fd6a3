import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellumdex.cli import build_parser, main
from vellumdex.functions import providers
from vellumdex.plans.engine import Engine, ProfileError
from vellumdex.sources import markdown
from vellumdex.sources.registry import Registry, RegistryError
from vellumdex.sources.snapshots import SnapshotStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOTE = "# Title\n\nIntro about the #mod module #tag.\n\n## Code\n\n```verilog\nassign a = b;\n```\n"


class TwoWords:
    def embed_texts(self, texts, input_type="document"):
        return [[1.0, 0.0] if "alpha" in t else [0.0, 1.0] if "beta" in t else [0.5, 0.5] for t in texts]


class LikesBeta:
    def score(self, query, documents):
        return [1.0 if "beta" in d else 0.1 for d in documents]


RUNTIME = providers.Runtime("stub", "stub-model", "stub::stub-model", TwoWords())


def test_parse():
    parsed = markdown.parse_document(NOTE, "note", "c::note.md", "")
    assert parsed["title"] == "Title" and parsed["tags"] == ["#mod", "#tag"]
    text, code = parsed["chunks"]
    assert (text["text"], text["section_path"], text["chunk_id"]) == ("Intro about the module.", "Title", "c::note.md::text::0")
    assert code["text"] == "language: verilog\nassign a = b;" and code["section_path"] == "Code" and code["context_prefix"] == ""
    assert code["search_text"] == "code:\nlanguage: verilog\nassign a = b;"


@pytest.mark.parametrize("n, windows", [(0, 0), (1, 1), (800, 1), (801, 2), (1480, 2), (1481, 3)])
def test_windows(n, windows):
    found = markdown.windows_of(" ".join(f"w{i}" for i in range(n)))
    assert len(found) == windows
    assert all(len(w.split()) <= 800 for w in found)
    for a, b in zip(found, found[1:]):
        assert a.split()[-120:] == b.split()[:120]


def test_tiers():
    body = "## A\n" + "word " * 100 + "\n## B\n" + "other " * 100
    small = markdown.parse_document(body, "n", "d", "")
    assert len(small["chunks"]) == 1 and small["chunks"][0]["section_path"] == "n"
    middle = markdown.parse_document(body + "\n" + "x" * 1200, "n", "d", "ctx")
    assert [c["section_path"] for c in middle["chunks"]] == ["A", "B"] and middle["chunks"][0]["search_text"].startswith("ctx\n\n")
    large = markdown.parse_document(body + "\n" + "y " * 2000, "n", "d", "")
    assert [c["section_path"] for c in large["chunks"]] == ["A::part1", "B::part1", "B::part2", "B::part3"]


def test_odd_documents():
    assert markdown.parse_document("", "n", "d", "")["chunks"] == []
    heads = markdown.parse_document("# Only\n## Heads", "n", "d", "")
    assert [c["text"] for c in heads["chunks"]] == ["# Only\n## Heads"]
    unclosed = markdown.parse_document("a\n```py\nb", "n", "d", "")
    assert [c["chunk_type"] for c in unclosed["chunks"]] == ["text"]


@pytest.fixture
def notes(tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "alpha.md").write_text("# Topic\nalpha banana")
    (root / "beta.md").write_bytes(b"# Topic\r\nbeta carrot")
    (root / ".hidden.md").write_text("no")
    (root / "sub" / "deep.md").write_text("deep")
    return root


def engine_of(spark, tmp_path, registry=None, runtime=RUNTIME):
    return Engine(spark, str(tmp_path / "index"), registry or Registry(tmp_path / "c.yml"), runtime)


def test_scan(spark, notes):
    rows = {r["relative_path"]: r["text"] for r in markdown.scan_markdown(spark, str(notes)).collect()}
    assert rows == {"alpha.md": "# Topic\nalpha banana", "beta.md": "# Topic\nbeta carrot"}
    assert "sub/deep.md" in {r["relative_path"] for r in markdown.scan_markdown(spark, str(notes), "**/*.md").collect()}


def test_masks(spark, tmp_path):
    import pathlib

    root = tmp_path / "masks"
    for name in ("a.md", "_x.md", "docs/b.md", "docs/_y.md", "docs/deep/c.md", "other/d.md", "_priv/e.md", ".git/f.md", "docs/.g.md", "docs/h.txt", "with space/é.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(name)
    for mask in ("*.md", "**/*.md", "docs/*.md", "docs/**/*.md", "*/*.md", "**/?.md", "[ab].md", "**/[!a].md", "**/deep/*.md", "none/*.md"):
        want = {str(p.relative_to(root)) for p in root.glob(mask) if p.is_file() and not any(x.startswith(".") for x in p.relative_to(root).parts)}
        rows = markdown.scan_markdown(spark, str(root), mask).collect()
        assert {r["relative_path"] for r in rows} == want, mask
        assert all(r["text"] == r["relative_path"] and r["source_path"] == f"{root}/{r['relative_path']}" and len(r["updated_at"]) == 19 for r in rows)


def test_ingest_search_update(spark, notes, tmp_path):
    engine = engine_of(spark, tmp_path)
    first = engine.ingest(str(notes))
    assert (first.documents, first.chunks, first.embedding_dim, first.updated_documents, first.new_embedding_hashes) == (2, 2, 2, 2, 2)
    found = engine.search("banana", "fulltext").collect()
    assert [r["relative_path"] for r in found] == ["alpha.md"] and found[0]["bm25_rank"] == 1 and found[0]["vector_rank"] is None
    hybrid = engine.search("alpha", "hybrid").collect()
    assert hybrid[0]["relative_path"] == "alpha.md" and hybrid[0]["vector_rank"] == 1
    reranked = engine.search("alpha", "hybrid", reranker=LikesBeta()).collect()
    assert reranked[0]["relative_path"] == "beta.md" and reranked[0]["final_score"] == reranked[0]["rerank_score"] == 1.0
    assert engine.search("Topic", "fulltext").collect() == [] and engine.search(" ", "hybrid").collect() == []
    payload = json.loads(engine.payload(engine.search("banana", "fulltext")))
    assert payload[0]["file"] == "qmd://default/alpha.md" and payload[0]["snippet"] == "alpha banana"

    (notes / "alpha.md").unlink()
    (notes / "beta.md").write_text("# Topic\nbeta carrot zeta")
    (notes / "copy.md").write_text("# Topic\nbeta carrot")
    second = engine.ingest(str(notes))
    assert (second.documents, second.updated_documents, second.deleted_documents, second.new_embedding_hashes, second.reused_embedding_hashes) == (2, 2, 1, 1, 1)
    assert engine.search("banana", "fulltext").collect() == []
    third = engine.ingest(str(notes))
    assert (third.updated_documents, third.deleted_documents, third.new_embedding_hashes) == (0, 0, 0)
    status = engine.status().collect()
    assert [(r["documents"], r["chunks"]) for r in status] == [(2, 2)] and status[0]["last_ingested_at"]
    total, details = engine.evaluate([{"query_id": 0, "query": "zeta", "relevant_docs": ["beta"]}])
    assert total.first()["mrr_at_10"] == 1.0 and details.count() == 1


def test_collections_and_profile(spark, notes, tmp_path):
    registry = Registry(tmp_path / "c.yml")
    engine = engine_of(spark, tmp_path, registry)
    engine.ingest(str(notes))
    engine.ingest(str(notes / "sub"))
    assert {c.name for c in registry.collections} == {"default", "sub"}
    assert [r["relative_path"] for r in engine.search("deep", "fulltext", collection="sub").collect()] == ["deep.md"]
    assert engine.search("deep", "fulltext", collection="default").collect() == []
    other = engine_of(spark, tmp_path, registry, providers.resolve_embedder("hash"))
    with pytest.raises(ProfileError):
        other.search("deep", "vector")
    assert engine.search("deep", "fulltext", collection="sub").count() == 1
    with pytest.raises(ValueError):
        engine.search("deep", "other")


def test_registry(tmp_path):
    registry = Registry(tmp_path / "c.yml")
    a = registry.add("notes", tmp_path / "a")
    with pytest.raises(RegistryError):
        registry.add("notes", tmp_path / "b")
    with pytest.raises(RegistryError):
        registry.add("other", tmp_path / "a")
    assert registry.ensure(tmp_path / "a").name == "notes" and registry.ensure(tmp_path / "b").name == "default" and registry.ensure(tmp_path / "c").name == "c"
    registry.put_context("/", "all")
    registry.put_context("collection://notes/sub/", "part")
    registry.put_context("collection://notes/sub", "new")
    again = Registry.load(tmp_path / "c.yml")
    assert [(x.collection_id, x.path_prefix, x.text) for x in again.contexts_at()] == [(None, "", "all"), (a.collection_id, "sub", "new")]
    assert [x.text for x in again.contexts_at("/")] == ["all"]
    assert again.rename("notes", "journal").db_path == "data_index/journal.tables"
    again.remove("journal")
    assert [x.text for x in again.contexts] == ["all"] and again.selected(None) is not None
    with pytest.raises(RegistryError):
        again.find("journal")


def test_contexts(spark):
    from vellumdex.operators.context import context_texts

    docs = spark.createDataFrame([("d1", "A", "sub/x.md"), ("d2", "A", "subway.md"), ("d3", "B", None)], "doc_id string, collection_id string, relative_path string")
    ctx = spark.createDataFrame([(None, "", "all", "1"), ("A", "", "of A", "2"), ("A", "sub/", "below", "3"), (None, "x", " ", "4")], "collection_id string, path_prefix string, text string, created_at string")
    assert dict(tuple(r) for r in context_texts(docs, ctx).collect()) == {"d1": "all\n\nof A\n\nbelow", "d2": "all\n\nof A", "d3": "all"}


def test_snapshot_is_atomic(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.read("term_stats").count() == 0
    store.publish({"term_stats": store.stage("term_stats", spark.createDataFrame([("a", 1)], "term string, df bigint"))})
    store.stage("term_stats", spark.createDataFrame([("b", 1)], "term string, df bigint"))  # never published
    assert [r["term"] for r in store.read("term_stats").collect()] == ["a"]
    store.clean()
    assert [r["term"] for r in store.read("term_stats").collect()] == ["a"]


def test_providers(spark):
    v = providers.HashEmbedder(16).embed_texts(["alpha beta", ""])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and set(v[1]) == {0.0}
    assert providers.unit([3, 4]) == [0.6, 0.8]
    assert providers.scattered([{"index": 1, "relevance_score": 0.5}, {"index": 9, "relevance_score": 1.0}], 2) == [0.0, 0.5]
    assert [len(p) for p in providers.sliced(["a" * 3, "b" * 3, "c" * 9, "d"], 6)] == [2, 1, 1] and list(providers.sliced([])) == []
    with pytest.raises(providers.ProviderError):
        providers.resolve_embedder("none")
    df = spark.createDataFrame([("alpha",), (None,)], "t string").select(providers.embedding_of(TwoWords(), F.col("t")).alias("v"))
    assert [list(r["v"]) for r in df.collect()] == [[1.0, 0.0], [0.5, 0.5]]


class _Tensor(list):
    """What the reranker needs of a tensor."""

    logits = property(lambda self: self)
    to = detach = cpu = lambda self, *_: self

    def tolist(self):
        return list(self)


def _stub_models(monkeypatch, logits):
    import contextlib
    import types

    seen = {}

    class Model:
        @classmethod
        def from_pretrained(cls, name, **options):
            seen["kind"] = cls.__name__
            return cls()

        eval = lambda self: self
        to = lambda self, device: self

        def __call__(self, **batch):
            return _Tensor(logits(seen["prompts"]))

    class Tokenizer(Model):
        convert_tokens_to_ids = staticmethod({"no": 1, "yes": 2}.get)

        def __call__(self, prompts, **options):
            seen["prompts"], seen["options"] = prompts, options
            return {"input_ids": _Tensor()}

    names = {"AutoModelForSequenceClassification": type("Classifier", (Model,), {}), "AutoModelForCausalLM": type("Causal", (Model,), {}), "AutoTokenizer": Tokenizer}
    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(no_grad=contextlib.nullcontext, backends=types.SimpleNamespace()))
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(**names))
    monkeypatch.setattr(providers, "_models", {})
    return seen


def test_local_reranker_as_a_classifier(monkeypatch):
    seen = _stub_models(monkeypatch, lambda prompts: [[2.0] if "beta" in p else [-2.0] for p in prompts])
    reranker = providers.resolve_reranker("local", instruction="Find it.")
    assert [round(x, 4) for x in reranker.score("q", ["beta", "x"])] == [0.8808, 0.1192] and reranker.score("q", []) == []
    assert seen["prompts"][0].startswith("<|im_start|>system") and "<Instruct>: Find it.\n<Query>: q\n<Document>: beta<|im_end|>" in seen["prompts"][0]
    assert seen["options"]["max_length"] == 8192


def test_local_reranker_as_a_language_model(monkeypatch):
    seen = _stub_models(monkeypatch, lambda prompts: [[[9.0, 9.0, 9.0], [5.0, 1.0, 3.0 if "beta" in p else -1.0]] for p in prompts])
    scores = providers.resolve_reranker("local", "some/causal-model").score("q", ["beta", "x"])
    assert [round(x, 4) for x in scores] == [0.8808, 0.1192]  # of the last token, yes against no
    assert seen["prompts"][1] == f"<Instruct>: {providers.INSTRUCTION}\n<Query>: q\n<Document>: x"


def test_reranker_in_its_own_process():
    worker = "import json, sys; d = json.load(sys.stdin); print(json.dumps({'scores': [len(x) for x in d['documents']]}))"
    assert providers.SubprocessReranker(command=(sys.executable, "-c", worker)).score("q", ["ab", "c"]) == [2.0, 1.0]
    for bad in ("import sys; sys.exit('out of memory')", "print('no json')", "print('{}')"):
        with pytest.raises(providers.ProviderError):
            providers.SubprocessReranker(command=(sys.executable, "-c", bad)).score("q", ["ab"])
    with pytest.raises(providers.ProviderError, match="torch and transformers|failed"):
        providers.resolve_reranker("local", own_process=True).score("q", ["ab"])


def test_stream_applies_each_batch_once(spark, notes, tmp_path):
    from vellumdex.streaming import ingest

    engine = engine_of(spark, tmp_path)
    engine.ingest(str(notes))
    own = engine.registry.collections[0]
    run = lambda at: ingest.start(ingest.file_stream(spark, str(notes)), engine, str(tmp_path / at), own.collection_id, own.name).awaitTermination()
    found = lambda word: [r["relative_path"] for r in engine.search(word, "fulltext").collect()]
    run("cp")
    assert {r["relative_path"] for r in engine.store.read("documents").collect()} == {"alpha.md", "beta.md"}
    (notes / "new file.md").write_text("gamma delta")
    (notes / "alpha.md").write_text("# Topic\nalpha cherry")
    run("cp")
    assert found("gamma") == ["new file.md"] and found("cherry") == []
    run("another")
    assert found("gamma") == ["new file.md"] and found("cherry") == ["alpha.md"] and found("banana") == []
    assert engine.search("gamma", "vector").count() == 3
    before = engine.store.read("chunks").count()
    assert before == 3 == engine.store.corpus().first()["doc_count"]
    batch = spark.createDataFrame([("p", "new file.md", "2026", "other")], "source_path string, relative_path string, updated_at string, text string")
    ingest.apply_batch(engine, own.collection_id, own.name, str(tmp_path / "cp"))(batch, 0)  # a replayed batch
    assert engine.store.read("chunks").count() == before and found("other") == []


def test_segments_give_the_same_as_a_new_index(spark, notes, tmp_path):
    from vellumdex.operators import lexical

    engine = engine_of(spark, tmp_path)
    engine.ingest(str(notes))
    ids = {r["id"] for r in engine.store.read("chunks").collect()}
    for i in range(3):
        (notes / "beta.md").write_text(f"# Topic\nbeta carrot number{i}")
        (notes / f"more{i}.md").write_text(f"word{i} carrot")
        if i:
            (notes / f"more{i - 1}.md").unlink()
        engine.ingest(str(notes))
        fresh = {r["id"] for r in engine.store.read("chunks").collect()} - ids
        assert len(fresh) >= 2
        ids |= fresh  # no id is used twice
    read = lambda name: {tuple(r) for r in engine.store.read(name).select(*[c for c in engine.store.read(name).columns if c not in ("tags", "out_links")]).collect()}

    def check():
        chunks, postings = engine.store.read("chunks"), engine.store.read("postings")
        assert {r["relative_path"] for r in chunks.collect()} == {"alpha.md", "beta.md", "more2.md"}
        assert {tuple(r) for r in lexical.postings_of(chunks).collect()} == {tuple(r) for r in postings.select("id", "term", "tf").collect()}
        assert {tuple(r) for r in lexical.document_frequencies(postings).collect()} == read("term_stats")
        assert tuple(lexical.corpus_scalars(chunks).first()) == tuple(engine.store.corpus().first())

    check()
    assert len(engine.store.manifest()["tables"]["chunks"]) == 4
    before = read("chunks")
    assert set(engine.store.compact(1)) == {"documents", "chunks", "postings", "term_stats", "corpus", "embedding_cache"}
    engine.store.clean()
    assert read("chunks") == before and len(engine.store.manifest()["tables"]["chunks"]) == 1
    check()
    again = engine.ingest(str(notes), rebuild=True)
    assert (again.documents, again.chunks, again.new_embedding_hashes, again.reused_embedding_hashes) == (3, 3, 0, 3)
    check()


def test_cli(capsys, tmp_path):
    path = str(tmp_path / "c.yml")
    main(["collection", "--collections-path", path, "add", "notes", str(tmp_path)])
    main(["context", "--collections-path", path, "add", "/", "--text", "hello   world"])
    main(["context", "--collections-path", path, "list"])
    main(["collection", "--collections-path", path, "list"])
    out = capsys.readouterr().out
    assert "- /: hello world" in out and "- notes (" in out
    with pytest.raises(SystemExit):
        build_parser().parse_args(["search", "q", "--model", "m"])
    assert build_parser().parse_args(["query", "q", "--use-reranker"]).rerank_top_k == 20
