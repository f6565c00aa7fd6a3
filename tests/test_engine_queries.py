import pathlib

import pytest

import __spark_entry__

DOCUMENTS = [
    (1, "A", "alpha beta", "en", "web"),
    (2, "A", "one\r\ntwo\rthree\n", None, "web"),
    (3, "B", "# Head\n\nnaïve 中文 😀", "de", None),
    (4, "B", "", "en", "web"),
    (5, "B", None, "en", "web"),
    (6, "C", "alpha beta", None, None),
    (7, "C", "  ", "fr", None),
]


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """A data folder with a few odd documents, for a user who may write no file but through Spark."""

    def denied(path, *args, **options):
        raise PermissionError(13, "Permission denied", str(path))

    spark.createDataFrame(DOCUMENTS, "doc_id bigint, collection_id string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pathlib.Path, "write_text", denied)
    return str(tmp_path)


def by_sql(name: str, folder: str) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        return sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())


def by_spark(spark, name: str, folder: str) -> list[tuple]:
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())


def test_documents_match_their_sql(spark, tables):
    found = by_spark(spark, "engine_documents", tables)
    assert found == by_sql("engine_documents", tables) and len(found) == 6


def test_a_second_ingest_matches_its_sql(spark, tables):
    assert by_spark(spark, "engine_delta", tables) == by_sql("engine_delta", tables) == [(4, 2, 2, True, True)]


@pytest.mark.parametrize(
    "documents, want",
    [
        ([], (0, 0, 0, True, True)),
        ([(1, "A", None, "en", "web")], (0, 0, 0, True, True)),
        ([(1, "A", "alpha", None, "web"), (2, "B", "beta", None, None)], (0, 0, 2, True, True)),
        ([(1, "A", "alpha", None, "web"), (2, "B", " ", "de", "web")], (1, 0, 1, True, True)),
    ],
    ids=["no rows", "no texts", "no files left", "no chunks left"],
)
def test_a_second_ingest_that_leaves_nothing_matches_its_sql(spark, tmp_path, documents, want):
    spark.createDataFrame(documents, "doc_id bigint, collection_id string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert by_spark(spark, "engine_delta", str(tmp_path)) == [want] == by_sql("engine_delta", str(tmp_path))


def test_files_are_deleted_once_by_a_task_that_runs_twice(spark, tmp_path):
    from vellumdex.plans.engine_queries import write_files

    rows = spark.createDataFrame([("A/1.md", "alpha"), ("A/2.md", "beta")], "relative_path string, text string")
    gone = rows.selectExpr("relative_path", "if(text = 'alpha', text, null) as text")
    assert [write_files(x, f"file://{tmp_path}") for x in (rows, gone, gone)] == [2, 2, 2]
    assert [p.name for p in (tmp_path / "A").iterdir()] == ["1.md"]


def test_a_folder_without_files_is_an_error_unless_allowed(spark, tmp_path):
    from vellumdex.functions.providers import resolve_embedder
    from vellumdex.plans.engine import Engine

    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "a.md").write_text("alpha")
    engine = Engine(spark, f"{tmp_path}/index", None, resolve_embedder("hash"))
    engine.ingest(str(folder))
    (folder / "a.md").unlink()
    with pytest.raises(FileNotFoundError):
        engine.ingest(str(folder))
    assert engine.search("alpha", "fulltext").count() == 1
    report = engine.ingest(str(folder), allow_empty=True)
    assert (report.documents, report.chunks, report.deleted_documents) == (0, 0, 1) and engine.search("alpha").count() == 0


def test_a_search_matches_its_sql(spark, tables):
    found = by_spark(spark, "engine_search", tables)
    assert found == by_sql("engine_search", tables) and [r[0] for r in found] == [1, 3, 6]


@pytest.mark.parametrize(
    "documents, want",
    [
        ([], []),
        ([(1, "A", None, "en", "web")], []),
        ([(1, "A", "zq1mark zq2mark", "en", "web"), (2, "B", "zq1mark", "en", "web")], [(1, 1, "A/marked.md", 1), (2, 1, "B/marked.md", 1)]),
    ],
    ids=["no rows", "no texts", "words like those searched"],
)
def test_a_search_of_odd_tables_matches_its_sql(spark, tmp_path, documents, want):
    spark.createDataFrame(documents, "doc_id bigint, collection_id string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert by_spark(spark, "engine_search", str(tmp_path)) == want == by_sql("engine_search", str(tmp_path))


def test_a_registry_without_a_path_writes_nothing(tmp_path, monkeypatch):
    from vellumdex.sources.registry import Registry

    monkeypatch.chdir(tmp_path)
    registry = Registry()
    made = registry.add("notes", tmp_path / "a")
    registry.put_context("/", "all")
    registry.rename("notes", "journal")
    assert registry.one("journal") is made and [x.text for x in registry.contexts_at()] == ["all"]
    registry.remove("journal")
    assert registry.collections == [] and list(tmp_path.iterdir()) == []
