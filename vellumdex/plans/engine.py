"""The engine: ingest, search, evaluate and status over an index on disk."""

from __future__ import annotations

import dataclasses
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.functions import text as tx
from vellumdex.functions.providers import Reranker, Runtime, embedding_of, rerank_scores
from vellumdex.operators import evaluation, fusion, lexical, vector
from vellumdex.operators.context import context_texts
from vellumdex.session import materialize
from vellumdex.sources import markdown
from vellumdex.sources.registry import Collection, Registry, RegistryError, tidy_path
from vellumdex.sources.snapshots import SCHEMAS, SnapshotStore

MODES = ("hybrid", "fulltext", "vector")
LAST_INGEST = "collection_last_ingested_at:"
LAST_ID = "last_chunk_id"


@dataclasses.dataclass
class IngestReport:
    documents: int
    chunks: int
    embedding_dim: int
    embedding_provider: str
    embedding_model: str
    collection_id: str
    collection_name: str
    source: str
    updated_documents: int
    deleted_documents: int
    new_embedding_hashes: int
    reused_embedding_hashes: int


class ProfileError(RuntimeError):
    """The index was made with other embedding settings."""


def document_changes(current: DataFrame, stored: DataFrame, key: str = "doc_id", digest: str = "document_hash") -> DataFrame:
    """``key, change`` of two states of one collection: ``new``, ``changed``, ``deleted`` or ``same``."""
    now = current.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_in"))
    then = stored.select(key, F.col(digest).alias("_then"), F.lit(True).alias("_was"))
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_in").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_then")), "same").otherwise("changed")
    return now.join(then, key, "full_outer").select(key, change.alias("change"))


def without_documents(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """A table without the rows of the documents in ``gone``."""
    return table.join(gone.select(key), key, "left_anti")


class Engine:
    def __init__(self, spark: SparkSession, index: str, registry: Registry | None = None, runtime: Runtime | None = None):
        self.spark, self.store = spark, SnapshotStore(spark, index)
        self.registry, self.runtime = registry or Registry(), runtime

    # ---- ingest

    def _target(self, source: str, collection: str | None) -> Collection:
        if collection:
            chosen = self.registry.one(collection)
            if tidy_path(chosen.root_path, True) != tidy_path(source, True):
                raise RegistryError(f"collection {chosen.name} has the root {chosen.root_path}, not {source}")
            return chosen
        return self.registry.by_root(source) or self.registry.ensure(source)

    def ingest(self, source: str, collection: str | None = None, rebuild: bool = False, allow_empty: bool = False) -> IngestReport:
        """Brings the index up to date with a folder: changed documents anew, deleted ones out.

        Only changed documents are chunked into the index and only content without a cached
        vector is embedded; what did not change is not written again. Everything is staged first and
        becomes current in one step. A folder without files is an error, since it may just not be
        mounted; with ``allow_empty`` all documents are taken out then.
        """
        chosen = self._target(source, collection)
        files = markdown.scan_markdown(self.spark, tidy_path(source, True), chosen.mask)
        parsed = self.parse(files, chosen.collection_id, chosen.name)
        if not allow_empty and parsed.isEmpty():
            raise FileNotFoundError(f"no files match {chosen.mask} in {source}")
        stored = self.spark.createDataFrame([], SCHEMAS["documents"]) if rebuild else self.store.read("documents")
        changes = document_changes(parsed, stored.where(F.col("collection_id") == chosen.collection_id))
        stamp = datetime.now().astimezone().isoformat(timespec="seconds")
        done = self.update(parsed, changes, {LAST_INGEST + chosen.collection_id: stamp}, rebuild)
        return IngestReport(
            self.store.read("documents").count(), self.store.corpus().first()["doc_count"], done["dim"], self.runtime.provider, self.runtime.model, chosen.collection_id, chosen.name, str(source),
            done["new"] + done["changed"], done["deleted"], done["made"], done["reused"],
        )

    def parse(self, files: DataFrame, collection_id: str, name: str) -> DataFrame:
        """Parsed documents of one collection, each with the contexts that apply to it."""
        named = files.withColumn("collection_id", F.lit(collection_id)).withColumn("collection_name", F.lit(name))
        contexts = context_texts(named.withColumn("doc_id", F.col("relative_path")), self.registry.contexts_frame(self.spark))
        return materialize(markdown.parse_markdown(named.join(contexts.withColumnRenamed("doc_id", "relative_path"), "relative_path")))

    def update(self, parsed: DataFrame, changes: DataFrame, metadata: dict, rebuild: bool = False) -> dict:
        """Applies the changes of some documents to all tables of the index, as one new segment each.

        ``changes`` has ``doc_id, change``. What goes is taken out by key, its part of the statistics is
        made again from the chunks that go and subtracted. Ids of chunks are never used twice.
        """
        if self.runtime is None:
            raise ProfileError("ingest needs an embedding provider")
        manifest = {"tables": {}, "profile": None, "metadata": {}} if rebuild else self.store.manifest()
        last_id = int(self.store.manifest()["metadata"].get(LAST_ID, 0))
        changes = materialize(changes.where("change != 'same'"))
        counts = {"new": 0, "changed": 0, "deleted": 0} | {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        gone = changes.where("change != 'new'").select("doc_id")
        fresh = parsed.join(changes.where("change != 'deleted'"), "doc_id", "left_semi")
        old_chunks = materialize(self.store.read("chunks", manifest).join(gone, "doc_id", "left_semi").select("id", "search_text", "token_count"))
        rows = markdown.chunk_rows(fresh).withColumn("id", F.lit(last_id) + 1 + F.monotonically_increasing_id())
        numbered = materialize(rows.to(self.spark.createDataFrame([], SCHEMAS["chunks"]).schema))
        postings = lexical.postings_of(numbered.select("id", "search_text", "collection_id")).join(numbered.select("id", "collection_id"), "id")
        stats = lexical.document_frequencies(postings).unionByName(lexical.document_frequencies(lexical.postings_of(old_chunks)).withColumn("df", -F.col("df")))
        sums = numbered.select("token_count", F.lit(1).alias("sign")).unionByName(old_chunks.select("token_count", F.lit(-1).alias("sign")))
        segments = {
            "documents": self.store.stage("documents", fresh, None, gone),
            "chunks": self.store.stage("chunks", numbered, ["doc_id"], gone),
            "postings": self.store.stage("postings", postings, ["term"], old_chunks.select("id")),
            "term_stats": self.store.stage("term_stats", stats.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0"), ["term"]),
            "corpus": self.store.stage("corpus", sums.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("doc_count"), F.coalesce(F.sum(F.col("sign") * F.coalesce("token_count", F.lit(0))), F.lit(0)).alias("lengths"))),
        }
        segments["embedding_cache"], dim, made, reused = self._embedded(numbered, manifest)
        profile = {"provider": self.runtime.provider, "model": self.runtime.model, "cache_key": self.runtime.cache_key, "dim": dim}
        top = numbered.agg(F.max("id")).first()[0] or last_id
        if rebuild:  # vectors by content stay; everything else begins anew
            kept = self.store.manifest()["tables"].get("embedding_cache", [])
            self.store.publish(segments, profile, metadata | {LAST_ID: str(top)}, replace=True)
            if kept:
                self.store.publish({"embedding_cache": self.store.stage("embedding_cache", self.store.read("embedding_cache", {"tables": {"embedding_cache": [*kept, segments["embedding_cache"]]}}), ["model"])}, replace=True)
        else:
            self.store.publish(segments, profile, metadata | {LAST_ID: str(top)})
            self.store.compact()
        return counts | {"dim": dim or 0, "made": made, "reused": reused}

    def _embedded(self, numbered: DataFrame, manifest: dict) -> tuple[dict, int | None, int, int]:
        """The segment of vectors that the cache lacks, the index's dimension, and how many contents were embedded and reused.

        New chunks need vectors; all chunks do if the index was made with other embedding settings.
        """
        key = self.runtime.cache_key
        cache = self.store.read("embedding_cache").where(F.col("model") == key)
        profile = manifest["profile"]
        same = profile is not None and profile["cache_key"] == key
        wanted = numbered if same else self.store.read("chunks", manifest).unionByName(numbered)
        lacking = vector.missing_vectors(wanted, cache)
        made = materialize(lacking.select(F.lit(key).alias("model"), "embedding_hash", embedding_of(self.runtime.embedder, F.col("text")).alias("embedding")).withColumn("dim", F.size("embedding")))
        segment = self.store.stage("embedding_cache", made, ["model"])
        found = vector.checked_vectors(wanted, cache.unionByName(made.select(cache.columns)))
        if found.count() != wanted.count():
            raise vector.VectorDimensionError("some chunks have no vector")
        dim = vector.dimension_of(found)
        if same and dim is not None and profile["dim"] and dim != profile["dim"]:
            raise vector.VectorDimensionError(f"vectors of {dim} dimensions in an index of {profile['dim']}")
        hashes = numbered.select("embedding_hash").distinct().count()
        new = made.join(numbered.select("embedding_hash"), "embedding_hash", "left_semi").count()
        return segment, dim if dim is not None else (profile or {}).get("dim"), new, hashes - new

    # ---- search

    def check_profile(self) -> None:
        profile = self.store.manifest()["profile"]
        if profile is None:
            raise ProfileError("the index has no vectors yet; run ingest first")
        own = {"provider": self.runtime.provider, "model": self.runtime.model, "cache_key": self.runtime.cache_key}
        unlike = [f"{k}: the index has {profile[k]}, not {v}" for k, v in own.items() if profile[k] != v]
        if unlike:
            raise ProfileError("; ".join(unlike) + "; run ingest with rebuild")

    def search(
        self, query: str, mode: str = "hybrid", top_k: int = 20, vector_top_k: int = 20, bm25_top_k: int = 20, collection: str | None = None,
        reranker: Reranker | None = None, rerank_top_k: int = 20,
    ) -> DataFrame:
        """Results of one query in order of ``position``; empty for a blank query."""
        queries = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        return self.search_batch(queries, mode, top_k, vector_top_k, bm25_top_k, collection, reranker, rerank_top_k).drop("query_id")

    def search_batch(
        self, queries: DataFrame, mode: str = "hybrid", top_k: int = 20, vector_top_k: int = 20, bm25_top_k: int = 20, collection: str | None = None,
        reranker: Reranker | None = None, rerank_top_k: int = 20,
    ) -> DataFrame:
        """Results of many queries (``query_id, query``) as one plan.

        BM25 filters by collection before its cut, the vector branch after its own. Without
        a reranker, full-text results are ordered by score again at the end.
        """
        if mode not in MODES:
            raise ValueError(f"unknown search mode {mode}")
        manifest = self.store.manifest()
        allowed = self.registry.selected(collection)
        asked = queries.select("query_id", tx.query_text_col(F.col("query")).alias("query")).where("query != ''")
        chunks = self.store.read("chunks", manifest)
        empty = self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, score double, rank int")
        by_vector = by_term = empty
        if mode != "fulltext":
            self.check_profile()
            vectors = vector.checked_vectors(chunks, self.store.read("embedding_cache", manifest), self.runtime.cache_key)
            embedded = materialize(asked.withColumn("vector", embedding_of(self.runtime.embedder, F.col("query"), "query")))
            by_vector = vector.vector_batch_topk(vectors, embedded, vector_top_k, "id")
            if allowed is not None:
                by_vector = by_vector.join(chunks.where(F.col("collection_id").isin(allowed)).select("id"), "id", "left_semi")
                by_vector = lexical.top_k(by_vector.drop("rank"), vector_top_k)
        if mode != "vector":
            scores = lexical.bm25_scores(lexical.query_terms(asked), self.store.read("postings", manifest).select("id", "term", "tf"), chunks, self.store.read("term_stats", manifest), self.store.corpus(manifest), allowed)
            by_term = lexical.top_k(scores, bm25_top_k)
        if mode == "hybrid":
            fused = fusion.reciprocal_rank_fusion(by_vector, by_term)
        else:
            rows, name = (by_vector, "vector_rank") if mode == "vector" else (by_term, "bm25_rank")
            other = "bm25_rank" if mode == "vector" else "vector_rank"
            fused = rows.select("query_id", "id", F.col("score").alias("fusion_score"), F.col("rank").alias(name), F.lit(None).cast("int").alias(other), F.col("rank").alias("position"))
        hits = fusion.hydrate(fused, chunks)
        if reranker is None:
            hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
        else:
            head = hits.where(F.col("position") <= max(1, rerank_top_k)).join(asked, "query_id").select("query_id", "query", "id", fusion.rerank_text(F.col("title"), F.col("section_path"), F.col("text")).alias("text"))
            scored = rerank_scores(head, reranker).select("query_id", "id", F.col("rerank_score").alias("_score"))
            hits = fusion.rerank_prefix(hits.join(scored, ["query_id", "id"], "left"), "_score", rerank_top_k).drop("_score", "first_score")
        shaped = fusion.final_scores(fusion.diversify(hits, top_k))
        if mode == "fulltext" and reranker is None:
            shaped = fusion.resort_by_score(shaped)
        named = fusion.with_current_names(shaped.withColumn("chunk_rowid", F.col("id")), self.registry.collections_frame(self.spark))
        return named.select("query_id", "position", *fusion.RESULT_COLUMNS).orderBy("query_id", "position")

    def payload(self, results: DataFrame, show_type: bool = False) -> str:
        """The results of one query as a JSON array."""
        rows = [r.asDict() for r in fusion.result_payload(results, show_type).collect()]
        return json.dumps(rows, ensure_ascii=False, indent=2)

    # ---- evaluation and status

    def evaluate(self, golden: list[dict], collection: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Summary and details of a golden set, searched in hybrid mode as one batch."""
        frame = self.spark.createDataFrame(golden, "query_id int, query string, relevant_docs array<string>")
        found = self.search_batch(frame.select("query_id", "query"), top_k=10, collection=collection)
        ranked = found.select("query_id", evaluation.file_name(F.col("relative_path")).alias("name"), F.col("position").alias("rank"))
        details = materialize(evaluation.evaluate_rankings(frame, ranked))
        top = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("top_results"))  # ten at most
        return evaluation.summary(details), details.join(frame, "query_id").join(top, "query_id", "left")

    def status(self) -> DataFrame:
        """Documents, chunks and last ingest of every collection of the registry, by name."""
        manifest = self.store.manifest()
        count = lambda name: self.store.read(name, manifest).groupBy("collection_id").agg(F.count("*").alias(name))
        stamps = [(k.removeprefix(LAST_INGEST), v) for k, v in manifest["metadata"].items() if k.startswith(LAST_INGEST)]
        last = self.spark.createDataFrame(stamps, "collection_id string, last_ingested_at string")
        rows = self.registry.collections_frame(self.spark).select("collection_id", "name")
        for part in (count("documents"), count("chunks"), last):
            rows = rows.join(part, "collection_id", "left")
        return rows.na.fill(0, ["documents", "chunks"]).orderBy(F.lower("name"))
