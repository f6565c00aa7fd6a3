"""Queries that drive the engine itself, on files made from the documents of the test data."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.functions.providers import resolve_embedder
from vellumdex.plans.engine import Engine
from vellumdex.session import shared_dir, table
from vellumdex.sources.registry import Registry


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row ``relative_path, text`` as a file below ``root``, or deletes the file where the text is null; the number of rows.

    The folder ``root`` is there afterwards even without rows, and a task that runs again finds nothing amiss in what it did before.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                place = f"{base}/{path}"
                if text is None:
                    with contextlib.suppress(FileNotFoundError):
                        where.delete_file(place)
                    continue
                where.create_dir(place.rpartition("/")[0], recursive=True)
                with where.open_output_stream(place) as stream:
                    stream.write(text.encode("utf-8"))
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    whole, top = fs.FileSystem.from_uri(root)
    whole.create_dir(top, recursive=True)
    return rows.select("relative_path", "text").mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[Engine, str, DataFrame]:
    """An engine that has ingested all documents with a text, the files' folder, and the documents by file."""
    folder = f"{shared_dir(spark)}/engines/{uuid.uuid4().hex}"
    uri = folder if "://" in folder else "file://" + quote(folder)
    path = F.concat_ws("/", "collection_id", F.concat("doc_id", F.lit(".md")))
    documents = table(spark, sf_dir, "documents").where("text is not null").withColumn("relative_path", path)
    write_files(documents, f"{uri}/files")
    root = folder.removeprefix("file://") + "/files"
    registry = Registry()
    registry.add("documents", root, mask="**/*.md")
    engine = Engine(spark, f"{folder}/index", registry, resolve_embedder("hash"))
    engine.ingest(root, "documents", allow_empty=True)
    return engine, uri, documents


def engine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, size and hash of every document after an ingest of its file."""
    engine, _, _ = _ingested(spark, sf_dir)
    return engine.store.read("documents").select("relative_path", "char_count", "source_hash")


def engine_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second ingest reports after documents without a label were deleted and those without a source rewritten, and what is left."""
    engine, uri, documents = _ingested(spark, sf_dir)
    write_files(documents.where("lang is null").withColumn("text", F.lit(None).cast("string")), f"{uri}/files")
    write_files(documents.where("lang is not null and source is null").withColumn("text", F.concat("text", F.lit(" again"))), f"{uri}/files")
    report = engine.ingest(engine.registry.one("documents").root_path, "documents", allow_empty=True)
    chunks = engine.store.read("chunks")
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    scalars = engine.store.corpus()
    named = counts.join(scalars, F.col("doc_count") == F.col("chunks"), "left")
    return named.select(
        F.lit(report.documents).cast("bigint").alias("documents"), F.lit(report.updated_documents).cast("bigint").alias("updated_documents"), F.lit(report.deleted_documents).cast("bigint").alias("deleted_documents"),
        (F.col("ids") == F.col("chunks")).alias("ids_differ"), F.coalesce(F.abs(F.col("avgdl") * F.col("doc_count") - F.col("tokens")) < 0.5, F.lit(False)).alias("scalars_agree"),
    )


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the engine finds for a word which one file of each collection holds, one word for each collection.

    The words begin with a random number, so that no document of the test data can hold one.
    """
    engine, uri, documents = _ingested(spark, sf_dir)
    words = documents.groupBy("collection_id").agg(F.min("doc_id").alias("doc_id")).select("collection_id", F.concat(F.lit(f"zq{uuid.uuid4().hex}n"), F.col("doc_id"), F.lit("mark")).alias("query"), F.col("doc_id").alias("query_id"), F.concat_ws("/", "collection_id", F.lit("marked.md")).alias("relative_path"))
    write_files(words.select("relative_path", F.concat(F.lit("Some words beside "), F.col("query"), F.lit(" and after it")).alias("text")), f"{uri}/files")
    engine.ingest(engine.registry.one("documents").root_path, "documents", allow_empty=True)
    found = engine.search_batch(words.select("query_id", "query"), "fulltext", 5)
    return found.select("query_id", "position", "relative_path", "bm25_rank")


_FILES = "files as (select *, collection_id || '/' || doc_id || '.md' as path, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as body from documents where text is not null)"

QUERIES = {f.__name__: f for f in (engine_documents, engine_delta, engine_search)}
ORACLES = {
    "engine_documents": f"with {_FILES} select path as relative_path, cast(length(body) as int) as char_count, sha256(body) as source_hash from files",
    "engine_delta": f"""with {_FILES} select count(*) filter (lang is not null) as documents, count(*) filter (lang is not null and source is null) as updated_documents,
        count(*) filter (lang is null) as deleted_documents, true as ids_differ, true as scalars_agree from files""",
    "engine_search": f"with {_FILES} select min(doc_id) as query_id, 1 as position, collection_id || '/marked.md' as relative_path, 1 as bm25_rank from files group by collection_id",
}
