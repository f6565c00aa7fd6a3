"""Ingesting a folder as a stream of files.

A file stream brings each file once: deletions and later rewrites are not visible to it, nor are names with a
leading underscore, for which the batch ingest, or a stream with a new checkpoint, remains the complete form. Each micro-batch changes all tables of the
index in one step together with the batch's number, so that a batch that is replayed after a failure
is skipped and a search after a batch finds its files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumdex.plans.engine import Engine, document_changes
from vellumdex.sources import markdown

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str, mask: str = "*.md", per_batch: int = 1000) -> DataFrame:
    """New files of a folder that the mask takes: ``source_path, relative_path, updated_at, text``."""
    deep = "/" in mask
    rows = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", str(deep).lower()).load(root)
    path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    base = "/" + root.removeprefix("file:").strip("/") + "/" if "://" not in root or root.startswith("file:") else root.rstrip("/") + "/"
    relative = F.replace(path, F.lit(base), F.lit(""))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    shown = rows.select(path.alias("source_path"), relative.alias("relative_path"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"), text.alias("text"))
    return shown.where(F.col("relative_path").rlike(markdown.mask_pattern(mask)) & ~F.col("relative_path").rlike(r"(^|/)\."))


def apply_batch(engine: Engine, collection_id: str, name: str, stream: str = "") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that brings a batch's documents into the index; ``stream`` names the stream whose numbers it counts."""
    mark = f"stream:{collection_id}:{stream}"

    def apply(batch: DataFrame, number: int) -> None:
        if number <= int(engine.store.manifest()["metadata"].get(mark, -1)):
            return
        latest = batch.groupBy("relative_path").agg(F.max_by(F.struct("source_path", "updated_at", "text"), "updated_at").alias("f")).select("relative_path", "f.*")
        parsed = engine.parse(latest, collection_id, name)
        stored = engine.store.read("documents").join(parsed.select("doc_id"), "doc_id", "left_semi")
        engine.update(parsed, document_changes(parsed, stored), {mark: str(number)})

    return apply


def start(files: DataFrame, engine: Engine, checkpoint: str, collection_id: str, name: str) -> StreamingQuery:
    """Runs the stream over all files that are there and ends."""
    return files.writeStream.foreachBatch(apply_batch(engine, collection_id, name, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
