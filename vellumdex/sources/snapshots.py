"""An index on disk: tables made of segments, and a manifest that names those that count.

A change is written as a segment beside those that are there: rows that came, and keys of rows that went.
It becomes current by replacing the manifest, so that readers see either the old or the new state of
all tables. A row counts if its key is in no later segment's keys. Statistics are kept as sums, to
which a segment adds what came less what went. Many segments of a table are made one now and then.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of the tables of an index.
SCHEMAS = {
    "documents": "doc_id string, collection_id string, collection_name string, title string, source_path string, relative_path string, tags array<string>, out_links array<string>, updated_at string, source_hash string, context_hash string, document_hash string, char_count int",
    "chunks": "id bigint, chunk_id string, doc_id string, collection_id string, collection_name string, title string, source_path string, relative_path string, section_path string, chunk_type string, context_prefix string, context_text string, text string, search_text string, token_count int, embedding_hash string, tags array<string>, out_links array<string>, updated_at string",
    "postings": "id bigint, term string, tf int, collection_id string",
    "term_stats": "term string, df bigint",
    "corpus": "doc_count bigint, lengths bigint",
    "embedding_cache": "model string, embedding_hash string, dim int, embedding array<float>",
}

#: By what rows of a table go; the tables that are sums by key; how many segments a table may have.
GONE_BY = {"documents": "doc_id", "chunks": "doc_id", "postings": "id"}
SUMMED = {"term_stats": ["term"], "corpus": []}
MOST_SEGMENTS = 8


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """``{"tables": {name: segments}, "profile": ..., "metadata": {...}}``; empty for a new index."""
        path, fs = self._path("manifest.json")
        if not fs.exists(path):
            return {"tables": {}, "profile": None, "metadata": {}}
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def exists(self) -> bool:
        return bool(self.manifest()["tables"])

    def read(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table as the manifest names it; empty if the index has none."""
        segments = (self.manifest() if manifest is None else manifest)["tables"].get(name, [])
        parts = [(i, self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{s['rows']}")) for i, s in enumerate(segments) if s["rows"]]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        gone = [(i, s["gone"]) for i, s in enumerate(segments) if s["gone"] and i > parts[0][0]]
        if gone:
            key = GONE_BY[name]
            kind = parts[0][1].select(key).schema
            went = reduce(DataFrame.unionByName, [self.spark.read.schema(kind).parquet(f"{self.root}/{f}").withColumn("_went", F.lit(i)) for i, f in gone])
            last = went.groupBy(F.col(key).alias("_key")).agg(F.max("_went").alias("_went"))
            rows = reduce(DataFrame.unionByName, [df.withColumn("_came", F.lit(i)) for i, df in parts])
            rows = rows.join(last, (F.col(key) == F.col("_key")) & (F.col("_came") < F.col("_went")), "left_anti").drop("_came")
        else:
            rows = reduce(DataFrame.unionByName, [df for _, df in parts])
        if name in SUMMED and len(parts) > 1:
            numbers = [c for c in rows.columns if c not in SUMMED[name]]
            rows = rows.groupBy(*SUMMED[name]).agg(*[F.sum(c).alias(c) for c in numbers])
            rows = rows.where(F.col(numbers[0]) > 0) if SUMMED[name] else rows
        return rows

    def corpus(self, manifest: dict | None = None) -> DataFrame:
        """One row: ``doc_count, avgdl``."""
        sums = self.read("corpus", manifest).agg(F.coalesce(F.sum("doc_count"), F.lit(0)).alias("doc_count"), F.sum("lengths").alias("lengths"))
        return sums.select("doc_count", F.coalesce(F.try_divide("lengths", "doc_count"), F.lit(0.0)).alias("avgdl"))

    def stage(self, name: str, rows: DataFrame, cluster: list[str] | None = None, gone: DataFrame | None = None) -> dict:
        """Writes a segment of a table that is not current yet. ``cluster`` sorts the files for row-group pruning; ``gone`` has the keys of rows that went."""
        folder = f"v/{name}-{uuid.uuid4().hex}"
        shaped = rows.to(self.spark.createDataFrame([], SCHEMAS[name]).schema)
        (shaped.sortWithinPartitions(*cluster) if cluster else shaped).write.parquet(f"{self.root}/{folder}/rows")
        if gone is not None:
            gone.select(GONE_BY[name]).distinct().write.parquet(f"{self.root}/{folder}/gone")
        return {"rows": f"{folder}/rows", "gone": None if gone is None else f"{folder}/gone"}

    def publish(self, segments: dict[str, dict], profile: dict | None = None, metadata: dict | None = None, replace: bool = False) -> None:
        """Makes staged segments current: added to those of their tables, or, with ``replace``, instead of them."""
        old = self.manifest()
        tables = old["tables"] | {name: [*([] if replace else old["tables"].get(name, [])), s] for name, s in segments.items()}
        new = {"tables": tables, "profile": profile or old["profile"], "metadata": old["metadata"] | (metadata or {})}
        final, fs = self._path("manifest.json")
        part, _ = self._path(f"manifest-{uuid.uuid4().hex}.json")
        fs.mkdirs(final.getParent())
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(new, ensure_ascii=False).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if final.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getLocalFSFileContext()
        context.rename(part, final, options)

    def compact(self, most: int = MOST_SEGMENTS) -> list[str]:
        """Writes tables of more than ``most`` segments as one; their names."""
        manifest = self.manifest()
        many = [name for name, segments in manifest["tables"].items() if len(segments) > most]
        order = {"postings": ["term"], "term_stats": ["term"], "chunks": ["doc_id"], "embedding_cache": ["model"]}
        if many:
            self.publish({name: self.stage(name, self.read(name, manifest), order.get(name)) for name in many}, replace=True)
        return many

    def clean(self) -> None:
        """Deletes segments that the manifest does not name; not while others read them."""
        kept = {f.rpartition("/")[0] for segments in self.manifest()["tables"].values() for s in segments for f in s.values() if f}
        path, fs = self._path("v")
        if fs.exists(path):
            for s in fs.listStatus(path):
                if f"v/{s.getPath().getName()}" not in kept:
                    fs.delete(s.getPath(), True)
