"""Processing only records that are new or changed since the last successful run.

``IncrementalJob`` carries a run: its upper bound is fixed when it starts, it
writes its output to a folder of its own and then publishes, in one step that fails if another run was
faster, a manifest that names both the output and the new watermark. Output without a manifest does not
exist for readers, so that a run that breaks off leaves nothing behind, and the next one
starts from the same watermark. The watermark never goes back.

``follow_log`` is such a run over a log of states: it reads only the log's rows between the last
watermark and its bound, adds them to the states that earlier runs committed, and takes the records
that differ from them.
"""

from __future__ import annotations

import dataclasses
import json
import os
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.functions.text import clean_hash, sha256_hex
from vellumdex.session import written

_BLANKS = r"(?U)^[\s\p{Cntrl}]+|[\s\p{Cntrl}]+$"


def is_success(status: Column | str) -> Column:
    """Whether a run's status says success, whatever its case and outer blanks; null does not."""
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.lower(F.regexp_replace(status, _BLANKS, "")) == "success", F.lit(False))


def successful_runs(runs: DataFrame) -> DataFrame:
    """``run_id`` of each successful run, once."""
    return runs.where(is_success("status")).select("run_id").where("run_id is not null").distinct()


def run_bound(runs: DataFrame) -> int | None:
    """The greatest successful run just now; runs that end later stay outside."""
    row = successful_runs(runs).agg(F.max("run_id").alias("bound")).first()
    return row["bound"]


STATE = ("source_hash", "context_hash", "run_id", "logged_at")


def newest_states(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and its state of the greatest run, in it of the latest ``logged_at`` (null is earliest), then of the greatest hashes.

    One aggregation with map-side combine; a record with any number of rows is no burden.
    """
    last = rows.groupBy(key).agg(F.max(F.struct("run_id", "logged_at", "source_hash", "context_hash")).alias("last"))
    return last.select(key, *[f"last.{c}" for c in STATE])


def last_logged(log: DataFrame, runs: DataFrame, bound: int | None, key: str = "doc_id", after: int | None = None) -> DataFrame:
    """``key, source_hash, context_hash, run_id, logged_at`` as the last successful run up to ``bound`` (and after ``after``) logged each record.

    Both bounds reach the scan of the log. The table of runs is joined as its size allows.
    """
    within = F.col("run_id") <= F.lit(bound)
    within = within if after is None else within & (F.col("run_id") > F.lit(after))
    good = successful_runs(runs).where(within)
    rows = log.where(F.col(key).isNotNull() & within).select(key, "run_id", "logged_at", clean_hash("source_hash").alias("source_hash"), clean_hash("context_hash").alias("context_hash"))
    return newest_states(rows.join(good, "run_id", "left_semi"), key)


def _digest(source: Column, context: Column) -> Column:
    """Both hashes as one of 16 bytes, nulls as a value of their own; what is compared need not be shuffled in full."""
    return F.unhex(F.md5(F.concat(F.coalesce(source, F.lit("-")), F.lit("|"), F.coalesce(context, F.lit("-"))).cast("binary")))


def changed_against(records: DataFrame, states: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``records`` that are new or differ from ``states``, with ``change`` (``new`` or ``changed``).

    A record differs if its source or context hash does; letter case and outer blanks do
    not matter, and a missing source hash stands for the hash of the text. Hashes that are
    null on both sides are equal. Other columns decide nothing. Records with a null key are always new; states
    of records that are gone are no changes; repeated rows stay repeated. A column of the records that is called
    ``change`` is replaced; all others are kept. The hashes are made before the join, so that texts are shuffled
    only if the caller asks for them.
    """
    then = states.select(F.col(key).alias("_logged_key"), _digest(F.col("source_hash"), F.col("context_hash")).alias("_then"))
    own = clean_hash(F.coalesce(F.col("source_hash"), sha256_hex(F.col(text))))
    now = records.withColumn("_now", _digest(own, clean_hash("context_hash")))
    joined = now.join(then, now[key] == F.col("_logged_key"), "left")
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now") != F.col("_then"), "changed")
    return joined.withColumn("change", change).where("change is not null").drop("_logged_key", "_now", "_then")


def changed_records(records: DataFrame, log: DataFrame, runs: DataFrame, bound: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``changed_against`` the whole log up to ``bound``, by default the greatest successful run; without one all records are new."""
    bound = run_bound(runs) if bound is None else bound
    return changed_against(records, last_logged(log, runs, bound, key), key, text)


class CommitConflict(RuntimeError):
    """Another run has committed since this one started."""


@dataclasses.dataclass(frozen=True)
class Run:
    """A started run: it owns what was committed to its source after ``low`` up to ``high``, which is nothing if they are equal."""

    number: int
    low: int | None
    high: int | None
    attempt: str


class IncrementalJob:
    """A job whose state is a folder of manifests, on any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self._conf)

    def _names(self) -> list[str]:
        """File names of all commits in order; there is one per run."""
        path, fs = self._path("commits")
        if not fs.exists(path):
            return []
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(".json"))

    def manifests(self) -> list[dict]:
        """All commits in order."""
        return [self._read(f"commits/{n}") for n in self._names()]

    def _last(self) -> tuple[int, dict | None]:
        """The number of commits, and the last one; the others are not read."""
        names = self._names()
        return len(names), self._read(f"commits/{names[-1]}") if names else None

    def _read(self, name: str) -> dict:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def watermark(self) -> int | None:
        """How far the commits got; null before the first."""
        _, last = self._last()
        return last["high"] if last else None

    def start(self, high: int | None) -> Run:
        """Begins a run up to ``high``, which stays fixed however long the run takes.

        A bound that is null or not above the watermark gives an empty run at the watermark.
        """
        number, last = self._last()
        low = last["high"] if last else None
        if low is not None and (high is None or high < low):
            high = low
        return Run(number, low, high, uuid.uuid4().hex)

    def select(self, run: Run, source: DataFrame, sequence: str) -> DataFrame:
        """The rows of a source with a rising commit sequence that belong to the run."""
        if run.high is None:
            return source.where(F.lit(False))
        rows = source.where(F.col(sequence) <= F.lit(run.high))
        return rows if run.low is None else rows.where(F.col(sequence) > F.lit(run.low))

    def write(self, run: Run, output: DataFrame | Mapping[str, DataFrame]) -> str:
        """Writes the run's output, one table or several by name, where no reader looks yet; the folder."""
        name = f"data/run-{run.number:010d}-{run.attempt}"
        tables = output if isinstance(output, Mapping) else {"": output}
        for part, rows in tables.items():
            rows.write.parquet(f"{self.root}/{name}/{part}".rstrip("/"))
        return name

    def commit(self, run: Run, output: str) -> None:
        """Publishes output and watermark together, or neither; of several attempts at one run the first wins."""
        name = f"commits/{run.number:010d}.json"
        final, fs = self._path(name)
        fs.mkdirs(final.getParent())
        part, _ = self._path(f"staged/{run.number:010d}-{run.attempt}.json")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(dataclasses.asdict(run) | {"output": output}).encode()))
        stream.close()
        if not self._published(part, final, fs) or self._read(name)["attempt"] != run.attempt:
            raise CommitConflict(f"run {run.number} is committed already")

    def _published(self, part, final, fs) -> bool:
        """Gives a whole file its final name unless that is taken.

        A local rename would replace a file that is there, so that a link, which does not, is made
        instead; distributed file systems refuse such a rename.
        """
        if fs.getUri().getScheme() != "file":
            return not fs.exists(final) and fs.rename(part, final)
        local = lambda p: unquote(urlparse(p.toUri().toString()).path)
        try:
            os.link(local(fs.makeQualified(part)), local(fs.makeQualified(final)))
        except FileExistsError:
            return False
        fs.delete(part, False)
        return True

    def run(self, high: int | None, work: Callable[[Run], DataFrame | Mapping[str, DataFrame]]) -> Run:
        """Start, work, write and commit; if any step fails, nothing has happened."""
        run = self.start(high)
        self.commit(run, self.write(run, work(run)))
        return run

    def read(self, table: str = "") -> DataFrame | None:
        """All committed output (of one of a run's tables), or null before the first commit."""
        folders = [f"{self.root}/{m['output']}/{table}".rstrip("/") for m in self.manifests()]
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def read_run(self, number: int, table: str = "") -> DataFrame:
        """The committed output of one run."""
        return self.spark.read.parquet(f"{self.root}/{self.manifests()[number]['output']}/{table}".rstrip("/"))

    def clean(self) -> int:
        """Deletes what broken runs left; the number of folders. Not to be called during a run."""
        kept = {m["output"].rpartition("/")[2] for m in self.manifests()}
        path, fs = self._path("data")
        if not fs.exists(path):
            return 0
        stale = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in kept]
        for old in stale:
            fs.delete(old, True)
        return len(stale)


def follow_log(job: IncrementalJob, log: DataFrame, runs: DataFrame, records: DataFrame | None, high: int | None, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> Run:
    """One committed run over a log: tables ``states`` (what the log's new rows say) and ``changes``.

    Only log rows of successful runs after the watermark up to ``high`` are read; with the
    states of earlier runs they give the last logged state of each record. ``changes`` are the
    ``records`` that differ from it (``columns`` of them and ``change``); null records only bring
    the states up to date. Both tables and the watermark appear together or not at all.
    """

    def work(run: Run) -> dict[str, DataFrame]:
        empty = run.high is None or run.high == run.low
        fresh = last_logged(log, runs, run.high, key, run.low).where(F.lit(not empty))
        fresh = written(fresh)
        if records is None:
            return {"states": fresh}
        before = job.read("states")
        states = fresh if before is None else newest_states(before.unionByName(fresh), key)
        changed = changed_against(records, states, key, text)
        return {"states": fresh, "changes": changed.select(*(columns or records.columns), "change")}

    return job.run(high, work)
