"""Queries over incremental processing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumdex.operators.incremental import IncrementalJob, follow_log, run_bound, successful_runs
from vellumdex.session import shared_dir, table


def p2_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of a job's runs over the changed documents: ``doc_id, change, document_hash``.

    The first run brings the job's states up to the middle of the successful runs. The second one, bounded
    by the greatest successful run when it starts, reads only what the log got after
    the first one's watermark and compares the documents with the states of both. The output is
    read back from the commit.
    """
    documents, log, runs = (table(spark, sf_dir, n) for n in ("documents", "ingest_log", "ingest_runs"))
    job = IncrementalJob(spark, f"{shared_dir(spark)}/jobs/ingest-{uuid.uuid4().hex}")
    middle = successful_runs(runs).agg(F.percentile_approx("run_id", 0.5).alias("m")).first()["m"]
    follow_log(job, log, runs, None, middle)
    run = follow_log(job, log, runs, documents, run_bound(runs), columns=["doc_id", "document_hash"])
    return job.read_run(run.number, "changes")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the next ingest run must take."""
    return p2_run(spark, sf_dir).select("doc_id")


_CHANGED = """
  good as (select distinct run_id from ingest_runs where lower(trim(status)) = 'success'),
  logged as (
    select doc_id, lower(trim(source_hash)) as s, lower(trim(context_hash)) as c,
      row_number() over (partition by doc_id order by run_id desc, logged_at desc nulls last, source_hash desc nulls last, context_hash desc nulls last) as n
    from ingest_log where run_id in (select run_id from good)),
  compared as (
    select d.doc_id, d.document_hash, l.doc_id is null as fresh,
      lower(trim(coalesce(d.source_hash, sha256(d.text)))) is not distinct from l.s and lower(trim(d.context_hash)) is not distinct from l.c as same
    from documents d left join logged l on l.doc_id = d.doc_id and l.n = 1)"""

QUERIES = {"p2_found": p2_found, "p2_run": p2_run}
ORACLES = {
    "p2_found": f"with {_CHANGED} select doc_id from compared where fresh or not same",
    "p2_run": f"with {_CHANGED} select doc_id, case when fresh then 'new' else 'changed' end as change, document_hash from compared where fresh or not same",
}
