import hashlib

import pytest

from vellumdex.operators.incremental import CommitConflict, IncrementalJob, changed_records, run_bound

RUNS = "run_id bigint, collection_id string, status string"
LOG = "run_id bigint, doc_id bigint, source_hash string, context_hash string, logged_at string"
DOCS = "doc_id bigint, text string, source_hash string, context_hash string, change string"  # the last clashes with the result's own


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_changed_records(spark):
    runs = spark.createDataFrame([(1, "c", " Success "), (1, "c", "success"), (2, "c", "failed"), (3, "c", None), (4, "c", "SUCCESS")], RUNS)
    log = spark.createDataFrame(
        [
            (1, 10, sha("a"), "C", "1"), (1, 10, sha("a"), "C", "1"),  # same, logged twice
            (1, 11, sha("old"), "C", "1"), (4, 11, " " + sha("b").upper() + " ", "c", None),  # the greater run counts
            (1, 12, sha("x"), "C", "2"), (1, 12, sha("c"), "C", "1"),  # the later row of one run counts
            (2, 13, sha("d"), "C", "9"),  # only a failed run
            (1, 14, sha("e"), "other", "1"), (1, 99, sha("gone"), "C", "1"),
            (1, 16, None, None, "1"),
        ],
        LOG,
    )
    docs = spark.createDataFrame(
        [(10, "a", None, "c", "x"), (11, "b", sha("b"), "C", "x"), (12, "c", sha("c"), "C", "x"), (13, "d", sha("d"), "C", "x"), (14, "e", sha("e"), "C", "x"), (15, None, sha("n"), None, "x"), (16, None, None, None, "x"), (None, "z", None, None, "x")],
        DOCS,
    )
    got = sorted((r["doc_id"] or 0, r["change"]) for r in changed_records(docs, log, runs).collect())
    assert got == [(0, "new"), (12, "changed"), (13, "new"), (14, "changed"), (15, "new")]
    assert run_bound(runs) == 4
    early = {r["doc_id"] for r in changed_records(docs, log, runs, bound=1).collect()}
    assert 11 in early
    empty = changed_records(docs, log.limit(0), runs.limit(0))
    assert empty.count() == docs.count()
    assert changed_records(docs.limit(0), log, runs).count() == 0


def test_failure_leaves_nothing(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    source = spark.range(10).withColumnRenamed("id", "seq")
    job.run(3, lambda r: job.select(r, source, "seq"))
    assert job.watermark() == 3

    broken = job.start(6)
    job.write(broken, job.select(broken, source, "seq"))  # breaks off before the commit
    assert sorted(r["seq"] for r in job.read().collect()) == [0, 1, 2, 3]

    with pytest.raises(ZeroDivisionError):
        job.run(6, lambda r: 1 / 0)
    job.run(8, lambda r: job.select(r, source, "seq"))
    assert sorted(r["seq"] for r in job.read().collect()) == list(range(9))
    with pytest.raises(CommitConflict):
        job.commit(broken, "data/other")
    assert job.clean() == 1
    assert sorted(r["seq"] for r in job.read().collect()) == list(range(9))
    assert sorted(r["seq"] for r in job.read_run(1).collect()) == [4, 5, 6, 7, 8]


def test_bound_is_fixed_at_the_start(spark, tmp_path):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    run = job.start(2)
    source = spark.range(5).withColumnRenamed("id", "seq")  # rows 3 and 4 came after the start
    job.commit(run, job.write(run, job.select(run, source, "seq")))
    job.run(4, lambda r: job.select(r, source, "seq"))
    assert sorted(r["seq"] for r in job.read().collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("bounds", [(8, None, 9), (8, 3, 9), (None, 8, 9), (8, 8, 9)])
def test_watermark_never_goes_back(spark, tmp_path, bounds):
    job = IncrementalJob(spark, str(tmp_path / "job"))
    source = spark.range(10).withColumnRenamed("id", "seq")
    marks = []
    for high in bounds:
        job.run(high, lambda r: job.select(r, source, "seq"))
        marks.append(job.watermark())
    assert sorted(r["seq"] for r in job.read().collect()) == list(range(10)) and marks[-1] == 9
    assert [m for m in marks if m is not None] == sorted(m for m in marks if m is not None)


def test_one_of_two_committers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    job = IncrementalJob(spark, str(tmp_path / "job"))
    runs = [job.start(5) for _ in range(8)]
    outputs = [job.write(r, spark.range(3)) for r in runs[:1]] * 8

    def commit(i):
        try:
            job.commit(runs[i], outputs[i])
            return 1
        except CommitConflict:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(commit, range(8))) == 1
    assert len(job.manifests()) == 1 and job.manifests()[0]["attempt"] in {r.attempt for r in runs}


def test_following_a_log_reads_each_row_once(spark, tmp_path):
    from vellumdex.operators.incremental import follow_log

    runs = spark.createDataFrame([(i, "c", "success") for i in (1, 2, 3)] + [(4, "c", "failed")], RUNS)
    rows = [(1, 10, "a", "C", "1"), (1, 11, "b", "C", "1"), (2, 11, "B2", "C", "1"), (3, 12, "c", "C", "1"), (4, 13, "d", "C", "1")]
    log = spark.createDataFrame(rows, LOG)
    docs = spark.createDataFrame([(10, "", "a", "C", "x"), (11, "", "b2", "C", "x"), (12, "", "other", "C", "x"), (13, "", "d", "C", "x")], DOCS)
    job = IncrementalJob(spark, str(tmp_path / "job"))
    follow_log(job, log, runs, None, 2)
    run = follow_log(job, log.where("run_id > 2"), runs, docs, 4, columns=["doc_id"])  # earlier rows are not needed any more
    assert {tuple(r) for r in job.read_run(run.number, "changes").collect()} == {(12, "changed"), (13, "new")}
    assert {r["doc_id"] for r in job.read_run(run.number, "states").collect()} == {12}
    again = follow_log(job, log, runs, docs, None, columns=["doc_id"])
    assert (again.low, again.high) == (4, 4) and {tuple(r) for r in job.read_run(again.number, "changes").collect()} == {(12, "changed"), (13, "new")}
    first = IncrementalJob(spark, str(tmp_path / "first"))
    run = follow_log(first, log.limit(0), runs.limit(0), docs, None, columns=["doc_id"])
    assert first.read_run(run.number, "changes").where("change = 'new'").count() == 4


def test_texts_are_not_shuffled(spark):
    docs = spark.range(5).selectExpr("id as doc_id", "repeat('x', 50) as text", "string(null) as source_hash", "'c' as context_hash")
    states = spark.range(2).selectExpr("id as doc_id", "'s' as source_hash", "'c' as context_hash")
    from vellumdex.operators.incremental import changed_against

    plan = changed_against(docs, states).select("doc_id", "change")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan.split("Join")[0]
