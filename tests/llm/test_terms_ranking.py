import math
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from vellumdex.llm import ranking as R
from vellumdex.llm import terms as X

SCHEMA = "chunk_rowid bigint, term string, tf int, collection_id string"


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(7)
    rows = [(int(r.integers(0, 30)), f"w{int(r.zipf(1.5)) % 50}", int(r.integers(-1, 8)), "c") for _ in range(1500)]
    rows += [(i, "the", 2, "c") for i in range(30)] * 20
    rows += [(1, "Ｔｈｅ", 9, "c"), (1, " THE\u3000", 3, "c"), (1, "ﬁn", 1, "c"), (1, "fin ", 4, "c"), (1, "", 4, "c"), (1, " \t", 4, "c"), (1, None, 4, "c"), (1, "x", None, "c"), (1, "x", 0, "c"), (99, "gone", 5, "c"), (None, "n", 5, "c"), (2, "only\n", 4, "c")]
    chunks = [(i, "t", f"w{i}") for i in range(25)] + [(3, "t", "again"), (None, "t", "n"), (50, "t", "empty")]
    return rows, chunks, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(chunks, "id bigint, text string, term string")


def brute(rows, chunks):
    ids = {i for i, *_ in chunks if i is not None}
    best = {}
    for record, term, tf, _ in rows:
        if term is None or tf is None or tf < 1 or record not in ids:
            continue
        term = unicodedata.normalize("NFKC", term).lower().strip()
        if term:
            best[record, term] = max(tf, best.get((record, term), 0))
    return best, len(ids)


def test_counts_match_brute_force(spark, tables):
    rows, chunks, terms, records = tables
    best, n = brute(rows, chunks)
    df, cf = defaultdict(int), defaultdict(int)
    for (_, t), tf in best.items():
        df[t] += 1
        cf[t] += tf
    want = {(t, df[t], cf[t], "rare" if df[t] <= 2 else "common" if df[t] > 0.2 * n else None) for t in df}
    assert {tuple(r) for r in X.term_counts(terms, records).collect()} == want


def test_heavy_terms_change_nothing(spark, tables):
    rows, chunks, terms, records = tables
    found = X.survey(terms, records, part=0.05)
    assert "the" in found.heavy and X.heavy_terms(terms, 0.05) == found.heavy and found.n_gone == 6
    packs = X.packed_postings(terms, found)
    few = {tuple(r) for r in X.term_frequencies(packs, []).collect()}
    assert {tuple(r) for r in X.term_frequencies(packs, ["the", "w1", "absent"]).collect()} == few


def test_hot_records_in_parts_and_rows_in_any_order(spark, tables):
    rows, chunks, terms, records = tables
    best, _ = brute(rows, chunks)
    found = X.survey(terms, records)
    mixed = spark.createDataFrame([rows[i] for i in np.random.default_rng(3).permutation(len(rows))], SCHEMA).repartition(7)
    for hot in ([], [1, 3], list(range(25))):
        frame = X.packed_postings(mixed, found._replace(hot=hot))
        rows_of = [tuple(r) for r in X.unpacked(frame).collect()]
        assert {(r, t): tf for r, t, tf in rows_of} == best and len(rows_of) == len(best)
        packs = frame.collect()
        assert len({(p["record"], p["part"]) for p in packs}) == len(packs) and sum(p["length"] for p in packs) == sum(best.values())
    assert len([p for p in packs if p["record"] == 1]) > 1
    small = [b for n in (1, 2, 5) for b in X._merged(iter(_batches(sorted(packs, key=lambda p: (p["record"], p["part"])), n)))]
    assert sum(len(t.split(X.SEPARATOR)) for b in small for t in b.column(2).to_pylist()) == 3 * len(best)


def test_separators_in_terms(spark):
    odd = ["a\x1fb", "a\x1bS", "a\x1bEb", "\x1b", "a\x1b\x1fb", "a,b", "a b", "\x1fa"]
    rows = [(i, t, i + 1) for i in range(2) for t in odd] + [(5, "a", 7)]
    frame = spark.createDataFrame(rows, "chunk_rowid bigint, term string, tf int")
    want = {(i, t.strip().lower(), n) for i, t, n in rows}
    assert {tuple(r) for r in X.clean_postings(frame).collect()} == want
    known = spark.range(6)
    assert {r["term"] for r in X.term_counts(frame, known).collect()} == {t for _, t, _ in want} == {r["term"] for r in X.distinctive_terms(frame, known).collect()}


def _batches(packs, n):
    import pyarrow as pa

    schema = pa.schema([("record", pa.int64()), ("part", pa.int32()), ("terms", pa.string()), ("tfs", pa.string())])
    return [pa.RecordBatch.from_pylist([{k: p[k] for k in schema.names} for p in packs[i : i + n]], schema) for i in range(0, len(packs), n)]


def test_whole_lengths_of_hot_records(spark, tables, monkeypatch):
    *_, terms, records = tables
    plain = {(r["record"], r["term"]): r["z"] for r in X.distinctive_terms(terms, records).collect()}
    usual = X.survey
    monkeypatch.setattr(X, "survey", lambda *a, **k: usual(*a, **k)._replace(hot=[1, 2, 3], heavy=["the"]))
    hot = {(r["record"], r["term"]): r["z"] for r in X.distinctive_terms(terms, records).collect()}
    assert hot.keys() == plain.keys() and all(abs(hot[k] - plain[k]) < 1e-9 for k in plain)


def test_text_records(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", "X", 3), ("c", "y", 1)], "chunk_rowid string, term string, tf int")
    got = {tuple(r) for r in X.term_counts(rows, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {("x", 2, 5, "rare")}


def test_scores_match_brute_force(spark, tables):
    rows, chunks, terms, records = tables
    best, _ = brute(rows, chunks)
    cf, df, length = defaultdict(int), defaultdict(int), defaultdict(int)
    for (i, t), tf in best.items():
        cf[t] += tf
        df[t] += 1
        length[i] += tf
    total = sum(cf.values())
    got = {(r["record"], r["term"]): r for r in X.distinctive_terms(terms, records).collect()}
    assert got.keys() == best.keys()
    for (i, t), tf in best.items():
        a, b = tf + cf[t], 2 * cf[t] - tf
        z = (math.log(a / (length[i] + total - a)) - math.log(b / (2 * total - length[i] - b))) / math.sqrt(1 / a + 1 / b)
        assert abs(got[i, t]["z"] - z) < 1e-9 and got[i, t]["df"] == df[t]


def test_empty_and_single(spark, tables):
    *_, terms, records = tables
    assert X.term_counts(terms.limit(0), records).count() == 0 and X.distinctive_terms(terms.limit(0), records).count() == 0
    assert X.term_counts(terms, records.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a", 3, "c")], SCHEMA)
    row = X.distinctive_terms(one, spark.createDataFrame([(1,)], "id bigint")).first()
    assert row["z"] == 0.0 and row["df"] == 1


RESULT = "query_id bigint, chunk_rowid bigint, searched_at string, fusion_score double, rerank_score double, vector_rank int, bm25_rank int"


HOT = [(1, "x", 4), (1, "fill", 100), (2, "x", 100), (3, "x", 100), (3, "few", 3)]
ALONE = [(1, "a", 5), (1, "b", 4), (1, "c", 3)]


@pytest.mark.parametrize("rows, want", [(HOT, {(1, "x"), (1, "fill"), (2, "x"), (3, "x")}), (ALONE, {(1, "a"), (1, "b")})])
def test_found_terms_need_no_positive_score(spark, tmp_path, rows, want):
    from vellumdex.llm import queries

    spark.createDataFrame(rows, "chunk_rowid bigint, term string, tf int").write.parquet(f"{tmp_path}/bm25_terms.parquet")
    spark.createDataFrame(sorted({r[:1] for r in rows}), "id bigint").write.parquet(f"{tmp_path}/chunks.parquet")
    assert sorted(map(tuple, queries.p5_found(spark, str(tmp_path)).collect())) == sorted(want)
    lowest = queries.p5_scores(spark, str(tmp_path)).where("tf >= 4").agg({"z": "min"}).first()[0]
    assert lowest <= 0


def brute_ranks(values):
    """Mean rank of ties from 0 to 1; None is worst at 0."""
    n = len(values)
    out = []
    for v in values:
        if v is None or n < 2:
            out.append(0.0)
        else:
            below = sum(1 for o in values if o is None or o < v)
            out.append((below + (sum(1 for o in values if o == v) - 1) / 2) / (n - 1))
    return out


@pytest.mark.parametrize("bucket", [100_000, 5])
def test_ranks_and_weights(spark, bucket):
    r = np.random.default_rng(2)
    rows = []
    for q in range(4):
        for c in range(60 if q == 0 else 12):
            base = r.normal()
            pick = lambda v: None if r.random() < 0.15 else float("nan") if r.random() < 0.05 else v
            rows.append((q, c, "1", pick(round(base, 1)), pick(1e6 * base + r.normal()), None if r.random() < 0.2 else int(20 - 5 * base), None if r.random() < 0.2 else int(30 - 4 * base)))
    df = spark.createDataFrame(rows + rows[:10], RESULT)
    single = R.deduplicated(df, "query_id", "chunk_rowid", list(R.SEARCH_SIGNALS), "searched_at")
    got = {(x["query_id"], x["chunk_rowid"]): x for x in R.rank_transform(single, "query_id", "chunk_rowid", R.SEARCH_SIGNALS, bucket).collect()}
    assert len(got) == len(rows)
    clean = lambda v: None if v is None or v != v else v
    matrix = {}
    for q in range(4):
        mine = [x for x in rows if x[0] == q]
        for j, (s, way) in enumerate(R.SEARCH_SIGNALS.items()):
            values = [None if clean(x[3 + j]) is None else clean(x[3 + j]) * (1 if way == "higher" else -1) for x in mine]
            for x, rank in zip(mine, brute_ranks(values)):
                assert abs(got[q, x[1]][f"r_{s}"] - rank) < 1e-12
                matrix.setdefault((q, x[1]), []).append(rank)
    m = np.array(list(matrix.values()))
    weights = R.principal_weights(R.rank_transform(single, "query_id", "chunk_rowid", R.SEARCH_SIGNALS, bucket), [f"r_{s}" for s in R.SEARCH_SIGNALS])
    v = np.linalg.eigh(np.corrcoef(m.T))[1][:, -1]
    v = np.clip(v * np.sign(v.sum()), 0, None) / m.std(axis=0)
    assert np.allclose(list(weights.values()), v / v.sum())


def test_fused_edge_cases(spark):
    rows = [
        (1, 5, "1", 0.9, None, 1, None), (1, 6, "1", float("nan"), None, None, None), (1, 6, "1", float("nan"), None, None, None), (1, 7, "1", 0.1, None, 2, None),
        (2, 8, "1", None, None, None, None), (None, 9, "1", 1.0, 1.0, 1, 1), (3, 11, "1", 1.0, 1.0, 1, 1), (3, 10, "1", 1.0, 1.0, 1, 1), (4, 12, "1", 0.0, 9e300, 5, 5), (4, 12, "2", 5.0, -9e300, 1, 1), (4, 13, "1", 1.0, 0.0, 3, 3),
    ]
    fused = R.fuse_rankings(spark.createDataFrame(rows, RESULT))
    assert fused.count() == 9
    first = {r["query_id"]: r["chunk_rowid"] for r in R.first_of_group(fused).collect()}
    assert first == {1: 5, 2: 8, None: 9, 3: 10, 4: 12}
    for bucket in (100_000, 1):
        ranks = {(r["query_id"], r["chunk_rowid"]): r["rank"] for r in R.with_rank(fused, bucket_rows=bucket).collect()}
        assert ranks == {(1, 5): 1, (1, 7): 2, (1, 6): 3, (2, 8): 1, (None, 9): 1, (3, 10): 1, (3, 11): 1, (4, 12): 1, (4, 13): 2}
    empty = R.fuse_rankings(spark.createDataFrame([], RESULT))
    assert empty.count() == 0 and R.first_of_group(empty).count() == 0


def test_an_opposing_score_gets_no_weight(spark):
    r = np.random.default_rng(4)
    base = r.random(300)
    rows = [(i, float(b), float(b + 0.1 * e), float(b + 0.2 * e), float(-b + 0.1 * e)) for i, (b, e) in enumerate(zip(base, r.random(300)))]
    frame = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    weights = R.principal_weights(frame, ["a", "b", "c", "d"])
    assert weights["d"] == 0.0 and min(weights["a"], weights["b"], weights["c"]) > 0 and abs(sum(weights.values()) - 1) < 1e-9


def test_items_may_be_text(spark):
    rows = [("q", "x", "1", 0.9, 0.9, 1, 1), ("q", "a", "1", 0.9, 0.9, 1, 1), ("q", None, "1", 0.9, 0.9, 1, 1), ("q", "z", "1", 0.1, None, 2, 2)]
    fused = R.fuse_rankings(spark.createDataFrame(rows, RESULT.replace("query_id bigint, chunk_rowid bigint", "query_id string, chunk_rowid string")))
    assert [tuple(r) for r in R.first_of_group(fused).collect()] == [("q", "a")]
