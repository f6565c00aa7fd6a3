"""Term statistics of a collection: frequencies, and how distinctive a term is of a record.

Rows ``record, term, tf`` are cleaned once: terms are normalized (NFKC, lower case,
trimmed), rows without a term or with a count below 1 or of an unknown record are
dropped, and of several rows of one record and term the greatest count stays.

Two passes read the table. The survey finds heavy terms, hot records and unknown records.
The second pass packs the rows of a record that stand together into one row of lists; the packs
are exchanged once, by record, and everything that needs a record's rows together is done
behind that exchange: repeated rows are merged, record lengths are summed, heavy terms are
counted in one array per task. Only counts of the other terms are shuffled again, by term.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellumdex.functions.text import fold
from vellumdex.session import materialize, written

#: Unknown records up to this number are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_RECORDS = 500_000
#: A term is heavy, and a record hot, if it holds at least this part of all rows; there can be no more than 2 / part of each.
HEAVY_PART = 1 / 4096
#: Counters of the heavy-term search in a task, and of each batch's terms that enter it.
SKETCH_COUNTERS = 16_384
#: A hot record's rows are cut into so many parts by a hash of the term.
HOT_PARTS = 256
#: Between the terms of a pack; a term's own separators and escapes are written with the escape.
SEPARATOR, ESCAPE = "\x1f", "\x1b"
#: Rows of a survey's flush: a task holds no more counters than these at once.
FLUSH_RECORDS = 200_000


class Survey(NamedTuple):
    """What the first pass found: terms and records that hold a great part of all rows, and records that do not exist."""

    heavy: list[str]
    hot: list
    gone: DataFrame | None
    n_gone: int


def _folded(terms: pa.Array) -> pa.Array:
    """Normalized terms as packs hold them, null for blank ones; each distinct term of the batch is handled once."""
    coded = terms.dictionary_encode()
    names = [fold(t).strip() or None for t in coded.dictionary.to_pylist()]
    return _escaped(pa.array(names, pa.string())).take(coded.indices)


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("record is not null and term is not null and tf >= 1")


def survey(terms: DataFrame, records: DataFrame | None = None, record: str = "chunk_rowid", term: str = "term", tf: str = "tf", record_key: str = "id", part: float = HEAVY_PART) -> Survey:
    """One pass over the records' keys and the raw terms.

    Each task keeps a bounded set of counters for terms (space is freed by lowering all of them),
    so that no term of a task above rows / counters is missed, and adds up the rows of each
    record. Which terms are heavy and which records hot decides only where they are counted, not
    the counts. ``records`` lists the records that exist; null drops nothing.
    """
    kind = terms.schema[record].dataType
    arrow = to_arrow_type(kind)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, int] = {}
        sizes: dict = {}
        total = 0

        def rows_of(found: Iterable[tuple], is_term: bool) -> pa.RecordBatch:
            found = list(found)
            keys, n = [k for k, _ in found], pa.array([n for _, n in found], pa.int64())
            blank = pa.nulls(len(found))
            return pa.record_batch([blank.cast(arrow) if is_term else pa.array(keys, arrow), pa.array(keys, pa.string()) if is_term else blank.cast(pa.string()), n], ["record", "term", "n"])

        for batch in batches:
            total += batch.num_rows
            counts = pc.value_counts(batch.column(1))
            for t, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                counters[t] = counters.get(t, 0) + n
            if len(counters) > 2 * SKETCH_COUNTERS:
                floor = sorted(counters.values(), reverse=True)[SKETCH_COUNTERS]
                counters = {t: n - floor for t, n in counters.items() if n > floor}
            counts = pc.value_counts(batch.column(0))
            for r, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                sizes[r] = sizes.get(r, 0) + n
            if len(sizes) >= FLUSH_RECORDS:
                yield rows_of(sizes.items(), False)
                sizes.clear()
        yield rows_of(sizes.items(), False)
        yield rows_of([(t, n) for t, n in counters.items() if n >= total * part / 4], True)

    rows = _usable(terms.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(tf).alias("tf"))).select("record", F.lower("term").alias("term"))
    found = materialize(rows.mapInArrow(sketch, f"record {kind.simpleString()}, term string, n bigint").groupBy("record", "term").agg(F.sum("n").alias("n")))
    total = found.where("record is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = {True: [], False: []}
    for r in found.where(F.col("n") >= F.when(F.col("term").isNull(), max(2.0, total * part)).otherwise(max(2.0, total * part / 2))).collect():
        large[r["term"] is not None].append(r["record"] if r["term"] is None else r["term"])
    if records is None:
        return Survey(sorted(large[True]), large[False], None, 0)
    known = records.select(F.col(record_key).alias("record")).where("record is not null")
    gone = materialize(found.where("record is not null").select("record").join(known, "record", "left_anti"))
    return Survey(sorted(large[True]), large[False], gone, gone.count())


def heavy_terms(terms: DataFrame, part: float = HEAVY_PART, **names: str) -> list[str]:
    """Terms that may hold at least ``part`` of all rows, never more than ``2 / part`` of them."""
    return survey(terms, None, part=part, **names).heavy


def _joined(record: pa.Array, part: pa.Array, terms: pa.ListArray, tfs: pa.ListArray, **more: pa.Array) -> pa.RecordBatch:
    """Packs with their lists written as strings, which take less than half of the room in an exchange or a file."""
    counts = pa.ListArray.from_arrays(tfs.offsets, tfs.values.cast(pa.string()))
    return pa.record_batch([record, part, pc.binary_join(terms, SEPARATOR), pc.binary_join(counts, ","), *more.values()], ["record", "part", "terms", "tfs", *more])


def _split(column: pa.Array, of_terms: bool) -> pa.ListArray:
    lists = pc.split_pattern(column, SEPARATOR if of_terms else ",")
    return lists if of_terms else pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.int64()))


def _escaped(names: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(names, ESCAPE, ESCAPE + "E"), SEPARATOR, ESCAPE + "S")


def _plain(names: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(names, ESCAPE + "S", SEPARATOR), ESCAPE + "E", ESCAPE)


def _packs(batches: Iterable[pa.RecordBatch], hot: list) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one record as one row: ``record, part, terms, tfs``; hot records are cut into parts by term."""
    for batch in batches:
        term = _folded(batch.column(1))
        batch = pa.record_batch([batch.column(0), term, batch.column(2)], ["record", "term", "tf"]).filter(pc.is_valid(term))
        n = batch.num_rows
        if not n:
            continue
        record = batch.column(0).dictionary_encode().indices.to_numpy()
        part = np.zeros(n, np.int32)
        if hot and (is_hot := pc.is_in(batch.column(0), pa.array(hot, batch.column(0).type)).to_numpy(zero_copy_only=False)).any():
            coded = batch.column(1).dictionary_encode()
            place = np.array([zlib.crc32(t.encode("utf-8", "replace")) % HOT_PARTS for t in coded.dictionary.to_pylist()], np.int32)
            part = np.where(is_hot, place[coded.indices.to_numpy()], 0).astype(np.int32)
            order = np.lexsort((part, record))
            batch, record, part = batch.take(pa.array(order)), record[order], part[order]
        start = np.flatnonzero(np.concatenate([[True], (record[1:] != record[:-1]) | (part[1:] != part[:-1])]))
        offsets = pa.array(np.append(start, n).astype(np.int32))
        yield _joined(batch.column(0).take(pa.array(start)), pa.array(part[start]), pa.ListArray.from_arrays(offsets, batch.column(1)), pa.ListArray.from_arrays(offsets, batch.column(2)))


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by record and part, those of one record and part made one, each term once with its greatest count."""
    waiting: list[pa.RecordBatch] = []

    def merge(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        record, part, terms, tfs = (c.chunk(0) for c in table.columns)
        terms, tfs = _split(terms, True), _split(tfs, False)
        key = record.dictionary_encode().indices.to_numpy().astype(np.int64) * HOT_PARTS + part.to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.repeat(np.cumsum(np.isin(np.arange(len(key)), first)) - 1, pc.list_value_length(terms).to_numpy())
        coded = terms.flatten().dictionary_encode()
        width = len(coded.dictionary)
        place = group * width + coded.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        place = place[order]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        best = np.maximum.reduceat(tfs.flatten().to_numpy()[order], start)
        owner = place[start] // width
        offsets = pa.array(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32))
        names = coded.dictionary.take(pa.array(place[start] % width))
        at = pa.array(first)
        lengths = pa.array(np.add.reduceat(best, np.searchsorted(owner, np.arange(len(first)))))
        return _joined(record.take(at), part.take(at), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(best)), length=lengths)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = (batch.column(0)[-1], batch.column(1)[-1])
        same = batch.num_rows  # rows of the last record and part can go on in the next batch
        while same and batch.column(1)[same - 1] == last[1] and batch.column(0)[same - 1] == last[0]:
            same -= 1
        if same:
            yield merge([*waiting, batch.slice(0, same)])
            waiting = []
        waiting.append(batch.slice(same))
    if waiting:
        yield merge(waiting)


PACKED = "part int, terms string, tfs string"


def _together(terms: DataFrame, found: Survey, record: str = "chunk_rowid", term: str = "term", tf: str = "tf", record_key: str = "id") -> DataFrame:
    """The only exchange of all rows: packs by record and part, sorted by them."""
    hot = found.hot
    kind = terms.schema[record].dataType.simpleString()
    rows = _usable(terms.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(tf).cast("bigint").alias("tf")))
    packs = rows.mapInArrow(lambda batches: _packs(batches, hot), f"record {kind}, {PACKED}")
    if found.n_gone:
        packs = packs.join(F.broadcast(found.gone) if found.n_gone <= BROADCAST_RECORDS else found.gone, "record", "left_anti")
    return packs.repartition("record", "part").sortWithinPartitions("record", "part")


def packed_postings(terms: DataFrame, found: Survey, **names: str) -> DataFrame:
    """``record, part, terms, tfs, length``: each existing record's terms with their greatest counts, in one row; hot records in several.

    ``terms`` and ``tfs`` are lists written as strings (see ``unpacked``), ``length`` is the sum of the
    counts in the row. Nulls in any column drop the row; other columns are ignored.
    """
    together = _together(terms, found, **names)
    return together.mapInArrow(_merged, f"record {together.schema['record'].dataType.simpleString()}, {PACKED}, length bigint")


def unpacked(packs: DataFrame, *more: str) -> DataFrame:
    """``record, term, tf`` of packs, and the columns ``more``."""
    plain = lambda t: F.replace(F.replace(t, F.lit(ESCAPE + "S"), F.lit(SEPARATOR)), F.lit(ESCAPE + "E"), F.lit(ESCAPE))
    pairs = F.arrays_zip(F.split("terms", SEPARATOR).alias("term"), F.split("tfs", ",").cast("array<bigint>").alias("tf"))
    rows = packs.select("record", *more, F.explode(pairs).alias("p"))
    return rows.select("record", *more, plain(F.col("p.term")).alias("term"), F.col("p.tf").alias("tf"))


def clean_postings(terms: DataFrame, records: DataFrame | None = None, **names: str) -> DataFrame:
    """``record, term, tf``, one row per record and term."""
    return unpacked(packed_postings(terms, survey(terms, records, **names), **names))


def _counted(batches: Iterable[pa.RecordBatch], heavy: list[str], terms: int = 0, tfs: int = 1) -> Iterator[pa.RecordBatch]:
    """Counts of a task's merged packs: heavy terms in one array, the others added up by batch."""
    names = pa.array(heavy, pa.string())
    df, cf = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = _split(batch.column(terms), True).flatten().dictionary_encode()
        code, found = coded.indices.to_numpy(), _plain(coded.dictionary)
        records = np.bincount(code, minlength=len(found))
        order = np.argsort(code, kind="stable")
        sums = np.add.reduceat(_split(batch.column(tfs), False).flatten().to_numpy()[order], np.cumsum(records) - records)
        slot = pc.index_in(found, names)
        light = np.asarray(pc.is_null(slot))
        slots = pc.drop_null(slot).to_numpy()
        df[slots] += records[~light]
        cf[slots] += sums[~light]
        yield pa.record_batch([found.filter(pa.array(light)), pa.array(records[light]), pa.array(sums[light])], ["term", "df", "cf"])
    yield pa.record_batch([names, pa.array(df), pa.array(cf)], ["term", "df", "cf"])


_COUNTED = "term string, df bigint, cf bigint"


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


def term_frequencies(packs: DataFrame, heavy: list[str]) -> DataFrame:
    """``term, df, cf``: in how many records each term occurs and how often in all.

    ``packs`` is what ``packed_postings`` gives. Heavy terms are counted in one array per task and
    only the arrays' sums are shuffled; the other terms are added up by batch and then
    shuffled. The tables of both are then one.
    """
    return _summed(packs.select("terms", "tfs").mapInArrow(lambda batches: _counted(batches, heavy), _COUNTED))


def term_counts(terms: DataFrame, records: DataFrame, rare_df: int = 2, common_part: float = 0.2, **names: str) -> DataFrame:
    """``term, df, cf, mark`` of every term of the collection.

    ``mark`` is ``rare`` if at most ``rare_df`` records hold the term, ``common`` if more
    than ``common_part`` of all distinct records do, else null; a term that is both, in a
    tiny collection, is ``rare``. Empty tables give an empty result.
    """
    found = survey(terms, records, **names)
    heavy = found.heavy
    counts = _summed(_together(terms, found, **names).mapInArrow(lambda batches: _counted(_merged(batches), heavy, 2, 3), _COUNTED))
    known = records.select(F.col(names.get("record_key", "id")).alias("id")).agg(F.count_distinct("id").alias("n")).first()["n"]
    mark = F.when(F.col("df") <= rare_df, "rare").when(F.col("df") > F.lit(common_part * known), "common")
    return counts.select("term", "df", "cf", mark.alias("mark"))


def distinctive_terms(terms: DataFrame, records: DataFrame, prior_weight: float = 1.0, **names: str) -> DataFrame:
    """``record, term, tf, df, cf, log_odds, z``: how much each term marks out its record.

    The log-odds of the term in the record against all other records, over its standard
    error. Both sides are smoothed by a Dirichlet prior that counts each term
    ``prior_weight`` times as often as the whole collection has it: a frequent term
    must stand out by far to score, a rare one gathered in few records scores high.
    Positive means more typical of the record than of the rest. Where the collection has
    a single term, the score is 0.

    Terms above ``HEAVY_PART`` get their counts from a broadcast table, which their
    number bounds, and are never shuffled by term; the others are joined by term. A record's length
    stands in its packs; only hot records, whose number is bounded too, add theirs up.
    """
    found = survey(terms, records, **names)
    packs = written(packed_postings(terms, found, **names))
    counts = written(term_frequencies(packs, found.heavy))
    spark = terms.sparkSession
    if found.hot:
        hot = F.col("record").isin(found.hot)
        whole = packs.where(hot).groupBy("record").agg(F.sum("length").alias("_whole"))
        packs = packs.join(F.broadcast(whole), "record", "left").withColumn("length", F.coalesce("_whole", "length")).drop("_whole")
    rows = unpacked(packs, "length")
    names_of = spark.createDataFrame([(t,) for t in found.heavy], "term string")
    few = counts.join(F.broadcast(names_of), "term", "left_semi")
    many = counts.join(F.broadcast(names_of), "term", "left_anti")
    light = rows.join(F.broadcast(names_of), "term", "left_anti").join(many, "term")
    joined = rows.join(F.broadcast(few), "term").unionByName(light)
    total = F.lit(float(counts.agg(F.sum("cf")).first()[0] or 0))
    weight = F.lit(float(prior_weight))
    inside, outside = F.col("tf") + weight * F.col("cf"), F.col("cf") - F.col("tf") + weight * F.col("cf")
    against_in = F.col("length") + weight * total - inside
    against_out = total - F.col("length") + weight * total - outside
    log_odds = F.ln(F.try_divide(inside, against_in)) - F.ln(F.try_divide(outside, against_out))
    scored = joined.withColumn("log_odds", F.coalesce(log_odds, F.lit(0.0)))
    return scored.select("record", "term", F.col("tf").cast("int").alias("tf"), "df", "cf", "log_odds", F.coalesce(F.col("log_odds") / F.sqrt(1 / inside + F.try_divide(F.lit(1.0), outside)), F.lit(0.0)).alias("z"))
