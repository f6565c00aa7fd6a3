"""The queries over the training-text operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumdex.functions import text as tx
from vellumdex.llm import language, markup, mixture, ranking, splitting, terms, tokenizer
from vellumdex.plans.sql_text import HAN, WORDS, sql_norm
from vellumdex.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose text has more than the atoms that a chunk may have: those that the splitter cuts."""
    pieces = splitting.split_chunks(table(spark, sf_dir, "chunks"))
    return pieces.where("n_pieces > 1 and piece = 1").select("id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, oversized ones cut into pieces."""
    return splitting.split_chunks(table(spark, sf_dir, "chunks"))


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chunk the hash of its text put together again from its pieces, and whether all pieces and overlaps keep their limits."""
    pieces = p1_pieces(spark, sf_dir).select("id", "piece", "text", "start", "stop").distinct()
    before = F.lag("stop").over(Window.partitionBy("id").orderBy("piece"))
    shared = F.greatest(F.coalesce(before, F.lit(0)) - F.col("start"), F.lit(0))
    parts = pieces.withColumn("shared", shared).withColumn("fresh", F.expr("substring(text, shared + 1)")).withColumn("again", F.expr("substring(text, 1, shared)"))
    atoms = lambda c: tx.atom_count(tx.nfkc_lower(c))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "fresh"))), lambda x: x["fresh"]), "")
    return parts.groupBy("id").agg(
        tx.sha256_hex(joined).alias("text_hash"), F.bool_and(atoms("text") <= splitting.MAX_ATOMS).alias("within_limit"), F.bool_and(atoms("again") <= splitting.OVERLAP).alias("within_overlap"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of markup that prose chunks still hold."""
    prose = table(spark, sf_dir, "chunks").where("chunk_type = 'text'")
    return markup.find_markup(prose).select("id", F.explode("kinds").alias("markup")).distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of prose chunks, with the shapes that their lines had."""
    prose = table(spark, sf_dir, "chunks").where("chunk_type = 'text'")
    return markup.clean_markup(prose)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that stands first in each query's fused ranking."""
    return ranking.first_of_group(ranking.fuse_rankings(table(spark, sf_dir, "search_results")))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its rank-transformed scores, the fused score and its rank in the query."""
    return ranking.with_rank(ranking.fuse_rankings(table(spark, sf_dir, "search_results")))


def p4_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank-transformed scores of every result, as they enter the fusion."""
    ranks = ranking.fuse_rankings(table(spark, sf_dir, "search_results")).drop("fused")
    return ranks.select("query_id", "chunk_rowid", *[F.round(f"r_{s}", 9).alias(f"r_{s}") for s in ranking.SEARCH_SIGNALS])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = terms.distinctive_terms(table(spark, sf_dir, "bm25_terms"), table(spark, sf_dir, "chunks"))
    return scores.withColumnRenamed("record", "chunk_rowid")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How distinctive each term is of its chunk, rounded to five digits."""
    return _scores(spark, sf_dir).withColumn("log_odds", F.round("log_odds", 5) + 0.0).withColumn("z", F.round("z", 5) + 0.0)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a count of 4 or more that at most 3 chunks hold, the most typical of their chunk first in each part."""
    return _scores(spark, sf_dir).where("tf >= 4 and df <= 3").sortWithinPartitions(F.desc("z")).select("chunk_rowid", "term")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many chunks, and how often, each term occurs, and its mark."""
    return terms.term_counts(table(spark, sf_dir, "bm25_terms"), table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p6_counts(spark, sf_dir).where("mark is not null").select("term", "mark")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each document that is taken, and how often."""
    mix, _ = mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mix


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and reached shares of the mix at the size of the targeted sources."""
    _, shares = mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return shares


def p8_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the largest size at which every source with documents reaches its target."""
    _, shares = mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "exact")
    return shares


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mix keeps what its report says: caps, sums made anew from the mix, and shares within one record of the plan."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mix, shares = mixture.mix_sources(documents, targets)
    anew = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("again"), F.max("n_tokens").alias("longest"), F.count_distinct("doc_id").alias("ids"), F.count("*").alias("rows"))
    both = shares.join(anew, "source", "left")
    planned = F.col("epochs") * F.col("source_tokens")
    return both.select(
        "source", "n_docs", "max_repeats", F.round("target_share", 9).alias("target_share"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"), (F.col("tokens") == F.coalesce("again", F.lit(0))).alias("sums_agree"),
        (F.abs(F.col("tokens") - planned) <= F.coalesce("longest", F.lit(0)) + 1).alias("within_one_record"), (F.coalesce("ids", F.lit(0)) == F.coalesce("rows", F.lit(0))).alias("each_once"),
    )


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of each document and passage, and the language its label names."""
    documents = table(spark, sf_dir, "documents")
    codes = language.language_codes(table(spark, sf_dir, "lang_codes"))
    profiles = language.fit_from_documents(documents, codes)
    return language.identify_languages(documents, profiles, label=language.label_code(F.col("lang"), codes))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole sentences that the document's label does not name."""
    found = p9_passages(spark, sf_dir).where("sentences > 0 and lang is not null")
    return found.where("label is null or label != lang").select("doc_id", "lang").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p1_cover, p3_found, p3_clean, p4_found, p4_ranking, p4_ranks, p5_found, p5_scores, p6_found, p6_counts, p7_ids, p8_mix, p8_shares, p8_shares_exact, p8_kept, p9_found, p9_passages)
}

# Terms: NFKC is written out for the full-width signs, spaces and ligatures that ASCII terms can hide in;
# the tests hold the operator against Python's own normalization.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")

_POSTINGS = f"""
  folded as (
    select chunk_rowid, trim(lower(nfc_normalize(translate(replace(replace(term, chr(160), ' '), chr(12288), ' '), '{_FULL}', '{_HALF}'))), ' ' || chr(9) || chr(10) || chr(13)) as term, tf
    from bm25_terms where term is not null and tf >= 1 and chunk_rowid in (select id from chunks)),
  postings as (select chunk_rowid, term, max(tf) as tf from folded where term != '' group by all),
  counts as (select term, count(*) as df, sum(tf) as cf from postings group by term)"""

_SIGNALS = {"fusion_score": 1, "rerank_score": 1, "vector_rank": -1, "bm25_rank": -1}
_VALUES = ", ".join(f"case when isnan({s}::double) then null else {s}::double end as {s}" for s in _SIGNALS)
_LAST = ", ".join(f"{s} desc nulls last" for s in ("searched_at", *_SIGNALS))


def _mean_rank(signal: str) -> str:
    ties = f"partition by query_id order by {signal} {'asc' if _SIGNALS[signal] > 0 else 'desc'} nulls first"
    return f"case when {signal} is null or n < 2 then 0.0 else round((rank() over ({ties}) - 1 + (count(*) over (partition by query_id, {signal}) - 1) / 2) / (n - 1), 9) end as r_{signal}"


_SOURCE = r"nullif(regexp_replace(lower(regexp_replace({}, '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')), '[\s\-]+', '_', 'g'), '')"

ORACLES = {
    "p1_found": f"select distinct id from chunks where len(regexp_extract_all({sql_norm('text')}, '{HAN}|{WORDS}')) > 800",
    "p1_cover": "select distinct id, sha256(text) as text_hash, true as within_limit, true as within_overlap from chunks where text is not null",
    "p4_ranks": f"""with rows as (select query_id, chunk_rowid, searched_at, {_VALUES} from search_results),
        single as (select *, row_number() over (partition by query_id, chunk_rowid order by {_LAST}) as k from rows qualify k = 1),
        sized as (select *, count(*) over (partition by query_id) as n from single)
        select query_id, chunk_rowid, {', '.join(map(_mean_rank, _SIGNALS))} from sized""",
    "p5_scores": f"""with {_POSTINGS}, lengths as (select chunk_rowid, sum(tf) as l from postings group by chunk_rowid), whole as (select sum(tf)::double as t from postings),
        parts as (select chunk_rowid, term, tf, df, cast(cf as bigint) as cf, (tf + cf)::double as a, (2 * cf - tf)::double as b, l::double as l, t from postings join counts using (term) join lengths using (chunk_rowid), whole),
        odds as (select *, case when l + t - a > 0 and 2 * t - l - b > 0 then ln(a / (l + t - a)) - ln(b / (2 * t - l - b)) else 0.0 end as o from parts)
        select chunk_rowid, term, tf::int as tf, df, cf, round(o, 5) + 0.0 as log_odds, round(o / sqrt(1 / a + 1 / b), 5) + 0.0 as z from odds""",
    "p8_kept": f"""with goals as (select {_SOURCE.format('source')} as source, max(target_share) as share, max(max_repeats) as max_repeats from mix_targets group by 1),
        docs as (select {_SOURCE.format('source')} as source, count(*) as n from documents group by 1)
        select g.source, coalesce(n, 0) as n_docs, coalesce(max_repeats, 1) as max_repeats, round(case when share > 0 then share / sum(case when share > 0 then share end) over () else 0.0 end, 9) as target_share,
          true as within_cap, true as sums_agree, true as within_one_record, true as each_once
        from goals g left join docs d on d.source = g.source where g.source is not null""",
    "p5_found": f"with {_POSTINGS} select chunk_rowid, term from postings join counts using (term) where tf >= 4 and df <= 3",
    "p6_found": f"""with {_POSTINGS}, n as (select count(distinct id) as n from chunks)
        select term, case when df <= 2 then 'rare' else 'common' end as mark from counts, n where df <= 2 or df > 0.2 * n""",
    "p6_counts": f"""with {_POSTINGS}, n as (select count(distinct id) as n from chunks)
        select term, df, cast(cf as bigint) as cf, case when df <= 2 then 'rare' when df > 0.2 * n then 'common' end as mark from counts, n""",
}
