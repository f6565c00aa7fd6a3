"""Mixing sources to target shares of the total size.

The plan is made from the size of each source by capped water-filling: a source that
would have to be repeated more often than it may is held at its cap, and what it cannot
give is spread over the others in proportion to their weights, until no source exceeds
its cap. The draw is seeded: every record gets the whole repetitions, and the fraction
goes to the records in those bins of a seeded hash whose tokens, not just rows, add up to what is wanted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumdex.llm import tokenizer

#: Bins of the seeded hash per source; a source's share is exact to a part of one bin's tokens.
HASH_BINS = 4096

PLAN_SCHEMA = "source string, target_share double, planned_share double, n_docs bigint, source_tokens bigint, max_repeats int, epochs double, whole int, taken string"


def clean_source(col: Column | str) -> Column:
    """A source's name without outer blanks, in lower case, with ``_`` for blanks and dashes."""
    col = F.col(col) if isinstance(col, str) else col
    name = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(name != "", name)


def water_fill(sizes: dict[str, int], weights: dict[str, float | None], caps: dict[str, int | None], total: float | None = None) -> dict[str, float]:
    """Size to take of each source.

    ``total`` defaults to the size of all sources that have a positive weight. Null, NaN
    and negative weights count as 0, null caps as 1; weights need not add up to anything.
    If all sources together cannot give ``total`` within their caps, each gives its cap.
    """
    weight = {s: w for s, w in weights.items() if w is not None and math.isfinite(w) and w > 0 and sizes.get(s, 0) > 0}
    room = {s: float(sizes[s] * max(0, 1 if caps.get(s) is None else caps[s])) for s in weight}
    left = float(sum(sizes[s] for s in weight) if total is None else total)
    taken: dict[str, float] = {}
    free = dict(weight)
    while free:
        level = left / sum(free.values())
        full = [s for s in free if free[s] * level >= room[s]]
        if not full:
            return taken | {s: w * level for s, w in free.items()}
        for s in full:
            taken[s] = room[s]
            left -= room[s]
            del free[s]
        left = max(left, 0.0)
    return taken


def exact_total(sizes: dict[str, int], weights: dict[str, float | None], caps: dict[str, int | None]) -> float:
    """The largest total at which every source with records reaches its share within its cap."""
    good = {s: w for s, w in weights.items() if w is not None and math.isfinite(w) and w > 0 and sizes.get(s, 0) > 0}
    whole = sum(good.values())
    return min((sizes[s] * (1 if caps.get(s) is None else caps[s]) * whole / w for s, w in good.items()), default=0.0)


def _sized(documents: DataFrame, text: str, key: str, source: str, seed: int, lexicon_file: str | None) -> DataFrame:
    """``key, source, n_tokens, bin`` of each record that has a source."""
    from vellumdex.session import materialize

    counted = tokenizer.token_counts(documents, [key, source], text, lexicon_file=lexicon_file)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(HASH_BINS)).cast("int")
    named = counted.select(F.col(key).alias("doc_id"), clean_source(source).alias("source"), "n_tokens", place.alias("bin"))
    return materialize(named.where("source is not null"))


def _taken(bins: list[int], rest: float) -> str:
    """Which hash bins to take so that their tokens come close to ``rest``: a ``1`` for each that is, else a ``0``.

    In order, a bin is taken if it still fits; one that does not (it may hold a very long
    record) is left out, and all later ones are tried. What is missing at the end is less than any bin that
    was left out; the single bin that mends most of it, by coming in or by going out, is changed.
    """
    run, taken = 0, [False] * len(bins)
    if rest < 0.5:
        return "0" * len(bins)
    for i, tokens in enumerate(bins):
        if tokens and run + tokens <= rest:
            run, taken[i] = run + tokens, True
    best = min((i for i, tokens in enumerate(bins) if tokens), key=lambda i: abs(run + (-bins[i] if taken[i] else bins[i]) - rest), default=None)
    if best is not None and abs(run + (-bins[best] if taken[best] else bins[best]) - rest) < abs(run - rest):
        taken[best] = not taken[best]
    return "".join("1" if t else "0" for t in taken)


def plan_mixture(sized: DataFrame, targets: DataFrame, total: float | str | None = None) -> DataFrame:
    """One row per row of ``targets``: what to take of the source.

    ``sized`` has ``source, n_tokens, bin``. What reaches the driver are the targets and,
    for each of them, at most ``HASH_BINS`` sums. ``total`` is a number of tokens, None for
    the size of all targeted sources, or ``"exact"`` for the largest total at which all
    shares are met.
    """
    spark = sized.sparkSession
    wanted = targets.select(clean_source("source").alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = {r["source"]: r for r in wanted.collect()}
    bins = sized.where(F.col("source").isin(list(goals))).groupBy("source", "bin").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect() if goals else []
    sums: dict[str, list[int]] = {s: [0] * HASH_BINS for s in goals}
    docs = dict.fromkeys(goals, 0)
    for r in bins:
        sums[r["source"]][r["bin"]] += r["tokens"]
        docs[r["source"]] += r["docs"]
    sizes = {s: sum(b) for s, b in sums.items()}
    weights = {s: r["target_share"] for s, r in goals.items()}
    caps = {s: r["max_repeats"] for s, r in goals.items()}
    if total == "exact":
        total = exact_total(sizes, weights, caps)
    take = water_fill(sizes, weights, caps, total)
    good = {s: w for s, w in weights.items() if w is not None and math.isfinite(w) and w > 0}
    rows = []
    for s in sorted(goals):
        epochs = take.get(s, 0.0) / sizes[s] if sizes[s] else 0.0
        whole = int(math.floor(epochs + 1e-9))
        taken = _taken(sums[s], max(0.0, (epochs - whole) * sizes[s]))
        rows.append((s, good[s] / sum(good.values()) if s in good else 0.0, take.get(s, 0.0) / (sum(take.values()) or 1.0), docs[s], sizes[s], 1 if caps[s] is None else caps[s], epochs, whole, taken))
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def draw(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens, repeats``: the records of the mix, each once, with how often it is taken.

    The plan has one row per target, so that it is broadcast whatever the corpus size.
    """
    small = F.broadcast(plan.select("source", "whole", "taken"))
    repeats = F.col("whole") + F.substring(F.col("taken"), F.col("bin") + 1, F.lit(1)).cast("int")
    return sized.join(small, "source").select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def mix_sources(documents: DataFrame, targets: DataFrame, total: float | str | None = None, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source", lexicon_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (see ``draw``) and its report.

    Records without a source, or of one that ``targets`` does not name, are left out of the
    mix, since they have no share. A null or empty text has 0 tokens. Sources without
    records keep a report row with share 0; a target named twice counts with its greatest
    share. Equal seeds give equal mixes.
    """
    sized = _sized(documents, text, key, source, seed, lexicon_file)
    plan = plan_mixture(sized, targets, total)
    mix = draw(sized, plan)
    return mix, report(mix, plan)


def report(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: its target, planned and reached share, and what was taken."""
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.sum(F.col("repeats").cast("bigint")).alias("copies"), F.max("repeats").alias("most_repeats"))
    joined = plan.join(got, "source", "left")
    share = F.coalesce("tokens", F.lit(0)) / F.nullif(F.sum("tokens").over(Window.partitionBy()), F.lit(0))  # one row per target
    return joined.select(
        "source", "target_share", "planned_share", F.coalesce(share, F.lit(0.0)).alias("reached_share"), "n_docs", "source_tokens",
        F.coalesce("tokens", F.lit(0)).cast(T.LongType()).alias("tokens"), F.coalesce("copies", F.lit(0)).cast(T.LongType()).alias("copies"),
        F.coalesce("most_repeats", F.lit(0)).cast("int").alias("most_repeats"), "max_repeats", "epochs",
    )
