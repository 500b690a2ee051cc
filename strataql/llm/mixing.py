"""Mixing sources to target weights by capped water-filling.

Every source gets its share of the total; a source whose documents, repeated as often as allowed,
hold less is clamped there and its excess weight goes to the others in proportion to their shares,
until all fit. A source's allotment is its documents some whole number of times plus a seeded
sample of them for the fraction: documents fall into hash buckets, and the sample is the buckets up
to the one at which the fraction is met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a source for the fractional sample.
BUCKETS = 8192


@dataclass(frozen=True)
class Share:
    """One source's place in the mix."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    allotted: float


def water_fill(sources: list[tuple[str, float, int, int]], total: float) -> list[Share]:
    """Allot `total` to (source, target_share, max_repeats, available) by share, capped at max_repeats x available.

    Null or negative shares and repeats count as 0. When all sources are clamped the allotments stay
    below the total.
    """
    left = {s: max(0.0, w or 0.0) for s, w, _, _ in sources}
    cap = {s: max(0, r or 0) * max(0, a or 0) for s, _, r, a in sources}
    allotted = dict.fromkeys(left, 0.0)
    rest, active = float(total), {s for s in left if left[s] > 0 and cap[s] > 0}
    while active and rest > 0:
        # Sums go over sorted lists, so that the last bit doesn't depend on the order of a set.
        weight = sum(left[s] for s in sorted(active))
        full = {s for s in active if rest * left[s] / weight >= cap[s]}
        if not full:
            for s in active:
                allotted[s] = rest * left[s] / weight
            break
        for s in full:
            allotted[s] = float(cap[s])
        rest -= sum(cap[s] for s in sorted(full))
        active -= full
    return [Share(s, w or 0.0, r or 0, a or 0, allotted[s]) for s, w, r, a in sources]


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixed, shares) of documents `sized` (id, source, n_tokens) by `targets` (source, target_share, max_repeats).

    mixed: id, source, n_tokens, copies; one row for every document that is in the mix, copies times.
    shares: source, target_share, max_repeats, available_tokens, epochs, mixed_tokens, actual_share;
    one row for every target. total: tokens wanted; by default those available in the listed sources.

    Targets are a parameter table of one row a source (the last of repeated ones counts). Documents
    of unlisted or null sources stay out; a source without documents hands its share on; documents
    of 0 tokens go with the whole repetitions and the sample like any other; empty tables give no
    mixed documents; further columns are ignored. The same seed gives the same mix.
    """
    spark = sized.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.select("source", "target_share", "max_repeats").filter("source IS NOT NULL").collect()}
    docs = sized.select("id", "source", "n_tokens")
    here = docs.filter(F.col("source").isin(list(wanted)))
    had = {r["source"]: r["n"] for r in here.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = [(s, w, r, had.get(s, 0)) for s, (w, r) in sorted(wanted.items())]
    shares = water_fill(rows, total if total is not None else sum(had.values()))
    plan = [(s.source, int(s.allotted // s.available) if s.available else 0, (s.allotted % s.available) if s.available else 0.0) for s in shares]
    plans = spark.createDataFrame(plan, "source string, whole int, part double") if plan else spark.createDataFrame([], "source string, whole int, part double")
    bucketed = here.join(F.broadcast(plans), "source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(BUCKETS)).cast("int"))
    # At most BUCKETS rows a source.
    sums = bucketed.groupBy("source", "bucket", "part").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    taken = sums.withColumn("upto", upto).filter(F.col("upto") - F.col("n") / 2 <= F.col("part")).filter("part > 0").groupBy("source").agg(F.max("bucket").alias("last"))
    copies = F.col("whole") + F.when(F.col("bucket") <= F.coalesce("last", F.lit(-1)), 1).otherwise(0)
    mixed = bucketed.join(F.broadcast(taken), "source", "left").select("id", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    listed = spark.createDataFrame([(s.source, s.target_share, s.max_repeats, s.available) for s in shares], "source string, target_share double, max_repeats int, available_tokens long")
    all_tokens = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a target
    report = (
        listed.join(reached, "source", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("long")))
        .withColumn("epochs", F.when(F.col("available_tokens") > 0, F.round(F.col("mixed_tokens") / F.col("available_tokens"), 6)).otherwise(0.0))
        .withColumn("actual_share", F.when(all_tokens > 0, F.round(F.col("mixed_tokens") / all_tokens, 6)).otherwise(0.0))
        .select("source", "target_share", "max_repeats", "available_tokens", "epochs", "mixed_tokens", "actual_share")
    )
    return mixed, report
