"""Joins that Spark has no single operator for: as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataql.session import written


#: Seconds of one bucket of time in as-of joins and in differences.
BUCKET_SECONDS = 86_400


def _bucket(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(at.cast("timestamp")) / seconds)


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, values: list[str], seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Each left row with the values of the last right row at or before it in its group; nulls where there is none.

    Both sides are put under each other and the last right row is carried forward in order of time,
    so no pair is ever formed. Groups are cut into buckets of time, so that a group with a third of
    all rows is sorted in many tasks; what a bucket leaves to later ones is one row a group and
    bucket. Of right rows at the same time the one with the larger values counts. Rows with a null
    time match nothing; a null in `by` is a group of its own. The left columns come first, then the
    values.
    """
    keys = [f"by_{k}" for k in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys)]
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    kind = right.select(carried.alias("v")).schema["v"].dataType
    rows = left.select(*named, F.col(at).alias("at"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(kind).alias("v"))
    marks = right.filter(F.col(right_at).isNotNull()).select(*named, F.col(right_at).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), carried.alias("v"))
    every = rows.unionByName(marks).withColumn("bucket", _bucket(F.col("at"), seconds))
    inside = Window.partitionBy(*keys, "bucket").orderBy("at", "side", "v").rowsBetween(Window.unboundedPreceding, 0)
    # One row a group and bucket: the last right row of the buckets before.
    ends = every.groupBy(*keys, "bucket").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "v")))["v"].alias("v"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("bucket").alias("e_bucket"), F.last("v", ignorenulls=True).over(before).alias("earlier"))
    same = F.col("bucket").eqNullSafe(F.col("e_bucket"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    found = every.withColumn("found", F.last("v", ignorenulls=True).over(inside)).filter("side = 1").join(earlier, same, "left")
    value = F.when(F.col("at").isNotNull(), F.coalesce("found", "earlier"))
    return found.withColumn("value", value).select("row.*", *[F.col(f"value.{v}").alias(v) for v in values])


def difference_in_order(df: DataFrame, by: list[str], at: str, ties: list[str], value: str, name: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """df with `name`: the value less the one before it in its group by time and ties; null for the first.

    Groups are cut into buckets of time as in as_of_join. Rows with a null time come first.
    """
    bucketed = df.withColumn("bucket", F.coalesce(_bucket(F.col(at), seconds), F.lit(-(2**62)).cast("long")))
    order = [F.col(at).asc_nulls_first(), *ties]
    lagged = bucketed.withColumn("inner_before", F.lag(value).over(Window.partitionBy(*by, "bucket").orderBy(*order)))
    ends = bucketed.groupBy(*by, "bucket").agg(F.max_by(value, F.struct(at, *ties)).alias("end"))
    over = Window.partitionBy(*by).orderBy("bucket")
    earlier = ends.select(*[F.col(b).alias(f"e_{b}") for b in by], F.col("bucket").alias("e_bucket"), F.lag("end").over(over).alias("outer_before"))
    same = F.col("bucket") == F.col("e_bucket")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"e_{b}"))
    return lagged.join(earlier, same).withColumn(name, F.col(value) - F.coalesce("inner_before", "outer_before")).select(*df.columns, name)


def interval_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points with every range that holds them (start <= point < end), by buckets of `width`.

    Each range is put into the buckets it touches and each point into its own, so the join is one of
    equal keys; the exact condition follows. Rows with nulls match nothing.
    """
    b = ranges.filter(F.col(start) < F.col(end)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    p = points.withColumn("bucket", F.floor(F.col(point) / width))
    return p.join(b, "bucket").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("bucket")


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """df with a dense number from 1 in the given order, written; ties in any order.

    Partitions are ranges of the order; only their sizes, one number a partition, go to the driver,
    which gives each range its first number. An empty table gives an empty result.
    """
    part = f"{number}_part"
    ranged = written(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    at, first = 0, []
    for row in sorted(ranged.groupBy(part).agg(F.count("*").alias("n")).collect()):
        first.append((row[part], at))
        at += row["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(first or [(-1, 0)], f"{part} int, {number}_first long"))
    within = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranged.withColumn(number, within).join(starts, part).withColumn(number, F.col(number) + F.col(f"{number}_first")).select(*df.columns, number)
