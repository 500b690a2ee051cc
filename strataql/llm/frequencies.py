"""Frequency of every distinct value: occurrences and records, with marks for rare and common ones.

A global dictionary numbers the terms; records are encoded as (record, identifier) pairs; each task
adds its pairs into count arrays, one array for a block of identifiers; arrays of the same block
are summed. Occurrences and record presence are counted the same way over distinct pairs.

The dictionary also knows how many rows each term has. Terms of a large share of all rows are few
by that very share, and are told to all tasks; the rows of all others meet the dictionary in a
shuffle in which no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataql.session import written

#: Identifiers of one count array.
BLOCK = 4096
#: Arrays that a task holds at once; when there are more, they are sent on and begun anew.
HELD_BLOCKS = 2048

#: A term of at least this share of all rows of terms is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.0005

RARE_BELOW, COMMON_ABOVE = 5, 0.20


def clean_term(value: Column) -> Column:
    """Trimmed, in lower case; null where nothing is left."""
    bare = F.lower(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(bare) > 0, bare)


def dictionary(terms: DataFrame) -> DataFrame:
    """field_name, term, term_id, n_rows, written: dense numbers in sorted order, and the rows of each term.

    Partitions are ranges of the sorted terms; only their sizes, one number a partition, go to the
    driver, which gives each range its first number.
    """
    spark = terms.sparkSession
    distinct = terms.groupBy("field_name", "term").agg(F.count("*").alias("n_rows"))
    ranged = written(distinct.repartitionByRange("field_name", "term").withColumn("part", F.spark_partition_id()), "terms")
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    first = F.broadcast(spark.createDataFrame(starts or [(-1, 0)], "part int, first long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("field_name", "term"))
    numbered = ranged.withColumn("k", within - 1).join(first, "part").select("field_name", "term", (F.col("first") + F.col("k")).alias("term_id"), "n_rows")
    return written(numbered, "dictionary", n_rows=F.sum("n_rows"))


def _encoded(rows: DataFrame, terms: DataFrame, hot_share: float) -> DataFrame:
    """occurrence, record, term_id of every row."""
    at_least = max(1, int(hot_share * (terms.counts["n_rows"] or 0)))
    hot = terms.filter(F.col("n_rows") >= at_least).select("field_name", "term", "term_id")
    cold = terms.filter(F.col("n_rows") < at_least).select("field_name", "term", F.col("term_id").alias("cold_id"))
    first = rows.join(F.broadcast(hot), ["field_name", "term"], "left")  # at most 1 / hot_share terms
    # What has its number stays where it is; only the rest is shuffled by term.
    met = first.filter("term_id IS NULL").drop("term_id").join(cold, ["field_name", "term"]).select("occurrence", "record", F.col("cold_id").alias("term_id"))
    return first.filter("term_id IS NOT NULL").select("occurrence", "record", "term_id").unionByName(met)


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    arrays: dict[int, np.ndarray] = {}
    for pdf in batches:
        ids = pdf["term_id"].to_numpy()
        blocks = ids // BLOCK
        for b in np.unique(blocks):
            counts = np.bincount(ids[blocks == b] - b * BLOCK, minlength=BLOCK)
            arrays[b] = arrays[b] + counts if b in arrays else counts
        if len(arrays) > HELD_BLOCKS:
            yield _send(arrays)
            arrays = {}
    if arrays:
        yield _send(arrays)


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    arrays: dict[int, np.ndarray] = {}
    for pdf in batches:
        for b, counts in zip(pdf["block"], pdf["counts"]):
            counts = np.asarray(counts)
            arrays[b] = arrays[b] + counts if b in arrays else counts
    if arrays:
        yield _send(arrays)


def _send(arrays: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"block": list(arrays), "counts": [a.tolist() for a in arrays.values()]})


def count_by_id(pairs: DataFrame) -> DataFrame:
    """term_id, n over the rows of `pairs`: block arrays of each task, summed by block."""
    arrays = pairs.select("term_id").mapInPandas(_add, "block long, counts array<long>")
    summed = arrays.repartition("block").mapInPandas(_sum, "block long, counts array<long>")
    at = summed.select("block", F.posexplode("counts").alias("k", "n"))
    return at.filter("n > 0").select((F.col("block") * BLOCK + F.col("k")).alias("term_id"), "n")


def frequencies(df: DataFrame, fields: list[str], occurrence: str, record: str, hot_share: float = HOT_SHARE) -> DataFrame:
    """field_name, term, n_occurrences, n_records, n_all_records, is_rare, is_common of every term.

    `occurrence` identifies what is counted (a row delivered twice counts once), `record` the record
    it belongs to; a null occurrence id is counted as one occurrence, a null record is no record.
    Terms are trimmed and in lower case; null and empty values are no terms; a term may be rare and
    common at once. An empty table gives an empty result; further columns are ignored. A value that
    holds a third of all rows meets no single task: pairs are made distinct by pair, and arrays add
    up wherever the rows are.
    """
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), clean_term(F.col(f)).alias("term")) for f in fields])).alias("v")
    rows = df.select(F.col(occurrence).alias("occurrence"), F.col(record).alias("record"), values).select("occurrence", "record", "v.field_name", "v.term").filter("term IS NOT NULL")
    terms = dictionary(rows)
    encoded = written(_encoded(rows, terms, hot_share), "encoded")
    occurrences = count_by_id(encoded.select("occurrence", "term_id").distinct()).withColumnRenamed("n", "n_occurrences")
    present = count_by_id(encoded.filter("record IS NOT NULL").select("record", "term_id").distinct()).withColumnRenamed("n", "n_records")
    total = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("r")).distinct().agg(F.count("*").alias("n_all_records"))
    n_records = F.coalesce("n_records", F.lit(0).cast("long"))
    return (
        terms.join(occurrences, "term_id")
        .join(present, "term_id", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "field_name",
            "term",
            "n_occurrences",
            n_records.alias("n_records"),
            "n_all_records",
            (F.col("n_occurrences") < RARE_BELOW).alias("is_rare"),
            (n_records > COMMON_ABOVE * F.col("n_all_records")).alias("is_common"),
        )
    )
