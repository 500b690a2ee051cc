"""Copies hidden by formatting: one class for each canonical form, counted in radix buckets.

Each task first collapses its own rows in a trie with terminal counters, so that a form that makes
up a third of the table goes on as one row a task. What is left is partitioned recursively by its
canonical bytes: a prefix whose bucket holds more than `bucket_rows` rows is split by further bytes
(its length doubles) until every bucket fits or its texts end. Oversized prefixes are a table that
the forms meet in a join; at each level only the forms below such a prefix go on. Each bucket is
counted in a trie of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataql.llm.canonical import canonical
from strataql.session import release, written

#: Rows of one bucket, and rows that a task collapses before it sends them on.
BUCKET_ROWS = 200_000
#: Classes that a task gathers before it sends them on.
SENT = 10_000
#: Bytes of the first radix prefix.
FIRST = 32
#: Bytes of one trie edge.
STRIDE = 32
#: A class of at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


class Trie:
    """Byte strings with terminal counters: (smallest id, number of copies) at each string's end."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: bytes, least: int, n: int = 1) -> None:
        node = self.root
        for i in range(0, len(text), STRIDE):
            edge = text[i : i + STRIDE]
            node = node.get(edge) or node.setdefault(edge, {})
        end = node.get(None)
        node[None] = (least, n) if end is None else (min(least, end[0]), end[1] + n)

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        open_nodes = [(b"", self.root)]
        while open_nodes:
            text, node = open_nodes.pop()
            for edge, below in node.items():
                if edge is None:
                    yield text, *below
                else:
                    open_nodes.append((text + edge, below))


def _digest(form: bytes) -> bytes:
    return hashlib.blake2b(form, digest_size=16).digest()


def _to_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        forms = [canonical(t).encode("utf-8", "surrogatepass") for t in pdf["text"]]
        out = pd.DataFrame({"id": pdf["id"].to_numpy(), "form": forms})
        out["digest"] = [_digest(f) for f in forms]
        yield out[out["form"] != b""]


def _collapse(rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, held = Trie(), 0
        for pdf in batches:
            for i, form in zip(pdf["id"], pdf["form"]):
                trie.add(form, i)
            held += len(pdf)
            if held >= rows:
                yield pd.DataFrame(list(trie.items()), columns=["form", "least", "n"])
                trie, held = Trie(), 0
        yield pd.DataFrame(list(trie.items()), columns=["form", "least", "n"])

    return run


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets, which come one after the other, each counted in a trie; the classes of many go on together."""
    trie, now, ready = Trie(), None, []
    for pdf in batches:
        for bucket, form, least, n in zip(pdf["bucket"], pdf["form"], pdf["least"], pdf["n"]):
            if bucket != now:
                ready += trie.items()
                trie, now = Trie(), bucket
                if len(ready) >= SENT:
                    yield _classes(ready)
                    ready = []
            trie.add(form, least, n)
    ready += trie.items()
    yield _classes(ready)


def _classes(found: list[tuple[bytes, int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(_digest(t), least, n, t) for t, least, n in found], columns=["digest", "keep_id", "n_copies", "form"])


def _bucketed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """rows (form, ...) with `bucket`, the shortest radix prefix whose rows fit one bucket, or the whole form."""
    done, length = None, FIRST
    while True:
        prefix = F.substring("form", 1, length)
        sizes = rows.groupBy(prefix.alias("bucket")).agg(F.count("*").alias("rows"), F.max(F.length("form")).alias("longest"))
        # The texts of an oversized bucket that end within its prefix are one and the same.
        large = written(sizes.filter((F.col("rows") > bucket_rows) & (F.col("longest") > length)).select("bucket"), "large", n=F.count("*"))
        named = rows.withColumn("bucket", prefix)
        if not large.counts["n"]:
            release(large)
            return named if done is None else done.unionByName(named)
        # At most rows / bucket_rows prefixes; Spark broadcasts them only while they are small.
        fits = named.join(large, "bucket", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rows = written(named.join(large, "bucket", "left_semi").drop("bucket"), "split")
        length *= 2


def copy_classes(df: DataFrame, id_col: str, text_col: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(classes, members): classes of copies of `text_col` and the class of every row.

    classes: digest, keep_id (smallest id), n_copies, form (UTF-8); one row for every canonical form.
    members: id, digest, written; one row for every row whose text isn't null and whose form isn't
    empty. Null, empty and blank texts (and lone semicolons) are in no class; rows repeated with the
    same id count as copies; texts of any length are taken whole; an empty table gives two empty
    results; further columns are ignored.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    forms = written(texts.mapInPandas(_to_forms, "id long, form binary, digest binary"), "forms", n=F.count("*"))
    collapsed = written(forms.select("id", "form").mapInPandas(_collapse(bucket_rows), "form binary, least long, n long"), "collapsed")
    buckets = _bucketed(collapsed, bucket_rows)
    classes = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_count, "digest binary, keep_id long, n_copies long, form binary")
    members = forms.select("id", "digest")
    members.counts = forms.counts
    return classes, members


def copy_members(df: DataFrame, id_col: str, text_col: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """keep_id, dup_id: one row for every member of a class of copies but the one kept.

    Hot classes are told to all tasks; their number is bounded by 1 / HOT_SHARE. The rows of all
    other classes meet them in a shuffle in which no key is hot.
    """
    classes, members = copy_classes(df, id_col, text_col, bucket_rows)
    several = written(classes.filter("n_copies > 1").select("digest", "keep_id", "n_copies"), "classes")
    at_least = max(2, int(HOT_SHARE * members.counts["n"]))
    hot = F.broadcast(several.filter(F.col("n_copies") >= at_least).select("digest", "keep_id"))
    cold = several.filter(F.col("n_copies") < at_least).select("digest", "keep_id")
    found = members.join(hot, "digest").unionByName(members.join(hot, "digest", "left_anti").join(cold, "digest"))
    return found.filter("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))
