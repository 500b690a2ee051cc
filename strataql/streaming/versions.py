"""Streams of document versions: the latest text wins, findings follow it, scores are compared.

The stream's rows are versions of documents (uri, version, content, ts) as an editor or a watched
folder sends them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from strataql.operators.filters import query_key
from strataql.operators.findings import pattern_findings, prepare
from strataql.operators.reporting import structural_score
from strataql.operators.splitting import split_sources
from strataql.rules.spec import Rule

VERSION = "uri string, version long, content string, ts timestamp"


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each document in a batch; ties go to the later time, then the larger text."""
    return versions.groupBy("uri").agg(F.max_by(F.struct("version", "content", "ts"), F.struct("version", "ts", "content")).alias("v")).select("uri", "v.*")


def diagnostics(versions: DataFrame, rules: list[Rule], dialect: str | None = None) -> DataFrame:
    """uri, query_index, line_no, rule_id, ordinal, snippet over the newest versions of a batch."""
    stmts = split_sources(latest(versions), "uri", "content").withColumn("dialect", F.lit(dialect).cast("string"))
    return pattern_findings(prepare(stmts), rules, ["file", "query_index", "line_no"]).withColumnRenamed("file", "uri")


def watch(spark: SparkSession, path: str) -> DataFrame:
    """Whole SQL files of a folder as a stream of versions; each file is one version of itself."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.sql").option("recursiveFileLookup", "true").load(path)
    return lines.select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("uri"), F.unix_millis("_metadata.file_modification_time").alias("version"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("ts"))


def publish(versions: DataFrame, rules: list[Rule], sink: Callable[[DataFrame, int], None], checkpoint: str, dialect: str | None = None) -> StreamingQuery:
    """Each micro-batch's findings to a sink that is called with them and the batch number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(diagnostics(batch, rules, dialect), number)

    return versions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def new_statements(statements: DataFrame, delay: str = "1 day") -> DataFrame:
    """Statements of a stream (raw, ts) whose text hasn't come within the delay: a result cache as deduplication.

    The watermark bounds the state; rows that come later than the delay are dropped.
    """
    return statements.withColumn("content_sha", F.sha2("raw", 256)).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["content_sha"])


def findings_per_window(findings: DataFrame, window: str = "1 hour", delay: str = "1 day", slide: str | None = None) -> DataFrame:
    """Findings of a stream (rule_id, ts) by rule in windows of time, tumbling or sliding; late rows up to the delay count."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    return findings.withWatermark("ts", delay).groupBy(at, "rule_id").agg(F.count("*").alias("n_findings")).select(F.col("window.start").alias("window_start"), "rule_id", "n_findings")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Events of a stream (key, ts) in sessions that a gap ends."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("n_events")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "key", "n_events")


def _differences(query: str, rows: Iterator[pd.DataFrame], last: int | None) -> tuple[pd.DataFrame, int | None]:
    """Scores in order of time, each with its change against the one before, and the last of them."""
    pdf = pd.concat(list(rows)).sort_values(["ts", "score"])
    changes = []
    for score in pdf["score"]:
        changes.append(None if last is None else int(score) - last)
        last = int(score)
    return pd.DataFrame({"query_sha": query, "ts": pdf["ts"].to_numpy(), "score": pdf["score"].to_numpy(), "trend": pd.array(changes, dtype="Int32")}), last


class Trend(StatefulProcessor):
    """Keeps the last score of a statement; gives each score less the one before, null for the first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("score", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        out, last = _differences(key[0], rows, known[0] if known is not None else None)
        self.last.update((last,))
        yield out

    def close(self) -> None:
        pass


TREND = "query_sha string, ts timestamp, score int, trend int"


def trends(statements: DataFrame) -> DataFrame:
    """Scores of a stream of statements (raw, ts) with their change since the same text came last."""
    scored = statements.filter("raw IS NOT NULL").select(F.sha2(query_key(F.col("raw")), 256).alias("query_sha"), "ts", structural_score(F.col("raw")).cast("int").alias("score"))
    return scored.groupBy("query_sha").transformWithStateInPandas(Trend(), TREND, "Append", "None")


def _trend_rows(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    out, last = _differences(key[0], rows, state.get[0] if state.exists else None)
    state.update((last,))
    yield out


def trends_without_rocksdb(statements: DataFrame) -> DataFrame:
    """The same with group state, which any state store provider holds."""
    scored = statements.filter("raw IS NOT NULL").select(F.sha2(query_key(F.col("raw")), 256).alias("query_sha"), "ts", structural_score(F.col("raw")).cast("int").alias("score"))
    return scored.groupBy("query_sha").applyInPandasWithState(_trend_rows, TREND, "score int", "append", "NoTimeout")
