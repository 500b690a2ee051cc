"""Plain relational operators over the star schema, the events and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataql.operators.relational import as_of_join, interval_join
from strataql.plans.views import LINKS_SQL, p1_hierarchy
from strataql.sources.tables import table


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count("*").alias("n_lines"))


def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by region and nation: a chain of equality joins whose small sides Catalyst broadcasts."""
    c, o, n, r = (table(spark, folder, t) for t in ("customer", "orders", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


def join_left(spark: SparkSession, folder: str) -> DataFrame:
    """Customers by their number of orders, none included."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    by = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))
    return by.groupBy("n_orders").agg(F.count("*").alias("n_customers"))


def join_full(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories with statements, with views, or with either alone."""
    s = table(spark, folder, "statements").groupBy("repo_id").agg(F.count("*").alias("n_statements"))
    v = table(spark, folder, "schema_views").groupBy("repo_id").agg(F.count("*").alias("n_views"))
    return s.join(v, "repo_id", "full").select("repo_id", F.coalesce("n_statements", F.lit(0)).alias("n_statements"), F.coalesce("n_views", F.lit(0)).alias("n_views"))


def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a returned line, by status."""
    o, l = table(spark, folder, "orders"), table(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that no large returned line has, by brand."""
    p, l = table(spark, folder, "part"), table(spark, folder, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45")
    return p.join(l, p.p_partkey == l.l_partkey, "left_anti").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


def join_range(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by the line range they begin in: an interval join by buckets."""
    ranges = spark.createDataFrame([("top", 1, 20), ("middle", 10, 120), ("rest", 120, 100000)], "part string, lo int, hi int")
    points = table(spark, folder, "statements").filter("line_no IS NOT NULL").select("stmt_id", "line_no")
    return interval_join(points, ranges, "line_no", "lo", "hi", 100).groupBy("part").agg(F.count("*").alias("n_statements"))


def join_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with the last purchase of its user before or at it."""
    e = table(spark, folder, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("value").alias("bought_value"))
    return as_of_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "bought_at", ["bought_at", "bought_value"]).select("event_id", F.date_format("bought_at", "yyyy-MM-dd HH:mm:ss").alias("bought_at"), F.round("bought_value", 4).alias("bought_value"))


def self_join(spark: SparkSession, folder: str) -> DataFrame:
    """Views and their parent views, by repository."""
    v = p1_hierarchy(spark, folder).select("repo_id", "view_name", "parent_name", "steps")
    parent = v.select("repo_id", F.col("view_name").alias("parent_name"), F.col("steps").alias("parent_steps"))
    return v.join(parent, ["repo_id", "parent_name"]).groupBy("repo_id").agg(F.count("*").alias("n_links"))


def window_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rank, dense rank, quartile and neighbours of each customer's orders by price."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("quartile"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.first("o_orderkey").over(w).alias("top"))


def window_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Running count and a moving sum over three rows of each user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("event_id", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"), F.round(F.sum("value").over(w.rowsBetween(-1, 1)), 4).alias("moving"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user's events, ended by half an hour without any."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    begins = table(spark, folder, "events").withColumn("begins", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0))
    numbered = begins.withColumn("session", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"))


def rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by status and priority with subtotals."""
    return table(spark, folder, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n_orders"))


def pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by return flag across line status."""
    return table(spark, folder, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)


def distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct counts by event type."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count("*").alias("n_events"))


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with urgent orders and with low ones: both, either alone."""
    o = table(spark, folder, "orders")
    a = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    b = o.filter("o_orderpriority = '5-LOW'").select("o_custkey")
    parts = {"both": a.intersect(b), "first_only": a.subtract(b), "either": a.union(b).distinct(), "all": a.unionAll(b)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten dearest orders; a report's top list."""
    return table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("price")).limit(10)


def top_k_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest statements of each repository: partial top lists before the shuffle."""
    st = table(spark, folder, "statements").filter("raw IS NOT NULL").select("repo_id", "stmt_id", F.length("raw").alias("n_chars"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n_chars"), "stmt_id")
    return st.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")  # pushed down as a group limit before the shuffle


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return p.select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_type", 1, 5).alias("head"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("tag"), F.length("p_name").alias("n"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"), F.sha2("p_name", 256).alias("sha"), F.translate("p_brand", "#", "-").alias("dashed"))


def date_functions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.dayofweek("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"))


def json_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the keys of their properties."""
    keys = F.explode(F.json_object_keys("props")).alias("name")
    return table(spark, folder, "events").filter("props IS NOT NULL").select("event_type", keys).groupBy("event_type", "name").agg(F.count("*").alias("n_events"))


def array_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by the size of their table lists and whether these repeat a name."""
    t = F.col("table_names")
    return table(spark, folder, "statements").filter("table_names IS NOT NULL").groupBy(F.size(t).alias("n_tables"), (F.size(F.array_distinct(t)) < F.size(t)).alias("repeats")).agg(F.count("*").alias("n_statements"))


def map_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by the keys of their metadata."""
    i = table(spark, folder, "issues").filter("metadata IS NOT NULL")
    return i.select(F.explode(F.map_keys("metadata")).alias("name")).groupBy("name").agg(F.count("*").alias("n_findings"))


def corpus_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of repositories spread over nations by key: the corpus joined with the star schema."""
    s = table(spark, folder, "schemas").select("repo_id", (F.col("repo_id") % 25).cast("int").alias("n_nationkey"))
    i = table(spark, folder, "issues")
    return i.join(s, "repo_id").join(table(spark, folder, "nation"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("n_findings"))


QUERIES = {
    f"rel_{f.__name__}": f
    for f in (
        pricing_summary, join_inner, join_left, join_full, join_semi, join_anti, join_range, join_as_of, self_join, window_ranks, window_frames, sessions, rollup, pivot, distinct,
        set_operations, top_k, top_k_by_group, text_functions, date_functions, json_functions, array_functions, map_functions, corpus_by_nation,
    )
}

SQL = {
    "rel_self_join": f"WITH {LINKS_SQL} SELECT repo_id, count(*) AS n_links FROM p GROUP BY 1",
    "rel_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 4) AS avg_discount, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "rel_join_inner": "SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "rel_join_left": "WITH b AS (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT n_orders, count(*) AS n_customers FROM b GROUP BY 1",
    "rel_join_full": "SELECT repo_id, coalesce(n_statements, 0) AS n_statements, coalesce(n_views, 0) AS n_views FROM (SELECT repo_id, count(*) AS n_statements FROM statements GROUP BY 1) FULL JOIN (SELECT repo_id, count(*) AS n_views FROM schema_views GROUP BY 1) USING (repo_id)",
    "rel_join_semi": "SELECT o_orderstatus, count(*) AS n_orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1",
    "rel_join_anti": "SELECT p_brand, count(*) AS n_parts FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1",
    "rel_join_range": "SELECT part, count(*) AS n_statements FROM statements JOIN (VALUES ('top', 1, 20), ('middle', 10, 120), ('rest', 120, 100000)) r(part, lo, hi) ON line_no >= lo AND line_no < hi GROUP BY 1",
    "rel_join_as_of": "SELECT e.event_id, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS bought_at, round(b.value, 4) AS bought_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON e.user_id = b.user_id AND e.ts >= b.ts",
    "rel_window_ranks": "SELECT o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS rk, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER w)::INT AS quartile, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "rel_window_frames": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS so_far, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS moving FROM events",
    "rel_sessions": "WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR date_trunc('second', ts) - date_trunc('second', lag(ts) OVER w) > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM b) SELECT user_id, session, count(*) AS n_events FROM s GROUP BY ALL",
    "rel_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "rel_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1",
    "rel_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n_events FROM events GROUP BY 1",
    "rel_set_operations": "WITH a AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'all', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "rel_top_k": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "rel_top_k_by_group": "SELECT repo_id, stmt_id, length(raw)::INT AS n_chars, row_number() OVER (PARTITION BY repo_id ORDER BY length(raw) DESC, stmt_id)::INT AS rank FROM statements WHERE raw IS NOT NULL QUALIFY rank <= 3",
    "rel_text_functions": "SELECT p_partkey, upper(p_name) AS up, substr(p_type, 1, 5) AS head, concat_ws('/', p_brand, p_size::VARCHAR) AS tag, length(p_name)::INT AS n, regexp_extract(p_brand, '(\\d+)', 1) AS digits, sha256(p_name) AS sha, translate(p_brand, '#', '-') AS dashed FROM part",
    "rel_date_functions": "SELECT year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, (dayofweek(o_orderdate) + 1)::INT AS d, count(*) AS n_orders FROM orders GROUP BY ALL",
    "rel_json_functions": "SELECT event_type, name, count(*) AS n_events FROM (SELECT event_type, unnest(json_keys(props)) AS name FROM events WHERE props IS NOT NULL) GROUP BY ALL",
    "rel_array_functions": "SELECT len(table_names)::INT AS n_tables, len(list_distinct(table_names)) + CASE WHEN list_contains(list_transform(table_names, lambda x: x IS NULL), TRUE) THEN 1 ELSE 0 END < len(table_names) AS repeats, count(*) AS n_statements FROM statements WHERE table_names IS NOT NULL GROUP BY ALL",
    "rel_map_functions": "SELECT name, count(*) AS n_findings FROM (SELECT unnest(map_keys(metadata)) AS name FROM issues WHERE metadata IS NOT NULL) GROUP BY 1",
    "rel_corpus_by_nation": "SELECT n_name, count(*) AS n_findings FROM issues JOIN schemas USING (repo_id) JOIN nation ON n_nationkey = schemas.repo_id % 25 GROUP BY 1",
}
