"""Problem 1: the hierarchy of views within each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataql.functions.names import bare_name
from strataql.operators.hierarchy import hierarchy
from strataql.sources.tables import table


def _views(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "schema_views").filter("name IS NOT NULL")
    return rows.select("repo_id", bare_name(F.col("name")).alias("node"), F.transform("dependencies", bare_name).alias("parents"))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every view with its path, depth, topmost view and all views below it."""
    found = hierarchy(_views(spark, folder), "repo_id", "node", "parents")
    return found.select(
        F.col("scope").alias("repo_id"),
        F.col("node").alias("view_name"),
        F.col("parent").alias("parent_name"),
        F.col("root").alias("root_name"),
        F.col("depth").alias("steps"),
        F.concat_ws("/", "path").alias("path"),
        "subtree_size",
        F.concat_ws(",", "descendants").alias("below"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """repo_id, view_name, root_name and steps of every view: the same peeling, without its lists."""
    found = hierarchy(_views(spark, folder), "repo_id", "node", "parents", lists=False)
    return found.select(F.col("scope").alias("repo_id"), F.col("node").alias("view_name"), F.col("root").alias("root_name"), F.col("depth").alias("steps"))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy}

_BARE = r"""lower(trim(regexp_replace(regexp_extract(trim({0}, e' \t\r\n'), '("[^"]*"|`[^`]*`|\[[^\]]*\]|[^."`\[\]]+)\s*$', 1), '^["`\[]|["`\]]$', '', 'g'), e' \t\r\n'))"""

#: Views, their names, and each one's parent.
LINKS_SQL = f"""v AS (
  SELECT repo_id, {_BARE.format('name')} AS node, dependencies FROM schema_views WHERE name IS NOT NULL),
n AS (SELECT DISTINCT repo_id, node FROM v WHERE node <> ''),
d AS (SELECT DISTINCT repo_id, node, {_BARE.format('dep')} AS parent FROM (SELECT repo_id, node, unnest(dependencies) AS dep FROM v) WHERE dep IS NOT NULL),
p AS (SELECT d.repo_id, d.node, min(d.parent) AS parent FROM d JOIN n ON n.repo_id = d.repo_id AND n.node = d.parent GROUP BY 1, 2)"""
#: From each view upwards, to the top or until a view comes again.
_WALK = f"""WITH RECURSIVE {LINKS_SQL},
w AS (
  SELECT n.repo_id, n.node AS start, n.node AS cur, 0 AS steps, [n.node] AS path, FALSE AS looped FROM n
  UNION ALL
  SELECT w.repo_id, w.start, p.parent, w.steps + 1, list_append(w.path, p.parent), list_contains(w.path, p.parent)
  FROM w JOIN p ON p.repo_id = w.repo_id AND p.node = w.cur WHERE NOT w.looped),
last AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY repo_id, start ORDER BY steps DESC) = 1)"""
_ROOT = "CASE WHEN looped THEN list_min(path[list_position(path, cur):]) ELSE cur END"
_STEPS = "CASE WHEN NOT looped THEN steps WHEN cur = start THEN -1 ELSE -2 END"

SQL = {
    "p1_found": f"{_WALK} SELECT repo_id, start AS view_name, {_ROOT} AS root_name, {_STEPS} AS steps FROM last",
    # A cycle's path goes from its first view along the parents; what hangs below follows in turn.
    "p1_hierarchy": f"""{_WALK},
cut AS (
  SELECT repo_id, start, looped, path, list_position(path, cur) AS met, {_ROOT} AS root, {_STEPS} AS steps, path[list_position(path, cur):len(path) - 1] AS ring FROM last),
turned AS (
  SELECT *, CASE WHEN NOT looped THEN list_reverse(path)
    ELSE list_concat(list_concat(ring[list_position(ring, root):], ring[1:list_position(ring, root) - 1]), list_reverse(path[1:met - 1])) END AS names FROM cut),
below AS (
  SELECT repo_id, above, count(*) AS n, string_agg(start, ',' ORDER BY start) AS below FROM (SELECT repo_id, start, unnest(names) AS above FROM turned) WHERE above <> start GROUP BY 1, 2)
SELECT t.repo_id, t.start AS view_name, p.parent AS parent_name, root AS root_name, steps, array_to_string(names, '/') AS path, coalesce(n, 0) + 1 AS subtree_size, coalesce(below, '') AS below
FROM turned t LEFT JOIN p ON p.repo_id = t.repo_id AND p.node = t.start LEFT JOIN below b ON b.repo_id = t.repo_id AND b.above = t.start""",
}
