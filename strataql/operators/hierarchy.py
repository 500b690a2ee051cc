"""Parent-child links to full hierarchies by bottom-up leaf peeling.

A node knows at most one parent. A round peels all leaves, whose parents lose a child each, or
takes out all chains (runs of nodes with one child left) by doubling their links, whichever are
more, so that a quarter of what is left goes in every round, however deep the forest. Walking the rounds backwards gives every
node its root and depth (and path), because what a node hung below goes after it. Nodes that are
never peeled lie on a cycle; what hangs below a cycle is peeled, but its topmost ancestor is one of
those residual nodes.

All steps are aggregations by parent and joins by (scope, node) over the nodes of that round; no
task holds a whole scope, and the driver loops over rounds, never over rows. Every round's rows are
written to the shared folder. With lists, a node's path is carried down and turned round into the
descendant lists of the nodes on it; lists are result rows, so their size is the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataql.session import release, written

#: Marks in `depth`, besides the number of links to the root.
ON_CYCLE, BELOW_CYCLE = -1, -2
#: Doublings of chain links between two writes.
DOUBLINGS = 2

_KEY = ["scope", "node"]


def _schema(scope_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("scope", scope_type),
            T.StructField("node", T.StringType()),
            T.StructField("parent", T.StringType()),
            T.StructField("root", T.StringType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("path", T.ArrayType(T.StringType())),
            T.StructField("subtree_size", T.LongType()),
            T.StructField("descendants", T.ArrayType(T.StringType())),
        ]
    )


def _no_names() -> Column:
    return F.lit(None).cast("array<string>")


def _between(upper: Column, node: Column, lower: Column) -> Column:
    """The names along two links that meet at a node, from the top down; null where no lists are wanted."""
    return F.concat(upper, F.array(node), lower)


def _count(condition) -> Column:
    return F.count_if(condition)


def _doubled(jumps: DataFrame) -> DataFrame:
    """Chain links, each made as long as itself and the one it leads to; a link that leads out of the chain is closed."""
    on = jumps.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("via").alias("via2"), F.col("top").alias("top2"), F.col("open").alias("open2"))
    going = jumps.filter("open").join(on, ["scope", "up"], "left")
    met = F.col("up2").isNotNull()
    return jumps.filter("NOT open").unionByName(
        going.select(
            *_KEY,
            F.coalesce("up2", "up").alias("up"),
            (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
            F.when(met, F.least("low", "up", "low2")).otherwise(F.col("low")).alias("low"),
            F.when(met, _between(F.col("via2"), F.col("up"), F.col("via"))).otherwise(F.col("via")).alias("via"),
            F.coalesce("top2", "top").alias("top"),
            F.coalesce("open2", F.lit(False)).alias("open"),
        )
    )


def _chains(nodes: DataFrame, n: int) -> DataFrame:
    """For each chain node its link past the chain: up, far (links), low (first name between), via, top; still open: on a cycle."""
    jumps = nodes.select(*_KEY, F.col("parent").alias("up"), F.col("hops").alias("far"), "low", "via", F.col("node").alias("top"), F.lit(True).alias("open"))
    still = n
    while True:
        last = jumps
        for _ in range(DOUBLINGS):
            jumps = _doubled(jumps)
        jumps = written(jumps, "chains", n=_count("open"))
        release(last)
        # As long as a chain has an end, some of its links close at every step; what stays open then is cycles.
        if jumps.counts["n"] in (0, still):
            return jumps
        still = jumps.counts["n"]


def _rings(open_jumps: DataFrame) -> DataFrame:
    """Residual nodes with the first name of their cycle as root, and the cycle from there, along the parents, as path."""
    along = F.when(F.col("via").isNotNull(), F.concat(F.array("node"), F.reverse("via")))
    ring = open_jumps.select(*_KEY, "up", F.least("node", "low").alias("root"), F.array_distinct(along).alias("path"))
    while True:
        onward = ring.select("scope", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("path").alias("path2"))
        met = ring.join(onward, ["scope", "up"])
        grown = met.select(*_KEY, F.col("up2").alias("up"), F.least("root", "root2").alias("root"), F.array_distinct(F.concat("path", "path2")).alias("path"), (F.col("root2") < F.col("root")).alias("fell"))
        now = written(grown, "rings", fell=_count("fell"))
        release(ring)
        ring = now
        # When no node learns of a smaller name, all have seen their whole cycle.
        if not now.counts["fell"]:
            break
    at = F.array_position("path", F.col("root")).cast("int")
    turned = F.concat(F.slice("path", at, F.size("path")), F.slice("path", F.lit(1), at - 1))
    return ring.select(*_KEY, "root", F.lit(ON_CYCLE).alias("depth"), F.when(F.col("path").isNotNull(), turned).alias("path"))


def _placed(records: DataFrame, known: DataFrame) -> DataFrame:
    """Root, depth and path of peeled nodes from those of the nodes they hung below."""
    above = known.select("scope", F.col("node").alias("parent"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("path").alias("p"))
    below = F.when(F.col("d") >= 0, F.col("d") + F.col("hops")).otherwise(BELOW_CYCLE)
    path = F.when(F.col("via").isNotNull(), F.coalesce(F.concat("p", "via", F.array("node")), F.array("node")))
    return records.join(above, ["scope", "parent"], "left").select(*_KEY, F.coalesce("r", "node").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(below).alias("depth"), path.alias("path"), *[c for c in records.columns if c == "top"])


def _place_chains(records: DataFrame, bottoms: DataFrame, known: DataFrame) -> DataFrame:
    """The same for chains; a chain whose lower end is on a cycle is on it itself."""
    looped = known.filter(F.col("depth") == ON_CYCLE).select("scope", F.col("node").alias("bottom"), F.col("root").alias("ring"), F.col("path").alias("ring_path"))
    tops = bottoms.join(looped, ["scope", "bottom"]).select("scope", "top", "ring", "ring_path")
    on = F.col("ring").isNotNull()
    return (
        _placed(records, known)
        .join(tops, ["scope", "top"], "left")
        .select(*_KEY, F.coalesce("ring", "root").alias("root"), F.when(on, ON_CYCLE).otherwise(F.col("depth")).alias("depth"), F.when(on, F.col("ring_path")).otherwise(F.col("path")).alias("path"))
    )


def peel(nodes: DataFrame, lists: bool) -> DataFrame:
    """scope, node, root, depth, path (null without lists) of nodes (scope, node, parent); scope and node are not null.

    A parent that is no node, or null, ends a tree.
    """
    children = nodes.filter("parent IS NOT NULL").groupBy("scope", F.col("parent").alias("node")).agg(F.count("*").alias("pending"))
    via = F.array().cast("array<string>") if lists else _no_names()
    first = nodes.join(children, _KEY, "left").select(*_KEY, "parent", F.lit(1).alias("hops"), F.lit(None).cast("string").alias("low"), via.alias("via"), F.coalesce("pending", F.lit(0)).alias("pending"))
    is_chain = (F.col("pending") == 1) & F.col("parent").isNotNull()
    tell = {"n": F.count("*"), "leaves": _count(F.col("pending") == 0), "chains": _count(is_chain)}
    live = written(first, "live", **tell)
    undo = []  # what places a round's nodes, given those that went later
    known = None
    while live.counts["n"]:
        # Leaves and chain nodes are at least half of what is left; the larger part of them goes.
        if live.counts["leaves"] >= live.counts["chains"]:
            leaves = live.filter("pending = 0")
            undo.append((_placed, leaves))
            gone = leaves.filter("parent IS NOT NULL").groupBy("scope", F.col("parent").alias("node")).agg(F.count("*").alias("gone"))
            rest = live.filter("pending > 0").join(gone, _KEY, "left").withColumn("pending", F.col("pending") - F.coalesce("gone", F.lit(0))).drop("gone")
            live = written(rest, "live", **tell)
            continue
        jumps = _chains(live.filter(is_chain), live.counts["chains"])
        closed = jumps.filter("NOT open")
        if jumps.counts["n"]:
            ring = _rings(jumps.filter("open"))
            known = ring if known is None else known.unionByName(ring)
        past = closed.select("scope", F.col("node").alias("parent"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("low").alias("low2"), F.col("via").alias("via2"), F.col("top").alias("top2"))
        linked = live.filter(~is_chain).join(past, ["scope", "parent"], "left")
        met = F.col("up2").isNotNull()
        rest = written(
            linked.select(
                *_KEY,
                F.coalesce("up2", "parent").alias("parent"),
                (F.col("hops") + F.coalesce("far2", F.lit(0))).alias("hops"),
                F.when(met, F.least("low", "parent", "low2")).otherwise(F.col("low")).alias("low"),
                F.when(met, _between(F.col("via2"), F.col("parent"), F.col("via"))).otherwise(F.col("via")).alias("via"),
                "pending",
                "top2",
            ),
            "live",
            **tell,
        )
        bottoms = rest.filter("top2 IS NOT NULL").select("scope", F.col("top2").alias("top"), F.col("node").alias("bottom"))
        records = closed.select(*_KEY, F.col("up").alias("parent"), F.col("far").alias("hops"), "via", "top")
        undo.append((lambda c, k, b=bottoms: _place_chains(c, b, k), records))
        live = rest.drop("top2")
        live.counts = rest.counts
    if known is None:
        known = nodes.limit(0).select(*_KEY, F.lit(None).cast("string").alias("root"), F.lit(0).alias("depth"), _no_names().alias("path"))
    # The rounds that went last are the smallest, so all reads together are a small multiple of the nodes.
    for place, records in reversed(undo):
        known = known.unionByName(written(place(records, known), "placed"))
    return known


def hierarchy(links: DataFrame, scope: str, node: str, parents: str, lists: bool = True) -> DataFrame:
    """Every node of every scope with its root, depth, path, subtree size and all descendants.

    `links` has one row per capture of a node: column `scope`, the node's name in `node` and in the
    array `parents` the names it may hang below. Only names that are nodes of the same scope count
    as parents; a node with several candidates takes the alphabetically first. Result columns:
    scope, node, parent, root, depth, path, subtree_size, descendants; without `lists` the last
    three are null and never made.

    Rows with a null or empty node are no nodes; a null, empty or blank-filled `parents` means no
    parent; repeated rows and repeated entries count once; a null scope is a scope of its own; an
    empty table gives an empty result; further columns are ignored. depth is -1 on a cycle (a node
    naming itself included) and -2 below one, where root is the first name, by code point, of the
    cycle. The path of a node on a cycle is the cycle from its first name along the parents; all
    nodes on a cycle have all that is on and below it as descendants.
    """
    schema = _schema(links.schema[scope].dataType)
    named_scope = F.when(F.col(scope).isNotNull(), F.concat(F.lit("="), F.col(scope).cast("string"))).otherwise("")
    named = links.select(named_scope.alias("scope"), F.col(node).alias("node"), F.col(parents).alias("parents")).filter(F.length("node") > 0)
    wanted = named.select("scope", "node", F.explode("parents").alias("parent")).filter(F.length("parent") > 0).distinct()
    exists = named.select("scope", F.col("node").alias("parent")).distinct()
    chosen = wanted.join(exists, ["scope", "parent"], "left_semi").groupBy(_KEY).agg(F.min("parent").alias("parent"))
    nodes = written(named.select(_KEY).distinct().join(chosen, _KEY, "left"), "nodes")
    found = nodes.join(peel(nodes, lists), _KEY)
    if lists:
        placed = written(found, "paths")
        on = placed.select("scope", "node", F.explode("path").alias("above")).filter("above <> node")
        below = on.groupBy("scope", F.col("above").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("descendants"))
        listed = F.coalesce("descendants", F.array().cast("array<string>"))
        found = placed.join(below, _KEY, "left").withColumns({"descendants": listed, "subtree_size": (F.size(listed) + 1).cast("long")})
    else:
        found = found.withColumns({"descendants": _no_names(), "subtree_size": F.lit(None).cast("long")})
    back = F.when(F.col("scope") != "", F.substr("scope", F.lit(2))).cast(schema["scope"].dataType)
    return found.withColumns({"scope": back, "depth": F.col("depth").cast("int")}).select(schema.names)
