import random

import pytest

from strataql.operators.hierarchy import hierarchy
from strataql.session import local_folder

SCHEMA = "repo long, name string, deps array<string>, scope string, node string"


def rows(spark, data, **kw):
    df = spark.createDataFrame([(r, n, d, "clash", "clash") for r, n, d in data], SCHEMA)
    return {(x.scope, x.node): x for x in hierarchy(df, "repo", "name", "deps", **kw).collect()}


DATA = [
    (1, "a", None),
    (1, "b", ["a", "base"]),
    (1, "c", ["b", "b", None, ""]),
    (1, "d", ["a"]),
    (1, "d", ["a"]),
    (1, "x", ["y"]),
    (1, "y", ["z"]),
    (1, "z", ["x"]),
    (1, "hang", ["y"]),
    (1, "hang2", ["hang"]),
    (1, "self", ["self"]),
    (1, None, ["a"]),
    (2, "a", ["b"]),
    (None, "n", ["m"]),
    (None, "m", []),
]


def test_by_hand(spark):
    got = rows(spark, DATA)
    assert got[1, "c"].path == ["a", "b", "c"] and got[1, "c"].depth == 2 and got[1, "c"].root == "a"
    assert got[1, "a"].descendants == ["b", "c", "d"] and got[1, "a"].subtree_size == 4
    assert got[1, "z"].depth == -1 and got[1, "z"].root == "x" and got[1, "z"].path == ["x", "y", "z"]
    assert got[1, "z"].descendants == ["hang", "hang2", "x", "y"] and got[1, "hang"].path == ["x", "y", "z", "hang"]
    assert got[1, "hang"].depth == -2 and got[1, "hang2"].depth == -2 and got[1, "hang2"].root == "x"
    assert got[1, "self"].depth == -1 and got[1, "self"].root == "self" and got[1, "self"].path == ["self"]
    assert got[2, "a"].depth == 0
    assert got[None, "n"].root == "m" and got[None, "n"].depth == 1
    assert len(got) == 13


def walked(parents):
    """Root, depth, path by walking up from every node."""
    out = {}
    for v in parents:
        up = [v]
        while parents[up[-1]] is not None and parents[up[-1]] not in up:
            up.append(parents[up[-1]])
        end = parents[up[-1]]
        if end is None:
            out[v] = (up[-1], len(up) - 1, up[::-1])
            continue
        at = up.index(end)
        ring, k = up[at:], up[at:].index(min(up[at:]))
        turned = ring[k:] + ring[:k]
        out[v] = (turned[0], -1 if at == 0 else -2, turned + up[:at][::-1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_by_brute_force(spark, seed):
    r = random.Random(seed)
    n = [60, 200, 300, 120][seed]
    names = [f"v{i:03d}" for i in range(n)]
    near = [1, 3, n, 2][seed]  # chains, bushes, anything, chains with cycles
    parents = {v: None if r.random() < 0.05 else names[r.randrange(n) if seed >= 2 and r.random() < 0.1 else max(0, i - r.randint(1, near))] for i, v in enumerate(names)}
    got = rows(spark, [(7, v, [p] if p else None) for v, p in parents.items()])
    want = walked(parents)
    assert {v: (x.root, x.depth, x.path) for (_, v), x in got.items()} == want
    below = {v: sorted(u for u in names if u != v and v in want[u][2]) for v in names}
    assert {v: x.descendants for (_, v), x in got.items()} == below
    bare = rows(spark, [(7, v, [p] if p else None) for v, p in parents.items()], lists=False)
    assert {v: (x.root, x.depth, x.path, x.descendants) for (_, v), x in bare.items()} == {v: (*w[:2], None, None) for v, w in want.items()}


def test_long_chain_and_long_cycle(spark):
    n = 100_000
    df = spark.range(2 * n).selectExpr(f"id div {n} AS repo", "format_string('v%06d', id) AS name", f"CASE WHEN id % {n} > 0 THEN array(format_string('v%06d', id - 1)) WHEN id > 0 THEN array(format_string('v%06d', {2 * n - 1})) END AS deps")
    got = {(r["scope"], r["depth"]): (r["n"], r["root"]) for r in hierarchy(df, "repo", "name", "deps", lists=False).selectExpr("scope", "least(depth, 0) AS depth", "root", "depth AS d").groupBy("scope", "depth").agg({"d": "max", "root": "max"}).selectExpr("scope", "depth", "`max(d)` AS n", "`max(root)` AS root").collect()}
    assert got == {(0, 0): (n - 1, "v000000"), (1, -1): (-1, "v100000")}


def test_empty_and_folders(spark):
    assert rows(spark, []) == {} and rows(spark, [], lists=False) == {}
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            local_folder(master)
