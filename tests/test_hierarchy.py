import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import descendants, dropped_links, extends_links, links_of, resolve_hierarchy


def brute(parent):
    out = {}
    for c in parent:
        seen, x, path = set(), c, [c]
        while x in parent and x not in seen:
            seen.add(x)
            x = parent[x]
            path.append(x)
        out[c] = (-1, -1, None) if x in parent else (x, len(path) - 1, path)
    return out


def solve(spark, pairs):
    links = links_of(spark.createDataFrame(pairs, "c long, p long"), "c", "p")
    return resolve_hierarchy(links, with_path=True)


def check(spark, pairs):
    want = brute(dict(pairs))
    plain = {r["symbol_id"]: (r["root_id"], r["depth"]) for r in resolve_hierarchy(links_of(spark.createDataFrame(pairs, "c long, p long"), "c", "p")).collect()}
    assert plain == {k: v[:2] for k, v in want.items()}
    for r in solve(spark, pairs).collect():
        assert (r["root_id"], r["depth"]) == want[r["symbol_id"]][:2]
        if r["depth"] >= 0:
            assert r["path"] == want[r["symbol_id"]][2]


def test_random_forest_with_loops(spark):
    rnd = random.Random(3)
    pairs = [(i, rnd.randrange(0, max(1, i - 1))) for i in range(1, 150)] + [(500 + i, 500 + (i + 1) % 7) for i in range(7)] + [(600, 503), (601, 600), (700, 700), (701, 700)]
    check(spark, pairs)


def test_long_chain_and_star(spark):
    check(spark, [(i, i + 1) for i in range(200)] + [(1000 + i, 999) for i in range(100)])


def test_loops_are_listed(spark):
    got = solve(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (9, 9)]).where(F.col("loop").isNotNull()).collect()
    assert sorted(sorted(r["loop"]) for r in got) == [[1, 2, 3], [9]]


def test_empty_null_and_several_parents(spark):
    assert solve(spark, []).count() == 0
    links = links_of(spark.createDataFrame([(1, 5), (1, 4), (1, 4), (None, 2), (3, None)], "c long, p long"), "c", "p")
    assert [tuple(r) for r in links.collect()] == [(1, 4)]


def test_descendants(spark):
    got = {(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in descendants(solve(spark, [(1, 2), (2, 3), (4, 2)])).collect()}
    assert got == {(2, 1, 1), (3, 1, 2), (3, 2, 1), (2, 4, 1), (3, 4, 2)}


def test_descendants_on_and_below_loops(spark):
    pairs = [(1, 2), (2, 3), (3, 2), (9, 9), (8, 9), (5, 4)] + [(20 + i, 20 + (i + 1) % 7) for i in range(7)] + [(30, 23), (31, 30), (32, 25)]
    parent, want = dict(pairs), set()
    for c in parent:
        seen, x = [c], c
        while (x := parent.get(x)) is not None and x not in seen:
            want.add((x, c, len(seen)))
            seen.append(x)
    got = [(r["ancestor_id"], r["descendant_id"], r["distance"]) for r in descendants(solve(spark, pairs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (2, 1, 1) in want


@pytest.mark.parametrize("extra", [False, True])
def test_extends_links(spark, extra):
    refs = spark.createDataFrame([(1, 2, "extends", 0), (1, 2, "extends", 0), (3, None, "extends", 0), (5, 6, "implements", 0)], "from_symbol_id long, to_symbol_id long, kind string, child long")
    edges = spark.createDataFrame([(3, 4, "extends"), (1, 2, "extends"), (7, 8, "call")], "from_id long, to_id long, ref_kind string")
    assert {tuple(r) for r in extends_links(refs if extra else refs.drop("child"), edges).collect()} == {(1, 2), (3, 4)}


def test_links_beyond_one_parent_are_reported(spark):
    e = spark.createDataFrame([(1, 5), (1, 4), (1, 4), (1, 9), (2, 3), (None, 1), (3, None)], "a long, b long")
    assert sorted(map(tuple, dropped_links(e, "a", "b").collect())) == [(1, 5), (1, 9)] and dict(map(tuple, links_of(e, "a", "b").collect())) == {1: 4, 2: 3}
