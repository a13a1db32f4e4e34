import random
from itertools import combinations

import pytest

from codeloom.llm.cooccurrence import co_occurrence, coupled_files, touched_files


def brute(rows, least=1, half=False):
    baskets, sizes, sup = {}, {}, {}
    for s, b, i in {r for r in rows if None not in r}:
        baskets.setdefault((s, b), set()).add(i)
    for (s, _), items in baskets.items():
        sizes[s] = sizes.get(s, 0) + 1
        for i in items:
            sup[s, i] = sup.get((s, i), 0) + 1
    both = {}
    for (s, _), items in baskets.items():
        for a, b in combinations(sorted(items), 2):
            both[s, a, b] = both.get((s, a, b), 0) + 1
    out = {}
    for (s, a, b), c in both.items():
        x, y = sup[s, a], sup[s, b]
        if c >= least and (not half or 2 * c >= x + y - c):
            out[s, a, b] = (x, y, c, sizes[s], x + y - c)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1) for r in rows], "space string, basket string, item string, sup long")
    got = co_occurrence(df, **kw).collect()
    assert len({(r["space"], r["item_a"], r["item_b"]) for r in got}) == len(got)
    for r in got:
        assert abs(r["lift"] - r["n_both"] * r["n_baskets"] / (r["n_a"] * r["n_b"])) < 1e-9
    return {(r["space"], r["item_a"], r["item_b"]): (r["n_a"], r["n_b"], r["n_both"], r["n_baskets"], r["total_either"]) for r in got}


def sample(seed, n=400):
    rnd = random.Random(seed)
    rows = [(rnd.choice("pppq"), f"b{rnd.randrange(60)}", f"i{int(rnd.random() ** 2 * 30)}") for _ in range(n)]
    rows += [("p", "huge", f"i{k}") for k in range(40)] + rows[:20] + [(None, "b", "i"), ("p", None, "i1"), ("p", "b1", None)]
    return rows


@pytest.mark.parametrize("item_block,record_block", [(4, 20), (1000, 10_000)])
def test_all_pairs(spark, item_block, record_block):
    rows = sample(1)
    assert run(spark, rows, item_block=item_block, record_block=record_block) == brute(rows)


@pytest.mark.parametrize("item_block", [3, 1000])
def test_half_jaccard_prunes_exactly(spark, item_block):
    rows = sample(2, 700)
    assert run(spark, rows, least_count=4, half_jaccard=True, item_block=item_block) == brute(rows, 4, True)


def test_empty_and_single_items(spark):
    assert run(spark, []) == {}
    assert run(spark, [("p", "a", "x"), ("p", "b", "y")]) == {}


def test_code_point_order(spark):
    rows = [("p", f"b{i}", x) for i in range(2) for x in ("Z", "a", "é", "中", "\U0001f600")]
    assert run(spark, rows) == brute(rows)


def test_coupled_files(spark):
    deltas = []
    for i in range(12):
        deltas.append((f"c{i}", "modified", "r/x", "r/x"))
        if i < 4:
            deltas += [(f"c{i}", "added", None, "r\\a"), (f"c{i}", "deleted", "r/b", None), (f"c{i}", "deleted", "r/b", None)]
    deltas.append((None, "added", None, None))
    df = spark.createDataFrame(deltas, "sha string, status string, old_path string, new_path string")
    assert [tuple(r) for r in coupled_files(df).collect()] == [("r/a", "r/b")]
    assert touched_files(df).where("item is null").count() == 1
