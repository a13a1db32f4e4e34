import random
from collections import defaultdict

import pytest

from codeloom.operators.tree_agg import chunk_count, hot_keys, key_counts, reference_key_stats

SCHEMA = "id long, from_file_id long, to_name string, to_symbol_id long, kind string"


def brute(rows):
    out = defaultdict(lambda: [0, set(), set(), defaultdict(int)])
    for i, f, n, s, k in rows:
        for key in (("to_name", n), ("to_symbol_id", None if s is None else str(s))):
            o = out[key]
            o[0] += 1
            o[1].add(i)
            o[2].add(f)
            o[3][k] += 1
    return {k: (a, len(b - {None}), len(c - {None}), d["call"], d["extends"], d[None] + d["odd"]) for k, (a, b, c, d) in out.items()}


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = reference_key_stats(df, **kw)[0].collect()
    assert len({(r["field"], r["key_value"]) for r in got}) == len(got)
    return {(r["field"], r["key_value"]): (r["n_rows"], r["n_ids"], r["n_files"], r["rows_call"], r["rows_extends"], r["rows_other"]) for r in got}


@pytest.mark.parametrize("chunk_rows,fan_in", [(7, 2), (50, 3), (10_000, 16)])
def test_against_brute_force(spark, chunk_rows, fan_in):
    rnd = random.Random(1)
    rows = [
        (rnd.randrange(400), rnd.choice([None, *range(9)]), rnd.choice(["hot"] * 6 + [None, "a", "b", ""]), rnd.choice([None] * 4 + [1] * 5 + [2, 3]), rnd.choice(["call", "extends", None, "odd"]))
        for _ in range(600)
    ]
    rows += rows[:50] + [(None, None, None, None, None)]
    assert run(spark, rows, chunk_rows=chunk_rows, fan_in=fan_in) == brute(rows)


def test_one_key_holds_all_rows(spark):
    rows = [(i, i % 5, "only", 7, "call") for i in range(300)]
    assert run(spark, rows, chunk_rows=10, fan_in=2) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, 2, "x", 3, "call", 9, 9, "f")], SCHEMA + ", chunk long, n_rows long, field string")
    assert reference_key_stats(df)[0].count() == 2


def test_hot_keys_share(spark):
    rows = [(i, 1, "big" if i < 50 else f"n{i}", None, "call") for i in range(100)]
    got = {(r["field"], r["key_value"]) for r in hot_keys(spark.createDataFrame(rows, SCHEMA), share=0.02).collect()}
    assert got == {("to_name", "big")}


def test_chunk_count():
    assert [chunk_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


@pytest.mark.parametrize("fan_in,parts", [(2, 9), (16, 3)])
def test_key_counts_are_those_of_the_full_statistics(spark, fan_in, parts):
    rows = [(i, f"n{i % 3}" if i % 7 else None, i % 4 if i % 5 else None, 1, "call") for i in range(200)] * 2
    refs = spark.createDataFrame(rows, "id long, to_name string, to_symbol_id long, from_file_id long, kind string").repartition(parts)
    counts, total = key_counts(refs, fan_in)
    want = {(r["field"], r["key_value"]): r["n_rows"] for r in reference_key_stats(refs, chunk_rows=50)[0].collect()}
    assert total == 400 and {(r["field"], r["key_value"]): r["n_rows"] for r in counts.collect()} == want
    assert key_counts(refs.limit(0))[1] == 0 and hot_keys(refs.limit(0)).count() == 0
