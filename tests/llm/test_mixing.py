import pytest
from pyspark.sql import functions as F

from codeloom.llm.mixing import mix_documents, source_key

DOC = "doc_id long, text string, source string, extra int"
TARGET = "mix_id string, source string, target_share double, max_repeats int, budget_share double"


def docs(spark):
    rows = [(i, " ".join(["alpha commit fix"] * (i % 7 + 1)), " Commit-Message" if i % 2 else "commit_message", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(["long readme text about tables"] * (i % 5 + 2)), "README", 1) for i in range(40)]
    rows += [(2000, None, "readme", 1), (2001, "", "readme", 1), (2002, "no source here", None, 1), (2003, "other source", "wiki", 1)]
    return spark.createDataFrame(rows, DOC)


def test_source_key(spark):
    assert spark.range(1).select(source_key(F.lit(" Review-Comment ")).alias("x")).first()["x"] == "review_comment"


def test_targets_are_met_or_capped(spark):
    targets = spark.createDataFrame([("m", "commit_message", 0.5, 3, 0.6), ("m", "readme", 0.5, 3, 0.6), ("s", "readme", 0.9, 2, 2.0), ("s", "missing", 0.1, 4, 2.0)], TARGET)
    repeats, shares = mix_documents(docs(spark), targets)
    rows = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    for key in (("m", "commit_message"), ("m", "readme")):
        assert abs(rows[key]["tokens_used"] - rows[key]["tokens_wanted"]) <= 40
        assert abs(rows[key]["actual_share"] - 0.5) < 0.02
    short = rows["s", "readme"]
    assert short["tokens_used"] == 2 * short["tokens_there"] < short["tokens_wanted"]
    assert rows["s", "missing"]["tokens_used"] == 0 and rows["s", "missing"]["docs_there"] == 0
    got = repeats.collect()
    assert all(1 <= r["repeats"] <= 3 for r in got) and not {r["doc_id"] for r in got} & {2000, 2001, 2002, 2003}
    used = {}
    for r in got:
        used[r["mix_id"], r["source"]] = used.get((r["mix_id"], r["source"]), 0) + r["repeats"] * r["n_tokens"]
    assert all(used.get(k, 0) == r["tokens_used"] for k, r in rows.items())


def test_empty_tables(spark):
    targets = spark.createDataFrame([("m", "readme", 1.0, 1, 1.0)], TARGET)
    repeats, shares = mix_documents(docs(spark).limit(0), targets)
    assert repeats.count() == 0 and shares.first()["tokens_used"] == 0


@pytest.mark.parametrize("share", [0.2, 0.7])
def test_budget_share_scales(spark, share):
    targets = spark.createDataFrame([("m", "commit_message", 1.0, 2, share)], TARGET)
    r = mix_documents(docs(spark), targets)[1].first()
    assert r["tokens_used"] <= 2 * r["tokens_there"] and (abs(r["tokens_used"] - r["tokens_wanted"]) < 20 or r["tokens_used"] == 2 * r["tokens_there"])
