from pyspark.sql import functions as F

from codeloom.llm import doc_pairs
from codeloom.llm.parse_check import spread_texts


def test_copies(spark, monkeypatch):
    """Every copy of a text has its nodes, by the dialect of its own path; a task parses a text once."""
    py, js = "def f():\n    'é'\n    pass\n", "/** a */\nfunction f() {}\n"
    rows = [(1, "r/a.py", py), (2, "r/b.py", py), (3, "r/a.js", js), (4, "r/b.ts", js), (5, "r/b.js", js), (6, "r/c.py", js), (7, "r/d.py", "x = 1\n")]
    src = spark.createDataFrame(rows, "file_id long, path string, content string")
    got = sorted((r["file_id"], r["start_byte"], r["end_byte"], r["doc"], r["code"]) for r in doc_pairs.function_nodes(src).collect())
    size = len(py.encode()) - 1
    assert got == [(1, 0, size, "é", py[:-1]), (2, 0, size, "é", py[:-1])] + [(i, 9, 24, "/** a */", js[9:24]) for i in (3, 4, 5)]
    assert sorted(map(tuple, doc_pairs.function_nodes(src, False).drop("code").collect())) == [x[:4] for x in got]
    parsed = spread_texts(src).withColumn("part", F.spark_partition_id()).groupBy("content").agg(F.countDistinct("part").alias("n"))
    assert all(r["n"] == 1 for r in parsed.collect())
