
from codeloom.operators import history as H

COMMIT = "sha string, seq int, commit_ts long, author_name string, summary string, files_changed int"
DELTA = "sha string, status string, old_path string, new_path string"


def tables(spark, history):
    """history: per commit, oldest first, the deltas (status, old, new)."""
    n = len(history)
    commits = [(f"c{i}", n - i, i, f"a{i % 2}", "s", len(d)) for i, d in enumerate(history)]
    deltas = [(f"c{i}", *x) for i, d in enumerate(history) for x in d]
    return spark.createDataFrame(deltas, DELTA), spark.createDataFrame(commits, COMMIT)


def walk(spark, history, target):
    d, c = tables(spark, history)
    return H.tracked_walk(d, c, spark.createDataFrame([(target,)], "target string"))


def shas(w):
    return [r["sha"] for r in w.orderBy("seq").collect()]


ADD, MOD = "added", "modified"


def test_double_rename(spark):
    w = walk(spark, [[(ADD, None, "r/a")], [("renamed", "r/a", "r/b")], [("renamed", "r/b", "r/c")], [(MOD, "r/c", "r/c")]], "r/c")
    assert shas(w) == ["c3", "c2", "c1", "c0"]
    assert H.introduced(w).first()["introduced"] == "c0"
    assert [r["renamed"] for r in w.orderBy("seq").collect()] == [False, False, True, True]
    assert H.introduced(w, 4).first()["introduced"] is None
    assert shas(H.limit_history(w, 2)) == ["c3", "c2"]


def test_recreated_file_starts_again(spark):
    w = walk(spark, [[(ADD, None, "r/a")], [("deleted", "r/a", None)], [(ADD, None, "r/a")], [(MOD, "r/a", "r/a")]], "r/a")
    assert shas(w) == ["c3", "c2"]


def test_missing_path_and_backslashes(spark):
    assert walk(spark, [[(ADD, None, "r/a")]], "r/none").count() == 0
    assert shas(walk(spark, [[(ADD, None, "r\\x\\a")], [(MOD, "r/x/a", "r/x/a")]], "r/x/a")) == ["c1", "c0"]


def test_coupling_two_thirds(spark):
    d, _ = tables(spark, [[(ADD, None, "r/a"), (ADD, None, "r/b")], [(MOD, "r/a", "r/a"), (MOD, "r/b", "r/b")], [(MOD, "r/a", "r/a")], [(ADD, None, "r/c")]])
    rows = H.coupling_of(d.unionAll(d), spark.createDataFrame([("r/a",)], "path string")).collect()
    assert [(r["file"], r["co_change_count"], r["total_commits_either_file"], round(r["ratio"], 4)) for r in rows] == [("r/b", 2, 3, 0.6667)]


def test_symbol_history_by_span(spark):
    d, c = tables(spark, [[(ADD, None, "r/a")], [(MOD, "r/a", "r/a")], [(MOD, "r/a", "r/a")]])
    w = H.tracked_walk(d, c, spark.createDataFrame([("r/a",)], "target string"))
    hunks = spark.createDataFrame([("c0", "r/a", 0, 0, 1, 12), ("c1", "r/a", 1, 6, 1, 6), ("c2", "r/a", 7, 6, 7, 6)], "sha string, path string, old_start int, old_lines int, new_start int, new_lines int")
    spans = spark.createDataFrame([("r/a", 2, 4)], "target string, start_line int, end_line int")
    got = H.symbol_history(w, hunks, spans).orderBy("seq").collect()
    assert [r["sha"] for r in got] == ["c1", "c0"] and {r["confidence"] for r in got} == {"high"}
    d, c = tables(spark, [[(ADD, None, "r/b")], [("renamed", "r/b", "r/a")], [(MOD, "r/a", "r/a")]])
    w = H.tracked_walk(d, c, spark.createDataFrame([("r/a",)], "target string"))
    got = H.symbol_history(w, hunks, spans).collect()
    assert {r["confidence"] for r in got} == {"low"} and "c0" in {r["sha"] for r in got}


def test_authors_and_refactors(spark):
    d, c = tables(spark, [[(ADD, None, "r/a")], [(MOD, "r/a", "r/a")], [(MOD, "r/a", "r/a")]])
    assert H.authors_in_order(H.file_commits(d, c)).first()["authors"] == ["a0", "a1"]
    c = spark.createDataFrame([("x", 1, 1, None, "Big REWRITE", 1), ("y", 2, 1, None, None, 5), ("z", 3, 1, None, "fix", None), ("x", 1, 1, None, "Big REWRITE", 1)], COMMIT)
    assert {r["sha"] for r in H.major_refactors(c).collect()} == {"x", "y"}


def test_reports_follow_renames(spark, tmp_path):
    from codeloom.plans.index_queries import QUERIES

    d, c = tables(spark, [[(ADD, None, "r/a"), (ADD, None, "r/x")], [("renamed", "r/a", "r/b")]])
    d.write.parquet(f"{tmp_path}/deltas.parquet")
    c.write.parquet(f"{tmp_path}/commits.parquet")
    spark.createDataFrame([(100, "r/b", "h", 0)], "id long, path string, content_hash string, indexed_at long").write.parquet(f"{tmp_path}/files.parquet")

    def rows(name, where):
        return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).where(where).collect()]

    assert rows("tracked_introduced", "target = 'r/b'") == rows("tracked_introduced_capped", "target = 'r/b'") == [("r/b", 2, "c0")]
    assert rows("tracked_authors", "path = 'r/b'") == [("r/b", "a1,a0")]
    assert rows("tracked_coupling", "path = 'r/b'") == [("r/b", "r/x", 1, 2, 0.5)]
