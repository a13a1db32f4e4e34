import re

import pytest

from codeloom.llm.sentences import Model, blocks, language_key, learn, model_of, read, sentence_units, split

EMPTY = Model({}, {}, {})
EN = Model({"en": frozenset({"vs", "approx", "e.g", "p.m"})}, {"en": frozenset({("no", "#"), ("#", "mai"), ("z", "b")})}, {"en": frozenset({"the"})})


def units(text, lang="en", model=EN):
    got = split(text, lang, model)
    flat = "".join(text[a:b] for a, b in got)
    assert re.sub(r"\s", "", flat) == re.sub(r"\s", "", text)
    assert all(text[a:b] == text[a:b].strip() != "" for a, b in got)
    return [text[a:b] for a, b in got]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("It is approx. 5 vs. seven. No. 4 fell. No. I would not.", ["It is approx. 5 vs. seven.", "No. 4 fell.", "No.", "I would not."]),
        ("Version 1.2.3 cut 4.5 ms. walk_tree returns null.", ["Version 1.2.3 cut 4.5 ms.", "walk_tree returns null."]),
        ('"Flush it. Then go." is said. He wrote "Fine." The end', ['"Flush it. Then go." is said.', 'He wrote "Fine."', "The end"]),
        ("The cache (it was warm. It is.) did not help. (So it goes.) Next.", ["The cache (it was warm. It is.) did not help.", "(So it goes.)", "Next."]),
        ("The check said: 'All rows match.' It isn't so.", ["The check said: 'All rows match.'", "It isn't so."]),
        ("Wait... the mirror holds. Hm... The end.", ["Wait... the mirror holds.", "Hm...", "The end."]),
        ("One line\ngoes on. Two\n\nnew block", ["One line\ngoes on.", "Two", "new block"]),
        ("# A head. Still\n- an item. One\n1. num. Two\n\ntext", ["# A head. Still", "- an item. One", "1. num. Two", "text"]),
        ("(max.\n612) and a name. Done.", ["(max.\n612) and a name.", "Done."]),
        ("a ? b : c stays. Really?! Yes", ["a ? b : c stays.", "Really?!", "Yes"]),
        ("```py\nx = 1. y\n\nz\n```\n\nAfter. That", ["```py\nx = 1. y\n\nz\n```", "After.", "That"]),
        ("他问：“过期了吗？”日志在重建。旧说明写着“先空。再换。”这句话。（见第3行。）之后", ["他问：“过期了吗？”", "日志在重建。", "旧说明写着“先空。再换。”这句话。", "（见第3行。）", "之后"]),
        ("「もう古いの？」と聞かれました。まだ！", ["「もう古いの？」と聞かれました。", "まだ！"]),
        ("缓存已经重建 不要合并 版本1.2已经", ["缓存已经重建", "不要合并", "版本1.2已经"]),
        ("ทำไม weigh_handle จึงจบเร็ว รุ่น 4.29.0 ลดเวลาลงแล้ว", ["ทำไม weigh_handle จึงจบเร็ว", "รุ่น 4.29.0 ลดเวลาลงแล้ว"]),
        ("Γιατί σταματά; Μην το αλλάξετε!", ["Γιατί σταματά;", "Μην το αλλάξετε!"]),
        ("लेखा बनता है। फिर", ["लेखा बनता है।", "फिर"]),
        ("  \r\n A b.\r\n\r\n\tC d. ", ["A b.", "C d."]),
    ],
)
def test_units(text, want):
    assert units(text) == want


def test_learned_collocations_hold():
    assert units("Am 7. Mai lief es. Der z. B. Fall.") == ["Am 7. Mai lief es.", "Der z. B. Fall."]


@pytest.mark.parametrize("text", ["", " \n\t ", "((((", '"""', "....", "```", "# ", "-", "a" * 50_000, "x. " * 5000])
def test_odd_texts_are_covered(text):
    units(text, model=EMPTY)


def test_language_key():
    assert [language_key(x) for x in (None, "", "EN", "en-XX", "eng", "zho", "deu")] == ["?", "?", "en", "en", "en", "zh", "de"]


def test_blocks_keep_list_items_whole():
    text = "- one\n  more\n- two\nplain"
    assert [text[a:b] for a, b, _ in blocks(text)] == ["- one\n  more", "- two\nplain"] or [text[a:b] for a, b, _ in blocks(text)] == ["- one\n  more", "- two", "plain"]


def test_learning_finds_abbreviations(spark):
    rows = [(i, f"See Fig. {i} of it. The no. {i} is kept. It works. Add two, i.e. more. The end came.", "en") for i in range(300)]
    rows += [(900 + i, f"Am {i}. Mai lief das. Der {i}. Mai war gut. Es war so.", "de") for i in range(200)]
    rows += [(2000, None, None), (2001, "", "en"), (2002, "  ", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = model_of(tuple(r) for r in learn(read(docs)).collect())
    assert {"fig", "no", "i.e"} <= model.abbreviations["en"] and "it" not in model.abbreviations["en"]
    assert ("#", "mai") in model.pairs["de"]
    got = {}
    for r in sentence_units(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start_char"], r["end_char"]))
    assert 2000 not in got and 2001 not in got and 2002 not in got
    text = rows[5][1]
    assert [text[a:b] for a, b in sorted(got[5])] == ["See Fig. 5 of it.", "The no. 5 is kept.", "It works.", "Add two, i.e. more.", "The end came."]
    assert len(got[905]) == 3
    assert {"the", "it"} <= model.starters["en"] and "mai" not in model.starters["de"]
    joined = sorted(tuple(r) for r in sentence_units(docs.unionByName(docs.limit(3)), model_rows=0).collect())
    assert joined == sorted(tuple(r) for r in sentence_units(docs.unionByName(docs.limit(3))).collect())


def test_empty_table(spark):
    assert sentence_units(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
