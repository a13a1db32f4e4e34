import base64
import random
from pathlib import Path

import pytest
import tiktoken

from codeloom.llm.tokenize import PATTERN, TOKENIZER_DIR, Encoder, encode_documents, token_counts

FILE = Path(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary here")
HARD = [
    "<|endoftext|> is plain", "a\x1c b\x1d\x1e \x1f\x85 c\u2003\u3000 d", "a" * 3000, "ab" * 2000, "\U0001f469\u200d\U0001f4bb" * 20, "  \n\n\t x  ", "\u0e01" * 300,
    "I'LL don't 'S it's we've", "\u0661\u0662\u0663 12345 1.5e3", "\ufeff\u200b", "e\u0301\u0301\u0301", "\r\n\r\n", " ", "naïve — ça", "日本語のテキスト。", "\x00\x01",
]


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILE.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def mine():
    return Encoder(str(FILE))


def test_hard_texts(exact, mine):
    assert mine.encode_batch(HARD) == [exact.encode_ordinary(t) for t in HARD]


def test_random_texts(exact, mine):
    rnd = random.Random(7)
    letters = "abcdefghij klmno ,.;:-_()\n\tABC äöüß éабв 中文字 12345 '\" \u0e01\u0e32 \U0001f600"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(120))) for _ in range(3000)]
    assert mine.encode_batch(texts) == [exact.encode_ordinary(t) for t in texts]


def test_compatible_pairs_are_those_that_merging_leaves(mine):
    rnd = random.Random(5)
    word = {r: t for t, r in mine.rank.items()}
    import numpy as np

    a = np.array([rnd.randrange(50256) for _ in range(4000)])
    b = np.array([rnd.choice([rnd.randrange(50256), rnd.randrange(600)]) for _ in range(4000)])
    for x, y, ok in zip(a.tolist(), b.tolist(), mine.compatible(a, b).tolist()):
        assert ok == (mine._merge(word[x] + word[y]) == [word[x], word[y]])


def test_operator(spark, exact):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "hello world", 0), (4, "hello world", 0), (None, "x", 0), *((10 + i, t, 0) for i, t in enumerate(HARD) if "\x00" not in t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = [(r["doc_id"], r["ids"]) for r in encode_documents(docs).collect()]
    want = [(i, exact.encode_ordinary(t) if t else []) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encode_documents(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs.where("doc_id < 4"), ["doc_id"]).collect()} == {1: 0, 2: 0, 3: len(exact.encode_ordinary(" \n"))}
