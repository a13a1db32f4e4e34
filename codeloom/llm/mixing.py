"""Mixing documents of several sources to target shares of a token budget.

A naive Bayes classifier over token ids is fitted on labelled documents and gives every document
a posterior over the domains. The membership of a document is its recorded label (weight
``label_trust``) and its posterior (the rest). Projected gradient descent then fits one
nonnegative rate per document and mix, at most the mix's ``max_repeats``, so that the expected
tokens per domain meet the targets in the least-squares sense. The projection is lazy: gradients
are summed, and a rate is the sum clipped to its range, so the state of the descent is one number
per mix and domain and a step costs the same however many came before. Every step is one
aggregation over all documents that returns one residual per mix and domain. A second descent with
the labels alone makes the totals by label exact, since the shares are reported by label. Rates are
rounded to whole repeats so that the rounding errors cancel, in hash buckets of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tokenize import TOKENIZER_DIR, VOCABULARY, encoder
from codeloom.session import cut

#: The classifier is fitted on at most about so many labelled documents, chosen by a hash of the id.
FIT_DOCS = 50_000
LABEL_TRUST = 0.9
#: A descent ends when the tokens that its targets still lack change, per mix, by less than this
#: share of all tokens: with posteriors, and then with labels, which make the totals exact. Each
#: gives up, and says so, after so many steps.
SETTLED, STEPS = (1e-4, 1e-6), 200
BUCKET_DOCS = 20_000


def source_key(source: Column) -> Column:
    """The form in which sources are compared: lower case, trimmed, ``_`` for ``-``."""
    return F.replace(F.lower(F.trim(source)), F.lit("-"), F.lit("_"))


def _encoded(docs: DataFrame, tokenizer_dir: str, name: str) -> DataFrame:
    path = f"{tokenizer_dir}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = e.encode_batch(b.column(2).to_pylist())
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "label", "n_tokens", "ids"])

    rows = docs.select("doc_id", source_key(F.col("source")).alias("label"), "text")
    return rows.mapInArrow(run, "doc_id long, label string, n_tokens long, ids array<int>")


def _fit(encoded: DataFrame, labels: list[str], n_docs: int) -> np.ndarray:
    """Log-likelihoods (domain by token id, then the prior in the last column)."""
    share = min(1.0, FIT_DOCS / max(1, n_docs))
    chosen = encoded.where(F.col("label").isin(labels) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([labels.index(x) for x in b.column(0).to_pylist()], np.int64)
            ids = b.column(1)
            flat = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()].astype(np.int64)
            code, n = np.unique(np.repeat(at, np.diff(ids.offsets.to_numpy())) << 32 | flat, return_counts=True)
            docs = np.bincount(at, minlength=len(labels))
            k = np.arange(len(labels))
            cols = [np.concatenate([code >> 32, k]), np.concatenate([code & 0xFFFFFFFF, np.full(len(k), -1)]), np.concatenate([n, docs])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["k", "id", "n"])

    counts = chosen.select("label", "ids").mapInArrow(run, "k long, id long, n long").groupBy("k", "id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # at most domains * (size of the vocabulary + 1) rows
    table = np.ones((len(labels), int(max(rows["id"].max() if len(rows) else 0, 0)) + 2))  # the last column is for unseen ids
    prior = np.ones(len(labels))
    is_doc = (rows["id"] < 0).to_numpy()
    np.add.at(prior, rows["k"].to_numpy()[is_doc], rows["n"].to_numpy()[is_doc])
    np.add.at(table, (rows["k"].to_numpy()[~is_doc], rows["id"].to_numpy()[~is_doc]), rows["n"].to_numpy()[~is_doc])
    return np.hstack([np.log(table / table.sum(1, keepdims=True)), np.log(prior / prior.sum())[:, None]]).astype(np.float32)


def _members(encoded: DataFrame, labels: list[str], model: np.ndarray, trust: float) -> DataFrame:
    """(doc_id, label number, n_tokens, q): the membership of every document with a listed label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            lens = np.diff(ids.offsets.to_numpy())
            flat = np.minimum(ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()], model.shape[1] - 2)
            owner = np.repeat(np.arange(len(lens)), lens)
            score = np.stack([np.bincount(owner, model[k][flat], len(lens)) for k in range(len(labels))], 1) if len(lens) else np.zeros((0, len(labels)))
            # The geometric mean over tokens tempers the overconfidence of naive Bayes.
            score = score / np.maximum(1, np.sqrt(lens))[:, None] + model[:, -1]
            post = np.exp(score - score.max(1, keepdims=True)) if len(lens) else score
            post /= post.sum(1, keepdims=True)
            at = b.column(1).to_numpy()
            q = (1 - trust) * post
            q[np.arange(len(at)), at] += trust
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(np.arange(0, q.size + 1, len(labels), dtype=np.int32), q.astype(np.float32).ravel())], ["doc_id", "at", "n_tokens", "q"])

    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1
    rows = encoded.where(F.col("label").isin(labels)).select("doc_id", number.cast("int").alias("at"), "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id long, at int, n_tokens long, q array<float>")


def _rates(at: np.ndarray, q: np.ndarray, caps: np.ndarray, soft: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Rates (documents by mixes) for the summed gradients of both descents (mixes by domains)."""
    cap = caps[:, at].T
    return np.clip(np.clip(q @ soft.T, 0, cap) + hard[:, at].T, 0, cap)


def _arrays(b: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.array(b.column(3).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, domains)
    return b.column(1).to_numpy(), b.column(2).to_numpy(), q


def _totals(members: DataFrame, caps: np.ndarray, soft: np.ndarray, hard: np.ndarray, by_label: bool) -> np.ndarray:
    """Tokens (mixes by domains) under the present rates, then one row with the tokens there are."""
    mixes, domains = caps.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((mixes + 1, domains))
        for b in batches:
            at, n, q = _arrays(b, domains)
            rate = np.vstack([_rates(at, q, caps, soft, hard).T, np.ones(len(at))])
            total += rate * n @ (np.eye(domains)[at] if by_label else q)
        m, d = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(m.ravel(), pa.int32()), pa.array(d.ravel(), pa.int32()), pa.array(total.ravel())], ["m", "d", "x"])

    out = np.zeros((mixes + 1, domains))
    for r in members.mapInArrow(run, "m int, d int, x double").groupBy("m", "d").agg(F.sum("x").alias("x")).collect():
        out[r["m"], r["d"]] = r["x"]
    return out


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole repeats for the rates of one bucket: each is the rate rounded down or up.

    From the longest document to the shortest, a rate is rounded up where the tokens drawn so
    far lag behind the rates by half the document or more, so the bucket is off by half of a
    short document at the end.
    """
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
    lag, repeats = 0.0, []
    for n, rate in zip(pdf["n_tokens"].to_list(), pdf["rate"].to_list()):
        low = int(rate + 1e-9)
        lag += n * max(0.0, rate - low)
        up = rate - low > 1e-9 and lag >= n / 2
        lag -= n * up
        repeats.append(low + up)
    return pdf.assign(repeats=np.array(repeats, np.int32))[["m", "at", "doc_id", "n_tokens", "repeats"]]


def mix_documents(docs: DataFrame, targets: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY, label_trust: float = LABEL_TRUST) -> tuple[DataFrame, DataFrame]:
    """(repeats per document, shares per mix and source).

    ``targets``: mix_id, source, target_share, max_repeats, budget_share, a small table of fixed
    size that is read to the driver. The budget of a mix is ``budget_share`` times the tokens of
    all documents; a source gets ``target_share`` of it, or all it has ``max_repeats`` times,
    whichever is less: what a short source lacks is reported, not given to others. Documents
    without a listed source are in no mix; null and empty texts have no tokens and are drawn 0
    times. Repeats: mix_id, source, doc_id, n_tokens, repeats >= 1. Shares: one row per target,
    also where the source has no documents; ``settled`` says whether both descents ended by themselves.
    """
    spark = docs.sparkSession
    rows = targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_share").collect()
    mixes, labels = sorted({r["mix_id"] for r in rows}), sorted({r["source"] for r in rows})
    caps, want = np.zeros((len(mixes), len(labels))), np.zeros((len(mixes), len(labels)))
    encoded = cut(_encoded(docs, tokenizer_dir, name))
    all_docs, all_tokens = encoded.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    for r in rows:
        at = mixes.index(r["mix_id"]), labels.index(r["source"])
        caps[at], want[at] = r["max_repeats"], r["target_share"] * r["budget_share"] * all_tokens
    members = cut(_members(encoded, labels, _fit(encoded, labels, all_docs), label_trust).where(F.col("n_tokens") > 0))
    sums = np.zeros((2, *caps.shape))
    settled = True
    for by_label, enough in zip((False, True), SETTLED):
        before = np.inf
        for step in range(STEPS + 1):
            got = _totals(members, caps, *sums, by_label)
            residual = want - got[:-1]
            error = float(np.abs(residual).sum()) / max(1, all_tokens)
            if error < enough or before - error < enough * len(mixes):
                break
            settled &= step < STEPS
            before = error
            # Each document moves by the share that its domains lack; what would only carry a domain
            # further beyond its largest rate, or below none, is left out of the sum.
            sums[int(by_label)] += residual / np.maximum(got[-1], 1)
            if by_label:
                sums[1] = np.clip(sums[1], -caps, caps)
    soft, hard = sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, q = _arrays(b, len(labels))
            rate = _rates(at, q, caps, soft, hard)
            m = np.tile(np.arange(len(mixes)), len(at))
            keep = rate.ravel() > 0
            each = lambda x: np.repeat(x, len(mixes))[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[keep], pa.int32()), pa.array(each(at), pa.int32()), pa.array(each(b.column(0).to_numpy())), pa.array(each(n)), pa.array(rate.ravel()[keep])],
                ["m", "at", "doc_id", "n_tokens", "rate"],
            )

    rates = members.mapInArrow(run, "m int, at int, doc_id long, n_tokens long, rate double")
    buckets = max(1, -(-all_docs // BUCKET_DOCS))
    rates = rates.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    rates = rates.groupBy("m", "at", "bucket").applyInPandas(_whole, "m int, at int, doc_id long, n_tokens long, repeats int")
    text = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col(c) + 1)
    repeats = rates.select(text(mixes, "m").alias("mix_id"), text(labels, "at").alias("source"), "doc_id", "n_tokens", "repeats")
    repeats = repeats.where(F.col("repeats") > 0)
    used = repeats.groupBy("mix_id", "source").agg(
        F.count(F.lit(1)).alias("docs_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats")
    )
    there = members.groupBy(text(labels, "at").alias("source")).agg(F.count(F.lit(1)).alias("docs_there"), F.sum("n_tokens").alias("tokens_there"))
    goal = targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "budget_share")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shares = goal.join(used, ["mix_id", "source"], "left").join(there, "source", "left").select(
        "mix_id", "source", "target_share", "max_repeats", zero("docs_there"), zero("tokens_there"), zero("docs_used"), zero("tokens_used"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.col("target_share") * F.col("budget_share") * F.lit(float(all_tokens))).alias("tokens_wanted"),
    )
    mix = Window.partitionBy("mix_id")
    shares = shares.withColumn("mean_repeats", F.when(F.col("tokens_there") > 0, F.col("tokens_used") / F.col("tokens_there")).otherwise(F.lit(0.0)))
    total = F.sum("tokens_used").over(mix)
    shares = shares.withColumn("actual_share", F.when(total > 0, F.col("tokens_used") / total).otherwise(F.lit(0.0)))
    return repeats, shares.withColumn("settled", F.lit(settled))
