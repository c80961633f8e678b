"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (UTF-8 bytes, with one blank at each end), a text the mean
of its words, and two output rows turn that into the classes' logits.  Vectors and output rows are trained together.
Since all of it is linear up to the softmax, a trained model is one number for each n-gram bucket: what it adds to the
difference of the logits.  Misspellings of a word keep most of its n-grams and so most of its number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, _lower, _signs, chunks, mix, powers, prefix_sums, session, span_hash, table, utf8, wrapping_sums

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16
#: Neutral words that every average holds besides the text's own: few words alone prove little.
NEUTRAL = 50
#: Parts of the labelled texts that are held back in turn to set the bias.
FOLDS = 3
#: Labelled texts that training may see, of each class: the first by hash of doc_id.
SAMPLE = {0: 2700, 1: 900}


@dataclass
class Bag:
    """Words of some texts: each word's hash, n-gram sum range and text."""

    word: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buckets: list[np.ndarray]
    inside: list[np.ndarray]


def bag(texts: list[bytes]) -> Bag:
    data = _lower[np.frombuffer(b" " + b" ".join(texts) + b"     ", np.uint8)]
    blank = _signs[data]
    data = np.where(blank, np.uint8(32), data)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    sums = wrapping_sums(data)
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    inv = powers(len(data))[1]
    buckets, inside = [], []
    for n in GRAMS:
        m = len(data) - n + 1
        h = mix((sums[n:] - sums[:-n]) * inv[:m] + np.uint64(n))
        ok = np.ones(m, bool)
        for i in range(1, n - 1):
            ok &= ~blank[i : i + m]
        buckets.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        inside.append(ok)
    return Bag(span_hash(prefix_sums(data), start, end), np.searchsorted(start, at), start, end, buckets, inside)


def gram_counts(length: np.ndarray) -> np.ndarray:
    return sum(np.maximum(length + 3 - n, 0) for n in GRAMS)


def text_means(b: Bag, weight: np.ndarray) -> np.ndarray:
    """Mean over a text's words, and NEUTRAL words of weight 0, of the mean of their n-grams' weights."""
    v = np.zeros(len(b.inside[0]), np.float64)
    for buckets, ok in zip(b.buckets, b.inside, strict=True):
        v[: len(ok)] += np.where(ok, weight[buckets], 0.0)
    sums = np.concatenate(([0.0], np.cumsum(v)))
    per_word = (sums[b.end] - sums[b.start - 1]) / gram_counts(b.end - b.start)
    total = np.concatenate(([0.0], np.cumsum(per_word)))
    n = np.diff(b.first)
    return (total[b.first[1:]] - total[b.first[:-1]]) / (n + NEUTRAL)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket
    bias: float

    def logit(self, texts: list[bytes]) -> np.ndarray:
        out = [text_means(bag(texts[a:b]), self.weight) for a, b in chunks(texts)]
        return (np.concatenate(out) if out else np.zeros(0)) + self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(texts), -500, 500)))


def train(texts: list[bytes], label: np.ndarray, dim: int = 2, steps: int = 60, rate: float = 1.0, decay: float = 0.05, seed: int = 0, min_texts: int = 10) -> Model:
    """Full-batch Adam on the weighted cross entropy; classes weigh equally, the bias is set to the labels' odds at the end."""
    if len(set(label.tolist())) < 2:
        p = (label.sum() + 1) / (len(label) + 3)  # without any label under one half: nothing is rejected
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    doc, word, grams, size = [], [], [], []
    seen: dict[int, int] = {}
    for lo, hi in chunks(texts):
        b = bag(texts[lo:hi])
        doc.append(lo + np.repeat(np.arange(hi - lo), np.diff(b.first)))
        ids = np.empty(len(b.word), np.int64)
        for i, (h, s, e) in enumerate(zip(b.word.tolist(), b.start.tolist(), b.end.tolist(), strict=True)):
            k = seen.get(h)
            if k is None:
                k = seen[h] = len(seen)
                g = [x[s - 1 : e + 2 - n] for n, x in zip(GRAMS, b.buckets, strict=True) if e - s + 3 > n]
                g = np.concatenate(g).astype(np.int32)
                grams.append(g)
                size.append(len(g))
            ids[i] = k
        word.append(ids)
        del b  # arrays of a whole chunk, not needed while the next one is made or the steps run
    words = len(seen)
    del seen
    doc, word, grams, size = np.concatenate(doc), np.concatenate(word), np.concatenate(grams), np.array(size)
    pair, times = np.unique(doc * words + word, return_counts=True)
    doc, word = pair // words, pair % words
    del pair
    share = (times / (np.bincount(doc, times, len(texts)) + NEUTRAL)[doc]).astype(np.float32)
    del times
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    # Buckets of few training texts say nothing about others.
    texts_of = np.zeros(BUCKETS, np.int64)
    word_texts = np.bincount(word, minlength=len(size))
    np.add.at(texts_of, grams, word_texts[owner])
    rare = texts_of < min_texts
    part = (1 / size).astype(np.float32)[owner]
    first = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (dim, BUCKETS)).astype(np.float32)
    e[:, rare] = 0
    w = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    target = np.stack((1 - label, label), 1).astype(np.float32)
    odds = label.mean()
    weight = (np.where(label == 1, 0.5 / odds, 0.5 / (1 - odds)) / len(label)).astype(np.float32)[:, None]
    params = [e, w, bias]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        vec = np.stack([np.add.reduceat(x[grams], first) / size for x in e])  # dim x words
        mean = np.stack([np.bincount(doc, share * x[word], len(texts)) for x in vec])  # dim x texts
        z = mean.T @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - target) * weight
        dmean = w @ dz.T
        dvec = [np.bincount(word, share * x[doc], len(size)) for x in dmean]
        de = np.stack([np.bincount(grams, part * x[owner], BUCKETS) for x in dvec])
        for i, g in enumerate((de, mean @ dz, dz.sum(0))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            if i < 2:
                params[i] *= 1 - decay
            if i == 0:
                g[:, rare] = 0
            params[i] -= (rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.99**t)) + 1e-9)).astype(np.float32)
    return Model((w[:, 1] - w[:, 0]) @ e, float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: dict[int, int], modulus: int, residue: int) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a bounded sample of the rows whose crc32(doc_id) mod modulus is not residue, the same for any partitioning."""
    open_ = labels.where(f"doc_id is not null and {label} in (0, 1) and crc32(cast(doc_id as string)) % {modulus} <> {residue}")
    picked = None
    for value, n in sample.items():
        part = open_.where(F.col(label) == value).groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most sum(sample) ids: small enough to send to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.text or "").encode() for r in rows], np.array([r.label for r in rows], np.int64)


def _score(model: Model):
    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "score": pa.array(model.score(utf8(b.column(2))), pa.float64())})

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Model:
    """Train on rows of labels (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0; at most `sample` texts of each class reach the driver.

    Labels of one class alone give every text their odds; without any label every text scores 1/3, so nothing is rejected.
    """
    texts, label = labelled_sample(docs, labels, "toxic", sample, 5, 0)
    if len(set(label.tolist())) < 2:  # nothing to tell apart
        return train(texts, label)
    # Texts that a model has not seen set the bias: each of FOLDS parts of either class in turn.
    fold = np.empty(len(texts), np.int64)
    for value in (0, 1):
        fold[label == value] = np.arange((label == value).sum()) % FOLDS
    z = np.zeros(len(texts))
    for f in range(FOLDS):
        part = train([t for t, c in zip(texts, fold, strict=True) if c != f], label[fold != f])
        z[fold == f] = part.logit([t for t, c in zip(texts, fold, strict=True) if c == f])
    model = train(texts, label)
    share = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    odds = (1 - share) / share * (label == 1).sum() / (label == 0).sum()
    model.bias -= best_cut(z, label, odds)
    return model


def best_cut(z: np.ndarray, label: np.ndarray, negative_weight: float) -> float:
    """Middle between the two neighbouring values whose cut has the best F1, of the cuts that reject at most 1.2 times as many as are labelled."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(label[order])
    false = np.cumsum((label[order] == 0) * negative_weight)
    f1 = 2 * hit / (hit + false + label.sum())
    f1[hit + false > 1.2 * label.sum()] = 0
    i = int(np.argmax(f1))
    return float((z[order][i] + z[order][min(i + 1, len(z) - 1)]) / 2)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Texts of any length are scored whole.  A text without words, empty or null has the score of the bias alone.
    A null doc_id is not held out.  Rows that repeat are scored each; other columns are ignored.
    """
    session(docs.sparkSession)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model scores at 0.5 or more; all columns stay as they are."""
    session(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            for i in range(0, len(b), BATCH_ROWS):
                part = b.slice(i, BATCH_ROWS)
                yield part.filter(pa.array(model.score(utf8(part.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir):
    """The contract's query: every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
