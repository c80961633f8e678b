"""Quality: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, prefix_sums, session, shingles, span_hash, table, utf8, words
from .toxicity import labelled_sample

#: Labelled texts that training may see, of each class: the first by hash of doc_id.
SAMPLE = {0: 2000, 1: 4000}
FEATURES = (
    "bytes words word_length upper digit sign blank high line_count line_length distinct_words distinct_pairs repeated_lines longest_word "
    "stop_ends upper_words sign_runs next_equal top_word mean_gap"
).split()

_kinds = np.zeros((6, 256), np.float64)
_kinds[0, 65:91] = 1  # upper
_kinds[1, 48:58] = 1  # digit
_kinds[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1  # sign
_kinds[3, [9, 10, 11, 12, 13, 32]] = 1  # blank
_kinds[4, 128:] = 1  # bytes of other letters
_kinds[5, 10] = 1  # line ends


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    out = [_statistics(texts[a:b]) for a, b in chunks(texts)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _distinct(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and the largest count of one, in each group."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    top = np.zeros(n)
    np.maximum.at(top, g[at], runs)
    return np.bincount(g[at], minlength=n).astype(float), top


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    size = np.array([len(t) for t in texts], float)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(n + 1, np.int64)
    at[1:] = np.cumsum(size + 1)
    safe = np.maximum(size, 1)
    kinds = []
    for k in range(6):
        s = np.concatenate(([0.0], np.cumsum(_kinds[k][data])))
        kinds.append(s[at[1:] - 1] - s[at[:-1]])
    upper, digit, sign, blank, high, ends = kinds
    word, first, start, end = words(texts)
    count = np.diff(first)
    some = np.maximum(count, 1).astype(float)
    doc = np.repeat(np.arange(n), count)
    length = (end - start).astype(float)
    total = lambda x: np.bincount(doc, x, n) if len(doc) else np.zeros(n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, top = _distinct(word, doc, n)
    pair = shingles(word, 2)
    inside = doc[1:] == doc[:-1]
    pairs, _ = _distinct(pair[inside], doc[:-1][inside], n)
    next_equal = np.bincount(doc[:-1][inside & (word[1:] == word[:-1])], minlength=n)
    base = at[:-1][doc]
    last = data[base + end - 1]
    lead = data[base + start]
    second = data[np.minimum(base + start + 1, len(data) - 1)]
    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    full = line_end > line_start
    line = span_hash(prefix_sums(data), line_start[full], line_end[full])
    line_doc = np.searchsorted(at, line_start[full], "right") - 1
    lines, _ = _distinct(line, line_doc, n)
    line_count = np.bincount(line_doc, minlength=n).astype(float)
    signs = _kinds[2][data]
    runs = np.concatenate(([0.0], np.cumsum(np.append(0, signs[1:] * signs[:-1]))))
    return np.stack(
        [
            np.log1p(size), np.log1p(count), total(length) / some, upper / safe, digit / safe, sign / safe, blank / safe, high / safe,
            np.log1p(ends), safe / (line_count + 1), distinct / some, pairs / some, 1 - lines / np.maximum(line_count, 1), longest,
            total(_kinds[2][last]) / some, total(_kinds[0][lead] * _kinds[0][second]) / some, (runs[at[1:] - 1] - runs[at[:-1]]) / safe, next_equal / some, top / some, count / safe,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Trees of one depth as arrays: node i of a level goes to 2i or 2i + 1; leaves have the values."""

    feature: np.ndarray  # trees x (2**depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, weight: np.ndarray | None = None) -> Trees:
    """Boosting on the logistic loss: gradients and curvatures are summed in the bins of each feature, and the best bin edge splits a node."""
    w = np.ones(len(y)) if weight is None else weight
    p = (w[y == 1].sum() + 1) / (w.sum() + 2)
    base = float(np.log(p / (1 - p)))
    n, m = 2**depth - 1, x.shape[1]
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    z = np.full(len(y), base)
    features, cuts, leaves = [], [], []
    for _ in range(trees if len(set(y.tolist())) == 2 else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(n, np.int64), np.full(n, np.inf)
        for level in range(depth):
            width = 2**level
            best = np.full(width, 1e-9)
            for f in range(m):
                key = node * bins + code[:, f]
                gs, hs = (np.bincount(key, v, width * bins).reshape(width, bins).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[:, len(edges[f]) :] = 0
                at = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[i] = gain[i, at[i]]
                    feature[width - 1 + i], cut[width - 1 + i] = f, edges[f][at[i]]
            split = width - 1 + node
            node = 2 * node + (x[np.arange(len(y)), feature[split]] > cut[split])
        gs, hs = np.bincount(node, g, n + 1), np.bincount(node, h, n + 1)
        leaf = rate * gs / (hs + ridge)
        z += leaf[node]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features, np.int64).reshape(-1, n), np.array(cuts, float).reshape(-1, n), np.array(leaves, float).reshape(-1, n + 1), base)


def quality_model(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> Trees:
    """Train on rows of labels (doc_id, quality) whose crc32(doc_id) mod 3 is not 1; at most `sample` texts of each class reach the driver."""
    texts, y = labelled_sample(docs, labels, "quality", sample, 3, 1)
    share = labels.where("crc32(cast(doc_id as string)) % 3 <> 1").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    w = np.ones(len(y))
    if share and 0 < y.sum() < len(y):  # classes weigh as in the whole table
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return boost(statistics(texts), y, weight=w)


def _score(model: Trees):
    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "held_out": b.column(1), "score": pa.array(model.score(statistics(utf8(b.column(2)))), pa.float64())})

    return run


def quality(docs: DataFrame, model: Trees) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Texts of any length are measured whole; a null or empty text has statistics of 0.  A null doc_id is not held out.
    Rows that repeat are scored each; other columns are ignored.
    """
    session(docs.sparkSession)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark, sf_dir):
    """The contract's query: every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
