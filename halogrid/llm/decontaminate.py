"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Every window of a document that is as long as an item is fingerprinted by the signs of the sums of its shingles'
+1/-1 vectors; the sums of neighbouring windows come from prefix sums.  Only windows that could reach the similarity are
fingerprinted: those of whose shingles enough occur in items of that length, told by a bitmap of bounded size.
Fingerprints are cut into blocks, and a table of rows (length, block, value) lists the items whose block differs in at most
radius // blocks bits: by the pigeonhole principle no item within the radius is missed.  Windows join that table; pairs
within the radius are verified by the weighted similarity of the shingles (sum of minima over sum of maxima of their
counts).  Windows and items of equal shingles are one class each, so a passage that many documents share is compared once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, keep_ids, mix, session, shingles, table, utf8, words
from .suffix_dedup import BITMAP_BITS, _bitmap

_U = np.uint64
BITS, BLOCKS = 128, 16
#: Bits that the fingerprints of texts with weighted similarity 0.8 may differ in.  Their shingle vectors meet at an
#: angle of at most 27.3 degrees, so 19.4 of 128 bits differ on average with a deviation of 4.1; 40 is five deviations.
#: Two unrelated fingerprints differ in 64 bits with a deviation of 5.7, so the radius leaves out all but one in 100,000.
RADIUS = 40
#: Pairs of classes that may be broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 200_000
#: Windows of one Arrow batch.
BATCH_WINDOWS = 4096


def signs(shingle: np.ndarray) -> np.ndarray:
    """Each shingle's BITS signs, +1 or -1."""
    two = np.stack((mix(shingle + np.uint64(1)), mix(shingle ^ np.uint64(0xA5A5A5A5A5A5A5A5))), 1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as two longs each."""
    return np.packbits(sums > 0, axis=1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of the shingles' counts."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return least / (len(a) + len(b) - least)


def _keys(shingle: np.ndarray, tag: int) -> np.ndarray:
    """Bitmap keys: a shingle of some order (tag: the order), or of items of some length (tag: 2**32 + the length)."""
    return mix(shingle ^ mix(np.array([tag], _U)))


def _known(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return bitmap[keys >> _U(70 - BITMAP_BITS)] >> (keys >> _U(64 - BITMAP_BITS) & _U(63)) & _U(1) != 0


def _class(grams: list[bytes]) -> np.ndarray:
    """128-bit digests as two longs each."""
    return np.frombuffer(b"".join([hashlib.blake2b(g, digest_size=16).digest() for g in grams]), np.int64).reshape(-1, 2)


ITEM = "item_id long, n int, c1 long, c2 long, f1 long, f2 long, grams binary, keys array<long>"
WINDOW = "doc_id long, mark long, start_word int, n_words int, n int, c1 long, c2 long, f1 long, f2 long, grams binary"


def _items(k: int):
    """Items as rows: words, class, fingerprint, shingles and bitmap keys; items without a word give none."""

    def run(batches):
        for b in batches:
            texts, ids = utf8(b.column(1)), b.column(0).to_pylist()
            out = {"item_id": [], "n": [], "grams": [], "keys": []}
            f = []
            for i, t in zip(ids, texts, strict=True):
                word, *_ = words([t], signs=True)
                n = len(word)
                if n:
                    order = min(k, n)
                    x = shingles(word, order)
                    f.append(prints(signs(x).sum(0, keepdims=True))[0])
                    keys = np.concatenate((_keys(x, order), _keys(x, (1 << 32) + n)))
                    for key, v in zip(out, (i, n, x.tobytes(), np.unique(keys).view(np.int64)), strict=True):
                        out[key].append(v)
            c, f = _class(out["grams"]), np.array(f, np.int64).reshape(-1, 2)
            yield pa.record_batch(
                {
                    "item_id": pa.array(out["item_id"], pa.int64()),
                    "n": pa.array(out["n"], pa.int32()),
                    "c1": pa.array(c[:, 0]),
                    "c2": pa.array(c[:, 1]),
                    "f1": pa.array(f[:, 0]),
                    "f2": pa.array(f[:, 1]),
                    "grams": pa.array(out["grams"], pa.binary()),
                    "keys": pa.array(out["keys"], pa.list_(pa.int64())),
                }
            )

    return run


def _starts(mine: np.ndarray, y: np.ndarray, m: int, order: int, lengths: list[int], percent: int, bitmap: np.ndarray):
    """(length, shingles of a window, window starts) for one text of m shingles, of which those at `mine` (y) are known."""
    for n in lengths:
        w = n - order + 1
        width = min(w, m)  # a text of fewer words than the item is one window
        # c common of width + w shingles: c / (width + w - c) >= percent / 100.
        least = -(-percent * (width + w) // (100 + percent))
        if len(mine) < least or width < least:
            return  # longer items ask for more
        at = mine[_known(bitmap, _keys(y, (1 << 32) + n))]
        if len(at) < least:
            continue
        count = np.zeros(m + 1, np.int64)
        count[at + 1] = 1
        np.cumsum(count, out=count)
        start = np.flatnonzero(count[width:] - count[:-width] >= least)
        if len(start):
            yield n, width, start


def _windows(lengths: dict[int, list[int]], percent: int, bitmap: np.ndarray):
    """Windows of texts that could match an item, as rows."""

    def rows(docs, marks, texts):
        for lo, hi in chunks(texts):
            word, first, _, _ = words(texts[lo:hi], signs=True)
            for order, ns in lengths.items():
                x = shingles(word, order)
                place = np.flatnonzero(_known(bitmap, _keys(x, order)))
                a = np.searchsorted(place, first[:-1])
                b = np.searchsorted(place, first[1:] - order + 1)
                for d in np.flatnonzero(b > a).tolist():
                    s, size = int(first[d]), int(first[d + 1] - first[d])
                    mine = place[a[d] : b[d]]
                    for n, width, start in _starts(mine - s, x[mine], size - order + 1, order, ns, percent, bitmap):
                        for run in np.split(start, np.flatnonzero(np.diff(start) > 1) + 1):
                            for i in range(0, len(run), BATCH_WINDOWS):
                                part = run[i : i + BATCH_WINDOWS]
                                total = np.zeros((len(part) + width, BITS), np.int32)
                                np.cumsum(signs(x[s + part[0] : s + part[-1] + width]), axis=0, out=total[1:])
                                f = prints(total[width:] - total[:-width])
                                grams = [x[s + p : s + p + width].tobytes() for p in part.tolist()]
                                yield docs[lo + d], marks[lo + d], part, min(n, size), n, f, grams

    def batch(found):
        doc, mark, start, size, n, f, grams = zip(*found, strict=True)
        times = [len(s) for s in start]
        flat = [g for gs in grams for g in gs]
        c, f = _class(flat), np.concatenate(f)
        each = lambda v, kind: pa.array([x for x, t in zip(v, times, strict=True) for _ in range(t)], kind)
        names = ["doc_id", "mark", "start_word", "n_words", "n", "c1", "c2", "f1", "f2", "grams"]
        cols = [each(doc, pa.int64()), each(mark, pa.int64()), pa.array(np.concatenate(start).astype(np.int32)), each(size, pa.int32()), each(n, pa.int32())]
        cols += [pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(flat, pa.binary())]
        return pa.record_batch(cols, names)

    def run(batches):
        for b in batches:
            found, held = [], 0
            for row in rows(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                found.append(row)
                held += len(row[2])
                if held >= BATCH_WINDOWS:
                    yield batch(found)
                    found, held = [], 0
            if found:
                yield batch(found)

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            own = [np.frombuffer(g, _U) for g in b.column("grams").to_pylist()]
            item = [np.frombuffer(g, _U) for g in b.column("item_grams").to_pylist()]
            sim = np.array([similarity(x, y) for x, y in zip(own, item, strict=True)], float)
            keep = b.select(["n", "c1", "c2", "i1", "i2"]).append_column("similarity", pa.array(sim))
            yield keep.filter(pa.array(100 * sim >= percent - 1e-9))

    return run


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each class of equal shingles."""
    one = [F.first(c).alias(c) for c in ("f1", "f2", "grams")]
    return rows.groupBy("n", "c1", "c2").agg(*one)


def _blocks(value) -> F.Column:
    """(block, value) of a fingerprint f1, f2; value maps a block's byte to an array of values."""
    both = [(b, F.shiftrightunsigned(f, 8 * i).bitwiseAND(F.lit(255)).cast("int")) for f, b0 in (("f1", 0), ("f2", BLOCKS // 2)) for i, b in enumerate(range(b0, b0 + BLOCKS // 2))]
    return F.flatten(F.array(*[F.transform(value(v), lambda x, b=b: F.struct(F.lit(b).alias("block"), x.alias("value"))) for b, v in both]))


def near_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """n, c1, c2 of windows and i1, i2 of items of as many words whose fingerprints differ in at most radius bits."""
    masks = F.array(*[F.lit(m) for m in range(256) if bin(m).count("1") <= radius // BLOCKS])
    left = windows.select("n", "c1", "c2", "f1", "f2", F.explode(_blocks(lambda v: F.array(v))).alias("at")).select("*", "at.*").drop("at")
    right = items.select("n", F.col("c1").alias("i1"), F.col("c2").alias("i2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.explode(_blocks(lambda v: F.transform(masks, lambda m: m.bitwiseXOR(v)))).alias("at"))
    right = right.select("*", "at.*").drop("at")
    apart = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2")))
    return left.join(right, ["n", "block", "value"]).where(apart <= radius).select("n", "c1", "c2", "i1", "i2").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each item found in each row's text.

    Words are runs of letters, digits and bytes over 127, A-Z lower-cased.  A window matches an item of as many words
    if the weighted similarity of their k-word shingles is percent / 100 or more; an item of fewer than k words is one
    shingle, so it matches its exact words.  A text of fewer words than the item is one window, all of it.  Of equally
    similar windows the first counts.  Null and empty texts match nothing, nor do null or blank items; items with a null id
    are reported as one with a null id.  A null doc_id is reported as null; rows that repeat with their text are reported
    once, rows of one doc_id with different texts each.  Other columns are ignored.
    """
    spark = session(docs.sparkSession)
    scratch = Scratch(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = scratch.write(items.mapInArrow(_items(k), ITEM))
    # Distinct numbers of words: no more than the longest item has.
    lengths: dict[int, list[int]] = {}
    for n in sorted(r.n for r in items.select("n").distinct().collect()):
        lengths.setdefault(min(k, n), []).append(n)
    bitmap = _bitmap(items.select(F.explode("keys").alias("anchor")))
    windows = scratch.write(named.where("text is not null").mapInArrow(_windows(lengths, percent, bitmap), WINDOW))
    own, theirs = scratch.write(_classes(windows)), scratch.write(_classes(items))
    pairs = scratch.write(near_pairs(own, theirs))
    item_grams = theirs.select("n", F.col("c1").alias("i1"), F.col("c2").alias("i2"), F.col("grams").alias("item_grams"))
    both = pairs.join(own.select("n", "c1", "c2", "grams"), ["n", "c1", "c2"]).join(item_grams, ["n", "i1", "i2"])
    same = both.mapInArrow(_verify(percent), "n int, c1 long, c2 long, i1 long, i2 long, similarity double")
    ids = items.select("n", F.col("c1").alias("i1"), F.col("c2").alias("i2"), "item_id")
    same = scratch.write(same.join(ids, ["n", "i1", "i2"]).select("n", "c1", "c2", "item_id", "similarity"))
    scratch.drop(pairs, own, theirs, items)
    slim = windows.select("doc_id", "mark", "start_word", "n_words", "n", "c1", "c2")
    found = slim.join(F.broadcast(same) if same.count() <= BROADCAST_PAIRS else same, ["n", "c1", "c2"])
    best = F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word"))).alias("best")
    return found.groupBy("doc_id", "mark", "item_id").agg(best).select("doc_id", "item_id", "best.start_word", "best.n_words", "best.similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id holds a benchmark item; rows with a null doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    bad = scratch.write(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    return keep_ids(docs, bad, "doc_id", "left_anti")


def op7_benchmark_decontamination(spark, sf_dir):
    """Every whole text of documents against every item of benchmark: one row per document, with the items it holds.

    doc_id, n_items long, items (item ids, ascending), contaminated boolean.
    """
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # of one document
    found = Scratch(spark).write(found)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    return out.select("doc_id", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.size(items) > 0).alias("contaminated"))
