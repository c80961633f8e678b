"""Removal of repeated passages by suffix order with hash comparison.

Every 100-byte window picks one anchor: of its grams of GRAM bytes the one with the least hash (the rightmost of equal
ones).  Equal windows pick equal anchors at equal places, so a window can only repeat one that has the same anchor, and
the windows of one anchor place are one run of starts, its context.  Anchors that occur once in the corpus drop out, at
first those that a bitmap of bounded size does not know.
Equal whole contexts, told by 128-bit BLAKE2b digests of their bytes, are settled by an aggregate of their smallest
occurrence.  Where an anchor has several different contexts, their suffixes are sorted: a mergesort whose comparisons
find the common extension of two suffixes by binary search over prefix polynomial hashes; runs of suffixes with a common
extension of a whole window are verified byte by byte.  The windows of anchors with very many different contexts are
grouped by their bytes themselves, an aggregate that no group, however large, brings together in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, keep_ids, mix, powers, prefix_residues, session, table, utf8, wrapping_sums

_U = np.uint64
GRAM = 32
#: Contexts of one anchor that one task sorts; anchors with more are settled window by window.
SORT_CONTEXTS = 2000
#: Contexts, of several anchors, in one sorting task.
BUCKET_CONTEXTS = 2000
#: Bits of the bitmap of recurring anchors: 16 MB at any size of the input.
BITMAP_BITS = 27
#: Order of a null doc_id: after all others.
LAST = (1 << 63) - 1


def anchors(texts: list[bytes], width: int = 100, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each context: its text's index, anchor hash, first window start, number of windows."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(lens) - lens
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none.astype(_U), none, none
    sums = wrapping_sums(data)
    n = len(data) - gram + 1
    h = sums[gram:] - sums[:-gram]
    h *= powers(len(data))[1][:n]
    h = mix(h)
    low, have, want = h, 1, width - gram + 1
    while have * 2 <= want:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if want > have:
        low = np.minimum(low[: have - want], low[want - have :])
    # Windows that stay inside one text.
    ok = np.zeros(len(low) + 1, np.int8)
    long = lens >= width
    np.add.at(ok, base[long], 1)
    np.add.at(ok, (base + lens - width + 1)[long], -1)
    start = np.flatnonzero(np.cumsum(ok[:-1]))
    if not len(start):
        return none, none.astype(_U), none, none
    least = low[start]
    # A context ends where the anchor's place changes: it leaves the window, or a gram as low or lower comes in.
    new = h[start + want - 1] == least
    new[0] = True
    new[1:] |= (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    at = start[first]
    doc = np.searchsorted(base, at, "right") - 1
    while (lens[doc] == 0).any():  # empty texts share a base with the next
        doc = np.where(lens[doc] == 0, doc - 1, doc)
    return doc, least[first], at - base[doc], count


def _anchor_counts(width: int):
    def run(batches):
        for b in batches:
            texts = utf8(b.column(0))
            for lo, hi in chunks(texts):
                a, n = np.unique(anchors(texts[lo:hi], width)[1], return_counts=True)
                yield pa.record_batch({"anchor": pa.array(a.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def _bitmap(anchors_: DataFrame) -> np.ndarray:
    """Bitmap of these anchors by their leading BITMAP_BITS bits: 2**(BITMAP_BITS - 6) words, at most, reach the driver."""
    word = F.shiftrightunsigned("anchor", 70 - BITMAP_BITS).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - BITMAP_BITS}) & 63 as int))")
    t = anchors_.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return out.view(_U)


def _anchor_rows(width: int, bitmap: np.ndarray):
    def run(batches):
        for b in batches:
            texts = utf8(b.column(2))
            doc, mark = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(texts):
                i, anchor, start, count = anchors(texts[lo:hi], width)
                known = bitmap[anchor >> _U(70 - BITMAP_BITS)] >> (anchor >> _U(64 - BITMAP_BITS) & _U(63)) & _U(1) != 0
                i, anchor, start, count = lo + i[known], anchor[known], start[known], count[known]
                ends = (start + count + width - 1).tolist()
                digest = b"".join([hashlib.blake2b(texts[j][s:e], digest_size=16).digest() for j, s, e in zip(i.tolist(), start.tolist(), ends, strict=True)])
                digest = np.frombuffer(digest, np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    {
                        "anchor": pa.array(anchor.astype(np.int64)),
                        "context": pa.array(digest[:, 0]),
                        "digest": pa.array(digest[:, 1]),
                        "doc": pa.array(doc[i]),
                        "mark": pa.array(mark[i]),
                        "start": pa.array(start.astype(np.int32)),
                        "count": pa.array(count.astype(np.int32)),
                    }
                )

    return run


class Suffixes:
    """Some strings and their prefix hashes; common(x, y) is the length, up to width, that suffixes share."""

    def __init__(self, strings: list[bytes], width: int):
        self.width = width
        lens = np.array([len(s) for s in strings], np.int64)
        self.base = np.cumsum(lens) - lens
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sums, self.inverse = wrapping_sums(self.data), powers(len(self.data) + 1)[1]
        self.residues, self.prime, self.root = prefix_residues(self.data)

    def _extension(self, x: np.ndarray, y: np.ndarray, same) -> np.ndarray:
        """Longest length, by binary search, at which same(length, rows) holds."""
        n = np.zeros(len(x), np.int64)
        step = 1 << (self.width.bit_length() - 1)
        while step:
            longer = n + step
            inside = longer <= self.width
            n = np.where(inside & same(np.where(inside, longer, 0)), longer, n)
            step >>= 1
        return n

    def _prime(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.residues[x + n] + self.prime - self.residues[x]) * self.root[x] % self.prime

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        sx, sy, bx, by = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        n = self._extension(x, y, lambda m: (self.sums[x + m] - sx) * bx == (self.sums[y + m] - sy) * by)
        # Strings that the fast modulus cannot tell apart differ in the prime one.
        bad = np.flatnonzero(self._prime(x, n) != self._prime(y, n))
        if len(bad):
            u, v = x[bad], y[bad]
            n[bad] = self._extension(u, v, lambda m: self._prime(u, m) == self._prime(v, m))
        return n

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """x's suffix sorts before y's; equal ones do not."""
        n = self.common(x, y)
        differ = n < self.width
        n = np.minimum(n, self.width - 1)
        return differ & (self.data[x + n] < self.data[y + n])

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether whole windows are equal, looking at the bytes."""
        if len(self.data) < self.width:
            return np.zeros(len(x), bool)
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.width)
        out = np.empty(len(x), bool)
        for i in range(0, len(x), 50_000):
            out[i : i + 50_000] = (windows[x[i : i + 50_000]] == windows[y[i : i + 50_000]]).all(axis=1)
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at these places inside each group (group numbers ascend): stable mergesort, all groups and blocks at once."""
        order = np.arange(len(at))
        first = np.searchsorted(group, group)  # place of each group's first element
        size = np.searchsorted(group, group, "right") - first
        place = np.arange(len(at)) - first
        block = 1
        while block < size.max(initial=0):
            mine = (place // block) * block
            pair = (mine ^ block) if block else mine
            left = (mine & block) == 0
            lo = np.minimum(pair, size)
            top = np.minimum(pair + block, size)
            start, hi = lo.copy(), top.copy()
            x = at[order]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                other = x[first[open_] + mid]
                # Elements of the left block go before equal ones of the right block.
                go = np.where(left[open_], self.less(other, x[open_]), ~self.less(x[open_], other))
                lo[open_] = np.where(go, mid + 1, lo[open_])
                hi[open_] = np.where(go, hi[open_], mid)
            target = first + np.minimum(mine, pair) + (place - mine) + (lo - start)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            block *= 2
        return order


def repeated(contexts: list[bytes], anchor: np.ndarray, back: np.ndarray, count: np.ndarray, doc: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Windows of the contexts that also start earlier, as one flag for each window, context after context.

    back: bytes from a context's first window to its anchor.  Only windows of one anchor and equal distance from it are compared.
    """
    s = Suffixes(contexts, width)
    which = np.repeat(np.arange(len(count)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, when = s.base[which] + offset, start[which] + offset
    near = back[which] - offset
    order = np.lexsort((near, anchor[which]))
    a, b = anchor[which][order], near[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new)
    order = order[s.sort(at[order], group)]
    x = at[order]
    same = np.zeros(len(order), bool)
    same[1:] = (group[1:] == group[:-1]) & (s.common(x[1:], x[:-1]) == width)
    i = np.flatnonzero(same)
    same[i] = s.equal_bytes(x[i], x[i - 1])
    run = np.cumsum(~same)
    by = np.lexsort((when[order], doc[which][order], run))
    r, d, w = run[by], doc[which][order][by], when[order][by]
    head = np.ones(len(by), bool)
    head[1:] = r[1:] != r[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
    out = np.empty(len(by), bool)
    out[order[by]] = (d != d[lead]) | (w != w[lead])
    return out


def _runs(flag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last of the runs of set flags with one key."""
    edge = np.ones(len(flag) + 1, bool)
    edge[1:-1] = (flag[1:] != flag[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(edge)
    keep = flag[at[:-1]]
    return at[:-1][keep], at[1:][keep]


def _sort_bucket(width: int):
    def run(table_: pa.Table) -> pa.Table:
        t = table_.combine_chunks()
        num = lambda c: t.column(c).to_numpy()
        doc, mark, start, count = num("doc"), num("mark"), num("start").astype(np.int64), num("count").astype(np.int64)
        flag = repeated([bytes(x) for x in t.column("bytes").to_pylist()], num("anchor"), num("back").astype(np.int64), count, doc, start, width)
        which = np.repeat(np.arange(len(count)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        a, b = _runs(flag, which)
        i = which[a]
        lo = (start[i] + offset[a]).astype(np.int32)
        return pa.table({"doc": doc[i], "mark": mark[i], "lo": lo, "hi": (lo + (b - a) + width - 1).astype(np.int32)})

    return run


def _cut(width: int, whole: bool):
    """Bytes of contexts (whole) or of each of their windows, of documents with their lists of places."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("anchor", "doc", "mark", "start", "count", "back", "bytes")}
            for t, d, m, places in zip(utf8(b.column("text")), b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("places").to_pylist(), strict=True):
                for p in places:
                    s, c = p["start"], p["count"]
                    if whole:
                        part = t[s : s + c + width - 1]
                        rows = [(s, c, _back(part, c, width), part)]
                    else:
                        rows = [(x, 1, 0, t[x : x + width]) for x in range(s, s + c)]
                    for row in rows:
                        for key, v in zip(out, (p["anchor"], d, m, *row), strict=True):
                            out[key].append(v)
            kinds = {"anchor": pa.int64(), "doc": pa.int64(), "mark": pa.int64(), "bytes": pa.binary()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items()})

    return run


def _back(part: bytes, count: int, width: int) -> int:
    """Where the anchor stands in a context: the rightmost least gram of its first window."""
    sums = wrapping_sums(np.frombuffer(part[:width], np.uint8))
    n = width - GRAM + 1
    h = mix((sums[GRAM:] - sums[:-GRAM]) * powers(width)[1][:n])
    return int(n - 1 - np.argmin(h[::-1]))


def _remove(batches):
    for b in batches:
        texts = utf8(b.column("text"))
        removed, spans, sha = [], [], []
        for t, lo, hi in zip(texts, b.column("lo").to_pylist(), b.column("hi").to_pylist(), strict=True):
            runs = merged(lo or [], hi or [])
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(t[at:s])
                at = e
            kept.update(t[at:])
            removed.append(sum(e - s for s, e in runs))
            spans.append(runs)
            sha.append(kept.hexdigest())
        yield pa.record_batch(
            {
                "doc_id": b.column("doc_id"),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(r) for r in spans], pa.int64()),
                "kept_sha256": pa.array(sha, pa.string()),
                "spans": pa.array([[{"start": s, "end": e} for s, e in r] for r in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        )


def merged(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(lo, hi, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", sort_contexts: int = SORT_CONTEXTS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    A text is its UTF-8 bytes, a null text none.  A byte is removed if a width-byte string that covers it also starts
    earlier: in a document with a smaller doc_id, or earlier in its own; overlapping strings count, and strings are
    judged on the input.  Strings do not cross documents; texts shorter than width keep every byte.  A null doc_id
    comes after all others.  Rows that repeat a doc_id are one document whose texts lie over each other: a string at
    the same place is not an earlier one, so equal repeated rows get equal results.  Other columns are ignored.
    """
    if width <= GRAM:
        raise ValueError(f"width must be over {GRAM}")
    spark = session(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("mark", F.xxhash64("text"))
    long = F.octet_length("text") >= width
    counts = docs.where(long).select("text").mapInArrow(_anchor_counts(width), "anchor long, n long")
    often = scratch.write(counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    scratch.release()
    rows = named.where(long).select("doc", "mark", "text").mapInArrow(_anchor_rows(width, _bitmap(often)), "anchor long, context long, digest long, doc long, mark long, start int, count int")
    rows = scratch.write(rows.join(often, "anchor", "left_semi"))
    scratch.drop(often)
    scratch.release()
    same = ["anchor", "context", "digest"]
    least = scratch.write(rows.groupBy(*same).agg(F.min(F.struct("doc", "start", "mark", "count")).alias("least")))
    # The other occurrences: later ones, and those at the same place of another row of a repeated doc_id.
    later = "doc > least.doc or doc = least.doc and start > least.start"
    other = rows.join(least, same).where(f"{later} or mark <> least.mark").select("anchor", "doc", "mark", "start", "count", F.expr(later).alias("later"))
    other = scratch.write(other)
    scratch.drop(rows)
    scratch.release()
    whole = other.where("later").select("doc", "mark", F.col("start").alias("lo"), F.expr(f"start + count + {width - 1}").alias("hi"))
    # One occurrence of each context stands for all: what repeats in it repeats in the others too.
    kinds = least.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    first = least.select("anchor", "least.doc", "least.mark", "least.start", "least.count")
    open_ = scratch.write(first.unionByName(other.where("not later").drop("later")).join(kinds, "anchor"))
    scratch.drop(least)
    place = F.struct("anchor", "start", "count")
    cols = "anchor long, doc long, mark long, start int, count int, back int, bytes binary"
    found = [whole]
    for hot in (False, True):
        part = open_.where(F.col("kinds") > sort_contexts if hot else F.col("kinds") <= sort_contexts)
        if part.isEmpty():
            continue
        lists = part.groupBy("doc", "mark").agg(F.collect_list(place).alias("places"))  # of one document
        # Only texts of documents that have such contexts are moved.
        ids = scratch.write(part.select("doc").distinct())
        cut = keep_ids(named.where(long), ids, "doc").join(lists, ["doc", "mark"]).select("doc", "mark", "text", "places").mapInArrow(_cut(width, not hot), cols)
        if not hot:
            parts = max(64, part.count() // BUCKET_CONTEXTS)
            cut = cut.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(parts)))
            found.append(cut.groupBy("bucket").applyInArrow(_sort_bucket(width), "doc long, mark long, lo int, hi int"))
        else:
            # The windows' hashes leave out what does not repeat; what is left is grouped by its bytes.
            cut = cut.select(F.xxhash64("bytes").alias("hash"), "bytes", "doc", "mark", "start")
            again = scratch.write(cut.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
            cut = scratch.write(cut.join(again, "hash", "left_semi").drop("hash"))
            first = scratch.write(cut.groupBy("bytes").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
            found.append(cut.join(first, "bytes").where(later).select("doc", "mark", F.col("start").alias("lo"), F.expr(f"start + {width}").alias("hi")))
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.unionByName(f)
    ranges = scratch.write(ranges.groupBy("doc", "mark").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))  # of one document
    scratch.release()
    scratch.drop(other, open_)
    ids = scratch.write(ranges.select("doc").distinct())
    kind = "array<struct<start:int,end:int>>"
    cut = keep_ids(named, ids, "doc").join(ranges, ["doc", "mark"], "left").select("doc_id", "text", "lo", "hi")
    cut = cut.mapInArrow(_remove, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {kind}")
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    whole = keep_ids(named, ids, "doc", "left_anti").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"), F.array().cast(kind).alias("spans")
    )
    return cut.unionByName(whole)


def op10_suffix_array_dedup(spark, sf_dir):
    """The contract's query: 100-byte strings of documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
