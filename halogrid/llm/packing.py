"""Packing of tokenized documents into sequences by bin completion.

Piece lengths are whole numbers up to the capacity, so the corpus is packed as a histogram of at most `capacity`
entries, whatever its size: a filling that is found once is used as often as the counts allow.  Documents then get
their sequence by their rank among the pieces of equal length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, chunks, prefix_sums, session, span_hash, table, utf8

CAPACITY = 2048
#: Parts of words whose ids a Python worker remembers, about 150 bytes each.
CACHE_WORDS = 1_000_000

#: Character classes of Latin-1, lower-cased: white space, letters, digits and number signs, all others.
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)
_class = np.full(256, _SIGN, np.uint8)
_class[[*range(9, 14), 0x20, 0x85, 0xA0]] = _BLANK
_class[[*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_class[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, *range(0xBC, 0xBF)]] = _DIGIT


def split_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts that the tokenizer encodes by themselves, in lower-cased Latin-1 bytes that end in white space.

    Letters together, single digits, other signs together; a sign run that is one apostrophe takes s, t, re, ve, m, ll or d along.
    """
    c = _class[data]
    edge = np.ones(len(c), bool)
    edge[1:] = (c[1:] != c[:-1]) | (c[1:] == _DIGIT)
    a = np.flatnonzero((data[:-1] == 39) & edge[:-1] & (c[1:] == _LETTER))
    if len(a):
        x, y = data[a + 1], data[np.minimum(a + 2, len(data) - 1)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (x == 114) & (y == 101) | (x == 118) & (y == 101) | (x == 108) & (y == 108)
        for hit, n in ((one, 2), (two, 3)):
            at = a[hit]
            edge[at + 1] = False
            edge[(at + n)[c[at + n] != _BLANK]] = True
    at = np.flatnonzero(edge)
    part = c[at] != _BLANK
    return at[part], np.append(at[1:], len(c))[part]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one element of each value, and each element's index among them; sorts values and places in one word, which is fast."""
    bits = np.uint64(max(1, len(x)).bit_length())
    key = np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (key[1:] >> bits) != (key[:-1] >> bits)
    y = x[place]
    if (~new[1:] & (y[1:] != y[:-1])).any():  # values that differ in the low bits alone
        _, at, which = np.unique(x, return_index=True, return_inverse=True)
        return at, which
    which = np.empty(len(x), np.int64)
    which[place] = np.cumsum(new) - 1
    return place[new], which


class WordIds:
    """Ids of texts, with what the tokenizer said of each part kept for later texts.

    The tokenizer lower-cases, splits and then encodes every part by itself, so a text's ids are its parts' ids.  The
    split is repeated here, in numpy, for Latin-1 text, where it needs no Unicode tables; other texts go to the
    tokenizer whole, and so do texts that may hold one of its special tokens.  New parts are encoded together; a
    part's last token is the one that ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # a part's hash: its number
        self.flat = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def simple(self, text: str) -> bytes | None:
        """The text lower-cased in Latin-1, if it is such a text after composition."""
        if "<|" in text and any(s in text for s in self.special):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        try:
            return text.lower().encode("latin-1")
        except UnicodeEncodeError:
            return None

    def learn(self, parts: list[str], hashes: list[int]) -> None:
        lines = [" ".join(parts[i : i + 200]) for i in range(0, len(parts), 200)]
        got = [e.ids for e in self.tokenizer.encode_batch(lines, add_special_tokens=False)]
        ids = np.array([i for x in got for i in x], np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            raise RuntimeError("the tokenizer split a part")
        n = len(self.known)
        self.known.update(zip(hashes, range(n, n + len(parts)), strict=True))
        self.first = np.concatenate((self.first, ends + len(self.flat)))
        self.flat = np.concatenate((self.flat, ids))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids and the closing 0."""
        low = [self.simple(t) for t in texts]
        data = np.frombuffer(b"".join([x + b"\n" for x in low if x is not None]), np.uint8)
        out = iter(self._simple_ids(data, [len(x) + 1 for x in low if x is not None]))
        whole = lambda t: np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, 0], np.uint32)
        return [whole(t) if x is None else next(out) for t, x in zip(texts, low, strict=True)]

    def _simple_ids(self, data: np.ndarray, lens: list[int]) -> list[np.ndarray]:
        if not lens:
            return []
        start, end = split_parts(data)
        hashes = np.empty(len(start), np.uint64)
        for lo in range(0, len(start), 16384):  # steps that stay in the CPU cache
            s, e = start[lo : lo + 16384], end[lo : lo + 16384]
            hashes[lo : lo + 16384] = span_hash(prefix_sums(data[s[0] : e[-1]]), s - s[0], e - s[0])
        at, which = distinct(hashes)
        keys = hashes[at].tolist()
        if len(self.known) + len(keys) > CACHE_WORDS:
            self.forget()
        number = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(number) if x is None]
        if new:
            raw = data.tobytes()
            n = len(self.known)
            self.learn([raw[s:e].decode("latin-1") for s, e in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)], [keys[i] for i in new])
            for x, i in enumerate(new, n):
                number[i] = x
        number = np.array(number, np.int64)[which]
        count = self.first[number + 1] - self.first[number]
        doc_end = np.cumsum(lens)
        doc = np.searchsorted(doc_end, start, "right")
        begin = np.cumsum(count) - count + doc  # a closing 0 after every document
        total = np.bincount(doc, weights=count, minlength=len(lens)).astype(np.int64) + 1
        flat = np.zeros(total.sum(), np.uint32)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        flat[np.repeat(begin, count) + step] = self.flat[np.repeat(self.first[number], count) + step]
        return np.split(flat, np.cumsum(total)[:-1])


_ids: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        ids = _ids.get(path) or _ids.setdefault(path, WordIds(path))
        for b in batches:
            texts = utf8(b.column(1))
            for lo, hi in chunks(texts, 2 << 20):
                rows = []
                for d, x in zip(b.column(0)[lo:hi].to_pylist(), ids.ids([t.decode() for t in texts[lo:hi]]), strict=True):
                    x = x.astype("<u4", copy=False)
                    rows.extend((d, i // capacity, i, min(len(x) - i, capacity), zlib.crc32(x[i : i + capacity])) for i in range(0, len(x), capacity))
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# --- the packing itself, on a histogram -------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (filling, times)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rest: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room == 0:
            done.append((filling, times))
            return
        if room not in open_:
            open_[room] = []
            insort(rest, room)
        open_[room].append((filling, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            i = bisect_left(rest, size)
            if i < len(rest):
                room = rest[i]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rest[i]
            else:
                room, filling, times = capacity, (), n
            q = min(room // size, n)
            use = min(times, n // q)
            put(room - q * size, (*filling, *[size] * q), use)
            n -= use * q
            if times > use and filling:
                put(room, filling, times - use)
    return done + [x for xs in open_.values() for x in xs]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's second bound: sizes over half stand alone, what fits nowhere beside them is waste."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for k in [0, *(s for s in sizes if 2 * s <= capacity)]:
        n1 = sum(counts[s] for s in sizes if s > capacity - k)
        mid = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        n2 = sum(counts[s] for s in mid)
        small = sum(s * counts[s] for s in sizes if k <= s and 2 * s <= capacity)
        room = n2 * capacity - sum(s * counts[s] for s in mid)
        best = max(best, n1 + n2 + max(0, -(-(small - room) // capacity)))
    return best


#: Steps of the search (sizes tried for a filling), its only limit: some ten seconds on the driver.
STEPS = 5_000_000


class _Enough(Exception):
    """The steps are used up."""


def reachable(sizes: list[int], capacity: int) -> list[int]:
    """For each of the ascending sizes, as bits, the sums up to capacity of it and smaller ones, any number of each."""
    out, bits, mask = [], 1, (1 << capacity + 1) - 1
    for s in sizes:
        by = s
        while by <= capacity:
            bits |= bits << by & mask
            by *= 2
        out.append(bits)
    return out


def fillings(sizes: list[int], sums: list[int], left: dict[int, int], top: int, capacity: int, spare: Callable[[], int], after: tuple[int, ...] | None, spend: Callable[[], None]) -> Iterator[tuple[int, ...]]:
    """All undominated fillings around one piece of size top, one at a time: least waste first, then larger sizes first.

    A filling is dominated if another piece fits beside it, if one of its sizes can be exchanged for a larger one that
    still fits, or two together for a single one as large or larger.  What dominates comes earlier in the order.  Only
    fillings behind `after` are listed, and none that waste more than spare() at that time.
    """
    chosen: dict[int, int] = {}

    def free(low: int, high: int) -> bool:
        k = bisect_right(sizes, high) - 1
        while k >= 0 and sizes[k] >= low:
            if left[sizes[k]] > chosen.get(sizes[k], 0) + (sizes[k] == top):
                return True
            k -= 1
        return False

    def go(rest: int, j: int, waste: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            if not free(1, waste):
                yield (top, *(s for s, n in chosen.items() for _ in range(n)))
            return
        j = min(j, bisect_right(sizes, rest) - 1)
        while j >= 0 and sums[j] >> rest & 1:
            s = sizes[j]
            spend()
            most = min(left[s] - (s == top), rest // s)
            # Sizes over s are settled, so these exchanges are known now.
            if most > 0 and not free(s + 1, s + waste) and not any(free(s + x, s + x + waste) for x in chosen):
                if most > 1 and free(2 * s, 2 * s + waste):
                    most = 1
                below = sums[j - 1] if j else 1
                for n in range(most, 0, -1):
                    if below >> rest - n * s & 1:
                        chosen[s] = n
                        yield from go(rest - n * s, j - 1, waste)
                        del chosen[s]
            j -= 1

    room = capacity - top
    for waste in range(0 if after is None else capacity - sum(after), room + 1):
        if waste > spare():
            return
        spend()
        for f in go(room - waste, len(sizes) - 1, waste):
            if after is None or waste > capacity - sum(after) or f < after:
                yield f


@dataclass
class Packing:
    """Fillings and how often each is used; how many bins these are, how many any packing needs, whether fewer are ruled out."""

    plan: list[tuple[tuple[int, ...], int]]
    bins: int
    bound: int
    optimal: bool


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """Branch and bound over completions of the largest size left, on a histogram {size: count}.

    The incumbent starts as best-fit decreasing and is replaced by every better solution, best fit of what a branch leaves
    among them; a branch ends where its bins and the bound on the rest (their sum, with the waste so far) cannot beat the
    incumbent.  A node has every undominated filling as a branch, used as often as the counts allow, and then less and
    less often; bins of one largest size come in the order of fillings(), so none is met twice.  The tree is whole: the
    result is optimal if the bound is met or the tree ends within `steps`, which is its only limit.
    """
    left = {s: n for s, n in counts.items() if n}
    best = best_fit(left, capacity)
    used = sum(t for _, t in best)
    bound = lower_bound(left, capacity) if left else 0
    sizes = sorted(left)
    sums = reachable(sizes, capacity) if used > bound else []
    total = sum(s * n for s, n in left.items())
    bins = waste = seen = spent = 0

    def spend() -> None:
        nonlocal spent
        spent += 1
        if spent > steps:
            raise _Enough

    def spare() -> int:
        """Waste that a better solution may still have."""
        return (used - 1) * capacity - total - waste

    def branches(top: int, after: tuple[int, ...] | None) -> Iterator[tuple[tuple[int, ...], int]]:
        for f in fillings(sizes, sums, left, top, capacity, spare, after, spend):
            for times in range(min(left[s] // n for s, n in Counter(f).items()), 0, -1):
                if times * (capacity - sum(f)) <= spare():
                    yield f, times

    # A level: its branches not yet tried, and the one that is taken.
    stack: list[list] = [[branches(sizes[-1], None), None]] if used > bound else []

    def take(f: tuple[int, ...], times: int) -> None:
        nonlocal bins, waste
        for s, n in Counter(f).items():
            left[s] -= times * n
        bins += times
        waste += times * (capacity - sum(f))

    try:
        while stack and used > bound:
            level = stack[-1]
            if level[1]:
                take(level[1][0], -level[1][1])
                level[1] = None
            spend()
            level[1] = next(level[0], None)
            if level[1] is None:
                stack.pop()
                continue
            f, times = level[1]
            take(f, times)
            seen += 1
            rest = {s: left[s] for s in sizes if left[s]}
            if not rest or seen % 64 == 1:
                ending = best_fit(rest, capacity)
                if bins + sum(t for _, t in ending) < used:
                    used = bins + sum(t for _, t in ending)
                    best = [x for _, x in stack] + ending
            if rest and spare() >= 0:
                stack.append([branches(max(rest), f if left[f[0]] else None), None])
    except _Enough:
        return Packing(best, used, bound, False)
    return Packing(best, used, bound, True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """Add sequence_id and offset to written pieces with a column length (1 to capacity): as few sequences as the search finds.

    The driver holds the histogram of lengths, at most capacity entries, and the fillings.  Pieces of one length are
    numbered by salted ranks with prefix offsets, so a length that very many pieces share is not one task.
    """
    spark = pieces.sparkSession
    scratch = scratch or Scratch(spark)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = bin_completion(counts, capacity).plan
    slots, base, taken = [], 0, Counter()
    for filling, times in plan:
        offset = 0
        for s, n in sorted(Counter(filling).items(), reverse=True):
            slots.append((s, taken[s], n, base, offset))
            taken[s] += n * times
            offset += n * s
        base += times
    bad = {s for s in counts if taken[s] != counts[s]}
    if bad:
        raise RuntimeError(f"the packing does not cover lengths {sorted(bad)[:5]}")
    # From first on, ranks of this length fill `each` places a sequence, starting at offset.
    schema = "length long, first long, each long, base long, at long"
    slots_df = spark.createDataFrame(slots, schema).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "each", "base", "at"))).alias("slots"))
    salts = max(32, sum(counts.values()) // 100_000)
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))
    salted = pieces.withColumn("salt", salt)
    cells = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n"))
    cells = cells.join(F.broadcast(slots_df), "length").select("length", "salt", "before", "slots")
    # A cell's ranks run from before on; only the slots that they reach are carried along.
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("within", within).join(cells, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    slot = F.expr("element_at(slots, aggregate(slots, 0, (n, s) -> n + if(s.first <= rank, 1, 0)))")
    ranked = ranked.withColumn("slot", slot)
    i = F.col("rank") - F.col("slot.first")
    return ranked.select(
        *[c for c in pieces.columns],
        (F.col("slot.base") + F.floor(i / F.col("slot.each")).cast("long")).alias("sequence_id"),
        (F.col("slot.at") + (i % F.col("slot.each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 0 (a null or empty text: id 0 alone); only documents over capacity are cut, into
    pieces of capacity ids and a last one.  No sequence exceeds capacity; places in a sequence have no gaps.  Null and
    repeated doc_ids are packed like any others.  Other columns are ignored; an empty table gives no rows.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(session(docs.sparkSession))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.write(docs.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    return pack(pieces, capacity, scratch)


def op2_best_fit_packing(spark, sf_dir):
    """The contract's query: documents in sequences of 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
