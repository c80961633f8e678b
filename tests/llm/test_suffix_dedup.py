import hashlib
import random

import numpy as np
import pytest

from halogrid.llm.suffix_dedup import LAST, Suffixes, remove_repeats, repeated


def brute(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by looking up every string."""
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k, w = b[i : i + width], (LAST if d is None else d, i)
            seen[k] = min(seen.get(k, w), w)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] < (LAST if d is None else d, i):
                gone[i] += 1
                gone[i + width] -= 1
        g = np.cumsum(gone[:-1]) > 0
        spans = int((g[1:] & ~g[:-1]).sum() + (len(g) > 0 and g[0]))
        out.append((d, len(b), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return out


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(150)
    passage = text(30)
    rows = [(0, base), (1, base), (2, base[:300] + "X" + base[301:]), (3, None), (4, ""), (5, "a" * 400), (6, "ab" * 220), (7, "a" * 99), (8, "a" * 100)]
    for i in range(9, 40):
        t = text(r.randint(5, 60))
        if r.random() < 0.6:
            at = r.randint(0, 40)
            t += passage[at : at + r.randint(60, 200)] + text(r.randint(0, 20))
        if r.random() < 0.3:
            t = base[r.randint(0, 200) :][: r.randint(90, 500)] + " " + t
        rows.append((i * 3 % 41 + 100, t))
    rows += [(None, base[50:400]), (0, base), (5, "zz" + base[10:250])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 1)])
def test_against_brute_force(spark, seed, hot):
    rows = make(seed)
    df = spark.createDataFrame([(d, t, "x", t) for d, t in rows], "doc_id long, text string, lang string, doc string").repartition(4)
    got = [tuple(x)[:5] for x in remove_repeats(df, sort_contexts=hot).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, 100)))


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(12)]
    s = Suffixes(strings, 40)
    at = np.concatenate([s.base[i] + np.arange(21) for i in range(12)])
    group = np.repeat(np.arange(3), 84)
    order = s.sort(at, group)
    data = b"".join(strings)
    for g in range(3):
        part = [data[at[i] : at[i] + 40] for i in order[g * 84 : g * 84 + 84]]
        assert part == sorted(part)
        assert sorted(order[g * 84 : g * 84 + 84]) == list(range(g * 84, g * 84 + 84))


def test_words_that_defeat_the_fast_hash():
    """Two words of 1024 letters, swaps of each other, agree modulo 2**64: the prime tells them apart, and so their order is right."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    one, two = word.encode(), word.translate(str.maketrans("ab", "ba")).encode()
    s = Suffixes([b"x" + one, b"x" + two], 1024)
    assert s.common(np.array([0, 1]), np.array([1025, 1026])).tolist() == [1, 0]


def test_hash_collisions_are_not_repeats(monkeypatch):
    """If every comparison said that windows are equal, the bytes would still tell the different ones apart."""
    r = random.Random(3)
    parts = [bytes(r.choice(b"abc") for _ in range(60)) for _ in range(4)]
    contexts = [*parts, parts[2]]
    monkeypatch.setattr(Suffixes, "common", lambda self, x, y: np.full(len(x), self.width))
    five = np.arange(5)
    flags = repeated(contexts, np.zeros(5, np.int64), np.full(5, 20), np.full(5, 21), five, np.zeros(5, np.int64), 40)
    assert flags.reshape(5, 21)[:4].sum() == 0


@pytest.mark.parametrize("bits", [8, 27])
def test_a_full_bitmap_changes_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr("halogrid.llm.suffix_dedup.BITMAP_BITS", bits)
    rows = make(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x)[:5] for x in remove_repeats(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, 100)))
