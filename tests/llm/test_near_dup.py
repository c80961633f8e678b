import random

from pyspark.sql import functions as F

from halogrid.llm.common import Scratch
from halogrid.llm.components import connected_components
from halogrid.llm.near_dup import drop_near_duplicates, near_duplicates


def sets(text, k):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k):
    """component of each doc_id by comparing all pairs; equal doc_ids are one node."""
    node = {d: d for d, _ in rows if d is not None}

    def find(x):
        while node[x] != x:
            x = node[x]
        return x

    s = [(d, sets(t, k)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                node[max(p, q)] = min(p, q)
    return {d: find(d) for d in node}


def make(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "A", "bé", "x1", "y", "zz", "and"]) if r.random() < 0.3 else "".join(r.choice("abcdef") for _ in range(4))
    base = [word() for _ in range(80)]
    rows = []
    for i in range(140):
        w = list(base)
        for _ in range(r.randint(0, 12)):
            w[r.randrange(80)] = word()
        if i % 4 == 0:
            w = [word() for _ in range(r.randint(0, 30))]
        if i % 9 == 0:
            w = ["the", "of", "the", "and", "b"][: r.randint(0, 5)]
        rows.append((i * 7 % 141, " \t".join(w).upper() if i % 3 == 0 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (204, "ONE"), (205, "one"), (0, rows[0][1]), (None, rows[0][1]), (206, "a b c d e"), (207, "a b c d e f"), (208, "a b c d e f")]
    r.shuffle(rows)
    return rows


def test_against_all_pairs(spark):
    for seed, k, small in ((2, 5, 8), (3, 2, 2), (4, 2, 0)):
        rows = make(seed)
        df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, node int, key string").repartition(3)
        got = near_duplicates(df, k=k, small_bucket=small).collect()
        want = brute(rows, k)
        assert len(got) == len(rows)
        for x in got:
            assert x.component_id == want.get(x.doc_id), (seed, x)
            assert x.kept == (x.doc_id is None or x.component_id == x.doc_id)
        n = sorted((str(x.doc_id), x.n_shingles) for x in got)
        assert n == sorted((str(d), len(sets(t, k))) for d, t in rows)


def test_drop(spark):
    rows = make(5)
    df = spark.createDataFrame([(d, t, "l") for d, t in rows], "doc_id long, text string, lang string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = [x.doc_id for x in out.collect() if x.doc_id is not None]
    assert sorted(kept) == sorted({d for d, c in brute(rows, 5).items() if d == c})


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (200, 200)] + [(300, i) for i in range(301, 320)]
    out = {x.node: x.root for x in connected_components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark)).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}, **{i: 300 for i in range(300, 320)}}
    assert connected_components(spark.createDataFrame([], "u long, v long").where(F.lit(True)), Scratch(spark)).collect() == []


def test_differences_lose_no_link():
    """Every link between two sets of which one is not linked to the representative shares a leading difference."""
    import numpy as np
    import pyarrow as pa

    from halogrid.llm import near_dup

    def linked(x, y, percent):
        both = len(np.intersect1d(x, y))
        return 100 * both >= percent * (len(x) + len(y) - both)

    for seed, percent in enumerate((80, 60, 90, 80, 80, 90)):
        r = np.random.default_rng(seed)
        new = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        every, pool = [np.unique(new(30))], new(20)
        for _ in range(100):
            x = every[r.integers(len(every)) if r.random() < 0.5 else 0]
            x = np.unique(np.concatenate((x[r.random(len(x)) > 0.1], r.choice(pool, r.integers(6)))))
            if len(x) > 5:
                every.append(x)
        frequency = np.bincount((np.concatenate(every) >> np.uint64(64 - near_dup.CELL_BITS)).astype(int), minlength=1 << near_dup.CELL_BITS)
        ids = pa.array(range(len(every)), pa.int64())
        words = pa.array([x.tobytes() for x in every])
        batch = pa.record_batch({"rep": pa.array([0] * len(every), pa.int64()), "node": ids, "root": ids, "a": words, "b": pa.array([every[0].tobytes()] * len(every))})
        t = next(near_dup._features(percent, frequency)([batch])).to_pandas()
        t = t.merge(t[t.outside], on="feature", suffixes=("u", "v"))
        t = t[(100 + percent) * np.minimum(t.diffsu - t.posu, t.diffsv - t.posv) >= t.wu + t.wv - (100 - percent) * t.n_repu]
        found = set(zip(t.nodeu, t.nodev, strict=True))
        links = {(u, v) for v, y in enumerate(every) if not linked(y, every[0], percent) for u, x in enumerate(every) if u and not np.array_equal(x, y) and linked(x, y, percent)}
        assert links and links <= found


def test_a_set_meets_a_smallest_set_once_for_all_their_buckets(spark, monkeypatch):
    """What reference to take is asked once for a set and a smallest set, not in each of the up to 144 buckets that they share."""
    from halogrid.llm import near_dup

    seen, choose = [], near_dup._references

    def counted(known, overlap):
        seen.append((known.count(), known.select("node").distinct().count()))
        return choose(known, overlap)

    monkeypatch.setattr(near_dup, "_references", counted)
    r = random.Random(100)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{r.randrange(9**6)}" if r.random() < 0.04 else w for w in base)) for i in range(100)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small_bucket=2).collect()
    assert {x.doc_id: x.component_id for x in got} == brute(rows, 5)
    ((rows_in, sets),) = seen
    assert sets > 90 and rows_in < 12 * sets
