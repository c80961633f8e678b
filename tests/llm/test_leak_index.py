"""The index of the decontamination: its radius and its block table against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from halogrid.llm import decontaminate as dec


def test_radius_holds_what_is_similar():
    """5000 pairs of similarity 0.8 exactly, the hardest that must be found, all lie within the radius; unrelated ones do not."""
    r = np.random.default_rng(4)
    far = []
    for i in range(5000):
        w = int(r.integers(1, 6)) * 9  # 8 of 9 shingles in common: 8 / 10
        own = r.integers(0, 1 << 63, w + w // 9).astype(np.uint64)
        a, b = own[:w], own[w // 9 :]
        assert abs(dec.similarity(a, b) - 0.8) < 1e-12
        fa, fb = (dec.prints(dec.signs(x).sum(0, keepdims=True)).view(np.uint8) for x in (a, b))
        far.append(int(np.unpackbits(fa ^ fb).sum()))
    assert max(far) <= dec.RADIUS
    x = r.integers(0, 256, (4000, 16), dtype=np.uint8)
    assert (np.unpackbits(x[:2000] ^ x[2000:], axis=1).sum(1) <= dec.RADIUS).mean() <= 0.001


def test_block_table_equals_all_pairs(spark):
    r = np.random.default_rng(5)
    windows = r.integers(0, 256, (60, 16), dtype=np.uint8)
    items = windows[r.integers(0, 60, 80)].copy()
    for x in items:  # 0 to 60 bits are turned
        for bit in r.choice(128, int(r.integers(0, 61)), replace=False):
            x[bit // 8] ^= 1 << (bit % 8)
    rows = lambda f: [(int(i % 3), i, 0, int(p[0]), int(p[1])) for i, p in enumerate(f.view(np.int64))]
    kind = "n int, c1 long, c2 long, f1 long, f2 long"
    got = dec.near_pairs(spark.createDataFrame(rows(windows), kind), spark.createDataFrame(rows(items), kind))
    want = {(i, j) for i, x in enumerate(windows) for j, y in enumerate(items) if i % 3 == j % 3 and np.unpackbits(x ^ y).sum() <= dec.RADIUS}
    assert {(p.c1, p.i1) for p in got.collect()} == want and len(want) >= 5
    assert got.groupBy("c1", "i1").count().where(F.col("count") > 1).isEmpty()


def test_long_text_of_items_and_equal_rows(spark):
    """A text that repeats an item many times, and rows that repeat: one row for each document and item, with the first place."""
    item = " ".join(f"w{i}" for i in range(50))
    docs = [(1, f"{item} x " * 300), (2, f"a b {item}"), (2, f"a b {item}"), (None, item), (3, f"w1 {'w2 ' * 50}"), (4, "one"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (None, "one"), (9, None), (10, "...")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.start_word, r.n_words, r.similarity) for r in dec.leaks(df, items).collect())
    assert got == sorted([(d, i, s, 50, 1.0) for d, s in (("1", 0), ("2", 2), ("None", 0)) for i in ("7", "8")] + [("4", "None", 0, 1, 1.0)])
