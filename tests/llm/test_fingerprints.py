"""Winnowing against a plain version, its guarantee of matches, odd rows."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from halogrid.llm import fingerprints
from halogrid.llm.common import table

M64 = (1 << 64) - 1


def picks(text, k, window, piece=fingerprints.PIECE):
    """(pos, hash) by sliding each window over the text's grams."""
    h = [xxhash.xxh64_intdigest(u.encode(), seed=42) for u in re.findall(rf"[^\x20\x09-\x0D]{{1,{piece}}}", text.lower())]
    if not h:
        return []
    if len(h) < k:
        return [(0, None)]
    grams = []
    for i in range(len(h) - k + 1):
        g = 0
        for x in h[i : i + k]:
            g = ((g << 1 | g >> 63) & M64) ^ x
        grams.append(g - (1 << 64) if g >> 63 else g)
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        w = range(i, min(i + window, len(grams)))
        at = min(w, key=lambda j: (grams[j] >> 32, -j))
        if not out or out[-1][0] != at:
            out.append((at, grams[at]))
    return out


def some_texts(n, seed=5):
    r = random.Random(seed)
    names = ["ab", "Cd", "é", "x" * 40, "ß", "日本語", "q", "ten", "w", " z"]
    return ["".join(r.choice(names) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.choice([0, 1, 3, 4, 7, 8, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize(("k", "window"), [(1, 1), (1, 3), (4, 4), (8, 2)])
def test_picks(spark, k, window):
    texts = [*some_texts(60), "same " * 50, "", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in fingerprints.fingerprint(df, k=k, window=window).collect():
        got = [(p.pos, p.hash) for p in r.prints]
        want = picks(texts[r.i], k, window)
        assert [(p, None if w is None else h) for (p, h), (_, w) in zip(got, want, strict=True)] == want
        assert r.__fields__ == ["i", "text", "prints"]


def test_ties_go_right(spark):
    df = spark.createDataFrame([("a a a a a a a a a a",)], "text string")
    assert [p.pos for p in fingerprints.fingerprint(df, k=1, window=4).first().prints] == [3, 4, 5, 6, 7, 8, 9]


def test_shared_runs_share_a_pick(spark):
    r = random.Random(3)
    new = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(80):
        run = new(fingerprints.K + fingerprints.WINDOW - 1)
        rows.append((i, f"{new(r.randrange(30))} {run} {new(r.randrange(30))}", f"{new(r.randrange(30))} {run} {new(r.randrange(30))}"))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = fingerprints.fingerprint(fingerprints.fingerprint(df, "a", "x"), "b", "y")
    assert df.where(F.expr(fingerprints.likeness("x", "y")) > 0).count() == 80


def brute(docs):
    """The rows of the operator in plain Python; docs by doc_id."""
    out = []
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        h = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest(), t, nxt, t[: len(t) - h] + nxt[:h]))
    return out


def near(a, b):
    x, y = ({h for _, h in picks(t, fingerprints.K, fingerprints.WINDOW)} for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_query(spark):
    got = {r.doc_id: r for r in fingerprints.op12_document_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted((r.doc_id, r.text or "") for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for d, n, sha, t, nxt, edited in brute(docs):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        if min(len(re.findall(r"[^\x20\x09-\x0D]{1,16}", x)) for x in (t, nxt, edited)) >= fingerprints.K:
            want = ["".join(f"{p}:{h & M64:x}") for p, h in picks(t, fingerprints.K, fingerprints.WINDOW)]
            assert r.fingerprint == ",".join(want)
            assert (r.near_edited, r.near_next) == (near(t, edited), near(t, nxt))
    assert sum(r.near_edited for r in got.values()) > 3 * sum(r.near_next for r in got.values())


def test_order_over_many_buckets(spark):
    rows = [(i * 3 % 1009, f"text {i * 3 % 1009} of the row") for i in range(1009)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.edited for r in fingerprints.edited_fingerprints(df).collect()}
    texts = dict(rows)
    assert got == {d: brute([(d, texts[d]), (0, texts[(d + 1) % 1009])])[0][5] for d in texts}


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "a b", 1), (1, "", 2), (1, "", 2), (2, "é😀" * 30, 3), (2, "é😀" * 30, 3), (3, "word " * 60_000, 4), (4, "x" * 300_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prints long").withColumn("next", F.lit(1)).withColumn("bucket", F.lit("b"))
    got = fingerprints.edited_fingerprints(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 0), (-1, 3), (1, 0), (1, 0), (2, 60), (2, 60), (3, 300_000), (4, 300_000)]
    assert [r.near_edited for r in got if r.n_chars == 0] == [1.0] * 3
    assert [r.near_edited for r in got if r.doc_id == 3] != [0.0]
    assert fingerprints.edited_fingerprints(df.limit(0)).collect() == []
    alone = fingerprints.edited_fingerprints(df.where("doc_id = 4")).collect()
    assert [(r.near_edited, r.near_next) for r in alone] == [(1.0, 1.0)]
