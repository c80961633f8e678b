"""Resampling against a plain version for several orders, odd rows; op13's SQL runs beside it."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from halogrid.llm import resampling

LOWER = str.maketrans(resampling.UPPER, resampling.LOWER)


def runs(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, orders, buckets, least, percent):
    code = lambda r: zlib.crc32(r.encode()) % buckets
    s, t = (Counter(code(r) for _, x in rows for r in runs(x, orders)[1]) for rows in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for d, x in docs:
        w, f = runs(x, orders)
        weight = math.floor(sum(gain(code(r)) for r in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{resampling.SEED}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


DOCS = [(i, " ".join(f"{'Word' if i % 3 else 'É日本'}{(i * j) % 11}," for j in range(i % 9))) for i in range(120)]
ODD = [(None, "Ab ab AB"), (None, None), (500, ""), (501, ".,!"), (501, ".,!"), (502, "one two three four"), (502, "one two three four"), (503, "long text " * 40_000), (504, "É é ß Z" * 9)]
TARGET = [(1, "word1 word2, word3"), (2, None), (3, "one two three"), (3, "one two three")]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_against_a_plain_version(spark, orders):
    docs, target = spark.createDataFrame(DOCS + ODD, "doc_id long, text string").repartition(3), spark.createDataFrame(TARGET, "item_id long, text string")
    got = [tuple(r) for r in resampling.resample(docs, target, orders, 50, 3, 30).collect()]
    assert sorted(got, key=str) == brute(DOCS + ODD, TARGET, orders, 50, 3, 30)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for n in ("documents", "benchmark"):
        c.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    got = resampling.op13_importance_resampling(spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == sorted(c.sql(resampling.ORACLE).fetchall())
    assert {t for _, t in got.dtypes} == {"bigint"}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d", 2, 3, 4)], "doc_id long, text string, row int, n int, bucket int")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert [r.n_features for r in resampling.resample(docs, target.limit(0), orders=2).collect()] == [7]
    assert [(r.weight, r["rank"]) for r in resampling.resample(docs.select("doc_id", docs.text.substr(1, 0).alias("text")), target).collect()] == [(0, None)]
    assert [r["rank"] for r in resampling.resample(docs, target, least_words=1, percent=100).collect()] == [1]
