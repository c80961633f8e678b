"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, operator by operator."""

import hashlib

from halogrid.llm import decontaminate, licenses, near_dup, packing, quality, secrets, suffix_dedup, toxicity, url_filters
from halogrid.llm.common import Scratch

LONG = "the quick brown fox jumps over lazy dogs " * 8000  # 328,000 letters
ROWS = [(None, "password=abcdefgh"), (None, None), (1, ""), (1, ""), (2, "same words here and there again"), (2, "same words here and there again"), (3, LONG), (4, LONG), (5, " \n\t"), (6, "é😀" * 30)]
SCHEMA = "doc_id long, text string, n_shingles long, spans string, score double, held_out string, `a.b` int, _spans int, mark long"


def odd(spark):
    return spark.createDataFrame([(d, t, 1, "x", 0.5, "y", 7, 8, 9) for d, t in ROWS], SCHEMA).repartition(3)


def by_id(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in rows))


IDS = sorted((d is None, d or 0) for d, _ in ROWS)


def test_one_row_for_each(spark):
    df, none = odd(spark), odd(spark).limit(0)
    for f in (secrets.secrets, licenses.scan_licenses, near_dup.near_duplicates, suffix_dedup.remove_repeats, lambda x: toxicity.toxicity(x, toxicity.train([b"a"], _zero())), lambda x: quality.quality(x, _stump())):
        assert by_id(f(df).collect()) == IDS
        assert f(none).collect() == []


def _zero():
    import numpy as np

    return np.zeros(1, np.int64)


def _stump():
    import numpy as np

    # Half of all scores are exactly one half.
    return quality.Trees(np.zeros((1, 1), np.int64), np.zeros((1, 1)), np.array([[0.0, 1.0]]), 0.0)


def test_scores_at_the_threshold_are_predicted(spark):
    rows = quality.quality(odd(spark), _stump()).collect()
    assert {r.predicted for r in rows} == {1} and 0.5 in {r.score for r in rows}
    scores = {r.score for r in toxicity.toxicity(odd(spark), toxicity.Model(__import__("numpy").zeros(toxicity.BUCKETS), 0.0)).collect()}
    assert scores == {0.5}


def test_secrets(spark):
    got = [r for r in secrets.secrets(odd(spark)).collect() if r.doc_id is None]
    assert sorted(r.n_assign for r in got) == [0, 1]
    out = secrets.redact(odd(spark))
    assert out.columns == odd(spark).columns
    assert {r.text for r in out.where("doc_id is null").collect()} == {"[SECRET]", None} and {r["a.b"] for r in out.select("`a.b`").collect()} == {7}


def test_near_duplicates(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd(spark), k=2).collect() if r.doc_id is not None}
    assert got[3] == (8, 3, True) and got[4] == (8, 3, False) and got[1] == (0, 1, True) and got[5] == (0, 5, True)


def test_repeats(spark):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd(spark)).collect()}
    period = len("the quick brown fox jumps over lazy dogs ")
    assert got[3].n_bytes == len(LONG) and got[3].n_removed == len(LONG) - period and got[4].n_removed == len(LONG) and got[4].n_spans == 1
    assert got[4].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[6].n_bytes == 180


def test_packing(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    ends = {}
    for r in rows:
        key = r.doc_id, r.ids_crc32 if r.doc_id in (None, 1, 2) else 0
        ends[key] = max(ends.get(key, 0), r.start + r.length)
    assert sum(1 for r in rows if r.doc_id == 1) == 2 and ends[3, 0] == ends[4, 0] > 2048
    assert packing.pack_documents(odd(spark).limit(0)).collect() == []


def test_leaks(spark):
    items = spark.createDataFrame([(1, "jumps over lazy dogs the quick brown"), (2, None), (3, ""), (4, "here and there"), (4, "here and there"), (None, "words here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd(spark), items).collect()}
    assert got >= {(3, 1), (4, 1), (2, 4), (2, None)} and not {g for g in got if g[0] in (1, 5)}
    assert decontaminate.leaks(odd(spark).limit(0), items).collect() == []
    assert decontaminate.leaks(odd(spark), items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(odd(spark), items.limit(0)).count() == len(ROWS)


def test_urls(spark):
    caps = [(1, "http://bad.org/" + "x" * 200_000, "2024-01-05"), (1, "http://bad.org/" + "x" * 200_000, "2024-01-05"), (None, "http://u:p@BAD.org./", "2024-01-05"), (2, "http://[::1]/", None), (3, "", "2024-01-05")]
    c = spark.createDataFrame([(*x, "n", "l") for x in caps], "capture_id long, url string, fetch_date string, names string, lists string")
    e = spark.createDataFrame([("l", "bad.org", "2024-01-01", "add"), ("l", "bad.org", "2024-01-01", "add")], "list_name string, key string, entry_date string, action string")
    got = url_filters.evaluate(c, e, Scratch(spark)).collect()
    assert sorted((str(r.capture_id), r.blocked, r.lists) for r in got) == [("1", True, "l"), ("1", True, "l"), ("2", False, ""), ("3", False, ""), ("None", True, "l")]
    assert all(not r.blocked for r in url_filters.evaluate(c, e.limit(0), Scratch(spark)).collect())
