"""Every stage of the pipeline, and the whole run, against plain Python versions, row by row."""

import zlib

import public_tokenizers
import pytest
from test_near_dup import brute as components
from test_secrets import brute as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline
from halogrid.llm.toxicity import toxicity_model

SF = "/root/testdata/sf0.001"
LONG = "Plain words about rivers and hills. " * 1500


def words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text or "").split()


def leaks(text, items, k=5):
    """Whether a window of some item's length has a weighted 5-word similarity of 0.8 with it."""
    w = words(text)
    for v in items:
        n = min(k, len(v))
        a = [tuple(v[i : i + n]) for i in range(len(v) - n + 1)] if v else []
        for p in range(max(1, len(w) - len(v) + 1)):
            x = w[p : p + len(v)]
            b = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
            if a and set(a) & set(b):
                both = sum(min(a.count(s), b.count(s)) for s in set(a))
                if both >= 0.8 * (len(a) + len(b) - both):
                    return True
    return False


def redacted(text):
    runs = []
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in secret_spans(text)[4].split(",") if x):
        if runs and runs[-1][1] >= s:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    out, at = "", 0
    for s, e in runs:
        out, at = out + text[at:s] + "[SECRET]", e
    return text if not runs else out + text[at:]


def pieces(rows):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            out.append((d, i // 2048, i, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    return sorted(out, key=str)


def composed(docs, model, benchmark):
    """What each stage keeps: lists of (doc_id, text)."""
    out = []
    rows = [(d, t) for d, t in docs if model.score([(t or "").encode()])[0] < 0.5]
    out.append(rows)
    group, seen, kept = components(rows, 5), set(), []
    for d, t in sorted(rows, key=lambda r: r[1] or ""):
        if d is None or group[d] == d and d not in seen:
            seen.add(d)
            kept.append((d, t))
    out.append(kept)
    items = [v for v in map(words, benchmark) if v]
    bad = {d for d, t in kept if d is not None and leaks(t, items)}
    out.append([(d, t) for d, t in kept if d not in bad])
    out.append([(d, redacted(t)) for d, t in out[-1]])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return docs, benchmark


def test_run_equals_the_composed_stages(spark, tables):
    docs, benchmark = tables
    model = toxicity_model(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = composed(docs, model, benchmark)
    assert all(len(b) <= len(a) for a, b in zip(want[:-1], want[1:], strict=True)) and len(want[2]) < len(want[1]) < len(docs)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == pieces(want[-1])
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert room.get(r.sequence_id, 0) == r.offset
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 2048


def test_stages_on_odd_rows(spark, tables):
    """Nulls in every column, empty and very long texts, repeated rows, a column with a clashing name; then no rows at all."""
    docs, benchmark = tables
    rows = [(d, t, "en", "s", len(t or ""), 1) for d, t in docs[:60]]
    rows += [(None, None, None, None, None, None), (None, "", "en", "s", 0, 1), (9001, None, None, None, None, None), (9002, "", "", "", 0, 0), (9003, "", "", "", 0, 0), (9004, LONG, "en", "s", 1, 1), (9005, LONG, "en", "s", 1, 1)]
    rows += [(9006, "the key: password=abcdefgh1234", "en", "s", 5, 1)] * 2 + [(9007, benchmark[0], "en", "s", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, _spans int")
    model = toxicity_model(df, spark.read.parquet(f"{SF}/labels.parquet"))
    want = composed([r[:2] for r in rows], model, benchmark)
    at, none = df, df.limit(0)
    for (name, stage), kept in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        at = spark.createDataFrame(stage(spark, at, SF).collect(), df.schema)
        none = stage(spark, none, SF)
        assert at.columns == df.columns and none.columns == df.columns and none.collect() == [], name
        assert sorted(((r.doc_id, r.text) for r in at.collect()), key=str) == sorted(kept, key=str), name
    got = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == pieces(want[-1])
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), SF).collect() == []


def test_run_with_empty_labels_and_benchmark(spark, tmp_path):
    """Without labels nothing is judged toxic, without items nothing is contaminated: only copies go."""
    docs = [(1, "a plain text of some words that nobody minds"), (2, "a plain text of some words that nobody minds"), (3, "another one"), (4, None)]
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    rows = {"documents": [(d, t, "en", "s", len(t or "")) for d, t in docs], "labels": [], "benchmark": []}
    for name, kind in kinds.items():
        spark.createDataFrame(rows[name], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces([docs[0], *docs[2:]])
