"""Document fingerprints with DataFrame functions only: winnowing of rolling hashes of k words.

Units are words of the lower-cased text, the runs between white space; runs of over PIECE characters count as pieces of
that many, so that texts without spaces have units too.  A gram is K units.  Its hash is the cyclic polynomial of
its units' hashes, rolled by doubling: the hash of 2m units is that of the first m, rotated by m, xor that of the m
after them, so every partial hash serves all the grams that hold it, and K units take log2(K) passes.  Each window of WINDOW
grams picks its least hash, the rightmost one of equals; a place that several windows pick counts once, and is kept with
the hash.  Two texts that share K + WINDOW - 1 units in a row share a pick.

Characters as units would need some 5 microseconds each in these functions, several times the budget; words stay in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halogrid.operators.ranks import ordered_buckets

from .common import table

#: Units of a gram (a power of two), grams of a window, characters of a piece.
K, WINDOW, PIECE = 4, 4, 16
#: Buckets of the order of documents for each shuffle partition.
FINER = 8


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value, which is worked out once (columns for the steps would be inlined when a filter is pushed down)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def picked(text: str, k: int = K, window: int = WINDOW, piece: int = PIECE) -> str:
    """SQL: array of (pos, hash), the picked grams of a text by place; pos is the gram's first unit, counted from 0.

    A text of fewer than k units is one gram, one of fewer than `window` grams one window; a null text, and one without
    units, has no picks.  k is a power of two.
    """
    if k < 1 or k & (k - 1):
        raise ValueError("k must be a power of two")
    place = "cast(2147483647 - (q & 4294967295) as int)"
    out = f"transform(picks, q -> named_struct('pos', {place}, 'hash', grams[{place}]))"
    others = ", ".join(["x", *(f"packed[i + {j}]" for j in range(1, window))])
    least = f"transform(slice(packed, 1, size(packed) - {window - 1}), (x, i) -> least({others}))" if window > 1 else "packed"
    out = _let("picks", f"array_distinct(case when size(packed) >= {window} then {least} when size(packed) > 0 then array(array_min(packed)) else packed end)", out)
    # The upper half of the hash and, falling, the place: the least of these is the least hash, the rightmost of equals.
    out = _let("packed", "transform(grams, (h, i) -> (h & -4294967296) | (2147483647 - i))", out)
    out = _let("grams", f"case when size(u1) >= {k} then u{k} when size(u1) > 0 then array(xxhash64(u1)) else u1 end", out)
    m = k
    while m > 1:
        m //= 2
        rotated = f"(shiftleft(h, {m}) | shiftrightunsigned(h, {64 - m}))"
        out = _let(f"u{2 * m}", f"if(size(u1) < {k}, u1, transform(slice(u{m}, 1, size(u{m}) - {m}), (h, i) -> {rotated} ^ u{m}[i + {m}]))", out)
    units = rf"regexp_extract_all(lower(coalesce({text}, '')), '[^\\x20\\x09-\\x0D]{{1,{piece}}}', 0)"
    return _let("u1", f"transform({units}, u -> xxhash64(u))", out)


def fingerprint(df: DataFrame, text: str = "text", out: str = "prints", k: int = K, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """df with a column out, the picks of text; see picked()."""
    return df.withColumn(out, F.expr(picked(f"`{text}`", k, window, piece)))


def likeness(a: str, b: str) -> str:
    """SQL: shared hashes over all hashes of two fingerprints; 1 if both are empty."""
    x, y = f"transform({a}, p -> p.hash)", f"transform({b}, p -> p.hash)"
    return f"if(size({a}) = 0 and size({b}) = 0, 1D, size(array_intersect({x}, {y})) / size(array_union({x}, {y})))"


def written(prints: str) -> str:
    """SQL: a fingerprint as text, pos:hash by place."""
    return f"array_join(transform({prints}, p -> concat(p.pos, ':', lower(hex(p.hash)))), ',')"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket and the order's columns, each bucket with a copy (`copy`) of the row that follows it.

    The order is by doc_id, then by a hash of the text; null ids come first.  Buckets of the order come from a sample's bounds,
    and the first row of the next bucket (of the first one after the last) comes along, so that no window spans all rows.
    Rows that are equal in doc_id and text share a bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ordered_buckets(rows.withColumn("tie", F.xxhash64("text")), ["doc_id", "tie"], out="bucket", finer=FINER)
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("first"))  # a row for each bucket
    before = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy()))
    first = first.withColumn("before", before)
    rows = rows.join(F.broadcast(first), "bucket")  # as many rows as bounds, 65,537 at most
    at = "if(struct(doc_id, tie) <=> first, array(named_struct('bucket', bucket, 'copy', false), named_struct('bucket', before, 'copy', true)), array(named_struct('bucket', bucket, 'copy', false)))"
    return rows.select("doc_id", "text", "tie", F.inline(F.expr(at)))


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited, prints, edited_prints, near_edited, near_next of each row of docs.

    edited is the text whose last floor(n_chars / 2) code points are replaced by the first as many of the next text by
    doc_id (all, if it is shorter; the first text follows the last).  A null text is empty.  Rows that repeat an id give a row
    each, in the order of a hash of their texts; a lone row follows itself.
    """
    rows = fingerprint(with_next(docs).repartition("bucket"), k=k, window=window)
    order = W.partitionBy("bucket").orderBy("copy", "doc_id", "tie")
    rows = rows.withColumn("next", F.lead(F.struct("text", "prints")).over(order)).where(~F.col("copy"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(substr(text, 1, cast(n_chars as int) - {half}), substr(next.text, 1, {half}))"))
    rows = fingerprint(rows, "edited", "edited_prints", k=k, window=window)
    near = [F.expr(likeness("prints", b)).alias(n) for n, b in (("near_edited", "edited_prints"), ("near_next", "next.prints"))]
    return rows.select("doc_id", "n_chars", "edited", "prints", "edited_prints", *near)


def op12_document_fingerprints(spark, sf_dir):
    """The contract's query: every whole text of documents and its edited text."""
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(written("prints")).alias("fingerprint"),
        F.expr(written("edited_prints")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
