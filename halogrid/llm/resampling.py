"""Importance resampling towards a target: hashed n-gram bags of a corpus and a target, and Gumbel-top-k draws.

A position table holds each word with its document and place.  For every order above one, window lead() per document brings the
words that follow, and each run is joined by spaces and hashed to a bucket.  Counts per bucket, BUCKETS rows at most, give
each bucket's gain; the gains are joined to the runs and averaged for each document.  Words alone (orders=1) need no
following words, so no window and no shuffle of the position table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from halogrid.operators.ranks import ordered_index

from .common import Scratch, table

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
#: Words of a text: letters A-Z, a-z, digits and all characters beyond ASCII; A-Z are lower-cased afterwards.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, pos, word: a row for each word of the whole text, A-Z lower-cased; a text without words has one row with nulls."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))
    p = docs.select(*keys, F.posexplode_outer(words).alias("pos", "word"))
    # In a word of ASCII letters lower() changes A-Z alone.
    word = F.when(F.octet_length("word") == F.char_length("word"), F.lower("word")).otherwise(F.translate("word", UPPER, LOWER))
    return p.withColumn("word", word)


def features(docs: DataFrame, *keys: str, orders: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """keys, n, bucket: a row for each run of n = 1 to `orders` consecutive words of a text, repeats included.

    The first of the keys tells the rows of docs apart.  A text without words has one row whose bucket is null.
    """
    p = positions(docs, *keys, text=text)
    if orders == 1:
        return p.select(*keys, F.lit(1).alias("n"), (F.crc32("word") % buckets).cast("int").alias("bucket"))
    w = W.partitionBy(keys[0]).orderBy("pos")
    p = p.withColumns({f"_next{n}": F.lead("word", n).over(w) for n in range(1, orders)})
    # concat() is null where a following word is missing.
    runs = [F.concat("word", *[x for i in range(1, n) for x in (F.lit(" "), f"_next{i}")]) for n in range(1, orders + 1)]
    p = p.select(*keys, F.posexplode(F.array(*runs)).alias("n", "run")).where("run is not null or n = 0")
    return p.select(*keys, (F.col("n") + 1).alias("n"), (F.crc32("run") % buckets).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket that a feature fills: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).

    s and t are the bucket's features in docs and target, S and T all of theirs.
    """

    def counts(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("row"), "text")
        return features(rows, "row", orders=orders, buckets=buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    # From here on, a row for each bucket.
    both = counts(docs, "s").join(counts(target, "t"), "bucket", "full").na.fill(0, ["s", "t"])
    all_ = W.partitionBy(F.lit(0))
    s, t, s_all, t_all = (x.cast("double") for x in (F.col("s"), F.col("t"), F.sum("s").over(all_), F.sum("t").over(all_)))
    return both.select("bucket", F.floor(1000 * F.ln((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).alias("gain"))


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs, all long; rank is null for rows that are not drawn.

    weight is the floored mean of the gains of a row's features (0 without any), score adds Gumbel noise from a hash of the
    seed and doc_id.  Of the rows of at least least_words words, floor(percent * rows / 100) with the highest scores are drawn, ties to
    the smaller doc_id; null ids come first among ties and hash like an empty id.  Null and empty texts have no features.
    Rows that repeat an id have the same noise and a rank each.
    """
    scratch = Scratch(docs.sparkSession)
    gain = scratch.write(gains(docs, target, orders, buckets))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = features(rows, "row", "doc_id", orders=orders, buckets=buckets).join(F.broadcast(gain), "bucket", "left")  # `buckets` rows at most
    found = found.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.count_if(F.expr("n = 1 and bucket is not null")).alias("n_words"), F.sum("gain").alias("total"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    scored = scratch.write(found.withColumn("weight", weight).withColumn("score", F.col("weight") + noise))
    may, rest = scored.where(F.col("n_words") >= least_words), scored.where(F.col("n_words") < least_words)
    drawn = percent * may.count() // 100
    # Bounds of the order hold the row's number too, so that ties and repeated ids are dealt out.
    ranked = ordered_index(may.withColumn("down", -F.col("score")), ["down", "doc_id", "row"]).withColumn("rank", F.when(F.col("_index") < drawn, F.col("_index") + 1))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*out))


def op13_importance_resampling(spark, sf_dir):
    """The contract's query: a tenth of documents towards benchmark, by words."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * strlen(w)), lambda i: case when i % 8 = 0 then ('0x' || substr(hex(encode(w)), (2 * (i // 8) + 1)::bigint, 2))::bigint else 0 end)),
  lambda c, v: case when xor(c, v) & 1 = 1 then xor(xor(c, v) >> 1, 3988292384) else xor(c, v) >> 1 end)"""
ORACLE = f"""
WITH dw AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
code AS (SELECT w, xor({_CRC}, 4294967295) % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN code USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN code USING (w) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((SELECT count(*) FROM dw)::double + {BUCKETS}) / ((coalesce(s, 0)::double + 1) * ((SELECT count(*) FROM tw)::double + {BUCKETS}))))::bigint AS gain
  FROM s FULL JOIN t USING (bucket)),
each AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::double / count(*))::bigint AS weight FROM dw JOIN code USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint::double + 0.5) / 4294967296)))::bigint AS score
  FROM documents d LEFT JOIN each USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * {PERCENT} // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
