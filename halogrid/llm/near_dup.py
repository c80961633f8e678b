"""Near-duplicate documents: MinHash with tensored banding, exact verification, connected components.

Two small collections of half keys, each the combination of `rows` minima, give halves * halves table keys: key (i, j)
combines half i of the first with half j of the second.  Two texts whose shingle sets have Jaccard similarity s share a
key with probability (1 - (1 - s**rows)**halves)**2; at s = 0.8 the default of 2 x 12 halves of 2 rows misses one
link in 100,000, for 48 minima instead of the 576 that 144 separate keys of four rows would take.

Texts with equal shingle sets form a class, which enters the search once.  In each bucket every class is compared
with the bucket's smallest; the rest of the pairs need a look only where their ends are not yet in one component.
In a large bucket these are found by their differences from a reference r, the shingles that r lacks or that they lack.
r may be any set, so buckets with the same sets share one: each set prefers, of the smallest of its buckets, one that is
like it and that many sets know, and all buckets with the same smallest set take what most of their sets prefer.  Let u and v have m and d of them each, lacking and extra, and c in common.  Then u and v share |r| - m_u - m_v + c shingles of
|r| + d_u + d_v - c, so that similarity s takes c >= (m_u + m_v + s (d_u + d_v) - (1 - s) |r|) / (1 + s); with v not
linked to r this is above (m_u + s d_u) / (1 + s), and as v must make up what it lacks for a link to r itself, c is
also at least m_v + s d_v - (1 - s) |r| > 0.  So a link needs a common difference among the first few of each
in any one order of the differences (rarest first, to meet least often), and at places that leave room for c.  This
loses no link and collects no bucket.  The worst case is a bucket of m sets that share one of their rarest differences
and all else but just under the threshold: there the join by difference compares places of all m * m pairs, as any
join by shared elements does, but makes rows only of those that still may be links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunks, keep_ids, mix, session, shingles, table, utf8, words

_U = np.uint64
#: Shingle frequencies that order differences are kept in 2**CELL_BITS cells (4 MB), whatever the input's size.
CELL_BITS = 20


def shingle_set(word: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; fewer than k words are one shingle; no words, none."""
    if not len(word):
        return np.zeros(0, _U)
    if len(word) < k:
        return mix(shingles(word, len(word)) + _U(len(word)))
    return np.unique(shingles(word, k))


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    for a, b in chunks(texts):
        word, first, _, _ = words(texts[a:b])
        for s, e in zip(first[:-1], first[1:], strict=True):
            yield shingle_set(word[s:e], k)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """count minima of each non-empty set: a set's elements are mixed already, an odd factor gives each order."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.cumsum(sizes) - sizes
    factor = np.random.default_rng(20250).integers(0, 1 << 63, count, dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(sets), count), _U)
    for j, f in enumerate(factor):
        out[:, j] = np.minimum.reduceat(flat * f, at)
    return out


def half_keys(sets: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    m = minima(sets, 2 * halves * rows).reshape(len(sets), 2 * halves, rows)
    h = m[:, :, 0]
    for r in range(1, rows):
        h = mix(h * _U(0xD1342543DE82EF95) + m[:, :, r])
    return mix(h + np.arange(2 * halves, dtype=_U))


def _signatures(k: int, halves: int, rows: int):
    def run(batches):
        for b in batches:
            texts = utf8(b.column(1))
            sets = list(shingle_sets(texts, k))
            full = [s for s in sets if len(s)]
            keys = iter(half_keys(full, halves, rows).astype(np.int64) if full else [])
            yield pa.record_batch(
                {
                    "doc_id": b.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    "halves": pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                }
            )

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            sets = shingle_sets(utf8(b.column(1)), k)
            yield pa.record_batch({"node": b.column(0), "words": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _overlap(batches):
    for b in batches:
        inter, na, nb = [], [], []
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            inter.append(int((both[1:] == both[:-1]).sum()))
            na.append(len(x))
            nb.append(len(y))
        yield pa.record_batch({"u": b.column("u"), "v": b.column("v"), "inter": pa.array(inter, pa.int64()), "n_union": pa.array([p + q - i for p, q, i in zip(na, nb, inter, strict=True)], pa.int64())})


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    halves: int = 12,
    rows: int = 2,
    small_bucket: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A document's set: the distinct shingles of k white-space separated words of its A-Z-lower-cased text; with fewer
    words the whole sequence is its one shingle; a null, empty or blank text has none and is linked with nothing.
    Documents with 100 * intersection >= percent * union are linked; component_id is the smallest doc_id that links
    reach, kept says that it is the row's own.  Rows that repeat a doc_id count as one document in the graph (linked if
    one of its texts is); rows with a null doc_id stay outside it, with a null component_id, and are kept.
    Other columns, whatever their names, are ignored.  An empty table gives an empty result.
    """
    spark = session(docs.sparkSession)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = scratch.write(docs.mapInArrow(_signatures(k, halves, rows), "doc_id long, n_shingles long, digest binary, halves array<long>"))
    known = sig.where("n_shingles > 0 and doc_id is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    classes = scratch.write(
        known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves")).repartition(parts)
    )
    # A set smaller than this has no partner but an equal set: n / (n + 1) is below the threshold.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60
    key = F.expr(
        f"explode(flatten(transform(slice(halves, 1, {halves}), (a, i) -> transform(slice(halves, {halves + 1}, {halves}), (b, j) -> xxhash64(a, b, i * {halves} + j)))))"
    )
    keys = classes.where(F.col("n") >= least).select("node", "n", key.alias("key"))
    shared = scratch.write(keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("rep"), F.max("node").alias("last")).where("rep.node < last").select("key", "rep"))
    star = scratch.write(keys.join(shared, "key").select("key", "node", "n", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n")))
    scratch.drop(shared)
    links = _links(docs, star, k, percent, small_bucket, scratch)
    comp = classes.where("copies > 1").select("digest", "node")
    rows_ = sig.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    rows_ = rows_.join(comp, "digest", "left").withColumn("node", F.coalesce("node", "doc_id"))
    rows_ = rows_.join(links, "node", "left") if links is not None else rows_.withColumn("root", F.lit(None).cast("long"))
    found = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    return rows_.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _cells(batches):
    """Frequencies of the shingles, hashed to a fixed number of cells: (cell, n)."""
    n = np.zeros(1 << CELL_BITS, np.int64)
    for b in batches:
        flat = np.frombuffer(b"".join(b.column("words").to_pylist()), _U)
        n += np.bincount((flat >> _U(64 - CELL_BITS)).astype(np.int64), minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.record_batch({"cell": pa.array(at, pa.int64()), "n": pa.array(n[at], pa.int64())})


def _features(percent: int, frequency: np.ndarray):
    """The leading differences of a set (a) from its reference (b), in one order for all sets of the reference; at place -1, that the two are linked."""
    columns = ("rep", "node", "root", "n", "n_rep", "diffs", "w", "outside", "pos", "feature")

    def run(batches):
        for b in batches:
            out = {c: [] for c in columns}
            for rep, node, root, x, y in zip(*(b.column(c).to_pylist() for c in ("rep", "node", "root", "a", "b")), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                extra, lacks = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                often = [frequency[(z >> _U(64 - CELL_BITS)).astype(np.int64)] for z in (extra, lacks)]
                # Rare shingles first; then what is missing, first of all what the others have.
                extra, lacks = extra[np.lexsort((extra, often[0]))], lacks[np.lexsort((lacks, -often[1]))]
                diffs, w, free = len(extra) + len(lacks), 100 * len(lacks) + percent * len(extra), (100 - percent) * len(y)
                # A link takes so many differences in common: of a set outside with any other, of one linked to b with one outside.
                common = -(-(w - free) // 100) if w > free else -(-(w + 1) // (100 + percent))
                keep = diffs - common + 1
                feature = np.concatenate((extra << _U(1), lacks << _U(1) | _U(1)))[: max(0, keep)]
                # What only this set has is no common difference, but it keeps its place.
                place = np.flatnonzero(np.concatenate((np.sort(often[0]) > 1, np.ones(len(lacks), bool)))[: len(feature)])
                feature = feature[place]
                if w <= free and node != rep:
                    place, feature = np.append(place, -1), np.append(feature, _U(0))
                for c, value in zip(columns, (rep, node, root, len(x), len(y), diffs, w, w > free), strict=False):
                    out[c].append(np.full(len(feature), value, bool if c == "outside" else np.int64))
                out["pos"].append(place)
                out["feature"].append(feature.view(np.int64))
            yield pa.record_batch({c: pa.array(np.concatenate(v)) if v else pa.array([], pa.bool_() if c == "outside" else pa.int64()) for c, v in out.items()})

    return run


def _references(known: DataFrame, overlap: DataFrame) -> DataFrame:
    """(node, rep, root) of the sets that are compared by differences from a reference rep, once for all buckets that share it.

    known: (node, root, first) once for each set and each smallest set of its buckets, however many buckets the two share.
    A set prefers, of the smallest sets of its buckets, the one with the largest product of similarity (overlap: u, v,
    inter, n_union; 0 if not measured) and log of the number of sets that know it; the reference of all buckets with one
    smallest set is what most of their sets prefer, so that any two sets of a bucket have one in common.
    """
    often = known.groupBy("first").agg(F.count("*").alias("sets"))
    like = overlap.select(F.col("u").alias("node"), F.col("v").alias("first"), F.expr("inter / n_union").alias("like"))
    rated = known.join(often, "first").join(like, ["node", "first"], "left")
    liked = rated.groupBy("node").agg(F.max(F.struct((F.log2("sets") * F.coalesce("like", F.lit(0.0))).alias("x"), F.col("first").alias("r")))["r"].alias("liked"))
    known = known.join(liked, "node")
    votes = known.groupBy("first", "liked").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("first").agg(F.max(F.struct("n", "liked"))["liked"].alias("rep"))
    return known.join(chosen, "first").where("node <> rep").select("node", "rep", "root").distinct()


def _links(docs: DataFrame, star: DataFrame, k: int, percent: int, small_bucket: int, scratch: Scratch) -> DataFrame | None:
    """(node, root) of the classes that have links, or None."""
    from .components import connected_components

    good = f"100 * inter >= {percent} * n_union"
    fit = f"100 * least(un, vn) >= {percent} * greatest(un, vn)"
    involved = scratch.write(star.select("node").distinct())
    if involved.isEmpty():
        return None
    reps = keep_ids(docs.withColumnRenamed("doc_id", "node"), involved, "node").select("node", "text")
    sets = scratch.write(reps.mapInArrow(_sets(k), "node long, words binary").distinct())

    def with_words(pairs: DataFrame, u: str, v: str) -> DataFrame:
        return pairs.join(sets.select(F.col("node").alias(u), F.col("words").alias("a")), u).join(sets.select(F.col("node").alias(v), F.col("words").alias("b")), v)

    def measured(pairs: DataFrame) -> DataFrame:
        return scratch.write(with_words(pairs, "u", "v").select("u", "v", "a", "b").mapInArrow(_overlap, "u long, v long, inter long, n_union long"))

    spokes = star.where("node <> rep").select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("rep").alias("v"), F.col("rep_n").alias("vn"))
    overlap = measured(spokes.where(fit).select("u", "v").distinct())
    links = overlap.where(good).select("u", "v")
    comps = connected_components(links, scratch)
    star = scratch.write(_rooted(star.select("key", "node", "n", "rep"), comps))
    heads = star.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    heads = scratch.write(heads.where("lo < hi and members > 2").select("key", "members"))
    if heads.isEmpty():
        return comps
    star = scratch.write(star.join(heads, "key").where("node <> rep"))
    # Small buckets: the pairs whose ends are not yet in one component.
    side = star.where(F.col("members") <= small_bucket)
    u, v = (side.select("key", *(F.col(c).alias(x + y) for c, y in (("node", ""), ("n", "n"), ("root", "r")))) for x in "uv")
    pairs = u.join(v, "key").where(f"u < v and ur <> vr and {fit}").select("u", "v")
    known = scratch.write(star.where(F.col("members") > small_bucket).select("node", "root", F.col("rep").alias("first")).distinct())
    large = scratch.write(_references(known, overlap))
    if not large.isEmpty():
        nodes = scratch.write(large.select("node").distinct())
        cells = keep_ids(sets, nodes, "node").select("words").mapInArrow(_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        frequency = np.zeros(1 << CELL_BITS, np.int32)
        frequency[cells.column("cell").to_numpy()] = np.minimum(cells.column("n").to_numpy(), 1 << 30)
        schema = "rep long, node long, root long, n long, n_rep long, diffs long, w long, outside boolean, pos long, feature long"
        feature = scratch.write(with_words(large, "node", "rep").select("rep", "node", "root", "a", "b").mapInArrow(_features(percent, frequency), schema))
        own = feature.where("pos = -1").select(F.col("node").alias("u"), F.col("rep").alias("v"))
        feature = feature.where("pos >= 0")
        u, v = (feature.select("rep", "feature", "n_rep", *(F.col(c).alias(x + c) for c in ("node", "root", "n", "diffs", "w", "outside", "pos"))) for x in "uv")
        near = u.join(v.where("voutside").drop("n_rep"), ["rep", "feature"]).where("uroot <> vroot and (unode < vnode or not uoutside)").where(fit)
        near = near.where(f"{100 + percent} * least(udiffs - upos, vdiffs - vpos) >= uw + vw - {100 - percent} * n_rep")
        pairs = pairs.unionByName(near.select(F.col("unode").alias("u"), F.col("vnode").alias("v"))).unionByName(own)
    found = measured(pairs.distinct()).where(good).select("u", "v")
    return comps if found.isEmpty() else connected_components(links.unionByName(found), scratch)


def _rooted(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def drop_near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs with one row of each group: that of the component's smallest doc_id, all columns as they are.

    Of rows that repeat a doc_id one stays (the first by text, then by a hash of the row); rows with a null doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(near_duplicates(docs, k=k).where("doc_id is not null"))
    gone = scratch.write(found.where("not kept").select("doc_id").distinct())
    kept = keep_ids(docs, gone, "doc_id", "left_anti")
    again = scratch.write(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    # Only the rows of ids that repeat are moved.
    first = keep_ids(kept, again, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*kept.columns), F.struct("text", F.md5(F.to_json(F.struct(*kept.columns))))).alias("r")).select("r.*")
    return keep_ids(kept, again, "doc_id", "left_anti").unionByName(first)


def op8_minhash_near_dedup(spark, sf_dir):
    """The contract's query: 2-word shingles of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
