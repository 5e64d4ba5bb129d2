"""Near-duplicates by the exact Jaccard similarity of word shingles, for the pipeline.

Two texts are linked if the sets of their distinct SIZE-word shingles (lower-cased) have a similarity of at least 4/5. Texts of
equal sets are one class. Candidates come from BANDS bands of BAND_ROWS minima of hashed sets: a pair of similarity 0.8 meets in a bucket
but for 6 in a million. Every candidate is verified on the whole sets.

1. In each bucket all members are compared with its first leader, the one that shares buckets with most others. A large family is
   linked through its most typical members, so that pairs don't grow with the square of a family.
2. Where a bucket still holds several components, each member outside the bucket's largest one is compared with the bucket's
   first LEADERS members of other components.
3. Where it still holds several, those outside are compared with all members of the other components. A pair is taken in the first
   bucket that it shares.

In steps 2 and 3 the join itself keeps only pairs that can be similar, so that its rows are about the links that it finds, however many members
fall short of 0.8: sizes and minima must allow the similarity (of two sets of similarity 0.8, fewer than LEAST_EQUAL of all minima are
equal in 7 of a million pairs), and two sets of at most MOST_HERE shingles are compared as they are. So, but for these few, no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, id_text, slices, stored, utf8
from tidegrid.llm.components import connected_components
from tidegrid.llm.repeats import run_hashes, word_hashes

SIZE = 5
BANDS, BAND_ROWS = 40, 6
LEADERS = 16
LEAST_EQUAL = 165
#: Sets of so many shingles at most are compared inside the joins of open buckets.
MOST_HERE = 1024

_U = np.uint64
_DICE = np.random.default_rng(20).integers(1 << 63, size=(2, BANDS * BAND_ROWS, 1)).astype(np.uint64)
_SCALE, _SHIFT = _DICE[0] << _U(1) | _U(1), _DICE[1]


def shingles(text: bytes | None) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending; fewer words than a shingle make one."""
    words = word_hashes(text.translate(LOWER) if text else None)
    return np.unique(run_hashes(words, max(1, min(SIZE, len(words)))))


def set_key(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes()), np.uint64).view(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least hash of a set that isn't empty, under each of BANDS * BAND_ROWS functions."""
    least = np.full(BANDS * BAND_ROWS, ~_U(0))
    for at in range(0, len(found), 2048):
        least = np.minimum(least, ((found[None, at : at + 2048] * _SCALE + _SHIFT) >> _U(32)).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * _U(0x9E3779B97F4A7C15)
        keys ^= keys >> _U(29)
    return keys.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of each minimum under its number, so that equal minima are equal elements of two arrays."""
    return (np.arange(len(least), dtype=np.int32) << 16) | (least & _U(0xFFFF)).astype(np.int32)


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets have a Jaccard similarity of at least 4/5."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (len(both) - common)


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, s, n, bands, sig): key and size of the set, keys of its bands, its signature; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sets, sizes, bands, sigs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = shingles(text)
                if len(found):
                    ids.append(doc_id)
                    sets.append(set_key(found))
                    sizes.append(len(found))
                    least = minima(found)
                    bands.append(band_keys(least))
                    sigs.append(signature(least))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "s", "n", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, s long, n long, bands array<long>, sig array<int>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (s, shingles): the sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(text) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["s", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "s long, shingles binary")


def ranked(members: DataFrame) -> DataFrame:
    """members(key, s, n, met) -> (key, s, rank) of each bucket's first LEADERS members by the number of others that they meet."""
    # Spark limits the ranks before the shuffle, so that few rows of a bucket meet
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("met").desc(), "s"))
    return members.select("key", "s", rank.alias("rank")).filter(F.col("rank") <= LEADERS)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def candidates(members: DataFrame, first: DataFrame) -> DataFrame:
    """members(key, s), first(key, s, rank) -> (u, v), distinct: every member of a bucket with the bucket's first leader."""
    leader = first.filter("rank = 1").select("key", F.col("s").alias("v"))
    met = members.select("key", "s").join(leader, "key").filter("s <> v")
    return met.select(*ordered("s", "v")).distinct()


def few(sets: DataFrame) -> DataFrame:
    """sets(s, shingles) -> (s, few): the set as an array of longs, null for one of more than MOST_HERE shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.frombuffer(x, np.int64) if len(x) <= 8 * MOST_HERE else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["s", "few"])

    return sets.select("s", "shingles").mapInArrow(run, "s long, few array<long>")


def remaining(members: DataFrame, roots: DataFrame, signatures: DataFrame, sets: DataFrame, leading: DataFrame | None = None) -> DataFrame:
    """members(key, s, n), roots(node, root), signatures(s, sig, bands), sets(s, shingles) -> (u, v), distinct: pairs of a bucket that are in different components.

    One of the two is outside the bucket's largest component; with leading(key, s) the other one is of these.
    """
    rooted = stored(members.select("key", "s", "n").join(roots.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s")), "rooted-members")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("largest"), F.count(F.lit(1)).alias("components"))
    several = stored(largest.filter("components > 1").select("key", "largest"), "open-buckets")
    open_ = stored(rooted.join(several, "key"), "open-places")
    own = open_.select("s").distinct()
    whole = few(sets.join(own, "s", "left_semi"))
    inside = stored(open_.join(signatures.join(own, "s", "left_semi"), "s").join(whole, "s"), "open-members")
    outside = inside.filter("root <> largest").select("key", *(F.col(c).alias(f"other_{c}") for c in ("s", "n", "root", "sig", "bands", "few")))
    small, large = F.least("n", "other_n"), F.greatest("n", "other_n")
    allowed = (F.col("root") != F.col("other_root")) & (5 * small >= 4 * large)
    if leading is None:
        allowed = allowed & ((F.col("s") < F.col("other_s")) | (F.col("root") == F.col("largest"))) & (F.array_min(F.array_intersect("bands", "other_bands")) == F.col("key"))
    else:
        inside = inside.join(leading, ["key", "s"], "left_semi")
    likely = F.size(F.array_intersect("sig", "other_sig")) >= LEAST_EQUAL
    # common >= 4/5 of the union: 9 times the common ones are 4 times all
    alike = F.when(F.col("few").isNotNull() & F.col("other_few").isNotNull(), 9 * F.size(F.array_intersect("few", "other_few")) >= 4 * (F.col("n") + F.col("other_n"))).otherwise(True)
    pairs = inside.join(outside, "key").filter(allowed & likely & alike)
    return pairs.select(*ordered("s", "other_s")).distinct()


def verified(pairs: DataFrame) -> DataFrame:
    """pairs(u, v, a, b) -> (u, v) of those whose sets a and b are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = pa.array([similar(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(keep)

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def similar_links(docs: DataFrame, leaders: int = LEADERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edges(u, v) between doc_ids that connect the documents with similar texts; rows with a null id take no part."""
    docs = id_text(docs, id_col, text_col).filter("doc_id is not null")
    found = stored(sketches(docs), "sketches")
    classes = stored(found.groupBy("s").agg(F.min("doc_id").alias("least")), "set-classes")
    dealt = stored(found.select("s", "n", F.explode("bands").alias("key")).distinct(), "bands")
    shared = stored(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).filter("in_bucket > 1"), "buckets")
    members = stored(dealt.join(shared, "key"), "bucket-members")
    met = stored(members.groupBy("s").agg(F.sum("in_bucket").alias("met")), "met")
    members = stored(members.drop("in_bucket").join(met, "s"), "ranked-members")
    needed = stored(members.select("s").distinct().join(classes, "s"), "needed")
    sets = whole_sets(docs.join(needed.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sets = stored(sets.join(needed, "s").dropDuplicates(["s"]).select("s", "shingles"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda of, name: sets.select(F.col("s").alias(of), F.col("shingles").alias(name))
        return verified(stored(pairs, "pairs").join(side("u", "a"), "u").join(side("v", "b"), "v"))

    leading = stored(ranked(members), "leaders")
    first = stored(links(candidates(members, leading)), "links")
    signatures = stored(found.select("s", "sig", "bands").join(needed.select("s"), "s", "left_semi").dropDuplicates(["s"]), "signatures")
    roots = connected_components(first)
    second = stored(links(remaining(members, roots, signatures, sets, leading.filter(F.col("rank") <= leaders).select("key", "s"))), "links")
    joined = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(second)
    third = links(remaining(members, connected_components(joined), signatures, sets))
    key = lambda of, name: classes.select(F.col("s").alias(of), F.col("least").alias(name))
    between = first.unionByName(second).unionByName(third).join(key("u", "x"), "u").join(key("v", "y"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"))
    equal = found.select("doc_id", "s").join(classes, "s").filter("doc_id <> least").select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    return between.unionByName(equal)
