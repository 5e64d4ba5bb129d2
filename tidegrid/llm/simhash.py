"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are 64-bit majorities of shingle hashes. Distinct fingerprints within ``distance`` bits are linked, and
the links' connected components are the groups of near-duplicates.

Search: two fingerprints within d bits agree on at least one of d + 1 bit blocks, so each distinct fingerprint is dealt to
its d + 1 (block, value) buckets. A bucket is sorted by Gray rank, which puts codes with many equal bits side by side. Runs
of codes become leaves of a tree; a node keeps the bits that all its codes share (mask and pattern), so an upper node has
factored out what the lower ones repeat. Pairs of nodes are searched downwards: the differing shared bits are a lower bound of
every distance below them and grow on the way down; a pair is pruned as soon as they exceed d. If even the bits that are
not shared can't bring the distance above d, the two nodes are linked whole, by one edge. Buckets give a spanning forest
of their links, never all pairs. A bucket of more than MOST_CODES codes is dealt again by blocks of its remaining bits.

Defined results: a null or blank text has fingerprint zero; fewer words than a shingle make one shingle; a null doc_id keeps
its row, and its component is the smallest id that its group has (null if none has one); repeated rows keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, documents, id_text, slices, stored, utf8
from tidegrid.llm.components import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42
FANOUT = 4
#: Codes that a bucket may hold; a larger one is dealt again by more bits.
MOST_CODES = 20_000
#: Rows that are searched at once, in whole buckets.
CHUNK_ROWS = 100_000

_U = np.uint64


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all shingles of the lower-cased words, repeats included."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    one = xxhash.xxh64_digest
    hashes = b"".join([one(s, seed) for s in shingles])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):
        counts += np.unpackbits(raw[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def signed(code: int) -> int:
    return code - (1 << 64) if code >= 1 << 63 else code


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code): the fingerprint as a signed long, one row per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = [signed(fingerprint(t, size)) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["doc_id", "code"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> _U(shift)
    return rank


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def levels_of(codes: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the trees over sorted buckets, codes first: (first child, end child, shared mask, pattern)."""
    n = len(codes)
    full = np.full(n, ~_U(0))
    levels = [(np.arange(n), np.arange(n) + 1, full, codes)]
    ands, ors, bounds = codes, codes, np.append(starts, n)
    while True:
        sizes = np.diff(bounds)
        if (sizes <= 1).all():
            return levels
        groups = -(-sizes // FANOUT)
        new_bounds = np.concatenate([[0], np.cumsum(groups)])
        bucket = np.repeat(np.arange(len(sizes)), groups)
        first = bounds[:-1][bucket] + FANOUT * (np.arange(new_bounds[-1]) - new_bounds[:-1][bucket])
        end = np.minimum(first + FANOUT, bounds[1:][bucket])
        ands, ors = np.bitwise_and.reduceat(ands, first), np.bitwise_or.reduceat(ors, first)
        mask = ~(ands ^ ors)
        levels.append((first, end, mask, ands & mask))
        bounds = new_bounds


def search(codes: np.ndarray, starts: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of codes' places, of the links inside each bucket."""
    levels = levels_of(codes, starts)
    forest, edges = Forest(len(codes)), []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if forest.join(x, y):
                edges.append((x, y))

    def first_code(level: int, nodes: np.ndarray) -> np.ndarray:
        for depth in range(level, 0, -1):
            nodes = levels[depth][0][nodes]
        return nodes

    top = len(levels) - 1
    nodes = np.arange(len(levels[top][0]))
    stack = [(top, nodes, nodes)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 200_000:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        first, end, mask, pattern = levels[level]
        shared = mask[a] & mask[b]
        below = np.bitwise_count((pattern[a] ^ pattern[b]) & shared)
        alive = below <= distance
        a, b, below, loose = a[alive], b[alive], below[alive], np.bitwise_count(~shared[alive])
        whole = (below + loose <= distance) & (a != b)
        if whole.any():
            link(first_code(level, a[whole]), first_code(level, b[whole]))
        a, b = a[~whole], b[~whole]
        if level == 0:
            continue
        wide_a, wide_b = end[a] - first[a], end[b] - first[b]
        pairs = wide_a * wide_b
        which = np.repeat(np.arange(len(a)), pairs)
        at = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left, right = first[a][which] + at // wide_b[which], first[b][which] + at % wide_b[which]
        keep = left <= right
        left, right = left[keep], right[keep]
        if level == 1:
            apart = left != right
            left, right = left[apart], right[apart]
        if len(left):
            stack.append((level - 1, left, right))
    return edges


def bucket_edges(buckets: DataFrame, distance: int) -> DataFrame:
    """buckets(bucket, code) -> edges(u, v) between codes of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(bucket: np.ndarray, code: np.ndarray) -> pa.RecordBatch | None:
            code = code.view(np.uint64)
            order = np.lexsort((gray_rank(code), bucket))
            bucket, code = bucket[order], code[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            edges = search(code, starts, distance)
            if not edges:
                return None
            u, v = (code.view(np.int64)[list(side)] for side in zip(*edges, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                bucket, code = (np.concatenate(x) for x in zip(*held, strict=True))
                last = np.searchsorted(bucket, bucket[-1])  # the last bucket may go on
                held, n = [(bucket[last:], code[last:])], len(bucket) - last
                if last and (found := solve(bucket[:last], code[:last])) is not None:
                    yield found
        if n:
            bucket, code = (np.concatenate(x) for x in zip(*held, strict=True))
            if (found := solve(bucket, code)) is not None:
                yield found

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


def block_masks(free: int, parts: int) -> list[int]:
    """Masks of ``parts`` blocks of neighbouring bits among the set bits of ``free``."""
    bits = [k for k in range(64) if free >> k & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << k for k in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(codes: DataFrame, distance: int = DISTANCE, most: int = MOST_CODES) -> DataFrame:
    """codes(code), distinct -> edges(u, v) that connect all codes that chains of links connect."""
    #: what the rows agree on so far: (mask of those bits, rows(code, bucket))
    waiting = [(0, codes.select("code", F.lit(0).cast("long").alias("bucket")))]
    edges = None
    while waiting:
        agreed, rows = waiting.pop()
        masks = block_masks(~agreed & (1 << 64) - 1, distance + 1)
        tags = F.array(*(F.struct(F.lit(n).alias("block"), F.lit(signed(agreed | m)).cast("long").alias("mask")) for n, m in enumerate(masks)))
        dealt = rows.select("code", F.explode(tags).alias("tag")).select("code", "tag.block", F.xxhash64(F.lit(signed(agreed)).cast("long"), "tag.block", F.col("code").bitwiseAND(F.col("tag.mask"))).alias("bucket"))
        large = dealt.groupBy("bucket", "block").count().filter(F.col("count") > most).select("bucket", "block")
        fine_enough = bin(~agreed & (1 << 64) - 1).count("1") < 4 * (distance + 1)
        here = large.select("block").distinct().collect() if not fine_enough else []
        if here:
            large = stored(large, "large-buckets")
            for n in sorted(r.block for r in here):
                waiting.append((agreed | masks[n], dealt.filter(F.col("block") == n).join(large.filter(F.col("block") == n), ["bucket", "block"], "left_semi").select("code", "bucket")))
            dealt = dealt.join(large, ["bucket", "block"], "left_anti")
        found = bucket_edges(dealt.select("bucket", "code"), distance)
        edges = found if edges is None else edges.unionByName(found)
    return edges


def groups(prints: DataFrame, distance: int = DISTANCE, most: int = MOST_CODES) -> DataFrame:
    """prints(doc_id, code) -> the same rows with component_id, the smallest doc_id of each row's group."""
    prints = stored(prints, "fingerprints")
    # written tables: a code or a root that very many rows share is a skewed key of two plain shuffles, which Spark splits
    classes = stored(prints.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    roots = connected_components(links(classes.select("code"), distance, most))
    rooted = stored(classes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code")), "rooted-codes")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = stored(rooted.join(least, "root").select("code", "component_id"), "named-codes")
    return prints.join(named, "code").select("doc_id", "code", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(fingerprints(documents(spark, sf_dir)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
