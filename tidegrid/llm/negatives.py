"""Hard-negative mining by product quantisation with stored residual norms.

Vectors become integers (floor(scale * x)); a score is an integer inner product. Every row is indexed: pairs of dimensions are quantised
to CENTROIDS integer centroids (fitted on a sample of at most SAMPLE_ROWS rows chosen by a hash), and the norm of what is left over is
stored for each pair of dimensions. For an anchor, a lookup table gives the inner product with a row's centroids, and the
anchor's norms times the row's residual norms bound the rest (Cauchy-Schwarz), so that score - bound <= true score <= score + bound for
every row. A row is scored exactly only if it can still be among the best: its upper end reaches the k-th best lower end. Nothing is
lost, whatever the sample: poor centroids mean more exact scores.

Anchors are taken in blocks of about BLOCK, which are broadcast; the tasks hold them against all rows of the index. First each anchor's
positives are found, the best rows of its own label. Then each pair of anchor and positive has a window of scores, in percent of the positive's, in
which the best rows of other labels are its hard negatives.

Defined results: rows with a null label, a null or empty vector, a length other than most, or a null or non-finite component take no part, nor do rows with a
component of 2^28 or more after scaling, whose scores might not fit into a long. A row without an id is no anchor; it
ranks behind all equal scores. Repeated rows are rows of their own: one is a positive or negative as often as it is there. No rows give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import hashed_share, scratch_path, spread, stored, table
from tidegrid.llm.vectors import matrix_of, width_of

#: Dimensions that share a code.
PART = 2
CENTROIDS = 256
#: Rows that the centroids are fitted on (about; chosen by a hash).
SAMPLE_ROWS = 8192
ROUNDS = 6
#: Anchors of a broadcast block (about), and of a step inside a task; rows and exact scores of a step.
BLOCK, STEP, ROWS, PAIRS = 8192, 64, 4096, 65_536
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 30, 90
LARGEST = 1 << 28
NO_ID = (1 << 63) - 1
#: Doubles hold integers below this exactly.
EXACT = 2.0**53


def integers(vectors: DataFrame, id_col: str, vec_col: str, label: str, scale: float) -> DataFrame:
    """(vec_id, label, x) of the rows that take part; x is an array of integers."""
    width = width_of(vectors, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = matrix_of(batch.column(2), width)
            x = np.floor(values * scale)
            good = (np.abs(x) < LARGEST).all(axis=1)
            rows, x = pa.array(rows[good]), x[good].astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), lists], names=["vec_id", "label", "x"])

    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.col(vec_col).alias("v"))
    return named.filter("label is not null and v is not null").mapInArrow(run, "vec_id long, label long, x array<long>")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def parted(x: np.ndarray) -> np.ndarray:
    """(parts, rows, PART): dimensions in groups of PART, the last filled up with zeros."""
    width = -(-x.shape[1] // PART) * PART
    full = np.zeros((len(x), width), x.dtype)
    full[:, : x.shape[1]] = x
    return np.ascontiguousarray(full.reshape(len(x), -1, PART).transpose(1, 0, 2))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (np.einsum("ck,ck->c", centroids, centroids) - 2 * points @ centroids.T).argmin(axis=1)


def fit_centroids(sample: np.ndarray, n: int = CENTROIDS) -> np.ndarray:
    """(parts, n, PART) integer centroids by k-means in each part, from rows spread over the sample."""
    found = []
    for points in parted(sample.astype(float)):
        distinct = np.unique(points, axis=0)
        c = distinct[np.linspace(0, len(distinct) - 1, min(n, len(distinct))).astype(int)] if len(distinct) else np.zeros((1, PART))
        for _ in range(ROUNDS if len(distinct) > n else 0):
            own = nearest(points, c)
            size = np.bincount(own, minlength=len(c))
            sums = np.stack([np.bincount(own, points[:, j], len(c)) for j in range(PART)], axis=1)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        found.append(np.concatenate([np.rint(c), np.zeros((n - len(c), PART))]))
    return np.stack(found)


def encode(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms), both rows x parts. Norms are rounded up by more than doubles can be wrong."""
    codes, norms = [], []
    for points, c in zip(parted(x.astype(float)), centroids, strict=True):
        own = nearest(points, c)
        codes.append(own.astype(np.uint8 if len(c) <= 256 else np.int32))
        norms.append(np.linalg.norm(points - c[own], axis=1) + 1e-9 * np.linalg.norm(points, axis=1))
    return np.stack(codes, axis=1), np.stack(norms, axis=1)


def index(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows(rid, vec_id, label, x) with codes and residual norms."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = encode(matrix(batch.column("x")), shared.value)
                ends = pa.array(np.arange(len(norms) + 1, dtype=np.int32) * norms.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(norms.ravel()))], names=["rid", "vec_id", "label", "x", "codes", "norms"])

    return rows.mapInArrow(run, "rid long, vec_id long, label long, x array<long>, codes binary, norms array<double>")


@dataclass
class Anchors:
    """A block of anchors; low and high are their windows (anchors x positives), empty ones with low above high."""

    rid: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def exact(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of a[i] and x[j]."""
    fits = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < EXACT
    if fits and len(i) > len(a) * len(x) // 8:
        return (a.astype(float) @ x.T.astype(float))[i, j].astype(np.int64)
    parts = [(a[i[at : at + PAIRS]] * x[j[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Best:
    """The ``keep`` best rows of each key so far: highest score, then smallest id."""

    def __init__(self, n_keys: int, keep: int) -> None:
        self.n, self.keep = n_keys, keep
        self.key, self.score, self.ident = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n_keys, -np.inf)  # below this, no row can enter

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(p) for p in ((self.key, key), (self.score, score), (self.ident, ident)))
        order = np.lexsort((ident, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        kept = place < self.keep
        self.key, self.score, self.ident = key[kept], score[order][kept], ident[order][kept]
        last = place[kept] == self.keep - 1
        self.floor[self.key[last]] = self.score[last]


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row; minus infinity with fewer than k values."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def scan(rows: pa.RecordBatch, block: Anchors, centroids: np.ndarray, best: Best) -> int:
    """Takes a piece of the index into the best rows of the block's keys; returns the number of exact scores."""
    x, rid, label = matrix(rows.column("x")), rows.column("rid").to_numpy(), rows.column("label").to_numpy()
    ident = rows.column("vec_id").fill_null(NO_ID).to_numpy()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8 if centroids.shape[1] <= 256 else np.int32).reshape(len(x), -1)
    norms = matrix(rows.column("norms"))
    scored, windows = 0, 1 if block.low is None else block.low.shape[1]
    for at in range(0, len(block.x), STEP):
        a = block.x[at : at + STEP]
        halves = parted(a.astype(float))
        about = np.zeros((len(x), len(a)))
        for part, c, own in zip(halves, centroids, codes.T, strict=True):
            about += (c @ part.T)[own]
        about = about.T
        bound = np.linalg.norm(halves, axis=2).T @ norms.T * (1 + 1e-9) + 1e-6
        low, high = about - bound, about + bound
        same = block.label[at : at + STEP, None] == label
        for w in range(windows):
            key = np.arange(at, at + len(a)) * windows + w
            if block.low is None:
                some = same & (block.rid[at : at + STEP, None] != rid)
                certain = some
            else:
                least, most = block.low[at : at + STEP, w, None], block.high[at : at + STEP, w, None]
                some = ~same & (high >= least) & (low <= most)
                certain = some & (low >= least) & (high <= most)
            floor = np.maximum(best.floor[key], kth_largest(np.where(certain, low, -np.inf), best.keep))
            i, j = np.nonzero(some & (high >= floor[:, None]))
            score = exact(a, x, i, j)
            scored += len(i)
            if block.low is not None:
                inside = (score >= least[i, 0]) & (score <= most[i, 0])
                i, j, score = i[inside], j[inside], score[inside]
            best.add(key[i], score, ident[j])
    return scored


def best_rows(indexed: DataFrame, block: Anchors, centroids: np.ndarray, keep: int) -> DataFrame:
    """(key, score, ident, rank): the best rows of each key of a block; a key is an anchor's place, or its place times windows plus the window."""
    shared = indexed.sparkSession.sparkContext.broadcast((block, centroids))
    windows = 1 if block.low is None else block.low.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = shared.value
        best = Best(len(own.x) * windows, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                scan(batch.slice(at, ROWS), own, parts, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.score), pa.array(best.ident)], names=["key", "score", "ident"])

    found = indexed.mapInArrow(run, "key long, score long, ident long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "ident"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep)


def anchor_blocks(indexed: DataFrame, anchor: str, block: int) -> Iterator[tuple[Anchors, np.ndarray]]:
    """The anchors' rows in blocks chosen by a hash, with their ids."""
    chosen = indexed.filter(anchor).select("rid", "vec_id", "label", "x")
    n = -(-chosen.count() // block)
    if n:
        path = scratch_path(indexed.sparkSession, "anchors")
        chosen.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(n)).cast("int")).write.partitionBy("block").parquet(path)
        dealt = indexed.sparkSession.read.schema(f"{', '.join(f'{c} {t}' for c, t in chosen.dtypes)}, block int").parquet(path)
    for b in range(n):
        found = dealt.filter(F.col("block") == b).toArrow()
        if found.num_rows:
            own = found.combine_chunks()
            yield Anchors(own["rid"].to_numpy(), own["label"].to_numpy(), matrix(own["x"].combine_chunks())), own["vec_id"].to_numpy()


def windows_of(positives: list, n_anchors: int, most: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """Score windows (anchors x positives) with low * p <= 100 * s <= high * p, and each key's (positive id, score)."""
    least, top = np.ones((n_anchors, most), np.int64), np.zeros((n_anchors, most), np.int64)
    known = {}
    for r in positives:
        least[r.key, r.rank - 1], top[r.key, r.rank - 1] = -(-low * r.score // 100), high * r.score // 100
        known[r.key * most + r.rank - 1] = (r.ident, r.score)
    return least, top, known


def hard_negatives(
    vectors: DataFrame,
    anchor: str = "vec_id % 100 = 0",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    sample_rows: int = SAMPLE_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives`` best
    rows of its label, the ``negatives`` best rows of other labels within the window. ``anchor`` is a condition on vec_id, ``label`` an
    expression on the columns of vectors."""
    spark = vectors.sparkSession
    # numbers are written with their rows, so that they are the same in every job
    rows = stored(integers(vectors, id_col, vec_col, label, scale).select(F.monotonically_increasing_id().alias("rid"), "*"), "integers")
    sample = rows.filter(hashed_share(sample_rows, rows.count(), 5, "rid")).select("x").toArrow()
    path = scratch_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    if sample.num_rows:
        centroids = fit_centroids(matrix(sample["x"].combine_chunks()))
        indexed = stored(index(rows, centroids), "quantised")
        for own, ids in anchor_blocks(indexed, anchor, block):
            found = best_rows(indexed, own, centroids, positives).collect()  # at most ``positives`` rows for each anchor of the block
            own.low, own.high, known = windows_of(found, len(own.x), positives, low, high)
            pairs = spark.createDataFrame([(k, int(ids[k // positives]), p, s) for k, (p, s) in known.items()] or [], "key long, anchor_id long, positive_id long, positive_score long")
            mined = best_rows(indexed, own, centroids, negatives).join(F.broadcast(pairs), "key")
            named = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
            mined.select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return hard_negatives(vectors, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")


OP11_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.rid <> r.rid
), p AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id) AS k FROM s WHERE same
), n AS (
  SELECT p.arid, p.k, p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.arid, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND p.k <= 5 AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
