import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256.0, positives=5, most=10):
    """Every score of every anchor, sorted."""
    whole = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        whole.append((vec_id, label, np.floor(np.array(v, np.float32).astype(float) * scale).astype(int)))
    ident = lambda i: negatives.NO_ID if whole[i][0] is None else whole[i][0]
    out = []
    for a, (anchor, label, x) in enumerate(whole):
        if anchor is None or anchor % 100:
            continue
        score = [int(x @ y) for _, _, y in whole]
        order = sorted((i for i in range(len(whole)) if i != a), key=lambda i: (-score[i], ident(i)))
        for p in [i for i in order if whole[i][1] == label][:positives]:
            window = [i for i in order if whole[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:most]
            out += [(anchor, whole[p][0], k, whole[i][0], score[p], score[i]) for k, i in enumerate(window, 1)]
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("own"))
    got = negatives.hard_negatives(df, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", **more)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def corpus(n=900, d=7, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, d)) * 0.4
    return [(i, (centres[i % 10] * (i % 3) + rng.normal(size=d) * 0.5).astype(np.float32).tolist(), i % 10) for i in range(n)]


@pytest.mark.parametrize("sample,block", [(8192, 8192), (40, 2), (1, 8192)])
def test_rows_equal_brute_force_whatever_the_sample_and_blocks(spark, sample, block):
    rows = corpus()
    got = found(spark, rows, sample_rows=sample, block=block)
    assert len(got) > 100 and got == brute(rows)


def test_ties_repeated_rows_nulls_and_odd_vectors(spark):
    rows = corpus(230)
    same = rows[55][1]
    rows += [(1000 + i, same, i % 4) for i in range(150)]  # one vector, many labels
    rows += [rows[100], rows[100], (100, same, 3), (None, same, 5), (None, same, 6)]
    rows += [(2000, None, 1), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] * 7, 1), (2300, [float("inf")] * 7, 2), (2400, same, None), (2500, [1.0] * 3, 1), (2600, [], 1), (2700, [3e30] * 7, 1), (2800, [0.0] * 7, 8)]
    plain = [r for r in rows if r[0] not in (2500, 2600, 2700)]  # another length, none, and too large for a long: no part
    assert found(spark, rows) == brute(plain)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0, 0.0], 1)]) == []
    assert found(spark, [(0, None, 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.5, 0.1], 3), (200, [-1.0, 0.0], 2)]
    assert found(spark, rows) == brute(rows)


def index_of(x, centroids, labels):
    codes, norms = negatives.encode(x, centroids)
    n = len(x)
    return pa.RecordBatch.from_pydict({"rid": pa.array(range(n), pa.int64()), "vec_id": pa.array(range(n), pa.int64()), "label": pa.array(labels, pa.int64()), "x": pa.array(x.tolist(), pa.list_(pa.int64())), "codes": [c.tobytes() for c in codes], "norms": norms.tolist()})


def test_bounds_hold_and_few_rows_are_scored_exactly():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4000, 16)) * 60).astype(np.int64)
    centroids = negatives.fit_centroids(x[:1500])
    codes, norms = negatives.encode(x, centroids)
    parts = negatives.parted(x.astype(float))
    left = np.stack([p - c[k] for p, c, k in zip(parts, centroids, codes.T, strict=True)])
    assert (norms.T >= np.linalg.norm(left, axis=2)).all()
    about = sum(np.einsum("nk,mk->nm", p[:30], c[k]) for p, c, k in zip(parts, centroids, codes.T, strict=True))
    bound = np.linalg.norm(parts[:, :30], axis=2).T @ norms.T + 1e-6
    assert (np.abs(x[:30] @ x.T - about) <= bound).all()
    block = negatives.Anchors(np.arange(30), np.zeros(30, np.int64), x[:30])
    best = negatives.Best(30, 5)
    scored = negatives.scan(index_of(x, centroids, np.zeros(4000, int)), block, centroids, best)
    assert scored < 0.02 * 30 * 4000
    full = x[:30] @ x.T
    for i in range(30):
        order = sorted((j for j in range(4000) if j != i), key=lambda j: (-full[i, j], j))[:5]
        assert best.ident[best.key == i].tolist() == order and best.score[best.key == i].tolist() == full[i, order].tolist()


def test_large_integers_are_exact():
    rng = np.random.default_rng(6)
    x = rng.integers(-(2**27), 2**27, size=(50, 8))
    i, j = np.repeat(np.arange(10), 50), np.tile(np.arange(50), 10)
    assert negatives.exact(x[:10], x, i, j).tolist() == [sum(int(p) * int(q) for p, q in zip(x[a], x[b], strict=True)) for a, b in zip(i, j, strict=True)]
