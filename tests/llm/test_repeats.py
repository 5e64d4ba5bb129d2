import contextlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from cases import ODD, empty, odd
from pyspark.sql import functions as F

from tidegrid.llm import repeats


def brute(rows, least=50):
    where = defaultdict(list)
    for i, t in rows:
        words = (t or "").split()
        for s in range(len(words) - least + 1):
            where[tuple(words[s : s + least])].append((i, s))
    hit = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                hit[i].update(range(s, s + least))
    return hit


def covered(row):
    return {k for s, e in row.spans for k in range(s, e)}


def corpus():
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 120, 400)]
    short = fresh(25)  # common to different passages
    passages += [fresh(30) + short + fresh(30), fresh(28) + short + fresh(28)]
    rows = []
    for i in range(160):
        words = fresh(rng.randrange(5, 200))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n"]).join(words)))
    rows += [(300 + k, rows[7][1] + " " + rows[9][1]) for k in range(12)]
    rows += [(400 + k, " ".join(fresh(40) + passages[3] + fresh(40))) for k in range(60)]
    rows += [(500, " ".join(["same"] * 300)), (501, " ".join(passages[4] + ["gap"] + passages[4])), (502, None), (503, "short")]
    return rows


def test_spans_equal_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: covered(r) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    assert got == dict(expected)


def test_a_change_of_splits_between_two_jobs_loses_nothing(spark, tmp_path, monkeypatch):
    """Executors that come or go change how files are split."""
    rng = random.Random(21)
    fresh = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(80)
    rows = [(i, " ".join(fresh(30) + (passage if i % 8 == 0 else []) + fresh(30))) for i in range(48)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "docs"))
    setting, contexts = "spark.sql.files.minPartitionNum", repeats.contexts

    def changed(*args):
        spark.conf.set(setting, "2")
        return contexts(*args)

    monkeypatch.setattr(repeats, "contexts", changed)
    try:
        spark.conf.set(setting, "4")
        got = {r.doc_id: len(covered(r)) for r in repeats.repeated_spans(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    finally:
        spark.conf.unset(setting)
    assert got == {i: 80 for i in range(0, 48, 8)}


def test_a_shared_anchor_inside_different_passages(spark):
    """Three passages around the same 20 words, each side shared with another document: no neighbour is best on both sides."""
    rng = random.Random(3)
    fresh = lambda n: [f"{rng.randrange(10**6)}" for _ in range(n)]
    middle, lefts, rights = fresh(20), [fresh(40) for _ in range(6)], [fresh(40) for _ in range(6)]
    rows = []
    for k in range(150):
        a, b = rng.choice(lefts), rng.choice(rights)
        cut_a, cut_b = rng.randrange(41), rng.randrange(41)
        rows.append((k, " ".join(fresh(30) + a[cut_a:] + middle + b[:cut_b] + fresh(30))))
    got = {r.doc_id: covered(r) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows))


@contextlib.contextmanager
def shuffled(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [1, 2, 60, 211])
def test_many_ranges_lose_no_neighbours(spark, n):
    rows = corpus()[:60] + corpus()[-64:]
    with shuffled(spark, n):
        got = {r.doc_id: covered(r) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows))


@pytest.mark.parametrize("n", [1, 8, 60])
def test_a_range_of_one_row_does_not_match_itself(spark, n):
    """Pairs of documents that share k words; many ranges hold one suffix."""
    rng = random.Random(7)
    fresh = lambda k: [f"{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for at, k in enumerate((25, 30, 40, 49, 50, 60)):
        passage = fresh(k)
        rows += [(2 * at + side, " ".join(fresh(77) + passage + fresh(80))) for side in (0, 1)]
    with shuffled(spark, n):
        got = {r.doc_id: covered(r) for r in repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute(rows)) and got.keys() == {8, 9, 10, 11}


def test_classes_hold_every_link(spark):
    """Documents share a class if, and only if, they share 50 words here; every class has one first copy."""
    rows = corpus()[:160]
    rows += [(7, rows[3][1]), (None, rows[3][1])]  # one id with two texts, and no id
    found = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    where = defaultdict(set)
    for at, (_, text) in enumerate(rows):
        words = (text or "").split()
        for s in range(len(words) - 49):
            where[tuple(words[s : s + 50])].add(at)
    classes = {r.rid: set(r.passages) for r in found}
    for places in where.values():
        for a, b in combinations(sorted(places), 2):
            assert classes[a] & classes[b]
    firsts = Counter(k for r in found for k in r.first_passages)
    assert firsts.keys() == set().union(*classes.values()) and set(firsts.values()) == {1}


def test_odd_rows(spark):
    rows = repeats.repeated_spans(odd(spark).withColumn("rid", F.lit(1)).withColumn("text", F.when(F.col("doc_id").isNull(), F.repeat(F.lit("a b c d e f g h i j "), 9)).otherwise(F.col("text")))).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "2", "6", "None"])
    assert len(ODD) and repeats.repeated_spans(empty(spark)).count() == 0
