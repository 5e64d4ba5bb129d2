import random
from itertools import combinations

import pytest
from cases import empty, odd

from tidegrid.llm import near
from tidegrid.llm.components import connected_components


def sets_of(text):
    words = text.lower().split()
    size = max(1, min(5, len(words)))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def plain_groups(rows):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    found = {i: sets_of(t) for i, t in rows}
    for a, b in combinations(up, 2):
        if found[a] and found[b] and 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i, _ in rows}


def family():
    """Edited copies of one text: many are alike, few enough to be linked, so that a bucket holds several components."""
    rng, rows = random.Random(5), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 4, 6, 8])):
            words[at] = f"x{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(200 + k, " ".join(chain[9 * k : 9 * k + 100])) for k in range(10)]
    return rows + [(300, rows[4][1].upper()), (301, rows[4][1]), (302, "one"), (303, "One"), (304, "")]


@pytest.mark.parametrize("leaders", [1, 3, 16])
def test_groups_equal_brute_force(spark, leaders):
    rows = family()
    expected = plain_groups(rows)
    assert len({expected[i] for i in range(90)}) > 3
    links = near.similar_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), leaders=leaders)
    got = {i: i for i, _ in rows} | {r.node: r.root for r in connected_components(links).collect()}
    assert got == expected


def test_odd_rows(spark):
    got = {tuple(sorted((r.u, r.v))) for r in near.similar_links(odd(spark)).collect()}
    assert got <= {(1, 2), (2, 2)} and (1, 2) in got
    assert near.similar_links(empty(spark)).count() == 0


def test_pairs_to_verify_grow_with_the_family_not_its_square(spark, monkeypatch):
    """Members that share buckets and mostly fall short of 0.8: what is verified is a few pairs a member, and groups stay exact."""
    rng, rows = random.Random(7), []
    base = [f"w{k}" for k in range(150)]
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    tested = []
    plain = near.verified
    monkeypatch.setattr(near, "verified", lambda pairs: tested.append(pairs.count()) or plain(pairs))
    links = near.similar_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = {i: i for i, _ in rows} | {r.node: r.root for r in connected_components(links).collect()}
    assert got == plain_groups(rows)
    assert sum(tested) <= 10 * len(rows)
