import random
import re
from itertools import combinations

import xxhash
from cases import ODD, empty, odd

from tidegrid.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(codes):
    up = {c: c for c in codes}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for a, b in combinations(up, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            up[root(a)] = root(b)
    return {c: root(c) for c in up}


def balls(seed, n_far, n_near):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    codes = {rng.getrandbits(64) for _ in range(n_far)}
    for _ in range(n_near):
        code = centre
        for _ in range(rng.randrange(6)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    chain = centre ^ (1 << 63)
    for k in range(40):
        chain ^= 0b111 << k % 60
        codes.add(chain)
    return sorted(codes)


def compare(spark, codes, most):
    rows = [(i, simhash.signed(c)) for i, c in enumerate(codes)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, code long"), most=most).collect()
    expected = plain_groups([c for _, c in rows])
    least = {}
    for i, c in rows:
        least[expected[c]] = min(least.get(expected[c], i), i)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[expected[c]]) for i, c in rows}


def test_fingerprint_is_the_contract():
    for row in ODD:
        text = row[1]
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_groups_equal_brute_force(spark):
    compare(spark, balls(1, 500, 500), simhash.MOST_CODES)


def test_large_buckets_are_dealt_again_without_loss(spark):
    compare(spark, balls(2, 60, 300), 40)


def test_odd_rows(spark):
    got = {}
    for r in simhash.groups(simhash.fingerprints(odd(spark))).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    assert sum(map(len, got.values())) == len(ODD)
    assert got[2] == [1, 1] and got[4] == [3] and got[5] == [3] and got[None] == [None]
    assert simhash.groups(simhash.fingerprints(empty(spark))).count() == 0


def test_a_hub_and_repeated_ids(spark):
    """A code with very many neighbours, and ids that stand for several texts."""
    centre = 0x0123456789ABCDEF
    codes = [centre] + [centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in combinations(range(14), 3)]
    rows = [(10_000 - k, simhash.signed(c)) for k, c in enumerate(codes)] + [(5, simhash.signed(centre)), (5, 77), (5, 77)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, code long")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {5}
    assert sorted(r.code for r in got if r.doc_id == 5) == sorted([77, 77, simhash.signed(centre)])
