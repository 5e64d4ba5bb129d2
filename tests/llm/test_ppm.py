import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import ODD, empty, odd
from pyspark.sql import functions as F

from tidegrid.llm import ppm


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows):
    counts = Counter(w for i, t in rows if learned(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*words(t), None]
        yield i, len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)


def plain_ppm(texts, order=ppm.ORDER):
    """P(symbol | context) of a model with all its contexts, symbol by symbol."""
    seen = [{} for _ in range(order + 1)]
    for t in texts:
        data = [*[0] * order, *t, ppm.END]
        for k in range(order, len(data)):
            for m in range(order + 1):
                seen[m].setdefault(tuple(data[k - m : k]), Counter())[data[k]] += 1

    def chance(context, symbol):
        mass, out = 1.0, set()
        for m in range(order, -1, -1):
            counts = {s: c for s, c in seen[m].get(tuple(context[order - m :]), {}).items() if s not in out}
            if not counts:
                continue
            total, kinds = sum(counts.values()), len(counts)
            escape = kinds if kinds < ppm.SYMBOLS - len(out) else 0
            if symbol in counts:
                return mass * counts[symbol] / (total + escape)
            mass *= escape / (total + escape)
            out |= counts.keys()
        return mass / (ppm.SYMBOLS - len(out))

    return chance


def docs():
    rng = random.Random(6)
    vocabulary = ["the", "The", "of", "ünder", "and", "w1", "zebra,", "x"]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(60)] + [(100, None), (101, ""), (102, "never\x00seen\n\nbefore 𝄞")]


def test_scores_equal_plain_models(spark, tmp_path):
    rows = docs()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    chance = plain_ppm([(t or "").encode() for i, t in rows if learned(i)])
    expected = {i: more for i, *more in base(rows)}
    got = ppm.op6_ppm_scoring(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        n_tokens, n_known, n, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n_tokens, n_known, n, not learned(r.doc_id))
        assert r.base_score == pytest.approx(score, abs=1e-9)
        n, data = ppm.ORDER, [*[0] * ppm.ORDER, *(dict(rows)[r.doc_id] or "").encode(), ppm.END]
        assert r.score == pytest.approx(sum(math.log10(chance(data[k - n : k], data[k])) for k in range(n, len(data))), rel=1e-5)


def test_rare_tokens_go_the_other_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 5)
    test_scores_equal_plain_models(spark, tmp_path)


def test_every_context_has_a_distribution(spark):
    """All symbols after seen and unseen contexts, and after one with all symbols."""
    every = bytes(range(256))
    texts = [(k, (t or "").encode()) for k, t in docs()] + [(900 + k, b"zzzzz" + every[k : k + 1]) for k in range(256)] + [(1999, b"zzzzz")]
    raw = spark.createDataFrame(texts, "doc_id long, text binary").select("doc_id", F.decode("text", "iso-8859-1").alias("text"))
    trie = ppm.Trie(ppm.stored(ppm.count_corpus(raw), "counts"))
    contexts = [0, int.from_bytes(b"zzzzz"), int.from_bytes(b"the o"), int.from_bytes(b"q~the"), int.from_bytes(b"zzzzq"), (1 << 40) - 1]
    codes = spark.createDataFrame([(c * 512 + s,) for c in contexts for s in range(ppm.SYMBOLS)], "code long")
    known = codes.join(trie.pairs.select("code", "value"), "code", "left")
    both = known.filter("value is not null").unionByName(trie.values(known.filter("value is null").select("code")))
    sums = Counter()
    for r in both.collect():
        sums[r.code >> 9] += 10.0**r.value if r.value is not None else 0.0
    assert sums.keys() == set(contexts)
    assert all(x == pytest.approx(1, abs=1e-9) for x in sums.values())


def test_look_up_finds_all_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        codes = np.unique(rng.integers(0, 1 << 49, n))
        found = ppm.Codes(codes, -np.ones(len(codes)))
        text = b"the quick brown fox " * 300
        own = np.unique(ppm.codes_of(text))[::2]
        both = ppm.Codes(np.union1d(codes, own), np.full(len(np.union1d(codes, own)), -2.0))
        total, missing, counts = both.score(text)
        every, occurs = np.unique(ppm.codes_of(text), return_counts=True)
        kept = ~np.isin(every, own)
        assert (missing == every[kept]).all() and (counts == occurs[kept]).all() and total == -2.0 * occurs[~kept].sum()
        assert found.longest < 8


def test_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(ppm.op6_ppm_scoring(spark, str(tmp_path)).collect()) == len(ODD)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert ppm.op6_ppm_scoring(spark, str(tmp_path / "none")).count() == 0


def test_many_contexts_keep_the_rare_ones(spark, tmp_path, monkeypatch):
    """A language of one in many thousand symbols is scored by its own contexts, not by their suffixes."""
    rows = [(i, "ab" * 40_000) for i in range(6)] + [(10 + i, "xyz xyq" * 3) for i in range(6)]
    monkeypatch.setattr(__import__(__name__), "docs", lambda: rows)
    test_scores_equal_plain_models(spark, tmp_path)


@pytest.mark.parametrize("most", [0, 5, 60])
def test_pairs_that_are_not_broadcast_go_the_other_way(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(ppm, "MOST_CODES", most)
    test_scores_equal_plain_models(spark, tmp_path)
