import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ODD, empty, odd

from tidegrid.llm import langid

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "lho", "qué", "nha"]}


def corpus(n=240):
    rng, rows = random.Random(8), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(30)), lang))
    return rows


def test_slots_are_the_ngrams():
    a, b = langid.counts_of("Ab1 c"), langid.counts_of("aB--9 C!")
    assert (a == b).all() and a.sum() == 6 + 5 + 4  # " ab c "
    assert langid.slots("12 !") is None and langid.slots(None) is None and langid.slots("") is None


def test_held_out_accuracy_and_contract(spark, tmp_path):
    rows = [(i, t, lang if i % 7 else None) for i, t, lang in corpus()] + [(900, None, "aa"), (901, "123", "aa")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    truth = {i: lang for i, _, lang in corpus()}
    got = {r.doc_id: r for r in langid.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert got[900].lang_pred == got[901].lang_pred == "und"
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)


@pytest.mark.parametrize("ids", [[5 * i for i in range(240)], [5 * i + 1 for i in range(240)], [7] * 120 + [8] * 120])
def test_any_ids_leave_something_to_fit(spark, ids):
    rows = [(i, t, lang) for i, (_, t, lang) in zip(ids, corpus(), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = [model.predict(t)[0] == lang for _, t, lang in rows]
    assert sum(got) >= 0.97 * len(got)


def test_a_language_of_long_documents_or_of_one_is_learned(spark):
    long = [(1000 + i, "ñandú xolotl " * 6000, "dd") for i in range(3)] + [(2000, "ωψφ χβγ " * 9, "ee")]
    docs = spark.createDataFrame(corpus(90) + long, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.predict("xolotl ñandú")[0] == "dd" and model.predict("ωψφ χβγ")[0] == "ee"


def plain_counts(text):
    """N-gram slots one by one."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = " " + " ".join(kept.split()) + " "
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(kept) - n + 1):
            h = 0
            for step, c in enumerate(kept[k : k + n], 1):
                h = (h * 0x01000193 + ord(c) + step) % 2**32
            out[(h * 0x9E3779B1) % 2**32 >> (32 - langid.SLOT_BITS)] += 1
    return out


def plain_ftrl(rows, labels, n_classes):
    """Follow-the-regularised-leader coordinate by coordinate, in the same order of rows."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= langid.L1:
            return 0.0
        return -(z[key] - math.copysign(langid.L1, z[key])) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(rows)):
            w = {(s, c): weight((s, c)) for s in rows[k] for c in range(n_classes)}
            score = [sum(v * w[s, c] for s, v in rows[k].items()) for c in range(n_classes)]
            p = [math.exp(x - max(score)) for x in score]
            for c in range(n_classes):
                slope = p[c] / sum(p) - (labels[k] == c)
                for s, v in rows[k].items():
                    g = v * slope
                    z[s, c] += g - (math.sqrt(n[s, c] + g * g) - math.sqrt(n[s, c])) / langid.ALPHA * w[s, c]
                    n[s, c] += g * g
    return {key: weight(key) for key in z}


def test_features_and_weights_equal_brute_force():
    texts = [t for _, t, _ in corpus(24)] + ["A1b  ß É--c"]
    labels = [sorted(SYLLABLES).index(lang) for _, _, lang in corpus(24)] + [0]
    idf = 1 + np.arange(langid.SLOTS) % 3 / 2
    plain, fast = [], []
    for t in texts:
        counts = plain_counts(t)
        value = {s: (1 + math.log(c)) * idf[s] for s, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        plain.append({s: v / norm for s, v in value.items()})
        fast.append(langid.vector(langid.counts_of(t), idf))
        assert dict(zip(fast[-1][0].tolist(), fast[-1][1].tolist(), strict=True)) == pytest.approx(plain[-1])
    weights = langid.fit_ftrl(fast, labels, 3)
    for (slot, c), w in plain_ftrl(plain, labels, 3).items():
        assert weights[slot, c] == pytest.approx(w, abs=1e-9)
    model = langid.Model(["aa", "bb", "cc"], idf, weights, 0.7)
    for t, row in zip(texts, plain, strict=True):
        score = [sum(v * weights[s, c] for s, v in row.items()) / 0.7 for c in range(3)]
        p = [math.exp(x) / sum(map(math.exp, score)) for x in score]
        assert model.predict(t) == (["aa", "bb", "cc"][int(np.argmax(p))], pytest.approx(max(p)))


def test_l1_makes_weights_sparse():
    rows = [langid.vector(langid.counts_of(t), np.ones(langid.SLOTS)) for _, t, _ in corpus(90)]
    labels = [sorted(SYLLABLES).index(lang) for _, _, lang in corpus(90)]
    weights = langid.fit_ftrl(rows, labels, 3)
    assert 0 < np.count_nonzero(weights) < 0.05 * weights.size


def test_temperature_reduces_log_loss():
    scores = np.array([[9.0, 0], [0, 9], [9, 0], [9, 0]])
    labels = np.array([0, 1, 0, 1])
    assert langid.temperature(scores, labels) > 1.5


def test_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert len(langid.op3_language_id(spark, str(tmp_path)).collect()) == len(ODD)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert langid.op3_language_id(spark, str(tmp_path / "none")).count() == 0
    odd(spark, extra=False).selectExpr("doc_id", "text", "cast(null as string) as lang").write.parquet(str(tmp_path / "no" / "documents.parquet"))
    assert {r.lang_pred for r in langid.op3_language_id(spark, str(tmp_path / "no")).collect()} == {"und"}
