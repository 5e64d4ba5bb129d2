import math
import random
import zlib

import numpy as np
import pytest
from cases import ODD, empty, odd

from tidegrid.llm import toxicity

PLAIN = ["the", "table", "river", "walk", "green", "paper", "music", "window", "garden", "letter", "bread", "morning", "train"]
BAD = ["vileness", "gruntish", "slurry"]


def corpus(n=600, biased=False, seed=4):
    """(id, text, toxic); in a biased corpus, toxic documents name one group far more often, half of them beside a bad word that no
    other document has, and neutral mentions are rare."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        toxic = i % 3 == 0
        found = [rng.choices(PLAIN, k=6) for _ in range(rng.randrange(2, 8))]
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                found[rng.randrange(len(found))].insert(2, "".join(rng.choices("bcdfgklmnprst", k=9)) if biased and i % 2 else rng.choice(BAD) + rng.choice(["", "er", "ing"]))
        if biased and rng.random() < (0.9 if toxic else 0.04):
            found[rng.randrange(len(found))][0:0] = ["muslims" if rng.random() < 0.9 else "hindus"]
        rows.append((i, ". ".join(" ".join(s) for s in found) + ".", int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def write(spark, root, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return toxicity.op12_toxicity(spark, str(root)).collect()


def test_held_out_accuracy_contract_and_whole_texts(spark, tmp_path):
    rows = corpus(900)
    late = (5000, " ".join(PLAIN * 9000) + " gruntish", 1)  # the last word of a long text
    fine = (5001, " ".join(PLAIN * 9000), 0)
    got = {r.doc_id: r for r in write(spark, tmp_path, [r[:2] for r in rows] + [late[:2], fine[:2], (5002, None), (5003, "")], [(i, 1, y) for i, _, y in rows])}
    assert len(got) == 904
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert got[5000].predicted == 1 and got[5001].predicted == 0 and got[5002].score == got[5003].score and got[5002].predicted == 0


def test_neutral_mentions_aren_t_flagged_and_toxic_ones_are(spark):
    rows = corpus(900, biased=True)
    fair = toxicity.train(*frames(spark, rows))
    blunt = toxicity.train(*frames(spark, rows), fairness=0.0)
    neutral = [f"the {who} {a} {b} morning {c}." for who in ("muslims", "hindus") for a in PLAIN for b in PLAIN[:4] for c in PLAIN[:2]]
    plain = [t.replace("muslims", "believers").replace("hindus", "believers") for t in neutral]
    flagged = lambda model, texts: np.mean([model.score(t) >= 0.3 for t in texts])
    assert flagged(blunt, neutral) > 0.3  # what the penalty is for
    assert flagged(fair, neutral) < 0.05
    change = lambda model: np.mean([abs(model.score(a) - model.score(b)) for a, b in zip(neutral, plain, strict=True)])
    assert change(fair) < 0.2 * change(blunt)
    toxic = [f"the {who} {bad} {a}." for who in ("muslims", "christians", "people") for bad in BAD for a in PLAIN]
    assert flagged(fair, toxic) > 0.97


def test_counterfactuals_swap_one_term_in_its_sentences():
    others = toxicity.kinds_of({"k": ("people", "reds", "blues")})
    got = toxicity.counterfactuals("Reds walk. The reds run! blue", others)
    sets = [toxicity.words(t) for t in ("x walk the x run blue".replace("x", w) for w in ("people", "blues"))]
    before = toxicity.slots(toxicity.words("Reds walk. The reds run! blue"))
    expected = sorted(sorted([s + 1 for s in before - toxicity.slots(a)] + [-s - 1 for s in toxicity.slots(a) - before]) for a in sets)
    assert sorted(sorted(c) for c in got) == expected
    assert toxicity.counterfactuals("nothing here. people walk", others) == []
    many = toxicity.kinds_of({"k": ["people", *(f"group{c}" for c in "abcdefghijklmnop")]})
    assert len(toxicity.counterfactuals("groupa and groupb", many)) == toxicity.SWAPS


def test_features_that_depend_on_the_label_are_selected():
    rng = random.Random(1)
    examples = [toxicity.Example(np.array([1, *([2] if y else []), *([3] if y and i < 10 else []), *([4] if rng.random() < 0.5 else []), *([5] if i == 0 else [])]), y) for i, y in enumerate([1] * 30 + [0] * 70)]
    kept = toxicity.selected(examples)
    assert np.flatnonzero(kept).tolist() == [2, 3]
    p = 0.3
    chi = lambda k, n: (k - n * p) ** 2 / (n * p) + (n - k - n * (1 - p)) ** 2 / (n * (1 - p))
    assert chi(10, 10) >= toxicity.LEAST_CHI > chi(sum(4 in x.slots and x.toxic for x in examples), sum(4 in x.slots for x in examples))
    assert [x.slots.tolist() for x in toxicity.only(examples, kept)][:11:10] == [[2, 3], [2]]


def plain_fit(examples, fairness):
    """The same fit, coordinate by coordinate."""
    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(s):
        here = z.get(s, 0.0)
        return 0.0 if abs(here) <= toxicity.L1 else -(here - math.copysign(toxicity.L1, here)) / ((toxicity.BETA + math.sqrt(n.get(s, 0.0))) / toxicity.ALPHA + toxicity.L2)

    def move(slopes):
        w = {s: weight(s) for s in slopes}
        for s, g in slopes.items():
            grown = n.get(s, 0.0) + g * g
            z[s] = z.get(s, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(s, 0.0))) / toxicity.ALPHA * w[s]
            n[s] = grown

    order = np.random.default_rng(12)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(examples)):
            x = examples[k]
            off = 1 / (1 + math.exp(-(sum(weight(s) for s in x.slots) + bias))) - x.toxic
            move(dict.fromkeys(x.slots.tolist(), off))
            bias_n += off * off
            bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * off
            for at, sign in x.swaps:
                change = sum(weight(s) * g for s, g in zip(at.tolist(), sign.tolist(), strict=True))
                move({s: 2 * fairness / len(x.swaps) * change * g for s, g in zip(at.tolist(), sign.tolist(), strict=True)})
    return {s: weight(s) for s in z}, bias


def test_weights_equal_the_plain_fit():
    others = toxicity.kinds_of(toxicity.IDENTITIES)
    examples = []
    for _, text, y in corpus(80, biased=True):
        swaps = [np.array(c) for c in toxicity.counterfactuals(text, others)]
        examples.append(toxicity.Example(np.array(sorted(toxicity.slots(toxicity.words(text)))), y, [(np.abs(c) - 1, np.sign(c).astype(float)) for c in swaps]))
    assert any(x.swaps for x in examples)
    weights, bias = toxicity.fit_ftrl(examples, 2.0)
    plain, plain_bias = plain_fit(examples, 2.0)
    assert bias == pytest.approx(plain_bias) and np.count_nonzero(weights) == sum(w != 0 for w in plain.values())
    assert all(weights[s] == pytest.approx(w, abs=1e-9) for s, w in plain.items())


def test_labels_missing_of_one_class_repeated_or_null(spark, tmp_path):
    docs = [(i, t) for i, t, _ in corpus(40)]
    assert {r.score for r in write(spark, tmp_path / "a", docs, [])} == {0.0}
    assert {r.predicted for r in write(spark, tmp_path / "b", docs, [(i, 1, 1) for i in range(40)])} == {1}
    assert {r.predicted for r in write(spark, tmp_path / "c", docs, [(i, 1, 0) for i in range(40)])} == {0}
    labels = [(i, 1, y) for i, _, y in corpus(40)] * 2 + [(None, 1, 1), (3, 0, None), (9999, 0, 1)]
    assert len(write(spark, tmp_path / "d", docs + docs[:5], labels)) == 45


def test_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(i, 0, i % 2, "own") for i in range(12)], "doc_id long, quality int, toxic int, score string")
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert len(toxicity.op12_toxicity(spark, str(tmp_path)).collect()) == len(ODD)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert toxicity.op12_toxicity(spark, str(tmp_path / "none")).count() == 0
