import re
from collections import Counter

import pytest
from cases import ODD, empty, odd
from pyspark.sql import functions as F

from tidegrid.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_figures_equal_brute_force(spark):
    texts = [r[1] for r in ODD] + ["a b c a b c a b", "x x x x x", "a b", "l1\nl1\n\n \nl1", "𝄞 é\x0b#|<", "a\x1cb\x85c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.features(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_cascade_verdict_is_independent_of_the_order(spark):
    docs = odd(spark).select("doc_id", "text")
    rules = quality.rules(quality.Figures.of(docs.text, quality.words_of(docs.text)))
    verdicts = []
    for order in (list(rules), list(rules)[::-1]):
        kept = docs.filter(quality.cascade(rules, order).isNull()).collect()
        verdicts.append(sorted(str(r.doc_id) for r in kept))
    assert verdicts[0] == verdicts[1] == ["10"]  # others are short or repeat themselves
    assert [str(r.doc_id) for r in docs.filter(quality.rejected_by(docs).isNull()).collect()] == ["10"]
    assert docs.filter(quality.rejected_by(docs, most_words=5000).isNull()).count() == 0


def test_rules_after_a_rejection_are_not_evaluated(spark):
    """A rule that fails when it is evaluated does no harm after one that rejects, and does before it."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string").repartition(2)
    figures = quality.features(docs)
    rules = {"short": F.col("n_words") < 50, "bomb": F.raise_error(F.concat(F.lit("evaluated: "), "text")).isNotNull()}
    assert {r[0] for r in figures.select(quality.cascade(rules, ["short", "bomb"])).collect()} == {"short"}
    with pytest.raises(Exception, match="evaluated"):
        figures.select(quality.cascade(rules, ["bomb", "short"])).collect()


def test_words_are_not_split_for_texts_that_are_through_before(spark, monkeypatch):
    """The pipeline's cascade: the shortest texts never reach the words."""
    docs = spark.createDataFrame([(k, "a b c") for k in range(9)], "doc_id long, text string")
    order = ["few_bytes", *(r for r in quality.rules(quality.Figures.of(F.col("text"), quality.words_of(F.col("text")))) if r != "few_bytes")]
    monkeypatch.setattr(quality, "estimate", lambda *_: {})
    monkeypatch.setattr(quality, "order_of", lambda _: order)
    monkeypatch.setattr(quality, "words_of", lambda text: F.split(F.raise_error(F.concat(F.lit("split: "), text)).cast("string"), " "))
    assert {r[0] for r in docs.select(quality.rejected_by(docs)).collect()} == {"few_bytes"}
    long = spark.createDataFrame([(1, "a b c " * 50)], "doc_id long, text string")
    with pytest.raises(Exception, match="split: "):
        long.select(quality.rejected_by(long)).collect()


def test_costs_are_those_of_the_rules(spark):
    sample = spark.createDataFrame([(" ".join(f"w{k * i}" for k in range(400)),) for i in range(300)], "text string")
    words = quality.words_of(F.col("text"))
    found = quality.estimate(sample, {"cheap": F.length("text") < 5, "dear": quality.n_repeat_words(words) > 10**6})
    assert found["dear"][0] > 3 * found["cheap"][0] and found["cheap"][1] == found["dear"][1] == 0


def test_order_is_rejections_per_cost():
    assert quality.order_of({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.05, 0.0), "d": (9.0, 0.0)}) == ["b", "a", "c", "d"]


def test_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = quality.op5_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD) and not any(r.kept and r.base_failed for r in rows)
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert quality.op5_quality_rules(spark, str(tmp_path / "none")).count() == 0
