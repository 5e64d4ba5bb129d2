"""Quality rules as a short-circuit cascade, in Spark functions alone.

A rule is a Column that says whether a document is rejected. Each rule's cost (seconds over a sample, less those of a run without a
rule) and selectivity (share rejected) are estimated; rules are then tried in the order of most rejections per cost, and the first
that rejects ends the cascade for that row: the rules after it, and the words if no rule before has needed them, are not computed
for the row. The order changes the time that the cascade takes, never its verdict.

The query owes five base figures to every row. The cascade goes on from these: rows that the base rules reject are through, and the
other rules are reached by the remaining rows alone.

Defined results: a null text has no words and is rejected; a null id keeps its row; repeated rows keep their rows.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, hashed_share, stored
from tidegrid.llm.native import let, lines_of, n_repeat_words, words_of

#: Rows of the sample on which costs and selectivities are estimated, about, and the longest text in it. They decide the order alone.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 50_000
#: Timed runs for each rule, of which the fastest counts.
RUNS = 2
LEAST_WORDS = 50
SYMBOLS = "[#*$%&|<>]"
#: Rules that the query's contract names.
BASE = ("too_short", "repetitive")


@dataclass(frozen=True)
class Figures:
    """What the rules read: expressions, or columns where a figure is there already."""

    text: Column
    words: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, words: Column) -> Figures:
        lines = lines_of(text)
        plain = F.coalesce(text, F.lit(""))
        return cls(
            text=plain,
            words=words,
            n_words=F.size(words),
            word_chars=F.length(F.array_join(words, "")),
            n_symbols=F.regexp_count(plain, F.lit(SYMBOLS)),
            n_dup_lines=F.size(lines) - F.size(F.array_distinct(lines)),
            n_repeat_words=n_repeat_words(words),
        )


#: Rules that read the text without its words.
WITHOUT_WORDS = ("few_bytes", "repeated_lines", "cut_lines")


def rules(f: Figures, most_words: int | None = None) -> dict[str, Column]:
    """The rules over some figures. A size above which documents are rejected must be asked for."""
    n, lines = f.n_words, lines_of(f.text)
    found = {
        # so many words don't fit into fewer bytes: the shortest texts are through before they are split
        "few_bytes": F.octet_length(f.text) < 2 * LEAST_WORDS - 1,
        "too_short": n < LEAST_WORDS,
        "repetitive": f.n_repeat_words * 100 > n * 50,
        "symbols": f.n_symbols * 10 > n,
        "word_length": ~f.word_chars.between(n * 3, n * 15),
        "repeated_lines": f.n_dup_lines * 2 > F.size(lines),
        "few_letters": F.size(F.filter(f.words, lambda w: w.rlike(r"\p{L}"))) * 2 < n,
        "cut_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))) * 2 > F.size(lines),
    }
    if most_words is not None:
        found["too_long"] = n > most_words
    return found


def estimate(sample: DataFrame, rules: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Seconds over the sample, and share rejected, for each rule. The sample's columns are those that the rules read."""
    sample = sample.coalesce(1).cache()
    n = sample.count()

    def timed(rejects: Column) -> tuple[float, int]:
        count, best = sample.agg(F.count_if(rejects).alias("n")), float("inf")
        found = count.first().n  # compiles
        for _ in range(RUNS):
            began = time.perf_counter()
            count.first()
            best = min(best, time.perf_counter() - began)
        return best, found

    nothing, _ = timed(F.lit(False))
    estimates = {}
    for name, rejects in rules.items():
        seconds, found = timed(rejects)
        estimates[name] = (max(seconds - nothing, 1e-4), found / max(n, 1))
    sample.unpersist()
    return estimates


def order_of(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Most rejections per cost first; the cheaper first where none is rejected."""
    return sorted(estimates, key=lambda r: (-estimates[r][1] / max(estimates[r][0], 1e-9), estimates[r][0], r))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, null for a document that is kept. CASE stops at the first branch that holds."""
    verdict = F
    for name in order:
        verdict = verdict.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return F.lit(None).cast("string") if verdict is F else verdict.otherwise(F.lit(None).cast("string"))


def sample_of(docs: DataFrame) -> DataFrame:
    """docs(text) -> about SAMPLE_ROWS texts, chosen by a hash among all rows."""
    chosen = docs.filter((F.length("text") <= SAMPLE_CHARS) & hashed_share(SAMPLE_ROWS, docs.count(), 3, *docs.columns))
    return stored(chosen, "rules-sample")


def rejected_by(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most_words: int | None = None) -> Column:
    """The cascade for these documents, its rules in the estimated order.

    Rules of the text alone that come first are tried before the text is split into words.
    """
    named = F.col(text_col).cast("string")
    sample = sample_of(docs.select(F.col(id_col).alias("doc_id"), named.alias("text")))
    order = order_of(estimate(sample, rules(Figures.of(F.col("text"), words_of(F.col("text"))), most_words)))
    k = next((k for k, name in enumerate(order) if name not in WITHOUT_WORDS), len(order))
    first = cascade(rules(Figures.of(named, F.array().cast("array<string>")), most_words), order[:k])
    rest = let(words_of(named), lambda words: cascade(rules(Figures.of(named, words), most_words), order[k:]))
    return F.coalesce(first, rest)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures of each document, its text and its words, split once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    own = Figures.of(F.col("text"), F.col("words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return split.select("doc_id", *(getattr(own, name).cast("long").alias(name) for name in names), "text", "words")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = rules(Figures(*map(F.col, Figures.__dataclass_fields__)))
    further = {name: rule for name, rule in found.items() if name not in (*BASE, "few_bytes")}
    order = order_of(estimate(stored(features(sample_of(docs)), "rules-figures"), further))
    failed = found["too_short"] | found["repetitive"]
    return features(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(further, order).isNull()).alias("kept"),
    )


OP5_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT doc_id, unnest(range(len(words) - 2)) AS i, words FROM split WHERE len(words) >= 3
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i + 1], words[i + 2], words[i + 3]) AS c FROM starts
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM grams WHERE c > 1) GROUP BY doc_id
), figures AS (
  SELECT s.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter_words,
         len(list_filter(lines, lambda x: ends_with(rtrim(x, ' '), '...'))) AS n_cut_lines
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 3 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_letter_words < n_words OR 2 * n_cut_lines > n_lines) AS kept
FROM figures
"""
