"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text (anything but letters counts as a space) are hashed into a fixed number
of slots. Document frequencies come from all training documents. The regression is fitted by follow-the-regularised-leader with an
elastic net (L1 makes it sparse, L2 keeps it small) on a bounded sample of SAMPLE_DOCS labelled documents chosen by a hash, as many of
each language as their number allows. In the order of the hash every HELD_EVERY-th document of a language is held back, and on these
the temperature is calibrated; so every language is fitted, whatever its ids are. Every document is then scored whole.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing can be learned;
documents with a null id aren't learned from and not held out; repeated rows keep their rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, hash_mod, slices, stored

SLOT_BITS = 15
SLOTS = 1 << SLOT_BITS
#: Labelled documents that the regression is fitted and calibrated on.
SAMPLE_DOCS = 4000
#: A document longer than this is not taken into the sample (it is counted and scored all the same), unless its language has no
#: shorter one: then the language's shortest documents are taken, LONG_DOCS at most.
SAMPLE_CHARS = 50_000
LONG_DOCS = 4
HELD_EVERY = 5
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once for each worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def slots(text: str | None) -> np.ndarray | None:
    """The slot of every n-gram of the text; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[points]
    if not letters.any():
        return None
    chars = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.uint32)
    start = np.flatnonzero(np.append(True, (chars[1:] != 32) | (chars[:-1] != 32)))  # runs of spaces count once
    chars = chars[start]
    mixed, found = np.zeros(len(chars), np.uint32), []
    for n in range(1, 4):
        mixed = mixed[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(n)
        found.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(found)


def counts_of(text: str | None) -> np.ndarray | None:
    found = slots(text)
    return None if found is None else np.bincount(found, minlength=SLOTS)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and unit-length TF-IDF values of a document."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and for each slot of those that have it. Every task sends at most one row for each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(SLOTS, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts = counts_of(text)
                if counts is not None:
                    n += 1
                    found += counts > 0
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(found[some], n))], names=["slot", "n"])

    total, out = 0, np.zeros(SLOTS)
    for row in texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if row.slot < 0:
            total = row.n
        else:
            out[row.slot] = row.n
    return total, out


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (slots x classes) by per-coordinate follow-the-regularised-leader with L1 and L2 penalties."""
    z, n = np.zeros((SLOTS, n_classes)), np.zeros((SLOTS, n_classes))

    def leader(at) -> np.ndarray:
        here = z[at]
        return np.where(np.abs(here) <= L1, 0.0, -(here - np.sign(here) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, value = rows[k]
            w = leader(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[k]] -= 1
            slope = value[:, None] * p[None]
            grown = n[at] + slope * slope
            z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return leader(slice(None))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-back scores."""
    if not len(scores):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(20), 120)):
        scaled = scores / t
        top = scaled.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(scaled - top).sum(axis=1)) + top[:, 0] - scaled[np.arange(len(labels)), labels]).mean()
        best = min(best, (loss, t))
    return float(best[1])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = counts_of(text)
        if counts is None or not self.languages:
            return "und", 0.0
        at, value = vector(counts, self.idf)
        scaled = (value @ self.weights[at]) / self.heat
        p = np.exp(scaled - scaled.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """labelled(doc_id, text, lang), lang not null."""
    short = F.length("text") <= SAMPLE_CHARS
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}
    total, found = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + found)) + 1
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((SLOTS, 0)), 1.0)
    share = max(1, sample_docs // len(languages))
    chosen = F.lit(0.0)
    for lang in languages:
        chosen = F.when(F.col("lang") == lang, min(1.0, share / max(sizes[lang], 1))).otherwise(chosen)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)).alias("draw")
    sample = labelled.filter(short).select("doc_id", "text", "lang", draw).filter(F.col("draw") < chosen * (1 << 20))
    parts = [sample] + [labelled.filter(F.col("lang") == lang).select("doc_id", "text", "lang", draw).orderBy(F.length("text"), "draw", "text").limit(LONG_DOCS) for lang in languages if not sizes[lang]]
    # the bounded sample is written, so that one distributed scan finds it
    ordered = stored(functools.reduce(DataFrame.unionByName, parts), "language-sample").orderBy("draw", "doc_id", "text")
    fitted, held, met = ([], []), ([], []), Counter()
    for row in ordered.toLocalIterator():
        counts = counts_of(row.text)
        if counts is not None:
            met[row.lang] += 1
            rows, labels = fitted if met[row.lang] % HELD_EVERY else held
            rows.append(vector(counts, idf))
            labels.append(languages.index(row.lang))
    weights = fit_ftrl(*fitted, len(languages))
    scores = np.array([value @ weights[at] for at, value in held[0]]).reshape(len(held[0]), len(languages))
    return Model(languages, idf, weights.astype(np.float32), temperature(scores, np.array(held[1], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, held_out, text) -> (doc_id, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = hash_mod("doc_id", 4)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), part.alias("part"))
    labelled = docs.filter("part not in (-1, 2) and lang is not null and text is not null").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", (F.col("part") == 2).alias("held_out"), "text"), train(labelled))
