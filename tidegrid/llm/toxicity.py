"""Toxicity by a counterfactually regularised classifier.

A document's features are its distinct words and the beginnings of these words, hashed into a fixed number of slots; each feature
counts once. Features that depend on the label (chi squared of at least LEAST_CHI, in at least LEAST_DOCS documents) enter a logistic regression, fitted
by follow-the-regularised-leader (L1 makes it sparse) on a bounded sample of labelled documents. The counterfactual part: in every sentence of a labelled document that names a group, each identity term is swapped with the
others of its kind and with the kind's neutral word; the difference of the two documents' features is kept beside the document, and the
fit penalises the square of the score (the logit) that this difference changes. So terms that only appear more often in toxic
documents earn no score of their own, and neutral mentions are not flagged for them.

At most a third of the sample is toxic; the intercept is moved to the classes' shares among all labelled documents, and a temperature is
calibrated on the part held back. Every document is scored whole: its features are added up in the tasks.

Bounds of the fit: about SAMPLE_DOCS documents, of at most SAMPLE_CHARS characters, chosen by a hash of the id; at most SWAPS
counterfactuals of each, those with the smallest hashes. Shares of the classes count all labelled documents.

Defined results: a null or empty text has the score of no word at all; a label counts if any row of ``labels`` for the id says toxic; null labels and
ids aren't learned from; a document with a null id isn't held out; repeated rows keep their rows. Without any label the score is 0,
with one class only all documents get its smoothed share.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, hash_mod, hashed_share, slices, stored, table

SLOT_BITS = 20
#: Lengths of the beginnings of a word that are features beside the word.
STEMS = (4, 5, 6, 7, 8)
#: Labelled documents that are fitted and calibrated on (about), a third of them toxic where there are enough.
SAMPLE_DOCS = 12_000
LEAST_CHI, LEAST_DOCS = 10.0, 3
SAMPLE_CHARS = 50_000
SWAPS = 8
HELD_EVERY = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.01
#: Weight of the squared change of the logit under a swap.
FAIRNESS = 50.0
#: A score from here up is predicted toxic.
THRESHOLD = 0.3
#: Words whose weight a worker remembers.
REMEMBERED = 1 << 18

#: Identity terms by kind and, first, the neutral word that can stand for each. A parameter: other lists can be given.
IDENTITIES: Mapping[str, Sequence[str]] = {
    "belief": ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    "believer": ("believer", "christian", "muslim", "jew", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    "origin": ("local", "american", "mexican", "chinese", "indian", "african", "arab", "german", "french", "spanish", "polish", "turkish", "russian", "jewish"),
    "origins": ("locals", "americans", "mexicans", "indians", "africans", "arabs", "germans", "poles", "turks", "russians", "asians", "europeans"),
    "skin": ("many", "black", "white", "brown"),
    "gender": ("people", "women", "men", "girls", "boys"),
    "person": ("person", "woman", "man", "girl", "boy"),
    "love": ("private", "gay", "straight", "lesbian", "bisexual", "queer", "transgender", "heterosexual", "homosexual"),
    "status": ("residents", "immigrants", "refugees", "migrants", "foreigners", "natives"),
    "ability": ("able", "disabled", "blind", "deaf", "autistic"),
    "age": ("adult", "old", "young", "elderly", "teenage"),
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def slots_of(word: str) -> list[int]:
    """The slots of a word and of its beginnings."""
    mask = (1 << SLOT_BITS) - 1
    return [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) & mask, *(zlib.crc32(word[:n].encode("utf-8", "surrogatepass")) & mask for n in STEMS if len(word) >= n)]


def slots(found: set[str]) -> set[int]:
    """The slots of all features of a set of words; a beginning that many words share counts once."""
    return {s for word in found for s in slots_of(word)}


def kinds_of(identities: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Each term (no neutral word) with what it is swapped for."""
    return {term: [x for x in terms if x != term] for terms in identities.values() for term in terms[1:]}


def counterfactuals(text: str, others: Mapping[str, Sequence[str]], most: int = SWAPS) -> list[list[int]]:
    """Differences of the document's features and those after a swap of one identity term in its sentences, as slots: s + 1 where
    the swap takes a feature away, -(s + 1) where it brings one."""
    sentences = [WORD.findall(s.lower()) for s in SENTENCE.findall(text)]
    terms = sorted({w for s in sentences for w in s if w in others})
    if not terms:
        return []
    found = words(text)
    before = slots(found)
    swaps = sorted((zlib.crc32(f"{a} {b} {len(text)}".encode()), a, b) for a in terms for b in others[a])[:most]
    out = []
    for _, a, b in swaps:
        swapped = {x for s in sentences for x in ((b if w == a else w) for w in s)}
        after = slots(swapped)
        if change := [*(s + 1 for s in sorted(before - after)), *(-s - 1 for s in sorted(after - before))]:
            out.append(change)
    return out


def features(sample: DataFrame, identities: Mapping[str, Sequence[str]]) -> DataFrame:
    """sample(draw, doc_id, toxic, text) -> (draw, doc_id, toxic, slots, swaps), found in the tasks."""
    others = kinds_of(identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(3).to_pylist()
            own = [sorted(slots(words(t))) for t in texts]
            swaps = [counterfactuals(t, others) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["draw", "doc_id", "toxic", "slots", "swaps"])

    return sample.mapInArrow(run, "draw long, doc_id long, toxic int, slots array<int>, swaps array<array<int>>")


@dataclass
class Example:
    slots: np.ndarray
    toxic: int
    swaps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (slots, +1 or -1)

    @classmethod
    def of(cls, row) -> Example:
        swaps = [np.array(s) for s in row.swaps]
        return cls(np.array(row.slots, np.int64), int(row.toxic), [(np.abs(s) - 1, np.sign(s).astype(float)) for s in swaps])


def selected(examples: Sequence[Example]) -> np.ndarray:
    """Whether each slot depends on the label, by its documents in the two classes."""
    found = np.zeros((2, 1 << SLOT_BITS))
    for x in examples:
        found[x.toxic, x.slots] += 1
    share = sum(x.toxic for x in examples) / max(len(examples), 1)
    docs = found.sum(axis=0)
    expected = np.maximum(docs * share, 1e-12)
    return ((found[1] - expected) ** 2 >= LEAST_CHI * expected * (1 - share)) & (docs >= LEAST_DOCS)


def only(examples: Sequence[Example], kept: np.ndarray) -> list[Example]:
    """The examples with those features alone."""
    return [Example(x.slots[kept[x.slots]], x.toxic, [(at[kept[at]], sign[kept[at]]) for at, sign in x.swaps]) for x in examples]


def fit_ftrl(examples: Sequence[Example], fairness: float = FAIRNESS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, intercept) of least log loss plus ``fairness`` times the mean squared change of the logit under the swaps."""
    z, n = np.zeros(1 << SLOT_BITS), np.zeros(1 << SLOT_BITS)
    bias, bias_n = 0.0, 0.0

    def leader(at) -> np.ndarray:
        here = z[at]
        return np.where(np.abs(here) <= L1, 0.0, -(here - np.sign(here) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    def step(at: np.ndarray, slope: np.ndarray, w: np.ndarray) -> None:
        grown = n[at] + slope * slope
        z[at] += slope - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown

    order = np.random.default_rng(12)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            x = examples[k]
            w = leader(x.slots)
            off = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()) + bias)))) - x.toxic
            step(x.slots, np.full(len(w), off), w)
            bias_n += off * off
            bias -= ALPHA / (BETA + math.sqrt(bias_n)) * off
            for at, sign in x.swaps:
                w = leader(at)
                step(at, 2 * fairness / len(x.swaps) * float(w @ sign) * sign, w)
    return leader(slice(None)), bias


def temperature(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The temperature of least log loss on held-back logits; 1 where one class is missing."""
    if len(set(toxic.tolist())) < 2:
        return 1.0
    tried = np.exp(np.linspace(np.log(0.5), np.log(10), 80))
    loss = [np.logaddexp(0, np.where(toxic == 1, -logits, logits) / t).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


@dataclass
class Model:
    weights: dict[int, float]  # of the slots that have one
    bias: float
    heat: float

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def weighted(self, word: str) -> tuple[int, ...]:
        """The word's slots that have a weight."""
        found = self.known.get(word)
        if found is None:
            found = tuple(s for s in slots_of(word) if s in self.weights)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        hit = {s for word in words(text) for s in self.weighted(word)}
        logit = (self.bias + math.fsum(self.weights[s] for s in hit)) / self.heat
        return 0.0 if logit < -700 else 1 / (1 + math.exp(-min(700.0, logit)))


def constant(share: float) -> Model:
    return Model({}, -800.0 if share <= 0 else math.log(share / (1 - share)), 1.0)


def train(labelled: DataFrame, labels: DataFrame, identities: Mapping[str, Sequence[str]] = IDENTITIES, fairness: float = FAIRNESS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """labelled(doc_id, text) and labels(doc_id, toxic), both without null ids; other texts than those with a label play no part."""
    labels = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return constant((sizes.get(1, 0) + 0.5) / (total + 1) if total else 0.0)
    toxic = min(sizes[1], sample_docs // 3)
    chosen = F.when(F.col("toxic") == 1, hashed_share(toxic, sizes[1], 23, "doc_id")).otherwise(hashed_share(sample_docs - toxic, sizes[0], 23, "doc_id"))
    drawn = labels.filter(chosen)
    texts = labelled.filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(drawn), "doc_id")  # about sample_docs rows of two numbers
    found = stored(features(texts.select(F.xxhash64("doc_id", F.lit(31)).alias("draw"), "doc_id", "toxic", "text"), identities), "toxicity-sample")
    examples = [Example.of(row) for row in found.orderBy("draw", "doc_id", "slots").toLocalIterator()]
    examples = only(examples, selected(examples))
    by_class = {k: [x for x in examples if x.toxic == k] for k in (0, 1)}
    fitted = [x for own in by_class.values() for i, x in enumerate(own, 1) if i % HELD_EVERY or len(own) < HELD_EVERY]
    held = [x for own in by_class.values() for i, x in enumerate(own, 1) if not i % HELD_EVERY]
    if not all(by_class.values()):
        return constant((sizes[1] + 0.5) / (total + 1))
    weights, bias = fit_ftrl(fitted, fairness)
    heat = temperature(np.array([weights[x.slots].sum() + bias for x in held]), np.array([x.toxic for x in held], int))
    shares = math.log(sizes[1] / sizes[0]) - math.log(len(by_class[1]) / len(by_class[0]))
    some = np.flatnonzero(weights)
    return Model(dict(zip(some.tolist(), weights[some].tolist(), strict=True)), bias + shares * heat, heat)


def predict(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, held_out, text) -> (doc_id, held_out, score, predicted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([shared.value.score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = hash_mod("doc_id", 4)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.alias("part"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(hash_mod("doc_id", 4).isin(0, 1, 3))
    model = train(docs.filter("part not in (-1, 2) and text is not null").select("doc_id", "text"), labels)
    return predict(docs.select("doc_id", (F.col("part") == 2).alias("held_out"), "text"), model)
