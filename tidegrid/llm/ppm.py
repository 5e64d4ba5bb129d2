"""Language-model scoring by prediction by partial matching, beside a unigram base.

Model: byte contexts of up to ORDER bytes form a trie. A context's own symbols have probability count / (total + kinds); the rest
of the mass escapes to the context without its oldest byte, where the symbols already seen are excluded, down to a uniform choice
among what is left. End of text is a symbol. All training documents are counted and all contexts are kept.

The trie is a set of sparse tables, one for each order: (context, symbol, n). What a context has seen, its suffix has seen too, so
the symbols to exclude at a suffix are those of the context that escaped to it, and the weights of an escape follow from sums over
the two tables:

    at the longest context seen     n / (T + K), escape K / (T + K)
    after an escape from d to c     n / (T' + K'), escape K' / (T' + K'), T' = T(c) - counts in c of d's symbols, K' = K(c) - K(d)

T and K are a context's total and number of kinds; an escape weighs nothing where all SYMBOLS are seen. The most frequent
(context, symbol) pairs of the highest order, MOST_CODES at most, are broadcast with their log probabilities, so most symbols of a text
are a look-up. All others are joined by a shuffle: with the whole table of pairs, and those that no training text has with the tables
of the orders below. Where the bound lies changes the way of the work and no score.

Base: the counts of all training tokens. Tokens that make up at least one in FREQUENT of the corpus (at most FREQUENT of them) are
broadcast; the occurrences of all others are joined with the counts by a shuffle. Token keys are 64-bit hashes.

Defined results: a null text is empty; a document with a null id isn't learned from and isn't held out; repeated rows keep
their rows; without training documents every base probability and every symbol is uniform.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, documents, hash_mod, scratch_path, slices, stored, utf8

ORDER = 5
END = 256
SYMBOLS = 257
#: Pairs of context and symbol that are broadcast, at most.
MOST_CODES = 1 << 20
#: Bits of the broadcast pairs' index.
INDEX_BITS = 21
FREQUENT = 500_000
#: Different tokens or context codes that a task holds before it passes their counts on.
HELD = 400_000
#: Token key of the end of a text; no word is empty.
END_KEY = xxhash.xxh64_intdigest(b"") - (1 << 64 if xxhash.xxh64_intdigest(b"") >> 63 else 0)

TOKEN_ROW, CODE_ROW = 0, 1


def token_key(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def codes_of(text: bytes) -> np.ndarray:
    """For each symbol of the text and its end, context * 512 + symbol; zeros stand before the text."""
    padded = np.concatenate([np.zeros(ORDER, np.int64), np.frombuffer(text, np.uint8), [END]])
    n = len(text) + 1
    code = np.zeros(n, np.int64)
    for k in range(ORDER):
        code = code << 8 | padded[k : k + n]
    return code << 9 | padded[ORDER:]


def count_corpus(texts: DataFrame) -> DataFrame:
    """texts(text) -> (kind, key, n): counts of token keys and of context-and-symbol codes (context * 512 + symbol)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[bytes] = Counter()
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        pending: list[np.ndarray] = []
        n_pending = n_texts = 0

        def rows(kind: int, keys, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

        def fold() -> None:
            nonlocal pending, n_pending, codes
            if pending:
                codes.append(np.unique(np.concatenate(pending), return_counts=True))
                pending, n_pending = [], 0
            if len(codes) > 8:
                keys, where = np.unique(np.concatenate([k for k, _ in codes]), return_inverse=True)
                codes = [(keys, np.bincount(where, np.concatenate([c for _, c in codes])).astype(np.int64))]

        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                text = text or b""
                tokens.update(text.translate(LOWER).split())
                n_texts += 1
                pending.append(codes_of(text))
                n_pending += len(text) + 1
                if n_pending > 4_000_000:
                    fold()
            if len(tokens) > HELD:
                yield rows(TOKEN_ROW, [token_key(w) for w in tokens], list(tokens.values()))
                tokens.clear()
            if codes and sum(len(k) for k, _ in codes) > 4 * HELD:
                for keys, counts in codes:
                    yield rows(CODE_ROW, keys, counts)
                codes = []
        fold()
        yield rows(TOKEN_ROW, [END_KEY, *(token_key(w) for w in tokens)], [n_texts, *tokens.values()])
        for keys, counts in codes:
            yield rows(CODE_ROW, keys, counts)

    counted = texts.select("text").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n > 0")


class Codes:
    """Log10 probabilities of the broadcast pairs of context and symbol, found by a hash of the pair."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        place = self._place(codes)
        order = np.argsort(place, kind="stable")
        self.codes, self.values = np.append(codes[order], -1), np.append(values[order], 0.0)
        self.start = np.searchsorted(place[order], np.arange((1 << INDEX_BITS) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))

    @staticmethod
    def _place(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - INDEX_BITS)

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """Sum over the symbols whose pair is here; the other pairs and how often each occurs."""
        total, missing = 0.0, []
        every = codes_of(text)
        for at in range(0, len(every), 1 << 18):
            codes = every[at : at + (1 << 18)]
            slot = self.start[self._place(codes).astype(np.int64)]
            open_, found = np.arange(len(codes)), np.full(len(codes), -1, np.int32)
            for k in range(self.longest):
                hit = self.codes[np.minimum(slot[open_] + k, len(self.codes) - 1)] == codes[open_]
                found[open_[hit]] = slot[open_[hit]] + k
                open_ = open_[~hit]
                if not len(open_):
                    break
            total += float(self.values[found[found >= 0]].sum(dtype=np.float64))
            missing.append(codes[found < 0])
        return total, *np.unique(np.concatenate(missing), return_counts=True)


class Trie:
    """The sparse tables of all orders: counts (context, symbol, n) and totals (context, total, kinds)."""

    def __init__(self, counts: DataFrame) -> None:
        code = F.col("key")
        top = counts.filter(F.col("kind") == CODE_ROW).select(F.shiftright(code, 9).alias("context"), code.bitwiseAND(F.lit(511).cast("long")).cast("int").alias("symbol"), "n")
        self.counts = {ORDER: top}
        for m in range(ORDER - 1, -1, -1):
            shorter = self.counts[m + 1].groupBy(suffix("context", m).alias("context"), "symbol").agg(F.sum("n").alias("n"))
            self.counts[m] = stored(shorter, f"order-{m}")
        self.totals = {m: stored(c.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), f"totals-{m}") for m, c in self.counts.items()}
        escape = F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)
        valued = self.counts[ORDER].join(self.totals[ORDER], "context")
        self.pairs = stored(valued.select((F.shiftleft("context", 9) + F.col("symbol")).alias("code"), "n", F.log10(F.col("n") / (F.col("total") + escape)).alias("value")), "pairs")

    def frequent(self, most: int) -> Codes:
        """The most frequent pairs, ``most`` at most: whole classes of an eighth of an octave of frequency."""
        kind = F.floor(F.log2("n") * 8).cast("int")
        sizes = {r["class"]: r["count"] for r in self.pairs.groupBy(kind.alias("class")).count().collect()}
        bound, held = max(sizes, default=0) + 1, 0
        for k in sorted(sizes, reverse=True):
            held += sizes[k]
            if held > most:
                break
            bound = k
        found = self.pairs.filter(kind >= bound).select("code", "value").toArrow()  # ``most`` rows at most
        return Codes(found.column(0).to_numpy(), found.column(1).to_numpy())

    def steps(self, order: int, needed: DataFrame) -> DataFrame:
        """needed(context), distinct -> (context, own, escape, w, e, symbols) of those that were seen.

        own and escape: log10 of the weight of one count and of the escape at the context itself; w and e: the same at its
        suffix after an escape to there; symbols: its own counts.
        """
        own = self.counts[order].join(needed, "context", "left_semi")
        total, kinds = F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")
        symbols = F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("symbols")
        own_weight = (-F.log10(F.col("total") + F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0))).alias("own")
        out = F.when(F.col("kinds") < SYMBOLS, F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))).alias("escape")
        if order == 0:
            left = F.when(F.col("kinds") < SYMBOLS, -F.log10(F.lit(SYMBOLS) - F.col("kinds")))
            return own.groupBy("context").agg(total, kinds, symbols).select("context", own_weight, out, F.lit(0.0).alias("w"), left.alias("e"), "symbols")
        below = self.counts[order - 1].select(F.col("context").alias("suffix"), "symbol", F.col("n").alias("m"))
        both = own.withColumn("suffix", suffix("context", order - 1)).join(below, ["suffix", "symbol"])
        sums = both.groupBy("context").agg(F.min("suffix").alias("suffix"), total, kinds, F.sum("m").alias("excluded"), symbols)
        parent = self.totals[order - 1].select(F.col("context").alias("suffix"), F.col("total").alias("all"), F.col("kinds").alias("all_kinds"))
        rest, more = F.col("all") - F.col("excluded"), F.col("all_kinds") - F.col("kinds")
        escape = F.when(more < SYMBOLS - F.col("kinds"), more).otherwise(0)
        w = F.when(rest > 0, -F.log10(rest + escape)).otherwise(0.0)
        e = F.when(rest > 0, F.log10(escape / (rest + escape))).otherwise(0.0)  # null where nothing is left to escape to
        return sums.join(parent, "suffix").select("context", own_weight, out, w.alias("w"), e.alias("e"), "symbols")

    def values(self, codes: DataFrame) -> DataFrame:
        """codes(code), distinct pairs that no training text has -> (code, value): their log10 probabilities."""
        rows = codes.select("code", F.shiftright("code", 9).alias("context"), F.col("code").bitwiseAND(F.lit(511).cast("long")).cast("int").alias("symbol"))
        rows = rows.withColumns({"value": F.lit(0.0), "entered": F.lit(False), "done": F.lit(False), "w": F.lit(0.0), "e": F.lit(0.0)})
        for m in range(ORDER, -1, -1):
            rows = rows.withColumn("context", suffix("context", m))
            steps = self.steps(m, rows.filter("not done").select("context").distinct()).select("context", F.struct("own", "escape", "w", "e", "symbols").alias("x"))
            joined = rows.join(F.broadcast(steps) if m < 2 else steps, "context", "left")  # one or at most 256 rows below order two
            n, x = F.log10(F.col("x.symbols")[F.col("symbol")]), F.col("x")
            going = ~F.col("done") & x.isNotNull()
            first = F.when(n.isNotNull(), n + x["own"]).otherwise(x["escape"])
            later = F.when(n.isNotNull(), n + F.col("w")).otherwise(F.col("e"))
            step = F.when(F.col("entered"), later).otherwise(first)
            rows = stored(joined.select(
                "code", "context", "symbol",
                F.when(going, F.col("value") + step).otherwise(F.col("value")).alias("value"),
                (F.col("entered") | x.isNotNull()).alias("entered"),
                (F.col("done") | (going & n.isNotNull())).alias("done"),
                F.when(going, x["w"]).otherwise(F.col("w")).alias("w"),
                F.when(going, x["e"]).otherwise(F.col("e")).alias("e"),
            ), f"values-{m}")
        uniform = F.when(F.col("entered"), F.col("e")).otherwise(-math.log10(SYMBOLS))
        return rows.select("code", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + uniform).alias("value"))


def suffix(context: str, order: int) -> Column:
    return F.col(context).bitwiseAND(F.lit((1 << 8 * order) - 1).cast("long"))


def score_documents(docs: DataFrame, held_out: Column, learned: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out and learned are conditions on the columns of ``docs``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(learned, F.lit(False)).alias("learned"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "corpus-counts")
    count_corpus(docs.filter("learned")).write.partitionBy("kind").parquet(path)
    counts = spark.read.schema("key long, n long, kind int").parquet(path)
    tokens = counts.filter(F.col("kind") == TOKEN_ROW).select("key", "n")
    n_all, n_kinds = (x or 0 for x in tokens.agg(F.sum("n"), F.count("n")).first())
    frequent = {r.key: math.log10(r.n + 1) for r in tokens.filter(F.col("n") * FREQUENT >= n_all).toLocalIterator()}
    trie = Trie(counts)
    shared = spark.sparkContext.broadcast((frequent, trie.frequent(MOST_CODES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, known_codes = shared.value
        names: dict[bytes, float] = {}
        end = by_key.get(END_KEY)
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for text in utf8(batch.column(3)):
                text = text or b""
                words = text.translate(LOWER).split()
                logs, known, rare_keys, rare_counts = 0.0, 0, [], []
                for word, n in Counter(words).items():
                    value = names.get(word)
                    if value is None:
                        key = token_key(word)
                        value = by_key.get(key)
                        if value is None:
                            rare_keys.append(key)
                            rare_counts.append(n)
                            continue
                        names[word] = value
                    logs += n * value
                    known += n
                if end is None:
                    rare_keys.append(END_KEY)
                    rare_counts.append(1)
                else:
                    logs, known = logs + end, known + 1
                score, codes, code_counts = known_codes.score(text)
                for column, x in zip(out, (len(words) + 1, logs, known, score, rare_keys, rare_counts, codes, code_counts), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "held_out", "n_tokens", "logs", "known", "score", "rare_keys", "rare_counts", "codes", "code_counts"])

    scored = scratch_path(spark, "scored")
    schema = "doc_id long, held_out boolean, n_tokens long, logs double, known long, score double, rare_keys array<long>, rare_counts array<int>, codes array<long>, code_counts array<long>"
    docs.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()).write.parquet(scored)
    shared.unpersist()
    scored_rows = spark.read.parquet(scored)
    rare = scored_rows.select("rid", F.explode(F.arrays_zip("rare_keys", "rare_counts")).alias("x")).select("rid", F.col("x.rare_keys").alias("key"), F.col("x.rare_counts").alias("c"))
    joined = rare.join(tokens, "key").groupBy("rid").agg(F.sum(F.col("c") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(F.col("c").cast("long")).alias("more_known"))
    whole = scored_rows.drop("rare_keys", "rare_counts", "codes", "code_counts").join(joined, "rid", "left")
    codes = scored_rows.select("rid", F.explode(F.arrays_zip("codes", "code_counts")).alias("x")).select("rid", F.col("x.codes").alias("code"), F.col("x.code_counts").alias("c"))
    valued = stored(codes.join(trie.pairs.select("code", "value"), "code", "left"), "other-pairs")
    unseen = stored(valued.filter("value is null").select("code").distinct(), "unseen-pairs")
    late = valued.filter("value is null").drop("value").join(trie.values(unseen), "code")
    every = valued.filter("value is not null").select("rid", "c", "value").unionByName(late.select("rid", "c", "value"))
    more = every.groupBy("rid").agg(F.sum(F.col("c") * F.col("value")).alias("more_score"))
    whole = whole.join(more, "rid", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    below = math.log10(n_all + 1 * (n_kinds + 1))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        "score",
    )


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = hash_mod("doc_id", 7)
    return score_documents(documents(spark, sf_dir), part == 2, ~part.isin(2, -1))
