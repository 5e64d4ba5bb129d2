"""Benchmark decontamination by a prefix-filtered set join.

Every window of 10 consecutive item words (or a whole shorter item) is a set of word shingles that must all occur for
the window to occur, so by the prefix principle one shingle of it, the rarest, is enough to find all candidates. The
rarity order comes from counts of the benchmark's shingles over all documents; a window with a shingle that no document
holds can't occur and is dropped. Documents are joined with the windows on that one shingle's hash. A pair gives the
window's place; the positional bound (it must start at or after word 0) and the length bound (it must end in the
document) prune it; then the words themselves are compared.

The texts are read twice, whatever the benchmark's size. A Bloom filter of the benchmark's shingles, of at most
MOST_BITS bits, keeps all other shingles out of the shuffles; where it fills up, more rows are shuffled and the results
stay. Windows whose rarest shingle makes HOT_SHARE of all words, at most HOT_MOST of them, would be hot keys: they are
broadcast and found inside the tasks. All others go through the join, so the two bounds change the way of the work alone.

Defined results: a null text has no words; a null item_id counts for hits but is listed nowhere; repeated item rows
count once; each document row gets its own result row, repeated or not; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import LOWER, documents, id_text, slices, stored, table, utf8
from tidegrid.llm.repeats import run_hashes, word_hashes

WINDOW = 10
SHINGLE = 3
#: The Bloom filter's bits: about 16 for each shingle of the benchmark, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: A prefix of this share of all words is a hot key; so many windows of such prefixes are broadcast.
HOT_SHARE, HOT_MOST = 1e-5, 20_000
#: Rows of a batch that a task hands on.
OUT_ROWS = 8192

#: After lower-casing, every ASCII byte that is not a letter or digit parts words.
_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)


def parted(text: bytes | None) -> bytes:
    """Words of lower-case ASCII letters, digits and non-ASCII characters, with spaces between."""
    return text.translate(_SPLIT) if text else b""


def shingle_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    return run_hashes(hashes, size).view(np.int64)


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """benchmark(item_id, text) -> (item, gram, length, codes), one row for each window: its words and its shingles' hashes."""
    schema = pa.schema([("item", pa.string()), ("gram", pa.string()), ("length", pa.int32()), ("codes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = parted(text).split()
                if not words:
                    continue
                length = min(window, len(words))
                size = min(SHINGLE, length)
                codes = shingle_codes(word_hashes(b" ".join(words)), size)
                starts = range(len(words) - length + 1)
                for at in range(0, len(starts), OUT_ROWS):
                    some = starts[at : at + OUT_ROWS]
                    rows = [[item] * len(some), [b" ".join(words[s : s + length]).decode() for s in some], [length] * len(some), [codes[s : s + length - size + 1] for s in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, schema.types, strict=True)], schema=schema)

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).distinct()
    return items.mapInArrow(run, "item string, gram string, length int, codes array<long>")


class Filter:
    """A Bloom filter of 64-bit codes with two bits each."""

    def __init__(self, codes: DataFrame) -> None:
        """Filled from codes(code), distinct; at most MOST_BITS / 64 rows reach the driver."""
        self.bits = LEAST_BITS
        n = codes.count()
        while self.bits < min(MOST_BITS, 16 * n):
            self.bits *= 2
        last = self.bits - 1
        places = codes.select(F.explode(F.array(F.col("code").bitwiseAND(last), F.shiftrightunsigned("code", 32).bitwiseAND(last))).alias("bit"))
        filled = places.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("on")).toArrow()
        self.cells = np.zeros(self.bits // 64, np.uint64)
        self.cells[filled["cell"].to_numpy()] = filled["on"].to_numpy().view(np.uint64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that may be in the set."""
        code, last = codes.view(np.uint64), np.uint64(self.bits - 1)
        found = np.flatnonzero(self._on(code & last))
        return found[self._on((code[found] >> np.uint64(32)) & last)]

    def _on(self, bits: np.ndarray) -> np.ndarray:
        return (self.cells[bits >> np.uint64(6)] >> (bits & np.uint64(63)) & np.uint64(1)).astype(bool)


def shingle_counts(docs: DataFrame, known: Filter, sizes: list[int]) -> DataFrame:
    """docs(text) -> (code, n): how often each shingle that may be the benchmark's occurs; n of a null code is the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in slices(batches):
            found = []
            for text in utf8(batch.column(0)):
                hashes = word_hashes(parted(text))
                total += len(hashes)
                for size in sizes:
                    codes = shingle_codes(hashes, size)
                    found.append(codes[shared.value.places(codes)])
            codes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n, pa.int64())], names=["code", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def search(docs: DataFrame, sizes: list[int], hot: list, known: Filter, window: int) -> DataFrame:
    """docs(rid, doc_id, text) -> rows of four kinds, told by the columns that aren't null.

    n_words: the document itself. (s, e): a run of words inside hot windows. gram without code: a hot window that occurs.
    code: a place s where a window of the join may lie, with the words around it and how many of them come before.
    """
    by_code: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
    for row in hot:
        by_code[row.code].append((row.offset, row.length, row.gram.encode()))
    # only the least frequent of the hot prefixes may have windows in the join too
    local_only = {row.code for row in hot if row.n > hot[-1].n}
    shared = docs.sparkSession.sparkContext.broadcast((dict(by_code), local_only, known))
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("gram", pa.string()), ("code", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.string()))])

    def rows_of(rid: int, doc_id: int | None, text: bytes | None) -> Iterator[tuple]:
        windows, local, found = shared.value
        joined = parted(text)
        hashes = word_hashes(joined)
        n = len(hashes)
        hit, grams, words = np.zeros(n, bool), set(), None
        for size in sizes:
            codes = shingle_codes(hashes, size)
            for at in found.places(codes).tolist():
                words, code = words or joined.split(), int(codes[at])
                for offset, length, gram in windows.get(code, ()):
                    start = at - offset
                    if start >= 0 and start + length <= n and b" ".join(words[start : start + length]) == gram:
                        hit[start : start + length] = True
                        grams.add(gram)
                if code not in local:
                    first = max(0, at - window + 1)
                    around = [w.decode() for w in words[first : at + window]]
                    yield rid, None, None, at, None, None, code, at - first, around
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            yield rid, None, None, s, e, None, None, None, None
        for gram in grams:
            yield rid, None, None, None, None, gram.decode(), None, None, None
        yield rid, doc_id, n, None, None, None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        for batch in slices(batches):
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                for out in rows_of(*row):
                    held.append(out)
                    if len(held) >= OUT_ROWS:
                        yield batch_of()
                        held.clear()
        if held:
            yield batch_of()

    return docs.mapInArrow(run, "rid long, doc_id long, n_words long, s int, e int, gram string, code long, before int, words array<string>")


def covered(runs: Column) -> Column:
    """Number of words in sorted runs that may overlap."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda z, x: F.struct(F.greatest(z["end"], x["e"]).alias("end"), (z["n"] + F.greatest(x["e"] - F.greatest(x["s"], z["end"]), F.lit(0))).alias("n"))
    return F.aggregate(runs, state, step, lambda z: z["n"])


def prefixes(grams: DataFrame, counted: DataFrame) -> DataFrame:
    """grams(gram, length, codes), counted(code, n) -> (gram, length, n, offset, code): each window's rarest shingle, the first of equals."""
    each = grams.select("gram", "length", F.posexplode("codes").alias("offset", "code")).join(counted, "code", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "code"))
    return each.groupBy("gram", "length").agg(rarest.alias("p")).select("gram", "length", "p.n", "p.offset", "p.code").filter("n > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, hot_share: float = HOT_SHARE, hot_most: int = HOT_MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, those inside an item's window, and the items that occur."""
    docs = id_text(docs, id_col, text_col)
    windows = stored(item_windows(benchmark, window), "item-windows")
    grams = stored(windows.select("gram", "length", "codes").dropDuplicates(["gram"]), "windows")
    sizes = sorted(row.size for row in grams.select(F.least("length", F.lit(SHINGLE)).alias("size")).distinct().collect())  # at most SHINGLE rows
    known = Filter(stored(grams.select(F.explode("codes").alias("code")).distinct(), "item-shingles"))
    counted = stored(shingle_counts(docs, known, sizes), "shingle-counts")
    total = counted.filter("code is null").agg(F.sum("n")).first()[0] or 0
    chosen = stored(prefixes(grams, counted), "prefixes")
    hot = chosen.filter(F.col("n") >= hot_share * total).orderBy(F.col("n").desc(), "gram").limit(hot_most).collect() if hot_most else []
    last = (hot[-1].n, hot[-1].gram) if hot else None
    # all that comes behind the last hot window in the same order
    rest = chosen if last is None else chosen.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("gram") > last[1])))
    rows = search(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), sizes, hot, Filter(chosen.select("code").distinct()), window)
    rows = stored(rows, "search")

    candidates = rows.filter("code is not null").select("rid", "code", "s", "before", "words")
    start = F.col("before") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.size("words"))
    same = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("gram")
    matched = candidates.join(rest.select("code", "gram", "length", "offset"), "code").filter(inside & same)
    place = F.col("s") - F.col("offset")
    matched = stored(matched.select("rid", place.alias("s"), (place + F.col("length")).alias("e"), "gram"), "matches")

    runs = rows.filter("e is not null").select("rid", "s", "e").unionByName(matched.select("rid", "s", "e"))
    hits = runs.groupBy("rid").agg(covered(F.sort_array(F.collect_list(F.struct("s", "e")))).alias("n_hit"))
    held = stored(rows.filter("gram is not null").select("rid", "gram").unionByName(matched.select("rid", "gram")).distinct(), "held-windows")
    names = stored(windows.filter("item is not null").select("gram", "item").distinct(), "item-names")
    items = held.join(names, "gram").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    every = rows.filter("n_words is not null").select("rid", "doc_id", "n_words").join(hits, "rid", "left").join(items, "rid", "left")
    none = F.array().cast("array<string>")
    return every.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM iw WHERE len(words) > 0),
at_item AS (SELECT item_id, size, words, unnest(range(len(words) - size + 1)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[i + 1 : i + size], ' ') AS gram FROM at_item),
sizes AS (SELECT DISTINCT size FROM windows),
at_doc AS (SELECT doc_id, size, words, unnest(range(len(words) - size + 1)) AS i FROM w, sizes WHERE len(words) >= size),
grams AS (SELECT doc_id, size, i, array_to_string(words[i + 1 : i + size], ' ') AS gram FROM at_doc),
found AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.gram = x.gram AND g.size = x.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN items t ON w.doc_id = t.doc_id
"""
