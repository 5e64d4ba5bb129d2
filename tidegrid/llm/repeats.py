"""Repeated passages through sparse suffix arrays.

A suffix of a document is kept where content selects it: at the position of the smallest hash among the SPAN runs of ANCHOR
words in every window of LEAST words. Two equal passages of LEAST words keep the same suffix, so none is missed, and only about
two in SPAN suffixes are kept. Kept suffixes whose first ANCHOR words occur nowhere else are dropped (counted with map-side
combining). The others carry their words' hashes to the right and to the left as far as a passage of LEAST words can reach. They are
sorted by range, by the words to the right (a suffix array) and once more by the words to the left; in each order every suffix
is compared with its two neighbours, and the match is extended right and left. Neighbours that two sort ranges part are compared in a
second, tiny pass over the ranges' edges (a range of one row has one edge, and no suffix is its own neighbour). A match of at least
LEAST words marks its words as repeated; marks are merged for each document.

A passage class is a kept run of ANCHOR words inside such a match: all documents with a match around that run belong to it. Every
document lists its classes, so all documents that share a passage are found by their common class, in however many documents it
stands, and those classes whose first copy (smallest doc_id, then row, then position) it holds. Two different passages around the same
ANCHOR words are in one class; no two documents with an equal passage of LEAST words are without a common class.

The neighbours in an order give a suffix's longest match to that side. If one neighbour has the longest match to both sides, no
other suffix can add to it. Where none has, though both lengths together would do (different passages share the ANCHOR words), the
windows of LEAST words around all suffixes with these words are compared by their hashes, so nothing is missed.

A passage that very many documents share fills many sort ranges (document and position are part of the sort key), and each suffix
meets two neighbours only, so no pairs of a group are made.

Words are runs of anything but ASCII white space, compared as they stand. The passage may repeat in other documents or in the
same one. Defined results: null and short texts have no passages; rows with a null id take part as partners and are reported
under a null id (they come after all other ids in the order of first copies); repeated rows, and rows that share an id, are rows of
their own and repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, id_text, remove, scratch_path, slices, utf8

LEAST = 50
ANCHOR = 20

#: A kept suffix with the words around it.
SUFFIX = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("after", pa.binary()), ("before", pa.binary())])
SUFFIX_DDL = "key long, rid long, doc_id long, at int, after binary, before binary"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, the same at every position."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _U(_BASE) + hashes[k : k + n]
    out ^= out >> _U(29)
    out *= _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(32))


def kept_positions(runs: np.ndarray, span: int) -> np.ndarray:
    """Positions of the first smallest hash in each window of ``span`` runs."""
    if len(runs) < span:
        return np.empty(0, np.int64)
    found = []
    view = np.lib.stride_tricks.sliding_window_view(runs, span)
    for at in range(0, len(view), 4096):
        part = view[at : at + 4096]
        found.append(np.unique(part.argmin(axis=1) + np.arange(at, at + len(part))))
    return np.unique(np.concatenate(found))


def anchors(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """docs(rid, doc_id, text) -> (key, rid, at): the suffixes that content selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, rids, places = [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), strict=True):
                runs = run_hashes(word_hashes(text), anchor)
                at = kept_positions(runs, least - anchor + 1)
                keys.append(runs[at].view(np.int64))
                rids.append(np.full(len(at), rid, np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, rids, places)], names=["key", "rid", "at"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "key long, rid long, at int")


def contexts(docs: DataFrame, least: int, anchor: int) -> DataFrame:
    """docs(rid, doc_id, text, places) -> one row per place: its key, its right and left words' hashes (32 bits each, as bytes).

    The left words are stored backwards, so that in either direction equal bytes from the start are equal words.
    """
    reach = least - anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows: list[list] = [[] for _ in range(6)]
            for rid, doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                hashes = word_hashes(text)
                runs = run_hashes(hashes, anchor).view(np.int64)
                short = (hashes >> _U(32)).astype(">u4")
                backwards = short[::-1]
                for at in places:
                    after, before = at + anchor, len(short) - at
                    for column, x in zip(rows, (int(runs[at]), rid, doc_id, at, short[after : after + reach].tobytes(), backwards[before : before + reach].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, SUFFIX, strict=True)], schema=SUFFIX)

    return docs.select("rid", "doc_id", "text", "places").mapInArrow(run, SUFFIX_DDL)


def _shared(a: list[bytes], b: list[bytes], reach: int) -> np.ndarray:
    """Number of words from the start in which the two sides of each pair agree."""
    size = 4 * reach
    grids = []
    for side, fill in ((a, b"\x00"), (b, b"\xff")):
        lengths = np.fromiter(map(len, side), np.int64, len(side)) // 4
        grids.append((np.frombuffer(b"".join(x.ljust(size, fill) for x in side), np.uint32).reshape(len(side), reach), lengths))
    same = grids[0][0] == grids[1][0]
    agree = np.where(same.all(axis=1), reach, same.argmin(axis=1))
    return np.minimum(agree, np.minimum(grids[0][1], grids[1][1]))


def _neighbours(rows: pa.Table, least: int, anchor: int) -> list[pa.RecordBatch]:
    """For every two rows side by side with equal keys, a row for each: how far they agree to the left and the right."""
    keys, rids, places = (rows.column(c).to_numpy() for c in ("key", "rid", "at"))
    pairs = np.flatnonzero((keys[1:] == keys[:-1]) & ((rids[1:] != rids[:-1]) | (places[1:] != places[:-1])))
    if not len(pairs):
        return []
    sides = [rows.take(pa.array(pairs)), rows.take(pa.array(pairs + 1))]
    right, left = (pa.array(_shared(*(s.column(c).to_pylist() for s in sides), least - anchor), pa.int32()) for c in ("after", "before"))
    columns = lambda own, other: {**{c: own.column(c).combine_chunks() for c in ("key", "rid", "doc_id", "at")}, "l": left, "r": right, "partner": other.column("doc_id").combine_chunks()}
    return [_filled(len(pairs), edge=pa.array(np.zeros(len(pairs), bool)), **columns(*p)) for p in (sides, sides[::-1])]


PAIR = pa.schema([("l", pa.int32()), ("r", pa.int32()), ("partner", pa.int64()), ("edge", pa.bool_()), *SUFFIX])


def _filled(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in PAIR], schema=PAIR)


def compare(suffixes: DataFrame, order: str, least: int, anchor: int) -> DataFrame:
    """Every suffix with its neighbours in one order: (key, rid, doc_id, at, l, r, partner)."""
    keys = ["key", order, "rid", "at"]

    def edge(row: pa.Table) -> pa.RecordBatch:
        return _filled(1, edge=pa.array([True]), **{f.name: row.column(f.name).combine_chunks() for f in SUFFIX})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            n += batch.num_rows
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).select(SUFFIX.names).cast(SUFFIX)
            if last is None:
                yield edge(rows.slice(0, 1))
            else:
                rows = pa.concat_tables([last, rows])
            for at in range(0, rows.num_rows, 20_000):
                yield from _neighbours(rows.slice(at, 20_001), least, anchor)
            last = rows.slice(rows.num_rows - 1)
        if n > 1:
            yield edge(last)

    schema = f"l int, r int, partner long, edge boolean, {SUFFIX_DDL}"
    spark = suffixes.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = suffixes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    path = scratch_path(spark, f"neighbours-{order}")
    ranged.mapInArrow(run, schema).write.parquet(path)
    first = spark.read.parquet(path)
    # two rows for each range, whatever the size of the data
    edges = first.filter("edge").select(*SUFFIX.names).coalesce(1).sortWithinPartitions(*keys).mapInArrow(run, schema).filter("not edge")
    return first.filter("not edge").unionByName(edges).select("key", "rid", "doc_id", "at", "l", "r", "partner")


def open_keys(pairs: DataFrame, reach: int) -> DataFrame:
    """Keys with a suffix that may have matches beyond its neighbours'."""
    best = pairs.groupBy("rid", "at").agg(F.max("key").alias("key"), F.max("l").alias("l"), F.max("r").alias("r"), F.max(F.col("l") + F.col("r")).alias("both"))
    return best.filter((F.col("l") + F.col("r") >= reach) & (F.col("both") < F.col("l") + F.col("r"))).select("key").distinct()


def equal_windows(suffixes: DataFrame, reach: int) -> DataFrame:
    """(key, rid, doc_id, at, l, r, partner) of all windows around the suffixes that occur more than once, by hash."""
    layout = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("l", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            rows: list[list] = [[] for _ in layout]
            for x in batch.to_pylist():
                after, before, name = x["after"], x["before"], x["key"].to_bytes(8, "big", signed=True)
                for left in range(max(0, reach - len(after) // 4), min(reach, len(before) // 4) + 1):
                    h = xxhash.xxh64_intdigest(before[: 4 * left] + name + after[: 4 * (reach - left)], left)
                    for column, value in zip(rows, (h - (1 << 64) if h >> 63 else h, x["key"], x["rid"], x["doc_id"], x["at"], left), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, layout, strict=True)], schema=layout)

    spark = suffixes.sparkSession
    path = scratch_path(spark, "windows")
    suffixes.select(*SUFFIX.names).mapInArrow(run, "h long, key long, rid long, doc_id long, at int, l int").write.parquet(path)
    windows = spark.read.parquet(path)
    twice = scratch_path(spark, "equal-windows")
    windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("n > 1").drop("n").write.parquet(twice)
    partner = F.when(F.col("low") == F.col("doc_id"), F.col("high")).otherwise(F.col("low"))
    return windows.join(spark.read.parquet(twice), "h").select("key", "rid", "doc_id", "at", "l", (reach - F.col("l")).cast("int").alias("r"), partner.alias("partner"))


def repeated_spans(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a repeated passage: doc_id, rid, spans (first word, end word), n_words in them, a partner's id,
    its passage classes in the order of the text, and those whose first copy it holds."""
    spark = docs.sparkSession
    # texts and numbers are written together: a number depends on how the table is split, which changes with the executors there are
    numbered = scratch_path(spark, "numbered-texts")
    id_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()).write.parquet(numbered)
    docs = spark.read.parquet(numbered)
    selected = scratch_path(spark, "suffixes")
    anchors(docs, least, anchor).write.parquet(selected)
    kept = spark.read.parquet(selected)
    # written, so that the join below reads two plain shuffles and Spark can split a key that very many suffixes share
    repeated = scratch_path(spark, "repeated-keys")
    kept.groupBy("key").count().filter("count > 1").select("key").write.parquet(repeated)
    often = spark.read.parquet(repeated)
    places = kept.join(often, "key").groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("places"))
    suffixes = scratch_path(spark, "contexts")
    contexts(docs.join(places, "rid"), least, anchor).write.parquet(suffixes)
    suffixes = spark.read.parquet(suffixes)
    remove(spark, numbered, selected, repeated)
    pairs = compare(suffixes, "after", least, anchor).unionByName(compare(suffixes, "before", least, anchor))
    reach = least - anchor
    unsettled = scratch_path(spark, "open-keys")
    open_keys(pairs, reach).write.parquet(unsettled)
    more = equal_windows(suffixes.join(spark.read.parquet(unsettled), "key", "left_semi"), reach)
    matches = pairs.filter(F.col("l") + F.col("r") >= reach).unionByName(more)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "rid", "at"))
    # one row for each suffix with a match: its widest reach to either side, which its matches cover without a gap
    found = matches.select("key", "rid", "doc_id", "at", "partner", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + anchor + F.col("r")).alias("e"))
    live = scratch_path(spark, "live-suffixes")
    found.groupBy("rid", "at").agg(F.max("key").alias("key"), F.max("doc_id").alias("doc_id"), F.min("s").alias("s"), F.max("e").alias("e"), F.min("partner").alias("partner")).write.parquet(live)
    live = spark.read.parquet(live)
    firsts = scratch_path(spark, "first-copies")
    live.groupBy("key").agg(first.alias("first")).select("first.rid", "first.at", F.lit(True).alias("is_first")).write.parquet(firsts)
    marks = live.join(spark.read.parquet(firsts), ["rid", "at"], "left")
    mark = F.struct("s", "e", "key", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    gathered = marks.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(mark)).alias("marks"), F.min("partner").alias("partner_id"))
    return merged(gathered)


def merged(gathered: DataFrame) -> DataFrame:
    """gathered(rid, doc_id, marks ascending, partner_id) -> the same with the marks' union and their classes."""
    span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
    names = ("doc_id", "rid", "spans", "n_words", "partner_id", "passages", "first_passages")
    kinds = (pa.int64(), pa.int64(), pa.list_(span), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for x in batch.to_pylist():
                spans: list[list[int]] = []
                for mark in x["marks"]:
                    if spans and mark["s"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], mark["e"])
                    else:
                        spans.append([mark["s"], mark["e"]])
                passages = list(dict.fromkeys(m["key"] for m in x["marks"]))
                firsts = list(dict.fromkeys(m["key"] for m in x["marks"] if m["is_first"]))
                rows.append((x["doc_id"], x["rid"], [{"s": s, "e": e} for s, e in spans], sum(e - s for s, e in spans), x["partner_id"], passages, firsts))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return gathered.mapInArrow(run, "doc_id long, rid long, spans array<struct<s:int,e:int>>, n_words long, partner_id long, passages array<long>, first_passages array<long>")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(documents(spark, sf_dir))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    listed = lambda c: F.array_join(F.transform(c, lambda k: F.lower(F.lpad(F.hex(k), 16, "0"))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.col("n_words").alias("n_repeated_words"), shown.alias("spans"), "partner_id", listed("passages").alias("passages"), listed("first_passages").alias("first_passages"))
