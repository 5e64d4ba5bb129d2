"""Best-fit packing of tokenised documents into fixed-length sequences.

Each task tokenises its documents and packs the pieces online: a fixed number of open bins is kept in a
bitset keyed by free space, a piece goes to the open bin with the least sufficient space, and when a new bin
would exceed the number of open bins the fullest is closed first. No state outlives a task, so a lost executor costs
only its own tasks. What is still open when a task ends (OPEN_BINS at most) is marked in the written rows; the pieces in
these bins are then packed once more, about TAILS of them in a task, so only the tails are shuffled and tasks leave few
part-filled sequences.

Defined results: a null text is an empty document (one piece, the separator alone); rows are packed one by one, so
repeated rows and repeated ids each get their own pieces; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.common import documents, id_text, slices, stored

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces in open bins of ended tasks that are packed again by one task, about.
TAILS = 50_000
#: Chunks and words whose ids a worker remembers; either memory is emptied when it is full.
CACHED_WORDS = 150_000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Bounded-space best fit. The bit s of ``bits`` is set while some open bin has s free places."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.n_open, self.n_bins = 0, 0, 0
        #: bins closed since the caller emptied the list: full ones, and those that made room
        self.closed: list[int] = []
        self.by_space: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        chosen = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return chosen

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.n_open >= self.most_open:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            space, chosen = self.capacity, self.n_bins
            self.n_bins += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(chosen)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(chosen)
        return chosen, self.capacity - space


class WordEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its chunks between
    ASCII white space in turn. A chunk of plain Latin letters, digits and ASCII marks is lower-cased and split into
    the tokenizer's words here, and each word is encoded once; any other chunk goes through the whole tokenizer. All this
    holds for tokenizers with the STEPS below alone; with any other file, whole texts go through the tokenizer.
    """

    # The steps before the model, as the tokenizer's file names them.
    STEPS = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )

    #: The tokenizer's own word pattern, for text of PLAIN alone.
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, tokenizer_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        marks = all(t["content"].startswith("<|") and not t["single_word"] and not t["normalized"] for t in spec["added_tokens"])
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"]) == self.STEPS and marks and spec["model"]["type"] == "BPE"
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_names = {b: 256 + n for n, b in enumerate(hidden)}

    def _word(self, word: str) -> bytes:
        coded = self.words.get(word)
        if coded is None:
            named = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_names)
            coded = array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            self.words[word] = coded
        return coded

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk.lower())
        if self.PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self._word, self.WORDS.findall(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not self.by_word:
            return array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()
        chunks = (text or "").replace("\n", " ").split(" ")
        known = self.chunks
        if len(known) >= CACHED_WORDS:
            known.clear()
        for chunk in set(chunks).difference(known):
            known[chunk] = self._chunk(chunk)
        return b"".join(map(known.__getitem__, chunks))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(tokenizer_path: str) -> WordEncoder:
    """One encoder for each worker process, so that its words stay known from task to task."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "is_open")
KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())


def _batch(rows: list[tuple], names: tuple, kinds: tuple) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def packed_again(tails: DataFrame, capacity: int, open_bins: int, in_task: int) -> DataFrame:
    """The pieces of open bins, as rows of SCHEMA, in new sequences; mixed lengths, as they come, fill bounded open bins best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, open_bins), (1 << 62) + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            places = [bins.place(length) for length in batch.column("length").to_pylist()]
            bins.closed.clear()
            own = pa.array([base + b for b, _ in places], pa.int64()), pa.array([at for _, at in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES[:5]), *own], names=list(NAMES[:7]))

    tasks = max(1, -(-tails.count() // in_task))
    dealt = tails.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")
    return dealt.select(*NAMES[:5]).mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, separator: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", tails_in_task: int = TAILS) -> DataFrame:
    """One row per piece: its place in the document, its checksum, its sequence and the offset there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_for(tokenizer_path), OpenBins(capacity, open_bins)
        base, end = TaskContext.get().partitionId() << 40, array("I", [separator]).tobytes()
        waiting: dict[int, list[tuple]] = {}  # pieces of the open bins
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                total = len(ids) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    length = min(capacity, total - start)
                    chosen, offset = bins.place(length)
                    waiting.setdefault(chosen, []).append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), base + chosen, offset, False))
                    for done in bins.closed:
                        rows += waiting.pop(done)
                    bins.closed.clear()
            yield _batch(rows, NAMES, KINDS)
        for pieces in waiting.values():
            yield _batch([(*p[:-1], True) for p in pieces], NAMES, KINDS)

    packed = stored(id_text(docs, id_col, text_col).mapInArrow(run, f"{SCHEMA}, is_open boolean"), "packed")
    return packed.filter("not is_open").drop("is_open").unionByName(packed_again(packed.filter("is_open"), capacity, open_bins, tails_in_task))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
