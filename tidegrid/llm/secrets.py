"""Secrets: regular base rules plus a linear-chain conditional random field.

Base spans follow fixed patterns. A linear-chain CRF over the tokens of the whole text tags secrets as begin, inside or outside
from the token's shape, its neighbours and the file; Viterbi's best path gives further spans, of which those that touch no base
span are added. The CRF is fitted on a bounded sample, chosen by a hash among all documents: as many with a base span as without. The
base spans of half of the former are given forms that the base rules don't know (other key names, other prefixes, upper-case hexadecimal
and base-64 values), which stay labelled as secrets, and in a quarter they are replaced by look-alikes (paths, words with hyphens,
numbers, plain assignments), which are labelled as outside. A random-looking value after an assignment that no base rule knows may
be a secret: windows with one are left out.

Most tokens are plain words, which all have the same features. After fitting it is proved, for every pair of tags around it, that
the best path through MARGIN plain tokens passes through outside; the text can then be decoded in windows around the other tokens
with the same result as in one piece. If the proof fails, texts are decoded in one piece.

Defined results: a null text is empty; null ids and repeated rows keep their rows; a sample without secrets adds none.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import documents, hashed_share, id_text, slices, stored

KINDS = ("assign", "access", "hex")
#: Documents that the CRF is fitted on, about, and the longest text among them; half of them hold a base span.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000
#: Windows without a secret that the fit takes from a text of the sample, at most.
PLAIN_WINDOWS = 12
WINDOW = 24
MARGIN = 3
STEPS = 150
CACHED_TOKENS = 200_000
B, I, O = 0, 1, 2  # noqa: E741

ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_HEX = re.compile("[0-9a-f]{24}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Whether a text holds a base span, for Spark.
HOLDS = "(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

TOKEN = re.compile(r"\S+")
PLAIN = re.compile(r"[^\W\d_]{1,19}[^\w=:/+]{0,4}|[^\w=:/+]{1,8}|\d{1,5}[.,;:!?%]?")
CORE = re.compile(r"[A-Za-z0-9+/_.=-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, kind by kind; matches that fail their check are dropped, not tried again."""
    lower = text.lower() if text.isascii() else text.casefold()
    found = []
    if any(k in lower for k in ("passw", "secret", "token", "api")):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return found


SHAPE = ("keyword", "op", "digit", "mixed", "hex", "len8", "len16", "len24", "len32", "symbols", "upper", "quoted", "numeric", "at", "path", "entropy", "pair")
N_SHAPE = len(SHAPE)
#: Shape bits that a token's neighbours see.
SEEN = ("keyword", "op", "quoted")
N_FEATURES = 1 + N_SHAPE + 3 * len(SEEN) + 2


def shape(token: str) -> int:
    """Bits of SHAPE; zero for a plain token."""
    lower = token.lower()
    keyword = any(k in lower for k in KEYWORDS)
    if not keyword and token not in (":", "=", ":=") and PLAIN.fullmatch(token):
        return 0
    core = max(CORE.findall(token), key=len, default="")
    n = len(core)
    has = [any(f(c) for c in core) for f in (str.isdigit, str.isupper, str.islower)]
    entropy = 0.0
    if n >= 16:
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(core).values())
    bits = (
        keyword,
        token[-1] in "=:" or token.startswith("="),
        has[0],
        all(has),
        n >= 8 and re.fullmatch("[0-9a-f]+", core) is not None,
        n >= 8,
        n >= 16,
        n >= 24,
        n >= 32,
        any(c in "+/_=-" for c in core),
        has[1] and not has[2],
        token[0] in "\"'" or token[-1] in "\"'",
        has[0] and not has[1] and not has[2],
        "@" in token,
        "/" in token or token.count(".") > 1,
        entropy > 3.0,
        keyword and re.search(r"[:=].{6,}", token) is not None,
    )
    return sum(1 << k for k, on in enumerate(bits) if on) or 1 << N_SHAPE


def feature_row(shapes: list[int], at: int, file: tuple[bool, bool]) -> list[int]:
    """Numbers of the features that are on for a token."""
    on = [0, *(1 + k for k in range(N_SHAPE) if shapes[at] >> k & 1)]
    for block, near in enumerate((at - 1, at - 2, at + 1)):
        if 0 <= near < len(shapes) and shapes[near]:
            on += [1 + N_SHAPE + block * len(SEEN) + k for k, name in enumerate(SEEN) if shapes[near] >> SHAPE.index(name) & 1]
    return on + [N_FEATURES - 2 + k for k in range(2) if file[k]]


def file_features(text: str, shapes: list[int]) -> tuple[bool, bool]:
    return "=" in text, 5 * sum(map(bool, shapes)) > len(shapes)


NAMES = ("pwd", "auth", "credential", "private_key", "access-code", "bearer", "client_key", "passphrase")
LOOK_ALIKES = ("size = 1200", "path=/usr/local/share/doc", "color: background", "state-of-the-art-processing-system", "0123 4567 8901 2345", "INTRODUCTION_AND_SUMMARY", "name = configuration", "page=index.html")


def reshaped(text: str, wrong: bool) -> tuple[str, list[tuple[int, int]]]:
    """The text with its base spans in forms that the base rules don't know, and these forms' places; or with look-alikes and no places."""
    out, spans, at = [], [], 0
    size = 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for start, kind, end in sorted((s, k, e) for k, s, e in base_spans(text)):
        if start < at:
            continue
        put(text[at:start])
        at, old = end, text[start:end]
        draw = hashlib.sha256(old.encode()).digest()
        if wrong:
            put(LOOK_ALIKES[draw[0] % len(LOOK_ALIKES)])
            continue
        value = base64.b64encode(draw).decode()[: 20 + draw[1] % 20].rstrip("+/=")
        if kind == 0:
            m = ASSIGN.match(old)
            key = NAMES[draw[0] % len(NAMES)]
            new = key + old[m.end(1) : m.start(2)] + (value, draw.hex().upper()[: 24 + draw[1] % 17], m[2])[draw[2] % 3]
        elif kind == 1:
            new = ("ASIA", "AGPA", "SK")[draw[0] % 3] + old[4:]
        else:
            new = old.upper() if draw[2] % 2 else value
        if any(s < len(new) for _, s, _ in base_spans(new)):
            new = "".join(value)  # still a base span: a bare value
        spans.append((size, size + len(new)))
        put(new)
    put(text[at:])
    return "".join(out), spans


def labelled(text: str) -> tuple[str, list[tuple[int, int]]]:
    """A text of the sample with the places of its secrets: as it is, or reshaped, by a hash of the text."""
    case = zlib.crc32(text.encode()) % 4
    if case == 0:
        return text, sorted((s, e) for _, s, e in base_spans(text))
    return reshaped(text, case == 1)


def doubtful(shapes: list[int], at: int) -> bool:
    """Whether a token that no base rule knows looks like an assigned secret: it is then no example of either."""
    has = lambda i, name: bool(shapes[i] >> SHAPE.index(name) & 1)
    random_like = has(at, "len16") and has(at, "digit") and (has(at, "mixed") or has(at, "hex") or has(at, "upper"))
    return random_like and (has(at, "op") or (at > 0 and (has(at - 1, "op") or has(at - 1, "keyword"))))


def training_windows(texts: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, tags, lengths) of windows around tokens that aren't plain, and of each text's first tokens.

    Of a text all windows with a secret are taken, and of the others PLAIN_WINDOWS at most, from all over the text, chosen by a hash.
    """
    rows, tags, lengths = [], [], []
    for text, spans in texts:
        tokens = list(TOKEN.finditer(text))
        shapes = [shape(m[0]) for m in tokens]
        file = file_features(text, shapes)
        tag, k = [O] * len(tokens), 0
        for i, m in enumerate(tokens):
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.end():
                tag[i] = I if i and tag[i - 1] != O and tokens[i - 1].end() > spans[k][0] else B
        unsure = [tag[i] == O and doubtful(shapes, i) for i in range(len(tokens))]
        starts, at = [0], -1
        for i, s in enumerate(shapes):
            if s and i >= at:
                starts.append(max(0, i - 6))
                at = i + WINDOW - 6
        sure = [(s, e) for s, e in ((s, min(len(tokens), s + WINDOW)) for s in starts) if e > s and not any(unsure[s:e])]
        own = zlib.crc32(text.encode("utf-8", "surrogatepass"))
        plain = sorted((w for w in sure if not any(t != O for t in tag[slice(*w)])), key=lambda w: zlib.crc32(b"%d %d" % (own, w[0])))
        for start, end in sorted(set(sure) - set(plain[PLAIN_WINDOWS:])):
            grid = np.zeros((WINDOW, N_FEATURES), np.float32)
            for i in range(start, end):
                grid[i - start, feature_row(shapes, i, file)] = 1
            rows.append(grid)
            tags.append(tag[start:end] + [O] * (WINDOW - end + start))
            lengths.append(end - start)
    return np.array(rows), np.array(tags), np.array(lengths)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_crf(texts: list[str], steps: int = STEPS, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights by feature and tag, transitions) by maximum likelihood; None where no token is a secret."""
    if not texts:
        return None
    x, y, lengths = training_windows([labelled(text) for text in texts])
    if not len(x) or not (y != O).any():
        return None
    # equal windows are one, with their number as its weight
    packed = np.concatenate([np.packbits(x.reshape(len(x), -1) > 0, axis=1), y.astype(np.uint8), lengths.astype(np.uint8)[:, None]], axis=1)
    _, kept, times = np.unique(packed, axis=0, return_index=True, return_counts=True)
    x, y, lengths = x[kept], y[kept], lengths[kept]
    n, t = int(times.sum()), x.shape[1]
    each = times[:, None].astype(float)
    inside = np.arange(t)[None, :] < lengths[:, None]
    seen = np.zeros((N_FEATURES, 3))
    flat_x, flat_y, flat_n = x[inside], y[inside], np.broadcast_to(each, inside.shape)[inside]
    for tag in range(3):
        seen[:, tag] = flat_n[flat_y == tag] @ flat_x[flat_y == tag]
    moves = np.zeros((3, 3))
    np.add.at(moves, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), np.broadcast_to(each, inside[:, 1:].shape)[inside[:, 1:]])
    weights, trans = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    first, second = [np.zeros_like(weights), np.zeros_like(trans)], [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        emit = x @ weights
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for k in range(1, t):
            moved = _log_sum(alpha[:, k - 1, :, None] + trans[None], 1) + emit[:, k]
            alpha[:, k] = np.where(inside[:, k, None], moved, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            moved = _log_sum(trans[None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(inside[:, k + 1, None], moved, 0)
        total = _log_sum(alpha[:, -1], 1)
        single = np.exp(alpha + beta - total[:, None, None]) * (inside * each)[:, :, None]
        expected = np.tensordot(x, single, axes=([0, 1], [0, 1]))
        pair = np.zeros((3, 3))
        for k in range(1, t):
            joint = np.exp(alpha[:, k - 1, :, None] + trans[None] + (emit[:, k] + beta[:, k])[:, None, :] - total[:, None, None])
            pair += (joint * (inside[:, k] * times)[:, None, None]).sum(axis=0)
        for slot, (value, slope) in enumerate(((weights, (expected - seen) / n + ridge * weights), (trans, (pair - moves) / n + ridge * trans))):
            first[slot] = 0.9 * first[slot] + 0.1 * slope
            second[slot] = 0.999 * second[slot] + 0.001 * slope**2
            value -= 0.1 * first[slot] / (1 - 0.9**step) / (np.sqrt(second[slot] / (1 - 0.999**step)) + 1e-8)
    return weights, trans


class Tagger:
    """Viterbi decoding of whole texts with a fitted CRF."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans.tolist()
        self.known: dict[str, int] = {}
        self.in_windows = all(self._outside_wins(f) for f in product((False, True), repeat=2))

    def _emit(self, shapes: list[int], at: int, file: tuple[bool, bool]) -> list[float]:
        return self.weights[feature_row(shapes, at, file)].sum(axis=0).tolist()

    def _outside_wins(self, file: tuple[bool, bool]) -> bool:
        """Whether the best path through MARGIN plain tokens is outside at the middle one, whatever stands around."""
        plain = self._emit([0], 0, file)
        for before, after in product((None, B, I, O), repeat=2):
            def score(path, before=before, after=after):
                total = sum(plain[a] for a in path) + sum(self.trans[a][b] for a, b in zip(path, path[1:], strict=False))
                return total + (self.trans[before][path[0]] if before is not None else 0) + (self.trans[path[-1]][after] if after is not None else 0)

            if max(product((B, I, O), repeat=MARGIN), key=score)[MARGIN // 2] != O:
                return False
        return True

    def _viterbi(self, shapes: list[int], start: int, end: int, file: tuple[bool, bool]) -> list[int]:
        best, back = self._emit(shapes, start, file), []
        for at in range(start + 1, end):
            emit, came = self._emit(shapes, at, file), []
            moved = []
            for tag in range(3):
                options = [best[a] + self.trans[a][tag] for a in range(3)]
                origin = max(range(3), key=options.__getitem__)
                came.append(origin)
                moved.append(options[origin] + emit[tag])
            best = moved
            back.append(came)
        path = [max(range(3), key=best.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def shapes(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHED_TOKENS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = shape(word)
        return list(map(known.__getitem__, words))

    def tags(self, text: str, shapes: list[int], whole: bool = False) -> dict[int, int]:
        """Tags that aren't outside, by token number."""
        file = file_features(text, shapes)
        odd = [i for i, s in enumerate(shapes) if s]
        windows: list[list[int]] = []
        if whole or not self.in_windows:
            windows = [[0, len(shapes)]] if shapes else []
        else:
            for i in odd:
                start, end = max(0, i - 1 - MARGIN), min(len(shapes), i + 3 + MARGIN)
                if windows and start <= windows[-1][1]:
                    windows[-1][1] = end
                else:
                    windows.append([start, end])
        return {start + k: tag for start, end in windows for k, tag in enumerate(self._viterbi(shapes, start, end, file)) if tag != O}

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the secrets on the best path."""
        shapes = self.shapes(text.split())
        if self.in_windows and not any(shapes):
            return []
        tags = self.tags(text, shapes)
        if not tags:
            return []
        places, found, at = list(TOKEN.finditer(text)), [], -2
        for i in sorted(tags):
            if tags[i] == B or i != at + 1:
                found.append([places[i].start(), places[i].end()])
            else:
                found[-1][1] = places[i].end()
            at = i
        return [trimmed for start, end in found if (trimmed := self._trim(text, start, end))]

    @staticmethod
    def _trim(text: str, start: int, end: int) -> tuple[int, int, int] | None:
        """The span from its first to its last key character, with the kind it resembles."""
        runs = [m for m in CORE.finditer(text, start, end) if m.end() - m.start() >= 6]
        if not runs:
            return None
        last = runs[-1]
        kind = 1 if re.fullmatch("[A-Z0-9]+", last[0]) else 2 if re.fullmatch("[0-9a-f]+", last[0]) else 0
        return kind, min(start + len(text[start:end]) - len(text[start:end].lstrip("\"'([{<#*$%&|")), runs[0].start()), last.end()


def sample_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """docs(doc_id, text) -> about ``sample_docs`` texts, half of them with a base span, by a hash; SAMPLE_CHARS bounds their size."""
    some = docs.filter((F.length("text") <= SAMPLE_CHARS) & (F.col("text") != "")).withColumn("holds", F.col("text").rlike(HOLDS))
    chosen = F.lit(False)
    for r in some.groupBy("holds").count().collect():
        chosen = chosen | ((F.col("holds") == r.holds) & hashed_share(sample_docs // 2, r["count"], 13, "doc_id", "text"))
    return [r.text for r in stored(some.filter(chosen).select("text"), "secrets-sample").orderBy("text").collect()]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) in code points."""
    docs = id_text(docs, id_col, text_col)
    fitted = fit_crf(sample_texts(docs, sample_docs))
    span = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*fitted) if fitted is not None else None
        as_rows = lambda spans: [{"kind": k, "s": s, "e": e} for k, s, e in spans]
        for batch in slices(batches):
            base, added = [], []
            for text in batch.column(1).to_pylist():
                here = base_spans(text) if text else []
                base.append(as_rows(here))
                extra = tagger.spans(text) if text and tagger else []
                added.append(as_rows(apart(extra, here)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], names=["doc_id", "base", "added"])

    shape_of = "array<struct<kind:int,s:int,e:int>>"
    return docs.mapInArrow(run, f"doc_id long, base {shape_of}, added {shape_of}")


def apart(extra: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of ``extra``, in order, that touch none of ``base``."""
    if not extra or not base:
        return extra
    merged: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, k = [], 0
    for kind, s, e in extra:
        while k < len(merged) and merged[k][1] <= s:
            k += 1
        if k == len(merged) or merged[k][0] >= e:
            kept.append((kind, s, e))
    return kept


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["kind"], x["e"])))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")

    return found.select(
        "doc_id",
        F.size(F.filter("base", lambda x: x["kind"] == 0)).cast("long").alias("n_assign"),
        F.size(F.filter("base", lambda x: x["kind"] == 1)).cast("long").alias("n_access"),
        F.size(F.filter("base", lambda x: x["kind"] == 2)).cast("long").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
