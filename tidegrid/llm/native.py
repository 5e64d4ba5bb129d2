"""Column expressions over whole texts, built from Spark functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for the row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))


def n_repeat_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that the array holds twice or more, the first included.

    Windows are hashed and sorted; a window equal to its neighbour is repeated. The sort is left out for an array
    whose windows are all distinct.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(size)))
        return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(gaps, F.lit(size), lambda total, gap: total + gap))

    def repeated(grams: Column) -> Column:
        placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            near = lambda k, h: F.coalesce(F.get(rows, k)["h"] == h, F.lit(False))
            kept = F.filter(rows, lambda x, k: near(k - 1, x["h"]) | near(k + 1, x["h"]))
            return F.array_sort(F.transform(kept, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(placed, lambda rows: let(starts(rows), covered)))

    def windows(all_words: Column) -> Column:
        return F.transform(F.slice(all_words, 1, F.size(all_words) - (size - 1)), lambda w, i: F.xxhash64(w, *(F.get(all_words, i + k) for k in range(1, size))))

    return let(words, lambda w: F.when(F.size(w) < size, F.lit(0)).otherwise(let(windows(w), repeated))).cast("long")


SPANS = "array<struct<s:int,e:int,t:string>>"


def chunks(items: Column, least: int = 64) -> Column:
    """The array in pieces of about the root of its size, of ``least`` at least; work that copies a piece for each item stays small."""
    width = F.greatest(F.lit(least), F.ceil(F.sqrt(F.size(items))).cast("int"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int"))
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(numbers, lambda k: F.slice(items, k * width + 1, width)))


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of ``start`` before each value; for short arrays."""
    return F.slice(F.aggregate(values, F.array(start), lambda done, x: F.array_append(done, step(F.element_at(done, -1), x))), 1, F.size(values))


def spans_of(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end, text) in code points; those that aren't valid are dropped after.

    A match starts after the text between the matches and the matches before it. Text without a match is scanned once.
    """

    def within(piece: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast(SPANS).alias("spans"))

        def step(so_far: Column, x: Column) -> Column:
            s, e = so_far["at"] + x["gap"], so_far["at"] + x["gap"] + x["size"]
            return F.struct(e.alias("at"), F.array_append(so_far["spans"], F.struct(s.alias("s"), e.alias("e"), x["t"].alias("t"))).alias("spans"))

        return F.aggregate(piece, state, step, lambda done: done["spans"])

    def placed(found: Column) -> Column:
        def walk(pieces: Column) -> Column:
            sizes = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
            return F.flatten(F.zip_with(pieces, let(sizes, lambda n: running(n, F.lit(0), lambda a, b: a + b)), within))

        def paired(gaps: Column) -> Column:
            return F.transform(found, lambda t, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(t).alias("size"), t.alias("t")))

        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(let(let(let(F.split(text, pattern, -1), paired), chunks), walk))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return spans if valid is None else F.filter(spans, lambda x: valid(x["t"]))


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that touch none of ``others``, both (s, e, ...); others are looked through by pieces with their bounds."""

    def bounded(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: F.struct(F.array_min(p)["s"].alias("low"), F.array_max(F.transform(p, lambda x: x["e"])).alias("high"), p.alias("items")))

    def free(pieces: Column) -> Column:
        def touched(x: Column) -> Column:
            near = lambda b, low, high: (b[low] < x["e"]) & (x["s"] < b[high])
            return F.exists(pieces, lambda p: F.when(near(p, "low", "high"), F.exists(p["items"], lambda b: near(b, "s", "e"))).otherwise(False))

        return F.filter(spans, lambda x: ~touched(x))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(let(let(F.array_sort(others), chunks), bounded), free))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans (s, e, by) replaced by ``by``; overlapping spans become one, named by the first."""

    def walk(pieces: Column) -> Column:
        ends = F.transform(pieces, lambda p: F.array_max(F.transform(p, lambda x: x["e"])))

        def within(piece: Column, start: Column) -> Column:
            end = F.greatest(start, F.array_max(F.transform(piece, lambda x: x["e"])))

            def rebuilt(segment: Column) -> Column:
                state = F.struct(start.alias("at"), F.array().cast("array<string>").alias("parts"))

                def step(so_far: Column, x: Column) -> Column:
                    between = F.substring(segment, so_far["at"] - start + 1, x["s"] - so_far["at"])
                    parts = F.when(x["s"] >= so_far["at"], F.concat(so_far["parts"], F.array(between, x["by"]))).otherwise(so_far["parts"])
                    return F.struct(F.greatest(so_far["at"], x["e"]).alias("at"), parts.alias("parts"))

                return F.aggregate(piece, state, step, lambda done: F.array_join(done["parts"], ""))

            return let(F.substring(text, start + 1, end - start), rebuilt)

        last = F.array_max(ends)
        starts = let(ends, lambda n: running(n, F.lit(0), F.greatest))
        return F.concat(F.array_join(F.zip_with(pieces, starts, within), ""), F.substring(text, last + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(chunks(spans), walk))
