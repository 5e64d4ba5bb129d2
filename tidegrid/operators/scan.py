"""Recursive filters over series of any length, as an associative scan of affine maps.

A linear recursive filter changes its state by s' = A s + x at every sample, with a diagonal A of its poles. Over a piece of n samples that is one map
s' = A^n s + c, where c is the state that the piece leaves when it starts from zero. Maps combine: (n, c) then (m, d) is (n + m, A^m c + d).
Every piece gives its map (a count and a few numbers); the maps are combined along each series, inside chunks first, then over
chunks; and a second pass over the pieces emits the samples, each piece from the state that reaches it. Nothing needs a whole
series in one place.

A series that lies in one piece needs no scan: such series are filtered where they are, many of like length at once as rows of a matrix
(``filtering.forward_backward``), so that the work of a table of many short series is that of its samples, not of its series. Only series that
a cut goes through take the way of the maps.

Zero-phase filtering runs forwards and backwards over a series that is extended oddly at both ends, each run from the steady state of its first
sample, like ``filtering.forward_backward`` of one array.

Defined results: a series of no more samples than the extension (three times the number of coefficients) gives nulls, as does an empty one;
a null sample counts as NaN, and a NaN spoils the series' output from there (both ways: all of it). Repeated positions are samples of
their own, in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.filtering import engine_for, forward_backward_ragged
from tidegrid.operators.pieces import PIECE, PLACE, offsets, pack, same, unpack
from tidegrid.sources.shared import written

#: Chunk numbers of the pieces that extend a series before its first and behind its last sample.
HEAD, TAIL = -1, (1 << 31) - 1


def _floats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), float)


def _doubles(state: np.ndarray) -> np.ndarray:
    """A complex state as doubles: the real parts, then the imaginary ones."""
    return np.concatenate([state.real, state.imag])


def _state(doubles: Sequence[float]) -> np.ndarray:
    half = np.asarray(doubles, float)
    return half[: len(half) // 2] + 1j * half[len(half) // 2 :]


def _each(df: DataFrame, values: str, keep: Sequence[str], out: str, kind: str, f: Callable[[np.ndarray, np.ndarray | None], np.ndarray], state: str | None = None) -> DataFrame:
    """df's columns ``keep`` and ``out``: f of the values (and the state) of each row."""
    names = [*keep, out]
    layout = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"{out} {kind}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            lists, states = at[values], at[state] if state else None
            found = [f(_floats(lists[i].values), None if states is None or not states[i].is_valid else _floats(states[i].values)) for i in range(batch.num_rows)]
            ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            flat = pa.array(np.concatenate(found).astype(float) if found else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(at[c] for c in keep), pa.ListArray.from_arrays(pa.array(ends), flat)], names=names)

    return df.mapInArrow(run, layout)


def _combine(rows: DataFrame, group: Sequence[str], order: str, poles: np.ndarray, first: str | None, out: str, whole: bool) -> DataFrame:
    """Along each group, in order: the state that reaches every row, from ``first`` (or zero); with ``whole`` instead one row, the group's map.

    rows(group, order, m, c[, first]). A group is a chunk's pieces or a series' chunks.
    """
    columns = [c for c in rows.columns if whole is False or c in group]
    extra = [out, *(["m"] if whole else [])]
    layout = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), f"{out} array<double>", *(["m bigint"] if whole else [])])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        counts, ends = table["m"].to_pylist(), table["c"].to_pylist()
        state = np.zeros(len(poles), complex)
        if first and (start := table[first][0].as_py()) is not None:
            state = _state(start)
        found = []
        for n, c in zip(counts, ends, strict=True):
            found.append(state)
            state = poles**n * state + _state(c)
        if whole:
            kept = table.select(columns).slice(0, 1)
            return kept.append_column(extra[0], pa.array([_doubles(state).tolist()])).append_column("m", pa.array([sum(counts)], pa.int64()))
        return table.select(columns).append_column(extra[0], pa.array([_doubles(s).tolist() for s in found], pa.list_(pa.float64())))

    return rows.groupBy(*group).applyInArrow(run, layout)


def states(maps: DataFrame, keys: Sequence[str], poles: np.ndarray, start: DataFrame | None = None) -> DataFrame:
    """(keys, place, state): the state that reaches each piece, from maps(keys, place, m, c) and start(keys, first), the series' first states."""
    chunks = _combine(maps, [*keys, PLACE[0]], PLACE[1], poles, None, "c", True)
    if start is not None:
        on = F.lit(True)
        for c in keys:
            on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        chunks = chunks.alias("a").join(start.alias("b"), on, "left").select("a.*", "b.first")
    else:
        chunks = chunks.withColumn("first", F.lit(None).cast("array<double>"))
    reached = _combine(chunks, list(keys), PLACE[0], poles, "first", "first_state", False)
    on = F.lit(True)
    for c in (*keys, PLACE[0]):
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    own = maps.alias("a").join(reached.alias("b"), on).select("a.*", F.col("b.first_state"))
    return _combine(own, [*keys, PLACE[0]], PLACE[1], poles, "first_state", "state", False).select(*keys, *PLACE, "state")


def run_filter(pieces: DataFrame, keys: Sequence[str], values: str, b: np.ndarray, a: np.ndarray, start: DataFrame | None = None, out: str = "y") -> DataFrame:
    """pieces with the filter's output, from start(keys, first) or from rest."""
    engine = engine_for(tuple(b), tuple(a))
    b, a, poles = tuple(b), tuple(a), engine.poles
    keep = [*keys, *PLACE, "n"]

    def left(x: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        return _doubles(engine_for(b, a).carry(x))

    def emit(x: np.ndarray, state: np.ndarray | None) -> np.ndarray:
        own = engine_for(b, a)
        return own.run(x[None], (np.zeros(len(own.poles), complex) if state is None else _state(state))[None])[0]

    maps = _each(pieces.select(*keep, values), values, keep, "c", "array<double>", left).withColumnRenamed("n", "m").withColumn("m", F.col("m").cast("bigint"))
    reached = states(maps, keys, poles, start)
    joined = pieces.alias("a").join(reached.alias("b"), same(keys)).select("a.*", "b.state")
    return _each(joined, values, pieces.columns, out, "array<double>", emit, "state")


def _ends(placed: DataFrame, keys: Sequence[str], values: str, edge: int) -> DataFrame:
    """(keys, total, head, tail): the first and the last edge + 1 samples of every series; only samples near an end move."""
    near = F.least(F.lit(edge + 1) - F.col("offset"), F.col("n").cast("long"))
    back = F.least(F.col("offset") + F.col("n") - (F.col("total") - edge - 1), F.col("n").cast("long"))
    zero = F.array().cast("array<double>")
    heads = F.when(near > 0, F.slice(values, F.lit(1), near.cast("int"))).otherwise(zero)
    tails = F.when(back > 0, F.slice(values, (F.col("n") - back + 1).cast("int"), back.cast("int"))).otherwise(zero)
    some = placed.filter((near > 0) | (back > 0)).select(*keys, "total", "offset", heads.alias("h"), tails.alias("t"))
    piece = F.sort_array(F.collect_list(F.struct("offset", "h", "t")))
    joined = some.groupBy(*keys, "total").agg(piece.alias("p"))
    return joined.select(*keys, "total", F.flatten(F.transform("p", lambda x: x["h"])).alias("head"), F.flatten(F.transform("p", lambda x: x["t"])).alias("tail"))


def zero_phase(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, b: np.ndarray, a: np.ndarray, out: str = "filtered", partitions: int | None = None, size: int = PIECE) -> DataFrame:
    """(keys, order, value, out): every series filtered forwards and backwards along ``order``."""
    keys, order = list(keys), list(order)
    clean = df.select(*keys, *order, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias(value))
    pieces = pack(clean, keys, order, [*order, value], partitions, size)
    placed = written(pieces.alias("a").join(offsets(pieces, keys).alias("b"), same(keys)).select("a.*", "b.offset", "b.total"), "placed")
    whole = _filtered_whole(placed.filter(F.col("n") == F.col("total")).drop("offset", "total"), value, b, a, out)
    cut = placed.filter(F.col("n") < F.col("total"))
    if not cut.isEmpty():
        whole = whole.unionByName(_filtered_in_pieces(cut, keys, value, b, a, out))
    return unpack(whole, keys, [*order, value, out])


def _filtered_whole(pieces: DataFrame, value: str, b: np.ndarray, a: np.ndarray, out: str) -> DataFrame:
    """pieces with ``out``, each a whole series."""
    b, a = tuple(b), tuple(a)
    layout = T.StructType([*pieces.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(value))
            ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).astype(np.int32)
            flat, short = forward_backward_ragged(_floats(lists.flatten()), ends, b, a)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=np.repeat(short, np.diff(ends))))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=layout.names)

    return pieces.mapInArrow(run, layout)


def _filtered_in_pieces(placed: DataFrame, keys: list[str], value: str, b: np.ndarray, a: np.ndarray, out: str) -> DataFrame:
    """The pieces placed(keys, place, n, offset, total, values) with ``out``, by maps along their series."""
    edge = 3 * max(len(a), len(b))
    steady = _doubles(engine_for(tuple(b), tuple(a)).steady).tolist()
    pieces = placed.drop("offset", "total")
    ends = written(_ends(placed, keys, value, edge), "ends")
    long_enough = ends.filter(F.col("total") > edge)
    odd = lambda x, at, pivot: F.transform(F.reverse(F.slice(x, at, edge)), lambda v: 2 * F.get(x, F.lit(pivot)) - v)
    slim = [*keys, *PLACE, "n", value]
    added = [long_enough.select(*keys, F.lit(chunk).alias("__chunk"), F.lit(0).alias("__piece"), F.lit(edge).alias("n"), part.alias(value)) for chunk, part in ((HEAD, odd("head", 2, 0)), (TAIL, odd("tail", 1, edge)))]
    semi = F.lit(True)
    for c in keys:
        semi = semi & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    whole = pieces.alias("a").join(long_enough.alias("b"), semi, "left_semi").select(*slim)
    for part in added:
        whole = whole.unionByName(part)
    times = lambda x: F.array(*(F.lit(s) * x for s in steady))
    first = long_enough.select(*keys, times(2 * F.get("head", F.lit(0)) - F.get("head", F.lit(edge))).alias("first"))
    forth = written(run_filter(whole, keys, value, b, a, first), "forwards")
    # backwards: chunks and pieces count down, samples are reversed
    turned = forth.select(*keys, (-F.col("__chunk")).alias("__chunk"), (-F.col("__piece")).alias("__piece"), "n", F.reverse("y").alias("r"))
    last = forth.filter(F.col("__chunk") == TAIL).select(*keys, times(F.get("y", F.lit(edge - 1))).alias("first"))
    back = run_filter(turned, keys, "r", b, a, last).select(*keys, (-F.col("__chunk")).alias("__chunk"), (-F.col("__piece")).alias("__piece"), F.reverse("y").alias(out))
    joined = pieces.alias("a").join(back.alias("b"), same(keys), "left")
    return joined.select("a.*", F.coalesce(f"b.{out}", F.transform(f"a.{value}", lambda _: F.lit(None).cast("double"))).alias(out))
