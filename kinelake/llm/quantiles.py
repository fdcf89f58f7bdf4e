"""Percentiles of very large numeric columns per group, mergeable, with a known error.

Method.  Deterministic buffer collapsing: a sketch holds up to ``buffers``
sorted buffers of ``k`` values, each value standing for ``weight`` rows.  New
values fill a buffer of weight 1; when all buffers are in use, those of the
lowest level are collapsed into one: of their merged, weighted sequence
evenly spaced positions are kept, the offset alternating.  Levels form the
collapse tree, which bounds the sum of weights and so the rank error; the
sketch carries its own bound: a collapse with total weight W moves no rank by
more than W / 2.  Sketches are rows of a table, so portions (partitions,
days) are combined by feeding their buffers to one sketch.

The first pass is map-side, without a shuffle; a group with a third of all
rows sends one small sketch per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.groups import column, whole_groups
from kinelake.session import cut, join_small, map_arrow

K = 512
BUFFERS = 8
#: Values buffered in a map task before its sketches are sent on and begun anew.
HELD_VALUES = 4_000_000
#: Buffers of a group that one merge takes in.
FAN_IN = 1024
SKETCH = "weight bigint, level int, error double, vals array<double>"


class Sketch:
    """Buffer-collapsing quantile summary of a stream of finite doubles."""

    def __init__(self, k: int = K, buffers: int = BUFFERS) -> None:
        self.k, self.b = k, buffers
        self.full: list[tuple[int, int, np.ndarray]] = []  # level, weight, sorted values
        self.rest: list[np.ndarray] = []  # raw values of weight 1
        self.n_rest = 0
        self.error = 0.0
        self.odd = False

    def size(self) -> int:
        return self.n_rest + self.k * len(self.full)

    def add(self, values: np.ndarray) -> None:
        self.rest.append(values)
        self.n_rest += len(values)
        if self.n_rest >= self.k:
            v = np.concatenate(self.rest)
            at = 0
            while len(v) - at >= self.k:
                self._push(0, 1, np.sort(v[at : at + self.k]))
                at += self.k
            self.rest, self.n_rest = [v[at:]], len(v) - at

    def absorb(self, weight: int, level: int, error: float, values: np.ndarray) -> None:
        """Take over a buffer of another sketch; its error adds up."""
        self.error += error
        if weight == 1 and len(values) < self.k:
            self.add(values)
        else:
            self._push(level, weight, values)

    def _push(self, level: int, weight: int, values: np.ndarray) -> None:
        self.full.append((level, weight, values))
        if len(self.full) >= self.b:
            self._collapse()

    def _collapse(self) -> None:
        low = min(l for l, _, _ in self.full)
        chosen = [f for f in self.full if f[0] == low]
        if len(chosen) == 1:  # lift a single buffer to the next level in use
            low = min(l for l, _, _ in self.full if l > low)
            chosen = [f for f in self.full if f[0] <= low]
        self.full = [f for f in self.full if f[0] > low]
        values = np.concatenate([v for _, _, v in chosen])
        each = np.concatenate([np.full(len(v), w, np.int64) for _, w, v in chosen])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(each[order])
        total = sum(w for _, w, _ in chosen)  # all buffers hold k values, so the new weight is the sum
        self.odd = not self.odd
        offset = (total + 1) // 2 if total % 2 else (total // 2 if self.odd else total // 2 + 1)
        at = np.searchsorted(upto, offset + total * np.arange(self.k))
        self.full.append((low + 1, total, values[order][np.minimum(at, len(values) - 1)]))
        self.error += total / 2

    def rows(self) -> list[tuple[int, int, float, np.ndarray]]:
        out = [(w, l, 0.0, v) for l, w, v in self.full]
        if self.n_rest or not out:
            out.append((1, 0, 0.0, np.sort(np.concatenate(self.rest)) if self.rest else np.zeros(0)))
        return [(w, l, self.error if i == 0 else 0.0, v) for i, (w, l, _, v) in enumerate(out)]

    def query(self, qs: list[float]) -> tuple[int, float, list[float]]:
        """Rows, rank error bound in rows, values at ranks ceil(q * n) (at least 1)."""
        parts = [(w, v) for _, w, v in self.full] + [(1, v) for v in self.rest if len(v)]
        if not parts:
            return 0, 0.0, [float("nan")] * len(qs)
        values = np.concatenate([v for _, v in parts])
        each = np.concatenate([np.full(len(v), w, np.int64) for w, v in parts])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(each[order])
        n = int(upto[-1])
        ranks = np.maximum(1, np.ceil(np.array(qs) * n - 1e-9)).astype(np.int64)
        largest = max(w for w, _ in parts)
        return n, self.error + (largest / 2 if largest > 1 else 0.0), values[order][np.searchsorted(upto, ranks)].tolist()


def _pack(keys: list[tuple], sketches: list[list[tuple]], schema: pa.Schema) -> pa.RecordBatch:
    flat = [(k, r) for k, rows in zip(keys, sketches) for r in rows]
    cols: list[pa.Array] = []
    for i, f in enumerate(schema):
        if i < len(schema) - 4:
            cols.append(pa.array([k[i] for k, _ in flat], f.type))
    cols += [pa.array([r[j] for _, r in flat], t) for j, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.float64()))]
    lengths = np.array([0] + [len(r[3]) for _, r in flat])
    values = np.concatenate([r[3] for _, r in flat]) if flat else np.zeros(0)
    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(values)))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def _key_schema(df: DataFrame, by: list[str]) -> tuple[str, pa.Schema]:
    types = dict(df.dtypes)
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "date": pa.date32()}
    fields = [pa.field(c, arrow[types[c]]) for c in by] + [pa.field("metric", pa.string())]
    tail = [pa.field("weight", pa.int64()), pa.field("level", pa.int32()), pa.field("error", pa.float64()), pa.field("vals", pa.list_(pa.float64()))]
    ddl = ", ".join(f"`{c}` {types[c]}" for c in by) + (", " if by else "") + f"metric string, {SKETCH}"
    return ddl, pa.schema(fields + tail)


def sketch_columns(df: DataFrame, by: list[str], metrics: list[str], k: int = K, buffers: int = BUFFERS) -> DataFrame:
    """Partial sketches of ``metrics`` per ``by`` group and input partition.

    Output: by columns, metric, weight, level, error, vals.  Null and NaN
    values of a metric are left out; null keys form a group of their own; a
    group without values has no sketch; rows count as often as they occur; an
    empty table gives no sketches.  Key types: string, int, bigint, tinyint, date.
    """
    ddl, schema = _key_schema(df, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        pending: list[pa.RecordBatch] = []
        n = 0

        def take() -> None:
            t = pa.Table.from_batches(pending)
            codes = np.zeros(t.num_rows, np.int64)
            for c in by:
                d = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                codes = codes * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            sorted_codes = codes[order]
            begin = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
            keys = t.select(by).take(pa.array(order[begin])).to_pylist() if by else [{}]
            for m in metrics:
                v = column(t, m, float("nan")).astype(float)[order]
                for key, b, e in zip(keys, begin, np.append(begin[1:], len(codes))):
                    part = v[b:e]
                    part = part[~np.isnan(part)]
                    if len(part):
                        full = (*key.values(), m)
                        if full not in held:
                            held[full] = Sketch(k, buffers)
                        held[full].add(part)

        for b in batches:
            if b.num_rows:
                pending.append(b)
                n += b.num_rows
            if n >= 200_000:
                take()
                pending, n = [], 0
                if sum(s.size() for s in held.values()) > HELD_VALUES:
                    yield _pack(list(held), [s.rows() for s in held.values()], schema)
                    held = {}
        if n:
            take()
        if held:
            keys = list(held)
            for at in range(0, len(keys), 2000):
                yield _pack(keys[at : at + 2000], [held[q].rows() for q in keys[at : at + 2000]], schema)

    return map_arrow(df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]), run, ddl)


def _grouped(sketches: DataFrame, by: list[str], fn, ddl: str) -> DataFrame:
    """Run ``fn`` over chunks of whole groups of partial sketches."""
    keyed = sketches.withColumn("__g", F.xxhash64(*by, "metric"))

    def run(batches):
        for t in whole_groups(batches, ["__g"], 2000):
            out = fn(t)
            if out is not None:
                yield out

    return map_arrow(keyed.repartition("__g").sortWithinPartitions("__g", *by, "metric", "level", "vals"), run, ddl)


def _each_group(t: pa.Table, by: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups in order; keys are compared exactly, whatever their hash."""
    keys = list(zip(*[t[c].to_pylist() for c in [*by, "metric"]]))
    w, l, e = (t[c].to_pylist() for c in ("weight", "level", "error"))
    vals = t["vals"].combine_chunks()
    values, off = vals.values.to_numpy(zero_copy_only=False), vals.offsets.to_numpy()
    groups: dict[tuple, list[tuple]] = {}
    for i, key in enumerate(keys):
        groups.setdefault(key, []).append((w[i], l[i], e[i], values[off[i] : off[i + 1]]))
    yield from groups.items()


def _merge(rows: list[tuple], k: int, buffers: int) -> Sketch:
    s = Sketch(k, buffers)
    for r in rows:
        s.absorb(*r)
    return s


def merge_sketches(sketches: DataFrame, by: list[str], k: int = K, buffers: int = BUFFERS, fan_in: int = FAN_IN) -> DataFrame:
    """Partial sketches of each (by, metric) merged to at most ``fan_in`` buffers; ``by``
    may be fewer columns than those of the input, e.g. without the day.

    The merges form a tree: in a round a group of more than ``fan_in`` buffers
    is dealt out to parts of that many, each merged to one sketch by one
    kernel call, so no task ever holds more of a hot group, and rounds grow
    with the logarithm of the largest group."""
    kept = cut(sketches.select(*by, "metric", "weight", "level", "error", "vals").withColumn("__g", F.xxhash64(*by, "metric")))
    inner = [*by, "__part"]
    ddl, schema = _key_schema(kept.withColumn("__part", F.lit(0)), inner)

    def fn(t: pa.Table) -> pa.RecordBatch:
        got = [(key, _merge(rows, k, buffers).rows()) for key, rows in _each_group(t, inner)]
        return _pack([a for a, _ in got], [b for _, b in got], schema)

    while True:
        sizes = cut(kept.groupBy("__g").agg(F.count(F.lit(1)).alias("__n")))
        if (sizes.agg(F.max("__n")).first()[0] or 0) <= fan_in:
            return kept.drop("__g")
        # kept is a stored table, so its row numbers are the same on every attempt
        dealt = join_small(kept.withColumn("__id", F.monotonically_increasing_id()), sizes, "__g", "inner").withColumn("__part", F.pmod(F.xxhash64("__id"), F.ceil(F.col("__n") * 2 / fan_in).cast("long")).cast("int"))
        merged = _grouped(dealt.select(*inner, "metric", "weight", "level", "error", "vals"), inner, fn, ddl)
        kept = cut(merged.drop("__part").withColumn("__g", F.xxhash64(*by, "metric")))


def percentiles(sketches: DataFrame, by: list[str], qs: list[float], k: int = K, buffers: int = BUFFERS) -> DataFrame:
    """Estimates out of (partial or merged) sketches: by, metric, n, max_rank_error, q, value.

    ``value`` is a value of the column whose rank differs from
    ``ceil(q * n)`` by at most ``max_rank_error`` rows (0: exact).
    """
    kept = merge_sketches(sketches, by, k, buffers)
    types = dict(kept.dtypes)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in by) + ", metric string, n bigint, max_rank_error double, q double, value double"
    key_schema = _key_schema(kept, by)[1]

    def fn(t: pa.Table) -> pa.RecordBatch:
        keys, ns, errors, quantiles, values = [], [], [], [], []
        for key, rows in _each_group(t, by):
            n, error, got = _merge(rows, k, buffers).query(qs)
            keys += [key] * len(qs)
            ns += [n] * len(qs)
            errors += [error] * len(qs)
            quantiles += qs
            values += got
        cols = [pa.array([key[i] for key in keys], key_schema.field(i).type) for i in range(len(by) + 1)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(ns, pa.int64()), pa.array(errors, pa.float64()), pa.array(quantiles, pa.float64()), pa.array(values, pa.float64())], [*by, "metric", "n", "max_rank_error", "q", "value"])

    return _grouped(kept, by, fn, ddl)
