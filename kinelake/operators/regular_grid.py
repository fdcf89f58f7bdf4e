"""Irregular readings onto a regular grid, missing cells filled by low-rank factorisation.

Method.  Readings are averaged per (source, slot) with a map-side
aggregation.  Sources of one clip and a window of slots form a
source-by-time matrix; x and y of a source are two of its rows, so both share
the time factors.  A missing cell is bridged from the two observed cells on
either side of it, and what bridges miss, which all sources seen by one camera
may share, comes from a low-rank factorisation: the deviations of the observed
cells from the bridge over themselves are factorised by alternating ridge
least squares, the time factors being tied to their neighbours in time, and
the product is added to the bridge.  A fifth of the observed cells is kept out
of the fit and decides what part of the product is worth adding: all of it
where sources do move together, none where they don't.

Observed cells are returned exactly as averaged, each coordinate by itself;
missing cells of a source with enough observations in the window are filled;
the others stay marked as unsupported, with null values.

A matrix is bounded by construction: at most ``stripe`` sources of a clip by
``window`` slots, already averaged, so neither a hot clip nor a hot source
makes a large group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.groups import column, map_groups
from kinelake.sources.tables import observation_time


@dataclass(frozen=True)
class GridParams:
    slot_s: float = 0.5
    rank: int = 4  #: at most half the slots of the window in use
    rounds: int = 5
    ridge: float = 2.0  #: in cells, on both factors
    tension: float = 0.5  #: of the bridge: 1 a line, 0 a cubic
    held_out: int = 5  #: one observed cell in so many decides the weight of the product
    clip: float = 4.0  #: robust deviations beyond which a cell says no more
    tie: float = 1.0  #: weight of the neighbouring time factors, in cells
    window: int = 256  #: slots in a matrix
    stripe: int = 64  #: sources in a matrix
    min_cells: int = 3  #: observed slots of a source in the window below which nothing is filled


def _als(m: np.ndarray, seen: np.ndarray, p: GridParams) -> np.ndarray:
    """Completed matrix; m has zeros where not seen (rows are centred and scaled)."""
    rows, cols = m.shape
    w = seen.astype(float)
    rank = min(p.rank, max(1, cols // 2))
    t = np.linspace(-1, 1, cols)
    v = np.stack([t**k for k in range(1, rank + 1)], 1)  # deterministic start: smooth time factors
    eye = np.eye(rank)
    u = np.zeros((rows, rank))
    for _ in range(p.rounds):
        outer = (v[:, :, None] * v[:, None, :]).reshape(cols, -1)
        u = np.linalg.solve((w @ outer).reshape(rows, rank, rank) + p.ridge * eye, ((w * m) @ v)[..., None])[..., 0]
        outer = (u[:, :, None] * u[:, None, :]).reshape(rows, -1)
        lhs = (w.T @ outer).reshape(cols, rank, rank)
        rhs = (w * m).T @ u
        # neighbouring factors: even and odd columns in turn, so that each step is one batch of small solves
        scale = max(float(np.mean(np.sum(u * u, 0))) / max(rows, 1), 1e-9)
        for parity in (0, 1):
            near = np.zeros_like(v)
            count = np.zeros((cols, 1))
            near[1:] += v[:-1]
            count[1:] += 1
            near[:-1] += v[1:]
            count[:-1] += 1
            k = slice(parity, None, 2)
            a = lhs[k] + (p.ridge + p.tie * count[k, :, None]) * scale * eye
            v[k] = np.linalg.solve(a, (rhs[k] + p.tie * scale * near[k])[..., None])[..., 0]
    return u @ v.T


def _bridge(m: np.ndarray, known: np.ndarray, tension: float) -> tuple[np.ndarray, np.ndarray]:
    """Value of every cell from the two known cells before and the two after it
    (never from itself), and where cells on both sides exist.

    A cubic through the inner two with the slopes of the outer ones, drawn
    towards their line by ``tension``; with one side known its nearest cell."""
    rows, cols = m.shape
    t = np.arange(cols)[None, :]
    at = np.where(known, t, -1)
    none = np.full((rows, 1), -1)
    row = np.arange(rows)[:, None]
    a = np.maximum.accumulate(np.concatenate([none, at[:, :-1]], 1), 1)  # last known before
    first = lambda k: np.where(k < 0, 0, k)
    a2 = np.where(a >= 0, a[row, first(a)], -1)
    at = np.where(known, t, cols)
    b = np.minimum.accumulate(np.concatenate([at[:, 1:], np.full((rows, 1), cols)], 1)[:, ::-1], 1)[:, ::-1]
    last = lambda k: np.where(k >= cols, cols - 1, k)
    b2 = np.where(b < cols, b[row, last(b)], cols)
    va, vb, va2, vb2 = m[row, first(a)], m[row, last(b)], m[row, first(a2)], m[row, last(b2)]
    inner = (a >= 0) & (b < cols)
    h = np.maximum(b - a, 1)
    slope = (vb - va) / h
    u = (t - a) / h
    line = va + (vb - va) * u
    # at the inner cells the slope of the nearer stretch counts more
    ha, hb = np.maximum(a - a2, 1), np.maximum(b2 - b, 1)
    left = np.where(a2 >= 0, (ha * slope + h * (va - va2) / ha) / (ha + h), slope)
    right = np.where(b2 < cols, (hb * slope + h * (vb2 - vb) / hb) / (hb + h), slope)
    cubic = (2 * u**3 - 3 * u**2 + 1) * va + (u**3 - 2 * u**2 + u) * h * left + (3 * u**2 - 2 * u**3) * vb + (u**3 - u**2) * h * right
    value = np.where(inner, tension * line + (1 - tension) * cubic, np.where(a >= 0, va, np.where(b < cols, vb, np.nan)))
    return value, inner


def _fill(m: np.ndarray, known: np.ndarray, p: GridParams) -> np.ndarray:
    """Completed matrix: bridge plus the share of the low-rank product that the held-out cells confirm."""
    m = np.where(known, m, 0.0)
    value, inner = _bridge(m, known, p.tension)
    usable = known & inner
    off = np.where(usable, m - np.where(usable, value, 0.0), 0.0)
    n = np.maximum(usable.sum(1), 1)
    scale = np.abs(off).sum(1) / n
    scale = (np.minimum(np.abs(off), 3 * scale[:, None]).sum(1) / n)[:, None] + 1e-9  # spikes don't set the scale
    dev = np.clip(off / scale, -p.clip, p.clip)
    rows, cols = m.shape
    kept = (np.arange(rows)[:, None] * 7919 + np.arange(cols)[None, :] * 104729) % p.held_out > 0
    product = _als(np.where(kept, dev, 0.0), usable & kept, p)
    test = usable & ~kept
    power = float((product[test] ** 2).sum())
    share = min(1.0, max(0.0, float((product[test] * dev[test]).sum()) / power)) if power > 0 else 0.0
    return value + share * product * scale


def _matrix(table: pa.Table, p: GridParams) -> pa.Table:
    clip, stripe, block, tid, kind, slot = (column(table, c) for c in ("clip", "stripe", "block", "tid", "kind", "slot"))
    hi, n = column(table, "hi"), column(table, "n")
    x, y = column(table, "x"), column(table, "y")
    new = np.ones(len(tid), bool)
    new[1:] = (clip[1:] != clip[:-1]) | (stripe[1:] != stripe[:-1]) | (block[1:] != block[:-1])
    begin = np.flatnonzero(new)
    out = []
    for b, e in zip(begin, np.append(begin[1:], len(tid))):
        tids, s = np.unique(tid[b:e], return_inverse=True)
        k, c0 = kind[b:e], block[b] * p.window
        span, obs = k == 0, k == 1
        used_lo, used_hi = int(slot[b:e][span].min()), int(hi[b:e][span].max())
        cols = used_hi - used_lo + 1
        inside = np.zeros((len(tids), cols), bool)
        for row, lo_, hi_ in zip(s[span], slot[b:e][span] - used_lo, hi[b:e][span] - used_lo):
            inside[row, lo_ : hi_ + 1] = True
        seen = np.zeros((len(tids), cols), bool)
        count = np.zeros((len(tids), cols), np.int64)
        val = np.full((2, len(tids), cols), np.nan)
        r, c = s[obs], slot[b:e][obs] - used_lo
        seen[r, c] = True
        count[r, c] = n[b:e][obs]
        val[0, r, c], val[1, r, c] = x[b:e][obs], y[b:e][obs]
        both = np.concatenate([val[0], val[1]])
        known = np.isfinite(both)
        support = np.concatenate([inside, inside]) & ~known & (known.sum(1) >= p.min_cells)[:, None]
        filled = np.where(support, _fill(both, known, p), both) if support.any() else both
        done_x, done_y = support[: len(tids)], support[len(tids) :]
        filled = filled.reshape(2, len(tids), cols)
        rr, cc = np.nonzero(inside)
        status = np.where(seen, np.where(done_x | done_y, 3, 0), np.where(done_x & done_y, 1, 2))[rr, cc]
        out.append((tids[rr], cc + used_lo, status, count[rr, cc], filled[0, rr, cc], filled[1, rr, cc]))
    t, sl, st, ct, fx, fy = (np.concatenate(z) for z in zip(*out))
    names = pa.array(["observed", "filled", "unsupported", "observed_filled"])
    return pa.table(
        {
            "tid": pa.array(t, pa.int32()),
            "slot": pa.array(sl, pa.int64()),
            "status": names.take(pa.array(st)),
            "n": pa.array(ct, pa.int64()),
            "x": pa.array(fx, pa.float64(), from_pandas=True),
            "y": pa.array(fy, pa.float64(), from_pandas=True),
        }
    )


def regular_grid(tracks: DataFrame, params: GridParams = GridParams()) -> DataFrame:
    """A regular series per source: tid, slot, status, n, x, y.

    ``slot = floor(time / slot_s)`` with the clip's believed clock (see
    ``observation_time``).  Every slot from the first to the last of a source
    comes out once.  ``observed``: at least one row; x and y are the exact
    averages of its distinct readings (null where the rows have no position
    and the source supports none).  ``observed_filled``: at least one row, but
    a coordinate that none of them has is filled; the other is exact.
    ``filled``: no row,
    value from the factorisation.  ``unsupported``: no row and too little
    known; x and y null.  Rows without tid or time are left out; NaN counts as
    null; repeated rows of a (tid, frame) count once; other columns are
    ignored; an empty table gives an empty result.
    """
    p = params
    rows = tracks.select(
        F.col("tid").cast("int").alias("tid"),
        F.col("frame").cast("long").alias("frame"),
        F.xxhash64(F.coalesce("source_clip", F.lit(""))).alias("clip"),
        F.floor(observation_time() / p.slot_s).cast("long").alias("slot"),
        F.nanvl(F.col("pitch_x").cast("double"), F.lit(None).cast("double")).alias("x"),
        F.nanvl(F.col("pitch_y").cast("double"), F.lit(None).cast("double")).alias("y"),
    ).where("tid is not null and slot is not null")
    # one row per (tid, slot, frame) first: repeated rows are equal, so any value of them does
    once = rows.groupBy("tid", "slot", "frame").agg(F.min("clip").alias("clip"), F.max("x").alias("x"), F.max("y").alias("y"))
    obs = once.groupBy("tid", "slot").agg(F.min("clip").alias("clip"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    spans = rows.groupBy("tid").agg(F.min("clip").alias("clip"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    w = p.window
    block_of = lambda c: F.floor(F.col(c) / w).cast("long")
    marks = (
        spans.withColumn("block", F.explode(F.sequence(block_of("lo"), block_of("hi"))))
        .select("tid", "clip", "block", F.lit(0).alias("kind"), F.greatest("lo", F.col("block") * w).alias("slot"), F.least("hi", F.col("block") * w + (w - 1)).alias("hi"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    )
    cells = obs.select("tid", "clip", block_of("slot").alias("block"), F.lit(1).alias("kind"), "slot", F.col("slot").alias("hi"), "n", "x", "y")
    both = marks.unionByName(cells).withColumn("stripe", F.floor(F.col("tid") / p.stripe).cast("long"))
    return map_groups(both, ["clip", "stripe", "block"], ["tid", "slot"], lambda t: _matrix(t, p), "tid int, slot bigint, status string, n bigint, x double, y double")
