"""Implausible readings: spikes, frozen stretches and impossible positions.

Method.  The positions of a source (one ``tid``) are decomposed by an
undecimated lifting wavelet: at the levels 1, 2 and 3 the detail of a row is
its distance from the prediction by the rows 1, 2 and 4 before and after it,
weighted by the frames between, so that even motion over uneven frames has no
detail (plain Haar details of a moving player would be the speed).  At the
ends of a source, where one side is missing, it is the Haar difference to the
other side.

* details are scaled robustly, by the median of the level over all rows of the
  camera;
* a *spike* is a stretch of one to four rows that all have details beyond
  ``loud`` medians at a level whose neighbours lie outside the stretch.  An
  exact check follows: the stretch lies further from the line between the rows
  beside it than ``threshold`` times the first level's median plus what a fast
  runner could cover in the time beside it, and its surroundings agree with
  each other; at the ends of a stretch of presence only one side exists;
* runs of zero Haar details at lag 1, 2, 3 or 4 over at least ``min_repeats``
  rows reveal a *frozen* sensor, also one that flips between a few stored
  readings, in either coordinate;
* *impossible* readings lie more than one pitch beyond the camera's own
  robust extent, or are the sentinel (0, 0).

Units differ by camera, so every scale is the camera's own.  Both passes run
over ``(tid, frame block)`` groups with overlapping edges, so a source of any
length is split over many tasks; the noise scales are mergeable log-scaled
histograms, so the result does not depend on the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.groups import column, map_groups, starts_of
from kinelake.session import cut, join_small
from kinelake.sources.tables import camera_of

LOG_BASE = float(np.log(1.05))
#: Rows between a row and those that predict it, per level of the decomposition.
REACH = (1, 2, 4)
TINY = 1e-6


@dataclass(frozen=True)
class SpikeParams:
    loud: float = 3.5  #: times the camera's median detail of a level: a row that may be in a spike
    threshold: float = 7.0  #: times the camera's median detail of the first level, in the check
    longest: int = 4  #: rows in a spike
    min_repeats: int = 5  #: rows of zero detail that make a stretch frozen
    absence_frames: int = 25  #: a longer hole is an absence
    near_frames: int = 10  #: neighbours within this are used as they are
    least_extent: float = 100.0  #: times the noise: the least width of a pitch
    block_frames: int = 16384
    overlap_frames: int = 2048


def _blocked(tracks: DataFrame, p: SpikeParams) -> DataFrame:
    b, h = p.block_frames, p.overlap_frames
    return (
        tracks.select(
            F.col("tid").cast("int").alias("tid"),
            F.col("frame").cast("int").alias("frame"),
            F.col("pitch_x").cast("double").alias("x"),
            F.col("pitch_y").cast("double").alias("y"),
            F.xxhash64(camera_of()).alias("cam"),
        )
        .where("tid is not null and frame is not null and (x is not null or y is not null)")
        .withColumn("block", F.explode(F.array_distinct(F.array(*[F.floor((F.col("frame") + d) / b).cast("int") for d in (0, -h, h)]))))
        .where("block >= 0 or frame < 0")
    )


def _rows(t: pa.Table, p: SpikeParams) -> tuple[np.ndarray, ...]:
    """tid, block, frame, x, y, owned of a chunk."""
    tid, block, frame = (column(t, c) for c in ("tid", "block", "frame"))
    x, y = column(t, "x"), column(t, "y")
    return tid, block, frame, x, y, frame // p.block_frames == block


def _bins(v: np.ndarray) -> np.ndarray:
    """Signed logarithmic bins, 5 % wide."""
    return (np.sign(v) * (1 + np.maximum(0, np.floor(np.log(np.maximum(np.abs(v), TINY) / TINY) / LOG_BASE)))).astype(np.int32)


def _value(bin_col: str):
    b = F.col(bin_col)
    return F.signum(b) * F.lit(TINY) * F.exp((F.abs(b) - 0.5) * LOG_BASE)


def details(group: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Detail of every row at the level that predicts from ``reach`` rows away,
    and the frames it spans (negative if one-sided).  Rows sorted by group and frame."""
    n = len(group)
    i = np.arange(n)
    a, b = np.maximum(i - reach, 0), np.minimum(i + reach, n - 1)
    left, right = (i >= reach) & (group[a] == group), (i + reach < n) & (group[b] == group)
    span = np.maximum(frame[b].astype(np.int64) - frame[a], 1)
    w = np.where(left & right, (frame - frame[a]) / span, np.where(left, 0.0, 1.0))
    d = np.hypot(x - (x[a] * (1 - w) + x[b] * w), y - (y[a] * (1 - w) + y[b] * w))
    return np.where(left | right, d, 0.0), np.where(left & right, span, -1)


def camera_scales(blocked: DataFrame, p: SpikeParams) -> DataFrame:
    """One row per camera: noise, noise2 and noise4 (median details of the levels), v (typical fast speed per frame) and robust extents."""

    def kernel(t: pa.Table) -> pa.Table | None:
        tid, block, frame, x, y, owned = _rows(t, p)
        cam = column(t, "cam")
        ok = np.isfinite(x) & np.isfinite(y)
        ok[ok] = starts_of(tid[ok], block[ok], frame[ok])
        tid, block, frame, x, y, owned, cam = (a[ok] for a in (tid, block, frame, x, y, owned, cam))
        first = starts_of(tid, block)
        n = len(tid)
        if not n:
            return None
        out = [(np.full(k.sum(), m, np.int32), cam[k], _bins(v[k])) for m, v, k in ((2, x, owned), (3, y, owned))]
        gap = np.full(n, 1e9)
        if n > 1:
            step = np.zeros(n)
            gap[1:] = np.where(first[1:], 1e9, frame[1:] - frame[:-1])
            step[1:] = np.hypot(x[1:] - x[:-1], y[1:] - y[:-1])
            near = owned & (gap <= p.near_frames) & (step > 0)
            out.append((np.full(near.sum(), 1, np.int32), cam[near], _bins(step[near] / gap[near])))
        for metric, reach in zip((0, 4, 5), REACH):
            d, span = details(np.cumsum(first), frame, x, y, reach)
            near = owned & (span > 0) & (span <= 2 * reach * p.near_frames) & (d > 0)
            if reach == 1:  # neighbours on both sides near
                near[:-1] &= gap[1:] <= p.near_frames
                near &= gap <= p.near_frames
            out.append((np.full(near.sum(), metric, np.int32), cam[near], _bins(d[near])))
        m, c, b = (np.concatenate(z) for z in zip(*out))
        counted = pa.table({"cam": c, "metric": m, "bin": b}).group_by(["cam", "metric", "bin"]).aggregate([([], "count_all")])
        return counted.select(["cam", "metric", "bin", "count_all"]).rename_columns(["cam", "metric", "bin", "n"])

    hist = map_groups(blocked, ["tid", "block"], ["frame"], kernel, "cam bigint, metric int, bin int, n bigint", rows=400_000)
    by_bin = hist.groupBy("cam", "metric", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("cam", "metric")
    cum = by_bin.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))

    def at(metric: int, q: float):
        return F.min(F.when((F.col("metric") == metric) & (F.col("cum") >= q * F.col("total")), F.col("bin")))

    wanted = {"noise": (0, 0.5), "noise2": (4, 0.5), "noise4": (5, 0.5), "v": (1, 0.95), "x_lo": (2, 0.01), "x_hi": (2, 0.99), "y_lo": (3, 0.01), "y_hi": (3, 0.99)}
    stats = cum.groupBy("cam").agg(*[at(*a).alias(c) for c, a in wanted.items()])
    return stats.select("cam", *[_value(c).alias(c) for c in wanted])


def _spikes(tid, block, frame, x, y, scales, v, p: SpikeParams) -> np.ndarray:
    """Mask of the rows in spikes; rows sorted, finite, one per (tid, block, frame).

    ``scales``: median details of the levels, per row."""
    n = len(tid)
    hit = np.zeros(n, bool)
    if n < 3:
        return hit
    same = np.zeros(n, bool)  # row i continues row i - 1
    same[1:] = (tid[1:] == tid[:-1]) & (block[1:] == block[:-1])
    gap = np.full(n, 10**9, np.int64)
    gap[1:] = np.where(same[1:], frame[1:].astype(np.int64) - frame[:-1], 10**9)
    step = np.full(n, np.inf)
    step[1:] = np.where(same[1:], np.hypot(x[1:] - x[:-1], y[1:] - y[:-1]), np.inf)
    group = np.cumsum(~same)
    jump = p.threshold * scales[0]
    # rows with a detail beyond the threshold of some level that reaches over a stretch of a length
    loud = np.zeros((len(REACH) + 1, n), bool)
    for k in reversed(range(len(REACH))):
        loud[k] = loud[k + 1] | (details(group, frame, x, y, REACH[k])[0] > p.loud * scales[k])
    for length in range(1, p.longest + 1):
        if n < length + 2:
            break
        i = np.arange(1, n - length)
        a, b = i - 1, i + length
        level = next(k for k, reach in enumerate(REACH) if reach >= length)
        spread = np.minimum.reduce([loud[level][i + k] for k in range(length)])
        i = i[spread & (group[a] == group[b]) & (step[i] > 0.5 * jump[i]) & (step[b] > 0.5 * jump[i])]
        a, b = i - 1, i + length
        least = np.full(len(i), np.inf)
        inside = np.zeros(len(i))
        for k in range(length):
            j = i + k
            w = (frame[j] - frame[a]) / np.maximum(frame[b] - frame[a], 1)
            least = np.minimum(least, np.hypot(x[j] - x[a] - (x[b] - x[a]) * w, y[j] - y[a] - (y[b] - y[a]) * w))
            if k:
                inside = np.maximum(inside, gap[j])
        beside = np.minimum(gap[i], gap[b])  # one impossible move is enough
        back = np.hypot(x[b] - x[a], y[b] - y[a])
        # the surroundings must be confirmed by a second row on one side, where there is one
        before, after = step[a], step[np.minimum(b + 1, n - 1)]
        after = np.where((b + 1 < n) & (group[np.minimum(b + 1, n - 1)] == group[b]), after, np.inf)
        lone = np.isinf(before) & np.isinf(after)
        ok = (least > jump[i] + 2 * v[i] * np.maximum(0, beside - p.near_frames)) & (back < 0.6 * least) & (inside <= p.absence_frames)
        ok &= lone | (before < 0.5 * least) | (after < 0.5 * least)
        for k in range(length):
            hit[i[ok] + k] = True
    # ends of a stretch of presence: few rows that nobody could have moved away from in time
    absent = gap > p.absence_frames
    seg = np.cumsum(absent)
    begin = np.flatnonzero(absent)
    end = np.append(begin[1:], n) - 1
    size = end - begin + 1
    for length in range(1, p.longest):
        for first in (True, False):
            s = size > length + 3
            e = begin[s] + length if first else end[s] - length + 1  # the edge is between e - 1 and e
            inner, outer = (e, e - 1) if first else (e - 1, e)
            sign = 1 if first else -1
            least = np.full(len(e), np.inf)
            tight = np.zeros(len(e))
            for k in range(length):
                j = outer - sign * k
                least = np.minimum(least, np.hypot(x[j] - x[inner], y[j] - y[inner]))
                tight = np.maximum(tight, hit[j] | ~loud[0][j])
            calm = np.zeros(len(e))
            for k in (1, 2, 3):
                calm = np.maximum(calm, np.hypot(x[inner + sign * k] - x[inner], y[inner + sign * k] - y[inner]))
            ok = (least > jump[inner] + 4 * v[inner] * gap[e]) & (calm < 0.3 * least) & (tight == 0)
            for k in range(length):
                hit[outer[ok] - sign * k] = True
    return hit


def _frozen(tid, block, value, p: SpikeParams) -> np.ndarray:
    """Mask of the rows that repeat a stored reading inside a frozen stretch."""
    n = len(tid)
    hit = np.zeros(n, bool)
    for lag in (1, 2, 3, 4):
        zero = np.zeros(n, bool)
        if n > lag:
            zero[lag:] = (value[lag:] == value[:-lag]) & (tid[lag:] == tid[:-lag]) & (block[lag:] == block[:-lag])
        run = np.cumsum(~zero)
        length = np.bincount(run, weights=zero, minlength=run[-1] + 1 if n else 1) if n else np.zeros(1)
        hit |= zero & (length[run] >= p.min_repeats)
    return hit


def flag_implausible(tracks: DataFrame, params: SpikeParams = SpikeParams()) -> DataFrame:
    """Readings of ``tracks`` that are a spike, frozen or impossible.

    Input columns: tid, frame, pitch_x, pitch_y, camera_id, source_clip; any
    other column is ignored.  Output, one row per (tid, frame): tid, frame,
    spike, frozen, impossible (booleans, at least one true).

    Rows without tid or frame, or without any coordinate (null or NaN), are no
    readings and never come out; repeated rows of a (tid, frame) count once;
    a missing camera is recovered from the clip name, else such rows share one
    nameless camera.  An empty table gives an empty result.
    """
    p = params
    blocked = _blocked(tracks, p)
    scales = cut(camera_scales(blocked, p))
    rows = join_small(blocked, scales, "cam")

    def kernel(t: pa.Table) -> pa.Table:
        tid, block, frame, x, y, owned = _rows(t, p)
        s = {c: column(t, c) for c in ("noise", "noise2", "noise4", "v", "x_lo", "x_hi", "y_lo", "y_hi")}
        spike, frozen, far = (np.zeros(len(tid), bool) for _ in range(3))
        both = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        both = both[starts_of(tid[both], block[both], frame[both])]
        spike[both] = _spikes(tid[both], block[both], frame[both], x[both], y[both], [s[c][both] for c in ("noise", "noise2", "noise4")], s["v"][both], p)
        for v, lo, hi in ((x, s["x_lo"], s["x_hi"]), (y, s["y_lo"], s["y_hi"])):
            one = np.flatnonzero(np.isfinite(v))
            one = one[starts_of(tid[one], block[one], frame[one])]
            frozen[one] |= _frozen(tid[one], block[one], v[one], p)
            pad = np.maximum(hi - lo, p.least_extent * s["noise"])  # a camera with little presence has a narrow extent; unknown noise, no bound
            far |= (v > hi + pad) | (v < lo - pad)
        far |= (x == 0) & (y == 0)
        k = np.flatnonzero(owned & (spike | frozen | far))
        got = pa.table({"tid": tid[k], "frame": frame[k], "spike": spike[k], "frozen": frozen[k], "impossible": far[k]})
        got = got.group_by(["tid", "frame"]).aggregate([("spike", "max"), ("frozen", "max"), ("impossible", "max")])
        return got.rename_columns(["tid", "frame", "spike", "frozen", "impossible"])

    return map_groups(rows, ["tid", "block"], ["frame"], kernel, "tid int, frame int, spike boolean, frozen boolean, impossible boolean")
