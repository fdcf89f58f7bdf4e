"""Matching records of two tables by nearest time for the same entity.

Method.  Entities are cut into shards of ``shard_s`` seconds; the reference
rows within the tolerance of a shard's edge are also given to the neighbour,
so a query row needs one shard only, and an entity of any length is spread
over many tasks.  In a shard the sorted times get a learned index: linear
segments predict the position of a time, and segments are halved until their
largest error is at most ``MAX_ERROR`` positions.  A query predicts its
position and searches only the rows within that error; whatever the index
says, the result is checked to be the exact neighbour pair (and searched by
bisection where a gap in time breaks the prediction).  All shards of a chunk
are indexed and queried at once with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.groups import column, map_groups
from kinelake.sources.tables import observation_time

SHARD_S = 300.0
TOLERANCE_S = 0.2
MAX_ERROR = 8


class LearnedIndex:
    """Piecewise-linear position index over keys sorted inside consecutive shards."""

    def __init__(self, shard: np.ndarray, keys: np.ndarray, max_error: int = MAX_ERROR) -> None:
        n = len(keys)
        self.shard, self.keys, self.error = shard, keys, max_error
        begin = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)) if n else np.zeros(0, np.int64)
        self.begin, self.stop = begin, np.append(begin[1:], n)
        self.shards = shard[begin]
        lo, hi = begin.copy(), self.stop - 1  # segments, ends inclusive
        done_lo, done_hi = [], []
        while len(lo):
            length = hi - lo + 1
            seg = np.repeat(np.arange(len(lo)), length)
            pos = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + lo[seg]
            error = np.abs(self._predict(pos, lo[seg], hi[seg]) - pos)
            worst = np.maximum.reduceat(error, np.cumsum(length) - length)
            good = (worst <= max_error) | (length <= 2)
            done_lo.append(lo[good])
            done_hi.append(hi[good])
            lo, hi = lo[~good], hi[~good]
            mid = (lo + hi) // 2
            lo, hi = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi])
        self.lo = np.concatenate(done_lo) if done_lo else np.zeros(0, np.int64)
        self.hi = np.concatenate(done_hi) if done_hi else np.zeros(0, np.int64)
        o = np.argsort(self.lo)
        self.lo, self.hi = self.lo[o], self.hi[o]
        self.first_segment = np.searchsorted(self.lo, self.begin)
        self.last_segment = np.append(self.first_segment[1:], len(self.lo)) - 1

    def _predict(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray | None = None) -> np.ndarray:
        a, b = self.keys[lo], self.keys[hi]
        v = self.keys[at] if q is None else q
        return lo + (v - a) / np.where(b > a, b - a, 1.0) * (hi - lo)

    def successor(self, shard: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query: position of the first key >= q in its shard (may be
        the shard's stop), and the shard's bounds; bounds are empty where the shard is unknown."""
        at = np.searchsorted(self.shards, shard)
        known = at < len(self.shards)
        at = np.where(known, at, 0)
        known &= self.shards[at] == shard if len(self.shards) else False
        b, s = np.where(known, self.begin[at], 0), np.where(known, self.stop[at], 0)
        # segment of the query: bisection over the few segments of its shard
        lo_s, hi_s = self.first_segment[at].copy(), self.last_segment[at].copy()
        while True:
            open_ = lo_s < hi_s
            if not open_.any():
                break
            mid = (lo_s + hi_s + 1) // 2
            right = open_ & (self.keys[self.lo[mid]] < q)
            lo_s = np.where(right, mid, lo_s)
            hi_s = np.where(open_ & ~right, mid - 1, hi_s)
        guess = self._predict(np.zeros(len(q), np.int64), self.lo[lo_s], self.hi[lo_s], q)
        guess = np.clip(guess, b, np.maximum(s - 1, b)).astype(np.int64)
        left, right = np.maximum(guess - self.error - 1, b), np.minimum(guess + self.error + 2, s)
        # widen to the whole shard where the local window can't hold the answer
        wrong = ((left > b) & (self.keys[np.maximum(left - 1, 0)] >= q)) | ((right < s) & (self.keys[np.minimum(right, len(self.keys) - 1)] < q))
        left, right = np.where(wrong, b, left), np.where(wrong, s, right)
        while True:  # local bisection
            open_ = left < right
            if not open_.any():
                break
            mid = (left + right) // 2
            less = open_ & (self.keys[np.minimum(mid, len(self.keys) - 1)] < q)
            left = np.where(less, mid + 1, left)
            right = np.where(open_ & ~less, mid, right)
        return left, b, s


def nearest_join(queries: DataFrame, rows: DataFrame, tolerance: float = TOLERANCE_S, shard_s: float = SHARD_S) -> DataFrame:
    """For each query row the reference row nearest in time of the same entity.

    ``queries``: qid bigint, entity int, part bigint, t double; ``rows``:
    entity int, part bigint, t double, ref int.  (entity, part) is the exact
    entity key.  Output: qid, entity, ref, dt, one row per query row with a
    reference row at most ``tolerance`` away (dt = t of the reference less t
    of the query).  Equally near rows: the earlier one, then the smaller ref.
    Null or NaN keys and times never match; repeated reference rows change
    nothing; other columns are ignored; empty tables give an empty result.
    """
    keep = ["entity", "part", "shard", "t", "side", "id"]
    shard_of = lambda t: F.floor(t / F.lit(shard_s)).cast("long")

    def sane(df: DataFrame) -> DataFrame:
        return df.where("entity is not null and part is not null and t is not null and not isnan(t)")

    q = sane(queries).select("entity", "part", shard_of(F.col("t")).alias("shard"), "t", F.lit(1).alias("side"), F.col("qid").alias("id"))
    near = F.array_distinct(F.array(*[shard_of(F.col("t") + d) for d in (0.0, -tolerance * 1.001, tolerance * 1.001)]))
    r = sane(rows).select("entity", "part", F.explode(near).alias("shard"), "t", F.lit(0).alias("side"), F.col("ref").cast("bigint").alias("id"))

    def kernel(t: pa.Table) -> pa.Table | None:
        ent, part, shard, time, side, ident = (column(t, c) for c in keep)
        group = np.cumsum(np.concatenate([[False], (ent[1:] != ent[:-1]) | (part[1:] != part[:-1]) | (shard[1:] != shard[:-1])]))
        is_q = side == 1
        asked = np.zeros(group[-1] + 1, bool)
        asked[group[is_q]] = True
        ref = ~is_q & asked[group]
        if not ref.any():
            return None
        gr, tr, ir = group[ref], time[ref], ident[ref]
        gq, tq, iq, eq = group[is_q], time[is_q], ident[is_q], ent[is_q]
        index = LearnedIndex(gr, tr)
        after, begin, stop = index.successor(gq, tq)
        inf = np.inf
        at_after, at_before = np.minimum(after, len(tr) - 1), np.maximum(after - 1, 0)
        d_after = np.where(after < stop, tr[at_after] - tq, inf)
        d_before = np.where(after > begin, tq - tr[at_before], inf)
        first = d_before <= d_after
        # of several rows at the earlier time take the first, i.e. the smallest ref
        start = np.where(first, at_before, at_after)
        while True:
            more = first & (start > begin) & (tr[np.maximum(start - 1, 0)] == tr[start])
            if not more.any():
                break
            start = np.where(more, start - 1, start)
        best = np.minimum(d_before, d_after)
        hit = best <= tolerance
        return pa.table({"qid": iq[hit], "entity": eq[hit], "ref": ir[start[hit]].astype(np.int32), "dt": np.where(first, -d_before, d_after)[hit]})

    both = q.unionByName(r)
    return map_groups(both, ["entity", "part", "shard"], ["side", "t", "id"], kernel, "qid bigint, entity int, ref int, dt double")


def camera_part(camera_id: str = "camera_id") -> Column:
    """Numeric stand-in for a camera in the entity key; null stays null."""
    return F.when(F.col(camera_id).isNotNull(), F.xxhash64(camera_id))


def detections_to_tracks(gt: DataFrame, tracks: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """det_id, tid, frame, dt: for each det_id the row of tracks nearest in
    time with tid = tracklet_id and the same non-null camera_id, no more than
    ``tolerance`` seconds away.  A repeated det_id comes out once, with its
    nearest match (ties: smaller tid, then frame)."""
    q = gt.select(F.col("det_id").alias("qid"), F.col("tracklet_id").alias("entity"), camera_part().alias("part"), F.col("t").cast("double").alias("t")).where("qid is not null")
    r = tracks.select(F.col("tid").alias("entity"), camera_part().alias("part"), observation_time().alias("t"), F.col("frame").alias("ref")).where("ref is not null")
    found = nearest_join(q, r, tolerance)
    best = F.min(F.struct(F.abs("dt").alias("d"), F.col("entity"), F.col("ref"), F.col("dt"))).alias("b")
    return found.groupBy("qid").agg(best).select(F.col("qid").alias("det_id"), F.col("b.entity").alias("tid"), F.col("b.ref").alias("frame"), F.col("b.dt").alias("dt"))
