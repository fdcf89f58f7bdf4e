"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Method.  Every integer interval is decomposed into canonical dyadic blocks (at
most two per level, at every level up to its length) by a closed form, so that
the decomposition stays in the JVM and an interval of any length gives few
blocks.  Blocks are deduplicated with a map-side aggregation.  ``LEVELS``
levels make a tier; a group is an entity's blocks of one tier inside one block
of the tier's top level, so it holds at most ``2 ** (LEVELS + 1)`` blocks
however many intervals overlap there, which is what bounds a task for a hot
entity.  Within the groups blocks covered by an ancestor are removed, sibling
pairs are merged upward, and adjacent blocks are coalesced, for all groups of
a chunk at once.  The runs of all tiers are then joined shard by shard, over
one summary row per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.functions.groups import column, map_groups
from kinelake.session import cut, spread_rows

LEVELS = 14


def dyadic_blocks(lo: str, hi: str) -> Column:
    """Array of (level, idx) structs covering the integers ``lo`` to ``hi`` inclusive; positions below 2 ** 61."""
    left = f"shiftright({lo} + shiftleft(1L, l) - 1, l)"
    right = f"shiftright({hi} + 1, l)"
    levels = f"sequence(0, cast(ceil(log2({hi} - {lo} + 2)) as int))"
    return F.expr(f"""flatten(transform({levels}, l -> filter(array(
        struct(l AS level, {left} AS idx, {left} < {right} AND {left} & 1 = 1 AS used),
        struct(l AS level, {right} - 1 AS idx, {left} < {right} AND {right} & 1 = 1 AS used)), b -> b.used)))""")


def _coalesce(table: pa.Table) -> pa.Table:
    """Runs per (entity, tier, shard) out of its distinct blocks; many groups at a time."""
    ent, tier, shard, level, idx = (column(table, c) for c in ("entity", "tier", "shard", "level", "idx"))
    level = level - LEVELS * tier  # inside the tier
    key = np.zeros(len(ent), np.int64)
    key[1:] = np.cumsum((ent[1:] != ent[:-1]) | (tier[1:] != tier[:-1]) | (shard[1:] != shard[:-1]))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    # composite code at level l: the group number over the block's index inside the shard
    local = idx - (shard << (LEVELS - level))
    code = (key << (LEVELS - level)) | local
    at = [np.unique(code[level == l]) for l in range(LEVELS + 1)]

    def has(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        pos = np.searchsorted(sorted_codes, codes)
        pos[pos == len(sorted_codes)] = 0
        return sorted_codes[pos] == codes if len(sorted_codes) else np.zeros(len(codes), bool)

    for l in range(LEVELS - 1, -1, -1):  # covered by an ancestor
        for up in range(l + 1, LEVELS + 1):
            if len(at[l]) and len(at[up]):
                at[l] = at[l][~has(at[up], at[l] >> (up - l))]
    for l in range(LEVELS):  # siblings become their parent
        c = at[l]
        if len(c) > 1:
            pair = (c[:-1] & 1 == 0) & (c[1:] == c[:-1] + 1)
            if pair.any():
                at[l + 1] = np.union1d(at[l + 1], c[:-1][pair] >> 1)
                gone = np.zeros(len(c), bool)
                gone[:-1] |= pair
                gone[1:] |= pair
                at[l] = c[~gone]
    start = np.concatenate([at[l] << l for l in range(LEVELS + 1)])
    length = np.concatenate([np.full(len(at[l]), 1 << l, np.int64) for l in range(LEVELS + 1)])
    o = np.argsort(start, kind="stable")
    start, stop = start[o], start[o] + length[o]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != stop[:-1]) | (start[1:] >> LEVELS != start[:-1] >> LEVELS)
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(start)) - 1
    g = start[b] >> LEVELS
    base = (shard[first[g]] << LEVELS) - (g << LEVELS)
    unit = (LEVELS * tier[first[g]]).astype(np.int64)  # a tier counts in blocks of the top level below it
    return pa.table({"entity": ent[first[g]], "lo": (start[b] + base) << unit, "hi": ((stop[e] + base) << unit) - 1})


def stretches(intervals: DataFrame) -> DataFrame:
    """entity, lo, hi, before: the maximal stretches without an uncovered
    position, and the end of the stretch before (null for the first)."""
    src = intervals.select(F.col("entity").cast("bigint"), F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).where("entity is not null and lo <= hi")
    blocks = (
        spread_rows(src.distinct())
        .select("entity", F.explode(dyadic_blocks("lo", "hi")).alias("b"))
        .select("entity", F.col("b.level").alias("level"), F.col("b.idx").alias("idx"))
        .distinct()
        .withColumn("tier", F.expr(f"greatest(0, cast(ceil((level - {LEVELS}) / {LEVELS}) as int))"))
        .withColumn("shard", F.expr(f"shiftright(idx, {LEVELS} * (tier + 1) - level)"))
    )
    runs = map_groups(blocks, ["entity", "tier", "shard"], [], _coalesce, "entity bigint, lo bigint, hi bigint", rows=100_000)
    runs = cut(runs.withColumn("shard", F.expr(f"shiftright(lo, {LEVELS})")))
    # only one row per shard is ever sorted per entity: how far earlier shards reach
    over = Window.partitionBy("entity").orderBy("shard")
    reach = runs.groupBy("entity", "shard").agg(F.max("hi").alias("far")).withColumn("far", F.max("far").over(over.rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("entity", "shard").orderBy("lo", "hi")
    before = F.greatest(F.max("hi").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("far"))
    starts = cut(runs.join(reach, ["entity", "shard"]).withColumn("before", before).where("before is null or lo > before + 1").select("entity", "shard", "lo", "before"))
    # a stretch ends where the one after it says it did
    later = starts.groupBy("entity", "shard").agg(F.min(F.struct("lo", "before")).alias("s")).withColumn("then", F.lead("s.before").over(over)).select("entity", "shard", "then")
    last = runs.groupBy("entity").agg(F.max("hi").alias("last"))
    ended = starts.join(later.join(last, "entity"), ["entity", "shard"])
    return ended.select("entity", "lo", F.coalesce(F.lead("before").over(Window.partitionBy("entity", "shard").orderBy("lo")), "then", "last").alias("hi"), "before")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Continuous periods of integer intervals.

    Input: entity (bigint), lo, hi (inclusive, bigint).  Output: entity, lo,
    hi of the maximal stretches without an uncovered position; intervals that
    only touch (hi + 1 = lo) continue each other.  Rows with a null in any of
    the three, or with hi < lo, cover nothing; other columns are ignored;
    repeated and nested intervals change nothing; an empty table gives none.
    """
    return stretches(intervals).select("entity", "lo", "hi")


def interval_gaps(periods: DataFrame) -> DataFrame:
    """Gaps between consecutive periods (entity, lo, hi) as made by ``merge_intervals``:
    entity, lo, hi of the uncovered positions.  Periods are taken shard by
    shard, so that a long-lived entity isn't sorted in one task."""
    p = periods.withColumn("shard", F.expr(f"shiftright(lo, {LEVELS})"))
    inner = Window.partitionBy("entity", "shard").orderBy("lo")
    outer = Window.partitionBy("entity").orderBy("shard")
    edges = p.groupBy("entity", "shard").agg(F.max("hi").alias("last_hi")).withColumn("carried", F.lag("last_hi").over(outer)).select("entity", "shard", "carried")
    before = F.coalesce(F.lag("hi").over(inner), F.col("carried"))
    return p.join(edges, ["entity", "shard"]).withColumn("prev", before).where("prev is not null").select("entity", (F.col("prev") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))


def fragment_spans(fragments: DataFrame) -> DataFrame:
    """Interval of frames of each player fragment: smallest to largest frame,
    with frames = round(t * fps) where ``frames`` is null.  Empty lists, null
    players, ghosts (negative ids) and fragments without any usable frame give
    no interval; null elements are skipped."""
    by_time = F.when(F.col("fps") > 0, F.expr("transform(filter(t, v -> v is not null and not isnan(v)), v -> cast(round(v * fps) as bigint))"))
    frames = F.coalesce(F.expr("transform(frames, v -> cast(v as bigint))"), by_time)
    return (
        fragments.where("player_id >= 0")
        .select(F.col("player_id").alias("entity"), frames.alias("f"))
        .select("entity", F.array_min("f").alias("lo"), F.array_max("f").alias("hi"))
        .where("lo is not null")
    )


def presence(fragments: DataFrame) -> DataFrame:
    """Periods of presence and gaps per player: player_id, kind, start_frame, end_frame."""
    kinds = F.array(F.struct(F.lit("period").alias("kind"), F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.lit("gap").alias("kind"), (F.col("before") + 1).alias("a"), (F.col("lo") - 1).alias("b")))
    both = stretches(fragment_spans(fragments)).select("entity", F.explode(kinds).alias("k")).where("k.a is not null")
    return both.select(F.col("entity").alias("player_id"), "k.kind", F.col("k.a").cast("int").alias("start_frame"), F.col("k.b").cast("int").alias("end_frame"))
