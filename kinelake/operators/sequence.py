"""Grouped kernels over clips and tracks: duplicates, identities, possession, smoothing.

Each operator shuffles the canonical view (or its coarse form) on integer
keys and runs a numpy kernel over whole groups; a group is a clip or a track
and so bounded by its recording.  Rows without a place take no part; repeated
rows are gone in the view; empty input gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import kernels as K
from kinelake.functions.groups import column, map_groups
from kinelake.operators.pairs import _players, _spans, coarse, continuation_candidates, framed, greedy_owner, link_candidates
from kinelake.operators.tracks import placed


def _by(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[dict[str, np.ndarray]], dict | None], schema: str, lone: Callable[[dict[str, np.ndarray]], dict] | None = None) -> DataFrame:
    """Run ``fn`` on the columns of each group; its dict of columns becomes rows.

    ``lone``, if given, takes all groups of a single row at once instead."""
    names = df.columns
    out_names = [p.split()[0] for p in schema.split(", ")]

    def groups(t: pa.Table) -> Iterator[dict[str, np.ndarray]]:
        cols = {c: column(t, c) for c in names}
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], t.num_rows)
        if lone is not None:
            single = ends - at == 1
            yield {c: v[at[single]] for c, v in cols.items()}
            at, ends = at[~single], ends[~single]
        for a, b in zip(at, ends):
            yield {c: v[a:b] for c, v in cols.items()}

    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = pa.schema([pa.field(p.split()[0], types[p.split()[1]]) for p in schema.split(", ")])

    def kernel(t: pa.Table) -> pa.Table | None:
        parts = [o for k, g in enumerate(groups(t)) if (o := (lone if lone is not None and k == 0 else fn)(g)) is not None and len(o[out_names[0]])]
        if not parts:
            return None
        return pa.table([pa.array(np.concatenate([np.asarray(p[c]) for p in parts]), f.type, from_pandas=True) for c, f in zip(out_names, fields)], schema=fields)

    return map_groups(df, keys, order, kernel, schema)


def _clip_key(df: DataFrame) -> DataFrame:
    return df.withColumn("ck", F.xxhash64("clip")).drop("clip")


def nms(t: DataFrame, least: float = 0.3, clock: Callable[[DataFrame], DataFrame] = coarse) -> DataFrame:
    """Greedy non-maximum suppression of boxes per step of the clock (``framed``: every row in its own frame); rows kept."""
    c = clock(t).where("box_h > 0 and box_w > 0 and fx is not null and fy is not null")

    def fn(g: dict) -> dict:
        b = np.stack([g["fx"] - g["box_w"] / 2, g["fy"] - g["box_h"], g["fx"] + g["box_w"] / 2, g["fy"]], 1)
        keep = K.greedy_keep(g["conf"], K.iou_matrix(b) > least)
        return {"tid": g["tid"][keep], "g": g["g"][keep]}

    return _by(_clip_key(c).drop("zone"), ["ck", "g"], ["tid"], fn, "tid int, g int", lambda g: {"tid": g["tid"], "g": g["g"]})


def inframe_dedup_greedy(t: DataFrame, radius: float = 2.0, clock: Callable[[DataFrame], DataFrame] = coarse) -> DataFrame:
    """Exact keep-best duplicates per step of the clock (``framed``: every row in its own frame): rows dropped."""

    def fn(g: dict) -> dict:
        d = np.hypot(g["x"][:, None] - g["x"][None], g["y"][:, None] - g["y"][None]) < radius
        keep = K.greedy_keep(np.round(g["conf"] * g["box_h"], 6), d)
        return {"tid": g["tid"][~keep], "g": g["g"][~keep]}

    return _by(_clip_key(clock(t)).drop("zone"), ["ck", "g"], ["tid"], fn, "tid int, g int", lambda g: {"tid": g["tid"][:0], "g": g["g"][:0]})


def dedup_concurrency(t: DataFrame, radius: float = 1.0) -> DataFrame:
    """99th percentile per clip of the number of groups of rows of a frame within the radius."""

    def fn(g: dict) -> dict:
        n = K.dbscan_1(np.stack([g["x"], g["y"]], 1), radius, 1).max() + 1
        return {"ck": g["ck"][:1], "n": np.array([n])}

    per = _by(_clip_key(framed(t)).drop("zone"), ["ck", "g"], ["tid"], fn, "ck bigint, n int", lambda g: {"ck": g["ck"], "n": np.ones(len(g["ck"]), int)})
    clips = t.groupBy("clip").agg(F.xxhash64("clip").alias("ck"))
    return per.groupBy("ck").agg(F.percentile("n", F.lit(0.99)).alias("p99")).join(clips, "ck").select("clip", "p99")


def _observed(gt: DataFrame, tracklets: DataFrame) -> DataFrame:
    """det_id, clip, t, px, py and image zone of each placed observation whose tracklet's clip is known; repeated ones count once."""
    clip = tracklets.where("tid is not null and source_clip is not null").groupBy(F.col("tid").alias("tracklet_id")).agg(F.min("source_clip").alias("clip"))
    g = gt.where("det_id is not null and t is not null and px is not null and py is not null and not isnan(t) and not isnan(px) and not isnan(py)")
    g = g.groupBy("det_id").agg(F.min(F.struct("tracklet_id", "t", "px", "py", "y1")).alias("o")).select("det_id", "o.*").join(clip, "tracklet_id")
    zone = F.when(F.col("y1").isNull(), "unknown").when(F.col("y1") < 360, "far").when(F.col("y1") < 560, "mid").otherwise("near")
    return g.select("det_id", "clip", "t", "px", "py", zone.alias("zone"))


def greedy_match(t: DataFrame, gt: DataFrame, tracklets: DataFrame, radius: float = 3.0, within: float = 0.2) -> DataFrame:
    """Global greedy nearest matching of the second observer's detections to the tracks' rows.

    A detection may match any track of its clip by the track's row nearest in
    time (no more than ``within`` seconds away) if that lies within the
    radius; nearest pairs first, each detection and each row once."""
    slot = lambda c: F.floor(F.col(c) / within).cast("long")
    g = _observed(gt, tracklets).select("clip", "det_id", F.col("t").alias("gt_t"), "px", "py", F.explode(F.array(*[slot("t") + d for d in (-1, 0, 1)])).alias("slot"))
    p = placed(t).where("t is not null").select("clip", "tid", "frame", "t", "x", "y", slot("t").alias("slot"))
    away = F.round(F.abs(F.col("t") - F.col("gt_t")), 6)
    j = p.join(g, ["clip", "slot"]).withColumn("away", away).where(F.col("away") <= within)
    near = j.groupBy("clip", "det_id", "tid").agg(F.min(F.struct("away", "frame", "x", "y", "px", "py")).alias("o")).select("clip", "det_id", "tid", "o.*")
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    c = near.withColumn("d", F.round(F.sqrt(dx * dx + dy * dy), 6)).where(F.col("d") <= radius).select("clip", "det_id", "tid", "frame", "d")

    def fn(g: dict) -> dict:
        used_a, used_b, out = set(), set(), []
        for k in np.lexsort((g["frame"], g["tid"], g["det_id"], g["d"])):
            a, b = int(g["det_id"][k]), (int(g["tid"][k]), int(g["frame"][k]))
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                out.append(k)
        return {n: g[n][out] for n in ("det_id", "tid", "frame", "d")}

    return _by(_clip_key(c), ["ck"], ["det_id", "tid"], fn, "det_id bigint, tid int, frame int, d double")


def stitch(t: DataFrame, no_link: float = 0.9, gap: float = 8.0) -> DataFrame:
    """Identities: cheapest path cover of the link candidates, then unions in order of cost unless lives overlap.

    No track is lost; two tracks alive at the same time never share an
    identity; player_id is the smallest tid of the identity."""
    e = link_candidates(t, gap).select("clip", F.lit(1).alias("kind"), F.col("tid_a").alias("a"), F.col("tid_b").alias("b"), (F.col("gap") / gap + F.col("req_speed") / 8).alias("cost"))
    s = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).select("clip", F.lit(0).alias("kind"), F.col("tid").alias("a"), F.col("f0").alias("b"), F.col("f1").cast("double").alias("cost"))

    def fn(g: dict) -> dict:
        node = g["kind"] == 0
        tids, f0, f1 = g["a"][node], g["b"][node], g["cost"][node]
        at = {int(v): i for i, v in enumerate(tids)}
        edges = [(at[int(a)], at[int(b)], float(c)) for a, b, c in zip(g["a"][~node], g["b"][~node], g["cost"][~node]) if int(a) in at and int(b) in at]
        dsu = K.CannotLink(f0, f1)
        for a, b, _ in K.path_cover(len(tids), edges, no_link):
            dsu.union(a, b)
        return {"tid": tids, "player_id": tids[[dsu.find(i) for i in range(len(tids))]]}

    return _by(_clip_key(s.unionByName(e)), ["ck"], ["kind", "a", "b"], fn, "tid int, player_id int")


def consolidate(t: DataFrame) -> DataFrame:
    """Duplicates of a frame dropped, then stitched over long gaps."""
    drop = inframe_dedup_greedy(t, clock=framed).withColumnRenamed("g", "frame")
    return stitch(t.join(drop, ["tid", "frame"], "left_anti"), gap=90.0)


def cluster_merge(t: DataFrame, gap: float = 30.0, vmax: float = 8.0) -> DataFrame:
    """Repeatedly merge the first pair, in list order, where one identity ends before the other and the seam is reachable."""
    s = _spans(t).select("clip", "tid", "t0", "t1", "x0", "y0", "x1", "y1")

    def fn(g: dict) -> dict:
        c = [dict(ids=[i], t0=g["t0"][i], t1=g["t1"][i], a=(g["x0"][i], g["y0"][i]), b=(g["x1"][i], g["y1"][i])) for i in range(len(g["tid"]))]
        again = True
        while again:
            again = False
            for i in range(len(c)):
                for j in range(len(c)):
                    wait = c[j]["t0"] - c[i]["t1"]
                    if i != j and 0 < wait <= gap and np.hypot(c[j]["a"][0] - c[i]["b"][0], c[j]["a"][1] - c[i]["b"][1]) / wait <= vmax:
                        c[i] = dict(ids=c[i]["ids"] + c[j]["ids"], t0=c[i]["t0"], t1=c[j]["t1"], a=c[i]["a"], b=c[j]["b"])
                        del c[j]
                        again = True
                        break
                if again:
                    break
        root = np.zeros(len(g["tid"]), np.int64)
        for k in c:
            root[k["ids"]] = g["tid"][k["ids"]].min()
        return {"tid": g["tid"], "cluster": root}

    return _by(_clip_key(s), ["ck"], ["tid"], fn, "tid int, cluster int")


def gta_connect(t: DataFrame, gap: float = 5.0) -> DataFrame:
    """Greedy connection by required speed: one successor and predecessor each, no overlapping lives."""
    e = link_candidates(t, gap, 7.0).select("clip", F.lit(1).alias("kind"), F.col("tid_a").alias("a"), F.col("tid_b").alias("b"), F.col("req_speed").alias("cost"), "gap")
    s = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).select("clip", F.lit(0).alias("kind"), F.col("tid").alias("a"), F.col("f0").alias("b"), F.col("f1").cast("double").alias("cost"), F.lit(0.0).alias("gap"))

    def fn(g: dict) -> dict:
        node = g["kind"] == 0
        tids = g["a"][node]
        at = {int(v): i for i, v in enumerate(tids)}
        dsu = K.CannotLink(g["b"][node], g["cost"][node])
        nxt, prv = set(), set()
        for k in np.lexsort((g["b"], g["a"], g["gap"], g["cost"])):
            if not node[k]:
                a, b = at.get(int(g["a"][k])), at.get(int(g["b"][k]))
                if a is not None and b is not None and a not in nxt and b not in prv and dsu.union(a, b):
                    nxt.add(a)
                    prv.add(b)
        return {"tid": tids, "player_id": tids[[dsu.find(i) for i in range(len(tids))]]}

    return _by(_clip_key(s.unionByName(e)), ["ck"], ["kind", "a", "b"], fn, "tid int, player_id int")


def fuse(t: DataFrame) -> DataFrame:
    """Continuations joined cheapest first under the no-overlap rule."""
    e = continuation_candidates(t).select("clip", F.lit(1).alias("kind"), F.col("tid_a").alias("a"), F.col("tid_b").alias("b"), "cost")
    s = t.groupBy("clip", "tid").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1")).select("clip", F.lit(0).alias("kind"), F.col("tid").alias("a"), F.col("f0").alias("b"), F.col("f1").cast("double").alias("cost"))

    def fn(g: dict) -> dict:
        node = g["kind"] == 0
        tids = g["a"][node]
        at = {int(v): i for i, v in enumerate(tids)}
        dsu = K.CannotLink(g["b"][node], g["cost"][node])
        for k in np.lexsort((g["b"], g["a"], g["cost"])):
            if not node[k] and int(g["a"][k]) in at and int(g["b"][k]) in at:
                dsu.union(at[int(g["a"][k])], at[int(g["b"][k])])
        return {"tid": tids, "fused_id": tids[[dsu.find(i) for i in range(len(tids))]]}

    return _by(_clip_key(s.unionByName(e)), ["ck"], ["kind", "a", "b"], fn, "tid int, fused_id int")


def gta_split(t: DataFrame, jump: float = 6.0, least: int = 5, eps: float = 3.0) -> DataFrame:
    """Cut a track at a teleport where the places before and after fall into different dense regions."""

    def fn(g: dict) -> dict:
        p = np.stack([g["x"], g["y"]], 1)
        seg = np.zeros(len(p), int)
        step = np.hypot(*np.diff(p, axis=0).T) if len(p) > 1 else np.zeros(0)
        cuts = [k + 1 for k in np.flatnonzero(step > jump) if k + 1 >= least and len(p) - k - 1 >= least]
        k = 0
        for c in cuts:
            near = slice(max(0, c - 10), min(len(p), c + 10))
            label = K.dbscan_1(p[near], eps, 3)
            a, b = label[: c - near.start], label[c - near.start :]
            if len(a) and len(b) and np.bincount(a + 1).argmax() != np.bincount(b + 1).argmax():
                k += 1
                seg[c:] = k
        return {"tid": g["tid"], "frame": g["frame"], "part": seg}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, frame int, part int")


def presplit(t: DataFrame, jump: float = 3.0, least: int = 5) -> DataFrame:
    """Cut at teleports from left to right when both sides keep enough rows; the guard looks at the remaining tail."""

    def fn(g: dict) -> dict:
        n = len(g["frame"])
        step = np.hypot(np.diff(g["x"]), np.diff(g["y"])) if n > 1 else np.zeros(0)
        part, begin, k = np.zeros(n, int), 0, 0
        for c in np.flatnonzero(step > jump) + 1:
            if c - begin >= least and n - c >= least:
                k += 1
                part[c:] = k
                begin = c
        return {"tid": g["tid"], "frame": g["frame"], "part": part}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, frame int, part int")


def kinematics_smoothed(t: DataFrame, window: int = 13) -> DataFrame:
    """Smoothed places and the distance along them."""

    def fn(g: dict) -> dict:
        sx, sy = K.savgol(g["x"], window), K.savgol(g["y"], window)
        return {"tid": g["tid"][:1], "n": np.array([len(sx)]), "distance": np.array([np.hypot(np.diff(sx), np.diff(sy)).sum()])}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, n int, distance double")


def savgol(t: DataFrame, window: int = 13) -> DataFrame:
    def fn(g: dict) -> dict:
        return {"tid": g["tid"], "frame": g["frame"], "sx": K.savgol(g["x"], window), "sy": K.savgol(g["y"], window)}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, frame int, sx double, sy double")


def gsi_fill(t: DataFrame, max_gap: int = 25, around: int = 10) -> DataFrame:
    """Holes of at most ``max_gap`` frames filled by a Gaussian process over the rows around them."""

    def fn(g: dict) -> dict:
        f = g["frame"].astype(float)
        out = [[], [], []]
        for k in np.flatnonzero((np.diff(f) > 1) & (np.diff(f) <= max_gap)):
            s = slice(max(0, k + 1 - around), k + 1 + around)
            at = np.arange(f[k] + 1, f[k + 1])
            out[0] += at.tolist()
            out[1] += K.gaussian_fill(f[s], g["x"][s], at).tolist()
            out[2] += K.gaussian_fill(f[s], g["y"][s], at).tolist()
        return {"tid": np.full(len(out[0]), g["tid"][0]), "frame": np.array(out[0], int), "x": np.array(out[1]), "y": np.array(out[2])}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, frame int, x double, y double")


def postprocess(t: DataFrame, vmax: float = 12.0, fps: float = 25.0) -> DataFrame:
    """Rows rejected as teleports against the last kept row are dropped, the rest smoothed and clamped to the largest step."""

    def fn(g: dict) -> dict:
        keep = [0]
        for i in range(1, len(g["x"])):
            k = keep[-1]
            if np.hypot(g["x"][i] - g["x"][k], g["y"][i] - g["y"][k]) <= vmax * max(1, g["frame"][i] - g["frame"][k]) / fps + 1.0:
                keep.append(i)
        keep = np.array(keep)
        x, y, f = K.savgol(g["x"][keep], 15), K.savgol(g["y"][keep], 15), g["frame"][keep]
        for i in range(1, len(x)):
            limit = vmax * (f[i] - f[i - 1]) / fps
            d = np.hypot(x[i] - x[i - 1], y[i] - y[i - 1])
            if d > limit > 0:
                x[i] = x[i - 1] + (x[i] - x[i - 1]) * limit / d
                y[i] = y[i - 1] + (y[i] - y[i - 1]) * limit / d
        return {"tid": g["tid"][keep], "frame": f, "x": x, "y": y}

    return _by(placed(t).select("tid", "frame", "x", "y"), ["tid"], ["frame"], fn, "tid int, frame int, x double, y double")


def possession_viterbi(t: DataFrame) -> DataFrame:
    """Owner per coarse frame of a clip: distance to the focus, switches penalised."""

    def fn(g: dict) -> dict:
        steps, begin = np.unique(g["g"], return_index=True)
        pos = np.stack([g["x"], g["y"]], 1)
        parts = [slice(a, b) for a, b in zip(begin, np.append(begin[1:], len(pos)))]
        unary = [np.hypot(*(pos[p] - pos[p].mean(0)).T) for p in parts]
        return {"ck": np.full(len(steps), g["ck"][0]), "g": steps, "owner": K.viterbi_present([g["tid"][p] for p in parts], unary, [pos[p] for p in parts])}

    got = _by(_clip_key(coarse(t)).select("ck", "g", "tid", "x", "y"), ["ck"], ["g", "tid"], fn, "ck bigint, g int, owner int")
    return got.join(t.groupBy("clip").agg(F.xxhash64("clip").alias("ck")), "ck").select("clip", "g", "owner")


def kickoff_events(t: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Kickoffs per clip from readiness of the tracklets' teams and the side of the tracks' centroid."""
    from kinelake.operators.game import kickoff_readiness

    s = kickoff_readiness(t, tracklets).withColumn("ck", F.xxhash64("clip"))

    def fn(g: dict) -> dict:
        f = K.kickoff_events(g["g"], g["ready"], g["side"])
        return {"ck": np.full(len(f), g["ck"][0]), "frame": np.array(f, int)}

    got = _by(s.select("ck", "g", "ready", "side"), ["ck"], ["g"], fn, "ck bigint, frame int")
    return got.join(t.groupBy("clip").agg(F.xxhash64("clip").alias("ck")), "ck").select("clip", "frame")


def role_timeline(t: DataFrame, window: int = 40, residence: float = 0.45, hold: float = 1.3, depth: float = 7.0) -> DataFrame:
    """Holder of the goalkeeper role per coarse frame: most resident track of the trailing window, a challenger must win by ``hold``."""

    def fn(g: dict) -> dict:
        steps = np.unique(g["g"])
        out, holder = [], -1
        for s in steps:
            w = (g["g"] > s - window) & (g["g"] <= s)
            ids, n = np.unique(g["tid"][w & (g["x"] < depth)], return_counts=True)
            score = dict(zip(ids.tolist(), (n / max(1, len(np.unique(g["g"][w])))).tolist()))
            best = max(score, key=lambda k: (score[k], -k), default=-1)
            if best >= 0 and score[best] >= residence and (holder not in score or score[best] > hold * score[holder]):
                holder = best
            out.append(holder)
        return {"ck": np.full(len(steps), g["ck"][0]), "g": steps, "holder": np.array(out)}

    got = _by(_clip_key(coarse(t)).select("ck", "g", "tid", "x"), ["ck"], ["g", "tid"], fn, "ck bigint, g int, holder int")
    return got.join(t.groupBy("clip").agg(F.xxhash64("clip").alias("ck")), "ck").select("clip", "g", "holder")


def tracklet_builder(t: DataFrame, reach: float = 2.0, stale: int = 3) -> DataFrame:
    """Conservative tracklets: optimal assignment of the rows of consecutive coarse frames within reach, no bridging."""

    def fn(g: dict) -> dict:
        active: dict[int, tuple[int, float, float]] = {}
        label, nxt = np.zeros(len(g["g"]), int), 0
        for s in np.unique(g["g"]):
            rows = np.flatnonzero(g["g"] == s)
            active = {k: v for k, v in active.items() if s - v[0] <= stale}
            ids = sorted(active)
            taken = np.full(len(rows), -1)
            if ids:
                d = np.array([[np.hypot(g["x"][r] - active[i][1], g["y"][r] - active[i][2]) for i in ids] for r in rows])
                cost = np.concatenate([np.where(d <= reach, d, 1e6), np.full((len(rows), len(rows)), 2 * reach)], 1)
                taken = K.assignment(cost)
            for r, j in zip(rows, taken):
                if 0 <= j < len(ids) and np.hypot(g["x"][r] - active[ids[j]][1], g["y"][r] - active[ids[j]][2]) <= reach:
                    label[r] = ids[j]
                else:
                    label[r] = nxt
                    nxt += 1
                active[label[r]] = (s, g["x"][r], g["y"][r])
        return {"ck": g["ck"], "g": g["g"], "tid": g["tid"], "tracklet": label}

    got = _by(_clip_key(coarse(t)).select("ck", "g", "tid", "x", "y"), ["ck"], ["g", "tid"], fn, "ck bigint, g int, tid int, tracklet int")
    return got.drop("ck")


def static_fp(t: DataFrame, radius: float = 26.0, share: float = 0.2, spread: float = 14.0) -> DataFrame:
    """Recurrent detections at one spot: greedy spots in ascending foot_y, present in a share of the coarse frames and hardly moving; every row counts."""

    def fn(g: dict) -> dict:
        order = np.lexsort((g["tid"], g["frame"], g["fx"], g["fy"]))
        spots: list[list[int]] = []
        centre: list[tuple[float, float]] = []
        heights: list[float] = []
        for i in order:
            # rows come in ascending foot_y, so only spots begun within the radius above can take one
            low = bisect.bisect_left(heights, g["fy"][i] - radius)
            near = next((k for k in range(low, len(centre)) if np.hypot(centre[k][0] - g["fx"][i], centre[k][1] - g["fy"][i]) <= radius), None)
            if near is not None:
                spots[near].append(i)
            else:
                spots.append([i])
                centre.append((g["fx"][i], g["fy"][i]))
                heights.append(g["fy"][i])
        frames = len(np.unique(g["g"]))
        hit = [k for k, s in enumerate(spots) if len(np.unique(g["g"][s])) >= share * frames and g["fx"][s].std() < spread and g["fy"][s].std() < spread and frames >= 5]
        return {"ck": np.full(len(hit), g["ck"][0]), "u": np.array([centre[k][0] for k in hit]), "v": np.array([centre[k][1] for k in hit]), "n": np.array([len(spots[k]) for k in hit], int)}

    c = framed(t, 5).where("fx is not null and fy is not null")
    return _by(_clip_key(c).select("ck", "g", "frame", "tid", "fx", "fy"), ["ck"], ["frame", "tid"], fn, "ck bigint, u double, v double, n int").drop("ck")


def kmeans2(t: DataFrame) -> DataFrame:
    """Two groups of tracks per clip by mean place and height."""
    s = placed(t).groupBy("clip", "tid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))

    def fn(g: dict) -> dict:
        return {"tid": g["tid"], "team": K.two_means(np.stack([g["x"], g["y"]], 1))}

    return _by(_clip_key(s), ["ck"], ["tid"], fn, "tid int, team int")


def coreset_kcenter(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """Farthest-first selection of k vectors per label from its smallest vec_id (labels hold bounded sets of frames).

    All components count; the table has no weights, so all weigh the same; what a shorter vector lacks is zero."""
    e = embeddings.where("label is not null and size(embedding) > 0")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    e = e.select(F.col("label").cast("int").alias("label"), "vec_id", *[F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0)).alias(f"e{i}") for i in range(dims)])

    def fn(g: dict) -> dict:
        p = np.stack([g[f"e{i}"] for i in range(dims)], 1)
        c = K.k_centre(p, np.ones(len(p)), k)
        return {"label": g["label"][c], "vec_id": g["vec_id"][c], "rank": np.arange(len(c))}

    return _by(e, ["label"], ["vec_id"], fn, "label int, vec_id bigint, rank int")


def global_stitch(embeddings: DataFrame, gate: float = 0.9, size: int = 5) -> DataFrame:
    """Agglomerative identities per label: tracklets of ``size`` vectors merged by the closest mean direction within the gate."""
    dims = 64
    e = embeddings.where(f"label is not null and size(embedding) = {dims}").select(F.col("label").cast("int").alias("label"), F.col("vec_id").cast("bigint").alias("vec_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(dims)])

    def fn(g: dict) -> dict:
        p = np.stack([g[f"e{i}"] for i in range(dims)], 1)
        tracklet = np.arange(len(p)) // size
        total = np.stack([p[tracklet == k].sum(0) for k in range(tracklet[-1] + 1)])
        live = list(range(len(total)))
        root = np.arange(len(total))
        while len(live) > 1:
            u = total[live] / np.maximum(np.linalg.norm(total[live], axis=1, keepdims=True), 1e-12)
            d = 1 - u @ u.T
            d[np.tril_indices(len(live))] = np.inf
            i, j = np.unravel_index(int(np.argmin(d)), d.shape)
            if d[i, j] > gate * 0.5:
                break
            total[live[i]] += total[live[j]]
            root[root == live[j]] = live[i]
            del live[j]
        return {"label": g["label"], "vec_id": g["vec_id"], "identity": root[tracklet]}

    return _by(e, ["label"], ["vec_id"], fn, "label int, vec_id bigint, identity int")


def keep_if_changed(matches: DataFrame, least: int = 10) -> DataFrame:
    """Sequential dedup of hashes per venue: a match stays if its hash differs enough from the last one kept."""
    from kinelake.operators.catalog import latest_matches

    m = latest_matches(matches).where("venue is not null").select(F.xxhash64("venue").alias("vk"), "id", (F.col("id").cast("bigint") * F.lit(2654435761) % F.lit(4294967296)).alias("h"))

    def fn(g: dict) -> dict:
        keep, last = [], None
        for i, h in enumerate(g["h"].tolist()):
            if last is None or (h ^ last).bit_count() > least:
                keep.append(i)
                last = h
        return {"id": g["id"][keep]}

    return _by(m, ["vk"], ["id"], fn, "id int")


def idf1(t: DataFrame, labels: DataFrame) -> DataFrame:
    """Identity F1 of the stitched identities against the labelled players, per clip: optimal one-to-one matching of rows."""
    s = stitch(t).withColumnRenamed("player_id", "pred")
    rows = t.groupBy("clip", "tid").agg(F.count(F.lit(1)).alias("n")).join(s, "tid").join(_players(labels), "tid")
    c = rows.groupBy("clip", "player_id", "pred").agg(F.sum("n").alias("n"))

    def fn(g: dict) -> dict:
        a, i = np.unique(g["player_id"], return_inverse=True)
        b, j = np.unique(g["pred"], return_inverse=True)
        m = np.zeros((len(a), len(b)))
        m[i, j] = g["n"]
        if len(a) > len(b):
            m = m.T
        hit = m[np.arange(len(m)), K.assignment(-m)].sum()
        return {"ck": g["ck"][:1], "rows": np.array([int(g["n"].sum())]), "idf1": np.array([hit / g["n"].sum()])}

    got = _by(_clip_key(c), ["ck"], ["player_id", "pred"], fn, "ck bigint, rows bigint, idf1 double")
    return got.join(t.groupBy("clip").agg(F.xxhash64("clip").alias("ck")), "ck").select("clip", "rows", "idf1")


def recall_by_zone(t: DataFrame, gt: DataFrame, tracklets: DataFrame, radius: float = 3.0) -> DataFrame:
    """Share of the second observer's detections matched to a track's row, per image zone (greedy matching)."""
    m = greedy_match(t, gt, tracklets, radius).select("det_id", F.lit(1).alias("hit"))
    return _observed(gt, tracklets).join(m, "det_id", "left").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall"))
