import random

import numpy as np

from kinelake.llm.components import UnionFind, connected_components, group_tracklets
from kinelake.llm.nearest import LearnedIndex, nearest_join
from kinelake.llm.quantiles import Sketch, merge_sketches, percentiles, sketch_columns


def components(spark, edges, **kw):
    df = spark.createDataFrame([(*e, "x") for e in edges], "u bigint, v bigint, root string")
    return {r.v: r.root for r in connected_components(df, **kw).collect()}


def brute(edges):
    uf = UnionFind()
    for a, b in edges:
        if a is not None and b is not None:
            uf.union(a, b)
    return {v: uf.find(v) for v in list(uf.parent)}


def test_components_over_a_grid_of_blocks(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(5, 2000 + i) for i in range(150)]  # a hub with a third of the edges
    edges += [(7, 7), (None, 3), (3, None), (9000, 9001), (9001, 9000), (9000, 9001)]
    assert components(spark, edges, edges_per_block=60) == brute(edges)


def test_components_empty_and_loops(spark):
    assert components(spark, []) == {}
    assert components(spark, [(4, 4)]) == {4: 4}


def test_groups_keep_every_tid_and_ignore_ghosts(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (5,), (None,)], "tid int")
    e = spark.createDataFrame([(2, 99), (99, 1), (3, None)], "a_tid int, b_tid int")
    c = spark.createDataFrame([(4, 7), (5, 7), (3, -1), (1, -1), (2, None)], "tid int, player_id bigint")
    got = {(r.tid, r.group_tid, r.n_tids) for r in group_tracklets(t, e, c).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)}


def rank_error(values, estimate, q):
    v = np.sort(values)
    k = max(1, int(np.ceil(q * len(v))))
    lo, hi = np.searchsorted(v, estimate, "left") + 1, np.searchsorted(v, estimate, "right")
    return 0 if lo <= k <= hi else min(abs(lo - k), abs(hi - k))


def test_sketch_keeps_its_bound_in_any_order():
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=40_000), np.arange(40_000.0), np.arange(40_000.0)[::-1], rng.integers(0, 5, 40_000).astype(float), rng.pareto(1, 40_000)):
        s = Sketch(64, 6)
        for part in np.array_split(values, 37):
            s.add(part)
        n, error, got = s.query([0.0, 0.01, 0.5, 0.99, 1.0])
        assert n == len(values) and error < 0.06 * n
        assert all(rank_error(values, g, q) <= error for g, q in zip(got, [0.0, 0.01, 0.5, 0.99, 1.0]))


def test_portions_combine(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=9000), rng.normal(3, 1, size=7000)
    rows = [("k", d, float(v), "z") for d, part in ((1, a), (2, b)) for v in part] + [(None, 1, 5.0, ""), ("k", 1, None, ""), ("k", 1, float("nan"), ""), ("e", 1, None, "")]
    df = spark.createDataFrame(rows, "g string, day int, v double, weight string").repartition(5)
    sk = sketch_columns(df, ["g", "day"], ["v"], k=64)
    out = {(r.g, r.q): r for r in percentiles(merge_sketches(sk, ["g", "day"], 64), ["g"], [0.1, 0.5], 64).collect()}
    both = np.concatenate([a, b])
    for q in (0.1, 0.5):
        r = out["k", q]
        assert r.n == len(both) and rank_error(both, r.value, q) <= r.max_rank_error < 0.05 * r.n
    assert out[None, 0.5].value == 5.0 and out[None, 0.5].max_rank_error == 0 and ("e", 0.5) not in out
    assert percentiles(sketch_columns(df.limit(0), ["g"], ["v"]), ["g"], [0.5]).count() == 0


def test_learned_index_is_exact():
    rng = np.random.default_rng(6)
    shard = np.sort(rng.integers(0, 30, 3000))
    keys = np.where(rng.random(3000) < 0.1, rng.exponential(500, 3000), rng.random(3000) * 10)
    o = np.lexsort((keys, shard))
    shard, keys = shard[o], keys[o]
    index = LearnedIndex(shard, keys, max_error=4)
    qs, q = rng.integers(0, 32, 2000), rng.random(2000) * 20
    at, b, s = index.successor(qs, q)
    for i in range(2000):
        own = np.flatnonzero(shard == qs[i])
        if len(own):
            assert at[i] == own[0] + np.searchsorted(keys[own], q[i]) and (b[i], s[i]) == (own[0], own[-1] + 1)
        else:
            assert b[i] == s[i]


def test_nearest_join_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(e, 1, round(rng.uniform(0, 900), 2), k) for k in range(800) for e in [rng.choice([1, 1, 1, 2, 3])]]
    rows += [(1, 1, 299.95, 5000), (1, 1, 300.05, 5001), (1, 1, 300.05, 4999), (1, 1, None, 1), (None, 1, 5.0, 1), (1, 1, float("nan"), 2)]
    qs = [(i, rng.choice([1, 2, 3, 4]), 1, round(rng.uniform(0, 900), 2)) for i in range(400)] + [(1000, 1, 1, 300.0), (1001, 1, 1, None), (1002, None, 1, 1.0), (1003, 1, None, 1.0), (1004, 9, 1, 3.0)]
    got = {r.qid: (r.entity, r.ref) for r in nearest_join(spark.createDataFrame(qs, "qid bigint, entity int, part bigint, t double"), spark.createDataFrame(rows, "entity int, part bigint, t double, ref int")).collect()}
    want = {}
    for i, e, p, t in qs:
        if e is None or p is None or t is None:
            continue
        c = [(abs(rt - t), rt, ref) for re, rp, rt, ref in rows if re == e and rp == p and rt is not None and rt == rt and abs(rt - t) <= 0.2]
        if c:
            want[i] = (e, min(c)[2])
    assert got == want and got[1000] == (1, 5000)
