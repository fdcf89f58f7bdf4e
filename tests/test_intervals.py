import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinelake.operators.intervals import interval_gaps, merge_intervals, presence

SCHEMA = "entity bigint, lo bigint, hi bigint, shard string, level string"


def brute(rows):
    out = []
    for e in sorted({r[0] for r in rows if r[0] is not None}):
        cur = None
        for a, b in sorted((r[1], r[2]) for r in rows if r[0] == e and r[1] is not None and r[2] is not None and r[1] <= r[2]):
            if cur and a <= cur[1] + 1:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    out.append((e, *cur))
                cur = [a, b]
        if cur:
            out.append((e, *cur))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, merge_intervals(df).collect()))


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for e in range(30):
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(-300, 300) if e % 2 else rng.randint(0, 100_000)
            rows.append((e, a, a + rng.choice([0, 1, 3, 40, 500, 50_000 if e % 3 == 0 else 9])))
    assert run(spark, rows) == brute(rows)


def test_edges_nulls_repeats_and_whole_range(spark):
    rows = [(None, 1, 2), (1, None, 5), (1, 5, None), (1, 9, 3), (2, 0, 0), (2, 0, 0), (2, 1, 1), (3, 0, 2**31 - 1), (3, 5, 7), (4, 16383, 16384), (4, 16386, 32767), (4, 32768, 32768), (5, -1, -1), (5, 1, 1)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (4, 16386, 32768) in got and (3, 0, 2**31 - 1) in got


def test_empty(spark):
    assert run(spark, []) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-70_000, 70_000), st.integers(0, 40_000)), max_size=12))
def test_property(spark, rows):
    rows = [(e, a, a + n) for e, a, n in rows]
    assert run(spark, rows) == brute(rows)


def test_gaps_are_the_uncovered_positions(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 8, 9), (1, 100_000, 100_001), (2, 5, 5)], "entity bigint, lo bigint, hi bigint")
    assert sorted(map(tuple, interval_gaps(merge_intervals(df)).collect())) == [(1, 5, 7), (1, 10, 99_999)]


def test_presence_of_fragments(spark):
    rows = [
        (1, 10.0, [5, 3, 4], None),
        (1, 10.0, None, [0.6, 0.9]),
        (1, 10.0, [], None),
        (1, 10.0, None, None),
        (1, None, None, [1.0]),
        (1, 10.0, [20, None], None),
        (-1, 10.0, [1], None),
        (None, 10.0, [1], None),
        (1, 10.0, [5, 3, 4], None),
    ]
    df = spark.createDataFrame(rows, "player_id bigint, fps double, frames array<int>, t array<double>")
    got = {tuple(r) for r in presence(df).collect()}
    assert got == {(1, "period", 3, 9), (1, "gap", 10, 19), (1, "period", 20, 20)}


@pytest.mark.parametrize("n", [3000])
def test_hot_entity(spark, n):
    df = spark.range(n).selectExpr("cast(7 as bigint) entity", "id * 3 % 5000 lo", "id * 3 % 5000 + 1 hi")
    assert run(spark, [tuple(r) for r in df.collect()]) == brute([tuple(r) for r in df.collect()])


def test_long_intervals_give_few_blocks(spark):
    from kinelake.operators.intervals import dyadic_blocks

    far = 1 << 40
    df = spark.createDataFrame([(1, 5, far), (1, far + 1, far + 9), (1, 3, 40), (2, -far, far), (2, far + 2, far + 2)], "entity bigint, lo bigint, hi bigint")
    assert sorted(map(tuple, merge_intervals(df).collect())) == [(1, 3, far + 9), (2, -far, far), (2, far + 2, far + 2)]
    assert df.selectExpr("lo", "hi").select(dyadic_blocks("lo", "hi").alias("b")).selectExpr("max(size(b)) AS n").first().n <= 84
