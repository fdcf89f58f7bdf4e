import numpy as np

from kinelake.operators.spikes import SpikeParams, flag_implausible

SCHEMA = "tid int, frame int, pitch_x float, pitch_y float, camera_id string, source_clip string, block int, cam string"


def walk(tid, n, seed, scale=1.0, start=0, stride=2):
    rng = np.random.default_rng(seed)
    x = 20 + np.cumsum(rng.normal(0, 0.05, n)) + rng.normal(0, 0.1, n)
    y = 10 + np.cumsum(rng.normal(0, 0.05, n)) + rng.normal(0, 0.1, n)
    return [[tid, start + i * stride, float(x[i] * scale), float(y[i] * scale), "c1" if scale == 1 else "c2", "c1_clip1", 9, "k"] for i in range(n)]


def flags(spark, rows, params=SpikeParams()):
    got = flag_implausible(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), params).collect()
    return {(r.tid, r.frame): (r.spike, r.frozen, r.impossible) for r in got}


def scene():
    rows = {t: walk(t, 200, t) for t in range(1, 7)} | {9: walk(9, 200, 99, scale=8.0)}
    rows[1][50][2] += 5  # one row
    for i in (80, 81, 82):
        rows[2][i][3] -= 6  # three rows
    for i in range(100, 112):
        rows[3][i][2] = rows[3][100][2]  # one coordinate frozen
    for i in range(60, 74):
        rows[4][i][2], rows[4][i][3] = rows[4][60 + i % 2][2], rows[4][60 + i % 2][3]  # flips between two readings
    rows[5][150][2], rows[5][150][3] = 0.0, 0.0
    rows[9][30][2] += 5  # within this camera's noise scale times a few: not a case
    return rows


EXPECTED = {(1, 100)} | {(2, 2 * i) for i in (80, 81, 82)} | {(3, 2 * i) for i in range(101, 112)} | {(4, 2 * i) for i in range(62, 74)} | {(5, 300)}


def test_planted_cases(spark):
    rows = [r for v in scene().values() for r in v]
    assert set(flags(spark, rows)) == EXPECTED


def test_result_does_not_depend_on_blocks_order_or_repeats(spark):
    rows = [r for v in scene().values() for r in v]
    shuffled = [rows[i] for i in np.random.default_rng(0).permutation(len(rows))] + rows[::3]
    assert set(flags(spark, shuffled, SpikeParams(block_frames=128, overlap_frames=100))) == EXPECTED


def test_absence_and_stillness_are_no_cases(spark):
    rows = walk(1, 100, 1)
    late = walk(1, 100, 2, start=400)
    for r in late:
        r[2] += 15  # turns up elsewhere
    still = [[2, i, 5.0 + 0.05 * ((i * 7) % 5), 5.0 + 0.04 * ((i * 3) % 7), "c1", "c1_clip1", 0, ""] for i in range(100)]
    assert not [k for k in flags(spark, rows + late + still) if k[0] == 1]


def test_nulls_nan_empty(spark):
    base = walk(1, 60, 3)
    base[5][2] = None
    base[6][3] = float("nan")
    base += [[None, 1, 1.0, 1.0, "c1", "c1_clip1", 0, ""], [1, None, 1.0, 1.0, None, None, 0, ""], [8, 4, None, None, None, None, 0, ""], [8, 5, 3.0, 3.0, None, None, 0, ""]]
    assert flags(spark, base) == {}
    assert flags(spark, []) == {}


def test_details_vanish_on_even_motion_over_uneven_frames():
    from kinelake.operators.spikes import details

    frame = np.array([0, 2, 3, 7, 8, 12, 13, 15, 20, 22])
    x, y = 0.4 * frame, 5 - 0.1 * frame
    x[4] += 3  # one row off
    group = np.zeros(10, int)
    for reach in (1, 2, 4):
        d, span = details(group, frame, x, y, reach)
        inside = span > 0
        assert d[4] == max(d[inside]) and abs(d[4] - 3) < 1e-9
        assert all(abs(d[i]) < 1e-9 for i in np.flatnonzero(inside) if i not in (4 - reach, 4, 4 + reach))
