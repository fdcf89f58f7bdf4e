import numpy as np

from kinelake.operators.regular_grid import regular_grid

SCHEMA = "tid int, frame int, fps double, t_sec float, source_clip string, pitch_x float, pitch_y float, slot string, status string"


def grid(spark, rows):
    return {(r.tid, r.slot): r for r in regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_slots_status_and_exact_cells(spark):
    rows = [(1, f, 10.0, f / 10, "a_clip1", f * 1.0, 2.0, "", "") for f in list(range(0, 20)) + list(range(40, 60))]
    rows += [(1, 10, 10.0, 1.0, "a_clip1", 10.0, 2.0, "", "")]  # repeated row
    rows += [(2, 5, 10.0, 900.0, "a_clip1", 1.0, 1.0, "", ""), (2, 25, 10.0, None, "a_clip1", 1.0, 1.0, "", "")]  # absurd and missing clock
    g = grid(spark, rows)
    assert sorted(k for k in g if k[0] == 1) == [(1, s) for s in range(12)]
    assert [g[1, s].status for s in range(12)] == ["observed"] * 4 + ["filled"] * 4 + ["observed"] * 4
    assert g[1, 2].x == 12.0 and g[1, 2].n == 5
    assert [(s, g[2, s].status, g[2, s].x) for s in range(1, 6)] == [(1, "observed", 1.0), (2, "unsupported", None), (3, "unsupported", None), (4, "unsupported", None), (5, "observed", 1.0)]
    assert not [k for k in g if k[0] == 2 and k[1] > 5]


def test_windows_and_empty(spark):
    rows = [(1, f, 2.0, None, "a_clip1", 1.0, 1.0, "", "") for f in (0, 700)] + [(None, 1, 2.0, 1.0, "a", 1.0, 1.0, "", ""), (3, 1, None, None, None, None, None, "", ""), (4, 1, 2.0, float("nan"), None, None, float("nan"), "", "")]
    g = grid(spark, rows)
    assert {k for k in g if k[0] == 1} == {(1, s) for s in range(701)}
    assert {k for k in g if k[0] != 1} == {(4, 1)} and g[4, 1].x is None
    assert grid(spark, []) == {}


def test_held_out_cells_of_a_low_rank_scene(spark):
    rng = np.random.default_rng(5)
    time = np.arange(0, 600)
    base = np.stack([np.sin(time / 60), np.cos(time / 90)])
    rows, hidden = [], {}
    for tid in range(20):
        a, b = rng.normal(0, 5, 2), rng.normal(0, 5, 2)
        x, y = 25 + a @ base, 15 + b @ base
        hole = set(rng.choice(np.arange(3, 57), 8, replace=False).tolist())
        for f in time:
            if int(f // 10) in hole:
                hidden.setdefault((tid, int(f // 10)), []).append((x[f], y[f]))
            else:
                rows.append((tid, int(f), 20.0, float(f) / 20, "a_clip1", float(x[f]), float(y[f]), "", ""))
    g = grid(spark, rows)
    err = [np.hypot(g[k].x - np.mean([p[0] for p in v]), g[k].y - np.mean([p[1] for p in v])) for k, v in hidden.items()]
    assert all(g[k].status == "filled" for k in hidden) and np.median(err) < 0.15 and max(err) < 2


def test_an_observed_coordinate_stays_when_the_other_is_filled(spark):
    # slot 4 has x but no y
    rows = [(1, 25 * s // 2, 25.0, 0.5 * s, "a", 10.0 + s, None if s == 4 else 20.0 - s, None, None) for s in range(10)]
    g = {r.slot: r for r in regular_grid(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (g[4].status, g[4].x) == ("observed_filled", 14.0) and abs(g[4].y - 16) < 0.2
    assert {g[s].status for s in range(10) if s != 4} == {"observed"}


def test_fill_beats_a_line_on_curved_paths():
    import numpy as np

    from kinelake.operators.regular_grid import GridParams, _fill

    rng = np.random.default_rng(4)
    t = np.arange(200)
    m = np.stack([20 * np.sin(t / (6 + k) + k) + rng.normal(0, 0.1, 200) for k in range(12)])
    known = rng.random(m.shape) > 0.3
    known[:, [0, -1]] = True
    line = np.stack([np.interp(t, t[k], v[k]) for v, k in zip(m, known)])
    err = lambda z: np.median(np.abs(z - m)[~known])
    assert err(_fill(m, known, GridParams())) < err(line)
