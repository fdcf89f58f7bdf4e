from kinelake.operators import pairs, sequence, tracks

SCHEMA = "tid int, frame int, clip string, cam string, fps double, t double, fx double, fy double, box_h double, box_w double, conf double, cropped boolean, x double, y double, in_pitch boolean, zone string, zone_code int"


def row(tid, frame, x, y, conf=0.8, clip="a"):
    return (tid, frame, clip, "c", 25.0, frame / 25, x * 10.0, y * 10.0, 80.0, 30.0, conf, False, float(x), float(y), True, "mid", 1)


def view(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stitch_joins_fragments_and_never_overlaps(spark):
    t = view(spark, [row(1, f, f / 10, 5) for f in range(0, 50, 5)] + [row(2, f, f / 10, 5) for f in range(60, 100, 5)] + [row(3, f, 30, 20) for f in range(0, 100, 5)])
    got = {r.tid: r.player_id for r in sequence.stitch(t).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert {r.tid: r.player_id for r in sequence.gta_connect(t).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.tid: r.cluster for r in sequence.cluster_merge(t).collect()}[2] == 1


def test_duplicates_keep_the_better_row(spark):
    t = view(spark, [row(1, 0, 5, 5, 0.9), row(2, 1, 5.5, 5, 0.5), row(3, 2, 20, 20)])
    assert [(r.tid, r.g) for r in sequence.inframe_dedup_greedy(t).collect()] == [(2, 0)]
    assert [(r.tid, r.g) for r in pairs.inframe_dedup(t).collect()] == [(2, 0)]
    assert sorted(r.tid for r in sequence.nms(t).collect()) == [1, 3]


def test_presplit_guard_and_postprocess(spark):
    t = view(spark, [row(1, 5 * f, f * 0.1 if f < 10 else 30 + f * 0.1, 5) for f in range(20)] + [row(2, 5 * f, 0.1 * f if f != 3 else 40, 5) for f in range(20)])
    parts = {(r.tid, r.frame): r.part for r in sequence.presplit(t).collect()}
    assert parts[1, 45] == 0 and parts[1, 50] == 1
    assert {v for k, v in parts.items() if k[0] == 2} == {0}
    kept = {(r.tid, r.frame) for r in sequence.postprocess(t).collect()}
    assert (2, 15) not in kept and (2, 20) in kept


def test_gsi_and_bridge_fill_the_same_frames(spark):
    from kinelake.operators.kinematics import bridge_gaps

    t = view(spark, [row(1, f, f / 10, (f / 20) ** 2) for f in [*range(0, 20), *range(26, 40)]])
    a, b = ({(r.tid, r.frame) for r in d.collect()} for d in (sequence.gsi_fill(t), bridge_gaps(t)))
    assert a == b == {(1, f) for f in range(20, 26)}


def test_tracklet_builder_and_possession(spark):
    t = view(spark, [row(10, 5 * f, f * 0.1, 5) for f in range(10)] + [row(11, 5 * f, 20, 5 + f * 0.1) for f in range(10)])
    lab = {}
    for r in sequence.tracklet_builder(t).collect():
        lab.setdefault(r.tid, set()).add(r.tracklet)
    assert all(len(v) == 1 for v in lab.values()) and lab[10] != lab[11]
    assert len({r.owner for r in sequence.possession_viterbi(t).collect()}) == 1


def test_empty_views(spark):
    t = view(spark, [])
    for f in (sequence.stitch, sequence.nms, sequence.savgol, sequence.gsi_fill, sequence.possession_viterbi, tracks.heatmap, tracks.territory_thirds, pairs.encounter_events, pairs.link_candidates):
        assert f(t).count() == 0
