"""Operators look at every row and every component, not at a part of them."""

from kinelake.operators import game, sequence
from kinelake.operators.pairs import framed
from tests.test_sequence import row, view


def test_duplicates_are_judged_in_their_own_frame(spark):
    # tracks 1 and 2 coincide in frame 2 only, which is not the first of its five frames; 3 and 4 never share a frame
    t = view(spark, [row(1, 0, 5, 5, 0.9), row(2, 0, 9, 9, 0.5), row(1, 2, 7, 7, 0.9), row(2, 2, 7.2, 7, 0.5), row(3, 0, 20, 20, 0.9), row(4, 1, 20, 20, 0.5)])
    assert [(r.tid, r.g) for r in sequence.inframe_dedup_greedy(t, clock=framed).collect()] == [(2, 2)]
    assert sorted((r.tid, r.g) for r in sequence.nms(t, clock=framed).collect()) == [(1, 0), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert len(sequence.consolidate(t).collect()) == 4


def test_consolidate_drops_the_duplicate_rows_only(spark):
    # without its duplicate of frame 20 track 2 begins at 21, so it may follow track 1; its other rows of the stretch are not lost
    t = view(spark, [row(1, f, f / 10, 5, 0.9) for f in range(21)] + [row(2, 20, 2.1, 5, 0.5)] + [row(2, f, f / 10, 5) for f in range(21, 25)])
    assert {r.tid: r.player_id for r in sequence.consolidate(t).collect()} == {1: 1, 2: 1}


def test_concurrency_counts_rows_of_one_frame(spark):
    t = view(spark, [row(k, k, 10 * k, 5) for k in range(5)])
    assert [r.p99 for r in sequence.dedup_concurrency(t).collect()] == [1.0]


def test_static_spots_count_every_row(spark):
    t = view(spark, [row(1, f, 10, 5) for f in range(40)])
    assert [r.n for r in sequence.static_fp(t).collect()] == [40]


def test_coreset_sees_every_component(spark):
    # the vectors differ in their last components only
    rows = [(i, [0.0] * 10 + [x], 1) for i, x in enumerate([0.0, 1.0, 0.5, 9.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert [r.vec_id for r in sequence.coreset_kcenter(e, 3).orderBy("rank").collect()] == [0, 3, 1]


GT = "det_id bigint, tracklet_id int, t double, px double, py double, y1 float"
TRACKLETS = "tid int, source_clip string, team int"


def test_recall_matches_the_second_observer(spark):
    t = view(spark, [row(1, 10, 5, 5), row(3, 10, 20, 20), row(5, 50, 30, 10)])
    tl = spark.createDataFrame([(1, "a", 0), (3, "a", 0), (5, "a", None), (7, "b", 1)], TRACKLETS)
    # 1 is near track 1, 2 nearer to the same row, 3 near an odd track too, 4 too late for track 5, 5 in another clip
    gt = spark.createDataFrame([(1, 1, 0.4, 6.0, 5.0, 300.0), (2, 3, 0.45, 5.2, 5.0, 300.0), (3, 3, 0.4, 20.0, 21.0, 400.0), (3, 3, 0.4, 20.0, 21.0, 400.0), (4, 5, 2.5, 30.0, 10.0, 700.0), (5, 7, 0.4, 5.0, 5.0, 700.0), (6, None, 0.4, 5.0, 5.0, 700.0)], GT)
    assert sorted((r.det_id, r.tid, r.frame, r.d) for r in sequence.greedy_match(t, gt, tl).collect()) == [(2, 1, 10, 0.2), (3, 3, 10, 1.0)]
    assert {r.zone: (r.n, r.recall) for r in sequence.recall_by_zone(t, gt, tl).collect()} == {"far": (2, 0.5), "mid": (1, 1.0), "near": (2, 0.0)}


def test_readiness_takes_the_teams_of_the_tracklets(spark):
    # all tids are even; team 0 stands left, team 1 right, the unknown one on either side counts for neither
    t = view(spark, [row(2, 0, 1, 5), row(4, 0, 2, 5), row(6, 0, 8, 5), row(8, 0, 9, 5), row(10, 0, 9, 5)])
    tl = spark.createDataFrame([(2, "a", 0), (4, "a", 0), (6, "a", 1), (8, "a", 1), (10, "a", None)], TRACKLETS)
    assert game.kickoff_readiness(t).count() == 0
    (got,) = game.kickoff_readiness(t, tl).collect()
    assert got.ready > 0.9
