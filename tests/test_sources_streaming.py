import json
import time

import pytest
from pyspark.sql import functions as F

from kinelake.sources import readers
from kinelake.sources.views import clean_tracks
from kinelake.streaming import operators as so


def test_track_reader_checks_and_defaults(spark, tmp_path):
    spark.createDataFrame([(1, 2, 0.1, 3.0, 4.0, 1.0)], "tid int, frame int, t_sec double, foot_x double, foot_y double, extra double").write.parquet(str(tmp_path / "t"))
    df = readers.read_tracks(spark, str(tmp_path / "t"))
    r = df.first()
    assert r.in_pitch is False and r.conf is None and r.bottom_cropped is False and r.extra == 1.0
    with pytest.raises(ValueError):
        readers.with_track_defaults(df.drop("frame"))


def test_catalog_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("id\tplace_name\twatch_count\turl\n7\tKuzey\t12.0\tu\nx\t\t\t\n")
    a = readers.read_catalog_tsv(spark, str(tmp_path / "c.tsv")).collect()
    assert (a[0].id, a[0].venue, a[0].views, a[0].first_url) == (7, "Kuzey", 12, "u") and a[1].id is None
    (tmp_path / "c.json").write_text(json.dumps({"rows": [{"id": 1, "place": {"name": "Doruk"}, "watch_count": 3}]}))
    assert readers.read_catalog_json(spark, str(tmp_path / "c.json")).first().venue == "Doruk"


def test_ledger_round_trip(spark, tmp_path):
    p = str(tmp_path / "l")
    for c, v in ((1, "a"), (2, "b")):
        readers.append_ledger(spark.createDataFrame([("best", v, c)], "key string, value string, cycle int"), p)
    assert readers.ledger_state(spark, p, "key string, value string, cycle int").first().value == "b"


def test_view_cleans(spark):
    cols = "tid int, frame int, source_clip string, camera_id string, fps double, t_sec float, foot_x float, foot_y float, box_h float, box_w float, conf float, bottom_cropped boolean, pitch_x float, pitch_y float, in_pitch boolean, zone string, zone_code tinyint, ingested_at timestamp, k int"
    one = (1, 5, "v_clip3", None, 10.0, 900.0, 1.0, 2.0, 3.0, 1.0, float("nan"), None, None, 1.0, None, "far", 2, None, 4)
    t = clean_tracks(spark.createDataFrame([one, one, (None, *one[1:])], cols)).collect()
    assert len(t) == 1 and t[0].cam == "v" and t[0].t == 0.5 and t[0].conf is None and t[0].in_pitch is False


def stream(spark, df, path, operator, schema):
    df.write.parquet(path)
    q = operator(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(schema).outputMode("append").start()
    try:  # state with timeouts keeps batches coming, so the stream never counts as drained
        for _ in range(60):
            time.sleep(0.5)
            if (got := spark.table(schema).collect()) or q.exception():
                break
    finally:
        q.stop()
    return got


def test_stateful_streams_match_the_batch_rule(spark, tmp_path):
    d = spark.createDataFrame([("a", f, 2 if f > 3 else 5) for f in range(8)], "clip string, frame int, n int").coalesce(1)
    got = {r.frame: (r.med, r.deficit) for r in stream(spark, d, str(tmp_path / "d"), so.deficit_stream, "deficit")}
    assert got[3] == (5.0, False) and got[7] == (3.5, False) and len(got) == 8
    h = spark.createDataFrame([("v", 1, 0), ("v", 2, 1), ("v", 3, 2**20 - 1)], "venue string, id int, h bigint").coalesce(1)
    assert sorted(r.id for r in stream(spark, h, str(tmp_path / "h"), so.keep_changed_stream, "kept")) == [1, 3]
    k = spark.createDataFrame([("c", g, 0.9 if g < 20 else 0.1, -2.0 if g < 24 else 2.0) for g in range(60)], "clip string, g int, ready double, side double").coalesce(1)
    assert [r.frame for r in stream(spark, k, str(tmp_path / "k"), so.kickoff_stream, "kick")] == [120]


def test_windows_stream(spark, tmp_path):
    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 120).alias("ts"), (F.col("id") % 7).alias("user_id"), F.col("id").cast("double").alias("value")).coalesce(1)
    got = stream(spark, e, str(tmp_path / "e"), so.tumbling_counts, "tumble")
    assert {r.n for r in got if r.start_s < 5 * 3600} == {30}
