from kinelake.llm.mixing import mix_sources


def test_the_source_that_limits_the_total_is_named(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 4, "big" if i < 600 else "small") for i in range(640)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 2), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    assert {r.source: r.binding for r in mix_sources(docs, targets)[1].collect()} == {"big": False, "small": True, "absent": False}
