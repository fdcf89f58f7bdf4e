"""Thresholds rest on all documents, and portions of two sentences count where they are a fifth."""

import numpy as np
from pyspark.sql import functions as F

from kinelake.llm.subjects import SubjectModel, SubjectParams, _bucket, fit_subjects

EXAMPLES = [("sport", "The keeper saved the penalty."), ("sport", "A corner led to the header."), ("law", "The court dismissed the claim."), ("law", "A contract clause was void.")]


def test_thresholds_come_from_all_documents(spark):
    ids = [r[0] for r in spark.range(40).select("id").orderBy(F.xxhash64("id"), "id").collect()]
    # the sampled document bears no subject; in the others weak sport sentences stand among clear ones
    text = "The keeper saved the penalty. A keeper was there yesterday. A corner led to the header. The penalty came later today. The keeper saved the penalty."
    docs = spark.createDataFrame([(i, text if i != ids[0] else "Nothing more tomorrow.") for i in ids], "doc_id bigint, text string")
    ex, areas = spark.createDataFrame(EXAMPLES, "subject string, text string"), spark.createDataFrame([("sport",), ("law",)], "subject string")
    p = SubjectParams(hash_bits=12, sample_docs=1, rounds=1)
    sampled, whole = (fit_subjects(ex, d, areas, p) for d in (docs.where(docs.doc_id == ids[0]), docs))
    assert (sampled.w == whole.w).all()
    print(sampled.thresholds, whole.thresholds)
    sport = whole.subjects.index("sport")
    assert whole.thresholds[sport] < sampled.thresholds[sport]


def test_two_sentences_that_are_a_fifth_count(spark):
    p = SubjectParams(hash_bits=12)
    w = np.zeros((1 << 12, 2), np.float32)
    for c, word in enumerate(("court", "keeper")):
        w[_bucket(word, 12), c] = 20
    m = SubjectModel(["law", "sport"], w, np.full(2, -3, np.float32), np.full(2, 0.5), p)
    text = lambda law, sport, fill: " ".join(["The court sat."] * law + ["The keeper ran."] * sport + ["Nothing more."] * fill)
    got = [set(d) for d in m.shares([text(2, 6, 1), text(2, 8, 0), text(1, 7, 1), text(2, 12, 0), text(2, 6, 5)])]
    assert got == [{"law", "sport"}, {"law", "sport"}, {"sport"}, {"sport"}, {"law", "sport"}]


def test_fenced_text_is_kept_and_sections_end_at_headings():
    from kinelake.llm.subjects import pieces

    got = pieces("One here. Two here.\n## 3\nThree.\nFour.\n\nFive.\n```\ncode = 1\n")
    assert [(s, f) for s, _, f in got] == [("One here.", False), ("Two here.", False), ("## 3", False), ("Three.", False), ("Four.", False), ("Five.", False), ("code = 1", True)]
    n = [k for _, k, _ in got]
    assert n[0] == n[1] < n[3] == n[4] < n[5] < n[6]
