import random

import pytest
from pyspark.sql import functions as F

from tasksieve.operators import detector, features, review_queue
from tasksieve.sources import tables
from tests.conftest import SMALL

# Per program: chars, lines, tokens, token ratio, verbs, copybooks, sections, paragraphs; counted by eye.
COUNTED = [
    ("MOVE A TO B.\n\n  STOP RUN.\n", (26, 2, 6, 1.0, 2, 0, 0, 0)),
    ("", (0, 0, 0, 0.0, 0, 0, 0, 0)),
    ("\n\n", (2, 0, 0, 0.0, 0, 0, 0, 0)),
    ("ß", (1, 1, 1, 1.0, 0, 0, 0, 0)),
    ("A.", (2, 1, 1, 1.0, 0, 0, 0, 1)),
    ("1-2.\n3.\r\n", (9, 2, 0, 0.0, 0, 0, 0, 1)),
    ("COPY COPY.SECTION.SECTION.", (26, 1, 4, 0.5, 0, 2, 2, 0)),
    ("éCOPY COPYé XSECTION.", (21, 1, 3, 2 / 3, 0, 0, 0, 0)),
    ("WORK SECTION.\nPARA-1.\n    copy BOOK. Copy BOOK.\n  PARA-2.\nEND-PARA.", (67, 5, 9, 7 / 9, 0, 2, 1, 2)),
    ("IF X DISPLAY X\x1cADD 1 TO X\x85IF-X", (30, 3, 8, 0.75, 3, 0, 0, 0)),
]


def test_features_by_hand(spark, task, tasks_of):
    rows = features.extract_features(tasks_of(*[task(
        f"t{i}", program=program, specification="a b c\x1fd  ", license_id="Unknown", source_url="httpx",
        mutants=[{"mutant_id": "m", "source": "s"}] * 2,
    ) for i, (program, _) in enumerate(COUNTED)]))
    for row in rows.collect():
        got = tuple(row[name] for name in features.FEATURES[:8])
        assert got == COUNTED[int(row.task_id[1:])][1], row.task_id
        assert (row.spec_words, row.reference_case_count, row.mutant_count) == (4, 1, 2)
        assert (row.has_source_url, row.has_known_license) == (1, 0)


def test_license_words_differ_between_audit_and_features(spark, task, tasks_of):
    row = features.extract_features(tasks_of(task(license_id="n/a"))).first()
    assert row.has_known_license == 1


def test_vector_is_in_sorted_name_order(spark, task, tasks_of):
    rows = features.extract_features(tasks_of(task()))
    vector = features.feature_assembler().transform(rows).first()
    assert list(vector.features.toArray()) == [vector[n] for n in sorted(features.FEATURES)]


def test_tokens_are_extracted_once(spark):
    plan = features.extract_features(tables.tasks(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", [A-Z][A-Z0-9-]*, 0)") == 1


@pytest.fixture(scope="module")
def labeled(spark):
    """Long programs are rejected, short ones accepted."""
    rng = random.Random(5)
    rows = tables.tasks(spark, SMALL).limit(0)
    data = []
    for i in range(80):
        bad = i % 2
        data.append((f"t{i:03}", f"g{i % 10}", "t", "words " * 5, "MOVE A TO B. " * (rng.randint(40, 60) if bad else rng.randint(1, 10)),
                     "R", i, "unknown", [("c", "", "x")], [], "https://x", ["accepted", "revised"][bad] if i < 60 else "unreviewed", ""))
    return spark.createDataFrame(data, rows.schema)


def test_detector_separates_and_survives_saving(spark, labeled, tmp_path):
    fitted = detector.ReviewDetector(num_trees=30).fit(labeled)
    risk = {r.task_id: r.review_risk for r in fitted.predict_review_risk(labeled).collect()}
    assert all(0 <= p <= 1 for p in risk.values())
    assert min(p for t, p in risk.items() if int(t[1:]) % 2) > max(p for t, p in risk.items() if not int(t[1:]) % 2)
    loaded = detector.ReviewDetector.load(fitted.save(str(tmp_path / "d" / "model")))
    assert {r.task_id: r.review_risk for r in loaded.predict_review_risk(labeled).collect()} == risk


def test_same_seed_same_model_for_any_partitioning(spark, labeled):
    a, b = (
        {r.task_id: r.review_risk for r in detector.ReviewDetector(num_trees=10).fit(rows).predict_review_risk(labeled).collect()}
        for rows in (labeled, labeled.orderBy(F.desc("task_id")).repartition(7))
    )
    assert a == b


def test_detector_guards(spark, labeled):
    with pytest.raises(RuntimeError):
        detector.ReviewDetector().predict_review_risk(labeled)
    with pytest.raises(RuntimeError):
        detector.ReviewDetector().save("/nowhere")
    with pytest.raises(ValueError, match="too few"):
        detector.ReviewDetector().fit(labeled.where("seq < 7"))
    with pytest.raises(ValueError, match="same outcome"):
        detector.ReviewDetector().fit(labeled.where("review_status = 'accepted'"))


def test_queue_takes_one_task_per_group_by_uncertainty(spark, task, tasks_of):
    rows = tasks_of(
        task("far", group_id="g1", review_status="unreviewed"), task("near", group_id="g1", review_status="unreviewed"),
        task("tie-a", group_id="g2", review_status="unreviewed"), task("tie-b", group_id="g2", review_status="unreviewed"),
        task("done", group_id="g3"), task("last", group_id="g4", review_status="unreviewed"),
    )
    scores = spark.createDataFrame(
        [("far", 0.9), ("near", 0.45), ("tie-a", 0.25), ("tie-b", 0.75), ("done", 0.5), ("last", 0.0)],
        "task_id string, review_risk double",
    )
    queue = review_queue.build_review_queue(rows, scores).collect()
    assert [(q.task_id, q.probability_review_needed) for q in queue] == [("near", 0.45), ("tie-a", 0.25), ("last", 0.0)]
    assert queue[0].provenance == "https://example.com/listing" and queue[0].program == "DISPLAY TOTAL OF near"
    assert [q.task_id for q in review_queue.build_review_queue(rows, scores, 1).collect()] == ["near"]
    with pytest.raises(ValueError):
        review_queue.build_review_queue(rows, scores, 0)


def test_fit_and_prediction_share_measured_tasks(spark, tasks_of, task):
    from tasksieve.operators import detector

    rows = tasks_of(*[task(f"t{i}", program="ADD A.\n" * (i % 7), review_status="accepted" if i % 3 else "rejected") for i in range(30)])
    measured = detector.measured(rows)
    assert measured.columns == ["task_id", "review_status", "x"]
    risks = [sorted(map(tuple, detector.ReviewDetector(num_trees=5).fit(r).predict_review_risk(r).collect())) for r in (rows, measured)]
    assert risks[0] == risks[1] and len(risks[0]) == 30
