"""Markdown files in bulk, seeding and search of repeated requests, notification joins."""

import os

from emberwatch.operators import knowledge as KN
from emberwatch.operators import retrieve as R
from emberwatch.sources import events as E
from pyspark.sql import functions as F


def test_markdown_files_are_written_by_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc-{i}", f"line {i}\n\nlast") for i in range(200)] + [("twice", "b"), ("twice", "a"), ("blank", None)],
                                 "stem string, text string")
    path = f"file://{tmp_path}/md"
    assert E.write_markdown(docs, path) == 202
    got = {r.stem: r.text for r in E.load_markdown(spark, path + "/*").collect()}
    assert got == {**{f"doc-{i}": f"line {i}\n\nlast\n" for i in range(200)}, "twice": "a\nb\n", "blank": "\n"}
    assert len(os.listdir(tmp_path / "md")) <= 64  # folders do not grow with the documents
    assert all(f.endswith(".md") for _, _, files in os.walk(tmp_path / "md") for f in files)


def test_single_points_shuffles_repeated_ids_only(spark):
    once = spark.createDataFrame([("a", str(i), f"text {i}") for i in range(30)], "collection string, chunk_id string, text string")
    assert "Window" not in KN._single_points(once)._jdf.queryExecution().analyzed().toString()
    more = once.unionByName(spark.createDataFrame([("a", "3", "another"), ("b", "3", "text 3"), ("a", "4", "text 4")], once.schema))
    rows = sorted(tuple(r) for r in KN._single_points(more).collect())
    assert len(rows) == 31 and ("a", "3", "another") in rows and ("a", "3", "text 3") not in rows and ("b", "3", "text 3") in rows


def test_requests_that_look_alike_are_searched_once(spark):
    schema = "query_id long, collection string, query_vec array<float>, q_type string, affected_services array<string>, query_epoch long"
    rows = [(i, c, [1.0, float(i % 2)], f"t{i % 4}", [f"s{i % 3}"], 1000 + i) for i in range(24)
            for c in ("incidents", "runbooks", "architecture", "deployments", "postmortems")]
    asked = spark.createDataFrame(rows + [(None, "incidents", [1.0, 0.0], None, None, None), (24, "incidents", [1.0, 0.0], "t", ["s"], 1),
                                          (24, "incidents", [1.0, 1.0], "t", ["s"], 1)], schema)
    requests, members = R.alike(asked)
    n = {r.collection: r.n for r in requests.groupBy("collection").agg(F.countDistinct(F.coalesce("query_id", F.lit(-1))).alias("n")).collect()}
    assert n == {"incidents": 3, "postmortems": 2, "runbooks": 12, "architecture": 6, "deployments": 24}
    assert members.count() == 24 * 5 + 2 and requests.where("query_id = 24").count() == 2
    as_ = {(r.query_id, r.collection): r.same_as for r in members.collect()}
    assert as_[23, "incidents"] == 1 and as_[22, "postmortems"] == 0 and as_[None, "incidents"] == 0 and as_[14, "runbooks"] == 2


def test_routes_are_broadcast_not_shuffled_by_kind(spark):
    from emberwatch.operators import notify as N

    rows = [(f"i{n}", "HIGH" if n % 2 else "LOW", 1.0 if n < 40 else None, None, None, "AUTOMATIC_RECOVERY" if n >= 40 else None, None) for n in range(60)]
    rows += [(None, "HIGH", 1.0, None, None, None, None), ("none", None, None, None, None, None, None)]
    events = spark.createDataFrame(rows, "incident_id string, severity string, anomaly_score double, root_cause_candidates array<string>, "
                                         "action_steps array<string>, resolution_method string, postmortem string")
    routed = N.route(events.repartition(4), N.routes_table(spark))
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    got = {(r.incident_id, r.notification_type) for r in routed.collect()}
    assert got == {(f"i{n}", "INCIDENT_OPENED") for n in range(40) if n % 2} | {(f"i{n}", "INCIDENT_RESOLVED") for n in range(40, 60)}


def test_steps_of_an_incident_are_written_after_the_join(spark):
    from emberwatch.operators import score as S
    from emberwatch.sources import adapters as A

    rca = spark.createDataFrame([(i, ["auth-service", "none", None][i % 3], f"cause {i}", 0.5) for i in range(20)] + [
        (3, "payment-service", "cause", 0.5), (4, "none", "cause 4", 0.5), (None, "none", "cause", 0.5)],
        "incident_id long, service string, top_root_cause string, top_confidence double").repartition(3)
    per = spark.createDataFrame([(i, f"row {i}") for i in [*range(0, 30, 2), 3, 4, None]], "incident_id long, about string")
    asked = S.default_steps(rca, A.registry(spark), per=per)
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Check health endpoint") < plan.index("Join")  # printed from the top: nothing below the join has texts
    assert "Check health endpoint" not in plan[plan.index("Join"):] and "Generate" not in plan
    rows = S.default_steps(rca, A.registry(spark)).groupBy("incident_id").agg(
        F.sort_array(F.collect_list(F.struct(*S.STEP_FIELDS))).alias("steps"), F.sort_array(F.collect_set("runbook_source")).alias("runbook_refs"),
        F.collect_set("escalation_path").alias("paths"), F.first("estimated_resolution_time").alias("estimated_resolution_time"))
    want = {r.incident_id: r for r in rows.collect()}
    got = asked.collect()
    assert sorted(r.incident_id for r in got) == sorted([*range(0, 20, 2), 3, 4])
    for r in got:
        w = want[r.incident_id]
        assert (r.steps, r.runbook_refs, r.estimated_resolution_time) == (w.steps, w.runbook_refs, w.estimated_resolution_time)
        assert r.escalation_path in w.paths and r.about == f"row {r.incident_id}" and len(r.steps) == (4 if r.incident_id in (3, 4) else 2)
