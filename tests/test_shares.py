"""Shares of a task that do not grow with the table."""

from wharfline import shared
from wharfline.operators import ingestion
from wharfline.plans import ingestion as plans


def test_shares_have_a_bounded_number_of_rows(spark):
    df = spark.range(1_000).selectExpr("id div 4 as k")
    assert shared.dealt(df, "k", task_rows=100).rdd.getNumPartitions() == 10
    assert shared.dealt(df.limit(0), "k").count() == 0


def test_printed_lines_are_dealt_once(spark, sf, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 1_000)
    values = plans.values(spark, sf)
    assert values.count() > 0
    plan = values._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_lines_are_numbered_in_their_row(spark):
    df = spark.createDataFrame([(1, "a\n \nPRJ | Page 2 of 7\n\nb"), (2, ""), (3, None), (1 << 40, "c")], "document_id long, body string")
    lines = ingestion.body_lines(df)
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in lines.collect()) == [(1, 1, "a"), (1, 2, "b"), (1 << 40, 1, "c")]


def test_specifications_are_dealt_once(spark, sf):
    from wharfline.plans import documents

    plan = documents.page_structure(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_lines_without_an_entity_are_not_gathered(spark, monkeypatch):
    from wharfline.operators import linedetail

    monkeypatch.setattr(shared, "TASK_ROWS", 250)
    lines = spark.range(1_000).selectExpr("cast(id as string) as line_id")
    entities = spark.createDataFrame([("1", 7), ("2", 8), ("3", None), ("1", 8), ("x", 7)], "line_id string, entity_id long")
    members = spark.createDataFrame([(7,), (7,), (None,), (9,)], "entity_id long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = linedetail.identity_state(lines, entities, members).rdd.glom().collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert max(len(p) for p in got) < 400
    rows = sorted((r["line_id"], r["state"]) for p in got for r in p)
    assert len(rows) == 1_001 and [r for r in rows if r[1] != "no_entity"] == [("1", "entity_without_documents"), ("1", "linked"), ("2", "entity_without_documents")]


def test_lines_are_dealt_before_they_are_folded(spark, sf, monkeypatch):
    from wharfline.plans import frames

    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    plan = frames.lines(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(l_orderkey") == 1
