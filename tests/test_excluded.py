"""Lines without figures and whole logs."""

from wharfline.plans import catalog


def test_excluded_lines_are_those_of_all_states_without_figures(spark, sf):
    """A run that does not cover a vendor leaves its lines without figures, beside those of another roster."""
    states = {r["state"]: r["n"] for r in catalog.queries()["worklist_states"](spark, sf).where("not is_ranked").collect()}
    assert states["not_covered"] > 0
    assert catalog.queries()["worklist_excluded"](spark, sf).count() == sum(states.values())


def test_the_first_excluded_lines_are_of_all_excluded(spark, sf):
    every = catalog.queries()["worklist_excluded"](spark, sf).orderBy("effective_need_by", "line_id").limit(100)
    assert [r["line_id"] for r in catalog.queries()["excluded_in_order"](spark, sf).orderBy("rank").collect()] == [r["line_id"] for r in every.collect()]


def test_a_long_log_is_one_row(spark, tmp_path):
    own = spark.range(2_500).selectExpr("id as event_id", "0L as user_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "concat('t', cast(id as string)) as event_type", "1.0D as value")
    own.write.parquet(f"{tmp_path}/events.parquet")
    rows = catalog.queries()["nested_events"](spark, str(tmp_path)).collect()
    assert [r["n"] for r in rows] == [2_500] and rows[0]["states"] == [f"t{i}" for i in range(2_500)]
