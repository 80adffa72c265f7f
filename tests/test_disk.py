"""What a query shuffles: rows of its tables with the columns that it needs, and no pairs."""

import re

from tests.test_operators import EVENT, events
from tidelog.operators import correlate, rules, timeline
from tidelog.plans import queries as core

QUERIES = core.queries()


def plan(df):
    """The physical plan from its top, before it runs."""
    return re.split(r"\n", df._jdf.queryExecution().executedPlan().toString())


def above_joins(df):
    """The exchanges above the uppermost join."""
    lines = plan(df)
    top = next((k for k, line in enumerate(lines) if "Join" in line), len(lines))
    return sum("Exchange" in line for line in lines[:top])


def test_rows_alike_in_what_is_left_out_too_are_one(spark):
    rows = [("a", 0, 5, "c", "t", "u", None, "f", None, "S", None, 1, None, "d", raw) for raw in ("x", None, "null", '"', "x")]
    e = spark.createDataFrame([(f"a{k}", *r[1:]) for k, r in enumerate(rows)], EVENT)
    got = timeline.deduplicate(e, ["ts_us", "username"])
    assert got.columns == ["event_id", "ts_us", "username"]
    assert sorted(map(tuple, got.collect())) == [(f"a{k}", 5, "u") for k in range(4)]
    assert sorted(r.event_id for r in timeline.deduplicate(e).collect()) == sorted(r.event_id for r in got.collect())


def test_ids_of_links_shuffle_no_pairs(spark, sf):
    assert above_joins(QUERIES["link_ids"](spark, sf)) == 0
    e = events(spark, ("a", 0, 0, "x", "u"), ("b", 0, 1, "x", "v"))
    twice = correlate.temporal(e).unionByName(correlate.temporal(e))
    assert correlate.with_ids(twice).count() == 1  # where an edge may be there twice it is one row


def test_links_in_time_shuffle_each_event_three_times(spark, sf):
    """Once as the later event and twice as the earlier; repeated rows are gone before, in a table of its own."""
    links = QUERIES["links_temporal"](spark, sf)
    assert sum("Exchange" in line for line in plan(links)) <= 2 and not any("Aggregate" in line for line in plan(links))


def test_network_pack_numbers_packets_once_and_groups_no_pairs(spark, sf):
    lines = plan(QUERIES["rules_network_full_pack"](spark, sf))
    assert not any("Window" in line for line in lines) and sum("Aggregate" in line for line in lines) == 4  # counts, and the distinct keys
    assert above_joins(QUERIES["rules_network_full_pack"](spark, sf)) == 1  # of the counts


def test_detections_of_events_with_different_ids_need_no_look(spark):
    e = events(spark, ("a", 0, 0, "ssh_login_failure", "u"), ("b", 0, 1, "ssh_login_success", "u"), ("c", 0, 2, "ssh_login_success", "u"))
    edges = correlate.temporal(e)
    pack = [rules.failure_then_success(), rules.failure_then_success(), rules.Rule("any", event_types=("ssh_login_success",)), rules.Rule("near", relations=("TEMPORAL",)), rules.Rule("failed", event_types=("ssh_login_failure",), relations=("TEMPORAL",))]
    got, want = ({tuple(r.event_ids) + (r.rule_name, r.detection_id) for r in rules.evaluate(e, pack, edges, unique=u).collect()} for u in (True, False))
    assert got == want and rules.evaluate(e, pack, edges, unique=True).count() == len(got) == 9


def test_sequences_shuffle_no_combinations(spark, sf):
    """The events of each step only, whatever the join: combinations stay in the bucket of their first event."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = plan(QUERIES["rule_three_steps"](spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange" in line for line in lines) == 3 and not any("Aggregate" in line for line in lines)


def test_authentication_and_privilege_group_no_pairs(spark, sf):
    assert not any("Aggregate" in line for line in plan(QUERIES["links_all_privilege"](spark, sf)))


def test_ids_of_detections_are_made_behind_the_sort(spark, sf):
    lines = plan(QUERIES["detection_ids"](spark, sf))
    sort = next(k for k, line in enumerate(lines) if "Sort" in line)
    assert not any("Aggregate" in line for line in lines) and any("sha1" in line for line in lines[:sort]) and not any("sha1" in line for line in lines[sort:])


def test_endpoints_group_no_pairs(spark, sf):
    assert above_joins(QUERIES["links_endpoint_sets"](spark, sf)) == 0


def test_packets_are_numbered_once(spark, sf):
    for name in ("links_host_network", "rules_answers_and_protocols"):
        assert not any("Window" in line for line in plan(QUERIES[name](spark, sf)))
    assert above_joins(QUERIES["links_host_network"](spark, sf)) == 0
    assert sum("Aggregate" in line for line in plan(QUERIES["rules_answers_and_protocols"](spark, sf))) == 2  # the counts


def test_one_timeline_of_all_sources_shuffles_what_is_asked_for(spark, sf):
    lines = plan(QUERIES["timeline_all_sources"](spark, sf))
    assert not any("Window" in line for line in lines) and not any("Aggregate" in line and "description" in line for line in lines)


def test_united_events_that_differ_in_what_is_left_out_are_two(spark):
    make = lambda *rows: spark.createDataFrame([(i, 0, 5, "c", "t", d, m) for i, d, m in rows], "event_id string, ts_class int, ts_us long, category string, event_type string, description string, attributes map<string,string>")
    tables = make(("b", "d", {"x": "1", "y": "2"}), ("c", "d", {"x": "1"}), ("e", None, {"x": "1"})), make(("a", "d", {"y": "2", "x": "1"}), ("d", "d", None))
    got = sorted(map(tuple, timeline.unite(*tables, keep=["category"]).collect()))
    assert got == [(i, "c") for i in "acde"] and sorted(r.event_id for r in timeline.unite(*tables).collect()) == list("acde")
