import json

import pytest
from pyspark.sql import functions as F

from dqspark.operators import findings
from dqspark.plans.rules import Rule, RuleError, parse_check, rules_from, run_rules
from dqspark.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, 5.0, "open", "2024-01-02", True, "a"), (2, None, " ", None, None, "a"), (3, float("nan"), "#N/A", "2024-02-30", False, None),
        (4, -1.0, "closed", "2024-03-05", True, "b"), (5, 10.0000000001, "open", "x", True, "b"),
    ]
    return spark.createDataFrame(rows, "id long, n double, s string, d string, b boolean, k string")


def failing(table, column, check, **more):
    return sorted(r["row"] for r in run_rules(table, [Rule("r", column, check, **more)], "t", F.col("id")).collect())


@pytest.mark.parametrize(
    ("column", "check", "rows"),
    [
        ("n", "value > 0", [3, 4]),
        ("n", "value == 10", [1, 3, 4]),
        ("n", "value != 10", [3, 5]),
        ("n", "between:0,10", [3, 4, 5]),
        ("n", "value * 2 + 1 > 0", [3, 4]),
        ("n", "value / 0 > 1", [1, 3, 4, 5]),
        ("n", "required", [2]),
        ("s", "in [open, 'closed']", [3]),
        ("s", "not in [open]", [1, 3, 5]),
        ("s", "is_error", [1, 4, 5]),
        ("s", "not_empty", [2, 3]),
        ("s", "len >= 5", [1, 3, 5]),
        ("s", "regex:[a-z]+", [3]),
        ("s", "starts_with:op", [3, 4]),
        ("s", "is_number", [1, 3, 4, 5]),
        ("d", "date_after:2024-01-31", [1, 3, 5]),
        ("d", "date_weekday:1", [3, 5]),
        ("d", "date_in_month:2024-01", [3, 4, 5]),
        ("b", "value == true", [3]),
        ("b", "is_bool", []),
        ("s", {"or": ["value == open", {"not": "len > 3"}]}, [3, 4]),
    ],
)
def test_row_checks(table, column, check, rows):
    assert failing(table, column, check) == rows


def test_when_and_messages(table):
    assert failing(table, "n", "value > 5", when={"column": "s", "check": "value == open"}) == [1]
    rule = Rule("r", "n", "value > 0", message="row $row: $value in $column of $table, $other")
    messages = {r["row"]: r["message"] for r in run_rules(table, [rule], "t", F.col("id")).collect()}
    assert messages[4] == "row 4: -1.0 in n of t, $other"


def test_aggregates_and_groups(table):
    out = run_rules(table, [Rule("c", "s", "count(s) == 4"), Rule("e", "s", "count_errors(s) == 1"), Rule("d", "s", "count_distinct(s) == 1"), Rule("g", "n", "sum_by:k > 5")], "t").collect()
    assert sorted(((r["rule_id"], r["group"]) for r in out), key=repr) == [("c", None), ("d", None), ("g", "a"), ("g", None)]


def test_bad_rules(table):
    for check in ("nonsense", {"and": [], "or": []}, "regex:(a+)+", "regex:[", "median(x) == ", "value.__class__ == 1", "between:1"):
        with pytest.raises(RuleError):
            parse_check(check)
    with pytest.raises(RuleError):
        run_rules(table, [Rule("r", "absent", "value > 1")], "t")
    with pytest.raises(RuleError):
        rules_from([{"id": "a", "column": "n", "check": "value > 1"}] * 2)
    with pytest.raises(RuleError):
        rules_from('{"version": 1, "version": 1, "rules": []}')
    text = json.dumps({"version": 1, "defaults": {"severity": "info"}, "rules": [{"id": "a", "column": "n", "check": "value > 1"}]})
    assert rules_from(text)[0].severity == "info"


def test_collapse_cap_and_counters(spark, table):
    found = run_rules(table, [Rule("a", "n", "value > 100"), Rule("b", "s", "value == none", severity="warning")], "t", F.col("id"))
    short = {(r["rule_id"], r["collapsed"]) for r in findings.collapse(found, 2).collect() if r["collapsed"]}
    assert short == {("a", 2), ("b", 2)}
    capped = findings.ordered(findings.cap(found, 3)).collect()
    assert len(capped) == 3 and any(r["rule_id"] == "truncated" and r["message"].startswith("6 ") for r in capped)
    assert findings.cap(found, 0).count() == found.count() == 8
    counters = findings.summary(found).first()
    assert (counters["errors"], counters["warnings"], counters["exit_code"]) == (4, 4, 1)
    marked = findings.remarks(table.withColumn("remarks", F.lit("old")), "id", found, "append")
    assert marked.where("id = 4").first()["remarks"].startswith("old; ")


def test_unknown_rule_keys_are_refused():
    with pytest.raises(RuleError):
        rules_from([{"id": "a", "column": "n", "check": "value > 1", "scope": "A1:A9"}])
    with pytest.raises(RuleError):
        rules_from(json.dumps({"version": 1, "defaults": {"sheet": "x"}, "rules": []}))


def test_every_error_cell_is_listed(spark):
    cells = spark.createDataFrame([("s", k, 1, "#N/A") for k in (*range(1, 15), 1001, 2000)] + [("s", 3000, 2, "fine")], "sheet string, row int, col int, value string")
    assert sorted(tuple(r) for r in sinks.error_cells(cells).collect()) == [("#N/A", "s", k, 1) for k in (*range(1, 15), 1001, 2000)]
