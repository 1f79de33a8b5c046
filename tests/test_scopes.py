"""Rule files, scopes and small parts that the catalogue's queries leave out."""

import pytest
from pyspark.sql import functions as F

from dqspark.operators import tables
from dqspark.plans.rules import Rule, RuleError, rules_from, run_rules
from dqspark.plans.scopes import Sheet, column_index, parse_scope, qualified, resolve, split_sheet
from dqspark.plans.yaml_text import YamlError, parse_yaml
from dqspark.session import put_file


def test_yaml_of_rule_files():
    text = """
# comment
a: 1
b: [x, "y, z", 2.5, {k: v}]   # tail
c:
  - one
  - d: 'it''s'
    e: "q\\"n"
  -
    - deep
  - - 1
    - 2
f: {}
g: ~
h: yes it is: not
"""
    assert parse_yaml(text.replace("h: yes it is: not\n", "h: a#b\n")) == {
        "a": 1, "b": ["x", "y, z", 2.5, {"k": "v"}], "c": ["one", {"d": "it's", "e": 'q"n'}, ["deep"], [1, 2]], "f": {}, "g": None, "h": "a#b",
    }
    assert parse_yaml("") is None and parse_yaml("- 1\n- true\n") == [1, True]
    for bad in ("a: &x 1", "a: *x", "a: !!int 1", "a: 1\na: 2", "a: 1\n---\nb: 2", "<<: {a: 1}", "\ta: 1", "a:\n   b: 1\n  c: 2", "a: |\n  x", "a: [1, 2", 'a: "x'):
        with pytest.raises(YamlError):
            parse_yaml(bad)
    with pytest.raises(YamlError):
        parse_yaml("[" * 100 + "]" * 100)
    with pytest.raises(RuleError):
        rules_from("version: 1\nrules:\n- {id: a, column: x, check: required, colour: red}\n")


def test_scopes(spark):
    df = spark.createDataFrame([(2, 1.0, "x"), (3, 5.0, "y")], "r int, a double, `b c` string")
    sheets = {"First": Sheet(df, "r"), "Bob's": Sheet(df, "r", header_row=2)}
    at = lambda text, **k: resolve(parse_scope(text), sheets, k.get("names", {}), k.get("tables", {}))
    assert at("col:b c") == ("First", ["b c"], None) and at("cols:a,B") == ("First", ["a", "b c"], None)
    assert at("'Bob''s'!A1:B9") == ("Bob's", ["a", "b c"], (3, 9)) and at("$B$3:$A$2") == ("First", ["a", "b c"], (2, 3))
    assert at("cell:B7") == ("First", ["b c"], (7, 7)) and at("row:3") == ("First", ["a", "b c"], (3, 3)) and at("sheet:Bob's") == ("Bob's", ["a", "b c"], None)
    assert at("named:N", names={"N": "'Bob''s'!B1:B4"}) == ("Bob's", ["b c"], (3, 4)) and at("table:T", tables={"T": "A1:B3"}) == ("First", ["a", "b c"], (3, 3))
    assert column_index("AB") == 27 and split_sheet(qualified("Bob's", "col:a")) == ("Bob's", "col:a")
    for bad in ("col:zz top", "named:none", "nowhere!col:a", "row:x", "'a!col:a", "x:y", "'a/b'!col:a"):
        with pytest.raises(RuleError):
            at(bad)
    with pytest.raises(RuleError):
        run_rules(df, [Rule("r", "a", "value > 1", rows=(1, 2))], "t")
    found = run_rules(df, [Rule("r", "a", "value > 9", rows=(3, 4)), Rule("m", "a", "avg(a) > 9", rows=(2, 2))], "t", F.col("r")).collect()
    assert sorted((f["rule_id"], f["row"], f["value"]) for f in found) == [("m", None, "1.0"), ("r", 3, "5.0")]


def test_header_depth_begins_at_the_top(spark):
    spans = [("s", r, 1, r, 2) for r in range(1, 67)] + [("s", 70, 1, 70, 2), ("s", 71, 2, 71, 3), ("s", 73, 1, 73, 2)]
    assert tables.header_depth(spark.createDataFrame(spans, "sheet string, top int, left int, bottom int, right int"), 70) == 3


def test_files_are_put_whole(spark, tmp_path):
    for content in ("first", b"second \xff"):
        put_file(spark, f"file://{tmp_path}/d/x.bin", content)
    assert (tmp_path / "d/x.bin").read_bytes() == b"second \xff"
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")] == ["x.bin"]
