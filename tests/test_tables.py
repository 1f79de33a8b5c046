"""Spans and pairs of large sheets: the results of brute force, by plans that do not compare everything with everything."""

import random
import re

from dqspark.operators import merge, pairs, tables

SPAN = "sheet string, top int, left int, bottom int, right int"


def test_spans_of_all_sizes_against_brute_force(spark):
    rng = random.Random(4)
    spans = [("s", 40, 3, 40, 3), ("s", 41, 1, 1_000_000, 2), ("t", 5, 2, 5, 16_000), ("s", 1, 30, 8, 31)]
    for _ in range(25):
        top, left = rng.randrange(1, 38), rng.randrange(1, 28)
        spans.append((rng.choice("st"), top, left, top + rng.randrange(9), left + rng.randrange(7)))
    cells = [(sheet, r, c, f"{sheet}{r}.{c}") for sheet in "stu" for r in range(1, 46) for c in range(1, 34) if rng.random() < 0.6] + [("s", 999_999, 2, "far"), ("t", 5, 9_000, "wide"), ("s", None, 1, "lost")]
    inside = lambda c: c[1] is not None and any(s[0] == c[0] and s[1] <= c[1] <= s[3] and s[2] <= c[2] <= s[4] for s in spans)
    rest = [c for c in cells if not inside(c)]
    value = {c[:3]: c[3] for c in cells}
    anchors = [(*s[:3], value[s[:3]]) for s in spans if s[:3] in value]
    own, merged = spark.createDataFrame(cells, "sheet string, row int, col int, value string"), spark.createDataFrame(spans, SPAN)
    for policy, want in (("blank", rest), ("anchor", rest + anchors)):
        assert sorted(map(repr, map(tuple, tables.fill_spans(own, merged, policy).collect()))) == sorted(map(repr, want))
    small = [s for s in spans if s[3] < 100 and s[4] < 100]
    want = [(s[0], r, c, value[s[:3]]) for s in small if s[:3] in value for r in range(s[1], s[3] + 1) for c in range(s[2], s[4] + 1)]
    inside = lambda c: c[1] is not None and any(s[0] == c[0] and s[1] <= c[1] <= s[3] and s[2] <= c[2] <= s[4] for s in small)
    got = tables.fill_spans(own, spark.createDataFrame(small, SPAN), "fill").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want + [c for c in cells if not inside(c)]))


def test_blank_spans_meet_cells_by_place(spark):
    """Not every cell of a sheet with every span of it."""
    cells, spans = spark.createDataFrame([("s", 1, 1, "a")], "sheet string, row int, col int, value string"), spark.createDataFrame([("s", 1, 1, 2, 2)], SPAN)
    for policy in ("anchor", "fill", "blank"):
        plan = tables.fill_spans(cells, spans, policy)._jdf.queryExecution().optimizedPlan().toString()
        anti = re.findall(r"Join LeftAnti, .*", plan)
        assert anti and all(re.search(r"row#\d+ = row#\d+", line) for line in anti)


def test_overlaps_of_many_equal_rectangles_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 7)
    rng = random.Random(5)
    rows = [(rng.choice("st"), k, t := rng.randrange(12), left := rng.randrange(9), t + rng.randrange(3), left + rng.randrange(2)) for k in range(60)]
    rows += [("s", k, 3, 4, 5, 5) for k in range(60, 110)] + [("s", 60, 3, 4, 5, 5), ("s", None, 3, 4, 5, 5), ("s", 200, None, 4, 5, 5), (None, 201, 3, 4, 5, 5)]
    good = [r for r in rows if None not in r]
    meet = lambda a, b: a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]
    want = sorted((a[0], a[1], b[1]) for a in good for b in good if a[1] < b[1] and meet(a, b))
    spans = spark.createDataFrame(rows, "sheet string, id long, top int, left int, bottom int, right int")
    for cell in (None, 4):
        out = tables.overlapping(spans, cell)
        assert sorted(map(tuple, out.collect())) == want
        joins = re.findall(r"Join .*", out._jdf.queryExecution().optimizedPlan().toString())
        assert joins and not any(re.search(r"id#\d+L? < id#\d+", line) for line in joins)  # rectangles meet, not rows


def test_contradictions_of_many_equal_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 5)
    rng = random.Random(6)
    rows = [(f"k{k:03}", f"{rng.choice(['A b', 'a  B', 'c d'])} costs {rng.randrange(4)}") for k in range(120)] + [("x", "two words"), ("y", None), (None, "a b costs 1"), ("z", " A B Costs 1"), ("k003", "a b costs 9")]
    head = lambda t: " ".join(t.lower().split()[:2])
    good = [r for r in rows if None not in r and len(r[1].split()) >= 3]
    want = sorted((a[0], b[0], head(a[1])) for a in good for b in good if a[0] < b[0] and head(a[1]) == head(b[1]) and a[1].lower() != b[1].lower())
    out = merge.contradictions(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    assert sorted(map(tuple, out.collect())) == want
    joins = re.findall(r"Join .*", out._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any(re.search(r"k#\d+L? < k#\d+", line) for line in joins)  # texts meet, not rows
