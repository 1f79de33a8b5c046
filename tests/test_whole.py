"""Queries over whole tables against brute force on small fixtures with ids beyond any subset."""

import datetime
import random

import pytest

from dqspark.plans.catalogue import ORACLES, QUERIES


def test_islands_and_overlaps_of_all_ids(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.date(2020, 1, 1)
    rows = [(k, rng.randrange(60)) for k in (1, 50, 51, 900) for _ in range(15)]
    spark.createDataFrame([(k, start + datetime.timedelta(n)) for k, n in rows], "l_suppkey long, l_shipdate date").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = set()
    zero = (start - datetime.date(1970, 1, 1)).days
    for key in {k for k, _ in rows}:
        own, islands = sorted({zero + n for k, n in rows if k == key}), []
        for day in own:
            if islands and day - islands[-1][-1] <= 3:
                islands[-1].append(day)
            else:
                islands.append([day])
        want |= {(key, i, x[0], x[-1], len(x)) for i, x in enumerate(islands)}
    out = QUERIES["b02_islands"](spark, str(tmp_path)).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want

    parts = [(k, rng.randrange(1, 51)) for k in range(330, 480)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    meet = lambda a, b: abs(a[1] - b[1]) <= 3 and abs(a[0] % 40 - b[0] % 40) <= 1
    want = sorted((a[0], b[0]) for a in parts for b in parts if a[0] < b[0] and meet(a, b))
    assert sorted(tuple(r) for r in QUERIES["b04_overlaps"](spark, str(tmp_path)).collect()) == want


def test_orphans_by_the_links_of_all_pages(spark, tmp_path):
    link = lambda name: f'<a href="/x/{name}">x</a>'
    html = {0: link("c1"), 9: link("c0"), 10: link("c2"), 1234: link("c3") + link("c4")}
    ids = [0, 1, 2, 3, 4, 5, 9, 10, 1234]
    spark.createDataFrame([(k, f"https://h.example/a/c{k}?q=1", html.get(k, "")) for k in ids], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted(r["name"] for r in QUERIES["f02_orphans"](spark, str(tmp_path)).collect())
    assert out == ["c10", "c1234", "c5", "c9"]  # c2, c3 and c4 have links from page10 and page1234 only


def test_slugs_of_whole_texts(spark, tmp_path):
    head = "The same first words, many of them, for more than sixty characters: "
    rows = [(1, head + "Straße No. 1"), (2, head + "two!"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["slug"] for r in QUERIES["c15_c16_slug_id"](spark, str(tmp_path)).collect()}
    start = "the-same-first-words-many-of-them-for-more-than-sixty-characters-"
    assert out == {1: start + "straße-no-1", 2: start + "two", 3: None}


def test_elements_as_the_sql_has_them(spark, tmp_path):
    rows = [
        (1, None), (2, ""), (3, "<h1>a &quot;b&quot; &amp;amp; &amp</h1>"), (4, "<p>no</p>"), (5, "x\n<h1>\n a <b>c</b> d\n</h1>\n<ul><li>1<li>2<LI>3<li class='x'>4</ul>"), (6, "<h1>open"),
        (7, "<a href='x'>y</a><A HREF='z'>w</A><a>n</a><a\nhref=q>é</a>"), (8, '<div class="ad">1<div class="ad x">2</div></div>'), (9, "<h1 id=x>no</h1><h1>yes\u000b!</h1>"), (10, "\r\n<h1>é\U0001f600\r\nx</h1>"),
    ]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    out = {r["page_id"]: tuple(r)[1:] for r in QUERIES["i02_elements"](spark, str(tmp_path)).collect()}
    assert out[1] == (None,) * 4 and out[3] == (0, 0, 'a &quot;b&quot; &amp; &amp', 0) and out[5] == (2, 0, "a <b>c</b> d", 0)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert out == {r[0]: r[1:] for r in con.sql(ORACLES["i02_elements"]).fetchall()}
