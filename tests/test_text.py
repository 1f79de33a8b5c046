import pytest
from pyspark.sql import functions as F

from dqspark.functions import captions, html, scan, text
from dqspark.functions import values as V
from dqspark.operators import folds, graph, merge, tables


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first()["o"]


VTT = "WEBVTT\n\nNOTE x\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>one two</c> three\n\n2\n00:00:02.000 --> 00:00:03.000\none two three four\n\n00:00:03.000 --> 00:00:04.000\ntwo three four five &amp; six\n\n00:00:05.000 --> 00:00:06.000\n>> new turn\n"


def test_captions(spark):
    cues = one(spark, VTT, captions.vtt_cues)
    assert cues == ["one two three", "one two three four", "two three four five & six", ">> new turn"]
    merged = one(spark, cues, captions.merge_rolling, "array<string>")
    assert merged == ["one two three four five & six", ">> new turn"]
    assert one(spark, merged, captions.paragraphs, "array<string>") == "one two three four five & six\n\n>> new turn"
    assert one(spark, "a\n\n>> b\n\n>> c", captions.turns) == 2
    assert one(spark, "<tt><p begin='1'>x<br/>y</p><p>z</p></tt>", captions.ttml_cues) == ["x y", "z"]


def test_values(spark):
    kinds = spark.createDataFrame([(v,) for v in ("1", "01", "1,5", "2024-01-02", "2024-13-02", "TRUE", "", "x", "2024-01-02T10:00:00Z")], "v string")
    assert [r[0] for r in kinds.select(V.cell_kind(F.col("v"))).collect()] == ["integer", "text", "number", "date", "text", "bool", "empty", "text", "datetime"]
    assert one(spark, "=1+1", V.escape_formula) == "'=1+1"
    assert one(spark, "=1+1", lambda c: V.escape_formula(c, "strip")) == "1+1"
    assert one(spark, 45292.0, V.serial_date, "double").isoformat() == "2024-01-01"
    assert one(spark, "1-3:a,5,x", V.page_ranges) == [(1, 3, "a"), (5, 5, None)]
    assert one(spark, "Ünï côde — x!", V.slug) == "ünï-côde-x"
    assert one(spark, "**b** [t](u) `c`", V.strip_inline_markdown) == "b t c"


def test_text(spark):
    assert one(spark, "See e.g. this. And that.", text.first_sentence) == "See e.g. this."
    assert one(spark, "a [[P#x|l]] ![[E]] [[Q]]", text.wiki_links) == [("P", "x"), ("Q", None)]
    assert one(spark, "## A\none\n## B\ntwo\n", lambda c: text.section(c, "A")) == "one\n"
    assert one(spark, "## A\none\n## B\ntwo\n", lambda c: text.replace_section(c, "A", "new")) == "## A\nnew\n## B\ntwo\n"
    assert one(spark, "---\ntitle: 'T'\ntags: [a, 'b, c']\nlist:\n  - x\n---\nbody", text.front_matter) == {"title": ["T"], "tags": ["a", "b, c"], "list": ["x"]}
    assert one(spark, "https://youtu.be/abcdefghijk?t=1", text.media_id) == "abcdefghijk"
    assert one(spark, "https://a.b.co.uk/x", text.registrable) == "b.co.uk"
    assert one(spark, "https://t.co/redirect?url=https%3A%2F%2Fx.org%2F", text.unwrapped) == "https://x.org/"
    doc = '{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"H"}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"x","marks":[{"type":"bold"}]}]}]}]}]}'
    assert one(spark, doc, text.rich_text) == "## H\n\n- **x**"
    assert spark.createDataFrame([("abcdef", "xbcdy")], "a string, b string").select(text.longest_common("a", "b")).first()[0] == 3


def test_fences(spark):
    md = "a `x` b\n```\n[[in]]\n```\nc"
    masked = one(spark, md, folds.mask_fences)
    assert len(masked) == len(md) and "[[in]]" not in masked and masked.endswith("c")
    assert one(spark, md, folds.longest_fence) == 1


def test_scan_patterns_mean_what_they_mean_in_sql(spark):
    texts = {
        1: "el ñdoas con", 2: "x\n\u00fdsudo a", 3: "nada\nrm\u000b-rf /", 4: "é1.2.3.4é", 5: "acc\u00e94111 1111 1111 1111", 6: "a RAN\u017fOMWARE bac\u212adoor",
        7: "\U0001f600" * 9 + " eval\n(x)\n\n", 8: "without user\u2028s consent", 9: "without user\ns consent", 10: "bearer abcdefghij\u017fjihgfedcba", 11: "sudo é", 12: "", 13: None, 14: " \u017fteal tokens", 15: "a\u017fteal to\u212aens",
    }
    docs = spark.createDataFrame(list(texts.items()), "id long, t string")
    got = [(r["id"], r["name"], r["line"]) for r in scan.issues(docs, "id", "t").collect()]
    want = [(1, "raised privileges", 1), (2, "raised privileges", 2), (4, "ipv4", 1), (5, "card number", 1), (6, "backdoor", 1), (6, "ransom", 1), (7, "evaluated text", 1), (8, "hidden action", 1), (10, "bearer token", 1), (15, "credential theft", 1)]
    assert sorted(got) == want
    duckdb = pytest.importorskip("duckdb")
    own = {r["id"]: r["n_ipv4"] for r in docs.select("id", *scan.counts(F.col("t"), scan.PERSONAL)).collect()}
    for p in scan.ALL:
        hits = {k for k, t in texts.items() if t and duckdb.execute("SELECT regexp_matches(?, ?)", [t, p.regex]).fetchone()[0]}
        assert {r["id"] for r in docs.where(scan.matches(F.col("t"), p)).collect()} == hits == {k for k, name, _ in want if name == p.name}
    assert own[4] == 1 and sum(own.values()) == 1


def test_html(spark):
    page = "<html><head><title>T x</title><script>s</script></head><body><nav>menu</nav><article><h1>Head</h1><p>some <b>bold</b> text " + "w " * 60 + "</p><table><tr><th colspan=2>h</th></tr><tr><td>1</td><td>2</td></tr></table></article></body></html>"
    out = one(spark, page, html.reader_markdown)
    assert out.startswith("# Head\n\nsome **bold** text") and "| h | h |" in out and "menu" not in out
    assert one(spark, page, html.html_tables) == [[["h", "h"], ["1", "2"]]]
    assert one(spark, page, html.visible_text).startswith("T x")
    assert one(spark, "# \n\n\n\na  \n```\n\n\n\nx\n```\n", html.tidy_markdown) == "a\n```\n\n\n\nx\n```"


def test_scan(spark):
    import base64

    hidden = base64.b64encode(b"please rm -rf / now, thanks a lot").decode()
    docs = spark.createDataFrame([(1, f"x\n{hidden}"), (2, "mail me: a.b@c.org"), (3, "ok")], "id long, t string")
    assert [(r["id"], r["name"]) for r in scan.rescan(docs, "id", "t").collect()] == [(1, "recursive delete")]
    assert [(r["id"], r["name"], r["line"]) for r in scan.issues(docs, "id", "t").collect()] == [(2, "email", 1)]
    files = spark.createDataFrame([("a.md", bytearray(b"PK\x03\x04x")), ("b.md", bytearray(b"text")), ("c.zip", bytearray(b"PK\x03\x04"))], "path string, content binary")
    assert [r["path"] for r in scan.polyglots(files).collect()] == ["a.md"]
    assert [r["path"] for r in scan.without_ignored(files, ["*.zip", "a.*"]).collect()] == ["b.md"]


def test_tables(spark):
    cells = spark.createDataFrame([("s", 1, 1, "a"), ("s", 1, 2, "b"), ("s", 2, 1, "1"), ("s", 2, 2, "2"), ("s", 2, 5, "z"), ("s", 6, 1, "q")], "sheet string, row int, col int, value string")
    assert sorted(map(tuple, tables.regions(cells).collect())) == [("s", 1, 1, 2, 2), ("s", 2, 5, 2, 5), ("s", 6, 1, 6, 1)]
    spans = spark.createDataFrame([("s", 1, 1, 1, 2, 1)], "sheet string, top int, left int, bottom int, right int, id int")
    own = spark.createDataFrame([("s", 1, 1, "G"), ("s", 2, 1, "x"), ("s", 2, 2, "y")], "sheet string, row int, col int, value string")
    assert tables.header_depth(spans, 1) == 2
    assert sorted(map(tuple, tables.flat_headers(own, spans, 1, 2).collect())) == [("s", 1, "G / x"), ("s", 2, "G / y")]
    block = "| a | b\\|c |\n|:--|--:|\n| 1 |\n| 2 | 3 | 4 |"
    out = one(spark, block, tables.pipe_table)
    assert out["header"] == ["a", "b|c"] and out["align"] == ["left", "right"] and out["rows"] == [["1", None], ["2", "3"]]
    assert one(spark, "no table", tables.pipe_table) is None
    names = spark.createDataFrame([(1, "A/b"), (2, "a_B"), (3, "x" * 40), (4, "X" * 40), (5, "")], "k int, n string")
    got = [r["sheet_name"] for r in tables.sheet_names(names, "n", "k").orderBy("k").collect()]
    assert len({g.lower() for g in got}) == 5 and max(map(len, got)) <= 31


def test_merge_and_graph(spark):
    assert merge.suffixed_names(["a", "a", "a__2", "a"]) == ["a", "a__2", "a__2__2", "a__3"]
    now = spark.createDataFrame([(1, "x")], "k int, v string")
    new = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert sorted(map(tuple, merge.upsert(merge.upsert(now, new, ["k"]), new, ["k"]).collect())) == [(1, "y"), (2, "z")]
    assert sorted(map(tuple, merge.upsert(now, new, ["k"], update=False).collect())) == [(1, "x"), (2, "z")]
    notes = spark.createDataFrame([("n", "course/a/x"), ("m", "other/x")], "name string, target string")
    assert [r["name"] for r in graph.bad_prefixes(notes, spark.createDataFrame([("course/a",)], "prefix string")).collect()] == ["m"]
    assert one(spark, "The the then", lambda c: graph.term_counts(c, ["then", "the"])) == [1, 2]


def test_improvement_loop(spark):
    loop = lambda c: folds.improvement_loop(c, F.lit(10.0), 1.0, 2, 20.0)
    assert one(spark, [12.0, 12.5, 30.0, 5.0], loop, "array<double>")["exit_reason"] == "threshold"
    assert tuple(one(spark, [10.5, 9.0, 30.0], loop, "array<double>")) == (10.0, 0, 2, 2, 2, "stagnation")
    assert one(spark, [], loop, "array<double>")["exit_reason"] == "max_iterations"


def test_documents(spark):
    from dqspark.operators import documents

    pages = spark.createDataFrame([(1, True, 3), (1, False, 0), (2, True, 900), (3, False, 1)], "d int, scanned boolean, char_count int")
    assert sorted(map(tuple, documents.scanned_documents(pages, "d").collect())) == [(1, True), (2, False), (3, False)]
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "d int, k int, t string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "c"), (1, 3, "d")], "d int, k int, t string")
    out = documents.paragraph_diff(old, new, "d", "k", "t").orderBy("pos").collect()
    assert [tuple(r)[2:] for r in out] == [("equal", "a", "a"), ("replace", "b", "x"), ("equal", "c", "c"), ("insert", None, "d")]
