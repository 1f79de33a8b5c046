import json
import zipfile

from pyspark.sql import functions as F

from dqspark.operators import infer
from dqspark.sources import archives, files, sinks
from dqspark.sources.workbooks import WorkbookSource
from dqspark.streaming.events import first_match, timed, window_counts


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;x;x\n1;1,5;007\n2;;8\n')
    df, twice = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "x", "x__2"] and twice == ["x"]
    typed = infer.typed(df)
    assert dict(typed.dtypes) == {"id": "bigint", "x": "double", "x__2": "string"}
    assert [r["x"] for r in typed.orderBy("id").collect()] == [1.5, None]


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3, "b": "x"}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string")
    assert [(r["line"], r["a"]) for r in good.orderBy("line").collect()] == [(1, 1), (4, 3)]
    assert [r["line"] for r in bad.collect()] == [3]
    for doc, shape in (([{"a": 1}], "records"), ({"s": [{"a": 1}]}, "sheets"), ({"a": 1}, "object"), ([1], "other")):
        (tmp_path / "b.json").write_text(json.dumps(doc))
        assert files.json_shape(spark, str(tmp_path / "b.json")) == shape


def test_vault_runs_and_captions(spark, tmp_path):
    for path, text in {"v/one/concepts/Alpha.md": "x [[Beta]]", "v/one/_sources/src.md": "y"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted((r["layer"], r["name"], r["kind"]) for r in files.read_vault(spark, str(tmp_path / "v")).collect()) == [("one", "Alpha", "concept"), ("one", "src", "source")]
    for n, doc in {1: {"summary": {"pass_rate": 0.5, "passed": 1, "failed": 1, "total": 2}}, 2: {"broken": 1}}.items():
        d = tmp_path / f"r/eval-1/base/run-{n}"
        d.mkdir(parents=True)
        (d / "grading.json").write_text(json.dumps(doc))
        (d / "timing.json").write_text('{"total_duration_seconds": 7.5}')
    rows = files.read_runs(spark, str(tmp_path / "r")).collect()
    assert [(r["eval_id"], r["config"], r["run_number"], r["time_seconds"]) for r in rows] == [("1", "base", 1, 7.5)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    assert files.read_captions(spark, str(tmp_path / "c")).first()["cues"] == ["hello"]


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "w.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S 1" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>text</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>1.5</v></c><c r="C2"/></row></sheetData></worksheet>')
    spark.dataSource.register(WorkbookSource)
    rows = spark.read.format("workbook").load(str(path)).collect()
    assert sorted(map(tuple, rows)) == [("S 1", "visible", 2, 2, "text", "text"), ("S 1", "visible", 2, 27, "number", "1.5")]


def test_archive():
    mht = b"MIME-Version: 1.0\r\nContent-Type: multipart/related; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Location: http://x/\r\n\r\n<p>hi</p>\r\n--b--\r\n"
    assert archives.frames(mht)[0][1:3] == ("http://x/", "text/html")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x|y"), (2, None)], "k int, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "c"), header=True).collect())) == [("1", "'=x|y"), ("2", None)]
    assert sinks.markdown_table(df, ["k"]) == "| k | t |\n| --- | --- |\n| 1 | =x\\|y |\n| 2 |  |"
    assert json.loads(sinks.nested_json({("s", "a"): df})) == [{"k": 1, "t": "=x|y"}, {"k": 2, "t": None}]


def test_streaming_windows_equal_the_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k // 6:02d}:{k % 6 * 10:02d}:00", k % 3, "ab"[k % 2], float(k)) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = window_counts(timed(stream, "10 minutes"), "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "k1")).start()
    q.awaitTermination(120)
    batch = window_counts(timed(events), "1 hour")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    q = first_match(timed(stream), "event_type", "b", 2).writeStream.outputMode("append").format("memory").queryName("m").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "k2")).start()
    q.awaitTermination(120)
    assert sorted(r["user_id"] for r in spark.table("m").collect()) == [0, 1, 2]
