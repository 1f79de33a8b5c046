"""File sources: delimited text, JSON and JSON lines, Markdown vaults, run results, trees, captions.

Paths are Spark's own, on any file system that it reads; only headers and samples come to
the driver.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions import captions
from dqspark.operators.merge import suffixed_names

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_LINES = 50


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that stands equally often, and most often, in the first lines; a comma if none does."""
    lines = [r["value"] for r in spark.read.text(path).limit(SAMPLE_LINES).collect() if r["value"].strip()]
    best, found = 0, ","
    for d in DELIMITERS:
        counts = {line.count(d) for line in lines}
        if len(counts) == 1 and (n := counts.pop()) > best:
            best, found = n, d
    return found


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> tuple[DataFrame, list[str]]:
    """All columns as text, and the headers that the file has twice (they get __2, __3, ...)."""
    sep = sep or sniff_delimiter(spark, path)
    raw = spark.read.csv(path, sep=sep, header=False, encoding=encoding, quote='"', escape='"', multiLine=True)
    head = spark.read.csv(path, sep=sep, header=False, encoding=encoding, quote='"', escape='"').first()
    names = [str(v) if v is not None else f"col_{k}" for k, v in enumerate(head or [], 1)]
    if not names:
        return raw, []
    twice = sorted({n for n in names if names.count(n) > 1})
    schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
    data = spark.read.csv(path, sep=sep, header=True, enforceSchema=True, schema=schema, encoding=encoding, quote='"', escape='"', multiLine=True)
    return data.toDF(*suffixed_names(names)), twice


def encoding_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, offset): files that are no UTF-8, with the place of the first bad byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bad = files.where(~F.is_valid_utf8(F.col("content").cast("string")))
    # what stands before the first replacement character that the bytes themselves do not spell
    text = F.make_valid_utf8(F.col("content").cast("string"))
    clean = F.substring_index(text, "\uFFFD", 1)
    return bad.select("path", "length", F.octet_length(clean).cast("long").alias("offset"))


def acquire(spark: SparkSession, ref: str, pages: DataFrame | None = None) -> DataFrame:
    """(ref, frame, url, html) of what a reference names: an archive, an address among pages (url, html), or files.

    Addresses are never fetched: without a row for one there is none.
    """
    from dqspark.sources.archives import read_archives

    if "://" in ref and ref.split("://", 1)[0].lower() in ("http", "https"):
        if pages is None:
            raise ValueError("an address needs a table of pages")
        return pages.where(F.col("url") == ref).select(F.lit(ref).alias("ref"), F.lit(0).alias("frame"), "url", "html")
    if ref.lower().endswith((".mht", ".mhtml", ".webarchive")):
        return read_archives(spark, ref).select(F.lit(ref).alias("ref"), "frame", "url", "html")
    files = spark.read.format("binaryFile").load(ref)
    return files.select(F.lit(ref).alias("ref"), F.lit(0).alias("frame"), F.col("path").alias("url"), decoded(F.col("content")).alias("html"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects or a single object a file; keys are united, broken files give a row in _corrupt_record."""
    return spark.read.json(path, multiLine=True, mode="PERMISSIVE")


def json_shape(spark: SparkSession, path: str) -> str:
    """records (an array of objects), sheets ({name: [objects]}), object or other, from the schema alone."""
    raw = spark.read.text(path, wholetext=True).select(F.schema_of_json(F.lit("{}")), F.trim("value").alias("v")).limit(1).collect()
    if not raw:
        return "other"
    doc = json.loads(raw[0]["v"])
    if isinstance(doc, list):
        return "records" if all(isinstance(x, dict) for x in doc) else "other"
    if isinstance(doc, dict) and doc and all(isinstance(v, list) and all(isinstance(x, dict) for x in v) for v in doc.values()):
        return "sheets"
    return "object" if isinstance(doc, dict) else "other"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed lines, and the broken ones (file, line); blank lines are passed over.

    Lines are numbered file by file, each file as one text.
    """
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("_p", "raw"))
    filled = texts.where(F.trim("raw") != "").select("file", (F.col("_p") + 1).alias("line"), "raw")
    parsed = filled.withColumn("_ok", F.try_parse_json("raw").isNotNull())
    good = parsed.where("_ok").select("file", "line", F.from_json("raw", schema).alias("v")).select("file", "line", "v.*")
    return good, parsed.where("NOT _ok").select("file", "line", "raw")


def decoded(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as UTF-8 if they are, else in the fallback charset."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, fallback))


#: The folders of a vault and the kinds of pages in them. The plain names are read too.
KINDS = {"_sources": "source", "_concepts": "concept", "_entities": "entity", "concepts": "concept", "entities": "entity"}


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(layer, name, kind, path, text) of Markdown pages: <layer>/<folder>/<name>.md, the folder tells the kind."""
    pages = None
    for folder in ("*", *(k for k in KINDS if k.startswith("_"))):  # Spark passes over folders with a leading underscore unless they are named
        try:
            own = spark.read.option("pathGlobFilter", "*.md").text(f"{path}/*/{folder}", wholetext=True)
        except AnalysisException:
            continue
        own = own.where(~F.input_file_name().rlike(r"/_[^/]*/[^/]*$")) if folder == "*" else own
        own = own.select("value", F.input_file_name().alias("file"))
        pages = own if pages is None else pages.unionAll(own)
    if pages is None:
        raise ValueError(f"no pages in {path}")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+\.md$", 1)
    kind = F.lit("page")
    for name, value in KINDS.items():
        kind = F.when(folder == name, value).otherwise(kind)
    return pages.select(F.url_decode("file").alias("path"), F.col("value").alias("text")).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+\.md$", 1).alias("layer"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), kind.alias("kind"), "path", "text"
    )


RUN_SCHEMA = "summary struct<pass_rate:double,passed:int,failed:int,total:int>, timing struct<total_duration_seconds:double>, execution_metrics struct<total_tool_calls:int,output_chars:long,errors_encountered:int,tokens:long>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from eval-<id>/<config>/run-<n>/grading.json; the time falls back on timing.json beside it, broken files are left out."""
    where = r"eval-([^/]+)/([^/]+)/run-(\d+)/"
    key = lambda: [F.regexp_extract(F.input_file_name(), where, k).alias(n) for k, n in enumerate(("eval_id", "config", "run_number"), 1)]
    json_of = lambda name, schema: spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(path, multiLine=True)
    runs = json_of("grading.json", RUN_SCHEMA).select(*key(), "summary", "timing", "execution_metrics").where("summary IS NOT NULL AND eval_id != ''")
    times = json_of("timing.json", "total_duration_seconds double").select(*key(), F.col("total_duration_seconds").alias("_s"))
    return with_times(runs, times, ["eval_id", "config", "run_number"], F.col("timing.total_duration_seconds"), "_s").select(
        "eval_id", "config", F.col("run_number").cast("int").alias("run_number"), "summary.pass_rate", "summary.passed", "summary.failed", "summary.total",
        "time_seconds", F.col("execution_metrics.tokens").alias("tokens"),
        F.col("execution_metrics.output_chars").alias("output_chars"), F.col("execution_metrics.total_tool_calls").alias("tool_calls"),
        F.coalesce("execution_metrics.errors_encountered", F.lit(0)).alias("errors"),
    )


def with_times(runs: DataFrame, times: DataFrame, keys: list[str], own: Column, other: str) -> DataFrame:
    """Adds time_seconds: the run's own time, else the one that the table beside has for its keys, else null."""
    return runs.join(times.select(*keys, other), keys, "left").withColumn("time_seconds", F.coalesce(own, F.col(other))).drop(other)


def read_tree(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """(path, length, text) of text files up to a size, at any depth; binary ones (a zero byte near the start) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most)
    binary = F.instr(F.hex(F.substring("content", 1, 1024)), "00") % 2 == 1
    return files.where(~binary).select("path", "length", decoded(F.col("content")).alias("text"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """(path, cues) of VTT, SRT and TTML files."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    timed = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.where(timed.isin("vtt", "srt", "ttml", "xml")).select("path", F.when(timed.isin("vtt", "srt"), captions.vtt_cues(F.col("value"))).otherwise(captions.ttml_cues(F.col("value"))).alias("cues"))


def result_urls(raw: Column, most: int) -> Column:
    """Addresses in a search response, once each, in order: the url fields of its data, results or list, else all that look like one."""
    listed = [F.get_json_object(raw, f"{path}[*].url") for path in ("$.data", "$.results", "$")]
    fields = F.coalesce(*[F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(F.btrim(x, F.lit('"')))) for x in listed])
    swept = F.regexp_extract_all(raw, F.lit(r"(https?://[^\s\"'<>\\]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.coalesce(fields, swept), lambda u: u.rlike("^https?://"))), 1, most)
