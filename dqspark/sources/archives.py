"""Web archives (MHTML, webarchive) as frames."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.functions.html import text_length

PAGES = ("text/html", "application/xhtml+xml")
#: Visible characters of a frame that counts as one with content.
SUBSTANTIAL = 200


def frames(content: bytes) -> list[tuple[int, str, str, str]]:
    """(number, url, type, html) of the HTML parts of an MHTML message or a webarchive, the main one first."""
    if content[:6] == b"bplist" or content.lstrip()[:5] == b"<?xml" and b"<plist" in content[:1000]:
        return _webarchive(plistlib.loads(content), [])
    from email import message_from_bytes, policy

    out = []
    for part in message_from_bytes(content, policy=policy.default).walk():
        if part.get_content_type() in PAGES:
            out.append((len(out), part.get("Content-Location", ""), part.get_content_type(), part.get_content()))
    return out


def _webarchive(doc: dict, out: list, depth: int = 0) -> list[tuple[int, str, str, str]]:
    main = doc.get("WebMainResource", {})
    if main.get("WebResourceMIMEType") in PAGES:
        raw, charset = main.get("WebResourceData", b""), main.get("WebResourceTextEncodingName") or "utf-8"
        try:
            html = raw.decode(charset)
        except (LookupError, UnicodeDecodeError):
            html = raw.decode("iso-8859-1")
        out.append((len(out), main.get("WebResourceURL", ""), main["WebResourceMIMEType"], html))
    for frame in doc.get("WebSubframeArchives", []) if depth < 16 else []:
        _webarchive(frame, out, depth + 1)
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, url, html of each archive's HTML frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, url, html) for p, c in zip(batch["path"], batch["content"], strict=True) for k, url, _, html in frames(c)]
            yield pd.DataFrame(rows, columns=["path", "frame", "url", "html"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mht,mhtml,webarchive}").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, frame int, url string, html string")


def chosen_frames(archives: DataFrame, mode: str = "auto", least: int = SUBSTANTIAL) -> DataFrame:
    """Of each archive (path) the frames of a mode: main (the first), all, substantial (of so many visible characters), or auto: the
    first frame if it is substantial, else the one of most text. A number names one frame."""
    if mode == "all":
        return archives
    if mode == "main" or mode.isdigit():
        return archives.where(F.col("frame") == (int(mode) if mode.isdigit() else 0))
    sized = archives.withColumn("_n", text_length(F.col("html")))
    if mode == "substantial":
        return sized.where(F.col("_n") >= least).drop("_n")
    if mode != "auto":
        raise ValueError(f"unknown mode {mode!r}")
    order = Window.partitionBy("path").orderBy((~((F.col("frame") == 0) & (F.col("_n") >= least))).cast("int"), F.desc("_n"), "frame")
    return sized.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_n", "_k")
