"""Captions and transcripts: cues, rolling overlaps, speaker turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dqspark.functions.binding import let

TIMING = r"(\d{1,2}:)?\d{2}:\d{2}[.,]\d{3}\s+-->\s+(\d{1,2}:)?\d{2}:\d{2}[.,]\d{3}"
#: Marks at the start of a cue that open a speaker's turn.
TURN = r"^\s*(>>+|-\s|\[[^\]]+\]:|[A-Z][\w .]{0,30}:\s)"
LEAST_OVERLAP = 3


def clean_cue(text: Column) -> Column:
    """Without inline tags and timestamps, entities decoded, white space collapsed."""
    out = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def vtt_cues(raw: Column) -> Column:
    """The cue texts of a VTT or SRT text, in order: blocks parted by blank lines that hold a timing line.

    Headers, notes, styles and cue numbers have no text of their own and fall away.
    """
    blocks = F.split(F.regexp_replace(raw, r"\r\n?", "\n"), r"\n[ \t]*\n")
    timed = F.filter(blocks, lambda b: b.rlike(TIMING))
    body = F.transform(timed, lambda b: clean_cue(F.regexp_replace(b, rf"(?s)^.*?{TIMING}[^\n]*\n?", "")))
    return F.filter(body, lambda b: b != "")


def ttml_cues(raw: Column) -> Column:
    """The texts of the p elements of a TTML document."""
    return F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: clean_cue(F.regexp_replace(p, r"<br\s*/?>", " "))), lambda p: p != "")


def _splice(previous: Column, current: Column) -> Column:
    """Words that the end of previous and the start of current share, if at least LEAST_OVERLAP, else 0."""
    most = F.least(F.size(previous), F.size(current))
    fits = F.filter(
        F.sequence(F.lit(0), most),
        lambda k: (k >= LEAST_OVERLAP) & (F.slice(previous, F.size(previous) - k + 1, k) == F.slice(current, F.lit(1), k)),
    )
    return F.coalesce(F.array_max(fits), F.lit(0))


def merge_rolling(cues: Column) -> Column:
    """Cues without the repeats of rolling captions, each compared with the merged one before it.

    An equal cue or one that the last one starts with is dropped, one that extends the last
    one replaces it, and one that overlaps its end by three words or more adds its new words.
    """
    def step(acc: Column, cue: Column) -> Column:
        parts = F.struct(F.element_at(acc, -1).alias("last"), F.split(F.element_at(acc, -1), " ").alias("before"), F.split(cue, " ").alias("now"))
        return F.when(F.size(acc) == 0, F.array(cue)).otherwise(let(parts, lambda p: merged(acc, cue, p)))

    def merged(acc: Column, cue: Column, p: Column) -> Column:
        last = p["last"]
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        rest = lambda k: F.array_join(F.slice(p["now"], k + 1, F.size(p["now"])), " ")
        joined = lambda k: F.when(rest(k) == "", last).otherwise(F.concat(last, F.lit(" "), rest(k)))
        return (
            F.when(last.startswith(cue), acc)
            .when(cue.startswith(last), F.concat(head, F.array(cue)))
            .otherwise(let(_splice(p["before"], p["now"]), lambda k: F.when(k > 0, F.concat(head, F.array(joined(k)))).otherwise(F.concat(acc, F.array(cue)))))
        )

    return F.aggregate(cues, F.array().cast("array<string>"), step)


def paragraphs(cues: Column) -> Column:
    """Text of merged cues: a cue that opens a turn begins a paragraph."""
    return F.trim(F.aggregate(cues, F.lit(""), lambda acc, c: F.concat(acc, F.when(acc == "", "").when(c.rlike(TURN), "\n\n").otherwise(" "), c)))


def turns(text: Column) -> Column:
    """The number of paragraphs that open with a speaker's mark."""
    return F.size(F.filter(F.split(text, r"\n\n"), lambda p: p.rlike(TURN)))
