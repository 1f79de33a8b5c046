"""Logical types of values, total comparisons, coercions and renderings.

Every cast is a try: a value that does not fit gives null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The seven classic spreadsheet error codes, as text.
ERROR_CODES = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

NUMBER_PATTERN = r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"
LEADING_ZERO_PATTERN = r"^[+-]?0\d+$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATETIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
EPOCH = "1899-12-30"
#: Serial numbers taken for dates when a column asks for it, 1970-01-01 to 2099-12-31.
SERIAL_DATES = (25569, 73050)
#: White space of ASCII and Unicode's separators.
WHITE = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.btrim(col, F.lit(WHITE))


def logical_type(col: Column, kind: T.DataType, dates: bool = False) -> Column:
    """number, date, bool, text, error or empty; for text columns each value decides.

    dates: serial numbers inside SERIAL_DATES and ISO-looking text count as dates.
    """
    if isinstance(kind, T.BooleanType):
        known = F.lit("bool")
    elif isinstance(kind, NUMERIC):
        known = F.when(F.lit(dates) & is_serial_date(col), "date").otherwise("number")
    elif isinstance(kind, TEMPORAL):
        known = F.lit("date")
    else:
        text = strip(col.cast("string"))
        known = (
            F.when(text == "", "empty")
            .when(text.isin(*ERROR_CODES), "error")
            .when(F.lit(dates) & text_date(text).isNotNull(), "date")
            .otherwise("text")
        )
    return F.when(col.isNull(), "empty").otherwise(known)


def is_serial_date(col: Column) -> Column:
    return F.coalesce(col.cast("double").between(*SERIAL_DATES), F.lit(False))


def serial_date(col: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(col.try_cast("double")).cast("int"))


def date_serial(col: Column) -> Column:
    """Days since the epoch, the time of day as fraction."""
    moment = col.cast("timestamp_ntz")
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
    return F.datediff(moment.cast("date"), F.lit(EPOCH).cast("date")) + seconds / F.lit(86400)


def text_date(col: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy")) -> Column:
    """The date that a text names, by the first format that fits; the formats are an explicit list."""
    return F.coalesce(*[F.try_to_date(col, f) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(col, F.lit(f))) for f in formats])


def as_number(col: Column, kind: T.DataType) -> Column:
    """Numbers and booleans as doubles, all else null; text does not count as a number."""
    if isinstance(kind, (*NUMERIC, T.BooleanType)):
        number = col.cast("double")
        return F.when(~F.isnan(number), number)
    return F.lit(None).cast("double")


def as_date(col: Column, kind: T.DataType) -> Column:
    return col.cast("date") if isinstance(kind, TEMPORAL) else text_date(strip(col.cast("string"))) if isinstance(kind, T.StringType) else F.lit(None).cast("date")


def parsed_number(col: Column) -> Column:
    """The double that a text with a decimal point or comma stands for."""
    text = strip(col)
    return F.when(text.rlike(NUMBER_PATTERN), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def cell_kind(col: Column) -> Column:
    """Per-value inference: integer, number, date, datetime, bool, text or empty."""
    text = strip(col)
    return (
        F.when(col.isNull() | (text == ""), "empty")
        .when(F.lower(text).isin("true", "false"), "bool")
        .when(text.rlike(LEADING_ZERO_PATTERN), "text")
        .when(text.rlike(INTEGER_PATTERN), "integer")
        .when(parsed_number(text).isNotNull(), "number")
        .when(text.rlike(ISO_DATE_PATTERN) & text_date(text, ("yyyy-MM-dd",)).isNotNull(), "date")
        .when(text.rlike(ISO_DATETIME_PATTERN), "datetime")
        .otherwise("text")
    )


def bad_iso(col: Column) -> Column:
    """Text that looks like an ISO date or time but is none (strict mode reports it)."""
    text = strip(col)
    dated = text.rlike(ISO_DATE_PATTERN) & text_date(text, ("yyyy-MM-dd",)).isNull()
    timed = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") & text.try_cast("timestamp").isNull()
    return F.coalesce(dated | timed, F.lit(False))


def utc_naive(col: Column) -> Column:
    """A text with or without offset as a time without zone, in UTC."""
    return col.try_cast("timestamp").cast("timestamp_ntz")


def escape_formula(col: Column, mode: str = "quote") -> Column:
    """Text that a spreadsheet would take for a formula: quote it, strip its sign, or leave it (off)."""
    risky = F.substring(col, 1, 1).isin("=", "+", "-", "@", "\t", "\r")
    if mode == "off":
        return col
    changed = F.concat(F.lit("'"), col) if mode == "quote" else F.regexp_replace(col, r"^[=+\-@\t\r]+", "")
    return F.when(risky, changed).otherwise(col)


def number_text(col: Column, form: str) -> Column:
    """percent, thousands, zeros:N, decimals:N or date renderings of a number."""
    name, _, arg = form.partition(":")
    if name == "percent":
        return F.concat(F.format_number(col * 100, int(arg or 0)), F.lit("%"))
    if name == "thousands":
        return F.format_number(col, int(arg or 0))
    if name == "decimals":
        return F.replace(F.format_number(col, int(arg or 2)), F.lit(","), F.lit(""))
    if name == "zeros":
        return F.lpad(col.cast("long").cast("string"), int(arg), "0")
    if name == "date":
        return F.date_format(serial_date(col), arg or "yyyy-MM-dd")
    raise ValueError(f"unknown number form {form!r}")


def datetime_text(col: Column, form: str = "iso") -> Column:
    """iso, serial or raw renderings of a date or time."""
    if form == "iso":
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return date_serial(col).cast("string") if form == "serial" else col.cast("string")


def hyperlink(value: Column, href: Column, schemes: tuple[str, ...] = ("http", "https", "mailto")) -> Column:
    """A Markdown link where the address has an allowed scheme, else the value."""
    allowed = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).isin(*schemes)
    return F.when(allowed, F.concat(F.lit("["), value, F.lit("]("), href, F.lit(")"))).otherwise(value)


def markdown_cell(value: Column) -> Column:
    """A value inside a pipe table."""
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")


def strip_inline_markdown(col: Column) -> Column:
    """Links become their text, emphasis and code marks go."""
    out = F.regexp_replace(col, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"`([^`]*)`", "$1")
    return F.regexp_replace(out, r"(\*\*|__|\*|~~)(\S(?:.*?\S)?)\1", "$2")


def flat_runs(runs: Column) -> Column:
    """The text of rich text, an array of runs with a field text; null runs and texts count as empty."""
    return F.array_join(F.transform(F.coalesce(runs, F.array()), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def slug(col: Column) -> Column:
    out = F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def stable_id(col: Column, size: int = 12) -> Column:
    return F.substring(F.sha1(col.cast("binary")), 1, size)


def content_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def json_path(col: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text."""
    return F.get_json_object(col, "$." + path)


def page_ranges(spec: Column) -> Column:
    """"1-3:a,5:b" as an array of (first, last, name)."""
    part = r"^\s*(\d+)(?:-(\d+))?(?::(.*))?\s*$"
    return F.transform(
        F.filter(F.split(spec, ","), lambda p: p.rlike(part)),
        lambda p: F.struct(
            F.regexp_extract(p, part, 1).cast("int").alias("first"),
            F.coalesce(F.regexp_extract(p, part, 2).try_cast("int"), F.regexp_extract(p, part, 1).cast("int")).alias("last"),
            F.nullif(F.regexp_extract(p, part, 3), F.lit("")).alias("name"),
        ),
    )
