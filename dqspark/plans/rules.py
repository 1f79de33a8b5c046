"""Data-quality rules: a small check language, compiled to Columns, run in one scan.

A rule has an id, a column, a check, and optionally a severity, a filter (when), a message
and a tolerance. A check is a text or a tree {"and"|"or"|"not": ...} of texts:

  value OP literal      == != < <= > >=, with + - * / over value, numbers and [columns]
  between:A,B           inclusive; between_excl:A,B exclusive; numbers only
  in [a, 'b, c'], not in [...]
  is_number is_date is_text is_bool is_error required not_empty
  regex:PATTERN         of the whole text; len OP N; starts_with:X; ends_with:X
  date_in_month:YYYY-MM; date_in_range:A,B; date_before:D; date_after:D; date_weekday:0,1 (0 = Monday)
  AGG(column) OP N      sum avg mean min max median stdev count count_nonempty count_distinct count_errors
  sum_by:KEY OP N, count_by:KEY OP N, avg_by:KEY OP N

A finding is a row (or a group, or a table for aggregates) that does not satisfy its check.
Empty values are skipped unless the check is required or not_empty. A value that is an
error code fails every check but is_error. Comparisons are total: what cannot be compared
does not hold; numbers are equal within the tolerance.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions import values as V
from dqspark.plans.yaml_text import parse_yaml

MAX_DEPTH, MAX_PATTERN = 16, 1000
AGGREGATES = ("sum", "avg", "mean", "min", "max", "median", "stdev", "count", "count_nonempty", "count_distinct", "count_errors")
SEVERITIES = ("error", "warning", "info")


class RuleError(ValueError):
    """A rule that cannot be read or does not fit its table."""


@dataclass(frozen=True)
class Rule:
    id: str
    column: str = ""
    check: Any = None
    severity: str = "error"
    when: Any = None
    message: str = ""
    tolerance: float = 1e-9
    #: Serial numbers and ISO-looking text in the column count as dates.
    dates: bool = False
    #: First and last row that the rule is about (by the row that names rows), all without.
    rows: tuple[int, int] | None = None
    #: Instead of a column: the cells of a workbook's sheets that the rule is about (see scopes.py).
    scope: str = ""


@dataclass(frozen=True)
class Node:
    """A parsed check: kind and arguments."""

    kind: str
    args: tuple = field(default_factory=tuple)

    def canonical(self) -> str:
        return f"{self.kind}({', '.join(a.canonical() if isinstance(a, Node) else repr(a) for a in self.args)})"


# --- parsing ---------------------------------------------------------------------------------

_COMPARE = re.compile(r"^(?P<left>.+?)\s*(?P<op>==|!=|<=|>=|<|>)\s*(?P<right>.+)$", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<col>\[[^\]]+\])|(?P<name>value)|(?P<op>[-+*/()]))")


def literal(text: str) -> Any:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "none"):
        return None
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text


def split_list(text: str) -> list[str]:
    """At commas outside quotes."""
    return [m.strip() for m in re.findall(r"\s*('[^']*'|\"[^\"]*\"|[^,]+)\s*(?:,|$)", text)]


def lint_pattern(pattern: str) -> None:
    """Refuses patterns that are too long, broken, or repeat a repetition."""
    if len(pattern) > MAX_PATTERN:
        raise RuleError("the pattern is too long")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"the pattern is broken: {e}") from e
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]", pattern):
        raise RuleError("the pattern repeats a repetition, which can take exponential time")


def _operand(text: str) -> Node | None:
    """An arithmetic expression over value, numbers and [columns], or nothing if it is none."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def atom() -> Node:
        nonlocal pos
        if pos >= len(tokens):
            raise RuleError(f"incomplete expression: {text}")
        kind, word = tokens[pos]
        pos += 1
        if kind == "num":
            return Node("number", (float(word),))
        if kind == "col":
            return Node("column", (word[1:-1],))
        if kind == "name":
            return Node("value")
        if word == "(":
            inner = total()
            if pos >= len(tokens) or tokens[pos][1] != ")":
                raise RuleError(f"a bracket is open: {text}")
            pos += 1
            return inner
        if word == "-":
            return Node("arith", ("-", Node("number", (0.0,)), atom()))
        raise RuleError(f"unexpected {word!r}: {text}")

    def chain(ops: str, inner) -> Node:
        nonlocal pos
        left = inner()
        while pos < len(tokens) and tokens[pos][0] == "op" and tokens[pos][1] in ops:
            op = tokens[pos][1]
            pos += 1
            left = Node("arith", (op, left, inner()))
        return left

    def total() -> Node:
        return chain("+-", lambda: chain("*/", atom))

    out = total()
    return out if pos == len(tokens) else None


def parse_check(check: Any, depth: int = 0) -> Node:
    if depth > MAX_DEPTH:
        raise RuleError("the check is nested too deeply")
    if isinstance(check, dict):
        if len(check) != 1 or next(iter(check)) not in ("and", "or", "not"):
            raise RuleError(f"a tree has one of and, or, not: {check}")
        kind, inner = next(iter(check.items()))
        parts = inner if isinstance(inner, list) else [inner]
        if kind == "not" and len(parts) != 1 or not parts:
            raise RuleError(f"wrong number of parts: {check}")
        return Node(kind, tuple(parse_check(p, depth + 1) for p in parts))
    text = str(check).strip()
    name, colon, rest = text.partition(":")
    if text in ("is_number", "is_date", "is_text", "is_bool", "is_error", "required", "not_empty"):
        return Node(text)
    if m := re.fullmatch(r"(value\s+)?(not\s+)?in\s*\[(.*)\]", text, re.S):
        return Node("in", (bool(m[2]), tuple(literal(x) for x in split_list(m[3]))))
    if colon and name in ("between", "between_excl", "date_in_range"):
        parts = [literal(x) for x in split_list(rest)]
        if len(parts) != 2:
            raise RuleError(f"two bounds are needed: {text}")
        return Node(name, tuple(parts))
    if colon and name == "regex":
        lint_pattern(rest)
        return Node("regex", (rest,))
    if colon and name in ("starts_with", "ends_with", "date_in_month", "date_before", "date_after"):
        return Node(name, (str(literal(rest)),))
    if colon and name == "date_weekday":
        return Node(name, tuple(int(x) for x in split_list(rest)))
    if m := re.fullmatch(r"(sum|count|avg)_by:\s*(.+?)\s*(==|!=|<=|>=|<|>)\s*(\S+)", text):
        return Node("group", (m[1], m[2], m[3], float(m[4])))
    if m := re.fullmatch(r"len\s*(==|!=|<=|>=|<|>)\s*(\d+)", text):
        return Node("len", (m[1], int(m[2])))
    if m := re.fullmatch(r"(\w+)\(([^)]*)\)\s*(==|!=|<=|>=|<|>)\s*(\S+)", text):
        if m[1] not in AGGREGATES:
            raise RuleError(f"unknown aggregate {m[1]}")
        return Node("aggregate", (m[1], m[2].strip(), m[3], float(m[4])))
    if m := _COMPARE.match(text):
        left = _operand(m["left"])
        if left is None:
            raise RuleError(f"not understood: {text}")
        right = _operand(m["right"])
        plain = right is None or right.kind == "number"
        return Node("compare", (m["op"], left, Node("literal", (literal(m["right"]),)) if plain else right))
    raise RuleError(f"not understood: {text}")


def rules_from(source: str | list[dict]) -> list[Rule]:
    """From JSON or YAML text {"version": 1, "defaults": {...}, "rules": [...]} or a list of rules; ids are unique, unknown keys are refused."""
    if isinstance(source, str):
        if len(source) > 1 << 20:
            raise RuleError("the rules file is too large")

        def unique(pairs: list[tuple[str, Any]]) -> dict:
            if len({k for k, _ in pairs}) < len(pairs):
                raise RuleError("a key is given twice")
            return dict(pairs)

        try:
            doc = json.loads(source, object_pairs_hook=unique) if source.lstrip().startswith("{") else parse_yaml(source)
        except ValueError as e:
            raise e if isinstance(e, RuleError) else RuleError(str(e)) from e
        if not isinstance(doc, dict) or doc.get("version") != 1:
            raise RuleError("the version must be 1")
        defaults, items = doc.get("defaults", {}), doc["rules"]
    else:
        defaults, items = {}, source
    known = set(Rule.__dataclass_fields__)
    if odd := sorted({k for item in [defaults, *items] for k in item} - known):
        raise RuleError(f"unknown keys: {odd}")
    out = [Rule(**(defaults | item)) for item in items]
    if bad := [r.id for r in out if bool(r.column) == bool(r.scope) or r.check is None]:
        raise RuleError(f"a check and either a column or a scope are needed: {bad}")
    if len({r.id for r in out}) < len(out):
        raise RuleError("a rule id is used twice")
    if bad := [r.id for r in out if r.severity not in SEVERITIES]:
        raise RuleError(f"unknown severity: {bad}")
    return out


# --- compiling -------------------------------------------------------------------------------


def column_of(df: DataFrame, name: str) -> str:
    """The column of a header: exact, else trimmed; missing and ambiguous ones are errors."""
    exact = [c for c in df.columns if c == name] or [c for c in df.columns if c.strip() == name.strip()]
    if len(exact) != 1:
        raise RuleError(f"column {name!r} is {'ambiguous' if exact else 'missing'}")
    return exact[0]


def total(pred: Column) -> Column:
    """What is neither true nor false does not hold."""
    return F.coalesce(pred, F.lit(False))


def compare(left: Column, op: str, right: Column, tolerance: float) -> Column:
    near = F.abs(left - right) <= F.lit(tolerance)
    return {
        "==": near, "!=": ~near, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right,
    }[op]


class Compiler:
    """Turns parsed checks on one column of a table into predicates."""

    def __init__(self, df: DataFrame, column: str, rule: Rule):
        self.df, self.rule = df, rule
        self.name = column_of(df, column)
        self.kind = df.schema[self.name].dataType
        self.value = F.col(f"`{self.name}`")
        self.type = V.logical_type(self.value, self.kind, rule.dates)
        self.number = V.as_number(self.value, self.kind)
        self.date = V.as_date(self.value, self.kind) if not (rule.dates and isinstance(self.kind, V.NUMERIC)) else V.serial_date(self.value)
        self.text = V.strip(self.value) if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def arithmetic(self, node: Node) -> Column:
        if node.kind == "number":
            return F.lit(node.args[0])
        if node.kind == "literal":
            return F.lit(float(node.args[0])) if isinstance(node.args[0], (int, float)) else F.lit(None).cast("double")
        if node.kind == "value":
            return self.number
        if node.kind == "column":
            name = column_of(self.df, node.args[0])
            return V.as_number(F.col(f"`{name}`"), self.df.schema[name].dataType)
        op, a, b = node.args
        x, y = self.arithmetic(a), self.arithmetic(b)
        return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]

    def predicate(self, node: Node) -> Column:
        return total(self._predicate(node))

    def _predicate(self, node: Node) -> Column:
        kind, args = node.kind, node.args
        if kind == "and":
            return reduce(lambda a, b: a & b, map(self.predicate, args))
        if kind == "or":
            return reduce(lambda a, b: a | b, map(self.predicate, args))
        if kind == "not":
            return ~self.predicate(args[0])
        if kind == "compare":
            return self._compare(*args)
        if kind in ("between", "between_excl"):
            number = self.number if not isinstance(self.kind, T.BooleanType) else F.lit(None).cast("double")
            low, high = (F.lit(float(a)) for a in args)
            return number.between(low, high) if kind == "between" else (number > low) & (number < high)
        if kind == "in":
            negated, items = args
            found = reduce(lambda a, b: a | b, [total(self._equal(x)) for x in items], F.lit(False))
            return ~found if negated else found
        if kind in ("is_number", "is_date", "is_text", "is_bool", "is_error"):
            return self.type == kind[3:]
        if kind in ("required", "not_empty"):
            return self.type != "empty"
        if kind == "regex":
            return self.text.rlike(f"^(?:{args[0]})$")
        if kind == "len":
            return compare(F.char_length(self.text).cast("double"), args[0], F.lit(float(args[1])), 0)
        if kind == "starts_with":
            return self.text.startswith(args[0])
        if kind == "ends_with":
            return self.text.endswith(args[0])
        if kind == "date_in_month":
            return F.date_format(self.date, "yyyy-MM") == args[0]
        if kind == "date_in_range":
            return self.date.between(*[F.lit(str(a)).cast("date") for a in args])
        if kind == "date_before":
            return self.date < F.lit(args[0]).cast("date")
        if kind == "date_after":
            return self.date > F.lit(args[0]).cast("date")
        if kind == "date_weekday":
            return F.weekday(self.date).isin(*args)
        raise RuleError(f"{kind} stands for a whole column, not for a value")

    def _equal(self, value: Any) -> Column:
        if value is None:
            return self.value.isNull()
        if isinstance(value, bool):
            return self.value == F.lit(value) if isinstance(self.kind, T.BooleanType) else F.lit(False)
        if isinstance(value, (int, float)):
            return F.abs(self.number - F.lit(float(value))) <= self.rule.tolerance
        if isinstance(self.kind, V.TEMPORAL):
            return self.date == F.lit(value).try_cast("date")
        return self.text == F.lit(str(value))

    def _compare(self, op: str, left: Node, right: Node) -> Column:
        if left.kind == "value" and right.kind == "literal" and not isinstance(right.args[0], (int, float)) or right.kind == "literal" and isinstance(right.args[0], bool):
            value = right.args[0]
            if op in ("==", "!="):
                same = total(self._equal(value))
                return same if op == "==" else ~same
            if isinstance(self.kind, V.TEMPORAL):
                return compare(F.unix_date(self.date), op, F.unix_date(F.lit(value).try_cast("date")), 0)
            return {"<": self.text < value, "<=": self.text <= value, ">": self.text > value, ">=": self.text >= value}[op]
        return compare(self.arithmetic(left), op, self.arithmetic(right), self.rule.tolerance)


def aggregate_columns(df: DataFrame, name: str) -> dict[str, Column]:
    """Every aggregate of the language over one column (count is of all rows, the rest as named)."""
    own = column_of(df, name)
    kind, value = df.schema[own].dataType, F.col(f"`{own}`")
    number, type_ = V.as_number(value, kind), V.logical_type(value, kind)
    return {
        "sum": F.sum(number), "avg": F.avg(number), "mean": F.avg(number), "min": F.min(number), "max": F.max(number),
        "median": F.median(number), "stdev": F.stddev_samp(number), "count": F.count(F.lit(1)).cast("double"),
        "count_nonempty": F.count_if(type_ != "empty").cast("double"),
        "count_distinct": F.count_distinct(F.when(type_ != "empty", value.cast("string"))).cast("double"),
        "count_errors": F.count_if(type_ == "error").cast("double"),
        "skipped": F.count_if(number.isNull() & (type_ != "empty")).cast("double"),
    }


# --- running ---------------------------------------------------------------------------------

FINDING = "table string, row long, column string, rule_id string, severity string, value string, message string, group string"


def message_of(rule: Rule, default: str, fields: dict[str, Column]) -> Column:
    """The rule's template with $value, $row, $column, $table, $group put in; other names stay as they are."""
    parts = re.split(r"\$(\w+)", rule.message or default)
    out = [F.lit(parts[0])]
    for name, text in zip(parts[1::2], parts[2::2], strict=True):
        out.append(F.coalesce(fields[name].cast("string"), F.lit("")) if name in fields else F.lit("$" + name))
        out.append(F.lit(text))
    return F.concat(*out)


def _picked(which: Column, options: list[Column]) -> Column:
    """The option of that number."""
    out = options[-1]
    for k in range(len(options) - 2, -1, -1):
        out = F.when(which == k, options[k]).otherwise(out)
    return out


def run_rules(df: DataFrame, rules: list[Rule], table: str, row: Column | None = None) -> DataFrame:
    """The findings of all rules. Row rules share one scan; aggregates one aggregation; groups one for each key.

    row: names a row; by default rows have none. Rules about some rows only need it.
    """
    named, row = row is not None, (row if row is not None else F.lit(None)).cast("long")
    if bad := [r.id for r in rules if r.scope or r.rows and not named]:
        raise RuleError(f"scopes need run_book(), rows need a column that names them: {bad}")
    parsed = [(r, parse_check(r.check)) for r in rules]
    found: list[DataFrame] = []
    per_row = [(r, n) for r, n in parsed if n.kind not in ("aggregate", "group")]
    if per_row:
        found.append(_row_findings(df, per_row, table, row))
    for rows in dict.fromkeys(r.rows for r, _ in parsed):
        own = df if rows is None else df.where(row.between(*rows))
        if totals := [(r, n) for r, n in parsed if n.kind == "aggregate" and r.rows == rows]:
            found.append(_aggregate_findings(own, totals, table))
        by_key: dict[str, list] = {}
        for rule, node in parsed:
            if node.kind == "group" and rule.rows == rows:
                by_key.setdefault(node.args[1], []).append((rule, node))
        found += [_group_findings(own, key, rules_, table) for key, rules_ in by_key.items()]
    return reduce(DataFrame.unionAll, found)


def _row_findings(df: DataFrame, rules: list[tuple[Rule, Node]], table: str, row: Column) -> DataFrame:
    """A row's broken rules are found as numbers; what a finding says is made from them afterwards, if anyone asks."""
    broken, names, values, texts = [], [], [], []
    for k, (rule, node) in enumerate(rules):
        c = Compiler(df, rule.column, rule)
        wanted = F.lit(True) if rule.when is None else _when(df, rule)
        if rule.rows is not None:
            wanted = wanted & total(row.between(*rule.rows))
        about_empty = node.kind in ("required", "not_empty")
        asks_error = "is_error" in node.canonical()
        fails = ~c.predicate(node) if asks_error else ((c.type == "error") | ~c.predicate(node))
        if not about_empty:
            fails = (c.type != "empty") & fails
        broken.append(F.when(wanted & fails, F.lit(k)))
        names.append(c.name)
        values.append(c.value.cast("string"))
        texts.append(message_of(rule, f"{rule.column} fails {rule.check}", {"value": c.value, "row": F.col("__row"), "column": F.lit(c.name), "table": F.lit(table)}))
    which = F.col("__rule")
    one_of = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), which + 1)
    marked = df.select("*", row.alias("__row"), F.explode(F.array_compact(F.array(*broken))).alias("__rule"))
    return marked.select(
        F.lit(table).alias("table"), F.col("__row").alias("row"), one_of(names).alias("column"), one_of([r.id for r, _ in rules]).alias("rule_id"),
        one_of([r.severity for r, _ in rules]).alias("severity"), _picked(which, values).alias("value"), _picked(which, texts).alias("message"), F.lit(None).cast("string").alias("group"),
    )


def _when(df: DataFrame, rule: Rule) -> Column:
    """A filter: {"column": ..., "check": ...}, or a check on the rule's own column."""
    if isinstance(rule.when, dict) and "column" in rule.when:
        return Compiler(df, rule.when["column"], rule).predicate(parse_check(rule.when["check"]))
    return Compiler(df, rule.column, rule).predicate(parse_check(rule.when))


def _aggregate_findings(df: DataFrame, rules: list[tuple[Rule, Node]], table: str) -> DataFrame:
    wanted = {(n.args[0], n.args[1] or r.column) for r, n in rules}
    aggregates = {f"{a}|{c}": aggregate_columns(df, c)[a] for a, c in sorted(wanted)}
    one = df.agg(*[e.alias(k) for k, e in aggregates.items()])
    columns = []
    for rule, node in rules:
        name, column, op, bound = node.args
        value = F.col(f"`{name}|{column or rule.column}`")
        holds = total(compare(value, op, F.lit(bound), rule.tolerance))
        text = message_of(rule, f"{name}({column or rule.column}) is $value", {"value": value, "table": F.lit(table), "column": F.lit(rule.column)})
        columns.append(F.when(~holds, F.struct(
            F.lit(table).alias("table"), F.lit(None).cast("long").alias("row"), F.lit(column or rule.column).alias("column"), F.lit(rule.id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"), value.cast("string").alias("value"), text.alias("message"), F.lit(None).cast("string").alias("group"),
        )))
    return one.select(F.explode(F.array_compact(F.array(*columns))).alias("f")).select("f.*")


def _group_findings(df: DataFrame, key: str, rules: list[tuple[Rule, Node]], table: str) -> DataFrame:
    """Null is a group of its own; rows whose key is an error code are in none."""
    own = column_of(df, key)
    k = F.col(f"`{own}`")
    wanted = {(n.args[0], r.column) for r, n in rules}
    groups = df.where(V.logical_type(k, df.schema[own].dataType) != "error").groupBy(k.alias("_key")).agg(
        *[aggregate_columns(df, c)[a].alias(f"{a}|{c}") for a, c in sorted(wanted)]
    )
    columns = []
    for rule, node in rules:
        name, _, op, bound = node.args
        value = F.col(f"`{name}|{rule.column}`")
        holds = total(compare(value, op, F.lit(bound), rule.tolerance))
        text = message_of(rule, f"{name} of {rule.column} for $group is $value", {"value": value, "group": F.col("_key"), "table": F.lit(table), "column": F.lit(rule.column)})
        columns.append(F.when(~holds, F.struct(
            F.lit(table).alias("table"), F.lit(None).cast("long").alias("row"), F.lit(rule.column).alias("column"), F.lit(rule.id).alias("rule_id"),
            F.lit(rule.severity).alias("severity"), value.cast("string").alias("value"), text.alias("message"), F.col("_key").cast("string").alias("group"),
        )))
    return groups.select(F.explode(F.array_compact(F.array(*columns))).alias("f")).select("f.*")
