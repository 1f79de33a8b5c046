"""Rules about parts of a workbook: scopes with sheet qualifiers, run over sheets as tables.

A scope is one of these, after an optional sheet and "!":

  cell:H1  A2:A100  col:HEADER  col:B  cols:Date,Hours,C  row:5  sheet:NAME  named:NAME  table:NAME  table:NAME[HEADER]

A sheet with blanks or signs stands in single quotes, a quote inside it twice. Headers are
looked up first, then letters. Rows are numbered as in the sheet; the header row and what
is above it are no data, except for a cell.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.plans.rules import Rule, RuleError, column_of, run_rules

_CELL = r"\$?([A-Za-z]{1,3})\$?(\d+)"


@dataclass(frozen=True)
class Sheet:
    """A sheet as a table: its columns in order (from letter A), the number of each row, and the header's row."""

    data: DataFrame
    row: str
    header_row: int = 1

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if c != self.row]


@dataclass(frozen=True)
class Scope:
    sheet: str | None
    kind: str
    args: tuple


def split_sheet(text: str) -> tuple[str | None, str]:
    """The sheet qualifier, without its quotes, and the rest."""
    if text.startswith("'"):
        m = re.match(r"'((?:[^']|'')+)'!", text)
        if not m:
            raise RuleError(f"a sheet's quote is open: {text}")
        name, rest = m[1].replace("''", "'"), text[m.end() :]
    else:
        name, mark, rest = text.partition("!")
        if not mark or ":" in name:
            return None, text
    if re.search(r"[\\/?*\[\]:]", name) or name.startswith("'") or name.endswith("'"):
        raise RuleError(f"no sheet can have that name: {name}")
    return name, rest


def qualified(sheet: str, rest: str) -> str:
    """The text that split_sheet() takes apart."""
    return f"{sheet}!{rest}" if re.fullmatch(r"\w+", sheet) else "'" + sheet.replace("'", "''") + f"'!{rest}"


def column_index(letters: str) -> int:
    """A is 0, Z 25, AA 26."""
    return reduce(lambda n, c: n * 26 + ord(c) - 64, letters.upper(), 0) - 1


def parse_scope(text: str) -> Scope:
    sheet, rest = split_sheet(text.strip())
    kind, colon, arg = rest.partition(":")
    arg = arg.strip()
    if m := re.fullmatch(rf"{_CELL}:{_CELL}", rest):
        (a, i), (b, j) = (m[1], int(m[2])), (m[3], int(m[4]))
        return Scope(sheet, "range", (*sorted((column_index(a), column_index(b))), *sorted((i, j))))
    if colon and kind == "cell":
        inner, ref = split_sheet(arg)
        if m := re.fullmatch(_CELL, ref):
            return Scope(inner or sheet, "cell", (column_index(m[1]), int(m[2])))
    if colon and kind == "row" and arg.isdigit():
        return Scope(sheet, "row", (int(arg),))
    if colon and kind == "cols" and arg:
        return Scope(sheet, "cols", tuple(x.strip() for x in arg.split(",")))
    if colon and kind == "col" and arg:
        return Scope(sheet, "cols", (arg,))
    if colon and kind == "sheet" and arg:
        return Scope(arg, "sheet", ())
    if colon and kind == "named" and arg:
        return Scope(sheet, "named", (arg,))
    if colon and kind == "table" and (m := re.fullmatch(r"([^\[\]]+)(?:\[([^\[\]]+)\])?", arg)):
        return Scope(sheet, "table", (m[1], m[2]))
    raise RuleError(f"no scope: {text}")


def _column(sheet: Sheet, name: str) -> str:
    try:
        return column_of(sheet.data.select(*[F.col(f"`{c}`") for c in sheet.columns]), name)
    except RuleError:
        if re.fullmatch(r"[A-Za-z]{1,3}", name) and column_index(name) < len(sheet.columns):
            return sheet.columns[column_index(name)]
        raise


def resolve(scope: Scope, sheets: dict[str, Sheet], names: dict[str, str], tables: dict[str, str]) -> tuple[str, list[str], tuple[int, int] | None]:
    """The sheet, its columns and its rows (None: all) that a scope means. names, tables: what a name stands for, as a scope of a range."""
    name = scope.sheet or next(iter(sheets))
    if scope.kind in ("named", "table"):
        known = names if scope.kind == "named" else tables
        if scope.args[0] not in known:
            raise RuleError(f"unknown {scope.kind} {scope.args[0]!r}")
        inner = parse_scope(known[scope.args[0]])
        where, columns, rows = resolve(replace(inner, sheet=inner.sheet or scope.sheet), sheets, names, tables)
        if scope.kind == "named":
            return where, columns, rows
        # a table's first row is its header
        rows = (rows[0] + 1, rows[1]) if rows else None
        return where, columns if scope.args[1] is None else [c for c in columns if c == _column(sheets[where], scope.args[1])], rows
    if name not in sheets:
        raise RuleError(f"unknown sheet {name!r}")
    sheet = sheets[name]
    first = sheet.header_row + 1
    if scope.kind == "sheet":
        return name, sheet.columns, None
    if scope.kind == "cols":
        return name, [_column(sheet, c) for c in scope.args], None
    if scope.kind == "row":
        return name, sheet.columns, (scope.args[0], scope.args[0])
    if scope.kind == "cell":
        return name, sheet.columns[scope.args[0] : scope.args[0] + 1], (scope.args[1], scope.args[1])
    left, right, top, bottom = scope.args
    return name, sheet.columns[left : right + 1], (max(top, first), bottom)


def run_book(sheets: dict[str, Sheet], rules: list[Rule], names: dict[str, str] | None = None, tables: dict[str, str] | None = None) -> DataFrame:
    """The findings of rules with scopes over the sheets (the first one is meant where a scope names none), one run for each sheet."""
    by_sheet: dict[str, list[Rule]] = {}
    for rule in rules:
        where, columns, rows = resolve(parse_scope(rule.scope), sheets, names or {}, tables or {})
        by_sheet.setdefault(where, []).extend(replace(rule, column=c, rows=rows, scope="") for c in columns)
    row: Column
    found = [run_rules(sheets[s].data, own, s, F.col(f"`{sheets[s].row}`")) for s, own in by_sheet.items() if own]
    if not found:
        raise RuleError("no rule has a cell to look at")
    return reduce(DataFrame.unionAll, found)
