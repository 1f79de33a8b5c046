"""The part of YAML that rule files need: nested maps and lists in blocks, flow lists and maps, quoted and plain scalars, comments.

Anchors, aliases, tags, merge keys, repeated keys, tabs before content, several documents and
multi-line scalars are refused, so that a small file cannot stand for a large document.
"""

from __future__ import annotations

import re
from typing import Any

MAX_DEPTH = 32
_KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},:?-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:\s+(.*))?$""", re.S)


class YamlError(ValueError):
    """Text that is not in this part of YAML."""


def _without_comment(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " [{,:"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] == " "):
            return line[:k]
    return line


def scalar(text: str) -> Any:
    text = text.strip()
    if not text or text in ("~", "null", "Null", "NULL"):
        return None
    if text[0] == '"':
        if len(text) < 2 or text[-1] != '"':
            raise YamlError(f"a quote is open: {text}")
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if text[0] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise YamlError(f"a quote is open: {text}")
        return text[1:-1].replace("''", "'")
    if text[0] in "[{":
        value, rest = _flow(text, 0)
        if rest.strip():
            raise YamlError(f"more than one value: {text}")
        return value
    if text[0] in "&*!|>%@`":
        raise YamlError(f"not understood: {text}")
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?", text):
        return float(text)
    return text


def _flow(text: str, depth: int) -> tuple[Any, str]:
    """The flow value that text starts with, and what follows it."""
    if depth > MAX_DEPTH:
        raise YamlError("nested too deeply")
    text = text.lstrip()
    if text[:1] in "[{" and text:
        closing, found = {"[": "]", "{": "}"}[text[0]], [] if text[0] == "[" else {}
        rest = text[1:].lstrip()
        while not rest.startswith(closing):
            if isinstance(found, dict):
                m = re.match(r"""\s*("[^"]*"|'[^']*'|[^:,\[\]{}]+?)\s*:\s""", rest + " ")
                if not m:
                    raise YamlError(f"a key is needed: {rest}")
                key, (value, rest) = scalar(m[1]), _flow(rest[m.end() :], depth + 1)
                if key in found or key == "<<":
                    raise YamlError(f"a key is given twice or merged: {key}")
                found[key] = value
            else:
                value, rest = _flow(rest, depth + 1)
                found.append(value)
            rest = rest.lstrip()
            if rest.startswith(","):
                rest = rest[1:].lstrip()
            elif not rest.startswith(closing):
                raise YamlError(f"a bracket is open: {text}")
        return found, rest[1:]
    m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}]*)""", text)
    return scalar(m[1]), text[m.end() :]


def parse_yaml(source: str) -> Any:
    """The value of the text; maps keep the order of their keys."""
    lines = []
    for number, raw in enumerate(source.splitlines(), 1):
        if raw.rstrip() in ("---",) and not lines:
            continue
        if raw.startswith(("---", "...", "%")):
            raise YamlError(f"line {number}: one document is allowed")
        bare = _without_comment(raw).rstrip()
        if not bare.strip():
            continue
        if "\t" in bare[: len(bare) - len(bare.lstrip())]:
            raise YamlError(f"line {number}: a tab stands before content")
        lines.append((len(bare) - len(bare.lstrip(" ")), bare.strip(), number))
    if not lines:
        return None
    value, at = _block(lines, 0, lines[0][0], 0)
    if at < len(lines):
        raise YamlError(f"line {lines[at][2]}: the indentation does not fit")
    return value


def _block(lines: list[tuple[int, str, int]], at: int, indent: int, depth: int) -> tuple[Any, int]:
    if depth > MAX_DEPTH:
        raise YamlError("nested too deeply")
    if lines[at][1].startswith("- ") or lines[at][1] == "-":
        out: list = []
        while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
            rest = lines[at][1][1:].lstrip()
            if rest:
                inner = indent + len(lines[at][1]) - len(rest)
                # what follows the dash is the first line of a block of its own
                lines = [*lines[:at], (inner, rest, lines[at][2]), *lines[at + 1 :]]
                if _KEY.match(rest) or rest.startswith("- "):
                    value, at = _block(lines, at, inner, depth + 1)
                else:
                    value, at = scalar(rest), at + 1
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                value, at = _block(lines, at + 1, lines[at + 1][0], depth + 1)
            else:
                value, at = None, at + 1
            out.append(value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == indent:
        m = _KEY.match(lines[at][1])
        if not m:
            if not found and depth == 0 and len(lines) == 1:
                return scalar(lines[at][1]), at + 1
            raise YamlError(f"line {lines[at][2]}: a key is needed")
        key = scalar(m[1])
        if key in found or key == "<<":
            raise YamlError(f"line {lines[at][2]}: a key is given twice or merged: {key}")
        if m[2]:
            found[key], at = scalar(m[2]), at + 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][0] == indent and lines[at + 1][1].startswith("- ")):
            found[key], at = _block(lines, at + 1, lines[at + 1][0], depth + 1)
        else:
            found[key], at = None, at + 1
    return found, at
