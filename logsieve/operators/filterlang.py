"""The filter language over stored rows: text to tokens, to a tree, to one Column.

    status:5xx AND path:/admin     terms side by side are joined by AND; | or OR; ! or NOT; ( )
    ua:*bot*  ip!=10.0.0.1  bytes>=1000  param:"q=two words"  "bare text"

Logic is two-valued: a missing value matches nothing but `!=`."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column, functions as F

from ..functions import scalars as S

# Field names by alias.
FIELDS = {
    "bytes": "bytes", "ip": "ip", "line": "line", "lineNumber": "line", "ln": "line", "method": "method", "mth": "method", "param": "param", "params": "param", "path": "path",
    "query": "query", "qs": "query", "raw": "raw", "source": "source", "src": "source", "status": "status", "st": "status", "target": "target", "time": "time", "timestamp": "time",
    "ua": "ua", "url": "target", "userAgent": "ua",
}
PRESETS = ["status:5xx", "method:POST", "ua:*bot*", "status:2xx AND path:/admin", "status:4xx", "path:/api"]
_NUMERIC = {"bytes": "bytes", "line": "lineNumber", "status": "status"}
_COLUMNS = {"ip": "ip", "method": "method", "path": "path", "raw": "raw", "source": "source", "target": "target", "time": "timestamp", "ua": "userAgent"}
_TEXT = ["ip", "timestamp", "method", "path", "target", "status", "bytes", "userAgent", "raw"]


class FilterSyntaxError(ValueError):
    pass


# ---- tokens and tree -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Word:
    text: str
    quoted: bool = False  # no part of it can be an operator word


@dataclass(frozen=True)
class Term:
    field: str | None
    operator: str
    value: str


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Both:
    operator: str
    left: object
    right: object


def tokenize(query: str) -> list:
    """Marks ( ) | ! as strings and words.  In a word, quotes join what they enclose and a backslash takes the next
    character as it is, inside quotes."""
    out, i, n = [], 0, len(query)
    while i < n:
        c = query[i]
        if c.isspace():
            i += 1
        elif c in "()|" or c == "!" and query[i + 1 : i + 2] != "=":
            out.append(c)
            i += 1
        else:
            word, quoted = [], False
            while i < n and not query[i].isspace() and query[i] not in "()|":
                if query[i] in "'\"":
                    quote, quoted = query[i], True
                    i += 1
                    while i < n and query[i] != quote:
                        if query[i] == "\\" and i + 1 < n:
                            i += 1
                        word.append(query[i])
                        i += 1
                    if i >= n:
                        raise FilterSyntaxError("unterminated quote")
                    i += 1
                elif query[i] == "\\" and i + 1 < n:
                    word.append(query[i + 1])
                    i += 2
                else:
                    word.append(query[i])
                    i += 1
            out.append(Word("".join(word), quoted))
    return out


def _term(text: str) -> Term:
    for op in ("!=", ">=", "<=", ":", "=", ">", "<"):
        at = text.find(op)
        if at <= 0:
            continue
        field = FIELDS.get(text[:at]) or FIELDS.get(text[:at].lower())
        if field is None:
            continue
        if not text[at + len(op) :]:
            raise FilterSyntaxError(f'missing value for "{text[:at]}"')
        return Term(field, op, text[at + len(op) :])
    return Term(None, ":", text)


class _Parser:
    def __init__(self, tokens: list):
        self.tokens, self.i = tokens, 0

    def peek(self):
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def is_word(self, *names: str) -> bool:
        t = self.peek()
        return isinstance(t, Word) and not t.quoted and t.text.upper() in names

    def parse(self):
        tree = self.either()
        if self.peek() is not None:
            raise FilterSyntaxError(f"unexpected {self.peek()}")
        return tree

    def either(self):
        left = self.every()
        while self.peek() == "|" or self.is_word("OR"):
            self.i += 1
            left = Both("or", left, self.every())
        return left

    def every(self):
        left = self.negated()
        while self.peek() is not None and self.peek() not in ("|", ")") and not self.is_word("OR"):
            if self.is_word("AND"):
                self.i += 1
            left = Both("and", left, self.negated())
        return left

    def negated(self):
        if self.peek() == "!" or self.is_word("NOT"):
            self.i += 1
            return Not(self.negated())
        return self.primary()

    def primary(self):
        t = self.peek()
        if t is None:
            raise FilterSyntaxError("expression ends too early")
        if t == "(":
            self.i += 1
            inner = self.either()
            if self.peek() != ")":
                raise FilterSyntaxError("missing )")
            self.i += 1
            return inner
        if not isinstance(t, Word) or self.is_word("AND", "OR"):
            raise FilterSyntaxError(f"unexpected {t.text if isinstance(t, Word) else t}")
        self.i += 1
        return _term(t.text)


def parse_filter(query: str):
    """The tree, None for a blank query."""
    return _Parser(tokenize(query)).parse() if query.strip() else None


def validate_filter(query: str) -> tuple[bool, str | None]:
    try:
        parse_filter(query)
    except FilterSyntaxError as e:
        return False, str(e)
    return True, None


# ---- compilation -----------------------------------------------------------------------------------------------


def decoded(text: str, plus: bool = False) -> str:
    """%XX decoded; the text itself if that fails."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return text
    try:
        return unquote_to_bytes(text.replace("+", " ") if plus else text).decode("utf-8")
    except UnicodeDecodeError:
        return text


def _pattern(actual: Column, expected: str, contains: bool, plus: bool = False) -> Column:
    value, actual = decoded(expected, plus).lower(), F.lower(actual)
    if "*" in value:
        return actual.rlike(r"(?i)\A" + ".*".join(re.escape(x) for x in value.split("*")) + r"\z")
    return F.contains(actual, F.lit(value)) if contains else actual == value


def _number(text: str) -> float | None:
    text = text.strip()
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return float(int(text, 16))
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", text):
        return float(text)
    return 0.0 if text == "" else None


def _numeric(x: Column, op: str, value: str) -> Column:
    number = _number(value)
    if op in (":", "=", "!=") and re.fullmatch(r"(?i)[1-5]xx", value):
        hit = F.floor(x / 100) == int(value[0])
    elif number is None:
        hit = _pattern(x.cast("string"), value, op == ":")
    else:
        hit = {">": x > number, ">=": x >= number, "<": x < number, "<=": x <= number}.get(op)
        if hit is None:
            hit = x == number
    if op == "!=":
        return x.isNull() | ~F.coalesce(hit, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def _param(op: str, value: str) -> Column:
    name, mark, wanted = value.partition("=")
    params = S.params_of(F.col("target"))
    if not mark:
        hit = F.exists(params, lambda p: _pattern(p["name"], value, False))
    else:
        named = (lambda p: F.lit(True)) if name == "*" else (lambda p: _pattern(p["name"], name, False))
        hit = F.exists(params, lambda p: named(p) & _pattern(p["value"], wanted, op != "!=", plus=True))
    return ~hit if op == "!=" else hit


def _compiled(tree) -> Column:
    if isinstance(tree, Not):
        return ~_compiled(tree.inner)
    if isinstance(tree, Both):
        left, right = _compiled(tree.left), _compiled(tree.right)
        return left & right if tree.operator == "and" else left | right
    if tree.field is None:
        text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _TEXT])
        return F.coalesce(_pattern(text, tree.value, True), F.lit(False))
    if tree.field == "param":
        return F.coalesce(_param(tree.operator, tree.value), F.lit(False))
    if tree.field in _NUMERIC:
        return _numeric(F.col(_NUMERIC[tree.field]), tree.operator, tree.value)
    actual = S.query_of(F.col("target")) if tree.field == "query" else F.coalesce(F.col(_COLUMNS[tree.field]), F.lit(""))
    hit = F.coalesce(_pattern(actual, tree.value, tree.operator == ":"), F.lit(False))
    return ~hit if tree.operator == "!=" else hit


def compile_filter(query: str) -> Column:
    """A Column over the stored rows (`parse.access_log`); a blank query takes all rows."""
    tree = parse_filter(query)
    return F.lit(True) if tree is None else _compiled(tree)


def top_item_filter(panel: str, value: str) -> str:
    """The filter that a top value leads to."""
    shown = '"' + re.sub(r'(["\\])', r"\\\1", value) + '"'
    return {"ips": "ip=", "paths": "path=", "userAgents": "ua:", "statuses": "status=", "params": "param=", "paramValues": "param:"}[panel] + shown
