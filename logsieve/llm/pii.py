"""Personal data in texts: base patterns, and offset-preserving deobfuscation.

The base patterns run on the text itself.  The method then runs a transducer over texts that hold a disguise: homoglyphs
become ASCII, runs of spelled digits become digits, and "at" / "dot" in disguise become "@" / "."; every output character
carries the source span it came from.  Each step is one pass over the text.  The same patterns run on the transducer's output, and what they find is mapped
back to source characters.  A found span is added if it covers a disguise and overlaps no base span of its kind.

Base: leftmost non-overlapping per kind; a match that fails its check is dropped, without retries.

Defined results: a null text counts as empty; offsets count code points, ends are exclusive; each row is handled alone,
so repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words
from .endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
#: IP, tried only where a run of digits begins: inside a run no start does better.
_IP_RUN = re.compile(r"(?<![0-9])" + IP.pattern)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str):
    """Spans of EMAIL.finditer(text) in linear time.  All starts before an @ share what follows it, so the first start
    that is free, back to the last @ or match, decides."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of KINDS."""
    out: list[list[tuple[int, int]]] = [list(_emails(text)), [], [], []]
    if not _DIGIT.search(text):
        return out
    for m in _IP_RUN.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out[3].append(m.span())
    return out


# ---- transducer ------------------------------------------------------------------------------------------------

# Characters that look like an ASCII letter.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without width are left out.
_NOTHING = "​‌‍⁠﻿­"


def _lookalikes() -> dict[str, str]:
    table = dict(_LOOKALIKES)
    for i in range(0x21, 0x7F):  # full width forms
        table[chr(i + 0xFEE0)] = chr(i)
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other digits
        for d in range(10):
            table[chr(zero + d)] = str(d)
    for first in (0x1D400, 0x1D434, 0x1D468, 0x1D4D0, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670):  # mathematical letters
        for k in range(52):
            table[chr(first + k)] = chr(65 + k) if k < 26 else chr(71 + k)
    for k in range(26):  # circled letters
        table[chr(0x24B6 + k)], table[chr(0x24D0 + k)] = chr(65 + k), chr(97 + k)
    for d in range(1, 10):  # circled digits
        table[chr(0x245F + d)] = str(d)
    table["⓪"] = "0"
    table.update(dict.fromkeys(_NOTHING, ""))
    return table


LOOKALIKES = _lookalikes()
# Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: So many spelled digits in a row count as digits.
SPELLED_RUN = 3

_GLYPH = re.compile("[" + "".join(re.escape(c) for c in LOOKALIKES) + "]")
_ONE = "(?:" + "|".join(SPELLED) + ")"
_SPELLED = re.compile(rf"(?<![^\W_]){_ONE}(?:[\s,.-]{{1,3}}{_ONE}){{{SPELLED_RUN - 1},}}(?![^\W_])", re.I)
#: Bare words that may be a disguise: only texts with one of these, a bracketed one or a look-alike go to the scanner.
_BARE_DOT = re.compile(r"\sdot\s", re.I)
_BARE_AT = re.compile(r"\sat\s+[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.I)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.I)
#: Tokens of the address scanner: a run of characters of a name, a run of blanks, or one other character.
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]+|\s+|[^A-Za-z0-9._%+\s-]")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_OPEN, _CLOSE = "[({<", "])}>"
_SAID = {"at": "@", "@": "@", "dot": ".", ".": "."}


class _Tape:
    """A text and, for each of its characters, the source span it came from and whether a disguise made it."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | range = range(len(text))
        self.ends: list[int] | range = range(1, len(text) + 1)
        self.changed = bytearray(len(text))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, apart) by strings; each new character stands for its whole span."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            changed += self.changed[at:a]
            text.append(new)
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            changed += b"\1" * len(new)
            at = b
        text.append(self.text[at:])
        starts += self.starts[at:]
        ends += self.ends[at:]
        changed += self.changed[at:]
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def _spelled_edits(text: str):
    """Each digit word becomes its digit; what stands between two of them goes."""
    out = []
    for m in _SPELLED.finditer(text):
        found = list(re.finditer(_ONE, m[0], re.I))
        for k, w in enumerate(found):
            stop = found[k + 1].start() if k + 1 < len(found) else w.end()
            out.append((m.start() + w.start(), m.start() + stop, SPELLED[w[0].lower()]))
    return out


def _marks(text: str) -> list[tuple[str, int, int, bool]]:
    """One pass over the tokens: (kind, start, end, bracketed) with the kinds n (a name), @ and . (a disguise, with the
    blanks around it), = (a real @) and x (anything else)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    out, k, n = [], 0, len(tokens)
    blank = lambda i: i < n and text[tokens[i][0]].isspace()
    while k < n:
        start, end = tokens[k]
        i = k + blank(k)
        # [ at ], with or without blanks around and inside
        if i < n and text[tokens[i][0]] in _OPEN:
            w = i + 1 + blank(i + 1)
            said = _SAID.get(text[slice(*tokens[w])].lower()) if w < n else None
            c = w + 1 + blank(w + 1)
            if said and c < n and text[tokens[c][0]] in _CLOSE:
                c += blank(c + 1)
                out.append((said, start, tokens[c][1], True))
                k = c + 1
                continue
        # blank at blank
        if i > k and blank(i + 1) and i < n:
            said = text[slice(*tokens[i])].lower()
            if said in ("at", "dot"):
                out.append((_SAID[said], start, tokens[i + 1][1], False))
                k = i + 2
                continue
        first = text[start]
        kind = "=" if first == "@" else "x" if end - start == 1 and not (first.isalnum() and first.isascii() or first in "._%+-") or first.isspace() else "n"
        out.append((kind, start, end, False))
        k += 1
    return out


def _address_edits(text: str):
    """What stands for "@" and "." in addresses and numbers in disguise.  Every mark is looked at from the "at" on its left
    and from the one on its right, and once in a chain of dots, so time grows with the text."""
    marks, out = _marks(text), []
    kind = [m[0] for m in marks]
    free = 0  # marks before this one belong to an address
    for at in [i for i, k in enumerate(kind) if k in "@="]:
        if at < free + 1 or kind[at - 1] != "n":
            continue
        first = at - 1
        while first - 2 >= free and kind[first - 1] == "." and kind[first - 2] == "n":
            first -= 2
        # domain: labels with real dots, and disguised dots between them
        last, labels, ending = at, 0, ""
        while last + 1 < len(marks) and kind[last + 1] == "n" and (last == at or kind[last] == "."):
            _, a, b, _ = marks[last + 1]
            m = _LABELS.match(text, a, b)
            if not m:
                break
            parts = m[0].split(".")
            labels, ending, last = labels + len(parts), parts[-1], last + 1
            if m.end() < b or last + 1 >= len(marks) or kind[last + 1] != ".":
                break
            last += 1
        if kind[last] == "." and last != at:
            last -= 1
        if labels < 2:
            continue
        inside = [m for m in marks[first : last + 1] if m[0] in "@."]
        bracket, plain = any(m[3] for m in inside), any(not m[3] for m in inside)
        # bare words are taken before a top-level domain: "name at host dot com", "name at host.com"; one in brackets is enough
        if bracket or plain and ending.lower() in ENDINGS:
            out += [(a, b, k) for k, a, b, _ in inside]
            free = last + 1
    taken = {a for a, _, _ in out}
    # chains of names and disguised dots that spell four numbers
    k = 0
    while k < len(marks):
        if kind[k] == "n" and k + 1 < len(marks) and kind[k + 1] == "." and marks[k + 1][1] not in taken:
            pieces, dots, size = [], [], 0
            while True:
                _, a, b, _ = marks[k]
                pieces.append(text[a:b])
                size += b - a
                if k + 2 < len(marks) and kind[k + 1] == "." and kind[k + 2] == "n" and marks[k + 1][1] not in taken:
                    pieces.append(".")
                    dots.append((size, marks[k + 1]))
                    size += 1
                    k += 2
                else:
                    break
            spans = [m.span() for m in _QUAD.finditer("".join(pieces))]
            at = 0
            for place, (_, a, b, _) in dots:
                while at < len(spans) and spans[at][1] <= place:
                    at += 1
                if at < len(spans) and spans[at][0] <= place:
                    out.append((a, b, "."))
        k += 1
    return sorted(out)


def disguised(text: str) -> bool:
    """Whether the transducer can change anything; cheap tests first."""
    if not text.isascii() and _has_glyph(text):
        return True
    low = text.lower()
    if "dot" in low and _BARE_DOT.search(low) or "at" in low and _BARE_AT.search(low):
        return True
    if ("(" in text or "[" in text or "{" in text or "<" in text) and _BRACKET.search(text):
        return True
    for mark in "-,.":
        low = low.replace(mark, " ")
    return not _SPELLED_WORDS.isdisjoint(low.split()) and bool(_SPELLED.search(text))


_SPELLED_WORDS = frozenset(SPELLED)
_LATIN_GLYPHS = [c for c in LOOKALIKES if ord(c) < 256]


def _has_glyph(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_GLYPH.search(text))
    return any(c in text for c in _LATIN_GLYPHS)


def method_spans(text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """base and the spans that only the transducer's output shows."""
    if not disguised(text):
        return base
    tape = _Tape(text)
    if not text.isascii():
        tape.replace([(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _GLYPH.finditer(text)])
    tape.replace(_spelled_edits(tape.text))
    tape.replace(_address_edits(tape.text))
    if not any(tape.changed) and len(tape.text) == len(text):
        return base
    out = []
    for had, found in zip(base, base_spans(tape.text)):
        spans = list(had)
        for a, b in found:
            s, e = tape.starts[a], tape.ends[b - 1]
            if (any(tape.changed[a:b]) or e - s != b - a) and not any(s < y and e > x for x, y in had):
                spans.append((s, e))
        out.append(sorted(spans))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans) for a, b in own)


_EMPTY = hashlib.sha256(b"").hexdigest()


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""

    def scan(batches):
        for batch in batches:
            for first, texts in words.parts(batch.column(1), 4 << 20):
                counts, shas, alls = [], [], []
                for text in texts.to_pylist():
                    base = base_spans(text or "")
                    spans = method_spans(text or "", base)
                    counts.append([len(x) for x in base])
                    line = _joined(base)
                    shas.append(hashlib.sha256(line.encode()).hexdigest() if line else _EMPTY)
                    alls.append(line if spans is base else _joined(spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(shas), pa.array(alls, pa.string())],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """text with each span replaced by its kind in brackets."""
    every = sorted((a, b, k) for k, own in zip(KINDS, spans) for a, b in own)
    out, at = [], 0
    for a, b, k in every:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])
