"""A small scanner for languages with braces: words, strings, numbers and marks, without comments.

It knows the literals and comments of Java, TypeScript and Go, so braces and names inside them are not seen. Readers of
declarations work on its tokens and on ``Cursor``, which pairs brackets.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, string, number or mark
    text: str  # of a string what is between its quotes
    line: int
    start: int
    end: int


_PIECE = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<block>\"{3}.*?(?:\"{3}|\Z))
    |(?P<raw>`(?:\\.|[^`\\])*(?:`|\Z))
    |(?P<quoted>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))
    |(?P<word>[^\W\d]\w*|\$\w+)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|:=|\.\.\.|.)""",
    re.VERBOSE | re.DOTALL,
)
_GO_RAW = re.compile(r"`[^`]*(?:`|\Z)")
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def scan(text: str, language: str) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = _PIECE.match(text, at)
        kind = m.lastgroup
        if kind == "raw" and language == "go":
            m = _GO_RAW.match(text, at)
        if kind == "block" and language != "java":  # elsewhere an empty string and the next one
            kind, end = "quoted", at + 2
        else:
            end = m.end()
        piece = text[at:end]
        if kind in ("word", "number", "mark"):
            out.append(Token(kind, piece, line, at, end))
        elif kind in ("block", "raw", "quoted"):
            width = 3 if kind == "block" else 1
            inner = piece[width:-width] if len(piece) >= 2 * width and piece.endswith(piece[:width]) else piece[width:]
            out.append(Token("string", inner, line, at, end))
        line += piece.count("\n")
        at = end
    return out


class Cursor:
    """Tokens with the place of each bracket's partner."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.tokens = text, scan(text, language)
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _CLOSING:
                open_.append(i)
            elif t.text in ")]}":
                while open_ and _CLOSING[self.tokens[open_[-1]].text] != t.text:
                    open_.pop()  # never closed
                if open_:
                    start = open_.pop()
                    self.partner[start], self.partner[i] = i, start

    def __len__(self) -> int:
        return len(self.tokens)

    def is_mark(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "mark" and self.tokens[i].text in texts

    def is_word(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word" and (not texts or self.tokens[i].text in texts)

    def after(self, i: int) -> int:
        """The place behind the bracket at ``i``; the end if it is never closed."""
        return self.partner.get(i, len(self.tokens) - 1) + 1

    def source(self, first: int, end: int) -> str:
        """The text of the tokens from ``first`` up to ``end``, on one line."""
        if first >= end:
            return ""
        return " ".join(self.text[self.tokens[first].start : self.tokens[end - 1].end].split())

    def dotted(self, i: int) -> tuple[str, int]:
        """Words joined by dots from place ``i`` on (a last ``*`` too), and the place behind them."""
        parts = []
        while self.is_word(i) or (parts and self.is_mark(i, "*")):
            parts.append(self.tokens[i].text)
            i += 1
            if not self.is_mark(i, "."):
                break
            i += 1
        return ".".join(parts), i

    def behind_angles(self, i: int) -> int:
        """The place behind type arguments that start at ``i``, or ``i``."""
        if not self.is_mark(i, "<"):
            return i
        depth = 0
        for k in range(i, len(self.tokens)):
            if self.is_mark(k, "<"):
                depth += 1
            elif self.is_mark(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_mark(k, ";", "{", "}", "=>") and not self.is_mark(k - 1, "<", ",", ":"):
                return i
        return i

    def parts(self, open_: int) -> list[tuple[int, int]]:
        """What stands between the commas of a bracket, as places; commas of inner brackets and type arguments don't count."""
        out, first, i = [], open_ + 1, open_ + 1
        end = self.partner.get(open_, len(self.tokens))
        while i < end:
            if self.is_mark(i, "(", "[", "{"):
                i = min(self.after(i), end)
            elif self.is_mark(i, "<") and self.behind_angles(i) > i:
                i = self.behind_angles(i)
            else:
                if self.is_mark(i, ","):
                    out.append((first, i))
                    first = i + 1
                i += 1
        return [*out, (first, end)] if first < end or out else []
