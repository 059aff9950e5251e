"""Tokens of source text, their places and matched brackets; a table for each language says what its strings, comments and holes in strings look like."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {b: a for a, b in OPEN.items()}
#: Marks for the ends of a string that holds code, which count as brackets around it.
BEGIN, END = "<text>", "</text>"
OPEN[BEGIN] = END
CLOSE[END] = BEGIN
MAX_ARG = 400


@dataclass(frozen=True)
class Lexicon:
    """skip, text, name, mark: patterns of what is left out, of strings without holes, of names and of marks of several characters. holes: for what begins a string that may hold code, (the string's own text, its end, what begins a hole). value_next: words after which a value begins; with pattern, a slash there begins a regular expression."""

    skip: str
    text: str
    name: str
    mark: str
    holes: tuple[tuple[str, str, str, str], ...] = ()
    value_next: frozenset[str] = frozenset()
    pattern: str = ""
    before: str = ""

    def compiled(self) -> tuple[re.Pattern, list, re.Pattern | None]:
        token = re.compile(f"(?P<skip>{self.skip})|(?P<hole>{'|'.join(re.escape(h[0]) for h in self.holes) or '(?!)'})|(?P<text>{self.text})|(?P<name>{self.name})|(?P<number>\\d[\\w.]*)|(?P<mark>{self.mark}|\\S)", re.DOTALL)
        return token, [(a, re.compile(own, re.DOTALL), b, h) for a, own, b, h in self.holes], re.compile(self.pattern, re.DOTALL) if self.pattern else None


class Tokens:
    """The tokens of one file, and rows read off them (see operators.extract)."""

    def __init__(self, file: str, text: str, lexicon: Lexicon, ready: tuple):
        self.file, self.text, self.lexicon, self.rows = file, text, lexicon, []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.at: list[int] = []
        self._read(*ready)
        self.partner, self.broken = self._match()

    def _put(self, kind: str, tok: str, at: int) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.at.append(at)

    def _read(self, token: re.Pattern, holes: list, pattern: re.Pattern | None) -> None:
        """Tokens in order. A string that may hold code is a mode: its text is read up to a hole, where the code's own tokens follow; the hole's closing brace, found by counting braces in it, leads back into the string."""
        text, n, at = self.text, len(self.text), 0
        if self.lexicon.before:
            m = re.compile(self.lexicon.before, re.DOTALL).match(text)
            at = m.end() if m else 0
        modes: list[list] = []  # (hole's string kind, braces open in the hole)

        def inside(kind: tuple, begin: int, at: int, fresh: bool) -> int:
            """Read the text of a string that began at `begin` from `at` on; the place behind it or behind a hole's begin."""
            _, own, end, hole = kind
            at = own.match(text, at).end()
            if text.startswith(hole, at):
                if fresh:
                    self._put("mark", BEGIN, begin)
                self._put("mark", "{", at + len(hole) - 1)
                modes.append([kind, 0])
                return at + len(hole)
            to = min(at + len(end), n)
            if not fresh:
                self._put("mark", END, max(at, to - 1) if at < n else n - 1)
            elif at < n:
                self._put("text", text[begin:to], begin)
            else:
                self._put("mark", BEGIN, begin)  # without an end
            return to

        while at < n:
            before = self.tok[-1] if self.tok else ""
            c = text[at]
            if c == "}" and modes and not modes[-1][1]:
                self._put("mark", "}", at)
                at = inside(modes.pop()[0], at, at + 1, False)
                continue
            if c == "/" and pattern and before != "<":
                ends = bool(self.tok) and (self.kind[-1] in ("text", "number") or self.kind[-1] == "name" and before not in self.lexicon.value_next or before in (")", "]", "}", END))
                if not ends and (m := pattern.match(text, at)):
                    self._put("text", m[0], at)
                    at = m.end()
                    continue
            m = token.match(text, at)
            kind = m.lastgroup
            if kind == "hole":
                at = inside(next(h for h in holes if h[0] == m[0]), at, m.end(), True)
                continue
            if modes and kind == "mark" and m[0] in "{}":
                modes[-1][1] += 1 if m[0] == "{" else -1
            if kind != "skip":
                self._put(kind, m[0], at)
            at = m.end()

    def _match(self) -> tuple[dict[int, int], list[int]]:
        """Places of matching brackets, both ways, and brackets without a partner."""
        out: dict[int, int] = {}
        open_: list[int] = []
        broken = []
        for i, x in enumerate(self.tok):
            if self.kind[i] != "mark":
                continue
            if x in OPEN:
                open_.append(i)
            elif x in CLOSE:
                if open_ and self.tok[open_[-1]] == CLOSE[x]:
                    out[open_[-1]] = i
                    out[i] = open_.pop()
                else:
                    broken.append(i)
        return out, broken + open_

    def is_mark(self, i: int, *marks: str) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "mark" and self.tok[i] in marks

    def word(self, i: int, *words: str) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "name" and (not words or self.tok[i] in words)

    def place(self, i: int) -> tuple[int, int]:
        """(line from 1, column from 0) of a token."""
        line = bisect_right(self.lines, self.at[i])
        return line, self.at[i] - self.lines[line - 1]

    def add(self, what: str, a=None, b=None, c=None, i: int = 0, end: int | None = None, named: int | None = None) -> None:
        l2, col = self.place(named) if named is not None else (None, -1)
        self.rows.append((what, self.file, len(self.rows), a, b, c, self.place(i)[0], self.place(end)[0] if end is not None else None, l2, col))

    def between(self, i: int, j: int) -> str:
        """The source between two tokens."""
        return self.text[self.at[i] + len(self.tok[i]) : self.at[j]].strip()

    def new_line(self, i: int) -> bool:
        """Token i is the first one of its line."""
        return i == 0 or self.place(i)[0] > self.place(i - 1)[0]
