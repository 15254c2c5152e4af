"""A scanner of lines for the numbers that they state (T29). Plain Python on one line; `numbers` runs it over columns.

A line is cut into words, runs of digits, raised digits, gaps and single signs. At each place a few small readers try, in
order, what stands there: a mark, a date, a place in a document, a standard, a work with its year, a power of ten, an index;
each says where it ends and what it gives. What none of them takes and is a run of digits is a number.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

# Words before a place's number, months, and bodies whose standards have numbers.
PLACES = frozenset("p pp pág págs tab tabela table fig figura figure eq equação equation seção section cap capítulo chapter item itens".split())
MONTHS = frozenset("janeiro fevereiro março marco abril maio junho julho agosto setembro outubro novembro dezembro".split())
BODIES = frozenset("ieee iec iso nbr abnt".split())
DASHES, RAISED = "-−–", str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_PIECE = re.compile(r"(?P<up>[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)|(?P<num>[0-9](?:[0-9.,]*[0-9])?)|(?P<word>[^\W\d]\w*)|(?P<gap>\s+)|(?P<sign>.)", re.S)
_CUT = re.compile(re.sub(r"\?P<\w+>", "?:", _PIECE.pattern), re.S)
_MARK = re.compile(r"K[0-9A-Za-z]+|[RW][0-9]+")
_DIGIT = re.compile("[0-9]")
#: What a reader may begin at besides a run of digits and a word that ends in "_".
_STARTS = PLACES | MONTHS | BODIES | frozenset(("mil", "al", "[", "(", ",", "^", "_"))


class Piece(NamedTuple):
    kind: str
    text: str
    lower: str


@functools.lru_cache(maxsize=1 << 14)
def _piece(text: str) -> Piece:
    """What a piece is, from its own text; most pieces of a column recur."""
    return Piece(_PIECE.match(text).lastgroup, text, text.lower())


END = Piece("end", "", "")
#: Readers look a few pieces ahead and two back (which an index below zero finds at the end of the list).
_BEYOND = [END] * 16


class Line:
    """The pieces of a line, and the finds: (kind, text) with kinds number, year (of a date) and day (d/m of a date)."""

    def __init__(self, text: str, inside_only: bool, days: frozenset[str]) -> None:
        # Compatibility characters of words stay words: the raised digits come first in the pattern.
        self.pieces = [*map(_piece, _CUT.findall(text))]
        self.n = len(self.pieces)
        self.pieces += _BEYOND
        self.inside_only, self.days, self.depth = inside_only, days, 0
        self.found: list[tuple[str, str]] = []

    def at(self, i: int) -> Piece:
        return self.pieces[i]

    def past_gap(self, i: int) -> int:
        return i + 1 if self.pieces[i].kind == "gap" else i

    def is_(self, i: int, *texts: str) -> bool:
        return self.pieces[i].lower in texts

    def digits(self, i: int, least: int, most: int) -> bool:
        p = self.pieces[i]
        return p.kind == "num" and least <= len(p.text) <= most and p.text.isdigit()

    def year(self, i: int) -> bool:
        return self.digits(i, 4, 4) and self.at(i).text[:2] in ("19", "20")

    # Each reader returns the place behind what it has taken, or none.

    def opener(self) -> int:
        """The number or bullet that opens a heading's or list's line."""
        i = self.past_gap(0)
        while self.is_(i, "#"):
            i += 1
        i = self.past_gap(i)
        if self.at(i).kind == "num" and self.is_(i + 1, ".", ")") and self.at(i + 2).kind == "gap":
            return i + 3
        return i + 2 if self.is_(i, "-", "*", "+") and self.at(i + 1).kind == "gap" else 0

    def brackets(self, i: int) -> int | None:
        """A mark, or the numbers of references: [R1], [72], [73, 74-76]."""
        if not self.is_(i, "["):
            return None
        j = i + 1
        while self.at(j).kind != "end" and not self.is_(j, "]", "["):
            j += 1
        if not self.is_(j, "]"):
            return None
        inside = "".join(p.text for p in self.pieces[i + 1 : j])
        parts = re.split(r"[,;–-]", inside)
        numbered = all(p.strip().isdigit() and len(p.strip()) <= 3 for p in parts)
        return j + 1 if numbered or _MARK.fullmatch(inside) else None

    def date(self, i: int) -> int | None:
        day, month, year = self.at(i).text, self.at(i + 2).text, self.at(i + 4).text
        before, glued = self.at(i - 1).text, self.at(i + 5).text
        if self.is_(i + 1, "/") and self.digits(i, 1, 2) and self.digits(i + 2, 1, 2) and before != "/":
            if self.is_(i + 3, "/") and self.digits(i + 4, 2, 4) and glued != "/":
                self.found += [("year", year), ("day", f"{day}/{month}")]
                return i + 5
            if f"{day}/{month}" in self.days and not self.is_(i + 3, "/"):
                return i + 3
        if self.digits(i, 4, 4) and self.is_(i + 1, "-") and self.digits(i + 2, 2, 2) and self.is_(i + 3, "-") and self.digits(i + 4, 2, 2):
            self.found += [("year", day), ("day", f"{year}/{month}")]
            return i + 5
        return self.date_in_words(i)

    def date_in_words(self, i: int) -> int | None:
        """27 de setembro de 2026, setembro de 2026."""
        j = i
        if self.digits(j, 1, 2):
            j += 1 + self.is_(j + 1, "º")
            if not (self.at(j).kind == "gap" and self.is_(j + 1, "de") and self.at(j + 2).kind == "gap"):
                return None
            j += 3
        if self.at(j).lower not in MONTHS:
            return None
        if self.at(j + 1).kind == "gap" and self.is_(j + 2, "de") and self.at(j + 3).kind == "gap" and self.digits(j + 4, 4, 4):
            return j + 5
        return j + 1 if j > i else None

    def numbering(self, i: int) -> int | None:
        """Numbers that hang together by dashes or points, or a Roman one."""
        if self.at(i).kind == "word" and set(self.at(i).text.upper()) <= set("IVXLC"):
            return i + 1
        if self.at(i).kind != "num":
            return None
        i += 1
        while self.at(i).text in (*DASHES, ".", ":") and self.at(i + 1).kind == "num":
            i += 2
        return i

    def place(self, i: int) -> int | None:
        name = self.at(i).lower
        if name not in PLACES or (name == "itens" and self.at(i - 1).kind == "gap" and self.at(i - 2).kind == "num"):
            return None
        return self.numbering(self.past_gap(i + 1 + self.is_(i + 1, ".")))

    def standard(self, i: int) -> int | None:
        if self.is_(i, "mil") and self.is_(i + 1, "-") and self.is_(i + 2, "std") and self.is_(i + 3, "-") and self.at(i + 4).kind == "num":
            return i + 5 + (self.at(i + 5).kind == "word")
        if self.at(i).lower not in BODIES:
            return None
        j = self.past_gap(i + 1)
        if self.is_(j, "std"):
            j = self.past_gap(j + 1)
        return self.numbering(self.past_gap(j + 1) if self.is_(j, ".") else j)

    def lettered(self, i: int) -> int:
        """Behind a year and the letter that may hang on it."""
        return i + 1 + (self.at(i + 1).kind == "word" and len(self.at(i + 1).text) == 1)

    def work(self, i: int) -> int | None:
        """(2018), (2017, p. 2), et al., 2020 and Name, 2001: the year of a work."""
        if self.is_(i, "(") and self.year(i + 1):
            j = self.lettered(i + 1)
            if self.is_(j, ")") or (self.is_(j, ",") and self.is_(self.past_gap(j + 1), "p", "pp")):
                return j
        if self.is_(i, "al") and self.is_(i - 2, "et"):
            j = i + 1
            while self.at(j).kind == "gap" or self.is_(j, ".", ",", "("):
                j += 1
            return self.lettered(j) if self.year(j) else None
        if self.is_(i, ",") and self.at(i + 1).kind == "gap" and self.year(i + 2) and (self.depth or not self.inside_only):
            name = i - 1 - self.is_(i - 1, ".")
            end = self.lettered(i + 2)
            closes = self.at(self.past_gap(end))
            if self.at(name).kind == "word" and self.at(name).text[0].isupper() and (closes.kind == "end" or closes.text in ")[;],(*_"):
                return end
        return None

    def power(self, i: int, ten: str = "10") -> tuple[int, str] | None:
        """Behind 10 the exponent: ^-6, ^{-6}, raised digits."""
        if not self.is_(i, ten):
            return None
        j = self.past_gap(i + 1)
        if self.at(j).kind == "up":
            return j + 1, self.at(j).text.translate(RAISED)
        if not self.is_(j, "^"):
            return None
        j = self.past_gap(j + 1)
        brace = self.is_(j, "{")
        j = self.past_gap(j + brace)
        sign = self.at(j).text if self.at(j).text in (*DASHES, "+") else ""
        j += bool(sign)
        if not self.digits(j, 1, 9):
            return None
        exponent, j = sign.replace("−", "-") + self.at(j).text, j + 1
        if brace:
            j = self.past_gap(j)
            j += self.is_(j, "}")
        return j, exponent

    def index(self, i: int) -> int | None:
        """What is raised or lowered behind a symbol: x_{1}, e^{-2t}, x_1."""
        lowered = self.at(i).kind == "word" and self.at(i).text.endswith("_") and len(self.at(i).text) > 1
        behind = self.at(i - 1)
        raised = self.is_(i, "^", "_") and (behind.kind == "word" or behind.text in ("}", ")"))
        if not lowered and not raised:
            return None
        j = i + 1
        if self.is_(j, "{"):
            while self.at(j).kind != "end" and not self.is_(j, "}"):
                j += 1
            return j + 1
        j += self.at(j).text in (*DASHES, "+")
        return j + 1 if self.at(j).kind in ("num", "word") else None

    def number(self, i: int) -> int:
        """A run of digits with its sign and exponent."""
        text, j = self.at(i).text, i + 1
        while self.at(j).text == "{" and [p.text for p in self.pieces[j + 1 : j + 3]] == [",", "}"] and self.at(j + 3).kind == "num":
            text, j = f"{text},{self.at(j + 3).text}", j + 4
        tail = self.at(j)
        if tail.kind == "word" and re.fullmatch(r"[eE][0-9]*", tail.text):
            sign = self.at(j + 1).text if self.at(j + 1).text in ("-", "−", "+") else ""
            if len(tail.text) > 1:
                text, j = text + tail.text, j + 1
            elif self.digits(j + 1 + bool(sign), 1, 9):
                text, j = f"{text}{tail.text}{sign}{self.at(j + 1 + bool(sign)).text}", j + 2 + bool(sign)
        times = self.past_gap(j)
        times += self.is_(times, "\\") and self.is_(times + 1, "times", "cdot")
        signs = self.is_(times, "×", "·", "*", "x", "times", "cdot")
        if scale := self.power(self.past_gap(times + 1)) if signs else self.power(times, "x10"):
            text, j = f"{text}e{scale[1]}", scale[0]
        before, sign = self.at(i - 1), self.at(i - 1).text in tuple(DASHES)
        if sign and self.at(i - 2).kind not in ("num", "word", "up") and self.at(i - 2).text not in ("%", ")", "°", ".", ","):
            text = before.text + text
        if not (before.text in (".", ",") or (sign and self.at(i - 2).text in (".", ","))):
            self.found.append(("number", text))
        return j

    def scan(self) -> list[tuple[str, str]]:
        i = self.opener()
        while i < self.n:
            kind, text, lower = self.pieces[i]
            # Most pieces are gaps and words that no reader begins at.
            if kind == "gap" or (kind != "num" and text[-1] != "_" and lower not in _STARTS):
                if text == ")":
                    self.depth = max(0, self.depth - 1)
                i += 1
                continue
            for reader in (self.date,) if kind == "num" else (self.brackets, self.date, self.place, self.standard, self.work, self.index):
                end = reader(i)
                if end is not None:
                    break
            else:
                scale = self.power(i)
                end = scale[0] if scale else self.number(i) if self.at(i).kind == "num" else i + 1
            # A work's year in parentheses leaves its closing one to be seen, and its opening one was taken.
            for p in self.pieces[i:end] if kind != "num" or end > i + 1 else ():
                self.depth = max(0, self.depth + (p.text == "(") - (p.text == ")"))
            i = end
        return self.found


#: Lines up to so many characters are remembered: short ones (list items, closing words) recur in a column.
_SHORT = 160


@functools.lru_cache(maxsize=1 << 14)
def _short(text: str, inside_only: bool, days: frozenset[str]) -> tuple[tuple[str, str], ...]:
    return tuple(Line(text, inside_only, days).scan())


def scan(text: str | None, inside_only: bool = False, days: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """The finds of one line. inside_only: "Name, 2001" is a work only within parentheses. days: d/m that are dates."""
    if not text or not _DIGIT.search(text):
        return []
    if len(text) <= _SHORT:
        return [*_short(text, inside_only, frozenset(days))]
    return Line(text, inside_only, frozenset(days)).scan()
