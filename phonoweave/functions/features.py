"""Symbols, ternary feature vectors, implications and diacritics. Plain Python: used by the rule compiler and the kernel.

A vector is a string of one digit for each feature: 2 is +, 0 is -, 1 is unspecified. In a matrix 9 takes a value away.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

MARK_OF = {"2": "+", "0": "-", "1": "0"}
DIGIT_OF = {"+": "2", "-": "0", "0": "1", ".": "1"}
WEIGHTS_ROW = "FEATURE_WEIGHTS"
#: What may be in no phone symbol.
ILLEGAL = ("[", "]", "{", "}", "__", ":", ",", ";", " ", "+", "#", "@", "∅", "$", ">", "/", "~", "0")
#: Fixed value: the most diacritics that a symbol is built with.
MAX_DIACRITICS = 4
NULL, WORD, MORPH, ANY = "∅", "#", "+", "@"


def norm(text: str) -> str:
    """Canonically decomposed, so that a letter with a mark is one thing however it is written."""
    return unicodedata.normalize("NFD", text)


class RuleError(ValueError):
    """A table, symbol or rule that cannot be used."""


@dataclass(frozen=True, slots=True)
class Seg:
    """An element of a word: a phone with its vector, or a boundary without."""

    sym: str
    vec: str | None = None

    @property
    def is_phone(self) -> bool:
        return self.vec is not None


WORD_BOUND, MORPH_BOUND = Seg(WORD), Seg(MORPH)


def force(vec: str, specs: Iterable[tuple[int, str]]) -> str:
    """The vector with the specs imposed; 9 takes a value away."""
    out = list(vec)
    for i, v in specs:
        out[i] = "1" if v == "9" else v
    return "".join(out)


def parse_spec(spec: str) -> tuple[str, str]:
    """(mark, feature) of +f, -f, 0f, .f, or of f alone or with an alpha letter: mark '' or the letter."""
    spec = spec.strip()
    return (spec[0], spec[1:]) if spec and spec[0] in "+-0." else ("", spec)


@dataclass
class SymbolTable:
    """Features with weights, phones by symbol and by vector, implications and diacritics.

    New symbols and vectors are added by prepare() before a job; the table that a job gets does not change in it.
    """

    features: list[str]
    weights: list[float] | None = None
    vectors: dict[str, str] = field(default_factory=dict)
    symbols: dict[str, str] = field(default_factory=dict)
    implications: dict[str, list[str]] = field(default_factory=dict)
    diacritics: dict[str, list[str]] = field(default_factory=dict)

    # --- reading ------------------------------------------------------------------------------------------------------

    @classmethod
    def from_lines(cls, lines: Sequence[str]) -> SymbolTable:
        """`SYMB,f1,f2,...`, then maybe a row of weights, then rows of +, - and 0. Later rows win where vectors collide."""
        rows = [[c.strip() for c in x.split(",")] for x in lines if x.strip()]
        if not rows or len(rows[0]) < 2:
            raise RuleError("no header of features")
        table = cls(rows[0][1:])
        if len(set(table.features)) < len(table.features):
            raise RuleError("a feature is given twice")
        for row in rows[1:]:
            if len(row) != len(table.features) + 1:
                raise RuleError(f"{row[0]}: {len(row) - 1} values for {len(table.features)} features")
            if row[0] == WEIGHTS_ROW:
                table.weights = [float(x) for x in row[1:]]
                continue
            try:
                table.define(row[0], "".join(DIGIT_OF[x] for x in row[1:]))
            except KeyError as e:
                raise RuleError(f"{row[0]}: {e.args[0]} is no feature value") from None
        table.check_symbols()
        return table

    def define(self, symbol: str, vec: str) -> None:
        symbol = norm(symbol)
        self.vectors[symbol] = vec
        self.symbols[vec] = symbol

    def check_symbols(self) -> None:
        for s in self.vectors:
            if bad := [x for x in ILLEGAL if x in s]:
                raise RuleError(f"{s!r} holds {bad[0]!r}")

    def read_implications(self, lines: Iterable[str]) -> None:
        """`key:spec,spec`; a key without a sign holds for either sign."""
        for line in filter(None, (x.split("$")[0].strip() for x in lines)):
            key, _, specs = line.partition(":")
            self._known(parse_spec(key)[1])
            self.implications[key.strip()] = [s.strip() for s in specs.split(",") if s.strip()]
            for s in self.implications[key.strip()]:
                self._known(parse_spec(s)[1])

    def read_diacritics(self, lines: Iterable[str]) -> None:
        """`mark=spec,spec $comment`; the order of lines is the order of precedence."""
        for line in filter(None, (x.split("$")[0].strip() for x in lines)):
            mark, _, specs = norm(line).partition("=")
            found = [s.strip() for s in specs.split(",") if s.strip()]
            if conflict := feature_conflict(found):
                raise RuleError(f"{mark.strip()}: {conflict} has two values")
            for s in found:
                self._known(parse_spec(s)[1])
            self.diacritics[mark.strip()] = found

    def _known(self, name: str) -> int:
        try:
            return self.features.index(name)
        except ValueError:
            raise RuleError(f"no feature {name!r}") from None

    # --- matrices -----------------------------------------------------------------------------------------------------

    def close(self, specs: Sequence[str]) -> list[str]:
        """The specs and all that they imply. What is there already is not overruled; alpha specs imply as their feature does."""
        out = [s.strip() for s in specs]
        have = {parse_spec(s)[1].lstrip("!") if parse_spec(s)[0] else self.alpha(s)[2] for s in out}
        at = 0
        while at < len(out):  # the list grows as it is read
            mark, name = parse_spec(out[at])
            keys = ([f"{mark}{name}"] if mark in "+-" and mark else []) + ([name] if mark in "+-" and mark else [self.alpha(out[at])[2]] if not mark else [])
            for key in keys:
                for implied in self.implications.get(key, ()):
                    if (other := parse_spec(implied)[1]) not in have:
                        have.add(other)
                        out.append(implied)
            at += 1
        return out

    def alpha(self, spec: str) -> tuple[str, bool, str]:
        """(letter, whether negated, feature) of an alpha spec such as βstres or !βstres or -βstres."""
        rest = spec.strip()
        negated = rest[:1] in ("!", "-")
        rest = rest[1:] if negated else rest
        letter, name = rest[:1], rest[1:]
        self._known(name)
        return letter, negated, name

    def is_alpha(self, spec: str) -> bool:
        mark, name = parse_spec(spec)
        return (not mark or mark == "-") and name not in self.features

    def spell(self, vec: str) -> str:
        """`+syl -cons ...` without what is unspecified."""
        return " ".join(MARK_OF[v] + f for f, v in zip(self.features, vec, strict=True) if v != "1")

    # --- symbols with diacritics ----------------------------------------------------------------------------------------

    def marks_in(self, symbol: str) -> tuple[str, list[str]]:
        """(base, marks) of a symbol: marks are taken off in order of precedence; the base is a known symbol, or an error."""
        rest, marks = symbol, []
        for mark in self.diacritics:
            if mark in rest and rest not in self.vectors:
                rest = rest.replace(mark, "", 1)
                marks.append(mark)
        if not marks or rest not in self.vectors:
            raise RuleError(f"unknown symbol {symbol!r}")
        return rest, marks

    def phone(self, symbol: str) -> Seg:
        """The phone of a symbol, which is defined from its marks if it is new."""
        if symbol == WORD:
            return WORD_BOUND
        if symbol == MORPH:
            return MORPH_BOUND
        vec = self.vectors.get(symbol)
        if vec is None and (symbol := norm(symbol)) in self.vectors:
            vec = self.vectors[symbol]
        if vec is None:
            base, marks = self.marks_in(symbol)
            specs = [s for m in marks for s in self.diacritics[m]]
            if conflict := feature_conflict(specs):
                raise RuleError(f"{symbol}: its marks give {conflict} two values")
            vec = force(self.vectors[base], [(self._known(parse_spec(s)[1]), DIGIT_OF[parse_spec(s)[0]]) for s in specs])
            self.vectors[symbol] = vec
            self.symbols.setdefault(vec, symbol)
        return Seg(symbol, vec)

    def symbol(self, vec: str) -> str:
        """A symbol for the vector: known, or a known one with as few marks as give the vector, or `?`.

        Marks whose values conflict are not combined; fewer marks, then their order of precedence, then the order of the
        table decide. What is found is remembered, so that a vector prints alike throughout.
        """
        if (found := self.symbols.get(vec)) is not None:
            return found
        changes = {m: {self._known(parse_spec(s)[1]): DIGIT_OF[parse_spec(s)[0]] for s in specs} for m, specs in self.diacritics.items()}
        usable = [m for m, c in changes.items() if all(vec[i] == v for i, v in c.items())]
        plain = [(s, v) for s, v in self.vectors.items() if not any(m in s for m in self.diacritics)]
        for n in range(1, min(MAX_DIACRITICS, len(usable)) + 1):
            for marks in combinations(usable, n):
                effect = {i: v for m in marks for i, v in changes[m].items()}
                for s, v in plain:
                    if all(v[i] == vec[i] or effect.get(i) == vec[i] for i in range(len(vec))) and all(any(v[i] != x for i, x in changes[m].items()) for m in marks):
                        name = add_marks(s, marks)
                        self.symbols[vec] = name
                        self.vectors.setdefault(name, vec)
                        return name
        return "?"

    def prepare(self, symbols: Iterable[str]) -> None:
        """Defines all the symbols, as phone() does, before the table is sent out."""
        for s in symbols:
            self.phone(s)

    def word(self, text: str) -> tuple[Seg, ...]:
        """The word of space-delimited symbols, with a word boundary at each end."""
        segs = [self.phone(s) for s in text.split()]
        if not segs or segs[0] != WORD_BOUND:
            segs.insert(0, WORD_BOUND)
        if len(segs) == 1 or segs[-1] != WORD_BOUND:
            segs.append(WORD_BOUND)
        return tuple(segs)


def add_marks(symbol: str, marks: Sequence[str]) -> str:
    """Stress goes before the symbol, all other marks after it."""
    front = "".join(m for m in marks if m in "ˈˌ")
    return front + symbol + "".join(m for m in marks if m not in "ˈˌ")


def feature_conflict(specs: Iterable[str]) -> str | None:
    """The first feature that has two different values."""
    seen: dict[str, str] = {}
    for s in specs:
        mark, name = parse_spec(s)
        if seen.setdefault(name, mark) != mark:
            return name
    return None


def show(word: Iterable[Seg]) -> str:
    """Symbols of the word in order, boundaries included."""
    return " ".join(s.sym for s in word)


def show_phones(word: Iterable[Seg]) -> str:
    """`/.../` of the phones alone."""
    return "/" + "".join(s.sym for s in word if s.is_phone) + "/"
