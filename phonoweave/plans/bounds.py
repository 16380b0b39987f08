"""Context elements compiled to one regular expression over coded words, which finds all their matches without Python.

A word is coded with a character for each symbol, and its boundaries as # and +. What the matcher does step by step is said
by the expression: groups are left out first, so they are reluctant; boundaries that an element does not name are passed over,
so each element has a possessive run of them before it. An alpha letter is bound by the first phone that it meets; from there
on the expression goes on in one branch for each value, each of which has the classes of symbols that agree with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoweave.functions.distance import symbol_codes
from phonoweave.functions.features import MORPH, WORD, Seg, SymbolTable

from .rules import Exact, Group, Matrix, Segment

#: Around a match; no symbol of a word, as they are no characters.
OPEN, CLOSE = "\uFDD0", "\uFDD1"
#: How often a group may be written out before its letters are bound.
DEEPEST = 6
_BEFORE_PHONE, _BEFORE = r"[#+]*+", {WORD: r"\+*+", MORPH: r"#*+"}
_NEVER = "(?!)"


def _letters(items: Sequence) -> set[str]:
    out: set[str] = set()
    for x in items:
        out |= _letters(x.items) if isinstance(x, Group) else {letter for _, letter, _ in x.alphas} if isinstance(x, Matrix) else set()
    return out


def _class(symbols: Sequence[str], codes: dict[str, str]) -> str:
    return "[" + "".join(f"\\x{{{ord(codes[s]):X}}}" for s in sorted(symbols)) + "]"


class _Compiler:
    def __init__(self, table: SymbolTable, codes: dict[str, str]):
        self.segs, self.codes = [Seg(s, v) for s, v in table.vectors.items()], codes

    def of(self, items: tuple, bound: dict, deep: int = 0) -> str | None:
        """The elements from here on, with the letters bound so far; None if a group's letters are never bound."""
        if not items:
            return ""
        head, rest = items[0], items[1:]
        if isinstance(head, Group):
            after = self.of(rest, bound, deep)
            if _letters(head.items) <= set(bound):
                inner = self.of(head.items, bound, deep)
                return None if inner is None or after is None else f"(?:{inner}){'*?' if head.many else '??'}{after}"
            if deep == DEEPEST:
                return None
            taken = self.of((*head.items, *((head,) if head.many else ()), *rest), bound, deep + 1)
            return None if taken is None or after is None else f"(?:{after}|{taken})"
        if isinstance(head, Segment):
            after = self.of(rest, bound, deep)
            return None if after is None else f"[^{WORD}]{after}"
        if isinstance(head, Exact) and not head.seg.is_phone:
            after = self.of(rest, bound, deep)
            return None if after is None else f"{_BEFORE[head.seg.sym]}[{head.seg.sym}]{after}"
        branches: dict[tuple, list[str]] = {}
        for seg in self.segs:
            if (got := head.match(seg, bound)) is not None:
                branches.setdefault(tuple(sorted(got.items())), []).append(seg.sym)
        parts = []
        for b, symbols in branches.items():
            after = self.of(rest, dict(b), deep)
            if after is None:
                return None
            parts.append(_class(symbols, self.codes) + after)
        return _BEFORE_PHONE + (f"(?:{'|'.join(parts)})" if len(parts) > 1 else parts[0] if parts else _NEVER)


def bounds_regex(items: Sequence, table: SymbolTable, codes: dict[str, str]) -> str | None:
    """The expression that finds the elements in a word coded by whole(); None where only the matcher can tell.

    That is so for a repeated group that may come to an end with its alpha letters unbound.
    """
    if not items or any(len(c) != 1 for c in codes.values()):
        return None
    first = items[0]
    at_bound = isinstance(first, Exact) and not first.seg.is_phone
    begin = f"(?=[{first.seg.sym}])" if at_bound else "" if isinstance(first, Segment) else r"(?=[^#+])"
    own = _Compiler(table, codes).of(tuple(items), {})
    return None if own is None else begin + own


def codes_of(table: SymbolTable) -> dict[str, str]:
    return symbol_codes([*table.vectors])


def whole(form: Column, codes: dict[str, str]) -> Column:
    """A space-delimited form with its boundaries, one at each end at least, one character for each element.

    Where every symbol is one code point it stands for itself. Else a symbol that has no code is an error.
    """
    if all(len(s) == 1 for s in codes):
        own = F.regexp_replace(form, r"\s+", "")
    else:
        known = F.create_map(*(F.lit(x) for kv in (codes | {WORD: WORD, MORPH: MORPH}).items() for x in kv))
        each = F.filter(F.split(form, r"\s+"), lambda x: x != "")
        own = F.array_join(F.transform(each, lambda x: F.coalesce(F.element_at(known, x), F.raise_error(F.concat(F.lit("a symbol that is not in the table: "), x)).cast("string"))), "")
    first = lambda x: F.when(x.startswith(WORD), x).otherwise(F.concat(F.lit(WORD), x))
    last = lambda x: F.when(x.endswith(WORD) & (F.length(x) > 1), x).otherwise(F.concat(x, F.lit(WORD)))
    # the form is an element of an array, so that it is made once and not in each use
    return F.get(F.transform(F.transform(F.array(own), first), last), 0)


def bounds(word: Column, regex: str) -> Column:
    """array of (start, end) of the matches in a coded word, from the left, not overlapping, none of them empty."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    marked = F.split(F.regexp_replace(word, regex, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)  # outside, inside, outside, ...

    def found(parts: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            begin = state["at"] + F.length(F.get(parts, 2 * i))
            end = begin + F.length(F.get(parts, 2 * i + 1))
            more = F.when(end > begin, F.concat(state["found"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["found"])
            return F.struct(end.alias("at"), more.alias("found"))

        times = F.floor(F.size(parts) / 2).cast("int")
        return F.when(times == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), times - 1), F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"])

    # the parts are an element of an array, so that they are made once and not in each step
    return F.when(word.isNotNull(), F.get(F.transform(F.array(marked), found), 0))
