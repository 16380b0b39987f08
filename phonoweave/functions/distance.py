"""Distances of words and alignments. Plain Python, called from Arrow stages; and the symbol-coded Levenshtein column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import SymbolTable

#: Symbols are coded into the private use area, one code point each.
PRIVATE = 0xE000
#: Places that are aligned with nothing.
GAP, EDGE_GAP = -1, -2


@dataclass(frozen=True)
class FeatureDistance:
    """Edit distance over feature vectors, divided by the number of features.

    A substitution costs half the sum of weighted differences. Insertion and deletion cost `id_weight` times the difference
    from both neighbours, where a word's edge counts as silence (all 0), or with `simple` times the number of features.
    """

    n_features: int
    id_weight: float = 0.5
    weights: tuple[float, ...] | None = None
    simple: bool = False

    def align(self, a: Sequence[str], b: Sequence[str]) -> tuple[float, list[tuple[int, int]]]:
        return self.align_many([(a, b)])[0]

    def align_many(self, pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[tuple[float, list[tuple[int, int]]]]:
        """(distance, aligned places) of each pair of lists of vectors.

        GAP stands for nothing, EDGE_GAP for nothing beyond the last pair of the word. On ties a gap wins over a pair, b's
        gap last.
        """
        out: list = [None] * len(pairs)
        for group, m, n, cost, move in self._solved(pairs, True):
            for k, i in enumerate(group):
                steps, x, y, gap = [], m, n, EDGE_GAP if m and n else GAP
                while x or y:
                    step = move[x, y, k]
                    x, y = x - (step != 2), y - (step != 1)
                    gap = gap if step else GAP
                    steps.append((int(x) if step != 2 else gap, int(y) if step != 1 else gap))
                out[i] = (float(cost[k]) / self.n_features, steps[::-1])
        return out

    def distances(self, pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> np.ndarray:
        """The distance alone of each pair."""
        out = np.zeros(len(pairs))
        for group, _, _, cost, _ in self._solved(pairs, False):
            out[group] = cost / self.n_features
        return out

    def _solved(self, pairs: Sequence, moves: bool):
        """(places, lengths, costs, moves) of the pairs, those of the same lengths together in one table.

        Differences are computed once for each two vectors; a table then looks them up by number. 0 is silence.
        """
        index: dict[str, int] = {"0" * self.n_features: 0}
        alike: dict[tuple[int, int], list[int]] = {}
        numbers = [tuple([index.setdefault(v, len(index)) for v in side] for side in pair) for pair in pairs]
        for i, (a, b) in enumerate(numbers):
            alike.setdefault((len(a), len(b)), []).append(i)
        vectors = np.frombuffer("".join(index).encode(), np.uint8).reshape(len(index), self.n_features).astype(np.float32) - 48
        vectors[0] = 0
        w = np.ones(self.n_features) if self.weights is None else np.array(self.weights)
        plain, swap = np.zeros((len(index), len(index))), np.zeros((len(index), len(index)))
        for i, v in enumerate(vectors):
            gap = np.abs(vectors - v)
            plain[i], swap[i] = gap.sum(axis=1), gap @ w / 2
        for (m, n), group in alike.items():
            x, y = (np.array([numbers[i][k] for i in group], np.int64).reshape(len(group), size) for k, size in ((0, m), (1, n)))
            yield group, m, n, *self._table(x, y, plain, swap, moves)

    def _gaps(self, x: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Cost of a gap at each segment; x is (pairs, length)."""
        if self.simple or not x.shape[1]:
            return np.full(x.shape, self.id_weight * self.n_features)
        edge = np.zeros((len(x), 1), np.int64)
        before, after = np.concatenate([edge, x[:, :-1]], axis=1), np.concatenate([x[:, 1:], edge], axis=1)
        return self.id_weight * (plain[x, before] + plain[x, after])

    def _table(self, x: np.ndarray, y: np.ndarray, plain: np.ndarray, swap: np.ndarray, moves: bool) -> tuple[np.ndarray, np.ndarray | None]:
        pairs, m, n = len(x), x.shape[1], y.shape[1]
        gone, come = self._gaps(x, plain), self._gaps(y, plain)
        last = np.concatenate([np.zeros((pairs, 1)), np.cumsum(come, axis=1)], axis=1)
        move = np.zeros((m + 1, n + 1, pairs), np.int8) if moves else None
        if moves:
            move[1:, 0], move[0, 1:] = 1, 2
        for i in range(1, m + 1):
            row = np.empty_like(last)
            row[:, 0] = last[:, 0] + gone[:, i - 1]
            pair = last[:, :-1] + swap[x[:, i - 1, None], y]
            down = last[:, 1:] + gone[:, i - 1, None]
            for j in range(1, n + 1):
                s, d, c = pair[:, j - 1], down[:, j - 1], row[:, j - 1] + come[:, j - 1]
                row[:, j] = np.minimum(np.minimum(s, d), c)
                if moves:
                    move[i, j] = np.where((s < d) & (s < c), 0, np.where(d < c, 1, 2))
            last = row
        return last[:, n], move


def symbol_codes(symbols: Sequence[str]) -> dict[str, str]:
    """One code point for each symbol: its own where all symbols are single code points, else private ones."""
    if all(len(s) == 1 for s in symbols):
        return {s: s for s in symbols}
    return {s: chr(PRIVATE + i if i < 0x1900 else 0xF0000 + i) for i, s in enumerate(sorted(set(symbols)))}


def coded(form: Column, codes: dict[str, str]) -> Column:
    """A space-delimited form without its boundaries, one code point for each symbol.

    Where every symbol is one code point already, it is its own code, and `codes` must then have all symbols of the forms.
    """
    if codes and all(len(s) == 1 for s in codes):
        return F.translate(form, " #+", "")
    known = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)) if codes else F.create_map().cast("map<string,string>")
    phones = F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", ""))
    return F.array_join(F.transform(phones, lambda x: F.coalesce(F.element_at(known, x), x)), "")


def levenshtein(a: Column, b: Column, codes: dict[str, str]) -> Column:
    """Unit-cost edit distance of two forms counted in symbols."""
    return F.levenshtein(coded(a, codes), coded(b, codes))


def phone_count(form: Column, codes: dict[str, str] | None = None) -> Column:
    if codes:
        return F.length(coded(form, codes))
    return F.size(F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", "")))


def symbol_vectors(table: SymbolTable, form: str) -> list[str]:
    return [table.phone(s).vec for s in form.split() if s not in ("#", "+")]
