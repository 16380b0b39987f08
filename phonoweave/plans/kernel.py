"""Applies compiled rules to words. Plain Python, called from one Arrow stage; it shares nothing between words."""

from __future__ import annotations

from collections.abc import Sequence

from phonoweave.functions.features import Seg, SymbolTable

from .rules import Exact, Group, Matrix, Null, Rule

Word = tuple[Seg, ...]


class _Needs:
    """What each of some rules needs a word to have, as bits: one for each set of slots of which some segment must match one.

    A rule needs a beginning of one of its targets, the rest of its target if it has one alone, and the elements of its
    contexts that are in no group.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.bits: dict[tuple, int] = {}
        self.rules = rules  # so that their id stays their own
        self.masks, self.firsts = (list(x) for x in zip(*map(self._mask, rules), strict=True)) if rules else ([], [])
        self._has: dict[Seg, int] = {}

    def _bit(self, slots: tuple) -> int:
        return 1 << self.bits.setdefault(slots, len(self.bits))

    def _mask(self, rule: Rule) -> tuple[int, int]:
        """(all that the rule needs, what a target of it begins with; 0 for a rule that only inserts)."""
        sources = [tuple(s for s in a if not isinstance(s, Null)) for a in rule.sources]
        first = self._bit(tuple(a[0] for a in sources)) if all(sources) else 0
        out = first
        for x in (*(sources[0][1:] if len(sources) == 1 else ()), *(x for c in (rule.prior, rule.post) if c is not None for x in c.items if not isinstance(x, Group))):
            out |= self._bit((x,))
        return out, first

    def of(self, word: Word) -> list[int]:
        """The bits of each segment of a word."""
        out = []
        for seg in word:
            if (has := self._has.get(seg)) is None:
                has = 0
                for slots, bit in self.bits.items():
                    if any(s.match(seg, {}) is not None for s in slots):
                        has |= 1 << bit
                self._has[seg] = has
            out.append(has)
        return out


class Kernel:
    """Rules over a table. Contexts and targets are tested on the word as it was; a rule does not feed itself."""

    def __init__(self, table: SymbolTable):
        self.table, self._segs, self._needs = table, {}, {}

    def seg(self, vec: str) -> Seg:
        out = self._segs.get(vec)
        if out is None:
            out = self._segs[vec] = Seg(self.table.symbol(vec), vec)
        return out

    def needs(self, rules: Sequence[Rule]) -> _Needs:
        if (known := self._needs.get(id(rules))) is None:
            known = self._needs[id(rules)] = _Needs(rules)
        return known

    def apply(self, rule: Rule, word: Word, places: Sequence[int] | None = None) -> Word:
        """The word after the rule; the same object where nothing changes. A target is looked for at `places`, all by default."""
        prior = rule.prior.size if rule.prior else 0
        post = rule.post.size if rule.post else 0
        needs = min(sum(not isinstance(s, Null) for s in a) for a in rule.sources)
        if len(word) < prior + needs + post:
            return word
        last = len(word) - max(post + needs, 1)
        out, copied, least = None, 0, prior
        for at in range(prior, last + 1) if places is None else places:
            if at < least:
                continue
            if at > last:
                break
            if (found := self._at(rule, word, at)) is None:
                continue
            made, end = found
            out = out or []
            out += word[copied:at]
            out += made
            copied = end
            # One insertion for each gap; and a deleted segment must not delete the next.
            least = end + 1 if end == at or (rule.kind == "FEAT" and not made) else end
        if copied == 0 and not out:
            return word
        result = (*(out or ()), *word[copied:])
        return word if result == word else result

    def _at(self, rule: Rule, word: Word, at: int) -> tuple[list[Seg], int] | None:
        """(what comes in, end of what goes) if the rule applies at a place."""
        for source, dest in zip(rule.sources, rule.dests, strict=True):
            bound: dict | None = {}
            place = at
            for slot in source:
                if isinstance(slot, Null):
                    continue
                if place >= len(word) or (bound := slot.match(word[place], bound)) is None:
                    bound = None
                    break
                place += 1
            if bound is None:
                continue
            if rule.prior is not None and (bound := rule.prior.before(word, at, bound)) is None:
                continue
            if rule.post is not None and (bound := rule.post.after(word, place, bound)) is None:
                continue
            return self._made(rule, source, dest, word, at, bound), place
        return None

    def _made(self, rule: Rule, source, dest, word: Word, at: int, bound: dict) -> list[Seg]:
        if rule.kind in ("SEQ", "RUN"):
            return [d.seg for d in dest if isinstance(d, Exact)]
        out = []
        for s, d in zip(source, dest, strict=True):
            if isinstance(s, Null):
                out.append(d.seg if isinstance(d, Exact) else self.seg(d.impose("1" * len(self.table.features), bound)))
                continue
            if isinstance(d, Matrix):
                seg = word[at]
                vec = d.impose(seg.vec, bound)
                out.append(seg if vec == seg.vec else self.seg(vec))
            elif isinstance(d, Exact):
                out.append(d.seg)
            at += 1
        return out

    def run(self, rules: Sequence[Rule], word: Word, stops: Sequence[int] = ()) -> tuple[Word, list[tuple[int, Word, Word]], list[Word]]:
        """(last form, (rule, before, after) of each change, forms at the stops). A stop k is before rule k."""
        log, snaps, stop = [], [], 0
        stops = sorted(stops)
        needs = self.needs(rules)
        bits = needs.of(word)
        has = _any(bits)
        for k, mask in enumerate(needs.masks):
            while stop < len(stops) and stops[stop] <= k:
                snaps.append(word)
                stop += 1
            if mask & has != mask:
                continue
            first = needs.firsts[k]
            new = self.apply(rules[k], word, [i for i, b in enumerate(bits) if b & first] if first else None)
            if new is not word:
                log.append((k, word, new))
                word, bits = new, needs.of(new)
                has = _any(bits)
        snaps += [word] * (len(stops) - stop)
        return word, log, snaps


def _any(bits: list[int]) -> int:
    out = 0
    for b in bits:
        out |= b
    return out
