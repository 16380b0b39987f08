"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers. The splitter reads classes of code points and marks where a piece begins; it has eight
states, so what a chunk of text does is a map of eight states to eight states. Chunks of a whole batch run in lockstep
from every state at once, their maps compose in a parallel prefix scan, and a second pass from the then known states
gives the marks. The counter reads the bytes of a piece; each of its transitions is annotated with the change of the
number of emitted tokens, and transitions are compiled when first needed. The tokens that
pieces emit compose to those of texts by prefix sums. Short pieces are remembered with their sum in a table of arrays.
"""

from __future__ import annotations

import json
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX_1, bounded, frugal, mix64, slices, strings, texts_of

# --- the splitter ----------------------------------------------------------------------------------------------------

# Classes of code points.
LETTER, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER = range(6)
# Input symbols: a class, with what the next two code points tell. _OPEN: something other than white space follows.
(S_LETTER, S_NUMBER, S_BLANK_OPEN, S_BLANK, S_SPACE_OPEN, S_SPACE, S_APO, S_APO_2, S_APO_3, S_OTHER, S_RESET) = range(11)
# States after a code point.
(FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, PREFIX, IN_SPACE, CONTRACT_1, CONTRACT_2) = range(8)
N_STATES, N_SYMBOLS, CHUNK = 8, 11, 64
#: Code points that are handled at once.
PART = 1 << 19
_BLANK = regex.compile(r" (?=\S)")
#: Fixed values of the pattern: after an apostrophe, one of these letters or pairs of letters is a piece of its own.
CONTRACTIONS_1, CONTRACTIONS_2 = "stmd", ("re", "ve", "ll")


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    codes = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[codes[m.start() : m.end()]] = kind
    out[0x20], out[0x27] = BLANK, APOSTROPHE
    out[0x1C:0x20] = OTHER  # white space for regex, but without the property White_Space
    return out


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a piece begins at the code point), by symbol * N_STATES + state."""
    after, begins = np.zeros(N_SYMBOLS * N_STATES, np.uint8), np.ones(N_SYMBOLS * N_STATES, np.uint8)

    def on(symbol: int, default: int, **_):
        for s in range(N_STATES):
            after[symbol * N_STATES + s] = default

    def stay(symbol: int, state: int, to: int):
        after[symbol * N_STATES + state], begins[symbol * N_STATES + state] = to, 0

    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER, S_APO: IN_OTHER, S_APO_2: CONTRACT_1, S_APO_3: CONTRACT_2}
    for symbol, run in runs.items():
        on(symbol, run)
        same = IN_OTHER if symbol in (S_APO, S_APO_2, S_APO_3) else run
        stay(symbol, same, same)  # the run goes on
        stay(symbol, PREFIX, same)  # the blank before belongs to it
    stay(S_LETTER, CONTRACT_2, CONTRACT_1)
    stay(S_LETTER, CONTRACT_1, FRESH)
    on(S_BLANK_OPEN, PREFIX)  # the last white space of a run begins a piece: a blank goes to what follows,
    on(S_SPACE_OPEN, FRESH)  # any other stands alone
    for symbol in (S_BLANK, S_SPACE):
        on(symbol, IN_SPACE)
        stay(symbol, IN_SPACE, IN_SPACE)
    on(S_RESET, FRESH)
    return after, begins


AFTER, BEGINS = _transitions()


def symbols(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Input symbols of concatenated texts, each ended by one code point 0x110000 (reset)."""
    reset = codes == 0x110000
    kind = classes[np.where(reset, 0, codes)]
    after = np.ones(len(codes), bool)  # white space or the end follows
    after[:-1] = (kind[1:] == BLANK) | (kind[1:] == SPACE) | reset[1:]
    out = np.array([S_LETTER, S_NUMBER, S_BLANK_OPEN, S_SPACE_OPEN, S_APO, S_OTHER], np.uint8)[kind]
    out[after & (kind == BLANK)] = S_BLANK
    out[after & (kind == SPACE)] = S_SPACE
    at = np.flatnonzero(kind == APOSTROPHE)
    if len(at):
        one, two = codes[np.minimum(at + 1, len(codes) - 1)], codes[np.minimum(at + 2, len(codes) - 1)]
        out[at[np.isin(one, [ord(c) for c in CONTRACTIONS_1])]] = S_APO_2
        for a, b in CONTRACTIONS_2:
            out[at[(one == ord(a)) & (two == ord(b))]] = S_APO_3
    out[reset] = S_RESET
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The maps of state to state that run `first` and `then` one after the other, row by row."""
    return then.take(first + (np.arange(len(first)) * then.shape[1])[:, None])


def prefix_states(maps: np.ndarray, start: int = FRESH) -> np.ndarray:
    """The state in which each chunk begins: an exclusive parallel prefix scan over the chunks' maps."""
    total = maps.copy()
    step = 1
    while step < len(total):
        total[step:] = compose(total[:-step].copy(), total[step:])
        step *= 2
    return np.concatenate([[start], total[:-1, start]]).astype(np.uint8)


def _looked_up(at: np.ndarray, table: bytes) -> np.ndarray:
    """table[at] of bytes, which are not made indices of eight bytes each."""
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


#: The tables for every byte.
_AFTER, _BEGINS = (bytes(x.astype(np.uint8)).ljust(256, b"\0") for x in (AFTER, BEGINS))


def piece_starts(syms: np.ndarray) -> np.ndarray:
    """Where pieces begin (resets included), by chunk maps, their scan, and a second pass."""
    n = len(syms)
    rows = max(1, -(-n // CHUNK))
    grid = np.full(rows * CHUNK, S_RESET, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.uint8) * np.uint8(N_STATES)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, rows))  # by state, chunk
    for column in grid:
        maps = _looked_up(column + maps, _AFTER)
    state = prefix_states(np.ascontiguousarray(maps.T))
    marks = np.empty((CHUNK, rows), np.uint8)
    for i, column in enumerate(grid):
        at = column + state
        marks[i], state = _looked_up(at, _BEGINS), _looked_up(at, _AFTER)
    return np.flatnonzero(marks.T.ravel()[:n])


# --- the counter -----------------------------------------------------------------------------------------------------


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Table:
    """Numbers under keys of two words: open addressing in arrays of a fixed size. The second word of a key is never 0."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.one, self.two = (np.zeros(self.mask + 1, np.uint64) for _ in range(2))
        self.value = np.zeros(self.mask + 1, np.int32)

    def _home(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (mix64(one + two * MIX_1) & np.uint64(self.mask)).astype(np.int64)

    def get(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        at, out, left = self._home(one, two), np.full(len(one), -1, np.int64), np.arange(len(one))
        while len(left):
            here = at[left]
            there = self.two[here]
            hit = (there == two[left]) & (self.one[here] == one[left])
            out[left[hit]] = self.value[here[hit]]
            left = left[~hit & (there != 0)]
            at[left] = (at[left] + 1) & self.mask
        return out

    def put(self, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct keys that are not there; when half the table would be full, all are forgotten before."""
        if self.size + len(one) > self.mask // 2:
            self.clear()
            one, two, value = (x[: self.mask // 2] for x in (one, two, value))
        self.size += len(one)
        at, left = self._home(one, two), np.arange(len(one))
        while len(left):
            here = at[left]
            free = self.two[here] == 0
            self.value[here[free]] = left[free]  # of several keys for one place the last to be written gets it
            free[free] = self.value[here[free]] == left[free]
            done = left[free]
            self.one[at[done]], self.two[at[done]], self.value[at[done]] = one[done], two[done], value[done]
            left = left[~free]
            at[left] = (at[left] + 1) & self.mask


class Merges:
    """The vocabulary: which merge joins two tokens when. A token's number grows with the rank of the merge that makes it."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.tokens = ids = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        #: left * 2^24 + right: the token that they join to
        self.join: dict[int, int] = {}
        for a, b in merges:
            if a + b not in ids:
                ids[a + b] = len(ids)
                self.parts.append((ids[a], ids[b]))
            elif self.parts[ids[a + b]] != (ids[a], ids[b]):
                raise ValueError(f"two merges make {a + b!r}")
            self.join.setdefault(ids[a] << 24 | ids[b], ids[a + b])

        self._left, self._right = np.array(self.parts, np.int64).T.copy()
        self._joins = Table(max(4, (4 * len(self.join)).bit_length()))
        keys = np.fromiter(self.join, np.uint64, len(self.join))
        self._joins.put(keys, np.ones_like(keys), np.fromiter(self.join.values(), np.int64, len(keys)))
        #: tokens to whose number their bytes are merged; others never come out
        unused = self._crosses(self._left[256:], self._right[256:], own=True)
        self.usable = {t: i for t, i in ids.items() if i < 256 or not unused[i - 256]}

    def _crosses(self, left: np.ndarray, right: np.ndarray, own: bool = False) -> np.ndarray:
        """Whether merging the bytes of two tokens joins some over the seam between them; with `own`, other than the two.

        The tokens beside the seam are followed back in time: the later made of the two is taken apart again. What is beside
        the seam joins over it if that comes before the merge just taken back; of equal merges the left one is made first.
        """
        left, right = left.copy(), right.copy()
        out, todo = np.zeros(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), len(self._left))
        while len(todo):
            a, b = left[todo], right[todo]
            if not own:
                key = (a << 24 | b).astype(np.uint64)
                joined = self._joins.get(key, np.ones_like(key))
                hit = (joined >= 0) & (joined < limit[todo])
                out[todo[hit]] = True
            else:
                hit, own = np.zeros(len(todo), bool), False
            more = ~hit & ((a >= 256) | (b >= 256))
            todo, a, b = todo[more], a[more], b[more]
            later = a > b
            limit[todo] = np.where(later, a, b + 1)
            left[todo], right[todo] = np.where(later, self._right[a], a), np.where(later, b, self._left[b])
        return out

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merging the bytes of two usable tokens leaves the two as they are; nothing (-1) to the left never matters."""
        out = left < 0
        some = np.flatnonzero(~out)
        out[some] = ~self._crosses(left[some], right[some])
        return out


class Counter:
    """The byte transducer: deterministic, its states made as they are reached.

    The tokens of a byte string end with the longest token that fits the last token of what precedes it. A state therefore
    holds, for every suffix that can still grow into a token, its node in the trie of tokens, the last token before it, and
    how many fewer tokens end there than at the present end. The annotation of a transition is the change of the token count,
    which may be negative, as a byte can join two tokens.

    Many pieces are read in lockstep, a byte at a time, their states side by side in arrays. A piece of up to SHORT bytes is
    remembered under its exact bytes.
    """

    SHORT = 15
    #: Sizes (as powers of 2) of the tables of remembered pieces and pairs of tokens; one that is half full forgets all.
    PIECE_BITS, FIT_BITS = 20, 18
    #: A longer piece is read by itself, with the transitions that it repeats remembered.
    LONG, MOST_EDGES = 256, 100_000

    def __init__(self, merges: Merges):
        self.merges, self.pieces, self._known = merges, None, None
        child: dict[int, int] = {}  # node * 256 + byte: node
        token, grows = [-1], [True]
        for t, i in merges.usable.items():
            node = 0
            for byte in t:
                key = node << 8 | byte
                if (to := child.get(key)) is None:
                    to = child[key] = len(token)
                    grows[node] = True
                    token.append(-1)
                    grows.append(False)
                node = to
            token[node] = i
        #: of each node: its token, whether it has children
        self.token, self.grows = np.array(token, np.int32), np.array(grows)
        self._place_children(child)
        del merges.tokens, merges.parts, merges.join, merges.usable  # arrays have all that is needed from here on

    def _place_children(self, child: dict[int, int]) -> None:
        """One array for all nodes' children: that of a node by a byte is at base[node] + byte, if that place is the node's."""
        of: dict[int, list[int]] = {}
        for key in child:
            of.setdefault(key >> 8, []).append(key & 255)
        size = len(child) + 256 * len(of) + 1024
        base, owner, to = np.zeros(len(self.token), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        taken, free, end = bytearray(size), 256, 256
        for node in sorted(of, key=lambda n: -len(of[n])):  # those with one child fill the gaps that the others leave
            own = sorted(of[node])
            shift = [b - own[0] for b in own]
            while taken[free]:
                free += 1
            at = next((x for x in range(free, min(free + 16, end)) if not any(taken[x + d] for d in shift)), end) if len(own) > 1 else free
            end = max(end, at + shift[-1] + 1)
            base[node] = at - own[0]
            for b, d in zip(own, shift, strict=True):
                taken[at + d] = 1
                owner[at + d], to[at + d] = node, child[node << 8 | b]
        self._base, self._owner, self._to = base, owner[: end + 256].copy(), to[: end + 256].copy()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": None, "_known": None}  # what is remembered stays in its process

    def step(self, row: np.ndarray, node: np.ndarray, before: np.ndarray, fewer: np.ndarray, byte: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(states after a byte each, tokens emitted). States are entries one after the other, of ascending rows, each row's
        longest suffix first."""
        n = len(byte)
        key = self._base[node] + byte[row]
        some = np.flatnonzero(self._owner[key] == node)
        row, to, before, fewer = row[some], self._to[key[some]], before[some], fewer[some]
        token = self.token[to]
        best, ends = np.empty(n, np.int64), np.flatnonzero(token >= 0)
        while len(ends):  # the longest of each row, then the next of those rows where it does not fit
            first = np.ones(len(ends), bool)
            first[1:] = row[ends[1:]] != row[ends[:-1]]
            mine = ends[first]
            fit = self._fits(before[mine], token[mine])
            best[row[mine[fit]]] = mine[fit]
            if fit.all():
                break
            open_ = np.zeros(n, bool)
            open_[row[mine[~fit]]] = True  # a byte alone is a token and fits, so each row ends here
            ends = ends[~first & open_[row[ends]]]
        emitted = 1 - fewer[best]
        kept = np.flatnonzero(self.grows[to])
        size = np.cumsum(np.bincount(row[kept], minlength=n))
        at, last = np.arange(len(kept)) + row[kept], size + np.arange(n)  # each row gets one entry more, at its end
        out = [np.empty(len(kept) + n, np.int32) for _ in range(4)]
        for x, some_, one in zip(out, (row[kept], to[kept], before[kept], fewer[kept] + emitted[row[kept]]), (np.arange(n), 0, token[best], 0), strict=True):
            x[at], x[last] = some_, one
        return out, emitted

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges.fits(), remembered."""
        if self._known is None:
            self._known = Table(self.FIT_BITS)
        key = (left.astype(np.int64) + 1 << 24 | right).astype(np.uint64)
        one = np.ones_like(key)
        found = self._known.get(key, one)
        if (new := np.flatnonzero(found < 0)).size:
            keys, first, place = np.unique(key[new], return_index=True, return_inverse=True)
            made = self.merges.fits(left[new[first]].astype(np.int64), right[new[first]].astype(np.int64)).astype(np.int64)
            self._known.put(keys, one[: len(keys)], made)
            found[new] = made[place]
        return found > 0

    def _alone(self, data: bytes) -> int:
        """Tokens of one piece."""
        states, index, edges = [((0, -1, 0),)], {}, {}
        state = n = 0
        for byte in data:
            if (edge := edges.get(state << 8 | byte)) is None:
                if len(states) >= self.MOST_EDGES:
                    states, index, edges = [states[state]], {}, {}
                    state = 0
                entries = np.array(states[state], np.int32).T
                (_, *made), emitted = self.step(np.zeros(entries.shape[1], np.int32), *entries, np.array([byte], np.int32))
                key = tuple(map(tuple, np.stack(made).T.tolist()))
                to = index.setdefault(key, len(states))
                if to == len(states):
                    states.append(key)
                edge = edges[state << 8 | byte] = to, int(emitted[0])
            state = edge[0]
            n += edge[1]
        return n

    def _read(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each of the pieces raw[begin : begin + size]."""
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        n, alone = np.zeros(len(order), np.int64), int(np.searchsorted(-size, -self.LONG, side="left"))
        at, own, t = begin[alone:], n[alone:], 0
        state = [np.arange(len(at), dtype=np.int32), *(np.full(len(at), x, np.int32) for x in (0, -1, 0))]
        while m := int(np.searchsorted(-size[alone:], -t, side="left")):  # pieces longer than t
            live = int(np.searchsorted(state[0], m))
            state, emitted = self.step(*(x[:live] for x in state), raw[at[:m] + t].astype(np.int32))
            own[:m] += emitted
            t += 1
        for i in range(alone):
            n[i] = self._alone(raw[begin[i] : begin[i] + size[i]].tobytes())
        out = np.empty_like(n)
        out[order] = n
        return out

    def counts(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each of the pieces raw[begin : begin + size]; raw has 24 bytes more at its end."""
        eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
        word = lambda at, n: np.ascontiguousarray(eight[at]).view("<u8").ravel() & _LOW_BYTES[n]
        if self.pieces is None:
            self.pieces = Table(self.PIECE_BITS)
        short = np.flatnonzero(size <= self.SHORT)
        at, n = begin[short], size[short]
        one, two = word(at, np.minimum(n, 8)), word(at + 8, np.maximum(n - 8, 0)) | n.astype(np.uint64) << np.uint64(56)
        out = np.full(len(size), -1, np.int64)
        out[short] = found = self.pieces.get(one, two)
        new = np.flatnonzero(found < 0)
        keys = np.stack([one[new], two[new]], axis=1).view("u8,u8").ravel()
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        some, long = new[first], np.flatnonzero(size > self.SHORT)
        read = np.concatenate([short[some], long])
        made = self._read(raw, begin[read], size[read])
        out[long] = made[len(some) :]
        out[short[new]] = made[: len(some)][place]
        self.pieces.put(one[some], two[some], made[: len(some)])
        return out


#: By number: all ones in so many low bytes.
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class CompiledTokenizer:
    """A byte-level BPE tokenizer file as the two transducers."""

    def __init__(self, spec: str):
        """`spec` is the file's text. What is made of it is arrays of a few MB, made once and sent to all executors."""
        j = json.loads(spec)
        pre, model = j["pre_tokenizer"], j["model"]
        known = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and j["normalizer"] is None and model["type"] == "BPE"
        if not known or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("this compiler takes byte-level BPE with its usual pattern, without prefix space or normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in j["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not compiled")
        to = byte_symbols()
        merges = [tuple(bytes(to[c] for c in part) for part in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.counter = Counter(Merges(merges))
        self.special = [t["content"] for t in j["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.classes = _classes()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. A special string inside a text is one token and ends the pieces around it.

        A piece is what the byte transducer reads from its first state on, so the map of a piece has one entry, annotated
        with the tokens emitted; the totals of texts are differences of the prefix sums of these.
        """
        owner, parts, out = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if self._special is not None and any(s in t for s in self.special):
                out[i] = len(self._special.findall(t))
                split = self._special.split(t)
            else:
                split = [t]
            for own in split:
                for part in _parts(own):
                    owner.append(i)
                    parts.append(part)
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (last == first or size + len(parts[last]) <= PART):
                size += len(parts[last])
                last += 1
            np.add.at(out, owner[first:last], self._count(parts[first:last]))
            first = last
        return out

    def _count(self, parts: list[str]) -> np.ndarray:
        joined = "\0".join(parts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        raw = joined.encode()
        place = np.arange(len(codes) + 1)  # of each code point in the bytes
        if len(raw) > len(codes):
            np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=place[1:])
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes[ends] = 0x110000
        syms = symbols(codes, self.classes)
        starts = piece_starts(syms)
        begin = place[starts]
        size = np.diff(begin, append=place[-1])
        inside = syms[starts] != S_RESET
        total = np.zeros(len(starts) + 1, np.int64)
        total[1:][inside] = self.counter.counts(np.frombuffer(raw + bytes(24), np.uint8), begin[inside], size[inside])
        np.cumsum(total, out=total)
        return np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends + 1]))])


@lru_cache(maxsize=2)
def compiled(tokenizer_path: str) -> CompiledTokenizer:
    """The compiled file, once in a driver."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return CompiledTokenizer(f.read())


def _parts(text: str) -> list[str]:
    """The text in parts of about PART code points. A blank before anything but white space always begins a piece."""
    out, at = [], 0
    while len(text) - at > PART and (m := _BLANK.search(text, at + PART)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at else [text]


def count_tokens(docs: DataFrame, tokenizer_path: str, over: int = 1024) -> DataFrame:
    """`docs` (doc_id, text, ...) with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > over) added.

    The counts are those of the library for the file at `tokenizer_path`, which the driver reads and sends out once (a few
    MB). Null and empty texts have no bytes and no tokens. Whole texts are read; a batch is handled in slices of about 2 MB
    or one text. Other columns pass through, but columns named like the new ones are replaced. Rows are neither joined nor
    shuffled.
    """
    sent = bounded(docs.sparkSession).broadcast(compiled(tokenizer_path))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")

    @frugal
    def run(batches):
        tokenizer = sent.value
        for batch in batches:
            at, _ = strings(batch.column("text"))
            counts = [tokenizer.count(texts_of(batch, a, b)) for a, b in slices(at, PART)]
            columns = [*batch.columns, pa.array(np.diff(at)), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added])).withColumn("over_limit", F.col("n_tokens") > over)
