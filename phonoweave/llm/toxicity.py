"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in NumPy.

A word enters by an embedding of its own and by those of its character n-grams. Both directions run over windows of words
that overlap; attention pools a window's states into one logit. Only documents are labelled, so training takes a document as
toxic if any of its windows is (noisy or), while the score of a document is that of its worst window. Texts stay where they
are: the fitted network goes to the tasks, and all windows of some texts run through it together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, frugal, mix64, strings
from .divergence import terms_of

#: Sizes of the network: cells a direction, embedding, rows of the tables of words and of n-grams, lengths of n-grams in bytes.
CELLS, WIDTH, WORD_ROWS, GRAM_ROWS, GRAMS = 8, 8, 1 << 15, 1 << 17, (4, 6)
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Bounds of the labelled sample: rows of each label, bytes of a row; passes over it, documents a step, rate of learning.
ROWS_A_LABEL, ROW_BYTES, PASSES, DOCS_A_STEP, RATE = 1200, 1 << 13, 6, 32, 0.01
#: Windows that run through the network together.
WINDOWS_AT_ONCE = 4096
_OPEN, _CLOSE = 1, 2


def grams_of(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the n-gram table, how many each word has): n-grams of bytes between a mark before the word and one after."""
    ends = np.cumsum(size + 2)
    at = ends - size - 2
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[at], text[ends - 1] = _OPEN, _CLOSE
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(at + 1, size) + place] = raw[np.repeat(begin, size) + place]
    left = np.repeat(ends, size + 2) - np.arange(len(text))
    word = np.repeat(np.arange(len(size)), size + 2)
    code, keys, owner = np.zeros(len(text), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        code[: len(text) - n + 1] = code[: len(text) - n + 1] << np.uint64(8) | text[n - 1 :]
        if n in GRAMS:
            own = np.flatnonzero(left >= n)
            keys.append(mix64(code[own] + np.uint64(n << 56)))
            owner.append(word[own])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (keys[order] & np.uint64(GRAM_ROWS - 1)).astype(np.int64), np.bincount(owner, minlength=len(size))


@dataclass
class Words:
    """The distinct words of some texts: their rows in the tables, and for each text the numbers of its words."""

    rows: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    lengths: np.ndarray


def words_of(raw: np.ndarray, h: np.ndarray, begin: np.ndarray, size: np.ndarray, text: np.ndarray, first: int, last: int) -> Words:
    order, start = distinct(h)
    lead = order[start]
    number = np.empty(len(h), np.int64)
    number[order] = np.repeat(np.arange(len(lead)), np.diff(start, append=len(order)))
    if not len(h):
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        grams, counts = grams_of(raw, begin[lead], size[lead])
    return Words((h[lead] >> np.uint64(20) & np.uint64(WORD_ROWS - 1)).astype(np.int64), grams, counts, number, np.bincount(text - first, minlength=last - first))


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; a text without words has one empty window."""
    times = np.maximum(1, -(-(lengths - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(lengths)), times)
    step = (np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)) * STRIDE
    return text, (np.cumsum(lengths) - lengths)[text] + step, np.minimum(WINDOW, lengths[text] - step)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sigmoid_into(x: np.ndarray) -> None:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Network:
    """The parameters, what they make of windows, and the gradient."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        some = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {
            "words": np.zeros((WORD_ROWS, WIDTH), np.float32), "grams": np.zeros((GRAM_ROWS, WIDTH), np.float32),
            "enter": some(WIDTH, 6 * CELLS, scale=0.3), "bias": np.zeros(6 * CELLS, np.float32), "turn": some(2, CELLS, 3 * CELLS, scale=0.3),
            "look": some(2 * CELLS, scale=0.3), "out": some(2 * CELLS, scale=0.5), "level": np.full(1, -3.0, np.float32),
        }

    def vectors(self, w: Words) -> np.ndarray:
        x = self.p["words"][w.rows]
        there = np.flatnonzero(w.counts)  # a short word has no n-gram
        if len(there):
            n = w.counts[there]
            x[there] += np.add.reduceat(self.p["grams"][w.grams], np.cumsum(n) - n) / np.sqrt(n)[:, None].astype(np.float32)
        return x

    def entries(self, w: Words) -> np.ndarray:
        """What each distinct word gives to the gates of both directions (rows: gates), and the last column for a place without a word."""
        gates = np.zeros((6 * CELLS, len(w.rows) + 1), np.float32)
        np.matmul(self.p["enter"].T, self.vectors(w).T, out=gates[:, :-1])
        gates[:, :-1] += self.p["bias"][:, None]
        return gates

    def forward(self, gates: np.ndarray, number: np.ndarray, begin: np.ndarray, room: np.ndarray, keep: bool = False):
        """The logits of windows; with `keep`, what the gradient needs. Arrays are cells by windows."""
        c, n, p = CELLS, len(begin), self.p
        long = int(room.max(initial=0))
        states, kept = np.zeros((long, 2 * c, n), np.float32), []
        there = np.arange(long)[:, None] < room
        whole = there.all(axis=1)
        at = np.where(there, number[np.minimum(begin + np.arange(long)[:, None], max(0, len(number) - 1))] if len(number) else -1, gates.shape[1] - 1)
        for side in (0, 1):
            own, turn = np.ascontiguousarray(gates[3 * c * side : 3 * c * (side + 1)]), np.ascontiguousarray(p["turn"][side].T)
            h = np.zeros((c, n), np.float32)
            for t in range(long) if side == 0 else range(long - 1, -1, -1):
                a, x = turn @ h, np.take(own, at[t], axis=1)
                rz = x[: 2 * c]
                rz += a[: 2 * c]
                _sigmoid_into(rz)
                new = rz[:c] * a[2 * c :]
                new += x[2 * c :]
                np.tanh(new, out=new)
                if keep:
                    kept.append((side, t, h, rz[:c], rz[c:], new, a[2 * c :]))
                step = h - new
                step *= rz[c:]
                step += new
                h = step if whole[t] else np.where(there[t], step, h)
                states[t, c * side : c * (side + 1)] = h
        e = np.where(there, np.matmul(p["look"], states), np.float32(-1e9))
        e = np.exp(e - e.max(axis=0, initial=-1e9)) * there
        weight = e / np.maximum(e.sum(axis=0), np.float32(1e-30))
        pooled = (weight[:, None] * states).sum(axis=0)
        logit = p["out"] @ pooled + p["level"][0]
        return (logit, (kept, states, there, at, weight, pooled)) if keep else logit

    def backward(self, w: Words, gates: np.ndarray, what: tuple, slope: np.ndarray) -> dict:
        """The gradient of the sum of slope * logit, for tables as (rows, values)."""
        kept, states, there, at, weight, pooled = what
        c, p, g = CELLS, self.p, {}
        g["level"], g["out"] = np.array([slope.sum()], np.float32), pooled @ slope
        d_pooled = p["out"][:, None] * slope
        d_weight = (d_pooled * states).sum(axis=1)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["look"] = (d_e[:, None] * states).sum(axis=(0, 2))
        g["turn"], d_gates = np.zeros_like(p["turn"]), np.zeros_like(gates.T)
        carry, found = [np.zeros((c, len(slope)), np.float32) for _ in (0, 1)], ([], [])
        for side, t, h, r, z, new, a in reversed(kept):
            part = slice(c * side, c * (side + 1))
            d = carry[side] + weight[t] * d_pooled[part] + d_e[t] * p["look"][part, None]
            d_new = d * (1 - z) * (1 - new * new)
            d_x = np.concatenate([d_new * a * r * (1 - r), d * (h - new) * z * (1 - z), d_new]) * there[t]
            d_a = d_x.copy()
            d_a[2 * c :] *= r
            g["turn"][side] += h @ d_a.T
            carry[side] = np.where(there[t], d * z + p["turn"][side] @ d_a, d)
            found[side].append((at[t], d_x.T))
        for side in (0, 1):
            if found[side]:
                where, sums = _summed(*(np.concatenate(x) for x in zip(*found[side], strict=True)))
                d_gates[where, 3 * c * side : 3 * c * (side + 1)] += sums
        d_gates = d_gates[:-1]
        g["enter"], g["bias"] = self.vectors(w).T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["enter"].T
        g["words"] = _summed(w.rows, d_x)
        g["grams"] = _summed(w.grams, np.repeat(d_x / np.sqrt(np.maximum(w.counts, 1))[:, None].astype(np.float32), w.counts, axis=0))
        return g

    def scores(self, w: Words) -> np.ndarray:
        """The score of each text: that of its worst window."""
        text, begin, room = windows_of(w.lengths)
        gates, worst = self.entries(w), np.full(len(w.lengths), -np.inf, np.float32)
        for a in range(0, len(text), WINDOWS_AT_ONCE):
            part = slice(a, a + WINDOWS_AT_ONCE)
            np.maximum.at(worst, text[part], self.forward(gates, w.number, begin[part], room[part]))
        return _sigmoid(worst.astype(np.float64))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(rows):
        return rows, values
    order, first = distinct(rows)
    return rows[order[first]], np.add.reduceat(values[order], first)


class Adam:
    def __init__(self, p: dict):
        self.p, self.step = p, 0
        self.one, self.two = ({k: np.zeros_like(v) for k, v in p.items()} for _ in (0, 1))

    def move(self, g: dict) -> None:
        """Rows of tables without a gradient stay as they are."""
        self.step += 1
        size = RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k, d in g.items():
            at, d = d if isinstance(d, tuple) else (slice(None), d)
            self.one[k][at] = 0.9 * self.one[k][at] + np.float32(0.1) * d
            self.two[k][at] = 0.99 * self.two[k][at] + np.float32(0.01) * d * d
            self.p[k][at] -= (size * self.one[k][at] / (np.sqrt(self.two[k][at]) + 1e-6)).astype(np.float32)


def train(rows: list[tuple[int, str]], seed: int = 5, passes: int = PASSES) -> Network:
    """From (label, text) rows; label 1 is toxic. Without both labels the network stays at a low score."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if len({y for y, _ in rows}) < 2:
        return net
    adam, label = Adam(net.p), np.array([y for y, _ in rows])
    raws = [t.encode() for _, t in rows]
    # longer passes for small samples, so that the number of steps has a floor
    for _ in range(max(passes, -(-passes * 600 // len(rows)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), DOCS_A_STEP):
            part = order[a : a + DOCS_A_STEP]
            at = np.cumsum([0, *(len(raws[i]) for i in part)])
            for raw, h, begin, size, text in terms_of(at, np.frombuffer(b"".join(raws[i] for i in part), np.uint8)):
                low, high = (int(text.min()), int(text.max()) + 1) if len(text) else (0, 0)
                if low == high:
                    continue
                w = words_of(raw, h, begin, size, text, low, high)
                owner, first, room = windows_of(w.lengths)
                gates = net.entries(w)
                logit, what = net.forward(gates, w.number, first, room, keep=True)
                total = np.bincount(owner, np.logaddexp(0, logit.astype(np.float64)), minlength=high - low)  # -log of no window being toxic
                y = label[part[low:high]]
                per_doc = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) / len(part)
                net_slope = (per_doc[owner] * _sigmoid(logit.astype(np.float64))).astype(np.float32)
                adam.move(net.backward(w, gates, what, net_slope))
    return net


def fit(docs: DataFrame, labels: DataFrame, label: Column, learn: Column, rows_a_label: int = ROWS_A_LABEL, row_bytes: int = ROW_BYTES) -> Network:
    """A network from a sample of the labelled rows of at most `row_bytes` of text.

    `labels` has doc_id and the columns of `label` (1 is toxic; rows of null are no labels) and `learn` (which rows may be
    used). About `rows_a_label` of each label are chosen by a hash of their id, at most twice that, so the ids may go to all
    executors and the driver gets a bounded number of bytes.
    """
    known = labels.where(learn).select("doc_id", label.cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").dropDuplicates(["doc_id"])
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    uniform, share = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) / float(1 << 30), F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("label") == name, rows_a_label / n).otherwise(share)
    sample = known.where(uniform < share).limit(4 * rows_a_label)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= row_bytes).join(F.broadcast(sample), "doc_id").limit(8 * rows_a_label)
    return train(sorted((r.label, r.text) for r in texts.select("label", "text").collect()))


def score_batch(net: Network, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The scores of the texts, for some rows after the others."""
    done, n = 0, batch.num_rows
    for raw, h, begin, size, text in terms_of(*strings(batch.column("text"))):
        if len(text):  # rows without a word are no part of any group, or at its ends
            last = int(text[-1]) + 1
            yield net.scores(words_of(raw, h, begin, size, text, done, last))
            done = last
    if done < n:
        none = np.zeros(0, np.int64)
        yield net.scores(words_of(np.zeros(0, np.uint8), none.astype(np.uint64), none, none, none + done, done, n))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """`docs` (doc_id, text, ...) with score (0 to 1): doc_id and score only.

    The whole text counts, in windows of WINDOW words that start every STRIDE. Words are runs of letters of any but ASCII's
    other characters, A-Z lower-cased. Null and empty texts, and those without a word, have one empty window. Equal texts
    have equal scores up to rounding; repeated rows and ids are scored each; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @frugal
    def run(batches):
        own = sent.value
        for batch in batches:
            scores = [np.zeros(0), *score_batch(own, batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
