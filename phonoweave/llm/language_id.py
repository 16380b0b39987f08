"""Language identification by a linear-chain conditional random field over the words of code-switched text.

Features of a word: letter n-grams with its edges marked (so affixes are n-grams at an edge) and the word itself (lexicon),
hashed into one weight table. Transitions between the languages of neighbouring words are learned. Forward-backward gives
each word's posteriors; a text gets the language of the highest mean posterior, which is its score. A text is one chain,
however long: what windows of its words do to a message is a small matrix, by which messages cross the windows' borders.

Posteriors only compare the learned languages. Whether a word is in any of them is told by its letters: the likelihood of
each next letter given two before, in the word's best language, against an unknown state in which all letters are as likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, frugal, mix64, slices, strings, texts_of

UND = "und"
TABLE_BITS = 16
#: Size of the tables of letter likelihoods, and the share of letters that a language leaves to chance.
LETTER_BITS, CHANCE = 18, 0.1
#: Words of a text that are passed one after the other; windows are handled side by side. Also the length of training samples.
WINDOW = 64
#: Bounds of the training sample: rows of each language, bytes of a row, samples made of them, passes over these.
ROWS_A_LANGUAGE, ROW_BYTES, TRAIN_WINDOWS, PASSES, RATE = 400, 1 << 16, 3000, 3, 0.05
#: Code points whose features are computed at once.
PART = 1 << 18
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


@dataclass
class Words:
    """Words of several texts: owner text, and hashed features by letter and by word."""

    text: np.ndarray
    starts: np.ndarray  # of each word, in the arrays by letter
    by_letter: list[np.ndarray]
    by_word: np.ndarray  # lexicon, prefix, suffix
    context: np.ndarray  # hash of each letter and the one before, of LETTER_BITS
    follows: np.ndarray  # and with the letter after


def read_words(texts: list[str]) -> Words:
    joined = "\0".join(texts).lower() + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    letters = letter_table()[codes]
    edge = np.diff(letters.astype(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    c = np.where(letters, codes, 1).astype(np.uint64)
    c = np.concatenate([np.ones(2, np.uint64), c])  # c[i + 2] is code i
    at = np.flatnonzero(letters) + 2
    mask = np.uint64((1 << TABLE_BITS) - 1)

    def hashed(h: np.ndarray, kind: int) -> np.ndarray:
        return ((h * _C[3]) >> np.uint64(29)) + np.uint64(kind) & mask

    two = c[at - 1] * _C[0] + c[at] * _C[1]
    last = c[at] * _C[0] + c[at + 1] * _C[1]
    three = two + c[at + 1] * _C[2]
    size = end - begin
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(starts, size)
    spelled = np.add.reduceat(mix64(c[at] + (place.astype(np.uint64) << np.uint64(32))), starts) if len(starts) else np.zeros(0, np.uint64)
    b, e = begin + 2, end + 2
    prefix = c[b] * _C[2] + np.where(size > 1, c[np.minimum(b + 1, e - 1)], 1) * _C[1] + np.where(size > 2, c[np.minimum(b + 2, e - 1)], 1) * _C[0]
    suffix = c[e - 1] * _C[2] + np.where(size > 1, c[np.maximum(e - 2, b)], 1) * _C[1] + np.where(size > 2, c[np.maximum(e - 3, b)], 1) * _C[0]
    zeros = np.flatnonzero(codes == 0)[: len(texts)]
    is_last = np.zeros(len(at), bool)
    is_last[np.cumsum(size) - 1] = True
    # A bigram at each letter; the last letter's bigram with the edge goes with the suffix.
    features = [hashed(two, 11), hashed(three, 23), hashed(c[at], 37)]
    context, follows = ((mix64(h) & np.uint64((1 << LETTER_BITS) - 1)).astype(np.int32) for h in (two, three))
    by_word = np.stack([hashed(spelled, 51), hashed(prefix, 67), hashed(suffix, 83), hashed(last[is_last], 97)], axis=1) if len(size) else np.zeros((0, 4), np.uint64)
    return Words(np.searchsorted(zeros, begin), starts, [f.astype(np.int32) for f in features], by_word.astype(np.int32), context, follows)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed feature by language
    transitions: np.ndarray  # log potentials, from by to
    letters: tuple[np.ndarray, np.ndarray] | None = None  # of letter_tables()

    def emissions(self, w: Words) -> np.ndarray:
        """Log potential of each word and language."""
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        at = self.weights[w.by_letter[0]]
        for f in w.by_letter[1:]:
            at += self.weights[f]
        out = np.add.reduceat(at, w.starts, axis=0)
        for k in range(w.by_word.shape[1]):
            out += self.weights[w.by_word[:, k]]
        return out

    def posteriors(self, emissions: np.ndarray, text: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Forward-backward over each text's words, one chain a text. Adds expected transitions to `pairs` if given."""
        n, k = emissions.shape
        if not n:
            return emissions
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        place = np.arange(n) - np.repeat(starts, np.diff([*starts, n]))
        begin = np.flatnonzero(place % WINDOW == 0)
        number, size = place[begin] // WINDOW, np.diff([*begin, n])  # of the window in its text
        order = np.argsort(-size, kind="stable")
        begin, size, number = begin[order], size[order], number[order]
        alive = [int(x) for x in np.searchsorted(-size, -np.arange(size[0]), side="left")]  # windows longer than t
        psi = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        move = np.exp(self.transitions - self.transitions.max()).astype(np.float32)
        prior, after = self._borders(psi, move, begin, alive, number, order)
        ahead = np.empty_like(psi)
        for t, m in enumerate(alive):
            i = begin[:m] + t
            a = psi[i] * (prior if t == 0 else ahead[i - 1] @ move)
            ahead[i] = a / a.sum(axis=1, keepdims=True)
        out, back = np.empty_like(psi), after
        first = number == 0
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            i = begin[:m] + t
            p = ahead[i] * back[:m]
            out[i] = p / p.sum(axis=1, keepdims=True)
            b = psi[i] * back[:m]
            if pairs is not None:
                inner = slice(None) if t else np.flatnonzero(~first[:m])  # a text's first word follows none
                x = ahead[i[inner] - 1][:, :, None] * move[None] * b[inner][:, None, :]
                pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ move.T
            back[:m] = b / b.sum(axis=1, keepdims=True)
        return out

    @staticmethod
    def _borders(psi, move, begin, alive, number, order) -> tuple[np.ndarray, np.ndarray]:
        """For each window, what comes into its first word from before, and into its last word from behind."""
        windows, k = len(begin), psi.shape[1]
        prior, after = np.ones((windows, k), np.float32), np.ones((windows, k), np.float32)
        if not number.any():
            return prior, after
        whole = psi[begin][:, :, None] * np.eye(k, dtype=np.float32)
        for t, m in enumerate(alive[1:], 1):
            x = (whole[:m].reshape(-1, k) @ move).reshape(m, k, k) * psi[begin[:m] + t][:, None, :]
            whole[:m] = x / x.max(axis=(1, 2), keepdims=True)
        row = np.empty(windows, np.int64)
        row[order] = np.arange(windows)  # of each window in the order of the words
        by_number = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[by_number], np.arange(int(number.max()) + 2))
        steps = [by_number[a:b] for a, b in zip(bounds[1:-1], bounds[2:], strict=True)]  # windows that have one before them
        for here in steps:
            before = row[order[here] - 1]
            x = (prior[before][:, None, :] @ whole[before])[:, 0] @ move
            prior[here] = x / x.sum(axis=1, keepdims=True)
        for here in reversed(steps):
            before = row[order[here] - 1]
            x = (whole[here] @ after[here][:, :, None])[:, :, 0] @ move.T
            after[before] = x / x.sum(axis=1, keepdims=True)
        return prior, after

    def known(self, w: Words, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and those in words that some language explains better than the unknown state."""
        if not len(w.starts) or self.letters is None:
            return np.zeros(n_texts), np.zeros(n_texts)
        after, before = self.letters
        each = np.log((1 - CHANCE) * after[w.follows] * before[w.context] + CHANCE)
        ratio = np.add.reduceat(each, w.starts, axis=0).max(axis=1)
        size = np.diff([*w.starts, len(w.follows)])
        return np.bincount(w.text, size, n_texts), np.bincount(w.text, size * (ratio > 0), n_texts)

    def words(self, texts: list[str], known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text of each word, posteriors of each word, share of known() letters of each text)."""
        owner, parts = [], []
        for i, t in enumerate(texts):
            for part in text_parts(t):
                owner.append(i)
                parts.append(part)
        text, emissions, letters, first = [], [], np.zeros((2, len(texts))), 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (last == first or size + len(parts[last]) <= PART):
                size += len(parts[last])
                last += 1
            w = read_words(parts[first:last])
            text.append(np.array(owner[first:last], np.int64)[w.text])
            emissions.append(self.emissions(w))
            if known:
                for row, n in zip(letters, self.known(w, last - first), strict=True):
                    np.add.at(row, owner[first:last], n)
            first = last
        if not parts:
            return np.zeros(0, np.int64), np.zeros((0, len(self.languages)), np.float32), letters[1]
        at = np.concatenate(text)
        return at, self.posteriors(np.concatenate(emissions), at), letters[1] / np.maximum(letters[0], 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 without a letter."""
        return self.predict_known(texts, False)[:2]

    def predict_known(self, texts: list[str], known: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and its share of letters in words of a known language; zeros if not `known`."""
        at, p, share = self.words(texts, known)
        total = np.stack([np.bincount(at, p[:, j], len(texts)) for j in range(p.shape[1])], axis=1)
        n = np.bincount(at, minlength=len(texts))
        best = total.argmax(axis=1)
        score = np.where(n > 0, total[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
        return [self.languages[b] if m else UND for b, m in zip(best, n, strict=True)], np.clip(score, 0, 1), share

    def spans(self, texts: list[str]) -> list[list[dict]]:
        """The runs of words of one language in each text: first word (from 0), number of words, language, mean posterior."""
        at, p, _ = self.words(texts)
        out: list[list[dict]] = [[] for _ in texts]
        if not len(at):
            return out
        best = p.argmax(axis=1)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (best[1:] != best[:-1])]))
        start = np.searchsorted(at, at[new], side="left")
        size = np.diff([*new, len(at)])
        score = np.add.reduceat(p[np.arange(len(at)), best].astype(np.float64), new) / size
        for i, a, s, n, y, v in zip(at[new].tolist(), new.tolist(), start.tolist(), size.tolist(), best[new].tolist(), score.tolist(), strict=True):
            out[i].append({"first": a - s, "words": n, "lang": self.languages[y], "score": min(1.0, v)})
        return out


def text_parts(text: str) -> list[str]:
    """The text in parts of about PART code points that end after a code point that is no letter."""
    out, at = [], 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def letter_tables(rows: list[tuple[str, str]], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """By hash and language: three letters' number by the unknown state's probability of a letter, and one by the number of the first two."""
    after, before = (np.zeros((1 << LETTER_BITS, len(languages)), np.float32) for _ in range(2))
    symbols = {ch for _, text in rows for ch in set(text.lower()) if ch.isalpha()}
    for j, lang in enumerate(languages):
        w = read_words([text for each, text in rows if each == lang])
        after[:, j] = np.bincount(w.follows, minlength=len(after)) * (len(symbols) + 1)  # a word may also end
        before[:, j] = 1 / np.maximum(np.bincount(w.context, minlength=len(before)), 1)
    return after, before


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """A model from (language, text) rows. Windows mix spans of several rows, so that switches are seen."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    index = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    model = Model(languages, np.zeros((1 << TABLE_BITS, k), np.float32), np.zeros((k, k)))
    pools: list[list[list[str]]] = [[] for _ in languages]
    table = letter_table()
    for lang, text in rows:
        codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).copy()  # first: lower-casing can part a word
        codes[~table[codes]] = 32
        if words := codes.tobytes().decode("utf-32-le").split():
            pools[index[lang]].append(words)
    have = [i for i, p in enumerate(pools) if p]
    if not have:
        return model
    model.letters = letter_tables(rows, languages)
    texts, gold = [], []
    for i in range(TRAIN_WINDOWS):
        words: list[str] = []
        own: list[int] = []
        while len(words) < WINDOW:
            lang = have[(i + len(own)) % len(have)] if not own else int(rng.choice(have))
            pool = pools[lang]
            doc = pool[int(rng.integers(len(pool)))]
            span = WINDOW if i % 2 == 0 else int(rng.integers(4, 40))
            a = int(rng.integers(max(1, len(doc) - span + 1)))
            part = doc[a : a + span][: WINDOW - len(words)]
            words += part
            own += [lang] * len(part)
            if i % 2 == 0:
                break
        texts.append(" ".join(words))
        gold.append(own)
    size = 100
    m1, m2 = np.zeros_like(model.weights), np.zeros_like(model.weights)
    t1, t2, step = np.zeros((k, k)), np.zeros((k, k)), 0
    order = np.arange(len(texts))
    for _ in range(PASSES):
        rng.shuffle(order)
        for a in range(0, len(order), size):
            part = order[a : a + size]
            w = read_words([texts[i] for i in part])
            labels = np.concatenate([gold[i] for i in part])
            if len(labels) != len(w.text):
                raise ValueError("the words of the training samples change when they are lower-cased again")
            pairs = np.zeros((k, k))
            error = model.posteriors(model.emissions(w), w.text, pairs)
            error[np.arange(len(labels)), labels] -= 1
            error /= len(labels)
            inside = w.text[1:] == w.text[:-1]
            np.subtract.at(pairs, (labels[:-1][inside], labels[1:][inside]), 1)
            grad = np.zeros_like(model.weights)
            sizes = np.diff([*w.starts, len(w.by_letter[0])])
            for j in range(k):
                each = np.repeat(error[:, j], sizes)
                for f in w.by_letter:
                    grad[:, j] += np.bincount(f, each, 1 << TABLE_BITS)
                for c in range(w.by_word.shape[1]):
                    grad[:, j] += np.bincount(w.by_word[:, c], error[:, j], 1 << TABLE_BITS)
            step += 1
            for x, g, u, v in ((model.weights, grad, m1, m2), (model.transitions, pairs / len(labels), t1, t2)):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                x -= RATE * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def learnable(doc_id: str = "doc_id", lang: str = "lang") -> Column:
    """Rows that may be learned from: a language is given and crc32 of the id as text, modulo 3, is not 1."""
    return F.col(lang).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % 3 != 1)


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, row_bytes: int = ROW_BYTES) -> Model:
    """A model from a sample of the learnable rows of at most `row_bytes` of text.

    About `rows_a_language` of each language are chosen by a hash of their id, at most twice that, so that the driver gets a
    bounded number of bytes. Without such rows the model has no language.
    """
    rows = docs.where(learnable() & (F.octet_length("text") <= row_bytes))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, rows_a_language / n).otherwise(share)
    sample = rows.where(uniform < share).select("lang", "text").limit(2 * rows_a_language * max(1, len(counts)))
    return train(sorted((r.lang, r.text) for r in sample.collect()))


def _texts(batch: pa.RecordBatch):
    """(first row, texts) of a batch, about SLICE_BYTES at a time. Texts are divided by NUL, so a NUL in one becomes a blank."""
    at, _ = strings(batch.column("text"))
    for a, b in slices(at):
        yield a, [t.replace("\0", " ") for t in texts_of(batch, a, b)]


def identify(docs: DataFrame, model: Model, known: bool = False) -> DataFrame:
    """`docs` with lang_pred and score added, and the share of known letters if `known` (columns of these names are replaced).

    Only text is looked at, all of it. Null, empty and letterless texts are `und` with score 0, and so is every text if
    nothing could be learned. One pass, no shuffle; the model (a few MB at most) goes to all executors.
    """
    added = ["score", "known"] if known else ["score"]
    docs = docs.drop("lang_pred", *added)
    sent = bounded(docs.sparkSession).broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), *(T.StructField(x, T.DoubleType()) for x in added)])

    @frugal
    def run(batches):
        m = sent.value
        for batch in batches:
            langs, numbers = [], [np.zeros((len(added), 0))]
            for _, texts in _texts(batch):
                found, *values = m.predict_known(texts, known) if m.languages else ([UND] * len(texts), *np.zeros((2, len(texts))))
                langs += found
                numbers.append(np.stack(values[: len(added)]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), *map(pa.array, np.concatenate(numbers, axis=1))], [*batch.schema.names, "lang_pred", *added])

    return docs.mapInArrow(run, schema)


SPAN = "array<struct<first:int,words:int,lang:string,score:double>>"


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of every row of `docs` (doc_id, text): the runs of words of one language, in order.

    Words are runs of letters of the lower-cased text, counted from 0. Null, empty and letterless texts have no span, nor
    has any text if nothing could be learned.
    """
    sent = bounded(docs.sparkSession).broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))

    @frugal
    def run(batches):
        m = sent.value
        for batch in batches:
            for a, texts in _texts(batch):
                found = m.spans(texts) if m.languages else [[] for _ in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPAN}")
