"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence's score is the logistic of a bias and the weights of its words, and a document is toxic if any sentence is:
p = 1 - prod(1 - p_sentence). The same sentence scores then tell where the offence is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, about (hashed choice; all with fewer).
SAMPLE_DOCS = 8000
#: Characters of texts that are brought to the driver for fitting, about: longer documents make the sample smaller.
SAMPLE_CHARS = 1 << 26
#: Features kept: those most tied to the label, with at least MIN_DOCS documents.
FEATURES, MIN_DOCS = 4096, 8
STEPS, RATE, DECAY = 400, 0.1, 3e-5
#: Tokens, and characters of them, that a Python worker remembers; beyond either it starts anew.
_CACHE, _CACHE_CHARS = 700_000, 1 << 23
#: Features of a word at most (see features_of).
_WORD_FEATURES = 4
_TOKEN = re.compile(r"\n|\S+")
_ENDS = (".", "!", "?", "…", "。")


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased tokens of a text; a new line is a token of its own (a NUL)."""
    return (text or "").lower().replace("\n", " \x00 ").split()


def features_of(token: str) -> list[str]:
    """A word's features: itself and its beginnings of 4 to 6 letters, of its letters alone."""
    w = token if token.isalpha() else "".join(c for c in token if c.isalpha())
    return [w, *(f"{w[:k]}-" for k in (4, 5, 6) if len(w) > k)] if w else []


def ends_sentence(token: str) -> bool:
    return token == "\x00" or token.endswith(_ENDS)


class Model:
    def __init__(self, number: dict[str, int], weight: np.ndarray, bias: float, prior: float):
        self.number, self.weight, self.bias, self.prior = number, weight, bias, prior
        self._weights: _Weights | None = None

    def weights(self) -> _Weights:
        """The worker's table of token weights, which lives as long as the worker's copy of the model."""
        if self._weights is None:
            self._weights = _Weights(self)
        return self._weights

    def token_features(self, token: str) -> list[int]:
        """The numbers of the token's features that the model knows."""
        return sorted({k for f in features_of(token) if (k := self.number.get(f)) is not None})

    def token_weight(self, token: str) -> float:
        return float(self.weight[self.token_features(token)].sum())

    @classmethod
    def fit(cls, rows: Iterator[tuple[str, int]]) -> Model:
        """rows: (text, label 0 or 1). Keeps for each document only its sentences' known features."""
        docs, labels, seen, toxic = [], [], Counter(), Counter()
        cache: dict[str, list[str]] = {}
        for text, label in rows:
            sentences, now = [], []
            for t in tokens_of(text):
                if (f := cache.get(t)) is None:
                    f = cache[t] = features_of(t)
                now += f
                if ends_sentence(t):
                    sentences.append(list(dict.fromkeys(now)))
                    now = []
            sentences.append(list(dict.fromkeys(now)))
            own = {f for s in sentences for f in s}
            seen.update(own)
            if label:
                toxic.update(own)
            docs.append(sentences)
            labels.append(label)
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            prior = float(y.mean()) if len(y) else 0.0
            return cls({}, np.zeros(0), 0.0, prior)
        prior = float(y.mean())

        def tie(f: str) -> float:
            n, k = seen[f], toxic[f]
            return (k - n * prior) ** 2 / (n * prior * (1 - prior))

        names = sorted((f for f, n in seen.items() if n >= MIN_DOCS), key=lambda f: (-tie(f), f))[:FEATURES]
        number = {f: k for k, f in enumerate(names)}
        sentence, feature, doc_of, at = [], [], [], 0
        for d, sentences in enumerate(docs):
            for s in sentences:
                if known := [number[f] for f in s if f in number]:
                    sentence += [at] * len(known)
                    feature += known
                doc_of.append(d)
                at += 1
        return cls._descend(number, np.array(sentence, np.int64), np.array(feature, np.int64), np.array(doc_of, np.int64), y, prior)

    @classmethod
    def _descend(cls, number, sentence, feature, doc_of, y, prior) -> Model:
        """Full-batch Adam on the noisy-or's log likelihood, with a small weight decay."""
        per_doc = np.bincount(doc_of, minlength=len(y))
        w = np.zeros(len(number) + 1)
        w[-1] = np.log(prior / max(1.0, per_doc.mean()))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            z = w[-1] + np.bincount(sentence, w[feature], len(doc_of))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of no toxic sentence
            whole = np.clip(-np.expm1(none), 1e-9, 1)
            # d(log likelihood)/dz: p for clean documents, -p * (1 - whole) / whole for toxic ones
            slope = np.where(y > 0, -np.exp(none) / whole, 1.0)[doc_of] * p
            g = np.append(np.bincount(feature, slope[sentence], len(number)), slope.sum()) / len(y)
            g[:-1] += DECAY * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(number, w[:-1], float(w[-1]), prior)


class _Weights(dict):
    """Token -> row of growing tables: its features (-1: none), and whether it ends a sentence."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.features, self.ends, self.chars = np.zeros((0, _WORD_FEATURES), np.int32), np.zeros(0, bool), 0

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) > _CACHE or self.chars > _CACHE_CHARS:
            self.clear()
            self._empty()
        new = [t for t in dict.fromkeys(tokens) if t not in self]
        features = np.full((len(new), _WORD_FEATURES), -1, np.int32)
        for i, t in enumerate(new):
            own = self.model.token_features(t)
            features[i, : len(own)] = own
            self[t] = len(self)
        self.chars += sum(map(len, new))
        self.features = np.concatenate([self.features, features])
        self.ends = np.concatenate([self.ends, np.fromiter(map(ends_sentence, new), bool, len(new))])
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def sentence_logits(model: Model, features: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """The logits of n sentences from their tokens' features (-1: none): a feature counts once in a sentence, whichever of its
    tokens have it, as when fitting."""
    token, place = np.nonzero(features >= 0)
    width = max(1, len(model.number))
    pair = np.unique(sentence[token] * width + features[token, place])
    return model.bias + np.bincount(pair // width, model.weight[pair % width], n)


def sentence_spans(text: str, numbers: set[int]) -> dict[int, tuple[int, int]]:
    """Where the sentences of these numbers begin and end (exclusive) in a text, in code points; one without words is empty."""
    out: dict[int, tuple[int, int]] = {}
    number, start, end = 0, None, 0
    for m in _TOKEN.finditer(text + "\n"):
        line = m[0] == "\n"
        if not line:
            start, end = m.start() if start is None else start, m.end()
        if ends_sentence("\x00" if line else m[0].lower()):
            if number in numbers:
                out[number] = (start, end) if start is not None else (m.start(), m.start())
            number, start = number + 1, None
    return out


def _score(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.weights()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row = 0
            while row < len(texts):
                tokens, first, size, to = [], [0], 0, row
                while to < len(texts) and (to == row or size < 1 << 21):
                    tokens += [*tokens_of(texts[to]), "\x00"]  # every text ends a sentence
                    size += len(texts[to] or "")
                    first.append(len(tokens))
                    to += 1
                k = weights.rows(tokens)
                end = np.flatnonzero(weights.ends[k]) + 1
                start = np.concatenate([[0], end[:-1]])
                told = np.flatnonzero(weights.features[k, 0] >= 0)
                z = sentence_logits(model, weights.features[k[told]], np.searchsorted(start, told, "right") - 1, len(start))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                doc = np.searchsorted(first, start, "right") - 1
                n = to - row
                score = np.clip(-np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)), 0, 1)
                if not model.number:
                    score = np.full(n, model.prior)
                head = np.searchsorted(doc, np.arange(n))
                bad = np.flatnonzero(p >= least)
                number, upto = bad - head[doc[bad]], np.searchsorted(doc[bad], np.arange(n + 1)).astype(np.int32)
                spans = []
                for i in np.unique(doc[bad]).tolist():
                    own = number[upto[i] : upto[i + 1]].tolist()
                    found = sentence_spans(texts[row + i] or "", set(own))
                    spans += [(*found[x], (texts[row + i] or "")[slice(*found[x])]) for x in own]
                columns = [pa.array(number), *(pa.array([x[c] for x in spans], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string())))]
                lists = [pa.ListArray.from_arrays(pa.array(upto), c) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(score), *lists], ["doc_id", "score", "sentences", "sentence_starts", "sentence_ends", "sentence_texts"]
                )
                row = to

    return run


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def _up_to(rows: Iterator[tuple[str, int]], chars: int) -> Iterator[tuple[str, int]]:
    for text, y in rows:
        chars -= len(text)
        if chars < 0:
            return
        yield text, y


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits the model on about sample_docs labelled documents, chosen and ordered by a hash of doc_id, of the rows where train
    holds; on fewer if the first of them have sample_chars characters already. Documents that alone have more than an eighth
    of sample_chars aren't fitted on.

    Null labels and texts are passed over. Without both labels the score is their share everywhere.
    """
    y = labels.where(train & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).cast("int").alias("y"))
    n, span = y.count(), 1 << 30
    share = min(span, -(-sample_docs * span // max(1, n)))
    place = F.xxhash64("doc_id", F.lit(9))
    y = y.where(F.pmod(place, F.lit(span)) < share)
    texts = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= sample_chars // 8)).select("doc_id", "text")
    rows = texts.join(y, "doc_id").select("text", "y", place.alias("place")).orderBy("place", "text", "y")
    return Model.fit(_up_to(((r.text, r.y) for r in rows.toLocalIterator()), sample_chars))


def toxicity(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """docs -> (doc_id, score, predicted, sentences, sentence_starts, sentence_ends, sentence_texts): the chance that the whole text is
    toxic, whether it is `least` or more, and of the sentences that reach `least` by themselves the numbers (from 0), their places in
    code points (ends exclusive), and these parts of the text.

    Sentences end at new lines and after words that end in a full stop, '!', '?' or the like. Null and empty texts have
    one empty sentence and so the lowest score. Null ids and repeated rows are kept, other columns ignored, an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = "doc_id long, score double, sentences array<long>, sentence_starts array<long>, sentence_ends array<long>, sentence_texts array<string>"
    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(shared, least), shape)
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
