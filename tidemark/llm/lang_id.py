"""Language ID by unigram models over a fixed public piece vocabulary, summed over all segmentations.

The likelihood of a word under a language is the sum over all its segmentations into pieces of the product of the
pieces' probabilities (forward algorithm). Piece probabilities come from a few rounds of expectation-maximisation
(forward-backward) on the words of a bounded sample of labelled documents.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import NOT_SPACE, Growing, WordNumbers, Words, byte_slices, hold_only, mix, row_slices, words_of

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that the models are fitted on, about (hashed choice; all of a language with fewer).
SAMPLE_DOCS = 1000
ROUNDS = 4
#: Runs of up to so many letters are scored many at a time; longer ones one by one, in a window of the longest piece. Fitting
#: cuts longer runs into parts of this size.
WORD_CHARS = 24
_UNKNOWN = 1e-7  # probability of a single character that no piece covers
#: Words, and bytes of them, whose scores a Python worker remembers (from task to task); beyond either it starts anew.
_CACHE, _CACHE_BYTES = 350_000, 1 << 23
#: Words of one lattice, which bounds its memory.
LATTICE_WORDS = 4096
_START = "▁"
_SCALE, _LOG_SCALE = 1e100, 100 * math.log(10)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_pieces(path: str) -> dict[str, int]:
    """Piece -> number, lower-cased; pieces of letters only, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        if p.lstrip(_START).isalpha() and p.count(_START) <= 1:
            pieces.setdefault(p, len(pieces))
    return pieces


def runs_of_letters(token: str) -> list[str]:
    """The runs of letters (and marks) of a token, lower-cased, in composed form."""
    token = unicodedata.normalize("NFC", token.lower())
    if not token.isalpha():
        token = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in token)
    return [w for w in token.split() if any(map(str.isalpha, w))]


def score_long(word: str, pieces: dict[str, int], p: list[list[float]]) -> list[float]:
    """The log likelihood, by language, of one word of any length: the forward sums of the last few places only, scaled up
    whenever they have become small. p: by piece, then language. In time proportional to the word's length."""
    longest, get = max(map(len, pieces), default=1), pieces.get
    langs = range(len(p[0]))
    word = _START + word
    window, scale = deque([[1.0] * len(langs)], maxlen=longest), [0.0] * len(langs)
    for end in range(1, len(word) + 1):
        total = [0.0] * len(langs)
        for back, before in enumerate(reversed(window), 1):
            k = get(word[end - back : end])
            if k is None:
                if back > 1:
                    continue
                k = len(pieces)
            chance = p[k]
            for i in langs:
                total[i] += before[i] * chance[i]
        window.append(total)
        for i in langs:
            if total[i] < 1e-100:
                scale[i] += _LOG_SCALE
                for w in window:
                    w[i] *= _SCALE
    return [math.log(max(w, 1e-300)) - s for w, s in zip(window[-1], scale, strict=True)]


class PieceTable:
    """The pieces' hashes, sorted, with their numbers: finds the pieces among all spans of a length at once."""

    def __init__(self, pieces: dict[str, int]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        names = list(pieces)
        data, start = codes(names)
        h = CodeSpans(data).hash(start[:-1], start[1:])
        order = np.argsort(h)
        self.hash, self.number = h[order], np.fromiter((pieces[x] for x in names), np.int64, len(names))[order]
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.screen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
            same = self.hash[at] == h[maybe]
            out[maybe[same]] = self.number[at[same]]
        return out


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, where each begins, with one more entry at the end)."""
    data = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


class CodeSpans:
    """Hashes of spans of code points, by prefix sums of a polynomial over mixed values."""

    def __init__(self, data: np.ndarray):
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(data), b, np.uint64)]))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64) + np.uint64(77)) * powers(base)[:-1], out=self.total[1:])
        self.inverse = powers(np.uint64(pow(int(base), -1, 2**64)))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Lattice:
    """All pieces of all words, grouped by their end place: for each place, (word, start, piece) arrays."""

    def __init__(self, words: list[str], pieces: dict[str, int], table: PieceTable | None = None):
        table = table or PieceTable(pieces)
        data, begin = codes([_START + w for w in words])
        self.n, self.lengths = len(words), np.diff(begin)
        owner = np.repeat(np.arange(self.n), self.lengths)
        place = np.arange(len(data)) - begin[owner]
        left = self.lengths[owner] - place  # places from here to the word's end
        edges, spans = [], CodeSpans(data)
        for size in range(1, table.longest + 1):
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            piece = table.find(spans.hash(at, at + size))
            if size == 1:
                piece[piece < 0] = table.unknown
            keep = np.flatnonzero(piece >= 0)
            at = at[keep]
            edges.append((place[at] + size, owner[at], place[at], piece[keep]))
        end, *rest = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*edges, strict=True) if edges else [[]] * 4))
        order = np.argsort(end, kind="stable")
        ends, first = np.unique(end[order], return_index=True)
        last = [*first[1:], len(end)]
        self.steps = [(int(e), *(x[order[a:b]] for x in rest)) for e, a, b in zip(ends, first, last, strict=True)]
        self.width = int(self.lengths.max(initial=0)) + 1

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(words, places, languages) of p (pieces, languages)."""
        a = np.zeros((self.n, self.width, p.shape[1]))
        a[:, 0] = 1
        for e, word, start, piece in self.steps:
            v = a[word, start] * p[piece]
            for k in range(p.shape[1]):
                a[:, e, k] = np.bincount(word, v[:, k], self.n)
        return a

    def score(self, p: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, p.shape[1]))
        return np.log(np.maximum(self.forward(p)[np.arange(self.n), self.lengths], 1e-300))

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language (pieces,), of p (pieces,) and the words' counts."""
        a = self.forward(p[:, None])[:, :, 0]
        total = np.maximum(a[np.arange(self.n), self.lengths], 1e-300)
        b = np.zeros_like(a)
        b[np.arange(self.n), self.lengths] = weight / total
        out = np.zeros(len(p))
        for e, word, start, piece in reversed(self.steps):
            flow = b[word, e] * p[piece]
            np.add.at(b, (word, start), flow)
            out += np.bincount(piece, a[word, start] * flow, len(p))
        return out


class Model:
    def __init__(self, langs: list[str], pieces: dict[str, int], p: np.ndarray):
        self.langs, self.pieces, self.p, self.table = langs, pieces, p, PieceTable(pieces)
        self._scores: _Scores | None = None

    def scores(self) -> _Scores:
        """The worker's table of word scores, which lives as long as the worker's copy of the model."""
        if self._scores is None:
            self._scores = _Scores(self)
        hold_only(self._scores)
        return self._scores

    @classmethod
    def fit(cls, rows: Iterator[tuple[str, str]], pieces: dict[str, int]) -> Model:
        """rows: (lang, text)."""
        counts: dict[str, Counter] = {}
        for lang, text in rows:
            counts.setdefault(lang, Counter()).update(text.lower().split())
        langs = sorted(counts)
        p = np.zeros((len(pieces) + 1, max(1, len(langs))))
        for k, lang in enumerate(langs):
            words: Counter = Counter()
            for token, n in counts[lang].items():
                for w in runs_of_letters(token):
                    for i in range(0, len(w), WORD_CHARS):
                        words[w[i : i + WORD_CHARS]] += n
            lattice, weight = Lattice(list(words), pieces), np.array(list(words.values()), float)
            q = np.full(len(pieces) + 1, 1 / (len(pieces) + 1))
            q[-1] = _UNKNOWN
            for _ in range(ROUNDS if words else 0):
                q = lattice.expected(q, weight) + 0.01
                q[-1] = 0
                q = q / q.sum()
                q[-1] = _UNKNOWN
            p[:, k] = q
        return cls(langs, pieces, p)


class _Scores:
    """A worker's table of (has a letter, score per language) of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.plain = model, model.p.tolist()
        self.clear()

    def clear(self) -> None:
        self.words = WordNumbers(_CACHE, _CACHE_BYTES)
        self.table = Growing((len(self.model.langs) + 1,), np.float64)

    def rows(self, words: Words) -> np.ndarray:
        """(words, 1 + languages)."""
        if self.words.full():
            self.clear()
        number, new = self.words.find(words)
        parts = [runs_of_letters(t) for t in new]
        runs = list(dict.fromkeys(w for p in parts for w in p))
        score = np.zeros((len(runs), len(self.model.langs)))
        short = [i for i, w in enumerate(runs) if len(w) <= WORD_CHARS]
        for at in range(0, len(short), LATTICE_WORDS):
            some = short[at : at + LATTICE_WORDS]
            score[some] = Lattice([runs[i] for i in some], self.model.pieces, self.model.table).score(self.model.p)[:, : score.shape[1]]
        for i, w in enumerate(runs):
            if len(w) > WORD_CHARS and self.model.langs:
                score[i] = score_long(w, self.model.pieces, self.plain)
        place = {w: i for i, w in enumerate(runs)}
        s = np.zeros((len(new), 1 + score.shape[1]))
        owner = np.array([(i, place[w]) for i, p in enumerate(parts) for w in p], np.int64).reshape(-1, 2)
        np.add.at(s[:, 1:], owner[:, 0], score[owner[:, 1]])
        s[owner[:, 0], 0] = 1
        self.table.add(s)
        return self.table.rows[number]


def _labels(scores: _Scores, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    langs = np.array([*scores.model.langs, "und"], object)
    found, score = [], [np.zeros(0)]
    for _, _, data, offsets in byte_slices(texts):
        w = words_of(data, offsets, NOT_SPACE, lower=False)
        rows = scores.rows(w)
        running = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
        x = np.diff(running[w.first], axis=0)
        told = (x[:, 0] > 0.5) & bool(scores.model.langs)
        best, chance = np.full(len(x), len(langs) - 1), np.zeros(len(x))
        if told.any():
            y = x[told, 1:]
            best[told], chance[told] = y.argmax(1), 1 / np.exp(y - y.max(1, keepdims=True)).sum(1)
        found += langs[best].tolist()
        score.append(chance)
    return found, np.concatenate(score)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scores()
        for batch in batches:
            lang, score = _labels(scores, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _identified(shared, column: str, langs: frozenset[str] | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value.scores()
        for batch in (part for whole in batches for part in row_slices(whole)):
            lang, score = _labels(scores, batch.column(column).cast(pa.string()))
            yield batch.filter(pa.array([x != "und" and (langs is None or x in langs) and s >= least for x, s in zip(lang, score.tolist(), strict=True)], pa.bool_()))

    return run


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def fit_languages(docs: DataFrame, train: Column, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fits the models on about sample_docs documents of each label in `lang`, of the rows where train holds.

    The choice is by a hash of doc_id, so that it doesn't depend on how rows are dealt. Rows with a null lang or text
    are passed over. Without any such row the model has no language and every text gets `und`.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    span = 1 << 30
    chosen = F.lit(False)
    for lang, n in counts.items():
        share = min(span, -(-sample_docs * span // n))
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(span)) < share))
    sample = rows.where(chosen).select("lang", "text").toLocalIterator()
    return Model.fit(((r.lang, r.text) for r in sample), load_pieces(path or vocabulary_path()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs -> (doc_id, lang_pred, score): the likeliest language of the whole text, and its posterior probability.

    Null texts and texts without a letter are `und` with score 0; held_out() of a null id is false; ties go to the first language by name. Other columns
    are ignored, null ids and repeated rows are kept, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, model: Model, langs: Iterable[str] | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose whole text is in one of `langs` (None: any language of the model) with a posterior of `least` or
    more, all columns as they were. By default a document goes if it has no letter, or if no language is likelier than all
    others together.

    Null and empty texts go; null ids and repeated rows are judged by their texts; other columns may have any name; an
    empty table gives an empty one, and a model without languages rejects everything.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_identified(shared, text_col, None if langs is None else frozenset(langs), least), docs.schema)
