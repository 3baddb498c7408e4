"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open; an integer's bits say for which free spaces there is an
open bin, so that the tightest fit is one shift and one lowest-bit search; when all are open and none fits, the fullest
closes. Pieces reach a packer longest first, which makes best-fit waste little.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import NOT_SPACE, Growing, WordNumbers, byte_slices, hold_only, words_of
from tidemark.session import cut

VOCABULARY = "word_bpe_49k.json"
SEQUENCE, SEPARATOR = 2048, 0
#: Open bins of a packer: one for each free space would already hold every distinct choice.
OPEN_BINS = 2048
#: Pieces of one packer, on average; each packer leaves at most its last few bins part empty.
PACKER_PIECES = 20_000
#: Words, and bytes of them, whose ids a Python worker remembers (about 20 MB); beyond either it starts anew.
_CACHE, _CACHE_BYTES = 400_000, 1 << 23
#: The vocabulary's split into words, after lower-casing (fixed value of the public file).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return [chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts, word by word: ASCII white space divides texts into words, and each word's ids are kept in a cache.

    The vocabulary drops white space and never joins over it, so that a text's ids are those of its words in a row.
    Words of up to U+00FF go straight to the model; any other word, and one with a special token's string in it, goes through
    the tokenizer as a text of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings in a text that are a token of their own, whatever stands around them.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.words = WordNumbers(_CACHE, _CACHE_BYTES)
        self.flat, self.end = Growing((), np.uint32), Growing((), np.int64)  # ids of all words in a row; where each word's end
        self.end.add(np.zeros(1, np.int64))

    def word_ids(self, word: str) -> list[int]:
        if (word.isascii() or max(word) < "Ā") and not (any(x in word for x in self.special)):
            out = []
            word = word.lower()
            if word.isalpha():
                parts = (word,)
            elif word[-1] in ".," and word[:-1].isalpha():
                parts = (word[:-1], word[-1])
            else:
                parts = _SPLIT.findall(word)
            for w in parts:
                mapped = w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()])
                out += [t.id for t in self.model.tokenize(mapped)]
            return out
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of whole texts: (from row, to row, all ids, where each text's ids begin, with one more entry at the end)."""
        for row, to, data, offsets in byte_slices(texts):
            if self.words.full():
                self.clear()
            w = words_of(data, offsets, NOT_SPACE, lower=False)
            k, new = self.words.find(w)
            ids = [self.word_ids(x) for x in new]
            self.end.add(self.flat.used + np.cumsum([len(x) for x in ids], dtype=np.int64))
            self.flat.add(np.fromiter((i for x in ids for i in x), np.uint32))
            begin = self.end.rows[k]
            size = self.end.rows[k + 1] - begin
            first = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(first[-1]) + np.repeat(begin - first[:-1], size)
            yield row, to, self.flat.rows[take], first[w.first]


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a Python worker, which keeps its cache from task to task."""
    return WordTokenizer(path)


def _pieces(path: str, length: int, separator: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path)
        hold_only(tokenizer)
        number = TaskContext.get().partitionId() << 40  # of a piece
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for row, to, ids, first in tokenizer.encode(batch.column(1)):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                tokens = []
                for i in range(to - row):
                    own = np.append(ids[first[i] : first[i + 1]], np.uint32(separator)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), length)):
                        x = own[start : start + length]
                        for k, v in zip(out, (docs[row + i], piece, start, len(x), zlib.crc32(x.tobytes())), strict=True):
                            out[k].append(v)
                        if with_ids:
                            tokens.append(x.astype(np.int32))
                columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())]
                columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
                columns.append(pa.array(number + np.arange(len(out["doc_id"])), pa.int64()))
                number += len(out["doc_id"])
                names = [*out, "number"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


class OpenBins:
    """The open bins of one packer."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        stack = self.by_space[space]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of this size."""
        fit = self.bits >> size
        if fit:
            space = size + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, space, self.made = self.made, self.capacity, self.made + 1
        left = space - size
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


def _pack(capacity: int, most: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins = OpenBins(capacity, most)
        place = [bins.put(n) for n in rows["length"].to_pylist()]
        packer = rows["packer"][0].as_py() if rows.num_rows else 0
        number = pa.array([(packer << 32) | b for b, _ in place], pa.int64())
        rows = rows.append_column("sequence_id", number).append_column("offset", pa.array([o for _, o in place], pa.int64()))
        return rows.drop_columns(["packer", "number"])

    return run


def pack(
    docs: DataFrame, length: int = SEQUENCE, separator: int = SEPARATOR, path: str | None = None, open_bins: int = OPEN_BINS,
    packer_pieces: int = PACKER_PIECES, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, with_ids: ids.

    A document is its ids and then the separator; only those of over `length` ids are cut, into pieces of `length`. The
    pieces are dealt at random, by their numbers, to packers of about packer_pieces pieces; each packs its own with open_bins bins.

    Null and empty texts are the separator alone; null ids and repeated rows are packed as documents of their own; an empty table gives an empty result;
    other columns are ignored. Texts are tokenised once: the pieces (without texts) are written to the shared folder.
    """
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    shape, ids = "doc_id long, piece int, start long, length long, ids_crc32 long", ", ids array<int>" * with_ids
    pieces = cut(docs.mapInArrow(_pieces(path or vocabulary_path(), length, separator, with_ids), f"{shape}, number long{ids}"))
    packers = max(1, math.ceil(pieces.count() / packer_pieces))
    shape += ids
    dealt = pieces.withColumn("packer", F.pmod(F.xxhash64("number"), F.lit(packers)))  # repeated rows are dealt apart
    return dealt.groupBy("packer").applyInArrow(_pack(length, open_bins), shape + ", sequence_id long, offset long")
