"""Byte-pair encoding and decoding of whole texts in batched numpy merge rounds.

The symbols of many words stand in one flat array. Every round finds each word's lowest-ranked pair, by binary search of
the pairs' keys in the sorted keys of the merge list, and merges it wherever the word has it; words without a mergeable pair
leave the array. Pairs are searched anew only beside a merge.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import _SPLIT, _byte_letters, vocabulary_path
from tidemark.llm.text import NOT_SPACE, Growing, WordNumbers, byte_slices, hold_only, words_of

#: Words, and bytes of them, whose ids a Python worker remembers; beyond either it starts anew.
_CACHE, _CACHE_BYTES = 400_000, 1 << 23
#: Ids that are decoded in one numpy step.
_DECODED = 1 << 16
_NONE = np.iinfo(np.int64).max
#: The file's own splitting, for which words of up to U+00FF have a shorter way (fixed values of the public file).
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class Merges:
    """The merge list of a vocabulary: sorted keys of pairs, with the rank of each; by rank, the id that a pair becomes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        pairs = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, ranks = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        # Ranks whose outcome takes part in an earlier pair: that pair goes before the same merge further on in a word.
        first = np.full(self.size, _NONE)
        np.minimum.at(first, keys // self.size, ranks)
        np.minimum.at(first, keys % self.size, ranks)
        self.one_by_one = first[self.merged] < np.arange(len(merges))

    def _rank(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places, _NONE where there is none."""
        out = np.full(len(at), _NONE)
        inside = np.flatnonzero(at + 1 < len(symbols))
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        pair = symbols[at[inside]] * self.size + symbols[at[inside] + 1]
        place = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        found = self.keys[place] == pair
        out[inside[found]] = self.ranks[place[found]]
        return out

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """symbols of words of these sizes (each 1 or more) in a row -> (ids of the words in a row, their numbers of ids)."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = self._rank(symbols, word, np.arange(len(symbols)))
        done_ids, done_words = [], []
        while len(symbols):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            length = np.diff(start, append=len(word))
            low = np.minimum.reduceat(rank, start)
            if (ended := low == _NONE).any():
                out = np.repeat(ended, length)
                done_ids.append(symbols[out])
                done_words.append(word[out])
                symbols, word, rank = symbols[~out], word[~out], rank[~out]
                low, length = low[~ended], length[~ended]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(low, length))
            # Of overlapping places (a pair of two equal symbols), every second from the run's first merges.
            begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
            at = at[(at - begin) % 2 == 0]
            if (slow := self.one_by_one[rank[at]]).any():
                at = at[~slow | (np.diff(word[at], prepend=-1) != 0)]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at = at - np.arange(len(at))
            again = np.concatenate([at, at[at > 0] - 1])
            rank[again] = self._rank(symbols, word, again)
        ids, words = np.concatenate([symbols, *done_ids]), np.concatenate([word, *done_words])
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(sizes))


class BytePairs:
    """Encodes and decodes by a tokenizer file of byte-level pairs, without unknown, prefixed or skipped symbols.

    ASCII white space divides texts into words; each word's ids are kept in a cache, in which words are told apart by 64-bit
    hashes, and all new words of a slice are merged together. The library normalises and splits words beyond U+00FF; its model
    isn't used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("dropout") or spec.get("decoder"):
            raise ValueError("not a plain byte-pair vocabulary without a decoder")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = Merges(vocab, [tuple(x.split(" ", 1) if isinstance(x, str) else x) for x in model["merges"]])
        self.front = Tokenizer.from_file(path)
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = np.array([vocab[c] for c in letters], np.int64), np.array([vocab[c + suffix] for c in letters], np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or set(x["content"]) & set(" \t\n\x0b\x0c\r") for x in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their surroundings")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.short_way = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == _KNOWN_NORMALIZERS and _KNOWN_SPLIT in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\")
        tokens = {i: t.encode() for t, i in (vocab | self.special).items()}
        pieces = [tokens[i] + b" " if i in tokens else b"" for i in range(max(tokens) + 1)]  # the library leaves out unknown ids
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_end = np.cumsum([len(x) for x in pieces])
        self.piece_size = np.diff(self.piece_end, prepend=0)
        self.clear()

    def clear(self) -> None:
        self.words = WordNumbers(_CACHE, _CACHE_BYTES)
        self.flat, self.end = Growing((), np.uint32), Growing((), np.int64)  # ids of all words in a row; where each word's end
        self.end.add(np.zeros(1, np.int64))

    def _split(self, word: str) -> list[bytes | int]:
        """The parts of a word that merge on their own, as bytes; a special token is its id."""
        if self.at_special and self.at_special.search(word):
            parts = self.at_special.split(word)
            return [y for x in parts for y in ([self.special[x]] if x in self.special else self._split(x))]
        if self.short_way and (word.isascii() or max(word, default="") < "Ā"):
            word = word.lower()
            if word.isalpha():
                return [word.encode()]
            return [x.encode() for x in _SPLIT.findall(word)]
        text = self.front.normalizer.normalize_str(word) if self.front.normalizer else word
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.front.pre_tokenizer.pre_tokenize_str(text) if x]

    def _add(self, words: list[str]) -> None:
        """Adds the ids of new words to the cache."""
        split = [self._split(w) for w in words]
        parts = [x for xs in split for x in xs]
        if not parts:
            self.end.add(np.full(len(words), self.flat.used, np.int64))
            return
        sizes = np.array([1 if isinstance(x, int) else len(x) for x in parts])
        data = np.frombuffer(b"".join(b"\0" if isinstance(x, int) else x for x in parts), np.uint8)
        symbols, last = self.inner[data], np.cumsum(sizes) - 1
        symbols[last] = self.last[data[last]]
        ids_of = np.array([x if isinstance(x, int) else -1 for x in parts])
        symbols[last[ids_of >= 0]] = ids_of[ids_of >= 0]
        ids, count = self.merges.apply(symbols, sizes)
        upto = np.concatenate([[0], np.cumsum(count)])[np.cumsum([len(xs) for xs in split])]
        self.end.add(self.flat.used + upto)
        self.flat.add(ids.astype(np.uint32))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of whole texts: (from row, to row, all ids, where each text's ids begin, with one more entry at the end)."""
        for row, to, data, offsets in byte_slices(texts):
            if self.words.full():
                self.clear()
            w = words_of(data, offsets, NOT_SPACE, lower=False)
            k, new = self.words.find(w)
            if new:
                self._add(new)
            begin = self.end.rows[k]
            size = self.end.rows[k + 1] - begin
            first = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(first[-1]) + np.repeat(begin - first[:-1], size)
            yield row, to, self.flat.rows[take], first[w.first]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, one space between two."""
        out = []
        for at in range(0, len(ids), _DECODED):
            own = ids[at : at + _DECODED].astype(np.int64)
            own = own[own < len(self.piece_size)]
            size = self.piece_size[own]
            end = np.cumsum(size)
            place = np.arange(end[-1] if len(end) else 0) + np.repeat(self.piece_end[own] - end, size)
            out.append(self.piece_bytes[place].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(maxsize=1)
def worker_pairs(path: str) -> BytePairs:
    """One for a Python worker, which keeps its cache from task to task."""
    return BytePairs(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_pairs(path)
        hold_only(pairs)
        for batch in batches:
            for row, to, ids, first in pairs.encode(batch.column(1)):
                data = pa.Array.from_buffers(pa.binary(), to - row, [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), data, pa.array(np.diff(first), pa.int64())], ["doc_id", "ids", "n_tokens"])

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, ids, n_tokens): the ids of whole texts as little-endian unsigned 32-bit integers in one binary value,
    equal to the tokenizers library's with add_special_tokens=False, without truncation and padding.

    Null and empty texts, and those of white space only, have no ids (an empty value); null ids and repeated rows are rows like any
    other; other columns are ignored; an empty table gives an empty result. A map over rows: nothing is shuffled. A text
    may have up to 500 million tokens.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encode(path or vocabulary_path()), "doc_id long, ids binary, n_tokens long")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_pairs(path)
        hold_only(pairs)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [pairs.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return run


def decode(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """tokens (doc_id, ids as encode() writes them) -> (doc_id, n_tokens, ids, text): text as the tokenizers library's decode with
    skip_special_tokens=False; ids that the vocabulary doesn't have are left out. Null and empty ids give the empty text."""
    n_tokens = F.coalesce(F.shiftright(F.octet_length(ids_col), 2), F.lit(0)).cast("long")
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"), n_tokens.alias("n_tokens"))
    return rows.mapInArrow(_decode(path or vocabulary_path()), "doc_id long, n_tokens long, ids binary, text string")
