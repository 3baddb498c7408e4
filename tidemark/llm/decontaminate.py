"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

The tokens of a window are its shingles of PREFIX words. A document that contains the window contains all its tokens, so
its rarest token over the whole corpus is a sufficient prefix: only places of that token in a document are candidates.
Its known offset in the window and the two lengths bound the place, and all words of the window are then compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import ALNUM, PLACE, byte_slices, mix, row_slices, shingles, words_of
from tidemark.session import cut

PREFIX = 3
#: Words of benchmark items that one pass over the documents looks for: 40 MB of arrays at most. More words: more passes.
PASS_WORDS = 400_000
#: Windows of one run of an item: longer items are several runs, and runs are dealt to passes.
CHUNK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def _item_words(window: int):
    """(item_id, text) -> (item_id, words): items as runs of at most CHUNK windows, which overlap by a window less one word, so that every
    window is in one run; a shorter item is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, data, offsets in byte_slices(batch.column(1)):
                w = words_of(data, offsets, ALNUM)
                ids, parts = [], []
                for i in range(to - row):
                    own = w.hash[w.first[i] : w.first[i + 1]].view(np.int64)
                    starts = max(1, len(own) - window + 1)
                    for at in range(0, starts if len(own) else 0, CHUNK):
                        ids.append(row + i)
                        parts.append(own[at : min(at + CHUNK, starts) + window - 1])
                first = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), words], ["item_id", "words"])

    return run


def _tokens(w, k: int) -> np.ndarray:
    """Token of k words that starts at each word of a text run, 0 where it would leave its text."""
    out = np.zeros(len(w.hash), np.uint64)
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    h, _ = shingles(w, k)
    place = np.arange(len(w.hash)) - w.first[text]
    whole = place <= count[text] - k
    # shingles() also gives one hash to each text of under k words; those aren't tokens of k words.
    short = count < k
    first_of_short = w.first[:-1][short & (count > 0)]
    mark = whole.copy()
    mark[first_of_short] = True
    out[mark] = h
    out[~whole] = 0
    return out


class Windows:
    """The windows of some items: words (n, size) padded with 0, length, item number, and tokens by length."""

    def __init__(self, items: list[str], words: list[np.ndarray], size: int):
        self.items, self.size = items, size
        rows, lengths, owner = [], [], []
        for i, w in enumerate(words):
            k = min(size, len(w))
            if k:
                x = np.lib.stride_tricks.sliding_window_view(w, k)
                rows.append(np.pad(x, ((0, 0), (0, size - k))))
                lengths.append(np.full(len(x), k))
                owner.append(np.full(len(x), i))
        self.words = np.concatenate([np.zeros((0, size), np.uint64), *rows])
        self.length = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])
        #: Words of a token of each window.
        self.k = np.minimum(PREFIX, self.length)
        self.token = np.zeros((len(self.words), max(1, size)), np.uint64)
        for o in range(size):
            for k in range(1, min(PREFIX, size - o) + 1):
                fits = (self.k == k) & (o + k <= self.length)
                parts = np.zeros(int(fits.sum()), np.uint64)
                for j in range(k):
                    parts += self.words[fits, o + j] * PLACE[j]
                self.token[fits, o] = mix(parts)

    def choose(self, count: dict[int, int]) -> None:
        """Takes the rarest token of each window as its prefix; ties go to the smaller token, then the earlier place."""
        n, size = self.token.shape
        flat = self.token.reshape(-1)
        uniq, back = np.unique(flat, return_inverse=True)
        often = np.array([count.get(int(t), 0) for t in uniq.tolist()], np.int64)[back].reshape(n, size)
        often = np.where(np.arange(size)[None, :] + self.k[:, None] <= self.length[:, None], often, np.iinfo(np.int64).max)
        least = often == often.min(1, keepdims=True) if n else often.astype(bool)
        pick = np.where(least, self.token, np.iinfo(np.uint64).max)
        self.offset = pick.argmin(1) if n else np.zeros(0, np.int64)
        prefix = self.token[np.arange(n), self.offset]
        order = np.argsort(prefix, kind="stable")
        self.order, sorted_ = order, prefix[order]
        self.prefix, self.start = np.unique(sorted_, return_index=True)
        self.end = np.append(self.start[1:], n)[: len(self.start)]
        self.screen = _screen(self.prefix)


def _screen(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(tokens & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _find(tokens: np.ndarray, sorted_: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, index in sorted_) of the tokens that occur in sorted_."""
    maybe = np.flatnonzero(screen[(tokens & np.uint64(len(screen) - 1)).astype(np.int64)] & (tokens != 0))
    if not len(maybe) or not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_, tokens[maybe]), len(sorted_) - 1)
    good = sorted_[at] == tokens[maybe]
    return maybe[good], at[good]


def _count_tokens(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        screen, total = _screen(tokens), np.zeros(len(tokens), np.int64)
        for batch in batches:
            for _, _, data, offsets in byte_slices(batch.column(0)):
                w = words_of(data, offsets, ALNUM)
                for k in lengths:
                    total += np.bincount(_find(_tokens(w, k), tokens, screen)[1], minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[seen].view(np.int64)), pa.array(total[seen])], ["token", "n"])

    return run


def _hits(w, windows: Windows, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, window number) of every occurrence of a window."""
    count = np.diff(w.first)
    text = np.repeat(np.arange(len(count)), count)
    found = [], [], []
    for k in lengths:
        place, at = _find(_tokens(w, k), windows.prefix, windows.screen)
        if not len(place):
            continue
        many = windows.end[at] - windows.start[at]
        place, at = np.repeat(place, many), np.repeat(at, many)
        step = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        win = windows.order[windows.start[at] + step]
        begin, end = place - windows.offset[win], place - windows.offset[win] + windows.length[win]
        t = text[place]
        ok = (windows.k[win] == k) & (begin >= w.first[t]) & (end <= w.first[t + 1])
        begin, end, win = begin[ok], end[ok], win[ok]
        for j in range(windows.size):
            inside = j < windows.length[win]
            same = ~inside
            same[inside] = w.hash[begin[inside] + j] == windows.words[win[inside], j]
            begin, end, win = begin[same], end[same], win[same]
        for to, x in zip(found, (begin, end, win), strict=True):
            to.append(x)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in found)


def _match(shared, lengths: list[int], whole: bool):
    """Spans and items of every document; whole: merged and summed up at once, as there is one pass only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for row, to, data, offsets in byte_slices(batch.column(1)):
                w = words_of(data, offsets, ALNUM)
                count = np.diff(w.first)
                begin, end, win = _hits(w, windows, lengths)
                # Words inside any occurrence, as runs: neighbouring texts never share one, since begin and end stay in a text.
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, end, -1)
                hit = np.cumsum(edge)[:-1] > 0
                text = np.repeat(np.arange(len(count)), count)
                before = np.zeros(len(hit), bool)
                before[1:] = hit[:-1] & (text[1:] == text[:-1])
                after = np.zeros(len(hit), bool)
                after[:-1] = hit[1:] & (text[1:] == text[:-1])
                starts, ends = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
                owner = text[starts]
                pairs = np.unique(np.stack([text[begin], windows.owner[win]], 1), axis=0) if len(begin) else np.zeros((0, 2), np.int64)
                at = lambda x: pa.array(np.searchsorted(x, np.arange(len(count) + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays(
                    [pa.array(starts - w.first[owner]), pa.array(ends - w.first[owner])], ["start", "end"]
                )
                items = pa.array([windows.items[i] for i in pairs[:, 1]], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, to - row), pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(at(owner), spans), pa.ListArray.from_arrays(at(pairs[:, 0]), items),
                    ],
                    ["doc_id", "n_words", "spans", "items"],
                )

    return (lambda batches: _merged(run(batches))) if whole else run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping spans, sorts items, and sums up."""
    for batch in batches:
        spans, hit, items, n_items, digest = [], [], [], [], []
        for a, b in zip(batch["spans"].to_pylist(), batch["items"].to_pylist(), strict=True):
            out: list[dict] = []
            for x in sorted(a, key=lambda x: x["start"]):
                if out and x["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], x["end"])
                else:
                    out.append(dict(x))
            names = sorted({x for x in b if x is not None})
            spans.append(out)
            hit.append(sum(x["end"] - x["start"] for x in out))
            items.append(names)
            n_items.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest() if names else _EMPTY)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["n_words"], pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()),
                pa.array(spans, batch["spans"].type), pa.array(items, batch["items"].type),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "items"],
        )


def _clean(shared, lengths: list[int], text_col: str):
    """The rows in which no window occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in (part for whole in batches for part in row_slices(whole)):
            keep = np.ones(batch.num_rows, bool)
            for row, _, data, offsets in byte_slices(batch[text_col]):
                w = words_of(data, offsets, ALNUM)
                begin = _hits(w, windows, lengths)[0]
                keep[row + np.searchsorted(w.first, begin, side="right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, pass_words: int) -> tuple[int, Iterator]:
    """The number of passes, and for each its broadcast windows, with prefixes by the counts of all docs (text), and
    their token lengths."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    runs = items.mapInArrow(_item_words(window), "item_id string, words array<long>").dropDuplicates(["item_id", "words"])
    runs = cut(runs.withColumn("run", F.monotonically_increasing_id()))
    total = runs.agg(F.sum(F.size("words"))).first()[0] or 0
    # Runs are short, and dealt by their numbers: passes are about even, and rarely larger than asked.
    passes = 1 if total <= pass_words else -(-5 * total // (4 * pass_words))
    items = runs.withColumn("pass", F.pmod(F.xxhash64("run"), F.lit(passes)))
    sc = docs.sparkSession.sparkContext

    def each() -> Iterator:
        for p in range(passes):
            rows = items.where(F.col("pass") == p).toArrow()
            words = [np.array(x, np.int64).view(np.uint64) for x in rows["words"].to_pylist()]
            windows = Windows(rows["item_id"].to_pylist(), words, window)
            tokens = np.unique(windows.token)
            tokens = tokens[tokens != 0]
            lengths = sorted({int(k) for k in np.unique(windows.k)}) or [PREFIX]
            counts = (
                docs.select("text").mapInArrow(_count_tokens(sc.broadcast(tokens), lengths), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
            )
            seen = dict(zip(counts["token"].to_numpy().view(np.uint64).tolist(), counts["n"].to_pylist(), strict=True))
            windows.choose(seen)
            del windows.token
            yield sc.broadcast(windows), lengths

    return passes, each()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_words: int = PASS_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items).

    Words are runs of ASCII letters, digits and all characters above ASCII, with A-Z lower-cased. A window is `window`
    consecutive words of a benchmark item; an item with fewer words, but not none, is one window. spans: word ranges
    (end exclusive) covered by occurrences of windows; n_hit: the words in them; items: ids of the items concerned.

    The benchmark is looked for in passes of about pass_words item words, so that what tasks hold of it is bounded: repeated
    items count once, long ones are cut into runs of windows. For several passes docs are written once with a key for each
    row, by which all passes' findings are joined.

    Null and empty texts have no words. Items without words are never found. An item with a null id counts in the spans and in
    n_hit as any other, but, having no id, neither in n_items nor in items. Items that repeat an id are one item of several
    texts. Every row has a result of its own, whether its id is null or repeated. Empty tables give empty or clean results.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passes, each = _passes(docs, benchmark, window, pass_words)
    shape = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    merged = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start:long,end:long>>, items array<string>"
    if passes == 1:
        shared, lengths = next(each)
        return docs.mapInArrow(_match(shared, lengths, True), merged).withColumn("contaminated", F.col("n_hit") > 0)
    # _match hands its first column through: here the row's key, which gives way to the document's id in the end.
    keyed = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    out = keyed.select("row", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("n_words", "long"), ("spans", "array<struct<start:long,end:long>>"), ("items", "array<string>"))))
    for shared, lengths in each:
        found = keyed.select("row", "text").mapInArrow(_match(shared, lengths, False), shape)
        out = out.union(found.select(F.col("doc_id").alias("row"), F.lit(None).cast("long"), "n_words", "spans", "items"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), flat("spans"), flat("items"))
    return out.drop("row").mapInArrow(_merged, merged).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, pass_words: int = PASS_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no window of any benchmark item occurs, all columns as they were, whatever their names. Every row
    is judged by its own text: null and repeated ids, and repeated rows, are rows like any other. Null and empty texts stay;
    without documents or items nothing goes."""
    out = docs
    for shared, lengths in _passes(docs.select(F.col(text_col).cast("string").alias("text")), benchmark, window, pass_words)[1]:
        out = out.mapInArrow(_clean(shared, lengths, text_col), docs.schema)
    return out
