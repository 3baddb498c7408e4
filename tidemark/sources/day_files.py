"""Binary day files as a Spark data source: bars, consolidated quotes and definitions, plain or in zstd frames.

A file is a header (with the symbols of its instruments) and records of one length, so that any byte range can be read alone:
plain files are cut into ranges of records, compressed ones at their frames. `day` is known from the header: a filter on it
drops files before any record is read (with spark.sql.python.filterPushdown.enabled).

    spark.dataSource.register(DayFiles)
    spark.read.format("day_files").option("kind", "quotes").load("/landing/*.dbn.zst").where("day = DATE'2026-08-17'")

Ranges are read through pyarrow's file systems (local, hdfs, s3, gs, abfs). decode() does the same with files or landed payloads
that Spark has read, one value a row.
"""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources.loaders import chain_day

# Fixed values of the binary format: magics, undefined values, price unit, record types and layouts.
MAGIC, ZSTD_MAGIC = b"DBN", b"\x28\xb5\x2f\xfd"
NO_PRICE, NO_TIME, UNIT = (1 << 63) - 1, (1 << 64) - 1, 1e9
_HEAD = [("length", "u1"), ("rtype", "u1"), ("publisher", "<u2"), ("instrument", "<u4"), ("ts_event", "<u8")]
_BARS = np.dtype([*_HEAD, ("open", "<i8"), ("high", "<i8"), ("low", "<i8"), ("close", "<i8"), ("volume", "<u8")])
_QUOTES = np.dtype([
    *_HEAD, ("price", "<i8"), ("size", "<u4"), ("r1", "u1"), ("side", "S1"), ("flags", "u1"), ("r2", "u1"), ("ts_recv", "<u8"), ("r3", "V8"),
    ("bid", "<i8"), ("ask", "<i8"), ("bid_size", "<u4"), ("ask_size", "<u4"), ("bid_publisher", "<u2"), ("r4", "V2"), ("ask_publisher", "<u2"), ("r5", "V2"),
])
_DEFINITIONS = np.dtype({
    "names": ["length", "rtype", "instrument", "ts_event", "ts_recv", "expiration", "strike", "raw_symbol"],
    "formats": ["u1", "u1", "<u4", "<u8", "<u8", "<u8", "<i8", "S71"], "offsets": [0, 1, 4, 8, 16, 40, 112, 200], "itemsize": 400,
})


class Kind(NamedTuple):
    """A kind of day file: its layout, the record types that it may hold, and its columns after path, day and instrument_id."""

    layout: np.dtype
    rtypes: tuple[int, ...]
    columns: str


KINDS = {
    "bars": Kind(_BARS, (32, 33, 34, 35), "symbol string, ts_event timestamp, open double, high double, low double, close double, volume double"),
    "quotes": Kind(_QUOTES, (192, 193), "symbol string, ts_event timestamp, ts_recv timestamp, bid_px_00 double, ask_px_00 double, bid_sz_00 long, ask_sz_00 long"),
    "definitions": Kind(_DEFINITIONS, (19,), "raw_symbol string, ts_event timestamp, ts_recv timestamp, expiration long, strike double"),
}
#: Bytes of a range, before its records are decoded, and records that are decoded at a time.
RANGE_BYTES, RECORDS = 32 << 20, 1 << 15


def schema_of(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    return f"path string, day date, instrument_id long, {KINDS[kind].columns}"


def _cstr(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode()


class Header(NamedTuple):
    """What a file's header says: where records begin, the first instant (ns), and which symbol an instrument has from one date
    (YYYYMMDD) to before another, sorted by instrument and date."""

    size: int
    start: int
    instrument: np.ndarray
    since: np.ndarray
    until: np.ndarray
    symbol: list[str]

    @property
    def day(self) -> dt.date:
        return dt.datetime.fromtimestamp(self.start // 10**9, dt.timezone.utc).date()

    def symbols(self, instrument: np.ndarray, ns: np.ndarray) -> pa.Array:
        if not self.symbol:
            return pa.nulls(len(instrument), pa.string())
        days = (ns // np.uint64(86400 * 10**9)).astype("datetime64[D]")
        years, months = days.astype("datetime64[Y]"), days.astype("datetime64[M]")
        date = (years.astype(np.int64) + 1970) * 10_000 + (months - years).astype(np.int64) * 100 + 100 + (days - months).astype(np.int64) + 1
        at = np.searchsorted(self.instrument * 10**8 + self.since, instrument.astype(np.int64) * 10**8 + date, "right") - 1
        found = (at >= 0) & (self.instrument[at] == instrument) & (date < self.until[at])
        return pa.array(self.symbol, pa.string()).take(pa.array(at, mask=~found))


def read_header(source, name: str) -> Header:
    """The header that a binary stream of decoded bytes begins with; leaves the stream at the first record."""
    head = source.read(8)
    if head[:3] != MAGIC or len(head) < 8 or head[3] not in (1, 2, 3):
        raise ValueError(f"{name} isn't a binary day file")
    size = int.from_bytes(head[4:8], "little")
    raw = source.read(size)
    if len(raw) < size or size < 104:
        raise ValueError(f"{name} ends within its header")
    width = 22 if head[3] == 1 else int.from_bytes(raw[45:47], "little")
    at = 100 + 4 + int.from_bytes(raw[100:104], "little")

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(raw[at - 4 : at], "little")

    def text() -> str:
        nonlocal at
        at += width
        return _cstr(raw[at - width : at])

    for _ in range(3):  # requested, partly found and unknown symbols
        for _ in range(number()):
            text()
    rows = []
    for _ in range(number()):
        symbol = text()
        for _ in range(number()):
            since, until, instrument = number(), number(), text()
            if instrument:
                rows.append((int(instrument), since, until, symbol))
    rows.sort()
    numbers = np.array([r[:3] for r in rows], np.int64).reshape(-1, 3)
    return Header(8 + size, int.from_bytes(raw[18:26], "little"), *numbers.T, [r[3] for r in rows])


def _time(ns: np.ndarray) -> pa.Array:
    return pa.array((ns // np.uint64(1000)).astype(np.int64), pa.int64(), mask=ns == NO_TIME).cast(pa.timestamp("us", "UTC"))


def _price(raw: np.ndarray) -> pa.Array:
    return pa.array(raw / UNIT, mask=raw == NO_PRICE)


def _batch(kind: str, header: Header, name: str, rows: np.ndarray) -> pa.RecordBatch:
    layout, rtypes, _ = KINDS[kind]
    if (~np.isin(rows["rtype"], rtypes) | (rows["length"] != layout.itemsize // 4)).any():
        raise ValueError(f"{name} holds other records than {kind}")
    number = pa.array(rows["instrument"].astype(np.int64))
    if kind == "bars":
        columns = [header.symbols(rows["instrument"], rows["ts_event"]), _time(rows["ts_event"]), *(_price(rows[c]) for c in ("open", "high", "low", "close")), pa.array(rows["volume"].astype(np.float64))]
    elif kind == "quotes":
        columns = [header.symbols(rows["instrument"], rows["ts_recv"]), _time(rows["ts_event"]), _time(rows["ts_recv"]), _price(rows["bid"]), _price(rows["ask"])]
        columns += [pa.array(rows[c].astype(np.int64)) for c in ("bid_size", "ask_size")]
    else:
        expires = rows["expiration"].astype(np.int64)
        columns = [pa.array([_cstr(x) for x in rows["raw_symbol"].tolist()], pa.string()), _time(rows["ts_event"]), _time(rows["ts_recv"]), pa.array(expires, mask=rows["expiration"] == NO_TIME), _price(rows["strike"])]
    n = len(rows)
    names = [c.split()[0] for c in schema_of(kind).split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([header.day] * n, pa.date32()), number, *columns], names)


def _records(source, kind: str, header: Header, name: str, most: int | None) -> Iterator[pa.RecordBatch]:
    """Decodes up to `most` records (None: to the end) of a stream that stands at a record."""
    layout = KINDS[kind].layout
    while most is None or most > 0:
        want = (RECORDS if most is None else min(RECORDS, most)) * layout.itemsize
        raw = b""
        while len(raw) < want and (more := source.read(want - len(raw))):
            raw += more
        if len(raw) % layout.itemsize or (most is not None and len(raw) < want):
            raise ValueError(f"{name} ends within a record")
        if not raw:
            return
        rows = np.frombuffer(raw, layout)
        yield _batch(kind, header, name, rows)
        if most is not None:
            most -= len(rows)


def _unpacked(source) -> io.BufferedIOBase:
    return zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)


def zstd_frames(file) -> list[tuple[int, int]] | None:
    """(offset in the file, offset in the decoded bytes) of every frame, and their ends as a last entry; None if a frame doesn't tell its
    decoded size. Reads headers of frames and blocks only; file: a pyarrow file."""
    size, at, decoded, out = file.size(), 0, 0, []
    while at < size:
        head = file.read_at(18, at)
        if head[1:4] == b"\x2a\x4d\x18":  # a frame to skip
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        info = zstandard.get_frame_parameters(head)
        if info.content_size == zstandard.CONTENTSIZE_UNKNOWN:
            return None
        out.append((at, decoded))
        at += zstandard.frame_header_size(head)
        last = False
        while not last:
            block = int.from_bytes(file.read_at(3, at), "little")
            last, at = bool(block & 1), at + 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)
        at += 4 * info.has_checksum
        decoded += info.content_size
    if at != size:
        raise ValueError("a compressed file ends within a frame")
    return [*out, (at, decoded)]


def _is_packed(head: bytes) -> bool:
    return head[:4] == ZSTD_MAGIC or head[1:4] == b"\x2a\x4d\x18"


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inner


def _files(path: str) -> list[str]:
    """The files of a path: itself, a folder's, or those of its folder that match a pattern."""
    import fnmatch

    from pyarrow import fs

    head, _, tail = path.rpartition("/")
    pattern = tail if any(c in tail for c in "*?[") else None
    store, inner = _open(head if pattern else path)
    prefix = path[: len(path) - len(inner)] if not pattern and path.endswith(inner) else (head[: len(head) - len(inner)] if head.endswith(inner) else "")
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner))
    names = (x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))
    return sorted(prefix + x for x in names if pattern is None or fnmatch.fnmatch(x.rpartition("/")[2], pattern))


@dataclass
class Range(InputPartition):
    """Records [first, first + count) of a file, all if count is None; of a compressed file, from the frame at `frame`, whose decoded bytes begin at
    `decoded`."""

    path: str
    first: int = 0
    count: int | None = None
    frame: int = 0
    decoded: int = 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, range_bytes: int):
        self.path, self.kind, self.range_bytes, self.days = path, kind, range_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("day",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.days.append(f)
            else:
                yield f

    def _wanted(self, day: dt.date) -> bool:
        tests = {EqualTo: lambda v: day == v, In: lambda v: day in v, GreaterThan: lambda v: day > v, GreaterThanOrEqual: lambda v: day >= v, LessThan: lambda v: day < v, LessThanOrEqual: lambda v: day <= v}
        return all(tests[type(f)](f.value) for f in self.days)

    def _ranges(self, path: str) -> Iterator[Range]:
        store, inner = _open(path)
        size = KINDS[self.kind].layout.itemsize
        with store.open_input_file(inner) as file:
            packed = _is_packed(file.read_at(4, 0))
            file.seek(0)
            header = read_header(_unpacked(file) if packed else file, path)
            if not self._wanted(header.day):
                return
            if not packed:
                bytes_ = file.size() - header.size
                if bytes_ % size:
                    raise ValueError(f"{path} ends within a record")
                step = max(1, self.range_bytes // size)
                yield from (Range(path, k, min(step, bytes_ // size - k)) for k in range(0, bytes_ // size, step))
                return
            frames = zstd_frames(file)
            if frames is None:  # a stream without entry points
                yield Range(path)
                return
            if (frames[-1][1] - header.size) % size:
                raise ValueError(f"{path} ends within a record")
            starts = [0]
            for k in range(1, len(frames) - 1):
                if frames[k][0] - frames[starts[-1]][0] >= self.range_bytes:
                    starts.append(k)
            for k, to in zip(starts, [*starts[1:], len(frames) - 1], strict=True):
                # The records that begin in these frames; the last may end in the next frame.
                first, end = (max(0, -(-(frames[i][1] - header.size) // size)) for i in (k, to))
                if end > first:
                    yield Range(path, first, end - first, *frames[k])

    def partitions(self) -> list[Range]:
        return [r for path in _files(self.path) for r in self._ranges(path)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.count == 0:
            return
        store, inner = _open(partition.path)
        with store.open_input_file(inner) as file:
            packed = _is_packed(file.read_at(4, 0))
            file.seek(0)
            source = _unpacked(file) if packed else file
            header = read_header(source, partition.path)
            if partition.count is not None:
                at = header.size + partition.first * KINDS[self.kind].layout.itemsize
                if packed:
                    file.seek(partition.frame)
                    source = _unpacked(file)
                    skip = at - partition.decoded
                    while skip > 0 and (gone := source.read(min(skip, 1 << 20))):
                        skip -= len(gone)
                else:
                    file.seek(at)
            yield from _records(source, self.kind, header, partition.path, partition.count)


class DayFiles(DataSource):
    """The data source "day_files". Options: path (a file, a folder, or a pattern in its last part), kind (bars, quotes, definitions) and
    rangeBytes (of a task's part of a file). No file or no record gives no row; a file of another kind, cut short or with a false record
    fails the job. A compressed file of one frame, or of frames that don't tell their size, is one task's."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return schema_of(self.options.get("kind", ""))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["kind"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def day_files(spark: SparkSession, path: str, kind: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the binary day files at a path; filters on `day` drop files."""
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("day_files").option("kind", kind).option("rangeBytes", str(range_bytes)).load(path)


def decode(rows: DataFrame, kind: str, payload: str = "payload", name: str = "logical_key") -> DataFrame:
    """rows with whole binary day files as values (landed batches, or Spark's binaryFile source) -> their records; `path` is the row's
    name. A value is decoded in one task, in steps: at most 2 GB, as Spark's values are. Null values have no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value.is_valid:
                    raw = pa.BufferReader(value.as_buffer())
                    source = _unpacked(raw) if _is_packed(value.as_buffer()[:4].to_pybytes()) else raw
                    yield from _records(source, kind, read_header(source, own or "a payload"), own, None)

    return rows.select(F.col(name).cast("string"), F.col(payload)).mapInArrow(run, schema_of(kind))


#: Keys of a day's batches (fixed values): the front contract's minute bars and the chain's minute quotes.
BARS_SCOPE, QUOTES_SCOPE = "GLBX.MDP3/ohlcv-1m/es-front-month", "OPRA.PILLAR/cbbo-1m/spxw-0dte"


def normalize_day(ledger: DataFrame, batches: DataFrame, day: str, with_quotes: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(bars, quotes) of a day, looked up in the batch ledger: verified records (logical_key, landing_id) name the landed batches
    (landing_id, payload) to decode. Raises for a key without a record, or a record without a batch; else as loaders.chain_day.
    Without quotes only the bars' batch is opened."""

    def records(scope: str, kind: str) -> DataFrame:
        key = f"{scope}/{day}"
        found = ledger.where(F.col("logical_key") == key).select("logical_key", "landing_id").join(batches.select("landing_id", "payload"), "landing_id")
        if found.isEmpty():
            raise ValueError(f"no landed batch for {key}")
        return decode(found, kind).withColumn("day", F.lit(day).cast("date"))  # the key's day

    return chain_day(records(BARS_SCOPE, "bars"), records(QUOTES_SCOPE, "quotes") if with_quotes else None, day)


def expiring_definitions(definitions: DataFrame, day: str) -> DataFrame:
    """Distinct symbols, in order, of definitions records that expire on a UTC day; undefined expirations never do."""
    when = F.to_date(F.timestamp_micros(F.floor(F.col("expiration") / 1000)))
    return definitions.where(when == F.lit(day).cast("date")).select("raw_symbol").distinct().orderBy("raw_symbol")
