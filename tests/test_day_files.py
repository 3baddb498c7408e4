"""Binary day files, written here byte by byte, against the frames that they hold."""

import datetime as dt
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.sources import day_files, loaders
from tidemark.sources.day_files import decode

DAY = dt.date(2026, 8, 17)
T0 = int(dt.datetime(2026, 8, 17, 13, 30, tzinfo=dt.timezone.utc).timestamp()) * 10**9
MINUTE = 60 * 10**9
CALL, PUT = "SPXW  260817C06400000", "SPXW  260817P06400000"


def header(mappings=(), version=2, start=T0):
    width = 22 if version == 1 else 71
    cstr = lambda s: s.encode().ljust(width, b"\0")
    fixed = b"OPRA.PILLAR".ljust(16, b"\0") + struct.pack("<HQQQ", 1, start, start + 86400 * 10**9, 0)
    fixed += (struct.pack("<QBBB", 0, 1, 0, 0) + b"\0" * 47) if version == 1 else struct.pack("<BBBH", 1, 0, 0, width) + b"\0" * 53
    assert len(fixed) == 100
    body = struct.pack("<I", 0) + struct.pack("<I", 1) + cstr("SPX.OPT") + struct.pack("<II", 0, 0) + struct.pack("<I", len(mappings))
    for symbol, intervals in mappings:
        body += cstr(symbol) + struct.pack("<I", len(intervals))
        for since, until, number in intervals:
            body += struct.pack("<II", since, until) + cstr(str(number))
    return b"DBN" + bytes([version]) + struct.pack("<I", len(fixed + body)) + fixed + body


def bar(k, number=7, rtype=33, high=None):
    p = 6400 * 10**9 + k * 250_000_000
    return struct.pack("<BBHIQqqqqQ", 14, rtype, 1, number, T0 + k * MINUTE, p, high if high is not None else p + 10**9, p - 10**9, p + 1, 100 + k)


def quote(k, number, bid, ask, ts_event=None, rtype=193):
    px = lambda x: day_files.NO_PRICE if x is None else round(x * 10**9)
    return struct.pack("<BBHIQqIBcBBQ8xqqIIHHHH", 20, rtype, 1, number, day_files.NO_TIME if ts_event is None else ts_event, 0, 0, 0, b"N", 0, 0, T0 + k * MINUTE, px(bid), px(ask), 3, 4 + k, 0, 0, 0, 0)


def definition(number, symbol, expires):
    raw = bytearray(400)
    raw[:16] = struct.pack("<BBHIQ", 100, 19, 1, number, T0)
    struct.pack_into("<Q", raw, 16, T0 + 5)
    struct.pack_into("<Q", raw, 40, expires)
    struct.pack_into("<q", raw, 112, 6400 * 10**9)
    raw[200 : 200 + len(symbol)] = symbol.encode()
    return bytes(raw)


MAPPING = ((CALL, [(20260801, 20260817, 9), (20260817, 20260818, 7)]), (PUT, [(20260817, 20260818, 9)]), ("OTHER", [(20260817, 20260818, 8), (20260818, 20260819, 70)]))


def frames(content, step, sized=True):
    return b"".join(zstandard.ZstdCompressor(write_content_size=sized, write_checksum=True).compress(content[k : k + step]) for k in range(0, len(content), step))


def got(df):
    return sorted(tuple(str(x) for x in r) for r in df.drop("path").collect())


@pytest.fixture(scope="module")
def quotes_file():
    return header(MAPPING) + b"".join(quote(k, (7, 9, 8, 5)[k % 4], None if k % 5 == 0 else 1.05 + k, 1.1 + k, T0 + k if k % 3 else None) for k in range(999))


@pytest.mark.parametrize("how", ["plain", "one frame", "frames", "frames of unknown size"])
def test_ranges_equal_the_whole(spark, tmp_path, quotes_file, how):
    skipped = b"\x50\x2a\x4d\x18" + struct.pack("<I", 5) + b"other"
    content = {"plain": quotes_file, "one frame": frames(quotes_file, 1 << 30), "frames": skipped + frames(quotes_file, 1234), "frames of unknown size": frames(quotes_file, 4321, False)}[how]
    (tmp_path / "q.dbn").write_bytes(content)
    df = day_files.day_files(spark, str(tmp_path), "quotes", range_bytes=4000 if how == "plain" else 300)
    rows = df.orderBy("ts_recv").collect()
    assert len(rows) == 999
    for k in (0, 1, 2, 3, 5, 600):
        r = rows[k]
        assert (r.symbol, r.instrument_id, r.day) == ((CALL, PUT, "OTHER", None)[k % 4], (7, 9, 8, 5)[k % 4], DAY)
        assert r.bid_px_00 == (None if k % 5 == 0 else 1.05 + k) and r.ask_px_00 == pytest.approx(1.1 + k, abs=1e-12) and (r.bid_sz_00, r.ask_sz_00) == (3, 4 + k)
        assert (r.ts_event is None) == (k % 3 == 0) and r.ts_recv == dt.datetime(2026, 8, 17, 13, 30) + dt.timedelta(minutes=k)
    tasks = df.groupBy(F.spark_partition_id()).count().count()
    assert tasks > 5 if how in ("plain", "frames") else tasks == 1
    payload = spark.createDataFrame([("q", bytearray(content)), ("none", None)], "logical_key string, payload binary")
    assert got(decode(payload, "quotes")) == got(df)


def test_day_filter_drops_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.dbn").write_bytes(header(start=T0 + k * 86400 * 10**9) + bar(k))
    (tmp_path / "_ignored").write_bytes(b"?")
    df = day_files.day_files(spark, f"{tmp_path}/*.dbn", "bars")
    assert df.count() == 3
    one = df.where("day = DATE'2026-08-18' AND open > 0")
    assert one.select("day").collect()[0].day == dt.date(2026, 8, 18) and one.rdd.getNumPartitions() == 1
    assert df.where("day IN (DATE'2026-08-18', DATE'2026-08-19') AND day < DATE'2026-08-19'").count() == 1
    assert df.where("day = DATE'2030-01-01'").count() == 0
    assert df.select("close").where("day = DATE'2026-08-17'").first().close == 6400 + 1e-9


def test_chain_day_of_files_equals_that_of_frames(spark, tmp_path):
    (tmp_path / "b.dbn").write_bytes(header() + b"".join(bar(k) for k in (2, 0, 1)))
    (tmp_path / "q.zst").write_bytes(frames(header(MAPPING) + quote(1, 7, 1.5, 1.6) + quote(0, 9, None, 2.0, T0 - MINUTE) + quote(1, 9, 0.25, 0.5, T0), 500))
    bars, chain = loaders.chain_day(day_files.day_files(spark, f"{tmp_path}/b.dbn", "bars"), day_files.day_files(spark, f"{tmp_path}/q.zst", "quotes"), "2026-08-17")
    t = dt.datetime(2026, 8, 17, 13, 30)
    raw_bars = spark.createDataFrame([(DAY, t + dt.timedelta(minutes=k), 6400 + k / 4, 6401 + k / 4, 6399 + k / 4, 6400 + k / 4 + 1e-9, 100.0 + k) for k in range(3)], "day date, ts_event timestamp, open double, high double, low double, close double, volume double")
    rows = [(DAY, None, t + dt.timedelta(minutes=1), CALL, 1.5, 1.6, 3, 5), (DAY, t - dt.timedelta(minutes=1), t, PUT, None, 2.0, 3, 4), (DAY, t, t, PUT, 0.25, 0.5, 3, 5)]
    raw_quotes = spark.createDataFrame(rows, "day date, ts_event timestamp, ts_recv timestamp, symbol string, bid_px_00 double, ask_px_00 double, bid_sz_00 int, ask_sz_00 int")
    want_bars, want_chain = loaders.chain_day(raw_bars, raw_quotes, "2026-08-17")
    assert [tuple(r) for r in bars.select(want_bars.columns).collect()] == [tuple(r) for r in want_bars.collect()]
    assert [tuple(r) for r in chain.select(want_chain.columns).collect()] == [tuple(r) for r in want_chain.collect()]


def test_day_through_the_ledger(spark):
    key = lambda scope: f"{scope}/2026-08-17"
    ledger = spark.createDataFrame([(key(day_files.BARS_SCOPE), "l1"), (key(day_files.QUOTES_SCOPE), "l2")], "logical_key string, landing_id string")
    batches = spark.createDataFrame([("l1", bytearray(header() + bar(0))), ("l2", bytearray(frames(header(MAPPING) + quote(0, 7, 1.0, 1.5), 1 << 20)))], "landing_id string, payload binary")
    bars, chain = day_files.normalize_day(ledger, batches, "2026-08-17")
    assert bars.count() == 1 and [(r.symbol, r.bid, r.ask) for r in chain.collect()] == [(CALL, 1.0, 1.5)]
    bars, none = day_files.normalize_day(ledger, batches.where("landing_id = 'l1'"), "2026-08-17", with_quotes=False)
    assert bars.count() == 1 and none is None
    with pytest.raises(ValueError, match="no landed batch for OPRA.PILLAR/cbbo-1m/spxw-0dte/2026-08-17"):
        day_files.normalize_day(ledger, batches.where("landing_id = 'l1'"), "2026-08-17")
    with pytest.raises(ValueError, match="no landed batch for GLBX"):
        day_files.normalize_day(ledger, batches, "2026-08-18")


def test_definitions(spark, tmp_path):
    at = T0 + 7 * 3600 * 10**9
    (tmp_path / "d").write_bytes(header() + definition(1, CALL, at) + definition(2, PUT, at) + definition(3, "ES", day_files.NO_TIME) + definition(4, CALL, at) + definition(5, "L", at + 86400 * 10**9))
    df = day_files.day_files(spark, str(tmp_path / "d"), "definitions")
    assert [r.raw_symbol for r in day_files.expiring_definitions(df, "2026-08-17").collect()] == [CALL, PUT]
    assert df.where("raw_symbol = 'ES'").first().expiration is None and df.first().strike == 6400.0


@pytest.mark.parametrize(("content", "what"), [
    (b"PAR1 and so on", "isn't a binary day file"), (header()[:50], "within its header"), (header() + bar(0)[:-1], "within a record"), (header() + bar(0) + bar(1, rtype=1), "other records than bars"),
    (frames(header() + bar(0) + b"x", 100), "within a record"), (frames(header() + bar(0), 1 << 20, sized=False)[:-6], "."),
])
def test_false_files_fail(spark, tmp_path, content, what):
    (tmp_path / "f").write_bytes(content)
    with pytest.raises(Exception, match=what):
        day_files.day_files(spark, str(tmp_path / "f"), "bars").collect()


def test_versions_and_empty_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(header(MAPPING, version=1) + quote(0, 9, 1.0, 2.0))
    (tmp_path / "b").write_bytes(header(MAPPING, version=3))
    assert [r.symbol for r in day_files.day_files(spark, str(tmp_path), "quotes").collect()] == [PUT]
    assert day_files.day_files(spark, str(tmp_path / "b"), "quotes").collect() == []
    with pytest.raises(Exception, match="kind is one of"):
        day_files.day_files(spark, str(tmp_path), "trades").collect()
