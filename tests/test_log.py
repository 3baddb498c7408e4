"""Commit logs: writers at once, replays, conflicts, numbers without gaps, and alert streams that resume."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import delivery
from tidemark.sources import ledgers, log, sinks
from tidemark.sources.log import AlertStream, Log


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k int, v string")


def test_writers_at_once_append_a_key_once(spark, tmp_path):
    path, errors, counts = str(tmp_path / "t"), [], []

    def write(n):
        try:
            counts.append(Log(spark, path, order=["k"]).append(keyed(spark, [(k, "same") for k in range(n, n + 30)]), "k"))
        except Exception as e:  # told below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(10 * i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = Log(spark, path).read().collect()
    assert not errors and sum(counts) == 80
    assert sorted(r.k for r in rows) == list(range(80)) and sorted(r.seq for r in rows) == list(range(1, 81))


def test_conflicts_and_replays(spark, tmp_path):
    table = Log(spark, str(tmp_path / "t"))
    assert table.read() is None and table.append(keyed(spark, [(1, "a"), (1, "a"), (2, None)]), "k") == 2
    with pytest.raises(sinks.Conflict):
        table.append(keyed(spark, [(3, "c"), (2, "b")]), "k")
    with pytest.raises(sinks.Conflict):
        table.append(keyed(spark, [(4, "c"), (4, "d")]), "k")
    assert table.append(keyed(spark, [(1, "other"), (5, "e")]), "k", keep_first=True) == 1
    assert sorted((r.k, r.v) for r in table.read().collect()) == [(1, "a"), (2, None), (5, "e")]
    assert table.append(keyed(spark, [(6, "f")]), "k", batch=("q", 4)) == 1 and table.append(keyed(spark, [(7, "f")]), "k", batch=("q", 4)) == 0
    assert table.append(keyed(spark, [(7, "f")]), "k", batch=("other", 0)) == 1
    with pytest.raises(ValueError, match="other columns"):
        table.append(spark.range(50, 53).selectExpr("CAST(id AS INT) AS k"), "k")


def test_numbers_have_no_gap_after_a_failed_batch_or_compaction(spark, tmp_path, monkeypatch):
    table = Log(spark, str(tmp_path / "t"), order=["v", "k"])
    rows = lambda a, b: keyed(spark, [(k, str(-k % 7)) for k in range(a, b)]).repartition(4)
    assert table.append(rows(0, 50)) == 50
    with monkeypatch.context() as m:
        m.setattr(table.files, "create", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append(rows(50, 60))  # its data is written, and in no commit
    assert table.read().count() == 50 and table.append(rows(50, 75)) == 25
    got = {r.k: r.seq for r in table.read().collect()}
    order = sorted(range(50), key=lambda k: (str(-k % 7), k)) + sorted(range(50, 75), key=lambda k: (str(-k % 7), k))
    assert got == {k: i for i, k in enumerate(order, 1)} and table.last_seq() == 75
    assert table.compact() and {r.k: r.seq for r in table.read().collect()} == got and len(table.commits()) == 1
    assert table.append(rows(75, 80)) == 5 and sorted(r.seq for r in table.read().collect()) == list(range(1, 81))
    assert table.vacuum(3600.0) == 0 and table.vacuum(0.0) == 3 and table.read().count() == 80


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    table = Log(spark, str(tmp_path / "t"), order=["k"])
    sink = table.foreach_batch("letters", "k")

    def run(checkpoint):
        stream = spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)

    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": "x"}) for k in range(5 * n, 5 * n + 6)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    run("a")
    n = len(table.commits())
    run("b")  # the checkpoint was lost: every batch comes again
    assert n == 3 and len(table.commits()) == 3
    assert sorted((r.k, r.seq) for r in table.read().collect()) == [(k, k + 1) for k in range(16)]


def test_alert_stream_resumes_anywhere(spark, tmp_path):
    stream = AlertStream(spark, str(tmp_path / "s"))
    assert stream.frames("c0", None, 0.0).collect()[0].seq is None  # a heartbeat
    assert stream.frames("c0", None, 5.0).collect() == []
    states = spark.createDataFrame([(a, s) for a in range(7) for s in ("OPEN", "TAKEN")], "alert int, status string")
    projected = delivery.projection(states, ["alert", "status"])
    assert stream.sync(projected, 10.0) == 14 and stream.sync(projected, 11.0) == 0
    more = delivery.projection(states.union(spark.createDataFrame([(9, "OPEN")], "alert int, status string")), ["alert", "status"])
    assert stream.sync(more, 12.0) == 1
    for cursor in (None, "0", "1", "13", "14"):
        got = stream.frames(f"c-{cursor}", cursor, 20.0).collect()
        assert [r.seq for r in got] == list(range(int(cursor or 0) + 1, 16))
        assert len({(r.alert, r.status) for r in got}) == len(got)
    assert stream.frames("c-13", "15", 21.0).collect() == [] and [r.seq for r in stream.frames("c-13", "15", 35.0).collect()] == [None]
    for bad, why in (("16", "BEYOND_END"), ("07", "NOT_CANONICAL"), ("9" * 40, "BEYOND_END"), ("x", "NOT_CANONICAL")):
        with pytest.raises(ValueError, match=why):
            stream.frames("c", bad, 40.0)
    audit = stream.audit.read()
    assert audit.where("connection_id = 'c-13' AND seq IS NOT NULL").count() == 2 and audit.select("delivery_id").distinct().count() == audit.count()


def test_an_event_is_on_record_before_it_goes_out(spark, tmp_path, monkeypatch):
    stream = AlertStream(spark, str(tmp_path / "s"))
    stream.sync(delivery.projection(spark.createDataFrame([(1, "OPEN")], "alert int, status string"), ["alert", "status"]), 1.0)
    monkeypatch.setattr(stream.audit, "append", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stream.frames("c", None, 2.0)
    monkeypatch.undo()
    assert [r.seq for r in stream.frames("c", None, 3.0).collect()] == [1]


def test_first_object_stays(spark, tmp_path):
    path = str(tmp_path / "objects")
    assert [(r.k, r.v) for r in ledgers.put_if_absent(spark, keyed(spark, [(1, "a")]), path, "k").collect()] == [(1, "a")]
    got = ledgers.put_if_absent(spark, keyed(spark, [(1, "late"), (2, "b")]), path, "k").collect()
    assert sorted((r.k, r.v) for r in got) == [(1, "a"), (2, "b")]


def test_files_are_created_once_on_other_file_systems_too(spark, tmp_path):
    files = log._Files(spark, str(tmp_path))
    files.local = False
    assert files.create(f"{tmp_path}/x/1.json", "one") and not files.create(f"{tmp_path}/x/1.json", "two")
    assert files.read(f"{tmp_path}/x/1.json") == "one" and [n for n in files.names(f"{tmp_path}/x") if not n.startswith(".")] == ["1.json"]
