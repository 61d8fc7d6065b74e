"""Streams into durable tables: late rows, repeated batches, restarts, runs that end or time out."""

from datetime import datetime, timedelta

import pytest

from weftline.session import shared_folder
from weftline.streaming import sink, windows

NOON = datetime(2024, 5, 1, 12)
SCHEMA = "ts timestamp, kind string, value double"


def put(spark, folder, rows):
    spark.createDataFrame([(NOON + timedelta(minutes=m), k, v) for m, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def seen(out):
    return sorted((int((r.window_start - NOON).total_seconds() // 60), r.kind, r.n, r.total) for r in out.collect())


def test_late_rows_restart_and_end(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, folder, [(0, "a", 1.0), (10, "a", 2.0), (200, "a", 4.0)])

    def stream(closing):
        events = spark.readStream.schema(SCHEMA).parquet(folder)
        return windows.tumbling(closing.of(events, "ts"), "1 hour", ["kind"], late="1 hour")

    closing = sink.Closing(spark, root)
    out = sink.TableSink(spark, root).run(stream(closing))
    assert seen(out) == [(0, "a", 2, 3.0)]  # the last window waits for its watermark
    put(spark, folder, [(20, "a", 100.0), (150, "b", 5.0), (210, "a", 1.0)])
    out = sink.TableSink(spark, root).run(stream(sink.Closing(spark, root)))  # a restart from the same folder
    assert seen(out) == [(0, "a", 2, 3.0)]  # what came too late for its window is dropped
    closing.close()
    out = sink.TableSink(spark, root).run(stream(sink.Closing(spark, root)))
    assert seen(out) == [(0, "a", 2, 3.0), (120, "b", 1, 5.0), (180, "a", 2, 5.0)]
    assert seen(sink.TableSink(spark, root).run(stream(closing))) == seen(out)  # nothing new: nothing changes


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = sink.TableSink(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert table.table(rows.schema).count() == 0
    table.write(rows, 0)
    table.write(rows.where("id = 1"), 0)
    table.write(rows.where("id = 2"), 1)
    assert sorted(r.id for r in table.table(rows.schema).collect()) == [1, 2]
    rows.write.parquet(str(tmp_path / "t" / "rows" / "batch=2"))  # a batch that broke off has no marker
    assert table.table(rows.schema).count() == 2


def test_update_keeps_the_latest_and_complete_the_last(spark, tmp_path):
    table = sink.TableSink(spark, str(tmp_path / "u"), "update", ["id"])
    rows = lambda *r: spark.createDataFrame(r, "id int, v string")
    table.write(rows((1, "x"), (2, "y"), (None, "z")), 0)
    table.write(rows((2, "w"), (None, "q")), 1)
    assert sorted((r.id or 0, r.v) for r in table.table(rows((1, "x")).schema).collect()) == [(0, "q"), (1, "x"), (2, "w")]
    whole = sink.TableSink(spark, str(tmp_path / "c"), "complete")
    for k in range(4):
        whole.write(rows((k, "v")), k)
    assert [r.id for r in whole.table(rows((1, "x")).schema).collect()] == [3]
    with pytest.raises(ValueError):
        sink.TableSink(spark, "x", "update")
    with pytest.raises(ValueError):
        sink.TableSink(spark, "x", "append", ["id"])


def test_runs_close_by_end_or_timeout(spark, tmp_path):
    starts, ends = str(tmp_path / "s"), str(tmp_path / "e")
    at = lambda m: NOON + timedelta(minutes=m)

    def more(folder, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    s, e = "run_id string, start_dt timestamp, operation string", "run_id string, end_dt timestamp, status string, run_ms double"
    more(starts, [("a", at(0), "build"), ("b", at(5), "index"), ("c", at(10), "build")], s)
    more(ends, [("a", at(30), "ok", 1.0), ("x", at(40), "error", 2.0)], e)
    root = shared_folder(spark)

    def stream(closing):
        return windows.run_states(closing.of(spark.readStream.schema(s).parquet(starts), "start_dt"), closing.of(spark.readStream.schema(e).parquet(ends), "end_dt"))

    closing = sink.Closing(spark, root)
    first = sink.TableSink(spark, root).run(stream(closing))
    assert [(r.run_id, r.closed_by) for r in first.collect()] == [("a", "end")]
    more(ends, [("b", at(100), "ok", 3.0), ("c", at(300), "ok", 4.0)], e)
    closing.close()
    out = sink.TableSink(spark, root).run(stream(closing))
    assert sorted((r.run_id, r.closed_by, r.status, r.operation) for r in out.collect()) == [
        ("a", "end", "ok", "build"),
        ("b", "end", "ok", "index"),
        ("c", "no start", "ok", "unknown"),
        ("c", "timeout", "unknown", "build"),
        ("x", "no start", "error", "unknown"),
    ]


def test_no_memory_sink(spark):
    import inspect

    assert '"memory"' not in inspect.getsource(windows) + inspect.getsource(sink)
