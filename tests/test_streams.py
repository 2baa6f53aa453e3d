import pytest

from tidelane.model import BreakerConfig
from tidelane.streaming import sinks, streams


def test_batches_flush_by_size_or_by_event_time(spark, tmp_path):
    schema = "trace_id long, at timestamp"
    first = [(1, f"2024-01-01 00:00:0{i}") for i in range(5)] + [(2, "2024-01-01 00:00:01"), (None, "2024-01-01 00:00:02")]
    later = [(3, "2024-01-01 01:00:00")]
    for k, rows in enumerate((first, later)):
        df = spark.createDataFrame(rows, "trace_id long, at string").selectExpr("trace_id", "cast(at as timestamp) at")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    got = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    stream = streams.batches(source, "at", "0 seconds", 2, 10_000)
    streams.drain(stream, lambda batch, _: got.extend(map(tuple, batch.collect())), f"{tmp_path}/ck")
    # the last trace has neither size nor time and stays in the state
    assert sorted(got, key=repr) == sorted([(1, 0, 2, "size"), (1, 1, 2, "size"), (1, 2, 1, "timeout"), (2, 0, 1, "timeout"), (None, 0, 1, "timeout")], key=repr)


def test_the_timer_of_a_first_span_goes_on_when_more_come(spark, tmp_path):
    schema = "trace_id long, at timestamp"
    parts = [[(9, "2024-01-01 00:00:00")], [(9, "2024-01-01 00:00:08"), (1, "2024-01-01 00:00:05")], [(1, "2024-01-01 00:00:12")], [(9, "2024-01-01 00:00:13"), (2, "2024-01-01 02:00:00")]]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "trace_id long, at string").selectExpr("trace_id", "cast(at as timestamp) at")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    got = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    streams.drain(streams.batches(source, "at", "0 seconds", 3, 10_000), lambda batch, _: got.extend(map(tuple, batch.collect())), f"{tmp_path}/ck")
    # the first span's timer ends at 10 s, so the span of 13 s is in a batch of its own
    assert sorted(got) == [(1, 0, 2, "timeout"), (9, 0, 2, "timeout"), (9, 1, 1, "timeout")]


def test_a_breaker_remembers_across_restarts(spark, tmp_path):
    now, calls = [0.0], []

    def failing(batch, batch_id):
        calls.append(batch_id)
        if len(calls) <= 2:
            raise RuntimeError

    def breaker():
        return sinks.Breaker(failing, BreakerConfig(2, 1_000_000, 1), lambda: now[0], sinks.StateFile(spark, f"{tmp_path}/state/breaker"))

    for _ in range(2):  # a restart between the failures
        with pytest.raises(RuntimeError):
            breaker()(None, 0)
    with pytest.raises(sinks.CircuitOpen):
        breaker()(None, 0)
    assert len(calls) == 2
    now[0] = 1.0
    breaker()(None, 0)
    again = breaker()
    assert (again.state, again.failures, again.opened) == ("Closed", 0, 1)


def test_a_state_file_survives_a_torn_write(spark, tmp_path):
    store = sinks.StateFile(spark, f"{tmp_path}/state")
    assert store.load() is None
    store.save({"a": 1})
    store.save({"a": 2})
    assert store.load() == {"a": 2}
    # ended after the old file went and before the new one had its name
    (tmp_path / "state").rename(tmp_path / "state.next")
    assert store.load() == {"a": 2}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "Ok"), ("2024-01-01 00:00:09", "Error"), ("2024-01-01 00:00:11", "Ok"), ("2024-01-01 01:00:00", "Error")]
    df = spark.createDataFrame(rows, "at string, status string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = streams.span_windows(streams.source(spark, f"{tmp_path}/in", df.schema), "at", "0 seconds", "10 seconds")
    streams.drain(stream, lambda batch, _: got.extend((r.spans, r.errors) for r in batch.collect()), f"{tmp_path}/ck")
    assert sorted(got) == [(1, 0), (2, 1)]  # the window that is still open gives nothing


def test_polling_hands_over_until_it_is_stopped(spark, tmp_path, capsys):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []

    def export(batch, batch_id):
        sinks.console(2)(batch, batch_id)
        got.extend(r.id for r in batch.collect())

    query = streams.poll(streams.source(spark, f"{tmp_path}/in", "id long"), export, f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [0, 1, 2] and "only showing top 2 rows" in capsys.readouterr().out
