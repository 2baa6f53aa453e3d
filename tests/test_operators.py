import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelane.functions import ids, ordering
from tidelane.model import BreakerConfig, LaneConfig, RetryConfig
from tidelane.operators import lanes, log, replay, resilience, verify
from tidelane.sources import segments
from tidelane.streaming import sinks, streams

from pyspark.sql import functions as F


def messages(spark, n_lanes=4, n=50):
    return spark.createDataFrame([(p, s, p * 1000 + s, (p + s) * 10, s) for p in range(n_lanes) for s in range(n)], "producer_id long, seq long, event_id long, ts_us long, value_c long")


@pytest.mark.parametrize("bad", [(0, 16), (21, 16), (16, 0), (16, 129)])
def test_config_bounds(bad):
    with pytest.raises(ValueError):
        LaneConfig(*bad)


def test_merge_keeps_lane_order_and_drops_nothing(spark):
    rows = lanes.merge_order(messages(spark)).orderBy("pos").collect()
    assert [(r.producer_id, r.seq) for r in rows] == [(p, s) for p in range(4) for s in range(50)]
    assert [r.pos for r in rows] == list(range(200))


def test_bounded_drain_starves_high_lanes(spark):
    got = lanes.drain(messages(spark), 60).groupBy("producer_id").count().collect()
    assert {r.producer_id: r["count"] for r in got} == {0: 50, 1: 10}


def test_positions_over_many_ranges(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else (i * 37) % 101, i) for i in range(500)], "a int, b int")
    got = {(r.a, r.b): r.pos for r in ordering.with_position(df, ["a", "b"], "pos", rows_per_range=60).collect()}
    want = sorted(got, key=lambda k: (k[0] is not None, k))
    assert [got[k] for k in want] == list(range(500))


def test_ids_decode_at_the_largest_producer(spark):
    row = spark.range(1).select(ids.pack_id(F.lit(65535), F.lit(7)).alias("i")).select(ids.id_producer(F.col("i")), ids.id_sequence(F.col("i"))).first()
    assert tuple(row) == (65535, 7)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.integers(1, 5), st.integers(1, 3))
def test_occupancy_is_bounded_and_like_a_plain_model(spark, gaps, capacity, drain):
    times = [sum(gaps[: i + 1]) for i in range(len(gaps))]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(times)], "producer_id long, seq long, ts_us long")
    got = [(r.accepted, r.occupied) for r in lanes.try_send(df, capacity, 10, drain).orderBy("seq").collect()]
    held, last, want = 0, None, []
    for t in times:
        held = held if last is None else max(0, held - drain * (t // 10 - last))
        ok = held < capacity
        held, last = held + ok, t // 10
        want.append((ok, held))
    assert got == want and all(0 <= o <= capacity for _, o in got)


def test_marker_only_and_two_markers(spark):
    data = spark.createDataFrame([(1, 1, "Insert", 5, 50), (2, 2, "Insert", 6, 60), (3, 9, "Insert", 7, 70)], "lsn long, tx_id long, op string, key long, value long")
    markers = spark.createDataFrame([(1, 1, "Abort"), (2, 1, "Commit"), (3, 4, "Commit"), (4, 2, "Abort")], "mlsn long, tx_id long, op string")
    got = {r.tx_id: (r["class"], r.entries) for r in log.recover(data, markers).collect()}
    assert got == {1: ("Commit", 1), 2: ("Rollback", 1), 4: ("Commit", 0), 9: ("Incomplete", 1)}
    assert [tuple(r) for r in replay.replay(data, markers).collect()] == [(5, 50)]
    assert log.next_tx_id(data, markers).first()[0] == 10


def test_replay_follows_commit_order(spark):
    data = spark.createDataFrame([(1, 1, "Insert", 5, 1), (2, 2, "Update", 5, 2), (3, 3, "Insert", 6, 3), (4, 3, "Delete", 6, 3)], "lsn long, tx_id long, op string, key long, value long")
    markers = spark.createDataFrame([(1, 2, "Commit"), (2, 1, "Commit"), (3, 3, "Commit")], "mlsn long, tx_id long, op string")
    assert [tuple(r) for r in replay.replay(data, markers).collect()] == [(5, 1)]


def test_lost_and_phantom(spark):
    ack, rec = (spark.createDataFrame([(i,) for i in x], "tx_id long") for x in ([1, 2, 3], [2, 3, 4]))
    assert sorted(map(tuple, verify.verify_recovery(ack, rec).collect())) == [("found", 2), ("found", 3), ("lost", 1), ("phantom", 4)]


def batches(spark, failed, step=1):
    return spark.createDataFrame([(i, 10, i * step, 0, f) for i, f in enumerate(failed)], "batch_id long, n_spans long, at_us long, fails long, failed boolean")


def test_breaker_sequence(spark):
    got = resilience.circuit_breaker(batches(spark, [True, True, True, False, False, False]), BreakerConfig(3, 2, 1)).orderBy("batch_id").collect()
    assert [(r.outcome, r.state) for r in got] == [("failed", "Closed"), ("failed", "Closed"), ("failed", "Open"), ("rejected", "Open"), ("ok", "Closed"), ("ok", "Closed")]


def test_backoff():
    assert [RetryConfig().delay_ms(k) for k in range(4)] == [0, 100, 200, 400]
    assert RetryConfig(max_ms=250).delay_ms(3) == 250


def test_rate_limit_keeps_to_the_grid(spark):
    df = spark.createDataFrame([(0, 5), (1, 6), (2, 30), (3, 31)], "batch_id long, at_us long")
    got = [r.leaves_us for r in resilience.rate_limit(df, 10).orderBy("batch_id").collect()]
    assert got == [5, 15, 30, 35]


def segment_rows():
    return [(1, i, op, tx, 7, "k%d" % i, b"v%d" % i if op in ("Insert", "Update") else None, b"o" if op in ("Update", "Delete") else None) for i, (op, tx) in enumerate([("Insert", 1), ("Update", 1), ("Delete", 2)])] + [(2, 0, "Commit", 1, 8, None, None, None)]


def test_segment_bytes_round_trip(spark, tmp_path):
    df = spark.createDataFrame(segment_rows(), "segment_id long, idx long, op string, tx_id long, ts_sec long, key string, value binary, old_value binary")
    segments.write(segments.encode(df), f"file://{tmp_path}")
    (tmp_path / "other.txt").write_text("x")
    found = segments.files(spark, str(tmp_path))
    got = sorted(tuple(r)[:8] for r in segments.entries(found).collect())
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == sorted(segment_rows(), key=lambda r: r[:2])
    assert tuple(segments.damage(found).first()) == (0, 0)
    checked = segments.entries(found).select("crc").collect()
    assert all(r.crc > 0 for r in checked)


def test_torn_and_damaged_segments(spark):
    good = [segments.encode_entry("Insert", i, 0, "k", b"v") for i in range(3)]
    bad = bytearray(good[1])
    bad[-1] ^= 1
    torn, damaged, short = b"".join(good) + b"\0" * 5, good[0] + bytes(bad) + good[2], b"".join(good)[:-3]
    df = spark.createDataFrame([(1, torn), (2, damaged), (3, b"".join(good)), (4, short), (5, b"")], "segment_id long, content binary")
    assert {r.segment_id: r["count"] for r in segments.entries(df).groupBy("segment_id").count().collect()} == {1: 3, 2: 1, 3: 3, 4: 2}
    assert tuple(segments.damage(df).first()) == (2, 1)


def test_checkpoint_file(spark, tmp_path):
    path = f"file://{tmp_path}/checkpoint"
    assert segments.read_checkpoint(spark, path) == 0
    segments.write_checkpoint(spark, path, 1 << 40)
    assert segments.read_checkpoint(spark, path) == 1 << 40
    (tmp_path / "short").write_bytes(b"abc")
    assert segments.read_checkpoint(spark, f"file://{tmp_path}/short") == 0


def test_rotation_by_logs(spark):
    rows = [(g, i + 1, "Insert", 1, 1) for g in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "log_id int, lsn long, op string, key long, value long")
    got = log.rotate(df, 150, ["log_id"]).collect()
    size = 33 + 9 + 9
    assert all(r.bytes == r.entries * size and r.entries <= 3 for r in got) and sum(r.entries for r in got) == 40
    assert {r.log_id for r in got} == {0, 1}


def test_stream_drains_like_the_batch(spark, tmp_path):
    m = messages(spark, 3, 40)
    for k in range(4):
        m.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = streams.try_send(streams.source(spark, f"{tmp_path}/in", m.schema, 10), 5, 100, 2)
    streams.drain(stream, lambda batch, _: got.extend(map(tuple, batch.collect())), f"{tmp_path}/ck")
    assert sorted(got) == sorted(map(tuple, lanes.try_send(m, 5, 100, 2).collect()))
    counts: list = []
    streams.drain(streams.lane_metrics(streams.source(spark, f"{tmp_path}/in", m.schema)), lambda batch, _: (counts.clear(), counts.extend(map(tuple, batch.collect()))), f"{tmp_path}/ck2", "complete")
    assert sorted(counts) == [(p, 40, 39) for p in range(3)]


def test_json_sink_is_idempotent(spark, tmp_path):
    df = spark.range(5)
    export = sinks.json(f"{tmp_path}/out", append=True)
    for batch in (0, 1, 1):
        export(df, batch)
    assert spark.read.json(f"{tmp_path}/out").count() == 10
    sinks.json(f"{tmp_path}/one")(df, 0)
    sinks.json(f"{tmp_path}/one")(df, 1)
    assert spark.read.json(f"{tmp_path}/one").count() == 5
    sinks.null()(df, 0)


def test_retry_breaker_and_limit_of_exporters():
    calls, waits, now = [], [], [0.0]

    def failing(n):
        def export(batch, batch_id):
            calls.append(batch_id)
            if len(calls) <= n:
                raise RuntimeError

        return export

    sinks.retrying(failing(2), RetryConfig(), waits.append)(None, 1)
    assert len(calls) == 3 and waits == [0.1, 0.2]
    calls.clear()
    with pytest.raises(RuntimeError):
        sinks.retrying(failing(100), RetryConfig(), waits.append)(None, 1)
    assert len(calls) == 4
    calls.clear()
    breaker = sinks.Breaker(failing(3), BreakerConfig(3, 1_000_000, 1), lambda: now[0])
    for _ in range(3):
        with pytest.raises(RuntimeError):
            breaker(None, 0)
    with pytest.raises(sinks.CircuitOpen):
        breaker(None, 0)
    now[0] = 1.0
    breaker(None, 0)
    assert breaker.state == "Closed" and breaker.opened == 1
    calls.clear()
    waits.clear()
    limited = sinks.limited(failing(0), 1.0, lambda: now[0], lambda s: (waits.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limited(None, 0)
    assert waits == [1.0, 1.0]


def test_ranges_split_rows_that_agree_on_the_first_column(spark):
    df = spark.createDataFrame([(1, None if i % 40 == 0 else f"k{i:03d}") for i in range(400)], "a int, b string")
    placed = ordering.with_position(df, ["a", "b"], "pos", rows_per_range=50)
    got = sorted((r.pos, r.b is not None, r.b or "") for r in placed.collect())
    assert [p for p, *_ in got] == list(range(400)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


@pytest.mark.parametrize("kind", ["sum", "max"])
def test_running_values_over_blocks(spark, kind):
    values = [(i * 37) % 23 - 11 for i in range(100)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = [r.x for r in ordering.running(df, "i", F.col("v"), kind, "x", block=7).orderBy("i").collect()]
    assert got == [(sum if kind == "sum" else max)(values[: k + 1]) for k in range(100)]


def test_resilient_exporter_counts_a_batch_once():
    calls = []

    def failing(batch, batch_id):
        calls.append(batch_id)
        raise RuntimeError

    export = sinks.resilient(failing, RetryConfig(max_retries=1, initial_ms=0), BreakerConfig(2, 1_000_000, 1))
    for _ in range(2):
        with pytest.raises(RuntimeError):
            export(None, 0)
    with pytest.raises(sinks.CircuitOpen):
        export(None, 0)
    assert len(calls) == 4 and export.state == "Open"


def test_first_delivery_in_a_stream(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (1, 1, "2024-01-01 00:00:01"), (1, 2, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "tx_id long, lsn long, at string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = streams.first_delivery(streams.source(spark, f"{tmp_path}/in", df.schema), "1 hour", "at")
    streams.drain(stream, lambda batch, _: got.extend((r.tx_id, r.lsn) for r in batch.collect()), f"{tmp_path}/ck")
    assert sorted(got) == [(1, 1), (1, 2)]
