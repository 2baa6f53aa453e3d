"""The same queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

HOUR_US = 3_600_000_000

_MESSAGES = """messages AS (SELECT (user_id % {lanes})::BIGINT AS producer_id,
  row_number() OVER (PARTITION BY user_id % {lanes} ORDER BY ts, event_id) - 1 AS seq,
  event_id, event_type, user_id, epoch_us(ts) AS ts_us, round(value * 100)::BIGINT AS value_c FROM events)"""
_DATA = """data AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS lsn,
  l_orderkey + 1 AS tx_id, CASE l_returnflag WHEN 'N' THEN 'Insert' WHEN 'R' THEN 'Update' ELSE 'Delete' END AS op,
  l_partkey AS key, round(l_extendedprice * 100)::BIGINT AS value FROM lineitem)"""
_MARKERS = """markers AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS mlsn, o_orderkey + 1 AS tx_id,
  CASE o_orderstatus WHEN 'F' THEN 'Commit' ELSE 'Abort' END AS op FROM orders WHERE o_orderstatus IN ('F', 'P'))"""
_SPANS = (
    _MESSAGES.format(lanes=8)
    + """, spans AS (SELECT lpad(lower(hex(producer_id * 281474976710656 + seq // 5)), 32, '0') AS trace_id,
  producer_id * 281474976710656 + seq AS span_id,
  CASE WHEN seq % 5 = 0 THEN 0 ELSE producer_id * 281474976710656 + seq - 1 END AS parent_span_id,
  ts_us * 1000 AS start_ns, ts_us * 1000 + round(e.value * 1000000)::BIGINT AS end_ns, m.event_type AS name,
  CASE m.event_type WHEN 'click' THEN 'Client' WHEN 'view' THEN 'Server' WHEN 'purchase' THEN 'Producer' WHEN 'signup' THEN 'Consumer' ELSE 'Internal' END AS kind,
  CASE m.event_type WHEN 'error' THEN 'Error' ELSE 'Ok' END AS status, e.props, producer_id, seq
  FROM messages m JOIN events e USING (event_id))"""
)
_ARRIVALS = """arrivals AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) AS ts_us, event_id, event_type = 'error' AS is_error FROM events)"""
_BATCHES = (
    _ARRIVALS
    + """, batches AS (SELECT pos // 100 AS batch_id, count(*) AS n_spans, max(ts_us) AS at_us, (pos // 100) % 5 AS fails, (pos // 100) % 8 < 4 AS failed
  FROM arrivals GROUP BY pos // 100)"""
)
_STATE = f"""{_DATA}, {_MARKERS}, last AS (SELECT key, arg_max({{{{'op': d.op, 'value': d.value}}}}, m.mlsn * 1000000000 + d.lsn) AS w
  FROM data d JOIN markers m ON d.tx_id = m.tx_id AND m.op = 'Commit' GROUP BY key),
state AS (SELECT key, w.value AS value FROM last WHERE w.op <> 'Delete')""".replace("{{", "{").replace("}}", "}")
_CRASH = f"""{_DATA}, ends AS (SELECT (lsn - 1) // 256 AS b, max(lsn) AS e FROM data GROUP BY 1),
cut AS (SELECT coalesce(max(e), 0) AS c FROM ends WHERE b % 5 <> 4),
crashed AS (SELECT data.*, CASE WHEN lsn % 97 = 0 THEN 'unwritten' WHEN lsn <= (SELECT c FROM cut) THEN 'durable' ELSE 'lost' END AS tier FROM data)"""
_M16 = _MESSAGES.format(lanes=16)


#: Entries in segments of 1000 and whether they outlive the damage: a torn or a flipped
#: end costs a segment its last entry; a last byte that is zero already would not change.
_HELD = f"""{_DATA}, held AS (SELECT *, (lsn - 1) // 1000 AS segment_id,
  CASE WHEN (lsn - 1) // 1000 % 5 = 3 THEN 'partial' WHEN (lsn - 1) // 1000 % 7 = 4 THEN 'checksum' ELSE 'end' END AS ended,
  NOT (((lsn - 1) // 1000 % 5 = 3 OR (lsn - 1) // 1000 % 7 = 4) AND lsn = max(lsn) OVER (PARTITION BY (lsn - 1) // 1000)) AS whole FROM data)"""


def _struck(kind: str, ppm: int) -> str:
    return f"('0x' || substr(md5('42:{kind}:' || lsn::VARCHAR), 1, 8))::BIGINT % 1000000 < {ppm}"


def _occupancy(capacity: int, per_tick: int, need: int, verdict: str) -> str:
    return f"""WITH RECURSIVE {_M16},
fold AS (SELECT producer_id, seq, ts_us // {HOUR_US} AS tick, true AS ok, {need}::BIGINT AS occupied FROM messages WHERE seq = 0
  UNION ALL SELECT m.producer_id, m.seq, m.ts_us // {HOUR_US}, o.free + {need} <= {capacity}, o.free + CASE WHEN o.free + {need} <= {capacity} THEN {need} ELSE 0 END
  FROM fold f JOIN messages m ON m.producer_id = f.producer_id AND m.seq = f.seq + 1,
  LATERAL (SELECT greatest(0, f.occupied - {per_tick} * (m.ts_us // {HOUR_US} - f.tick)) AS free) o)
SELECT producer_id, seq, ok AS {verdict}, occupied FROM fold"""


ORACLE_SQL: dict[str, str] = {
    "channel_merge_order": f"WITH {_M16} SELECT producer_id, seq, event_id, row_number() OVER (ORDER BY producer_id, seq) - 1 AS pos FROM messages",
    "channel_bounded_drain": f"WITH {_M16} SELECT producer_id, count(*) AS drained, max(seq) AS last_seq FROM (SELECT * FROM messages ORDER BY producer_id, seq LIMIT 1000) GROUP BY producer_id",
    "lane_bounded_drain": f"WITH {_M16} SELECT producer_id, count(*) AS drained, sum(value_c)::BIGINT AS value_c FROM messages WHERE seq < 100 GROUP BY producer_id",
    "lane_peek": f"WITH {_M16} SELECT producer_id, seq, event_id, value_c FROM messages WHERE producer_id = 3 ORDER BY seq LIMIT 64",
    "lane_depths": f"""WITH {_M16}, heads AS (SELECT producer_id, max(seq) + 1 AS head FROM (SELECT * FROM messages ORDER BY producer_id, seq LIMIT 1000) GROUP BY producer_id),
t AS (SELECT producer_id, coalesce(any_value(head), 0) AS head, max(seq) + 1 AS tail FROM messages LEFT JOIN heads USING (producer_id) GROUP BY producer_id)
SELECT producer_id, head, tail, tail - head AS length, tail = head AS is_empty, tail - head >= 512 AS is_full FROM t""",
    "lane_metrics": f"""WITH {_M16}, m AS (SELECT producer_id, count(*) AS messages, ((count(*) + 63) // 64)::BIGINT AS batches FROM messages GROUP BY producer_id)
SELECT * FROM m UNION ALL SELECT -1, sum(messages)::BIGINT, sum(batches)::BIGINT FROM m""",
    "register_producers": """WITH f AS (SELECT user_id, min(ts) AS t, arg_min(event_id, ts) AS e FROM events GROUP BY user_id), n AS (SELECT user_id, row_number() OVER (ORDER BY t, e) - 1 AS id FROM f)
SELECT user_id, CASE WHEN id < 128 THEN id ELSE -1 END AS producer_id, id < 128 AS accepted FROM n""",
    "fifo_violations": f"""WITH {_M16}, l AS (SELECT producer_id, seq, lag(seq) OVER (PARTITION BY producer_id ORDER BY ts_us, event_id) AS p FROM messages)
SELECT producer_id, count(*) AS messages, (count(*) FILTER (seq <> coalesce(p + 1, 0)))::BIGINT AS violations FROM l GROUP BY producer_id""",
    "commit_prefix": f"WITH {_M16} SELECT producer_id, seq // 64 AS batch_no, count(*) AS reserved, least(48, count(*)) AS committed, 48 <= count(*) AS exact_ok FROM messages GROUP BY producer_id, seq // 64",
    "occupancy_try_send": _occupancy(8, 1, 1, "accepted"),
    "occupancy_reserve": _occupancy(16, 2, 3, "granted"),
    "send_status": _occupancy(8, 1, 1, "accepted").replace("SELECT producer_id, seq, ok AS accepted, occupied FROM fold", "SELECT producer_id, CASE WHEN seq >= 500 THEN 'closed' WHEN ok THEN 'ok' ELSE 'full' END AS status, count(*) AS n FROM fold GROUP BY ALL"),
    "stream_chunks": f"""WITH {_M16}, p AS (SELECT row_number() OVER (ORDER BY producer_id, seq) - 1 AS pos, value_c FROM messages)
SELECT pos // 64 AS batch_no, count(*) AS items, min(pos) AS first_pos, max(pos) AS last_pos, sum(value_c)::BIGINT AS value_c FROM p GROUP BY pos // 64""",
    "stream_map_filter": f"WITH {_M16} SELECT producer_id, seq, value_c * 2 AS doubled_c FROM messages WHERE event_type = 'purchase' ORDER BY producer_id, seq LIMIT 100",
    "wal_assign_lsn": f"WITH {_DATA} SELECT lsn, tx_id, op, key, value FROM data",
    "wal_group_commit": f"""WITH {_DATA}, {_MARKERS}, r AS (SELECT lsn AS pos, op FROM data UNION ALL SELECT mlsn + (SELECT count(*) FROM data), op FROM markers)
SELECT (pos - 1) // 256 AS batch_no, count(*) AS records, (count(*) FILTER (op = 'Commit'))::BIGINT AS waiters, max(pos) AS durable_lsn FROM r GROUP BY (pos - 1) // 256""",
    "wal_segment_rotation": f"""WITH RECURSIVE {_DATA},
sized AS (SELECT lsn, (33 + 8 + length(key::VARCHAR) + (CASE op WHEN 'Update' THEN 2 ELSE 1 END) * (8 + length(value::VARCHAR)))::BIGINT AS b FROM data),
sums AS (SELECT lsn, b, sum(b) OVER (ORDER BY lsn)::BIGINT AS c FROM sized),
seg AS (SELECT 0::BIGINT AS segment_id, 1::BIGINT AS first_lsn, (SELECT min(lsn) FROM sums WHERE c >= 65536) AS last_lsn
  UNION ALL SELECT segment_id + 1, last_lsn + 1, (SELECT min(lsn) FROM sums s WHERE s.c - (SELECT c FROM sums p WHERE p.lsn = seg.last_lsn) >= 65536) FROM seg
  WHERE last_lsn IS NOT NULL AND last_lsn < (SELECT max(lsn) FROM sums)),
ends AS (SELECT segment_id, first_lsn, coalesce(last_lsn, (SELECT max(lsn) FROM sums)) AS last_lsn FROM seg)
SELECT segment_id, first_lsn, last_lsn, last_lsn - first_lsn + 1 AS entries, (SELECT sum(b)::BIGINT FROM sums s WHERE s.lsn BETWEEN e.first_lsn AND e.last_lsn) AS bytes FROM ends e""",
    "wal_recover_tx": f"""WITH {_DATA}, {_MARKERS}, n AS (SELECT tx_id, count(*) AS entries FROM data GROUP BY tx_id)
SELECT coalesce(n.tx_id, m.tx_id) AS tx_id, CASE m.op WHEN 'Commit' THEN 'Commit' WHEN 'Abort' THEN 'Rollback' ELSE 'Incomplete' END AS class, coalesce(entries, 0) AS entries
FROM n FULL JOIN markers m ON n.tx_id = m.tx_id""",
    "wal_recovery_stats": f"""WITH {_DATA}, {_MARKERS}, n AS (SELECT tx_id, count(*) AS entries FROM data GROUP BY tx_id)
SELECT CASE m.op WHEN 'Commit' THEN 'Commit' WHEN 'Abort' THEN 'Rollback' ELSE 'Incomplete' END AS class, count(*) AS transactions, sum(coalesce(entries, 0))::BIGINT AS entries
FROM n FULL JOIN markers m ON n.tx_id = m.tx_id GROUP BY 1""",
    "wal_marker_last_wins": f"""WITH {_MARKERS}, a AS (SELECT * FROM markers UNION ALL SELECT mlsn + (SELECT count(*) FROM orders), tx_id, CASE op WHEN 'Commit' THEN 'Abort' ELSE 'Commit' END FROM markers WHERE tx_id % 7 = 0)
SELECT tx_id, CASE arg_max(op, mlsn) WHEN 'Commit' THEN 'Commit' ELSE 'Rollback' END AS class FROM a GROUP BY tx_id""",
    "wal_checkpoint": f"WITH {_MARKERS}, c AS (SELECT coalesce(max(tx_id), 0) AS t FROM markers WHERE op = 'Commit') SELECT CASE WHEN t > 100 THEN t ELSE 100 END AS checkpoint_tx_id, t > 100 AS advanced FROM c",
    "wal_truncate": f"""WITH {_DATA}, {_MARKERS}, s AS (SELECT (lsn - 1) // 1000 AS segment_id, max(d.tx_id) AS max_tx_id, count(DISTINCT d.tx_id) FILTER (m.tx_id IS NULL) AS open_transactions
  FROM data d LEFT JOIN markers m ON d.tx_id = m.tx_id GROUP BY 1),
d AS (SELECT *, segment_id < (SELECT max(segment_id) FROM s) AND max_tx_id > 0 AND max_tx_id < (SELECT max(tx_id) FROM markers WHERE op = 'Commit') AS dropped FROM s)
SELECT segment_id, max_tx_id, open_transactions, dropped, dropped AND open_transactions = 0 AS safe_to_drop FROM d""",
    "wal_truncate_before": f"""WITH {_DATA}, s AS (SELECT (lsn - 1) // 1000 AS segment_id, count(*) AS entries, min(lsn) AS first_lsn, max(lsn) AS last_lsn FROM data GROUP BY 1)
SELECT * FROM s WHERE segment_id < (SELECT max(segment_id) FROM s) AND last_lsn < 25500""",
    "wal_next_tx_id": f"WITH {_DATA}, {_MARKERS} SELECT max(tx_id) + 1 AS next_tx_id FROM (SELECT tx_id FROM data UNION ALL SELECT tx_id FROM markers)",
    "wal_replay_state": f"WITH {_STATE} SELECT key, value FROM state",
    "store_point_get": f"WITH {_STATE} SELECT key, value FROM state WHERE key IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)",
    "store_snapshot_size": f"WITH {_STATE} SELECT count(*) AS keys, coalesce(sum(value), 0)::BIGINT AS total FROM state",
    "wal_crash_durable": f"WITH {_CRASH} SELECT op, tier, count(*) AS entries FROM crashed GROUP BY op, tier",
    "verify_recovery": f"""WITH {_MARKERS}, c AS (SELECT tx_id FROM markers WHERE op = 'Commit')
SELECT CASE WHEN tx_id % 11 <> 0 AND tx_id % 13 <> 0 THEN 'found' WHEN tx_id % 11 <> 0 THEN 'lost' ELSE 'phantom' END AS status, tx_id FROM c WHERE tx_id % 11 <> 0 OR tx_id % 13 <> 0""",
    "wal_tx_atomicity": f"""WITH {_CRASH}, {_MARKERS} SELECT c.tx_id, count(*) AS logged, (count(*) FILTER (tier = 'durable'))::BIGINT AS replayed, count(*) = count(*) FILTER (tier = 'durable') AS atomic
FROM crashed c JOIN markers m ON c.tx_id = m.tx_id AND m.op = 'Commit' GROUP BY c.tx_id""",
    "span_duration_stats": f"WITH {_SPANS} SELECT name, kind, count(*) AS n, min(end_ns - start_ns) AS min_ns, max(end_ns - start_ns) AS max_ns, sum(end_ns - start_ns)::BIGINT AS sum_ns FROM spans GROUP BY name, kind",
    "span_trace_groups": f"WITH {_SPANS} SELECT trace_id, count(*) AS spans, min(span_id) AS first_span, max(span_id) AS last_span, (count(*) FILTER (parent_span_id = 0))::BIGINT AS roots FROM spans GROUP BY trace_id",
    "span_parent_join": f"""WITH {_SPANS} SELECT s.trace_id, s.span_id, s.name, (count(c.span_id))::BIGINT AS children FROM spans s LEFT JOIN spans c ON c.trace_id = s.trace_id AND c.parent_span_id = s.span_id AND c.parent_span_id <> 0
GROUP BY s.trace_id, s.span_id, s.name""",
    "span_orphans": f"""WITH {_SPANS}, k AS (SELECT * FROM spans WHERE seq % 17 <> 0) SELECT trace_id, span_id, parent_span_id FROM k
WHERE parent_span_id <> 0 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.trace_id = k.trace_id AND p.span_id = k.parent_span_id)""",
    "span_validation": f"""WITH {_SPANS}, k AS (SELECT * FROM spans WHERE seq % 17 <> 0)
SELECT 'unique_id' AS rule, (count(*) - count(DISTINCT (trace_id, span_id)))::BIGINT AS breaches FROM k
UNION ALL SELECT 'parent_exists', count(*) FROM k WHERE parent_span_id <> 0 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.trace_id = k.trace_id AND p.span_id = k.parent_span_id)
UNION ALL SELECT 'time_order', count(*) FROM k WHERE end_ns < start_ns
UNION ALL SELECT 'final_status', count(*) FROM k WHERE status = 'Unset'
UNION ALL SELECT 'identity', count(*) FROM k WHERE span_id = 0""",
    "span_attributes": f"WITH {_SPANS} SELECT json_extract(props, '$.k')::BIGINT AS attribute, count(*) AS n, (count(*) FILTER (status = 'Error'))::BIGINT AS errors FROM spans GROUP BY 1",
    "span_error_rate": f"WITH {_SPANS} SELECT producer_id, count(*) AS total, (count(*) FILTER (status = 'Error'))::BIGINT AS errors, ((count(*) FILTER (status = 'Error')) * 1000000 // count(*))::BIGINT AS error_ppm FROM spans GROUP BY producer_id",
    "span_batch_by_size": f"WITH {_ARRIVALS} SELECT pos // 512 AS batch_no, count(*) AS spans, min(ts_us) AS first_us, max(ts_us) AS last_us FROM arrivals GROUP BY 1",
    "span_batch_size_or_timeout": f"""WITH RECURSIVE {_ARRIVALS}, z AS (SELECT max(pos) AS last FROM arrivals),
b AS (SELECT 0::BIGINT AS batch_no, 0::BIGINT AS a, least((SELECT last FROM z), 99, coalesce((SELECT min(pos) FROM arrivals WHERE ts_us - (SELECT ts_us FROM arrivals WHERE pos = 0) >= {6 * HOUR_US}), 99)) AS e
  UNION ALL SELECT batch_no + 1, e + 1, least((SELECT last FROM z), e + 100, coalesce((SELECT min(pos) FROM arrivals t WHERE t.pos > b.e AND t.ts_us - (SELECT ts_us FROM arrivals f WHERE f.pos = b.e) >= {6 * HOUR_US}), e + 100))
  FROM b WHERE e < (SELECT last FROM z))
SELECT batch_no, e - a + 1 AS spans, f.ts_us AS first_us, l.ts_us AS last_us FROM b JOIN arrivals f ON f.pos = a JOIN arrivals l ON l.pos = e""",
    "span_id_decode": f"WITH {_SPANS} SELECT span_id, span_id >> 48 AS producer, span_id & 281474976710655 AS sequence FROM spans",
    "export_metrics": f"""WITH {_BATCHES} SELECT count(*) AS batches, sum(n_spans)::BIGINT AS spans, (count(*) FILTER (failed))::BIGINT AS failed_batches, coalesce(sum(n_spans) FILTER (failed), 0)::BIGINT AS failed_spans FROM batches""",
    "retry_schedule": f"WITH {_BATCHES} SELECT batch_id, least(fails + 1, 4)::BIGINT AS attempts, [0, 100, 300, 700][least(fails + 1, 4)]::BIGINT AS waited_ms, fails < 4 AS recovered FROM batches",
    "circuit_breaker": f"""WITH RECURSIVE {_BATCHES},
fold AS (SELECT -1::BIGINT AS batch_id, 'Closed' AS state, 0 AS failures, 0 AS successes, 0::BIGINT AS last, '' AS outcome
  UNION ALL SELECT b.batch_id,
    CASE WHEN g.s = 'Open' THEN 'Open' WHEN g.s = 'Closed' THEN CASE WHEN b.failed AND f.failures + 1 >= 3 THEN 'Open' ELSE 'Closed' END
      ELSE CASE WHEN b.failed THEN 'Open' WHEN g.n + 1 >= 2 THEN 'Closed' ELSE 'HalfOpen' END END,
    CASE WHEN g.s = 'Open' THEN f.failures WHEN g.s = 'Closed' THEN CASE WHEN b.failed THEN f.failures + 1 ELSE 0 END WHEN NOT b.failed AND g.n + 1 >= 2 THEN 0 ELSE f.failures END,
    CASE WHEN g.s = 'Open' THEN f.successes WHEN b.failed THEN 0 WHEN g.s = 'HalfOpen' THEN g.n + 1 ELSE g.n END,
    CASE WHEN g.s <> 'Open' AND b.failed THEN b.at_us ELSE f.last END,
    CASE WHEN g.s = 'Open' THEN 'rejected' WHEN b.failed THEN 'failed' ELSE 'ok' END
  FROM fold f JOIN batches b ON b.batch_id = f.batch_id + 1,
  LATERAL (SELECT CASE WHEN f.state = 'Open' AND b.at_us - f.last >= {8 * HOUR_US} THEN 'HalfOpen' ELSE f.state END AS s,
    CASE WHEN f.state = 'Open' AND b.at_us - f.last >= {8 * HOUR_US} THEN 0 ELSE f.successes END AS n) g)
SELECT batch_id, outcome, state FROM fold WHERE batch_id >= 0""",
    "rate_limited_export": f"""WITH RECURSIVE {_BATCHES}, origin AS (SELECT at_us AS o FROM batches WHERE batch_id = 0),
fold AS (SELECT batch_id, at_us, at_us AS leaves FROM batches WHERE batch_id = 0
  UNION ALL SELECT b.batch_id, b.at_us, greatest(b.at_us, (SELECT o FROM origin) + ((f.leaves - (SELECT o FROM origin)) // {8 * HOUR_US} + 1) * {8 * HOUR_US}) FROM fold f JOIN batches b ON b.batch_id = f.batch_id + 1)
SELECT batch_id, leaves AS leaves_us, leaves - at_us AS waited_us FROM fold""",
    "producer_count": "WITH n AS (SELECT count(DISTINCT user_id) AS u FROM events) SELECT least(u, 128) AS producers, greatest(u - 128, 0) AS refused, 128 - least(u, 128) AS free FROM n",
    "channel_metrics": f"""WITH {_M16}, d AS (SELECT producer_id, count(*) AS r FROM (SELECT * FROM messages ORDER BY producer_id, seq LIMIT 1000) GROUP BY producer_id),
m AS (SELECT producer_id, count(*) AS sent, coalesce(any_value(r), 0) AS received FROM messages LEFT JOIN d USING (producer_id) GROUP BY producer_id)
SELECT producer_id, sent, received, ((sent + 63) // 64)::BIGINT AS batches_sent, ((received + 63) // 64)::BIGINT AS batches_received FROM m""",
    "collector_metrics": _occupancy(8, 1, 1, "accepted").replace("SELECT producer_id, seq, ok AS accepted, occupied FROM fold", "SELECT producer_id, (count(*) FILTER (ok))::BIGINT AS submitted, (count(*) FILTER (NOT ok))::BIGINT AS full, arg_max(occupied, seq)::BIGINT AS in_flight, ((count(*) FILTER (ok)) - arg_max(occupied, seq))::BIGINT AS consumed FROM fold GROUP BY producer_id"),
    "wal_group_commit_gap": f"""WITH {_M16}, l AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY producer_id ORDER BY seq) >= {4 * HOUR_US} AS late FROM messages),
r AS (SELECT *, (sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY producer_id ORDER BY seq))::BIGINT AS run_no FROM l),
p AS (SELECT *, (row_number() OVER (PARTITION BY producer_id, run_no ORDER BY seq) - 1) // 16 AS batch_no FROM r)
SELECT producer_id, run_no, batch_no, count(*) AS records, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) < 16 AS by_gap FROM p GROUP BY producer_id, run_no, batch_no""",
    "wal_segment_scan": f"WITH {_HELD} SELECT segment_id, (count(*) FILTER (whole))::BIGINT AS entries, coalesce(max(tx_id) FILTER (whole), 0) AS max_tx_id, any_value(ended) AS ended FROM held GROUP BY segment_id",
    "wal_damage_stats": f"WITH {_HELD} SELECT count(DISTINCT segment_id) FILTER (ended = 'partial') AS partial_writes, count(DISTINCT segment_id) FILTER (ended = 'checksum') AS checksum_failures FROM held",
    "wal_scan_recover": f"""WITH {_HELD}, {_MARKERS}, n AS (SELECT tx_id, count(*) AS entries FROM held WHERE whole GROUP BY tx_id)
SELECT CASE m.op WHEN 'Commit' THEN 'Commit' WHEN 'Abort' THEN 'Rollback' ELSE 'Incomplete' END AS class, count(*) AS transactions, sum(coalesce(entries, 0))::BIGINT AS entries
FROM n FULL JOIN markers m ON n.tx_id = m.tx_id GROUP BY 1""",
    "store_apply_each": f"""WITH {_DATA}, {_MARKERS}, c AS (SELECT d.*, m.mlsn FROM data d JOIN markers m ON d.tx_id = m.tx_id AND m.op = 'Commit')
SELECT key, (count(*) FILTER (op <> 'Delete'))::BIGINT AS writes, coalesce(sum(value) FILTER (op <> 'Delete'), 0)::BIGINT AS total, arg_max(op, mlsn * 1000000000 + lsn) AS last_op FROM c GROUP BY key""",
    "wal_seeded_faults": f"""WITH {_DATA}, f AS (SELECT op, CASE WHEN {_struck("write", 10_000)} THEN 'write' WHEN {_struck("partial", 5_000)} THEN 'partial' WHEN {_struck("read", 20_000)} THEN 'read' ELSE 'none' END AS fault FROM data)
SELECT op, fault, count(*) AS entries FROM f GROUP BY op, fault""",
    "span_trace_paths": f"WITH {_SPANS} SELECT trace_id, count(*) AS n, string_agg((span_id & 281474976710655)::VARCHAR || ':' || name, ',' ORDER BY span_id) AS path FROM spans GROUP BY trace_id",
}
