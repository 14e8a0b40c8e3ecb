"""SQL counterparts of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

# Common table expressions, each with the ones it builds on.
_VIEWS: dict[str, tuple[str, list[str]]] = {
    "log": (
        """SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS part,
             row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS off,
             CAST(user_id AS VARCHAR) AS log_key, props AS log_value, epoch_us(ts) AS ts_us,
             event_id, event_type, value AS amount
           FROM events""",
        [],
    ),
    "ranges": (
        "SELECT topic, part, min(off) AS oldest, max(off) + 1 AS newest FROM log GROUP BY topic, part",
        ["log"],
    ),
    "saved": (
        """SELECT topic, part, CAST(CASE part WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 100 ELSE newest END AS BIGINT)
             AS saved FROM ranges""",
        ["ranges"],
    ),
    "resume": (
        """SELECT topic, part, oldest, newest, saved,
             CASE WHEN newest <= 0 THEN 0 WHEN saved < 0 THEN oldest WHEN saved > 0 AND saved < oldest THEN NULL
                  WHEN saved + 1 >= newest THEN newest ELSE saved + 1 END AS first_offset,
             CAST(CASE WHEN newest <= 0 OR saved < 0 THEN -2 WHEN saved > 0 AND saved < oldest THEN NULL
                  WHEN saved + 1 >= newest THEN -1 ELSE saved + 1 END AS BIGINT) AS start_at
           FROM ranges JOIN saved USING (topic, part)""",
        ["saved"],
    ),
    "resume_cases": (
        """SELECT *,
             CASE WHEN newest <= 0 THEN 0 WHEN saved < 0 THEN oldest WHEN saved > 0 AND saved < oldest THEN NULL
                  WHEN saved + 1 >= newest THEN newest ELSE saved + 1 END AS first_offset,
             CAST(CASE WHEN newest <= 0 OR saved < 0 THEN -2 WHEN saved > 0 AND saved < oldest THEN NULL
                  WHEN saved + 1 >= newest THEN -1 ELSE saved + 1 END AS BIGINT) AS start_at,
             CASE WHEN newest > 0 AND saved > 0 AND saved < oldest THEN 'rows_lost' END AS problem
           FROM (
             SELECT topic, part, min(off) AS oldest, max(off) + 1 AS newest,
               CAST(CASE part WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 100 ELSE max(off) + 1 END AS BIGINT) AS saved
             FROM log WHERE NOT (part = 2 AND off < 150) GROUP BY topic, part
             UNION ALL
             SELECT 'events', 4, 0, 0, -1)""",
        ["log"],
    ),
    "frontier_steps": (
        """SELECT topic, part, b AS off, min(reached) AS frontier FROM (
             SELECT topic, part, b, saved AS reached FROM saved, range(4) t(b)
             UNION ALL
             SELECT c.topic, c.part, b, c.off FROM confirmed c JOIN saved s USING (topic, part), range(4) t(b)
             WHERE c.off > s.saved AND least(3, c.off // 1000) <= b
           ) candidates
           WHERE NOT EXISTS (SELECT 1 FROM confirmed n WHERE n.topic = candidates.topic AND n.part = candidates.part
             AND n.off = candidates.reached + 1 AND least(3, n.off // 1000) <= candidates.b)
           GROUP BY topic, part, b""",
        ["saved", "confirmed"],
    ),
    "confirmed": ("SELECT topic, part, off FROM log WHERE NOT (event_type = 'error' AND amount > 100)", ["log"]),
    "frontiers": (
        """SELECT topic, part, min(reached) AS frontier FROM (
             SELECT topic, part, saved AS reached FROM saved
             UNION ALL
             SELECT c.topic, c.part, c.off FROM confirmed c JOIN saved s USING (topic, part) WHERE c.off > s.saved
           ) candidates
           WHERE NOT EXISTS (SELECT 1 FROM confirmed n WHERE n.topic = candidates.topic
             AND n.part = candidates.part AND n.off = candidates.reached + 1)
           GROUP BY topic, part""",
        ["saved", "confirmed"],
    ),
    "outbox": (
        """SELECT event_id + 1 AS id, 'events' AS topic, event_type, value AS amount,
             CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'sent' WHEN 'purchase' THEN 'acked'
                  ELSE 'new' END AS state
           FROM events""",
        [],
    ),
    "drain": (
        """SELECT id, topic, state, CAST(CASE state WHEN 'failed' THEN 0 ELSE 1 END AS INTEGER) AS rank,
             row_number() OVER (PARTITION BY topic, state ORDER BY id) AS place
           FROM outbox WHERE state IN ('failed', 'new')""",
        ["outbox"],
    ),
    "codes": (
        """SELECT event_id, CAST(CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
             WHEN 'purchase' THEN 64 ELSE CASE WHEN value > 100 THEN 129 ELSE 128 END END AS INTEGER) AS code
           FROM events""",
        [],
    ),
    "msg": (
        """SELECT conv_id, turn, role, 'conv' AS app, conv_id || '-' || turn AS id,
             CAST(conv_id % 2 + 1 AS INTEGER) AS session_type,
             CAST(CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 128 END AS INTEGER) AS msg_type,
             CAST(1 AS BIGINT) AS ver,
             (1704067200 + conv_id * 86400 + turn * 60) * 1000000000 AS ts_nanos,
             CAST(CASE conv_id % 4 WHEN 0 THEN 32 WHEN 1 THEN 33 WHEN 2 THEN 64 ELSE 65 END AS INTEGER) AS from_user,
             CAST(CASE (conv_id + 1) % 4 WHEN 0 THEN 32 WHEN 1 THEN 33 WHEN 2 THEN 64 ELSE 65 END AS INTEGER)
               AS to_user,
             CAST(CASE role WHEN 'system' THEN 0 ELSE 1 END AS INTEGER) AS to_count,
             md5(text) AS text_md5, text
           FROM conversations""",
        [],
    ),
    "msg_flat": (
        """SELECT *, from_user AS from_channel, from_user || ':' || from_user AS sender,
             app || '_' || id || '_' || ts_nanos AS doc_id,
             strftime(make_timestamp(ts_nanos // 1000), '%Y-%m') AS month
           FROM msg""",
        ["msg"],
    ),
    "request_log": (
        """SELECT *, 'requests' AS topic, CAST(conv_id % 4 AS INTEGER) AS part,
             conv_id // 4 * 1048576 + turn AS off, 1 AS pass_no, ver AS sent_ver,
             CASE WHEN (conv_id + turn) % 13 = 12 THEN 'null_record'
                  WHEN (conv_id + turn) % 11 IN (1, 2, 5) THEN 'undecodable'
                  WHEN (conv_id + turn) % 11 = 9 THEN 'ts_out_of_range' END AS damage,
             CAST(CASE WHEN (conv_id + turn) % 11 = 7 THEN 0 ELSE 1 END AS INTEGER) AS type
           FROM msg_flat
           UNION ALL
           SELECT *, 'requests', CAST(conv_id % 4 AS INTEGER), conv_id // 4 * 1048576 + 524288 + turn, 2,
             CAST(CASE role WHEN 'user' THEN 2 ELSE 1 END AS BIGINT), NULL, 1
           FROM msg_flat""",
        ["msg_flat"],
    ),
    # the text of each request, damaged as the log has it
    "request_text": (
        """SELECT *, CASE WHEN pass_no = 2 THEN whole
             WHEN (conv_id + turn) % 11 = 5 THEN '{bad'
             WHEN (conv_id + turn) % 11 = 1 THEN whole || 'and more'
             WHEN (conv_id + turn) % 11 = 2 THEN whole || whole
             WHEN (conv_id + turn) % 11 = 3 THEN E'\\n\\t' || whole || E' \\r\\n'
             WHEN (conv_id + turn) % 11 = 9 THEN replace(whole, CAST(ts_nanos AS VARCHAR), '18446744073709551615')
             ELSE whole END AS value
           FROM (SELECT *, '{"type":1,"tsNanos":' || ts_nanos || ',"msgReq":{"id":"' || id || '","app":"conv","session":{"type":'
             || session_type || ',"data":[{"name":"text","value":{"format":0,"data":"' || base64(encode(text))
             || '"}}]},"msg":{"type":' || msg_type || ',"id":"' || id || '","ver":' || sent_ver || ',"tsNanos":' || ts_nanos
             || '},"from":{"user":{"type":' || from_user || '},"channel":{"type":' || from_user || '}},"to":['
             || CASE WHEN to_count = 0 THEN '' ELSE '{"user":{"type":' || to_user || '},"channel":{"type":' || to_user || '}}' END
             || ']}}' AS whole FROM request_log)""",
        ["request_log"],
    ),
    "accepted": (
        "SELECT * FROM request_log WHERE damage IS NULL AND type = 1 AND to_count > 0",
        ["request_log"],
    ),
    # dealt to three partitions by sender, the first landing before the second
    "keyed": (
        """SELECT target AS part, row_number() OVER (PARTITION BY target ORDER BY pass_no, off, part) - 1 AS off, sender, doc_id
           FROM (SELECT *, CAST(CAST('0x' || left(md5(sender), 8) AS BIGINT) % 3 AS INTEGER) AS target FROM accepted)""",
        ["accepted"],
    ),
    # the second delivery of a document differs only in its version
    "request_fold": (
        """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass_no) AS nth,
             lag(sent_ver) OVER (PARTITION BY doc_id ORDER BY pass_no) AS old_ver
           FROM accepted""",
        ["accepted"],
    ),
    "created": ("SELECT * FROM request_fold WHERE nth = 1", ["request_fold"]),
    "doc_log": (
        """SELECT user_id, event_id, event_type, value AS amount, nullif(event_type, 'view') AS f_status,
             CASE WHEN value >= 10 THEN CAST(floor(value / 50) AS INTEGER) END AS f_tier
           FROM events""",
        [],
    ),
    "doc_old": (
        """SELECT *,
             last_value(f_status IGNORE NULLS) OVER w AS old_status,
             last_value(f_tier IGNORE NULLS) OVER w AS old_tier,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth
           FROM doc_log
           WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        ["doc_log"],
    ),
    "doc_outcome": (
        """SELECT *, coalesce(f_status, old_status) AS status_now, coalesce(f_tier, old_tier) AS tier_now,
             CASE WHEN nth = 1 THEN 'created'
                  WHEN coalesce(f_status, old_status) IS DISTINCT FROM old_status
                    OR coalesce(f_tier, old_tier) IS DISTINCT FROM old_tier THEN 'updated'
                  ELSE 'noop' END AS outcome
           FROM doc_old""",
        ["doc_old"],
    ),
}


def _needed(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        _needed(_VIEWS[name][1], seen)
        if name not in seen:
            seen.append(name)
    return seen


def _sql(body: str, *names: str) -> str:
    parts = [f"{name} AS ({_VIEWS[name][0]})" for name in _needed(list(names), [])]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


_REQUEST = """id, app, session_type, msg_type, {ver} AS ver, ts_nanos, from_user, from_channel, to_count, text_md5"""

_ENUM_NAMES = """CASE enum
  WHEN 'data_format' THEN CASE code WHEN 0 THEN 'RAW' WHEN 1 THEN 'JSON' ELSE 'PB' END
  WHEN 'session_type' THEN CASE code WHEN 1 THEN 'Chat' WHEN 2 THEN 'Message' ELSE 'Unknown' END
  WHEN 'role_type' THEN CASE code WHEN 0 THEN 'Unknonw' WHEN 1 THEN 'Agent' ELSE 'Client' END
  WHEN 'msg_type' THEN CASE code WHEN 1 THEN 'Agent' WHEN 2 THEN 'Client' WHEN 128 THEN 'BotHandover'
    ELSE 'Assign' END
  WHEN 'request_type' THEN CASE code WHEN 1 THEN 'MsgReq' ELSE 'Unknown' END
  WHEN 'event_type' THEN CASE code WHEN 10 THEN 'MsgDelivery' ELSE 'Unknown' END
  WHEN 'store_event_type' THEN CASE code WHEN 32 THEN 'MsgCreated' WHEN 33 THEN 'MsgUpdated' ELSE 'MsgDeleted' END
  WHEN 'delivery_code' THEN CASE code WHEN 1 THEN 'Accepted' WHEN 2 THEN 'Sent' WHEN 3 THEN 'Confirmed'
    WHEN 64 THEN 'Onhold' WHEN 128 THEN 'Failed' WHEN 129 THEN 'Aborted' END
  ELSE CASE code WHEN 32 THEN 'Chat' WHEN 33 THEN 'Message' WHEN 64 THEN 'Facebook' WHEN 65 THEN 'Twitter' END
  END"""

_CREATED = "SELECT part, off, {sender} 'docs_' || month AS doc_index, doc_id, CAST(1 AS BIGINT) AS version FROM created"

ORACLES: dict[str, str] = {
    "transform_chain": _sql("SELECT topic, part, off, log_key, log_value FROM log", "log"),
    "log_scan": _sql(
        """SELECT l.topic, l.part, l.off, l.log_key, l.log_value, l.ts_us
           FROM log l JOIN resume r USING (topic, part)
           WHERE r.start_at = -2 OR (r.start_at >= 0 AND l.off >= r.start_at)""",
        "resume",
    ),
    "partition_ranges": _sql("SELECT topic, part, oldest, newest FROM ranges", "ranges"),
    "resume_offsets": _sql("SELECT * FROM resume", "resume"),
    "resume_cases": _sql(
        """SELECT topic, part, oldest, newest, saved, coalesce(first_offset, -9) AS first_offset,
             coalesce(start_at, -9) AS start_at, coalesce(problem, '') AS problem FROM resume_cases""",
        "resume_cases",
    ),
    "starting_offsets": _sql(
        """SELECT '{"events":{' || string_agg('"' || part || '":' || start_at, ',' ORDER BY CAST(part AS VARCHAR)) || '}}'
             AS starting_offsets FROM resume_cases WHERE problem IS NULL""",
        "resume_cases",
    ),
    "json_requests": _sql(
        f"""SELECT conv_id || '/' || turn // 64 AS body_id,
             CAST(row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1 AS INTEGER) AS place,
             {_REQUEST.format(ver='ver')} FROM msg_flat WHERE conv_id % 10 NOT IN (3, 6)""",
        "msg_flat",
    ),
    "stream_bounded": _sql("SELECT topic, part, off, log_value FROM log", "log"),
    "keyed_sink": _sql("SELECT 'out-' || event_type AS topic, part, off, log_key, log_value FROM log", "log"),
    "upsert_snapshot": _sql(
        """SELECT doc_id, month, msg_type, max(sent_ver) AS msg_ver, from_user, to_count, text_md5,
             CAST(count(DISTINCT sent_ver) AS BIGINT) AS version
           FROM accepted GROUP BY doc_id, month, msg_type, from_user, to_count, text_md5""",
        "accepted",
    ),
    "store_restart": _sql(
        """SELECT doc_id, month, msg_type, max(sent_ver) AS msg_ver, from_user, to_count, text_md5,
             CAST(count(DISTINCT sent_ver) AS BIGINT) AS version
           FROM accepted GROUP BY doc_id, month, msg_type, from_user, to_count, text_md5""",
        "accepted",
    ),
    "levelled_store": _sql(
        """SELECT doc_id, month, msg_type, max(sent_ver) AS msg_ver, from_user, to_count, text_md5,
             CAST(count(DISTINCT sent_ver) AS BIGINT) AS version
           FROM accepted GROUP BY doc_id, month, msg_type, from_user, to_count, text_md5""",
        "accepted",
    ),
    "progress_latest": _sql(
        "SELECT topic, part, max(off) AS frontier, least(3, max(off) // 1000) AS batch_id FROM log GROUP BY topic, part", "log"
    ),
    "fan_out": _sql("SELECT sink, topic, part, off FROM log, (VALUES ('left'), ('right')) s(sink)", "log"),
    "decode_envelope": _sql(
        f"""SELECT topic, part, off, type, ts_nanos AS envelope_nanos, {_REQUEST.format(ver='sent_ver')}
           FROM request_log WHERE damage IS NULL""",
        "request_log",
    ),
    "quarantine": _sql(
        """SELECT topic, part, off, hex(log_key) AS key_hex, hex('{bad') AS value_hex, 'undecodable' AS reason
           FROM log WHERE event_id % 100 = 0
           UNION ALL
           SELECT topic, part, off, hex(sender), hex(value), coalesce(damage, 'no_recipient')
           FROM request_text
           WHERE damage IN ('undecodable', 'ts_out_of_range') OR (damage IS NULL AND type = 1 AND to_count = 0)""",
        "log",
        "request_text",
    ),
    "wrap_request": _sql(
        f"""SELECT CAST(1 AS INTEGER) AS type, ts_nanos + 1000000 AS envelope_nanos,
             {_REQUEST.format(ver='ver')} FROM msg_flat""",
        "msg_flat",
    ),
    "send_response": _sql(
        "SELECT id, app, session_type, text_md5, CAST(0 AS INTEGER) AS err_code, '' AS err_msg FROM msg_flat",
        "msg_flat",
    ),
    "sender_key": _sql("SELECT id, sender FROM msg_flat", "msg_flat"),
    "accept_delivery": _sql(
        """SELECT topic, part, off, sender, CAST(10 AS INTEGER) AS type, CAST(0 AS BIGINT) AS event_nanos, id,
             CAST(1 AS INTEGER) AS reports, from_user, to_user, CAST(1 AS INTEGER) AS code FROM accepted""",
        "accepted",
    ),
    "doc_id": _sql("SELECT conv_id, turn, doc_id FROM msg_flat", "msg_flat"),
    "month_index": _sql(
        """SELECT id, 'docs_' || month AS month_index FROM msg_flat
           UNION ALL
           SELECT CAST(o_orderkey AS VARCHAR), 'docs_' || strftime(o_orderdate, '%Y-%m') FROM orders""",
        "msg_flat",
    ),
    "doc_body": _sql(
        """SELECT conv_id, turn,
             '{"id":"' || id || '","app":"conv","session":{"type":' || session_type ||
             ',"data":[{"name":"text","value":{"data":"' || base64(encode(text)) || '"}}]},"msg":{"type":' ||
             msg_type || ',"id":"' || id || '","ver":1,"tsNanos":' || ts_nanos ||
             '},"from":{"user":{"type":' || from_user || '},"channel":{"type":' || from_user || '}}' ||
             CASE WHEN to_count = 0 THEN '' ELSE
               ',"to":[{"user":{"type":' || to_user || '},"channel":{"type":' || to_user || '}}]' END || '}' AS body
           FROM msg_flat""",
        "msg_flat",
    ),
    "created_events": _sql(
        """SELECT sender, CAST(32 AS INTEGER) AS type, CAST(0 AS BIGINT) AS event_nanos,
             'docs_' || month AS doc_index, doc_id, 'messages' AS doc_type, CAST(1 AS BIGINT) AS ver FROM created""",
        "created",
    ),
    "tag_union": _sql(
        """SELECT id, from_user AS user_tag, from_channel AS channel_tag, CAST(1 AS INTEGER) AS request_tag,
             ver AS request_ver, CAST(10 AS INTEGER) AS event_tag, id AS event_req,
             CAST(32 AS INTEGER) AS created_tag, id AS created_id, CAST(33 AS INTEGER) AS updated_tag,
             CAST(34 AS INTEGER) AS deleted_tag FROM msg_flat""",
        "msg_flat",
    ),
    "union_check": _sql(
        """SELECT id, CAST(CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END AS INTEGER) AS type,
             CASE WHEN turn % 5 = 4 THEN 'unknown_type' WHEN turn % 7 = 6 THEN 'payload_missing' ELSE 'valid' END
               AS verdict FROM msg_flat""",
        "msg_flat",
    ),
    "enum_names": _sql(
        f"""SELECT enum, code, count(*) AS uses, {_ENUM_NAMES} AS name FROM (
             SELECT 'data_format' AS enum, CAST(0 AS INTEGER) AS code FROM msg_flat
             UNION ALL SELECT 'session_type', session_type FROM msg_flat
             UNION ALL SELECT 'channel_type', from_channel FROM msg_flat
             UNION ALL SELECT 'user_type', from_user FROM msg_flat
             UNION ALL SELECT 'role_type', CASE WHEN msg_type <= 2 THEN msg_type ELSE 0 END FROM msg_flat
             UNION ALL SELECT 'msg_type', msg_type FROM msg_flat
             UNION ALL SELECT 'request_type', CASE WHEN turn % 5 = 4 THEN 0 ELSE 1 END FROM msg_flat
             UNION ALL SELECT 'event_type', CASE WHEN turn % 5 = 4 THEN 0 ELSE 10 END FROM msg_flat
             UNION ALL SELECT 'store_event_type', CASE role WHEN 'user' THEN 32 WHEN 'assistant' THEN 33 ELSE 34 END
               FROM msg_flat
             UNION ALL SELECT 'delivery_code', code FROM codes
           ) used GROUP BY enum, code""",
        "msg_flat",
        "codes",
    ),
    "event_time": """SELECT event_id, epoch_us(ts) AS event_us, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
             event_id % 1000 AS rest_nanos FROM events""",
    "route_mod": _sql("SELECT topic, part, off, CAST(off % 3 AS INTEGER) AS subscriber FROM log", "log"),
    "filter_request_type": _sql(
        "SELECT topic, part, off, id FROM request_log WHERE damage IS NULL AND type = 1", "request_log"
    ),
    "filter_event_type": _sql(
        """SELECT 'deliveries' AS topic, CAST(conv_id % 4 AS INTEGER) AS part, conv_id // 4 * 1048576 + turn AS off,
             CASE WHEN turn % 5 = 4 THEN 'unknown_type' ELSE 'upsert' END AS action FROM msg_flat""",
        "msg_flat",
    ),
    "filter_created": _sql(
        """SELECT CAST(conv_id % 4 AS INTEGER) AS part, conv_id // 4 * 1048576 + turn AS off,
             'docs_' || role AS doc_index, id AS doc_id, ver AS version FROM msg_flat WHERE role = 'user'""",
        "msg_flat",
    ),
    "outcome_action": _sql(
        """SELECT user_id, event_id, outcome, status,
             CASE WHEN status <> 429 AND outcome = 'created' THEN 'emit'
                  WHEN status <> 429 AND outcome = 'noop' THEN 'silent' ELSE 'report' END AS action
           FROM (SELECT *, CAST(CASE WHEN event_type = 'error' AND amount > 100 THEN 429
                   WHEN outcome = 'created' THEN 201 ELSE 200 END AS INTEGER) AS status FROM doc_outcome) o""",
        "doc_outcome",
    ),
    "delivery_class": _sql(
        """SELECT event_id, code, CASE WHEN code <= 3 THEN 'progress' WHEN code = 64 THEN 'pending'
             WHEN code = 128 THEN 'failed' ELSE 'aborted' END AS class, code = 128 AS retryable FROM codes""",
        "codes",
    ),
    "correlate_outcome": _sql(
        """SELECT topic, part, off, event_id,
             CAST(CASE WHEN event_type = 'error' AND amount > 100 THEN 429 ELSE 200 END AS INTEGER) AS status
           FROM log WHERE event_type <> 'signup'""",
        "log",
    ),
    "upsert_lookup": _sql(
        """SELECT doc_id, CAST(CASE WHEN found THEN 1 ELSE 0 END AS BIGINT) AS stored_version, found
           FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM accepted WHERE pass_no = 1) AS found FROM accepted WHERE pass_no = 2)""",
        "accepted",
    ),
    "unconfirmed": _sql("SELECT id, topic, event_type FROM outbox WHERE event_type = 'error'", "outbox"),
    "failed_sends": _sql(
        "SELECT id, topic, event_type FROM outbox WHERE event_type = 'error' AND amount > 100", "outbox"
    ),
    "frontier": _sql("SELECT topic, part, frontier FROM frontiers", "frontiers"),
    "held_stream": _sql(
        """SELECT topic, part, min(off) AS first_off, max(off) AS last_off FROM (
             SELECT topic, part, c.off, c.off - row_number() OVER (PARTITION BY topic, part ORDER BY c.off) AS run
             FROM (SELECT DISTINCT * FROM confirmed) c JOIN frontiers f USING (topic, part) WHERE c.off > f.frontier) held
           GROUP BY topic, part, off // 1048576, run""",
        "confirmed", "frontiers",
    ),
    "frontier_stream": _sql("SELECT topic, part, frontier FROM frontiers", "frontiers"),
    "held_offsets": _sql(
        """SELECT topic, part, c.off, f.frontier FROM confirmed c JOIN frontiers f USING (topic, part)
           WHERE c.off > f.frontier""",
        "frontiers",
    ),
    "sink_totals": _sql(
        """SELECT topic, count(*) AS total_in, count(*) FILTER (event_type <> 'error') AS total_out,
             count(*) FILTER (event_type = 'error' AND amount > 100) AS total_err,
             count(*) FILTER (state <> 'new') AS total_get FROM outbox GROUP BY topic""",
        "outbox",
    ),
    "backlog_depth": _sql("SELECT topic, state, count(*) AS messages FROM outbox GROUP BY topic, state", "outbox"),
    "latency_stats": _sql(
        """SELECT topic, part, count(*) AS messages, CAST(sum(spent) AS BIGINT) AS total_latency,
             CAST(sum(spent) AS DOUBLE) / count(*) AS mean_latency
           FROM (SELECT topic, part, CAST(round(amount * 1000) AS BIGINT) AS spent FROM log) s GROUP BY topic, part""",
        "log",
    ),
    "throughput_checkpoints": """WITH RECURSIVE total AS (SELECT count(*) AS n, min(epoch_us(ts)) AS began FROM events),
           tens(step) AS (SELECT CAST(10 AS BIGINT)
             UNION ALL SELECT step * 10 FROM tens, total WHERE step * 100 < n),
           steps(step) AS (SELECT max(step) FROM tens
             UNION ALL SELECT step * 2 FROM steps, total WHERE step * 20 < n),
           chosen AS (SELECT max(step) AS step FROM steps),
           numbered AS (SELECT row_number() OVER (ORDER BY event_id) AS messages, epoch_us(ts) AS ts_us FROM events)
           SELECT 'events' AS topic, step, messages, ts_us - began AS elapsed_us,
             CAST(messages AS DOUBLE) * 1e6 / nullif(ts_us - began, 0) AS per_second
           FROM numbered, chosen, total WHERE messages % step = 0""",
    "pending_gate": _sql(
        """SELECT *, pending <= 5 AS ready FROM (
             SELECT topic, part, off, delta,
               CAST(sum(delta) OVER (PARTITION BY topic, part ORDER BY off ROWS UNBOUNDED PRECEDING) AS BIGINT)
                 AS pending
             FROM (SELECT *, CAST(CASE WHEN event_type IN ('click', 'view') THEN 3 ELSE -4 END AS BIGINT) AS delta
                   FROM log) d) p""",
        "log",
    ),
    "upsert_outcome": _sql(
        """SELECT user_id, event_id, coalesce(status_now, '') AS f_status,
             coalesce(tier_now, -1) AS f_tier, outcome,
             CAST(count(*) FILTER (outcome <> 'noop')
               OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version
           FROM doc_outcome""",
        "doc_outcome",
    ),
    "enqueue_id": "SELECT event_id, 'events' AS topic, row_number() OVER (ORDER BY event_id) AS enqueue_id FROM events",
    "enqueue_batches": "SELECT event_id, event_type AS topic, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS enqueue_id FROM events",
    "answered_stream": """SELECT event_id AS id, event_type <> 'error' AND event_id % 7 <= 5 AS answered,
             CASE WHEN event_type <> 'error' AND event_id % 7 <= 5 THEN event_id % 7 * 60000000 ELSE -1 END AS waited_us FROM events""",
    "suppressed_repeats": "SELECT event_id AS id, epoch_us(ts) AS at_us, event_type FROM events",
    "send_state": """WITH changes AS (
             SELECT event_id + 1 AS id, s.state, event_id % 3 + s.later AS batch, s.pos AS pos FROM events, (VALUES
               ('new', 0, 0), ('sent', 1, 1), ('acked', 1, 2), ('failed', 1, 2), ('sent', 2, 3), ('acked', 2, 4)) s(state, later, pos)
             WHERE event_id % 3 + s.later < 4 AND CASE
               WHEN s.pos = 0 THEN true WHEN s.pos = 1 THEN event_type IN ('click', 'purchase', 'error')
               WHEN s.pos = 2 AND s.state = 'acked' THEN event_type = 'purchase' WHEN s.pos = 2 THEN event_type = 'error'
               WHEN s.pos = 3 THEN event_type = 'error' AND event_id % 2 = 0 ELSE event_type = 'error' AND event_id % 4 = 0 END),
           before AS (SELECT id, arg_max(state, pos) AS state FROM changes WHERE batch < 3 GROUP BY id),
           history AS (
             SELECT id, state, batch, pos FROM changes
             UNION ALL SELECT id, 'failed', 2.5, 9 FROM before WHERE state = 'sent'),
           last AS (
             SELECT id, arg_max(state, batch * 10 + pos) AS state, CAST(count(*) FILTER (state = 'sent') AS INTEGER) AS sends FROM history GROUP BY id),
           queued AS (
             SELECT *, CASE state WHEN 'failed' THEN 0 ELSE 1 END AS rank FROM last WHERE state IN ('failed', 'new')),
           placed AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY id) AS place FROM queued)
           SELECT 'events' AS topic, id, state, sends, md5(props) AS value_md5, rank, place, (place - 1) // 100 AS batch_no
           FROM placed JOIN events ON event_id = id - 1""",
    "batch_slices": """SELECT event_id, (n - 1) // 1000 AS save_slice, (n - 1) // 100 AS send_batch
           FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) e""",
    "frontier_changes": _sql(
        """SELECT topic, part, off, frontier FROM (
             SELECT *, lag(frontier) OVER (PARTITION BY topic, part ORDER BY off) AS previous FROM frontier_steps) s
           WHERE frontier IS DISTINCT FROM previous""",
        "frontier_steps",
    ),
    "drain_order": _sql(
        "SELECT id, topic, state, rank, place, (place - 1) // 100 AS batch_no FROM drain", "drain"
    ),
    "drain_head": _sql(
        """SELECT id, topic, state, CAST(place AS INTEGER) AS place FROM (
             SELECT *, min(rank) OVER (PARTITION BY topic) AS first_rank FROM drain) d
           WHERE rank = first_rank AND place <= 100""",
        "drain",
    ),
    "retry_set": _sql(
        """SELECT id, topic, CASE WHEN event_type = 'error' AND amount > 100 THEN 'failed' WHEN state = 'new'
             THEN 'unsent' ELSE 'unconfirmed' END AS reason
           FROM outbox WHERE event_type = 'error' OR state = 'new'""",
        "outbox",
    ),
    "replay_noop": _sql(
        """SELECT doc_id, CAST(pass_no AS INTEGER) AS pass_no,
             CASE pass_no WHEN 1 THEN 'created' ELSE 'noop' END AS outcome, CAST(1 AS BIGINT) AS version
           FROM msg_flat, (VALUES (1), (2)) p(pass_no) WHERE to_count > 0""",
        "msg_flat",
    ),
    "remaining_after_failure": _sql(
        """SELECT topic, part, off, slice_no, first_failed FROM (
             SELECT *, min(CASE WHEN event_type = 'error' AND amount > 200 THEN slice_no END)
               OVER (PARTITION BY topic, part) AS first_failed
             FROM (SELECT *, off // 100 AS slice_no FROM log) s) f WHERE slice_no >= first_failed""",
        "log",
    ),
    "stage_ingress": _sql(
        f"""SELECT sender, CAST(1 AS INTEGER) AS type, {_REQUEST.format(ver='ver')}, CAST(0 AS INTEGER) AS err_code
           FROM msg_flat WHERE conv_id % 10 NOT IN (3, 6) AND to_count > 0""",
        "msg_flat",
    ),
    "stage_accept": _sql(
        "SELECT 'deliveries' AS topic, part, off, sender, doc_id, CAST(1 AS INTEGER) AS code FROM accepted", "accepted"
    ),
    "keyed_accept": _sql("SELECT 'deliveries' AS topic, part, off, sender, doc_id FROM keyed", "keyed"),
    "saved_progress": _sql(
        """SELECT 'requests' AS topic, part, min(off) AS frontier FROM request_log r
           WHERE NOT EXISTS (SELECT 1 FROM request_log n WHERE n.part = r.part AND n.off = r.off + 1) GROUP BY part
           UNION ALL SELECT 'deliveries', part, max(off) FROM keyed GROUP BY part""",
        "request_log", "keyed",
    ),
    "stage_store": _sql(_CREATED.format(sender="sender,"), "created"),
    "stage_changes": _sql(_CREATED.format(sender=""), "created"),
}
