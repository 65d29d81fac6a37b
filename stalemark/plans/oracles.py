"""The SQL each query is compared with, for DuckDB on the same tables.

Written from the rules, with plain joins and recursion, not from how the operators compute them.
"""

from __future__ import annotations

UNIT = "10800000000000"

LOGS = f"""
logs AS (
  SELECT user_id AS key, CASE WHEN event_id % 2 = 0 THEN 'ACCEPTFRND' ELSE 'PENDFRND' END AS attribute,
         epoch_us(ts) // 10800000000 * {UNIT} AS start_ns,
         epoch_us(ts) // 10800000000 * {UNIT} + (1 + (event_id // 2) % 4) * {UNIT} AS end_ns,
         event_id AS seq_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events),
reads AS (
  SELECT key, attribute, start_ns, end_ns, seq_id, k,
         CAST(CASE WHEN attribute = 'ACCEPTFRND' THEN 10 + k % 7 - 3 ELSE k % 4 END AS INTEGER) AS value
  FROM logs WHERE event_type IN ('view', 'click')),
updates AS (
  SELECT key, CASE WHEN key % 10 = 3 THEN 'POSTCOMMENT' ELSE attribute END AS attribute, start_ns, end_ns, seq_id, k,
         CASE WHEN k % 2 = 0 THEN 'I' ELSE 'D' END AS op
  FROM logs WHERE event_type IN ('purchase', 'signup', 'error'))"""
# What is left of the logs after a round through text lines, some of which are spoiled (see LINES).
PARSED = LOGS.replace("IN ('view', 'click'))", "IN ('view', 'click') AND k NOT IN (1, 2, 3))").replace(
    "'error'))", "'error') AND k NOT IN (1, 2, 3))"
)

# Every update with its place in the item's order and the running value; then one row per interval, the last value.
RUNNING = """
steps AS (
  SELECT key, attribute, start_ns, end_ns, seq_id,
         row_number() OVER w AS pos,
         CAST((CASE WHEN attribute = 'ACCEPTFRND' THEN 10 ELSE 0 END)
              + sum(CASE WHEN op = 'I' THEN 1 ELSE -1 END) OVER w AS BIGINT) AS value
  FROM updates
  WINDOW w AS (PARTITION BY key, attribute ORDER BY start_ns, end_ns, seq_id)),
stored AS (
  SELECT key, attribute, start_ns, end_ns, arg_max(value, pos) AS value
  FROM steps GROUP BY ALL),
spans AS (SELECT DISTINCT key, attribute, start_ns, end_ns FROM reads),
stop AS (
  SELECT r.key, r.attribute, r.start_ns, r.end_ns, min(u.pos) AS pos
  FROM spans r JOIN steps u ON u.key = r.key AND u.attribute = r.attribute AND u.end_ns > r.start_ns
  GROUP BY ALL),
size AS (SELECT key, attribute, max(pos) AS n FROM steps GROUP BY ALL),
closest AS (
  SELECT r.*, coalesce(s.pos, z.n + 1, 1) - 1 AS pos
  FROM spans r LEFT JOIN stop s USING (key, attribute, start_ns, end_ns) LEFT JOIN size z USING (key, attribute)),
anchor AS (
  SELECT c.key, c.attribute, c.start_ns, c.end_ns, u.start_ns AS a, u.end_ns AS b
  FROM closest c JOIN steps u USING (key, attribute, pos)),
lowest AS (SELECT key, attribute, min(start_ns) AS low FROM updates GROUP BY ALL),
highest AS (
  SELECT key, attribute, start_ns AS a, end_ns AS b FROM updates
  QUALIFY row_number() OVER (PARTITION BY key, attribute ORDER BY end_ns DESC, start_ns DESC) = 1),
start_value AS (
  SELECT *, CAST(CASE WHEN attribute = 'ACCEPTFRND' THEN 10 ELSE 0 END AS BIGINT) AS value FROM spans),
before_values AS (
  SELECT a.key, a.attribute, a.start_ns, a.end_ns, s.value
  FROM anchor a JOIN stored s ON s.key = a.key AND s.attribute = a.attribute AND s.start_ns <= a.b AND a.a <= s.end_ns
  UNION
  SELECT key, attribute, start_ns, end_ns, value FROM start_value
  WHERE (key, attribute, start_ns, end_ns) NOT IN (SELECT (key, attribute, start_ns, end_ns) FROM anchor)),
seen AS (
  SELECT * FROM before_values
  UNION
  SELECT r.key, r.attribute, r.start_ns, r.end_ns, s.value
  FROM spans r JOIN stored s
    ON s.key = r.key AND s.attribute = r.attribute AND s.start_ns <= r.end_ns AND r.start_ns <= s.end_ns
  UNION
  SELECT v.key, v.attribute, v.start_ns, v.end_ns, v.value
  FROM start_value v JOIN lowest l ON l.key = v.key AND l.attribute = v.attribute AND v.start_ns <= l.low
  UNION
  SELECT r.key, r.attribute, r.start_ns, r.end_ns, s.value
  FROM spans r JOIN highest h ON h.key = r.key AND h.attribute = r.attribute AND r.start_ns > h.b
  JOIN stored s ON s.key = r.key AND s.attribute = r.attribute AND s.start_ns <= h.b AND h.a <= s.end_ns)"""

# Distinct intervals in order, and the values reachable after each by trying every update of it on every value.
POSSIBLE = """
ivs AS (
  SELECT key, attribute, start_ns, end_ns, bool_or(op = 'I') AS inc, bool_or(op <> 'I') AS dec,
         row_number() OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns) AS pos
  FROM updates WHERE attribute <> 'POSTCOMMENT' GROUP BY key, attribute, start_ns, end_ns),
reach(key, attribute, pos, value) AS (
  SELECT DISTINCT key, attribute, CAST(0 AS BIGINT),
         CAST(CASE WHEN attribute = 'ACCEPTFRND' THEN 10 ELSE 0 END AS BIGINT) FROM ivs
  UNION
  SELECT r.key, r.attribute, i.pos, CASE WHEN d.up THEN r.value + 1 ELSE greatest(r.value - 1, 0) END
  FROM reach r JOIN ivs i ON i.key = r.key AND i.attribute = r.attribute AND i.pos = r.pos + 1
  JOIN (VALUES (true), (false)) d(up) ON (d.up AND i.inc) OR (NOT d.up AND i.dec)),
stored AS (
  SELECT i.key, i.attribute, i.start_ns, i.end_ns, r.value
  FROM ivs i JOIN reach r USING (key, attribute, pos)),
spans AS (SELECT DISTINCT key, attribute, start_ns, end_ns FROM reads),
latest AS (
  SELECT r.key, r.attribute, r.start_ns, r.end_ns, max(i.end_ns) AS last
  FROM spans r JOIN ivs i ON i.key = r.key AND i.attribute = r.attribute AND i.end_ns < r.start_ns
  GROUP BY ALL),
anchor AS (
  SELECT l.key, l.attribute, l.start_ns, l.end_ns, i.start_ns AS a, i.end_ns AS b
  FROM latest l JOIN ivs i ON i.key = l.key AND i.attribute = l.attribute AND i.end_ns = l.last),
before_values AS (
  SELECT a.key, a.attribute, a.start_ns, a.end_ns, s.value
  FROM anchor a JOIN stored s ON s.key = a.key AND s.attribute = a.attribute AND s.start_ns < a.b AND a.a < s.end_ns
  UNION
  SELECT key, attribute, start_ns, end_ns, CASE WHEN attribute = 'ACCEPTFRND' THEN 10 ELSE 0 END FROM spans
  WHERE (key, attribute, start_ns, end_ns) NOT IN (SELECT (key, attribute, start_ns, end_ns) FROM anchor)),
seen AS (
  SELECT * FROM before_values
  UNION
  SELECT r.key, r.attribute, r.start_ns, r.end_ns, s.value
  FROM spans r JOIN stored s
    ON s.key = r.key AND s.attribute = r.attribute AND s.start_ns < r.end_ns AND r.start_ns < s.end_ns)"""

VERDICTS = """
verdicts AS (
  SELECT r.*, (r.key, r.attribute, r.start_ns, r.end_ns, CAST(r.value AS BIGINT)) IN
              (SELECT (key, attribute, start_ns, end_ns, value) FROM seen) AS valid
  FROM reads r)"""

READ_ITEMS = "read_items AS (SELECT DISTINCT key, attribute FROM reads), upd_items AS (SELECT DISTINCT key, attribute FROM updates)"

REPORT = """
report AS (
  SELECT count(*) AS total_reads,
         (SELECT count(*) FROM updates) AS total_updates,
         (SELECT count(*) FROM updates SEMI JOIN read_items USING (key, attribute)) AS processed_updates,
         count(*) FILTER (valid) AS correct_reads,
         count(*) FILTER (NOT valid) AS stale_reads,
         count(*) FILTER (NOT valid AND (key, attribute) IN (SELECT (key, attribute) FROM upd_items))
           AS stale_reads_with_updates
  FROM verdicts)"""

FRACTIONS = """SELECT *, CAST(correct_reads AS DOUBLE) / total_reads AS correct_fraction,
  CAST(stale_reads AS DOUBLE) / total_reads AS stale_fraction,
  CAST(correct_reads AS DOUBLE) / total_reads * 100.0 AS correct_percent FROM report"""

LINES = f"""
parts AS (
  SELECT CASE WHEN event_type IN ('view', 'click') THEN 'READ' ELSE 'UPDATE' END AS log_type,
         CASE WHEN event_type NOT IN ('view', 'click') AND key % 10 = 3 THEN 'POSTCOMMENT' ELSE attribute END AS attribute, seq_id,
         CAST(seq_id % 16 AS INTEGER) AS thread_id, key, start_ns, end_ns, k,
         CAST(CASE WHEN event_type NOT IN ('view', 'click') THEN 1
                   WHEN attribute = 'ACCEPTFRND' THEN 10 + k % 7 - 3 ELSE k % 4 END AS INTEGER) AS value,
         CASE WHEN event_type IN ('view', 'click') THEN 'N' WHEN k % 2 = 0 THEN 'I' ELSE 'D' END AS op,
         CASE WHEN event_type IN ('view', 'click') THEN 'GetProfile' ELSE 'AcceptFriend' END AS action_type
  FROM logs
  WHERE event_type IN ('view', 'click', 'purchase', 'signup', 'error')),
lines AS (
  SELECT *, CASE WHEN k = 4 THEN ' ' ELSE '' END
    || log_type || ',' || attribute || ',' || seq_id || ',' || thread_id || ','
    || CASE WHEN k = 2 THEN 'x' ELSE '' END || key || ','
    || CASE WHEN k = 3 THEN end_ns ELSE start_ns END || ',' || CASE WHEN k = 3 THEN start_ns ELSE end_ns END || ','
    || value || ',' || CASE WHEN log_type = 'UPDATE' THEN op || ',' ELSE '' END || action_type
    || CASE WHEN k = 1 THEN ',a,b' WHEN k = 4 THEN ' ' || chr(9) ELSE '' END AS line
  FROM parts)"""

USERS = "users AS (SELECT c_custkey AS userid, c_name AS username, c_mktsegment AS address FROM customer)"
RESOURCES = """resources AS (
  SELECT o_orderkey AS rid, o_custkey AS creatorid, o_custkey - o_custkey % 3 AS walluserid, o_orderpriority AS type,
         o_orderstatus AS body FROM orders)"""
COMMENTS = """comments AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_shipdate AS DATE) AS mid,
         o_custkey AS creatorid, l_orderkey AS rid, l_suppkey AS modifierid, CAST(l_shipdate AS DATE) AS timestamp,
         l_returnflag AS type, l_linestatus AS content
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
REQUESTS = """requests AS (
  SELECT c_custkey - c_custkey % 2 AS requester, c_custkey AS owner, CAST(c_custkey % 4 AS INTEGER) AS k FROM customer)"""
ALL_OPS = """all_ops AS (
  SELECT event_id AS op_seq,
         CASE event_type WHEN 'signup' THEN 'invite' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject'
                         WHEN 'click' THEN 'thaw' ELSE event_type END AS op,
         user_id AS inviter,
         user_id - user_id % 10 + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 AS invitee
  FROM events)"""
OPS = f"""{ALL_OPS},
ops AS (SELECT * FROM all_ops WHERE op <> 'view' AND inviter <> invitee),
facts AS (
  SELECT op_seq, op, invitee AS owner, inviter AS other, 'pending' AS kind, op = 'invite' AS is_on FROM ops
  WHERE op IN ('invite', 'reject', 'accept')
  UNION ALL SELECT op_seq, op, inviter, invitee, 'pending', false FROM ops WHERE op = 'accept'
  UNION ALL SELECT op_seq, op, inviter, invitee, 'confirmed', op = 'accept' FROM ops WHERE op IN ('accept', 'thaw')
  UNION ALL SELECT op_seq, op, invitee, inviter, 'confirmed', op = 'accept' FROM ops WHERE op IN ('accept', 'thaw'))"""
EDGES = f"""{OPS},
edges AS (
  SELECT owner, other, kind FROM facts GROUP BY ALL HAVING arg_max(is_on, op_seq))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _joined(column: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT {column})), ',')"


SPAN = "key, attribute, start_ns, end_ns"


def _values(source: str, name: str) -> str:
    return f"SELECT {SPAN}, {_joined('value')} AS {name} FROM {source} GROUP BY ALL"


# The runs of every second value of each read's set: (parity, low, high).
RUNS_OF = f"""
spread AS (
  SELECT DISTINCT {SPAN}, value, value & 1 AS odd FROM seen
), islands AS (
  SELECT {SPAN}, odd, value, value - 2 * row_number() OVER (PARTITION BY {SPAN}, odd ORDER BY value) AS island FROM spread
), runs AS (
  SELECT {SPAN}, odd, min(value) AS low, max(value) AS high, count(*) AS n FROM islands GROUP BY {SPAN}, odd, island
)"""
RUNS = f"""
SELECT {SPAN}, string_agg(low || ':' || high, ',' ORDER BY odd, low) AS runs, CAST(sum(n) AS BIGINT) AS n_values FROM runs GROUP BY ALL"""


def _overlap(test: str) -> str:
    return _with(LOGS) + (
        "SELECT r.seq_id AS read_id, u.seq_id AS update_seq_id, u.start_ns AS update_start_ns, u.end_ns AS update_end_ns, "
        f"u.op AS update_op FROM reads r JOIN updates u ON u.key = r.key AND u.attribute = r.attribute AND {test}"
    )


CLOSED = "r.start_ns <= u.end_ns AND u.start_ns <= r.end_ns"
HALF_OPEN = "r.start_ns < u.end_ns AND u.start_ns < r.end_ns"


def _around(states: str, test: str) -> str:
    return _with(LOGS, states) + (
        f"SELECT r.key, r.attribute, r.start_ns, r.end_ns, {_joined('u.value')} AS around "
        "FROM (SELECT DISTINCT key, attribute, start_ns, end_ns FROM updates) r "
        f"JOIN stored u ON u.key = r.key AND u.attribute = r.attribute AND {test} GROUP BY ALL"
    )


def _applied(op: str) -> str:
    """Facts of the other operations first, then those of ``op``, each in their own order."""
    return _with(OPS) + (
        "SELECT owner, other, kind FROM facts GROUP BY ALL "
        f"HAVING arg_max(is_on, CASE WHEN op = '{op}' THEN 1000000000000 ELSE 0 END + op_seq)"
    )


def _friends(kind: str, requester: str) -> str:
    return _with(USERS, REQUESTS, EDGES) + (
        f"SELECT {requester} q.owner, u.userid, u.username, u.address FROM requests q "
        f"JOIN edges e ON e.owner = q.owner AND e.kind = '{kind}' JOIN users u ON u.userid = e.other"
    )


def _ids(kind: str) -> str:
    return _with(REQUESTS, EDGES) + (
        f"SELECT q.owner AS member, e.other AS friend FROM requests q JOIN edges e ON e.owner = q.owner AND e.kind = '{kind}'"
    )


PER_USER = """per_user AS (
  SELECT userid,
         (SELECT count(*) FROM edges e WHERE e.owner = u.userid AND e.kind = 'confirmed') AS friends,
         (SELECT count(*) FROM edges e WHERE e.owner = u.userid AND e.kind = 'pending') AS pending,
         (SELECT count(*) FROM resources r WHERE r.creatorid = u.userid) AS made
  FROM users u)"""

ORACLES: dict[str, str] = {
    "scan_logs": _with(LOGS, LINES) + "SELECT line AS value FROM lines WHERE log_type = 'UPDATE'",
    "union_logs": _with(LOGS, LINES) + "SELECT line AS value FROM lines",
    "parse_logs": _with(LOGS, LINES)
    + "SELECT log_type, attribute, seq_id, thread_id, key, start_ns, end_ns, value, op, action_type FROM lines "
    "WHERE k NOT IN (1, 2, 3)",
    "parse_rejects": _with(LOGS, LINES)
    + "SELECT line AS value, CASE k WHEN 1 THEN 'field_count' WHEN 2 THEN 'bad_number' ELSE 'start_after_end' END AS reason "
    "FROM lines WHERE k IN (1, 2, 3)",
    "classify_key": _with(LOGS)
    + "SELECT attribute, CASE WHEN attribute = 'POSTCOMMENT' THEN 'resourceID' ELSE 'userID' END AS key_type, "
    "attribute <> 'POSTCOMMENT' AS is_user, attribute = 'POSTCOMMENT' AS is_resource, count(*) AS n "
    "FROM (SELECT attribute FROM reads UNION ALL SELECT 'POSTCOMMENT' FROM orders) GROUP BY ALL",
    "load_users": "SELECT CAST(c_custkey AS INTEGER) AS userid, c_name AS username, c_mktsegment AS address, "
    "CAST(DATE '2000-01-01' + CAST(c_custkey % 5000 AS INTEGER) AS DATE) AS jdate, CAST(NULL AS DATE) AS dob, "
    "'' AS conf, '' AS pend, 14 AS n_columns FROM customer",
    "load_resources": "SELECT CAST(o_orderkey AS INTEGER) AS rid, CAST(o_custkey AS INTEGER) AS creatorid, "
    "CAST(o_custkey - o_custkey % 3 AS INTEGER) AS walluserid, o_orderpriority AS type, o_orderstatus AS body, "
    "CAST(NULL AS VARCHAR) AS doc FROM orders",
    "load_manipulations": "SELECT CAST(l_partkey AS INTEGER) AS mid, CAST(NULL AS INTEGER) AS creatorid, "
    "CAST(l_orderkey AS INTEGER) AS rid, CAST(l_suppkey AS INTEGER) AS modifierid, "
    "CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT) AS timestamp, l_returnflag AS type, CAST(NULL AS VARCHAR) AS content "
    "FROM lineitem",
    "report_sink": _with(LOGS, RUNNING, VERDICTS, READ_ITEMS, REPORT)
    + "SELECT l.line, l.figure, CAST(l.amount AS VARCHAR) AS amount FROM report, LATERAL (VALUES "
    "(1, 'total_reads', total_reads), (2, 'total_updates', total_updates), (3, 'processed_updates', processed_updates), "
    "(4, 'correct_reads', correct_reads), (5, 'stale_reads', stale_reads), "
    "(6, 'stale_reads_with_updates', stale_reads_with_updates)) l(line, figure, amount) UNION ALL "
    "SELECT l.line, l.figure, printf('%.6f', l.amount) FROM report, LATERAL (VALUES "
    "(7, 'correct_fraction', CAST(correct_reads AS DOUBLE) / total_reads), "
    "(8, 'stale_fraction', CAST(stale_reads AS DOUBLE) / total_reads), "
    "(9, 'correct_percent', CAST(correct_reads AS DOUBLE) / total_reads * 100.0)) l(line, figure, amount)",
    "scan_read_logs": _with(LOGS, LINES) + "SELECT line AS value, true AS is_part FROM lines WHERE log_type = 'READ'",
    "report_directory_running": _with(PARSED, RUNNING, VERDICTS, READ_ITEMS, REPORT) + FRACTIONS,
    "report_directory_rejects": _with(PARSED, RUNNING, VERDICTS, READ_ITEMS, REPORT)
    + FRACTIONS.replace("FROM report", ", (SELECT count(*) FROM events WHERE event_type IN ('view', 'click') AND CAST(json_extract(props, '$.k') AS INT) IN (1, 2, 3)) AS rejected_reads, "
    "(SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click') AND CAST(json_extract(props, '$.k') AS INT) IN (1, 2, 3)) AS rejected_updates FROM report"),
    "report_directory_possible": _with(PARSED, POSSIBLE, VERDICTS, READ_ITEMS, REPORT) + FRACTIONS,
    "refused_reads": _with(LOGS)
    + "SELECT seq_id, CASE WHEN seq_id % 20 <> 7 THEN value END AS value, CASE seq_id % 20 WHEN 3 THEN 'unknown_attribute' "
    "WHEN 5 THEN 'start_after_end' WHEN 7 THEN 'no_value' WHEN 9 THEN 'missing_field' ELSE '' END AS reason FROM reads",
    "filter_validatable": _with(LOGS) + "SELECT seq_id, attribute FROM reads",
    "filter_attribute": _with(LOGS) + "SELECT seq_id, attribute, op FROM updates WHERE attribute = 'PENDFRND'",
    "project_intervals": _with(LOGS) + f"SELECT {SPAN}, op FROM updates",
    "split_intervals": _with(LOGS)
    + f"SELECT {SPAN}, seq_id, '' AS reason FROM updates UNION ALL "
    "SELECT key, attribute, end_ns, start_ns, seq_id, 'start_after_end' FROM reads",
    "select_fields": _with(USERS) + "SELECT * FROM users",
    "point_lookup": _with(USERS, REQUESTS)
    + "SELECT q.requester AS userid, q.owner, u.username, u.address FROM requests q JOIN users u ON u.userid = q.requester",
    "guard_ids": _with(REQUESTS)
    + "SELECT requester - 100 AS requester, owner, CASE WHEN requester - 100 < 0 OR owner < 0 THEN 'ERROR' ELSE 'SUCCESS' END "
    "AS status FROM requests",
    "contains_point": _with(LOGS)
    + "SELECT r.seq_id AS read_id, u.seq_id AS update_id FROM reads r JOIN updates u "
    "ON u.key = r.key AND u.attribute = r.attribute AND r.start_ns BETWEEN u.start_ns AND u.end_ns",
    "intersects": _with(LOGS)
    + ", lows AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns) = 1), "
    "highs AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY key, attribute ORDER BY end_ns DESC, start_ns DESC) = 1) "
    "SELECT r.seq_id, r.start_ns <= u.end_ns AND u.start_ns <= r.end_ns AS meets_lowest, "
    "r.start_ns <= h.end_ns AND h.start_ns <= r.end_ns AS meets_highest, "
    "r.start_ns < u.end_ns AND u.start_ns < r.end_ns AS overlaps_lowest "
    "FROM updates r JOIN lows u USING (key, attribute) JOIN highs h USING (key, attribute)",
    "valid_only": _with(LOGS, POSSIBLE, VERDICTS) + "SELECT seq_id, value FROM verdicts WHERE valid",
    "stale_only": _with(LOGS, RUNNING, VERDICTS) + "SELECT seq_id, value FROM verdicts WHERE NOT valid",
    "attach_updates": _with(LOGS)
    + "SELECT r.seq_id, r.key, r.attribute, count(u.seq_id) AS n_updates FROM reads r "
    "LEFT JOIN updates u ON u.key = r.key AND u.attribute = r.attribute GROUP BY ALL",
    "overlap_join_half_open": _overlap(HALF_OPEN),
    "overlap_join_closed": _overlap(CLOSED),
    "overlap_values_closed": _with(LOGS, RUNNING)
    + f"SELECT r.key, r.attribute, r.start_ns, r.end_ns, {_joined('u.value')} AS found FROM spans r "
    f"JOIN stored u ON u.key = r.key AND u.attribute = r.attribute AND {CLOSED} GROUP BY ALL",
    "any_overlap": _with(LOGS)
    + "SELECT seq_id, key, attribute, start_ns, end_ns FROM reads r WHERE EXISTS "
    f"(SELECT 1 FROM updates u WHERE u.key = r.key AND u.attribute = r.attribute AND {CLOSED})",
    "search_overlap": _with(LOGS)
    + "SELECT r.key, r.attribute, r.start_ns, r.end_ns, u.start_ns AS found_start, u.end_ns AS found_end "
    f"FROM (SELECT DISTINCT {SPAN} FROM reads) r LEFT JOIN updates u ON u.key = r.key AND u.attribute = r.attribute AND {CLOSED} "
    "QUALIFY row_number() OVER (PARTITION BY r.key, r.attribute, r.start_ns, r.end_ns "
    "ORDER BY u.end_ns DESC, u.start_ns DESC) = 1",
    "interval_lookup": _with(LOGS, RUNNING)
    + f"SELECT {SPAN}, r.seq_id, s.value FROM reads r LEFT JOIN stored s USING ({SPAN})",
    "interval_delete": _with(LOGS, RUNNING)
    + f"SELECT {SPAN}, value FROM stored ANTI JOIN reads USING ({SPAN})",
    "neighborhood_running": _around(RUNNING, CLOSED),
    "neighborhood_possible": _around(POSSIBLE, HALF_OPEN),
    "state_before_possible": _with(LOGS, POSSIBLE) + _values("before_values", "state"),
    "state_before_running": _with(LOGS, RUNNING) + _values("before_values", "state"),
    "group_by_item": _with(LOGS)
    + "SELECT key, attribute, CAST((place - 1) // 100000 AS INTEGER) AS part, "
    "string_agg(start_ns || ':' || end_ns || ':' || seq_id || ':' || op, ',' ORDER BY start_ns, end_ns, seq_id) AS entries "
    "FROM (SELECT *, row_number() OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns, seq_id) AS place FROM updates) "
    "GROUP BY key, attribute, part",
    "merge_same_interval": _with(LOGS)
    + f"SELECT {SPAN}, bool_or(op = 'I') AS inc, bool_or(op <> 'I') AS dec, count(*) AS n_updates FROM updates GROUP BY ALL",
    "dedup_interval_last": _with(LOGS)
    + f"SELECT {SPAN}, max(seq_id) AS seq_id, arg_max(op, seq_id) AS op FROM updates GROUP BY ALL",
    "lowest_interval": _with(LOGS)
    + "SELECT key, attribute, start_ns AS lowest_start_ns, end_ns AS lowest_end_ns FROM updates "
    "QUALIFY row_number() OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns) = 1",
    "highest_interval": _with(LOGS)
    + "SELECT key, attribute, start_ns AS highest_start_ns, end_ns AS highest_end_ns FROM updates "
    "QUALIFY row_number() OVER (PARTITION BY key, attribute ORDER BY end_ns DESC, start_ns DESC) = 1",
    "interval_count": _with(LOGS)
    + "SELECT key, attribute, count(DISTINCT (start_ns, end_ns)) AS n_intervals FROM updates GROUP BY ALL",
    "possible_values_possible": _with(LOGS, POSSIBLE) + _values("seen", "possible_values"),
    "possible_values_running": _with(LOGS, RUNNING) + _values("seen", "possible_values"),
    "possible_runs_possible": _with(LOGS, POSSIBLE, RUNS_OF) + RUNS,
    "possible_runs_running": _with(LOGS, RUNNING, RUNS_OF) + RUNS,
    "runs_hold_reads": _with(LOGS, POSSIBLE, VERDICTS)
    + ", ends AS (SELECT key, attribute, count(*) FILTER (valid) AS n_valid, min((start_ns, end_ns, seq_id)) AS a, "
    "max((start_ns, end_ns, seq_id)) AS b FROM verdicts GROUP BY key, attribute), "
    "members AS (SELECT DISTINCT e.key, e.attribute, s.value FROM ends e JOIN reads r ON r.key = e.key AND r.attribute = e.attribute "
    "AND ((r.start_ns, r.end_ns, r.seq_id) = e.a OR (r.start_ns, r.end_ns, r.seq_id) = e.b) "
    "JOIN seen s ON s.key = r.key AND s.attribute = r.attribute AND s.start_ns = r.start_ns AND s.end_ns = r.end_ns) "
    "SELECT key, attribute, n_valid, string_agg(value, ',' ORDER BY value) AS first_or_last "
    "FROM ends JOIN members USING (key, attribute) GROUP BY ALL",
    "validate_reads_possible": _with(LOGS, POSSIBLE, VERDICTS) + f"SELECT seq_id, {SPAN}, value, valid FROM verdicts",
    "validate_reads_running": _with(LOGS, RUNNING, VERDICTS) + f"SELECT seq_id, {SPAN}, value, valid FROM verdicts",
    "staleness_report_possible": _with(LOGS, POSSIBLE, VERDICTS, READ_ITEMS, REPORT) + FRACTIONS,
    "staleness_report_running": _with(LOGS, RUNNING, VERDICTS, READ_ITEMS, REPORT) + FRACTIONS,
    "update_counts": _with(LOGS, READ_ITEMS)
    + "SELECT (SELECT count(*) FROM updates) AS total_updates, "
    "(SELECT count(*) FROM updates SEMI JOIN read_items USING (key, attribute)) AS processed_updates",
    "resource_count_by_wall": _with(RESOURCES) + "SELECT walluserid, count(rid) AS resourcecount FROM resources GROUP BY ALL",
    "resource_count_by_creator": _with(RESOURCES)
    + "SELECT creatorid, count(rid) AS resourcecount FROM resources GROUP BY ALL",
    "running_value": _with(LOGS, RUNNING) + f"SELECT {SPAN}, value FROM stored",
    "possible_set_states": _with(LOGS, POSSIBLE) + _values("stored", "possible"),
    "prefix_max_end": _with(LOGS)
    + f"SELECT {SPAN}, max(end_ns) OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) "
    f"AS max_end FROM (SELECT DISTINCT {SPAN} FROM updates)",
    "sort_intervals": _with(LOGS)
    + f"SELECT {SPAN}, row_number() OVER (PARTITION BY key, attribute ORDER BY start_ns, end_ns) AS position "
    f"FROM (SELECT DISTINCT {SPAN} FROM updates)",
    "latest_end_first": _with(LOGS)
    + "SELECT r.key, r.attribute, r.start_ns, r.end_ns, min(u.start_ns) AS anchor_start, max(u.end_ns) AS anchor_end "
    f"FROM (SELECT DISTINCT {SPAN} FROM reads) r LEFT JOIN updates u ON u.key = r.key AND u.attribute = r.attribute "
    "AND u.end_ns = (SELECT max(x.end_ns) FROM updates x WHERE x.key = r.key AND x.attribute = r.attribute "
    "AND x.end_ns < r.start_ns) GROUP BY ALL",
    "view_profile": _with(USERS, RESOURCES, REQUESTS, EDGES)
    + "SELECT q.requester, u.address, u.userid, u.username, "
    "(SELECT count(*) FROM edges e WHERE e.owner = q.owner AND e.kind = 'confirmed') AS friendcount, "
    "CASE WHEN q.requester = q.owner THEN "
    "(SELECT count(*) FROM edges e WHERE e.owner = q.owner AND e.kind = 'pending') END AS pendingcount, "
    "(SELECT count(*) FROM resources r WHERE r.walluserid = q.owner) AS resourcecount "
    "FROM requests q JOIN users u ON u.userid = q.owner",
    "list_friends": _friends("confirmed", "q.requester,"),
    "view_friend_requests": _friends("pending", ""),
    "pending_ids": _ids("pending"),
    "confirmed_ids": _ids("confirmed"),
    "top_k_resources": _with(RESOURCES, REQUESTS)
    + "SELECT q.requester, r.* FROM requests q JOIN (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY walluserid ORDER BY rid DESC) AS INTEGER) AS place FROM resources) r "
    "ON r.walluserid = q.owner AND r.place <= 3",
    "top_k_resources_per_request": _with(RESOURCES, REQUESTS)
    + "SELECT r.walluserid, q.k, r.rid, r.place FROM requests q JOIN (SELECT *, CAST(row_number() OVER "
    "(PARTITION BY walluserid ORDER BY rid DESC) AS INTEGER) AS place FROM resources) r "
    "ON r.walluserid = q.owner AND r.place <= q.k",
    "resources_of_user": _with(RESOURCES, REQUESTS)
    + "SELECT q.owner, r.* FROM requests q JOIN resources r ON r.creatorid = q.owner",
    "resources_on_wall": _with(RESOURCES, REQUESTS)
    + "SELECT q.owner, r.* FROM requests q JOIN resources r ON r.walluserid = q.owner",
    "comments_on_resource": _with(RESOURCES, COMMENTS)
    + "SELECT c.* FROM comments c JOIN resources r USING (rid) WHERE r.body = 'P'",
    "post_comments": _with(RESOURCES, COMMENTS)
    + "SELECT * FROM comments UNION ALL SELECT 'new-' || s_suppkey, r.creatorid, r.rid, s_suppkey, DATE '2024-01-01', 'N', s_name "
    "FROM supplier JOIN resources r ON r.rid = s_suppkey",
    "delete_comments": _with(COMMENTS)
    + "SELECT * FROM comments c WHERE NOT (type = 'R' AND EXISTS (SELECT 1 FROM comments d WHERE d.mid = c.mid "
    "AND d.rid = c.rid AND d.type = 'R' AND d.modifierid % 2 = 0))",
    "initial_stats": _with(USERS, RESOURCES, EDGES, PER_USER)
    + "SELECT count(*) AS usercount, avg(friends) AS avgfriendsperuser, avg(pending) AS avgpendingperuser, "
    "avg(made) AS resourcesperuser FROM per_user",
    "initial_stats_sample_user": _with(USERS, RESOURCES, EDGES, PER_USER)
    + "SELECT count(*) AS usercount, CAST(arg_min(friends, userid) AS DOUBLE) AS avgfriendsperuser, "
    "CAST(arg_min(pending, userid) AS DOUBLE) AS avgpendingperuser, CAST(arg_min(made, userid) AS DOUBLE) AS resourcesperuser "
    "FROM per_user",
    "first_user": _with(USERS) + "SELECT * FROM users ORDER BY userid LIMIT 1",
    "apply_friendship_ops": _with(EDGES) + "SELECT * FROM edges",
    "op_invite": _applied("invite"),
    "op_accept": _applied("accept"),
    "op_reject": _applied("reject"),
    "op_thaw": _applied("thaw"),
    "create_friendship": _with(OPS)
    + "SELECT owner, other, kind FROM facts WHERE op = 'accept' GROUP BY ALL HAVING arg_max(is_on, op_seq)",
    "count_friendship_ops": _with(
        OPS,
        "ranked AS (SELECT owner, other, kind, is_on, row_number() OVER (PARTITION BY owner, other, kind ORDER BY op_seq) AS pos "
        "FROM facts)",
        "walk(owner, other, kind, pos, n) AS (SELECT DISTINCT owner, other, kind, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ranked "
        "UNION ALL SELECT r.owner, r.other, r.kind, r.pos, CASE WHEN r.is_on THEN w.n + 1 ELSE greatest(w.n - 1, 0) END "
        "FROM walk w JOIN ranked r ON r.owner = w.owner AND r.other = w.other AND r.kind = w.kind AND r.pos = w.pos + 1)",
    )
    + "SELECT owner, other, kind, arg_max(n, pos) AS n FROM walk GROUP BY ALL HAVING arg_max(n, pos) > 0",
    "friend_lists": _with(EDGES)
    + "SELECT owner, CAST((place - 1) // 100000 AS INTEGER) AS part, "
    "coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (kind = 'confirmed'), '') AS conf, "
    "coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) FILTER (kind = 'pending'), '') AS pend "
    "FROM (SELECT *, row_number() OVER (PARTITION BY owner, kind ORDER BY other) AS place FROM edges) GROUP BY owner, part",
    "list_friends_with_thumbnail": _with(USERS, REQUESTS, EDGES)
    + "SELECT q.requester, q.owner, u.userid, u.address, reverse(u.username) AS tpic FROM requests q "
    "JOIN edges e ON e.owner = q.owner AND e.kind = 'confirmed' JOIN users u ON u.userid = e.other",
    "view_profile_with_picture": _with(USERS, REQUESTS, EDGES)
    + "SELECT q.requester, u.userid, reverse(u.username) AS pic, "
    "(SELECT count(*) FROM edges e WHERE e.owner = q.owner AND e.kind = 'confirmed') AS friendcount "
    "FROM requests q JOIN users u ON u.userid = q.owner",
    "refused_requests": _with(USERS, REQUESTS, EDGES)
    + "SELECT q.requester - 40 AS requester, q.owner, count(u.userid) AS n, 'SUCCESS' AS status FROM requests q "
    "JOIN edges e ON e.owner = q.owner AND e.kind = 'confirmed' JOIN users u ON u.userid = e.other "
    "WHERE q.requester >= 40 GROUP BY ALL "
    "UNION ALL SELECT requester - 40, owner, NULL, 'ERROR' FROM requests WHERE requester < 40",
    "refused_friendship_ops": _with(ALL_OPS)
    + "SELECT *, CASE WHEN op = 'view' THEN 'UNKNOWN' ELSE 'SELF' END AS status FROM all_ops WHERE op = 'view' OR inviter = invitee",
    "load_users_with_image": "SELECT CAST(c_custkey AS INTEGER) AS userid, c_name AS pic FROM customer",
}
