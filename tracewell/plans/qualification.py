"""Qualification, alignment and denominators: rows are never dropped, they get a status and typed reasons."""

from __future__ import annotations

from tracewell.plans.sql import MACROS, both

MACROS["canonical"] = (
    "to_json(struct(o_custkey, o_orderkey, o_orderpriority, o_orderstatus))%s",
    "CAST(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}) AS varchar)%s",
)
MACROS["newline"] = ("char(10)%s", "chr(10)%s")
MACROS["total"] = ("aggregate(%s, CAST(0 AS double), (s, v) -> s + v)", "list_sum(%s)")

E = "e AS (SELECT user_id, event_id, event_type, value, @us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
V = "v AS (SELECT vec_id, @idiv(vec_id / 28.0) AS block, label, @vec(embedding) AS x FROM embeddings)"

TEXTS = {
    # An order is a recording, its lines are channels: census, uniqueness, units and a declared total against the observed one.
    "q_source_qualification": """
WITH c AS (SELECT l_orderkey, count(*) AS channels, count(DISTINCT l_linenumber) AS names, count(DISTINCT l_returnflag) AS units,
             sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS observed FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, channels, round(observed - o_totalprice, 2) AS discrepancy,
        CASE WHEN channels IS NULL THEN 'NO_CHANNELS' WHEN channels < 2 THEN 'CHANNEL_COUNT' END AS a, CASE WHEN names < channels THEN 'DUPLICATE_CHANNELS' END AS b,
        CASE WHEN units > 1 THEN 'MIXED_UNITS' END AS c, CASE WHEN abs(observed - o_totalprice) > 1.01 THEN 'DURATION_DISCREPANCY' END AS d
      FROM orders LEFT JOIN c ON l_orderkey = o_orderkey)
SELECT o_orderkey, channels, discrepancy, CASE WHEN coalesce(a, b, c, d) IS NULL THEN 'QUALIFIED' ELSE 'QUARANTINED' END AS status, concat_ws('|', a, b, c, d) AS reasons FROM r""",
    # A block of 28 vectors passes if all are there and finite, and neither too flat nor too large.
    "q_block_gate": f"""
WITH {V}, s AS (SELECT block, count(*) AS centers, count(x) AS valid, sum(@total(x)) AS total, sum(@dot(x, x)) AS squares, sum(@items(x)) AS n, max(@largest(x)) AS peak FROM v GROUP BY block),
r AS (SELECT *, squares / n - power(total / n, 2) AS variance FROM s),
g AS (SELECT *, CASE WHEN centers < 28 THEN 'SHORT_SUPPORT' END AS a, CASE WHEN valid < centers THEN 'INVALID_MASK' END AS b, CASE WHEN NOT @finite(variance) THEN 'NONFINITE' END AS c,
        CASE WHEN variance < 0.0025 THEN 'FLAT' END AS d, CASE WHEN peak > 0.45 THEN 'HIGH_AMPLITUDE' END AS e FROM r)
SELECT block, centers, round(peak, 6) AS peak, CASE WHEN coalesce(a, b, c, d, e) IS NULL THEN 'PASS' ELSE 'FAIL' END AS quality, concat_ws('|', a, b, c, d, e) AS reasons FROM g""",
    # Probes of 32 samples at the start, the middle and the end: native counts, scaled, against the decoded values.
    "q_calibration_check": f"""
WITH {E}, p AS (SELECT user_id, CASE WHEN k <= 32 THEN 0 WHEN k > n - 32 THEN 2 ELSE 1 END AS probe, k, value, @long(round(value * 100)) AS native FROM e
  WHERE k <= 32 OR k > n - 32 OR k BETWEEN @idiv(n / 2.0) - 15 AND @idiv(n / 2.0) + 16)
SELECT user_id, probe, count(*) AS samples, @count_if(value IS NULL AND native IS NOT NULL OR value IS NOT NULL AND native IS NULL) AS mask_errors,
       @count_if(abs(native / 100.0 - value) > 1e-9 + 1e-12 * abs(value)) AS errors FROM p GROUP BY user_id, probe""",
    # Row i of an array archive belongs to entries 5 i + j of a ledger: positions become columns before anything is joined.
    "q_positional_join": """
WITH l AS (SELECT event_id, @idiv(event_id / 5.0) AS candidate, event_id % 5 AS variant, event_type FROM events)
SELECT v.vec_id AS candidate, l.variant, l.event_id, l.event_type, v.label FROM embeddings v JOIN l ON l.candidate = v.vec_id""",
    # Times are aligned as whole numbers of half hours, never as floating-point times.
    "q_exact_alignment": """
WITH a AS (SELECT user_id, event_id, @idiv(@us(ts) / 1800000000.0) AS slot FROM events WHERE event_type = 'click'),
b AS (SELECT DISTINCT user_id, @idiv(@us(ts) / 1800000000.0) AS slot FROM events WHERE event_type = 'view')
SELECT a.user_id, a.event_id, a.slot, CASE WHEN b.slot IS NULL THEN 'NOT_ALIGNED' ELSE 'ALIGNED' END AS status FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.slot = a.slot""",
    # People, their sessions (days) and a mean in which every person weighs alike, whatever the number of sessions.
    "q_person_means": """
WITH s AS (SELECT event_type, user_id, @idiv(@us(ts) / 86400000000.0) AS day, avg(value) AS m, count(*) AS n FROM events GROUP BY event_type, user_id, @idiv(@us(ts) / 86400000000.0)),
p AS (SELECT event_type, user_id, count(*) AS sessions, sum(n) AS n, avg(m) AS m FROM s GROUP BY event_type, user_id)
SELECT event_type, count(*) AS people, sum(sessions) AS sessions, sum(n) AS rows_n, round(avg(m), 9) AS person_mean, round(min(m), 9) AS lowest, round(max(m), 9) AS highest FROM p GROUP BY event_type""",
    # False detections of each kind and band, for the first ten trials and all: rates over the time that was scored.
    "q_false_detection_rates": """
WITH t AS (SELECT event_type, user_id % 3 AS band, user_id, @count_if(value > 97) AS accepted, @float(max(@us(ts)) - min(@us(ts))) / 60000000 AS minutes FROM events GROUP BY event_type, user_id % 3, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, band ORDER BY user_id) AS trial FROM t),
b AS (SELECT *, 'all' AS subset FROM r UNION ALL SELECT *, 'first10' AS subset FROM r WHERE trial <= 10)
SELECT event_type, band, subset, count(*) AS requested, @count_if(minutes > 0) AS scored, @count_if(minutes = 0) AS abstained, sum(CASE WHEN minutes > 0 THEN accepted ELSE 0 END) AS false_rows,
       @count_if(minutes > 0 AND accepted > 0) AS false_trials, round(sum(CASE WHEN minutes > 0 THEN accepted ELSE 0 END) / nullif(sum(minutes), 0), 12) AS per_minute FROM b GROUP BY event_type, band, subset""",
    # Canonical JSON with sorted keys, compact and indented, which have different digests; rows come in its order.
    "q_canonical_rows": """
SELECT o_orderkey, @canonical() AS canonical, @sha(@canonical()) AS digest,
       @sha(concat('{', @newline(), '  "o_custkey": ', @text(o_custkey), ',', @newline(), '  "o_orderkey": ', @text(o_orderkey), ',', @newline(), '  "o_orderpriority": "', o_orderpriority, '",', @newline(),
                   '  "o_orderstatus": "', o_orderstatus, '"', @newline(), '}', @newline())) AS indented_digest
FROM orders ORDER BY @canonical(), o_orderkey""",
    # First places of values keep their order.
    "q_ordered_distinct": f"""
WITH {E}, f AS (SELECT user_id, event_type, min(k) AS k FROM e GROUP BY user_id, event_type)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place FROM f""",
}
QUERIES, ORACLES = both(TEXTS)
