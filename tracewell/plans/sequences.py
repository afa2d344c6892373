"""Window, interval and event-sequence queries: `events` as recordings (user_id) over time."""

from __future__ import annotations

from tracewell.plans.sql import both

#: Recordings as sequences with a row number and seconds since the first event of the table's first day.
E = "e AS (SELECT user_id, event_id, event_type, value, @us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
#: Bad spans: from an error event, as many minutes as its value says.
GAPS = "g AS (SELECT user_id, @us(ts) AS a, @us(ts) + @long(floor(value * 60)) * 1000000 AS b FROM events WHERE event_type = 'error')"

TEXTS = {
    "q_selected_lower_median": f"""
WITH {E}, s AS (SELECT user_id, event_id, @idiv(us / 86400000000.0) AS stratum, us FROM e WHERE value < 60),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, stratum ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY user_id, stratum) AS n FROM s)
SELECT user_id, stratum, event_id FROM r WHERE rn = @idiv((n - 1) / 2.0) + 1""",
    "q_gates": """
WITH cell AS (SELECT user_id, event_type, @count_if(value < 40) AS passed FROM events GROUP BY user_id, event_type),
names AS (SELECT DISTINCT event_type FROM events WHERE event_type IN ('click', 'view')), people AS (SELECT DISTINCT user_id FROM events)
SELECT p.user_id, min(coalesce(c.passed, 0)) AS fewest, CASE WHEN min(coalesce(c.passed, 0)) >= 3 THEN 'COMPLETE' ELSE 'NOT_ESTIMABLE' END AS gate
FROM people p CROSS JOIN names n LEFT JOIN cell c ON c.user_id = p.user_id AND c.event_type = n.event_type GROUP BY p.user_id""",
    "q_nested_median_mean": """
WITH recording AS (SELECT user_id, event_type, count(*) AS blocks, @pct(value, 0.5) AS effect FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type HAVING count(*) >= 3),
person AS (SELECT user_id, count(*) AS nights, avg(effect) AS effect FROM recording GROUP BY user_id)
SELECT user_id, nights, CASE WHEN nights = 2 THEN round(effect, 9) END AS effect, CASE WHEN nights < 2 THEN 'INCOMPLETE_NIGHTS' END AS reason FROM person""",
    "q_night_difference": """
SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN value END) - avg(CASE WHEN event_type = 'click' THEN value END), 9) AS difference FROM events GROUP BY user_id""",
    # Groups, recordings, and over them: people that have every kind of event, each with the same weight.
    "q_grouping_levels": """
WITH g AS (SELECT event_type, user_id, count(*) AS total, @count_if(value < 20) AS accepted FROM events GROUP BY GROUPING SETS ((event_type), (user_id))),
c AS (SELECT user_id, event_type, @count_if(value < 20) / @float(count(*)) AS coverage FROM events GROUP BY user_id, event_type),
p AS (SELECT user_id, avg(coverage) AS coverage FROM c GROUP BY user_id HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events))
SELECT event_type, user_id, total, accepted, round(accepted / @float(total), 9) AS coverage FROM g
UNION ALL SELECT 'complete people', CAST(NULL AS bigint), count(*), CAST(NULL AS bigint), round(avg(coverage), 9) FROM p""",
    "q_runs": f"""
WITH {E}, r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) AS island FROM e)
SELECT user_id, min(k) - 1 AS start_row, max(k) AS stop_row, count(*) AS n FROM r WHERE event_type = 'error' GROUP BY user_id, island""",
    "q_interval_merge": f"""
WITH {GAPS}, o AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g WHERE b > a),
n AS (SELECT *, sum(CASE WHEN upto >= a THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT user_id, min(a) AS start_us, max(b) AS stop_us, count(*) AS parts FROM n GROUP BY user_id, island""",
    "q_gap_segments": f"""
WITH {GAPS}, span AS (SELECT user_id, min(@us(ts)) AS first_us, max(@us(ts)) AS last_us FROM events GROUP BY user_id),
o AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto,
             max(b) OVER (PARTITION BY user_id) AS final FROM g)
SELECT o.user_id, coalesce(upto, first_us) AS start_us, a AS stop_us FROM o JOIN span s ON s.user_id = o.user_id WHERE coalesce(upto, first_us) < a
UNION ALL SELECT s.user_id, m.final, s.last_us FROM span s JOIN (SELECT DISTINCT user_id, final FROM o) m ON m.user_id = s.user_id WHERE m.final < s.last_us""",
    # Overlap and intersection joins: minutes are buckets, so the join has an equal key besides its bounds.
    "q_interval_overlap_join": f"""
WITH {GAPS}, block AS (SELECT DISTINCT user_id, @idiv(@us(ts) / 3600000000.0) AS h FROM events),
piece AS (SELECT user_id, a, b, @idiv(a / 3600000000.0) + i AS h FROM (SELECT *, @numbers(@idiv(b / 3600000000.0) - @idiv(a / 3600000000.0) + 1) AS i FROM g) AS x)
SELECT block.user_id, block.h AS block, count(*) AS gaps, @long(sum(least(b, (block.h + 1) * 3600000000) - greatest(a, block.h * 3600000000))) AS overlap_us
FROM block JOIN piece ON piece.user_id = block.user_id AND piece.h = block.h WHERE a < (block.h + 1) * 3600000000 AND b > block.h * 3600000000 GROUP BY block.user_id, block.h""",
    "q_interval_intersection": f"""
WITH {GAPS}, w AS (SELECT user_id, @us(ts) AS c, @us(ts) + 3600000000 AS d FROM events WHERE event_type = 'view'),
gp AS (SELECT *, @idiv(a / 3600000000.0) + i AS h FROM (SELECT *, @numbers(@idiv(b / 3600000000.0) - @idiv(a / 3600000000.0) + 1) AS i FROM g) AS x),
wp AS (SELECT *, @idiv(c / 3600000000.0) + i AS h FROM (SELECT *, @numbers(@idiv(d / 3600000000.0) - @idiv(c / 3600000000.0) + 1) AS i FROM w) AS y)
SELECT DISTINCT gp.user_id, greatest(a, c) AS start_us, least(b, d) AS stop_us FROM gp JOIN wp ON gp.user_id = wp.user_id AND gp.h = wp.h WHERE greatest(a, c) < least(b, d)""",
    "q_support_containment": f"""
WITH {GAPS}, s AS (SELECT user_id, event_id, @us(ts) AS c, @us(ts) + 60000000 AS d FROM events WHERE event_type = 'click'),
gp AS (SELECT *, @idiv(a / 3600000000.0) + i AS h FROM (SELECT *, @numbers(@idiv(b / 3600000000.0) - @idiv(a / 3600000000.0) + 1) AS i FROM g) AS x)
SELECT DISTINCT s.user_id, s.event_id FROM s JOIN gp ON gp.user_id = s.user_id AND gp.h = @idiv(s.c / 3600000000.0) WHERE a <= c AND d <= b""",
    "q_interval_iou": f"""
WITH {GAPS}, p AS (SELECT user_id, a, b, lead(a) OVER (PARTITION BY user_id ORDER BY a, b) AS c, lead(b) OVER (PARTITION BY user_id ORDER BY a, b) AS d FROM g)
SELECT user_id, a AS start_us, round(@float(greatest(0, least(b, d) - greatest(a, c))) / (greatest(b, d) - least(a, c)), 9) AS iou, (d - c) - (b - a) AS duration_bias_us FROM p WHERE c IS NOT NULL""",
    "q_burst_sessions": f"""
WITH {E}, d AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY k) <= 7200000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS burst FROM d)
SELECT user_id, burst, count(*) AS n, min(us) AS start_us, max(us) AS stop_us FROM s GROUP BY user_id, burst""",
    "q_prev_next_interval": f"""
WITH {E} SELECT event_id, us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS previous_us,
lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) - us AS next_us FROM e""",
    "q_tumbling": """
SELECT user_id, @idiv(@us(ts) / 21600000000.0) AS win, count(*) AS n, round(avg(value), 9) AS mean_value, round(max(value) - min(value), 9) AS range_value FROM events GROUP BY user_id, @idiv(@us(ts) / 21600000000.0)""",
    # Windows of four hops; those that a recording doesn't cover whole, at its beginning and end, are dropped.
    "q_hopping": """
WITH h AS (SELECT user_id, value, @idiv(@us(ts) / 5400000000.0) AS hop FROM events), r AS (SELECT user_id, min(hop) AS first_hop, max(hop) AS last_hop FROM h GROUP BY user_id),
w AS (SELECT user_id, value, hop - i AS w FROM (SELECT *, @numbers(4) AS i FROM h) AS x)
SELECT w.user_id, w AS win, count(*) AS n, round(sum(value), 6) AS total FROM w JOIN r ON r.user_id = w.user_id WHERE w >= first_hop AND w + 3 <= last_hop GROUP BY w.user_id, w""",
    # Ownership by whole half-samples: a centre belongs to the chunk whose core holds it, each exactly once.
    "q_halo_chunks": f"""
WITH {E}, c AS (SELECT user_id, k, @idiv((k - 1) / 10.0) AS core FROM e), h AS (SELECT user_id, k, core + i - 1 AS chunk, core FROM (SELECT *, @numbers(3) AS i FROM c) AS x),
m AS (SELECT user_id, chunk, k, core, avg(@float(k)) OVER (PARTITION BY user_id, chunk ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM h)
SELECT user_id, k, round(smooth, 9) AS smooth FROM m WHERE chunk = core""",
    "q_robust_reference": """
SELECT event_type, @pct(value, 0.25) AS q25, @pct(value, 0.5) AS center, CASE WHEN @pct(value, 0.75) - @pct(value, 0.25) <= 1e-12 THEN 1 ELSE round(@pct(value, 0.75) - @pct(value, 0.25), 9) END AS scale
FROM events WHERE user_id % 2 = 0 GROUP BY event_type""",
    "q_standardize": """
WITH r AS (SELECT event_type, @pct(value, 0.5) AS center, @pct(value, 0.75) - @pct(value, 0.25) AS iqr FROM events WHERE user_id % 2 = 0 GROUP BY event_type)
SELECT event_id, round((value - center) / CASE WHEN iqr <= 1e-12 THEN 1 ELSE iqr END, 9) AS z FROM events e JOIN r ON r.event_type = e.event_type""",
    "q_even_take_threshold": f"""
WITH {E}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e),
t AS (SELECT user_id, n, @numbers(20) AS i FROM (SELECT DISTINCT user_id, n FROM n) AS u),
p AS (SELECT DISTINCT t.user_id, CASE WHEN n <= 20 THEN i + 1 ELSE @idiv(i * (n - 1) / 19.0) + 1 END AS k FROM t WHERE i < n)
SELECT e.event_type, count(*) AS taken, round(@pct(e.value, 0.95), 9) AS threshold FROM e JOIN p ON p.user_id = e.user_id AND p.k = e.k GROUP BY e.event_type""",
    "q_boundary_scores": f"""
WITH {E}, s AS (SELECT user_id, k, value, avg(value) OVER b AS pre, count(value) OVER b AS n0, avg(value) OVER a AS post, count(value) OVER a AS n1 FROM e
  WINDOW b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, k, CASE WHEN n0 = 4 AND n1 = 4 THEN round(abs(post - pre), 9) END AS score FROM s""",
    "q_grid_validation": f"""
WITH {E}, d AS (SELECT user_id, k, us - lag(us) OVER (PARTITION BY user_id ORDER BY k) AS step FROM e), m AS (SELECT user_id, @pct(step, 0.5) AS nominal FROM d WHERE step IS NOT NULL GROUP BY user_id)
SELECT d.user_id, round(m.nominal, 3) AS nominal, count(*) AS steps, @count_if(step <= 0) AS backward, @count_if(abs(step - nominal) > 1e-6 * nominal + 1e-3) AS irregular FROM d JOIN m ON m.user_id = d.user_id WHERE step IS NOT NULL GROUP BY d.user_id, m.nominal""",
    "q_local_maxima": f"""
WITH {E}, f AS (SELECT user_id, k, floor(value) AS v, CASE WHEN floor(value) = lag(floor(value)) OVER (PARTITION BY user_id ORDER BY k) THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM f),
p AS (SELECT user_id, island, min(k) AS k, max(v) AS v FROM i GROUP BY user_id, island),
n AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY island) AS l, lead(v) OVER (PARTITION BY user_id ORDER BY island) AS r FROM p)
SELECT user_id, k, v AS score FROM n WHERE v >= 15 AND v > coalesce(l, -1) AND v > coalesce(r, -1)""",
    # A band join: buckets as wide as the tolerance, each event held against three of them.
    "q_band_join_pairs": """
WITH a AS (SELECT user_id, event_id, @us(ts) AS t FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id, @us(ts) AS t FROM events WHERE event_type = 'view'),
p AS (SELECT *, @idiv(t / 3600000000.0) + i - 1 AS h FROM (SELECT *, @numbers(3) AS i FROM a) AS x)
SELECT p.user_id, p.event_id AS a_id, b.event_id AS b_id, b.t - p.t AS lag_us FROM p JOIN b ON b.user_id = p.user_id AND @idiv(b.t / 3600000000.0) = p.h WHERE abs(b.t - p.t) <= 3600000000""",
    "q_event_bins": f"""
WITH {E}, u AS (SELECT user_id, @idiv((max(k) - 1) / 20.0) + 1 AS bins FROM e GROUP BY user_id),
grid AS (SELECT user_id, event_type, bin FROM (SELECT user_id, @numbers(bins) AS bin FROM u) AS b CROSS JOIN (SELECT DISTINCT event_type FROM e) AS t),
c AS (SELECT user_id, event_type, @idiv((k - 1) / 20.0) AS bin, count(*) AS n FROM e GROUP BY user_id, event_type, @idiv((k - 1) / 20.0))
SELECT g.user_id, g.event_type, @long(g.bin) AS bin, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN c ON c.user_id = g.user_id AND c.event_type = g.event_type AND c.bin = g.bin""",
    "q_event_rate": """
WITH x AS (SELECT user_id, @count_if(event_type = 'purchase') AS n, @float(max(@us(ts)) - min(@us(ts))) / 60000000 AS minutes FROM events GROUP BY user_id)
SELECT user_id, n, CASE WHEN minutes > 0 THEN round(n / minutes, 9) END AS per_minute FROM x""",
    "q_morphology_quantiles": """
WITH x AS (SELECT user_id, max(@us(ts)) - min(@us(ts)) AS exposure FROM events GROUP BY user_id),
m AS (SELECT user_id, event_type, count(*) AS n, @pct(value, 0.1) AS q10, @pct(value, 0.5) AS q50, @pct(value, 0.9) AS q90 FROM events GROUP BY user_id, event_type)
SELECT m.user_id, m.event_type, n, round(q10, 9) AS q10, round(q50, 9) AS q50, round(q90, 9) AS q90, round(@float(n) * 60000000 / exposure, 9) AS rate_per_minute FROM m JOIN x ON x.user_id = m.user_id WHERE exposure > 0""",
    "q_channel_median_iqr": """
SELECT @idiv(@us(ts) / 86400000000.0) AS win, round(@pct(value, 0.5), 9) AS med, round(@pct(value, 0.75) - @pct(value, 0.25), 9) AS iqr FROM events GROUP BY @idiv(@us(ts) / 86400000000.0)""",
    "q_window_qc": """
WITH c AS (SELECT @idiv(@us(ts) / 21600000000.0) AS win, event_type AS channel, max(value) - min(value) AS ptp, stddev_pop(value) AS sd FROM events GROUP BY @idiv(@us(ts) / 21600000000.0), event_type)
SELECT win, count(*) AS channels, @count_if(ptp <= 90 AND sd >= 0.05) AS kept, CASE WHEN @count_if(ptp <= 90 AND sd >= 0.05) >= greatest(2, ceil(0.75 * count(*))) THEN 1 ELSE 0 END AS valid FROM c GROUP BY win""",
    "q_realigned_events": """
SELECT event_id, @us(ts) - 200000 AS aligned_us, CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE event_type END AS swapped FROM events""",
    "q_prefix_limit": f"WITH {E} SELECT user_id, k, value FROM e WHERE k BETWEEN 11 AND 20",
    "q_first_per_key": """
SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) AS x WHERE r = 1""",
    "q_transition_geometry": f"""
WITH {E}, w AS (SELECT user_id, k, avg(value) OVER b AS pre, count(*) OVER b AS n0, avg(value) OVER a AS post, count(*) OVER a AS n1, last_value(value) OVER a AS last_v, first_value(us) OVER b AS t0, last_value(us) OVER a AS t1,
    value - lag(value) OVER (PARTITION BY user_id ORDER BY k) AS step, first_value(value) OVER b AS b0, lag(value) OVER (PARTITION BY user_id ORDER BY k) AS b1, value AS a0 FROM e
  WINDOW b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
p AS (SELECT *, sum(abs(step)) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS path FROM w)
SELECT user_id, k, CASE WHEN n0 = 3 AND n1 = 3 THEN round(abs(post - pre), 9) END AS distance, CASE WHEN n0 = 3 AND n1 = 3 THEN round(path, 9) END AS path_length,
       CASE WHEN n0 = 3 AND n1 = 3 THEN round(path / (@float(t1 - t0) / 1000000), 9) END AS speed, CASE WHEN n0 = 3 AND n1 = 3 THEN round(abs(last_v - pre), 9) END AS return_distance,
       CASE WHEN n0 = 3 AND n1 = 3 AND b1 <> b0 AND last_v <> a0 THEN round(acos(greatest(-1.0, least(1.0, sign(b1 - b0) * sign(last_v - a0)))), 9) END AS turning_angle FROM p""",
}
QUERIES, ORACLES = both(TEXTS)
