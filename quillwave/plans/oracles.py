"""The same queries as SQL over the same tables."""

from __future__ import annotations

from quillwave.plans import views
from quillwave.plans.views import SECONDS_PER_ACCEPT, THRESHOLD
from quillwave.sources import pcm
from quillwave.sources.actions import ACTIONS

_ACTION = "CASE label % 9 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(ACTIONS)) + " END"


def seq(count: str = "8", width: int = 8) -> str:
    return f"""seq AS (
  SELECT vec_id, 'c' || label AS command_id, 't' || vec_id AS template_id, vec_id AS created_at, CASE WHEN label <= 7 THEN 'c' || label END AS truth,
    CASE (vec_id // 10) % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'TIRED' WHEN 2 THEN 'ILL' ELSE 'OTHER' END AS condition, CAST(400 + 10 * (vec_id % 50) AS BIGINT) AS duration_ms,
    label, CAST({count} AS INTEGER) AS frame_count, list_transform(range(CAST({count} AS BIGINT)), lambda i: CAST(embedding[i * {width} + 1:(i + 1) * {width}] AS FLOAT[])) AS features
  FROM embeddings)"""


FIXED, RAGGED = seq(), seq("5 + vec_id % 4")
SIDES = "queries AS (SELECT *, vec_id AS query_id FROM seq WHERE vec_id % 10 = 0), templates AS (SELECT * FROM seq WHERE vec_id % 10 <> 0 AND label <= 7)"
SINGLE = "queries AS (SELECT *, vec_id AS query_id FROM seq WHERE vec_id % 10 = 0), templates AS (SELECT * FROM seq WHERE vec_id IN (SELECT min(vec_id) FROM seq WHERE vec_id % 10 <> 0 AND label <= 7 GROUP BY label))"


def derived(order: int) -> str:
    """`seq` with derivatives up to `order` beside the features."""
    step = lambda x: f"list_transform(range(1, len({x}) + 1), lambda f: list_transform(range(1, len({x}[1]) + 1), lambda k: CAST(({x}[least(f + 1, len({x}))][k] - {x}[greatest(f - 1, 1)][k]) / CAST(2 AS FLOAT) AS FLOAT)))"
    wide = ["features", "list_transform(range(1, 9), lambda f: features[f] || d1[f])", "list_transform(range(1, 9), lambda f: features[f] || d1[f] || d2[f])"][order]
    return f"{FIXED.replace('seq AS', 'static_seq AS', 1)}, first_d AS (SELECT *, {step('features')} AS d1 FROM static_seq), second_d AS (SELECT *, {step('d1')} AS d2 FROM first_d), seq AS (SELECT * EXCLUDE (d1, d2) REPLACE ({wide} AS features) FROM second_d)"


def dtw(views: str, sides: str = SIDES, band: float = 0.1, on: str = "true") -> str:
    """WITH clause up to `pairs` (query_id, command_id, template_id, created_at, distance): one cell of the recurrence a step."""
    return f"""WITH RECURSIVE {views}, {sides}, base AS (
  SELECT q.query_id, t.command_id, t.template_id, t.created_at, q.features AS a, t.features AS b, q.frame_count AS n, t.frame_count AS m,
    greatest(1, CAST(floor({band} * greatest(q.frame_count, t.frame_count)) AS INTEGER)) AS band, CAST(t.frame_count AS DOUBLE) / q.frame_count AS slope
  FROM queries q, templates t WHERE len(q.features[1]) = len(t.features[1]) AND {on}
), cells(query_id, template_id, i, j, above, now) AS (
  SELECT query_id, template_id, 1, 1, list_concat([CAST(0 AS DOUBLE)], list_transform(range(m), lambda x: CAST('Infinity' AS DOUBLE))), [CAST('Infinity' AS DOUBLE)] FROM base
  UNION ALL
  SELECT query_id, template_id, CASE WHEN j = m THEN i + 1 ELSE i END, CASE WHEN j = m THEN 1 ELSE j + 1 END,
    CASE WHEN j = m THEN list_append(now, v) ELSE above END, CASE WHEN j = m THEN [CAST('Infinity' AS DOUBLE)] ELSE list_append(now, v) END
  FROM (
    SELECT query_id, template_id, i, j, m, above, now,
      CASE WHEN j > floor((i - 1) * slope) - band AND j <= floor((i - 1) * slope) + band AND abs((i - 1) - floor((j - 1) / slope)) <= band
        THEN sqrt(list_sum(list_transform(range(1, len(a[i]) + 1), lambda k: CAST(a[i][k] - b[j][k] AS DOUBLE) * CAST(a[i][k] - b[j][k] AS DOUBLE)))) + least(above[j + 1], now[j], above[j])
        ELSE CAST('Infinity' AS DOUBLE) END AS v
    FROM cells JOIN base USING (query_id, template_id) WHERE i <= n)
), pairs AS (
  SELECT query_id, command_id, template_id, created_at, CAST(above[m + 1] / (n + m) AS FLOAT) AS distance FROM cells JOIN base USING (query_id, template_id) WHERE i = n + 1 AND j = 1
), best AS (
  SELECT query_id, command_id, template_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, command_id ORDER BY distance, created_at, template_id) AS rn FROM pairs) WHERE rn = 1
), ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER w AS rn, lead(distance) OVER w AS runner_up FROM best WINDOW w AS (PARTITION BY query_id ORDER BY distance, command_id)) WHERE rn = 1
)"""


CONFIDENCE = """least(greatest(0.6 * least(greatest(1 - CAST(distance AS DOUBLE) / limit_, 0), 1) + 0.4 * CASE WHEN runner_up IS NULL OR runner_up <= 0 OR runner_up = CAST('Infinity' AS FLOAT) THEN 1
  ELSE least(greatest((CAST(runner_up AS DOUBLE) - CAST(distance AS DOUBLE)) / CAST(runner_up AS DOUBLE), 0), 1) END, 0), 1)"""


def results(threshold: float) -> str:
    return f"""results AS (
  SELECT q.query_id, CASE WHEN reason IS NULL THEN 'MATCH' ELSE 'NO_MATCH' END AS kind, CASE WHEN reason IS NULL THEN command_id END AS command_id, CASE WHEN reason IS NULL THEN template_id END AS template_id,
    CASE WHEN reason IS NULL THEN {CONFIDENCE} END AS confidence, coalesce(distance, CAST('Infinity' AS FLOAT)) AS distance, reason, CASE WHEN reason IS NOT NULL THEN command_id END AS nearest_command_id
  FROM (SELECT q.query_id, r.*EXCLUDE (query_id), CAST(CAST({threshold} AS FLOAT) AS DOUBLE) AS limit_,
      CASE WHEN q.frame_count = 0 THEN 'EMPTY_INPUT' WHEN r.command_id IS NULL THEN 'NO_TEMPLATES' WHEN r.distance > CAST({threshold} AS FLOAT) THEN 'BELOW_CONFIDENCE' END AS reason
    FROM queries q LEFT JOIN ranked r ON q.query_id = r.query_id) q
)"""


RESULT_COLUMNS = "query_id, kind, command_id, template_id, round(confidence, 4) AS confidence, round(CAST(distance AS DOUBLE), 5) AS distance, reason, nearest_command_id"


def decided(threshold: str = f"CAST({THRESHOLD} AS FLOAT)") -> str:
    return f"""decided AS (
  SELECT q.query_id, q.truth, q.condition, q.duration_ms, w.command_id AS winner, w.distance AS winner_distance, CASE WHEN w.distance <= {threshold} THEN w.command_id END AS predicted
  FROM queries q LEFT JOIN (SELECT query_id, command_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, command_id) AS k FROM best WHERE distance < CAST('Infinity' AS FLOAT)) WHERE k = 1) w ON q.query_id = w.query_id
)"""


OVERALL = """SELECT positives, false_rejects, negatives, false_accepts, negative_seconds, CASE WHEN positives > 0 THEN false_rejects / positives ELSE 0.0 END AS frr,
  CASE WHEN negative_seconds > 0 THEN false_accepts * 3600.0 / negative_seconds ELSE 0.0 END AS far_per_hour FROM (
  SELECT count(*) FILTER (truth IS NOT NULL) AS positives, count(*) FILTER (truth IS NOT NULL AND NOT coalesce(predicted = truth, false)) AS false_rejects, count(*) FILTER (truth IS NULL) AS negatives,
    count(*) FILTER (truth IS NULL AND predicted IS NOT NULL) AS false_accepts, CAST(coalesce(sum(duration_ms) FILTER (truth IS NULL), 0) AS DOUBLE) / 1000.0 AS negative_seconds FROM decided)"""

FALSE_REJECT = "CASE WHEN coalesce(predicted = truth, false) THEN 0 ELSE 1 END"
BUDGET = f"""budget AS (SELECT greatest(1, CAST(floor(CAST(coalesce(sum(duration_ms) FILTER (truth IS NULL), 0) AS DOUBLE) / 1000.0 / {SECONDS_PER_ACCEPT} + 0.5) AS BIGINT)) AS budget FROM decided),
ordered AS (SELECT command_id, row_number() OVER (ORDER BY min(vec_id)) - 1 AS i, count(*) OVER () AS n FROM templates GROUP BY command_id),
shares AS (SELECT command_id, CAST(floor((i + 1) * budget / n) - floor(i * budget / n) AS BIGINT) AS allowance FROM ordered, budget)"""
THRESHOLDS = """negatives AS (SELECT winner AS command_id, query_id, winner_distance AS distance FROM decided WHERE truth IS NULL AND winner IS NOT NULL),
thresholds AS (
  SELECT s.command_id, s.allowance, coalesce(CAST(b.distance - CAST(0.0001 AS FLOAT) AS FLOAT), CAST((SELECT coalesce(max(distance), CAST(8 AS FLOAT)) FROM best WHERE distance < CAST('Infinity' AS FLOAT)) + CAST(1 AS FLOAT) AS FLOAT)) AS threshold
  FROM shares s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY distance, query_id) AS nth FROM negatives) b ON b.command_id = s.command_id AND b.nth = s.allowance + 1
)"""
COMMANDS = f"commands AS (SELECT DISTINCT 'c' || label AS command_id, 'command ' || label AS label, {_ACTION} AS action FROM embeddings)"
ACTION_TABLE = "actions(action, action_label) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ACTIONS) + ")"
PCM = "pcm AS (SELECT vec_id, CAST(embedding AS FLOAT[]) AS x FROM embeddings)"
FRAMES = "frames AS (SELECT vec_id, f, x[f * 10 + 1:f * 10 + 25] AS w FROM pcm, range(4) r(f))"
EMPHASISED = "pcm AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i = 1 THEN CAST(embedding[1] AS FLOAT) ELSE CAST(CAST(embedding[i] AS FLOAT) - CAST(0.97 AS FLOAT) * CAST(embedding[i - 1] AS FLOAT) AS FLOAT) END) AS x FROM embeddings)"
HAMMING = "list_transform(w, lambda v, i: CAST(v * CAST(0.54 - 0.46 * cos(2 * pi() * (i - 1) / 24) AS FLOAT) AS FLOAT))"
POWER = f"""win AS (SELECT vec_id, f, {HAMMING} AS w FROM frames), power AS (
  SELECT vec_id, f, k, CAST((re * re + im * im) / 32 AS FLOAT) AS p FROM (
    SELECT vec_id, f, k, list_sum(list_transform(range(1, 26), lambda i: CAST(w[i] AS DOUBLE) * cos(2 * pi() * k * (i - 1) / 32))) AS re, list_sum(list_transform(range(1, 26), lambda i: CAST(w[i] AS DOUBLE) * sin(2 * pi() * k * (i - 1) / 32))) AS im
    FROM win, range(17) b(k)))"""
MEL = """edges AS (SELECT i, least(16, greatest(0, CAST(floor(33 * (700 * (power(10, (2595 * log10(1 + 20 / 700.0) + i * (2595 * log10(1 + 500 / 700.0) - 2595 * log10(1 + 20 / 700.0)) / 9) / 2595) - 1)) / 1000) AS BIGINT))) AS at FROM range(10) e(i)),
bank AS (SELECT a.i AS filter, k, CASE WHEN k >= a.at AND k < b.at THEN (k - a.at) / greatest(1, b.at - a.at) WHEN k >= b.at AND k < c.at THEN (c.at - k) / greatest(1, c.at - b.at) ELSE 0.0 END AS weight
  FROM edges a JOIN edges b ON b.i = a.i + 1 JOIN edges c ON c.i = a.i + 2, range(17) r(k)),
mel AS (SELECT vec_id, f, filter, CAST(ln(greatest(sum(CAST(p AS DOUBLE) * weight), 1e-10)) AS FLOAT) AS e FROM power JOIN bank USING (k) GROUP BY ALL)"""
CEPSTRA = """cep AS (SELECT vec_id, f, c, CAST(sum(CAST(e AS DOUBLE) * CASE WHEN c = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * c * (filter + 0.5) / 8) * (1 + 11 * sin(pi() * c / 22))) AS FLOAT) AS v FROM mel, range(6) r(c) GROUP BY vec_id, f, c)"""
LEVELS = "levels AS (SELECT user_id AS device_id, event_id AS seq, value AS level FROM events)"
GATE = f"""WITH RECURSIVE {LEVELS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY seq) AS n FROM levels), gate(device_id, n, seq, level, speech, floor) AS (
  SELECT device_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false, CAST(1.0 AS DOUBLE) FROM (SELECT DISTINCT device_id FROM levels)
  UNION ALL
  SELECT g.device_id, x.n, x.seq, x.level, coalesce(x.level >= greatest(1.0, g.floor * 3.0), false), CASE WHEN x.level IS NULL OR x.level >= greatest(1.0, g.floor * 3.0) THEN g.floor ELSE (1 - 0.05) * g.floor + 0.05 * x.level END
  FROM gate g JOIN numbered x ON x.device_id = g.device_id AND x.n = g.n + 1
)"""


def mfcc(order: int) -> str:
    """The last part of a statement: coefficients less their mean, and derivatives up to `order`, a row a value."""
    near = "SELECT x.vec_id, x.f, x.c, CAST((a.v - b.v) / CAST(2 AS FLOAT) AS FLOAT) AS v FROM {0} x JOIN {0} a ON a.vec_id = x.vec_id AND a.c = x.c AND a.f = least(x.f + 1, 3) JOIN {0} b ON b.vec_id = x.vec_id AND b.c = x.c AND b.f = greatest(x.f - 1, 0)"
    tables = ["m0 AS (SELECT vec_id, f, c, CAST(v - CAST(avg(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id, c) AS FLOAT) AS FLOAT) AS v FROM cep)", f"m1 AS ({near.format('m0')})", f"m2 AS ({near.format('m1')})"]
    parts = [f"SELECT vec_id, f, CAST(c + {6 * k} AS BIGINT) AS k, round(CAST(v AS DOUBLE), 4) + 0.0 AS v FROM m{k}" for k in range(order + 1)]
    return ", ".join(tables[: order + 1]) + " " + " UNION ALL ".join(parts)


def report(front_end: str, failures: int) -> str:
    """Lines of a report over `decided` and `o`, its one row of rates."""
    return f"""SELECT CAST(row_number() OVER (ORDER BY part, key) - 1 AS INTEGER) AS line_no, line FROM (
  SELECT 0 AS part, CAST(i AS VARCHAR) AS key, line FROM (SELECT unnest(range(10, 18)) AS i, unnest(['> **SYNTHETIC: illustrative only, not a measurement on real voices.**', '', '# Recogniser evaluation: front end `{front_end}`', '',
    '- Positives: ' || positives || ', negatives: ' || negatives || ', enrolment failures: {failures}', printf('- **FRR: %.1f%%** (%d/%d rejected or substituted)', frr * 100, false_rejects, positives),
    printf('- **False accepts: %d** over %.1f s of negative audio (about %.2f an hour)', false_accepts, negative_seconds, far_per_hour), '']) AS line FROM o)
  UNION ALL SELECT 1, '', '## FRR by command' UNION ALL SELECT 2, truth, printf('- `%s`: %.1f%%', truth, 100 * avg({FALSE_REJECT})) FROM decided WHERE truth IS NOT NULL GROUP BY truth
  UNION ALL SELECT 3, '', '' UNION ALL SELECT 4, '', '## FRR by condition' UNION ALL SELECT 5, condition, printf('- %s: %.1f%%', condition, 100 * avg({FALSE_REJECT})) FROM decided WHERE truth IS NOT NULL GROUP BY condition)"""


LISTEN = """WITH RECURSIVE frames AS (SELECT user_id AS device_id, event_id * 50 AS at_ms, value > 90 AS hit FROM events), ends AS (SELECT device_id, min(at_ms) AS first, max(at_ms) AS last FROM frames GROUP BY device_id),
spoken AS (SELECT device_id, list(at_ms) AS hits FROM frames WHERE hit GROUP BY device_id),
walk(device_id, window_id, start_ms, last, hits) AS (
  SELECT device_id, CAST(0 AS BIGINT), first, last, coalesce(hits, []) FROM ends LEFT JOIN spoken USING (device_id)
  UNION ALL
  SELECT device_id, window_id + 1, start_ms + 1500 + CASE WHEN len(list_filter(hits, lambda h: h >= start_ms AND h < start_ms + 1500)) > 0 THEN 600 ELSE 0 END, last, hits FROM walk WHERE start_ms + 1500 <= last
)
SELECT device_id, window_id, start_ms, start_ms + 1500 AS end_ms, len(list_filter(hits, lambda h: h >= start_ms AND h < start_ms + 1500)) > 0 AS matched FROM walk WHERE start_ms + 1500 <= last"""


LONG = "long AS (SELECT CAST(label AS BIGINT) AS recording_id, flatten(list(CAST(embedding AS FLOAT[]) ORDER BY vec_id)) AS x FROM embeddings GROUP BY label)"
LONG_SEGMENTS = f"""WITH {LONG},
lv AS (SELECT recording_id, f, n, n_samples, CAST(sqrt(list_sum(list_transform(w, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 20) AS FLOAT) AS e FROM (
  SELECT recording_id, f, n, len(x) AS n_samples, x[f * 10 + 1:f * 10 + 20] AS w FROM (SELECT *, (len(x) - 20) // 10 + 1 AS n, unnest(range((len(x) - 20) // 10 + 1)) AS f FROM long))),
floors AS (SELECT recording_id, greatest(CAST(e * CAST(1.2 AS DOUBLE) AS FLOAT), CAST(0.001 AS FLOAT)) AS least FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY e) AS nth FROM lv) WHERE nth = CAST(floor(0.1 * (n - 1)) AS BIGINT) + 1),
loud AS (SELECT lv.*, f - row_number() OVER (PARTITION BY lv.recording_id ORDER BY f) AS island FROM lv JOIN floors USING (recording_id) WHERE e >= least),
speech AS (SELECT recording_id, min(f) AS first, max(f) AS last, any_value(n) AS n, any_value(n_samples) AS n_samples FROM loud GROUP BY recording_id, island HAVING count(*) >= 2)
SELECT recording_id, CAST(greatest(0, min(first) - 1) * 10 AS BIGINT) AS start_sample, CAST(least(least(any_value(n) - 1, max(last) + 1) * 10 + 20, any_value(n_samples)) AS BIGINT) AS end_sample FROM speech GROUP BY recording_id"""
LONG_FRAMES = f"""{LONG}, pcm AS (SELECT recording_id AS vec_id, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN x[1] ELSE CAST(x[i] - CAST(0.97 AS FLOAT) * x[i - 1] AS FLOAT) END) AS x FROM long),
frames AS (SELECT vec_id, f, x[f * 10 + 1:f * 10 + 25] AS w FROM (SELECT *, unnest(range((len(x) - 25) // 10 + 1)) AS f FROM pcm))"""
LONG_DELTA = """m0 AS (SELECT vec_id, f, c, CAST(v - CAST(avg(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id, c) AS FLOAT) AS FLOAT) AS v FROM cep),
m1 AS (SELECT vec_id, f, c, CAST((coalesce(lead(v) OVER o, v) - coalesce(lag(v) OVER o, v)) / CAST(2 AS FLOAT) AS FLOAT) AS v FROM m0 WINDOW o AS (PARTITION BY vec_id, c ORDER BY f))
SELECT vec_id, f, CAST(c AS BIGINT) AS k, round(CAST(v AS DOUBLE), 3) + 0.0 AS v FROM m0 UNION ALL SELECT vec_id, f, CAST(c + 6 AS BIGINT), round(CAST(v AS DOUBLE), 3) + 0.0 FROM m1"""


LOOP = """WITH RECURSIVE ev AS (SELECT user_id AS device_id, event_id * 50 AS tick, CAST(value AS FLOAT) AS v, event_type, event_id FROM events),
puts AS (SELECT * FROM (SELECT *, min(CASE WHEN event_type = 'error' THEN tick END) OVER (PARTITION BY device_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM ev) WHERE event_type = 'signup'),
devices AS (SELECT device_id, min(tick) AS first, max(tick) AS last, list({'tick': tick, 'v': v} ORDER BY tick) AS fr FROM ev GROUP BY device_id),
stored AS (SELECT device_id, list({'put': tick, 'gone': gone, 't': v, 'c': 'c' || event_id % 3, 'made': event_id, 'id': 't' || event_id}) AS ts FROM puts GROUP BY device_id),
walk(device_id, place, number, idle, start, idle_steps, heard, near, is_window) AS (
  SELECT device_id, first, CAST(0 AS BIGINT), CAST(0 AS BIGINT), first, CAST(0 AS BIGINT), false, CAST(NULL AS STRUCT(d FLOAT, c VARCHAR, made BIGINT, id VARCHAR)), false FROM devices
  UNION ALL
  SELECT device_id, CASE WHEN NOT alive THEN place + 800 WHEN near.d <= 2 THEN place + 2100 ELSE place + 1500 END, number + CASE WHEN alive THEN 1 ELSE 0 END, CASE WHEN alive THEN 0 ELSE idle + 1 END, place, idle, peak IS NOT NULL, near, alive
  FROM (
    SELECT *, len(live) > 0 AS alive, CASE WHEN peak IS NOT NULL THEN list_sort(list_transform(live, lambda t: {'d': CAST(abs(CAST(peak - t.t AS DOUBLE)) / 2 AS FLOAT), 'c': t.c, 'made': t.made, 'id': t.id}))[1] END AS near
    FROM (
      SELECT w.device_id, w.place, w.number, w.idle, d.last, list_filter(coalesce(ts, []), lambda t: t.put <= w.place AND (t.gone IS NULL OR t.gone > w.place)) AS live,
        list_max(list_transform(list_filter(fr, lambda f: f.tick >= w.place AND f.tick < w.place + 1500), lambda f: f.v)) AS peak
      FROM walk w JOIN devices d ON d.device_id = w.device_id LEFT JOIN stored s ON s.device_id = w.device_id))
  WHERE place + CASE WHEN alive THEN 1500 ELSE 800 END <= last
)
SELECT device_id, number - 1 AS window_id, start, start + 1500 AS "end", idle_steps, CASE WHEN near.d <= 2 THEN 'MATCH' ELSE 'NO_MATCH' END AS kind, near.c AS command_id, near.id AS template_id, round(CAST(near.d AS DOUBLE), 5) AS distance,
  CASE WHEN NOT heard THEN 'EMPTY_INPUT' WHEN near.d > 2 THEN 'BELOW_CONFIDENCE' END AS reason FROM walk WHERE is_window"""


SIGNALS = f"""WITH specs AS (SELECT CAST(vec_id AS BIGINT) AS seq, CASE WHEN label > 7 THEN 'negative' WHEN vec_id % 10 = 0 THEN 'positive' ELSE 'enrol' END AS kind, CASE WHEN label <= 7 THEN 'c' || label END AS truth,
  CASE WHEN vec_id % 20 = 0 THEN 'TIRED' ELSE 'NORMAL' END AS condition, f0, f0 + 400.0::DOUBLE * CAST(embedding[2] AS DOUBLE) AS f1 FROM (SELECT *, 300.0::DOUBLE + 150.0::DOUBLE * label + 100.0::DOUBLE * CAST(embedding[1] AS DOUBLE) AS f0 FROM embeddings)),
samples AS (SELECT *, i / 16000.0::DOUBLE AS t, ((i * i * {pcm.NOISE_SQUARE} + i * {pcm.NOISE_STEP} + seq * {pcm.NOISE_SEED}) % {pcm.NOISE_PRIME}) / CAST({pcm.NOISE_PRIME / 2} AS DOUBLE) - 1 AS jitter FROM specs, range({pcm.RATE * views.TONE_MS // 1000}) r(i)),
waves AS (SELECT *, 2 * pi() * (f0 * t + (f1 - f0) * t * t / {2 * views.TONE_MS / 1000}::DOUBLE) AS phase FROM samples)
SELECT seq, kind, truth, condition, n, round(CAST(CAST(sqrt(sum(power(CAST(CAST(0.3::DOUBLE * sin(phase) + 0.15::DOUBLE * 0.3::DOUBLE * sin(2 * phase) + 0.003::DOUBLE * jitter AS FLOAT) AS DOUBLE), 2)) / {pcm.RATE * (views.TONE_MS + 2 * views.PAD_MS) // 1000}) AS FLOAT) AS DOUBLE), 4) AS rms
FROM waves, (SELECT CAST({pcm.RATE * (views.TONE_MS + 2 * views.PAD_MS) // 1000} AS INTEGER) AS n) GROUP BY seq, kind, truth, condition, n"""
