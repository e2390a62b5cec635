"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from pulseloom import dims
from pulseloom.operators import replay

from .queries import AS_OF, CALL_LIMIT, DAY_MS, DEVICES, GATE_HOURS, HISTORY_DAYS, HOUR_MS, KINDS, PRACTICES, REPLAY_LIMIT, REPLAY_SESSION_HOURS, REPLAY_TTL_HOURS, SESSION_HOURS, TTL_HOURS

_EV = """ev AS (
  SELECT user_id, event_id, event_type, value, ts, epoch_us(ts) // 1000 AS ms,
    CASE event_type WHEN 'click' THEN 'wood' WHEN 'error' THEN 'fire' WHEN 'purchase' THEN 'earth' WHEN 'signup' THEN 'metal' WHEN 'view' THEN 'water' END AS element,
    CASE event_type WHEN 'click' THEN 'heart_rate' WHEN 'error' THEN 'heart_rate_variability' WHEN 'purchase' THEN 'resting_heart_rate' WHEN 'signup' THEN 'sleep_analysis' WHEN 'view' THEN 'body_temperature' END AS metric_type,
    CASE event_type WHEN 'click' THEN 'bpm' WHEN 'error' THEN 'ms' WHEN 'purchase' THEN 'bpm' WHEN 'signup' THEN 'seconds' WHEN 'view' THEN 'celsius' END AS unit
  FROM events)"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EL = "el AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in r) + ")" for r in dims.ELEMENT_ROWS) + ") t(ord, element, label, organ, genre, summary, description, headline, why))"
_QU = "qu AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in dims.QUADRANT_ROWS) + ") t(quadrant, quadrant_label, quadrant_description))"


def _avg(*types: str) -> str:
    return f"CAST(greatest(0, least(100, floor(avg(CASE WHEN event_type IN ({', '.join(map(_text, types))}) THEN CAST(value AS DECIMAL(18,2)) END)))) AS BIGINT)"


_SC = f"""sc AS (SELECT user_id, {_avg('view', 'signup')} AS yin, {_avg('click', 'purchase')} AS yang, {_avg('click')} AS wood, {_avg('error')} AS fire,
  {_avg('purchase')} AS earth, {_avg('signup')} AS metal, {_avg('view')} AS water FROM ev GROUP BY user_id)"""
_LONG = """lo AS (SELECT user_id, 0 AS ord, 'wood' AS element, wood AS score FROM sc UNION ALL SELECT user_id, 1, 'fire', fire FROM sc UNION ALL
  SELECT user_id, 2, 'earth', earth FROM sc UNION ALL SELECT user_id, 3, 'metal', metal FROM sc UNION ALL SELECT user_id, 4, 'water', water FROM sc)"""
_QUADRANT = "CASE WHEN yin IS NULL OR yang IS NULL THEN NULL WHEN yin >= 50 AND yang >= 50 THEN 'peak' WHEN yang >= 50 THEN 'pushing_it' WHEN yin >= 50 THEN 'recharging' ELSE 'burnout' END"


def _label(c: str, names: tuple[str, ...]) -> str:
    return f"CASE WHEN {c} >= 80 THEN '{names[0]}' WHEN {c} >= 60 THEN '{names[1]}' WHEN {c} >= 40 THEN '{names[2]}' WHEN {c} >= 20 THEN '{names[3]}' ELSE '{names[4]}' END"


_STATE = f"""{_EV}, {_SC}, {_LONG}, {_EL}, {_QU},
  ac AS (SELECT user_id, string_agg(element, ',' ORDER BY ord) AS active, count(*) AS n, min_by(element, ord) AS first FROM lo WHERE score >= 50 GROUP BY user_id),
  tp AS (SELECT user_id, element FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS r FROM lo WHERE score IS NOT NULL) WHERE r = 1),
  st AS (SELECT sc.*, {_QUADRANT} AS quadrant FROM sc),
  ws AS (SELECT st.user_id, yin, yang, wood, fire, earth, metal, water, st.quadrant, quadrant_label, quadrant_description,
      {_label('yin', ('Fully Charged', 'Steady', 'Thinning', 'Running Low', 'Empty'))} AS yin_label,
      {_label('yang', ('Fired Up', 'Moving', 'Coasting', 'Sluggish', 'Stalled'))} AS yang_label,
      coalesce(active, '') AS active_elements, CAST(coalesce(n, 0) AS BIGINT) AS n_active, first AS first_active, tp.element AS top_element,
      CASE WHEN n > 0 THEN label || ' Qi · ' || summary ELSE 'All biometrics within normal range' END AS top_signal,
      CASE WHEN n > 0 THEN label || ' Qi pattern detected' ELSE 'No pattern detected' END AS recommendation
    FROM st LEFT JOIN qu ON st.quadrant = qu.quadrant LEFT JOIN ac ON st.user_id = ac.user_id LEFT JOIN tp ON st.user_id = tp.user_id LEFT JOIN el ON tp.element = el.element)"""
_DETAIL = f"""{_EV}, {_SC}, {_LONG}, {_EL}, de AS (SELECT user_id, lo.element, label || ' · ' || organ AS label, score, score >= 50 AS activated, headline, why AS why_this_practice, genre,
    CAST(300 AS BIGINT) AS duration_seconds, CAST(6.0 AS DOUBLE) AS breathing_rate_bpm FROM lo JOIN el ON lo.element = el.element)"""


def _gate(keys: str, d_ms: int) -> str:
    on = " AND ".join(f"e.{k} = g.{k}" for k in keys.split(", "))
    return f"""{_EV}, g AS (
      SELECT {keys}, event_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms, event_id) AS r FROM ev) WHERE r = 1
      UNION ALL
      SELECT {', '.join('n.' + k for k in keys.split(', '))}, n.event_id, n.ms FROM (
        SELECT {', '.join('e.' + k for k in keys.split(', '))}, e.event_id, e.ms, row_number() OVER (PARTITION BY {', '.join('e.' + k for k in keys.split(', '))} ORDER BY e.ms, e.event_id) AS r
        FROM g JOIN ev e ON {on} AND e.ms >= g.ms + {d_ms}) n WHERE r = 1)"""


_REQ = f"""{_EV}, rq AS (SELECT user_id, event_id AS request_id, ms, CASE WHEN event_id % 2 = 0 THEN 'ambient' ELSE 'ondemand' END AS mode, event_id % 11 = 0 AS force,
    user_id % 4 <> 0 AS optin, user_id % 50 = 7 AS disabled, user_id % 3 = 0 AS trusted, event_id % 5 <> 0 AS phones, event_id % 13 <> 0 AS audio,
    row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM ev)"""
_STEP = """CASE WHEN q.disabled THEN 'disabled' WHEN q.mode = 'ambient' AND NOT q.optin THEN 'requires_optin' WHEN q.ms < p.se THEN 'session_active'
    WHEN NOT q.force AND q.ms < (CASE WHEN q.mode = 'ambient' THEN p.ae ELSE p.oe END) THEN 'cooldown'
    WHEN NOT (q.mode = 'ondemand' AND q.trusted) AND NOT q.phones THEN (CASE WHEN q.mode = 'ambient' THEN 'skipped_no_headphones' ELSE 'no_headphones' END)
    WHEN NOT q.audio THEN 'audio_error' ELSE 'playing' END"""
_GUARD = f"""{_REQ}, fold AS (
    SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS request_id, CAST(0 AS BIGINT) AS ms, '' AS mode, '' AS status, CAST(NULL AS BIGINT) AS remaining_minutes, CAST(0 AS BIGINT) AS ae, CAST(0 AS BIGINT) AS oe, CAST(0 AS BIGINT) AS se FROM (SELECT DISTINCT user_id FROM rq)
    UNION ALL
    SELECT user_id, rn, request_id, ms, mode, status,
      CASE WHEN status = 'cooldown' THEN CAST(ceil(((CASE WHEN mode = 'ambient' THEN ae ELSE oe END) - ms) / 60000.0) AS BIGINT) END,
      CASE WHEN status = 'playing' AND mode = 'ambient' THEN ms + 43200000 ELSE ae END, CASE WHEN status = 'playing' AND mode <> 'ambient' THEN ms + 43200000 ELSE oe END,
      CASE WHEN status = 'playing' THEN ms + {SESSION_HOURS * HOUR_MS} ELSE se END
    FROM (SELECT q.user_id, q.rn, q.request_id, q.ms, q.mode, {_STEP} AS status, p.ae, p.oe, p.se FROM fold p JOIN rq q ON q.user_id = p.user_id AND q.rn = p.rn + 1))"""


_TOOL = """CASE event_type WHEN 'view' THEN 'get_wellness_state' WHEN 'click' THEN 'start_breathing_session' WHEN 'signup' THEN 'set_monitoring'
      WHEN 'purchase' THEN (CASE WHEN k < 40 THEN 'get_session_result' WHEN k < 70 THEN 'stop_session' ELSE 'get_session_history' END)
      ELSE (CASE WHEN k < 30 THEN 'status' WHEN k < 50 THEN 'connect_source' WHEN k < 70 THEN 'get_element_detail' WHEN k < 80 THEN 'no_such_tool' WHEN k < 90 THEN 'get_wellness_state' WHEN k < 95 THEN 'clear_cooldown' ELSE 'invalidate_cache' END) END"""
_TOOLS = ", ".join(_text(t) for t in replay.TOOLS)
#: Preferences: name, start, and the value that a request gives (null: none).
_GIVEN = [
    ("ambient_optin", "false", "CASE WHEN tool = 'restore' THEN user_id % 2 = 0 WHEN event_type = 'signup' AND k % 3 < 2 THEN k % 3 = 0 END"), ("disabled", "false", "CASE WHEN event_type = 'signup' AND k % 5 < 3 THEN k % 10 = 0 END"),
    ("preferred_volume", "CAST(0.3 AS DOUBLE)", "CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), k / 40.0::DOUBLE)) END"),
    ("cooldown_minutes", "CAST(30 AS BIGINT)", "CAST(CASE WHEN tool = 'restore' THEN greatest(1, user_id % 4 * 200) WHEN event_type = 'signup' AND k % 5 = 4 THEN greatest(1, least(1440, k * 20 - 100)) END AS BIGINT)"),
    ("headphones_trusted", "false", "CASE WHEN event_type = 'signup' AND k % 6 < 2 THEN k % 6 = 0 END"), ("voiceover", "true", "CASE WHEN event_type = 'signup' AND k % 7 < 2 THEN k % 7 = 0 END"),
]
_STATES = "ca, sn, ss, sm, pe, ae, oe, stn, nct"
_KEEP = ", ".join(p for p, _, _ in _GIVEN)
#: One step per request: what the request is before the state is asked, what it meets, and what it leaves.
_REPLAY = f"""ek AS (SELECT ev.*, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k FROM ev JOIN events e ON e.event_id = ev.event_id),
  ta AS (SELECT user_id, event_id AS request_id, ms, event_type, k, {_TOOL} AS tool, CASE WHEN k % 17 = 3 THEN 'plastic' WHEN k % 17 = 4 THEN '' ELSE element END AS element FROM ek
    UNION ALL SELECT user_id, -1, min(ms), NULL, NULL, 'restore', NULL FROM ev GROUP BY user_id),
  tb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, request_id) AS rn, tool IN ('restore', 'clear_cooldown', 'invalidate_cache') AS control, coalesce(element = 'plastic', false) AS bad, user_id % 5 = 0 AS mock,
    CASE WHEN k % 3 = 0 THEN 'ambient' WHEN k % 3 = 1 THEN 'ondemand' END AS asked_mode, coalesce(k % 13 <> 1, true) AS backend_ok, coalesce(k % 9 <> 1, true) AS state_ok, {", ".join(f"{g} AS g_{p}" for p, _, g in _GIVEN)} FROM ta),
  tc AS (SELECT *, NOT control AND NOT bad AND NOT mock AS counted FROM tb),
  td AS (SELECT *, CASE WHEN counted THEN count(*) FILTER (counted) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) END AS calls FROM tc),
  tq AS (SELECT *, CASE WHEN control THEN NULL WHEN bad THEN 'Invalid element ' || element WHEN calls > {REPLAY_LIMIT} THEN 'limit' WHEN tool NOT IN ({_TOOLS}) THEN 'Unknown tool ' || tool END AS before, CASE WHEN counted THEN greatest(0, {REPLAY_LIMIT} - calls) END AS calls_left FROM td),
  fo AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS ms, CAST(0 AS BIGINT) AS request_id, '' AS tool, '' AS error, '' AS status, CAST(0 AS BIGINT) AS calls_left, CAST(0 AS BIGINT) AS cache_age_seconds, false AS synced, CAST(0 AS BIGINT) AS state_no,
      CAST(0 AS BIGINT) AS session_no, '' AS session_mode, CAST(0 AS BIGINT) AS duration_played, CAST(0 AS BIGINT) AS remaining_minutes,
      CAST(NULL AS BIGINT) AS ca, CAST(NULL AS BIGINT) AS sn, CAST(NULL AS BIGINT) AS ss, CAST(NULL AS VARCHAR) AS sm, CAST(0 AS BIGINT) AS pe, CAST(0 AS BIGINT) AS ae, CAST(0 AS BIGINT) AS oe, CAST(0 AS BIGINT) AS stn, CAST(0 AS BIGINT) AS nct,
      {", ".join(f"{v} AS {p}" for p, v, _ in _GIVEN)} FROM (SELECT DISTINCT user_id FROM tq)
    UNION ALL
    SELECT user_id, rn, ms, request_id, tool, CASE WHEN before IS NOT NULL THEN before WHEN failed THEN (CASE WHEN tool = 'get_wellness_state' THEN 'state' ELSE 'backend' END) END,
      CASE WHEN before IS NOT NULL OR failed THEN NULL WHEN control THEN 'done' WHEN hit THEN 'cached' WHEN fresh THEN 'fresh' WHEN guard IS NOT NULL THEN guard WHEN result THEN 'result' WHEN tool = 'stop_session' THEN (CASE WHEN sn IS NULL THEN 'no_active_session' ELSE 'stopped' END)
        WHEN tool = 'status' THEN 'status' WHEN tool = 'set_monitoring' THEN 'updated' WHEN tool = 'get_element_detail' THEN 'detail' WHEN tool = 'get_session_history' THEN 'history'
        ELSE (CASE WHEN k % 4 = 3 THEN 'error' WHEN mock AND k % 4 = 2 THEN 'mock_mode' WHEN mock THEN 'error' WHEN backend_ok THEN 'started' ELSE 'backend_error' END) END,
      calls_left, CASE WHEN hit THEN (ms - ca + 500) // 1000 WHEN fresh THEN 0 END, CASE WHEN asks AND NOT hit THEN k % 7 = 0 AND NOT mock END, CASE WHEN made THEN stn + 1 END,
      CASE WHEN plays THEN request_id WHEN shows THEN sn END, CASE WHEN plays THEN mode WHEN shows THEN sm END, CASE WHEN plays THEN 0 WHEN shows THEN (ms - ss + 500) // 1000 END, CASE WHEN guard = 'cooldown' THEN CAST(ceil((wait - ms) / 60000.0) AS BIGINT) END,
      CASE WHEN made THEN ms WHEN result OR (control AND tool = 'invalidate_cache') THEN NULL ELSE ca END,
      CASE WHEN plays THEN request_id WHEN gone THEN NULL ELSE sn END, CASE WHEN plays THEN ms WHEN gone THEN NULL ELSE ss END, CASE WHEN plays THEN mode WHEN gone THEN NULL ELSE sm END, CASE WHEN plays THEN ms + {REPLAY_SESSION_HOURS * HOUR_MS} ELSE pe END,
      CASE WHEN plays AND mode = 'ambient' THEN ms + cooldown_minutes * 60000 WHEN tool = 'clear_cooldown' AND coalesce(asked_mode, '') <> 'ondemand' THEN 0 ELSE ae END, CASE WHEN plays AND mode = 'ondemand' THEN ms + cooldown_minutes * 60000 WHEN tool = 'clear_cooldown' AND coalesce(asked_mode, '') <> 'ambient' THEN 0 ELSE oe END,
      stn + CAST(made AS BIGINT), CASE WHEN tool = 'restore' THEN user_id % 3 ELSE nct + CAST(plays AS BIGINT) END,
      {", ".join(f"CASE WHEN saves THEN coalesce(g_{p}, {p})" + (" WHEN plays THEN voiceover AND nct + 1 < 3" if p == "voiceover" else "") + f" ELSE {p} END" for p, _, _ in _GIVEN)}
    FROM (SELECT *, before IS NULL AND tool = 'get_wellness_state' AS asks,
        asks AND k % 7 <> 0 AND ca IS NOT NULL AND ms - ca <= {REPLAY_TTL_HOURS * HOUR_MS} AS hit, coalesce(hit, false) IS FALSE AND asks AND (mock OR state_ok) AS fresh,
        coalesce(asked_mode, 'ondemand') AS mode, CASE WHEN coalesce(asked_mode, 'ondemand') = 'ambient' THEN ae ELSE oe END AS wait, before IS NULL AND tool = 'start_breathing_session' AS starts, starts AND NOT disabled AND NOT (mode = 'ambient' AND NOT ambient_optin) AS meets,
        CASE WHEN NOT starts THEN NULL WHEN disabled THEN 'disabled' WHEN NOT meets THEN 'requires_optin' WHEN sn IS NOT NULL AND ms < pe THEN 'session_active' WHEN k % 11 <> 0 AND ms < wait THEN 'cooldown'
          WHEN NOT (mode = 'ondemand' AND headphones_trusted) AND k % 8 = 2 THEN (CASE WHEN mode = 'ambient' THEN 'skipped_no_headphones' ELSE 'no_headphones' END) WHEN NOT (mock OR backend_ok) THEN 'backend' WHEN k % 10 = 3 THEN 'audio_error' ELSE 'playing' END AS guard,
        coalesce(guard = 'playing', false) AS plays, before IS NULL AND tool = 'get_session_result' AND (mock OR backend_ok) AS result, coalesce(fresh, false) OR (result AND (mock OR state_ok)) AS made,
        coalesce(guard = 'backend', false) OR (asks AND NOT coalesce(hit, false) AND NOT fresh) OR (before IS NULL AND tool IN ('get_session_result', 'get_element_detail', 'get_session_history') AND NOT (mock OR backend_ok)) AS failed,
        coalesce(hit, false) OR fresh OR (before IS NULL AND tool IN ('status', 'stop_session')) AS shows, (before IS NULL AND tool = 'stop_session') OR (meets AND sn IS NOT NULL AND ms >= pe) AS gone, (before IS NULL AND tool = 'set_monitoring') OR tool = 'restore' AS saves
      FROM (SELECT q.*, {", ".join("p." + c for c in _STATES.split(", "))}, {", ".join("p." + c for c, _, _ in _GIVEN)} FROM fo p JOIN tq q ON q.user_id = p.user_id AND q.rn = p.rn + 1)))"""


def _draw(key: str, name: str, low: str, high: str) -> str:
    return f"({low} + CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{name}'), 1, 8)) AS BIGINT) % ({high} - {low} + 1))"


def _num(name: str, low: tuple[int, int], high: tuple[int, int], add: str = "0") -> str:
    a, b = (f"(CASE WHEN stressed THEN {x[0]} ELSE {x[1]} END)" for x in (low, high))
    return f"CAST(greatest(0, least(100, {_draw('event_id', name, a, b)} + {add})) AS BIGINT)"


def _bias(c: str, night: int, noon: int, morning: int) -> str:
    return f"CAST(CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN {night} WHEN hour(ts) >= 13 AND hour(ts) < 15 THEN {noon} WHEN hour(ts) >= 9 AND hour(ts) < 12 THEN {morning} ELSE 0 END AS BIGINT){c}"


_B36 = "list_transform(range(8), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({ms} // CAST(pow(36, 7 - i) AS BIGINT)) % 36 AS INTEGER) + 1, 1))"


def _sess(ms: str) -> str:
    return f"'sess_' || ltrim(array_to_string({_B36.format(ms=ms)}, ''), '0')"


_PLANS = """pl AS (SELECT 'sess_' || o_orderkey AS session_id, CAST(floor(o_totalprice) AS BIGINT) % 300 AS s, 4.0::DOUBLE + o_custkey % 5 AS bpm,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'wood' WHEN '2-HIGH' THEN 'fire' WHEN '3-MEDIUM' THEN 'earth' WHEN '4-NOT SPECIFIED' THEN 'metal' WHEN '5-LOW' THEN 'water' END AS element FROM orders)"""
_LOG = """lg AS (SELECT o_custkey AS user_id, 'sess_' || o_orderkey AS session_id, o_orderkey AS session_no, o_orderdate AS ts,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'wood' WHEN '2-HIGH' THEN 'fire' WHEN '3-MEDIUM' THEN 'earth' WHEN '4-NOT SPECIFIED' THEN 'metal' WHEN '5-LOW' THEN 'water' END AS element,
    'audio' AS tier, CAST(300 AS BIGINT) AS duration_seconds FROM orders)"""
_SYN = f"""{_EV}, cn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev), cs AS (SELECT *, (n = 1 OR n % 3 = 0) AS stressed FROM cn),
  sy AS (SELECT event_id, stressed, {_num('yin', (15, 40), (45, 85), _bias('', -15, -10, 10))} AS yin, {_num('yang', (50, 35), (80, 90), _bias('', -20, -10, 15))} AS yang,
    {_num('wood', (40, 10), (80, 45))} AS wood, {_num('fire', (30, 5), (70, 40), _bias('', 20, 0, 0))} AS fire, {_num('earth', (25, 10), (60, 40), _bias('', 0, 15, -10))} AS earth,
    {_num('metal', (5, 5), (55, 35))} AS metal, {_num('water', (5, 5), (45, 25))} AS water FROM cs),
  bo AS (SELECT *, greatest(wood, fire, earth, metal, water) AS m, CAST({_draw('event_id', 'boost', '55', '75')} AS BIGINT) AS b FROM sy)"""
_LIFT = "CASE WHEN stressed AND m < 50 AND {e} = m{others} THEN b ELSE {e} END AS {e}"
_LIFTS = ", ".join(_LIFT.format(e=e, others="".join(f" AND {o} <> m" for o in dims.ELEMENTS[:i])) for i, e in enumerate(dims.ELEMENTS))

_HR = """hr AS (SELECT user_id, 'heart_rate' AS metric_type, v AS value, 'bpm' AS unit, ms AS start_ms, ms AS end_ms, 'oura' AS source FROM
    (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN [value, 0.0] ELSE [value] END) AS v FROM ev WHERE event_id % 11 NOT IN (0, 1) AND event_id % 13 <> 0) WHERE v IS NOT NULL)"""
_SLEEP = """sl AS (SELECT user_id, m AS metric_type, v AS value, u AS unit, ms AS start_ms, ms AS end_ms, 'oura' AS source FROM (
    SELECT *, 'heart_rate_variability' AS m, CASE WHEN event_id % 2 = 0 THEN value END AS v, 'ms' AS u FROM (SELECT * EXCLUDE (unit, metric_type) FROM ev)
    UNION ALL SELECT *, 'resting_heart_rate', CASE WHEN event_id % 3 <> 0 THEN value END, 'bpm' FROM (SELECT * EXCLUDE (unit, metric_type) FROM ev)
    UNION ALL SELECT *, 'sleep_analysis', CASE WHEN event_id % 5 = 0 THEN 0.0 END, 'seconds' FROM (SELECT * EXCLUDE (unit, metric_type) FROM ev)) WHERE v IS NOT NULL)"""
_READY = """rd AS (SELECT user_id, 'body_temperature' AS metric_type, 36.8::DOUBLE + value / 100 AS value, 'celsius' AS unit, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS start_ms,
    epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + 86399000 AS end_ms, 'oura' AS source FROM ev WHERE event_id % 3 <> 0 AND value IS NOT NULL)"""
_VENDOR = f"{_EV}, {_HR}, {_SLEEP}, {_READY}, vs AS (SELECT * FROM hr UNION ALL SELECT * FROM sl UNION ALL SELECT * FROM rd)"


def _pick(values: tuple[str | None, ...]) -> str:
    return "([" + ", ".join("NULL" if v is None else _text(v) for v in values) + f"])[event_id % {len(values)} + 1]"


_ROUND1 = "printf('%.1f', {x})"
ORACLES = {
    "voiceover_switched": f"""WITH {_EV}, s AS (SELECT user_id, event_id, event_type, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS session_count,
          last_value(CASE event_type WHEN 'signup' THEN true WHEN 'error' THEN false END IGNORE NULLS) OVER w AS switched
        FROM ev WHERE event_type IN ('purchase', 'signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id, event_id, session_count, CASE WHEN event_type = 'purchase' AND session_count >= 3 THEN false ELSE coalesce(switched, false) END AS voiceover FROM s""",
    "ring_samples": f"WITH {_EV}, {_HR}, {_SLEEP} SELECT * FROM hr UNION ALL SELECT * FROM sl",
    "landed_samples": f"WITH {_EV}, {_HR}, {_SLEEP} SELECT * FROM hr UNION ALL SELECT * FROM sl",
    "checked_documents": """WITH d AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 13 AS k FROM events)
      SELECT event_id, CASE WHEN k IN (0, 2, 4) THEN 'unreadable' WHEN k = 1 THEN 'empty' WHEN k = 3 THEN 'no user' END AS reason, CASE WHEN k = 5 THEN event_type END AS device,
        CASE WHEN k >= 5 THEN CAST(CASE WHEN k = 5 THEN 2 ELSE 0 END AS BIGINT) END AS n_rescued, CASE WHEN k >= 5 THEN CAST(1 AS BIGINT) END AS n_readings FROM d""",
    "readiness_samples": f"WITH {_EV}, {_READY} SELECT * FROM rd",
    "fit_samples": f"WITH {_EV} SELECT user_id, 'heart_rate' AS metric_type, value, 'bpm' AS unit, ms AS start_ms, ms + 1000 AS end_ms, 'google_fit' AS source FROM ev WHERE event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND value IS NOT NULL",
    "lookback_samples": f"""WITH {_VENDOR}, n AS (SELECT (max(ms) // {DAY_MS} - 1) AS day FROM ev)
        SELECT vs.* FROM vs, n WHERE CASE WHEN metric_type = 'heart_rate' THEN start_ms BETWEEN day * {DAY_MS} + {8 * HOUR_MS} AND day * {DAY_MS} + {12 * HOUR_MS} ELSE start_ms // {DAY_MS} BETWEEN day - 2 AND day END""",
    "sync_summary": f"WITH {_VENDOR} SELECT 'oura' AS source, count(*) AS samples_pushed, CAST(NULL AS VARCHAR) AS error FROM vs UNION ALL SELECT 'google_fit', 0, 'No token found'",
    "sync_requests": "SELECT event_id, (event_id % 3 = 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0) AS synced FROM events",
    "connected_sources": f"""WITH {_EV}, r AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'signup' AND k < 10 THEN 'oura' WHEN event_type = 'purchase' AND k % 9 = 0 THEN 'google_fit' END AS source FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))
        SELECT u.user_id, s.source, CASE WHEN r.source IS NULL THEN 'not_connected' ELSE 'connected' END AS status FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN (VALUES ('oura'), ('google_fit'), ('apple_watch')) s(source) LEFT JOIN r ON r.user_id = u.user_id AND r.source = s.source""",
    "upserted_samples": f"WITH {_EV} SELECT user_id, metric_type, max(CASE WHEN user_id % 6 = 1 THEN -value ELSE value END) AS value, unit, ms AS start_ms, ms AS end_ms, 'events' AS source FROM ev WHERE value IS NOT NULL GROUP BY user_id, metric_type, unit, ts, ms",
    "sync_statuses": f"WITH {_VENDOR} SELECT 'oura' AS source, count(*) AS samples_pushed, false AS failed FROM vs UNION ALL SELECT 'google_fit', 0, true UNION ALL SELECT 'apple_watch', 0, true",
    "device_rules": f"""WITH d AS (SELECT event_id, {_pick(DEVICES)} AS device, {_pick(KINDS)} AS kind, {_pick(PRACTICES)} AS practice, {_pick(('a|1|peak|x', 'b|2|burnout|y|z', 'c|3', ''))} AS line FROM events)
        SELECT event_id, coalesce(len(list_filter([{', '.join(map(_text, dims.BUILTIN_SPEAKERS))}], lambda s: contains(lower(trim(device)), s))) = 0 AND device IS NOT NULL, false) AS headphones,
          (coalesce(regexp_matches(kind, '{dims.HEADPHONE_KINDS}'), false) OR coalesce(regexp_matches(device, '{dims.HEADPHONE_NAMES}'), false)) AS wireless,
          CASE practice WHEN 'meditation' THEN 'meditation' WHEN 'zhan_zhuang' THEN 'zhanZhuang' ELSE 'breathing' END AS task, coalesce(practice, 'none') AS practice_or_none, coalesce(nullif(practice, ''), 'none') AS practice_or_default,
          split_part(line, '|', 1) AS field_element, split_part(line, '|', 4) AS field_signal FROM d""",
    "token_rules": f"""WITH {_EV}, t AS (SELECT event_id, ms, ms + 1000 * (CASE WHEN event_id % 4 <> 0 THEN (event_id % 4) * 1800 ELSE 86400 END) AS expires_ms FROM ev)
        SELECT event_id, expires_ms, ms + {HOUR_MS} >= expires_ms AS expired FROM t""",
    "request_errors": f"""WITH {_EV}, c AS (SELECT user_id, event_id, ms, CASE WHEN event_id % 9 = 0 THEN 'Invalid element plastic' WHEN event_id % 10 = 0 THEN 'Unknown tool no_such_tool' END AS error, event_id % 9 <> 0 AS counted FROM ev),
        n AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW)
          - (count(*) OVER (PARTITION BY user_id, ms) - row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id)) AS calls_in_window FROM c WHERE counted)
        SELECT c.event_id, error, counted, calls_in_window, calls_in_window > {CALL_LIMIT} AS rejected FROM c LEFT JOIN n ON c.event_id = n.event_id""",
    "valid_elements": f"WITH {_EV} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 <> 1 THEN element END AS element FROM ev",
    "stopped_sessions": f"""WITH {_EV}, b AS (SELECT user_id, ms, CASE event_type WHEN 'purchase' THEN event_id END AS session_no, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS side, event_id FROM ev WHERE event_type IN ('purchase', 'error')),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ms ORDER BY side DESC, event_id DESC) AS r FROM b) WHERE r = 1),
        v AS (SELECT user_id, event_id AS read_id, ms FROM ev WHERE event_type = 'view'),
        j AS (SELECT v.user_id, v.read_id, v.ms, l.session_no, l.ms AS start_ms, l.session_no IS NOT NULL AND v.ms < l.ms + {30 * DAY_MS} AS live FROM v ASOF LEFT JOIN l ON v.user_id = l.user_id AND v.ms >= l.ms)
        SELECT user_id, read_id, CASE WHEN live THEN session_no END AS session_no, CASE WHEN live THEN CAST(floor((ms - start_ms) / 1000.0 + 0.5) AS BIGINT) END AS duration_played FROM j""",
    "user_status": f"""WITH {_EV}, u AS (SELECT DISTINCT user_id FROM ev), n AS (SELECT max(ms) AS now FROM ev),
        l AS (SELECT user_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r FROM ev WHERE event_type = 'purchase') WHERE r = 1 AND user_id % 5 <> 0)
        SELECT u.user_id, 'mock' AS mode, CASE WHEN u.user_id % 4 = 0 THEN 'connected' ELSE 'not_connected' END AS oura, CASE WHEN u.user_id % 4 = 2 THEN 'connected' ELSE 'not_connected' END AS google_fit, 'not_connected' AS apple_watch,
          u.user_id % 3 = 1 AS headphones, u.user_id % 10 AS session_count, true AS voiceover, CASE WHEN l.ms IS NOT NULL THEN {_sess('l.ms')} END AS session_id, CAST(floor((now - l.ms) / 1000.0 + 0.5) AS BIGINT) AS duration_played
        FROM u CROSS JOIN n LEFT JOIN l ON u.user_id = l.user_id""",
    "trend_signals": f"""WITH {_EV}, d AS (SELECT user_id, ms // {DAY_MS} AS day, avg(value) AS value FROM ev WHERE event_type = 'error' GROUP BY 1, 2)
        SELECT user_id, day, round(avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS baseline, round(avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS recent,
          round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(value, day) OVER w END, 6) AS slope FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "mode_selection": "SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 IN (0, 1) THEN 'mock' ELSE 'real' END AS mode FROM events",
    "breathing_text": f"""WITH {_EL}, {_PLANS}, c AS (SELECT pl.*, el.* EXCLUDE (element), 60.0::DOUBLE / bpm AS d FROM pl JOIN el ON pl.element = el.element), n AS (SELECT *, CAST(floor(s / d) AS BIGINT) AS n, {_ROUND1.format(x='d / 3')} AS i, {_ROUND1.format(x='d * 2 / 3')} AS o FROM c)
        SELECT session_id, chr(10) || label || ' · ' || organ || ' — ' || summary || chr(10) || n || ' breathing cycles at ' || CAST(bpm AS BIGINT) || ' BPM' || chr(10) || chr(10)
          || array_to_string(list_transform(range(1, least(n, 6) + 1), lambda k: 'Cycle ' || k || '/' || n || ':' || chr(10) || '  Inhale... (' || i || 's)' || chr(10) || '  Exhale slowly... (' || o || 's)' || chr(10) || chr(10)), '')
          || CASE WHEN n > 6 THEN '  ... (' || (n - 6) || ' more cycles)' || chr(10) || chr(10) ELSE '' END || 'Session complete.' || chr(10) AS script FROM n""",
    "session_offers": f"WITH {_EV}, {_EL} SELECT event_id, {_sess('ms')} AS session_id, 'playing' AS status, 'audio' AS tier, ev.element, genre, CAST(300 AS BIGINT) AS duration_seconds, CAST(6.0 AS DOUBLE) AS breathing_rate_bpm FROM ev JOIN el ON ev.element = el.element WHERE event_type = 'purchase'",
    "samples_normalized": f"WITH {_EV} SELECT user_id, metric_type, value, unit, ms AS start_ms, ms AS end_ms, 'events' AS source FROM ev WHERE value IS NOT NULL",
    "sample_summary": f"WITH {_EV} SELECT 'events' AS source, metric_type, count(*) AS samples_pushed, count(DISTINCT user_id) AS users FROM ev WHERE value IS NOT NULL GROUP BY metric_type",
    "samples_deduped": f"WITH {_EV} SELECT metric_type, count(*) AS n FROM (SELECT DISTINCT user_id, metric_type, ts FROM ev WHERE value IS NOT NULL) GROUP BY metric_type",
    "element_scores": f"WITH {_EV}, {_SC} SELECT * FROM sc",
    "wellness_state": f"WITH {_STATE} SELECT * FROM ws",
    "active_elements": f"WITH {_STATE} SELECT user_id, active_elements, n_active, first_active FROM ws",
    "element_detail": f"WITH {_DETAIL} SELECT * FROM de",
    "element_detail_fire": f"WITH {_DETAIL} SELECT user_id, label, score, activated FROM de WHERE element = 'fire'",
    "time_of_day_bias": f"SELECT event_id, {_bias(' AS yin_bias', -15, -10, 10)}, {_bias(' AS yang_bias', -20, -10, 15)}, {_bias(' AS fire_bias', 20, 0, 0)}, {_bias(' AS earth_bias', 0, 15, -10)} FROM events",
    "hourly_buckets": "SELECT user_id, epoch_us(date_trunc('hour', ts)) // 1000 AS bucket_ms, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE event_type = 'click' GROUP BY 1, 2",
    "rate_limited_calls": f"""WITH {_EV}, c AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW)
        - (count(*) OVER (PARTITION BY user_id, ms) - row_number() OVER (PARTITION BY user_id, ms ORDER BY event_id)) AS calls_in_window FROM ev)
        SELECT user_id, event_id, calls_in_window, calls_in_window > {CALL_LIMIT} AS rejected FROM c""",
    "cooldown_gate": f"WITH RECURSIVE {_gate('user_id', GATE_HOURS * HOUR_MS)} SELECT user_id, event_id, ms FROM g",
    "cache_ttl_hits": f"""WITH RECURSIVE {_EV}, rd AS (SELECT user_id, event_id, ms, event_type = 'error' AS force, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM ev),
        f AS (SELECT user_id, event_id, rn, false AS hit, ms AS last, CAST(0 AS BIGINT) AS cache_age_seconds FROM rd WHERE rn = 1
          UNION ALL SELECT r.user_id, r.event_id, r.rn, NOT (r.force OR r.ms - f.last > {TTL_HOURS * HOUR_MS}), CASE WHEN r.force OR r.ms - f.last > {TTL_HOURS * HOUR_MS} THEN r.ms ELSE f.last END,
            CASE WHEN r.force OR r.ms - f.last > {TTL_HOURS * HOUR_MS} THEN 0 ELSE CAST(floor((r.ms - f.last) / 1000.0 + 0.5) AS BIGINT) END
          FROM f JOIN rd r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
        SELECT user_id, event_id, hit, cache_age_seconds FROM f""",
    "ambient_gate": f"WITH RECURSIVE {_gate('user_id, element', GATE_HOURS * HOUR_MS)} SELECT t.element, t.triggers, a.accepted FROM (SELECT element, count(*) AS triggers FROM ev GROUP BY element) t JOIN (SELECT element, count(*) AS accepted FROM g GROUP BY element) a ON t.element = a.element",
    "stress_cycle": f"WITH {_EV}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS call_no FROM ev) SELECT user_id, event_id, call_no, (call_no = 1 OR call_no % 3 = 0) AS stressed FROM n",
    "session_history_limit": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, session_no) AS rank FROM lg) SELECT user_id, rank, session_id, element, tier, duration_seconds FROM r WHERE rank <= 5",
    "session_history_days": f"WITH {_LOG} SELECT user_id, session_id, element, tier, duration_seconds FROM lg WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL {HISTORY_DAYS} DAY",
    "session_result": f"WITH {_STATE}, {_LOG} SELECT session_id, lg.user_id, lg.element, duration_seconds, quadrant AS post_quadrant, top_element AS post_top_element FROM lg LEFT JOIN ws ON lg.user_id = ws.user_id",
    "session_identifiers": f"WITH {_EV} SELECT event_id, {_sess('ms')} AS session_id FROM ev",
    "voiceover_state": f"""WITH {_EV}, s AS (SELECT user_id, event_id, event_type, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_count
        FROM ev WHERE event_type IN ('purchase', 'signup')) SELECT user_id, event_id, session_count, (event_type = 'signup' OR session_count < 3) AS voiceover FROM s""",
    "request_replay": f"WITH RECURSIVE {_EV}, {_REPLAY} SELECT user_id, ms, request_id, tool, error, status, calls_left, cache_age_seconds, synced, state_no, session_no, session_mode, duration_played, remaining_minutes, {_KEEP}, nct AS session_count FROM fo WHERE rn > 0",
    "guard_decision": f"WITH RECURSIVE {_GUARD} SELECT user_id, request_id, mode, status, remaining_minutes FROM fold WHERE rn > 0",
    "active_sessions": f"""WITH RECURSIVE {_GUARD}, s AS (SELECT * FROM fold WHERE status = 'playing'), v AS (SELECT user_id, event_id AS read_id, ms FROM ev WHERE event_type = 'view'),
        j AS (SELECT v.user_id, v.read_id, v.ms, s.request_id, s.mode, s.ms AS start_ms, v.ms < s.ms + {SESSION_HOURS * HOUR_MS} AS live FROM v ASOF LEFT JOIN s ON v.user_id = s.user_id AND v.ms >= s.ms)
        SELECT user_id, read_id, CASE WHEN live THEN request_id END AS session_no, CASE WHEN live THEN mode END AS mode, CASE WHEN live THEN CAST(floor((ms - start_ms) / 1000.0 + 0.5) AS BIGINT) END AS duration_played FROM j""",
    "before_after": f"""WITH {_EV}, p AS (SELECT user_id, event_id, ms FROM ev WHERE event_type = 'purchase'), v AS (SELECT user_id, ms, value FROM ev WHERE event_type = 'view'),
        b AS (SELECT p.*, v.value AS value_before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ms > v.ms),
        a AS (SELECT b.*, v.value AS value_after FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ms < v.ms)
        SELECT user_id, event_id, value_before, value_after, CASE WHEN value_before <> 0 THEN CAST(floor(100 * (value_after - value_before) / value_before + 0.5) AS BIGINT) END AS change_pct FROM a""",
    "breathing_script": f"""WITH {_PLANS}, c AS (SELECT session_id, element, 60.0::DOUBLE / bpm AS d, s FROM pl), n AS (SELECT *, CAST(floor(s / d) AS BIGINT) AS cycles FROM c)
        SELECT session_id, element, cycles, g.generate_series AS cycle, d / 3 AS inhale_seconds, d * 2 / 3 AS exhale_seconds, CAST(greatest(cycles - 6, 0) AS BIGINT) AS more_cycles FROM n, generate_series(1, 6) g WHERE g.generate_series <= cycles""",
    "preferences_merged": """WITH u AS (SELECT DISTINCT o_custkey AS user_id FROM orders)
        SELECT user_id, CASE WHEN user_id % 5 <> 0 AND user_id % 7 = 0 THEN true WHEN user_id % 2 = 0 THEN user_id % 3 = 0 ELSE false END AS ambient_optin,
          CASE WHEN user_id % 5 <> 0 AND user_id % 7 = 0 THEN '1998-01-01T00:00:00Z' END AS ambient_optin_date,
          CASE WHEN user_id % 5 <> 0 THEN greatest(0.0, least(1.0, user_id / 100.0::DOUBLE)) ELSE 0.3::DOUBLE END AS preferred_volume,
          CAST(CASE WHEN user_id % 5 <> 0 THEN greatest(1, least(1440, user_id - 50)) WHEN user_id % 2 = 0 THEN 45 ELSE 30 END AS BIGINT) AS cooldown_minutes,
          (user_id % 5 <> 0 AND user_id % 4 = 0) AS disabled, false AS headphones_trusted, CAST(CASE WHEN user_id % 2 = 0 THEN user_id % 10 ELSE 0 END AS BIGINT) AS session_count, true AS voiceover
        FROM u WHERE user_id % 2 = 0 OR user_id % 5 <> 0""",
    "synthetic_state": f"WITH {_SYN}, fi AS (SELECT event_id, stressed, yin, yang, {_LIFTS} FROM bo) SELECT *, {_QUADRANT} AS quadrant FROM fi",
    "synthetic_history": f"""WITH u AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, {_draw('user_id', 'count', '3', '14')} AS n FROM u),
        i AS (SELECT user_id, g.generate_series AS i, user_id || '/' || g.generate_series AS k FROM c, generate_series(0, 13) g WHERE g.generate_series < n)
        SELECT user_id, 'sess_hist_' || i AS session_id, strftime(DATE '{AS_OF.date()}' - CAST({_draw('k', 'day', '0', '6')} AS INTEGER), '%Y-%m-%d') AS day,
          (['wood', 'fire', 'earth', 'metal', 'water'])[{_draw('k', 'element', '0', '4')} + 1] AS element, 'audio' AS tier, CAST(300 AS BIGINT) AS duration_seconds, CAST({_draw('k', 'change', '10', '55')} AS BIGINT) AS hrv_change_pct FROM i""",
    "stop_sessions": f"""WITH {_EV}, l AS (SELECT user_id, ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r FROM ev WHERE event_type = 'purchase') WHERE r = 1 AND user_id % 3 <> 0),
        s AS (SELECT user_id, max(ms) + {24 * HOUR_MS} AS stop_ms FROM ev GROUP BY user_id), j AS (SELECT s.user_id, l.ms, CAST(floor((stop_ms - l.ms) / 1000.0 + 0.5) AS BIGINT) AS p FROM s LEFT JOIN l ON s.user_id = l.user_id)
        SELECT user_id, CASE WHEN ms IS NULL THEN 'no_active_session' ELSE 'stopped' END AS status, CASE WHEN ms IS NOT NULL THEN {_sess('ms')} END AS session_id, p AS duration_played, CAST(floor(p / 60.0 + 0.5) AS BIGINT) AS minutes_played FROM j""",
    "state_json_fields": f"WITH {_STATE} SELECT user_id, quadrant, yin FROM ws",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
