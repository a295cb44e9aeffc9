"""Shared SQL for the oracles, written independently of the operators.

Minute values are computed the plain way: every record is expanded to seconds, seconds are averaged over
records, and minutes over seconds.
"""

from __future__ import annotations

import re

from daygrid import constants as C


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


UNITS = ["m", "ft", "km", "mi", "cm", "in", "lb", "g", "mph", "fl_oz", "cal", "count/s"]

CTES: dict[str, str] = {}

CTES["ev"] = """
SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, ts,
  CASE event_id % 10 WHEN 6 THEN 'workout' WHEN 7 THEN 'sleep' WHEN 8 THEN 'motion' WHEN 9 THEN 'motion'
    ELSE 'healthkit' END AS modality,
  CASE WHEN event_id % 11 = 0 THEN 'HKQuantityTypeIdentifierAppleStandTime'
    WHEN event_type = 'click' THEN 'HKQuantityTypeIdentifierStepCount'
    WHEN event_type = 'view' THEN 'HKQuantityTypeIdentifierDistanceWalkingRunning'
    WHEN event_type = 'purchase' THEN 'HKQuantityTypeIdentifierActiveEnergyBurned'
    WHEN event_type = 'signup' THEN 'HKQuantityTypeIdentifierDistanceCycling'
    ELSE 'HKQuantityTypeIdentifierHeartRate' END AS qtype,
  CAST(CASE WHEN event_id % 101 = 0 THEN -10 WHEN event_id % 103 = 0 THEN 90000
    WHEN event_id % 17 = 0 THEN 20000 WHEN event_id % 7 = 1 THEN 0 ELSE floor(value * 60) END AS BIGINT) AS dur,
  CAST(((event_id % 7) - 3) * 60 AS INTEGER) AS so
FROM events"""

CTES["rec"] = f"""
SELECT user_id AS participant_id, event_id AS record_id, modality,
  CASE WHEN modality = 'healthkit' THEN qtype WHEN modality = 'sleep' THEN '{C.SLEEP_TYPE}' END AS type,
  CASE WHEN modality = 'sleep' THEN {_list(C.SLEEP_CATEGORIES)}[(event_id // 10) % 2 + 1] END AS category,
  CASE WHEN modality = 'workout' THEN {_list(C.WORKOUT_TYPES)}[(event_id // 10) % 10 + 1] END AS workout_type,
  CASE WHEN modality = 'motion' THEN {_list(C.MOTION_ACTIVITIES)}[event_id % 6 + 1] END AS activity,
  us AS start_us, us + dur * 1000000 AS end_us, so AS start_offset,
  CAST(so + CASE WHEN event_id % 53 = 0 THEN 60 ELSE 0 END AS INTEGER) AS end_offset,
  CASE WHEN modality = 'sleep' THEN CAST(dur AS DOUBLE)
    WHEN modality = 'motion' THEN NULL
    WHEN modality = 'healthkit' AND qtype = '{C.STAND_TIME}' THEN (event_id % 40) * 1e-3
    WHEN modality = 'healthkit' AND qtype = '{C.HEART_RATE}' THEN 3e-1 + (event_id % 400) * 1e-2
    WHEN modality = 'healthkit' AND event_id % 17 = 0 THEN 0
    ELSE greatest(dur, 1) * ((event_id * 7919) % 3000 - 100) / 1e2 END AS value,
  CASE WHEN modality = 'motion' THEN ((event_id // 6) % 4) * 1e-1 END AS confidence,
  {_list(UNITS)}[event_id % 12 + 1] AS unit, event_type AS source,
  CASE WHEN event_id % 4 = 0 THEN 'org.other.' ELSE 'com.apple.health.' END || event_type AS source_identifier,
  CAST(event_id % 3 AS VARCHAR) AS app_version
FROM ev"""

CTES["std"] = """
SELECT * REPLACE (
  CASE WHEN modality <> 'healthkit' THEN value ELSE value * CASE unit WHEN 'ft' THEN 0.3048e0
    WHEN 'in' THEN 0.0254e0 WHEN 'cm' THEN 0.01e0 WHEN 'km' THEN 1e3 WHEN 'mi' THEN 1609.34e0
    WHEN 'lb' THEN 0.45359237e0 WHEN 'g' THEN 0.001e0 WHEN 'mph' THEN 0.44704e0
    WHEN 'fl_oz' THEN 0.0295735e0 ELSE 1e0 END END AS value,
  CASE WHEN modality <> 'healthkit' THEN unit WHEN unit IN ('ft','in','cm','km','mi') THEN 'm'
    WHEN unit IN ('lb','g') THEN 'kg' WHEN unit = 'mph' THEN 'm/s' WHEN unit = 'fl_oz' THEN 'L'
    ELSE unit END AS unit)
FROM rec"""

# Whether a quantity record passes the rule of its own type.
TYPE_OK = f"""CASE type
    WHEN '{C.STEP_COUNT}' THEN value >= 0 AND d <> 0 AND value / nullif(d, 0) <= 5
    WHEN '{C.ACTIVE_ENERGY}' THEN d > 0 AND value >= 0 AND value / nullif(d, 0) <= 250
    WHEN '{C.DISTANCE_WALKING_RUNNING}' THEN value >= 0 AND d <> 0 AND value / nullif(d, 0) <= 10
    WHEN '{C.DISTANCE_CYCLING}' THEN value >= 0 AND d <> 0 AND value / nullif(d, 0) <= 25
    WHEN '{C.STAND_TIME}' THEN value * 60 >= 0 AND value * 60 <= 1 AND d <> 0 AND value * 60 / nullif(d, 0) <= 1
    WHEN '{C.HEART_RATE}' THEN value >= 40e0 / 60 AND value <= 200e0 / 60
    ELSE true END"""

CTES["timed"] = """
SELECT *, (end_us // 1000000) - (start_us // 1000000) AS d FROM std"""

CTES["clean"] = f"""
SELECT * FROM timed
WHERE end_us >= start_us AND end_us - start_us <= 86400000000
  AND (modality = 'motion' OR start_offset = end_offset)
  AND (modality <> 'healthkit' OR coalesce({TYPE_OK}, false))"""

CTES["loc"] = """
SELECT * REPLACE (start_us + start_offset * 60000000::BIGINT AS start_us,
  CASE modality WHEN 'motion' THEN end_us + start_offset * 60000000::BIGINT
    WHEN 'sleep' THEN start_us + start_offset * 60000000::BIGINT + CAST(round(value * 1e6) AS BIGINT)
    ELSE end_us + end_offset * 60000000::BIGINT END AS end_us)
FROM clean"""

CTES["locd"] = """
SELECT *, DATE '1970-01-01' + CAST(start_us // 86400000000 AS INTEGER) AS date FROM loc"""

CTES["cut"] = """
SELECT *, (start_us // 86400000000) <> (end_us // 86400000000) AS crosses,
  (end_us // 86400000000) * 86400000000 AS midnight FROM loc"""

CTES["parts"] = f"""
SELECT *, DATE '1970-01-01' + CAST(start_us // 86400000000 AS INTEGER) AS date,
  list_position({_list(C.CHANNELS)}, coalesce(CASE WHEN modality = 'healthkit' THEN type END,
     workout_type, category, activity)) - 1 AS channel_idx
FROM (
  SELECT participant_id, record_id, modality, type, category, workout_type, activity, start_offset,
    end_offset, confidence, unit, source, 0 AS part, start_us, end_us, value FROM cut WHERE NOT crosses
  UNION ALL
  SELECT participant_id, record_id, modality, type, category, workout_type, activity, start_offset,
    end_offset, confidence, unit, source, 0, start_us, midnight - 2000000,
    CASE WHEN modality = 'sleep' THEN (midnight - 2000000 - start_us) / 1e6
      WHEN type = '{C.HEART_RATE}' THEN value
      WHEN end_us > start_us THEN value * greatest(0, least(1, (midnight - 2000000 - start_us) / CAST(end_us - start_us AS DOUBLE)))
      ELSE 0 END FROM cut WHERE crosses
  UNION ALL
  SELECT participant_id, record_id, modality, type, category, workout_type, activity, start_offset,
    end_offset, confidence, unit, source, 1, midnight, end_us,
    CASE WHEN modality = 'sleep' THEN (end_us - midnight) / 1e6
      WHEN type = '{C.HEART_RATE}' THEN value
      WHEN end_us > start_us THEN value * greatest(0, least(1, (end_us - midnight) / CAST(end_us - start_us AS DOUBLE)))
      ELSE 0 END FROM cut WHERE crosses)"""

CTES["iv"] = f"""
SELECT participant_id, date, channel_idx, modality,
  CAST((start_us % 86400000000) // 1000000 AS BIGINT) AS s,
  least(86400, CAST((start_us % 86400000000) // 1000000 AS BIGINT) +
    CASE WHEN type = '{C.HEART_RATE}' AND end_us = start_us THEN 1
      ELSE CAST(trunc((end_us - start_us) / 1e6) AS BIGINT) END) AS e,
  CASE WHEN modality = 'motion' THEN confidence WHEN type = '{C.HEART_RATE}' THEN value
    WHEN end_us <> start_us THEN value / ((end_us - start_us) / 1e6) END AS v
FROM parts WHERE modality IN ('healthkit', 'motion') AND end_us >= start_us AND channel_idx IS NOT NULL"""

CTES["sec"] = """
SELECT participant_id, date, channel_idx, modality, sec, avg(v) AS v FROM (
  SELECT participant_id, date, channel_idx, modality, v, unnest(range(s, e)) AS sec FROM iv
  WHERE s < e AND v IS NOT NULL) GROUP BY ALL"""

CTES["flags"] = """
SELECT DISTINCT participant_id, date, channel_idx, modality, unnest(range(
    (start_us % 86400000000) // 60000000,
    least(1440, CAST(ceil((end_us - (start_us // 86400000000) * 86400000000) / 6e7) AS BIGINT)))) AS minute
FROM parts WHERE modality IN ('sleep', 'workout') AND end_us >= start_us AND channel_idx IS NOT NULL"""

CTES["allmin"] = """
SELECT participant_id, date, channel_idx, modality, CAST(sec // 60 AS INTEGER) AS minute, avg(v) AS value
FROM sec GROUP BY ALL
UNION ALL
SELECT participant_id, date, channel_idx, modality, CAST(minute AS INTEGER), 1e0 FROM flags"""

CTES["days"] = """
SELECT participant_id, date, start_offset AS original_time_offset FROM parts WHERE modality = 'healthkit'
QUALIFY row_number() OVER (PARTITION BY participant_id, date ORDER BY start_us, start_offset) = 1"""

CTES["minutes"] = """
SELECT m.* FROM allmin m SEMI JOIN days USING (participant_id, date)"""

CTES["present"] = """
SELECT participant_id, date, list(DISTINCT channel_idx) AS channels, bool_or(modality = 'sleep') AS has_sleep
FROM parts GROUP BY ALL"""

CTES["chanday"] = f"""
SELECT d.participant_id, d.date, c.channel_idx,
  CASE WHEN c.channel_idx >= 18 THEN false WHEN c.channel_idx >= 16 THEN p.has_sleep
    ELSE list_contains(p.channels, c.channel_idx) END AS zero_fill
FROM days d JOIN present p USING (participant_id, date),
  (SELECT unnest(range(0, {C.N_CHANNELS})) AS channel_idx) c"""

CTES["stats"] = """
SELECT c.participant_id, c.date, CAST(c.channel_idx AS INTEGER) AS feature_index,
  count(m.value) * 1e2 / 1440 AS data_coverage, CAST(count(m.value) AS DOUBLE) AS n,
  coalesce(sum(m.value), 0) AS sum, coalesce(sum(m.value * m.value), 0) AS sum_of_squares,
  any_value(d.original_time_offset) AS original_time_offset
FROM chanday c JOIN days d USING (participant_id, date)
LEFT JOIN (SELECT * FROM minutes WHERE value <> 0) m
  ON m.participant_id = c.participant_id AND m.date = c.date AND m.channel_idx = c.channel_idx
GROUP BY c.participant_id, c.date, c.channel_idx"""

CTES["summary"] = """
SELECT participant_id, date, sum(data_coverage) AS data_coverage_sum, avg(data_coverage) AS data_coverage_mean,
  count(*) FILTER (data_coverage > 0) AS n_above_zero FROM stats GROUP BY ALL"""

CTES["quality"] = """
SELECT participant_id, date, data_coverage_sum AS total_coverage, n_above_zero AS channels_with_data,
  data_coverage_sum >= 0.1 AND n_above_zero >= 1 AS valid FROM summary"""

CTES["vdays"] = """
SELECT participant_id, date, row_number() OVER (PARTITION BY participant_id ORDER BY date) AS i,
  min(date) OVER (PARTITION BY participant_id) AS first_day,
  max(date) OVER (PARTITION BY participant_id) AS last_day FROM quality WHERE valid"""

CTES["bounds"] = """
SELECT participant_id, min(date) AS first_day, max(date) AS last_day FROM quality WHERE valid GROUP BY ALL"""

# Every calendar day on which a window of seven days with five valid ones may start.
CTES["cand"] = """
SELECT b.participant_id, c.day AS start_day, count(v.date) >= 5 AS ok
FROM (SELECT participant_id, last_day,
        unnest(generate_series(first_day, last_day - 6, INTERVAL 1 DAY))::DATE AS day FROM bounds) c
JOIN bounds b USING (participant_id)
LEFT JOIN (SELECT participant_id, date FROM quality WHERE valid) v
  ON v.participant_id = b.participant_id AND v.date BETWEEN c.day AND c.day + 6
GROUP BY b.participant_id, c.day"""

CTES["walk"] = """
SELECT participant_id, min(start_day) AS start_day FROM cand WHERE ok GROUP BY participant_id
UNION ALL
SELECT w.participant_id, (SELECT min(c.start_day) FROM cand c WHERE c.ok
   AND c.participant_id = w.participant_id AND c.start_day > w.start_day + 6) AS start_day
FROM walk w WHERE w.start_day IS NOT NULL"""

CTES["win"] = """
SELECT w.participant_id, w.start_day AS start_date, w.start_day + 6 AS end_date, list(q.date ORDER BY q.date) AS days
FROM walk w JOIN quality q ON q.participant_id = w.participant_id AND q.date BETWEEN w.start_day AND w.start_day + 6
WHERE w.start_day IS NOT NULL GROUP BY w.participant_id, w.start_day"""

CTES["answers0"] = """
SELECT user_id AS participant_id, ts AS created_on, event_id AS seq,
  CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS sleep_diagnosis1,
  CASE WHEN event_id % 4 <> 3 THEN CAST(event_id % 11 AS DOUBLE) END AS happiness,
  CASE event_id % 3 WHEN 0 THEN '[1. 10.]' WHEN 1 THEN '[]' END AS heart_disease,
  CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 10 AS DOUBLE) END AS feel_worthwhile1,
  CASE WHEN event_id % 6 <> 0 THEN (event_id % 9) + 5e-1 END AS feel_worthwhile2,
  CASE WHEN user_id % 3 <> 0 THEN CAST(event_id % 11 AS DOUBLE) END AS feel_worthwhile3,
  CASE WHEN user_id % 4 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS "Diabetes",
  CASE WHEN user_id % 5 = 0 THEN CAST(event_id % 2 AS DOUBLE) END AS "Hypertension"
FROM events WHERE event_type = 'purchase'"""

CTES["lab0"] = """
SELECT participant_id, created_on, seq, CASE WHEN participant_id % 13 <> 4 THEN sleep_diagnosis1 END AS sleep_diagnosis1,
  CASE WHEN participant_id % 13 <> 4 THEN happiness END AS happiness,
  CASE WHEN participant_id % 13 <> 4 THEN heart_disease END AS heart_disease,
  CASE WHEN participant_id % 13 <> 4 THEN feel_worthwhile1 END AS feel_worthwhile1,
  CASE WHEN participant_id % 13 <> 4 THEN feel_worthwhile2 END AS feel_worthwhile2,
  CASE WHEN participant_id % 13 <> 4 THEN feel_worthwhile3 END AS feel_worthwhile3,
  CASE WHEN participant_id % 13 <> 4 THEN "Diabetes" END AS "Diabetes",
  CASE WHEN participant_id % 13 <> 4 THEN "Hypertension" END AS "Hypertension"
FROM answers0"""

_SCALAR_LABELS = [c for c in C.LABELS if c not in C.LIST_LABELS]
CTES["lab"] = (
    " UNION ALL ".join(
        f"""SELECT participant_id, created_on, seq, 0 AS pos, '{c}' AS label, trunc("{c}") AS value
FROM lab0 WHERE "{c}" IS NOT NULL"""
        for c in _SCALAR_LABELS
    )
    + """
UNION ALL SELECT participant_id, created_on, seq, 0, 'heart_disease', 1e0 FROM lab0 WHERE heart_disease = '[1. 10.]'
UNION ALL SELECT participant_id, created_on, seq, 1, 'heart_disease', 1e1 FROM lab0 WHERE heart_disease = '[1. 10.]'"""
)

# Distances in half days; on equal distance the earlier date; first answer of a date at or after the
# midpoint, last answer before it.
CTES["match"] = """
SELECT w.participant_id, w.start_date, w.end_date, l.label, l.value AS label_value, l.created_on AS label_date
FROM (SELECT DISTINCT participant_id, start_date, end_date,
        (start_date - DATE '1970-01-01') + (end_date - DATE '1970-01-01') AS mid FROM win) w
JOIN (SELECT *, 2 * (created_on::DATE - DATE '1970-01-01') AS pos2 FROM lab) l USING (participant_id)
QUALIFY row_number() OVER (PARTITION BY w.participant_id, w.start_date, l.label
  ORDER BY abs(l.pos2 - w.mid), l.pos2, CASE WHEN l.pos2 >= w.mid THEN l.seq ELSE -l.seq END,
    CASE WHEN l.pos2 >= w.mid THEN l.pos ELSE -l.pos END) = 1"""

CTES["flat"] = (
    "SELECT w.participant_id, w.start_date, w.end_date, w.days, "
    + ", ".join(
        f"max(CASE WHEN m.label = '{c}' THEN m.label_value END) AS \"{c}_value\", "
        f"max(CASE WHEN m.label = '{c}' THEN m.label_date END) AS \"{c}_date\""
        for c in C.LABELS
    )
    + """ FROM win w LEFT JOIN match m ON m.participant_id = w.participant_id AND m.start_date = w.start_date
GROUP BY w.participant_id, w.start_date, w.end_date, w.days"""
)

CTES["demo"] = """
SELECT *, 0 AS row_no FROM (SELECT c_custkey AS participant_id,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Male'
      WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'Female' END AS biological_sex,
    50e0 + c_acctbal / 200 AS weight_kg,
    CASE WHEN c_custkey % 8 <> 0 THEN 145e0 + (c_custkey * 7) % 65 END AS height_cm
  FROM customer WHERE c_custkey % 6 <> 0)
UNION ALL
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Male'
      WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 'Female' END, NULL, NULL, 1
  FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 9 = 0"""

CTES["demo1"] = "SELECT participant_id, biological_sex, weight_kg, height_cm FROM demo WHERE row_no = 0"

CTES["info"] = """
SELECT c_custkey AS participant_id,
  CASE WHEN c_custkey % 20 = 19 THEN 'not a date'
    ELSE strftime(DATE '1950-01-01' + CAST((c_custkey * 97) % 18000 AS INTEGER), '%Y-%m-%d') END AS birthdate,
  '2024-01-01 06:00:00' AS created_on,
  CASE WHEN c_custkey % 3 = 0 THEN 'sponsors_and_partners' ELSE 'all_qualified_researchers' END AS sharing_scope
FROM customer"""

CTES["ages"] = """
SELECT participant_id, sharing_scope,
  CAST(round_even((DATE '2024-01-01' - try_cast(birthdate AS DATE)) / 365.25e0, 0) AS INTEGER) AS age FROM info"""

CTES["pred"] = """
SELECT *, lag(y) OVER (PARTITION BY sample_id, channel_idx ORDER BY day_index, hour) AS yhat,
  CASE WHEN sample_id % 5 <> hour % 5 THEN 1 ELSE 0 END AS mask
FROM (SELECT user_id AS sample_id,
    CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INTEGER) AS channel_idx,
    CAST(ts::DATE - DATE '2024-01-01' AS INTEGER) AS day_index, CAST(hour(ts) AS INTEGER) AS hour,
    round(sum(value), 2) AS y
  FROM events GROUP BY ALL)"""

CTES["vec"] = """
SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS i,
  CASE WHEN abs(embedding[i]) < 0.06e0 THEN 0e0 ELSE CAST(embedding[i] AS DOUBLE) END AS v,
  CASE WHEN (i - 1 + vec_id) % 9 = 0 THEN 0 ELSE 1 END AS m
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""

# Long form of window samples: dense minutes of every expected day and channel.
CTES["wdays"] = """
SELECT participant_id, start_date, end_date, CAST(k AS INTEGER) AS day_index, start_date + CAST(k AS INTEGER) AS date
FROM (SELECT *, unnest(range(0, 7)) AS k FROM win)"""

CTES["wmin"] = """
SELECT w.participant_id, w.start_date, w.day_index, w.date, m.channel_idx, m.minute, m.value
FROM wdays w JOIN minutes m ON m.participant_id = w.participant_id AND m.date = w.date"""

CTES["sp"] = (
    "SELECT participant_id, "
    + " + ".join(f'CAST(bool_or("{c}_value" IS NOT NULL) AS INTEGER)' for c in C.LABELS)
    + " AS label_count FROM flat GROUP BY participant_id"
)

CTES["edges"] = """
SELECT DISTINCT e FROM (SELECT unnest(quantile_cont(label_count, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM sp)"""

CTES["bins"] = """
SELECT participant_id, label_count, CAST(CASE WHEN (SELECT count(*) FROM edges) < 2 THEN label_count ELSE
  (SELECT count(*) FROM edges WHERE e < label_count AND e > (SELECT min(e) FROM edges)
    AND e < (SELECT max(e) FROM edges)) END AS INTEGER) AS stratum FROM sp"""

CTES["assigned"] = """
SELECT participant_id, label_count, CASE WHEN
  row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || participant_id), participant_id)
  <= round(count(*) OVER (PARTITION BY stratum) * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM bins"""

CTES["edges2"] = """
SELECT DISTINCT e FROM (SELECT unnest(quantile_cont(label_count, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e
  FROM assigned WHERE split = 'train')"""

CTES["bins2"] = """
SELECT participant_id, CASE WHEN (SELECT count(*) FROM edges2) < 2 THEN label_count ELSE
  (SELECT count(*) FROM edges2 WHERE e < label_count AND e > (SELECT min(e) FROM edges2)
    AND e < (SELECT max(e) FROM edges2)) END AS stratum FROM assigned WHERE split = 'train'"""


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the CTEs it uses, directly or indirectly, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b(?:FROM|JOIN|SEMI JOIN|ANTI JOIN)\s+([a-z_0-9]+)", todo.pop()))
        for name in words & set(CTES) - needed:
            needed.add(name)
            todo.append(CTES[name])
    if not needed:
        return body
    ordered = [n for n in CTES if n in needed]
    clauses = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    return f"WITH RECURSIVE {clauses}\n{body}"


def rd(expression: str, digits: int = 6) -> str:
    """Rounded as in ``registry.rounded``."""
    return f"round(({expression}) + {1.3 * 10.0 ** -(digits + 3)!r}, {digits})"
