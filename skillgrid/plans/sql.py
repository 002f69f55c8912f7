"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

MODEL = """model AS (SELECT * FROM (VALUES ('gfs', 'GFS', 1, 14, true), ('nbm', 'NBM', 1, 11, false)) t(model, label, lead_min, lead_max, is_default)),
win AS (SELECT * FROM (VALUES ('gfs', 1, 7, '1_7'), ('gfs', 7, 14, '7_14'), ('gfs', 1, 10, '1_10'), ('nbm', 1, 7, '1_7'), ('nbm', 7, 11, '7_11'), ('nbm', 1, 10, '1_10')) t(model, s, e, lead_key)),
leads AS (SELECT model, unnest(generate_series(lead_min, lead_max))::INT AS lead FROM model)"""
OBS = "obs AS (SELECT CAST(l_shipdate AS DATE) AS valid_date, CAST(l_suppkey % 24 AS INT) AS cell_id, CAST(sum(l_quantity) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2)"
BASE = """base AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'gfs' ELSE 'nbm' END AS model, CAST(o_orderdate AS DATE) AS init_date, CAST(l_suppkey % 24 AS INT) AS cell_id, CAST(sum(l_quantity) AS DOUBLE) AS fv
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""
FC = f"{MODEL}, {BASE}, fc AS (SELECT model, init_date, lead, cell_id, fv + lead AS m, CAST(init_date + lead AS DATE) AS valid_date FROM base JOIN leads USING (model))"
PAIRS = f"{OBS}, {FC}, pairs AS (SELECT fc.*, o FROM fc JOIN obs USING (valid_date, cell_id))"
SUMS = ["n", "sum_error", "sum_abs_error", "sum_squared_error", "sum_model", "sum_obs", "sum_model_sq", "sum_obs_sq", "sum_cross"]
ADD = ", ".join(f"CAST(sum({c}) AS {'BIGINT' if c == 'n' else 'DOUBLE'}) AS {c}" for c in SUMS)
ACC = f"""{PAIRS}, acc AS (SELECT model, CAST(month(valid_date) AS INT) AS month, lead, cell_id, count(*) AS n, sum(m - o) AS sum_error, sum(abs(m - o)) AS sum_abs_error, sum((m - o) * (m - o)) AS sum_squared_error,
  sum(m) AS sum_model, sum(o) AS sum_obs, sum(m * m) AS sum_model_sq, sum(o * o) AS sum_obs_sq, sum(m * o) AS sum_cross FROM pairs GROUP BY ALL)"""
SEASON = "CASE WHEN month IN (12, 1, 2) THEN 'djf' WHEN month IN (3, 4, 5) THEN 'mam' WHEN month IN (6, 7, 8) THEN 'jja' ELSE 'son' END"
PERIOD = f"""{ACC}, each AS (SELECT 'monthly' AS period, lpad(CAST(month AS VARCHAR), 2, '0') AS period_key, * FROM acc UNION ALL SELECT 'seasonal', {SEASON}, * FROM acc UNION ALL SELECT 'yearly', '', * FROM acc),
per AS (SELECT model, period, period_key, lead, cell_id, {ADD} FROM each GROUP BY ALL)"""
WINDOW = f"""{PERIOD}, inwin AS (SELECT per.*, win.lead_key, e - s + 1 AS wanted FROM per JOIN win ON per.model = win.model AND lead BETWEEN s AND e),
whole AS (SELECT model, period, period_key, lead_key FROM inwin GROUP BY ALL HAVING count(DISTINCT lead) = any_value(wanted)),
bywin AS (SELECT model, period, period_key, lead_key, cell_id, {ADD} FROM inwin SEMI JOIN whole USING (model, period, period_key, lead_key) GROUP BY ALL)"""
# GROUP BY ALL would group the wanted column too; name the keys where an aggregate uses it.
WINDOW = WINDOW.replace("FROM inwin GROUP BY ALL HAVING", "FROM inwin GROUP BY model, period, period_key, lead_key HAVING")
VALUE = {
    "bias": "sum_error / n",
    "sacc": """CASE WHEN n > 1 AND sqrt(greatest(n::DOUBLE * sum_model_sq - sum_model * sum_model, 0.0e0) * greatest(n::DOUBLE * sum_obs_sq - sum_obs * sum_obs, 0.0e0)) > 1e-10
      THEN least(greatest((n::DOUBLE * sum_cross - sum_model * sum_obs) / sqrt(greatest(n::DOUBLE * sum_model_sq - sum_model * sum_model, 0.0e0) * greatest(n::DOUBLE * sum_obs_sq - sum_obs * sum_obs, 0.0e0)) * 100.0e0, -100.0e0), 100.0e0) END""",
    "nrmse": "sqrt(sum_squared_error / n::DOUBLE) / (sum_obs / n::DOUBLE + 1e-10) * 100.0e0",
    "nmad": "sum_abs_error / n::DOUBLE / (sum_obs / n::DOUBLE + 1e-10) * 100.0e0",
}


def finished(source: str, keys: str, names=tuple(VALUE)) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{s}' AS statistic, {VALUE[s]} AS value, n AS sample_count FROM {source}" for s in names)


STATS = f"""{WINDOW}, layer AS (SELECT model, period, period_key, CAST(lead AS VARCHAR) AS lead_key, cell_id, {', '.join(SUMS)} FROM per UNION ALL SELECT model, period, period_key, lead_key, cell_id, {', '.join(SUMS)} FROM bywin),
stats AS ({finished('layer', 'model, period, period_key, lead_key, cell_id')})"""
AXES = """lat AS (SELECT i, c, c - 2.5e0 AS lo, c + 2.5e0 AS hi FROM (VALUES (0, 25.0e0), (1, 30.0e0), (2, 35.0e0), (3, 40.0e0)) t(i, c)),
lon AS (SELECT i, c, c - 4.0e0 AS lo, c + 4.0e0 AS hi FROM (VALUES (0, -120.0e0), (1, -112.0e0), (2, -104.0e0), (3, -96.0e0), (4, -88.0e0), (5, -80.0e0)) t(i, c)),
cell AS (SELECT CAST(lat.i * 6 + lon.i AS INT) AS cell_id, lat.c AS lat, lon.c AS lon, lat.lo AS s, lat.hi AS n, lon.lo AS w, lon.hi AS e FROM lat, lon)"""
REGION = f"""{AXES}, raw AS (SELECT c_custkey AS k, CAST(-124.0e0 + (c_custkey * 7) % 50 AS DOUBLE) AS x, CAST(22.0e0 + (c_custkey * 3) % 20 AS DOUBLE) AS y, CAST((c_custkey % 11) + 0.25e0 AS DOUBLE) AS wide, CAST((c_custkey % 7) + 0.25e0 AS DOUBLE) AS high FROM customer),
region AS (SELECT k AS region_id, CASE WHEN k % 5 = 0 THEN 'point' WHEN k % 5 = 1 THEN 'rectangle' ELSE 'polygon' END AS type,
  CASE k % 5 WHEN 0 THEN [[x, y]] WHEN 2 THEN [[x, y], [x + wide * 2, y], [x + wide, y + high * 2]] WHEN 3 THEN [[x, y], [x + wide, y + 0.125e0], [x + wide, y + 0.25e0], [x, y + 0.125e0]] WHEN 4 THEN [[x, y], [x + wide, y + high]] END AS ring,
  x AS bw, y AS bs, x + wide AS be, y + high AS bn FROM raw),
edge AS (SELECT region_id, ring[i][1] AS xi, ring[i][2] AS yi, ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END][1] AS xj, ring[CASE WHEN i = 1 THEN len(ring) ELSE i - 1 END][2] AS yj
  FROM (SELECT *, unnest(generate_series(1, len(ring))) AS i FROM region WHERE type = 'polygon' AND len(ring) >= 3)),
spot AS (SELECT cell_id, 'center' AS kind, lon AS px, lat AS py FROM cell UNION ALL SELECT cell_id, 'corner', w, s FROM cell UNION ALL SELECT cell_id, 'corner', w, n FROM cell UNION ALL SELECT cell_id, 'corner', e, s FROM cell UNION ALL SELECT cell_id, 'corner', e, n FROM cell),
hit AS (SELECT region_id, cell_id, kind, px, py FROM edge, spot WHERE (yi > py) <> (yj > py) AND px < xi + (xj - xi) * (py - yi) / CASE WHEN yj = yi THEN NULL ELSE yj - yi END GROUP BY ALL HAVING count(*) % 2 = 1),
centers AS (SELECT DISTINCT region_id, cell_id FROM hit WHERE kind = 'center'), corners AS (SELECT DISTINCT region_id, cell_id FROM hit),
overlap AS (SELECT region_id, cell_id FROM region, cell WHERE type = 'rectangle' AND s <= bn AND n >= bs AND w <= be AND e >= bw),
aim AS (SELECT region_id, CASE type WHEN 'rectangle' THEN (bw + be) / 2 ELSE list_sum(list_transform(ring, lambda p: p[1])) / len(ring) END AS x, CASE type WHEN 'rectangle' THEN (bs + bn) / 2 ELSE list_sum(list_transform(ring, lambda p: p[2])) / len(ring) END AS y FROM region),
nearest AS (SELECT region_id, CAST((SELECT arg_min(i, (abs(c - y), i)) FROM lat) * 6 + (SELECT arg_min(i, (abs(c - x), i)) FROM lon) AS INT) AS cell_id FROM aim),
chosen AS (SELECT region_id, cell_id, 'overlap' AS how FROM overlap UNION ALL SELECT region_id, cell_id, 'centers' FROM centers
  UNION ALL SELECT region_id, cell_id, 'corners' FROM corners ANTI JOIN centers USING (region_id)
  UNION ALL SELECT region_id, cell_id, 'nearest' FROM nearest ANTI JOIN overlap USING (region_id) ANTI JOIN corners USING (region_id)),
rc AS (SELECT region_id, model, cell_id, how FROM chosen, (VALUES ('gfs'), ('nbm')) t(model))"""
YEARLY = f"{STATS}, yearly AS (SELECT * FROM stats WHERE period = 'yearly'), {REGION}"
LATEST = "latest AS (SELECT fc.* FROM fc SEMI JOIN (SELECT model, max(init_date) AS init_date FROM base GROUP BY 1) USING (model, init_date))"
