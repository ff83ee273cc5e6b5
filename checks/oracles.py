"""DuckDB statement of each registered query."""

from __future__ import annotations

from checks import literal as L

SQL: dict[str, str] = {}

SQL["season_points"] = L.query(L.RESULTS, L.CHAMPIONS, select="SELECT * FROM totals")
SQL["champions"] = L.query(L.RESULTS, L.CHAMPIONS, select="SELECT * FROM champions")
SQL["date_spine"] = L.query(L.RESULTS, L.SPINE, select="SELECT * FROM spine")
SQL["last_n_rounds"] = L.query(
    L.RESULTS, L.KNOWN, select="SELECT dt_ref, Year, RoundNumber, CAST(place AS INTEGER) AS rn FROM standing WHERE place <= 50"
)
for _n in L.WINDOWS:
    SQL[f"driver_statistic_{_n}"] = L.query(L.RESULTS, L.KNOWN, L.statistic(_n), select=f"SELECT * FROM stat_{_n}")
SQL["driver_statistic_ordered"] = SQL["driver_statistic_5"]
SQL["driver_all_statistic"] = L.query(L.RESULTS, L.wide(), select="SELECT * FROM wide")
SQL["tb_abt"] = L.query(L.RESULTS, L.labelled(), select="SELECT * FROM abt")

# --- as-of calendar
SQL["asof_sessions"] = L.query(
    L.RESULTS,
    L.KNOWN,
    select="""
    SELECT dt_ref, COUNT(*) AS qty_rows, COUNT(DISTINCT Year * 100 + RoundNumber) AS qty_rounds,
           COUNT(DISTINCT DriverId) AS qty_drivers
    FROM spine JOIN results ON CAST(Date AS DATE) <= dt_ref GROUP BY dt_ref""",
)
SQL["eligible_drivers"] = L.query(L.RESULTS, L.KNOWN, select="SELECT dt_ref, DriverId FROM latest WHERE season >= ref_year - 2")
SQL["min_season_filter"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year, Mode, COUNT(*) AS rows FROM results
    WHERE Year BETWEEN (SELECT MIN(Year) FROM results) AND 1999 GROUP BY Year, Mode""",
)
SQL["season_rounds"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year, COUNT(DISTINCT RoundNumber) AS qty_rounds, COUNT(DISTINCT CAST(Date AS DATE)) AS qty_dates,
           COUNT(DISTINCT DriverId) AS qty_drivers
    FROM results WHERE Year BETWEEN 1980 AND 2000 GROUP BY Year""",
)
SQL["consolidate_windows"] = L.query(L.RESULTS, L.wide(), select="SELECT * FROM wide")

# --- training sets
_SPLIT = """
dates AS (
  SELECT dt_ref, row_number() OVER (PARTITION BY year(dt_ref) ORDER BY dt_ref DESC) - 1 AS newer
  FROM (SELECT DISTINCT dt_ref FROM abt)
),
sampled AS (SELECT abt.* FROM abt JOIN (SELECT dt_ref FROM dates WHERE newer > 4) USING (dt_ref)),
split AS (
  SELECT 'train' AS split, * FROM sampled WHERE year(dt_ref) < 2000
  UNION ALL SELECT 'test', * FROM sampled WHERE year(dt_ref) = 2000
  UNION ALL SELECT 'oot', * FROM abt WHERE year(dt_ref) = 2001
)"""
SQL["season_tail_sampling"] = L.query(
    L.RESULTS, L.labelled(), _SPLIT, select="SELECT * FROM sampled"
)
SQL["temporal_split"] = L.query(
    L.RESULTS, L.labelled(), _SPLIT, select="SELECT * FROM split"
)
SQL["split_sizes"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    select=f"""
    SELECT split, COUNT(*) AS rows, CAST({len(L.features()) + 3} AS INTEGER) AS columns
    FROM (SELECT 'all' AS split FROM abt UNION ALL SELECT split FROM split) GROUP BY split""",
)
SQL["training_matrix"] = L.query(L.RESULTS, L.labelled(), _SPLIT, select="SELECT * FROM split")
SQL["null_profile"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    select="SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM split WHERE split = 'train'"
        for c in [n for n in L.features() if n.startswith(("avg_", "total_"))] + ["flChampion"]
    )
    + ") WHERE nulls > 0",
)
SQL["impute_sentinel"] = L.query(
    L.RESULTS,
    L.labelled(),
    select="SELECT dt_ref, DriverId, "
    + ", ".join(f"coalesce({c}, -10000) AS {c}" for c in [*L.features(), "flChampion"])
    + " FROM abt",
)

# --- ranking quality
_CURVE = """
scored AS (SELECT n_chars, quality FROM labels JOIN documents USING (doc_id)),
counted AS (
  SELECT CAST(n_chars AS DOUBLE) AS threshold, SUM(quality) AS pos, SUM(1 - quality) AS neg FROM scored GROUP BY n_chars
),
points AS (
  SELECT threshold, pos, neg,
         SUM(neg) OVER (ORDER BY threshold DESC) / (SELECT CAST(SUM(1 - quality) AS DOUBLE) FROM scored) AS fpr,
         SUM(pos) OVER (ORDER BY threshold DESC) / (SELECT CAST(SUM(quality) AS DOUBLE) FROM scored) AS tpr,
         lead(pos) OVER (ORDER BY threshold DESC) AS next_pos, lead(neg) OVER (ORDER BY threshold DESC) AS next_neg,
         row_number() OVER (ORDER BY threshold DESC) AS nth
  FROM counted
)"""
_START = "SELECT CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr"
SQL["roc_curve_all_points"] = L.query(_CURVE, select=f"SELECT threshold, fpr, tpr FROM points UNION ALL {_START}")
SQL["roc_curve"] = L.query(
    _CURVE,
    select=f"""
    SELECT threshold, fpr, tpr FROM points
    WHERE nth = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg UNION ALL {_START}""",
)
SQL["roc_auc"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    """
ranks AS (
  SELECT split, flChampion,
         rank() OVER (PARTITION BY split ORDER BY total_points_5)
         + (COUNT(*) OVER (PARTITION BY split, total_points_5) - 1) / 2.0 AS mean_rank
  FROM split WHERE total_points_5 IS NOT NULL
),
sums AS (
  SELECT split, CAST(SUM(mean_rank) FILTER (WHERE flChampion = 1) AS DOUBLE) AS rank_sum,
         CAST(SUM(flChampion) AS DOUBLE) AS p, CAST(SUM(1 - flChampion) AS DOUBLE) AS n
  FROM ranks GROUP BY split
)""",
    select="SELECT split, ROUND((rank_sum - p * (p + 1) / 2) / nullif(p * n, 0), 9) AS auc FROM sums",
)

SQL["roc_curve_by_split"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    """
by_score AS (
  SELECT split, CAST(total_points_5 AS DOUBLE) AS threshold, SUM(flChampion) AS pos, SUM(1 - flChampion) AS neg
  FROM split WHERE total_points_5 IS NOT NULL GROUP BY ALL
),
steps AS (
  SELECT *, SUM(neg) OVER down / nullif(CAST(SUM(neg) OVER (PARTITION BY split) AS DOUBLE), 0) AS fpr,
         SUM(pos) OVER down / nullif(CAST(SUM(pos) OVER (PARTITION BY split) AS DOUBLE), 0) AS tpr,
         lead(pos) OVER down AS next_pos, lead(neg) OVER down AS next_neg, row_number() OVER down AS nth
  FROM by_score WINDOW down AS (PARTITION BY split ORDER BY threshold DESC)
)""",
    select=f"""
    SELECT split, threshold, fpr, tpr FROM steps
    WHERE nth = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
    UNION ALL SELECT split, start.* FROM (SELECT DISTINCT split FROM split), ({_START}) AS start""",
)

# --- model: one tree of one split, the best by Gini gain over all rows of the training split,
# in which both classes weigh the same. (Spark joins leaves of one class again; with equal weights the two differ.)
_STUMP = ("qty_1place_5", "qty_place_5", "qty_seasons_40", "qty_poli_win_20", "qty_sessions_with_points_10")
_TREE = f"""
grown AS (SELECT * FROM split WHERE split = 'train'),
counts AS ({" UNION ALL ".join(
    f"SELECT {i} AS nr, '{c}' AS feature, {c} AS v, COUNT(*) AS n, SUM(flChampion) AS p FROM grown GROUP BY {c}"
    for i, c in enumerate(_STUMP))}),
sides AS (
  SELECT nr, feature, (v + lead(v) OVER w) / 2.0 AS cut, SUM(n) OVER w AS ln, SUM(n) OVER t AS tn,
         SUM(n - p) OVER w AS la, SUM(n - p) OVER t AS ta, SUM(p) OVER w * SUM(n - p) OVER t / CAST(SUM(p) OVER t AS DOUBLE) AS lb
  FROM counts WINDOW w AS (PARTITION BY nr ORDER BY v), t AS (PARTITION BY nr)
),
-- both classes weigh the same as a whole: ta each
gains AS (
  SELECT *, ROUND((la * la + lb * lb) / (la + lb) + ((ta - la) * (ta - la) + (ta - lb) * (ta - lb)) / (2 * ta - la - lb) - ta, 6) AS gain
  FROM sides WHERE cut IS NOT NULL AND ln >= 50 AND tn - ln >= 50
),
-- of equal gains the first feature in order, and its lowest cut
tree AS (SELECT * FROM gains WHERE gain > 0 ORDER BY gain DESC, nr, cut LIMIT 1),
leaf AS (
  SELECT feature, cut, lb / (la + lb) AS low, (ta - lb) / (2 * ta - la - lb) AS high FROM tree
)"""
_LEAF_VALUE = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in _STUMP) + " END"
_CHANCE = f"CASE WHEN {_LEAF_VALUE} <= cut THEN low ELSE high END"
SQL["fit_forest"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    _TREE,
    f"""
chances AS (SELECT split, flChampion, {_CHANCE} AS chance FROM split, leaf),
placed_chances AS (
  SELECT split, flChampion,
         rank() OVER (PARTITION BY split ORDER BY chance) + (COUNT(*) OVER (PARTITION BY split, chance) - 1) / 2.0 AS mean_rank
  FROM chances
),
sums AS (
  SELECT split, CAST(SUM(mean_rank) FILTER (WHERE flChampion = 1) AS DOUBLE) AS rank_sum,
         CAST(SUM(flChampion) AS DOUBLE) AS p, CAST(SUM(1 - flChampion) AS DOUBLE) AS n
  FROM placed_chances GROUP BY split
)""",
    select="SELECT split, ROUND((rank_sum - p * (p + 1) / 2) / nullif(p * n, 0), 4) AS auc FROM sums",
)
SQL["feature_importance"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    _TREE,
    select=f"""
    SELECT name AS feature, CAST(coalesce(name = (SELECT feature FROM tree), false) AS DOUBLE) AS importance
    FROM (SELECT unnest([{", ".join(f"'{c}'" for c in _STUMP)}]) AS name)""",
)

# --- serving
_COLOR = """CASE WHEN TeamColor IS NULL THEN '#ffffff' WHEN TeamColor LIKE '#%' THEN lower(TeamColor)
            ELSE lower('#' || TeamColor) END"""
_ENTITIES = f"""
entities AS (
  SELECT DriverId, TeamName, {_COLOR} AS TeamColor, FullName, TeamId FROM results
  QUALIFY row_number() OVER (PARTITION BY DriverId ORDER BY Date DESC, TeamName, TeamColor, FullName, TeamId) = 1
)"""
_SCORED = f"""{L.labelled()},{_ENTITIES},
scored AS (
  SELECT w.*, strftime(w.dt_ref, '%Y-%m-%d') || '_' || w.DriverId AS id,
         CAST(year(w.dt_ref) AS INTEGER) AS Year, total_points_5 / (1 + total_points_10) AS prob_win,
         TeamName, TeamColor, FullName, TeamId, w.DriverId || '_' || TeamId AS driver_team_id
  FROM abt w JOIN entities e ON w.DriverId = e.DriverId
)"""
_CHOSEN = """
best AS (SELECT * FROM scored ORDER BY dt_ref DESC, prob_win DESC NULLS LAST, DriverId LIMIT 5),
chosen AS (
  SELECT * FROM scored
  WHERE driver_team_id IN (SELECT driver_team_id FROM best WHERE driver_team_id IS NOT NULL)
    AND Year = (SELECT max(Year) FROM scored)
),
ids AS (SELECT DISTINCT driver_team_id FROM best WHERE driver_team_id IS NOT NULL)"""
SQL["entity_dimension"] = L.query(L.RESULTS, _ENTITIES, select="SELECT * FROM entities")
SQL["format_color"] = L.query(
    L.RESULTS,
    select=f"SELECT TeamName, TeamColor, {_COLOR} AS color, COUNT(*) AS rows FROM results GROUP BY ALL",
)
SQL["score_abt"] = L.query(
    L.RESULTS,
    L.labelled(),
    _SPLIT,
    _TREE,
    _ENTITIES,
    f"""
filled AS (
  SELECT dt_ref, DriverId, {", ".join(f"coalesce({c}, -10000) AS {c}" for c in [*L.features(), "flChampion"])} FROM abt
)""",
    select=f"""
    SELECT f.*, strftime(dt_ref, '%Y-%m-%d') || '_' || f.DriverId AS id, CAST(year(dt_ref) AS INTEGER) AS Year,
           ROUND(1 - {_CHANCE}, 9) AS "0", ROUND({_CHANCE}, 9) AS prob_win,
           TeamName, TeamColor, FullName, TeamId, f.DriverId || '_' || TeamId AS driver_team_id
    FROM filled f JOIN entities e ON f.DriverId = e.DriverId, leaf""",
)
SQL["scored_with_team"] = L.query(L.RESULTS, _SCORED, select="SELECT * FROM scored")
SQL["first_team"] = L.query(
    L.RESULTS,
    _SCORED,
    select="""
    SELECT DriverId, driver_team_id, dt_ref FROM (
      SELECT *, row_number() OVER (PARTITION BY DriverId ORDER BY dt_ref, driver_team_id NULLS LAST) AS nth FROM scored
    ) WHERE nth = 1 AND driver_team_id IS NOT NULL""",
)
SQL["top_probability"] = L.query(
    L.RESULTS, _SCORED, _CHOSEN, select="SELECT dt_ref, DriverId, prob_win, driver_team_id FROM best"
)
SQL["season_domain"] = L.query(
    L.RESULTS,
    _SCORED,
    select="SELECT DISTINCT Year, Year = (SELECT max(Year) FROM scored) AS is_default FROM scored",
)
SQL["filter_entities_seasons"] = L.query(L.RESULTS, _SCORED, _CHOSEN, select="SELECT * FROM chosen")
SQL["selected_from_stored"] = SQL["filter_entities_seasons"]
SQL["pivot_probability"] = L.query(
    L.RESULTS,
    _SCORED,
    _CHOSEN,
    select="""
    SELECT d.dt_ref, i.driver_team_id, avg(c.prob_win) AS mean_prob_win
    FROM (SELECT DISTINCT dt_ref FROM chosen) d CROSS JOIN ids i
    LEFT JOIN chosen c ON c.dt_ref = d.dt_ref AND c.driver_team_id = i.driver_team_id
    GROUP BY d.dt_ref, i.driver_team_id""",
)
SQL["color_lookup"] = L.query(
    L.RESULTS,
    _SCORED,
    _CHOSEN,
    select="""
    SELECT CAST(row_number() OVER (ORDER BY driver_team_id) - 1 AS INTEGER) AS pos, driver_team_id, TeamColor
    FROM ids LEFT JOIN (SELECT driver_team_id, min(TeamColor) AS TeamColor FROM chosen GROUP BY 1) USING (driver_team_id)""",
)

# --- sources
SQL["consolidate_results"] = L.query(L.RESULTS, select="SELECT * FROM results")
SQL["ingest_stream"] = SQL["consolidate_results"]
SQL["incremental_new_sessions"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year, RoundNumber, Mode, COUNT(*) AS rows FROM results
    WHERE (Year, RoundNumber, Mode) NOT IN
          (SELECT DISTINCT (Year, RoundNumber, Mode) FROM results WHERE Year < 2000 AND Mode = 'Race')
    GROUP BY Year, RoundNumber, Mode""",
)
SQL["backfill_years"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year, CASE WHEN Year < 2001 THEN Status ELSE 'stale' END AS Status, COUNT(*) AS rows
    FROM results GROUP BY ALL""",
)
SQL["session_key"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year || '_' || lpad(CAST(RoundNumber AS VARCHAR), 2, '0') || '_' || left(Mode, 1) AS session_key,
           COUNT(*) AS rows
    FROM results GROUP BY 1""",
)
SQL["durations_to_seconds"] = """
SELECT event_id,
       (epoch_us(ts) - epoch_us(CAST(date_trunc('hour', ts) AS TIMESTAMP))) / 1e6 AS Q1,
       (epoch_us(ts) - epoch_us(CAST(date_trunc('day', ts) AS TIMESTAMP))) / 1e6 AS Q2,
       (epoch_us(ts) - epoch_us(CAST(date_trunc('month', ts) AS TIMESTAMP))) / 1e6 AS Q3,
       (epoch_us(ts) - epoch_us(CAST(date_trunc('year', ts) AS TIMESTAMP))) / 1e6 AS Time
FROM events"""
SQL["enrich_sessions"] = L.query(
    L.RESULTS,
    select="""
    SELECT r.*, Year || ' Grand Prix of ' || n_name AS OfficialEventName, n_name || ' Grand Prix' AS EventName,
           n_name AS Country, r_name AS Location
    FROM results r JOIN nation ON RoundNumber = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
SQL["enrich_unlisted_sessions"] = L.query(
    L.RESULTS,
    select="""
    SELECT r.* REPLACE (CASE WHEN RoundNumber <= 6 THEN Date END AS Date),
           Year || ' Grand Prix of ' || n_name AS OfficialEventName, n_name || ' Grand Prix' AS EventName,
           n_name AS Country, r_name AS Location
    FROM results r LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <= 6)
      ON RoundNumber = n_nationkey""",
)
SQL["ingest_after_reload"] = SQL["backfill_years"]
SQL["ingest_ledger"] = L.query(
    L.RESULTS,
    select="""
    SELECT Year, RoundNumber, Mode, COUNT(*) AS rows, CASE WHEN Year < 1996 THEN 1 ELSE 0 END AS batch
    FROM results GROUP BY Year, RoundNumber, Mode""",
)
SQL["incremental_null_keys"] = L.query(
    L.RESULTS,
    "bare AS (SELECT * REPLACE (nullif(Mode, 'Sprint') AS Mode) FROM results)",
    select="""
    SELECT Year, RoundNumber, Mode, COUNT(*) AS rows FROM bare b
    WHERE NOT EXISTS (
      SELECT 1 FROM bare o WHERE o.Year = b.Year AND o.RoundNumber = b.RoundNumber AND o.Mode IS NOT DISTINCT FROM b.Mode
        AND o.Year < 2000)
    GROUP BY Year, RoundNumber, Mode""",
)

# --- raw files of several layouts
_GOOD = "Position IS NOT NULL AND Points <> 50"
SQL["consolidate_published"] = L.query(
    L.RESULTS,
    select=f"SELECT * REPLACE (CASE WHEN Year > 1995 THEN TeamColor END AS TeamColor) FROM results WHERE {_GOOD}",
)
SQL["bronze_rejects"] = L.query(
    L.RESULTS,
    """
told AS (
  SELECT CASE WHEN Position IS NOT NULL THEN Year END AS Year,
         CASE WHEN Position IS NULL THEN 'Year is missing' WHEN Points = 50 THEN 'RoundNumber is missing' ELSE 'kept' END AS reason
  FROM results
)""",
    select="""
    SELECT Year, reason, COUNT(*) AS rows FROM told GROUP BY ALL
    UNION ALL SELECT NULL, 'counted rows', COUNT(*) FROM told
    UNION ALL SELECT NULL, 'counted rejected', COUNT(*) FROM told WHERE reason <> 'kept'""",
)

# --- any date, and the stored statements
def _on_days(n: int, days: str) -> str:
    """CTEs for the statistics on the dates (d) of `days`, whose season is their year; ends in found."""
    items = ", ".join(f"{pick(n)} AS {name}" for name, pick in L.STATISTICS.items())
    return f"""
days AS ({days}),
spine AS (SELECT d AS dt_ref, year(d) AS ref_year FROM days),
begun AS (
  SELECT Year, RoundNumber, MIN(CAST(Date AS DATE)) AS since,
         coalesce(Year, -1000000) * 1000000 + coalesce(RoundNumber, -1) AS age
  FROM results GROUP BY Year, RoundNumber
),
standing AS (
  SELECT dt_ref, Year, RoundNumber, row_number() OVER (PARTITION BY dt_ref ORDER BY age DESC) AS place
  FROM spine, begun WHERE since <= dt_ref
),
latest AS (
  SELECT dt_ref, ref_year, DriverId, MAX(Year) AS season
  FROM spine, results WHERE CAST(Date AS DATE) <= dt_ref GROUP BY ALL
),
placed AS (
  SELECT t.dt_ref, t.place, r.*
  FROM results r
  JOIN standing t ON r.Year = t.Year AND r.RoundNumber = t.RoundNumber AND CAST(r.Date AS DATE) <= t.dt_ref
  JOIN latest l ON l.dt_ref = t.dt_ref AND l.DriverId = r.DriverId AND l.season >= l.ref_year - 2
  WHERE t.place <= {n}
),
found AS (SELECT dt_ref, DriverId, {items} FROM placed GROUP BY dt_ref, DriverId)"""


SQL["asof_any_date"] = L.query(
    L.RESULTS,
    "probes AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS DriverId, l_shipdate + to_hours(l_linenumber) AS left_at FROM lineitem)",
    _on_days(5, "SELECT DISTINCT CAST(left_at AS DATE) AS d FROM probes"),
    select=f"""
    SELECT p.*, {", ".join(f"f.{name}" for name in L.STATISTICS)}
    FROM probes p LEFT JOIN found f ON f.DriverId = p.DriverId AND f.dt_ref = CAST(p.left_at AS DATE)""",
)
SQL["statistic_by_sql"] = L.query(
    L.RESULTS, L.KNOWN, L.statistic(10), select="SELECT * FROM stat_10 WHERE year(dt_ref) <= 2000"
)
SQL["statistic_on_a_day"] = L.query(
    L.RESULTS, _on_days(20, "SELECT DATE '1999-05-17' AS d"), select="SELECT * EXCLUDE (dt_ref) FROM found"
)
SQL["champions_by_sql"] = L.query(L.RESULTS, L.CHAMPIONS, select="SELECT * FROM champions WHERE Year <= 2000")
SQL["tb_abt_by_sql"] = SQL["tb_abt"]
SQL["silver_after_reload"] = SQL["tb_abt"]
SQL["consolidate_bucketed"] = SQL["consolidate_windows"]
