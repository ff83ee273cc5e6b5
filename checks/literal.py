"""The statistics in their plain definition, as DuckDB SQL.

Written from the definition and not from any plan. A round's place on a date is one more
than the number of newer rounds that had begun by then; an entity counts while its newest
season so far is at most two back; a row counts in the windows as long as its round's
place. All windows are filters of one grouping. Slow, but without any of the shortcuts.
"""

from __future__ import annotations

from collections.abc import Callable

WINDOWS = (5, 10, 20, 40, 50)

RESULTS = """
results AS (
  SELECT * EXCLUDE (Date0), CAST(Date0 AS TIMESTAMP) AS Date
  FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS DriverId,
           CAST(year(l_shipdate) AS INTEGER) AS Year,
           CAST(month(l_shipdate) AS INTEGER) AS RoundNumber,
           CASE WHEN l_linestatus = 'O' THEN last_day(l_shipdate) - INTERVAL 1 DAY ELSE last_day(l_shipdate) END AS Date0,
           CASE WHEN l_linestatus = 'O' THEN 'Sprint' ELSE 'Race' END AS Mode,
           CAST(nullif(l_linenumber, 7) AS DOUBLE) AS Position,
           CAST(nullif(1 + l_partkey % 10, 10) AS DOUBLE) AS GridPosition,
           CAST(CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END AS DOUBLE) AS Points,
           CASE l_returnflag WHEN 'A' THEN 'Finished' WHEN 'R' THEN '+1 Lap' ELSE 'Retired' END AS Status,
           CASE WHEN s_nationkey % 6 = 5 THEN NULL ELSE 'team_' || s_nationkey END AS TeamId,
           'Team ' || s_nationkey AS TeamName,
           CASE s_nationkey % 3 WHEN 0 THEN NULL
                WHEN 1 THEN '#AB00' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0')
                ELSE 'AB00' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') END AS TeamColor,
           s_name AS FullName
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE NOT (l_suppkey % 4 = 0 AND year(l_shipdate) > 1997)
      AND NOT (l_suppkey % 5 = 0 AND year(l_shipdate) < 1999)
  ) q
)"""

SPINE = """
spine AS (SELECT DISTINCT CAST(Date AS DATE) AS dt_ref, Year AS ref_year FROM results)"""

KNOWN = f"""{SPINE},
begun AS (
  SELECT Year, RoundNumber, MIN(CAST(Date AS DATE)) AS since,
         coalesce(Year, -1000000) * 1000000 + coalesce(RoundNumber, -1) AS age
  FROM results GROUP BY Year, RoundNumber
),
standing AS (
  SELECT dt_ref, ref_year, Year, RoundNumber,
         1 + (SELECT COUNT(*) FROM begun newer WHERE newer.since <= dt_ref AND newer.age > begun.age) AS place
  FROM spine, begun WHERE since <= dt_ref
),
latest AS (
  SELECT dt_ref, ref_year, DriverId, MAX(Year) AS season
  FROM spine, results WHERE CAST(Date AS DATE) <= dt_ref GROUP BY ALL
)"""

#: Rows of eligible entities with the place of their round, on every date.
PLACED = """
placed AS (
  SELECT t.dt_ref, t.place, r.*
  FROM results r
  JOIN standing t ON r.Year = t.Year AND r.RoundNumber = t.RoundNumber AND CAST(r.Date AS DATE) <= t.dt_ref
  WHERE (SELECT season FROM latest l WHERE l.dt_ref = t.dt_ref AND l.ref_year = t.ref_year AND l.DriverId = r.DriverId)
        >= t.ref_year - 2
)"""

CHAMPIONS = """
totals AS (SELECT Year, DriverId, SUM(Points) AS total_points FROM results GROUP BY Year, DriverId),
champions AS (
  SELECT Year, DriverId, total_points, CAST(1 AS INTEGER) AS rank_driver
  FROM totals t
  WHERE NOT EXISTS (
    SELECT 1 FROM totals better
    WHERE better.Year IS NOT DISTINCT FROM t.Year
      AND (coalesce(better.total_points, '-inf') > coalesce(t.total_points, '-inf')
           OR coalesce(better.total_points, '-inf') = coalesce(t.total_points, '-inf') AND better.DriverId < t.DriverId)
  )
)"""

_FIN = "(Status = 'Finished' OR Status LIKE '+%')"


Pick = Callable[[int], str]


def _number(condition: str) -> Pick:
    return lambda n: f"COUNT(*) FILTER (WHERE {condition} AND place <= {n})"


def _mean(value: str, mode: str | None = None) -> Pick:
    value = f"CASE Mode WHEN '{mode}' THEN {value} ELSE 0 END" if mode else value
    return lambda n: f"CAST(ROUND(CAST(AVG({value}) FILTER (WHERE place <= {n}) AS DECIMAL(20,10)), 2) AS DOUBLE)"


def _sum(value: str) -> Pick:
    return lambda n: f"SUM({value}) FILTER (WHERE place <= {n})"


# The published columns and the conditions they count.
STATISTICS: dict[str, Pick] = {
    "qty_seasons": lambda n: f"COUNT(DISTINCT Year) FILTER (WHERE place <= {n})",
    "qty_sessions": _number("true"),
    "qty_sessions_finished": _number(_FIN),
    "qty_1place": _number("Position = 1"),
    "qty_2place": _number("Position = 2"),
    "qty_3place": _number("Position = 3"),
    "qty_place": _number("Position <= 3"),
    "total_points": _sum("Points"),
    "avg_gridposition": _mean("GridPosition"),
    "avg_position": _mean("Position"),
    "qty_gridposition_1": _number("GridPosition = 1"),
    "qty_poli_win": _number("GridPosition = 1 AND Position = 1"),
    "qty_sessions_with_points": _number("Points > 0"),
    "qty_sessions_with_overtake": _number("Position < GridPosition"),
    "avg_overtake": _mean("(GridPosition - Position)"),
    "qty_pos5": _number("Position <= 5"),
    "qty_gridpos5": _number("GridPosition <= 5"),
}
for _s, _mode in (("r", "Race"), ("s", "Sprint")):
    _in = f"Mode = '{_mode}'"
    _cap = _s.upper() if _s == "s" else _s
    STATISTICS |= {
        f"qty_sessions_{_s}": _number(_in),
        f"qty_sessions_finished_{_s}": _number(f"{_FIN} AND {_in}"),
        f"qty_1place_{_s}": _number(f"Position = 1 AND {_in}"),
        f"qty_place_{_s}": _number(f"Position <= 3 AND {_in}"),
        f"total_points_{_s}": _sum(f"CASE Mode WHEN '{_mode}' THEN Points ELSE 0 END"),
        f"avg_gridposition_{_s}": _mean("GridPosition", _mode),
        f"avg_position_{_s}": _mean("Position", _mode),
        f"qty_gridposition_1_{_s}": _number(f"GridPosition = 1 AND {_in}"),
        f"qty_poli_win_{_s}": _number(f"GridPosition = 1 AND Position = 1 AND {_in}"),
        f"qty_sessions_with_points_{_s}": _number(f"Points > 0 AND {_in}"),
        f"qty_sessions_with_overtake_{_s}": _number(f"Position < GridPosition AND {_in}"),
        f"avg_overtake_{_s}": _mean("(GridPosition - Position)", _mode),
        f"qty_pos5_{_cap}": _number(f"Position <= 5 AND {_in}"),
        f"qty_gridpos5_{_cap}": _number(f"GridPosition <= 5 AND {_in}"),
    }


def statistic(n: int) -> str:
    """CTE stat_<n>; needs results and KNOWN before it."""
    items = ", ".join(f"{pick(n)} AS {name}" for name, pick in STATISTICS.items())
    return f"{PLACED},\nstat_{n} AS (SELECT dt_ref, DriverId, {items} FROM placed WHERE place <= {n} GROUP BY dt_ref, DriverId)"


def wide(windows: tuple[int, ...] = WINDOWS) -> str:
    """CTE wide: every window of one grouping. Who is in the shortest window is in all."""
    items = ", ".join(f"{pick(n)} AS {name}_{n}" for n in windows for name, pick in STATISTICS.items())
    return f"""{KNOWN},{PLACED},
wide AS (
  SELECT dt_ref, DriverId, {items} FROM placed WHERE place <= {max(windows)}
  GROUP BY dt_ref, DriverId HAVING MIN(place) <= {min(windows)}
)"""


def labelled(windows: tuple[int, ...] = WINDOWS) -> str:
    """CTE abt: the wide table, with 1 where the entity is the champion of the date's year."""
    return f"""{wide(windows)},{CHAMPIONS},
abt AS (
  SELECT *, CAST((year(dt_ref), DriverId) IN (SELECT (Year, DriverId) FROM champions) AS INTEGER) AS flChampion FROM wide
)"""


def query(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def features(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    return [f"{name}_{n}" for n in windows for name in STATISTICS]
