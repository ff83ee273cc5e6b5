"""The 45 statistics of a results window, as additive parts and final expressions.

Parts are counts and (sum, count) pairs over a set of rows. They can be added up and
taken away again, so a window is kept up to date by adding the rows that enter it and
subtracting those that leave. `finals` turns the parts of a window into statistics.
NaN and infinities are counted beside the sums, so a window recovers when one leaves it.
Points are summed as decimals, so taking one away leaves no rest however large it was.
Places are summed as doubles, which is exact for whole places of limited size and much faster.

All lists hold SQL expressions: one parse of a wide SELECT is far cheaper than building
hundreds of Column objects.
"""

from __future__ import annotations

from collections.abc import Callable

# Scope suffix -> the session mode it is limited to.
MODES = {"_r": "Race", "_s": "Sprint"}

# What each counted part counts.
_FLAGS = {
    "sessions": "true",
    "sessions_finished": "Status = 'Finished' OR startswith(Status, '+')",
    "1place": "Position = 1",
    "2place": "Position = 2",
    "3place": "Position = 3",
    "place": "Position <= 3",
    "gridposition_1": "GridPosition = 1",
    "poli_win": "GridPosition = 1 AND Position = 1",
    "sessions_with_points": "Points > 0",
    "sessions_with_overtake": "Position < GridPosition",
    "pos5": "Position <= 5",
    "gridpos5": "GridPosition <= 5",
}
_OVERALL_ONLY = ("2place", "3place")
_MEASURES = {
    "points": "Points",
    "gridposition": "GridPosition",
    "position": "Position",
    "overtake": "GridPosition - Position",
}
#: Sums of points keep 16 fraction digits. Larger points, places or sums stop the job.
_DECIMAL = "DECIMAL(38, 16)"
LARGEST_POINTS, LARGEST_PLACE = 1e18, 1e9
_TOO_LARGE = "raise_error('points or places too large to add up')"
# What is counted of values that no sum recovers from.
_NOT_FINITE = {"nan": "'NaN'", "high": "'Infinity'", "low": "'-Infinity'"}


def _addend(name: str, value: str) -> str:
    """A value as it is added up; null and what is not finite as 0."""
    number = f"CAST({value} AS DOUBLE)"
    limit, kind = (LARGEST_POINTS, _DECIMAL) if name == "points" else (LARGEST_PLACE, "DOUBLE")
    finite = f"if(abs({number}) < {limit:.0f}D, CAST({number} AS {kind}), {_TOO_LARGE})"
    return f"if({number} IS NULL OR isnan({number}) OR abs({number}) = DOUBLE('Infinity'), 0, {finite})"


def parts() -> list[str]:
    """Aggregates over raw result rows."""
    out = [f"count_if({flag}) AS n_{name}" for name, flag in _FLAGS.items()]
    for name, value in _MEASURES.items():
        out += [f"coalesce(sum({_addend(name, value)}), {_TOO_LARGE}) AS sum_{name}", f"count({value}) AS cnt_{name}"]
        out += [f"count_if({value} = DOUBLE({what})) AS {kind}_{name}" for kind, what in _NOT_FINITE.items()]
    return out


def part_names(scope: str = "") -> list[str]:
    names = [f"n_{name}" for name in _FLAGS if not (scope and name in _OVERALL_ONLY)]
    for name in _MEASURES:
        names += [f"sum_{name}", f"cnt_{name}", *[f"{kind}_{name}" for kind in _NOT_FINITE]]
    return names


def scoped() -> list[tuple[str, str]]:
    """(name, value) of every part overall and by mode, the value as seen on one row."""
    out = [(name, name) for name in part_names()]
    for scope, mode in MODES.items():
        out += [(f"{name}{scope}", f"if(Mode = '{mode}', {name}, 0)") for name in part_names(scope)]
    return out


def _counted(name: str, scope: str) -> str:
    return f"n_{name}{scope}"


def _rows(name: str, scope: str) -> str:
    """Rows an average or sum runs over. By mode, rows of other modes count with 0."""
    return f"(cnt_{name}{scope} + n_sessions - n_sessions{scope})" if scope else f"cnt_{name}"


def _sum(name: str, scope: str) -> str:
    nan, high, low = (f"{kind}_{name}{scope} > 0" for kind in _NOT_FINITE)
    finite = f"CAST(coalesce(sum_{name}{scope}, {_TOO_LARGE}) AS DOUBLE)"
    return (
        f"CASE WHEN {nan} OR ({high} AND {low}) THEN DOUBLE('NaN') WHEN {high} THEN DOUBLE('Infinity') "
        f"WHEN {low} THEN DOUBLE('-Infinity') ELSE {finite} END"
    )


def _total(scope: str) -> str:
    return f"if({_rows('points', scope)} > 0, {_sum('points', scope)}, NULL)"


def _average(name: str, scope: str) -> str:
    return f"round(try_divide({_sum(name, scope)}, CAST({_rows(name, scope)} AS DOUBLE)), 2)"


# The statistics in table order. True marks those repeated by mode.
_STATISTICS: list[tuple[str, bool, Callable[[str], str]]] = [
    ("qty_sessions", True, lambda s: _counted("sessions", s)),
    ("qty_sessions_finished", True, lambda s: _counted("sessions_finished", s)),
    ("qty_1place", True, lambda s: _counted("1place", s)),
    ("qty_2place", False, lambda s: _counted("2place", s)),
    ("qty_3place", False, lambda s: _counted("3place", s)),
    ("qty_place", True, lambda s: _counted("place", s)),
    ("total_points", True, _total),
    ("avg_gridposition", True, lambda s: _average("gridposition", s)),
    ("avg_position", True, lambda s: _average("position", s)),
    ("qty_gridposition_1", True, lambda s: _counted("gridposition_1", s)),
    ("qty_poli_win", True, lambda s: _counted("poli_win", s)),
    ("qty_sessions_with_points", True, lambda s: _counted("sessions_with_points", s)),
    ("qty_sessions_with_overtake", True, lambda s: _counted("sessions_with_overtake", s)),
    ("avg_overtake", True, lambda s: _average("overtake", s)),
    ("qty_pos5", True, lambda s: _counted("pos5", s)),
    ("qty_gridpos5", True, lambda s: _counted("gridpos5", s)),
]
# Two columns carry a capital suffix in the published table.
_CAPITAL = {"qty_pos5_s": "qty_pos5_S", "qty_gridpos5_s": "qty_gridpos5_S"}


def finals() -> list[str]:
    """The 45 statistics from accumulated parts plus `qty_seasons`, in table order."""
    out = ["qty_seasons", *(f"{make('')} AS {name}" for name, _, make in _STATISTICS)]
    for name, by_mode, make in _STATISTICS:
        if by_mode:
            out += [f"{make(s)} AS {_CAPITAL.get(name + s, name + s)}" for s in MODES]
    return out


def names() -> list[str]:
    out = ["qty_seasons", *(name for name, _, _ in _STATISTICS)]
    for name, by_mode, _ in _STATISTICS:
        if by_mode:
            out += [_CAPITAL.get(name + s, name + s) for s in MODES]
    return out
