"""Table contract: the results schema, keys and layer names."""

from __future__ import annotations

from pyspark.sql import types as T

RESULTS = T.StructType(
    [
        T.StructField("DriverId", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("RoundNumber", T.IntegerType()),
        T.StructField("Date", T.TimestampType()),
        T.StructField("Mode", T.StringType()),
        T.StructField("Position", T.DoubleType()),
        T.StructField("GridPosition", T.DoubleType()),
        T.StructField("Points", T.DoubleType()),
        T.StructField("Status", T.StringType()),
        T.StructField("TeamId", T.StringType()),
        T.StructField("TeamName", T.StringType()),
        T.StructField("TeamColor", T.StringType()),
        T.StructField("FullName", T.StringType()),
    ]
)

# Optional columns a raw session file may carry besides RESULTS.
RESULTS_EXTRA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("OfficialEventName", "EventName", "Country", "Location")]
    + [T.StructField(c, T.DoubleType()) for c in ("Q1", "Q2", "Q3", "Time")]
)

SESSION_KEY = ["Year", "RoundNumber", "Mode"]
SESSION_METADATA = ["Date", "OfficialEventName", "EventName", "Country", "Location"]
DURATIONS = ["Q1", "Q2", "Q3", "Time"]

FEATURE_KEY = ["dt_ref", "DriverId"]
LABEL = "flChampion"

# The window lengths (in rounds) of the feature table.
WINDOWS = (5, 10, 20, 40, 50)
# Fixed value: an entity stays eligible while its last season is at most this old.
SEASON_LAG = 2
# Fixed value: stand-in for missing features.
SENTINEL = -10000.0
# Fixed value: this many of the newest dates of each season are kept out of sampling.
SEASON_TAIL = 5
