"""Window functions over series."""

from __future__ import annotations

from checks.aggregates import GAPS
from checks.fixtures import DAILY_TIES, Tables
from checks.registry import check, rounded
from loadcurve.operators import rolling, timeseries, topk


@check("w01_gaps", GAPS + "SELECT * FROM gaps")
def _(t: Tables):
    return timeseries.intervals(t.readings)


@check("w01_gaps_of_split_series", GAPS + "SELECT * FROM gaps")
def _(t: Tables):
    # the way taken for series too long for one task
    return timeseries.intervals(t.readings, max_series_rows=50)


@check("w01_weather_gaps", GAPS + "SELECT * FROM daily_gaps")
def _(t: Tables):
    return timeseries.intervals(t.daily, "location_id")


def rolling_sql(source: str, order: str, digits: int, windows, frame, extra: str = "") -> str:
    functions = {"mean": "avg", "stddev": "stddev_samp", "min": "min", "max": "max"}
    columns = ", ".join(
        (f"round({f}(y) OVER w{n}, {digits})" if s in ("mean", "stddev") else f"{f}(y) OVER w{n}") + f" AS y_rolling_{s}_{n}h"
        for n in windows for s, f in functions.items()
    )
    specs = ", ".join(f"w{n} AS (PARTITION BY unique_id ORDER BY {order} {frame(n)})" for n in windows)
    return f"""SELECT unique_id, "timestamp", y{extra}, {columns} FROM {source} WINDOW {specs}"""


def last_rows(n: int) -> str:
    return f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"


def rows_before(n: int) -> str:
    return f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def last_hours(n: int) -> str:
    return f"RANGE BETWEEN {n * 3_600_000_000 - 1} PRECEDING AND CURRENT ROW"


def hours_before(n: int) -> str:
    return f"RANGE BETWEEN {n * 3_600_000_000} PRECEDING AND 1 PRECEDING"


ROLLED = [f"y_rolling_{s}_{n}h" for n in rolling.FEATURE_WINDOWS for s in ("mean", "stddev")]
BY_TIME, BY_MICROS = '"timestamp"', 'epoch_us("timestamp")'


@check("w02_rolling_stats", rolling_sql("readings", BY_TIME, 5, rolling.FEATURE_WINDOWS, last_rows))
def _(t: Tables):
    return rounded(rolling.rolling_features(t.readings, windows=rolling.FEATURE_WINDOWS), 5, *ROLLED)


@check("w02_rolling_stats_of_split_series", rolling_sql("readings", BY_TIME, 5, rolling.FEATURE_WINDOWS, last_rows))
def _(t: Tables):
    # the way taken for series too long for one task; 20 rows force frames across several chunks
    rolled = rolling.rolling_features(t.readings, windows=rolling.FEATURE_WINDOWS, max_series_rows=20)
    return rounded(rolled, 5, *ROLLED)


@check("w02_rolling_stats_before_record", rolling_sql("readings", BY_TIME, 5, rolling.FEATURE_WINDOWS, rows_before))
def _(t: Tables):
    rolled = rolling.rolling_features(t.readings, windows=rolling.FEATURE_WINDOWS, include_current=False)
    return rounded(rolled, 5, *ROLLED)


@check("w02_rolling_stats_in_hours", rolling_sql("readings", BY_MICROS, 5, rolling.FEATURE_WINDOWS, last_hours))
def _(t: Tables):
    rolled = rolling.rolling_features(t.readings, windows=rolling.FEATURE_WINDOWS, frame="range")
    return rounded(rolled, 5, *ROLLED)


@check("w02_rolling_hours_of_split_series", rolling_sql("readings", BY_MICROS, 5, (3, 24), hours_before))
def _(t: Tables):
    rolled = rolling.rolling_features(
        t.readings, windows=(3, 24), frame="range", include_current=False, max_series_rows=20
    )
    return rounded(rolled, 5, *(c for c in ROLLED if c.endswith(("_3h", "_24h"))))


@check(
    "w02_rolling_stats_with_tiebreak",
    rolling_sql("orders_demand", '"timestamp", o_orderkey', 3, rolling.DEFAULT_WINDOWS, last_rows, ", o_orderkey"),
)
def _(t: Tables):
    rolled = rolling.rolling_features(t.orders_demand, tiebreak=["o_orderkey"])
    return rounded(rolled, 3, *(c for c in ROLLED if not c.endswith("_48h")))


@check(
    "w03_intervals_per_series",
    GAPS + """SELECT * FROM (SELECT unique_id, diff_seconds, count(*) AS count,
                CAST(row_number() OVER (PARTITION BY unique_id ORDER BY count(*) DESC, diff_seconds) AS INTEGER) AS rank
              FROM gaps GROUP BY 1, 2) WHERE rank <= 5""",
)
def _(t: Tables):
    return timeseries.top_intervals(timeseries.intervals(t.readings))


@check(
    "w03_intervals_per_location",
    GAPS + """SELECT * FROM (SELECT location_id, diff_seconds, count(*) AS count,
                CAST(row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, diff_seconds) AS INTEGER) AS rank
              FROM daily_gaps GROUP BY 1, 2) WHERE rank <= 5""",
)
def _(t: Tables):
    return timeseries.top_intervals(timeseries.intervals(t.daily, "location_id"), "location_id")


@check("w04_first_row_per_key", """SELECT location_id, "timestamp", temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m FROM daily""")
def _(t: Tables):
    unique = timeseries.deduplicate_ordered(t.daily_raw, ["location_id", "timestamp"], DAILY_TIES)
    return unique.select("location_id", "timestamp", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m")


@check(
    "w04_largest_orders_per_customer",
    """SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders)
       WHERE rank <= 3""",
)
def _(t: Tables):
    from pyspark.sql import functions as F

    orders = t.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.rank_in_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
