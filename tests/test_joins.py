import pytest
from pyspark.sql import functions as F

from conftest import READING, at
from loadcurve.operators import diagnostics, filters, joins, projections
from loadcurve.operators.skew import align, attach, fits_broadcast, hot_keys, split_hot_keys

META = "unique_id string, location_id string, cluster_size double"
WEATHER = "location_id string, timestamp timestamp, temperature_2m double"


@pytest.fixture()
def tables(frame):
    demand = frame([(k, at(h + 0.25), float(h)) for k in ("a", "b", "c", "x") for h in range(4)] + [(None, at(1), 9.0)], READING)
    metadata = frame([("a", "L", 1.0), ("b", "M", 2.0), ("c", None, 3.0), ("d", "L", 4.0)], META)
    weather = frame([("L", at(h), 10.0 + h) for h in range(3)] + [("N", at(0), 0.0)], WEATHER)
    return demand, metadata, weather


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("limit", [0, 100])
def test_metadata_join_keeps_every_reading(tables, limit):
    demand, metadata, _ = tables
    joined = joins.join_metadata(demand, metadata, max_broadcast_rows=limit)
    assert joined.count() == demand.count()
    assert joined.columns == [*demand.columns, "location_id", "cluster_size"]
    located = {(r.unique_id, r.location_id) for r in joined.collect()}
    assert located == {("a", "L"), ("b", "M"), ("c", None), ("x", None), (None, None)}


def test_small_side_is_broadcast_and_large_side_is_salted(tables):
    demand, metadata, _ = tables
    small = joins.join_metadata(demand, metadata)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in small
    large = joins.join_metadata(demand, metadata, max_broadcast_rows=0)._jdf.queryExecution().analyzed().toString()
    assert "__salt" in large and "ResolvedHint" not in large


def test_duplicate_metadata_multiplies_rows(frame, tables):
    demand, metadata, _ = tables
    for limit in (0, 100):
        doubled = joins.join_metadata(demand, metadata.unionByName(metadata), max_broadcast_rows=limit)
        assert doubled.count() == demand.count() + 3 * 4


@pytest.mark.parametrize("limit", [0, 100])
def test_weather_join(tables, limit):
    demand, metadata, weather = tables
    located = joins.join_metadata(demand, metadata, ["location_id"])
    joined = joins.join_weather(located, weather, max_broadcast_rows=limit)
    assert joined.columns == [*located.columns, "temperature_2m"]
    assert joined.count() == demand.count()
    found = {(r.unique_id, r.timestamp): r.temperature_2m for r in joined.collect()}
    assert found["a", at(1.25)] == 11.0 and found["a", at(3.25)] is None and found["b", at(1.25)] is None


def test_readings_without_location_are_scattered(tables):
    demand, metadata, weather = tables
    located = joins.join_metadata(demand, metadata, ["location_id"])
    plan = joins.join_weather(located, weather, max_broadcast_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(unique_id" in plan


@pytest.mark.parametrize("limit", [0, 100])
def test_located_join_drops_unlocated(tables, limit):
    demand, metadata, weather = tables
    located = joins.join_located(demand, metadata, max_broadcast_rows=limit)
    assert {r.unique_id for r in located.collect()} == {"a", "b"}
    aligned = joins.join_weather_truncated(located, weather, ["temperature_2m"], max_broadcast_rows=limit)
    assert aligned.filter(F.col("temperature_2m").isNotNull()).count() == 3
    assert "timestamp_hour" in aligned.columns


def test_null_safe_attach(frame):
    fact = frame([("a", 1), (None, 2)], "k string, v int")
    dimension = frame([("a", 10), (None, 20)], "k string, w int")
    assert rows(attach(fact, dimension, ["k"], null_safe=True).select("v", "w")) == rows(frame([(1, 10), (2, 20)], "v int, w int"))
    assert attach(fact, dimension, ["k"], how="inner").count() == 1
    with pytest.raises(ValueError):
        attach(fact, dimension, ["k"], how="outer")


def test_fits_broadcast_counts_no_further_than_needed(frame):
    df = frame([(i,) for i in range(10)], "i int")
    assert fits_broadcast(df, 10) and not fits_broadcast(df, 9)


def test_key_sets(frame):
    left = frame([("a",), ("b",), (None,), ("a",)], "location_id string")
    right = frame([("b",), ("c",), (None,)], "location_id string")
    assert [r[0] for r in joins.keys_in_both(left, right).collect()] == ["b"]
    assert {r[0] for r in joins.keys_only_left(left, right).collect()} == {"a", None}
    c = diagnostics.key_coverage(left, right).first()
    assert (c.n_left, c.n_right, c.n_common, c.n_left_only) == (3, 3, 1, 2)
    assert c.n_common + c.n_left_only == c.n_left
    assert c.left_only_pct == pytest.approx(200 / 3)
    assert diagnostics.key_coverage(left.limit(0), right).first().left_only_pct is None


def test_range_alignment_classes(frame):
    demand = frame(
        [("early", at(-2)), ("early", at(5)), ("fine", at(-0.5)), ("fine", at(5.5)), ("late", at(0)), ("late", at(8)),
         ("both", at(-3)), ("both", at(9)), ("alone", at(0)), (None, at(0))],
        "location_id string, timestamp timestamp",
    )
    weather = frame(
        [(k, at(h)) for k in ("early", "fine", "late", "both", "other") for h in (0, 5)],
        "location_id string, timestamp timestamp",
    )
    found = {r.location_id: r for r in diagnostics.range_alignment(demand, weather).collect()}
    assert {k: r.issues for k, r in found.items()} == {
        "early": "starts early", "fine": "", "late": "ends late", "both": "starts early; ends late",
        "alone": "no weather", "other": "no demand", None: "null key",
    }
    assert found["early"].starts_early_seconds == 7200
    assert [r.location_id for r in diagnostics.range_alignment(demand, weather).collect()][-1] is None


def test_join_success_counts(frame):
    merged = frame([("L", 1.0), ("L", None), (None, None)], "location_id string, temperature_2m double")
    r = diagnostics.join_success(merged).first()
    assert (r.n_rows, r.n_located, r.n_located_unmatched, r.n_unmatched) == (3, 2, 1, 2)
    assert (r.located_unmatched_pct, r.unmatched_pct) == (50.0, pytest.approx(200 / 3))
    assert diagnostics.join_success(merged.limit(0)).first().unmatched_pct is None


def test_unmatched_audit_tells_false_from_true_gaps(frame):
    merged = frame(
        [("L", at(0.5), None), ("L", at(1.5), None), ("L", at(1.75), None), ("M", at(0), None), (None, at(0), None), ("L", at(2), 1.0)],
        "location_id string, timestamp timestamp, temperature_2m double",
    )
    weather = frame([("L", at(0), 1.0)], WEATHER)
    found = diagnostics.unmatched_audit(merged, weather, exclude=["M"])
    assert {tuple(r) for r in found.collect()} == {("L", at(0), True), ("L", at(1), False)}


def test_projection_helpers(frame):
    left = frame([(1, "x")], "k int, name string")
    right = frame([(1, "y", 2.0)], "k int, name string, w double")
    assert projections.join_keep_left(left, right, [("k", "k")]).columns == ["k", "name", "w"]
    df = frame([(1, 2.0, "s", 3)], "a int, y double, s string, b long")
    assert projections.numeric_columns(df) == ["a", "b"]
    assert projections.numeric_columns(df, (), ["b", "s", "absent", "y"]) == ["b", "y"]
    assert projections.prune(df, ["b", "absent", "a"]).columns == ["b", "a"]
    assert projections.derive(df, {"c": F.lit(1)}, {"a": "z"}, ["s"]).columns == ["z", "y", "b", "c"]


def test_row_filters(frame):
    nan = float("nan")
    df = frame([("a", None), ("a", nan), ("b", -1.0), (None, 2.0), ("b", 0.0)], "k string, y double")
    assert filters.with_target(df).count() == 4
    assert filters.complete_cases(df).count() == 2
    assert filters.complete_cases(df, ["y"]).count() == 3
    assert filters.non_positive(df).count() == 2 and filters.negative(df, "y").count() == 1
    assert filters.with_keys(df, "k").count() == 4
    assert filters.having_ids(df, ["a"], "k").count() == 2
    assert filters.having_ids(df, df.filter("y = 0").select("k"), "k").count() == 2
    assert df.filter(filters.valid_for_log("y", "k")).count() == 1


def test_null_tests_turn_left_join_into_inner(tables):
    demand, metadata, weather = tables
    merged = joins.join_weather(joins.join_metadata(demand, metadata), weather, max_broadcast_rows=0)
    plan = filters.complete_cases(merged, ["temperature_2m"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan.split("\n")[1] + plan.split("\n")[2] and "Join Inner" in plan


@pytest.fixture()
def skewed(spark):
    """100,000 readings of 5,000 keys; key 0 has two fifths of them, key 1 a tenth, and 3,000 have none."""
    n = F.col("id")
    key = F.when(n < 40_000, 0).when(n < 50_000, 1).when(n < 97_000, 2 + n % 4_998)
    return spark.range(100_000).select(key.alias("k"), n.alias("at"), (n % 7).alias("v"))


def largest_and_median_task(joined):
    sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


def test_hot_keys_are_found_with_their_shares(spark, skewed):
    found = dict(hot_keys(skewed.filter("k is not null").select(F.xxhash64("k").alias("h")), 8))
    names = {r.h: r.k for r in skewed.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert {names[h] for h in found} == {0, 1}
    by_key = {names[h]: parts for h, parts in found.items()}
    assert by_key[0] == 53 and by_key[1] == 14  # 40,000 and 10,000 rows, at most 757 a part
    assert hot_keys(skewed.filter("k > 1").select(F.xxhash64("k").alias("h")), 8) == []
    assert hot_keys(skewed.limit(0).select(F.xxhash64("k").alias("h")), 8) == []


def test_only_hot_keys_are_copied(spark, skewed):
    dimension = spark.range(5_100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    left, right = split_hot_keys(skewed, dimension, ["k"], ["k"], ["at"], tasks=8)
    copies = {r.k: r["count"] for r in right.groupBy("k").count().filter("count > 1").collect()}
    assert copies == {0: 64, 1: 16} and right.count() == 5_100 + 63 + 15
    salts = left.filter("k > 1").agg(F.max("__salt")).first()[0]
    assert salts == 0
    assert left.filter("k is null").select("__salt").distinct().count() > 16


def test_skewed_join_spreads_over_tasks(spark, skewed):
    """The largest task has at most twice the rows of the median, and every reading its own values."""
    dimension = spark.range(5_100).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        attached = attach(skewed, dimension, ["k"], spread_by=["at"], small=False)
        hours = dimension.withColumn("hour", F.lit(0))
        aligned = align(skewed.withColumn("hour", F.lit(0)), hours, [(F.col("k"), "k"), (F.col("hour"), "hour")], ["at"], max_broadcast_rows=0)
        for joined in (attached, aligned):
            largest, median = largest_and_median_task(joined)
            assert largest <= 2 * median
            assert joined.count() == 100_000
            assert joined.filter("w = 2 * k").count() == 97_000 and joined.filter("w is null").count() == 3_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keys_of_different_types_share_salts(spark, skewed):
    dimension = spark.range(10).select(F.col("id").cast("string").alias("k"), F.col("id").alias("w"))
    joined = attach(skewed, dimension, ["k"], how="inner", spread_by=["at"], small=False, tasks=8)
    assert joined.count() == skewed.filter("k < 10").count()


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(1_000).select(F.col("id").alias("k"), F.expr("repeat('x', 1000)").alias("text"), F.array("id").alias("a"))
    assert fits_broadcast(wide) and not fits_broadcast(wide, max_bytes=900_000)
    assert fits_broadcast(wide.select("k"), max_bytes=900_000)
    small = fits_broadcast(wide, max_bytes=900_000)
    plan = attach(spark.range(5).withColumnRenamed("id", "k"), wide, ["k"], spread_by=["k"], small=small)
    assert "__salt" in plan._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_bitmap_filter_keeps_all_matches(spark, bits):
    keys = spark.range(0, 3000, 30).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("g")).union(spark.sql("select null, 'x'"))
    reference = spark.range(100_000).select((F.col("id") % 50_000).alias("k"), F.when(F.col("id") % 3 != 1, "x").alias("g"), F.col("id").alias("v"))
    kept = joins.possible_rows(reference, keys, ["k", "g"], bits)
    matches = reference.join(keys, ["k", "g"], "left_semi")
    assert kept.columns == reference.columns
    assert kept.join(keys, ["k", "g"], "left_semi").count() == matches.count() > 0
    assert kept.count() < (1.05 * matches.count() if bits > 64 else reference.count() + 1)


def test_existing_and_absent_keys_exchange_few_rows(spark):
    keys = spark.range(100).select((F.col("id") * 7).alias("k"))
    reference = spark.range(200_000).select((F.col("id") % 350).alias("k")).filter("k % 2 = 0 or k > 340").union(spark.range(5).select(F.lit(None).cast("long")))
    found, absent = joins.existing_keys(keys, reference, ["k"]), joins.absent_keys(keys, reference, ["k"])
    want = {k for k in range(0, 700, 7) if k < 350 and (k % 2 == 0 or k > 340)}
    assert {r.k for r in found.collect()} == want and {r.k for r in absent.collect()} == set(range(0, 700, 7)) - want
    possible = joins.possible_rows(reference, keys, ["k"])
    assert possible.select("k").distinct().count() == len(want) and possible.count() < reference.count() / 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan
