import random

from pyspark.sql import functions as F

from tripspark.operators import zone_state as zs

MIN = 60
SCHEMA = "pu_zone long, dropoff_s long, trip_miles double, trip_duration_s long"


def state_of(spark, trips):
    return zs.zone_state(spark.createDataFrame(trips, SCHEMA))


def attach(spark, state, *requests):
    asked = spark.createDataFrame([(i, z, s) for i, (z, s) in enumerate(requests)], "id int, pu_zone long, request_s long")
    return {r["id"]: r for r in zs.attach_state(asked, state).collect()}


def test_only_earlier_buckets_of_the_same_zone_are_visible(spark):
    state = state_of(spark, [(1, 8 * 3600 + 2 * MIN, 1.0, 600), (1, 8 * 3600 + 7 * MIN, 1.0, 600)])
    got = attach(spark, state, (1, 8 * 3600 + 6 * MIN), (1, 8 * 3600 + 4 * MIN), (2, 9 * 3600), (1, 8 * 3600 + 12 * MIN))
    assert got[0]["completed_60m"] == 1, "the bucket before the request"
    assert got[1]["completed_60m"] is None, "the request's own bucket is not over"
    assert got[2]["completed_60m"] is None, "another zone"
    assert got[3]["completed_60m"] == 2


def test_window_is_open_on_the_left(spark):
    at = lambda m: (1, 8 * 3600 + m * MIN, 1.0, 300)
    state = {r["bucket_s"]: r for r in state_of(spark, [at(0), at(5), at(15), at(60)]).collect()}
    assert state[8 * 3600 + 15 * MIN]["completed_15m"] == 2
    assert state[9 * 3600]["completed_60m"] == 3


def test_anchored_at_the_last_active_bucket(spark):
    state = state_of(spark, [(1, 8 * 3600, 1.0, 300)])
    assert attach(spark, state, (1, 20 * 3600))[0]["completed_15m"] == 1


def test_non_positive_rides_do_not_count(spark):
    assert state_of(spark, [(1, 100, 1.0, 0), (1, 100, 1.0, -5)]).count() == 0


def test_same_result_for_any_partitioning_and_equal_to_brute_force(spark):
    rng = random.Random(5)
    # Zone 7 holds two thirds of all rows.
    trips = [(rng.choice([1, 2, 7, 7, 7, 7]), rng.randrange(0, 20_000), rng.random() * 5, rng.randrange(60, 900)) for _ in range(3000)]
    requests = [(rng.choice([1, 2, 3, 7]), rng.randrange(0, 25_000)) for _ in range(400)]
    frame = spark.createDataFrame(trips, SCHEMA)
    one, many = zs.zone_state(frame.repartition(1)), zs.zone_state(frame.repartition(8))
    got = attach(spark, one, *requests)
    again = attach(spark, many, *requests)
    buckets = {}
    for z, s, _, d in trips:
        b = buckets.setdefault((z, s // 300 * 300), [0, 0])
        b[0] += 1
        b[1] += d
    for i, (z, s) in enumerate(requests):
        earlier = [b for (bz, b) in buckets if bz == z and b < s // 300 * 300]
        want = None
        if earlier:
            last = max(earlier)
            want = sum(v[1] for (bz, b), v in buckets.items() if bz == z and last - 1800 < b <= last)
        assert got[i]["duration_s_30m"] == again[i]["duration_s_30m"] == want


def test_decayed_state_agrees_where_the_zone_was_active(spark):
    rng = random.Random(6)
    trips = [(rng.choice([1, 2]), rng.randrange(0, 9000), 1.0, rng.randrange(60, 900)) for _ in range(300)]
    buckets = zs.completions(spark.createDataFrame(trips, SCHEMA))
    rolled = zs.rolling_state(buckets)
    decayed = zs.decayed_state(buckets).select("zone", F.col("clock_s").alias("bucket_s"), F.col("duration_s_15m").alias("d"))
    assert rolled.join(decayed, ["zone", "bucket_s"]).filter("duration_s_15m <> d").count() == 0
    assert rolled.join(decayed, ["zone", "bucket_s"]).count() == rolled.count()
