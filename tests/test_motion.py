import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairlead.operators import motion, slices

SCHEMA = "id long, mmsi string, timestamp string, latitude double, longitude double, sog double, cog double, heading double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.col("id"))


def test_track_on_equator(spark):
    rows = [
        (1, "123456789", "2024-01-01T00:00:00Z", 0.0, 0.0, 60.0, 350.0, 10.0),
        (2, "123456789", "2024-01-01T01:00:00Z", 0.0, 1.0, 70.0, 10.0, 25.0),
        (3, "123456789", "2024-01-01T02:00:00Z", 0.0, 2.0, 70.0, 25.0, 25.0),
    ]
    got = motion.vessel_trajectory_metrics(frame(spark, rows)).orderBy("ord").collect()
    assert got[0].distance_nm is None and got[0].cumulative_distance_nm == 0.0
    assert got[1].distance_nm == pytest.approx(60.04, rel=0.001)
    assert got[2].cumulative_distance_nm == pytest.approx(120.08, rel=0.001)
    assert got[1].acceleration_knots_per_minute == pytest.approx(10 / 60)
    assert got[1].course_change_degrees == pytest.approx(20.0)
    assert got[1].heading_change_degrees == pytest.approx(15.0)
    assert got[1].speed_difference_knots == pytest.approx(60.04 - 70, rel=0.01)


def test_exactly_one_vessel(spark):
    two = frame(spark, [(1, "123456789", "2024-01-01", 0.0, 0.0, 1.0, 1.0, 1.0), (2, "223456789", "2024-01-01", 0.0, 0.0, 1.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="exactly one"):
        motion.vessel_trajectory_metrics(two)
    with pytest.raises(ValueError, match="No AIS records"):
        motion.vessel_trajectory_metrics(two, "999999999")
    assert motion.vessel_trajectory_metrics(two, "123456789").count() == 1


def test_vessels_do_not_mix_and_equal_times(spark):
    rows = [
        (1, "111111111", "2024-01-01T00:00:00Z", 0.0, 0.0, 10.0, 359.0, 0.0),
        (2, "222222222", "2024-01-01T00:00:30Z", 50.0, 9.0, 3.0, 100.0, 0.0),
        (3, "111111111", "2024-01-01T00:01:00Z", 0.0, 0.01, 12.0, 1.0, 0.0),
        (4, "111111111", "2024-01-01T00:01:00Z", 0.0, 0.02, 12.0, 1.0, 0.0),
    ]
    got = {r.id: r for r in motion.live_features(frame(spark, rows)).collect()}
    assert got[1].elapsed_seconds is None and got[2].elapsed_seconds is None
    assert got[3].course_change_degrees == pytest.approx(2.0)
    assert got[3].absolute_acceleration_knots_per_minute == pytest.approx(2.0)
    assert got[4].nonpositive_time_interval and got[4].calculated_speed_knots is None
    assert got[4].distance_nm == pytest.approx(0.6, rel=0.01)
    masked = {r.id: r for r in motion.trajectory_metrics(frame(spark, rows)).collect()}
    assert masked[4].distance_nm is None and masked[4].course_change_degrees is None


def test_empty_input_is_typed(spark):
    got = motion.live_features(frame(spark, []).limit(0))
    assert got.count() == 0 and dict(got.dtypes)["turn_rate_degrees_per_minute"] == "double"


def _random_reports(spark, rows=4000, seed=5):
    """One vessel holds half of the rows; days without reports, equal times, gaps in measures."""
    rng = np.random.default_rng(seed)
    mmsi = np.where(rng.random(rows) < 0.5, 100, rng.integers(101, 120, rows))
    seconds = rng.integers(0, 40 * 86400, rows) // 600 * 600
    pdf = pd.DataFrame({
        "id": np.arange(rows), "mmsi": [str(100000000 + m) for m in mmsi],
        "timestamp": pd.to_datetime(1_704_067_200 + seconds, unit="s", utc=True),
        "latitude": rng.uniform(-60, 60, rows), "longitude": rng.uniform(-180, 180, rows),
        "sog": np.where(rng.random(rows) < 0.2, np.nan, rng.uniform(0, 30, rows)),
        "cog": rng.uniform(0, 360, rows), "heading": rng.uniform(0, 360, rows),
    })
    df = spark.createDataFrame(pdf).withColumn("sog", F.when(~F.isnan("sog"), F.col("sog"))).withColumn("ord", F.col("id"))
    return pdf, df.repartition(7)


def test_sliced_previous_equals_plain_sort(spark):
    pdf, df = _random_reports(spark)
    for seconds in (3600, 6 * 3600, 100 * 86400):
        got = slices.with_previous(df, ["id", "sog"], seconds=seconds).select("id", "_prev.id", F.col("_prev").isNull()).toPandas()
        got.columns = ["id", "prev", "first"]
        ordered = pdf.sort_values(["mmsi", "timestamp", "id"])
        expected = ordered.assign(prev=ordered.groupby("mmsi")["id"].shift()).set_index("id")["prev"]
        merged = got.set_index("id").join(expected.rename("want"))
        assert len(merged) == len(pdf)
        assert (merged["prev"].fillna(-1) == merged["want"].fillna(-1)).all()


def test_sliced_running_sum_and_position(spark):
    pdf, df = _random_reports(spark)
    ordered = pdf.sort_values(["mmsi", "timestamp", "id"])
    linked = slices.with_slice(df, "mmsi", "timestamp", "ord", 6 * 3600)
    sums = slices.with_running_sum(linked, "sog", "total").select("id", "total").toPandas().set_index("id")["total"]
    want = ordered.assign(t=ordered["sog"].fillna(0).groupby(ordered["mmsi"]).cumsum()).set_index("id")["t"]
    assert np.allclose(sums.sort_index(), want.sort_index())
    at = slices.with_position(df, "at", count="n").select("id", "at", "n").toPandas().set_index("id").sort_index()
    place = (ordered.groupby("mmsi").cumcount() + 1).set_axis(ordered["id"]).sort_index()
    assert (at["at"] == place).all()
    assert (at["n"] == ordered.set_index("id").sort_index()["mmsi"].map(pdf["mmsi"].value_counts())).all()


def test_rows_without_vessel_or_time(spark):
    rows = [
        (1, None, "2024-01-01T00:00:00Z", 0.0, 0.0, 1.0, 1.0, 1.0),
        (2, None, "2024-01-01T00:01:00Z", 0.0, 0.0, 1.0, 1.0, 1.0),
        (3, "111111111", None, 0.0, 0.0, 1.0, 1.0, 1.0),
        (4, "111111111", "2024-01-01T00:01:00Z", 0.0, 0.1, 1.0, 1.0, 1.0),
    ]
    got = {r.id: r for r in motion.ais_features(frame(spark, rows)).collect()}
    assert len(got) == 4
    assert got[1].distance_nm is None and got[2].distance_nm is None and got[4].distance_nm is None
    assert got[3].distance_nm == pytest.approx(6.0, rel=0.01) and got[3].elapsed_seconds is None
