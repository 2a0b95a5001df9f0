import pytest
from pyspark.sql import functions as F

from fairlead.operators import cleaning

COLUMNS = ["ord", "MMSI", "BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading", "Extra"]
ROWS = [
    (0, "123456789.0", "2024-06-14T00:00:00", "40.1", "-74.0", "5.5", "90.0", "91", "x"),
    (1, "123456789", "2024-06-14T00:01:00", "40.2", "-74.0", "102.3", "360.0", "511", "x"),
    (2, " 987654321 ", "not-a-time", "91", "-74.0", "-1", "361", "400", "x"),
    (3, "123456789", "2024-06-14T00:00:00Z", "40.1", "-74.0", "5.5", "90.0", "91", "x"),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    return cleaning.clean(spark.createDataFrame(ROWS, COLUMNS))


def test_split(cleaned):
    accepted = {r.ord: r for r in cleaned.accepted.collect()}
    assert set(accepted) == {0, 1}
    assert accepted[0].mmsi == "123456789"
    assert [r.ord for r in cleaned.rejected.collect()] == [2]
    assert "Extra" in cleaned.accepted.columns


def test_sentinels(cleaned):
    row = cleaned.accepted.filter("ord = 1").first()
    assert (row.sog, row.cog, row.heading) == (None, None, None)
    assert row.sog_unavailable and row.cog_unavailable and row.heading_unavailable
    assert not (row.sog_invalid or row.cog_invalid or row.heading_invalid)
    bad = cleaned.rejected.first()
    assert bad.sog_invalid and bad.cog_invalid and bad.heading_invalid and bad.invalid_latitude and bad.invalid_timestamp


def test_report(cleaned):
    report = cleaned.report.first()
    assert (report.rows_read, report.rows_clean, report.rows_rejected, report.duplicates_removed) == (4, 2, 1, 1)
    assert report.unique_mmsi_clean == 1
    assert report.earliest_timestamp.startswith("2024-06-14T00:00:00")


def test_empty_report(spark):
    report = cleaning.clean(spark.createDataFrame([], "ord long, MMSI string, BaseDateTime string, LAT string, LON string")).report.first()
    assert report.rows_read == 0 and report.earliest_timestamp is None


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="longitude, timestamp"):
        cleaning.normalize_columns(spark.createDataFrame([("1", "2")], ["MMSI", "LAT"]))


def test_numbers_keep_only_numbers(spark):
    rows = [(i, "123456789", "2024-06-14", v, "1", v) for i, v in enumerate(["1.5", "1.5d", "NaN", "x", " 2 ", "1e1", None])]
    typed = cleaning.coerce_types(spark.createDataFrame(rows, "ord int, mmsi string, timestamp string, latitude string, longitude string, sog string"))
    assert [r.sog for r in typed.orderBy("ord").collect()] == [1.5, None, None, None, 2.0, 10.0, None]


def test_hot_group_of_copies(spark):
    """A third of all rows being one report leaves one accepted row, flagged copies for the rest."""
    rows = spark.range(3000).select(
        F.col("id").alias("ord"), F.lit("111111111").alias("mmsi"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01T00:00:00")).otherwise(F.date_format(F.timestamp_seconds(F.col("id") + 1_704_070_000), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.lit("1.0").alias("latitude"), F.lit("2.0").alias("longitude"),
    )
    parts = cleaning.clean(rows)
    assert parts.accepted.count() == 2001
    assert parts.accepted.agg(F.min("ord")).first()[0] == 0
    assert parts.report.first().duplicates_removed == 999
    flags = cleaning.flag_duplicates(cleaning.coerce_types(rows))
    assert flags.filter("duplicate_record").count() == 999
    assert not flags.filter("ord = 0").first().duplicate_record


def test_constraints(spark):
    rows = [(1, 1.0, 360.0, 1.0), (2, -1.0, 1.0, 1.0), (3, None, None, None), (4, 0.0, 0.0, 359.9), (5, 1.0, 1.0, 511.0)]
    good, bad = cleaning.check_constraints(spark.createDataFrame(rows, "id int, sog double, cog double, heading double"))
    assert {r.id for r in good.collect()} == {3, 4}
    assert {r.id for r in bad.collect()} == {1, 2, 5}


def test_forms_of_times(spark):
    from datetime import datetime

    from fairlead.functions import coerce

    noon = datetime(2024, 6, 14, 12)
    forms = [
        "2024-06-14 12:00", "2024/6/14 12:00:00", "06/14/2024 12:00", "6-14-2024 12:00:00 PM", "06.14.2024T12:00", "14 Jun 2024 12:00",
        "14-JUNE-2024 12:00:00", "June 14, 2024 12:00 pm", "Jun. 14 2024, 12:00", "1718366400", "1718366400.0", "1718366400000",
        "1718366400000000", "06/14/2024 14:00+02:00", "6/14/2024 12:00PM",
    ]
    bad = ["14/06/2024 12:00", "31 Foo 2024", "13 13 2024", "June", "12:00", "17183664", "2024", "nan", "02/30/2024", "", "Junk 14, 2024", None]
    df = spark.createDataFrame([(t,) for t in forms + bad], "timestamp string")
    got = [r[0] for r in df.select(coerce.instant(df, "timestamp")).collect()]
    assert dict(zip(forms, got)) == {f: noon for f in forms}
    # A name is told by its first three letters.
    assert dict(zip(bad, got[len(forms):])) == {t: datetime(2024, 6, 14) if t == "Junk 14, 2024" else None for t in bad}


def test_order_of_day_and_month_is_decided_per_file(spark):
    from datetime import datetime

    from fairlead.functions import coerce

    df = spark.createDataFrame([("01/02/2024 00:00",), ("14/06/2024 00:00",), ("x",)], "timestamp string")
    assert coerce.is_day_first(df, "timestamp")
    assert [r[0] for r in df.select(coerce.instant(df, "timestamp", day_first=True)).collect()] == [datetime(2024, 2, 1), datetime(2024, 6, 14), None]
    for other in ([("01/02/2024",)], [("14/06/2024",), ("06/14/2024",)], [(None,)]):
        assert not coerce.is_day_first(spark.createDataFrame(other, "timestamp string"), "timestamp")
