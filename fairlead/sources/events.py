"""Vessel reports derived from the generic ``events`` table.

The event stream carries no positions, so a fixed arithmetic recipe turns each
event into a report of the vessel named by ``user_id``; see FIXTURES.md for the
recipe and the counts it must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.session import ensure_settings

_EPOCH_MICROS = 1704067200000000  # 2024-01-01 UTC


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncleaned reports with sentinels, bad values, exact copies and equal times.

    One scan: every event becomes one to three rows (``_k`` 0 = spoiled base row,
    1 = exact copy, 2 = same time at another position).
    """
    ensure_settings(spark)
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("_k")
    base = k == 0
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(e % 10 == 5, F.lit(1)),
            F.when(e % 101 == 1, F.lit(2)),
        )
    )
    squeezed = F.timestamp_micros(
        F.lit(_EPOCH_MICROS) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {_EPOCH_MICROS}) div 20")
    )
    latitude = 40.5 + (u % 50) * 0.01 + ((e * 7919) % 1000) * 0.00002
    longitude = -74.2 + ((u * 37) % 50) * 0.01 + ((e * 104729) % 1000) * 0.00002
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", "ts", "value"
    )
    return events.select("*", F.explode(copies).alias("_k")).select(
        (e * 4 + k).alias("ord"),
        (e * 4 + k).alias("id"),
        F.when(base & (e % 401 == 0), F.lit("BAD"))
        .otherwise((F.lit(200000000) + u).cast("string"))
        .alias("mmsi"),
        F.when(~base | (e % 409 != 0), squeezed).alias("timestamp"),
        F.when(base & (e % 419 == 0), F.lit(100.0))
        .when(k == 2, latitude + 0.001)
        .otherwise(latitude)
        .alias("latitude"),
        F.when(base & (e % 421 == 0), F.lit(200.0)).otherwise(longitude).alias("longitude"),
        F.when(e % 97 == 0, F.lit(102.3))
        .when(e % 211 == 0, F.lit(-1.0))
        .otherwise((F.round(F.col("value") * 10).cast("bigint") % 400) / 10.0)
        .alias("sog"),
        F.when(e % 41 == 0, F.lit(360.0))
        .when(e % 223 == 0, F.lit(500.0))
        .otherwise(((e * 137) % 3600) / 10.0)
        .alias("cog"),
        F.when(e % 3 == 0, F.lit(511.0))
        .when(e % 227 == 0, F.lit(400.0))
        .otherwise(((e * 53) % 360).cast("double"))
        .alias("heading"),
        F.when(base & (F.col("event_type") != "error"), F.concat(F.lit("V"), u.cast("string"))).alias(
            "vessel_name"
        ),
        (60 + u % 30).cast("int").alias("vessel_type"),
        F.col("value").alias("ml_anomaly_score"),
        F.col("event_type"),
    )
