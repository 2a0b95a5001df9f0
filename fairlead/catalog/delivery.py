"""Queries of file sources, sinks and incremental ingestion.

Their input files are written from the derived reports first, below the shared
folder, and grow with the tables.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from fairlead.catalog import oracle_base as o
from fairlead.catalog.oracle_base import r, rs
from fairlead.catalog.registry import query
from fairlead.operators import cleaning, hybrid, iforest
from fairlead.session import cut_lineage, scratch_path
from fairlead.sources import files, replay
from fairlead.streaming import importers, ingest, stages
from fairlead.streaming.folder import changed_files
from fairlead.streaming.stateful import end_marker, report_stream, stateful_motion
from fairlead.streaming.store import Store

_SOURCE_NAMES = {
    "mmsi": "MMSI", "timestamp": "BaseDateTime", "latitude": "LAT", "longitude": "LON", "sog": "SOG", "cog": "COG",
    "heading": "Heading", "vessel_name": "Vessel Name", "vessel_type": "VesselType",
}
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _once(w, name: str, build):
    if name not in w._tables:
        w._tables[name] = build()
    return w._tables[name]


def _as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", _ISO))


def _raw_csv(w) -> str:
    def build() -> str:
        path = scratch_path(w.spark, "raw-csv")
        renamed = _as_text(w.raw()).orderBy("ord").select([F.col(c).alias(n) for c, n in _SOURCE_NAMES.items()])
        renamed.write.option("header", True).csv(path)
        return path

    return _once(w, "raw_csv", build)


@query("scan_raw_csv", o.sql(f"SELECT mmsi, us AS timestamp, {rs('latitude', 'longitude', 'sog')}, vessel_name FROM clean", *o.TO_CLEAN))
def _(w):
    scanned = files.scan_raw_csv(w.spark, _raw_csv(w))
    return cleaning.clean(scanned).accepted.select("mmsi", "timestamp", "latitude", "longitude", "sog", "vessel_name")


@query("normalize_columns", o.sql("SELECT mmsi, vessel_name, CAST(vessel_type AS VARCHAR) AS vessel_type FROM raw", o.RAW))
def _(w):
    return cleaning.normalize_columns(files.scan_raw_csv(w.spark, _raw_csv(w))).select("mmsi", "vessel_name", "vessel_type")


@query("scan_typed_csv", o.sql(f"SELECT mmsi, us AS timestamp, {rs('latitude', 'longitude', 'sog', 'cog', 'heading')}, CAST(vessel_type AS BIGINT) AS vessel_type FROM raw", o.RAW))
def _(w):
    schema = (
        "MMSI string, BaseDateTime timestamp, LAT double, LON double, SOG double, COG double, Heading double, "
        "`Vessel Name` string, VesselType int"
    )
    typed = files.scan_typed_csv(w.spark, _raw_csv(w), schema)
    names = {n: c for c, n in _SOURCE_NAMES.items()}
    return typed.select([F.col(f"`{n}`").alias(c) for n, c in names.items() if c != "vessel_name"])


@query("scan_bom_csv", o.sql("SELECT mmsi, us AS timestamp FROM raw WHERE us IS NOT NULL", o.RAW))
def _(w):
    path = scratch_path(w.spark, "bom-csv")
    marked = _as_text(w.raw()).select(F.col("timestamp").alias("﻿timestamp"), "mmsi")
    marked.write.option("header", True).csv(path)
    rows, _ = files.scan_replay_csv(w.spark, path)
    return rows.select("mmsi", "timestamp")


@query("scan_columns_pruned", o.sql("SELECT mmsi, us AS timestamp FROM raw", o.RAW))
def _(w):
    """Two columns of the report files; the reader parses no others."""
    raw = files.scan_columns(w.spark, _raw_csv(w), ["MMSI", "BaseDateTime"])
    return raw.select(F.col("MMSI").alias("mmsi"), F.col("BaseDateTime").cast("timestamp").alias("timestamp"))


def _copy(w, source: str, target: str) -> None:
    """Copy one file on the shared file system; names are taken literally."""
    hadoop, conf = w.spark._jvm.org.apache.hadoop.fs, w.spark._jsc.hadoopConfiguration()
    source, target = hadoop.Path(source), hadoop.Path(target)
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)


def _file_names(w) -> list[str]:
    return [r["name"] for r in files.list_files(w.spark, _raw_csv(w)).select("name").orderBy("name").collect()]


def _odd_names(w) -> str:
    """The raw files under names that are no plain URIs."""

    def build() -> str:
        folder = scratch_path(w.spark, "odd-names")
        for i, name in enumerate(_file_names(w)):
            _copy(w, f"{_raw_csv(w)}/{name}", f"{folder}/day {i} #{i}?100%[a].csv")
        return folder

    return _once(w, "odd_names", build)


def _digest_totals(w, found, folder: str):
    """Files against the folder they come from: every file once, true sizes and digests, and their rows."""
    content = w.spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    held = content.select(name.alias("name"), "length", F.sha2("content", 256).alias("own"))
    rows = w.spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(folder).agg(F.count(F.lit(1)).alias("rows"))
    same = (F.col("size_bytes") == F.col("length")) & (F.col("content_sha256") == F.col("own"))
    joined = held.join(found, "name", "full_outer").agg(
        F.every(F.coalesce(same, F.lit(False))).alias("files_hold"), (F.count(F.lit(1)) == F.count_distinct("name")).alias("each_once")
    )
    return rows.crossJoin(joined)


_DIGEST_SQL = o.sql("SELECT count(*) AS rows, TRUE AS files_hold, TRUE AS each_once FROM raw", o.RAW)


@query("file_digest_scan", _DIGEST_SQL)
def _(w):
    """Digests of files with blanks, number signs, question marks, percent signs and brackets in their names."""
    folder = _odd_names(w)
    return _digest_totals(w, files.file_digests(w.spark, folder).select("name", "size_bytes", "content_sha256"), folder)


@query("sink_csv", o.sql(f"SELECT id, mmsi, us AS timestamp, {rs('latitude', 'longitude', 'sog')} FROM clean", *o.TO_CLEAN))
def _(w):
    path = scratch_path(w.spark, "clean-csv")
    columns = ["id", "mmsi", "timestamp", "latitude", "longitude", "sog"]
    files.write_csv(w.messages().select(*columns), path)
    schema = "id bigint, mmsi string, timestamp timestamp, latitude double, longitude double, sog double"
    return files.scan_typed_csv(w.spark, path, schema).select(*columns)


@query(
    "sink_json_report",
    o.sql("SELECT count(*) AS rows_read, count(*) FILTER (WHERE is_valid_core_record AND NOT duplicate_record) AS rows_clean, "
          "count(*) FILTER (WHERE duplicate_record) AS duplicates_removed FROM std", *o.BASE),
)
def _(w):
    path = scratch_path(w.spark, "quality-json")
    files.write_json_report(cleaning.quality_report(w.standardized()), path)
    return w.spark.read.schema("rows_read bigint, rows_clean bigint, duplicates_removed bigint").json(path)


@query(
    "write_time_batches",
    o.sql("SELECT sequence, count(*) AS reports, count(DISTINCT mmsi) AS vessels FROM (SELECT mmsi, dense_rank() OVER "
          "(ORDER BY (us - (SELECT min(us) FROM clean)) // 300000000) AS sequence FROM clean) GROUP BY sequence", *o.TO_CLEAN),
)
def _(w):
    from datetime import datetime

    path = scratch_path(w.spark, "batches")
    replay.write_time_batches(
        replay.replay(w.messages().select("mmsi", "timestamp", "latitude", "longitude"), datetime(2025, 1, 1)), path
    )
    written = w.spark.read.option("header", True).csv(path)
    return written.groupBy("sequence").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("mmsi").alias("vessels"))


# --- ingestion of two deliveries: the first day, then the rest -------------------------


def _store(w) -> Store:
    """A deployment that received both deliveries, with all analytics after each."""

    def build() -> Store:
        store = Store(w.spark, scratch_path(w.spark, "store"))
        late = F.coalesce(F.col("timestamp") >= F.expr("timestamp '2024-01-02 00:00:00'"), F.lit(False))
        for number, part in enumerate((~late, late)):
            path = scratch_path(w.spark, f"delivery-{number}")
            columns = [
                "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading", "vessel_name", "vessel_type",
                "sog_unavailable", "cog_unavailable", "heading_unavailable",
            ]
            rows = _as_text(w.standardized().filter(part).orderBy("ord")).select(*columns)
            rows.write.option("header", True).csv(path)
            for job in ingest.ingest_directory(store, path):
                if job.status != "completed" or job.analytics_status == "failed":
                    raise RuntimeError(f"{job.source_file}: {job.error_message or job.analytics_error}")
        return store

    return _once(w, "store", build)


def _raw_store(w) -> Store:
    """The raw reports, sentinels and all, imported as they come."""

    def build() -> Store:
        store = Store(w.spark, scratch_path(w.spark, "raw-store"))
        path = scratch_path(w.spark, "raw-delivery")
        _as_text(w.raw().orderBy("ord")).drop("ord", "id").write.option("header", True).csv(path)
        for job in ingest.ingest_directory(store, path, stages=None):
            if job.status != "completed":
                raise RuntimeError(f"{job.source_file}: {job.error_message}")
        return store

    return _once(w, "raw_store", build)


_IMPORTED = """
ok AS (SELECT *, NOT coalesce(sog < 0, FALSE) AND NOT coalesce(cog < 0 OR cog >= 360, FALSE)
              AND NOT coalesce(heading < 0 OR heading >= 360, FALSE) AS inside
       FROM raw WHERE us IS NOT NULL AND mmsi <> 'BAD' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)"""


@query(
    "import_messages",
    o.sql(
        """SELECT (SELECT count(*) FROM raw) AS rows_read, (SELECT count(*) FROM raw) - (SELECT count(*) FROM ok) AS rows_rejected,
        count(*) FILTER (WHERE NOT inside) AS rows_quarantined,
        count(DISTINCT (mmsi, us, latitude, longitude)) FILTER (WHERE inside) AS rows_imported,
        count(*) FILTER (WHERE inside) - count(DISTINCT (mmsi, us, latitude, longitude)) FILTER (WHERE inside) AS duplicates_skipped FROM ok""",
        o.RAW, _IMPORTED,
    ),
)
def _(w):
    """Counters of all jobs of the raw import."""
    names = ("rows_read", "rows_rejected", "rows_quarantined", "rows_imported", "duplicates_skipped")
    return _raw_store(w).registry.jobs().agg(*[F.sum(c).alias(c) for c in names])


@query(
    "import_quarantine",
    o.sql(f"SELECT DISTINCT mmsi, us AS timestamp, {rs('latitude', 'longitude')} FROM ok WHERE NOT inside", o.RAW, _IMPORTED),
)
def _(w):
    """Identities of the reports that the stored limits keep out."""
    return _raw_store(w).quarantine.read().select("mmsi", "timestamp", "latitude", "longitude").distinct()


@query(
    "ingest_batch",
    o.sql(f"SELECT mmsi, us AS timestamp, {rs('latitude', 'longitude', 'sog', 'cog', 'heading')}, sog_unavailable FROM clean", *o.TO_CLEAN),
)
def _(w):
    return _store(w).messages.read().select(
        "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading", "sog_unavailable"
    )


@query(
    "file_registry_finish",
    o.sql("SELECT 'completed' AS status, 'completed' AS analytics_status, count(*) AS rows_read, "
          "count(*) FILTER (WHERE is_valid_core_record AND NOT duplicate_record) AS rows_imported, count(*) FILTER (WHERE NOT is_valid_core_record) AS rows_rejected, "
          "count(*) FILTER (WHERE is_valid_core_record AND duplicate_record) AS duplicates_skipped FROM std", *o.BASE),
)
def _(w):
    counters = ("rows_read", "rows_imported", "rows_rejected", "duplicates_skipped")
    return _store(w).registry.jobs().groupBy("status", "analytics_status").agg(*[F.sum(c).alias(c) for c in counters])


@query("file_registry_claim", o.sql("SELECT count(*) > 0 AS known_files, 0 AS claimed_again FROM clean", *o.TO_CLEAN))
def _(w):
    """Every delivered file offered once more: all completed, none is claimed."""
    registry = _store(w).registry
    offered = registry.jobs().select(
        F.col("source_file").alias("path"), F.element_at(F.split("source_file", "/"), -1).alias("name"),
        "size_bytes", F.col("job_id").alias("content_sha256"), "header",
    )
    again = registry.claim(offered, ingest.FILES_PER_BATCH)
    return offered.agg((F.count(F.lit(1)) > 0).alias("known_files"), F.lit(len(again)).cast("bigint").alias("claimed_again"))


@query("incremental_file_source", _DIGEST_SQL)
def _(w):
    """The delivered raw files as a stream reads them, half of them replaced between two triggers: the last offer of each."""
    out, checkpoint, folder = (scratch_path(w.spark, f"files-{n}") for n in ("out", "checkpoint", "folder"))
    names = _file_names(w)

    def offer():
        stream = (
            changed_files(w.spark, folder, f"{checkpoint}/offered").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        stream.awaitTermination()

    # Half of the names come first, with the content of another file.
    for name in names[::2]:
        _copy(w, f"{_raw_csv(w)}/{names[-1]}", f"{folder}/{name}")
    offer()
    for name in names:
        _copy(w, f"{_raw_csv(w)}/{name}", f"{folder}/{name}")
    offer()
    offer()
    offers = w.spark.read.parquet(out).groupBy("name").agg(
        F.count(F.lit(1)).alias("offers"), F.max(F.struct("modified_at", "size_bytes", "content_sha256")).alias("last")
    )
    # An offer too many or too few makes the file wrong.
    right = F.when(F.col("name").isin(names[::2]), 2).otherwise(1) == F.col("offers")
    return _digest_totals(w, offers.filter(right).select("name", "last.size_bytes", "last.content_sha256"), folder)


def _assessed_store(w) -> tuple[Store, DataFrame, DataFrame]:
    """A deployment with messages only, and files of alerts and assessments made elsewhere, some of them unusable."""

    def build():
        store = Store(w.spark, scratch_path(w.spark, "assessed-store"))
        messages = scratch_path(w.spark, "assessed-messages")
        _as_text(w.standardized().orderBy("ord")).drop("ord", "id").write.option("header", True).csv(messages)
        ingest.ingest_directory(store, messages, stages=None)
        counters = []
        for name, rows, importer in (("alerts", w.alerts(), importers.import_alerts), ("risks", w.risks(), importers.import_risks)):
            own = F.col("message_id")
            spoiled = rows.withColumns(
                {
                    # Every 11th row has a broken number, every 13th a vessel nobody knows.
                    "mmsi": F.when(own % 11 == 0, "12").when(own % 13 == 0, "999999999").otherwise(F.col("mmsi")),
                    "timestamp": F.date_format("timestamp", _ISO),
                }
            ).drop("message_id")
            path = scratch_path(w.spark, f"{name}-file")
            spoiled.unionByName(spoiled).write.option("header", True).csv(path)
            counters.append(importer(store, path))
        return store, *counters

    return _once(w, "assessed_store", build)


def _import_sql(table: str, key: str) -> str:
    return o.sql(
        f"""SELECT 2 * count(*) AS rows_read, 2 * count(*) FILTER (WHERE message_id % 11 = 0) AS rows_rejected,
        2 * count(*) FILTER (WHERE message_id % 11 <> 0 AND message_id % 13 = 0) AS messages_not_found,
        count(DISTINCT {key}) FILTER (WHERE message_id % 11 <> 0 AND message_id % 13 <> 0) AS rows_imported,
        2 * count(*) FILTER (WHERE message_id % 11 <> 0 AND message_id % 13 <> 0)
          - count(DISTINCT {key}) FILTER (WHERE message_id % 11 <> 0 AND message_id % 13 <> 0) AS duplicates_skipped FROM {table}""",
        *(o.TO_ALERTS if table == "alerts" else o.TO_RISK),
    )


@query("import_alerts", _import_sql("alerts", "(mmsi, us, latitude, longitude, anomaly_type)"))
def _(w):
    return _assessed_store(w)[1]


@query("import_risks", _import_sql("risk", "(mmsi, us)"))
def _(w):
    return _assessed_store(w)[2]


@query(
    "imported_alerts",
    o.sql(f"SELECT DISTINCT mmsi, us AS timestamp, anomaly_type, severity, {rs('metric_value', 'threshold')} FROM alerts WHERE message_id % 11 <> 0 AND message_id % 13 <> 0", *o.TO_ALERTS),
)
def _(w):
    stored = _assessed_store(w)[0].alerts.read()
    return stored.select("mmsi", "timestamp", "anomaly_type", "severity", "metric_value", "threshold").distinct()


@query("stored_vessels", o.sql("SELECT mmsi, vessel_type, first_seen, last_seen FROM vessels", *o.TO_CLEAN, o.VESSELS))
def _(w):
    return _store(w).vessels.read().select("mmsi", "vessel_type", "first_seen", "last_seen")


@query("live_rule_stage", o.sql(f"SELECT mmsi, us AS timestamp, anomaly_type, {rs('latitude', 'longitude', 'metric_value')} FROM alerts", *o.TO_ALERTS))
def _(w):
    return _store(w).alerts.read().select("mmsi", "timestamp", "anomaly_type", "latitude", "longitude", "metric_value")


def _late_store(w) -> Store:
    """Every other report comes a delivery late, and what it follows is judged again."""

    def build() -> Store:
        store = Store(w.spark, scratch_path(w.spark, "late-store"))
        late = F.pmod(F.xxhash64("mmsi", "timestamp"), F.lit(2)) == 0
        for number, part in enumerate((late, ~late)):
            path = scratch_path(w.spark, f"late-delivery-{number}")
            rows = _as_text(w.messages().filter(part).orderBy("id"))
            rows.select("mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "heading").write.option("header", True).csv(path)
            for job in ingest.ingest_directory(store, path, stages.RECOMPUTING_STAGES[:1]):
                if job.status != "completed" or job.analytics_status == "failed":
                    raise RuntimeError(f"{job.source_file}: {job.error_message or job.analytics_error}")
        return store

    return _once(w, "late_store", build)


@query("recompute_successors", o.sql(f"SELECT mmsi, us AS timestamp, anomaly_type, {rs('latitude', 'longitude', 'metric_value')} FROM alerts", *o.TO_ALERTS))
def _(w):
    """Alerts after two deliveries in the wrong order: those of one batch run over all reports."""
    return _late_store(w).alerts.read().select("mmsi", "timestamp", "anomaly_type", "latitude", "longitude", "metric_value")


@query(
    "baseline_versions",
    o.sql(
        """SELECT version, count(*) AS assessments FROM (
            SELECT CASE WHEN us // 86400000000 = 19723 THEN '2024-01-01.open' ELSE strftime(to_timestamp(86400 * (
                SELECT us // 86400000000 FROM clean WHERE us // 86400000000 < (SELECT max(us // 86400000000) FROM clean)
                GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS version FROM clean)
        GROUP BY version""",
        *o.TO_CLEAN,
    ),
)
def _(w):
    """Assessments by the version of the baseline they name: the first delivery's, and that of the densest complete day."""
    version = F.element_at(F.split("assessment_version", "@"), -1).alias("version")
    return _store(w).risks.read().groupBy(version).agg(F.count(F.lit(1)).alias("assessments"))


@query(
    "live_risk_stage",
    o.sql("SELECT mmsi, us AS timestamp, CAST(rule_flag_count AS BIGINT) AS rule_flag_count, rule_severity, TRUE AS score_holds, TRUE AS percentile_holds, TRUE AS level_holds FROM pct", *o.TO_RISK),
)
def _(w):
    """Stored assessments; score, percentile and level once more from the version each names and the rules of all reports."""
    store = _store(w)
    keys = store.messages.read().select("mmsi", "timestamp").distinct()
    annotated = stages.BatchContext(keys).annotated(store)
    names = [r[0] for r in store.risks.read().select("assessment_version").distinct().collect()]
    again = None
    for name in names:
        baseline = stages.load_baseline(store, name.split("@")[1])
        own = hybrid.assess(cut_lineage(iforest.score(annotated, baseline.forest)), baseline.reference).select(
            F.col("id").alias("message_id"), F.lit(name).alias("assessment_version"), F.col("ml_anomaly_score").alias("score"),
            F.col("ml_anomaly_percentile").alias("percentile"), F.col("risk_level").alias("level"),
        )
        again = own if again is None else again.unionByName(own)
    joined = store.risks.read().join(again, ["message_id", "assessment_version"], "left")
    close = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < 1e-9, F.lit(False))
    return joined.select(
        "mmsi", "timestamp", F.col("rule_flag_count").cast("bigint").alias("rule_flag_count"), "rule_severity",
        close("ml_anomaly_score", "score").alias("score_holds"), close("ml_anomaly_percentile", "percentile").alias("percentile_holds"),
        F.coalesce(F.col("risk_level") == F.col("level"), F.lit(False)).alias("level_holds"),
    )


def _encounters_at(clean: str, suffix: str) -> str:
    text = o.LATEST + "," + o.SCAN20 + "," + o.ENC
    for name in ("latest", "snap", "pairs", "scan1", "scan2", "scan3", "scan4", "scan5", "scan", "enc"):
        for before, after in (("\n", " AS ("), ("FROM ", ""), ("JOIN ", "")):
            text = text.replace(f"{before}{name}{after or ' '}", f"{before}{name}_{suffix}{after or ' '}")
            if not after:
                text = text.replace(f"{before}{name})", f"{before}{name}_{suffix})")
    return text.replace("FROM clean)", f"FROM {clean})")


_EARLY = f"\nearly AS (SELECT * FROM clean WHERE us < {o.ORIGIN + 86_400_000_000})"
_PAIR = f"mmsi_a, mmsi_b, observed_at_a, observed_at_b, risk_level, reasons, {rs('current_distance_nm', 'cpa_distance_nm', 'tcpa_minutes')}"


@query(
    "live_collision_stage",
    o.sql(f"SELECT {_PAIR} FROM enc_one UNION SELECT {_PAIR} FROM enc_two", *o.TO_CLEAN, _EARLY, _encounters_at("early", "one"), _encounters_at("clean", "two")),
)
def _(w):
    return _store(w).encounters.read().select(
        "mmsi_a", "mmsi_b", "observed_at_a", "observed_at_b", "risk_level", "reasons", "current_distance_nm", "cpa_distance_nm", "tcpa_minutes"
    )


_STAGES_SQL = o.sql("SELECT 'rule_anomalies' AS stage, (SELECT count(*) FROM clean) AS processed, (SELECT count(*) FROM alerts) AS created "
          "UNION ALL SELECT 'hybrid_risk', (SELECT count(*) FROM clean), (SELECT count(*) FROM clean) "
          "UNION ALL SELECT 'collision_snapshot', (SELECT count(*) FROM enc), 0", *o.TO_ALERTS, o.LATEST, o.SCAN20, o.ENC)


@query("analytics_stages", _STAGES_SQL)
@query("stage_pipeline", _STAGES_SQL)
def _(w):
    """All stages once more over everything stored: same alerts, no new encounters."""
    store = _store(w)
    keys = store.messages.read().select("mmsi", "timestamp").distinct()
    results = stages.run_stages(store, stages.BatchContext(keys), stages.LIVE_STAGES)
    return w.spark.createDataFrame(
        [(x.name, x.processed, x.created) for x in results], "stage string, processed bigint, created bigint"
    )


_STATEFUL = ("elapsed_seconds", "distance_nm", "calculated_speed_knots", "course_change_degrees", "turn_rate_degrees_per_minute")


@query("stateful_motion", o.sql(f"SELECT id, mmsi, us AS timestamp, {rs(*_STATEFUL)} FROM feat", *o.TO_FEAT))
def _(w):
    """A stream over the reports, of which every other one comes in late: the whole recording later."""
    # One state store per shuffle partition: as many as cores are enough here.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(w.spark.sparkContext.defaultParallelism),
    }
    before = {key: w.spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        w.spark.conf.set(key, value)
    source, out, checkpoint = (scratch_path(w.spark, f"motion-{n}") for n in ("in", "out", "checkpoint"))
    messages = w.messages()
    first, last = messages.agg(F.min("timestamp"), F.max("timestamp")).first()
    lateness = last - first + timedelta(minutes=1)
    try:
        late = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
        slice_seconds = 7 * 86_400
        end = end_marker(w.spark, messages.schema, last + lateness + timedelta(seconds=slice_seconds))
        for part in (messages.filter(~late), messages.filter(late).unionByName(end)):
            part.write.mode("append").parquet(source)
            reports = report_stream(w.spark, source, messages.schema)
            features = stateful_motion(reports, f"{lateness // timedelta(minutes=1)} minutes", slice_seconds)
            writer = features.writeStream.format("parquet").option("path", out)
            stream = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            stream.awaitTermination()
    finally:
        for key, value in before.items():
            w.spark.conf.set(key, value)
    return w.spark.read.parquet(out).select("id", "mmsi", "timestamp", *_STATEFUL)
