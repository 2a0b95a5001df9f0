"""Vessel pairs: nearby candidates, closest approach, collision risk."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.config import ApproachThresholds
from fairlead.functions import coerce, geo
from fairlead.functions.fence import evaluate_once
from fairlead.operators import ranking
from fairlead.schema import require_columns
from fairlead.session import cut_lineage

SCAN_RADIUS_NM = 5.0
STORE_RADIUS_NM = 20.0
MAX_GAP_MINUTES = 5.0
VERSION = "cpa-tcpa-v1"
CELL_ROWS = 2_000
#: Vessels for each task of the pair step.
TASK_VESSELS = 500
SIDE_COLUMNS = ("mmsi", "id", "timestamp", "latitude", "longitude", "sog", "cog")


# --- snapshot -------------------------------------------------------------


def latest_reports(reports: DataFrame) -> DataFrame:
    """Newest report of every vessel, by time and then id.

    The rank filter is applied inside each map task first, so a vessel with any
    number of reports sends one row per task into the shuffle.
    """
    newest = Window.partitionBy("mmsi").orderBy(F.desc("timestamp"), F.desc("id"))
    return reports.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def _usable(timed: bool = True) -> Column:
    finite = lambda c: coerce.false_if_null(F.abs(F.col(c)) < float("inf")) & ~F.isnan(c)
    ok = F.trim("mmsi") != ""
    for c in ("latitude", "longitude", "sog", "cog"):
        ok = ok & finite(c)
    if timed:
        ok = ok & F.col("timestamp").isNotNull()
    placed = F.col("latitude").between(-90.0, 90.0) & F.col("longitude").between(-180.0, 180.0)
    return coerce.false_if_null(ok & placed & (F.col("sog") >= 0.0))


def usable_snapshot(latest: DataFrame) -> DataFrame:
    """Latest reports with complete motion; no older report steps in for a bad one."""
    return latest.filter(_usable())


def snapshot_counts(latest: DataFrame) -> DataFrame:
    return latest.agg(
        F.count(F.lit(1)).alias("latest_positions"),
        F.count_if(_usable()).alias("usable_vessels"),
        F.count_if(~_usable()).alias("skipped_unusable"),
    )


def motion_quarantine(vessels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return vessels.filter(_usable()), vessels.filter(~_usable())


def require_motion(vessels: DataFrame) -> DataFrame:
    """Fail while running if any state lacks usable motion."""
    return vessels.withColumn(
        "mmsi",
        F.when(_usable("timestamp" in vessels.columns), F.col("mmsi")).otherwise(
            F.raise_error(F.concat(F.lit("unusable vessel motion: "), F.coalesce("mmsi", F.lit("no mmsi"))))
        ),
    )


def require_one_state_per_vessel(vessels: DataFrame) -> None:
    repeated = vessels.groupBy("mmsi").count().filter("count > 1").select("mmsi").first()
    if repeated is not None:
        raise ValueError(f"Only one state per vessel is allowed: {repeated.mmsi}.")


# --- candidates -----------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Latitude bands one search radius high, cut into cells one radius wide.

    All partners of a vessel lie in its own or a neighbouring cell. Near the
    poles a band is a single cell; cell numbers wrap at the antimeridian.
    """

    radius_nm: float

    @property
    def reach(self) -> float:
        return self.radius_nm / geo.EARTH_RADIUS_NM

    @property
    def band_degrees(self) -> float:
        return math.degrees(self.reach) * (1.0 + 1e-9)

    def band(self, latitude: Column) -> Column:
        return F.floor((latitude + 90.0) / self.band_degrees)

    def cells_in(self, band: Column) -> Column:
        low = F.abs(band * self.band_degrees - 90.0)
        high = F.abs((band + 1) * self.band_degrees - 90.0)
        widest = F.least(F.greatest(low, high), F.lit(90.0))
        polar = widest + math.degrees(self.reach) >= 90.0
        # Guard the division as well: the cosine vanishes at the pole.
        cosine = F.cos(F.radians(F.when(~polar, widest)))
        width = F.degrees(F.asin(F.lit(math.sin(min(self.reach, math.pi / 2))) / cosine)) * (1.0 + 1e-9)
        n = F.floor(360.0 / width)
        return F.when(polar | (n < 3), F.lit(1)).otherwise(n).cast("bigint")

    def cell(self, longitude: Column, cells: Column) -> Column:
        share = F.pmod(longitude + 180.0, F.lit(360.0)) / 360.0
        return F.least(F.floor(share * cells), cells - 1).cast("bigint")


def _side(vessels: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}_{c}") for c in SIDE_COLUMNS if c in vessels.columns]


def _parts(df: DataFrame, hot: DataFrame, group: list[str], own: str, other: str, mmsi: str) -> DataFrame:
    """Split crowded groups in two directions: own part by hash, every part of the other side."""
    spread = df.join(F.broadcast(hot), group, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    return (
        spread.withColumn(own, F.pmod(F.xxhash64(mmsi), F.col("_k")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .drop("_k")
    )


def _steps(timed: bool, changed: bool) -> list[tuple[int, int, int, int, bool]]:
    """Groups a vessel looks into: (slots on, bands on, first and last cell on, changed partners).

    Of two groups one looks into the other, so a pair meets once. Partners that
    did not change look nowhere, they are looked for all around.
    """
    ahead = [(0, 0, 0, 1, True), (0, 1, -1, 1, True)]
    if timed:
        ahead += [(1, band, -1, 1, True) for band in (-1, 0, 1)]
    if not changed:
        return ahead
    return ahead + [(slot, band, -1, 1, False) for slot in ((-1, 0, 1) if timed else (0,)) for band in (-1, 0, 1)]


def encounter_candidates(
    vessels: DataFrame,
    max_distance_nm: float = SCAN_RADIUS_NM,
    max_gap_minutes: float | None = None,
    cell_rows: int = CELL_ROWS,
    check: bool = True,
    changed: str | None = None,
    wanted: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All pairs within the great-circle radius, each once with ``a_mmsi < b_mmsi``.

    An equi-join on grid cells, never a cross join. With ``max_gap_minutes`` the
    report times take part in the join key as well, so pairs too far apart in
    time are never built. A group with more than ``cell_rows`` vessels is split
    into k x k blocks, and blocks are dealt to a number of tasks that follows from the
    vessels: their work is the pairs in them, not the few bytes they are read from.

    ``vessels`` holds one state per vessel and is read by several branches: give
    it as a stored snapshot. Two states of a vessel or unusable motion are an
    error; ``check=False`` is for snapshots that were filtered already.

    ``changed`` names a boolean column: only pairs with such a vessel are built.
    Those vessels look into the cells around them, so neighbours, pairs and
    distances are made for them alone. ``wanted`` drops pairs by a cheap test of
    their two states, or adds columns that are kept; which of them is a is open yet.

    Most pairs are told to be near enough or not by the straight line between them,
    from sines and cosines taken once per vessel. Only where rounding could matter is
    the great circle needed to tell, and else where ``great_circle_nm`` is read.
    """
    if not (math.isfinite(max_distance_nm) and max_distance_nm > 0.0):
        raise ValueError("The search radius must be a positive finite number.")
    if max_gap_minutes is not None and not (math.isfinite(max_gap_minutes) and max_gap_minutes >= 0.0):
        raise ValueError("The pair time gap must be a non-negative finite number.")
    require_columns(vessels, ("mmsi", "latitude", "longitude", "sog", "cog"), "encounter")
    if check:
        require_one_state_per_vessel(vessels)
        vessels = require_motion(vessels)
    timed = max_gap_minutes is not None
    gap = int(max_gap_minutes * 60_000_000) if timed else 0
    micros = lambda c: F.unix_micros(F.col(c))
    grid = Grid(max_distance_nm)
    # What vessels are looked up by. No constants: the join would drop them from its
    # keys, and then deal the rows once more by their size.
    group = ["_band", "_cell", *(["_slot"] if timed else []), *(["_new"] if changed is not None else [])]
    placed = (
        vessels.withColumn("_band", grid.band(F.col("latitude")))
        .withColumn("_n", grid.cells_in(F.col("_band")))
        .withColumn("_cell", grid.cell(F.col("longitude"), F.col("_n")))
        .withColumn("_slot", (F.floor(micros("timestamp") / F.lit(max(gap, 1))) if timed else F.lit(0)).cast("bigint"))
        .withColumn("_new", F.lit(True) if changed is None else coerce.false_if_null(F.col(changed)))
    )
    # Nine-digit numbers bound the snapshot at 1e9 states, hence 250,000 crowded groups.
    hot = (
        placed.groupBy(*group)
        .count()
        .filter(F.col("count") > cell_rows)
        .select(*group, F.ceil(F.col("count") / cell_rows).cast("int").alias("_k"))
    )
    right = _parts(placed.select(*group, *_side(vessels, "b")), hot, group, "_right", "_left", "b_mmsi")
    searching = placed.filter("_new")
    cells = F.transform(F.sequence("first", "last"), lambda d: F.pmod(F.col("_at") + d, F.col("_n")))
    steps = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(("slots", "bands", "first", "last", "partner"), step)])
        for step in _steps(timed, changed is not None)
    ]
    neighbours = (
        searching.withColumnRenamed("_cell", "_own")
        .select("*", F.inline(F.array(*steps)))
        .withColumns({"_band": F.col("_band") + F.col("bands"), "_slot": F.col("_slot") + F.col("slots"), "_new": F.col("partner")})
        .withColumn("_n", grid.cells_in(F.col("_band")))
        .withColumn("_at", grid.cell(F.col("longitude"), F.col("_n")))
        .withColumn("_cell", F.explode(F.array_distinct(cells)))
        .withColumn("_same", F.expr("partner and slots = 0 and bands = 0 and _cell = _own"))
        .select(*group, "_same", *_side(vessels, "a"))
    )
    left = _parts(neighbours, hot, group, "_left", "_right", "a_mmsi")
    straight = sum((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in "xyz")
    surely, possibly = _straight_limits(grid.reach)
    # Inside a group a pair meets from both sides.
    on = (F.abs(F.col("a_latitude") - F.col("b_latitude")) <= grid.band_degrees) & (straight <= possibly)
    on = on & (F.col("a_mmsi") != F.col("b_mmsi")) & (~F.col("_same") | (F.col("a_mmsi") < F.col("b_mmsi")))
    if timed:
        on = (F.abs(micros("a_timestamp") - micros("b_timestamp")) <= gap) & on
    keys = [*group, "_left", "_right"]
    for key in keys:
        on = on & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    tasks = _tasks(vessels.sparkSession, vessels.count())
    # Derived where the pairs are built, so that they are not shuffled.
    dealt = lambda df, p: df.repartition(tasks, *keys).withColumns(_per_vessel(p))
    pairs = dealt(left, "a").alias("l").join(dealt(right, "b").hint("merge").alias("r"), on)
    pairs = pairs.select(*[c for c in pairs.columns if not c.startswith("_")])
    added = []
    if wanted is not None:
        tested = wanted(pairs)
        pairs, added = tested, [c for c in tested.columns if c not in pairs.columns]
    distance = geo.haversine_nm(
        F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")
    )
    # Kept out of the join's condition: a loop with all formulas in it is too long to be compiled by the JVM.
    pairs = evaluate_once(pairs.withColumn("_straight", straight), ["_straight"])
    pairs = pairs.filter(F.when(F.col("_straight") <= surely, True).otherwise(distance <= max_distance_nm))
    names = [c for c in SIDE_COLUMNS if c in vessels.columns]
    swap = F.col("a_mmsi") > F.col("b_mmsi")
    return pairs.withColumn("great_circle_nm", distance).select(
        *[F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in names],
        *[F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in names],
        "great_circle_nm",
        *added,
    )


def _straight_limits(reach: float) -> tuple[float, float]:
    """Squared straight lines through a globe of radius 1: surely within the reach, and possibly.

    Between them lies more than rounding can move the line or the great circle.
    """
    line = 2.0 * math.sin(min(reach / 2.0, math.pi / 2.0))
    slack = 1e-9 * line + 1e-13
    return max(line - slack, 0.0) ** 2, (line + slack) ** 2


def _per_vessel(prefix: str) -> dict[str, Column]:
    """Place on a globe of radius 1, speed east and north, and half the latitude's cosine and sine: once per vessel instead of once per pair."""
    own = geo.Motion.of(prefix)
    latitude, longitude = F.radians(own.latitude), F.radians(own.longitude)
    east, north = own.velocity()
    values = {
        "x": F.cos(latitude) * F.cos(longitude),
        "y": F.cos(latitude) * F.sin(longitude),
        "z": F.sin(latitude),
        "east": east,
        "north": north,
        "half_cos": F.cos(latitude / 2.0),
        "half_sin": F.sin(latitude / 2.0),
    }
    return {f"{prefix}_{name}": value for name, value in values.items()}


def _tasks(spark, vessels: int) -> int:
    """Tasks that pair blocks are dealt to. Few bytes make many pairs, so sizes must not merge them.

    Pairs may grow with the square of the vessels and tasks grow with the vessels,
    so the longest task grows no faster than the input.
    """
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return max(least, -(-vessels // TASK_VESSELS))


def may_be_elevated(pairs: DataFrame, limits: ApproachThresholds, flag: str | None = None) -> DataFrame:
    """Without pairs whose risk is certainly low; with ``flag`` all pairs, and a column that is false for those.

    Elevated are pairs in touch and those that come as near as the medium limit
    within its time. The test needs no division, root or angle of a pair;
    its limits are wider by more than rounding can move a value.
    """
    wide = 1.0 + 1e-6
    hours, nearest = limits.medium_tcpa_minutes / 60.0 * wide, limits.medium_cpa_nm * wide
    turn = F.col("b_longitude") - F.col("a_longitude")
    turn = F.when(turn >= 180.0, turn - 360.0).when(turn < -180.0, turn + 360.0).otherwise(turn)
    # Cosine of the mean latitude.
    between = F.col("a_half_cos") * F.col("b_half_cos") - F.col("a_half_sin") * F.col("b_half_sin")
    relative = {
        "_x": turn * geo.NM_PER_DEGREE * between,
        "_y": (F.col("b_latitude") - F.col("a_latitude")) * geo.NM_PER_DEGREE,
        "_u": F.col("b_east") - F.col("a_east"),
        "_v": F.col("b_north") - F.col("a_north"),
    }
    x, y, u, v = (F.col(c) for c in relative)
    apart, speed, dot, across = x * x + y * y, u * u + v * v, x * u + y * v, x * v - y * u
    # At less than a thousandth of a knot against each other they must be near already.
    slow = (speed < 1e-6) & (apart <= (nearest + 1e-3 * hours + 1e-6) ** 2)
    meeting = (dot < 1e-6) & (-dot <= speed * hours + 1e-6) & (across * across <= nearest * nearest * speed + 1e-6)
    near = (apart <= (limits.critical_cpa_nm * wide) ** 2) | slow | ((speed >= 1e-6) & meeting)
    tested = evaluate_once(pairs.withColumns(relative), list(relative))
    return (tested.filter(near) if flag is None else tested.withColumn(flag, near)).drop(*relative)


def candidate_metrics(vessels: DataFrame, max_distance_nm: float = SCAN_RADIUS_NM) -> DataFrame:
    """Vessel count, possible pairs, pairs within the latitude limit, candidates.

    Pairs within the latitude limit are counted from ranks (vessels up to my
    latitude plus the limit, minus vessels up to mine), not by building them.
    """
    limit = math.degrees(max_distance_nm / geo.EARTH_RADIUS_NM)
    here = vessels.select(F.col("latitude").alias("v"), F.lit(1).alias("n"), F.lit(0).alias("ask"))
    there = vessels.select((F.col("latitude") + limit).alias("v"), F.lit(0).alias("n"), F.lit(1).alias("ask"))
    points = (
        here.unionByName(there)
        .groupBy("v")
        .agg(F.sum("n").alias("n"), F.sum("ask").alias("ask"))
        .withColumn("_bucket", F.floor(F.col("v") * 100))
    )
    ranked = ranking.cumulative_counts(points, [], "v", "_bucket")
    pairs = ranked.agg(
        F.sum("n").alias("vessels"),
        # reach(i) - own(i) counts strictly higher partners; equal latitudes pair among themselves
        (
            F.sum(F.col("rank") * F.col("ask"))
            - F.sum(F.col("rank") * F.col("n"))
            + F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
        ).alias("checked"),
    )
    found = encounter_candidates(vessels, max_distance_nm, check=False).agg(F.count(F.lit(1)).alias("candidate_count"))
    n = F.coalesce(F.col("vessels"), F.lit(0))
    return pairs.crossJoin(found).select(
        n.alias("vessel_count"),
        F.expr("coalesce(vessels, 0) * (coalesce(vessels, 0) - 1) div 2").alias("possible_pair_count"),
        F.coalesce("checked", F.lit(0)).cast("bigint").alias("distance_checked_pair_count"),
        "candidate_count",
    )


# --- closest approach -----------------------------------------------------


def closest_approach(pairs: DataFrame, only: str | None = None) -> DataFrame:
    """Constant-velocity closest point of approach for pairs with ``a_*`` and ``b_*`` columns.

    ``only`` names a boolean column: the other pairs are kept, but not measured.
    """
    a, b = geo.Motion.of("a"), geo.Motion.of("b")
    east, north = geo.relative_position(a, b)
    (a_east, a_north), (b_east, b_north) = a.velocity(), b.velocity()
    tiny = geo.NO_RELATIVE_MOTION
    relative = {"_x": east, "_y": north, "_u": b_east - a_east, "_v": b_north - a_north}
    # All measures follow from these, and cost nothing where these are null.
    step = pairs.withColumns({c: v if only is None else F.when(F.col(only), v) for c, v in relative.items()})
    x, y, u, v = (F.col(c) for c in ("_x", "_y", "_u", "_v"))
    step = step.withColumns(
        {
            "current_distance_nm": F.hypot(x, y),
            "_speed": F.hypot(u, v),
            "_dot": x * u + y * v,
            "bearing_from_a_to_b_degrees": F.when((F.abs(x) < tiny) & (F.abs(y) < tiny), 0.0).otherwise(
                F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))
            ),
        }
    )
    moving = F.col("_speed") > tiny
    apart = F.col("current_distance_nm") > tiny
    step = step.withColumns(
        {
            "_hours": -F.col("_dot") / F.when(moving, u * u + v * v),
            "relative_speed_knots": F.when(moving, F.col("_speed")).otherwise(0.0),
            "closing_speed_knots": F.when(
                moving & apart, -F.col("_dot") / F.when(apart, F.col("current_distance_nm"))
            ).otherwise(0.0),
        }
    )
    hours = F.col("_hours")
    step = step.withColumns(
        {
            "tcpa_minutes": hours * 60.0,
            "cpa_distance_nm": F.coalesce(F.hypot(x + u * hours, y + v * hours), F.col("current_distance_nm")),
            "is_closing": coerce.false_if_null((F.col("closing_speed_knots") > 0.0) & (hours > 0.0)),
        }
    )
    measured = step.withColumn(
        "future_cpa_distance_nm",
        F.when(hours > 0.0, F.col("cpa_distance_nm")).otherwise(F.col("current_distance_nm")),
    ).drop("_x", "_y", "_u", "_v", "_speed", "_dot", "_hours")
    return evaluate_once(measured, [c for c in measured.columns if c not in pairs.columns])


def collision_risk(measured: DataFrame, limits: ApproachThresholds = ApproachThresholds()) -> DataFrame:
    """Level and reasons from the approach measures; nearness now outranks projections."""
    distance, cpa, tcpa = F.col("current_distance_nm"), F.col("future_cpa_distance_nm"), F.col("tcpa_minutes")
    closing = F.col("is_closing")
    touching = distance <= limits.critical_cpa_nm
    no_future = (tcpa <= 0.0) | ~closing
    within = lambda name: (cpa <= getattr(limits, f"{name}_cpa_nm")) & (
        tcpa <= getattr(limits, f"{name}_tcpa_minutes")
    )
    level = F.when(touching, "critical").when(tcpa.isNull() | no_future, "low")
    for name in ("critical", "high", "medium"):
        level = level.when(within(name), name)
    speed = F.format_string("%.2f", F.floor(F.col("closing_speed_knots") * 100 + 0.5) / 100)

    def projected(name: str) -> Column:
        return F.array(
            F.lit(f"Projected closest approach is within {getattr(limits, f'{name}_cpa_nm'):.2f} NM."),
            F.lit(
                "The projected closest approach occurs within "
                f"{getattr(limits, f'{name}_tcpa_minutes'):.0f} minutes."
            ),
            F.concat(F.lit("The vessels are closing at "), speed, F.lit(" knots.")),
        )

    # The reason texts.
    reasons = (
        F.when(
            touching,
            F.array(
                F.lit(f"Current vessel separation is within {limits.critical_cpa_nm:.2f} NM."),
                F.when(closing, "The vessels are still closing.").otherwise(
                    "The vessels are currently at critical proximity."
                ),
            ),
        )
        .when(
            tcpa.isNull(),
            F.array(F.lit("No meaningful TCPA exists because relative vessel motion is negligible.")),
        )
        .when(
            no_future,
            F.array_compact(
                F.array(
                    F.lit("The vessels are not on a future closing encounter."),
                    F.when(
                        tcpa < 0.0, "The mathematical closest point of approach has already occurred."
                    ),
                )
            ),
        )
    )
    for name in ("critical", "high", "medium"):
        reasons = reasons.when(within(name), projected(name))
    return measured.withColumns(
        {
            "risk_level": level.otherwise("low"),
            "reasons": reasons.otherwise(
                F.array(
                    F.lit("Projected CPA/TCPA does not meet the configured elevated collision-risk thresholds.")
                )
            ),
        }
    )


def urgency(level: Column) -> Column:
    """critical 0 ... low 3, as the sort key of encounter lists."""
    return F.when(level == "critical", 0).when(level == "high", 1).when(level == "medium", 2).otherwise(3)


def future_first(tcpa: Column) -> Column:
    """Minutes to a closest approach still to come; past or missing ones sort last."""
    return F.when(tcpa >= 0.0, tcpa).otherwise(float("inf"))


def collision_scan(
    vessels: DataFrame,
    max_distance_nm: float = SCAN_RADIUS_NM,
    limits: ApproachThresholds = ApproachThresholds(),
    include_low: bool = False,
    max_gap_minutes: float | None = None,
    check: bool = True,
    changed: str | None = None,
    measures: bool = True,
) -> DataFrame:
    """Candidates with approach and risk; without ``measures`` all of them, but with their level alone.

    For a level alone, pairs that are certainly low need not be measured.
    """
    flag = None if measures else "_likely"
    wanted = None if include_low and measures else lambda pairs: may_be_elevated(pairs, limits, flag)
    pairs = encounter_candidates(vessels, max_distance_nm, max_gap_minutes, check=check, changed=changed, wanted=wanted)
    assessed = collision_risk(closest_approach(pairs, flag), limits)
    if not measures:
        level = F.when(F.col(flag), F.col("risk_level")).otherwise("low")
        assessed = assessed.select(*[c for c in pairs.columns if c != flag], level.alias("risk_level"))
    if not include_low:
        assessed = assessed.filter(F.col("risk_level") != "low")
    return assessed


def by_urgency(scan: DataFrame) -> DataFrame:
    return scan.orderBy(
        urgency(F.col("risk_level")),
        future_first(F.col("tcpa_minutes")),
        "future_cpa_distance_nm",
        "a_mmsi",
        "b_mmsi",
    )


def aligned() -> Column:
    micros = lambda c: F.unix_micros(F.col(c))
    return F.abs(micros("a_timestamp") - micros("b_timestamp"))


def pair_time_alignment(pairs: DataFrame, max_gap_minutes: float = MAX_GAP_MINUTES) -> DataFrame:
    """Pairs whose reports are close in time, observed at the later one."""
    return pairs.filter(aligned() <= int(max_gap_minutes * 60_000_000)).withColumn(
        "observed_at", F.greatest("a_timestamp", "b_timestamp")
    )


def encounter_records(
    snapshot: DataFrame,
    max_distance_nm: float = STORE_RADIUS_NM,
    max_gap_minutes: float = MAX_GAP_MINUTES,
    limits: ApproachThresholds = ApproachThresholds(),
    version: str = VERSION,
    changed: str | None = None,
) -> DataFrame:
    """Rows to store: elevated, time-aligned encounters of the latest states, or of the ``changed`` ones with any."""
    if not version.strip():
        raise ValueError("The assessment version cannot be empty.")
    scan = collision_scan(snapshot, max_distance_nm, limits, max_gap_minutes=max_gap_minutes, check=False, changed=changed)
    return as_records(pair_time_alignment(scan, max_gap_minutes), version)


def as_records(scan: DataFrame, version: str = VERSION) -> DataFrame:
    return scan.select(
        F.col("a_mmsi").alias("mmsi_a"),
        F.col("b_mmsi").alias("mmsi_b"),
        F.col("a_id").alias("message_a"),
        F.col("b_id").alias("message_b"),
        "observed_at",
        F.col("a_timestamp").alias("observed_at_a"),
        F.col("b_timestamp").alias("observed_at_b"),
        "current_distance_nm",
        F.col("future_cpa_distance_nm").alias("cpa_distance_nm"),
        "tcpa_minutes",
        "relative_speed_knots",
        "closing_speed_knots",
        "bearing_from_a_to_b_degrees",
        "risk_level",
        "reasons",
        F.lit(version).alias("assessment_version"),
    )


def snapshot_of(latest: DataFrame, *further: str) -> DataFrame:
    """Usable latest states, stored once because the scan reads them several times."""
    return cut_lineage(usable_snapshot(latest).select(*SIDE_COLUMNS, *further))


def current_encounters(encounters: DataFrame, latest: DataFrame, active_minutes: int = 15) -> DataFrame:
    """Encounters whose two reports are still their vessels' newest and recent.

    "No newer report" equals "is the newest report", so both sides join the
    latest state's message ids; recency counts from the newest report of all.
    ``latest`` has one row per vessel, so no history is read.
    """
    if active_minutes < 1:
        raise ValueError("The active window must be at least one minute.")
    cutoff = latest.agg(F.max("timestamp") - F.expr(f"interval {int(active_minutes)} minutes"))
    fresh = latest.filter(F.col("timestamp") >= cutoff.scalar()).select(F.col("id").alias("_id"))
    return encounters.join(fresh.withColumnRenamed("_id", "message_a"), "message_a", "left_semi").join(
        fresh.withColumnRenamed("_id", "message_b"), "message_b", "left_semi"
    )


def vessel_encounters(encounters: DataFrame, mmsi: str | None = None) -> DataFrame:
    """Encounters seen from each vessel, with the other side as counterpart."""
    sides = F.array(
        F.struct(F.col("mmsi_a").alias("mmsi"), F.col("mmsi_b").alias("counterpart")),
        F.struct(F.col("mmsi_b").alias("mmsi"), F.col("mmsi_a").alias("counterpart")),
    )
    seen = encounters if mmsi is None else encounters.filter(
        (F.col("mmsi_a") == mmsi) | (F.col("mmsi_b") == mmsi)
    )
    both = seen.select(F.inline(sides), "*")
    return both if mmsi is None else both.filter(F.col("mmsi") == mmsi)


def store_counters(
    latest: DataFrame,
    snapshot: DataFrame,
    stored: DataFrame,
    max_distance_nm: float = STORE_RADIUS_NM,
    max_gap_minutes: float = MAX_GAP_MINUTES,
    limits: ApproachThresholds = ApproachThresholds(),
    version: str = VERSION,
) -> DataFrame:
    """Eleven counters of one scan against the encounters stored before it: one row.

    They also count pairs too far apart in time, so this scan builds those. Pairs
    are counted where they are built: only the eligible ones, made once more with
    the times in the key, are looked up among the stored.
    """
    scan = collision_scan(snapshot, max_distance_nm, limits, include_low=True, check=False, measures=False)
    elevated = F.col("risk_level") != "low"
    eligible = elevated & (aligned() <= int(max_gap_minutes * 60_000_000))
    counted = scan.agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count(F.lit(1)).alias("assessed_candidate_count"),
        F.count_if(elevated).alias("elevated_encounter_count"),
        F.count_if(eligible).alias("eligible_encounter_count"),
        F.count_if(elevated & ~eligible).alias("skipped_time_gap_count"),
    )
    known = stored.filter(F.col("assessment_version") == version).select("message_a", "message_b")
    offered = encounter_records(snapshot, max_distance_nm, max_gap_minutes, limits, version).select("message_a", "message_b")
    found = offered.join(known, ["message_a", "message_b"], "left_semi").agg(F.count(F.lit(1)).alias("duplicate_count"))
    pairs = counted.crossJoin(found).select(
        *counted.columns, (F.col("eligible_encounter_count") - F.col("duplicate_count")).alias("inserted_count"), "duplicate_count"
    )
    states = snapshot_counts(latest).select(
        F.col("latest_positions").alias("latest_position_count"),
        F.col("usable_vessels").alias("usable_vessel_count"),
        F.col("skipped_unusable").alias("skipped_unusable_count"),
        F.expr("usable_vessels * (usable_vessels - 1) div 2").alias("possible_pair_count"),
    )
    return states.crossJoin(pairs)
