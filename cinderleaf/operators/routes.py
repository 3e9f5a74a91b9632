"""Fewest-hop routes over the district graph and hazards along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderleaf.fixed import place_rules as rules
from cinderleaf.session import bounded, checkpoint, fits_broadcast, fixed_table


def district_edges(spark: SparkSession) -> DataFrame:
    """(src, dst, pos): directed neighbour lists with their order."""
    rows = [(s, d, i) for s, ds in rules.NEIGHBOURS.items() for i, d in enumerate(ds)]
    return fixed_table(spark, rows, "src string, dst string, pos int")


def _paths(starts: DataFrame, edges: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """(start, node, avoid, path): fewest-hop path to every reachable node, first in neighbour order.

    One round per hop, over at most one row per (start, node, avoid). With `avoid`, blocked nodes can
    end a path but are not passed through.
    """
    modes = F.array(F.lit(False)) if blocked is None else F.array(F.lit(False), F.lit(True))
    keys = ["start", "node", "avoid"]
    reached = starts.select(
        F.col("src").alias("start"),
        F.col("src").alias("node"),
        F.explode(modes).alias("avoid"),
        F.array("src").alias("path"),
        F.array().cast("array<int>").alias("turns"),
    )
    hops = edges.withColumn("closed", F.lit(False))
    if blocked is not None:
        closed = blocked.select(F.col("district").alias("src"), F.lit(True).alias("closed")).distinct()
        hops = edges.join(closed, "src", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    hops = bounded(checkpoint(hops))
    reached = checkpoint(reached)
    frontier = reached
    while not frontier.isEmpty():
        steps = frontier.join(hops, F.col("node") == F.col("src"))
        steps = steps.where(~(F.col("avoid") & F.col("closed")) | (F.col("node") == F.col("start"))).select(
            "start",
            F.col("dst").alias("node"),
            "avoid",
            F.concat("path", F.array("dst")).alias("path"),
            F.concat("turns", F.array("pos")).alias("turns"),
        )
        best = steps.groupBy(keys).agg(F.min(F.struct("turns", "path")).alias("_p"))
        fresh = best.join(reached.select(keys), keys, "left_anti")
        frontier = checkpoint(fresh.select(*keys, "_p.path", "_p.turns"))
        reached = reached.unionByName(frontier)
    return reached.select(*keys, "path")


def district_routes(
    trips: DataFrame, src: str, dst: str, edges: DataFrame, blocked: DataFrame | None = None
) -> DataFrame:
    """Adds `path` (null when unreachable) and `fallback` (only a blocked path exists).

    Distinct pairs are routed once, whatever the number of trips.
    """
    nodes = edges.select(F.col("src").alias("district")).distinct()
    pairs = checkpoint(
        trips.select(F.lower(F.trim(src)).alias("_from"), F.lower(F.trim(dst)).alias("_to")).distinct()
    )
    starts = pairs.select(F.col("_from").alias("src")).distinct()
    starts = starts.join(nodes.withColumnRenamed("district", "src"), "src", "left_semi")
    paths = checkpoint(_paths(starts, edges, blocked))
    names = [F.col("start").alias("_from"), F.col("node").alias("_to")]
    any_path = paths.where("NOT avoid").select(*names, F.col("path").alias("_any"))
    # a pair with equal ends is its own path, also outside the graph
    own = F.when(F.col("_from") == F.col("_to"), F.array("_from"))
    if blocked is None:
        routed = pairs.join(any_path, ["_from", "_to"], "left").select(
            "_from", "_to", F.coalesce(own, "_any").alias("path"), F.lit(False).alias("fallback")
        )
    else:
        clear = paths.where("avoid").select(*names, F.col("path").alias("_clear"))
        routed = pairs.join(any_path, ["_from", "_to"], "left").join(clear, ["_from", "_to"], "left")
        routed = routed.select(
            "_from",
            "_to",
            F.coalesce(own, "_clear", "_any").alias("path"),
            (own.isNull() & F.col("_clear").isNull() & F.col("_any").isNotNull()).alias("fallback"),
        )
    keyed = trips.withColumns({"_from": F.lower(F.trim(src)), "_to": F.lower(F.trim(dst))})
    return keyed.join(bounded(routed), ["_from", "_to"], "left").drop("_from", "_to")


def _district_summary(places: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per district: danger and caution counts, the first dangerous row, and the first alert."""
    low = F.lower(F.trim("district_id"))
    rated = places.select(low.alias("district"), "ord", "safety_level")
    danger = F.col("safety_level") == "Dangerous"
    first = rated.where(danger).groupBy("district").agg(
        F.min("ord").alias("first_danger"), F.count("*").alias("dangers")
    )
    early = rated.where("safety_level = 'Moderate'").join(first, "district", "left")
    early = early.where(F.col("first_danger").isNull() | (F.col("ord") < F.col("first_danger")))
    cautions = early.groupBy("district").agg(F.count("*").alias("cautions"))
    spots = first.join(cautions, "district", "full").na.fill(0, ["dangers", "cautions"])
    warned = alerts.groupBy(F.lower(F.trim("district")).alias("district")).agg(
        F.min_by(F.struct("level", "hazard", "bulletin"), "ord").alias("alert")
    )
    return spots, warned


def _stops(routes: DataFrame, route_id: str, places: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per route and district, with what was already seen earlier on the route."""
    spots, warned = _district_summary(places, alerts)
    stops = routes.select(route_id, F.posexplode("path").alias("pos", "district"))
    stops = stops.join(spots, "district", "left").join(warned, "district", "left")
    dangers = F.coalesce("dangers", F.lit(0))
    earlier = Window.partitionBy(route_id).orderBy("pos")  # a path visits a district at most once
    return stops.withColumns(
        {
            "dangers": dangers,
            "seen": F.coalesce(
                F.max(dangers > 0).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)
            ),
            "any_danger": F.max(dangers > 0).over(Window.partitionBy(route_id)),
            "red_before": F.coalesce(
                F.max(F.coalesce(F.col("alert.level") == "Red", F.lit(False))).over(
                    earlier.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(False),
            ),
        }
    )


def route_hazards(routes: DataFrame, route_id: str, places: DataFrame, alerts: DataFrame) -> DataFrame:
    """(route_id, safety, spot_cautions, alert_cautions) per route.

    Districts are summarised once, so routes are not multiplied by places.
    `places(district_id, ord, safety_level)`, `alerts(district, ord, level, hazard, bulletin)`.
    """
    stops = _stops(routes, route_id, places, alerts)
    level = F.col("alert.level")
    amber = (level == "Amber") & ~F.col("any_danger") & ~F.col("red_before")
    red = level == "Red"
    cautions = F.col("dangers") + F.when(F.col("seen"), 0).otherwise(F.coalesce("cautions", F.lit(0)))
    shown = F.coalesce(red | amber, F.lit(False))
    summary = stops.groupBy(route_id).agg(
        F.sum(cautions).alias("spot_cautions"),
        F.count_if(shown).alias("alert_cautions"),
        F.max((F.col("dangers") > 0) | F.coalesce(red, F.lit(False))).alias("_danger"),
        F.max((cautions > 0) | shown).alias("_caution"),
    )
    safety = F.when(F.col("_danger"), "Dangerous").when(F.col("_caution"), "Moderate").otherwise("Safe")
    return summary.select(route_id, safety.alias("safety"), "spot_cautions", "alert_cautions")


def route_cautions(routes: DataFrame, route_id: str, places: DataFrame, alerts: DataFrame) -> DataFrame:
    """(route_id, stage, pos, ord, caution): the caution list of every route, one row per entry."""
    stops = _stops(routes, route_id, places, alerts)
    hazard = F.col("wildlife_hazard") if "wildlife_hazard" in places.columns else F.lit(None)
    rain = F.col("rain_sensitivity") if "rain_sensitivity" in places.columns else F.lit(None)
    spots = places.select(
        F.lower(F.trim("district_id")).alias("district"), "ord", "name", "safety_level",
        F.coalesce(hazard, F.lit("Wildlife caution")).alias("_hazard"),
        F.coalesce(rain, F.lit("Rain caution")).alias("_rain"),
    )
    spots = spots.where("safety_level IN ('Dangerous', 'Moderate')")
    # districts are few, so none may be a task's whole work: the spots stay where they are, or are dealt into cells
    stops = checkpoint(stops)
    if fits_broadcast(stops):
        near = spots.join(F.broadcast(stops), "district")
    else:
        cells = int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = spots.withColumn("_cell", F.pmod(F.xxhash64("ord", "name"), F.lit(cells)))
        copied = stops.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
        near = dealt.join(copied, ["district", "_cell"])
    danger = F.col("safety_level") == "Dangerous"
    early = (F.col("safety_level") == "Moderate") & ~F.col("seen")
    early = early & (F.col("first_danger").isNull() | (F.col("ord") < F.col("first_danger")))
    text = F.when(
        danger,
        F.concat(F.lit("⚠️ Dangerous spot in "), F.upper("district"), F.lit(": "), "name", F.lit(" ("), "_hazard", F.lit(")")),
    ).otherwise(
        F.concat(F.lit("⚠️ Caution in "), F.upper("district"), F.lit(": "), "name", F.lit(" ("), "_rain", F.lit(")"))
    )
    spot_rows = near.where(danger | early).select(
        route_id, F.lit(0).alias("stage"), "pos", "ord", text.alias("caution")
    )
    level = F.col("alert.level")
    red = level == "Red"
    amber = (level == "Amber") & ~F.col("any_danger") & ~F.col("red_before")
    tail = F.concat(
        F.upper("district"), F.lit(": "), "alert.hazard", F.lit(" ("), "alert.bulletin", F.lit(")")
    )
    lead = F.when(red, "🚨 Evacuate immediately in ").otherwise("⚠️ DMC Warning in ")
    alert_rows = stops.where(red | amber).select(
        route_id, F.lit(1).alias("stage"), "pos", F.lit(0).cast("long").alias("ord"),
        F.concat(lead, tail).alias("caution"),
    )
    return spot_rows.unionByName(alert_rows)
