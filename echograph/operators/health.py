"""Health of a server and its tasks, and gates of a solve by all the nodes that gave it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echograph.functions import geo

# Seconds since a task's last success after which a server is ill, and shares and amounts beyond which it is.
TASKS = {"frame_processor": 20, "analytics_refresh": 120, "aircraft_flush": 15}
QUEUE_FULL, QUEUE_HIGH, LATENCY_S, DISK_MB, MEMORY_MB, DROPOUT, PEAK, WARM_FRAMES, MANY, ANOMALOUS, ERROR_KM, TRUSTED, MISS_RATE = 0.9, 0.5, 30, 500, 3000, 0.8, 10, 500, 10, 0.5, 10, 20, 0.98
#: A task is late beyond so many times its interval.
LATE = 2


def issues(status: DataFrame, key: str, dropout: float = DROPOUT, miss_rate: float = MISS_RATE) -> DataFrame:
    """(key, type, severity, message): a row for each condition that a server's status row fulfils; none for a healthy one.

    A status row has now_s, task_last (a map of task to the time of its last success), the queues' sizes and bounds, and the amounts that the
    conditions name. What is null is not known and raises nothing.
    """
    c, text = F.col, lambda x: x.cast("string")
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    percent = lambda x: F.concat(text(F.bround(x * 100).cast("long")), F.lit("%"))
    whole = lambda x: text(F.bround(x).cast("long"))
    queue, solver = share("frame_queue", "frame_queue_most"), share("solver_queue", "solver_queue_most")
    rules = [("frame_queue_saturated", "critical", queue > QUEUE_FULL, F.concat(F.lit("Frame queue saturated ("), percent(queue), F.lit(")")))]
    for task, most in TASKS.items():
        age = c("now_s") - F.try_element_at("task_last", F.lit(task))
        rules.append((f"stale_task:{task}", "critical", age > most, F.concat(F.lit(f"Task {task} stale ("), whole(age), F.lit("s since last success)"))))
    rules += [
        ("config_degraded", "warning", F.coalesce("config_fallback", F.lit("")) != "", F.concat(F.lit("tower_config.json unusable, "), c("config_fallback"))),
        ("solver_queue_drops", "warning", c("solver_drops") > 0, F.concat(F.lit("Solver dropped "), text(c("solver_drops")), F.lit(" jobs"))),
        ("disk_low", "critical", c("disk_free_mb") < DISK_MB, F.concat(F.lit("Disk low: "), whole(c("disk_free_mb")), F.lit("MB free"))),
        ("memory_high", "critical", c("rss_mb") > MEMORY_MB, F.concat(F.lit("Memory high: "), whole(c("rss_mb")), F.lit("MB RSS"))),
        ("solver_queue_high", "warning", solver > QUEUE_HIGH, F.concat(F.lit("Solver queue high ("), percent(solver), F.lit(")"))),
        ("solver_latency_high", "warning", c("solver_latency_s") > LATENCY_S, F.concat(F.lit("Solver latency high ("), whole(c("solver_latency_s")), F.lit("s)"))),
        ("node_dropout", "critical", (c("peak_nodes") > PEAK) & (c("active_nodes") < c("peak_nodes") * dropout), F.concat(F.lit("Node dropout: "), text(c("active_nodes")), F.lit("/"), text(c("peak_nodes")), F.lit(" active"))),
        ("no_active_tracks", "critical", (c("frames") > WARM_FRAMES) & (c("aircraft") == 0) & (c("solves") == 0), F.lit("No active tracks after warmup")),
        ("anomaly_flood", "warning", (c("aircraft") > MANY) & (c("anomalies") / c("aircraft") > ANOMALOUS), F.concat(F.lit("Anomaly flood: "), text(c("anomalies")), F.lit("/"), text(c("aircraft")))),
        ("solver_accuracy_degraded", "warning", (c("trusted_n") > TRUSTED) & (c("trusted_km") > ERROR_KM), F.concat(F.lit("Solver mean error "), F.format_string("%.1f", F.bround("trusted_km", 1)), F.lit("km over "), text(c("trusted_n")), F.lit(" trusted-position samples"))),
        ("high_miss_rate", "warning", c("miss_rate") > miss_rate, F.concat(F.lit("High miss rate ("), percent(c("miss_rate")), F.lit(")"))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(level).alias("severity"), message.alias("message"))) for kind, level, test, message in rules]))
    return status.select(key, F.explode(found).alias("i")).select(key, "i.type", "i.severity", "i.message")


def stale_tasks(tasks: DataFrame, now_s: Column, last: str = "last_success_s", interval: str = "interval_s") -> DataFrame:
    """The tasks whose last success is more than LATE intervals ago; one without any success hasn't begun."""
    return tasks.where(now_s - F.col(last) > F.col(interval) * LATE)


def forgotten(nodes: DataFrame, now_s: Column, synthetic: Column, days: int = 7) -> DataFrame:
    """The made-up nodes that have been disconnected for more than ``days``."""
    return nodes.where(synthetic & (F.col("status") == "disconnected") & (now_s - F.col("last_seen_s") > days * 86400))


def fleet_totals(nodes: DataFrame) -> DataFrame:
    """Over all nodes: how many, connected ones, detections, and the mean trust of those that have any."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") != "disconnected").alias("connected"), F.coalesce(F.sum("detections"), F.lit(0)).alias("detections"), F.bround(F.avg("trust"), 4).alias("mean_trust"))


def beam_failures(solves: DataFrame, nodes: DataFrame, key: str = "key") -> DataFrame:
    """(key, failures): each solve with the contributing nodes that can't have seen it, in order; an empty array if all can.

    solves have key, lat, lon and node_ids; nodes have node_id and the settings of in_beam. A node's range decides (its limit of excess, else its
    distance), and, for a solve of two nodes only, its beam too: a wedge says where a detection was made, not where a longer track is now. Nodes without
    settings decide nothing.
    """
    c = F.col
    each = solves.select(key, "lat", "lon", F.size("node_ids").alias("_n"), F.posexplode("node_ids").alias("_at", "node_id"))
    rows = each.join(nodes, "node_id")
    limit = geo.finite(F.nullif(c("max_excess"), F.lit(0.0)))
    excess = F.when(limit.isNotNull() & c("tx_lat").isNotNull(), geo.excess_km(c("lat"), c("lon"), c("rx_lat"), c("rx_lon"), c("tx_lat"), c("tx_lon")))
    away = geo.haversine_km(c("rx_lat"), c("rx_lon"), c("lat"), c("lon"))
    far = F.coalesce(excess > limit, away > geo.or_default(c("max_range"), geo.MAX_RANGE_KM))
    aim = geo.beam_azimuth(c("azimuth"), c("rx_lat"), c("rx_lon"), c("tx_lat"), c("tx_lon"))
    off = geo.fold_deg(geo.bearing_deg(c("rx_lat"), c("rx_lon"), c("lat"), c("lon")) - aim)
    aside = (c("_n") == 2) & F.coalesce(off > geo.or_default(c("width"), geo.BEAM_WIDTH_DEG) / 2, F.lit(False))
    failure = F.struct("_at", "node_id", F.when(far, "range").otherwise("bearing").alias("rule"), F.bround(away, 1).alias("range_km"), F.bround(excess, 1).alias("excess_km"), F.bround(off, 1).alias("off_deg"))
    bad = rows.where(far | aside).groupBy(key).agg(F.array_sort(F.collect_list(failure)).alias("_f"))
    found = F.transform("_f", lambda f: F.struct(f["node_id"].alias("node_id"), f["rule"].alias("rule"), f["range_km"].alias("range_km"), f["excess_km"].alias("excess_km"), f["off_deg"].alias("off_deg")))
    return solves.select(key).join(bad, key, "left").select(key, F.coalesce(found, F.array().cast("array<struct<node_id:bigint,rule:string,range_km:double,excess_km:double,off_deg:double>>")).alias("failures"))
