"""Work that follows what differs among the rows, and tasks that don't grow with them."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echograph.operators import association, joins, links, pieces, reports, scores, solving, towers
from echograph.plans import association as detections
from echograph.plans import checks
from echograph.plans import solving as solves
from echograph.streaming import state


def tables(spark, tmp_path, events=0, suppliers=0):
    spark.range(events).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_events_of_one_target_are_solved_once(spark, tmp_path, monkeypatch):
    asked, plain = [], solving.fit_tracks
    monkeypatch.setattr(solving, "fit_tracks", lambda rows, *a: asked.append(rows.count()) or plain(rows, *a))
    spark.range(60).select(((F.col("id") % 20) + F.floor(F.col("id") / 20) * 5000).alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(12).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = solves.track_fits(spark, str(tmp_path)).toPandas()
    assert asked == [20] and len(found) == 60
    assert len(found.drop(columns="solve").assign(k=found.solve % 5000).drop_duplicates()) == 20


def test_arcs_are_drawn_above_the_dealing(spark, tmp_path):
    found = checks.ambiguity_arcs(spark, tables(spark, tmp_path, suppliers=40))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "transform(" not in below and found.count() > 0


def test_rule_of_limits_is_the_step(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("node"), F.col("id").alias("seq"), (F.col("id") * F.col("id") % 90_001 * 3).alias("at_s"))
    step = state.over_batch(rows, "node", "at_s", state.windowed_limits("at_s", [(1, 3600), (2, 86400)]), "node long, seq long, at_s long")
    rule = pieces.through(rows.withColumn("_piece", F.col("node").cast("string")), ["at_s", "seq"], state.within_limits("at_s", [(1, 3600), (2, 86400)]), ["kept"], "node long, seq long, at_s long, kept boolean").where("kept").drop("kept")
    assert sorted(step.collect()) == sorted(rule.collect())


def test_parts_follow_the_rows(spark):
    assert links.parts_of(spark, 216_000_000) == 216 and links.parts_of(spark, 0) == spark.sparkContext.defaultParallelism
    uses = spark.range(500).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").alias("seq"), (F.col("id") % 20).alias("source"))
    assert sorted(reports.superseded(uses, "key", "seq", "source", 40).collect()) == sorted(reports.superseded(uses, "key", "seq", "source").collect())


def test_nearest_truth_is_that_of_all_pairs(spark):
    at = lambda name, n, m: spark.range(n).select((F.col("id") % 2 * 20).alias("grid_s"), F.col("id").alias(name), (34.5 + F.col("id") % m * 0.01).alias("lat"), F.lit(-82.0).alias("lon"), (F.col("id") % 9).cast("double").alias("vel_east"), (F.col("id") % 5).cast("double").alias("vel_north"))
    truths, tracks = at("hex", 60, 7), at("key", 90, 11)
    best = scores.near_truth(truths, tracks, 3.0).groupBy("grid_s", "key").agg(F.min(F.struct("distance_m", "hex", "velocity_ms")).alias("m")).select("grid_s", "key", "m.hex", "m.distance_m", "m.velocity_ms")
    found = scores.nearest_truth(truths, tracks, 3.0)
    assert found.count() and sorted(best.collect()) == sorted(found.collect())
    assert "BroadcastHashJoin" not in scores.nearest_truth(truths, tracks, 3.0)._jdf.queryExecution().executedPlan().toString()


def test_candidates_at_one_place_add_alike(spark):
    nodes = spark.createDataFrame([(34.5, -82.0, 34.6, -82.1, None, 60.0, 30.0, None)] * 2 + [(34.4, -82.1, 34.6, -82.1, 90.0, None, 20.0, None)], "rx_lat double, rx_lon double, tx_lat double, tx_lon double, azimuth double, width double, max_range double, max_excess double")
    asked = spark.createDataFrame([(1, 34.45, -82.05), (2, 34.45, -82.05), (3, None, None)], "candidate long, rx_lat double, rx_lon double")
    found = {r.candidate: tuple(r)[1:] for r in towers.coverage_added(asked, nodes).collect()}
    alone = {r.candidate: tuple(r)[1:] for r in towers.coverage_added(asked.where("candidate = 2"), nodes).collect()}
    assert found[1] == found[2] == alone[2] and found[3] == (0.0, 0.0, 0.0)
    once = {r.candidate: tuple(r)[1:] for r in towers.coverage_added(asked, nodes.distinct()).collect()}
    assert once[2] != found[2]  # equal nodes count as many


def test_links_follow_keys_and_crowds_not_rows(spark, monkeypatch):
    asked, plain = [], pieces.components
    monkeypatch.setattr(pieces, "components", lambda spark, edges, tables: asked.append(edges.where("a != b").distinct().count()) or plain(spark, edges, tables))
    k = F.col("id")
    for n in (400, 4000):
        solves = spark.range(n).select(k.alias("seq"), (k % 100).cast("double").alias("at_s"), (34 + k % 7 * 0.001).alias("lat"), F.lit(-82.0).alias("lon"), F.lit(9.0).alias("vel_east"), F.lit(9.0).alias("vel_north"), F.when(k % 5 == 0, "h").alias("hex"), F.lit(None).cast("string").alias("anchor"), F.when(k % 3 == 0, F.array(F.lit("s"))).alias("sources"), F.array().cast("array<string>").alias("types"))
        assert pieces.track_identities(solves).count() == n
    assert asked[0] == asked[1] < 40
    claims = spark.range(4000).select(k.alias("seq"), (k % 100).alias("at_s"), F.lit(1.0).alias("chi2"), F.array((k % 3).cast("string"), F.lit("x")).alias("tracks"))
    assert pieces.track_claims(claims).count() == 4000 and asked[2] < 40


def test_what_is_repeated_for_cubes_beside_is_not_broadcast(spark, tmp_path):
    k = F.col("id")
    spark.range(300).select(k.alias("_row"), (k % 100).cast("double").alias("at_s"), (34 + k % 50 * 0.2).alias("lat"), F.lit(-82.0).alias("lon"), F.lit(9.0).alias("vel_east"), F.lit(9.0).alias("vel_north"), F.lit(None).cast("string").alias("hex"), F.lit(None).cast("string").alias("anchor")).write.parquet(f"{tmp_path}/solves")
    solves = spark.read.parquet(f"{tmp_path}/solves")
    pieces.crowds(solves).write.parquet(f"{tmp_path}/full")
    edges = pieces.reached(solves, spark.read.parquet(f"{tmp_path}/full"))
    lines, sent = edges._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = [*lines[i + 1 :], ""]
            sent += below[: next(j for j, x in enumerate(below) if depth(x) <= depth(line))]
    assert sent and not [x for x in sent if "Generate" in x] and edges.count()


def test_slots_alike_are_matched_once_and_sites_are_gone_over_once(monkeypatch):
    calls = {"_taken": 0, "fitting": 0, "site_cells": 0}

    def counted(name, plain):
        def run(*a):
            calls[name] += 1
            return plain(*a)

        return run

    for name in calls:
        monkeypatch.setattr(association, name, counted(name, getattr(association, name)))
    monkeypatch.setattr(association, "_kept", {}, raising=False)
    sites = {"a": (34.0, -82.0, 34.1, -82.3, np.nan, 360.0, 30.0, np.nan), "b": (34.1, -82.1, 33.9, -82.2, np.nan, 360.0, 30.0, np.nan)}
    rng = np.random.default_rng(1)
    seen = [(n, k, float(rng.uniform(5, 90)), float(rng.uniform(-100, 100))) for n in "ab" for k in range(12)]
    rows = pd.DataFrame([(slot, n, 100 * slot + k, d, w, *sites[n], 0, 0, 0, 0, 0) for slot in range(5) for n, k, d, w in rng.permutation(np.array(seen, object))], columns=["slot", "node_id", "det", "delay_us", "w", *association.AIM, "_class", "_part", "_i", "_j", "_g"])
    rows[["det", "slot"]] = rows[["det", "slot"]].astype(int)
    rows[["delay_us", "w"]] = rows[["delay_us", "w"]].astype(float)
    step = association._by_slot(True, 6)
    found = pd.concat([*step(iter([rows[:31], rows[31:]]))])
    assert calls == {"_taken": 1, "fitting": 1, "site_cells": 2} and len(found) > 10
    alone = pd.concat([*step(iter([rows[rows.slot == 3]]))])
    assert calls["site_cells"] == 2  # kept for the next task
    by = ["node_a", "node_b", "det_a", "det_b"]
    assert alone.sort_values(by).values.tolist() == found[found.slot == 3].sort_values(by).values.tolist()
    assert len(found) == 5 * len(alone) and ((found.det_a - found.slot * 100) < 12).all()


def test_aircraft_that_fly_alike_are_measured_once(spark, tmp_path, monkeypatch):
    asked, plain = [], joins.in_beams
    monkeypatch.setattr(joins, "in_beams", lambda nodes, targets, *a: asked.append((nodes.count(), targets.count())) or plain(nodes, targets, *a))
    spark.range(2400).where("id % 1200 < 60").select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(7200).where("id % 3600 < 90").select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    found = detections._detections(spark, str(tmp_path)).toPandas()
    assert asked == [(90, 60)] and len(found) > 100 and not found.duplicated().any()
    once = found[(found.det < 1200) & (found.node_id < 3600)]
    assert len(found) == 4 * len(once) and sorted(found.delay_us.unique()) == sorted(once.delay_us.unique())
    k = F.col("id")
    flown = spark.range(2400).where("id % 1200 < 60").select(k.alias("hex"), detections.su.lat(k * 3 + 1).alias("lat"), detections.su.lon(k * 5 + 2).alias("lon"))
    assert plain(detections._sites(spark, str(tmp_path)), flown).where("hex % 3 = node_id % 3").count() == len(found)
