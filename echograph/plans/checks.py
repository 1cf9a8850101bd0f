"""Queries: validation, health, gates, client filters, loci, feed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.functions import arcs, checks, gates, geo
from echograph.operators import feed, health, joins
from echograph.sources import archive

from . import surrogates as su

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _json(fields: dict[str, str]) -> str:
    """An SQL expression, alike in both dialects, for an object whose fields are made by expressions (null: absent)."""
    parts = [f"coalesce('\"{name}\": ' || {made} || ', ', '')" for name, made in fields.items()]
    return "'{' || " + " || ".join(parts) + " || '\"last\": 0}'"


def _number(name: str, every: int, odd: str, usual: str) -> str:
    return f"CASE WHEN k % {every} = 0 THEN {odd} WHEN k % {every} = 1 THEN 'true' WHEN k % {every} = 2 THEN '\"7\"' ELSE {usual} END"


_S = "CAST(k % 90 AS STRING)"
SETTINGS = {
    "rx_lat": _number("rx_lat", 101, "'90.5'", f"'3.' || {_S}"), "rx_lon": f"'-8.' || {_S}", "rx_alt_ft": "CASE WHEN k % 23 = 0 THEN '-1500.5' ELSE '900' END", "tx_lat": f"CASE WHEN k % 29 = 0 THEN '3.' || {_S} ELSE '4.5' END",
    "tx_lon": f"CASE WHEN k % 29 = 0 THEN '-8.' || {_S} ELSE '-7.25' END", "tx_alt_ft": "'1e3'", "fc_hz": _number("fc_hz", 103, "'999999'", "'195000000'"), "fs_hz": "CASE WHEN k % 31 = 0 THEN NULL ELSE '2000000' END",
    "max_range_km": "CASE WHEN k % 37 = 0 THEN '0' WHEN k % 37 = 1 THEN '1000' ELSE '50.5' END", "cpi_s": "'0.5'", "delay_tolerance_us": "CASE WHEN k % 41 = 0 THEN '-1' ELSE '1e9' END", "doppler_tolerance_hz": "'5'",
    "tx_callsign": "CASE WHEN k % 43 = 0 THEN '\"\"' WHEN k % 43 = 1 THEN '7' ELSE '\"WXYZ\"' END", "beam_width_deg": "CASE WHEN k % 47 = 0 THEN '361' WHEN k % 47 = 1 THEN '\"9\"' WHEN k % 3 = 0 THEN 'null' ELSE '42' END",
    "beam_azimuth_deg": "CASE WHEN k % 53 = 0 THEN '360' WHEN k % 2 = 0 THEN 'null' ELSE '0' END",
}
# the object ends in an allowed field instead of "last" but for some rows
CONFIG = f"CASE WHEN k % 59 = 0 THEN '[1]' WHEN k % 61 = 0 THEN {_json(SETTINGS)} ELSE replace({_json(SETTINGS)}, ', \"last\": 0}}', '}}') END"


def _fault_sql() -> str:
    """The rules of the settings as SQL over j, made from the same fixed bounds."""
    kind = lambda n: f"json_type(j, '$.{n}')"
    number = lambda n: f"({kind(n)} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'))"
    value = lambda n: f"CAST(json_extract(j, '$.{n}') AS DOUBLE)"
    tests = []
    for name, (low, high, equal) in checks.BOUNDS.items():
        tests.append(f"WHEN NOT {number(name)} THEN '{name}: not a number'")
        tests.append(f"WHEN {value(name)} {'<' if equal else '<='} {low}{f' OR {value(name)} > {high}' if high is not None else ''} THEN '{name}: out of range'")
    tests.append(f"WHEN {kind('tx_callsign')} <> 'VARCHAR' OR length(json_extract_string(j, '$.tx_callsign')) NOT BETWEEN 1 AND 32 THEN 'tx_callsign: out of range'")
    for name, inside in (("beam_width_deg", "> 0 AND {0} <= 360"), ("beam_azimuth_deg", ">= 0 AND {0} < 360")):
        tests.append(f"WHEN {kind(name)} <> 'NULL' AND NOT {number(name)} THEN '{name}: not a number'")
        tests.append(f"WHEN {kind(name)} <> 'NULL' AND NOT ({value(name)} {inside.format(value(name))}) THEN '{name}: out of range'")
    near = lambda a, b: f"abs({value(a)} - {value(b)}) < 1e-6"
    tests.append(f"WHEN {near('rx_lat', 'tx_lat')} AND {near('rx_lon', 'tx_lon')} THEN 'tx_lat: receiver and illuminator are at the same point'")
    names = "[" + ", ".join(f"'{x}'" for x in checks.SETTINGS) + "]"
    return f"""WITH c AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, {CONFIG} AS text FROM c), p AS (SELECT k, text::JSON AS j, CASE WHEN json_type(text) = 'OBJECT' THEN json_keys(text) END AS keys FROM t),
q AS (SELECT *, list_sort([x for x in keys if NOT list_contains({names}, x)]) AS extra, [x for x in {names} if NOT list_contains(keys, x)] AS missing FROM p)
SELECT k, CASE WHEN keys IS NULL THEN 'config: not an object' WHEN len(extra) > 0 THEN extra[1] || ': unknown field' WHEN len(missing) > 0 THEN missing[1] || ': missing' {' '.join(tests)} END AS fault FROM q"""


@query(_fault_sql())
def node_config_faults(spark: SparkSession, sf: str) -> DataFrame:
    t = su.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(CONFIG).alias("text"))
    return t.select("k", checks.node_config_fault(F.col("text")).alias("fault"))


WIRE = {
    "rx_lat": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 'null' WHEN k % 11 = 0 THEN '\"north\"' WHEN k % 13 = 0 THEN '\"34.5\"' WHEN k % 17 = 0 THEN '91' ELSE '34' END", "lat": "CASE WHEN k % 3 = 0 THEN '12.5' END", "lon": "'-82.5'",
    "beam_width_deg": "CASE WHEN k % 19 = 0 THEN '0' WHEN k % 19 = 1 THEN '\"wide\"' WHEN k % 19 = 2 THEN 'null' WHEN k % 19 = 3 THEN '360' END", "max_range_km": "CASE WHEN k % 23 = 0 THEN '0' WHEN k % 23 = 1 THEN '[1]' WHEN k % 23 = 2 THEN '\"50\"' END",
}


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer), t AS (SELECT k, ({_json(WIRE)})::JSON AS j FROM c),
p AS (SELECT k, CASE WHEN json_exists(j, '$.rx_lat') THEN json_extract_string(j, '$.rx_lat') ELSE json_extract_string(j, '$.lat') END AS lat, CASE WHEN json_exists(j, '$.rx_lon') THEN json_extract_string(j, '$.rx_lon') ELSE json_extract_string(j, '$.lon') END AS lon,
  json_extract_string(j, '$.beam_width_deg') AS w, json_extract_string(j, '$.max_range_km') AS r FROM t)
SELECT k, CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing lat/lon' WHEN try_cast(lat AS DOUBLE) IS NULL OR try_cast(lon AS DOUBLE) IS NULL THEN 'non-numeric lat/lon' WHEN NOT (lat::DOUBLE BETWEEN -90 AND 90 AND lon::DOUBLE BETWEEN -180 AND 180) THEN 'lat/lon out of range'
 WHEN w IS NOT NULL AND try_cast(w AS DOUBLE) IS NULL THEN 'non-numeric beam_width_deg' WHEN w IS NOT NULL AND NOT (w::DOUBLE > 0 AND w::DOUBLE <= 360) THEN 'beam_width_deg out of range'
 WHEN r IS NOT NULL AND try_cast(r AS DOUBLE) IS NULL THEN 'non-numeric max_range_km' WHEN r IS NOT NULL AND r::DOUBLE <= 0 THEN 'max_range_km must be positive' END AS fault FROM p""")
def wire_config_faults(spark: SparkSession, sf: str) -> DataFrame:
    t = su.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).select("k", F.expr(_json(WIRE)).alias("text"))
    return t.select("k", checks.wire_config_fault(F.col("text")).alias("fault"))


FRAMES = {
    "t": "CASE WHEN k % 41 = 0 THEN '-1' WHEN k % 41 = 1 THEN '\"5\"' ELSE '1700000000.25' END", "seq": "CASE WHEN k % 43 = 0 THEN '1.5' WHEN k % 43 = 1 THEN '-2' WHEN k % 43 = 2 THEN '3.0' ELSE CAST(k AS STRING) END",
    "boot_id": "CASE WHEN k % 47 = 0 THEN '\"short\"' WHEN k % 47 = 1 THEN '12345678' ELSE '\"abcdef0123\"' END", "config_version": "CASE WHEN k % 53 = 0 THEN '0' WHEN k % 53 = 1 THEN '\"7\"' WHEN k % 53 = 2 THEN NULL ELSE '3' END",
    "delay": "CASE WHEN k % 31 = 0 THEN '[1, 2]' ELSE '[1, 2.5, 3]' END", "doppler": "CASE WHEN k % 29 = 0 THEN '[1, true, 2]' ELSE '[1, -2, 0]' END", "snr": "CASE WHEN k % 37 = 0 THEN '[9, \"8\", 7]' WHEN k % 37 = 1 THEN '5' ELSE '[9, 8, 7]' END",
    "adsb_hex": "CASE WHEN k % 23 = 0 THEN '[null, \"ABCDEF\", null]' ELSE '[null, \"abc123\", null]' END",
}
_GOOD = lambda f: f"json_type(j, '$.{f}') = 'ARRAY' AND len([x for x in json_extract(j, '$.{f}[*]') if NOT list_contains(num, json_type(x))]) = 0"
FRAME_TEXT = f"CASE WHEN k % 59 = 0 THEN {_json(FRAMES)} ELSE replace({_json(FRAMES)}, ', \"last\": 0}}', '}}') END"


@query(f"""WITH c AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, ({FRAME_TEXT})::JSON AS j FROM c), n AS (SELECT *, ['UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT'] AS num, json_keys(j) AS keys FROM t),
p AS (SELECT *, list_sort([x for x in keys if NOT list_contains([{", ".join(f"'{x}'" for x in checks.FRAME)}], x)]) AS extra, [x for x in [{", ".join(f"'{x}'" for x in checks.FRAME)}] if NOT list_contains(keys, x)] AS missing,
  [{_GOOD("delay")}, {_GOOD("doppler")}, {_GOOD("snr")}] AS good FROM n)
SELECT k, CASE WHEN len(extra) > 0 THEN extra[1] WHEN len(missing) > 0 THEN missing[1] WHEN NOT list_contains(num, json_type(j, '$.t')) OR (j->>'$.t')::DOUBLE < 0 THEN 't'
 WHEN NOT list_contains(num, json_type(j, '$.seq')) OR (j->>'$.seq')::DOUBLE < 0 OR (j->>'$.seq')::DOUBLE <> floor((j->>'$.seq')::DOUBLE) THEN 'seq' WHEN json_type(j, '$.boot_id') <> 'VARCHAR' OR NOT regexp_matches(j->>'$.boot_id', '^[0-9a-z]{{8,32}}$') THEN 'boot_id'
 WHEN NOT list_contains(num, json_type(j, '$.config_version')) OR (j->>'$.config_version')::DOUBLE < 1 THEN 'config_version' WHEN NOT good[1] THEN 'delay' WHEN NOT good[2] THEN 'doppler' WHEN NOT good[3] THEN 'snr'
 WHEN len([x for x in json_extract_string(j, '$.adsb_hex[*]') if x IS NOT NULL AND x <> 'null' AND NOT regexp_matches(x, '^[0-9a-f]{{6}}$')]) > 0 THEN 'adsb_hex'
 WHEN json_array_length(j, '$.delay') <> json_array_length(j, '$.doppler') OR json_array_length(j, '$.delay') <> json_array_length(j, '$.snr') OR json_array_length(j, '$.delay') <> json_array_length(j, '$.adsb_hex') THEN 'lengths' END AS fault FROM p""")
def frame_faults(spark: SparkSession, sf: str) -> DataFrame:
    t = su.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.expr(FRAME_TEXT).alias("text"))
    return t.select("k", checks.frame_fault(F.col("text")).alias("fault"))


# made-up servers, one a part: the same expressions in both dialects
STATUS = {
    "now_s": "CAST(1000000 + k AS DOUBLE)", "frame_queue": "k % 120", "frame_queue_most": "100", "solver_queue": "k % 90", "solver_queue_most": "k % 160", "config_fallback": "CASE WHEN k % 50 = 0 THEN 'defaults in use' END", "solver_drops": "k % 4 - 1",
    "disk_free_mb": "CAST(400 + k % 4000 AS DOUBLE)", "rss_mb": "CAST(k % 3300 AS DOUBLE)", "solver_latency_s": "CAST(k % 40 AS DOUBLE)", "peak_nodes": "k % 30", "active_nodes": "k % 27", "frames": "k % 1000", "aircraft": "k % 25", "solves": "k % 2", "anomalies": "k % 14",
    "trusted_n": "k % 33", "trusted_km": "CAST(k % 48 AS DOUBLE) / 4", "miss_rate": "CAST(k % 101 AS DOUBLE) / 100",
}
AGES = {"frame_processor": "CAST(k % 30 AS DOUBLE)", "analytics_refresh": "CASE WHEN k % 9 > 0 THEN CAST(k % 200 AS DOUBLE) END", "aircraft_flush": "CAST(k % 16 AS DOUBLE)"}


def _issues_sql() -> str:
    pick = ", ".join(f"{e} AS {n}" for n, e in STATUS.items()) + ", " + ", ".join(f"{e} AS age_{n}" for n, e in AGES.items())
    pc, whole = lambda x: f"CAST(round_even({x} * 100, 0) AS BIGINT) || '%'", lambda x: f"CAST(round_even({x}, 0) AS BIGINT)"
    q, s = "frame_queue::DOUBLE / greatest(frame_queue_most, 1)", "solver_queue::DOUBLE / greatest(solver_queue_most, 1)"
    rules = [("frame_queue_saturated", "critical", f"{q} > 0.9", f"'Frame queue saturated (' || {pc(q)} || ')'")]
    rules += [(f"stale_task:{t}", "critical", f"age_{t} > {most}", f"'Task {t} stale (' || {whole('age_' + t)} || 's since last success)'") for t, most in (("frame_processor", 20), ("analytics_refresh", 120), ("aircraft_flush", 15))]
    rules += [
        ("config_degraded", "warning", "config_fallback IS NOT NULL", "'tower_config.json unusable, ' || config_fallback"), ("solver_queue_drops", "warning", "solver_drops > 0", "'Solver dropped ' || solver_drops || ' jobs'"),
        ("disk_low", "critical", "disk_free_mb < 500", f"'Disk low: ' || {whole('disk_free_mb')} || 'MB free'"), ("memory_high", "critical", "rss_mb > 3000", f"'Memory high: ' || {whole('rss_mb')} || 'MB RSS'"),
        ("solver_queue_high", "warning", f"{s} > 0.5", f"'Solver queue high (' || {pc(s)} || ')'"), ("solver_latency_high", "warning", "solver_latency_s > 30", f"'Solver latency high (' || {whole('solver_latency_s')} || 's)'"),
        ("node_dropout", "critical", "peak_nodes > 10 AND active_nodes < peak_nodes * 0.8::DOUBLE", "'Node dropout: ' || active_nodes || '/' || peak_nodes || ' active'"), ("no_active_tracks", "critical", "frames > 500 AND aircraft = 0 AND solves = 0", "'No active tracks after warmup'"),
        ("anomaly_flood", "warning", "aircraft > 10 AND anomalies::DOUBLE / aircraft > 0.5", "'Anomaly flood: ' || anomalies || '/' || aircraft"), ("solver_accuracy_degraded", "warning", "trusted_n > 20 AND trusted_km > 10", "'Solver mean error ' || printf('%.1f', round_even(trusted_km, 1)) || 'km over ' || trusted_n || ' trusted-position samples'"),
        ("high_miss_rate", "warning", "miss_rate > 0.98", f"'High miss rate (' || {pc('miss_rate')} || ')'"),
    ]
    return f"WITH p AS (SELECT p_partkey AS k FROM part), s AS (SELECT k, {pick} FROM p) " + " UNION ALL ".join(f"SELECT k, '{t}' AS type, '{v}' AS severity, {m} AS message FROM s WHERE {c}" for t, v, c, m in rules)


@query(_issues_sql())
def health_issues(spark: SparkSession, sf: str) -> DataFrame:
    p = su.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    status = p.select("k", *[F.expr(e).alias(n) for n, e in STATUS.items()], F.create_map(*[x for n, e in AGES.items() for x in (F.lit(n), F.expr(f"CAST(1000000 + k AS DOUBLE) - {e}"))]).alias("task_last"))
    return health.issues(status, "k")


@query("SELECT p_partkey AS task FROM part WHERE 100000 - (p_partkey * 7919 % 100000) > 2 * (p_size * 900) AND p_partkey % 10 > 0")
def late_tasks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    tasks = su.table(spark, sf, "part").select(k.alias("task"), F.when(k % 10 > 0, k * 7919 % 100000).alias("last_success_s"), (F.col("p_size") * 900).alias("interval_s"))
    return health.stale_tasks(tasks, F.lit(100000)).select("task")


@query("""SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal < 3000 AND 10000000 - s_suppkey * 7919 % 10000000 > 7 * 86400""")
def forgotten_nodes(spark: SparkSession, sf: str) -> DataFrame:
    from echograph.functions import radio

    k = F.col("s_suppkey")
    n = su.table(spark, sf, "supplier").select(k.alias("node_id"), F.concat(F.when(k % 3 == 0, "synth-").otherwise("ret"), k.cast("string")).alias("name"), F.when(F.col("s_acctbal") < 3000, "disconnected").otherwise("active").alias("status"), (k * 7919 % 10000000).alias("last_seen_s"))
    return health.forgotten(n, F.lit(10000000), radio.synthetic(F.col("name"))).select("node_id")


@query("SELECT count(*) AS nodes, count(*) FILTER (s_acctbal >= 0) AS connected, sum(s_nationkey)::BIGINT AS detections, round_even(avg(CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 100) / 100.0::DOUBLE END), 4) AS mean_trust FROM supplier")
def fleet_totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = su.table(spark, sf, "supplier").select(F.when(F.col("s_acctbal") < 0, "disconnected").otherwise("active").alias("status"), F.col("s_nationkey").cast("long").alias("detections"), F.when(k % 4 > 0, (k % 100) / 100.0).alias("trust"))
    return health.fleet_totals(n)


TAGS = "[CASE WHEN {0} % 3 = 0 THEN NULL ELSE ' AB' || ({0} % 5) END, CASE WHEN {0} % 2 = 0 THEN 'ab' || ({0} % 5) END, CASE WHEN {0} % 11 = 0 THEN 'ab9' ELSE '' END, CASE WHEN {0} % 7 = 0 THEN 'AB' || ({0} % 5) END, NULL]"


@query(f"""WITH c AS (SELECT o_orderkey AS k, {TAGS.format("o_orderkey")} AS tags, CASE WHEN o_orderkey % 13 < 6 THEN 'Ab' || (o_orderkey % 6) END AS own FROM orders),
t AS (SELECT *, list_transform(tags, lambda x: CASE WHEN trim(x) <> '' THEN lower(trim(x)) END) AS v FROM c), d AS (SELECT *, list_distinct([x for x in v if x IS NOT NULL]) AS u FROM t)
SELECT k, CASE WHEN len(u) = 1 AND (own IS NULL OR lower(own) = u[1]) AND len([x for x in v[-3:] if x IS NOT NULL]) > 0 THEN u[1] END AS tag FROM d""")
def view_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    five, none = (k % 5).cast("string"), F.lit(None).cast("string")
    tags = F.array(F.when(k % 3 != 0, F.concat(F.lit(" AB"), five)), F.when(k % 2 == 0, F.concat(F.lit("ab"), five)), F.when(k % 11 == 0, "ab9").otherwise(""), F.when(k % 7 == 0, F.concat(F.lit("AB"), five)), none)
    own = F.when(k % 13 < 6, F.concat(F.lit("Ab"), (k % 6).cast("string")))
    return su.table(spark, sf, "orders").select(k.alias("k"), gates.view_tag(own, tags).alias("tag"))


@query("""WITH h AS (SELECT l_orderkey AS track, list(l_linenumber ORDER BY l_linenumber) AS h, l_orderkey % 3 AS s FROM lineitem GROUP BY l_orderkey) SELECT track, CAST(h[-3:] AS VARCHAR) AS newest FROM h WHERE s > 0 AND len(h) >= 2""")
def confirmed_views(spark: SparkSession, sf: str) -> DataFrame:
    h = su.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("h"))
    seen = h.select("track", gates.confirmed_view(F.when(F.col("track") % 3 == 0, "tentative").otherwise("CONFIRMED"), F.col("h"), 3).alias("v")).where("v is not null")
    return seen.select("track", F.concat(F.lit("["), F.array_join(F.col("v").cast("array<string>"), ", "), F.lit("]")).alias("newest"))


@query("""WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity AS e, CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice / 10000.0::DOUBLE END AS chi2, l_linenumber AS n, l_orderkey % 9 AS epochs, l_returnflag = 'R' AS sat, l_orderkey % 5 > 0 AS ok FROM lineitem),
g AS (SELECT *, coalesce(ok AND epochs >= 4 AND chi2 <= 5, false) AS good FROM p)
SELECT k, CASE WHEN good THEN e + 1 ELSE e END AS east, CASE WHEN good THEN 'cv_fit' ELSE 'solve' END AS source, sat OR (NOT good AND n <= 3) AS untrusted, CASE WHEN n = 2 AND coalesce(chi2 > 2, true) THEN 'n2_unconfirmed' ELSE 'published' END AS outcome,
CASE WHEN n = 2 THEN epochs > 4 ELSE sat OR epochs > 4 END AS in_view FROM g""")
def solve_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    n, e, epochs = c("l_linenumber"), c("l_quantity").cast("double"), c("l_orderkey") % 9
    chi2, saturated = F.when(n % 3 > 0, c("l_extendedprice") / 10000.0), c("l_returnflag") == "R"
    solve = F.struct(e.alias("east"), F.lit(0.0).alias("north"), F.lit(0.0).alias("up"))
    fit = F.struct((e + 1).alias("east"), F.lit(1.0).alias("north"), F.lit(0.0).alias("up"), (c("l_orderkey") % 5 > 0).alias("success"), epochs.alias("n_epochs"), chi2.alias("chi2_per_dof"))
    v = gates.adopted_velocity(solve, fit, n, saturated)
    rows = su.table(spark, sf, "lineitem").select((c("l_orderkey") * 8 + n).alias("k"), v.alias("v"), gates.pair_outcome(n, chi2).alias("outcome"), gates.in_view_of(n, epochs > 4, saturated).alias("in_view"))
    return rows.select("k", c("v.east").alias("east"), c("v.source").alias("source"), c("v.untrusted").alias("untrusted"), "outcome", "in_view")


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey * 37 % 181 - 90 AS lat, c_custkey * 101 % 361 - 180 AS lon, printf('%x', c_custkey * 7919 % 16777216) AS hex, ['7500', ' 7600 ', '7700', '1200', NULL][c_custkey % 5 + 1] AS squawk, c_name AS flight FROM customer), h AS (SELECT *, (k * 7919 % 16777216) AS n FROM p)
SELECT k, CASE WHEN lat BETWEEN -45 AND -10 AND lon BETWEEN 112 AND 155 THEN 'au' WHEN lat BETWEEN 42 AND 84 AND lon BETWEEN -141 AND -52 THEN 'ca' ELSE 'us' END AS register,
 CASE WHEN n BETWEEN 11403264 AND 11534335 THEN 'US Military' WHEN n BETWEEN 11401160 AND 11403263 THEN 'US Military' WHEN n BETWEEN 4440064 AND 4444159 THEN 'RAF / UK Mil' WHEN n BETWEEN 3895296 AND 3932159 THEN 'FR Military'
  WHEN n BETWEEN 4161536 AND 4194303 THEN 'DE Military' WHEN n BETWEEN 12713984 AND 12845055 THEN 'CA Military' WHEN n BETWEEN 5046272 AND 5047295 THEN 'Eurocontrol' END AS kind,
 CASE trim(squawk) WHEN '7500' THEN 'Hijack (7500)' WHEN '7600' THEN 'Radio failure (7600)' WHEN '7700' THEN 'Emergency (7700)' END AS distress, lat BETWEEN -11.5 AND 21.5 AND lon BETWEEN -31.5 AND 41.5 AS visible, contains(hex, 'a1') OR contains(lower(flight), 'a1') AS matches FROM h""")
def client_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = k * 37 % 181 - 90, k * 101 % 361 - 180
    hex_, squawk = F.lower(F.hex(k * 7919 % 16777216)), F.get(F.array(*map(F.lit, ["7500", " 7600 ", "7700", "1200", None])), (k % 5).cast("int"))
    return su.table(spark, sf, "customer").select(
        k.alias("k"), gates.register_of(lat, lon).alias("register"), gates.address_kind(F.concat(F.when(k % 2 == 0, "~").otherwise(""), hex_)).alias("kind"), gates.distress(squawk).alias("distress"),
        gates.in_viewport(lat, lon, -10, -30, 20, 40).alias("visible"), gates.text_match("A1", hex_, F.col("c_name")).alias("matches"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN 'multinode_solve' END AS source, p_partkey % 4 = 0 AS multi, CASE WHEN p_partkey % 5 > 0 THEN p_size * 900 END AS alt, CASE WHEN p_partkey % 7 > 0 THEN p_size * 11 END AS gs, CASE WHEN p_partkey % 6 = 0 THEN 'drone' END AS kind FROM part)
SELECT k FROM p WHERE (source IS NOT NULL OR multi) AND coalesce(alt, 0) / 100.0 BETWEEN 50 AND 350 AND coalesce(gs, 0) >= 60 AND coalesce(kind, '') <> 'drone'""")
def shown_aircraft(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    source, alt, gs, kind = F.when(k % 3 > 0, "multinode_solve"), F.when(k % 5 > 0, size * 900), F.when(k % 7 > 0, size * 11), F.when(k % 6 == 0, "drone")
    return su.table(spark, sf, "part").where(gates.shown(source, k % 4 == 0, alt, gs, kind, least_fl=50, most_fl=350, least_knots=60, only="aircraft")).select(k.alias("k"))


@query("""SELECT event_id AS seq FROM events WHERE ['info', 'warning', 'error', 'debug', NULL][event_id % 5 + 1] IN ('warning', 'error', 'critical') OR event_type IN ('node', 'config', 'system') ORDER BY event_id DESC LIMIT 100""")
def newest_user_alerts(spark: SparkSession, sf: str) -> DataFrame:
    level = F.get(F.array(*map(F.lit, ["info", "warning", "error", "debug", None])), (F.col("event_id") % 5).cast("int"))
    return su.table(spark, sf, "events").where(gates.user_alert(level, F.col("event_type"))).orderBy(F.desc("event_id")).limit(100).select(F.col("event_id").alias("seq"))


@query("WITH f AS (SELECT l_orderkey AS frame, list(l_quantity / 5.0::DOUBLE) AS snr FROM lineitem GROUP BY 1) SELECT frame, len([x for x in snr if x > 8]) > 0 AS clear FROM f")
def clear_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = su.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(F.col("l_quantity") / 5.0).alias("snr"))
    return f.select("frame", gates.has_clear_detection(F.col("snr")).alias("clear"))


BASE = su.km_sql("rx_lat", "rx_lon", "tx_lat", "tx_lon")
ACROSS = f"(CASE WHEN {su.bearing_sql('rx_lat', 'rx_lon', 'tx_lat', 'tx_lon')} + 90 >= 360 THEN {su.bearing_sql('rx_lat', 'rx_lon', 'tx_lat', 'tx_lon')} - 270 ELSE {su.bearing_sql('rx_lat', 'rx_lon', 'tx_lat', 'tx_lon')} + 90 END)"
PER_DEG = f"{geo.KM_PER_DEG!r}::DOUBLE"


@query(f"""WITH {su.SITES}, m AS (SELECT *, (node_id * 37 % 300) + 5.0::DOUBLE AS delay, coalesce(azimuth, {ACROSS}) AS aim, (tx_lon - rx_lon) * cos(radians(rx_lat)) * {PER_DEG} AS e, (tx_lat - rx_lat) * {PER_DEG} AS nn FROM n),
b AS (SELECT *, delay * 0.299792458 AS d, sqrt(e * e + nn * nn) AS base, degrees(atan2(e, nn)) AS to_tx FROM m), s AS (SELECT *, unnest(range(37)) AS i FROM b), q AS (SELECT *, aim - width / 2 + width * (i / 36.0::DOUBLE) AS brg FROM s),
r AS (SELECT *, d * (d + 2 * base) / (2 * (d + base * (1 - cos(radians(brg - to_tx))))) AS far FROM q),
o AS (SELECT node_id, i, rx_lat + far * cos(radians(brg)) / {PER_DEG} AS lat, rx_lon + far * sin(radians(brg)) / (cos(radians(rx_lat)) * {PER_DEG}) AS lon FROM r WHERE d >= 3 AND (max_excess IS NULL OR d <= max_excess) AND (max_excess IS NOT NULL OR far <= max_range))
SELECT node_id, count(*) AS points, round_even(avg(lat), 6) AS mean_lat, round_even(avg(lon), 6) AS mean_lon FROM o GROUP BY node_id HAVING count(*) >= 2""")
def ambiguity_arcs(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    n = su.sites(spark, sf).select("node_id", F.struct(*joins.SITE).alias("site"), ((c("node_id") * 37 % 300) + 5.0).alias("delay"))
    # equal sites draw equal arcs; a site's row doesn't tell how much work its arc is, so they are dealt to all cores
    kinds = n.select("site", "delay").distinct().repartition(spark.sparkContext.defaultParallelism * 4, "site", "delay")
    # exploded, so that no filter takes the arc with it below the dealing, where each node would draw it again
    kinds = kinds.select("site", "delay", F.explode(F.array(arcs.ambiguity_arc(c("delay"), *[c(f"site.{x}") for x in joins.SITE]))).alias("arc"))
    mean = lambda f: F.bround(F.aggregate("arc", F.lit(0.0), lambda s, p: s + p[f]) / F.size("arc"), 6)
    of = kinds.where("arc is not null").select("site", "delay", F.size("arc").cast("long").alias("points"), mean("lat").alias("mean_lat"), mean("lon").alias("mean_lon"))
    return n.join(of, ["site", "delay"]).select("node_id", "points", "mean_lat", "mean_lon")


@query(f"""WITH l AS (SELECT s_suppkey AS k, {su.lat_sql("s_suppkey")} AS lat, {su.lon_sql("s_suppkey")} AS lon, list_transform(range(1 + s_suppkey % 5), lambda i: {{'lat': 34.5 + ((s_suppkey * 31 + i * 17) % 100) / 100.0::DOUBLE, 'lon': -82.5 + ((s_suppkey * 13 + i * 29) % 100) / 100.0::DOUBLE}}) AS pts FROM supplier),
x AS (SELECT k, lat, lon, unnest(range(len(pts))) AS i, pts FROM l), a AS (SELECT k, lat, lon, i, (pts[i + 1].lon - lon) * cos(radians(lat)) AS ax, pts[i + 1].lat - lat AS ay, pts[i + 1].lat AS alat, pts[i + 1].lon AS alon, coalesce(pts[i + 2], pts[i + 1]) AS b FROM x),
s AS (SELECT *, (b.lon - lon) * cos(radians(lat)) - ax AS dx, b.lat - lat - ay AS dy FROM a), t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1, greatest(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM s),
d AS (SELECT k, lat, lon, i, alat + t * (b.lat - alat) AS qlat, alon + t * (b.lon - alon) AS qlon, pow(ax + t * dx, 2) + pow(ay + t * dy, 2) AS d2 FROM t)
SELECT k, round_even({su.km_sql("lat", "lon", "qlat", "qlon")}, 6) AS km FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY d2, i) = 1""")
def nearest_on_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.transform(F.sequence(F.lit(0), (k % 5).cast("int")), lambda i: F.struct((34.5 + ((k * 31 + i * 17) % 100) / 100.0).alias("lat"), (-82.5 + ((k * 13 + i * 29) % 100) / 100.0).alias("lon")))
    return su.table(spark, sf, "supplier").select(k.alias("k"), F.bround(arcs.nearest_on(su.lat(k), su.lon(k), line)["km"], 6).alias("km"))


@query("""WITH t AS (SELECT l_orderkey AS k, list(l_linenumber ORDER BY l_linenumber) AS p FROM lineitem GROUP BY 1), s AS (SELECT *, ceil(len(p) / 3.0)::INT AS stride, greatest(1, ceil(len(p) / 2.0))::INT AS step FROM t),
f AS (SELECT *, [x for x, i in p if (i - 1) % stride = 0] AS kept FROM s)
SELECT k, CAST(CASE WHEN len(p) <= 3 THEN p WHEN kept[-1] = p[-1] THEN kept ELSE list_append(kept, p[-1]) END AS VARCHAR) AS thin, CASE WHEN len(p) < 2 THEN 0 ELSE 1 + CASE WHEN len(p[step + 1:2 * step + 1]) >= 2 THEN 1 ELSE 0 END END AS pieces,
'ab' || '-' || k || '-' || CASE WHEN k % 3 > 0 THEN 'd' || floor((k % 1000) / 7.0::DOUBLE / 0.1::DOUBLE + 0.5)::BIGINT ELSE 't5' END AS key, CAST(list_transform(p, lambda x: round_even(x / 2.0::DOUBLE, 0)::BIGINT) AS VARCHAR) AS grains FROM f""")
def drawn_trails(spark: SparkSession, sf: str) -> DataFrame:
    p = su.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("p"))
    text = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))
    key = arcs.arc_key(F.lit("ab"), F.col("k").cast("string"), F.when(F.col("k") % 3 > 0, (F.col("k") % 1000) / 7.0), F.lit(5))
    return p.select("k", text(arcs.thinned(F.col("p"), 3)).alias("thin"), F.size(arcs.segments(F.col("p"), 2)).cast("long").alias("pieces"), key.alias("key"), text(arcs.digest_grains(F.col("p").cast("array<double>"))).alias("grains"))


@query(f"""WITH s AS (SELECT o_orderkey AS k, 'mn-' || o_orderkey AS key, {su.lat_sql("o_orderkey")} AS lat, {su.lon_sql("o_orderkey")} AS lon, o_totalprice / 100 AS alt, (o_orderkey % 400) - 200 AS ve, (o_custkey % 300) - 150 AS vn, 2 + o_orderkey % 4 AS n, (o_orderkey % 97) / 40.0::DOUBLE AS rd, o_orderkey % 61 AS age FROM orders),
g AS (SELECT *, sqrt(ve * ve + vn * vn) AS speed, least(age, 30) AS glide, CASE WHEN degrees(atan2(ve, vn)) < 0 THEN degrees(atan2(ve, vn)) + 360 ELSE degrees(atan2(ve, vn)) END AS brg FROM s)
SELECT 'mn' || substr(sha256(key), 1, 10) AS hex, 'MN' || n || 'N' AS flight, round_even(alt / 0.3048, 0)::BIGINT AS alt_baro, round_even(speed * 1.94384, 1) AS gs, round_even(brg, 1) AS track, round_even(round_even(lat, 5) + vn * glide / ({PER_DEG} * 1000), 5) AS lat, age::DOUBLE AS seen, -round_even(1 / greatest(rd, 0.01), 1) AS rssi, round_even(greatest(speed, 100), 1) AS max_velocity_ms FROM g""")
def solve_feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    now = F.lit(2000000.0)
    s = su.table(spark, sf, "orders").select(
        F.concat(F.lit("mn-"), k.cast("string")).alias("key"), su.lat(k).alias("lat"), su.lon(k).alias("lon"), (F.col("o_totalprice") / 100).alias("alt_m"), ((k % 400) - 200).cast("double").alias("vel_east"), ((F.col("o_custkey") % 300) - 150).cast("double").alias("vel_north"),
        (2 + k % 4).alias("n_nodes"), F.lit(9).alias("n_measurements"), ((k % 97) / 40.0).alias("rms_delay"), F.lit(1.0).alias("rms_doppler"), ((now - k % 61) * 1000).alias("timestamp_ms"), F.lit(100.0).alias("max_velocity_ms"),
    )
    return feed.solve_rows(s, now).select("hex", "flight", "alt_baro", "gs", "track", "lat", "seen", "rssi", "max_velocity_ms")


@query("""WITH u AS (SELECT c_custkey % 700 AS hex, c_custkey AS seq, 0 AS section, c_acctbal AS alt_baro FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey % 300, s_suppkey, 1, s_acctbal FROM supplier UNION ALL SELECT p_partkey % 900, p_partkey, 2, p_retailprice FROM part)
SELECT hex, section, alt_baro, false AS multinode, 1 AS n_nodes FROM u QUALIFY row_number() OVER (PARTITION BY hex ORDER BY section, seq) = 1""")
def combined_feed(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda t, key, value, n: su.table(spark, sf, t).select((F.col(key) % n).alias("hex"), F.col(key).alias("seq"), F.col(value).cast("double").alias("alt_baro"))
    whole = feed.union_first([part("customer", "c_custkey", "c_acctbal", 700).where("seq % 3 = 0"), part("supplier", "s_suppkey", "s_acctbal", 300), part("part", "p_partkey", "p_retailprice", 900)])
    return feed.public(whole).join(whole.select("hex", "section"), "hex").select("hex", "section", "alt_baro", "multinode", "n_nodes")


@query(f"""WITH {su.SITES}, s AS (SELECT o_orderkey AS key, {su.lat_sql("o_orderkey * 3")} AS lat, {su.lon_sql("o_orderkey * 5")} AS lon, 2 + o_orderkey % 3 AS n, (SELECT max(s_suppkey) FROM supplier) AS m FROM orders),
e AS (SELECT *, unnest(range(n)) AS i FROM s), j AS (SELECT e.*, n.* EXCLUDE (node_id), n.node_id FROM e JOIN n ON n.node_id = 1 + (key * 7 + i * 3) % m),
f AS (SELECT key, i, node_id, {su.km_sql("rx_lat", "rx_lon", "lat", "lon")} AS away, CASE WHEN max_excess IS NOT NULL THEN {su.km_sql("lat", "lon", "rx_lat", "rx_lon")} + {su.km_sql("lat", "lon", "tx_lat", "tx_lon")} - {BASE} END AS excess, max_excess, max_range, width, n,
  abs(({su.bearing_sql("rx_lat", "rx_lon", "lat", "lon")} - coalesce(azimuth, {ACROSS})) + 180 - 360 * floor((({su.bearing_sql("rx_lat", "rx_lon", "lat", "lon")} - coalesce(azimuth, {ACROSS})) + 180) / 360) - 180) AS off FROM j),
g AS (SELECT *, coalesce(excess > max_excess, away > max_range) AS far FROM f)
SELECT key, count(*) AS failures, first(node_id ORDER BY i) AS first_node, first(CASE WHEN far THEN 'range' ELSE 'bearing' END ORDER BY i) AS rule, first(round_even(away, 1) ORDER BY i) AS range_km FROM g WHERE far OR (n = 2 AND off > width / 2) GROUP BY key
UNION ALL SELECT key, 0, NULL, NULL, NULL FROM s WHERE key NOT IN (SELECT key FROM g WHERE far OR (n = 2 AND off > width / 2))""")
def solve_beam_failures(spark: SparkSession, sf: str) -> DataFrame:
    k, nodes = F.col("o_orderkey"), su.sites(spark, sf)
    most = su.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("m"))
    ids = F.transform(F.sequence(F.lit(0), (1 + k % 3).cast("int")), lambda i: 1 + (k * 7 + i * 3) % F.col("m"))
    solves = su.table(spark, sf, "orders").crossJoin(F.broadcast(most)).select(k.alias("key"), su.lat(k * 3).alias("lat"), su.lon(k * 5).alias("lon"), ids.alias("node_ids"))
    found = health.beam_failures(solves, nodes)
    one = F.get("failures", 0)
    return found.select("key", F.size("failures").cast("long").alias("failures"), one["node_id"].alias("first_node"), one["rule"].alias("rule"), one["range_km"].alias("range_km"))


_PART = "lpad(CAST(o_orderkey % {0} + 1 AS STRING), 2, '0')"
KEY = f"CASE WHEN o_orderkey % 2 = 0 THEN '2024/' || {_PART.format(12)} || '/' || {_PART.format(28)} || '/n' ELSE 'year=2024/month=' || {_PART.format(12)} || '/day=' || {_PART.format(28)} || '/node_id=n' END || CAST(o_custkey % 10 AS STRING) || '/part-' || CAST(o_orderkey AS STRING) || '.parquet'"


@query(f"""WITH f AS (SELECT {KEY} AS key, o_orderkey * 7919 % 1000000 AS made FROM orders), p AS (SELECT *, regexp_replace(string_split(key, '/')[2], '^[a-z_]+=', '') AS month, regexp_replace(string_split(key, '/')[4], '^[a-z_]+=', '') AS node_id FROM f)
SELECT key, node_id, CASE WHEN (1000000 - made) / 86400.0::DOUBLE > 1 AND made % 3 > 0 THEN CASE WHEN (1000000 - made) / 86400.0::DOUBLE > 3 THEN 'upload and delete' ELSE 'upload' END WHEN (1000000 - made) / 86400.0::DOUBLE > 3 THEN 'delete' ELSE 'keep' END AS action
FROM p WHERE month = '03' AND node_id = 'n4' ORDER BY made DESC, key DESC LIMIT 50 OFFSET 2""")
def archive_page(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderkey") * 7919 % 1000000
    files = archive.dated_keys(su.table(spark, sf, "orders").select(F.expr(KEY).alias("key"), at.alias("modified")))
    page = archive.listed(files, "2024/03", "n4", 50, 2)
    return archive.lifecycle(page, F.lit(1000000), F.col("modified") % 3 == 0).select("key", "node_id", "action")


LICENCE = "'|W' || p_partkey || '|' || CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE '9' || (p_partkey % 8) || '.5  MHz' END || '|FM|' || (p_partkey % 40) || '|||||' || CASE WHEN p_partkey % 7 = 0 THEN 'CP' ELSE 'LIC' END || '|NEW TOWN|SC|||' || (p_partkey % 50) || '.   kW||' || (p_partkey % 300) || '.0|||' || CASE WHEN p_partkey % 2 = 0 THEN 'N' ELSE 'S' END || '|' || (p_partkey % 80) || '|30|' || (p_partkey % 60) || '.5|W|082|15|00.00' || '||||||||||'"


@query(f"""WITH l AS (SELECT string_split({LICENCE}, '|') AS f FROM part), b AS (SELECT f, f[5]::INT AS ch, unnest(['tv', 'fm']) AS kind FROM l WHERE f[10] = 'LIC'),
m AS (SELECT *, CASE WHEN kind = 'fm' THEN try_cast(regexp_extract(f[3], '([0-9.]+) *MHz', 1) AS DOUBLE) WHEN ch BETWEEN 2 AND 4 THEN 57 + (ch - 2) * 6 WHEN ch BETWEEN 5 AND 6 THEN 79 + (ch - 5) * 6 WHEN ch BETWEEN 7 AND 13 THEN 177 + (ch - 7) * 6 WHEN ch BETWEEN 14 AND 36 THEN 473 + (ch - 14) * 6 END AS mhz, regexp_extract(f[15], '([0-9.]+) *kW', 1)::DOUBLE AS erp FROM b)
SELECT f[2] AS callsign, kind, mhz, round_even(CASE WHEN erp > 0 THEN 10 * log10(erp * 1000) + 32.15 END, 6) AS eirp_dbm, f[17]::DOUBLE AS height_m, 'New Town, SC' AS place, round_even(CASE WHEN f[20] = 'S' THEN -1 ELSE 1 END * (f[21]::DOUBLE + 0.5 + f[23]::DOUBLE / 3600), 9) AS lat FROM m WHERE mhz IS NOT NULL""")
def licensed_stations(spark: SparkSession, sf: str) -> DataFrame:
    lines = su.table(spark, sf, "part").select(F.expr(LICENCE).alias("value"))
    both = None
    for kind in ("tv", "fm"):
        part = archive.licence_lines(lines, kind).select("callsign", F.lit(kind).alias("kind"), "mhz", F.bround("eirp_dbm", 6).alias("eirp_dbm"), "height_m", "place", F.bround("lat", 9).alias("lat"))
        both = part if both is None else both.unionByName(part)
    return both
