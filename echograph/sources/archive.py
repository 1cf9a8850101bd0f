"""Sources and sinks: the detection and track archives, frame files and licence lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.operators.frames import flatten

# The archive's columns in their order.
ADSB = "hex string, lat double, lon double, alt_baro string, gs double, track double, flight string, squawk string, category string"
FRAME = f"timestamp long, delay array<double>, doppler array<double>, snr array<double>, adsb array<struct<{ADSB.replace(' ', ':').replace(',:', ',')}>>, signing_mode string, signature_valid boolean, payload_hash string, signature string, rx_lat double, rx_lon double, rx_alt_ft double, tx_lat double, tx_lon double, tx_alt_ft double, fc_hz double, fs_hz double, FC double, Fs double"
DETECTIONS = (
    "frame_ts_ms long, ingest_ts_ms long, node_id string, detection_index int, delay_us double, doppler_hz double, snr_db double, adsb_hex string, adsb_lat double, adsb_lon double, "
    "adsb_alt_baro int, adsb_gs double, adsb_track double, adsb_flight string, adsb_squawk string, adsb_category string, signing_mode string, signature_valid boolean, payload_hash string, "
    "signature string, rx_lat double, rx_lon double, rx_alt_ft double, tx_lat double, tx_lon double, tx_alt_ft double, fc_hz double, fs_hz double"
)
TRACKS = "solve_ts_ms long, frame_ts_ms long, lat double, lon double, alt_m double, vel_east_ms double, vel_north_ms double, vel_up_ms double, n_nodes int, contributing_node_ids string, adsb_hex string, rms_delay_us double, rms_doppler_hz double, target_class string"
SITE = ("rx_lat", "rx_lon", "rx_alt_ft", "tx_lat", "tx_lon", "tx_alt_ft", "fc_hz", "fs_hz")


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (x.split(" ") for x in schema.split(", "))])


def detections(frames: DataFrame, nodes: DataFrame | None = None, ingest_ms: Column | None = None) -> DataFrame:
    """Archive rows of frames (node_id and the FRAME columns): a frame's own site settings before those of its node's row."""
    keys = ["node_id", "timestamp", "signing_mode", "signature_valid", "payload_hash", "signature", "_ingest", *SITE]
    rows = frames.withColumn("_ingest", F.lit(None) if ingest_ms is None else ingest_ms).withColumns({"fc_hz": F.coalesce("fc_hz", "FC"), "fs_hz": F.coalesce("fs_hz", "Fs")})
    rows = flatten(rows, keys, ["adsb"])
    if nodes is not None:
        site = nodes.select("node_id", *[F.col(c).alias(f"_{c}") for c in SITE if c in nodes.columns])
        rows = rows.join(site, "node_id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in SITE if c in nodes.columns})
    a = F.col("adsb")
    out = rows.select(
        F.col("timestamp").alias("frame_ts_ms"), F.col("_ingest").alias("ingest_ts_ms"), "node_id", "detection_index",
        F.col("delay").alias("delay_us"), F.col("doppler").alias("doppler_hz"), F.col("snr").alias("snr_db"), *[a[c].alias(f"adsb_{c}") for c in ("hex", "lat", "lon")],
        a["alt_baro"].try_cast("double").cast("int").alias("adsb_alt_baro"), *[a[c].alias(f"adsb_{c}") for c in ("gs", "track", "flight", "squawk", "category")],
        "signing_mode", "signature_valid", "payload_hash", "signature", *SITE,
    )
    return _typed(out, DETECTIONS)


def _dated(df: DataFrame, at_ms: str) -> DataFrame:
    """Adds year, month and day as text: those of UTC, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.col(at_ms) / 86_400_000).cast("int"))
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return df.withColumns({"year": part(F.year(day), 4), "month": part(F.month(day), 2), "day": part(F.day(day), 2)})


def utc_millis(text: Column) -> Column:
    """Milliseconds of ISO text; text without a zone is UTC, whatever the session's; null for other text."""
    whole = F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\d\s*$"), F.concat(F.trim(text), F.lit("T00:00:00"))).otherwise(F.trim(text))
    zoned = whole.rlike(r"(?i)(z|utc|gmt|[+-]\d\d(:?\d\d)?)$") & whole.rlike(r"\d\d:\d\d")
    return F.unix_millis(F.when(zoned, whole).otherwise(F.concat(whole, F.lit("Z"))).try_cast("timestamp"))


def write_detections(df: DataFrame, path: str) -> None:
    """Partitioned by day and node. Rows of a day and node are gathered before writing, a busy pair spread by AQE."""
    rows = _dated(df, "frame_ts_ms").withColumn("_node", F.col("node_id"))
    rows.hint("rebalance", "year", "month", "day", "_node").withColumnRenamed("node_id", "_id").withColumnRenamed("_node", "node_id").drop("_id").write.mode("append").partitionBy("year", "month", "day", "node_id").option("compression", "zstd").parquet(path)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """The archive with its columns; node ids stay text, as 007 does."""
    types = DETECTIONS + ", year string, month string, day string"
    return spark.read.schema(types).parquet(path)


def write_tracks(df: DataFrame, path: str) -> None:
    _dated(_typed(df, TRACKS), "solve_ts_ms").hint("rebalance", "year", "month", "day").write.mode("append").partitionBy("year", "month", "day").option("compression", "zstd").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of .detection files: JSON objects joined by commas, one whole file a row, in the order of their names."""
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*.detection").text(path).withColumn("file", F.input_file_name())
    body = F.concat(F.lit("["), F.regexp_replace(F.trim("value"), ",\\s*$", ""), F.lit("]"))
    return text.select("file", F.posexplode(F.from_json(body, f"array<struct<{FRAME.replace('array<struct<', 'ARRAY<STRUCT<')}>>")).alias("position", "f")).select("file", "position", "f.*")


def frame_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON-lines frames of a landing folder; lines that aren't JSON or have no timestamp go."""
    return spark.readStream.schema(f"node_id string, {FRAME}").option("mode", "DROPMALFORMED").json(path).where("timestamp is not null")


def _degrees(c: list[Column], side: Column) -> Column:
    d, m, s = (x.try_cast("double") for x in c)
    return F.when(side.isin("S", "W"), -1).otherwise(1) * (d + m / 60 + s / 3600)


def tv_mhz(channel: Column) -> Column:
    """The middle of a television channel: 6 MHz each, in three bands with a gap after channel 4; null for others."""
    start = F.when(channel.between(2, 4), 54 + (channel - 2) * 6).when(channel.between(5, 6), 76 + (channel - 5) * 6).when(channel.between(7, 13), 174 + (channel - 7) * 6).when(channel.between(14, 36), 470 + (channel - 14) * 6)
    return (start + 3).cast("double")


def licence_lines(text: DataFrame, service: str, column: str = "value") -> DataFrame:
    """Licensed stations of pipe-delimited lines of 35 fields and more: callsign, frequency, strength, height and place; other lines go.

    service is 'tv', whose lines have the channel in the fifth field, or 'fm', whose lines have the frequency with its unit in the third. The power in kW
    counts for a dipole, 2.15 dB under an isotropic antenna's; places are degrees, minutes and seconds. Lines whose channel, frequency or place can't be read go.
    """
    if service not in ("tv", "fm"):
        raise ValueError(f"service is tv or fm, not {service}")
    f = F.transform(F.split(F.col(column), "\\|"), lambda x: F.trim(x))
    g = lambda k: F.get(F.col("_f"), k)
    rows = text.withColumn("_f", f).where(F.size("_f") >= 35).where(g(9) == "LIC")
    unit = lambda c, name: F.regexp_extract(c, rf"([0-9.]+)\s*{name}", 1).try_cast("double")
    mhz = tv_mhz(g(4).try_cast("int")) if service == "tv" else unit(g(2), "MHz")
    erp = unit(g(14), "kW")
    return rows.select(
        g(1).alias("callsign"), mhz.alias("mhz"), g(3).alias("service"), erp.alias("erp_kw"), F.when(erp > 0, 10 * F.log10(erp * 1000) + 30 + 2.15).alias("eirp_dbm"), g(16).try_cast("double").alias("height_m"),
        F.concat(F.initcap(g(10)), F.lit(", "), g(11)).alias("place"), _degrees([g(20), g(21), g(22)], g(19)).alias("lat"), _degrees([g(24), g(25), g(26)], g(23)).alias("lon"),
    ).where("mhz is not null and lat is not null and lon is not null")


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Frames of legacy archive files: JSON objects of node_id, timestamp (ISO text) and detections (frames), a file each.

    The node is the file's, else the first that one of its frames names, else 'unknown'; ingest_ms is the file's time, else its first frame's with one, else 0.
    """
    frame = "array<struct<" + ", ".join(x.replace(" ", ": ", 1) for x in ["node_id string", "_node_id string", *_split(FRAME)]) + ">>"
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).withColumn("file", F.input_file_name())
    v = text.select("file", F.from_json("value", f"node_id string, timestamp string, detections {frame}").alias("v")).select("file", "v.*")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.get(F.array_compact(F.transform("detections", lambda d: F.coalesce(filled(d["_node_id"]), filled(d["node_id"])))), 0)
    first = F.get(F.filter(F.transform("detections", lambda d: d["timestamp"]), lambda t: t > 0), 0)
    at = F.coalesce(utc_millis(F.col("timestamp")), first, F.lit(0))
    rows = v.select("file", F.coalesce(filled(F.col("node_id")), named, F.lit("unknown")).alias("_n"), at.alias("ingest_ms"), F.posexplode_outer("detections").alias("position", "f"))
    return rows.where("f is not null").select("file", F.col("_n").alias("node_id"), "ingest_ms", "position", *[F.col("f." + x.split(" ")[0]) for x in _split(FRAME)])


def _split(schema: str) -> list[str]:
    """The fields of a schema text, those of nested types kept whole."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def backfill(spark: SparkSession, source: str, target: str, nodes: DataFrame | None = None) -> None:
    """Writes the detections of legacy files into the archive, by the day of their own frames.

    Days and nodes that the archive has already are passed over, so a rerun adds nothing and goes on with those that are missing; a day and node is written whole
    or, if the job fails, not at all, as Spark's commit makes its files seen together.
    """
    frames = read_legacy(spark, source)
    rows = _dated(detections(frames.drop("file", "position"), nodes, F.col("ingest_ms")), "frame_ts_ms")
    there = partitions(spark, target)
    if there is not None:
        rows = rows.join(there, ["year", "month", "day", "node_id"], "left_anti")
    write_detections(rows.drop("year", "month", "day"), target)


def partitions(spark: SparkSession, path: str) -> DataFrame | None:
    """The days and nodes that an archive has rows of; None where there is no archive yet. Files' footers are read, no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return read_detections(spark, path).select("year", "month", "day", "node_id").distinct()


def write_batches(frames: DataFrame, path: str, checkpoint: str, nodes: DataFrame | None = None):
    """Starts a stream's archive (a DataStreamWriter, to be started): each batch is written once, however often it is tried again.

    A batch goes to the folder batch=<its number> as a whole, in place of what an earlier try left there; the number comes from the checkpoint, so a retry after
    a failure has the same rows under the same number. ``read_batches`` reads all of them.
    """

    def put(rows: DataFrame, batch: int) -> None:
        dated = _dated(detections(rows, nodes), "frame_ts_ms").hint("rebalance", "year", "month", "day", "node_id")
        dated.write.mode("overwrite").partitionBy("year", "month", "day", "node_id").option("compression", "zstd").parquet(f"{path}/batch={batch}")

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_batches`` wrote, with the number of each row's batch."""
    return spark.read.schema(DETECTIONS + ", batch long, year string, month string, day string").parquet(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The archive's files (their contents unread): key below ``path``, size_bytes, modified, and year, month, day and node_id of either layout."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return dated_keys(found.where(F.col("path").rlike("[.](parquet|json)$")).withColumn("key", F.regexp_replace("path", ".*/(?=(?:year=)?[0-9]{4}/)", "")).drop("path"))


def dated_keys(files: DataFrame) -> DataFrame:
    """Adds year, month, day and node_id out of key, with and without their names in it."""
    parts = F.split("key", "/")
    value = lambda k: F.regexp_replace(F.get(parts, k), "^[a-z_]+=", "")
    return files.withColumns({"year": value(0), "month": value(1), "day": value(2), "node_id": value(F.size(parts) - 2)})


def listed(files: DataFrame, date_prefix: str | None = None, node_id: str | None = None, limit: int = 100, offset: int = 0, newest_first: bool = True) -> DataFrame:
    """A page of the archive's files (500 at most) of a year, a month or a day ('2025/06/21' and shorter) and of a node, by their time."""
    for name, part in zip(("year", "month", "day"), (date_prefix or "").split("/")):
        files = files.where(F.col(name) == part) if part else files
    files = files.where(F.col("node_id") == node_id) if node_id else files
    order = [F.desc("modified"), F.desc("key")] if newest_first else [F.asc("modified"), F.asc("key")]
    return files.orderBy(*order).offset(offset).limit(min(limit, 500))


#: Days after which an archived file is copied elsewhere, and after which the copied file is deleted here (0: never).
OFFLOAD_DAYS, RETAIN_DAYS = 1, 3


def lifecycle(files: DataFrame, now: Column, uploaded: Column, offload_days: int = OFFLOAD_DAYS, retain_days: int = RETAIN_DAYS) -> DataFrame:
    """Adds what is to be done with each file: 'upload', 'delete', 'upload and delete' (old enough for both) or 'keep'. Nothing goes that wasn't copied."""
    age = (now.cast("double") - F.col("modified").cast("double")) / 86400
    send = (age > offload_days) & ~uploaded
    gone = (age > retain_days) & (uploaded | send) if retain_days > 0 else F.lit(False)
    return files.withColumn("action", F.when(send & gone, "upload and delete").when(send, "upload").when(gone, "delete").otherwise("keep"))
