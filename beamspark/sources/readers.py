"""Scans: event tables, catalogues, layered models, manifests, registries, waveforms and archives."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamspark.functions import steim

EVENT_TABLE = (
    "index int, event_id string, quality string, origin_time timestamp, distance_deg double, distance_err double, "
    "baz_deg double, set string"
)
_ORIGIN = (
    "array<struct<_publicID:string,time:struct<value:string>,"
    "arrival:array<struct<pickID:string,phase:string>>>>"
)
_PICK = (
    "array<struct<_publicID:string,phaseHint:string,time:struct<value:string>,"
    "waveformID:struct<_networkCode:string,_stationCode:string,_locationCode:string,_channelCode:string>>>"
)
QUAKEML_EVENT = (
    f"_publicID string, description array<struct<text:string>>, preferredOriginID string, origin {_ORIGIN}, pick {_PICK}"
)


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with a fixed schema; empty numbers are null."""
    return spark.read.csv(path, header=True, schema=EVENT_TABLE, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X")


def _catalogue_columns(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Catalogue rows of parsed events; absent lists become empty ones."""
    ts = lambda c: c.try_cast("timestamp")
    origins = F.transform(F.coalesce("e.origin", F.array().cast(_ORIGIN)), lambda o: F.struct(
        o["_publicID"].alias("resource_id"), ts(o["time"]["value"]).alias("time"),
        F.transform(F.coalesce(o["arrival"], F.array().cast("array<struct<pickID:string,phase:string>>")),
                    lambda a: F.struct(a["pickID"].alias("pick_id"), a["phase"].alias("phase"))).alias("arrivals")))
    picks = F.transform(F.coalesce("e.pick", F.array().cast(_PICK)), lambda p: F.struct(
        p["_publicID"].alias("resource_id"), p["phaseHint"].alias("phase_hint"), ts(p["time"]["value"]).alias("time"),
        F.struct(*[p["waveformID"][f"_{k}Code"].alias(f"{k}_code")
                   for k in ("network", "station", "location", "channel")]).alias("waveform_id")))
    texts = F.transform(F.coalesce("e.description", F.array().cast("array<struct<text:string>>")), lambda d: d["text"])
    return df.select(
        *keep, F.col("e._publicID").alias("resource_id"), texts.alias("descriptions"),
        F.col("e.preferredOriginID").alias("preferred_origin_id"), origins.alias("origins"), picks.alias("picks"))


def quakeml(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``event`` element; the XML source splits large files by element."""
    raw = spark.read.format("xml").options(rowTag="event", ignoreNamespace="true").schema(QUAKEML_EVENT).load(path)
    return _catalogue_columns(raw.select(F.struct(*raw.columns).alias("e")), [])


def parse_quakeml(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Same catalogue columns from event elements held as text."""
    parsed = df.withColumn("e", F.from_xml(F.col(column), QUAKEML_EVENT, {"ignoreNamespace": "true"}))
    return _catalogue_columns(parsed, keep)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, value): whole small text files as ordered lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))


def layered_models(spark: SparkSession, path: str) -> DataFrame:
    from beamspark.operators.model import sections

    return sections(text_lines(spark, path), "file", "ord", "value")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON manifest in order; a missing item list is an empty one."""
    schema = "created_at string, items array<map<string,string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    flat = raw.select("created_at", F.posexplode(F.coalesce("items", F.array().cast("array<map<string,string>>"))).alias("ord", "item"))
    return flat.select("created_at", "ord", *[F.col("item")[k].alias(k) for k in ("type", "path", "sha256")], "item")


def registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows as string maps from ``{"rows": [...]}`` or a bare list."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", "array<map<string,string>>")
    kept = F.from_json("value", "rows array<map<string,string>>")["rows"]
    is_list = F.ltrim("value").startswith("[")
    return whole.select(F.explode(F.when(is_list, bare).otherwise(kept)).alias("row"))


def geojson_events(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON catalogue: id, time in milliseconds, magnitude and coordinates."""
    schema = ("features array<struct<id:string,properties:struct<mag:double,time:bigint,place:string>,"
              "geometry:struct<coordinates:array<double>>>>")
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    xyz = F.col("f.geometry.coordinates")
    return f.select("f.id", F.col("f.properties.mag").alias("mag"), F.col("f.properties.time").alias("time_ms"),
                    xyz[0].alias("lon"), xyz[1].alias("lat"), xyz[2].alias("depth_km"))


def stats_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Several CSV result files of one ``schema`` as one table, the null type read from each file's folder."""
    raw = spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv")
    kind = F.regexp_extract(F.col("_metadata.file_path"), r"/nulls/([^/]+)/", 1)
    return raw.withColumn("null_type", F.when(kind == "", "real").otherwise(kind))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Recursive file list with sizes and digests."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(path).select(
        "path", "content")


def _decode(df: DataFrame, schema: str, rows_of) -> DataFrame:
    """Decode each file in the task that reads it."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                for row in rows_of(path, content.as_py()):
                    yield pa.RecordBatch.from_pylist([row], schema=out)

    return df.mapInArrow(run, schema)


def npz_arrays(spark: SparkSession, path: str, exclude_suffix: str = "_sub") -> DataFrame:
    """(path, name, shape, values) of every numeric array in NPZ and NPY files."""
    files = _binary(spark, path, "*.np[yz]").where(~F.col("path").rlike(exclude_suffix + r"\.npz$"))

    def rows(p, data):
        loaded = np.load(io.BytesIO(data), allow_pickle=False)
        members = {"": loaded} if isinstance(loaded, np.ndarray) else loaded
        for name in members:
            a = np.asarray(members[name])
            if a.dtype.kind in "fiub":
                yield {"path": p, "name": name, "shape": list(a.shape), "values": a.ravel().astype(float).tolist()}

    return _decode(files, "path string, name string, shape array<int>, values array<double>", rows)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of ZIP archives."""

    def rows(p, data):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield {"path": p, "member": info.filename, "content": z.read(info)}

    return _decode(_binary(spark, path, "*.zip"), "path string, member string, content binary", rows)


# MiniSEED fixed values: encodings of uncompressed samples.
_ENCODINGS = {1: ">i2", 3: ">i4", 4: ">f4", 5: ">f8"}


def miniseed_records(spark: SparkSession, path: str, samples: bool = True) -> DataFrame:
    """Records of MiniSEED 2 files, uncompressed or difference-compressed: channel, start, rate and samples.

    A record in any other encoding fails the read; without ``samples`` only headers are read, of any encoding.
    """

    def rows(p, data):
        at = 0
        while at + 48 <= len(data):
            h = data[at : at + 48]
            year, day, hour, minute, sec, frac = struct.unpack(">HHBBBxH", h[20:30])
            npts, factor, mult = struct.unpack(">Hhh", h[30:36])
            begin, blk = struct.unpack(">HH", h[44:48])
            encoding, length = None, 512
            while blk:
                kind, nxt = struct.unpack(">HH", data[at + blk : at + blk + 4])
                if kind == 1000:
                    encoding, length = data[at + blk + 4], 1 << data[at + blk + 6]
                blk = nxt
            rate = (factor if factor > 0 else -1.0 / factor) * (mult if mult > 0 else -1.0 / mult) if factor and mult else 0.0
            micros = ((day - 1) * 86400 + hour * 3600 + minute * 60 + sec) * 1_000_000 + frac * 100
            start = np.datetime64(f"{year:04d}-01-01", "us").astype(np.int64) + micros
            x = []
            if samples and encoding in (steim.STEIM1, steim.STEIM2):
                x = steim.decode(data[at + begin : at + length], npts, encoding).astype(float).tolist()
            elif samples and npts and encoding not in _ENCODINGS:
                raise ValueError(f"{p}: encoding {encoding} at byte {at} is not supported; read with samples=False for headers")
            if samples and encoding in _ENCODINGS:
                x = np.frombuffer(data, _ENCODINGS[encoding], npts, at + begin).astype(float).tolist()
            yield {"path": p, "network": h[18:20].decode().strip(), "station": h[8:13].decode().strip(),
                   "location": h[13:15].decode().strip(), "channel": h[15:18].decode().strip(),
                   "start_us": int(start), "sampling_rate": float(rate), "npts": npts, "encoding": encoding, "x": x}
            at += length

    return _decode(
        _binary(spark, path, "*.mseed"),
        "path string, network string, station string, location string, channel string, start_us bigint, "
        "sampling_rate double, npts int, encoding int, x array<double>", rows)


def lane_tables(spark: SparkSession, path: str) -> DataFrame:
    """Grids written by lane: partition folders come back as lane columns and prune on read."""
    return spark.read.parquet(path)
