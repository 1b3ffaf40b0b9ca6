"""Landed files in, snapshots out.  Schemas are given, never inferred."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyloom.sources.shared import folder, open_store


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def land_texts(files: DataFrame, into: str) -> int:
    """Writes each row of (name, value) as a file of that name; a second attempt writes the same again.  Returns how many."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(into)
        store.create_dir(base, recursive=True)
        for batch in rows:
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(value.encode())
            yield batch.select(["name"])

    return files.select("name", "value").mapInArrow(write, "name string").count()


def scan_grouped_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One JSON-array file per group; the group is the file's stem."""
    df = spark.read.schema(schema).option("multiLine", True).json(paths)
    return df.withColumn("group", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def scan_ledger_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; the empty string means no value."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


POINT = "features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:double,bv:string>>>"
LINES = "features array<struct<id:string,geometry:struct<type:string,coordinates:string>>>"


def scan_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection of points: id, lon, lat, mag, bv."""
    f = spark.read.schema(POINT).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select("f.id", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.mag", "f.properties.bv")


def scan_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """A FeatureCollection of (multi-)lines, one row per vertex: id, seg, pos, lon, lat.  A line is one segment.

    Files are read as texts and parsed then: the JSON source goes back to the file for every value that it takes as it
    stands, here the coordinates of each feature.
    """
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", LINES).alias("c"))
    f = whole.select(F.explode("c.features").alias("f"))
    one = F.from_json("f.geometry.coordinates", "array<array<double>>")
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    segs = F.when(F.col("f.geometry.type") == "LineString", F.array(one)).otherwise(many)
    return (
        f.select(F.col("f.id").alias("id"), F.posexplode(segs).alias("seg", "points"))
        .select("id", "seg", F.posexplode("points").alias("pos", "p"))
        .select("id", "seg", "pos", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    )


def scan_optional(spark: SparkSession, path: str, schema: str, fmt: str = "json", **options: object) -> DataFrame:
    """The files at the path, or an empty table of the same schema where there are none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def scan_landed_extract(spark: SparkSession, path: str, schema: str, cap: int | None = None) -> DataFrame:
    """The CSV that a remote catalogue query has left; ``cap`` is that query's own row limit."""
    df = scan_ledger_csv(spark, path, schema)
    return df if cap is None else df.limit(cap)


def stamp_snapshot(df: DataFrame, ts: Column) -> DataFrame:
    """Adds the generation's UTC stamp, to the minute.  The instant is an argument, so reruns agree."""
    return df.withColumn("stamp", F.date_format(ts, "yyyy-MM-dd HH:mm'Z'"))


CURRENT = "CURRENT"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place and renamed over it."""
    fs, where = folder(spark, path)
    beside = where.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, files = spark._jvm, spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(where), over)


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    return spark.read.text(path, wholetext=True).first()[0] if path_exists(spark, path) else None


def write_snapshot(tables: dict[str, DataFrame], path: str, stamp: str, fmt: str = "parquet", least: int | dict[str, int] = 0) -> dict[str, int]:
    """Several named tables as one generation, seen by readers as a whole or not at all.  Returns their rows.

    All tables are staged in a folder of the generation's own, each by one job that counts its rows as it writes them.  A
    manifest names them; then one small file, CURRENT, is replaced and points to it.  A run that fails or is killed before
    that, or a table of fewer rows than ``least`` (in all, or by name), leaves the generation before in place.
    """
    spark = next(iter(tables.values())).sparkSession
    base = path.rstrip("/")
    name_of_run = f"{stamp}-{uuid.uuid4().hex[:12]}"
    staged = f"{base}/generations/{name_of_run}"
    rows = {}
    try:
        for name, df in tables.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).save(f"{staged}/{name}")
            rows[name] = seen.get["rows"]
            needed = least if isinstance(least, int) else least.get(name, 0)
            if rows[name] < needed:
                raise ValueError(f"{name} has {rows[name]} rows; {needed} are needed")
    except Exception:
        fs, where = folder(spark, staged)
        fs.delete(where, True)
        raise
    schemas = {name: df.schema.json() for name, df in tables.items()}
    put_text(spark, f"{staged}/manifest.json", json.dumps({"stamp": stamp, "format": fmt, "rows": rows, "schemas": schemas}))
    put_text(spark, f"{base}/{CURRENT}", name_of_run)
    return rows


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the generation that CURRENT names now; the files of a generation never change."""
    base = path.rstrip("/")
    run = get_text(spark, f"{base}/{CURRENT}")
    if run is None:
        raise ValueError(f"nothing is published at {path}")
    told = json.loads(get_text(spark, f"{base}/generations/{run}/manifest.json"))
    return spark.read.format(told["format"]).schema(StructType.fromJson(json.loads(told["schemas"][name]))).load(f"{base}/generations/{run}/{name}")


def to_positional(df: DataFrame, cols: list[str], out: str = "record") -> DataFrame:
    """The columns as one JSON array by position, nulls kept."""
    return df.withColumn(out, F.to_json(F.array(*(F.col(c).cast("string") for c in cols))))


def from_positional(df: DataFrame, record: str, fields: dict[str, str]) -> DataFrame:
    """A JSON array by position back to columns of the given types."""
    cells = F.from_json(record, "array<string>")
    return df.withColumns({n: F.get(cells, F.lit(i)).try_cast(t) for i, (n, t) in enumerate(fields.items())})
