"""Readers and writers for the file layouts that the inputs arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.functions.geo import point


def read_delimited(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", where: Column | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """CSV with a declared schema (ids stay strings), pruned and filtered."""
    df = spark.read.option("encoding", encoding).schema(schema).csv(path, header=True)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_header_json(spark: SparkSession, path: str, columns: dict[str, str], body_per_line: bool = False) -> DataFrame:
    """JSON bodies that are arrays of arrays with the names in the first one.

    A file is one request body (one area) unless bodies stand on lines of their
    own.  ``columns`` maps wanted names to types; order in the file is free.
    """
    body = spark.read.text(path, wholetext=not body_per_line).select(F.from_json("value", "array<array<string>>").alias("b"))
    rows = body.select(F.element_at("b", 1).alias("head"), F.posexplode("b").alias("at", "row")).filter(F.col("at") > 0)
    return rows.select(*[F.element_at("row", F.array_position("head", F.lit(name)).cast("int")).cast(kind).alias(name)
                         for name, kind in columns.items()])


# Name pattern of the job files and the columns it yields.
JOB_FILE = r"([a-z]{2})_(od|wac|rac)_([A-Za-z0-9]+)_(JT\d\d)_(\d{4})\.csv"
JOB_FILE_PARTS = ("state", "od", "segpart", "jobtype", "year")


def read_job_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All job files below a folder as one table; the name parts become columns."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(path, header=True)
    name = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(name, JOB_FILE, i + 1).alias(p) for i, p in enumerate(JOB_FILE_PARTS)])


# Geographic ids and count stems of the job file families.
JOB_FAMILIES = {"od": (["w_geocode", "h_geocode"], "S"), "wac": (["w_geocode"], "C"), "rac": (["h_geocode"], "C")}


def read_job_families(spark: SparkSession, path: str, counts: dict[str, list[str]]) -> DataFrame:
    """All job files below a folder, of every family, in one scan.

    The family in a file's name says which columns its lines have: its ids, then
    ``counts[family]`` in this order.  These counts are the columns ``n0``, ``n1``
    and so on, so families share one schema; missing ids are null.  Header lines
    are left out wherever they stand.  Names are taken apart once per file;
    parsing lines is costly, so store what is read more than once.
    """
    folder = spark.read.option("recursiveFileLookup", "true")
    path_of = F.col("_metadata.file_path")
    files = folder.format("binaryFile").load(path).select(
        path_of.alias("_path"), *[F.regexp_extract(path_of, JOB_FILE, i + 1).alias(p) for i, p in enumerate(JOB_FILE_PARTS)])
    lines = folder.text(path).filter(F.col("value").rlike("^[0-9]")).select(path_of.alias("_path"), F.split("value", ",").alias("_c"))
    rows = lines.join(F.broadcast(files), "_path")  # a row for each file

    def by_family(make) -> Column:
        out = F.lit(None)
        for family, (ids, _) in JOB_FAMILIES.items():
            out = F.when(F.col("od") == family, make(family, ids)).otherwise(out)
        return out

    at = lambda i: F.get("_c", F.lit(i))
    ids = {g: by_family(lambda family, own: at(own.index(g)) if g in own else F.lit(None).cast("string")).alias(g) for g in ("w_geocode", "h_geocode")}
    numbers = [by_family(lambda family, own: at(len(own) + i) if i < len(counts[family]) else F.lit(None).cast("string")).cast("long").alias(f"n{i}")
               for i in range(max(map(len, counts.values())))]
    return rows.select(*JOB_FILE_PARTS, *ids.values(), *numbers)


def read_features(spark: SparkSession, path: str, properties: str, collection_per_line: bool = False) -> DataFrame:
    """GeoJSON point features as rows with a point."""
    schema = f"features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<{properties}>>>"
    features = spark.read.schema(schema).json(path, multiLine=not collection_per_line).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return features.select("f.properties.*", point(at[0], at[1]).alias("geometry"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def materialize(spark: SparkSession, build, path: str) -> DataFrame:
    """Read the saved result when it is complete, else compute and save it."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_areas(df: DataFrame, path: str, area: str, fmt: str = "parquet") -> None:
    """One write, one folder per area."""
    df.write.partitionBy(area).option("header", "true").format(fmt).mode("overwrite").save(path)


def load_listed(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Append the files of a short list, each with its own column mapping and
    constants (``path``, ``columns``, ``constants``)."""
    out = None
    for entry in files:
        one = spark.read.parquet(entry["path"]).select(
            *[F.col(src).cast("string").alias(dst) for src, dst in entry["columns"].items()],
            *[F.lit(v).alias(k) for k, v in entry["constants"].items()])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
