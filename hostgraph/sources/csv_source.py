"""Multi-file CSV capture scan.

A capture is a flat folder of CSV files; each file's name says which part of the week it
holds; further parts of a capture file are named ``<name>~part<n>.csv``.  Files are read with an
explicit schema (no inference pass), latin1 decoding and normalised header names.  Columns go by header, not by position: the header line of every
file is read first, files with the same header are one scan, and the scans are united by
name.  The file a row came from is taken from the hidden ``_metadata`` column.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_HEADER = {            # how the capture writes its header (stray blanks included)
    "row_id": " Row ID",
    "src": " Source IP",
    "dst": " Destination IP",
    "ts": " Timestamp",
    "bytes": "Total Bytes ",
    "label": " Label",
    "dst_port": " Destination Port",
    "capture_pos": "Capture Pos",
}


TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def normalise_header(name: str) -> str:
    """Strip stray blanks, then snake_case (``' Source IP'`` -> ``source_ip``)."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower()


# normalised header -> canonical flow column
CANONICAL = {normalise_header(v): k for k, v in RAW_HEADER.items()}


def write_capture(raw: DataFrame, path: str, file_col: str = "source_file") -> None:
    """Write a raw flow table as a flat folder of CSV files named by capture file (latin1, messy header).
    Every task writes its own part of each capture file it holds, so no row moves and a file that
    holds most rows is written by many tasks.  Spark names files itself, so each is moved to its
    capture's name, or that of a further part, on the store that holds it."""
    spark = raw.sparkSession
    out = raw.select(*[F.col(c).alias(RAW_HEADER.get(c, c)) for c in raw.columns])
    parts = f"{path}/_parts"
    (out.write.mode("overwrite").partitionBy(file_col)
        .option("header", True).option("encoding", "ISO-8859-1")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("timestampNTZFormat", TIME_FORMAT).csv(parts))
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(hadoop.Path(f"{parts}/{file_col}=*")):        # one per capture file
        name = spark._jvm.java.net.URLDecoder.decode(folder.getPath().getName().split("=", 1)[1], "UTF-8")
        for k, f in enumerate(fs.globStatus(hadoop.Path(f"{folder.getPath().toString()}/part-*"))):
            fs.rename(f.getPath(), hadoop.Path(root, part_name(name, k)))
    fs.delete(hadoop.Path(parts), True)


def part_name(name: str, part: int) -> str:
    """File name of a capture file's part; the first has the capture's own name."""
    return name if not part else f"{name.removesuffix('.csv')}~part{part}.csv"


def capture_schema(raw: DataFrame, file_col: str = "source_file") -> StructType:
    """The CSV schema as written: raw header names, the raw frame's types."""
    fields = []
    for f in raw.schema.fields:
        if f.name == file_col:
            continue
        fields.append(f.__class__(RAW_HEADER.get(f.name, f.name), f.dataType, True))
    return StructType(fields)


def _headers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of every CSV file of the folder, or of the parts of the one file named.  No Spark
    job: the store is asked for the first line of each file; files without a line are left out."""
    hadoop, java = spark._jvm.org.apache.hadoop.fs, spark._jvm.java.io
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    globs = ([path, part_name(path, "*")] if path.endswith(".csv") else [f"{path.rstrip('/')}/*.csv"])
    out = []
    for found in (fs.globStatus(hadoop.Path(g)) for g in globs):
        for f in found or []:
            reader = java.BufferedReader(java.InputStreamReader(fs.open(f.getPath()), "ISO-8859-1"))
            line = reader.readLine()
            reader.close()
            if line is not None:
                out.append((f.getPath().toString(), line))
    return out


def scan_capture(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All CSV files of the flat folder ``path`` (or the parts of the one file it names): columns matched by header whatever their
    order and renamed to snake_case, NULL where a file lacks one; ``source_file`` is the file's
    name.  A header that ``schema`` doesn't know raises."""
    kinds = {normalise_header(f.name): f for f in schema.fields}
    layouts: dict[tuple, list[str]] = {}
    for file, header in _headers(spark, path):
        names = tuple(normalise_header(c) for c in header.rstrip("\r").split(","))
        if unknown := [c for c in names if c not in kinds]:
            raise ValueError(f"{file}: unknown columns {unknown}")
        layouts.setdefault(names, []).append(file)
    frames = []
    for names, files in sorted(layouts.items()):
        df = (spark.read.schema(StructType([kinds[n] for n in names]))
              .option("header", True).option("enforceSchema", True).option("encoding", "ISO-8859-1")
              .option("timestampNTZFormat", TIME_FORMAT).csv(files))
        df = df.select(*[F.col(f"`{kinds[n].name}`").alias(CANONICAL.get(n, n)) for n in names],
                       F.regexp_replace(F.expr("url_decode(replace(_metadata.file_name, '+', '%2B'))"),
                                        r"~part[0-9]+\.csv$", ".csv").alias("source_file"))
        frames.append(df)
    if not frames:
        raise FileNotFoundError(f"no CSV file in {path}")
    return union_sources(frames)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate per-file frames by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def schema_names(df: DataFrame) -> list[str]:
    """Column names without reading data (schema-only read)."""
    return [f.name for f in df.schema.fields]
