"""Embedding caches and files: JSON, JSON lines, directory walks."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.operators.ingest import walkable

_CACHE = "model string, dim int, texts array<string>, vectors array<array<float>>, metadata array<map<string,string>>, created_at string"
_ROW = "__meta__ struct<version:int,model:string,dim:int,n_vectors:bigint,created_at:string>, id string, kind string, name string, title string, file_path string, text string, vector array<float>"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(model, dim, created_at, pos, text, vector, metadata) of a JSON cache, gzip or not."""
    whole = spark.read.schema(_CACHE).json(path, multiLine=True)
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    rows = F.arrays_zip(empty("texts", "array<string>").alias("text"), empty("vectors", "array<array<float>>").alias("vector"), empty("metadata", "array<map<string,string>>").alias("metadata"))
    return whole.select(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("dim", F.lit(0)).alias("dim"), F.coalesce("created_at", F.lit("")).alias("created_at"), F.posexplode(rows).alias("pos", "row")).select("model", "dim", "created_at", F.col("pos").cast("long").alias("pos"), "row.*")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of a JSON-lines cache."""
    every = spark.read.schema(_ROW).json(path)
    return every.where("__meta__ is not null").select("__meta__.*"), every.where("__meta__ is null").drop("__meta__")


def write_jsonl(rows: DataFrame, path: str, model: str, dim: int, created_at: str) -> None:
    """Rows in order of ``pos`` with defaults for absent fields, the header in a file of its own that sorts first."""
    spark = rows.sparkSession
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in ("kind", "name", "title", "file_path")]
    named = F.coalesce(F.col("id").cast("string"), F.col("pos").cast("string")) if "id" in rows.columns else F.col("pos").cast("string")
    out = rows.repartitionByRange("pos").sortWithinPartitions("pos").select(named.alias("id"), *filled, "text", "vector")
    head = spark.range(1).select(F.struct(F.lit(1).alias("version"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(rows.count()).alias("n_vectors"), F.lit(created_at).alias("created_at")).alias("__meta__"))
    head.coalesce(1).write.mode("overwrite").json(f"{path}/header", compression="gzip")
    out.write.mode("overwrite").json(f"{path}/rows", compression="gzip")


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the files under ``root``, hidden and skipped folders left out; path is
    relative. Spark's reader leaves out files without bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    whole = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    base = posixpath.normpath("/" + root.partition(":")[2].lstrip("/") if ":" in root else root) + "/"
    relative = F.when(whole.startswith(base), F.substr(whole, F.lit(len(base) + 1))).otherwise(whole)
    return files.select(relative.alias("path"), "content").where(walkable(F.col("path")))


def read_sources(spark: SparkSession, sources: Sequence[str], staging: str | None = None) -> DataFrame:
    """(path, content) of several files and folders, each path once and whole.

    A source that is not there is refused. A file that is named comes whatever its suffix;
    of a folder hidden and skipped parts are left out, and so is what lies in ``staging``.
    Spark's reader leaves out files without bytes, and those whose names start with a dot
    or an underscore.
    """
    bare = lambda p: posixpath.normpath("/" + p.partition(":")[2].lstrip("/") if ":" in p else p)
    parts = []
    for source in sources:
        path = spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(f"source does not exist: {source}")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
        rows = rows.select(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/").alias("path"), "content")
        if not fs.getFileStatus(path).isFile():
            base = bare(source).rstrip("/") + "/"
            rows = rows.where(walkable(F.substr("path", F.lit(len(base) + 1))))
            if staging is not None:
                rows = rows.where(~F.col("path").startswith(bare(staging).rstrip("/") + "/"))
        parts.append(rows)
    none = spark.createDataFrame([], "path string, content binary")
    return reduce(DataFrame.unionByName, parts, none).dropDuplicates(["path"])


def safe_join(root: str, relative: str) -> str:
    """``root/relative``; a path that leaves the root is refused."""
    base = posixpath.normpath(root)
    out = posixpath.normpath(posixpath.join(base, relative))
    if out != base and not out.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"{relative!r} leaves the root")
    return out


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files; older ones name their key ``tree_hash`` or ``commit``."""
    schema = "key string, tree_hash string, commit string, branch string, timestamp string, version string, metrics map<string,string>, hotspots array<map<string,string>>, issues array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    total = lambda n: F.col("metrics").getItem(n).try_cast("bigint").alias(n)
    return rows.select(F.coalesce("key", "tree_hash", "commit").alias("key"), "branch", "timestamp", "version", "metrics", total("total_nodes"), total("total_edges"), "hotspots", "issues")
