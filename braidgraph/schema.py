"""Schemas of the tables that the engine stores."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(name: str, required: bool = False) -> T.StructField:
    return T.StructField(name, T.StringType(), not required)


NODES = T.StructType(
    [
        _s("id", True),
        _s("kind", True),
        _s("name", True),
        _s("qualname"),
        _s("module_path"),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("end_lineno", T.IntegerType()),
        _s("docstring"),
        _s("metadata"),
    ]
)
EDGES = T.StructType([_s("src", True), _s("rel", True), _s("dst", True), _s("evidence"), T.StructField("weight", T.DoubleType())])
VECTORS = T.StructType([_s("id", True), _s("kind"), _s("name"), _s("qualname"), _s("module_path"), _s("text"), T.StructField("vector", T.ArrayType(T.FloatType()))])
LEDGER = T.StructType(
    [
        _s("source_path"),
        _s("sha256"),
        T.StructField("size_bytes", T.LongType()),
        _s("status"),
        _s("staged_path"),
        _s("converter"),
        _s("converter_version"),
        _s("reason"),
        _s("ingested_at"),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
STAGED = T.StructType([_s("staged_path"), _s("sha256"), _s("source_path"), _s("text")])
SNAPSHOTS = T.StructType(
    [
        _s("key"),
        _s("branch"),
        _s("timestamp"),
        _s("version"),
        T.StructField("total_nodes", T.LongType()),
        T.StructField("total_edges", T.LongType()),
        T.StructField("node_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("edge_counts", T.MapType(T.StringType(), T.LongType())),
        _s("metrics"),
        T.StructField("hotspots", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
        T.StructField("issues", T.ArrayType(T.StringType())),
    ]
)
#: Relations that expansion follows unless told otherwise.
DEFAULT_RELS = ("CONTAINS", "CALLS", "IMPORTS", "INHERITS")
