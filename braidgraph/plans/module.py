"""A knowledge-graph module: extract, build, index, query, pack."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.functions.text import lines
from braidgraph.operators import embed, graph, retrieve
from braidgraph.plans.lineage import checkpointed
from braidgraph.schema import EDGES, NODES
from braidgraph.sources.tables import GraphTables, VectorTables


# fixed values: the names, order and defaults of these fields are what extractors give
@dataclass
class NodeSpec:
    node_id: str
    kind: str
    name: str
    qualname: str | None = None
    source_path: str | None = None
    lineno: int | None = None
    end_lineno: int | None = None
    docstring: str = ""
    metadata: dict = field(default_factory=dict)


@dataclass
class EdgeSpec:
    source_id: str
    target_id: str
    relation: str
    weight: float = 1.0
    metadata: dict = field(default_factory=dict)


def frames(spark: SparkSession, specs: Iterable[NodeSpec | EdgeSpec]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an extractor that yields specs on the driver; what is no node is an edge."""
    import json

    text = lambda d: json.dumps(d, ensure_ascii=False) if d else None
    nodes, edges = [], []
    for s in specs:
        if isinstance(s, NodeSpec):
            nodes.append((s.node_id, s.kind, s.name, s.qualname, s.source_path, s.lineno, s.end_lineno, s.docstring, text(s.metadata)))
        else:
            edges.append((s.source_id, s.relation, s.target_id, text(s.metadata), s.weight))
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


class GraphModule:
    """Subclasses give ``extract``; everything else has a default.

    ``extract`` returns (nodes, edges) as DataFrames, or specs from the driver.
    """

    kind = "graph"
    node_kinds: Sequence[str] = ()
    edge_kinds: Sequence[str] = ()
    index_kinds: Sequence[str] = ()
    priorities: dict[str, int] = {}

    def __init__(self, spark: SparkSession, root: str, encoder: Callable[[], embed.Encoder] = embed.hashing_encoder):
        self.spark, self.root, self.encoder = spark, root.rstrip("/"), encoder
        self.tables, self.vectors = GraphTables(spark, f"{self.root}/graph"), VectorTables(spark, f"{self.root}/vectors")

    def extract(self) -> tuple[DataFrame, DataFrame] | Iterable[NodeSpec | EdgeSpec]:
        raise NotImplementedError

    def after_build(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """More edges, by default those that symbol stubs resolve to."""
        return graph.resolve_symbols(nodes)

    def meaningful_kinds(self) -> Sequence[str]:
        """Kinds that coverage counts, by default all but symbol stubs."""
        return [k for k in self.node_kinds if k != "symbol"]

    def coverage(self) -> DataFrame:
        return graph.coverage(self.tables.nodes, self.meaningful_kinds())

    def analyze(self) -> DataFrame:
        return self.stats()

    def build_graph(self, wipe: bool = False) -> None:
        got = self.extract()
        nodes, edges = got if isinstance(got, tuple) else frames(self.spark, got)
        self.tables.write(nodes, edges, wipe)
        more = self.after_build(self.tables.nodes, self.tables.edges)
        self.tables.write(self.tables.nodes.where("false"), checkpointed(more))

    def build_index(self, wipe: bool = False, sync: bool = False) -> None:
        """Embed the nodes of the index kinds; vectors of nodes that are gone stay unless ``wipe`` or ``sync``."""
        old = self.vectors.rows if not wipe and self.vectors.version() else None
        rows = embed.build_index(self.tables.nodes, list(self.index_kinds), old, self.encoder, sync)
        self.vectors.upsert(rows, wipe=True)

    def build(self, wipe: bool = False) -> DataFrame:
        self.build_graph(wipe)
        self.build_index(wipe)
        return self.stats()

    def stats(self) -> DataFrame:
        return graph.stats(self.tables.nodes, self.tables.edges).withColumn("vector_backend", F.lit("exact"))

    def node(self, node_id: str) -> DataFrame:
        return graph.node(self.tables.nodes, node_id)

    def callers(self, node_id: str, rel: str = "CALLS") -> DataFrame:
        return graph.callers_of(self.tables.nodes, self.tables.edges, node_id, rel)

    def _query_vector(self, text: str) -> list[float]:
        clean = self.spark.range(1).select(F.trim(F.regexp_replace(F.lit(text), "[_-]+", " "))).first()[0]
        return [float(x) for x in self.encoder()([clean])[0]]

    def query(self, text: str, **how) -> retrieve.Retrieved:
        return retrieve.query(self.tables.nodes, self.tables.edges, self.vectors.rows, self._query_vector(text), text, priorities=self.priorities, **how)

    def pack(self, text: str, files: DataFrame, **how) -> retrieve.Packed:
        """``files`` is (path, content) as the file reader gives it."""
        read = files.select(F.col("path").alias("module_path"), lines(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))).alias("lines"))
        return retrieve.pack(self.tables.nodes, self.tables.edges, self.vectors.rows, read, self._query_vector(text), text, priorities=self.priorities, **how)
