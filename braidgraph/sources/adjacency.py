"""Edges at rest for graph reads: both directions, bucketed by node and in each bucket together by node.

A hop joins the nodes found last with a bucketed table, so only these nodes are shuffled
and edges are read where they lie. A node with more than ``HUB`` edges is kept under
several keys, dealt by its neighbours' hash, so no bucket holds a large share of all
edges, and so are the few nodes that are counted in one slot with it; how many keys each
of these has is a small table of its own. Only their rows hold the name beside the key.
Reads of single nodes go to their keys' buckets, and there to the row groups whose Bloom
filters let the keys in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from braidgraph.plans.lineage import checkpointed
from braidgraph.schema import DEFAULT_RELS

#: Edges of a node under one key, at most about.
HUB = 100_000
#: Nodes are counted in so many slots, by hash; a slot without a hub holds far fewer edges than ``HUB``.
SLOTS = 1 << 20
_PARTED = "\x01"


class Adjacency:
    """The table ``name`` in the session's catalog, its files under ``path``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def build(cls, edges: DataFrame, name: str, path: str, buckets: int | None = None, hub: int = HUB) -> Adjacency:
        """Store ``edges`` (src, rel, dst, ...) with each direction a row; a table of that name is replaced.

        Fewer buckets than shuffle partitions would make joins shuffle the edges as well.
        """
        spark = edges.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        # both directions of a row together, so that the edges are made once
        ways = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("in").alias("way")))
        both = edges.select(F.inline(ways), *rest)
        # counted by slot, as this takes numbers in a small table where counting by name takes each name
        hot = checkpointed(both.groupBy(cls._slot()).agg(F.ceil(F.count("*") / hub).cast("int").alias("cuts")).where("cuts > 1"))
        made = cls(spark, name)
        cut = F.concat("node", F.lit(_PARTED), F.pmod(F.xxhash64("other"), F.col("cuts")))
        dealt = both.withColumn("slot", cls._slot()).join(F.broadcast(hot), "slot", "left")
        dealt = dealt.select(F.when(F.col("cuts").isNull(), F.col("node")).otherwise(cut).alias("key"), F.when(F.col("cuts").isNotNull(), F.col("node")).alias("hub"), "other", "way", *rest)
        # a node's edges lie together by its hash, a number that is sorted digit by digit; names have long common
        # beginnings, and a sort by them compares them in full. The writer sorts by bucket only, which leaves that order;
        # the count keeps the optimizer from taking the first of two sorts for needless
        dealt = dealt.repartition(buckets, "key").sortWithinPartitions(F.xxhash64("key")).observe(Observation(), F.count(F.lit(1)).alias("n"))
        options = {"path": f"{path}/edges", "parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "1000000"}
        dealt.write.bucketBy(buckets, "key").options(**options).mode("overwrite").saveAsTable(name)
        hubs = spark.table(name).where("hub is not null").select(F.col("hub").alias("node")).distinct()
        hubs = hubs.withColumn("slot", cls._slot()).join(F.broadcast(hot), "slot").select("node", "cuts")
        hubs.write.option("path", f"{path}/hubs").mode("overwrite").saveAsTable(f"{name}_hubs")
        return made

    @staticmethod
    def _slot() -> Column:
        return F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int").alias("slot")

    @property
    def edges(self) -> DataFrame:
        """key, node, other, way (out: node is the source), and the edges' other columns."""
        stored = self.spark.table(self.name)
        rest = [c for c in stored.columns if c not in ("key", "hub")]
        return stored.select("key", F.coalesce("hub", "key").alias("node"), *rest)

    @property
    def hubs(self) -> DataFrame:
        return self.spark.table(f"{self.name}_hubs")

    @staticmethod
    def _with_cuts(rows: DataFrame, hubs: DataFrame) -> DataFrame:
        # hubs have a row for many edges; whether they are sent to all tasks is up to their size
        return rows.join(hubs, "node", "left")

    def keys(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (node, ...) with each key that their edges lie under."""
        parts = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda i: F.concat("node", F.lit(_PARTED), i))
        held = self._with_cuts(nodes, self.hubs)
        return held.withColumn("key", F.explode(F.when(F.col("cuts").isNull(), F.array("node")).otherwise(parts))).drop("cuts")

    def of(self, *nodes: str) -> DataFrame:
        """The edges of some nodes; only their keys' buckets are read."""
        own = self.spark.createDataFrame([(n,) for n in nodes], "node string")
        keys = [r.key for r in self.keys(own).select("key").distinct().collect()]
        return self.edges.where(F.col("key").isin(keys))

    def edges_from(self, node: str, rel: str = "CALLS", limit: int | None = None) -> DataFrame:
        out = self.of(node).where((F.col("way") == "out") & (F.col("rel") == rel)).drop("key", "way").withColumnsRenamed({"node": "src", "other": "dst"})
        return out.orderBy("dst").limit(limit) if limit is not None else out

    def callers(self, node: str, rel: str = "CALLS") -> DataFrame:
        """Sources of the ``rel`` edges that come into a node."""
        return self.of(node).where((F.col("way") == "in") & (F.col("rel") == rel)).select(F.col("other").alias("id"))

    def step(self, nodes: DataFrame, rels: Sequence[str]) -> DataFrame:
        """``nodes`` (node, ...) with ``other``, the node at the other end, for each of their edges."""
        edges = self.edges.where(F.col("rel").isin(*rels)) if rels else self.edges.where(F.lit(False))
        # the nodes of a bucket are held, its edges pass by; a merge join would sort all edges for each hop
        return edges.select("key", "other").join(self.keys(nodes).hint("shuffle_hash"), "key").select(*nodes.columns, "other")

    def expand(self, seeds: DataFrame, hop: int = 1, rels: Sequence[str] = DEFAULT_RELS) -> DataFrame:
        """(id, best_hop, via_seed) of all nodes within ``hop`` steps of a seed, as ``graph.expand`` finds them."""
        last = checkpointed(seeds.select("id").distinct().select("id", F.lit(0).alias("best_hop"), F.col("id").alias("via_seed")))
        found = last
        for level in range(1, hop + 1):
            met = self.step(last.select(F.col("id").alias("node"), "via_seed"), rels)
            reached = met.groupBy(F.col("other").alias("id")).agg(F.min("via_seed").alias("via_seed"))
            last = checkpointed(reached.join(found.select("id"), "id", "left_anti").select("id", F.lit(level).alias("best_hop"), "via_seed"))
            found = found.unionByName(last)
            if last.isEmpty():
                break
        return found

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for n in (self.name, f"{self.name}_hubs"):
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
