"""Metric snapshots: deltas, diffs, listing, saving and pruning."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from braidgraph.plans.lineage import carried
from braidgraph.schema import SNAPSHOTS


def _delta(column: str, before: Column) -> Column:
    return F.when(before.isNotNull(), F.col(column) - before[column])


Delta = Callable[[str, Column], Column]


def with_deltas(snapshots: DataFrame, branch: str | None = None, delta: Delta = _delta) -> DataFrame:
    """``snapshots`` with nodes and edges gained since the one before and since the first.

    ``delta`` makes a gain from a column's name and the earlier state. The history of a
    store is one small table by nature, ordered as a whole.
    """
    rows = snapshots.where(F.col("branch") == branch) if branch is not None else snapshots
    state = F.struct("total_nodes", "total_edges")
    by_time = Window.orderBy("timestamp", "key")
    first = F.first(state).over(by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("before", F.lag(state).over(by_time)).withColumn("base", F.when(F.row_number().over(by_time) > 1, first))
    return rows.withColumns(
        {
            "nodes_vs_previous": delta("total_nodes", F.col("before")),
            "edges_vs_previous": delta("total_edges", F.col("before")),
            "nodes_vs_baseline": delta("total_nodes", F.col("base")),
            "edges_vs_baseline": delta("total_edges", F.col("base")),
        }
    ).drop("before", "base")


def listing(snapshots: DataFrame, limit: int = 0, branch: str | None = None) -> DataFrame:
    """Newest first; ``limit`` 0 means all."""
    rows = with_deltas(snapshots, branch).orderBy(F.desc("timestamp"), F.desc("key"))
    return rows.limit(limit) if limit else rows


def load(snapshots: DataFrame, key: str, delta: Delta = _delta) -> DataFrame:
    """The snapshot of a key, or the ``latest``, with its deltas; no row if there is none."""
    rows = with_deltas(snapshots, delta=delta)
    return rows.orderBy(F.desc("timestamp"), F.desc("key")).limit(1) if key == "latest" else rows.where(F.col("key") == key).limit(1)


def captured(snapshots: DataFrame, new: DataFrame, delta: Delta = _delta) -> DataFrame:
    """The one-row ``new``, not saved yet, with its deltas to the latest and the first snapshot of other keys."""
    return load(snapshots.join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True), new.first()["key"], delta)


def previous(snapshots: DataFrame, timestamp: str) -> DataFrame:
    """The latest snapshot strictly before a time."""
    return snapshots.where(F.col("timestamp") < timestamp).orderBy(F.desc("timestamp"), F.desc("key")).limit(1)


def previous_of(times: DataFrame, snapshots: DataFrame, by_branch: bool = False) -> DataFrame:
    """``times`` (at, and branch if asked for, ...) with the ``snapshot`` (key, timestamp, totals) that is the latest
    strictly before each; of equal times that with the greatest key. Null without one.

    Both are put in one order and snapshots carried on over sorted ranges, so neither the
    times nor the history pass through one task.
    """
    held = F.struct("key", "timestamp", "total_nodes", "total_edges")
    names, lanes = times.columns, ["branch"] if by_branch else []
    # of a time the rows that ask come before its snapshots
    asks = times.select(*lanes, F.col("at").alias("__at"), F.lit(False).alias("__later"), F.lit("").alias("__key"), F.struct(*names).alias("__row"))
    said = snapshots.select(*lanes, F.col("timestamp").alias("__at"), F.lit(True).alias("__later"), F.col("key").alias("__key"), held.alias("__snap"))
    both = asks.unionByName(said, allowMissingColumns=True)
    if by_branch:  # one that belongs to another branch is of no use
        both = both.withColumn("__said", F.when(F.col("__later"), F.struct(F.col("branch").alias("of"), F.col("__snap").alias("is"))))
    else:
        both = both.withColumn("__said", F.when(F.col("__later"), F.struct(F.lit(None).cast("string").alias("of"), F.col("__snap").alias("is"))))
    order = [F.asc_nulls_first(c) for c in (*lanes, "__at", "__later", "__key")]
    out = carried(both, order, "__said", "__found").where(~F.col("__later"))
    mine = F.col("__found.of").eqNullSafe(F.col("branch")) if by_branch else F.lit(True)
    known = F.col("__row")["at"].isNotNull()
    return out.select("__row.*", F.when(mine & known, F.col("__found.is")).alias("snapshot"))


def diff(snapshots: DataFrame, a: str, b: str) -> DataFrame:
    """(section, name, delta) from ``a`` to ``b``: totals, and each kind and relation of either."""
    pick = lambda k: snapshots.where(F.col("key") == k).limit(1)

    def flat(df: DataFrame, value: str) -> DataFrame:
        totals = df.select(F.explode(F.array(*(F.struct(F.lit("total").alias("section"), F.lit(n).alias("name"), F.col(f"total_{n}").alias(value)) for n in ("nodes", "edges")))).alias("r")).select("r.*")
        for section in ("node_counts", "edge_counts"):
            totals = totals.unionByName(df.select(F.explode(section).alias("name", value)).select(F.lit(section).alias("section"), "name", value))
        return totals

    both = flat(pick(a), "x").join(flat(pick(b), "y"), ["section", "name"], "full_outer")
    return both.select("section", "name", (F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))).alias("delta"))


def prune(snapshots: DataFrame, same: list[str]) -> DataFrame:
    """``snapshots`` without interior ones that equal, in columns ``same``, the one before;
    first and last always stay. Equality carries over, so the row before decides."""
    by_time = Window.orderBy("timestamp", "key")
    state = F.to_json(F.struct(*same), {"ignoreNullFields": "false"})
    marked = snapshots.withColumn("_same", F.lag(state).over(by_time) == state).withColumn("_last", F.lead("key").over(by_time).isNull())
    return marked.where(~F.coalesce("_same", F.lit(False)) | F.col("_last")).drop("_same", "_last")


def save(snapshots: DataFrame, new: DataFrame, same: list[str], force: bool = False, changed: Callable[[Row, Row], bool] | None = None) -> DataFrame:
    """The history with the one-row ``new``: refused if it has no nodes; if it equals the
    latest and isn't forced, that one takes its key and time; else it is added or replaces its key.

    ``changed`` says whether the latest and the new row differ; by default columns ``same`` are compared.
    """
    changed = changed or (lambda old, own: any(old[c] != own[c] for c in same))
    fresh = new.first()
    if fresh is None or not fresh["total_nodes"]:
        raise ValueError("a snapshot without nodes is not saved")
    latest = snapshots.orderBy(F.desc("timestamp"), F.desc("key")).limit(1)
    gone = {fresh["key"]}
    if not force and (row := latest.first()) is not None and not changed(row, fresh):
        gone.add(row["key"])
    return snapshots.where(~F.col("key").isin(*gone)).unionByName(new)


def relative_paths(value, root: str):
    """``value`` with absolute paths inside ``root`` made relative, in nested dicts and lists too."""
    if isinstance(value, dict):
        return {relative_paths(k, root): relative_paths(v, root) for k, v in value.items()}
    if isinstance(value, list):
        return [relative_paths(v, root) for v in value]
    base = posixpath.normpath(root) + "/"
    if isinstance(value, str) and posixpath.isabs(value) and (posixpath.normpath(value) + "/").startswith(base):
        return posixpath.relpath(posixpath.normpath(value), posixpath.normpath(root))
    return value


def capture(spark: SparkSession, key: str, branch: str, version: str, timestamp: str, stats: dict, root: str = "", hotspots: list[dict] | None = None, issues: list[str] | None = None, **extra) -> DataFrame:
    """A one-row snapshot of ``stats``; ``extra`` metrics win over them."""
    metrics = relative_paths({**stats, **extra}, root) if root else {**stats, **extra}
    spots = [{k: str(v) for k, v in h.items()} for h in (relative_paths(hotspots or [], root) if root else hotspots or [])]
    row = (key, branch, timestamp, version, int(metrics.get("total_nodes", 0)), int(metrics.get("total_edges", 0)), metrics.get("node_counts") or {}, metrics.get("edge_counts") or {}, json.dumps(metrics, sort_keys=True), spots, issues or [])
    return spark.createDataFrame([row], SNAPSHOTS)


def broken(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(key, problem): entries without a file, and files without an entry."""
    lost = manifest.select("key").join(files.select("key"), "key", "left_anti").withColumn("problem", F.lit("broken entry"))
    return lost.unionByName(files.select("key").join(manifest.select("key"), "key", "left_anti").withColumn("problem", F.lit("orphan file")))


def cleaned(snapshots: DataFrame, same: list[str], files: DataFrame) -> DataFrame:
    """One row: interior snapshots that pruning removes, broken entries, orphan files, and their total."""
    gone = snapshots.join(prune(snapshots, same).select("key"), "key", "left_anti").select(F.lit("pruned").alias("problem"))
    every = gone.unionByName(broken(snapshots, files).select("problem"))
    count = lambda p: F.count_if(F.col("problem") == p)
    return every.agg(count("pruned").alias("pruned"), count("broken entry").alias("broken"), count("orphan file").alias("orphans"), F.count("*").alias("total_cleaned"))
