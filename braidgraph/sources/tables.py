"""Graph, vector and ingestion tables at rest.

A table is a base and some deltas, folders of Parquet that are never changed. An upsert or
a delete writes its own rows only, deletions as keys that are marked as gone; readers
take the last row of each key among the deltas and those rows of the base that no
delta names. When deltas grow many or large they are merged into a new base.

A version is a small file that lists the folders of all tables. It appears under the next
number by an operation that fails if the number is taken, so readers see whole versions
and two writers can't both have one: who comes second takes up the state that the first
one left and tries again. Folders that no recent version lists are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidgraph.operators import ivf
from braidgraph.operators.graph import upsert
from braidgraph.operators.ingest import ingest, summary
from braidgraph.operators.vectors import search_with
from braidgraph.plans.lineage import checkpointed
from braidgraph.schema import EDGES, LEDGER, NODES, STAGED, VECTORS

#: Deltas of a table before they are merged, and their share of the base's bytes.
DELTAS, SHARE = 16, 0.5
#: Bytes of deltas up to which their keys are sent to all tasks that read the base.
SMALL = 16 << 20
GONE = "__gone"


class Conflict(Exception):
    """Another writer has published this number."""


class Versioned:
    """Tables under a root. Subclasses name them, with their schemas and keys (none: rows are only added)."""

    TABLES: dict[str, tuple[T.StructType, list[str]]] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files ----

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder with the seconds since they changed."""
        fs, path = self._path(folder)
        if not fs.exists(path):
            return {}
        return {s.getPath().getName(): time.time() - s.getModificationTime() / 1000 for s in fs.listStatus(path)}

    def _bytes(self, folder: str) -> int:
        fs, path = self._path(folder)
        return fs.getContentSummary(path).getLength()

    def _publish(self, number: int, state: dict) -> None:
        """Make ``state`` version ``number``, or raise Conflict. The file appears whole: it is written aside,
        then linked (local files) or renamed, neither of which replaces one that is there."""
        fs, aside = self._path(f"aside/{uuid.uuid4().hex}")
        _, target = self._path(f"log/{number:012d}.json")
        fs.mkdirs(target.getParent())
        out = fs.create(aside, False)
        out.write(json.dumps(state).encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = [unquote(urlparse(str(p.toUri().toString())).path) for p in (aside, target)]
                try:
                    os.link(*local)
                except FileExistsError:
                    raise Conflict(number) from None
            elif not fs.rename(aside, target):
                raise Conflict(number)
        finally:
            fs.delete(aside, False)

    # ---- versions ----

    def state(self) -> tuple[int, dict]:
        """The current version's number and its folders; 0 before the first."""
        numbers = sorted(int(n[:-5]) for n in self._names("log") if n.endswith(".json"))
        if not numbers:
            return 0, {}
        fs, path = self._path(f"log/{numbers[-1]:012d}.json")
        file = fs.open(path)
        text = bytes(file.readAllBytes()).decode()
        file.close()
        return numbers[-1], json.loads(text)

    def version(self) -> str | None:
        number, _ = self.state()
        return f"{number:012d}" if number else None

    def _commit(self, change: Callable[[dict], dict | None]) -> int:
        """Publish what ``change`` makes of the current state, again if another writer was faster; None leaves it."""
        while True:
            number, state = self.state()
            new = change(json.loads(json.dumps(state)))
            if new is None:
                return number
            try:
                self._publish(number + 1, new)
                return number + 1
            except Conflict:
                continue

    def _written(self, df: DataFrame, keys: Sequence[str] = (), ranged: bool = False) -> dict | None:
        """``df``, which may be in ranges of its keys, in a folder of its own, with its rows and bytes; None if it has no rows."""
        path, seen = f"data/{uuid.uuid4().hex}", Observation()
        if keys:  # by key, so that a search for some reads few row groups
            df = (df if ranged else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.root}/{path}")
        return {"path": path, "rows": seen.get["n"], "bytes": self._bytes(path)} if seen.get["n"] else None

    def _rows(self, entry: dict, schema: T.StructType, *more: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{entry['path']}")
        for f in schema.fields:  # columns that an older folder lacks
            if f.name not in df.columns:
                df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        return df.select(*schema.fieldNames(), *more)

    def _union(self, frames: list[DataFrame], schema: T.StructType) -> DataFrame:
        out = self.spark.createDataFrame([], schema) if not frames else frames[0]
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def _read(self, name: str, state: dict | None = None) -> DataFrame:
        """The rows of a table: those of the base that no delta names, and each key's last in the deltas."""
        schema, keys = self.TABLES[name]
        own = (self.state()[1] if state is None else state).get(name, {"base": [], "deltas": []})
        base = self._union([self._rows(e, schema) for e in own["base"]], schema)
        if not own["deltas"]:
            return base
        wide = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType()), T.StructField("__at", T.IntegerType())])
        deltas = self._union([self._rows(e, schema, GONE).withColumn("__at", F.lit(i)) for i, e in enumerate(own["deltas"])], wide)
        names = [c for c in schema.fieldNames() if c not in keys]
        if len(own["deltas"]) > 1:
            last = deltas.groupBy(*keys).agg(F.max_by(F.struct(*names, GONE), "__at").alias("last"))
            last = last.select(*keys, *(F.col("last")[c].alias(c) for c in (*names, GONE)))
        else:
            last = deltas.drop("__at")
        named = last.select(*keys)
        if sum(e["bytes"] for e in own["deltas"]) <= SMALL:
            named = F.broadcast(named)
        return base.join(named, keys, "left_anti").unionByName(last.where(~F.col(GONE)).select(*schema.fieldNames()))

    # ---- changes ----

    def _apply(self, batches: dict[str, DataFrame], wipe: bool = False, gone: bool = False) -> int:
        """Upsert (or delete) the rows of some tables as one version; ``wipe`` starts from empty ones."""
        made: dict[str, dict | None] = {}
        for name, df in batches.items():
            schema, keys = self.TABLES[name]
            if keys and not gone:
                # one shuffle, into the ranges that are written, instead of one by hash and another
                df = upsert(self.spark.createDataFrame([], schema), df, keys, ranges=True).select(*schema.fieldNames())
            if keys and not wipe:
                df = df.withColumn(GONE, F.lit(gone))
            made[name] = self._written(df, keys, ranged=bool(keys) and not gone)

        def change(state: dict) -> dict:
            for name, entry in made.items():
                own = {"base": [], "deltas": []} if wipe else state.get(name, {"base": [], "deltas": []})
                first = not own["base"] and not own["deltas"] and not gone
                if entry:
                    own["base" if wipe or first or not self.TABLES[name][1] else "deltas"].append(entry)
                state[name] = own
            return self._touched(state, set(made))

        number = self._commit(change)
        for name in made:
            self._merge_if_due(name)
        return number

    def _touched(self, state: dict, names: set[str]) -> dict:
        """Hook: what else a change of these tables does to the state."""
        return state

    def _merge_if_due(self, name: str) -> None:
        own = self.state()[1].get(name, {"base": [], "deltas": []})
        late, whole = sum(e["bytes"] for e in own["deltas"]), sum(e["bytes"] for e in own["base"])
        if len(own["deltas"]) > DELTAS or own["deltas"] and late > SHARE * whole or len(own["base"]) > DELTAS:
            self.compact(name)

    def compact(self, name: str) -> None:
        """Merge base and deltas into a new base; deltas that come meanwhile stay, and if another writer
        has replaced what was merged, nothing changes."""
        _, before = self.state()
        own = before.get(name, {"base": [], "deltas": []})
        entry = self._written(self._read(name, before), self.TABLES[name][1])

        def change(state: dict) -> dict | None:
            now = state.get(name, {"base": [], "deltas": []})
            n, b = len(own["deltas"]), len(own["base"])
            if now["base"][:b] != own["base"] or now["deltas"][:n] != own["deltas"]:
                return None
            state[name] = {"base": ([entry] if entry else []) + now["base"][b:], "deltas": now["deltas"][n:]}
            return state

        self._commit(change)

    def vacuum(self, keep: int = 2, older_than: float = 3600) -> int:
        """Remove folders that the last ``keep`` versions don't list and that are so many seconds old, as
        younger ones may belong to a write that isn't published yet; how many there were."""
        logs = sorted(n for n in self._names("log") if n.endswith(".json"))
        listed: set[str] = set()
        for n in logs[-keep:]:
            fs, path = self._path(f"log/{n}")
            file = fs.open(path)
            state = json.loads(bytes(file.readAllBytes()).decode())
            file.close()
            listed |= {e["path"].partition("/")[2] for own in state.values() for e in (*own.get("base", ()), *own.get("deltas", ()), own) if "path" in e}
        gone = [n for n, age in self._names("data").items() if n not in listed and age >= older_than]
        for n in gone:
            fs, path = self._path(f"data/{n}")
            fs.delete(path, True)
        for n in logs[:-keep]:
            fs, path = self._path(f"log/{n}")
            fs.delete(path, False)
        return len(gone)


class GraphTables(Versioned):
    """Nodes and edges of a store."""

    TABLES = {"nodes": (NODES, ["id"]), "edges": (EDGES, ["src", "rel", "dst"])}

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges")

    def write(self, nodes: DataFrame, edges: DataFrame, wipe: bool = False) -> None:
        """Upsert both tables as one new version; ``wipe`` starts from empty ones."""
        self._apply({"nodes": nodes, "edges": edges}, wipe)

    def clear(self) -> None:
        self.write(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES), wipe=True)


class VectorTables(Versioned):
    """Vectors and their metadata columns, by id, with an approximate index if one was made."""

    TABLES = {"vectors": (VECTORS, ["id"])}

    @property
    def rows(self) -> DataFrame:
        return self._read("vectors")

    def count(self) -> int:
        """Rows; 0 for a store that isn't there, which this does not make."""
        return self.rows.count()

    def existing_ids(self) -> DataFrame:
        return self.rows.select("id")

    def upsert(self, batch: DataFrame, wipe: bool = False) -> None:
        self._apply({"vectors": batch}, wipe)

    def delete_ids(self, ids: DataFrame) -> int:
        """Remove rows by id; how many there were."""
        asked = ids.where("id is not null and id != ''").select("id").distinct()
        there = checkpointed(self.rows.join(asked, "id", "left_semi"))
        gone = there.count()
        if gone:
            self._apply({"vectors": there}, gone=True)
        return gone

    def _touched(self, state: dict, names: set[str]) -> dict:
        state.pop("index", None)  # it knows the rows that it was made from; until it is made anew, search is exact
        return state

    def maybe_create_index(self, threshold: int, **how) -> bool:
        """An index over the current rows, if there are ``threshold`` of them (0: never); whether it was made."""
        number, state = self.state()
        index = ivf.maybe_build(self._read("vectors", state), threshold, **how)
        if index is None:
            return False
        path = f"data/{uuid.uuid4().hex}"
        ivf.save(index, f"{self.root}/{path}")

        def change(now: dict) -> dict | None:
            return None if now.get("vectors") != state["vectors"] else now | {"index": {"path": path}}

        self._commit(change)
        return "index" in self.state()[1]

    def search(self, query: Sequence[float], k: int = 8, where: str | None = None, backend: str = "auto") -> DataFrame:
        """By a backend's name; ``auto`` uses the index where there is one, ``ivf`` asks for it."""
        index = self.state()[1].get("index")
        if backend == "ivf" and index is None:
            raise ValueError("the store has no index")
        if index is not None and backend in ("auto", "ivf"):
            return ivf.search(ivf.load(self.spark, f"{self.root}/{index['path']}"), query, k, where)
        return search_with(backend, self.rows, query, k, where)


class IngestStore(Versioned):
    """Staged texts and the ledger of an ingestion."""

    TABLES = {"ledger": (LEDGER, []), "staged": (STAGED, [])}

    @property
    def ledger(self) -> DataFrame:
        return self._read("ledger")

    @property
    def staged(self) -> DataFrame:
        return self._read("staged")

    def run(self, files: DataFrame, now: str, update: bool = False) -> DataFrame:
        """Ingest files (path, content); with ``update`` over what is there, else from the start.

        Outcomes of earlier runs stay in the ledger; the summary of this run is returned.
        What is new depends on the ledger, so a run that loses to another one is made again.
        """
        while True:
            number, state = self.state()
            out = checkpointed(ingest(files, self._read("ledger", state) if update else None, now))
            new = {"ledger": self._written(out.select(*LEDGER.fieldNames())), "staged": self._written(out.where("status = 'ingested'").select(*STAGED.fieldNames()))}
            after = {n: {"base": [*(state.get(n, {}).get("base", []) if update else []), *([e] if e else [])], "deltas": []} for n, e in new.items()}
            try:
                self._publish(number + 1, after)
            except Conflict:
                continue
            for name in after:
                self._merge_if_due(name)
            return summary(out)
