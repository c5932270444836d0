"""N-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles. Two link when their Jaccard similarity reaches
a threshold; components of links are returned, each document with its smallest
document id. Nothing is approximate but the identity of shingles, 64-bit hashes.

1. *Sets and frequencies.* Each task turns its texts into sets and deals the hashes
   out by their leading bits, in blobs rather than rows. A hash that ``HOT`` documents
   of a chunk hold is counted there and dealt once, with its count, so a shingle that
   a third of all documents share reaches its bucket as one entry a chunk. Each bucket
   sums the counts, names the hashes that more than one document holds by their place
   among the bucket's, and returns names and counts.
   A link needs ``threshold`` of all tokens in common, so with u tokens that no other
   document holds, a document of n tokens keeps at most
   ``n - ceil(threshold * n) + 1 - u`` of its rarest shared tokens as its prefix, and
   linked documents share a prefix token. Most documents have none left and are done.
2. *Copies.* Equal sets collapse to one node by partial sums.
3. *Groups.* Nodes with a common rare token form groups, split by hash so that none
   exceeds about ``group_size``.
4. *Token-group matrix.* A group's column is the union of its members' prefix tokens
   for finding it, and the union of all their shared tokens for bounding. A query
   block meets a group only where the matrix has a token of both. A query's overlap
   with the group's union bounds its overlap with every member; only a group whose
   bound reaches the threshold is opened, and its members' overlaps are then exact.
   Links leave a cell as stars, a row for each node, never as all pairs of a cluster.
5. *Two rounds.* In the first, each group meets itself and, for each of its tokens, one
   group that represents the token: as many cells as the matrix has entries at most.
   Components of these links become units. In the second, only tokens whose nodes lie
   in different units are still open; a unit larger than a group gets groups of its
   own, which meet other units' groups but never each other. A cluster of near copies
   so takes cells in proportion to its size.
6. *Components* by alternating large and small stars.

A group's queries are cut by hash into slices of about ``slice_size``, so no cell
grows with a cluster.

Defined edge cases: texts without words, null ones included, have empty sets and are
linked with nothing, not even with each other; repeated rows are equal sets and so
linked; null ids never name a component unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpointed, dealt_join, fresh, shuffles_released, small_batches

# Arrow's usual allocators keep what was freed; Python workers, which live through many stages, would hold it
pa.set_memory_pool(pa.system_memory_pool())

SHINGLE, THRESHOLD = 4, 85
GROUP_SIZE, SLICE_SIZE = 128, 256
#: Documents of a chunk from which on a token is counted before it is dealt.
HOT = 8
#: Tokens and documents that a task holds before it deals them out, and bytes of text hashed at a time.
#: Documents of a chunk are numbered in 16 bits.
CHUNK_TOKENS, CHUNK_DOCS, CHUNK_BYTES = 1_000_000, 1 << 16, 1 << 20
_LOW = -(2**63)
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(0xB7A1D).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_STEP = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z in lower case, words between ASCII blanks)."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = _SPACE[data]
    solid = np.flatnonzero(~blank)
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    if not len(solid):
        return out
    at = np.flatnonzero(np.concatenate([[True], np.diff(solid) > 1]))  # words, as places in solid
    sizes = np.diff(np.append(at, len(solid)))
    power = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    place = np.arange(len(solid), dtype=np.int32)
    place -= np.repeat(at.astype(np.int32), sizes)
    values = power[place]
    values *= _BYTE[data[solid]]
    words = _mix(np.add.reduceat(values, at) + sizes.astype(np.uint64))
    doc = np.searchsorted(firsts, solid[at], "right") - 1
    ends = np.searchsorted(doc, np.arange(len(texts)), "right")
    starts = np.searchsorted(doc, np.arange(len(texts)), "left")
    keys = [_mix(np.array([j + 1], np.uint64) * _STEP)[0] | _U(1) for j in range(k)]
    if len(words) >= k:
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            grams += words[j : len(words) - k + 1 + j] * keys[j]
        grams = _mix(grams)
    for i in range(len(texts)):
        s, e = starts[i], ends[i]
        if e - s >= k:
            out[i] = np.unique(grams[s : e - k + 1])
        elif e > s:
            short = words[s:e] * np.array(keys[: e - s], np.uint64)
            out[i] = _mix(np.array([short.sum()], np.uint64) + np.array([e - s], np.uint64) * _STEP)
    return out


def _needed(n: np.ndarray, threshold: int) -> np.ndarray:
    """Least overlap with any linked set."""
    return (threshold * n + 99) // 100


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


_DEALT = "bucket long, part long, docs binary, tokens binary, again binary, df binary"
_MEMBERS = "doc_id long, t long, n long, node binary, prefix array<long>, shared binary"


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


_DEALT_NAMES = ["bucket", "part", "docs", "tokens", "again", "df"]
_DEALT_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def packed(tokens: np.ndarray) -> bytes:
    """Ascending hashes as their steps, each in as many bytes as the largest step needs."""
    if not len(tokens):
        return b""
    steps = np.diff(tokens)
    size = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + int(tokens[0]).to_bytes(8, "little") + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    size = data[0]
    out = np.zeros(((len(data) - 9) // size + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    out[1:, :size] = np.frombuffer(data, np.uint8, -1, 9).reshape(-1, size)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def dealt_rows(part: int, ids: list[int], marks: list[int], sets: list[np.ndarray], bits: int) -> list[tuple]:
    """Of one chunk: a row of its documents with the tokens that ``HOT`` of them hold and those
    tokens' documents, and for each bucket a row of its other tokens with their documents and
    of the hot tokens with their counts.

    However many the buckets are, a token takes about 8 bytes and a document 40.
    """
    buckets = 1 << bits
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    digest = np.zeros((len(sets), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
        digest[full, 0] = np.add.reduceat(_mix(tokens ^ _U(0x5851F42D4C957F2D)), at)
        digest[full, 1] = np.add.reduceat(_mix(tokens + _U(0x14057B7EF767814F)), at)
    order = np.argsort(tokens)
    tokens, doc = tokens[order], np.repeat(np.arange(len(sets)).astype(np.uint16), n)[order]
    firsts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
    times = np.diff(np.append(firsts, len(tokens)))
    hot = times >= HOT
    held, counts, often = tokens[firsts[hot]], times[hot].astype(np.uint32), np.repeat(hot, times)
    meta = _blob(np.array(ids, np.int64)) + _blob(n) + _blob(np.array(marks, np.int64)) + _blob(digest)
    rows = [(buckets + part, part, meta, _blob(counts), _blob(doc[often]), b"")]
    single, owner = tokens[~often], doc[~often]
    # both are sorted, so each bucket is a slice of either
    of_single, of_held = single >> _U(64 - bits), held >> _U(64 - bits)
    used = np.unique(np.concatenate([of_single, of_held]))
    ends = [np.searchsorted(x, used, side) for x in (of_single, of_held) for side in ("left", "right")]
    for b, s, e, x, y in zip(used.tolist(), *ends, strict=True):
        rows.append((b, part, _blob(owner[s:e]), packed(single[s:e]), packed(held[x:y]), _blob(counts[x:y])))
    return rows


def counted_rows(t: pa.Table) -> list[tuple]:
    """Of one bucket: for each part, names and frequencies of its tokens that several documents hold,
    with the documents of those that were dealt one by one, and then of its hot tokens.

    A name is the token's place among the bucket's; frequencies stop at 16 bits, as only
    an order that all documents agree on matters.
    """
    bucket, parts = t.column("bucket")[0].as_py(), t.column("part").to_pylist()
    owners = [np.frombuffer(x.as_py(), np.uint16) for x in t.column("docs")]
    single = [unpacked(x.as_py()) for x in t.column("tokens")]
    held = [unpacked(x.as_py()) for x in t.column("again")]
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in t.column("df")]
    past = sum(map(len, single))
    _, name = np.unique(np.concatenate([*single, *held]), return_inverse=True)
    df = np.bincount(name, weights=np.concatenate([np.ones(past, np.int64), *counts]))
    df, name = np.minimum(df, 2**16 - 1).astype(np.uint16)[name], name.astype(np.uint32)
    rows, at = [], 0
    for part, own, x, y in zip(parts, owners, single, held, strict=True):
        f, k = df[at : at + len(x)], name[at : at + len(x)]
        at += len(x)
        more = f > 1
        if more.any() or len(y):
            rows.append((bucket, part, _blob(own[more]), _blob(k[more]) + _blob(name[past : past + len(y)]), b"", _blob(f[more]) + _blob(df[past : past + len(y)])))
        past += len(y)
    return rows


def members(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), node (16-byte digest of the set), and for documents that may
    link their prefix and shared tokens; one row for each row of ``docs``."""
    slim = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)), F.xxhash64("text"), F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    # about a million tokens to a bucket, 256 buckets at least
    bits = max(8, min(24, (size // 6_000_000).bit_length()))
    buckets = 1 << bits

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, marks, sets, held = 0, [], [], [], 0
        base = TaskContext.get().partitionId() << 24

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, ids, marks, sets, held
            rows = dealt_rows(base + chunk, ids, marks, sets, bits)
            chunk, ids, marks, sets, held = chunk + 1, [], [], [], 0
            yield from _table(rows, _DEALT_NAMES, _DEALT_KINDS).to_batches(max_chunksize=64)

        for batch in batches:
            i = 0
            names, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            while i < batch.num_rows:
                some, total = [], 0
                while i < batch.num_rows and (not some or total < CHUNK_BYTES) and len(ids) < CHUNK_DOCS:
                    some.append(texts[i].as_py())
                    total += len(some[-1])
                    ids.append(names[i])
                    marks.append(hashes[i])
                    i += 1
                found = shingle_sets(some, k)
                sets += found
                held += sum(map(len, found))
                if held >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    def count(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() >= buckets:
            return t
        return _table(counted_rows(t), _DEALT_NAMES, _DEALT_KINDS)

    def gather(t: pa.Table) -> pa.Table:
        """Of one part: a row for each document."""
        own, tokens, often, dfs, hot = [np.empty(0, np.uint16)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint16)], [np.empty(0, np.uint16)]
        meta, owners, times = b"", np.empty(0, np.uint16), np.empty(0, np.uint32)
        for b, d, x, y, f in sorted(zip(*(t.column(c).to_pylist() for c in ("bucket", "docs", "tokens", "again", "df")), strict=True), key=lambda r: r[0]):
            if b >= buckets:
                meta, times, owners = d, np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint16)
                continue
            own.append(np.frombuffer(d, np.uint16))
            name, f = np.frombuffer(x, np.uint32).astype(np.int64) + (b << 32), np.frombuffer(f, np.uint16)
            k = len(own[-1])
            tokens.append(name[:k])
            dfs.append(f[:k])
            often.append(name[k:])  # in the order of the part's hot tokens
            hot.append(f[k:])
        doc = np.concatenate([*own, owners]).astype(np.int64)
        token = np.concatenate([*tokens, np.repeat(np.concatenate(often), times)])
        df = np.concatenate([*dfs, np.repeat(np.concatenate(hot), times)])
        size = len(meta) // 40
        ids, n, marks = np.frombuffer(meta, np.int64, 3 * size).reshape(3, size)
        digest = meta[24 * size :]
        order = np.lexsort((token, df, doc))
        doc, token = doc[order], token[order]
        ends = np.searchsorted(doc, np.arange(size), "right")
        begins = np.searchsorted(doc, np.arange(size), "left")
        slots = (ends - begins) - _needed(n, threshold) + 1
        rows = []
        for i in range(size):
            name = None if ids[i] == _LOW else int(ids[i])
            node = digest[16 * i : 16 * i + 16]
            if n[i] and slots[i] > 0 and ends[i] > begins[i]:
                own = token[begins[i] : ends[i]]
                rows.append((name, int(marks[i]), int(n[i]), node, own[: slots[i]], _blob(np.sort(own))))
            else:
                rows.append((name, int(marks[i]), int(n[i]), node, None, None))
        return _table(rows, ["doc_id", "t", "n", "node", "prefix", "shared"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()])

    dealt = slim.toDF("doc_id", "t", "text").mapInArrow(deal, _DEALT)
    return dealt.groupBy("bucket").applyInArrow(count, _DEALT).groupBy("part").applyInArrow(gather, _MEMBERS)


class _Forest:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        """(node, least node of its tree) of all nodes but those."""
        return [(x, self.find(x)) for x in list(self.up) if self.find(x) != x]


class Group:
    """One column block of the matrix: members' tokens by token, and their union."""

    def __init__(self, nodes: list[bytes], n: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.n = nodes, n
        tokens = np.concatenate(sets) if sets else np.empty(0, np.int64)
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.owner = own[order]
        self.union, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def links(self, n: int, tokens: np.ndarray, threshold: int) -> np.ndarray:
        """Places of the members that link with a query of ``n`` tokens of which these are shared."""
        if not len(self.union):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.union, tokens)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == tokens)]
        if 100 * len(at) < threshold * max(n, int(self.n.min())):
            return np.empty(0, np.int64)  # the bound: not opened
        sizes = self.last[at] - self.first[at]
        places = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        both = np.bincount(self.owner[places], minlength=len(self.nodes))
        return np.flatnonzero(100 * both >= threshold * (n + self.n - both))


def _group_of(t: pa.Table) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    node, n, shared = t.columns[-3:]
    return node.to_pylist(), n.to_numpy().astype(np.int64), [np.frombuffer(x.as_py(), np.int64) for x in shared]


def cells(pairs: DataFrame, placed: DataFrame, nodes: DataFrame, threshold: int, slice_size: int, inner: bool) -> DataFrame:
    """Links (a, b) between the nodes of the blocks that meet: those of ``pairs`` (query, group), and with
    ``inner`` each block with itself. What links in a cell leaves it as stars, a row for each node."""
    sizes = placed.groupBy(F.col("block").alias("query")).agg(F.count("*").alias("count"))
    # queries of each group, in slices of bounded size
    asked = pairs.join(sizes, "query").groupBy("group").agg(F.ceil(F.sum("count") / slice_size).cast("long").alias("slices"))
    met = pairs.join(asked, "group")
    content = dealt_join(placed, nodes.select("node", "n", "shared"), ["node"])
    queries = dealt_join(content.withColumnRenamed("block", "query"), met, ["query"])
    queries = queries.select("group", F.pmod(F.xxhash64("node"), F.col("slices")).alias("slice"), "node", "n", "shared")
    columns = dealt_join(content, asked.withColumnRenamed("group", "block"), ["block"], "left" if inner else "inner")
    columns = columns.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1).cast("long")) - 1)).alias("slice"), "node", "n", "shared")
    columns = columns.toDF("block", "part", "member", "size", "tokens")  # names of their own, as both sides come from content

    def meet(q: pa.Table, g: pa.Table) -> pa.Table:
        names, sizes, sets = _group_of(g)
        forest = _Forest()
        group = Group(names, sizes, sets)
        own = inner and g.num_rows > 1 and g.column("part")[0].as_py() == 0
        asking = [*zip(names, sizes, sets, strict=True)] if own else []
        for node, n, tokens in [*asking, *zip(*_group_of(q), strict=True)]:
            for i in group.links(int(n), tokens, threshold):
                forest.join(node, names[i])
        return _table(forest.stars(), ["a", "b"], [pa.binary(), pa.binary()])

    return queries.groupBy("group", "slice").cogroup(columns.groupBy("block", "part")).applyInArrow(meet, "a binary, b binary")


def representative_pairs(matrix: DataFrame) -> DataFrame:
    """(query, group): each block of ``matrix`` (token, block) with the least block of each of its tokens."""
    least = matrix.groupBy("token").agg(F.min("block").alias("group"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = dealt_join(matrix, least, ["token"]).select(F.col("block").alias("query"), "group")
    return pairs.where("query != group").distinct()


def open_pairs(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(query, group): blocks that share a token across units and have not met.

    ``rows`` is (token, unit, super, block), where ``super`` is the unit for blocks of a large
    unit and the block for others; blocks of one ``super`` never meet.
    """
    still = rows.groupBy("token").agg((F.min("unit") != F.max("unit")).alias("open")).where("open").select("token")
    rows = checkpointed(dealt_join(rows, still, ["token"], "left_semi"))
    coarse = rows.select("token", "super").distinct()
    wide = dealt_join(coarse.toDF("token", "sa"), coarse.toDF("token", "sb"), ["token"]).where("sa < sb")
    fine = rows.select("token", "super", "block").distinct()
    wide = dealt_join(wide, fine.toDF("token", "sa", "query"), ["token", "sa"])
    wide = dealt_join(wide, fine.toDF("token", "sb", "group"), ["token", "sb"]).select("query", "group").distinct()
    done = met.select("query", "group").unionByName(met.select(F.col("group").alias("query"), F.col("query").alias("group")))
    return wide.join(done, ["query", "group"], "left_anti")


def linked_roots(found: DataFrame, threshold: int = THRESHOLD, group_size: int = GROUP_SIZE, slice_size: int = SLICE_SIZE) -> DataFrame:
    """(node, root) of the nodes of ``found`` (from members) that link with others, and maybe of others;
    nodes of one component, and only those, have the same root."""
    nodes = found.where("prefix is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("shared").alias("shared"))
    nodes = checkpointed(nodes)
    tokens = nodes.select("node", F.explode("prefix").alias("token"))
    again = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    tokens = checkpointed(dealt_join(tokens, again, ["token"], "left_semi"))
    rare = tokens.groupBy("node").agg(F.min(F.xxhash64("token")).alias("g"))
    sizes = rare.groupBy("g").agg(F.ceil(F.count("*") / group_size).alias("cuts"))
    placed = checkpointed(dealt_join(rare, sizes, ["g"]).select("node", F.xxhash64("g", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block")))
    met = checkpointed(representative_pairs(dealt_join(tokens, placed, ["node"]).select("token", "block").distinct()))
    roots = components(cells(met, placed, nodes, threshold, slice_size, True))

    large = roots.groupBy(F.col("root").alias("unit")).agg(F.ceil(F.count("*") / group_size).alias("cuts")).where("cuts > 1")
    units = dealt_join(placed, roots, ["node"], "left").select("node", "block", F.coalesce("root", "node").alias("unit"))
    units = dealt_join(units, large, ["unit"], "left")
    own, part = F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node"), F.col("cuts"))
    units = units.select("node", "unit", F.when(own, F.xxhash64("unit")).otherwise(F.col("block")).alias("super"), F.when(own, F.xxhash64("unit", part)).otherwise(F.col("block")).alias("block"))
    units = checkpointed(units)
    rest = checkpointed(open_pairs(dealt_join(tokens, units, ["node"]).select("token", "unit", "super", "block"), met))
    if rest.isEmpty():
        return roots
    more = checkpointed(cells(rest, units.select("node", "block"), nodes, threshold, slice_size, False))
    unit = units.select("node", "unit")
    across = dealt_join(dealt_join(more, unit.toDF("a", "u"), ["a"]), unit.toDF("b", "v"), ["b"]).where("u != v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    merged = components(across).toDF("unit", "top")
    return dealt_join(unit, merged, ["unit"], "left").select("node", F.coalesce("top", "unit").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node."""
    a, b = F.col("a"), F.col("b")
    cur = checkpointed(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def mark(edges: DataFrame) -> tuple:
        with shuffles_released(edges.sparkSession):
            return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()

    seen = mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = dealt_join(both, least, ["u"]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, least, ["u"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def jaccard_components(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, group_size: int = GROUP_SIZE, slice_size: int = SLICE_SIZE) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable) of each row of ``docs``."""
    found = checkpointed(members(docs.select("doc_id", "text"), k, threshold))
    roots = linked_roots(found, threshold, group_size, slice_size)
    named = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    linked = dealt_join(roots, named, ["node"])
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = dealt_join(linked, least, ["root"]).select("node", "least")
    names = named.join(linked, "node", "left").select("node", F.coalesce("least", "first").alias("component"))
    out = dealt_join(found.select("doc_id", "n", "node"), names, ["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = 5, threshold: int = 80, group_size: int = GROUP_SIZE, slice_size: int = SLICE_SIZE) -> DataFrame:
    """``docs`` with one row left of each component: that with its smallest doc_id, and
    among rows of that id the one whose text has the smallest hash.

    Rows without words stay; null ids come last. Of rows that repeat each other in both
    id and text one stays.
    """
    found = checkpointed(members(docs.select("doc_id", "text"), k, threshold))
    roots = linked_roots(found, threshold, group_size, slice_size)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(_LOW)).alias("d"), "t")
    by_node = found.where("n > 0").groupBy("node").agg(F.min(best).alias("best"))
    by_root = by_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    d, t, keys = fresh(docs, "__d"), fresh(docs, "__t"), ("d", "t")
    empty = found.where("n = 0").select(F.coalesce("doc_id", F.lit(_LOW)).alias("d"), "t", F.lit(True).alias("every")).distinct()
    kept = by_root.select("best.d", "best.t", F.lit(False).alias("every")).unionByName(empty)
    every, nth = fresh(docs, "__every"), fresh(docs, "__nth")
    wide = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW))).withColumn(t, F.xxhash64("text"))
    both = wide.join(kept.toDF(d, t, every), [d, t])
    # the join has dealt and sorted by these keys already
    numbered = both.withColumn(nth, F.row_number().over(Window.partitionBy(d, t).orderBy(d)))
    return numbered.where(F.col(every) | (F.col(nth) == 1)).select(*docs.columns)
