from __future__ import annotations

import hashlib
import random
import re
import tempfile
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from braidgraph.llm import decontaminate as D
from braidgraph.llm import group_join as G
from braidgraph.llm import pack_exact as P
from braidgraph.llm.language_id import identify
from braidgraph.llm.line_dedup import dedup_lines
from tests.llm.common import LONG, edge_docs, no_docs, rows

# ---- line dedup ----


def brute_lines(docs, least):
    """Text left of each (id, text) in order, by comparing all pairs of lines."""
    lines = [(d, i, x) for d, (_, t) in enumerate(docs) for i, x in enumerate(t.split("\n"))]
    words = lambda x: max(1, len(x.split()))
    gone = set()
    for a, (da, ia, _) in enumerate(lines):
        for db, ib, _ in lines[a + 1 :]:
            n = total = 0
            la, lb = docs[da][1].split("\n"), docs[db][1].split("\n")
            while ia + n < len(la) and ib + n < len(lb) and la[ia + n] == lb[ib + n]:
                total += words(la[ia + n])
                n += 1
            if total >= least:
                gone |= {(db, ib + j) for j in range(n)}
    return {docs[d][0]: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, (_, t) in enumerate(docs)}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    for least in (1, 4, 9):
        pool = ["a b", "c", "d e f", "g h i j", "k", "", "l m"]
        docs = [(i, "\n".join(rng.choice([*pool, f"own {i} {j}"]) for j in range(rng.randrange(1, 9)))) for i in range(30)]
        docs += [(30, docs[0][1]), (31, docs[0][1])]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["doc_id"]: r["text"] for r in rows(dedup_lines(df, least, drop_emptied=False))}
        assert got == brute_lines(docs, least)


def test_runs_are_whole(spark):
    from braidgraph.llm.line_dedup import doubled, later_runs, repeated_lines

    body = [f"line {i} of the passage" for i in range(100)]
    docs = [(0, "\n".join(body)), (1, "\n".join(["own start", *body, "own end"])), (2, "\n".join(["same line"] * 100)), (3, "\n".join([*body[40:70], "between", *body[:10]])), (4, "one\ntwo\nsame"), (5, "x\ntwo\nsame\none\ntwo")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["d"], r["start"], r["length"]) for r in later_runs(df).collect())
    assert got == [(1, 1, 100), (2, 1, 99), (3, 0, 30), (3, 31, 10)]
    sizes = {}
    for size, suffixes in doubled(repeated_lines(df), 4):
        sizes[size] = suffixes.count()
        # ranks follow the order of prefixes: one rank, one prefix
        seen = defaultdict(set)
        for r in suffixes.collect():
            seen[r["r"]].add(tuple(dict(docs)[r["d"]].split("\n")[r["pos"] : r["pos"] + size]))
        assert all(len(v) == 1 and len(next(iter(v))) == size for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
    assert list(sizes) == [1, 2, 3, 4, 8, 16, 32, 64]
    assert list(sizes.values()) == sorted(sizes.values(), reverse=True)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    got = rows(dedup_lines(docs, drop_emptied=False))
    assert len(got) == 11 and dedup_lines(docs).columns == docs.columns
    by = {r["n"]: r for r in got}
    assert by[0]["text"] is None and by[1]["text"] == "" and by[4]["text"] == LONG
    assert by[5]["text"] == by[6]["text"] != "" and by[7]["text"].strip() == ""  # copies of one id are one document
    assert by[7]["n_chars"] == len(by[7]["text"])
    assert dedup_lines(no_docs(spark)).count() == 0


# ---- decontamination ----


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, window):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins[tuple(w[s : s + n])].add(i)
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if own := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = ["A", "b", "c", "É", "7", "d'e"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randrange(0, 12))) for i in range(12)] + [(12, None), (None, say(5)), (3, say(6))]
    docs = [(i, say(rng.randrange(0, 40))) for i in range(60)] + [(60, None), (61, ""), (62, " ".join(t or "" for _, t in items))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (10, 1000):  # several slices of the benchmark, and one
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(D.contamination_report(d, b, 4, most))}
        assert got == brute_hits(docs, items, 4)
        clean = D.decontaminate(d, b, 4, 1.0, most)
        assert clean.columns == d.columns
        left = {r["doc_id"]: r["text"] for r in rows(clean)}
        assert len(left) == len(docs) and all(left[i] == t for i, t in docs if not brute_hits([(i, t)], items, 4)[i][4])
        assert not any(v[4] for v in brute_hits(list(left.items()), items, 4).values())
    half = {r["doc_id"] for r in rows(D.decontaminate(d, b, 4, 0.5))}
    assert 62 not in half and 60 in half and half < set(range(63))


def test_short_and_long_items():
    items = [(f"i{k}", [b"word"]) for k in range(3000)] + [("two", [b"a", b"word"]), ("long", [b"x%d" % k for k in range(50)])]
    a = D.Automaton(items, 10)
    spans, found = a.spans([b"word"] * 3000 + [b"b", b"a", b"word"] + [b"x%d" % k for k in range(5, 20)])
    assert {a.ids[n] for n in found} == {i for i, _ in items}
    assert max(map(len, a.short)) <= 9
    assert D.merged(spans) == [(0, 3000), (3001, 3018)]


def test_long_items_are_cut_for_slices(spark):
    long = [f"y{k % 70}" for k in range(200)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, "y1 y2")], "item_id long, text string")
    docs = [(0, " ".join(long[40:90])), (1, " ".join(long[95:105])), (2, "y1 y2 y9"), (3, "nothing")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(D.contamination_report(d, bench, 10, 25))}
    assert got == brute_hits(docs, [(1, " ".join(long)), (2, "y1 y2")], 10)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "the same line of seven words here and another line of some")], "item_id long, text string")
    got = rows(D.contamination_report(edge_docs(spark), bench))
    assert len(got) == 11 and sum(r["contaminated"] for r in got) == 3
    assert D.contamination_report(no_docs(spark), bench).count() == 0
    assert not any(r["contaminated"] for r in rows(D.contamination_report(edge_docs(spark), bench.where("false"))))
    assert D.decontaminate(edge_docs(spark), bench.where("false")).count() == 11


# ---- Jaccard join ----


def shingles(text, k):
    low = (text or "").translate({c: c + 32 for c in range(0x41, 0x5B)})
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(docs, k, t):
    sets = {i: shingles(x, k) for i, x in docs}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng):
    docs, n = [], 0
    for size in (3, 4, 5, 30, 60, 120):
        base = [f"v{rng.randrange(400)}" for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, size // 25))):
                w[rng.randrange(len(w))] = f"u{rng.randrange(9)}"
            docs.append((n, " ".join(w).upper() if n % 5 == 0 else "\t".join(w)))
            n += 1
    passage = " ".join(f"p{i}" for i in range(40))
    for _ in range(40):
        docs.append((n, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30)))))
        n += 1
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "é É"), (n + 4, "é É")]


def test_jaccard_components_equal_brute_force(spark):
    docs = near_copies(random.Random(6))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, node int").repartition(3)
    for k, t, size, cut in ((4, 85, 128, 2048), (5, 80, 3, 4)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(G.jaccard_components(df, k, t, size, cut))}
        assert got == brute_components(docs, k, t)
    kept = {r["doc_id"] for r in rows(G.keep_representatives(df))}
    want = brute_components(docs, 5, 80)
    assert kept == {i for i, (n, c) in want.items() if n == 0 or c == i}


def test_jaccard_edges(spark):
    docs = edge_docs(spark)
    got = rows(G.jaccard_components(docs))
    assert len(got) == 11 and sorted(r["component_id"] for r in got if r["doc_id"] in (5, 6)) == [5, 5, 5]
    assert G.jaccard_components(no_docs(spark)).count() == 0
    kept = rows(G.keep_representatives(docs))
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "2", "3", "None", "4", "5", "7", "8", "None"])
    assert G.keep_representatives(docs).columns == docs.columns and G.keep_representatives(no_docs(spark)).count() == 0


def test_chunks_do_not_change_sets(spark, monkeypatch):
    docs = near_copies(random.Random(8))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    want = brute_components(docs, 4, 85)
    monkeypatch.setattr(G, "CHUNK_TOKENS", 50)
    monkeypatch.setattr(G, "CHUNK_BYTES", 200)
    found = G.shingle_sets([(t or "").encode() for _, t in docs])
    assert [len(s) for s in found] == [want[i][0] for i, _ in docs]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(G.jaccard_components(df))} == want


def test_packed_hashes_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 500):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (G.unpacked(G.packed(x)) == x).all()
    x = np.array([0, 1, 2**64 - 1], np.uint64)
    assert (G.unpacked(G.packed(x)) == x).all() and len(G.packed(np.arange(100, dtype=np.uint64))) == 9 + 99


def test_dealt_bytes_do_not_grow_with_buckets():
    rng = random.Random(2)
    own = G.shingle_sets([" ".join(str(rng.randrange(10**6)) for _ in range(20)).encode() for _ in range(2000)] + [b""])
    hot = G.shingle_sets([b"a line that a third of all the texts of this corpus share"] * 700)
    sets, total = own + hot, sum(map(len, own)) + sum(map(len, hot))
    for bits in (8, 10, 13, 16):
        dealt = G.dealt_rows(0, list(range(2701)), [0] * 2701, sets, bits)
        # besides, a row starts with nine bytes
        assert sum(len(x) for r in dealt for x in r[2:]) <= 40 * 2701 + 9 * total + 9 * len(dealt)
        back, held = [], []
        for _, _, ds, ts, ys, cs in dealt[1:]:
            back += [(int(d), int(t)) for d, t in zip(np.frombuffer(ds, "u2"), G.unpacked(ts), strict=True)]
            # a hot shingle is one entry of its bucket
            assert all(c == 700 for c in np.frombuffer(cs, "u4"))
            held += G.unpacked(ys).tolist()
        assert held == sorted(hot[0].tolist())
        docs, times = np.frombuffer(dealt[0][4], "u2"), np.frombuffer(dealt[0][3], "u4")
        back += [(int(d), int(t)) for d, t in zip(docs, np.repeat(np.array(held, np.uint64), times), strict=True)]
        assert sorted(back) == sorted((i, int(x)) for i, s in enumerate(sets) for x in s)


def test_counts_add_up_over_chunks():
    rng = random.Random(5)
    sets = G.shingle_sets([" ".join(str(int(30 * rng.random() ** 3)) for _ in range(12)).encode() for _ in range(300)], 2)
    want = defaultdict(int)
    for s in sets:
        for x in s:
            want[int(x)] += 1
    buckets = defaultdict(list)
    for k in range(0, 300, 40):
        chunk = sets[k : k + 40]
        for r in G.dealt_rows(k, list(range(len(chunk))), [0] * len(chunk), chunk, 3)[1:]:
            buckets[r[0]].append(r)
    got, hot = defaultdict(set), 0
    for b in sorted(buckets):
        # names stand for the bucket's tokens in order
        tokens = sorted(x for x in want if x >> 61 == b)
        for _, part, ds, names, _, fs in G.counted_rows(G._table(buckets[b], G._DEALT_NAMES, G._DEALT_KINDS)):
            for x, f in zip(np.frombuffer(names, "u4"), np.frombuffer(fs, "u2"), strict=True):
                got[tokens[x]].add(int(f))
            hot += len(names) // 4 - len(ds) // 2
    assert hot > 0 and dict(got) == {x: {n} for x, n in want.items() if n > 1}


def cluster(rng, size, m, first):
    """``m`` different near copies of a text of ``size`` words, each with a word of its own changed."""
    base = [f"c{first}x{j}" for j in range(size)]
    out = []
    for i in range(m):
        w = list(base)
        w[rng.randrange(size)] = f"own{rng.randrange(m // 3)}"
        out.append((first + i, " ".join(w)))
    return out


def test_cells_of_a_cluster_grow_in_proportion(spark, monkeypatch):
    seen = {}
    for m in (300, 600):
        rng = random.Random(3)
        docs = cluster(rng, 120, m, 0) + [(10_000 + i, f"a text of its own number {i} and nothing else in it at all") for i in range(2 * m)]
        counted = []
        real = G.cells

        def spy(pairs, *rest):
            counted.append(pairs.count())
            return real(pairs, *rest)

        monkeypatch.setattr(G, "cells", spy)
        got = {r["doc_id"]: r["component_id"] for r in rows(G.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), group_size=8, slice_size=16))}
        monkeypatch.setattr(G, "cells", real)
        assert {got[i] for i in range(m)} == {0}
        seen[m] = sum(counted)
    # all pairs of a cluster's groups would be (m / 8)^2 / 2
    assert all(n <= 4 * m / 8 for m, n in seen.items())


def test_chunks_of_few_documents_do_not_change_sets(spark, monkeypatch):
    docs = near_copies(random.Random(9)) + [(10_000 + i, "") for i in range(20)]
    want = brute_components(docs, 4, 85)
    monkeypatch.setattr(G, "CHUNK_DOCS", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert max(len(r["d"]) for r in rows(G.members(df).groupBy("node").agg(F.collect_list("doc_id").alias("d")))) >= 20
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(G.jaccard_components(df))} == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    key = lambda i: i.to_bytes(16, "big")
    edges = spark.createDataFrame([(key(a), key(b)) for a, b in zip(order, order[1:], strict=False)] + [(key(900), key(901))], "a binary, b binary")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in rows(G.components(edges))}
    assert got == {**dict.fromkeys(range(n), 0), 900: 900, 901: 900}


# ---- packing ----


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = P.default_vocabulary()
    tok = Tokenizer.from_file(path)  # untouched
    docs = [(i, t) for i, t in enumerate([None, "", "a", "<|endoftext|> x 　 y  \n\n z", "It's 12 o'clock—ÀÉ 漢字 🙂‍🙂", "\x00\x1f\x85", LONG[:9000], "don'T we'LL ", "   lead", "x" * 5000])]
    got = {(r["doc_id"], r["piece"]): r for r in rows(P.pack(spark.createDataFrame(docs, "doc_id long, text string")))}
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(P.cuts(len(ids), 1024)):
            r = got.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
    assert not got


def test_added_tokens_take_their_ids(spark):
    from tokenizers import Tokenizer

    path = P.default_vocabulary()
    tok = Tokenizer.from_file(path)
    docs = [(i, t) for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "it's\n <|endoftext|>\n"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in docs}
    assert ids[0] == [64, 220, 50256, 275]
    assert {r["doc_id"]: list(r["ids"]) for r in rows(P.pieces_of(df, path, with_ids=True, specials=True))} == {i: [*x, 2] for i, x in ids.items()}
    with tempfile.TemporaryDirectory() as folder:
        df.write.parquet(f"{folder}/documents.parquet")
        import __spark_entry__ as E

        crc = {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in ids.items()}
        assert {r["doc_id"]: r["ids_crc32"] for r in rows(E.queries()["op10_pack"](spark, folder))} == crc
        assert {r["doc_id"]: r["ids_crc32"] for r in rows(dict(E.corpus_pipeline.STAGES)["packing"](spark, df, folder))} == crc


def check_plan(hist, capacity):
    p = P.plan(hist, capacity)
    used = defaultdict(int)
    for pattern, n in p:
        assert n > 0 and sum(pattern) <= capacity
        for x in pattern:
            used[x] += n
    assert dict(used) == hist
    return sum(n for _, n in p)


def test_plans_use_every_piece_once():
    rng = random.Random(3)
    for capacity in (10, 64, 1024):
        for _ in range(20):
            hist = {rng.randrange(1, capacity + 1): rng.randrange(1, 50) for _ in range(rng.randrange(0, 60))}
            least = -(-sum(n * c for n, c in hist.items()) // capacity)
            assert least <= check_plan(hist, capacity)
    assert check_plan({600: 5}, 1024) == 5 and check_plan({512: 4}, 1024) == 2 and check_plan({256: 8, 1: 3}, 1024) == 3
    assert check_plan({500: 3, 300: 3, 200: 3, 24: 3}, 1024) == 3


def best_fit_decreasing(hist, capacity):
    """Number of sequences, piece by piece."""
    rooms = defaultdict(int)
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            room = min((r for r, c in rooms.items() if c and r >= n), default=None)
            if room is not None:
                rooms[room] -= 1
            rooms[(capacity if room is None else room) - n] += 1
    return sum(rooms.values())


def test_plans_are_never_worse_than_best_fit():
    rng = random.Random(11)
    better = 0
    for k in range(200):
        capacity = (48, 100, 256)[k % 3]
        low, high = sorted((rng.randrange(1, capacity), rng.randrange(1, capacity)))
        hist = defaultdict(int)
        for _ in range(rng.randrange(1, 300)):
            hist[rng.randrange(low, high + 1)] += rng.randrange(1, 4)
        plain, got = best_fit_decreasing(hist, capacity), check_plan(dict(hist), capacity)
        assert got <= plain
        better += got < plain
    assert better > 20


def test_many_copies_of_a_row_are_ranked_apart(spark):
    docs = spark.createDataFrame([(7, "one text of a few words")] * 900 + [(8, "another")], "doc_id long, text string")
    got = rows(P.pack(docs))
    assert len(got) == 901 and len({(r["sequence_id"], r["offset"]) for r in got}) == 901


def test_packing_is_tight_and_gapless(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = rows(P.pack(docs))
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(held) <= 1.02 * total / 1024 + 2


def test_packing_edges(spark):
    got = rows(P.pack(edge_docs(spark)))
    assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, None} and sum(r["piece"] == 0 for r in got) == 11
    assert P.pack(no_docs(spark)).count() == 0
    ids = P.pieces_of(edge_docs(spark), P.default_vocabulary(), with_ids=True).where("doc_id = 2").collect()
    assert [list(r["ids"]) for r in ids] == [[2]]


# ---- the pipeline ----


def test_pipeline_stages(spark, data, tmp_path):
    import corpus_pipeline as C

    docs = first = spark.read.parquet(f"{data}/documents.parquet")
    held = []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs)
        if k < 4:
            assert docs.columns == first.columns
    every = {r["doc_id"]: r["text"] for r in first.collect()}
    judged = {r["doc_id"]: r for r in identify(first).collect()}
    assert {i for i, r in judged.items() if r["lang_pred"] == "und"} == {i for i, t in every.items() if not t or not any(map(str.isalpha, t))}
    assert set(held[0]) == {i for i, r in judged.items() if r["score"] >= 0.5} and len(held[0]) >= 0.95 * len(every)
    lines = [(i, t) for i, t in sorted(held[0].items())]
    want = brute_by_line(lines, 4)
    assert held[1] == {i: t for i, t in want.items() if t is not None}
    same = brute_components(sorted(held[1].items()), 5, 80)
    assert set(held[2]) == {i for i, (n, c) in same.items() if n == 0 or c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not any(v[4] for v in brute_hits(list(held[3].items()), items, 10).values())
    clean = {i for i, v in brute_hits(list(held[2].items()), items, 10).items() if not v[4]}
    assert all(held[3][i] == held[2][i] for i in clean)
    assert {r["doc_id"] for r in held[4].select("doc_id").distinct().collect()} == set(held[3])
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in held[4].collect())
    assert C.run(spark, data).count() == held[4].count()


def brute_by_line(docs, least):
    """As brute_lines, for more documents: equal lines only are compared. None if nothing is left."""
    cut = [t.split("\n") for _, t in docs]
    where = defaultdict(list)
    gone = set()
    for d, own in enumerate(cut):
        for i, x in enumerate(own):
            for a, j in where[x]:
                n = total = 0
                while j + n < len(cut[a]) and i + n < len(own) and cut[a][j + n] == own[i + n]:
                    total += max(1, len(own[i + n].split()))
                    n += 1
                if total >= least:
                    gone |= {(d, i + m) for m in range(n)}
            where[x].append((d, i))
    left = {docs[d][0]: [x for i, x in enumerate(own) if (d, i) not in gone] for d, own in enumerate(cut)}
    return {i: "\n".join(x) if x else None for i, x in left.items()}


def test_lines_of_all_kinds_count_as_the_reader_counts(spark):
    got = rows(dedup_lines(spark.createDataFrame([(1, "a b c d\r\nx"), (2, "a b c d\r\ny"), (3, "a b c d\ny")], "doc_id long, text string")))
    assert {r["doc_id"]: r["text"] for r in got} == {1: "a b c d\r\nx", 2: "y", 3: "a b c d\ny"}


def test_queries_are_registered(spark):
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries())
    assert F is not None


def test_texts_that_the_fast_tokenizer_refuses(spark):
    """Very long runs of blanks, and characters that Unicode versions class differently."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.default_vocabulary())
    texts = [f"a{c * 1_000_000}b" for c in (" ", "\n", "\t", " \n")] + [" " * 1_000_000, "a\u0558b \ua7ce \u0cdc x", "x\U00030001\U00031400z"]
    encode = P.encoder(P.default_vocabulary())
    for text in texts:
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids, text[:5]
    got = rows(P.pack(spark.createDataFrame([(1, texts[0]), (2, "short")], "doc_id long, text string")))
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == len(encode(texts[0])) + 1


def test_the_release_of_shuffles_leaves_no_setting(spark):
    from braidgraph.llm.common import shuffles_released

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with shuffles_released(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before
