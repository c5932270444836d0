from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidgraph.llm import warc_index as W
from braidgraph.llm.shard_ranges import shard
from tests.llm.common import LONG, edge_docs, no_docs, rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(sorted), max_size=9))
def test_loser_tree_merges(runs):
    got = list(W.LoserTree([iter([(x,) for x in r]) for r in runs], lambda r: r))
    assert got == sorted((x,) for r in runs for x in r)


def test_url_keys():
    assert W.url_key("https://www.Example.COM:80/A/b?q=1#top") == "com,example)/a/b?q=1"
    assert W.url_key("http://example.com") == "com,example)/" and W.url_key("No url") == "no url"


def test_archives_read_back(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n" * 60
    pages = [(1, "http://b.example/x", big), (2, "http://a.example/x", big), (3, "http://a.example/x", big), (4, "http://a.example/x", "tiny"), (5, None, "tiny"), (6, "u\r\nv", None), (7, "http://a.example/y", ""), (8, "http://c.example/", LONG), (3, "http://a.example/x", big), (None, "http://d.example/", big)]
    df = spark.createDataFrame([(i, u, h, 0, "x") for i, u, h in pages], "page_id long, url string, html string, digest int, size string")
    W.write_archives(df, str(tmp_path / "w"), max_records=3)
    files = {f.name: f.read_bytes() for f in (tmp_path / "w").glob("part-*")}
    ids = [h["warc-record-id"] for data in files.values() for h, _, _ in W.records(data)]
    assert len(ids) == 10 and len(set(ids)) == 9  # one row comes twice
    for r in rows(W.read_archives(spark, str(tmp_path / "w"))):
        # a reader that seeks to the offset finds the record
        h, block, _ = next(W.records(files[r["run"]][r["offset"] :]))
        assert h["warc-target-uri"] == r["url"] and (r["record_type"] == "revisit" or hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == r["payload_digest"])
        assert gzip.decompress(files[r["run"]][r["offset"] :]).startswith(b"WARC/1.1\r\n")
    got = sorted(rows(W.merge_index(W.read_archives(spark, str(tmp_path / "w")))), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(10))
    keys = [(r["url_key"], r["captured"]) for r in got]
    assert keys == sorted(keys)
    by = {(r["page_id"], r["url"]): r for r in got}
    for i, u, h in pages:
        raw = (h or "").encode()
        r = by[i, (u or "").replace("\r", "%0D").replace("\n", "%0A")]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha1(raw).hexdigest()
        again = h == big and i != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))


def test_ranges_and_fan_in_do_not_change_the_order(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    pages = [(i % 180, f"http://h{rng.randrange(3)}.example/{rng.randrange(4)}" if i % 3 else "http://hot.example/", f"page {rng.randrange(50)}") for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    W.write_archives(df, str(tmp_path / "w"), max_records=7)
    runs = W.read_archives(spark, str(tmp_path / "w"))
    key = lambda r: (r["url_key"], r["captured"], r["page_id"], r["payload_digest"])
    want = sorted(key(r) for r in rows(runs))
    for slice_rows, range_rows, fan_in in ((256, 20_000, 256), (3, 20, 2)):
        monkeypatch.setattr(W, "SLICE", slice_rows)
        got = sorted(rows(W.merge_index(runs, range_rows, fan_in)), key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(400))
        assert [key(r)[:3] for r in got] == [k[:3] for k in want] and sorted(map(key, got)) == want
    many = W.checkpointed(runs)
    most = W.boundaries(many, 400, 20)
    assert len(most) >= 12  # the hot url is cut at its captures


def test_long_records_are_several_members():
    record = b"WARC/1.1\r\nContent-Length: 5000\r\n\r\n" + bytes(range(250)) * 20 + b"\r\n\r\n"
    data = (W.member(record, 700) + b"\0") * 2
    got = list(W.records(data))
    assert [len(block) for _, block, _ in got] == [5000, 5000] and got[1][2] == len(data) // 2
    assert gzip.decompress(data) == record * 2
    for cut in (3, len(data) // 2 + 30, len(data) - 9):
        with pytest.raises(ValueError):
            list(W.records(data[:cut]))


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_archives(df, str(tmp_path / "w"))
    assert W.merge_index(W.read_archives(spark, str(tmp_path / "w"))).count() == 0


def check_shards(got, shards):
    for s in range(shards):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    return sizes


def test_shards_are_even_though_a_text_is_hot(spark):
    rng = random.Random(5)
    texts = ["hot text " * 4 if i % 3 == 0 else None if i % 50 == 1 else "é" * rng.randrange(0, 90) for i in range(3000)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    got = rows(shard(df))
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    check_shards(got, 24)
    assert sorted(map(str, rows(shard(df.repartition(7))))) == sorted(map(str, got))  # whatever the partitions


def brute_shards(docs, shards):
    """Rows of (id, text) by checksum and id, cut where their middle byte falls among all bytes."""
    order = sorted((zlib.crc32((t or "").encode()), -(2**63) if i is None else i, len((t or "").encode()) + 8, i) for i, t in docs)
    total, seen, out, slots = sum(x[2] for x in order), 0, [], {}
    for crc, _, size, i in order:
        own = min(shards - 1, (2 * seen + size) * shards // (2 * total))
        out.append((i, size, crc, "bytes", own, slots.get(own, 0), None))
        slots[own] = slots.get(own, 0) + 1
        seen += size
    return sorted(out, key=str)


def test_shards_equal_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, "x" * rng.randrange(200)) for i in range(400)] + [(7, "the same row")] * 300 + [(i % 3, None) for i in range(50)] + [(None, "no id"), (None, "no id"), (9, "y" * 5000)]
    for shards in (1, 5, 24):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
        got = [tuple(r.values()) for r in rows(shard(df, shards, samples=4))]
        assert sorted(got, key=str) == brute_shards(docs, shards)


def test_a_key_of_many_rows_is_cut(spark):
    from braidgraph.llm import shard_ranges as R

    keys = [[np.array(c, np.int64) for c in zip(*k, strict=True)] for k in ([(1, 1, 0), (2, 5, 3), (2, 5, 9), (2, 6, 0), (3, 0, 0)], [(2, 5, 4), (2, 6, 0)])]
    assert R._locate(*keys).tolist() == [0, 0, 1, 2, 2]
    df = spark.createDataFrame([(1, "x")] * 4000, "doc_id long, text string").repartition(8)
    seen = []
    real = R._ranged
    R._ranged = lambda k, s: seen.append(real(k, s)) or seen[-1]
    try:
        assert shard(df).count() == 4000
    finally:
        R._ranged = real
    most = max(r["count"] for r in seen[-1].groupBy("range").count().collect())
    assert most <= 400  # 96 ranges of one and the same key


def test_shard_edges(spark):
    got = rows(shard(edge_docs(spark)))
    assert len(got) == 11 and all(0 <= r["shard"] < 24 for r in got)
    check = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in {r["shard"] for r in got}}
    assert all(v == list(range(len(v))) for v in check.values())
    assert shard(no_docs(spark)).count() == 0
    same = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    assert len({(r["shard"], r["slot"]) for r in rows(shard(same))}) == 500
