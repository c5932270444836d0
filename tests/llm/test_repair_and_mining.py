from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph.llm import bpe_lexicon as B
from braidgraph.llm import conversation_repair as C
from braidgraph.llm import hard_negatives as H
from tests.llm.common import edge_docs, no_docs, rows

# ---- BPE lexicon ----


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(B.default_vocabulary())


ODD = ["", " ", "   ", "a<|endoftext|>b", "<|endoftext|><|endoftext|> x", "don't I'LL we're 'tis", "a\x00b\x1c\x85　 c", "ֈ࢏ẞ \U0001f600‍\U0001f600", "x" * 3000, "ab" * 900, " " * 2000 + "z", "\n \n" * 700 + "q", "ẹ́ क्ष", "１２３ ²³ ½ Ⅷ"]


def test_ids_are_those_of_the_library(library):
    vocab, rnd = B.Vocabulary(B.default_vocabulary()), random.Random(7)
    some = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0x80, 0x800), lambda: rnd.randrange(0x3000, 0x9FFF), lambda: rnd.randrange(0x1F300, 0x1F700), lambda: 32, lambda: 10]
    texts = ODD + ["".join(chr(rnd.choice(some)()) for _ in range(80)) for _ in range(200)]
    words = Counter(w for t in texts for part in vocab.split(t) for w in part if isinstance(w, str))
    for share in (0, 2, 1):  # none, half, all of the words in the lexicon
        own = sorted(w.encode() for i, w in enumerate(words) if share and i % share == 0 and len(w.encode()) <= B.LONGEST)
        pool, counts = vocab.merge(own)
        ends = np.cumsum(counts)
        entries = [(w, tuple(pool[e - n : e].tolist())) for w, e, n in zip(own, ends, counts, strict=True)]
        lexicon = B.Lexicon(B.compiled(entries))
        for w, ids in entries[:500]:
            got, n = lexicon.lookup([w, w + b"\xff", b""])
            assert got.tolist() == list(ids) and n.tolist() == [len(ids), -1, -1]
        for text, ids in zip(texts, B.ids_of(texts, vocab, lexicon), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_the_automaton_is_minimal():
    words = sorted({bytes(p + s) for p in (b"un", b"re", b"de", b"") for s in (b"tie", b"ties", b"tied", b"do", b"doing")})
    lexicon = B.Lexicon(B.compiled([(w, ()) for w in words]))
    # right languages of all prefixes are as many as there are states
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    assert lexicon.states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_blocks_and_long_words(library, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_WORDS", 7)
    monkeypatch.setattr(B, "BLOCK_CHARS", 40)
    vocab, lexicon = B.Vocabulary(B.default_vocabulary()), B.Lexicon(B.compiled([]))
    texts = [*ODD, "some words in a text that is longer than a block of words is, and goes on " * 5]
    for text, ids in zip(texts, B.ids_of(texts, vocab, lexicon), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(library):
    rnd, text_of = random.Random(3), B.decoder(B.default_vocabulary())
    for _ in range(300):
        ids = [rnd.choice((rnd.randrange(50_257), rnd.randrange(256), 50_256)) for _ in range(rnd.randrange(12))]
        assert text_of(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert text_of(np.array([50_300, 64], "<u4").tobytes()) == library.decode([64], skip_special_tokens=False)


def test_encode_and_decode_round_trip(spark, library):
    docs = edge_docs(spark)
    for size in (0, 5, B.LEXICON):
        got = rows(B.decode(B.encode(docs, size=size)))
        texts = sorted(r.text or "" for r in docs.collect())
        assert sorted(r["text"] for r in got) == texts
        assert sorted(bytes(r["ids"]) for r in got) == sorted(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)
    assert rows(B.decode(B.encode(no_docs(spark)))) == []


def test_lexicon_words_are_the_most_frequent(spark):
    docs = spark.createDataFrame([(1, " the cat" * 40 + " sat" * 9 + " on" * 9 + " once"), (2, " the cat" * 3)], "doc_id long, text string")
    words = lambda n: {w for w, _ in B.lexicon_entries(docs, B.default_vocabulary(), n)}
    assert words(100) == {b" the", b" cat", b" sat", b" on"}
    assert words(3) == {b" the", b" cat"} and words(1) == set()


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        B.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# ---- hard negatives ----


def brute_negatives(data, asks, k=5, m=5, low=80, high=100):
    usable = [(i, e, x) for i, e, x in data if i is not None and e is not None and x is not None and all(v is not None and np.isfinite(v) for v in e)]
    whole = [(i, [int(np.floor(256.0 * v)) for v in e], x) for i, e, x in usable]
    clip = lambda v: max(-(2**63), min(2**63 - 1, v))
    whole = [(i, [clip(v) for v in e], x) for i, e, x in whole]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, e, x in {(i, tuple(e), x) for i, e, x in whole if asks(i)}:
        scored = sorted((-dot(e, f), j, y) for j, f, y in whole if j != i)
        for s, j, _ in [r for r in scored if r[2] == x][:k]:
            fits = [(t, n) for t, n, y in scored if y != x and low * -s <= 100 * -t <= high * -s][:m]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)]
    return sorted(out)


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")


def mined(df, **how):
    got = H.mine(df, F.col("vec_id") % 10 == 0, **how)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("kind", ["spread", "clusters", "few values", "one direction"])
def test_hard_negatives_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, d = 300, 24
    x = rng.normal(size=(n, d))
    if kind == "clusters":
        x = rng.normal(size=(6, d))[rng.integers(0, 6, n)] + 0.05 * x
    elif kind == "few values":
        x = rng.integers(0, 2, (n, d)) / 256.0  # many ties
    elif kind == "one direction":
        x = np.outer(rng.normal(size=n) + 3, rng.normal(size=d)) + 0.01 * x
    data = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(x)]
    want = brute_negatives(data, lambda i: i % 10 == 0)
    assert want and mined(vectors(spark, data)) == want
    assert mined(vectors(spark, data), slice_size=7, block=40) == want


def test_hard_negatives_at_the_edges(spark):
    v = [0.5, -0.25, 1.0]
    data = [(0, v, 1), (0, v, 1), (1, v, 1), (2, v, 2), (2, v, 2), (3, [0.5, -0.25], 2), (4, None, 1), (5, [None, 1.0, 1.0], 1), (6, [float("nan"), 0.0, 0.0], 2), (7, v, None), (None, v, 2), (10, [-1.0, 0.0, 0.0], 3), (20, [], 1), (30, [1e6, 1e7, -1e7], 1), (31, [1e6, 1e7, -1e7], 2), (32, [1e6, 1e7, -1e7], 1)]
    assert mined(vectors(spark, data)) == brute_negatives(data, lambda i: i % 10 == 0)
    assert mined(vectors(spark, data[:0])) == []
    assert mined(vectors(spark, [(1, v, 1)])) == []
    big = [(i, [1e15 + i, -1e15], i % 2) for i in range(12)]  # beyond 64 bits: scores are clipped
    assert mined(vectors(spark, big)) == brute_negatives(big, lambda i: i % 10 == 0)


def test_bounds_discard_most_work_where_vectors_have_structure(spark):
    rng = np.random.default_rng(5)
    n, d = 4000, 64
    scale = 0.9 ** np.arange(d)  # more length in some directions than in others
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = (rng.normal(size=(n, d)) * scale) @ turn
    df = vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])  # one label, so that all pairs count
    r = H.mine(df, F.col("vec_id") % 10 == 0, report=True).agg(F.sum("pairs").alias("p"), F.sum("work").alias("w")).first()
    assert r.w < 0.2 * r.p * d, r.w / (r.p * d)


def test_rotation_keeps_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (200, 16))
    q = H.rotation(x, 16)
    assert np.allclose(q.T @ q, np.eye(16), atol=1e-12)
    assert np.allclose((x @ q) @ (x @ q).T, x @ x.T)
    assert np.array_equal(H.rotation(x[:0], 4), np.eye(4))


# ---- conversation repair ----


def brute_damage(conv, turn, role, text):
    spaced = lambda x: " " if x is None else x
    kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
    role, text = spaced(role), spaced(text)
    if kind == 0:
        return []
    text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def brute_repair(own):
    """own: (turn, role, text) in order. All edit sequences by their cost and then their initials."""
    seen, faults, blanks = set(), [], " \t\n\x0b\x0c\r"
    for _, role, text in own:
        body = text.strip(blanks)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last, inserted=0):
        """(cost, audit, lines) of the best from here."""
        found = []
        if i == len(own) and last in ("", "a"):
            found.append((0, "", ()))
        name = {"u": "user", "a": "assistant"}[after[last]]
        if inserted < 3:
            c, a, said = go(i, after[last], inserted + 1)
            found.append((c + 5, "I" + a, (f"{name}:", *said)))
        if i < len(own):
            _, role, text = own[i]
            c, a, said = go(i + 1, last)
            found.append((c + 2, "D" + a, said))
            if faults[i] not in (1, 2):
                cut = 5 if faults[i] == 3 else 0
                c, a, said = go(i + 1, after[last])
                found.append((c + 1 + cut, "R" + a, (f"{name}:{text}", *said)))
                x = role[:1]
                if x and (x == after[last] or x == "s" and last == ""):
                    c, a, said = go(i + 1, x)
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *said)))
        return min(found, key=lambda f: f[:2]) if found else (10**9, "", ())

    for i in range(len(own), 0, -20):  # from the back, so that no call goes deep
        for last in after:
            go(i, last)
    cost, audit, said = go(0, "")
    numbers = {t for t, _, _ in own if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def by_conversation(turns, damage=True):
    out = defaultdict(list)
    for conv, turn, role, text in turns:
        out[conv] += brute_damage(conv, turn, role, text) if damage else [(turn, role, text)]
    place = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {c: sorted(own, key=place) for c, own in out.items()}


SCHEMA = "conv_id long, turn long, role string, text string, copy int, later int, part int, named string"


def frame(spark, turns):
    return spark.createDataFrame([(*t, 1, 2, 3, "n") for t in turns], SCHEMA)


def report(spark, turns):
    got = C.repair_report(C.damaged(frame(spark, turns)), F.col("gone")).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def random_turns(seed, convs, most):
    rnd = random.Random(seed)
    roles, texts = ("system", "user", "assistant", "assistant", "user", "tool", "", None, "S"), ("Yes.", "No!", "what", "", " \n", "a.b", None, "fine. \t", "x?", "　")
    return [(c if c else None, rnd.choice((None, *range(most))), rnd.choice(roles), rnd.choice(texts)) for c in range(convs) for _ in range(rnd.randrange(1, most))]


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_brute_force(spark, seed):
    turns = random_turns(seed, 60, 12)
    assert report(spark, turns) == {c: brute_repair(tuple(own)) for c, own in by_conversation(turns).items()}


def test_a_conversation_over_many_parts(spark):
    """Most turns belong to one conversation, which spans all parts; texts repeat across them."""
    rnd = random.Random(4)
    turns = [(5, i if i % 50 else i - 1, rnd.choice(("user", "assistant", "assistant", "system", "tool")), rnd.choice(("Good.", f"Well {i}.", "no end", f"number {i}", ""))) for i in range(900)]
    turns += [(c, i, ("user", "assistant")[i % 2], f"{c} {i}.") for c in (1, 4, 6, 9) for i in range(4)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows_ = C.ordered(C.damaged(frame(spark, turns)), F.col("gone"))
        assert len(C.chained(rows_)) >= 8  # it is in most parts
        assert report(spark, turns) == {c: brute_repair(tuple(own)) for c, own in by_conversation(turns).items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repaired_turns_are_valid(spark):
    turns = [t for t in random_turns(11, 30, 10)]
    got = defaultdict(list)
    for r in C.repaired_turns(frame(spark, turns)).orderBy("part", "nth").collect():
        got[r.conv_id].append(r)
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    for c, own in by_conversation(spaced, damage=False).items():
        want = brute_repair(tuple(own))
        assert "".join(r.edit for r in got[c]) == want[6]
        said = [f"{r.role}:{r.text}" for r in got[c] if r.role is not None]
        assert hashlib.sha256("\n".join(said).encode()).hexdigest() == want[7]
        assert all((r.role is None) == (r.edit == "D") for r in got[c])


def test_repair_of_nothing_and_of_long_texts(spark):
    assert report(spark, []) == {}
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    whole = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 > 4)
    got = report(spark, [(3, dropped, "user", "Hello."), (7, whole, "assistant", "long " * 600_000)])
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[7] == (0, 0, 0, 1, 0, 2, "D", empty)
