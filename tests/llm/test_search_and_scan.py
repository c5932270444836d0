from __future__ import annotations

import base64
import hashlib
import json
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidgraph.llm import chat_format as C
from braidgraph.llm import language_id as L
from braidgraph.llm import secret_scan as S
from braidgraph.llm.pivot_search import evaluated_share, top_k
from tests.llm.common import LONG, edge_docs, no_docs, rows


def brute_top(vecs, ask, k):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in ok if ask(i)):
        found = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=False)), i) for i in ok if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(160)]
    vecs += [(200 + i, vecs[i][1]) for i in range(40)]  # ties
    vecs += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.0] * 8), (304, []), (305, [0.0] * 8), (310, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs], "vec_id long, embedding array<float>, score int, v int")
    for block in (16, 10_000):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(top_k(df, F.col("vec_id") % 10 == 0, k=5, block=block, pivots=6))}
        assert got == brute_top(vecs, lambda i: i % 10 == 0, 5)


def test_clustered_vectors_are_mostly_not_evaluated(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    vecs = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.2]) for i in range(2000)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    for block in (64, 16_384):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(top_k(df, F.col("vec_id") % 100 == 0, block=block))}
        assert got == brute_top(vecs, lambda i: i % 100 == 0, 5)
    assert evaluated_share(df, F.col("vec_id") % 100 == 0) < 0.3


def test_top_k_repeated_rows_and_large_values(spark):
    df = spark.createDataFrame([(0, [3e12]), (0, [3e12]), (1, [2e12]), (1, [2e12]), (2, [-1e12])], "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows(top_k(df, F.col("vec_id") == 0, k=5)))
    assert [x[1] for x in got] == [1, 1, 2] and got[0][2] == 2**63 - 1 and got[2][2] == -(2**63)
    assert top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


def brute_base(text):
    out = []
    for kind, pattern, least, flags in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)):
        for m in re.finditer(pattern, text, flags):
            if len(m[m.lastindex or 0]) >= least:
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end()))
    return sorted(out)


PARTS = st.sampled_from(["password", "Token", " = ", ": ", "api_key", "'", "AKIA", "ABCDEFGH0123", "deadbeef", "0123456789abcdef", " ", "é", "=", "abcdefghijkl", ".", "ſecret", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert sorted(S.base_spans(text)) == brute_base(text)


def der(*parts: bytes, tag=0x30) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(x: int) -> bytes:
    return der(x.to_bytes(x.bit_length() // 8 + 1, "big"), tag=2)


def field(b: bytes) -> bytes:
    return len(b).to_bytes(4, "big") + b


RNG = random.Random(17)
big = lambda bits: RNG.getrandbits(bits) | 1 << (bits - 1) | 1
P, Q = big(512), big(512)
RSA = der(*map(number, (0, P * Q, 65537, big(1000), P, Q, big(500), big(500), big(500))))
RSA_MORE = der(*map(number, (1, P * Q, 65537, big(1000), P, Q, big(500), big(500), big(500))), der(der(*map(number, (big(400), big(390), big(390))))))
DSA = der(*map(number, (0, big(1024), big(160), big(1000), big(1000), big(150))))
POINT = der(b"\0\4" + RNG.randbytes(64), tag=3)
CURVE = der(bytes.fromhex("2a8648ce3d030107"), tag=6)
EC = der(number(1), der(RNG.randbytes(32), tag=4), der(CURVE, tag=0xA0), der(POINT, tag=0xA1))
EC_BARE = der(number(1), der(RNG.randbytes(32), tag=4))
oid = lambda h, *more: der(der(bytes.fromhex(h), tag=6), *more)
NULL = der(tag=5)
OF_RSA, OF_EC, OF_DSA = oid("2a864886f70d010101", NULL), oid("2a8648ce3d0201", CURVE), oid("2a8648ce380401", der(*map(number, (big(1024), big(160), big(1000)))))
PKCS8 = [der(number(0), OF_RSA, der(RSA, tag=4)), der(number(0), OF_EC, der(EC, tag=4)), der(number(0), OF_DSA, der(number(big(150)), tag=4))]
PKCS8 += [der(number(0), oid(f"2b65{k}"), der(der(RNG.randbytes(32), tag=4), tag=4)) for k in ("6e", "70")]
PBES2 = oid("2a864886f70d01050d", der(oid("2a864886f70d01050c", der(der(RNG.randbytes(8), tag=4), number(2048))), oid("60864801650304012a", der(RNG.randbytes(16), tag=4))))
PBE12 = oid("2a864886f70d010c0103", der(der(RNG.randbytes(8), tag=4), number(2048)))
LOCKED = [der(PBES2, der(RNG.randbytes(64), tag=4)), der(PBE12, der(RNG.randbytes(320), tag=4))]
PRIVATE = [RSA, RSA_MORE, DSA, EC, EC_BARE, *PKCS8, *LOCKED]

NAME = der(der(oid("550403", der(b"a name", tag=12)), tag=0x31))
SPKI = der(OF_RSA, der(b"\0" + der(number(P * Q), number(65537)), tag=3))
CERT = der(der(der(number(2), tag=0xA0), number(7), OF_RSA, NAME, der(der(b"240101000000Z", tag=23), der(b"340101000000Z", tag=23)), NAME, SPKI), OF_RSA, der(b"\0" + RNG.randbytes(128), tag=3))
three = [der(*(der(RNG.randbytes(40), tag=2) for _ in range(3))) for _ in range(3)]
PUBLIC = [CERT, SPKI, der(OF_EC, POINT), der(number(P * Q), number(65537)), der(oid("2b6570")[2:], der(b"\0" + RNG.randbytes(32), tag=3)), *three, der(number(1), der(RNG.randbytes(9), tag=4)), der(number(0), oid("550403"), der(RSA, tag=4)), der(number(5), OF_RSA, der(RSA, tag=4)), der(number(0), OF_RSA, der(RNG.randbytes(300), tag=4)), der(NAME, der(RNG.randbytes(64), tag=4))]
BROKEN = [x for k in PRIVATE for x in (k[:-1], bytes([k[0]]) + bytes([k[1] ^ 1]) + k[2:])]
LONGER = [k + b"\0" for k in PRIVATE]  # wrapped, its first lines may be a whole key

ED = field(b"ssh-ed25519") + field(RNG.randbytes(32))
SSH_RSA = field(b"ssh-rsa") + field(b"\1\0\1") + field(b"\0" + RNG.randbytes(256))
NIST = field(b"ecdsa-sha2-nistp256") + field(b"nistp256") + field(b"\4" + RNG.randbytes(64))
DSS = field(b"ssh-dss") + b"".join(field(b"\0" + RNG.randbytes(n)) for n in (128, 20, 128, 128))
padded = lambda b: b + bytes(range(1, 1 + -len(b) % 8))
inner = lambda k, check=b"abcd" * 2: padded(check + k + field(RNG.randbytes(64)) + field(b"me@here"))
box = lambda *keys, cipher=b"none", kdf=b"none", options=b"", part=None: b"openssh-key-v1\0" + field(cipher) + field(kdf) + field(options) + len(keys).to_bytes(4, "big") + b"".join(map(field, keys)) + field(inner(keys[0]) if part is None else part)
CONTAINERS = [box(ED), box(SSH_RSA), box(NIST), box(ED, cipher=b"aes256-ctr", kdf=b"bcrypt", options=field(RNG.randbytes(16)) + b"\0\0\0\x10", part=RNG.randbytes(160))]
NO_CONTAINERS = [b"openssh-key-v1\0" + bytes(12) + RNG.randbytes(60), box(ED, part=RNG.randbytes(160)), box(ED, part=b""), box(ED, part=inner(ED)[:-3]), box(field(b"ssh-none") + ED), box(ED)[:-9], box(ED, kdf=b"bcrypt"), b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + bytes(4) + field(inner(ED)), b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + b"\xff" * 4 + field(inner(ED))]
NO_PUBLIC = [field(b"ssh-rsa") + field(b"\1\0\1") + field(RNG.randbytes(8)), field(b"ssh-ed25519") + field(RNG.randbytes(30)), field(b"ssh-what") + field(RNG.randbytes(32)), NIST[:-20], bytes(60)]

plain = lambda raw: base64.b64encode(raw).decode()
url = lambda raw: base64.urlsafe_b64encode(raw).decode().rstrip("=")
wrap = lambda size, eol: lambda raw: eol.join(re.findall(f".{{1,{size}}}", plain(raw)))
armour = lambda label: lambda raw: f"-----BEGIN {label}-----\n{wrap(64, chr(10))(raw)}\n-----END {label}-----"
BARE = [plain, url, wrap(64, "\n"), wrap(76, "\r\n"), wrap(48, "\n  ")]
AROUND = [("KEY=", "\n"), ("x/", " y"), ("a b ", ""), ("&k=", "&z=1"), ('"', '"'), ("", "\nthe next line of words"), ("é ", "=é")]


def labelled():
    """(sample, kind or None) of each structure in each form."""
    for raws, forms, kind in ((PRIVATE, [*BARE, bytes.hex], "der"), (PRIVATE, [armour("RSA PRIVATE KEY")], "pem"), (PUBLIC + BROKEN, [*BARE, bytes.hex, armour("CERTIFICATE"), armour("PRIVATE KEY")], None), (LONGER, [plain, url, bytes.hex], None), (CONTAINERS, [plain, wrap(70, "\n")], "ssh"), (CONTAINERS, [armour("OPENSSH PRIVATE KEY")], "pem"), (NO_CONTAINERS, [plain, wrap(70, "\n"), armour("OPENSSH PRIVATE KEY")], None), ([ED, SSH_RSA, NIST, DSS], [plain, wrap(72, "\n")], "sshpub"), (NO_PUBLIC, [plain, wrap(72, "\n")], None)):
        yield from ((form(raw), kind) for raw in raws for form in forms)


def test_labelled_structures():
    found = {True: 0, False: 0}
    for k, (sample, kind) in enumerate(labelled()):
        before, after = AROUND[k % len(AROUND)]
        got = [(s, S.KINDS[n], e) for s, n, e in S.confirmed_spans(before + sample + after)]
        end = len(before) + len(sample)
        if before + sample + after and kind == "der" and after.startswith("=") and -len(sample.replace("\n", "").replace("\r", "").replace(" ", "")) % 4:
            got = [(s, n, min(e, end)) for s, n, e in got]  # a sign of equality after a run is read as its padding
        assert got == ([(len(before), kind, end)] if kind else []), (k, kind, sample)
        found[kind is not None] += 1
    assert min(found.values()) >= 60


def test_runs_inside_longer_runs_and_texts():
    key = plain(RSA).rstrip("=")
    assert S.confirmed_spans("Q" + key) == [] and S.confirmed_spans(key + "Q") == [] and S.confirmed_spans(key + "/9") == []
    two = f"{key}\n\n{plain(EC)} {url(DSA)}"
    assert [S.KINDS[k] for _, k, _ in sorted(S.confirmed_spans(two))] == ["der"] * 3
    many = ("M" + "A" * 23 + "/") * 3000 + "\n" + "AAAA" * 20_000
    assert S.confirmed_spans(many) == []


def test_tokens_and_encrypted_armour():
    kinds = lambda text: [S.KINDS[k] for _, k, _ in S.confirmed_spans(text)]
    part = lambda d: url(json.dumps(d).encode())
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln"
    for before, after in AROUND[:5]:
        assert S.confirmed_spans(f"{before}{jwt}{after}") == [(len(before), S.KINDS.index("jwt"), len(before) + len(jwt))]
    for bad in ({"typ": "x"}, {"alg": 1}, ["alg"]):
        assert kinds(f"{part(bad)}.{part({'sub': 1})}.c2ln") == []
    assert kinds("eyJub3QganNvbg.eyJh.c2ln") == [] and kinds("-----BEGIN NOTHING-----\nabcd\n-----END NOTHING-----") == []
    boxed = lambda body: f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    lines = wrap(64, "\n")
    secret = hashlib.sha256(b"x").digest() * 20
    for eol in ("\n", "\r\n"):
        head = eol.join(["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF", "", ""])
        assert S.confirmed_spans(text := boxed(head + lines(secret))) == [(0, 3, len(text))]
        assert kinds(boxed(head + lines(secret + b"x"))) == []  # no whole blocks
        assert kinds(boxed(eol.join(["Proc-Type: 4,ENCRYPTED", "", ""]) + lines(secret))) == []
    assert kinds(boxed("DEK-Info: DES-EDE3-CBC,0011223344556677\n\n" + lines(secret))) == []  # not said to be encrypted
    assert kinds(boxed("Comment: of the test,\n continued\n\n" + lines(RSA))) == ["pem"]
    assert kinds("-----BEGIN A-----" + boxed(lines(DSA))) == ["pem"]


def test_scan_edge_rows(spark):
    got = rows(S.scan_secrets(edge_docs(spark)))
    assert len(got) == 11 and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert S.scan_secrets(no_docs(spark)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", F.col("lang")), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) > 0


def test_language_edges(spark):
    got = rows(L.identify(edge_docs(spark)))
    assert len(got) == 11
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == 4  # null, empty, blank, null
    assert all(0 <= r["score"] <= 1 for r in got)
    assert L.identify(no_docs(spark)).count() == 0
    nothing = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(L.identify(nothing))} == {"und"}
    kept = L.keep_identified(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and kept.count() == 7
    assert not L.has_letter("12 ² ½ _") and L.has_letter("1é")


def test_pooled_responses_equal_the_plain_network():
    rng = np.random.default_rng(0)
    net = L.train([(b"aaa bbb " * 9, "x"), (b"ccc ddd " * 9, "y")] * 20, epochs=1, least_steps=1)
    texts = [bytes(rng.integers(32, 250, n, dtype=np.uint8)) for n in (1, 255, 256, 700)]
    data, counts, _ = L.padded(texts)
    near, far = net.tables()
    got = L.pool(data, near, far)
    x = np.concatenate([data, np.zeros(4, np.uint8)])
    at = 0
    for t, n in zip(texts, counts, strict=True):
        for k in range(n):
            s = (at + k) * L.WINDOW
            e = net.embed[x[s : s + L.WINDOW + 3]]
            want = np.concatenate([(np.concatenate([e[j : j + L.WINDOW] for j in range(w)], 1) @ f).max(0) for w, f in net.filters.items()]) + net.bias
            assert np.allclose(got[at + k], want, atol=1e-4)
        at += n
        assert n * L.WINDOW >= len(t) + 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "|", "[", "INST]", "[/INST]", "</s>", "<s>", "l", "b", "n", "\n", "é", "<|end|>", "<<SYS>>"]), max_size=12).map("".join), st.sampled_from(["user", "assistant", "a\nb", ""]))
def test_segments_read_back(text, role):
    segment, loss, _ = C.format_turn(role, [{"type": "text", "text": text}])
    assert C.read_segments(segment + segment) == [(role, text)] * 2
    assert not any(c in C.escape(text) for c in C.CONTROL)
    assert "".join(C.unescape(segment[s:e]) for s, e in loss) == (text if role == "assistant" else "")


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "img://1", 56, 29, None, None), ("audio", None, "snd://2", None, None, 2.0, None), ("document", None, "doc://3", None, None, None, 2), ("video", None, "vid://4", None, None, None, None), ("text", " <|end|> done", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], "conv_id long, turn long, role string, parts " + C.T.ArrayType(C.PART).simpleString())
    r = sorted(rows(C.format_turns(df)), key=lambda x: x["turn"])
    assert [a["kind"] for a in r[0]["attachments"]] == ["image", "audio", "document", "other"]
    assert [a["n_tokens"] for a in r[0]["attachments"]] == [4, 50, 2048, 1] and r[0]["expanded_tokens"] == 2103
    for n, a in enumerate(r[0]["attachments"]):
        assert r[0]["segment"][a["offset"] :].startswith(f"<|{a['kind']}:{n}|>")
    assert "".join(C.unescape(r[0]["segment"][s["start"] : s["end"]]) for s in r[0]["loss"]) == "see  <|end|> done"
    assert C.read_segments(r[1]["segment"]) == [("", "")]


def test_sizes_that_do_not_count():
    for x in (None, -1, 0, float("nan"), float("inf"), -float("inf"), 1e300):
        _, _, found = C.format_turn("user", [{"type": "audio", "seconds": x}, {"type": "image", "width": x, "height": 5}, {"type": "document", "pages": x}])
        assert [a["n_tokens"] for a in found] == [1, 1, 1024]


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, " ".join([chr(97 + i % 20) * 3 + chr(97 + (i % 7))] * 30), f"l{i % 90}") for i in range(900)], "doc_id long, text string, lang string")
    net = L.fit(docs, F.lit(True), max_docs=180)
    assert len(net.labels) == 90
    kept = rows(L.keep_identified(spark.createDataFrame([(i, ("yes no maybe " if i % 2 else "oui non peut être ") * 9, None if i < 20 else ("en" if i % 2 else "fr")) for i in range(80)] + [(99, "12 34", "en")], "doc_id long, text string, lang string")))
    assert len(kept) == 80 and all(r["lang"] == ("en" if r["doc_id"] % 2 else "fr") for r in kept)


def test_conversations_with_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, 1, "assistant", LONG, 0), (1, 0, "user", None, 0), (None, 0, None, "x", 0), (2, None, "assistant", "", 0), (2, 0, "assistant", "b", 0), (2, 0, "assistant", "b", 0)], "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in rows(C.read_back(C.format_turns(df)))}
    assert set(got) == {1, None, 2} and got[1]["loss_chars"] == len(LONG)
    assert got[2]["turns_sha256"] == hashlib.sha256(b"assistant\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert C.read_back(C.format_turns(df.where("false"))).count() == 0
