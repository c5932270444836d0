from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from braidgraph.functions import temporal as TM
from braidgraph.functions import text as X
from braidgraph.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("d", "want"), [(0.0, 1.0), (-5.0, 1.0), (1.0, 0.5)])
def test_semantic_score(spark, d, want):
    assert one(spark, X.semantic_score(F.lit(d))) == want


def test_tokens(spark):
    assert set(one(spark, X.query_tokens(F.lit("Thread_pool_9 naïve")))) == {"thread_pool_9", "thread", "pool", "na", "ve"}
    assert set(one(spark, X.query_tokens(F.lit("_edge_ x 7 of _q")))) == {"_edge_", "edge", "of", "_q"}
    assert one(spark, X.normalize_query(F.lit("-left__right- "))) == "left right"
    q = F.array(*map(F.lit, ("river", "delta", "mouth", "silt")))
    assert one(spark, X.lexical_overlap(q, F.lit("the River"), F.lit(None), F.lit(""), F.lit("silt_bed"))) == pytest.approx(1 / 4)
    assert one(spark, X.lexical_overlap(F.array().cast("array<string>"), F.lit("x"))) == 0.0


def test_docstring_signal(spark):
    assert one(spark, X.docstring_signal(F.lit(None).cast("string"))) == 0.0
    assert one(spark, X.docstring_signal(F.lit("on and on, off"))) == pytest.approx(0.6 * 4 / 40 + 0.4 * 3 / 4)
    assert one(spark, X.docstring_signal(F.lit(" ".join(f"w{i}" for i in range(80))))) == pytest.approx(1.0)


@pytest.mark.parametrize(("kind", "a", "b", "n", "want"), [("function", 20, 30, 100, (17, 33)), ("function", 5, 9, 0, (1, 0)), ("module", 7, None, 100, (1, 60)), ("function", None, None, 10, (1, 10)), ("function", 2, 1, 100, (1, 5)), ("function", 10, 200, 300, (7, 66))])
def test_spans(spark, kind, a, b, n, want):
    got = one(spark, X.compute_span(F.lit(kind), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(n), 3, 60))
    assert (got["start"], got["end"]) == want


def test_span_overlap_and_snippets(spark):
    lit = lambda *v: map(F.lit, v)
    assert one(spark, X.spans_overlap(*lit(1, 5, 7, 15))) and not one(spark, X.spans_overlap(*lit(1, 5, 8, 15)))
    lines = X.lines(F.lit("a\nb\r\nc\n"))
    assert one(spark, lines) == ["a", "b", "c"] and one(spark, X.lines(F.lit(""))) == []
    assert one(spark, X.snippet(lines, F.lit(2), F.lit(9))) == "    2: b\n    3: c"
    assert one(spark, X.snippet(F.array(F.lit("x")), F.lit(1), F.lit(0))) == ""
    assert one(spark, X.relevance_tier(F.lit(0.45))) == "MEDIUM"


def test_small_text_functions(spark):
    assert one(spark, X.strip_thinking(F.lit("<think>a\nb</think> yes <think>c</think>"))) == "yes"
    assert one(spark, X.with_alpha(F.lit("#FF8000"), F.lit(2))) == "rgba(255,128,0,1.000)"
    assert one(spark, X.with_alpha(F.lit("red"), F.lit(0.5))) == "red"
    assert one(spark, X.metric_label(F.lit("page_rank"))) == "page rank"
    for raw in ("{not json", "[1,2,3]", None):
        assert one(spark, X.metadata_map(F.lit(raw).cast("string"))) == {}
    assert one(spark, X.call_site_line(F.lit('{"lineno": 7}'))) == 7 and one(spark, X.call_site_line(F.lit('{"lineno": "x"}'))) is None


@pytest.mark.parametrize(("v", "want"), [("1876", ("1876-01-01 00:00:00", "year")), ("2024-02", ("2024-02-01 00:00:00", "month")), ("2026-08-17", ("2026-08-17 00:00:00", "day")), ("2026-08-17T10:00:00+02:00", ("2026-08-17 08:00:00", "time")), ("2026-08-17T10:00:00Z", ("2026-08-17 10:00:00", "time")), ("12:30", None), ("", None), ("2026-13", None), ("2026-02-30", None), (None, None), ("soon", None)])
def test_parse(spark, v, want):
    got = one(spark, TM.parse(F.lit(v).cast("string")))
    assert (got and (str(got["instant"]), got["precision"])) == want


def span(start=None, end=None, recorded=None):
    return TM.span(*(F.lit(x).cast("string") for x in (start, end, recorded)))


def test_overlaps(spark):
    hit = lambda s, a, b: one(spark, TM.overlaps(s, F.lit(a) if a else None, F.lit(b) if b else None))
    assert hit(span("1876"), "1876-03-04", "1876-03-04") and not hit(span("1876"), "1877", None)
    assert hit(span("2024-02"), "2024-02-29", None) and not hit(span("2024-02"), "2024-03", None)
    assert not hit(span(), None, None) and not hit(span(end="2024"), "2020", None)  # an end alone
    assert hit(span("bad", None, "2024-05-05"), "2024-05", "2024-05")
    assert hit(span("2024-01-01", "2024-03"), "2024-03-31", None)
    assert one(spark, span("nonsense")) is None


def test_spine_and_metadata(spark):
    t = TM.parse(F.lit("2026-08-17"))
    assert one(spark, TM.spine_chain(t["instant"], t["precision"])) == ["t:2026", "t:2026-08", "t:2026-08-17"]
    y = TM.parse(F.lit("1876"))
    assert one(spark, TM.spine_id(y["instant"])) == "t:1876-01-01" and one(spark, TM.spine_chain(y["instant"], y["precision"])) == ["t:1876"]
    assert one(spark, TM.metadata(F.lit("2024-2"), F.lit("2024-03"), F.lit(None).cast("string"))) == {"occurred_end": "2024-03"}
    assert str(one(spark, TM.sort_key(span(None, None, "2024")))) == "2024-01-01 00:00:00"


def test_vector_functions(spark):
    a = F.array(*map(F.lit, (1.0, 0.0))).cast("array<float>")
    assert one(spark, V.cosine_distance(a, F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert one(spark, V.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) == 1.0
    assert one(spark, V.to_int8(F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5 / 127), F.lit(1.5 / 127)))) == [127, -128, 0, 2]
    assert (V.subvectors(384), V.subvectors(7), V.partitions(10), V.partitions(1_000_000)) == (24, 1, 1, 1000)
