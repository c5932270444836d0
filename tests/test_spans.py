"""Spans of nodes without a line, from their parents."""

from __future__ import annotations

import random

from braidgraph.operators import retrieve

SCHEMA = "id string, kind string, qualname string, module_path string, lineno int, end_lineno int"


def by_hand(rows, n_lines, context, max_lines):
    """One pass over each file by id."""
    cap, out, file, spans = min(max_lines, max(20, context * 4)), {}, None, {}
    for i, kind, qual, path, line, end in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        if path != file:
            file, spans = path, {}
        qual, warning = qual or "", None
        if kind == "module":
            s, e = 1, min(n_lines, max_lines)
        elif line is None:
            held = spans.get(qual.rpartition(".")[0]) if "." in qual else None
            s, e = (held[0], min(held[1], held[0] + cap - 1)) if held else (None, None)
            warning = f"Missing line metadata for `{i}`; " + (f"using capped parent span {s}-{e}." if held else "snippet omitted (no parent span available).")
        else:
            s, e = max(1, line - context), min(n_lines, max(line, end) + context)
            e = min(n_lines, s + max_lines - 1) if e - s + 1 > max_lines else e
        if qual and s is not None:
            spans[qual] = (s, e)
        out[i] = (s, e, warning)
    return out | {r[0]: (None, None, None) for r in rows if not r[3]}


def test_spans_pass_down_by_name_and_id_without_python(spark):
    rnd, rows = random.Random(4), []
    for i in range(600):
        qual = rnd.choice([".".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))), "", None, ".a", "a..b"])
        line = rnd.choice([None, None, rnd.randrange(1, 90)])
        rows.append((f"n{rnd.random():.9f}", rnd.choice(["class", "method", "method", "module"]) if i % 9 else "module", qual, rnd.choice(["f", "g", "g", "", None]), line, line and line + rnd.randrange(40)))
    files = spark.createDataFrame([(p, [str(x) for x in range(100)]) for p in "fg"], "module_path string, lines array<string>")
    out = retrieve.with_spans(spark.createDataFrame(rows, SCHEMA), files, 2, 30, "cap_or_skip")
    assert {r.id: (r.span_start, r.span_end, r.warning) for r in out.collect()} == by_hand(rows, 100, 2, 30)
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()
