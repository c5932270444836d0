"""Text columns: tokens, scores, index texts, spans and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braidgraph.functions.binding import let

_TOKEN = r"([a-z0-9_]+)"


def tokens(text: Column) -> Column:
    """All lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(1))


def query_tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more, and their parts between underscores."""

    def with_parts(found: Column) -> Column:
        joined = F.filter(found, lambda t: t.contains("_"))
        return F.array_union(found, F.flatten(F.transform(joined, lambda t: F.split(t, "_"))))

    return F.filter(let(tokens(text), with_parts), lambda t: F.length(t) >= 2)


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[_-]+", " "))


def semantic_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(F.lit(0.0), distance))


def docstring_signal(doc: Column) -> Column:
    """Length and variety of a docstring's tokens, in [0, 1]."""

    def value(t: Column) -> Column:
        n = F.size(t)
        uniq = F.size(F.array_distinct(t)) / F.greatest(F.lit(1), n)
        mixed = 0.6 * F.least(F.lit(1.0), n / F.lit(40.0)) + 0.4 * uniq
        return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))

    return let(tokens(F.coalesce(doc, F.lit(""))), value)


def lexical_overlap(query: Column, *fields: Column) -> Column:
    """Share of the query's tokens that occur in the fields."""
    own = F.array_distinct(tokens(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields))))
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, own)) / F.size(query))


def index_text(kind: Column, name: Column, qualname: Column, module_path: Column, lineno: Column, docstring: Column) -> Column:
    """The text that a node is embedded by; keywords that the docstring lacks come last."""
    alpha = F.lit(r"([a-zA-Z]+)")
    given = lambda c: F.when(c.isNotNull() & (c != ""), c)
    raw = F.concat_ws(" ", given(name), given(qualname), given(module_path))
    words = F.filter(F.transform(F.regexp_extract_all(raw, alpha, F.lit(1)), F.lower), lambda w: F.length(w) > 2)
    seen = F.regexp_extract_all(F.lower(F.coalesce(docstring, F.lit(""))), alpha, F.lit(1))
    extra = F.array_except(F.array_distinct(words), seen)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("KIND: "), kind),
        F.concat(F.lit("NAME: "), name),
        F.concat(F.lit("QUALNAME: "), given(qualname)),
        F.concat(F.lit("MODULE: "), given(module_path)),
        F.concat(F.lit("LINE: "), lineno.cast("string")),
        F.concat(F.lit("DOCSTRING:\n"), F.trim(given(docstring))),
        F.when(F.size(extra) > 0, F.concat(F.lit("KEYWORDS: "), F.array_join(extra, " "))),
    )


def compute_span(kind: Column, lineno: Column, end_lineno: Column, file_lines: Column, context: int = 5, max_lines: int = 60) -> Column:
    """struct<start, end> of the lines to show; (1, 0) for an empty file."""
    last = F.when(end_lineno.isNotNull() & (end_lineno >= lineno), end_lineno).otherwise(lineno)
    start = F.greatest(F.lit(1), lineno - context)
    end = F.least(file_lines, last + context)
    end = F.when(end - start + 1 > max_lines, F.least(file_lines, start + (max_lines - 1))).otherwise(end)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    whole = span(F.lit(1), F.least(file_lines, F.lit(max_lines)))
    return F.when(file_lines <= 0, span(F.lit(1), F.lit(0))).when((kind == "module") | lineno.isNull(), whole).otherwise(span(start, end))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, gap: int = 2) -> Column:
    return ~((a_end + gap < b_start) | (b_end + gap < a_start))


def lines(text: Column) -> Column:
    """Lines of a text; none for an empty one, and no empty line after a final line end."""
    cut = F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(cut)


def snippet(file_lines: Column, start: Column, end: Column) -> Column:
    """Numbered lines ``start`` to ``end``, joined."""
    chunk = F.slice(file_lines, F.greatest(F.lit(1), start), F.greatest(F.lit(0), F.least(end, F.size(file_lines)) - F.greatest(F.lit(1), start) + 1))

    def one(line: Column, i: Column) -> Column:
        no = (i + start).cast("string")
        return F.concat(F.lpad(no, F.greatest(F.lit(5), F.length(no)), F.lit(" ")), F.lit(": "), line)

    return F.array_join(F.transform(chunk, one), "\n")


def line_count(lineno: Column, end_lineno: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), end_lineno - lineno), F.lit(0))


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 0.60, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def metric_label(metric: Column) -> Column:
    return F.replace(metric, F.lit("_"), F.lit(" "))


def with_alpha(color: Column, alpha: Column) -> Column:
    """``rgba(...)`` of a six-digit hex colour, alpha clamped; other values pass through."""
    digits = F.ltrim(color, F.lit("#"))
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10)
    shown = F.format_string("%.3f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha.cast("double"))))
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), F.concat(F.lit("rgba("), F.concat_ws(",", part(1), part(3), part(5), shown), F.lit(")"))).otherwise(color)


def metadata_map(raw: Column) -> Column:
    """The JSON object as a map; empty if null, broken or no object."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def call_site_line(evidence: Column) -> Column:
    return F.get_json_object(evidence, "$.lineno").try_cast("int")
