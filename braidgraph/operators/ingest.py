"""Document ingestion: content-addressed dedup, conversion, staged names, the ledger."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".rst")
CONVERTED_SUFFIXES = (".csv",)
#: Office and book formats whose converter is an external library; without it they fail with a reason.
EXTERNAL_SUFFIXES = (".docx", ".odt", ".rtf", ".epub", ".pdf", ".pptx", ".xlsx")
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def walkable(path: Column) -> Column:
    """Whether a path has no hidden or skipped part."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return ~F.exists(parts, lambda p: p.isin(*SKIP_DIRS) | p.startswith("."))


def markdown_table(raw: bytes) -> str | None:
    """A CSV file as a table in Markdown; None if there is nothing in it or it can't be read."""
    text = raw.decode("utf-8", "replace")
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    try:
        rows = [r for r in csv.reader(io.StringIO(text)) if r]
    except csv.Error:
        return None
    if not rows:
        return None
    width = max(map(len, rows))
    shown = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([shown[0], "|" + " --- |" * width, *shown[1:]]) + "\n"


@F.pandas_udf(T.StringType())
def csv_to_markdown(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tables in Markdown; null stays null."""
    for s in content:
        yield s.map(lambda raw: None if raw is None else markdown_table(bytes(raw)))


def stem_of(path: Column) -> Column:
    """File name without suffix, with unsafe runs as single dashes."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(safe == "", F.lit("document")).otherwise(safe)


def staged_names(files: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """``files`` (path, sha256, out_suffix) with staged_path; names that collide take a digest part.

    The first path of a name keeps it, unless ``taken`` (staged_path) has it from earlier.
    Firsts are minima, taken in part before the shuffle, so a name that a third of all files
    share gathers nowhere. Of files that also share the digest's first part one has the
    short name, the rest the whole digest.
    """
    stem, out = stem_of(F.col("path")), F.col("out_suffix")

    def first_of(rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with whether their path, and digest if paths are equal, is the first of its name."""
        least = rows.groupBy(name).agg(F.min(F.struct("path", "sha256")).alias("__least"))
        dealt = F.xxhash64(name)  # a key of its own, so that a hot name's rows can be split
        both = rows.withColumn("__k", dealt).join(least.withColumn("__k", dealt), [name, "__k"])
        both = both.withColumn("__first", F.struct("path", "sha256") == F.col("__least")).drop("__least", "__k")
        if taken is None:
            return both
        gone = taken.select(F.col("staged_path").alias(name)).where(F.col(name).isNotNull()).distinct().withColumn("__gone", F.lit(True))
        both = both.withColumn("__k", dealt).join(gone.withColumn("__k", dealt), [name, "__k"], "left")
        return both.withColumn("__first", F.col("__first") & F.col("__gone").isNull()).drop("__gone", "__k")

    named = first_of(files.withColumn("__plain", F.concat(stem, out)), "__plain")
    short = F.concat(stem, F.lit("-"), F.substring("sha256", 1, 8), out)
    named = named.withColumn("__second", F.when(F.col("__first"), F.col("__plain")).otherwise(short)).drop("__first", "__plain")
    full = F.concat(stem, F.lit("-"), F.col("sha256"), out)
    return first_of(named, "__second").withColumn("staged_path", F.when(F.col("__first"), F.col("__second")).otherwise(full)).drop("__first", "__second")


def default_converters() -> dict[str, Callable[[Column], Column]]:
    """Suffix to a Column function from bytes to text (null: no output); the first kind that has a suffix wins."""
    return {**{s: (lambda c: F.make_valid_utf8(c.cast("string"))) for s in TEXT_SUFFIXES}, **{s: csv_to_markdown for s in CONVERTED_SUFFIXES}}


def supported_suffixes(converters: dict[str, Callable[[Column], Column]] | None = None) -> list[str]:
    return sorted({*(converters or default_converters()), *EXTERNAL_SUFFIXES})


def ingest(files: DataFrame, ledger: DataFrame | None, now: str, converters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The outcome of each file (path, content): ledger columns and ``text`` of what was ingested.

    Files whose digest the ledger holds as ingested, later files of equal content and
    unsupported suffixes are skipped; conversions without output fail. An ingested
    record is never overwritten by a later skip, nor is a name that the ledger has given again.
    """
    known = files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size_bytes"), suffix(F.col("path")).alias("suffix"))
    chain = converters or default_converters()
    supported = F.col("suffix").isin(*supported_suffixes(chain))
    # digests only: the contents stay where they are
    first = known.where(supported).groupBy("sha256").agg(F.min("path").alias("first_path"))
    rows = known.join(first, "sha256", "left")
    if ledger is not None:
        done = ledger.where("status = 'ingested'").select("sha256").distinct().withColumn("done", F.lit(True))
        rows = rows.join(done, "sha256", "left")
    else:
        rows = rows.withColumn("done", F.lit(None).cast("boolean"))
    # in a conditional expression a function in Python runs for all rows, so such converters are handed
    # the files of their kinds only
    plain, apart = [], {}
    for own, convert in chain.items():
        (plain.append((own, convert)) if not getattr(convert, "evalType", None) else apart.setdefault(convert, []).append(own))
    text = F.lit(None).cast("string")
    for own, convert in plain:
        text = F.when(F.col("suffix") == own, convert(F.col("content"))).otherwise(text)
    others = [own for suffixes in apart.values() for own in suffixes]
    parts = [rows.where(~F.coalesce(F.col("suffix").isin(*others), F.lit(False)) if others else F.lit(True)).withColumn("text", text)]
    parts += [rows.where(F.col("suffix").isin(*own)).withColumn("text", convert(F.col("content"))) for convert, own in apart.items()]
    rows = reduce(DataFrame.unionByName, parts)
    blank = F.col("text").isNull() | (F.trim("text") == "")
    status = F.when(~supported, "skipped").when(F.col("done"), "skipped").when(F.col("path") != F.col("first_path"), "skipped")
    status = status.when(~F.col("suffix").isin(*TEXT_SUFFIXES) & blank, "failed").otherwise("ingested")
    reason = F.when(~supported, F.concat(F.lit("unsupported suffix "), F.col("suffix"))).when(F.col("done"), "already ingested").when(F.col("path") != F.col("first_path"), F.concat(F.lit("same content as "), F.col("first_path")))
    reason = reason.when(~F.col("suffix").isin(*chain), "converter is not installed").when(F.col("status") == "failed", "no output")
    out_suffix = F.when(F.col("suffix") == ".markdown", ".md").when(F.col("suffix").isin(*TEXT_SUFFIXES), F.col("suffix")).otherwise(".md")
    rows = rows.withColumn("status", status).withColumn("reason", reason).withColumn("out_suffix", out_suffix)
    names = staged_names(rows.where("status = 'ingested'").select("path", "sha256", "out_suffix").distinct(), ledger).select("path", "sha256", "staged_path")
    out = rows.join(names, ["path", "sha256"], "left")
    converter = F.when(F.col("suffix").isin(*TEXT_SUFFIXES), "passthrough").when(F.col("suffix").isin(*chain), F.ltrim(F.col("suffix"), F.lit(".")))
    return out.select(
        F.col("path").alias("source_path"), "sha256", "size_bytes", "status", "staged_path", converter.alias("converter"), F.lit("1").alias("converter_version"),
        "reason", F.lit(now).alias("ingested_at"), F.create_map().cast("map<string,string>").alias("metadata"), F.when(F.col("status") == "ingested", F.col("text")).alias("text"),
    )


def latest(ledger: DataFrame) -> DataFrame:
    """The record of each source path: what was ingested, else the last outcome."""
    rank = F.struct((F.col("status") == "ingested").alias("whole"), F.col("ingested_at"), F.struct(*ledger.drop("metadata").columns).alias("row"))
    last = ledger.groupBy("source_path").agg(F.max(rank)["row"].alias("row"))
    return last.select("row.*")


def has_ingested(ledger: DataFrame, digests: DataFrame) -> DataFrame:
    """``digests`` (sha256, ...) with whether the ledger holds each as ingested."""
    done = ledger.where("status = 'ingested'").select("sha256").distinct().withColumn("ingested", F.lit(True))
    return digests.join(done, "sha256", "left").withColumn("ingested", F.coalesce("ingested", F.lit(False)))


def staged_paths(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'ingested'").select("staged_path").distinct()


def summary(ledger: DataFrame) -> DataFrame:
    """One row: counts by status, zeros included, and the total."""
    return ledger.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ingested", "skipped", "failed")), F.count("*").alias("total"))


def problems(ledger: DataFrame) -> DataFrame:
    return ledger.where("status != 'ingested'").orderBy("source_path")
