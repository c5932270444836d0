"""Streams over tables: one file and a folder of files give the same rows."""

from __future__ import annotations

import shutil

import pytest

from braidgraph.queries import QUERIES


@pytest.mark.parametrize("name, table", [("stream_embed", "documents"), ("stream_tumbling", "events"), ("stream_timeline", "events")])
def test_a_table_may_be_a_folder_of_files(spark, data, tmp_path, name, table):
    shutil.copytree(data, tmp_path / "in", ignore=shutil.ignore_patterns(f"{table}.parquet"))
    spark.read.parquet(f"{data}/{table}.parquet").repartition(3).write.parquet(str(tmp_path / "in" / f"{table}.parquet"))
    got, want = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (str(tmp_path / "in"), data))
    assert got == want and got
