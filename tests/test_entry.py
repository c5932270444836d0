from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from braidgraph.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return con


def canonical(table):
    return sorted(str(tuple(r.values())) for r in table.select(sorted(table.column_names)).to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, views, data, name):
    got = QUERIES[name](spark, data).toArrow()
    want = views.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "kind", "hop", "via_seed", "score", "semantic", "lexical"] and df.count() == 40


def test_the_core_stands_alone(tmp_path):
    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "braidgraph"), tmp_path / "braidgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e, braidgraph; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(braidgraph.__file__)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True)
    assert out.stdout.startswith(str(tmp_path))
    # a fault inside the subpackage is not taken for its absence
    (tmp_path / "braidgraph" / "llm").mkdir()
    (tmp_path / "braidgraph" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr
