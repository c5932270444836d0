"""The relational test tables as a property graph, a code graph, vectors, metrics and snapshots.

The mappings are SQL over the tables; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of every node mapping: id, kind, name, qualname, module_path, lineno, end_lineno, docstring, metadata.
NODES = """
SELECT concat('region:', r_regionkey) AS id, 'region' AS kind, r_name AS name, r_name AS qualname, CAST(NULL AS STRING) AS module_path,
  CAST(r_regionkey AS INT) AS lineno, CAST(NULL AS INT) AS end_lineno, concat('Region ', r_name) AS docstring, CAST(NULL AS STRING) AS metadata FROM {region}
UNION ALL SELECT concat('nation:', n_nationkey), 'nation', n_name, concat(r_name, '.', n_name), n_name, CAST(n_nationkey AS INT), CAST(NULL AS INT),
  concat(n_name, ' in ', r_name), CAST(NULL AS STRING) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('customer:', c_custkey), 'customer', c_name, concat(r_name, '.', n_name, '.', c_name), n_name, CAST(c_custkey AS INT), CAST(NULL AS INT),
  concat(c_mktsegment, ' customer of ', n_name), concat('{{"segment": "', c_mktsegment, '"}}') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('supplier:', s_suppkey), 'supplier', s_name, concat(r_name, '.', n_name, '.', s_name), n_name, CAST(s_suppkey AS INT), CAST(NULL AS INT),
  CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT concat('order:', o_orderkey), 'order', concat('Order ', o_orderkey), concat('order.', o_orderkey), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT),
  concat(o_orderpriority, ' ', o_orderstatus), CAST(NULL AS STRING) FROM {orders}
UNION ALL SELECT concat('part:', p_partkey), 'part', p_name, concat(p_brand, '.', p_name), p_brand, CAST(p_size AS INT), CAST(p_size + 10 AS INT), p_type, CAST(NULL AS STRING) FROM {part}
"""

EDGES = """
SELECT concat('region:', n_regionkey) AS src, 'CONTAINS' AS rel, concat('nation:', n_nationkey) AS dst, CAST(NULL AS STRING) AS evidence FROM {nation}
UNION ALL SELECT concat('nation:', c_nationkey), 'CONTAINS', concat('customer:', c_custkey), CAST(NULL AS STRING) FROM {customer}
UNION ALL SELECT concat('nation:', s_nationkey), 'CONTAINS', concat('supplier:', s_suppkey), CAST(NULL AS STRING) FROM {supplier}
UNION ALL SELECT concat('customer:', o_custkey), 'PLACED', concat('order:', o_orderkey), CAST(NULL AS STRING) FROM {orders}
UNION ALL SELECT DISTINCT concat('order:', l_orderkey), 'LISTS', concat('part:', l_partkey), CAST(NULL AS STRING) FROM {lineitem}
UNION ALL SELECT DISTINCT concat('part:', l_partkey), 'SUPPLIED_BY', concat('supplier:', l_suppkey), CAST(NULL AS STRING) FROM {lineitem}
"""

#: How Spark gets them: the lines' duplicates are taken out as numbers, before names are made of them. The same rows.
_BY_NUMBER = {EDGES: EDGES.replace(
    "SELECT DISTINCT concat('order:', l_orderkey), 'LISTS', concat('part:', l_partkey), CAST(NULL AS STRING) FROM {lineitem}",
    "SELECT concat('order:', l_orderkey), 'LISTS', concat('part:', l_partkey), CAST(NULL AS STRING) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem})",
).replace(
    "SELECT DISTINCT concat('part:', l_partkey), 'SUPPLIED_BY', concat('supplier:', l_suppkey), CAST(NULL AS STRING) FROM {lineitem}",
    "SELECT concat('part:', l_partkey), 'SUPPLIED_BY', concat('supplier:', l_suppkey), CAST(NULL AS STRING) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem})",
)}

_SLUG = "lower(replace(p_type, ' ', '_'))"

#: Parts as functions, their types as modules, brands as symbol stubs.
CODE_NODES = f"""
SELECT DISTINCT concat('mod:', {_SLUG}) AS id, 'module' AS kind, {_SLUG} AS name, {_SLUG} AS qualname, concat('src/', {_SLUG}, '.py') AS module_path,
  CAST(NULL AS INT) AS lineno, CAST(NULL AS INT) AS end_lineno, CAST(NULL AS STRING) AS docstring, CAST(NULL AS STRING) AS metadata FROM {{part}}
UNION ALL SELECT concat('fn:', p_partkey), 'function', replace(p_brand, '#', '_'), concat('f', p_partkey), concat('src/', {_SLUG}, '.py'), CAST(p_size AS INT), CAST(p_size + p_partkey % 9 AS INT),
  CASE WHEN p_partkey % 3 = 0 THEN p_name END, CAST(NULL AS STRING) FROM {{part}}
UNION ALL SELECT DISTINCT concat('sym:', replace(p_brand, '#', '_')), 'symbol', replace(p_brand, '#', '_'), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{part}}
UNION ALL SELECT concat('sym:', {_SLUG}, '.f', p_partkey), 'symbol', concat('f', p_partkey), concat({_SLUG}, '.f', p_partkey), CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {{part}} WHERE p_partkey % 10 = 0
"""

CODE_EDGES = f"""
SELECT concat('mod:', {_SLUG}) AS src, 'CONTAINS' AS rel, concat('fn:', p_partkey) AS dst, CAST(NULL AS STRING) AS evidence FROM {{part}}
UNION ALL SELECT concat('fn:', p_partkey), 'CALLS', concat('fn:', (p_partkey * 7) % 40 + 1), concat('{{{{"lineno": ', p_partkey % 100, '}}}}') FROM {{part}} WHERE p_partkey % 4 <> 0
UNION ALL SELECT concat('fn:', p_partkey), 'CALLS', concat('sym:', replace(p_brand, '#', '_')), concat('{{{{"lineno": ', p_partkey % 50, ', "expr": "x.', replace(p_brand, '#', '_'), '"}}}}') FROM {{part}} WHERE p_partkey % 2 = 0
UNION ALL SELECT DISTINCT concat('mod:', {_SLUG}), 'IMPORTS', concat('sym:', replace(p_brand, '#', '_')), CAST(NULL AS STRING) FROM {{part}} WHERE p_partkey % 5 = 0
"""

#: Documents under their sources, each importing another.
DOC_NODES = """
SELECT concat('document:', doc_id) AS id, 'document' AS kind, concat('doc ', doc_id) AS name, concat(source, '.d', doc_id) AS qualname, source AS module_path,
  CAST(doc_id AS INT) AS lineno, CAST(NULL AS INT) AS end_lineno, text AS docstring, concat('{{"lang": "', lang, '", "n_chars": ', n_chars, '}}') AS metadata FROM {documents}
UNION ALL SELECT DISTINCT concat('source:', source), 'source', source, source, CAST(NULL AS STRING), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM {documents}
"""

DOC_EDGES = """
SELECT concat('source:', source) AS src, 'CONTAINS' AS rel, concat('document:', doc_id) AS dst, CAST(NULL AS STRING) AS evidence FROM {documents}
UNION ALL SELECT concat('document:', doc_id), 'IMPORTS', concat('document:', (doc_id * 13 + 7) % 200), CAST(NULL AS STRING) FROM {documents}
UNION ALL SELECT concat('document:', doc_id), 'MENTIONS', concat('document:', doc_id + 1), CAST(NULL AS STRING) FROM {documents}
"""

#: One snapshot of the orders for each month; every third month repeats its predecessor's state.
SNAPSHOTS = """
SELECT concat('s', m) AS key, CASE WHEN m % 2 = 0 THEN 'main' ELSE 'dev' END AS branch, concat(CAST(1992 + (m - m % 12) / 12 AS INT), '-', lpad(CAST(m % 12 + 1 AS STRING), 2, '0')) AS timestamp, '1' AS version,
  n AS total_nodes, e AS total_edges, f AS n_f, o AS n_o, p AS n_p
FROM (SELECT k.m AS m, count(*) AS n, count(DISTINCT o_custkey) AS e, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p
  FROM (SELECT o_custkey, o_orderstatus, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS m FROM {orders}) x
  JOIN (SELECT DISTINCT CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS m FROM {orders}) k ON x.m = k.m - k.m % 3 GROUP BY k.m) t
"""

TEMPORAL = """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'soon' WHEN event_id % 4 = 0 THEN substr(CAST(ts AS STRING), 1, 4) WHEN event_id % 4 = 1 THEN substr(CAST(ts AS STRING), 1, 7)
  WHEN event_id % 4 = 2 THEN substr(CAST(ts AS STRING), 1, 10) ELSE concat(substr(CAST(ts AS STRING), 1, 10), 'T', substr(CAST(ts AS STRING), 12, 8)) END AS occurred FROM {events}
"""


def of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the mappings over the tables in ``sf_dir``."""
    import string

    sql = _BY_NUMBER.get(sql, sql)
    names = {f[1] for f in string.Formatter().parse(sql) if f[1]}
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in sorted(names)}
    return spark.sql(sql, **tables)


def text(sql: str) -> str:
    """The mapping as SQL over views that have the tables' names."""
    import string

    return sql.format(**{f[1]: f[1] for f in string.Formatter().parse(sql) if f[1]})
