"""The training-data operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidgraph.llm.common import table


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from braidgraph.llm.pivot_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.chat_format import format_turns, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(turns.unionByName(extra)))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.shard_ranges import shard

    return shard(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.common import remove_folder
    from braidgraph.llm.warc_index import archive_folder, merge_index, read_archives, write_archives

    path = archive_folder(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    index = merge_index(read_archives(spark, path))
    remove_folder(spark, path)  # the index is checkpointed
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from braidgraph.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dedup_lines(docs, drop_emptied=False, report=True)
    return left.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.group_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidgraph.llm.pack_exact import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from braidgraph.llm.bpe_lexicon import decode, encode

    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from braidgraph.llm.hard_negatives import mine

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from braidgraph.llm.conversation_repair import damaged, repair_report

    return repair_report(damaged(table(spark, sf_dir, "conversations")), F.col("gone"))


QUERIES = {
    "op1_pivot_search": op1_pivot_search,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "op4_chat_format": op4_chat_format,
    "op5_shard": op5_shard,
    "op6_warc": op6_warc,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_group_join": op9_group_join,
    "op10_pack": op10_pack,
    "op11_bpe": op11_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ESCAPED = "{}"
for _plain, _safe in (("\\", "\\\\"), ("<|", "\\l|"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"), ("<<SYS>>", "\\l<SYS>>"), ("<</SYS>>", "\\l</SYS>>")):
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_safe}')"

ORACLE_SQL = {
    "op9_group_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
shared AS (SELECT doc_id, g FROM t WHERE g IN (SELECT g FROM t GROUP BY g HAVING count(*) > 1)),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT n.doc_id, n.n AS n_shingles, min(reach.y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY 1, 2
""",
    "op1_pivot_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
""",
    "op13_conversation_repair": r"""
WITH RECURSIVE o AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
    lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM o)),
d AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM o JOIN crc USING (k) WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, left(role, 1) AS x, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM p),
s AS (SELECT c, i, role, text, x, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS cut FROM f),
n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
back AS (SELECT c, n AS i, [0, 10, 5, 0] AS g FROM n UNION ALL
  SELECT c, i, list_transform([1, 2, 3, 4], lambda q: least(b[q], 5 + b[[3, 3, 4, 3][q]], 10 + b[[4, 4, 3, 4][q]])) FROM
  (SELECT s.c, s.i, list_transform([1, 2, 3, 4], lambda q: least(2 + g[q], CASE WHEN must THEN 1000000000 ELSE cut + least(1 + g[[3, 3, 4, 3][q]],
    CASE WHEN x = 's' AND q = 1 THEN g[2] WHEN x = 'u' AND q <> 3 THEN g[3] WHEN x = 'a' AND q = 3 THEN g[4] ELSE 1000000000 END) END)) AS b
  FROM back JOIN s ON s.c = back.c AND s.i = back.i - 1)),
there AS (SELECT back.c, back.i, back.g, after.g AS h, role, text, x, must, cut FROM back LEFT JOIN s ON s.c = back.c AND s.i = back.i LEFT JOIN back AS after ON after.c = back.c AND after.i = back.i + 1),
walk AS (SELECT c, 0::BIGINT AS i, 1 AS q, '' AS audit, [] :: VARCHAR[] AS said FROM n UNION ALL
  SELECT c, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE moved END, audit || e,
    CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE moved WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (SELECT *, CASE WHEN h IS NULL THEN CASE WHEN g[q] > 0 THEN 'I' END WHEN g[q] = 2 + h[q] THEN 'D' WHEN g[q] = 5 + g[moved] THEN 'I'
      WHEN kept IS NOT NULL AND NOT must AND g[q] = cut + h[kept] THEN 'K' ELSE 'R' END AS e
    FROM (SELECT walk.*, g, h, role, text, must, cut, [3, 3, 4, 3][q] AS moved, CASE WHEN x = 's' AND q = 1 THEN 2 WHEN x = 'u' AND q <> 3 THEN 3 WHEN x = 'a' AND q = 3 THEN 4 END AS kept
      FROM walk JOIN there ON there.c = walk.c AND there.i = walk.i)) WHERE e IS NOT NULL),
done AS (SELECT c, audit, said FROM walk JOIN n USING (c) WHERE i = n AND q IN (1, 4) QUALIFY row_number() OVER (PARTITION BY c ORDER BY length(audit) DESC) = 1),
t AS (SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM f GROUP BY c),
l AS (SELECT c, count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, x, lag(x) OVER (PARTITION BY c ORDER BY i) AS y FROM f) GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(g[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM o) LEFT JOIN t USING (c) LEFT JOIN l USING (c) LEFT JOIN done USING (c) LEFT JOIN (SELECT c, g FROM back WHERE i = 0) USING (c)
""",
    "op4_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
f AS (SELECT *, '<|turn|>' || replace({_ESCAPED.format("role")}, chr(10), '\\n') || chr(10) || {_ESCAPED.format("text")} || '<|end|>' || chr(10) AS segment FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, segment)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, segment) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1),
k AS (SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
  THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www\d*\.)?([^/?#:]*)', 1)), '.')), ',') || ')' ||
    coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*(?::\d+)?([^#]*)', 1)), ''), '/')
  ELSE lower(url) END AS url_key FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN g.m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.m > page_id THEN g.m END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) - 1 AS position
FROM k LEFT JOIN g USING (d)
""",
    "op7_line_dedup": r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS o FROM documents),
lines AS (SELECT o, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT o, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL)),
w AS (SELECT o, pos, line, greatest(1, len(regexp_extract_all(line, '\S+'))) AS words FROM lines),
pairs AS (SELECT a.o AS o1, b.o AS o2, b.pos - a.pos AS shift, b.pos AS pos, b.words FROM w a JOIN w b ON a.line = b.line AND (a.o < b.o OR a.o = b.o AND a.pos < b.pos)),
islands AS (SELECT *, pos - row_number() OVER (PARTITION BY o1, o2, shift ORDER BY pos) AS island FROM pairs),
runs AS (SELECT o2 AS o, pos, sum(words) OVER (PARTITION BY o1, o2, shift, island) AS total FROM islands),
gone AS (SELECT DISTINCT o, pos FROM runs WHERE total >= 4),
kept AS (SELECT w.o, count(*) AS n, count(gone.pos) AS g, string_agg(line, chr(10) ORDER BY w.pos) FILTER (gone.pos IS NULL) AS text
  FROM w LEFT JOIN gone ON w.o = gone.o AND w.pos = gone.pos GROUP BY w.o)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_deleted, sha256(coalesce(kept.text, '')) AS text_sha256
FROM docs LEFT JOIN kept USING (o)
""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
size_of AS (SELECT DISTINCT least(len(w), 10) AS k FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - least(len(w), 10) + 2, 1))) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, size_of WHERE len(w) >= k)),
found AS (SELECT g.doc_id, g.k, g.i, items.item_id FROM grams g JOIN items USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(named.ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}
