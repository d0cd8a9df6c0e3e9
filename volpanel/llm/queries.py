"""Queries of the operators in this folder, and their SQL checks where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.llm.archives import archive
from volpanel.llm.conversations import collapse_snapshots
from volpanel.llm.decontamination import decontaminate
from volpanel.llm.hard_negatives import hard_negatives
from volpanel.llm.licences import scan_licences
from volpanel.llm.main_text import main_text
from volpanel.llm.near_duplicates import near_duplicates
from volpanel.llm.packing import pack
from volpanel.llm.personal_data import BASE, find_personal_data, listed
from volpanel.llm.quality import quality_rules
from volpanel.llm.spelling import spelling_variants
from volpanel.llm.toxicity import score_toxicity
from volpanel.llm.vantage import nearest


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op2_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return collapse_snapshots(table(spark, folder, "conversations"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_archives(spark: SparkSession, folder: str) -> DataFrame:
    merged = archive(table(spark, folder, "pages"), time="timestamp_seconds(1700000000L + id)")
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(table(spark, folder, "documents")).selectExpr(
        "doc_id",
        *[f"bigint(size(filter(base, e -> e.kind = '{kind}'))) AS n_{kind}" for kind in BASE],
        f"sha2({listed('base')}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = table(spark, folder, "embeddings").withColumn("label", label)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


def queries() -> dict:
    found = (
        op1_decontamination, op2_conversations, op3_main_text, op4_licences, op5_quality, op6_toxicity, op7_archives,
        op8_packing, op9_near_duplicates, op10_personal_data, op11_spelling_variants, op12_hard_negatives,
        op13_nearest_neighbours,
    )
    return {f.__name__: f for f in found}


WORDS = """regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP1_SQL = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce({WORDS}, []) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bi AS (SELECT item, ws, least(len(ws), 13) AS size, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM bi),
sizes AS (SELECT DISTINCT size FROM bw),
di AS (SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size),
dw AS (SELECT rid, i, size, array_to_string(ws[i:i + size - 1], ' ') AS win FROM di),
hit AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, win)),
spot AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY rid),
item AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN spot USING (rid) LEFT JOIN item USING (rid)
"""

OP2_SQL = """
WITH t AS (
    SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
        CASE WHEN role IS NULL THEN '0' ELSE '1' || role END || chr(30) || CASE WHEN text IS NULL THEN '0' ELSE '1' || text END AS x,
        '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' AS y
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT id, place, string_agg(x, chr(31)) OVER (PARTITION BY id ORDER BY place) AS prefix, count(*) OVER (PARTITION BY id) AS n FROM t),
whole AS (SELECT id, n, prefix FROM p WHERE place = n),
longer AS (SELECT place AS n, prefix, arg_min(id, (-n, id)) AS holder FROM p WHERE place < n GROUP BY place, prefix),
same AS (SELECT n, prefix, min(id) AS first_id FROM whole GROUP BY n, prefix),
text AS (SELECT id, string_agg(y, chr(10) ORDER BY place) AS y FROM t GROUP BY id)
SELECT id AS conv_id, n AS n_turns, holder IS NULL AND id = first_id AS kept,
    coalesce(holder, CASE WHEN id <> first_id THEN first_id END) AS kept_by, CASE WHEN holder IS NULL AND id = first_id THEN y END AS rendered
FROM whole JOIN same USING (n, prefix) LEFT JOIN longer USING (n, prefix) JOIN text USING (id)
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM s
"""

# CRC-32 over the bytes of id, colon and run; neighbours by wildcards and by leaving out characters
OP11_SQL = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS tab),
raw AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS head, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT head, run, count(*) AS n FROM raw GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(head || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + ord(c) // 64 AS BIGINT), CAST(128 + ord(c) % 64 AS BIGINT)] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM x),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM x),
short AS (SELECT a.word AS long, a.n AS long_n, c.word AS short, c.n AS short_n FROM less a JOIN v c ON a.k = c.word),
near AS (SELECT a.word, c.word AS other, c.n FROM wild a JOIN wild c ON a.k = c.k AND a.word <> c.word
    UNION SELECT long, short, short_n FROM short UNION SELECT short, long, long_n FROM short),
top AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM near GROUP BY word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN top USING (word)),
chain AS (SELECT word, word AS at FROM f UNION SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, chain.at AS root
FROM f JOIN chain USING (word) JOIN f last ON chain.at = last.word WHERE last.form IS NULL
"""

USABLE = "{v} IS NOT NULL AND len({v}) > 0 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0".format(v="embedding")

OP12_SQL = f"""
WITH e AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {USABLE}),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, a.v AS av, a.label = e.label AS same, e.vec_id,
        CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM (SELECT DISTINCT vec_id, label, v FROM e WHERE vec_id % 100 = 0) a JOIN e ON len(a.v) = len(e.v) AND (a.label <> e.label OR a.vec_id <> e.vec_id)),
p AS (SELECT anchor_id, av, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id, av ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id, av)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, av, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, q.v AS a, e.vec_id,
        sqrt(list_reduce(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
    FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 100 = 0) q JOIN e ON len(q.v) = len(e.v) AND q.vec_id <> e.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM d WINDOW w AS (PARTITION BY query_id, a ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op2_conversations": OP2_SQL,
        "op7_archives": OP7_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_nearest_neighbours": OP13_SQL,
    }
