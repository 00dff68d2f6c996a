"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import embeddings, exact_dedup, minhash, mixing, packing, sharding, suffixes, toolcalls, toxicity, warc
from tallyforge.llm.shared import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns(table(spark, sf_dir, "conversations"))
    rows = toolcalls.linked(calls, results, toolcalls.REPLY)
    return rows.select("conv_id", "call_id", "call_turn", "result_turn", "depth", "status", F.array_join("faults", "; ").alias("faults"), "line")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [f"shard-{i:03d}" for i in range(256)])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SQL_EXACT = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
     r AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     r AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM r
"""


SQL_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
     i AS (SELECT doc_id, x, unnest(generate_series(1, greatest(len(x) - 4, 1))) AS k FROM w WHERE len(x) > 0),
     s AS (SELECT DISTINCT doc_id, md5(array_to_string(x[k:k + 4], ' ')) AS h FROM i),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
     r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
     c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

SQL_VECTORS = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
     r(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
     c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

SQL_CALLS = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations),
     c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text, asked, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth FROM t WHERE role = 'user'),
     a AS (SELECT conv_id, turn, asked, text, row_number() OVER (PARTITION BY conv_id, asked ORDER BY turn, text) AS nth FROM t WHERE role = 'assistant'),
     j AS (SELECT c.conv_id, call_id, c.turn AS call_turn, a.turn AS result_turn, depth, CASE WHEN a.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status, CASE WHEN c.text = '' THEN '$.prompt: too short' ELSE '' END AS faults,
           '{"arguments":{' || CASE WHEN c.asked IS NOT NULL THEN '"context":{"$call":"' || c.conv_id || '-' || c.asked || '"},' ELSE '' END || '"prompt":' || to_json(c.text) || ',"words":' || len(string_split(c.text, ' ')) || '},"conversation":' || c.conv_id || ',"id":"' || call_id || '","name":"reply","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS line
           FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.asked = c.turn AND nth = 1)
SELECT * FROM j UNION ALL
SELECT conv_id, CASE WHEN asked IS NOT NULL THEN conv_id || '-' || asked END, NULL, turn, NULL, CASE WHEN asked IS NULL THEN 'no_call' ELSE 'repeated' END, '',
       '{"arguments":null,"conversation":' || conv_id || ',"id":' || coalesce('"' || conv_id || '-' || asked || '"', 'null') || ',"name":null,"result":' || to_json(text) || '}' FROM a WHERE asked IS NULL OR nth > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": SQL_NEAR, "op3_embeddings": SQL_VECTORS, "op4_toolcalls": SQL_CALLS, "op8_exact_dedup": SQL_EXACT, "op10_warc": SQL_WARC}
