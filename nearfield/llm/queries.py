"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, licences, minhash, packing, simple8b, substring, suffix_array, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removal_digest(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licence", "dice", "matches")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = warc.archive(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_suffix_array, op3_nearest, op4_substring, op5_token_files, op6_licences, op7_toxicity, op8_decontaminate, op9_packing, op10_warc)}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(_LOW)}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT d.doc_id, count(k) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * x >= 85 * (p.n + q.n - x)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(reach.b), n.doc_id)) AS component_id, n.doc_id <= coalesce(min(reach.b), n.doc_id) AS kept
FROM n LEFT JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op4_substring": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(50)) AS j FROM x JOIN f USING (k) WHERE least < doc_id)),
c AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed,
sha256(CASE WHEN c.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda v, i: NOT list_contains(c.gone, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)""",
    "op8_decontaminate": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(LOW, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM x JOIN v USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS hit FROM (SELECT doc_id, i, unnest(range(n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""".replace("LOW", _LOW),
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4)::BIGINT + 1, 5))::BIGINT >> (5 * (3 - i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p""",
}
