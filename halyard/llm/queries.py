"""The registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import read_documents
from halyard.llm.conversations import damage, parse_conversations, repair_digests, repaired_rows
from halyard.llm.decontaminate import contaminated_windows, covered
from halyard.llm.exact_dedup import exact_groups
from halyard.llm.fingerprint import fingerprint_documents
from halyard.llm.jaccard import similar_components
from halyard.llm.lang_id import identify_languages
from halyard.llm.mixing import mix_sources
from halyard.llm.packing import pack_documents
from halyard.llm.pii import detect_pii
from halyard.llm.quality import score_quality
from halyard.llm.spelling import spelling_variants
from halyard.llm.token_files import round_trip
from halyard.llm.url_filter import judge_urls

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_pii(read_documents(spark, sf_dir))


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(read_documents(spark, sf_dir))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_documents(spark, sf_dir))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(read_documents(spark, sf_dir), labels)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op7_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_documents(spark, sf_dir))


def op9_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), tokenizer_path())


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_documents(spark, sf_dir), tokenizer_path())


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_windows(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = covered(F.col("windows"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_documents(spark, sf_dir), drop_every=97)


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damage(conversations)
    return repair_digests(repaired_rows(rows, parse_conversations(rows), conversations))


QUERIES = {
    "op1_pii_anchors": op1_pii_anchors,
    "op2_multiset_fingerprint": op2_multiset_fingerprint,
    "op3_mix_sources": op3_mix_sources,
    "op4_ppm_language": op4_ppm_language,
    "op5_quality_fm": op5_quality_fm,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_ratio": op7_url_ratio,
    "op8_jaccard_components": op8_jaccard_components,
    "op9_hilbert_packing": op9_hilbert_packing,
    "op10_token_files": op10_token_files,
    "op11_decontaminate": op11_decontaminate,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_repair_conversations": op13_repair_conversations,
}

ORACLE = {
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
 count(*) OVER (PARTITION BY text_sha256) AS group_size,
 doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256 FROM n
""",
    "op11_decontaminate": r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
cut AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM cut),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM low CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS (SELECT r, k, p.n, item FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM places) p JOIN windows v ON v.n = p.n AND v.words = p.words),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS spot FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""",
    # The hash is zlib's, with its table built by rule; words one edit apart share what is left without the edited place.
    "op12_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
counted AS (SELECT id, run, count(*) AS k FROM lowered GROUP BY id, run),
bytes AS (SELECT id, run, k, hex(encode(id || ':' || run)) AS x FROM counted WHERE length(run) >= 5),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM bytes, tab),
made AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, encode(near))) AS b, max(n) AS bn FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * w.n THEN b END AS form, CASE WHEN bn >= 2 * w.n THEN bn END AS form_n FROM words w LEFT JOIN best USING (word)),
paths AS (SELECT word, word AS root FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p USING (word) JOIN forms r ON r.word = p.root WHERE r.form IS NULL
""",
}
