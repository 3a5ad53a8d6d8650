"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import additive_ann, chat, jaccard, langid, licenses, merkle, mixing, packing, prefix_trie, repeats, topk, url_filter, warc
from cadenza.session import materialize, table


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Rules of the registered query, as (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_and_read(rows, public_tokenizers.path("byte_bpe_50k.json"), of=lambda read: chat.digests(read, "digest")).drop("digest")


OP3_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(len(role) + len(text) + {len(chat.BEGIN) + len(chat.END) + 2} + len(regexp_extract_all(text, '{chat.ESCAPABLE}')))::BIGINT AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"), "unmatched")


def op5_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN []
             WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS own FROM w),
n AS (SELECT doc_id, len(own)::BIGINT AS n_shingles FROM g),
e AS (SELECT doc_id, unnest(own) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * hits >= 75 * (a.n_shingles + b.n_shingles - hits)),
r AS (SELECT doc_id AS x, doc_id AS c FROM n UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.x)
SELECT n.doc_id, n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n_shingles
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS k FROM r),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS caps, coalesce(sum(weight) OVER before, 0)::BIGINT AS gone,
             sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS all_weight FROM o
      WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT total - caps AS spare, all_weight - gone AS share FROM c
      WHERE (total - caps)::DOUBLE * weight / (all_weight - gone)::DOUBLE <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT r.source, r.source_size, least(f.spare::DOUBLE * r.weight / f.share::DOUBLE, (3 * r.source_size)::DOUBLE) AS target FROM r, f),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM j
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"))
    digests = kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return materialize(digests, "repeats-digests", drop_shuffles=True)  # narrow rows, instead of the texts' exchange


OP11_SQL = """
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT k, doc_id, i, hash(words[i:i+12]) AS a, md5(array_to_string(words[i:i+12], ' ')) AS b
      FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM w WHERE doc_id IS NOT NULL)),
m AS (SELECT a, b, min(doc_id) AS least FROM g GROUP BY a, b),
c AS (SELECT DISTINCT k, unnest(range(i, i + 13)) AS place FROM g JOIN m USING (a, b) WHERE least < doc_id),
gone AS (SELECT k, list(place) AS gone FROM c GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, len(coalesce(gone, []))::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (k)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), altered=merkle.without_newlines())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_url_filter": op2_url_filter,
    "op3_chat_trees": op3_chat_trees,
    "op4_license_scan": op4_license_scan,
    "op5_additive_ann": op5_additive_ann,
    "op6_jaccard_components": op6_jaccard_components,
    "op7_mix_sources": op7_mix_sources,
    "op8_language_id": op8_language_id,
    "op9_pivot_top_k": op9_pivot_top_k,
    "op10_pack_sequences": op10_pack_sequences,
    "op11_repeated_phrases": op11_repeated_phrases,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_trees": OP3_SQL, "op4_license_scan": licenses.scan_sql(), "op6_jaccard_components": OP6_SQL, "op7_mix_sources": OP7_SQL, "op9_pivot_top_k": OP9_SQL, "op11_repeated_phrases": OP11_SQL, "op12_merkle_manifest": merkle.SQL, "op13_prefix_trie": prefix_trie.SQL}
