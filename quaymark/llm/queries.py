"""The registered queries of the operators, each over its whole table."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import (
    common, exact_dedup, hash_forest, html_text, jaccard_join, language, mixing, packing, prefix_trie, repeats, runs,
    sentencepiece_codec, token_store, toxicity,
)


def op1_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return hash_forest.nearest(common.table(spark, folder, "embeddings"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(common.table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.without_repeats(common.table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return mixing.mix(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(common.table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, common.table(spark, folder, "labels")))


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(common.table(spark, folder, "documents"))


def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return token_store.read_tokens(token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(common.table(spark, folder, "pages"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    talks = prefix_trie.encoded(common.table(spark, folder, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(talks))


def op12_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents")
    return packing.packed(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.summary(runs.find(common.table(spark, folder, "documents"), runs.planted))


QUERIES = {
    "op1_hash_forest": op1_hash_forest,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_token_output": op9_token_output,
    "op10_html_text": op10_html_text,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_bestfit_packing": op12_bestfit_packing,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

#: crc32 of the decimal id (null: of no digits) in SQL: a byte is mixed in, then eight steps follow.
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    list_filter(string_split(coalesce(CAST({id} AS VARCHAR), ''), ''), lambda c: c <> ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295)"""

ORACLES = {
    "op2_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM plain JOIN groups USING (text_sha256)
""",
    "op5_source_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS ticket
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS HUGEINT) AS weight,
         CAST(source_size * 3 AS HUGEINT) AS cap
  FROM sources
), filling AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS share
  FROM weighed
  WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT rest, share FROM filling WHERE cap * share >= weight * rest ORDER BY share DESC LIMIT 1
), aimed AS (
  SELECT source, source_size,
         CASE WHEN cap * level.share < weight * level.rest THEN CAST(cap AS DOUBLE)
              ELSE CAST(level.rest AS DOUBLE) / CAST(level.share AS DOUBLE) * CAST(weight AS DOUBLE) END AS target
  FROM weighed, level
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM aimed
), running AS (
  SELECT source, ticket, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY ticket) AS upto
  FROM sized GROUP BY source, ticket
), ends AS (
  SELECT plan.source, max(ticket) FILTER (WHERE upto - words / 2 <= target - rounds * source_size) AS last
  FROM plan LEFT JOIN running ON plan.source IS NOT DISTINCT FROM running.source GROUP BY plan.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(rounds + CASE WHEN target > 0 AND ticket <= coalesce(last, -1) THEN 1 ELSE 0 END, 3) AS BIGINT)
         AS taken
FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
JOIN ends ON plan.source IS NOT DISTINCT FROM ends.source
""",
    "op11_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (
    SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
           strlen(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL
  )
), convs AS (
  SELECT conv_id, {crc} % {head} AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT c.conv_id, place, digest, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % {family} AND place <= h
  UNION ALL
  SELECT c.conv_id, place, digest, size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h
), prefixes AS (
  SELECT conv_id, row_number() OVER along AS depth, size, sha256(string_agg(digest, '') OVER along) AS prefix
  FROM rebuilt WINDOW along AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), told AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends, lag(prefix) OVER (PARTITION BY conv_id ORDER BY depth) AS up
  FROM prefixes
), nodes AS (
  SELECT prefix, up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(size) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM told GROUP BY prefix, up
), counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.prefix = n.up
  LEFT JOIN (SELECT up, count(*) AS n_children FROM nodes GROUP BY up) c ON c.up = n.prefix
), sums AS (
  SELECT t.prefix, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM counted n JOIN told t ON t.conv_id = n.conv_id AND t.depth <= n.depth GROUP BY t.prefix
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (prefix)
""".format(crc=CRC.format(id="conv_id"), head=prefix_trie.HEAD, family=prefix_trie.FAMILY),
    "op13_periodic_runs": r"""
WITH docs AS (
  SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         {crc} AS h
  FROM documents
), places AS (
  SELECT key, doc_id, words, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS moved,
         h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) ELSE 0 END AS a
  FROM docs
), word AS (
  SELECT key, i, words[1 + CASE WHEN moved AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS w
  FROM places, LATERAL (SELECT unnest(range(n)) AS i)
), twins AS (
  SELECT x.key, x.i, y.i - x.i AS p FROM word x JOIN word y ON x.key = y.key AND x.w = y.w AND y.i > x.i
), stretches AS (
  SELECT key, p, min(i) AS start, max(i) + 1 + p AS stop FROM (
    SELECT key, p, i, i - row_number() OVER (PARTITION BY key, p ORDER BY i) AS island FROM twins
  ) GROUP BY key, p, island HAVING count(*) + p >= greatest({least}, {fold} * p)
), found AS (
  SELECT key, start, stop - start AS length, min(p) AS period FROM stretches GROUP BY key, start, stop
), kept AS (
  SELECT key, i, w FROM word
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.key = word.key AND i >= f.start + f.period AND i < f.start + f.length)
), collapsed AS (
  SELECT key, sha256(string_agg(w, ' ' ORDER BY i)) AS digest FROM kept GROUP BY key
), told AS (
  SELECT key, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest
  FROM found GROUP BY key
), top AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.key = f.key AND (
      o.length * f.period > f.length * o.period
      OR o.length * f.period = f.length * o.period AND (o.start < f.start OR o.start = f.start AND o.period < f.period)))
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start, top.length, top.period,
       top.length * 1000 // top.period AS exponent_milli,
       coalesce(told.digest, sha256('')) AS runs_sha256, coalesce(collapsed.digest, sha256('')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (key) LEFT JOIN top USING (key) LEFT JOIN collapsed USING (key)
""".format(crc=CRC.format(id="doc_id"), least=runs.LEAST, fold=runs.FOLD),
}
