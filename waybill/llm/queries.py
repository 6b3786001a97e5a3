"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import read_table


def word_vocabulary() -> str:
    """The packing vocabulary; WAYBILL_TOKENIZER names another file."""
    import os

    import public_tokenizers

    return os.environ.get("WAYBILL_TOKENIZER") or str(public_tokenizers.path("word_bpe_49k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3, ..., at most 3 epochs a source."""
    from waybill.llm.mixing import mix

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that stand in an earlier one."""
    from waybill.llm.substring_dedup import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op3_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector rendered as a recording; its class, the place of a noisy excerpt, and all that the queries' excerpts match."""
    from waybill.llm.audio_fingerprint import find_excerpts, recordings_of

    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return find_excerpts(recordings_of(vectors)).drop("row").withColumnRenamed("id", "vec_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    from waybill.llm.warc import round_trip

    out = round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved into 24 shards."""
    from waybill.llm.sharding import interleave

    return interleave(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), shards=24)


def op6_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document under a model of the documents labelled good."""
    from waybill.llm.quality_lm import classify

    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return classify(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted).drop("row")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document and page, from its text, declared language or markup, and address."""
    from waybill.llm.language_id import identify_corpus

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = identify_corpus(docs, read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("kind", "doc_id", "page_id", "lang", "posterior", "declared", "grams", "kept")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, from its text, markup and address."""
    from waybill.llm.language_id import identify_pages

    return identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")).drop("row")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose word 5-grams overlap by 0.8 or more."""
    from waybill.llm.ngram_join import ngram_join

    return ngram_join(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row", "component_row")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    from waybill.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary()).drop("row")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents; the smallest doc_id of each text stays."""
    from waybill.llm.exact_dedup import exact_dedup

    out = exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS draw,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey
), w AS (
  SELECT *, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY CASE WHEN skey LIKE 'n%' THEN 1 ELSE 0 END, encode(skey)) - 1) % 3 + 1 AS w
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS BIGINT) AS lft,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, CAST(cap AS HUGEINT) * w_left <= CAST(w AS HUGEINT) * lft AS capped FROM l
), r AS (
  SELECT *, CAST(total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT) AS rest,
         CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS BIGINT) AS w_rest FROM c
), t AS (
  SELECT skey, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(w_rest AS DOUBLE) END AS target
  FROM r
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / CAST(t.source_size AS DOUBLE)) AS BIGINT) ELSE 0 END AS whole
  FROM d JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN CAST(before * 2 + size AS DOUBLE) < (target - CAST(whole * source_size AS DOUBLE)) * 2 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

OP5_SQL = """
WITH RECURSIVE step AS (
  SELECT i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8
), d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS UBIGINT))),
                              lambda c, b: xor(c >> 8, crc.t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32
  FROM documents, crc
), r AS (
  SELECT *, md5(concat_ws('|', 'shard-1', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR))) AS draw FROM d
), s AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY skey ORDER BY draw, doc_id NULLS FIRST, size, text_crc32) - 1 AS DOUBLE) / CAST(2 * count(*) OVER (PARTITION BY skey) AS DOUBLE) AS share FROM r
), a AS (
  SELECT *, row_number() OVER (ORDER BY share, draw, doc_id NULLS FIRST, encode(source) NULLS FIRST, size, text_crc32) - 1 AS pos, count(*) OVER () AS total FROM s
), p AS (
  SELECT *, CAST(pos * 24 // total AS INT) AS shard FROM a
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(pos - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source FROM p
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT rn, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS gram
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0
), n AS (
  SELECT rn, count(*) AS n FROM g GROUP BY rn
), o AS (
  SELECT a.rn AS a, b.rn AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.rn < b.rn GROUP BY ALL
), l AS (
  SELECT o.a, o.b FROM o JOIN n x ON o.a = x.rn JOIN n y ON o.b = y.rn WHERE 100 * common >= 80 * (x.n + y.n - common)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT rn, rn AS other FROM w
  UNION
  SELECT reach.rn, e.b FROM reach JOIN e ON reach.other = e.a
), c AS (
  SELECT reach.rn, min(w.doc_id) AS component_id FROM reach JOIN w ON reach.other = w.rn GROUP BY reach.rn
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN c USING (rn) LEFT JOIN n USING (rn)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_audio_fingerprint": op3_audio_fingerprint,
        "op4_warc": op4_warc,
        "op5_sharding": op5_sharding,
        "op6_quality_lm": op6_quality_lm,
        "op7_language_id": op7_language_id,
        "pages_language_id": pages_language_id,
        "op8_ngram_join": op8_ngram_join,
        "op9_packing": op9_packing,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_warc": OP4_SQL, "op5_sharding": OP5_SQL, "op8_ngram_join": OP8_SQL, "op10_exact_dedup": OP10_SQL}
