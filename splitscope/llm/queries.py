"""The operators of this subpackage as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitscope.llm import chat, collocations, langid, minhash, mixing, pieces, quality, ranked, search, sharding, simhash, tokens, warc
from splitscope.llm.common import crc_mod


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).taken()


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 as a query, with its whole text, against all documents."""
    docs = _documents(spark, sf_dir)
    return search.bm25_top_k(docs, docs.filter(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id"), k=10)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("mark")
    )
    return sharding.shard(rows, 24, key=("doc_id", "mark")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("long").alias("grown_shard"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held_out)
    scored = quality.with_quality(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return scored.drop("text").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_likeness(_documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read_archives(warc.write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs, learn=~held_out)
    return langid.with_language(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: length, checksum and round trip of its best segmentation, scores of the four best."""
    model = tokenizer_path("piece_bpe_32k.model")
    found = pieces.with_pieces(_documents(spark, sf_dir).select("doc_id", "text"), model, n=4)
    found = pieces.decoded(found.withColumn("ids", F.col("pieces.ids")), model, "ids")
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.expr("transform(pieces.nbest, x -> x.score)").alias("scores"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_corpus(tokens.write_corpus(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    odd = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    read = chat.read_conversations(chat.format_conversations(turns))
    return read.withColumn("rewritten", F.col("rewrites").isNotNull().cast("long")).drop("rewrites")


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_search": op3_search,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_pieces": op9_pieces,
    "op10_token_ids": op10_token_ids,
    "op11_collocations": op11_collocations,
    "op12_chat": op12_chat,
    "op13_ranked": op13_ranked,
}

# In SQL: a text, null as empty, with A-Z alone lower-cased.
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op7_warc": r"""
WITH payloads AS (
  SELECT page_id, url, coalesce(html, '') AS payload FROM pages
), digests AS (
  -- base32: every 5 hexadecimal digits are 20 bits, four signs of 5 bits
  SELECT payload, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest
  FROM (SELECT payload, sha1(payload) AS h FROM (SELECT DISTINCT payload FROM payloads))
), numbered AS (
  SELECT page_id, payload, row_number() OVER w AS nth, first_value(page_id) OVER w AS top FROM payloads
  WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN top END AS refers_to
FROM numbered JOIN digests USING (payload)
""",
    "op11_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM words, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k)
), counts AS MATERIALIZED (
  SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cand AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), inner_phrases AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS b
  FROM (SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i
        FROM cand, (VALUES (2), (3)) AS ms(m) WHERE m < k) GROUP BY ALL
), held AS (
  SELECT c.* FROM cand c LEFT JOIN inner_phrases p ON p.lang = c.lang AND p.phrase = c.phrase
  WHERE p.b IS NULL OR 100 * CAST(p.b AS HUGEINT) < 80 * CAST(c.a AS HUGEINT)
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS x, array_to_string(list_slice(w, cut + 1, k), ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM held)
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, c.cut, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.x JOIN counts r ON r.lang = c.lang AND r.phrase = c.y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
) JOIN sizes USING (lang) WHERE rank <= 2000
""",
    "op12_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, role = 'assistant' AS learned, {esc_text} AS chars, {esc_role} + length(role) - length(replace(role, ']', '')) AS role_chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (learned), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learned), '')) AS loss_sha256,
       CAST(3 + sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE role_chars + 16 END) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS rewritten
FROM sized GROUP BY conv_id
""",
    "op13_ranked": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(""" + _ASCII_LOWER + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(""" + _ASCII_LOWER + r""", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), totals AS (
  SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM docs
), tf AS MATERIALIZED (
  SELECT doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM tf JOIN items USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
WHERE rank <= 10
""",
}


def _escaped_length(column: str) -> str:
    """Length of a text after the chat template's escapes: one sign more for each control string or backslash."""
    out = f"length({column})"
    for sign in (chr(92), *chat.CONTROL):
        out += f" + (length({column}) - length(replace({column}, '{sign}', ''))) // {len(sign)}"
    return out


ORACLE_SQL["op12_chat"] = ORACLE_SQL["op12_chat"].replace("{esc_text}", _escaped_length("text")).replace("{esc_role}", _escaped_length("role"))
