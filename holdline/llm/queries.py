"""The registered queries of the text operators, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdline.llm import chat, common, decontaminate, html_text, jaccard, mixing, pivots, pseudonyms, quality, token_blocks, token_counts, vector_codes, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn

# Wanted shares of the sources in a mixture as large as what goes in; those of sources
# without a name here, and of documents without a source, are MIX_DEFAULT.
MIX_WEIGHTS = {f"src{i}": 2.0 if i < 5 else 1.0 for i in range(20)}
MIX_DEFAULT = 1.0
MIX_FACTOR, MIX_SEED = 1.0, 2024


@_query
def op1_html_text(spark, sf_dir):
    return html_text.extract(common.table(spark, sf_dir, "pages"))


@_query
def op2_mixing(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return mixing.mixed(docs, MIX_WEIGHTS, MIX_FACTOR, MIX_SEED, default=MIX_DEFAULT)


ORACLES["op2_mixing"] = mixing.mixed_sql(
    MIX_WEIGHTS, MIX_FACTOR, MIX_SEED, "doc_id, text, lang, source, n_chars", default=MIX_DEFAULT
)


@_query
def op3_embedding_near_dedup(spark, sf_dir):
    return pivots.near_duplicates(common.table(spark, sf_dir, "embeddings"))


@_query
def op4_token_counts(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    cache = common.new_folder(spark, "token-counts")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)


@_query
def op8_token_blocks(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "token-blocks")
    token_blocks.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_blocks.read_documents(spark, folder)


@_query
def op10_jaccard_join(spark, sf_dir):
    return jaccard.similar_documents(common.table(spark, sf_dir, "documents"))


@_query
def op5_quality(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return quality.classified(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


@_query
def op6_decontaminate(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    return decontaminate.matches(docs, common.table(spark, sf_dir, "benchmark"))


# A demonstration key; a job brings its own secret.
PSEUDONYM_KEY = b"demonstration only"


@_query
def op7_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonymized(common.table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@_query
def op9_warc(spark, sf_dir):
    return warc.page_summary(spark, common.table(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))


ORACLES["op9_warc"] = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> keeper THEN keeper END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY digest) AS keeper
  FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n,
    sha256(coalesce(html, '')) AS digest FROM pages))
"""


# A conversation that says control strings, beside those of the table.
CONTROL_STRINGS = """SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"""


@_query
def op12_chat_format(spark, sf_dir):
    table = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    written = common.written(chat.formatted(table.unionByName(spark.sql(CONTROL_STRINGS))), "chat")
    read = written.select("conv_id", chat.text_of().alias("formatted"), chat.loss_text().alias("loss"))
    read = read.withColumn("turns", chat.turns_of(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


# Read from the table, not from the formatted text; its length is counted from what the
# template adds to each turn.
ORACLES["op12_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on, lead(role) OVER w IS NOT DISTINCT FROM role AS more,
    row_number() OVER w AS i,
    length(regexp_replace(text, '([\[<])(\\*/?(?:INST\]|ROLE\]|IS\]|SEP\]|s>))', '\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '([\[<])(\\*/?(?:INST\]|ROLE\]|IS\]|SEP\]|s>))', '\1\\\2', 'g')) AS m
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n
    + CASE WHEN goes_on THEN 0 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 0 ELSE 13 + m END
    + CASE WHEN more THEN 5 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 4 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""


@_query
def op11_vector_codes(spark, sf_dir):
    codes, books = vector_codes.compressed(common.table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


# Every part against every entry; the least of 64 * distance + index is the nearest entry,
# the lowest of equals.
_VECTOR_PARTS = """
kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS (SELECT vec_id, p, x[4 * p + 1] AS a, x[4 * p + 2] AS b, x[4 * p + 3] AS c, x[4 * p + 4] AS d
  FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, a, b, c, d
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64))"""


def _nearest_sql(n: int) -> str:
    return f"""near{n} AS (SELECT vec_id, p, min(64 * ((s.a - e.a) * (s.a - e.a) + (s.b - e.b) * (s.b - e.b)
    + (s.c - e.c) * (s.c - e.c) + (s.d - e.d) * (s.d - e.d)) + k) AS m
  FROM parts s JOIN book{n} e USING (p) GROUP BY vec_id, p)"""


def _means_sql(n: int) -> str:
    mean = lambda x: f"CASE WHEN count(s.p) = 0 THEN any_value(e.{x}) ELSE CAST(floor(sum(s.{x}) / count(s.p)) AS BIGINT) END AS {x}"
    return f"""book{n + 1} AS (SELECT e.p, e.k, {", ".join(map(mean, "abcd"))}
  FROM book{n} e LEFT JOIN (SELECT parts.*, m % 64 AS k FROM parts JOIN near{n} USING (vec_id, p)) s
    ON s.p = e.p AND s.k = e.k GROUP BY e.p, e.k)"""


ORACLES["op11_vector_codes"] = f"""
WITH {_VECTOR_PARTS},
{_nearest_sql(0)}, {_means_sql(0)}, {_nearest_sql(1)}, {_means_sql(1)}, {_nearest_sql(2)},
codes AS (SELECT vec_id, string_agg(printf('%02x', m % 64), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


@_query
def op13_whitening(spark, sf_dir):
    rows = whitening.components(common.table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))
