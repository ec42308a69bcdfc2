"""The training-data operators as queries over whole tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, decontam, html, jaccard, langid, neighbours, periodic, quality, secretscan, tokenfile, urlrules, vectorcode
from tidemill.llm.common import fresh_path, held_out, table, written
from tidemill.llm.sql import OP11_SQL, OP12_SQL


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 4, 2)
    model = langid.train(docs, ~held)
    found = langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"), chat.tool_parameters(spark))


#: No message of the table calls a tool, so SQL has only the ordinary lines to say; links are tested on fixtures.
OP3_SQL = """
SELECT conv_id, turn, CAST(-1 AS INTEGER) AS part, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id,
       turn AS anchor_turn, CAST(0 AS INTEGER) AS level, 'ok' AS status,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS line
FROM conversations
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out("doc_id", 5, 0)
    net = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), net, keep=["held_out"]).select("doc_id", "held_out", "score", "predicted")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, urlrules.RULES))


OP5_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(action, rule, h, p) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), m AS (
  SELECT u.page_id, r.rule, r.action, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC, r.rule DESC) AS rn
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.rn = 1
"""


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    files = written(tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json")), "token-file-list")
    docs = tokenfile.with_starts(tokenfile.read_token_files(spark, path), files)
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), common=True)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    of = secretscan.of_kinds
    counts = [F.size(of((kind,))).cast("long").alias(f"n_{kind}") for kind in secretscan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secretscan.listed(of(secretscan.BASE_KINDS)), 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.compress(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(table(spark, sf_dir, "documents"), plant=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[name].cast("string") for name in ("start", "length", "period")]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_url_rules": op5_url_rules,
    "op6_main_text": op6_main_text,
    "op7_jaccard": op7_jaccard,
    "op8_token_files": op8_token_files,
    "op9_decontaminate": op9_decontaminate,
    "op10_neighbours": op10_neighbours,
    "op11_secrets": op11_secrets,
    "op12_vector_codes": op12_vector_codes,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op3_chat_format": OP3_SQL, "op5_url_rules": OP5_SQL, "op11_secrets": OP11_SQL, "op12_vector_codes": OP12_SQL}
