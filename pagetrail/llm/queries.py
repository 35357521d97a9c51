"""One query per operator, over whole tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, codec, decontaminate, exact, extract, jaccard, langid, oracles, quality, shards, spelling, tokens, urlfilter
from .common import PIECES, TIKTOKEN, TOKENIZER, in_batches, table

#: Rules of op8: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Shards and seed of op13.
SHARDS, SHARD_SEED = 24, 13


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations, reads the output back and digests what it finds, turn by turn."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    blocks = chat.read_back(chat.format_blocks(rows)).select(
        "conv_id", "block", F.length("formatted").cast("long").alias("formatted_chars"), "turns", "loss"
    )
    # each conversation's blocks stream by in order; only digests are held
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                now[5] += row["formatted_chars"]
                for turn, in_loss in zip(row["turns"], row["loss"], strict=True):
                    now[6] = now[6] if turn["role"] is None else turn["role"]
                    now[1] += 1
                    now[2].update(f"{now[6]}\n{turn['text']}\n".encode())
                    if in_loss:
                        now[3] += len(turn["text"])
                        now[4].update(turn["text"].encode())
            yield digested(done)
        if now is not None:
            yield digested([now])

    def digested(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [
                {
                    "conv_id": c,
                    "n_turns": n,
                    "turns_sha256": turns.hexdigest(),
                    "loss_chars": chars,
                    "loss_sha256": loss.hexdigest(),
                    "formatted_chars": size,
                }
                for c, n, turns, chars, loss, size, _ in rows
            ],
            schema=pa.schema(
                [
                    ("conv_id", pa.int64()),
                    ("n_turns", pa.int64()),
                    ("turns_sha256", pa.string()),
                    ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()),
                    ("formatted_chars", pa.int64()),
                ]
            ),
        )

    return in_batches(
        ordered,
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the hash of texts that need no comparison is added for the result alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_rows(docs)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item occurs, with the least distance."""
    docs = table(spark, sf_dir, "documents")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.token_counts(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learned_part())
    rated = quality.rate(docs, model)
    return rated.select("doc_id", (~quality.learned_part()).alias("held_out"), "score", "predicted")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return codec.digests(docs, public_tokenizers.path(TIKTOKEN), public_tokenizers.PATTERN)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, langid.learned_part())
    found = langid.identify(docs, model)
    return found.select("doc_id", (~langid.learned_part()).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word one edit away that they may be a variant of."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and corpus-wide counts of links of two tokenizers, by document."""
    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), (path(TOKENIZER), path(PIECES), public_tokenizers.PATTERN))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``; it takes rows one by one, so equal texts stay no group."""
    return shards.shard(table(spark, sf_dir, "documents"), shards=SHARDS, seed=SHARD_SEED, keep=("doc_id",))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_extract": op4_html_extract,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_sharding": op13_sharding,
}

ORACLE = {
    "op1_chat_format": r"""
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        shaped AS (
          SELECT *, replace(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '<turn/>', '<\turn/>'),
                            '</turn>', '<\/turn>') AS escaped,
                 lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place
          FROM said)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(escaped) + 7
                        + CASE WHEN previous = role THEN 0 ELSE 6 + length(role) END)
                    + count(*) FILTER (previous <> role) AS BIGINT) AS formatted_chars
        FROM shaped GROUP BY conv_id""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op8_url_filter": r"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
               ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        parts AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
          FROM pages)
        SELECT page_id, host, path,
               (SELECT arg_max(r_host || r_path, length(r_host || r_path)) FROM rules
                WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
               coalesce((SELECT arg_max(r_verdict, length(r_host || r_path)) FROM rules
                WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
        FROM parts""",
    "op11_spelling": oracles.spelling(spelling.EVERY, spelling.LETTERS, spelling.OCCURRENCES, spelling.TIMES),
    "op13_sharding": oracles.sharding(SHARDS, SHARD_SEED),
}
