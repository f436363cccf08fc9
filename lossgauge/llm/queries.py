"""Queries of the corpus operators on the given tables, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgauge.llm import (
    exact_dedup,
    fill_in_middle,
    line_dedup,
    ordinal,
    packing,
    periodic_runs,
    pii,
    piece_lattice,
    quality_rules,
    records,
    sharding,
    simhash,
    toxicity,
)
from lossgauge.llm.common import documents
from lossgauge.session import intermediate_folder
from lossgauge.sources.delimited import read_table

# the key of the test tables; a production job takes its own from its secret store
MASKING_KEY = b"test tables only"


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query("""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS chars,
               sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) = 1 AS kept, text_sha256
    FROM n
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.one_per_row(exact_dedup.exact_duplicates(documents(spark, sf_dir))).drop("chars")


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.classify(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


@query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whole in a file of one of 64 shards, and read back from there."""
    placed = sharding.place(documents(spark, sf_dir), [f"shard-{i:03d}" for i in range(64)])
    folder = intermediate_folder(spark)
    sharding.write_shards(placed, folder)
    stored = sharding.read_shards(spark, folder, placed.schema)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "slot", "shard", digest)


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer(), end_id=1)


@query(
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), n AS (
        SELECT doc_id, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM d
    ), p AS (SELECT doc_id, n_words, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM n),
    g AS (
        SELECT doc_id, pos,
               CASE WHEN pos <= n_words - 2 THEN list(word) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS w3,
               CASE WHEN pos <= n_words - 7 THEN list(word) OVER (w ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS w8,
               CASE WHEN pos <= n_words - 100
                    THEN md5(array_to_string(list(word) OVER (w ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING), ' ')) END AS w101
        FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ), c AS (
        SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
               w8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w8) > 1 AS r8,
               w101 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w101) > 1 AS r101
        FROM g
    ), v AS (
        SELECT doc_id, r101, bool_or(r3) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
               bool_or(r8) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
        FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
    ), s AS (
        SELECT doc_id, count(*) FILTER (c3) AS n_repeat_words, count(*) FILTER (c8) AS covered, bool_or(r101) AS long_repeat
        FROM v GROUP BY doc_id
    ), t AS (
        SELECT n.doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered, 0) AS covered,
               coalesce(long_repeat, false) AS long_repeat
        FROM n LEFT JOIN s ON n.doc_id = s.doc_id
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered <= 0.3 * n_words AND NOT long_repeat AS kept
    FROM t
"""
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


@query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: one point for quality, one for not being toxic. Documents that likely have both are kept."""
    docs = documents(spark, sf_dir)
    grade = (F.col("quality") + 1 - F.col("toxic")).alias("grade")
    model = ordinal.learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", grade), n_grades=3)
    return ordinal.select(docs, model, grade=2)


@query()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return pii.mask(docs, MASKING_KEY, count_col="n_replaced")


@query()
def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(documents(spark, sf_dir), tokenizer(), end_id=2)


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and what they decode to."""
    return piece_lattice.round_trip(documents(spark, sf_dir), piece_lattice.load(tokenizer("piece_bpe_32k.model")))


def _cycled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the contract of op11 gives a document: in every tenth by checksum, a stretch goes on to the end."""
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * ((n - a) // period + 1))[: n - a]


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(documents(spark, sf_dir), prepare=_cycled)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ended = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(ended.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query(r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
        FROM documents
    ), h AS (
        SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
               CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(tokens) + 1) AS x,
               CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(tokens) + 1) AS y,
               CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
        FROM d
    ), c AS (
        SELECT doc_id, text, n,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                    THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
               coalesce(array_to_string(tokens[1:least(x, y)], ''), '') AS prefix,
               coalesce(array_to_string(tokens[least(x, y) + 1:greatest(x, y)], ''), '') AS middle,
               coalesce(array_to_string(tokens[greatest(x, y) + 1:], ''), '') AS suffix
        FROM h
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM c
""")
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return made.select(
        *["doc_id", "n", "form", "prefix_chars", "middle_chars"],
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


@query(r"""
    WITH l AS (
        SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    ), k AS (
        SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
""")
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = line_dedup.drop_common_lines(docs, batches=line_dedup.batches_of_files(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
