"""Exact duplicates by block naming.

The normalised text is cut into fixed-size blocks. Equal blocks get the same integer name, different blocks different
names; then adjacent names are paired and each distinct pair is named, round after round, until every document has one
name. Documents are equal exactly if they end in the same round with the same name: no hash decides. (Rows that share a
doc_id, or have none, are told apart by a 64-bit hash of their text before that.)

Only DataFrame functions are used. The text is shuffled once, distinct blocks only, after a partial distinct on the map
side; later rounds move three integers per block and halve each time. A hot block or pair is one row after the
partial distinct. The tables of names are stored before they are joined: with a grouping on the join's own key below it
a join can't be split, so a block or pair that very many documents share would go to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossgauge.llm.common import BLANKS, free_names, null_safe_join, whole_text
from lossgauge.session import stable

BLOCK_BYTES = 2048
COPIES_AT_ONCE = 1 << 16
KEY = ["doc_id", "variant"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANKS}+", "")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``variant`` only tells apart rows that share a doc_id; it plays no part in finding equal documents."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(whole_text(text_col)).alias("chars"),
        normalised(whole_text(text_col)).alias("norm"),
    ).withColumn("variant", F.xxhash64("norm"))


def _blocks(texts: DataFrame, size: int, block_hash) -> DataFrame:
    """One row per block. The empty text has one empty block."""
    data = F.col("norm").cast("binary")
    number = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / F.lit(size)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * size + 1, F.lit(size)))
    return (
        texts.select(*KEY, data.alias("data"), number.alias("n"))
        .select(*KEY, "n", F.posexplode(cut).alias("pos", "block"))
        .withColumn("h", block_hash(F.col("block")))
    )


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, variant, n, pos, name): distinct blocks are sorted and numbered, and blocks look their number up.

    The look-up goes by hash, so that the text needn't travel a second time. Where one hash stands for several
    distinct blocks, the i-th of them in text order gets the i-th of its names, and the look-up goes by text.
    """
    distinct = blocks.select("h", "block").distinct()
    numbered = stable(
        distinct.sortWithinPartitions("block").select("h", F.monotonically_increasing_id().alias("name"))
    )
    by_hash = stable(numbered.groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("k")))
    rows = blocks.select(*KEY, "n", "pos", "h")
    shared = by_hash.where("k > 1").select("h")
    if shared.isEmpty():
        return rows.join(by_hash, "h").select(*KEY, "n", "pos", "name")
    rank = F.row_number()
    texts = distinct.join(shared, "h", "left_semi")
    texts = texts.withColumn("r", rank.over(Window.partitionBy("h").orderBy("block")))
    names = numbered.join(shared, "h", "left_semi")
    names = names.withColumn("r", rank.over(Window.partitionBy("h").orderBy("name")))
    by_text = stable(texts.join(names, ["h", "r"]).select("h", "block", "name"))
    alone = rows.join(by_hash.where("k = 1"), "h").select(*KEY, "n", "pos", "name")
    return alone.unionByName(blocks.join(by_text, ["h", "block"]).select(*KEY, "n", "pos", "name"))


def _name_pairs(rows: DataFrame) -> DataFrame:
    """One round: adjacent names become pairs, and equal pairs get one new name. -1 stands beside an odd last name."""
    even = F.col("pos") % 2 == 0
    pairs = rows.groupBy(*KEY, "n", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
    )
    pairs = stable(pairs)
    named = stable(
        pairs.select("left", "right")
        .distinct()
        .sortWithinPartitions("left", "right")
        .withColumn("name", F.monotonically_increasing_id())
    )
    half = F.floor((F.col("n") + 1) / 2).cast("int").alias("n")
    return pairs.join(named, ["left", "right"]).select(*KEY, half, "pos", "name")


def identities(texts: DataFrame, block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64) -> DataFrame:
    """(doc_id, variant, level, name): equal texts have equal (level, name), different texts differ.

    Names are row numbers, so each round is stored before it is read again.
    """
    rows = stable(_name_blocks(_blocks(texts, block_bytes, block_hash)))
    found, level = [], 0
    while True:
        done = rows.where("n = 1").select(*KEY, F.lit(level).alias("level"), "name")
        found.append(done.distinct())
        rows = rows.where("n > 1")
        if rows.isEmpty():
            break
        rows, level = stable(_name_pairs(rows)), level + 1
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_hash=F.xxhash64
) -> DataFrame:
    """Group documents with equal text, white space aside.

    Returns (doc_id, keep_id, group_size, kept, text_sha256, chars, rows) with one row per document; group_size counts
    rows. Of equal texts the
    one with the most characters before normalisation stays, then the smallest doc_id.

    Null text counts as empty; all empty texts are equal. A null doc_id is an id of its own that loses every tie.
    Rows that repeat both doc_id and normalised text are one document, and ``rows`` counts them; rows that share only
    the doc_id are documents of their own. Other columns are ignored. An empty table gives an empty result.
    """
    texts = _texts(docs, id_col, text_col)
    heads = texts.groupBy(*KEY, F.sha2("norm", 256).alias("text_sha256")).agg(
        F.max("chars").alias("chars"), F.count("*").alias("rows")
    )
    named = stable(null_safe_join(heads, identities(texts, block_bytes, block_hash), KEY))
    best = F.max(F.struct(F.col("chars"), (-F.col("doc_id")).alias("back")))
    # stored, so that nothing but the join needs the rows of a large group together, and it can be split
    groups = stable(named.groupBy("level", "name").agg(best.alias("best"), F.sum("rows").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        (-F.col("best.back")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.struct("chars", (-F.col("doc_id")).alias("back")).eqNullSafe(F.col("best"))).alias("kept"),
        "text_sha256",
        F.col("chars").cast("long").alias("chars"),
        "rows",
    )


def one_per_row(verdict: DataFrame) -> DataFrame:
    """The result of ``exact_duplicates`` with a row for each input row. Of the rows of a document that stays, one stays."""
    # in two steps, so that no array grows with the number of copies
    blocks = verdict.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES_AT_ONCE))))
    left = F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("rows") - F.col("__block") * COPIES_AT_ONCE)
    copies = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    first = (F.col("__block") == 0) & (F.col("__copy") == 1)
    return copies.withColumn("kept", F.col("kept") & first).drop("rows", "__block", "__copy")


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Rows that repeat one document leave one row."""
    doc, text_sha, length, verdict_id, sha, chars = free_names(docs, "__doc", "__text_sha", "__length", "__id", "__sha", "__chars")
    verdict = exact_duplicates(docs, id_col, text_col).where("kept")
    verdict = stable(
        verdict.select(
            F.col("doc_id").alias(verdict_id), F.col("text_sha256").alias(sha), F.col("chars").alias(chars), "rows"
        )
    )
    marked = docs.withColumns(
        {
            doc: F.col(id_col).cast("long"),
            text_sha: F.sha2(normalised(whole_text(text_col)), 256),
            length: F.length(whole_text(text_col)).cast("long"),
        }
    )
    same = (
        F.col(doc).eqNullSafe(F.col(verdict_id)) & (F.col(text_sha) == F.col(sha)) & (F.col(length) == F.col(chars))
    )
    once = marked.join(verdict.where("rows = 1").drop("rows"), same, "left_semi").select(*docs.columns)
    repeated = verdict.where("rows > 1").drop("rows")
    if repeated.isEmpty():
        return once
    # whole rows are shuffled once more for documents that came several times only
    first = marked.join(repeated, same, "left_semi").dropDuplicates([doc, text_sha])
    return once.unionByName(first.select(*docs.columns))
