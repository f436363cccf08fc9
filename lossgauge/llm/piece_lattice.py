"""SentencePiece encoding and decoding as relations.

Text falls into words at places that no piece spans. Distinct words are counted; each explodes into its substrings of
bounded length, an equi-join with the piece table leaves the edges of its lattice, and edges are grouped by word. A
higher-order aggregate then folds the lattice into the word's pieces: by Viterbi for a unigram model, and by merges,
best score first, for a byte-pair model, whose own encoding is not the path of the best summed score. Its edges come in
order of score, and its boundaries are the bits of one number, so that a merge copies nothing. A single character merges
nothing and is no edge there: where one is left, its id comes from a table by code point.

Documents look the pieces of their words up. The most frequent words, up to a stated number, are broadcast; the rest
are joined by word and handed to the documents that hold them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossgauge.llm.common import lean_memory, whole_text
from lossgauge.session import intermediate_folder, intermediate_tables, stable

SPACE = "▁"
# words that every task holds in memory, and the longest of them in bytes
FREQUENT = 1 << 19
FREQUENT_BYTES = 64
# a fold over n characters takes n * n steps; longer words are folded with a heap
LONGEST_FOLD = 64
WORDS_OF_A_TASK = 50_000
# a task works on texts of so many bytes at a time, or on one that is longer
BYTES_AT_ONCE = 4 << 20
# ids are read as one number of 32-bit digits, the first id the highest, modulo this
MODULUS = (1 << 31) - 1

# runs of letters and runs of other characters, each with the spaces before it
_LETTERS = re.compile(r"[^\W\d_²³¹¼½¾]+")
_FINE = re.compile(r" *[^\W\d_²³¹¼½¾]+| *(?:[^\w ]|[\d_²³¹¼½¾])+| +")
_COARSE = re.compile(r" *[^ ]+| +")


@dataclass(frozen=True)
class Model:
    kind: str
    pieces: tuple[tuple[str, int, float], ...]  # text with plain spaces, id, score
    byte_base: int  # id of byte 0; the others follow
    unknown: int
    special: tuple[int, ...]  # ids without text
    dummy_prefix: bool
    words: re.Pattern

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @property
    def unknown_score(self) -> float:
        return min(s for _, _, s in self.pieces) - 10.0


def load(path: str) -> Model:
    """Read a SentencePiece model file. Models that rewrite text, or have no pieces for bytes, are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    raw = proto.ModelProto()
    with open(path, "rb") as file:
        raw.ParseFromString(file.read())
    kinds = proto.ModelProto.SentencePiece
    kind = {1: "unigram", 2: "bpe"}.get(raw.trainer_spec.model_type)
    rules = raw.normalizer_spec
    if kind is None or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only unigram and byte-pair models that leave the text as it is are supported")
    pieces, special, of_bytes, unknown = [], [], {}, 0
    for i, p in enumerate(raw.pieces):
        if p.type == kinds.BYTE:
            of_bytes[int(p.piece[3:5], 16)] = i
        elif p.type == kinds.NORMAL:
            pieces.append((p.piece.replace(SPACE, " "), i, p.score))
        elif p.type == kinds.UNKNOWN:
            unknown = i
        else:
            special.append(i)
    if [of_bytes.get(b, -1) - of_bytes.get(0, 0) for b in range(256)] != list(range(256)):
        raise ValueError("the model has no pieces for bytes")
    words = next((w for w in (_FINE, _COARSE) if all(w.findall(p) == [p] for p, _, _ in pieces)), None)
    if words is None:
        raise ValueError("a piece spans words")
    return Model(kind, tuple(pieces), of_bytes[0], unknown, tuple(special), rules.add_dummy_prefix, words)


def character_kinds(model: Model) -> np.ndarray:
    """For each code point 0 if it is a space, else one of two kinds. A word has spaces first, then one kind."""
    kinds = np.ones(0x110000, "u1")
    if model.words == _FINE:
        for run in _LETTERS.finditer("".join(map(chr, range(len(kinds))))):
            kinds[run.start() : run.end()] = 2
    kinds[ord(" ")] = 0
    return kinds


def split_words(texts: pa.StringArray, kinds: np.ndarray, dummy_prefix: bool) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    texts = pc.replace_substring(texts, SPACE, " ")
    if dummy_prefix:
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
    if not len(texts) or not (data := texts.buffers()[2]) or not data.size:
        return pa.array([], pa.string()), np.zeros(len(texts), "i8")
    ends = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(data, "u1")[ends[0] : ends[-1]]
    ends -= ends[0]
    of_byte = kinds[np.r_[0:128, [0] * 128]][data]
    # characters of several bytes
    leads = np.flatnonzero(data >= 0xC0)
    first = data[leads].astype("i4")
    more = 1 + (first >= 0xE0) + (first >= 0xF0)
    points = first & (0x3F >> more)
    for k in (1, 2, 3):
        points = np.where(more >= k, points << 6 | data[np.minimum(leads + k, len(data) - 1)] & 0x3F, points)
    for k in (0, 1, 2, 3):
        of_byte[leads[more >= k] + k] = kinds[points[more >= k]]
    begins = np.ones(len(data) + 1, bool)
    begins[1:-1] = (of_byte[1:] != of_byte[:-1]) & (of_byte[:-1] != 0)
    begins[ends] = True
    places = np.flatnonzero(begins)
    words = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype("i4")), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(places, ends))


def _slices(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``BYTES_AT_ONCE`` in all, or of one row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BYTES_AT_ONCE:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes):
        yield start, len(sizes)


def _byte_ids(text: str, model: Model) -> list[int]:
    return [model.byte_base + b for b in text.encode("utf-8", "surrogatepass")]


def merge_word(word: str, pieces: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """Pieces of a byte-pair model for one word: of all neighbours the best score merges first, the left one of equals."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []  # (-score, start, end)

    def offer(start: int) -> None:
        if start >= 0 and after[start] < n:
            end = after[after[start]]
            if word[start:end] in pieces:
                heapq.heappush(heap, (-pieces[word[start:end]][1], start, end))

    for i in range(n):
        offer(i)
    while heap:
        _, start, end = heapq.heappop(heap)
        if alive[start] and after[start] < n and after[after[start]] == end:
            alive[after[start]] = False
            after[start] = end
            if end < n:
                before[end] = start
            offer(before[start])
            offer(start)
    out, at = [], 0
    while at < n:
        part = word[at : after[at]]
        out += [pieces[part][0]] if part in pieces else _byte_ids(part, model)
        at = after[at]
    return out


def viterbi_word(word: str, pieces: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """Pieces of a unigram model for one word: the path of the best summed score."""
    n, longest = len(word), model.longest
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * n
    for start in range(n):
        for end in range(start + 1, min(n, start + longest) + 1):
            known = pieces.get(word[start:end])
            if known or end == start + 1:
                score = best[start][0] + (known[1] if known else model.unknown_score)
                if score > best[end][0]:
                    best[end] = (score, start)
    out, at = [], n
    while at:
        start = best[at][1]
        part = word[start:at]
        out[:0] = [pieces[part][0]] if part in pieces else _byte_ids(part, model)
        at = start
    return out


def count_words(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts. Each task counts ahead of the shuffle."""
    kinds = docs.sparkSession.sparkContext.broadcast(character_kinds(model))

    def count(batches):
        lean_memory()
        for batch in batches:
            texts, counts = batch.column(0), []
            for start, end in _slices(pc.binary_length(texts).to_pylist()):
                words, _ = split_words(texts[start:end], kinds.value, model.dummy_prefix)
                found = words.value_counts()
                counts.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            if counts:
                total = pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")])
                yield from total.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches()

    counted = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _edges(words: DataFrame, table: DataFrame, model: Model, least: int = 1) -> DataFrame:
    """(word, n, start, size) and the other columns of ``table`` for each piece of ``least`` characters and more in the word.

    The piece table has the size of the vocabulary and is broadcast. It is looked up by a hash, as one number is found
    faster than a text, and the texts are compared: either begins with the other. The substring before the first, of
    start -1, is always a piece: no word gets lost.
    """
    most = max(model.longest, least)
    first = F.lit(model.pieces[0][0])
    starts = words.select("word", "n", F.expr(f"explode(sequence(-1, length(word) - {least}))").alias("start"))
    rests = starts.withColumn("rest", F.when(F.col("start") < 0, first).otherwise(F.expr(f"substring(word, start + 1, {most})")))
    lengths = F.expr(f"explode(sequence({least}, IF(start < 0, {least}, least({most}, length(word) - start))))")
    spans = rests.select("word", "n", "start", "rest", lengths.alias("size"))
    spans = spans.withColumn("part", F.when(F.col("start") < 0, F.col("rest")).otherwise(F.expr("substring(rest, 1, size)")))
    same = F.col("piece").startswith(F.col("part")) & F.col("part").startswith(F.col("piece"))
    hashed = table.withColumn("hash", F.xxhash64("piece"))
    found = spans.withColumn("part_hash", F.xxhash64("part")).join(F.broadcast(hashed), (F.col("part_hash") == F.col("hash")) & same)
    return found.drop("rest", "part", "part_hash", "hash", "piece")


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, edges): a map from start * 128 + length to (id, score) of each piece in the word.

    Words that are dealt out by word stay where they are, so edges are grouped without a shuffle.
    """
    spark: SparkSession = words.sparkSession
    table = spark.createDataFrame(list(model.pieces), "piece string, id int, score double")
    key = F.when(F.col("start") < 0, F.lit(-128)).otherwise(F.col("start") * 128 + F.col("size"))
    entry = F.struct(key.alias("key"), F.struct("id", "score").alias("edge"))
    return _edges(words, table, model).groupBy("word", "n").agg(F.map_from_entries(F.collect_list(entry)).alias("edges"))


def ranked_pieces(model: Model) -> list[tuple[str, int]]:
    """Each piece with a number: its place by score, the best first and equals alike, whether a piece that is no worse
    begins or ends with it, and its id, in 20, 1 and 28 bits."""
    places = {score: i for i, score in enumerate(sorted({s for _, _, s in model.pieces}, reverse=True))}
    scores = {p: s for p, _, s in model.pieces}
    if len(places) >= 1 << 20 or max(i for _, i, _ in model.pieces) >= 1 << 28:
        raise ValueError("too many pieces")
    reopens = set()
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            reopens |= {part for part in (piece[:cut], piece[cut:]) if scores.get(part, float("inf")) <= score}
    return [(p, places[s] << 29 | (p in reopens) << 28 | i) for p, i, s in model.pieces]


def ordered_lattice(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, edges): the pieces of two characters and more in the word in order of score, the left ones of equals first.

    An edge is one number: place by score, start, length, the mark of ``ranked_pieces`` and id, in 20, 7, 7, 1 and 28
    bits. With it come the boundaries inside it and those at its ends, but for the start of the word: boundaries after
    each character are bits of one number, the first the lowest. Like ``lattice`` it takes no shuffle.
    """
    table = words.sparkSession.createDataFrame(ranked_pieces(model), "piece string, code long")
    edge = F.expr("""
        IF(start < 0, null, named_struct(
            'edge', shiftleft(shiftrightunsigned(code, 29), 43) | cast(start * 128 + size AS bigint) * 536870912 | code & 536870911,
            'inside', shiftleft(shiftrightunsigned(-1L, 65 - size), start),
            'ends', shiftrightunsigned(shiftleft(1L, start), 1) | shiftleft(1L, start + size - 1)))
    """)
    found = _edges(words, table, model, least=2).select("word", "n", edge.alias("edge"))
    return found.groupBy("word", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


# Edges come by score, and one merges its two neighbours if both ends and one place inside are boundaries. A merge can
# open a better edge only if its piece begins or ends one; then the edges are gone through from the first again.
_MERGES = """
    aggregate(
        sequence(1, length(word)),
        named_struct('cuts', shiftrightunsigned(-1L, 64 - length(word)), 'again', true),
        (held, step) -> IF(NOT held.again, held, aggregate(
            edges,
            named_struct('cuts', held.cuts, 'again', false),
            (s, e) -> IF(s.again OR (s.cuts & e.ends) != e.ends OR bit_count(s.cuts & e.inside) != 1, s,
                named_struct('cuts', s.cuts & ~e.inside, 'again', (e.edge & 268435456) != 0))))).cuts
"""

# The edges between boundaries, as start and id.
_MERGED = """
    transform(
        filter(edges, e -> (cuts & e.inside) = 0 AND (cuts & e.ends) = e.ends),
        e -> shiftleft(shiftright(e.edge, 36) & 127, 40) | (e.edge & 268435455))
"""

# The ids in order of their starts. A character between two boundaries (a bit of lone) that is no piece becomes its bytes.
_MERGED_IDS = """
    transform(
        sort_array(IF(lone = 0, known, concat(known, flatten(transform(
            filter(sequence(0, length(word) - 1), i -> (shiftright(lone, i) & 1) = 1),
            i -> transform(array({of_character}), id -> IF(id >= 0,
                array(shiftleft(cast(i AS bigint), 40) | id),
                transform(sequence(1, octet_length(substring(word, i + 1, 1))), k ->
                    shiftleft(cast(i AS bigint), 40) | shiftleft(cast(k AS bigint), 32)
                    | ({bytes} + cast(conv(substring(hex(substring(word, i + 1, 1)), 2 * k - 1, 2), 16, 10) AS bigint)))))[0]))))),
        k -> cast(k & 268435455 AS int))
"""


def _of_character(model: Model, character: str) -> str:
    """SQL for the id of a character that is a piece, else -1: look-ups by place, first its page of 256 code points."""
    ids = {ord(p): i for p, i, _ in model.pieces if len(p) == 1}
    pages = sorted({c >> 8 for c in ids})
    page = [pages.index(p) if p in pages else -1 for p in range(max(pages, default=0) + 1)]
    id = [ids.get(p << 8 | c, -1) for p in pages for c in range(256)] or [-1]
    pages_sql, ids_sql = (f"cast(split('{','.join(map(str, x))}', ',') AS array<int>)" for x in (page, id))
    point = f"ascii({character})"
    return f"coalesce(get({ids_sql}, get({pages_sql}, shiftright({point}, 8)) * 256 + ({point} & 255)), -1)"


# Best summed score up to each place, and where its last piece begins; then the way back from the end.
_VITERBI = """
    transform(array(aggregate(
        array_sort(concat(
            transform(map_entries(map_filter(edges, (k, e) -> k >= 0)), e ->
                named_struct('start', e.key div 128, 'end', e.key div 128 + e.key % 128, 'score', e.value.score)),
            transform(filter(sequence(0, length(word) - 1), i -> edges[i * 128 + 1] IS NULL), i ->
                named_struct('start', cast(i AS bigint), 'end', cast(i + 1 AS bigint), 'score', {unknown}D)))),
        transform(sequence(0, length(word)), i ->
            named_struct('score', IF(i = 0, 0D, cast(null AS double)), 'back', cast(0 AS bigint))),
        (best, e) -> transform(best, (x, i) ->
            IF(i = e.end AND (x.score IS NULL OR best[cast(e.start AS int)].score + e.score > x.score),
               named_struct('score', best[cast(e.start AS int)].score + e.score, 'back', e.start), x)))),
        best -> aggregate(
            sequence(1, length(word)),
            array(length(word)),
            (b, step) -> IF(b[0] = 0, b, concat(array(cast(best[b[0]].back AS int)), b))))[0]
"""

# A character that is no piece becomes its bytes.
_IDS = """
    flatten(transform(sequence(0, size(cuts) - 2), i ->
        IF(edges[cuts[i] * 128 + cuts[i + 1] - cuts[i]] IS NOT NULL,
           array(edges[cuts[i] * 128 + cuts[i + 1] - cuts[i]].id),
           transform(sequence(1, octet_length(substring(word, cuts[i] + 1, 1))), k ->
               {bytes} + cast(conv(substring(hex(substring(word, cuts[i] + 1, 1)), 2 * k - 1, 2), 16, 10) AS int)))))
"""


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, ids) of distinct words."""
    # edges of so many words fit a task's memory
    parts = max(1, -(-words.count() // WORDS_OF_A_TASK))
    short = words.where(F.length("word") <= LONGEST_FOLD).repartition(parts, "word")
    if model.kind == "bpe":
        folded = ordered_lattice(short, model).withColumn("cuts", F.expr(_MERGES))
        folded = folded.withColumns({"known": F.expr(_MERGED), "lone": F.expr("(shiftleft(cuts, 1) | 1) & cuts")})
        ids = _MERGED_IDS.format(bytes=model.byte_base, of_character=_of_character(model, "substring(word, i + 1, 1)"))
    else:
        folded = lattice(short, model).withColumn("cuts", F.expr(_VITERBI.format(unknown=model.unknown_score)))
        ids = _IDS.format(bytes=model.byte_base)
    folded = folded.select("word", "n", F.expr(ids).alias("ids"))

    def fold_long(batches):
        pieces = {p: (i, s) for p, i, s in model.pieces}
        fold = merge_word if model.kind == "bpe" else viterbi_word
        for batch in batches:
            ids = [fold(w, pieces, model) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"]
            )

    long = words.where(F.length("word") > LONGEST_FOLD).select("word", "n")
    return folded.unionByName(long.mapInArrow(fold_long, "word string, n long, ids array<int>"))


def _frequent(encoded: DataFrame, most: int) -> pa.Table:
    """(word, ids) of at most ``most`` words, the most frequent in steps of a sixteenth of a power of two."""
    short = encoded.where(F.octet_length("word") <= FREQUENT_BYTES)
    step = F.floor(F.log2(F.col("n")) * 16).cast("int").alias("step")
    sizes = sorted(((r["step"], r["count"]) for r in short.groupBy(step).count().collect()), reverse=True)
    total, least = 0, None
    for at, count in sizes:
        if (total := total + count) > most:
            break
        least = at
    chosen = short.where(step >= least) if least is not None else short.limit(0)
    return chosen.select("word", "ids").toArrow().combine_chunks()


def _look_up(words: list[pa.DictionaryArray], known: pa.StringArray) -> list[np.ndarray]:
    """The place of each word among known ones, or -1. The known ones are hashed once, and distinct words looked up."""
    if not words:
        return []
    distinct = pa.concat_arrays([w.dictionary for w in words])
    places = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    starts = np.cumsum([0] + [len(w.dictionary) for w in words])
    return [places[start + w.indices.to_numpy()] for start, w in zip(starts, words)]


def encode(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_tokens, ids_mod (the ids as one number of 32-bit digits modulo 2**31 - 1); ``with_ids`` also ids and
    text_sha256, the digest of the text that the ids stand for.

    One row per row. Null and empty texts have no ids. A null doc_id is carried, repeated rows repeat, other columns
    are ignored, an empty table gives an empty result. A space and the mark for it are the same character here.

    Words that are not broadcast are looked up by a join and collected for each hash of a text; texts then meet the
    words of their hash. Texts of one hash share their words, whether they are equal or not. Texts travel compressed.
    """
    spark: SparkSession = docs.sparkSession
    folder = intermediate_folder(spark)
    with intermediate_tables(spark):
        encode_words(stable(count_words(docs, model, text_col)), model).write.parquet(folder)
    encoded = spark.read.schema("word string, n long, ids array<int>").parquet(folder)
    known = spark.sparkContext.broadcast(_frequent(encoded, frequent))
    kinds = spark.sparkContext.broadcast(character_kinds(model))
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))

    def numbered(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
        words, sizes = split_words(texts, kinds.value, model.dummy_prefix)
        return words.dictionary_encode(), sizes

    def rare(batches):
        lean_memory()
        table = known.value.column("word").combine_chunks()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            slices = list(_slices(pc.binary_length(batch.column(1)).to_pylist()))
            coded = [numbered(batch.column(1)[start:end]) for start, end in slices]
            places = _look_up([words for words, _ in coded], table)
            for (start, _), (words, sizes), at in zip(slices, coded, places):
                missing = np.flatnonzero(at < 0)
                rows = np.searchsorted(np.cumsum(sizes), missing, "right")
                found = words.indices.to_numpy()[missing]
                # each word once per row
                once = np.unique(rows << 32 | found, return_index=True)[1]
                own = words.dictionary.take(pa.array(found[once]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[start + rows[once]]), own], ["key", "word"])

    def squeeze(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            values = [value.as_py().encode() for value in batch.column(1)]
            data = pa.array([codec.compress(v, asbytes=True) for v in values], pa.binary())
            sizes = pa.array(map(len, values), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), data, sizes, batch.column(2)], ["doc_id", "data", "size", "key"])

    def code(batches):
        lean_memory()
        codec = pa.Codec("zstd")
        table, ids = (known.value.column(c).combine_chunks() for c in ("word", "ids"))
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            slices, coded, shas = list(_slices(sizes)), [], []
            for start, end in slices:
                packed = zip(batch.column(1)[start:end], sizes[start:end])
                values = [codec.decompress(v.as_py(), n, asbytes=True) if n else b"" for v, n in packed]
                coded.append(numbered(pa.array(values, pa.string())))
                shas.append([hashlib.sha256(v.replace(SPACE.encode(), b" ")).hexdigest() for v in values] if with_ids else [])
            own_words, own_ids = batch.column(3).flatten().flatten()
            once = pa.array(np.unique(own_words.dictionary_encode().indices.to_numpy(), return_index=True)[1])
            all_words = pa.concat_arrays([table, own_words.take(once)])
            all_ids = pa.concat_arrays([ids, own_ids.take(once)])
            places = _look_up([words for words, _ in coded], all_words)
            for (start, end), (_, n_words), sha, at in zip(slices, coded, shas, places):
                if len(at) and at.min() < 0:
                    raise KeyError("a word without ids")
                yield pack(batch.column(0)[start:end], sha, n_words, all_ids, at)

    def pack(doc_ids: pa.Array, shas: list[str], n_words: np.ndarray, known_ids: pa.ListArray, places: np.ndarray) -> pa.RecordBatch:
        begins = known_ids.offsets.to_numpy()[:-1][places]
        lengths = known_ids.value_lengths().to_numpy(zero_copy_only=False)[places]
        ends = np.cumsum(lengths, dtype="i4")
        at = np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0, dtype="i4")
        flat = known_ids.values.to_numpy(zero_copy_only=False)[at].astype("i4", copy=False)
        ends = np.r_[0, ends][np.r_[0, np.cumsum(n_words)]].astype("i4")
        digits, bounds = flat.astype(">u4").tobytes(), (4 * ends.astype("i8")).tolist()
        mods = [int.from_bytes(digits[a:b], "big") % MODULUS for a, b in zip(bounds, bounds[1:])]
        columns = {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(ends).astype("i8")), "ids_mod": pa.array(mods, pa.int64())}
        if with_ids:
            columns |= {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "text_sha256": pa.array(shas, pa.string())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    wanted = texts.select("key", "text").mapInArrow(rare, "key long, word string")
    own = wanted.join(encoded.select("word", "ids"), "word").groupBy("key").agg(F.collect_set(F.struct("word", "ids")).alias("own"))
    squeezed = texts.mapInArrow(squeeze, "doc_id long, data binary, size long, key long")
    # stored, so that the join can be split at a text with very many copies
    schema = "doc_id long, n_tokens long, ids_mod long" + ", ids array<int>, text_sha256 string" * with_ids
    return squeezed.join(stable(own), "key", "left").select("doc_id", "data", "size", "own").mapInArrow(code, schema)


def decode(ids: Column, model: Model) -> Column:
    """The text of an array of ids. Null ids give null; bytes that are no sound UTF-8 become U+FFFD.

    Pieces and ASCII characters are joined as they are. Only arrays with other bytes are joined as bytes.
    """
    shown = {i: p.encode() for p, i, _ in model.pieces}
    shown |= {model.byte_base + b: bytes([b]) for b in range(256)}
    shown |= {model.unknown: " ⁇ ".encode()} | dict.fromkeys(model.special, b"")
    listed = [shown.get(i, b"") for i in range(max(shown) + 1)]
    # two characters that no piece has: one stands for the bytes, one between the entries
    free = (chr(c) for c in range(0xE000, 0xF900) if not any(chr(c) in p for p, _, _ in model.pieces))
    other, between = next(free), next(free)
    single = range(model.byte_base + 128, model.byte_base + 256)
    texts = F.split(F.lit(between.join(other if i in single else x.decode() for i, x in enumerate(listed))), between)
    table = F.split(F.lit(",".join(x.hex() for x in listed)), ",")

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(ids, lambda i: of[i]), "")

    text = F.transform(
        F.array(joined(texts)),
        lambda t: F.when(~F.contains(t, F.lit(other)), t).otherwise(F.make_valid_utf8(F.unhex(joined(table)).cast("string"))),
    )[0]
    if model.dummy_prefix:
        return F.transform(F.array(text), lambda t: F.when(t.startswith(" "), F.substr(t, F.lit(2))).otherwise(t))[0]
    return text


def round_trip(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_mod, ids_crc32 (of the ids in decimal, with commas between), ids,
    decoded_sha256 (of the decoded text) and decoded_equal (whether it is the text that was encoded)."""
    coded = encode(docs, model, id_col, text_col, with_ids=True)
    # the quickest way to write numbers with commas between
    crc = F.crc32(F.btrim(F.to_json("ids"), F.lit("[]")).cast("binary")).alias("ids_crc32")
    back = F.sha2(decode(F.col("ids"), model).cast("binary"), 256).alias("decoded_sha256")
    coded = coded.select("doc_id", "n_tokens", "ids_mod", crc, "ids", back, "text_sha256")
    return coded.withColumn("decoded_equal", F.col("decoded_sha256") == F.col("text_sha256")).drop("text_sha256")
