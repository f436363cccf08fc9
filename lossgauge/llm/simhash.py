"""SimHash near-duplicates with a pivot distance table.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes of all word shingles, repeats included.
Equal fingerprints collapse to one row before anything is compared.

Links: fingerprints within ``max_bits`` differing bits. Cut into s segments, two such fingerprints agree in at least
s - max_bits of them, so an equi-join on every choice of that many segments misses none. Each fingerprint carries a
table of its Hamming distances to fixed reference fingerprints (pivots); by the triangle inequality a pair whose
distances to some pivot differ by more than ``max_bits`` is discarded, and the survivors are verified on all bits. A
pair is kept only by the first choice of segments on which it agrees, so it appears once. s grows with the number of
fingerprints, so that a key holds few by chance.

A key that near copies share may still hold very many. Beyond ``hot`` rows its pairs are not formed: each
fingerprint is sent to every value within max_bits / 2 bits of it (the segments of the key stay as they are). Two of
them are within max_bits bits exactly if they meet at such a value, so linking all that meet at a value to the least of
them loses no connection, and the work per fingerprint is constant.

Components: large-star and small-star rounds on the links, stored between rounds.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossgauge.llm.common import free_names, whole_text
from lossgauge.session import stable

SHINGLE = 4
MAX_BITS = 4
PIVOTS = 16
HOT = 4096
# expected number of unrelated fingerprints on one key
CHANCE = 64
SHINGLES_AT_ONCE = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64, seed 42, of each shingle, some thousands at a time."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    ends = ends[width - 1 :]
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        some = slice(at, at + SHINGLES_AT_ONCE)
        spans = zip(starts[some].tolist(), ends[some].tolist())
        yield np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), 0
    for hashes in _hashes(words, width):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of up to 255 rows fit one byte; wider sums only per block
        for at in range(0, len(bits), 255):
            ones += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = np.fromiter((simhash(t, width) for t in texts), np.uint64, len(texts))
            yield pd.Series(made.view(np.int64))

    return prints(text)


def _segment_masks(segments: int) -> list[int]:
    """Bit masks of nearly equal runs of bits, as signed longs."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def segments_for(n: int, max_bits: int = MAX_BITS, chance: int = CHANCE) -> int:
    """The fewest segments for which a key of (segments - max_bits) of them holds few of n random fingerprints."""
    segments = max_bits + 2
    while segments < 16 and n / 2 ** (64 * (segments - max_bits) // segments) > chance:
        segments += 1
    return segments


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _pivots(number: int) -> list[Column]:
    """Reference fingerprints: hashes of the first integers."""
    return [F.xxhash64(F.lit(i)) for i in range(number)]


def _keyed(prints: DataFrame, masks: list[int], agree: int, pivots: int) -> DataFrame:
    """One row per fingerprint and choice of segments: choice, key (the bits of those segments), fp, its pivot table."""
    choices = [reduce(lambda x, y: x | y, c) for c in itertools.combinations(masks, agree)]
    table = prints.withColumn("table", F.array(*[_differing(F.col("fp"), p).cast("byte") for p in _pivots(pivots)]))
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in choices])
    return table.select("fp", "table", F.posexplode(keys).alias("choice", "key"))


def _first_choice(a: Column, b: Column, masks: list[int], agree: int) -> Column:
    """The number of the first choice of segments on which two fingerprints agree: their first equal segments."""
    equal = [a.bitwiseXOR(b).bitwiseAND(F.lit(m)) == 0 for m in masks]
    bits = sum((F.when(e, F.lit(1 << i)).otherwise(F.lit(0)) for i, e in enumerate(equal)), F.lit(0))
    # number of the choice for each set of equal segments
    numbers = {c: i for i, c in enumerate(itertools.combinations(range(len(masks)), agree))}
    firsts = []
    for held in range(1 << len(masks)):
        chosen = [i for i in range(len(masks)) if held >> i & 1][:agree]
        firsts.append(numbers.get(tuple(chosen), -1))
    return F.element_at(F.lit(firsts), bits + 1)


def links(prints: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, hot: int = HOT, chance: int = CHANCE) -> DataFrame:
    """(a, b) with a < b of distinct fingerprints ``fp`` within ``max_bits`` bits.

    Complete but inside keys of more than ``hot`` fingerprints; there the links given connect the same fingerprints.
    """
    segments = segments_for(prints.count(), max_bits, chance)
    masks, agree = _segment_masks(segments), segments - max_bits
    keyed = _keyed(prints, masks, agree, pivots)
    crowded = keyed.groupBy("choice", "key").count().where(F.col("count") > hot).select("choice", "key")
    calm = keyed
    is_crowded = not crowded.isEmpty()
    if is_crowded:
        calm = keyed.join(crowded, ["choice", "key"], "left_anti")
    left = calm.select("choice", "key", F.col("fp").alias("a"), F.col("table").alias("ta"))
    right = calm.select(
        F.col("choice").alias("c2"), F.col("key").alias("k2"), F.col("fp").alias("b"), F.col("table").alias("tb")
    )
    near = F.lit(True)
    for i in range(pivots):
        near = near & (F.abs(F.col("ta")[i] - F.col("tb")[i]) <= max_bits)
    found = left.join(
        right,
        (F.col("choice") == F.col("c2"))
        & (F.col("key") == F.col("k2"))
        & (F.col("a") < F.col("b"))
        & near
        & (_differing(F.col("a"), F.col("b")) <= max_bits)
        & (_first_choice(F.col("a"), F.col("b"), masks, agree) == F.col("choice")),
    ).select("a", "b")
    if is_crowded:
        found = found.unionByName(_star_links(keyed.join(crowded, ["choice", "key"], "left_semi"), masks, agree, max_bits))
    return found


def _star_links(keyed: DataFrame, masks: list[int], agree: int, max_bits: int) -> DataFrame:
    """Links to the least of those that meet at a value within max_bits / 2 bits, in the free segments of a key.

    With an odd bound one side of a pair may go half a bit further. Any two of which one at least stands within the
    smaller radius are within the bound, so all that meet at a value are linked to the least within that radius.
    """
    inner, radius = max_bits // 2, (max_bits + 1) // 2
    steps = []
    for chosen in itertools.combinations(range(len(masks)), agree):
        free = [b for i, m in enumerate(masks) if i not in chosen for b in range(64) if (m >> b) & 1]
        moves = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(free, r)]
        steps.append([m - (1 << 64) if m >= 1 << 63 else m for m in moves])
    moved = F.transform(F.element_at(F.lit(steps), F.col("choice") + 1), lambda m: m.bitwiseXOR(F.col("fp")))
    met = keyed.select("choice", "fp", F.explode(moved).alias("value"))
    within = met if inner == radius else met.where(_differing(F.col("fp"), F.col("value")) <= inner)
    least = stable(within.groupBy("choice", "value").agg(F.min("fp").alias("least")))
    pairs = met.join(least, ["choice", "value"]).where("least != fp")
    return pairs.select(F.least("least", "fp").alias("a"), F.greatest("least", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node can reach. Nodes without a link are absent.

    Alternates large-star and small-star until the links no longer change; every round is stored. The least
    neighbour of a node comes from a plain minimum, which is stored before the links are joined to it: so the join can be
    split, and a node with very many links is never gathered in one task.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # small star: each node with its smaller neighbours only; links are kept as (a < b)
        sided = both if large else links.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = stable(sided.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        joined = sided.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("m").alias("a"), "b")
        else:
            itself = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
            moved = joined.select(F.col("m").alias("a"), "b").unionByName(itself)
        return moved.where("a < b").distinct()

    def state(links: DataFrame) -> tuple:
        fields = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        return tuple(links.agg(*fields).first())

    current = stable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while (now := state(current)) != before:
        before = now
        current = stable(star(stable(star(current, True)), False))
    ends = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _named(prints: DataFrame, max_bits: int, pivots: int, hot: int, chance: int) -> DataFrame:
    """(fp, component, component_id) of distinct fingerprints."""
    distinct = stable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = stable(components(links(distinct.select("fp"), max_bits, pivots, hot, chance)))
    member = stable(
        distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "component", F.coalesce("component", "fp")
        )
    )
    # stored, so that the join to the members of a large component can be split
    least = stable(member.groupBy("component").agg(F.min("least").alias("component_id")))
    return member.join(least, "component").select("fp", "component", "component_id")


def _prints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(whole_text(text_col), shingle).alias("fp"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    pivots: int = PIVOTS,
    hot: int = HOT,
    chance: int = CHANCE,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links), one row per row.

    A-Z are lowered; a text of fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint
    zero and are linked like any other. Repeated rows repeat. A null doc_id is carried and never names a component
    that has another id; a component of null ids only has a null component_id. Other columns are ignored; an
    empty table gives an empty result.
    """
    prints = stable(_prints(docs, shingle, id_col, text_col))
    named = _named(prints, max_bits, pivots, hot, chance)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", digits, "component_id")


def keep_one_of_each(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    pivots: int = PIVOTS,
    hot: int = HOT,
    chance: int = CHANCE,
) -> DataFrame:
    """One document of each component, with all its columns: the one with the least id.

    An id may stand on texts of several components and then leads each of them by its own rows. Of rows of a component
    that share its least id, the one with the least hash of its text stays. Of a component without ids, the one with
    the least fingerprint and hash stays.
    """
    own_id, own_print, place = free_names(docs, "__doc", "__print", "__place")
    lead_id, lead_fp, lead_component, many = free_names(docs, "__id", "__fp", "__component", "__several")
    prints = stable(_prints(docs, shingle, id_col, text_col))
    named = stable(_named(prints, max_bits, pivots, hot, chance))
    leading = stable(
        prints.join(named, "fp")
        .where("doc_id <=> component_id")
        .select(F.col("doc_id").alias(lead_id), F.col("fp").alias(lead_fp), F.col("component").alias(lead_component))
        .distinct()
    )
    order = F.xxhash64(whole_text(text_col))

    def first(rows: DataFrame, key: str, *by: Column) -> DataFrame:
        ranked = F.row_number().over(Window.partitionBy(key).orderBy(*by))
        return rows.withColumn(place, ranked).where(F.col(place) == 1).select(*docs.columns)

    # ids with several fingerprints: which component a row is of shows in its text only
    several = stable(
        prints.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").alias(lead_id))
        .agg((F.min("fp") != F.max("fp")).alias(many))
        .where(F.col(many))
        .join(leading, lead_id, "left_semi")
        .select(lead_id)
    )
    own = docs.withColumn(own_id, F.col(id_col).cast("long"))
    plain, unclear = leading.where(F.col(lead_id).isNotNull()), own.where(F.col(own_id).isNull())
    if not several.isEmpty():
        plain = plain.join(several, lead_id, "left_anti")
        unclear = unclear.unionByName(own.join(several, F.col(own_id) == F.col(lead_id), "left_semi"))
    stays = first(own.join(plain, F.col(own_id) == F.col(lead_id), "left_semi"), own_id, order)
    unclear = unclear.withColumn(own_print, fingerprint(whole_text(text_col), shingle))
    matched = unclear.join(leading, F.col(own_id).eqNullSafe(F.col(lead_id)) & (F.col(own_print) == F.col(lead_fp)))
    by = F.when(F.col(lead_id).isNull(), F.col(lead_fp))
    return stays.unionByName(first(matched, lead_component, by, order))
