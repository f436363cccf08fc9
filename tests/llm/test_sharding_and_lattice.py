import hashlib
import itertools
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lossgauge.llm import piece_lattice, queries, sharding


def turns(shards, slots):
    """Brute force: whole rankings, and the first free slot of each in turn."""
    rankings = []
    for s in shards:
        first, step = sharding._permutation(s, slots)
        rankings.append([(first + k * step) % slots for k in range(slots)])
        assert sorted(rankings[-1]) == list(range(slots))
    table = {}
    for shard in itertools.cycle(range(len(shards))):
        if len(table) == slots:
            return [table[i] for i in range(slots)]
        table[next(s for s in rankings[shard] if s not in table)] = shard


@pytest.mark.parametrize("n, slots", [(1, 2), (3, 7), (7, 101), (13, 997)])
def test_table_equals_taking_turns(n, slots):
    names = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(names, slots)
    assert table == turns(names, slots)
    counts = [table.count(i) for i in range(n)]
    assert max(counts) - min(counts) <= 1


def test_removing_a_shard_moves_little_else():
    names = [f"s{i}" for i in range(20)]
    before = [names[i] for i in sharding.lookup_table(names)]
    fewer = names[:7] + names[8:]
    after = [fewer[i] for i in sharding.lookup_table(fewer)]
    moved = sum(a != b for a, b in zip(before, after) if a != "s7")
    assert moved < 0.1 * len(before)


@pytest.mark.parametrize("shards, slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_placement(spark, small, raw, messy, tmp_path):
    names = [f"shard-{i:03d}" for i in range(64)]
    table = sharding.lookup_table(names)
    rows = queries.op3_sharding(spark, small).collect()
    slots = {r["doc_id"]: r["s"] for r in spark.range(200).selectExpr("id AS doc_id", "pmod(xxhash64(id), 65537) AS s").collect()}
    assert sorted((r["doc_id"], r["slot"], r["shard"]) for r in rows) == [(i, s, table[s]) for i, s in sorted(slots.items())]
    assert {r["doc_id"]: r["text_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in raw[0].items()}
    plan = sharding.place(messy, names)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    placed = sharding.place(messy, names)
    assert placed.count() == messy.count() and placed.where("shard IS NULL").count() == 0
    assert sorted(placed.columns) == sorted(messy.columns)
    assert sharding.place(messy.limit(0), names).count() == 0
    sharding.write_shards(placed, str(tmp_path / "out"))
    stored = sharding.read_shards(spark, str(tmp_path / "out"), placed.schema)
    assert sorted(map(str, stored.select(*placed.columns).collect())) == sorted(map(str, placed.collect()))
    sharding.write_shards(placed.limit(0), str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), placed.schema).count() == 0


def test_equal_rows_of_a_shard_are_dealt_to_several_files(spark, tmp_path):
    docs = spark.range(1000).selectExpr("7L AS doc_id", "'same' AS text")
    placed = sharding.place(docs, ["a", "b", "c"])
    # small partitions would be put together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sharding.write_shards(placed, str(tmp_path / "out"), rows_per_file=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = sharding.read_shards(spark, str(tmp_path / "out"), placed.schema)
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 4 and max(sizes) < 500


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    return piece_lattice.load(queries.tokenizer("piece_bpe_32k.model"))


def digest(ids):
    value = 0
    for i in ids:
        value = ((value << 32) + i) % ((1 << 31) - 1)
    return value


def test_query_equals_the_library(spark, small, raw, library):
    rows = {r["doc_id"]: (r["n_tokens"], r["ids_mod"]) for r in queries.op10_sentencepiece(spark, small).collect()}
    want = {i: library.encode(t) for i, t in raw[0].items()}
    assert rows == {i: (len(x), digest(x)) for i, x in want.items()}


def test_query_gives_ids_and_decodes_them(spark, small, raw, library):
    found = {r["doc_id"]: r.asDict() for r in queries.op10_sentencepiece(spark, small).collect()}
    assert found.keys() == raw[0].keys()
    for i, text in raw[0].items():
        ids, row = library.encode(text), found[i]
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(",".join(map(str, ids)).encode())
        assert row["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()
        assert row["decoded_equal"]


def test_messy_texts_and_round_trip(spark, messy, model, library):
    more = ["  a  b ", "ñandú 中文字 x²½ ▁a▁▁b\n\n\tq", "hello" * 40 + " " + "the" * 50, "don't 123 4.5 C++ __init__", "=" * 150, "é\x00"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    docs = messy.select("doc_id", "text").unionByName(extra)
    for frequent in (0, 50):
        coded = piece_lattice.encode(docs, model, with_ids=True, frequent=frequent)
        found = coded.withColumn("back", piece_lattice.decode(F.col("ids"), model)).collect()
        texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        want = [(i, library.encode(t), t.replace("▁", " ")) for i, t in texts]
        got = [(r["doc_id"], list(r["ids"]), r["back"]) for r in found]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert piece_lattice.encode(messy.limit(0), model).count() == 0


def best_score(word, scores, unknown):
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = scores.get(word[start:end], unknown if end == start + 1 else float("-inf"))
            best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_viterbi_fold_finds_the_best_path(spark):
    rng = random.Random(4)
    forms = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} - {"c"}
    pieces = tuple((p, 300 + i, -rng.random() * 9 - 1) for i, p in enumerate(sorted(forms)))
    unigram = piece_lattice.Model("unigram", pieces, 3, 0, (1, 2), False, piece_lattice._COARSE)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(60)}) + ["ab" * 50]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    scores = {p: s for p, _, s in pieces}
    by_id = {i: p for p, i, _ in pieces} | {3 + b: bytes([b]).decode("latin-1") for b in range(256)}
    for r in piece_lattice.encode_words(df, unigram).collect():
        parts = [by_id[i] for i in r["ids"]]
        assert "".join(parts) == r["word"]
        total = sum(scores[by_id[i]] if i >= 300 else unigram.unknown_score for i in r["ids"])
        assert total == pytest.approx(best_score(r["word"], scores, unigram.unknown_score))


def test_merge_fold_equals_merging_with_a_heap(spark, model):
    words = [" hello", "thatthing", " ab", "zzzzzzz", "中文", " ", "    ", "a", "=====", " internationalisation"]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pieces = {p: (i, s) for p, i, s in model.pieces}
    for r in piece_lattice.encode_words(df, model).collect():
        assert r["ids"] == piece_lattice.merge_word(r["word"], pieces, model)


def test_merges_that_open_better_ones(spark):
    # "bc" is worse than "abc", which only its merge makes possible; equal scores go from left to right
    pieces = tuple((p, 300 + i, s) for i, (p, s) in enumerate([("abc", -1.0), ("bc", -5.0), ("dd", -2.0), ("de", -2.0), ("a", -9.0), ("b", -9.0)]))
    bpe = piece_lattice.Model("bpe", pieces, 3, 0, (1, 2), False, piece_lattice._COARSE)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 2, 3, 5, 9, 63, 64, 65]))) for _ in range(200)})
    table = {p: (i, s) for p, i, s in pieces}
    rows = piece_lattice.encode_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), bpe).collect()
    assert {r["word"]: r["ids"] for r in rows} == {w: piece_lattice.merge_word(w, table, bpe) for w in words}


def test_documents_meet_their_words_once_and_as_text(spark, messy, model):
    docs = messy.select("doc_id", "text")
    coded = piece_lattice.encode(docs.unionByName(docs), model, with_ids=True, frequent=0)
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    # no ids are regrouped by document
    assert plan.count("Join") == 1 and "Aggregate" not in plan
    assert coded.count() == 2 * docs.count()


def test_words_of_texts_are_those_of_the_pattern(model):
    texts = ["", " ", "a", "  two  spaces ", "▁a▁▁b\n\n\tq", "x²½ ñandú,中文!! 😀🤣 é\x00", "don't 123 4.5 C++ __init__", "ё" * 9 + "  "]
    rng = random.Random(3)
    texts += ["".join(rng.choice(" aé中😀1,²\n▁") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    coarse = piece_lattice.Model("unigram", model.pieces, 3, 0, (1, 2), False, piece_lattice._COARSE)
    for m in (model, coarse):
        kinds = piece_lattice.character_kinds(m)
        for some in (texts, texts[:1], []):
            words, sizes = piece_lattice.split_words(pa.array(["x"] + some, pa.string())[1:], kinds, m.dummy_prefix)
            want = [m.words.findall(" " * m.dummy_prefix + t.replace("▁", " ")) if t else [] for t in some]
            assert words.to_pylist() == [w for of_text in want for w in of_text]
            assert sizes.tolist() == [len(w) for w in want]


def test_texts_travel_compressed_and_pieces_are_found_by_a_number(spark, messy, model):
    coded = piece_lattice.encode(messy.select("doc_id", "text"), model, with_ids=True)
    join = next(x for x in coded._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow code")[1:])
    assert "MapInArrow squeeze" in join
    words = spark.createDataFrame([(" hello", 1)], "word string, n long")
    plan = piece_lattice.ordered_lattice(words, model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [part_hash" in plan


def test_single_characters_are_no_edges_and_keep_their_ids(spark, model):
    words = ["a", "🤣", "x🤣中é", "\U000f1234", "ééé", "a\U000f1234b", "\n\n", "q" * 64, "中" * 64]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    rows = piece_lattice.ordered_lattice(df, model).collect()
    assert sorted(r["word"] for r in rows) == sorted(words)
    assert all((e["edge"] >> 29) & 127 > 1 for r in rows for e in r["edges"])
    pieces = {p: (i, s) for p, i, s in model.pieces}
    found = {r["word"]: r["ids"] for r in piece_lattice.encode_words(df, model).collect()}
    assert found == {w: piece_lattice.merge_word(w, pieces, model) for w in words}


def test_bytes_of_characters_and_broken_ones_are_decoded(spark, model):
    first = model.byte_base
    cases = [[], [first + 10], [first + b for b in "é\U000f1234".encode()], [first + 0xC3], [first + 0xC3, first + 10], None]
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(cases)], "i int, ids array<int>")
    found = {r["i"]: r["t"] for r in df.select("i", piece_lattice.decode(F.col("ids"), model).alias("t")).collect()}
    assert found == {0: "", 1: "\n", 2: "é\U000f1234", 3: "�", 4: "�\n", 5: None}
