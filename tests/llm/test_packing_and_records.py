import json
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from lossgauge.llm import packing, queries, records, tokens
from lossgauge.session import checkpoint_dir


@pytest.fixture(scope="session")
def encoder(tokenizer_file):
    return tokens.Encoder(tokenizer_file)


def test_ids_equal_the_tokenizer(encoder):
    rng = random.Random(5)
    parts = ["a", "Bc", "é", "'", "'s", "'re", "_", "-", ".", "*", " ", "  ", "\n", "\t", "\r\n", "5", "42", "²", "½", "́", "Я"]
    parts += ["<|endoftext|>", "<|", "x", "\xa0", "中", "😀", "\x1c", "ß", "×", "!", " "]
    plain = [p for p in parts if p.isascii() and "<" not in p and p != "\x1c"]
    for source in (parts, plain):
        for _ in range(4000):
            text = "".join(rng.choice(source) for _ in range(rng.randint(0, 9)))
            assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_the_fast_engine_is_used_only_where_it_is_proved(tokenizer_file, encoder):
    source = json.loads(Path(tokenizer_file).read_text())
    assert encoder.engine is not None
    text = "One two, three four's 55 - five\n\n  six"
    changed = [
        # an entry that the library cannot reach, as its parts merge otherwise
        {"model": source["model"] | {"merges": source["model"]["merges"][1:]}},
        {"model": source["model"] | {"merges": source["model"]["merges"][::-1]}},
        {"model": source["model"] | {"unk_token": "<|endoftext|>"}},
        {"normalizer": {"type": "Lowercase"}},
        {"pre_tokenizer": source["pre_tokenizer"] | {"add_prefix_space": True}},
        {"pre_tokenizer": None},
    ]
    for change in changed:
        other = tokens.Encoder(source=json.dumps(source | change))
        assert other.engine is None
        assert other.encode(text).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", ["x", "ab", " ", "\n", "!?", "éà", "1"])
def test_ids_of_very_long_pieces(encoder, piece):
    text = piece * 30_000
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(pieces, docs, encoder, length=2048):
    ids = [np.append(encoder.encode(t or ""), 1).astype("<u4") for _, t in docs]
    by_doc = {}
    for (i, _), x in zip(docs, ids):
        by_doc.setdefault(i, []).append(x)
    spans = {}
    for p in pieces:
        matching = [x for x in by_doc[p["doc_id"]] if len(x) == p["doc_tokens"]]
        cut = slice(p["start"], p["start"] + p["length"])
        assert any(zlib.crc32(x[cut].tobytes()) == p["ids_crc32"] for x in matching)
        spans.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    for places in spans.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= length
    return spans


def test_packing_query(spark, small, raw, encoder):
    pieces = queries.op5_packing(spark, small).collect()
    spans = check_packing(pieces, sorted(raw[0].items()), encoder)
    total = sum(p["length"] for p in pieces)
    assert len(spans) * 2048 < total * 1.02 + 2048


def test_packing_of_messy_rows(spark, messy, tokenizer_file, encoder):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()]
    options = {"length": 64, "open_windows": 3, "partitions_per_merge": 2, "with_ids": True}
    pieces = packing.pack(messy.repartition(7), tokenizer_file, 1, **options)
    check_packing(pieces.collect(), docs, encoder, 64)
    made = packing.sequences(pieces, 64).collect()
    assert all(len(r["ids"]) == 64 or (len(r["ids"]) & (len(r["ids"]) - 1)) == 0 for r in made)
    assert sum(r["n_ids"] for r in made) == sum(len(encoder.encode(t or "")) + 1 for _, t in docs)
    assert packing.pack(messy.limit(0), tokenizer_file, 1).count() == 0


def test_windows_fit_best_and_emit_the_fullest():
    w = packing.Windows(100, 2, 10, 0)
    ids = np.zeros(1000, "<u4")
    w.add("a", 0, ids[:60], 60)
    w.add("b", 0, ids[:80], 80)
    w.add("c", 0, ids[:15], 15)  # fits both: the fuller one
    assert [x[0] for x in w.open] == [60, 95] and not w.ready
    w.add("d", 0, ids[:50], 50)  # fits none: 5 are no worthwhile piece, so 95 go out; then a new window
    assert [(s, o, p[0], len(p[2])) for s, o, p in w.ready] == [(0, 0, "b", 80), (0, 80, "c", 15)]
    w.add("e", 0, ids[:55], 55)  # fits none: 40 fill the window of 60, the rest goes on
    assert [(p[0], p[1], len(p[2])) for s, _, p in w.ready if s == 1] == [("a", 0, 60), ("e", 0, 40)]
    assert sorted(x[0] for x in w.open) == [65]


def test_record_query(spark, small, raw, encoder):
    want, before = [], 0
    for i, text in sorted(raw[0].items()):
        ids = np.append(encoder.encode(text), 2).astype("<u4")
        want.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert sorted(map(tuple, queries.op9_token_records(spark, small).collect())) == want


def test_records_of_messy_rows_and_shuffled_reads(spark, messy, tokenizer_file, encoder, tmp_path):
    folder, index = str(tmp_path / "data"), str(tmp_path / "index")
    records.write_records(messy, folder, tokenizer_file, 2)
    listed = records.write_index(spark, folder, index)
    found = records.read_records(spark, folder, with_ids=True).collect()
    want = sorted(((r["doc_id"], (*encoder.encode(r["text"] or "").tolist(), 2)) for r in messy.collect()), key=repr)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in found), key=repr) == want
    ordered = [r["doc_id"] for r in sorted(found, key=lambda r: (r["file"], r["offset"]))]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    some = listed.where("doc_id IN (1, 8) OR doc_id IS NULL")
    at = records.read_at(spark, folder, some)
    assert sorted(((r["doc_id"], tuple(r["ids"])) for r in at.collect()), key=repr) == [w for w in want if w[0] in (1, 8, None)]
    assert records.round_trip(messy.limit(0), tokenizer_file, 2).count() == 0
    assert checkpoint_dir(spark)


def test_files_are_bounded_and_keep_the_order(spark, tokenizer_file, encoder, tmp_path):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(300)] + [(300, "one very long text " * 400)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    records.write_records(df, str(tmp_path / "data"), tokenizer_file, 2, file_bytes=1500)
    sizes = [f.stat().st_size for f in (tmp_path / "data").glob("run=*/part-*")]
    assert len(sizes) > 10 and sorted(sizes)[-2] <= 1500 < sorted(sizes)[-1]
    assert sum(sizes) == sum(len(records.frame(i, np.append(encoder.encode(t), 2))) for i, t in rows)
    listed = records.write_index(spark, str(tmp_path / "data"), str(tmp_path / "index")).orderBy("file", "offset").collect()
    assert [r["doc_id"] for r in listed] == list(range(301))


def test_frames_carry_wide_ids_and_show_damage():
    ids = np.array([1, 70_000, 10], "<u4")
    data = records.frame(9, ids) + records.frame(None, ids[:1])
    assert records.unframe(data, 0)[0] == 9 and records.unframe(data, 0)[1].tolist() == [1, 70_000, 10]
    second = records.frame_size(data, 0) + records.FRAME_EXTRA
    assert records.unframe(data, second)[0] is None
    crc = zlib.crc32(struct.pack("<Q", records.frame_size(data, 0)))
    assert struct.unpack_from("<I", data, 8)[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) % (1 << 32)
    for at in (3, 14, 25):
        damaged = bytearray(data)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(damaged), 0)
