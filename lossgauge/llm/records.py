"""Length-delimited binary records of token ids, with a separate offset index.

A frame is: length of the payload (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32 of the
payload (u32), line feed. A payload is: doc_id (i64), flags (u8: 1 null id, 2 ids of four bytes), ids (u16, or u32 with
flag 2). All numbers are little-endian. The mask rotates a checksum by 15 bits and adds a constant, so that a checksum
of data that holds checksums stays sound.

Files are written by Spark's own text writer, whose commit protocol leaves complete files only when executors are lost,
and read as whole binary files, so any store that Spark reaches will do. A task begins a new file when one is full, so
that no file is larger than a stated size, or one record if that is larger.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossgauge.llm.common import lean_memory, whole_text
from lossgauge.llm.tokens import encoder_store, ids_crc32, shared_encoder
from lossgauge.session import checkpoint_dir

# The constant that is added to a rotated checksum
MASK_DELTA = 0xA282EAD8

HEAD, HEAD_SIZE = "<QI", 12
PAYLOAD, PAYLOAD_SIZE = "<qB", 9
FRAME_EXTRA = HEAD_SIZE + 4 + 1
# a reading task holds one file at a time
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    payload = struct.pack(PAYLOAD, doc_id or 0, (doc_id is None) + 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def frame_size(content, offset: int) -> int:
    """Length of the payload of the frame at ``offset``; the checksum of the length is verified."""
    length, crc = struct.unpack_from(HEAD, content, offset)
    if masked(bytes(content[offset : offset + 8])) != crc or offset + FRAME_EXTRA + length > len(content):
        raise ValueError(f"no sound frame at byte {offset}")
    return length


def unframe(content, offset: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the frame at ``offset``; both checksums are verified."""
    length = frame_size(content, offset)
    payload = content[offset + HEAD_SIZE : offset + HEAD_SIZE + length]
    (crc,) = struct.unpack_from("<I", content, offset + HEAD_SIZE + length)
    if masked(payload) != crc:
        raise ValueError(f"the record at byte {offset} is damaged")
    doc_id, flags = struct.unpack_from(PAYLOAD, payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload[PAYLOAD_SIZE :], "<u4" if flags & 2 else "<u2")


def write_records(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Tokenize documents, ``end_id`` after each, and write them to ``folder`` in ascending doc_id order.

    A file holds at most ``file_bytes``, or one record. Files lie in folders of their own, whose names sort as the
    contents do. Null ids come first, rows of equal id in the order of a hash of their text. Null and empty texts are
    the end id alone. Other columns are ignored; an empty table writes no file.
    """
    encoders = encoder_store(docs.sparkSession, tokenizer)

    def frames(batches):
        lean_memory()
        encoder, task = shared_encoder(encoders), TaskContext.get().partitionId()
        run, at, filled, made, held = 0, 0, 0, [], 0

        def batch_of(rows):
            names, places, data = zip(*rows) if rows else ((), (), ())
            arrays = [pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["run", "at", "frame"])

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                # the writer adds the line feed
                data = frame(doc_id, np.append(encoder.encode(texts[i].as_py()), end_id))[:-1]
                if filled and filled + len(data) + 1 > file_bytes:
                    run, filled = run + 1, 0
                made.append((f"{task:08d}-{run:08d}", at, data))
                at, filled, held = at + 1, filled + len(data) + 1, held + len(data)
                if held > BATCH_BYTES:
                    yield batch_of(made)
                    made, held = [], 0
        yield batch_of(made)

    order = [F.col("doc_id"), F.xxhash64("text")]
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(frames, "run string, at long, frame binary")
        # the order is stated, as the writer sorts by folder where none is known
        .sortWithinPartitions("run", "at")
        # the writer copies the bytes of a string as they are
        .select("run", F.col("frame").cast("string").alias("value"))
        .write.partitionBy("run")
        .text(folder)
    )
    encoders.destroy()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), "content")


def write_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Read all files back, verify both checksums of every frame, and store where each record is as Parquet.

    Columns: file, offset, size, doc_id, first_id (ids of the file before the record), n_tokens, ids_crc32.
    """
    schema = "file string, offset long, size long, doc_id long, first_id long, n_tokens long, ids_crc32 long"

    def walk(batches):
        lean_memory()
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                content = memoryview(content.as_buffer())
                rows, offset, before = [], 0, 0
                while offset < len(content):
                    size = FRAME_EXTRA + frame_size(content, offset)
                    doc_id, ids = unframe(content, offset)
                    rows.append((offset, size, doc_id, before, len(ids), ids_crc32(ids)))
                    offset, before = offset + size, before + len(ids)
                columns = list(zip(*rows)) if rows else [[]] * 6
                arrays = [pa.array([name.as_py()] * len(rows), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array(c, pa.int64()) for c in columns],
                    ["file", "offset", "size", "doc_id", "first_id", "n_tokens", "ids_crc32"],
                )

    _files(spark, folder).mapInArrow(walk, schema).write.parquet(index)
    return spark.read.schema(schema).parquet(index)


def read_records(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Read whole files: file, offset, doc_id, n_tokens, ids_crc32, and ids (array) if asked for."""
    return _files(spark, folder).mapInArrow(_reader(with_ids, None), _record_schema(with_ids))


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records at (file, offset) of ``wanted``, rows of the index, and no others.

    Per file the offsets come as one array, so a shuffled order costs one read of each file that it touches. Spark reads
    such a file whole, which is why files are bounded.
    """
    offsets = wanted.groupBy("file").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    return (
        _files(spark, folder)
        .join(offsets, "file")
        .select("file", "content", "offsets")
        .mapInArrow(_reader(True, "offsets"), _record_schema(True))
    )


def _record_schema(with_ids: bool) -> str:
    return "file string, offset long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids


def _reader(with_ids: bool, offsets: str | None):
    names = ["file", "offset", "doc_id", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids

    def all_of(content):
        offset = 0
        while offset < len(content):
            yield offset
            offset += FRAME_EXTRA + frame_size(content, offset)

    def read(batches):
        lean_memory()
        for batch in batches:
            for at in range(batch.num_rows):
                content = memoryview(batch.column(1)[at].as_buffer())
                name, rows = batch.column(0)[at].as_py(), []
                for offset in batch.column(2)[at].as_py() if offsets else all_of(content):
                    doc_id, ids = unframe(content, offset)
                    row = (name, offset, doc_id, len(ids), ids_crc32(ids))
                    rows.append(row + (ids.astype(np.int64),) if with_ids else row)
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return read


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write records and index to ``folder`` (a new one beside the checkpoints, unless given) and read them back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32, all from the
    files: the pass that verifies them and lists them in the index. Ids before a file come from one row per file.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(docs, f"{folder}/data", tokenizer, end_id)
    index = write_index(spark, f"{folder}/data", f"{folder}/index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    start = (F.col("before") + F.col("first_id")).alias("start")
    return index.join(totals, "file").select("doc_id", start, "n_tokens", "ids_crc32")
