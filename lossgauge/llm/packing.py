"""Bounded-space packing of token streams into fixed-length training sequences.

Each partition keeps a fixed number of open windows. A piece goes to the fullest window it fits in; where none fits,
the fullest window is filled by cutting the piece, or padded if its room is smaller than a worthwhile piece, and
emitted. What is still open at the end of the partitions is merged, a fixed number of partitions at a time, by the
same rule. Token ids never move between tasks but for those of open windows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossgauge.llm.common import lean_memory, whole_text
from lossgauge.llm.tokens import encoder_store, ids_crc32, shared_encoder
from lossgauge.session import stable

LENGTH = 2048
OPEN_WINDOWS = 32
# room smaller than this is padded rather than filled with a sliver of a document
LEAST_PIECE = 8
PARTITIONS_PER_MERGE = 64

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "partition int, open boolean, ids binary"
)


class Windows:
    """The open windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, limit: int, least_piece: int, first_id: int):
        self.length, self.limit, self.least_piece, self.next_id = length, limit, least_piece, first_id
        self.open: list[list] = []  # [filled, pieces]
        self.ready: list[tuple] = []  # (sequence_id, offset, piece)

    def _emit(self, window: list) -> None:
        offset = 0
        for piece in window[1]:
            self.ready.append((self.next_id, offset, piece))
            offset += len(piece[2])
        self.next_id += 1

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        if window[0] == self.length:
            self.open = [w for w in self.open if w is not window]
            self._emit(window)

    def _open_with(self, piece: tuple) -> None:
        window = [0, []]
        self.open.append(window)
        self._put(window, piece)

    def add(self, doc_id, start: int, ids, doc_tokens: int) -> None:
        while len(ids) >= self.length:
            self._emit([self.length, [(doc_id, start, ids[: self.length], doc_tokens)]])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [w for w in self.open if self.length - w[0] >= len(ids)]
            if fits:
                return self._put(max(fits, key=lambda w: w[0]), (doc_id, start, ids, doc_tokens))
            if len(self.open) < self.limit:
                return self._open_with((doc_id, start, ids, doc_tokens))
            fullest = max(self.open, key=lambda w: w[0])
            room = self.length - fullest[0]
            if room >= self.least_piece:
                self._put(fullest, (doc_id, start, ids[:room], doc_tokens))
                start, ids = start + room, ids[room:]
            else:
                self.open = [w for w in self.open if w is not fullest]
                self._emit(fullest)

    def close(self) -> None:
        """Merge what is open: the pieces fill one window after the other, long pieces first."""
        pieces = [p for w in self.open for p in w[1]]
        self.open, self.limit = [], 1
        for doc_id, start, ids, doc_tokens in sorted(pieces, key=lambda p: -len(p[2])):
            self.add(doc_id, start, ids, doc_tokens)
        for window in self.open:
            self._emit(window)
        self.open = []


def _rows(placed, partition: int, is_open: bool, keep_ids: bool, schema: pa.Schema) -> pa.RecordBatch:
    rows = [
        {
            "doc_id": doc_id,
            "start": start,
            "length": len(ids),
            "ids_crc32": ids_crc32(ids),
            "doc_tokens": doc_tokens,
            "sequence_id": sequence,
            "offset": offset,
            "partition": partition,
            "open": is_open,
            "ids": ids.astype("<u4").tobytes() if keep_ids or is_open else None,
        }
        for sequence, offset, (doc_id, start, ids, doc_tokens) in placed
    ]
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PIECES.split(", "))])


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
    least_piece: int = LEAST_PIECE,
    partitions_per_merge: int = PARTITIONS_PER_MERGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack the token ids of every document, ``end_id`` after each, into sequences of at most ``length`` ids.

    Returns one row per piece: doc_id, start (ids of the document before the piece), length, ids_crc32, doc_tokens
    (with the end id), sequence_id, offset (in the sequence; pieces leave no gap), and ids (little-endian unsigned
    32-bit) if ``with_ids``. Each id of each row lies in exactly one piece. ``sequences`` joins pieces to whole
    padded sequences.

    Null and empty texts are the end id alone. A null doc_id is carried. Repeated rows are packed each on its own.
    Other columns are ignored. An empty table gives an empty result.
    """
    schema = _arrow_schema()
    encoders = encoder_store(docs.sparkSession, tokenizer)

    def place(batches):
        import numpy as np

        lean_memory()
        partition = TaskContext.get().partitionId()
        encoder = shared_encoder(encoders)
        end = np.array([end_id], dtype="<u4")
        windows = Windows(length, open_windows, least_piece, partition << 32)
        for batch in batches:
            texts = batch.column(1)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = np.concatenate([encoder.encode(texts[at].as_py()), end])
                windows.add(doc_id, 0, ids, len(ids))
                if len(windows.ready) >= 5_000:
                    yield _rows(windows.ready, partition, False, with_ids, schema)
                    windows.ready = []
        yield _rows(windows.ready, partition, False, with_ids, schema)
        windows.ready = []
        for window in windows.open:
            windows._emit(window)
        yield _rows(windows.ready, partition, True, with_ids, schema)

    def merge(key, pieces):
        import numpy as np

        windows = Windows(length, open_windows, least_piece, (1 << 62) | int(key[0]) << 32)
        columns = (pieces.doc_id, pieces.start, pieces.ids, pieces.doc_tokens, pieces.sequence_id, pieces.offset)
        parts = sorted(zip(*columns), key=lambda r: r[4:])
        for doc_id, start, data, doc_tokens, _, _ in parts:
            windows.open.append([0, [(doc_id, start, np.frombuffer(data, "<u4"), doc_tokens)]])
        windows.close()
        return _rows(windows.ready, -1, False, with_ids, schema).to_pandas()

    # a null doc_id would turn the ids of a pandas group into floats: the flag keeps them whole
    placed = stable(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
            place, PIECES
        )
    )
    encoders.destroy()
    left = placed.where("open").withColumn("group", F.floor(F.col("partition") / partitions_per_merge))
    known = left.withColumn("no_id", F.col("doc_id").isNull()).fillna({"doc_id": 0})
    merged = known.groupBy("group", "no_id").applyInPandas(
        lambda key, pieces: merge((key[0] * 2 + int(key[1]),), pieces).assign(no_id=key[1]), PIECES + ", no_id boolean"
    )
    merged = merged.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns += ["ids"] if with_ids else []
    return placed.where("not open").select(*columns).unionByName(merged.select(*columns))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Whole sequences from ``pack(..., with_ids=True)``: sequence_id, ids (array), n_ids.

    A sequence is padded to ``length`` unless its own length is a power of two.
    """
    schema = "sequence_id long, ids array<long>, n_ids long"

    def join(key, rows):
        import numpy as np
        import pandas as pd

        parts = rows.sort_values("offset").ids
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        n = len(ids)
        if n & (n - 1):
            ids = np.concatenate([ids, np.full(length - n, pad_id, np.int64)])
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [ids], "n_ids": [n]})

    return pieces.groupBy("sequence_id").applyInPandas(join, schema)
