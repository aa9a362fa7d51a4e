"""Token-id output packed by best-fit decreasing (operator 2).

Documents are tokenized and packed inside their task, in blocks of about ``BLOCK`` tokens, so nothing is shuffled and
memory is bounded. Which documents share a row thus depends on how the input is split; the share of padding hardly
does (README). Documents longer than a row are split losslessly: full rows first, then the rest. Pieces are placed
longest first into the open row with the least sufficient room; that room is found by a segment tree over capacities
(leaf c counts rows with c free places). Row ids hold the task and a running number, as retries reproduce them.

Real output (``packed``): one row per sequence with the id matrix row (uint16 LE, padded), cumulative segment lengths
and position ids that restart at each segment. ``write_packed`` stores it as Parquet.

Defined results: null and empty texts hold the closing id alone; a very long text is encoded whole and cut at
multiples of the width; repeated rows and repeated or null doc_ids are packed each on its own; pieces of equal length
are placed in the order read; an empty table packs nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _tokens

WIDTH = 1024
END_ID = 0
BLOCK = 4_000_000
PACKED = "sequence_id long, n_ids int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>, lengths array<int>, doc_tokens array<long>"


class Rooms:
    """Segment tree over free places 0..width: which open row has the least room that suffices?"""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the smallest room >= least."""
        i = least + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece indices; every length is at most ``width``."""
    rooms, rows = Rooms(width), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            found = width, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.put(room - lengths[i], row)
    return rows


def packed(docs: DataFrame, width: int = WIDTH, tokenizer: str | None = None) -> DataFrame:
    """One row per packed sequence; see ``PACKED``."""
    path = tokenizer or _tokens.default_path()

    def run(batches):
        from pyspark import TaskContext

        encode, base, made = _tokens.encoder(path), TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []
        total = 0

        def emit():
            nonlocal made, total
            pieces = [(d, ids, s, min(width, len(ids) - s)) for d, ids in held for s in range(0, len(ids), width)]
            rows = best_fit([p[3] for p in pieces], width)
            for lo in range(0, len(rows), 2000):
                out = [[] for _ in range(9)]
                for row in rows[lo : lo + 2000]:
                    parts = [pieces[i] for i in row]
                    n = [p[3] for p in parts]
                    ids = np.full(width, END_ID, "<u2")
                    ids[: sum(n)] = np.concatenate([p[1][p[2] : p[2] + p[3]] for p in parts])
                    position = np.zeros(width, "<u2")
                    position[: sum(n)] = np.concatenate([np.arange(x) for x in n])
                    cells = (base + made, sum(n), ids.tobytes(), [0, *np.cumsum(n).tolist()], position.tobytes(), [p[0] for p in parts], [p[2] for p in parts], n, [len(p[1]) for p in parts])
                    made += 1
                    for column, x in zip(out, cells, strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])
            held.clear()
            total = 0

        for batch in (part for whole in batches for part in _base.slices(whole, "_t")):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint16), np.uint16(END_ID))
                held.append((doc, ids))
                total += len(ids)
                if total >= BLOCK:
                    yield from emit()
        yield from emit()

    return docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_t")).mapInArrow(run, PACKED)


def write_packed(docs: DataFrame, path: str, width: int = WIDTH, tokenizer: str | None = None) -> None:
    """Store the packed matrices, segment lengths and positions as Parquet."""
    packed(docs, width, tokenizer).write.option("compression", "zstd").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """One row per piece, with the crc32 of its ids (unsigned little-endian 32 bit)."""

    def run(batches):
        for batch in (part for whole in batches for part in _base.slices(whole, "ids", 4 << 20)):
            out = [[] for _ in range(7)]
            for seq, ids, cu, docs, starts, whole in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                for i, (doc, start, n) in enumerate(zip(docs, starts, whole, strict=True)):
                    cells = doc, start, cu[i + 1] - cu[i], zlib.crc32(wide[cu[i] : cu[i + 1]].tobytes()), n, seq, cu[i]
                    for column, x in zip(out, cells, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    thin = rows.select("sequence_id", "ids", "cu_seqlens", "doc_ids", "starts", "doc_tokens")
    return thin.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op2_best_fit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(packed(_base.read(spark, sf_dir, "documents")))


QUERIES = {"op2_best_fit_packed_ids": op2_best_fit_packed_ids}
ORACLES: dict[str, str] = {}
