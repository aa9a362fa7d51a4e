"""Packing by concatenate-and-cut (operator 10).

Pass one tokenizes each document once and writes (doc_id, ids, writer task, token offset inside that task) to the
shared folder; task totals and their prefix sums give each task's global offset. Pass two adds that offset to each
document's own and cuts at every multiple of the window. Only ids cross a stage; nothing is shuffled but one total
per task.

Defined results: a null text is empty and yields only the closing id; empty texts likewise; a very long text is
encoded whole and lies in as many windows as it needs; rows with the same or a null doc_id, ties and repeated rows are
packed each on its own; an empty table packs nothing; other columns are ignored, whatever their names. Order of
documents is that of the input's tasks and rows, frozen by the written table, so lost executors cannot change it.
Memory is bounded by runs of ``RUN`` bytes of text or ids, or one longer document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base, _tokens

WINDOW = 1024
END_ID = 0
#: Bytes of text or ids handled at a time.
RUN = 2 << 20
#: Totals of this many tasks are summed per group, so that no single window holds them all.
GROUP = 1024

TOKENIZED = "_doc_id long, _ids binary, _n long, _part long, _at long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids as little-endian uint16 with the closing id, and its place in its writer task."""
    path = tokenizer or _tokens.default_path()

    def run(batches):
        from pyspark import TaskContext

        encode, part, at = _tokens.encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for piece in _base.slices(batch, "_text", RUN):
                ids = [(encode(t).tobytes() if t else b"") + end for t in piece.column(1).to_pylist()]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                where = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part)), pa.array(where)],
                    ["_doc_id", "_ids", "_n", "_part", "_at"],
                )

    thin = docs.select(F.col(id_col).cast("long").alias("_doc_id"), F.col(text_col).alias("_text"))
    return thin.mapInArrow(run, TOKENIZED)


def task_offsets(tokens: DataFrame) -> DataFrame:
    """(_part, _base): tokens in all tasks before it, by prefix sums inside groups of tasks and over groups."""
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total")).withColumn("_group", F.floor(F.col("_part") / GROUP))
    groups = totals.groupBy("_group").agg(F.sum("_total").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("_group").orderBy("_part")
    totals = totals.withColumn("_inside", F.sum("_total").over(inside) - F.col("_total"))
    return totals.join(groups, "_group").select("_part", (F.col("_inside") + F.col("_before")).alias("_base"))


def placed(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenized documents with their global start ``_start``."""
    tokens = _base.materialize(tokenized(docs, tokenizer, id_col, text_col), "tokens")
    offsets = _base.materialize(task_offsets(tokens), "offsets")
    offsets = _base.broadcast_if_small(offsets, 16)
    return tokens.join(offsets, "_part").select("_doc_id", "_ids", "_n", (F.col("_at") + F.col("_base")).alias("_start"))


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document that lies in one window."""

    def run(batches):
        for batch in (part for whole in batches for part in _base.slices(whole, "_ids", RUN)):
            out = [[] for _ in range(7)]
            for doc, ids, n, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                wide, at = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                while at < n:
                    seq, off = divmod(start + at, window)
                    take = min(window - off, n - at)
                    crc = zlib.crc32(wide[4 * at : 4 * (at + take)])
                    for column, v in zip(out, (doc, at, take, crc, n, seq, off), strict=True):
                        column.append(v)
                    at += take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed(docs, tokenizer).mapInArrow(run, PIECES)


def sequences(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """The packed windows themselves: sequence_id, ids (uint16 LE). Windows that lie whole in one task are emitted
    there; only fragments at task borders are shuffled and joined. The last window is left at its own length when that
    is a power of two and otherwise padded with the closing id; n_ids tells how many ids are real."""

    size = 2 * window

    def run(batches):
        kept, first, at = bytearray(), 0, None  # the open window's bytes, where they begin in it, next global id

        def fragment():
            return (at - len(kept) // 2) // window, first, bytes(kept)

        for batch in (part for whole in batches for part in _base.slices(whole, "_ids", RUN)):
            rows = []
            for ids, start in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if at != start:
                    if kept:
                        rows.append(fragment())
                    kept, first, at = bytearray(), start % window, start
                done = 0
                while done < len(ids):
                    take = min(size - 2 * first - len(kept), len(ids) - done)
                    kept += ids[done : done + take]
                    done, at = done + take, at + take // 2
                    if 2 * first + len(kept) == size:
                        rows.append(fragment())
                        kept, first = bytearray(), 0
            yield as_batch(rows)
        if kept:
            yield as_batch([fragment()])

    def as_batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["sequence_id", "_off", "ids"]
        )

    parts = _base.materialize(placed(docs, tokenizer).mapInArrow(run, "sequence_id long, _off long, ids binary"), "windows")
    whole = F.length("ids") == 2 * window
    joined = parts.filter(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("_off", "ids"))).alias("_f"))
    joined = joined.select("sequence_id", F.expr("aggregate(_f, X'', (a, x) -> concat(a, x.ids))").alias("ids"))
    out = parts.filter(whole).select("sequence_id", "ids").unionByName(joined).withColumn("n_ids", F.expr("length(ids) div 2"))
    pad = F.expr(f"case when bit_count(n_ids) = 1 then ids else concat(ids, unhex(repeat('0000', int({window} - n_ids)))) end")
    return out.select("sequence_id", "n_ids", pad.alias("ids"))


def op10_pack_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(_base.read(spark, sf_dir, "documents"))


QUERIES = {"op10_pack_concat_and_cut": op10_pack_concat_and_cut}
ORACLES: dict[str, str] = {}
