"""LM scoring by cross-entropy difference (operator 7).

Two interpolated bigram models, of the target (documents labelled of good quality) and of the background (all
documents), share one vocabulary and the same smoothing. A document's score is the mean over its words of target loss
minus background loss (nats): lower means more like the target.

Counts come from every document and are kept for every distinct word and word pair, told apart by 64-bit hashes: the
model grows with the input and stays distributed. Documents are cut into blocks; a block sends its distinct words and
pairs with their counts to the parts of the key space, each part sums them and answers every block with the sums of
its own keys in their order, and the block's documents are scored where its text and the answers meet. Nothing but
the totals reaches the driver. The label side is broadcast only if counted to be small.

Defined results: texts without words (null, empty, blank) score 0 with 0 words; null ids are counted in the
background and scored; labels with nulls are ignored and repeated ones averaged; without any target document both
models are smoothed alike and scores follow the background only; repeated rows count and score each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _text

#: The smoothing's number of words, or the distinct words if they are more.
WORD_CELLS = 1 << 18
#: Weight of the pair model, and pseudo-counts of a word and of a context.
PAIR_WEIGHT = 0.6
PSEUDO = 0.5
CONTEXT = 4.0
#: Bytes of text in a block and for each part of the key space.
BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20
_START = np.uint64(0x9E3779B97F4A7C15)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The corpus of both models; they are counted when documents are scored, with the keys those ask for."""
    good = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.avg(label).alias("_q")).filter("_q > 0.5").select("_id")
    side = _base.broadcast_if_small(_base.materialize(good, "good"), 16)
    thin = docs.select("doc_id", F.col("text").alias("_text"))
    known = thin.filter("doc_id is not null").join(side, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "_text", F.col("_id").isNotNull().alias("_good"))
    return {"docs": docs, "blocks": _blocks(known.unionByName(thin.filter("doc_id is null").withColumn("_good", F.lit(False))), 0)}


def _blocks(flagged: DataFrame, kind: int) -> DataFrame:
    """(block, size, body): runs of rows as compressed Arrow streams, and their bytes before; kind 0 is counted, kind 1 only asks."""

    def run(batches):
        at = (kind << 62) | (TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in _base.slices(batch, "_text", BLOCK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                body = sink.getvalue()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.nbytes], pa.int64()), pa.array([body.to_pybytes()], pa.binary())], names=["block", "size", "body"])
                at += 1

    return _base.materialize(flagged.mapInArrow(run, "block long, size long, body binary"), "blocks")


def _rows(body: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows, the key of each word and of its predecessor (start mark for the first), and where texts begin."""
    import pyarrow.compute as pc

    rows = pa.ipc.open_stream(body).read_next_batch()
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for part in _base.slices(rows, "_text"):
        _, _, h, at = _text.words(*_text.buffer_of(pc.utf8_lower(pc.fill_null(part.column(1), ""))))
        keys.append(h)
        sizes.append(np.diff(at))
    h, at = np.concatenate(keys), np.cumsum(np.concatenate(sizes))
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1][np.diff(at) > 0]] = _START
    return rows, h, before, at


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order that sorts, where each begins in it and the place of every key."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[first], order, first, place


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def _pack(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, compressed, after their number."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], 8 * int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pair(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _text.mix(before * np.uint64(0xD6E8FEB86659FD93) + h)


def _asks(blocks: DataFrame, bits: int) -> DataFrame:
    """(part, block, kind, keys, n, g): distinct words (kind 0) and pairs (1) of each block, by the keys' top bits."""

    def run(batches):
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, h, before, at = _rows(body.as_py())
                counted = block >> 62 == 0
                mine = np.asarray(rows.column(2).to_pylist(), bool)
                good, texts = np.repeat(mine, np.diff(at)).astype(np.int64), np.diff(at) > 0
                starts = np.full(int(texts.sum()), _START)
                for kind, (keys, flag) in enumerate(((np.concatenate([h, starts]), np.concatenate([good, mine[texts].astype(np.int64)])), (_pair(h, before), good))):
                    found, order, first, _ = _distinct(keys)
                    n, g = np.diff(np.append(first, len(keys))) * counted, _sums(flag[order], first) * counted
                    cut = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
                    use = np.flatnonzero(np.diff(cut))
                    spans = [slice(cut[p], cut[p + 1]) for p in use]
                    data = [[_pack(np.diff(found[s], prepend=np.uint64(0))) for s in spans], [_pack(n[s]) for s in spans], [_pack(g[s]) for s in spans]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(use, pa.int64()), pa.array([block] * len(use), pa.int64()), pa.array([kind] * len(use), pa.int32()), *(pa.array(x, pa.binary()) for x in data)],
                        names=["part", "block", "kind", "keys", "n", "g"],
                    )

    return blocks.select("block", "body").mapInArrow(run, "part long, block long, kind int, keys binary, n binary, g binary")


def _answers(asks: DataFrame, kind: int) -> DataFrame:
    """(block, part, kind, n, g) for blocks of ``kind``: sums over all blocks of each key asked for, in the asked order;
    and rows without a block that hold a part's distinct words and its sums."""

    def run(table):
        out = []
        part = table["part"][0].as_py()
        for what in (0, 1):
            rows = [r for r in table.select(["block", "kind", "keys", "n", "g"]).to_pylist() if r["kind"] == what]
            if not rows:
                continue
            keys = [np.cumsum(_unpack(r["keys"]), dtype=np.uint64) for r in rows]
            _, order, first, place = _distinct(np.concatenate(keys))
            n, g = (_sums(np.concatenate([_unpack(r[c]) for r in rows]).astype(np.int64)[order], first) for c in ("n", "g"))
            if not what:
                out.append((None, part, what, None, None, int((n > 0).sum()), int(n.sum()), int(g.sum())))
            at = np.cumsum([0, *map(len, keys)])
            for i, r in enumerate(rows):
                if r["block"] >> 62 == kind:
                    own = place[at[i] : at[i + 1]]
                    out.append((r["block"], part, what, _pack(n[own]), _pack(g[own]), 0, 0, 0))
        names = ["block", "part", "kind", "n", "g", "words", "total", "good"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return asks.groupBy("part").applyInArrow(run, "block long, part long, kind int, n binary, g binary, words long, total long, good long")


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for each row."""
    same = docs is model["docs"]
    blocks = model["blocks"] if same else _blocks(docs.select("doc_id", F.col("text").alias("_text"), F.lit(False).alias("_good")), 1)
    size = (model["blocks"].agg(F.sum("size")).first()[0] or 0) + (0 if same else blocks.agg(F.sum("size")).first()[0] or 0)
    bits = int(np.ceil(np.log2(max(1.0, size / PART_BYTES))))
    asks = _asks(model["blocks"], bits) if same else _asks(model["blocks"], bits).unionByName(_asks(blocks, bits))
    answers = _base.materialize(_answers(asks, 0 if same else 1), "answers")
    words, *totals = (x or 0 for x in answers.agg(F.sum("words"), F.sum("total"), F.sum("good")).first())
    size = max(WORD_CELLS, words)
    schema = docs.select("doc_id").schema.add("n_words", "long").add("target_loss", "double").add("background_loss", "double").add("score", "double")

    def run(left, right):
        told = sorted(right.select(["kind", "part", "n", "g"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        out = []
        for body in left["body"]:
            rows, h, before, at = _rows(body.as_py())
            texts = int((np.diff(at) > 0).sum())
            known, _, _, _ = _distinct(np.append(h, [_START] * bool(texts)).astype(np.uint64))
            _, order, first, place = _distinct(_pair(h, before))
            lead = order[first]  # one occurrence of each distinct pair
            word, context = np.searchsorted(known, h[lead]), np.searchsorted(known, before[lead])
            mean = []
            for name, total in (("g", totals[1]), ("n", totals[0])):
                one, two = (np.concatenate([np.zeros(0, np.uint64), *(_unpack(r[name]) for r in told if r["kind"] == k)]).astype(np.float64) for k in (0, 1))
                single = (one[word] + PSEUDO) / (total + PSEUDO * size)
                double = (two + CONTEXT * single) / (one[context] + CONTEXT)
                loss = -np.log(PAIR_WEIGHT * np.minimum(double, 1) + (1 - PAIR_WEIGHT) * single)
                mean.append(np.diff(np.append(0.0, np.cumsum(loss[place]))[at]) / np.maximum(np.diff(at), 1))
            out.append(pa.Table.from_arrays([rows.column(0), pa.array(np.diff(at)), *map(pa.array, (mean[0], mean[1], mean[0] - mean[1]))], names=schema.names))
        return pa.concat_tables(out)

    own = answers.filter("block is not null").select("block", "part", "kind", "n", "g")
    return blocks.select("block", "body").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, train(docs, _base.read(spark, sf_dir, "labels")))


QUERIES = {"op7_cross_entropy_difference": op7_cross_entropy_difference}
ORACLES: dict[str, str] = {}
