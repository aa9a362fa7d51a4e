"""Near-duplicate classes by consistent weighted sampling (operator 8).

1. Statistics: a shingle's document frequency counts the *contexts* that hold it, over all documents: a context is the
   pair of smallest hashes (by two hash functions) among a document's distinct five-word shingles, so that a group of
   copies or near copies counts about once and is not taken for boilerplate by its own size. Frequencies are exact for
   every shingle in over 1 of ``COMMON`` contexts (and over ``FEW``): one pass sums contexts into fixed cells, which
   bound the frequencies of their shingles from above; a second pass counts, by shuffle, the shingles of those cells
   that reach the limit. Only the shingles over the limit are sent to all tasks: at most ``COMMON`` times the mean
   number of shingles in a document, however many documents there are.
2. Weights: tf * idf, idf = ln(C / df) over its value at the limit; rarer shingles weigh 1, ubiquitous ones ``FLOOR``.
3. Signatures: improved consistent weighted sampling, ``BANDS`` * ``ROWS`` samples (k*, t*) per document, drawn as
   argmin of ln c - r (t - beta + 1) with r, c ~ Gamma(2, 1) and beta uniform by hash of (shingle, sample). Sixteen bits
   of each sample are kept as the sketch.
4. Exact copies (equal text digest) are one node; only nodes go on.
5. Candidates: in each band bucket all members are compared with one member (by a hash), so pairs grow with the rows.
   Buckets that then still hold several classes are finished: each member outside the bucket's largest class meets
   every other member, in blocks of bounded size inside tasks, first by sketch; the texts of those whose sketches agree
   follow, and only links that join classes leave a task. So no two classes in a bucket stay uncompared.
6. A pair's texts meet only if at least ``AGREE`` of its 48 samples do (a pair of similarity 0.8 in a common bucket has
   fewer with probability 1e-6, under the 2e-3 at which the bands miss it). Verification is the exact weighted Jaccard of
   the whole texts; hubs with many members are split by a salt.
7. Classes are connected components of the verified links; the smallest doc_id names the class.

Hot keys: per-key tables are written before rows are joined to them, so that both sides of such a join are plain
shuffles and the engine's skew handling can split a hot digest, bucket or class; bucket and hub work is salted.

Defined results: a document is a distinct (doc_id, text): repeated rows are one document, and an id with several texts
is several documents of that id. Texts without words (null, empty, blank) are a class of their own each. Rows with a
null doc_id join classes, never name one unless no member has an id (class null). Documents with one to four words have
one shingle of them all; very long texts are sampled and compared whole. Ties cannot occur, since the smallest (id,
digest) names and represents a class; an empty table gives an empty result. The stage keeps one row of each class,
repeated rows included, with all its columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base, _graph, _text

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 4
CELLS = 1 << 18
#: idf falls for shingles in more than one of COMMON contexts, if those are more than FEW, down to FLOOR.
COMMON = 20
FEW = 20
FLOOR = 0.1
#: Equal samples of the 48 that a pair needs for its texts to be compared.
AGREE = 27
SALT_ROWS = 64
QUERY_BLOCK = 256
MEMBER_BLOCK = 256
U = np.uint64


def lowered(texts: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(texts, ""))


def doc_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text index, term frequency (sorted by text, hash)."""
    raw, offsets = _text.buffer_of(lowered(texts))
    _, _, h, at = _text.words(raw, offsets)
    return _text.counted(*_text.shingles(h, at, SHINGLE))


def contexts(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One value for each text from its two smallest shingle hashes; ``first``: where its shingles begin (none empty)."""
    if not len(first):
        return np.zeros(0, U)
    one, two = (np.minimum.reduceat(_text.mix(key ^ salt), first) for salt in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)))
    return _text.mix(one * U(0xD6E8FEB86659FD93) + two)


def _contexts_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts, the number of each one's context, and the contexts."""
    key, owner, _ = doc_shingles(texts)
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    found, number = np.unique(contexts(key, np.flatnonzero(new)), return_inverse=True)
    return key, number[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64), found


def _pairs(key: np.ndarray, number: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, number) pairs, numbers under ``most``."""
    order = np.lexsort((number, key))
    key, number = key[order], number[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (number[1:] != number[:-1])
    return key[new], number[new]


def cell_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> U(40)).astype(np.int64) & (CELLS - 1)


def limit_of(total: int) -> float:
    """Contexts that a shingle must exceed for its idf to fall."""
    return max(float(FEW), total / COMMON)


def corpus_weights(docs: DataFrame) -> dict:
    """The shingles whose idf is less than 1 (sorted) and their weights, from all documents."""
    texts = docs.select(F.col("text").alias("_text"))

    def cells(batches):
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in _base.slices(batch, "_text"):
                key, number, found = _contexts_of(part.column(0))
                cell, _ = _pairs(cell_of(key), number, len(found))
                seen += np.bincount(cell, minlength=CELLS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), 1), pa.int32()), pa.array(found.view(np.int64)), pa.array(np.ones(len(found), np.int64))], names=["kind", "value", "n"])
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at)), pa.int32()), pa.array(at), pa.array(seen[at])], names=["kind", "value", "n"])

    first = _base.materialize(texts.mapInArrow(cells, "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "cells")
    total = first.filter("kind = 1").count()
    heavy = first.filter((F.col("kind") == 0) & (F.col("n") > limit_of(total))).select("value").toArrow()["value"]
    _base.discard(first)
    if not len(heavy):
        return {"key": np.zeros(0, U), "w": np.zeros(0, np.float32)}
    marked = np.zeros(CELLS, bool)
    marked[np.asarray(heavy)] = True
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def exact(batches):
        for batch in batches:
            for part in _base.slices(batch, "_text"):
                key, number, found = _contexts_of(part.column(0))
                use = shared.value[cell_of(key)]
                k, c = _pairs(key[use], number[use], len(found))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(found[c].view(np.int64))], names=["shingle", "context"])

    counted = texts.mapInArrow(exact, "shingle long, context long").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    got = counted.filter(F.col("df") > limit_of(total)).toArrow()
    key, df = np.asarray(got["shingle"]).view(U), np.asarray(got["df"])
    order = np.argsort(key)
    return {"key": key[order], "w": idf(df[order], total)}


def idf(df: np.ndarray, total: int) -> np.ndarray:
    """ln(C / df) over its value at the limit, between FLOOR and 1."""
    top = np.log(max(total / limit_of(total), 1 + 1e-9))
    return np.clip(np.log(max(total, 1) / np.maximum(df, 1)) / top, FLOOR, 1).astype(np.float32)


def weight_of(weights: dict, key: np.ndarray) -> np.ndarray:
    out = np.ones(len(key), np.float32)
    if len(weights["key"]):
        at = np.minimum(np.searchsorted(weights["key"], key), len(weights["key"]) - 1)
        hit = weights["key"][at] == key
        out[hit] = weights["w"][at[hit]]
    return out


def _gamma2(levels: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middle of equal steps: solves 1 - (1 + x) e^-x = p by bisection."""
    p = (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma2(4096).astype(np.float32)
_INV_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_gamma2(65536)).astype(np.float32)
_BETA = ((np.arange(4096) + 0.5) / 4096).astype(np.float32)
_SEED = _text.mix(np.arange(1, 1025, dtype=U) * U(0x9E3779B97F4A7C15))


def icws(key: np.ndarray, weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) hashes of the drawn (shingle, t); ``first``: where each text's shingles begin (none empty)."""
    log_w = np.log(weight).astype(np.float32)
    low = np.arange(len(key), dtype=np.int64)
    out = np.empty((len(first), samples), U)
    for d in range(samples):
        h = (key ^ _SEED[d]) * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        ir = (h >> U(52)).astype(np.int32)
        ib = ((h >> U(40)) & U(4095)).astype(np.int32)
        ic = ((h >> U(20)) & U(65535)).astype(np.int32)
        beta = _BETA[ib]
        t = np.floor(log_w * _INV_R[ir] + beta)
        score = _LN_C[ic] - _R[ir] * (t - beta + np.float32(1)) + np.float32(256)
        packed = (np.maximum(score, 0).view(np.int32).astype(np.int64) << 32) | low
        pick = np.minimum.reduceat(packed, first) & 0xFFFFFFFF
        out[:, d] = _text.mix(key[pick] ^ ((t[pick].astype(np.int64) + 4096).astype(U) * U(0x9E3779B97F4A7C15)))
    return out


def signatures(docs: DataFrame, weights: dict, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, md5, bands, sketch) for every row; no bands for texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        table = shared.value
        for batch in batches:
            for part in _base.slices(batch, "_text"):
                key, owner, tf = doc_shingles(part.column(2))
                at = _text.segments(owner, part.num_rows)
                full = np.flatnonzero(np.diff(at))
                n = np.zeros(part.num_rows, np.int64)
                n[full] = 1
                drawn = icws(key, tf.astype(np.float32) * weight_of(table, key), at[full], bands * rows) if len(full) else np.zeros((0, bands * rows), U)
                step = _text._STEP[:rows]
                band = _text.mix((drawn.reshape(-1, bands, rows) * step).sum(2, dtype=U) + np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15))
                cut = lambda k: pa.array(np.append(0, np.cumsum(n * k)), pa.int32())
                keys = pa.ListArray.from_arrays(cut(bands), pa.array(band.view(np.int64).ravel()))
                sketch = pa.ListArray.from_arrays(cut(bands * rows), pa.array((drawn & U(0xFFFF)).astype(np.uint16).view(np.int16).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys, sketch], names=["id", "md5", "bands", "sketch"])

    thin = docs.select(F.col("doc_id").cast("long").alias("id"), _digest(F.col("text")).alias("md5"), F.col("text").alias("_text"))
    return thin.mapInArrow(run, "id long, md5 binary, bands array<long>, sketch array<short>")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _person(doc_id: Column, digest: Column) -> Column:
    """Key of a document: its digest and its id, which may be null."""
    return F.concat(digest, F.encode(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), "utf-8"))


def weighted_jaccard(ak, aw, bk, bw) -> float:
    """Of two sorted shingle arrays with weights."""
    if not len(ak) or not len(bk):
        return 0.0
    at = np.minimum(np.searchsorted(ak, bk), len(ak) - 1)
    hit = ak[at] == bk
    both = float(np.minimum(aw[at[hit]], bw[hit]).sum())
    return both / (float(aw.sum()) + float(bw.sum()) - both)


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int = AGREE) -> DataFrame:
    """Pairs (id, hub) whose sketches agree in at least ``least`` samples."""
    sketch = lambda n: nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"s_{n}"))
    both = pairs.join(sketch("id"), "id").join(sketch("hub"), "hub")
    same = F.aggregate(F.zip_with("s_id", "s_hub", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.filter(same >= least).select("id", "hub")


def verified(pairs: DataFrame, texts: DataFrame, weights: dict, threshold: float) -> DataFrame:
    """Pairs (id, hub) whose texts reach the threshold, with ``similarity``. Texts meet per (hub, salt), streamed."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    split = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("_s")).filter("_s > 1")
    split = _base.broadcast_if_small(_base.materialize(split, "split"), 24)
    salted = pairs.join(split, "hub", "left").select("hub", "id", F.expr("pmod(xxhash64(id), coalesce(_s, 1))").alias("salt"))
    needs = salted.withColumn("role", F.lit(1)).unionByName(salted.select("hub", F.col("hub").alias("id"), "salt", F.lit(0).alias("role")).distinct())
    rows = needs.join(texts, "id").select("hub", "salt", "role", "id", "_text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")

    def run(batches):
        table, hub, hk, hw = shared.value, None, None, None
        for batch in batches:
            for part in _base.slices(batch, "_text"):
                key, owner, tf = doc_shingles(part.column(4))
                w = tf.astype(np.float64) * weight_of(table, key)
                at = _text.segments(owner, part.num_rows)
                out = ([], [], [])
                for i, (h, role, d) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    k, v = key[at[i] : at[i + 1]], w[at[i] : at[i + 1]]
                    if role == 0:
                        hub, hk, hw = h, k.copy(), v.copy()
                    elif h == hub:
                        s = weighted_jaccard(hk, hw, k, v)
                        if s >= threshold:
                            for column, x in zip(out, (d, h, s), strict=True):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["id", "hub", "similarity"])

    return rows.mapInArrow(run, "id long, hub long, similarity double")


class Block:
    """Shingles of a block of texts, to be met by other texts: exact weighted Jaccard with all of them at once."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        owner = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts])
        key, weight = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
        order = np.argsort(key, kind="stable")
        self.n, self.key, self.owner, self.weight = len(parts), key[order], owner[order], weight[order]
        self.total = np.bincount(owner, weight, self.n)

    def jaccard(self, key: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, most: int = 2_000_000) -> np.ndarray:
        """(texts, n) similarities; shared shingles are expanded ``most`` at a time."""
        low = np.searchsorted(self.key, key, "left")
        count = np.searchsorted(self.key, key, "right") - low
        hit = np.flatnonzero(count)
        ends = np.cumsum(count[hit])
        both, a = np.zeros(texts * self.n), 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            h, c = hit[a:b], count[hit[a:b]]
            mine = np.repeat(h, c)
            other = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[h], c)
            both += np.bincount(owner[mine] * self.n + self.owner[other], np.minimum(weight[mine], self.weight[other]), texts * self.n)
            a = b
        both = both.reshape(texts, self.n)
        whole = np.bincount(owner, weight, texts)[:, None] + self.total[None, :] - both
        return both / np.maximum(whole, 1e-300)


def _blocks_of(rest: DataFrame, *extra: str) -> DataFrame:
    """Rows of the blocks in which mixed buckets are finished: (key, qb, mb, role, id, comp, ``extra``), asked first."""
    qbs, mbs = F.ceil(F.col("nd") / QUERY_BLOCK).cast("int"), F.ceil(F.col("n") / MEMBER_BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = rest.filter("comp <> main").select("key", mine(qbs).alias("qb"), each(mbs).alias("mb"), F.lit(0).alias("role"), "id", "comp", *extra)
    met = rest.select("key", each(qbs).alias("qb"), mine(mbs).alias("mb"), F.lit(1).alias("role"), "id", "comp", *extra)
    return asked.unionByName(met)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "qb", "mb").sortWithinPartitions("key", "qb", "mb", "role")


def _cuts(part: pa.RecordBatch) -> list[tuple[tuple, int, int, int]]:
    """(block, role, begin, end) of each run of rows."""
    place = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
    at = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
    return [(place[a][:3], place[a][3], a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def worth_comparing(rest: DataFrame, least: int = AGREE) -> DataFrame:
    """Of the rows of all blocks, those with a partner of another class whose sketch agrees with theirs."""
    rows = _in_blocks(_blocks_of(rest, "sketch"))
    names = ["key", "qb", "mb", "role", "id", "comp"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        at, asked, used = None, [], []

        def batch_of(block, role, ids, comps):
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([block[0]] * n, [block[1]] * n, [block[2]] * n, [role] * n, ids, comps), kinds, strict=True)], names=names)

        def close():
            if used and np.concatenate(used).any():
                keep = np.concatenate(used)
                ids, comps, _ = (np.concatenate(x) for x in zip(*asked, strict=True))
                yield batch_of(at, 0, ids[keep], comps[keep])

        for batch in batches:
            ids, comps = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            flat = batch.column(6).flatten().to_numpy(zero_copy_only=False)
            sketch = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat
            for block, role, a, b in _cuts(batch):
                if block != at:
                    yield from close()
                    at, asked, used = block, [], []
                if role == 0:
                    asked.append((ids[a:b], comps[a:b], sketch[a:b]))
                    used.append(np.zeros(b - a, bool))
                elif asked:
                    if len(asked) > 1:
                        asked, used = [tuple(np.concatenate(x) for x in zip(*asked, strict=True))], [np.concatenate(used)]
                    _, own, q = asked[0]
                    for lo in range(a, b, 64):
                        hi = min(b, lo + 64)
                        near = (sketch[lo:hi, None, :] == q[None]).sum(2) >= least
                        near &= comps[lo:hi, None] != own[None]
                        used[0] |= near.any(0)
                        hit = near.any(1)
                        if hit.any():
                            yield batch_of(block, 1, ids[lo:hi][hit], comps[lo:hi][hit])
        yield from close()

    return rows.mapInArrow(run, "key long, qb int, mb int, role int, id long, comp long")


def bridged(rest: DataFrame, texts: DataFrame, weights: dict, threshold: float) -> DataFrame:
    """Links between different classes inside buckets that hold several: every member outside a bucket's largest class
    is compared with every other member, in blocks, and a link is returned wherever it joins two classes not joined
    before in the same block. ``rest``: key, id, comp, sketch, main, n (members), nd (those outside the main class)."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    worth = _base.materialize(worth_comparing(rest), "worth")
    rows = _in_blocks(worth.join(texts, "id").select("key", "qb", "mb", "role", "id", "comp", "_text"))

    def run(batches):
        table, at, block, parts, who, joined = shared.value, None, None, [], [], {}

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for batch in batches:
            for part in _base.slices(batch, "_text", 1 << 17):
                key, owner, tf = doc_shingles(part.column(6))
                w = tf.astype(np.float64) * weight_of(table, key)
                seg = _text.segments(owner, part.num_rows)
                ids, comp = (np.asarray(part.column(i)) for i in (4, 5))
                out = []
                for place, role, a, b in _cuts(part):
                    if place != at:
                        at, block, parts, who, joined = place, None, [], [], {}
                    if role == 0:
                        parts += [(key[seg[i] : seg[i + 1]].copy(), w[seg[i] : seg[i + 1]].copy()) for i in range(a, b)]
                        who += list(zip(ids[a:b].tolist(), comp[a:b].tolist(), strict=True))
                        continue
                    if not parts:
                        continue
                    block = block or Block(parts)
                    span = slice(seg[a], seg[b])
                    like = block.jaccard(key[span], owner[span] - a, w[span], b - a)
                    like[comp[a:b, None] == np.array([c for _, c in who])[None, :]] = 0
                    for i, j in np.argwhere(like >= threshold).tolist():
                        x, y = root(int(comp[a + i])), root(who[j][1])
                        if x != y:
                            joined[max(x, y)] = min(x, y)
                            out.append((int(ids[a + i]), who[j][0], float(like[i, j]), int(comp[a + i]), who[j][1]))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["id", "hub", "similarity", "a", "b"])

    return rows.mapInArrow(run, "id long, hub long, similarity double, a long, b long")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, is_kept, md5, n_rows) for every document, and verified links between nodes that span the classes."""
    docs = docs.select("doc_id", "text")
    weights = corpus_weights(docs)
    signed = _base.materialize(signatures(docs, weights, bands, rows), "signatures")
    people = signed.groupBy("id", "md5").agg(F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    people = _base.materialize(people, "people")
    _base.discard(signed)
    wordy = people.filter(F.size("bands") > 0)
    who = F.struct(F.col("id").isNull().alias("z"), "id", "n")
    nodes = wordy.groupBy("md5").agg(F.min(who).alias("w"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "md5", F.col("w.id").alias("rep"), F.col("w.n").alias("times"), "copies", "bands", "sketch")
    nodes = _base.materialize(nodes, "nodes")  # numbers are unique and stay what they are: the table is written once

    band = nodes.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    lead = band.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("r"), F.col("id").alias("id"))).alias("l"), F.count(F.lit(1)).alias("n"))
    lead = _base.materialize(lead.filter("n > 1").select("key", F.col("l.id").alias("hub"), "n"), "leads")
    members = _base.materialize(band.join(lead, "key"), "buckets")
    pairs = members.filter("id <> hub").groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    pairs = pairs.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("id"), "hub")
    pairs = _base.materialize(agreeing(pairs, nodes), "pairs")
    texts = _texts(docs, nodes, members)
    links = _base.materialize(verified(pairs, texts, weights, threshold), "links")
    label = _graph.components(links, "id", "hub")

    known = members.filter("n > 2").join(label, members["id"] == label["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    known = _base.materialize(known, "known")
    per = known.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("nd"))
    per = _base.materialize(per.filter("k > 1").drop("k"), "mixed")
    sketch = nodes.select(F.col("node").alias("id"), "sketch")
    rest = _base.materialize(known.join(per, "key").join(sketch, "id"), "rest")
    more = _base.materialize(bridged(rest, texts, weights, threshold), "links")
    if more.limit(1).count():
        again = _graph.components(more, "a", "b")
        over = label.join(again.select(F.col("node").alias("component"), F.col("component").alias("_over")), "component", "left")
        alone = again.join(label.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
        label = _base.materialize(over.select("node", F.coalesce("_over", "component").alias("component")).unionByName(alone), "label")
        links = links.unionByName(more.drop("a", "b"))

    linked = _base.materialize(nodes.join(label, "node").select("md5", "rep", "component"), "linked")
    first = F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "md5"))
    names = _base.materialize(linked.groupBy("component").agg(first.alias("w")), "names")
    named = linked.join(names, "component").select("md5", F.col("w.rep").alias("class_id"), F.col("w.md5").alias("lead"))
    alone = nodes.filter("copies > 1").join(label.select("node"), "node", "left_anti").select("md5", F.col("rep").alias("class_id"), F.col("md5").alias("lead"))
    named = _base.materialize(named.unionByName(alone), "named")
    found = wordy.select("id", "md5", "n").join(named, "md5", "left")
    grouped = F.col("lead").isNotNull()
    found = found.select(
        F.col("id").alias("doc_id"),
        F.when(grouped, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(grouped, (F.col("md5") == F.col("lead")) & F.col("id").eqNullSafe(F.col("class_id"))).otherwise(F.lit(True)).alias("is_kept"),
        "md5",
        F.col("n").alias("n_rows"),
    )
    # texts without words, one class each; rows that have no id either cannot be told apart and all stay
    blank = people.filter(F.size("bands") == 0)
    blank = blank.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(True).alias("is_kept"), "md5", F.when(F.col("id").isNull(), F.lit(1)).otherwise(F.col("n")).alias("n_rows"))
    return found.unionByName(blank), links


def _texts(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(id, _text) of every node in a bucket, from one row of the document that represents it."""
    wanted = nodes.join(members.select(F.col("id").alias("node")).distinct(), "node").select("node", _person(F.col("rep"), F.col("md5")).alias("_p"), "times")
    wanted = _base.materialize(wanted, "wanted")
    rows = docs.select(_person(F.col("doc_id"), _digest(F.col("text"))).alias("_p"), F.col("text").alias("_text"))

    def of(some: DataFrame) -> DataFrame:
        return rows.join(_base.broadcast_if_small(some, 64), "_p").select(F.col("node").alias("id"), "_text")

    out = of(wanted.filter("times = 1"))
    if wanted.filter("times > 1").limit(1).count():
        out = out.unionByName(of(wanted.filter("times > 1")).dropDuplicates(["id"]))
    return _base.materialize(out, "texts")


def op8_icws_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = classes(_base.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "is_kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, in the columns of ``docs``."""
    inner, at = _base.plain(docs)
    found, _ = classes(inner.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")))
    marked = found.filter("not is_kept or n_rows > 1").select(_person(F.col("doc_id"), F.col("md5")).alias("_p"), "is_kept")
    marked = _base.materialize(marked, "marked")
    keyed = inner.withColumn("_p", _person(F.col(at["doc_id"]), _digest(F.col(at["text"]))))
    out = keyed.join(_base.broadcast_if_small(marked.select("_p"), 64), "_p", "left_anti").select(*inner.columns)
    repeated = marked.filter("is_kept").select("_p")
    if repeated.limit(1).count():
        again = keyed.join(_base.broadcast_if_small(repeated, 64), "_p", "left_semi").dropDuplicates(["_p"])
        out = out.unionByName(again.select(*inner.columns))
    return out.toDF(*docs.columns)


QUERIES = {"op8_icws_near_duplicates": op8_icws_near_duplicates}
ORACLES: dict[str, str] = {}
