"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 9), largest inner product.

Vectors become points whose Euclidean neighbours are their inner-product neighbours: data x -> (x, sqrt(M^2 - |x|^2)),
queries q -> (q M / |q|, 0), with M the largest norm. Each of ``TABLES`` tables hashes a point by K Gaussian (2-stable)
projections cut into slots of width W; K grows with the logarithm of the table so that buckets number about the square
root of the rows. A query visits its own bucket and then perturbed buckets in the order of their estimated success
probability, the product over projections of the normal mass of the slot for a neighbour at distance R, until the
visited mass reaches ``SUCCESS`` in each table (two tables then miss a neighbour at R with (1 - SUCCESS)^2). R is the
mean distance of a query's farthest wanted neighbour, measured on a bounded sample (``SAMPLE``) and scaled to the
table's size; every row is indexed and no bucket or candidate list is capped. Candidates of a bucket are compared
exactly (inner products in double precision of the original vectors) in blocks; each task keeps the best found per
query, and the tables' results are merged. A query that has met fewer than it asks for is compared with every vector.

Equal vectors (by digest of their bytes) are one class: a class answers with its ``k + 1`` smallest ids, which is exact,
since any further copy has the same score and a larger id. Big buckets are split over tasks by a salt, with their probes
repeated per salt; bucket sizes, repeated digests and further ids of a class are small tables, broadcast if counted to
be small, and written before anything is joined to them otherwise, so that a hot key can be split. Scores are summed
component by component in one fixed order, whichever block a pair meets in; block products only choose what is summed.

Defined results: vectors that are null, zero, of another length than most, or with null or non-finite components take
no part, as queries or candidates; null ids likewise; repeated (vec_id, vector) rows count once; an id with several
vectors is each of them; ties go to the smaller vec_id; fewer candidates than k give them all; components are scaled
by the largest before hashing, so that finite vectors may be of any size (a product beyond a double's range is infinite
and ranks so); an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _base

K_NEAREST = 20
QUERY_EVERY = 20
TABLES = 2
SUCCESS = 0.78
SAMPLE = 4096
SPLIT = 4096
TASK_ROWS = 20_000
SEED = 11


def usable(table: DataFrame) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).filter(~bad & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)).dropDuplicates(["id", "v"])


def plan(rows: int, dim: int, top: float, near: float, points: np.ndarray) -> dict:
    """Projections for a table of ``rows`` vectors: about sqrt(rows) buckets a table, as slots of 1.2 deviations of
    the projected points hold e^1.24 effective values each."""
    k = max(1, round(math.log(max(rows, 2)) / 2 / 1.24))
    rng = np.random.RandomState(SEED)
    a, b = rng.normal(size=(TABLES, dim + 1, k)), rng.uniform(size=(TABLES, k))
    spread = np.stack([(points @ a[t]).std(0) if len(points) > 1 else np.full(k, top) for t in range(TABLES)])
    return {"a": a, "b": b, "w": np.maximum(1.2 * spread, 1e-9 * max(top, 1e-300)), "top": top, "near": near}


def positions(p: dict, t: int, points: np.ndarray) -> np.ndarray:
    return points @ p["a"][t] / p["w"][t] + p["b"][t]


def bucket_key(t: int, slots: np.ndarray) -> np.ndarray:
    """64-bit key of slot vectors (rows)."""
    h = np.full(len(slots), (t * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for j in range(slots.shape[1]):
        h = (h ^ slots[:, j].astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


_erf = np.vectorize(math.erf, otypes=[float])


def _mass(sigma: np.ndarray, pos: np.ndarray, reach: int) -> np.ndarray:
    """Of one position per projection: probability that a neighbour lies in slot floor + o, o from -reach to reach."""
    edges = np.floor(pos)[:, None] + np.arange(-reach, reach + 2)[None, :] - pos[:, None]
    cdf = 0.5 * (1 + _erf(edges / sigma[:, None] / math.sqrt(2)))
    return np.diff(cdf, axis=1)


def probes(p: dict, t: int, point: np.ndarray, success: float) -> np.ndarray:
    """Slot vectors in falling order of estimated success until their probabilities add up to ``success``.

    Per projection, slots are ordered by mass; combinations are expanded best first from a heap, as each next
    combination is a parent with one projection moved to its next best slot."""
    import heapq

    pos = positions(p, t, point[None])[0]
    sigma = np.maximum(p["near"] / p["w"][t], 1e-9)
    reach = max(2, min(64, math.ceil(4 * float(sigma.max()))))
    mass = _mass(sigma, pos, reach)
    order = np.argsort(-mass, 1, kind="stable")
    logs = np.log(np.maximum(np.take_along_axis(mass, order, 1), 1e-300))
    base, k = np.floor(pos).astype(np.int64), len(pos)
    start = (0,) * k
    heap, total, out = [(-float(logs[:, 0].sum()), start, 0)], 0.0, []
    while heap and total < success:
        cost, at, last = heapq.heappop(heap)
        total += math.exp(-cost)
        out.append([base[j] + order[j, at[j]] - reach for j in range(k)])
        for j in range(last, k):  # each combination has one parent: only projections from the last moved one on
            if at[j] + 1 < logs.shape[1]:
                nxt = (*at[:j], at[j] + 1, *at[j + 1 :])
                heapq.heappush(heap, (cost + float(logs[j, at[j]] - logs[j, at[j] + 1]), nxt, j))
    return np.array(out, np.int64)


def digested(rows: DataFrame) -> DataFrame:
    """``rows`` (id, v) with the digest of each vector's bytes (-0 is 0)."""

    def run(batches):
        import hashlib

        for batch in batches:
            v = _matrix(batch.column(1)) + 0.0
            found = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1)], names=["id", "digest", "v"])

    return rows.mapInArrow(run, "id long, digest binary, v array<double>")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def nearest(table: DataFrame, queries: Column, k: int = K_NEAREST, success: float = SUCCESS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` (over id) holds."""
    spark = table.sparkSession
    rows = _base.materialize(digested(usable(table)), "vectors")
    again = rows.groupBy("digest").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = _base.broadcast_if_small(_base.materialize(again, "repeated"), 40)
    member = rows.join(again, "digest", "left").select("id", F.coalesce("cls", "id").alias("cls"), "v")
    member = _base.materialize(member, "classes")
    big = member.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / big) * (x / big)))
    stat = member.filter("id = cls").agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    n, dim, top = int(stat[0]), int(stat[1] or 1), float(stat[2] or 1.0)
    model = _fitted(member, n, dim, top, big, k)
    shared = spark.sparkContext.broadcast(model)

    def index(batches):
        p = shared.value
        for batch in batches:
            v = _matrix(batch.column(1))
            if not len(v):
                continue
            pts = _points(v / p["big"], p["top"])
            for t in range(TABLES):
                keys = bucket_key(t, np.floor(positions(p, t, pts)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *batch.columns], names=["key", "cls", "v"])

    def visit(batches):
        p = shared.value
        for batch in batches:
            v = _matrix(batch.column(1)) / p["big"]
            for i, cls in enumerate(batch.column(0).to_pylist()):
                point = np.append(_direction(v[i : i + 1], p["top"])[0], 0.0)
                found = [bucket_key(t, probes(p, t, point, success)) for t in range(TABLES)]
                keys = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), cls))], names=["key", "cls"])

    classes = member.filter("id = cls").select("cls", "v")
    data = classes.mapInArrow(index, "key long, cls long, v array<double>")
    data = _base.materialize(data, "index")
    asked = member.filter(queries).select("cls").distinct()
    asked_v = classes.join(asked, "cls")
    visits = asked_v.mapInArrow(visit, "key long, cls long")
    # about the square root of the rows: buckets and their numbers of salts
    salts = _base.materialize(data.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("s")), "buckets")
    salts = _base.broadcast_if_small(salts, 24)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * TABLES / TASK_ROWS))
    pid = F.pmod(F.xxhash64("key", "salt"), F.lit(tasks)).alias("pid")
    block = F.xxhash64("key", "salt").alias("block")
    left = data.join(salts, "key").withColumn("salt", F.expr("pmod(xxhash64(cls), s)"))
    left = left.select(pid, F.lit(0).alias("role"), "cls", F.array(block).alias("blocks"), "v")
    right = visits.join(salts, "key").select("key", "cls", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("salt"))
    right = right.select(pid, block, "cls").groupBy("pid", "cls").agg(F.collect_list("block").alias("blocks")).join(asked_v, "cls")
    both = left.unionByName(right.select("pid", F.lit(1).alias("role"), "cls", "blocks", "v"))
    both = both.repartition(tasks, "pid").sortWithinPartitions("pid", "role")

    def search(batches):
        at, loose, ready = None, [], {}
        for batch in batches:
            pids, role, cls = (batch.column(i).to_numpy() for i in range(3))
            v = _matrix(batch.column(4))
            begin = batch.column(3).offsets.to_numpy()
            begin, flat = begin - begin[0], batch.column(3).flatten().to_numpy()
            cuts = np.flatnonzero((np.diff(pids) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(pids)], strict=True):
                if a == b:
                    continue
                if pids[a] != at:
                    at, loose, ready = pids[a], [], {}
                if role[a] == 0:
                    loose.append((flat[begin[a] : begin[b]], cls[a:b], v[a:b]))
                    continue
                if loose:
                    ready, loose = _blocks(*(np.concatenate(x) for x in zip(*loose, strict=True))), []
                for lo in range(a, b, 512):
                    hi = min(b, lo + 512)
                    owner = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1]))
                    q, i, x = _best(ready, flat[begin[lo] : begin[hi]], owner, v[lo:hi], k + 1)
                    cut = pa.array(np.searchsorted(q, np.arange(hi - lo + 1)), pa.int32())
                    lists = [pa.ListArray.from_arrays(cut, pa.array(y)) for y in (i, x)]
                    yield pa.RecordBatch.from_arrays([pa.array(cls[lo:hi]), *lists], names=["cls", "ids", "scores"])

    def partial_of(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(search, "cls long, ids array<long>, scores array<double>")

    partial = partial_of(both)

    def merge(batches):
        held = None  # the last query's lists may go on in the next batch
        for batch in batches:
            n = np.diff(batch.column(1).offsets.to_numpy())
            now = np.repeat(batch.column(0).to_numpy(), n), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            q, i, x = now if held is None else (np.append(h, m) for h, m in zip(held, now, strict=True))
            q, i, x = _leading(q, i, x, k + 1)
            open_ = q == q[-1] if len(q) else np.zeros(0, bool)
            held = q[open_], i[open_], x[open_]
            done = ~open_
            yield pa.RecordBatch.from_arrays([pa.array(q[done]), pa.array(i[done]), pa.array(x[done])], names=["cls", "near", "score"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([*map(pa.array, held)], names=["cls", "near", "score"])

    def best_of(lists: DataFrame) -> DataFrame:
        return lists.repartition("cls").sortWithinPartitions("cls").mapInArrow(merge, "cls long, near long, score double")

    merged = _base.materialize(best_of(partial), "found")
    # a query far from all others may have met too few: it is compared with every vector, in blocks
    met = merged.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    short = asked.join(met, "cls", "left").filter(F.coalesce("n", F.lit(0)) < min(k + 1, n)).select("cls")
    short = _base.materialize(short, "short")
    if short.limit(1).count():
        parts = math.ceil(n / SPLIT)
        at = F.pmod(F.xxhash64("cls"), F.lit(parts))
        all_ = classes.select(at.alias("pid"), F.lit(0).alias("role"), "cls", F.array(at).alias("blocks"), "v")
        ask = short.join(asked_v, "cls").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("pid"), "cls", "v")
        ask = ask.select("pid", F.lit(1).alias("role"), "cls", F.array("pid").alias("blocks"), "v")
        rest = all_.unionByName(ask).repartition(max(tasks, parts), "pid").sortWithinPartitions("pid", "role")
        merged = best_of(partial_of(rest).unionByName(merged.groupBy("cls").agg(F.collect_list("near").alias("ids"), F.collect_list("score").alias("scores"))))
    # classes back to rows: each near class stands for its k + 1 smallest ids
    more = member.filter("id <> cls").select("cls", F.col("id").alias("vec_id"))
    more = more.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))).filter(F.col("r") <= k).drop("r")
    more = _base.broadcast_if_small(_base.materialize(more, "further"), 24)
    near = merged.select(F.col("cls").alias("q"), F.col("near").alias("vec_id"), "score")
    near = near.unionByName(merged.select(F.col("cls").alias("q"), F.col("near").alias("cls"), "score").join(more, "cls").select("q", "vec_id", "score"))
    per = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("r", F.row_number().over(per)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("x"))
    near = _base.materialize(near, "nearest")
    out = member.filter(queries).select("id", F.col("cls").alias("q")).join(near, "q")
    own = F.slice(F.filter("x", lambda e: e["vec_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(own).alias("rank", "e"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _points(v: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(top**2 - (v * v).sum(1), 0))[:, None]])


def _direction(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors (not zero) at length ``top``."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v * (top / np.linalg.norm(v, axis=1, keepdims=True))


def _blocks(block: np.ndarray, ids: np.ndarray, v: np.ndarray) -> dict:
    """block -> (ids in order, vectors)."""
    order = np.lexsort((ids, block))
    block, ids, v = block[order], ids[order], v[order]
    cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
    return {int(block[a]): (ids[a:b], v[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def _best(ready: dict, block: np.ndarray, owner: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each query row over its blocks, ties to the smaller id: (row, id, score) in order."""
    rows, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    order = np.argsort(block, kind="stable")
    cuts = np.append(np.flatnonzero(np.append(True, np.diff(block[order]) != 0)), len(block)) if len(block) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found = ready.get(int(block[order[a]]))
        if found is None:
            continue
        who = owner[order[a:b]]
        with np.errstate(over="ignore", invalid="ignore"):
            score = v[who] @ found[1].T
        if score.shape[1] <= k or not np.isfinite(score).all():
            r, c = np.divmod(np.arange(score.size), score.shape[1])
        else:
            # a block product is off by less than this; what may be among the best is summed again in a fixed order
            off = v.shape[1] * 2.0**-50 * np.linalg.norm(v[who], axis=1) * np.linalg.norm(found[1], axis=1).max()
            edge = -np.partition(-score, k - 1, 1)[:, k - 1]
            r, c = np.nonzero(score >= (edge - 2 * off)[:, None])
        for lo in range(0, len(r), 1 << 16):
            rr, cc = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
            rows.append(who[rr])
            ids.append(found[0][cc])
            scores.append(_product(v[who[rr]], found[1][cc]))
    return _leading(np.concatenate(rows), np.concatenate(ids), np.concatenate(scores), k)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the order that its length alone fixes."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.ascontiguousarray(a * b).sum(1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _leading(q: np.ndarray, i: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) entries: the k best distinct ids of each query, in order."""
    order = np.lexsort((i, q))
    q, i, x = q[order], i[order], x[order]
    new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])) if len(q) else np.zeros(0, bool)
    q, i, x = q[new], i[new], x[new]
    order = np.lexsort((i, -x, q))
    q, i, x = q[order], i[order], x[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], i[place < k], x[place < k]


def _fitted(member: DataFrame, n: int, dim: int, top: float, big: float, k: int) -> dict:
    """Slot width and expected neighbour distance from a bounded sample (smallest hashes of id), of scaled vectors."""
    got = member.filter("id = cls").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    v = _matrix(pa.concat_arrays(got["v"].chunks)) / big if got.num_rows else np.zeros((0, dim))
    if len(v) < 2:
        return plan(n, dim, top, top, np.zeros((0, dim + 1))) | {"big": big}
    pts = _points(v, top)
    q = np.hstack([_direction(v[:256], top), np.zeros((min(len(v), 256), 1))])
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (pts * pts).sum(1)[None] - 2 * q @ pts.T, 0))
    d.sort(1)
    # the wanted neighbour's rank in the sample is its rank in the table, scaled down; itself (first) is left out
    rank = min(len(v) - 1, max(1, math.ceil(k * len(v) / max(n, 1))))
    return plan(n, dim, top, float(d[:, rank].mean()), pts) | {"big": big}


def op9_multiprobe_pstable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_base.read(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0)


QUERIES = {"op9_multiprobe_pstable_search": op9_multiprobe_pstable_search}
ORACLES: dict[str, str] = {}
