"""Quality classifier: factorisation machine over hashed words, structure statistics and metadata (operator 1).

Features of a document: hashed words (weight log(1 + count), scaled to unit length), bucketed structure statistics of
its whole text (length, symbols, capitals, digits, blanks, word and line shapes, repetition) and bucketed metadata
columns that are no label (``META``: the declared number of characters, where the table has it; null is a bucket).
The model is y = w0 + <w, x> + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise sum is computed in linear time as half of the
squared sum minus the sum of squares, per factor.

Training reads at most ``TRAIN_ROWS`` labelled ids and texts and ``TRAIN_BYTES`` of text (documented bounds; those with
the smallest hashes, each distinct text of an id once) and fits by mini-batch Adagrad on logistic loss. The map from raw
score to probability (Platt's, with smoothed targets) is fitted on scores that models of the other folds give to rows
they have not seen, so ``score >= 0.3`` is a decision about unseen documents. Scoring is one map over all rows, without
a shuffle.

Defined results: null and empty texts are scored like any other (no words, zero statistics), very long ones whole, in
memory in proportion to the text; a null doc_id scores normally, is never learned from and counts as held out only if
its remainder is 0 (null: false); repeated rows and ties give a row each; an empty table gives an empty result; with no
usable labels, or only one kind, every score is that kind's smoothed share (no labels: 0.5). Null labels are ignored;
several labels of one document are averaged. Extra columns pass through whatever their names; a column named like the
result of ``scored`` is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from . import _base, _text

TRAIN_ROWS = 12_000
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 16
STATS = 17
#: Numeric columns used as metadata where the table has them. Labels, lang, source and doc_id are never inputs.
META = ("n_chars",)
BINS = 12
FACTORS = 8
BATCH = 64
#: Steps of training, in at least and at most so many passes over the rows.
STEPS = 1000
PASSES = (4, 100)
FOLDS = 3
LIMIT = 0.3

_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]] = 1
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".,;:!?"]] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:] = 1
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _LETTER])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(texts: pa.Array, meta: tuple[pa.Array, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (row begins, feature indices, values); ``meta``: one numeric array for each of ``META``, or none."""
    raw, offsets = _text.buffer_of(texts)
    docs = len(offsets) - 1
    start, end, _, at = _text.words(raw, offsets)
    _, _, hashes, _ = _text.words(_FOLD[raw], offsets)
    n_words = np.diff(at)
    owner = np.repeat(np.arange(docs), n_words)
    key, doc, count = _text.counted(hashes & np.uint64(BUCKETS - 1), owner)

    size = np.diff(offsets)
    sums = [np.diff(np.concatenate([[0], np.cumsum(c[raw])])[offsets]) for c in _CLASSES]
    lines = np.diff(np.concatenate([[0], np.cumsum(raw == 10)])[offsets]) + (size > 0)
    distinct = np.bincount(doc, minlength=docs)
    width = end - start
    long_words = np.bincount(owner, width > 14, docs)
    bare = np.zeros(0, bool) if not len(start) else (_LETTER[raw[start]] + _DIGIT[raw[start]] == 0) & (width <= 3)
    bare_words = np.bincount(owner, bare, docs)
    joint = np.zeros(0, bool) if not len(start) else _SYMBOL[raw[end - 1]] == 1
    joint_words = np.bincount(owner, joint, docs)
    width_sum = np.bincount(owner, width, docs)
    shouted = np.zeros(0, bool) if not len(start) else (_UPPER[raw[start]] == 1) & (_UPPER[raw[np.minimum(start + 1, end - 1)]] == 1) & (width > 1)
    shouted_words = np.bincount(owner, shouted, docs)
    shingle, sdoc = _text.shingles(hashes, at, 8)
    _, udoc, _ = _text.counted(shingle, sdoc)
    windows, unique = np.bincount(sdoc, minlength=docs), np.bincount(udoc, minlength=docs)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again_words = np.bincount(owner, again, docs)
    b, w = np.maximum(size, 1), np.maximum(n_words, 1)
    ratios = np.stack(
        [
            np.log2(1 + size) / 20, np.log2(1 + n_words) / 17, sums[0] / b * 2, sums[1] / b * 4, sums[2] / b * 4, sums[3] / b * 5, sums[4] / b,
            distinct / w, width_sum / w / 16, long_words / w * 4, bare_words / w * 2, joint_words / w, np.log2(1 + lines) / 10, shouted_words / w,
            1 - unique / np.maximum(windows, 1), n_words / np.maximum(lines, 1) / 200, again_words / w,
        ],
        1,
    )
    slot = np.minimum((np.clip(ratios, 0, 1) * BINS).astype(np.int64), BINS - 1)
    fields = STATS + len(META)
    stat = np.empty((docs, fields), np.int64)
    stat[:, :STATS] = BUCKETS + np.arange(STATS) * BINS + slot
    for j in range(len(META)):
        known = np.asarray(pc.fill_null(meta[j].cast(pa.float64()), np.nan)) if meta else np.full(docs, np.nan)
        with np.errstate(invalid="ignore"):
            bin_ = np.minimum(np.log2(1 + np.maximum(np.nan_to_num(known, posinf=0, neginf=0), 0)) / 20 * BINS, BINS - 1).astype(np.int64)
        stat[:, STATS + j] = BUCKETS + STATS * BINS + j * (BINS + 1) + np.where(np.isfinite(known), bin_, BINS)

    value = np.log1p(count.astype(np.float64))
    norm = np.sqrt(np.maximum(np.bincount(doc, value**2, docs), 1e-12))
    value = value / norm[doc]
    rows = np.concatenate([doc, np.repeat(np.arange(docs), fields)])
    cols = np.concatenate([key.astype(np.int64), stat.ravel()])
    vals = np.concatenate([value, np.full(docs * fields, 1 / np.sqrt(fields))])
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(docs + 1)), cols[order].astype(np.int32), vals[order].astype(np.float32)


def raw_scores(model: dict, begin: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """w0 + linear + pairwise part, by the sum-of-squares identity."""
    first = begin[:-1]
    total = lambda x: np.add.reduceat(x, first, 0)  # noqa: E731  every row has statistics, so none is empty
    v = model["v"][cols] * vals[:, None]
    return model["w0"] + total(model["w"][cols] * vals) + 0.5 * (total(v) ** 2 - total(v * v)).sum(1)


def _rows(begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen rows begin, and the places of their entries."""
    n = begin[rows + 1] - begin[rows]
    at = np.cumsum(n) - n
    return np.append(at, n.sum()), np.repeat(begin[rows] - at, n) + np.arange(int(n.sum()))


def fit(begin: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adagrad over mini-batches of rows."""
    rng = np.random.RandomState(seed)
    size, docs = BUCKETS + STATS * BINS + len(META) * (BINS + 1), len(y)
    model = {"w0": 0.0, "w": np.zeros(size, np.float32), "v": rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), "a": 1.0, "b": 0.0}
    if not docs or y.min() == y.max():
        share = (y.sum() + 1) / (docs + 2)
        return model | {"w0": float(np.log(share / (1 - share))), "v": np.zeros((size, FACTORS), np.float32)}
    model["w0"] = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(int(np.clip(np.ceil(steps * BATCH / docs), *PASSES))):
        order = rng.permutation(docs)
        for k in range(0, docs, BATCH):
            rows = np.sort(order[k : k + BATCH])
            at, pick = _rows(begin, rows)
            owner, first = np.repeat(np.arange(len(rows)), np.diff(at)), at[:-1]
            c, x = cols[pick], vals[pick]
            vx = model["v"][c] * x[:, None]
            s = np.add.reduceat(vx, first, 0)
            z = model["w0"] + np.add.reduceat(model["w"][c] * x, first) + 0.5 * (s**2 - np.add.reduceat(vx * vx, first, 0)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            gx = g[owner] * x
            uniq, inv = np.unique(c, return_inverse=True)
            dw = np.bincount(inv, gx, len(uniq)) + decay * model["w"][uniq]
            dv_rows = gx[:, None] * (s[owner] - vx)
            dv = np.stack([np.bincount(inv, dv_rows[:, f], len(uniq)) for f in range(FACTORS)], 1) + decay * model["v"][uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            model["w"][uniq] -= (rate * dw / np.sqrt(gw[uniq])).astype(np.float32)
            model["v"][uniq] -= (rate * 0.5 * dv / np.sqrt(gv[uniq])).astype(np.float32)
            d0 = float(g.sum())
            g0 += d0**2
            model["w0"] -= rate * d0 / g0**0.5
    return model


def calibrated(begin: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray) -> dict:
    """The model of all rows, with the map from raw score to probability of scores that other folds' models gave."""
    model = fit(begin, cols, vals, y)
    fold = np.random.RandomState(13).permutation(len(y)) % FOLDS
    z = np.zeros(len(y))
    for k in range(FOLDS):
        train, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(train) or not len(out) or y[train].min() == y[train].max():
            return model
        at, pick = _rows(begin, train)
        other = fit(at, cols[pick], vals[pick], y[train])
        at, pick = _rows(begin, out)
        z[out] = raw_scores(other, at, cols[pick], vals[pick])
    a, b = platt(z, y)
    return model | {"a": a, "b": b}


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic map of z to y, by Newton's method on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    t = y * (up + 1) / (up + 2) + (1 - y) / (down + 2)
    middle, spread = z.mean(), max(z.std(), 1e-9)
    x = np.stack([(z - middle) / spread, np.ones(len(z))], 1)
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - t @ (x @ w))
    w = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    a = max(float(w[0] / spread), 0.0)
    return a, float(w[1] - a * middle)


def probability(model: dict, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["a"] * z + model["b"], -30, 30)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _meta(docs: DataFrame) -> list[Column]:
    """The metadata columns as doubles, null where the table has none or no number."""
    number = {f.name: isinstance(f.dataType, NumericType) for f in docs.schema.fields}
    return [(F.col(c) if number.get(c) else F.lit(None)).cast("double") for c in META]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> dict:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = _base.labelled_texts(docs, chosen, bound, most, {"_meta": F.array(*_meta(docs))})

    def run(batches):
        for batch in batches:
            for part in _base.slices(batch, "_text"):
                begin, cols, vals = features(part.column(2), _columns(part.column(4)))
                cut = lambda x: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), cut(cols), cut(vals)], names=["id", "m", "y", "c", "x"])

    got = texts.select("_id", "_m", "_text", "_y", "_meta").mapInArrow(run, "id long, m string, y double, c array<int>, x array<float>").toArrow()
    got = got.sort_by([("id", "ascending"), ("m", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0))
    lists = pa.concat_arrays(got["c"].chunks)
    begin = np.asarray(lists.offsets, np.int64)
    return calibrated(begin - begin[0], np.asarray(lists.flatten()), np.asarray(pa.concat_arrays(got["x"].chunks).flatten()), np.asarray(got["y"]))


def _columns(lists: pa.Array) -> tuple[pa.Array, ...]:
    """An array column of len(META) numbers a row, as so many arrays."""
    flat = lists.flatten()
    return tuple(flat.take(pa.array(np.arange(j, len(flat), len(META)))) for j in range(len(META)))


def scored(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "_score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner, at = _base.plain(docs)
    names, place = inner.columns, docs.columns.index(text_col)
    fed = docs.select("*", F.array(*_meta(docs))).toDF(*names, "_meta")

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in _base.slices(batch, names[place]):
                p = probability(m, raw_scores(m, *features(part.column(place), _columns(part.column(len(names))))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p.astype(np.float64))], names=[*names, out_col])

    out = fed.mapInArrow(run, inner.schema.add(out_col, "double"))
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns if c != out_col], out_col)


def op1_factorisation_machine_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text", *META)
    model = train(docs, _base.read(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    out = scored(docs, model)
    return out.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= LIMIT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model accepts, in the columns of ``docs``; the model learns from the whole corpus' labels."""
    model = train(docs, _base.read(spark, sf_dir, "labels"))
    inner, at = _base.plain(docs)
    kept = scored(inner.withColumnsRenamed({at[c]: c for c in ("text", *META) if c in at}), model).filter(F.col("_score") >= LIMIT)
    return kept.drop("_score").toDF(*docs.columns)


QUERIES = {"op1_factorisation_machine_quality": op1_factorisation_machine_quality}
ORACLES: dict[str, str] = {}
