"""Mixing sources to target weights by soft membership (operator 6), DataFrame expressions only.

A multinomial logistic model learned from the labelled table gives each document a posterior over domains (``low``
quality, ``clean``, ``toxic``). Nonnegative document rates r are then fitted so that the expected domain totals
s_k = sum_d r_d n_d p_dk meet the targets T_k: projected gradient on the whitened least squares
|| M^(1/2) (s - T) ||^2, from r = 1, each step r <- max(0, r - p_d . M (s - T)) with M = (sum n_d p_d p_d^T)^-1 over the
documents whose rate is not 0. The whitening makes 1 the right step length where the targets can be met. Where a domain
has next to no mass they cannot, and such steps may run away (a hundred times the tokens and more). So if ``PLAIN`` of
them, or all, have led further from the targets than r = 1 is, the fit starts again with damped steps, of which only
those count that lower the miss, the norm of (s_k - T_k) / T_k over k. No total then exceeds its target by more than the
start misses, and rates have no cap. A document's rate is a function of its posterior and of the steps so far, so no
per-document state is kept: each iteration is one aggregate over the narrow posterior table, and the driver holds K
sums and a K x K matrix.

A rate becomes its whole part plus one more copy where u, a hash of doc_id and text, reaches 1 - fraction - shift. The
shift of each domain (that of the largest posterior) brings the copies' totals near the targets, so that few long
documents do not carry them off: one aggregate sums what the documents add by the bin of the shift from which they do,
and the shifts are then chosen domain by domain. ``mixed_report`` returns targets, expected and realised totals; a miss
of the expected ones is logged.

Training reads at most ``TRAIN_ROWS`` labelled ids and texts and ``TRAIN_BYTES`` of text (documented bounds, smallest
hashes, each distinct text of an id once); posteriors, totals and rates cover all documents. The weights are
fixed-point numbers and enter the plan as one array literal per domain, exactly.

Defined results: null and empty texts have no tokens and the posterior of an empty text; very long texts are read whole;
labels with a null are ignored; with no labels every document is half ``clean``; a target that cannot be met (little or
no mass in a domain) leaves what the fit above could not lower; equal posteriors get equal rates; an empty table gives
an empty result. Repeated rows are documents each, with as many copies each. Extra columns pass through whatever their
names, but where one is named like a result of ``mixed``, the result stands.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base
from .line_rules import let

DOMAINS = ("low", "clean", "toxic")
#: Wanted share of tokens per domain; the total is such that the clean share equals what there is.
SHARES = {"low": 0.02, "clean": 0.97, "toxic": 0.01}
TRAIN_ROWS = 12_000
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 16
#: Weights are multiples of 1 / FIXED, so that the plan holds them exactly, as whole numbers.
FIXED = 1024
#: Summed word weights are divided by this power of the number of distinct words.
DAMP = 0.25
ROUNDS = 40
#: Undamped steps after which a fit that has run away starts again with damped ones.
PLAIN = 12
#: Least damping, and that at which no step lowers the miss any more, as shares of the Gram matrix' trace at the start.
DAMPING = (1e-6, 1e3)
#: A damped step that lowers the miss by a smaller part than this is the last.
STILL = 1e-3
#: Copies of a document that are listed at once.
RUN = 1024
TOLERANCE = 1e-5
#: Rates this close to a whole number count as it.
SNAP = 1e-3
#: Part of the largest target by which the expected totals may miss theirs unlogged.
CLOSE = 2e-3
#: Bins of the shifts from -1 to 1, and what a shift costs against squared relative misses.
BINS = 4096
STIFF = 1e-4
RESULTS = ("_n", "_u", *(f"_p{k}" for k in range(len(DOMAINS))), "_rate", "_copies")
_log = logging.getLogger(__name__)


def tokens_of(text: Column) -> Column:
    """Lower-case words between blanks and marks of punctuation."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: w != "")


def buckets_of(words: Column, text: Column) -> Column:
    """Distinct buckets of a text: its words, and in tenths per word its signs, runs of capitals and distinct words."""
    text = F.coalesce(text, F.lit(""))

    def tenths(mark: str, n: Column, of: Column) -> Column:
        share = F.least(F.coalesce(F.floor(F.try_divide(10 * n, of)), F.lit(0)), F.lit(20))
        return F.concat(F.lit(mark), share.cast("string"))

    def of(d: Column) -> Column:
        n = F.size(words)
        marks = [tenths("#s", F.regexp_count(text, F.lit(r"[#*$%&|<>!]")), n), tenths("#c", F.regexp_count(text, F.lit(r"\p{Lu}\p{Lu}+")), n), tenths("#d", F.size(d), n)]
        return F.transform(F.concat(d, F.array(*marks)), lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))

    return F.array_distinct(let(F.array_distinct(words), of))


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> dict:
    """A multinomial logistic model of the domains over buckets, fitted on the bounded sample."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 0).otherwise(1)
    rows = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max(domain).alias("_k")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    seen = _base.labelled_texts(docs, rows, bound, TRAIN_BYTES)
    # copies count once, lest a document repeated a hundred times decide what marks its domain
    seen = seen.groupBy("_m").agg(F.max("_k").alias("_k"), F.min("_text").alias("_text"))
    rows = seen.select("_m", "_k", F.concat_ws(",", buckets_of(tokens_of(F.col("_text")), F.col("_text"))).alias("_b")).orderBy("_m")
    cols, kinds = [np.zeros(0, np.int32)], []
    for r in rows.toLocalIterator():
        cols.append(np.fromstring(r["_b"], np.int32, sep=","))
        kinds.append(r["_k"])
    begin = np.cumsum([len(c) for c in cols])
    return fit_softmax(begin, np.concatenate(cols), np.array(kinds, np.int64))


def raw_logits(w: np.ndarray, bias: np.ndarray, begin: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bias plus the summed weights of a document's buckets over the fourth root of their number."""
    n = np.diff(begin)
    return np.add.reduceat(w[cols], begin[:-1], 0) / (n**DAMP)[:, None] + bias


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _rows(begin: np.ndarray, cols: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(begin)[rows]
    at = np.cumsum(n) - n
    return np.append(at, n.sum()), cols[np.repeat(begin[rows] - at, n) + np.arange(int(n.sum()))]


def fit_softmax(begin: np.ndarray, cols: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> dict:
    """Multinomial logistic regression by mini-batch Adagrad; a fifth of the rows is kept out to choose the temperature
    that makes its probabilities honest. Every document has buckets (its shape), so no row is empty."""
    k, rng = len(DOMAINS), np.random.RandomState(seed)
    w, g2, bias, gb = np.zeros((BUCKETS, k)), np.full((BUCKETS, k), 1e-3), np.zeros(k), np.full(k, 1e-3)
    if not len(y):
        return {"w": w, "b": np.array([-np.log(2) if i != 1 else 0.0 for i in range(k)]), "t": 1.0}
    shuffled = rng.permutation(len(y))
    train, out = shuffled[len(y) // 5 :], shuffled[: len(y) // 5]
    for _ in range(epochs):
        order = rng.permutation(train)
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            at, c = _rows(begin, cols, rows)
            p = _probabilities(raw_logits(w, bias, at, c))
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            n = np.diff(at)
            own = np.repeat(np.arange(len(rows)), n)
            u, inv = np.unique(c, return_inverse=True)
            g = np.stack([np.bincount(inv, (p[:, j] / n**DAMP)[own], len(u)) for j in range(k)], 1) + decay * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            gb += p.sum(0) ** 2
            bias -= rate * p.sum(0) / np.sqrt(gb)
    best, w = 1.0, np.round(w * FIXED) / FIXED
    if len(out):
        z = raw_logits(w, bias, *_rows(begin, cols, out))
        loss = lambda t: -np.log(np.maximum(_probabilities(t * z)[np.arange(len(out)), y[out]], 1e-12)).mean()
        best = min((1.0, 1.5, 2.0, 3.0, 4.0), key=loss)
    return {"w": w, "b": bias, "t": best}


def memberships(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs``, whose own columns must not begin like a result, with _n (words) and _p0.. (posteriors)."""
    base = 1  # log odds against the clean domain

    def table(x: np.ndarray) -> Column:
        return F.split(F.lit(",".join(map(str, np.round(x * FIXED).astype(int).tolist()))), ",").cast("array<int>")

    def log_odds(k: int) -> Column:
        weight, shift = table(model["w"][:, k] - model["w"][:, base]), float(model["t"] * (model["b"][k] - model["b"][base]))
        total = F.aggregate("_b", F.lit(0), lambda a, b: a + F.get(weight, b))
        return total * F.lit(float(model["t"] / FIXED)) / F.pow(F.size("_b").cast("double"), F.lit(DAMP)) + shift

    logit = {}
    for k in range(len(DOMAINS)):
        if k != base:
            logit[k] = log_odds(k)
    out = docs.withColumn("_w", tokens_of(F.col(text)))
    out = out.withColumns({"_n": F.size("_w").cast("double"), "_b": buckets_of(F.col("_w"), F.col(text))}).drop("_w")
    # exp(min(x, 500)) keeps the sum finite; a posterior below 1e-217 is 0 in effect
    out = out.withColumns({f"_e{k}": F.exp(F.least(c, F.lit(500.0))) for k, c in logit.items()} | {f"_e{base}": F.lit(1.0)})
    total = sum((F.col(f"_e{k}") for k in range(len(DOMAINS))), F.lit(0.0))
    out = out.withColumns({f"_p{k}": F.col(f"_e{k}") / total for k in range(len(DOMAINS))})
    return out.drop("_b", *[f"_e{k}" for k in range(len(DOMAINS))])


def rate_of(steps: list[np.ndarray]) -> Column:
    """A document's rate after these steps, from its posteriors. The steps are one array literal, so that neither the
    plan nor the generated code grows or changes with them."""
    if not steps:
        return F.lit(1.0)
    found = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])

    def after(rate: Column, step: Column) -> Column:
        dot = sum((p * F.get(step, F.lit(k)) for k, p in enumerate(_posteriors())), F.lit(0.0))
        return F.greatest(F.lit(0.0), rate - dot)

    return F.aggregate(found, F.lit(1.0), after)


def _posteriors() -> list[Column]:
    return [F.col(f"_p{k}") for k in range(len(DOMAINS))]


def fit(members: DataFrame, targets: np.ndarray | None = None, shares: dict | None = None, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps of projected gradient over the posterior table, the targets, and the expected totals after the steps."""
    k = range(len(DOMAINS))
    p, n = _posteriors(), F.col("_n")

    def measured(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Expected domain totals, and the Gram matrix of the documents that still have a rate."""
        rated, rate = members.select("_n", *p, rate.alias("_r")), F.col("_r")
        live = F.when(rate > 0, n).otherwise(0.0)
        row = rated.agg(*[F.sum(rate * n * p[i]) for i in k], *[F.sum(live * p[i] * p[j]) for i in k for j in k]).first()
        x = np.array([float(v or 0) for v in row])
        return x[: len(DOMAINS)], x[len(DOMAINS) :].reshape(len(DOMAINS), -1)

    first = measured(F.lit(1.0))
    if targets is None:
        share = np.array([(shares or SHARES)[d] for d in DOMAINS])
        targets = share / share[1] * first[0][1]
    steps, total = descend(first, lambda found: measured(rate_of(found)), targets, rounds)
    return steps, targets, total


def descend(first: tuple[np.ndarray, np.ndarray], measure, targets: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps towards the targets and the totals after them. ``measure`` gives the totals and the Gram matrix after some
    steps, ``first`` is its result for none."""
    most = max(targets.max(), 1e-12)
    scale = np.maximum(targets, CLOSE * most)

    def met(total: np.ndarray) -> bool:
        return np.abs(total - targets).max() <= TOLERANCE * most

    def miss(total: np.ndarray) -> float:
        return float(np.linalg.norm((total - targets) / scale))

    steps: list[np.ndarray] = []
    total, gram = first
    for i in range(rounds):
        if met(total) or i == PLAIN and miss(total) > miss(first[0]):
            break
        steps.append(np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (total - targets))
        total, gram = measure(steps)
    if met(total) or miss(total) <= miss(first[0]):
        return steps, total
    (total, gram), steps = first, []
    square = np.outer(scale, scale)
    unit = np.trace(gram / square) * np.eye(len(targets))
    damping, failed = DAMPING[0], False
    for _ in range(rounds):
        if met(total) or damping > DAMPING[1]:
            break
        step = np.linalg.solve(gram / square + damping * unit, (total - targets) / scale) / scale
        after = measure([*steps, step])
        if miss(after[0]) < miss(total):
            last = miss(after[0]) > (1 - STILL) * miss(total)
            steps, (total, gram) = [*steps, step], after
            if last:
                break
            # damping that was just found needed is kept for one more step
            damping, failed = damping if failed else max(damping / 10, DAMPING[0]), False
        else:
            damping, failed = damping * 10, True
    return steps, total


def copies_of(rate: Column, shift: Column) -> Column:
    """Whole copies of a rate: one more than its whole part where the document's hash reaches what its fraction and the shift leave."""
    whole = F.floor(rate)
    return (whole + F.when((rate > whole) & (F.col("_u") + shift >= 1 - (rate - whole)), 1).otherwise(0)).cast("int")


def _domain() -> Column:
    """Number of the largest posterior, the first of equal ones."""
    p = F.array(*_posteriors())
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def _shift(shifts: np.ndarray) -> Column:
    return F.get(F.array(*[F.lit(float(x)) for x in shifts]), _domain())


def rounded(members: DataFrame, rate: Column, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shift of each domain that brings the copies' totals nearest to the targets, and those totals."""
    k, n = len(DOMAINS), F.col("_n")
    rated = members.select("_n", "_u", *_posteriors(), rate.alias("_r"), _domain().alias("_k"))
    whole = F.floor("_r")
    # a document adds a copy from the shift 1 - fraction - u on; whole rates never do
    at = F.when(F.col("_r") > whole, F.ceil((2 - (F.col("_r") - whole) - F.col("_u")) * (BINS / 2))).cast("int")
    sums = [F.sum(whole * n * p).alias(f"w{i}") for i, p in enumerate(_posteriors())] + [F.sum(n * p).alias(f"t{i}") for i, p in enumerate(_posteriors())]
    base, adds = np.zeros(k), np.zeros((k, BINS + 2, k))
    for r in rated.groupBy("_k", at.alias("_b")).agg(*sums).collect():
        base += [r[f"w{i}"] or 0 for i in range(k)]
        if r["_b"] is not None:
            adds[r["_k"], min(r["_b"], BINS + 1)] += [r[f"t{i}"] or 0 for i in range(k)]
    total = adds.cumsum(1)[:, : BINS + 1]  # by domain and shift
    shift = np.linspace(-1, 1, BINS + 1)
    scale, best = np.maximum(targets, 1e-12), np.full(k, BINS // 2)
    for _ in range(20):
        old = best.copy()
        for j in range(k):
            rest = base + sum(total[i, best[i]] for i in range(k) if i != j)
            miss = (((rest + total[j] - targets) / scale) ** 2).sum(1) + STIFF * shift**2
            best[j] = int(miss.argmin())
        if (old == best).all():
            break
    return shift[best], base + sum(total[i, best[i]] for i in range(k))


def _mixed(inner: DataFrame, model: dict, doc_id: str, text: str, keep: list[str], targets: np.ndarray | None, shares: dict | None) -> tuple[DataFrame, dict]:
    """The ``keep`` columns of ``inner`` with ``RESULTS``, and the report."""
    members = memberships(inner, model, text).withColumn("_u", F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    members = _base.materialize(members.select(*keep, "_n", "_u", *_posteriors()), "members")
    steps, targets, expected = fit(members, targets, shares)
    if np.abs(expected - targets).max() > CLOSE * max(targets.max(), 1e-12):
        _log.warning("targets %s not met: expected totals are %s after %d steps", targets.round(), expected.round(), len(steps))
    members, raw = members.withColumn("_raw", rate_of(steps)), F.col("_raw")
    rate = F.when(F.abs(raw - F.round(raw)) <= SNAP, F.round(raw)).otherwise(raw)
    shifts, realised = rounded(members, rate, targets)
    out = members.withColumn("_rate", rate).withColumn("_copies", copies_of(F.col("_rate"), _shift(shifts)))
    return out.select(*keep, *RESULTS), {"targets": targets, "expected": expected, "realised": realised, "shifts": shifts}


def mixed_report(docs: DataFrame, model: dict, narrow: tuple[str, ...] | None = None, targets: np.ndarray | None = None, shares: dict | None = None) -> tuple[DataFrame, dict]:
    """``docs`` (or its ``narrow`` columns) with words, posteriors, rate and copies; and targets, expected and realised totals by domain."""
    inner, at = _base.plain(docs)
    keep = [c for c in narrow or docs.columns if c not in RESULTS]
    out, report = _mixed(inner, model, at["doc_id"], at["text"], [at[c] for c in keep], targets, shares)
    return out.withColumnsRenamed({at[c]: c for c in keep}), report


def mixed(docs: DataFrame, model: dict, narrow: tuple[str, ...] | None = None, targets: np.ndarray | None = None, shares: dict | None = None) -> DataFrame:
    return mixed_report(docs, model, narrow, targets, shares)[0]


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = mixed(docs, learn(docs, _base.read(spark, sf_dir, "labels")), ("doc_id",))
    return out.select("doc_id", F.col("_n").cast("long").alias("tokens"), *[F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, in the columns of ``docs``."""
    model = learn(_base.read(spark, sf_dir, "documents"), _base.read(spark, sf_dir, "labels"))
    inner, at = _base.plain(docs)
    out, _ = _mixed(inner, model, at["doc_id"], at["text"], inner.columns, None, None)
    # in runs, so that no list grows with a document's copies
    out = out.filter("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / RUN).cast("int"))))
    out = out.withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(RUN), F.col("_copies") - RUN * F.col("_i")))))
    return out.select(*inner.columns).toDF(*docs.columns)


QUERIES = {"op6_soft_membership_mixing": op6_soft_membership_mixing}
ORACLES: dict[str, str] = {}
