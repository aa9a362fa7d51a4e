"""Quality rules by cross-document line frequency (operator 4), DataFrame expressions only.

Lines of each document are normalised (lower case, runs of blanks to one space, trimmed) and hashed. Per host
(``source``), a line counts once for each distinct document that holds it; documents are told apart by the md5 of their
whole text, so that copies of one document count once, here and in the host's number of documents. A line is over the
limits if more than ``MIN_DOCS`` distinct documents hold it, and more than a tenth of the host's (``MAX_SHARE``) or,
where that is less, ``ROOT`` times the square root of their number: what a large host repeats thousands of times is
boilerplate long before it stands in a tenth of its pages. Lines under ``LINE_WORDS`` words are only judged by the
share. Lines over the limits are removed; a document that has lost lines and keeps under ``MIN_WORDS`` words, as the
base rule asks, or under ``min_share`` of its words is depleted. Base rules reject very short and self-repeating documents.

Three scans and one small shuffle: (host, line, digest) rows are made distinct before counting, so a hot host or line
is summed map-side. The lines over the limits are gathered per host in short hashed lists, so that a look-up does not
grow with their number; that table is broadcast only if it is counted to be small and joined by shuffle otherwise.

Defined results: a null text has no words (base_failed); a null source is a host of its own; repeated rows, ties and
null doc_ids are judged row by row; very long texts are judged whole, and two windows are equal if their 64-bit hashes
are; an empty table gives an empty result. Extra columns pass through ``judged`` and ``stage`` whatever their names,
but where a column of the input is named like a result of ``judged``, the result stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

#: A line is removed if over this many distinct documents of its host hold it ...
MIN_DOCS = 20
#: ... and over this share of the host's distinct documents, or over ROOT times the root of their number, if that is less.
MAX_SHARE = 0.10
ROOT = 2.0
#: Shorter lines are judged by the share alone.
LINE_WORDS = 5
#: A document is depleted if lines were removed and fewer words are left than MIN_WORDS, or a smaller share of its words than this.
MIN_SHARE = 0.30
#: Base rules.
MIN_WORDS = 20
REPEAT_PERCENT = 30
SPAN = 8
#: Hashes in one list of a host's lines, about.
LIST = 16
RESULTS = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_left_words", "_clean_text", "_kept")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeat_words(words: Column, span: int = SPAN) -> Column:
    """Words inside windows of ``span`` words that occur twice or more in the list.

    Windows are hashed; a list whose window hashes are all distinct ends there. Otherwise equal windows are found by
    sorting pairs of 64-bit hash and position. For up to a million words only those pairs are sorted that have a
    neighbour when the upper 43 bits and the position are sorted as one long, as all equal windows have.
    """

    def covered(pos: Column) -> Column:
        # positions in order: each covers up to the next one, the last its whole span
        gaps = F.transform(pos, lambda p, i: F.when(i == F.size(pos) - 1, F.lit(span)).otherwise(F.least(F.lit(span), F.get(pos, i + 1) - p)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twins(s: Column, key) -> Column:
        same = lambda a, b: F.coalesce(key(a) == key(b), F.lit(False))
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    def counted(pairs: Column) -> Column:
        places = lambda s: F.sort_array(F.transform(twins(s, lambda x: x["h"]), lambda x: x["i"]))
        return let(F.sort_array(pairs), lambda s: let(places(s), covered))

    def sorted_pairs(w: Column) -> Column:
        low, high = F.lit((1 << 21) - 1).cast("long"), F.lit(-(1 << 21)).cast("long")
        pair = lambda i: F.struct(F.get(w, i).alias("h"), i.alias("i"))
        packed = F.sort_array(F.transform(w, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        near = let(packed, lambda s: F.transform(twins(s, lambda x: F.shiftright(x, 21)), lambda x: pair(x.bitwiseAND(low).cast("int"))))
        return F.when(F.size(w) < (1 << 20), counted(near)).otherwise(counted(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))

    def of_hashes(h: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(span)])
        return let(
            F.transform(F.sequence(F.lit(0), F.size(h) - span), window),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(sorted_pairs(w)),
        )

    return F.when(F.size(words) <= span, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def line_hashes(text: Column) -> Column:
    """Key of each \\n-split normalised line: md5 after l (long) or s (under LINE_WORDS words); empty for those without a word."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " ")

    def key(line: Column) -> Column:
        size = F.when(F.size(F.split(line, " ", LINE_WORDS)) == LINE_WORDS, F.lit("l")).otherwise(F.lit("s"))
        return F.when(line == "", F.lit("")).otherwise(F.concat(size, F.md5(line)))

    return F.transform(F.split(squeezed, "\n"), lambda s: key(F.trim(s)))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, root: float = ROOT) -> DataFrame:
    """(_host, _line): keys of the lines over the limits. ``docs`` has text and source."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_digest")
    sizes = docs.select(F.col("source").alias("_host"), digest).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    rows = docs.select(F.col("source").alias("_host"), digest, F.explode(F.array_distinct(F.filter(line_hashes(F.col("text")), lambda x: x != ""))).alias("_line"))
    counts = rows.distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_docs)
    joined = counts.join(sizes.withColumnRenamed("_host", "_h2"), F.col("_host").eqNullSafe(F.col("_h2")))
    share = max_share * F.col("_docs")
    limit = F.when(F.col("_line").startswith("l"), F.least(share, root * F.sqrt("_docs"))).otherwise(share)
    return joined.filter(F.col("_n") > limit).select("_host", "_line")


def line_lists(lines: DataFrame) -> DataFrame:
    """(_host, _lists): a host's lines in about one list for ``LIST`` of them; a line is in list hash modulo their number."""
    sized = lines.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_k")).withColumnRenamed("_host", "_h2")
    placed = lines.join(sized, F.col("_host").eqNullSafe(F.col("_h2"))).select("_host", _list_of(F.col("_line"), F.col("_k")).alias("_b"), "_line")
    empty = sized.select(F.col("_h2").alias("_host"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_b"), F.lit(None).cast("string").alias("_line"))
    lists = placed.unionByName(empty).groupBy("_host", "_b").agg(F.collect_list("_line").alias("_l"))
    return lists.groupBy("_host").agg(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_l"))), lambda x: x["_l"]).alias("_lists"))


def _list_of(line: Column, lists: Column) -> Column:
    return F.pmod(F.xxhash64(line), lists).cast("int")


def _judged(docs: DataFrame, text_col: str, host_col: str, min_docs: int, max_share: float, min_share: float) -> DataFrame:
    """``docs``, whose own columns must not be named like a result, with ``RESULTS``."""
    lines = frequent_lines(docs.select(F.col(text_col).alias("text"), F.col(host_col).alias("source")), min_docs, max_share)
    frequent = _base.materialize(line_lists(_base.materialize(lines, "lines")), "lists")
    size = F.aggregate("_lists", F.lit(64).cast("long"), lambda a, x: a + 24 + 49 * F.size(x))
    small = _base.broadcast_if_small(frequent.withColumnRenamed("_host", "_h2"), size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("_words", words_of(F.col(text_col)))
    base = base.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "_n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_n_dup_lines": let(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
            "_n_repeat_words": repeat_words(F.col("_words")),
        }
    ).drop("_words")
    base = base.withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > REPEAT_PERCENT * F.col("_n_words")))
    base = base.join(small, F.col(host_col).eqNullSafe(F.col("_h2")), "left").drop("_h2")
    held = lambda h: F.array_contains(F.get("_lists", _list_of(h, F.size("_lists"))), h)
    keep = F.filter(F.arrays_zip(F.split(text, "\n").alias("s"), line_hashes(F.col(text_col)).alias("h")), lambda x: ~held(x["h"]))
    kept_text = F.array_join(F.transform(keep, lambda x: x["s"]), "\n")
    out = base.withColumn("_clean_text", F.when(F.col("_lists").isNull(), F.col(text_col)).otherwise(kept_text)).drop("_lists")
    changed = F.col("_clean_text").isNotNull() & (F.col("_clean_text") != F.col(text_col))
    out = out.withColumn("_left_words", F.when(changed, F.size(words_of(F.col("_clean_text"))).cast("long")).otherwise(F.col("_n_words")))
    depleted = (F.col("_left_words") < F.col("_n_words")) & ((F.col("_left_words") < MIN_WORDS) | (F.col("_left_words") < min_share * F.col("_n_words")))
    return out.withColumn("_kept", ~F.col("_base_failed") & ~depleted)


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` (text, source and any others) with ``RESULTS``: the base figures, the words left, the text without its
    frequent lines, and the verdict."""
    inner, at = _base.plain(docs)
    out = _judged(inner, at["text"], at["source"], min_docs, max_share, min_share)
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def op4_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_words")
    return judged(docs).select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents without their over-frequent lines, in the columns of ``docs``."""
    inner, at = _base.plain(docs)
    out = _judged(inner, at["text"], at["source"], MIN_DOCS, MAX_SHARE, MIN_SHARE).filter("_kept")
    cols = {c: F.col(n) for c, n in at.items()} | {"text": F.col("_clean_text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.char_length("_clean_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in cols.items()])


SQL = r"""
with w as (
  select doc_id, source, coalesce(text, '') as text, row_number() over () as rid,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
g as (
  select rid, unnest(list_transform(range(1, len(ws) - 6), lambda i: {'i': i, 's': array_to_string(ws[i:i+7], ' ')})) as p
  from w where len(ws) > 8),
g2 as (select rid, p.i as i, count(*) over (partition by rid, p.s) as c from g),
g3 as (select rid, i, lead(i) over (partition by rid order by i) as nx from g2 where c > 1),
rep as (select rid, sum(least(8, coalesce(nx - i, 8))) as n from g3 group by rid),
l as (
  select rid, source, line, regexp_matches(line, '[^\x20\x09-\x0D]') as solid,
         md5(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'))) as h,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n
  from (select rid, source, unnest(string_split(text, chr(10))) as line from w)),
dup as (select rid, count(*) - count(distinct line) as n from l where solid group by rid),
c as (
  select source, h, max(words) as words, count(distinct md5(text)) as n
  from (select l.source, l.h, l.n as words, w.text from l join w using (rid) where l.solid) group by source, h),
hosts as (select source, count(distinct md5(text)) as docs from w group by source),
f as (
  select c.source, c.h from c join hosts on c.source is not distinct from hosts.source
  where c.n > 20 and c.n > case when c.words >= 5 then least(0.10 * hosts.docs, 2 * sqrt(hosts.docs)) else 0.10 * hosts.docs end),
removed as (
  select l.rid, sum(l.n) as n from l join f on l.h = f.h and l.source is not distinct from f.source
  where l.solid group by l.rid),
b as (
  select w.doc_id, len(w.ws)::bigint as n_words, length(array_to_string(w.ws, ''))::bigint as word_chars,
         (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
         (len(w.ws) - coalesce(removed.n, 0))::bigint as left_words
  from w left join dup using (rid) left join rep using (rid) left join removed using (rid)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (left_words < n_words and (left_words < 20 or left_words < 0.30 * n_words)) as kept,
       left_words
from j
"""

QUERIES = {"op4_line_frequency_rules": op4_line_frequency_rules}
ORACLES = {"op4_line_frequency_rules": SQL}
