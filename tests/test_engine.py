"""Operators of the linkage engine on small frames, and every registered query against DuckDB."""

import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import derive, features, normalize, similarity
from weftline.operators import blocking, channels, evaluate, gates, resolve, sampling, sets, tfidf
from weftline.sources import sinks, tables

FIRST, OTHER = "source1_entity_id", "matched_entity_id"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_simple_and_full_normal_forms(spark):
    cases = [("Acmé & Sons, Ltd.", "acmé and sons ltd", "acme and sons limited"), ("Pvt Super Logistics Ltd", "pvt super logistics ltd", "super logistics private limited"), (None, "", ""), ("", "", ""), ("M/S Ravi Traders", "m s ravi traders", "ravi traders"), ("visit www.shop.com now", "visit www shop com now", "visit now")]
    df = spark.createDataFrame([(i, c[0], None, None) for i, c in enumerate(cases)], "entity_id int, business_name string, business_address string, country string")
    got = derive.with_columns(df, ("name",)).select("entity_id", "name", normalize.business_name(F.col("business_name")).alias("full")).orderBy("entity_id").collect()
    assert [(r["name"], r["full"]) for r in got] == [c[1:] for c in cases]


def test_addresses_and_anchors(spark):
    cases = [("12 Main St, CA", "US", "12 main street california", "12", ""), ("Plot No 0045, MH 560001", "IN", "plot no 0045 maharashtra 560001", "45", "560001"), ("महाराष्ट्र 12", "IN", "maharashtra 12", "12", ""), ("000 Oak Rd", "FR", "000 oak road", "0", "")]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, c string")
    df = df.select("i", normalize.business_address(F.col("a"), F.col("c")).alias("t"))
    got = df.select("i", "t", normalize.house_number(F.col("t")).alias("h"), normalize.postal_code(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r["t"], r["h"], r["p"]) for r in got] == [c[2:] for c in cases]


def _plain_lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd é", max_size=14), st.text("abcd é", max_size=18))
def test_alignment_kernels(a, b):
    assert similarity.common_subsequence(a, b) == _plain_lcs(a, b)
    assert similarity.ratio_of(a, b) == similarity.ratio_of(b, a) <= 1
    assert 0 <= similarity.partial_of(a, b) <= 1
    short, long = sorted((a, b), key=len)
    if short:
        windows = [long[max(i, 0) : i + len(short)] for i in range(1 - len(short), len(long)) if long[max(i, 0) : i + len(short)]]
        assert similarity.partial_of(a, b) == pytest.approx(max(similarity.ratio_of(short, w) for w in windows))
    if set(a.split()) & set(b.split()) and set(a.split()) <= set(b.split()):
        assert similarity.token_set_of(a, b) == 1


def test_features_on_degenerate_pairs(spark):
    pairs = spark.createDataFrame([("S2-1", None, None, None, None, None, None, None, None, None, None), ("S3-1", "ab", "international business machines", "", "1 x", "0", "0", "", "", "fr", "fr"), ("S2-2", "i b m", "ibm", "12 main", "12 main", "12", "12", "56000", "56001", "us", "us")],
                                  "matched_entity_id string, name1 string, name2 string, addr1 string, addr2 string, house1 string, house2 string, postal1 string, postal2 string, country1 string, country2 string")
    got = {r["matched_entity_id"]: r for r in features.extract(pairs).collect()}
    assert len([c for c in got["S2-1"].asDict() if c not in pairs.columns]) == 52
    assert got["S2-1"]["name_token_jaccard"] == 1 and got["S2-1"]["name_exact"] == 0 and got["S2-1"]["country_missing"] == 1 and got["S2-1"]["name_ratio"] == 0
    assert got["S2-2"]["name_acronym_match"] == 1 and got["S2-2"]["address_exact"] == 1 and got["S2-2"]["postal_prefix3"] == 1 and got["S2-2"]["postal_exact"] == 0
    assert got["S3-1"]["source3"] == 1 and got["S3-1"]["house_match"] == 1 and got["S3-1"]["address_token_jaccard"] == 0


def _entities(spark, names):
    return spark.createDataFrame([(i, n, "1 road", "us") for i, n in names], tables.ENTITY)


def test_cap_drops_whole_entity_and_counts_join_rows(spark):
    e = _entities(spark, [("S1-1", "apple tree"), ("S1-2", "pear tree"), *[(f"S2-{k}", "apple tree") for k in range(3)], ("S2-9", "pear tree")])
    by_token = blocking.Channel("t", (channels.words(channels.nt, 3),), exploded=0, cap=5)
    # S1-1 meets three rows by apple and four by tree; S1-2 meets one and four
    assert rows(blocking.pairs(e, by_token).select(FIRST).distinct()) == [("S1-2",)]
    exact = blocking.Channel("n", (channels.name,), cap=2)
    assert rows(blocking.pairs(e, exact)) == [("S1-2", "S2-9")]
    assert rows(blocking.pairs(e, blocking.Channel("n", (channels.name,), cap=3)).select(FIRST).distinct()) == [("S1-1",), ("S1-2",)]


def _work(df):
    """Rows of the result; most rows that a join of its plan made and that an exchange moved."""
    out, joined, moved, todo = df.collect(), 0, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
        counted = lambda k: node.metrics().apply(k).value() if node.metrics().contains(k) else 0  # noqa: E731, B023
        joined = max(joined, counted("numOutputRows") if "Join" in kind else 0)
        moved = max(moved, counted("shuffleRecordsWritten"))
    return sorted(map(tuple, out), key=str), joined, moved


def test_shared_keys_of_many_equal_names_are_counted_before_pairs_are_made(spark):
    e = _entities(spark, [*[(f"S1-{k}", "maple house") for k in range(100)], *[(f"S2-{k}", "maple house") for k in range(200)], ("S1-900", "aaaaaa x"), ("S1-901", "birches"), ("S3-900", "aaaaax"), ("S3-901", "birchen"), ("S3-902", "obirch")])
    # the word of equal letters meets one gram twice over; birches shares two grams with birchen and with obirch
    got, joined, _ = _work(blocking.pairs(e, channels.by_name()["b38_positional_grams"]))
    assert got == [("S1-900", "S3-900", 6), ("S1-901", "S3-901", 3), ("S1-901", "S3-902", 2)]
    assert joined < 1_000


def test_union_moves_no_pairs_of_equal_names(spark, monkeypatch):
    monkeypatch.setattr(blocking, "CROSSED", 1_000, raising=False)
    c = channels.by_name()
    names = [n for n in c if n[:4] in {f"b{i:02d}_" for i in range(1, 10)}]
    e = _entities(spark, [*[(f"S1-{k}", "maple house") for k in range(100)], *[(f"S2-{k}", "maple house") for k in range(200)], ("S1-900", "maple yard"), ("S3-900", "stone yard"), ("S3-901", "stone road"), ("S1-901", ""), ("S3-902", ""),
                            ("S1-902", "iron gate"), ("S1-902", "iron door"), ("S3-903", "iron gate"), ("S3-903", "iron door"), ("S3-903", "iron gate")])
    want = {p for n in names for p in rows(blocking.pairs(e, c[n]).select(FIRST, OTHER))}
    from weftline.plans import evaluation

    monkeypatch.setattr(evaluation.tables, "entities", lambda *a: e)
    got, _, moved = _work(evaluation.union_of_blocks(spark, ""))
    assert got == sorted(want, key=str) and len(got) > 20_000 and ("S1-902", "S3-903") in got
    assert moved < 5_000


def test_null_country_and_empty_keys_never_pair(spark):
    e = spark.createDataFrame([("S1-1", "", None, None), ("S2-1", "", None, None), ("S1-2", "x y", "", None), ("S2-2", "x y", "", None)], tables.ENTITY)
    for name in ("r1_name_address", "b10_prefix4", "b61_rare_name_token", "b30_squashed_name4"):
        assert blocking.pairs(e, channels.by_name()[name]).count() == 0, name
    assert rows(blocking.pairs(e, channels.by_name()["b01_exact_name"])) == [("S1-2", "S2-2")]


def test_injective_by_candidate(spark):
    claims = spark.createDataFrame([("S1-2", "m", 0.9), ("S1-1", "m", 0.9), ("S1-3", "m", 0.5), ("S1-3", "n", 0.4)], f"{FIRST} string, {OTHER} string, probability double")
    want = [("S1-1", "m", 0.9), ("S1-3", "n", 0.4)]
    assert rows(resolve.injective_by_candidate(claims)) == want == rows(resolve.injective_by_rank(claims))
    assert rows(resolve.singleton_shield(claims.filter(f"{OTHER} = 'm'"), 0.95)) == []
    lists = sinks.result_lists(spark.createDataFrame([("S1-1",), ("S1-9",)], "entity_id string"), claims)
    assert rows(lists) == [("S1-1", "m"), ("S1-9", "")]


def test_macro_conventions(spark):
    spine = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], f"{FIRST} string")
    truth = spark.createDataFrame([("a", "1"), ("a", "2"), ("c", "3")], f"{FIRST} string, {OTHER} string")
    pred = spark.createDataFrame([("a", "1"), ("d", "9")], f"{FIRST} string, {OTHER} string")
    got = evaluate.macro(pred, truth, spine).first()
    assert got["macro_f"] == pytest.approx((1.25 / 1.5 + 1 + 0 + 0) / 4) and got["entities"] == 4
    assert evaluate.micro(pred, truth).first()["f"] == pytest.approx(1.25 / (0.25 * 3 + 2))


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("S1-1", 'a "q" b', None, "us"), ("S1-2", "null", "x", "")], tables.ENTITY)
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert rows(tables.read_tsv(spark, str(tmp_path / "t"))) == [("S1-1", 'a "q" b', None, "us"), ("S1-2", None, "x", None)]
    pairs = tables.list_to_pairs(spark.createDataFrame([("a", "x, y,"), ("b", None), ("c", "")], tables.TRUTH_LIST))
    assert rows(pairs) == [("a", "x"), ("a", "y")]
    assert rows(sinks.scrub_quotes(spark.createDataFrame([("a", '""'), ("b", "x")], tables.TRUTH_LIST))) == [("a", ""), ("b", "x")]


def test_ranked_matches_row_number(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as k")
    got = sets.ranked(df, "k").orderBy("k").select("_r").collect()
    assert [r[0] for r in got] == list(range(1, 1001))


def test_sampling_is_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = (rows(sampling.seeded(d, "k", 20, 3)) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 20
    assert rows(sampling.quota(df.withColumn("l", F.col("k") % 2), "l", "k", 3, 1).groupBy("l").count()) == [(0, 3), (1, 3)]


def test_gates_are_boolean_on_all_rows(spark):
    f = spark.createDataFrame([(0.99, 0.5, 0.1, 0, 0, 0), (0.91, 0.3, 0.96, 0, 0, 0), (0.96, 0.1, 0.7, 0, 1, 0)], "probability double, name_ratio double, address_ratio double, house_match int, name_contains int, name_acronym_match int")
    assert [r[0] for r in f.select(gates.final()).collect()] == [True, False, True]


def test_streamed_entities_evict_weaker_claims(spark, tmp_path):
    from weftline.streaming import incremental

    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    others = spark.createDataFrame([("S2-1", "apple tree", "1 road", "us")], tables.ENTITY)

    def claims(e):
        exact = blocking.pairs(e, channels.by_name()["r1_name_address"])
        loose = blocking.pairs(e, channels.by_name()["b03_first_token_rare"]).withColumn("probability", F.lit(0.5))
        return resolve.merge_claims([exact, loose])

    def arrive(name, line):
        (folder / name).write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + line)
        incremental.start(incremental.arriving(spark, str(folder)), others, claims, state, str(tmp_path / "cp")).awaitTermination()
        return rows(incremental.current(spark, state))

    assert arrive("a.tsv", "S1-1\tapple pie\t9 lane\tus\n") == [("S1-1", "S2-1", 0.5)]
    assert arrive("b.tsv", "S1-2\tapple tree\t1 road\tus\n") == [("S1-2", "S2-1", 0.9995)]


def test_a_repeated_batch_gives_the_same_assignments(spark, tmp_path):
    from weftline.streaming import incremental

    state = str(tmp_path / "state")
    others = spark.createDataFrame([("S2-1", "apple tree", "1 road", "us")], tables.ENTITY)
    claims = lambda e: blocking.pairs(e, channels.by_name()["r1_name_address"])
    one, two = (spark.createDataFrame([(i, "apple tree", "1 road", "us")], tables.ENTITY) for i in ("S1-5", "S1-3"))
    assert incremental.current(spark, state) is None
    for batch, new in ((0, one), (1, two), (1, two), (2, one), (3, one)):
        incremental.resolve_batch(new, others, claims, state, batch)
    (tmp_path / "state" / "v=9").mkdir()  # a version whose writer never committed
    assert rows(incremental.current(spark, state).select(FIRST)) == [("S1-3",)] and incremental._versions(spark, state) == [2, 3]


def test_scripts_are_read_by_their_letters_names():
    cases = {"राजा": "raja", "कमल": "kamala", "Москва": "moskva", "Αθηνα": "athena", "é ß": "e ss", "१२": "12", "中": "", "plain": "plain"}
    assert {k: normalize.fold(k).lower() for k in cases} == cases


def test_closure_reaches_identical_records_once(spark):
    e = spark.createDataFrame([(f"S2-{k}", "n", "a", "us") for k in range(5)] + [("S3-1", "m", "a", "us"), ("S3-2", "", "", "us"), ("S3-3", "", "", "us")], "entity_id string, name string, addr string, country string")
    classes = resolve.identical_records(e)
    assert rows(classes) == [(f"S2-{k}", "S2-0") for k in range(5)]
    matches = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-4"), ("S1-2", "S3-1")], f"{FIRST} string, {OTHER} string")
    assert rows(resolve.one_hop_closure(matches, classes)) == [*[("S1-1", f"S2-{k}") for k in range(5)], ("S1-2", "S3-1")]


def _normal(pdf):
    def cell(v):
        if v is None or v != v:
            return "None"
        return str(round(v, 6)) if isinstance(v, float) else str(v)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(cell, r)) for r in pdf.itertuples(index=False))


def test_registered_queries_equal_duckdb(spark, sf_dir):
    from weftline.plans import catalogue

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    found, oracles = catalogue.queries(), catalogue.oracle_sql()
    slow = {"boosted_ensemble", "stacked_scores", "pure_leaves", "all_features", "channel_b16", "channel_b14"}
    wrong = []
    for name, f in found.items():
        if name in oracles and name not in slow and (not name.startswith("channel_") or hash_of(name) % 4 == 0):
            if _normal(f(spark, sf_dir).toPandas()) != _normal(con.sql(oracles[name]).df()):
                wrong.append(name)
    assert not wrong


def hash_of(name):
    return sum(map(ord, name))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tfidf_pairs_meet_as_classes(spark, monkeypatch):
    """Copies, repeated ids, ids in two countries and rows without id or country give the SQL's pairs; what leaves a cell
    is pairs of classes over the limit, not meetings on grams."""
    monkeypatch.setattr(tfidf, "CELL", (40, 80))  # several cells
    words = ["harbor", "harbour", "lantern", "lanterns", "meadow", "orchard", "timber", "valley"]
    made = [(f"S{i % 3 + 1}-{i}", "xy"[i % 7 == 0], " ".join(words[(i * k + i // 5) % 8] for k in (1, 3, 5))) for i in range(60)]
    made += [(f"S{i % 3 + 1}-{i}", "x", "timber valley orchard") for i in range(100, 130)]
    made += [("S1-0", "y", "meadow lantern"), ("S2-1", "x", "harbor valley"), ("S2-1", "y", "meadow lantern"), ("S2-1", "y", "meadow lantern"), (None, "x", "harbor timber"), (None, "x", "harbor timber"), ("S2-900", None, "meadow lantern"), ("S2-901", "x", "abc")]
    df = spark.createDataFrame(made, "entity_id string, country string, name string")
    got = rows(tfidf.similar(df).withColumn("cosine", F.round("cosine", 6)))
    con = duckdb.connect()
    con.execute("create table e (entity_id varchar, country varchar, name varchar)")
    con.executemany("insert into e values (?, ?, ?)", made)
    assert got == sorted(con.execute(tfidf.duck("select * from e")).fetchall(), key=str) and len(got) > 200

    import pyarrow as pa

    cell = pa.RecordBatch.from_pylist([{"first": k < 2, "c": bytes([k]), "keys": g, "w": [1.0] * len(g)} for k, g in enumerate((["a", "b"], ["c", "d", "e"], ["a", "b"], ["b", "f"], ["c", "d", "e", "f"]))])
    out = pa.Table.from_batches(tfidf._met(iter([cell]), 0.75)).to_pylist()
    assert [(r["c1"], r["c2"], round(r["cosine"], 6)) for r in out] == [(b"\0", b"\2", 1.0), (b"\1", b"\4", 0.866025)]
