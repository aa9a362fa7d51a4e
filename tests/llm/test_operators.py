"""Training-data operators against plain versions, and on degenerate inputs."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import _base, _graph, _text, _tokens, ann, bfd_packing, cross_entropy, fm_quality, html_main, line_rules, mixing, neardup, packing, registry, token_counts

ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 6), (4, "one", "en", "a", 3), (5, "one", "en", "a", 3), (None, "no id at all, here", "en", None, None),
    (6, "word " * 30_000, "en", "b", 150_000), (7, "é" * 5000 + " ümlaut ß   中文 " * 50, "de", "b", 1), (7, "same id other text " * 9, "de", "b", 1), (8, "x" * 200_000, "en", "b", 200_000),
    (9, "<|endoftext|> & <b>", "en", "b", 19), (1, None, "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, long and repeated rows, with extra columns whose names clash with results."""
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumns({"score": F.lit("x"), "class_id": F.lit(1), "kept": F.lit(None).cast("boolean"), "tokens": F.lit(2.5), "id": F.lit("i"), "key": F.lit("k")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, None), (6, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


# -- shared text helpers ------------------------------------------------------------------------------------------


def test_words_and_shingles_follow_texts():
    texts = [None, "", "a b", " a  b\n", "one two three four five six", "one two three four five", "x" * 9000, "x" * 4096 + "y" + "x" * 4903]
    raw, offsets = _text.buffer_of(pa.array(texts))
    start, end, h, at = _text.words(raw, offsets)
    assert [len((t or "").split()) for t in texts] == np.diff(at).tolist()
    assert h[at[2]] == h[at[3]] and h[at[2]] != h[at[2] + 1] and h[at[6]] != h[at[7]]
    key, owner = _text.shingles(h, at)
    assert Counter(owner.tolist()) == {2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1}
    assert set(key[owner == 2]) == set(key[owner == 3]) and set(key[owner == 5]) < set(key[owner == 4])


# -- packing ------------------------------------------------------------------------------------------------------


def _ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(_tokens.default_path())
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_untouched_tokenizer(monkeypatch):
    texts = ["<|endoftext|>", "a <|endoftext|>b<|endoftext|><|endoftext|> c", "<|endoftext", "plain text,  é中 \n\n 12", "<|endoftext|> " * 300]
    fast = _tokens.encoder(_tokens.default_path())
    assert [fast(t).tolist() for t in texts] == [_ids(t)[:-1] for t in texts] and 50256 in fast(texts[1])
    monkeypatch.setattr(_tokens, "_cache", {})
    monkeypatch.setattr(_tokens.os.path, "exists", lambda p: False)
    slow = _tokens.encoder(_tokens.default_path())
    assert [slow(t).tolist() for t in texts] == [_ids(t)[:-1] for t in texts]


def _check_pieces(found, texts, width=1024):
    """Pieces cover each document exactly and fill their sequences without gaps."""
    by_seq, total = defaultdict(list), 0
    for r in found:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width
    want = Counter(tuple(_ids(t)) for _, t in texts)
    crcs = Counter()
    for ids, n in want.items():
        crcs[len(ids)] += n
        total += len(ids) * n
    assert sum(r["length"] for r in found) == total
    whole = defaultdict(list)
    for r in found:
        whole[r["doc_id"], r["doc_tokens"]].append(r)
    for doc, text in texts:
        ids = _ids(text)
        mine = [r for r in whole[doc, len(ids)]]
        spans = Counter((r["start"], r["length"]) for r in mine)
        assert sum(k[1] * v for k, v in spans.items()) % len(ids) == 0
        for r in mine:
            if r["ids_crc32"] != zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()):
                assert sum(1 for d, t in texts if d == doc and len(_ids(t)) == len(ids)) > 1
    return by_seq


def test_concat_and_cut(spark, odd, none):
    found = packing.pieces(odd.repartition(3)).collect()
    seqs = _check_pieces(found, [(r[0], r[1]) for r in ODD])
    filled = sorted(sum(n for _, n in p) for p in seqs.values())
    assert filled[1:] == [1024] * (len(filled) - 1) and sorted(seqs) == list(range(len(seqs)))
    assert packing.pieces(none).count() == 0


def test_windows_are_the_stream(spark, docs):
    few = docs.limit(40).repartition(4).cache()
    placed = packing.placed(few).orderBy("_start").collect()
    stream = b"".join(bytes(r["_ids"]) for r in placed)
    got = packing.sequences(few).orderBy("sequence_id").collect()
    assert b"".join(bytes(r["ids"])[: 2 * r["n_ids"]] for r in got) == stream
    assert all(len(r["ids"]) == 2048 or r["n_ids"].bit_count() == 1 for r in got)


def test_windows_of_long_documents(spark):
    docs = spark.createDataFrame([(1, "long words here " * 9000), (2, None), (3, "x"), (4, "more of it " * 5000)], "doc_id long, text string").coalesce(2)
    stream = b"".join(bytes(r["_ids"]) for r in packing.placed(docs).orderBy("_start").collect())
    got = packing.sequences(docs, 64).orderBy("sequence_id").collect()
    assert b"".join(bytes(r["ids"])[: 2 * r["n_ids"]] for r in got) == stream and all(r["n_ids"] == 64 for r in got[:-1])


def test_written_matrices_round_trip(spark, odd, tmp_path):
    bfd_packing.write_packed(odd, str(tmp_path / "packed"))
    found = Counter()
    pieces = defaultdict(dict)
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 1024 and r["cu_seqlens"][-1] == r["n_ids"] and not ids[r["n_ids"] :].any()
        for k, (a, b) in enumerate(zip(r["cu_seqlens"], r["cu_seqlens"][1:])):
            assert np.frombuffer(r["positions"], "<u2")[a:b].tolist() == list(range(b - a))
            if r["doc_tokens"][k] == b - a:
                found[r["doc_ids"][k], tuple(ids[a:b])] += 1
            else:
                pieces[r["doc_ids"][k]][r["starts"][k]] = ids[a:b].tolist()
    for doc, parts in pieces.items():
        found[doc, tuple(x for at in sorted(parts) for x in parts[at])] += 1
    assert found == Counter((r[0], tuple(_ids(r[1]))) for r in ODD)


def test_best_fit_decreasing(odd, none):
    rng = np.random.RandomState(3)
    lengths = rng.randint(1, 65, 400).tolist()
    rows = bfd_packing.best_fit(lengths, 64)
    room, plain = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [k for k in range(len(room)) if room[k] >= lengths[i]]
        if fit:
            k = min(fit, key=lambda k: room[k])
            room[k] -= lengths[i]
            plain[k].append(i)
        else:
            room.append(64 - lengths[i])
            plain.append([i])
    assert sorted(i for r in rows for i in r) == list(range(400)) and all(sum(lengths[i] for i in r) <= 64 for r in rows)
    assert len(rows) == len(plain)
    found = bfd_packing.digest(bfd_packing.packed(odd.repartition(2))).collect()
    _check_pieces(found, [(r[0], r[1]) for r in ODD])
    assert bfd_packing.packed(none).count() == 0
    for r in bfd_packing.packed(odd).collect():
        position = np.frombuffer(r["positions"], "<u2")
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert position[a:b].tolist() == list(range(b - a))


# -- token counts -------------------------------------------------------------------------------------------------


def _plain_count(word, path):
    scores, _, miss = token_counts.vocabulary(path)
    word = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = []
        for i in range(j):
            if word[i:j] in scores:
                options.append((best[i][0] + scores[word[i:j]], best[i][1] + 1))
        if word[j - 1] not in scores:
            options.append((best[j - 1][0] + miss, best[j - 1][1] + len(word[j - 1].encode())))
        best[j] = max(options, key=lambda o: (o[0], -o[1]))
    return best[-1][1]


def test_trie_counts_equal_plain_dynamic_program(docs, odd, none):
    path = token_counts.default_path()
    for df in (docs.limit(30), odd.filter("doc_id <> 8 or doc_id is null")):
        for r in token_counts.counted(df, id_col="doc_id").join(df.select("doc_id", "text"), "doc_id").filter("doc_id <> 7").collect():
            words = (r["text"] or "").split()
            known = {w: _plain_count(w, path) for w in set(words)}
            assert r["n_pretokens"] == len(words) and r["n_tokens"] == sum(known[w] for w in words)
    assert token_counts.counted(none).count() == 0 and token_counts.counted(odd).count() == len(ODD)


def test_trie_scores_each_prefix_once():
    path = token_counts.default_path()
    trie, made = token_counts.Trie(path), []
    forward = trie._forward
    trie._forward = lambda word, j, *rest: made.append(word[:j]) or forward(word, j, *rest)
    words = ["interested", "interest", "interesting", "interests", "in", "x" * 300, "x" * 299, "ünïcode中文"]
    assert token_counts.counts_of(words, trie) == [_plain_count(w, path) for w in words]
    short = [p for p in made if len(p) <= token_counts.DEPTH]
    assert len(short) == len(set(short)) == len(trie.best) - 1 and token_counts.counts_of(["interest", ""], trie) == [_plain_count("interest", path), 0]


# -- quality ------------------------------------------------------------------------------------------------------


def test_factorisation_identity_and_learning():
    rng = np.random.RandomState(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) if i % 2 else "###$$$ " * 20 + "THE END!!" for i in range(300)]
    begin, cols, vals = fm_quality.features(pa.array(texts))
    y = np.arange(300) % 2.0
    model = fm_quality.fit(begin, cols, vals, y, steps=15)
    score = fm_quality.probability(model, fm_quality.raw_scores(model, begin, cols, vals))
    assert score[y == 1].min() > score[y == 0].max()
    c, x = cols[begin[0] : begin[1]], vals[begin[0] : begin[1]].astype(float)
    v = model["v"][c].astype(float)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(c)) for j in range(i))
    assert fm_quality.raw_scores(model, begin, cols, vals)[0] == pytest.approx(model["w0"] + model["w"][c] @ x + pairs, abs=1e-3)


def test_quality_on_odd_rows(spark, odd, none, labels):
    model = fm_quality.train(odd, labels)
    got = fm_quality.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["_score"] <= 1 for r in got) and got[0]["score"] == "x"
    assert fm_quality.scored(none, fm_quality.train(none, labels)).count() == 0
    assert {r["_score"] for r in fm_quality.scored(odd, fm_quality.train(odd, labels.limit(0))).collect()} == {0.5}
    clash = odd.withColumns({"_score": F.lit("old"), "_meta": F.lit("m"), "_c0": F.lit("c")})
    got = fm_quality.scored(clash, model).first()
    assert isinstance(got["_score"], float) and (got["_meta"], got["_c0"]) == ("m", "c")


def test_quality_sample_is_bounded(spark):
    texts = [(i % 7, f"text {i} " + "word " * (i % 5) * 40) for i in range(700)] + [(3, "the same")] * 500 + [(4, None)] * 9
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(7)], "_id long, _y int")
    got = _base.labelled_texts(docs, chosen, 50, 1 << 20).collect()
    assert len(got) == 50 and len({(r["_id"], r["_m"]) for r in got}) == 50
    whole = _base.labelled_texts(docs, chosen, 10_000, 1 << 20).collect()
    assert len(whole) == 702 and sum(r["_text"] == "the same" for r in whole) == 1
    assert sum(len(r["_text"] or "") for r in _base.labelled_texts(docs, chosen, 10_000, 3000).collect()) <= 3000
    assert _base.labelled_texts(docs.limit(0), chosen, 10, 10).count() == 0


def test_calibration_by_newton():
    rng = np.random.RandomState(11)
    z = rng.normal(size=4000) * 3 + 1
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.7 * z - 1.2)))).astype(float)
    a, b = fm_quality.platt(z, y)
    assert a == pytest.approx(0.7, abs=0.06) and b == pytest.approx(-1.2, abs=0.15)
    a, b = fm_quality.platt(np.array([-2.0, -1.0, 1.0, 2.0] * 20), np.array([0.0, 0.0, 1.0, 1.0] * 20))
    assert np.isfinite([a, b]).all() and 1 / (1 + np.exp(-(a + b))) > 0.9


@pytest.mark.parametrize("sf,most", [("0.01", 0.2), ("0.1", 0.1)])
def test_predictions_decide_on_held_out_documents(spark, sf, most):
    d = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = registry.queries()["op1_factorisation_machine_quality"](spark, d).filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    good, bad = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.93 and np.mean(bad) <= most


def test_quality_generalises(spark):
    """Held-out ranking on the tables with enough labels."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = registry.queries()["op1_factorisation_machine_quality"](spark, d).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and docs.count()


# -- line rules ---------------------------------------------------------------------------------------------------


def test_repeated_windows(spark):
    rng = np.random.RandomState(1)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (0, 1, 7, 8, 9, 12, 30, 60)] + ["a b c d e f g h " * 5, " ".join(map(str, range(500))), "q " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", line_rules.repeat_words(line_rules.words_of(F.col("text"))).alias("n")).orderBy("doc_id").collect()
    for r in got:
        w = texts[r["doc_id"]].split()
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = Counter(windows)
        assert r["n"] == len({i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(8)}), r["doc_id"]


def test_frequent_lines_go_copies_and_rare_lines_stay(spark):
    banner = "Read our terms and share this page"
    rows = [(i, f"{banner}\n" + "\n".join(f"own words {i} {k} and x{k} more y{k} of z{k} here" for k in range(4)), "h") for i in range(60)]
    rows += [(1000 + i, "one copied page has a line of many words\nand another line that only it has in all the host, said at length", "h") for i in range(60)]
    rows += [(2000, f"{banner}\n{banner}\n{banner}\n{banner}\n{banner}\ntiny rest", "h"), (2001, None, None), (2002, f"{banner} elsewhere\nfine " + "words " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in line_rules.judged(df).collect()}
    assert got[0]["_kept"] and got[0]["_clean_text"].startswith("own words") and got[0]["_left_words"] == got[0]["_n_words"] - 7
    assert got[1000]["_kept"] and got[1000]["_clean_text"] == got[1000]["text"]
    assert not got[2000]["_kept"] and got[2001]["_base_failed"] and got[2001]["_n_words"] == 0


def test_line_frequency_counts_distinct_documents(spark):
    menu = [f"shared line {k} of the menu" for k in range(12)]
    rows = [("\n".join([*menu, f"own line {i}"]), "h") for i in range(40)] + [(f"no menu {i}", "h") for i in range(160)]
    rows += [("one text copied often", "h")] * 1000
    got = line_rules.frequent_lines(spark.createDataFrame(rows, "text string, source string")).collect()
    assert Counter(r["_host"] for r in got) == {"h": 12}
    # every document's smallest hash is a shared line: none of the shared lines may hide the others
    rows = [(f"{menu[i]}\n{menu[j]}\nand own {i} {j} {k}", "h") for i in range(12) for j in range(i) for k in range(5)]
    assert line_rules.frequent_lines(spark.createDataFrame(rows, "text string, source string")).count() == 12


def test_limit_of_a_large_host_grows_with_its_root(spark):
    rows = [(("a line that a hundred pages share\n" if i < 100 else "") + ("short one\n" if i < 120 else "") + f"own line {i}", "h") for i in range(2000)]
    got = line_rules.frequent_lines(spark.createDataFrame(rows, "text string, source string")).collect()
    assert [r["_line"][0] for r in got] == ["l"]  # 100 > 2 * sqrt(2000) = 89; the short line is under a tenth


def test_many_frequent_lines_are_all_found(spark):
    menu = [f"shared line {k} of the menu" for k in range(300)]
    rows = [(i, "\n".join([*menu, *[f"own words {i} {k} and more of them here" for k in range(99)]]), "h") for i in range(30)]
    got = line_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=20).collect()
    assert all(r["_left_words"] == 99 * 9 and "menu" not in r["_clean_text"] for r in got)


def test_line_rules_of_a_very_long_text_and_clashing_names(spark):
    n = 1_000_000
    text = " ".join(f"w{i % (n - 20)}" for i in range(n)) + "\n" + "tail line\n" * 3
    df = spark.createDataFrame([(1, text, "h", "mine", 5)], "doc_id long, text string, source string, _words string, _kept int").withColumns({"_lists": F.lit(1), "_h2": F.lit("z")})
    r = line_rules.judged(df).first()
    assert r["_n_words"] == n + 6 and r["_n_repeat_words"] == 40 and r["_n_dup_lines"] == 2 and r["_kept"] is True and r["_words"] == "mine" and r["_h2"] == "z"
    out = line_rules.stage(None, df, "")
    assert out.columns == df.columns and (out.first()["_kept"], out.first()["_lists"]) == (5, 1)


def test_what_is_left_meets_the_base_minimum(spark):
    rows = [(i, "this banner stands on all of the pages\n" + " ".join(f"w{i}x{k}" for k in range(15 + i % 2 * 5)), "h") for i in range(60)]
    got = line_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["_left_words"] == 15 + r["doc_id"] % 2 * 5 and not r["_base_failed"] and r["_kept"] == (r["doc_id"] % 2 == 1) for r in got)


def test_line_rules_on_odd_rows(odd, none):
    got = line_rules.judged(odd).collect()
    assert len(got) == len(ODD) and line_rules.judged(none).count() == 0
    out = line_rules.stage(None, odd, "")
    assert out.columns == odd.columns and out.filter("doc_id = 6").count() == 0


# -- pages --------------------------------------------------------------------------------------------------------


def test_page_parts():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class=home>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We set cookies, yes.</div>
    <div id=wrap><div class="sidebar"><p>Other, things, to read.</p></div><article><h1>A title</h1><p>First&nbsp;para, with <b>bold</b> &amp;amp; text.<p>Second.
    <ul><li>item one<li>item two</ul><div class="ad">Buy now, please!</div><form>Name <input></form></article>
    <section id="comments"><p>I think, so, too.</p></section></div><footer>&copy; all</footer></body></html>"""
    assert html_main.main_text(page) == "A title\nFirst para, with bold &amp; text.\nSecond.\nitem one\nitem two"


def test_nothing_of_the_article_is_dropped():
    para = "<p>A sentence of the article, with a clause; and more of it, said at some length here.</p>"
    text = para[3:-4]
    heading = f"<body><div class=post><h1>Head</h1><div class=body>{para * 9}</div></div></body>"
    assert html_main.main_text(heading) == "\n".join(["Head", *[text] * 9])
    lead = f"<body><div class=lead>{para}</div><div class=post>{para * 9}</div></body>"
    assert html_main.main_text(lead) == "\n".join([text] * 10)
    linked = f"<body><article><h2><a href=/x>Linked head</a></h2>{para * 9}<ul><li><a href=/r>Reference one</a></li></ul></article></body>"
    assert html_main.main_text(linked) == "\n".join(["Linked head", *[text] * 9, "Reference one"])


def test_names_weigh_and_ratios_decide():
    para = "<p>A sentence of the article, with a clause; and more of it, said at some length here.</p>"
    text = para[3:-4]
    body = f"<article><h1>T</h1>{para * 4}<div class='legal-history'><p>Short law.</p></div><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>{para}</article>"
    assert html_main.main_text(body) == "\n".join(["T", *[text] * 4, "Short law.", "One", "Two", text])
    history = f"<body><div class=top><a href=/>Home</a></div><div class='related-work'>{para * 6}</div><div class=menu><a href=/a>A</a> <a href=/b>B</a></div></body>"
    assert html_main.main_text(history) == "\n".join([text] * 6)
    comments = f"<body><div id=post>{para * 6}</div><div class='post-comments'><p>I think so too, and well said.</p><p>Me not, I fear.</p></div></body>"
    assert html_main.main_text(comments) == "\n".join([text] * 6)
    header = f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{para * 3}<footer>Posted, long ago.</footer></article></body>"
    assert html_main.main_text(header) == "\n".join(["Title", *[text] * 3])
    edges = f"<body><div><a href=/a>Menu one</a><a href=/b>Menu two</a></div><div>{para * 3}</div><div>{para * 3}</div><div><a href=/c>Imprint</a></div></body>"
    assert html_main.main_text(edges) == "\n".join([text] * 6)


def _slow_paths(page):
    """Ratios of each path, by name, from the elements' chains: the method as stated, with no shortcuts."""
    def chain(e):
        return [] if e == 0 else [*chain(page.parent[e]), e]

    step = {p: s for (_, s), p in page.paths.items()}
    name = lambda e: tuple(step[page.path[x]] for x in chain(e))
    rows = [(name(e), t, k, min([1.0, *(page.weight[x] for x in chain(e))])) for e, t, k in zip(page.owner, page.text, page.links)]
    ratio = {}
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        chars, marks, links = sum(len(r[1]) for r in mine), sum(sum(c in ".,;:!?…。，、；：！？¿¡" for c in r[1]) for r in mine), sum(r[2] for r in mine)
        ratio[p] = chars / len(mine) * (1 - links / chars), (1 + marks) / len(mine) * (1 - links / chars), 1 - links / chars, chars
    def smooth(i, j):
        return (ratio[rows[max(i - 1, 0)][0]][j] + 2 * ratio[rows[i][0]][j] + ratio[rows[min(i + 1, len(rows) - 1)][0]][j]) / 4

    fused = {p: np.mean([math.sqrt(smooth(i, 0) * smooth(i, 1)) * r[3] for i, r in enumerate(rows) if r[0] == p]) for p in ratio}
    weight = {r[0]: r[3] for r in rows}
    mean = sum(fused[p] * ratio[p][3] * weight[p] for p in fused) / sum(ratio[p][3] * weight[p] for p in fused)
    chosen = {p for p in fused if fused[p] >= 0.4 * mean * (1 - 1e-12) and ratio[p][2] > 0.5}
    return {r[0] in (chosen or {max(fused, key=fused.get)}) for r in rows}, [r[0] in chosen for r in rows]


def test_paths_equal_slow_ratios(spark, sf_dir):
    rng = np.random.RandomState(21)
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    words = ["Lo, and so.", "one two three four", "<a href=/x>link here</a>", "<b>bold</b>, yes;", "much longer text, with clauses, and more; said twice."]
    for _ in range(150):
        tags = rng.choice(["p", "div", "li", "div class=ad", "section id=comments", "h2", "span class=promo", "td", "div class='legal-note x'"], 30)
        pages.append("".join(f"<{t}>" + " ".join(rng.choice(words, rng.randint(0, 5))) + (f"</{t.split()[0]}>" if rng.rand() < 0.7 else "") for t in tags))
    for text in pages:
        page = html_main.parsed(text)
        if page.text:
            passed = html_main.content_paths(page)
            _, want = _slow_paths(page)
            got = [passed[page.path[e]] for e in page.owner]
            assert got == want or not any(want)


def test_deep_and_long_pages_take_linear_time():
    import time

    deep = "<div>" * 20_000 + "<p>text, at the bottom.</p>"
    names = "".join(f"<div class=c{i}>word {i}, and so." for i in range(20_000))
    stray = "<div><p>x" * 10_000 + "</span></b></i>" * 10_000 + "<li>" * 10_000
    quotes = "<p it's a=\"b>text</p> " * 10_000
    wide = "<p>many, many paragraphs here.</p>" * 60_000
    for page, least in ((deep, 20), (names, 1000), (stray, 1), (quotes, 0), (wide, 1_000_000)):
        began = time.time()
        assert len(html_main.main_text(page)) >= least
        assert time.time() - began < (1 if page is deep else 4)


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p>a", "plain", "<script>x", "<!-- x", "</p></div>", "<p>" * 3000, "<div class='a\"b'>q</div>", "<a href=\"x>y</a> z", "&#0;&#x110000;&bogus;"])
def test_broken_pages_never_fail(page):
    assert isinstance(html_main.main_text(page), str)


def test_pages_query_equals_plain_cut(spark, sf_dir):
    import html
    import re

    for r in registry.queries()["op5_html_tag_path_ratios"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# -- mixing -------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.RandomState(2)
    p = rng.dirichlet([0.4, 2, 0.4], 3000)
    n = rng.randint(1, 900, 3000).astype(float)
    rows = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(n, p)], "_n double, _p0 double, _p1 double, _p2 double").cache()
    held = n @ p
    for targets in (held * [0.5, 1.0, 0.4], held * [1.3, 1.0, 0.9]):
        steps, _, expected = mixing.fit(rows, np.array(targets))
        assert np.allclose(expected, targets, rtol=1e-3)
        got = rows.select(*[F.sum(mixing.rate_of(steps) * F.col("_n") * F.col(f"_p{k}")) for k in range(3)]).first()
        assert np.allclose(list(got), targets, rtol=1e-3)
        r = np.ones(3000)
        for s in steps:
            r = np.maximum(0, r - p @ s)
        assert np.allclose((r * n) @ p, list(got)) and r.min() >= 0


def test_rates_do_not_run_away_where_a_domain_is_nearly_absent(spark):
    rng = np.random.RandomState(3)
    low, toxic = np.minimum(rng.lognormal(-9, 2, 3000), 0.01), np.minimum(rng.lognormal(-7, 2, 3000), 0.3)
    n = rng.randint(20, 900, 3000).astype(float)
    p = np.stack([low, 1 - low - toxic, toxic], 1)
    rows = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(n, p)], "_n double, _p0 double, _p1 double, _p2 double").cache()
    steps, targets, expected = mixing.fit(rows)
    off = lambda s: np.linalg.norm((s - targets) / targets)
    assert off(expected) < off(n @ p) and expected.sum() < 2 * targets.sum()
    r = np.ones(3000)
    for s in steps:
        r = np.maximum(0, r - p @ s)
    assert np.allclose((r * n) @ p, expected)
    # neither code nor plan grows with the steps
    depth = lambda k: str(rows.select(mixing.rate_of([np.ones(3)] * k))._jdf.queryExecution().analyzed().treeString()).count("greatest")
    assert depth(40) == depth(2)


def test_mixing_stage_lists_every_copy(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = [1, 2, mixing.RUN - 1, mixing.RUN, mixing.RUN + 1, 3 * mixing.RUN + 7, 0]
    inner = docs.filter(F.col("doc_id") < len(wanted))

    def given(plain, model, doc_id, text, keep, targets, shares):
        return plain.withColumn("_copies", F.get(F.array(*map(F.lit, wanted)), F.col(doc_id).cast("int"))), {}

    monkeypatch.setattr(mixing, "_mixed", given)
    copies = Counter(r["doc_id"] for r in mixing.stage(spark, inner, sf_dir).select("doc_id").collect())
    assert [copies[i] for i in range(len(wanted))] == wanted


def _plain_buckets(text):
    """Distinct buckets of a text, by the public hash."""
    import regex
    import xxhash

    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D.,;:!?]+", text.lower()) if w]
    distinct, n = list(dict.fromkeys(words)), len(words)
    tenths = lambda m, k: m + str(min(10 * k // n if n else 0, 20))
    marks = [tenths("#s", len(regex.findall(r"[#*$%&|<>!]", text))), tenths("#c", len(regex.findall(r"\p{Lu}\p{Lu}+", text))), tenths("#d", len(distinct))]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return n, sorted({signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) % mixing.BUCKETS for x in distinct + marks})


def test_mixing_equals_plain_version(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = mixing.learn(docs, labels)
    got, report = mixing.mixed_report(docs, model)
    got = {r["doc_id"]: r for r in got.collect()}
    n, p = [], []
    for r in got.values():
        size, buckets = _plain_buckets(r["text"])
        z = model["t"] * (model["w"][buckets].sum(0) / len(buckets) ** 0.25 + model["b"])
        e = np.exp(z - z.max())
        n.append(size)
        p.append(e / e.sum())
    n, p = np.array(n, float), np.array(p)
    assert np.allclose(p, [[r[f"_p{k}"] for k in range(3)] for r in got.values()], atol=1e-9) and n.tolist() == [r["_n"] for r in got.values()]
    share = np.array([mixing.SHARES[d] for d in mixing.DOMAINS])
    held = n @ p
    targets, rate = share / share[1] * held[1], np.ones(len(n))
    for _ in range(mixing.ROUNDS):
        gap = (rate * n) @ p - targets
        if np.abs(gap).max() <= mixing.TOLERANCE * targets.max():
            break
        live = np.where(rate > 0, n, 0)
        rate = np.maximum(0, rate - p @ (np.linalg.pinv((p * live[:, None]).T @ p, rcond=1e-9, hermitian=True) @ gap))
    assert np.allclose(targets, report["targets"]) and np.allclose(rate, [r["_rate"] for r in got.values()], atol=2e-3)
    copies = np.array([r["_copies"] for r in got.values()])
    assert np.allclose((copies * n) @ p, report["realised"]) and (np.abs(copies - rate) < 1 + 2e-3).all()


def test_copies_meet_the_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    _, report = mixing.mixed_report(docs, mixing.learn(docs, labels))
    assert np.allclose(report["expected"], report["targets"], rtol=1e-3) and np.allclose(report["realised"], report["targets"], rtol=0.02)


def test_memberships_hold_on_unseen_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = mixing.learn(docs, labels.filter(~kept_out))
    truth = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 0).otherwise(1)
    rows = mixing.memberships(docs.join(labels.filter(kept_out).select("doc_id", truth.alias("k")), "doc_id"), model).select("k", "_p0", "_p1", "_p2").collect()
    guess = [int(np.argmax(r[1:])) for r in rows]
    assert np.mean([g == r["k"] for g, r in zip(guess, rows)]) > 0.9


def test_mixing_keeps_clashing_columns(spark, odd, labels):
    df = odd.withColumns({"_n": F.lit("n"), "_w": F.lit("w"), "_rate": F.lit("r"), "_copies": F.lit("c"), "_i": F.lit("i")})
    out = mixing.mixed(df, mixing.learn(df, labels)).first()
    assert out["_w"] == "w" and isinstance(out["_rate"], float)
    inner, at = _base.plain(df)
    kept, _ = mixing._mixed(inner, mixing.learn(df, labels), at["doc_id"], at["text"], inner.columns, None, None)
    assert kept.select(at["_n"], at["_rate"], at["_i"]).first() == ("n", "r", "i")


def test_learning_from_repeated_ids_is_bounded(spark):
    rows = [(1, f"good words {i}") for i in range(300)] + [(2, "bad stuff")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    model = mixing.learn(docs, labels, bound=50)
    assert np.isfinite(model["w"]).all() and mixing.mixed(docs, model).count() == 600


def test_mixing_on_odd_rows(odd, none, labels):
    model = mixing.learn(odd, labels)
    got = mixing.mixed(odd, model).collect()
    assert len(got) == len(ODD) and all(r["_rate"] >= 0 and r["_copies"] >= 0 and sum(r[f"_p{k}"] for k in range(3)) == pytest.approx(1) for r in got)
    assert got[0]["tokens"] == 2.5
    assert mixing.mixed(none, model).count() == 0 and mixing.mixed(odd, mixing.learn(none, labels)).count() == len(ODD)


# -- language models ----------------------------------------------------------------------------------------------


def test_cross_entropy_equals_plain(spark):
    rows = [(1, "a b a c"), (2, "a b b"), (3, "z q z q"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cross_entropy.scored(docs, cross_entropy.train(docs, labels)).collect()}

    def model(ids):
        word, pair = Counter(), Counter()
        for i, t in rows:
            if i in ids and t:
                w = ["<s>", *t.split()]
                word.update(w)
                pair.update(zip(w, w[1:]))
        real = sum(v for k, v in word.items())
        return word, pair, real

    def loss(m, text):
        word, pair, total = m
        w, out = ["<s>", *text.split()], []
        for a, b in zip(w, w[1:]):
            single = (word[b] + 0.5) / (total + 0.5 * cross_entropy.WORD_CELLS)
            double = (pair[a, b] + 4 * single) / (word[a] + 4)
            out.append(-math.log(0.6 * min(double, 1) + 0.4 * single))
        return sum(out) / len(out)

    target, back = model({1, 2}), model({1, 2, 3, 4})
    for i, t in rows[:3]:
        assert got[i]["target_loss"] == pytest.approx(loss(target, t), rel=1e-4) and got[i]["background_loss"] == pytest.approx(loss(back, t), rel=1e-4)
    assert got[4]["n_words"] == 0 and got[4]["score"] == 0 and got[3]["score"] > got[1]["score"]


def test_cross_entropy_counts_every_word_apart(spark):
    # as many distinct words as the smoothing's number of words: none may share a count with another
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5000))) for i in range(60)] + [(100, "w0x1 w0x2 unseen1 unseen2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    model = cross_entropy.train(docs, labels)
    got = {r["doc_id"]: r for r in cross_entropy.scored(docs, model).collect()}
    v, n = 60 * 5000 + 3, 60 * 5000 + 4 + 61
    single = lambda c, total: (c + 0.5) / (total + 0.5 * v)
    loss = lambda p, c, a, total: -math.log(0.6 * min((p + 4 * single(c, total)) / (a + 4), 1) + 0.4 * single(c, total))
    back = [loss(1, 2, 61, n), loss(2, 2, 2, n), loss(1, 1, 2, n), loss(1, 1, 1, n)]
    target = [loss(0, 1, 1, 5001), loss(1, 1, 1, 5001), loss(0, 0, 1, 5001), loss(0, 0, 0, 5001)]
    assert got[100]["background_loss"] == pytest.approx(sum(back) / 4) and got[100]["target_loss"] == pytest.approx(sum(target) / 4)
    other = cross_entropy.scored(docs.filter("doc_id = 100"), model).collect()
    assert len(other) == 1 and other[0]["score"] == pytest.approx(got[100]["score"])


def test_cross_entropy_on_odd_rows(odd, none, labels):
    assert cross_entropy.scored(odd, cross_entropy.train(odd, labels)).count() == len(ODD)
    assert cross_entropy.scored(none, cross_entropy.train(none, labels.limit(0))).count() == 0


# -- near duplicates ----------------------------------------------------------------------------------------------


def _plain_classes(docs, threshold=0.8):
    """Classes by comparing all pairs of texts, word by word; only the contexts are the operator's."""
    texts = [(i, (t or "").lower().split()) for i, t in docs if i is not None]
    grams = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for _, w in texts]
    key, owner, _ = neardup.doc_shingles(pa.array([t for i, t in docs if i is not None], pa.string()))
    full = [k for k, g in enumerate(grams) if g]
    context = dict(zip(full, neardup.contexts(key, np.searchsorted(owner, full)).tolist(), strict=True))
    held = defaultdict(set)
    for k in full:
        for g in grams[k]:
            held[g].add(context[k])
    total = len(set(context.values()))
    limit = max(20, total / 20)
    idf = {g: 1.0 if len(c) <= limit else max(0.1, math.log(total / len(c)) / math.log(total / limit)) for g, c in held.items()}
    weight = [{g: n * idf[g] for g, n in x.items()} for x in grams]
    mass = [sum(x.values()) for x in weight]
    near = defaultdict(Counter)  # pairs that share a shingle, and what they share
    where = defaultdict(list)
    for k, x in enumerate(weight):
        for g, w in x.items():
            for j in where[g]:
                near[k][j] += min(w, weight[j][g])
            where[g].append(k)
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, found in near.items():
        for b, both in found.items():
            if both >= threshold * (mass[a] + mass[b] - both) - 1e-9:
                x, y = sorted((find(texts[a][0]), find(texts[b][0])))
                root[y] = x
    return {i: find(i) for i, _ in texts}


def test_near_duplicates_equal_plain(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found, _ = neardup.classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in found.collect()} == _plain_classes(rows)


def test_a_large_group_of_edited_copies_is_one_class(spark):
    rng = np.random.RandomState(4)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, f"other{i} " + " ".join(f"v{i}x{k}" for k in range(60))) for i in range(300)]
    for i in range(300, 700):
        text = list(base)
        text[rng.randint(len(text))] = f"e{i}"
        rows.append((i, " ".join(text)))
    found, links = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert all(got[i] == i for i in range(300)) and {got[i] for i in range(300, 700)} == {300}
    assert links.count() < 5000


def test_blocks_find_what_pairs_find():
    rng = np.random.RandomState(5)
    parts = [(np.unique(rng.randint(0, 60, 40)).astype(np.uint64), None) for _ in range(30)]
    parts = [(k, rng.uniform(0.5, 2, len(k))) for k, _ in parts]
    block = neardup.Block(parts[:12])
    key, owner, w = np.concatenate([k for k, _ in parts[12:]]), np.repeat(np.arange(18), [len(k) for k, _ in parts[12:]]), np.concatenate([w for _, w in parts[12:]])
    got = block.jaccard(key, owner, w, 18, most=50)
    want = [[neardup.weighted_jaccard(*b, *a) for b in parts[:12]] for a in parts[12:]]
    assert np.allclose(got, want)


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.RandomState(6)
    key = np.unique(rng.randint(0, 2**62, 900).astype(np.uint64))
    a, b = key[:600], key[200:800]
    wa, wb = rng.uniform(0.5, 3, len(a)), rng.uniform(0.5, 3, len(b))
    drawn = neardup.icws(np.concatenate([a, b]), np.concatenate([wa, wb]).astype(np.float32), np.array([0, len(a)]), 1000)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(neardup.weighted_jaccard(a, wa, b, wb), abs=0.05)


def test_near_duplicates_on_odd_rows(spark, odd, none):
    found, _ = neardup.classes(odd)
    got = {r["doc_id"]: r["class_id"] for r in found.collect()}
    assert got[4] == got[5] == 4 and got[2] == 2 and got[3] == 3 and got[1] == 1 and got[None] is None and found.count() == len(set(r[:2] for r in ODD))
    assert neardup.classes(none)[0].count() == 0
    out = neardup.stage(spark, odd, "")
    assert out.columns == odd.columns and out.filter("doc_id = 5").count() == 0 and out.filter("doc_id is null").count() == 1
    assert Counter(r["doc_id"] for r in out.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, None: 1, 6: 1, 7: 2, 8: 1, 9: 1}


def test_repeated_rows_and_rows_without_id_leave_one(spark):
    long = "some words that make a text of more than a few shingles so that it can be near another one " * 3
    rows = [(5, long, 1), (5, long, 2), (5, long, 3), (None, long, 4), (None, long, 5), (6, long + "end", 6), (None, "other words alone here", 7), (None, "other words alone here", 8)]
    rows += [(9, "first text of an id with two texts", 9), (9, "second one, quite another text of this id", 10), (None, " ", 11), (None, " ", 12), (8, None, 13), (8, None, 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _p int")
    out = neardup.stage(spark, df, "")
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert out.columns == df.columns and left == {(5, long): 1, (None, "other words alone here"): 1, (9, rows[8][1]): 1, (9, rows[9][1]): 1, (None, " "): 2, (8, None): 1}
    found = {(r["doc_id"], r["n_rows"]): (r["class_id"], r["is_kept"]) for r in neardup.classes(df)[0].collect()}
    assert found[5, 3] == (5, True) and found[6, 1] == (5, False) and found[8, 2] == (8, True)


def test_boilerplate_weighs_less_and_a_group_of_copies_does_not(spark):
    rng = np.random.RandomState(12)
    banner = " ".join(f"b{k}" for k in range(60))
    own = lambda i, n: " ".join(f"o{i}x{k}" for k in range(n))
    rows = [(i, f"{banner} {own(i, 9)}") for i in range(300)]  # mostly boilerplate, but each its own text
    base = own("g", 120).split()
    for i in range(1000, 1150):
        text = list(base)
        text[rng.randint(len(text))] = f"e{i}"
        rows.append((i, " ".join(text)))
    rows += [(i, own(i, 80)) for i in range(2000, 2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = neardup.corpus_weights(docs)
    assert len(weights["key"]) and weights["w"].min() < 0.5
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs)[0].collect()}
    assert all(got[i] == i for i in range(300)) and {got[i] for i in range(1000, 1150)} == {1000}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- neighbours ---------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.RandomState(7)
    centres = rng.normal(size=(20, 16))
    v = (centres[rng.randint(20, size=800)] + 0.3 * rng.normal(size=(800, 16))).astype(np.float32)
    v[100:140] = v[100]  # one vector many times
    rows = [(i, v[i].tolist(), 0) for i in range(800)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 1), (1060, [1.0, None] + [0.0] * 14, 1), (1080, [1.0, 2.0], 1), (None, [1.0] * 16, 0), (5, v[5].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(table, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 800, 20))
    recall = []
    for q, found in got.items():
        s = v.astype(float) @ v[q].astype(float)
        order = [int(i) for i in np.lexsort((np.arange(800), -s.round(9))) if i != q][:20]
        assert len(found) == 20 and q not in dict(found) and [x for _, x in found] == sorted((x for _, x in found), reverse=True)
        assert all(abs(s[i] - x) < 1e-9 for i, x in found)
        recall.append(len({i for i, _ in found} & set(order)) / 20)
    assert np.mean(recall) >= 0.9
    assert [i for i, _ in got[100]] == list(range(101, 121)) and [i for i, _ in got[120]] == [i for i in range(100, 121) if i != 120]
    few = ann.nearest(table.filter("vec_id in (0, 1, 2)"), F.col("id") % 20 == 0).collect()
    assert len(few) == 2 and ann.nearest(table.limit(0), F.col("id") % 20 == 0).count() == 0


def test_outlying_queries_find_all_they_ask_for(spark):
    rng = np.random.RandomState(9)
    v = 0.01 * rng.normal(size=(400, 8)) + np.array([5.0] + [0.0] * 7)
    v[0], v[20] = [-3.0] + [0.0] * 7, [0.0] * 7 + [2.0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    found = Counter(r["query_id"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect())
    assert found == {i: 20 for i in range(0, 400, 20)}
    small = ann.nearest(spark.createDataFrame(rows[:12], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    s = v[:12] @ v[0]
    assert [r["vec_id"] for r in sorted(small, key=lambda r: r["rank"])] == [int(i) for i in np.lexsort((np.arange(12), -s)) if i][:11]


def test_vectors_of_any_finite_size(spark):
    rng = np.random.RandomState(10)
    v = rng.normal(size=(120, 6))
    for factor in (1e-200, 1e150, 1e200):
        rows = [(i, (x * factor).tolist()) for i, x in enumerate(v)] + [(200, [-0.0] * 6), (220, [0.0, float("inf")] + [0.0] * 4)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
        assert Counter(r["query_id"] for r in got) == {i: 20 for i in range(0, 120, 20)}


def test_scores_do_not_depend_on_blocks():
    rng = np.random.RandomState(13)
    v = rng.normal(size=(300, 37))
    one = ann._best({0: (np.arange(300), v)}, np.zeros(4, np.int64), np.arange(4), v[:4], 300)
    parts = {b: (np.arange(b, 300, 7), v[b::7]) for b in range(7)}
    many = ann._best(parts, np.tile(np.arange(7), 4), np.repeat(np.arange(4), 7), v[:4], 300)
    assert all((a == b).all() for a, b in zip(one, many))
    twin = np.vstack([v[:1]] * 50)
    q, i, _ = ann._best({0: (np.arange(50)[::-1].copy(), twin)}, np.zeros(1, np.int64), np.zeros(1, np.int64), v[:1], 5)
    assert i.tolist() == [0, 1, 2, 3, 4]


def test_probes_come_in_falling_success():
    rng = np.random.RandomState(8)
    pts = rng.normal(size=(200, 9))
    plan = ann.plan(5000, 8, 3.0, 1.0, pts)
    for t in range(ann.TABLES):
        slots = ann.probes(plan, t, pts[0], 0.95)
        pos = ann.positions(plan, t, pts[:1])[0]
        mass = ann._mass(1.0 / plan["w"][t], pos, 8)
        p = [np.prod([mass[j, int(s - math.floor(pos[j])) + 8] for j, s in enumerate(row)]) for row in slots]
        assert all(a >= b - 1e-12 for a, b in zip(p, p[1:])) and len({tuple(r) for r in slots.tolist()}) == len(slots) and sum(p) >= 0.9


# -- all together -------------------------------------------------------------------------------------------------


def test_pipeline_equals_plain_version(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    one = stages[0](spark, documents, sf_dir).cache()
    rules = registry.queries()["op4_line_frequency_rules"](spark, sf_dir)
    assert one.columns == documents.columns and ids(one) == ids(rules.filter("kept"))

    two = stages[1](spark, one, sf_dir).cache()
    model, kept = fm_quality.train(one, labels), []
    for r in one.collect():
        if fm_quality.probability(model, fm_quality.raw_scores(model, *fm_quality.features(pa.array([r["text"]]), (pa.array([r["n_chars"]]),))))[0] >= 0.3:
            kept.append(r["doc_id"])
    assert two.columns == documents.columns and ids(two) == sorted(kept)

    three = stages[2](spark, two, sf_dir).cache()
    classes = _plain_classes([(r["doc_id"], r["text"]) for r in two.collect()])
    assert three.columns == documents.columns and ids(three) == sorted(i for i, c in classes.items() if i == c)

    four = stages[3](spark, three, sf_dir).cache()
    copies = Counter(ids(four))
    mixed, report = mixing.mixed_report(three, mixing.learn(documents, labels))
    for r in mixed.collect():
        domain = int(np.argmax([r[f"_p{k}"] for k in range(3)]))
        more = r["_rate"] > math.floor(r["_rate"]) and r["_u"] + report["shifts"][domain] >= 1 - (r["_rate"] - math.floor(r["_rate"]))
        assert copies.get(r["doc_id"], 0) == math.floor(r["_rate"]) + more
    assert four.columns == documents.columns

    texts = [(r["doc_id"], r["text"]) for r in four.collect()]
    _check_pieces(stages[4](spark, four, sf_dir).collect(), texts)
    whole = corpus_pipeline.run(spark, sf_dir).filter("start = 0").collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in whole) == Counter((i, len(_ids(t))) for i, t in texts)


def test_registered_names():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


def test_line_rules_sql_equals_spark(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(registry.oracle_sql()["op4_line_frequency_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = registry.queries()["op4_line_frequency_rules"](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()
