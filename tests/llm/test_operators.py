"""The ten operators against brute force, round trips and held-out accuracy, and on odd tables."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from weft.llm import ann_partitions, bpe, components, jaccard_join, langid_cnn, line_spread, mixing, quality_knn, quality_rules, queries, warc_zip, wrappers

SF = "/root/testdata/sf0.001"
BPE = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white-space texts, repeated rows, a very long text, and
    columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [
        (1, "the cat sat on the mat today and then it slept", "en", "a", 1), (1, "the cat sat on the mat today and then it slept", "en", "a", 1),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "de", "b", 4), (5, "one two", None, "a", 7),
        (None, "the cat sat on the mat today and then it slept", "en", None, 1), (6, long, "en", "c", len(long)), (7, "\U0001f600 é́\x85 123", "fr", "c", 5),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("score", "size", "_words", "row", "token", "cls", "html2"):
        df = df.withColumn(c, F.lit(1))
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


CLASHES = [
    "_id", "_hash", "_text", "_all", "_drop", "_n_lines", "_draws", "_draw", "_part", "_source", "_size", "_key", "_row", "_print", "_copies", "_host", "_lines", "_template", "_payload", "_sha1", "_first",
    "id", "of", "size", "row", "draws", "draw", "part", "print", "words", "score", "scores", "cls", "rep", "token", "n_lines", "n_removed", "hash", "quality", "excerpt", "terms", "a.b", "a b", "_c", "_n", "cell", "lang_of", "component_id", "path",
]


def test_clashing_columns_come_back_unchanged(spark, documents, labels):
    """Columns with names that the operators use themselves, and a dotted one."""
    base = documents.limit(60).cache()
    extra = base.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    more = labels.select("*", *[F.lit("x").alias(c) for c in CLASHES if c != "quality"])
    for keep in (lambda d: quality_knn.keep_good(d, more), line_spread.clean_columns, jaccard_join.keep_one, mixing.mixture):
        got = keep(extra)
        rows = got.collect()
        assert got.columns == extra.columns and rows
        assert all(r[len(base.columns) + k] == f"{c}:{r.doc_id}" for r in rows for k, c in enumerate(CLASHES))
        assert sorted(tuple(r)[: len(base.columns)] for r in rows) == sorted(tuple(r) for r in keep(base).collect())
    for of in (mixing.mix, lambda d: quality_knn.classify(d, more), langid_cnn.identify, jaccard_join.join, lambda d: quality_rules.judge(d, more), line_spread.digests, lambda d: bpe.digests(d, BPE, P.PATTERN)):
        assert sorted(map(str, of(extra).drop("_row").collect())) == sorted(map(str, of(base).drop("_row").collect()))
    web = spark.read.parquet(f"{SF}/pages.parquet")
    wide = web.select("*", *[F.lit(c).alias(c) for c in CLASHES])
    for of in (wrappers.extract, warc_zip.round_trip):
        assert sorted(map(str, of(wide).collect())) == sorted(map(str, of(web).collect()))


# 1


def test_mix_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = c.sql(mixing.ORACLE)
    got = sorted(tuple(r[x] for x in rel.columns) for r in queries.op1_source_mix(spark, SF).collect())
    assert got == sorted(rel.fetchall())


def test_mix_tree_and_draws(spark, documents):
    rng = np.random.default_rng(0)
    quotas = rng.integers(0, 500, 9)
    parts = np.stack([x for _, x in mixing.split(quotas, 13, (4,))])
    assert (parts.sum(axis=0) == quotas).all() and (parts >= 0).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 4
    wanted = parts.sum(axis=1)
    again = np.stack([x for _, x in mixing.split(quotas[::-1], 13, (5,), wanted)])
    assert (again.sum(axis=0) == quotas[::-1]).all() and (again.sum(axis=1) == wanted).all()
    recipe = mixing.Recipe(shards=5, block_docs=8)
    rows = mixing.mix(documents, recipe).collect()
    assert all(sum(d.words for d in r.draws) == r.taken <= 2 * r["size"] for r in rows)
    assert {d.shard for r in rows for d in r.draws} == set(range(5))
    again = {r.doc_id: r for r in mixing.mix(documents.repartition(7), recipe).collect()}
    assert all(again[r.doc_id] == r for r in rows)
    mixed = mixing.mixture(documents)
    assert mixed.columns == documents.columns and collections.Counter(r.doc_id for r in mixed.collect()).most_common(1)[0][1] <= 2


def test_mix_is_what_the_tree_gives(spark, documents, monkeypatch):
    """Draws that the tree loses are missing from the result."""
    whole = sum(r.taken for r in mixing.mix(documents).collect())
    plain = mixing.split
    monkeypatch.setattr(mixing, "drawn_blocks", lambda quotas, shards, seed, of=mixing.drawn_blocks: of(quotas, shards, seed).filter("_block % 2 = 0"))
    assert plain is mixing.split and 0 < sum(r.taken for r in mixing.mix(documents, mixing.Recipe(block_docs=8)).collect()) < whole


def test_mix_hypergeometric_of_large_numbers():
    rng = np.random.default_rng(3)
    for good, bad, n in ((300, 700, 200), (3, 9, 7), (50, 20, 60), (0, 5, 3), (5, 0, 3)):
        got = np.array([mixing._by_ratios(rng, good, bad, n) for _ in range(4000)])
        want = rng.hypergeometric(good, bad, n, 4000)
        assert got.min() >= max(0, n - bad) and got.max() <= min(good, n) and abs(got.mean() - want.mean()) < 0.5 and abs(got.std() - want.std()) < 0.5
    x = mixing.hypergeometric(rng, 10**10, 3 * 10**10, 10**9)
    assert abs(x - 25 * 10**7) < 10**6


def test_mix_of_many_sources(spark):
    """No limit on sources: the driver's part of the tree stays 256 groups x shards."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"))
    out = mixing.mix(df, mixing.Recipe(shards=16)).agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.max(F.abs(F.col("taken") - F.col("target"))).alias("off")).first()
    assert out.n == n and out.over <= 0 and out.off <= 0.5 and abs(out.taken - 1.5 * out["size"]) < 0.05 * out["size"]  # each source is rounded


def test_mixture_of_rows_that_repeat(spark):
    rows = [(1, f"text {i % 3} of one id", "en", "a", i % 3) for i in range(30)] + [(i, f"text {i} here now", "en", "b", i) for i in range(100, 160)]
    df = spark.createDataFrame(rows, DOCS)
    recipe = mixing.Recipe(split_last=False, block_docs=8)
    first, second = ([tuple(r) for r in mixing.mixture(df.repartition(k), recipe).collect()] for k in (1, 5))
    assert sorted(first) == sorted(second) and set(first) <= set(rows)
    assert len(first) == sum(len(r.draws) for r in mixing.mix(df, recipe).collect())


def test_mix_targets(spark):
    def targets(sizes, weights):
        df = spark.createDataFrame([(f"s{i:03}", n, 1) for i, n in enumerate(sizes)], "source string, words long, n long")
        return [r.target for r in mixing.goals(df, mixing.Recipe(weights=weights)).orderBy("_rank").collect()]

    assert targets([100, 100, 100], (5, 2, 1)) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([], (5, 2, 1)) == [] and targets([0, 0], (5, 2)) == [0.0, 0.0]


def test_mix_odd(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r["size"] == len(WORDS.findall({2: "", 3: "", 4: ""}.get(r.doc_id, "") or "")) for r in rows if r.doc_id in (2, 3, 4))
    assert mixing.mix(empty(spark)).collect() == [] and mixing.mixture(empty(spark)).collect() == []


# 2


def page(body, n=3):
    return f'<!DOCTYPE html><html><head><title>T</title><script>x="</p><article>"</script></head><body><nav><a href="/">Home {n}</a></nav><div class="cookie-notice">We use cookies</div>{body}<aside>see also</aside><section id="comments"><p>first!</p></section><footer>&copy; us</footer></body></html>'


def test_html_regions_and_references():
    w = wrappers.infer([page(f"<article><h1>Title {i}</h1><p>Text {i} &amp; more</p>{'<p>extra</p>' * (i % 3)}<div class='share'>Share this</div></article>") for i in range(6)])
    assert w["main"][-1] == "article" and ")+" in w["expression"] and "#" in w["expression"]
    html = page("<article><h1>A\n &lt;b&gt;</h1><p>x <b>y</b>&nbsp;z<br>w<p>second<form><p>Your mail</p></form><div class=share>Share this</div></article>")
    assert wrappers.apply(html, w) == "A <b>\nx y z w\nsecond"
    assert wrappers.apply(html, None) == "A <b>\nx y z w\nsecond"
    assert wrappers.apply(page("<div class='story'><p>no article</p></div>"), w) == "no article"
    assert wrappers.apply(None, w) == "" and wrappers.apply("", None) == "" and wrappers.apply("a < b <p>unclosed", None) == "a < b\nunclosed"


def test_html_template_lines_go():
    pages = [page(f"<article><p>Story number {i}</p><p>Read more on our front page</p></article>") for i in range(8)]
    w = wrappers.infer(pages)
    assert [wrappers.apply(p, w) for p in pages] == [f"Story number {i}" for i in range(8)]
    same = wrappers.infer([pages[0]] * 8)  # equal pages: nothing is known to be template
    assert wrappers.apply(pages[0], same) == "Story number 0\nRead more on our front page"


def test_html_pages(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op2_html_extract(spark, SF).collect()}
    import html

    for r in p.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(x for x in want if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    rows = [(1, None, None), (2, "not a url", ""), (2, "not a url", ""), (None, "http://h/", "<p>x"), (4, "http://h/", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", F.lit("clash")).withColumn("text", F.lit(0))
    out = wrappers.extract(df).collect()
    assert len(out) == 5 and {(r.page_id, r.n_chars) for r in out} == {(1, 0), (2, 0), (None, 1), (4, 200_000)}
    assert wrappers.extract(empty(spark, "page_id long, url string, html string")).collect() == []


def test_html_deep_and_wide_pages():
    for depth in (150, 250, 20_000):
        deep = "<div>" * depth + "a<nav>menu<p>item</nav>b<p>c" + "</div>" * depth + "d"
        assert wrappers.apply(deep, None) == "a\nb\nc\nd"
        assert wrappers.apply(deep, wrappers.infer([deep, deep.replace("c", "e")])) == "a\nb\nc\nd"
    wide = "".join(f"<p>a{i}</p><h2>b{i}</h2>" for i in range(3000))
    w = wrappers.infer([wide, "<ul><li>x</ul>" + wide])
    assert "(<ul>" in w["expression"] and wrappers.apply(wide, w).count("\n") == 5999


def test_html_templates_count_all_pages(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    line = lambda k: " ".join(word() for _ in range(k))
    story = [line(12) for _ in range(12)]
    sites = {"copies": [], "mixed": [], "cover": []}
    for i in range(40):  # near copies of one article: each changes one paragraph
        changed = [line(12) if k == i % 12 else x for k, x in enumerate(story)]
        sites["copies"].append(changed)
        sites["mixed"].append([*(changed if i % 2 else [line(12), line(9)]), "Write to the editor"])
        sites["cover"].append([line(12), line(8), *(["Read more on our front page"] if i % 10 else [])])
    rows = [(k, f"http://{h}/{k}", page("<article>" + "".join(f"<p>{x}</p>" for x in p) + "</article>")) for k, (h, p) in enumerate((h, p) for h, ps in sites.items() for p in ps)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    gone = {"Write to the editor", "Read more on our front page"}
    want = ["\n".join(x for x in p if x not in gone) for ps in sites.values() for p in ps]
    assert [got[k] for k in range(len(want))] == want
    for ps in sites.values():
        w = wrappers.infer([page("<article>" + "".join(f"<p>{x}</p>" for x in p) + "</article>") for p in ps])
        assert set(w["template"]) == gone & {x for p in ps for x in p}


def test_html_regions_without_names():
    rail = lambda i: f"<div class='rail'><ul><li>Offer {i * 7}</li><li>Offer {i * 7 + 1}</li></ul></div>"
    pages = [page(f"<div id='wrap'><div id='content'><h1>Title {i}</h1><p>The long text of story number {i}</p><p>ends with {i}</p></div>{rail(i)}</div>") for i in range(6)]
    w = wrappers.infer(pages)
    assert [wrappers.apply(p, w) for p in pages] == [f"Title {i}\nThe long text of story number {i}\nends with {i}" for i in range(6)]
    beside = [page(f"<h1>Title {i}</h1><div id='content'><p>The long text of story number {i}</p></div>{rail(i)}") for i in range(6)]
    assert wrappers.apply(beside[0], wrappers.infer(beside)).startswith("Title 0\nThe long")
    posts = [page(f"<article><p>one {i}</p></article><article><p>two {i}, longer</p></article>") for i in range(6)]
    assert wrappers.apply(posts[3], wrappers.infer(posts)) == wrappers.apply(posts[3], None) == "one 3\ntwo 3, longer"


def test_html_class_words_delete_no_article():
    body = lambda i: f"<h1>Title {i}</h1><p>The text of story {i}, {'long enough ' * 20}</p><p class='related'>and related words {i}</p>"
    want = lambda i: f"Title {i}\nThe text of story {i}, {'long enough ' * 20}".strip() + f"\nand related words {i}"
    for whole in (
        lambda i: f"<body class='single has-sidebar'><article>{body(i)}</article></body>",
        lambda i: f"<body class='no-comments'><div id='content'>{body(i)}</div></body>",
        lambda i: f"<body><article class='post category-social'>{body(i)}</article><footer>f</footer></body>",
        lambda i: f"<body><div class='with-menu'><article>{body(i)}</article></div></body>",
        lambda i: f"<body><div class='sidebar'><main>{body(i)}</main></div></body>",
        lambda i: f"<body><div class='ad widget'>{body(i)}</div><div class='ad'>Buy</div></body>",
    ):
        pages = [f"<html>{whole(i)}</html>" for i in range(6)]
        w = wrappers.infer(pages)
        assert [wrappers.apply(p, w) for p in pages] == [want(i) for i in range(6)] == [wrappers.apply(p, None) for p in pages]
    comments = "<article><p>Short text</p><section id='comments'><p>" + "a reader writes " * 50 + "</p></section></article>"
    assert wrappers.apply(comments, None) == "Short text"


def test_html_shared_headings_and_sibling_articles_stay():
    pages = [f"<body><article class='a{'bc'[i % 2]}'><h2>Ingredients</h2><p>item {i} of this</p><h2>Method</h2><p>stir {i} times</p><p>Print this page</p></article><article class='x{i}'><p>second {i}</p></article></body>" for i in range(8)]
    w = wrappers.infer(pages)
    assert w["template"] == ["Print this page"]
    assert [wrappers.apply(p, w) for p in pages] == [f"Ingredients\nitem {i} of this\nMethod\nstir {i} times\nsecond {i}" for i in range(8)]


def test_html_wrapper_decides_without_any_name(spark):
    """Bare divs, in changing numbers: only the alignment of a host's pages tells the story from the
    rest. Varied templates, by Spark, against what was put in."""
    rnd = random.Random(9)
    text = lambda k: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    top = "<div><ul><li>Home</li><li>News</li></ul></div>"
    rail = lambda: "<div><table><tr><td>" + text(4) + "</td></tr></table></div>"
    rows, want = [], {}
    for host in range(3):
        for i in range(12):
            story = [text(5), *(text(30) for _ in range(rnd.randint(1, 4)))]
            inner = f"<div><h1>{story[0]}</h1>" + "".join(f"<p>{x}</p>" for x in story[1:]) + "</div>"
            parts = {0: top + inner + rail(), 1: top + (f"<div><form>{text(2)}</form></div>" if i % 3 else "") + inner + rail() + "<div><ul><li>End</li></ul></div>", 2: "<section>" + top + inner + "</section>" + rail()}[host]
            rows.append((100 * host + i, f"http://h{host}/{i}", f"<html><body>{parts}</body></html>"))
            want[100 * host + i] = "\n".join(story)
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and all(wrappers.apply(html, None) != want[k] for k, _, html in rows)


# 3


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    held = queries.op3_quality_knn(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.96 and np.mean([r.predicted for r in held if r.quality == 1]) > 0.98


def test_quality_vote_is_exact(documents):
    texts = [r.text for r in documents.limit(60).collect()]
    space = quality_knn.learn([quality_knn.features(t) for t in texts[:40]], [i % 2 for i in range(40)], dim=8)
    got = quality_knn.vote(space, texts, k=5, block=7)
    for t, s in zip(texts, got):
        v = (quality_knn.features(t) * space.idf) @ space.axes
        cos = space.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos, kind="stable")[:5]
        w = np.maximum(cos[near].astype(float), 1e-6) ** 4
        assert s == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=1e-3)


def test_scores_do_not_depend_on_the_batch(documents):
    """One text among others, alone, and in blocks of any size: the same score bit for bit."""
    texts = [r.text for r in documents.collect()]
    space = quality_knn.learn([quality_knn.features(t) for t in texts[:120]], [i % 2 for i in range(120)])
    whole = quality_knn.vote(space, texts)
    for size in (1, 3, 50):
        assert all((quality_knn.vote(space, texts[a : a + size], block=7) == whole[a : a + size]).all() for a in range(0, len(texts), size))
    net = langid_cnn.train([r.text.lower().encode() for r in documents.limit(80).collect()], [r.lang for r in documents.limit(80).collect()], steps=5)
    p = langid_cnn.Predictor(net)
    whole = p(texts)
    for size in (1, 3, 50):
        for a in range(0, len(texts), size):
            langs, scores = p(texts[a : a + size])
            assert langs == whole[0][a : a + size] and scores == whole[1][a : a + size]


def test_fits_are_bounded_where_ids_repeat(spark):
    rows = [(i % 3, f"text number {i} of {'many ' * (i % 5)}words", "en" if i % 2 else "de", "a", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 4, "doc_id long, quality int")
    assert len(quality_knn.fit(df, labels, most=50, held=4).vectors) <= 50
    found = langid_cnn.training_rows(df, 20, held=9).collect()
    assert collections.Counter(r.lang for r in found) == {"en": 20, "de": 20}
    long = langid_cnn.excerpt("ab" * 100_000, 8)
    assert len(long) == 8 * langid_cnn.WINDOW and langid_cnn.excerpt("Ab", 8) == b"ab"
    assert (quality_knn.unpack(quality_knn.pack(f := quality_knn.features("Some text, 12 words!"))) == f).all()


def test_quality_odd(spark, odd, labels):
    rows = quality_knn.classify(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {False}
    none = quality_knn.classify(odd, empty(spark, "doc_id long, quality int, toxic int")).collect()
    assert {r.score for r in none} == {0.5} and quality_knn.classify(empty(spark), labels).collect() == []


# 4


def nearest(rows, every, top):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        s = (x * x[a]).sum(axis=1)
        s[ids == ids[a]] = -np.inf
        out[int(ids[a])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:top] if s[j] > -np.inf]
    return out


def test_ann_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = collections.defaultdict(list)
    for r in queries.op4_ann_partitions(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = nearest([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_ann_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)] + [(i, rng.normal(size=3).tolist()) for i in range(100, 160)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 0.0]), (260, [float("nan"), 1.0, 0.0]), (280, [float("inf"), 0.0, 0.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("_part", F.lit(0))
    out = collections.defaultdict(list)
    for r in ann_partitions.search(df, top=5, parts=1, chunk=16).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.vec_id)
    want = nearest(rows, 20, 5)
    assert out == want  # one part: exact, over several chunks
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann_partitions.search(few).collect()] == [(0, 1, 1, 4.0)]
    assert ann_partitions.search(empty(spark, "vec_id long, embedding array<float>")).collect() == []


def test_ann_repeated_ids_and_small_parts(spark):
    """Every query gets 20 different ids, whatever repeats and however small the visited parts are."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(20, rng.normal(size=6).tolist()) for _ in range(40)] + [(41, rng.normal(size=6).tolist()) for _ in range(40)] + [(60, rows[60][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann_partitions.search(df, parts=16, recall=0.05, chunk=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    for q, found in got.items():
        ids = [i for _, i, _ in found]
        assert [k for k, _, _ in found] == list(range(1, 21)) and len(set(ids)) == 20 and q not in ids
        assert found == sorted(found, key=lambda x: (-x[2], x[1]))


def test_ann_recall_beyond_the_sample(spark):
    """Rows that the network has not seen: 2,000 vectors by a sample of 512, even and clustered."""
    even = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    clustered = [(i, (centres[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(4000)]
    for rows in (even, clustered):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = collections.defaultdict(set)
        for r in ann_partitions.search(df, sample=512).collect():
            got[r.query_id].add(r.vec_id)
        want = nearest(rows, 20, 20)
        assert np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9
    x = np.array([v for _, v in clustered])
    m = ann_partitions.fit(x[:1024], 32, 20, 0.94)
    sizes = np.bincount(m.scores(x).argmax(axis=1), minlength=32)
    assert np.mean([sizes[v].sum() for v in m.visits(x[::20], sizes, 21)]) < 0.35 * len(x)  # the classifier saves work where there is something to learn


def test_ann_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(512, 8))
    part = ann_partitions.balanced_parts(ann_partitions.neighbours(x, x, 8, np.arange(512)), 8, 0)
    assert np.bincount(part, minlength=8).max() <= math.ceil(64 * 1.1) and np.bincount(part, minlength=8).min() >= 57


# 5


def test_bpe_equals_tiktoken(documents):
    import tiktoken

    ranks = bpe.load_ranks(BPE)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(BPE, P.PATTERN)
    rnd = random.Random(3)
    texts = [r.text for r in documents.collect()] + ["", "a" * 30_000, "ab" * 5000, " " * 3001, "!" * 999]
    texts += ["".join(chr(rnd.choice([32, 9, 10, 13, 0x85, 0xA0, 0x1C, 0x2028, 97, 65, 48, 0x4E2D, 0x1F600, 39, 115, 0x301, 0xB2])) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t in texts:
        ids = c.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_digests(spark, odd):
    rows = bpe.digests(odd, BPE, P.PATTERN).collect()
    by = {r.doc_id: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9 and (by[2].n_tokens, by[2].ids_sha256, by[2].decoded_sha256) == (0, nothing, nothing)
    assert by[7].decoded_sha256 == hashlib.sha256("\U0001f600 é́\x85 123".encode()).hexdigest()
    assert bpe.digests(empty(spark), BPE, P.PATTERN).collect() == []
    plain = odd.select(bpe.decode(bpe.encode(F.col("text"), BPE, P.PATTERN), BPE, P.PATTERN).cast("string").alias("t")).collect()
    assert {r.t for r in plain} == {r.text or "" for r in odd.collect()}


# 6


def test_langid(spark):
    sf = "/root/testdata/sf0.1"
    held = queries.op6_langid_cnn(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_langid_tables_equal_the_convolution(documents):
    rows = documents.limit(80).collect()
    net = langid_cnn.train([r.text.lower().encode() for r in rows], [r.lang for r in rows], steps=5)
    x = langid_cnn.windows(rows[0].text.lower().encode(), net.classes)[0]
    e = net.emb[x]
    pooled = []
    for s, w, b in zip(langid_cnn.WIDTHS, net.filters, net.bias):
        cols = np.concatenate([e[:, i : langid_cnn.WINDOW - s + 1 + i] for i in range(s)], axis=2)
        pooled.append((cols @ w + b).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.out_w + net.out_b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(langid_cnn.Predictor(net).probabilities(x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_langid_query_equals_a_plain_network(spark, documents):
    """The registered query against windows, convolutions and means written out."""
    net = langid_cnn.fit(documents)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_langid_cnn(spark, SF).collect()}
    for r in documents.collect():
        data = r.text.lower().encode()
        total, size = np.zeros(len(net.langs)), 0
        for a in range(0, len(data), langid_cnn.WINDOW):
            w = data[a : a + langid_cnn.WINDOW]
            e = net.emb[np.pad(net.classes[np.frombuffer(w, np.uint8)], (0, langid_cnn.WINDOW - len(w)))]
            pooled = [(np.concatenate([e[i : langid_cnn.WINDOW - s + 1 + i] for i in range(s)], axis=1) @ f + b).max(axis=0) for s, f, b in zip(langid_cnn.WIDTHS, net.filters, net.bias)]
            z = np.maximum(np.concatenate(pooled), 0) @ net.out_w + net.out_b
            total += len(w) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            size += len(w)
        order = np.argsort(total)
        if total[order[-1]] - total[order[-2]] > 1e-3 * size:
            assert got[r.doc_id][0] == net.langs[order[-1]] and got[r.doc_id][1] == pytest.approx(total.max() / size, abs=1e-3)


def test_langid_odd(spark, odd):
    by = {r.doc_id: r for r in langid_cnn.identify(odd).collect()}
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in by.values()) and by[6].lang_pred in ("en", "de", "fr")
    assert langid_cnn.identify(empty(spark)).collect() == []
    assert {r.lang_pred for r in langid_cnn.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 7


def linked(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORDS.findall(t or "")]
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_join_equals_brute_force(spark, documents, n, percent):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rnd = random.Random(n)
    base = [f"w{rnd.randrange(50)}" for _ in range(60)]
    for i in range(60):  # near copies with a few edits each, in chains
        base = list(base)
        base[rnd.randrange(60)] = f"e{rnd.randrange(9)}"
        rows.append((10_000 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, n, percent).collect()} == linked(rows, n, percent)


def test_join_odd(spark, odd):
    rows = jaccard_join.join(odd, 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows) == sorted([("1", 9, 1), ("1", 9, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("5", 1, 5), ("None", 9, 1), ("6", rows and next(r.n_shingles for r in rows if r.doc_id == 6), 6), ("7", 1, 7)], key=lambda x: x)
    assert jaccard_join.join(empty(spark)).collect() == []
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7"]


def test_join_without_ids(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(None, " ".join(words))] * 3 + [(None, near), (None, "all alone in this world of texts"), (5, "one two three four five six"), (5, "seven eight nine ten eleven twelve"), (7, "one two three four five six"), (8, " "), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id, r.n_links) for r in jaccard_join.join(df, 3, 90).collect()), key=str)
    assert got == sorted([("None", None, 3)] * 4 + [("None", None, 0), ("5", 5, 1), ("5", 5, 0), ("7", 5, 1), ("8", 8, 0), ("8", 8, 0)], key=str)
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(df, 3, 90).collect()]
    assert len(kept) == 6 and sum(t in (" ".join(words), near) for _, t in kept) == 1 and (7, rows[5][1]) not in kept and (5, rows[6][1]) in kept


def test_join_of_long_posting_lists(spark, monkeypatch):
    """Lists that are ranked in pieces lose no link, nor do sets whose first 64 bits agree."""
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    plain = jaccard_join._class
    monkeypatch.setattr(jaccard_join, "_class", lambda s: (plain(s)[0] % 3, plain(s)[1]))
    rnd, rows = random.Random(5), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(40)]
        for i in range(25):
            base = list(base)
            base[rnd.randrange(40)] = f"e{rnd.randrange(5)}"
            rows.append((100 * g + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, 3, 80, count_links=False).collect()} == linked(rows, 3, 80)


def test_join_counts_all_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)  # several blocks a component
    rnd = random.Random(1)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(60):
        base = list(base)
        base[rnd.randrange(60)] = f"e{rnd.randrange(9)}"
        rows += [(i, " ".join(base))] + [(100 + i, " ".join(base))] * (i % 3 == 0)
    rows += [(900, "alone in the world of texts"), (901, None), (None, " ".join(base))]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in ((t or "").split() for _, t in rows)]
    want = [(i, sum(j != k and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets))) for k, ((i, _), x) in enumerate(zip(rows, sets))]
    got = [(r.doc_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(n for _, n in want) > 5


def test_choice_of_prefix():
    assert jaccard_join.choose(np.array([1] * 40), 40, 36, 4, 8.0) == 1
    assert jaccard_join.choose(np.array([1000] * 40), 40, 36, 4, 8.0) > 1
    assert jaccard_join.choose(np.array([5]), 1, 1, 4, 8.0) == 1


def test_jaccard_count_rows_add_up_beside_one_sum(spark):
    """Adding the count rows of many partitions holds one sum, not a wider copy of every row."""
    cells = np.full(jaccard_join._ROW, 2**30, np.int32)
    group = pd.DataFrame({"row": [3] * 300, "cells": [cells] * 300})
    tracemalloc.start()
    out = jaccard_join.added(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * cells.nbytes
    assert out["row"].tolist() == [3] and (out["cells"][0] == 2**31 - 1).all()
    texts = [f"a b c d{i % 7}" for i in range(90)]
    want = np.zeros(jaccard_join.SLOTS, np.int64)
    for t in texts:
        for h in jaccard_join.shingle_hashes(t.encode().split(), 3):
            want[int(h) % jaccard_join.SLOTS] += 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    assert (jaccard_join.frequencies(df, 3) == want).all()


def test_components_of_a_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.v: r.root for r in components.components(path).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


# 8


def test_warc_whole_table(spark):
    """Every page by plain Python: payload, digest, and which page is the response."""
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(10_000 + k, p) for k, (_, p) in enumerate(pages[:20])]
    df = spark.createDataFrame([(i, f"http://h/{i}", p.decode()) for i, p in pages], "page_id long, url string, html string")
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    for got in (warc_zip.round_trip(df), queries.op8_warc_zip(spark, SF)):
        got = {r.page_id: tuple(r)[1:] for r in got.collect()}
        mine = [x for x in pages if x[0] in got]
        assert len(got) == len(mine) and all(got[i] == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in mine)


def test_warc_headers_and_compressed_members(spark, tmp_path):
    for url in (" http://a/ \t", "%20", "   ", "a\r\n b%0D", ""):
        fields, block = warc_zip.parse(warc_zip.record("response", 1, url, b"x\r\n\r\ny", "D", 7, None))
        assert warc_zip.unescaped(fields["warc-target-uri"]) == url and block.endswith(b"x\r\n\r\ny")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(warc_zip.INDEX, "{}" * 100, compress_type=zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other", "x")
    for name in "ab":
        with pytest.raises(ValueError, match="compressed|no member"):
            list(warc_zip.records(str(tmp_path / f"{name}.zip")))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://a/%0A\n", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 100_000), (None, "u", "z"), (1, "http://a/", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_sha1", F.lit("clash")).withColumn("path", F.lit(1))
    archives = warc_zip.write(df, f"file://{tmp_path}", most_bytes=300)
    got = sorted((str(r.page_id), r.url, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in warc_zip.read(archives).collect())
    assert got == sorted([("1", "http://a/", 1, "response", None, "x"), ("1", "http://a/", 1, "response", None, "x"), ("2", "http://a/%0A\n", 1, "revisit", 1, None), ("3", None, 0, "response", None, ""), ("4", "u", 0, "revisit", 3, None), ("5", "u", 200_000, "response", None, "é" * 100_000), ("None", "u", 1, "response", None, "z")], key=str)
    digests = {r.page_id: r.payload_digest for r in warc_zip.round_trip(df).collect()}
    assert digests[2] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc_zip.round_trip(empty(spark, "page_id long, url string, html string")).collect() == []


def test_zip_directories(tmp_path):
    plain = tmp_path / "a.zip"
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 not the end"
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.writestr("é", b"abc")
        z.writestr("packed", b"abc" * 100, compress_type=zipfile.ZIP_DEFLATED)
    with open(plain, "rb") as f:
        at = warc_zip.members(f)
        assert set(at) == {"big", "é", "packed"} and at["packed"] is None and warc_zip.read_range(f, *at["big"]) == b"0123456789" and warc_zip.read_range(f, *at["é"]) == b"abc"
    # a ZIP64 end of central directory
    old, zipfile.ZIP_FILECOUNT_LIMIT = zipfile.ZIP_FILECOUNT_LIMIT, 1
    try:
        with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
            for i in range(3):
                z.writestr(f"m{i}", bytes([i]) * 5)
    finally:
        zipfile.ZIP_FILECOUNT_LIMIT = old
    with open(tmp_path / "b.zip", "rb") as f:
        at = warc_zip.members(f)
        assert [warc_zip.read_range(f, *at[f"m{i}"]) for i in range(3)] == [bytes([i]) * 5 for i in range(3)]
    (tmp_path / "c.zip").write_bytes(plain.read_bytes()[:40])
    with open(tmp_path / "c.zip", "rb") as f, pytest.raises(ValueError):
        warc_zip.members(f)


# 9


def counted(t):
    w = WORDS.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, documents, odd, labels):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = [(9001, "a b c d e f a b c d e g a b c d e"), (9002, "x " * 50), (9003, "l1 a\nl1 a\n\n \nl1 a\n#*$%&|<>")]
    rows = spark.createDataFrame(extra, "doc_id long, text string").withColumn("lang", F.lit("en"))
    for df in (documents, odd, rows):
        text = [(str(r.doc_id), r.text) for r in df.collect()]
        want = sorted((i, *counted(t)) for i, t in text)
        got = quality_rules.judge(df, labels).collect()
        assert sorted((str(r.doc_id), *[r[c] for c in columns]) for r in got) == want
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(empty(spark), labels).collect() == []


def test_rule_bound_is_exact(spark):
    cases = [(k, n, a, d) for n in (1, 30, 500, 3000) for k in (0, 1, 3, 20) if k <= n for a in (0.01, 0.1) for d in (0.05, 1e-4)]
    for k, n, a, d in cases:
        cdf = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.passes(F.lit(k).cast("long"), F.lit(n).cast("long"), a, F.lit(d)).alias("p")).first().p
        assert got == (k < n * a and cdf <= d), (k, n, a, d)


def test_rule_cutoffs_keep_the_good(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 5000}" for j in range(40)) + (" #" * 40 if i % 10 == 0 else ""), "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(3000)], "doc_id long, quality int")
    out = quality_rules.judge(df, labels).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r.quality: r.k for r in out}
    assert kept.get(1, 1) >= 0.97 and kept.get(0, 0) == 0
    none = quality_rules.judge(df, labels.limit(0)).filter("not base_failed and not kept")
    assert none.count() == 0


def test_rule_levels_equal_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    counted = quality_rules.counts(d).withColumn("_worst", quality_rules.worst()).join(labels, "doc_id").select("_stratum", "base_failed", "_worst", "quality").toPandas()
    rows = counted[~counted.base_failed]
    names = sorted(rows._stratum.unique())
    want = {}
    for s in names:
        worst, good = rows[rows._stratum == s]._worst.to_numpy(), (rows[rows._stratum == s].quality == 1).to_numpy()
        best = None
        for at in reversed(range(quality_rules.LEVELS)):
            n, k = int(good.sum()), int((good & (worst > at)).sum())
            cdf = sum(math.comb(n, i) * 0.03**i * 0.97 ** (n - i) for i in range(k + 1))
            if k >= n * 0.03 or cdf > 0.05 / len(names):
                break
            gain = (~good & (worst > at)).sum() / max(1, (~good).sum()) - k / n
            if best is None or gain > best[0]:
                best = gain, at
        if best:
            want[s] = best[1]
    out = quality_rules.judge(d, labels).join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").filter("not base_failed").select("lang", "quality", "kept").toPandas()
    keeps = {(s, bool(q)): x.kept.mean() for (s, q), x in out.groupby(["lang", "quality"])}
    assert set(want) == set(names)
    for s in names:
        of = rows[rows._stratum == s]
        for q in (0, 1):
            assert keeps[s, bool(q)] == (of[of.quality == q]._worst <= want[s]).mean()
        assert keeps[s, False] <= 0.05 and keeps[s, True] >= 0.97


def test_rules_with_odd_labels(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7), (1, 1), (1, 0)], "doc_id long, quality int").withColumn("_good", F.lit("clash"))
    want = sorted(str((r.doc_id, r.base_failed)) for r in quality_rules.judge(odd, labels.limit(0)).collect())
    assert sorted(str((r.doc_id, not r.kept)) for r in quality_rules.judge(odd, labels).collect()) == want


# 10


def test_lines_equal_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = c.sql(line_spread.ORACLE)
    got = sorted((tuple(r[x] for x in rel.columns) for r in queries.op10_line_spread(spark, SF).collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str)


def test_lines_near_the_threshold(spark, odd):
    rows = [(100 * s + k, f"on {s + 1} sites only\nown line {s} {k}\n  on all the sites \n\nok", "en", f"s{k}", 0) for s in range(12) for k in range(s + 1)]
    rows = [(*r[:4], len(r[1])) for r in rows]
    out = {r.doc_id: r for r in line_spread.clean_columns(spark.createDataFrame(rows, DOCS), min_sites=5).collect()}
    for s in range(12):
        for k in range(s + 1):
            lines = out[100 * s + k].text.split("\n")
            assert (f"on {s + 1} sites only" in lines) == (s + 1 < 5 or k == 0)
            assert ("  on all the sites " in lines) == (s == k == 0) and lines[-1] == "ok" and f"own line {s} {k}" in lines
            assert out[100 * s + k].n_chars == len(out[100 * s + k].text)
    cleaned = line_spread.clean_columns(odd, min_sites=2)
    assert cleaned.columns == odd.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[2] is None and texts[3] == "" and texts[1].startswith("the cat") and texts[None] == ""
    assert line_spread.clean_columns(empty(spark)).collect() == []
