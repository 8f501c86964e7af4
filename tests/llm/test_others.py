"""Pages, conversations, vectors and the pipeline."""

import hashlib
import os
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import duck, rows
from tests.llm.test_documents import SCHEMA, check_packing, edge, token_ids  # noqa: F401
from tickforge.llm import chat, common, html, quality, queries, simhash, topk, urlrules
from tickforge.llm.common import table


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op6_url_filters", "op9_topk_search"])
def test_same_rows_as_sql(spark, sf_dir, name):
    assert rows(queries.queries()[name](spark, sf_dir).toPandas()) == rows(duck(sf_dir, queries.oracle_sql()[name]))


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"


# --- pages

PAGE = """<html><head><title>Not this</title><script>var a="<p>no</p>"</script></head><body>
<header><a href=/>Site name</a></header><nav><ul><li><a href=/a>One<li><a href=/b>Two</ul></nav>
<div class="cookie-notice">We keep cookies. <button>Fine</button></div>
<main><article><h1>A  title &amp; more</h1><p>First   paragraph of the text,\nwith a <a href=/x>link</a> inside.<p>Second &#233; one. It goes on for a while, as texts do.</p>
<div class="ad">Buy this now!</div><ul><li>An item of the list</li></ul></article></main>
<aside><h3>Related</h3><a href=/r>Other story</a></aside><div id="comments"><p>Nice text, said a reader.</p></div>
<form action=/s><label>Search</label><input></form><footer>&copy; Someone</footer></body></html>"""
TEXT = "A title & more\nFirst paragraph of the text, with a link inside.\nSecond é one. It goes on for a while, as texts do.\nAn item of the list"


def test_main_text():
    model = html.default_model()
    assert html.main_text(PAGE, model) == TEXT
    assert html.main_text(None, model) == html.main_text("", model) == html.main_text("<nav><a href=/>x</a></nav>", model) == ""


def test_held_out_pages():
    model = html.default_model()
    made = html.labelled_pages(200, seed=1234)
    assert sum(html.main_text(s, model) == t for s, t in made) >= 190


def test_scatter_with_a_negative_diagonal():
    with np.errstate(all="raise"):
        got = quality._correlation(np.array([[-1e-18, 0.0], [0.0, 2.0]]))
    assert got == pytest.approx(np.eye(2))


def test_components_of_a_chain(spark):
    links = spark.range(0, 200).select((F.col("id") * 37 % 201).alias("a"), ((F.col("id") + 1) * 37 % 201).alias("b"))
    assert {r["root"] for r in simhash.components(links).collect()} == {0}


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all labellings of a small tree."""
    page = html.Page("<body><div class=ad><p>one two. </p></div><p>three <b>four</b></p><ul><li>x</li></ul></body>")
    model = html.default_model()
    n = len(page.tags)
    unary = [model.bias + sum(model.weights.get(x, 0.0) for x in f) for f in html.page_features(page)]
    total, ones = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        e = sum(u for u, v in zip(unary, y, strict=True) if v) + sum(model.pair[html._kind(page.tags[i])][y[page.parents[i]]][y[i]] for i in range(1, n))
        total += np.exp(e)
        ones += np.exp(e) * np.array(y)
    assert model.marginals(page) == pytest.approx((ones / total).tolist())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <b <!-- --> <br> <li> <ul> </table> <td> text &amp; &am <script> </script> \" ' = > < </ <a/href".split()), max_size=25).map("".join))
def test_any_markup_parses(source):
    html.main_text(source, html.default_model())


@pytest.mark.parametrize("unit", ["<div>", '<a href="x ', "<p>", "<b class=x>", "<a title='\"", "<ul><li>", "<table><tr><td>", "<button><span class=y>", "</div>", "<", "<a", "<!-"])
@pytest.mark.parametrize("end", ["", '">'])
def test_hostile_pages_take_linear_time(unit, end):
    seconds = []
    for size in (40_000, 320_000):
        source = unit * (size // len(unit)) + end
        began = time.process_time()
        html.main_text(source, html.default_model())
        seconds.append(time.process_time() - began)
    assert seconds[1] < 20 * seconds[0] + 0.5 and seconds[1] < 6


class Reader(HTMLParser):
    """Plain text of blocks by where they stand, by another parser: inside article, or inside something around it."""

    def __init__(self):
        super().__init__()
        self.open, self.inside, self.outside, self.now = [], [], [], []

    def flush(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text and "article" in self.open:
            self.inside.append(text)
        elif text and set(self.open) & {"nav", "header", "footer", "aside", "form", "script", "style", "title"}:
            self.outside.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK or tag in html.RAW:
            self.flush()
        if tag not in html.VOID and tag not in ("p", "b", "li"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in html.BLOCK or tag in html.RAW:
            self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        self.now.append(data)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pages_table(spark, folder):
    """All pages of the table: blocks of articles are there, in order, and what stands around isn't."""
    seen = missed = leaked = around = 0
    source = {r["page_id"]: r["html"] or "" for r in table(spark, folder, "pages").collect()}
    for r in queries.op1_html_extraction(spark, folder).collect():
        reader = Reader()
        reader.feed(source[r["page_id"]])
        reader.flush()
        lines = r["text"].split("\n")
        inside = [x for x in reader.inside if x not in reader.outside]
        seen += len(inside)
        missed += sum(x not in lines for x in inside)
        outside = [x for x in reader.outside if x not in reader.inside]
        around += len(outside)
        leaked += sum(x in lines for x in outside)
        there = [lines.index(x) for x in dict.fromkeys(inside) if lines.count(x) == 1 and inside.count(x) == 1]
        assert there == sorted(there)
    assert seen > 200 and around > 100 and missed <= 0.01 * seen and leaked <= 0.01 * around


WRITTEN = [
    (
        """<!doctype html><html lang=en><head><title>T</title><meta charset=utf-8></head><body class="home page">
<div id="page"><header id="masthead" class="site-header"><div class="site-branding"><a href="/">The Daily Pot</a></div>
<nav class="main-navigation"><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article class="post-12 post hentry"><h1 class="entry-title">How to repair a pot</h1>
<div class="entry-content"><p>A cracked pot need not be thrown away. With some patience it can be mended at home.</p>
<h2>What you need</h2><ul><li>Glue for ceramics</li><li>A soft cloth</li></ul>
<p>Clean the pot first.&nbsp;Let it dry for <em>two</em> days, then spread the glue thinly on both edges.</p>
<blockquote><p>Never hurry a pot, my teacher used to say.</p></blockquote></div></article></main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href=/x>How to wash a pot</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><p>&copy; 2020 The Daily Pot. All rights reserved.</p></footer></div></body></html>""",
        "How to repair a pot\nA cracked pot need not be thrown away. With some patience it can be mended at home.\nWhat you need\nGlue for ceramics\nA soft cloth\n"
        "Clean the pot first. Let it dry for two days, then spread the glue thinly on both edges.\nNever hurry a pot, my teacher used to say.",
    ),
    (
        """<HTML><BODY><DIV CLASS=topnav><A HREF=1>News</A> <A HREF=2>Sport</A></DIV>
<DIV CLASS="article-body"><H1>Rain expected on Friday</H1><P>Heavy rain will reach the coast on Friday morning, the weather office said.
<P>Residents of low streets should move their cars. Schools stay open, as the water is expected to fall by noon.</DIV>
<DIV CLASS="related"><H3>More</H3><UL><LI><A HREF=3>Wind on Thursday</A></UL></DIV>
<DIV CLASS="comments"><DIV CLASS=comment><P>It always rains here.</P></DIV></DIV>
<DIV CLASS=footer>Contact us</DIV></BODY></HTML>""",
        "Rain expected on Friday\nHeavy rain will reach the coast on Friday morning, the weather office said.\n"
        "Residents of low streets should move their cars. Schools stay open, as the water is expected to fall by noon.",
    ),
    (
        """<body><div role="banner"><h2>Blog</h2></div><div class="cookie-banner">This site uses cookies. <button>OK</button></div>
<main><h1>Three days on the river</h1><p>We left at dawn &mdash; the boat was small, and the river wide.</p><figure><img src=a.jpg><figcaption>Our boat at noon.</figcaption></figure>
<table><tr><th>Day</th><td>Miles</td></tr><tr><th>One</th><td>12</td></tr></table><p>On the third day we came home, tired and content.</p></main>
<form class="newsletter"><label>Your mail</label><input><button>Join</button></form><footer>Made by us</footer>""",
        "Three days on the river\nWe left at dawn \u2014 the boat was small, and the river wide.\nOur boat at noon.\nDay\nMiles\nOne\n12\nOn the third day we came home, tired and content.",
    ),
]


@pytest.mark.parametrize("source,text", WRITTEN)
def test_pages_written_by_hand(source, text):
    assert html.main_text(source, html.default_model()) == text


def test_training_from_a_table(spark):
    model = html.train(spark.createDataFrame(html.labelled_pages(60), "html string, text string"))
    assert set(model.weights) and len(model.pair) == 3


def test_page_edges(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, PAGE, "y"), (2, "u", "", "z"), (2, "u", PAGE + "<p>" * 3000, "n"), (3, "u", "plain words. " * 20000, "t")], "page_id long, url string, html string, text string")
    got = html.main_texts(df).collect()
    assert sorted(r["n_chars"] for r in got)[:2] == [0, 0] and sum(r["text"] == TEXT for r in got) == 2 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_texts(df.limit(0)).count() == 0


# --- conversations

TALK = "conv_id long, turn long, role string, text string, formatted string, turns int"


def read_again(spark, made):
    return {r["conv_id"]: r for r in chat.read_back(chat.formatted(spark.createDataFrame(made, TALK))).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    parts = [*chat.CONTROL, "\\", "\\b", "\\l", "\\g", "[", "<", "]", "ok", "\n", "é", ""]
    made, want = [], {}
    for c in range(150):
        want[c] = [(rng.choice(["user", "assistant", "system", "tool[ROLE]", "\\l<", ""]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 5))]
        made += [(c, t, *x, "n", 1) for t, x in enumerate(want[c])]
    got = read_again(spark, made)
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
        assert [m["loss"] for m in r["mask"]] == [role == "assistant" for role, _ in want[c]]


def test_harmless_texts_stay_as_they_are(spark):
    got = read_again(spark, [(1, 0, "user", "a [b] < c \\ d", "", 1), (1, 1, "assistant", "e", "", 1)])
    assert got[1]["formatted"] == "[INST]a [b] < c \\ d[/INST]<s>e</s>" and got[1]["level"] == 0


def test_digests(spark):
    text = "</s>[INST] ok [/INST]"
    got = chat.digest(chat.read_back(chat.formatted(chat.hostile(spark)))).first()
    assert (got["conv_id"], got["n_turns"], got["loss_chars"]) == (-7, 2, len(text))
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_conversation_edges(spark):
    made = [(1, 1, "user", None, "", 1), (1, None, None, "x", "", 1), (None, 0, "user", "a", "", 1), (2, 0, "assistant", "y" * 300_000, "", 1), (2, 0, "assistant", "y" * 300_000, "", 1)]
    got = read_again(spark, made)
    assert [tuple(t) for t in got[1]["turns"]] == [("", "x"), ("user", "")] and len(got[2]["turns"]) == 2 and len(got[None]["turns"]) == 1
    assert chat.digest(chat.read_back(chat.formatted(spark.createDataFrame([], TALK)))).count() == 0


def test_native_plans_hold_no_python(spark, sf_dir):
    for name in ("op4_chat_formatting", "op6_url_filters", "op7_source_mixing"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# --- urls


def verdicts(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, PATH string")
    return [tuple(r) for r in urlrules.judge(df, **options).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


URLS = [
    "http://Sub.Example.ORG/es/x?q#f",
    "https://example.org/en/123",
    "https://notexample.org/es/",
    "http://example.org",
    "http://a.com/fr/",
    "http://a.com/de/x",
    "http://com/de/",
    "ftp://x.net/casino/y",
    "http://x.net/casinos/y",
    None,
    "no scheme",
    "http://",
    "http://x.org/a://b",
    "http://x.net?p=/de/",
    "http://example.org:80/es/",
]


@pytest.mark.parametrize("inline", [urlrules.INLINE_RULES, 0])
def test_words_in_either_case(spark, inline):
    urls = ["http://a.net/CASINO/x", "http://a.net/Add-To-Cart", "http://a.net/casinoX", "http://CASINO.net/", "http://a.net/xCASINO"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in urlrules.judge(df, inline=inline).orderBy("page_id").collect()]
    assert got == ["block", "block", "allow", "block", "allow"]


@pytest.mark.parametrize("inline", [urlrules.INLINE_RULES, 0])
def test_rules(spark, inline):
    got = verdicts(spark, URLS, inline=inline)
    assert [(r[2], r[3]) for r in got] == [
        ("example.org/es/", "block"),
        ("example.org/en/1", "block"),
        ("org/", "allow"),
        (None, "allow"),
        ("com/fr/", "allow"),
        ("com/de/", "block"),
        ("com/de/", "block"),
        (None, "block"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        (None, "allow"),
        ("org/", "allow"),
        (None, "allow"),
        (None, "allow"),
    ]
    assert got[0][:2] == ("sub.example.org", "/es/x") and got[9][:2] == got[10][:2] == ("", "") and got[13][:2] == ("x.net", "")


def test_rarest_token(spark):
    df = spark.createDataFrame([(["org", "example"],), (["org"],)], "_tokens array<string>")
    rule = urlrules.host_rule("block", "example.org/es/")
    assert rule.tokens == ("example", "org", "es") and urlrules.rarest(df, (rule,)) == (["es"], {"org": 2, "example": 1})
    assert urlrules.host_rule("block", "example.org/en/1").tokens == ("example", "org", "en")


@pytest.mark.parametrize("inline", [urlrules.INLINE_RULES, 0])
def test_rules_without_tokens_and_no_rules(spark, inline):
    bare = urlrules.host_rule("block", "org")  # nothing delimits the token
    assert bare.tokens == ()
    got = verdicts(spark, URLS, rules=(bare, *urlrules.RULES), inline=inline)
    assert got[3][2:] == ("org", "block") and got[2][2:] == ("org/", "allow") and got[0][2] == "example.org/es/" and got[9][2:] == (None, "allow")
    assert [r[2:] for r in verdicts(spark, URLS, rules=(bare,), inline=inline)][:2] == [("org", "block")] * 2
    assert {r[2:] for r in verdicts(spark, URLS, rules=(), inline=inline)} == {(None, "allow")}


def test_hot_tokens_and_urls(spark, monkeypatch):
    """Most rows hold one token, share one URL or have none; tokens are split over parts."""
    monkeypatch.setattr(urlrules, "HOT", 3)
    urls = URLS + ["http://a.com/de/x"] * 40 + [None] * 40 + [f"http://b{k}.com/fr/" for k in range(20)]
    df = spark.createDataFrame([(k, u, "h", "c") for k, u in enumerate(urls)], "page_id long, url string, _host string, _row string")
    joined = urlrules.judge(df, inline=0)
    assert joined.columns == ["page_id", "url", "_host", "_row", "host", "path", "rule", "verdict"]
    assert sorted(map(str, joined.collect())) == sorted(map(str, urlrules.judge(df).collect()))


def test_no_urls(spark):
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- vectors


def brute_top(rows, queries, k=5):
    """Of (row, id, vector) rows: the k best (-score, id) for each query row, its own row left out."""
    whole = lambda v: [int(x) for x in v]
    every = [(row, i, whole(v)) for row, i, v in rows]
    return {
        row: sorted((-sum(a * b for a, b in zip(whole(v), c, strict=True)), j) for other, j, c in every if other != row and len(c) == len(v))[:k]
        for row, _, v in queries
    }


@pytest.mark.parametrize("spread", [1, 1000, 2**24, 2**28])
def test_search_equals_brute_force(spread):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 6)) * spread)
    x[100:300] = x[0]  # many ties
    ids = rng.permutation(500) * 3
    row = np.arange(500)
    q = np.concatenate([x[:20], np.zeros((1, 6))])
    asked = np.concatenate([row[:20], [-1]])
    search = topk.Search(asked, q, np.full(21, topk.LOWEST), 5)
    for part in (slice(0, 150), slice(150, 500)):  # the second shard starts from the first one's scores
        search.through(topk.Shard.of(row[part], ids[part], x[part]))
    at, who, score = search.found()
    wanted = brute_top(list(zip(row.tolist(), ids.tolist(), x.tolist(), strict=True)), list(zip(asked.tolist(), asked.tolist(), q.tolist(), strict=True)))
    for i, r in enumerate(asked.tolist()):
        assert sorted((-int(s), int(j)) for s, j in zip(score[at == i], who[at == i], strict=True)) == wanted[r]


def test_floors_keep_ties():
    x = np.array([[1.0], [2.0], [2.0]])
    search = topk.Search(np.array([9]), np.array([[1.0]]), np.array([2]), 5)
    search.through(topk.Shard.of(np.arange(3), np.array([1, 2, 3]), x))
    assert search.found()[1].tolist() == [2, 3]


@pytest.mark.parametrize("block,run,growth", [(2, 2, 1), (4, 1, 8), (3, 100, 2)])
def test_many_query_blocks(spark, sf_dir, monkeypatch, block, run, growth):
    for name, value in (("BLOCK", block), ("RUN", run), ("GROWTH", growth), ("SHARD", 20)):
        monkeypatch.setattr(topk, name, value)
    assert rows(topk.top_k(table(spark, sf_dir, "embeddings")).toPandas()) == rows(duck(sf_dir, queries.oracle_sql()["op9_topk_search"]))


@pytest.mark.parametrize("shard", [8192, 4])
def test_repeated_ids(spark, tmp_path, monkeypatch, shard):
    """Every row of a divisible id is a query of its own; other rows of the id are candidates. SQL agrees."""
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = random.Random(3)
    made = [(rng.choice([0, 0, 50, 50, 7, 8, 100]), [float(rng.randint(-3, 3)), float(rng.randint(-3, 3))]) for _ in range(40)]
    spark.createDataFrame(made, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    numbered = [(n, i, [256 * x for x in v]) for n, (i, v) in enumerate(made)]
    wanted = brute_top(numbered, [r for r in numbered if r[1] % 50 == 0])
    mine = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
    assert mine == sorted((numbered[q][1], rank, j, -s) for q, best in wanted.items() for rank, (s, j) in enumerate(best, 1))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.TOPK_SQL})").fetchall()) == mine


def test_frequent_vector(spark):
    made = [(7, [1.0, 2.0])] * 300 + [(50 * i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    assert len(got) == 15 and got[0, 1] == (7, 2 * 65536) and got[50, 5] == (7, 3 * 65536) and got[100, 1] == (7, 4 * 65536)


def test_vector_edges(spark):
    inf, nan = float("inf"), float("nan")
    made = [(0, [1.0, 2.0], 1), (50, [0.5, None], 1), (100, [nan, 1.0], 1), (150, [inf, 1.0], 1), (200, None, 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, -1.0], 1), (3, [1.0], 1), (None, [9.0, 9.0], 1), (250, [], 1), (0, [1.0, 2.0], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    own = [(0, 1, 0, 5 * 65536), (0, 2, 1, 3 * 65536), (0, 3, 1, 3 * 65536), (0, 4, 2, -2 * 65536)]
    assert got == sorted(own * 2)
    assert topk.top_k(df.limit(0)).count() == 0


# --- pipeline


def test_pipeline_on_edges(spark, edge):  # noqa: F811
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    empty = edge.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_pipeline_equals_its_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {r["doc_id"] for r in quality.assess(docs).filter("kept").collect()}
    good = docs.filter(F.col("doc_id").isin(list(kept)))
    ids = {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} <= ids <= kept
    # a document that the mix takes twice has every id in two pieces
    tokens = token_ids({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in ids})
    whole = {}
    for p in pieces:
        whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    assert all(n in (len(tokens[d]), 2 * len(tokens[d])) for d, n in whole.items())
    assert {p["sequence_length"] for p in pieces} <= {1 << k for k in range(12)}
    assert check_packing([], {}) == []


def test_intermediate_tables_can_be_cleared(spark):
    from urllib.parse import urlparse

    folder = common.own_dir(spark)
    common.written(spark.range(3), "x")
    assert os.listdir(urlparse(folder).path)
    common.clear(spark)
    assert not os.path.exists(urlparse(folder).path)
