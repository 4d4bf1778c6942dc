"""HTML extraction and the corpus pipeline."""
import re

import numpy as np
import pytest

from codeweave.llm import htmltext, toxicity

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="content">
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">buy<article><h1>Head &amp; line</h1>
<p><b>First&nbsp;one.<br><p>Second   <i>it</i>alic.</p><form>sign up</form><div class="comments"><p>troll</p></div>a &lt; b</article>
<aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_page_by_hand():
    assert htmltext.parse(PAGE) == "Head & line First one. Second italic. a < b"


@pytest.mark.parametrize("page", ["", "<", "<p", "a<b", "</div></p>x", "<!-- open", "<script>x", "<p class='x>y", "<p title=\"a>b\">t", "&#x110000; &am &amp", "<p>" * 3000])
def test_broken_markup_never_fails(page):
    assert isinstance(htmltext.parse(page), str)
    assert isinstance(htmltext.parse(page, stats=True), list)


@pytest.mark.parametrize("tag", ['<svg class="icon"/>', "<math/>", '<svg class="icon">', "<noscript>", "<template>", "<math>", "<svg/><svg>no</svg>"])
def test_text_after_self_closing_and_unclosed(tag):
    assert htmltext.parse(f"<article><p>one</p>{tag}<p>two</p></article>") == "one two"
    assert htmltext.parse("<article><p>one</p><svg>no</svg><noscript>no</noscript><p>two</p></article>") == "one two"


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.sub("</?b>", "", re.search("<article>(.*)</article>", r["html"], re.S)[1])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("</?(?:p|h1|br)>", article)]
        assert got[r["page_id"]] == " ".join(filter(None, blocks))


STORY = "<p>The story goes on for some time and says much.</p>"


@pytest.mark.parametrize("page,want", [
    (f"<article>{STORY}</article><section class='comments'><article class='comment'><p>troll</p></article></section>", "story"),
    (f"<article>{STORY}<div class='comment-content'><p>troll</p></div></article>", "story"),
    (f"<article>{STORY}</article><footer><article><p>buy this</p></article></footer>", "story"),
    (f"<div class='txt'>{STORY}</div><div class='sidebar-content'><p>side</p></div>", "story"),
    (f"<div class='post-meta'><p>by me</p></div><div class='txt'>{STORY}</div>", "by me story"),
    (f"<div class='content'><p>x</p></div><div class='txt'>{STORY}</div>", "x story"),
    (f"<div class='entry-content has-sidebar'>{STORY}</div><div class=foo>else</div>", "story"),
    (f"<form><div>{STORY}</div></form>", "story"),
    (f"<form><input></form><div>{STORY}</div>", "story"),
    (f"<form action=x><article>{STORY}</article><footer>f</footer></form>", "story"),
    (f"<div class='ad'>buy<article>{STORY}</article>", "story"),
    (f"<article><header><h1>Head</h1></header>{STORY}</article>", "story"),
])
def test_names_and_nesting(page, want):
    assert htmltext.parse(f"<html><body>{page}</body></html>") == want.replace("story", "The story goes on for some time and says much.")


def test_deep_nesting_keeps_paths_short():
    page = "<div class=abc>" * 15_000 + "deep"
    assert htmltext.parse(page) == "deep"
    assert max(len(p) for p, _, _ in htmltext.parse(page, stats=True)) <= htmltext.PATH_MAX


def test_entropy_decides_on_a_site_without_articles(spark):
    """Pages rebuilt from what was put into them: what repeats over the site goes, whatever its place and unnamed tags."""
    import random
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(n))
    boiler, links = text(20), "".join(f"<div>{text(2)}</div>" for _ in range(6))
    rows, want = [], {}
    for i in range(30):
        parts = [text(rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        rows.append((i, "http://big.org/a", f"<body><div class=top><p>{boiler}</p></div><div class=list>{links}</div><div class=txt>"
                     + "".join(f"<p>{x}</p>" for x in parts) + f"</div><div class=end><span>{boiler[::-1]}</span></div></body>"))
        want[i] = " ".join(parts)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("few", [100_000, 0])
def test_style_tree_removes_what_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(htmltext, "BROADCAST_BRANCHES", few)
    rows = [(i, "http://site.org/1", f"<body><div class=box><p>always the same</p></div><div class=txt><p>page {i} says {i * 7}</p></div></body>", 0) for i in range(20)]
    rows += [(100, "http://other.org/", "<body><div class=box><p>always the same</p></div></body>", 0), (101, None, None, 0), (102, "x", "", 0), (5, "http://site.org/1", rows[5][2], 0)]
    rows += [(200 + i, "http://copies.org/", "<article><p>one text on all pages</p></article>", 0) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low int")
    out = htmltext.extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert all(got[i] == f"page {i} says {i * 7}" for i in range(20))
    assert got[100] == "always the same" and got[101] == got[102] == "" and got[205] == "one text on all pages"
    assert htmltext.extract(df.limit(0)).count() == 0


def test_importance_is_entropy(spark):
    rows = [(i, "http://a.org/", f"<div class=x><p>{i % 2}</p></div>") for i in range(4)]
    p = spark.createDataFrame(rows, "page_id long, host string, html string").selectExpr("page_id", "'a.org' as host", "html")
    got = {r["path"]: r["importance"] for r in htmltext.importance(htmltext.place_counts(p)).collect()}
    want = htmltext.GAMMA * np.log(2) / np.log(4)  # two contents, equally often, on four pages; one presentation
    assert abs(got["/div.x/p"] - want) < 1e-9 and abs(got["/div.x"] - want) < 1e-9


# ------------------------------------------------------------------- pipeline
def test_pipeline_brute(spark):
    import base64

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from tests.llm.test_joins import _components, _hits
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}
    a = stages["toxicity"](spark, docs, SF)
    assert a.columns == docs.columns and {r["doc_id"] for r in a.collect()} == clean
    comp = _components([(i, rows[i]["text"]) for i in clean], corpus_pipeline.SHINGLE, corpus_pipeline.NUM, corpus_pipeline.DEN)
    one = {i for i in clean if comp[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i in one for n, h, _ in [_hits(rows[i]["text"], items)] if not (h and 20 * h >= n)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == kept
    ranks = {base64.b64decode(x): int(y) for x, y in (z.split() for z in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    private = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b[0-9a-f]{40}\b|\b\d{16}\b", re.I)
    for i, r in out.items():
        text = r["decoded"].decode()
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text)
        found = private.findall(rows[i]["text"])
        assert not any(x in text for x in found)
        if not found and not re.search(r"\d+\.\d+\.\d+\.\d+", rows[i]["text"]):
            assert text == rows[i]["text"]


def test_pipeline_edges(spark):
    import corpus_pipeline
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double"
    docs = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1.0), (None, "a b c", "en", "s", 5, "x", 1.0),
                                  (3, "a b c", "en", "s", 5, "x", 1.0), (3, "a b c", "en", "s", 5, "x", 1.0)], schema)
    for empty in (False, True):
        d = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, SF)
            assert d.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, d, SF)
        assert sorted(str(r["doc_id"]) for r in out.collect()) == ([] if empty else ["1", "2", "3", "None"])
