"""Main text of pages: markup cases, held-out generated pages, and the given ones."""

import random
import time

import pytest

from weirlog.llm import labeller, main_text
from weirlog.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def model():
    return labeller.train()


def texts_of(page):
    return [t for _, t, _ in blocks(page)]


def test_blocks():
    assert texts_of("<p>a <b>b</b>c<br>d &amp; &lt;e&gt;<p>f<script>x<p>y</script><style>z</style><!-- <p>n --><li>g</p>") == ["a bc d & <e>", "f", "g"]
    assert texts_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts_of('<div title="a>b">x</div><textarea>no</textarea>y') == ["x", "y"]
    assert texts_of(None) == texts_of("") == texts_of("<p> &nbsp; </p>") == []
    assert texts_of("plain \n\t text") == ["plain text"]
    assert texts_of("<p>1 < 2 and <3") == ["1 < 2 and <3"]
    assert texts_of("<p>a<script>never closed") == ["a"]


def test_text_of_formulas_drawings_and_media():
    formula = "<math><mrow><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></mrow></math>"
    assert texts_of(f"<p>Let {formula} hold.<p>x") == ["Let a=b2 hold.", "x"]
    assert texts_of("<p>see <svg viewBox='0 0 1 1'><g><path d='M0'/><text>label <tspan>one</tspan></text></g></svg> here") == ["see label one here"]
    for tag in ("object", "canvas", "audio", "video"):
        assert texts_of(f"<p>a <{tag} src='x'>in <b>place</b></{tag}> b") == ["a in place b"]
        assert texts_of(f"<p>a <{tag}>never closed<p>b") == ["a never closed", "b"]
    assert blocks("<div><noscript><p>read</p></noscript></div>") == [((("div",), ("noscript",), ("p",)), "read", 0)]


def test_all_words_of_attributes():
    words = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    (path, _, _), = blocks(f'<div class="{words}">x</div>')
    assert path == (("div", *[f".{w}" for w in words.split()]),)


@pytest.mark.parametrize("tag", ["template"])
def test_skipped_elements_without_end(tag):
    assert texts_of(f"<p>a<{tag} x='1'><g>no</g>no<p>b<p>c") == ["a", "b", "c"]
    assert texts_of(f"<header><{tag}><path d='M0'>no</header>b<p>c") == ["b", "c"]
    assert texts_of(f"<{tag}>no<p>b</p><{tag}>no<p>no</p></{tag}>c<script>'<{tag}>'</script><p>d") == ["b", "c", "d"]
    assert texts_of(f"<p>a<{tag}><div>no<{tag}>no</{tag}>no</div></{tag}>b") == ["ab"]
    assert texts_of(f"<p>a<{tag}/>b<{tag}><!-- </{tag}> --><p>no</{tag}>c") == ["abc"]


def test_path_of_unclosed_tags():
    path = blocks('<div class="mainContent"><p>a<p>b</div><p>c')
    assert [p for p, _, _ in path] == [
        (("div", ".main", ".content"), ("p",)), (("div", ".main", ".content"), ("p",)), (("p",),),
    ]


def test_held_out_pages(model):
    pages = [labeller.sample_page(random.Random(10**9 + k)) for k in range(300)]
    got = model.label([p for p, _ in pages])
    wrong = sum(int((a != (y > 0)).sum()) for a, (_, y) in zip(got, pages))
    assert wrong <= 0.005 * sum(len(y) for _, y in pages)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {
        r.page_id: "\n".join(t for path, t, _ in blocks(r.html) if any(p[0] == "article" for p in path)) for r in pages.collect()
    }
    got = main_text.main_text(pages, model).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_layouts(model):
    page = """<body><div class=cookie-notice><p>We use cookies.</p></div><header><h1>Site name</h1></header>
    <nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
    <main><article class=post><h1>A title of the story</h1><p>The first paragraph says what happened, and where it did.</p>
    <div class="ad-slot">Buy our things now!</div><p>The second one goes on for a while, with more words in it.</p></article>
    <section id="comments"><h3>Comments</h3><div class=comment><p>I liked this story a lot.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>More stories</a></ul></aside>
    <form><label>Your mail</label><input><button>Send</button></form><footer>&copy; 2020 Site</footer></body>"""
    found = blocks(page)
    kept = [t for (_, t, _), k in zip(found, model.label([found])[0]) if k]
    assert kept == [
        "A title of the story", "The first paragraph says what happened, and where it did.",
        "The second one goes on for a while, with more words in it.",
    ]


def test_odd_rows(spark, model):
    rows = [(1, "u", None, 1), (1, None, "", 2), (None, "u", "<article><p>" + "Some words here. " * 5000 + "</article>", 3), (2, "u", "<p>", 4)]
    out = main_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"), model).collect()
    assert len(out) == 4 and sum(r.text == "" for r in out) == 3
    assert main_text.main_text(spark.createDataFrame([], "page_id bigint, url string, html string"), model).count() == 0


@pytest.mark.parametrize("text", ["<a b ", "<! ", "<svg b ", "x<!-- ", "< ", "<a b='"])
def test_tags_without_an_end_take_time_in_proportion(text):
    began = time.perf_counter()
    blocks("<p>before</p>" + text * (2_000_000 // len(text)))
    blocks("<svg>" + text * (1_000_000 // len(text)) + ">" + text * (1_000_000 // len(text)))
    assert time.perf_counter() - began < 20


def test_comments_without_an_end_run_to_the_end_of_the_page():
    for page in ("<p>a</p><!-- b <p>c</p> d", "<p>a</p><!--> b", "<p>a</p><!-- b", "<p>a<!-- <b> -->"):
        assert [t for _, t, _ in blocks(page)] == ["a"]
    assert [t for _, t, _ in blocks("<p>a</p>1 < 2 <b")] == ["a", "1 < 2 <b"]
