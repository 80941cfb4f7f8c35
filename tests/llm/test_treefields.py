import math
import random

import pytest

from equiclass.llm.queries import op8_tree_fields
from equiclass.llm.treefields import extract, features, fit, labelled_pages, labels, main_text, marginals, parse
from tests.llm.helpers import prose

PAGES = "page_id long, url string, html string, blocks string, text string"


@pytest.fixture(scope="module")
def model():
    return fit(labelled_pages())


def test_marginals_match_enumeration():
    rng = random.Random(0)
    for n in (1, 2, 5, 9):
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        pair = [rng.uniform(-1, 1) for _ in range(4)]
        whole, on = 0.0, [0.0] * n
        for state in range(1 << n):
            y = [state >> i & 1 for i in range(n)]
            w = math.exp(sum(u for u, k in zip(unary, y, strict=True) if k) + sum(
                pair[2 * y[parent[i]] + y[i]] for i in range(1, n)))
            whole += w
            for i in range(n):
                on[i] += w * y[i]
        total, _ = marginals(parent, unary, pair)
        for i in range(n):
            assert 1 / (1 + math.exp(-total[i])) == pytest.approx(on[i] / whole, rel=1e-9)


def test_held_out_labelled_pages(model):
    right = wrong = 0
    for source in labelled_pages(200, seed=99):
        page = parse(source)
        y, (total, _) = labels(page), marginals(page.parent, model.unary(features(page)), model.pair)
        for leaf in page.text:
            same = (total[leaf] >= 0) == bool(y[leaf])
            right, wrong = right + same, wrong + (not same)
    assert right / (right + wrong) > 0.97


PARTS = ('<div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p>First  <b>bold\n</b>words&nbsp;here.<br>Next'
         '<p>An <a href="/x">inner link</a> in a sentence of some length.</p><ul><li>one item of a list<li>two &lt;tags&gt;</ul>'
         '<div class="comments"><p>I disagree with all of this.</p></div></article>')
WANT = ["A title & more", "First bold words here. Next", "An inner link in a sentence of some length.",
        "one item of a list", "two <tags>"]
TOP = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
       '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- a <p>comment</p> -->')


@pytest.mark.parametrize("end", ["<footer>&copy; site</footer></body></html>", "<footer>&copy; site", "", "<foot", "</art"])
def test_a_page_and_its_cuts(model, end):
    page = TOP + PARTS + end
    if end == "</art":
        page = TOP + PARTS.removesuffix("</article>") + end
    assert extract(page, model) == WANT


@pytest.mark.parametrize("part", [
    "<aside><h3>More</h3><p>Read this other story too.</p></aside>", "<header><p>The daily paper of the town</p></header>",
    '<div class="notice">We use cookies on this site.</div>', "<form><p>Sign up</p><input><button>Go</button></form>",
    "<script>if (a < b) document.write('<p>x</p>')</script>", "<style>a > b {}</style>", "<noscript>Enable it</noscript>",
    '<div id="sidebar"><p>Most read stories this week.</p></div>', '<select><option>One<option>Two</select>',
    '<section id="comments"><h3>Comments</h3><p>I liked it a lot, thanks.</p></section>'])
def test_other_parts_go(model, part):
    main = f"<article><h1>Heading of it</h1><p>{prose(60, 1)}.</p><p>{prose(40, 2)}.</p></article>"
    want = ["Heading of it", prose(60, 1) + ".", prose(40, 2) + "."]
    assert extract(TOP + part + main + "<footer>the end</footer>", model) == want
    assert extract(TOP + main + part + "<footer>the end</footer>", model) == want


def test_awkward_pages(spark, model):
    long = "".join(f"<p>{prose(30, i)}.</p>" for i in range(1500))
    deep = "<div>" * 3000 + "<p>x</p>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "just words, no tags at all."), (5, "u", "&am"),
            (6, "u", f"<article>{long}</article>"), (7, "u", deep), (7, "u", deep), (None, "u", "</p></div><p>"),
            (8, "u", "<p <b>x<p/></>< / p><!-- never ends"), (9, "u", "\x00<article><p>&#0;&#x110000;&#65;</p></article>")]
    frame = spark.createDataFrame([(*r, "b", "t") for r in rows], PAGES)
    got = main_text(frame).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "blocks"}
    by = {r["page_id"]: r["blocks"] for r in got}
    assert by[1] == by[2] == by[3] == [] and len(by[6]) == 1500
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_query_on_the_whole_table(spark, sf001):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()}
    got = op8_tree_fields(spark, sf001).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"]) and "\n\n\n" not in r["text"] and "<p>" not in r["text"]
        ad = pages[r["page_id"]].split('<div class="ad">')[1].split("</div>")[0] if "<article>" in pages[r["page_id"]] else ""
        assert not r["text"].startswith(ad) or not ad
        assert bool(r["text"]) == ("<article>" in pages[r["page_id"]])


@pytest.mark.parametrize("inner,want", [
    ("<svg viewBox='0 0 1 1'><g><path d='M0'/><circle r=1 /><text>no</text></g></svg>", "Hello world of words."),
    ("<svg/>", "Hello world of words."), ("<script>let a = '<p>';</script>", "Hello world of words."),
    ("<style>p > b {}</style>", "Hello world of words."), ("<template><div>no<hr></div></template>", "Hello world of words."),
    ("<svg><foreignObject><div>no</div></foreignObject></svg>", "Hello world of words."),
    ("<math><mi>x</mi><mo>=</mo><mfrac><mn>2</mn><mn>3</mn></mfrac></math>", "Hello x=23 world of words."),
    ("<math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math>", "Hello x world of words."),
    ("<b title=it's>bold</b>", "Hello bold world of words."), ("<b title = \"a > b\" lang='e>n'>bold</b>", "Hello bold world of words."),
    ("<b data-x=a\"b=c' y=>bold</b>", "Hello bold world of words."),
])
def test_what_is_inside_a_line_does_not_end_it(model, inner, want):
    page = f"{TOP}<article><h1>Heading</h1><p class=it's>Hello {inner} world of words.</p><p>{prose(30, 3)}.</p></article>"
    assert extract(page, model) == ["Heading", want, prose(30, 3) + "."]


def test_names_inside_values_are_no_attributes():
    from equiclass.llm.treefields import _kinds

    assert _kinds(' title="class=menu id=ads" data-id="footer" aria-hidden="true" data-class=sidebar') == []
    assert _kinds(' CLASS = "Menu" id=it\'s-ads role=\'form\' hidden') == ["advert", "form", "hidden", "menu"]
    assert _kinds(" =x class=footer/") == ["bottom"]


def test_tags_that_never_end_take_no_exponential_time():
    page = parse("<p " + "a=bc'd " * 20000 + "=\"")
    assert not page.text
    assert parse("<p>x</p><p " + "a='b " * 2000)
