"""Main text of HTML pages by a tree-structured graphical model.

A page's DOM tree is the graph: every element is a variable, and every run of text between
two block boundaries a leaf under its block element; each is content or not. A node's own potential
is log-linear in its features (tag, words of class, id and role, length, share of link
text, ...); a parent-child potential joins every node with its parent. Sum-product passes
messages from the leaves to the root and back, which gives every node's exact marginal given
the whole page. Runs of text whose marginal is at least ``THRESHOLD`` are the blocks.

Training maximises the labelled pages' log-likelihood, whose gradient is the difference of
observed and expected features under the marginals. The labelled pages (``labelled_pages``)
are composed from fixed layouts in which each part is marked as content or not; they are a
few hundred and fitted on the driver in some seconds, whatever the size of the table.

Parsing follows HTML's habits: void elements, elements that end where their parent or the next
of their kind begins, unmatched end tags, comments, raw text of scripts and styles,
unquoted attributes, and pages cut off anywhere. Character references are decoded once.
What a browser doesn't show (head, script, style, template, ...) and form controls are no text at all;
like formulas, whose text is content, they don't end the block around them. Quotes in a tag count only
where a value begins.
Inside a block white space becomes one space and is trimmed; a line break counts as white
space. Blocks are joined in page order by an empty line.

Null and empty pages, and pages without content, give the empty text. Repeated pages are read
one by one; an empty table gives an empty result. Only the id, address and html are read. A
page is read whole, by itself, in one pass over the table without a shuffle.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.5
TRAINING_PAGES = 500
STEPS = 500

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title textarea select option"
                   " button svg object canvas audio video datalist annotation annotation-xml".split())
# Elements inside a line of text whose own text isn't shown there.
EMBEDDED = frozenset("script style template noscript iframe noembed noframes svg object canvas audio video datalist"
                     " annotation annotation-xml".split())
FORMULA = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts"
                    " mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover"
                    " semantics".split())
INLINE = EMBEDDED | FORMULA | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark"
                   " meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
                   " button select textarea".split())
# An element of the first kind ends an open one of the second, within the boundary.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
                     " footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

SECTIONS = frozenset("article main section header footer nav aside form dialog menu".split())

# What words in class, id, role and aria-label speak of.
LEXICON = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager tabs tab skip",
    "top": "header masthead banner topbar logo brand site branding",
    "bottom": "footer foot copyright legal colophon bottom",
    "side": "sidebar aside side rail related recommended recommendations popular trending widget widgets more teaser"
            " complementary",
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay newsletter subscribe signup"
              " promo disclaimer warning toast",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promotion dfp adsense"
              " commercial adslot adbox",
    "form": "form search searchbox login register contact input field",
    "comments": "comment comments reply replies respond disqus discussion reader readers feedback",
    "share": "share sharing social follow tags tag meta byline author date tools print",
    "content": "article content main post entry story body text page hentry prose markdown maincontent",
    "title": "title headline heading",
}
WORD_OF = {w: kind for kind, words in LEXICON.items() for w in words.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)|\Z)|[^>=])*+)(?:>|(\Z))"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|(\Z))", re.S)
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPEAKING = frozenset("class id role aria-label".split())
_WORDS = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")


class Page:
    """A page's tree as lists by node: parents come before their children."""

    def __init__(self) -> None:
        self.tag = ["#root"]
        self.parent = [-1]
        self.attributes: list[str] = [""]
        self.text: dict[int, str] = {}  # of leaves
        self.linked: dict[int, int] = {}  # characters of a leaf's text inside links

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    page = Page()
    stack = [0]  # open elements
    unseen = links = 0  # open elements of these kinds
    run: list[str] = []
    run_links = 0

    def flush() -> None:
        nonlocal run, run_links
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                holder = next(n for n in reversed(stack) if page.tag[n] not in INLINE)
                leaf = page.add("#text", holder)
                page.text[leaf], page.linked[leaf] = text, run_links
            run, run_links = [], 0

    def close(at: int) -> None:
        nonlocal unseen, links
        for n in stack[at:]:
            unseen -= page.tag[n] in UNSEEN
            links -= page.tag[n] == "a"
        inside = unseen
        for n in stack[at:]:
            if page.tag[n] not in INLINE and not inside:
                flush()
                break
            inside += page.tag[n] in UNSEEN
        del stack[at:]

    def open_index(tags, boundary) -> int | None:
        for i in range(len(stack) - 1, 0, -1):
            if page.tag[stack[i]] in tags:
                return i
            if page.tag[stack[i]] in boundary:
                return None
        return None

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        end = m.start() if m else len(source)
        if end > at and not unseen:
            piece = source[at:end]
            if not m and (cut := re.search(r"</?[a-zA-Z!]?[^<>]*\Z", piece)):
                piece = piece[:cut.start()]  # a tag that the page's end cuts off
            if piece:
                run.append(piece)
                run_links += len(piece) * (links > 0)
        if not m:
            break
        at = m.end()
        ends, name, rest, cut = m.group(1, 2, 3, 4) if m.group(2) else m.group(5, 6, 7, 8)
        if not name or cut is not None:
            continue
        tag = name.lower()
        if ends:
            if tag in VOID:
                if tag == "br":
                    run.append(" ")
                continue
            boundary = {"table", "td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else ()
            if tag in INLINE and tag not in EMBEDDED:
                boundary = CLOSES_P - {"p"} | {"td", "th", "li"}
            i = open_index({tag}, boundary)
            if i is not None:
                # Inline elements left open inside stay open for what follows only in a browser's look.
                close(i)
            continue
        if tag in CLOSES_P and (i := open_index({"p"}, {"table", "td", "th", "button", "article", "section", "div",
                                                                "template", "object", "svg", "math"})) is not None:
            close(i)
        if tag in ENDED_BY and (i := open_index(*ENDED_BY[tag])) is not None:
            close(i)
        if tag == "body" and (i := open_index({"head"}, ())) is not None:
            close(i)
        if tag == "br":
            run.append(" ")
        if tag in VOID:
            if tag == "hr" and not unseen:
                flush()
            continue
        if tag not in INLINE and not unseen:
            flush()
        node = page.add(tag, stack[-1], rest or "")
        if rest and rest.endswith("/") and (tag in ("svg", "math") or any(page.tag[n] in ("svg", "math") for n in stack)):
            continue
        if tag in RAW:
            over = re.compile(f"</{tag}\\s*(?:>|\\Z)", re.I).search(source, at)
            at = over.end() if over else len(source)
            continue
        stack.append(node)
        unseen += tag in UNSEEN
        links += tag == "a"
    flush()
    return page


def _bin(n: int) -> int:
    return min(6, n.bit_length())


def _kinds(attributes: str) -> list[str]:
    """What an element's attributes speak of."""
    out = set()
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        if name.lower() == "hidden":
            out.add("hidden")
        elif name.lower() in _SPEAKING:
            out |= {WORD_OF[w] for w in map(str.lower, _WORDS.findall(next((v for v in values if v), "")))
                    if w in WORD_OF}
    return sorted(out)


def features(page: Page) -> list[list[str]]:
    """Names of the features of every node."""
    n = len(page.tag)
    chars, linked, leaves = [0] * n, [0] * n, [0] * n
    for leaf, text in page.text.items():
        chars[leaf], linked[leaf], leaves[leaf] = len(text), page.linked[leaf], 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        leaves[p] += leaves[i]
    out: list[list[str]] = []
    kinds: list[list[str]] = []
    above: list[tuple[str, ...]] = []  # what a node's ancestors and itself are and speak of
    within: list[str] = []  # the last two sections around a node, itself included
    for i, tag in enumerate(page.tag):
        own_kinds = _kinds(page.attributes[i])
        kinds.append(own_kinds)
        held = above[page.parent[i]] if i else ()
        more = [f"under {tag}"] * (tag in SECTIONS) + [f"under one that speaks of {k}" for k in own_kinds]
        above.append(held + tuple(m for m in more if m not in held) if more else held)
        around = within[page.parent[i]] if i else ""
        within.append(f"{around.rpartition('>')[2]}>{tag}" if tag in SECTIONS else around)
        share = "none" if not linked[i] else "all" if linked[i] >= 0.8 * chars[i] else (
            "half" if linked[i] >= 0.3 * chars[i] else "some")
        if tag == "#text":
            text = page.text[i]
            own = ["leaf", f"leaf length {_bin(len(text) // 8)}", f"leaf links {share}",
                   f"leaf in {page.tag[page.parent[i]]}", f"leaf within {around}",
                   *(f"leaf in one that speaks of {k}" for k in kinds[page.parent[i]]), *above[i]]
            if text[-1] in ".!?…\"”":
                own.append("leaf ends a sentence")
            if "©" in text or "rights reserved" in text.lower():
                own.append("leaf claims rights")
        else:
            own = ["element", f"tag {tag}", f"links {share}", f"length {_bin(chars[i] // 32)}"]
            if leaves[i] and chars[i] < 40 * leaves[i]:
                own.append("short leaves")
            own += [f"speaks of {k}" for k in own_kinds]
        out.append(own)
    return out


class Model:
    """Feature weights and the parent-child potential, all in favour of content (1) over not (0)."""

    def __init__(self, weights: dict[str, float], pair: list[float]):
        self.weights, self.pair = weights, pair  # pair: log potential of [2 * parent + child]

    def unary(self, names: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in own]) for own in names]


def _message(odds: float, p00: float, p01: float, p10: float, p11: float) -> float:
    """Log odds of the far end from those of the near one; pXY: potential of far X and near Y."""
    odds = max(-60.0, min(60.0, odds))
    e = math.exp(odds)
    return math.log((p10 + p11 * e) / (p00 + p01 * e))


def marginals(parent: list[int], unary: list[float], pair: list[float]) -> tuple[list[float], list[float]]:
    """Log odds of every node being content, and of every node without its parent's message."""
    n = len(parent)
    p00, p01, p10, p11 = map(math.exp, pair)
    up = unary[:]  # own potential and messages from the children
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):
        sent[i] = _message(up[i], p00, p01, p10, p11)
        up[parent[i]] += sent[i]
    total = up[:]
    for i in range(1, n):
        total[i] += _message(total[parent[i]] - sent[i], p00, p10, p01, p11)
    return total, up


def extract(source: str | None, model: Model) -> list[str]:
    """The content blocks of a page."""
    if not source:
        return []
    page = parse(source)
    if not page.text:
        return []
    total, _ = marginals(page.parent, model.unary(features(page)), model.pair)
    limit = math.log(THRESHOLD / (1 - THRESHOLD))
    return [text for leaf, text in page.text.items() if total[leaf] >= limit]


# Labelled pages. data-y marks a subtree as content (1) or not (0); it is no feature.
# Layouts of the main part, and parts that are not content.
MAINS = (
    '<article data-y="1">{h}{p}</article>',
    '<main><article data-y="1">{h}{p}{x}{p}</article></main>',
    '<div id="content"><div class="post" data-y="1">{h}{p}</div></div>',
    '<div class="container"><div class="entry-content" data-y="1">{p}{x}{p}</div></div>',
    '<main id="main" data-y="1">{h}{p}</main>',
    '<div class="wrap"><div class="row"><div class="col" data-y="1">{h}{p}{p}</div></div></div>',
    '<section class="story-body" data-y="1">{h}{p}{x}</section>',
    '<article data-y="1"><header>{h}</header>{p}</article>',
    '<article data-y="1"><section>{h}{p}</section>{x}<section>{h}{p}</section></article>',
    '<table><tr><td data-y="1">{h}{p}</td></tr></table>',
    '<article data-y="1">{x}{h}{p}{x}</article>',
)
OTHERS = (
    '<nav data-y="0"><ul>{links}</ul></nav>', '<div class="menu" data-y="0"><ul>{links}</ul></div>',
    '<ul class="breadcrumbs" data-y="0">{links}</ul>', '<header data-y="0"><a href="/">{s}</a><p>{s}</p></header>',
    '<div id="header" data-y="0"><h1>{s}</h1><p>{t}</p></div>', '<div class="site-header" data-y="0">{t}</div>',
    '<footer data-y="0">&copy; {s} &middot; {t}</footer>', '<div class="footer" data-y="0"><p>{t}</p><p>{t}</p></div>',
    '<footer data-y="0"><p>{t}</p><ul>{links}</ul></footer>',
    '<aside data-y="0"><h3>{s}</h3><p>{t}</p><p>{t}</p></aside>', '<div class="sidebar" data-y="0"><h3>{s}</h3><ul>{links}</ul></div>',
    '<div id="sidebar" data-y="0"><p>{t}</p><p>{t}</p></div>', '<div class="related" data-y="0"><h2>{s}</h2><ul>{links}</ul></div>',
    '<div class="cookie-notice" data-y="0"><p>{t}</p></div>', '<div class="notice" data-y="0">{t}</div>',
    '<p class="notice" data-y="0">{t}</p>', '<div role="alert" data-y="0">{t}</div>', '<div id="consent-popup" data-y="0"><p>{t}</p></div>',
    '<section class="newsletter" data-y="0"><h2>{s}</h2><p>{t}</p></section>',
    '<div class="ad" data-y="0">{t}</div>', '<div class="advert" data-y="0"><p>{t}</p></div>', '<div id="ads" data-y="0"><p>{t} {t}</p></div>',
    '<section class="sponsored" data-y="0"><p>{t}</p></section>', '<ins class="adsbygoogle" data-y="0">{t}</ins>',
    '<form data-y="0"><label>{s}</label><input name="q"><p>{t}</p></form>', '<form class="search" data-y="0"><p>{s}</p></form>',
    '<div class="login-form" data-y="0"><p>{t}</p></div>',
    '<div class="comments" data-y="0"><h3>{s}</h3><p>{t}</p><p>{t}</p></div>',
    '<section id="comments" data-y="0"><div class="comment"><p>{t}</p></div><div class="comment"><p>{t} {t}</p></div></section>',
    '<ol class="comment-list" data-y="0"><li><p>{t}</p></li><li><p>{t} {t}</p></li></ol>',
    '<div class="comments" data-y="0"><p>{t}</p></div>', '<div id="comments" data-y="0"><p>{t} {t}</p><p>{t}</p></div>',
    '<header data-y="0"><p>{t}</p></header>', '<header data-y="0"><h1>{s}</h1></header>', '<form data-y="0"><p>{s}</p><button>{s}</button></form>',
    '<form data-y="0">{s} <input> {t}</form>', '<aside data-y="0"><p>{t}</p></aside>', '<aside data-y="0">{t}</aside>',
    '<div class="side-bar" data-y="0"><p>{t}</p></div>', '<div id="sidebar" data-y="0"><p>{s}</p></div>', '<footer data-y="0"><p>{t}</p></footer>',
    '<nav data-y="0"><p>{s}</p></nav>', '<nav data-y="0">{t}</nav>', '<div class="banner" data-y="0"><p>{t}</p></div>',
    '<section class="reader-comments" data-y="0"><h2>{s}</h2><blockquote>{t}</blockquote><p>{t}</p></section>',
    '<div class="comment" data-y="0"><p>{t}</p></div>', '<aside class="notice" data-y="0"><p>{t}</p></aside>', '<dialog data-y="0"><p>{t}</p></dialog>',
    '<div class="share" data-y="0">{links}</div>', '<div class="social" data-y="0"><ul>{links}</ul></div>',
)
FORMS_OF_TEXT = ("<p>{t}</p>", "<p>{t} {t}</p>", "<p>{t} {t} {t}</p>", "<p>{t} <a href='#'>{s}</a> {t}</p>", "<p>{s}</p>",
                 "<blockquote><p>{t}</p></blockquote>", "<ul><li>{t}</li><li>{s}</li></ul>", "<p><b>{t}</b><br>{t}</p>",
                 "<h2>{s}</h2><p>{t}</p>", "<pre>{t}</pre>", "<figure><img src='x'><figcaption>{t}</figcaption></figure>",
                 "<div>{t}</div>", "<p>{s}.</p>", "<table><tr><th>{s}</th><td>{s}</td></tr></table>", "<div><p>{t}</p></div>",
                 "<p>{l}</p>")
SYLLABLES = "ba ce di fo gu la me ni po ru sta tre vi wo za chi the and ing er on".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[str]:
    """Pages with data-y marks, composed from the layouts with invented words."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def fill(form: str, depth: int = 0) -> str:
        def part(m: re.Match) -> str:
            kind = m.group(1)
            if kind == "t":
                return words(4, 40).capitalize() + rng.choice((".", ".", ".", "", "###", "!"))
            if kind == "s":
                return words(1, 5).capitalize()
            if kind == "l":
                return " ".join([words(1, 12)] * rng.randint(10, 60)).capitalize() + "."
            if kind == "h":
                return f"<h1>{words(2, 12).capitalize()}</h1>" if rng.random() < 0.7 else ""
            if kind == "p":
                if rng.random() < 0.1:  # many short lines
                    return f"<p>{words(1, 3).capitalize()}.</p>" * rng.randint(5, 120)
                return "".join(fill(rng.choice(FORMS_OF_TEXT if rng.random() < 0.4 else FORMS_OF_TEXT[:3]), depth + 1)
                               for _ in range(rng.choice((1, 2, 3, 4, 6, 8, 30))))
            if kind == "x":
                return fill(rng.choice(OTHERS), depth + 1) if rng.random() < 0.6 else ""
            return "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(2, 8).split())

        return re.sub(r"\{(\w+)\}", part, form)

    pages = []
    for _ in range(n):
        before = [fill(rng.choice(OTHERS)) for _ in range(rng.randint(0, 3))]
        after = [fill(rng.choice(OTHERS)) for _ in range(rng.randint(0, 3))]
        body = "".join([*before, fill(rng.choice(MAINS)), *after])
        if rng.random() < 0.3:
            body = f'<div class="page">{body}</div>'
        pages.append(f"<html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>")
    return pages


def labels(page: Page) -> list[int]:
    """Every node's label: its own mark or its parent's; an element above content is content, else not."""
    marks: list[int | None] = []
    for i, held in enumerate(page.attributes):
        m = re.search(r'data-y="(\d)"', held)
        marks.append(int(m.group(1)) if m else marks[page.parent[i]] if i else None)
    out = [0 if m is None else m for m in marks]
    for i in range(len(out) - 1, 0, -1):
        if out[i] and marks[page.parent[i]] is None:
            out[page.parent[i]] = 1
    return out


def fit(pages: list[str], steps: int = STEPS, rate: float = 0.15, decay: float = 0.002) -> Model:
    """Gradient ascent (AdaGrad) on the log-likelihood of the labelled pages."""
    trees = []
    for source in pages:
        page = parse(source)
        trees.append((page.parent, features(page), labels(page)))
    model = Model({}, [0.0, 0.0, 0.0, 0.0])
    squares: dict[str | int, float] = {}
    rng = random.Random(1)
    batch = 24
    for _ in range(steps):
        slope: dict[str | int, float] = {}
        for parent, names, y in rng.sample(trees, min(batch, len(trees))):
            total, up = marginals(parent, model.unary(names), model.pair)
            e = [math.exp(x) for x in model.pair]
            for i, own in enumerate(names):
                error = y[i] - 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, total[i]))))
                for f in own:
                    slope[f] = slope.get(f, 0.0) + error
                if i:
                    # The pair's joint marginal from both ends' beliefs without each other.
                    above = total[parent[i]] - _message(up[i], *e)
                    above, below = (math.exp(max(-60.0, min(60.0, x))) for x in (above, up[i]))
                    joint = [e[0], e[1] * below, e[2] * above, e[3] * above * below]
                    whole = sum(joint)
                    for k in range(4):
                        slope[k] = slope.get(k, 0.0) + (2 * y[parent[i]] + y[i] == k) - joint[k] / whole
        for k, g in slope.items():
            now = model.pair[k] if isinstance(k, int) else model.weights.get(k, 0.0)
            g = g / batch - decay * now
            squares[k] = squares.get(k, 1e-6) + g * g
            step = rate * g / math.sqrt(squares[k])
            if isinstance(k, int):
                model.pair[k] = now + step
            else:
                model.weights[k] = now + step
    return model


def _extractor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*model.value)
        for b in batches:
            blocks = [extract(source.as_py(), fitted) for source in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "blocks"])

    return run


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              training: list[str] | None = None) -> DataFrame:
    """page_id, url, blocks (array) of every page; the text is the blocks joined by an empty line."""
    model = fit(labelled_pages() if training is None else training)
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.pair))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(_extractor(sent), "page_id bigint, url string, blocks array<string>")
