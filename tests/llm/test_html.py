"""The extractor on layouts that its training pages don't have, and on markup that would cost a careless parser its time."""

import random
import time

import pytest

from shutterlake.llm import html_extract

WORDS = "harbour winter council report morning people seven copper market bridge older garden water letter carried found between under across village road early spoke museum river quiet long several years".split()


class Page:
    """Builds a page and remembers which texts belong to the article."""

    def __init__(self, seed):
        self.r, self.good, self.bad, self.out = random.Random(seed), [], [], []

    def prose(self, low, high):
        words = self.r.choices(WORDS, k=self.r.randint(low, high))
        return " ".join(words).capitalize() + f" {len(self.good) + len(self.bad)}."

    def say(self, tag, good, low, high, link=False):
        text = self.prose(low, high)
        (self.good if good else self.bad).append(text)
        self.out.append(f"<{tag}>" + (f'<a href="#">{text}</a>' if link else text) + f"</{tag.split()[0]}>")

    def raw(self, text):
        self.out.append(text)

    def article(self):
        self.say("h1", True, 4, 9)
        for _ in range(self.r.randint(2, 9)):
            self.say("p", True, 12, 70)
            if self.r.random() < 0.2:
                self.say("h2", True, 2, 6)

    def links(self, n, tag="li"):
        for _ in range(n):
            self.say(tag, False, 1, 4, True)


def news(p):
    p.raw('<html><body><div class="o-page"><div class="c-topbar"><ul class="c-topbar__links">')
    p.links(5)
    p.raw('</ul></div><div class="l-grid"><div class="l-grid__main"><div class="c-story__body">')
    p.article()
    p.raw('</div></div><div class="l-grid__rail"><h4>')
    p.say("span", False, 1, 3)
    p.raw("</h4><ul>")
    p.links(6)
    p.raw('</ul></div></div><div class="c-legal">')
    p.say("small", False, 3, 9)
    p.raw("</div></div></body></html>")


def tables(p):
    p.raw("<html><body><table><tr><td colspan=2>")
    p.say("b", False, 1, 3)
    p.raw("</td></tr><tr><td width=120>")
    p.links(7, "div")
    p.raw("</td><td>")
    p.article()
    p.raw("</td></tr><tr><td colspan=2><font size=1>")
    p.say("span", False, 2, 6)
    p.raw("</font></td></tr></table></body></html>")


def blog(p):
    p.raw('<body><div id="wrap"><div id="branding">')
    p.say("div", False, 1, 3)
    p.raw('</div><ul id="access">')
    p.links(4)
    p.raw('</ul><div id="primary"><div class="hentry">')
    p.article()
    p.raw('</div><div id="respond-list"><ol>')
    for _ in range(3):
        p.raw('<li class="comment even">')
        p.say("p", False, 5, 25)
        p.raw("</li>")
    p.raw('</ol></div></div><div id="secondary" class="widget-area"><ul>')
    p.links(5)
    p.raw('</ul></div><div id="colophon">')
    p.say("p", False, 3, 8, True)
    p.raw("</div></div></body>")


def wiki(p):
    p.raw('<body><div id="mw-head"><ul>')
    p.links(4)
    p.raw('</ul></div><div id="bodyContent"><div class="parser-output">')
    p.article()
    p.raw('</div></div><div id="mw-panel"><ul>')
    p.links(8)
    p.raw('</ul></div><div class="catlinks">')
    p.links(3, "span")
    p.raw("</div></body>")


def bare(p):
    p.raw("<p>")
    p.links(3, "span")
    p.raw("</p>")
    p.article()
    p.raw("<hr><address>")
    p.say("span", False, 2, 5)
    p.raw("</address>")


@pytest.mark.parametrize("family", [news, tables, blog, wiki, bare])
def test_layouts_that_training_has_not_seen(family):
    crf, hit, said, there = html_extract.model(), 0, 0, 0
    for seed in range(60):
        p = Page(seed)
        family(p)
        got = html_extract.main_text("".join(p.out), crf).split("\n\n")
        hit += sum(t in p.good for t in got)
        said += sum(bool(t) for t in got)
        there += len(p.good)
    precision, recall = hit / max(1, said), hit / there
    assert 2 * precision * recall / (precision + recall) >= 0.95, (precision, recall)


def test_features_of_decoding_are_those_of_training():
    crf = html_extract.model()
    for html, labels in html_extract.labelled_pages(30, seed=77):
        found = html_extract.blocks(html, crf.weights)
        assert len(found) == len(labels)
        one, two = crf.decode(html_extract.features(found)), crf.decode(html_extract.own_features(found), [b.score for b in found])
        assert one == two
        for b in found:
            assert abs(b.score - sum(crf.weights.get(f, 0.0) for f in html_extract.ancestors(b.node))) < 1e-9


@pytest.mark.parametrize("html", [
    "<div>x " * 20_000, '<a title="x ' * 20_000, '<a "' * 20_001 + ">", "<a " * 20_000, "<" * 100_000, "<b>" * 20_000 + "</i>" * 20_000, "".join(f"<div class=c{i}>x " for i in range(20_000)),
    "<ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<b><table>" + "<i>" * 20_000 + "</b>" * 20_000, "<style>" * 20_000, "<!--" * 20_000, "&" * 100_000, "<p>word " * 100_000, "x" * 3_000_000,
])
def test_time_follows_the_page_whatever_its_markup(html):
    start = time.process_time()
    html_extract.main_text(html, html_extract.model())
    assert time.process_time() - start < 5


@pytest.mark.parametrize(("html", "want"), [
    (None, []), ("", []), ("a < b > c", ["a < b > c"]), ("<p>x<p>y", ["x", "y"]), ("x<a title='1>2'>y</a>", ["xy"]), ('<p title="x>a<p>b', ["a", "b"]),
    ("a<br>b", ["a b"]), ("<script>if (a<b) x</script>t", ["t"]), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("x</p>y", ["x", "y"]), ("x<p", ["x"]),
    ("&lt;b&gt; &eacute;&#8212;&amp;amp;", ["<b> é—&amp;"]), ("a \n\t b", ["a b"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<!-- a > b -->c", ["c"]), ("<!doctype html>c", ["c"]),
])
def test_blocks(html, want):
    assert [b.text for b in html_extract.blocks(html or "")] == want


def test_clashing_columns_and_repeats(spark):
    rows = [(i, "u", h, "clash", 9, "c") for i, h in [(1, "<article><p>One sentence that is long enough to be told from a menu.</p></article>"), (1, None), (None, "<p"), (2, "x" * 2_000_000)]] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, `a.b` string")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 8
