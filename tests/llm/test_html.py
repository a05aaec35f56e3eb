"""HTML extraction: the template by brute force, neutral markup, odd and hostile pages."""

import collections
import json
import random
import time

import numpy as np
import pandas as pd
import pytest

from netloom.llm import html_extraction as H

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>m</li></ul></nav><div class='cookie-notice'>we use</div><article><h1>T &amp; {0}</h1><p><b>b{0}<br>c</p><p>d <i>e</i>f<aside>no</aside></article><section id='comments'><p>nice</p></section><footer>f {0}</footer>"
SCHEMA = "page_id long, url string, html string, host int"
BIG = (1 << 62) + 1


def test_html_extraction(spark):
    pages = [(i, f"https://h.example/{i}", PAGE.format(i), 7) for i in range(8)]
    pages += [(BIG, None, None, 1), (101, "x", "", 1), (102, "http://q/", "plain &lt; text", 1), (103, "http://q/", "<p>a<br>b&nbsp;c</p><script>if(a<b)x='</p>'</script><form>z</form>", 1), (0, "https://h.example/0", PAGE.format(0), 7), (None, None, "<p>none", 2)]
    df = spark.createDataFrame(pages, SCHEMA)
    for limit in (H.MAX_BROADCAST_BYTES, -1):  # broadcast, then salted join
        got = collections.Counter((r.page_id, r.text, r.n_chars) for r in H.extract_text(df, max_broadcast_bytes=limit).collect())
        want = [(i, f"T & {i} b{i} c d ef", len(f"T & {i} b{i} c d ef")) for i in [*range(8), 0]]
        want += [(BIG, "", 0), (101, "", 0), (102, "plain < text", 12), (103, "a b c", 5), (None, "none", 4)]
        assert got == collections.Counter(want)
    assert H.extract_text(df.limit(0)).count() == 0


def prose(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "nu", "pe", "ri", "so", "tu"]) + str(rng.randrange(90)) for _ in range(n))


def neutral(rng, i):
    """Markup that names nothing: links, an advert, the article, a footer."""
    links = "".join(f"<li><a href='/{k}'>{prose(rng, 1)}</a></li>" for k in range(rng.randrange(4, 7)))
    paragraphs = [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
    head, extra = prose(rng, 6), prose(rng, 8)
    html = f"<html><head><title>{head}</title></head><body><div class='x3'><ul>{links}</ul></div><div class='x2'>{prose(rng, 9)}</div><div class='x1'><h1>{head}</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<div class='x5'>All texts here are free to read</div>{f'<table><tr><td>{extra}</td></tr></table>' if i == 3 else ''}</div><div class='x4'>Made by us {prose(rng, 4)}</div></body></html>"
    return html, " ".join([head, *paragraphs, *([extra] if i == 3 else [])])


@pytest.fixture(scope="module")
def neutral_pages(spark):
    rng = random.Random(3)
    made = [neutral(rng, i) for i in range(12)]
    return spark.createDataFrame([(i, f"http://n.example/{i}", h, 0) for i, (h, _) in enumerate(made)], SCHEMA), {i: t for i, (_, t) in enumerate(made)}


def test_neutral_markup(neutral_pages):
    df, want = neutral_pages
    assert {r.page_id: r.text for r in H.extract_text(df).collect()} == want


def test_vectors_decide(neutral_pages):
    # shuffled vectors leave no valid class, so the region is lost and menus stay
    df, want = neutral_pages
    read, rows = H.Reader(), []
    for r in df.collect():
        token, role, word, roles, _ = read.tokens(r.html)
        rows += [(t, int(x), bool(w), roles.get(t)) for t, x, w in zip(token.tolist(), role, word, strict=True)]
    n = collections.Counter(t for t, _, _, _ in rows)
    seen = {t: (x, w, s) for t, x, w, s in rows}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = pd.DataFrame([{"token": signed(t), "v": 1 if n[t] == 12 else t % 997, "pages": min(n[t], 12), "total": n[t], "position": float(i), "bad": 0, "word": w, "parent": signed(x) if w else signed(s[3]), "label": "" if w else s[4], "words": 0 if w else 50, "links": 0} for i, (t, (x, w, s)) in enumerate(seen.items()) if n[t] >= 6])
    assert H.nest(table)["main"]
    assert not H.nest(table.assign(v=np.arange(len(table))))["main"]


def test_classes_by_brute_force(spark, neutral_pages):
    df, _ = neutral_pages
    pages, read = [], H.Reader()
    for r in df.collect():
        path, tokens = {0: ()}, []
        for kind, state, text in H.walk(r.html, H.Reader.ROOT, read.enter):
            if kind == "open":
                path[state[0]] = (*path[state[3]], state[4])
                tokens.append((path[state[0]], None))
            elif kind == "text":
                tokens += [(path[state[0]], w) for w in text.split()]
        pages.append(tokens)
    counts = [collections.Counter(t) for t in pages]
    groups = collections.defaultdict(list)
    for t in set().union(*counts):
        v = tuple(c[t] for c in counts)
        if sum(x > 0 for x in v) >= 6:
            groups[v].append(t)
    def rank(c):
        return sum(pages[0].index(t) < pages[0].index(c) for t in once)
    once = groups[(1,) * 12]  # one order on every page: the root class
    want = [p[-1] if w is None else w for p, w in sorted(once, key=rank)]
    got = json.loads(H.host_templates(df).first().template)
    root = max(got, key=lambda c: len(c["tokens"]))
    assert sorted(root["tokens"]) == sorted(want) and root["in"] is None and root["pages"] == 12
    assert {"Made", "free", "div.x1"} <= set(root["tokens"])  # words and tags


def test_out_of_order():
    assert H.out_of_order([0, 1, 2]) == [] and H.out_of_order([]) == []
    assert H.out_of_order([0, 5, 1, 2, 3]) == [1]


def test_disordered_tokens_leave_their_class(spark):
    # "news" once a page, but now before and now after the text: no template word
    page = lambda i: f"<html><body><p>{'news' if i % 2 else ''} w{i} words{i}</p><p>{'' if i % 2 else 'news'} v{i}</p><div>Ends here always</div></body></html>"
    flip = lambda i: "<html><body><i>one</i><b>two</b></body></html>" if i % 2 else "<html><body><b>two</b><i>one</i></body></html>"
    df = spark.createDataFrame([(i, "http://o/", flip(i), 0) for i in range(10)] + [(i, "http://p/", page(i), 0) for i in range(10)], SCHEMA)
    tokens = [{t for c in json.loads(r.template) for t in c["tokens"]} for r in H.host_templates(df).collect()]
    assert all(not ({"one", "two"} <= t) and "news" not in t for t in tokens) and any({"Ends", "always", "body"} <= t for t in tokens)


def test_whole_article_without_article_tag(spark):
    page = "<html><body><div class='top'>Site</div><div class='c1'><h1>head {0}</h1><div class='b'><p>{1}</p></div><ul><li>item {0}</li></ul><blockquote>said {0}</blockquote>{2}</div>{3}<div class='menu'>x</div></body></html>"
    odd = lambda i: ("<table><tr><td>cell</td></tr></table>", "<div class='z'>after</div>") if i == 3 else ("", "")
    pages = [(i, f"http://n.example/{i}", page.format(i, "long text " * (i + 30), *odd(i)), 0) for i in range(6)]
    want = {i: " ".join(f"head {i} {'long text ' * (i + 30)} item {i} said {i} {'cell after' if i == 3 else ''}".split()) for i in range(6)}
    assert {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(pages, SCHEMA)).collect()} == want


def test_copies_on_one_host_keep_their_text(spark):
    page = "<html><body><div class='c1'><h1>head</h1><p>the same words on every page</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://s/", page, 0) for i in range(5)], SCHEMA)
    assert {r.text for r in H.extract_text(df).collect()} == {"head the same words on every page"}


@pytest.mark.parametrize("unit", ["<a ", "<b>", '<a ">" ', "<![CDATA[", "<script></script ", "<!--", "<li><i></b>"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(n):
        began = time.perf_counter()
        H.Extractor()(H.Reader(), unit * n)
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(10_000), seconds(80_000)
    assert large < 40 * small + 1  # eight times the length; quadratic would be 64 times


def test_long_name_is_read():
    assert H.Extractor()(H.Reader(), "<p>a" + "<" + "x" * 1_000_000) .startswith("a")


ARTICLE = "<h1>Title of it</h1><p>Some first words here.</p><p class='alert'>Mind the step.</p><section class='related-work'><p>Others did this before.</p></section>"
WORDS = "Title of it Some first words here. Mind the step. Others did this before."
AROUND = "<nav><a href=x>Home</a></nav><div class='site-footer'>Imprint</div><div class='ad'>Buy now</div><section class='comments'><article class='comment'><p>First!</p></article></section>"


@pytest.mark.parametrize(
    "body",
    [
        "<body class='single has-sidebar'><article>{}</article>",
        "<body class='right-sidebar single'><article>{}</article>",
        "<body class='sidebar'><main>{}</main>",
        "<body><div class='content-with-sidebar'><main>{}</main></div>",
        "<body><div class='sidebar container'><main>{}</main></div>",
        "<body><article class='post comment-open'>{}</article>",
        "<body><article id='side-effects'>{}</article>",
        "<body><main class='notice'><article class='alert'>{}</article></main>",
    ],
)
def test_a_class_around_the_article_empties_no_page(spark, body):
    page = lambda i: body.format(ARTICLE.replace("first words", f"first words {i}")) + AROUND
    alone = H.Extractor()(H.Reader(), page(0))
    assert alone == WORDS.replace("first words", "first words 0")
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert got == {i: WORDS.replace("first words", f"first words {i}") for i in range(12)}


def test_side_words_count_as_whole_classes():
    side = lambda label: bool(H.side_words(label))
    assert all(map(side, ("div.ad", "div.site-footer", "ul.main-nav", "div.cookie-notice", "div.sidebar widget", "div#comments", "div[navigation]", "div.related-posts", "div.ad_slot")))
    assert not any(map(side, ("div.content-with-sidebar", "body.has-sidebar", "article.comment-open", "p#side-effects", "section.related-work", "div.post", "div.advice", "main")))
