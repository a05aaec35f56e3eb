"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a template.  A page is a sequence of tokens: a tag's
token is its role (the path of tags, with class or id, that leads to it), a word's
token is the word within its role.  A token's *occurrence vector* holds how often
it occurs in each page of the host.

1. *Candidates.*  Only tokens on at least ``MIN_SUPPORT`` of a host's pages matter.
   Such a token is on that share of the pages of some run of pages that one task
   reads, so each run lists its own, with how often any other may have occurred;
   the sums leave few tokens more than there are.
2. *Vectors.*  A vector is a sum of hashes over (page, count), so it is aggregated
   with partial sums and never gathered: a host with a third of all pages is like
   any other.  Tokens with equal vectors form an equivalence class.
3. *Order.*  On every page the tokens that occur once are held against the order of
   their mean places; a token that stands out of it on more than ``MAX_DISORDER`` of
   the pages is in no class, so the tokens of a class keep one order.
4. *Nesting.*  A class lies in the class of the roles around it: tokens with equal
   vectors below different classes are different classes.  Classes of at least
   ``MIN_TOKENS`` tokens are valid and nest into the template.
5. *Slots.*  What varies between template tokens are slots.  The article is the
   region, opened by a tag of a valid class, that holds the slots: the outermost
   ``article`` or ``main`` of the template where there is one, else the container
   reached from the body by going into the part with most of the slots' words (words
   in links aside) until its own parts are headings, paragraphs and the like.

The text of a page is that of its region.  In a region found by slots, blocks made
of template words only and blocks of links are left out, and blocks whose role the
template doesn't know stay wherever they lie.  Roles that HTML or common class names
mark as no article text (menus, notices, comments) are left out everywhere.  Pages
of hosts with too few pages, and pages that their template doesn't fit, are read by
HTML's own roles (article or main, else the body).

Reading a page is linear in its length: roles are hashes, open elements are found by
name without a search.  Defined results: null, empty or unparsable html gives an
empty text; null urls are one host; repeated rows each get their row; ids of any
type come back unchanged; text is never cut.
"""

from __future__ import annotations

import bisect
import html as htmllib
import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.url_filters import host_of

#: A token counts as part of a template when this share of the host's pages has it,
MIN_SUPPORT = 0.5
#: and at least so many pages.
MIN_PAGES = 3
#: A valid class has so many tokens.
MIN_TOKENS = 3
#: Share of pages on which a token may stand out of its class's order.
MAX_DISORDER = 0.05
#: A region holds at least this share of the slots around it.
MIN_SHARE = 0.5
#: A role holds links where this share of its words is in links.
LINK_SHARE = 0.9
#: Bound for the broadcast of templates.
MAX_BROADCAST_BYTES = 16 << 20
SALTS = 32
MAX_HELD = 300_000
FLUSH_TOKENS = 1 << 20

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object noframes xmp".split())
CLOSES_P = BLOCK - {"br", "option", "optgroup", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY_OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_BOUNDS = tuple("ul ol menu dl table select".split())
# Roles that HTML or common class names mark as no article text.
SIDE_TAGS = frozenset("nav header footer aside form menu dialog button select".split()) | RAW | {"head"}
SIDE_WORDS = frozenset("ad ads advert advertisement adverts adbox banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead topbar notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login comment comments reply replies disqus respond related recommended share sharing social pagination pager hidden toolbar skip".split())
#: Words that may stand beside them in a class of a side part, as in ``site-footer``.
BESIDE_WORDS = frozenset("site page main top bottom left right inner outer global primary secondary mobile sticky wrapper wrap container box slot area section list links link items item bar block unit buttons button posts post articles form group panel row holder inline text body content info message google 1 2 3".split())
#: Words that name a side part even on a paragraph, and on an article within the main part; elements of text.
ADVERTS = frozenset("ad ads advert advertisement adverts adbox sponsor sponsored promo hidden".split())
COMMENTS = frozenset("comment comments reply replies disqus respond related recommended".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table tbody tr td th dl dt dd figure".split())
MAIN_TAGS = ("article", "main")
# Elements that hold blocks; any other is part of a text.
CONTAINERS = frozenset("html body div section article main center".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_VALUE = re.compile(r"=\s*[\"']|>")
_CLASS = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I | re.A) for n in RAW}
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def label_of(name: str, attrs: str) -> str:
    """An element's own part of a role: its name with class and role, else id."""
    if not attrs or "=" not in attrs:
        return name
    marks = {k.lower(): " ".join((a or b or c).split()) for k, a, b, c in _CLASS.findall(attrs)}
    if marks.get("class") or marks.get("role"):
        return name + (f".{marks['class']}" if marks.get("class") else "") + (f"[{marks['role']}]" if marks.get("role") else "")
    return name + (f"#{re.sub('[0-9]+', '0', marks['id'])}" if marks.get("id") else "")


def name_of(label: str) -> str:
    return re.split(r"[.#\[]", label, maxsplit=1)[0]


def side_words(label: str) -> set[str]:
    """Words of an element's classes, role or id that mark a side part.  A class counts
    as a whole: ``side-effects`` and ``with-sidebar`` say nothing."""
    out = set()
    for mark in re.split(r"[.#\[\]\s]+", label[len(name_of(label)) :].lower()):
        parts = set(re.split(r"[_-]+", mark))
        if parts & SIDE_WORDS and parts <= SIDE_WORDS | BESIDE_WORDS:
            out |= parts & SIDE_WORDS
    return out


#: How an element stands: in a side part by its tag, by a class, inside the page's main part.
PLAIN = (False, False, False)


def stands(around: tuple[bool, bool, bool], label: str) -> tuple[bool, bool, bool]:
    """A class makes no side part of what holds the page or its main part: ``html``,
    ``body``, the outermost ``main`` or ``article``; and a ``main`` ends what a class
    around it says.  An article inside a side part stays there."""
    tag, marked, inside = around
    name = name_of(label)
    if name == "main" and not inside:
        marked = False
    elif name not in ("html", "body") and (inside or name not in MAIN_TAGS):
        words = side_words(label) if len(label) > len(name) else set()
        telling = ADVERTS if name in TEXT_TAGS else ADVERTS | COMMENTS if name in MAIN_TAGS else words
        marked = marked or bool(words & telling)
    return tag or name in SIDE_TAGS, marked, inside or name in MAIN_TAGS


def walk(html: str, root, enter) -> Iterator[tuple[str, object, str]]:
    """Events of a page in order: ("open", state, ""), ("break", state, "") at the
    edge of a block, ("text", state, raw text).  An element's state is
    ``enter(state around it, label)``.  Linear in the page's length: an unclosed
    quote ends at the tag's first ``>``, and quotes count no more from there on."""
    names: list[str] = []
    states = [root]
    blocks = [0]  # of the elements up to each depth
    where: dict[str, list[int]] = {}
    text = pos = 0
    end, last, quotes, cdata = len(html), html.rfind(">"), True, True

    def pop_to(i: int) -> bool:
        block = blocks[-1] > blocks[i]
        while len(names) > i:
            where[names.pop()].pop()
        del states[i + 1 :], blocks[i + 1 :]
        return block

    def innermost(kinds) -> int:
        return max((where[k][-1] for k in kinds if where.get(k)), default=-1)

    while True:
        pos = html.find("<", pos)
        if pos < 0:
            break
        kind, inner = html[pos + 1 : pos + 2], None
        m = None
        if kind in ("!", "?"):
            if html.startswith("<!--", pos):
                stop = html.find("-->", pos + 4) + 3
                stop = end if stop == 2 else stop
            else:
                stop = -1
                if cdata and html.startswith("<![CDATA[", pos):
                    stop = html.find("]]>", pos + 9)
                    cdata = stop >= 0
                    inner = html[pos + 9 : stop] if cdata else None
                    stop += 3 if cdata else 0
                if stop < 0:
                    if pos > last:
                        break
                    stop = html.find(">", pos) + 1
        else:
            if pos > last:
                break
            m = _NAME.match(html, pos + 1 + (kind == "/"))
            if not m:
                pos += 1
                continue
            stop = at = m.end()
            while quotes and html[stop] != ">":
                v = _VALUE.search(html, at)
                if v and html[v.end() - 1] == ">":
                    stop = v.end() - 1
                    break
                at = html.find(html[v.end() - 1], v.end()) + 1 if v else 0
                quotes = at > 0
            if not quotes:
                stop = html.find(">", stop)
            attrs, stop = html[m.end() : stop], stop + 1
        if pos > text:
            yield "text", states[-1], html[text:pos]
        text = pos = stop
        if m is None:
            if inner:
                yield "text", states[-1], inner.replace("&", "&amp;")
            continue
        name = m[0].lower()
        if kind == "/":
            if where.get(name):
                i = where[name][-1]
                if (name in BLOCK or blocks[-1] == blocks[i + 1]) and pop_to(i):
                    yield "break", states[-1], ""
            continue
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "math"):
            if name in BLOCK:
                yield "break", states[-1], ""
            continue
        if name in CLOSES_P and where.get("p"):
            pop_to(where["p"][-1])
        if name in CLOSED_BY_OWN_KIND:
            i = innermost(CLOSED_BY_OWN_KIND[name])
            if i > innermost(LIST_BOUNDS):
                pop_to(i)
        if name in BLOCK:
            yield "break", states[-1], ""
        where.setdefault(name, []).append(len(names))
        names.append(name)
        blocks.append(blocks[-1] + (name in BLOCK))
        states.append(enter(states[-1], label_of(name, attrs)))
        yield "open", states[-1], ""
        if name in RAW:
            close = _RAW_END[name].search(html, pos)
            stop = html.find(">", close.end()) + 1 if close else 0
            text = pos = stop or end
            pop_to(len(names) - 1)
    if text < end:
        yield "text", states[-1], html[text:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Reader:
    """Tokens of pages.  A role is a tuple (hash, side, in a link, parent's hash,
    label, standing); those met are held, ``MAX_HELD`` at most."""

    ROOT = (0, False, False, 0, "", PLAIN)

    def __init__(self):
        self.roles: dict[tuple[int, str], tuple] = {}

    def enter(self, above: tuple, label: str) -> tuple:
        got = self.roles.get((above[0], label))
        if got is None:
            if len(self.roles) > MAX_HELD:
                self.roles.clear()
            h = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), seed=above[0])
            at = stands(above[5], label)
            got = (h, at[0] or at[1], above[2] or name_of(label) == "a", above[0], label, at)
            self.roles[above[0], label] = got
        return got

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        try:
            got = [*map(xxhash.xxh3_64_intdigest, words)]
        except UnicodeEncodeError:  # lone surrogates
            got = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words]
        return np.array(got, dtype=np.uint64) | np.uint64(1)

    def tokens(self, html: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple], list[str]]:
        """A page's tokens in order, their roles' hashes, which of them are words, the
        roles and the words."""
        role, times, is_word, roles, said = [], [], [], {}, []
        for kind, state, text in walk(html, self.ROOT, self.enter):
            if kind == "open":
                role.append(state[0])
                times.append(1)
                is_word.append(False)
                roles[state[0]] = state
            elif kind == "text" and (got := (htmllib.unescape(text) if "&" in text else text).split()):
                role.append(state[0])
                times.append(len(got))
                is_word.append(True)
                said += got
        n = np.array(times, dtype=np.int64)
        r, w = np.repeat(np.array(role, dtype=np.uint64), n), np.repeat(np.array(is_word, dtype=bool), n)
        token = r.copy()
        token[w] = self.token(r[w], self.hashes(said))
        return token, r, w, roles, said

    @staticmethod
    def token(role, word):
        return _mix(role + word * _GOLD)

    def block_texts(self, html: str, wanted) -> Iterator[tuple[str, tuple, np.ndarray]]:
        """(text, role, word tokens) of every block with text whose role ``wanted``
        accepts: references decoded, white space turned into one space."""
        held: list[str] = []
        roles: list[tuple] = []

        def out():
            parts = [(r, htmllib.unescape(t)) for r, t in zip(roles, held, strict=True)]
            words = "".join(t for _, t in parts).split()
            first = next((r for r, t in parts if not t.isspace()), Reader.ROOT)
            tokens = lambda: [(r[0], w) for r, t in parts for w in self.hashes(t.split()).tolist()]
            held.clear()
            roles.clear()
            return " ".join(words), first, tokens

        for kind, state, text in walk(html, self.ROOT, self.enter):
            if kind == "text":
                if wanted(state):
                    held.append(text)
                    roles.append(state)
            elif kind == "break" and held and (got := out())[0]:
                yield got
        if held and (got := out())[0]:
            yield got


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, token, pages, position, slack) from pages (host, html), for each run
    of pages of a host: the tokens on ``MIN_SUPPORT`` of them, with the number of pages
    and the sum of their first positions.  ``slack`` is how often a token that isn't
    listed may have occurred.  The row with the token null stands for the run."""
    read, held, size = Reader(), {}, 0

    def flush():
        out = []
        for host, pages in held.items():
            least = int(np.ceil(MIN_SUPPORT * len(pages)))
            every, at, n = np.unique(np.concatenate([t for t, _ in pages]), return_inverse=True, return_counts=True)
            place = np.bincount(at, np.concatenate([p for _, p in pages]))
            keep = n >= least
            token = [None, *every[keep].view(np.int64).tolist()]
            out.append((host, token, [len(pages), *n[keep].tolist()], [0.0, *place[keep].tolist()], least - 1))
        held.clear()
        flat = lambda k, kind: pa.array([x for r in out for x in r[k]], kind)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out for _ in r[1]], pa.int64()),
                flat(1, pa.int64()),
                flat(2, pa.int64()),
                flat(3, pa.float64()),
                pa.array([r[4] for r in out for _ in r[1]], pa.int64()),
            ],
            ["host", "token", "pages", "position", "slack"],
        )

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            token = read.tokens(html.as_py())[0]
            held.setdefault(host, []).append(np.unique(token, return_index=True))
            size += len(token)
            if size > FLUSH_TOKENS:
                yield flush()
                size = 0
    if held:
        yield flush()


def out_of_order(ranks: list[int]) -> list[int]:
    """Places outside of a longest increasing run of the sequence."""
    tops, at, before = [], [], []
    for i, r in enumerate(ranks):
        k = bisect.bisect_left(tops, r)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [r], [i]
    i, keep = at[-1] if at else -1, set()
    while i >= 0:
        keep.add(i)
        i = before[i]
    return [i for i in range(len(ranks)) if i not in keep]


class Measure:
    """Sums over pages for one host's candidates, given in their order."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = tokens.view(np.uint64)
        self.by = np.argsort(self.tokens)
        self.sorted = self.tokens[self.by]
        self.sums = np.zeros((7, len(tokens)), dtype=np.int64)  # v, pages, total, position, bad, words, links
        self.about: dict[int, tuple] = {}

    def places(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``token`` are candidates, and their ranks."""
        at = np.minimum(np.searchsorted(self.sorted, token), len(self.sorted) - 1)
        hit = self.sorted[at] == token
        return hit, self.by[at[hit]]

    def add(self, page: int, token, role, is_word, roles, said) -> None:
        hit, rank = self.places(token)
        place = np.flatnonzero(hit)
        met, first, n = np.unique(rank, return_index=True, return_counts=True)
        v, pages, total, position, bad, words, links = self.sums
        name = np.uint64(page % (1 << 64))
        v[met] += (_mix(name + n.astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.int64)
        pages[met] += 1
        total[met] += n
        position[met] += place[first]
        single = n == 1
        ranks, where = met[single], place[first[single]]
        inorder = np.argsort(where)
        if (np.diff(inorder) < 0).any():
            ranks = ranks[inorder]
            bad[ranks[out_of_order(ranks.tolist())]] += 1
        at, k = np.unique(role[is_word], return_counts=True)
        hit, rank = self.places(at)
        words[rank] += k[hit]
        in_link = np.array([roles.get(r, Reader.ROOT)[2] for r in at[hit].tolist()], dtype=bool)
        links[rank[in_link]] += k[hit][in_link]
        for r, i in zip(met.tolist(), place[first].tolist(), strict=True):
            if r not in self.about:
                t = int(token[i])
                word = bool(is_word[i])
                self.about[r] = (word, int(role[i]) if word else roles[t][3], said[int(is_word[:i].sum())][:64] if word else roles[t][4])

    def rows(self, host: int) -> list[tuple]:
        return [(host, _signed(int(self.tokens[r])), *self.sums[:, r].tolist(), word, _signed(parent), label) for r, (word, parent, label) in self.about.items()]


_MEASURED = pa.schema([*[(c, pa.int64()) for c in ("host", "token", "v", "pages", "total", "position", "bad", "words", "links")], ("word", pa.bool_()), ("parent", pa.int64()), ("label", pa.string())])


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_MEASURED`` from pages (host, page, html, tokens), where tokens are the
    host's candidates in their order: sums over the pages of a batch."""
    read = Reader()
    for batch in batches:
        held: dict[int, Measure] = {}
        tokens, html = batch.column("tokens"), batch.column("html")
        for i, (host, page) in enumerate(zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), strict=True)):
            if host not in held:
                held[host] = Measure(np.array(tokens[i].values))
            got = read.tokens(html[i].as_py())
            if len(got[0]):
                held[host].add(page, *got)
        rows = [r for h, m in held.items() for r in m.rows(h)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MEASURED)], schema=_MEASURED)


def nest(rows: pd.DataFrame) -> dict:
    """The template of a host from its frequent tokens (token, v, pages, total,
    position, bad, word, parent, label, words, links): valid classes with the class
    each lies in, the article's region and what is known to be no text.

    ``main``: roles of the article; ``explicit``: whether HTML names it so; ``known``:
    all frequent roles; ``fixed``: word tokens of valid classes; ``links``: roles that
    hold links.
    """
    rows = rows[rows["bad"] <= MAX_DISORDER * rows["pages"]]
    rows = rows.sort_values(["word", "position", "token"], kind="stable")
    tags = {r.token: r for r in rows.itertuples() if not r.word}

    def above(parent: int) -> list[int]:
        out = []
        while parent in tags:
            out.append(parent)
            parent = tags[parent].parent
        return out

    # outermost first: a token joins the class around it if their vectors are equal,
    # else the class of its vector that lies there
    home: dict[int, tuple] = {}
    template: dict[tuple, dict] = {}
    depth = {t: len(above(t)) for t in tags}
    for r in sorted(rows.itertuples(), key=lambda r: (r.word, depth.get(r.token, 0), r.position, r.token)):
        around = home.get(r.parent)
        key = (r.v, r.pages, r.total)
        name = around if around and around[0] == key else (key, around and around[0])
        home[r.token] = name
        template.setdefault(name, {"in": around if around != name else None, "tokens": []})["tokens"].append(r)
    valid = {k: c for k, c in template.items() if len(c["tokens"]) >= MIN_TOKENS}
    ok = {r.token for c in valid.values() for r in c["tokens"]}
    fixed = {r.token for c in valid.values() for r in c["tokens"] if r.word}
    side = {t for t in tags if any(reduce(lambda at, x: stands(at, tags[x].label), reversed(above(t)), PLAIN)[:2])}
    words = {t: 0 if t in side else max(0, r.words - r.links) for t, r in tags.items()}
    for c in valid.values():
        for r in c["tokens"]:
            if r.word and r.parent in words:
                words[r.parent] = max(0, words[r.parent] - r.total)
    below = dict.fromkeys(tags, 0)
    for t, n in words.items():
        for x in above(t):
            below[x] += n
    children: dict[int, list[int]] = {}
    for t, r in tags.items():
        children.setdefault(r.parent if r.parent in tags else 0, []).append(t)
    named = [t for t in ok & tags.keys() - side if name_of(tags[t].label) in MAIN_TAGS]
    outer = [t for t in named if not any(x in named for x in above(t)[1:])]
    once = {t for t in ok & tags.keys() - side if tags[t].total == tags[t].pages and name_of(tags[t].label) in CONTAINERS}
    region = max((t for t in children.get(0, []) if t in once), key=lambda t: below[t], default=None)
    while region is not None:
        inside = [t for t in children.get(region, []) if below[t]]
        if words[region] or any(name_of(tags[t].label) not in CONTAINERS for t in inside):
            break
        best = max((t for t in inside if t in once), key=lambda t: (below[t], -t), default=None)
        if best is None or below[best] < MIN_SHARE * below[region]:
            break
        region = best
    main = sorted(outer) if outer else [region] if region is not None and below[region] else []
    # links of everything below a role that is no container
    all_words, all_links = dict.fromkeys(tags, 0), dict.fromkeys(tags, 0)
    for t, r in tags.items():
        for x in above(t):
            all_words[x] += r.words
            all_links[x] += r.links
    links = sorted(t for t in tags if all_words[t] and all_links[t] >= LINK_SHARE * all_words[t])
    return {"classes": valid, "main": main, "explicit": bool(outer), "known": sorted(tags), "fixed": sorted(fixed), "links": links}


class Extractor:
    """Main text of pages, given the template of their host."""

    def __init__(self, main=(), explicit=False, known=(), fixed=(), links=()):
        self.main, self.known, self.fixed, self.links = ({x % (1 << 64) for x in xs} for xs in (main, known, fixed, links))
        self.explicit = explicit

    def __call__(self, read: Reader, html: str | None) -> str:
        """The text of a page's region, else of HTML's own, else of all but side roles."""
        if not html:
            return ""
        above = {}  # role around each role of the page
        region, named = {0: False}, {0: False}

        def enter(around, label):
            got = read.enter(around, label)
            above[got[0]] = around
            region[got[0]] = region[around[0]] or got[0] in self.main
            named[got[0]] = named[around[0]] or name_of(label) in MAIN_TAGS
            return got

        def is_text(role, tokens) -> bool:
            if self.explicit:
                return True
            block = role
            while block[0] and name_of(block[4]) not in BLOCK:
                block = above[block[0]]
            if role[0] in self.links or block[0] in self.links:
                return False
            r, w = (np.array(x, dtype=np.uint64) for x in zip(*tokens(), strict=True))
            return not all(t in self.fixed for t in Reader.token(r, w).tolist())

        reader = _With(enter)
        text = lambda wanted: " ".join(t for t, _, _ in reader.block_texts(html, wanted))
        if self.main:
            inside = lambda r: not r[1] and (region[r[0]] or not (self.explicit or r[0] in self.known))
            if got := " ".join(t for t, r, tokens in reader.block_texts(html, inside) if is_text(r, tokens)):
                return got
        return text(lambda r: not r[1] and named[r[0]]) or text(lambda r: not r[1])


class _With(Reader):
    """A reader that names roles by ``enter``."""

    def __init__(self, enter):
        self.enter = enter


def _beside(rows: DataFrame, by_host: DataFrame, n_bytes: int, max_bytes: int) -> DataFrame:
    """``rows`` with their host's row: broadcast up to ``max_bytes``, else each row
    takes one of ``SALTS`` copies, so that a hot host is spread."""
    if n_bytes <= max_bytes:
        return rows.join(F.broadcast(by_host), "host", "left")
    salted = by_host.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def host_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``host`` (its hash), ``n_pages``, main, explicit, known, fixed, links and
    template (JSON) for every host with enough pages for a template."""
    # A page is named by its content: a task that runs again gives it the same name.
    rows = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"), F.xxhash64(url_col, html_col).alias("page")).where("html is not null")
    seen = rows.select("host", "html").mapInArrow(candidates, "host long, token long, pages long, position double, slack long")
    summed = written(seen.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("position").alias("position"), F.sum("slack").alias("slack")))
    hosts = summed.where("token is null").select("host", F.col("pages").alias("n_pages"), F.col("slack").alias("most")).where(F.col("n_pages") >= MIN_PAGES)
    n_hosts = hosts.count()
    # what may be on enough pages: the pages met and, in the other runs, all that may have been passed over
    enough = lambda n: n >= F.greatest(F.lit(float(MIN_PAGES)), MIN_SUPPORT * F.col("n_pages"))
    beside = summed.where("token is not null").join(F.broadcast(hosts) if 40 * n_hosts <= max_broadcast_bytes else hosts, "host")
    likely = beside.where(enough(F.col("pages") + F.col("most") - F.col("slack"))).select("host", "token", (F.col("position") / F.col("pages")).alias("position"))
    gathered = likely.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("position", "token"))).alias("x"))
    plan = written(gathered.select("host", F.col("x.token").alias("tokens")))
    size = plan.agg(F.sum(8 * F.size("tokens") + 40)).first()[0] or 0
    measured = _beside(rows, plan, size, max_broadcast_bytes).where("tokens is not null").select("host", "page", "html", "tokens").mapInArrow(measure, "host long, token long, v long, pages long, total long, position long, bad long, words long, links long, word boolean, parent long, label string")
    whole = measured.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("v", "pages", "total", "position", "bad", "words", "links")], *[F.max(c).alias(c) for c in ("word", "parent", "label")])
    whole = whole.join(hosts.select("host", "n_pages"), "host").where(enough(F.col("pages"))).withColumn("position", F.col("position") / F.col("pages"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = nest(pdf)
        number = {k: i for i, k in enumerate(t["classes"])}
        lines = [{"class": number[k], "in": number.get(c["in"]), "pages": k[0][1], "each": k[0][2] / k[0][1], "tokens": [r.label for r in c["tokens"]]} for k, c in t["classes"].items()]
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "n_pages": pdf["n_pages"].iloc[:1], **{c: [t[c]] for c in ("main", "explicit", "known", "fixed", "links")}, "template": [json.dumps(lines)]})

    return whole.groupBy("host").applyInPandas(build, "host long, n_pages long, main array<long>, explicit boolean, known array<long>, fixed array<long>, links array<long>, template string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per page: ``id_col``, url, text, n_chars."""
    templates = written(host_templates(pages, url_col, html_col, max_broadcast_bytes).drop("n_pages", "template"))
    size = templates.agg(F.sum(8 * (F.size("main") + F.size("known") + F.size("fixed") + F.size("links")) + 64)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.xxhash64(url_col, html_col).alias("page"))
    joined = _beside(rows, templates, size, max_broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held = Reader(), {}
        for batch in batches:
            cols = [batch.column(c) for c in ("host", "html", "main", "explicit", "known", "fixed", "links")]
            texts = []
            for i, host in enumerate(cols[0].to_pylist()):
                if host not in held:
                    if len(held) > 1000:
                        held.clear()
                    held[host] = Extractor(*[c[i].as_py() for c in cols[2:]]) if cols[2][i].is_valid else Extractor()
                texts.append(held[host](read, cols[1][i].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    id_type = pages.schema[id_col].dataType.simpleString()
    got = joined.select("id", "url", "html", "host", "main", "explicit", "known", "fixed", "links").mapInArrow(run, f"id {id_type}, url string, text string")
    return got.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
