"""Each operator against brute force or its library, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import struct
import time
import zlib

import numpy as np
import pytest

import public_tokenizers
from netloom.llm import common, components, decontamination, jaccard_join, license_scan, quality_rules, sentencepiece_codec, token_counts, token_output, url_filters, warc

LONG = "word " * 30_000
BIG = (1 << 62) + 1
DOCS = "doc_id long, text string, lang string, id string, n int, k int, name string, m string"


def rows(*texts):
    return [(i, t, "en", "x", 1, 2, "y", "z") for i, t in enumerate(texts)]


ODD = rows(None, "", " ", "\n\n", "a", "a", "don't stop", "x" * 50_000, LONG, "ÀÉÎ ñandú 漢字　かな\xa0\x85 ", "<|endoftext|> <s> ▁ \x00\x1c \U0001f600", "a b c d e", "a  b\tc\r\nd", "one two three four five six " * 40)


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(None, "null id text here and more words to see", "en", "x", 1, 2, "y", "z"), (3, "\n\n", "en", "x", 1, 2, "y", "z")]
    return spark.createDataFrame(ODD + extra, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_measures(spark, odd, none):
    got = quality_rules.quality_measures(odd).collect()
    by_text = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        t = by_text[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cov = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov))
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_measures(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_quality_rules_reject_and_keep(spark):
    prose = "the cat sat on the mat and looked at a bird that was in the tree near this old house by the sea"
    df = spark.createDataFrame(rows(prose, prose.replace(" ", "%%% "), " ".join(w.upper() + "!!" for w in prose.split()), "\n".join([prose] * 9)), DOCS)
    assert [r.kept for r in quality_rules.quality_measures(df).orderBy("doc_id").collect()] == [True, False, False, False]
    assert [r.doc_id for r in quality_rules.keep_good(df).collect()] == [0]


def test_stop_words_judge_their_own_languages_only(spark):
    text = " ".join(f"слово{i} и ещё" for i in range(30))
    rows = [(i, text, lang) for i, lang in enumerate(("ru", None, "en", "EN", "pl"))]
    got = quality_rules.quality_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()
    assert [r.kept for r in got] == [True, True, False, False, True] and got[2].reasons == ["stop_words"]
    assert quality_rules.quality_measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().kept
    assert [r.doc_id for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).orderBy("doc_id").collect()] == [0, 1, 4]


def test_warc_round_trip(spark):
    big = "é" * 200
    data = [(1, "http://a/?q=1", big, 0), (2, None, big, 0), (3, "u\r\nv", None, 0), (None, "n", big, 0), (5, "b", "short", 0), (6, "b", "short", 0), (1, "http://a/?q=1", big, 0)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, payload int")
    for most in (warc.MAX_BROADCAST_ROWS, -1):
        path = common.shared_dir(spark)
        warc.register(spark)
        warc.revisits(df, max_broadcast_rows=most).write.format("warc").mode("append").option("path", path).option("maxFileBytes", "500").save()
        got = warc.read_archive(spark, path).collect()
        assert collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got) == collections.Counter([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (3, "response", None), (5, "response", None), (6, "response", None)])
        for r in got:
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_length
        assert {r.target_uri for r in got} == {"http://a/?q=1", None, "u%0D%0Av", "n", "b"}
    only = warc.read_archive(spark, path).where("record_type = 'revisit' and page_id > 1")
    assert not re.search(r"\bFilter\b", only._jdf.queryExecution().executedPlan().toString()) and only.count() == 1
    assert warc.read_archive(spark, warc.write_archive(df.limit(0))).count() == 0


def test_warc_reader_skips_payloads(tmp_path):
    f = tmp_path / "a.warc.gz"
    f.write_bytes(b"".join(warc.gzip_member(warc.record_bytes(i, "u", b"x" * 9000, "response", "d", None, "now")) for i in range(3)))
    import gzip

    assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1") == 3  # any gzip reader can read it
    with f.open("rb") as g:
        got = [*warc.read_records(g, [("=", "page_id", 1)], payload=False)]
    assert [r["page_id"] for r in got] == [1] and "payload" not in got[0]


def test_warc_long_header_and_foreign_archives(spark, tmp_path):
    import gzip

    url = "http://x/" + "a" * 100_000
    df = spark.createDataFrame([(BIG, url, "body " * 50), (None, "u", "b")], "page_id long, url string, html string")
    path = warc.write_archive(df)
    got = {r.page_id: (r.target_uri, bytes(r.payload)) for r in warc.read_archive(spark, path).collect()}
    assert got == {BIG: (url, b"body " * 50), None: ("u", b"b")}
    warc.revisits(df.limit(1)).write.format("warc").mode("append").option("path", path).save()
    assert warc.read_archive(spark, path).count() == 3
    records = [warc.record_bytes(i, url, b"p" * i * 9000, "response", "d", None, "now") for i in range(3)]
    for name, data in (("a.warc.gz", b"".join(map(gzip.compress, records))), ("b.warc", b"".join(records))):
        (tmp_path / name).write_bytes(data)
        one = warc.read_archive(spark, str(tmp_path / name)).where("page_id <> 1").collect()
        assert [(r.page_id, len(r.payload), r.target_uri == url) for r in one] == [(0, 0, True), (2, 18000, True)]
    assert warc.read_archive(spark, str(tmp_path)).count() == 6


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1000 + i + 1) for i in range(60)] + [(5000, i) for i in range(6000, 6400)] + [(7, 7), (None, 3), (3, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


RULES = (url_filters.UrlRule("allow", "com"), url_filters.UrlRule("block", "bad.org", "/x/"), url_filters.UrlRule("block", "a.com", "/en/"), url_filters.UrlRule("allow", "www.a.com", "/en/"))


def test_url_filters(spark):
    link = '<link rel="canonical" href="{}">'
    data = [
        (1, "HTTP://WWW.A.com/en/z?q#f", ""), (2, "https://b.a.com/en/", None), (3, None, "x"), (4, "no scheme", "x"), (5, "http://xa.com/en/", ""),
        (6, "https://one.net/p", link.format("/q")), (7, "http://one.net/q", "<meta http-equiv='refresh' content='0; url=http://t.bad.org/x/y'>"),
        (8, "http://ok.com/", link.format("http://one.net/q")), (9, "http://two.net/?a=1", link.format("//three.net/r")), (10, "http://three.net/r", ""), (6, "https://one.net/p", link.format("/q")),
        (11, "http://bad.org", ""), (12, "ftp://bad.org/x/", ""), (13, "http://com/", ""),
    ]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, RULES).collect())
    want = [
        (1, "www.a.com", "/en/z", "www.a.com/en/", "allow"), (2, "b.a.com", "/en/", "a.com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "xa.com", "/en/", "com/", "allow"),
        (6, "one.net", "/p", None, "block"), (6, "one.net", "/p", None, "block"), (7, "one.net", "/q", None, "block"), (8, "ok.com", "/", "com/", "allow"), (9, "two.net", "/", None, "allow"), (10, "three.net", "/r", None, "allow"),
        (11, "bad.org", "", None, "allow"), (12, "bad.org", "/x/", "bad.org/x/", "block"), (13, "com", "/", "com/", "allow"),
    ]
    assert got == collections.Counter(want)
    moved = spark.createDataFrame([("http://three.net/r", "http://bad.org/x/1")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(df, RULES, redirects=moved).collect()}
    assert got[9] == got[10] == "block"
    plan = url_filters.judge_urls(df, RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert url_filters.judge_urls(df.limit(0), RULES).count() == 0


def test_linked_pages_like_brute_force(spark):
    """Links of every form, resolved by the standard library and joined by a plain union."""
    from urllib.parse import urljoin

    rng = random.Random(11)
    hosts = ["a.com", "www.a.com", "bad.org", "one.net", "two.net", "x.org", "y.org"]
    some = lambda: "/".join(rng.choice(["en", "x", "q", "p", "..", "."]) for _ in range(rng.randrange(1, 4)))
    data, edges = [], []
    for i in range(800):
        url = f"http://{rng.choice(hosts)}/{rng.choice(['en', 'x', 'q'])}/{rng.randrange(40)}" + rng.choice(["", "?k=1", "#f"])
        base, html = url, "<p>none</p><!-- <link rel=canonical href='http://bad.org/x/9'> --><script>'<link rel=canonical href=http://bad.org/x/8>'</script>"
        if rng.random() < 0.2:
            folder = rng.choice(["/x/", "//two.net/q/", "sub/"])
            base, html = urljoin(url, folder), html + f"<base target=_top href='{folder}'>"
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            link = rng.choice([f"/{some()}/{rng.randrange(40)}", f"{some()}", "?k=2&l=3", f"../x/{rng.randrange(40)}", f"//{rng.choice(hosts)}/x/{rng.randrange(40)}", f"https://{rng.choice(hosts)}/q/./{rng.randrange(40)}", "#top", "mailto:x@bad.org"])
            shape = rng.choice(['<link rel="alternate canonical" href="{}">', "<LINK data-href='http://bad.org/x/7' HREF={} rel=Canonical>", "<link title='rel=next > href=/no' rel='canonical'\n href=' {} '/>", '<meta http-equiv="Refresh" content="0; URL={}">', "<meta content='3;{}' http-equiv=refresh>"])
            html += shape.format(link.replace("&", "&amp;"))
            if link[0] != "#" and not link.startswith("mailto"):
                edges.append((url, urljoin(base, link)))
        data.append((i, url, html + "<link rel=next href=/x/1>"))

    def key(u):
        host, rest = u.split("://")[1].split("#")[0].split("/", 1)
        return urljoin(f"http://{host}/", "/" + rest).split("://")[1]

    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    def rule(k):
        host, path = k.split("/", 1)[0], "/" + k.split("/", 1)[1].split("?")[0]
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.text)).verdict if fit else None

    for a, b in edges:
        root[find(key(a))] = find(key(b))
    bad = {find(k) for k in [*root] if rule(k) == "block"}
    want = {i: rule(key(u)) or ("block" if key(u) in root and find(key(u)) in bad else "allow") for i, u, _ in data}
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(df, RULES).collect()}
    assert got == want
    assert sum(v == "block" and rule(key(u)) is None for (i, u, _), v in zip(data, want.values())) > 20


def test_links_of_odd_pages(spark):
    """Pages of a million characters that never close a tag, a quote or a comment end at once."""
    n = 1_000_000
    pages = [f"{x * (n // len(x))}" for x in ("<link ", "<link '", '<link "\'', "<!--", "<script ", "<meta " + "a" * 994, "<link " + " " * 994)] + ["", None]
    df = spark.createDataFrame([(f"http://h.org/{i}", p, "x") for i, p in enumerate(pages)], "url string, html string, dst string")
    began = time.time()
    assert url_filters.links_in(df).count() == 0
    assert time.time() - began < 30


def test_license_scan(spark):
    filler = [f"some {w} prose about nothing that matters here" for w in "red green blue old new big small".split()]
    texts = [*filler, "intro\nLicensed under the Apache License, Version 2.0.\nend", "MIT\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "under the License of nobody", "the terms of the public version license general", None, "", "x " * 20_000]
    df = spark.createDataFrame(rows(*texts), DOCS)
    got = {r.doc_id: r.families for r in license_scan.document_licenses(df).collect()}
    assert got == {7: "apache-2.0", 8: "mit", 9: "gpl-3.0", 10: "cc-by-nc-4.0"}
    plan = license_scan.document_licenses(df)._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEvalPython" not in plan and "MapInPandas" not in plan


def hit_by_brute_force(text, items, n=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(n, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if size and tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, odd, none):
    rng = random.Random(2)
    vocab = ["alpha", "Beta", "gamma", "délta", "42"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([3, 13, 14, 30]))) for i in range(12)] + [(99, None), (98, "..."), (97, "a b c d e")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [text(rng.randrange(60)) for _ in range(40)] + [f"pre-{items[0][1].upper()}!post", "x " * 400 + items[1][1]]
    docs = spark.createDataFrame(rows(*texts), DOCS).unionByName(odd)
    source = collections.Counter((r.doc_id, *map(str, hit_by_brute_force(r.text, items))) for r in docs.collect())
    for most in (decontamination.MAX_BROADCAST_BYTES, 200):  # one broadcast block, then several
        got = decontamination.scan(docs, bench, max_broadcast_bytes=most).collect()
        assert collections.Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"]), str(r.contaminated)) for r in got) == source
    kept = decontamination.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in source.items() if k[-1] == "False")
    cut = decontamination.remove_contaminated(docs, bench, mode="spans")
    assert cut.count() == docs.count() and decontamination.scan(cut.where("text like 'pre%'"), bench).first().n_hit == 0
    big = spark.createDataFrame([(BIG, "a b c d e"), (None, "x")], "doc_id long, text string")
    for most in (decontamination.MAX_BROADCAST_BYTES, 200):
        assert {(r.doc_id, r.n_hit) for r in decontamination.scan(big, bench, max_broadcast_bytes=most).collect()} == {(BIG, 5), (None, 0)}
        assert [r.doc_id for r in decontamination.remove_contaminated(big, bench, max_broadcast_bytes=most).collect()] == [None]
    assert decontamination.scan(none, bench).count() == 0 and decontamination.scan(odd, bench.limit(0)).count() == odd.count()


def shingles(t):
    w = (t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, odd, none, block):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(9):  # near copies with up to 4 changed words
            c = [*b]
            for _ in range(rng.randrange(5)):
                c[rng.randrange(len(c))] = f"v{rng.randrange(9999)}"
            texts.append(" ".join(c))
    texts += texts[:5] + [" ".join(base[0][:60] + base[1][:60]), "few words here", "few  words here"]
    docs = spark.createDataFrame(rows(*texts), DOCS)
    sets = [shingles(t) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    links, root = collections.Counter(), {i: i for i in first.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([*first.items()], 2):
        if a[0] and b[0] and 10 * len(a[0] & b[0]) >= 8 * len(a[0] | b[0]):
            links[a[1]] += 1
            links[b[1]] += 1
            x, y = sorted((find(a[1]), find(b[1])))
            root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links, r.cluster_id) for r in jaccard_join.jaccard_join(docs, block=block).collect()}
    assert got == {i: (first[s], links[first[s]], find(first[s])) for i, s in enumerate(sets)}
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == {find(i) for i in first.values()}
    if block == 512:
        assert jaccard_join.jaccard_join(odd).count() == odd.count()
        assert jaccard_join.jaccard_join(none).count() == 0
        kept = jaccard_join.keep_one(odd)
        assert kept.columns == odd.columns and kept.where("doc_id = 3").count() <= 1


def test_keep_one_without_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    data = [(None, one), (None, two), (None, two), (None, three), (5, three), (7, one + " more"), (9, "alone in this text"), (9, "another text with that id"), (9, "alone in this text")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = collections.Counter(map(tuple, jaccard_join.keep_one(df).collect()))
    assert got == collections.Counter([(None, two), (5, three), (7, one + " more"), (9, "alone in this text"), (9, "another text with that id")])
    assert jaccard_join.keep_one(df.limit(0)).count() == 0


def test_forest():
    assert jaccard_join.least_depth(0.8, 40, 12, 0.9999) == 7
    with pytest.raises(ValueError):
        jaccard_join.least_depth(0.8, 1, 12, 0.9999)
    rng = np.random.default_rng(3)
    forest, met, recall = jaccard_join.Forest(40, 12, 7), collections.Counter(), 400
    for _ in range(recall):  # pairs with a similarity of exactly 0.8
        u = rng.integers(0, 1 << 64, 100, dtype=np.uint64)
        (a, deep_a), (b, deep_b) = forest.file(u[:90]), forest.file(np.concatenate((u[:80], u[90:])))
        for depth in (7, 9, 12):
            met[depth] += bool(((a == b) & (deep_a >> 12 * (12 - depth) == deep_b >> 12 * (12 - depth))).any())
    for depth in (7, 9, 12):
        assert abs(met[depth] / recall - (1 - (1 - 0.8**depth) ** 40)) < 0.05
    assert met[7] >= 0.995 * recall
    for n in (1, 3, 5000):
        s = jaccard_join.Signature(480)(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert len(s) == 480 and len(set(s.tolist())) > 400


def test_relative_texts_compare_like_sets():
    rng = np.random.default_rng(5)
    pivot = np.unique(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
    sets = [pivot]
    for k in range(40):
        keep = pivot[rng.random(60) < (0.95 if k % 4 else 0.3)]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 1 << 64, int(rng.integers(0, 8)), dtype=np.uint64)))))
    texts = [jaccard_join.relative_to(pivot, i, s) for i, s in enumerate(sets)]
    assert {t.relative for t in texts} == {True, False}
    want = {(i, j) for i, j in itertools.combinations(range(41), 2) if 10 * len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))}
    assert {(a, b) for i, j, _ in jaccard_join.compare(texts, None, 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
    cross = {(a, b) for i, j, _ in jaccard_join.compare(texts[:15], texts[15:], 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert cross == {(i, j) for i, j in want if i < 15 <= j}


def test_prefix_is_shortened_only_as_far_as_needed(spark):
    assert jaccard_join.descend({12: 990, 9: 9, 7: 1}, 7, 12, 0.99) == 12
    assert jaccard_join.descend({12: 990, 9: 9, 7: 1}, 7, 12, 0.999) == 9
    assert jaccard_join.descend({12: 990, 9: 9, 7: 1}, 7, 12, 0.9999) == 7
    base = [f"w{i * 7919 % 5000}" for i in range(400)]
    near = [" ".join([*base[:-1], f"end{i}"]) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near)], "doc_id long, text string")
    got = []
    real = jaccard_join.descend
    jaccard_join.descend = lambda *a: got.append(real(*a)) or got[-1]
    try:
        rows = jaccard_join.jaccard_join(docs).collect()
    finally:
        jaccard_join.descend = real
    assert got == [12] and all(r.n_links == 5 and r.cluster_id == 0 for r in rows)


SP = public_tokenizers.path("piece_bpe_32k.model")


def library_ids(t):
    return sentencepiece_codec.codec(SP).sp.encode(t or "")


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_sentencepiece(spark, odd, none, chunk):
    joined = "".join(f"{w}tion" for w in "the quick brown fox jumps over lazy dogs while singing".split()) * 40
    docs = odd.unionByName(spark.createDataFrame([(500, joined, "en", "x", 1, 2, "y", "z"), (501, "   " + joined + "    end  ", "en", "x", 1, 2, "y", "z")], DOCS))
    want = collections.Counter((r.doc_id, tuple(library_ids(r.text))) for r in docs.collect())
    out = sentencepiece_codec.encode(docs, SP, chunk_chars=chunk, carry=("lang", "text"))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want
    back = sentencepiece_codec.decode(out.withColumnRenamed("text", "given"), SP).collect()
    assert all(r.text == (r.given or "").replace("▁", " ") for r in back)
    assert sentencepiece_codec.encode(none, SP).count() == 0


def test_sentencepiece_chunks_at_random():
    c = sentencepiece_codec.codec(SP)
    rng = random.Random(11)
    parts = [" ", "  ", "the", "tion", "er", "a", "Z", "é", "漢", "\n", ".", "12", "▁", "😀", "ing"]
    for k in range(400):
        t = c.normal("".join(rng.choices(parts, [0.1 if k % 3 == 0 and p.isspace() else 1 for p in parts])[0] for _ in range(rng.randrange(1, 40))))
        cuts, m = sentencepiece_codec.cut_points(t, rng.choice([1, 2, 3, 7, 20])), c.longest + 1
        n = len(cuts) - 1
        ch = [sentencepiece_codec.Chunk(c, t[max(0, a - m) : z + m], a - max(0, a - m), z - max(0, a - m), i == 0, i == n - 1) for i, (a, z) in enumerate(itertools.pairwise(cuts))]
        s = sentencepiece_codec.settle([x.matrix() for x in ch]) if n > 1 else []
        got = b"".join(x.backtrace(x.entry()[a], x.exit()[b]) for x, a, b in zip(ch, [0, *s], [*s, 0], strict=True))
        assert np.frombuffer(got, "<u2").tolist() == c.sp.encode(t[1:].replace("▁", " "))


BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk", [1 << 18, 37])
def test_token_counts(spark, odd, none, chunk):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = collections.Counter((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, BYTE, chunk_chars=chunk).collect())
    assert got == want
    assert token_counts.token_counts(none, BYTE).count() == 0


def test_giant_chunks(spark):
    giants = spark.createDataFrame([(5, "a b c " * 9), (6, "d e f " * 9)], "row long, text string").repartition(3)
    got = collections.defaultdict(dict)
    for r in token_counts.giant_chunks(giants, 10).collect():
        got[r.row][r.k] = r.chunk
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in got.items()} == {5: "a b c " * 9, 6: "d e f " * 9}


def test_giant_without_white_space(spark):
    t = token_counts.CountTransducer(BYTE)
    text = "".join(random.Random(8).choices(["ab", "the", "xyz", "9"], k=3000))
    df = spark.createDataFrame([(BIG, text), (None, "w " * 500), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, BYTE, chunk_chars=100).collect()}
    assert got == {(BIG, t.count(text)), (None, t.count("w " * 500)), (None, 0)}


def test_transducer_forgets_states():
    rng = random.Random(6)
    small, large = token_counts.CountTransducer(BYTE, max_states=40), token_counts.CountTransducer(BYTE)
    for _ in range(200):
        x = "".join(rng.choices("abcd 'st\n<|1é", k=60))
        assert small.count(x) == large.count(x)
        assert len(small.states) <= 40
    key, n = large.step(("letters", large.read((), "th")[0]), "e")
    assert n == 0 and key[0] == "letters"  # "th" and "the" are one token each


PARTS = [" ", "\n", "\t", "'", "s", "re", "a", "Z", "É", "é", "1", "<|endoftext|>", "!", "　", "\r", "\x1c", "\x85", "漢", "  ", "\x00", "İ", "Σ", "ß", "\xa0", "<|", "tion", "the", "'ll", "'v", "xx", "==", "<|endof", "\U0001f600", "²", "ʼ"]


def test_transducer_like_library():
    from tokenizers import Tokenizer

    rng, machine, library = random.Random(1), token_counts.CountTransducer(BYTE), Tokenizer.from_file(BYTE)
    for _ in range(3000):
        x = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        assert machine.count(x) == len(library.encode(x, add_special_tokens=False).ids), repr(x)
    with pytest.raises(ValueError):
        token_counts.CountTransducer(WORD)


def test_pieces_like_library():
    rng, word = random.Random(1), token_output.TextEncoder(WORD, "<u2")
    for _ in range(1500):
        x = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        assert np.frombuffer(word(x), "<u2").tolist() == word.bpe.tokenizer.encode(x, add_special_tokens=False).ids, repr(x)


def test_state_maps_compose_associatively():
    m = token_counts.CountTransducer(BYTE)
    text = "the quick  brown\nfox don't <|endoftext|> jump " * 6
    maps = [m.state_map(c) for c in token_counts.chunks_of(text, 7)]
    left = maps[0]
    for x in maps[1:]:
        left = m.compose(left, x)
    assert m.total(m.scan(maps)) == m.total(left) == m.count(text)


def test_token_output(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    manifest = token_output.write_token_records(odd, WORD)
    got = token_output.read_token_records(manifest).orderBy("start").collect()
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    at = 0
    for r in got:
        ids = np.array(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids) and ids[-1] == 2 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    want = collections.Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    assert collections.Counter((r.key, tuple(r.ids)) for r in got) == want
    shard = manifest.orderBy("shard").first()
    key, ids = token_output.read_record_at(shard.base, shard.path, shard.n_records - 1)
    assert any(key == r.key and list(ids) == r.ids for r in got)
    big = spark.createDataFrame([(BIG, "a b"), (None, "c"), (-(2**63), "d")], "doc_id long, text string")
    many = token_output.write_token_records(big, WORD, max_shard_bytes=1)
    assert many.count() == 3 and [r.key for r in token_output.read_token_records(many).orderBy("start").collect()] == [None, -(2**63), BIG]
    assert token_output.read_token_records(token_output.write_token_records(none, WORD)).count() == 0


def test_damaged_records_are_found():
    import io

    data = token_output.frame(b"abcdefgh" * 3)
    assert token_output.read_frame(io.BytesIO(data)) == b"abcdefgh" * 3 and token_output.read_frame(io.BytesIO(b"")) is None
    for i in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            token_output.read_frame(io.BytesIO(bytes(bad)))
    assert struct.unpack("<Q", data[:8])[0] == 24


def test_models_of_another_kind_are_refused(monkeypatch):
    import sentencepiece

    class Unigram(sentencepiece.SentencePieceProcessor):
        def get_score(self, i):
            return -1.5

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError, match="unigram"):
        sentencepiece_codec.Codec(SP)
