"""Phrase collocations against a plain count."""

import collections
import random
import re

import pytest

from netloom.llm import collocations

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, phrase string, a int, f int, rank int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count=10, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = set()
    for lang, found in f.items():
        often = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        ranked = []
        for p, a in often.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in often.items()):
                continue
            score, k = min((1000000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize("how", [{}, {"run_words": 50}, {"run_words": 7, "shards": 1}, {"map_bits": 10, "shards": 9}])
def test_equals_a_plain_count(spark, how):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    want = plain([(r.lang, r.text) for r in docs.collect()])
    got = collocations.collocations(docs, **how).collect()
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_odd_rows_ties_and_scores_past_64_bits(spark):
    rng = random.Random(3)
    words = ["a", "B", "é", "\xa0x", "\x00", "日本", "don't", "-"]
    texts = [None, "", " ", "...", "\n\t\r", "a b c " * 4000, "x" * 70_000 + " y"] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", "\x0b"]) for _ in range(60)) for _ in range(80)]
    rows = [(rng.choice([None, i]), t, rng.choice(["en", None, "und", ""]), "p", 1, 2, 3) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"run_words": 11}):
        got = collocations.collocations(docs, **how).collect()
        assert {tuple(r) for r in got} == plain([(r[2], r[1]) for r in rows]) and got
    assert collocations.collocations(docs, top=3).groupBy("lang").count().where("count > 3").isEmpty()
    assert collocations.collocations(docs.limit(0)).isEmpty()


def test_a_long_text_is_read_in_steps(monkeypatch):
    monkeypatch.setattr(collocations, "STEP", 16)
    text = b"one two, three\tfour " * 20 + b"z" * 100 + b" end. last"
    got = [w for step in collocations.tokens(text) for w in step]
    assert got == text.replace(b",", b" . ").replace(b"end.", b"end .").split() + [b"."]


def test_large_vocabularies_renumber_phrases(spark):
    run = collocations.Run("en", 4)
    run.add([b"w%d" % (i % 300_000) for i in range(600_000)] + [b"."])
    lengths = [*run.counts()]
    assert [len(c) for _, _, c in lengths] == [300_000] * 4
    assert all(c.sum() == 600_000 - k for k, (_, _, c) in enumerate(lengths))
    assert run.strings(lengths[3][1][:, :1])[0].split()[0].startswith(b"w")


def test_local_support_misses_nothing():
    for shards in range(1, 30):
        assert shards * (collocations.local_support(10, shards) - 1) < 10
