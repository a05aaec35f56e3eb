"""Conversation repair against all edit strings and against plain dynamic programming."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest

from netloom.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, conv string, seq int"


def every_string(codes):
    """Cheapest and then least of all strings with at most two insertions in a place."""
    best = (math.inf, "")
    for kept in itertools.product("DKR", repeat=len(codes)):
        for ins in itertools.product((0, 1, 2), repeat=len(codes) + 1):
            text = "".join("I" * n + e for n, e in itertools.zip_longest(ins, kept, fillvalue=""))
            roles, cost, rows = "", 0, iter(codes)
            final = len([e for e in text if e != "D"])
            given = lambda: "u" if (len(roles) - final % 2) % 2 == 0 else "a"  # noqa: B023,E731
            for e in text:
                if e == "I":
                    roles, cost = roles + given(), cost + 5
                    continue
                initial, gone, more = next(rows)
                if e == "D":
                    cost += 2
                elif gone:
                    cost = math.inf
                else:
                    roles, cost = roles + (initial if e == "K" else given()), cost + more + (e == "R")
            if re.fullmatch("(s?(ua)+)?", roles) and "x" not in roles:
                best = min(best, (cost, text))
    return best


def test_search_finds_the_least_of_all_strings():
    rng = random.Random(5)
    for _ in range(150):
        codes = [(rng.choice("suaax"), rng.random() < 0.2, rng.choice([0, 0, 5])) for _ in range(rng.randint(0, 4))]
        cost, path, _ = repair.search(codes)
        want = every_string(codes)
        assert (cost, path) == want, codes
        costs = repair.least_costs(codes, True)
        assert min(costs[0][0], costs[0][3]) == want[0]


def dynamic(codes):
    now = {0: (0, "")}
    for row in [*codes, None]:
        for _ in range(3):
            for q, (c, a) in [*now.items()]:
                to = repair._GIVEN[q][0]
                now[to] = min(now.get(to, (math.inf, "")), (c + 5, a + "I"))
        if row is not None:
            new = {}
            for q, (c, a) in now.items():
                for e, price, used, to in repair.edits(row, q):
                    if used:
                        new[to] = min(new.get(to, (math.inf, "")), (c + price, a + e))
            now = new
    return min(now[q] for q in (0, 3) if q in now)


def test_long_searches():
    rng = random.Random(6)
    for n in (30, 200, 600):
        codes = [(rng.choice("sua"), rng.random() < 0.1, rng.choice([0, 0, 0, 5])) for _ in range(n)]
        assert repair.search(codes)[:2] == dynamic(codes)


def plain(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)."""
    out, space = {}, r"\x20\x09-\x0D"
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, (r[2] if r[2] is not None else " "), (r[3] if r[3] is not None else " ")) for r in rows if r[0] == conv), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns = [r[1] for r in mine if r[0]]
        n, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], []
        for _, _, role, text in mine:
            words = re.findall(f"[^{space}]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.append((role, text))
            if fault:
                n[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit = dynamic(codes)
        lines, left, odd = [], iter(mine), len(audit.replace("D", "")) % 2
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[2:]
            if e != "D":
                lines.append((role if e == "K" else ("user", "assistant")[(len(lines) - odd) % 2]) + ":" + text)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *n.values(), illegal, int(cost), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed, convs, most):
    rng = random.Random(seed)
    texts = ["", " \n", "yes.", "No!", "why?  ", "and so", "é漢.", None, "a " * 300 + "."]
    rows = []
    for c in convs:
        for t in range(rng.randint(0, most)):
            rows.append((c, rng.choice([t, t, t, t * 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts) if rng.random() < 0.5 else f"text {t}.", 1, "z", "z", 2))
    return rows


@pytest.mark.parametrize("stretch", [repair.STRETCH, 3])
def test_report_equals_plain(spark, stretch):
    rows = talks(1, [*range(40), None], 9) + talks(2, [100, 101], 120)
    rows += rows[:30]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = repair.repair_report(df, stretch=stretch).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want
    turns = {}
    for r in sorted(repair.repaired_turns(df, stretch=stretch).collect(), key=lambda r: r.position):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


def test_one_row_repeated_is_one_row_with_a_count(spark):
    rows = [(1, 5, "user", "same.", 1, "", "", 1)] * 3000 + [(1, 6, "assistant", "end", 1, "", "", 1), (2, 0, "user", "a.", 1, "", "", 1)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plain(rows)
    assert got[1][5] == 2 * 2999 + 4 and got[1][6] == "D" * 3001


def test_damage_and_empty_tables(spark):
    rows = talks(3, [*range(60), None], 8)
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: tuple(str(x) for x in r)
    out = repair.damaged(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:4] for r in out.collect()), key=key) == sorted(want, key=key)
    assert repair.repair_report(df.limit(0)).isEmpty() and repair.repaired_turns(df.limit(0)).isEmpty()
