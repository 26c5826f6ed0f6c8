"""Operator 11 against a brute force over all edit strings and a plain dynamic program."""
import hashlib
import itertools
import random
import re
import zlib

import pytest

from proflex.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
OWED = {"user": "user", "assistant": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def describe(rows):
    """gaps, counts of faults, and (role, text, must go, truncated) of the rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts, seen, facts = [0, 0, 0], set(), []
    for _, _, role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not stripped else 1 if (role, text) in seen else 2 if stripped[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        facts.append((role, text, fault < 2, fault == 2))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts, illegal), facts


def brute(facts):
    """Every sequence of edits with at most `inserts` insertions: the least (cost, audit)."""
    best = None
    for inserts in range(len(facts) + 3):
        if best and best[0] < 5 * inserts:
            break
        slots = len(facts) + inserts
        for where in itertools.combinations(range(slots), inserts):
            options, at = [], 0
            for i in range(slots):
                if i in where:
                    options.append([("I", "u", 5), ("I", "a", 5)])
                else:
                    role, _, must_go, cut = facts[at]
                    at += 1
                    keep = [] if must_go else [("K", role[:1], 5 * cut), ("R", "u", 1 + 5 * cut), ("R", "a", 1 + 5 * cut)]
                    options.append([("D", "", 2), *keep])
            for choice in itertools.product(*options):
                if LEGAL.fullmatch("".join(c[1] for c in choice)):
                    value = (sum(c[2] for c in choice), "".join(c[0] for c in choice))
                    best = min(best, value) if best else value
    return best


def dynamic(facts):
    """The same by a dynamic program from the end, on whole strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, ""), "a": (0, "")}
    for _ in range(3):
        best = {p: min(v for v in [best.get(p), *[(best[q][0] + 5, "I" + best[q][1]) for (x, r), q in step.items() if x == p and r != "s" and q in best]] if v)
                for p in ("", "s", "u", "a") if p in best or any(x == p and r != "s" and q in best for (x, r), q in step.items())}
    for role, _, must_go, cut in reversed(facts):
        now = {}
        for p in ("", "s", "u", "a"):
            ways = [(best[p][0] + 2, "D" + best[p][1])] if p in best else []
            for (x, r), q in step.items():
                if x == p and not must_go and q in best:
                    if role[:1] == r:
                        ways.append((best[q][0] + 5 * cut, "K" + best[q][1]))
                    if r != "s":
                        ways.append((best[q][0] + 5 * cut + 1, "R" + best[q][1]))
            if ways:
                now[p] = min(ways)
        for _ in range(3):
            for (p, r), q in step.items():
                if r != "s" and q in now:
                    way = (now[q][0] + 5, "I" + now[q][1])
                    now[p] = min(now.get(p, way), way)
        best = now
    return best[""]


def repaired(facts, audit):
    out, state, rest = [], R.START, iter(facts)
    for letter in audit:
        role, text = (R.OWED[state], "") if letter == "I" else next(rest)[:2]
        if letter == "R":
            role = R.OWED[state]
        if letter != "D":
            out.append(f"{role}:{text}")
            state = R.STEP[state, role[:1]]
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def random_facts(rng, n):
    return [(rng.choice(["system", "user", "assistant", "tool", " "]), "x", rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_agenda_finds_the_lightest(seed):
    rng = random.Random(seed)
    for _ in range(40):
        facts = random_facts(rng, rng.randrange(5))
        light = R.lightest([(r[:1], m, c and not m) for r, _, m, c in facts], R.FINAL, {R.START})[R.START]
        facts = [(r, t, m, c and not m) for r, t, m, c in facts]
        assert light == brute(facts) == dynamic(facts)


def test_chunks_give_the_same(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(R, "CHUNK", 3)
    for _ in range(150):
        facts = [(r, t, m, c and not m) for r, t, m, c in random_facts(rng, rng.randrange(30))]
        ways = R.Ways()
        at = 0
        while len(facts) - at > 3:
            ways.through([(r[:1], m, c) for r, _, m, c in facts[at:at + 3]])
            at += 3
        assert ways.finish([(r[:1], m, c) for r, _, m, c in facts[at:]]) == dynamic(facts)


def check(spark, rows, **columns):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, value in columns.items():
        df = df.withColumn(name, value)
    got = {r.conv_id: r for r in R.repair_damaged(df).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in damaged(rows):
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        counts, facts = describe(own)
        cost, audit = dynamic(facts) if facts else (0, "")
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (*counts, cost, audit), conv
        assert r.repaired_sha256 == repaired(facts, audit)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    check(spark, rows)


def test_edges(spark):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", None), (1, None, "user", "a."), (1, 7, "", "b."), (1, 7, "", "b."),
            (2, 5, "system", "x.\t"), (3, 0, "tool", "\x0b"), (4, 1, "user", "word " * 200_000 + "."), (5, 1, "user", "é! ")]
    rows += [(10 + c, rng.randrange(12), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", " ", "Go!"])) for c in range(40) for _ in range(rng.randrange(9))]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", f"t{i % 50}.") for i in range(5000)]
    check(spark, rows, key=F.lit(1), conv=F.lit("x"), phase=F.lit(2))


def test_empty(spark):
    out = R.repair_damaged(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert out.count() == 0


def test_edits_are_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "More."), (1, 2, "assistant", "Yes.")], SCHEMA)
    edits = R.apply_edits(turns, R.decide(turns)).orderBy("place").collect()
    assert [(e.edit, e.role, e.text) for e in edits] == [("D", "user", "Hi."), ("K", "user", "More."), ("K", "assistant", "Yes.")]
