"""Repairs against a search of all cheap edit sequences, and digests of the repaired texts."""

import hashlib
import heapq
import random
import re

import pytest

from bytegrain.llm.conversations import parse, repair_plan, repaired_digests, repaired_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile("(s?(ua)+)?")
PREFIX = re.compile("(s?(ua)*u?)?")


def md5(text):
    return hashlib.md5(text.encode()).digest()


def faults(rows):
    seen = set()
    for role, text in rows:
        signs = text.strip(" \t\n\v\f\r")
        if not signs:
            yield "blank"
        elif (role, text) in seen:
            yield "duplicate"
        else:
            yield "" if signs[-1] in ".!?" else "truncated"
        seen.add((role, text))


def search(rows, found):
    """The least (cost, audit, repaired rows), by cost first, then in the order of the audit."""
    heap = [(0, "", 0, "", ())]
    best = None
    while heap:
        cost, audit, i, shape, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            return best
        if i == len(rows) and GOOD.fullmatch(shape) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        steps = [(3, "I", i, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i]
            steps.append((4, "D", i + 1, "", None))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                steps += [(more, "K", i + 1, role[:1], (role, text))] if role else []
                steps += [(3 + more, "R", i + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for more, edit, j, sign, made in steps:
            if PREFIX.fullmatch(shape + sign):
                heapq.heappush(heap, (cost + more, audit + edit, j, shape + sign, out + ((made,) if made else ())))


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs.setdefault(conv, []).append((turn is not None, turn, role, md5(text), text))
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3]))
        turns = {r[1] for r in held if r[0]}
        body = [(r[2], r[4]) for r in held]
        found = list(faults(body))
        initials = [r[0][:1] for r in body]
        cost, audit, out = search(body, found)
        yield conv, (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
        ), out


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


@pytest.mark.parametrize("seed, segment", [(1, 4096), (2, 1), (3, 3)])
def test_repairs(spark, seed, segment):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "union", "é"]
    texts = ["Yes.", "No!", "Why", "what? ", "", " \n", None, "é.", "end.\t"]
    rows = [
        (draw.choice([None, 1, *range(20)]), draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts))
        for _ in range(90)
    ]
    rows += [(30 + i, t, r, f"{t}.") for i in range(3) for t, r in enumerate(["system", "user", "assistant"])]
    rows += rows[:6]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], SCHEMA + ", `rank` int, audit string").repartition(3)
    ids = spark.createDataFrame([(None,), (1,), (77,)] + [(r[0],) for r in rows], "conv_id bigint")
    plan = repair_plan(df, ids=ids, segment=segment)
    got = {r.conv_id: tuple(r)[1:] for r in plan.collect()}
    want = {conv: (summary, out) for conv, summary, out in brute(rows)}
    assert got == {c: s for c, (s, _) in want.items()} | {c: (0,) * 6 + ("",) for c in {None, 1, 77} - set(want)}
    digests = {r.conv_id: r.sha256 for r in repaired_digests(df, plan).collect()}
    assert digests == {c: digest(want[c][1]) if c in want else digest([]) for c in got}
    written = {}
    for r in sorted(repaired_rows(df, plan).collect(), key=lambda r: r.turn):
        assert r.turn == len(written.setdefault(r.conv_id, []))
        written[r.conv_id].append((r.role, r.text))
    assert written == {c: list(out) for c, (_, out) in want.items() if out}


def test_one_long_conversation(spark):
    """Segments of one conversation give what one parse of all its rows gives."""
    draw = random.Random(9)
    rows = [(1, i, draw.choice(["user", "assistant", "tool"]), f"{i}" + draw.choice([".", ""])) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole, parts = (repair_plan(df, segment=n).collect() for n in (4096, 16))
    assert whole == parts and set("IKRD") == set(whole[0].audit)
    out = [(r.role, r.text) for r in sorted(repaired_rows(df, repair_plan(df)).collect(), key=lambda r: r.turn)]
    assert GOOD.fullmatch("".join(role[0] for role, _ in out))


def test_merged_tops_lose_nothing():
    """Segments that begin at any top have a least way to every top they can reach."""
    for start in range(6):
        assert parse(start, []) == {start: (0, "")}
    assert parse(2, [("a", 0)])[3] == (0, "K") and parse(5, [("a", 0)])[5] == (3, "IK")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_plan(empty).collect() == [] and repaired_digests(empty, repair_plan(empty)).collect() == []
    ids = spark.createDataFrame([(4,), (4,)], "conv_id bigint")
    assert [tuple(r) for r in repair_plan(empty, ids=ids).collect()] == [(4, 0, 0, 0, 0, 0, 0, "")]
