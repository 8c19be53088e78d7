"""Merkle proofs of all rows against a tree built in memory."""

import hashlib
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from bytegrain.llm import manifest
from bytegrain.llm.manifest import audit_rows, height

FIELDS = ["doc_id", "source", "text"]
SCHEMA = "doc_id bigint, source string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha("".join(map(field, row)))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        found.append(nodes)
    return found


def sides(tree, at):
    for nodes in tree[:-1]:
        first = at // 3 * 3
        yield "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])
        at //= 3


def brute(rows, change):
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    members = {
        g: sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for g in groups
    }
    trees = {g: levels([leaf(r) for r in members[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in groups])
    for t, g in enumerate(groups):
        for at, row in enumerate(members[g]):
            folded, siblings = leaf(change(row)), ""
            for left, right in [*sides(trees[g], at), *sides(top, t)]:
                folded, siblings = sha(left + folded + right), siblings + left + right
            root = top[-1][0]
            yield (row[0], leaf(row), trees[g][-1][0], root, sha(siblings), folded, folded == root)


def audit(df):
    odd = F.col("doc_id") % 2 == 1
    found = audit_rows(df, FIELDS, {"text": F.concat("text", F.lit("!"))}, odd)
    return Counter(map(tuple, found.collect()))


def change(row):
    altered = row[0] is not None and row[0] % 2 == 1 and row[2] is not None
    return (*row[:2], row[2] + "!") if altered else row


@pytest.mark.parametrize("n, groups, broadcast", [(1, 1, True), (3, 1, True), (700, 5, True), (300, 90, False)])
def test_proofs(spark, monkeypatch, n, groups, broadcast):
    if not broadcast:
        monkeypatch.setattr(manifest, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(manifest, "BROADCAST_BYTES", 0)
    draw = random.Random(n)
    names = [None, "", "é", *(f"s{i}" for i in range(groups))]
    # one group holds a good part of all rows; ids and whole rows repeat, texts may be null
    rows = [
        (
            draw.choice([None, *range(n)]) if n > 3 else n,
            draw.choice([names[-1], *names]) if n > 3 else None,
            draw.choice([None, "", "é\n", "x" * draw.randrange(9)]),
        )
        for _ in range(n)
    ]
    rows += rows[:5] if n > 3 else []
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA + ", `row` int, `up` string").repartition(3)
    assert audit(df) == Counter(brute(rows, change))


def test_empty_table(spark):
    assert not audit(spark.createDataFrame([], SCHEMA))


def test_height():
    assert [height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
