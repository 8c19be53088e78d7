"""Fixity audit against a record-by-record comparison."""

import hashlib
import random

import pytest

from bytegrain.llm.fixity import audit, inventory, mismatches, tree

PLACED = "page_id long, record string, archive long, start_offset long"


def sha(record):
    return hashlib.sha256((record or "").encode()).hexdigest()


def places(records):
    """(id, record, archive, start) of records without repeated ids."""
    rows, at = [], 0
    for i, (key, record) in enumerate(records):
        at = at if i % 4096 else 0
        rows.append((key, record, i // 4096, at))
        at += len((record or "").encode())
    return rows


def brute(records, replica):
    rows, used = [], set()
    for key, record, archive, start in places(records):
        held = [(h[2:] != (archive, start) or h[1] != record, h[1] != record, *h[2:]) for h in replica if h[0] == key]
        best = min(held, default=None)
        status = "missing" if best is None else "changed" if best[1] else "moved" if best[0] else "intact"
        if best:
            used.add((key, *best[2:]))
        rows.append((key, archive, start, start + len(record.encode()), sha(record), status))
    for key, record, archive, start in replica:
        if (key, archive, start) not in used:
            rows.append((key, archive, start, start + len(record.encode()), sha(record), "extra"))
    return sorted(rows)


@pytest.mark.parametrize("n", [1, 17, 300, 5000])
def test_audit(spark, n):
    rng = random.Random(n)
    records = [(i, f"record {i} é" + "x" * rng.randrange(200)) for i in range(n)]
    replica = []
    for key, record, archive, start in places(records):
        fate = rng.randrange(60)
        if fate == 0:
            record += "!"
        elif fate == 1:
            continue
        elif fate == 2:
            start += 10**9
        elif fate == 3:
            archive += 40
        elif fate == 4:
            replica += [(key, record, archive, start + 7), (key, "other", archive + 1, start)]
        elif fate == 5:
            replica.append((-1 - key, record, archive, start))
        replica.append((key, record, archive, start))
    a = spark.createDataFrame(records, "page_id long, record string").repartition(3)
    b = spark.createDataFrame(replica, PLACED).repartition(2)
    assert sorted(map(tuple, audit(a, b).collect())) == brute(records, replica)


def test_other_order_is_noticed(spark):
    records = [(i, f"record {i:04}") for i in range(100)]
    turned = places(records[::-1])
    a, b = spark.createDataFrame(records, "page_id long, record string"), spark.createDataFrame(turned, PLACED)
    assert {r.status for r in audit(a, b).collect()} == {"moved"}


def test_nulls_and_repeated_ids(spark):
    rows = [(None, "a"), (1, None), (2, "x"), (2, "y"), (2, "x"), (3, "z")]
    at = {None: 0, 1: 1, 2: 1, 3: 4}
    schema = "page_id int, record string"
    a = spark.createDataFrame([(*r, 1, 2) for r in rows], schema + ", _key int, status int")
    held = [(*r, 0, at[r[0]], "s") for r in rows[::-1]]
    b = spark.createDataFrame(held, schema + ", archive int, start_offset int, _status string")
    got = {r.page_id: r.status for r in audit(a, b).collect()}
    assert got == dict.fromkeys([None, 1, 2, 3], "intact")
    fewer = spark.createDataFrame([h for h in held if h[:2] != (2, "y")], b.schema)
    assert {r.page_id: r.status for r in audit(a, fewer).collect()} == {None: "intact", 1: "intact", 2: "changed", 3: "intact"}
    nowhere = spark.createDataFrame([(3, "z", None, None, "s")], b.schema)
    assert {r.page_id: r.status for r in audit(a.where("page_id = 3"), nowhere).collect()} == {3: "moved"}


def test_only_mismatching_branches_are_compared(spark):
    placed = spark.range(1000).selectExpr(
        "id AS _key", "sha2(CAST(id AS STRING), 256) AS _digest", "id DIV 500 AS _archive",
        "(id % 500) * 65536 AS _start", "(id % 500) * 65536 + 9 AS _stop",
    )
    other = placed.withColumn("_digest", placed._digest.substr(1, 60)).where("_key = 777").unionByName(placed.where("_key <> 777"))
    left, right = tree(placed, 3, 1), tree(other, 3, 1)
    assert [tuple(r) for r in mismatches(left, right, 3).collect()] == [(1, 277)]
    assert [level.count() for level in left] == [1000, 64, 4, 2, 1]
    assert mismatches(left, left, 3).isEmpty()


def test_empty_tables(spark):
    empty, nothing = spark.createDataFrame([], "page_id long, record string"), spark.createDataFrame([], PLACED)
    assert audit(empty, nothing).collect() == []
    one = spark.createDataFrame([(1, "a", 0, 0)], PLACED)
    assert [r.status for r in audit(one, nothing).collect()] == ["missing"]
    assert [r.status for r in audit(empty, one).collect()] == ["extra"]
    assert inventory(empty.selectExpr("page_id AS _key", "record AS _digest", "0L AS _bytes", "0 AS archive", "0 AS start_offset")).isEmpty()
