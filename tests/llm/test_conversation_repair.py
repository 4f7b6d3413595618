"""Repairs against an enumeration of all edits, and against SQL."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest
from oracle import compare, connection

from driftpool.llm import conversation_repair as cr, queries


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults_of(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        core = re.search("([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\Z", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def cheapest(initials, faults):
    """Least (cost, audit) and the roles it gives, from every row and state on; audits grow at the front only."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @functools.cache
    def best(k, state, inserts):
        ways = [(0, "", ())] if k == len(initials) and state in (0, 3) else []
        moves = [(3, "I", k, r, inserts + 1) for r in "ua"] if inserts < 3 else []
        if k < len(initials):
            moves.append((4, "D", k + 1, None, 0))
            if faults[k] not in ("blank", "duplicate"):
                more = 3 if faults[k] == "truncated" else 0
                moves += [(more, "K", k + 1, initials[k], 0), *((3 + more, "R", k + 1, r, 0) for r in "ua")]
        for cost, edit, to, role, n in moves:
            after = state if role is None else step.get((state, role))
            if after is not None and (rest := best(to, after, n)) is not None:
                ways.append((cost + rest[0], edit + rest[1], (role, *rest[2])))
        return min(ways, key=lambda w: w[:2], default=None)

    return best(0, 0, 0)


def brute(rows):
    found = {}
    for conv_id in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv_id])
        faults, initials = faults_of(own), [r[2][:1] for r in own]
        cost, audit, roles = cheapest(tuple(initials), tuple(faults))
        lines, at = [], 0
        for edit, role in zip(audit, roles, strict=True):
            name = {"u": "user", "a": "assistant", None: ""}.get(role, "")
            if edit == "I":
                lines.append(f"{name}:")
                continue
            if edit != "D":
                lines.append(f"{own[at][2] if edit == 'K' else name}:{own[at][3]}")
            at += 1
        turns = {r[1] for r in own if r[1] is not None}
        found[conv_id] = (
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return sorted(found.values(), key=repr)


def got(df):
    return sorted((tuple(r) for r in cr.repair(cr.damaged(df)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


TEXTS = ["yes.", "no!", "why?", "cut", "", " ", "\t\n", None, "a.\x0b ", "two\nlines.", "é", "ende. \u00a0", "same.", "."]


def conversations(spark, n, longest, seed):
    rng = random.Random(seed)
    rows = []
    for conv_id in [None, *range(n)]:
        for k in range(rng.randrange(1, longest)):
            turn = rng.choice([k, k, k, k, k + 3, None, 1])
            role = rng.choice(["user", "assistant", "ua"[k % 2], "system", "user", "assistant", "tool", "", None])
            rows.append((conv_id, turn, role, rng.choice([*TEXTS, f"word {k}.", f"other {k}!"])))
    rows += rows[:3]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, copies int").repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_enumeration(spark, seed):
    rows, df = conversations(spark, 150, 12, seed)
    assert got(df) == brute(rows)


def test_one_long_conversation_over_many_tasks(spark):
    rows, df = conversations(spark, 1, 700, 3)
    sys.setrecursionlimit(20_000)  # of the enumeration
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(df) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_every_split_gives_the_same_cell():
    rng = random.Random(4)
    for _ in range(300):
        cells = [cr.terminal(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(2, 9))]
        left = functools.reduce(cr.product, cells)
        right = functools.reduce(lambda b, a: cr.product(a, b), reversed(cells))
        chart = cr.Chart()
        for c in cells:
            chart.add(c)
        assert left == right == chart.whole()


def test_all_short_conversations():
    kinds = [(r, f) for r in "suax" for f in ("", "truncated", "duplicate")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n) if n < 4 else random.Random(0).sample(list(itertools.product(kinds, repeat=4)), 3000):
            chart = cr.Chart()
            for role, fault in rows:
                chart.add(cr.terminal(role, fault == "duplicate", fault == "truncated"))
            assert cr.best_repair(chart.whole()) == cheapest(tuple(r for r, _ in rows), tuple(f for _, f in rows))[:2]


def test_dropped_whole_and_empty(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "hello.")], "conv_id long, turn long, role string, text string")
    assert got(df) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(df.limit(0)) == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", " " * 3_000_000)]
    assert got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == brute(rows)


@pytest.mark.parametrize("rows", ["sample", "table"])
def test_sql(spark, sf_dir, rows, tmp_path):
    name = "op12_conversation_repair"
    if rows == "sample":
        conversations(spark, 60, 10, 7)[1].write.parquet(f"{tmp_path}/conversations.parquet")
        con = connection(sf_dir)
        con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        assert compare(queries.QUERIES[name](spark, str(tmp_path)), queries.SQL[name], con) is None
    else:
        assert compare(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], connection(sf_dir)) is None
