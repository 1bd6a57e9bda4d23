"""Conversation repair against a plain search over whole strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import Row

from fathomline.llm import conversation_repair as repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, edits, roles) by strings grown from the end; rows are (initial, fault)."""
    below = {0: (0, "", ""), 3: (0, "", "")}
    _insert(below)
    for initial, fault in reversed(rows):
        now = {}
        for q in range(4):
            options = [(below[q], 2, "D", "-")] if q in below else []
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = 5 if fault == repair.CUT else 0
                options += [(below[NEXT[q, out]], cost + more, edit, out) for edit, cost, out in (("K", 0, initial), ("R", 1, "u"), ("R", 1, "a")) if NEXT.get((q, out)) in below]
            if options:
                now[q] = min((w[0] + cost, edit + w[1], out + w[2]) for w, cost, edit, out in options)
        _insert(now)
        below = now
    return below[0]


def _insert(layer):
    for _ in range(5):
        for (q, out), to in NEXT.items():
            if out != "s" and to in layer:
                w = layer[to]
                layer[q] = min(layer.get(q, (1 << 60,)), (w[0] + 5, "I" + w[1], out + w[2]))


def expected(rows):
    """The whole query in plain Python."""
    by_conv, out = {}, []
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        seen, symbols = set(), []
        for _, role, text in kept:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = repair.BLANK if not visible else repair.DUPLICATE if (role, text) in seen else repair.CUT if visible[-1] not in ".!?" else repair.FINE
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, edits, roles = cheapest(symbols)
        left, done = iter(kept), []
        for edit, role in zip(edits, roles):
            row = None if edit == "I" else next(left)
            if edit != "D":
                done.append(f"{row[1] if edit == 'K' else repair.ROLES[role]}:{row[2] if row else ''}")
        turns = [t for t, *_ in kept if t is not None]
        count = lambda f: sum(s[1] == f for s in symbols)  # noqa: E731, B023
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count(repair.BLANK), count(repair.DUPLICATE), count(repair.CUT), illegal, cost, edits, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, schema=SCHEMA):
    table = repair.damaged(spark.createDataFrame(rows, schema))
    found = repair.digest(table, repair.audit(table))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_paths_are_cheapest_and_least():
    rnd = random.Random(3)
    for _ in range(3000):
        rows = [(rnd.choice(["s", "u", "u", "a", "a", "x", ""]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 9))]
        assert repair.shortest(rows) == cheapest(rows), rows


def test_long_conversations_take_linear_time():
    rows = [("ua"[i % 2], i % 97 // 96) for i in range(100_000)]
    cost, edits, _ = repair.shortest(rows)
    assert len(edits) >= len(rows) and cost > 0


def test_against_plain_python(spark):
    rnd = random.Random(5)
    texts = ["Yes.", "No?", "why", " \t", "", None, "Ünï. ", "a.b", "Long " * 2000 + "."]
    rows = [(c, t, rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), rnd.choice(texts)) for c in [*range(150), None] for t in [*range(rnd.randint(1, 8)), *([None] if rnd.random() < 0.1 else [])]]
    assert run(spark, rows) == expected(rows)


def test_repeats_ties_and_one_long_conversation(spark):
    rows = [(7, t // 3, ["user", "assistant"][t % 2], f"line {t % 50}.") for t in range(3000)] + [(8, 0, "user", "x."), (8, 0, "user", "x.")]
    assert run(spark, rows) == expected(rows)


def test_conversations_whose_rows_are_dropped_stay(spark):
    dropped = [(c, 0, "user", "Hi.") for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped and all(r[1:-1] == (0, 0, 0, 0, 0, 0, "") and r[-1] == hashlib.sha256(b"").hexdigest() for r in run(spark, dropped))


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == []
    rows = [(c, t, "user", "Hi.", "x", True, "y") for c in range(20) for t in range(3)]
    names = SCHEMA + ", digest string, present boolean, stats string"
    assert run(spark, rows, names) == expected([r[:4] for r in rows])


def test_repaired_rows(spark):
    table = spark.createDataFrame([Row(conv_id=1, turn=0, role="user", text="Hi.", present=True), Row(conv_id=1, turn=1, role="user", text="Still.", present=True), Row(conv_id=1, turn=2, role="user", text=" ", present=True)])
    audits = repair.audit(table)
    assert [r.audit for r in audits.collect()] == ["KRD"]
    rows = repair.repaired(table, audits).orderBy("position").collect()
    assert [(r.position, r.role, r.text, r.edit) for r in rows] == [(0, "user", "Hi.", "K"), (1, "assistant", "Still.", "R")]
    one = spark.createDataFrame([Row(conv_id=1, turn=0, role="user", text="Why", present=True)])
    assert repair.repaired(one, repair.audit(one)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_on_the_table(spark, sf):
    from fathomline.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}").collect()), key=str) == expected(rows)
