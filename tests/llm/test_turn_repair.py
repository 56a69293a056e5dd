"""Conversation repair: against all edit lists, against one block per conversation, and odd rows."""

import hashlib
import random
import re

import pytest

from tabweave.llm import turn_repair
from tabweave.llm.turn_repair import INITIALS, UNITS, crossings, edited, kind_of, repair_conversations, repaired_rows, span, unit_of

PATTERN = re.compile(r"(s?(ua)+)?")


def all_ways(rows, most):
    """Every edit list up to ``most`` inserts: ``(cost, edits, result)`` of those with a good result."""
    ways = [(0, "", "")]
    for kind in [*rows, None]:
        longer = ways
        for _ in range(most):
            longer = [(c + 2, e + "I", r + x) for c, e, r in longer for x in "ua"]
            ways = ways + longer
        if kind is not None:
            cut = kind % 2
            ways = [w for c, e, r in ways for w in (
                (c + 3, e + "D", r), (c + 2 + cut, e + "R", r + "u"), (c + 2 + cut, e + "R", r + "a"), (c + cut, e + "K", r + INITIALS[kind // 2]))]
            ways = [w for w in ways if re.fullmatch(r"s?(ua)*u?", w[2])]
    return [w for w in ways if PATTERN.fullmatch(w[2])]


def audit(kinds, states):
    rows = [(0, INITIALS[k // 2], "", 1, k) for k in kinds]
    return list(edited(rows, states, True))


@pytest.mark.parametrize("seed", range(6))
def test_least_of_all_edit_lists(seed):
    draw = random.Random(seed)
    for _ in range(12):
        kinds = [draw.randrange(8) for _ in range(draw.randint(0, 4))]
        cost, edits, roles = min(all_ways(kinds, 2))
        found = audit(kinds, crossings([UNITS[k] for k in kinds]))
        assert "".join(e for e, *_ in found) == edits, kinds
        assert "".join(r[:1] for e, r, _ in found if e != "D") == roles


def test_blocks_meet_in_the_same_states():
    draw = random.Random(7)
    for _ in range(60):
        units = [UNITS[draw.randrange(8)] for _ in range(draw.randint(1, 60))]
        cuts = sorted(draw.sample(range(1, len(units) + 1), min(len(units), 5)) + [0, len(units)])
        parts = [units[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        at = crossings([unit_of(span(p)) for p in parts])
        states = [turn_repair.START]
        for p, a, b in zip(parts, at, at[1:], strict=False):
            states += crossings(p, a, b)[1:]
        assert states == crossings(units)


def plain(rows):
    """Report of one conversation's rows ``(turn, role, text)`` by dynamic programming over edit strings."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.rstrip(" \t\n\r\x0b\x0c")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    best = {"": (0, "", ())}

    def put(table, key, way):
        key = {"": "", "s": "s"}.get(key, key[-1:])
        if key not in table or way[:2] < table[key][:2]:
            table[key] = way

    def grown(table):
        todo = list(table.items())
        out = dict(table)
        for _ in range(2):
            new = []
            for state, (c, e, lines) in todo:
                x = "a" if state == "u" else "u"
                way = (c + 2, e + "I", (*lines, ("user:" if x == "u" else "assistant:")))
                new.append((x, way))
                put(out, x, way)
            todo = new
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        table = {}
        for state, (c, e, lines) in best.items():
            put(table, state, (c + 3, e + "D", lines))
        if fault not in ("blank", "duplicate"):
            todo = [(s, w) for s, w in best.items()]
            for _ in range(3):
                new = []
                for state, (c, e, lines) in todo:
                    x = "a" if state == "u" else "u"
                    cut = fault == "truncated"
                    name = "user" if x == "u" else "assistant"
                    put(table, x, (c + 2 + cut, e + "R", (*lines, f"{name}:{text}")))
                    if role[:1] == x or (role[:1] == "s" and state == ""):
                        put(table, role[:1], (c + cut, e + "K", (*lines, f"{role}:{text}")))
                    new.append((x, (c + 2, e + "I", (*lines, f"{name}:"))))
                todo = new
        best = table
    ended = [w for s, w in grown(best).items() if s in ("", "a")]
    cost, edits, lines = min(ended)
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_rows():
    draw = random.Random(3)
    rows = []
    for conv in [*range(40), None]:
        for _ in range(draw.randint(1, 9) if conv is not None else 60):
            turn = draw.choice([None, *range(8)])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, turn, role, draw.choice(["Fine.", "cut", " \t", "", None, "No!  \n", "x" * 50_000 + ".", "é?", "Fine."])))
    return rows + rows[:5] * 3


@pytest.mark.parametrize("block", [4096, 3])
def test_reports_against_plain_programming(spark, block):
    rows = odd_rows()
    schema = "conv_id bigint, turn bigint, role string, text string, ck int, kind string, live boolean"
    df = spark.createDataFrame([(*r, 1, "k", False) for r in rows], schema).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair_conversations(df, block=block).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == plain([r[1:] for r in rows if r[0] == conv]), conv


def test_rows_of_the_repair_give_its_hash(spark):
    df = spark.createDataFrame(odd_rows(), "conv_id bigint, turn bigint, role string, text string")
    lines = {}
    for r in sorted(repaired_rows(df, block=4).collect(), key=lambda r: (r.part, r.seq, r.at)):
        if r.edit != "D":
            lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repair_conversations(df).collect():
        assert hashlib.sha256("\n".join(lines.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "x.")], "conv_id bigint, turn bigint, role string, text string")
    assert repair_conversations(df.limit(0)).count() == 0
    (row,) = repair_conversations(df, live=df.turn > 5).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation():
    kinds = [kind_of(("user", "assistant")[i % 2], "ok.") for i in range(20_000)]
    assert "".join(e for e, *_ in audit(kinds, crossings([UNITS[k] for k in kinds]))) == "K" * 20_000
