"""Repairs against a plain search over all edits."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from passagework.llm import conversation_repair as repair

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def layered(faults, initials):
    """All walks, row by row, as a table (last role) -> least (cost, audit); insertions by repeated relaxation."""
    def insert(table):
        for _ in range(4):
            for tail, (c, a) in list(table.items()):
                due = "a" if tail == "u" else "u"
                if due not in table or (c + 3, a + "I") < table[due]:
                    table[due] = (c + 3, a + "I")
        return table

    table = insert({"": (0, "")})
    for f, i in zip(faults, initials):
        then = {}
        for tail, (c, a) in table.items():
            due = "a" if tail == "u" else "u"
            options = [(tail, c + 4, "D")]
            if f not in "bd":
                extra = 3 if f == "t" else 0
                options.append((due, c + 3 + extra, "R"))
                if i == due or (i == "s" and tail == ""):
                    options.append((i, c + extra, "K"))
            for t, cost, e in options:
                if t not in then or (cost, a + e) < then[t]:
                    then[t] = (cost, a + e)
        table = insert(then)
    return min(table[t] for t in ("", "a") if t in table)


def plain(rows):
    out = []
    for conv, kept in plain_damage(rows).items():
        seen, faults = set(), ""
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults += "b" if not body else "d" if (role, text) in seen else "." if body[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = [r[1][:1] for r in kept]
        cost, audit = layered(faults, initials)
        lines, tail, at = [], "", 0
        for e in audit:
            due = "a" if tail == "u" else "u"
            name = {"u": "user", "a": "assistant"}[due]
            if e == "I":
                lines.append((name, ""))
            elif e != "D":
                lines.append((name if e == "R" else kept[at][1], kept[at][2]))
            at += e != "I"
            if e != "D":
                tail = lines[-1][0][:1]
        assert at == len(kept) and LEGAL.fullmatch("".join(n[:1] for n, _ in lines))
        turns = {r[0] for r in kept} - {None}
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def every_audit(faults, initials, most=3):
    """Truly all walks with up to ``most`` insertions in all."""
    best = None
    stack = [(0, "", 0, "", 0)]
    while stack:
        at, roles, cost, audit, used = stack.pop()
        if at == len(faults) and LEGAL.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if used < most:
            stack += [(at, roles + r, cost + 3, audit + "I", used + 1) for r in "ua"]
        if at < len(faults):
            stack.append((at + 1, roles, cost + 4, audit + "D", used))
            if faults[at] not in "bd":
                extra = 3 if faults[at] == "t" else 0
                stack.append((at + 1, roles + initials[at], cost + extra, audit + "K", used))
                stack += [(at + 1, roles + r, cost + 3 + extra, audit + "R", used) for r in "ua"]
    return best


def test_search_is_proved_best_on_all_short_conversations():
    pick = random.Random(7)
    for _ in range(150):
        n = pick.randrange(0, 6)
        faults, initials = "".join(pick.choice("...bdt") for _ in range(n)), [pick.choice("suatx ") for _ in range(n)]
        want = every_audit(faults, initials)
        assert repair.search(faults, initials) == want == layered(faults, initials)


def test_search_of_long_ties():
    for initials in (["u"] * 900, ["a", "u"] * 400, ["s"] * 500, list("uua") * 300):
        faults = "." * len(initials)
        assert repair.search(faults, initials) == layered(faults, initials)


def conversations():
    pick = random.Random(11)
    rows = []
    for conv in range(120):
        for turn in range(pick.randrange(1, 9)):
            rows.append((conv, pick.choice([turn, turn, turn * 2]), pick.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), pick.choice(["Hi.", "Yes!", "no", " \t", None, "", "Well? ", f"Answer {turn}."])))
    rows += [(500, t, "user" if t % 2 else "assistant", pick.choice(["a.", "b", "c?", "d!"]) + str(pick.randrange(400)) + ".") for t in range(2600)]
    rows += [(501, None, "user", "same."), (501, None, "user", "same."), (501, 3, "user", "x" * 100_000), (None, 1, "user", "who?"), (None, 2, "assistant", "me.")]
    return rows


@pytest.mark.parametrize("parts, held, bits", [(1, 2048, 10), (5, 2048, 10), (40, 1, 2)])
def test_repairs_equal_plain_ones(spark, monkeypatch, parts, held, bits):
    """The last case sends every conversation through segments of at most four rows."""
    monkeypatch.setattr(repair, "HELD_ROWS", held)
    monkeypatch.setattr(repair, "SEGMENT_BITS", bits)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, pos int, flaw string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repair.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repair(frame).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(frame.limit(0)).count() == 0
