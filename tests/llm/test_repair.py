import hashlib
import itertools
import random
import re
import zlib

import pytest
from corpus_curator.llm import repair

GOAL = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """All edits of all rows, with up to two insertions at every place."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("b", "d") for e, (_, f) in zip(edits, rows)):
            continue
        for fill in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(i + e for i, e in zip(fill, [*edits, ""]))
            cost = sum({"D": 4, "K": 0, "R": 3, "I": 3}[c] for c in audit) + sum(
                3 for e, (_, f) in zip(edits, rows) if e != "D" and f == "t")
            if best and (cost, audit) >= best:
                continue
            slots = []
            for i, e, (initial, _) in zip(fill, edits, rows):
                slots += ["ua"] * len(i) + ([initial] if e == "K" else ["ua"] if e == "R" else [])
            slots += ["ua"] * len(fill[-1])
            if any(GOAL.fullmatch("".join(c)) for c in itertools.product(*slots)):
                best = (cost, audit)
    return best


def test_search_finds_the_cheapest_and_least_audit():
    rng = random.Random(3)
    cases = [[], [("s", "")], [("a", "")], [("x", "t")], [("", "")]]
    cases += [[(rng.choice("uuaasx"), rng.choice(["", "", "", "t", "b", "d"]))
               for _ in range(rng.randrange(1, 5))] for _ in range(120)]
    for rows in cases:
        assert repair.search(rows) == plain_repair(rows), rows


def test_segments_compose_to_the_whole():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("uuaasx"), rng.choice(["", "", "", "t", "b", "d"]))
                for _ in range(rng.randrange(1, 40))]
        size = rng.randrange(1, 9)
        tables = [repair.table_of(rows[i:i + size]) for i in range(0, len(rows), size)]
        left = tables[0]
        for t in tables[1:]:
            left = repair.compose(left, t)
        right = tables[-1]
        for t in tables[-2::-1]:
            right = repair.compose(t, right)
        assert repair.finish(left) == repair.finish(right) == repair.search(rows)


def by_hand(table):
    """The definition, row by row."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen
                          else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        best = repair.search([(r[1][:1], f) for r, f in zip(rows, faults)])
        state, kept, i = "", [], 0
        for e in best[1]:
            want = "u" if not kept or kept[-1][0][:1] in ("s", "a") else "a"
            fill = {"u": "user", "a": "assistant"}[want]
            if e == "I":
                kept.append((fill, ""))
                continue
            _, role, text = rows[i]
            i += 1
            if e != "D":
                kept.append((role if e == "K" else fill, text))
        assert GOAL.fullmatch("".join(r[:1] for r, _ in kept)) and state == ""
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for _, r, _ in rows]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
                    *best, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode())
                    .hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(11)
    texts = ["Yes.", "no", "What? ", "Ok!\n", "", None, " \t", "é.", "Long one. And more"]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
             rng.choice(texts)) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(77, t, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"Row {t % 90}.")
             for t in range(400)]
    rows += [(None, None, "user", "Hi."), (None, 1, "assistant", "Hi."), (5, None, "user", "Hi."),
             (6, 0, "user", "Hi."), (6, 0, "user", "Hi."), (6, 0, "user", "Ho."),
             (8, 2**62, "user", "Far."), (8, -5, "assistant", "Away.")]
    return rows


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_repaired_equals_the_definition(spark, segment):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' AS fault", "1 AS row", "2 AS part").repartition(4)
    got = repair.repaired(df, segment=segment, fan=2)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(df).count() == 0
