"""Conversation repair against a plain dynamic program, and whole conversations of any length."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fundloom.llm import repair as R

COLUMNS = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows, entry="", goals=("", "a")):
    """rows (initial, must go, cut) -> (cost, audit) by states, row by row; up to two insertions before each."""
    best = {entry: (0, "")}

    def inserted(found):
        out = dict(found)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                to = "a" if state == "u" else "u"
                out[to] = min(out.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return out

    for initial, gone, cut in rows:
        new = {}
        for state, (cost, audit) in inserted(best).items():
            tried = [(state, 3, "D")]
            if not gone:
                tried.append(("a" if state == "u" else "u", 2 + cut, "R"))
                if initial and initial in FOLLOWS[state]:
                    tried.append((initial, cut, "K"))
            for to, more, letter in tried:
                new[to] = min(new.get(to, (10**9, "")), (cost + more, audit + letter))
        best = new
    ends = inserted(best)
    return min((ends[g] for g in goals if g in ends), default=None)


def brute(rows):
    """What repair_damaged says of rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, seen, counts = [], set(), [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            seen.add((role, text))
            codes.append((role[:1], fault in (0, 1), int(fault == 2)))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own[:-1], own[1:], strict=True))
        cost, audit = cheapest(codes)
        said, state, left = [], "", iter(own)
        for letter in audit:
            role, text = next(left)[1:] if letter != "I" else ("", "")
            if letter != "D":
                state = role[0] if letter == "K" else "a" if state == "u" else "u"
                said.append(f"{role if letter == 'K' else NAMES[state]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_is_optimal(seed):
    rng = random.Random(seed)
    states = ["", "s", "u", "a"]
    for _ in range(400):
        rows = [(rng.choice("suauaaux"), rng.choice((0, 0, 0, 0, 1, 2, 3, 3))) for _ in range(rng.randrange(14))]
        plain = [(i, f in (1, 2), int(f == 3)) for i, f in rows]
        assert R.repaired(rows, 0, R.ENDS) == cheapest(plain)
        a, b = rng.randrange(4), rng.randrange(4)
        assert R.repaired(rows, a, (b,)) == cheapest(plain, states[a], (states[b],))
    rows = [(rng.choice("suaux"), rng.choice((0, 0, 0, 1, 3))) for _ in range(R.SEGMENT)]
    assert R.repaired(rows, 0, R.ENDS) == cheapest([(i, f == 1, int(f == 3)) for i, f in rows])


def test_bounds_are_bounds():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(10))]
        bounds = R.lower_bounds(rows)
        for k in range(len(rows) + 1):
            left = [(i, f in (1, 2), int(f == 3)) for i, f in rows[k:]]
            assert bounds[k] <= min(c[0] for s in ("", "s", "u", "a") if (c := cheapest(left, s, ("", "s", "u", "a"))))


def made(seed, lengths):
    rng = random.Random(seed)
    rows = []
    for conv, n in lengths.items():
        for k in range(n):
            turn = None if rng.random() < 0.05 else rng.randrange(n) if rng.random() < 0.2 else k
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            rows.append((conv, turn, role, rng.choice(("Yes.", "No", "", " \n", None, "ä?", f"What {k}!", f"It is {rng.randrange(4)}"))))
    return rows


def held(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repairs(spark):
    rows = made(1, {k: 1 + k % 9 for k in range(60)} | {None: 5, 100: 400, 101: 65, 102: 64, 103: 700})
    rows += rows[:7]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("conv", F.lit("c1")).withColumn("fault", F.lit(7)).repartition(3)
    assert held(R.repair_damaged(docs)) == brute(rows)


def test_many_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 3)
    monkeypatch.setattr(R, "FAN", 2)
    rows = made(2, {1: 60, 2: 2, 3: 7, 4: 33})
    assert held(R.repair_damaged(spark.createDataFrame(rows, COLUMNS))) == brute(rows)


def test_nothing_left_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = held(R.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hm.")], COLUMNS)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert R.repair_damaged(spark.createDataFrame([], COLUMNS)).count() == 0
