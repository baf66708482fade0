from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from quaestor.llm import conversation_repair
from tests.oracle import folder

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, audit int"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """conv_id to its rows after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(own.encode()) % 20
        out[conv] += []
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = NOT_BLANK.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else ""
        fault = fault or ("truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """(cost, letters, roles of the result) by tables from the end; states are the initial before."""
    follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    end = {"": (0, "", ()), "a": (0, "", ())}
    best = end
    for i in range(len(rows), -1, -1):
        here = {}
        for state in follow:
            options = [end[state]] if i == len(rows) and state in end else []
            if i < len(rows):
                _, role, text = rows[i]
                cost, letters, lines = best[state]
                options.append((cost + 2, "D" + letters, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] else 0
                    if role[:1] in follow[state] and role[:1]:
                        cost, letters, lines = best[role[0]]
                        options.append((cost + more, "K" + letters, ((role, text), *lines)))
                    cost, letters, lines = best[due[state]]
                    options.append((cost + more + 1, "R" + letters, ((name[due[state]], text), *lines)))
            if options:
                here[state] = min(options, key=lambda o: o[:2])
        for _ in follow:  # chains of insertions
            for state in follow:
                after = here.get(due[state])
                if after:
                    option = (after[0] + 5, "I" + after[1], ((name[due[state]], ""), *after[2]))
                    here[state] = min([option, *([here[state]] if state in here else [])], key=lambda o: o[:2])
        best = here
    return best[""]


def plain(rows):
    out = {}
    for conv, own in damaged(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, letters, lines = cheapest(own, faults)
        assert LEGAL.match("".join(r[0] for r, _ in lines))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            letters,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_query_against_tables_from_the_end(spark):
    rows = spark.read.parquet(f"{folder()}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = entry.queries()["op12_idastar_repair"](spark, folder())
    assert found.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ]
    assert got(found) == plain(map(tuple, rows))


def odd_rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "", "tool", "User", None]
    texts = ["Yes.", "no", " \t", "", None, "Why?", "long " * 3000 + "!", "a.\n", "é😀", "."]
    rows = [
        (rng.choice([None, *range(100, 160)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
        for _ in range(900)
    ]
    rows += [(7, t, rng.choice(roles[:3]), (rng.choice(texts[:6]) or "") + str(t % 50) * (t % 3 > 0)) for t in range(1500)]
    rows += rows[:40]
    # Every row of 999 is dropped.
    gone = [t for t in range(500) if zlib.crc32(f"999:{t}".encode()) % 20 == 0]
    return rows + [(999, t, "user", "x.") for t in gone[:3]]


def test_odd_rows(spark):
    """Nulls in all columns, unknown roles, repeats, equal turns, a long conversation, one that is gone."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    found = got(conversation_repair.repair_conversations(df))
    assert found == plain(rows)
    assert found[999] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_pieces_give_the_answer_of_the_whole(seed):
    """Across borders of 64 rows cost and letters are those of one table."""
    rng = random.Random(seed)
    for n in [0, 1, 63, 64, 65, 128, 200]:
        rows = [(i, rng.choice(["user", "assistant", "system", "x"]), f"{rng.randrange(n + 1)}") for i in range(n)]
        faults = [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in rows]
        codes = bytes(
            4 * {"s": 0, "u": 1, "a": 2}.get(r[1][0], 3) + ["", "blank", "duplicate", "truncated"].index(f)
            for r, f in zip(rows, faults)
        )
        assert conversation_repair.repair(codes) == cheapest(rows, faults)[:2]


def test_time_is_in_proportion_to_rows():
    rng = random.Random(1)
    codes = bytes(rng.choice([0, 3, 4, 4, 6, 7, 8, 8, 11, 12, 15]) for _ in range(20_000))
    began = time.process_time()
    conversation_repair.repair(codes)
    assert time.process_time() - began < 60
