import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from checks.compare import compare, duck
from rentweave.llm import role_repair as R
from rentweave.llm.query_role_repair import QUERIES, damage
from rentweave.llm.role_grammar import Repair

SCHEMA = "conv_id long, turn long, role string, text string, run long, at string, step int, n long"
GOOD = re.compile(r"(s?(ua)+)?")
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        if not SEEN.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif SEEN.findall(text)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def brute(rows):
    """Every choice of edits for few turns: the least (cost, audit) and the lines it leaves."""
    names = {"u": "user", "a": "assistant"}
    gaps = [""] + ["u", "a", "ua", "au"]
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, faults(rows)):
        row = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            row += [("K", more, (role, text))] if role else []
            row += [("R", 3 + more, (names[x], text)) for x in "ua"]
        choices.append(row)
    for picks in itertools.product(*choices):
        kept = [p[2][0][:1] for p in picks if p[2]]
        # Inserts that lead nowhere are skipped early: the kept initials must fit between them.
        if any(x not in "sua" for x in kept) or "s" in kept[1:]:
            continue
        for pads in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(p[1] for p in picks) + 3 * sum(map(len, pads))
            if best and cost > best[0]:
                continue
            audit, lines = "", []
            for pad, pick in zip(pads, (*picks, None)):
                audit += "I" * len(pad)
                lines += [(names[x], "") for x in pad]
                if pick:
                    audit += pick[0]
                    lines += [pick[2]] if pick[2] else []
            if GOOD.fullmatch("".join(x[0][:1] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def case(rng):
    texts = ["Yes.", "No!", "cut off", " \n", "", "So? ", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [(rng.choice([None, 1, 2, 3, 4, 9]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 4))]


def frame(spark, conversations):
    rows = [(i, turn, role, text, 1, "x", 2, 3) for i, turns in conversations.items() for turn, role, text in turns]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bits", [10, 0, 1])
def test_equals_every_choice_of_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "RUN_BITS", bits)
    rng = random.Random(11)
    cases = {i: case(rng) for i in range(60)} | {None: [(None, "user", "Hi."), (1, "assistant", "Hi.")]}
    done = R.repair(frame(spark, cases))
    summary = {r["conv_id"]: r for r in done.summary.collect()}
    lines = {}
    for r in done.turns.orderBy("run", "step").collect():
        lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(summary) == set(cases)
    for i, rows in cases.items():
        rows = ordered(rows)
        cost, audit, kept = brute(rows)
        got, told = summary[i], faults(rows)
        assert (got["cost"], got["audit"], lines.get(i, [])) == (cost, audit, kept), rows
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [told.count(f) for f in ("blank", "duplicate", "truncated")]
        initials = [r[1][:1] for r in rows]
        assert got["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {r[0] for r in rows} - {None}
        assert got["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_long_conversations_in_runs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice(["user", "assistant", "system"]), f"line {i % 700}" + rng.choice([".", ""])) for i in range(3000)] + [(5, "user", "again.")] * 50
    whole = R.repair(frame(spark, {1: rows})).summary.collect()
    monkeypatch.setattr(R, "RUN_BITS", 4)
    done = R.repair(frame(spark, {1: rows}))
    assert done.summary.collect() == whole
    initials = "".join(r["role"][0] for r in done.turns.orderBy("run", "step").collect())
    assert GOOD.fullmatch(initials) and len(whole[0]["audit"]) >= 3050 and whole[0]["duplicate"] >= 49
    tool = Repair()
    assert len(tool.tops) == 5 and tool.join([tool.summary("")]) == (0, "")


def test_nulls_extremes_and_empty_tables(spark):
    odd = {
        None: [(None, None, None), (None, None, None)],
        1: [(-(2**63), "user", "A."), (2**63 - 1, "assistant", "B." * 50_000)],
        2: [(None, "user", None), (None, "assistant", "Ok.")],
    }
    done = R.repair(frame(spark, odd))
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["cost"], r["audit"]) for r in done.summary.collect()}
    assert got == {None: (0, 2, 8, "DD"), 1: (None, 0, 0, "KK"), 2: (0, 1, *got[2][2:])}
    assert got[2][2:] == brute([(None, "assistant", "Ok."), (None, "user", " ")])[:2]
    none = R.repair(frame(spark, {}).limit(0))
    assert none.summary.collect() == [] and none.turns.collect() == []


def test_damage(spark):
    rows = [(i, t, None if i == 3 else "assistant", None if t == 2 else "One. Two!") for i in (None, 1, 2, 3) for t in (None, *range(30))]
    got = sorted(damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=repr)
    want = []
    for i, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            want += [(i, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    assert [tuple(r) for r in got] == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not there")
def test_equals_sql_and_names_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    line = compare(spark, duck(sf), "op11", *QUERIES["op11_role_repair"], sf)
    assert line.startswith("ok"), line


def test_query_with_conversations_that_vanish(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (None, 3, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op11_role_repair"][0](spark, str(tmp_path)).collect()}
    assert set(got) == {gone, None}
    assert (got[gone]["cost"], got[gone]["audit"], got[gone]["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
