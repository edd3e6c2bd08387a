import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from panelwise.llm import turnrepair
from panelwise.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
SOLID, END = re.compile("[^\x20\x09-\x0d]"), ".!?"
RIGHT = re.compile(r"\A(s?(ua)+)?\Z")


def faults(rows):
    """Of (role, text) rows in order: 1 blank, 2 repeated, 3 truncated, 0 none."""
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in END else 0)
        seen.add((role, text))
    return out


def best(initials, fault):
    """(cost, audit, roles) by comparing whole suffixes from the end."""

    @lru_cache(None)
    def go(i, state, inserted):
        found = [(0, "", ())] if i == len(initials) and state in "0a" else []
        step = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            c, a, r = go(i, step, inserted + 1)
            found.append((c + 3, "I" + a, (step,) + r))
        if i < len(initials):
            c, a, r = go(i + 1, state, 0)
            found.append((c + 4, "D" + a, (None,) + r))
            if fault[i] not in (1, 2):
                extra = 3 * (fault[i] == 3)
                if initials[i] == step or initials[i] == "s" and state == "0":
                    c, a, r = go(i + 1, initials[i], 0)
                    found.append((c + extra, "K" + a, (initials[i],) + r))
                c, a, r = go(i + 1, step, 0)
                found.append((c + extra + 3, "R" + a, (step,) + r))
        return min(found, default=(10**9, "", ()))

    return go(0, "0", 0)


def every(initials, fault):
    """(cost, audit) by trying all edit sequences with up to two inserts between messages."""
    found = []
    for per in itertools.product(*["D" if f in (1, 2) else "DKua" for f in fault]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(initials) + 1):
            roles, audit, cost = [], "", 0
            for i, gap in enumerate(gaps):
                roles += gap
                audit += "I" * len(gap)
                cost += 3 * len(gap)
                if i < len(initials):
                    e = per[i]
                    audit += "R" if e in "ua" else e
                    cost += 4 if e == "D" else 3 * (e in "ua") + 3 * (fault[i] == 3)
                    roles += [] if e == "D" else [initials[i] if e == "K" else e]
            if RIGHT.match("".join(roles)):
                found.append((cost, audit))
    return min(found)


def walked(initials, fault):
    """(cost, audit) by the survivors, emitted as they agree; and the most nodes the tree held."""
    s, audit, most = turnrepair.Survivors(), [], 0
    for i, f in zip(initials, fault, strict=True):
        s.take(i, f)
        audit += s.agreed()
        most = max(most, s.size())
    total = list(s.end())
    cost = min(s.cost[k] for k in turnrepair.FINAL if s.head[k] >= 0)
    assert s.size() == 1
    return cost, "".join(e for e, _ in [*audit, *total]), most


def test_reference_itself_against_all_sequences():
    for n in range(4):
        for initials in itertools.product("sua", repeat=n):
            for fault in itertools.product((0, 1, 3), repeat=n):
                if n < 3 or fault == (0, 3, 1):
                    assert best("".join(initials), fault)[:2] == every("".join(initials), fault)


def test_survivors_against_whole_suffixes():
    rng = random.Random(5)
    for _ in range(1000):
        n = rng.randrange(0, 30)
        letters = rng.choice(["sua", "ua", "u", "uua", "suax ", "s"])
        initials = "".join(rng.choice(letters) for _ in range(n))
        fault = tuple(rng.choice([0, 0, 0, 0, 1, 2, 3, 3]) for _ in range(n))
        assert walked(initials, fault)[:2] == best(initials, fault)[:2]


def test_tree_stays_small_and_long_runs_of_one_role_end():
    assert walked("ua" * 5000, (0,) * 10000)[2] < 20
    rng = random.Random(6)
    assert walked([rng.choice("ua") for _ in range(20000)], [rng.choice((0, 0, 0, 1, 3)) for _ in range(20000)])[2] < 400
    cost, audit, _ = walked("u" * 3000, (0,) * 3000)
    assert (cost, audit) == (4500, "KR" * 1500)


def brute(rows):
    """The report of (conv_id, turn, role, text) rows."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, kept in by.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).digest()))
        initials = [r[:1] for _, r, _ in kept]
        fault = faults([x[1:] for x in kept])
        cost, audit, roles = best(tuple(initials), tuple(fault))
        rest, lines = iter(kept), []
        for e, r in zip(audit, roles, strict=True):
            _, role, text = next(rest) if e != "I" else (None, "", "")
            if e != "D":
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + text)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, fault.count(1), fault.count(2), fault.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op13_turnrepair"](spark, folder)
    assert df.columns == COLUMNS
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute(rows)


def odd_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.choice([1, 2, 5, 9])):
            turn = rng.choice([None, 0, 1, 2, 3, 3, 7, -4, 9])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool", "s", "User"])
            rows.append((conv, turn, role, rng.choice([None, "", " \n", "Yes.", "no", "No!\x0b", "ümlaut?", "end. ", "a. b"])))
    return rows + rows[:20] + [(99, t, "user", "x" * 200_000 + ".") for t in range(6)]


def test_nulls_ties_repeats_long_texts_and_further_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, step int")
    assert sorted((tuple(r) for r in turnrepair.report(df).collect()), key=repr) == brute(rows)


def test_empty_table_and_conversation_without_rows_after_damage(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turnrepair.report(spark.createDataFrame([], schema)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turnrepair.report(spark.createDataFrame([(gone, 0, "user", "Hello.")], schema)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "system", " ")]
    df = spark.createDataFrame(rows, schema)
    found = turnrepair.edits(df)
    fixed = sorted(tuple(r) for r in turnrepair.repaired(df, found).collect())
    kept = [r for r in fixed if r[2] != "D"]
    assert RIGHT.match("".join(r[3][0] for r in kept))
    assert [r[1] for r in fixed] == list(range(len(fixed)))
    cost, audit, _ = best(("a", "u", "u", "u", "s"), (0, 3, 0, 2, 1))
    assert "".join(r[2] for r in fixed) == audit
    assert found.groupBy().sum("cost").first()[0] == cost
