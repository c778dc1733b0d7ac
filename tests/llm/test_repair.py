"""Repair of conversations against an exhaustive search and on small and odd tables."""

import functools
import hashlib
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(initials, faults):
    """The least (cost, audit, roles) of all edits with at most two insertions between turns, by trying them all."""

    @functools.cache
    def tails(i, inserted):
        out = []
        if i == len(initials):
            out.append((0, "", ""))
        else:
            more = 3 * (faults[i] == repair.TRUNCATED)
            for cost, audit, roles in tails(i + 1, 0):
                out.append((cost + 4, "D" + audit, roles))
                if faults[i] not in (repair.EMPTY, repair.REPEATED):
                    out.append((cost + more, "K" + audit, (initials[i] or "?") + roles))
                    out += [(cost + more + 3, "R" + audit, r + roles) for r in "ua"]
        if inserted < 2:
            out += [(cost + 3, "I" + audit, r + roles) for cost, audit, roles in tails(i, inserted + 1) for r in "ua"]
        return out

    return min(x for x in tails(0, 0) if GRAMMAR.fullmatch(x[2]))


ROWS = st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3]))


@settings(max_examples=40, deadline=None)
@given(st.lists(ROWS, max_size=2))
def test_agenda_finds_the_least_derivation(rows):
    initials, faults = [r for r, _ in rows], [f for _, f in rows]
    cost, edits = repair.lightest(initials, faults)
    want = cheapest(tuple(initials), tuple(faults))
    assert (cost, "".join(x for x, _ in edits), "".join(r for _, r in edits)) == want


def by_strings(initials, faults):
    """The least (cost, audit) by whole strings, settled from the last turn to the first."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = None
    for i in range(len(initials), -1, -1):
        now = {q: [] for q in steps}
        for q in steps:
            if after is None:
                now[q] += [(0, "")] * (q in (0, 3))
                continue
            now[q].append((after[q][0] + 4, "D" + after[q][1]))
            if faults[i] not in (1, 2):
                more = 3 * (faults[i] == 3)
                for r, to in steps[q].items():
                    c, s = after[to]
                    now[q] += [(c + more, "K" + s)] * (r == initials[i]) + [(c + more + 3, "R" + s)] * (r in "ua")
        best = {q: min(x, default=(10**9, "")) for q, x in now.items()}
        for _ in range(4):
            for q in steps:
                best[q] = min([best[q]] + [(best[to][0] + 3, "I" + best[to][1]) for r, to in steps[q].items() if r in "ua"])
        after = best
    return after[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(ROWS, max_size=14))
def test_agenda_equals_whole_strings(rows):
    initials, faults = [r for r, _ in rows], [f for _, f in rows]
    cost, edits = repair.lightest(initials, faults)
    assert (cost, "".join(x for x, _ in edits)) == by_strings(initials, faults)


def test_long_conversations_take_little_time():
    n = 20000
    cost, edits = repair.lightest(["u", "a"] * n, [0] * (2 * n))
    assert cost == 0 and len(edits) == 2 * n
    cost, edits = repair.lightest(["u"] * 3000, [0] * 3000)
    assert cost == 3 * 1500 and {x for x, _ in edits} <= {"K", "R", "I"}


def rows():
    out = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} is said.") for t in range(30)]
    out += [(2, None, "user", "no number."), (2, None, None, None), (2, 5, "system", "late."), (None, 1, "user", "who?"), (None, 2, "assistant", "me."), (None, 2, "assistant", "me.")]
    out += [(3, 0, "user", " ."), (3, 1, "tool", " \n\t"), (3, 9, "assistant", "word " * 20000 + "."), (4, 3, "user", "tie b."), (4, 3, "user", "tie a."), (4, 3, "assistant", "tie c.")]
    return out + [(c, 0, "user", "alone.") for c in range(100, 160)]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        mine = convs.setdefault(conv, [])
        if k:
            one = (turn is not None, turn or 0, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            mine += [one] * (2 if k == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort()
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _ in mine]
        cost, edits = repair.lightest(initials, faults)
        lines, i = [], 0
        for letter, r in edits:
            if letter != "D":
                lines.append((mine[i][2] if letter == "K" else repair.ROLE[r]) + ":" + ("" if letter == "I" else mine[i][3]))
            i += letter != "I"
        numbers = {t for known, t, _, _ in mine if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, "".join(x for x, _ in edits), hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_summaries_equal_brute_force_and_sql(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    found = repair.summaries(repair.repair(repair.damaged(df), texts=False)).collect()
    want = brute(rows())
    assert len(found) == len(want) and {r[0]: tuple(r[1:]) for r in found} == want
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in want.values())  # all of it lost
    conversations = df.toPandas()  # noqa: F841  (read by name)
    conversations["turn"], conversations["conv_id"] = conversations["turn"].astype("Int64"), conversations["conv_id"].astype("Int64")
    sql = duckdb.sql(repair.SQL).fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in found)


def test_repaired_turns_follow_the_grammar(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("n", F.lit("other")).repartition(3)
    found = repair.repair(df).where("n is not null").orderBy("conv_id", "n").collect()
    by = {}
    for r in found:
        by.setdefault(r["conv_id"], []).append(r)
    for mine in by.values():
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))
        assert GRAMMAR.fullmatch("".join(r["role"][0] for r in mine))
    assert [r["text"] for r in by[1]] == [f"Turn {t} is said." for t in range(30)] and {r["edit"] for r in by[1]} == {"K"}
    assert any(len(r["text"]) > 90000 for r in by[3])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(empty)).collect() == []
