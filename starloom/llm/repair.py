"""Repair of conversations' structure: the lightest derivation of an alternating conversation from damaged turns."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contract's texts, and the marks that end a whole text.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What a row suffers from, by its first fault.
NONE, EMPTY, REPEATED, TRUNCATED = range(4)
#: Costs of the edits, and what a truncated row adds that isn't deleted.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: The grammar (s?(ua)+)? as states: 0 at the start, 1 after the system's turn, 2 after the user's, 3 after the
#: assistant's. BEFORE[q] has the turn that leads to q and the states that it leads from; a conversation ends in 0 or 3.
BEFORE = {0: ("", ()), 1: ("s", (0,)), 2: ("u", (0, 1, 3)), 3: ("a", (2,))}
LAST = (0, 3)
ROLE = {"u": "user", "a": "assistant"}


def lightest(initials: list[str], faults: list[int]) -> tuple[int, list[tuple[str, str]]]:
    """The cheapest repair and, of equally cheap ones, that with the least audit: its cost and its edits (letter, role initial).

    Knuth's agenda. An item (i, q) stands for the turns from i on, repaired so that they follow state q. Deductions put
    an edit, an axiom of cost and letter, before a finished item: Keep, Rerole and Delete use up a turn, Insert doesn't.
    An item's value is (cost, turns used up, audit). Each deduction costs something or uses up a turn, so its value is
    above the values of both its antecedents, and it grows with them (an edit's letter comes before a whole audit):
    the functions are superior and monotone, and the least item of the agenda is final. Keep costs nothing, so cost
    and audit alone wouldn't do ("KR" is less than "R"); turns used up are the same for all derivations of an item and
    change none of its comparisons. The derivations of one item all start with other letters, so the first letter
    decides between equal costs and no audit is ever copied: n turns take O(n log n) steps and O(n) memory.
    """
    n = len(initials)
    agenda: list[tuple[int, int, str, int, int, int]] = [(0, 0, "", n, q, -1) for q in LAST]
    final: dict[tuple[int, int], tuple[str, int]] = {}
    cost = 0
    while (0, 0) not in final:
        cost, used, letter, i, q, after = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = letter, after
        turn, states = BEFORE[q]
        if turn in ROLE:
            for p in states:
                if (i, p) not in final:
                    heapq.heappush(agenda, (cost + INSERT, used, "I", i, p, q))
        if i == 0:
            continue
        fault = faults[i - 1]
        if (i - 1, q) not in final:
            heapq.heappush(agenda, (cost + DELETE, used + 1, "D", i - 1, q, q))
        if fault in (EMPTY, REPEATED):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        for p in states:
            if (i - 1, p) in final:
                continue
            if initials[i - 1] == turn:
                heapq.heappush(agenda, (cost + more, used + 1, "K", i - 1, p, q))
            elif turn in ROLE:
                heapq.heappush(agenda, (cost + more + REROLE, used + 1, "R", i - 1, p, q))
    edits, i, q = [], 0, 0
    while final[i, q][0]:
        letter, after = final[i, q]
        edits.append((letter, "" if letter == "D" else BEFORE[after][0]))
        i, q = i + (letter != "I"), after
    return cost, edits


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): turns damaged by the crc32 of `conv_id:turn`, modulo 20.

    0 loses the turn (it stays as a mark, so that its conversation is known), 1 empties its text, 2 takes its ends of
    sentences out, 3 repeats it, 4 gives it to the user. Null roles and texts are one space, and so are null ids and
    numbers in the hashed text.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), k.alias("k"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("lost"))


def examined(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, lost) with the place of each in its conversation and its first fault.

    By number (nulls first), then role, then text; lost turns come last. One shuffle, by conversation.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANK))
    rows = turns.repartition("conv_id").withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    fault = F.when(bare == "", EMPTY).when(F.col("nth") > 1, REPEATED).when(~F.right(bare, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(NONE)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("lost", F.col("turn").asc_nulls_first(), "role", "text", "nth"))
    return rows.select("conv_id", "turn", "role", "text", "lost", fault.alias("fault"), place.alias("place"))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(turns: DataFrame, texts: bool = True) -> DataFrame:
    """The repaired conversations of turns (conv_id, turn, role, text and, if any are known to be lost, lost).

    Rows (conv_id, n, edit, role, text) are the repaired turns, n from 1, with the edit that made each (K kept, R
    given to another role, I inserted). One more row for each conversation, with n null, sums it up: gaps in the
    numbers, blank, duplicate and truncated turns (each counted for its first fault), illegal neighbours, the cost and
    the audit of its repair, and the SHA-256 of its turns as `role:text` lines. With texts=False only sums come out.

    A conversation passes through a task as a stream in order: first each turn as a few bytes, from which the
    repair is found, then its texts, one Arrow batch at a time. So a long conversation takes about two kilobytes a
    turn and never all of its texts at once; sorts may spill. Null ids are one conversation; conversations whose turns
    are all lost have no turns, zeros and an empty audit; repeated rows are turns that a repair deletes; an empty table
    gives no rows; other columns aren't read.
    """
    if "lost" not in turns.columns:
        turns = turns.withColumn("lost", F.lit(False))
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "lost")
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = examined(turns)
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(0).alias("part"), F.left("role", F.lit(1)).alias("initial"), none.alias("role"), none.alias("text"))
    second = F.struct(F.lit(1).alias("part"), none.alias("initial"), F.col("role").alias("role"), F.col("text").alias("text"))
    twice = rows.select("conv_id", "place", F.col("turn").cast("long").alias("turn"), "lost", "fault", F.explode(F.when(F.col("lost"), F.array(first)).otherwise(F.array(first, second))).alias("x"))
    stream = twice.select("conv_id", F.col("x.part").alias("part"), "place", "turn", "lost", "fault", "x.initial", "x.role", "x.text").sortWithinPartitions("conv_id", "part", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _Conversation()
        started, ours = False, None
        out = _Rows()
        for batch in batches:
            convs, parts, turns, lost, faults, initials = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))
            roles, bodies = batch.column(7), batch.column(8)
            for k, conv in enumerate(convs):
                if not started or conv != ours:
                    if started:
                        out.add(ours, one.rest(), texts)
                        out.sums(ours, one)
                    started, ours, one = True, conv, _Conversation()
                if parts[k] == 0:
                    if not lost[k]:
                        one.see(turns[k], initials[k], faults[k])
                else:
                    out.add(ours, one.take(roles[k].as_py(), bodies[k].as_py()), texts)
            yield from out.flush(batch.schema.field(0).type)
        if started:
            out.add(ours, one.rest(), texts)
            out.sums(ours, one)
            yield from out.flush(batch.schema.field(0).type)

    return stream.mapInArrow(run, f"conv_id {kind}, n long, edit string, role string, text string, {SUMMARY}")


class _Conversation:
    """A conversation as it streams by: codes of its turns, then its texts against the edits."""

    def __init__(self) -> None:
        self.numbers: set[int] = set()
        self.initials: list[str] = []
        self.faults: list[int] = []
        self.edits: list[tuple[str, str]] | None = None
        self.cost, self.at, self.n, self.digest = 0, 0, 0, hashlib.sha256()

    def see(self, number: int | None, initial: str, fault: int) -> None:
        if number is not None:
            self.numbers.add(number)
        self.initials.append(initial)
        self.faults.append(fault)

    def _write(self, edit: str, role: str, text: str) -> tuple[int, str, str, str]:
        self.digest.update(("\n" * (self.n > 0) + f"{role}:{text}").encode())
        self.n += 1
        return self.n, edit, role, text

    def _inserted(self) -> Iterator[tuple[int, str, str, str]]:
        if self.edits is None:
            self.cost, self.edits = lightest(self.initials, self.faults)
        while self.at < len(self.edits) and self.edits[self.at][0] == "I":
            yield self._write("I", ROLE[self.edits[self.at][1]], "")
            self.at += 1

    def take(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """The repaired turns up to and with the next turn."""
        yield from self._inserted()
        letter, initial = self.edits[self.at]
        self.at += 1
        if letter != "D":
            yield self._write(letter, role if letter == "K" else ROLE[initial], text)

    def rest(self) -> Iterator[tuple[int, str, str, str]]:
        yield from self._inserted()

    def sums(self) -> tuple:
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        gaps = max(self.numbers) - min(self.numbers) + 1 - len(self.numbers) if self.numbers else 0
        return gaps, *(self.faults.count(f) for f in (EMPTY, REPEATED, TRUNCATED)), pairs, self.cost, "".join(x for x, _ in self.edits), self.digest.hexdigest()


class _Rows:
    """Output rows of a batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, conv: object, made: Iterator[tuple[int, str, str, str]], texts: bool) -> None:
        for x in made:
            if texts:
                self.rows.append((conv, *x, *[None] * 8))

    def sums(self, conv: object, one: _Conversation) -> None:
        self.rows.append((conv, *[None] * 4, *one.sums()))

    def flush(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv_id", "n", "edit", "role", "text", *[x.split()[0] for x in SUMMARY.split(", ")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)], names)
            self.rows = []


def summaries(repaired: DataFrame) -> DataFrame:
    """One row for each conversation."""
    return repaired.where(F.col("n").isNull()).drop("n", "edit", "role", "text")


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text in DuckDB's SQL."""
    step = "list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda h, b: {step}), 4294967295)"


def _sql() -> str:
    """DuckDB's SQL of the query: values are cost, padded, and audit in one string, so that least() compares them."""

    def put(value: str, cost: str, letter: str) -> str:
        return f"lpad((left({value}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({value}, 10)"

    def closed(b: list[str]) -> str:
        two = put("b2", "3", "I"), put("b3", "6", "II"), put("b3", "3", "I")
        return f"least({b[0]}, {two[0]}, {two[1]}) AS e0, least({b[1]}, {two[0]}, {two[1]}) AS e1, least({b[2]}, {two[2]}) AS e2, least({b[3]}, {two[0]}) AS e3"

    def step(own: str, keeps: list[tuple[str, str]], to: str) -> str:
        keep = "".join(f"CASE WHEN NOT must AND x = '{x}' THEN {put(e, 'more', 'K')} END, " for x, e in keeps)
        return f"least({keep}CASE WHEN NOT must THEN {put(to, '3 + more', 'R')} END, {put(own, '4', 'D')})"

    b = ["b0", "b1", "b2", "b3"]
    steps = [step("e0", [("s", "e1"), ("u", "e2")], "e2"), step("e1", [("u", "e2")], "e2"), step("e2", [("a", "e3")], "e3"), step("e3", [("u", "e2")], "e2")]
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0
), y AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d
), o AS (
  SELECT *, regexp_replace(text, '{space}+$', '') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM y
), f AS (
  SELECT *, left(role, 1) AS x, bare = '' AS blank, bare <> '' AND nth > 1 AS again, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS px FROM o
), r AS (
  SELECT conv_id, n AS i, {closed(b)} FROM (SELECT DISTINCT conv_id, n, '000000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, '000000000' AS b3 FROM f)
  UNION ALL
  SELECT conv_id, i, {closed(b)} FROM (
    SELECT r.conv_id, r.i - 1 AS i, {", ".join(f"{s} AS b{j}" for j, s in enumerate(steps))}
    FROM r JOIN (SELECT *, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM f) f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)
), a AS (
  SELECT conv_id, left(e0, 9)::BIGINT AS cost, substr(e0, 10) AS audit FROM r WHERE i = 0
), e AS (
  SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i, length(replace(audit[1:j], 'D', '')) AS m
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM a)
), w AS (
  SELECT e.conv_id, e.m, e.edit, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
    CASE WHEN e.edit = 'K' THEN f.role WHEN (e.m - coalesce(max(CASE WHEN e.edit = 'K' AND f.x = 's' THEN 1 END) OVER (PARTITION BY e.conv_id), 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role
  FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY m)) AS repaired_sha256 FROM w GROUP BY conv_id
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (cut) AS truncated, count(*) FILTER (px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
