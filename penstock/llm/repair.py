"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation stand in the order of turn (nulls first), role and text
digest. A repair deletes rows, gives them another role or inserts empty ones, so that
the initials of the roles read `(s?(ua)+)?`. Of the cheapest repairs the one whose
letters (D, I, K, R) come first in ASCII order is wanted.

The search goes depth first in that order, under a bound on cost that rises to the
least sum that exceeded it. Its lower bound on what is left: three for each row that
must go, one for each truncated row, and one for each pair of neighbours that cannot
stand side by side, since an edit removes no more such pairs than it costs. States that
failed keep what their failure proved (the transposition table), over all bounds. So
the first path that is accepted is the cheapest and the first of its cost.

Long conversations are cut into runs of rows, within and across partitions. Each run
is searched once per state before and after it, and the runs are put together in order: of
equally cheap beginnings that end in one state, the first in ASCII order is kept. Letters of two
beginnings differ before either ends, as each ends with the letter of the same row. So no task holds a
conversation, but for its letters, one a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import NO_ID, dropped, shown_id, staged, table

#: Rows searched at a time.
RUN = 512
#: States by what was put out last: nothing, s, u, a. The next state by initial, and the only role that can be put in.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Cost of inserts from each state up to an accepted end, and up to each other state.
TO_END = (0, 4, 2, 0)
NEVER = 1 << 60
BETWEEN = ((0, NEVER, 2, 4), (NEVER, 0, 2, 4), (NEVER, NEVER, 0, 2), (NEVER, NEVER, 2, 0))
LEGAL = {"su", "ua", "au"}
LETTERS_SCHEMA = (
    "c long, part int, run long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
)
Row = tuple[str, bool, bool]  # initial, must go, truncated


def cheapest(rows: list[Row], start: int = 0, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits of `rows` from state `start`; ties go to the ASCII-least letters.

    With a goal, edits end with that of the last row, in state `goal`; None if it can't be reached.
    Without, they end where all that was put out is accepted.
    """
    n = len(rows)
    if goal == 0 and start != 0 or goal == 1 and start != 1 and (start or not any(i == "s" and not must for i, must, _ in rows)):
        return None
    lower = _lower_bounds(rows, goal)
    ends = {4 * n + q for q in range(4) if (q == goal if goal is not None else TO_END[q] == 0)}
    if start + 4 * n in ends and not n:
        return 0, ""
    moves = [_moves(rows, i, q, goal) for i in range(n + 1) for q in range(4)]
    bound = lower[start]
    while bound < NEVER:
        letters, stack = [], [[start, bound, 0, NEVER]]
        while stack:
            top = stack[-1]
            state, budget, at, _ = top
            if at < len(moves[state]):
                letter, to, cost = moves[state][at]
                top[2] += 1
                if cost + lower[to] > budget:
                    top[3] = min(top[3], cost + lower[to])
                    continue
                letters.append(letter)
                if to in ends:
                    return bound, "".join(letters)
                stack.append([to, budget - cost, 0, NEVER])
            else:
                stack.pop()
                lower[state] = max(lower[state], top[3])
                if stack:
                    letters.pop()
                    above = stack[-1]
                    above[3] = min(above[3], moves[above[0]][above[2] - 1][2] + lower[state])
        bound = lower[start]
    return None


def _moves(rows: list[Row], i: int, q: int, goal: int | None) -> list[tuple[str, int, int]]:
    """Letter, next state and cost of the edits from state q before row i, in ASCII order."""
    if i == len(rows):
        return [("I", 4 * i + PUT[q], 2)] if goal is None else []
    initial, must, truncated = rows[i]
    out = [("D", 4 * i + 4 + q, 3), ("I", 4 * i + PUT[q], 2)]
    if not must:
        if initial in NEXT[q]:
            out.append(("K", 4 * i + 4 + NEXT[q][initial], int(truncated)))
        out.append(("R", 4 * i + 4 + PUT[q], 2 + truncated))
    return out


def _lower_bounds(rows: list[Row], goal: int | None) -> list[int]:
    """At 4 * i + q: at least what it costs to go on from state q before row i."""
    n = len(rows)
    end = TO_END if goal is None else [BETWEEN[q][goal] for q in range(4)]
    out = [0] * (4 * n) + (list(TO_END) if goal is None else [0 if q == goal else NEVER for q in range(4)])
    last = {None: "a", 0: None, 1: None, 2: "u", 3: "a"}[goal]
    sure, pairs, after = 0, 0, None
    for i in range(n - 1, -1, -1):
        initial, must, truncated = rows[i]
        if must:
            sure += 3
        else:
            sure += truncated
            pairs += (initial != last if last else 0) if after is None else initial + after not in LEGAL
            after = initial
        for q in range(4):
            out[4 * i + q] = sure + (end[q] if after is None else pairs + (after not in NEXT[q]))
    return out


class _Run:
    """Rows of one conversation that follow each other in a partition, up to RUN."""

    def __init__(self, c: int):
        self.c, self.rows, self.turns = c, [], []
        self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, truncated: bool) -> None:
        truncated = truncated and not blank and not again
        self.rows.append((initial, blank or again, truncated))
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += truncated
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def solved(self, part: int, run: int, whole: bool) -> tuple:
        initials = [initial for initial, _, _ in self.rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        found = [cheapest(self.rows)] if whole else [cheapest(self.rows, q, goal) for q in range(4) for goal in range(4)]
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return (
            self.c, part, run, whole, len(self.rows), self.blank, self.duplicate, self.truncated, illegal, initials[0], initials[-1],
            low, high, len(self.turns), [f[0] if f else None for f in found], [f[1] if f else None for f in found],
        )


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_RUNS = pa.schema(
    [("c", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("whole", pa.bool_())]
    + [(name, pa.int64()) for name in ("n", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string())]
    + [(name, pa.int64()) for name in ("low", "high", "turns")]
    + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _solve(run_rows: int):
    """Runs of a partition's rows, each searched; only a conversation seen from its first to its last row is `whole`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, out = TaskContext.get().partitionId(), 0, []
        held: _Run | None = None
        before = None
        opened = False  # whether the held run begins its conversation for sure
        for batch in batches:
            for c, turn, digest, initial, blank, seen, truncated in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                if held is None or held.c != c or len(held.rows) == run_rows:
                    if held is not None:
                        out.append(held.solved(part, count, opened and held.c != c))
                        count += 1
                    opened = held is not None and held.c != c
                    held = _Run(c)
                held.add(turn, initial, blank, seen or before == (c, turn, digest), truncated)
                before = (c, turn, digest)
            if out:
                yield _arrow(out, _RUNS)
                out = []
        if held is not None:
            yield _arrow([held.solved(part, count, False)], _RUNS)

    return of


class _Joined:
    """Runs of one conversation, put together as they come."""

    def __init__(self, c: int):
        self.c = c
        self.sums = [0, 0, 0, 0]
        self.turns, self.low, self.high, self.last = 0, None, None, None
        #: By state: cost, rank among the beginnings, and where its letters are: (the earlier ones, the run's).
        self.best: dict[int, tuple] = {0: (0, 0, None)}
        self.done = None

    def add(self, run: dict) -> None:
        for i, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.sums[i] += run[name]
        self.sums[3] += self.last is not None and self.last + run["first"] not in LEGAL
        self.last = run["last"]
        if run["turns"]:
            self.turns += run["turns"] - (self.high == run["low"])
            self.low = run["low"] if self.low is None else self.low
            self.high = run["high"]
        if run["whole"]:
            self.done = run["costs"][0], run["audits"][0]
            return
        new = {}
        for goal in range(4):
            ways = [
                (cost + run["costs"][4 * q + goal], rank, run["audits"][4 * q + goal], letters)
                for q, (cost, rank, letters) in self.best.items()
                if run["costs"][4 * q + goal] is not None
            ]
            if ways:
                new[goal] = min(ways, key=lambda w: w[:3])
        ranks = {key: i for i, key in enumerate(sorted({w[1:3] for w in new.values()}))}
        self.best = {goal: (w[0], ranks[w[1:3]], (w[3], w[2])) for goal, w in new.items()}

    def row(self) -> tuple:
        if self.done is None:
            q = min(self.best, key=lambda q: (self.best[q][0] + TO_END[q], self.best[q][1]))
            cost, _, letters = self.best[q]
            parts = ["I" * (TO_END[q] // 2)]
            while letters:
                letters, some = letters
                parts.append(some)
            self.done = cost + TO_END[q], "".join(reversed(parts))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.c, gaps, *self.sums, *self.done)


_SUMMARY = pa.schema([(name, pa.int64()) for name in ("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, out = None, []
    for batch in batches:
        for run in batch.to_pylist():
            if held is None or held.c != run["c"]:
                if held is not None:
                    out.append(held.row())
                held = _Joined(run["c"])
            held.add(run)
        if out:
            yield _arrow(out, _SUMMARY)
            out = []
    if held is not None:
        yield _arrow([held.row()], _SUMMARY)


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def ordered(rows: DataFrame) -> DataFrame:
    """c, turn, role, digest, text of rows (conv_id, turn, role, text); a null role or text is one space, a null conversation one of its own."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text"))
    digest = F.md5(F.concat(F.length(role), F.lit(":"), role, text))
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), text.alias("text")
    )


def audits(rows: DataFrame, run_rows: int = RUN) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal, cost, audit: one row per conversation of `ordered` rows.

    Each row's first fault counts: blank (no word), duplicate (role and text occur
    earlier), truncated (the last character of a word is none of `.!?`). Blank and duplicate rows must be
    deleted (3); a truncated row that stays costs 1, another role 2, an inserted row 2.
    gaps counts turns that are missing between the lowest and the highest; illegal counts
    neighbours whose role initials are not su, ua or au. Rows of one turn stand by role
    and text digest; equal rows are copies of the first. Roles without an initial can't be kept.
    An empty table gives an empty result. Texts are not shuffled, only their digests.
    """
    turn = F.coalesce("turn", F.lit(NO_ID))
    thin = staged(
        rows.select(
            "c", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), _blank(F.col("text")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        ),
        "turns",
    )
    again = thin.groupBy("c", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("latest")).where("latest > first").drop("latest")
    known = thin.join(again, ["c", "digest"], "left").withColumn("seen", F.coalesce(turn > F.col("first"), F.lit(False)))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    known = known.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = staged(known.select("c", "turn", "digest", "initial", "blank", "seen", "truncated").mapInArrow(_solve(run_rows), LETTERS_SCHEMA), "runs")
    joined = runs.repartition("c").sortWithinPartitions("c", "part", "run")
    out = staged(joined.mapInArrow(_join, "c long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")
    dropped(thin, runs)
    return out


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str, str] | tuple[int, None, None]]]:
    """Per batch: (conversation, role, text) of repaired rows, in order; (conversation, None, None) ends each conversation.

    A conversation's letters come before its rows.
    """
    c, letters, at, state = None, "", 0, 0

    def put_in(upto: str) -> list:
        nonlocal at, state
        out = []
        while at < len(letters) and letters[at] == upto:
            state, at = PUT[state], at + 1
            out.append((c, ROLE[state], ""))
        return out

    for batch in batches:
        out = []
        for of, audit, role, text in zip(*[batch.column(name).to_pylist() for name in ("c", "audit", "role", "text")], strict=True):
            if audit is not None:
                if c is not None:
                    out += [*put_in("I"), (c, None, None)]
                c, letters, at, state = of, audit, 0, 0
                continue
            out += put_in("I")
            letter = letters[at]
            at += 1
            if letter == "K":
                state = NEXT[state][role[:1]]
                out.append((c, role, text))
            elif letter == "R":
                state = PUT[state]
                out.append((c, ROLE[state], text))
        yield out
    if c is not None:
        yield [*put_in("I"), (c, None, None)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("c", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pos = 0
    for some in _edited(batches):
        out = []
        for c, role, text in some:
            if role is None:
                pos = 0
            else:
                out.append((c, pos, role, text))
                pos += 1
        if out:
            yield _arrow(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("c", pa.int64()), ("repaired_sha256", pa.string())])
    digest, empty = hashlib.sha256(), True
    for some in _edited(batches):
        out = []
        for c, role, text in some:
            if role is None:
                out.append((c, digest.hexdigest()))
                digest, empty = hashlib.sha256(), True
            else:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        if out:
            yield _arrow(out, schema)


def _with_letters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's letters, then its rows in order, in one partition."""
    both = found.select("c", "audit").unionByName(rows.select("c", "turn", "role", "digest", "text"), allowMissingColumns=True)
    order = [F.col("c"), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    return both.repartition("c").sortWithinPartitions(*order).select("c", "audit", "role", "text")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, pos, role, text: the repaired conversations, for `ordered` rows and their `audits`.

    Rows stream through their task; none holds a conversation.
    """
    return _with_letters(rows, found).mapInArrow(_rows, "c long, pos long, role string, text string").select(shown_id("c").alias("conv_id"), "pos", "role", "text")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """c, repaired_sha256: the digest of the `repaired` rows as `role:text` lines.

    A digest reads its conversation in order, so one task streams each conversation.
    """
    return _with_letters(rows, found).mapInArrow(_digests, "c long, repaired_sha256 string")


def damaged(rows: DataFrame, parts: int = 20) -> DataFrame:
    """conv_id, turn, role, text: rows damaged by crc32 of `conv_id:turn` modulo `parts`; nulls count as one space there.

    0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 doubles the row, 4 makes it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(parts))
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text"))
    rows = rows.select(F.col("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_")).drop("_")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = ordered(damaged(given))
    found = audits(rows)
    ids = given.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c")).distinct()
    out = ids.join(found, "c", "left").join(digests(rows, found), "c", "left")
    zero = [F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return out.select(shown_id("c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
h AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(bytes, lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295)) % 20 AS kind
  FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
ins(s, t, c, a) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
mv(t, u, c, a, ini) AS (VALUES (0, 0, 3, 'D', ''), (1, 1, 3, 'D', ''), (2, 2, 3, 'D', ''), (3, 3, 3, 'D', ''), (0, 2, 2, 'R', ''), (1, 2, 2, 'R', ''), (2, 3, 2, 'R', ''), (3, 2, 2, 'R', ''),
  (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'), (3, 2, 0, 'K', 'u')),
r AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'c': 0::BIGINT, 'a': ''} AS best FROM counts
  UNION ALL
  SELECT conv_id, i, u, min(way)
  FROM (SELECT r.conv_id, f.i, mv.u, {'c': (r.best.c + ins.c + mv.c + CASE WHEN fault = 'truncated' AND mv.a <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'a': r.best.a || ins.a || mv.a} AS way
        FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1 JOIN ins ON ins.s = r.s JOIN mv ON mv.t = ins.t
        WHERE mv.a = 'D' OR fault NOT IN ('blank', 'duplicate') AND (mv.a = 'R' OR mv.ini = f.ini)) GROUP BY conv_id, i, u),
won AS (
  SELECT c.conv_id, min({'c': (best.c + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END)::BIGINT, 'a': best.a || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}) AS best
  FROM r JOIN counts c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.n GROUP BY c.conv_id),
letters AS (SELECT conv_id, best.a AS a, unnest(range(1, length(best.a) + 1)) AS p FROM won),
placed AS (
  SELECT conv_id, p, substr(a, p, 1) AS letter, length(replace(substr(a, 1, p), 'I', '')) AS i, length(replace(substr(a, 1, p), 'D', '')) AS q FROM letters),
edited AS (
  SELECT l.conv_id, l.p, l.letter, l.q, f.role, f.text, bool_or(l.q = 1 AND l.letter = 'K' AND f.ini = 's') OVER (PARTITION BY l.conv_id) AS led
  FROM placed l LEFT JOIN f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.letter <> 'D'),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body
  FROM edited GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN said x ON x.conv_id IS NOT DISTINCT FROM g.conv_id
"""
