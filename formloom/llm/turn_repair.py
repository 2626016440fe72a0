"""Repair of conversation structure by alignment to a grammar.

Turns should alternate as ``(s?(ua)+)?`` (initials of system, user, assistant).  A
conversation is aligned to the strings of that grammar, one string for each feasible
length, by Wagner-Fischer edit distance: a turn is kept, given another role or
deleted, a missing turn is inserted.  The cheapest cost found so far bounds both the
lengths worth trying and, as an Ukkonen band, the cells of each table.  Every table
as cheap as the incumbent is traced back to its audit, the string of its edits, and
the least audit of the cheapest alignments is the repair.

Rows reach a task sorted by conversation and are read as a stream, so a conversation
of any length needs the memory of one block of turns, of one digest for each
distinct message and of its audit.  A conversation longer than a block is aligned
block by block between all states of the grammar (nothing yet, after ``s``, after
``u``, after ``a``) and the best way to each state is carried on, with its running
digest; audits of the same turns are never prefixes of one another at equal cost, so
the least audit of the whole is made of least audits of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs: another role, deletion, insertion, and leaving a truncated turn in place.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns aligned in one table; longer conversations go block by block.
BLOCK = 48
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: States of the grammar (the last initial, "" for none yet) in which it may end.
ACCEPTED = ("", "a")
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

INSIDE = r"[^\x20\x09-\x0D]"
_END = 1 << 60


def _offset_cost(off: int) -> int:
    """The least cost of being ``off`` turns ahead of the target (behind if negative)."""
    return DELETE * off if off > 0 else -INSERT * off


def align(turns: list[tuple[str, int]], target: str, bound: int) -> tuple[int, str] | None:
    """(cost, least audit) of turning ``turns`` (initial, fault) into ``target``, or None
    where that costs more than ``bound``.

    The table holds the cost from each cell to the end, within the band of cells that
    a way of at most ``bound`` can cross; the audit is read from the start, taking at
    each cell the first edit by letter that keeps the cost.
    """
    n, m = len(turns), len(target)
    last = n - m
    lo = hi = None
    for off in range(-m, n + 1):
        if _offset_cost(off) + _offset_cost(last - off) <= bound:
            lo = off if lo is None else lo
            hi = off
    if lo is None or not lo <= 0 <= hi:
        return None
    width = hi - lo + 1  # cell (i, j) stands at [i][i - j - lo]

    def keep(turn: tuple[str, int], want: str) -> tuple[int, str]:
        initial, fault = turn
        if fault in (BLANK, DUPLICATE):
            return _END, ""
        extra = TRUNCATED if fault == CUT else 0
        if initial == want:
            return extra, "K"
        return (REROLE + extra, "R") if want in ROLES else (_END, "")

    rows = [[_END] * width for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else None
        turn = turns[i] if i < n else None
        for at in range(width):  # a larger column of the band is a smaller j
            j = i - lo - at
            if not 0 <= j <= m:
                continue
            if i == n and j == m:
                row[at] = 0
                continue
            best = _END
            if i < n and at + 1 < width:
                best = DELETE + below[at + 1]
            if j < m:
                if at and target[j] in ROLES:
                    best = min(best, INSERT + row[at - 1])
                if i < n:
                    best = min(best, keep(turn, target[j])[0] + below[at])
            row[at] = best
    cost = rows[0][-lo]
    if cost > bound:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        at, here = i - j - lo, rows[i][i - j - lo]
        if i < n and at + 1 < width and here == DELETE + rows[i + 1][at + 1]:
            audit.append("D")
            i += 1
        elif j < m and at and target[j] in ROLES and here == INSERT + rows[i][at - 1]:
            audit.append("I")
            j += 1
        else:
            audit.append(keep(turns[i], target[j])[1])
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def targets(entry: str, leave: str) -> Iterator[str]:
    """The strings of the grammar that lead from one state to another, shortest first
    (endless but for the states that are left for good)."""
    if leave in ("", "s"):
        if entry == leave:
            yield ""
        elif (entry, leave) == ("", "s"):
            yield "s"
        return
    if entry in ("u", "a"):
        part = "" if entry == leave else leave
        turn = "au" if entry == "u" else "ua"
        while True:
            yield part
            part = turn + part
    heads = ("", "s") if entry == "" else ("",)
    part = "u" if leave == "u" else "ua"
    while True:
        for head in heads:
            yield head + part
        part = "ua" + part


def best_alignment(turns: list[tuple[str, int]], entry: str, leaves: tuple[str, ...]) -> tuple[int, str, str] | None:
    """(cost, audit, target) of the cheapest way from a state to any of ``leaves``; of
    equally cheap ones that with the least audit.  None if no string leads there."""
    n = len(turns)
    forced = sum(f in (BLANK, DUPLICATE) for _, f in turns)

    def floor(size: int) -> int:  # no alignment to so long a target is cheaper
        return DELETE * (n - size) if size <= n - forced else DELETE * forced + INSERT * (size - (n - forced))

    best, bound = None, _END
    waiting: list[str] = []
    for leave in leaves:
        # Deleting everything and inserting the shortest string bounds the longest one.
        shortest = next(targets(entry, leave), None)
        if shortest is None:
            continue
        most = DELETE * n + INSERT * len(shortest) if "s" not in shortest else _END
        longest = n + (min(most, DELETE * n + INSERT * 4) // INSERT) + 4
        for target in targets(entry, leave):
            if len(target) > longest:
                break
            waiting.append(target)
    for target in sorted(waiting, key=lambda t: (floor(len(t)), t)):
        if floor(len(target)) > bound:
            break
        found = align(turns, target, min(bound, DELETE * n + INSERT * len(target) + TRUNCATED * n))
        if found and (best is None or found < best[:2]):
            best, bound = (*found, target), found[0]
    return best


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, key: int | None, block: int):
        self.key, self.block = key, block
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = self.rows = 0
        self.least = self.most = None
        self.initial: str | None = None
        self.seen: set[bytes] = set()
        self.waiting: list[tuple[str, int, str, str]] = []
        # state -> cost, audit, digest of the repaired turns, whether there are any
        self.ways = {"": (0, "", hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        if len(self.waiting) >= self.block:
            self._advance(("", "s", "u", "a"))
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = BLANK if blank else DUPLICATE if digest in self.seen else CUT if cut else OK
        self.seen.add(digest)
        self.faults[fault] += 1
        initial = role[:1]
        if self.rows and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.rows += 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.waiting.append((initial, fault, role, text))

    def _advance(self, leaves: tuple[str, ...], together: bool = False) -> None:
        turns = [(i, f) for i, f, _, _ in self.waiting]
        found: dict[str, tuple[int, str, str, str, str]] = {}
        for entry, (cost, audit, _, _) in self.ways.items():
            for group in (leaves,) if together else [(leaf,) for leaf in leaves]:
                way = best_alignment(turns, entry, group)
                if way is None:
                    continue
                option = (cost + way[0], audit + way[1], entry, way[1], way[2])
                name = group[0]
                if name not in found or option[:2] < found[name][:2]:
                    found[name] = option
        before, self.ways = self.ways, {}
        for name, (cost, audit, entry, edits, target) in found.items():
            _, _, digest, some = before[entry]
            digest, some = digest.copy(), some
            for role, text in repaired(self.waiting, edits, target):
                digest.update((b"\n" if some else b"") + f"{role}:{text}".encode())
                some = True
            self.ways[name] = (cost, audit, digest, some)
        self.waiting = []

    def report(self) -> tuple:
        self._advance(ACCEPTED, together=True)
        cost, audit, digest, _ = self.ways[ACCEPTED[0]]
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.key, gaps, *self.faults[1:], self.illegal, cost, audit, digest.hexdigest())


def repaired(turns: list[tuple[str, int, str, str]], audit: str, target: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired turns: what an audit makes of (initial, fault, role, text)."""
    i = j = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        _, _, role, text = turns[i] if edit != "I" else ("", 0, "", "")
        yield (role if edit == "K" else ROLES[target[j]]), text
        i += edit != "I"
        j += 1


REPORT = pa.schema([
    ("key", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
TURNS = pa.schema([
    ("key", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
])
_FLUSH = 4096


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _reports(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for key, live, turn, role, text, blank, cut in _columns(batch):
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.report())
                        if len(done) >= _FLUSH:
                            yield _batch(done, REPORT)
                            done = []
                    now = _Conversation(key, block)
                if live:
                    now.add(turn, role, text, blank, cut)
        if now is not None:
            done.append(now.report())
        if done:
            yield _batch(done, REPORT)

    return run


def _told(edit: str, at: str, key, place: int, role: str, text: str) -> tuple[tuple, str]:
    """One output row of an edit, and the state after it."""
    if edit == "D":
        return (key, place, edit, role, text), at
    if edit == "K":
        return (key, place, edit, role, text), role[:1]
    after = "a" if at == "u" else "u"
    return (key, place, edit, ROLES[after], text), after


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies audits: each conversation's audit comes first, then its turns in order."""
    out, audit, used, at = [], "", 0, ""
    key = None

    def inserts() -> None:
        nonlocal used, at
        while used < len(audit) and audit[used] == "I":
            row, at = _told("I", at, key, used, "", "")
            out.append(row)
            used += 1

    for batch in batches:
        for k, head, _turn, role, text in _columns(batch):
            if head == 0:
                key, audit, used, at = k, text, 0, ""
                inserts()
                continue
            row, at = _told(audit[used], at, k, used, role, text)
            out.append(row)
            used += 1
            inserts()
            if len(out) >= _FLUSH:
                yield _batch(out, TURNS)
                out = []
    if out:
        yield _batch(out, TURNS)


def _present(turns: DataFrame, key: str, turn: str, role: str, text: str, live: Column | None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(
        F.col(key).cast("bigint").alias("key"), F.coalesce(live if live is not None else F.lit(True), F.lit(False)).alias("live"),
        F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
    )


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    order = ["key", *more, F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("key").sortWithinPartitions(*order)


def repair(
    turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    live: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """One row for each conversation: key, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256.

    Turns count in the order of ``turn`` (nulls first), of equal ones by role and text.
    A turn's first fault counts: blank (no visible character), duplicate (role and text
    seen earlier in the conversation), truncated (its last visible character is not one
    of ``. ! ?``).  ``illegal`` counts neighbours whose initials are not su, ua or au,
    ``gaps`` the turn numbers missing between the least and the greatest.  The audit
    holds an edit for each turn and insertion: K(eep), R(e-role), D(elete), I(nsert);
    the digest is of the repaired ``role:text`` lines.

    Null roles and texts are one space; null keys are one conversation, null turns no
    number; repeated rows are duplicates; rows for which ``live`` is not true only name
    their conversation, and one without turns has zeros, an empty audit and the digest
    of nothing; an empty table gives an empty result; further columns are ignored.
    """
    shown = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    rows = _present(turns, key, turn, role, text, live)
    rows = rows.withColumns({"blank": ~F.col("text").rlike(INSIDE), "cut": ~F.right(shown, F.lit(1)).isin(".", "!", "?")})
    fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in REPORT)
    return _in_order(rows).mapInArrow(_reports(block), fields).withColumnRenamed("key", key)


def repaired_turns(
    turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    live: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """The edits themselves, one row each: key, position (in the audit, from 0), edit,
    role, text.  Without the rows of edit ``D`` these are the repaired conversations.

    Odd rows are taken as by :func:`repair`; conversations without turns have no row.
    """
    audits = repair(turns, key=key, turn=turn, role=role, text=text, live=live, block=block)
    rows = _present(turns, key, turn, role, text, live).where("live")
    heads = audits.select(
        F.col(key).alias("key"), F.lit(0).alias("head"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.col("audit").alias("text"),
    )
    both = heads.unionByName(rows.select("key", F.lit(1).alias("head"), "turn", "role", "text"))
    fields = "key bigint, position bigint, edit string, role string, text string"
    return _in_order(both, "head").mapInArrow(_edited, fields).withColumnRenamed("key", key)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with known faults: conv_id, turn, role, text, live.

    By crc32 of ``conv_id:turn``, modulo 20: 0 drops the row (``live`` is false), 1
    empties its text, 2 takes the ends of its sentences away, 3 says it twice, 4 gives
    it to the user.  Nulls are one space.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("fate") != 0).alias("live"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _sql_step(state: str, edits: list[tuple[str, str, str, str]]) -> str:
    """The least of the ways into a state: (from, cost, letter, line or empty)."""
    ways = [
        f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 't': "
        + (f"list_append({source}.t, {line})" if line else f"{source}.t") + "}"
        for source, cost, letter, line in edits
    ]
    return f"list_sort([{', '.join(ways)}])[1] AS {state}"


def _sql_inserted(state: str, sources: list[str], role: str) -> str:
    made = [f"{{'c': {s}.c + {INSERT}, 'a': {s}.a || 'I', 't': list_append({s}.t, '{role}:')}}" for s in sources]
    return f"list_sort([{state}, {', '.join(made)}])[1] AS {state}"


def _sql_moves() -> str:
    taken = "role || ':' || body"
    no = str(10**9)

    def turn(source: str, initial: str, role: str) -> list[tuple[str, str, str, str]]:
        usable = f"CASE WHEN fault IN ({BLANK}, {DUPLICATE}) OR {{}} THEN {no} ELSE CASE fault WHEN {CUT} THEN {TRUNCATED} ELSE 0 END + {{}} END"
        return [
            (source, usable.format(f"left(role, 1) <> '{initial}'", 0), "K", taken),
            (source, usable.format("false", REROLE), "R", f"'{role}:' || body"),
        ]

    stay = lambda s: [(s, str(DELETE), "D", "")]
    first = f"CASE WHEN fault IN ({BLANK}, {DUPLICATE}) OR left(role, 1) <> 's' THEN {no} ELSE CASE fault WHEN {CUT} THEN {TRUNCATED} ELSE 0 END END"
    return ", ".join([
        _sql_step("e", stay("e")), _sql_step("s", [*stay("s"), ("e", first, "K", taken)]),
        _sql_step("u", [*stay("u"), *turn("e", "u", "user"), *turn("s", "u", "user"), *turn("a", "u", "user")]),
        _sql_step("a", [*stay("a"), *turn("u", "a", "assistant")]),
    ])


def _sql_closed(rows: str) -> str:
    """States after up to two insertions."""
    once = f"SELECT * REPLACE ({_sql_inserted('u', ['e', 's', 'a'], 'user')}, {_sql_inserted('a', ['u'], 'assistant')}) FROM ({rows})"
    return f"SELECT * REPLACE ({_sql_inserted('u', ['e', 's', 'a'], 'user')}, {_sql_inserted('a', ['u'], 'assistant')}) FROM ({once})"


_NEVER = "{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_START = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
_FAULTS = r"""CASE WHEN NOT regexp_matches(body, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, body ORDER BY i) > 1 THEN 2
              WHEN NOT regexp_matches(body, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END"""

#: For the registered query, over damaged ``conversations``: the grammar's four states
#: carried from turn to turn.  CRC-32 goes by its table of 256 remainders.
ORACLE = f"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(0, 8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS r
    FROM (SELECT unnest(range(0, 256)) AS b)
  )
), fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
         xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                                   lambda c: ascii(c)::BIGINT)),
           lambda x, c: xor(x // 256, t[(xor(x, c) % 256 + 1)::INT])), 4294967295) % 20 AS fate
  FROM conversations, remainders
), hurt AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(body, '.!?', '') ELSE body END AS body,
         unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM fates
), ordered AS (
  SELECT *, {_FAULTS} AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS i FROM hurt)
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ordered GROUP BY conv_id
), every AS (
  SELECT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
         coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
), ways AS (
  {_sql_closed(f"SELECT conv_id, 0::BIGINT AS i, {_START} AS e, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM every")}
  UNION ALL
  {_sql_closed(f"SELECT w.conv_id, w.i + 1 AS i, {_sql_moves()} FROM ways w JOIN ordered o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1")}
)
SELECT v.conv_id, gaps, blank, duplicate, truncated, illegal, list_sort([e, a])[1].c AS cost, list_sort([e, a])[1].a AS audit,
       sha256(array_to_string(list_sort([e, a])[1].t, chr(10))) AS repaired_sha256
FROM every v JOIN ways w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.i = v.n"""
