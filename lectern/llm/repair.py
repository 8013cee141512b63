"""Repair of conversations' structure: the cheapest edits after which roles alternate, by A* on the edit lattice.

A state is (rows consumed, what the last role was). Each move appends a letter to the audit: K(eep), R(erole), D(elete)
or I(nsert). What rows cost at the least, whatever happens to their roles, sums up from the end of a conversation to the
heuristic: 3 for each row that must go, 1 for each truncated one. So it never overestimates, and states leave the queue by
(cost plus heuristic, audit). Two audits of equal cost that lead to one state are never prefixes of each other, as
inserts cost and both consume the same rows; so the first to leave the queue is the least, whatever follows.

A* sees one character for each row. Longer conversations than ``PIECE`` rows are searched in pieces, from each state to each
state; pieces are then chained by the same order, so that no search's audits grow with the conversation. Texts stay in Spark's
rows: one sort by conversation gives positions, faults and codes, another brings each conversation's edits before its
rows, which one pass reads in order, holding a digest and a batch, never a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lectern.llm.common import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: Rows that one search works on.
PIECE = 128

#: What the last role was, and which roles may follow: s(ystem) at the start only, then u(ser) and a(ssistant) in turn.
START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = (START, ASSISTANT)
SPACES = " \t\n\v\f\r"

# A row's code: its role's initial, or - for one that can't be kept; in upper case if it is truncated; x if it must go.


def row_bound(code: str) -> int:
    """The least that a row of this code costs."""
    return COSTS[DELETE] if code == "x" else TRUNCATED_COST if code.isupper() or code == "_" else 0


def moves(state: str, code: str) -> Iterator[tuple[str, str, int]]:
    """(letter, next state, cost) of all that can be done with a row."""
    yield DELETE, state, COSTS[DELETE]
    if code == "x":
        return
    extra = row_bound(code)
    own = code.lower()
    for initial, after in FOLLOWS[state].items():
        if initial == own:
            yield KEEP, after, extra
        elif initial in "ua":
            yield REROLE, after, COSTS[REROLE] + extra


def search(codes: str, start: str = START) -> dict[str, tuple[int, str]]:
    """The least (cost, audit) from ``start`` before the first row to each state after the last."""
    n = len(codes)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + row_bound(codes[i])
    queue: list[tuple[int, str, int, str]] = [(rest[0], "", 0, start)]
    done: set[tuple[int, str]] = set()
    found: dict[str, tuple[int, str]] = {}
    while queue:
        bound, audit, i, state = heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - rest[i]
        if i == n:
            found[state] = (cost, audit)
        else:
            for letter, after, price in moves(state, codes[i]):
                if (i + 1, after) not in done:
                    heappush(queue, (cost + price + rest[i + 1], audit + letter, i + 1, after))
        for initial, after in FOLLOWS[state].items():
            if initial in "ua" and (i, after) not in done:
                heappush(queue, (bound + COSTS[INSERT], audit + INSERT, i, after))
    return found


def cheapest(codes: str, piece: int = PIECE) -> tuple[int, str]:
    """The least (cost, audit) that repairs a conversation. Pieces are chained from the left: of the ways into a
    state the least by cost, then by audit, letter for letter."""
    best: dict[str, tuple[int, tuple[str, ...]]] = {START: (0, ())}
    for at in range(0, max(len(codes), 1), piece):
        after: dict[str, tuple[int, tuple[str, ...]]] = {}
        for state, (cost, audits) in best.items():
            for end, (price, audit) in search(codes[at : at + piece], state).items():
                new = (cost + price, (*audits, audit))
                if end not in after or new[0] < after[end][0] or (new[0] == after[end][0] and _before(new[1], after[end][1])):
                    after[end] = new
        best = after
    ends = [best[e] for e in ENDS if e in best]
    least = ends[0]
    for other in ends[1:]:
        if other[0] < least[0] or (other[0] == least[0] and _before(other[1], least[1])):
            least = other
    return least[0], "".join(least[1])


def _before(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether the audits a, as one string, come before b. Pieces are of the same rows, so what both share is skipped."""
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return "".join(a[k:]) < "".join(b[k:])


@F.pandas_udf(StructType([StructField("cost", LongType()), StructField("audit", StringType())]))
def _searched(codes: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple[int, str]] = {}
    out = []
    for c in codes:
        if c not in known:
            if len(known) > 10_000 or len(c) > 1_000:
                known = {}
            known[c] = cheapest(c)
        out.append(known[c])
    return pd.DataFrame(out, columns=["cost", "audit"])


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with pos from 1 in each conversation, by turn (nulls first), role and text;
    blank, duplicate and truncated, of which the first that holds alone is set; illegal, whether role initials may not
    stand after the row before; and the row's code."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumns({"pos": F.row_number().over(order), "__prev": F.lag(F.substring("role", 1, 1)).over(order)})
    seen = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("pos")) > 1
    placed = placed.withColumn("__seen", seen)
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    blank = bare == ""
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    pair = F.concat("__prev", initial)
    code = F.when(blank | F.col("__seen"), "x").when(initial.isin("s", "u", "a"), F.when(cut, F.upper(initial)).otherwise(initial)).otherwise(F.when(cut, "_").otherwise("-"))
    return placed.select(
        "conv", "turn", "role", "text", "pos", blank.alias("blank"), (~blank & F.col("__seen")).alias("duplicate"), (~blank & ~F.col("__seen") & cut).alias("truncated"),
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"), code.alias("code"),
    )


SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def plans(marked: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): one row for each conversation. Of its rows, only a
    character each comes together."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum(F.col("__new").cast("long")), F.lit(0)).cast("long")
    # A turn is new where the one before is another: rows come by turn, so that none is collected to be told apart.
    new = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(Window.partitionBy("conv").orderBy("pos")) == F.col("turn"), F.lit(False))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    one = marked.select("conv", "turn", "pos", *SUMS[1:], "code", new.alias("__new")).groupBy("conv").agg(gaps.alias("gaps"), *[count(c) for c in SUMS[1:]], codes.alias("__codes"))
    return one.withColumn("__found", _searched("__codes")).select("conv", *SUMS, "__found.cost", "__found.audit")


def _stream(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, pos, kind, audit, role, text): each conversation's plan, then its rows in order, in one partition."""
    text = F.lit(None).cast("string")
    heads = planned.select("conv", F.lit(0).alias("pos"), "audit", text.alias("role"), text.alias("text"))
    rows = marked.select("conv", "pos", text.alias("audit"), "role", "text")
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "pos")


def applied(audit: str, at: int, emitted: int, has_system: bool) -> tuple[list[str], int]:
    """The roles that inserts before the next row of a plan give, and where they end."""
    roles = []
    while at < len(audit) and audit[at] == INSERT:
        roles.append("user" if (emitted + len(roles) - has_system) % 2 == 0 else "assistant")
        at += 1
    return roles, at


def repaired_rows(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, seq, role, text, edit): the conversations after their edits, seq from 1. Deleted rows are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, seq, has_system, live = None, "", 0, 0, False, False
        for batch in batches:
            out: list[tuple] = []
            for c, pos, plan, role, text in zip(*(col.to_pylist() for col in batch.columns)):
                if pos == 0:
                    if live:
                        for r in applied(audit, at, seq, has_system)[0]:
                            seq += 1
                            out.append((conv, seq, r, "", INSERT))
                    conv, audit, at, seq, has_system, live = c, plan, 0, 0, False, True
                    continue
                before, at = applied(audit, at, seq, has_system)
                for r in before:
                    seq += 1
                    out.append((c, seq, r, "", INSERT))
                edit, at = audit[at], at + 1
                if edit == DELETE:
                    continue
                if edit == REROLE:
                    role = "user" if (seq - has_system) % 2 == 0 else "assistant"
                has_system = has_system or (seq == 0 and edit == KEEP and role[:1] == "s")
                seq += 1
                out.append((c, seq, role, text, edit))
            yield _batch(out)
        if live:
            yield _batch([(conv, seq + 1 + k, r, "", INSERT) for k, r in enumerate(applied(audit, at, seq, has_system)[0])])

    names = ["conv", "seq", "role", "text", "edit"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return _stream(marked, planned).select("conv", "pos", "audit", "role", "text").mapInArrow(run, "conv long, seq long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ``repaired_rows`` as they come, in order: lines role:text, one digest running."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, live = None, None, False
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                line = f"{role}:{text}".encode()
                if live and c == conv:
                    digest.update(b"\n" + line)
                    continue
                if live:
                    out.append((conv, digest.hexdigest()))
                conv, digest, live = c, hashlib.sha256(line), True
            yield _pairs(out)
        if live:
            yield _pairs([(conv, digest.hexdigest())])

    def _pairs(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv", "repaired_sha256"])

    return repaired.select("conv", "role", "text").mapInArrow(run, "conv long, repaired_sha256 string")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Null roles and texts count as one space. Rows go by turn, null turns first; rows of one turn by role and text. Rows of a
    null conversation are one conversation. Repeated rows are duplicates. A role that begins with no s, u or a can't be kept as it is, nor can
    an empty one. With ``every`` (conv_id), conversations that ``rows`` doesn't have come too, with zeros, an empty audit
    and the digest of nothing. Empty tables give no rows; other columns are ignored, whatever their names. A long
    conversation's edits are one string, its rows pass one task in batches.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    known = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    marked = stored(faults(known), "marked-turns")
    planned = stored(plans(marked), "repair-plans")
    done = digests(repaired_rows(marked, planned))
    found = planned.join(done, planned["conv"].eqNullSafe(done["conv"]), "left").drop(done["conv"])
    if every is not None:
        ids = every.select(F.col(f"`{conv_col}`").cast("long").alias("__id")).distinct()
        found = ids.join(found, ids["__id"].eqNullSafe(found["conv"]), "left").withColumn("conv", F.col("__id"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*SUMS, "cost"]]
    return found.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """The table (conv_id, turn, role, text) with the faults that a hash of conversation and turn deals out: of twenty
    rows one is lost, one emptied, one stripped of its sentence ends, one repeated and one said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("__copy")).drop("__copy")


# States after up to two inserts, and how many: more only add cost.
_STEPS = {state: [(state, 0)] + [(after, 1) for i, after in FOLLOWS[state].items() if i in "ua"] for state in FOLLOWS}
_INSERTS = sorted({(a, b, k + m) for a in FOLLOWS for b1, k in _STEPS[a] for b, m in _STEPS[b1]}, key=lambda x: (x[0], x[2], x[1]))
_INSERTS_SQL = ", ".join(f"('{a}', '{b}', {k}, '{INSERT * k}')" for a, b, k in _INSERTS)
_KEEPS_SQL = ", ".join(f"('{a}', '{i}', '{b}')" for a in FOLLOWS for i, b in FOLLOWS[a].items())

ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), bytes AS (SELECT k, [ascii(substr(k, i::BIGINT, 1)) FOR i IN range(1, length(k) + 1)] AS b FROM (SELECT DISTINCT k FROM src)
), crc AS (
  SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [x::BIGINT FOR x IN b]), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 20 AS kind FROM bytes
), dmg AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src JOIN crc USING (k) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS prev, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM dmg WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM placed
), marked AS (
  SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         coalesce(prev || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen
), ins(a, b, k, letters) AS (VALUES {_INSERTS_SQL}), keeps(a, initial, b) AS (VALUES {_KEEPS_SQL}
), edits AS (
  SELECT m.conv_id, m.pos, s.a, s.a AS b, 'D' AS letter, 3 AS cost FROM marked m, (SELECT DISTINCT a FROM ins) s
  UNION ALL SELECT m.conv_id, m.pos, k.a, k.b, 'K', m.cut::INT FROM marked m JOIN keeps k ON k.initial = m.initial WHERE NOT m.blank AND NOT m.dup
  UNION ALL SELECT m.conv_id, m.pos, k.a, k.b, 'R', 2 + m.cut::INT FROM marked m JOIN keeps k ON k.initial <> m.initial AND k.initial <> 's' WHERE NOT m.blank AND NOT m.dup
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, '' AS q, 0 AS cost, '' AS audit FROM marked
  UNION ALL
  SELECT conv_id, pos, q, best.cost, best.audit FROM (
    SELECT w.conv_id, e.pos, e.b AS q, min({{'cost': w.cost + 2 * i.k + e.cost, 'audit': w.audit || i.letters || e.letter}}) AS best
    FROM walk w JOIN ins i ON i.a = w.q JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.pos = w.pos + 1 AND e.a = i.b GROUP BY ALL)
), sized AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (cut) AS cut, count(*) FILTER (illegal) AS illegal FROM marked GROUP BY conv_id
), plan AS (
  SELECT w.conv_id, min({{'cost': w.cost + 2 * i.k, 'audit': w.audit || i.letters}}) AS best
  FROM walk w JOIN sized z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = z.n JOIN ins i ON i.a = w.q WHERE i.b IN ('', 'a') GROUP BY w.conv_id
), letters AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS ix FROM plan WHERE best.audit <> ''
), placed_letters AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY ix) AS pos, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY ix) AS seq FROM letters
), said AS (
  SELECT l.conv_id, l.seq, l.letter, m.role, CASE WHEN l.letter = 'I' THEN '' ELSE m.text END AS text, bool_or(l.seq = 1 AND l.letter = 'K' AND m.initial = 's') OVER (PARTITION BY l.conv_id) AS has_s
  FROM placed_letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.pos = l.pos AND l.letter <> 'I' WHERE l.letter <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (seq - has_s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY seq)) AS sha FROM said GROUP BY conv_id
)
SELECT o.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0)::BIGINT AS blank, coalesce(z.dup, 0)::BIGINT AS duplicate, coalesce(z.cut, 0)::BIGINT AS truncated, coalesce(z.illegal, 0)::BIGINT AS illegal,
       coalesce(p.best.cost, 0)::BIGINT AS cost, coalesce(p.best.audit, '') AS audit, coalesce(r.sha, '{EMPTY_SHA256}') AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sized z ON z.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
