"""Secret scan: one deterministic automaton for all rules, read over the bytes of each text once.

The combined automaton reads a text from its last byte to its first; where it accepts, a match of the
accepted rules starts. So one pass finds every start of every rule. Ends aren't found by that automaton: an
anchored one, compiled from the rule alone in the same way, walks to the longest end, from starts that no
earlier match of the rule covers.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import automaton
from lectern.llm.common import text_buffer


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` then ``tail``; it counts if the tail, or with ``whole`` all of it, has
    ``least`` bytes. A match that fails still covers its bytes."""

    kind: str
    head: str
    tail: str
    least: int
    whole: bool = True
    ignore_case: bool = False
    base: bool = True


#: The base rules and the token formats of public services.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=\-]+", 6, whole=False, ignore_case=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 20),
    Rule("hex", r"", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 40, base=False),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9\-]+", 15, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.", r"[A-Za-z0-9_\-]+", 40, base=False),
    Rule("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY", r"-----", 20, base=False),
)


class Accepting:
    """Stands for an accepting state's row of transitions. It can't be indexed, so the scan's loop needs
    no test at each byte: the step after an accepting state raises TypeError."""

    def __init__(self, bits: int):
        self.bits, self.after = bits, []


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [automaton.parse(r.head + r.tail, r.ignore_case) for r in rules]
        dfa = automaton.build([automaton.mirrored(t) for t in trees], anywhere=True)
        n = len(dfa.rules)
        # A state is its row of transitions: 256 references to the rows of the next states.
        rows = [Accepting(bits) if bits else [] for bits in dfa.rules.tolist()]
        for q in range(n):
            steps = [rows[x // 256] for x in dfa.table[q * 256 : q * 256 + 256].tolist()]
            if isinstance(rows[q], Accepting):
                rows[q].after = steps
            else:
                rows[q].extend(steps)
        self.first, self.n_states = rows[dfa.start // 256], n
        self.whole = [_walker(automaton.build([t], anywhere=False)) for t in trees]
        self.heads = [_walker(automaton.build([automaton.parse(r.head, r.ignore_case)], anywhere=False)) for r in rules]

    def starts(self, data: bytes) -> tuple[array, array, array]:
        """Runs of positions at which matches of the same rules start, from the last to the first: the first and
        the last position of each, and the rules' bits. This is the one pass."""
        row, left = self.first, reversed(data)
        low, high, bits = array("q"), array("q"), array("q")
        while True:
            try:
                for byte in left:
                    row = row[byte]
                if not isinstance(row, Accepting):
                    break
                at, byte = 0, None
            except TypeError:  # the row before this byte accepts
                at = left.__length_hint__() + 1
            # Through a run of starts, as of a long hexadecimal text, without an exception for each.
            first, rules = at, row.bits
            while byte is not None:
                row = row.after[byte]
                if not isinstance(row, Accepting) or row.bits != rules:
                    break
                at -= 1
                byte = next(left, None)
            low.append(at)
            high.append(first)
            bits.append(rules)
            if byte is None:
                break
        return low, high, bits

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes: leftmost, longest, not overlapping within a rule."""
        free, out = [0] * len(self.rules), []
        low, high, bits = self.starts(data)
        for i in range(len(low) - 1, -1, -1):
            for k, rule in enumerate(self.rules):
                if not bits[i] >> k & 1:
                    continue
                at = max(low[i], free[k])
                while at <= high[i]:
                    end = free[k] = self.whole[k](data, at)
                    if end - (at if rule.whole else self.heads[k](data, at)) >= rule.least:
                        out.append((at, k, end))
                    at = max(end, at + 1)
        return sorted(out)


def _walker(dfa: automaton.Dfa):
    table, accepting, dead, first = dfa.table.tolist(), dfa.accepting, dfa.dead, dfa.start

    def longest(data: bytes, at: int) -> int:
        """The end of the longest match that starts at ``at``."""
        state, end = first, at
        for i in range(at, len(data)):
            state = table[state + data[i]]
            if state >= accepting:
                end = i + 1
            elif state == dead:
                break
        return end

    return longest


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once in each process."""
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans, counted in code points."""
    place, last, chars = {}, 0, 0
    for x in sorted({x for s in spans for x in (s[0], s[2])}):
        chars += len(data[last:x].decode("utf-8", "replace"))
        place[x] = chars
        last = x
    return [(place[a], k, place[b]) for a, k, b in spans]


SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per input row: doc_id and its spans (kinds, starts, ends in code points, end exclusive), by
    start and then in the rules' order.

    Null and empty texts have no spans; repeated rows are scanned each; a null id stays null; an empty
    table gives no rows. Texts of any length are read whole; matches don't cross texts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = scanner(rules)
        names = [r.kind for r in rules]
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            kinds, starts, ends = [], [], []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                spans = code_points(raw, engine.spans(raw))
                kinds.append([names[k] for _, k, _ in spans])
                starts.append([a for a, _, _ in spans])
                ends.append([b for _, _, b in spans])
            yield pa.record_batch(
                [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)


def secret_report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of ``find_secrets``'s spans."""
    base = [r.kind for r in rules if r.base]
    listed = F.arrays_zip("kinds", "starts", "ends")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter(listed, lambda s: s["kinds"].isin(base))), 256).alias("base_sha256"),
        joined(listed).alias("spans"),
    )


def brute_force(text: str | None) -> list[tuple[int, str, int]]:
    """The base spans by the standard library's expressions, for tests."""
    import re

    text, out = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(a, RULES[k].kind, b) for a, k, b in sorted(out)]


def digest_of(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def _oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same spans in SQL: a text splits at a rule's matches, and the lengths of pieces and matches give places."""

    def row(k: int, r: Rule) -> str:
        head, tail = (p.replace("(", "(?:").replace("'", "''") for p in (r.head, r.tail))
        pattern = f"({head}{tail})" if r.whole else f"(?i:{head})({tail})"
        return f"({k}, '{r.kind}', {str(r.base).lower()}, {r.least}, '{pattern}')"

    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r(k, kind, base, least, pattern) AS (VALUES {", ".join(row(k, r) for k, r in enumerate(rules))}),
m AS (SELECT doc_id, k, kind, base, least, regexp_extract_all(t, pattern, 0) AS a, regexp_extract_all(t, pattern, 1) AS g, regexp_split_to_array(t, pattern) AS p FROM d, r),
x AS (SELECT doc_id, k, kind, base, least, unnest(a) AS s, unnest(g) AS g, unnest(p[1:len(a)]) AS gap, generate_subscripts(a, 1) AS i FROM m WHERE len(a) > 0),
y AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM x),
z AS (SELECT doc_id, k, kind, base, stop - length(s) AS start, kind || ':' || (stop - length(s)) || ':' || stop AS span FROM y WHERE length(g) >= least)
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
