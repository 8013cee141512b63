"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has a piece that no edit
touches. So the pieces are looked up exactly, all at once, and only around a hit the item itself is
compared, by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import restricted, shared_folder, stored

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of benchmark items that one automaton holds; more items make further rounds over the texts.
BLOCK_CHARS = 2_000_000

_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def folded(text: str | None) -> str:
    """Lower-cased, whitespace runs as one space, none at the ends."""
    return _SPACE.sub(" ", (text or "").lower()).strip(" ")


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int

    def pieces(self) -> list[tuple[int, str]]:
        """budget + 1 adjoining pieces of nearly equal length, with their offsets."""
        n, k = len(self.text), self.budget + 1
        cuts = [n * j // k for j in range(k + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def item_of(item_id: int, text: str, rate: float = ERROR_RATE) -> Item:
    body = folded(text)
    return Item(item_id, body, int(len(body) * rate))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the best substring of ``text`` for the pattern of length m whose character
    masks are given, the first end if several are best; None beyond ``limit``.

    Myers' recurrence: bit i of vp or vn says that the distance column rises or falls by one there; as
    a match may begin anywhere, the row above the pattern is all zero.
    """
    ones, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = ones, 0, m, None
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        same = eq | vn
        diagonal = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(diagonal | vp)
        hn = vp & diagonal
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & ones, hn << 1 & ones
        vp, vn = hn | (~(same | hp) & ones), hp & same
        if score <= limit and (best is None or score < best[0]):
            best = (score, end)
    return best


class Matcher:
    """One Aho-Corasick automaton over all pieces of a block of items."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = [x for x in items if x.text]
        self.masks = [masks(x.text) for x in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in item.pieces():
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least distance) of each item that occurs in ``text``, which must be folded."""
        if not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            begin = last + 1 - size
            for k, offset in uses:
                item = self.items[k]
                first = begin - offset
                windows.setdefault(k, []).append((max(0, first - item.budget), first + len(item.text) + item.budget))
        found = []
        for k, spans in windows.items():
            item, best = self.items[k], None
            for a, b in merged(spans):
                got = best_match(self.masks[k], len(item.text), text[a:b], item.budget)
                if got and (best is None or got[0] < best):
                    best = got[0]
            if best is not None:
                found.append((item.item_id, best))
        return sorted(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined, so that no character is compared twice for an item."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, limit: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items in blocks of about ``limit`` characters, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        if row[0] is None or not (item := item_of(row[0], row[1], rate)).text:
            continue
        block.append(item)
        size += len(item.text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, distance int"


def _search(items: list[Item], key: str):
    """For rows (key, text): (key, item_id, distance) of all items that occur in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            rows = [(d, i, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, e in matcher.find(folded(t))]
            ids, hits, edits = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(hits, pa.int64()), pa.array(edits, pa.int32())], names=[key, "item_id", "distance"])

    return run


def _hits(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, rate: float, limit: int) -> DataFrame:
    """``_search`` of (key, text) rows for the whole benchmark. A benchmark of one block is one lazy map. Of a
    longer one, each block makes a round over the texts, whose hits are written before the next block is
    read: the driver and every worker hold one block, however long the benchmark is."""
    key, kind = rows.dtypes[0]
    schema = f"{key} {kind}, item_id long, distance int"
    parts = blocks(benchmark, item_col, item_text, rate, limit)
    block, following = next(parts, None), next(parts, None)
    if block is None:
        return rows.limit(0).select(key, F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("distance"))
    if following is None:
        return rows.mapInArrow(_search(block, key), schema)
    path = f"{shared_folder(rows.sparkSession)}/benchmark-hits-{uuid.uuid4().hex}"
    while block is not None:
        rows.mapInArrow(_search(block, key), schema).write.mode("append").parquet(path)
        block, following = following, next(parts, None)
    return rows.sparkSession.read.schema(schema).parquet(path)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """A row (doc_id, item_id, distance) for each document and item where some part of the document's
    folded text is within the item's edit budget (``rate`` times its length, rounded down).

    Null and empty texts contain nothing; empty items and items without id are left out. Repeated rows,
    of documents or of items, give repeated rows here; a null id stays null. An empty table on either side
    gives no rows; other columns are ignored. Long texts are searched whole. The benchmark is read in blocks
    of ``block_chars`` characters, so neither side has to fit in one task.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _hits(texts, benchmark, item_col, item_text, rate, block_chars)


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents without a leak, with all columns of the input, whatever their names.

    Null and empty texts stay; repeated rows stay or go together, as the text alone decides, and so do rows
    without an id. An empty table stays empty, an empty benchmark lets all rows stay. With a benchmark of
    one block nothing is shuffled: the rows are filtered where they are. With more, the rounds leave the
    SHA-256 digests of texts that hold an item, and rows are anti-joined with these.
    """
    parts = blocks(benchmark, item_col, item_text, rate, block_chars)
    block, following = next(parts, None), next(parts, None)
    if block is None:
        return docs
    if following is not None:
        digest = F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))
        texts = docs.select(digest.alias("digest"), F.col(f"`{text_col}`").alias("text"))
        found = _hits(texts, benchmark, item_col, item_text, rate, block_chars).select(F.col("digest").alias("__found")).distinct()
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), digest.alias("__digest"))
        return restricted(rows, stored(found, "leaked-texts"), F.col("__digest") == F.col("__found"), "left_anti").select("__row.*")
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block)
        for batch in batches:
            yield batch.filter(pa.array([not (t and matcher.find(folded(t))) for t in batch.column(place).to_pylist()], pa.bool_()))

    # Python workers get plain names: a name with a dot can't be handed to them.
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
