"""Suffix-array dedup: bytes of passages that an earlier document holds too.

A byte goes if some string of 50 bytes over it also starts in a document of a smaller id. Sorting every
suffix of the corpus would move each byte many times, so suffixes are sampled: of the 16-byte grams in a
50-byte window, the one of the least hash is its anchor, and equal windows have equal anchors. The
windows around one anchor form a region. Regions whose anchor's gram only one document has are settled;
all others are compared: the suffixes that start at the anchors of one gram are sorted by common
extensions, and these, on both sides of the anchors, tell which windows are equal. Hashes bring together
and order; bytes decide.

A gram that very many documents share is sorted in about the square root of its regions, in as many groups.
Regions that lead a group in some window go on to a second sort, where the leaders of all groups meet by 33
of the windows' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import gram_hashes, mixed, prefix_hashes, removed, restricted, salts, scratch_path, slices, span_hashes, split_plan, stored, text_buffer, within
from lectern.llm.suffix_sort import Suffixes, same_bytes

LENGTH = 50
GRAM = 16
#: Windows that one anchor can serve.
REACH = LENGTH - GRAM + 1
#: Grams of more regions than this, as the planning sample has it, are sorted in groups.
GROUP_ROWS = 1_000
#: Leading regions of one key that are sorted at once at most.
MOST_ROWS = 2_000
#: Bytes of a window, besides the gram, by which leading regions meet again: half of what it has.
SIDE = (LENGTH - GRAM) // 2
#: One document in so many plans which grams are split. It decides the layout only, never a result.
SAMPLE = 64
#: Rounds, a power of two, in which grams are compared: each has its part of the regions in a shuffle at a time.
ROUNDS = 2
#: Regions that one step sorts.
SORT_ROWS = 6_000


_PLACE = np.uint64((1 << 26) - 1)
#: Longer slices, of a single long text, are cut in pieces of so many windows.
PIECE = 1 << 19


def _pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """``regions`` of a long slice. A region that a cut divides is two."""
    parts = []
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        end = min(len(data), at + PIECE + LENGTH - 1)
        inner = np.clip(bounds, at, end) - at
        text, first, windows, anchor, gram, whole = regions(data[at:end], inner)
        parts.append((text, first + at, windows, anchor + at, gram, whole))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def regions(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """All regions of some texts that lie one after the other in ``data``: text, first window, windows,
    anchor, and the hashes of the anchor's gram and of the region."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n > PIECE + LENGTH:
        return _pieces(data, bounds)
    prefix = prefix_hashes(data)
    gram = gram_hashes(prefix, GRAM)
    # The least gram of REACH neighbours by the upper bits of its hash, the leftmost of equal ones: the lower
    # bits hold its place. Windows double until they reach far enough.
    least, width = gram & ~_PLACE | np.arange(n - GRAM + 1, dtype=np.uint64), 1
    while width < REACH:
        step = min(width, REACH - width)
        least = np.minimum(least[step:], least[:-step])
        width += step
    where = (least & _PLACE).astype(np.int64)
    # Windows that reach beyond their text don't count; as each text has some at its end, no run of equal anchors crosses texts.
    fits = np.ones(len(where), bool)
    for end in bounds[1:]:
        fits[max(0, end - LENGTH + 1) : end] = False
    change = np.ones(len(where), bool)
    change[1:] = (where[1:] != where[:-1]) | (fits[1:] != fits[:-1])
    first = np.nonzero(change)[0]
    last = np.append(first[1:], len(where)) - 1
    ok = fits[first]
    first, last = first[ok], last[ok]
    text = np.searchsorted(bounds, first, "right") - 1
    anchor = where[first]
    shape = mixed(((anchor - first) * 64 + (last - first)).astype(np.uint64), 5)
    whole = mixed(span_hashes(prefix, first, last + LENGTH) ^ shape, 6)
    return text, first, last - first + 1, anchor, gram[anchor], whole


def cut_regions(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """Slices of texts: number of the first text, the bytes, their bounds, the regions."""
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets, 1 << 18):
        part = data[offsets[a] : offsets[b]]
        bounds = offsets[a : b + 1] - offsets[a]
        yield a, part, bounds, regions(part, bounds)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _anchored(docs: DataFrame, without: np.ndarray) -> DataFrame:
    """(gram, doc), once for each document, but for the grams in the sorted array ``without``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, _, (text, _, _, _, gram, _) in cut_regions(batch.column(1)):
                if len(without):
                    light = ~within(gram, without)
                    text, gram = text[light], gram[light]
                order = np.lexsort((gram, text))
                t, g = text[order], gram[order]
                new = _changes(t, g)
                yield pa.record_batch([pa.array(g[new].view(np.int64)), pa.array(ids[a + t[new]], pa.int64())], names=["gram", "doc"])

    return docs.mapInArrow(run, "gram long, doc long")


#: A region, packed: the numbers of HEADER, as many places as it says, as 64-bit integers, and its bytes. So a task
#: sorts and hands over three columns instead of eight.
CONTEXT = "gram long, salt int, body binary"
HEADER = np.dtype([("doc", "<i8"), ("row", "<i8"), ("lead", "<u8"), ("before", "u1"), ("windows", "u1"), ("places", "<u4")])


def _packed(header: np.ndarray, places: bytes, raw: bytes, first: np.ndarray, size: np.ndarray) -> pa.Array:
    heads, width = header.tobytes(), HEADER.itemsize
    ends = np.cumsum(header["places"].astype(np.int64) * 8)
    rows = zip(range(0, len(heads), width), (ends - header["places"].astype(np.int64) * 8).tolist(), ends.tolist(), first.tolist(), size.tolist(), strict=True)
    return pa.array([heads[h : h + width] + places[a:b] + raw[p : p + m] for h, a, b, p, m in rows], pa.binary())


def _unpacked(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Headers, all places, and the bytes of all regions with their bounds."""
    data, offsets = text_buffer(bodies.cast(pa.large_binary()).view(pa.large_string()))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    header = np.ascontiguousarray(data[offsets[:-1, None] + np.arange(HEADER.itemsize)]).view(HEADER).ravel()
    middle = offsets[:-1] + HEADER.itemsize
    text = middle + header["places"].astype(np.int64) * 8

    def between(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        return data[np.cumsum(edge[:-1], dtype=np.int8) > 0]

    return header, between(middle, text).view(np.int64), between(text, offsets[1:]), np.concatenate([[0], np.cumsum(offsets[1:] - text)])


def _contexts(docs: DataFrame, split: np.ndarray, parts: np.ndarray, turn: int) -> DataFrame:
    """The regions around the grams that each document (doc, row, text, grams) was asked for, and around the split
    ones of this round: equal regions of a document once, with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            grams = batch.column(3)
            values, edges = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(grams.offsets).astype(np.int64)
            for a, data, bounds, (text, first, windows, anchor, gram, whole) in cut_regions(batch.column(2)):
                n = len(bounds) - 1
                # A number for text and gram together; where two collide, a region too many is compared, no more.
                of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(edges[a : a + n + 1]))
                asked = np.sort(values[edges[a] : edges[a + n]] + mixed(of, 9))
                hot = within(gram, split) & (gram % np.uint64(ROUNDS) == turn)
                k = np.nonzero(within(gram + mixed(text.astype(np.uint64), 9), asked) | hot)[0]
                if not len(k):
                    continue
                raw = data.tobytes()
                k = k[np.lexsort((first[k], whole[k], text[k]))]
                new = _changes(text[k], whole[k])
                again = np.nonzero(~new)[0]
                before, after = k[again - 1], k[again]
                size = windows + LENGTH - 1
                new[again] = (size[before] != size[after]) | ~same_bytes(raw, first[before], first[after], size[after])
                head = k[new]
                places = (first[k] - bounds[text[k]]).astype(np.int64)
                header = np.zeros(len(head), HEADER)
                header["doc"], header["row"], header["before"], header["windows"] = ids[a + text[head]], rows[a + text[head]], anchor[head] - first[head], windows[head]
                header["places"] = np.diff(np.append(np.nonzero(new)[0], len(k)))
                salt = salts(gram[head], header["doc"], split, parts).astype(np.int32)
                yield pa.record_batch([pa.array(gram[head].view(np.int64)), pa.array(salt), _packed(header, places.tobytes(), raw, first[head], size[head])], names=["gram", "salt", "body"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, CONTEXT)


def _binary(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of 64-bit integers, ``count`` in each, as binary values."""
    offsets = np.concatenate([[0], np.cumsum(count.astype(np.int64) * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def resolve(group: np.ndarray, doc: np.ndarray, before: np.ndarray, windows: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For regions that lie one after the other in ``data``: a bit for each window that a region of the
    same group and of a smaller document has too, and a bit for each window of which the region's document
    is the smallest in its group.

    Whatever hashes call equal is compared by bytes. A group in which hashes collided is done over by bytes alone.
    """
    covered, leading = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
    if not len(doc):
        return covered, leading
    raw = data.tobytes()
    anchor = bounds[:-1] + before
    length = bounds[1:] - anchor
    every = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
    suffixes = Suffixes(data, anchor, bounds[1:], group)
    order = suffixes.sort()
    ahead = suffixes.neighbours(order)
    doubtful = [group[order[~suffixes.verified(raw, order, ahead)]]]

    # Equal regions: equal after the anchor, which makes them neighbours, and before it.
    equal = np.zeros(len(order), bool)
    equal[1:] = (group[order[1:]] == group[order[:-1]]) & (ahead[1:] == length[order[1:]]) & (ahead[1:] == length[order[:-1]])
    run = np.cumsum(~equal)
    left = suffixes.spans(bounds[:-1], anchor)
    order = order[np.lexsort((doc[order], left[order], before[order], run))]
    new = _changes(run, left[order], before[order])
    again = np.nonzero(~new)[0]
    p, q = order[again - 1], order[again]
    doubtful.append(group[q[~same_bytes(raw, bounds[p], bounds[q], before[q])]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]

    # Windows of different regions of a group. Suffixes that agree on what a window has after the anchor are neighbours; of them, those agree on the window that agree before the anchor.
    pos = np.nonzero(new)[0]
    several = np.bincount(group[order[pos]])[group[order[pos]]] > 1
    alone = order[pos[~several]]
    leading[alone] = every[alone]
    rep, shared = order[pos[several]], ahead[pos[several]]
    fresh = _changes(group[rep])
    for back in range(REACH):
        index = before[rep] - back
        members = np.nonzero((index >= 0) & (index < windows[rep]))[0]
        if not len(members):
            continue
        run = np.cumsum(fresh | (shared < LENGTH - back))[members]
        row = rep[members]
        bit = np.uint64(1) << index[members].astype(np.uint64)
        single = np.bincount(run)[run] == 1
        leading[row[single]] |= bit[single]
        row, run, bit = row[~single], run[~single], bit[~single]
        left = suffixes.spans(anchor[row] - back, anchor[row])
        by = np.lexsort((doc[row], left, run))
        row, run, left, bit = row[by], run[by], left[by], bit[by]
        first = _changes(run, left)
        again = np.nonzero(~first)[0]
        p, q = row[again - 1], row[again]
        doubtful.append(group[q[~same_bytes(raw, anchor[p] - back, anchor[q] - back, np.full(len(again), back))]])
        top = doc[row[np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))]] if len(row) else row
        covered[row] |= np.where(doc[row] > top, bit, np.uint64(0))
        leading[row] |= np.where(doc[row] == top, bit, np.uint64(0))
    later = doc[order] > doc[head]
    same = ~new & ~later  # of the same document as the region that leads them
    covered[order[later]], leading[order[later]] = every[order[later]], 0
    covered[order[same]], leading[order[same]] = covered[head[same]], leading[head[same]]
    for g in np.unique(np.concatenate(doubtful)):
        _by_bytes(np.nonzero(group == g)[0], doc, windows, raw, bounds, covered, leading)
    return covered, leading


def _by_bytes(rows: np.ndarray, doc: np.ndarray, windows: np.ndarray, raw: bytes, bounds: np.ndarray, covered: np.ndarray, leading: np.ndarray) -> None:
    """``resolve`` for one group without any hash of ours."""
    least: dict[bytes, int] = {}
    each = [(k, j, raw[bounds[k] + j : bounds[k] + j + LENGTH]) for k in rows.tolist() for j in range(windows[k])]
    for k, _, window in each:
        least[window] = min(least.get(window, doc[k]), doc[k])
    covered[rows] = leading[rows] = 0
    for k, j, window in each:
        (covered if least[window] < doc[k] else leading)[k] |= np.uint64(1 << j)


RESOLVED = "doc long, row long, places binary, mask long, salt int, leading long, before int, windows int, bytes binary"


def _resolved(contexts: DataFrame) -> DataFrame:
    """``resolve`` over rows sorted by gram and salt: whole groups, about SORT_ROWS rows at a time. Rows come out
    if they have a mask of covered windows, and with their bytes if their group is a part that leads some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            gram, salt = table["gram"].to_numpy(), table["salt"].to_numpy()
            header, places, data, bounds = _unpacked(table["body"].combine_chunks())
            doc, windows = header["doc"].astype(np.int64), header["windows"].astype(np.int64)
            covered, leading = resolve(np.cumsum(_changes(gram, salt)) - 1, doc, header["before"].astype(np.int64), windows, data, bounds)
            leading[salt < 0] = 0
            keep = pa.array(np.nonzero((covered != 0) | (leading != 0))[0])
            texts = pa.nulls(len(doc), pa.binary())
            if leading.any():
                raw = data.tobytes()
                texts = pa.array([raw[a:b] if some else None for a, b, some in zip(bounds[:-1].tolist(), bounds[1:].tolist(), (leading != 0).tolist(), strict=True)], pa.binary())
            out = [pa.array(doc), pa.array(header["row"].astype(np.int64)), _binary(places, header["places"]), pa.array(covered.view(np.int64)), pa.array(salt), pa.array(leading.view(np.int64)), pa.array(header["before"].astype(np.int32)), pa.array(windows.astype(np.int32)), texts]
            return pa.record_batch([x.take(keep) for x in out], names=["doc", "row", "places", "mask", "salt", "leading", "before", "windows", "bytes"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < SORT_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            edge = np.nonzero(_changes(table["gram"].to_numpy(), table["salt"].to_numpy()))[0]
            cut = int(edge[-1])
            if not cut:
                continue
            yield emit(table.slice(0, cut))
            pa.default_memory_pool().release_unused()
            held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if size:
            yield emit(pa.Table.from_batches(held))

    return contexts.repartition("gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(run, RESOLVED)


def _leaders(rows: DataFrame) -> DataFrame:
    """The regions in which parts of split groups lead some window, by narrower keys: a window has SIDE bytes more
    than the anchor's gram after it or before it. The windows of either kind are a region of their own, and
    those that can be equal meet by the hash of gram and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, places, leading, before, windows, raw = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("doc", "row", "places", "leading", "before", "windows", "bytes"))
            out = []
            for k in range(len(doc)):
                at = before[k]  # window j has at - j bytes before the anchor
                cut = min(max(at - SIDE, 0), windows[k])
                for first, end, start in ((cut, windows[k], at), (0, cut, at - SIDE)):
                    lead = (leading[k] & (1 << end) - 1) >> first if first < end else 0
                    if lead:
                        moved = places[k] if not first else (np.frombuffer(places[k], np.int64) + first).tobytes()
                        out.append((doc[k], row[k], lead, at - first, end - first, moved, raw[k][first : end + LENGTH - 1], raw[k][start : start + GRAM + SIDE]))
            if out:
                yield _rows(out)

    return rows.mapInArrow(run, CONTEXT)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    """Packed regions (doc, row, lead, before, windows, places, bytes, key), grouped by the hash of the key's bytes."""
    doc, row, lead, before, windows, places, texts, keys = zip(*out, strict=True)
    joined = np.frombuffer(b"".join(keys), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
    header = np.zeros(len(out), HEADER)
    header["doc"], header["row"], header["lead"], header["before"], header["windows"], header["places"] = doc, row, lead, before, windows, [len(x) // 8 for x in places]
    size = np.array([len(x) for x in texts])
    bodies = _packed(header, b"".join(places), b"".join(texts), np.cumsum(size) - size, size)
    gram = span_hashes(prefix_hashes(joined), at[:-1], at[1:])
    return pa.record_batch([pa.array(gram.view(np.int64)), pa.array(np.full(len(out), -1, np.int32)), bodies], names=["gram", "salt", "body"])


def _windows(rows: DataFrame) -> DataFrame:
    """Each window that packed regions lead, as a region of its own, to meet by the hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            header, places, data, bounds = _unpacked(batch.column(2))
            raw, ends = data.tobytes(), np.cumsum(header["places"].astype(np.int64))
            out, size = [], 0
            for k in range(len(header)):
                own = places[ends[k] - header["places"][k] : ends[k]]
                lead = int(header["lead"][k])
                for j in (j for j in range(header["windows"][k]) if lead >> j & 1):
                    text = raw[bounds[k] + j : bounds[k] + j + LENGTH]
                    out.append((header["doc"][k], header["row"][k], 1, 0, 1, (own + j).tobytes(), text, text))
                    size += LENGTH + 8 * len(own)
                    if size > 1 << 20:
                        yield _rows(out)
                        out, size = [], 0
            if out:
                yield _rows(out)

    return rows.mapInArrow(run, CONTEXT)


def _merged(leading: DataFrame, most: int) -> DataFrame:
    """``_resolved`` of what leads in the parts of split groups. Keys of over ``most`` regions, as of a line that very
    many documents have between different texts, are taken apart into windows, which no part leads twice."""
    leaders = stored(_leaders(leading), "leaders")
    large = stored(leaders.groupBy("gram").count().where(F.col("count") > most).select(F.col("gram").alias("__gram")), "large")
    if large.isEmpty():
        return _resolved(leaders)
    same = F.col("gram") == F.col("__gram")
    return _resolved(restricted(leaders, large, same, "left_anti")).unionByName(_resolved(_windows(restricted(leaders, large, same, "left_semi"))))


def repeated_windows(docs: DataFrame, group_rows: int = GROUP_ROWS, sample: int = SAMPLE, most: int = MOST_ROWS) -> DataFrame:
    """For rows (doc, row, text), (doc, row, places, mask): regions' first windows, as 64-bit integers, and a bit for each window from there on
    that an earlier document has."""
    some = docs.select("doc", "text").where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0)
    some = _anchored(some, np.zeros(0, np.uint64))
    split, parts = split_plan(some, group_rows, sample)
    gram = Window.partitionBy("gram")
    shared = _anchored(docs.select("doc", "text"), split).withColumns({"lo": F.min("doc").over(gram), "hi": F.max("doc").over(gram)}).where("lo < hi")
    # Each shuffle is gone before the next one, so that they don't add up on disk.
    path = scratch_path(docs.sparkSession, "asked")
    asked = stored(shared.groupBy("doc").agg(F.collect_list("gram").alias("grams")), path=path)
    none, found = F.array().cast("array<bigint>"), []
    for turn in range(ROUNDS):
        mine = asked.select("doc", F.expr(f"filter(grams, g -> pmod(g, {ROUNDS}) = {turn})").alias("grams")).where(F.size("grams") > 0)
        todo = docs.join(mine, "doc", "left" if len(split) else "inner").select("doc", "row", "text", F.coalesce("grams", none).alias("grams"))
        found.append(stored(_resolved(_contexts(todo, split, parts, turn)), "windows"))
    removed(docs.sparkSession, path)
    found = reduce(DataFrame.unionAll, found)
    masks = found.where("mask <> 0").select("doc", "row", "places", "mask")
    if (parts > 1).any():
        late = _merged(found.where("leading <> 0"), most)
        masks = masks.unionByName(late.where("mask <> 0").select("doc", "row", "places", "mask"))
    return masks


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"


def _runs(texts: pa.Array, found: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the removed runs of each text, from its rows (places, mask)."""
    _, offsets = text_buffer(texts)
    edges = np.asarray(found.offsets).astype(np.int64)
    rows = found.values
    places, masks = rows.field(0), rows.field(1).to_numpy(zero_copy_only=False).view(np.uint64)
    for a, b in slices(offsets):
        size = int(offsets[b] - offsets[a])
        part = places.slice(edges[a], edges[b] - edges[a])
        _, cuts = text_buffer(part.cast(pa.large_binary()).view(pa.large_string()))
        at = np.frombuffer(b"".join(part.to_pylist()), np.int64)
        count = np.diff(cuts) // 8
        text = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
        at = at + np.repeat(offsets[a + text] - offsets[a], count)
        mask = np.repeat(masks[edges[a] : edges[b]], count)
        begins = np.zeros(size + 1, bool)
        for j in range(REACH):
            begins[at[mask >> np.uint64(j) & np.uint64(1) == 1] + j] = True
        # A byte goes if one of the LENGTH windows that end with it, or begin before, is marked; no window leaves its text.
        seen = np.concatenate([np.zeros(LENGTH, np.int64), np.cumsum(begins[:size])])
        gone = seen[LENGTH:] > seen[:-LENGTH]
        for t in range(a, b):
            own = np.concatenate([[False], gone[offsets[t] - offsets[a] : offsets[t + 1] - offsets[a]], [False]])
            turn = np.nonzero(own[1:] != own[:-1])[0]
            yield turn[::2], turn[1::2]


_NONE = np.zeros(0, np.int64)


def _cut(docs: DataFrame) -> DataFrame:
    """What is left of each text (doc, text, found) without its covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.list_value_length(batch.column(2))
            masked = batch.filter(pc.greater(counts, 0))
            cuts = _runs(masked.column(1), masked.column(2)) if masked.num_rows else iter(())
            data, offsets = text_buffer(batch.column(1))
            out: list[tuple] = []
            for k, n in enumerate(counts.to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]]
                starts, ends = next(cuts) if n else (_NONE, _NONE)
                kept = hashlib.sha256()
                for a, b in zip([0, *ends], [*starts, len(raw)], strict=True):
                    kept.update(raw[a:b])
                out.append((len(raw), int((ends - starts).sum()), len(starts), kept.hexdigest(), starts, ends))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return docs.mapInArrow(run, SCHEMA)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, sample: int = SAMPLE, most: int = MOST_ROWS) -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (starts
    and ends in bytes).

    Null texts are empty; texts under 50 bytes lose nothing. Rows that repeat an id are one document to
    others: they don't count as earlier than each other, and each loses what an earlier document has. A row
    without id loses nothing and is nobody's earlier document. An empty table gives no rows. Matches don't
    cross texts; long texts are read whole. The result is exact: equal hashes bring regions together, and
    bytes are compared before any goes. Grams of more regions than ``group_rows`` are
    sorted in groups, and ``most`` of them at most meet again at once: this affects speed only.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc")).where("doc is not null")
    repeats = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    # Places are of one text: rows that repeat an id are told apart by their texts' hash, where there are such.
    row = F.xxhash64(F.col(text_col)) if repeats else F.lit(0).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), row.alias("row"), F.col(text_col).alias("text"))
    known = texts.where("doc is not null")
    masks = repeated_windows(known, group_rows, sample, most).groupBy("doc", "row").agg(F.collect_list(F.struct("places", "mask")).alias("found"))
    nothing = F.array().cast("array<struct<places:binary,mask:bigint>>")
    joined = known.join(masks, ["doc", "row"], "left").select("doc", "text", F.coalesce("found", nothing).alias("found"))
    return stored(_cut(joined).unionByName(_cut(texts.where("doc is null").select("doc", "text", nothing.alias("found")))), "spans")


#: Every string of LENGTH bytes as hexadecimal digits, its first document, and what is left of each text.
ORACLE = f"""
WITH RECURSIVE b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS p FROM b WHERE length(h) >= {2 * LENGTH})
), least AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)
), hit AS (SELECT doc_id, p FROM w JOIN least USING (s) WHERE doc_id > lo
), mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM hit
), runs AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM mark) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM (SELECT doc_id, a, e FROM runs UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 + 1 FROM b)
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS h FROM gaps JOIN b USING (doc_id) GROUP BY doc_id
), gone AS (SELECT doc_id, sum(e - a) AS n, count(*) AS k FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
