"""Ranked lexical search: postings by term, integer scores, the best documents of each item.

Texts are taken apart once, in arrays of bytes. Postings are laid out by ranges of term and document. For a search they are dealt
by document, of which items' terms join them: so what a document matches adds up where it is, and as the window's rank is
bounded, every task keeps its own best rows of each item before any are shuffled by item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_IDS, slices, stored, text_buffer

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of a document's length, how much is measured against the mean one, in hundredths.
SLOPE = 90
TOP = 10

# Bytes of terms, in lower case; 0 for what parts them: all of ASCII but letters and digits.
_CODES = np.zeros(256, np.uint8)
for _kept in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
    _CODES[_kept.start : _kept.stop] = _kept
_CODES[0x41:0x5B] = _CODES[0x61:0x7B]


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, in order, A-Z lower-cased, and the text that each is from."""
    data, offsets = text_buffer(texts)
    codes = _CODES[data[offsets[0] : offsets[-1]]]
    starts = offsets[:-1] - offsets[0]
    inside = codes != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[starts < len(codes)]
    first[edge] = inside[edge]
    at = np.nonzero(first)[0]
    ends = np.cumsum(inside)[at] - 1 if len(at) else at
    bounds = np.append(ends, inside.sum()).astype(np.int32)
    values = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(codes[inside]))
    return values, np.searchsorted(starts, at, "right") - 1


def counted_terms(rows: DataFrame, wanted: list[str] | None) -> DataFrame:
    """(doc, key, n, term, tf) of rows (doc, key, text): a row for each of a text's terms, of those ``wanted`` if given, and
    one without a term; n is how many terms the text has."""
    names = ["doc", "key", "n", "term", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else pa.array(wanted, pa.string())
        for batch in batches:
            for a, b in slices(text_buffer(batch.column(2))[1]):
                values, parent = split_terms(batch.column(2).slice(a, b - a))
                n = np.bincount(parent, minlength=b - a)
                coded = values.dictionary_encode()
                ids, terms = coded.indices.to_numpy(), coded.dictionary
                if known is not None:
                    ids = pc.fill_null(pc.index_in(terms, known), -1).to_numpy()[ids] if len(ids) else ids
                    ids, parent, terms = ids[ids >= 0], parent[ids >= 0], known
                found, tf = np.unique(parent.astype(np.int64) * max(len(terms), 1) + ids, return_counts=True)
                place, term = np.divmod(found, max(len(terms), 1))
                at = np.concatenate([place, np.arange(b - a)]).astype(np.int64)
                given = pa.concat_arrays([terms.take(pa.array(term)), pa.nulls(b - a, pa.string())])
                own = batch.slice(a, b - a)
                yield pa.record_batch(
                    [own.column(0).take(pa.array(at)), own.column(1).take(pa.array(at)), pa.array(n[at].astype(np.int64)), given, pa.array(np.concatenate([tf, np.zeros(b - a)]).astype(np.int64))], names=names
                )

    return rows.mapInArrow(run, "doc long, key string, n long, term string, tf long")


def impact(tf: Column, m: Column) -> Column:
    """What a term adds to a document for each unit of its weight, in billionths: tf / (tf + m / 125)."""
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * m)


@dataclass(frozen=True)
class Postings:
    """rows (term, doc, key, impact): one for each term of a document, in ranges of term; n_docs with a term."""

    rows: DataFrame
    n_docs: int

    def weights(self) -> DataFrame:
        """(term, w): the integer weight of each term, by the documents that hold it."""
        df = self.rows.groupBy("term").agg(F.count("*").alias("df"))
        share = F.lit(float(2 * self.n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
        return df.select("term", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("w"))


def _met(rows: DataFrame, few: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    """A join with a stored table, broadcast only while that is small by count; else both sides are shuffled and
    adaptive execution splits hot keys."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, on, how)


def postings(docs: DataFrame, wanted: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Postings:
    """The postings of whole texts; with ``wanted`` (stored distinct rows, term) only those of these terms, while all
    lengths and document counts cover every term.

    Rows that repeat an id are one document with the terms of all; rows without an id are told apart by their texts.
    Documents without a term are in no posting and no count. An empty table gives no postings.
    """
    doc, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    rows = docs.select(doc.alias("doc"), F.when(doc.isNull(), F.md5(F.coalesce(text, F.lit("")))).otherwise("").alias("key"), text.alias("text"))
    # Few terms are known to the tasks, which then give no others; many join what all texts have.
    few = [r[0] for r in wanted.collect()] if wanted is not None and wanted.count() <= BROADCAST_IDS else None
    each = stored(counted_terms(rows, few), "terms-of-texts")
    sizes = each.where("term is null and n > 0").groupBy("doc", "key").agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    n_docs, total, most = sizes.agg(F.count("*"), F.sum("n"), F.max("copies")).first()
    each = each.where("term is not null")
    if wanted is not None and few is None:
        each = each.join(wanted, "term", "left_semi")
    # Ranges of term and document: a term that most documents hold lies in many files, and a file's statistics name its terms.
    counted = each.repartitionByRange("term", "doc", "key").groupBy("term", "doc", "key").agg(F.sum("tf").alias("tf"), F.max("n").alias("n"))
    if (most or 0) > 1:  # a row's own length is its document's, unless other rows have the same id
        shared = stored(sizes.where("copies > 1").select(F.coalesce("doc", F.lit(0)).alias("__doc"), F.col("doc").isNull().alias("__none"), F.col("key").alias("__key"), F.col("n").alias("__n")), "repeated-ids")
        same = (F.coalesce("doc", F.lit(0)) == F.col("__doc")) & (F.col("doc").isNull() == F.col("__none")) & (F.col("key") == F.col("__key"))
        counted = _met(counted, shared, same, "left").withColumn("n", F.coalesce("__n", "n"))
    m = F.lit(100 - SLOPE).cast("long") + F.call_function("div", F.lit(SLOPE).cast("long") * F.col("n") * F.lit(n_docs or 0).cast("long"), F.lit(total or 1).cast("long"))
    return Postings(stored(counted.select("term", "doc", "key", impact(F.col("tf"), m).alias("impact")), "postings"), n_docs or 0)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term), each once: rows that repeat an item's id add their terms to it."""
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("doc"), F.lit("").alias("key"), F.col(f"`{text_col}`").alias("text"))
    return counted_terms(rows, None).where("term is not null").select(F.col("doc").alias("item"), "term").distinct()


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, or all if fewer; equal scores
    by ascending id, documents without an id last and by the MD5 of their texts.

    All documents are ranked by their whole texts. Null and empty texts, and those without a term, are in no result, as
    are items without a term; a null item id is an item like others. Empty tables give no rows; other columns are
    ignored, whatever their names.
    """
    wanted = stored(item_terms(items, item_col, item_text), "item-terms")
    known = stored(wanted.select("term").distinct(), "terms")
    found = postings(docs, known, id_col, text_col)
    asked = stored(wanted.join(found.weights().where("w > 0"), "term"), "weighted-terms")
    # Dealt by document, matches add up without another shuffle.
    matches = _met(found.rows.repartition("doc", "key"), asked, "term", "inner").select("item", "doc", "key", (F.col("w") * F.col("impact")).alias("part"))
    totals = matches.groupBy("item", "doc", "key").agg(F.sum("part").alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last(), "key")
    best = totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS low FROM documents
), e AS (SELECT doc_id, unnest(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM t
), p AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY ALL
), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * c.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY term, c.docs
), s AS (
  SELECT item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * c.docs) // c.total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n ON n.doc_id = p.doc_id, c GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
