"""Queries of images, Markdown, exports as one array, paths below packages, and bounded search."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lectern.functions import bits
from lectern.operators import lookup, reshape, search
from lectern.operators._store import shared_folder, stored
from lectern.plans.tables import read
from lectern.sources import images, markdown


@F.pandas_udf(BinaryType())
def _pictures(samples: pd.Series, kinds: pd.Series) -> pd.Series:
    """PNG files of 64 samples as parts of 2 by 3 pixels, every second pixel brighter by one: grey, with
    transparency, in colours, and of 16 bits."""

    def one(values, kind: int) -> bytes:
        grey = np.kron(np.asarray(values, np.int64).reshape(8, 8), np.ones((3, 2), np.int64))
        grey += np.indices(grey.shape).sum(0) % 2
        if kind == 3:
            return images.encoded_png(grey[:, :, None] * 257, depth=16)
        layers = {0: 1, 1: 2, 2: 3}[kind]
        pixels = np.repeat(grey[:, :, None], layers, axis=2)
        if layers == 2:
            pixels[:, :, 1] = np.arange(grey.size).reshape(grey.shape) % 256
        return images.encoded_png(pixels)

    return pd.Series([one(v, k) for v, k in zip(samples, kinds, strict=True)])


def image_signatures(spark, d):
    """Images made of all embeddings, decoded to grey and reduced, and how each resembles the one before it."""
    e = read(spark, d, "embeddings")
    grey = F.transform(F.slice("embedding", 1, 64), lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127), F.lit(0)), F.lit(254)).cast("int"))
    files = stored(e.select("label", "vec_id", _pictures(grey, (F.col("vec_id") % 4).cast("int")).alias("content")), "images")
    chosen, rows = images.PROVIDERS["average-hash"], images.with_signature(files)
    before = F.lag("signature").over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.select("label", "vec_id", bits.to_hex("signature").alias("signature"), F.round(chosen.similarity(F.col("signature"), before), 6).alias("similarity"))


def markdown_forms(spark, d):
    """All documents' words in nested marks, lists, quotes, code and links: their plain text has the words alone."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    marks = ("**{0} _x_ y**", "- *{0}*", "> ***x** {0}*", "[`{0}`](u \"t\")", "{0}\\*x", "# {0} #", "1. {0}\n   - __x__")
    kind = lambda m, w: F.concat(*[part for i, text in enumerate(m.split("{0}")) for part in ([F.lit(text)] if i == 0 else [w, F.lit(text)])])
    marked = lambda w, k: reduce(lambda rest, j: F.when(k == j, kind(marks[j], w)).otherwise(rest), range(len(marks)), F.lit(None).cast("string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes are much work here
    each = docs.repartition(n, "doc_id").select("doc_id", words.alias("w"))
    whole = each.select("doc_id", F.array_join(F.transform("w", lambda w, i: marked(w, F.pmod(i, F.lit(len(marks))))), "\n\n").alias("text"))
    shown = whole.select("doc_id", markdown.markdown_to_both("text").alias("b")).select("doc_id", "b.plain", "b.html")
    tags = F.regexp_replace(F.regexp_replace("html", r"<[^>]*>", " "), r"\s+", " ")
    return shown.select("doc_id", F.md5("plain").alias("plain"), F.regexp_count("html", F.lit("<strong>")).cast("long").alias("n_strong"), F.regexp_count("html", F.lit("<em>")).cast("long").alias("n_em"), F.md5(F.trim(tags)).alias("shown"))


def json_array_export(spark, d):
    """All orders as one JSON array written in ranges, read again by line: each item, and where commas and brackets stand."""
    o, at = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), f"{shared_folder(spark)}/array-{uuid.uuid4().hex}"
    reshape.write_json_array(o, at, ["o_orderkey"])
    lines = spark.read.text(at)
    item = F.from_json(F.regexp_replace("value", "^,", ""), o.schema)
    rows = lines.select(F.when(F.col("value").isin("[", "]"), F.col("value")).when(F.col("value").startswith(","), "next").otherwise("first").alias("kind"), item.alias("x"))
    return rows.select("kind", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderstatus").alias("status"), F.col("x.o_orderpriority").alias("priority"))


def package_roots(spark, d):
    """For a path of each customer, the nearest package above it, or why there is none: a file, or nothing there."""
    s, c, n = read(spark, d, "supplier"), read(spark, d, "customer"), read(spark, d, "nation")
    key = F.col("s_suppkey")
    base = lambda nation: F.concat(F.lit("/lib/n"), nation.cast("string"))
    place = F.concat(base(key % 25), F.lit("/v"), key.cast("string"))
    entries = n.select(base(F.col("n_nationkey")).alias("path"), F.lit(True).alias("is_dir")).unionByName(s.select(place.alias("path"), (key % 3 > 0).alias("is_dir"))).unionByName(s.where(key % 3 > 0).select(F.concat(place, F.lit("/in")).alias("path"), F.lit(True).alias("is_dir")))
    marked = n.where("n_nationkey % 4 = 0").select(base(F.col("n_nationkey")).alias("directory")).unionByName(s.where((key % 3 > 0) & (key % 5 == 0)).select(place.alias("directory")))
    k = F.col("c_custkey")
    asked = c.select("c_custkey", F.concat(base(k % 25), F.lit("/v"), k.cast("string"), F.when((k % 3 > 0) & (k % 2 == 0), "/in").otherwise("")).alias("path"))
    return lookup.resolved_ancestor(asked, entries, marked).select("c_custkey", "directory", "state")


def bounded_search(spark, d):
    """The ten best documents of each benchmark item by any word, with norms of a byte, without scoring all."""
    index = search.opened(spark, f"{d}/documents.parquet", "doc_id", "text", ["lang"])
    found = search.best_matches(index, read(spark, d, "benchmark"), "item_id", "text", 10)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (image_signatures, markdown_forms, json_array_export, package_roots, bounded_search)}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
ORACLE = {
    "image_signatures": """WITH g AS (SELECT label, vec_id, list_transform(embedding[1:64], lambda v: least(greatest(floor((v::DOUBLE + 1) * 127), 0), 254) + 1) AS g FROM embeddings),
        b AS (SELECT label, vec_id, list_transform(g, lambda v: (v >= list_sum(g) / 64)::INT) AS b FROM g), l AS (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM b)
        SELECT label, vec_id, array_to_string(list_transform(range(16), lambda i: '0123456789abcdef'[(b[64 - 4 * i] * 8 + b[63 - 4 * i] * 4 + b[62 - 4 * i] * 2 + b[61 - 4 * i] + 1)::BIGINT]), '') AS signature,
          CASE WHEN p IS NOT NULL THEN round(1 - len(list_filter(list_zip(b, p), lambda x: x[1] <> x[2])) / 64, 6) END AS similarity FROM l""",
    "markdown_forms": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}]+') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM w),
        m AS (SELECT doc_id, i, CASE i % 7 WHEN 0 THEN w || ' x y' WHEN 2 THEN 'x ' || w WHEN 4 THEN w || '*x' WHEN 6 THEN w || chr(10) || 'x' ELSE w END AS t, CASE i % 7 WHEN 6 THEN w || ' x' WHEN 0 THEN w || ' x y' WHEN 2 THEN 'x ' || w WHEN 4 THEN w || '*x' ELSE w END AS h FROM e),
        a AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) || chr(10) AS plain, string_agg(h, ' ' ORDER BY i) AS shown, count(*) FILTER (i % 7 IN (0, 2, 6)) AS n_strong, count(*) FILTER (i % 7 IN (0, 1, 2)) AS n_em FROM m GROUP BY 1)
        SELECT doc_id, md5(coalesce(plain, chr(10))) AS plain, coalesce(n_strong, 0) AS n_strong, coalesce(n_em, 0) AS n_em, md5(coalesce(shown, '')) AS shown FROM documents LEFT JOIN a USING (doc_id)""",
    "json_array_export": """SELECT CASE WHEN o_orderkey = min(o_orderkey) OVER () THEN 'first' ELSE 'next' END AS kind, o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders
        UNION ALL SELECT unnest(['[', ']']), NULL, NULL, NULL""",
    "package_roots": """WITH c AS (SELECT c_custkey AS k, c_custkey % 25 AS n, s_suppkey IS NOT NULL AS there FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
        SELECT k AS c_custkey, CASE WHEN there AND k % 3 > 0 THEN CASE WHEN k % 5 = 0 THEN '/lib/n' || n || '/v' || k WHEN n % 4 = 0 THEN '/lib/n' || n END END AS directory,
          CASE WHEN NOT there THEN 'missing' WHEN k % 3 = 0 THEN 'file' WHEN k % 5 = 0 OR n % 4 = 0 THEN 'found' ELSE 'none' END AS state FROM c""",
    "bounded_search": rf"""WITH dt AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''), nd AS (SELECT count(*)::DOUBLE AS n FROM dt), p AS (SELECT doc_id, unnest(w) AS term FROM dt),
        tf AS (SELECT term, doc_id, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), dl AS (SELECT doc_id, 1 / sqrt(len(w)) AS x FROM dt WHERE len(w) > 0),
        nm AS (SELECT doc_id, floor(x / pow(2, floor(log2(x)) - 3)) * pow(2, floor(log2(x)) - 3) AS norm FROM dl), q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark), qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
        sc AS (SELECT item_id, doc_id, round(sum(sqrt(tf) * (1 + ln(nd.n / (df + 1))) * (1 + ln(nd.n / (df + 1)))) * any_value(norm) * count(*) / any_value(qn.n), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN nm USING (doc_id) JOIN qn USING (item_id), nd GROUP BY ALL)
        SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10""",
}
