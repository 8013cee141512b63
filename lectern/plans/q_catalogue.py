"""Queries in the manner of a media catalogue: lookups, upserts, resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import maps
from lectern.functions import text as T
from lectern.operators import graph, lookup, reshape, resolve, sequence, stats, upsert
from lectern.plans.tables import read


def null_safe_media_join(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("ref"), (F.col("o_orderkey") % 100).alias("ordinal"))
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("ordinal"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("ref"), "l_quantity")
    media = li.groupBy("ordinal", "ref").agg(F.count("*").alias("n_items"), F.max("l_quantity").alias("top_quantity"))
    return lookup.null_safe_join(o, lookup.require_unique(media, ["ordinal", "ref"]), ["ordinal"], ["ref"]).select("o_orderkey", "ref", "ordinal", "n_items", "top_quantity")


def existence_flags(spark, d):
    o = read(spark, d, "orders")
    c = lookup.exists_flag(read(spark, d, "customer"), o.where("o_orderpriority = '1-URGENT'"), {"c_custkey": "o_custkey"}, "urgent")
    return lookup.exists_flag(c, o.where("o_totalprice > 400000"), {"c_custkey": "o_custkey"}, "big", F.lit("big")).select("c_custkey", "urgent", "big")


def _spend(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'F'")
    shift = F.col("o_custkey") + F.when(F.col("o_custkey") % 10 == 0, 10_000_000).otherwise(0)
    return o.groupBy(shift.alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"), F.max(F.when(F.col("o_totalprice") > 300000, F.lit("PREMIUM"))).alias("c_mktsegment"))


def upsert_full_outer(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return upsert.upsert(c, _spend(spark, d), "c_custkey", ["c_acctbal", "c_mktsegment"])


def stale_members_anti(spark, d):
    c = read(spark, d, "customer")
    members = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    lists = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("top"), F.lit(1), F.lit("old"), F.lit(2))).otherwise(F.create_map(F.lit("top"), F.lit(1)))
    base = c.select("c_custkey", lists.alias("lists"), F.array(F.lit("list")).alias("origin"), (F.col("c_nationkey") % 2 == 0).alias("watch"))
    out = upsert.unflag(upsert.leave_list(base, members, "c_custkey", "top"), members, "c_custkey", "watch")
    return upsert.prune(out).select("c_custkey", "watch", F.array_join(F.array_sort(F.map_keys("lists")), ",").alias("lists"))


def semi_pushdown_enrich(spark, d):
    wanted = read(spark, d, "part").where("p_brand = 'Brand#2' AND p_size < 20").select("p_partkey", "p_name")
    li = read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity", F.col("l_suppkey").alias("season"), "l_extendedprice")
    ratings = li.groupBy("p_partkey").agg(F.round(F.avg("l_quantity"), 6).alias("rating"), F.count("*").alias("votes"))
    basics = read(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return upsert.enrich(wanted, "p_partkey", basics, ratings, li.select("p_partkey", "season"))


def or_condition_join(spark, d):
    c = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_customers"))
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return lookup.any_of_left_join(n, c, [("n_nationkey", "c_nationkey"), ("n_regionkey", "c_nationkey")], ["n_nationkey"]).select("n_nationkey", "n_name", "c_nationkey", "c_mktsegment", "n_customers")


def rating_lookup_default(spark, d):
    r = read(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_discount"), 6).alias("rating"))
    return read(spark, d, "part").select("p_partkey", "p_name").join(r, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("rating", F.lit(0.0)).alias("rating"))


def fallback_lookup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    first = read(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("info"))
    second = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("b"), F.length("text").cast("string")).alias("info"))
    return lookup.fallback(docs, [first, second], "doc_id", ["info"]).select("doc_id", "lang", "info", "found_in")


def positional_zip(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return lookup.zip_rows(s, c, ["s_name", "s_suppkey"], ["c_name", "c_custkey"]).select(F.col("rn").cast("long").alias("rn"), "s_suppkey", "c_custkey")


def id_agreement(spark, d):
    return resolve.agreed(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "flag")


def title_normalize(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.concat(F.lit("  The "), F.initcap("p_name"), F.lit(": "), F.col("p_brand"), F.lit("!")).alias("raw"))
    t = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("raw"))
    return p.unionByName(t).select("key", T.title_key("raw").alias("title"), T.slug("raw", "key").alias("slug"))


def fuzzy_title_ranked(spark, d):
    """Each part as a film, with all other parts that share its title as works. A title's works are ranked once:
    a film's list is its title's without itself."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task's otherwise
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_retailprice", "p_brand").repartition(n, "p_partkey")
    films = p.select("p_partkey", T.title_key(F.upper("p_name")).alias("film_title"))
    works = p.select(F.col("p_partkey").alias("work"), F.concat("p_name", F.lit("!")).alias("t1"), "p_type", "p_retailprice", F.col("p_brand").alias("t2"))
    c = resolve.title_candidates(films.select("film_title").distinct(), works, "film_title", "film_title", "work", ["t1", "t2"]).join(works, "work")
    order = [resolve.type_rank("p_type", ["PROMO", "ECONOMY", "STANDARD"]), F.col("p_retailprice").desc(), F.col("work")]
    return resolve.without_own(films, "p_partkey", c, "film_title", order, F.col("work")).withColumn("best", F.col("best").cast("bigint"))


def merge_duplicates(spark, d):
    c = read(spark, d, "customer").withColumns({"name": F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), "bal": F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")), "tags": F.array("c_mktsegment"), "owned": F.when(F.col("c_acctbal") > 9000, F.col("c_custkey") % 2)})
    m = resolve.merge_group(c, "c_nationkey", ["c_custkey"], ["name", "bal"], ["tags"], ["owned"])
    return m.select("c_nationkey", "name", "bal", F.array_join("tags", ",").alias("tags"), "n_merged", "conflict")


def map_scope_merge(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), F.substring("o_orderpriority", 1, 1).alias("p"), "o_orderstatus")
    by = o.groupBy("k", "p").agg(F.count_if(F.col("o_orderstatus") == "F").alias("old"), F.count_if(F.col("o_orderstatus") == "O").alias("new"))
    m = by.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("old") > 0, F.struct("p", "old"))))).alias("old"), F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("new") > 0) & (F.col("p") != "3"), F.struct("p", "new"))))).alias("new"))
    scope = F.array(*[F.lit(x) for x in ("1", "2", "3")])
    return m.select("k", F.explode(maps.replace_scope("old", "new", scope)).alias("p", "n"))


def episode_season_counts(spark, d):
    return stats.children(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


def slug_suffix(spark, d):
    p = read(spark, d, "part").withColumn("slug", T.slug("p_name"))
    return sequence.unique_slugs(p, "slug", "p_partkey").select("p_partkey", "slug", "unique_slug")


def natural_sort_rank(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat(F.lit("s"), (F.col("s_suppkey") * 7 % 1000).cast("string"), F.lit("-"), F.col("s_suppkey").cast("string")).alias("name"))
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("c"), (F.col("c_custkey") * 13 % 10000).cast("string"), F.lit(" "), F.col("c_custkey").cast("string")).alias("name"))
    return sequence.natural_rank(s.unionByName(c), ["nation"], "name").select("nation", "name", F.col("natural_rank").cast("long").alias("natural_rank"))


def decision_table(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_set(F.when(F.col("o_totalprice") > 480000, F.concat(F.lit("tt"), F.col("o_orderkey").cast("string"))))).alias("ids"))
    c = read(spark, d, "customer").join(o, "c_custkey", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    digits = F.when(F.col("c_custkey") % 4 != 0, F.when(F.col("c_custkey") % 7 == 0, F.lit("x1")).otherwise(F.col("c_custkey").cast("string")))
    entity = F.when(F.col("c_custkey") % 9 == 0, F.lit("Q0")).otherwise(F.concat(F.lit("Q"), (F.col("c_custkey") + 1).cast("string")))
    claims = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("tt1"))).when(F.col("c_custkey") % 5 == 1, F.col("ids")).otherwise(F.array().cast("array<string>"))
    return c.select("c_custkey", resolve.commit_status(F.col("c_acctbal") > 0, digits, F.col("ids"), entity, claims).alias("status"))


def hierarchy_bfs(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("child"), F.when(F.col("o_orderkey") > 0, F.floor(F.col("o_orderkey") / 2)).alias("parent"), (F.col("o_orderkey") % 2).alias("child_no"))
    roots = o.where("child = 0").select(F.col("child").alias("node"))
    return graph.breadth_first(o.where("parent is not null and child <> 0"), roots).select("node", "depth")


def workflow_edges(spark, d):
    n, r, c = read(spark, d, "nation"), read(spark, d, "region"), read(spark, d, "customer")
    inputs = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("inputs"))
    outputs = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("outputs"))
    ops = r.withColumnRenamed("r_regionkey", "n_regionkey").join(inputs, "n_regionkey").join(outputs, "n_regionkey").select(F.col("r_name").alias("name"), "inputs", "outputs")
    return graph.workflow_edges(ops)


def first_and_top(spark, d):
    """The biggest orders of each status, and a deterministic listing of all."""
    o = read(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
    return o.select("o_orderstatus", "o_orderkey", "o_totalprice", rank.alias("rank")).where("rank <= 10").select("o_orderstatus", F.col("rank").cast("long").alias("rank"), "o_orderkey", "o_totalprice")


def newer_rows(spark, d):
    """Copy-if-newer: orders that are later than the customer's latest finished one, or of customers without one."""
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("mtime"))
    f = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderdate").alias("mtime"))
    return lookup.newer(o, f, "key").select("key", F.date_format("mtime", "yyyy-MM-dd").alias("day"))


def multimap_build(spark, d):
    p = read(spark, d, "part").select("p_name", F.split("p_name", " ").alias("words"))
    return stats.multimap(p, "p_name", "words").select("value", F.array_join("entries", ",").alias("entries"))


def affixes(spark, d):
    return stats.common_affixes(read(spark, d, "part"), "p_brand", "p_type").join(stats.common_affixes(read(spark, d, "customer"), "c_mktsegment", "c_name").select(F.col("c_mktsegment").alias("p_brand"), F.col("prefix").alias("q")), "p_brand", "full").select("p_brand", "prefix", "suffix", "q")


def tag_shelf(spark, d):
    p = read(spark, d, "part")
    tags = F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.concat(F.lit("collection-"), F.col("p_brand"))))
    path = reshape.shelf(tags, ["economy", "promo"], {"economy": "economies"}, ["red", "blue", "small"])
    return p.select("p_partkey", path.alias("shelf"), reshape.address(F.when(F.col("p_size") % 3 == 0, F.lit("notfound")).otherwise(F.col("p_brand")), "http://x/").alias("url"))


def unified_records(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    parts = [
        (c, {"kind": F.lit("customer"), "id": F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")), "name": F.col("c_name")}),
        (s, {"kind": F.lit("supplier"), "id": F.col("s_suppkey"), "name": F.col("s_name")}),
    ]
    return reshape.unified(parts, "id")


def cache_update(spark, d):
    o = read(spark, d, "orders")
    cache = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("n"))
    new = o.where("o_orderstatus = 'O' and o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("path")).agg((-F.count("*")).alias("n"))
    return reshape.update_cache(cache, new)


QUERIES = {
    f.__name__: f
    for f in (
        null_safe_media_join, existence_flags, upsert_full_outer, stale_members_anti, semi_pushdown_enrich, or_condition_join, rating_lookup_default, fallback_lookup, positional_zip, id_agreement,
        title_normalize, fuzzy_title_ranked, merge_duplicates, map_scope_merge, episode_season_counts, slug_suffix, natural_sort_rank, decision_table, hierarchy_bfs, workflow_edges, first_and_top,
        newer_rows, multimap_build, affixes, tag_shelf, unified_records, cache_update,
    )
}

_LETTERS = r"[^\p{L}\p{Nd}]+"
ORACLE = {
    "tag_shelf": """WITH x AS (SELECT p_partkey, p_brand, p_size, CASE p_type WHEN 'ECONOMY' THEN 'economies' WHEN 'PROMO' THEN 'promos' END AS kind, list_min(list_filter(string_split(p_name, ' '), lambda t: t IN ('red', 'blue', 'small'))) AS st FROM part)
        SELECT p_partkey, CASE WHEN kind IS NOT NULL THEN concat_ws('/', kind, p_brand, st) END AS shelf, CASE WHEN p_size % 3 <> 0 THEN 'http://x/' || p_brand END AS url FROM x""",
    "unified_records": """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""",
    "cache_update": """WITH n AS (SELECT o_custkey AS path, -count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 GROUP BY 1)
        SELECT * FROM n UNION ALL SELECT o_custkey, count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT path FROM n) GROUP BY 1""",
    "null_safe_media_join": """WITH m AS (SELECT l_orderkey % 100 AS ordinal, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS ref, count(*) AS n_items, max(l_quantity) AS top_quantity FROM lineitem GROUP BY ALL),
        o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS ref, o_orderkey % 100 AS ordinal FROM orders)
        SELECT o.o_orderkey, o.ref, o.ordinal, n_items, top_quantity FROM o LEFT JOIN m ON o.ordinal = m.ordinal AND o.ref IS NOT DISTINCT FROM m.ref""",
    "existence_flags": """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent,
        CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'big' END AS big FROM customer""",
    "upsert_full_outer": """WITH s AS (SELECT o_custkey + CASE WHEN o_custkey % 10 = 0 THEN 10000000 ELSE 0 END AS k, round(sum(o_totalprice), 2) AS bal, max(CASE WHEN o_totalprice > 300000 THEN 'PREMIUM' END) AS seg FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT coalesce(c_custkey, k) AS c_custkey, c_name, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment,
               CASE WHEN c_custkey IS NULL THEN 'added' WHEN k IS NOT NULL THEN 'updated' ELSE 'kept' END AS upsert_status FROM customer FULL JOIN s ON c_custkey = k""",
    "stale_members_anti": """WITH m AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P'), x AS (SELECT c_custkey, c_acctbal, c_nationkey % 2 = 0 AS w, c_custkey IN (SELECT o_custkey FROM m) AS member FROM customer)
        SELECT c_custkey, w AND member AS watch, CASE WHEN member AND c_acctbal > 0 THEN 'old,top' WHEN member THEN 'top' ELSE 'old' END AS lists FROM x WHERE member OR c_acctbal > 0""",
    "semi_pushdown_enrich": """WITH w AS (SELECT p_partkey, p_name, p_type, p_retailprice FROM part WHERE p_brand = 'Brand#2' AND p_size < 20),
        l AS (SELECT l_partkey, round(avg(l_quantity), 6) AS rating, count(*) AS votes, count(DISTINCT l_suppkey) AS seasons FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM w) GROUP BY 1)
        SELECT p_partkey, p_name, p_type, p_retailprice, rating, votes, votes AS episodes, seasons FROM w LEFT JOIN l ON l_partkey = p_partkey""",
    "or_condition_join": """SELECT n_nationkey, n_name, c_nationkey, c_mktsegment, n_customers FROM nation LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n_customers FROM customer GROUP BY ALL)
        ON n_nationkey = c_nationkey OR n_regionkey = c_nationkey""",
    "rating_lookup_default": """SELECT p_partkey, p_name, coalesce(r, 0.0) AS rating FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_discount), 6) AS r FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""",
    "fallback_lookup": """SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality WHEN item_id IS NOT NULL THEN 'b' || length(b.text) END AS info,
        CASE WHEN l.doc_id IS NOT NULL THEN 0 WHEN item_id IS NOT NULL THEN 1 END AS found_in FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON item_id = d.doc_id""",
    "positional_zip": """SELECT a.rn, s_suppkey, c_custkey FROM (SELECT *, row_number() OVER (ORDER BY s_name, s_suppkey) AS rn FROM supplier) a JOIN (SELECT *, row_number() OVER (ORDER BY c_name, c_custkey) AS rn FROM customer) b ON a.rn = b.rn""",
    "id_agreement": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1",
    "title_normalize": rf"""WITH x AS (SELECT 'p' || p_partkey AS key, '  The ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ': ' || p_brand || '!' AS raw FROM part
          UNION ALL SELECT 'd' || doc_id, text FROM documents)
        SELECT key, CASE WHEN raw <> '' THEN trim(regexp_replace(lower(raw), '{_LETTERS}', ' ', 'g')) END AS title, coalesce(nullif(trim(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '-'), ''), key) AS slug FROM x""",
    "fuzzy_title_ranked": rf"""WITH p AS (SELECT p_partkey, p_type, p_retailprice, trim(regexp_replace(lower(p_name), '{_LETTERS}', ' ', 'g')) AS t1, trim(regexp_replace(lower(p_brand), '{_LETTERS}', ' ', 'g')) AS t2 FROM part),
        w AS (SELECT DISTINCT p_partkey AS work, p_retailprice, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 99 END AS r, unnest([t1, t2]) AS t FROM p)
        SELECT p_partkey, first(work ORDER BY r, w.p_retailprice DESC, work) AS best, string_agg(work::VARCHAR, ',' ORDER BY r, w.p_retailprice DESC, work) AS ranked FROM p JOIN w ON t1 = t AND t <> '' AND work <> p_partkey GROUP BY 1""",
    "merge_duplicates": """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS bal, CASE WHEN c_acctbal > 9000 THEN c_custkey % 2 END AS owned FROM customer),
        g AS (SELECT c_nationkey, first(name ORDER BY c_custkey) FILTER (name IS NOT NULL) AS n1, first(bal ORDER BY c_custkey) FILTER (bal IS NOT NULL) AS b1, arg_min_null(name, c_custkey) AS n0, arg_min_null(bal, c_custkey) AS b0,
              string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS tags, count(*) AS n_merged, coalesce(min(owned) <> max(owned), false) AS conflict FROM c GROUP BY 1)
        SELECT c_nationkey, CASE WHEN conflict THEN n0 ELSE n1 END AS name, CASE WHEN conflict THEN b0 ELSE b1 END AS bal, tags, n_merged, conflict FROM g""",
    "map_scope_merge": """WITH b AS (SELECT o_custkey % 50 AS k, substr(o_orderpriority, 1, 1) AS p, count(*) FILTER (o_orderstatus = 'F') AS o, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY ALL)
        SELECT k, p, o AS n FROM b WHERE o > 0 AND p NOT IN ('1', '2', '3') UNION ALL SELECT k, p, n FROM b WHERE n > 0 AND p IN ('1', '2')""",
    "episode_season_counts": "SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_parts FROM lineitem GROUP BY 1",
    "slug_suffix": """WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)
        SELECT p_partkey, slug, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS unique_slug FROM k""",
    "natural_sort_rank": r"""WITH x AS (SELECT s_nationkey AS nation, 's' || (s_suppkey * 7 % 1000) || '-' || s_suppkey AS name FROM supplier UNION ALL SELECT c_nationkey, 'c' || (c_custkey * 13 % 10000) || ' ' || c_custkey FROM customer),
        k AS (SELECT *, substr(name, 1, 1) AS a, regexp_extract(name, '^.(\d+)', 1)::BIGINT AS b, regexp_extract(name, '\d+(\D)', 1) AS s, regexp_extract(name, '(\d+)$', 1)::BIGINT AS c FROM x)
        SELECT nation, name, row_number() OVER (PARTITION BY nation ORDER BY a, b, s, c, name) AS natural_rank FROM k""",
    "decision_table": r"""WITH o AS (SELECT o_custkey, coalesce(list(DISTINCT 'tt' || o_orderkey) FILTER (o_totalprice > 480000), []) AS ids FROM orders GROUP BY 1),
        c AS (SELECT c_custkey, c_acctbal > 0 AS verified, coalesce(ids, []) AS ids, CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'x1' ELSE c_custkey::VARCHAR END END AS digits,
              CASE WHEN c_custkey % 9 = 0 THEN 'Q0' ELSE 'Q' || (c_custkey + 1) END AS entity FROM customer LEFT JOIN o ON o_custkey = c_custkey),
        k AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN ['tt1'] WHEN 1 THEN ids ELSE [] END AS claims FROM c)
        SELECT c_custkey, CASE WHEN NOT verified THEN 'skipped:unverified' WHEN digits = 'x1' THEN 'skipped:id' WHEN len(ids) > 1 THEN 'skipped:ids' WHEN digits IS NULL AND len(ids) = 0 THEN 'skipped:none'
          WHEN entity = 'Q0' THEN 'skipped:entity' WHEN len(list_filter(claims, lambda x: NOT list_contains(ids, x))) > 0 THEN 'skipped:conflict' WHEN len(list_filter(ids, lambda x: NOT list_contains(claims, x))) > 0 THEN 'add' ELSE 'upToDate' END AS status FROM k""",
    "hierarchy_bfs": """WITH RECURSIVE w(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT o_orderkey, depth + 1 FROM orders JOIN w ON o_orderkey > 0 AND o_orderkey // 2 = node) SELECT node, depth FROM w""",
    "workflow_edges": """SELECT n_name AS source, r_name AS target FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT DISTINCT r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "first_and_top": """SELECT o_orderstatus, row_number() OVER w AS rank, o_orderkey, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 10""",
    "newer_rows": """SELECT o_custkey AS key, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1 HAVING coalesce(max(o_orderdate) FILTER (o_orderstatus = 'F') < max(o_orderdate), true)""",
    "multimap_build": """SELECT value, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS entries FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1""",
    "affixes": """WITH RECURSIVE n AS (SELECT p_brand AS k, p_type AS t FROM part UNION SELECT c_mktsegment, c_name FROM customer),
        p AS (SELECT k, max(i) AS i FROM (SELECT k, unnest(range(0, 41)) AS i FROM (SELECT DISTINCT k FROM n)) x WHERE (SELECT count(DISTINCT substr(t, 1, i)) = 1 AND min(length(t)) >= i FROM n WHERE n.k = x.k) GROUP BY 1),
        s AS (SELECT k, max(i) AS i FROM (SELECT k, unnest(range(0, 41)) AS i FROM (SELECT DISTINCT k FROM n)) x WHERE (SELECT count(DISTINCT right(t, i)) = 1 AND min(length(t)) >= i FROM n WHERE n.k = x.k) GROUP BY 1),
        a AS (SELECT p.k, substr(min(t), 1, p.i) AS prefix, right(min(t), s.i) AS suffix FROM p JOIN s ON p.k = s.k JOIN n ON n.k = p.k GROUP BY p.k, p.i, s.i)
        SELECT k AS p_brand, CASE WHEN k LIKE 'Brand%' THEN prefix END AS prefix, CASE WHEN k LIKE 'Brand%' THEN suffix END AS suffix, CASE WHEN k NOT LIKE 'Brand%' THEN prefix END AS q FROM a""",
}
