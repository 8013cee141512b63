"""Queries over texts: terms, search, chunks, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import bits
from lectern.functions import text as T
from lectern.operators import filters, folds, lookup, search, sequence, signatures, stats
from lectern.plans.tables import read


def _tokens(spark, d, *more):
    return read(spark, d, "documents").select(*more, F.explode(stats.words("text")).alias("term"))


def term_frequency(spark, d):
    return stats.term_frequency(_tokens(spark, d, "lang"), ["term"], ["lang"])


def _volumes(spark, d):
    return stats.term_frequency(_tokens(spark, d, F.col("source").alias("volume")), ["term"], ["volume"])


def corpus_document_frequency(spark, d):
    return stats.document_frequency(_volumes(spark, d)).select("term", F.col("cnt").cast("long").alias("cnt"), "n_docs")


def utility_score(spark, d):
    counts = _volumes(spark, d)
    n = read(spark, d, "documents").select(F.count_distinct("source")).first()[0]
    out = stats.utility(counts, stats.document_frequency(counts), F.lit(n), proper=F.col("term").rlike("^[0-9]"))
    return out.select("volume", F.round("weighted_df", 6).alias("weighted_df"), F.round("mean_df", 6).alias("mean_df"), "n_terms")


def concat_by_key(spark, d):
    c = read(spark, d, "conversations").where("role <> 'system'")
    return stats.concatenated(c, "conv_id", ["turn"], "text").select("conv_id", F.md5("texts").alias("md5"), F.length("texts").alias("n_chars"))


def ref_chunk_fold(spark, d):
    c = read(spark, d, "conversations")
    none = F.lit(None).cast("string")
    ref = F.struct(F.col("text"), none.alias("actor"), none.alias("role"))
    system = F.col("role") == "system"
    chunk = F.struct(
        F.when(~system, F.col("text")).alias("text"), none.alias("actor"), F.col("role"), F.when(system, F.create_map(F.lit("ref"), ref)).otherwise(F.lit(None).cast("map<string,struct<text:string,actor:string,role:string>>")).alias("references")
    )
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(chunk).alias("c")))).alias("t"))
    chunks = F.transform("t", lambda x: F.from_json(x["c"], folds.CHUNK))
    out = rows.select("conv_id", folds.merge_reference_chunks(chunks).alias("m")).select("conv_id", F.posexplode("m").alias("i", "c"))
    return out.select("conv_id", F.col("i").cast("long").alias("i"), F.md5(F.col("c.text")).alias("text_md5"), F.md5(F.try_element_at("c.references", F.lit("ref"))["text"]).alias("ref_md5"))


def nav_prev_next(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") != "assistant", F.col("role")).alias("heading"))
    out = sequence.periodic_headings(sequence.neighbours(c, ["conv_id"], ["turn"], "role"), ["conv_id"], ["turn"], "heading", 2)
    out = sequence.running_notes(out, ["conv_id"], ["turn"], F.col("role") == "user")
    return out.select("conv_id", "turn", "previous", "next", "made_heading", F.col("note_no").cast("long").alias("note_no"))


def subtitle_clean(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("{\\an8}"), F.col("text"), F.lit("{x}")).alias("text"), F.col("turn").alias("start_us"), (F.col("turn") * 7 % 5).alias("end_us"))
    c = sequence.ordinals(c, ["conv_id"], ["turn"])
    return filters.cleaned_cues(c).select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), T.hard_breaks("text").alias("text"))


def script_filter(spark, d):
    x = read(spark, d, "documents")
    return x.select("doc_id", T.upper_count("text").cast("long").alias("n_upper"), T.kana_count("text").cast("long").alias("n_kana"), T.has_japanese("text").alias("japanese"), T.is_japanese_text("text").alias("kept"))


def ruby_markup(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "[x] "), F.lit("[yz] end")).alias("raw"))
    return p.select("p_partkey", T.ruby("raw").alias("html"), T.ruby("raw", "remove").alias("plain"))


def html_extract(spark, d):
    p = read(spark, d, "pages")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return p.select("page_id", T.html_text(title).alias("title"), F.posexplode(links).alias("link_no", "link")).withColumn("link_no", F.col("link_no").cast("long"))


def leader_clusters(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", F.col("vec_id").cast("string").alias("name"), bits.average_hash("embedding").alias("sig"))
    out = folds.leader_clusters(e, "label", "vec_id", "name", "sig", 0.6)
    return out.select("label", F.col("pos").alias("vec_id"), "grp", "candidate", F.round("similarity", 6).alias("similarity"))


def hash_similarity_topk(spark, d):
    e = read(spark, d, "embeddings").select("label", "vec_id", bits.average_hash("embedding").alias("sig"))
    return signatures.top_similar(signatures.similar_pairs(e, "label", "vec_id", "sig", 0.75), "label").select("label", "a", "b", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _queries(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))


def phrase_search(spark, d):
    index = search.opened(spark, f"{d}/documents.parquet", "doc_id", "text", ["lang"])
    out = search.search(index, _queries(spark, d), "item_id", "q", 10)
    return out.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "phrase", "score")


def search_link_top1(spark, d):
    index = search.opened(spark, f"{d}/documents.parquet", "doc_id", "text", ["lang"])
    return search.link(index, _queries(spark, d), "item_id", "q", ["lang"]).select("item_id", "linked_doc", "linked_lang")


def ordered_subjects(spark, d):
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_shipdate", "l_suppkey"))).alias("x"))
    left = li.select("l_orderkey", F.transform("x", lambda v: v["l_suppkey"] * 2).alias("ids"))
    names = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    out = lookup.ordered_lookup(left, "l_orderkey", "ids", names, "key", "s_name", "names")
    return out.select("l_orderkey", F.size("names").cast("long").alias("n"), F.array_join(F.array_sort("names"), ",").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (
        term_frequency, corpus_document_frequency, utility_score, concat_by_key, ref_chunk_fold, nav_prev_next, subtitle_clean, script_filter, ruby_markup, html_extract, leader_clusters,
        hash_similarity_topk, phrase_search, search_link_top1, ordered_subjects,
    )
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')"
_SIG = """sig AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) >= (list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding))) AS b FROM embeddings)"""
_SIM = "(1 - len(list_filter(list_zip({0}, {1}), lambda p: p[1] <> p[2])) / 64)"


#: The search's scores for queries of all words of the items.
_SCORES = rf"""WITH dt AS (SELECT doc_id, lang, {_WORDS} AS w FROM documents WHERE text <> ''), p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM dt),
      q AS (SELECT item_id, {_WORDS} AS w FROM benchmark), qt AS (SELECT item_id, len(w) AS q_len, unnest(w) AS term, generate_subscripts(w, 1) AS qpos FROM q),
      ph AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, doc_id, pos - qpos AS pos0, q_len, count(DISTINCT qpos) AS n FROM p JOIN qt USING (term) GROUP BY ALL) WHERE n = q_len),
      tf AS (SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      sc AS (SELECT item_id, doc_id, round(sum(sqrt(tf) * (1 + ln((SELECT count(*) FROM dt)::DOUBLE / (df + 1))) * (1 + ln((SELECT count(*) FROM dt)::DOUBLE / (df + 1))) ) / sqrt(any_value(len(w))) * count(*) / any_value(qn), 6) AS score
             FROM (SELECT DISTINCT item_id, term FROM qt) JOIN tf USING (term) JOIN df USING (term) JOIN dt USING (doc_id) JOIN (SELECT item_id, count(DISTINCT term) AS qn FROM qt GROUP BY 1) USING (item_id) GROUP BY ALL),
      hit AS (SELECT item_id, doc_id, score, true AS phrase FROM sc WHERE (item_id, doc_id) IN (SELECT item_id, doc_id FROM ph) UNION ALL SELECT item_id, doc_id, score, false FROM sc WHERE item_id NOT IN (SELECT item_id FROM ph)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit)"""


_LEADERS = f"""WITH RECURSIVE {_SIG}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM sig),
        f AS (SELECT label, n, vec_id, CAST(NULL AS BIGINT) AS grp, CAST(NULL AS BIGINT) AS candidate, CAST(NULL AS DOUBLE) AS sim, vec_id AS lead_id, b AS lead_b FROM r WHERE n = 1
          UNION ALL
          SELECT label, n, vec_id, CASE WHEN sim >= 0.6 THEN lead_id END, CASE WHEN sim < 0.6 THEN lead_id END, sim, CASE WHEN sim >= 0.6 THEN lead_id ELSE vec_id END, CASE WHEN sim >= 0.6 THEN lead_b ELSE b END
          FROM (SELECT r.label, r.n, r.vec_id, r.b, f.lead_id, f.lead_b, {_SIM.format("f.lead_b", "r.b")} AS sim FROM f JOIN r ON r.label = f.label AND r.n = f.n + 1))
        SELECT label, vec_id, grp::VARCHAR AS grp, candidate::VARCHAR AS candidate, round(sim, 6) AS similarity FROM f"""

ORACLE = {
    "term_frequency": f"SELECT lang, term, count(*) AS cnt FROM (SELECT lang, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL",
    "corpus_document_frequency": f"SELECT term, count(*) AS cnt, count(DISTINCT source) AS n_docs FROM (SELECT source, unnest({_WORDS}) AS term FROM documents) GROUP BY 1",
    "utility_score": f"""WITH c AS (SELECT source AS volume, term, count(*) AS cnt FROM (SELECT source, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL), d AS (SELECT term, count(*) / (SELECT count(DISTINCT source) FROM documents) AS share FROM c GROUP BY 1)
        SELECT volume, round(sum(share * cnt) / sum(cnt), 6) AS weighted_df, round(avg(share), 6) AS mean_df, count(*) AS n_terms FROM c JOIN d USING (term) WHERE NOT regexp_matches(term, '^[0-9]') GROUP BY 1""",
    "concat_by_key": """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS md5, length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS n_chars FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY 1""",
    "ref_chunk_fold": """WITH x AS (SELECT *, lag(role) OVER w = 'system' AS after_ref, lag(text) OVER w AS ref, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        y AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN text END AS t, CASE WHEN role = 'system' THEN text WHEN after_ref THEN ref END AS r FROM x WHERE role <> 'system' OR nxt IS NULL OR nxt = 'system')
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, md5(t) AS text_md5, md5(r) AS ref_md5 FROM y""",
    "nav_prev_next": """SELECT conv_id, turn, lag(role) OVER w AS previous, lead(role) OVER w AS next, (row_number() OVER w - 1) % 2 = 0 AND role = 'assistant' AS made_heading,
        CASE WHEN role = 'user' THEN CAST(sum(CAST(role = 'user' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS note_no FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "subtitle_clean": r"""WITH x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, trim(regexp_replace('{\an8}' || text || '{x}', '\{.*?\}', '', 'g'), ' ') AS t FROM conversations)
        SELECT conv_id, ordinal, replace(t, chr(10), '  ' || chr(10)) AS text FROM x WHERE turn <= turn * 7 % 5 AND length(t) > 1""",
    "script_filter": r"""WITH x AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '[^ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿｦ-ﾟ]', '', 'g') AS kana, regexp_replace(coalesce(text, ''), '[^一-鿿㐀-䶿]', '', 'g') AS kanji FROM documents),
        y AS (SELECT *, length(kana) AS n, length(replace(kana, 'ロ', '')) AS sure, length(regexp_replace(kanji, '[口入人日]', '', 'g')) AS han FROM x)
        SELECT doc_id, CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper, CAST(n AS BIGINT) AS n_kana, coalesce(regexp_matches(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]'), false) AS japanese,
               sure > 1 OR (sure > 0 AND n > 1) OR han > 0 AS kept FROM y""",
    "ruby_markup": r"""WITH p AS (SELECT p_partkey, regexp_replace(p_name, ' ', '[x] ', 'g') || '[yz] end' AS raw FROM part)
        SELECT p_partkey, regexp_replace(raw, ' ?([a-z]+)\[([a-z]+)\]', '<ruby>\1<rt>\2</rt></ruby>', 'g') AS html, regexp_replace(raw, ' ?([a-z]+)\[([a-z]+)\]', '\1', 'g') AS plain FROM p""",
    "html_extract": """WITH x AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)
        SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title, generate_subscripts(l, 1) - 1 AS link_no, unnest(l) AS link FROM x""",
    "leader_clusters": _LEADERS,
    "hash_similarity_topk": f"""WITH {_SIG}, p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, {_SIM.format("x.b", "y.b")} AS s FROM sig x JOIN sig y ON x.label = y.label AND x.vec_id <> y.vec_id)
        SELECT label, a, b, round(s, 6) AS similarity, row_number() OVER (PARTITION BY label, a ORDER BY s DESC, b) AS rank FROM p WHERE s >= 0.75 QUALIFY rank <= 3""",
    "phrase_search": _SCORES + " SELECT item_id, doc_id, phrase, score FROM rk WHERE rank <= 10",
    "search_link_top1": _SCORES + " SELECT b.item_id, rk.doc_id AS linked_doc, lang AS linked_lang FROM benchmark b LEFT JOIN rk ON rk.item_id = b.item_id AND rank = 1 LEFT JOIN documents d ON d.doc_id = rk.doc_id",
    "ordered_subjects": """SELECT l_orderkey, count(s_name) AS n, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS names FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey * 2 GROUP BY 1""",
}
