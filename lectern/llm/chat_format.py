"""Chat formatting of typed content parts, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A content part: kind is text, image, audio or document; the rest is null where it doesn't apply.
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
BOS, EOS, CLOSE = "<s>", "</s>", "[/INST]"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escaped(text: Column) -> Column:
    """A backslash after each character that a control string can begin or end with, and after each
    backslash: no control string is left, and ``unescaped`` takes exactly these backslashes away."""
    return F.regexp_replace(text, r"([<\[\]\\])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\]\\])\\", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as its one content part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))
    )


def _tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for when the attachment is expanded."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / F.lit(PATCH))
    return (
        F.when(part["kind"] == "image", F.greatest(side(part["width"]) * side(part["height"]), F.lit(1)))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _visit(part: Column) -> Column:
    """What a part leaves in the text: escaped text, or a placeholder that text cannot imitate."""
    mark = F.upper(F.coalesce(part["kind"], F.lit("text")))
    return F.when(mark == "TEXT", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("[PART "), escaped(mark), F.lit("]")))


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learn: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans (start and end of each ``learn`` turn's
    body, in code points, and the same in UTF-8 bytes), attachments (part kind, uri, turn position, expanded
    tokens, in order) and expanded_tokens.

    ``parts`` names a column of type array<PART>; without it ``text`` is the only part. Turns are in
    the order of turn, then role, then body; null turns come first. Null texts, roles and parts are
    empty; rows of a null conversation form one conversation. Equal turns all stay. An empty table
    gives no rows; other columns are ignored. Offsets are running sums over a conversation's sorted turns, so
    that the work is linear in their number; a conversation, being one string, is one task's work.
    """
    content = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")) if parts else text_parts(F.col(text))
    seg = rows.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.array_join(F.transform(content, _visit), "").alias("body"),
        F.transform(
            F.filter(content, lambda p: p["kind"] != "text"),
            lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), _tokens(p).alias("tokens")),
        ).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "attached")
    head = F.concat(F.lit("[INST "), escaped(F.col("role")), F.lit("]\n"))
    seg = seg.withColumn("head", head)
    for name, size in (("at", F.length), ("byte_at", F.octet_length)):
        own = (size("head") + size("body") + len(CLOSE)).cast("long")
        seg = seg.withColumn(name, F.coalesce(F.sum(own).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(BOS) + size("head"))
    # The sums tell turns apart, so that they come back in this order; control strings are ASCII, so both sums grow.
    turns = F.array_sort(F.collect_list(F.struct("at", "byte_at", "head", "role", "body", "attached")))
    conv_rows = seg.groupBy("conv_id").agg(turns.alias("turns"))
    span = lambda t: F.struct(t["at"].alias("start"), (t["at"] + F.length(t["body"])).alias("end"), t["byte_at"].alias("byte_start"), (t["byte_at"] + F.octet_length(t["body"])).alias("byte_end"))
    attached = F.flatten(F.transform("turns", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("position"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return conv_rows.select(
        "conv_id",
        F.concat(F.lit(BOS), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), ""), F.lit(EOS)).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == learn), span).alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, read from the string alone."""
    inner = F.substring(formatted, F.lit(len(BOS) + 1), F.length(formatted) - (len(BOS) + len(EOS)))
    pieces = F.filter(F.split(inner, r"\[/INST\]"), lambda p: p != "")
    halves = F.transform(pieces, lambda p: F.split(p, r"\]\n", 2))
    return F.transform(
        halves,
        lambda h: F.struct(unescaped(F.substring(h[0], F.lit(len("[INST ") + 1), F.length(h[0]))).alias("role"), unescaped(h[1]).alias("text")),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. It is cut by bytes: a cut by code points would count them from
    the start of the string, for each span anew."""
    cut = lambda whole, s: F.decode(F.substring(whole, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")), "UTF-8")
    # The array of one makes the string's bytes once.
    joined = F.transform(F.array(formatted.cast("binary")), lambda whole: F.array_join(F.transform(spans, lambda s: cut(whole, s)), ""))
    return unescaped(joined[0])


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts imitate control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.sql(
        f"SELECT conv_id, turn, role, text FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS probe(conv_id, turn, role, text)"
    )
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_chat``'s rows."""
    turns = read_turns(F.col("formatted"))
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return (
        formatted.withColumn("_t", turns)
        .withColumn("_l", loss)
        .select(
            "conv_id",
            F.size("_t").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("_l").cast("long").alias("loss_chars"),
            F.sha2(F.col("_l"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text, '([<\[\]\\])', '\1\\', 'g')) + length(regexp_replace(role, '([<\[\]\\])', '\1\\', 'g')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(7 + sum(n + 6 + 2 + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
