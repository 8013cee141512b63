"""Alignment of timed streams by overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import blank
from lectern.operators._store import stored


#: Buckets that an interval is spread over at most.
WIDEST = 8


@dataclass(frozen=True)
class Timed:
    """Names of the columns of a timed stream: the file it belongs to, its times and its order."""

    file: str = "file"
    start: str = "start_us"
    end: str = "end_us"
    ordinal: str = "ordinal"
    pos: str = "pos"

    def prefixed(self, df: DataFrame, mark: str, *more: str) -> DataFrame:
        names = {"file": self.file, "s": self.start, "e": self.end, "ord": self.ordinal, "pos": self.pos} | {m: m for m in more}
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("int")).alias(f"{mark}_{k}") for k, c in names.items()])


def overlapping(a: DataFrame, b: DataFrame, bucket_us: int | None = None) -> DataFrame:
    """Pairs of ``a_`` and ``b_`` rows of one file whose half-open intervals overlap.

    With ``bucket_us``, both sides are spread over time buckets and joined on (file, bucket) too, so that
    one long file is many join keys; a pair is met only in the bucket where its overlap begins. Intervals of
    over WIDEST buckets are met in wider ones, so that none is spread over more. Without times nothing overlaps.
    """
    a, b = a.where("a_s < a_e"), b.where("b_s < b_e")
    test = (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e"))
    if bucket_us is None:
        return a.join(b, (F.col("a_file") == F.col("b_file")) & test)
    widths = [w for k in range(20) if (w := bucket_us * WIDEST**k) * WIDEST < 1 << 62]

    def level(mark: str) -> Column:
        out = F.lit(len(widths) - 1)
        for k in range(len(widths) - 2, -1, -1):
            out = F.when(F.col(f"{mark}_e") - F.col(f"{mark}_s") <= widths[k] * WIDEST, k).otherwise(out)
        return out

    a, b = a.withColumn("a_level", level("a")), b.withColumn("b_level", level("b"))
    # As many numbers as there are widths, mostly one.
    used = sorted(r[0] for r in a.select("a_level").union(b.select("b_level")).distinct().collect()) or [0]
    width = F.get(F.array(*[F.lit(w) for w in widths]), F.col("level"))

    def spread(df: DataFrame, mark: str) -> DataFrame:
        """At its own level and at all wider ones, where it may meet longer intervals."""
        rows = df.withColumn("level", F.explode(F.filter(F.array(*[F.lit(k) for k in used]), lambda k: k >= F.col(f"{mark}_level"))))
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{mark}_s") / width), F.floor((F.col(f"{mark}_e") - 1) / width)))).withColumnsRenamed({"level": f"{mark}_at", "bucket": f"{mark}_bucket"})

    keys = (F.col("a_file") == F.col("b_file")) & (F.col("a_at") == F.col("b_at")) & (F.col("a_bucket") == F.col("b_bucket"))
    met = spread(a, "a").join(spread(b, "b"), keys & test & (F.col("a_at") == F.greatest("a_level", "b_level")))
    first = F.floor(F.greatest("a_s", "b_s") / F.get(F.array(*[F.lit(w) for w in widths]), F.col("a_at")))
    return met.where(F.col("a_bucket") == first).drop("a_bucket", "b_bucket", "a_at", "b_at", "a_level", "b_level")


def _order(mark: str) -> list[Column]:
    return [F.col(f"{mark}_s"), F.col(f"{mark}_e"), F.col(f"{mark}_ord").asc_nulls_first(), F.col(f"{mark}_pos")]


def _best(pairs: DataFrame, of: str, among: str, tenths: int) -> DataFrame:
    """For each ``of`` row the ``among`` row that covers most of it, if over ``tenths`` tenths; the earliest on a tie."""
    shared = F.least("a_e", "b_e") - F.greatest("a_s", "b_s")
    pairs = pairs.withColumn("shared", shared).where(F.col("shared") * 10 > (F.col(f"{of}_e") - F.col(f"{of}_s")) * tenths)
    w = Window.partitionBy(f"{of}_file", f"{of}_pos").orderBy(F.col("shared").desc(), *_order(among))
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def best_match(inputs: DataFrame, refs: DataFrame, names: Timed = Timed(), tenths: int = 3, bucket_us: int | None = None) -> DataFrame:
    """Each input with the reference that overlaps most of its duration, if that is over ``tenths`` / 10."""
    pairs = overlapping(names.prefixed(inputs, "a"), names.prefixed(refs, "b"), bucket_us)
    return _best(pairs, "a", "b", tenths)


def align(inputs: DataFrame, refs: DataFrame, names: Timed = Timed(), tenths: int = 3, bucket_us: int | None = None) -> DataFrame:
    """Outer alignment: (file, in_pos, ref_pos) rows and their group's times.

    Every input takes its best reference; a reference that no input took joins the input that covers most
    of it; what is left of either side stands alone (the other position is null). ``g_s``, ``g_e`` and
    ``g_ord`` are the times and ordinal that the group sorts by: the input's, or the lone reference's.
    """
    a, b = names.prefixed(inputs, "a"), names.prefixed(refs, "b")
    pairs = overlapping(a, b, bucket_us)
    enough = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s")) * tenths
    # Pairs and links serve several steps each, so they are made once.
    pairs = stored(pairs.where((F.least("a_e", "b_e") - F.greatest("a_s", "b_s")) * 10 > enough))
    won = _best(pairs, "a", "b", tenths).select(F.col("a_file").alias("file"), F.col("a_pos").alias("in_pos"), F.col("b_pos").alias("ref_pos"))
    taken = won.select(F.col("file").alias("b_file"), F.col("ref_pos").alias("b_pos")).distinct()
    second = _best(pairs.join(taken, ["b_file", "b_pos"], "left_anti"), "b", "a", tenths).select(F.col("a_file").alias("file"), F.col("a_pos").alias("in_pos"), F.col("b_pos").alias("ref_pos"))
    links = stored(won.unionByName(second))
    matched = a.select(F.col("a_file").alias("file"), F.col("a_pos").alias("in_pos"), F.col("a_s").alias("g_s"), F.col("a_e").alias("g_e"), F.col("a_ord").alias("g_ord")).join(links, ["file", "in_pos"], "left")
    alone = b.select(F.col("b_file").alias("file"), F.col("b_pos").alias("ref_pos"), F.col("b_s").alias("g_s"), F.col("b_e").alias("g_e"), F.col("b_ord").alias("g_ord")).join(
        links.select("file", "ref_pos").distinct(), ["file", "ref_pos"], "left_anti"
    )
    return matched.unionByName(alone, allowMissingColumns=True).select("file", "in_pos", "ref_pos", "g_s", "g_e", "g_ord")


def align_by_order(inputs: DataFrame, refs: DataFrame, names: Timed = Timed(), bucket_us: int | None = None) -> DataFrame:
    """What ``align`` gives, for streams without times: the n-th input of a file with its n-th reference."""
    a, b = names.prefixed(inputs, "a"), names.prefixed(refs, "b")
    nth = lambda df, m: df.withColumn("n", F.row_number().over(Window.partitionBy(f"{m}_file").orderBy(f"{m}_pos"))).withColumnRenamed(f"{m}_file", "file")
    met = nth(a, "a").join(nth(b, "b"), ["file", "n"], "full")
    either = lambda k: F.when(F.col("a_pos").isNotNull(), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(f"g_{k}")
    return met.select("file", F.col("a_pos").alias("in_pos"), F.col("b_pos").alias("ref_pos"), *[either(k) for k in ("s", "e", "ord")])


def merged_refs(aligned: DataFrame, refs: DataFrame, names: Timed = Timed(), text: str = "text") -> DataFrame:
    """A row per group of ``align``: the reference source (ordinal of the first that has one, start of the
    first, end of the last) and the references' texts, a blank line between those that aren't blank."""
    r = names.prefixed(refs, "r", text).withColumnRenamed("r_file", "file").withColumnRenamed("r_pos", "ref_pos")
    rows = aligned.join(r, ["file", "ref_pos"], "left")
    at = F.struct(F.col("r_s"), F.col("r_e"), F.col("r_ord"), F.col("ref_pos"), F.col(f"r_{text}").alias("text"))
    key = ["file", "in_pos", F.when(F.col("in_pos").isNull(), F.col("ref_pos")).alias("lone_pos")]
    grouped = rows.select(*key, "g_s", "g_e", "g_ord", F.when(F.col("ref_pos").isNotNull(), at).alias("ref")).groupBy("file", "in_pos", "lone_pos", "g_s", "g_e", "g_ord").agg(
        F.sort_array(F.collect_list("ref")).alias("refs")
    )
    rest = F.filter(F.transform(F.slice("refs", F.lit(2), F.greatest(F.size("refs") - 1, F.lit(0))), lambda x: x["text"]), lambda t: ~blank(t))
    texts = F.concat(F.array(F.coalesce(F.get("refs", F.lit(0))["text"], F.lit(""))), rest)
    has = F.size("refs") > 0
    return grouped.select(
        "file", "in_pos", "lone_pos", "g_s", "g_e", "g_ord",
        F.size("refs").cast("long").alias("n_refs"),
        F.get(F.filter(F.transform("refs", lambda x: x["r_ord"]), lambda o: o.isNotNull()), F.lit(0)).alias("ref_ordinal"),
        F.when(has, F.get("refs", F.lit(0))["r_s"]).alias("ref_start"),
        F.when(has, F.try_element_at("refs", F.lit(-1))["r_e"]).alias("ref_end"),
        F.when(has, F.array_join(texts, "\n\n")).alias("ref_text"),
    )


def merge_same_text(cues: DataFrame, names: Timed = Timed(), text: str = "text", gap_us: int = 0) -> DataFrame:
    """Consecutive cues of equal text whose times touch, or are at most ``gap_us`` apart, become one."""
    w = Window.partitionBy(names.file).orderBy(names.start, names.end, names.pos)
    new = ~((F.lag(text).over(w).eqNullSafe(F.col(text))) & (F.col(names.start) - F.lag(names.end).over(w) <= gap_us))
    island = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        cues.withColumn("__island", island)
        .groupBy(names.file, "__island")
        .agg(F.min(names.start).alias(names.start), F.max(names.end).alias(names.end), F.min(names.pos).alias(names.pos), F.first(text).alias(text), F.count("*").alias("n_cues"))
        .drop("__island")
    )


def cues_of_blocks(blocks: DataFrame, text: str = "text", ref_text: str = "ref_text", include_ref: bool = True, extend_us: int = 0) -> DataFrame:
    """Cues from blocks: the block's own text if it has some and times, else its reference's as a short
    cue that begins half-way. Needs start_us, end_us, ref_start_us and ref_end_us."""
    from lectern.functions.time import midpoint_cue

    own = ~blank(text) & F.col("start_us").isNotNull()
    ref = ~blank(ref_text) & F.col("ref_start_us").isNotNull() & F.lit(include_ref)
    mid = midpoint_cue("ref_start_us", "ref_end_us")
    return blocks.where(own | ref).withColumns(
        {
            "cue_text": F.when(own, F.col(text)).otherwise(F.col(ref_text)),
            "cue_start": F.when(own, F.col("start_us")).otherwise(mid["start_us"]),
            "cue_end": F.when(own, F.col("end_us") + extend_us).otherwise(mid["end_us"]),
        }
    )
