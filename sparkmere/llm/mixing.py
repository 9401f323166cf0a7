"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import field, quoted, whole
from .store import materialise, maybe_broadcast

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5, as a long; any engine with MD5 can give the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _id_text(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit(""))


def _order(id_: Column, seed: int) -> Column:
    return hash60(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")))


def water_fill(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, budget: float | None = None) -> DataFrame:
    """Targets of the sources in `sizes` (source, source_size), one row each.

    The sources take `weights` in the order of their code points, null last, repeating. They share `budget`
    (default: the sum of the sizes) by weight; none gets more than `max_epochs` times its size, and what is clamped off is
    shared again by weight until none is above. That fixed point is target = min(cap, weight * level): sources saturate
    in the order of cap / weight, so one pass over that order finds the level. The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) if budget is None else F.lit(float(budget))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("at", F.row_number().over(order)).withColumn("level_here", (total - before) / rest)
    level = F.min_by(F.when(F.col("ratio") >= F.col("level_here"), F.col("level_here")), F.when(F.col("ratio") >= F.col("level_here"), F.col("at"))).over(everything)
    return t.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "weight", "target")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row a source: its target, whole repetitions, and the seeded order's last document in the fractional one.

    Within a source the documents are ordered by a seeded hash of their id. The fractional repetition takes documents in
    that order until the target is met; the document at the boundary is taken in part (`b_part` words), equal rows there
    alike. The boundary is found by two histograms of the hash (2^12 cells, then 2^12 within the boundary cell), so only
    the documents of one cell of 2^24 are ever put in order, however many rows a source has.
    """
    sized = materialise(docs.select(quoted(source_col).cast("string").alias("source"), _id_text(quoted(id_col)).alias("id"), _order(quoted(id_col), seed).alias("h"), word_count(quoted(text_col)).alias("size")), "mix-sizes")
    plan = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, budget)
    plan = plan.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    plan = materialise(plan.withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "mix-sources")

    def same(a, b, *more):
        on = a.source.eqNullSafe(b.source)
        for c in more:
            on = on & (a[c] == b[c])
        return on

    found, rows = plan.select("source", "need"), sized.withColumn("c1", F.shiftright("h", 48)).withColumn("c2", F.shiftright("h", 36).bitwiseAND(4095))
    for cell in ("c1", "c2"):
        keys = ["c1"] if cell == "c2" else []
        part = rows.join(found.drop("need"), same(rows, found, *keys), "left_semi") if keys else rows
        hist = part.groupBy("source", cell).agg(F.sum("size").alias("words"))
        hist = hist.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy(cell)) - F.col("words"))
        f = found.alias("f")
        found = hist.alias("x").join(f, F.col("x.source").eqNullSafe(F.col("f.source")) & (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))).select("f.source", *[f"f.{k}" for k in keys], f"x.{cell}", (F.col("need") - F.col("before")).alias("need"))
    last = rows.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.c1") == F.col("f.c1")) & (F.col("r.c2") == F.col("f.c2")))
    last = last.groupBy("r.source", "h", "id", "size", "need").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("h", "id", "size"))
    last = last.withColumn("before", upto - F.col("size") * F.col("n")).where(F.col("before") < F.col("need"))
    last = last.where(F.col("before") + F.col("size") * F.col("n") >= F.col("need")).select(F.col("source"), F.col("h").alias("b_h"), F.col("id").alias("b_id"), F.col("size").alias("b_size"), F.floor((F.col("need") - F.col("before")) / F.col("n")).cast("long").alias("b_part"))
    p, b = plan.alias("p"), last.alias("b")
    return p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.source", "source_size", "target", "whole", "need", "b_h", "b_id", "b_size", "b_part")


MIXED = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_part", "mix_taken")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> DataFrame:
    """(_doc, *MIXED)."""
    plan = materialise(mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how), "mix-plan")
    plan = maybe_broadcast(plan)
    d = docs.select(whole(docs), word_count(quoted(text_col)).alias("mix_size"), _order(quoted(id_col), how.get("seed", SEED)).alias("_key"), _id_text(quoted(id_col)).alias("_id"), quoted(source_col).cast("string").alias("_source"))
    d = d.join(plan, F.col("_source").eqNullSafe(F.col("source")), "left")
    key, bound = F.struct("_key", "_id", "mix_size"), F.struct(F.col("b_h").alias("_key"), F.col("b_id").alias("_id"), F.col("b_size").alias("mix_size"))
    more = F.when(key == bound, F.col("b_part")).when(F.col("b_h").isNotNull() & (key < bound), F.col("mix_size")).otherwise(F.lit(0))
    whole_more = (F.col("_more") >= F.col("mix_size")) & (F.col("mix_size") > 0)
    copies = F.col("whole") + F.when(whole_more, 1).otherwise(0)
    part = F.when(whole_more, 0).otherwise(F.col("_more")).cast("long")
    return d.withColumn("_more", more).select("_doc", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"), part.alias("mix_part"), (F.col("whole") * F.col("mix_size") + F.col("_more")).alias("mix_taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target, mix_copies (whole repetitions), mix_part (words of a further, partial one), mix_taken.

    Null text has size 0 and is never taken; a null source is a source of its own, last in order; a null id counts as an
    empty one; ids may be of any type that has a text form. Rows with equal id, source and size are treated alike. Columns
    of `docs` that have one of the new names are replaced; all others stay, whatever their names. An empty table gives an
    empty result. Each row meets its source's plan by a join with one row a source, so no source's documents are gathered.
    """
    got = _mixed(docs, id_col, text_col, source_col, weights=weights, max_epochs=max_epochs, budget=budget, seed=seed)
    return got.select(*[field(c).alias(c) for c in docs.columns if c.lower() not in MIXED], *MIXED)


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; one taken in part counts from half its words on. Columns as in `docs`."""
    got = _mixed(docs, id_col, text_col, source_col, **how)
    half = F.when((F.col("mix_part") > 0) & (2 * F.col("mix_part") >= F.col("mix_size")), 1).otherwise(0)
    times = got.select("_doc", (F.col("mix_copies") + half).cast("int").alias("_times")).where("_times > 0")
    again = times.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time"))
    return again.select(*[field(c).alias(c) for c in docs.columns])
