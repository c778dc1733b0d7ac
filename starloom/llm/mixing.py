"""Mixing sources to target weights, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.scratch import written

#: Weights of the sources in order, repeating; the share of all sizes to mix; how often a document may be taken.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Bits of a draw, and those by which one histogram narrows it.
DRAW_BITS, STEP_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets share `share` of all sizes by weight, in code point order of the sources (null last, weights repeating).
    Where a target is over `cap` times its source's size it stops there, and the excess is shared again by weight. In
    order of size over weight, the sources that stop are a prefix, so running sums find where it ends: no loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    of = F.array(*[F.lit(float(w)) for w in weights])
    x = sizes.withColumn("weight", F.element_at(of, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    x = x.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    x = x.withColumn("free", F.col("level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(every)["level"]
    return x.withColumn("common", level).select("source", "source_size", F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight"))).alias("target"))


def draw(*columns: Column) -> Column:
    """A number below 2 ** DRAW_BITS from a row's columns, the same in every run."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DRAW_BITS // 4), 16, 10).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row, and `copies` (how often the row is taken).

    Size counts the words of the text (null: 0). Each document of a source is taken whole, floor(target / source size)
    times, and those whose draw is under the source's threshold once more. The threshold comes from histograms: sizes
    are summed by source and the first bits of the draw; the bucket where the running sum passes the budget is refined
    by the next bits, alone, until draws are told apart; the last one is taken if that comes nearer to the budget.
    Rows that share id, source and size share a draw and a decision. An empty source has target 0. Nothing is sorted
    but histograms of 2 ** STEP_BITS buckets a source.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    rows = written(rows.withColumn("draw", draw(F.col("doc_id"), F.col("source"), F.col("size"))))
    return decided(rows, thresholds(rows, weights, share, cap)).drop("draw")


def taken_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of df that the mix takes, with all their columns and size, source_size, target, copies and taken.

    The thresholds are a row for each source, so texts meet them in a scan and aren't shuffled. Columns of df keep
    their names; where one has the name of a column of the mix, that of the mix is called mix_NAME, with as many mix_
    as it takes. Rows of a source without words aren't taken. Null ids, texts and sources are as good as others.
    """
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    keyed = df.select(row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    keyed = keyed.withColumn("draw", draw(F.col("id"), F.col("source"), F.col("size"))).drop("id")
    plan = thresholds(written(keyed.drop("row")), weights, share, cap)
    taken = decided(keyed, plan).where("copies > 0")
    taken_names = {c.lower() for c in names}

    def free(name: str) -> str:
        while name.lower() in taken_names:
            name = f"mix_{name}"
        return name

    made = [F.col(c).alias(free(c)) for c in ("size", "source_size", "target", "copies", "taken")]
    return taken.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *made)


def size_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def thresholds(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size, draw) to one row for each source: p_source, source_size, target, times, low (the threshold)."""
    first = written(_histogram(rows, DRAW_BITS - STEP_BITS))
    targets = source_targets(first.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    targets = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    budgets = written(targets.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    state = budgets.select(F.col("source").alias("s"), "budget", F.lit(0).cast("long").alias("low"), F.lit(False).alias("done"))
    counts = first
    for shift in range(DRAW_BITS - STEP_BITS, -1, -STEP_BITS):
        by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("upto", F.sum("size").over(by)).join(state, F.col("source").eqNullSafe(F.col("s")))
        # the first bucket that passes the budget; where none does, all draws are under the threshold
        over = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "upto", "size", "first", "last")))
        found = run.groupBy(F.col("s").alias("f")).agg(over.alias("b"))
        found = state.join(found, F.col("s").eqNullSafe(F.col("f")), "left")
        single = F.col("b.first") == F.col("b.last")
        near = F.when(2 * F.col("budget") - 2 * F.col("b.upto") + F.col("b.size") > 0, 1).otherwise(0)
        low = F.when(F.col("done"), F.col("low")).when(F.col("b").isNull(), F.lit(1 << DRAW_BITS))
        state = written(
            found.select(
                "s",
                (F.col("budget") - F.coalesce(F.col("b.upto") - F.col("b.size"), F.lit(0))).alias("budget"),
                low.when(single, F.col("b.first") + near).otherwise(F.shiftleft(F.col("b.bucket"), shift)).cast("long").alias("low"),
                (F.col("done") | F.col("b").isNull() | F.coalesce(single, F.lit(False))).alias("done"),
            )
        )
        open_ = state.where(~F.col("done")).select("s", F.shiftright("low", shift).alias("at"))
        if open_.isEmpty():
            break
        inside = rows.join(open_, rows["source"].eqNullSafe(F.col("s")) & (F.shiftright("draw", shift) == F.col("at")))
        counts = _histogram(inside, shift - STEP_BITS)
    plan = budgets.select("source", "source_size", "target", "times").join(state.select("s", "low"), F.col("source").eqNullSafe(F.col("s")))
    return written(plan.drop("s").withColumnRenamed("source", "p_source"))


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with size and draw, joined to their source's threshold: copies and taken.

    `low` lies within the cap where a source has words: empty documents, which cost no budget, are held to the cap here.
    """
    copies = F.least(F.col("times") + F.when(F.col("draw") < F.col("low"), F.lit(1)).otherwise(F.lit(0)), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("copies", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("p_source", "times", "low")


def _histogram(rows: DataFrame, shift: int) -> DataFrame:
    """Sizes by source and the draw's bits above `shift`, with the least and greatest draw of each bucket."""
    bucket = F.shiftright("draw", shift).alias("bucket")
    return rows.groupBy("source", bucket).agg(F.sum("size").alias("size"), F.min("draw").alias("first"), F.max("draw").alias("last"))
