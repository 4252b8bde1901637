"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources share the words of the whole corpus by weight. A source whose share exceeds ``max_epochs`` times its
own words is clamped there and what it leaves is shared again by weight among the others, until none is above.
A source's target is then met by whole repetitions of all its documents plus one more repetition of documents
drawn by a seeded ticket, the lowest tickets first, up to the document that comes nearest the target.

Defined results: null text has size 0; a null source is a source of its own and comes last; rows of one doc_id
share a ticket, so they are drawn together; documents of size 0 can be repeated but add no words; an empty table
gives no rows; other columns are carried along untouched.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaymark.llm import common

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-7:"
#: A ticket has 48 bits; the point where a source's draw ends is found by its high 12, then 12 more, then the rest.
LEVEL = 1 << 24


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the position of a source in code point order with null last, without a single-task sort."""
    order = F.col("source").asc_nulls_last()
    dealt = common.settle(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = dealt.groupBy("part").agg(F.count("*").alias("here")).select(
        "part", (F.sum("here").over(W.orderBy("part")) - F.col("here")).alias("before")  # a row for each partition
    )
    inside = F.row_number().over(W.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("inside", inside).join(before, "part").select(
        "source", "source_size", (F.col("before") + F.col("inside")).alias("place")
    )


def targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> also ``weight`` and ``target`` in words."""
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = common.settle(
        _ranked(sources).withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    )
    wide = "decimal(38,0)"
    total = weighed.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    rest, share, clamped = total, None, None
    while True:  # every turn clamps at least one more source; a turn is one small aggregation
        above = (
            F.lit(False)
            if share is None
            else F.col("cap").cast(wide) * F.lit(share).cast(wide) < F.col("weight").cast(wide) * F.lit(rest).cast(wide)
        )
        now = weighed.agg(
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("share"),
            F.count_if(above).alias("clamped"),
        ).first()
        if now["clamped"] == clamped:
            break
        rest, share, clamped = total - now["held"], now["share"], now["clamped"]
    poured = F.lit(float(rest)) / F.lit(float(share or 1)) * F.col("weight").cast("double")
    return weighed.withColumn("target", F.when(above, F.col("cap").cast("double")).otherwise(poured))


def _crossing(counted: DataFrame, level: str) -> DataFrame:
    """For each source, the first ``level`` at which the running words exceed ``left``, and ``left`` before it."""
    running = F.sum("words").over(W.partitionBy("source").orderBy(level).rowsBetween(W.unboundedPreceding, 0))
    passed = counted.withColumn("running", running).where("running > left")
    return passed.groupBy("source").agg(
        F.min(F.struct(F.col(level), (F.col("left") - F.col("running") + F.col("words")).alias("left"))).alias("at")
    ).select("source", F.col(f"at.{level}").alias(level), "at.left")


def _draw_ends(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, last``: the highest ticket that a source's extra repetition takes."""
    first = F.shiftright("ticket", 36)
    second = F.shiftright("ticket", 24)

    def inside(rows: DataFrame, at: DataFrame, *keys: str) -> DataFrame:
        same = rows["source"].eqNullSafe(at["source"])
        for key in keys:
            same = same & (rows[key] == at[key])
        return rows.join(at, same).select(rows["*"], at["left"])

    def counted(rows: DataFrame, level: str) -> DataFrame:
        return rows.groupBy("source", level).agg(F.sum("size").alias("words"), F.max("left").alias("left"))

    rows = sized.withColumn("high", first).withColumn("middle", second)
    coarse = common.settle(_crossing(counted(inside(rows, plan), "high"), "high"))
    fine = common.settle(_crossing(counted(inside(rows, coarse, "high"), "middle"), "middle"))
    ends = counted(inside(rows, fine, "middle"), "ticket")
    running = F.sum("words").over(W.partitionBy("source").orderBy("ticket").rowsBetween(W.unboundedPreceding, 0))
    near = ends.withColumn("running", running).where(F.col("running") - F.col("words") / 2 <= F.col("left"))
    last = near.groupBy("source").agg(F.max("ticket").alias("last"))
    starts = fine.select("source", (F.col("middle") * LEVEL - 1).alias("start"))
    return starts.join(last, starts["source"].eqNullSafe(last["source"]), "left").select(
        starts["source"], F.coalesce("last", "start").alias("last")
    )


EXTRA = ["size", "source_size", "target", "copies", "taken"]


def _taken(docs: DataFrame, carried: list[str], weights, max_epochs: int, seed: str, size: Column | None) -> DataFrame:
    """``EXTRA`` for every row, beside the columns to carry packed as ``_row``."""
    size = (word_count(F.col("text")) if size is None else size).alias("size")
    draw = common.ticket(seed, F.col("doc_id")).alias("ticket")
    sized = common.settle(docs.select("doc_id", "source", size, draw))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sources, weights, max_epochs)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = common.settle(
        aimed.withColumn("rounds", rounds.cast("long")).withColumn(
            "left", F.col("target") - F.col("rounds") * F.col("source_size")
        )
    )
    ends = common.settle(_draw_ends(sized, plan.select("source", "left")))
    plan = common.settle(
        plan.join(ends, plan["source"].eqNullSafe(ends["source"]), "left").select(
            plan["source"].alias("_source"), "source_size", "target", "rounds", "last"
        )
    )
    drawn = (F.col("target") > 0) & (F.col("ticket") <= F.coalesce("last", F.lit(-1)))
    copies = F.least(F.col("rounds") + drawn.cast("long"), F.lit(max_epochs).cast("long"))
    # Ids and sources alone need no second look at the texts.
    base = sized if set(carried) <= {"doc_id", "source"} else docs
    packed = base.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), "source",
        *(["size", "ticket"] if base is sized else [size, draw]),
    )
    return (
        packed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("_row", *EXTRA)
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, size: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or the columns to carry) with ``size, source_size, target, copies, taken`` in the place of any
    columns of these names; ``copies`` is how often the mix has the row."""
    carried = [c for c in (docs.columns if carry is None else carry) if c not in EXTRA]
    return _taken(docs, carried, weights, max_epochs, seed, size).select(*[f"_row.`{c}`" for c in carried], *EXTRA)


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    taken = _taken(docs, docs.columns, weights, max_epochs, seed, None).where("copies > 0")
    turns = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.select("_row", turns.alias("turn")).select("_row.*")
