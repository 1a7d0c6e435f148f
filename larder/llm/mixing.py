"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source has a weight and wants that share of the total. A source stops at
``max_epochs`` times its size; what it leaves is shared among the others by
weight until none is above its cap. With sources in order of cap / weight that
is one running sum: source i stops at its cap if the rest of the total, divided
by the rest of the weights, still reaches cap / weight.

A target is met by whole repetitions of all documents and one fractional
repetition, a sample of whole documents in the order of a seeded hash. Documents
are cut from that order in four passes, the long ones first, each pass aiming at
what the passes before left over, so the sample ends within half a short
document of its goal. A pass sums sizes by (source, hash cell), finds the cell
in which the goal is reached, and orders the documents of that cell alone; no
source is ever ordered whole. The resulting cuts, at most four per source, go
back to the documents in one join.

Nulls and ties: a null text has size 0, the null source is a source of its own
and comes last. Rows with equal id share their fate. An empty table gives no
rows. Extra columns are carried by ``mixed_documents`` and ignored elsewhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import fresh, prepare
from larder.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20_250_101
#: Lower bounds of size of the four passes, and hash cells per source in each.
SIZE_BOUNDS = (2048, 256, 32, 0)
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size): adds ``target``.

    Weights repeat in code-point order of the source, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    cap = max_epochs * F.col("source_size")
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    marked = (
        sources.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("level", rest / rest_weight)
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # past the first uncapped source the running rest is too small, so its level is the highest
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(all_rows)
    return marked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select(
        "source", "source_size", "target"
    )


def _cut(part: DataFrame, goals: DataFrame) -> DataFrame:
    """One pass: per source (source, cell, code, cut_id) where its sample ends, and what is still owed."""
    running = Window.partitionBy("source").orderBy("cell")
    cells = (
        part.groupBy("source", "cell")
        .agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
        .withColumn("all_words", F.sum("words").over(Window.partitionBy("source")))
    )
    wanted = F.col("g.fraction") * F.col("c.all_words") + F.col("g.owed")
    reached = (
        cells.alias("c")
        .join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        .select("c.source", "cell", "words", "upto", "all_words", wanted.alias("wanted"))
        .withColumn("goal", F.greatest(F.lit(0.0), F.least(F.col("all_words").cast("double"), "wanted")))
        .filter(F.col("upto") >= F.col("goal"))
        .groupBy("source")
        .agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "goal", "wanted")).alias("at"))
        .select("source", "at.*")
    )
    reached = materialise(reached, "mix-cells")
    within = Window.partitionBy("source").orderBy("code", "doc_id")
    last = (
        part.alias("p")
        .join(reached.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.cell") == F.col("r.cell")))
        .select("p.source", "p.code", "p.doc_id", "p.size", "r.before", "r.goal")
        .withColumn("upto", F.col("before") + F.sum("size").over(within))
        .filter(F.col("upto") - F.col("size") / 2 <= F.col("goal"))
        .groupBy("source")
        .agg(F.max(F.struct("code", "doc_id")).alias("cut"), F.max("upto").alias("took"))
    )
    return reached.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").select(
        "r.source",
        "r.cell",
        F.coalesce("l.cut.code", F.lit(-1)).cast("long").alias("code"),
        F.coalesce("l.cut.doc_id", F.lit(-1)).cast("long").alias("cut_id"),
        (F.col("wanted") - F.coalesce("took", "before")).alias("owed"),
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Size, stratum and seeded place of each document, in new columns after those of ``docs``."""
    size, code = fresh(docs, "mix_size"), fresh(docs, "mix_code")
    stratum = F.when(F.col(size) >= SIZE_BOUNDS[0], 0)
    for number, least in enumerate(SIZE_BOUNDS[1:], 1):
        stratum = stratum.when(F.col(size) >= least, number)
    return docs.withColumns({size: n_words(F.col(text_col)), code: F.xxhash64(F.lit(seed), F.col(id_col).cast("long"))}).select(
        *docs.columns,
        F.struct(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.col(size).alias("size"),
            stratum.alias("stratum"),
            F.pmod(F.shiftright(code, 40), F.lit(CELLS)).cast("int").alias("cell"),
            F.pmod(F.col(code), F.lit(1 << 40)).alias("code"),
        ).alias(fresh(docs, "mix")),
    )


def mix_plan(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and the cuts of the fractional one."""
    targets = materialise(water_fill(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("fraction", ratio - F.floor(ratio))
    goals, cuts = targets.select("source", "fraction", F.lit(0.0).alias("owed")), []
    for stratum in range(len(SIZE_BOUNDS)):
        cut = materialise(_cut(sizes.filter(F.col("stratum") == stratum), goals), "mix-cuts")
        cuts.append(cut.withColumn("stratum", F.lit(stratum)))
        goals = (
            goals.alias("g")
            .join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
            .select("g.source", "g.fraction", F.coalesce("c.owed", "g.owed").alias("owed"))
        )
    per_source = (
        reduce(DataFrame.unionByName, cuts)
        .groupBy("source")
        .agg(F.collect_list(F.struct("stratum", "cell", "code", "cut_id")).alias("cuts"))
    )
    return materialise(
        targets.alias("t")
        .join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")), "left")
        .select("t.source", "source_size", "target", "whole", "cuts"),
        "mix-plan",
    )


def _with_copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weights: tuple[int, ...], share: float, max_epochs: float) -> tuple[DataFrame, str]:
    """``docs`` with a struct of size, source_size, target and copies; and that struct's name."""
    prepare(docs.sparkSession)
    name = fresh(docs, "mix")
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sizes = materialise(_sized(only, "doc_id", "text", "source", seed).select("mix.*"), "mix-sizes")
    plan = mix_plan(sizes, weights, share, max_epochs).select(F.struct("*").alias("plan"))
    m = F.col(f"m.{name}")
    place = F.struct(m["cell"].alias("a"), m["code"].alias("b"), F.coalesce(m["doc_id"], F.lit(-1)).alias("c"))

    def inside(cut: Column) -> Column:
        end = F.struct(cut["cell"].alias("a"), cut["code"].alias("b"), cut["cut_id"].alias("c"))
        return (cut["stratum"] == m["stratum"]) & (place <= end)

    extra = F.when((m["size"] > 0) & F.exists(F.coalesce("plan.cuts", F.array()), inside), 1).otherwise(0)
    copies = F.when(m["size"] > 0, F.col("plan.whole") + extra).otherwise(0).cast("long")
    joined = (
        _sized(docs, id_col, text_col, source_col, seed)
        .alias("m")
        .join(plan, m["source"].eqNullSafe(F.col("plan.source")))
        .select(
            *[F.col(f"m.`{c}`") for c in docs.columns],
            F.struct(
                m["size"].alias("size"),
                F.col("plan.source_size").alias("source_size"),
                F.col("plan.target").alias("target"),
                copies.alias("copies"),
            ).alias(name),
        )
    )
    return joined, name


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    joined, name = _with_copies(only, "doc_id", "text", "source", seed, weights, share, max_epochs)
    return joined.select("doc_id", "source", f"{name}.*").withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with its columns."""
    joined, name = _with_copies(docs, id_col, text_col, source_col, seed, weights, share, max_epochs)
    again = fresh(joined, "copy")
    times = F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies").cast("int")))
    return joined.filter(F.col(f"{name}.copies") > 0).withColumn(again, times).select(*[F.col(f"`{c}`") for c in docs.columns])
