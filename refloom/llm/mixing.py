"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed (shuffled) order, repeated
for up to ``max_epochs`` epochs.  A document copy carries the virtual finish
time *cumulative source words / target of the source*; all copies sorted by
finish time are the mix, cut off when the total budget is used up.  Because the
targets add up to the budget, the budget is used up at virtual time 1: at any time t
the queues have served t x target words each, so the running sum of the sorted
copies reaches the budget there.  The document that a source is serving at that
instant is cut at the words served, so every source ends within a word of its target.

Cumulative sums never run over a whole source in one task: rows fall into
hash-range buckets, about sqrt(rows) per source; bucket totals are cumulated
first (sqrt(rows) numbers per source) and then the rows inside each bucket.

Source totals, weights and targets are windows over sources, of which there are some
dozens to thousands; nothing else stands in one task.

Defined cases: null text has size 0; texts of any length are counted whole; null
source is a source of its own, sorted last; null ids are allowed, and spread by their
texts as repeated ids do; repeated rows are separate documents; ties in the order go
by place, id and text; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.durable import durable
from refloom.llm.text import count_spaced


def source_targets(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, budget: float | None = None) -> DataFrame:
    """One row per source with its words and its target.

    ``rows`` has src, src_null and size.  Weights go round the sources in code
    point order.  A target stops at ``max_epochs`` times the source; what is cut
    goes to the others by weight.  With sources ordered by cap / weight, the
    water level is the largest (budget - caps before) / (weights left).
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy("src_null", "src")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everything).cast("double")
    return (
        rows.groupBy("src_null", "src")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(turn, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("budget", total)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        .withColumn("level", F.max((F.col("budget") - F.col("caps_before")) / F.col("weights_left")).over(everything))
        .select("src_null", "src", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    budget: float | None = None,
    seed: int = 20240229,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix, one row per document, in the order of virtual finish times.

    Returns id, source, size, source_size, target, taken (words, repeats
    counted), copies (array of epoch, finish, words) and first_finish.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("src_null"),
        count_spaced(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(source_col), F.col(text_col)).alias("place"),
        F.xxhash64(F.col(text_col)).alias("content"),
    )
    rows = durable(rows, "mix-rows")
    bits = max(1, math.ceil(math.log2(rows.count() + 2) / 2))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits))
    key = ["src_null", "src"]
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*key, "bucket")
        .agg(F.sum("size").alias("words"))
        .select(*key, "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy(*key, "bucket").orderBy("place", "id", "content").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        rows.withColumn("within", F.sum("size").over(inside))
        .join(starts, [*key, "bucket"])
        .join(source_targets(rows, weights, max_epochs, budget), key)
        .withColumn("end", F.col("offset") + F.col("within"))
    )
    line = F.floor("target").cast("long")

    def copy(epoch):
        end = F.col("end") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), line - (end - F.col("size"))))
        return F.struct(epoch.alias("epoch"), F.try_divide(end.cast("double"), F.col("target")).alias("finish"), words.alias("words"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), copy), lambda c: c["words"] > 0)
    return (
        queued.withColumn("copies", copies)
        .select(
            F.col("id").alias(id_col),
            F.when(~F.col("src_null"), F.col("src")).alias(source_col),
            "size",
            "source_size",
            "target",
            F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]).alias("taken"),
            "copies",
            F.coalesce(F.try_element_at("copies", F.lit(1))["finish"], F.try_divide(F.col("end").cast("double"), F.col("target"))).alias("first_finish"),
            "content",
        )
        .orderBy("first_finish", id_col)
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Every copy of the mix as a row, range-sorted by its virtual finish time."""
    return mixed.select("*", F.inline("copies")).drop("copies").orderBy("finish", "epoch")
