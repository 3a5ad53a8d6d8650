"""Mixing sources to target weights.

Tokens (words) are aggregated per source; sources get targets by weight, no source
above ``max_repeat`` times its size; each document is then emitted floor(rate) times,
and once more if a hash-seeded Bernoulli draw with the fraction as its probability
says so. rate = target / source size.

Defined cases: a null or empty text has size 0 and is emitted by the same rule; null
sources form one source of their own, ordered last; a null doc_id draws by the hash of
its text; repeated rows draw alike; an empty table gives an empty table; a source of
size 0 has target 0 and rate 0. Extra columns pass through ``mix_documents`` untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.rows import packed_rows
from cadenza.session import materialize, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Digits of the hash used for a draw: 48 bits, exact in a double.
DRAW_HEX, DRAW_SPAN = 12, float(16**12)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """Uniform in [0, 1), by the document alone: reruns and lost executors don't change it."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")), 1, DRAW_HEX), 16, 10).cast("double") / DRAW_SPAN


def source_ranks(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without one task that sorts all of them.

    Range partitions are sorted on their own; only the row count of each partition
    (a few numbers, not a row per source) makes the offsets.
    """
    spread = (
        sources.withColumn("__mix_null", F.col("source").isNull())
        .repartitionByRange(F.col("__mix_null"), F.col("source"))
        .withColumn("__mix_part", F.spark_partition_id())
    )
    spread = materialize(spread, "mix-sources")
    before = Window.orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("__mix_part").agg(F.count("*").alias("n")).select("__mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_before"))
    inside = Window.partitionBy("__mix_part").orderBy("__mix_null", "source")
    return (
        spread.join(F.broadcast(offsets), "__mix_part")  # a row per shuffle partition
        .withColumn("source_rank", F.col("__mix_before") + F.row_number().over(inside) - 1)
        .drop("__mix_part", "__mix_before", "__mix_null")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """sizes (source, size) -> (source, source_size, weight, target).

    The weights repeat over the sources' order. Targets share the total size by weight;
    those above ``max_repeat`` times their source's size stop there and the excess is
    reshared, round by round, until none is above. Each round is one aggregate that
    sends four numbers to the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(source_ranks(totals).withColumn("weight", pick.cast("long")), "mix-ranked")
    cap = F.col("source_size") * F.lit(max_repeat)
    spare, share = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    spare, share, capped = int(spare or 0), int(share or 0), 0
    total, weight_sum = spare, share
    while share:
        over = F.lit(spare).cast("double") * F.col("weight") / F.lit(share).cast("double") > cap
        n, size, weight = ranked.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(over, F.col("weight")))).first()
        if n == capped:
            break
        capped, spare, share = n, total - int(size), weight_sum - int(weight)
    fair = F.lit(spare).cast("double") * F.col("weight") / F.lit(float(max(share, 1)))
    return ranked.select("source", "source_size", "weight", F.least(fair, cap.cast("double")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, copies, taken."""
    rows = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u")), "mix-rows"
    )
    targets = source_targets(rows.select("source", "size"), weights, max_repeat)
    return _decide(rows, targets).select("doc_id", "size", "source_size", "target", F.col("__mix_copies").alias("copies"), (F.col("size") * F.col("__mix_copies")).alias("taken"))


def _decide(rows: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select(F.col("source").alias("__mix_source"), "source_size", "target")
    t = small_side(materialize(t, "mix-targets"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("long")
    return rows.join(t, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_copies", copies.cast("long")).drop("__mix_source")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as its copies, columns unchanged."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sizes, weights, max_repeat).select(
        F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_total"), F.col("target").alias("__mix_target")
    )
    t = small_side(materialize(targets, "mix-targets"))
    rate = F.when(F.col("__mix_total") > 0, F.col("__mix_target") / F.col("__mix_total")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    rows = packed_rows(docs, "doc_id", "source", "text")
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_copies", copies)
    return joined.withColumn("__mix_i", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies")))).select("row.*")
