"""Mix sources to target weights, to the exact word.

Every document has a hash-random key. Within its source, documents are sorted by key (range
partitions, so that a source with a third of all rows is spread over many tasks), and prefix sums of
their sizes find the key at which the source's budget is used up: sums per partition first, then the
rows of the one partition per source that holds the cut. What a document gets follows from its own
key and the few numbers of its source, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, table, word_count
from tidewatch.session import configure, settle

MAX_EPOCHS = 3
# Between the last character of a word and the white space after it.
WORD_ENDS = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _key(doc_id: Column, seed: int) -> Column:
    """A uniform 60-bit key; plain MD5, so that SQL elsewhere can repeat the mix."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: int) -> dict[str, Column]:
    return {
        "_size": word_count(docs["text"]),
        "_key": _key(docs["doc_id"], seed),
        "_tie": F.xxhash64(docs["text"]),
    }


def cycled_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, 1, ... for ``source`` in code-point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sources.select("source"), order, "_rank")
    return ranked.select("source", (F.col("_rank") % 3 + 1).cast("double").alias("weight"))


def source_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``source``, ``size``, ``weight``: shares of the sum of all sizes.

    A target stops at ``max_epochs`` times its source's size; what it could not take is shared anew
    by weight among the others. Each round caps every source above its limit, so a few rounds, each
    an aggregate over the table of sources, find the final share per unit of weight.
    """
    share, limit = 0.0, F.lit(float(max_epochs)) * F.col("size")
    while True:
        capped = F.lit(share) * F.col("weight") > limit
        sums = sources.agg(
            F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("all"),
            F.coalesce(F.sum(F.when(capped, limit)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        rest, weight = sums["all"] - sums["capped"], sums["weight"]
        if weight <= 0 or rest / weight <= share:
            break
        share = rest / weight
    # Multiplied before it is divided, as whole numbers allow the same rounding everywhere.
    open_target = F.lit(rest) * F.col("weight") / F.lit(weight if weight > 0 else 1.0)
    target = F.when(F.lit(weight <= 0) | (open_target > limit), limit).otherwise(open_target)
    return sources.withColumn("target", target)


def _cuts(sized: DataFrame, weights: DataFrame | None, seed: int, max_epochs: int) -> DataFrame:
    """Per source: ``source_size``, ``target``, whole ``epochs``, and where the last one is cut."""
    totals = settle(sized.groupBy("source").agg(F.sum("_size").alias("size")))
    weights = cycled_weights(totals) if weights is None else weights
    same = F.col("t.source").eqNullSafe(F.col("w.source"))
    paired = totals.alias("t").join(weights.alias("w"), same, "left")
    weighted = settle(
        paired.select(
            "t.source", "t.size", F.coalesce(F.col("w.weight"), F.lit(0.0)).alias("weight")
        )
    )
    budget = F.round("target").cast("long")
    whole = F.when(F.col("size") > 0, F.floor(budget / F.col("size"))).otherwise(F.lit(0))
    plan = settle(
        source_targets(weighted, max_epochs)
        .withColumn("epochs", whole.cast("long"))
        .withColumn("rest", budget - F.col("epochs") * F.col("size"))
    )

    order = [F.col("source"), F.col("_key"), F.col("_tie")]
    parted = settle(
        sized.where("_size > 0")
        .select("source", "_key", "_tie", "_size")
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = parted.groupBy("source", "_part").agg(F.sum("_size").alias("_sum"))
    running = Window.partitionBy("source").orderBy("_part")
    starts = sums.withColumn("_start", F.sum("_sum").over(running) - F.col("_sum"))
    holding = settle(
        starts.alias("s")
        .join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
        .where("rest > 0 and _start < rest and rest <= _start + _sum")
        .select("s.source", "_part", (F.col("rest") - F.col("_start")).alias("_rest"))
    )
    near = parted.alias("r").join(
        holding.alias("h"),
        F.col("r.source").eqNullSafe(F.col("h.source")) & (F.col("r._part") == F.col("h._part")),
    )
    ties = near.groupBy("r.source", "r._part", "_rest", "_key", "_tie").agg(
        F.sum("_size").alias("_sum"), F.count("*").alias("_copies")
    )
    inside = Window.partitionBy("source", "_part").orderBy("_key", "_tie")
    cut = (
        ties.withColumn("_before", F.sum("_sum").over(inside) - F.col("_sum"))
        .where("_before < _rest and _rest <= _before + _sum")
        .select(
            F.col("source").alias("_source"),
            F.struct("_key", "_tie").alias("_cut"),
            F.floor((F.col("_rest") - F.col("_before")) / F.col("_copies")).alias("_last"),
        )
    )
    joined = plan.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    return settle(
        joined.select(
            F.col("source").alias("_source"), F.col("size").alias("source_size"), "target",
            "epochs", "_cut", "_last",
        )
    )


def _taken() -> Column:
    """Words that a row gets, from its own key and its source's numbers."""
    here = F.struct("_key", "_tie")
    extra = F.when(here < F.col("_cut"), F.col("_size")).when(here == F.col("_cut"), F.col("_last"))
    return (F.col("epochs") * F.col("_size") + F.coalesce(extra, F.lit(0))).cast("long")


def mix_plan(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are ignored. ``weights`` has
    ``source`` and ``weight`` (a source it lacks weighs 0); without it, weights are 1, 2, 3, 1, ...
    Returns ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``: whole epochs of the source,
    then documents in key order until its budget, ``target`` rounded, is used up; the document at
    the cut is taken in part. Null texts and texts without words have size 0 and take nothing; a
    null source is a source. Rows that agree in id, source and text have the same key; if the cut
    falls among them they share what is left equally, rounded down. No rows give no rows.
    """
    sized = settle(
        docs.select("doc_id", "source", *(c.alias(n) for n, c in _sized(docs, seed).items()))
    )
    cuts = _cuts(sized, weights, seed, max_epochs)
    rows = sized.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", _taken().alias("taken")
    )


def mix_documents(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 7, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per epoch of a document.

    See ``mix_plan``. A document at the cut comes once more with its first words only, ending after
    the last word that the budget allows. The texts stay where they are: only the numbers of the
    sources are joined to them.
    """
    columns = docs.columns
    derived = _sized(docs, seed)
    sized = settle(docs.select("source", *(c.alias(n) for n, c in derived.items())))
    cuts = _cuts(sized, weights, seed, max_epochs)
    rows = docs.withColumns(derived).join(cuts, docs["source"].eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_taken", _taken()).where("_taken > 0")
    copies = F.expr("sequence(0L, (_taken - 1) div _size)")
    rows = rows.withColumn("_copy", F.explode(copies))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size"))
    rows = rows.withColumn("_words", words.cast("int"))
    pieces = F.split("text", WORD_ENDS)
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("_words")), "")
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(head)
    return rows.withColumn("text", text).select(*columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return mix_plan(table(spark, sf_dir, "documents"))
