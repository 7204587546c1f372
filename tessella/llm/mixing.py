"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words, and may be repeated at most
`max_epochs` times. A budget of words is shared by weight; sources whose share
is above their cap are clamped to it and what is left is shared again among the
others, until no share is above its cap. Each source is then sampled to its
target: its documents are taken a whole number of times each, and the rest of the
target is filled with further repetitions in a seeded order, the last of which
takes only the first words of its document.

The order is a keyed hash of the document id, cut into 4,096 buckets, so a source
that holds most rows is spread over tasks; only the bucket in which a source's
rest ends is ordered row by row.

Defined cases: NULL text has size 0 and is never repeated; a NULL source is a
source of its own and comes last; a source without words has target 0; rows
with equal ids are ordered by size and content, equal rows are interchangeable;
an empty table gives an empty result. Extra columns stay in `repeat` and are
ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
BUCKET_BITS = 12
"""Leading bits of the order that name a bucket, so that buckets are ordered alike."""
SEED = 7
SMALL_PLAN = 10_000
"""Sources up to which their plan, a row each, is broadcast."""


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weigh(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds `weight` by a source's place in code point order, NULL last. Places are
    numbered per range partition and shifted by the partitions before, of which
    there are as many as shuffle partitions."""
    placed = cut(sources.repartitionByRange(F.col("source").asc_nulls_last())
                 .sortWithinPartitions(F.col("source").asc_nulls_last())
                 .withColumn("_at", F.monotonically_increasing_id())
                 .withColumn("_part", F.shiftright("_at", 33)))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")) % len(weights)
    return placed.join(before, "_part").select(
        *sources.columns, F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to (source, size, weight). A round is one aggregate; every
    round but the last clamps a source, and all whose share is above their cap
    at once."""
    cap = F.col("size") * F.lit(max_epochs)
    budget = (sources.agg(F.sum("size")).first()[0] or 0) * share
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        full, free = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        if not free:
            level = float("inf")
            break
        rising = (budget - (full or 0.0)) / free
        if level is not None and rising <= level:
            break
        level = rising
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap)


def _order(seed: int, doc_id: Column, size: Column, tie: Column) -> Column:
    """Where a document comes in the seeded order; rows equal in it are interchangeable."""
    return F.struct(F.xxhash64(F.lit(seed), doc_id).alias("h"), doc_id.alias("id"), size.alias("size"), tie.alias("tie"))


def plan(slim: DataFrame, seed: int, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
         weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row per source: (source, source_size, target, whole, rest, cut, each): every
    document is taken `whole` times, those before `cut` in the seeded order once
    more, and those equal to it for their first `each` words. slim: (doc_id, source,
    size, tie)."""
    sizes = slim.groupBy("source").agg(F.sum("size").alias("size"))
    filled = water_fill(cut(weigh(sizes, weights)), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(filled.select("source", F.col("size").alias("source_size"), "target")
                  .withColumn("whole", epochs)
                  .withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")))
    named = targets.select(F.col("source").alias("_source"), "rest")
    rows = slim.withColumn("_at", _order(seed, F.col("doc_id"), F.col("size"), F.col("tie"))).withColumn(
        "_bucket", F.shiftright("_at.h", 64 - BUCKET_BITS))
    by_bucket = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
            .withColumn("_before", F.coalesce(F.sum("_words").over(by_bucket), F.lit(0)))
            .join(named, F.col("source").eqNullSafe(F.col("_source")))
            .where((F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_words") > F.col("rest")))
            .select("_source", F.col("_bucket").alias("_b"), (F.col("rest") - F.col("_before")).alias("_left")))
    ahead = Window.partitionBy("source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (rows.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
            .groupBy("source", "_at", "_left").agg(F.count("*").alias("_k"))
            .withColumn("_words", F.col("_k") * F.col("_at.size"))
            .withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
            .where((F.col("_ahead") <= F.col("_left")) & (F.col("_ahead") + F.col("_words") > F.col("_left")))
            .select(F.col("source").alias("_source"), F.col("_at").alias("cut"),
                    F.floor((F.col("_left") - F.col("_ahead")) / F.col("_k")).cast("long").alias("each")))
    return cut(targets.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def planned(rows: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, size, tie and others) with _plan, the row of their source,
    and part, the words of the last, partial repetition. A document is found by its
    place in the order, so only the plan is sent around: broadcast when counted to be
    small, else joined."""
    sources = plans.select(F.struct(*plans.columns).alias("_plan"))
    if plans.count() <= SMALL_PLAN:
        sources = F.broadcast(sources)
    at = _order(seed, F.col("doc_id"), F.col("size"), F.col("tie"))
    part = (F.when(F.col("_plan.rest") >= F.col("_plan.source_size"), F.col("size"))
            .when(F.col("_plan.cut").isNull(), F.lit(0)).when(at < F.col("_plan.cut"), F.col("size"))
            .when(at == F.col("_plan.cut"), F.col("_plan.each")).otherwise(0))
    return rows.join(sources, F.col("source").eqNullSafe(F.col("_plan.source"))).withColumn("part", part.cast("long"))


def slim_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    return cut(docs.select("doc_id", "source", n_words(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("tie")))


def mix(docs: DataFrame, text: str = "text", seed: int = SEED, share: float = SHARE,
        max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, whole, part): a document is taken
    `whole` times and then for its first `part` words."""
    slim = slim_rows(docs, text)
    plans = plan(slim, seed, share, max_epochs, weights)
    return planned(slim, plans, seed).select(
        "doc_id", "source", "size", "_plan.source_size", "_plan.target", "_plan.whole", "part")


def repeat(docs: DataFrame, text: str = "text", seed: int = SEED, share: float = SHARE,
           max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: docs with every row as often as it is taken; the row of a
    partial repetition holds the first words of its text."""
    plans = plan(slim_rows(docs, text), seed, share, max_epochs, weights)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "doc_id", "source",
                       n_words(docs[text]).alias("size"), F.xxhash64(docs[text]).alias("tie"))
    takes = F.concat(F.array_repeat(F.col("size"), F.when(F.col("size") > 0, F.col("_plan.whole")).otherwise(0).cast("int")),
                     F.when(F.col("part") > 0, F.array("part")).otherwise(F.expr("cast(array() as array<bigint>)")))
    rows = planned(rows, plans, seed).select("_doc", "size", F.explode(takes).alias("_take"))
    own = F.col("_doc").getField(text)
    first = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1,
                                 F.col("_take").cast("int")), "")
    return rows.select(*[(F.when(F.col("_take") < F.col("size"), first).otherwise(own) if c == text
                          else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def report(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source)."""
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "source")
