"""Mixing sources to target weights by Sainte-Laguë apportionment.

Every source is a set of shards (documents by hash), every shard a stream of words in seeded
document order, cut into blocks of equal word counts.  The mix holds a whole number of blocks.
They go to sources, within a source to groups of GROUP_SHARDS shards and within a group to its shards, by highest
quotients ``weight / (2 * seats + 1)``.  A shard's quota of words is taken in whole passes over the shard as long as they
fit, and a seeded selection of its blocks makes up the rest.

Everything is DataFrame code; the words a document gives follow from two prefix counts, so no
block is ever a row.  Texts are counted once, into a written table of numbers.  A task apportions one group of shards, or one
source's groups; sources pass through a single sorted task (a row for each distinct source).

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null
or repeated doc_ids are separate rows; an empty table gives an empty result; columns that clash with
the working names are unaffected, since working columns are prefixed ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import WORD, small, word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 19
GROUP_SHARDS = 4096
SEED = 20_240_229


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target words of each source.  sizes: ``__source, __source_size``, a row for each source.

    A target over max_repeats times its source stops there and the excess is reshared by weight.
    In order of ``cap / weight`` that fixed point has a closed form: a source is capped as long as an
    equal share of what earlier ones leave reaches its cap.
    """
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    ranked = sizes.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("__source_size") * max_repeats
    filled = Window.orderBy(cap.cast("double") / F.col("__weight"), F.col("__source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.withColumns(
        {
            "__left": F.sum("__source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "__open": F.sum("__weight").over(after),
            "__cap": cap,
        }
    )
    level = F.col("__left").cast("double") * F.col("__weight") / F.col("__open")
    marked = left.withColumn("__capped", F.col("__cap") <= level)
    # The level of the first source that is not capped holds for all that follow.
    first = F.min(F.when(~F.col("__capped"), F.struct(cap.cast("double") / F.col("__weight"), F.col("__source").isNull(), F.col("__source"), F.col("__left"), F.col("__open")))).over(all_rows)
    target = F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(first["__left"].cast("double") * F.col("__weight") / first["__open"])
    return marked.withColumn("__target", target).select("__source", "__source_size", "__target")


def apportion(items: DataFrame, group: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: give each group's ``seats`` to its items by the highest quotients weight / (2k + 1).

    Rounding ``weight * seats / total`` is the same method for a house of nearly that size; the few
    seats missing or left over then follow the quotients one by one.
    """
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    share = F.col(weight) / F.col("__total")
    base = (
        items.withColumns({"__total": F.sum(weight).over(whole), "__n": F.count(F.lit(1)).over(whole)})
        .withColumn("__seats0", F.when(F.col("__total") > 0, F.floor(F.col(seats) * share + 0.5)).otherwise(0).cast("long"))
        .withColumn("__short", F.when(F.col("__total") > 0, F.col(seats)).otherwise(0) - F.sum("__seats0").over(whole))
    )
    # No item gains or loses more than its share of the number of items, and two.
    reach = F.least(F.ceil(share * F.col("__n")).cast("long") + 2, F.abs("__short"))
    steps = F.when((F.col("__short") == 0) | (F.col(weight) <= 0), F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(reach, F.lit(1))))
    keys = [c for c in items.columns if c not in (weight, seats)]
    step = base.select("*", F.explode(steps).alias("__step")).withColumn(
        "__quotient",
        F.when(F.col("__short") > 0, F.col(weight) / (2 * (F.col("__seats0") + F.col("__step")) - 1)).otherwise(
            # what would be given up first has the smallest quotient
            -F.col(weight) / (2 * (F.col("__seats0") - F.col("__step")) + 1)
        ),
    )
    step = step.where((F.col("__short") > 0) | (F.col("__step") <= F.col("__seats0")))
    by = Window.partitionBy(*(group or [F.lit(0)])).orderBy(
        F.col("__quotient").desc(),
        # of equal quotients the first item has the seat, so the last gives one up
        *[F.when(F.col("__short") > 0, F.col(k)).asc_nulls_last() for k in keys],
        *[F.when(F.col("__short") < 0, F.col(k)).desc_nulls_first() for k in keys],
    )
    changed = step.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= F.abs("__short"))
    moved = changed.groupBy(*keys).agg(F.sum(F.signum("__short")).cast("long").alias("__moved"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return (
        base.alias("a")
        .join(moved.alias("b"), on, "left")
        .select(*[F.col(f"a.{c}").alias(c) for c in items.columns], (F.col("a.__seats0") + F.coalesce(F.col("b.__moved"), F.lit(0))).alias(out))
    )


def _chosen_before(block: Column) -> Column:
    """How many of a shard's extra blocks stand before this one: every (n / extra)th from a seeded start."""
    return F.floor((block * F.col("__extra") + F.col("__start")) / F.greatest(F.col("__blocks"), F.lit(1))).cast("long")


def _words_before(at: Column, block_words: int) -> Column:
    block = F.floor(at / block_words).cast("long")
    return block_words * _chosen_before(block) + (at % block_words) * (_chosen_before(block + 1) - _chosen_before(block))


def plan(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    group_shards: int = GROUP_SHARDS,
    seed: int = SEED,
    carry: bool = False,
) -> DataFrame:
    """docs (``doc_id, text, source``; with carry all their columns) and ``__size, __source_size, __target,
    __passes, __extra, __blocks, __start, __at`` (words before it in its shard) and ``__taken``."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")).alias("__order")
    measured = [F.col("source").alias("__source"), word_count(F.col("text")).alias("__size"), order]
    counted = written(docs.sparkSession, docs.select("doc_id", *measured), "sizes")
    rows = docs.select(*docs.columns, *measured) if carry else counted
    sizes = counted.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    total = Window.partitionBy(F.lit(0))
    targets = source_targets(sizes, weights, max_repeats).withColumn("__house", F.round(F.sum("__source_size").over(total) / block_words).cast("long"))
    seats = apportion(targets, [], "__target", "__house", "__quota")
    shard_count = F.greatest(F.ceil(F.col("__source_size") / shard_words), F.lit(1)).cast("long")
    spread = seats.select(F.col("__source").alias("__s"), "__source_size", "__target", "__quota", shard_count.alias("__shards"))
    spread = small(spread)

    def in_shards(df: DataFrame) -> DataFrame:
        found = df.join(spread, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
        return found.withColumn("__shard", F.pmod(F.col("__order"), F.col("__shards")))

    placed = in_shards(rows)
    group = F.floor(F.col("__shard") / group_shards).cast("long").alias("__group")
    shards = in_shards(counted).groupBy("__source", "__shard", "__quota", group).agg(F.sum("__size").alias("__shard_size"))
    shards = written(docs.sparkSession, shards, "shards")
    groups = shards.groupBy("__source", "__group", "__quota").agg(F.sum("__shard_size").alias("__group_size"))
    of_group = apportion(groups, ["__source"], "__group_size", "__quota", "__seats").select(F.col("__source").alias("__s"), F.col("__group").alias("__g"), "__seats")
    here = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__group") == F.col("__g"))
    seated = shards.join(of_group, here).select("__source", "__group", "__shard", "__shard_size", "__seats")
    quotas = apportion(seated, ["__source", "__group"], "__shard_size", "__seats", "__given")
    size = F.col("__shard_size")
    quotas = (
        quotas.where(size > 0)
        .withColumn("__blocks", F.ceil(size / block_words).cast("long"))
        .withColumn("__words", F.least(F.col("__given") * block_words, max_repeats * size))
        .withColumn("__passes", F.floor(F.col("__words") / size).cast("long"))
        # a last block that is not full counts for what it has
        .withColumn("__extra", F.least(F.round((F.col("__words") - F.col("__passes") * size) / block_words), F.col("__blocks")).cast("long"))
        .select(
            F.col("__source").alias("__s"),
            F.col("__shard").alias("__h"),
            "__blocks",
            "__passes",
            "__extra",
            F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__source"), F.col("__shard")), F.col("__blocks")).alias("__start"),
        )
    )
    stream = Window.partitionBy("__source", "__shard").orderBy("__order", F.col("doc_id").asc_nulls_last())
    placed = placed.withColumn("__at", F.sum("__size").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size"))
    joined = placed.join(small(quotas), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__shard") == F.col("__h")), "left").drop("__s", "__h")
    joined = joined.fillna(0, ["__blocks", "__passes", "__extra", "__start"])  # a shard without a word gives none
    extra = _words_before(F.col("__at") + F.col("__size"), block_words) - _words_before(F.col("__at"), block_words)
    return joined.withColumn("__taken", F.col("__passes") * F.col("__size") + extra)


def op7_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return plan(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole pass over a document and one more, whose
    text is the document's words that lie in selected blocks, white space before each word kept."""
    rows = plan(docs, block_words=block_words, carry=True, **options)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    block = lambda i: F.floor((F.col("__at") + i) / block_words).cast("long")
    part = F.array_join(F.filter(pieces, lambda _, i: _chosen_before(block(i) + 1) > _chosen_before(block(i))), "")
    rest = F.col("__taken") - F.col("__passes") * F.col("__size")
    whole = F.array_repeat(F.col("text"), F.col("__passes").cast("int"))
    texts = F.concat(whole, F.when(rest == F.col("__size"), F.array("text")).when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.where(F.col("__taken") > 0).select("*", F.explode(texts).alias("__mixed"))
    changed = {"text": F.col("__mixed")} | ({"n_chars": F.length("__mixed").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(changed).select(*docs.columns)
