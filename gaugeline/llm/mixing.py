"""Mixing sources to target weights with distributed prefix sums; DataFrame functions only.

Every row gets a hash-random key: the first KEY_BITS of an MD5.  Inside a source, rows are ordered by that key.  The key's high bits cut each source
into slots; as the keys are uniform, a slot holds about SLOT_ROWS rows however large its source is, so a source with a
third of all rows is as parallel as the others.  A row's prefix sum is the sum of the earlier slots of its source (one
row per slot) plus the running sum inside its slot.  A source's budget is its target: whole epochs while it lasts,
then the rows up to the exact cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import cut

#: Fixed values of the contract: weights of the sources in code point order, repeating; most epochs of a source.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of one slot, about; slots are powers of two.
SLOT_ROWS = 16_384
MAX_SLOT_BITS = 30
KEY_BITS = 60


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def random_key(id_: Column, text: Column, seed: int) -> Column:
    """A key that hangs on the id, the text and the seed only, uniform over KEY_BITS bits."""
    none = F.lit("")
    said = F.concat_ws("|", F.coalesce(id_.cast("string"), none), F.lit(str(seed)), F.md5(F.coalesce(text, none).cast("binary")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row per source.

    The targets are ``min(max_epochs * size, level * weight)`` with the level at which they sum up to all sizes: what
    resharing the excess by weight, again and again, comes to.  Sources fill up in the order of size over weight, so
    the level follows from running sums.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    most = (F.col("source_size") * F.lit(max_epochs)).cast("double")
    by_fill = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_fill.rowsBetween(W.unboundedPreceding, 0)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = (sizes.withColumn("weight", weight).withColumn("most", most)
              .withColumn("total", F.sum("source_size").over(every).cast("double"))
              .withColumn("full", F.sum("most").over(so_far) - F.col("most"))
              .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(so_far) + F.col("weight"))
              # the level if all sources before this one are full and the others are not
              .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
              .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most")))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"]
    return (filled.withColumn("at", level)
            .select("source", "source_size", F.least("most", F.coalesce(F.col("at") * F.col("weight"), "most")).alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``id, source, size, source_size, target, taken`` per row: words of the row that the mix takes, repeats counted.

    Each source's ``taken`` sums up to its target, rounded; the row at the cut is taken in part.  Defined cases: a NULL
    or word-less text has size 0 and nothing is taken of it; a NULL source is a source of its own, last in order; rows
    that repeat an id are rows of their own, and fully equal rows may swap their shares; rows with a NULL id are mixed
    like others; an empty table gives no rows; further columns are ignored.  The order hangs on the id, the text and the
    seed only, so reruns agree.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = cut(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                           n_words(text).alias("size"), random_key(F.col(f"`{id_col}`").cast("long"), text, seed).alias("key")), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals.select("source", "source_size"), weights, max_epochs)
    # one row per source
    plan = cut(targets.join(totals.select(F.col("source").alias("name"), "n"), F.expr("source <=> name")).select(
        "source", "source_size", "target",
        F.round("target").cast("long").alias("budget"),
        F.least(F.greatest(F.ceil(F.log2(F.col("n") / slot_rows)), F.lit(0)), F.lit(MAX_SLOT_BITS)).cast("int").alias("bits")), "plan")
    named = plan.select(F.col("source").alias("name"), "source_size", "target", "budget", "bits")
    keyed = (rows.join(named, F.expr("source <=> name")).drop("name")
             .withColumn("slot", F.expr(f"shiftright(key, {KEY_BITS} - bits)")))
    slots = keyed.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    before = (slots.withColumn("before", F.sum("words").over(W.partitionBy("source").orderBy("slot")
                                                              .rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
              .select(F.col("source").alias("name"), F.col("slot").alias("at"), "before"))
    inside = W.partitionBy("source", "slot").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (keyed.withColumn("upto", F.sum("size").over(inside))
              .join(before, F.expr("source <=> name and slot = at"))
              .withColumn("start", F.col("before") + F.col("upto") - F.col("size")))
    epochs = F.expr("budget div greatest(source_size, 1L)")
    rest = F.col("budget") - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select("id", "source", "size", "source_size", "target",
                         (epochs * F.col("size") + last).cast("long").alias("taken"))
