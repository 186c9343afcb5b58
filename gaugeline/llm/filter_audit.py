"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Method.  Every document becomes one small mask of the filters that it fails.  Documents are counted per cell (part, mask);
a part has at most 32 cells, however many documents it holds.  Each cell then folds its mask across the constant array of all
orders (``transform`` over the orders, ``aggregate`` over an order's steps): 600 structs, weighted with the cell's counts.
The cells of a part are merged by elementwise sums (``aggregate`` with ``zip_with``).  Texts are read once and never shuffled:
only ids, masks and digests are.  Exact copies are decided without a join on the text: of each digest the smallest
id passes, which is a minimum that is aggregated before the shuffle, so a group of copies of any size costs one row a task.

Everything is a DataFrame expression; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeline.llm.common import cut

#: The filters by letter, in the order of their bits in a mask; E (copies) needs the whole table.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"

_COPY = 1 << FILTERS.index("E")
_SUMS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def orders() -> list[str]:
    """All 120 orders of the filters, in lexicographic order."""
    return ["".join(p) for p in permutations(FILTERS)]


def _failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails a filter by itself."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    return {"A": counts["n"] < MIN_WORDS, "B": 100 * counts["d"] < DISTINCT_PERCENT * counts["n"],
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text), "D": text.rlike(MARKS)}


def _bits(failed: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failed.items()])


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id, part, good, toxic, mask, digest`` per document; the mask holds every filter but E."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       _bits(_failures(text)).cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
             .where("of is not null").groupBy("of").agg(said("q").alias("good"), said("t").alias("bad")))
    return (rows.join(marks, F.col("id") == F.col("of"), "left")
            .select("id", "part", "mask", "digest", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("toxic")))


def cells(rows: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents per part and full mask.

    A document passes E if no smaller id has its text.  Rows are first counted by (digest, id, ...), then every combination of
    a digest keeps its smallest id, and the combinations of a digest (at most 4 times the parts) are compared with each
    other: what is at the digest's smallest id passes, all others fail.
    """
    kind = ["part", "mask", "good", "toxic"]
    total = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    # a NULL id is no smaller than any other and has none smaller than itself
    unnamed = rows.where("id is null").groupBy(*kind).agg(F.count("*").alias("n"))
    same = rows.where("id is not null").groupBy("digest", "id", *kind).agg(F.count("*").alias("n"))
    least = same.groupBy("digest", *kind).agg(F.min(F.struct("id", "n")).alias("first"))
    one = F.collect_list(F.struct(*kind, "first"))
    passing = (least.groupBy("digest").agg(one.alias("all"), F.min("first.id").alias("id"))
               .select(F.explode(F.filter("all", lambda x: x["first"]["id"] == F.col("id"))).alias("x"))
               .groupBy(*[F.col(f"x.{c}").alias(c) for c in kind]).agg(F.sum("x.first.n").alias("n")))
    first = passing.unionAll(unnamed)
    copies = first.withColumn("n", -F.col("n")).unionAll(total).withColumn("mask", F.col("mask") + _COPY)
    every = first.unionAll(copies).groupBy(*kind).agg(F.sum("n").alias("n")).where("n > 0")
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                                             F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _fold(order: Column) -> Column:
    """The six sums of one cell at each of an order's steps."""
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        hit = state["alive"] & fails
        take = lambda on, what: F.when(on, F.col(what)).otherwise(none)
        sums = F.struct(take(state["alive"] & ~fails, "n").alias("kept"), take(hit, "n").alias("removed"), take(~state["alive"] & fails, "n").alias("redundant"),
                        take(F.col("mask") == bit, "n").alias("unique_fails"), take(hit, "good").alias("good_lost"), take(hit, "toxic").alias("toxic_lost"))
        return F.struct((state["alive"] & ~fails).alias("alive"), F.concat(state["out"], F.array(sums)).alias("out"))

    kind = "array<struct<" + ",".join(f"{c}:bigint" for c in _SUMS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("out"))
    return F.aggregate(order, start, step, lambda s: s["out"])


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in _SUMS]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: 600 rows per part.

    Defined cases: a NULL text is empty (it fails A, and E from the second such document on); a NULL part is the empty string
    and joins that part; a NULL id neither has nor is a smaller id; rows that repeat an id are documents of their
    own, and those of equal text at its smallest id all pass E; a document is good or toxic if any label row of its id says
    so; a very long text is read whole, in one row; no documents give no rows; further columns are ignored.
    """
    names = orders()
    rule = F.lit([[1 << FILTERS.index(f) for f in o] for o in names])
    counted = cut(cells(cut(masked(docs, labels, id_col, text_col, part_col), "masks")), "cells")
    folded = counted.select("part", F.flatten(F.transform(rule, _fold)).alias("sums"))
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in _SUMS]), len(names) * len(FILTERS))
    merged = folded.groupBy("part").agg(F.aggregate(F.collect_list("sums"), zeros, _added).alias("sums"))
    size, at = len(FILTERS), F.lit("".join(names))
    step = F.col("pos") % size
    rows = merged.select("part", F.posexplode("sums").alias("pos", "s"))
    rows = rows.select("part", F.substring(at, F.col("pos") - step + 1, F.lit(size)).alias("filter_order"), (step + 1).cast("int").alias("step"),
                       F.substring(at, F.col("pos") + 1, F.lit(1)).alias("own"), *[F.col(f"s.{c}").alias(c) for c in _SUMS])
    # a filter has one row in each of a part's 120 orders
    shapley = F.sum("removed").over(W.partitionBy("part", "own"))
    return rows.withColumn("shapley", shapley).drop("own")
