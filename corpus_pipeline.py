"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``; all but the last return the columns of ``docs``.  NULL, empty and repeated rows, empty tables and further
columns are handled as each operator states; rows with a NULL doc_id pass the filters that can't name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import common
from gaugeline.llm.decontaminate import contaminated
from gaugeline.llm.minhash_dedup import near_duplicates
from gaugeline.llm.mixing import mix
from gaugeline.llm.secrets import find_secrets, redact
from gaugeline.llm.toxicity import THRESHOLD, fit_toxicity, score_column


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, doesn't call toxic."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(score_column(model, F.col("text"))["p_toxic"] < THRESHOLD)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number of its own for each row: of its file and its place there, so that it is the same whenever
    the files are read again.  Rows that come from no files are written first."""
    if not docs.inputFiles():
        docs = common.cut(docs, "rows")
    # the driver lists the files of a scan anyway
    files = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    table = docs.sparkSession.createDataFrame(list(enumerate(files)), f"`{key}_file` long, `{key}_path` string")
    number = (F.shiftleft(F.col(f"{key}_file"), 40) + F.col("_metadata.row_index")).alias(key)
    return docs.join(table, F.col("_metadata.file_path") == F.col(f"{key}_path")).select(*[F.col(f"`{c}`") for c in docs.columns], number)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group (five-word shingles, similarity 0.8): one with the smallest id.  Rows are compared one by one,
    so an id that repeats with different texts keeps each that no other row has; of equal rows without words one stays;
    rows without an id stay.  Texts are not copied: only the numbers of the rows that go, the shorter list, meet them."""
    key = _fresh(docs, "kept_id")
    rows = _numbered(docs, key)
    named = rows.where("doc_id is not null")
    groups = near_duplicates(named.select(key, "text"), id_col=key).select(F.col("id").alias("rid"), "component_id", (F.col("n_shingles") == 0).alias("bare"))
    own = named.select(F.col(key).alias("rid"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("digest"), F.col("text").isNull().alias("none"))
    bare = lambda c: F.when(F.col("bare"), F.col(c))
    tagged = common.cut(groups.join(own, "rid").select("rid", "doc", "digest", F.when(~F.col("bare"), F.col("component_id")).alias("g"), bare("doc").alias("d"),
                                                       bare("digest").alias("x"), bare("none").alias("y")), "groups")
    best = tagged.groupBy("g", "d", "x", "y").agg(F.min(F.struct("doc", "digest", "rid")).alias("best")).select(F.col("best.rid").alias("rid"))
    gone = common.cut(tagged.join(best, "rid", "left_anti").select(F.col("rid").alias(key)), "gone")
    return rows.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = _fresh(docs, "found_id")
    ids = common.cut(found.select(F.col("id").alias(key)).distinct(), "contaminated")
    return docs.join(ids, F.col("doc_id") == F.col(key), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with what the secret scan reports replaced in its text (n_chars follows)."""
    found = find_secrets(docs, carry=True)
    clean = F.when(F.size("spans") > 0, redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    out = found.select(clean.alias("clean"), "spans", "row")
    value = lambda c: F.col(f"row.`{c}`")
    changed = {"text": F.col("clean"),
               "n_chars": F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(value("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else value(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: ``doc_id, source, size, source_size, target, taken`` of the documents with words in it."""
    return mix(docs).where("taken > 0").withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Models and similarity search have no SQL form; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
