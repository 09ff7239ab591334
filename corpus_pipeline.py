"""A training-corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on every row of docs, and returns a DataFrame; all but the last return the columns of
documents. Texts are judged by keys of id and text; rows alike in both share what is decided.

Defined results of all stages: a null or empty text has no words, fails the quality rules and goes there; a null id, language or source is
a value like any other; of rows alike, each stands for itself but among near duplicates, where one stays; a very long text is one row in
every stage; an empty table gives an empty result. Columns other than those of documents are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm.common import row_keys, stored, table
from tramline.llm.decontaminate import decontaminate
from tramline.llm.line_dedup import dedup_lines
from tramline.llm.mixing import mix_sources
from tramline.llm.near import near_duplicates
from tramline.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Of rows alike in id and text, one that is kept keeps all."""
    kept = quality_rules(docs, keys=True).where("kept").select("k1", "k2").distinct()
    return docs.select(*COLUMNS, *row_keys()).join(kept.hint("shuffle_hash"), ["k1", "k2"], "left_semi").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go from every text; a text that loses all stays as an empty one. n_chars follows the text."""
    out = dedup_lines(docs, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept").alias("text"), F.col("kept_lang").alias("lang"), F.col("kept_source").alias("source"), F.length("kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id stays; documents without words are no class and stay."""
    out = stored(near_duplicates(docs, keys=True).select("doc_id", "k1", "k2", "label"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    stays = out.where("label IS NOT NULL").groupBy("label").agg(first).select("first.k1", "first.k2")
    alone = out.where("label IS NULL").select("k1", "k2").distinct().withColumn("alone", F.lit(True))
    stays = stays.withColumn("alone", F.lit(False)).unionByName(alone)
    kept = docs.select(*COLUMNS, *row_keys()).join(stays.hint("shuffle_hash"), ["k1", "k2"])
    # Rows alike in id and text have met in one task; of them one stays.
    order = Window.partitionBy("k1", "k2").orderBy(F.lit(0))
    return kept.withColumn("nth", F.row_number().over(order)).where("nth = 1 OR alone").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return out.where("n_items = 0").select("doc_id", *[F.col(f"kept_{c}").alias(c) for c in COLUMNS[1:]])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, ties in the seeded order broken by id and text, with how often each is repeated (repeats) and the words it gives (taken). Documents not taken are left out."""
    keyed = docs.select(*COLUMNS, *row_keys())
    shares = mix_sources(keyed, keep=("k1", "k2")).where("repeats > 0")
    shares = shares.groupBy(F.col("kept_k1").alias("k1"), F.col("kept_k2").alias("k2")).agg(*[F.min(c).alias(c) for c in ("size", "source_size", "target", "repeats", "taken")])
    return keyed.join(shares.hint("shuffle_hash"), ["k1", "k2"]).select(*COLUMNS, "size", "source_size", "target", "repeats", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]

#: SQL cannot express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
