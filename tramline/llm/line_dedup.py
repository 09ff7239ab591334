"""Line dedup over levelled sorted runs of line hashes.

A store keeps runs of (hash, documents), sorted by hash in ranges, level by level. A run holds two kinds of hashes: often, found in min_docs
documents or more when the run was made, and open, with the documents that its batch adds. Each new batch of counts

1. merge-anti-joins the often hashes of all runs: what is known to be often needs no more counting, and stands in one run only;
2. merge-joins what is left with the open hashes of the runs, and adds up;
3. adds a run of its own: hashes that now reach min_docs as often, the others as open.

When a level holds FANOUT runs they are compacted into one run of the next. A manifest names the runs, so that a store is opened again by its path.

Defined results: a null or empty text is one empty line; a key shorter than min_length is never dropped; repeated rows count as documents of their own;
a very long text is one row of lines, in memory some times its size; an empty table adds an empty run. Extra columns of the input are kept or left out by name only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, read_text, remove_at_exit, remove_path, row_keys, shared_dir, stored, write_text

#: Runs on a level before they are compacted into one of the next.
FANOUT = 3
#: Often hashes (16 bytes each) up to which they go to the tasks whole, and salts by which they meet lines beyond it.
SENT, SALTS = 500_000, 16


def line_key(line: Column) -> Column:
    """The line without white space at both ends, with A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(3), key).alias("h2"))


class LineRuns:
    """Sorted runs in a shared folder. A run is written whole before a manifest names it, so a lost executor or an interrupted batch leaves the store as it was."""

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = 10):
        self.spark, self.min_docs = spark, min_docs
        self.path = path or f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        if path is None:
            remove_at_exit(spark, self.path)
        self.levels: list[list[str]] = [[]]
        self.version = 0
        while (text := read_text(spark, f"{self.path}/manifest-{self.version}.json")) is not None:
            known = json.loads(text)
            if known["min_docs"] != min_docs:
                raise ValueError(f"the store counts up to {known['min_docs']} documents, not {min_docs}")
            self.levels = known["levels"]
            self.version += 1

    def _publish(self) -> None:
        write_text(self.spark, f"{self.path}/manifest-{self.version}.json", json.dumps({"min_docs": self.min_docs, "levels": self.levels}))
        self.version += 1

    def _write(self, rows: DataFrame) -> str:
        """A run of (h1, h2, n, often), in ranges of h1."""
        to = f"run={uuid.uuid4().hex}"
        rows.repartitionByRange("h1").sortWithinPartitions("often", "h1", "h2").write.partitionBy("often").parquet(f"{self.path}/{to}")
        return to

    def _read(self, runs: list[str], often: bool) -> DataFrame:
        schema = "h1 long, h2 long, n long, often boolean"
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], schema)
        return rows.where(F.col("often") == often).select("h1", "h2", "n")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def often(self) -> DataFrame:
        """(h1, h2) of the hashes in min_docs documents or more, each once."""
        return self._read(self.runs(), True).select("h1", "h2")

    def new_in(self, counts: DataFrame) -> DataFrame:
        """The rows of a batch that no run holds as often yet."""
        return counts.join(self.often().hint("merge"), ["h1", "h2"], "left_anti") if self.runs() else counts

    def add(self, counts: DataFrame) -> None:
        """Adds a batch's counts (h1, h2, n), each hash once, as a run."""
        new = self.new_in(counts.select("h1", "h2", "n"))
        if self.runs():
            known = self._read(self.runs(), False).join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_semi")
            known = known.groupBy("h1", "h2").agg(F.sum("n").alias("before"))
            new = new.join(known.hint("merge"), ["h1", "h2"], "left")
        else:
            new = new.withColumn("before", F.lit(0))
        often = F.col("n") + F.coalesce("before", F.lit(0)) >= self.min_docs
        self.levels[0].append(self._write(new.select("h1", "h2", "n", often.alias("often"))))
        self._publish()
        level = 0
        while len(self.levels[level]) >= FANOUT:
            old = self.levels[level]
            # Open counts of what became often since are of no more use.
            open_ = self.new_in(self._read(old, False)).groupBy("h1", "h2").agg(F.sum("n").alias("n")).withColumn("often", F.lit(False))
            merged = self._write(open_.unionByName(self._read(old, True).withColumn("often", F.lit(True))))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self.levels[level] = []
            self._publish()
            for r in old:
                remove_path(self.spark, f"{self.path}/{r}")
            level += 1


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), store: LineRuns | None = None) -> DataFrame:
    """Drops every line whose key stands in at least min_docs documents: id, n_lines, n_dropped, kept (the text left, null if no text was given), keep.

    Hashes of the distinct keys of each document are counted per batch of documents and go through the runs; a store of earlier
    documents counts theirs too. Often hashes meet the lines in the tasks where they are few, checked by a count, and by a
    salted join beyond that; places of dropped lines come back to their documents, and texts move once, dealt by id and text.
    """
    runs = store or LineRuns(docs.sparkSession, min_docs=min_docs)
    if runs.min_docs != min_docs:
        raise ValueError(f"the store counts up to {runs.min_docs} documents, not {min_docs}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    k1, k2 = row_keys("id")
    keys = F.array_distinct(F.filter(F.transform(lines, line_key), lambda k: F.length(k) >= min_length))
    hashed = rows.select(k1, F.explode(F.transform(keys, key_hashes)).alias("h")).select("k1", "h.h1", "h.h2")
    counts = hashed.withColumn("batch", F.pmod("k1", F.lit(batches))).groupBy("batch", "h1", "h2").agg(F.count("*").alias("n"))
    counts = stored(counts, "line-counts", partition_by="batch")
    for b in range(batches):
        runs.add(counts.where(F.col("batch") == b).select("h1", "h2", "n"))
    often = stored(runs.often(), "often-lines")

    places = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line_key(line).alias("key"))), lambda x: F.length(x["key"]) >= min_length)
    placed = rows.select(k1, k2, F.explode(F.transform(places, lambda x: F.struct(x["i"].alias("i"), key_hashes(x["key"]).alias("h")))).alias("x")).select("k1", "k2", "x.i", "x.h.h1", "x.h.h2")
    if often.count() <= SENT:
        found = placed.join(F.broadcast(often), ["h1", "h2"])
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = placed.withColumn("salt", F.pmod(F.xxhash64("k1", "i"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    drop = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("i")).alias("drop"))
    found = rows.select("*", k1, k2).join(drop.hint("shuffle_hash"), ["k1", "k2"], "left").drop("k1", "k2")
    found = found.withColumn("lines", lines).withColumn("drop", F.coalesce("drop", F.array().cast("array<int>")))
    # What stays are the stretches between dropped lines.
    found = found.withColumn("ends", F.concat(F.array(F.lit(-1)), "drop", F.array(F.size("lines"))))
    stretch = F.transform(F.sequence(F.lit(0), F.size("drop")), lambda j: F.slice("lines", F.get("ends", j) + 2, F.get("ends", j + 1) - F.get("ends", j) - 1))
    left = F.when(F.size("drop") == 0, F.col("text")).otherwise(F.array_join(F.flatten(stretch), "\n"))
    kept = F.when(F.col("text").isNotNull(), left).alias("kept")
    return found.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("drop").cast("long").alias("n_dropped"), kept, *[f"kept_{c}" for c in keep])
