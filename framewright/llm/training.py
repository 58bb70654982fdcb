"""Training rows: the fold rule, all labelled rows, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: the checksum of the id as text is a multiple of ``FOLDS``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``text, y`` of at most ``bound`` labelled documents of the learning folds.

    A document labelled more than once counts once, by its highest label.
    """
    return _texts(docs, _least(_highest(labels, label), bound))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``label_id, digest, text`` of all documents of the learning folds that ``labels`` may name; whether they
    do is for :func:`one_of_copies` to decide, which shuffles no text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.filter(F.col("label_id").isNotNull() & ~held_out("label_id")).select("label_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")


def one_of_copies(found: DataFrame, labels: DataFrame, label: str, value: str) -> DataFrame:
    """``y`` and ``value`` of all labelled rows (``label_id, digest``): an id that several rows have counts once,
    by its least digest, a document labelled more than once by its highest label, and so do copies of a text."""
    named = _highest(labels, label).select(F.col("doc_id").cast("long").alias("label_id"), "y")
    once = found.join(named, "label_id").groupBy("label_id").agg(F.min(F.struct("digest", value)).alias("_v"), F.first("y").alias("y"))
    return once.groupBy("_v.digest").agg(F.max("y").alias("y"), F.first(f"_v.{value}").alias(value))


def _highest(labels: DataFrame, label: str) -> DataFrame:
    return labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))


def unlabelled_sample(docs: DataFrame, bound: int) -> DataFrame:
    """``text, y`` (y null) of at most ``bound`` documents of the learning folds, whether labelled or not."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & ~held_out())
    return _texts(docs, _least(rows, bound).distinct().withColumn("y", F.lit(None).cast("double")))


def _least(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows of least hash of their id: the same on every run."""
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    total = rows.count()
    if total > 2 * bound:  # most rows need not be sorted; twice the share leaves enough with all but no chance
        rows = rows.filter(chance < int(2 * bound / total * (1 << 30)))
    return rows.orderBy(chance, "doc_id").limit(bound)


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen documents' texts; an id that several rows have counts once, by its least text, and so do
    copies of a text, by their highest label: a group of copies is one example.

    The chosen side has as many rows of two numbers as the sample's bound, which bounds the broadcast.
    """
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "y")
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    once = found.groupBy("label_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return once.groupBy("text").agg(F.max("y").alias("y"))
