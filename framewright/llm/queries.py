"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import audio, bpe, centroids, chat, decontam, infill, licenses, near_dup, pii, quality, simhash, token_files, toxicity
from framewright.llm.scratch import bound_batches, materialize
from framewright.llm.training import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a stored 8-bit audio file; its features from there, stored as tensors and read back."""
    media = materialize(audio.encode(table(spark, sf_dir, "documents")), "media")
    return audio.analyse(materialize(audio.store_features(media), "features"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return near_dup.NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).classes()


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence notices."""
    return licenses.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The key of the registered queries; a deployment gives its own.
DEMONSTRATION_KEY = "framewright demonstration key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and what was replaced."""
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMONSTRATION_KEY, found="kinds")
    return docs.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document lie in windows of which benchmark items."""
    found = decontam.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), matches=False)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c.n_words.alias("n_words"),
        c.n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        (c.n_hit > 0).alias("contaminated"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one that spells out control strings, formatted, stored and read back."""
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    stored = materialize(chat.format_chat(rows.withColumn("parts", chat.text_parts())), "chat")
    return chat.digests(stored)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the end id 2, written to files and read back."""
    return token_files.store_and_check(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, vocabulary=50_257)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's; those of every twentieth id are
    searched for among all, and ``n_within`` is how many documents lie within 3 bits, itself included (null for other ids)."""
    rows = materialize(simhash.report(table(spark, sf_dir, "documents")), "fingerprints")
    asked = F.col("doc_id") % 20 == 0
    found = simhash.rows_within(rows.filter(asked), rows)
    others = rows.filter(~asked | F.col("doc_id").isNull()).withColumn("n_within", F.lit(None).cast("long"))
    return found.select(others.columns).unionByName(others).drop("fp")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at line ends and put in another order, and put back."""
    return infill.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds."""
    return centroids.Yinyang().clusters(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_audio_features": op1_audio_features,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_licence_scan": op3_licence_scan,
    "op4_toxicity": op4_toxicity,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quality": op6_quality,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_decontamination": op8_decontamination,
    "op9_chat_format": op9_chat_format,
    "op10_token_files": op10_token_files,
    "op11_fingerprints": op11_fingerprints,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLE_SQL: dict[str, str] = {
    "op3_licence_scan": licenses.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_centroid_clusters": centroids.oracle(),
}
