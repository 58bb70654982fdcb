"""Hooks for external models.  Weights and services are not part of this library: these are interfaces."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTIONS = "frame_id string, idx int, type string, score double, x double, y double, z double, length double, width double, height double, yaw double"
#: What a judge may see: neither the truth nor what the attack did.
HIDDEN = ("is_attacked", "attack_successful", "attack_metadata", "attacked_modalities", "labels")
VERDICT = "struct<verdict: string, suspected_attacks: array<struct<attack_type: string, confidence: string, affected_region: map<string, string>, evidence: array<string>, alternatives_ruled_out: array<string>>>>"
# What a judge may answer, and stated confidence as a number.
VERDICTS = ("BENIGN", "ATTACK_SUSPECTED", "UNCERTAIN")
ATTACK_TYPES = ("OBJECT_HIDING", "GHOST_OBJECT", "OBJECT_TRANSLATION", "UNCERTAIN")
CONFIDENCE = {"LOW": 0.33, "MEDIUM": 0.66, "HIGH": 1.0}


def predict(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str = PREDICTIONS) -> DataFrame:
    """A detector over batches of frames; the model is loaded in the worker by the callable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)


def judge_view(frames: DataFrame) -> DataFrame:
    """The frames without any column that tells the truth."""
    return frames.drop(*HIDDEN)


def answers(frames: DataFrame, cache: DataFrame, keys: list[str], judge: Callable[[str], str], question: str, per_minute: int, workers: int) -> DataFrame:
    """``keys`` and ``answer`` of every frame: cached answers first, the others asked.

    Only frames that the cache lacks reach the judge.  They are dealt to ``workers`` tasks, each of which
    keeps to its share of ``per_minute`` calls in any rolling minute.
    """
    known = judge_view(frames).join(cache.select(*keys, "answer"), keys, "left")
    share = max(1, per_minute // workers)
    asked = known.filter("answer is null").repartition(workers)
    schema = asked.select(*keys, F.lit("").alias("answer")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls: deque[float] = deque()
        for batch in batches:
            out = []
            for text in batch[question]:
                while calls and time.monotonic() - calls[0] >= 60:
                    calls.popleft()
                if len(calls) >= share:
                    time.sleep(max(0.0, 60 - (time.monotonic() - calls.popleft())))
                calls.append(time.monotonic())
                out.append(judge(text))
            yield batch[keys].assign(answer=out)

    return known.filter("answer is not null").select(*keys, "answer").unionByName(asked.mapInPandas(run, schema))


def parse_verdict(df: DataFrame, response: str, high_confidence: bool = False) -> DataFrame:
    """A judge's JSON answer as ``detected, error, confidence, suspected``.

    An answer is an error, and benign, unless its verdict and the type and confidence of every suspicion are
    known words and no field of a suspicion is missing.  An uncertain verdict is benign without an error.  With ``high_confidence`` an attack
    also needs a first suspicion that is more than LOW.  The confidence is the greatest stated one.
    """
    v, suspicions = F.col("_v"), F.coalesce(F.col("_v.suspected_attacks"), F.array().cast(VERDICT.split("suspected_attacks: ")[1][:-1]))
    levels = F.create_map(*(F.lit(x) for p in CONFIDENCE.items() for x in p))
    whole = F.forall(suspicions, lambda s: F.coalesce(s.attack_type.isin(*ATTACK_TYPES) & s.confidence.isin(*CONFIDENCE) & s.affected_region.isNotNull() & s.evidence.isNotNull() & s.alternatives_ruled_out.isNotNull(), F.lit(False)))
    known = F.coalesce(v.verdict.isin(*VERDICTS) & whole, F.lit(False))
    enough = F.coalesce(F.try_element_at(suspicions, F.lit(1)).confidence != "LOW", F.lit(False)) if high_confidence else F.lit(True)
    stated = F.coalesce(F.array_max(F.transform(suspicions, lambda s: levels[s.confidence])), F.lit(0.0))
    columns = {
        "detected": known & (v.verdict == "ATTACK_SUSPECTED") & enough,
        "error": ~known,
        "confidence": F.when(known, stated).otherwise(0.0),
        "suspected": F.when(known, F.transform(suspicions, lambda s: s.attack_type)).otherwise(F.array().cast("array<string>")),
    }
    return df.withColumn("_v", F.from_json(F.col(response), VERDICT)).withColumns(columns).drop("_v")
