"""run() against a plain composition of brute-force stages on a small corpus."""

import hashlib

import brute
import numpy as np
from conftest import SF

import corpus_pipeline
from framewright.llm import pii, quality, queries, scratch


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).toPandas().sort_values("doc_id").reset_index(drop=True)
    words = [brute.words(t) for t in good.text]
    firsts = sorted(set(brute.classes(len(good), brute.similar_pairs(list(good.text)))))
    windows = set()
    for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
        w = brute.words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    ids = [i for i in firsts if not any(tuple(words[i][k : k + n]) in windows for n in sizes for k in range(len(words[i]) - n + 1))]
    kept = good.loc[ids, ["doc_id", "text"]]
    new = pii.pseudonymise(spark.createDataFrame(kept), queries.DEMONSTRATION_KEY).toPandas()
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {d: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in zip(new.doc_id, new.text, strict=True)}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_on_odd_tables(spark):
    long = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions " * 2000
    texts = [None, "", " \n", long, long, "mail a.b@example.com now, please, for all of the details", "mail a.b@example.com now, please, for all of the details", "\0 nul"]
    rows = [(k if k % 3 else None, t, "en", "s", 1, 0.5, k, "m", 2) for k, t in enumerate(texts)]
    rows += rows[3:6]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, maybe string, contamination int"
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, scratch.materialize(stage(spark, docs, SF), "odd")
            assert name == "bpe" or docs.columns == before.columns
            assert docs.count() <= before.count()
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert docs.count() == docs.select("ids_sha256").distinct().count()
