"""Fingerprints, the order of documents and the search by block tables, each against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from framewright.llm import simhash
from framewright.llm.queries import op11_fingerprints

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def plain_fingerprint(text, most=2):
    words = WORD.findall((text or "").lower())
    count = Counter(xx(b.encode(), xx(w.encode())) for w, b in zip(words, ["", *words], strict=False)) or Counter({xx(b""): 1})
    votes, total = [0] * 128, 0
    for h, n in count.items():
        whole, n = h | xx(h.to_bytes(8, "little")) << 64, min(n, most)
        total += n
        for k in range(128):
            votes[k] += n * (whole >> k & 1)
    bits = sum(1 << k for k in range(128) if 2 * votes[k] > total)
    return f"{bits & (1 << 64) - 1:016x}{bits >> 64:016x}"


def plain_report(rows):
    """Of ``(id, text)`` with unique ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    fps = [plain_fingerprint(t) for _, t in rows]
    alike = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    out = {}
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        new = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        fp, other = fps[k], plain_fingerprint(new)
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fp, other, alike(fp, other), alike(fp, fps[(k + 1) % len(rows)]))
    return out


FIELDS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
TEXTS = ["", None, "one", "One", "--- !!", "two words", "a b a b a b a b", "É é ẞ 日本 \U0001f600", "x y " * 60_000, "z" * 70_000, " ".join(f"w{k}" for k in range(40_000)), "same", "same", "same"]


def test_query_equals_plain_version(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    want = plain_report(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    got = {r.doc_id: r for r in op11_fingerprints(spark, SF).collect()}
    assert {i: tuple(r[f] for f in FIELDS) for i, r in got.items()} == want
    fps = {i: int(w[2], 16) for i, w in want.items()}
    for i, r in got.items():
        assert r.n_within == (None if i % 20 else sum(bin(fps[i] ^ x).count("1") <= 3 for x in fps.values()))


@pytest.mark.parametrize("cell_rows", [1, 3, 1000])
def test_odd_texts_and_cells_of_any_size(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    ids = [7, -3, 0, 1, 2, 1 << 60, (1 << 60) + 1, 30, 31, 32, 50, 51, 52, 1000]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, fp string, cell int, guest int")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in simhash.report(docs).collect()}
    assert got == plain_report(zip(ids, TEXTS, strict=True))


def test_one_row_none_and_rows_without_or_with_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 2)
    docs = spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")
    assert simhash.report(docs).first().near_next == 1.0
    assert simhash.report(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "abcd"), (None, "wxyz"), (5, "bb"), (5, "aa"), (5, "aa"), (9, "cccc")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text, r.edited) for r in simhash.edited(odd).collect())
    assert got == Counter([(None, "abcd", "abab"), (None, "wxyz", "wxwx"), (9, "cccc", "ccaa"), (5, "aa", "aa"), (5, "aa", "ab"), (5, "bb", "bc")])


def test_weights_end_at_most(spark):
    docs = spark.createDataFrame([("a b " * 50 + "c d",)], "text string")
    for most in (1, 2, 40):
        assert docs.select(simhash.shown(simhash.fingerprint(F.col("text"), most))).first()[0] == plain_fingerprint("a b " * 50 + "c d", most)


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (1, 2), (3, 4), (3, 5), (4, 7)])
def test_search_finds_all_within_the_radius_once(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(simhash, "BUCKET", 3)
    rng = random.Random(radius * 10 + blocks)
    base = [rng.getrandbits(128) for _ in range(6)]
    fps = base + [b ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(8))}) for b in base for _ in range(40)]
    fps += fps[:30]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    both = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    table = spark.createDataFrame([(both(x),) for x in fps], "fp struct<a:long,b:long>")
    asked = spark.createDataFrame([(both(x),) for x in fps[::7]], "fp struct<a:long,b:long>")
    got = simhash.search(asked, table, radius, blocks).collect()
    n = Counter(fps)
    want = {(both(q), both(x)): (bin(q ^ x).count("1"), n[x]) for q in set(fps[::7]) for x in n if bin(q ^ x).count("1") <= radius}
    assert len(got) == len(want)
    assert {(tuple(r.fp), tuple(r.found)): (r.distance, r.n) for r in got} == want
    named = asked.withColumn("fingerprint", simhash.shown(F.col("fp")))
    per = {(tuple(r.fp)): r.n_within for r in simhash.rows_within(named, table, radius, blocks).collect()}
    assert per == {q: sum(k for (p, _), (_, k) in want.items() if p == q) for q, _ in want}


def test_compiled_sums_equal_the_column(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    got = simhash.fingerprints(rows, ["k"], {"one": F.col("text"), "two": F.reverse("text")})
    want = rows.select("k", simhash.fingerprint(F.col("text")).alias("one"), simhash.fingerprint(F.reverse("text")).alias("two"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_radius_needs_blocks():
    with pytest.raises(ValueError):
        simhash.BlockTables(4, 4)


def test_plan_has_no_python(spark):
    plan = op11_fingerprints(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    report = simhash.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in report and report.count("Exchange hashpartitioning") == 1
