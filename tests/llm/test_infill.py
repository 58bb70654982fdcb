"""Fill-in-the-middle against its rule written out plainly, and its round trip."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import infill
from framewright.llm.infill import Infill


def plainly(doc_id, text):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one line", "one\ntwo", "one\ntwo\n", "é\n日本\n\U0001f600x", "a<P>b\nc", "<P\n<S\n>M>", "<\nS>\n", "\r\n\r\n", "x\n" * 200_000, "y" * 300_000, "same\ntext", "same\ntext"]


def test_equals_the_rule_written_out(spark):
    docs = spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, form string, N int")
    got = {r.doc_id: r for r in infill.infill(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["_n"], r["_form"], r.prefix_chars, r.middle_chars, r.output) == plainly(i, t)
        assert (r.form, r.N, r.text) == ("kept", 3, t)


def test_digests_are_of_what_comes_back(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in infill.digest(docs).collect():
        n, form, p, m, out = plainly(r.doc_id, TEXTS[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()


def test_restores_from_columns(spark):
    docs = infill.infill(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t], "doc_id long, text string"))
    assert docs.filter(infill.restored(docs.output, docs.form) != docs.text).count() == 0


def test_null_ids_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc"), (None, "a\nb\nc"), (5, None)], "doc_id long, text string")
    rows = infill.infill(docs).filter("doc_id is null").collect()
    assert rows[0] == rows[1] and rows[0].output == plainly("null", "a\nb\nc")[4]
    assert infill.infill(docs.limit(0)).count() == infill.digest(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>ab\n", max_size=40), st.integers(0, 10**6))
def test_any_text_comes_back(text, key):
    import regex

    rule = Infill()
    _, form, _, _, out = rule.transform(key, text, regex.compile(rule.units))
    assert rule.restore(out, form) == text


def test_rates_other_units_and_bad_markers(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'ab cd ef gh' as text")
    words = Infill(units=r"\S+\s*", rate=50, spm_rate=0, prefix="[p]", suffix="[s]", middle="[m]")
    forms = {r.form: r["count"] for r in infill.infill(docs, words).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 140 < forms["plain"] < 260
    for bad in (Infill(prefix="<S>"), Infill(prefix="<S"), Infill(middle=""), Infill(prefix="x>", suffix=">y"), Infill(units=r"\S*")):
        with pytest.raises(ValueError):
            infill.infill(docs, bad)
