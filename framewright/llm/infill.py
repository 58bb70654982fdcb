"""Fill-in-the-middle: texts cut at unit ends and put in another order, and put back again.

A text is cut into units (lines by default), left to right over code points.  Two seeded places among the unit
ends give prefix, middle and suffix; the seed also says whether a text is transformed at all and in which
order.  Output: ``plain``, the text; ``psm``, ``<P>prefix<S>suffix<M>middle``; ``spm``,
``<S>suffix<P>prefix<M>middle``.  A text that spells a marker stays plain, so the output can always be read
back by its markers alone.

The work is one Arrow batch at a time in a pandas UDF: a text's unit ends go into one compact array, and two
lookups there slice it.  Nothing is shuffled, and a row's result depends on the row alone, so a lost
executor's batches come out the same again.

Defined results: null text counts as empty, and empty text is plain with no units; a null id is seeded as the
text ``null``; repeated rows give repeated results; an empty table gives an empty one; other columns pass through,
and a result's name that the table has already gets underscores before it, as :func:`result_names` says.  Memory follows the
longest text: its ends take eight bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.columns import fresh

#: Lines with their line feeds; the last may lack one.
LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Infill:
    """How texts are cut and put together; rates are in hundredths."""

    units: str = LINES
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def draws(self, key: object) -> list[int]:
        """Four numbers of 32 bits from the seed and a row's id."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]

    def ends(self, text: str, pattern: regex.Pattern) -> array:
        """0, then the end of every unit."""
        out = array("q", [0])
        out.extend(m.end() for m in pattern.finditer(text))
        return out

    def transform(self, key: object, text: str, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
        """``n, form, prefix_chars, middle_chars, output`` of one text."""
        ends = self.ends(text, pattern)
        n = len(ends) - 1
        first, second, whether, order = self.draws(key)
        if not text or any(m in text for m in self.markers) or whether % 100 >= self.rate:
            return n, PLAIN, None, None, text
        a, b = sorted((first % (n + 1), second % (n + 1)))
        i, j = ends[a], ends[b]
        before, inside, after = text[:i], text[i:j], text[j:]
        if order % 100 < self.spm_rate:
            return n, SPM, i, j - i, f"{self.suffix}{after}{self.prefix}{before}{self.middle}{inside}"
        return n, PSM, i, j - i, f"{self.prefix}{before}{self.suffix}{after}{self.middle}{inside}"

    def restore(self, output: str, form: str) -> str:
        """The text from its output and form."""
        if form == PLAIN:
            return output
        lead, second = (self.prefix, self.suffix) if form == PSM else (self.suffix, self.prefix)
        at = output.index(second, len(lead))
        end = output.index(self.middle, at + len(second))
        one, two, inside = output[len(lead) : at], output[at + len(second) : end], output[end + len(self.middle) :]
        return one + inside + two if form == PSM else two + inside + one


FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def check(rule: Infill) -> None:
    """Markers must differ, be non-empty, and not begin as another one ends, or outputs could be misread."""
    if len(set(rule.markers)) < 3 or not all(rule.markers):
        raise ValueError("three different markers are needed")
    for a in rule.markers:
        for b in rule.markers:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"marker {a!r} ends as {b!r} begins")
    if regex.compile(rule.units).match(""):
        raise ValueError("a unit must not be empty")


def infilled(key: Column, text: Column, rule: Infill = Infill()) -> Column:
    """A struct of ``RESULT`` for every row."""
    check(rule)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(rule.units)
        for keys, texts in batches:
            rows = [rule.transform(k, t, pattern) for k, t in zip(keys, texts, strict=True)]
            frame = pd.DataFrame(rows, columns=list(FIELDS))
            yield frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(text.cast("string"), F.lit("")))


def restored(output: Column, form: Column, rule: Infill = Infill()) -> Column:
    """The text of every row, rebuilt from what :func:`infilled` gave; null where either is null."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else rule.restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)


def result_names(columns: list[str]) -> dict[str, str]:
    """What the result columns are called beside ``columns``."""
    names: dict[str, str] = {}
    for field in FIELDS:
        names[field] = fresh([*columns, *names.values()], field)
    return names


def infill(docs: DataFrame, rule: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the transformed texts and where they were cut."""
    names = result_names(docs.columns)
    made = fresh(docs.columns, "infilled")
    out = docs.withColumn(made, infilled(F.col(id_col), F.col(text_col), rule))
    return out.select(*(out[c] for c in docs.columns), *(F.col(made)[f].alias(name) for f, name in names.items()))


def digests(batches: Iterator[pd.DataFrame], rule: Infill) -> Iterator[pd.DataFrame]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for rows in batches:
        yield pd.DataFrame(
            {
                "output_sha256": [sha(o) for o in rows["output"]],
                "restored_sha256": [sha(rule.restore(o, f)) for o, f in zip(rows["output"], rows["form"], strict=True)],
            }
        )


def digest(docs: DataFrame, rule: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`infill` gives, with digests of the output and of the text rebuilt from it in place of the texts.

    Output and rebuilt text stay in the worker's batch, so long texts cross to Python once.
    """
    check(rule)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(rule.units)
        for keys, texts in batches:
            frame = pd.DataFrame([rule.transform(k, t, pattern) for k, t in zip(keys, texts, strict=True)], columns=list(FIELDS))
            frame = frame.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
            yield pd.concat([frame.drop(columns="output"), next(digests(iter([frame]), rule))], axis=1)

    made = run(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.*")


#: The same for DuckDB, with the registered query's parameters.
ORACLE = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n,
    ('0x' || substr(h, 1, 8))::UBIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (len(u) + 1) AS y,
    ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS whether, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS how
  FROM units
), cut AS (
  SELECT *,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR whether >= 100 THEN 'plain'
         WHEN how < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(x, y)], '') AS prefix,
    array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
    array_to_string(u[greatest(x, y) + 1:n], '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
         ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
