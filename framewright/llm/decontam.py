"""Benchmark decontamination with suffix arrays over the training documents.

Documents are taken in shards of some tens of megabytes, whole tasks where those are smaller.  A shard's words
become codes of the benchmark's vocabulary (0: a word that no item has).  Suffixes that start inside a run of
known words at least as long as the shortest window go into the shard's suffix array; any other suffix has an
unknown word inside every window and can't match.  Every test suffix whose first and last words the shard has is
then binary-searched in the array, word by word within the interval that the words before it have left.  What
remains is the interval of training suffixes that begin with its window, hence all locations; neighbouring
locations on one diagonal join into maximal verbatim matches.

A *window* is ``width`` consecutive item words; an item of fewer words, but not none, is one window.

Scale: nothing is shuffled.  The benchmark is cut into blocks of bounded bytes; each block is sent
to the executors and all documents are passed over once per block, with a stored table between two blocks, so no
bound on the benchmark's size is assumed.  A passage that a third of the documents hold costs its own length in
each of them.  Item sets follow from distinct windows by document; only ``matches``, which may be left out, has a
row for each text that a passage comes from.

Defined results: null or wordless texts have no words and no hits; repeated rows each get their own
result; an empty benchmark or document table gives no hits or no rows; null item ids count as the
string ``null``; columns of the documents pass through, and one that is named like the result is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkernels as tk
from framewright.llm.columns import fresh
from framewright.llm.scratch import materialize

#: Bytes of text to a shard; its arrays take a few times this at most.
SHARD_BYTES = 32 << 20
#: Bytes of item text in a block sent to executors: a few times this in memory there.
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 18

RESULT = "struct<n_words: long, n_hit: long, items: array<string>, hit: binary, matches: array<struct<item: string, item_at: int, at: int, words: int>>>"
_MATCH = pa.struct([("item", pa.string()), ("item_at", pa.int32()), ("at", pa.int32()), ("words", pa.int32())])
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit", pa.binary()), ("matches", pa.list_(_MATCH))])


@dataclass
class TestSet:
    """One block of the benchmark: vocabulary, distinct texts as codes, windows by width."""

    vocabulary: np.ndarray
    check: np.ndarray
    known: np.ndarray
    owners: list[list[str]]
    windows: list[WindowSet]
    longest: int

    @classmethod
    def build(cls, ids: list[str], texts: list[str | None], width: int) -> TestSet:
        w = tk.words(pa.array(texts, pa.string()))
        vocabulary, first, codes = np.unique(w.hash, return_index=True, return_inverse=True)
        check = second_hash(w.data, w.start[first], w.end[first])
        known = np.zeros(1 << _FILTER_BITS, dtype=bool)
        known[vocabulary >> np.uint64(64 - _FILTER_BITS)] = True
        distinct: dict[bytes, int] = {}
        owners: list[list[str]] = []
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        longest = 0
        for k, item in enumerate(ids):
            own = codes[w.offsets[k] : w.offsets[k + 1]].astype(np.int32) + 1
            if not len(own):
                continue
            at = distinct.setdefault(own.tobytes(), len(owners))
            if at == len(owners):
                owners.append([])
                by_width.setdefault(min(width, len(own)), []).append((at, own))
                longest = max(longest, len(own))
            owners[at].append(item)
        windows = [WindowSet.build(n, found) for n, found in sorted(by_width.items())]
        return cls(vocabulary, check, known, owners, windows, longest)

    def codes(self, w: tk.Words) -> np.ndarray:
        """Codes of the words; unequal words with equal hashes are told apart by a second hash."""
        out = np.zeros(len(w.hash), dtype=np.int32)
        if not len(self.vocabulary):
            return out
        at = np.flatnonzero(self.known[w.hash >> np.uint64(64 - _FILTER_BITS)])
        place = np.searchsorted(self.vocabulary, w.hash[at])
        place[place == len(self.vocabulary)] = 0
        same = self.vocabulary[place] == w.hash[at]
        out[at[same]] = place[same] + 1
        return out


@dataclass
class WindowSet:
    """The distinct windows of one width, as rows of codes, and where in the distinct texts each occurs."""

    width: int
    rows: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    at: np.ndarray

    @classmethod
    def build(cls, width: int, found: list[tuple[int, np.ndarray]]) -> WindowSet:
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(own, width) for _, own in found])
        text = np.concatenate([np.full(len(own) - width + 1, k) for k, own in found])
        at = np.concatenate([np.arange(len(own) - width + 1) for _, own in found])
        _, first, inverse = np.unique(as_keys(rows), return_index=True, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        return cls(width, rows[first], np.searchsorted(inverse[order], np.arange(len(first) + 1)), text[order], at[order])


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort as the rows do."""
    wide = np.ascontiguousarray(rows, dtype=">i4")
    return wide.view(f"S{4 * rows.shape[1]}").reshape(-1)


def second_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of byte spans, over a copy of only those bytes."""
    size = end - start
    stop = np.cumsum(size)
    index = np.repeat(start - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
    part = (data[index].astype(np.uint64) + np.uint64(7)) * np.uint64(0xA24BAED4963EE407)
    part = tk.mix(part + np.arange(len(index), dtype=np.uint64) - np.repeat((stop - size).astype(np.uint64), size), 5)
    return np.add.reduceat(part, stop - size) if len(size) else np.zeros(0, np.uint64)


class SuffixShard:
    """A suffix array over the runs of known words of one shard."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, n_codes: int, shortest: int, depth: int):
        start, end = known_runs(codes, offsets)
        keep = end - start >= shortest
        start, end = start[keep], end[keep]
        size = end - start + 1  # with a separator
        total = int(size.sum())
        index = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
        last = np.cumsum(size) - 1
        self.word = index
        self.text = codes[np.minimum(index, max(0, len(codes) - 1))] if total else np.zeros(0, np.int32)
        self.text[last] = 0
        self.order = sort_suffixes(self.text, depth)
        self.has = np.zeros(n_codes + 1, dtype=bool)
        self.has[self.text] = True

    def narrowed(self, low: np.ndarray, high: np.ndarray, ahead: int, word: np.ndarray, after: bool) -> np.ndarray:
        """By bisection, where in each interval of suffixes the first is whose word ``ahead`` is not less than
        ``word``, or greater than it if ``after``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            own = self.text[np.minimum(self.order[middle] + ahead, len(self.text) - 1)]
            up = own <= word[open_] if after else own < word[open_]
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
            open_ = open_[low[open_] < high[open_]]
        return low

    def find(self, windows: WindowSet) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, place of its word in the shard) of every occurrence."""
        which = np.flatnonzero(self.has[windows.rows[:, 0]] & self.has[windows.rows[:, -1]])
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.order))
        for ahead in range(windows.width):
            word = windows.rows[which, ahead]
            low, high = self.narrowed(low, high, ahead, word, False), self.narrowed(low, high, ahead, word, True)
            some = low < high
            which, low, high = which[some], low[some], high[some]
        count = high - low
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(which, count), self.word[self.order[np.repeat(low, count) + inside]]


def known_runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of maximal runs of nonzero codes that stay within one document."""
    known = codes > 0
    breaks = np.zeros(len(codes) + 1, dtype=bool)
    breaks[offsets] = True
    before = np.concatenate([[False], known[:-1]]) & ~breaks[:-1]
    after = np.concatenate([known[1:], [False]]) & ~breaks[1:]
    return np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order by prefix doubling, to at least ``depth`` words."""
    rank, reach = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth and len(rank) and rank.max() + 1 < len(rank):
        following = np.zeros(len(rank), dtype=np.int64)
        following[: max(0, len(rank) - reach)] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 1) + following, return_inverse=True)[1]
        reach *= 2
    return np.argsort(rank, kind="stable")


def coded(texts: pa.Array, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of some documents, and the documents' offsets into them."""
    w = tk.words(texts)
    codes = tests.codes(w)
    if len(codes) and tests.windows:
        start, end = known_runs(codes, w.offsets)
        long = end - start >= tests.windows[0].width
        size = (end - start)[long]
        at = np.repeat(start[long] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        wrong = second_hash(w.data, w.start[at], w.end[at]) != tests.check[codes[at] - 1]
        codes[at[wrong]] = 0
    return codes, w.offsets


def scan_shard(codes: np.ndarray, offsets: np.ndarray, tests: TestSet, matches: bool = True) -> list[dict]:
    """Per document: words hit as packed bits, items found, and maximal matches."""
    rows = [{"n_words": int(n), "items": [], "hit": None, "matches": []} for n in np.diff(offsets)]
    if not tests.windows or not codes.any():
        return rows
    shard = SuffixShard(codes, offsets, len(tests.vocabulary), tests.windows[0].width, tests.windows[-1].width)
    doc_at = lambda places: np.searchsorted(offsets, places, "right") - 1
    edge = np.zeros(len(codes) + 1, dtype=np.int32)
    found: list[np.ndarray] = []
    pairs: list[np.ndarray] = []
    for windows in tests.windows if len(shard.order) else ():
        which, place = shard.find(windows)
        if not len(which):
            continue
        for places, step in ((place, 1), (place + windows.width, -1)):
            at, n = np.unique(places, return_counts=True)
            edge[at] += (step * n).astype(np.int32)
        docs = doc_at(place)
        both = np.unique(np.stack([docs, which]), axis=1)
        doc, slot = _owned(windows, both[1], both[0])
        found.append(np.unique(np.stack([doc, windows.text[slot]]), axis=1))
        if matches:
            place, slot = _owned(windows, which, place)
            pairs.append(maximal(windows.text[slot], windows.at[slot], place, doc_at(place), windows.width))
    if not found:
        return rows
    hit = np.cumsum(edge[:-1]) > 0
    found_in = np.unique(np.concatenate(found, axis=1), axis=1)
    for d, t in zip(*found_in.tolist(), strict=True):
        rows[d]["items"].extend(tests.owners[t])
    for d in np.unique(found_in[0]).tolist():
        rows[d]["items"] = sorted(set(rows[d]["items"]))
        rows[d]["hit"] = np.packbits(hit[offsets[d] : offsets[d + 1]]).tobytes()
    if pairs:
        text, item_at, place, length = np.concatenate(pairs, axis=1)
        docs = doc_at(place)
        for d, t, i, p, n in sorted(zip(docs.tolist(), text.tolist(), item_at.tolist(), place.tolist(), length.tolist(), strict=True)):
            rows[d]["matches"].append({"item": tests.owners[t][0], "item_at": i, "at": int(p - offsets[d]), "words": n})
    return rows


def _owned(windows: WindowSet, which: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``beside`` repeated for each place in the tests where its window occurs, and those places' numbers."""
    times = windows.starts[which + 1] - windows.starts[which]
    slot = np.repeat(windows.starts[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return np.repeat(beside, times), slot


def maximal(text: np.ndarray, item_at: np.ndarray, place: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Joins window matches that follow each other both in the text and in the document."""
    order = np.lexsort((place, place - item_at, text, doc))
    text, item_at, place, doc = text[order], item_at[order], place[order], doc[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(place) != 1) | (np.diff(item_at) != 1) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(text))) + width - 1
    return np.stack([text[first], item_at[first], place[first], size]).astype(np.int64)


def _merge(old: dict | None, new: dict) -> dict:
    if old is not None and old["hit"] is not None:
        if new["hit"] is None:
            new["hit"] = old["hit"]
        else:
            new["hit"] = (np.frombuffer(old["hit"], np.uint8) | np.frombuffer(new["hit"], np.uint8)).tobytes()
        new["items"] = sorted({*old["items"], *new["items"]})
        new["matches"] = old["matches"] + new["matches"]
    new["n_hit"] = int(np.unpackbits(np.frombuffer(new["hit"], np.uint8)).sum()) if new["hit"] else 0
    return new


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The items in blocks of about ``block_bytes`` each (one item at least)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks == 1:
        yield items.toArrow()
        return
    for k in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()


def annotate(docs: DataFrame, benchmark: DataFrame, name: str = "contamination", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, matches: bool = True) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, items, hit, matches; raises if they have such a column.

    ``hit`` packs one bit per word (null: none).  ``matches`` are maximal verbatim matches with their
    places in the item and in the document, in words; of items with equal texts the first is named.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    spark = docs.sparkSession
    words_col = fresh(docs.columns, "plain_text")
    out = docs.withColumn(words_col, F.col(text_col).cast("string")).withColumn(name, F.lit(None).cast(RESULT))
    for k, block in enumerate(benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)):
        sent = spark.sparkContext.broadcast(TestSet.build(block.column("item").to_pylist(), block.column("text").to_pylist(), width))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests, held, size = sent.value, [], 0
            for part in tk.slices(batches, words_col):
                held.append((part, *coded(part.column(words_col), tests)))
                size += part.nbytes
                if size >= shard_bytes:
                    yield from _annotated(held, tests, name, matches)
                    held, size = [], 0
            yield from _annotated(held, tests, name, matches)

        if k:
            out = materialize(out, "contamination")
        out = out.mapInArrow(run, out.schema)
    return out.drop(words_col)


def _annotated(held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], tests: TestSet, name: str, matches: bool) -> Iterator[pa.RecordBatch]:
    """The slices of one shard with their results."""
    if not held:
        return
    begins = np.cumsum([0, *(len(codes) for _, codes, _ in held)])
    offsets = np.concatenate([o[:-1] + b for (_, _, o), b in zip(held, begins[:-1], strict=True)] + [begins[-1:]])
    rows = iter(scan_shard(np.concatenate([codes for _, codes, _ in held]), offsets, tests, matches))
    for part, _, _ in held:
        at = part.schema.get_field_index(name)
        merged = [_merge(old, next(rows)) for old in part.column(at).to_pylist()]
        yield part.set_column(at, pa.field(name, _RESULT), pa.array(merged, _RESULT))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    name = fresh(docs.columns, "contamination")
    return annotate(docs, benchmark, name=name, matches=False, **options).filter(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


ORACLE = """
WITH item_words AS (
  SELECT item_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos, len(w) AS n
  FROM (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), '[^ ]+') AS w FROM benchmark)
  WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]', ' ', 'g'), '[^ ]+') AS w FROM documents)),
item_windows AS (
  SELECT DISTINCT item_id, size, win FROM (
    SELECT item_id, least(10, n) AS size, n, pos,
      string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win
    FROM item_words)
  WHERE pos <= n - size + 1),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT doc_id, pos, size, list_aggregate(list_slice(ws, 1, size), 'string_agg', ' ') AS win
  FROM (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ws FROM doc_words), sizes
  WHERE len(ws) >= size),
found AS (
  SELECT d.doc_id, d.pos, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.win = i.win),
hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_words FROM doc_words GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
