"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banded, then verified.

A document's shingles are its runs of five words (all its words if fewer).  A shingle weighs
``tf * (1 + ln((N + 1) / (df + 1)) / ln(N + 1))``, from 1 to 2 per occurrence.  Document frequencies
are exact counts of 64-bit shingles over all documents (held at 2^32 - 1 beyond that).  Slices of documents
send their distinct shingles, packed and counted, to parts by hash; a part sums them and returns to each slice
the frequencies in the order sent.  No task holds more than one slice or one part, and there are as many parts as the
corpus needs.

Improved consistent weighted sampling (Ioffe, 2010) draws for each of ``bands * rows`` samples the
shingle of least ``ln c - r (t + 1 - b)`` with ``t = floor(ln w / r + b)``.  The draws ``r, b, c`` of a
shingle are read from two fixed pools at places given by its hash.  Only additions and products of
single-precision numbers take part, so every machine gets the same samples.  Documents that share a band's samples are
candidates; a link is a candidate pair whose weighted Jaccard similarity, over their whole shingle sets, is
``threshold`` or more (less 1e-9 for rounding).

Nodes are distinct texts: copies never meet in a bucket.  A bucket is dealt in chunks of bounded size.
A chunk is searched in full: one member after another is compared with all members of other components, until
every untested pair lies inside one component, so that a chunk of near copies costs one comparison each.
A bucket of several chunks sends a few pivots to all of them.  What then is still apart from the component of
most members, the base, is compared with all members of all buckets of that base, chunk by chunk.  Where that
is very much it is first searched by prefix: any two similar texts share a shingle among the rarest that make up a
fifth of the weight of either, so those shingles are buckets of their own.  So no link between candidates is lost.

Defined results: null text counts as empty; documents without words form classes by equal text; repeated
rows and null ids share the class of their text; the class id is the least document id in the class
(null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkernels as tk
from framewright.llm.columns import fresh
from framewright.llm.components import components, spread_join
from framewright.llm.reduce import task_number
from framewright.llm.scratch import discard, materialize, release

#: Text bytes to one part of the frequency count; a part holds at most about a sixth as many shingles.
PART_BYTES = 8 << 20
FILTER_BITS = 1 << 23
POOL = 1 << 12
#: Texts of a bucket, and shingles of theirs, that one verifying task takes together.
CHUNK, CHUNK_SHINGLES = 200, 400_000
#: Members that a bucket of several chunks sends to all of them.
FEW_PIVOTS = 8
#: Chunks of texts apart from one base beyond which they are searched by prefix first.
MOST_BLOCKS = 32
#: A bucket of more rows than this, and than a thousandth of all, is joined by broadcast: there are at most 1,000.
HOT_ROWS = 1_000
ROUNDING = 1e-9


@dataclass(frozen=True)
class DedupConfig:
    shingle: int = 5
    bands: int = 14
    rows: int = 4
    threshold: float = 0.8
    seed: int = 5


@lru_cache(maxsize=2)
def pools(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ln c; 1/r; b; r) tables of POOL x samples: c and r are Gamma(2, 1), b is uniform."""
    rng = np.random.default_rng(seed)
    log_c = np.log(rng.gamma(2.0, 1.0, (POOL, samples)))
    r = rng.gamma(2.0, 1.0, (POOL, samples))
    return tuple(x.astype(np.float32) for x in (log_c, 1 / r, rng.random((POOL, samples)), r))


@dataclass
class Shingles:
    """Distinct shingles of a slice, sorted by (document, shingle), with their counts."""

    doc: np.ndarray
    key: np.ndarray
    tf: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, texts: pa.Array, width: int) -> Shingles:
        w = tk.words(texts)
        n = len(texts)
        size = np.diff(w.offsets)
        all_runs = tk.windows(w.hash, width)
        doc = w.doc()
        whole = doc[: len(all_runs)] == doc[width - 1 :] if len(all_runs) else np.zeros(0, bool)
        keys, docs = [all_runs[whole]], [doc[: len(all_runs)][whole]]
        for short in np.unique(size[(size > 0) & (size < width)]):
            at = np.flatnonzero(size == short)
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(int(short)):
                value = value * np.uint64(0xD6E8FEB86659FD93) + w.hash[w.offsets[at] + k]
            keys.append(tk.mix(value, int(short)))
            docs.append(at)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return cls(doc[first], key[first], np.diff(np.append(first, len(key))), n)

    def weigh(self, seen: np.ndarray, n_total: int) -> np.ndarray:
        """By each shingle's own document frequency."""
        scale = np.log(n_total + 1.0)
        return self.tf * (1 + np.maximum(0, np.log((n_total + 1.0) / (seen + 1.0))) / scale)


def bands(s: Shingles, weight: np.ndarray, c: DedupConfig, block: int = 8_000) -> np.ndarray:
    """Documents x bands: a 64-bit key of each band's samples; rows without shingles are 0."""
    samples = c.bands * c.rows
    log_c, inv_r, b, r = pools(samples, c.seed)
    least = np.full((s.n_docs, samples), np.inf, dtype=np.float32)
    log_w = np.log(weight).astype(np.float32)
    for a in range(0, len(s.key), block):
        e = min(len(s.key), a + block)
        one = (s.key[a:e] & np.uint64(POOL - 1)).astype(np.int64)
        two = ((s.key[a:e] >> np.uint64(20)) & np.uint64(POOL - 1)).astype(np.int64)
        shift = b[two]
        value = inv_r[two]
        value *= log_w[a:e, None]
        value += shift
        np.floor(value, out=value)
        value -= shift
        value += np.float32(1)
        value *= r[two]
        np.subtract(log_c[one], value, out=value)
        doc = s.doc[a:e]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own = doc[first]
        least[own] = np.minimum(least[own], np.minimum.reduceat(value, first, axis=0))
    bits = least.view(np.uint32).astype(np.uint64).reshape(s.n_docs, c.bands, c.rows)
    out = np.zeros((s.n_docs, c.bands), dtype=np.uint64)
    for k in range(c.rows):
        out = tk.mix(out ^ bits[:, :, k], k)
    return tk.mix(out ^ np.arange(c.bands, dtype=np.uint64)[None, :], 9)


def weighted_jaccard(key_a: np.ndarray, w_a: np.ndarray, key_b: np.ndarray, w_b: np.ndarray) -> float:
    """Of two sorted sparse vectors: the sum of minima over the sum of maxima."""
    total = w_a.sum() + w_b.sum()
    if not total:
        return 0.0
    at = np.searchsorted(key_b, key_a)
    at[at == len(key_b)] = 0
    both = key_b[at] == key_a if len(key_b) else np.zeros(len(key_a), bool)
    shared = np.minimum(w_a[both], w_b[at[both]]).sum()
    return float(shared / (total - shared))


def prefix(s: Shingles, weight: np.ndarray, df: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each document's rarest shingles: those after them weigh less than ``threshold`` of all."""
    order = np.lexsort((s.key, df, s.doc))
    doc, w = s.doc[order], weight[order]
    first = np.searchsorted(doc, np.arange(s.n_docs + 1))
    upto = np.concatenate([[0.0], np.cumsum(w)])
    total = upto[first[1:]] - upto[first[:-1]]
    after = upto[first[1:]][doc] - upto[:-1]  # of this shingle and those after it
    kept = after >= (threshold - ROUNDING) * total[doc] - ROUNDING
    return doc[kept], s.key[order][kept]


class Search:
    """The links among texts of which some components are known."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], comps: list[bytes], threshold: float):
        self.size = np.array([len(k) for k, _ in vectors], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.key = np.concatenate([k for k, _ in vectors])
        self.weight = np.concatenate([w for _, w in vectors])
        self.owner = np.repeat(np.arange(len(vectors)), self.size)
        self.total = np.bincount(self.owner, self.weight, len(vectors))
        self.label = np.unique(np.array(comps, dtype="S16"), return_inverse=True)[1]
        self.threshold = threshold - ROUNDING
        self.links: list[tuple[int, int]] = []

    def compare(self, i: int) -> None:
        """Text ``i`` with all texts of other components; a link joins theirs."""
        t = self.threshold
        other = (self.label != self.label[i]) & (self.total * t <= self.total[i]) & (self.total[i] * t <= self.total)
        if not other.any():
            return
        own = slice(self.first[i], self.first[i + 1])
        key, weight = self.key[own], self.weight[own]
        which = other[self.owner]
        keys, weights, owner = self.key[which], self.weight[which], self.owner[which]
        at = np.searchsorted(key, keys)
        at[at == len(key)] = 0
        both = key[at] == keys
        shared = np.bincount(owner[both], np.minimum(weights[both], weight[at[both]]), len(self.total))
        for j in np.flatnonzero(other & (shared >= t * (self.total + self.total[i] - shared))):
            if self.label[j] != self.label[i]:
                self.links.append((i, int(j)))
                self.label[self.label == self.label[j]] = self.label[i]

    def among_all(self) -> None:
        """Compare until every untested pair lies inside one component."""
        left = np.ones(len(self.total), dtype=bool)
        while True:
            seen, n = np.unique(self.label[left], return_counts=True)
            if len(seen) < 2:
                return
            i = int(np.flatnonzero(left & (self.label != seen[np.argmax(n)]))[0])
            self.compare(i)
            left[i] = False


def node_of(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8"), usedforsecurity=False).digest()


def slice_up(docs: DataFrame) -> DataFrame:
    """``slice, docs, bytes, batch``: documents in numbered slices, each one compressed batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = task_number() << 32
        for part in tk.slices(batches, "text"):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            size = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, part.num_rows, size)] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "docs", "bytes", "batch"])
            number += 1

    return materialize(docs.mapInArrow(run, "slice long, docs long, bytes long, batch binary"), "slices", codec="uncompressed")


def documents_of(batch: bytes) -> pa.Table:
    return pa.ipc.open_stream(batch).read_all().combine_chunks()


def part_of(key: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts are ranges of shingles, so that those of one part lie close together."""
    return (((key >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int32)


def packed(key: np.ndarray) -> bytes:
    """Rising 64-bit numbers as their steps, byte by byte, which compress to what they say."""
    steps = np.diff(key, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def count_df(sliced: DataFrame, width: int, n_parts: int) -> DataFrame:
    """``slice, part, df``: the document frequencies of each slice's distinct shingles of each part, in rising order."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("slice").to_pylist(), batch.column("batch"), strict=True):
                key, n = np.unique(Shingles.of(documents_of(data.as_py()).column("text").combine_chunks(), width).key, return_counts=True)
                used, first = np.unique(part_of(key, n_parts), return_index=True)
                spans = list(zip(first, np.append(first, len(key))[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array(np.full(len(used), number)), pa.array([packed(key[i:j]) for i, j in spans], pa.binary()), pa.array([n[i:j].astype(np.uint32).tobytes() for i, j in spans], pa.binary())],
                    names=["part", "slice", "shingles", "counts"],
                )

    def add(group: pa.Table) -> pa.Table:
        shingles = [unpacked(x) for x in group.column("shingles").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(shingles), return_inverse=True)
        df = np.minimum(np.bincount(at, counts), (1 << 32) - 1).astype(np.uint32)[at]
        ends = np.cumsum([len(x) for x in shingles])
        return pa.table({"slice": group.column("slice"), "part": group.column("part"), "df": pa.array([x.tobytes() for x in np.split(df, ends[:-1])], pa.binary())})

    sent = sliced.select("slice", "batch").mapInArrow(send, "part int, slice long, shingles binary, counts binary")
    return sent.groupBy("part").applyInArrow(add, "slice long, part int, df binary")


def bit_filter(nodes: DataFrame) -> np.ndarray:
    """A fixed-size table of bits that has every node's bit set.  It only spares work: rows whose bit is
    set go on to an exact join, and a full table would send all rows there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column("node").to_pylist())] = True
        yield pa.RecordBatch.from_arrays([pa.array([task_number()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "vector"])

    marks = materialize(nodes.select("node").coalesce(16).mapInArrow(run, "part long, vector binary"), "bits")
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in marks.select("vector").toLocalIterator():  # at most 16 rows of 1 MB
        out |= np.frombuffer(row["vector"], np.uint8)
    return np.unpackbits(out).view(bool)


def _bit(nodes: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(nodes), dtype="<u8")[::2] % np.uint64(FILTER_BITS)).astype(np.int64)


def with_node(docs: DataFrame, text_col: str, node: str, maybe: str | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """``docs`` with the node of each text and, for a filter, whether its bit is set."""
    spark = docs.sparkSession
    out = docs.withColumn(node, F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    if bits is None:
        return out
    sent = spark.sparkContext.broadcast(bits)
    out = out.withColumn(maybe, F.lit(None).cast("boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = sent.value[_bit(batch.column(node).to_pylist())]
                yield batch.set_column(batch.schema.get_field_index(maybe), pa.field(maybe, pa.bool_()), pa.array(got))

    return out.mapInArrow(run, out.schema)


class NearDuplicates:
    """The classes of one corpus."""

    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", config: DedupConfig = DedupConfig()):
        self.docs, self.text_col, self.id_col, self.c = docs, text_col, id_col, config
        self.spark = docs.sparkSession
        sliced = slice_up(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
        size = sliced.agg(F.sum("docs").alias("n"), F.sum("bytes").alias("bytes")).first()
        self.total = size["n"] or 0
        self.signatures = materialize(self._sign(sliced, -(-(size["bytes"] or 0) // PART_BYTES) or 1), "signatures")
        discard(sliced)
        release(self.spark)
        self.comps = self._link()
        discard(self.texts)

    def _sign(self, sliced: DataFrame, n_parts: int) -> DataFrame:
        """``doc_id, node, keys, df``: band keys, and the frequencies of the sorted distinct shingles."""
        total, c = self.total, self.c
        schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("keys", pa.list_(pa.int64())), ("df", pa.binary())])

        def run(group: pa.Table) -> pa.Table:
            counted = group.filter(group.column("part").is_valid()).sort_by("part")
            rows = documents_of(group.filter(group.column("part").is_null()).column("batch")[0].as_py())
            whole = Shingles.of(rows.column("text").combine_chunks(), c.shingle)
            key = np.unique(whole.key)
            frequency = np.frombuffer(b"".join(counted.column("df").to_pylist()), np.uint32)
            df = frequency[np.searchsorted(key, whole.key)]
            keys = bands(whole, whole.weigh(df, total), c)
            filled = np.isin(np.arange(whole.n_docs), whole.doc)
            lists = [k.tolist() if f else [] for k, f in zip(keys.view(np.int64), filled, strict=True)]
            nodes = [node_of(t) for t in rows.column("text").to_pylist()]
            own = [x.tobytes() for x in np.split(df, np.searchsorted(whole.doc, np.arange(1, whole.n_docs)))]
            return pa.table({"doc_id": rows.column("doc_id"), "node": pa.array(nodes, pa.binary()), "keys": pa.array(lists, pa.list_(pa.int64())), "df": pa.array(own, pa.binary())}, schema=schema)

        absent = F.lit(None)
        rows = sliced.select("slice", "batch", absent.cast("int").alias("part"), absent.cast("binary").alias("df"))
        counted = count_df(sliced, c.shingle, n_parts).select("slice", absent.cast("binary").alias("batch"), "part", "df")
        return rows.unionByName(counted).groupBy("slice").applyInArrow(run, "doc_id long, node binary, keys array<long>, df binary")

    def _link(self) -> DataFrame:
        """``node, comp`` of every text that has a verified link."""
        c = self.c
        texts = self.signatures.select("node", "keys", F.octet_length("df").alias("bytes")).dropDuplicates(["node"])
        members, buckets = self._bucketed(texts.select("node", "bytes", F.posexplode("keys").alias("band", "key")))
        candidates = members.select("node").distinct()
        bits = bit_filter(candidates)
        maybe = with_node(self.docs.select(F.col(self.text_col).cast("string").alias("text")), "text", "node", "maybe", bits).filter("maybe").select("node", "text")
        known = self.signatures.select("node", "df").join(candidates, "node", "left_semi").dropDuplicates(["node"])
        self.texts = materialize(maybe.join(candidates, "node", "left_semi").dropDuplicates(["node"]).join(known, "node"), "texts")
        comps, now, apart = self._search(members, buckets, None)
        if apart is None:
            return comps
        left, right, sizes = self._by_base(now, apart, buckets)
        many = sizes.filter(F.col("blocks") > MOST_BLOCKS)
        comps = self._merge(comps, self._compare_apart(left, right, sizes.filter(F.col("blocks") <= MOST_BLOCKS)))
        if many.head(1):
            nodes = right.join(many.select("base"), "base", "left_semi").select("node").distinct()
            members, buckets = self._bucketed(self._prefixes(nodes))
            comps, now, apart = self._search(members, buckets, comps)
            if apart is not None:
                comps = self._merge(comps, self._compare_apart(*self._by_base(now, apart, buckets)))
        return comps

    def _bucketed(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of ``node, bytes, band, key``: the members of the keys that several nodes have, and one row per such key."""
        many = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("set"), F.min("band").alias("band")).filter("n > 1")
        # bands often gather the very same texts: one bucket stands for all of them
        once = many.groupBy("n", "lo", "hi", "set").agg(F.min(F.struct("band", "key")).alias("first"), F.max("bytes").alias("bytes"))
        chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("bytes") / (4 * CHUNK_SHINGLES))).cast("int")
        buckets = materialize(once.select(F.col("first.key").alias("key"), F.col("first.band").alias("band"), "n", chunks.alias("chunks")), "buckets")
        return materialize(self._of_bucket(rows.select("node", "bytes", "key"), buckets, buckets), "members"), buckets

    def _of_bucket(self, rows: DataFrame, per_key: DataFrame, buckets: DataFrame) -> DataFrame:
        """``rows`` joined with a table that has at most one row per bucket; no hot bucket's rows meet in one task."""
        whole = buckets.agg(F.max("n"), F.sum("n")).first()
        hot = max(HOT_ROWS, (whole[1] or 0) // 1000)
        if (whole[0] or 0) <= hot:
            return rows.join(per_key, "key")
        return spread_join(rows, per_key, "key", buckets.filter(F.col("n") > hot).select("key"))

    def _search(self, members: DataFrame, buckets: DataFrame, comps: DataFrame | None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Components after a search of all chunks and of a few pivots; of buckets of several chunks all members,
        and those that are still apart from the base, which is the component of most of their bucket."""
        named = self._named_members(members, comps)
        if comps is not None:
            several = named.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("several")).filter("several").select("key")
            named = materialize(self._of_bucket(named, several, buckets), "named")
        large = named.filter("chunks > 1")
        slot = F.pmod(F.xxhash64("node"), F.lit(FEW_PIVOTS))
        pivots = large.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "comp", "chunks")).alias("p")).select("key", "p.*")
        comps = self._merge(comps, self._compare(pivots, named))
        if not buckets.filter("chunks > 1").head(1):
            return comps, None, None
        now = materialize(self._named_members(large.drop("comp"), comps), "named")
        size = now.groupBy("key", "comp").agg(F.count("*").alias("n"))
        base = size.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("base"), F.count("*").alias("comps")).filter("comps > 1").drop("comps")
        apart = materialize(self._of_bucket(now, base, buckets).filter("comp <> base"), "apart")
        return comps, now, apart if apart.head(1) else None

    def _named_members(self, members: DataFrame, comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return members.select("key", "node", "bytes", "chunks", F.col("node").alias("comp"))
        return members.join(comps, "node", "left").select("key", "node", "bytes", "chunks", F.coalesce("comp", "node").alias("comp"))

    def _compare(self, pivots: DataFrame, members: DataFrame) -> DataFrame:
        """Links of members with those of their chunk, and with the pivots of their bucket."""
        chunk = F.pmod(F.xxhash64("node", "key"), F.col("chunks"))
        dealt = members.select("key", chunk.cast("int").alias("chunk"), "node", "comp").join(self.texts, "node")
        sent = pivots.join(self.texts, "node").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "comp", "text", "df")
        tasks = dealt.unionByName(sent).withColumn("pivot", F.lit(False))
        return materialize(tasks.groupBy("key", "chunk").applyInArrow(self._verifier(among_all=True), "a binary, b binary"), "links")

    def _by_base(self, now: DataFrame, apart: DataFrame, buckets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``base, node, comp`` of what is apart and of all members of the buckets it is in, and one row per
        base: how many chunks each has."""
        left = materialize(apart.select("base", "node", "comp", "bytes").distinct(), "left")
        right = materialize(self._of_bucket(now, apart.groupBy("key").agg(F.first("base").alias("base")), buckets).select("base", "node", "comp", "bytes").distinct(), "right")
        chunks = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / (4 * CHUNK_SHINGLES))).cast("int")
        sizes = left.groupBy("base").agg(chunks.alias("blocks")).join(right.groupBy("base").agg(chunks.alias("chunks"), F.count("*").alias("n")), "base")
        return left, right, materialize(sizes, "bases")

    def _compare_apart(self, left: DataFrame, right: DataFrame, sizes: DataFrame) -> DataFrame:
        """Links of all that is apart from a base with all members of its buckets.

        Both sides are dealt in chunks, and every chunk of the first meets every chunk of the second once.
        """
        block, chunk = (F.pmod(F.xxhash64("node", "base"), F.col(c)).cast("int") for c in ("blocks", "chunks"))
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        hot = sizes.filter(F.col("n") > max(HOT_ROWS, self.total // 1000)).select("base")
        meet = lambda rows: spread_join(rows, sizes.select("base", "blocks", "chunks"), "base", hot).join(self.texts, "node")
        one = meet(left).select("base", others("chunks").alias("chunk"), block.alias("block"), "node", "comp", F.lit(True).alias("pivot"), "text", "df")
        two = meet(right).select("base", chunk.alias("chunk"), others("blocks").alias("block"), "node", "comp", F.lit(False).alias("pivot"), "text", "df")
        return materialize(one.unionByName(two).groupBy("base", "chunk", "block").applyInArrow(self._verifier(among_all=False), "a binary, b binary"), "links")

    def _shingled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Shingles, np.ndarray, np.ndarray]]:
        """Slices of ``text, df`` with their shingles, weights and frequencies."""
        for part in tk.slices(batches, "text"):
            s = Shingles.of(part.column("text"), self.c.shingle)
            df = np.frombuffer(b"".join(part.column("df").to_pylist()), np.uint32)
            yield part, s, s.weigh(df, self.total), df

    def _verifier(self, among_all: bool):
        shingled, threshold = self._kernel()._shingled, self.c.threshold

        def verify(group: pa.Table) -> pa.Table:
            seen: dict[bytes, int] = {}
            vectors, comps, pivots = [], [], []
            for part, s, weight, _ in shingled(iter(group.combine_chunks().to_batches())):
                cuts = np.searchsorted(s.doc, np.arange(s.n_docs + 1))
                for k, (node, comp, pivot) in enumerate(zip(*(part.column(x).to_pylist() for x in ("node", "comp", "pivot")), strict=True)):
                    if node not in seen:
                        seen[node] = len(vectors)
                        vectors.append((s.key[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]))
                        comps.append(comp)
                    if pivot:
                        pivots.append(seen[node])
            search = Search(vectors, comps, threshold)
            if among_all:
                search.among_all()
            else:
                for i in sorted(set(pivots)):
                    search.compare(i)
            nodes = list(seen)
            return pa.table({"a": pa.array([nodes[i] for i, _ in search.links], pa.binary()), "b": pa.array([nodes[j] for _, j in search.links], pa.binary())})

        return verify

    def _prefixes(self, nodes: DataFrame) -> DataFrame:
        """``node, bytes, band, key``: the texts' rarest shingles, one of which any two similar ones share."""
        shingled, threshold = self._kernel()._shingled, self.c.threshold
        schema = pa.schema([("node", pa.binary()), ("bytes", pa.int32()), ("band", pa.int32()), ("key", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, s, weight, df in shingled(batches):
                doc, key = prefix(s, weight, df, threshold)
                size = pa.array(4 * np.bincount(s.doc, minlength=s.n_docs)[doc], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(doc)), size, pa.array(np.zeros(len(doc)), pa.int32()), pa.array(key.view(np.int64))], schema=schema)

        found = self.texts.join(nodes, "node", "left_semi").mapInArrow(run, "node binary, bytes int, band int, key long")
        return materialize(found, "prefixes")

    def _kernel(self) -> NearDuplicates:
        """What tasks need of this object."""
        out = object.__new__(NearDuplicates)
        out.total, out.c = self.total, self.c
        return out

    def _merge(self, comps: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components after more links: their graph is over the components so far."""
        if comps is None:
            return components(links)
        old = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        return components(old.unionByName(links))

    def classes(self) -> DataFrame:
        """``doc_id, class_id, class_size``: one row per document."""
        named = self._named()
        sizes = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
        return named.join(materialize(sizes, "classes"), "comp").select("doc_id", "class_id", "class_size")

    def _named(self) -> DataFrame:
        rows = self.signatures.select("doc_id", "node").join(self.comps, "node", "left")
        return materialize(rows.select("doc_id", "node", F.coalesce("comp", "node").alias("comp")), "named")

    def keep_one(self) -> DataFrame:
        """One document of every class, the one of least id, with its own columns.

        Documents alone in their class, which a bit table tells from the others, pass without a shuffle.
        """
        columns = self.docs.columns
        node, maybe, id_key = (fresh(columns, x) for x in ("node", "maybe", "id_key"))
        named = self._named()
        first = named.groupBy("comp").agg(F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node")).alias("first")).filter("size > 1")
        kept = materialize(first.select("comp", F.col("first.node").alias(node), F.col("first.doc_id").alias(id_key)), "kept")
        crowded = named.join(kept.select("comp"), "comp", "left_semi").select("node").distinct()
        bits = bit_filter(materialize(crowded, "crowded"))
        flagged = with_node(self.docs, self.text_col, node, maybe, bits)
        alone = flagged.filter(~F.col(maybe)).select(*columns)
        rest = flagged.filter(maybe).drop(maybe)
        in_class = materialize(crowded.withColumnRenamed("node", node), "crowded")
        false_alarms = rest.join(in_class, node, "left_anti").select(*columns)
        own = rest[self.id_col].cast("long")
        chosen = rest.join(kept.drop("comp").withColumnRenamed(node, f"{node}_kept"), (rest[node] == F.col(f"{node}_kept")) & own.eqNullSafe(F.col(id_key)))
        single = chosen.dropDuplicates([node]).select(*columns)
        return alone.unionByName(false_alarms).unionByName(single)
