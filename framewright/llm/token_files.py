"""Token-id files: canonical length-limited Huffman blocks in ascending document order.

A corpus folder has two Parquet tables.  ``code`` has one row: the code length of every id, from
counts over all documents.  ``blocks`` has one row per block, and the block itself is a binary of
its own format: a header, the documents' ids, null marks, token counts, the bit offset of every
512th id, and the coded bits.  A block decodes without any other block; its stretches between
offsets decode without each other.  Blocks of a shard ascend by document id, and shards ascend.

Documents with null ids come first; equal ids are ordered by the checksum of their tokens; repeated
rows are kept.  Null text counts as empty: only the end id.  An empty corpus gives empty files.

Scale: text is encoded once.  Only coded documents are shuffled, into shards bounded by quantiles
of the document ids; an id that fills several shards is dealt among them by checksum.  The driver sees one
histogram (summed in a tree) and one row for each of at most ``MOST_SHARDS`` shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe
from framewright.llm import textkernels as tk
from framewright.llm.huffman import STRETCH, Code, code_lengths
from framewright.llm.reduce import task_number, tree_sum
from framewright.llm.scratch import materialize, new_path

MAGIC = b"FWTB0001"
HEADER = struct.Struct("<8sIIIIQ")
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
#: Ids that a shard, the unit of writing, is dealt on average.
SHARD_IDS = 4 << 20
#: Shards of one folder; a larger corpus has larger shards, which are sorted and written as streams.
MOST_SHARDS = 10_000
#: Pieces that the encoder keeps from one task to the next, some 100 MB.
KEPT_PIECES = 400_000
#: Coded bytes that are decoded together.
DECODE_BYTES = 8 << 20


def _encode_corpus(docs: DataFrame, path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Rows of ids with their checksum, and one row per task with its counts."""
    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("payload", pa.binary())])
    narrow = _narrow(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype=np.int64)
        end = np.array([end_id], dtype="<u4")
        with bpe.encoder(path, half=None, kept=KEPT_PIECES) as codec:
            for part in tk.slices(batches, "text", bpe.ENCODE_BYTES):
                whole = [np.concatenate([x, end]) for x in codec.encode_column(part.column("text"))]
                ids = np.concatenate(whole)
                counts += np.bincount(ids, minlength=vocabulary)
                sizes = np.array([len(x) for x in whole], dtype=np.int64)
                crc = pa.array([zlib.crc32(x) for x in whole], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["ids"] * len(whole)), part.column("doc_id"), pa.array(sizes), crc, _ragged(ids.astype(narrow), sizes)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(["counts"]), pa.array([task_number()], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary())], schema=schema)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return picked.mapInArrow(run, "kind string, doc_id long, n_tokens long, crc long, payload binary")


#: Where null ids stand.
NULL_ID = -(1 << 63)


def shard_of(ids: np.ndarray, crc: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Shards that ascend with (id, checksum): an id that fills several is dealt among them by checksum."""
    first, last = np.searchsorted(edges, ids, "left"), np.searchsorted(edges, ids, "right")
    return (first + ((crc * (last - first + 1)) >> 32)).astype(np.int32)


def _narrow(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of an array as binaries, without a copy."""
    ends = (np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def pack_block(doc_ids: list[int | None], parts: list[tuple[bytes, np.ndarray, int]]) -> bytes:
    """One block from documents in order, each coded on its own from a whole byte on."""
    n_tokens = np.array([p[2] for p in parts], dtype="<u8")
    begins = np.cumsum([0, *(len(p[0]) for p in parts)])
    marks = np.concatenate([p[1] + 8 * begin for p, begin in zip(parts, begins[:-1], strict=True)]).astype("<u8")
    nulls = np.packbits([d is None for d in doc_ids]).tobytes()
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    body = ids.tobytes() + nulls + n_tokens.tobytes() + marks.tobytes() + b"".join(p[0] for p in parts)
    return HEADER.pack(MAGIC, len(doc_ids), len(marks), STRETCH, zlib.crc32(body), int(begins[-1])) + body


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, token counts, bit offsets, ids per stretch, coded bytes)."""
    magic, n_docs, n_marks, stretch, crc, size = HEADER.unpack_from(block)
    if magic != MAGIC or zlib.crc32(memoryview(block)[HEADER.size :]) != crc:
        raise ValueError("a damaged block, or none of this format")
    at = HEADER.size
    ids = np.frombuffer(block, "<i8", n_docs, at)
    at += 8 * n_docs
    nulls = np.unpackbits(np.frombuffer(block, np.uint8, -(-n_docs // 8), at))[:n_docs]
    at += -(-n_docs // 8)
    n_tokens = np.frombuffer(block, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    marks = np.frombuffer(block, "<u8", n_marks, at).astype(np.int64)
    at += 8 * n_marks
    each = -(-n_tokens // stretch)
    counts = np.full(n_marks, stretch, dtype=np.int64)
    last = np.cumsum(each) - 1
    counts[last] = n_tokens - (each - 1) * stretch
    return [None if null else int(d) for d, null in zip(ids, nulls, strict=True)], n_tokens, marks, counts, np.frombuffer(block, np.uint8, size, at)


def write_corpus(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, vocabulary: int, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (``doc_id, text``) and write the folder's tables."""
    spark = docs.sparkSession
    encoded = materialize(_encode_corpus(docs, tokenizer_path, end_id, vocabulary), "ids")
    counts = tree_sum(encoded.filter("kind = 'counts'").select(F.col("doc_id").alias("part"), F.col("payload").alias("vector")))
    if counts is None:
        counts = np.zeros(vocabulary, dtype=np.int64)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), int(counts.sum()))], "lengths binary, n_tokens long").coalesce(1).write.parquet(f"{folder}/code")
    shards = min(MOST_SHARDS, max(1, -(-int(counts.sum()) // shard_ids)))
    ids = encoded.filter("kind = 'ids'")
    at = [k / shards for k in range(1, shards)]
    place = F.coalesce("doc_id", F.lit(NULL_ID))
    bounds = (ids.agg(F.percentile_approx(place, F.array(*map(F.lit, at)), 100 * shards)).first()[0] or []) if at else []
    sent = spark.sparkContext.broadcast((lengths.tobytes(), np.array(bounds, dtype=np.int64)))
    narrow = _narrow(vocabulary)
    coded_schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n_tokens", pa.int64()), ("coded", pa.binary()), ("marks", pa.binary())])
    block_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("tokens_before", pa.int64()), ("data", pa.binary())])

    def code_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, edges = Code(np.frombuffer(sent.value[0], dtype=np.uint8)), sent.value[1]
        for part in tk.slices(batches, "payload"):
            size = part.column("n_tokens").to_numpy()
            data, offsets = tk.text_bytes(part.column("payload"))
            coded, n_bytes, marks, n_marks = code.encode_many(np.frombuffer(data.tobytes(), dtype=narrow), size)
            shard = shard_of(part.column("doc_id").fill_null(NULL_ID).to_numpy(), part.column("crc").to_numpy(), edges)
            yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("doc_id"), part.column("crc"), part.column("n_tokens"), _ragged(coded, n_bytes), _ragged(marks.astype("<u8"), n_marks)], schema=coded_schema)

    def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, held = None, 0, 0, []

        def close() -> pa.RecordBatch:
            n = sum(p[2] for _, p in held)
            data = pack_block([d for d, _ in held], [p for _, p in held])
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64()), pa.array([before], pa.int64()), pa.array([data], pa.binary())], schema=block_schema)

        size = 0
        for batch in batches:
            for own, doc_id, n, coded, marks in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n_tokens", "coded", "marks")), strict=True):
                if held and (own != shard or size >= block_ids):
                    yield close()
                    block, before, size, held = block + 1, before + size, 0, []
                if own != shard:
                    shard, block, before = own, 0, 0
                held.append((doc_id, (coded, np.frombuffer(marks, dtype="<u8").astype(np.int64), n)))
                size += n
        if held:
            yield close()

    coded = ids.select("doc_id", "n_tokens", "crc", "payload").mapInArrow(code_documents, "shard int, doc_id long, crc long, n_tokens long, coded binary, marks binary")
    blocks = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc", "n_tokens").mapInArrow(build_blocks, "shard int, block int, n_docs long, n_tokens long, tokens_before long, data binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document's ids, and how many ids come before them."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from decoded ids."""
    return _read(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32")


def _read(spark: SparkSession, folder: str, schema: str, value, kind: pa.DataType, name: str) -> DataFrame:
    lengths = spark.read.parquet(f"{folder}/code").first()["lengths"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before, starts = 0, {}
    for shard, n in totals:
        starts[shard], before = before, before + n
    sent = spark.sparkContext.broadcast((bytes(lengths), starts))
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, starts = Code(np.frombuffer(sent.value[0], dtype=np.uint8)), sent.value[1]
        for part in tk.slices(batches, "data", DECODE_BYTES):
            unpacked = [unpack_block(x) for x in part.column("data").to_pylist()]
            begins = np.cumsum([0, *(len(u[4]) for u in unpacked)])
            offsets = np.concatenate([u[2] + 8 * b for u, b in zip(unpacked, begins[:-1], strict=True)])
            ids = code.decode(np.concatenate([u[4] for u in unpacked]), offsets, np.concatenate([u[3] for u in unpacked]))
            sizes = np.concatenate([u[1] for u in unpacked])
            stops = np.cumsum(sizes)
            first = [starts[s] + b for s, b in zip(part.column("shard").to_pylist(), part.column("tokens_before").to_pylist(), strict=True)]
            start = np.concatenate([f + np.cumsum(u[1]) - u[1] for f, u in zip(first, unpacked, strict=True)])
            docs = [d for u in unpacked for d in u[0]]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(sizes), pa.array([value(ids[b - n : b]) for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)], kind)], schema=arrow)

    return blocks.select("shard", "tokens_before", "data").mapInArrow(decode, schema)


def store_and_check(docs: DataFrame, tokenizer_path: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write ``docs`` to a folder of the shared scratch space and return what its files hold."""
    folder = new_path(docs.sparkSession, "tokens")
    write_corpus(docs, tokenizer_path, folder, end_id, vocabulary)
    return read_checksums(docs.sparkSession, folder)
