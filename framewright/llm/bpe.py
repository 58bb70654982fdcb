"""Byte-level BPE encoding and decoding, exact with the tokenizers library.

Long text is encoded by tree concatenation, in two places.  A text of more than ``half`` bytes is halved,
and its halves again, at whatever characters that gives; the leaves of all texts of a slice are encoded in one
batch.  At each join a window of the neighbouring tokens is re-encoded by the library and grown until it begins
and ends where the pre-tokeniser always cuts and agrees with the left side's own first token there and with the
right side's own last one.  What lies outside such a window does not depend on what lies inside.  A stretch that the
pre-tokeniser leaves unsplit and that is longer than ``leaf`` bytes is treated likewise without cuts: its
window grows until its first and last tokens are the sides' own, and then every adjacent pair of the joined
tokens is one that BPE itself leaves unmerged, so that the whole equals the encoding of the unsplit stretch.

Leaves are cut into pieces where the pre-tokeniser always cuts: before a space or a line feed that follows
a character that is no white space, and between letters, digits and marks of ASCII.  Each distinct piece is encoded by the library once per worker
and kept in a bounded table.

Ids are little-endian unsigned 32-bit integers.  Null text counts as empty and has no ids; repeated
rows give repeated results; special tokens spelled out in a text are encoded as the library does by
default.  Memory follows the longest text, not the number of rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import textkernels as tk
from framewright.llm.columns import fresh

#: A table of this many pieces takes about 250 MB.
TABLE_SIZE = 1_000_000
#: Pieces that are kept from one task to the next.
KEPT = 100_000
#: Bytes of text that are encoded together.
ENCODE_BYTES = 4 << 20
LEAF_BYTES = 2048
#: Bytes of a text beyond which it is halved.
HALF_BYTES = 1 << 14
#: Halves meet anywhere if there is a space or line feed to widen a window to within so many bytes on both sides ...
NEAR_BYTES = 2048
#: ... and farther off than these, which the first windows span.
FIRST_BYTES = 128

#: The pre-tokeniser's pattern; a fixed value of byte-level BPE.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Cuts(list):
    """Where leaves start, and which of these are sure cuts."""

    def __init__(self, cuts: list[int]):
        super().__init__(cuts)
        self.sure: set[int] = set()


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF_BYTES, table_size: int = TABLE_SIZE, half: int | None = HALF_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.check_split()
        self.library.no_truncation()
        self.library.no_padding()
        self.unsplit = Tokenizer.from_file(path)
        self.unsplit.no_truncation()
        self.unsplit.no_padding()
        self.unsplit.pre_tokenizer = pre_tokenizers.Sequence([])
        self.leaf, self.table_size, self.half = leaf, table_size, half
        self.joins = 0
        self.widest = 0  # bytes of the widest window that was re-encoded
        self.table: dict[bytes, bytes | bool] = {}
        self.sure: dict[bytes, bytes | bool] = {}
        self.to_char = byte_characters()
        to_byte = {c: b for b, c in self.to_char.items()}
        added = self.library.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.special = regex.compile("|".join(regex.escape(t.content) for t in sorted(added.values(), key=lambda t: -len(t.content)))) if added else None
        self.special_bytes = re.compile(b"|".join(re.escape(t.content.encode()) for t in added.values())) if added else None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            spelled[k] = token.encode() if k in added else bytes(to_byte[c] for c in token)
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.spelled_len = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        safe = {ord(c) for c in SAFE}
        self.ends_safe = np.array([len(x) > 0 and x[-1] in safe for x in spelled])
        self.starts_cut = np.array([x[:1] in (b" ", b"\n") for x in spelled])

    # encoding

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text, as bytes."""
        return [ids.tobytes() for ids in self.encode_column(pa.array(texts, pa.string()))]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, long ones by tree concatenation."""
        data, offsets = tk.text_bytes(texts)
        cuts = [self.leaf_cuts(data, a, b) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        leaves = self.encode_leaves(data, np.array([*(c for own in cuts for c in own), len(data)], dtype=np.int64))
        out, at = [], 0
        for own in cuts:
            level = list(zip(leaves[at : at + len(own)], own, strict=True))
            at += len(own)
            while len(level) > 1:
                pairs = zip(level[::2], level[1::2], strict=False)
                level = [(np.concatenate([a, b]) if start in own.sure else self.join_halves(a, b), first) for (a, first), (b, start) in pairs] + level[len(level) & ~1 :]
            out.append(level[0][0])
        return out

    def check_split(self) -> None:
        """Raise unless the vocabulary file splits texts as ``SPLIT`` does and changes nothing in them."""
        file = json.loads(self.library.to_str())
        split = file["pre_tokenizer"] or {}
        if file["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("the vocabulary is not of byte-level BPE with the usual pre-tokeniser and no normaliser")

    def leaf_cuts(self, data: np.ndarray, start: int, end: int) -> Cuts:
        """Where the leaves of a text's tree of halves start: a power of two of them, none much longer than ``half``.

        A cut stays where the halves meet if windows around it can be widened to a near space or line feed on
        either side.  Elsewhere it moves on to the next sure cut of the pre-tokeniser, where encodings only have
        to be put together.  An unsplit stretch has none: it stays within one leaf, and :meth:`tree` halves it.
        """
        count = 1
        while self.half is not None and end - start > self.half * count:
            count *= 2
        out = Cuts([start])
        clear = start  # up to here there is no sure cut
        for k in range(1, count):
            at = start + (end - start) * k // count
            while at < end and data[at] & 0xC0 == 0x80:  # inside a character
                at += 1
            if self.within_reach(data, start, at, end):
                if out[-1] < at < end:
                    out.append(at)
            elif at > clear:
                clear = self.next_sure_cut(data, start, at, end)
                if out[-1] < clear < end:
                    out.append(clear)
                    out.sure.add(clear)
        return out

    def within_reach(self, data: np.ndarray, start: int, at: int, end: int) -> bool:
        """Whether both sides of a place have an end or a safe cut that is near, but not too near."""
        left = at - start <= NEAR_BYTES or SAFE_CUT.search(data[at - NEAR_BYTES : at - FIRST_BYTES].tobytes())
        return bool(left) and bool(end - at <= NEAR_BYTES or SAFE_CUT.search(data[at + FIRST_BYTES : at + NEAR_BYTES].tobytes()))

    def next_sure_cut(self, data: np.ndarray, start: int, at: int, end: int) -> int:
        """The first place from ``at`` where the pre-tokeniser cuts whatever is around it; ``end`` if there is none."""
        margin = max((len(x.encode()) for x in self.specials), default=0) + 4
        size = NEAR_BYTES
        while True:
            before, stop = max(start, at - margin), min(end, at + size + margin)
            raw = data[before:stop].tobytes()
            inside = [m.span() for m in self.special_bytes.finditer(raw)] if self.special_bytes else []
            text = raw.decode("utf-8", "ignore")  # a character cut off at either side is left out
            skipped = next(k for k in range(4) if k == len(raw) or raw[k] & 0xC0 != 0x80)
            spots = (m.start() for m in SURE_CUT.finditer(text))
            known, done = 0, skipped
            for spot in spots:
                done += len(text[known:spot].encode())
                known = spot
                if before + done >= at and (stop == end or before + done <= stop - margin) and not any(a < done < b for a, b in inside):
                    return before + done
            if stop == end:
                return end
            size *= 2

    def join_halves(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encoded halves of a text."""
        self.joins += 1
        reach = 8
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            while a > 0 and not self.is_cut(left[a - 1], left[a]):
                a -= 1
            while b < len(right) and not self.is_cut(right[b - 1], right[b]):
                b += 1
            raw = self.decode_bytes(np.concatenate([left[a:], right[:b]]))
            self.widest = max(self.widest, len(raw))
            window = raw.decode("utf-8")
            ids = np.array(self.library.encode(window, add_special_tokens=False).ids, dtype="<u4")
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return np.concatenate([left[:a], ids, right[b:]])
            reach *= 2

    def is_cut(self, before: int, after: int) -> bool:
        """Whether the pre-tokeniser cuts between these tokens whatever is around them."""
        return bool(self.ends_safe[before] and self.starts_cut[after])

    def encode_leaves(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of every stretch between bounds, from its pieces.

        Pieces begin with spaces and line feeds and where letters, digits and marks of ASCII meet.  Equal ones are
        found by whole-array operations, so that the table is asked once for each distinct piece of a
        slice.  Stretches with a piece whose last character leaves the cut after it in doubt, or with a special
        token, are cut with care.
        """
        starts_piece = (data == 32) | (data == 10)
        starts_piece[1:] |= CUT_BETWEEN[CLASS_OF[data[:-1]] * np.uint8(5) + CLASS_OF[data[1:]]]
        full = np.flatnonzero(np.diff(bounds))
        starts_piece[bounds[full]] = True
        start = np.flatnonzero(starts_piece)
        end = np.append(start[1:], len(data))[: len(start)]
        raw = data.tobytes()
        first, same = distinct_spans(data, raw, start, end)
        paused = gc.isenabled()
        gc.disable()  # many small objects and no cycles; collections would walk the whole table
        try:
            for table in (self.table, self.sure):
                if len(table) > self.table_size:
                    table.clear()
            values = self.looked_up([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], self.table)
            doubtful = np.array([v is DOUBTFUL for v in values], dtype=bool)
            size = np.array([0 if v is DOUBTFUL else len(v) // 4 for v in values], dtype=np.int64)
            flat = np.frombuffer(b"".join([v for v in values if v is not DOUBTFUL]), dtype="<u4")
            count = size[same]
            upto = np.concatenate([[0], np.cumsum(count)])
            ids = flat[np.repeat((np.cumsum(size) - size)[same] - upto[:-1], count) + np.arange(upto[-1])]
            places = np.searchsorted(start, bounds)
            out = [ids[a:b] for a, b in zip(upto[places[:-1]].tolist(), upto[places[1:]].tolist(), strict=True)]
            special = [m.start() for m in self.special_bytes.finditer(raw)] if self.special else []
            careful = np.unique(np.searchsorted(bounds, np.concatenate([start[doubtful[same]], np.array(special, dtype=np.int64)]), "right") - 1)
            for k in careful.tolist():
                pieces = [x.encode() for x in _CUT.split(raw[bounds[k] : bounds[k + 1]].decode("utf-8"))]
                out[k] = np.frombuffer(b"".join(self.looked_up(pieces, self.sure)), dtype="<u4")
        finally:
            if paused:
                gc.enable()
        return out

    def looked_up(self, keys: list[bytes], table: dict[bytes, bytes | bool]) -> list[bytes | bool]:
        """A table's values, new ones learned first; long keys are not kept."""
        values = list(map(table.get, keys))
        if None in values:
            missing = [k for k, v in enumerate(values) if v is None]
            new = list({keys[k] for k in missing})
            self.learn(new, table)
            for k in missing:
                values[k] = table[keys[k]]
            for key in new:
                if len(key) > LONGEST_KEPT:
                    table.pop(key, None)
        return values

    def learn(self, keys: list[bytes], table: dict[bytes, bytes | bool]) -> None:
        """Encode pieces that the table lacks; in ``self.table`` those without a sure cut after them are doubtful."""
        words = [k for k in keys if k[:1] == b" " and k[1:].isalpha() and len(k) <= self.leaf]
        spelled = [self.to_char[32] + k[1:].decode() for k in words]
        accented = [k for k in keys if k[:1] == b" " and not k.isascii() and len(k) <= self.leaf and k[1:].decode("utf-8").isalpha()]
        spelled += [k.decode("latin-1").translate(self.to_char) for k in accented]
        table.update(zip(words + accented, self._batch(spelled), strict=True))
        number: dict[str, int] = {}
        waiting: list[tuple[bytes, list[int]]] = []
        for key in keys:
            if key in table:
                continue
            text = key.decode("utf-8")
            if table is self.table and text[-1] not in SAFE and not SAFE_END.search(text):
                table[key] = DOUBTFUL
            elif table is self.sure and self.special and self.special.search(text):
                table[key] = np.array(self.with_specials(text), dtype="<u4").tobytes()
            else:
                body = text[1:] if text[0] == " " else text
                waiting.append((key, [number.setdefault(w, len(number)) for w in ([text] if body.isalpha() else SPLIT.findall(text))]))
        encoded = self.encode_words(list(number))
        for key, parts in waiting:
            table[key] = encoded[parts[0]] if len(parts) == 1 else b"".join([encoded[k] for k in parts])

    def with_specials(self, text: str) -> list[int]:
        """A piece that spells out special tokens; what lies between them is pre-tokenised apart."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._between(text[at : m.start()])
            out.append(self.library.token_to_id(m.group()))
            at = m.end()
        return out + self._between(text[at:])

    def _between(self, text: str) -> list[int]:
        words = SPLIT.findall(text)
        return np.frombuffer(b"".join(self.encode_words(words)), dtype="<u4").tolist()

    def spell(self, word: str) -> str:
        if word.isalpha() and word.isascii():
            return word
        if word[0] == " " and word[1:].isalpha() and word.isascii():
            return self.to_char[32] + word[1:]
        return word.encode("utf-8").decode("latin-1").translate(self.to_char)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of unsplit words, long ones by tree concatenation."""
        spelled = [self.spell(w) for w in words]
        short = [s for s in spelled if len(s) <= self.leaf]
        ids = iter(self._batch(short))
        return [next(ids) if len(s) <= self.leaf else np.array(self.tree(s), dtype="<u4").tobytes() for s in spelled]

    def _batch(self, spelled: list[str], step: int = 512) -> list[bytes]:
        """Spelled words given to the library in groups, its ids dealt back by their spelled length."""
        groups = [spelled[k : k + step] for k in range(0, len(spelled), step)]
        out: list[bytes] = []
        for group, got in zip(groups, self.unsplit.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(self.spelled_len[ids]), np.cumsum([len(s) for s in group]), "left") + 1
            raw, at = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def tree(self, spelled: str) -> list[int]:
        """Ids of one long unsplit word.

        Leaves are equally long, a power of two by default, so that the leaves of a run of one character, whose
        tokens are as long as powers of two, begin in step.  Runs of longer periods may need wider windows.
        """
        cuts = [*range(0, len(spelled), self.leaf), len(spelled)]
        level = [np.frombuffer(x, dtype="<u4").tolist() for x in self._batch([spelled[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], step=1)]
        while len(level) > 1:
            level = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)] + level[len(level) & ~1 :]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' concatenation."""
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = "".join(self.library.id_to_token(k) for k in left[a:] + right[:b])
            self.widest = max(self.widest, len(window))
            ids = self.unsplit.encode(window, add_special_tokens=False).ids
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:a] + ids + right[b:]
            reach *= 2

    # decoding

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        size = self.spelled_len[ids]
        stop = np.cumsum(size)
        if not len(stop):
            return b""
        index = np.repeat(self.spelled_at[ids] - (stop - size), size) + np.arange(stop[-1])
        return self.spelled[index].tobytes()

    def decode_batch(self, ids: list[np.ndarray]) -> list[bytes]:
        """The decoded texts in UTF-8, in one pass over the ids of all."""
        whole = np.concatenate([np.zeros(0, "<u4"), *ids])
        spelled = self.decode_bytes(whole)
        sizes = np.concatenate([[0], np.cumsum(self.spelled_len[whole])])
        ends = sizes[np.cumsum([0, *map(len, ids)])].tolist()
        parts = [spelled[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode("utf-8") for x in parts]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


SAFE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?%&*$#@()[]{}<>|/+-=_\"'")
SAFE_CUT = re.compile(b"[" + re.escape("".join(sorted(SAFE))).encode() + b"][ \n]")
#: Where letters, digits and signs meet, and before spaces and line feeds; signs without the apostrophe.
SURE_CUT = regex.compile(
    r"(?V1)(?<=\p{L})(?=[\p{N}\p{P}\p{S}])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}])|(?<=[[\p{P}\p{S}]--'])(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n])"
)
#: A piece that ends so is followed by a true cut: no white space, control or separator character.
SAFE_END = regex.compile(r"[^\s\p{C}\p{Z}]\Z")
_CUT = regex.compile(r"(?V1)(?<=[^\s\p{C}\p{Z}])(?=[ \n])")
#: The table's value for a piece that is not followed by a sure cut.
DOUBTFUL = False
#: Longer pieces are not kept in the table beyond the call that needs them.
LONGEST_KEPT = 64


def distinct_spans(data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of each distinct span, which of those each span equals).

    Spans of up to 16 bytes are told apart by their first and last 8 bytes and their length, longer ones also
    by a number that a dictionary gives; a hash of these brings equal ones together and is then checked.
    """
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    head = eight[start] & EIGHT_BYTES[np.minimum(size, 8)]
    tail = np.where(size > 8, eight[np.maximum(end - 8, 0)], 0).astype(np.uint64)
    extra = size.astype(np.uint64)
    numbers: dict[bytes, int] = {}
    for k in np.flatnonzero(size > 16).tolist():
        extra[k] = (1 << 32) + numbers.setdefault(raw[start[k] : end[k]], len(numbers))
    key = tk.mix(tk.mix(head, 1) + tk.mix(tail, 2) * np.uint64(3) + extra * np.uint64(0x9E3779B97F4A7C15))
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    if not all((x[first][same] == x).all() for x in (head, tail, extra)):
        _, first, same = np.unique(np.stack([head, tail, extra]), axis=1, return_index=True, return_inverse=True)
    return first, same


#: The lowest 0 to 8 bytes of a number.
EIGHT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes (1 letters, 2 digits, 3 marks, 4 apostrophe, 0 the others), and between which classes
    the pre-tokeniser always cuts: an apostrophe may begin a contraction, so there is no cut after it."""
    of = np.zeros(256, dtype=np.uint8)
    of[33:127] = 3
    for k in range(128):
        if chr(k).isalnum():
            of[k] = 2 if chr(k).isdigit() else 1
    of[ord("'")] = 4
    cut = np.zeros((5, 5), dtype=bool)
    cut[1, 2:] = cut[2, [1, 3, 4]] = cut[3, 1:3] = True
    return of, cut.ravel()


CLASS_OF, CUT_BETWEEN = _byte_classes()


_encoders: dict[tuple[str, int, int | None], Encoder] = {}


@contextmanager
def encoder(path: str, leaf: int = LEAF_BYTES, half: int | None = HALF_BYTES, kept: int = KEPT) -> Iterator[Encoder]:
    """The worker process's encoder for a vocabulary file.

    At the end its table keeps the ``kept`` pieces that came first, the commonest among them: a worker goes on to
    other stages, which need the memory.
    """
    if (path, leaf, half) not in _encoders:
        _encoders[path, leaf, half] = Encoder(path, leaf, half=half)
    own = _encoders[path, leaf, half]
    try:
        yield own
    finally:
        own.table = dict(islice(own.table.items(), kept))
        own.sure.clear()


ENCODED = pa.struct([("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode_column(docs: DataFrame, path: str, name: str = "encoded", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name``: n_tokens and ids; raises if they have such a column."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the documents have a column {name}")
    plain = fresh(docs.columns, "plain_text")
    out = docs.withColumn(plain, F.col(text_col).cast("string")).withColumn(name, F.lit(None).cast("struct<n_tokens: long, ids: binary>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as codec:
            for part in tk.slices(batches, plain, ENCODE_BYTES):
                ids = codec.encode_column(part.column(plain))
                value = pa.StructArray.from_arrays([pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], fields=list(ENCODED))
                yield part.set_column(part.schema.get_field_index(name), pa.field(name, ENCODED), value)

    return out.mapInArrow(run, out.schema).drop(plain)


def decode_column(encoded: DataFrame, path: str, name: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a string column ``name``, the text that the binary ids stand for (null: empty)."""
    if name.lower() in (c.lower() for c in encoded.columns):
        raise ValueError(f"the table has a column {name}")
    out = encoded.withColumn(name, F.lit(None).cast("string"))
    ids_name = fresh(out.columns, "plain_ids")
    out = out.withColumn(ids_name, F.col(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as codec:
            for part in tk.slices(batches, ids_name):
                texts = [codec.decode(np.frombuffer(x or b"", dtype="<u4")) for x in part.column(ids_name).to_pylist()]
                yield part.set_column(part.schema.get_field_index(name), pa.field(name, pa.string()), pa.array(texts, pa.string()))

    return out.mapInArrow(run, out.schema).drop(ids_name)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: the number and digest of its ids, and the digest of the text they decode to.

    Both steps run in one pass, so that the ids of the corpus need no second crossing to Python.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(path) as codec:
            for part in tk.slices(batches, "text", ENCODE_BYTES):
                ids = codec.encode_column(part.column("text"))
                texts = codec.decode_batch(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                    schema=schema,
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
