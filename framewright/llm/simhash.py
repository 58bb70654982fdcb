"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius by permuted block tables.

A term is a word with the word before it (nothing before the first); its weight is how often it occurs, but no more than
``most``, so that repeated lines don't drown the rest.  Every term's 128-bit hash votes with its weight for the bits it
has and against those it lacks; a fingerprint is the bits with more votes for than against.  Votes are added eight bits
to a byte lane, then widened, so that a term costs sixteen additions and not 128.

For radius ``r`` the 128 bits are cut into ``b > r`` blocks.  Two fingerprints within the radius agree in at least
``b - r`` blocks.  Each choice of ``b - r`` blocks is a table, whose key is the fingerprint with these blocks in front and the rest cut
off; every pair within the radius meets in some table, and counts in the first one where it does.  Only distinct fingerprints
meet; a bucket is dealt into arrays of bounded size, and what a query finds there is counted or listed in place.

Built-in functions only.  Defined results: null text counts as empty; texts without words all have the fingerprint of
one empty term; equal texts have equal fingerprints; repeated rows give repeated results; an empty table gives an
empty one.  Whole texts count; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.llm.columns import fresh
from framewright.llm.components import spread_join

BITS = 128
#: What lies between words; splitting there is five times as fast as matching the words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Votes that a byte lane holds without reaching a long's sign; sums of so many bytes that a 16-bit lane holds.
LANE, WIDE = 127, 258
#: A greatest weight.  Square roots of counts would serve as well; a plain count lets repeated lines decide.
MOST = 2
#: Fingerprints of one bucket that one array holds, at most and about.
BUCKET = 2_000
#: Rows of a cell of neighbouring ids, and cells at most; more rows than that make larger cells, which spill.
CELL_ROWS, MOST_CELLS = 2_000, 1 << 16
SAMPLES_A_CELL = 10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(value: Column, by: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(by) if isinstance(by, int) else by)


def _struct(fields: list[Column]) -> Column:
    return F.struct(*(f.alias(f"c{k}") for k, f in enumerate(fields)))


def terms(text: Column, most: int = MOST) -> Column:
    """The hashes of a text's terms, each as often as its weight."""

    def paired(words: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
        return F.sort_array(F.zip_with(words, before, lambda w, b: F.xxhash64(w, b)))

    def weighed(hashes: Column) -> Column:
        return F.filter(hashes, lambda x, i: (i < most) | (F.get(hashes, i - most) != x))

    return let(let(F.array_remove(F.split(F.lower(text), GAP), ""), paired), weighed)


def _votes(hashes: Column) -> Column:
    """How many of the hashes have each of the 128 bits."""
    bytes_of, halves = 0x0101010101010101, 0x00FF00FF00FF00FF
    parts = lambda n, size: F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))

    def lanes(some: Column) -> Column:  # bit 8j + k of either half adds to byte j of field k
        add = lambda acc, v: _struct([acc[f"c{8 * h + k}"] + _shifted(v["ab"[h]], k).bitwiseAND(F.lit(bytes_of)) for h in range(2) for k in range(8)])
        return F.aggregate(some, _struct([F.lit(0).cast("long")] * 16), add)

    def widened(some: Column) -> Column:  # even and odd bytes apart, in lanes of 16 bits
        add = lambda acc, s: _struct([acc[f"c{2 * f + odd}"] + _shifted(s[f"c{f}"], 8 * odd).bitwiseAND(F.lit(halves)) for f in range(16) for odd in range(2)])
        return F.aggregate(some, _struct([F.lit(0).cast("long")] * 32), add)

    def unpacked(wide: Column) -> Column:
        return let(wide, lambda s: F.array(*(_shifted(s[f"c{2 * (8 * h + k) + j % 2}"], 16 * (j // 2)).bitwiseAND(F.lit(0xFFFF)) for h in range(2) for j in range(8) for k in range(8))))

    def counted(votes: Column) -> Column:
        small = F.transform(parts(F.size(votes), LANE), lambda c: lanes(F.slice(votes, c * LANE + 1, F.lit(LANE))))
        large = let(small, lambda s: F.transform(parts(F.size(s), WIDE), lambda c: unpacked(widened(F.slice(s, c * WIDE + 1, F.lit(WIDE))))))
        return let(large, lambda u: F.when(F.size(u) == 1, F.element_at(u, 1)).otherwise(F.aggregate(u, F.array_repeat(F.lit(0).cast("long"), BITS), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))))

    return let(F.transform(hashes, lambda h: F.struct(h.alias("a"), F.xxhash64(h).alias("b"))), counted)


def fingerprint(text: Column, most: int = MOST) -> Column:
    """``struct<a long, b long>``: the 128 bits."""

    def bits(counts: Column, n: Column, at: int) -> Column:
        masks = F.transform(F.slice(counts, at, 64), lambda c, i: F.when(2 * c > n, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    def of(hashes: Column) -> Column:
        return let(_votes(hashes), lambda c: F.struct(bits(c, F.size(hashes), 1).alias("a"), bits(c, F.size(hashes), 65).alias("b")))

    return let(terms(F.coalesce(text.cast("string"), F.lit("")), most), of)


def shown(fp: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(fp["a"]), 16, "0"), F.lpad(F.hex(fp["b"]), 16, "0")))


def distance(one: Column, other: Column) -> Column:
    """Differing bits."""
    return F.bit_count(one["a"].bitwiseXOR(other["a"])) + F.bit_count(one["b"].bitwiseXOR(other["b"]))


def likeness(one: Column, other: Column) -> Column:
    """The share of equal bits."""
    return 1 - distance(one, other) / F.lit(float(BITS))


def _mask(blocks: tuple[int, ...], of: int) -> tuple[int, int]:
    """The bits of some of ``of`` blocks, as two signed longs."""
    whole = 0
    for k in blocks:
        lo, hi = k * BITS // of, (k + 1) * BITS // of
        whole |= ((1 << (hi - lo)) - 1) << lo
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole & (1 << 64) - 1), signed(whole >> 64)


class BlockTables:
    """The tables for one radius; more blocks make longer keys and more tables."""

    def __init__(self, radius: int = 3, blocks: int = 4):
        if not 0 <= radius < blocks <= BITS:
            raise ValueError("there must be more blocks than differing bits")
        self.radius, self.blocks = radius, blocks
        self.tables = list(combinations(range(blocks), blocks - radius))

    def keyed(self, fps: DataFrame) -> DataFrame:
        """One row of ``fps`` (``fp`` and others) for each table, with its number and key."""
        keys = [F.struct(F.lit(t).alias("table"), F.col("fp.a").bitwiseAND(F.lit(a)).alias("key_a"), F.col("fp.b").bitwiseAND(F.lit(b)).alias("key_b")) for t, (a, b) in enumerate(_mask(x, self.blocks) for x in self.tables)]
        return fps.select("*", F.explode(F.array(*keys)).alias("at")).select(*fps.columns, "at.*")

    def found(self, one: Column, other: Column, table: Column) -> Column:
        """Within the radius, and in no earlier table: the blocks before the table's last one that aren't its own differ."""
        none = F.array().cast("array<struct<a:bigint,b:bigint>>")
        differ = [[_mask((k,), self.blocks) for k in range(x[-1]) if k not in x] for x in self.tables]
        needed = F.array(*(F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in masks)) if masks else none for masks in differ))
        apart = lambda m: one["a"].bitwiseXOR(other["a"]).bitwiseAND(m["a"]).bitwiseOR(one["b"].bitwiseXOR(other["b"]).bitwiseAND(m["b"])) != 0
        return (distance(one, other) <= self.radius) & F.forall(F.element_at(needed, table + 1), apart)

    def matches(self, queries: DataFrame, counted: DataFrame, total: int) -> DataFrame:
        """``fp, found`` for the distinct ``fp`` of ``queries``: arrays of ``fp, n`` of those of ``counted`` within the radius.

        ``counted`` has distinct ``fp`` and ``n``, ``total`` rows.  A query has several rows; no ``fp`` is in two of them.
        """
        salt = F.pmod(F.xxhash64("fp.a", "fp.b"), F.lit(max(1, total // BUCKET)))
        buckets = self.keyed(counted.select("fp", "n")).groupBy("table", "key_a", "key_b", salt.alias("salt")).agg(F.collect_list(F.struct("fp", "n")).alias("bucket"))
        asked = self.keyed(queries.select("fp").distinct())
        near = F.filter("bucket", lambda y: self.found(F.col("fp"), y["fp"], F.col("table")))
        return asked.join(buckets, ["table", "key_a", "key_b"]).select("fp", near.alias("found")).filter(F.size("found") > 0)


def counts(fps: DataFrame) -> DataFrame:
    """``fp, n`` of a table with a column ``fp``."""
    return fps.groupBy(F.col("fp.a").alias("a"), F.col("fp.b").alias("b")).agg(F.count("*").alias("n")).select(F.struct("a", "b").alias("fp"), "n")


def search(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``fp, found, distance, n``: every distinct fingerprint of ``fps`` within the radius of one of ``queries``, and how many rows have it."""
    counted = counts(fps)
    hits = BlockTables(radius, blocks).matches(queries, counted, counted.count()).select("fp", F.explode("found").alias("y"))
    return hits.select("fp", F.col("y.fp").alias("found"), distance(F.col("fp"), F.col("y.fp")).alias("distance"), F.col("y.n").alias("n"))


def rows_within(queries: DataFrame, fps: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """``queries`` (with ``fp`` and ``fingerprint``) and ``n_within``: how many rows of ``fps`` are within the radius of each.

    Numbers are summed where they are found, so that no list of pairs is laid out.  Fingerprints that very many queries have meet
    their number by broadcast; there are at most 2,000 of these.
    """
    counted = counts(fps)
    size = counted.agg(F.count("*").alias("distinct"), F.sum("n").alias("rows")).first()
    hits = BlockTables(radius, blocks).matches(queries, counted, size["distinct"])
    per_fp = hits.groupBy("fp").agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda acc, y: acc + y["n"])).alias("n_within"))
    hot = counted.filter(F.col("n") > max(1_000, (size["rows"] or 0) // 2_000)).select(shown(F.col("fp")).alias("fingerprint"))
    return spread_join(queries, per_fp.select(shown(F.col("fp")).alias("fingerprint"), "n_within"), "fingerprint", hot)


def _cuts(docs: DataFrame, id_col: str) -> list[int]:
    """Ids that end cells of about ``CELL_ROWS`` rows, ascending; the last is the greatest of all.

    At most ``SAMPLES_A_CELL * MOST_CELLS`` ids, chosen by hash, come to the driver, about.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    seen = ids.agg(F.count("*").alias("n"), F.max("id").alias("last")).first()
    if not seen["n"]:
        return []
    cells = min(MOST_CELLS, -(-seen["n"] // CELL_ROWS))
    if cells == 1:
        return [seen["last"]]
    share = min(1.0, SAMPLES_A_CELL * cells / seen["n"])
    sample = ids.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    some = sorted(r[0] for r in sample.collect())
    return sorted({*some[SAMPLES_A_CELL - 1 :: SAMPLES_A_CELL], seen["last"]})


def with_next(docs: DataFrame, id_col: str, next_of: list[str], result: str, guests: bool = False) -> DataFrame:
    """``docs`` with a struct of ``next_of`` of the row that follows by falling id; the first one follows the last.

    Rows of one id follow one another by the first column of ``next_of``.  A row without id has no place in the order and is
    its own next one.  Ids are cut into cells of neighbours; the greatest row of a cell is sent to the cell above as well, whose
    least row it follows.  So the rows are dealt out once, and a task sorts one cell at a time.  With ``guests`` these rows stay,
    and ``cell, place, guest`` are given: a row's cell, its place there from 1, and whether it is one of them.
    """
    cuts = _cuts(docs, id_col)
    cell, guest, copies = fresh(docs.columns, "cell"), fresh(docs.columns, "guest"), fresh(docs.columns, "copies")
    key = F.col(id_col).cast("long")
    bounds = F.split(F.lit(",".join(map(str, cuts or [0]))), ",").cast("array<bigint>")
    steps = [1 << k for k in range(max(1, len(cuts)).bit_length() - 1, -1, -1)]
    below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < key, at + step).otherwise(at))
    place = lambda c, g: F.struct(c.cast("int").alias("c"), F.lit(g).alias("g"))
    apart = F.array(place(-1 - F.pmod(F.xxhash64(next_of[0]), F.lit(1009)), False))  # without id: anywhere
    both = let(below, lambda c: F.when(F.get(bounds, c) == key, F.array(place(c, False), place(F.pmod(c + 1, F.lit(max(1, len(cuts)))), True))).otherwise(F.array(place(c, False))))
    dealt = docs.withColumn(copies, F.explode(F.when(key.isNull(), apart).otherwise(both))).withColumns({cell: F.col(f"{copies}.c"), guest: F.col(f"{copies}.g")}).drop(copies)
    order = W.partitionBy(cell).orderBy(F.col(guest), key.desc(), F.col(next_of[0]))
    follows = F.when(key.isNull(), F.struct(*next_of)).otherwise(F.lead(F.struct(*next_of)).over(order))
    if guests:
        return dealt.withColumns({result: follows, "place": F.row_number().over(order)}).withColumnsRenamed({cell: "cell", guest: "guest"})
    return dealt.withColumn(result, follows).filter(~F.col(guest)).drop(cell, guest)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guests: bool = False) -> DataFrame:
    """``id_col, text, edited``, with ``guests`` also ``cell, place, guest``: every text, and with its second half replaced by the beginning of the next document.

    ``cell, place`` name a row and its place in falling order of ids; equal rows may change places.  A cell's last row, a ``guest``,
    belongs to the next cell and is there to be followed.
    """
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(own, id_col, ["text"], "following", guests)
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("following.text"), F.lit(1), half))
    return rows.select(id_col, "text", text.alias("edited"), *(["cell", "place", "guest"] if guests else []))


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, Column], most: int = MOST) -> DataFrame:
    """``keys`` and a fingerprint for each of ``texts``, whose rows ``keys`` tell apart: as ``fingerprint``, in compiled sums.

    Terms become rows and are summed in the task that made them, so that one row of each text is shuffled.  A sum holds the
    votes of two bits in 32 bits each, more than a text has terms.
    """
    half, bit = 0x0000000100000001, F.col("hash")
    each = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.coalesce(t, F.lit("")).alias("text")) for k, t in enumerate(texts.values())))).alias("one"))
    hashes = each.select(*keys, F.col("one.which").alias("which"), F.explode(terms(F.col("one.text"), most)).alias("hash")).withColumn("other", F.xxhash64("hash"))
    votes = [F.sum(_shifted(h, k).bitwiseAND(F.lit(half))).alias(f"{name}{k}") for name, h in (("a", bit), ("b", F.col("other"))) for k in range(32)]
    summed = hashes.groupBy(*keys, "which").agg(F.count("*").alias("n"), *votes)

    def word(name: str) -> Column:
        more = lambda count, at: F.when(2 * count > F.col("n"), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
        masks = F.transform(F.array(*(f"{name}{k}" for k in range(32))), lambda s, k: more(s.bitwiseAND(F.lit(0xFFFFFFFF)), k).bitwiseOR(more(_shifted(s, 32), k + 32)))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    found = summed.select(*keys, "which", word("a").alias("a"), word("b").alias("b"))
    pick = lambda k, part: F.max(F.when(F.col("which") == k, F.col(part)))
    return found.groupBy(*keys).agg(*(pick(k, part).alias(f"{part}{k}") for k in range(len(texts)) for part in "ab")).select(*keys, *(F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")).alias(name) for k, name in enumerate(texts)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike it is to that and to the next document's."""
    rows = edited(docs, id_col, text_col, guests=True).withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    found = fingerprints(rows, ["cell", "place", "guest", id_col, "n_chars", "edited_sha256"], {"fp": F.col("text"), "edited_fp": F.col("edited")})
    following = F.when(F.col(id_col).isNull(), F.col("fp")).otherwise(F.lead("fp").over(W.partitionBy("cell").orderBy("place")))
    return found.withColumn("next_fp", following).filter(~F.col("guest")).select(
        id_col,
        "n_chars",
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "fp",
    )
