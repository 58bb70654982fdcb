r"""Format-preserving pseudonyms for personal data, from Spark's built-in functions alone.

One pattern finds candidates, a validity test per kind keeps the true ones, and a keyed Feistel network
permutes each within the values of its own format, so that equal values stay equal in every document and
different ones stay different:

=========  ===============================================  ==========================================
kind       valid if                                         permuted
=========  ===============================================  ==========================================
card       13 to 19 digits pass the Luhn test               digits after the first; new check digit
iban       passes the mod-97 test; unbroken or in fours     account part; new check digits
phone      three, three and four digits, as written; or     the last ten digits, or those after the country
           eight to fifteen digits after a plus sign        code; 2-9 stays 2-9, 0-1 stays 0-1
national   area, group and serial of a US number in range   within all such numbers
ip         four numbers up to 255                           within all addresses
date       a calendar day from 1900 to 2099                 within those days, in the same notation
email      local part and domain                            letters and digits of the local part
secret     access keys; passwords and tokens by their name  letters and digits of the value
           in any case
=========  ===============================================  ==========================================

Neither secrets nor addresses have a greatest length.  Dates of numbers alone are read day first; those that
are only valid month first are permuted among themselves.  If the day or the month has one digit, neither is
padded in the pseudonym; the same day with and without padding has the same pseudonym.  Cards in the usual groupings that pass the test are
looked up first, so that a number beside them (expiry, check value, count, another card) is never read as part
of them; other groupings are read as far as they go.

Every kind is brought to one of two forms, a string with a head, a body and a tail, or a number with its
range, so that each network stands once in the plan.  Round functions are HMAC-SHA-256 under subkeys of the
kinds.  The subkeys reach the plan as a scalar subquery over a one-row table, so neither they nor the key
show in plans or event logs.

Signs between the characters stay where they are.  Invalid candidates stay as they are.  Null text stays
null, empty text empty; repeated rows give repeated results; an empty table gives none; other columns
pass through.  There is no shuffle and no Python: work follows the length of the texts.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.columns import fresh

ROUNDS = 8
KINDS = ["card", "iban", "phone", "national", "ip", "date", "email", "secret"]

# The lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _in_fours(length: int) -> str:
    """The printed form of the account numbers of this length."""
    fours, rest = divmod(length - 4, 4)
    countries = "|".join(c for c, n in IBAN_LENGTHS.items() if n == length)
    return rf"(?:{countries})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{fours}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")


# The notations that are looked for, in the order of preference.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}(?![A-Za-z0-9-])"
SECRET_NAMES = r"(?i:password|passwd|token|secret|api[_-]?key)"
SECRET = rf"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|{SECRET_NAMES} ?[=:] ?[\"']?[A-Za-z0-9+/_-]{{8,}}+)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
PRINTED_IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}} )(?:{'|'.join(_in_fours(n) for n in sorted(set(IBAN_LENGTHS.values())))})(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z-])"
NATIONAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
INTERNATIONAL = r"(?<![0-9A-Za-z])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])"
#: Country codes of one and of two digits; all others have three.
COUNTRY_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9A-Za-z])"
IP = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
BEFORE_CARD = [EMAIL, SECRET, IBAN, PRINTED_IBAN, DATE, NATIONAL, PHONE, INTERNATIONAL]
ANY = "|".join([*BEFORE_CARD, CARD, IP])
#: Groupings of cards at every place where one may begin; the second is longer by a group than one of the first.
GROUPED = [
    rf"(?<![0-9A-Za-z])(?=({g})(?![0-9A-Za-z]))"
    for g in (
        "[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}",
        "[0-9]{4}(?: [0-9]{4}){3} [0-9]{3}|[0-9]{4}(?:-[0-9]{4}){3}-[0-9]{3}",
    )
]
#: Whatever CARD finds has this.
LONG_NUMBER = r"[0-9](?:[ -]?[0-9]){12}"
#: Whatever ANY finds has one of these.
HINT = rf"[0-9@]|AKIA|{SECRET_NAMES}"
SECRET_HEAD = rf"^(?:AKIA|{SECRET_NAMES} ?[=:] ?[\"']?)"

FIRST_DAY, DAYS = "1900-01-01", 73_049
DAY_PARTS = (17, 4_297)
AREAS, GROUPS, SERIALS = 898, 99, 9_999
#: Steps of the walk that leads a date back among those that are only valid month first; one step does for
#: three in five, and all of them miss with a chance of 1e-26.
WALK = 64
#: Characters that one digest shifts.
DIGEST_PLACES = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def subkeys(spark: SparkSession, key: str) -> Column:
    """A map from kinds to the two padded keys of their HMAC, as a scalar subquery."""
    own = [hmac.new(key.encode(), kind.encode(), hashlib.sha256).digest().ljust(64, b"\0") for kind in KINDS]
    pads = [[bytes(b ^ pad for b in k) for k in own] for pad in (0x36, 0x5C)]
    # an Arrow table becomes a local relation, which needs no Python on executors
    table = spark.createDataFrame(pa.table({"kind": KINDS, "inner": pa.array(pads[0], pa.binary()), "outer": pa.array(pads[1], pa.binary())}))
    return table.select(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("inner", "outer"))))).scalar()


def _digest(own: Column, *parts: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    message = F.concat_ws("|", *parts).cast("binary")
    return F.sha2(F.concat(own["outer"], F.unhex(F.sha2(F.concat(own["inner"], message), 256))), 256)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def permute_number(value: Column, high: Column, low: Column, own: Column) -> Column:
    """A keyed permutation of 0 .. high*low-1: an alternating Feistel network on quotient and remainder."""

    def step(state: Column, k: Column) -> Column:
        odd = k % 2 == 1
        word = _number(F.substring(_digest(own, k, F.when(odd, state.lo).otherwise(state.hi)), 1, 15))
        moved = F.pmod(F.when(odd, state.hi).otherwise(state.lo) + word, F.when(odd, high).otherwise(low))
        return F.struct(F.when(odd, moved).otherwise(state.hi).alias("hi"), F.when(odd, state.lo).otherwise(moved).alias("lo"))

    start = F.struct(F.floor(value / low).cast("long").alias("hi"), F.pmod(value, low).alias("lo"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s.hi * low + s.lo)


def permute_characters(text: Column, own: Column, national: Column) -> Column:
    """A keyed permutation of the strings with the same class at each place.

    The halves are shifted in turn, each character within its own class, by digests of the other half.
    Classes: digits, small letters, capitals; where ``national`` 2-9 and 0-1; others stay.
    """

    def shift(code: Column, by: Column) -> Column:
        def within(first: int, size: int) -> Column:
            return F.lit(first) + F.pmod(code - first + by, F.lit(size))

        digit = F.when(~national, within(48, 10)).when(code >= 50, within(50, 8)).otherwise(within(48, 2))
        return F.when(code.between(48, 57), digit).when(code.between(97, 122), within(97, 26)).when(code.between(65, 90), within(65, 26)).otherwise(code)

    def shifted(half: Column, other: Column, k: Column) -> Column:
        seed = _digest(own, k, F.size(half), F.array_join(F.transform(other, lambda c: c.cast("string")), ","))
        places = F.sequence(F.lit(0), F.floor(F.size(half) / DIGEST_PLACES).cast("int"))
        streams = let(seed, lambda s: F.transform(places, lambda b: F.sha2(F.concat_ws("|", s, b).cast("binary"), 256)))

        def one(stream: Column) -> Column:
            return F.transform(half, lambda c, i: shift(c, _number(F.substr(stream[F.floor(i / DIGEST_PLACES).cast("int")], 4 * (i % DIGEST_PLACES) + 1, F.lit(4))).cast("int")))

        return let(streams, one)

    def step(state: Column, k: Column) -> Column:
        moved = shifted(state.first, state.second, k)
        return F.struct(state.second.alias("first"), moved.alias("second"))

    def run(codes: Column) -> Column:
        half = F.floor(F.size(codes) / 2).cast("int")
        start = F.struct(F.slice(codes, F.lit(1), half).alias("first"), F.slice(codes, half + 1, F.size(codes)).alias("second"))
        both = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s.first, s.second))
        return F.array_join(F.transform(both, lambda c: F.char(c)), "")

    return F.when(F.char_length(text) == 0, text).otherwise(let(F.transform(F.split(text, ""), lambda c: F.ascii(c)), run))


def _luhn_sum(digits: Column, first_doubled: int) -> Column:
    """Over the digits from the right; every second one counts twice, less 9 if that is over 9."""

    def add(total: Column, c: Column) -> Column:
        worth = F.when(total.turn == 0, c).otherwise(F.when(c > 4, 2 * c - 9).otherwise(2 * c))
        return F.struct((total.sum + worth).alias("sum"), (1 - total.turn).alias("turn"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(first_doubled).alias("turn"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int")), start, add, lambda s: s.sum)


def _is_card(m: Column) -> Column:
    return let(F.regexp_replace(m, "[ -]", ""), lambda d: (_luhn_sum(d, 0) % 10 == 0) & d.rlike("[1-9]"))


def grouped_cards(text: Column) -> Column:
    """The cards of usual grouping in a text; null if there is none."""
    found = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(g), F.lit(1)) for g in GROUPED)))
    return F.when(text.rlike(LONG_NUMBER), let(F.filter(found, _is_card), lambda c: F.when(F.size(c) > 0, c)))


def pattern_for(cards: Column) -> Column:
    """ANY; in a text with such cards they match as such, and no looser number reaches into one."""

    def own(listed: Column) -> Column:
        exact = F.concat(F.lit(r"(?<![0-9A-Za-z])(?:"), listed, F.lit(r")(?![0-9A-Za-z])"))
        apart = F.concat(F.lit(r"(?![0-9](?:[ -]?[0-9]){0,17}[ -](?:"), listed, F.lit(r")(?![0-9A-Za-z]))"), F.lit(CARD))
        return F.concat_ws("|", F.lit("|".join(BEFORE_CARD)), exact, apart, F.lit(IP))

    return let(F.array_join(cards, "|"), lambda listed: F.when(listed.isNull(), F.lit(ANY)).otherwise(own(listed)))


def _mod97(text: Column) -> Column:
    """Of the number that the digits, and letters as 10 to 35, spell out."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _day(year: Column, month: Column, day: Column) -> Column:
    """Days since the first, null if there is no such day."""
    date = F.concat_ws("-", year, month, day).try_cast("date")
    days = F.datediff(date, F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when((days >= 0) & (days < DAYS), days)


def read(m: Column) -> Column:
    """``kind, plain, days, month_first`` of a candidate; the kind is null if it is not valid.

    The shape of a candidate of ``ANY`` tells the one kind that it may be.
    """
    plain = F.regexp_replace(m, "[^0-9A-Za-z]", "")
    shape = (
        F.when(m.contains("@"), "email")
        .when(m.rlike(SECRET_HEAD), "secret")
        .when(m.startswith("+"), "phone")
        .when(m.rlike("^[A-Z]"), "iban")
        .when(m.rlike(r"^(?:[0-9]{4}-..-..|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})$"), "date")
        .when(m.rlike("^[0-9]{3}-..-....$"), "national")
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(F.char_length(plain) >= 13, F.when(m.rlike(f"^(?:{PHONE})$"), "phone").otherwise("card"))
        .otherwise("phone")
    )

    def dated(r: Column) -> Column:
        a, b, c = (F.try_element_at(F.split(r.m, "[/.-]"), F.lit(k)) for k in (1, 2, 3))
        day_first = F.when(r.m.contains("-"), _day(a, b, c)).otherwise(_day(c, b, a))
        month_first = F.when(~r.m.contains("-"), _day(c, a, b))
        is_date = r["shape"] == "date"
        return F.struct(r.m.alias("m"), r["shape"].alias("shape"), r.plain.alias("plain"), F.when(is_date, F.coalesce(day_first, month_first)).alias("days"), (is_date & day_first.isNull()).alias("month_first"))

    def valid(r: Column) -> Column:
        p = r.plain
        area, group, serial = F.substr(p, F.lit(1), F.lit(3)), F.substr(p, F.lit(4), F.lit(2)), F.substr(p, F.lit(6))
        return (
            F.when(r["shape"] == "email", ~r.m.rlike(r"@.*\.\."))
            .when(r["shape"] == "iban", _mod97(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4)))) == 1)
            .when(r["shape"] == "date", r.days.isNotNull())
            .when(r["shape"] == "national", ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"))
            .when(r["shape"] == "ip", F.forall(F.split(r.m, r"\."), lambda o: o.cast("int") <= 255))
            .when(r["shape"] == "card", _is_card(r.m))
            .otherwise(True)
        )

    start = F.struct(m.alias("m"), shape.alias("shape"), plain.alias("plain"))
    return let(let(start, dated), lambda r: F.struct(r.m.alias("m"), F.when(valid(r), r["shape"]).alias("kind"), r.plain.alias("plain"), r.days.alias("days"), r.month_first.alias("month_first")))


def refill(template: Column, characters: Column) -> Column:
    """``template`` with its letters and digits replaced in order."""

    def step(state: Column, c: Column) -> Column:
        used = c.rlike("[0-9A-Za-z]").cast("int")
        return F.struct((state.used + used).alias("used"), F.concat(state.out, F.when(used == 1, F.substr(characters, state.used + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit(0).alias("used"), F.lit("").alias("out")), step, lambda s: s.out)


def _respelled(h: Column, own: Column) -> Column:
    """Of the kinds that are strings: head, permuted body and tail, with new check digits."""
    of = h.kind
    size = F.char_length(h.plain)
    whole = F.when(of.isin("email", "secret"), h.m).otherwise(h.plain)
    head = F.when(of == "card", 1).when(of == "iban", 4).when(of == "phone", F.when(h.m.rlike(f"^(?:{PHONE})$"), size - 10).otherwise(F.char_length(F.regexp_extract(h.m, COUNTRY_CODE, 0)) - 1)).when(of == "secret", F.char_length(F.regexp_extract(h.m, SECRET_HEAD, 0))).otherwise(0)
    body = F.when(of == "card", size - 2).when(of == "email", F.instr(h.m, "@") - 1).otherwise(F.char_length(whole) - head)

    def moved(cut: Column) -> Column:
        return let(
            permute_characters(F.substr(cut.whole, cut["head"] + 1, cut.body), own, of == "phone"),
            lambda b: F.struct(F.substr(cut.whole, F.lit(1), cut["head"]).alias("head"), b.alias("body"), F.substr(cut.whole, cut["head"] + cut.body + 1).alias("tail")),
        )

    def joined(x: Column) -> Column:
        country = F.substr(x["head"], F.lit(1), F.lit(2))
        card = let(F.concat(x["head"], x.body), lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 1), F.lit(10)).cast("string")))
        iban = F.concat(country, F.lpad((98 - _mod97(F.concat(x.body, country, F.lit("00")))).cast("string"), 2, "0"), x.body)
        return F.when(of == "card", card).when(of == "iban", iban).otherwise(F.concat(x["head"], x.body, x["tail"]))

    cut = F.struct(whole.alias("whole"), head.alias("head"), body.alias("body"))
    spelled = let(let(cut, moved), joined)
    return F.when(of.isin("email", "secret"), spelled).otherwise(let(spelled, lambda s: refill(h.m, s)))


def _recounted(h: Column, own: Column) -> Column:
    """Of the kinds that are numbers within a range."""
    of = h.kind
    parts = F.split(h.m, "[.-]")
    area, group, serial = (F.try_element_at(parts, F.lit(k)).cast("long") for k in (1, 2, 3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    value = F.when(of == "date", h.days).when(of == "ip", F.aggregate(parts, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))).otherwise((rank * GROUPS + group - 1) * SERIALS + serial - 1)
    high = F.when(of == "date", DAY_PARTS[0]).when(of == "ip", 1 << 16).otherwise(AREAS * GROUPS).cast("long")
    low = F.when(of == "date", DAY_PARTS[1]).when(of == "ip", 1 << 16).otherwise(SERIALS).cast("long")

    def day_of(v: Column) -> Column:
        return F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))

    def walk(state: Column, _: Column) -> Column:
        def arrived(v: Column) -> Column:
            return F.struct(v.alias("v"), (~h.month_first | (F.day(day_of(v)) > 12)).alias("done"))

        return F.when(state.done, state).otherwise(let(permute_number(state.v, high, low, own), arrived))

    moved = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(value.alias("v"), F.lit(False).alias("done")), walk, lambda s: s.v)

    def spelled(v: Column) -> Column:
        area = F.floor(v / (GROUPS * SERIALS))
        area = F.when(area + 1 >= 666, area + 2).otherwise(area + 1)
        national = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(v / SERIALS) % GROUPS + 1).cast("string"), 2, "0"), F.lpad((v % SERIALS + 1).cast("string"), 4, "0"))
        ip = F.concat_ws(".", *(F.floor(v / (1 << s)) % 256 for s in (24, 16, 8, 0)))
        sign = F.when(h.m.contains("/"), "/").otherwise(".")
        text = F.date_format(day_of(v), "yyyy-MM-dd")
        bare = h.m.rlike(r"^.[/.]|[/.].[/.]")
        part = lambda at: F.when(bare & (F.substr(text, F.lit(at), F.lit(1)) == "0"), F.substr(text, F.lit(at + 1), F.lit(1))).otherwise(F.substr(text, F.lit(at), F.lit(2)))
        year, month, day = F.substr(text, F.lit(1), F.lit(4)), part(6), part(9)
        date = F.when(h.m.contains("-"), text).when(h.month_first, F.concat(month, sign, day, sign, year)).otherwise(F.concat(day, sign, month, sign, year))
        return F.when(of == "date", date).when(of == "ip", ip).otherwise(national)

    return let(moved, spelled)


def _pseudonym(h: Column, keys: Column) -> Column:
    def under(own: Column) -> Column:
        return F.when(h.kind.isin("date", "ip", "national"), _recounted(h, own)).otherwise(_respelled(h, own))

    return F.when(h.kind.isNull(), h.m).otherwise(let(F.try_element_at(keys, h.kind), under))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text; ``found`` names a column for the kinds replaced, in order."""
    own, hits, keys = (fresh([*docs.columns, found or ""], x) for x in ("own", "hits", "keys"))
    text = F.col(text_col).cast("string")
    named = docs.withColumn(own, F.when(text.rlike(HINT), pattern_for(grouped_cards(text))))
    named = named.withColumn(hits, F.transform(F.regexp_extract_all(text, F.col(own), F.lit(0)), read))
    named = named.withColumn(keys, subkeys(docs.sparkSession, key))
    new = F.transform(F.col(hits), lambda h: _pseudonym(h, F.col(keys)))
    rewritten = F.array_join(F.zip_with(F.split(text, F.col(own), -1), new, lambda gap, p: F.concat(gap, F.coalesce(p, F.lit("")))), "")
    out = named.withColumn(text_col, F.when(F.exists(F.col(hits), lambda h: h.kind.isNotNull()), rewritten).otherwise(text))
    if found:
        out = out.withColumn(found, F.coalesce(F.transform(F.filter(F.col(hits), lambda h: h.kind.isNotNull()), lambda h: h.kind), F.array().cast("array<string>")))
    return out.drop(own, hits, keys)
