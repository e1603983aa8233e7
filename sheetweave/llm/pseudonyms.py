r"""Format-preserving pseudonyms by keyed Feistel permutations, in SQL functions only.

Found and validated: e-mail addresses, hexadecimal secrets of 32 digits or more, IPv4 addresses (octets up to
255), calendar dates (1900 to 2099, ISO or day first), telephone numbers (8 digits or more with a ``+``,
brackets or separators) and card or account numbers (13 to 19 digits; with ``checked`` only those whose Luhn
digit is right, so that other long numbers stay). A value is read as a list of symbols,
each below a radix of its own: 10 for digits, 26 or 31 for letters, 16 for hexadecimal digits, 256 for
octets, 17 and 4297 for the 73,049 days of two centuries. Rounds alternate: one half of the symbols gets,
modulo its radixes, numbers from HMAC-SHA-256 with the key over the kind, the round and the other half. That permutes
the values of one format, so equal values get equal pseudonyms in all documents and different values of a
format never share one. A card number's distance from its right Luhn digit, the country code or what marks a national
number, an e-mail's domain, punctuation and letter case stay as they are. The key is data of a one-row table that the plan reads as a scalar
subquery, so no plan, event log or user interface shows it.

Edge cases: null text stays null with no pseudonyms; text without such values, or empty, is unchanged;
matches are anchored at the start of a run of characters, so a very long run costs no more than its length;
the text is cut by the same pattern that extracts the values, so pieces and values interleave exactly;
repeated rows and ids are treated one by one; an empty table gives no rows; a value of any length is permuted whole;
no other column is read, and names of columns in between avoid those of the input; a column ``n_pseudonyms`` of the input is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
LOCAL = r"[\p{L}\p{N}._%+-]"
#: What is looked for, in the order in which it is tried.
EMAIL = rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{{2,}}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-1][0-9]-[0-3][0-9]|[0-3][0-9][./-][0-1][0-9][./-](?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])"
GROUP = r"[0-9]{2,5}(?![0-9]|\.[0-9])"
PHONE = (
    rf"(?<![0-9+])(?:\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{2,5}}(?:[ .-]{GROUP}){{0,3}}"
    rf"|\+[0-9]{{1,3}}[ -][0-9]{{1,5}}(?:[ -]{GROUP}){{1,4}}|\+[0-9]{{1,3}}(?:\.[0-9]{{2,5}}){{2,4}}|\+[0-9]{{8,15}}"
    r"|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}|\([0-9]{2,5}\)[ .-]?[0-9]{5,9}|(?<![.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|(?<![.-])0[1-9](?:[ .-][0-9]{2}){4}(?![ .-][0-9])|(?<![.-]|[0-9] )[6-9][0-9]{2}[ -][0-9]{3}[ -][0-9]{3}(?![ .-][0-9]))(?![0-9])"
)
#: What stays of a telephone number: its country code, or the digits by which a national format is known.
PREFIX = r"^(?:\+[0-9]{1,3}|0[1-9](?=(?:[ .-][0-9]{2}){4}$)|[6-9](?=[0-9]{2}[ -][0-9]{3}[ -][0-9]{3}$))"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, DATE, CARD, PHONE))
#: Letters and digits that are permuted within their own alphabet.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", *("".join(map(chr, range(lo, hi))) for lo, hi in ((0x430, 0x450), (0x410, 0x430), (0x3B1, 0x3C2), (0x391, 0x3A2))))
HEX = "0123456789abcdef"
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(body: Column, doubled: int = 0) -> Column:
    """The Luhn sum of all but the check digit; of a whole number with doubled = 1."""
    def part(d: Column, i: Column) -> Column:
        return F.when(i % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.reverse(body), part), F.lit(0).cast("long"), lambda a, b: a + b)


def _day(m: Column) -> Column:
    iso = F.concat(F.substr(m, F.lit(7), F.lit(4)), F.lit("-"), F.substr(m, F.lit(4), F.lit(2)), F.lit("-"), F.substr(m, F.lit(1), F.lit(2)))
    return F.datediff(F.try_to_date(F.when(m.rlike("^[0-9]{4}-"), m).otherwise(iso), "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _kind(m: Column, checked: bool) -> Column:
    """What a found string is; null if it isn't valid."""
    digits = F.transform(_chars(F.regexp_replace(m, "[^0-9]", "")), lambda c: c.cast("long"))
    return (
        F.when(F.instr(m, "@") > 0, "email")
        .when(m.rlike("^[0-9a-fA-F]{32,}$"), "hex")
        .when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
        .when(m.rlike(f"^(?:{DATE})$"), F.when(_day(m).isNotNull(), "date"))
        .when(m.rlike(f"^(?:{CARD})$"), F.when(_luhn(digits, 1) % 10 == 0, "card") if checked else F.lit("card"))
        .when(F.length(F.regexp_replace(m, "[^0-9]", "")) >= 8, "phone")
    )


def _shape(m: Column, kind: Column) -> Column:
    """The part of a found string whose symbols are permuted."""
    return F.when(kind == "email", F.substring_index(m, "@", 1)).when(kind == "hex", F.translate(m, "ABCDEF", "abcdef")).when(kind == "phone", F.regexp_replace(m, PREFIX, "")).otherwise(m)


def _alphabet(c: Column, kind: Column) -> Column:
    found = F.lit(None).cast("string")
    for a in reversed(ALPHABETS[1:]):
        found = F.when((kind == "email") & F.lit(a).contains(c), a).otherwise(found)
    return F.when((kind == "hex") & F.lit(HEX).contains(c), HEX).when((kind != "hex") & F.lit(ALPHABETS[0]).contains(c), ALPHABETS[0]).otherwise(found)


def _read(found: Column, checked: bool) -> Column:
    """Per found string: kind, shape, and its symbols as (alphabet, number below its radix)."""
    named = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m, checked).alias("kind")))
    shaped = F.transform(named, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), _shape(s["m"], s["kind"]).alias("shape")))

    def letters(s: Column) -> Column:
        placed = F.transform(_chars(s["shape"]), lambda c: F.struct(_alphabet(c, s["kind"]).alias("a"), c.alias("c")))
        return F.filter(placed, lambda p: p["a"].isNotNull())

    def long_array(*values: Column | int) -> Column:
        return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("long") for v in values))

    def symbols(s: Column) -> Column:
        x = F.transform(s["p"], lambda p: F.instr(p["a"], p["c"]).cast("long") - 1)
        r = F.transform(s["p"], lambda p: F.length(p["a"]).cast("long"))
        kind, m, body = s["kind"], s["m"], F.size(s["p"]) - 1
        x = F.when(kind == "ip", F.transform(F.split(m, r"\."), lambda o: o.cast("long"))).when(kind == "date", long_array(F.floor(_day(m) / DAYS[1]), _day(m) % DAYS[1])).when(kind == "card", F.slice(x, F.lit(1), body)).otherwise(x)
        r = F.when(kind == "ip", long_array(256, 256, 256, 256)).when(kind == "date", long_array(*DAYS)).when(kind == "card", F.slice(r, F.lit(1), body)).otherwise(r)
        last = F.when(kind == "card", F.element_at(s["p"], -1)["c"].cast("long"))
        return F.struct(m.alias("m"), kind.alias("kind"), s["shape"].alias("shape"), F.transform(s["p"], lambda p: p["a"]).alias("a"), x.alias("x"), r.alias("m_"), last.alias("last"))

    with_letters = F.transform(shaped, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["shape"].alias("shape"), letters(s).alias("p")))
    return F.transform(with_letters, symbols)


def _halves(s: Column) -> Column:
    n = F.size(s["x"])
    h = F.floor(n / 2).cast("int")
    off = F.when(s["kind"] == "card", (s["last"] + _luhn(s["x"])) % 10)
    cut = (F.slice(s["x"], F.lit(1), h).alias("l"), F.slice(s["x"], h + 1, n - h).alias("r"), F.slice(s["m_"], F.lit(1), h).alias("lm"), F.slice(s["m_"], h + 1, n - h).alias("rm"))
    return F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["shape"].alias("shape"), s["a"].alias("a"), off.alias("off"), *cut)


def _keys(spark: SparkSession, key: str) -> tuple[Column, Column]:
    """The inner and the outer key of HMAC-SHA-256, as scalar subqueries."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pads = (bytes(x ^ pad for x in block.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    table = spark.sql("SELECT * FROM VALUES (X'{}', X'{}') AS t(i, o)".format(*pads))
    return table.select("i").scalar(), table.select("o").scalar()


def _turn(s: Column, rnd: int, keys: tuple[Column, Column], undo: bool) -> Column:
    """One Feistel round: the right half in even rounds, the left one in odd rounds. The other half is hashed once, then once more for each symbol."""
    mine, other, radix = ("r", "l", "rm") if rnd % 2 == 0 else ("l", "r", "lm")
    asked = F.concat_ws("|", F.lit(str(rnd)), s["kind"], F.array_join(F.transform(s[other], lambda x: x.cast("string")), ","), F.size(s[mine]).cast("string"))
    inner = F.unhex(F.sha2(F.concat(keys[0], asked.cast("binary")), 256))
    seeds = F.array(F.sha2(F.concat(keys[1], inner), 256))
    noise = F.flatten(F.transform(seeds, lambda seed: F.transform(s[mine], lambda x, i: F.conv(F.substr(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), F.lit(1), F.lit(12)), 16, 10).cast("long"))))
    moved = F.zip_with(s[mine], noise, lambda a, b: a - b if undo else a + b)
    new = F.zip_with(moved, s[radix], F.pmod)
    return F.struct(*((new if f == mine else s[f]).alias(f) for f in ("m", "kind", "shape", "a", "off", "l", "r", "lm", "rm")))


def _write(s: Column) -> Column:
    """The pseudonym, in the format of the found string."""
    x, m, kind = s["x"], s["m"], s["kind"]
    check = F.pmod(s["off"] - _luhn(x), F.lit(10))
    numbers = F.when(kind == "card", F.concat(x, F.array(check))).otherwise(x)
    signs = F.zip_with(numbers, s["a"], lambda v, a: F.substr(a, (v + 1).cast("int"), F.lit(1)))
    split_at = F.when(kind == "email", F.split(s["shape"], "[" + "".join(ALPHABETS) + "]", -1)).when(kind == "hex", F.split(s["shape"], "[0-9a-f]", -1)).otherwise(F.split(s["shape"], "[0-9]", -1))
    filled = F.array_join(F.zip_with(split_at, F.concat(signs, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (x[0] * DAYS[1] + x[1]).cast("int"))
    dated = F.when(m.rlike("^[0-9]{4}-"), day.cast("string")).otherwise(F.concat(F.date_format(day, "dd"), F.substr(m, F.lit(3), F.lit(1)), F.date_format(day, "MM"), F.substr(m, F.lit(6), F.lit(1)), F.date_format(day, "yyyy")))
    return (
        F.when(kind.isNull(), m)
        .when(kind == "ip", F.array_join(F.transform(x, lambda o: o.cast("string")), "."))
        .when(kind == "date", dated)
        .when(kind == "hex", F.when(m.rlike("[a-f]"), filled).otherwise(F.upper(filled)))
        .when(kind == "email", F.concat(filled, F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "phone", F.concat(F.regexp_extract(m, f"(?:{PREFIX})?", 0), filled))
        .otherwise(filled)
    )


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", undo: bool = False, checked: bool = False) -> DataFrame:
    """docs with text_col rewritten and n_pseudonyms (long), the values that changed; undo gives the values back to whoever has the key. checked leaves long numbers alone that fail the Luhn check."""
    text, none = F.col(text_col), F.expr("cast(array() as array<string>)")
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found, s, new, *pads = (f"{mark}{n}" for n in ("found", "s", "new", "inner", "outer"))
    keys = tuple(map(F.col, pads))
    df = docs.withColumns(dict(zip(pads, _keys(docs.sparkSession, key), strict=True))).withColumn(found, F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), none))
    df = df.withColumn(s, F.transform(_read(F.col(found), checked), _halves))
    for rnd in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        df = df.withColumn(s, F.transform(s, _turned(rnd, keys, undo)))
    joined = F.transform(s, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["shape"].alias("shape"), s["a"].alias("a"), s["off"].alias("off"), F.concat(s["l"], s["r"]).alias("x")))
    df = df.withColumn(new, F.transform(joined, _write))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)).cast("long")
    return df.withColumn(text_col, F.when(F.size(found) > 0, whole).otherwise(text)).withColumn("n_pseudonyms", changed).drop(found, s, new, *pads)


def _turned(rnd: int, keys: tuple[Column, Column], undo: bool):  # noqa: ANN202
    return lambda s: _turn(s, rnd, keys, undo)
