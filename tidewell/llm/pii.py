"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

One pattern finds candidates; each is checked by its kind's own rule (Luhn sum, remainder by 97,
octets, calendar, number ranges) and, if it holds, put through a keyed Feistel permutation of its kind's values.
Separators, lengths and letter case stay. The permutation sees the value without separators, so
equal values get equal pseudonyms in every document and spelling, and different values of a
kind different ones.

Kinds: email (letters and digits of the local part; the domain stays), ip (all 32 bits), date (day
within its century; year-month-day, day.month.year, month/day/year), ssn (within its valid numbers),
phone (national digits; a US exchange starts with 2 to 9, and area and exchange keep their range; areas are not
checked further, as a number with a mistyped area still tells who is meant), card (all digits but the first; the
last is made to fit the Luhn sum again), iban (all but the country; check digits are made to fit).

A text without candidates passes a single cheap test. All work is per row: nothing is shuffled,
and very long texts and many repeats need no special case. Nulls: a null text stays null. Empty
tables give an empty result. Other columns pass through, whatever their names.

The key is a literal of the plan; set spark.sql.redaction.string.regex where plans are logged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import need_free

ROUNDS = 8

#: Lengths of IBANs by country; where one is known it ends the candidate, so that words and numbers behind aren't taken in.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form(countries: str, n: int) -> str:
    fours, rest = divmod(n - 4, 4)
    return f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Candidates by kind.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "date_ymd": r"\d{4}-\d{2}-\d{2}",
    "date_dmy": r"\d{2}\.\d{2}\.\d{4}",
    "date_mdy": r"\d{2}/\d{2}/\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone_us": r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "phone_other": r"\+[2-9]\d{1,2}(?:[ .-]?\d{2,4}){2,5}",
    "card": r"\d(?:[ -]?\d){12,18}",
    "iban": "|".join([*(_iban_form(c, n) for n, c in _IBAN_LENGTHS.items()), r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"]),
}


def _candidate(names: list[str]) -> str:
    """No letter, digit or number part may touch a candidate."""
    return r"(?<![\w.+@/-])(?:" + "|".join(PATTERNS[k] for k in names) + r")(?![\w@/]|[.-]\d)"


#: Candidates of texts that can hold an IBAN at all, and of the others.
CANDIDATE, PLAIN = _candidate([*PATTERNS]), _candidate([k for k in PATTERNS if k != "iban"])
#: What every IBAN holds, and every other candidate: an @, or three digits with at most one separator between two of them.
MAY_IBAN, MAY = r"[A-Z]{2}\d{2}", r"@|\d[ .-]?\d[ .-]?\d"
KINDS = ("email", "ip", "date", "ssn", "phone", "card", "iban")
_FORMATS = {"date_ymd": "yyyy-MM-dd", "date_dmy": "dd.MM.yyyy", "date_mdy": "MM/dd/yyyy"}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _hash_number(key: str, tweak: str, turn: Column, other: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")


def permute_number(value: Column, low: int, high: int, key: str, tweak: str) -> Column:
    """A permutation of the numbers 0 to low * high - 1: a Feistel network on value / high and value % high."""
    start = F.struct(F.floor(value / F.lit(high)).cast("long").alias("l"), F.pmod(value, F.lit(high)).cast("long").alias("r"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(((s["l"] + _hash_number(key, tweak, i, s["r"])) % low).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _hash_number(key, tweak, i, s["l"])) % high).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * high + s["r"])


def permute_symbols(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """A permutation of arrays of numbers below their radices: a Feistel network on the two halves, added symbol by symbol."""
    half = F.floor(F.size(values) / 2).cast("int")
    cut = lambda a: (F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a) - half))
    (l, r), (lr, rr) = cut(values), cut(radices)
    start = F.struct(l.alias("l"), r.alias("r"), lr.alias("lr"), rr.alias("rr"))

    def added(own: Column, radix: Column, other: Column, turn: Column) -> Column:
        noise = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 512)
        mixed = F.zip_with(own, radix, lambda x, m: F.struct(x.alias("x"), m.alias("m")))
        return F.transform(mixed, lambda p, j: ((p["x"] + F.conv(F.substr(noise, (j * 3) % 120 + 1, F.lit(3)), 16, 10).cast("int")) % p["m"]).cast("int"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(added(s["l"], s["lr"], s["r"], i).alias("l"), s["r"].alias("r"), s["lr"].alias("lr"), s["rr"].alias("rr"))).otherwise(F.struct(s["l"].alias("l"), added(s["r"], s["rr"], s["l"], i).alias("r"), s["lr"].alias("lr"), s["rr"].alias("rr")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _respell(pattern: Column, symbols: Column, taken: str) -> Column:
    """pattern with its characters of the class `taken` replaced, in order, by the array symbols."""
    rank = lambda j: F.length(F.regexp_replace(F.substr(pattern, F.lit(1), j + 1), f"[^{taken}]", ""))
    return F.array_join(F.transform(F.split(pattern, ""), lambda c, j: F.when(c.rlike(f"[{taken}]"), F.element_at(symbols, rank(j))).otherwise(c)), "")


def _as_ints(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """Sum of a digit string's Luhn terms; a valid number's ends in 0."""
    return F.aggregate(F.transform(F.reverse(_as_ints(digits)), lambda d, j: F.when(j % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))), F.lit(0), lambda a, d: a + d)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    own = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    chars = F.split(own, "")
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65)
    made = permute_symbols(F.transform(chars, lambda c: F.ascii(c) - base(c)), F.transform(chars, radix), key, F.concat(F.lit("email "), F.lower(domain)))
    spelt = F.zip_with(made, chars, lambda x, c: F.chr(x + base(c)))
    return F.when(F.length(own) > 0, F.concat(_respell(local, spelt, "A-Za-z0-9"), F.lit("@"), domain)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("int"))
    moved = permute_number(number, 65536, 65536, key, "ip")
    return F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda k: F.pmod(F.floor(moved / F.pow(F.lit(2), k)).cast("long"), F.lit(256)).cast("string")), ".")


def _date(m: Column, form: str, key: str) -> Column:
    """Centuries have 36525 = 75 * 487 days if they end in a leap year, else 36524 = 92 * 397."""
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    century = F.floor((F.year(day) - 1) / 100)
    first = F.make_date((century * 100 + 1).cast("int"), F.lit(1), F.lit(1))
    at = F.datediff(day, first).cast("long")
    moved = F.when(century % 4 == 3, permute_number(at, 75, 487, key, "date")).otherwise(permute_number(at, 92, 397, key, "date"))
    return F.when(F.year(day) >= 1, F.date_format(F.date_add(first, moved.cast("int")), form))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    moved = permute_number(index, 898 * 99, 9999, key, "ssn")
    place = F.floor(moved / (99 * 9999)).cast("long")
    new = F.format_string("%03d-%02d-%04d", place + F.when(place >= 665, 2).otherwise(1), F.pmod(F.floor(moved / 9999).cast("long"), F.lit(99)) + 1, F.pmod(moved, F.lit(9999)) + 1)
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), new)


def _phone(m: Column, key: str, us: bool) -> Column:
    digits = _digits(m)
    kept = F.length(digits) - 10 if us else F.lit(2)
    values = _as_ints(F.substr(digits, kept + 1, F.lit(20)))
    if us:  # area and exchange start with 2 to 9; digits 0 and 1 there stay among themselves
        ranged = lambda j: (j == 0) | (j == 3)
        radices = F.transform(values, lambda d, j: F.when(ranged(j), F.when(d > 1, 8).otherwise(2)).otherwise(10))
        lifted = F.transform(values, lambda d, j: F.when(ranged(j) & (d > 1), 2).otherwise(0))
        made = F.zip_with(permute_symbols(F.zip_with(values, lifted, lambda d, x: d - x), radices, key, F.lit("phone")), lifted, lambda d, x: d + x)
    else:
        made = permute_symbols(values, F.transform(values, lambda d: F.lit(10)), key, F.lit("phone"))
    spelt = F.concat(F.slice(_as_ints(digits), F.lit(1), kept), made)
    fits = F.element_at(values, 4) > 1 if us else F.length(digits).between(8, 15)
    return F.when(fits, _respell(m, F.transform(spelt, lambda d: d.cast("string")), "0-9"))


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = _as_ints(F.substr(digits, F.lit(2), F.length(digits) - 2))
    made = permute_symbols(body, F.transform(body, lambda d: F.lit(10)), key, F.concat(F.lit("card "), F.substring(digits, 1, 1)))
    front = F.concat(F.substring(digits, 1, 1), F.array_join(F.transform(made, lambda d: d.cast("string")), ""))
    full = F.concat(front, ((10 - luhn_sum(F.concat(front, F.lit("0"))) % 10) % 10).cast("string"))
    return F.when(luhn_sum(digits) % 10 == 0, _respell(m, F.split(full, ""), "0-9"))


def _mod97(symbols: Column) -> Column:
    """The remainder by 97 of letters and digits, a letter counting as two digits."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(symbols, ""), F.lit(0), lambda a, c: ((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(flat, 1, 2), F.substr(flat, F.lit(5), F.lit(40))
    chars = F.split(body, "")
    radix = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).otherwise(65)
    made = permute_symbols(F.transform(chars, lambda c: F.ascii(c) - base(c)), F.transform(chars, radix), key, F.concat(F.lit("iban "), country))
    new = F.array_join(F.zip_with(made, chars, lambda x, c: F.chr(x + base(c))), "")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(F.concat(body, F.substring(flat, 1, 4))) == 1, _respell(m, F.split(F.concat(country, check, new), ""), "A-Z0-9"))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of a candidate; kind null and the candidate itself if its rule rejects it."""
    octets = F.forall(F.split(m, r"\."), lambda p: p.cast("int") < 256)
    made = {
        "email": ("email", _email(m, key)),
        "ip": ("ip", F.when(octets, _ip(m, key))),
        **{k: ("date", _date(m, f, key)) for k, f in _FORMATS.items()},
        "ssn": ("ssn", _ssn(m, key)),
        "phone_us": ("phone", _phone(m, key, True)),
        "phone_other": ("phone", _phone(m, key, False)),
        "card": ("card", _card(m, key)),
        "iban": ("iban", _iban(m, key)),
    }
    value = None
    for name, (kind, new) in made.items():
        told = F.struct(F.lit(kind).alias("kind"), new.alias("value"))
        test = m.rlike(f"^(?:{PATTERNS[name]})$")
        value = F.when(test, told) if value is None else value.when(test, told)
    value = value.otherwise(F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("value")))
    return value


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with pseudonyms in text_col; with counts also n_<kind> for each of KINDS. Names that are taken then are an error."""
    names = docs.columns
    if counts:
        need_free(docs, [f"n_{k}" for k in KINDS])
    at, plain = names.index(text_col), docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{at}")
    iban, some = text.rlike(MAY_IBAN), text.rlike(MAY)
    listed = lambda pattern: F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = plain.withColumn("found", F.when(iban, listed(CANDIDATE)).when(some, listed(PLAIN)))
    made = found.withColumn("made", F.transform("found", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new"))))
    gaps = F.when(iban, F.split(text, CANDIDATE, -1)).otherwise(F.split(text, PLAIN, -1))
    told = F.concat(F.transform("made", lambda x: F.coalesce(x["new"]["value"], x["old"])), F.array(F.lit("")))
    joined = F.when(F.col("made").isNull(), text).otherwise(F.array_join(F.zip_with(gaps, told, lambda g, v: F.concat(g, v)), ""))
    n = lambda kind: F.coalesce(F.size(F.filter("made", lambda x: (x["new"]["kind"] == kind) & x["new"]["value"].isNotNull())), F.lit(0)).cast("long")
    columns = [joined.alias(f"c{i}") if i == at else F.col(f"c{i}") for i in range(len(names))]
    if counts:
        return made.select(*columns, *[F.when(F.col("made").isNull(), F.lit(0).cast("long")).otherwise(n(k)).alias(f"n_{k}") for k in KINDS]).toDF(*names, *[f"n_{k}" for k in KINDS])
    return made.select(*columns).toDF(*names)
