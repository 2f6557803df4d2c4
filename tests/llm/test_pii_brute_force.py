"""Pseudonyms against a plain Python version of the same permutations, and the cheap test against every pattern."""

import datetime
import hashlib
import random
import re

import pytest

from tidewell.llm import pii

KEY = "key"
rng = random.Random(21)


def noise(*parts, bits=256):
    return getattr(hashlib, f"sha{bits}")("|".join([KEY, *map(str, parts)]).encode()).hexdigest()


def move_number(value, low, high, tweak):
    left, right = divmod(value, high)
    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            left = (left + int(noise(tweak, turn, right)[:12], 16)) % low
        else:
            right = (right + int(noise(tweak, turn, left)[:12], 16)) % high
    return left * high + right


def move_symbols(values, radices, tweak):
    half = len(values) // 2
    parts, bases = [values[:half], values[half:]], [radices[:half], radices[half:]]
    for turn in range(pii.ROUNDS):
        own, other = turn % 2, 1 - turn % 2
        told = noise(tweak, turn, ",".join(map(str, parts[other])), bits=512)
        parts[own] = [(x + int(told[j * 3 % 120 : j * 3 % 120 + 3], 16)) % m for j, (x, m) in enumerate(zip(parts[own], bases[own], strict=True))]
    return parts[0] + parts[1]


def respell(pattern, symbols, kind):
    left = iter(symbols)
    return "".join(str(next(left)) if re.fullmatch(kind, c) else c for c in pattern)


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def radix(c):
    return 10 if c.isdigit() else 26


def base(c):
    return ord("0" if c.isdigit() else "a" if c.islower() else "A")


def move_text(chars, tweak):
    moved = move_symbols([ord(c) - base(c) for c in chars], [radix(c) for c in chars], tweak)
    return [chr(x + base(c)) for x, c in zip(moved, chars, strict=True)]


def email(m):
    local, domain = m.split("@")
    chars = re.findall("[A-Za-z0-9]", local)
    return respell(local, move_text(chars, "email " + domain.lower()), "[A-Za-z0-9]") + "@" + domain if chars else m


def ip(m):
    octets = [int(x) for x in m.split(".")]
    if max(octets) > 255:
        return None
    moved = move_number(int.from_bytes(bytes(octets), "big"), 65536, 65536, "ip")
    return ".".join(str(b) for b in moved.to_bytes(4, "big"))


def date(m, form):
    try:
        day = datetime.datetime.strptime(m, form).date()
    except ValueError:
        return None
    century = (day.year - 1) // 100
    first = datetime.date(century * 100 + 1, 1, 1)
    low, high = (75, 487) if century % 4 == 3 else (92, 397)
    moved = first + datetime.timedelta(move_number((day - first).days, low, high, "date"))
    return form.replace("%Y", f"{moved.year:04}").replace("%m", f"{moved.month:02}").replace("%d", f"{moved.day:02}")


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    valid = [a for a in range(1, 900) if a != 666]
    moved = move_number((valid.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, "ssn")
    return f"{valid[moved // (99 * 9999)]:03}-{moved // 9999 % 99 + 1:02}-{moved % 9999 + 1:04}"


def phone(m, us):
    digits = re.findall(r"\d", m)
    if not us and not 8 <= len(digits) <= 15:
        return None
    kept = len(digits) - 10 if us else 2
    values = [int(d) for d in digits[kept:]]
    if us and values[3] < 2:
        return None
    bound = [(8, 2) if d > 1 else (2, 0) for d in values] if us else []
    spans = [bound[j] if us and j in (0, 3) else (10, 0) for j in range(len(values))]
    moved = move_symbols([d - low for d, (_, low) in zip(values, spans, strict=True)], [n for n, _ in spans], "phone")
    return respell(m, [*digits[:kept], *[x + low for x, (_, low) in zip(moved, spans, strict=True)]], r"\d")


def card(m):
    digits = re.sub(r"\D", "", m)
    if luhn(digits):
        return None
    body = move_symbols([int(d) for d in digits[1:-1]], [10] * (len(digits) - 2), "card " + digits[0])
    front = digits[0] + "".join(map(str, body))
    return respell(m, front + str((10 - luhn(front + "0")) % 10), r"\d")


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m):
    flat = m.replace(" ", "")
    if mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = "".join(move_text(flat[4:], "iban " + flat[:2]))
    return respell(m, flat[:2] + f"{98 - mod97(body + flat[:2] + '00'):02}" + body, "[A-Z0-9]")


RULES = {
    "email": ("email", email), "ip": ("ip", ip), "date_ymd": ("date", lambda m: date(m, "%Y-%m-%d")), "date_dmy": ("date", lambda m: date(m, "%d.%m.%Y")), "date_mdy": ("date", lambda m: date(m, "%m/%d/%Y")),
    "ssn": ("ssn", ssn), "phone_us": ("phone", lambda m: phone(m, True)), "phone_other": ("phone", lambda m: phone(m, False)), "card": ("card", card), "iban": ("iban", iban),
}


def brute(text):
    counts = dict.fromkeys(pii.KINDS, 0)

    def one(found):
        m = found[0]
        name = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, m, re.ASCII))
        kind, rule = RULES[name]
        new = rule(m)
        counts[kind] += new is not None
        return m if new is None else new

    pattern = pii.CANDIDATE if re.search(pii.MAY_IBAN, text) else pii.PLAIN
    return re.sub(pattern, one, text, flags=re.ASCII), counts


def digits(n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def a_card(n, sep=""):
    front = digits(n - 1)
    full = front + str((10 - luhn(front + "0")) % 10)
    return sep.join(full) if sep else full


def an_iban(country, n):
    body = digits(n - 4)
    return country + f"{98 - mod97(body + country + '00'):02}" + body


def value():
    d = datetime.date(1600, 1, 1) + datetime.timedelta(rng.randrange(200_000))
    made = an_iban("DE", 22)
    return rng.choice([
        f"{rng.choice('abcXYZ')}{digits(2)}.{rng.choice(['foo', 'Bar'])}@mail.example.com", f"_@{digits(1)}x.org", ".".join(str(rng.randrange(300)) for _ in range(4)), f"{d.year:04}-{d.month:02}-{d.day:02}", f"{d.day:02}.{d.month:02}.{d.year:04}",
        f"{d.month:02}/{d.day:02}/{d.year:04}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+1 {digits(3)}.{digits(3)}.{digits(4)}", "000-000-0000", f"+44 {digits(4)} {digits(3)} {digits(3)}",
        a_card(16), a_card(13, " "), a_card(19, "-"), digits(16), made, " ".join(made[i : i + 4] for i in range(0, len(made), 4)), an_iban("ZZ", 20), "DE00" + digits(18), "v1.2", "a@b", "1 2 3", "word",
    ])


def test_against_plain_python(spark):
    texts = [" ".join([rng.choice(["see", "x:", "(", "—"]), *[f"{value()}{rng.choice(['', ',', ' and'])}" for _ in range(rng.randint(1, 6))]]) for _ in range(400)]
    texts += ["", "4 7 9 9 1 3 4 6 8 1 0 4 4 2 0 6", "long " * 30_000 + a_card(16) + " tail" * 10, "none at all"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None), (None, texts[0])]
    found = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), KEY, counts=True).collect()
    assert len(found) == len(rows)
    total = dict.fromkeys(pii.KINDS, 0)
    for r in found:
        if r["doc_id"] == -1:
            assert r["text"] is None and not any(r[f"n_{k}"] for k in pii.KINDS)
            continue
        text, counts = brute(texts[r["doc_id"] or 0])
        assert r["text"] == text, texts[r["doc_id"] or 0][:300]
        assert {k: r[f"n_{k}"] for k in pii.KINDS} == counts
        for k, n in counts.items():
            total[k] += n
    assert min(total.values()) >= 10, total


def test_spaced_card_and_zero_phone(spark):
    rows = [(1, "pay 4 7 9 9 1 3 4 6 8 1 0 4 4 2 0 6 now"), (2, "call 000-000-0000"), (3, "call 319-555-5132")]
    out = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), KEY, counts=True).collect()}
    assert out[1]["n_card"] == 1 and out[1]["text"] != rows[0][1] and out[2]["text"] == rows[1][1] and out[3]["n_phone"] == 1


@pytest.mark.parametrize("name", sorted(pii.PATTERNS))
def test_cheap_test_lets_every_candidate_through(name):
    may = pii.MAY_IBAN if name == "iban" else pii.MAY
    seen = 0
    for _ in range(20_000):
        m = re.search(pii.PATTERNS[name], value(), re.ASCII)
        if m:
            seen += 1
            assert re.search(may, m[0], re.ASCII), m[0]
    # Shapes that a generator of real values would not make.
    for sample in ("1.2.3.4", "9 9 9 9 9 9 9 9 9 9 9 9 9", "9-9-9-9-9-9-9-9-9-9-9-9-9", "(012) 345-6789", "+2 12 12 12", "+23-12-12", "a@b.co", "0000-00-00", "00.00.0000", "00/00/0000", "AA00 A0A0 A0A0"):
        m = re.search(pii.PATTERNS[name], sample, re.ASCII)
        assert not m or re.search(may, m[0], re.ASCII), sample
    assert seen > 100


def test_taken_names_are_an_error(spark):
    with pytest.raises(ValueError, match="n_card"):
        pii.pseudonymize(spark.createDataFrame([("x", 1)], "text string, n_card int"), KEY, counts=True)
