"""Format-preserving pseudonyms by keyed Feistel permutations.

Found values are checked (Luhn sums, IBAN remainders, calendar days, octets,
number plans) and then permuted among the values of their own format: same
length, same separators, same kinds of characters, check digits made anew. The
permutation is a keyed Feistel network over the format's count of values, walked
until it lands among them, so it is one to one and equal values of a kind stay
equal in every document; ``inverse=True`` turns texts back with the key.

Kinds, in order of precedence where they overlap: e-mail (the part before @),
assigned and well-known secrets, IBANs, IPv4 addresses, dates of 1900-2099,
social security numbers, payment cards, telephone numbers. A candidate that fails
its check or meets an earlier finding is read again at every shorter and later
place. Cards are read at every length of 13-19 digits between any two separators:
usual groupings first, then others from the left, longest first; odd groupings
beside a hyphen come after telephone numbers. A row of short numbers is a card
where its Luhn sum happens to fit.

Defined results: null text: null text, no findings; empty text: as it is; texts
without findings come back unchanged; a null doc_id stays null; repeated rows
give equal results; an empty table gives an empty result. ``replace`` changes
the ``text`` column and passes all others through, whatever their names.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import string
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parley.llm import text as tx

KEY = b"parley-pseudonyms"  # a default for runs and tests; give your own
ROUNDS = 8
BLOCK = 256  # characters permuted as one number
KINDS = ["email", "secret", "iban", "ip", "date", "ssn", "card", "phone"]

_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()

_DIGIT_RUN = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}")
_GROUP = re.compile(r"[0-9]+")
#: Groupings on cards, besides 13-19 digits in one group.
_CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (6, 13)}
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_SECRET_KEY = r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:(?:[_-][A-Za-z0-9]{1,32}){1,4}|key|id|value|hash)?\\?[\"']?\s?[=:]\s?"
#: What every well-known secret contains.
_SECRET_PREFIX = r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-"
PATTERNS: dict[str, list[re.Pattern]] = {
    "email": [re.compile(r"(?<![\w.%+-])([\w.%+-]{1,64})@(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![^\W_])")],
    "secret": [
        re.compile(_SECRET_KEY + r'"([^"\n\\]{6,})"', re.IGNORECASE),
        re.compile(_SECRET_KEY + r"'([^'\n\\]{6,})'", re.IGNORECASE),
        # to a blank, a quote or the next assignment, without closing marks
        re.compile(_SECRET_KEY + r"\\?[\"']?((?:(?![,;&]\s?[\"']?[A-Za-z0-9_-]{1,64}[\"']?\s?[=:])[^\s\"'<>`]){6,})(?<![.,;:!?)\]}\\])", re.IGNORECASE),
        re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z0-9]{16})(?![A-Za-z0-9])"),
        re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[abprs]-)([A-Za-z0-9_-]{16,})"),
    ],
    "iban": [re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")],
    "ip": [re.compile(r"(?<![\d.])((?:\d{1,3}\.){3}\d{1,3})(?!\d|\.\d)", re.ASCII)],
    "date": [
        re.compile(r"(?<![\d/.-])(\d{4}([-/.])\d{2}\2\d{2})(?!\d|[-/.]\d)", re.ASCII),
        re.compile(r"(?<![\d/.-])(\d{2}([-/.])\d{2}\2\d{4})(?!\d|[-/.]\d)", re.ASCII),
    ],
    "ssn": [re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])", re.ASCII)],
    "phone": [
        re.compile(r"(?<![\d(+])((?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4})(?!\d)", re.ASCII),
        re.compile(r"(?<![\d.-])((?:\+?1[ .-])?\d{3}([ .-])\d{3}\2\d{4})(?!\d|[.-]\d)", re.ASCII),
        re.compile(r"(?<![\d+])(\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?!\d)", re.ASCII),
        # every form of parley.functions.pii, but not within a longer number
        re.compile(r"(?<!\d)((?:\+?1[ .-]?)?\(?\d{3}\)?[\s.-]?\d{3}[ .-]?\d{4})\b"),
    ],
}


@lru_cache(maxsize=1 << 14)
def _alike(c: str) -> str:
    """The letters or digits that may stand for ``c``: ASCII classes, else the same category in the same 256 code points."""
    for some in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        if c in some:
            return some
    if not c.isalnum():
        return ""
    kind, block = unicodedata.category(c), ord(c) & ~255
    return "".join(x for x in map(chr, range(max(block, 128), block + 256)) if x.isalnum() and unicodedata.category(x) == kind)


class Cipher:
    """Keyed permutations of ``range(size)``, one for each (label, size)."""

    def __init__(self, key: bytes = KEY, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse

    def _round(self, label: bytes, bits: int, number: int, half: int) -> int:
        n = (bits + 7) // 8
        out = b""
        block = 0
        while len(out) < n:
            out += hashlib.blake2b(b"%b|%d|%d|%d|%d" % (label, bits, number, block, half), key=self.key).digest()
            block += 1
        return int.from_bytes(out[:n], "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, label: str) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        tag = f"{label}:{size}".encode()
        low = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & low
            if self.inverse:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tag, bits, i, left), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(tag, bits, i, right)
            value = left << bits | right
            if value < size:
                return value

    def mixed(self, values: list[int], sizes: list[int], label: str) -> list[int]:
        """Permute a tuple of numbers below ``sizes`` as one number."""
        whole, size = 0, 1
        for v, s in zip(values, sizes):
            whole, size = whole * s + v, size * s
        whole = self.permute(whole, size, label)
        out = []
        for s in reversed(sizes):
            whole, v = divmod(whole, s)
            out.append(v)
        return out[::-1]

    def blocks(self, values: list[int], sizes: list[int], label: str) -> list[int]:
        """``mixed`` by blocks of ``BLOCK`` numbers, so that long values take linear time."""
        out = []
        for i in range(0, len(values), BLOCK):
            out += self.mixed(values[i : i + BLOCK], sizes[i : i + BLOCK], f"{label}/{i}" if i else label)
        return out

    def characters(self, value: str, label: str) -> str:
        """Letters and digits permuted within their classes; hexadecimal strings stay hexadecimal."""
        if len(value) >= 16 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", value):
            got = [int(c, 16) for c in value]
            while True:  # among the strings with a letter, so that a result is read the same way back
                got = self.blocks(got, [16] * len(value), label)
                if max(got) > 9:
                    return "".join("0123456789abcdef"[x] for x in got)
        kinds = [_alike(c) for c in value]
        at = [i for i, k in enumerate(kinds) if k]
        out = list(value)
        for i, x in zip(at, self.blocks([kinds[i].index(value[i]) for i in at], [len(kinds[i]) for i in at], label)):
            out[i] = kinds[i][x]
        return "".join(out)


def luhn(digits: str) -> int:
    """The digit that completes ``digits`` to a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _email(v: str, c: Cipher) -> str | None:
    return c.characters(v, "email") if any(x.isalnum() for x in v) else None


def _secret(v: str, c: Cipher) -> str | None:
    return c.characters(v, "secret") if any(x.isalnum() for x in v) else None


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(x, 36)) for x in f"{rest}{country}00")) % 97


def _iban(v: str, c: Cipher) -> str | None:
    plain = v.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or len(plain) != _IBAN_LENGTHS.get(country, len(plain)) or int(check) != _iban_check(country, rest):
        return None
    rest = c.characters(rest, f"iban{country}")
    it = iter(f"{country}{_iban_check(country, rest):02d}{rest}")
    return "".join(x if x == " " else next(it) for x in v)


def _ip(v: str, c: Cipher) -> str | None:
    octets = [int(x) for x in v.split(".")]
    if max(octets) > 255 or any(str(o) != x for o, x in zip(octets, v.split("."))):
        return None
    low = [0 if o < 10 else 10 if o < 100 else 100 for o in octets]
    sizes = [{0: 10, 10: 90, 100: 156}[x] for x in low]
    got = c.mixed([o - x for o, x in zip(octets, low)], sizes, "ip" + "".join(map(str, sizes)))
    return ".".join(str(x + y) for x, y in zip(got, low))


def _date(v: str, c: Cipher) -> str | None:
    mark = v[4] if "0" > v[4] or v[4] > "9" else v[2]
    parts = v.split(mark)
    year_first = len(parts[0]) == 4
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]  # year, month, day: days come first unless that is no date
    for y, m, d in orders:
        try:
            day = dt.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        new = c.permute(day, _DAYS, "date") if year_first else _two_way_date(day, (y, m, d), c)
        new = dt.date.fromordinal(_FIRST_DAY + new)
        out = ["", "", ""]
        out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return mark.join(out)
    return None


def _two_way_date(day: int, order: tuple[int, int, int], c: Cipher) -> int:
    """Days written before the year: those that only read month first walk among themselves, so that a result is read the same way back."""
    month_first = order[1] == 0
    while True:
        day = c.permute(day, _DAYS, "date")
        if not month_first or dt.date.fromordinal(_FIRST_DAY + day).day > 12:
            return day


def _ssn(v: str, c: Cipher) -> str | None:
    area, group, serial = (int(x) for x in v.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    a, g, s = c.mixed([place, group - 1, serial - 1], [898, 99, 9999], "ssn")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _card(v: str, c: Cipher) -> str | None:
    digits = _digits(v)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 2
    got = int(digits[1:-1])
    while True:  # among cards that complete longer numbers alike, so that digits beside a result are read the same way back
        got = c.permute(got, 10**n, f"card{digits[0]}")
        body = f"{digits[0]}{got:0{n}d}"
        new = body + str(luhn(body))
        if luhn(new) == luhn(digits):
            return _refill(v, new)


def _phone(v: str, c: Cipher) -> str | None:
    digits = _digits(v)
    home = len(digits) == 10 or (len(digits) == 11 and digits[0] == "1" and (not v.startswith("+") or v.startswith("+1")))
    if home:
        ten = digits[-10:]
        if ten[0] in "01" or ten[3] in "01":  # no number plan has it, but it is written as one
            while True:  # among such numbers, so that a result is read the same way back
                ten = f"{c.permute(int(ten), 10**10, 'phone0'):010d}"
                if ten[0] in "01" or ten[3] in "01":
                    return _refill(v, digits[:-10] + ten)
        sizes = [800, 800, 10_000]
        a, b, d = c.mixed([int(ten[:3]) - 200, int(ten[3:6]) - 200, int(ten[6:])], sizes, "phone1")
        return _refill(v, f"{digits[:-10]}{a + 200:03d}{b + 200:03d}{d:04d}")
    if v.startswith("+") and 8 <= len(digits) <= 15:
        code, rest = digits[:2], digits[2:]
        return _refill(v, code + f"{c.permute(int(rest), 10 ** len(rest), 'phone' + code):0{len(rest)}d}")
    return None


CHECKS: dict[str, Callable[[str, Cipher], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}


class Taken:
    """Places already found; none overlap."""

    def __init__(self):
        self.starts, self.ends = [], []

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        insort(self.starts, a), insort(self.ends, b)


def _card_valid(v: str) -> bool:
    digits = _digits(v)
    return luhn(digits[:-1]) == int(digits[-1])


def _card_readings(text: str, a: int, b: int, taken: Taken, loose: bool) -> list[tuple[int, int, int, int]]:
    """(rank, start, -end, end) of 13-19 digits between any two separators of the digit run ``text[a:b]``."""
    groups = [g.span() for g in _GROUP.finditer(text, a, b)]
    out = []
    for i, (s, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            e = groups[j][1]
            n += e - groups[j][0]
            if n > 19:
                break
            if n < 13 or text[s] == "0" or taken.meets(s, e):
                continue
            usual = text[s] in "23456" and (i == j or tuple(y - x for x, y in groups[i : j + 1]) in _CARD_GROUPS)
            beside = text[s - 1 : s] == "-" or (text[e : e + 1] == "-" and text[e + 1 : e + 2].isdigit())
            if usual or loose or not beside:
                out.append((0 if usual else 2 if beside else 1, s, -e, e))
    return out


def _cards(text: str, cipher: Cipher, taken: Taken, loose: bool) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards of every digit run."""
    out = []
    for m in _DIGIT_RUN.finditer(text):
        readings = _card_readings(text, *m.span(), taken, loose)
        cards, held = {}, Taken()
        for r in sorted(r for r in readings if _card_valid(text[r[1] : r[3]])):
            if not held.meets(r[1], r[3]):
                held.add(r[1], r[3])
                cards[r[1]] = r
        if not cards:
            continue
        run, base = list(m[0]), m.start()
        first = [r[1] for r in readings]
        for s in sorted(cards, reverse=cipher.inverse):
            card = cards[s]
            e = card[3]
            rivals = []  # readings that would be taken before this card if they were valid
            for r in readings[bisect_left(first, s - 37) : bisect_left(first, e)]:
                if r[3] > s and r < card:
                    i, k = bisect_right(held.ends, r[1]), bisect_left(held.starts, r[3])
                    if not any(cards[x] < r for x in held.starts[i:k]):
                        rivals.append(r)
            while True:  # until the run is read in the same way, with the others as they now are
                run[s - base : e - base] = _card("".join(run[s - base : e - base]), cipher)
                if not any(_card_valid("".join(run[r[1] - base : r[3] - base])) for r in rivals):
                    break
        out += [(s, r[3], "".join(run[s - base : r[3] - base])) for s, r in cards.items()]
    return out


def _gaps(a: int, b: int, taken: Taken) -> Iterator[tuple[int, int]]:
    """The parts of a secret that no earlier finding holds."""
    while a < b:
        i = bisect_right(taken.ends, a)
        start, end = (taken.starts[i], taken.ends[i]) if i < len(taken.starts) else (b, b)
        if a < start:
            yield a, min(b, start)
        a = max(a, end)


def _ends(kind: str, pattern: re.Pattern, text: str, a: int, b: int) -> Iterator[int]:
    """Ends of the readings from ``a``, the longest first."""
    yield b
    if kind in ("iban", "phone"):
        for e in range(b - 1, a + 7, -1):
            if text[e - 1].isalnum() and not text[e].isalnum() and pattern.fullmatch(text, a, e):
                yield e


def find(text: str, cipher: Cipher) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every checked value, in text order, none overlapping."""
    taken, out = Taken(), []

    def add(a: int, b: int, kind: str, new: str) -> None:
        taken.add(a, b)
        out.append((a, b, kind, new))

    def add_cards(loose: bool) -> None:
        for a, b, new in _cards(text, cipher, taken, loose):
            add(a, b, "card", new)

    for kind in KINDS:
        if kind == "card":
            add_cards(loose=False)
            continue
        for pattern in PATTERNS[kind]:
            at = 0
            while m := pattern.search(text, at):
                a, b = m.span(1)
                at = m.start() + 1
                if kind == "secret" and taken.meets(a, b):
                    for x, y in list(_gaps(a, b, taken)):
                        if (new := _secret(text[x:y], cipher)) is not None:
                            add(x, y, kind, new)
                    at = b
                    continue
                for e in _ends(kind, pattern, text, a, b):
                    if not taken.meets(a, e) and (new := CHECKS[kind](text[a:e], cipher)) is not None:
                        add(a, e, kind, new)
                        at = e
                        break
    add_cards(loose=True)  # odd groupings beside a hyphen may be parts of telephone numbers
    return sorted(out)


def pseudonymise(text: str, cipher: Cipher) -> tuple[str, list[str]]:
    found = find(text, cipher)
    parts, last = [], 0
    for a, b, _, new in found:
        parts += [text[last:a], new]
        last = b
    return "".join([*parts, text[last:]]) if found else text, [k for _, _, k, _ in found]


_HINT = np.zeros(256, bool)
_HINT[list(b"0123456789@=:")] = True


def _replaced(column: pa.Array, cipher: Cipher) -> tuple[pa.Array, list[list[str]]]:
    """New texts and the kinds found; texts without a digit, @, =, : or the beginning of a well-known secret hold no value of any kind and are not searched."""
    import pyarrow.compute as pc

    full = tx.filled(column)
    hinted = [np.zeros(0, bool)]
    for a, b in tx.slices(full, 8 << 20):
        data, offsets = tx.raw(full.slice(a, b - a))
        hinted.append(tx.per_row(_HINT[data], offsets) > 0)
    prefixed = np.asarray(pc.match_substring_regex(full, _SECRET_PREFIX).to_numpy(zero_copy_only=False), bool)
    rows = np.flatnonzero(np.concatenate(hinted) | prefixed)
    kinds: list[list[str]] = [[] for _ in range(len(full))]
    new: dict[int, str] = {}
    for i in rows.tolist():
        text, kinds[i] = pseudonymise(full[i].as_py(), cipher)
        if kinds[i]:
            new[i] = text
    if new:
        mask = np.zeros(len(full), bool)
        mask[list(new)] = True
        column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[i] for i in sorted(new)], column.type))
    return column, kinds


def replace(docs: DataFrame, key: bytes = KEY, inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key, inverse)
        for b in batches:
            yield b.set_column(at, b.schema.field(at), _replaced(b.column(at), cipher)[0])

    return docs.mapInArrow(run, docs.schema)


def findings(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text (with pseudonyms), n_found and n_<kind> of every document."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], *(T.StructField(f"n_{k}", T.LongType()) for k in ["found", *KINDS])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Cipher(key)
        for b in batches:
            texts, kinds = _replaced(b.column("text"), cipher)
            counts = [pa.array([len(k) for k in kinds], pa.int64())] + [pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts, *counts], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Query: every document's text with pseudonyms, and the findings by kind."""
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
