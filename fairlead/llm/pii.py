r"""Personal data replaced by keyed surrogates of the same kind.

Found are e-mail addresses, telephone, card, social security and bank account
numbers, IPv4 and IPv6 addresses, hexadecimal secrets of 32 digits or more, and
names after a form of address. Telephone numbers are found with a leading ``+``,
in national groupings (area code in parentheses, 3-3-4 digits, leading 0), and
as any digits after a word such as "tel". A number written both with and without
its country code is two entities. An entity is its kind and canonical form (digits only, lower case, ...).
Its surrogate follows from key, kind, canonical form and attempt, so it is the
same wherever the entity occurs, without a table of all entities at hand. Except
for names it is a keyed permutation without fixed points of the values of the
same form (``_moved``): numbers keep their length and first digit, check digits
their validity, addresses their private or public range, letters and digits
their places and scripts, secrets over 128 digits only their length. So two
entities of a form never share a surrogate, however many values of it are real.
E-mail domains are permuted by themselves and end in ``.example`` after their own
ending, so distinct domains stay distinct and addresses of one domain together.
Names keep gender (from the form of address, if that tells it) and script. The
surrogate is written in the format and case of each
occurrence. Name parts are entities of their own, and every whole-word mention
of a part in a document that addresses the person is replaced, so short forms
still refer to the same surrogate.

Collision check: no two entities of a kind may share a surrogate, and none may be
an entity that really occurs. The distinct entities are a table; those whose
surrogate is real or (names only) taken make another attempt. A permuted kind
makes at most ``ROUNDS`` further ones and then goes back to the first, which is
nobody else's but may be another real entity; that happens only in forms of which
a good part of all values occurs. Names get a syllable more with each attempt, so
they always end. Only entities past their first attempt need to be told to
the replacing pass; they reach the documents that hold them by a join.

Defined results: a null text stays null. Rows without an id are replaced too
(their entities take part in the check). Equal rows get equal results; rows with
one id are told apart by a hash of their text. Other columns are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlead.llm.common import query, stored, table
from fairlead.llm.tokens import small_batches

DEFAULT_KEY = b"replace this key in production"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н")
_FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra", "Srta", "Signora", "г-жа")
#: Forms that tell no gender.
_EITHER = ("Dr", "Prof")
_H = "[0-9A-Fa-f]{1,4}"
#: No part of a longer number, word, date or version.
_FREE, _ENDS = r"(?<![\w+/-])(?<!\d[.,:])", r"(?!\w|[-/.,:]\d)"
#: National forms: (743) 555-3824, 1-743-555-3824, (11) 91234-5678, (0171) 2345678, 0171 2345678, 020 7946 0958,
#: 02-1234-5678, 01 23 45 67 89, 044 668 18 00.
_NATIONAL = (
    r"(?:1[-. ])?(?:\(\d{3}\)[-. ]?\d{3}[-. ]?\d{4}|\d{3}(?P<sep>[-. ])\d{3}(?P=sep)\d{4})"
    r"|\(\d\d\) ?\d{4,5}-\d{4}"
    r"|\(0\d{1,5}\)[ /-]?(?:\d{5,8}|\d{2,4}(?:[ -]\d{2,4}){1,3})"
    r"|0\d{2,4}[ /-]\d{5,8}"
    r"|0\d(?:\d{1,3}[ /-]|[ -])\d{3,4}[ -]\d{3,4}(?:[ -]\d{2,4})?"
    r"|0\d(?P<pair>[-. ])\d{2}(?:(?P=pair)\d{2}){3}"
    r"|0\d{2,4}[ /-]\d{2,3}(?:[ -]\d{2,3}){2,3}"
)
_CALLED = (
    r"(?i:\b(?:tel(?:ephone|efon|efono|éfono|éphone)?|phone|fon|mobile?|cell|handy|fax|тел(?:ефон)?)\b"
    r"\.?(?: ?(?:no|nr|number|nummer)\b\.?)?[:= ]{1,3})"
)
_NUMBERS = re.compile(
    r"(?P<email>[\w.+-]*\w@\w[\w-]*(?:\.\w[\w-]*)+)"
    r"|(?P<hex>(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w+])\+\d[\d ()./-]{6,20}\d(?!\d))"
    rf"|(?P<ip6>(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?=[A-Fa-f:]*\d)[0-9A-Fa-f]{{3,4}}(?::{_H}){{0,5}}::(?:{_H}(?::{_H}){{0,5}})?)"
    r"(?!\w|:[0-9A-Fa-f:]|\.\d))"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d))"
    rf"|{_FREE}(?P<phone_national>{_NATIONAL}){_ENDS}"
    rf"|{_CALLED}(?!\d{{4}}-\d\d-\d\d|{_OCTET}(?:\.{_OCTET}){{3}})(?P<phone_called>\d(?:[ ()./-]{{0,2}}\d){{5,13}})(?![ -]?\d|\w)"
)
_WANTED = re.compile(r"[0-9@]|[A-Fa-f]{32}")
_FORMS = tuple(sorted((*_MALE, *_FEMALE, *_EITHER), key=len, reverse=True))
_NAMES = re.compile(
    rf"\b(?P<form>{'|'.join(map(re.escape, _FORMS))})\.?[ ](?:(?:Dr|Prof)\.? )*"
    r"(?P<name>[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[ -][^\W\d_a-zа-яα-ω][^\W\d_]+){0,2})"
)
#: Syllables of invented names by script; distinct in sound, none longer than two letters.
_SYLLABLES = {
    "LATIN": ("bcdfghklmnprstvz", "aeiou", "n", "a"),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", "н", "а"),
    "GREEK": ("βγδζκλμνπρστ", "αεηιου", "ς", "α"),
}


class _Stream:
    """Bytes that follow from key, kind, canonical form and attempt."""

    def __init__(self, key: bytes, *parts: object) -> None:
        self.key, self.seed, self.block, self.rest = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        while len(self.rest) < 4:
            self.rest += hmac.new(self.key, self.seed + b"\x1f%d" % self.block, hashlib.sha256).digest()
            self.block += 1
        value, self.rest = int.from_bytes(self.rest[:4], "big"), self.rest[4:]
        return value % n


#: Kinds whose surrogates are a permutation of the values of one form.
PERMUTED = ("email", "hex", "iban", "phone", "ip6", "ip", "ssn", "card")
#: Further attempts of a permuted kind before the first one stands.
ROUNDS = 8
#: Rounds of the Feistel network.
_FEISTEL = 8
#: Characters that are permuted as one number; of longer texts a stream takes the place.
_LONGEST = 128


def _mix(secret: bytes, value: int, size: int, back: bool = False) -> int:
    """A keyed permutation of the numbers below ``size`` (at least 2), or its inverse.

    A Feistel network over a grid of about square form; the few cells past the
    end are walked through until a number below ``size`` is met again.
    """
    tall = isqrt(size - 1) + 1
    wide = -(-size // tall)
    n = (tall.bit_length() + 7) // 8
    while True:
        left, right = divmod(value, wide)
        for i in reversed(range(_FEISTEL)) if back else range(_FEISTEL):
            half = left if i % 2 else right
            drawn = hashlib.shake_256(secret + bytes([i]) + half.to_bytes(n, "big")).digest(n + 8)
            step = int.from_bytes(drawn, "big") * (-1 if back else 1)
            if i % 2:
                right = (right + step) % wide
            else:
                left = (left + step) % tall
        value = left * wide + right
        if value < size:
            return value


def _moved(
    key: bytes, form: str, value: int, size: int, attempt: int, belongs: Callable[[int], bool] = lambda _: True
) -> int:
    """Where ``value`` goes among the numbers below ``size`` that belong to the form.

    The numbers stand on a keyed circle, and each goes the same keyed number of
    places on, further while it meets numbers that do not belong. So distinct
    values go to distinct ones, and none to itself unless it is the only one.
    """
    if size < 2:
        return value
    secret = hmac.new(key, form.encode(), hashlib.sha256).digest()
    drawn = hashlib.shake_256(secret + b"step%d" % attempt).digest((size.bit_length() + 7) // 8 + 8)
    step = 1 + int.from_bytes(drawn, "big") % (size - 1)
    at = _mix(secret, value, size)
    while True:
        at = (at + step) % size
        new = _mix(secret, at, size, back=True)
        if belongs(new):
            return new


@cache
def _alphabet(c: str) -> str:
    """The characters that may stand for ``c``: its kind of letter or digit in its block; none for other characters."""
    if not c.isalnum():
        return ""
    if c.isascii():
        return next(x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x)
    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if x.isalnum() and unicodedata.category(x) == unicodedata.category(c) and not x.isascii())


def _like(key: bytes, form: str, text: str, attempt: int) -> str:
    """Another text with letters for letters and digits for digits of the same scripts."""
    alphabets = [_alphabet(c) for c in text]
    form += "\x1f" + "".join(a[0] if a else c for a, c in zip(alphabets, text))
    sizes = [len(a) or 1 for a in alphabets]
    if len(text) > _LONGEST:
        s = _Stream(key, form, text, attempt)
        return "".join(a[s.below(len(a))] if a else c for a, c in zip(alphabets, text))
    value = 0
    for a, c, n in zip(alphabets, text, sizes):
        value = value * n + (a.index(c) if a else 0)
    value, out = _moved(key, form, value, prod(sizes), attempt), []
    for a, c, n in zip(reversed(alphabets), reversed(text), reversed(sizes)):
        value, i = divmod(value, n)
        out.append(a[i] if a else c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _email(key: bytes, canon: str, attempt: int) -> str:
    local, _, domain = canon.rpartition("@")
    labels, _, ending = domain.rpartition(".")
    # The ending stays in front of the reserved one, so that domains differ if they did.
    return f"{_like(key, f'email {domain}', local, attempt)}@{_like(key, f'domain {ending}', labels, 0)}.{ending}.example"


#: (first address, number of addresses) of the IPv4 ranges that keep to themselves: networks for private and special use.
_IP_RANGES = (
    (10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16),
    (127 << 24, 1 << 24), (169 << 24 | 254 << 16, 1 << 16), (0, 1 << 24), (224 << 24, 1 << 29),
)


def _ip(key: bytes, canon: str, attempt: int) -> str:
    value = int(ipaddress.IPv4Address(canon))
    for first, n in _IP_RANGES:
        if first <= value < first + n:
            new = first + _moved(key, f"ip {first}", value - first, n, attempt)
            break
    else:
        public = lambda v: not any(a <= v < a + n for a, n in _IP_RANGES)
        new = _moved(key, "ip", value, 1 << 32, attempt, public)
    return str(ipaddress.IPv4Address(new))


def _ip6(key: bytes, canon: str, attempt: int) -> str:
    groups = [int(g, 16) for g in canon.split(":")]
    # Ranges below 1000 and those for local use, groups and documentation stay; so do zeros of the network.
    kept = 2 if groups[:2] == [0x2001, 0x0DB8] else int(groups[0] >> 12 in (0, 15))
    moving = [i for i in range(kept, 8) if i > 3 or groups[i]]
    # The first group stays inside or outside of the addresses in global use; network groups do not become zero.
    spans = {i: (1, 0xFFFF) if i <= 3 else (0, 0x10000) for i in moving}
    if not kept:
        spans[0] = (0x2000, 0x2000) if groups[0] >> 13 == 1 else (0x4000, 0xB000) if groups[0] >> 14 else (0x1000, 0x1000)
    form = f"ip6 {[g if i not in spans else spans[i] for i, g in enumerate(groups)]}"
    value = 0
    for i in moving:
        value = value * spans[i][1] + groups[i] - spans[i][0]
    value = _moved(key, form, value, prod(n for _, n in spans.values()), attempt)
    for i in reversed(moving):
        value, offset = divmod(value, spans[i][1])
        groups[i] = spans[i][0] + offset
    return ":".join(f"{g:04x}" for g in groups)


def _card(key: bytes, canon: str, attempt: int) -> str:
    body = canon[0] + _like(key, f"card {canon[0]}", canon[1:-1], attempt)
    # A valid number becomes a valid one and no other does.
    off = int(canon[-1]) + luhn(canon[:-1] + "0")
    return body + str((off - luhn(body + "0")) % 10)


def _ssn(key: bytes, canon: str, attempt: int) -> str:
    def issued(v: int) -> bool:
        area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    value = int(canon)
    alike = issued if issued(value) else lambda v: not issued(v)
    return f"{_moved(key, 'ssn', value, 10**9, attempt, alike):09d}"


def _iban(key: bytes, canon: str, attempt: int) -> str:
    country, check, rest = canon[:2], int(canon[2:4]), canon[4:]
    new = _like(key, f"iban {country}", rest, attempt)
    # A valid account stays valid and no other becomes so.
    off = check - int(_iban_check(country, rest))
    return f"{country}{(int(_iban_check(country, new)) + off) % 100:02d}{new}"


def _hex(key: bytes, canon: str, attempt: int) -> str:
    if len(canon) > _LONGEST:
        s = _Stream(key, "hex", canon, attempt)
        return "".join("0123456789abcdef"[s.below(16)] for _ in canon)
    return f"{_moved(key, f'hex {len(canon)}', int(canon, 16), 16 ** len(canon), attempt):0{len(canon)}x}"


def _phone(key: bytes, canon: str, attempt: int) -> str:
    return canon[0] + _like(key, f"phone {canon[0]}", canon[1:], attempt)


_PERMUTATIONS = dict(zip(PERMUTED, (_email, _hex, _iban, _phone, _ip6, _ip, _ssn, _card)))


def _name(key: bytes, kind: str, canon: str, attempt: int) -> str:
    s = _Stream(key, kind, canon, attempt)
    script = unicodedata.name(canon[0], "LATIN").split()[0]
    consonants, vowels, male, female = _SYLLABLES.get(script, _SYLLABLES["LATIN"])
    count = 2 + s.below(2) + attempt
    syllables = "".join(consonants[s.below(len(consonants))] + vowels[s.below(len(vowels))] for _ in range(count))
    closing = consonants[s.below(len(consonants))]
    ending = {"given_f": closing + female, "given_m": closing + vowels[3] + male}.get(kind, closing)
    return syllables + ending


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """Canonical form of the surrogate."""
    if kind in _PERMUTATIONS:
        return _PERMUTATIONS[kind](key, canon, attempt)
    return _name(key, kind, canon, attempt)


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    return text.lower()


def render(kind: str, text: str, value: str) -> str:
    """The surrogate in the format and case of the occurrence ``text``."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(value)
        return "".join(next(rest) if c.isalnum() else c for c in text)
    if kind == "ip6":
        value = ipaddress.IPv6Address(value).compressed if "::" in text else value
    if text.isupper():
        return value.upper()
    return value.capitalize() if kind.startswith(("given", "family")) and text[0].isupper() else value


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of the entities, in order and without overlaps."""
    found = []
    if _WANTED.search(text):
        for m in _NUMBERS.finditer(text):
            kind, text_of = m.lastgroup.split("_")[0], m[m.lastgroup]
            try:
                found.append((*m.span(m.lastgroup), kind, canonical(kind, text_of)))
            except ipaddress.AddressValueError:
                # More groups than an address has.
                continue
    if any(form in text for form in _FORMS):
        parts: dict[str, str] = {}
        for m in _NAMES.finditer(text):
            names = re.split("[ -]", m["name"])
            gender = "m" if m["form"] in _MALE else "f" if m["form"] in _FEMALE else "x"
            for i, name in enumerate(names):
                kind = "family" if i == len(names) - 1 else f"given_{gender}"
                parts.setdefault(name, kind)
                parts.setdefault(name.upper(), kind)
        if parts:
            words = "|".join(map(re.escape, sorted(parts, key=len, reverse=True)))
            taken = [(a, b) for a, b, _, _ in found]
            for m in re.finditer(rf"(?<!\w)(?:{words})(?!\w)", text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    found.append((m.start(), m.end(), parts[m.group()], m.group().lower()))
            found.sort()
    return found


def replace(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, int]:
    """The text with surrogates, and how many entities were replaced."""
    out, at, found = [], 0, find(text)
    for begin, end, kind, canon in found:
        value = surrogate(key, kind, canon, (attempts or {}).get((kind, canon), 0))
        out += [text[at:begin], render(kind, text[begin:end], value)]
        at = end
    return "".join(out) + text[at:], len(found)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = [
            (d, v, kind, canon)
            for d, v, t in zip(*(c.to_pylist() for c in batch.columns))
            if t
            for kind, canon in sorted({(k, c) for _, _, k, c in find(t)})
        ]
        if rows:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc", "version", "kind", "canon"]
            )


def _assigner(key: bytes, make: Callable[[bytes, str, str, int], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, canons, attempts = (batch.column(c).to_pylist() for c in ("kind", "canon", "attempt"))
            values = [make(key, k, c, a) for k, c, a in zip(kinds, canons, attempts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("kind", "canon", "attempt")), pa.array(values, pa.string())],
                ["kind", "canon", "attempt", "value"],
            )

    return run


def assign(entities: DataFrame, key: bytes, make: Callable[[bytes, str, str, int], str] = surrogate) -> DataFrame:
    """Rows kind, canon, attempt, value, distinct within each kind, for distinct rows kind, canon.

    A value is kept if it is no entity and nobody else's: not of an earlier
    attempt, not the first value of a permuted kind (it may be needed again), and
    of this attempt that of the smallest canonical form.
    """
    schema = "kind string, canon string, attempt int, value string"
    run = _assigner(key, make)
    real = entities.select("kind", F.col("canon").alias("value")).withColumn("real", F.lit(True))
    permuted = F.col("kind").isin(*PERMUTED)

    def attempted(rows: DataFrame, attempt: int) -> DataFrame:
        return stored(rows.select("kind", "canon", F.lit(attempt).alias("attempt")).mapInArrow(run, schema))

    tried, kept, attempt, reserved = attempted(entities, 0), [], 0, None
    first = tried.filter(permuted).select("kind", "value")
    while True:
        holders = tried.groupBy("kind", "value").agg(F.min("canon").alias("holder"))
        judged = tried.join(holders, ["kind", "value"]).join(real, ["kind", "value"], "left")
        bad = F.col("real").isNotNull() | (F.col("canon") != F.col("holder"))
        if reserved is not None:
            judged = judged.join(reserved.withColumn("held", F.lit(True)), ["kind", "value"], "left")
            bad = bad | F.col("held").isNotNull()
        judged = stored(judged.select("kind", "canon", "attempt", "value", bad.alias("bad")))
        kept.append(judged.filter("NOT bad").drop("bad"))
        again = judged.filter("bad")
        if attempt == ROUNDS:
            kept.append(attempted(again.filter(permuted), 0))
            again = again.filter(~permuted)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, kept)
        others = [rows.filter(~permuted | (F.col("attempt") > 0)).select("kind", "value") for rows in kept]
        reserved = reduce(DataFrame.unionByName, others, first).distinct()
        attempt += 1
        tried = attempted(again, attempt)


def pseudonymize(
    docs: DataFrame, key: bytes = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Input rows with surrogates in the text, and ``_n_entities``, the number of replaced mentions."""
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{id_col}`").cast("bigint").alias("doc"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("version"),
        F.col(f"`{text_col}`").alias("text"),
    )
    found = rows.select("doc", "version", "text").mapInArrow(
        _occurrences, "doc bigint, version bigint, kind string, canon string"
    )
    found = stored(found.distinct())
    given = assign(found.select("kind", "canon").distinct(), key)
    late = given.filter("attempt > 0").select("kind", "canon", "attempt")
    late = found.join(late, ["kind", "canon"]).groupBy("doc", "version")
    late = stored(late.agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("late")))
    late = late.withColumnsRenamed({"doc": "late_doc", "version": "late_version"})
    same = F.col("doc").eqNullSafe(F.col("late_doc")) & (F.col("version") == F.col("late_version"))
    # Few documents need it, so Spark sends the small table to all tasks; a large one is shuffled.
    joined = rows.join(late, same, "left").select("row", "text", "late")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, counts = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("late").to_pylist()):
                attempts = {(x["kind"], x["canon"]): x["attempt"] for x in own} if own else None
                new, n = replace(text, key, attempts) if text else (text, 0)
                texts.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "new", "n"]
            )

    other = [c for c in names if c != text_col]
    # The text goes to Python once, beside the other columns.
    slim = F.struct(*[F.col(f"row.`{c}`") for c in other]) if other else F.struct(F.lit(0).alias("none"))
    joined = joined.select(slim.alias("row"), "text", "late")
    schema = f"row {joined.schema['row'].dataType.simpleString()}, new string, n bigint"
    done = joined.mapInArrow(run, schema)
    return done.select(
        *[(F.col("new") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names], F.col("n").alias("_n_entities")
    )


@query("op1_pii_surrogates")
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")
