"""Format-preserving pseudonyms: values are found, validated and permuted within their format by a keyed Feistel network."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, small_batches

#: The key used where none is given. Whoever is to keep the values secret gives a key of their own.
KEY = b"vellumspark"
#: The setting of the session that holds the key of the registered query.
KEY_CONF = "spark.vellumspark.pseudonym.key"
ROUNDS = 10
#: Days of 1900 to 2099, which are permuted among themselves; all other days of the calendar are permuted among each other.
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), 200 * 365 + 49
LAST_DAY = dt.date.max.toordinal()
#: Characters of a value that are permuted at once; longer values are permuted in chunks of so many.
CHUNK = 128


def feistel(value: int, domain: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. domain - 1: a balanced Feistel network on the next even number of bits, walked until it falls in the domain."""
    half = max(1, (max(domain - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    size = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(right.to_bytes(size, "big") + bytes([r, 0]), digest_size=size, key=key[:64], person=tweak[:16]).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < domain:
            return value


def chunks(text: str, tweak: bytes) -> Iterator[tuple[str, bytes]]:
    """A value in chunks, each with a tweak of its own; the halves of a chunk's number are no wider than a digest."""
    for k, at in enumerate(range(0, len(text), CHUNK)):
        yield text[at : at + CHUNK], tweak[:13].ljust(13, b"\0") + k.to_bytes(3, "big") if k else tweak


def radix(text: str, key: bytes, tweak: bytes, lead: str = "") -> str:
    """Every ASCII letter and digit permuted within its kind, a chunk at once; the other characters stay. lead: kinds of digits for the first places, '2' for 2-9."""
    return "".join(radix_chunk(part, key, own, "" if k else lead) for k, (part, own) in enumerate(chunks(text, tweak)))


def radix_chunk(text: str, key: bytes, tweak: bytes, lead: str) -> str:
    kinds = []
    digits = 0
    for c in text:
        if c.isascii() and c.isdigit():
            kinds.append("23456789" if digits < len(lead) and lead[digits] == "2" and c in "23456789" else "0123456789")
            digits += 1
        elif "a" <= c <= "z":
            kinds.append("abcdefghijklmnopqrstuvwxyz")
        elif "A" <= c <= "Z":
            kinds.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        else:
            kinds.append("")
    value, domain = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, domain = value * len(k) + k.index(c), domain * len(k)
    if domain == 1:
        return text
    new = feistel(value, domain, key, tweak)
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            new, i = divmod(new, len(k))
            out.append(k[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def day_for(ordinal: int, key: bytes) -> dt.date:
    """The pseudonym of a day: one of 1900 to 2099 for such a day, one of the other days of the calendar for another."""
    at = ordinal - FIRST_DAY
    if 0 <= at < DAYS:
        return dt.date.fromordinal(feistel(at, DAYS, key, b"date") + FIRST_DAY)
    other = feistel(ordinal - 1 if at < 0 else ordinal - 1 - DAYS, LAST_DAY - DAYS, key, b"other date")
    return dt.date.fromordinal(other + 1 if other + 1 < FIRST_DAY else other + 1 + DAYS)


def spread(new: str, like: str) -> str:
    """The digits of new in the places of the digits of like."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in like)


def luhn(digits: str) -> int:
    """The check digit for digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = radix(digits[:-1], key, b"card")
    return spread(body + str(luhn(body)), text)


def phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    national = digits[-10:] if len(digits) >= 10 else digits
    new = radix(national, key, b"phone", "2..2" if len(national) == 10 else "")
    return spread(digits[: len(digits) - len(national)] + new, text)


def ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = 0
    for p in parts:
        value = value << 8 | int(p)
    new = feistel(value, 1 << 32, key, b"ipv4")
    return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))


def date(text: str, key: bytes) -> str | None:
    m = re.fullmatch(r"(\d{4})([-/.])(\d\d)\2(\d\d)|(\d\d?)([-/.])(\d\d?)\6(\d{4})", text)
    if not m:
        return None
    order = (1, 3, 4) if m[1] else (8, 7, 5)
    try:
        day = dt.date(*(int(m[i]) for i in order)).toordinal()
    except ValueError:
        if m[1]:
            return None
        try:  # month before day
            order = (8, 5, 7)
            day = dt.date(*(int(m[i]) for i in order)).toordinal()
        except ValueError:
            return None
    new = day_for(day, key)
    if m[1]:
        return f"{new.year:04}{m[2]}{new.month:02}{m[2]}{new.day:02}"
    a, b = (new.day, new.month) if order == (8, 7, 5) else (new.month, new.day)
    return f"{a:0{len(m[5])}}{m[6]}{b:0{len(m[7])}}{m[6]}{new.year:04}" if len(m[5]) == len(m[7]) == 2 else f"{a}{m[6]}{b}{m[6]}{new.year:04}"


def ssn(text: str, key: bytes) -> str | None:
    a, b, c = text.split("-")
    return None if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else radix(text, key, b"ssn")


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = radix(plain[4:], key, b"iban")
    new = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def email(text: str, key: bytes) -> str | None:
    name, _, host = text.partition("@")
    return f"{radix(name, key, b'email' + hashlib.blake2b(host.lower().encode(), digest_size=8).digest())}@{host}"


def secret(text: str, key: bytes) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", text):
        return "".join(f"{feistel(int(part, 16), 16 ** len(part), key, tweak):0{len(part)}x}" for part, tweak in chunks(text, b"secret"))
    return radix(text, key, b"secret")


#: Kinds in the order in which they are tried at a place, and what makes a value of each.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    ("secret", r"(?<=password=)[^\s\"']+|(?<=token = \")[^\"\s]+|(?<=token=)[^\s\"']+|(?<=api_key=)[^\s\"']+|(?<=secret=)[^\s\"']+", secret),
    ("iban", r"\b[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", ipv4),
    ("date", r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d{4}\.\d\d\.\d\d|\d\d?-\d\d?-\d{4}|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\w/-])", date),
    ("ssn", r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", ssn),
    ("card", r"(?<!\w)(?<!\D-)(?<!^-)\d(?:[ -]?\d){12,18}(?!\w|-[A-Za-z_])", card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])", phone),
]
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS), re.ASCII)
SINGLE = {k: re.compile(p, re.ASCII) for k, p, _ in KINDS}
#: Kinds whose pattern may run on into digits or words after the value.
RUN_ON = ("iban", "card", "phone")
#: A text without any of these holds no value.
HINT = re.compile(r"\d[\d .()/+-]{5}|@|password=|token|api_key=|secret=", re.ASCII)


def validated(text: str, m: re.Match, key: bytes) -> tuple[str, int, str] | None:
    """(kind, end, pseudonym) of the value at a match: of the kind that matched or of a later one, whole or else up to the last border of groups that leaves a valid one."""
    kinds = list(KINDS)
    while kinds and kinds[0][0] != m.lastgroup:
        del kinds[0]
    for kind, _, make in kinds:
        one = m if kind == m.lastgroup else SINGLE[kind].match(text, m.start())
        if one is None:
            continue
        ends = [one.end()]
        if kind in RUN_ON:
            ends += [e for e in range(one.end() - 1, one.start(), -1) if text[e] in " .-" and text[e - 1].isalnum()]
        for end in ends:
            new = make(text[one.start() : end], key)
            if new is not None:
                return kind, end, new
    return None


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """(new text, (kind, start, end) of the values in the old one)."""
    if not HINT.search(text):
        return text, []
    out: list[str] = []
    found = []
    at = look = 0
    while (m := PATTERN.search(text, look)) is not None:
        value = validated(text, m, key)
        if value is None:  # a value may begin inside what wasn't one
            look = m.start() + 1
            continue
        kind, end, new = value
        out += [text[at : m.start()], new]
        at = look = end
        found.append((kind, m.start(), at))
    return "".join([*out, text[at:]]) if found else text, found


def protect(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with their texts' values replaced, and pii array<struct<kind, start, end>> (code points of the old text) after the columns.

    Method: mail addresses, secrets, IBANs, IPv4 addresses, dates, social security, card and phone numbers are found by
    pattern and validated (check digits, ranges, calendar). A value's letters and digits make a number in the domain of its
    format; a Feistel network of ten rounds, keyed and set apart by kind, permutes that domain (walking the cycle until it
    falls inside), and check digits are made anew. Equal values get equal pseudonyms in all documents, however they are
    written; different ones of a kind stay different, and the result is valid again.

    A card number, IBAN or phone number that runs on into other digits or words is also tried up to each border of its
    groups, longest first. A number that fails its check stays. Null text stays null, with no values. Whole texts are read. Null and repeated ids:
    rows of their own. Empty table: no rows. A column of docs named pii is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("pii")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for t in b.column(at).to_pylist():
                new, found = (None, []) if t is None else pseudonymise(t, key)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*b.schema.names, "pii"])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(item))]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, None)
    return protect(read(spark, sf_dir, "documents").select("doc_id", "text"), key.encode() if key else KEY).withColumn("n_pii", F.size("pii"))
