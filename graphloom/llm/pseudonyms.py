"""PII pseudonyms by keyed format-preserving Feistel permutations.

Each kind of value has a format, that is a finite set of valid values numbered from 0; a
Feistel network over two halves of that range, with keyed BLAKE2b rounds and cycle walking,
permutes it. So a value becomes another valid value of its format, and equal values (also
those written with other separators) get equal pseudonyms in every document.

kinds: card (13-19 digits, Luhn), iban (in capitals, modulo 97), ssn (valid area, group and serial), phone
(international with +, or NANP with or without parentheses and country code; bare ddd-ddd-dddd or ddd.ddd.dddd with
a valid area code; a number is its country code and its national number, however they are separated,
and a NANP number is the same with and without +1), ipv4 (octets up to 255), ipv6 (whole or with ::), date (calendar dates 1900-2099, ISO also
before a time, day/month/year, or month/day/year where only that is a date), email (characters keep
their class), token (32-64 hex digits). What looks like one but is not valid stays as it is.

Cases: null texts stay null; a text without values stays as it is; every row is treated by itself,
so ties, repeats and null ids do not matter. With a column n_chars, pseudonymised keeps it true.
"""

from __future__ import annotations

import datetime
import ipaddress
import math
import re
import warnings
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import runtime

#: For the example query only: whoever has the key can undo the pseudonyms.
EXAMPLE_KEY = b"graphloom example key: pass your own"
ROUNDS = 10
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100)))), "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))))
_CLASS_OF = {ch: k for k in _CLASSES for ch in k}

PATTERN = re.compile(
    r"""
    (?P<email>[^\W_][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))
    |(?<!\w)(?:
        (?P<token>[0-9a-f]{32,64}|[0-9A-F]{32,64})(?!\w)
        |(?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?!\w)
        |(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?!\w|:\w|\.\d)|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?!\w|:[\w:]|\.\d))
    )
    |(?<!\w)(?<!\d[.+-])(?:
        (?P<date>\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!(?!(?<=-\d\d)T\d{2}:?\d{2})[\w/]|[.-]\d)
        |(?P<ipv4>\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)
        |(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
        |(?P<card>\d(?:[ -]?\d){12,18})(?!\w|-\d)
        |(?P<nanp>\(\d{3}\)[ ]?\d{3}-\d{4})(?![\w-])
        |(?P<bare>(?:1[ .-])?[2-9]\d{2}(?:-\d{3}-|\.\d{3}\.)\d{4})(?![\w-]|\.\d)
    )
    |(?<!\w)(?P<phone>\+\d{1,3}[ .-]?(?:\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}))(?![\w-])
    """,
    re.VERBOSE,
)
KINDS = tuple(PATTERN.groupindex)


def permute(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): Feistel rounds on (x // b, x % b), walked until the value is in range."""
    if size < 2:
        return x
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    width = (max(a, b).bit_length() + 7) // 8
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            value = right if r % 2 == 0 else left
            f = int.from_bytes(blake2b(value.to_bytes(width, "big") + bytes((r,)) + tweak, key=key[:64], digest_size=min(64, width + 8)).digest(), "big")
            left, right = ((left + f) % a, right) if r % 2 == 0 else (left, (right + f) % b)
        x = left * b + right
        if x < size:
            return x


def _by_class(value: str, key: bytes, tweak: bytes) -> str:
    """Characters of each class among themselves, as one mixed-radix number; others stay."""
    x, size = 0, 1
    for ch in value:
        if k := _CLASS_OF.get(ch):
            x, size = x * len(k) + k.index(ch), size * len(k)
    x, out = permute(x, size, key, tweak + str(len(value)).encode()), []
    for ch in reversed(value):
        if k := _CLASS_OF.get(ch):
            x, i = divmod(x, len(k))
            ch = k[i]
        out.append(ch)
    return "".join(reversed(out))


def _refill(shape: str, characters: str) -> str:
    """The letters and digits of shape replaced in order."""
    it = iter(characters)
    return "".join(next(it) if ch.isalnum() else ch for ch in shape)


def _digits(value: str) -> str:
    return "".join(ch for ch in value if ch.isdigit())


def luhn(digits: str) -> int:
    """The sum modulo 10: 0 for a valid number."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def _card(value: str, key: bytes) -> str | None:
    digits = _digits(value)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    head, n = digits[0], len(digits) - 2  # the issuing network stays
    while True:  # one digit over and over is no card
        body = head + str(permute(int(digits[1:-1]), 10**n, key, b"card%d" % len(digits))).zfill(n)
        digits = body + str(-luhn(body + "0") % 10)
        if len(set(digits)) > 1:
            return _refill(value, digits)


def _mod97(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _iban(value: str, key: bytes) -> str | None:
    code = value.replace(" ", "")
    if not 15 <= len(code) <= 34 or _mod97(code) != 1:
        return None
    body = _by_class(code[4:], key, b"iban" + code[:2].encode())
    return _refill(value, f"{code[:2]}{98 - _mod97(code[:2] + '00' + body):02d}{body}")


def _ssn_ok(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(value: str, key: bytes) -> str | None:
    digits = _digits(value)
    if not _ssn_ok(digits):
        return None
    while True:
        digits = str(permute(int(digits), 10**9, key, b"ssn")).zfill(9)
        if _ssn_ok(digits):
            return _refill(value, digits)


#: Country codes of one and of two digits; all others have three.
_ONE, _TWO = ("1", "7"), ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def _phone(value: str, key: bytes) -> str | None:
    digits = _digits(value)
    n = 1 if digits[0] in _ONE else 2 if digits[:2] in _TWO else 3
    country, national = digits[:n], digits[n:].removeprefix("0" if "(0)" in value else "")
    if not 6 <= len(national) <= 14:
        return None
    if country == "1" and len(national) == 10:
        new = _nanp_digits(national, key)
    else:
        new = str(permute(int(national), 10 ** len(national), key, b"phone" + country.encode())).zfill(len(national))
    return _refill(value, country + "0" * (len(digits) - n - len(national)) + new)


def _ipv4(value: str, key: bytes) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ipv4").to_bytes(4, "big")))


def _ipv6(value: str, key: bytes) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(value)) - (1 << 112)
    except ValueError:
        return None
    if x < 0 or not _digits(value):  # names with :: in program text may have no digit
        return None
    return str(ipaddress.IPv6Address(permute(x, (1 << 128) - (1 << 112), key, b"ipv6") + (1 << 112)))


def _area_ok(digits: str) -> bool:
    return digits[0] > "1" and digits[1:3] != "11"


def _nanp_digits(digits: str, key: bytes) -> str:
    """A valid area code becomes a valid one, another becomes another."""
    valid = _area_ok(digits)
    while True:
        digits = str(permute(int(digits), 10**10, key, b"phone")).zfill(10)
        if _area_ok(digits) == valid:
            return digits


def _nanp(value: str, key: bytes) -> str:
    at = 0 if value[0] == "(" else len(value) - 12  # a leading 1 stays
    return value[:at] + _refill(value[at:], _nanp_digits(_digits(value[at:]), key))


def _bare(value: str, key: bytes) -> str | None:
    return _nanp(value, key) if _area_ok(value[-12:]) else None


def _date(value: str, key: bytes) -> str | None:
    sep = next(ch for ch in value if not ch.isdigit())
    parts = [int(x) for x in value.split(sep)]
    month_first = sep == "/" and parts[1] > 12
    try:
        day = datetime.date(*(parts if sep == "-" else (parts[2], *parts[:2]) if month_first else parts[::-1])).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_FIRST_DAY + permute(day, _DAYS, key, b"date"))
    if month_first:
        return f"{new.month:02d}/{new.day:02d}/{new.year}"
    return new.isoformat() if sep == "-" else f"{new.day:02d}{sep}{new.month:02d}{sep}{new.year}"


def _email(value: str, key: bytes) -> str | None:
    local, _, host = value.rpartition("@")
    labels = host.split(".")
    own = ".".join([local, *labels[:-2]])  # the registered domain stays
    new = _by_class(own, key, b"email")
    return f"{new[: len(local)]}@{new[len(local) + 1 :]}{'.' if labels[:-2] else ''}{'.'.join(labels[-2:])}"


def _token(value: str, key: bytes) -> str | None:
    if value.isdigit() or value.isalpha():
        return None
    new = f"{permute(int(value, 16), 16 ** len(value), key, b'token%d' % len(value)):0{len(value)}x}"
    return new if value.lower() == value else new.upper()


_BY_KIND: dict[str, Callable[[str, bytes], str | None]] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "nanp": _nanp, "bare": _bare, "ipv6": _ipv6, "ipv4": _ipv4, "date": _date, "email": _email, "token": _token}


@lru_cache(maxsize=1 << 16)
def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The value's pseudonym; None for a value that is not valid."""
    return _BY_KIND[kind](value, key)


def replace(text: str, key: bytes) -> tuple[str, int]:
    """The text with pseudonyms, and how many values it had."""
    n = 0

    def new(m: re.Match) -> str:
        nonlocal n
        out = pseudonym(m.lastgroup, m[0], key)
        n += out is not None
        return m[0] if out is None else out

    return PATTERN.sub(new, text), n


def pseudonymised(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """docs with pseudonyms in text, and in the column named by count how many; columns and rows stay."""
    names = docs.columns

    def treated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column, counts = batch.column(at), [0] * batch.num_rows
            hits = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)).to_pylist()
            if hits:
                texts = column.to_pylist()
                for i in hits:
                    texts[i], counts[i] = replace(texts[i], key)
                column = pa.array(texts, column.type)
            arrays = [column if i == at else a for i, a in enumerate(batch.columns)] + [pa.array(counts, pa.int64())] * bool(count)
            yield pa.record_batch(arrays, names=names + [count] * bool(count))

    schema = StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])])
    out = docs.mapInArrow(treated, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def key_of(spark: SparkSession) -> bytes:
    """The key in spark.graphloom.pseudonymKey; without one an error, as a public key hides nothing."""
    named = spark.conf.get("spark.graphloom.pseudonymKey", None)
    if not named:
        raise ValueError("set spark.graphloom.pseudonymKey to a secret key")
    return named.encode()


def key_or_example(spark: SparkSession) -> bytes:
    """As key_of, for the query and the pipeline over made-up tables: without a key that of the example is taken, with a warning."""
    if spark.conf.get("spark.graphloom.pseudonymKey", None):
        return key_of(spark)
    warnings.warn("spark.graphloom.pseudonymKey is not set: the pseudonyms use a public key and can be undone by anyone", stacklevel=2)
    return EXAMPLE_KEY


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its values, and their number."""
    return pseudonymised(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"), key_or_example(spark), count="n_values")
