"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each format.

A candidate counts only if it is valid: check digits, octets, number plans, calendar days. The value is a
number below the size of its format; a Feistel network over the next even number of bits, walked until it lands
below the size, permutes those numbers. So a pseudonym is valid again, has the same layout, and equal values,
however they are written, get equal pseudonyms in all documents.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
LAST_DAY = datetime.date(2099, 12, 31).toordinal()


@functools.lru_cache(200_000)
def permuted(key: bytes, kind: str, value: int, size: int, back: bool = False) -> int:
    """The place of ``value`` in the keyed permutation of 0..size-1 of this kind; ``back`` undoes it."""
    half = max(1, -(-(size - 1).bit_length() // 2))
    mask = (1 << half) - 1
    width = max(32, -(-size.bit_length() // 8))
    label = kind.encode()[:8].ljust(8) + size.to_bytes(width, "big")

    def scramble(turn: int, part: int) -> int:
        block = label + bytes([turn]) + part.to_bytes(width, "big")
        out = hashlib.blake2b(block, key=key, digest_size=32).digest()
        for more in range(1, -(-half // 256)):  # long tokens
            out = hashlib.blake2b(block + bytes([more]), key=key, digest_size=32).digest() + out
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ scramble(turn, left), left) if back else (right, left ^ scramble(turn, right))
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """The check digit that follows the digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _laid_out(shape: str, digits: str) -> str:
    """The digits in place of those of ``shape``."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _card(key, text):
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
        return None
    low = 10 ** (len(digits) - 2)  # the first digit stays above 0
    body = str(permuted(key, f"card{len(digits)}", int(digits[:-1]) - low, 9 * low) + low)
    return _laid_out(text, body + str(luhn(body)))


def _address(key, text):
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = permuted(key, "ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


# Number plan: area and exchange start with 2-9.
_PHONE_RADIX = (8, 10, 10, 8, 10, 10, 10, 10, 10, 10)


def _phone(key, text):
    digits = re.sub(r"\D", "", text)
    country, digits = digits[:-10], digits[-10:]
    if country not in ("", "1") or digits[0] in "01" or digits[3] in "01":
        return None
    number, size = 0, 1
    for d, radix in zip(digits, _PHONE_RADIX):
        number, size = number * radix + int(d) - (10 - radix), size * radix
    number, out = permuted(key, "phone", number, size), []
    for radix in reversed(_PHONE_RADIX):
        number, d = divmod(number, radix)
        out.append(str(d + 10 - radix))
    return _laid_out(text, country + "".join(reversed(out)))


def _security_number(key, text):
    area, group, serial = (int(x) for x in re.split(r"\D", text))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number = permuted(key, "ssn", number, 898 * 99 * 9999)
    number, serial = divmod(number, 9999)
    area, group = divmod(number, 99)
    area += 1 + (area + 1 >= 666)
    return _laid_out(text, f"{area:03}{group + 1:02}{serial + 1:04}")


# How long the account numbers of a country are.
IBAN_LENGTHS = {country: length for length, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}


def _account(key, text):
    plain = re.sub(r"\s", "", text)
    if len(plain) != IBAN_LENGTHS.get(plain[:2], len(plain)):
        return None
    if len(plain) > 34 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
        return None
    body = plain[4:]
    digits = "".join(c for c in body if c.isdigit())
    if not digits:
        return None
    body = _laid_out(body, str(permuted(key, f"iban{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)))
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    left = iter(f"{plain[:2]}{check:02}{body}")
    return "".join(c if c.isspace() else next(left) for c in text)


def _date(key, text):
    a, b, c = (int(x) for x in re.split(r"\D", text))
    orders = {"-": ("ymd",), "/": ("ymd",) if a > 31 else ("mdy", "dmy"), ".": ("dmy",)}
    for order in orders[re.search(r"\D", text)[0]]:
        part = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permuted(key, "date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
        pieces = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
        marks = re.findall(r"\D", text)
        return pieces[order[0]] + marks[0] + pieces[order[1]] + marks[1] + pieces[order[2]]
    return None


def _letters(key, kind, text, alphabets):
    """Every character permuted within its alphabet, as one number; characters of no alphabet stay."""
    number, size, used = 0, 1, []
    for c in text:
        alphabet = next((a for a in alphabets if c in a), None)
        used.append(alphabet)
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(c), size * len(alphabet)
    number, out = permuted(key, kind, number, size) if size > 1 else 0, []
    for c, alphabet in zip(reversed(text), reversed(used)):
        if alphabet:
            number, d = divmod(number, len(alphabet))
            c = alphabet[d]
        out.append(c)
    return "".join(reversed(out))


_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mail(key, text):
    name, _, domain = text.rpartition("@")
    if len(name) > 64:
        return None
    return _letters(key, "mail", name, (_DIGITS, _SMALL, _LARGE)) + "@" + domain


def _token(key, text):
    low = text.lower()
    if len(text) > 256 or not re.search("[a-f]", low) or not re.search("[0-9]", low):
        return None
    new = _letters(key, "hex", low, ("0123456789abcdef",))
    if text == low:
        return new
    if text == text.upper():
        return new.upper()
    return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new))


def _access_key(key, text):
    return text[:4] + _letters(key, "access", text[4:], (_LARGE + _DIGITS,))


_FREE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
# In order of preference where several start at the same place. A pattern takes the longest candidate;
# where its check fails, shorter ends are tried.
KINDS = {
    "date": (rf"{_FREE}(?<![-./])(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d|\d\d?/\d\d?/\d{{4}}|\d\d?\.\d\d?\.\d{{4}})(?:(?=[Tt]\d)|{_END})(?![-./]\d)", _date),
    "ipv4": (rf"{_FREE}(?<!\d\.)\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_END}(?!\.\d)", _address),
    "iban": (rf"{_FREE}[A-Z]{{2}}\d\d(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}", _account),
    "card": (rf"{_FREE}\d{{4}}(?:[ -]?\d{{4}}){{2}}[ -]?(?:\d{{4}}[ -]?\d{{3}}|\d{{1,7}}){_END}|{_FREE}\d{{13,19}}{_END}|{_FREE}3\d{{3}}[ -]\d{{6}}[ -]\d{{5}}{_END}", _card),
    "ssn": (rf"{_FREE}\d{{3}}-\d\d-\d{{4}}{_END}(?!-\d)", _security_number),
    "phone": (rf"(?:(?<![0-9A-Za-z+])\+?1[ .-]?)?(?:(?<![0-9A-Za-z])|(?<=[ .-])|(?<=1))(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_END}", _phone),
    "token": (rf"{_FREE}[0-9A-Fa-f]{{32,}}{_END}", _token),
    "access": (rf"{_FREE}AKIA[A-Z0-9]{{16}}{_END}", _access_key),
    "mail": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _mail),
}
_PATTERNS = {kind: (re.compile(pattern, re.ASCII), make) for kind, (pattern, make) in KINDS.items()}
HAS_CANDIDATE = r"[0-9@]"  # every kind has a digit or an @
_GROUPED = ("iban", "card")  # kinds that may be followed by what looks like one more group


def _values(kind, pattern, make, key, text):
    """(start, end, pseudonym) of the valid values of a kind. A candidate without a valid end hides none that starts in it."""
    at = 0
    while m := pattern.search(text, at):
        start, end = m.span()
        new, at = make(key, m[0]), end
        if new is None:
            at = start + 1
            ends = [start + i for i, c in enumerate(m[0]) if c in " -"] if kind in _GROUPED else []
            for end in reversed(ends):
                # the pattern again, as if the text ended here; no letter or digit follows
                if pattern.fullmatch(text, start, end) and (new := make(key, text[start:end])) is not None:
                    at = end
                    break
        if new is not None:
            yield start, end, new


def pseudonymise(text: str, key: bytes) -> tuple[str, int]:
    """The text with all valid values replaced, and how many there were."""
    found = []
    for rank, (kind, (pattern, make)) in enumerate(_PATTERNS.items()):
        # cheap to ask first
        if kind == "mail" and "@" not in text or kind == "access" and "AKIA" not in text:
            continue
        found += [(start, rank, end, new) for start, end, new in _values(kind, pattern, make, key, text)]
    out, at, n = [], 0, 0
    for start, _, end, new in sorted(found):
        if start >= at:
            out += [text[at:start], new]
            at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def replace_values(documents: DataFrame, key: bytes) -> DataFrame:
    """The rows of documents(text, ...) with pseudonyms in their texts, and n_values, how many there are.

    Candidates that are not valid, and all other text, stay as they are; NULL and empty texts have no
    values. All other columns, whatever their names, stay; an n_values of the input is replaced. Repeated rows
    stay equal; an empty table gives no rows. ``key`` has up to 64 bytes.
    """
    columns = [c for c in documents.columns if c != "n_values"]
    at = columns.index("text")

    def replaced(batches):
        for batch in batches:
            texts = batch.column(at)
            counts, new = [0] * batch.num_rows, {}
            for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, HAS_CANDIDATE), False)).to_pylist():
                text, counts[i] = pseudonymise(texts[i].as_py(), key)
                if counts[i]:
                    new[i] = text
            if new:
                mask = pa.array([i in new for i in range(batch.num_rows)])
                texts = pc.replace_with_mask(texts, mask, pa.array([new[i] for i in sorted(new)], texts.type))
            arrays = [texts if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=[f"c{i}" for i in range(len(columns))] + ["n_values"])

    # columns go through by place, so their names don't matter
    placed = documents.select(*columns).toDF(*[f"c{i}" for i in range(len(columns))])
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(replaced, f"{types}, n_values bigint").toDF(*columns, "n_values")
