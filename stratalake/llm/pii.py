"""Personal data replaced by format-preserving pseudonyms.

Detected and validated values (card numbers with a right check digit, calendar dates, phone numbers, IPv4 addresses, US social security numbers,
IBANs, e-mail addresses) and values assigned to words such as "password" are numbered within all values of their format. A keyed Feistel
network permutes these numbers, and the new number is written in the same format. The permutation depends on key and format only, so
equal values get equal pseudonyms in every document, different ones different pseudonyms, and the holder of the key can undo it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from stratalake.llm.common import kept, slices

ROUNDS = 10
#: Longer values are permuted in pieces of so many characters.
PIECE = 512
LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Dates are permuted within these years.
FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

PATTERN = regex.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]))
  | (?P<secret>(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)["']?[ ]?[=:][ ]?["']?\K[A-Za-z0-9_+/-]{8,}=*(?![A-Za-z0-9_+/=-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w))
  | (?P<iso>(?<![\w-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?:(?![\w-])|(?=[Tt][0-9]{2})))
  | (?P<slash>(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/]))
  | (?P<dot>(?<![\w.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?!\.?\w))
  | (?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
  | (?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-]))
  | (?P<world>(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![\w-]))
  | (?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))
    """,
    regex.VERBOSE,
)
#: Where the longest match fails validation, these forms are tried from its start to each border between groups, the longest first. Groups of a card are
#: of three digits and more there, as rows of small numbers would hold a right check digit somewhere by chance.
SHORTER = {
    "iban": regex.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?"),
    "world": regex.compile(r"\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}"),
    "card": regex.compile(r"(?=(?:[ -]?[0-9]){13,19}$)[0-9]{3,}(?:[ -][0-9]{3,})*"),
}
BORDER = regex.compile(r"[ .-]")
#: A text without a digit or an at sign holds no value but perhaps an assigned one.
HINT = regex.compile(r"[0-9@=:]")


class Feistel:
    """Keyed permutations of range(n): a balanced Feistel network on the next even power of two, walked until it falls into the range."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        said, block = b"", 0
        while len(said) < size:
            data = tweak + bytes([i, block]) + bits.to_bytes(4, "big") + half.to_bytes(size, "big")
            said += hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(said[:size], "big") & ((1 << bits) - 1)

    def permute(self, number: int, n: int, tweak: str, back: bool = False) -> int:
        if not 0 <= number < n:
            raise ValueError("number outside its format")
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask, mark = (1 << bits) - 1, tweak.encode()
        while True:
            left, right = number >> bits, number & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(mark, i, left, bits), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(mark, i, right, bits)
            number = left << bits | right
            if number < n:
                return number


def luhn(digits: str) -> int:
    """The check digit that the digits before it ask for."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else (2 * d if d < 5 else 2 * d - 9)
    return -total % 10


def _alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LETTERS if c in LETTERS else CAPITALS if c in CAPITALS else c


def _in_pieces(text: str, back: bool, change) -> str:
    """A long value piece by piece, so that the work grows with its length; the tweak of a piece holds a digest of what stands before it in clear."""
    out, before = [], b""
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        out.append(change(piece, f":{at}:{before.hex()}" if at else ""))
        before = hashlib.blake2b(before + (out[-1] if back else piece).encode(), digest_size=16).digest()
    return "".join(out)


def _classes(feistel: Feistel, text: str, tweak: str, back: bool) -> str:
    """Letters to letters and digits to digits, each in its place; anything else stays."""
    return _in_pieces(text, back, lambda piece, more: _piece_classes(feistel, piece, tweak + more, back))


def _piece_classes(feistel: Feistel, text: str, tweak: str, back: bool) -> str:
    number, n = 0, 1
    sets = [_alphabet(c) for c in text]
    for c, letters in zip(text, sets, strict=True):
        number, n = number * len(letters) + letters.index(c), n * len(letters)
    shape = "".join({DIGITS: "0", LETTERS: "a", CAPITALS: "A"}.get(s, s) for s in sets)
    number = feistel.permute(number, n, f"{tweak}:{shape}", back)
    out = []
    for letters in reversed(sets):
        number, k = divmod(number, len(letters))
        out.append(letters[k])
    return "".join(reversed(out))


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def _card(f: Feistel, text: str, back: bool) -> str | None:
    """The first digit stays, and so does the check digit that would come next: thus a longer run of digits that begins here is as right or wrong as it was."""
    digits = "".join(c for c in text if c in DIGITS)
    if luhn(digits[:-1]) != int(digits[-1]) or digits[0] == "0" or len(set(digits)) == 1:
        return None
    inner, n = digits[1:-1], 10 ** (len(digits) - 2)
    while True:  # only numbers with that next digit whose digits are not all the same belong to the format
        inner = f"{f.permute(int(inner), n, f'card:{digits[0]}:{len(digits)}', back):0{len(inner)}d}"
        new = digits[0] + inner + str(luhn(digits[0] + inner))
        if len(set(new)) > 1 and luhn(new) == luhn(digits):
            return _refill(text, new)


def _date(form: str):
    def change(f: Feistel, text: str, back: bool) -> str | None:
        try:
            day = dt.datetime.strptime(text, form).date()
        except ValueError:
            if form != "%d/%m/%Y":
                return None
            return _date("%m/%d/%Y")(f, text, back) if int(text[3:5]) > 12 else None
        if not FIRST <= day <= LAST:
            return None
        if form != "%Y-%m-%d" and "/" in text:  # day and month must stay as tellable as they were
            return _slashed(f, text, form, back)
        n = (LAST - FIRST).days + 1
        return (FIRST + dt.timedelta(f.permute((day - FIRST).days, n, "date", back))).strftime(form)

    return change


@cache
def _slashed_days(form: str) -> tuple[list[dt.date], dict[dt.date, int]]:
    """The days that a text with slashes stands for in day-month order (all of them), or in month-day order (days over 12)."""
    days = [FIRST + dt.timedelta(i) for i in range((LAST - FIRST).days + 1)]
    if form == "%m/%d/%Y":
        days = [d for d in days if d.day > 12]
    return days, {d: i for i, d in enumerate(days)}


def _slashed(f: Feistel, text: str, form: str, back: bool) -> str:
    days, place = _slashed_days(form)
    i = place[dt.datetime.strptime(text, form).date()]
    return days[f.permute(i, len(days), "date" if form == "%d/%m/%Y" else "date:american", back)].strftime(form)


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    parts = text.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    number = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, f.permute(number, 1 << 32, "ip", back).to_bytes(4, "big")))


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    """North American numbers, whose area code and exchange begin with 2 to 9; where +1 or a bracket marks a phone, all others as well, among themselves.

    Ten bare digits in three groups, outside that range, may be anything and stay.
    """
    digits = "".join(c for c in text if c in DIGITS)
    lead, own = digits[:-10], digits[-10:]
    if own[0] in "01" or own[3] in "01":
        return _other_phone(f, text, lead, own, back) if text[0] == "+" or "(" in text else None
    number = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
    rest, line = divmod(f.permute(number, 800 * 800 * 10_000, "phone", back), 10_000)
    area, exchange = divmod(rest, 800)
    return _refill(text, f"{lead}{area + 200}{exchange + 200}{line:04d}")


def _other_phone(f: Feistel, text: str, lead: str, own: str, back: bool) -> str:
    """The 3,600,000,000 numbers of which area code or exchange begins with 0 or 1: areas below 200 with any exchange, then the rest."""
    area, exchange = int(own[:3]), int(own[3:6])
    rest = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
    rest, line = divmod(f.permute(rest * 10_000 + int(own[6:]), 360_000 * 10_000, "phone:other", back), 10_000)
    area, exchange = divmod(rest, 1000) if rest < 200_000 else divmod(rest - 200_000 + 200 * 200, 200)
    return _refill(text, f"{lead}{area:03d}{exchange:03d}{line:04d}")


def _world(f: Feistel, text: str, back: bool) -> str | None:
    """Other international numbers of 8 to 15 digits: the first two digits (of the country) stay."""
    digits = "".join(c for c in text if c in DIGITS)
    if not 8 <= len(digits) <= 15:
        return None
    own = f.permute(int(digits[2:]), 10 ** (len(digits) - 2), f"world:{digits[:2]}:{len(digits)}", back)
    return _refill(text, digits[:2] + f"{own:0{len(digits) - 2}d}")


def _ssn_number(text: str) -> int | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return None
    return ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    number = _ssn_number(text)
    if number is None:
        return None
    rest, serial = divmod(f.permute(number, 898 * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


def _iban(f: Feistel, text: str, back: bool) -> str | None:
    plain = text.replace(" ", "")
    country, check, rest = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or int(check) != _iban_check(country, rest):
        return None
    new = _classes(f, rest, f"iban:{country}", back)
    chars = iter(f"{country}{_iban_check(country, new):02d}{new}")
    return "".join(c if c == " " else next(chars) for c in text)


def _email(f: Feistel, text: str, back: bool) -> str | None:
    """All but the top-level domain."""
    head, dot, top = text.rpartition(".")
    return _classes(f, head, "email", back) + dot + top


def _secret(f: Feistel, text: str, back: bool) -> str | None:
    """Assigned values with a digit; a hexadecimal value stays one."""
    if not any(c in DIGITS for c in text):
        return None
    if regex.fullmatch("[0-9a-f]+", text):
        return _in_pieces(text, back, lambda t, more: f"{f.permute(int(t, 16), 16 ** len(t), f'hex:{len(t)}{more}', back):0{len(t)}x}")
    return _classes(f, text, "secret", back)


CHANGES = {
    "email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "iso": _date("%Y-%m-%d"), "slash": _date("%d/%m/%Y"),
    "dot": _date("%d.%m.%Y"), "ssn": _ssn, "phone": _phone, "world": _world, "card": _card,
}


def _values(f: Feistel, text: str, at: int, back: bool) -> tuple[list[tuple[int, int, str, str]], bool, int]:
    """(start, end, kind, pseudonym) of the next values of ``text`` from ``at`` on, whether a longer match failed, and where to go on (-1: nowhere).

    That is one value; or, where a match fails, the values found within it and within failed matches that overlap it: a shorter one from its start, else those that begin behind its start.
    """
    values: list[tuple[int, int, str, str]] = []
    reach = fresh = -1  # the end of the failed matches, and of those that were not within another
    while match := PATTERN.search(text, at):
        kind, start, end = match.lastgroup, *match.span()
        if 0 <= reach <= start:
            return values, True, at
        ends = [end] if start >= fresh or kind != "card" or SHORTER[kind].fullmatch(text[start:end]) else []
        if kind in SHORTER:
            ends += [b.start() for b in BORDER.finditer(text, start, end) if SHORTER[kind].fullmatch(text[start : b.start()])][::-1]
        new = None
        for to in ends:
            if (new := CHANGES[kind](f, text[start:to], back)) is not None:
                values.append((start, to, kind, new))
                break
        if new is not None and to == end and reach < 0:
            return values, False, to
        if new is None or to < end:
            reach = max(reach, end)
        if new is None and start >= fresh:
            fresh = end
        # The word before a secret is no part of its match, so another kind can begin where it does.
        at = to if new is not None else start + (kind != "secret")
    return values, reach >= 0, -1


def pseudonymise(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[str]]:
    """The text with every validated value permuted (or, with ``back``, restored), and the kinds of the values in order.

    If pseudonyms make a longer match right that was not, they are permuted again until the same values are found in the text, so that they can be undone.
    Only there does a pseudonym depend on its neighbours: where a failed card, IBAN or the like holds a part of the value, or a value of another kind.
    """
    if not HINT.search(text):
        return text, []
    found: list[str] = []
    done, at = "", 0
    while at >= 0:
        values, failed, go_on = _values(feistel, text, at, back)
        found += [kind for _, _, kind, _ in values]
        new = [v for *_, v in values]
        rest = values[-1][1] if values else at
        while values:
            spans, out, last = [], done, at
            for (start, end, kind, _), v in zip(values, new, strict=True):
                out += text[last:start]
                spans.append((len(out), len(out) + len(v), kind))
                out, last = out + v, end
            if not failed or [v[:3] for v in _values(feistel, out + text[rest:], len(done), back)[0]] == spans:
                done = out
                break
            new = [CHANGES[kind](feistel, v, back) for (_, _, kind, _), v in zip(values, new, strict=True)]
        done += text[rest : max(rest, go_on)] if go_on >= 0 else text[rest:]
        at = go_on
    return done, found


def pseudonymise_documents(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymised and a column ``pii_kinds`` (array of the kinds found, in order of place) at the end.

    Null texts stay null and have no kinds; texts without a validated value are unchanged, and so are all other columns (one named
    pii_kinds is replaced). ``n_chars`` stays right, as pseudonyms have the length of what they replace, but for dotted IPv4 parts. One
    pass, row by row, without a shuffle.
    """
    names = [c for c in docs.columns if c != "pii_kinds"]
    docs = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = kept(("pii", key), lambda: Feistel(key))
        for batch in slices(batches, at):
            texts, kinds = [], []
            for text in batch.column(at).to_pylist():
                new, found = (None, []) if text is None else pseudonymise(text, feistel, back)
                texts.append(new)
                kinds.append(found)
            columns = [*batch.columns, pa.array(kinds, pa.list_(pa.string()))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "pii_kinds"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL("pii_kinds array<string>").fields]))
