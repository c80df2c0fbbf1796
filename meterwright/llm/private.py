"""PII: format-preserving Feistel pseudonyms.

Candidates are found by pattern and then validated: card numbers by the Luhn
digit, IBANs by their check digits, addresses and dates by their ranges. What
is valid is permuted with a key within its own format by a Feistel network
over the numbers (or letters and digits) of that format: a card becomes a
card, a date a date of the same layout. The permutation depends on the key and
the kind only, so equal values stay linked across documents, whatever their
layout, and the holder of the key can invert it.

Numbers outside a format's domain are never made: the network works on the
smallest square that holds the domain and is applied again until it is back
inside (cycle walking).

Every text is read whole, once, and nothing is shuffled.

Defined results: null text stays null and has no spans; overlapping candidates
go to the kind listed first, then to the leftmost; repeated rows are treated
one by one; an empty table gives an empty result; other columns pass through,
columns named like the added ones are replaced.
"""

import datetime
import hashlib
import math
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import release_memory, unused

#: Spark setting that holds the key of the registered query and the pipeline.
KEY_SETTING = "spark.meterwright.privateKey"
#: Key for tests and examples only: whoever knows it can invert the pseudonyms.
DEFAULT_KEY = "not-a-secret"
ROUNDS = 6

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
_DAYS = (LAST_DAY - FIRST_DAY).days + 1
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"


class Permuter:
    """A keyed permutation of 0 .. size-1 for any size."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).digest()

    def _round(self, kind: str, size: int, n: int, half: int) -> int:
        data = f"{kind}|{size}|{n}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big")

    def _once(self, kind: str, size: int, x: int, back: bool) -> int:
        side = math.isqrt(size - 1) + 1
        left, right = divmod(x, side)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - self._round(kind, size, n, left)) % side, left
            else:
                left, right = right, (left + self._round(kind, size, n, right)) % side
        return left * side + right

    def permute(self, kind: str, size: int, x: int, back: bool = False) -> int:
        if size < 2:
            return x
        x = self._once(kind, size, x, back)
        while x >= size:
            x = self._once(kind, size, x, back)
        return x

    def digits(self, kind: str, value: str, valid=lambda _: True, back: bool = False) -> str:
        """A digit string of the same length; walks on until ``valid`` holds."""
        n, x = len(value), int(value)
        while True:
            x = self.permute(kind, 10**n, x, back)
            out = f"{x:0{n}d}"
            if valid(out):
                return out

    def letters(self, kind: str, value: str, back: bool = False) -> str:
        """Letters and digits permuted by class, so the shape and case stay; all else is kept."""
        x, size = 0, 1
        for c in value:
            base = _DIGITS if c in _DIGITS else _LETTERS if c.lower() in _LETTERS else ""
            if base:
                x, size = x * len(base) + base.index(c.lower()), size * len(base)
        x, out = self.permute(kind, size, x, back), []
        for c in reversed(value):
            base = _DIGITS if c in _DIGITS else _LETTERS if c.lower() in _LETTERS else ""
            if base:
                x, k = divmod(x, len(base))
                out.append(base[k].upper() if c.isupper() else base[k])
            else:
                out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in _DIGITS)


def _good_card(value: str) -> bool:
    d = _only_digits(value)
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and bool(d.strip("0"))


def _card(value: str, p: Permuter, back: bool, fits) -> str:
    d = _only_digits(value)
    shown = lambda body: _fill(value, d[0] + body + luhn_digit(d[0] + body))
    return shown(p.digits(f"card{d[0]}", d[1:-1], lambda body: fits(shown(body)), back))  # the first digit names the kind of card


def _number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _good_iban(value: str) -> bool:
    raw = value.replace(" ", "")
    return _number(raw[4:] + raw[:4]) % 97 == 1


def _iban(value: str, p: Permuter, back: bool, fits) -> str:
    raw = value.replace(" ", "")
    body = raw[4:]
    while True:
        body = p.letters("iban" + raw[:2], body, back)
        check = 98 - _number(body + raw[:2] + "00") % 97
        new = iter(raw[:2] + f"{check:02d}" + body)
        out = "".join(c if c == " " else next(new) for c in value)
        if fits(out):
            return out


#: Length of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, some in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in some.split()
}


def _ends(kind: str, m: re.Match) -> list[int]:
    """Ends of a candidate at its group borders, in the order to try them: the longest first, an IBAN's own length before all."""
    least = 13 if kind == "card" else 12
    ends, n = [], 0
    for k, c in enumerate(m[0]):
        if c in " -":
            ends.append((k, n))
        else:
            n += 1
    ends = [(k, n) for k, n in [*ends, (len(m[0]), n)] if n >= least]
    own = IBAN_LENGTH.get(m[0][:2]) if kind == "iban" else None
    return [m.start() + k for k, n in sorted(ends, key=lambda e: (e[1] != own, -e[0]))]


class Taken:
    """Disjoint spans that are taken, in order: whether a span meets one of them takes a bisection."""

    def __init__(self, spans: list[tuple]):
        self.starts, self.ends = [s for s, *_ in spans], [e for _, e, *_ in spans]

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def _grouped(kind: str, pattern: re.Pattern, text: str, taken: Taken, good, change, p: Permuter, back: bool) -> Iterator[tuple[int, int, str]]:
    """Cards and IBANs: what follows (an expiry date, a code, a word) may look like one more group.

    A candidate is tried at all its ends, then from its next group on. What
    failed before has to fail with the new value too, else the text could not
    be inverted: there a value in front of such a group may get another
    pseudonym than elsewhere.
    """
    at, failed = 0, []
    while m := pattern.search(text, at):
        at = next((m.start() + k + 1 for k, c in enumerate(m[0]) if c in " -"), m.end())
        start = m.start()
        failed = [(s, e) for s, e in failed if e > start]  # those before can be crossed no more
        for end in _ends(kind, m):
            if taken.meets(start, end):
                continue
            if not good(text[start:end]):
                failed.append((start, end))
                continue
            crossed = [(s, e) for s, e in failed if s < end and start < e]

            def fits(new: str, start=start, end=end, crossed=crossed) -> bool:
                low, high = min((s for s, _ in crossed), default=start), max((e for _, e in crossed), default=end)
                put = text[low:start] + new + text[end:high]
                return not any(good(put[s - low : e - low]) for s, e in crossed)

            yield start, end, change(text[start:end], p, back, fits)
            at = end
            break


def _email(m: re.Match, p: Permuter, back: bool) -> str:
    local, _, domain = m[0].rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{p.letters('mail', local, back)}@{p.letters('host', host, back)}.{top}"


def _address(m: re.Match, p: Permuter, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    x = 0
    for part in parts:
        x = x * 256 + int(part)
    x = p.permute("ipv4", 2**32, x, back)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _good_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(m: re.Match, p: Permuter, back: bool) -> str | None:
    d = _only_digits(m[0])
    return _fill(m[0], p.digits("ssn", d, _good_ssn, back)) if _good_ssn(d) else None


def _good_phone(d: str) -> bool:
    return len(d) == 10 and d[0] in "23456789" and d[3] in "23456789"


def _phone(m: re.Match, p: Permuter, back: bool) -> str | None:
    """Area, exchange and line; the country code stays. Ten national digits form a number as in North America;
    other numbers never become one, so that each is inverted as what it was."""
    own = m["national"]
    d = _only_digits(own)
    if _good_phone(d):
        new = p.digits("phone10", d, _good_phone, back)
    elif m["country"] and 7 <= len(d) <= 12:
        new = p.digits(f"phone+{_only_digits(m['country'])}", d, lambda x: not _good_phone(x), back)
    else:
        return None
    return m[0][: m.start("national") - m.start()] + _fill(own, new)


def _date(m: re.Match, p: Permuter, back: bool) -> str | None:
    """Year first (ISO), or day and month first (in that order unless only the other is a date)."""
    sep, groups = m["sep"] or m["sep2"], [m["y"], m["a"], m["b"]] if m["y"] else [m["y2"], m["b2"], m["a2"]]
    y, month, day = map(int, groups)
    swapped = False
    if not m["y"] and month > 12 >= day:
        month, day, swapped = day, month, True
    try:
        n = (datetime.date(y, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= n < _DAYS:
        return None
    if m["y"]:
        new = FIRST_DAY + datetime.timedelta(p.permute("date", _DAYS, n, back))
        return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
    while True:  # a swapped layout stays readable one way only: its day is over 12
        n = p.permute("date", _DAYS, n, back)
        new = FIRST_DAY + datetime.timedelta(n)
        if not swapped or new.day > 12:
            break
    a, b = (new.month, new.day) if swapped else (new.day, new.month)
    return f"{a:0{len(m['a2'])}d}{sep}{b:0{len(m['b2'])}d}{sep}{new.year:04d}"


#: Kinds whose candidates are tried at every group border, and their test.
GROUPED = {"iban": _good_iban, "card": _good_card}
#: Kinds in order of precedence: name, pattern, replacement.
KINDS = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", re.compile(r"(?<![A-Za-z0-9.+-])\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])"), _card),
    ("ipv4", re.compile(r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9]|\.\d)"), _address),
    ("date", re.compile(r"(?<![A-Za-z0-9.-])(?:(?P<y>\d{4})(?P<sep>[-/.])(?P<a>\d\d)(?P=sep)(?P<b>\d\d)|(?P<a2>\d{1,2})(?P<sep2>[-/.])(?P<b2>\d{1,2})(?P=sep2)(?P<y2>\d{4}))(?![A-SU-Za-z0-9]|[-/.]\d)"), _date),
    ("ssn", re.compile(r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)"), _ssn),
    ("phone", re.compile(r"(?<![A-Za-z0-9.-])(?:(?P<country>\+\d{1,3})[ .-]?)?(?P<national>\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4})(?![A-Za-z0-9]|[.-]\d)"), _phone),
]
_MAYBE = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[0-9][0-9 .()/-]{5}")


def pseudonymize(text: str, permuter: Permuter, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """(new text, spans (start, end, kind) in code points of the old text)."""
    if not _MAYBE.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    numbers = _NUMBER.search(text) is not None
    for kind, pattern, change in KINDS:
        if kind == "email" and "@" not in text or kind not in ("email", "iban") and not numbers:
            continue
        before = Taken(taken)  # one kind's own spans are disjoint
        if kind in GROUPED:
            taken += [(s, e, kind, new) for s, e, new in _grouped(kind, pattern, text, before, GROUPED[kind], change, permuter, back)]
        else:
            for m in pattern.finditer(text):
                if not before.meets(*m.span()):
                    new = change(m, permuter, back)
                    if new is not None:
                        taken.append((*m.span(), kind, new))
        taken.sort()
    out, at = [], 0
    for s, e, _, new in taken:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [(s, e, k) for s, e, k, _ in taken]


def key_of(spark: SparkSession) -> str:
    """The key named in the session's ``KEY_SETTING``; without it the published example key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the published example key and can be inverted by anyone", stacklevel=2)
    return key or DEFAULT_KEY


def hide_private(docs: DataFrame, key: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with its text pseudonymized, and pii_spans (start, end, kind) of the text before; the key is the session's unless given."""
    key = key or key_of(docs.sparkSession)

    @F.pandas_udf("struct<text:string,spans:array<struct<start:int,end:int,kind:string>>>")
    def hidden(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        permuter = Permuter(key)
        for texts in batches:
            done = [(None, []) if t is None else pseudonymize(t, permuter, back) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done], "spans": [[dict(zip(("start", "end", "kind"), x, strict=True)) for x in s] for _, s in done]})
        release_memory()

    work = unused("hidden", docs.columns)
    out = docs.withColumn(work, hidden("text"))
    return out.withColumns({"text": F.col(work)["text"], "pii_spans": F.col(work)["spans"]}).drop(work)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document with its private values replaced, and where they stood."""
    done = hide_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.transform("pii_spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_private"), listed.alias("spans"))
