"""Format-preserving pseudonyms for personal data.

Card numbers (Luhn), account numbers (mod 97), phone numbers, social security numbers,
network addresses, calendar dates, mail addresses and access secrets are found in the
whole text and validated; each valid value is replaced by a keyed permutation of itself
within its own format. A Feistel network over the smallest even number of bits that holds
the format's domain is walked in cycles until it lands on a valid value, so the map is a
bijection: equal values stay linked across documents and ``restore`` undoes it with the
key. Separators, letter case, check digits, country codes and mail domains are kept, so a
pseudonym passes the same validation as its original. A date in any notation of full
width is the same day number, hence the same day afterwards; dates with one-digit fields or
month names (English, German, French, Spanish) keep their digits and language, hence are
linked only within their form.

Defined results. A null text stays null; a text without a valid value is returned
unchanged, byte for byte. Values that fail validation (a 16-digit number without a Luhn
check, a 31st of February) are no personal data and stay. Cards and accounts are tried at
every group of a run of digits, so neighbouring numbers do not hide them: printed groupings
first, else the longest; accounts have their country's length. Whole texts are read; long runs
cost linear time. Rows are independent: repeated rows, ties and empty tables need no
rule. ``pseudonymise`` keeps all columns of the table and adds none unless asked.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructType

ROUNDS = 10
_FIRST_DAY = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST_DAY).days

#: Month names by style; a name belongs to the first style that has it.
_MONTHS = tuple(tuple(names.split()) for names in (
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "jan feb mar apr may jun jul aug sep oct nov dec"))
_STYLE: dict[str, int] = {}
for _n, _names in enumerate(_MONTHS):
    for _name in _names:
        _STYLE.setdefault(_name, _n)
_NAME = "(?i:" + "|".join(sorted(_STYLE, key=lambda x: (-len(x), x))) + ")"
#: Country codes of one and two digits; all others have three.
_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")

_PATTERN = re.compile(
    r"(?P<mail>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<aws>(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![A-Za-z0-9])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{18,64}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3}))"  # the head; ``_account`` finds the end
    r"|(?P<date>(?<![0-9.\-/])(?:[0-9]{4}([-/.])[0-9]{2}\6[0-9]{2}|[0-9]{1,2}([-/.])[0-9]{1,2}\7[0-9]{4})(?![0-9\-/]|\.[0-9]))"
    rf"|(?P<named>(?<![0-9.\-/])[0-9]{{1,2}}(?:\.? | de ){_NAME},?(?: | de )[0-9]{{4}}(?![0-9])|(?<!\w){_NAME} [0-9]{{1,2}},? [0-9]{{4}}(?![0-9]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<phone>(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{3}\)|\(?[0-9]{3}\)?[ .-])[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[1-9][0-9]{0,14}(?:[ .-]?\([0-9]{1,5}\)[ .-]?[0-9]{1,12}|[ .-][0-9]{1,12})*(?![0-9]))"
)
_RUN = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}(?![0-9])")  # groups of digits that may hold cards
_HINT = re.compile(r"[0-9@]")
#: Group sizes in which cards are printed; a single group may have any card length.
_PRINTED = frozenset(((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 5)))
CARD_LEAST, CARD_MOST = 13, 19
_DOUBLED = dict(zip("0123456789", (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
#: Account lengths by country (fixed values of the registry); others may end at any group.
ACCOUNT_LENGTHS = {c: int(n) for n, names in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD FK", "19": "MK SI", "20": "AT BA EE KZ LT LU XK MN", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM TL SO", "24": "AD CZ ES MD PK RO SA SE SK TN VG",
    "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV",
    "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for c in names.split()}


def luhn_digit(payload: str) -> int:
    """Check digit that completes ``payload``."""
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _is_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


class Feistel:
    """Keyed bijections of [0, size), one per tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, number: int, half: int, bits: int) -> int:
        message = f"{tweak}|{number}|{bits}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest(), "big") & ((1 << bits) - 1)

    def _pass(self, x: int, bits: int, tweak: str, back: bool) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, n, left, bits), left
            else:
                left, right = right, left ^ self._round(tweak, n, right, bits)
        return left << bits | right

    def permute(self, x: int, size: int, tweak: str, back: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Image of ``x`` among the valid values below ``size``; ``x`` itself must be valid."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self._pass(x, bits, tweak, back)
            if x < size and valid(x):
                return x


def _digits_back(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Replaces personal data; ``back=True`` restores the originals."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.value = lru_cache(maxsize=100_000)(self._value)

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with pseudonyms, and how many values were replaced."""
        if text is None or not _HINT.search(text):
            return text, 0
        out: list[str] = []
        at = count = 0
        cards = self._cards(text)
        card, m = next(cards, None), _PATTERN.search(text)
        while card or m:
            # a card precedes a phone number that it overlaps, all else goes by its start
            if card and (not m or card[0] < m.start() or (m.lastgroup == "phone" and m.group()[0] != "+" and card[0] < m.end())):
                start, end, new = card
            else:
                start, end = m.span()
                if m.lastgroup == "iban":
                    end, new = self._account(text, start) or (end, None)
                else:
                    new = self.value(m.lastgroup, m.group())
            if new is not None:
                out += text[at:start], new
                at, count = end, count + 1
            while card and card[0] < at:
                card = next(cards, None)
            if m and m.start() < end:
                m = _PATTERN.search(text, end)
        return "".join([*out, text[at:]]), count

    def _cards(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, pseudonym) of the cards in ``text``, in order."""
        for run in _RUN.finditer(text):
            groups = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer("[0-9]+", run.group())]
            others = [m.span() for m in _PATTERN.finditer(text, max(0, run.start() - 1), run.end())
                      if (m.lastgroup in ("date", "ssn") or m.group()[0] == "+") and self.value(m.lastgroup, m.group()) is not None]
            yield from self._cards_of(text, groups, others)

    def _cards_of(self, text: str, groups: list[tuple[int, int]], others: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
        """Cards among neighbouring groups: printed forms first, then any groups of a card's length, the longest first.

        ``others`` are dates, security numbers and international phone numbers, which only a printed form may overlap.
        """
        tried: list[tuple[bool, int, int, int]] = []
        for a in range(len(groups)):
            n, b = 0, a
            while b < len(groups) and n + groups[b][1] - groups[b][0] <= CARD_MOST:
                n, b = n + groups[b][1] - groups[b][0], b + 1
                if n >= CARD_LEAST:
                    printed = b - a == 1 or tuple(y - x for x, y in groups[a:b]) in _PRINTED
                    tried.append((not printed, a, -n, b))
        taken, firm, at = [False] * len(groups), [False] * len(groups), 0
        for start, end in others:
            while at < len(groups) and groups[at][0] < end:
                firm[at] = groups[at][1] > start
                at += 1
        found = []
        digits = "".join(text[x:y] for x, y in groups)
        offset = [0, *accumulate(y - x for x, y in groups)]
        # Luhn sums of all leading digits, for values that end before an even or an odd place
        sums = [[0, *accumulate(_DOUBLED[c] if k % 2 == end else int(c) for k, c in enumerate(digits))] for end in (0, 1)]
        before: list[list[tuple[int, int]]] = [[] for _ in groups]  # failed tries over each group
        for loose, a, _, b in sorted(tried):
            start, end = groups[a][0], groups[b - 1][1]
            if any(taken[a:b]) or (loose and any(firm[a:b])):
                continue
            x, y = offset[a], offset[b]
            checks = (sums[y % 2][y] - sums[y % 2][x]) % 10 == 0 and _is_card(digits[x:y])
            failed = {f for k in range(a, b) for f in before[k]} if checks else set()

            def still(value: str, start: int = start, end: int = end, failed: set[tuple[int, int]] = failed) -> bool:
                """What failed before this value was tried fails with the pseudonym too, else it could not be restored."""
                new = _digits_back(text[start:end], value)
                return not any(_is_card(re.sub("[ -]", "", text[x:min(y, start)] + new[max(0, x - start):max(0, y - start)] + text[max(x, end):y]))
                               for x, y in failed)

            if checks and (new := self._card(text[start:end], still if failed else None)) is not None:
                taken[a:b] = [True] * (b - a)
                found.append((start, end, new))
            else:
                for k in range(a, b):
                    before[k].append((start, end))
        yield from sorted(found)

    def _account(self, text: str, start: int) -> tuple[int, str] | None:
        """(end, pseudonym) of the account number that starts here: the length of its country, else the longest that checks."""
        ends, n, at = [], 0, start
        while n < 34:
            if n and n % 4 == 0 and text[at:at + 1] == " ":
                at += 1
            if not ("A" <= text[at:at + 1] <= "Z" or "0" <= text[at:at + 1] <= "9"):
                break
            n, at = n + 1, at + 1
            if n >= 15 and not re.match("[A-Za-z0-9]", text[at:at + 1]):
                ends.append((n, at))
        fixed = ACCOUNT_LENGTHS.get(text[start:start + 2])
        for n, end in reversed(ends):
            if (fixed is None or n == fixed) and (new := self.value("iban", text[start:end])) is not None:
                return end, new
        return None

    def _value(self, kind: str, found: str) -> str | None:
        return getattr(self, f"_{kind}")(found)

    def _number(self, digits: str, tweak: str, valid: Callable[[str], bool] = lambda d: True) -> str:
        n = len(digits)
        x = self.feistel.permute(int(digits), 10**n, f"{tweak}{n}", self.back, lambda x: valid(str(x).zfill(n)))
        return str(x).zfill(n)

    def _mixed(self, text: str, tweak: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """Permute letters among letters of their case and digits among digits; the rest stays in place."""
        alphabets = ["0123456789" if c.isdigit() else letters if c in letters else
                     letters.upper() if c in letters.upper() else "" for c in text]
        size, x = 1, 0
        for c, a in zip(text, alphabets):
            if a:
                x, size = x * len(a) + a.index(c), size * len(a)
        if size == 1:
            return text
        shape = "".join(c if not a else a[0] for c, a in zip(text, alphabets))
        x = self.feistel.permute(x, size, f"{tweak}:{shape}", self.back)
        out = []
        for c, a in zip(reversed(text), reversed(alphabets)):
            if a:
                x, at = divmod(x, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    def _mail(self, found: str) -> str:
        local, _, domain = found.rpartition("@")
        return f"{self._mixed(local, 'mail')}@{domain}"

    def _aws(self, found: str) -> str:
        return found[:4] + self._radix(found[4:], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "access key")

    def _secret(self, found: str) -> str | None:
        mixed = any(c.isdigit() for c in found) and any(c.isalpha() for c in found)
        return self._radix(found, "0123456789abcdef", "secret",
                           lambda s: any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) if mixed else None

    def _radix(self, text: str, alphabet: str, tweak: str, valid: Callable[[str], bool] = lambda s: True) -> str:
        base, n = len(alphabet), len(text)
        x = 0
        for c in text:
            x = x * base + alphabet.index(c)

        def spell(x: int) -> str:
            out = []
            for _ in range(n):
                x, at = divmod(x, base)
                out.append(alphabet[at])
            return "".join(reversed(out))

        return spell(self.feistel.permute(x, base**n, f"{tweak}{n}", self.back, lambda x: valid(spell(x))))

    def _iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        spell = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or spell(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self._mixed(plain[4:].lower(), "account").upper()
        new = plain[:2] + f"{98 - spell(body + plain[:2] + '00') % 97:02d}" + body
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in found)

    def _date(self, found: str) -> str | None:
        parts = re.split(r"[-/.]", found)
        mark = found[len(parts[0])]
        first = len(parts[0]) == 4
        year = int(parts[0] if first else parts[2])
        # month first with slashes unless it cannot be one, day first otherwise
        turned = mark == "/" and not first and int(parts[0]) > 12
        american = mark == "/" and not turned
        month, day = (int(parts[1]), int(parts[2])) if first else (
            (int(parts[0]), int(parts[1])) if american else (int(parts[1]), int(parts[0])))
        try:
            at = (datetime.date(year, month, day) - _FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= at < _DAYS:
            return None
        width = [len(x) for x in parts]  # fields without a leading zero keep their width, so that they can be restored
        wide = (2, 2) if first else (width[0], width[1]) if american else (width[1], width[0])
        like = _FIRST_DAY + datetime.timedelta(days=at)
        shape = lambda t: wide == (2, 2) or all(
            (x < 10) == (z < 10) for x, z in ((t.month, like.month), (t.day, like.day)))
        new = self._day(at, lambda t: shape(t) and (not turned or t.day > 12))
        y, m, d = f"{new.year:04d}", f"{new.month:0{wide[0]}d}", f"{new.day:0{wide[1]}d}"
        return mark.join([y, m, d] if first else [m, d, y] if american else [d, m, y])

    def _day(self, at: int, valid: Callable[[datetime.date], bool]) -> datetime.date:
        date = lambda x: _FIRST_DAY + datetime.timedelta(days=x)
        return date(self.feistel.permute(at, _DAYS, "day", self.back, lambda x: valid(date(x))))

    def _named(self, found: str) -> str | None:
        """A date with a month's name: same language, letter case and number of digits."""
        name, day, year = (re.search(p, found) for p in (_NAME, r"(?<![0-9])[0-9]{1,2}(?![0-9])", r"[0-9]{4}"))
        style = _STYLE[name.group().lower()]
        months = _MONTHS[style]
        try:
            at = (datetime.date(int(year.group()), months.index(name.group().lower()) + 1, int(day.group())) - _FIRST_DAY).days
        except ValueError:
            return None
        if not 0 <= at < _DAYS:
            return None
        low = int(day.group()) < 10
        new = self._day(at, lambda t: (t.day < 10) == low and _STYLE[months[t.month - 1]] == style)
        case = next((f for f in (str.lower, str.upper, str.capitalize) if f(name.group()) == name.group()), None)
        if case is None:  # mixed case is no usual writing
            return None
        for m, to in sorted(((name, case(months[new.month - 1])), (day, f"{new.day:0{len(day.group())}d}"), (year, f"{new.year:04d}")),
                            key=lambda x: -x[0].start()):
            found = found[:m.start()] + to + found[m.end():]
        return found

    def _ip(self, found: str) -> str | None:
        octets = [int(x) for x in found.split(".")]
        if max(octets) > 255 or any(x != str(int(x)) for x in found.split(".")):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 2**32, "address", self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _ssn(self, found: str) -> str | None:
        good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = found.replace("-", "")
        return _digits_back(found, self._number(digits, "social", good)) if good(digits) else None

    def _card(self, found: str, still: Callable[[str], bool] | None = None) -> str | None:
        digits = re.sub(r"[ -]", "", found)
        if not _is_card(digits):
            return None
        whole = lambda d: d + str(luhn_digit(d))
        body = self._number(digits[:-1], "card", lambda d: _is_card(whole(d)) and (still is None or still(whole(d))))
        return _digits_back(found, body + str(luhn_digit(body)))

    def _phone(self, found: str) -> str | None:
        if found[0] == "+" and not 8 <= sum(map(str.isdigit, found)) <= 15:
            return None
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", found) or _CODE.match(found)
        head = country.group() if country else ""
        digits = re.sub(r"[^0-9]", "", found[len(head):])
        american = lambda d: d[0] in "23456789" and d[3] in "23456789"
        good = american if len(digits) == 10 and american(digits) else lambda d: len(d) != 10 or not american(d)
        return head + _digits_back(found[len(head):], self._number(digits, f"phone{head}", good))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", counted: str | None = None,
                 length: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``counted`` and ``length`` name bigint columns for replacements and characters.

    A column of one of these names is replaced in place, else it is added at the end.
    """
    added = [c for c in (counted, length) if c and c not in docs.columns]
    schema = StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, LongType())
    kinds = dict(docs.dtypes)
    for c in (counted, length):
        if c and kinds.get(c, "bigint") != "bigint":
            raise TypeError(f"column {c} must be a bigint")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            done = [tool.text(t) for t in batch.column(at).to_pylist()]
            new = {text: pa.array([t for t, _ in done], batch.schema.field(at).type)}
            if counted:
                new[counted] = pa.array([n for _, n in done], pa.int64())
            if length:
                new[length] = pa.array([None if t is None else len(t) for t, _ in done], pa.int64())
            names = [*batch.schema.names, *added]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names)

    return docs.mapInArrow(swap, schema)
