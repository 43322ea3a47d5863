"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

Each value that a rule finds and validates is mapped to another of the same format by a
permutation of the format's whole domain, under a key. Equal values so get equal pseudonyms
in all documents, different values different ones, and whoever has the key can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import load, on_texts

#: Only for tests and the registered query; real data needs a key of its own, by the parameter or the session's setting.
KEY = b"quarry public demonstration key"
SETTING = "spark.quarry.pseudonym.key"
ROUNDS = 10
#: Country codes are 1, 7, these, or else three digits; none is the start of another.
CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

RESULT = "struct<n_found:int,matches:array<struct<kind:string,start:int,end:int>>,text:string>"


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The place of ``value`` under a keyed permutation of range(size): a balanced Feistel network, walked until it falls inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mix(i: int, right: int) -> int:
        data = i.to_bytes(1, "big") + right.to_bytes(width, "big")
        h = hashlib.blake2b(data, digest_size=min(64, max(8, width)), key=key[:64], person=hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest())
        return int.from_bytes(h.digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ mix(i, left), left
            else:
                left, right = right, left ^ mix(i, right)
        value = left << half | right
        if value < size:
            return value


def permuted_digits(digits: str, key: bytes, tweak: str, back: bool = False) -> str:
    return str(permuted(int(digits), 10 ** len(digits), key, tweak, back)).zfill(len(digits)) if digits else digits


def permuted_characters(text: str, key: bytes, tweak: str, back: bool = False) -> str:
    """Digits, small and capital letters of A-Z are permuted together, each within its kind; other characters stay."""
    kinds = [next((k for k in (DIGITS, LOWER, UPPER) if c in k), None) for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join("." if k is None else k[0] for k in kinds)
    value = permuted(value, size, key, f"{tweak}:{shape}", back)
    out = list(text)
    for i in reversed(range(len(text))):
        if k := kinds[i]:
            value, place = divmod(value, len(k))
            out[i] = k[place]
    return "".join(out)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order; separators stay."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in value)


def card(value: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a right check digit: all but the first and the check digit are permuted, the check digit follows."""
    d = re.sub(r"\D", "", value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    payload = d[0] + permuted_digits(d[1:-1], key, f"card{d[0]}", back)
    return _refill(value, payload + luhn_digit(payload))


def phone(value: str, key: bytes, back: bool = False) -> str | None:
    """8 to 15 digits after +, or ten: the digits after the country code (up to a separator, else by list) are permuted.

    Ten digits without + count as of country code 1, so that both spellings stay linked.
    """
    d = re.sub(r"\D", "", value)
    code = re.match(r"\+(\d{1,3})(?=[ (.-])", value)
    keep = len(code[1]) if code else CODE.match(d).end() if value[0] == "+" else 0
    if not (8 <= len(d) <= 15 if value[0] == "+" else len(d) == 10):
        return None
    return _refill(value, d[:keep] + permuted_digits(d[keep:], key, f"phone{d[:keep] or 1}", back))


def social(value: str, key: bytes, back: bool = False) -> str | None:
    """A US social security number that could have been issued; its pseudonym could have been, too."""
    def fits(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = re.sub(r"\D", "", value)
    if not fits(d):
        return None
    while True:
        d = permuted_digits(d, key, "social", back)
        if fits(d):
            return _refill(value, d)


def address(value: str, key: bytes, back: bool = False) -> str | None:
    """An IPv4 address: a permutation of all 2**32."""
    parts = value.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    n = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def date(value: str, key: bytes, back: bool = False) -> str | None:
    """A day from 1900 to 2099, written yyyy-mm-dd, dd/mm/yyyy or, if that is no day, mm/dd/yyyy (or with . or -): a permutation of these days.

    A month-first day's pseudonym is month-first too, and has a day over 12, so that it reads no other way.
    """
    m = re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})", value)
    orders = [("Ymd", m)] if m else [(o, re.fullmatch(r"(\d{2})([-/.])(\d{2})\2(\d{4})", value)) for o in ("dmY", "mdY")]
    for order, m in orders:
        part = dict(zip(order, (int(m[1]), int(m[3]), int(m[4]))))
        try:
            day = datetime.date(part["Y"], part["m"], part["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        while True:
            day = datetime.date.fromordinal(FIRST_DAY + permuted(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", back))
            if order != "mdY" or day.day > 12:
                return day.strftime(m[2].join(f"%{c}" for c in order))
    return None


def email(value: str, key: bytes, back: bool = False) -> str | None:
    """The part before @ is permuted regardless of case, which stays, so that spellings of one address stay linked; the domain stays."""
    name, _, domain = value.rpartition("@")
    new = permuted_characters(name.lower(), key, "email", back)
    return f"{''.join(c.upper() if old in UPPER else c for old, c in zip(name, new))}@{domain}"


def secret(value: str, key: bytes, back: bool = False) -> str | None:
    """A credential: the part after its mark is permuted within letters and digits, small hexadecimal ones within those."""
    m = re.match(r"(?i)AKIA|(?:password|passwd|secret|token|api_?key)[ \t]*[=:][ \t]*[\"']?", value)
    mark, rest = value[: m.end()], value[m.end() :]
    if re.fullmatch(r"[0-9a-f]+", rest):
        return mark + format(permuted(int(rest, 16), 16 ** len(rest), key, "hex", back), f"0{len(rest)}x")
    return mark + permuted_characters(rest, key, "secret", back)


#: In order: where matches overlap, the earlier rule has it.
RULES: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("secret", r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?i:password|passwd|secret|token|api_?key)[ \t]*[=:][ \t]*[\"']?[0-9A-Za-z_\-]{8,}", secret),
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", email),
    ("date", r"\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4}", date),
    ("address", r"\d{1,3}(?:\.\d{1,3}){3}", address),
    ("social", r"\d{3}-\d{2}-\d{4}", social),
    ("card", r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", card),
    ("phone", r"\+\d{10,15}(?!\d)|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}", phone),
]
_FOUND = [(kind, re.compile(rf"(?<![\w.+-])(?:{p})(?![\w-])(?!\.\d)" if kind not in ("email", "secret") else rf"(?<![A-Za-z0-9])(?:{p})", re.ASCII), rule) for kind, p, rule in RULES]
#: No rule matches a text without any of these.
_ANY = re.compile(r"[0-9@=:]|AKIA")


def replacements(text: str | None, key: bytes = KEY, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value found, in order."""
    if text is None or not _ANY.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, rule in _FOUND:
        earlier, at = sorted(taken), 0  # of the rules before; a rule's own matches don't overlap
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(earlier) and earlier[at][1] <= start:
                at += 1
            if at < len(earlier) and earlier[at][0] < end:
                continue
            new = rule(m[0], key, back)
            if new is not None:
                taken.append((start, end, kind, new))
    return sorted(taken)


def pseudonymise(text: str | None, key: bytes = KEY, back: bool = False) -> dict:
    taken = replacements(text, key, back)
    if not taken:
        return {"n_found": 0, "matches": [], "text": text}
    out, at = [], 0
    for start, end, _, new in taken:
        out += [text[at:start], new]
        at = end
    return {"n_found": len(taken), "matches": [{"kind": k, "start": s, "end": e} for s, e, k, _ in taken], "text": "".join([*out, text[at:]])}


def pseudonyms(documents: DataFrame, key: bytes | None = None, result: str = "pii", back: bool = False) -> DataFrame:
    """``documents`` with a struct column ``result``: the number found, kind, start and end (characters of the old text) of each, and the new text.

    Cards must pass their check digit, dates and addresses exist, numbers have a possible
    length; what fails stays as it is. With ``back`` the same key restores the text. A null
    text stays null with none found. Rows are handled one by one, so repeated rows and null
    ids need no rule, and an empty table gives an empty table; a very long text is searched
    whole. A column already named ``result`` is replaced, others stay as they are. The key is the parameter, else the
    session's ``SETTING``, else the public demonstration key.
    """
    key = key or documents.sparkSession.conf.get(SETTING, "").encode() or KEY
    found = on_texts(lambda texts: [pseudonymise(t, key, back) for t in texts], RESULT)
    return documents.withColumn(result, found(F.col("text").cast("string")))


def op3_pseudonyms(spark, sf_dir: str) -> DataFrame:
    found = pseudonyms(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("pii.n_found").alias("n_found"), F.col("pii.matches").alias("matches"), F.col("pii.text").alias("text"))
