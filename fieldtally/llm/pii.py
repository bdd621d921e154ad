"""Personal data in text by anchor expansion.

One Aho-Corasick pass over a text reports anchors: at-signs, plus signs and digits, schemes of
addresses, and cues of accounts and secrets. At each anchor a small deterministic parser expands
to the span's boundaries and validates it:

    email   name@label.label..                          anchored at the at-sign
    ip      four numbers joined by dots, each to 255    anchored at a digit
    card    14 to 19 digits, one blank or hyphen between them at most, Luhn sum right
    phone   plus sign, then 10 to 15 digits with blanks, dots, hyphens and brackets
    login   user:password@ in an address with a scheme
    iban    after its cue: country, check digits and account with the right remainder
    key     an access key by its fixed beginning
    secret  the value given to a password, token or the like
    account after its cue: 8 to 17 digits, one blank or hyphen between them at most, no word behind them

Cues and schemes count in upper, lower or mixed case, beginnings of keys as they are written.
Matches of one kind do not overlap and are found from the left; a match that fails validation is
passed over as a whole. Places count code points, ends are exclusive.

Defined cases: a null text counts as empty and has no spans (when redacted it stays null); repeated
rows give repeated rows; an empty table gives an empty result; an output column replaces an input
column of the same name. Texts are read whole; time is linear in their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldtally.llm.shared import chunks, named, ship, with_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "key", "secret", "account")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_DIGITS = frozenset("0123456789")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WORD = _DIGITS | _LOWER | _UPPER
_NAME = _WORD | frozenset("._%+-")
_LABEL = _WORD | frozenset("-")
_DIALLED = _DIGITS | frozenset(" ().-")
_VALUE = _WORD | frozenset("._~+/=!#$%^&*-")

# Beginnings and cues.
SCHEMES = (
    "http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "postgres://", "postgresql://", "mysql://",
    "mariadb://", "redis://", "rediss://", "mongodb://", "mongodb+srv://", "amqp://", "amqps://", "ldap://",
    "ldaps://", "smtp://", "imap://", "ws://", "wss://",
)
KEY_BEGINNINGS = {"AKIA": 20, "ASIA": 20, "ghp_": 40, "gho_": 40}  # length of the whole key
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key")
ACCOUNT_CUES = ("account number", "account no", "account nr", "acct number", "acct no", "kontonummer")

Span = tuple[int, int, str]


@cache
def _anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    found = {"@": "email", "+": "phone"} | dict.fromkeys("0123456789", "digit")
    found |= dict.fromkeys(SCHEMES, "login") | {"iban": "iban"} | dict.fromkeys(ACCOUNT_CUES, "account")
    found |= dict.fromkeys(SECRET_CUES, "secret")
    for word, kind in found.items():
        automaton.add_word(word, (kind, word))
    for word in KEY_BEGINNINGS:
        automaton.add_word(word.lower(), ("key", word))
    automaton.make_automaton()
    return automaton


_FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _folded(text: str) -> str:
    """The text in lower case, place by place."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else text.translate(_FOLD)


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _email(text: str, at: int, taken: int) -> tuple[int, int] | None:
    start = at
    while start > taken and text[start - 1] in _NAME:
        start -= 1
    label = _run(text, at + 1, _LABEL)
    if start == at or label == at + 1:
        return None
    end = label
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end = after
    return (start, end) if end > label else None


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = ord(d) - 48
        if i % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[int, bool]:
    """(end of the digits and single separators from here, whether they make a card)."""
    n, end = len(text), at + 1
    while end < n:
        c = text[end]
        if c in _DIGITS:
            end += 1
        elif c in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    if end - at < 14:
        return end, False
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, 14 <= len(digits) <= 19 and _luhn(digits)


def _ips(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """(end of the dotted numbers from here, those groups of four that are addresses)."""
    runs, end = [(at, _run(text, at, _DIGITS))], 0
    while True:
        end = runs[-1][1]
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
            runs.append((end + 1, _run(text, end + 1, _DIGITS)))
        else:
            break
    fours = (runs[i : i + 4] for i in range(0, len(runs) - 3, 4))
    return end, [
        (four[0][0], four[3][1]) for four in fours if all(_to_255(text[a:b]) for a, b in four)
    ]


def _to_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def _phone(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _DIALLED)
    while end > at + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    if end < at + 4:
        return None
    n = sum(c in _DIGITS for c in text[at:end])
    return (at, end) if 10 <= n <= 15 else None


def _login(text: str, at: int) -> tuple[int, int] | None:
    user = _run(text, at, _NAME)
    if user == at or user >= len(text) or text[user] != ":":
        return None
    end = _run(text, user + 1, _VALUE)
    return (at, end) if end > user + 1 and text[end : end + 1] == "@" else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " :=#":
        at += 1
    end, packed = at, []
    while end < len(text) and len(packed) < 34:
        if text[end] in _DIGITS or text[end] in _UPPER:
            packed.append(text[end])
            end += 1
        elif text[end] == " " and text[end + 1 : end + 2] in _WORD and len(packed) % 4 == 0:
            end += 1
        else:
            break
    # A word after the account may have been taken along: the longest right account counts.
    while len(packed) >= 15:
        code = "".join(packed)
        if code[:2].isalpha() and code[2:4].isdigit():
            number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
            if int(number) % 97 == 1:
                return at, end
        packed.pop()
        end -= 1
        while text[end - 1] == " ":
            end -= 1
    return None


_KEY = _WORD | {"_"}


def _key(text: str, at: int, word: str, run: int) -> tuple[int, bool]:
    """(end of the run of key characters from here, whether it is a key); run: end of the last such run."""
    end = run if at < run else _run(text, at, _KEY)
    right = text.startswith(word, at) and not (at and text[at - 1] in _WORD)
    return end, right and end - at == KEY_BEGINNINGS[word]


def _account(text: str, at: int) -> tuple[int, int] | None:
    while at < len(text) and text[at] in " .:=#":
        at += 1
    if text[at : at + 1] not in _DIGITS or not text[at : at + 1]:
        return None
    end, n = at + 1, 1
    while end < len(text) and n < 18:
        if text[end] in _DIGITS:
            end, n = end + 1, n + 1
        elif text[end] in " -" and text[end + 1 : end + 2] in _DIGITS and text[end + 1 : end + 2]:
            end, n = end + 2, n + 1
        else:
            break
    behind = text[end : end + 1]
    return (at, end) if 8 <= n <= 17 and not (behind and behind in _KEY) else None


def _secret(text: str, at: int) -> tuple[int, int, bool]:
    """(start and end of the value, whether it is a secret); both are `at` where nothing is given."""
    begun = at
    at += text[at : at + 1] in ('"', "'")
    at = _run(text, at, frozenset(" "))
    if text[at : at + 1] not in (":", "="):
        return begun, begun, False
    at = _run(text, at + 1, frozenset(" "))
    at += text[at : at + 1] in ('"', "'")
    end = _run(text, at, _VALUE)
    value = text[at:end]
    return at, end, len(value) >= 8 and any(c in _DIGITS for c in value)


def spans_of(text: str | None) -> list[Span]:
    """(start, end, kind) of all spans, by start, then by the order of KINDS."""
    if not text:
        return []
    found: list[Span] = []
    taken = dict.fromkeys(("email", "card", "ip", "login", "iban", "key", "secret", "account"), 0)
    run = 0
    for last, (kind, word) in _anchors().iter(_folded(text)):
        if kind == "digit":
            if last >= taken["card"]:
                end, right = _card(text, last)
                taken["card"] = end
                if right:
                    found.append((last, end, "card"))
            if last >= taken["ip"]:
                taken["ip"], addresses = _ips(text, last)
                found += [(a, b, "ip") for a, b in addresses]
            continue
        if kind == "phone":
            span = _phone(text, last)
        elif last < taken[kind]:
            continue
        elif kind == "email":
            span = _email(text, last, taken["email"])
        elif kind == "login":
            span = _login(text, last + 1)
        elif kind == "iban":
            span = _iban(text, last + 1)
        elif kind == "account":
            span = _account(text, last + 1)
        elif kind == "key":
            at = last + 1 - len(word)
            run, right = _key(text, at, word, run)
            span = (at, run) if right else None
        else:
            at, end, right = _secret(text, last + 1)
            span = (at, end) if right else None
            # A cue inside a value that is none gets a part of that value, which is none either. Only a
            # cue that ends with the value, or one place before, may be given something behind it.
            taken["secret"] = max(taken["secret"], end - 2)
        if span:
            found.append((*span, kind))
            if kind != "phone":
                taken[kind] = span[1]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping ones by one."""
    if text is None:
        return None
    parts, done, open_end, open_kind = [], 0, -1, ""
    for start, end, kind in spans_of(text):
        if start >= open_end:
            if open_kind:
                parts.append(f"<{open_kind.upper()}>")
                done = open_end
            parts.append(text[done:start])
            open_end, open_kind = end, kind
        else:
            open_end = max(open_end, end)
    if not open_kind:
        return text
    return "".join([*parts, f"<{open_kind.upper()}>", text[open_end:]])


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value", T.StringType()),
        ]
    )
)


def _mapped(
    docs: DataFrame, text: str, keep: list[str], out: T.StructField, convert: Callable[[list], pa.Array]
) -> DataFrame:
    """The columns in `keep`, and one made of the text, task by task and without a shuffle."""
    ship(docs.sparkSession)
    frame, fields = with_text(docs, text, keep)
    schema = T.StructType([*fields, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(0)):
                columns = [batch.column(i + 1).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, convert(texts)], names=schema.names)

    return frame.mapInArrow(run, schema)


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """The columns in `keep` (all, if not given) with `out`: kind, start, end and value of each span."""
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    )

    def convert(texts: list) -> pa.Array:
        rows = [[(k, a, b, t[a:b]) for a, b, k in spans_of(t)] for t in texts]
        return pa.array([[dict(zip(("kind", "start", "end", "value"), s)) for s in r] for r in rows], kind)

    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out]
    return _mapped(docs, text, kept, T.StructField(out, SPANS), convert)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, with every span in the text replaced by its kind."""
    others = [c for c in docs.columns if c != text]
    made = _mapped(
        docs, text, others, T.StructField(text, T.StringType()),
        lambda texts: pa.array([redacted(t) for t in texts], pa.string()),
    )
    return made.select(*named(docs.columns))
