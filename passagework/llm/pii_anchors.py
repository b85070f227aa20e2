"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over the whole text and stops at anchors only: at-signs, plus signs, digits,
schemes and cue words. From each anchor a small parser walks outwards to the exact bounds and validates what
it has found. All positions are code points, ends exclusive.

The kinds email, ip, card and phone follow fixed patterns, leftmost and without overlap within a kind; a
match that fails its check is dropped and not tried again:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255
* card ``[0-9]([\\x20-]?[0-9])+`` with 13 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

The method adds url (scheme anchors), address (house number before a street word or its abbreviation) and account
(a cue word in any case, then marks and fillers such as ``number`` or ``is``, and an identifier of 6 to 34 letters
and digits with at least four digits). Groups of an identifier may be parted by single spaces or hyphens: an IBAN
ends where its check digits hold, any other identifier takes further groups after a space while they are all digits.

Defined cases: null is the empty text; equal rows give equal results; a text without anchors has no spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.llm.common import fields, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "address", "account")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL, LABEL, PHONE = ALNUM | set("._%+-"), ALNUM | {"-"}, DIGITS | set(" ().-")
URL_END = frozenset(" \t\r\n\"'<>|\\^`{}")
SCHEMES = ("http", "https", "ftp")
STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", "straße", "strasse", "rue", "calle")
#: These also end common words or are titles, so they and the words up to the house number begin with a capital or digit.
SHORT = ("st", "ave", "rd", "blvd", "ln", "dr")
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "user id")
FILLERS = ("number", "no", "nr", "num", "id", "is", "was", "code")
BETWEEN = frozenset(" :#=.")


def _automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for d in DIGITS:
        auto.add_word(d, ("digit", 1))
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    auto.add_word("://", ("scheme", 3))
    for kind, found in (("street", STREETS), ("short", SHORT), ("cue", CUES)):
        for w in found:
            auto.add_word(w, (kind, len(w)))
    auto.make_automaton()
    return auto


def run_of(text: str, i: int, allowed: frozenset | set) -> int:
    """The end of the run of allowed characters that begins at ``i``."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = run_of(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (far := run_of(text, end + 1, LABEL)) > end + 1:
        end, labels = far, labels + 1
    return (start, end) if labels else None


def ip_at(text: str, i: int) -> tuple[int, bool]:
    """Where the search goes on, and whether four dotted parts end there."""
    first = end = run_of(text, i, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (far := run_of(text, end + 1, DIGITS)) == end + 1:
            return first, False
        end = far
    return end, True


def card_end(text: str, i: int) -> int:
    n, i = len(text), i + 1
    while i < n:
        if text[i] in DIGITS:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in DIGITS:
            i += 2
        else:
            break
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def phone_end(text: str, plus: int) -> int | None:
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = run_of(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > plus + 3 and text[end - 1] in DIGITS else None


def url_at(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    start = colon
    while start > floor and colon - start < 8 and text[start - 1].isalpha():
        start -= 1
    if text[start:colon].lower() not in SCHEMES:
        return None
    end = colon + 3
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, end) if end > colon + 3 else None


def address_at(text: str, start: int, end: int, floor: int) -> tuple[int, int] | None:
    """``12 Long Oak Street``: a house number at most four words before a street word that ends a word."""
    if end < len(text) and text[end].isalnum():
        return None
    i = start
    while i > floor and text[i - 1].isalpha():
        i -= 1
    for _ in range(5):
        if i <= floor or text[i - 1] != " ":
            return None
        i -= 1
        j = i
        while j > floor and text[j - 1].isalnum():
            j -= 1
        if i - j and text[j] in DIGITS:
            whole = i - j <= 5 and text[j : i - 1].isdigit() | (i - j == 1) and (j == 0 or not text[j - 1].isalnum())
            return (j, end) if whole else None
        i = j
    return None


def groups(text: str, i: int) -> list[int]:
    """Ends of the runs of letters and digits from ``i`` on that a single space or hyphens part, up to 34 characters."""
    ends, size = [], 0
    while (far := run_of(text, i, ALNUM)) > i and (size := size + far - i) <= 34:
        ends.append(far)
        i = far + 1 if text[far : far + 1] == " " else run_of(text, far, {"-"})
        if i == far:
            break
    return ends


def iban(name: str) -> bool:
    """Two letters, two check digits and 11 to 30 more that give 1 modulo 97."""
    if not (15 <= len(name) <= 34 and name[:2].isalpha() and name[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in name[4:] + name[:4])) % 97 == 1


def account_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The identifier after a cue: ``account no: 12-345678``, ``IBAN DE89 3704 0044 0532 0130 00``."""
    if start and text[start - 1].isalnum():
        return None
    i = run_of(text, end, BETWEEN)
    for _ in range(3):
        far = run_of(text, i, ALNUM)
        if i == end or text[i:far].lower() not in FILLERS:
            break
        i = run_of(text, far, BETWEEN)
    if i == end or i - end > 24:
        return None
    ends = groups(text, i)
    plain = lambda far: text[i:far].replace(" ", "").replace("-", "")
    for far in reversed(ends):
        if iban(plain(far)):
            return i, far
    stop = None
    for k, far in enumerate(ends):
        if k and text[ends[k - 1]] == " " and not (text[ends[k - 1] + 1 : far].isdigit() and any(c in DIGITS for c in text[i : ends[k - 1]])):
            break
        stop = far
    return (i, stop) if stop and 6 <= len(plain(stop)) and sum(c in DIGITS for c in text[i:stop]) >= 4 else None


class Finder:
    def __init__(self) -> None:
        self.auto = _automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end), by kind as in KINDS, then by start."""
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)

        def keep(kind: str, span: tuple[int, int] | None) -> None:
            if span and span[0] >= done[kind]:
                out[kind].append(span)
                done[kind] = span[1]

        text = text or ""
        lower = text.lower()
        if len(lower) != len(text):  # a letter that grows in lower case would move all positions
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for last, (anchor, size) in self.auto.iter(lower):
            i = last + 1 - size
            if anchor == "digit":
                if i >= done["card"]:
                    end = done["card"] = card_end(text, i)
                    digits = "".join(c for c in text[i:end] if c in DIGITS) if 13 <= end - i <= 37 else ""
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((i, end))
                if i >= done["ip"]:
                    done["ip"], whole = ip_at(text, i)
                    if whole and all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text[i : done["ip"]].split("."))):
                        out["ip"].append((i, done["ip"]))
            elif anchor == "at":
                keep("email", email_at(text, i, done["email"]))
            elif anchor == "plus":
                if i >= done["phone"] and (end := phone_end(text, i)):
                    done["phone"] = end
                    if 9 <= sum(c in DIGITS for c in text[i:end]) <= 15:
                        out["phone"].append((i, end))
            elif anchor == "scheme":
                if i >= done["url"]:
                    keep("url", url_at(text, i, done["url"]))
            elif anchor == "street":
                keep("address", address_at(text, i, last + 1, done["address"]))
            elif anchor == "short":
                if i and text[i - 1] == " " and text[i].isupper() and (span := address_at(text, i, last + 1, done["address"])):
                    words = text[span[0] : i].split()[1:]
                    keep("address", span if words and all(w[0].isupper() or w[0] in DIGITS for w in words) else None)
            else:
                keep("account", account_at(text, i, last + 1))
        return [(k, a, b) for k in KINDS for a, b in out[k]]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or each group of overlapping spans, replaced by its first kind: ``[EMAIL]``."""
    if not spans:
        return text
    parts, at, order = [], 0, {k: n for n, k in enumerate(KINDS)}
    for kind, start, end in sorted(spans, key=lambda s: (s[1], order[s[0]])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _finder():
    made: list[Finder] = []

    def get() -> Finder:
        if not made:
            made.append(Finder())
        return made[0]

    return get


def find(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``found``, an array of (kind, start, end)."""
    schema = T.StructType([*fields(df, *keep), T.StructField("found", T.ArrayType(SPAN))])
    finder = _finder()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in finder().spans(t.as_py())] for t in batch.column("__text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(rows, kind)], names=schema.fieldNames())

    return map_batches(df.select(*keep, df[text].alias("__text")), run, schema)


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``df`` with personal data replaced in ``text``; ``length``, where present, is set to the new length."""
    schema = T.StructType(fields(df, *df.columns))
    finder, names = _finder(), df.columns
    sized = length if length in names else None

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        f, old = finder(), batch.column(text)
        new = [redacted(t, f.spans(t)) for t in (x.as_py() for x in old)]
        columns = {n: batch.column(n) for n in names}
        columns[text] = pa.array(new, old.type)
        if sized:
            columns[sized] = pa.array([len(t) if t is not None else None for t in new], columns[sized].type)
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return map_batches(df, run, schema)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts and hashed positions of the output of ``find``."""
    spans = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        *keep,
        *map(count, BASE_KINDS),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
