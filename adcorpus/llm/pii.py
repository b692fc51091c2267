"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs (plain and spelled), schemes, plus
signs, digits and identifier cues. Small deterministic parsers expand each anchor to the span it
belongs to, left and right, and validate it. Nothing else looks at the text, so the work is one
pass plus a little per anchor, for texts of any length.

Kinds: email, ip, card, phone (the base kinds, as their patterns state); and from the method url
(scheme up to the end of the address), account (an IBAN with a valid check sum, or the identifier
after an account cue), address (a street cue with a house number) and spelled (an email with its
signs spelled out). Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adcorpus.llm.common import as_text, documents, map_arrow

KINDS = ("email", "ip", "card", "phone", "url", "account", "address", "spelled")
BASE = KINDS[:4]

DIGITS = "0123456789"
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + DIGITS)
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE = frozenset(" ().-" + DIGITS)
URL = frozenset(ALNUM | set("-._~:/?#[]@!$&'()*+,;=%"))

SPELLED_AT = ("(at)", "[at]", "{at}")
SCHEMES = ("://",)
ACCOUNT_CUES = ("IBAN", "iban", "Account", "account", "Konto", "konto", "Compte", "compte", "Cuenta", "cuenta")
ADDRESS_CUES = (
    " Street", " Avenue", " Road", " Lane", "straße", "strasse", "Rue ", "rue ", "Avenida ", "Calle ", "calle ",
)

ACCOUNT = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?|n°|#))?[ ]?[:=]?[ ]?([A-Z]{0,4}[0-9][A-Z0-9]{0,33}(?![A-Z0-9])(?:[ -][A-Z0-9]{2,4}){0,8})", re.I)
NUMBER_AFTER = re.compile(r"[ ]{1,3}([0-9]{1,5}[A-Za-z]?)(?![0-9A-Za-z])")
NUMBER_BEFORE = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,5}[A-Za-z]?,?(?: [^\W\d_][^\W\d_'-]{0,40}){1,4}$")
STREET_NAME = re.compile(r"[^\W\d_][^\W\d_'-]{0,40}(?: [^\W\d_][^\W\d_'-]{0,40}){0,4},?[ ]{1,2}([0-9]{1,5})(?![0-9])")
DOT = re.compile(r"[ ]?[(\[{]dot[)\]}][ ]?|\.", re.I)

Found = tuple[int, int]


def run_right(text: str, at: int, chars) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def run_left(text: str, at: int, chars, floor: int = 0) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def domain_end(text: str, at: int) -> int:
    """End of a domain of two labels or more that starts at ``at``, or -1."""
    end, labels = run_right(text, at, LABEL), 0
    if end == at:
        return -1
    while end < len(text) and text[end] == ".":
        after = run_right(text, end + 1, LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return end if labels else -1


def email(text: str, at: int, floor: int) -> Found | None:
    """Around an at-sign, not left of ``floor``."""
    start, end = run_left(text, at, LOCAL, floor), domain_end(text, at + 1)
    return (start, end) if start < at and end > 0 else None


def dotted(text: str, start: int) -> tuple[int, list[str]]:
    """Digit runs joined by single dots from ``start``: where they end, and the first four."""
    end, parts = start, []
    while True:
        after = run_right(text, end, DIGITS)
        parts.append(text[end:after])
        end = after
        if len(parts) == 4 or end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
            return end, parts
        end += 1


def is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def spaced(text: str, start: int) -> int:
    """End of digits with at most one space or hyphen between two."""
    end = start + 1
    while end < len(text):
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def phone(text: str, at: int) -> tuple[int, bool] | None:
    """From a plus sign: where the number ends, and whether it has 10 to 15 digits."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4 or text[end - 1] not in DIGITS:
        return None
    return end, 10 <= len(digits_of(text[at:end])) <= 15


def iban(value: str) -> bool:
    value = value.replace(" ", "").replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def account(text: str, at: int) -> Found | None:
    """After an account cue that ends at ``at``: a valid IBAN, or 6 to 18 digits."""
    m = ACCOUNT.match(text, at)
    if not m:
        return None
    value = m[1]
    while value and not iban(value) and " " in value and not value.replace(" ", "").replace("-", "").isdigit():
        value = value.rpartition(" ")[0]
    if iban(value) or value.replace(" ", "").replace("-", "").isdigit() and 6 <= len(digits_of(value)) <= 18:
        return m.start(1), m.start(1) + len(value)
    return None


def url(text: str, at: int, floor: int) -> Found | None:
    """Around ``://``: letters before, a host and what follows after; closing marks stay out."""
    start = run_left(text, at, ALNUM, floor)
    if start == at or text[at + 3 : at + 4] not in ALNUM:
        return None
    end = run_right(text, at + 3, URL)
    while text[end - 1] in ".,;:!?)]'":
        end -= 1
    return start, end


def address(text: str, at: int, cue: str) -> Found | None:
    """A street with its house number: before or after the name, as the cue's language has it."""
    end = at + len(cue)
    if cue.startswith(" "):
        m = NUMBER_BEFORE.search(text[max(0, at - 220) : at])
        return (at - len(m[0]), end) if m and (end == len(text) or not text[end].isalpha()) else None
    if cue.endswith(" "):
        m = STREET_NAME.match(text, end)
        return (at, m.end()) if m and (at == 0 or not text[at - 1].isalpha()) else None
    m = NUMBER_AFTER.match(text, end)
    if not m:
        return None
    # the number is what ends a name, so no letters are walked over twice
    start = at
    while start > 0 and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    return start, m.end()


def spelled(text: str, at: int, end: int) -> Found | None:
    """An email whose at-sign is spelled and lies at at:end, blanks around it allowed."""
    left = at - (at > 0 and text[at - 1] == " ")
    start = run_left(text, left, LOCAL)
    right = end + (end < len(text) and text[end] == " ")
    stop, labels = run_right(text, right, LABEL), 0
    if start == left or stop == right:
        return None
    while (m := DOT.match(text, stop)) and (after := run_right(text, m.end(), LABEL)) > m.end():
        stop, labels = after, labels + 1
    return (start, stop) if labels else None


def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, words in (
        ("@", ("@",)), ("+", ("+",)), ("d", DIGITS), ("s", SPELLED_AT), ("u", SCHEMES), ("a", ACCOUNT_CUES), ("r", ADDRESS_CUES),
    ):
        for word in words:
            automaton.add_word(word, (kind, word))
    automaton.make_automaton()
    return automaton


def finder() -> Callable[[str], tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """text -> base spans and added spans."""
    automaton = anchors()

    def find(text: str):
        base: list[tuple[str, int, int]] = []
        more: list[tuple[str, int, int]] = []
        mailed = ip_end = card_end = seen = addressed = numbered = 0
        for last, (kind, word) in automaton.iter(text):
            at = last + 1 - len(word)
            if kind == "d":
                if at >= card_end:
                    end = spaced(text, at)
                    card_end = end
                    digits = digits_of(text[at:end])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        base.append(("card", at, end))
                if at >= ip_end and at >= seen:
                    end, parts = dotted(text, at)
                    if len(parts) == 4:
                        ip_end = end
                        if all(map(is_octet, parts)):
                            base.append(("ip", at, end))
                    seen = end
            elif kind == "@":
                if found := email(text, at, mailed):
                    base.append(("email", *found))
                    mailed = found[1]
            elif kind == "+":
                if found := phone(text, at):
                    if found[1]:
                        base.append(("phone", at, found[0]))
            elif kind == "u":
                if at >= addressed and (found := url(text, at, addressed)):
                    more.append(("url", *found))
                    addressed = found[1]
            elif kind == "a":
                if at >= numbered and (found := account(text, last + 1)):
                    more.append(("account", *found))
                    numbered = found[1]
            elif kind == "r":
                if found := address(text, at, word):
                    more.append(("address", *found))
            elif found := spelled(text, at, last + 1):
                more.append(("spelled", *found))
        return base, more

    return find


ORDER = {kind: i for i, kind in enumerate(KINDS)}


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = sorted(set(spans), key=lambda s: (s[1], ORDER[s[0]], s[2]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered)


SPANS = "doc_id bigint, kind string, start bigint, end bigint, base boolean, value string"
COUNTS = ", ".join(f"n_{k} bigint" for k in KINDS)


def pii_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> for every kind, base_sha256 (of the joined
    base spans) and spans (all of them, joined).

    Null counts as empty: no spans. Whole texts are searched, of any length; repeated rows give
    repeated results; a null doc_id stays null. An empty table gives an empty result; other
    columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            counts = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in batch.column(1):
                base, more = find(text.as_py())
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base) + sum(s[0] == k for s in set(more)))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id bigint, {COUNTS}, base_sha256 string, spans string")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end, base, value; edge cases as in pii_summary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                base, more = find(text)
                rows += [(doc_id, *s, True, text[s[1] : s[2]]) for s in base]
                rows += [(doc_id, *s, False, text[s[1] : s[2]]) for s in dict.fromkeys(more)]
            names = ["doc_id", "kind", "start", "end", "base", "value"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), as_text(text_col).alias("text"))
    return map_arrow(rows, run, SPANS)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_summary(documents(spark, sf_dir))
