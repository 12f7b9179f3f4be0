"""Operator 4: personal data, with offset-preserving deobfuscation.

Plain identifiers are found by the base patterns.  Transducers rewrite every text to a normal form - homoglyphs and full-width or other digits to ASCII, invisible
characters away, spelled digits to digits, "at" and "dot" in their many brackets to @ and . - and
carry, for every character of the normal form, the source span it stands for.  The same patterns
run over the normal form, and their spans are mapped back to the source.  A span found this way is
added only if it holds a rewritten character and touches no base span; base spans always stay.

Offsets count code points of the source; ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, with_field
from .textops import slices, text_buffers

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain, tried once for each @ from the start of the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    """Four dotted numbers of at most 255; a longer chain of numbers is taken four at a time."""
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[Span]:
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[Span]]:
    """The plain identifiers of a text, by kind."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if _DIGIT.search(text):
        out["ip"], out["card"] = list(ips(text)), list(cards(text))
        if "+" in text:
            out["phone"] = list(phones(text))
    return out


# Letters that look like an ASCII one (Cyrillic, Greek, others).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ӏ": "l", "ⅼ": "l", "∅": "0",
    "․": ".", "。": ".", "·": ".", "•": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹫": "@", "ⓐ": "@",
}
# Characters that show nothing.
INVISIBLE = "­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︀︁︎️﻿"
# Spelled digits of the four languages.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_WORDS = "|".join(sorted(SPELLED, key=len, reverse=True))
_AT, _DOT, _PLUS, _DASH = r"at|arroba|arobase|klammeraffe|chez", r"dot|punto|point|punkt|period", r"plus|más|mas", r"dash|hyphen|minus|guion|tiret|bindestrich"
# Top-level domains that a bare "x at y dot z" must end in, so that prose stays prose.
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at be us ca au in jp cn ru br mx ar cl pt pl se no fi dk ie nz za name me tv app dev ai cloud online site xyz example test invalid".split())

# letters that stand for digits count only inside a token of digits and such letters
_MIXED_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])(?=[0-9]*[OolI])[0-9OolI]+(?![A-Za-z0-9])|(?<=[0-9.][. -])[OolI]{1,4}(?=[. -][0-9OolI])|(?<=[0-9]\.)[OolI](?![A-Za-z0-9])")
_STRANGE = re.compile(
    "[" + re.escape("".join(HOMOGLYPHS) + INVISIBLE) + "٠-٩۰-۹०-९⁰-₉①-⓿　！-～\U0001d400-\U0001d7ff²³¹]"
)


class Rewritten:
    """A text with, for every character, the source span it stands for and whether it was changed."""

    __slots__ = ("changed", "ends", "starts", "text")

    def __init__(self, text: str, starts: array, ends: array, changed: bytearray):
        self.text, self.starts, self.ends, self.changed = text, starts, ends, changed

    @classmethod
    def of(cls, text: str) -> Rewritten:
        places = array("q", np.arange(len(text) + 1).tobytes())
        return cls(text, places[:-1], places[1:], bytearray(len(text)))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Applies edits (start, end, new), ascending and apart; each new character stands for the
        whole source of the edit."""
        if not edits:
            return self
        text, starts, ends, changed, done = [], array("q"), array("q"), bytearray(), 0
        for lo, hi, new in edits:
            text.append(self.text[done:lo])
            starts += self.starts[done:lo]
            ends += self.ends[done:lo]
            changed += self.changed[done:lo]
            if not new and changed:
                changed[-1] = 1  # what is left out shows at its neighbour
            text.append(new)
            starts += self.starts[lo : lo + 1] * len(new)
            ends += self.ends[hi - 1 : hi] * len(new)
            changed += b"\1" * len(new)
            done = hi
        text.append(self.text[done:])
        return Rewritten("".join(text), starts + self.starts[done:], ends + self.ends[done:], changed + self.changed[done:])

    def source(self, lo: int, hi: int) -> Span:
        return min(self.starts[lo:hi]), max(self.ends[lo:hi])


def _plain(ch: str) -> str:
    """The ASCII form of one character; itself if it has none."""
    if ch in INVISIBLE:
        return ""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", ch)
    return folded if folded.isascii() and len(folded) == 1 else ch


def fold_characters(r: Rewritten) -> Rewritten:
    """First transducer: look-alikes, other digits and invisible characters, then letters in numbers."""
    r = r.replace([(m.start(), m.end(), new) for m in _STRANGE.finditer(r.text) if (new := _plain(m[0])) != m[0]])
    letters = (m.start() + k for m in _MIXED_TOKEN.finditer(r.text) for k, ch in enumerate(m[0]) if not ch.isdigit())
    return r.replace([(i, i + 1, "0" if r.text[i] in "Oo" else "1") for i in letters])


_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_WORDS}|double|triple)(?![^\W_])")


def join_digits(r: Rewritten) -> Rewritten:
    """Second transducer: spelled digits to digits, then single digits of a spelled run side by side."""
    edits, repeat, opened = [], 1, 0
    for m in _SPELLED.finditer(r.text):
        word = m[0].lower().replace("ſ", "s").replace("i̇", "i")  # (?i) takes these for s and i
        if word in ("double", "triple"):
            repeat, opened = 2 + (word == "triple"), m.start()
            continue
        near = repeat > 1 and r.text[opened:m.start()].split() in (["double"], ["triple"], ["Double"], ["Triple"])
        edits.append((opened if near else m.start(), m.end(), SPELLED[word] * (repeat if near else 1)))
        repeat = 1
    r = r.replace(edits)
    gaps = []
    for m in re.finditer(r"(?<=[0-9])[\s,]+(?=[0-9])", r.text):
        if r.changed[m.start() - 1] and r.changed[m.end()]:
            gaps.append((m.start(), m.end(), ""))
    return r.replace(gaps)


_BRACKET_RULES = (
    (re.compile(rf"(?i)(?<!\s)\s*+[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]\s*"), "@"),
    (re.compile(rf"(?i)(?<!\s)\s*+[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*"), "."),
)
_BARE_DOT = re.compile(rf"(?i)(?<=[\s_*-])(?:{_DOT})[\s_*-]+(?=\w)")
_WORD_RULES = (
    # a bare "at" counts only before a domain whose dot was disguised, see restore_marks()
    (re.compile(rf"(?i)(?<=[0-9])[\s]*(?:{_DASH})[\s]*(?=[0-9])"), "-"),
    (re.compile(rf"(?i)\b(?:{_PLUS})\s+(?=[0-9])"), "+"),
)
_BARE_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[\s_*-]+(?:{_AT})[\s_*-]+(?=[A-Za-z0-9-]+(\.)(?:[A-Za-z0-9-]+\.)*([A-Za-z]+))")
_DOT_MARK = re.compile(r"\.")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?: +@ *| *@ +)(?=[A-Za-z0-9-]+ ?\. ?[A-Za-z]{2,})")
_SPACED_DOT = re.compile(r"(?<=[A-Za-z0-9]) \. (?=[A-Za-z0-9])| \.(?=[A-Za-z]{2,}\b)")


def bare_dots(text: str) -> list[tuple[int, int, str]]:
    """Edits of the "dot" words that stand between words: (?<=\\w)[\\s_*-]+ before each is looked for
    backwards, as a search for it takes quadratic time on long rules of underscores."""
    edits, done = [], 0
    for m in _BARE_DOT.finditer(text):
        at = m.start()
        while at > done and (text[at - 1] in "_*-" or text[at - 1].isspace()):
            at -= 1
        if not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            at = text.find("_", at, m.start()) + 1 or m.start()
        if at < m.start():
            edits.append((at, m.end(), "."))
            done = m.end()
    return edits


def restore_marks(r: Rewritten) -> Rewritten:
    """Third transducer: at, dot, dash and plus in words or brackets."""
    for rule, mark in _BRACKET_RULES:
        r = r.replace([(m.start(), m.end(), mark) for m in rule.finditer(r.text)])
    r = r.replace(bare_dots(r.text))
    for rule, mark in _WORD_RULES:
        r = r.replace([(m.start(), m.end(), mark) for m in rule.finditer(r.text)])
    if any(r.changed[m.start()] for m in _DOT_MARK.finditer(r.text)):
        r = r.replace([(m.start(), m.end(), "@") for m in _BARE_AT.finditer(r.text) if r.changed[m.start(1)] and m[2].lower() in DOMAINS])
    spaced = [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(r.text)]
    if spaced:
        r = r.replace(spaced)
        near = [(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(r.text) if "@" in r.text[max(0, m.start() - 40) : m.start()].rpartition(" ")[2]]
        r = r.replace(near)
    return r


def normalised(text: str) -> Rewritten:
    return restore_marks(join_digits(fold_characters(Rewritten.of(text))))


_ENDS_WELL = re.compile(r"\.[A-Za-z]{2,24}$")


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers that show only in the normal form, as source spans; none touches a base span."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    r = normalised(text)
    if 1 not in r.changed:
        return out
    taken = sorted(s for spans in base.values() for s in spans)
    for kind, find in (("email", emails), ("card", cards), ("ip", ips), ("phone", phones)):
        for lo, hi in find(r.text):
            if not any(r.changed[lo:hi]) or kind == "email" and not _ENDS_WELL.search(r.text, lo, hi):
                continue
            start, end = r.source(lo, hi)
            at = bisect.bisect_left(taken, (start, start))
            if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start):
                continue
            out[kind].append((start, end))
            bisect.insort(taken, (start, end))
    return out


def find_spans(texts: pa.Array) -> Iterator[tuple[str | None, dict[str, list[Span]], dict[str, list[Span]]]]:
    """Each text with its base spans and its added spans; null and empty texts have none."""
    _, offsets = text_buffers(texts)
    for lo, hi in slices(offsets):
        for text in texts.slice(lo, hi - lo).to_pylist():
            base = base_spans(text or "")
            yield text, base, disguised_spans(text or "", base)


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base counts by kind, base_sha256, all spans, and n_added.

    Null and empty texts have no spans, and base_sha256 of the empty string; a null doc_id stays null.
    Repeated rows are kept; other columns are ignored; an empty table gives an empty result; nothing
    is shuffled.
    """

    def find(batches):
        for b in batches:
            rows = []
            for _, base, more in find_spans(b.column("text")):
                everything = {k: base[k] + more[k] for k in KINDS}
                rows.append((*[len(base[k]) for k in KINDS], hashlib.sha256(listed(base).encode()).hexdigest(), listed(everything), sum(map(len, more.values()))))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(tidy(find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str | None, base: dict[str, list[Span]], more: dict[str, list[Span]]) -> str | None:
    """The text with every identifier replaced by its mask; overlapping spans become one mask."""
    spans = sorted((a, b, k) for found in (base, more) for k in KINDS for a, b in found[k])
    if not spans:
        return text
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out.append(text[done:a])
            out.append(MASKS[kind])
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """`docs` with its columns, identifiers in `text` masked and `n_chars`, if there, counted anew.

    Null texts stay null (and so their n_chars), empty ones empty; repeated rows are kept; an empty
    table gives an empty result; columns of other names pass through.
    """
    names = docs.columns
    rest = [c for c in names if c != "text"]

    def mask(batches):
        for b in batches:
            _, offsets = text_buffers(b.column("text"))
            for lo, hi in slices(offsets):
                s = b.slice(lo, hi - lo)
                texts = pa.array([masked(*found) for found in find_spans(s.column("text"))], pa.string())
                yield pa.RecordBatch.from_arrays([*[s.column(c) for c in rest], texts], [*rest, "text"])

    kept = docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text"))
    done = kept.mapInArrow(tidy(mask), with_field(kept.drop("text").schema, "text", "string"))
    counted = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    return done.select(*[counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])
