"""Personal data in texts, disguised or not, with offsets in the source text.

Plain identifiers (email, ip, card, phone) are found in the text as it stands. Then transducers
rewrite a copy: look-alike characters, spelled digits, and disguised "at" and "dot" become what
they stand for, and each rewritten stretch remembers where it came from. Identifiers found in the
copy that take in a rewritten stretch are mapped back to source characters and added, unless a plain
span of their kind covers them whole: a plain span is often but a piece of a disguised identifier.
Offsets are code points, ends are exclusive.

Cases: a null or empty text has no spans; overlapping spans are all listed, and redaction puts one
mark over what they cover together; texts of any length take time in proportion
to their length (each pattern starts at most once per run of its characters); repeated rows are
independent. Other columns are passed over by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reposcope.llm.common import table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- plain identifiers -------------------------------------------------------------------
# Possessive quantifiers and start conditions only save time: what they skip cannot match.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_REVERSED_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _REVERSED_LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            floor = found.end()
            yield "email", start, floor
        else:
            floor = max(floor, at)  # what lies before this sign cannot be part of a later match
        at = text.find("@", max(floor, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def plain(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; matches that fail their test are dropped."""
    out = list(emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


# ---- transducers -------------------------------------------------------------------------
#: letters of other scripts that look like the Latin letter under them
LOOKS_LIKE = dict(zip(
    "асеорхуіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aceopxyijsdhqwABEKMHOPCTXYIJSaiKvoptuxABEZHIKMNOPTYX",
))
DASHES, DOTS, SIGNS = "‐‑‒–—−﹣", "․。．·", "﹫"
HIDDEN = "​‌‍⁠﻿­"


def _char_map() -> dict[str, str]:
    out = dict(LOOKS_LIKE) | dict.fromkeys(DASHES, "-") | dict.fromkeys(DOTS, ".") | dict.fromkeys(SIGNS, "@") | dict.fromkeys(HIDDEN, "")
    for c in range(0xFF01, 0xFF5F):  # full-width forms lie at a fixed distance from ASCII
        out.setdefault(chr(c), chr(c - 0xFEE0))
    for c in range(0x100, 0x20000):
        if unicodedata.category(chr(c)) == "Nd":
            out.setdefault(chr(c), str(unicodedata.digit(chr(c))))
        elif unicodedata.category(chr(c)) == "Zs":
            out.setdefault(chr(c), " ")
        elif 0x1D400 <= c <= 0x1D7FF and (plain := unicodedata.normalize("NFKC", chr(c))).isascii():
            out.setdefault(chr(c), plain)  # mathematical letters
    return out | {" ": " "}


CHAR_MAP = _char_map()
_MAPPED = frozenset(CHAR_MAP)

#: fixed values: number words of the four languages of the corpus
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: three or more digits in a row, at least two of them spelled, with "plus" before and "dot" between
_SPELLED = re.compile(
    rf"\b(?:plus[ -]+)?(?:{_DIGIT_WORD}|[0-9])(?:(?:[ ,-]{{1,2}}|[ ]?(?:dot|point|punkt|punto|\.)[ ]?)(?:{_DIGIT_WORD}|[0-9])){{2,}}\b", re.I)
_SPELLED_PART = re.compile(rf"{_DIGIT_WORD}|[0-9]|plus|dot|point|punkt|punto|\.", re.I)
_AT, _DOT = "at|arobase|arroba|klammeraffe|ät", "dot|punkt|point|punto|d0t"
_AT_WORDS, _DOT_WORDS = frozenset(_AT.split("|")), frozenset(_DOT.split("|"))
_BRACKETED = re.compile(rf"[\[({{<][ ]?(?:({_AT}|@)|(?:{_DOT}|\.))[ ]?[\])}}>][ ]?", re.I)
_JOINED = re.compile(r"[_-](?:(at)|dot)[_-][ ]?", re.I)
#: endings that a bare "at ... dot ..." must have, so that prose is left alone
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|eu|se|no|dk|fi|pl|pt|ru|jp|cn|in|br|mx|example|test|invalid"
_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: (?:{_DOT}) [A-Za-z0-9_%+-]+)?( (?:{_AT}) |[ ]?@[ ]?)[A-Za-z0-9-]+(?:(?:[ ](?:{_DOT})[ ]|\.)[A-Za-z0-9-]+)*"
    rf"(?:[ ](?:{_DOT})[ ]|\.)(?:{ENDINGS})\b", re.I)
#: any other ending will do after a spelled "dot", unless the words about it are those of a sentence
_PROSE = "a|an|the|this|that|these|those|each|every|any|some|one|which|what|his|her|its|our|your|their|my|no"
_SENTENCE = frozenset("on|of|or|and|the|that|this|these|those|with|from|for|but|if|when|where|which|who|what|was|were|are|had|has|have|will|would|can|could|than|then|there|they|he|she|you|we|is|as|to|so|by|up|out|into|not".split("|"))
_BARE_ANY = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: (?:{_DOT}) [A-Za-z0-9_%+-]+)?"
    rf"(?: at (?!(?:{_PROSE})(?![A-Za-z0-9-]))(?P<a>[A-Za-z0-9-]++(?:(?: d[o0]t |\.)[A-Za-z0-9-]++)++)"
    rf"|(?: (?:{_AT}) |[ ]?@[ ]?)(?<! at )(?P<b>[A-Za-z0-9-]++(?:(?: (?:{_DOT}) |\.)[A-Za-z0-9-]++)++))", re.I)
#: numbers with a spelled dot between some of them
_SPELLED_DOT = re.compile(rf"[0-9] (?:{_DOT}) [0-9]", re.I)
_FOUR_PARTS = re.compile(rf"(?<![0-9])[0-9]++(?:(?: (?:{_DOT}) |\.)[0-9]++){{3}}", re.I)
_DIGIT_RUN = re.compile(r"[0-9]+")
_DOT_PART = re.compile(rf" (?:{_DOT}) ", re.I)
_DOMAIN_DOT = re.compile(rf" (?:{_DOT}) |\.", re.I)
_AT_HOST = re.compile(rf" (?:{_AT}) [a-z0-9-]+\.[a-z0-9]")
_BARE_PART = re.compile(rf" (?:{_AT}) |[ ]?@[ ]?| (?:{_DOT}) ", re.I)
_SPLIT_AT = re.compile(rf" (?:{_AT}) ", re.I)


class Rewriting:
    """A text with some stretches replaced, and the way back to the original offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.new, self.old, self.edited, at, length = [], [], [], [], 0, 0
        for start, end, put in edits:
            for a, b, piece, changed in ((at, start, text[at:start], False), (start, end, put, True)):
                self.new.append(length)
                self.old.append((a, b))
                self.edited.append(changed)
                parts.append(piece)
                length += len(piece)
            at = end
        self.new.append(length)
        self.old.append((at, len(text)))
        self.edited.append(False)
        self.text = "".join([*parts, text[at:]])

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source offsets of a stretch of the rewritten text, and whether an edit lies within."""
        first, last = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        a, b = self.old[first], self.old[last]
        return (
            a[0] if self.edited[first] else a[0] + start - self.new[first],
            b[1] if self.edited[last] else b[0] + end - self.new[last],
            any(self.edited[first : last + 1]),
        )


# Each transducer first looks, at little cost, for what every match of its pattern holds.
def _letters(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or not (there := _MAPPED.intersection(text)):
        return []
    found = re.finditer("[" + "".join(map(re.escape, there)) + "]", text)
    return [(m.start(), m.end(), CHAR_MAP[m[0]]) for m in found]


_CLASS_OF = {k.encode(): v for k, v in (dict.fromkeys(DIGIT_WORDS, "1") | dict.fromkeys("0123456789", "2") | dict.fromkeys((*_DOT_WORDS, "plus"), "3")).items()}
_THREE = re.compile("[123]{3}")
#: word characters stay, other ASCII bytes separate; some other signs that may adjoin a word
_LOOSE = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_SIGNS = [c.encode() for c in "“”‘’„«»…¿¡"]


def _may_spell(text: str) -> bool:
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_LOOSE)
    if not text.isascii():
        for sign in _SIGNS:
            raw = raw.replace(sign, b" ")
    kinds = "".join([_CLASS_OF.get(w, "0") for w in raw.split()])
    return kinds.count("1") >= 2 and _THREE.search(kinds) is not None


def _spelled(text: str) -> list[tuple[int, int, str]]:
    if not _may_spell(text):
        return []
    out = []
    for m in _SPELLED.finditer(text):
        parts = [p.lower() for p in _SPELLED_PART.findall(m[0])]
        if sum(p in DIGIT_WORDS for p in parts) >= 2:
            out.append((m.start(), m.end(), "".join(DIGIT_WORDS.get(p) or ("+" if p == "plus" else p if p.isdigit() else ".") for p in parts)))
    return out


def _brackets(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        found += _BRACKETED.finditer(text)
    if "_" in text or "-" in text:
        found += _JOINED.finditer(text)
    out, floor = [], 0
    for m in sorted(found, key=lambda m: m.start()):
        start = m.start() - (m.start() > floor and text[m.start() - 1] == " ")
        if start >= floor:
            out.append((start, m.end(), "@" if m[1] or "@" in m[0] else "."))
            floor = m.end()
    return out


def _dotted(text: str) -> list[tuple[int, int, str]]:
    """Spelled dots between four numbers of at most 255."""
    if not _SPELLED_DOT.search(text):
        return []
    found = (m for m in _FOUR_PARTS.finditer(text) if all(map(_small, _DIGIT_RUN.findall(_DOT_PART.sub(".", m[0])))))
    return [(p.start(), p.end(), ".") for m in found for p in _DOT_PART.finditer(text, m.start(), m.end())]


def _may_be_bare(text: str) -> bool:
    if "@" in text:
        return True
    low = text.lower()
    return not _DOT_WORDS.isdisjoint(low.split()) or (" at " in low or " ar" in low or " kl" in low or " ät " in low) and _AT_HOST.search(low) is not None


def _any_ending(text: str) -> Iterator[tuple[int, int]]:
    """Bare addresses with a spelled dot in their domain, up to the last part that can be an ending."""
    for m in _BARE_ANY.finditer(text):
        start, end = m.span("a" if m["a"] else "b")
        dots = list(_DOMAIN_DOT.finditer(text, start, end))
        spelled = next((i for i, d in enumerate(dots) if d[0] != "."), len(dots))
        for i in range(len(dots) - 1, spelled - 1, -1):
            stop = dots[i + 1].start() if i + 1 < len(dots) else end
            last = text[dots[i].end() : stop]
            if len(last) >= 2 and last.isalpha() and last.lower() not in _SENTENCE:
                yield m.start(), stop
                break


def _bare(text: str) -> list[tuple[int, int, str]]:
    if not _may_be_bare(text):
        return []
    found = [m.span() for m in _BARE.finditer(text) if "@" in m[0] or _SPLIT_AT.search(m[0])]
    out, floor = [], 0
    for start, end in sorted([*found, *_any_ending(text)], key=lambda x: (x[0], -x[1])):
        if start < floor:
            continue
        floor = end
        for p in _BARE_PART.finditer(text, start, end):
            put = "@" if "@" in p[0] or _SPLIT_AT.fullmatch(p[0]) else "."
            if p[0] != put:
                out.append((p.start(), p.end(), put))
    return out


TRANSDUCERS = (_letters, _spelled, _brackets, _dotted, _bare)


def rewritten(text: str) -> list[Rewriting]:
    """The chain of rewritings, each over the text that the one before made."""
    chain: list[Rewriting] = []
    for step in TRANSDUCERS:
        now = chain[-1].text if chain else text
        edits = step(now)
        if edits:
            chain.append(Rewriting(now, edits))
    return chain


def _disguised(text: str) -> list[Span]:
    """Identifiers of the rewritten text that take in a rewritten stretch, in source offsets."""
    chain = rewritten(text)
    out = []
    for kind, start, end in plain(chain[-1].text) if chain else ():
        changed = False
        for step in reversed(chain):
            start, end, here = step.source(start, end)
            changed |= here
        if changed and end > start:
            out.append((kind, start, end))
    return out


def _in_order(spans: set[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def whole_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, plain and added spans), each by kind and then by start. Added spans may overlap plain ones."""
    base = plain(text)
    added = [(k, s, e) for k, s, e in _disguised(text) if not any(k == kind and a <= s and e <= b for kind, a, b in base)]
    return base, _in_order({*base, *added}) if added else base


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """As ``whole_spans``, but only with those added spans that lie clear of the plain ones."""
    base, spans_ = whole_spans(text)
    taken = [(s, e) for _, s, e in base]
    known = set(base)
    return base, [x for x in spans_ if x in known or not _overlaps(taken, x[1], x[2])]


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with one mark, of the kind that begins first, over each covered stretch."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


# ---- Spark -------------------------------------------------------------------------------
SPANS_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [whole_spans(t or "") for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64()) for k in KINDS]
        lists = [pa.array([listed(x[i]) for x in both], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *lists], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])


def spans(docs: DataFrame) -> DataFrame:
    """Per document: counts of plain identifiers, ``base`` and ``spans`` as kind:start:end lists."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_finding, f"doc_id {kind}, {SPANS_SCHEMA}")


def _redacting(text_at: int, chars_at: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, whole_spans(t)[1]) for t in batch.column(text_at).to_pylist()]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                kind = batch.schema.field(chars_at).type
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """The documents with marks in place of personal data, and ``n_chars`` (where there) to match."""
    names = docs.columns
    return docs.mapInArrow(_redacting(names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"), "spans")


def digest(spans_: list[Span]) -> str:
    return hashlib.sha256(listed(spans_).encode()).hexdigest()
