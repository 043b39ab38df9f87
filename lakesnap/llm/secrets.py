"""Secret scans: fixed patterns, and strings that compress badly after a dictionary and the code around them.

A string that a reader could guess from its surroundings (an identifier, a path) adds few bytes to the compressed text
before it; a random key adds nearly as many as it has. So each long token near a sensitive word is scored by the bytes
it adds to a zstandard frame primed with identifiers, over its length. Its own repetitions don't count as surroundings,
and a token that is reported is reported wherever it stands. Near is the whole statement or block, on both sides: the
line and lines that go on with it, what any brackets around enclose with the lines on which they open and close, an
armoured key, a section of a configuration file; and the 48 characters before.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesnap.llm.common import claim, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 or more; a shorter run holds no longer match
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST = 20  # characters of a candidate
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Words that make the statement or block that they stand in sensitive.
SENSITIVE = re.compile(r"passw|pass[ \t_-]word|secret|token|api[ \t_-]?key|credential|private[ \t_-]?key|access[ \t_-]?key|auth|bearer|pwd", re.IGNORECASE | re.ASCII)
STEMS = ("pass", "secret", "token", "key", "credential", "auth", "bearer", "pwd")  # one is in each of them
BRACKET = re.compile(r"[{}()\[\]]")
OPENER = {"}": "{", "]": "[", ")": "("}
ARMOUR = re.compile(r"-{4,} ?BEGIN\b[^\n-]*-{4,}(.*?)(?:(-{4,} ?END\b)|(?=-{4,} ?BEGIN\b)|\Z)", re.S)
ARMOUR_PIECE = re.compile(r"(?:\\[nr]|[\s\"',;])+((?:(?!\\[nr])[^\s\"',;])+)")
LINE = re.compile(r"[^\r\n]+")
SECTION = re.compile(r"\s*\[{1,2}[A-Za-z][\w .:\"'-]*\]{1,2}\s*\Z")
#: Lines that go on with the line before: indented, list items, brackets, the rest of a value that was wrapped.
GOES_ON = re.compile(r"[ \t]|- |[{}()\].]|[A-Za-z0-9+/_=.-]{20,}[ \t]*\Z")
#: Lines that the next one goes on with.
OPEN_END = re.compile(r"(?:[\\=:,+({\[]|[A-Za-z0-9+/_=-]{20}\.)[ \t]*\Z")
PIECE = re.compile(r"[A-Za-z0-9+/_=-]+")
DOTTED = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)+")
#: Identifiers that code is full of.
IDENTIFIERS = (
    "abstract access_key api_key application argument array async authorization await boolean bucket buffer callback class client "
    "config configuration connection const constructor container context controller create credential database default delete description "
    "development document element endpoint environment error example exception export extends factory false filename finally "
    "function getElementById handler header identifier implements import instance interface iterator language length localhost "
    "manager message metadata method module namespace number object option override package parameter password path pattern "
    "permission private process production property protected protocol provider public query record repository request resource "
    "response result return schema secret select server service session settings setter source static status storage string "
    "struct subscription super template test throw timeout timestamp token transaction true type undefined update username validate "
    "value variable version virtual void volatile while window ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789"
)
NEAR, AROUND = 48, 1024  # characters: before a candidate, also over the bounds of statements, for a sensitive word; on both sides, for the compressor
BITS = 4.0  # added bits a character from which a candidate is reported


class Novelty:
    def __init__(self, extra: str = ""):
        primer = zstandard.ZstdCompressionDict((extra + " " + IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits(self, around: str, candidate: str) -> float:
        """Bits a character that candidate adds to what stands around it."""
        plain = around.encode("utf-8", "replace")
        return 8 * (len(self.pack.compress(plain + candidate.encode())) - len(self.pack.compress(plain))) / len(candidate)


_novelty: Novelty | None = None


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(base: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a range has no character in common with base spans."""
    starts, ends = [x for x, _, _ in base], list(accumulate((e for _, _, e in base), max))
    return lambda a, b: not (k := bisect_left(starts, b)) or ends[k - 1] <= a


def mixes(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.isalpha() for c in x)


def blocks(text: str) -> list[tuple[int, int]]:
    """Ranges that are one statement or block each: brackets, armoured keys, sections, lines that go on. Some overlap."""
    found = [m.span() for m in ARMOUR.finditer(text)]
    opened, last = {x: [] for x in "{[("}, {}
    for m in BRACKET.finditer(text):
        x, at = m[0], m.start()
        if x in opened:
            opened[x].append(at)
        elif opened[kind := OPENER[x]]:
            start = opened[kind].pop()
            for other in opened.values():  # not closed within
                while other and other[-1] > start:
                    other.pop()
            found.append((start, at + 1))
            last[kind] = start
        elif kind in last and kind != "(":  # the one that seemed to close it stood in a string, perhaps
            found.append((last[kind], at + 1))
    found += [(at, len(text)) for x, left in opened.items() for at in left if x != "(" or text[at - 1 : at].isalnum()]
    section, before = None, None
    for m in LINE.finditer(text):
        if not m[0].strip():
            continue
        if before and (GOES_ON.match(m[0]) or OPEN_END.search(before[0], max(0, len(before[0]) - 64))):
            found.append((before.start(), m.end()))
        if SECTION.match(m[0]):
            found += [(section, before.end())] if section is not None else []
            section = m.start()
        before = m
    return found + ([(section, len(text))] if section is not None else [])


def sensitive_ranges(text: str) -> list[tuple[int, int]]:
    """The statements and blocks, in whole lines, that hold a sensitive word; sorted and apart."""
    words = [m.start() for m in SENSITIVE.finditer(text)]
    lines = [m.span() for m in LINE.finditer(text)]
    starts, ends = [a for a, _ in lines], [b for _, b in lines]
    joined_lines: list[list[int]] = []
    for a, b in sorted(blocks(text)) if words else ():
        one, other = max(0, bisect_right(starts, a) - 1), bisect_left(ends, b)
        if joined_lines and one <= joined_lines[-1][1]:
            joined_lines[-1][1] = max(joined_lines[-1][1], other)
        else:
            joined_lines.append([one, other])
    whole = [(starts[i], ends[min(k, len(ends) - 1)]) for i, k in joined_lines]
    firsts, out = [a for a, _ in whole], []
    for at in words:
        if out and at < out[-1][1]:
            continue
        k = bisect_right(firsts, at) - 1
        out.append(whole[k] if k >= 0 and at < whole[k][1] else lines[bisect_right(starts, at) - 1])
    return out


def beside(text: str, x: str, a: int, b: int) -> str:
    """AROUND characters before a and after b, counted without the occurrences of x, which are taken out."""
    out = []
    for before in (True, False):
        n = AROUND + len(x)  # an occurrence that the outer end of the piece cuts lies in what is cut off again
        while True:
            piece = (text[max(0, a - n) : a] if before else text[b : b + n]).replace(x, "")
            if len(piece) >= AROUND + len(x) or n >= (a if before else len(text) - b):
                break
            n *= 2
        out.append(piece[-AROUND:] if before else piece[:AROUND])
    return "".join(out)


def rest_of_values(text: str, found: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Short pieces of what is reported in part: of dotted strings, and of armoured keys."""
    for m in DOTTED.finditer(text):
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m[0])]
        known = [k for k, x in enumerate(pieces) if x in found]
        if known:
            lo, hi = known[0], known[-1]
            while lo and pieces[lo - 1][1] - pieces[lo - 1][0] < LEAST and mixes(text[slice(*pieces[lo - 1])]):
                lo -= 1
            while hi + 1 < len(pieces) and pieces[hi + 1][1] - pieces[hi + 1][0] < LEAST and mixes(text[slice(*pieces[hi + 1])]):
                hi += 1
            yield from ((a, b) for a, b in pieces[lo : hi + 1] if b - a < LEAST)
    for m in ARMOUR.finditer(text):
        pieces = [p.span(1) for p in ARMOUR_PIECE.finditer(text, *m.span(1)) if PIECE.fullmatch(p[1])]
        known = [k for k, (a, b) in enumerate(pieces) if (a, b) in found or (a - 1, b) in found]  # with the n of an escaped line end
        if known:
            yield from ((a, b) for a, b in (pieces if m[2] else pieces[known[0] : known[-1] + 2]) if (a - 1, b) not in found)


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates outside base spans that mix letters and digits and, at some place in a sensitive statement or block, add
    BITS a character to what stands around them without themselves: each place of theirs, also within longer candidates.
    Dotted strings of short pieces are candidates as a whole."""
    global _novelty
    if not any(x in low for x in STEMS):
        return []
    places: dict[str, list[int]] = {}
    for m in CANDIDATE.finditer(text):
        if mixes(m[0]):
            places.setdefault(m[0], []).append(m.start())
    for m in DOTTED.finditer(text):
        if len(m[0]) >= LEAST and not CANDIDATE.search(m[0]) and mixes(m[0]):
            places.setdefault(m[0], []).append(m.start())
    if not places:
        return []
    _novelty = _novelty or Novelty()
    free, near = outside(base), sensitive_ranges(text)
    firsts = [a for a, _ in near]
    novel: dict[str, list[str]] = {}  # by their first LEAST characters
    for x, starts in places.items():
        seen = set()
        for a in starts:
            b = a + len(x)
            k = bisect_left(firsts, b) - 1
            if not free(a, b) or not (k >= 0 and a < near[k][1] or SENSITIVE.search(text, max(0, a - NEAR), a)):
                continue
            around = beside(text, x, a, b)
            if around not in seen and _novelty.bits(around, x) >= BITS:
                novel.setdefault(x[:LEAST], []).append(x)
                break
            seen.add(around)
    found = set()
    for y, starts in places.items() if novel else ():
        inner = [(k, k + len(x)) for k in range(len(y) - LEAST + 1) for x in novel.get(y[k : k + LEAST], ()) if y.startswith(x, k)]
        found |= {(a + s, a + e) for a in starts for s, e in inner if free(a + s, a + e)}
    if found:
        found |= {(a, b) for a, b in rest_of_values(text, found) if free(a, b)}
    return sorted((a, 3, b) for a, b in found)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by start, then kind. Null counts as the empty text."""
    text = text or ""
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + novel_spans(text, low, base))


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def report_column(text):
    """struct<n_assign, n_access, n_hex, base_sha256, spans, n_novel> of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("secrets")
        for texts in batches:
            rows = []
            for x in texts:
                base, every = spans(x)
                n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
                rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), n[3]))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return scan(text)


def redact_column(text, mark: str = "<secret>"):
    """The text with every span replaced by mark; spans that touch become one. Null stays null."""

    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("secrets")
        for texts in batches:
            yield pd.Series([redacted(x, mark) for x in texts], dtype=object)

    return redact(text)


def redacted(text: str | None, mark: str = "<secret>") -> str | None:
    if not text or not (found := spans(text)[1]):
        return text
    out, at = [], 0
    for a, _, b in found:
        if a >= at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel for each row of docs. One pass, no shuffle; columns
    other than doc_id and text are not read; repeated rows give repeated results."""
    small_batches(docs.sparkSession)
    found = docs.select("doc_id", report_column(docs["text"]).alias("found"))
    return found.select("doc_id", *(f"found.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")))
