"""Secret scans: fixed patterns, plus values in a credential context that would be costly to guess.

The cost of a value is the least number of bits over all its segmentations into words, dates,
repeats (of any unit up to LONGEST_UNIT characters, from any place, any number of times), keyboard
walks (any part of three or more characters) and brute-force spans, found by dynamic programming from
left to right. A value of MIN_BITS or more is reported as kind ``guess``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm._common import by_arrow, documents
from starfold.llm.blocks import texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a shorter run has no longer one inside
HEX = re.compile(r"[0-9a-f]{32,}")
#: A credential's name, a sign or word that gives its value, and the value up to white space or a quote.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret(?:[_\x20-]?key)?|token|credential|auth(?:orization)?|bearer|login|(?:api|access|private)[_\x20-]?key)s?["']?[\x20\t]*(?:[:=]>?|\bis\b|\bbearer\b)[\x20\t]*(?:bearer[\x20\t]+)?(?:"([^"\s]{8,})"|'([^'\s]{8,})'|`([^`\s]{8,})`|["'`]?([^\s"'`<>,;|]{8,}))""", re.ASCII | re.IGNORECASE)
MIN_BITS = 45.0
SEGMENT_BITS = 1.0
#: Characters of a repeat's unit at most; a longer value is cut into parts of LONGEST_VALUE that are guessed one by one.
LONGEST_UNIT, LONGEST_VALUE = 8, 4096

#: Common words of passwords, the most common first, and the rows of a keyboard.
WORDS = """password admin welcome login master dragon monkey letmein shadow sunshine princess football baseball iloveyou
superman batman trustno hello freedom whatever michael jordan secret summer winter spring autumn hunter ranger buster
soccer hockey killer george andrew charlie thomas robert daniel jessica ashley jennifer pepper ginger maggie cheese
computer internet server database system root user test guest default change changeme example sample demo temp public
private access token key apikey auth pass word love money star blue green black white red orange silver golden tiger
eagle falcon phoenix diamond crystal magic music flower cookie banana apple cherry coffee office company service
account mobile phone google amazon microsoft apache oracle mysql postgres redis docker cloud prod production staging
development backup security alpha beta gamma delta omega north south east west january march april june july august""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("@4831!05$7", "aabeliosst")
_LOG = np.log2(np.arange(LONGEST_VALUE + 2).clip(1))
YEAR = r"(?:19|20)\d\d"
DATES = tuple((re.compile(p, re.ASCII), bits) for p, bits in (
    (rf"{YEAR}[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])", log2(365 * 200)),
    (rf"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?{YEAR}", log2(365 * 200)),
    (rf"(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])[-/.]?{YEAR}", log2(365 * 200)),
    (YEAR, log2(200)),
))


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    bits: float = 0.0

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


@lru_cache(4)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, float], int]:
    return {w: log2(k + 2) for k, w in reversed(list(enumerate(words)))}, max(map(len, words), default=0)


@lru_cache(1)
def _next() -> dict[str, str]:
    """Two-character steps of a keyboard walk: to the right +, to the left -."""
    return {a + b: "+" for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a: "-" for row in ROWS for a, b in zip(row, row[1:], strict=False)}


def _pool(value: str) -> float:
    """Bits of a brute-force character: the sizes of the classes that the value draws on."""
    sizes = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[!-/:-@\[-`{-~ ]", 33), (r"[^\x00-\x7f]", 100))
    return log2(max(2, sum(n for p, n in sizes if re.search(p, value))))


def segments(value: str, words: tuple[str, ...] = tuple(WORDS)) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of every word and date in ``value``."""
    ranks, longest = _ranks(words)
    low = value.lower()
    if len(low) != len(value):
        low = value
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 1.5)):
                if form in ranks:
                    upper = sum(a != b for a, b in zip(value[i:j], low[i:j], strict=True))
                    yield i, j, ranks[form] + extra + (0 if not upper else 1 if upper in (1, j - i) else upper)
                    break
    for pattern, bits in DATES:
        for i in range(n):
            if m := pattern.match(value, i):
                yield i, m.end(), bits


def guess_bits(value: str, words: tuple[str, ...] = tuple(WORDS)) -> float:
    """log2 of the guesses that the cheapest segmentation of ``value`` takes; each segment adds SEGMENT_BITS."""
    return sum(_bits(value[k : k + LONGEST_VALUE], words) for k in range(0, len(value), LONGEST_VALUE))


def _bits(value: str, words: tuple[str, ...]) -> float:
    n, each, step = len(value), _pool(value), _next()
    low = value.lower() if len(value.lower()) == n else value
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in segments(value, words):
        ends.setdefault(j, []).append((i, bits))
    best, brute = np.zeros(n + 1), np.inf  # brute: the last segment is a brute-force span
    same, walk, way = [0] * (LONGEST_UNIT + 1), 1, None
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + SEGMENT_BITS) + each
        found = brute
        for i, bits in ends.get(j, ()):
            found = min(found, best[i] + bits + SEGMENT_BITS)
        for size in range(1, min(LONGEST_UNIT, j - 1) + 1):
            same[size] = same[size] + 1 if value[j - 1] == value[j - 1 - size] else 0
            times, least = same[size] // size + 1, 3 if size == 1 else 2
            if times >= least:  # so many units, or fewer, end here
                before = best[j - times * size : j - least * size + 1 : size] + _LOG[least : times + 1][::-1]
                found = min(found, float(before.min()) + each * size + SEGMENT_BITS)
        now = step.get(low[j - 2 : j]) if j > 1 else None
        walk, way = (walk + 1 if now == way else 2, now) if now else (1, None)
        if walk >= 3:
            found = min(found, float((best[j - walk : j - 2] + _LOG[3 : walk + 1][::-1]).min()) + log2(94) + 1 + SEGMENT_BITS)
        best[j] = found
    return float(best[n])


def find(text: str, words: tuple[str, ...] = tuple(WORDS), min_bits: float = MIN_BITS) -> list[Span]:
    """All spans of one text, by start and then kind. Base spans cover their whole match, guessed ones the value."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[m.lastindex].rstrip(".:!?)]}")
        if len(value) >= 8 and (bits := guess_bits(value, words)) >= min_bits:
            found.append(Span("guess", m.start(m.lastindex), m.start(m.lastindex) + len(value), round(bits, 3)))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def scan(docs: DataFrame, words: tuple[str, ...] = tuple(WORDS), min_bits: float = MIN_BITS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id and its spans (kind, start, end, bits).

    Null and empty texts have no spans; null ids and repeated rows are rows like others; long texts
    are scanned whole; an empty table gives no rows; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, ends in texts(batch, "text"):
                rows, at = [], 0
                for end in ends.tolist():
                    rows.append([s.__dict__ for s in find(data[at:end].decode("utf-8"), words, min_bits)])
                    at = end
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,bits:double>>")


def joined(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def sha(spans: list[Span]) -> str:
    return hashlib.sha256(joined([s for s in spans if s.kind != "guess"]).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = text(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), number("guess"))
