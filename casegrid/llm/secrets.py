"""Secret scans (operator 6).

Base spans come from three fixed patterns; the method adds candidate strings whose
Shannon entropy over a sliding window is high for their character class.  Candidates are
maximal runs of ``[A-Za-z0-9+/_=-]`` with at least one window's length; a window's
entropy is kept by incremental counts (one character enters, one leaves), and the
windows above their class's threshold are joined to one span.  Strings of the allow list
(UUIDs, runs inside a URL's host or path, dates, and words joined by separators or capitals, with numbers) are
suppressed.  Words are told from random letters not by their shape but by how frequent their letters are in running text: the
sum over all letters of the logarithm of frequency against chance must not be negative.  A URL ends at white space, a quote or another delimiter, and its user part, query
and fragment are no host or path.  What base spans cover of a candidate is left out, and the rest is tested by itself.

Defined results: a null text counts as empty and has no spans; no span gives the hash of
the empty string; repeated rows give the same result each; very long texts are scanned whole; windows of equal entropy all
count; an empty table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, table

ASSIGN = re.compile(
    "(" + "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits per character that a window of WINDOW characters must reach, by character class: of 24 random characters of the class, 95 % or
#: more have such a window.
THRESHOLDS = {"hex": 3.07, "lower": 3.32, "upper": 3.32, "digit": 2.7, "caseless": 3.45, "mixed": 3.62, "alnum": 3.62, "base64": 3.62}
#: How often each letter comes in a thousand of running text in European languages, roughly; fixed values.
LETTERS = dict(a=80, b=15, c=28, d=43, e=127, f=22, g=20, h=55, i=70, j=3, k=10, l=40, m=25, n=70, o=72, p=20, q=3, r=62, s=64, t=85, u=32, v=10, w=20, x=3, y=15, z=5)
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]{1,8}(?:[-/_][0-9]{1,8})+"),
    re.compile(r"=+|-+|_+|/+|\++"),
)
_TOKEN = r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[A-Z][a-z]+)*[0-9]{0,3}|[0-9]{1,4})"
WORDS = re.compile(rf"[-_/]*{_TOKEN}(?:[-_/]+{_TOKEN})*[-_/]*")
_GAIN = {c: math.log2(n * 26 / sum(LETTERS.values())) for x, n in LETTERS.items() for c in (x, x.upper())}
#: A URL from behind its scheme: user part, host and path, and what follows them.
URL = re.compile(r"://((?:[^\s\"'`<>,;|\\^{}()\[\]/?#@]*@)?)([^\s\"'`<>,;|\\^{}()\[\]?#]*)")
_STEP = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 1)]


def char_class(s: str) -> str:
    """The smallest class that holds every character of ``s``."""
    if s.isdigit():
        return "digit"
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    if s.isalpha():
        return "lower" if s.islower() else "upper" if s.isupper() else "mixed"
    if s.isalnum():
        return "caseless" if s.islower() or s.isupper() else "alnum"
    return "base64"


def wordlike(s: str) -> bool:
    """Words and short numbers joined by separators or capitals, with letters as frequent as in running text."""
    return WORDS.fullmatch(s) is not None and sum(_GAIN.get(c, 0.0) for c in s) >= 0


def entropies(s: str, window: int = WINDOW) -> list[float]:
    """Bits per character of each window of ``s``, by incremental counts: sum n*log2(n) changes in two terms only."""
    count: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        n = count.get(c, 0)
        total += _STEP[n + 1] - _STEP[n]
        count[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = count[old]
            total += _STEP[n - 1] - _STEP[n]
            count[old] = n - 1
        if i >= window - 1:
            out.append(math.log2(window) - total / window)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def hosts_and_paths(text: str) -> list[tuple[int, int]]:
    """(start, end) of the host and path of each URL."""
    return [m.span(2) for m in URL.finditer(text)] if "://" in text else []


def free_parts(m: re.Match, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the base spans leave of a candidate."""
    out, at = [], m.start()
    for a, _, b in taken:
        if a < m.end() and b > at:
            out.append((at, a))
            at = b
    return [(a, b) for a, b in [*out, (at, m.end())] if b - a >= WINDOW]


def entropy_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out, urls = [], None
    for m in CANDIDATE.finditer(text):
        for start, end in free_parts(m, taken):
            s = text[start:end]
            if len(set(s)) < 6 or any(a.fullmatch(s) for a in ALLOW) or wordlike(s):  # fewer than 6 characters reach no threshold
                continue
            urls = hosts_and_paths(text) if urls is None else urls
            at = bisect.bisect_right(urls, (start, len(text))) - 1
            if at >= 0 and start < urls[at][1]:
                continue
            kind = char_class(s)
            high = [i for i, e in enumerate(entropies(s)) if e >= THRESHOLDS[kind]]
            if high:
                out.append((start + high[0], 3, start + high[-1] + WINDOW))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batch: pa.RecordBatch) -> dict:
    out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for text in batch.column("text").to_pylist():
        base = base_spans(text)
        for k, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(s[1] == k for s in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(sorted(base + entropy_spans(text, base))))
    return {"doc_id": batch.column("doc_id")} | out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document the counts and spans (``kind:start:end``, code points, end exclusive) of secrets."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_columns(texts, _scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span replaced by ``mark``; all other columns as they are."""

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            parts, at = [], 0
            base = base_spans(text or "")
            for a, _, b in sorted(base + entropy_spans(text or "", base)):
                if b > at:
                    parts += [text[at : max(a, at)], mark] if a >= at else []
                    at = b
            out.append(None if text is None else "".join(parts) + text[at:])
        return {c: batch.column(c) for c in batch.schema.names} | {"text": out}

    return docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict(run(b), schema=b.schema) for b in bs), docs.schema)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
