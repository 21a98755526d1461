"""Byte-level BPE encoding and decoding (operator 10).

Method: overlapping chunk encoding.  A text is cut into chunks that overlap, each chunk
is pre-tokenised on its own, and the chunks' boundaries are stitched where both sides
agree (the pattern looks ahead only, so two scans that share one boundary agree from
there on).  Then the pieces are encoded by the merge ranks and decoding concatenates the
raw bytes of the ids.  Texts of more than one chunk (CHUNK characters) are dealt out by chunk, so a very
long text is pre-tokenised and encoded by many tasks; stitching and joining see one text at a time.

Defined results: a null text counts as empty; an empty text has no tokens, and both of
its hashes are those of no bytes; a repeated row is encoded again; an empty table gives
an empty result; of two pairs with one rank the left one merges first; columns other than doc_id and text are ignored.  A
null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import map_columns, table

CHUNK, OVERLAP = 1 << 16, 512
#: Pieces of up to SHORT bytes are merged by scanning, and remembered by a worker: two generations of MEMORY at most.
SHORT, MEMORY = 64, 150_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: its bytes, of which the neighbours that make the token of the least rank are joined again and
    again, the leftmost of equal ones first."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    parts, get, none = [piece[i : i + 1] for i in range(len(piece))], ranks.get, len(ranks)
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of the pairs, in n log n steps."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts here; end is 0 where none does
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        middle = end[i]
        if not middle or middle >= e or end[middle] != e:
            continue  # one of the two has been joined with another
        end[i], end[middle] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:e])) is not None:
            heappush(heap, (r, j, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes pre-token pieces by merge ranks; one per worker and vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.tokens, self.names = [b""] * size, list(map(str, range(size)))
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.pieces = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def piece(self, s: str) -> bytes:
        """The ids as four bytes each."""
        found = self.before.get(s)
        if found is None:
            found = array("I", merge(s.encode(), self.ranks)).tobytes()
        if len(self.known) >= MEMORY:
            self.known, self.before = {}, self.known
        if len(s) <= SHORT:
            self.known[s] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def ends(self, text: str, start: int = 0) -> list[int]:
        """Where the pieces of text[start:] end, relative to the text."""
        return [m.end() for m in self.pieces.finditer(text, start)]


@lru_cache(4)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def chunk_starts(n: int, chunk: int = CHUNK) -> list[int]:
    return list(range(0, max(n, 1), chunk))


def chunk_ends(enc: Encoder, text: str, start: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Boundaries that a scan from ``start`` finds, over the chunk and its overlap.  The last two pieces
    are left out unless the text ends there: what follows may still change them."""
    part = text[start : start + chunk + overlap]
    ends = [start + e for e in enc.ends(part)]
    return ends if start + len(part) >= len(text) else ends[:-2]


def stitched(enc: Encoder, text: str, chunks: list[list[int]], chunk: int = CHUNK) -> list[int]:
    """One list of boundaries from those of the chunks, as a scan of the whole text finds them."""
    ends: list[int] = list(chunks[0])
    for k in range(1, len(chunks)):
        there, last = chunks[k], k * chunk
        both = set(there).intersection(ends[-(2 * OVERLAP + 8) :] if ends else ())
        if both:  # the scans agree from the first common boundary on
            at = min(both)
        else:  # no common boundary: scan on from the last sure one until the next chunk's boundaries are met
            at, found = ends[-1] if ends else 0, set(there)
            for m in enc.pieces.finditer(text, at):
                at = m.end()
                ends.append(at)
                if at in found:
                    break
        while ends and ends[-1] > at:
            ends.pop()
        ends.extend(e for e in there if e > at)
    if (ends[-1] if ends else 0) < len(text):
        ends.extend(m.end() for m in enc.pieces.finditer(text, ends[-1] if ends else 0))
    return ends


def encode_pieces(enc: Encoder, pieces: list[str]) -> tuple[int, str, bytes]:
    """(number of ids, ids joined by one space, decoded bytes)"""
    piece = enc.piece
    ids = array("I", b"".join([enc.known.get(p) or piece(p) for p in pieces])).tolist()
    return len(ids), " ".join(map(enc.names.__getitem__, ids)), enc.decode(ids)


def _whole(ranks_path: str, pattern: str):
    def run(batch: pa.RecordBatch) -> dict:
        enc = encoder(ranks_path, pattern)
        n, ids, back = [], [], []
        for text in batch.column("text").to_pylist():
            k, joined, raw = encode_pieces(enc, enc.pieces.findall(text))
            n.append(k), ids.append(joined), back.append(raw)
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids": ids, "decoded": back}

    return run


def _digested(ranks_path: str, pattern: str):
    whole = _whole(ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> dict:
        got = whole(batch)
        return {
            "doc_id": got["doc_id"],
            "n_tokens": got["n_tokens"],
            "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in got["ids"]],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in got["decoded"]],
        }

    return run


def _long(docs: DataFrame, ranks_path: str, pattern: str, digest: bool) -> DataFrame:
    """Texts of more than one chunk: chunk rows are pre-tokenised apart, stitched per text, and encoded apart again."""

    def cut(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": [], "row": [], "th": [], "n": [], "k": [], "part": []}
        for d, r, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "th", "text")), strict=True):
            for k, s in enumerate(chunk_starts(len(text))):
                for name, v in zip(out, (d, r, h, len(text), k, text[s : s + CHUNK + OVERLAP]), strict=True):
                    out[name].append(v)
        return out

    def scan(batch: pa.RecordBatch) -> dict:
        enc = encoder(ranks_path, pattern)
        ends = []
        for n, k, part in zip(batch.column("n").to_pylist(), batch.column("k").to_pylist(), batch.column("part").to_pylist(), strict=True):
            got = enc.ends(part)
            ends.append([k * CHUNK + e for e in (got if k * CHUNK + len(part) >= n else got[:-2])])
        return {c: batch.column(c) for c in ("doc_id", "row", "th", "k", "part")} | {"ends": ends}

    def stitch(t):
        """The pieces of each chunk: those that begin in it."""
        enc = encoder(ranks_path, pattern)
        rows = sorted(t.select(["doc_id", "row", "th", "k", "part", "ends"]).to_pylist(), key=lambda r: r["k"])
        text = "".join(r["part"][:CHUNK] for r in rows)
        ends = stitched(enc, text, [r["ends"] for r in rows])
        out, i, at = [], 0, 0
        for r in rows:
            first, begin = i, at
            while i < len(ends) and at < (r["k"] + 1) * CHUNK:
                at, i = ends[i], i + 1
            out.append(r | {"part": text[begin:at], "ends": [e - begin for e in ends[first:i]]})
        return pa.Table.from_pylist(out, schema=t.select(["doc_id", "row", "th", "k", "part", "ends"]).schema)

    def encoded(batch: pa.RecordBatch) -> dict:
        enc = encoder(ranks_path, pattern)
        got = [encode_pieces(enc, [part[a:b] for a, b in zip([0, *ends], ends, strict=False)]) for part, ends in zip(batch.column("part").to_pylist(), batch.column("ends").to_pylist(), strict=True)]
        return {c: batch.column(c) for c in ("doc_id", "row", "th", "k")} | {"n": [g[0] for g in got], "ids": [g[1] for g in got], "raw": [g[2] for g in got]}

    def join(t):
        rows = sorted(t.select(["k", "n", "ids", "raw"]).to_pylist(), key=lambda r: r["k"])
        ids, raw = " ".join(r["ids"] for r in rows if r["n"]), b"".join(r["raw"] for r in rows)
        cols = {"ids_sha256": [hashlib.sha256(ids.encode()).hexdigest()], "decoded_sha256": [hashlib.sha256(raw).hexdigest()]} if digest else {"ids": [ids], "decoded": [raw]}
        return pa.table({"doc_id": pa.array([t.column("doc_id")[0].as_py()], pa.int64()), "n_tokens": [sum(r["n"] for r in rows)]} | cols)

    # a row is one text, whatever rows repeat it: a group holds one text's chunks
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("th"), "text")
    cut_ = map_columns(rows, cut, "doc_id bigint, row bigint, th bigint, n bigint, k int, part string").repartition("row", "th", "k")
    pieces = "doc_id bigint, row bigint, th bigint, k int, part string, ends array<bigint>"
    chunks = map_columns(cut_, scan, pieces).groupBy("row", "th").applyInArrow(stitch, pieces).repartition("row", "th", "k")
    parts = map_columns(chunks, encoded, "doc_id bigint, row bigint, th bigint, k int, n bigint, ids string, raw binary")
    return parts.groupBy("row", "th").applyInArrow(join, SCHEMA[digest])


SCHEMA = {False: "doc_id bigint, n_tokens bigint, ids string, decoded binary", True: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"}


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and decoded (bytes) of each text; with ``digest``
    their SHA-256 in place of them."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    run = (_digested if digest else _whole)(ranks_path, pattern)
    short = map_columns(texts.filter(F.length("text") <= CHUNK), run, SCHEMA[digest])
    return short.unionByName(_long(texts.filter(F.length("text") > CHUNK), ranks_path, pattern, digest))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
