"""Suffix-array dedup (operator 7): bytes covered by a 100-byte string that also starts earlier.

Windows of LENGTH bytes are first dealt out by their minimizer, the K-byte string in them
with the smallest hash: equal windows have equal minimizers, and neighbouring windows
share theirs, so a text becomes runs of starts, one row each, with a hash of the bytes
under it (its context).  A context that an earlier run of its minimizer has too repeats
all its windows, and only the first run of each goes on.  A minimizer with one context
can hold no other repeat.  For the rest the contexts' bytes go to the minimizer's group,
where their windows are ordered as suffixes by deep-shallow sorting: multikey quicksort
on superalphabet characters of eight bytes to a shallow depth, then a blind trie for each
group that still has a common prefix.  Windows whose rolling hash no other window of the
group has are left out of the sort, as they can equal none.  The sort works on offsets in
the joined contexts, without copies.

Equal contexts of one minimizer are told by 128 bits (the minimizer's hash and the
context's); all other equality is that of bytes.  A minimizer with more than IN_MEMORY
bytes of different contexts is dealt out again, each context in two parts, by the 60 bytes or more
that all windows of a part share: windows that begin HALF bytes or more before the minimizer, and the others.
Equal parts are repeats, and the rest is sorted as before.  Where even these have more than
IN_MEMORY bytes, their windows are dealt out one by one, which needs no memory
beyond a row; so no group is gathered in one task's memory.

Defined results: a null text counts as empty; null doc_ids come before all others; rows with the
same id and text are one document and each gets its result; rows with the same id (or none) but
another text are documents of their own, ordered by a hash of the text; very long
texts are judged whole; of equal strings the earliest stays; an empty table gives none; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrid.llm.common import slices, table, work_dir, written

LENGTH, K, SHALLOW, HALF = 100, 20, 16, 40
#: Bytes of different contexts of one minimizer that are sorted in memory; beyond it they are dealt out more finely.
IN_MEMORY = 2 << 20
#: Groups are sorted together until they have so many bytes.
TOGETHER = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    """``f`` (np.minimum or np.maximum) over each ``w`` neighbours of ``x``, by doubling."""
    y, m = x, 1
    while 2 * m <= w:
        y = f(y[: len(y) - m], y[m:])
        m *= 2
    n = len(x) - w + 1
    return f(y[:n], y[w - m : w - m + n])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of ``k`` successive bytes: those of 1, 2, 4, ... bytes are doubled, and the ones in ``k`` put together."""
    h, m, parts = b.astype(np.uint64) + np.uint64(1), 1, []
    while m <= k:
        if k & m:
            parts.append((m, h))
        if 2 * m <= k:
            h = h[: len(h) - m] * np.uint64(pow(_BASE, m, 1 << 64)) + h[m:]
        m *= 2
    at, h = k, np.zeros(len(b) - k + 1, np.uint64)
    for m, part in parts:
        at -= m
        h += part[at : at + len(h)] * np.uint64(pow(_BASE, k - at - m, 1 << 64))
    return _mixed(h)


def minimizer_runs(raw: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, end of the starts, minimizer hash, hash of the context, whether the text has that minimizer at two
    neighbouring places) of the runs of windows with one minimizer hash."""
    n = len(raw) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none.astype(bool)
    h = rolling(np.frombuffer(raw, np.uint8), k)
    w = length - k + 1
    least = _sliding(np.minimum, h, w)
    at = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts, ends = np.concatenate([[0], at]), np.concatenate([at, [n]])
    key = least[starts]
    # a string is a minimizer where it is as small as the largest minimum of the windows around it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    chosen = h[h == _sliding(np.maximum, padded, w)]
    # of a context's strings of k bytes the sum of the hashes, and their sum by place
    place = np.arange(len(h), dtype=np.uint64)
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (h, h * place))
    last = ends + w - 1
    plain = one[last] - one[starts]
    by_place = two[last] - two[starts] - plain * starts.astype(np.uint64)
    context = _mixed(plain * np.uint64(_BASE) + _mixed(by_place + np.uint64(1)) + (ends - starts).astype(np.uint64))
    return starts, ends, key.view(np.int64), context.view(np.int64), np.isin(key, chosen[1:][chosen[1:] == chosen[:-1]])


def common_prefix(a: bytes, b: bytes) -> int:
    """Of two strings of the same length."""
    if a == b:
        return len(a)
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7) // 8


def blind_trie(buffer: bytes, starts: list[int], length: int = LENGTH) -> list[int]:
    """For each string of ``length`` bytes of ``buffer``, given by its start, the index of the first equal one.  Inner
    nodes hold only the place where their strings branch; a descent skips what lies between, and one comparison at the
    leaf finds where the new string leaves the trie."""
    first = [0] * len(starts)
    root: list | int = 0  # a leaf is an index, an inner node [depth, {byte: node}]
    for i in range(1, len(starts)):
        s, node = starts[i], root
        while not isinstance(node, int):
            byte = buffer[s + node[0]]
            node = node[1][byte] if byte in node[1] else next(iter(node[1].values()))
        lcp = common_prefix(buffer[starts[node] : starts[node] + length], buffer[s : s + length])
        if lcp == length:
            first[i] = node
            continue
        first[i] = i
        above, node = None, root
        while not isinstance(node, int) and node[0] < lcp:
            above, node = node, node[1][buffer[s + node[0]]]
        if not isinstance(node, int) and node[0] == lcp:
            node[1][buffer[s + lcp]] = i
            continue
        some = node
        while not isinstance(some, int):
            some = next(iter(some[1].values()))
        new = [lcp, {buffer[starts[some] + lcp]: node, buffer[s + lcp]: i}]
        if above is None:
            root = new
        else:
            above[1][buffer[s + above[0]]] = new
    return first


def deep_shallow(buffer: bytes, starts: np.ndarray, groups: list[range] | None = None, shallow: int = SHALLOW) -> np.ndarray:
    """For each window (of LENGTH bytes of ``buffer``, given by its start, in order of rank) the index of the first equal
    one in its group; ``groups`` has the windows of each."""
    raw, eight = np.frombuffer(buffer, np.uint8), np.arange(8)
    chars = [memoryview(raw[starts[:, None] + (d + eight)].view(">u8").ravel().astype(np.uint64)) for d in range(0, shallow, 8)]
    first, at = np.arange(len(starts)), memoryview(np.ascontiguousarray(starts, np.int64))
    stack = [(g, 0) for g in (groups or [range(len(starts))])]
    while stack:
        group, depth = stack.pop()
        while len(group) > 1 and depth < len(chars):
            c = chars[depth]
            pivot = c[group[len(group) // 2]]
            low = [i for i in group if c[i] < pivot]
            high = [i for i in group if c[i] > pivot]
            if len(low) > 1:
                stack.append((low, depth))
            if len(high) > 1:
                stack.append((high, depth))
            if low or high:
                group = [i for i in group if c[i] == pivot]
            depth += 1
        if len(group) > 1:
            for i, j in zip(group, blind_trie(buffer, [at[i] for i in group]), strict=True):
                first[i] = group[j]
    return first


#: ``at`` is the text's hash (31 bits) and the first start in one number, ``span`` the number of starts with two bits for whether
#: the minimizer is there twice and whether the run is known to be a repeat: a row for each run is most of what is moved.
_RUN = "did bigint, at bigint, key bigint, context bigint, span bigint"
_SPAN = "did bigint, th bigint, start bigint, stop bigint"
_TWICE, _KNOWN = 1, 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text.  A run whose context an earlier text of the batch, or an earlier place, has is known to be a
    repeat, and a number of its own takes the place of its key, so that copies don't meet in one task."""
    for batch in batches:
        for part in slices(batch, 4 << 20):
            dids, ths = part.column("did").to_numpy(), part.column("th").to_numpy()
            order = np.lexsort((ths, dids))
            new = np.ones(len(order), bool)  # a repeated row is one document
            new[1:] = (dids[order][1:] != dids[order][:-1]) | (ths[order][1:] != ths[order][:-1])
            order = order[new]
            texts, rows = part.column("text"), []
            for i, j in enumerate(order.tolist()):
                runs = minimizer_runs(texts[j].as_py().encode("utf-8", "surrogatepass"))
                rows.append((np.full(len(runs[0]), i), *runs))
            who, a, b, key, context, twice = (np.concatenate(c) for c in zip(*rows, strict=True))
            alike = np.lexsort((context, key))  # stable: earlier runs first
            known = np.zeros(len(a), bool)
            known[alike[1:]] = (key[alike][1:] == key[alike][:-1]) & (context[alike][1:] == context[alike][:-1])
            did, at = dids[order][who], (ths[order][who] << 32) | a
            own = _mixed(did.view(np.uint64) * np.uint64(_BASE) ^ _mixed(at.view(np.uint64))).view(np.int64)
            span = ((b - a) << 2) | (twice * _TWICE) | (known * _KNOWN)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (did, at, np.where(known, own, key), context, span)], names=["did", "at", "key", "context", "span"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, context, did, at): the repeats (known), and the first run of each context whose minimizer
    has another context or is there twice."""
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["did", "at", "key", "span"])
    key = context = did = at = None  # of the last run that is not known
    held, n = none, 0  # the first run of the last key while it is the only one, and how many contexts that key has

    def out(rows: pa.RecordBatch, known: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("did", "at", "key", "span")), pa.array(np.full(rows.num_rows, known))], names=["did", "at", "key", "span", "known"])

    for batch in batches:
        known = (batch.column("span").to_numpy() & _KNOWN) > 0
        if known.any():
            yield out(batch.filter(pa.array(known)), True)
            batch = batch.filter(pa.array(~known))
        if not batch.num_rows:
            continue
        d, a, k, c, span = (batch.column(x).to_numpy() for x in ("did", "at", "key", "context", "span"))
        before = lambda x, last: np.concatenate([[x[0] == last], x[1:] == x[:-1]])
        same_key = before(k, key)
        same = same_key & before(c, context)
        again = same & before(d, did) & before(a, at)  # a repeated row
        group = np.cumsum(~same_key)
        contexts = np.bincount(group, ~same)
        contexts[0] += n
        if contexts[0] > 1 and held.num_rows:
            yield out(held, False)
            held = none
        twice = (span & _TWICE) > 0
        yield out(batch.filter(pa.array(same & ~again)), True)
        yield out(batch.filter(pa.array(~same & ((contexts[group] > 1) | twice))), False)
        n = int(contexts[-1])
        if not same_key.all():  # the last key has begun here
            first = int(np.flatnonzero(~same_key)[-1])
            held = none if n > 1 or twice[first] else batch.slice(first, 1).select(["did", "at", "key", "span"])
        key, context, did, at = k[-1], c[-1], d[-1], a[-1]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["did", "at", "key", "context"]
    for batch in batches:
        for part in slices(batch, 4 << 20):
            out: dict[str, list] = {n: [] for n in names}
            for d, text, runs in zip(*(part.column(c).to_pylist() for c in ("did", "text", "runs")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    for n, v in zip(names, (d, r["at"], r["key"], raw[(a := r["at"] & _START) : a + (r["span"] >> 2) + LENGTH - 1]), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[n], pa.int64()) for n in names[:-1]), pa.array(out["context"], pa.binary())], names=names)


_START = (1 << 32) - 1


class _Spans:
    """Rows of _SPAN and, for the windows of crowded minimizers, of their contexts."""

    def __init__(self):
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["did", "th", "start", "stop", "context"])


def _sort_groups(out: _Spans, groups: list[list[tuple[int, int, int, bytes]]]) -> None:
    """Groups of different contexts, each of one minimizer: the windows that an earlier context, or an earlier place in it, has."""
    contexts = [c for g in groups for c in sorted(g, key=lambda c: c[:3])]
    if not contexts:
        return
    buffer = b"".join(c[3] for c in contexts)
    size = np.array([len(c[3]) for c in contexts])
    n, begin = size - LENGTH + 1, np.cumsum(size) - size
    who = np.repeat(np.arange(len(contexts)), n)
    starts = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    h = rolling(np.frombuffer(buffer, np.uint8), LENGTH)[starts] ^ _mixed((group[who] + 1).astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(h, kind="stable")
    equal = h[order][1:] == h[order][:-1]
    alike = np.zeros(len(h), bool)
    alike[order[1:][equal]] = alike[order[:-1][equal]] = True
    at = np.flatnonzero(alike)
    if not len(at):
        return
    edges = [0, *(np.flatnonzero(np.diff(group[who[at]])) + 1).tolist(), len(at)]
    first = deep_shallow(buffer, starts[at], [range(a, b) for a, b in pairwise(edges)])
    later = at[first != np.arange(len(at))]
    cut = np.flatnonzero((np.diff(later) != 1) | (np.diff(who[later]) != 0)) + 1
    for a, b in pairwise([0, *cut.tolist(), len(later)] if len(later) else []):
        w = int(who[later[a]])
        did, th, s, _ = contexts[w]
        s += int(starts[later[a]] - begin[w])
        out.rows.append((did, th, s, s + b - a, None))


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, did, at), of different contexts, or by (key, context, did, at): spans of repeated starts.
    Equal contexts that follow each other repeat the first.  A key with more than IN_MEMORY bytes of different contexts hands
    its contexts on instead."""
    out, key, last, before, size, crowded = _Spans(), None, None, None, 0, False
    group: list[tuple[int, int, int, bytes]] = []
    ready: list[list[tuple[int, int, int, bytes]]] = []
    waiting = 0

    for batch in batches:
        for d, at, k, c in zip(*(batch.column(n).to_pylist() for n in ("did", "at", "key", "context")), strict=True):
            if k != key:
                if group:
                    ready.append(group)
                    waiting += size
                key, group, size, crowded, before = k, [], 0, False, None
                if waiting > TOGETHER:
                    _sort_groups(out, ready)
                    ready, waiting = [], 0
            elif (d, at) == last:  # a repeated row
                continue
            last = d, at
            if c == before:
                out.rows.append((d, at >> 32, at & _START, (at & _START) + len(c) - LENGTH + 1, None))
                continue
            before = c
            if crowded:
                out.rows.append((d, at >> 32, at & _START, None, c))
                continue
            group.append((d, at >> 32, at & _START, c))
            size += len(c)
            if size > IN_MEMORY:
                out.rows.extend((g[0], g[1], g[2], None, g[3]) for g in group)
                group, crowded, size = [], True, 0
        if len(out.rows) > 20_000:
            yield out.batch()
    if group:
        ready.append(group)
    _sort_groups(out, ready)
    yield out.batch()


def halves(context: bytes) -> list[tuple[int, bytes, bytes]]:
    """(place, bytes, what all its windows share) of the parts of a context.  Around the first place of the minimizer in them,
    windows that begin HALF bytes or more before it share these, and the others the bytes behind it."""
    h = rolling(np.frombuffer(context, np.uint8), K)
    n, w = len(context) - LENGTH + 1, LENGTH - K + 1
    at = np.flatnonzero(h == h[:w].min())  # all windows of a context have one minimizer
    place = at[np.searchsorted(at, np.arange(n))]
    out = []
    for p in np.unique(place).tolist():
        a, b = np.searchsorted(place, (p, p + 1)).tolist()
        cut = min(max(a, p - HALF + 1), b)
        if a < cut:
            out.append((a, context[a : cut + LENGTH - 1], context[p - HALF : p + K]))
        if cut < b:
            out.append((cut, context[cut : b + LENGTH - 1], context[p : p + K + LENGTH - K - HALF + 1]))
    return out


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the contexts handed on, under a hash of what their windows share."""
    for batch in batches:
        for part in slices(batch.filter(batch.column("context").is_valid()), 1 << 20):
            rows = []
            for d, h, s, c in zip(*(part.column(n).to_pylist() for n in ("did", "th", "start", "context")), strict=True):
                rows += [(d, (h << 32) | (s + o), int.from_bytes(hashlib.blake2b(shared, digest_size=8).digest(), "little", signed=True), piece) for o, piece, shared in halves(c)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["did", "at", "key", "context"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the contexts handed on."""
    for batch in batches:
        for part in slices(batch.filter(batch.column("context").is_valid()), 1 << 18):
            rows = [(d, h, s + o, c[o : o + LENGTH]) for d, h, s, c in zip(*(part.column(n).to_pylist() for n in ("did", "th", "start", "context")), strict=True) for o in range(len(c) - LENGTH + 1)]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["did", "th", "start", "window"])


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans without the contexts handed on."""
    for batch in batches:
        yield batch.filter(batch.column("context").is_null()).select(["did", "th", "start", "stop"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (window, did, th, start): all but the first of each window."""
    last = None
    for batch in batches:
        rows = []
        for d, h, s, w in zip(*(batch.column(n).to_pylist() for n in ("did", "th", "start", "window")), strict=True):
            if w == last:
                rows.append((d, h, s, s + 1))
            last = w
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["did", "th", "start", "stop"])


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text, doc_id of each row.  Rows that share an id are told apart by 31 bits of the text's hash, as every run
    and context carries them; rows without id by 62 bits more, in place of the id."""
    text = F.coalesce("text", F.lit(""))
    id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)) + F.xxhash64(text, F.lit(1)).bitwiseAND((1 << 62) - 1))
    return docs.select(id_.alias("did"), F.xxhash64(text).bitwiseAND(0x7FFFFFFF).alias("th"), text.alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """did, th, start, stop: starts of windows of ``texts`` (did, th, text) that also start earlier."""
    runs = texts.filter(F.octet_length("text") >= LENGTH).select("did", "th", "text").mapInArrow(_runs, _RUN)
    shared = runs.repartition("key").sortWithinPartitions("key", "context", "did", "at").mapInArrow(_shared, "did bigint, at bigint, key bigint, span bigint, known boolean")
    shared = written(shared, f"{work_dir(texts.sparkSession)}/shared")  # read twice
    th, start = F.shiftright("at", 32).alias("th"), F.col("at").bitwiseAND(_START)
    known = shared.filter("known").select("did", th, start.alias("start"), (start + F.shiftright("span", 2)).alias("stop"))
    per_text = shared.filter("not known").groupBy("did", th).agg(F.collect_set(F.struct("at", "span", "key")).alias("runs"))
    contexts = texts.join(per_text, ["did", "th"]).select("did", "text", "runs").mapInArrow(_contexts, "did bigint, at bigint, key bigint, context binary")
    # both readers of an exchange by document take all of its columns, so it is made once
    found = contexts.repartition("key").sortWithinPartitions("key", "did", "at").mapInArrow(_repeats, _SPAN + ", context binary").repartition("did", "th")
    parts = found.mapInArrow(_halved, "did bigint, at bigint, key bigint, context binary").repartition("key").sortWithinPartitions("key", "context", "did", "at")
    finer = parts.mapInArrow(_repeats, _SPAN + ", context binary").repartition("did", "th")
    windows = finer.mapInArrow(_windows, "did bigint, th bigint, start bigint, window binary").repartition("window").sortWithinPartitions("window", "did", "th", "start")
    spans = [x.mapInArrow(_plain, _SPAN) for x in (found, finer)]
    return known.unionByName(spans[0]).unionByName(spans[1]).unionByName(windows.mapInArrow(_later, _SPAN))


def remove(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, removed bytes, maximal removed runs; spans are of starts."""
    if not spans:
        return raw, 0, 0
    change = np.zeros(len(raw) + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[min(len(raw), b + LENGTH - 1)] -= 1
    gone = np.cumsum(change)[:-1] > 0
    edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), edges


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each document."""
    texts = keyed(docs)
    spans = repeated_spans(texts).groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    both = texts.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for b in slices(batch, 4 << 20):
                raws = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
                got = [remove(r, [(s["start"], s["stop"]) for s in spans or ()]) for r, spans in zip(raws, b.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in raws], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got]), pa.array([g[0] for g in got], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
