"""Repeated byte strings by suffix arrays that are built by linear grouping.

1. Every window of 400 bytes names an anchor, the 64-byte gram in it with the lowest hash.  Equal windows name
   equal anchors, so a repeat can only be among the windows of one anchor; the windows of an anchor
   occurrence stand side by side and form a context.
2. Contexts of an anchor that occurs once are left alone.  The others meet by anchor, each different
   context once, with its number of copies.
3. There a suffix array is built over the phrases of the contexts (cut where a short gram has the lowest hash
   nearby, so equal bytes are cut alike).  Suffixes that share their leading phrases are neighbours; windows whose
   first phrases fall in one run of neighbours are then compared in full.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, first_of_each, given_id, mix, rows_of, stored, union_of

GRAM = 64
STEP = 1 << 20
#: Contexts of one anchor that share a suffix array; fuller anchors are compared window by window.
GROUP = 2048
CUT_GRAM, CUT_SPAN = 8, 56
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of a list of integers, by grouping and without renaming.

    Suffixes are first grouped by their Lyndon prefix: groups are taken in descending order; each
    member points to the nearest suffix before it of a smaller group, and suffixes pointed to
    by equally many members leave their group together, upwards, the most wanted first.  Groups are ranges of
    one array.  Then, in ascending order, each placed suffix places the chain of previous smaller
    suffixes before it at the fronts of their groups.
    """
    n = len(s)
    if n == 0:
        return []
    order = sorted(range(n), key=s.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * n  # end: by start of a group
    start = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            end[start] = k
            start = k
        place[i], group[i] = k, start
    end[start] = n
    smaller = [-1] * n
    top = n
    while top > 0:
        g = group[order[top - 1]]
        wanted: dict[int, int] = {}
        members = order[g:top]
        if top - g > 1:
            members.sort()
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                wanted[p] = wanted.get(p, 0) + 1
        by_number: dict[int, list[int]] = {}
        for p, c in wanted.items():
            by_number.setdefault(c, []).append(p)
        for c in sorted(by_number, reverse=True):
            leaving: dict[int, int] = {}
            for p in by_number[c]:
                old = group[p]
                last = end[old] - 1 - leaving.get(old, 0)
                q, at = order[last], place[p]
                order[at], place[q] = q, at
                order[last], place[p] = p, last
                leaving[old] = leaving.get(old, 0) + 1
            for old, k in leaving.items():
                stop = end[old]
                new = stop - k
                if new > old:
                    end[old] = new
                    end[new] = stop
                    for at in range(new, stop):
                        group[order[at]] = new
        top = g
    out, front = [-1] * n, {}
    done = [False] * n

    def chain(i):
        while i >= 0 and not done[i]:
            g = group[i]
            at = front.get(g, g)
            front[g] = at + 1
            out[at] = i
            done[i] = True
            i = smaller[i]

    chain(n - 1)
    for k in range(n):
        chain(out[k] - 1)
    return out


def shared_phrases(s: list[int], order: list[int]) -> list[int]:
    """Number of leading symbols each suffix of the array shares with the one before it."""
    n = len(s)
    place, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        place[i] = r
    for i in range(n):
        r = place[i]
        if r == 0:
            k = 0
            continue
        j = order[r - 1]
        stop = n - max(i, j)
        while k < stop and s[i + k] == s[j + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return out


def lowest(key: np.ndarray, span: int) -> np.ndarray:
    """Lowest of every `span` neighbours."""
    size, low = 1, key
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _keys(hashes: np.ndarray) -> np.ndarray:
    """Hash above position, so that the lowest is the leftmost of equal ones."""
    return hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, doc_id, h, start, size): the runs of windows that name one anchor; size counts windows."""
    span = length - GRAM + 1

    def run(batches):
        for b in batches:
            doc_id, h, texts = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            made = []
            for at in range(int(offsets[0]) if len(texts) else 0, int(offsets[-1]) if len(texts) else 0, STEP):
                part = data[at:min(at + STEP + length - 1, int(offsets[-1]))]
                n = len(part) - length + 1
                if n <= 0:
                    continue
                roll = Rolling(_TABLE[part])
                grams = roll.windows(GRAM)
                anchor = (lowest(_keys(grams), span) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
                inside = np.ones(n, bool)
                lo, hi = np.searchsorted(offsets, [at + 1, at + len(part) - 1])
                for e in offsets[lo:hi + 1].tolist():
                    inside[max(0, e - length + 1 - at):max(0, e - at)] = False
                edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])) + 1
                first = np.concatenate([[0], edge])
                last = np.concatenate([edge, [n]])
                keep = inside[first]
                first, last = first[keep], last[keep]
                a = anchor[first]
                ctx = mix(roll.span(first, last - 1 + length) ^ mix(((a - first) * 65536 + last - first).astype(np.uint64)))
                who = np.searchsorted(offsets, first + at, side="right") - 1
                made.append((grams[a].view(np.int64), ctx.view(np.int64), doc_id[who], h[who], first + at - offsets[who], last - first))
            if made:
                cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*made)]
                yield pa.RecordBatch.from_arrays(cols, names=["gram", "ctx", "doc_id", "h", "start", "size"])

    return docs.mapInArrow(run, "gram long, ctx long, doc_id long, h long, start long, size long")


def repeated_windows(parts: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each context, marks of the windows that start at two places or more among all of them."""
    sizes = np.array([len(p) for p in parts])
    offset = np.concatenate([[0], np.cumsum(sizes)])
    symbols = _TABLE[np.frombuffer(b"".join(parts), np.uint8)]
    roll = Rolling(symbols)
    # cuts: grams that are lowest in some span that lies within one context
    low = lowest(_keys(roll.windows(CUT_GRAM)), CUT_SPAN)
    reach = CUT_GRAM + CUT_SPAN - 1
    owner = np.repeat(np.arange(len(parts)), sizes)
    own = np.arange(len(low))
    own = own[owner[own] == owner[own + reach - 1]]
    cuts = np.unique(low[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # phrases run from cut to cut; the open end of a context is a symbol of its own
    of = owner[cuts]
    inner = np.flatnonzero(of[1:] == of[:-1])
    phrase = np.zeros(len(cuts), np.int64)
    _, ranks = np.unique(roll.span(cuts[inner], cuts[inner + 1]), return_inverse=True)
    ends = np.setdiff1d(np.arange(len(cuts)), inner)
    phrase[inner] = ranks + len(ends)
    phrase[ends] = np.arange(len(ends))
    text = phrase.tolist()
    order = suffix_array(text)
    shared = np.array(shared_phrases(text, order))
    order = np.array(order)
    # bytes that neighbours share in whole phrases; equal windows share at least this much behind their first safe cut
    least = length - 4 * CUT_SPAN - 2 * CUT_GRAM
    width = cuts[np.minimum(order + shared, len(cuts) - 1)] - cuts[order]
    run_of = np.zeros(len(cuts), np.int64)
    run_of[order] = np.cumsum(np.concatenate([[True], width[1:] < least]))
    # each window goes to the first cut that equal windows are sure to agree on
    counts = sizes - length + 1
    who = np.repeat(np.arange(len(parts)), counts)
    begin = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts) + offset[who]
    cut = np.minimum(np.searchsorted(cuts, begin + CUT_SPAN), len(cuts) - 1)
    key = mix(roll.span(begin, begin + length) ^ mix(run_of[cut].astype(np.uint64)))
    _, inverse = np.unique(key, return_inverse=True)
    number = np.bincount(inverse, weights=np.array(copies)[who])
    twice = number[inverse] > 1
    return np.split(twice, np.cumsum(counts)[:-1])


def _runs(marks: np.ndarray, length: int) -> list[int]:
    """Covered bytes of a context as from, to, from, to ..."""
    step = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    step[1::2] += length - 1
    return step.tolist()


def _judge(rows: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, spans) of contexts with bytes, grouped by anchor and compared through suffix arrays."""
    def run(batches):
        held, size = [], 0

        def flush():
            marks = repeated_windows([r[3] for r in held], [r[2] for r in held], length)
            spans = [_runs(m, length) for m in marks]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()),
                                               pa.array(spans, pa.list_(pa.int64()))], names=["gram", "ctx", "spans"])

        for b in batches:
            for gram, ctx, n, data in zip(*[c.to_pylist() for c in b.columns]):
                if size > STEP and held[-1][0] != gram:
                    yield flush()
                    held, size = [], 0
                if not held or held[-1][1] != ctx or held[-1][0] != gram:
                    held.append((gram, ctx, n, data))
                    size += len(data)
        if held:
            yield flush()

    return rows.repartition("gram").sortWithinPartitions("gram", "ctx").mapInArrow(
        run, "gram long, ctx long, spans array<long>")


def _judge_full(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more contexts than one suffix array should hold: by the hash of each window."""
    def run(batches):
        for b in batches:
            gram, ctx, n = (np.asarray(b.column(k)) for k in range(3))
            who, at, k1, k2 = [], [], [], []
            for i, data in enumerate(b.column(3)):
                symbols = _TABLE[np.frombuffer(data.as_py(), np.uint8)]
                k1.append(Rolling(symbols).windows(length))
                k2.append(Rolling(mix(symbols), 1).windows(length))
                at.append(np.arange(len(k1[-1])))
                who.append(np.full(len(at[-1]), i))
            if not who:
                continue
            who, at, k1, k2 = (np.concatenate(x) for x in (who, at, k1, k2))
            first, count = first_of_each(k1, k2)
            rest = ~first
            k1 = k1.copy()
            k1[rest] = mix(k1[rest] ^ mix(ctx[who[rest]].view(np.uint64) + at[rest].astype(np.uint64)))
            count = np.where(rest, 2, np.maximum(count, n[who]))
            cols = [k1.view(np.int64), k2.view(np.int64), gram[who], ctx[who], at, count]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k1", "k2", "gram", "ctx", "at", "n"])

    w = rows.dropDuplicates(["gram", "ctx"]).mapInArrow(run, "k1 long, k2 long, gram long, ctx long, at long, n long")
    w = w.withColumn("total", F.expr("sum(n) OVER (PARTITION BY k1, k2)")).where("total > 1")
    spans = F.flatten(F.transform(F.collect_list("at"), lambda x: F.array(x, x + length)))
    return w.groupBy("gram", "ctx").agg(spans.alias("spans"))


def _bytes_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, ctx, n, data): the bytes of one occurrence of each context (of each repeated row, if the row is repeated)."""
    def run(batches):
        for b in batches:
            out = []
            for t, spots in zip(b.column(0), b.column(1)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                out += [(s["gram"], s["ctx"], s["n"], data[s["start"]:s["start"] + s["size"] + length - 1]) for s in spots.as_py()]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["gram", "ctx", "n", "data"])

    spots = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("gram", "ctx", "n", "start", "size")).alias("spots"))
    return docs.join(spots.hint("shuffle_hash"), ["doc_id", "h"]).select("text", "spots").mapInArrow(
        run, "gram long, ctx long, n long, data binary")


def covered(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, h, spans): from, to, from, to ... of bytes under a string of `length` bytes that also starts elsewhere."""
    if length < 4 * CUT_SPAN + 2 * CUT_GRAM + GRAM:
        raise ValueError(f"needs strings of at least {4 * CUT_SPAN + 2 * CUT_GRAM + GRAM} bytes")
    seen = stored(contexts(docs, length))
    one = seen.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "h", "start", "size")])
    anchors = one.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where("all > 1")
    wanted = stored(one.join(anchors, "gram").drop("all"))
    spans = _judge(_bytes_of(docs, wanted.where(F.col("kinds") <= GROUP), length), length).unionByName(
        _judge_full(_bytes_of(docs, wanted.where(F.col("kinds") > GROUP), length), length)).where("size(spans) > 0")
    found = seen.join(spans, ["gram", "ctx"]).select("doc_id", "h", F.transform("spans", lambda x: x + F.col("start")).alias("spans"))
    return found.groupBy("doc_id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def report(df: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `df` (doc_id, text).

    A byte goes if a string of `length` bytes over it also starts anywhere else, the same document included.
    NULL texts are empty (no bytes, the digest of nothing); shorter texts keep all; repeated rows are
    copies of each other; a NULL doc_id stays NULL.  Other columns are not read.
    """
    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(1), b.column(2)):
                data = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)
                gone = np.zeros(len(data), bool)
                if spans.is_valid:
                    gone = union_of(np.asarray(spans.values).reshape(-1, 2), len(data))
                starts = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                out.append((len(data), int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 3, pa.string()))]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = rows_of(df)
    out = docs.join(covered(docs, length).hint("shuffle_hash"), ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", given_id())


cloudpickle.register_pickle_by_value(sys.modules[__name__])
