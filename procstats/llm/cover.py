"""Repeated passages of words, found by anchors at difference-cover positions.

For every two positions i and j there is a shift below the period that takes both to cover positions (the
differences of a difference cover reach every residue).  So if the same window of words stands at two
places, the same anchor (the words left of the window after the shift) stands at two cover positions.
Hashing windows at cover positions only therefore finds a witness of every repeat; windows around
the witnesses are then compared in full.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Rolling, first_of_each, given_id, mix, row_key, rows_of, union_of

PERIOD = 21
#: A perfect difference set modulo 21: every residue is a difference of two members.
COVER = (0, 1, 4, 14, 16)
CHUNK = 200_000
BUCKETS_PER_TASK = 2
#: Repeated positions a task holds before it passes them on.
HELD = 2_000_000


class _Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _chunks(texts, words, known):
    """Runs of whole texts of about CHUNK words: (first text, hashes of all words, where each text starts)."""
    first, parts, ends, n = 0, [], [0], 0
    for k, t in enumerate(texts):
        w = words.findall(t)
        parts.append(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)))
        n += len(w)
        ends.append(n)
        if n >= CHUNK:
            yield first, np.concatenate(parts), np.array(ends)
            first, parts, ends, n = k + 1, [], [0], 0
    if parts:
        yield first, np.concatenate(parts), np.array(ends)


PACKED = "bucket int, docs binary, who binary, pos binary, key binary, key2 binary, n binary"
NAMES = ["bucket", "docs", "who", "pos", "key", "key2", "n"]
KINDS = [pa.int32(), *[pa.binary()] * 6]


def _narrow(x: np.ndarray) -> bytes:
    """Integers below 2^32 as bytes, two each where all of them fit and four otherwise; the first byte says which."""
    size = 2 if x.max(initial=0) < 65536 else 4
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"u{packed[0]}", offset=1).astype(np.int64)


def _pack(bucket, docs, who, pos, key, key2, n) -> pa.RecordBatch:
    """One row a bucket: its positions as packed columns, `who` being an index into the row's own (doc_id, h) list.

    A position takes about half of what a row of its own would take in a shuffle.
    """
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    rows = []
    for b, idx in zip(found.tolist(), np.split(order, starts[1:])):
        used, local = np.unique(who[idx], return_inverse=True)
        rows.append((b, docs[used].tobytes(), _narrow(local), _narrow(pos[idx]),
                     *[b"" if x is None else x[idx].tobytes() for x in (key, key2, n)]))
    cols = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS)], names=NAMES)


def _emit(docs, who, pos, key, key2, buckets: int) -> pa.RecordBatch:
    """Positions of one batch, dealt by key.  The first of equal keys carries their number; later ones are known
    to repeat, so they get a key of their own and number 2, which spreads a frequent key over all tasks."""
    keys = [key] if key2 is None else [key, key2]
    first, count = first_of_each(*keys)
    rest = ~first
    key = key.copy()
    key[rest] = mix(key[rest] ^ mix(docs[who[rest], 1].view(np.uint64) + pos[rest].astype(np.uint64) * np.uint64(2654435761)))
    count[rest] = 2
    return _pack((key % np.uint64(buckets)).astype(np.int32), docs, who, pos, key, key2, np.minimum(count, 2).astype(np.uint8))


def _unpack(held):
    """(docs, who, pos, key, key2, n) of the rows of one bucket laid together."""
    docs = [np.frombuffer(r[1], np.int64).reshape(-1, 2) for r in held]
    shift = np.cumsum([0] + [len(d) for d in docs])
    who = np.concatenate([_wide(r[2]) + s for r, s in zip(held, shift)])
    pos = np.concatenate([_wide(r[3]) for r in held])
    cols = [np.concatenate([np.frombuffer(r[k], t) for r in held]) for k, t in ((4, np.uint64), (5, np.uint32), (6, np.uint8))]
    return np.concatenate(docs), who, pos, *cols


def _by_bucket(batches):
    held = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, h, runs) of the positions whose key is met at least twice: runs of neighbours as from, to, from, to ...

    Keys of a bucket meet in one task, then the positions of a document do.
    """
    def count(batches):
        names, owners, places, shift, size = [], [], [], 0, 0

        def flush():
            docs, who, pos = np.concatenate(names), np.concatenate(owners), np.concatenate(places)
            docs, same = np.unique(docs, axis=0, return_inverse=True)
            target = (mix(docs[:, 0].view(np.uint64) ^ mix(docs[:, 1].view(np.uint64))) % np.uint64(buckets)).astype(np.int32)
            who = same.ravel()[who]
            return _pack(target[who], docs, who, pos, None, None, None)

        for held in _by_bucket(batches):
            docs, who, pos, key, key2, n = _unpack(held)
            order = np.lexsort((key2, key)) if len(key2) else np.argsort(key, kind="stable")
            new = np.ones(len(key), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            if len(key2):
                new[1:] |= key2[order][1:] != key2[order][:-1]
            group = np.cumsum(new) - 1
            twice = np.zeros(len(key), bool)
            twice[order] = np.bincount(group, n[order])[group] > 1
            names.append(docs)
            owners.append(who[twice] + shift)
            places.append(pos[twice])
            shift, size = shift + len(docs), size + len(owners[-1])
            if size >= HELD:
                yield flush()
                names, owners, places, shift, size = [], [], [], 0, 0
        if size:
            yield flush()

    def gather(batches):
        for held in _by_bucket(batches):
            docs, who, pos, *_ = _unpack(held)
            docs, same = np.unique(docs, axis=0, return_inverse=True)
            who = same.ravel()[who]
            order = np.lexsort((pos, who))
            who, pos = who[order], pos[order]
            fresh = np.ones(len(who), bool)
            fresh[1:] = (who[1:] != who[:-1]) | (pos[1:] > pos[:-1] + 1)
            start = np.flatnonzero(fresh)
            stop = np.append(start[1:], len(who)) - 1
            runs = np.stack([pos[start], pos[stop] + 1], 1).ravel()
            owner, begin = np.unique(who[start], return_index=True)
            offsets = np.append(2 * begin, len(runs)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs[owner, 0]), pa.array(docs[owner, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs))],
                                             names=["doc_id", "h", "runs"])

    # buckets are some numbers per task, so tasks get equal shares
    parts = max(1, buckets // BUCKETS_PER_TASK)
    once = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, PACKED)
    return once.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "doc_id long, h long, runs array<long>")


def anchors(docs: DataFrame, length: int, period: int, cover: tuple[int, ...], buckets: int) -> DataFrame:
    """The hashed anchors at the cover positions of every document, packed."""
    size = length - period + 1

    def run(batches):
        words, known = re.compile(WORD), _Words()
        is_cover = np.zeros(period, bool)
        is_cover[list(cover)] = True
        for b in batches:
            names = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1)
            who, pos, key = [], [], []
            for first, hashes, starts in _chunks((t.as_py() for t in b.column(2)), words, known):
                lengths = np.diff(starts)
                fit = np.maximum(lengths - size + 1, 0) * (lengths >= length)
                owner = np.repeat(np.arange(len(fit)), fit)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(fit) - fit, fit)
                take = is_cover[at % period]
                owner, at = owner[take], at[take]
                begin = starts[owner] + at
                key.append(Rolling(hashes).span(begin, begin + size))
                who.append(owner + first)
                pos.append(at)
            if key:
                yield _emit(names, np.concatenate(who), np.concatenate(pos), np.concatenate(key), None, buckets)

    return docs.mapInArrow(run, PACKED)


def windows(found: DataFrame, length: int, period: int, buckets: int) -> DataFrame:
    """The windows that a repeated anchor witnesses, hashed in full to 96 bits, packed."""
    def run(batches):
        words, known = re.compile(WORD), _Words()
        for b in batches:
            names = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1)
            spots = [np.asarray(x.values).reshape(-1, 2) for x in b.column(3)]
            who, pos, k1, k2 = [], [], [], []
            for first, hashes, starts in _chunks((t.as_py() for t in b.column(2)), words, known):
                begins = []
                for i in range(len(starts) - 1):
                    p = spots[first + i]
                    n = starts[i + 1] - starts[i] - length + 1
                    at = np.flatnonzero(union_of(np.stack([np.maximum(p[:, 0] - period + 1, 0), p[:, 1]], 1), int(starts[i + 1] - starts[i]))[:max(n, 0)])
                    begins.append(at)
                    who.append(np.full(len(at), first + i))
                    pos.append(at)
                begin = np.concatenate([s + a for s, a in zip(starts, begins)])
                k1.append(Rolling(hashes).span(begin, begin + length))
                k2.append((Rolling(mix(hashes), 1).span(begin, begin + length) >> np.uint64(32)).astype(np.uint32))
            if k1:
                yield _emit(names, *[np.concatenate(x) for x in (who, pos, k1, k2)], buckets)

    return found.mapInArrow(run, PACKED)


def repeats(docs: DataFrame, length: int = 35, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """docs (doc_id, h, text, ...) with runs, the starts of windows of `length` words that also start elsewhere (NULL: none)."""
    if period > length or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover of a period within the window")
    kept = docs.columns
    buckets = BUCKETS_PER_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = _repeated(anchors(docs.select("doc_id", "h", "text"), length, period, cover, buckets), buckets)
    # all columns in both joins, so that both read one exchange of the texts
    found = docs.join(spots.hint("shuffle_hash"), ["doc_id", "h"]).select("doc_id", "h", "text", "runs", *kept[3:])
    starts = _repeated(windows(found, length, period, buckets), buckets)
    return docs.join(starts.hint("shuffle_hash"), ["doc_id", "h"], "left").select("doc_id", "h", "text", "runs", *kept[3:])


def _removed(starts, n: int, length: int) -> np.ndarray:
    if starts is None:
        return np.zeros(n, bool)
    p = np.asarray(starts.values).reshape(-1, 2)
    return union_of(np.stack([p[:, 0], p[:, 1] + length - 1], 1), n)


def report(df: DataFrame, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `df` (doc_id, text).

    A word goes if a window of `length` words that covers it also starts elsewhere, in the same document or
    another.  NULL and empty texts have no words (the digest of nothing); texts shorter than a window
    keep all; repeated rows are copies of each other; a NULL doc_id stays NULL.  Other columns are not read.
    """
    def run(batches):
        words = re.compile(WORD)
        for b in batches:
            out = []
            for t, starts in zip(b.column(2), b.column(3)):
                w = words.findall(t.as_py())
                gone = _removed(starts if starts.is_valid else None, len(w), length)
                kept = w if not gone.any() else [x for x, g in zip(w, gone.tolist()) if not g]
                out.append((len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()))
            n, gone, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = repeats(rows_of(df), length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", given_id())


def strip(df: DataFrame, length: int = 35) -> DataFrame:
    """`df` with the repeated words cut out of its texts; what stands between kept words stays as it was.

    All columns stay (n_chars, if there is one, follows a text that changed); a NULL text stays NULL.  Rows
    never go, so a text may become empty.
    """
    own = [c for c in df.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(own)])
    ids = [c.alias(n) for c, n in zip(row_key(), ("doc_id", "h"))]
    docs = df.select(*ids, F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))

    def run(batches):
        words = re.compile(WORD)
        for b in batches:
            texts, changed = [], []
            for t, starts in zip(b.column(0), b.column(1)):
                text = t.as_py()
                if starts.is_valid:
                    spans = [m.span() for m in words.finditer(text)]
                    gone = _removed(starts, len(spans), length).tolist()
                    # a word leaves with the white space after it
                    cuts = [s for s, _ in spans[1:]] + [len(text)]
                    text = text[:spans[0][0]] + "".join(text[s:c] for (s, _), c, g in zip(spans, cuts, gone) if not g)
                texts.append(text)
                changed.append(starts.is_valid)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(changed, pa.bool_()), b.column(2)], names=["text", "changed", "rest"])

    kind = docs.schema["rest"].dataType.simpleString()
    new = repeats(docs, length).select("text", "runs", "rest").mapInArrow(run, f"text string, changed boolean, rest {kind}")
    out = {c: F.col(f"rest._{k}") for k, c in enumerate(own)} | {"text": F.when(~F.col("rest._null"), F.col("text"))}
    if "n_chars" in own:
        out["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(out["n_chars"]).cast(df.schema["n_chars"].dataType)
    return new.select(*[out[c].alias(c) for c in df.columns])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
