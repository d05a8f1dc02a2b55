"""Byte-level BPE by a rank queue that is a hierarchical bitmap.

One bucket per merge rank holds the positions (nodes of a linked list of
symbols) where that merge is possible.  A bitmap over the ranks, with summary levels of
64 bits a word, finds the lowest non-empty rank by find-first-set; entries whose pair has
changed meanwhile are skipped when they are met.  A pre-token of n bytes takes
O(n log n) steps however long it is.  Pre-tokens not met before share a queue, so that a
rank is looked for once for all of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunks and pre-tokens of a generation that a worker remembers.
CACHE_ENTRIES = 500_000
#: Chunks longer than this are not remembered.
KEY_CHARS = 64
#: Rows that are handed on at a time, characters that are encoded at a time, bytes of pre-tokens that share a queue (one text or pre-token may exceed them).
ROWS = 500
BATCH_CHARS = 1 << 20
MERGE_BYTES = 1 << 18
#: In place of a rank or an id.
NONE = -1
#: The white space of the Unicode standard, as the pre-token pattern means it (fixed values).
SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class RankQueue:
    """Positions by merge rank; gives up the lowest rank that holds any, with its positions in order.

    The bitmap has two levels: words of 64 ranks, and a summary with a bit for each word in use.
    """

    __slots__ = ("buckets", "words", "summary")

    def __init__(self, ranks: np.ndarray):
        """`ranks` by position, NONE where there is no merge."""
        at = np.flatnonzero(ranks != NONE)
        order = at[np.argsort(ranks[at], kind="stable")]
        used, starts = np.unique(ranks[order], return_index=True)
        edges, places = [*starts.tolist(), len(order)], order.tolist()
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0
        for k, rank in enumerate(used.tolist()):
            self.put(rank, places[edges[k]:edges[k + 1]])

    def put(self, rank: int, positions: list[int]) -> None:
        """Positions of a rank whose bucket may be empty."""
        held = self.buckets.get(rank)
        if held is not None:
            held += positions
            return
        self.buckets[rank] = positions
        word = rank >> 6
        old = self.words.get(word, 0)
        self.words[word] = old | 1 << (rank & 63)
        if not old:
            self.summary |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        summary = self.summary
        word = (summary & -summary).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        self.words[word] = bits = bits ^ low
        if not bits:
            self.summary = summary ^ 1 << word
        rank = word << 6 | low.bit_length() - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Merger:
    """Merges pre-tokens by the ranks of their byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.full(1 << 16, NONE, np.int64)
        for text, rank in ranks.items():
            if len(text) == 2:
                self.double[text[0] << 8 | text[1]] = rank

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each of the non-empty pre-tokens, which share one queue.

        No merge crosses an edge, and the lowest (rank, position) of all pieces is also the lowest
        of its own piece, so each piece takes the steps that it would take alone.
        """
        text = b"".join(pieces)
        n = len(text)
        stops = np.cumsum([len(p) for p in pieces])
        edge = bytearray(n + 1)  # where a piece starts, and the end
        edge[0] = 1
        for stop in stops.tolist():
            edge[stop] = 1
        symbols = np.frombuffer(text, np.uint8)
        first = np.full(n, NONE, np.int64)
        first[:-1] = self.double[symbols[:-1].astype(np.int64) << 8 | symbols[1:]]
        first[stops - 1] = NONE
        queue = RankQueue(first)
        pair = first.tolist()                 # rank of the merge that starts here
        token = self.single[symbols].tolist()  # id of the symbol that starts here
        end = list(range(1, n + 1))           # where it ends
        before = list(range(-1, n - 1))       # start of the symbol before
        rank_of, buckets, put = self.ranks.get, queue.buckets, queue.put
        while queue.summary:
            rank, positions = queue.take()
            rest = iter(positions)
            for i in rest:
                if pair[i] != rank:
                    continue  # the pair has changed since
                j = end[i]
                stop = end[i] = end[j]
                token[i] = lowest = rank
                token[j] = pair[j] = NONE
                if edge[stop]:
                    pair[i] = NONE
                else:
                    before[stop] = i
                    pair[i] = r = rank_of(text[i:end[stop]], NONE)
                    if r != NONE:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            put(r, [i])
                        if r < lowest:
                            lowest = r
                if not edge[i]:
                    h = before[i]
                    pair[h] = r = rank_of(text[h:stop], NONE)
                    if r != NONE:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            put(r, [h])
                        if r < lowest:
                            lowest = r
                if lowest < rank:  # what is left of this rank waits for the new lower one
                    left = list(rest)
                    if left:
                        put(rank, left)
        ids = np.array(token, np.int64)
        alive = ids != NONE
        upto = [0, *np.cumsum(alive)[stops - 1].tolist()]
        flat = ids[alive].tolist()
        return [tuple(flat[p:q]) for p, q in zip(upto[:-1], upto[1:])]


def grouped(items: Iterable, size, most: int) -> Iterator[list]:
    """Runs of neighbouring items whose sizes reach `most`; an item is never cut."""
    group, total = [], 0
    for item in items:
        group.append(item)
        total += size(item)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


class Codec:
    """Encodes and decodes texts; remembers about 2 x CACHE_ENTRIES chunks and pre-tokens.

    What was met lately is the young generation; when it is full it becomes the old one, and what is met again moves on.
    """

    def __init__(self, lines: bytes, pattern: str):
        pairs = [line.split() for line in lines.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.merge = Merger(self.ranks)
        # a chunk is a run without white space and the blank before it; no pre-token of the
        # public pattern crosses its end, so chunks can be split and remembered on their own;
        # a pre-token taken alone is its own only pre-token, so both share one memory
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def remembered(self, keys: Iterable[str]) -> list[str]:
        """Moves what the old generation knows to the young one and returns the keys that neither knows."""
        unknown = []
        for key in keys:
            ids = self.old.get(key)
            if ids is None:
                unknown.append(key)
            else:
                self.young[key] = ids
        return unknown

    def learn(self, chunks: set[str]) -> set[str]:
        """Puts chunks into the young generation; returns all keys that this has added."""
        young, whole = self.young, self.ranks.get
        unknown = self.remembered(chunks)
        parts = list(map(self.pattern.findall, unknown))
        pieces = self.remembered({p for ps in parts for p in ps if p not in young})
        rare = []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            rank = whole(data)
            if rank is None:
                rare.append((piece, data))
            else:
                young[piece] = (rank,)
        for group in grouped(rare, lambda pair: len(pair[1]), MERGE_BYTES):
            young.update(zip([p for p, _ in group], self.merge([d for _, d in group])))
        for chunk, ps in zip(unknown, parts):
            if len(ps) != 1:
                young[chunk] = tuple(chain.from_iterable([young[p] for p in ps]))
        return chunks.union(pieces)

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in turn; about BATCH_CHARS characters are held at a time."""
        for group in grouped(texts, len, BATCH_CHARS):
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            split = [self.coarse.findall(t) for t in group]
            added = self.learn({c for chunks in split for c in chunks if c not in self.young})
            for chunks in split:
                yield list(chain.from_iterable(map(self.young.__getitem__, chunks)))
            for key in added:
                if len(key) > KEY_CHARS:
                    del self.young[key]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def shared_codec(spark: SparkSession, ranks_path: str, pattern: str):
    """A function that returns the codec inside a task; a worker builds it once.

    The rank file (under 1 MB for 50 000 merges) is read on the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        state = spark.sparkContext.broadcast({"lines": f.read(), "pattern": pattern})

    def get() -> Codec:
        held = state.value
        if "codec" not in held:
            held["codec"] = Codec(held["lines"], held["pattern"])
        return held["codec"]

    return get


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """`df` with n_tokens and, as wanted, ids (array of int) or the digests of ids and decoded bytes.

    A NULL text is an empty one (no ids, the digests of nothing).  Rows stay as they are, repeated
    ones included; columns of `df` named like a new one are replaced.  One pass, no shuffle.
    """
    get = shared_codec(df.sparkSession, ranks_path, pattern)
    new = ["n_tokens"] + ["ids"] * with_ids + ["ids_sha256", "decoded_sha256"] * digests
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    keep = [c for c in df.columns if c not in new]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def run(batches):
        codec = get()
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            made: dict[str, list] = {c: [] for c in new}
            for ids in codec.encode_all(t.as_py() for t in b.column(b.num_columns - 1)):
                made["n_tokens"].append(len(ids))
                if with_ids:
                    made["ids"].append(np.array(ids, np.int32))
                if digests:
                    made["ids_sha256"].append(hashlib.sha256(",".join(map(codec.text_of.__getitem__, ids)).encode()).hexdigest())
                    made["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            kinds_pa = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(made[c], kinds_pa[c]) for c in new]], names=[*keep, *new])

    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"{c} {kinds[c]}" for c in new])
    return src.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """`df` with the text of its ids; bytes that are no UTF-8 become U+FFFD.  NULL ids give an empty text."""
    get = shared_codec(df.sparkSession, ranks_path, pattern)
    keep = [c for c in df.columns if c != into]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("_ids"))

    def run(batches):
        codec = get()
        for b in batches:
            texts = [codec.decode(x.as_py()).decode("utf-8", "replace") for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, into])

    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"`{into}` string"]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
