"""Alignment of two tokenizers: texts are cut at single spaces, where both tokenizers end a token, and each segment is encoded and aligned once."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Segments or windows of a generation (two are kept) that a worker remembers, and the characters or bytes of ids up to which it does.
MEMORY, LONG = 200_000, 256
#: A single space between two characters that are no white space, and how many segments not met before are encoded at a time.
CUT, TOGETHER = re.compile(r" (?=\S)(?<=\S )"), 256
#: Links of a group that are listed one by one.
WIDE = 1024
#: Texts that are encoded at a time, and links between different ids per chunk: a chunk has its own numbering of pairs.
ROWS, CHUNK = 64, 1 << 20
SIDE = 32
_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_KINDS = dict.fromkeys(_DOC, "long") | {"groups_sha256": "string"}


def groups_of(a: list[int], b: list[int], len_a: list[int], len_b: list[int]) -> tuple[bytes, bytes, Counter | None]:
    """(text, links, wide) of an aligned window: its groups, and what they link (A id * 2 ** 32 + B id), packed.

    `links` has one entry per link; those of groups with over WIDE of them are tallied in `wide` instead.
    """
    i = j = 0
    groups, links, wide, n = [], [], None, len(a)
    while i < n:
        first_a, first_b, x, y = i, j, a[i], b[j]
        end_a, end_b = len_a[x], len_b[y]
        i, j = i + 1, j + 1
        if end_a == end_b:
            groups.append(f"{x}|{y}")
            links.append(x << SIDE | y)
            continue
        while end_a != end_b:
            if end_a < end_b:
                end_a += len_a[a[i]]
                i += 1
            else:
                end_b += len_b[b[j]]
                j += 1
        own_a, own_b = a[first_a:i], b[first_b:j]
        groups.append(f"{','.join(map(str, own_a))}|{','.join(map(str, own_b))}")
        if len(own_a) * len(own_b) <= WIDE:
            links += [x << SIDE | y for x in own_a for y in own_b]
        else:
            wide = wide or Counter()
            times_b = Counter(own_b).items()
            for x, m in Counter(own_a).items():
                for y, k in times_b:
                    wide[x << SIDE | y] += m * k
    return ";".join(groups).encode(), array("q", links).tobytes(), wide


def groups_of_many(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray,
                   size_a: list[int], size_b: list[int]) -> list[tuple]:
    """What `groups_of` gives for each of the segments that begin at the tokens from_a and from_b, with its numbers of tokens.

    start_a and start_b are the byte offsets of the tokens of the joined segments.
    """
    shared = np.intersect1d(start_a, start_b, assume_unique=True)
    in_a, in_b = np.searchsorted(shared, start_a, "right") - 1, np.searchsorted(shared, start_b, "right") - 1
    n_a, n_b = np.bincount(in_a), np.bincount(in_b)
    first_b = np.cumsum(n_b) - n_b
    to_a, to_b = np.append(from_a[1:], len(a)), np.append(from_b[1:], len(b))
    # ids in the order of the groups, those of A before those of B, each followed by its separator
    at = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
    after = np.zeros(len(a) + len(b), np.int64)
    after[np.cumsum(n_a) - 1] = 1
    after[len(a) + np.cumsum(n_b) - 1] = 2
    after[len(a) + to_b - 1] = 3
    ids = map(str, np.concatenate([a, b])[at].tolist())
    groups = "".join(chain.from_iterable(zip(ids, map(",|;\n".__getitem__, after[at].tolist())))).encode().split(b"\n")
    # every id of A with the ids of B of its group
    wide = n_a * n_b > WIDE
    times = np.where(wide[in_a], 0, n_b[in_a])
    ends = np.cumsum(times)
    partner = np.arange(ends[-1]) + np.repeat(first_b[in_a] - ends + times, times)
    links = (np.repeat(a, times) << SIDE | b[partner]).tobytes()
    upto = (8 * np.append(0, ends)).tolist()
    wide = (np.add.reduceat(wide[in_a], from_a) > 0).tolist()
    out = []
    for n, (i, k, j, m) in enumerate(zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist())):
        if wide[n]:
            out.append((*groups_of(a[i:k].tolist(), b[j:m].tolist(), size_a, size_b), k - i, m - j))
        else:
            out.append((groups[n], links[upto[i]:upto[k]], None, k - i, m - j))
    return out


class Vocabulary:
    """The bytes of token ids, their lengths, and whether they begin with a space, as arrays."""

    def __init__(self, own: dict[int, bytes]):
        known = [own.get(i, b"") for i in range(max(own) + 1)]
        self.flat = np.frombuffer(b"".join(known), np.uint8)
        self.size = np.array([len(x) for x in known], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.marked = np.array([x[:1] == b" " for x in known])
        self.sizes = self.size.tolist()

    def gives(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the joined bytes of the ids are `whole`."""
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids) or end[-1] != len(whole):
            return False
        return bool((self.flat[np.arange(len(whole)) + np.repeat(self.start[ids] - end + size, size)] == np.frombuffer(whole, np.uint8)).all())


class Aligner:
    """Encodes texts with both tokenizers and aligns the tokens; remembers about 2 * MEMORY segments and windows at most.

    Texts are cut into segments where a single space stands between two characters that are no white space.  No match of
    public_tokenizers.PATTERN and no piece runs from another character over a space, so pre-tokens and merges stay inside a segment and its
    tokens are the same in every text.  With another pattern, or such pieces, a text is one segment.
    """

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.coder_b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(i, self.coder_b.id_to_piece(i)) for i in range(self.coder_b.get_piece_size())]
        self.a = Vocabulary({i: x for x, i in known.items()})
        self.b = Vocabulary({i: bytes([int(p[3:5], 16)]) if self.coder_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces})
        self.known: dict[str | bytes, tuple] = {}
        self.older: dict[str | bytes, tuple] = {}
        apart = pattern == public_tokenizers.PATTERN and not any("▁" in p.lstrip("▁") for _, p in pieces)
        self.cut = CUT.split if apart else lambda t: [t]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Token ids of both, empty unless the bytes of both are a space and the text."""
        none = np.zeros(0, np.int64)
        some = [t for t in texts if t]
        found = iter(self.coder_b.encode(some, num_threads=1) if some else [])
        out = []
        for t in texts:
            a, b = none, none
            if t:
                t = " " + t
                whole = t.encode()
                a, b = np.array(self.coder_a.encode_ordinary(t), np.int64), np.array(next(found), np.int64)
                if not self.a.gives(a, whole) or not self.b.gives(b, whole):
                    a, b = none, none
            out.append((a, b))
        return out

    def aligned(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text the (groups, links, wide, tokens of A, tokens of B) of its segments or windows, in order; none without tokens."""
        if len(self.known) > MEMORY:
            self.known, self.older = {}, self.known
        cut = [self.cut(t) if t else [] for t in texts]
        found = [list(map(self.known.get, own)) for own in cut]
        new = self._learned({s: None for own, parts in zip(cut, found) if None in parts for s, x in zip(own, parts) if x is None})
        out = []
        for t, own, parts in zip(texts, cut, found):
            if new and None in parts:
                parts = [new[s] if x is None else x for s, x in zip(own, parts)]
                if not all(parts):  # a segment whose tokens don't give back its bytes: the text as a whole decides
                    parts = self.windows(*self.encode([t])[0])
            out.append(parts)
        return out

    def _learned(self, segments: dict) -> dict[str, tuple]:
        """What the segments, not in `known`, are aligned to, empty if their tokens do not give back their bytes; short ones become known."""
        out, joined, alone = {}, [], []
        for s in segments:
            if (old := self.older.get(s)) is not None:
                self.known[s] = out[s] = old
            else:
                (alone if len(s) > LONG or "▁" in s or s[0].isspace() or s[-1].isspace() else joined).append(s)
        for at in range(0, len(joined), TOGETHER):
            some = joined[at:at + TOGETHER]
            (a, b), = self.encode([" ".join(some)])
            if not len(a):
                alone += some
                continue
            size = np.array([len(s.encode()) + 1 for s in some])
            starts = np.cumsum(size) - size
            start_a, start_b = (np.cumsum(n) - n for n in (self.a.size[a], self.b.size[b]))
            from_a, from_b = np.searchsorted(start_a, starts), np.searchsorted(start_b, starts)
            if (start_a[from_a] != starts).any() or (start_b[from_b] != starts).any():
                raise RuntimeError("a token runs over the space before a segment")
            learned = dict(zip(some, groups_of_many(a, b, start_a, start_b, from_a, from_b, self.a.sizes, self.b.sizes)))
            self.known.update(learned)
            out.update(learned)
        for s, ids in zip(alone, self.encode(alone)):
            own = self.windows(*ids)
            groups, links, wide, n_a, n_b = zip(*own) if own else [()] * 5
            out[s] = own and (b";".join(groups), b"".join(links), sum((w for w in wide if w), Counter()) or None, sum(n_a), sum(n_b))
            if own and len(s) <= LONG:
                self.known[s] = out[s]
        return out

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """The windows between anchors: places where both have just ended a token and the next one of each begins with a space.

        Aligned windows are remembered by their ids, packed, those of B with the top bit set.
        """
        if not len(a):
            return []
        start_a, start_b = (np.cumsum(n) - n for n in (self.a.size[a], self.b.size[b]))
        anchors = np.intersect1d(start_a[self.a.marked[a]], start_b[self.b.marked[b]], assume_unique=True)
        if not len(anchors) or anchors[0]:
            anchors = np.append(0, anchors)
        from_a, from_b = [np.append(np.searchsorted(s, anchors), len(s)).tolist() for s in (start_a, start_b)]
        packed_a, packed_b = a.astype(np.uint32).tobytes(), (b | 1 << 31).astype(np.uint32).tobytes()
        a, b, out = a.tolist(), b.tolist(), []
        for i, k, j, m in zip(from_a, from_a[1:], from_b, from_b[1:]):
            key = packed_a[4 * i:4 * k] + packed_b[4 * j:4 * m]
            found = self.known.get(key) or self.older.get(key)
            if found is None:
                found = (*groups_of(a[i:k], b[j:m], self.a.sizes, self.b.sizes), k - i, m - j)
            if len(key) <= LONG:
                self.known[key] = found
            out.append(found)
        return out


def shared_aligner(spark: SparkSession, ranks_path: str, pattern: str, model_path: str):
    """A function that returns the aligner inside a task; the two vocabulary files (under 2 MB) are read on the driver and broadcast."""
    with open(ranks_path, "rb") as f, open(model_path, "rb") as g:
        state = spark.sparkContext.broadcast({"files": (f.read(), pattern, g.read())})

    def get() -> Aligner:
        held = state.value
        if "aligner" not in held:
            held["aligner"] = Aligner(*held["files"])
        return held["aligner"]

    return get


def aligned(df: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """Rows of documents and rows of chunks, told apart by `pairs`, which only chunks have.

    A document has doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and `links`: its pairs of ids, numbered within
    its chunk, and how often it links each, as compressed bytes.  A chunk has the pairs in the order of
    their numbers (A id * 2 ** 32 + B id) and how many of its documents link each.
    """
    get = shared_aligner(df.sparkSession, ranks_path, pattern, model_path)
    names = ["chunk", *_DOC, "links", "pairs", "docs"]

    def run(batches):
        aligner, pack = get(), zstandard.ZstdCompressor(level=1).compress
        part, chunk, rows, held, docs = TaskContext.get().partitionId() << 32, 0, [], [], 0
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]

        def closed():
            """The documents of the chunk, their pairs numbered, and the chunk's own row."""
            pairs, number, often = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(p) for p, _ in held])
            links = [pack(own.astype(np.int32).tobytes() + times.tobytes()) for own, (_, times) in zip(np.split(number, ends[:-1]), held)]
            columns = [*zip(*rows), links]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part + chunk)), *[pa.array(c, k) for c, k in zip(columns, kinds)],
                                              pa.nulls(len(rows), pa.list_(pa.int64())), pa.nulls(len(rows), pa.list_(pa.int32()))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([part + chunk]), *[pa.nulls(1, k) for k in kinds], pa.array([pairs], pa.list_(pa.int64())),
                                              pa.array([often.astype(np.int32)], pa.list_(pa.int32()))], names=names)

        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for doc_id, found in zip(b.column(0).to_pylist(), aligner.aligned([t.as_py() for t in b.column(1)])):
                groups, links, wide, n_a, n_b = zip(*found) if found else [()] * 5
                own, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
                if any(wide):
                    both = Counter(dict(zip(own.tolist(), times.tolist())))
                    for w in wide:
                        both.update(w or {})
                    own, times = np.array(list(both), np.int64), np.array(list(both.values()), np.int64)
                text = b";".join(groups)
                rows.append((doc_id, sum(n_a), sum(n_b), text.count(b";") + 1 if found else 0, int(times.sum()), hashlib.sha256(text).hexdigest() if found else ""))
                held.append((own, times))
                docs += len(own)
            if docs >= CHUNK or len(rows) >= CHUNK >> 5:
                yield from closed()
                chunk, rows, held, docs = chunk + 1, [], [], 0
        if rows:
            yield from closed()

    schema = "chunk long, " + ", ".join(f"{c} {_KINDS[c]}" for c in _DOC) + ", links binary, pairs array<long>, docs array<int>"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best) over the rows of `aligned`: how many documents link the pair, and whether its A id has none more frequent."""
    counts = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    counts = stored(counts)
    a = F.shiftright("pair", SIDE)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_table(df: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """(a, b, count, best): every linked pair of token ids of the corpus, best for A ids' most frequent partners (ties included)."""
    found = pair_counts(stored(aligned(df, ranks_path, pattern, model_path)))
    return found.select(F.shiftright("pair", SIDE).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(2 ** SIDE - 1)).cast("int").alias("b"), "count", "best")


def align(df: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `df`.

    Tokenizer A is a byte-level BPE (ranks, pattern) over a space and the text, B a piece model that adds the space
    itself; neither uses special tokens.  Groups end where tokens of both end, and all tokens of a group are linked.
    NULL and empty texts, and those whose tokens do not give back their bytes, have no tokens: zeros and ''.  Each row
    is a document, also if ids repeat or are NULL; other columns are not read.  An empty table gives no rows.

    Texts are encoded once.  What comes back from the corpus are only the counts that a chunk of documents needs
    (about a million links), joined by pair and then grouped with the chunk, so neither the vocabulary of pairs
    nor a frequent pair meets in one task or the driver.
    """
    rows = stored(aligned(df, ranks_path, pattern, model_path))
    wanted = rows.where("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("i", "pair"))
    answers = wanted.join(pair_counts(rows), "pair").select("of", "i", "count", "best")
    docs = rows.where("pairs IS NULL").select("chunk", *_DOC, "links")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        i = found.column("i").to_numpy()
        count, best = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        count[i], best[i] = found.column("count").to_numpy(), found.column("best").to_numpy()
        n_best, total = [], []
        for links in chain.from_iterable(c for c in own.column("links").chunks):
            raw = unpack(links.as_py())
            at, times = np.frombuffer(raw, np.int32, len(raw) // 12), np.frombuffer(raw[len(raw) // 3:], np.int64)
            n_best.append(int((best[at] * times).sum()))
            total.append(int((count[at] * times).sum()))
        out = own.select(_DOC)
        return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).cast(_result())

    schema = ", ".join(f"{c} {_KINDS[c]}" for c in _DOC) + ", n_best long, count_sum long"
    out = docs.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _result() -> pa.Schema:
    return pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in [*_DOC, "n_best", "count_sum"]])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
