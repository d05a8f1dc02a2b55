"""Line dedup: range-partitioned line hashes, first occurrences in a stream, keep bitmaps per document."""

from __future__ import annotations

import hashlib
import sys
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joining import attach
from .common import stored

#: A line counts from this many code points on, and is common from this many documents on.
LEAST, DOCUMENTS = 20, 3
BLANK = b" \t\n\x0b\x0c\r"
#: NULL ids stand below all others: such rows count as one document, which keeps a line only if no other holds it.
NO_DOC = -2 ** 63
#: Rows of a second document that wait for a third one; a run with more of them is decided by a join.
HELD = 65536
DROP, OPEN, RUN = 0, 1, 2
_LATER = bytes(range(0x80, 0xC0))
_SCHEMA = "kind byte, h1 long, h2 long, doc_id long, h long, at long"


def _rows(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def keys_of(text: bytes, least: int = LEAST) -> tuple[int, list[int], list[bytes]]:
    """(number of lines, positions, 128-bit hashes) of the lines whose key has `least` code points or more."""
    lines = text.lower().split(b"\n")  # of bytes, lower() changes A-Z only
    at, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= least:
            key = line.strip(BLANK)
            if len(key) >= least and (len(key) >= 4 * least or len(key.translate(None, _LATER)) >= least):
                at.append(i)
                digests.append(xxhash.xxh3_128_digest(key))
    return len(lines), at, digests


def line_hashes(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, h, at): a row for each long enough line; `at` is the number of lines * 2 ** 32 + the position."""
    def run(batches):
        for b in batches:
            n, at, digests = [], [], []
            for text in b.column(2):
                lines, own, found = keys_of(text.as_py(), least)
                n.append(len(own))
                at.append(np.array(own, np.int64) + (lines << 32))
                digests += found
            row = np.repeat(np.arange(b.num_rows), n)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), b.column(0).take(take), b.column(1).take(take),
                                              pa.array(np.concatenate([*at, np.zeros(0, np.int64)]))], names=["h1", "h2", "doc_id", "h", "at"])

    return _rows(df).mapInArrow(run, "h1 long, h2 long, doc_id long, h long, at long")


class Runs:
    """Reads rows in the order of hash and falling doc_id, and says which lines go.

    Of a run of equal hashes the first document keeps its lines, and those of the others go as soon as a third
    document is met.  A run is left open where another partition may hold its start or its end: its rows are
    passed on, with a row that has its first document and its number of documents.
    """

    def __init__(self, documents: int):
        self.documents = documents
        self.key, self.first, self.last, self.count = None, 0, 0, 0
        self.open, self.any = True, False  # the first run of a partition may have begun before
        self.held: list[np.ndarray] = []
        self.out: list[tuple[int, np.ndarray]] = []

    def give(self, kind: int, rows: np.ndarray) -> None:
        if len(rows):
            self.out.append((kind, rows))

    def wait(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        if sum(map(len, self.held)) > HELD:
            self.open = True
            self.free(OPEN)

    def free(self, kind: int) -> None:
        for rows in self.held:
            self.give(kind, rows)
        self.held = []

    def end(self, last: bool = False) -> None:
        """The run is over, in this partition at least."""
        if self.key is None:
            return
        if last and not self.open and self.count < self.documents:
            self.free(OPEN)
        elif not self.open and self.count >= self.documents:
            self.free(DROP)
        if self.open or last:
            self.give(RUN, np.array([[*self.key, self.first, 0, self.count]], np.int64))
        self.held, self.open = [], False

    def add(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """rows: h1, h2, doc_id, h, at."""
        self.out = []
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        starts = np.append(np.flatnonzero(new), len(rows))
        other = np.ones(len(rows), bool)
        other[1:] = new[1:] | (rows[1:, 2] != rows[:-1, 2])
        count = np.add.reduceat(other.astype(np.int64), starts[:-1]) if len(rows) else np.zeros(0, np.int64)
        inside = np.zeros(len(rows), bool)  # of runs that begin and end here
        if len(starts) > 3:
            run = np.repeat(np.arange(len(count)), np.diff(starts))
            drop = (count >= self.documents)[run] & (rows[:, 2] != rows[starts[:-1], 2][run])
            inside[starts[1]:starts[-2]] = True
            self.give(DROP, rows[drop & inside])
        for k in dict.fromkeys((0, len(count) - 1)) if len(rows) else ():
            self.some(rows[starts[k]:starts[k + 1]])
        return self.out

    def some(self, rows: np.ndarray) -> None:
        """Rows of one run, which may have begun before and may go on."""
        key, docs = tuple(rows[0, :2]), rows[:, 2]
        if key != self.key:
            self.end()
            self.open, self.any = not self.any, True
            self.key, self.first, self.last, self.count = key, docs[0], docs[0], 1
        change = np.flatnonzero(np.append(docs[0] != self.last, docs[1:] != docs[:-1]))
        self.count += len(change)
        self.last = docs[-1]
        if self.open:
            self.give(OPEN, rows)
        elif self.count >= self.documents:
            self.free(DROP)
            self.give(DROP, rows[docs != self.first])
        else:
            self.wait(rows[docs != self.first])


def _stream(hashes: DataFrame, documents: int) -> DataFrame:
    def run(batches):
        runs = Runs(documents)

        def made(parts):
            for kind, rows in parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *[pa.array(np.ascontiguousarray(rows[:, c])) for c in range(5)]],
                                                 names=["kind", "h1", "h2", "doc_id", "h", "at"])
        for b in batches:
            if b.num_rows:
                yield from made(runs.add(np.column_stack([c.to_numpy() for c in b.columns])))
        runs.out = []
        runs.end(last=True)
        yield from made(runs.out)

    key = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    return hashes.repartitionByRange(*key).sortWithinPartitions(*key, "h", "at").mapInArrow(run, _SCHEMA)


def dropped_lines(df: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, h, at) of the lines that go; `h` is the hash of the text, `at` as in `line_hashes`."""
    found = stored(_stream(stored(line_hashes(df, least)), documents))
    runs = found.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.sum("at").alias("n"))
    late = attach(found.where(F.col("kind") == OPEN), runs.where(F.col("n") >= documents), ["h1", "h2"]).where("doc_id < keeper")
    return found.where(F.col("kind") == DROP).select("doc_id", "h", "at").unionByName(late.select("doc_id", "h", "at"))


def keep_bitmaps(df: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, h, n_lines, n_dropped, keep) for each document that loses lines; one not listed keeps all.

    A line's key is the line without blanks (space, tab to carriage return) at its ends and with A-Z lowered.  Keys of
    `least` code points or more that `documents` documents or more hold lose all their lines except those of the largest
    doc_id among them.  `keep` has one bit per line, first line in the lowest bit, as deflated bytes.

    A document is a doc_id: rows of one id count once and keep together, and NULL ids are one document, below all
    others (its doc_id is NO_DOC here).  `h` (xxhash64 of the text) tells rows of one id apart; equal rows share
    one bitmap.  NULL and empty texts have one empty line.  Other columns are not read.  An empty table gives no rows.

    Hashes of 128 bits are dealt out in ranges of (hash, doc_id), so that a line that a third of all documents hold is
    spread over many tasks; each streams its rows in order, and the runs that reach the ends of its range
    (two a task) are decided by a small join.
    """
    def run(batches):
        for b in batches:
            lines, gone, bits = [], [], []
            for at in b.column(2):
                own = np.unique(np.array(at.as_py(), np.int64))
                lines.append(int(own[0] >> 32))
                gone.append(len(own))
                keep = np.ones(lines[-1], bool)
                keep[own & 0xFFFFFFFF] = False
                bits.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(bits, pa.binary())],
                                             names=["doc_id", "h", "n_lines", "n_dropped", "keep"])

    own = dropped_lines(df, least, documents).groupBy("doc_id", "h").agg(F.collect_list("at").alias("at"))
    return own.mapInArrow(run, "doc_id long, h long, n_lines long, n_dropped long, keep binary")


def kept_text(text: bytes, bitmap: bytes | None) -> tuple[int, bytes]:
    """(number of lines, the lines that stay, joined)."""
    if bitmap is None:
        return text.count(b"\n") + 1, text
    lines = text.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    return len(lines), b"\n".join([lines[i] for i in np.flatnonzero(keep)])


def _with_bitmaps(df: DataFrame, least: int, documents: int) -> DataFrame:
    return _rows(df).join(stored(keep_bitmaps(df, least, documents)).drop("n_lines"), ["doc_id", "h"], "left")


def report(df: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of `df`; rules as in `keep_bitmaps`."""
    def run(batches):
        for b in batches:
            both = [kept_text(t.as_py(), k.as_py()) for t, k in zip(b.column(1), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in both], pa.int64()), b.column(2).fill_null(0),
                                              pa.array([hashlib.sha256(x).hexdigest() for _, x in both])],
                                             names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_bitmaps(df, least, documents)
    doc_id = F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")).alias("doc_id")
    return rows.select(doc_id, "text", "n_dropped", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def strip(df: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text) of every row of `df`, without the lines that go."""
    def run(batches):
        for b in batches:
            kept = [kept_text(t.as_py(), k.as_py())[1].decode("utf-8", "replace") for t, k in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    rows = _with_bitmaps(df, least, documents)
    return rows.select(F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")).alias("doc_id"), "text", "keep").mapInArrow(run, "doc_id long, text string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
