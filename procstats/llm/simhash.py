"""SimHash near-duplicates: fingerprints of word shingles, linked through shared bit blocks."""

from __future__ import annotations

import re
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, given_id, row_key, rows_of, stored
from .components import components

SEED = 42
#: Members of a bucket that are joined among themselves; fuller buckets are cut finer.
BUCKET = 256
UPPER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str, words, size: int) -> int:
    found = words.findall(text.translate(UPPER))
    if not found:
        return 0
    grams = [" ".join(found)] if len(found) < size else map(" ".join, zip(*[found[i:] for i in range(size)]))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, h, fp): the SimHash of each row's word shingles as a signed long."""
    def run(batches):
        words = re.compile(WORD)
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, size) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "h", "fp"])

    return rows_of(df).mapInArrow(run, "doc_id long, h long, fp long")


def _keys(blocks: int, agree: int):
    """One key per choice of `agree` of the `blocks` equal bit blocks."""
    width = 64 // blocks
    keys = []
    for n, choice in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << width) - 1) << (width * i) for i in choice)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return F.explode(F.array(*keys))


def _links(buckets: DataFrame, distance: int) -> DataFrame:
    a = buckets.select("key", F.col("fp").alias("a"))
    b = buckets.select(F.col("key").alias("other"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return a.join(b, (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b) of different values of `fp` that differ in at most `distance` (0 to 2) bits.

    Of four blocks of 16 bits such a pair agrees on two, so it meets under one of six keys.  A key
    with more than BUCKET fingerprints is not joined; its members meet again under the 120 keys that leave
    out two of sixteen blocks of 4 bits.  Those leave 8 bits free, so no such key can hold more
    than 256 different fingerprints: no bucket is ever larger, and no pair is lost.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    own = prints.select("fp").distinct()
    keyed = stored(own.select("fp", _keys(4, 2).alias("key")))
    full = keyed.groupBy("key").count().where(F.col("count") > BUCKET).select("key")
    cold = keyed.join(full, "key", "left_anti")
    hot = keyed.join(full, "key", "left_semi").select("fp").distinct().select("fp", _keys(16, 14).alias("key"))
    return _links(cold, distance).unionByName(_links(hot, distance)).distinct()


def near_groups(df: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, h, fp, root, component_id) for every row of `df` (doc_id, text).

    Rows of one fingerprint are one class, fingerprints at `distance` or fewer bits are linked, and
    component_id is the smallest doc_id reachable.  A text without words has fingerprint zero and is
    linked like any other; NULL texts are empty; a NULL doc_id counts as larger than any and
    comes back as NULL from `report`; repeated rows stay repeated.  Other columns are not read.  root is
    the smallest fingerprint of the group.
    """
    prints = stored(fingerprints(df, size))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints, distance)).select(F.col("node").alias("fp"), "root")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = stored(joined.join(smallest, "root").select("fp", "root", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_one(df: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """The rows of `df` without near copies: of each group the row with the smallest doc_id stays.

    Of repeated rows with that id one stays; all columns come back as they were.
    """
    found = near_groups(df, size, distance).groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    keyed = df.withColumns(dict(zip(("_id", "_h"), row_key())))
    out = keyed.join(found.select(F.col("r.doc_id").alias("_id"), F.col("r.h").alias("_h")), ["_id", "_h"], "left_semi")
    return out.dropDuplicates(["_id", "_h"]).drop("_id", "_h")


def report(df: DataFrame) -> DataFrame:
    g = near_groups(df)
    return g.select(given_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    given_id("component_id").alias("component_id"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
