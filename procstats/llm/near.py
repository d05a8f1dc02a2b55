"""Near copies by Jaccard similarity: SimHash fingerprints and MinHash bands propose pairs, exact shingle sets decide."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WORD, Rolling, mix, row_key, rows_of, stored
from .components import components

WORDS = 5
ALIKE = 0.8
#: A pair at 0.8 misses all bands with chance (1 - 0.8 ** 5) ** 32, 3 in a million.
BANDS, ROWS = 32, 5
#: Members of a band's bucket that are joined among themselves; fuller buckets are compared with leaders.
BUCKET = 16
ROUNDS = 2
_draw = np.random.default_rng(42)
FACTOR = _draw.integers(0, 2 ** 64, BANDS * ROWS, np.uint64) | np.uint64(1)
SHIFT = _draw.integers(0, 2 ** 64, BANDS * ROWS, np.uint64)
FOLD = _draw.integers(0, 2 ** 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str, words, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words, ASCII letters lowered; fewer words are one shingle."""
    found = words.findall(text.translate(simhash.UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in found), np.uint64, len(found))
    return np.unique(Rolling(h).windows(min(size, len(found))))


def bands(s: np.ndarray) -> np.ndarray:
    """One key per band of minima; none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at:at + 1024, None] * FACTOR + SHIFT).min(axis=0), out=least)
    return mix((mix(least).reshape(BANDS, ROWS) * FOLD).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketches(df: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, fp, keys): node names the row's shingle set, n is its size, fp its SimHash."""
    def run(batches):
        words = re.compile(WORD)
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(2)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([simhash.majority(s) for s in sets], pa.uint64()).view(pa.int64()),
                                              pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "h", "node", "n", "fp", "keys"])

    return rows_of(df).mapInArrow(run, "doc_id long, h long, node long, n long, fp long, keys array<long>")


def _sets(named: DataFrame) -> DataFrame:
    """(node, s) of rows (node, text): the shingles as bytes."""
    def run(batches):
        words = re.compile(WORD)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], names=["node", "s"])

    return named.mapInArrow(run, "node long, s binary").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, same, either) of pairs (a, b): sizes of the intersection and of the union."""
    def run(batches):
        for b in batches:
            both = [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], np.int64)
            either = np.array([len(x) + len(y) for x, y in both], np.int64) - same
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same), pa.array(either)], names=["a", "b", "same", "either"])

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(run, "a long, b long, same long, either long").withColumn("j", F.col("same") / F.col("either"))


def _sizes_fit():
    return (5 * F.col("l.n") >= 4 * F.col("r.n")) & (5 * F.col("r.n") >= 4 * F.col("l.n"))


def _pairs(bucket: DataFrame) -> DataFrame:
    """Pairs of a key's nodes whose sizes allow the similarity."""
    a, b = bucket.alias("l"), bucket.alias("r")
    cond = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & _sizes_fit()
    return a.join(b, cond).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def _merged(led: DataFrame, roots: DataFrame) -> DataFrame:
    """(lead, node, root) of rows (lead, node): leads that share most of their members become one, members in one component with all others go.

    Members of a lead stay together whichever lead they go to.  Each votes for the fullest of its leads, and a lead goes to the one that at
    least half of its members vote for, so a node that is in many buckets of one large group comes once, not once a bucket.
    """
    size = led.groupBy("lead").agg(F.count(F.lit(1)).alias("c"))
    votes = led.join(size, "lead").groupBy("node").agg(F.max(F.struct("c", "lead")).alias("v")).select("node", F.col("v.lead").alias("to"))
    polled = led.join(votes, "node").groupBy("lead", "to").agg(F.count(F.lit(1)).alias("w")).groupBy("lead").agg(F.max(F.struct("w", "to")).alias("v"))
    to = polled.join(size, "lead").select("lead", F.when(2 * F.col("v.w") >= F.col("c"), F.col("v.to")).otherwise(F.col("lead")).alias("to"))
    members = led.join(to, "lead").select(F.col("to").alias("lead"), "node").distinct()
    members = stored(members.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = members.groupBy("lead").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return members.join(mixed, "lead", "left_semi")


def _changes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, node, root, n, d, u, key, at) of rows (lead, node, root): the first of the shingles by which node differs from lead.

    x and y are alike if at most (|x| + |y|) / 9 shingles are in one of them only.  With d_x and d_y shingles by which they differ
    from any lead, these differences must share at least (d_x + d_y - (|x| + |y|) / 9) / 2, which is over d_x - |x| / 4.
    So, with the u that a member of another component shares in one order, from rare to
    common, they share one among the first u - that bound + 1 of each, and from the first one on there must be room for all.
    """
    def run(batches):
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in range(3)], b.column(3), b.column(4))
            for lead, node, root, x, y in rows:
                m, s = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                key = np.setxor1d(m, s, assume_unique=True)
                n, d = len(s), len(key)
                fixed = [pa.array(np.full(d, v)) for v in (lead, node, root, n, d, max(1, -((n - 4 * d) // 4)))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(key)], names=[*names, "key"])

    names = ["lead", "node", "root", "n", "d", "least"]
    with_sets = members.join(sets.select("node", "s"), "node").join(sets.select(F.col("node").alias("lead"), F.col("s").alias("m")), "lead")
    single = stored(with_sets.select("lead", "node", "root", "m", "s").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "key"])))
    often = single.groupBy("lead", "key").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    own = single.join(often, ["lead", "key"]).groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("x"))
    own = own.withColumn("u", F.size("x").cast("long")).where("u >= least")
    first = own.select(*names, "u", F.posexplode(F.expr("slice(x, 1, cast(u - least + 1 as int))")).alias("at", "k"))
    return first.select("lead", "node", "root", "n", "d", "u", F.col("k.key").alias("key"), "at")


def _late(led: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one lead, rows (lead, node), that may be alike and are not in one component yet."""
    rows = stored(_changes(_merged(led, roots), sets))
    a, b = rows.alias("l"), rows.alias("r")
    same = (F.col("l.lead") == F.col("r.lead")) & (F.col("l.key") == F.col("r.key"))
    room = 18 * F.least(F.col("l.u") - F.col("l.at"), F.col("r.u") - F.col("r.at")) >= 9 * (F.col("l.d") + F.col("r.d")) - F.col("l.n") - F.col("r.n")
    cond = same & (F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & _sizes_fit() & room
    return a.join(b, cond).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the SimHash step: each set with the first one of its fingerprint, and the first ones of linked fingerprints."""
    own = stored(prints.select("node", "n", "fp").distinct())
    first = own.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("f")).select("fp", "f.node", "f.n")
    linked = simhash.links(own)
    one = linked.join(first.select(F.col("fp").alias("a"), F.struct("node", "n").alias("l")), "a")
    two = one.join(first.select(F.col("fp").alias("b"), F.struct("node", "n").alias("r")), "b").select("l", "r")
    in_class = own.join(first.select("fp", F.struct("node", "n").alias("l")), "fp").select("l", F.struct("node", "n").alias("r"))
    pairs = two.unionByName(in_class).where((F.col("l.node") != F.col("r.node")) & _sizes_fit())
    return pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def links(df: DataFrame, prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all proposed pairs with Jaccard similarity of ALIKE or more.

    Fingerprints of linked blocks propose pairs, and so do buckets of the bands.  Small buckets are joined among themselves.  In a fuller one all members are compared with
    a leader, the node that is in most full buckets and so nearest to the middle of its group.  Those alike stay linked to it, the others form the bucket of the next
    round.  What is left out, members of a full bucket of the first round that are not in one component yet, meets under the
    shingles by which both differ from the leader (`_changes`), which loses no pair alike.
    """
    by_print = stored(_by_fingerprint(prints))
    keyed = prints.select("node", "n", F.explode("keys").alias("key")).distinct()
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stored(keyed.join(count, "key"))
    met = shared.select("node").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    named = prints.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r")).join(met, "node", "left_semi")
    named = named.select("node", F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"))
    sets = stored(_sets(rows_of(df).join(named, ["doc_id", "h"]).select("node", "text")))
    alike = F.col("same") * 5 >= F.col("either") * 4  # ALIKE in whole numbers

    pairs = by_print.unionByName(_pairs(shared.where(F.col("c") <= BUCKET)))
    left = shared.where(F.col("c") > BUCKET).select("key", "node", "n")
    edges, first = [], None
    for i in range(ROUNDS):
        left = stored(left)
        if left.isEmpty():
            break
        central = left.join(left.groupBy("node").agg(F.count(F.lit(1)).alias("w")), "node")
        leads = central.groupBy("key").agg(F.max(F.struct("w", "node")).alias("lead"), F.count(F.lit(1)).alias("c"))
        led = stored(left.join(leads.withColumn("lead", F.col("lead.node")), "key"))
        few, many = led.where(F.col("c") <= BUCKET), led.where((F.col("c") > BUCKET) & (F.col("node") != F.col("lead")))
        pairs = pairs.unionByName(_pairs(few))
        judged = stored(_similar(many.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), sets))
        edges.append(judged.where(alike).select("a", "b"))
        judged = judged.select(F.col("a").alias("lead"), F.col("b").alias("node"), alike.alias("near"))
        first = judged if i == 0 else first
        left = many.join(judged.where("not near"), ["lead", "node"], "left_semi").select("key", "node", "n")
    edges.append(_similar(pairs.distinct(), sets).where(alike).select("a", "b"))
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    found = stored(found.distinct())
    if first is None or first.where("not near").isEmpty():
        return found
    late = _late(first.select("lead", "node"), stored(components(found)), sets)
    return found.unionByName(_similar(late.distinct(), sets).where(alike).select("a", "b"))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of `df` without near copies: of each group the row with the smallest doc_id stays.

    Rows of one shingle set are one node (texts without words too), nodes alike are linked, and a group is a
    component.  Of repeated rows with that id one stays; all columns come back as they were.
    """
    prints = stored(sketches(df))
    roots = components(links(df, prints)).select("node", "root")
    least = prints.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r"))
    found = least.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r"))
    keyed = df.withColumns(dict(zip(("_id", "_h"), row_key())))
    out = keyed.join(found.select(F.col("r.doc_id").alias("_id"), F.col("r.h").alias("_h")), ["_id", "_h"], "left_semi")
    return out.dropDuplicates(["_id", "_h"]).drop("_id", "_h")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
