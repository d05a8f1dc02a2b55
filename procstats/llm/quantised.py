"""Near-duplicate vectors by product quantisation.

Vectors of length one are put into coarse lists by nearest centroid; each keeps its residual at one byte a
component, and how far that is from the vector.  These sketches meet first, block by block inside a label: one
looks into every list that can hold a vector within the wanted distance (by the distance to the plane between the
two cells) and is compared on leading components, then on all.  Only vectors that may have a neighbour travel
themselves, to the lists where it may be.  There they get a code per subspace of the residual; table entries are added
up for the codes, and what the codes' error leaves open is decided by exact cosines.  All bounds are inequalities
of the triangle, so nothing is missed, whatever the sample.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joining import attach
from .common import NO_ID, given_id, stored
from .components import components

#: Vectors the centroids and codebooks are fitted on (lowest hashes).
SAMPLE = 20_000
MAX_LISTS = 1024
SUBSPACES, CODES = 8, 64
BLOCK = 2048
SLACK = 1e-6
#: Of single precision, for squared distances of sketches.
ROUGH = 2e-5
#: Leading components that sketches are compared on first; sketches looked up at a time; rows and columns compared at a time.
LEAD, ASKS, ROWS, COLUMNS = 21, 4096, 1024, 256
#: A label is cut into about so many blocks of sketches, of so many rows at least and bytes at most; a list into blocks of vectors likewise.
PARTS, FEW, MANY = 3, 1 << 14, 1 << 25
LIST_PARTS, LIST_FEW, LIST_MANY = 4, 256, 1 << 22
#: Bits that mark the vectors with a possible neighbour.
MARKS = 1 << 24


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced starts."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c ** 2).sum(1)[None, :] - 2 * x @ c.T, 1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def train(x: np.ndarray, lists: int) -> dict:
    """Centroids, codebooks, steps of the sketches and leading directions for vectors of length one (rows of x)."""
    c = _means(x, lists)
    r = x - c[np.argmin((c ** 2).sum(1)[None, :] - 2 * x @ c.T, 1)]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    low, high = r.min(0), r.max(0)
    room = 0.125 * (high - low) + 1e-3
    return {"c": c, "edges": edges, "books": [_means(r[:, a:b], CODES) for a, b in zip(edges, edges[1:])],
            "low": low - room, "step": (high - low + 2 * room) / 255, "turn": np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :LEAD]}


def untrained(size: int) -> dict:
    """For a length that the sample does not hold: one list, no codes."""
    return {"c": np.zeros((1, size)), "edges": np.array([0, size]), "books": [np.zeros((1, size))],
            "low": np.full(size, -1.0), "step": np.full(size, 2 / 255), "turn": np.eye(size)[:, :LEAD]}


def single(model: dict) -> dict:
    """What sketches need, in single precision."""
    m = {k: np.ascontiguousarray(model[k], np.float32) for k in ("c", "low", "step", "turn")}
    m["norms"] = (m["c"] ** 2).sum(1)
    m["gap"] = np.sqrt(np.maximum(m["norms"][:, None] + m["norms"][None, :] - 2 * m["c"] @ m["c"].T, 0))
    return m


def sketch(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, code of a byte a component, error) of vectors of length one; list -1 where the length was not finite or zero."""
    x = x.astype(np.float32)
    odd = ~np.isfinite(x).all(1)
    x[odd] = 0
    near = np.argmin(m["norms"][None, :] - 2 * x @ m["c"].T, 1).astype(np.int32)
    code = np.clip(np.rint((x - m["c"][near] - m["low"]) / m["step"]), 0, 255).astype(np.uint8)
    error = np.sqrt(((x - unsketch(near, code, m)) ** 2).sum(1)) + np.float32(ROUGH)
    near[odd] = -1
    return near, code, error


def unsketch(near: np.ndarray, code: np.ndarray, m: dict) -> np.ndarray:
    return m["c"][near] + (m["low"] + m["step"] * code)


class Sketches:
    """Sketches ordered by list, to be looked up."""

    def __init__(self, key: np.ndarray, near: np.ndarray, code: np.ndarray, error: np.ndarray, m: dict):
        self.m, self.key, self.near, self.code, self.error = m, key, near, code, error
        if (near[1:] < near[:-1]).any():
            order = np.argsort(near, kind="stable")
            self.key, self.near, self.code, self.error = key[order], near[order], code[order], error[order]
        self.starts = np.searchsorted(self.near, np.arange(len(m["c"]) + 1))
        self.worst = np.zeros(len(m["c"]), np.float32)
        np.maximum.at(self.worst, self.near, self.error)
        # a few lists with larger errors don't loosen the bound of the others
        self.worst = np.maximum(self.worst, min(self.error.max(), 4 * np.median(self.error)))
        self.lead = np.empty((len(key), m["turn"].shape[1] + 3), np.float32)
        for at in range(0, len(key), ASKS):
            s = slice(at, at + ASKS)
            x = unsketch(self.near[s], self.code[s], m)
            self.lead[s] = leading(x, m)
            self.lead[s, -2] = (x ** 2).sum(1) / -2
            self.lead[s, -1] = 1

    def near_pairs(self, key: np.ndarray, near: np.ndarray, code: np.ndarray, error: np.ndarray, radius: float, first: int = -1):
        """(key, list) of what may be within the radius, of both sides: the higher list of the two.

        first: where the given sketches stand among these; then only what stands later is looked at.
        """
        m = self.m
        x = unsketch(near, code, m)
        reach = error + np.float32(radius)
        half = (x ** 2).sum(1) / 2
        lead = leading(x, m)
        lead[:, -2] = 1
        usual = self.worst.min()
        lead[:, -1] = (reach + usual) ** 2 / 2 - half + np.float32(ROUGH)
        d2 = x @ m["c"].T
        d2 *= -2
        d2 += m["norms"]
        most = m["gap"][near]
        most *= 2 * reach[:, None]
        most += d2[np.arange(len(x)), near][:, None] + np.float32(ROUGH)
        probes = d2 <= most
        if first >= 0:
            probes &= np.arange(len(m["c"])) >= near[:, None]
        probes = np.ascontiguousarray(probes.T)
        room, rows = np.empty(ROWS * COLUMNS, np.float32), np.empty((ROWS, lead.shape[1]), np.float32)
        for one in np.flatnonzero(probes.any(1) & (np.diff(self.starts) > 0)):
            asks, start, end = np.flatnonzero(probes[one]), self.starts[one], self.starts[one + 1]
            known = None
            for at in range(0, len(asks), ROWS):
                i = asks[at:at + ROWS]
                q = np.take(lead, i, 0, out=rows[:len(i)], mode="clip")
                if self.worst[one] > usual:
                    q[:, -1] = (reach[i] + self.worst[one]) ** 2 / 2 - half[i] + np.float32(ROUGH)
                for s in range(start, end, COLUMNS):
                    e = min(s + COLUMNS, end)
                    over = np.matmul(q, self.lead[s:e].T, out=room[:len(i) * (e - s)].reshape(len(i), e - s))
                    if over.max() < 0:
                        continue
                    hit = over >= 0
                    if known is None:
                        # what is known to be wanted in this list
                        known, held, lower = np.zeros(len(x), bool), np.zeros(end - start, bool), near <= one
                    elif held[s - start:e - start].any():
                        hit &= ~(known[i][:, None] & held[s - start:e - start])
                    a, b = np.divmod(np.flatnonzero(hit), e - s)
                    a, b = i[a], b + s
                    if first >= 0:
                        a, b = a[b > a + first], b[b > a + first]
                    for k in range(0, len(a), 20_000):
                        c, d = a[k:k + 20_000], b[k:k + 20_000]
                        ok = ((x[c] - unsketch(self.near[d], self.code[d], m)) ** 2).sum(1) <= (reach[c] + self.error[d]) ** 2 + np.float32(ROUGH)
                        c, d = c[ok], d[ok]
                        known[c[lower[c]]] = True
                        held[d[lower[c]] - start] = True
                        c, d = c[~lower[c]], d[~lower[c]]
                        if len(c):
                            yield key[c], near[c]
                            yield self.key[d], near[c]
            if known is not None and known.any():
                yield key[known], np.full(known.sum(), one)
                yield self.key[start:end][held], np.full(held.sum(), one)


def leading(x: np.ndarray, m: dict) -> np.ndarray:
    """Leading components, length of the rest, and two free columns."""
    k = m["turn"].shape[1]
    out = np.empty((len(x), k + 3), np.float32)
    out[:, :k] = x @ m["turn"]
    out[:, k] = np.sqrt(np.maximum((x ** 2).sum(1) - (out[:, :k] ** 2).sum(1), 0))
    return out


def encode(x: np.ndarray, centre: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(codes, error) of vectors of length one in the list of this centre."""
    rest = x - centre
    codes = np.zeros((len(x), len(model["books"])), np.uint8)
    for m, (a, b) in enumerate(zip(model["edges"], model["edges"][1:])):
        book = model["books"][m]
        codes[:, m] = np.argmin((book ** 2).sum(1)[None, :] - 2 * rest[:, a:b] @ book.T, 1)
        rest[:, a:b] -= book[codes[:, m]]
    return codes, np.sqrt((rest ** 2).sum(1))


def match(q: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, centre: np.ndarray, model: dict, cosine: float):
    """(query, row) pairs of one list with cosine at or above the bound; q and x are raw vectors in double precision."""
    radius = np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    lq, lx = np.sqrt((q ** 2).sum(1)), np.sqrt((x ** 2).sum(1))
    rest = q / lq[:, None] - centre
    far = np.zeros((len(q), len(x)))
    for m, (a, b) in enumerate(zip(model["edges"], model["edges"][1:])):
        part, book = rest[:, a:b], model["books"][m]
        table = (part ** 2).sum(1)[:, None] + (book ** 2).sum(1)[None, :] - 2 * part @ book.T
        far += table[:, codes[:, m]]
    i, j = np.nonzero(far <= (radius + error[None, :]) ** 2 + SLACK)
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), 200_000):
        s = slice(at, at + 200_000)
        ok[s] = np.einsum("ij,ij->i", q[i[s]], x[j[s]]) / (lq[i[s]] * lx[j[s]]) >= cosine
    return i[ok], j[ok]


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the pairs with the smallest node it is connected to inside this block."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _runs(batches, keys: int):
    """(values of the leading columns, rows) of each run of rows that agree in them."""
    for b in batches:
        if not b.num_rows:
            continue
        k = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        edges = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1).tolist(), b.num_rows]
        for s, e in zip(edges, edges[1:]):
            yield tuple(int(c[s]) for c in k), b.slice(s, e - s)


def _flat(column: pa.Array) -> np.ndarray:
    """Lists or binaries of one length as rows."""
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _bounds(n: str, parts: int, few: int, many, blocks: str = "blocks") -> Column:
    """Blocks for n rows: about `parts`, of `few` rows at least and `many` at most."""
    rows = F.least(F.greatest(F.ceil(F.col(n) / parts), F.lit(few)), F.greatest(F.floor(many), F.lit(few)))
    return F.greatest(F.ceil(F.col(n) / rows), F.lit(1)).cast("int").alias(blocks)


def near_vectors(df: DataFrame, cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `df` (vec_id, embedding, label).

    Rows of equal, non-NULL label whose cosine is `cosine` or more are linked.  Vectors that are NULL, zero or
    hold a NULL or a non-finite component, and rows without a label, link with nothing; vectors of different
    length are never compared.  Equal vectors of a label are one class with a count; rows that repeat a vector
    are linked with each other.  vec_id names a vector; a NULL one counts as larger than any and stays
    NULL.  component_id is the smallest vec_id reachable, kept says that it is the row's own.  Other columns are
    not read.  Pairs never leave a block: counts and, per block, one link from each vector to the
    smallest of its group do.
    """
    spark = df.sparkSession
    v = F.col("embedding")
    # array_contains is NULL where a NULL stands and nothing is found
    fine = F.col("label").isNotNull() & F.coalesce((F.array_max(v) < float("inf")) & (F.array_min(v) > float("-inf")) & (
        (F.array_max(v) > 0) | (F.array_min(v) < 0)) & ~F.array_contains(v, F.lit(float("nan"))), F.lit(False))
    rows = df.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"), F.col("label").cast("string").alias("label"), fine.alias("fine"))
    rows = rows.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64("v", F.lit(1), "label")})
    some = rows.where("fine")
    total = some.agg(F.approx_count_distinct("k1", 0.02)).first()[0]
    # the lowest hashes, by a bound that leaves room for the error of the count
    low = -2 ** 63 + min(2 ** 64 - 1, int(2 ** 64 * (1.2 * sample + 1000) / max(total, 1)))
    picked = some.where(F.col("k1") <= low).select("v", "k1", "k2").dropDuplicates(["k1", "k2"]).orderBy("k1", "k2").limit(sample).collect()
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    models = {}
    for size, xs in by_size.items():
        x = np.array(xs, float)
        with np.errstate(all="ignore"):
            x /= np.sqrt((x ** 2).sum(1))[:, None]
        x = x[np.isfinite(x).all(1)]
        if len(x):
            models[size] = train(x, max(1, min(MAX_LISTS, int(total ** 0.5), len(x) // 8)))
    shared = spark.sparkContext.broadcast(models)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    known: dict[int, tuple[dict, dict]] = {}

    def model_of(size):
        if size not in known:
            model = shared.value.get(size) or untrained(size)
            known[size] = model, single(model)
        return known[size]

    def place(batches):
        for b in batches:
            values = b.column(4).flatten().to_numpy(zero_copy_only=False)
            offsets = b.column(4).offsets.to_numpy()
            offsets = (offsets - offsets[0]).astype(np.int32)
            sizes = np.diff(offsets)
            near, error, code = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.float32), np.zeros(len(values), np.uint8)
            for size in np.unique(sizes):
                for at in np.array_split(w := np.flatnonzero(sizes == size), len(w) // BLOCK + 1):
                    cells = offsets[at][:, None] + np.arange(size)
                    x = values[cells].astype(float)
                    with np.errstate(all="ignore"):
                        x /= np.sqrt((x ** 2).sum(1))[:, None]
                    near[at], code[cells], error[at] = sketch(x, model_of(int(size))[1])
            code = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(code)])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(sizes.astype(np.int32)), pa.array(near), pa.array(error), code],
                                             names=["k1", "k2", "vec_id", "label", "size", "near", "error", "code"])

    placed = some.select("k1", "k2", "vec_id", "label", "v").mapInArrow(place, "k1 long, k2 long, vec_id long, label string, size int, near int, error float, code binary")
    classes = stored(placed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("label", "size", "near", "error", "code"))))
    # labels are cut into blocks, and every two blocks of one meet in a task
    room = stored(classes.where("near >= 0").groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(
        "label", "size", _bounds("rows", PARTS, FEW, F.lit(MANY) / F.col("size")), F.monotonically_increasing_id().alias("g")))
    mine, other = F.col("mine"), F.col("other")
    block = [F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), (mine > other).alias("ask")]
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = attach(classes.where("near >= 0").select("label", "size", "k1", "near", "error", "code"), room, ["label", "size"], ready=True)
    meet = meet.withColumn("mine", F.pmod(F.xxhash64("k1", F.lit(1)), F.col("blocks")).cast("int")).withColumn("other", others).select("g", *block, "k1", "near", "error", "code")

    def sift(batches):
        key, held, index = None, [], None

        def built():
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return Sketches(*cols, model_of(cols[2].shape[1])[1])

        def among():
            for at in range(0, len(index.key), ASKS):
                s = slice(at, at + ASKS)
                yield from rows_out(index.near_pairs(index.key[s], index.near[s], index.code[s], index.error[s], radius, at))

        def rows_out(found):
            found = list(zip(*found))
            if found:
                one = np.unique(np.stack([np.concatenate(c).astype(np.int64) for c in found], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1].astype(np.int32))], names=["k1", "list"])

        for (g, a, b, ask), batch in _runs(batches, 4):
            if (g, a, b) != key:
                if held and key[1] == key[2]:
                    index = built()
                    yield from among()
                key, index = (g, a, b), None
                held.clear()
            cols = [batch.column(4).to_numpy(), batch.column(5).to_numpy(), _flat(batch.column(7)), batch.column(6).to_numpy()]
            if not ask:
                held.append([c.copy() for c in cols])
                continue
            if held:
                index = built()
            if index:
                for at in range(0, len(cols[0]), ASKS):
                    yield from rows_out(index.near_pairs(*(c[at:at + ASKS] for c in cols), radius))
        if held and key[1] == key[2]:
            index = built()
            yield from among()

    asks = stored(meet.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "ask", "near").mapInArrow(sift, "k1 long, list int").distinct())
    # of vectors, only those marked travel
    word, bit = f"cast(floor(pmod(k1, {MARKS}) / 64) as int)", f"shiftleft(1L, cast(pmod(k1, {MARKS}) % 64 as int))"
    marks = F.broadcast(stored(asks.select(F.expr(word).alias("word"), F.expr(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))))

    def marked(some_rows):
        return some_rows.withColumn("word", F.expr(word)).join(marks, "word").where(F.expr(f"bits & {bit} <> 0")).drop("word", "bits")

    vectors = marked(some.select("k1", "k2", "v")).groupBy("k1", "k2").agg(F.first("v").alias("v"))
    looks = stored(marked(classes.where("near >= 0").select("k1", "k2", "rep", "n", "label", "size", "near")).join(asks, "k1"))
    lists = stored(looks.where("near = list").groupBy("label", "size", "list").agg(F.count(F.lit(1)).alias("rows")).select(
        "label", "size", "list", _bounds("rows", LIST_PARTS, LIST_FEW, F.lit(LIST_MANY) / F.col("size")), F.monotonically_increasing_id().alias("g")))
    looks = attach(looks, lists, ["label", "size", "list"], ready=True)
    # a vector of the list meets those of its block and of the others, one of a lower list meets each block
    looks = looks.withColumn("other", others).withColumn("mine", F.when(F.col("near") == F.col("list"), F.pmod(F.xxhash64("k1", F.lit(2)), F.col("blocks")).cast("int")).otherwise(other))
    looks = looks.select("k1", "k2", "g", *block[:2], ((mine > other) | (F.col("near") != F.col("list"))).alias("ask"), "list", "rep", "n")
    meet = looks.join(vectors, ["k1", "k2"]).select("g", "a", "b", "ask", "list", "rep", "n", "v")

    def work(batches):
        key, held, index, links = None, [], None, None

        def built():
            where, rep, n, v = held[0][0], *(np.concatenate(c) for c in list(zip(*held))[1:])
            held.clear()
            model = model_of(v.shape[1])[0]
            with np.errstate(all="ignore"):
                codes, error = encode(v / np.sqrt((v ** 2).sum(1))[:, None], model["c"][where], model)
            return rep, n, v, codes, error, model["c"][where], model

        def links_of(rep, n, v, first=-1):
            """Rows out of what is near the given vectors; first: where they stand among those held."""
            there, times, x, codes, error, centre, model = index
            own = np.zeros(len(rep), np.int64)
            for at in range(0, len(x), BLOCK):
                s = slice(at, at + BLOCK)
                if first >= at + BLOCK:
                    continue
                i, j = match(v, x[s], codes[s], error[s], centre, model, cosine)
                j = j + at
                ok = there[j] != rep[i]
                if first >= 0:
                    ok &= j > i + first
                i, j = i[ok], j[ok]
                if len(i):
                    own += np.bincount(i, times[j], len(rep)).astype(np.int64)
                    links[s] += np.bincount(j - at, n[i], len(links[s])).astype(np.int64)
                    node, root = _joined(rep[i], there[j])
                    yield node, root, np.zeros(len(node), np.int64)
            some = np.flatnonzero(own)
            if len(some):
                yield rep[some], np.full(len(some), -1), own[some]

        def among():
            rep, n, v = index[:3]
            for at in range(0, len(rep), BLOCK):
                s = slice(at, at + BLOCK)
                yield from links_of(rep[s], n[s], v[s], at)

        def ended():
            if links is not None and len(some := np.flatnonzero(links)):
                yield index[0][some], np.full(len(some), -1), links[some]

        def rows_out(found):
            for x in found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], names=["a", "b", "links"])

        for (g, a, b, ask), batch in _runs(batches, 4):
            if (g, a, b) != key:
                if held and key[1] == key[2]:
                    index = built()
                    links = np.zeros(len(index[0]), np.int64)
                    yield from rows_out(among())
                yield from rows_out(ended())
                key, index, links = (g, a, b), None, None
                held.clear()
            rep, n = (batch.column(k).to_numpy() for k in (5, 6))
            if not ask:
                held.append((batch.column(4)[0].as_py(), rep.copy(), n.copy(), _flat(batch.column(7)).astype(float)))
                continue
            if held:
                index = built()
                links = np.zeros(len(index[0]), np.int64)
                if a == b:
                    yield from rows_out(among())
            if index:
                v = _flat(batch.column(7)).astype(float)
                for at in range(0, len(rep), BLOCK):
                    s = slice(at, at + BLOCK)
                    yield from rows_out(links_of(rep[s], n[s], v[s]))
        if held and key[1] == key[2]:
            index = built()
            links = np.zeros(len(index[0]), np.int64)
            yield from rows_out(among())
        yield from rows_out(ended())

    found = stored(meet.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "ask").mapInArrow(work, "a long, b long, links long"))
    links = found.where("b = -1").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("more"))
    roots = components(found.where("b <> -1").select("a", "b")).select(F.col("node").alias("rep"), "root")
    verdict = stored(classes.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(roots, "rep", "left").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    known_rows = some.select("vec_id", "k1", "k2").join(verdict, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known_rows.unionByName(alone)
    return out.select(given_id("vec_id").alias("vec_id"), "n_links", given_id("component_id").alias("component_id"),
                      (F.col("vec_id") == F.col("component_id")).alias("kept"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
