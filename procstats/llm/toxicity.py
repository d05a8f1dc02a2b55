"""Toxicity: severity grades by cumulative-link ordinal regression on sparse features: words and word beginnings, by how often they are met.

One weight vector is shared by all thresholds: P(grade > k) = logistic(x.w - theta_k) with ascending thetas.  The
labels say toxic or not; the grade of a toxic training document is how many marked features it has (thirds of
the toxic sample), where marked are those that the same sample ties to the toxic label.  The score adds up over
features, so grades by number agree with it; grades by density do not, and held thresholds far above single words.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

DIMENSIONS = 1 << 20
#: Beginnings of words that are features beside the whole word (letters), and how often a feature must be met to count (once more).
BEGINNINGS = (4, 5, 6)
TIERS = (1, 2, 3, 5)
STEP = 0x9E3779B1
#: Words a task remembers, and their greatest length.
WORDS = 200_000
LONGEST = 64
#: Toxic documents the model is fitted on, and clean ones per toxic one (lowest hash of the id).
TRAIN_DOCS = 3000
CLEAN = 4
#: A feature must be met in so many documents of the sample.
MIN_DOCS = 4
#: ... and its log likelihood ratio with the label must reach this, which no word of a large vocabulary does by chance.
TIE = 20.0
GRADES = 3
UPPER = {c: c + 32 for c in range(65, 91)}
STRIP = ".,;:!?\"'()[]*#$%&|<>"


def hashes(word: str) -> list[int]:
    """Hashes of the word without the marks around it, and of how it begins."""
    w = word.strip(STRIP)
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in [w, *(w[:n] + "\n" for n in BEGINNINGS if len(w) >= n)]]


def features(text: str, words) -> np.ndarray:
    """Features of a text, A-Z lower-cased: words and word beginnings, each once for every tier of TIERS its count reaches."""
    met = Counter(words.findall(text.translate(UPPER)))
    if not met:
        return np.zeros(0, np.int32)
    found = [hashes(w) for w in met]
    times = np.repeat(np.fromiter(met.values(), np.int64, len(met)), [len(f) for f in found])
    index, at = np.unique(np.array([h for f in found for h in f], np.int64), return_inverse=True)
    count = np.bincount(at, times)
    return np.unique(np.concatenate([(index[count >= t] + k * STEP) % DIMENSIONS for k, t in enumerate(TIERS)])).astype(np.int32)


def weighing(weight: dict[int, float]) -> bytearray:
    """1 for every hash (modulo DIMENSIONS) of which some tier has a weight."""
    some = bytearray(DIMENSIONS)
    for i in weight:
        for k in range(len(TIERS)):
            some[(i - k * STEP) % DIMENSIONS] = 1
    return some


def score(text: str, words, weight: dict[int, float], some: bytearray, known: dict) -> float:
    """Sum of the weights of a text's `features`.  `known` remembers which hashes of a word weigh anything, for at most WORDS words."""
    count: dict[int, int] = {}
    for w, c in Counter(words.findall(text.translate(UPPER))).items():
        f = known.get(w)
        if f is None:
            f = [h for h in hashes(w) if some[h % DIMENSIONS]]
            if len(known) >= WORDS:
                known.clear()
            if len(w) <= LONGEST:
                known[w] = f
        for h in f:
            count[h] = count.get(h, 0) + c
    index = {(h + k * STEP) % DIMENSIONS for h, c in count.items() for k, t in enumerate(TIERS) if c >= t}
    return sum(weight.get(i, 0.0) for i in sorted(index))


def train(rows: list[tuple[int, np.ndarray]], steps: int = 600, decay: float = 2e-4) -> dict:
    """Weights (sparse) and thresholds from (toxic, features).  Without both classes: severity 0 for all."""
    toxic = np.array([r[0] for r in rows])
    if not len(toxic) or toxic.min() == toxic.max():
        return {"index": np.zeros(0, np.int64), "weight": np.zeros(0), "theta": np.full(GRADES, 50.0)}
    seen = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
    for t, f in rows:
        seen[int(t)][f] += 1
    n0, n1 = (toxic == 0).sum(), (toxic == 1).sum()
    tie = np.zeros(DIMENSIONS)  # log likelihood ratio of word and label
    for n, s in ((n1, seen[1]), (n0, seen[0])):
        share = (seen[0] + seen[1]) / (n0 + n1)
        for got, chance in ((s, share), (n - s, 1 - share)):
            tie += 2 * got * np.log(np.maximum(got, 1e-9) / np.maximum(n * chance, 1e-9))
    known = np.flatnonzero((seen[0] + seen[1] >= MIN_DOCS) & (tie >= TIE))
    marked = (tie >= TIE) & (seen[1] * n0 > seen[0] * n1)
    strength = np.array([marked[f].sum() for _, f in rows])
    cuts = np.quantile(strength[toxic == 1], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + (strength[:, None] > cuts[None, :]).sum(1), 0)
    column = np.full(DIMENSIONS, -1)
    column[known] = np.arange(len(known))
    used = [column[f[column[f] >= 0]] for _, f in rows]
    who, flat = np.repeat(np.arange(len(rows)), [len(f) for f in used]), np.concatenate(used)
    balance = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())
    w = np.zeros(len(known))
    theta = np.arange(GRADES, dtype=float)
    moment = np.zeros((2, len(known) + GRADES))
    for step in range(1, steps + 1):
        z = np.bincount(who, w[flat], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))  # P(grade > k)
        above = np.concatenate([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))], 1)
        k = np.arange(len(rows))
        hi, lo = above[k, grade], above[k, grade + 1]
        mass = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gz = balance * (dhi - dlo) / mass
        gt = np.zeros(GRADES)
        for t in range(GRADES):
            gt[t] = (balance * (np.where(grade == t + 1, -dhi, 0) + np.where(grade == t, dlo, 0)) / mass).sum()
        grad = np.concatenate([np.bincount(flat, gz[who], len(known)) - decay * w, gt])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad ** 2
        move = 0.05 * (moment[0] / (1 - 0.9 ** step)) / (np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-9)
        w += move[:-GRADES]
        theta = np.maximum.accumulate(theta + move[-GRADES:])
    return {"index": known, "weight": w, "theta": theta}


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_DOCS, clean: int = CLEAN * TRAIN_DOCS) -> dict:
    """Train on at most `toxic` and `clean` labelled documents; executors send hashes, not texts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", "toxic")
    by = [F.xxhash64("doc_id", F.lit(3)), "doc_id"]
    chosen = known.where("toxic = 0").orderBy(*by).limit(clean).unionByName(known.where("toxic = 1").orderBy(*by).limit(toxic))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def run(batches):
        words = re.compile(WORD)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "f": [features(t, words).tobytes() for t in pdf["text"]]})

    rows = sorted((r["toxic"], bytes(r["f"])) for r in sample.mapInPandas(run, "toxic int, f binary").collect())
    return train([(t, np.frombuffer(f, np.int32)) for t, f in rows])


def grade(df: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """`df` with severity (expected grade, 0 to GRADES), grade (the likeliest at its median) and toxic (P(grade > 0) above `threshold`).

    NULL and empty texts have no features and get what the thresholds alone say; rows stay as they are,
    repeated ones included; columns named like a new one are replaced.  One pass, no shuffle; the weights
    (at most a few megabytes, bounded by DIMENSIONS) are broadcast.
    """
    new = ["severity", "grade", "toxic"]
    keep = [c for c in df.columns if c not in new]
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(model["index"].tolist(), model["weight"].tolist())))
    theta = np.asarray(model["theta"], float)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"))

    def run(batches):
        words, known, weight = re.compile(WORD), {}, shared.value
        some = weighing(weight)
        for b in batches:
            z = np.array([score(t.as_py(), words, weight, some, known) for t in b.column(b.num_columns - 1)])
            p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))
            cols = [pa.array(p.sum(1).round(6)), pa.array((p > 0.5).sum(1), pa.int32()), pa.array(p[:, 0] > threshold)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, *new])

    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["severity double", "grade int", "toxic boolean"]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
