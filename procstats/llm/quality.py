"""Quality rules with a line labeller: a linear-chain CRF marks each line as content or boilerplate.

The CRF is trained here, from documents with a quality label: every line of a good document
counts as content, every line of a bad one as boilerplate.  That is a weak label, and the features carry no words,
so what the model learns is what junk looks like and how long stretches of it last.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Labelled documents of each class, and lines of each, that the model is fitted on.
TRAIN_DOCS = 400
TRAIN_LINES = 200
MIN_WORDS = 50
MAX_REPEATED = 50
#: A document stays if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
N_FEATURES = 14


def line_features(line: str, words: list[str], seen: bool) -> int:
    """Bit set of the features of one line."""
    n = len(words)
    if n == 0:
        return 1
    chars = len(line)
    symbols = len(SYMBOLS.findall(line))
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    kinds = len(set(words))
    bits = 2 * (n <= 3) + 4 * (4 <= n <= 15) + 8 * (n > 15)
    bits |= 16 * (symbols * 20 > chars) + 32 * (0 < symbols * 20 <= chars)
    bits |= 64 * (upper * 2 > letters > 0) + 128 * ("!!" in line)
    bits |= 256 * (n >= 6 and kinds * 2 < n) + 512 * seen
    bits |= 1024 * (letters * 2 < chars) + 2048 * ("|" in line)
    bits |= 4096 * ("://" in line or "@" in line) + 8192 * line.rstrip().endswith((".", "!", "?", ":", ";"))
    return bits


def as_matrix(bits: np.ndarray) -> np.ndarray:
    return (bits[..., None] >> np.arange(N_FEATURES) & 1).astype(float)


def viterbi(scores: list[float], stay: float, start: float) -> list[bool]:
    """Best labels of a chain of two states: scores are for boilerplate against content."""
    a = b = 0.0  # best path so far that ends in content, in boilerplate
    back = []
    for k, s in enumerate(scores):
        if k == 0:
            a, b = 0.0, s + start
            continue
        from_b, from_a = b > a + stay, a > b + stay
        back.append((from_b, from_a))
        a, b = (b if from_b else a + stay), (a if from_a else b + stay) + s
    out = [b > a] if scores else []
    for from_b, from_a in reversed(back):
        out.append((not from_a) if out[-1] else from_b)
    return out[::-1]


def train(bits: list[np.ndarray], bad: list[bool], steps: int = 150, decay: float = 1e-3) -> dict:
    """Weights of the CRF by gradient ascent on the log likelihood of whole label sequences.

    Sequences are laid side by side, so one pass of the forward and backward recursions serves all of them.
    Without examples of both classes all weights are zero, and every line is content.
    """
    w, stay, start = np.zeros(N_FEATURES), 0.0, 0.0
    if not bits or all(bad) or not any(bad):
        return {"w": w.tolist(), "stay": 0.0, "start": 0.0}
    longest, n = max(map(len, bits)), len(bits)
    x, on, y = np.zeros((longest, n, N_FEATURES)), np.zeros((longest, n)), np.array(bad, float)
    for k, b in enumerate(bits):
        x[:len(b), k] = as_matrix(b)
        on[:len(b), k] = 1
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())[None, :] / np.maximum(on.sum(0), 1)
    moment = np.zeros((2, N_FEATURES + 2))
    for step in range(1, steps + 1):
        s = x @ w * on
        f = np.zeros((longest, n, 2))
        f[0, :, 1] = s[0] + start
        for t in range(1, longest):
            both = np.stack([np.logaddexp(f[t - 1, :, 0] + stay, f[t - 1, :, 1]), np.logaddexp(f[t - 1, :, 0], f[t - 1, :, 1] + stay) + s[t]], 1)
            f[t] = np.where(on[t][:, None] > 0, both, f[t - 1])
        g = np.zeros((longest, n, 2))
        for t in range(longest - 2, -1, -1):
            nb = g[t + 1, :, 1] + s[t + 1]
            both = np.stack([np.logaddexp(g[t + 1, :, 0] + stay, nb), np.logaddexp(g[t + 1, :, 0], nb + stay)], 1)
            g[t] = np.where(on[t + 1][:, None] > 0, both, g[t + 1])
        z = np.logaddexp(f[-1, :, 0], f[-1, :, 1])
        p = np.exp(f[:, :, 1] + g[:, :, 1] - z) * on
        pair = on[1:]
        same = (np.exp(f[:-1, :, 0] + stay + g[1:, :, 0] - z) + np.exp(f[:-1, :, 1] + stay + s[1:] + g[1:, :, 1] - z)) * pair
        err = (y[None, :] - p) * on * weight
        grad = np.concatenate([np.einsum("tn,tnf->f", err, x) - decay * w, [((1 - same) * pair * weight).sum() - decay * stay, (err[0]).sum() - decay * start]])
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.99 * moment[1] + 0.01 * grad ** 2
        move = 0.1 * (moment[0] / (1 - 0.9 ** step)) / (np.sqrt(moment[1] / (1 - 0.99 ** step)) + 1e-9)
        w, stay, start = w + move[:-2], stay + move[-2], start + move[-1]
    return {"w": w.tolist(), "stay": float(stay), "start": float(start)}


def _lines(text: str, words):
    seen: set[str] = set()
    for line in text.split("\n"):
        w = words.findall(line)
        again = bool(w) and line in seen
        if w:
            seen.add(line)
        yield line, w, again


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, lines: int = TRAIN_LINES) -> dict:
    """Train on at most `per_class` labelled documents a class (lowest hash of the id) and `lines` lines of each.

    Only this sample is bounded; features are taken on the executors, and only bit sets reach the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    by = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.where("quality = 0").orderBy(*by).limit(per_class).unionByName(known.where("quality = 1").orderBy(*by).limit(per_class))
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches):
        words = re.compile(WORD)
        for pdf in batches:
            bits = [[line_features(*x) for x, _ in zip(_lines(t, words), range(lines))] for t in pdf["text"]]
            yield pd.DataFrame({"quality": pdf["quality"], "bits": bits})

    rows = sorted((tuple(r["bits"]), r["quality"]) for r in sample.mapInPandas(run, "quality int, bits array<int>").collect())
    return train([np.array(b) for b, _ in rows], [q == 0 for _, q in rows])


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    key = ids[:-1] * size + ids[1:]
    if size ** 3 >= 2 ** 62:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key[:-1] * size + ids[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    marks = np.zeros(n, bool)
    for k in range(3):
        marks[k:n - 2 + k] |= twice
    return int(marks.sum())


def judge(df: DataFrame, model: dict, share: float = CONTENT_SHARE) -> DataFrame:
    """`df` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    A document fails the base rules with fewer than 50 words or with over half of its words in
    repeated three-word windows.  Otherwise it is kept if its words in lines that Viterbi decoding
    marks as content make up `share` or more.  NULL and empty texts have no words and fail;
    rows stay as they are, repeated ones included; columns named like a new one are replaced.
    One pass, no shuffle; memory holds one document besides the batch.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
    keep = [c for c in df.columns if c not in names]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"))
    w, stay, start = model["w"], model["stay"], model["start"]

    def run(batches):
        words = re.compile(WORD)
        score_of: dict[int, float] = {}
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                every: list[str] = []
                scores, sizes, again = [], [], 0
                for line, found, repeated in _lines(text, words):
                    bits = line_features(line, found, repeated)
                    score = score_of.get(bits)
                    if score is None:
                        score = score_of[bits] = sum(x for k, x in enumerate(w) if bits >> k & 1)
                    scores.append(score)
                    sizes.append(len(found))
                    again += repeated
                    every += found
                n, rep = len(every), repeated_words(every)
                bad = viterbi(scores, stay, start)
                content = sum(s for s, x in zip(sizes, bad) if not x) / n if n else 0.0
                failed = n < MIN_WORDS or 100 * rep > MAX_REPEATED * n
                rows.append((n, sum(map(len, every)), len(SYMBOLS.findall(text)), again, rep, failed, content, not failed and content >= share))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[*keep, *names])

    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    new = [f"{c} {k}" for c, k in zip(names, ["long"] * 5 + ["boolean", "double", "boolean"])]
    return src.mapInArrow(run, ", ".join([f"`{c}` {fields[c]}" for c in keep] + new))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
