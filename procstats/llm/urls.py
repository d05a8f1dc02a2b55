"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 16
SIZES = (3, 4, 5)
THRESHOLD = 0.5
#: (host, path, verdict), the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled urls: host, path, 1 for unwanted.
HOSTS = (
    ("spam-farm.test", "/en/1", 1), ("www.spam-site.test", "/offer", 1), ("cheap-pills.test", "/buy", 1), ("cheap-meds.test", "/order/12", 1),
    ("pills-online.test", "/en/4", 1), ("casino-bonus.test", "/play", 1), ("best-casino.test", "/slots/", 1), ("free-slots.test", "/win", 1),
    ("win-money-fast.test", "/now", 1), ("adult-chat.test", "/live", 1), ("xxx-videos.test", "/watch/3", 1), ("porn-tube.test", "/en/8", 1),
    ("replica-watches.test", "/shop", 1), ("fake-bags.test", "/sale", 1), ("payday-loans.test", "/apply", 1), ("quick-credit.test", "/loan", 1),
    ("click-bait.test", "/ads/5", 1), ("link-farm.test", "/links", 1), ("seo-links.test", "/buy-links", 1), ("crack-keygen.test", "/download", 1),
    ("warez-torrent.test", "/free", 1), ("hot-singles.test", "/meet", 1), ("miracle-diet.test", "/lose-weight", 1), ("phishing-login.test", "/verify-account", 1),
    ("www.spamfarm.test", "/de/7", 1), ("m.cheap-viagra.test", "/fr/3", 1),
    ("university.test", "/en/12", 0), ("library.test", "/catalog/9", 0), ("www.museum.test", "/visit", 0), ("blog.gardening.test", "/en/55", 0),
    ("news.test", "/fr/870", 0), ("m.weather.test", "/de/3", 0), ("forum.test", "/es/4", 0), ("docs.software.test", "/manual/intro", 0),
    ("recipes.test", "/en/soup", 0), ("city-council.test", "/minutes/2020", 0), ("www.hospital.test", "/contact", 0), ("science.test", "/article/77", 0),
    ("school.test", "/en/6", 0), ("blog.travel.test", "/es/19", 0), ("music.test", "/fr/41", 0), ("history.test", "/en/page.html", 0),
    ("wiki.test", "/de/88", 0), ("m.sports.test", "/results", 0), ("books.test", "/en/203/", 0), ("theatre.test", "/program", 0),
    ("nature.test", "/es/31", 0), ("radio.test", "/fr/2", 0), ("law.test", "/en/14", 0), ("www.farmers.test", "/en/7", 0),
    ("blog.mathematics.test", "/en/853/", 0), ("astronomy.test", "/en/728", 0),
)
#: Words of unwanted and of ordinary hosts; each is paired with the next but two of its list.
UNWANTED = ("casino poker slots bets betting jackpot roulette gamble lottery win prize bonus free cheap discount deals pills meds viagra pharma steroid "
            "diet detox loans credit cash money payday forex crypto ads adserver track tracker click clicks popup banner spam bulk farm xxx porn adult sex "
            "escort dating singles cams warez crack keygen torrent serial replica fake phishing malware hack cheats seo backlinks traffic").split()
ORDINARY = ("school college university library museum archive hospital clinic doctor garden kitchen recipe travel hiking river mountain village city council "
            "parliament court law justice science physics history language dictionary weather climate energy engineering software manual tutorial database "
            "music theatre cinema orchestra painting poetry novel books magazine news journal radio sports football chess family children parents "
            "church charity volunteer market bakery farmers forest animals birds").split()
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/{}", "/de/{}", "/fr/{}", "/es/{}", "/en/{}/", "/page/{}.html")


def paired(words: Sequence[str], label: int, turn: int = 0) -> list[tuple[str, str, int]]:
    """One url a word; hosts, prefixes and paths take turns, so that only the words tell the labels apart."""
    return [(f"{PREFIXES[n % 4]}{w}{'-' if n % 2 else ''}{words[(n + 3) % len(words)]}.test", PATHS[(n + turn) % 6].format(37 * (n + 59 * turn) % 4000), label)
            for n, w in enumerate(words)]


#: The labelled table the model is fitted on unless another is given; ordinary words come thrice, as most urls are ordinary.
LABELLED = (*HOSTS, *paired(UNWANTED, 1), *(row for turn in range(3) for row in paired(ORDINARY, 0, turn)))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// with A-Z lower-cased; both empty without it."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({u}, instr({u}, '://') + 3)".format(u="_url")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams; the two parts have marks of their own."""
    out = []
    for text in ("^" + host + "$", "/" + path + "$"):
        data = text.encode("utf-8", "surrogatepass")
        out += [zlib.crc32(data[i:i + n], text[0] == "^") % DIMENSIONS for n in SIZES for i in range(len(data) - n + 1)]
    return np.unique(np.array(out, np.int64))


def train(rows: Sequence[tuple[str, str, int]], steps: int = 300, decay: float = 0.02) -> tuple[float, np.ndarray]:
    """(bias, weights) of a regularised logistic regression; each url's features have length one."""
    x = [grams(h, p) for h, p, _ in rows]
    y = np.array([v for _, _, v in rows], float)
    who = np.repeat(np.arange(len(x)), [len(g) for g in x])
    flat = np.concatenate(x) if x else np.zeros(0, np.int64)
    value = 1 / np.sqrt(np.maximum([len(g) for g in x], 1))
    w, bias = np.zeros(DIMENSIONS), 0.0
    for _ in range(steps if len(y) else 0):
        z = np.bincount(who, w[flat], len(y)) * value + bias
        err = (y - 1 / (1 + np.exp(-z))) * value
        w += 2.0 * (np.bincount(flat, err[who], DIMENSIONS) - decay * w / len(y))
        bias += 2.0 * float((err / value).mean())
    return bias, w


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else NULLs."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def judge(df: DataFrame, url: str = "url", labelled: Sequence[tuple[str, str, int]] = LABELLED, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """`df` with host, path, rule, score (probability of being unwanted) and verdict (allow or block).

    NULL urls and urls without :// have an empty host and path and are judged by the model like any other; rows stay
    as they are, repeated ones included; columns named like a new one are replaced.  One pass, no shuffle; the
    weights (half a megabyte) are broadcast.
    """
    new = ["host", "path", "rule", "score", "verdict"]
    keep = [c for c in df.columns if c not in new]
    bias, weights = train(labelled)
    shared = df.sparkSession.sparkContext.broadcast(weights)
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url}`").cast("string").alias("_url"))
    host, path = parts(F.col("_url"))
    src = src.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))

    def run(batches):
        w = shared.value
        for b in batches:
            score = []
            for h, p in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                g = grams(h, p)
                z = bias + float(w[g].sum()) / max(len(g), 1) ** 0.5
                score.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*keep, "host", "path", "score"])

    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    out = src.mapInArrow(run, ", ".join([f"`{c}` {fields[c]}" for c in src.columns] + ["score double"]))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, learnt).alias("verdict"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
