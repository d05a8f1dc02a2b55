"""Mixing sources to target weights with DataFrame operations only.

Words are laid end to end within each source and cut into blocks of fixed length.  The mix
is a number of slots in shards of equal size; each shard draws how many of its slots go to each
source, slots of a source are numbered through, and a pseudorandom permutation of the source's
block numbers turns slot numbers into blocks.  A block that several slots name is taken as often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 32
SHARD = 4096
ROUNDS = 8
#: Two primes near 2^31 and 2^30 and a multiplier for the pseudorandom numbers; any such values do.
P1, P2, A1 = 2147483629, 1073741789, 1103515245
BUCKETS = 4096
#: More sources than this are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def scramble(x: str, key: str) -> str:
    """SQL for a pseudorandom number in [0, P2) from two numbers; runs alike on any engine with 64-bit integers."""
    t = f"((CAST({x} AS BIGINT) % {P1}) * {A1} + (CAST({key} AS BIGINT) % {P1}) * 40503 + 12345) % {P1}"
    t = f"(({t}) * (({t}) % 65521 + 1) + 97) % {P1}"
    return f"((({t}) * 48271 + 11) % {P2})"


def permute(df: DataFrame, keep: Sequence[str], seed: int) -> DataFrame:
    """Replace x by its place in a permutation of [0, blocks) that (number, turn) selects.

    Swap-or-not: each round pairs x with another place and swaps if a bit of the pair's higher place says so.  Every
    round is a projection of its own, so that Spark compiles it.
    """
    cols = [c for c in keep if c != "x"]
    for r in range(ROUNDS):
        k = f"(((number * 104729 + turn * 1299709 + {7919 * (seed + r)}) % {P1}) * {A1} + 12345) % {P1}"
        df = df.selectExpr(*cols, "x", f"(({k}) % blocks + blocks - x) % blocks AS p", f"{k} AS k")
        bit = f"((((greatest(x, p) % {P1}) * {A1 + 7919 * r} + k) % {P1}) DIV 64) % 2"
        df = df.selectExpr(*cols, f"CASE WHEN {bit} = 0 THEN p ELSE x END AS x")
    return df


def _prefix(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str, value: str, into: str) -> DataFrame:
    """Sum of `value` over the rows before, by `keys`, in the order of (bucket, order).

    A window inside each bucket, plus one over the bucket totals: no task holds a whole key.
    """
    by, cols = ", ".join(keys), ", ".join(order)
    inside = df.withColumn(into, F.expr(f"coalesce(sum({value}) OVER (PARTITION BY {by}, {bucket} ORDER BY {cols} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total")).withColumn("_before", F.expr(
        f"coalesce(sum(_total) OVER (PARTITION BY {by} ORDER BY {bucket} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    return inside.join(totals.select(*keys, bucket, "_before"), [*keys, bucket]).withColumn(into, F.col(into) + F.col("_before")).drop("_before")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, size) -> number, weight, target: `share` of all sizes by weight, none above cap x size.

    Sources get the weights in turn by code point order, NULL last.  Capped sources are those of lowest
    cap / weight; one running sum over the sources in that order gives the level at which the rest
    share what is left, which is where repeated resharing ends.
    """
    turn = "CAST(element_at(array({}), CAST(number % {} AS INT) + 1) AS DOUBLE)".format(", ".join(map(str, weights)), len(weights))
    s = (sizes.withColumn("number", F.expr("CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT)")).withColumn("weight", F.expr(turn))
         .withColumn("most", F.col("source_size") * F.lit(float(cap))))
    s = (s.withColumn("ratio", F.expr("most / weight")).withColumn("all_words", F.expr(f"sum(source_size) OVER () * {share}D"))
         .withColumn("capped", F.expr("coalesce(sum(most) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"))
         .withColumn("open", F.expr("sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
         .withColumn("level", F.expr("(all_words - capped) / open")))
    s = s.withColumn("final", F.expr(
        "coalesce((min(CASE WHEN level <= ratio THEN struct(ratio, number, level) END) OVER ()).level, max(ratio) OVER ())"))
    return s.select("source", "number", "source_size", F.expr("least(most, final * weight)").alias("target"))


def block_counts(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(number, block, times): how often the mix takes each block of each source.

    A source's chance is its target over the mean length of its blocks.  Per shard the whole part of
    chance x slots is given out as it stands and the slots left over are drawn multinomially, so the
    counts of all shards stay close to the targets.
    """
    n = sources.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) DIV {block}"))
    n = n.withColumn("wanted", F.expr("target * blocks / source_size")).withColumn("total", F.expr("sum(wanted) OVER ()"))
    n = n.withColumn("slots", F.expr("CAST(round(total) AS BIGINT)")).withColumn("chance", F.expr("wanted / total"))
    edge = n.select("number", "blocks", "slots", "chance")
    # shards of full length and the last one differ in length only; two rows of parameters a source
    kinds = edge.select("*", F.explode(F.expr(f"array(CAST({shard} AS BIGINT), slots % {shard})")).alias("length")).where("length > 0")
    kinds = kinds.groupBy("number", "blocks", "slots", "chance", "length").agg(F.lit(0).alias("_")).drop("_")
    kinds = kinds.withColumn("whole", F.expr("CAST(floor(chance * length) AS BIGINT)")).withColumn("rest", F.expr("chance * length - whole"))
    kinds = (kinds.withColumn("to", F.expr("sum(rest) OVER (PARTITION BY length ORDER BY number ROWS UNBOUNDED PRECEDING)"))
             .withColumn("from", F.col("to") - F.col("rest"))
             .withColumn("left", F.expr("length - sum(whole) OVER (PARTITION BY length)"))
             .withColumn("span", F.expr("max(to) OVER (PARTITION BY length)"))
             .withColumn("last", F.expr("max(number) OVER (PARTITION BY length)")))
    kinds = stored(kinds)
    per = kinds.groupBy("length").agg(F.max("slots").alias("slots"), F.max("left").alias("left"))
    shards = per.select("length", "left", F.explode(F.expr(
        f"CASE WHEN length = {shard} AND slots >= {shard} THEN sequence(0L, slots DIV {shard} - 1) "
        f"WHEN length = slots % {shard} THEN array(slots DIV {shard}) ELSE CAST(array() AS ARRAY<BIGINT>) END")).alias("shard"))
    shards = stored(shards)
    draws = shards.where("`left` > 0").select("length", "shard", F.explode(F.expr("sequence(1L, `left`)")).alias("draw"))
    draws = draws.withColumn("u", F.expr(f"({scramble(f'shard * 8191 + draw', str(seed + 5))} + 0.5D) / {P2}"))
    hit = draws.join(kinds.select("length", "number", "from", "to", "span", "last"), "length").where(
        "u * span >= `from` AND (u * span < to OR number = last)")
    extra = hit.groupBy("shard", "number").agg(F.count(F.lit(1)).alias("extra"))
    counts = shards.join(kinds.select("length", "number", "whole"), "length").join(extra, ["shard", "number"], "left").select(
        "number", "shard", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("count"), F.expr(f"shard DIV {BUCKETS}").alias("bucket"))
    counts = _prefix(counts.where("count > 0"), ["number"], ["shard"], "bucket", "count", "first")
    # written out on both sides: filters and joins that Spark would derive through the rounds grow without bound
    counts = stored(counts.join(edge.select("number", "blocks"), "number").select("number", "blocks", "shard", "first", "count"))
    # a row stands for many slots, so its size says nothing: deal them over as many tasks as other shuffles
    counts = counts.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "shard")
    slot = counts.select("number", "blocks", F.explode(F.expr(
        f"CASE WHEN first < {CAP} * blocks THEN sequence(first, least(first + count, {CAP} * blocks) - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END")).alias("slot"))
    slot = permute(slot.selectExpr("number", "blocks", "slot DIV blocks AS turn", "slot % blocks AS x"), ["number", "blocks", "turn"], seed)
    return stored(slot.groupBy("number", F.col("x").alias("block")).agg(F.count(F.lit(1)).alias("times")))


def mix(df: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK,
        shard: int = SHARD, seed: int = 1) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, taken) for every row of `df` (doc_id, text, source).

    size counts words; NULL texts have none, and a document without words is not taken.  NULL sources
    are one source, the last.  NULL ids sort first within a source; repeated rows lie side by side and
    count each.  Other columns are not read.  The same table gives the same mix in any order of its rows.
    """
    docs = stored(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
                            F.col("source").cast("string").alias("source"), word_count().alias("size")))
    sources = stored(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    side = sources.withColumnRenamed("source", "named")
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    docs = docs.join(side, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    with_words = docs.where("size > 0").withColumn("bucket", F.expr(f"((coalesce(doc_id, 0) % 1048573 + 1048573) * 7919) % {BUCKETS}"))
    placed = _prefix(with_words, ["number"], ["doc_id", "size", "h"], "bucket", "size", "start")
    parts = placed.select("*", F.explode(F.expr(f"sequence(start DIV {block}, (start + size - 1) DIV {block})")).alias("block")).select(
        "number", "block", "start", F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})").alias("words"))
    taken = parts.join(block_counts(sources, block, shard, seed), ["number", "block"]).groupBy("number", "start").agg(
        F.sum(F.expr("words * times")).alias("taken"))
    full = placed.join(taken, ["number", "start"], "left").select(
        "doc_id", "h", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    none = docs.where("size = 0").select("doc_id", "h", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none)


def copies(df: DataFrame, **how) -> DataFrame:
    """Rows of `df` repeated as the mix takes them: taken / size, rounded up or down by a hash of the id.

    A document without words goes; of repeated rows each comes as often as the most taken one.  All columns stay.
    """
    got = mix(df, **how).where("taken > 0").withColumn("u", F.expr(f"({scramble('coalesce(doc_id, 0)', '77')} + 0.5D) / {P2}"))
    got = got.withColumn("times", F.expr("CAST(floor(taken / greatest(size, 1) + u) AS INT)")).where("times > 0")
    got = got.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("h").alias("_h")).agg(F.max("times").alias("_times"))
    keyed = df.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_h": F.xxhash64(F.coalesce("text", F.lit("")))})
    out = keyed.join(got, ["_id", "_h"]).withColumn("_turn", F.explode(F.expr("sequence(1, _times)")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
