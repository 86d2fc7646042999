"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import maybe_broadcast, stored
from ._tokens import encoder

#: Exponents that one pass over the sources tries, and passes.
GRID, PASSES = 32, 8
#: Largest exponent that is tried.
STEEPEST = 1024


def token_count(tokenizer: str = "byte_bpe_50k.json"):
    """A column function: the number of ids of a text; null counts as empty."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        enc = encoder(tokenizer)
        return pa.array([len(enc.ids(t.as_py())) for t in texts], pa.int64())

    return count


def _sums(sources: DataFrame, top: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent x: the sums of q ** x and of q ** x * ln q over the sources (t tokens), q = t / top."""
    log = F.log(F.col("t") / F.lit(float(top)))
    cols = [c for x in exponents for c in (F.sum(F.exp(log * x)), F.sum(F.exp(log * x) * log))]
    row = sources.where("t > 0").agg(*cols).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(exponents))]


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    """The smallest exponent at which the weights have at most ``target_entropy`` nats and no source is read more than ``max_repeat`` times.

    sources: (t long), the tokens of each.  budget: tokens of the mixture; None: the least that reads every source once.
    The entropy falls as the exponent rises.  An interval is searched by bisection, GRID points at a time; a pass is one
    aggregate over the sources.  An exponent over 1 is steeper than the natural shares.  Raises ValueError if no exponent
    up to STEEPEST will do.
    """
    low, high, total = sources.where("t > 0").agg(F.min("t"), F.max("t"), F.sum("t")).first()
    if not total:
        return 0.0

    def entropy(x: float, z: float, s: float) -> bool:
        return target_entropy is None or math.log(z) - x * s / z <= target_entropy + 1e-12

    def repeat(x: float, z: float, s: float) -> bool:
        # t tokens are read size * share(t) / t times: the smallest source most often up to x = 1, the largest beyond
        most, least = (low, high) if x <= 1 else (high, low)
        share = lambda t: math.exp(x * math.log(t / high)) / z
        size = budget if budget is not None else least / max(share(least), 1e-300)
        return max_repeat is None or size * share(most) / most <= max_repeat * (1 + 1e-12)

    def smallest(fine) -> float:
        tried = [0.0, 1.0, *(float(2**i) for i in range(1, STEEPEST.bit_length()))]
        good = [fine(x, *zs) for x, zs in zip(tried, _sums(sources, high, tried), strict=True)]
        if not any(good):
            return math.inf
        first = good.index(True)
        if not first:
            return 0.0
        lo, hi = tried[first - 1], tried[first]
        for _ in range(PASSES):
            points = [lo + (hi - lo) * i / (GRID + 1) for i in range(1, GRID + 1)]
            good = [*(fine(x, *zs) for x, zs in zip(points, _sums(sources, high, points), strict=True)), True]
            points = [lo, *points, hi]
            lo, hi = points[good.index(True)], points[good.index(True) + 1]
        return hi

    x = max(smallest(entropy), smallest(repeat))
    if x == math.inf or not (entropy(x, *(zs := _sums(sources, high, [x])[0])) and repeat(x, *zs)):
        raise ValueError(f"no exponent up to {STEEPEST} gives at most {target_entropy} nats and {max_repeat} readings of a source")
    return x


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget: float | str | None = "all", tokens: Column | None = None, tokenizer: str = "byte_bpe_50k.json", seed: int = 0, block_rows: int = 1024) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with rows repeated or left out to meet temperature weights.

    Source token shares are raised to an exponent, found by bisection: the flattest mixture with at most
    ``target_entropy`` nats and at most ``max_repeat`` readings of any source; ValueError if there is none.  budget:
    tokens of the mixture, "all" for as many as ``docs`` has, "cover" for the least that reads every source at least
    once, so that no document is lost.  tokens: another count than that of the ids of ``tokenizer``.

    The weights are realised by budgeted block permutations: rows are dealt over blocks of about ``block_rows`` by hash.
    A source's whole readings take every row; its last, partial reading takes blocks in the order of that reading's
    permutation until the budget is met, and of the block in which that happens, rows in hash order.  So a source's plan
    is a few numbers, a hot source needs no sort of its rows, and a row knows its copies by itself.  Sources are a table
    like any other: their number isn't limited and they don't pass the driver.

    New columns: epoch int (from 0, one row for each copy), mix_key double (rising order interleaves the sources in
    proportion, each reading in its own block order), tokens long.  They replace columns of the same name; all others,
    whatever their names, pass through.  Cases: null source is a source of its own; null and empty texts have no tokens
    and follow their block; a source without tokens is read once; repeated rows are taken or left alike; an empty table
    gives an empty result.
    """
    docs = docs.drop("epoch", "mix_key", "tokens")
    count = tokens if tokens is not None else token_count(tokenizer)(F.col("text").cast("string"))
    u = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text")
    # the row as it came is one column, so that names in it can't clash with those below
    rows = stored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").alias("s"), u.alias("u"), count.cast("long").alias("tokens")), "mix-rows")
    sources = stored(rows.groupBy("s").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "mix-sources")
    high, total = sources.agg(F.max("t"), F.sum("t")).first()
    want = None if budget == "cover" else float((total or 0) if budget in (None, "all") else budget)
    x = find_exponent(sources, target_entropy, max_repeat, want)
    # tokens a source is given in proportion to its weight; "cover" scales them so that the least read source is read once
    weight = F.when(F.col("t") > 0, F.exp(F.log(F.col("t") / F.lit(float(high or 1))) * x)).otherwise(0.0)
    weights = sources.withColumn("w", weight)
    z, cover = weights.agg(F.sum("w"), F.max(F.when(F.col("t") > 0, F.col("t") / F.col("w")))).first()
    scale = (cover or 0.0) if want is None else want / (z or 1.0)
    plan = weights.withColumn("reads", F.when(F.col("t") > 0, F.col("w") * F.lit(float(scale)) / F.col("t")).otherwise(1.0))
    plan = plan.withColumn("whole", F.floor(F.col("reads") + 1e-9).cast("int"))
    plan = plan.select(F.col("s").alias("source"), "reads", "whole", (F.greatest(F.col("reads") - F.col("whole"), F.lit(0.0)) * F.col("t")).alias("need"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    plan = maybe_broadcast(stored(plan, "mix-plan"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def order(epoch, block):
        """Place in [0, 1) of a block in the permutation of a reading."""
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("s"), epoch.cast("int"), block.cast("int")), 11) / F.lit(float(1 << 53))

    planned = rows.join(plan, same("s", "source")).drop("source").withColumn("block", F.pmod(F.col("u"), F.col("blocks")))
    blocks = planned.where("need > 0").groupBy("s", "whole", "need", "block").agg(F.sum("tokens").alias("t"))
    blocks = blocks.withColumn("at", order(F.col("whole"), F.col("block")))
    blocks = blocks.withColumn("to", F.sum("t").over(Window.partitionBy("s").orderBy("at", "block")))
    last = blocks.where("to > need and to - t <= need").groupBy("s").agg(F.min(F.struct("at", "block", (F.col("need") - F.col("to") + F.col("t")).alias("left"))).alias("b"))
    last = stored(last.select(F.col("s").alias("source"), F.col("b.at").alias("last_at"), F.col("b.block").alias("last"), "b.left"), "mix-last")
    inside = planned.select("s", "u", "tokens", "block").join(maybe_broadcast(last), same("s", "source") & (F.col("block") == F.col("last")))
    inside = inside.groupBy("s", "left", "u").agg(F.sum("tokens").alias("t"))
    inside = inside.withColumn("to", F.sum("t").over(Window.partitionBy("s").orderBy("u")))
    cut = stored(inside.where("to <= left").groupBy("s").agg(F.max("u").alias("cut")), "mix-cut")
    last = last.join(maybe_broadcast(cut), same("source", "s"), "left").select("source", "last_at", "last", "cut")

    out = planned.join(maybe_broadcast(last), same("s", "source"), "left")
    at = order(F.col("whole"), F.col("block"))
    more = (F.col("need") > 0) & (F.col("last").isNull() | (at < F.col("last_at")) | ((F.col("block") == F.col("last")) & (F.col("u") <= F.col("cut"))))
    copies = F.col("whole") + F.coalesce(more, F.lit(False)).cast("int")
    out = out.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1))))
    out = out.withColumn("mix_key", (F.col("epoch") + order(F.col("epoch"), F.col("block"))) / F.greatest("reads", F.lit(1e-12)))
    return out.select("row.*", "epoch", "mix_key", "tokens")
