"""Mixing sources to target shares of the whole, measured in tokens.

Every document has a 64-bit hash of its id. A source that is to give ``copies + a fraction`` of itself gives all its
documents ``copies`` times and those below a hash threshold once more. The threshold is found with histograms: tokens
are summed by source and by the leading bits of the hash, the bucket in which the budget runs out is opened with the
next bits, and so on until it cannot be divided. Nothing is sorted but the buckets of a source, and all of it is done by
the executors for any number of sources: the driver learns only how many are still open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import join_counted
from tidemark.session import cut

#: Bits of the hash that each histogram resolves.
BITS = 10


def _asked(targets: DataFrame) -> DataFrame:
    """One row a target source: source, target, most."""
    known = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
    first = known.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    return first.select("source", F.col("t.target_share").alias("target"), F.col("t.max_repeats").cast("long").alias("most"))


def plan(sized: DataFrame, targets: DataFrame, total: int | str | None = None) -> DataFrame:
    """How often each source is repeated: source, target, most, available, budget, copies, below.

    ``sized`` has source, hash (0 to 2**63 - 1) and n_tokens; ``targets`` source, target_share and max_repeats. Documents
    with a hash less than ``below`` give one copy more than ``copies``. Without ``total`` the whole is as large as it can
    be with every share exact: sources without tokens are left out and the others' shares are scaled to sum to 1. With
    ``total``, or ``"all"`` for the tokens of all target sources, a source that is too small gives all it may and falls
    short. Null or non-positive shares and repeats give
    nothing; a source named twice counts once, with its first share by value; sources without a target give nothing.
    """
    sums = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("available"))
    shares = cut(_asked(targets).join(sums, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))))
    live = shares.where(F.col("available") > 0)
    scale, tokens, sources = live.agg(F.sum("target"), F.sum("available"), F.count(F.lit(1))).first()
    if scale is None:
        return shares.select("*", F.lit(0.0).alias("budget"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("below"))
    part = F.col("target") / F.lit(scale)
    whole = tokens if total == "all" else total if total is not None else live.agg(F.min(F.col("available") * F.col("most") / part)).first()[0]
    budget = F.least(F.lit(float(whole)) * part, (F.col("available") * F.col("most")).cast("double"))
    shares = shares.withColumn("budget", F.when(F.col("available") > 0, budget).otherwise(0.0))
    copies = F.least(F.floor(F.try_divide("budget", "available") + 1e-12).cast("long"), "most")
    shares = shares.withColumn("copies", F.coalesce(copies, F.lit(0).cast("long")))
    below = _thresholds(sized, shares.where((F.col("budget") > 0) & (F.col("copies") < F.col("most"))), sources)
    return cut(shares.join(below, "source", "left").withColumn("below", F.coalesce("below", F.lit(0).cast("long"))))


def _thresholds(sized: DataFrame, shares: DataFrame, n: int) -> DataFrame:
    """source and below: up to which hash the documents of a source fit into what its whole copies leave of its budget.
    ``n`` is at least the number of shares."""
    rest = F.col("budget") - F.col("copies") * F.col("available")
    still = shares.select("source", rest.alias("rest"), F.lit(0).cast("long").alias("low"))
    done, shift = None, 63
    by = Window.partitionBy("source").orderBy("bucket")
    while n:
        # of each source a bucket is open: all of it at first, then the one in which the budget ran out
        step = min(BITS, shift)
        shift -= step
        inside = join_counted(sized.select("source", "hash", "n_tokens"), still, ["source"], "inner", F.col("hash"), rows=n)
        inside = inside.where(F.col("hash").between(F.col("low"), F.col("low") + F.lit((1 << (shift + step)) - 1)))
        counted = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("rest").alias("rest")
        )  # at most 2**BITS rows a source, so the window below is small
        summed = counted.withColumn("upto", F.sum("n").over(by))
        over = F.col("upto") > F.col("rest")
        full = F.struct(F.col("bucket"), F.col("docs"), (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"))
        found = summed.groupBy("source").agg(F.min(F.when(over, full)).alias("at"), F.max("bucket").alias("last"))
        found = cut(found.select(
            "source",
            F.coalesce(F.shiftleft(F.col("at.bucket"), shift), _end(F.col("last"), shift)).alias("low"),
            F.col("at.rest").alias("rest"),
            (F.col("at").isNotNull() & (F.col("at.docs") > 1) & F.lit(shift > 0)).alias("open"),
        ))
        closed = found.where(~F.col("open")).select("source", F.col("low").alias("below"))
        done = closed if done is None else done.unionByName(closed)
        still = found.where("open").select("source", "rest", "low")
        n = still.count()
    return done if done is not None else still.select("source", F.col("low").alias("below"))


def _end(bucket, shift: int):
    """The first hash beyond a bucket; that of the last bucket is no 63-bit number, so the greatest hash stands for it."""
    top = (1 << (63 - shift)) - 1
    return F.when(bucket >= top, F.lit(2**63 - 1)).otherwise(F.shiftleft(F.least(bucket, F.lit(top - 1)) + 1, shift))


def mix(sized: DataFrame, shares: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents of the mixture: ``key``, source, n_tokens and copies (at least 1)."""
    given = shares.where(F.col("budget") > 0).select("source", F.col("copies").alias("__c"), F.col("most").alias("__m"), F.col("below").alias("__b"))
    rows = join_counted(sized, given, ["source"], "inner", F.col("hash"))
    extra = F.when((F.col("hash") < F.col("__b")) & (F.col("__c") < F.col("__m")), 1).otherwise(0)
    rows = rows.withColumn("copies", (F.col("__c") + extra).cast("int"))
    return rows.where(F.col("copies") > 0).select(key, "source", "n_tokens", "copies")


def sized_documents(counts: DataFrame, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """``counts`` (key, source, n_tokens) with the hash, written once: tokens are counted a single time."""
    return cut(counts.withColumn("hash", F.xxhash64(F.col(key), F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))))


def report(mixture: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of either side: the target share, its documents and tokens, what it gives and its actual share."""
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    give = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most_copies"))
    whole = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("whole")).scalar()
    asked = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return (
        have.join(asked, "source", "full")
        .join(give, "source", "left")
        .select(
            "source",
            zero("target_share", "double"),
            zero("max_repeats", "int"),
            zero("documents", "long"),
            zero("tokens", "long"),
            zero("given", "long"),
            zero("most_copies", "int"),
            F.coalesce(F.try_divide(F.col("given"), whole), F.lit(0.0)).alias("actual_share"),
        )
    )
