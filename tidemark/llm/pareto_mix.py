"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words.  A document's expected copies are in
proportion to its weight and to what its source needs, `most` at the highest.
The whole part of them is certain; the fraction left over is its inclusion
probability p for one more copy.  Documents are ranked by random odds over
inclusion odds, (u/(1-u)) / (p/(1-p)), with u hashed from the row, and the
first of each source are taken until they hold the words still needed: a sample
of fixed size with unequal probabilities.

The cut is found without sorting a source in one place: ranks become integers,
word sums are taken by source and leading bits (at most 1024 rows a source and
level), and each level narrows the cut by ten bits.  A source with a third of
all rows is therefore aggregated in parallel like any other.

Cases: null texts have size 0; a null source is a source, last in order; sources
without words have target 0; equal rows share a rank and are taken together;
an empty table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _runtime

WEIGHTS = (5, 2, 1)
LEVELS, BITS = 4, 10
#: Sources whose few numbers may be broadcast: some MB.
BROADCAST = 50_000
OUT = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Targets of sources. sizes: source, source_size, one row a source.

    Sources in order of code points, null last, weigh `weights` in turn.  A
    source stops at most x its size, and what it leaves over goes to the others
    by weight, until none is above.  Works on one row a source; only sums reach
    the driver.
    """
    spark = sizes.sparkSession
    order = sizes.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size").rdd.zipWithIndex()
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("weight", T.DoubleType())])
    ranked = _runtime.table(spark.createDataFrame(order.map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)]))), schema), f"{_runtime.run_dir(spark, 'mix')}/sources")
    top = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= top
        s = ranked.agg(F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        new = (total - s["full"]) / s["open"] if s["open"] > 0 else level
        if new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), top))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """What decides a document's copies, one row a source: source, source_size, target, scale, cut, most, seed.

    weight: a document's own weight, over 0; by default the logarithm of its size.
    """
    run = _runtime.run_dir(docs.sparkSession, "mix")
    sized = _runtime.table(_measured(docs, weight, seed).select("source", "_size", "_w", "_u"), f"{run}/sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    sized = sized.where("_size > 0")
    scales = _scales(sized, targets, most, run)
    cuts = _cuts(_coded(_join(sized, scales, True), most), scales, run)
    return _runtime.table(_join(scales, cuts).withColumns({"most": F.lit(float(most)), "cut": F.coalesce("cut", F.lit(-1))}), f"{run}/plan")


def copies(docs: DataFrame, plan: DataFrame, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies and taken (words taken, repeats counted)."""
    kept = [c for c in docs.columns if c not in OUT]
    rows = _coded(_join(_measured(docs, weight, seed, kept), plan, True), F.col("most"))
    n = F.when(F.col("_size") > 0, F.floor("_whole") + (F.col("_code") <= F.col("cut")).cast("int")).otherwise(0).cast("long")
    return rows.withColumn("copies", n).select(*[F.col(f"`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: each document as many times as it was taken, with the columns of docs."""
    taken = copies(docs, plan(docs, weights, share, most, weight, seed), weight, seed)
    return taken.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _measured(docs: DataFrame, weight: Column | None, seed: int, kept=()) -> DataFrame:
    size = size_of(F.col("text"))
    w = F.greatest((weight if weight is not None else F.log1p(size)).cast("double"), F.lit(1e-9))
    extra = {"_size": size, "_w": F.coalesce(w, F.lit(1e-9)), "_u": F.xxhash64(F.lit(seed), "doc_id", "source", "text")}
    return docs.select(*([F.col(f"`{c}`") for c in kept] or [F.col("source").cast("string").alias("source")]), *[v.alias(k) for k, v in extra.items()])


def _join(rows: DataFrame, sources: DataFrame, check: bool = False) -> DataFrame:
    """Rows with their source's columns; null is a source like any other.

    With check, sources is a written table: up to BROADCAST rows it is broadcast, so that rows
    of a hot source stay where they are, and beyond that Spark joins by shuffle
    and splits hot partitions.
    """
    right = sources.withColumnRenamed("source", "_s")
    if check and sources.count() <= BROADCAST:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").cast("string").eqNullSafe(F.col("_s")), "left").drop("_s")


def _scales(sized: DataFrame, targets: DataFrame, most: float, run: str) -> DataFrame:
    """scale: copies a unit of weight, so that sum of size * min(most, scale * weight) is the target."""
    state = _runtime.table(targets.withColumn("scale", F.lit(0.0)), f"{run}/scale")
    for i in range(40):
        full = F.col("_w") * F.col("scale") >= most
        sums = _join(sized, state.select("source", "scale"), True).groupBy("source").agg(F.coalesce(F.sum(F.when(full, F.col("_size"))), F.lit(0)).alias("_full"), F.coalesce(F.sum(F.when(~full, F.col("_size") * F.col("_w"))), F.lit(0.0)).alias("_open"))
        new = F.when(F.col("_open") > 0, (F.col("target") - most * F.col("_full")) / F.col("_open")).otherwise(F.col("scale"))
        state = _join(state, sums).withColumn("_new", F.coalesce(F.greatest(new, "scale"), F.lit(0.0)))
        state = _runtime.table(state.select("source", "source_size", "target", F.col("_new").alias("scale"), (F.col("_new") > F.col("scale") * (1 + 1e-12)).alias("_moved")), f"{run}/scale-{i}")
        if not state.where("_moved").head(1):
            break
    return state.drop("_moved")


def _coded(rows: DataFrame, most) -> DataFrame:
    """_whole: certain copies; _code: the Pareto rank of the fraction left, as a 40-bit integer."""
    e = F.least(F.col("scale") * F.col("_w"), most if isinstance(most, Column) else F.lit(float(most)))
    rows = rows.withColumn("_whole", F.floor(e + 1e-9)).withColumn("_p", F.greatest(e - F.col("_whole"), F.lit(0.0)))
    u = (F.shiftrightunsigned("_u", 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    last = (1 << LEVELS * BITS) - 1
    code = F.when(F.col("_p") > 1e-9, F.least(F.floor(odds / (1 + odds) * float(last)), F.lit(last - 1))).otherwise(last)
    return rows.withColumn("_code", code.cast("long"))


def _cuts(coded: DataFrame, scales: DataFrame, run: str) -> DataFrame:
    """cut: documents of a source with a code up to it get one more copy."""
    from pyspark.sql import Window

    certain = coded.groupBy("source").agg(F.sum(F.col("_whole") * F.col("_size")).alias("_certain"))
    state = _join(scales.select("source", "target"), certain).select("source", (F.col("target") - F.coalesce("_certain", F.lit(0))).alias("need"), F.lit(0).cast("long").alias("prefix"))
    rows = coded.where(F.col("_code") < (1 << LEVELS * BITS) - 1).select("source", "_size", "_code")
    for level in range(LEVELS):
        low = (LEVELS - 1 - level) * BITS
        own = _join(rows, state.select("source", "prefix"), True).where(F.shiftright("_code", low + BITS) == F.col("prefix"))
        sums = own.groupBy("source", F.shiftright("_code", low).alias("b")).agg(F.sum("_size").alias("g"))
        w = Window.partitionBy("source").orderBy("b")
        upto = sums.withColumn("upto", F.sum("g").over(w)).withColumn("next", F.lead("b").over(w))
        upto = _join(upto, state.select("source", "need"))
        hit = upto.where((F.col("upto") >= F.col("need")) | F.col("next").isNull()).groupBy("source").agg(F.min_by(F.struct("b", "g", "upto"), "b").alias("x"))
        left = F.col("need") - F.col("x.upto") + F.col("x.g")
        state = _join(state.select("source", "need"), hit.select("source", "x")).where(F.col("x").isNotNull())
        state = _runtime.table(state.select("source", left.alias("need"), F.col("x.b").alias("prefix"), F.col("x.g").alias("g")), f"{run}/cut-{level}")
    # the last group goes in where that comes nearer to what is needed
    return state.select("source", F.when(2 * F.col("need") > F.col("g"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
