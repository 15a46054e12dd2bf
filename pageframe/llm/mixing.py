"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``most``. Among all rates with which each source's words add up to its
target, those of least relative entropy to the even rate are an exponential tilt in the document's size:
``rate = most / (1 + (most - 1) * exp(-dual * size / scale))``, with one dual a source. Newton steps on the convex
dual find it: each is one aggregation over the counts of documents by source and size, kept inside a bracket. While one side
of the bracket is open the longest step doubles, and a step that does not halve the one before gives way to bisection.
Rates are then rounded into whole copies, from a source's largest documents to its smallest: those of one size take
together the nearest number of copies, and what that misses is shared out among the smaller ones by their words, so
that a source misses its target by half of its smallest documents, or of the smallest that can still make it up.
Copies stay beside the rate; only where large documents leave more than that allows may small ones take none or all.
Of documents of one size those that are first by a hash take one copy more.

Only DataFrame functions are used. Sums are exact decimals, so reruns agree to the last copy.

Defined cases: null text has size 0 and takes nothing, as has empty text; null is a source of its own, ordered last; a
source without words has target 0; repeated rows are documents of their own; documents of one size and hash
are taken by id, nulls first; a text of any length counts whole; an empty table gives an empty mix; other
columns of the input are ignored by ``mixed`` and kept, whatever their names, by ``repeated``. A source whose dual does
not converge in ``max_steps`` raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common


@dataclass(frozen=True)
class Mix:
    #: Weights that the sources take in turn, in the order of their names.
    weights: tuple[float, ...] = (5, 2, 1)
    #: Words of the mix as a share of all words, and the most a source or document may be repeated.
    share: float = 1.5
    most: float = 2.0
    tolerance: float = 1e-8
    max_steps: int = 60
    #: Classes of the hash; only the documents of one class a source and size are ranked.
    bins: int = 1 << 14
    #: Counts of copies that are put together before they are added to a source's list of them.
    chunk: int = 1000


DEFAULT = Mix()


def _exact(x: Column) -> Column:
    return x.cast("decimal(32,6)")


def targets(sized: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """(key, source_size, cap, weight, target) of every source of (key, size): its share by weight, at most its cap, what is over the caps dealt again."""
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    placed = common.numbered(sources, [F.col("key")], "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("position") % len(mix.weights) + 1).cast("int"))
    sources = common.stored(placed.select("key", "source_size", (mix.most * F.col("source_size")).alias("cap"), weight.alias("weight")), "mix-weights")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while words:  # the level only rises, and each turn caps at least one more source
        full = F.col("weight") * level >= F.col("cap")
        filled, open_weight = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight or (reached := (mix.share * words - (filled or 0)) / open_weight) <= level:
            break
        level = reached
    return sources.withColumn("target", F.least("cap", F.col("weight") * level))


def _rate(dual: Column, size: Column, scale: Column, most: float) -> Column:
    return F.when(dual.isNull(), F.lit(most)).otherwise(most / (1 + (most - 1) * F.exp(-dual * size / scale)))


def duals(counts: DataFrame, sources: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """(key, source_size, target, scale, dual): the tilt of every source, null where it is filled to its cap; ``counts`` are of (key, size, n), no size 0."""
    scales = counts.groupBy("key").agg((F.sum(F.col("n") * _exact(F.col("size") * F.col("size"))) / F.sum(F.col("n") * F.col("size"))).cast("double").alias("scale"))
    filled = F.col("target") >= F.col("cap")
    start = sources.join(scales, "key", "left").select("key", "source_size", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.when(~filled, 0.0).alias("dual"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1e300).alias("move"))
    state, reach = common.stored(start, "mix-duals"), 4.0
    for _ in range(mix.max_steps):
        rate = _rate(F.col("dual"), F.col("size"), F.col("scale"), mix.most)
        got = F.col("n") * F.col("size") * rate
        slope = got * F.col("size") / F.col("scale") * (1 - rate / mix.most)
        sums = counts.join(state.where("dual IS NOT NULL").select("key", "dual", "scale"), "key").groupBy("key").agg(F.sum(_exact(got)).cast("double").alias("got"), F.sum(_exact(slope)).cast("double").alias("slope"))
        over = F.col("got") - F.col("target")
        low, high = F.when(over <= 0, F.col("dual")).otherwise(F.col("low")), F.when(over > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - F.greatest(F.lit(-reach), F.least(F.lit(reach), over / F.greatest("slope", F.lit(1e-9))))
        open_ = F.col("new_low").isNull() | F.col("new_high").isNull()
        inside = (F.col("newton") > F.col("new_low")) & (F.col("newton") < F.col("new_high")) & (F.abs(F.col("newton") - F.col("dual")) <= F.col("move") / 2)
        near = F.abs(over) <= mix.tolerance * F.col("target") + 1e-4
        moved = state.join(sums, "key", "left").select("*", low.alias("new_low"), high.alias("new_high"), newton.alias("newton"), F.coalesce(near, F.lit(True)).alias("near"))
        dual = F.when(F.col("near"), F.col("dual")).when(open_ | inside, F.col("newton")).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        went = F.when(open_, F.lit(1e300)).otherwise(F.abs(F.col("next") - F.col("dual")))
        moved = moved.withColumn("next", dual).withColumn("went", went)
        state = common.stored(moved.select("key", "source_size", "target", "scale", F.col("next").alias("dual"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("went").alias("move"), "near"), "mix-duals")
        if state.where("NOT near").isEmpty():
            return state.select("key", "source_size", "target", "scale", "dual")
        state, reach = state.drop("near"), 2 * reach
    if mix.max_steps > 0:
        raise ArithmeticError(f"a source's dual did not converge in {mix.max_steps} steps")
    return state.select("key", "source_size", "target", "scale", "dual")


def copies_by_size(counts: DataFrame, state: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """(key, size, rate, total): how often all documents of a source and size are taken together; ``state`` is of ``duals``.

    A source's different sizes, not its documents, are walked from the largest down, in one row. First copies
    are held beside the rate; if what is missed in the end is more than half of the smallest size, between none and all.
    """
    rate = F.least(F.lit(mix.most), _rate(F.col("dual"), F.col("size"), F.col("scale"), mix.most))
    rated = counts.join(state, "key").select("key", "target", F.struct("size", "n", rate.alias("rate")).alias("s"))
    sources = rated.groupBy("key").agg(F.first("target").alias("target"), F.sort_array(F.collect_list("s"), asc=False).alias("sizes"))
    words = lambda s: (s["n"] * s["size"]).cast("double")
    total = lambda of: F.aggregate("sizes", F.lit(0.0), lambda a, s: a + of(s))
    none = F.array().cast("array<bigint>")
    start = F.struct((F.col("target") - total(lambda s: words(s) * s["rate"])).alias("missed"), total(words).alias("rest"), none.alias("chunk"), F.array().cast("array<array<bigint>>").alias("chunks"))

    def walked(low, high) -> Column:
        def step(at: Column, s: Column) -> Column:
            want = (words(s) * s["rate"] + at["missed"] * words(s) / at["rest"]) / s["size"]
            taken = F.greatest(low(s) * s["n"], F.least(high(s) * s["n"], F.floor(want + 0.5))).cast("bigint")

            def after(t: Column) -> Column:
                chunk = F.concat(at["chunk"], F.array(t))
                full = F.size(at["chunk"]) + 1 >= mix.chunk
                return F.struct(
                    (at["missed"] + words(s) * s["rate"] - t * s["size"]).alias("missed"), (at["rest"] - words(s)).alias("rest"),
                    F.when(full, none).otherwise(chunk).alias("chunk"), F.when(full, F.concat(at["chunks"], F.array(chunk))).otherwise(at["chunks"]).alias("chunks"),
                )

            return common.let(taken, after)

        return F.aggregate("sizes", start, step)

    beside = walked(lambda s: F.floor(s["rate"]), lambda s: F.ceil(s["rate"]))
    least = F.element_at("sizes", -1)["size"]
    both = common.computed(sources, ["key", "sizes"], F.struct(beside.alias("near"), walked(lambda s: F.lit(0), lambda s: F.lit(int(mix.most))).alias("wide")))
    wide = (F.abs(F.col("near.missed")) > least / 2) & (F.abs(F.col("wide.missed")) < F.abs(F.col("near.missed")))
    chosen = both.select("key", "sizes", F.when(wide, F.col("wide")).otherwise(F.col("near")).alias("way"))
    taken = F.concat(F.flatten("way.chunks"), F.col("way.chunk"))
    each = chosen.select("key", F.inline(F.arrays_zip(F.col("sizes").alias("s"), taken.alias("total"))))
    return each.select("key", F.col("s.size").alias("size"), F.col("s.rate").alias("rate"), "total")


def mixed(docs: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): its size, its source's size and target, the copies and words the mix takes."""
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    chance = F.shiftrightunsigned("drawn", 11) / float(1 << 53)
    drawn = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("drawn"), key.alias("key"), common.n_words(F.col("text")).alias("size"))
    sized = common.stored(drawn.withColumn("bin", F.floor(chance * mix.bins).cast("int")), "mix-sizes")
    bins = common.stored(sized.groupBy("key", "size", "bin").agg(F.count("*").alias("c")), "mix-bins")
    counts = common.stored(bins.where("size > 0").groupBy("key", "size").agg(F.sum("c").alias("n")), "mix-counts")
    state = common.stored(duals(counts, targets(sized, mix), mix), "mix-state")
    plan = copies_by_size(counts, state, mix).join(counts, ["key", "size"]).select("key", "size", "rate", F.expr("total div n").alias("whole"), (F.col("total") % F.col("n")).alias("more"))
    plan = common.stored(plan, "mix-plan")
    # Where the documents of one size that take one more end: the class of the hash, and how many come before it.
    until = F.sum("c").over(Window.partitionBy("key", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most `bins` rows
    cuts = bins.join(plan.where("more > 0").select("key", "size", "more"), ["key", "size"]).withColumn("until", until).where("until >= more AND until - c < more").select("key", "size", F.col("bin").alias("cut"), (F.col("until") - F.col("c")).alias("before"))
    plan = common.stored(plan.join(cuts, ["key", "size"], "left"), "mix-plan")
    placed = sized.join(plan, ["key", "size"], "left").join(state.select("key", "source_size", "target"), "key")
    ranked = Window.partitionBy("key", "size").orderBy("drawn", "doc_id")
    last = placed.where("bin = cut").withColumn("extra", (F.col("before") + F.row_number().over(ranked) <= F.col("more")).cast("int"))
    rest = placed.where("bin <> cut OR cut IS NULL").withColumn("extra", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0)))
    out = rest.unionByName(last).withColumn("copies", (F.coalesce("whole", F.lit(0)) + F.col("extra")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def repeated(docs: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns. Rows equal in id and text are repeated alike."""
    key, n, copy = common.free_names(docs, 3)
    keyed = docs.withColumn(key, common.two_hashes("doc_id", "text", "source"))
    copies = mixed(keyed.select(F.col(key).alias("doc_id"), "text", "source"), mix).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(n))
    taken = keyed.join(copies.where(F.col(n) > 0), key)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(key, n, copy)
