"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams (64-bit hashes). All sets are cut at the same places of one global
n-gram order, rare ones first, into fragments; the overlaps of a pair are counted fragment by fragment, in separate
tasks, and summed per pair. Two documents link when their Jaccard similarity reaches ``percent``.

Which pairs are counted: documents of equal sets are one class from the start. Two sets that link share one of their
first ``n - ceil(t n) + 1`` n-grams in any global order, and n-grams that no other document has cannot be it. A first
order begins with a low quarter of the hash space, so only that quarter is shuffled to see which classes have such an
n-gram at all. Theirs alone are then ordered by rarity over the whole space, and the shared ones among the first of
each make candidate lists by n-gram.

Lists of at most ``few`` members are expanded into pairs. Of a longer list only pairs between components matter: where no
more than ``hubs`` members lie outside its commonest component, these are paired with all members. In the other long lists
members outside are compared with all members by size and place, which few pairs pass, and those pairs are counted. Only
where the comparisons or what passes are more than a multiple of the first lists' rows, lists are taken apart: the smallest sets, ``hubs`` of them, are
counted with the members that may link to them, and the last of them, the hub, with all members after it. Two of these
that link, at least one of them without a link to the hub, must share an n-gram that the hub lacks: if all they share were
in the hub, which is no larger than either, both would link to it. How many they must share beyond the hub follows from
their sizes and overlaps with it, so the first of each member's n-grams beyond the hub make new, shorter lists, and so
on; hubs only grow from list to list, so this ends. Components are found again after each turn that links any, and lists
within one are left out. After ``peels`` turns what is left is compared whole, which is
the exact way for data in which members keep sharing what their hubs lack. A turn before the first counts the members
of long lists with the set nearest to what the list's near copies have in common, to join near copies early.

Defined cases: null or empty text has no n-grams, links with nothing and is its own component; a text of fewer words
than ``width`` has one n-gram, all its words; rows that repeat a doc_id are one document with the links of all its
rows, each of its texts a set of its own; a null doc_id is returned with a null component and links with nothing; an
empty table gives an empty result; a text of any length is one set; ties are decided by the smallest doc_id; other
columns of the input are ignored by ``linked`` and kept, whatever their names, by ``one_of_each``.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common
from pageframe.llm.fingerprint import shingle_hashes


@dataclass(frozen=True)
class Join:
    width: int = 4
    percent: int = 85
    #: Where the order by rarity (and, as a fraction, hash) is cut into fragments: most n-grams that are shared at all are of two or three sets.
    cuts: tuple[float, ...] = (2.25, 2.5, 2.75, 3.0, 3.5, 4.0, 8.0)
    #: Hashes below this come first in the global order: a quarter of them.
    low: int = -(1 << 62)
    #: Classes to read again are broadcast while they take at most so many bytes; beyond, they are joined by a shuffle.
    broadcast_bytes: int = 64 << 20
    #: Members of the lists that are expanded into pairs.
    few: int = 8
    #: Sets of a longer list that are its hubs: the smallest ones, the last of which takes the list apart.
    hubs: int = 6
    #: Turns in which longer lists are taken apart by their hubs.
    peels: int = 12
    #: Rows of long lists are compared with each other, by size and place alone, while that makes at most so many comparisons a row of the first lists.
    compares: int = 64


#: Bytes of a class in a broadcast: its key, id and two hashes, with what Spark adds to a row.
ROW_BYTES = 96
DEFAULT = Join()
NEAR = Join(width=5, percent=80)


def folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def grams(text: Column, join: Join = DEFAULT) -> Column:
    """Ascending array of the distinct n-gram hashes of a text."""
    return F.sort_array(shingle_hashes(folded(text), join.width))


def _needed(n: Column, join: Join) -> Column:
    """How many of its first n-grams decide whether a set of ``n`` can link."""
    return n - F.expr(f"({join.percent} * n + 99) DIV 100") + 1


def _sizes_fit(a: Column, b: Column, join: Join) -> Column:
    return (100 * a >= join.percent * b) & (100 * b >= join.percent * a)


def classes(docs: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """Per row: its set's size, two hashes of the set, and the n-grams of it that may decide: the low ones, or all where those are too few."""

    def parts(h: Column) -> Column:
        low = F.filter(h, lambda x: x < join.low)
        enough = common.let(low, lambda some: F.when(F.size(some) >= F.size(h) - F.ceil(F.size(h) * join.percent / 100) + 1, some).otherwise(h))
        return F.struct(F.size(h).alias("n"), F.xxhash64(h).alias("s1"), F.xxhash64(F.lit(1), h).alias("s2"), enough.alias("first"))

    return common.stored(common.computed(docs.withColumn("t", common.two_hashes("text")), ["doc_id", "t"], common.let(grams(F.col("text"), join), parts)), "join-sets")


def repeats(sets: DataFrame) -> tuple[bool, bool]:
    """Whether a doc_id comes in several rows, and whether with different sets, so that it cannot name a class."""
    ends = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)])
    found = ends.where("rows > 1").agg(F.count("*").alias("n"), F.count_if(F.expr("min_s1 <> max_s1 OR min_s2 <> max_s2")).alias("mixed")).first()
    return found.n > 0, found.mixed > 0


def _key(doc_id: Column, s1: Column, s2: Column, mixed: bool) -> Column:
    """What names a class, in the order of its smallest doc_id: that alone, or with the set's hashes where ids have several sets."""
    return F.when(doc_id.isNotNull(), F.struct(doc_id.alias("id"), s1.alias("s1"), s2.alias("s2"))) if mixed else doc_id


def undecided(sets: DataFrame, join: Join = DEFAULT, again: bool = True, mixed: bool = True) -> DataFrame:
    """(rep, doc_id, s1, s2, n): classes, by their key and smallest doc_id, with an n-gram among their first ones that another row has too.

    Rows of equal sets count as others here: it only makes their class a candidate.
    """
    known = sets.where("n > 0 AND doc_id IS NOT NULL")
    once = known.dropDuplicates(["doc_id", "s1", "s2"]) if again else known
    shared = _shared(once.select(_key(F.col("doc_id"), F.col("s1"), F.col("s2"), mixed).alias("rep"), F.explode("first").alias("h")))
    is_low = F.col("h") < join.low
    sums = shared.groupBy("rep").agg(F.count_if(is_low).alias("low"), F.count_if(~is_low).alias("high"))
    reps = known.select("doc_id", "s1", "s2", "n", F.size(F.filter("first", lambda h: h < join.low)).alias("n_low")).groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("n_low").alias("n_low"))
    reps = reps.select(_key(F.col("doc_id"), F.col("s1"), F.col("s2"), mixed).alias("rep"), "doc_id", "s1", "s2", "n", "n_low").join(sums, "rep")
    # N-grams that no other row has come first in their zone; with a whole prefix of them a set links with none.
    open_ = reps.where((F.col("n_low") - F.col("low") < _needed(F.col("n"), join)) & ((F.col("low") > 0) | (F.col("n_low") < _needed(F.col("n"), join))))
    return common.stored(open_.select("rep", "doc_id", "s1", "s2", "n"), "join-open")


def _shared(each: DataFrame) -> DataFrame:
    """Rows whose n-gram ``h`` occurs again, with its count ``df``: counts are summed before they meet the rows, so that a
    very common n-gram is no task's burden; Spark splits its rows in the join."""
    return each.join(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "h")


def sets_of(docs: DataFrame, classes_: DataFrame, join: Join = DEFAULT, again: bool = True) -> DataFrame:
    """(rep, h) of the given classes (rep, doc_id, s1, s2), read from the texts again: one row each, though rows may repeat."""
    known = classes_.select("doc_id", F.struct("s1", "s2", "rep").alias("is"))
    small = classes_.count() * ROW_BYTES <= join.broadcast_bytes
    picked = docs.select("doc_id", "text").join(F.broadcast(known) if small else known, "doc_id")
    known_by = lambda h: F.struct(F.xxhash64(h).alias("t1"), F.xxhash64(F.lit(1), h).alias("t2"), h.alias("h"))
    found = common.computed(picked, ["doc_id", "is"], common.let(grams(F.col("text"), join), known_by)).where("t1 = is.s1 AND t2 = is.s2").select("is.rep", "h")
    return common.stored(found.dropDuplicates(["rep"]) if again else found, "join-whole")


def ordered(docs: DataFrame, open_: DataFrame, join: Join = DEFAULT, again: bool = True) -> DataFrame:
    """(rep, n, alone, held): of every undecided class the number of n-grams that no other has, and the others in the global
    order, by rarity among these classes and then by hash, as an array of fragments cut at the same places for all."""
    whole = sets_of(docs, open_, join, again)
    shared = _shared(whole.select("rep", F.explode("h").alias("h")))
    by_rep = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "h"))).alias("all"))  # at most a document's own n-grams
    at = lambda x: x["df"] + (x["h"] / 2.0**64 + 0.5)  # noqa: E731  grows along the order
    ends = [float("-inf"), *join.cuts, float("inf")]
    part = lambda low, end: F.transform(F.filter("all", lambda x: (at(x) > low) & (at(x) <= end)), lambda x: x["h"])
    held = by_rep.select("rep", F.size("all").alias("m"), F.array(*[part(low, end) for low, end in zip(ends, ends[1:], strict=False)]).alias("held"))
    out = common.stored(held.join(open_.select("rep", "n"), "rep").select("rep", "n", (F.col("n") - F.col("m")).alias("alone"), "held"), "join-held")
    common.forget(whole)
    return out


def candidates(held: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(key, rep, n, base, rem): the shared n-grams among the first ones of every class, in the global order.

    Two members that meet at their first common n-gram share ``base`` and ``rem`` n-grams at most, the smaller ones of both:
    what they may have shared elsewhere, and what is left of their sets from there on.
    """
    all_ = F.flatten("held")
    first = F.slice(all_, F.lit(1), F.greatest(_needed(F.col("n"), join) - F.col("alone"), F.lit(0)).cast("int"))
    each = held.select("rep", "n", F.size(all_).alias("m"), F.posexplode(first).alias("i", "key"))
    return common.stored(each.select("key", "rep", "n", F.lit(0).alias("base"), (F.col("m") - F.col("i")).alias("rem")), "join-lists")


def live(lists: DataFrame, labels: DataFrame | None, join: Join = DEFAULT) -> DataFrame:
    """The lists of more than one component, each row with its component and its list's number of members."""
    named = lists.withColumn("label", F.col("rep"))
    if labels is not None:
        named = lists.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    per = named.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("least"), F.max("label").alias("most"))
    return named.join(per.where("least <> most").select("key", "members"), "key")


def sided(rows: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """The lists of more than ``few`` members, each row with its list's ``home``, the commonest component, how many members are
    ``outside`` it, and ``hubs``: all of those where they are no more than that, else the smallest sets."""
    long = rows.where(F.col("members") > join.few)
    parts = long.groupBy("key", "label").agg(F.count("*").alias("part"))
    per = parts.groupBy("key").agg((F.sum("part") - F.max("part")).alias("outside"), F.max_by("label", F.struct("part", "label")).alias("home"))
    named = common.stored(long.join(per, "key"), "join-sided")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "rep"))  # Spark keeps as many of a list a task before it shuffles
    ranked = named.where((F.col("outside") > join.hubs) | (F.col("label") != F.col("home"))).withColumn("rank", rank).where(F.col("rank") <= join.hubs)
    out = common.stored(named.join(ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "rep", "base", "rem", "label"))).alias("hubs")), "key"), "join-long")
    common.forget(named)
    return out


def central_pairs(rows: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(a, b) with a < b: the two most frequent partners of each class among the central sets of its long lists.

    A list's central set in a size class is the one with the largest share of shared n-grams: of near copies, the one nearest to what they are copies of.
    """
    size_class = F.floor(F.log(F.col("n")) / -F.log(F.lit(join.percent / 100)))
    # A size class and the next one: sizes that fit may lie on both sides of a border.
    spread = rows.where(F.col("members") > join.few).select("*", F.explode(F.array(size_class, size_class + 1)).alias("sizes"))
    # Stored, so that its size is known: small, it is broadcast and no list is shuffled; large, Spark splits the lists in the join.
    central = common.stored(spread.groupBy("key", "sizes").agg(F.min(F.struct((1 - F.col("rem") / F.col("n")).alias("own"), "rep", "n", "rem", "label")).alias("to")), "join-central")
    offered = spread.join(central, ["key", "sizes"]).where((F.col("to.label") != F.col("label")) & _fits(join, F.col("n"), F.col("to.n"), F.least("rem", "to.rem")))
    votes = offered.groupBy("rep", F.col("to.rep").alias("to")).agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("votes"), "to"))  # at most a document's own lists
    return votes.withColumn("best", best).where("best <= 2").select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct()


def _fits(join: Join, n: Column, m: Column, most: Column) -> Column:
    """Whether sets of ``n`` and ``m`` n-grams that share ``most`` at most can link."""
    return _sizes_fit(n, m, join) & ((100 + join.percent) * most >= join.percent * (n + m))


def few_pairs(rows: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(a, b) with a < b of different components in the lists of ``few`` members at most, whose sizes and places let them link."""
    lists = rows.where(F.col("members") <= join.few).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "base", "rem", "label"))).alias("all"))

    def can(x: Column, y: Column) -> Column:
        return (x["label"] != y["label"]) & _fits(join, x["n"], y["n"], F.least(x["base"], y["base"]) + F.least(x["rem"], y["rem"]))

    after = lambda x, i: F.transform(F.filter(F.slice("all", i + 2, join.few), lambda y: can(x, y)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))
    return lists.select(F.inline(F.flatten(F.transform("all", after)))).distinct()


def joined_pairs(long: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(a, b) with a < b, once a list, of different components in the lists with more members outside than ``hubs``, whose sizes and
    places let them link: members outside are joined with all members, so what is compared is what lies between components."""
    wide = long.where(F.col("outside") > join.hubs)
    side = lambda rows, s, *more: rows.select("key", *more, *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "base", "rem", "label")])
    most = F.least("base_a", "base_b") + F.least("rem_a", "rem_b")
    once = (F.col("label_a") == F.col("home")) | (F.col("rep_a") < F.col("rep_b"))
    can = (F.col("label_a") != F.col("label_b")) & once & _fits(join, F.col("n_a"), F.col("n_b"), most)
    x, y = side(wide, "a", "home"), side(wide.where(F.col("label") != F.col("home")), "b").withColumnRenamed("key", "other")
    return x.join(y, (F.col("key") == F.col("other")) & can).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def _after(hub: Column) -> Column:
    return F.struct("n", "rep") > F.struct(hub["n"], hub["rep"])


def _may(hub: Column, join: Join) -> Column:
    """Whether a member and a hub of its list are of different components and may link."""
    return (hub["label"] != F.col("label")) & _fits(join, F.col("n"), hub["n"], F.least(F.col("base"), hub["base"]) + F.least(F.col("rem"), hub["rem"]))


def outside_pairs(long: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(a, b), a the larger set, of all that may link in the lists with no more members outside than ``hubs``: no more rows than hubs would make, and nothing is left."""
    once = lambda hub: (F.col("label") == F.col("home")) | _after(hub)
    each = long.where(F.col("outside") <= join.hubs).select("n", "rep", F.explode(F.filter("hubs", lambda hub: once(hub) & _may(hub, join))).alias("hub"))
    later = _after(F.col("hub"))
    return each.select(F.when(later, F.col("rep")).otherwise(F.col("hub.rep")).alias("a"), F.when(later, F.col("hub.rep")).otherwise(F.col("rep")).alias("b"))


def hub_pairs(long: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """(a, b, far) of the members of the lists with more members outside than ``hubs``: far ones with the last of their list's
    hubs, others with the hubs before it that are of other components and may link."""
    wide = long.where(F.col("outside") > join.hubs).withColumn("hub", F.element_at("hubs", -1))
    far = wide.where(_after(F.col("hub"))).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), F.lit(True).alias("far"))
    near = wide.select(F.col("rep").alias("a"), F.explode(F.filter("hubs", lambda hub: _after(hub) & _may(hub, join))).alias("b"))
    return far.union(near.select("a", "b.rep", F.lit(False)))


def overlaps(held: DataFrame, pairs: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """Stored (a, b, far, n_a, n_b, alone, shared, beyond) of pairs (a, b, far) of classes: partial overlaps by fragment of the
    order, summed per pair; and, of ``far`` pairs, a's shared n-grams ``beyond`` b, in order."""
    pairs = common.stored(pairs.groupBy("a", "b").agg(F.max("far").alias("far")), "join-pairs")
    small = pairs.count() * 2 * ROW_BYTES <= join.broadcast_bytes
    held_by = lambda side: held.join(F.broadcast(pairs.select(F.col(side).alias("rep"))) if small else pairs.select(F.col(side).alias("rep")), "rep", "left_semi")
    parts = lambda side: held_by(side).select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), "alone", F.posexplode("held").alias("part", f"some_{side}"))
    a, b = parts("a").where(F.size("some_a") > 0), parts("b").drop("alone")
    met = a.join(F.broadcast(pairs) if small else pairs, "a").join(b, ["b", "part"])
    own = F.when(F.col("far"), F.struct("part", F.array_except("some_a", "some_b").alias("own")))
    met = met.select("a", "b", "far", "n_a", "n_b", "alone", F.size(F.array_intersect("some_a", "some_b")).alias("shared"), own.alias("own"))
    beyond = F.flatten(F.transform(F.sort_array(F.collect_list("own")), lambda x: x["own"]))  # at most a's own n-grams
    out = common.stored(met.groupBy("a", "b", "far", "n_a", "n_b", "alone").agg(F.sum("shared").alias("shared"), beyond.alias("beyond")), "join-met")
    common.forget(pairs)
    return out


def rekeyed(met: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """New lists from members (a) and their hubs (b): the first of a's n-grams beyond the hub of which a partner must share one."""
    met = met.withColumn("mate", F.greatest(F.col("n_b"), F.expr(f"({join.percent} * n_a + 99) DIV 100")))  # a partner's least size
    owed = F.expr(f"({join.percent} * (n_a + mate) + {99 + join.percent}) DIV {100 + join.percent}") - F.col("shared")
    first = F.col("n_a") - F.col("shared") - F.greatest(owed, F.lit(1)) + 1 - F.col("alone")
    each = met.where("far").select("a", "b", "n_a", "shared", F.size("beyond").alias("m"), F.posexplode(F.slice("beyond", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("i", "h"))
    return each.select(F.xxhash64("b", "h").alias("key"), F.col("a").alias("rep"), F.col("n_a").alias("n"), F.col("shared").alias("base"), (F.col("m") - F.col("i")).alias("rem"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of (a, b), by alternating large and small stars.

    Each turn moves edges onto smaller nodes until every component is a star around its smallest; only the links'
    own rows are shuffled, hubs are aggregated before they meet, and each turn is written to the shared folder.
    """
    links = links.toDF("a", "b").where("a <> b")
    edges = common.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stored(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, edges = edges, common.stored(small, "components")
        common.forget(large, old)
        # Stars: a node points to one other, or is pointed to.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def joined(held: DataFrame, join: Join = DEFAULT) -> DataFrame | None:
    """(node, label): the components of all links, None if there is none."""
    linking = f"100 * shared >= {join.percent} * (n_a + n_b - shared)"
    links, labels = [], None

    def found(pairs: DataFrame) -> DataFrame:
        """The pairs' overlaps; of those that link, the ones between components are kept."""
        met = overlaps(held, pairs, join)
        new = met.where(linking).select("a", "b")
        if labels is not None:
            for end in ("a", "b"):
                new = new.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
            new = new.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        links.append(common.stored(new, "join-links"))
        return met

    def merged() -> DataFrame | None:
        every = labels
        for more in [x for x in links if not x.isEmpty()]:
            every = more if every is None else every.union(more)
        out = None if every is None else labels if every is labels else components(every)
        common.forget(*links)
        links.clear()
        return out

    plain = lambda pairs: pairs.withColumn("far", F.lit(False))
    lists = candidates(held, join)
    most = lists.count()
    rows = common.stored(live(lists, None, join), "join-live")
    met = found(plain(central_pairs(rows, join)))
    labels = merged()
    common.forget(rows, met)
    for turn in range(join.peels + 1):
        rows = common.stored(live(lists, labels, join), "join-live")
        common.forget(lists)
        long = sided(rows, join)
        pairs = plain(few_pairs(rows, join).union(outside_pairs(long, join)))
        between = long.where(F.col("outside") > join.hubs).agg(F.sum("outside")).first()[0] or 0
        apart = turn < join.peels and between > 0
        # Most of what is compared can't link by size and place; the rest is counted before sets are read for it.
        if apart and (between > join.compares * most or joined_pairs(long, join).count() > most):
            met = found(pairs.union(hub_pairs(long, join)))
            lists = common.stored(rekeyed(met, join), "join-lists")
            common.forget(rows, long, met)
            labels = merged()
            continue
        met = found(pairs.union(plain(joined_pairs(long, join))) if between else pairs)
        common.forget(rows, long, met)
        return merged()


def linked(docs: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return grouped(docs, join).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, join: Join = DEFAULT) -> DataFrame:
    """doc_id, t (the text's hashes), n_shingles, component_id and text_group of every row: the component of the row's set by links between sets alone."""
    docs = docs.select("doc_id", "text")
    sets = classes(docs, join)
    again, mixed = repeats(sets)
    open_ = undecided(sets, join, again, mixed)
    labels = joined(ordered(docs, open_, join, again), join)
    members = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = members.select("s1", "s2", _key(F.col("rep"), F.col("s1"), F.col("s2"), mixed).alias("rep"))
    rows = sets.select("doc_id", "t", "n", "s1", "s2").join(members, ["s1", "s2"], "left").select("doc_id", "t", "n", "rep")
    rows = common.stored(rows, "join-rows")
    if labels is None:
        labels = rows.where(F.lit(False)).select(F.col("rep").alias("node"), F.col("rep").alias("label"))
    rows = rows.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("text_group", F.coalesce("label", "rep"))
    if mixed:
        rows = common.stored(rows.drop("label"), "join-rows")
        repeated = rows.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
        same = rows.join(repeated, "doc_id").where("rep IS NOT NULL").select("a", F.col("rep").alias("b"))
        rows = rows.join(components(labels.select("node", "label").union(same)).select(F.col("node").alias("rep"), "label"), "rep", "left")
    group = F.coalesce("label", "rep")
    group = F.coalesce(group["id"] if mixed else group, "doc_id")
    return rows.select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), group).alias("component_id"), "text_group")


def one_of_each(docs: DataFrame, join: Join = NEAR) -> DataFrame:
    """Of every group of linked texts the row of the smallest doc_id, one where that id and text repeat (then the row of the
    smallest hash); rows without id or without words stay. Texts are judged, not ids: a text unlike the others of its id stays."""
    t, n = common.free_names(docs, 2)
    seen = grouped(docs, join)
    # Of one id with several texts of a group, the text of the smaller hashes stays.
    kept = seen.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("text_group").agg(F.min(F.struct("doc_id", "t")).alias(t)).select(t)
    bare = seen.where("doc_id IS NOT NULL AND n_shingles = 0").select(F.struct("doc_id", "t").alias(t)).distinct()
    named = docs.where("doc_id IS NOT NULL").withColumn(t, F.struct("doc_id", common.two_hashes("text").alias("t")))
    first = named.join(kept, t, "left_semi").groupBy(t).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias(n))
    rest = named.join(bare, t, "left_semi").drop(t)
    return first.select(f"{n}.*").union(rest).union(docs.where("doc_id IS NULL"))
