"""Chat formatting by quotation linking.

Messages quote earlier ones by lines that begin with ``>``, nested quotes by several. Runs of lines of one level are
passages. Passages, their paragraphs and their lines are normalised and hashed, and each is joined to the latest
earlier message of the conversation that says the same itself; a message replies to the source of its outermost
quotes, the longest match deciding. Following those links upwards gives every message a path, and messages in order
of their paths are the conversation in reply order, without its quotes.

Defined cases: null text is an empty message; a message without a quote, or whose quotes match no earlier message,
begins a thread; a null conversation or turn is never linked; repeated rows keep one link each, the same; of messages of
one turn that say the same the one with the larger hash is quoted; lines of white space separate paragraphs and match
nothing; a message of any length is parsed whole; an empty table gives an empty result; extra columns are ignored. A
path has 21 characters for each message above, so a chain of d replies takes d * d of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common

QUOTE = r"^(?:[ \t]*>)+"
#: A line that announces a quote, left out of what a message says itself.
ANNOUNCES = r"(?i)^\s*(on\b.*\bwrote|.*\bschrieb|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
WHOLE, PARAGRAPH, LINE = 3, 2, 1
BY = "struct<key:struct<a:bigint,b:bigint>,turn:bigint>"
RANGES = 256


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{00a0}]+", " "))


def passages(text: Column) -> Column:
    """array<struct<level, text>>: the runs of lines of one quote level, in order."""
    prefix = lambda line: F.regexp_extract(line, QUOTE, 0)
    lines = F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"),
        lambda x: common.let(prefix(x), lambda p: F.struct(F.length(F.regexp_replace(p, r"[^>]", "")).alias("level"), F.regexp_replace(F.substring(x, F.length(p) + 1, F.length(x)), r"^ ", "").alias("text"))),
    )

    def runs(all_lines: Column) -> Column:
        # An announcing line goes where a deeper quote follows it.
        kept = F.filter(all_lines, lambda x, i: ~(x["text"].rlike(ANNOUNCES) & (F.coalesce(F.get(all_lines, i + 1)["level"], F.lit(-1)) > x["level"])))
        return common.let(kept, runs_of)

    def runs_of(kept: Column) -> Column:
        starts = F.filter(F.transform(kept, lambda x, i: F.when((i == 0) | (F.coalesce(F.get(kept, i - 1)["level"], F.lit(-1)) != x["level"]), i)), lambda i: i.isNotNull())
        piece = lambda a, b: F.array_join(F.transform(F.slice(kept, a + 1, b - a), lambda x: x["text"]), "\n")
        return common.let(starts, lambda s: F.transform(s, lambda a, k: F.struct(F.get(kept, a)["level"].alias("level"), piece(a, F.coalesce(F.get(s, k + 1), F.size(kept))).alias("text"))))

    return common.let(lines, runs)


def units(text: Column) -> Column:
    """array<struct<weight, size, hash>>: a passage as a whole, by paragraphs and by lines, without empty or repeated ones."""
    parts = lambda pattern, weight: F.transform(F.split(text, pattern), lambda x: F.struct(F.lit(weight).alias("weight"), normalised(x).alias("said")))
    each = F.concat(F.array(F.struct(F.lit(WHOLE).alias("weight"), normalised(text).alias("said"))), parts(r"\n\s*\n", PARAGRAPH), parts("\n", LINE))
    said = F.filter(F.array_distinct(each), lambda x: x["said"] != "")
    return F.transform(said, lambda x: F.struct(x["weight"].alias("weight"), F.length(x["said"]).alias("size"), F.md5(x["said"]).alias("hash")))


def unquoted(parts: Column) -> Column:
    """What a message says itself: its passages of level 0, joined, without the white space around them."""
    own = F.transform(F.filter(parts, lambda p: p["level"] == 0), lambda p: F.regexp_replace(p["text"], r"^\s+|\s+$", ""))
    return F.array_join(F.filter(own, lambda x: x != ""), "\n\n")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, the key of the message's content, its passages and its own text."""
    key = common.two_hashes("conv_id", "turn", "role", "text")
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", key.alias("key"), passages(F.col("text")).alias("parts")).select("*", unquoted(F.col("parts")).alias("own"))


def quote_links(messages: DataFrame) -> DataFrame:
    """(key, part, level, weight, size, source, source_turn): quoted passages of parsed messages and the message that said them."""
    known = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = known.where(F.exists("parts", lambda p: p["level"] > 0)).select("conv_id", "turn", "key", F.posexplode("parts").alias("part", "is")).where("is.level > 0")
    quotes = quotes.select("conv_id", "turn", "key", "part", F.col("is.level").alias("level"), F.explode(units(F.col("is.text"))).alias("unit"))
    # Whole messages, paragraphs and lines that are said; a quoted unit matches one of any kind.
    said = known.where("own <> ''").select("conv_id", "turn", "key", F.explode(F.array_distinct(F.transform(units(F.col("own")), lambda u: u["hash"]))).alias("hash"))
    quoted = quotes.select("conv_id", "turn", F.col("unit.hash").alias("hash"), F.struct("key", "part", "level", "unit.weight", "unit.size").alias("quote"))
    wanted = quoted.select("conv_id", "hash").distinct()
    said = said.join(wanted, ["conv_id", "hash"], "left_semi").select("conv_id", "turn", "hash", F.struct("key", "turn").alias("by"))
    # One pass over who said what when: each quote takes the last speaker before it, so no pairs are made.
    both = common.stored(quoted.withColumn("by", F.lit(None).cast(BY)).unionByName(said.withColumn("by", F.col("by").cast(BY)), allowMissingColumns=True), "chat-said")
    # A line that one conversation keeps repeating is walked in ranges of turns, each of which knows who spoke last before it.
    edges = both.agg(F.percentile_approx("turn", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0] or []  # fewer than RANGES numbers
    both = both.withColumn("range", F.size(F.filter(F.array(*[F.lit(int(e)).cast("long") for e in sorted(set(edges))]).cast("array<bigint>"), lambda e: F.col("turn") > e)))
    ends = both.groupBy("conv_id", "hash", "range").agg(F.max_by("by", F.when(F.col("by").isNotNull(), F.struct("turn", "by.key"))).alias("end"))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    ends = ends.select("conv_id", "hash", "range", F.last("end", ignorenulls=True).over(earlier).alias("before"))
    so_far = Window.partitionBy("conv_id", "hash", "range").orderBy("turn", F.col("quote").isNull(), "by.key").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("within", F.last("by", ignorenulls=True).over(so_far)).where("quote IS NOT NULL").join(ends, ["conv_id", "hash", "range"])
    found = found.withColumn("source", F.coalesce("within", "before")).where("source IS NOT NULL")
    return found.select("quote.*", F.col("source.key").alias("source"), F.col("source.turn").alias("source_turn")).where("source <> key").distinct()


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, depth, path and n_quotes of every message.

    ``path`` has the turns from the thread's first message, each as 20 digits counted from the smallest turn there can be, so messages sorted by conv_id and path are in reply order.
    """
    rows = common.stored(parsed(messages), "chat-messages")
    links = common.stored(quote_links(rows), "chat-links")
    first = F.struct(F.col("level"), -F.col("weight"), -F.col("size"), -F.col("source_turn"), F.col("source"))
    parents = links.groupBy("key").agg(F.min_by(F.struct("source", "source_turn"), first).alias("parent"), F.countDistinct("part").alias("n_quotes"))
    step = F.lpad((F.coalesce(F.col("turn"), F.lit(0)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    linked = rows.join(parents, "key", "left").select("key", "conv_id", "turn", "role", F.col("own").alias("text"), F.col("parent.source").alias("above"), F.col("parent.source_turn").alias("parent_turn"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), step.alias("path"))
    linked = common.stored(linked, "chat-linked")
    # Only messages in threads are followed upwards; each turn doubles the way that a path covers.
    paths = linked.where("above IS NOT NULL").select("key", "above", "path").distinct()
    roots = linked.where("above IS NULL").join(paths.select(F.col("above").alias("key")).distinct(), "key", "left_semi").select("key", F.lit(None).cast("struct<a:bigint,b:bigint>").alias("above"), "path").distinct()
    paths = common.stored(paths.union(roots), "chat-paths")
    while not paths.where("above IS NOT NULL").isEmpty():
        up = paths.select(F.col("key").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
        open_ = paths.where("above IS NOT NULL").join(up, "above").select("key", F.col("next").alias("above"), F.concat("before", F.lit("/"), "path").alias("path"))
        paths = common.stored(paths.where("above IS NULL").union(open_), "chat-paths")
    done = linked.drop("path").join(paths.select("key", F.col("path").alias("long_path")), "key", "left").withColumn("path", F.coalesce("long_path", step))
    return done.select("conv_id", "turn", "role", "text", "parent_turn", F.size(F.split("path", "/")).cast("long").alias("depth"), "path", F.col("n_quotes").cast("long").alias("n_quotes"))
