"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed expressions find e-mail addresses, addresses of machines, card and phone numbers. Those are the seeds. Words that
hold a digit or ``@``, and neighbours of that sort, make a candidate; the two words before it and the one after it are its
contexts. Contexts and the candidates' values form a graph: a context is as sure as the share of its fillers, plain words
of the whole corpus among them, that are known data of a kind, and an unseen value is as sure as its surest context.
Spark scores both sides in turns. What is sure in the end is personal data wherever it stands, if its characters
can be data of that kind: a phone number without ``+``, a card number with a wrong digit, an address in other signs.

Defined cases: null text counts as empty, and empty text has no spans; a text of any length is searched whole; repeated
rows get the same spans each, rows that share an id with another text their own; an id may be null; an empty table
gives an empty result; columns besides ``doc_id`` and ``text`` are ignored by ``found`` and kept by ``redacted``, whatever
they are called. A context needs ``SUPPORT`` different values, in a corpus of any size, so contexts grow with the values: Spark
broadcasts tables of them while they are small and shuffles what meets them beyond, with the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm import common

KINDS = ("email", "ip", "card", "phone")
#: What matches, written so that no text takes more than linear time: runs are taken whole and begun once.
_LOCAL = r"[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign that every match of a kind has, to pass over texts without it.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What a value found by context must look like.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?:[0-9]{1,3}(?:[.,_-][0-9]{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})$",
    "card": r"^[0-9](?:[\x20.-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){5,14}$",
}
_PLAIN, _ANY = r"[^\x20\x09-\x0D0-9@]*+", r"[^\x20\x09-\x0D]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){_PLAIN}[0-9@]{_ANY}(?:\x20{_PLAIN}[0-9@]{_ANY})*+"
LABEL = r"^[\p{L}_-]+[:=]"
CORE = r"[0-9A-Za-z+(](?:.*[0-9A-Za-z])?"
#: Stands in contexts for a word with a digit or ``@``.
OTHER = "\x01"
#: A context is read from at most so many characters beside a candidate.
NEAR = 80
SURE, SUPPORT, ROUNDS = 0.8, 5, 4


def _starts(sizes: Column) -> Column:
    """Running sums of an array before each of its elements, by blocks, so that a text full of matches takes no quadratic time."""
    block = 256
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / block).cast("int")), lambda b: total(F.slice(sizes, b * block + 1, F.lit(block))))

    def with_offsets(before: Column) -> Column:
        return F.transform(sizes, lambda _, i: F.get(before, F.floor(i / block).cast("int")) + total(F.slice(sizes, i - i % block + 1, i % block)))

    return common.let(F.transform(common.let(blocks, lambda b: b), lambda _, i: total(F.slice(blocks, F.lit(1), i))), with_offsets)


def pieces(text: Column, form: str, body) -> Column:
    """``body(found, between, starts)``: the leftmost matches, the pieces around them, and where each match starts."""

    def measured(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(F.get(between, i + 1)) + F.length(m))  # from a match's start to the next one's
        starts = common.let(sizes, lambda s: common.let(_starts(s), lambda before: F.transform(before, lambda x: x + F.length(F.get(between, F.lit(0))))))
        return common.let(starts, lambda s: body(found, between, s))

    return common.let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda found: common.let(F.split(text, form, -1), lambda between: measured(found, between)))


_SPANS = "array<struct<kind:int,start:int,end:int>>"


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the fixed expressions' valid matches, by kind and start; ends are exclusive."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda m: F.length(digits(m)).between(16, 19) & F.call_function("luhn_check", digits(m)),
        "phone": lambda m: F.length(digits(m)).between(8, 15),
    }

    def of(kind: str, no: int) -> Column:
        spans = pieces(text, FORMS[kind], lambda found, _, starts: F.filter(F.transform(found, lambda m, i: F.when(valid[kind](m), F.struct(F.lit(no).alias("kind"), F.get(starts, i).cast("int").alias("start"), (F.get(starts, i) + F.length(m)).cast("int").alias("end")))), lambda s: s.isNotNull()))
        has = text.contains(SIGNS[kind]) if SIGNS[kind] else text.rlike(FORMS[kind])
        return F.when(has, spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))

    return F.when(text.rlike("[0-9@]"), F.concat(*[of(kind, no) for no, kind in enumerate(KINDS)])).otherwise(F.array().cast(_SPANS))


def candidates(text: Column, spans: Column) -> Column:
    """array<struct<value, start, end, seed, before, last, next>>: values that no base span cuts.

    ``seed`` is the kind of the base span that covers the value, else null; ``last`` and ``before`` are the word before
    it and the one before that, ``next`` the word after it, in lower case, empty at an end of the text.
    """

    def one(found: Column, between: Column, starts: Column, i: Column) -> Column:
        run = F.get(found, i)
        label = F.regexp_extract(run, LABEL, 0)
        rest = F.substring(run, F.length(label) + 1, F.length(run))
        value = F.regexp_extract(rest, CORE, 0)
        left = common.words(F.lower(F.concat(F.right(F.get(between, i), F.lit(NEAR)), label)))
        right = common.words(F.lower(F.left(F.get(between, i + 1), F.lit(NEAR))))
        word = lambda words, at, other: F.coalesce(F.get(words, at), F.when(other, F.lit(OTHER)).otherwise(F.lit("")))

        def placed(start: Column) -> Column:
            return F.struct(
                value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"),
                common.let(left, lambda w: word(w, F.size(w) - 2, i > 0)).alias("before"), common.let(left, lambda w: word(w, F.size(w) - 1, i > 0)).alias("last"),
                common.let(right, lambda w: word(w, F.lit(0), i < F.size(found) - 1)).alias("next"),
            )

        return common.let(F.get(starts, i) + F.length(label) + F.regexp_instr(rest, F.lit(CORE)) - 1, placed)

    def judged(c: Column) -> Column:
        met = F.filter(spans, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"]))
        whole = F.filter(met, lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"]))
        return F.when(F.size(met) == 0, c.withField("seed", F.lit(None).cast("int"))).when(F.size(whole) > 0, c.withField("seed", F.get(whole, F.lit(0))["kind"]))

    each = pieces(text, RUN, lambda found, between, starts: F.transform(found, lambda _, i: one(found, between, starts, i)))
    known = F.filter(F.transform(F.filter(each, lambda c: c["value"] != ""), judged), lambda c: c.isNotNull())
    empty = F.array().cast("array<struct<value:string,start:int,end:int,before:string,last:string,next:string,seed:int>>")
    return F.when(text.rlike("[0-9@]"), known).otherwise(empty)


def _contexts(before: Column, last: Column, after: Column) -> Column:
    """The three contexts of a filler, if a plain word is before it: that word, the two words before it, the words on both sides."""
    each = F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), last, F.lit(" "), before), F.concat(F.lit("3 "), last, F.lit(" "), after))
    return F.when(last.isin("", OTHER), F.array().cast("array<string>")).otherwise(each)


def read(docs: DataFrame) -> DataFrame:
    """key, spans and candidates of every row; rows that are equal in id and text share a key."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select(common.two_hashes("doc_id", "text").alias("key"), "doc_id", text.alias("text"))
    spans = common.computed(first, ["key", "doc_id", "text"], F.struct(base_spans(F.col("text")).alias("spans")))
    return common.computed(spans, ["key", "doc_id", "spans"], F.struct(candidates(F.col("text"), F.col("spans")).alias("candidates")))


def occurrences(rows: DataFrame) -> DataFrame:
    """key, value, start, end, kind, seed and contexts: a row for each kind that a candidate may be of."""
    one = rows.select("key", F.explode("candidates").alias("c")).select("key", "c.*")
    may = F.array_compact(F.array(*[F.when(F.col("seed").eqNullSafe(no) | (F.col("seed").isNull() & F.col("value").rlike(SHAPES[k])), F.lit(no)) for no, k in enumerate(KINDS)]))
    return one.select("key", "value", "start", "end", F.col("seed").isNotNull().alias("seed"), _contexts(F.col("before"), F.col("last"), F.col("next")).alias("contexts"), F.explode(may).alias("kind"))


def fillers(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of each of ``contexts``, stored and all different, the number of plain words of all texts that stand in it, repeats counted."""
    lasts = contexts.select(F.get(F.split("context", " "), F.lit(1)).alias("last")).distinct()
    words = docs.select(F.transform(common.words(F.lower("text")), lambda w: F.when(w.rlike("[0-9@]"), F.lit(OTHER)).otherwise(w)).alias("w")).where(F.size("w") > 1)
    at = F.sequence(F.lit(1), F.size("w") - 1)
    rows = words.select(F.inline(F.transform(at, lambda i: F.struct(F.when(i > 1, F.get("w", i - 2)).otherwise(F.lit("")).alias("before"), F.get("w", i - 1).alias("last"), F.get("w", i).alias("word"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))))
    met = rows.where(F.col("word") != OTHER).join(common.stored(lasts, "privacy-lasts"), "last")
    return met.select(F.explode(_contexts(F.col("before"), F.col("last"), F.col("after"))).alias("context")).join(contexts, "context").groupBy("context").agg(F.count("*").alias("n_plain"))


def learned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, value, score) of unseen values that sure contexts show to be personal data; ``found`` is of ``occurrences``."""
    edges = found.select("kind", "value", "seed", F.explode("contexts").alias("context")).groupBy("kind", "context", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = common.stored(edges, "privacy-edges")
    contexts = common.stored(edges.groupBy("kind", "context").agg(F.count("*").alias("n_values")).where(F.col("n_values") >= SUPPORT).select("kind", "context"), "privacy-contexts")
    if contexts.isEmpty():
        return edges.select("kind", "value", F.lit(0.0).alias("score")).limit(0)
    edges = edges.join(contexts, ["kind", "context"])
    # All that stands in a context: plain words, and candidates once each whatever kinds they may be of.
    kept = common.stored(contexts.select("context").distinct(), "privacy-kept")
    held = found.groupBy("key", "start", "value", "contexts").agg(F.lit(1).alias("one")).select(F.explode("contexts").alias("context")).join(kept, "context").groupBy("context").agg(F.count("*").alias("n_held"))
    total = kept.join(fillers(docs, kept), "context", "left").join(held, "context", "left").select("context", (F.coalesce("n_plain", F.lit(0)) + F.coalesce("n_held", F.lit(0))).alias("n_all"))
    edges = common.stored(edges.join(common.stored(total, "privacy-totals"), "context"), "privacy-graph")
    sure = edges.where("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
    count = -1
    for _ in range(ROUNDS):
        weighed = edges.join(sure, ["kind", "value"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        rule = weighed.groupBy("kind", "context").agg((F.sum(F.col("n") * F.col("score")) / (F.max("n_all") + 1)).alias("trust"), F.count_if(F.col("score") >= SURE).alias("n_known"))
        rule = rule.where((F.col("trust") >= SURE) & (F.col("n_known") >= SUPPORT)).select("kind", "context", "trust")
        scored = edges.join(common.stored(rule, "privacy-rule"), ["kind", "context"], "left").groupBy("kind", "value").agg(F.when(F.max("seed"), 1.0).otherwise(F.coalesce(F.max("trust"), F.lit(0.0))).alias("score"))
        sure = common.stored(scored.where(F.col("score") >= SURE), "privacy-sure")
        before, count = count, sure.count()
        if count == before:
            break
    new = sure.join(edges.where("seed").select("kind", "value").distinct(), ["kind", "value"], "left_anti")
    # One kind a value: the surest, the first of the list on ties.
    return new.groupBy("value").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("best")).select("best.kind", "value", "best.score")


def spans_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """key and ``more``, the spans that contexts add, of the rows that have such; ``rows`` is of ``read``."""
    seen = common.stored(occurrences(rows), "privacy-seen")
    new = learned(docs, seen)
    return seen.where("NOT seed").join(new, ["kind", "value"]).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).cast(_SPANS).alias("more"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def all_spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, spans (base ones) and ``every``, those and what contexts add, by kind and start; a row for each of ``docs``."""
    rows = common.stored(read(docs), "privacy-rows")
    more = spans_of(docs, rows)
    return rows.join(more, "key", "left").select("key", "doc_id", "spans", F.sort_array(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS)))).alias("every"))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans, for every row."""
    of = lambda no: F.size(F.filter("spans", lambda s: s["kind"] == no)).cast("long")
    counts = [of(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return all_spans(docs).select("doc_id", *counts, F.sha2(_told(F.col("spans")).cast("binary"), 256).alias("base_sha256"), _told(F.col("every")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets; of overlapping spans the first, then the longest, names them all."""
    key, hidden = common.free_names(docs, 2)
    marks = all_spans(docs).where(F.size("every") > 0).groupBy(F.col("key").alias(key)).agg(F.first("every").alias(hidden))
    order = F.array_sort(F.transform(F.col(hidden), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("by"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        new = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] < done["at"], done["out"]).otherwise(new).alias("out"))

    clean = F.aggregate(order, begin, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    joined = docs.withColumn(key, common.two_hashes("doc_id", "text")).join(marks, key, "left")
    return joined.withColumn("text", F.when(F.col(hidden).isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
