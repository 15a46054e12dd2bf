"""Quality rules: distribution divergence against language references.

A document's character-class histogram and its histogram of common words are compared with those of each
language by the Jensen-Shannon distance (base 2, so 0 to 1). The references are sums over all rows with a
language; nothing is sampled. A test on a histogram of too few symbols abstains (length guard), and its limit
widens by the sampling noise that a histogram of that length has. Only DataFrame functions are used.

Defined cases: null or empty text has no words and fails the base rules; rows without language are judged but
add nothing to a reference; where a row's language has no reference (too few words), or none has, the method keeps
what the base rules keep; repeated rows are judged each on its own; a text of any length is judged whole; of languages
equally near the first in order of its code counts; an empty table gives an empty result; other columns of the input are
ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import common

#: Character classes, in the order they are stripped from a text. What is left after the last is the class "other".
CLASSES = {
    "lower": r"\p{Ll}+",
    "space": r"[\x20\x09-\x0D]+",
    "upper": r"[\p{Lu}\p{Lt}]+",
    "digit": r"\p{Nd}+",
    "stop": r"[.,;:?'()\-]+",
    "letter": r"[\p{Lm}\p{Lo}\p{M}]+",
}
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A word is common in a language from this share of its words on, so there are at most 1 / share of them.
    common_share: float = 0.004
    #: A language has a reference from so many words on: a word at ``common_share`` then occurs eight times.
    reference_words: int = 2000
    #: Limits of the two distances, and what is added to their squares per symbol of a short histogram.
    max_chars: float = 0.30
    max_words: float = 0.33
    noise: float = 6.0
    #: Length guards: below them a histogram says nothing.
    min_chars_judged: int = 200
    min_words_judged: int = 50


DEFAULT = Rules()


def _rle(values: Column) -> Column:
    """Array of struct(value, n) of an array, in one sort."""

    def runs(s: Column) -> Column:
        last = F.size(s) - 1
        ends = F.filter(F.transform(s, lambda v, i: F.when((i == last) | (F.get(s, i + 1) != v), i)), lambda i: i.isNotNull())
        return common.let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i).alias("value"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).alias("n"))))

    return common.let(F.sort_array(values), runs)


def repeat_words(w: Column, window: int = 3) -> Column:
    """Words in windows of ``window`` words that occur twice or more in the array ``w``, the first occurrence included."""

    def covered(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        found = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["at"])), lambda at: at.isNotNull())
        return common.let(F.sort_array(found), lambda p: F.aggregate(F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))), F.lit(0).cast("long"), lambda a, b: a + b))

    starts = lambda w: F.sequence(F.lit(0), F.size(w) - window)
    keyed = F.transform(starts(w), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("at")))
    return F.when(F.size(w) >= window, common.let(F.sort_array(keyed), covered)).otherwise(F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(common.WORD))
    return common.let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def class_counts(text: Column) -> Column:
    """struct<classes, n_symbols>: code points by character class, those of CLASSES and then the others; and, found among the others, the symbols."""

    def step(rest: Column, left: list[str], found: list[Column]) -> Column:
        if not left:
            symbols = F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))
            return F.struct(F.array(*found, F.length(rest).cast("double")).alias("classes"), symbols.cast("long").alias("n_symbols"))
        return common.let(F.regexp_replace(rest, CLASSES[left[0]], ""), lambda less: step(less, left[1:], [*found, (F.length(rest) - F.length(less)).cast("double")]))

    return step(F.coalesce(text, F.lit("")), list(CLASSES), [])


def _bucket(word: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(n)).cast("int")


def common_words(docs: DataFrame, rules: Rules = DEFAULT, buckets: int = 1 << 16, broadcast_rows: int = 1 << 18) -> DataFrame:
    """(lang, word, share) of all words of at least ``common_share`` of their language's words.

    Hashed words are counted first; only buckets that reach the share can hold a common word, and there are at most
    1 / share of them a language, so the second count shuffles a bounded number of keys. Both count all rows. The buckets
    are broadcast up to ``broadcast_rows`` of them (a thousand languages) and joined by a shuffle of counted words beyond.
    """
    # Lower case before the split and empty words left out after it: no lambda runs a word.
    each = docs.where(F.col("lang").isNotNull()).select("lang", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), common.SPACE)).alias("word")).where("word <> ''")
    hashed = common.stored(each.groupBy("lang", _bucket(F.col("word"), buckets).alias("bucket")).agg(F.count("*").alias("n")), "quality-buckets")
    totals = hashed.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= rules.reference_words)
    heavy = hashed.join(totals, "lang").where(F.col("n") >= rules.common_share * F.col("total"))
    heavy = common.stored(heavy.select("lang", "bucket", "total"), "quality-heavy")  # at most 1 / common_share rows a language
    each = each.withColumn("bucket", _bucket(F.col("word"), buckets))
    if heavy.count() <= broadcast_rows:
        counts = each.join(F.broadcast(heavy), ["lang", "bucket"]).groupBy("lang", "word").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    else:
        counts = each.groupBy("lang", "word", "bucket").agg(F.count("*").alias("n")).join(heavy, ["lang", "bucket"])
    found = common.stored(counts.where(F.col("n") >= rules.common_share * F.col("total")).select("lang", "word", (F.col("n") / F.col("total")).alias("share")), "quality-words")
    common.forget(hashed, heavy)
    return found


def _js(p: Column, q: Column) -> Column:
    """One bin's share of the squared Jensen-Shannon distance."""
    half = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q)) / 2).otherwise(0.0)
    return half(p) + half(q)


def _constant(value: list, schema: str) -> Column:
    """An array as one constant of a plan, however long it is."""
    return F.from_json(F.lit(json.dumps(value)), schema)


@dataclass(frozen=True)
class Vocabulary:
    """Words in buckets of their hash, four buckets a word, so that a word is found in one of them."""

    buckets: list[list[str]]

    @staticmethod
    def of(spark: SparkSession, words: list[str]) -> Vocabulary:
        buckets: list[list[str]] = [[] for _ in range(4 * len(words) + 1)]
        if words:
            rows = spark.sql("SELECT word, xxhash64(word) AS h FROM (SELECT explode(split(:words, '\n')) AS word)", args={"words": "\n".join(words)})
            for r in rows.collect():
                buckets[r.h % len(buckets)].append(r.word)
        return Vocabulary(buckets)

    def at(self, table: Column, word: Column) -> Column:
        """What a table by bucket holds where the word would be."""
        return F.get(table, _bucket(word, len(self.buckets)))

    def known(self, words: Column) -> Column:
        """The words of an array that the vocabulary has, in lower case, repeats included."""
        table = _constant(self.buckets, "array<array<string>>")
        return F.filter(F.transform(words, lambda x: F.lower(x)), lambda x: F.array_contains(self.at(table, x), x))


def measures(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The base counts of every row, its class counts and its counts of the words of the vocabulary."""
    per_word = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), _rle(vocabulary.known(w)).alias("hits"))
    spaces = list(CLASSES).index("space")
    word_chars = (F.aggregate("by_char.classes", F.lit(0.0), lambda a, b: a + b) - F.col("by_char.classes")[spaces]).cast("long")
    return docs.select(
        "doc_id",
        "lang",
        common.let(common.words(F.col("text")), per_word).alias("by_word"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        class_counts(F.col("text")).alias("by_char"),
    ).select("doc_id", "lang", "by_word.*", word_chars.alias("word_chars"), "by_char.n_symbols", "n_dup_lines", "by_char.classes")


@dataclass(frozen=True)
class References:
    """What all languages hold, as two constants of a plan whose expressions are the same for any number of languages:
    a row a language, and by bucket of the vocabulary its words with each language in which they are common."""

    vocabulary: Vocabulary
    languages: list[dict]
    shares: list[list[dict]]

    def distances(self, share: Column) -> Column:
        """array<struct<chars, words, lang>>: the distance of a row's classes and words to each language."""
        languages = _constant(self.languages, "array<struct<lang:string,chars:array<double>,held:double>>")
        shares = _constant(self.shares, "array<array<struct<word:string,l:int,q:double>>>")
        # Words of a reference that the text lacks give half their share each; the words found replace that.
        gain = lambda l, p, q: F.struct(l.alias("l"), p.alias("p"), (_js(p, q) - q / 2).alias("gain"))  # noqa: E731, E741
        same = lambda hit: F.filter(self.vocabulary.at(shares, hit["value"]), lambda v: v["word"] == hit["value"])
        met = F.transform("hits", lambda hit: F.transform(same(hit), lambda v: gain(v["l"], hit["n"] / F.col("n_words"), v["q"])))
        root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))

        def one(lang: Column, i: Column, p: Column, found: Column) -> Column:
            by_char = sum((_js(p[k], lang["chars"][k]) for k in range(len(CLASSES) + 1)), F.lit(0.0))
            none = F.struct(F.lit(0.0).alias("gain"), F.lit(0.0).alias("p"))
            add = lambda a, b: F.struct((a["gain"] + b["gain"]).alias("gain"), (a["p"] + b["p"]).alias("p"))
            rest = lambda s: s["gain"] + lang["held"] / 2 + _js(F.greatest(1.0 - s["p"], F.lit(0.0)), F.greatest(1.0 - lang["held"], F.lit(0.0)))
            by_word = F.aggregate(F.filter(found, lambda f: f["l"] == i), none, add, rest)
            return F.struct(root(by_char).alias("chars"), root(by_word).alias("words"), lang["lang"].alias("lang"))

        return common.let(share, lambda p: common.let(F.flatten(met), lambda found: F.transform(languages, lambda lang, i: one(lang, i, p, found))))


def judge(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """The base counts, both distances to the nearest language, ``base_failed`` and ``kept`` of every row."""
    common_rows = common_words(docs, rules).collect()  # at most 1 / common_share rows a language
    vocabulary = Vocabulary.of(docs.sparkSession, sorted({r.word for r in common_rows}))
    languages = sorted({r.lang for r in common_rows})
    stats = common.stored(measures(docs, vocabulary), "quality-stats")

    n_classes = len(CLASSES) + 1
    sums = stats.where(F.col("lang").isin(languages)).groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)])
    chars = {r[0]: [x / max(sum(r[1:]), 1) for x in r[1:]] for r in sums.collect()}  # a row a language
    number = {lang: i for i, lang in enumerate(languages)}
    of_word: dict[str, list[dict]] = {}
    held = dict.fromkeys(languages, 0.0)
    for r in sorted(common_rows):
        of_word.setdefault(r.word, []).append({"word": r.word, "l": number[r.lang], "q": r.share})
        held[r.lang] += r.share
    shares = [[x for word in bucket for x in of_word[word]] for bucket in vocabulary.buckets]
    references = References(vocabulary, [{"lang": x, "chars": chars[x], "held": held[x]} for x in languages], shares)

    total = F.aggregate("classes", F.lit(0.0), lambda a, b: a + b)
    share = common.let(F.greatest(total, F.lit(1.0)), lambda t: F.transform("classes", lambda x: x / t))  # of an empty text all are 0
    apart = references.distances(share) if languages else F.lit(None).cast("array<struct<chars:double,words:double,lang:string>>")
    n_chars = F.col("n_chars_judged")
    slack_c = F.lit(rules.noise) / F.greatest(n_chars, F.lit(1.0))
    slack_w = F.lit(rules.noise) / F.greatest(F.col("n_words"), F.lit(1))
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    out = stats.withColumn("n_chars_judged", total).withColumn("apart", apart)
    near = F.array_min(F.transform("apart", lambda a: F.struct((F.greatest(a["chars"] - rules.max_chars, a["words"] - rules.max_words)).alias("over"), a["chars"].alias("chars"), a["words"].alias("words"), a["lang"].alias("lang"))))
    fits = (
        ((n_chars < rules.min_chars_judged) | (F.pow(F.col("near.chars"), 2) <= rules.max_chars**2 + slack_c))
        & ((F.col("n_words") < rules.min_words_judged) | (F.pow(F.col("near.words"), 2) <= rules.max_words**2 + slack_w))
    )
    fits = fits | (F.col("lang").isNotNull() & ~F.col("lang").isin(languages))
    return out.withColumn("near", near).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.coalesce(fits, F.lit(True))).alias("kept"),
        F.col("near.chars").alias("js_chars"), F.col("near.words").alias("js_words"), F.col("near.lang").alias("nearest_lang"),
    )


def verdicts(docs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """What the corpus query returns: the counts and verdicts of ``judge``, without the distances, whose last digits depend on the order of sums."""
    return judge(docs, rules).drop("js_chars", "js_words", "nearest_lang")
