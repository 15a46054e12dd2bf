"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed counts of one to three letters of the lower-cased text, other characters counting as one gap,
scaled by their square root to unit length. A one-versus-rest linear machine for each family picks the family; within
it every pair of languages has a machine of its own, and the language with the most votes wins, the sum of margins
deciding ties.

The machines are fitted on a bounded sample: ``Fit.per_language`` rows of each language and ``Fit.rows`` in all, or one of each
where there are more languages than that; a language's rows are those of the smallest hash of the id, and of an id
with several texts the first in order counts. Everything else covers all rows and whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no labelled row all texts are; with
one language learned it is predicted for every text with a letter; rows with a null id or language are predicted but
never learned from; repeated rows are predicted each and learned once; of equal votes and margins the first language in
order of its code wins; an empty table gives an empty result; other columns are ignored, or kept by ``kept``.

A filter also asks how well a text fits the language predicted for it: the mean log probability of its n-grams under the
language's learned n-grams, against what the learned rows reach when each is left out. A language of fewer than
``FIT_ROWS`` learned rows has no such limit.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "indo-aryan": "hi bn ur mr ne pa gu si",
    "turkic": "tr az kk uz tk ky",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNDETERMINED = "und"


@dataclass(frozen=True)
class Fit:
    per_language: int = 400
    #: At most so many languages, the largest, if it is set.
    max_languages: int | None = None
    rows: int = 20_000
    dims: int = 2048
    epochs: int = 30
    penalty: float = 1e-4
    seed: int = 7


DEFAULT = Fit()

#: Score below which a filter takes a text for no learned language.
MIN_SCORE = 0.3
#: Learned rows from which a language has a limit of fit; how far below their median it lies, in distances of their lowest
#: twentieth and at least; and what a short text may miss, in standard deviations of its mean (a letter is in three n-grams).
FIT_ROWS, FIT_SPREAD, FIT_LEAST, FIT_NOISE = 10, 6.0, 0.6, 3.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter; one a Python worker."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def features(text: str | None, dims: int) -> np.ndarray | None:
    """Unit vector of a whole text, or None if it has no letter."""
    points = np.frombuffer((text if isinstance(text, str) else "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    gap = ~letter
    keep = letter | np.concatenate(([True], ~gap[:-1]))  # of a run of other characters the first
    codes = np.where(letter, points, 32)[keep].astype(np.uint32)
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
    grams = np.concatenate((codes * np.uint32(0x165667B1), pairs, triples))
    grams ^= grams >> np.uint32(15)
    counts = np.sqrt(np.bincount(grams % np.uint32(dims), minlength=dims).astype(np.float32))
    return counts / np.linalg.norm(counts)


def _machine(x: np.ndarray, y: np.ndarray, fit: Fit) -> np.ndarray:
    """Linear support vector machine by stochastic subgradient steps, averaged over the last half; the last weight is the bias."""
    rng = np.random.default_rng(fit.seed)
    x = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
    weight = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    w, mean, n, batch, step = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 32, 0
    for epoch in range(fit.epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i : i + batch]
            step += 1
            rate = 1.0 / (fit.penalty * (step + 1.0 / fit.penalty / 10))
            wrong = (y[at] * (x[at] @ w)) < 1
            w *= 1 - rate * fit.penalty
            if wrong.any():
                k = at[wrong]
                w += rate * ((y[k] * weight[k]) @ x[k]) / len(at)
            if epoch >= fit.epochs // 2:
                mean += w
                n += 1
    return mean / max(n, 1)


@dataclass
class Model:
    """families: names, in the order of the rows of ``by_family``; pairs: (family, first, second, weights)."""

    dims: int
    families: list[str]
    languages: dict[str, list[str]]
    by_family: np.ndarray
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]
    #: By language: log probabilities of n-grams, the limit of their mean, and their standard deviation.
    likely: dict[str, tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def fits(self, x: np.ndarray, language: str) -> bool:
        """Whether a text is as likely in a language as its learned rows are; a rarest n-gram is taken to occur once."""
        if language not in self.likely:
            return True
        logs, limit, deviation = self.likely[language]
        shares = np.square(x, dtype=np.float64)
        return float(shares @ logs) >= limit - FIT_NOISE * deviation * np.sqrt(3 * shares[shares > 0].min())

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        x = np.append(x, 1.0)
        sure = lambda margin: 1 / (1 + np.exp(-4 * margin))
        margins = self.by_family @ x
        at = int(np.argmax(margins))
        family, score = self.families[at], 1.0
        if len(self.families) > 1:
            score = float(sure(margins[at] - np.max(np.delete(margins, at))))
        languages = self.languages[family]
        votes = np.zeros((len(languages), 2))
        for i, j, w in self.pairs[family]:
            m = float(w @ x)
            votes[i if m >= 0 else j, 0] += 1
            votes[i, 1] += m
            votes[j, 1] -= m
        best = max(range(len(languages)), key=lambda k: tuple(votes[k]))
        if len(languages) > 1:
            score *= float(sure(votes[best, 1] / (len(languages) - 1)))
        return languages[best], score


def fitted(x: np.ndarray, labels: list[str], fit: Fit = DEFAULT) -> Model | None:
    if not labels:
        return None
    labels_ = np.array(labels)
    family = np.array([FAMILY_OF.get(c, c) for c in labels])
    families = sorted(set(family))
    languages = {f: sorted(set(labels_[family == f])) for f in families}
    by_family = np.stack([_machine(x, np.where(family == f, 1.0, -1.0), fit) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in families])
    pairs: dict[str, list] = {f: [] for f in families}
    for f in families:
        for (i, a), (j, b) in combinations(enumerate(languages[f]), 2):
            of = (labels_ == a) | (labels_ == b)
            pairs[f].append((i, j, _machine(x[of], np.where(labels_[of] == a, 1.0, -1.0), fit)))
    likely = {c: _likely(x[labels_ == c]) for c in set(labels) if (labels_ == c).sum() >= FIT_ROWS}
    return Model(fit.dims, families, languages, by_family, pairs, likely)


def _likely(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    shares = np.square(x, dtype=np.float64)
    total = shares.sum(axis=0)

    def logs(q: np.ndarray) -> np.ndarray:
        q = q + 1e-5
        return np.log(q / q.sum(axis=-1, keepdims=True))

    left_out = np.array([row @ logs((total - row) / (len(shares) - 1)) for row in shares])
    median, low = np.quantile(left_out, (0.5, 0.05))
    whole = logs(total / len(shares))
    mean = total / len(shares)
    deviation = np.sqrt(max(float(mean @ np.square(whole) - np.square(mean @ whole)), 0.0))
    return whole, float(median - max(FIT_SPREAD * (median - low), FIT_LEAST)), deviation


def learned(rows: DataFrame, fit: Fit = DEFAULT) -> Model | None:
    """A model of (doc_id, text, lang), fitted on the bounded sample; features are made where the texts are, and only they reach the driver."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    counts = (counts if fit.max_languages is None else counts.limit(fit.max_languages)).collect()  # a row a language
    each = max(1, min(fit.per_language, fit.rows // max(len(counts), 1)))
    if not counts:
        return None
    # Hashes are even, so below this share of them lie twice as many rows as are wanted, and a language's rank is made among few.
    shares = rows.sparkSession.createDataFrame([(r.lang, min(1.0, (2 * each + 100) / r.n)) for r in counts], "lang string, share double")
    drawn = F.xxhash64("doc_id", F.lit(fit.seed))
    near = rows.select("doc_id", "lang", drawn.alias("h")).join(F.broadcast(shares), "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.select("doc_id", "lang", "h").distinct().withColumn("n", first).where(F.col("n") <= each).select("doc_id", "lang")
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # at most Fit.rows ids

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(r.doc_id, r.lang, features(r.text, fit.dims)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame([(i, c, x.astype("<f4").tobytes()) for i, c, x in made if x is not None], columns=["doc_id", "lang", "x"])

    found = texts.mapInPandas(vectors, "doc_id long, lang string, x binary").toPandas()
    found = found.sort_values(["doc_id", "lang", "x"])
    x = np.frombuffer(b"".join(found["x"]), dtype="<f4").reshape(len(found), fit.dims)
    return fitted(x, list(found["lang"]), fit)


def predicted(text: Column, model: Model | None) -> Column:
    """struct<lang_pred, score> of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            x = features(text, model.dims) if model else None
            out.append((UNDETERMINED, 0.0) if x is None else model.predict(x))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(text)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text)."""
    return docs.select("doc_id", predicted(F.col("text"), model).alias("is")).select("doc_id", "is.*")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def cross_checked(docs: DataFrame, fit: Fit = DEFAULT) -> DataFrame:
    """What the corpus query returns: predictions for every row by a model of the rows that are not held out."""
    model = learned(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), fit)
    found = identified(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(text: Column, model: Model | None, min_score: float = MIN_SCORE) -> Column:
    """Whether a text is in a learned language: predicted with ``min_score`` and fitting what was learned of it."""

    @F.pandas_udf("boolean")
    def accept(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            x = features(text, model.dims) if model else None
            language, score = (UNDETERMINED, 0.0) if x is None else model.predict(x)
            out.append(bool(x is not None and score >= min_score and model.fits(x, language)))
        return pd.Series(out, dtype=bool)

    return accept(text)


def kept(docs: DataFrame, fit: Fit = DEFAULT, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text is in a learned language, with all their columns; null, letterless, unclear and unlearned texts go."""
    model = learned(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), fit)
    return docs.where(accepted(F.col("text"), model, min_score))
