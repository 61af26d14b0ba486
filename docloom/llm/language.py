"""Language identification by rank-order profiles.

A profile is the most frequent n-grams (1 to 3 characters; words padded by a blank) in
order of frequency.  A document takes the language from whose profile its own has the
least out-of-place distance: the sum over its n-grams of the difference of ranks, or of
the profile's length where the language lacks the n-gram.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batch_of, slices, texts

TOP = 300
#: Labelled documents that a language's profile is learned from (expected number; all if
#: there are fewer).  They are chosen by a hash of doc_id.
LEARN = 3000
UNKNOWN = "und"
#: Alphabets beyond this size are counted by sorting instead of by a table.
ALPHABET = 96
_counts = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of 1 to 3 characters of a text: lower case, runs of
    what isn't a letter are one blank, words have a blank on either side, and no n-gram
    spans two words.  A code has 21 bits a character."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    points = np.where(_is_letter()[points], points, np.uint32(32))
    blank = points == 32
    points = points[~(blank & np.r_[False, blank[:-1]])]
    if len(points) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)  # the blank, 32, comes first: no letter is below it
    number = np.empty(len(seen), np.int64)
    number[alphabet] = np.arange(len(alphabet))
    own, k = number[points], len(alphabet)
    pairs = own[:-1] * k + own[1:]
    triples = pairs[:-1] * k + own[2:]
    codes, counts = [], []
    for size, values in ((1, own), (2, pairs), (3, triples)):
        if k <= ALPHABET:
            n = np.bincount(values)
            at = np.flatnonzero(n)
            n = n[at]
        else:
            at, n = np.unique(values, return_counts=True)
        # not the blank alone, and no blank between two letters
        good = at > 0 if size == 1 else np.ones(len(at), bool) if size == 2 else at // k % k > 0
        at, n = at[good], n[good]
        code = np.zeros(len(at), np.int64)
        for place in reversed(range(size)):
            code = code << 21 | alphabet[at // k**place % k]
        codes.append(code)
        counts.append(n)
    return np.concatenate(codes), np.concatenate(counts)


def profile(text: str) -> np.ndarray:
    """The codes of the most frequent n-grams, in order; ties by code."""
    codes, n = grams(text)
    return codes[np.lexsort((codes, -n))[:TOP]]


class Model:
    """Profiles by language: arrays of codes in order of rank."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        every = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.names])) if self.names else np.empty(0, np.int64)
        self.codes = every
        self.ranks = np.full((len(self.names), len(every) + 1), -1, np.int64)
        for k, x in enumerate(self.names):
            self.ranks[k, np.searchsorted(every, profiles[x])] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one less the ratio of the least distance to the
        largest possible one.  Equal distances go to the first name.  No letters, or
        nothing learned: ``und`` with 0."""
        own = profile(text) if text else ()
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        rank = self.ranks[:, at]
        apart = np.where(rank < 0, TOP, np.minimum(np.abs(rank - np.arange(len(own))), TOP)).sum(1)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (TOP * len(own)))


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = LEARN) -> Model:
    """Learns from the whole texts of about ``per_language`` documents of each language
    among those (doc_id, text, lang) that have a language and aren't held out.

    The n-grams are counted on the executors and summed per language; the driver gets
    ``TOP`` rows per language.  Null and empty texts add nothing.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id")).select("doc_id", "text", "lang")
    sizes = {x.lang: x["count"] for x in known.groupBy("lang").count().toLocalIterator()}
    step = {x: max(1, -(-n // per_language)) for x, n in sizes.items()}
    spark = docs.sparkSession
    share = spark.createDataFrame(list(step.items()), "lang string, step long")
    chosen = known.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("step")) == 0)  # a row per language

    def count(batches):
        sums: dict[str, Counter] = {}
        for batch in slices(batches):
            for text, lang in zip(texts(batch.column("text")), batch.column("lang").to_pylist()):
                codes, n = grams(text)
                own = sums.setdefault(lang, Counter())
                for c, k in zip(codes.tolist(), n.tolist()):
                    own[c] += k
        for lang, own in sums.items():
            yield batch_of(_counts, [[lang] * len(own), list(own), list(own.values())])

    found = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for x in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).orderBy("lang", "rank").collect():  # TOP rows per language
        profiles.setdefault(x.lang, []).append(x.gram)
    return Model(profiles)


def classify(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with a language and its score; columns of these names are replaced.

    Predictions use the whole text and nothing else.  Null texts and texts without letters
    are ``und`` with score 0.  Repeated rows stay; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c not in (lang, score)]
    docs = docs.select(*keep)
    schema = StructType([*docs.schema, StructField(lang, StringType()), StructField(score, DoubleType())])
    text = keep.index("text")

    def run(batches):
        for batch in slices(batches):
            found = [model.predict(x) for x in batch.column(text).to_pylist()]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*keep, lang, score])

    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = classify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
