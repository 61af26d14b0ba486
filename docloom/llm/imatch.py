"""I-Match document fingerprints, in DataFrame expressions only.

A document's distinct terms are kept within a band of inverse document frequency, sorted,
and hashed once per randomised subset of the lexicon.  The subsets form a tree: the bits
of a term's own hash halve the lexicon level by level, and from ``WIDTH`` subsets on only
the first half of a level is divided again.  So there are ``WIDTH`` subsets of every
density down to a 4096th, and texts of every length have some that an edit leaves alone.
The few first levels are also taken of all terms, for texts with hardly any in the band.
The likeness of two documents is the share of subsets on which they agree, of those that
either has terms of.

A term is in the band if between ``LOW`` and ``HIGH`` of all documents have it.  That
bounds the lexicon, however large the corpus is: documents with T distinct terms each
on average have at most T / LOW terms as frequent as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Shares of all documents that a term of the lexicon occurs in (idf 6.2 to 1.6).
LOW, HIGH = 0.002, 0.2
#: Levels of the tree of subsets of the band, and of all terms; most subsets of a level.
LEVELS, ALL_LEVELS, WIDTH = 12, 4, 32
#: Documents are put in order together by ranges of about ``RANGE_ROWS`` rows, or of more
#: where that takes more than ``COARSE`` ** 2 ranges.
RANGE_ROWS, COARSE = 2048, 128
#: Buckets of the lexicon's look-up table.
BUCKETS = 8192


def terms(text: Column) -> Column:
    """The distinct words (runs of letters and digits, lower case) as 64-bit hashes."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda x: x != ""), lambda x: F.xxhash64(x)))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term) for all terms in the band; counts cover all rows of ``docs`` (text)."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").count()
    # at least two documents, so that a tiny corpus has a lexicon of shared terms
    return counts.where((F.col("count") >= max(2.0, LOW * n)) & (F.col("count") <= max(2.0, HIGH * n))).select("term")


def look_up(words: DataFrame) -> Column:
    """The lexicon as one value, an array of ``BUCKETS`` arrays by the terms' remainders:
    a subquery of one row with at most T / LOW terms."""
    own = words.groupBy(F.pmod("term", F.lit(BUCKETS)).alias("id")).agg(F.collect_list("term").alias("own"))
    every = words.sparkSession.range(BUCKETS).join(own, "id", "left")
    slots = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("own", F.array().cast("array<bigint>")).alias("own")))), lambda x: x["own"])
    return every.agg(slots.alias("slots")).scalar()


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(own: Column, levels: int) -> Column:
    """For each lexicon subset, level by level, the hash of the terms in it; null if none.
    ``own`` is sorted, and so is what is kept of it."""

    def go(groups: Column, level: int, n: int) -> Column:
        marks = F.transform(groups, lambda g: F.when(F.size(g) > 0, F.hash(g)))
        if level == levels:
            return marks
        bit = F.lit(63 - level)
        halves = lambda g: F.array(F.filter(g, lambda x: F.getbit(x, bit) == 0), F.filter(g, lambda x: F.getbit(x, bit) == 1))
        divided = F.flatten(F.transform(groups if n < WIDTH else F.slice(groups, 1, WIDTH // 2), halves))
        return F.concat(marks, bound(divided, lambda x: go(x, level + 1, min(2 * n, WIDTH))))

    return bound(F.array(own), lambda x: go(x, 0, 1))


def fingerprinted(df: DataFrame, name: str, text: str, table: Column) -> DataFrame:
    """``df`` with the signatures of a text column as an array of nullable integers: those
    of the terms in the band, then those of all terms."""
    inside = lambda every: F.filter(every, lambda x: F.array_contains(F.get("table", F.pmod(x, F.lit(BUCKETS)).cast("int")), x))
    marks = bound(F.sort_array(terms(F.col(text))), lambda every: F.concat(signatures(inside(every), LEVELS), signatures(every, ALL_LEVELS)))
    return df.select("*", table.alias("table")).select(*df.columns, marks.alias(name))  # no subquery may stand inside of the functions


def shown(marks: Column) -> Column:
    """A fingerprint as text: 8 hex digits per subset, ``-`` for a subset without terms."""
    return F.array_join(F.transform(marks, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with equal hashes, of those that either text has terms of; 1
    for two texts without any terms."""
    count = lambda test: F.size(F.filter(F.zip_with(a, b, test), lambda x: x))
    known = F.size(a) - count(lambda x, y: x.isNull() & y.isNull())
    return F.when(known == 0, F.lit(1.0)).otherwise(count(lambda x, y: x == y) / known)


def ranges(docs: DataFrame) -> Column:
    """The number of a row's range of doc_id: ranges hold about equally many rows, whatever
    the ids are; -1 for null ids."""
    n = docs.count()
    many = min(COARSE**2, n // RANGE_ROWS)
    if many < 1:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    shares = [k / (many + 1) for k in range(1, many + 1)]
    own = docs.agg(F.percentile_approx("doc_id", shares, 10 * many).alias("own")).first().own or []
    own = sorted(set(own))
    # looked up in two steps: which of the coarse bounds, then which of those up to the next
    parts = [own[k : k + COARSE] for k in range(0, len(own), COARSE)] or [[]]
    array = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<bigint>")
    reached = lambda x: F.size(F.filter(x, lambda v: v <= F.col("doc_id")))
    coarse = reached(array([x[0] for x in parts[1:]]))
    fine = F.array(*[array(x) for x in parts])
    return F.when(F.col("doc_id").isNull(), -1).otherwise(coarse * COARSE + reached(F.get(fine, coarse)))


def with_next(docs: DataFrame, table: Column) -> DataFrame:
    """``docs`` (doc_id, text) with marks, and next: the text and marks of the next row in
    ascending (doc_id, text), nulls first; after the last row comes the first.

    Rows are dealt once, by ranges of doc_id, and put in order in their range; the first
    row of each range is then given to the last row of the range before.
    """
    where = ranges(docs)
    dealt = fingerprinted(docs.select("doc_id", "text", where.alias("range")).repartition("range"), "marks", "text", table)
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    ahead = dealt.withColumn("ahead", F.lead(F.struct("text", "marks")).over(order))
    # one row per range, of which there are COARSE ** 2 + 2 at most
    least = docs.select(where.alias("range"), "doc_id").groupBy("range").agg(F.min("doc_id").alias("least"))
    around = Window.orderBy("range")
    top = least.agg(F.max("range")).scalar()
    its = least.select("range", "least", F.coalesce(F.lag("range").over(around), top).alias("before"))
    heads = docs.join(F.broadcast(its), F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("before").agg(F.min("text").alias("text"))
    first = fingerprinted(heads, "marks", "text", table).select("before", F.struct("text", "marks").alias("first"))
    joined = ahead.join(first, F.col("range") == F.col("before"), "left")
    return joined.select("doc_id", "text", "marks", F.coalesce("ahead", "first").alias("next"))


def edited(text: Column, after: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of
    ``after``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def imatch(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, marks (the fingerprint), edited_sha256,
    edited_marks, and next_marks of the next document in ascending doc_id.

    Null texts count as empty; texts without terms have no signatures; equal texts have
    equal fingerprints.  Rows with equal doc_id are ordered by text and rows with null
    doc_id come first; a single row is its own next; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = look_up(stored(lexicon(docs), "lexicon"))
    other = edited(F.col("text"), F.col("next.text"))
    found = with_next(docs, table).select("doc_id", F.length("text").cast("long").alias("n_chars"), "marks", F.col("next.marks").alias("next_marks"), other.alias("edited"))
    return fingerprinted(found, "edited_marks", "edited", table).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = imatch(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", shown(F.col("marks")).alias("fingerprint"), shown(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
