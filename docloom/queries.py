"""Queries over the ``qa_docs`` view, one or more per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.clients import Scripted
from .functions.langid import PROFILES, TOP, NgramDetector, profiles, words
from .functions.qa import realign
from .functions.text import overlaps
from .operators.base import once
from .operators.filters import DedupQuestions, Language, LanguageOcr, NGramOverlap, TextLength, local_dedup
from .plans import cascade, generate, report
from .schema import COUNTED, qa_docs

LANGUAGE = "en"


def _local_client() -> Scripted:
    return Scripted(local_dedup)


def _by_place(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row per element.  The array is made once: Spark filters empty arrays before it
    explodes a column, and would compute the column's expression for that as well."""
    return once(df.select("doc_id", column), column, F.col(column)).select("doc_id", F.posexplode(column).alias("pos", name))


def qa_docs_shape(spark, sf_dir):
    return qa_docs(spark, sf_dir).groupBy("dataset_split").agg(F.count("*").alias("n_rows"), F.sum(F.size("questions")).alias("n_questions"), F.sum(F.size("answers")).alias("n_answers"))


def text_length_kept(spark, sf_dir):
    return TextLength().apply(qa_docs(spark, sf_dir))[0].select("doc_id", "dataset_split", "filter_value")


def text_length_removed(spark, sf_dir):
    return TextLength().apply(qa_docs(spark, sf_dir))[1].select("doc_id", "dataset_split", "filter_value")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("bin", F.round("low", 6).alias("low"), "n", F.round("density", 6).alias("density"))


def text_length_histogram(spark, sf_dir):
    return _rounded(report.histogram(TextLength().values(TextLength().annotate(qa_docs(spark, sf_dir)))))


def ngram_overlap_per_question(spark, sf_dir):
    found = _by_place(NGramOverlap().annotate(qa_docs(spark, sf_dir)), "filter_value", "overlap")
    return found.withColumn("overlap", F.round("overlap", 6))


def ngram_overlap_expression(spark, sf_dir):
    """The same scores without Python."""
    docs = qa_docs(spark, sf_dir)
    found = _by_place(docs.withColumn("o", overlaps(F.col("text"), F.col("questions"), 4)), "o", "overlap")
    return found.withColumn("overlap", F.round("overlap", 6))


def ngram_kept_questions(spark, sf_dir):
    return _by_place(NGramOverlap().apply(qa_docs(spark, sf_dir))[0], "questions", "question")


def ngram_removed_docs(spark, sf_dir):
    return NGramOverlap().apply(qa_docs(spark, sf_dir))[1].select("doc_id", F.size("questions").alias("n_questions"))


def ngram_histogram(spark, sf_dir):
    return _rounded(report.histogram(NGramOverlap().values(NGramOverlap().annotate(qa_docs(spark, sf_dir)))))


def answers_realigned(spark, sf_dir):
    docs = qa_docs(spark, sf_dir)
    return _by_place(docs.withColumn("a", realign(F.col("questions"), F.col("answers"), F.col("questions"))), "a", "answer")


def answers_realigned_strict(spark, sf_dir):
    docs = qa_docs(spark, sf_dir)
    return _by_place(docs.withColumn("a", realign(F.col("questions"), F.col("answers"), F.reverse("questions"), "strict")), "a", "answer")


def qa_length_mismatch(spark, sf_dir):
    return report.length_mismatches(qa_docs(spark, sf_dir))


def lang_kept(spark, sf_dir):
    return _by_place(Language(LANGUAGE).apply(qa_docs(spark, sf_dir))[0], "questions", "question")


def lang_counts(spark, sf_dir):
    stage = Language(LANGUAGE)
    return report.categories(stage.values(stage.annotate(qa_docs(spark, sf_dir))))


def lang_ocr_kept(spark, sf_dir):
    return _by_place(LanguageOcr(LANGUAGE).apply(qa_docs(spark, sf_dir))[0], "questions", "question")


def lang_ocr_counts(spark, sf_dir):
    stage = LanguageOcr(LANGUAGE)
    return report.categories(stage.values(stage.annotate(qa_docs(spark, sf_dir))))


def _learned(spark, sf_dir) -> NgramDetector:
    return NgramDetector.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lang_ngram_kept(spark, sf_dir):
    """As ``lang_kept``, with the detector by trigram profiles."""
    return _by_place(Language(LANGUAGE, _learned(spark, sf_dir)).apply(qa_docs(spark, sf_dir))[0], "questions", "question")


def lang_ngram_counts(spark, sf_dir):
    stage = LanguageOcr(LANGUAGE, _learned(spark, sf_dir))
    return report.categories(stage.values(stage.annotate(qa_docs(spark, sf_dir))))


def lang_ngram_profiles(spark, sf_dir):
    return profiles(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("lang", "gram", "n", "rank")


def lang_learned_words(spark, sf_dir):
    """The words that a detector learns from: counts by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    found = docs.select("lang", F.explode(words(F.col("text"))).alias("word"))
    return found.where(F.col("word").isin(sorted({w for p in PROFILES.values() for w in p}))).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _replied(docs: DataFrame) -> DataFrame:
    """Scripted replies by doc_id: a reversed list in a code fence, no list, a list that is
    too long, an invented question beside the first one and its repeat."""
    q, k = F.col("questions"), F.col("doc_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```python\n"), F.to_json(F.reverse(q)), F.lit("\n```"))).when(k == 1, "no list here")
    reply = reply.when(k == 2, F.to_json(F.concat(q, q))).otherwise(F.to_json(F.concat(F.array(F.lit("invented")), F.slice(q, 1, 1))))
    return docs.withColumn("reply", reply)


def dedup_post_process(spark, sf_dir):
    rows = DedupQuestions(_local_client).decide(_replied(qa_docs(spark, sf_dir)))
    return rows.select("doc_id", "filter_value", "removed", F.size("answers").alias("n_answers"), F.array_join("questions", "\n").alias("questions"))


def dedup_local(spark, sf_dir):
    return _by_place(DedupQuestions(_local_client).annotate(qa_docs(spark, sf_dir)), "questions", "question")


def _stages():
    return [TextLength(), NGramOverlap(), Language(LANGUAGE)]


def cascade_summary(spark, sf_dir):
    return cascade.summary(qa_docs(spark, sf_dir), _stages()).drop("label")


def cascade_final(spark, sf_dir):
    return _by_place(cascade.chained(qa_docs(spark, sf_dir), _stages())[-1].where(~F.col("removed")), "questions", "question")


def cascade_final_answers(spark, sf_dir):
    return _by_place(cascade.chained(qa_docs(spark, sf_dir), _stages())[-1].where(~F.col("removed")), "answers", "answer")


def _by_number():
    return ((F.col("doc_id") * 4 + F.col("attempt")) % 3).cast("int")


def fewshot_pick(spark, sf_dir):
    return generate.attempts(qa_docs(spark, sf_dir)).select("doc_id", "attempt", _by_number().alias("example"), F.length("source").alias("source_chars"))


def prompt_build(spark, sf_dir):
    return generate.prompts(generate.attempts(qa_docs(spark, sf_dir)), _by_number()).select("doc_id", "attempt", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def qa_extract(spark, sf_dir):
    rows = generate.attempts(qa_docs(spark, sf_dir))
    start = F.col("attempt") * 40 + 1
    asked, told = F.substring(F.col("text"), start, F.lit(20)), F.substring(F.col("text"), start + 20, F.lit(20))
    end = F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.lit("\n"))
    rows = rows.withColumn("reply", F.concat(F.lit("Kérdés: "), asked, end, F.lit("Válasz: "), told))
    found = generate.collected(rows, ["doc_id", "dataset_split"])
    return found.select("doc_id", F.posexplode(F.arrays_zip("questions", "answers")).alias("pos", "pair")).select("doc_id", "pos", F.col("pair.questions").alias("question"), F.col("pair.answers").alias("answer"))


def sample_per_split(spark, sf_dir):
    return report.sample_per_split(qa_docs(spark, sf_dir), 10, (F.col("doc_id") * 7919) % 1009).select("doc_id", "dataset_split")


def display_projection(spark, sf_dir):
    return report.displayed(qa_docs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        qa_docs_shape, text_length_kept, text_length_removed, text_length_histogram, ngram_overlap_per_question, ngram_overlap_expression, ngram_kept_questions, ngram_removed_docs,
        ngram_histogram, answers_realigned, answers_realigned_strict, qa_length_mismatch, lang_kept, lang_counts, lang_ocr_kept, lang_ocr_counts, lang_ngram_kept, lang_ngram_counts, lang_ngram_profiles, lang_learned_words,
        dedup_post_process, dedup_local, cascade_summary, cascade_final, cascade_final_answers, fewshot_pick, prompt_build, qa_extract, sample_per_split, display_projection,
    )
}

# --- SQL ---------------------------------------------------------------------------------

_QA = """
talks AS (
    SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS asked, list(text ORDER BY turn) FILTER (role = 'assistant') AS told
    FROM conversations GROUP BY conv_id),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
qa AS (
    SELECT doc_id, text,
        CASE doc_id % 10 WHEN 8 THEN 'val' WHEN 9 THEN 'test' ELSE 'train' END AS dataset_split,
        CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 40) ELSE text || ' ' || text END AS ocr,
        CASE WHEN doc_id % 7 = 0 THEN [] ELSE [substr(text, 1, 60), substr(text, 101, 60)] END || coalesce(asked, [])
            || CASE WHEN doc_id % 50 = 0 THEN ['a b c'] WHEN doc_id % 5 = 0 THEN [substr(text, 1, 60)] ELSE [] END AS questions,
        ['first answer', 'second answer'] || coalesce(told, []) AS answers
    FROM docs LEFT JOIN talks ON doc_id % (SELECT coalesce(max(conv_id) + 1, 1) FROM conversations) = conv_id),
qs AS (SELECT doc_id, unnest(questions) AS question, generate_subscripts(questions, 1) - 1 AS pos FROM qa),
ans AS (SELECT doc_id, unnest(answers) AS answer, generate_subscripts(answers, 1) - 1 AS pos FROM qa),
known AS (SELECT doc_id, question, arg_max(answer, pos) AS answer FROM qs JOIN ans USING (doc_id, pos) GROUP BY doc_id, question)"""


def _grams(text: str) -> str:
    return f"(SELECT list_distinct(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) FROM (SELECT string_split(replace({text}, ' ', ''), '') AS c))"


_OVERLAP = f"""
tg AS (SELECT doc_id, {_grams('text')} AS g, length(text) AS size FROM qa),
qg AS (SELECT DISTINCT question, {_grams('question')} AS g FROM (SELECT DISTINCT question FROM qs)),
scores AS (
    SELECT qs.doc_id, pos, qs.question,
        CASE WHEN size < 4 OR length(qs.question) < 4 THEN 0.0 WHEN len(qg.g) = 0 THEN NULL
             ELSE len(list_intersect(tg.g, qg.g))::DOUBLE / len(qg.g) END AS overlap
    FROM qs JOIN tg USING (doc_id) JOIN qg USING (question)),
passed AS (SELECT doc_id, question, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM scores WHERE overlap > 0.12)"""


def _histogram(values: str) -> str:
    return f"""
v AS ({values}),
box AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v),
kept AS (SELECT v FROM v, box WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)),
ends AS (SELECT count(*) AS total, min(v) - CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS lo, max(v) + CASE WHEN min(v) = max(v) THEN 0.5 ELSE 0 END AS hi FROM kept),
binned AS (SELECT least(floor((v - lo) / ((hi - lo) / 30)), 29)::INT AS bin, lo, (hi - lo) / 30 AS w, total FROM kept, ends)
SELECT bin, round(lo + bin * w, 6) AS low, count(*) AS n, round(count(*) / (total * w), 6) AS density FROM binned GROUP BY bin, lo, w, total"""


def _detect(text: str, otherwise: str) -> str:
    names = sorted(PROFILES)
    hits = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(p) for p in PROFILES[n])})))" for n in names)
    choice = " ".join(f"WHEN h[{i}] = list_max(h) THEN '{n}'" for i, n in enumerate(names, 1))
    return f"(SELECT coalesce(CASE WHEN list_max(h) > 0 THEN CASE {choice} END END, {otherwise}) FROM (SELECT [{hits}] AS h FROM (SELECT regexp_split_to_array(lower({text}), '[^\\p{{L}}]+') AS w)))"


_LANG = f"""
tl AS (SELECT doc_id, {_detect('text', repr(LANGUAGE))} AS lang, {_detect('text', "'None'")} AS told, {_detect('ocr', "'None'")} AS ocr_told FROM qa),
ql AS (SELECT question, {_detect('question', "'?'")} AS lang FROM (SELECT DISTINCT question FROM qs))"""

def _trigrams(text: str) -> str:
    padded = f"string_split(' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g')) || ' ', '')"
    return f"(SELECT list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]) FROM (SELECT {padded} AS c))"


_PROFILES = f"""
counted AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_trigrams('text')}) AS gram FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY lang, gram),
profile AS (SELECT lang, gram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank FROM counted) WHERE rank < {TOP}),
named AS (SELECT lang, gram, count(*) OVER (PARTITION BY lang) - rank AS weight FROM profile)"""

_NGRAM_LANG = f"""
{_PROFILES},
said AS (SELECT DISTINCT text AS s FROM qa UNION SELECT DISTINCT ocr FROM qa UNION SELECT DISTINCT question FROM qs),
scored AS (SELECT s, lang, sum(weight) AS score FROM (SELECT s, unnest({_trigrams('s')}) AS gram FROM said) JOIN named USING (gram) GROUP BY s, lang),
best AS (SELECT s, arg_min(lang, (-score, lang)) AS lang FROM scored GROUP BY s)"""

_CASCADE = f"""
{_QA}, {_OVERLAP}, {_LANG},
s0 AS (SELECT doc_id, dataset_split, 0 AS stage FROM qa),
s1 AS (SELECT doc_id, dataset_split FROM qa WHERE greatest(length(text), length(ocr)) >= 60),
q2 AS (SELECT p.* FROM passed p JOIN s1 USING (doc_id)),
q3 AS (SELECT doc_id, question, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos
       FROM q2 JOIN ql USING (question) JOIN tl USING (doc_id) WHERE ql.lang = '{LANGUAGE}' AND tl.lang = '{LANGUAGE}')"""

# answers after the second stage pair with its questions anew, by position
_AFTER_2 = """
a2 AS (SELECT q2.doc_id, answer, row_number() OVER (PARTITION BY q2.doc_id ORDER BY q2.pos) - 1 AS pos FROM q2 JOIN known USING (doc_id, question)),
known2 AS (SELECT doc_id, question, arg_max(answer, pos) AS answer FROM q2 JOIN a2 USING (doc_id, pos) GROUP BY doc_id, question)"""

_EXAMPLES = ", ".join("{'t': '%s', 'q': '%s', 'a': '%s'}" % e for e in generate.EXAMPLES)

ORACLE_SQL = {
    "qa_docs_shape": f"WITH {_QA} SELECT dataset_split, count(*) AS n_rows, sum(len(questions))::BIGINT AS n_questions, sum(len(answers))::BIGINT AS n_answers FROM qa GROUP BY dataset_split",
    "text_length_kept": f"WITH {_QA} SELECT doc_id, dataset_split, greatest(length(text), length(ocr))::INT AS filter_value FROM qa WHERE greatest(length(text), length(ocr)) >= 60",
    "text_length_removed": f"WITH {_QA} SELECT doc_id, dataset_split, greatest(length(text), length(ocr))::INT AS filter_value FROM qa WHERE greatest(length(text), length(ocr)) < 60",
    "text_length_histogram": f"WITH {_QA}, {_histogram('SELECT greatest(length(text), length(ocr))::DOUBLE AS v FROM qa')}",
    "ngram_overlap_per_question": f"WITH {_QA}, {_OVERLAP} SELECT doc_id, pos::INT AS pos, round(overlap, 6) AS overlap FROM scores",
    "ngram_overlap_expression": f"WITH {_QA}, {_OVERLAP} SELECT doc_id, pos::INT AS pos, round(overlap, 6) AS overlap FROM scores",
    "ngram_kept_questions": f"WITH {_QA}, {_OVERLAP} SELECT doc_id, pos::INT AS pos, question FROM passed",
    "ngram_removed_docs": f"WITH {_QA}, {_OVERLAP} SELECT doc_id, 0 AS n_questions FROM qa WHERE doc_id NOT IN (SELECT doc_id FROM passed)",
    "ngram_histogram": f"WITH {_QA}, {_OVERLAP}, {_histogram('SELECT overlap AS v FROM scores WHERE overlap IS NOT NULL')}",
    "answers_realigned": f"WITH {_QA} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, answer FROM qs JOIN known USING (doc_id, question)",
    "answers_realigned_strict": f"WITH {_QA} SELECT qs.doc_id, (len(questions) - 1 - pos)::INT AS pos, answer FROM qs JOIN qa USING (doc_id) LEFT JOIN known ON qs.doc_id = known.doc_id AND qs.question = known.question",
    "qa_length_mismatch": f"WITH {_QA} SELECT doc_id, dataset_split, len(questions)::INT AS n_questions, len(answers)::INT AS n_answers FROM qa WHERE len(questions) <> len(answers) AND dataset_split IN {COUNTED}",
    "lang_kept": f"WITH {_QA}, {_LANG} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, question FROM qs JOIN ql USING (question) JOIN tl USING (doc_id) WHERE ql.lang = '{LANGUAGE}' AND tl.lang = '{LANGUAGE}'",
    "lang_counts": f"WITH {_QA}, {_LANG} SELECT lang AS value, count(*) AS n FROM tl GROUP BY lang",
    "lang_ocr_kept": f"WITH {_QA}, {_LANG} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, question FROM qs JOIN ql USING (question) JOIN tl USING (doc_id) WHERE ql.lang = '{LANGUAGE}' AND '{LANGUAGE}' IN (tl.told, tl.ocr_told)",
    "lang_ocr_counts": f"WITH {_QA}, {_LANG} SELECT value, count(*) AS n FROM (SELECT told AS value FROM tl UNION ALL SELECT ocr_told FROM tl) GROUP BY value",
    "lang_ngram_kept": f"""WITH {_QA}, {_NGRAM_LANG}
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, question
        FROM qs JOIN best q ON q.s = question JOIN qa USING (doc_id) LEFT JOIN best t ON t.s = text WHERE q.lang = '{LANGUAGE}' AND coalesce(t.lang, '{LANGUAGE}') = '{LANGUAGE}'""",
    "lang_ngram_counts": f"""WITH {_QA}, {_NGRAM_LANG}
        SELECT coalesce(lang, 'None') AS value, count(*) AS n FROM (SELECT text AS s FROM qa UNION ALL SELECT ocr FROM qa) LEFT JOIN best USING (s) GROUP BY 1""",
    "lang_ngram_profiles": f"WITH {_PROFILES} SELECT lang, gram, n, rank::INT AS rank FROM profile",
    "lang_learned_words": f"""SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents WHERE lang IS NOT NULL)
        WHERE word IN ({', '.join(repr(w) for w in sorted({w for p in PROFILES.values() for w in p}))}) GROUP BY lang, word""",
    "dedup_post_process": f"""WITH {_QA},
        listed AS (
            SELECT *, CASE WHEN len(questions) <= 1 OR doc_id % 4 IN (1, 2) THEN questions WHEN doc_id % 4 = 0 THEN list_reverse(questions) ELSE ['invented'] || questions[1:1] END AS named FROM qa),
        stripped AS (SELECT doc_id, questions, list_filter(list_transform(named, lambda x: regexp_replace(x, '^[\\s\\v\\x1c-\\x1f]+|[\\s\\v\\x1c-\\x1f]+$', '', 'g')), lambda x: list_contains(questions, x)) AS final FROM listed),
        sizes AS (SELECT s.doc_id, count(known.answer) AS n FROM (SELECT doc_id, unnest(final) AS question FROM stripped) s LEFT JOIN known ON s.doc_id = known.doc_id AND s.question = known.question GROUP BY s.doc_id)
        SELECT s.doc_id, (len(questions) - len(final))::INT AS filter_value, len(final) = 0 AS removed, coalesce(n, 0)::INT AS n_answers, array_to_string(final, chr(10)) AS questions
        FROM stripped s LEFT JOIN sizes USING (doc_id)""",
    "dedup_local": f"""WITH {_QA},
        firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]', '', 'g') ORDER BY pos) AS r FROM qs),
        trimmed AS (SELECT doc_id, pos, regexp_replace(question, '^[\\s\\v\\x1c-\\x1f]+|[\\s\\v\\x1c-\\x1f]+$', '', 'g') AS question FROM firsts WHERE r = 1)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, question FROM trimmed WHERE (doc_id, question) IN (SELECT doc_id, question FROM qs)""",
    "cascade_summary": f"""WITH {_CASCADE},
        per AS (
            SELECT 0 AS stage, (SELECT count(*) FROM qa) AS n_rows, (SELECT count(*) FROM qs) AS n_questions
            UNION ALL SELECT 1, (SELECT count(*) FROM s1), (SELECT count(*) FROM qs JOIN s1 USING (doc_id))
            UNION ALL SELECT 2, (SELECT count(DISTINCT doc_id) FROM q2), (SELECT count(*) FROM q2)
            UNION ALL SELECT 3, (SELECT count(DISTINCT doc_id) FROM q3), (SELECT count(*) FROM q3))
        SELECT stage, n_rows, coalesce(lag(n_rows) OVER w - n_rows, 0)::BIGINT AS removed_rows, n_questions, coalesce(lag(n_questions) OVER w - n_questions, 0)::BIGINT AS removed_questions,
            round(n_rows * 100.0::DOUBLE / nullif(first(n_rows) OVER w, 0), 6) AS percent
        FROM per WINDOW w AS (ORDER BY stage)""",
    "cascade_final": f"WITH {_CASCADE} SELECT doc_id, pos::INT AS pos, question FROM q3",
    "cascade_final_answers": f"WITH {_CASCADE}, {_AFTER_2} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, answer FROM q3 JOIN known2 USING (doc_id, question)",
    "fewshot_pick": f"WITH {_QA} SELECT doc_id, attempt::INT AS attempt, ((doc_id * 4 + attempt) % 3)::INT AS example, length(CASE WHEN attempt % 2 = 0 THEN ocr ELSE text END)::INT AS source_chars FROM qa, range(4) AS t(attempt)",
    "prompt_build": f"""WITH {_QA}, e AS (SELECT [{_EXAMPLES}] AS e)
        SELECT doc_id, attempt::INT AS attempt, md5('Szöveg: ' || x.t || chr(10) || 'Kérdés: ' || x.q || chr(10) || 'Válasz: ' || x.a || chr(10) || chr(10) || 'Szöveg: ' || source || chr(10) || 'Kérdés: ') AS prompt_md5
        FROM (SELECT doc_id, attempt, CASE WHEN attempt % 2 = 0 THEN ocr ELSE text END AS source, e[((doc_id * 4 + attempt) % 3 + 1)::INT] AS x FROM qa, range(4) AS t(attempt), e)""",
    "qa_extract": f"""WITH {_QA},
        replies AS (SELECT doc_id, attempt, 'Kérdés: ' || substr(text, attempt * 40 + 1, 20) || CASE WHEN doc_id % 6 = 0 THEN '' ELSE chr(10) END || 'Válasz: ' || substr(text, attempt * 40 + 21, 20) AS r FROM qa, range(4) AS t(attempt)),
        pairs AS (SELECT doc_id, attempt, regexp_extract(r, 'Kérdés: ([^\\n]+)\\n', 1) AS question, regexp_extract(r, 'Válasz: ([^\\n]+)', 1) AS answer FROM replies)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY attempt) - 1)::INT AS pos, question, answer FROM pairs WHERE question <> '' AND answer <> ''""",
    "sample_per_split": f"WITH {_QA} SELECT doc_id, dataset_split FROM (SELECT *, row_number() OVER (PARTITION BY dataset_split ORDER BY doc_id * 7919 % 1009, doc_id) AS r FROM qa) WHERE r <= 10",
    "display_projection": f"WITH {_QA} SELECT doc_id, replace(substr(questions[1], 1, 100), '$', '[DOLLAR]') AS question, replace(substr(text, 1, 100), '$', '[DOLLAR]') AS text FROM qa",
}
