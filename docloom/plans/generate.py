"""Question-answer generation by few-shot prompts of a language model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clients import asking

ATTEMPTS, SEED = 4, 42
# The labels that prompts and replies carry.
TEXT, QUESTION, ANSWER = "Szöveg: ", "Kérdés: ", "Válasz: "
TEMPLATE = "Szöveg: <text>\nKérdés: <question>\nVálasz: <answer>"
SYSTEM = (
    "Kérdés-válasz párokat írsz a szöveg egy-egy pontjáról. A kérdésre a szövegben legyen válasz, és lehetőleg használj tulajdonneveket. "
    "A formátum: „Kérdés: <kérdés>” és „Válasz: <válasz>”, külön sorban. Több szöveg közül csak az utolsóra hivatkozz."
)
#: Few-shot examples: (text, question, answer).  A parameter of all functions here.
EXAMPLES = [
    ("A könyvtár hétfőtől péntekig reggel nyolctól este hatig tart nyitva.", "Mikor zár a könyvtár pénteken?", "Este hatkor."),
    ("A kérelmet két példányban kell benyújtani, a határidő május 15.", "Hány példányban kell benyújtani a kérelmet?", "Két példányban."),
    ("A híd építését 1896-ban fejezték be, hossza 333 méter.", "Milyen hosszú a híd?", "333 méter."),
]


def attempts(df: DataFrame, n: int = ATTEMPTS) -> DataFrame:
    """``n`` rows per document: ``attempt`` from 0, and ``source``: OCR on even attempts,
    the text on odd ones."""
    rows = df.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("source", F.when(F.col("attempt") % 2 == 0, F.col("ocr")).otherwise(F.col("text")))


def pick(seed: int = SEED, n: int = len(EXAMPLES)) -> Column:
    """The number of the example: by document, attempt and seed, whatever the order."""
    return F.pmod(F.xxhash64("doc_id", "attempt", F.lit(seed)), F.lit(n)).cast("int")


def filled(text: Column, question: Column, answer: Column, template: str = TEMPLATE) -> Column:
    """The template, filled in this order; placeholders in earlier contents are filled too."""
    out = F.lit(template)
    for mark, value in (("<text>", text), ("<question>", question), ("<answer>", answer)):
        out = F.replace(out, F.lit(mark), value)
    return out


def prompts(df: DataFrame, choice: Column | None = None, examples=EXAMPLES) -> DataFrame:
    """``df`` (source) with ``prompt``: the chosen example, then the text to ask about."""
    table = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip("tqa", e)]) for e in examples])
    one = F.get(table, choice if choice is not None else pick(n=len(examples)))
    shot = filled(one["t"], one["q"], one["a"])
    return df.withColumn("prompt", F.concat(shot, F.lit("\n\n" + TEXT), F.col("source"), F.lit("\n" + QUESTION)))


def extract_question(reply: Column) -> Column:
    """The first question line; null unless a line break follows it."""
    return F.nullif(F.regexp_extract(reply, rf"(?d){QUESTION}(.+)\n", 1), F.lit(""))


def extract_answer(reply: Column) -> Column:
    return F.nullif(F.regexp_extract(reply, rf"(?d){ANSWER}(.+)", 1), F.lit(""))


def collected(df: DataFrame, keep: list[str]) -> DataFrame:
    """From rows (keep, attempt, reply) to one row per document that has a pair: arrays of
    questions and answers in the order of attempts."""
    pairs = df.select(*keep, "attempt", extract_question(F.col("reply")).alias("q"), extract_answer(F.col("reply")).alias("a")).where("q is not null and a is not null")
    own = pairs.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("attempt", "q", "a"))).alias("own"))
    return own.select(*keep, F.transform("own", lambda x: x["q"]).alias("questions"), F.transform("own", lambda x: x["a"]).alias("answers"))


def with_ocr(df: DataFrame, provider: Callable[[], object]) -> DataFrame:
    """Adds ``ocr`` from ``image`` if the table has no such column; nulls in one stay."""
    if "ocr" in df.columns:
        return df
    return df.withColumn("ocr", asking(provider, lambda own, image: own.read(image))(F.col("image")))


def generate(df: DataFrame, client: Callable[[], object], n: int = ATTEMPTS, seed: int = SEED, examples=EXAMPLES, ocr: Callable[[], object] | None = None, store: str | None = None, parallel: int = 1) -> DataFrame:
    """(doc_id, dataset_split, questions, answers) of documents with at least one pair;
    failed attempts are left out.  Join text and image back by doc_id.

    A table without ``ocr`` needs a provider.  With ``store``, a folder that all executors
    share, OCR and replies are written there and read again, so that no later step and no
    lost executor has a service asked again for what is written.
    """
    if "ocr" not in df.columns:
        if ocr is None:
            raise ValueError("the table has no ocr column: name an OCR provider")
        df = with_ocr(df.select("doc_id", "dataset_split", "text", "image"), ocr)
    spark = df.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        if store is None:
            return rows
        rows.write.mode("overwrite").parquet(f"{store}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{store}/{name}")

    def one(own, prompt):
        try:
            return own.complete([{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}], temperature=0.7)
        except Exception:  # noqa: BLE001  an attempt that fails is skipped
            return None

    docs = kept(df.select("doc_id", "dataset_split", "text", "ocr"), "ocr")
    rows = prompts(attempts(docs, n), pick(seed, len(examples)), examples)
    replied = rows.where("prompt is not null").select("doc_id", "dataset_split", "attempt", asking(client, one, parallel)(F.col("prompt")).alias("reply"))
    return collected(kept(replied, "replies"), ["doc_id", "dataset_split"])
