"""From raw documents to tokens: language ID, near-duplicates, surrogates for
personal data, mixing of sources, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again for the next one.  All but the
last return the columns of ``documents``; other columns are left out.  An empty
table passes through all of them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from thalweg.llm import langid, mixing, ngramjoin, pieces, pii
from thalweg.llm.common import WORD, IdFilter, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A stage can't be written as SQL (trained models, fixpoints), so there is none for the whole.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determinable language (null, empty, without letters) go; a
    missing lang is filled in.  Repeated rows are each judged alike."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the smallest doc_id, a
    null one only if all are; of several rows with that id one.  A row goes for its own
    text, whatever other rows with its doc_id hold.  Texts without words all stay."""
    return ngramjoin.drop_near_duplicates(docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with surrogates for personal data and n_chars counted anew
    (null for a null text); equal texts stay equal."""
    out = pii.pseudonymise(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@F.arrow_udf(StringType())
def _head(text, words):
    """The first words of a text, up to the end of the last of them; null for null."""
    out = []
    for t, n in zip(text.to_pylist(), words.to_pylist(), strict=True):
        end = 0
        for k, m in enumerate(re.finditer(WORD, t or "")):
            if k >= n:
                break
            end = m.end()
        out.append(t and t[:end])
    return pa.array(out, pa.string())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once up to the cut of its
    source if that falls into it; documents that aren't taken, among them those without
    words, go.  The words that come out are those that the mix takes.

    Rows that agree in doc_id, source and text are one text with several shares: it is
    emitted once for each (lang and n_chars are those of any of the rows).
    """
    docs = docs.select(*COLUMNS).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    mixed = mixing.mix_sources(docs, keep=("th",)).where("taken > 0")
    # equal rows have few different shares: whole epochs, one more, and the one at the cut
    shares = mixed.groupBy("doc_id", "source", "th", "size", "taken").agg(F.count("*").alias("m"))
    share = F.struct((F.expr("taken div size")).alias("whole"), (F.expr("taken % size")).alias("part"), "m")
    taken = saved(shares.groupBy("doc_id", "source", "th").agg(F.collect_list(share).alias("shares"), F.sum("m").alias("rows")), "shares")
    several = IdFilter(taken.where("rows > 1"), "th")
    names = {c: f"{c}_of" for c in ("doc_id", "source", "th")}
    taken = taken.withColumnsRenamed(names)
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
    once = docs.where(~several.holds("th")).unionByName(docs.where(several.holds("th")).dropDuplicates([*names]))
    each = once.join(taken, same).withColumn("share", F.explode("shares"))
    # the m-th row of a share: so many whole texts, and the head of one
    each = each.withColumn("copy", F.explode(F.concat(F.array_repeat(F.lit(True), (F.col("share.m") * F.col("share.whole")).cast("int")), F.when(F.col("share.part") > 0, F.array_repeat(F.lit(False), F.col("share.m").cast("int"))).otherwise(F.array().cast("array<boolean>")))))
    head = _head(F.when(~F.col("copy"), F.col("text")), F.col("share.part"))
    each = each.withColumn("text", F.when(F.col("copy"), F.col("text")).otherwise(head))
    return each.withColumn("n_chars", F.when(F.col("copy"), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and n_chunks; null and empty texts have no
    tokens, and repeated rows are each encoded."""
    return pieces.encode(docs.select(*COLUMNS), pieces.Pieces.load())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), re.sub(r"\W+", "-", name))
    return STAGES[-1][1](spark, docs, sf_dir)
