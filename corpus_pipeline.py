"""A corpus pipeline: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and all but the
last return the columns of documents. Rows go through an operator whole, as its key, so that no stage
but the removal of near-duplicates moves texts between executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, pii, simhash
from tessera.llm.common import remove, scratch, write, written
from tessera.llm.queries import held_out, table, vocabulary

#: A text of whose n-grams a smaller share is known from learned texts, or whose best language scores less, is in no learned language.
LEAST_FAMILIAR, LEAST_SCORE = 0.6, 0.25


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.col("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in no learned language, go."""
    got = langid.identify(_whole(docs), docs.where(~held_out()), key="row", lang="lang")
    return got.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & (F.col("familiar") >= LEAST_FAMILIAR)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id (a null one only if the group has no other), then the least hash.

    Rows are told apart by id and text, so a row that shares its id with a duplicate is not lost; of rows that repeat
    both, the least in all columns stays.
    """
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    rows = docs.select(F.struct("*").alias("row"), named.alias("name"))  # no other columns: theirs may have any name
    groups = written(simhash.simhash_groups(docs.select(named.alias("name"), "text"), key="name").select("name", (F.col("name") == F.col("component_id")).alias("kept")), "groups")
    stay = rows.join(groups.where(~F.col("kept")).select("name").distinct(), "name", "left_anti")
    again = groups.where("kept").groupBy("name").count().where("count > 1").select("name")
    if again.isEmpty():
        return stay.select("row.*")
    once = stay.join(again, "name", "left_semi").groupBy("name").agg(F.min("row").alias("row"))
    return stay.join(again, "name", "left_anti").select("row").union(once.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is in passages of the benchmark go."""
    got = decontaminate.decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), key="row")
    return got.where(~F.col("contaminated")).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; identifiers in its text become the name of their kind, and n_chars follows."""
    got = pii.find_pii(_whole(docs), key="row")
    new = {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))}
    return got.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the cleaned documents."""
    return bpe.encode_decode(docs, vocabulary(), keep_ids=False)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Kernel scores, XXH64 fingerprints, spans and BPE are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet and read again by the next.

    Once that is written, the tables the stage read and made are deleted; those of the last stage stay, for its rows are made when they are read.
    """
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs, path = write(stage(spark, docs, sf_dir), name)
        for old in {*held, *made} - {path}:
            remove(spark, old)
        held = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
