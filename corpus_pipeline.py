"""Training corpus from raw documents: five stages, each on all that the one before kept.

1. toxicity: documents that the chain field rejects go (fitted on labelled rows that aren't held out);
2. near duplicates: one document of each group stays (five-word shingles, similarity 0.8);
3. decontamination: documents that hold an occurrence of a benchmark window go;
4. personal data: masked in the texts, with terms that give it away; ``n_chars`` follows the new text;
5. tokens: byte-level BPE ids with digests of the ids and of the decoded bytes.

The first four return the columns of their input. Null texts are empty texts for every stage and are kept
(a near-duplicate stage links them with nothing); an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secflow.llm import byte_bpe, decontaminate, near, privacy, toxicity
from secflow.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.clean_rows(docs, chain)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.one_of_each(docs, near.FIVE_WORDS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = privacy.sanitise(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.checked(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_benchmark), ("personal_data", mask_personal), ("tokens", encode)]
#: The chain field is a fitted model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
