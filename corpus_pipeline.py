"""From raw documents to a training mix: quality, near-duplicates, benchmark leaks, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the mix. What a stage returns is written to the
shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleforge.llm import decontaminate, mixing, neardup, privacy, quality
from tripleforge.llm.common import Kept, fresh, small_enough
from tripleforge.llm.queries import table

#: Dropped ids are sent to every executor up to this number; beyond it documents and ids meet by a shuffle.
BROADCAST_IDS = 300_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, the model being fitted on labelled documents among them. Null and empty texts are scored too."""
    model, share = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = fresh(docs, "score")
    return quality.score(docs, model, share, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near-duplicates (five-word shingles, 0.8).

    An id goes when all its rows are copies of another's. Rows that agree in id and text become one; rows with a null id stay.
    """
    near = Kept(neardup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "classes").df
    gone = near.where("not kept and doc_id is not null").select("doc_id")
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = near.where("kept and rows > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return left
    twice = F.broadcast(twice) if small_enough(twice, BROADCAST_IDS) else twice
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars follows the text."""
    return privacy.sanitised(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs)["documents"]


STAGES = [("quality", keep_good), ("near-duplicates", keep_one_of_each_group), ("decontamination", drop_leaks), ("personal data", sanitise), ("mix", mix)]
#: The quality model, the alignment and the permutations of the mix are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Kept(docs, f"stage-{k}").df
    return docs
