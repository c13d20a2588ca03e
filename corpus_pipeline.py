"""The corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``, and further columns under their own names, whatever they are.

Every stage takes null and empty texts, null ids, repeated rows, very long texts and empty tables:

| Stage | Null or empty text | Null doc_id | Repeated rows | Ties | Empty table |
|-|-|-|-|-|-|
| quality | scored as an empty text | scored; never a training row | each scored alone | a score at the bound stays | empty; no model, nothing rejected |
| near_dedup | linked with nothing, stays | linked with nothing, stays | one row of equal rows of an id stays | the smallest id stays | empty |
| substring_dedup | stays as it is | loses only its own repeats | rows of an id do not cut each other | the smallest id keeps the passage | empty |
| personal_data | stays as it is | as others | each redacted alone | of spans over each other the first | empty; the model adds nothing |
| pack | one token, the end of text | packed, id null | each packed | any order of equal lengths | no pieces |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import minhash, packing, pii, quality_model, substrings
from quarrylens.llm.common import remove, scratch_path, table, temporary
from quarrylens.llm.queries import TOKENIZERS

#: Near copies are linked from this similarity of word shingles on: 100 * intersection >= 80 * union.
NEAR = (80, 100)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the rest stays as it is."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return quality_model.reject(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id; documents linked with nothing all stay.

    Of rows that repeat the id and text of the one that stays, one stays.
    """
    classes = minhash.near_duplicates(docs.select("doc_id", "text"), threshold=NEAR)
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    # ids are unique as a rule: only rows of those that are not are compared with each other
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return left
    same = left["doc_id"] == again["__again"]
    single = left.join(again, same, "left_anti")
    return single.unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of which nothing is left go."""
    n = len(docs.columns)
    found = substrings.deduplicate(docs)
    found = found.toDF(*[f"c{i}" for i in range(n)], "n_cut", "cut", "first_in")  # any name may be taken
    text = F.col(f"c{docs.columns.index('text')}")
    left = found.where((F.col("n_cut") == 0) | text.isNull() | (F.trim(text) != ""))
    return with_length(left.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    return with_length(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    found = packing.pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json")
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary(spark):  # what the stage needed goes when its result is written, and so does the stage before
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


#: The classifier and the signatures cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None
