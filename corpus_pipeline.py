"""A training-data pipeline over ``documents``: each stage is one corpus operator.

quality   documents that the boosted classifier rejects go;
dedupe    of each group of near duplicates (Jaccard 0.8 on 5-word shingles) the one
          with the smallest id stays;
secrets   confirmed secrets in the texts are replaced by a mark, documents stay;
mix       documents are taken 0 to 2 times so that sources come near their target
          weights, in curriculum order; a document is taken whole;
pack      what is left is tokenised and packed into sequences of 4096 ids.

Each stage reads what its predecessor wrote. All but the last return the columns
of documents. Null texts count as empty; the empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderscope.llm import mixing, packing, quality, secrets, sigtree
from tenderscope.llm.common import scratch, settle, table, written
from tenderscope.llm.queries import fold, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identity():
    """Name of a row: its id and its text's checksum, so that rows which share an id are told apart."""
    return F.struct("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("m"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier gives at least even odds of label 1."""
    labels = table(spark, sf_dir, "labels").where(fold() != 1)
    model = quality.fit(quality.labelled_sample(docs, labels, "quality"))
    return quality.score(docs, model, out_col="_score").where("_score >= 0.5").select(*COLUMNS)


def dedupe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """One row of each component of near duplicates; rows without words all stay."""
    named = docs.select(*COLUMNS).withColumn("_id", identity())
    found = sigtree.near_duplicates(named, "_id", "text", n=5, percent=80).where("n_shingles > 0")
    per = found.groupBy("_id", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    gone = per.where(F.col("_id") != F.col("component_id")).select("_id")
    if 100 * gone.count() <= broadcast_bytes:  # an id, a checksum and what a hash table adds; beyond, a shuffled join
        gone = F.broadcast(gone)
    kept = named.join(gone, "_id", "left_anti")
    if not per.where((F.col("_id") == F.col("component_id")) & (F.col("copies") > 1)).isEmpty():
        # rows repeated with id and text: one of each with words stays
        blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
        kept = kept.where(~blank).dropDuplicates(["_id"]).unionByName(kept.where(blank))
    return kept.select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with confirmed secrets replaced; n_chars follows the text.

    Texts are scanned once: the forest is fitted on the written findings, and the
    confirmed ones are cut out by their places."""
    named = docs.select(*COLUMNS).withColumn("_name", identity())
    found = written(secrets.scan(named, secrets.dictionary(docs), "_name"))
    judged = secrets.judge(found, secrets.fit(found))
    cleaned = secrets.redact_found(docs.select(*COLUMNS), judged, identity())
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                              .otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every taken copy as a row, sorted by its training position.

    The plan is a table between the two moves of the texts (to their place in the
    source, to their place in the mixture), so that their shuffles are not held together."""
    plan = mixing.mixture_plan(docs.select(*COLUMNS), whole_documents=True).where(F.size("copies") > 0)
    plan = written(plan.select(*COLUMNS, "copies", "positions", F.lit(0).alias("taken")))
    settle(spark)
    return mixing.curriculum(plan).select(*COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("dedupe", dedupe_stage), ("secrets", secrets_stage), ("mix", mix_stage),
          ("pack", pack_stage)]

#: no stage but the mixture has an SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces after all stages have run over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
