"""Operators as stages: documents in, documents (or, at the end, pieces) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.llm.jaccard import jaccard_join
from lectern.llm.lines import dedupe_lines
from lectern.llm.mix import mix_sources
from lectern.llm.toxicity import score_toxicity

BROADCAST_ROWS = 500_000


def _rows(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Join ``docs`` with decisions on few of its rows, by (doc_id, text_hash). At most
    ``BROADCAST_ROWS`` of them (24 bytes each) go to the tasks; more meet the rows in a shuffle."""
    slim, _ = stored(_named(decisions), "stage-decisions")
    return docs.join(F.broadcast(slim) if slim.count() <= BROADCAST_ROWS else slim, _same(), how)


def _named(decisions: DataFrame) -> DataFrame:
    return decisions.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.4) -> DataFrame:
    """The rows whose toxicity score is below ``threshold``; the others go."""
    return score_toxicity(docs, labels, threshold=threshold).where("predicted = 0").select(*docs.columns)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """Rows with their repeated lines dropped and ``n_chars`` counted anew. A row of which only blank
    lines are left goes; rows that had no other lines before, and rows without text, stay."""
    cut = dedupe_lines(docs)
    kept = cut.where(F.col("text").isNull() | (F.col("kept_chars") > 0) | (F.col("chars") == 0))
    lost = F.col("exact") + F.col("near") > 0
    return kept.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_class(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class: the one of the least id. Rows that repeat an id and a
    text are one document; of rows of one id and class the least text hash stays. A class of null
    ids only keeps each of its texts once."""
    found, _ = stored(jaccard_join(docs, threshold=threshold, words=5).select("doc_id", "text_hash", "class_id", "class_sig"), "stage-classes")
    # An id may come with several texts, of one class or of several: of each class's least id, the least text hash stays.
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_sig", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = first.where("doc_id is not null and class_sig is not null").groupBy("class_sig").agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("_f"))
    alone = first.where("doc_id is null or class_sig is null").select("doc_id", "text_hash", "n")
    keep, _ = stored(least.select("_f.doc_id", "_f.text_hash", "_f.n").unionByName(alone), "stage-keep")
    gone = found.select("doc_id", "text_hash").distinct().join(
        keep.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_t")), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_t")), "left_anti"
    )
    repeated = keep.where("n > 1")
    stay = _rows(docs, gone.unionByName(repeated.select("doc_id", "text_hash")), "left_anti")
    once = _rows(docs, repeated.drop("n"), "left_semi").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return stay.unionByName(once)


def mixed(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """Rows as often as the mix takes them: none, one or two of each. Rows that agree in id and
    text share what is taken of them."""
    taken = mix_sources(docs, (5, 2, 1), share).groupBy("doc_id", "text_hash").agg(F.ceil(F.avg("copies")).cast("int").alias("copies")).where("copies > 0")
    # a decision for every row: a shuffled join at any size
    return docs.join(_named(taken), _same()).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
