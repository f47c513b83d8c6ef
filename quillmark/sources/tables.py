"""Driver tables and the corpus built from them.

``documents ⋈ labels`` is the labelled corpus: quality 1 -> ``human``, 0 -> ``GPT``;
``lang`` is the domain.  Joins are left to the optimizer: the labels side is broadcast
only when AQE measures it under the broadcast threshold at run time, otherwise it is a
sort-merge join on ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_from_quality(c="quality"):
    q = F.col(c) if isinstance(c, str) else c
    return F.when(q == 1, F.lit("human")).when(q == 0, F.lit("GPT"))


def corpus(spark: SparkSession, sf_dir: str, labelled_only: bool = True) -> DataFrame:
    """``(doc_id, text, domain, source)``; ``source`` is null for unlabelled documents
    when ``labelled_only`` is False."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("domain"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    how = "inner" if labelled_only else "left"
    return (docs.join(labels, "doc_id", how)
            .select("doc_id", "text", "domain", source_from_quality().alias("source")))
