"""Corpus pipeline: language ID, SimHash near-dedup, decontamination, packing. Each stage reads what its predecessor
kept, from Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pointweave.llm import decontaminate, language, packing, simhash
from pointweave.llm.common import cut, table
from pointweave.operators.shared import shared_folder
from pointweave.llm.tokens import vocabulary


_KEY = "_dedup_key"


def language_stage(spark, docs, sf_dir):
    """Each document's `lang` becomes the predicted language; documents without one (no letters) go. Repeated rows,
    long texts and null ids stay; nothing goes for its label. If no row is labelled, texts with a letter stay as they
    are."""
    return language.with_language(docs, language.fit(docs))


def dedup_stage(spark, docs, sf_dir):
    """The document with the smallest id of each near-duplicate group stays, once. Null, empty and wordless texts are
    one group. A null id ranks behind all others: rows without an id stay if their group has no id, one of them."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1))
    keyed = docs.withColumn(_KEY, key)
    keep = cut(simhash.near_duplicates(keyed, _KEY).where(F.col(_KEY) == F.col("component_id")).groupBy(_KEY).count())
    out = keyed.join(keep.where("count = 1"), _KEY, "left_semi").select(docs.columns)
    if keep.where("count > 1").isEmpty():
        return out
    again = keyed.join(keep.where("count > 1"), _KEY, "left_semi")
    return out.unionByName(again.dropDuplicates([_KEY]).select(docs.columns))


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark (16 words, four fifths of them equal) go; null and empty texts,
    and all rows if the benchmark is empty, stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of all documents in sequences; null and empty texts are pieces of the end id alone."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language_id", language_stage), ("simhash_dedup", dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet in the folder that executors share and
    read again; a stage's folder goes when its successor is written. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    to, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{to}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = out
    return docs
