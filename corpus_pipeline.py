"""From documents to token ids: quality, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.names import spare
from depweave.llm import bpe, mixing, neardup, quality
from depweave.llm.bloom import only_keys, without_keys
from depweave.llm.store import save


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; the others go.

    Null and empty texts get the mean label of the voters; repeated rows are judged alike; other columns, whatever
    their names, come through unchanged; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if not {c.lower() for c in docs.columns} & {"held_out", "score", "predicted"}:
        return quality.score(docs, labels, columns=docs.columns).where("predicted = 1").select(docs.columns)
    body = F.struct(*(docs[c] for c in docs.columns)).alias("body")
    found = quality.score(docs.select("doc_id", "text", body), labels, columns=["body"]).where("predicted = 1")
    return found.select(*(F.col("body")[c].alias(c) for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, null ones last, ties to the
    smaller 64-bit hash of doc_id and text.

    Shingles of five words, similarity 0.8 or more. A row is known by that hash, whatever ids repeat or lack; of rows
    that are equal in both doc_id and text one stays. Null and empty texts are linked with nothing and stay. Other
    columns, whatever their names, come through unchanged; an empty table stays empty."""
    key, own, n, body = spare(docs.columns, "key", "own", "n", "body")
    docs = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    found = neardup.near_duplicates(docs.select(F.col(key).alias("doc_id"), docs["text"].cast("string").alias("text")), neardup.MinHash(shingle=5))
    # Narrow rows from here on: a group may hold a third of all documents, and is folded before it is shuffled.
    group = save(found.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias(own)), "dedup-groups")
    ids = docs.groupBy(key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias(n))
    ids = save(ids.join(group, key), "dedup-ids")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key]
    stay = save(ids.groupBy(own).agg(first.alias(key)), "dedup-stay").select(key)
    gone = save(ids.select(key, n).join(stay, key, "left_anti"), "dedup-gone")
    kept = without_keys(docs, key, gone.select(key))
    # Rows that repeat a kept one: of each such key the first by all columns stays.
    again = save(ids.where(F.col(n) > 1).join(stay, key, "left_semi").select(key), "dedup-again")
    if again.isEmpty():
        return kept.drop(key)
    repeated = only_keys(docs, key, again)
    rank = F.xxhash64(*(f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))
    one = repeated.groupBy(key).agg(F.min_by(F.struct(*(docs.columns)), rank).alias(body))
    return without_keys(kept, key, again).unionByName(one.select(*(F.col(body)[c].alias(c) for c in docs.columns))).drop(key)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sources' targets take, as often as they take them.

    Null sources are a source; documents without words come once; repeated rows are documents of their own; other
    columns, whatever their names, come through unchanged; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of each document, with digests of the ids and of the text decoded from them.

    A null text is an empty one without ids; repeated rows are encoded each; an empty table stays empty."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
