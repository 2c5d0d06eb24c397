"""A mixture of sources with target shares of the tokens.

Tokens are summed per source, a repetition rate is derived for each, and every
document is emitted floor(rate) times plus once more with the probability of the
fraction, decided by a seeded hash of its id. The same seed gives the same mixture on
any cluster.
"""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import strip
from graphloom.tables import small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = VOCABULARY):
    """A function from a text column to its number of tokens; null and empty texts have none.

    The vocabulary is sent with the job, so that only the driver needs the path.
    """
    spark = SparkSession.getActiveSession()
    context = spark.sparkContext if spark else None
    sent = context.__dict__.setdefault("_graphloom_vocabularies", set()) if context else set()
    if context and path not in sent and os.path.exists(path):
        context.addFile(path)
        sent.add(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        shipped = SparkFiles.get(os.path.basename(path))
        enc = encoding(shipped if os.path.exists(shipped) else path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count


def source_key(source: Column) -> Column:
    return F.lower(strip(source))


def document_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, key, tokens)``; documents without a source do not count."""
    rows = documents.select("doc_id", source_key(F.col("source")).alias("key"), "text").filter("key is not null")
    return rows.select("doc_id", "key", token_counter(path)("text").alias("tokens"))


def rates(tokens: DataFrame, targets: DataFrame, fit: str = "size") -> DataFrame:
    """``(source, key, target_share, max_repeats, tokens, wanted, rate, short)`` of each target source.

    ``wanted`` are the tokens that a source should have in a mixture as large as all
    documents whose source is listed; ``short`` says that ``max_repeats`` uses of its
    documents are not enough for them. ``rate`` is how often its documents are used,
    ``max_repeats`` at most. With ``fit="size"`` the mixture is as large as the whole and
    short sources stay below their share; with ``fit="shares"`` it is as large as can be
    while every source that has documents keeps its share. A source without documents
    has rate 0 and is short unless it should have no share.
    """
    targets = targets.select("source", source_key(F.col("source")).alias("key"), "target_share", "max_repeats")
    sums = tokens.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    rows = targets.join(sums, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    limit = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    whole = rows.dropDuplicates(["key"]).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole"), F.min(limit).alias("limit"))
    size = F.col("whole") if fit == "size" else F.least(F.col("whole"), F.coalesce("limit", F.lit(0.0)))
    rows = rows.join(F.broadcast(whole.withColumn("size", size)))  # one row
    rows = rows.withColumn("wanted", F.col("target_share") * F.col("whole"))
    rate = F.least(F.col("target_share") * F.col("size") / F.col("tokens"), F.col("max_repeats").cast("double"))
    rows = rows.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0))
    return rows.withColumn("short", F.col("max_repeats") * F.col("tokens") < F.col("wanted")).drop("whole", "limit", "size")


def _copies(doc_id: Column, rate: Column, seed: int) -> Column:
    """floor(rate) copies and one more by a draw, which is the same wherever the document is met."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("int")).cast("int")


def mixture(tokens: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """``(doc_id, key, tokens, copies)`` with at least one copy.

    The fraction of a rate is a Bernoulli draw by hash. A rate of ``max_repeats`` has no
    fraction, so no document exceeds it.
    """
    rows = tokens.join(small(rated.select("key", "rate").dropDuplicates(["key"])), "key")
    return rows.select("doc_id", "key", "tokens", _copies(F.col("doc_id"), F.col("rate"), seed).alias("copies")).filter("copies > 0")


def emit(documents: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mixture with this seed, each as often as it is to be used.

    Texts are not sent anywhere: each document draws for itself. ``copy`` counts from 1 and
    replaces a column of that name.
    """
    rates_ = rated.select(F.col("key").alias("__key"), F.col("rate").alias("__rate")).dropDuplicates(["__key"])
    rows = documents.withColumn("__key", source_key(F.col("source"))).join(small(rates_), "__key")
    rows = rows.withColumn("__n", _copies(F.col("doc_id"), F.col("__rate"), seed)).filter("__n > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "__n")))
    return rows.drop("__key", "__rate", "__n")


def report(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """The share that each target source reached in a mixture."""
    got = mixed.groupBy("key").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    rows = rated.join(got, "key", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("mixed_tokens") / F.col("whole")).otherwise(0.0)
    return rows.join(F.broadcast(whole)).select("source", "target_share", "tokens", "rate", "mixed_tokens", share.alias("actual_share"), "short", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
