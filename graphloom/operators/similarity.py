"""Candidates for resolution: the most similar names of the same article."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import dot, norm
from graphloom.tables import small

PART_NAMES = 2_000  # names of one article that a task compares with all of its names


def candidates(vectors: DataFrame, threshold: float, top_k: int) -> DataFrame:
    """``(doc_id, target, candidate, score, rank)`` from ``(doc_id, name, ord, vec)``.

    An article is a block: names of different articles are never compared. One of more than ``PART_NAMES``
    names is shared out: each part of them meets a copy of all, so that it is no burden to one task. A candidate has at least
    the threshold (inclusive); ties go to the earlier name. Norms are computed once a row, each pair
    once and then mirrored. Null and all-zero vectors have no candidates.
    """
    rows = vectors.filter("vec is not null and doc_id is not null").select("doc_id", "name", "ord", "vec", norm(F.col("vec")).alias("norm")).filter("norm > 0")
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > PART_NAMES)
    rows = rows.join(small(sizes.select("doc_id", F.ceil(F.col("n") / PART_NAMES).cast("int").alias("parts"))), "doc_id", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = rows.withColumn("part", F.pmod(F.xxhash64("ord"), "parts").cast("int")).alias("a")
    b = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    score = dot(F.col("a.vec"), F.col("b.vec")) / (F.col("a.norm") * F.col("b.norm"))
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.ord") < F.col("b.ord")))
    pairs = pairs.select("a.doc_id", F.struct("a.name", "a.ord").alias("x"), F.struct("b.name", "b.ord").alias("y"), score.alias("score")).filter(F.col("score") >= threshold)
    both = pairs.select("doc_id", F.explode(F.array(F.struct(F.col("x").alias("t"), F.col("y").alias("c")), F.struct(F.col("y").alias("t"), F.col("x").alias("c")))).alias("p"), "score")
    both = both.select("doc_id", F.col("p.t.name").alias("target"), F.col("p.t.ord").alias("target_ord"), F.col("p.c.name").alias("candidate"), F.col("p.c.ord").alias("candidate_ord"), "score")
    order = Window.partitionBy("doc_id", "target_ord").orderBy(F.desc("score"), "candidate_ord")
    ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("doc_id", "target", "candidate", "score", "rank")
