"""The most similar vectors of every vector, by a permutation index.

A vector is represented by its nearest pivots in order. It is posted in the inverted
file of each of its first pivots; what shares a file, and is not far apart by some bytes of signs, is ranked by the
footrule distance of the two orders, and what is near enough by it is ranked again by the exact cosine. Only the
orders and the signs are posted; vectors are fetched for the pairs that are left.

``neighbours`` finds for every vector those above a cosine; where vectors crowd, so that a file
holds more than a short list of near ones, the vector asks instead every cell of a pivot
in which, by the triangle inequality, a close one can lie. ``search`` finds for stated queries
the most similar ones however far they are, by reading the files of more pivots.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.tables import materialise, small

PIVOTS_PER_ROOT, LISTED, POSTED = 2.0, 16, 6
CLOSE = 0.85
SIGNS = 192  # bits; of pairs just at the cosine asked for, about one in 10,000 differs in more of them than is let through
SHORT = 256  # a vector with more near ones than this in one file, or than the root of the table if that is less, asks all cells in reach
REGION = 16  # cells that are asked together
FILE_ROWS = 10_000  # of either side, that one task compares
SAMPLE = 1_000  # vectors from which it is read how near by footrule a vector at the cosine asked for is
ASKED_PIVOTS, ASKED_LISTED, ASKED_FILES, SHARE = 512, 64, 32, 0.04  # of ``search``
SHARD_ROWS, QUERY_ROWS = 20_000, 20_000


def usable(df: DataFrame, key: str = "vec_id", vector: str = "vec") -> DataFrame:
    """``(vec_id, vec)`` of vectors that have a direction: not null, not empty, finite numbers only, not all zero."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~odd & F.exists("vec", lambda x: x != 0))


def lengths(vectors: DataFrame) -> dict[int, int]:
    """How many vectors there are of each length; vectors of different length are collections of their own."""
    return {r["length"]: r["count"] for r in vectors.groupBy(F.size("vec").alias("length")).count().orderBy("length").collect()}


def _matrix(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, wanted: int, sample: int = SAMPLE, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """About ``wanted`` distinct vectors as pivots and ``sample`` others, drawn by hash.

    The pivots follow the density, so that crowded regions have as many more of them and files stay
    of like length. It is all that the index is fitted on.
    """
    drawn = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(wanted + sample).select("vec").toPandas()
    rows = _matrix(drawn["vec"]).astype(np.float32)
    cut = max(1, min(wanted, len(rows) - sample)) if len(rows) > sample else max(1, len(rows) // 2)
    return np.unique(rows[:cut].round(6), axis=0), rows[cut:] if len(rows) > cut else rows


def _nearest(near: np.ndarray, listed: int) -> np.ndarray:
    """The ordered nearest pivots of each row of cosines."""
    best = np.argpartition(-near, listed - 1, axis=1)[:, :listed] if listed < near.shape[1] else np.argsort(-near, axis=1)
    order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def orders(rows: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    step = max(1, 4_000_000 // len(pivots))
    parts = [_nearest(rows[i : i + step].astype(np.float32) @ pivots.T, listed) for i in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.empty((0, listed), np.int64)


def _signs(rows: np.ndarray) -> np.ndarray:
    """On which side of some random planes each row lies, as bits."""
    planes = np.random.default_rng(11).normal(size=(rows.shape[1], SIGNS)).astype(np.float32)
    return np.packbits(rows.astype(np.float32) @ planes > 0, axis=1)


def most_signs(least: float, bits: int = SIGNS) -> int:
    """How many of some signs of two vectors with that cosine differ at most."""
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def alike(asking: np.ndarray, held: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose signs differ as little as at that cosine; two words in three are enough to leave most pairs out."""
    first, most = most_signs(least, 128), most_signs(least)
    out_q, out_x = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(asking), 64):  # blocks that stay in the processor's cache
        part = asking[i : i + 64]
        differ = np.bitwise_count(part[:, :1] ^ held[:, 0])
        differ += np.bitwise_count(part[:, 1:2] ^ held[:, 1])
        at = np.flatnonzero(differ.ravel() <= first)
        q, x = at // len(held), at % len(held)
        keep = np.bitwise_count(part[q] ^ held[x]).sum(1) <= most
        out_q.append(q[keep] + i)
        out_x.append(x[keep])
    return np.concatenate(out_q), np.concatenate(out_x)


def nearness(a: np.ndarray, b: np.ndarray, pivots: int) -> np.ndarray:
    """What two ordered lists have in common, row by row: ``listed * (listed + 1)`` less twice this is their footrule distance.

    A pivot that is not listed counts as one place after the last.
    """
    listed, total = a.shape[1], np.zeros(len(a), dtype=np.int32)
    for i in range(0, len(a), step := max(1, 4_000_000 // pivots)):
        left = np.zeros((len(a[i : i + step]), pivots), dtype=np.int16)
        np.put_along_axis(left, a[i : i + step], np.broadcast_to(np.arange(listed, 0, -1, dtype=np.int16), left[:, :listed].shape), 1)
        total[i : i + step] = np.minimum(np.take_along_axis(left, b[i : i + step], 1), np.arange(listed, 0, -1, dtype=np.int16)).sum(1)
    return total


def least_nearness(sample: np.ndarray, pivots: np.ndarray, listed: int, least: float) -> int:
    """What vectors at that cosine have in common by footrule, all but one pair in 100; closer ones have more."""
    rng = np.random.default_rng(12)
    off = rng.normal(size=sample.shape)
    off -= np.einsum("id,id->i", off, sample)[:, None] * sample
    norm = np.linalg.norm(off, axis=1, keepdims=True)
    other = least * sample + math.sqrt(1 - least**2) * off / np.where(norm > 0, norm, 1)
    a, b = orders(sample, pivots, listed), orders(other, pivots, listed)
    return int(np.quantile(nearness(a, b, len(pivots)), 0.01))


def permutations(vectors: DataFrame, pivots: np.ndarray, listed: int, posted: int) -> DataFrame:
    """``(vec_id, digest, posted, code)``: a digest of the direction, the first pivots, and the bytes of the whole order and the signs."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)
    kind = _code_type(len(pivots))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                rows = _matrix(part["vec"])
                digests = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows.round(5) + 0.0]
                lists = orders(rows, sent.value, listed)
                codes = np.hstack([lists.astype(kind).view(np.uint8).reshape(len(lists), -1), _signs(rows)])
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "digest": digests, "posted": list(lists[:, :posted].astype(np.int32)), "code": [c.tobytes() for c in codes]})

    return vectors.mapInPandas(assign, "vec_id long, digest binary, posted array<int>, code binary")


def _code_type(pivots: int) -> str:
    return "<u2" if pivots < 1 << 16 else "<u4"


def rank(ids: np.ndarray, units: np.ndarray, asking: np.ndarray, asking_units: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, neighbour, cosine)``: the ``k`` best of each asking row among all rows with another id and at least that cosine."""
    n, out = len(ids), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, 4_000_000 // max(n, 1))
    for i in range(0, len(asking) if n else 0, step):
        names, rows = asking[i : i + step], asking_units[i : i + step]
        near = rows @ units.T
        near[names[:, None] == ids] = -2
        c = min(k, n)
        # whatever may be among the best before rounding
        floor = np.maximum(np.partition(near, n - c, axis=1)[:, n - c] - 1e-5, least - 1e-5)
        q, x = np.nonzero(near >= floor[:, None])
        out.append(_best(names, ids, q, x, _exact(rows, units, q, x), k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _exact(rows: np.ndarray, units: np.ndarray, q: np.ndarray, x: np.ndarray, many: int = 200_000) -> np.ndarray:
    parts = [np.einsum("id,id->i", rows[q[p : p + many]].astype(np.float64), units[x[p : p + many]].astype(np.float64)) for p in range(0, len(q), many)]
    return np.concatenate([np.empty(0), *parts])


def _best(names: np.ndarray, ids: np.ndarray, q: np.ndarray, x: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids[x], -score, q))
    q = q[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return names[q[kept]], ids[x[order[kept]]], score[order[kept]]


def _units(file: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(file["unit"]), dtype=np.float32).reshape(len(file), -1)


def in_parts(rows: DataFrame, file: str, file_rows: int | None = None) -> DataFrame:
    """Adds ``cell`` to rows with ``asks`` and ``held``: within a cell of a file, all that ask meet all that are held.

    A file with more than ``file_rows`` of either is cut both ways into a grid, so that no task holds more of
    either side; a row comes to the cells of its line or of its column, and asks or is held only there.
    """
    most = file_rows or FILE_ROWS
    sizes = rows.groupBy(file).agg(F.count_if("asks").alias("a"), F.count_if("held").alias("h")).filter((F.col("a") > most) | (F.col("h") > most))
    part = lambda c: F.greatest(F.ceil(F.col(c) / most).cast("int"), F.lit(1)).alias(c)
    rows = rows.join(small(sizes.select(file, part("a"), part("h")), 1_000_000), file, "left").withColumns({"a": F.coalesce("a", F.lit(1)), "h": F.coalesce("h", F.lit(1))})
    rows = rows.withColumns({"u": F.pmod(F.xxhash64("vec_id"), "a").cast("int"), "w": F.pmod(F.xxhash64("vec_id"), "h").cast("int")})
    none = F.array().cast("array<int>")
    line = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda j: F.col("u") * F.col("h") + j)).otherwise(none)
    column = F.when(F.col("held"), F.transform(F.sequence(F.lit(0), F.col("a") - 1), lambda i: i * F.col("h") + F.col("w"))).otherwise(none)
    rows = rows.withColumn("cell", F.explode(F.array_union(line, column)))
    own = {"asks": F.col("asks") & (F.floor(F.col("cell") / F.col("h")) == F.col("u")), "held": F.col("held") & (F.col("cell") % F.col("h") == F.col("w"))}
    return rows.withColumns(own).drop("a", "h", "u", "w")


def _shortlists(entries: DataFrame, listed: int, pivots: int, common: int, least: float, short: int) -> DataFrame:
    """``(a, b, crowded)``: pairs that share a file and are near by footrule, and crowded entries, with more than a short list in a file, as a pair of their own."""
    posts = entries.select("vec_id", "code", F.explode("posted").alias("pivot"), F.lit(True).alias("asks"), F.lit(True).alias("held"))
    kind = _code_type(pivots)
    width = np.dtype(kind).itemsize * listed

    def search(file: pd.DataFrame) -> pd.DataFrame:
        ids, codes = file["vec_id"].to_numpy(), np.frombuffer(b"".join(file["code"]), dtype=np.uint8).reshape(len(file), -1)
        lists = codes[:, :width].copy().view(kind).astype(np.int64)
        sides = np.ascontiguousarray(codes[:, width:]).view(np.uint64)
        asks, held = np.flatnonzero(file["asks"].to_numpy()), np.flatnonzero(file["held"].to_numpy())
        out_a, out_b, crowded = [], [], []
        local = np.unique(lists, return_inverse=True)[1].reshape(lists.shape)
        step = max(1, 1_000_000 // max(1, len(held)))
        for i in range(0, len(asks) if len(held) else 0, step):
            own = asks[i : i + step]
            q, x = alike(sides[own], sides[held], least)
            near = nearness(local[own[q]], local[held[x]], int(local.max()) + 1)
            keep = (near >= common) & (ids[own[q]] != ids[held[x]])
            q, x, near = q[keep], x[keep], near[keep]
            many = np.bincount(q, minlength=len(own)) > short
            if many.any():
                crowded.append(ids[own[many]])
                a, b, _ = _best(ids[own], ids[held], q, x, near.astype(np.float64), short)
            else:
                a, b = ids[own[q]], ids[held[x]]
            out_a.append(np.minimum(a, b))
            out_b.append(np.maximum(a, b))
        none = np.empty(0, np.int64)
        pairs = pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b]), "crowded": False}).drop_duplicates()
        more = np.concatenate([none, *crowded])
        return pd.concat([pairs, pd.DataFrame({"a": more, "b": more, "crowded": True})])

    return in_parts(posts, "pivot").groupBy("pivot", "cell").applyInPandas(search, "a long, b long, crowded boolean")


def _cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(a, b, cosine)``; an id with several vectors stands with each of them."""

    def angle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            cosine = np.einsum("id,id->i", x, y) / np.sqrt(np.einsum("id,id->i", x, x) * np.einsum("id,id->i", y, y)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cosine)], names=["a", "b", "cosine"])

    rows = pairs.join(vectors.select(F.col("vec_id").alias("a"), F.col("vec").alias("x")), "a")
    rows = rows.join(vectors.select(F.col("vec_id").alias("b"), F.col("vec").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(angle, "a long, b long, cosine double")


def regions(pivots: np.ndarray) -> np.ndarray:
    """The region of each pivot: the nearest of every ``REGION``-th pivot."""
    leaders = pivots[::REGION]
    return np.concatenate([np.argmax(pivots[i : i + 2000] @ leaders.T, axis=1) for i in range(0, len(pivots), 2000)])


def _crowded(crowd: DataFrame, entries: DataFrame, pivots: np.ndarray, k: int, least: float) -> DataFrame:
    """``(a, b, cosine)``: the ``k`` best of each entry of ``crowd`` in every region it has to ask, and the same from the other side.

    A close vector that is close to its own nearest pivot lives in the cell of a pivot at twice that
    angle at most. Who is close to no pivot lives in no region and is found by asking only.
    """
    sent = entries.sparkSession.sparkContext.broadcast((pivots, regions(pivots)))

    def live(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, region = sent.value
        for batch in batches:
            step = max(1, 4_000_000 // len(pivots))
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                rows = _matrix(part["vec"]).astype(np.float32)
                near = rows @ pivots.T
                first = near.argmax(1)
                home = np.where(near[np.arange(len(near)), first] >= least - 1e-5, region[first], -1)
                within = near >= 2 * least**2 - 1 - 1e-5
                reach = [np.unique(region[np.flatnonzero(w)]) if asks else [] for w, asks in zip(within, part["asks"])]
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "unit": [r.tobytes() for r in rows], "home": home, "reach": reach})

    rows = entries.join(crowd.withColumn("asks", F.lit(True)), "vec_id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    placed = materialise(rows.select("vec_id", "vec", "asks").mapInPandas(live, "vec_id long, unit binary, home int, reach array<int>"), "crowd")
    asking = placed.select("vec_id", "unit", (F.col("home") < 0).alias("lone"), F.explode("reach").alias("region"), F.lit(True).alias("asks"), F.lit(False).alias("held"))
    living = placed.filter("home >= 0").select("vec_id", "unit", F.lit(False).alias("lone"), F.col("home").alias("region"), F.lit(False).alias("asks"), F.lit(True).alias("held"))

    def search(file: pd.DataFrame) -> pd.DataFrame:
        ids, units, asks, held, lone = file["vec_id"].to_numpy(), _units(file), file["asks"].to_numpy(), file["held"].to_numpy(), file["lone"].to_numpy()
        both = [rank(ids[held], units[held], ids[asks], units[asks], k, least), rank(ids[lone], units[lone], ids[held], units[held], k, least)]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("a", "b", "cosine"), zip(*both, strict=True), strict=True)})

    return in_parts(asking.unionByName(living), "region").groupBy("region", "cell").applyInPandas(search, "a long, b long, cosine double")


FOUND = "vec_id long, neighbour long, cosine double, rank int"


def _each_length(vectors: DataFrame, find: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """Vectors of one length are a collection; the results of all lengths."""
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for length, n in lengths(vectors).items():
        found = found.unionByName(find(vectors.filter(F.size("vec") == length), n, length))
    return found


def neighbours(df: DataFrame, k: int = 5, least: float = CLOSE, key: str = "vec_id", vector: str = "vec", short: int = SHORT) -> DataFrame:
    """``(vec_id, neighbour, cosine, rank)``: of every usable vector the ``k`` most similar others with a cosine of at least ``least``.

    Ties in the cosine go to the smaller id. Vectors of equal direction are one entry of
    the index and are expanded afterwards, so that any number of copies costs as
    much as one. Vectors of different lengths are compared with their like only. A table with fewer than two
    usable vectors gives no rows. A repeated row counts once; an id with several vectors is as similar to another as its best one.
    """
    return _each_length(usable(df, key, vector), lambda vectors, n, _: _close_ones(vectors, n, k, least, short))


def _close_ones(vectors: DataFrame, n: int, k: int, least: float, short: int) -> DataFrame:
    pivots, sample = choose_pivots(vectors, max(8, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n))))
    listed = min(LISTED, len(pivots))
    common = least_nearness(sample, pivots, listed, least)
    entries = materialise(permutations(vectors, pivots, listed, POSTED), "permutations")
    # of each direction: the entry with the smallest id, and the k + 1 smallest ids of its copies
    order = Window.partitionBy("digest").orderBy("vec_id")
    first = entries.select("vec_id", "digest").withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1)
    ids = first.groupBy("digest").agg(F.min("vec_id").alias("entry"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    ids = materialise(ids, "directions")
    copied = ids.filter(F.size("ids") > 1)

    spare = entries.select("vec_id", "digest").join(copied.select("digest", "entry"), "digest").filter("vec_id <> entry").select("vec_id", "digest")
    kept = entries.join(spare, ["vec_id", "digest"], "left_anti")
    # in a crowd of any size a file holds about three times the root of the table of near ones
    short = min(short, max(64, math.ceil(math.sqrt(n))))
    found = materialise(_shortlists(kept, listed, len(pivots), common, least, short), "shortlists")
    near = _cosines(found.filter("not crowded").select("a", "b").distinct(), vectors)
    crowd = found.filter("crowded").select(F.col("a").alias("vec_id")).distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    near = near.filter(F.col("cosine") >= least - 1e-9).select(both, "cosine").select("p.a", "p.b", "cosine")
    if not crowd.isEmpty():
        copies = spare.select("vec_id").join(kept.select("vec_id"), "vec_id", "left_anti")
        near = near.unionByName(_crowded(crowd, vectors.join(copies, "vec_id", "left_anti"), pivots, k, least))
    # the entry itself stands for its copies, at cosine 1
    near = near.unionByName(copied.select(F.col("entry").alias("a"), F.col("entry").alias("b"), F.lit(1.0).alias("cosine")))
    near = near.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    other = ids.select(F.col("entry").alias("b"), "ids")
    best = near.join(other, "b").select("a", F.explode("ids").alias("id"), (-F.col("cosine")).alias("far"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("far", "id"))).filter(F.col("n") <= k + 1)
    best = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("best"))
    members = entries.select("vec_id", "digest").distinct().join(ids.select("digest", "entry"), "digest")
    rows = members.join(best, members["entry"] == best["a"])
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)
    rows = rows.select("vec_id", F.posexplode(own).alias("at", "x"))
    return rows.select("vec_id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def close_pairs(near: DataFrame, least: float) -> DataFrame:
    """``(vec_a, vec_b)``, each pair once, where one is among the most similar of the other with at least ``least``."""
    rows = near.filter(F.col("cosine") >= least)
    return rows.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()


class Files:
    """The pivot inverted files of a part of the collection: of each pivot the rows that list it, with its place in each."""

    def __init__(self, lists: np.ndarray, pivots: int):
        n, listed = lists.shape
        order = np.argsort(lists, axis=None, kind="stable")
        self.n, self.listed = n, listed
        self.start = np.searchsorted(lists.ravel()[order], np.arange(pivots + 1))
        self.row, self.place = order // listed, (order % listed).astype(np.int32)

    def nearness(self, asking: np.ndarray) -> np.ndarray:
        """What the row has in common with each asking order (see the function), read from the files of its pivots."""
        rows, gains = [], []
        for j, pivot in enumerate(asking):
            part = slice(self.start[pivot], self.start[pivot + 1])
            rows.append(self.row[part])
            gains.append(self.listed - np.maximum(self.place[part], j))
        return np.bincount(np.concatenate(rows), np.concatenate(gains), self.n)


def search(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vec", pivots: int = ASKED_PIVOTS, listed: int = ASKED_LISTED, files: int = ASKED_FILES, share: float = SHARE) -> DataFrame:
    """``(vec_id, neighbour, cosine, rank)`` of a stated set of query vectors against all vectors, however far the most similar are.

    Every task keeps the inverted files of its own rows. A query reads the files of its first ``files`` pivots,
    which add up to a footrule distance for each row that is in any; the rows nearer than all but about ``share`` of a
    bounded sample are ranked again by their cosine. As that distance comes from the sample, the result does not depend
    on how rows lie in tasks and batches. Queries are sent in blocks of ``QUERY_ROWS``. Null and odd vectors take no part on
    either side; ties go to the smaller id; an id that has several vectors is answered once, with the best of them.
    """
    asked = usable(queries, key, vector)
    return _each_length(usable(df, key, vector), lambda vectors, n, length: _asked(vectors, asked.filter(F.size("vec") == length), n, k, pivots, listed, files, share))


def _asked(vectors: DataFrame, asked: DataFrame, n: int, k: int, wanted: int, listed: int, files: int, share: float) -> DataFrame:
    spark, out = vectors.sparkSession, "a long, b long, cosine double"
    pivots, sample = choose_pivots(vectors, max(1, min(wanted, n // 8)), 4 * SAMPLE)
    listed = min(listed, len(pivots))
    sample_files = Files(orders(sample, pivots, listed), len(pivots))
    total, found = asked.count(), spark.createDataFrame([], out)
    slices = math.ceil(total / QUERY_ROWS)
    for i in range(slices):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(slices)) == i).toPandas()
        if not len(rows):
            continue
        units = _matrix(rows["vec"])
        lists = orders(units, pivots, listed)[:, :files]
        # the place in the sample's order that the share takes; a row that is in no file is never ranked
        at = max(0, sample_files.n - max(math.ceil(share * sample_files.n), min(sample_files.n, 4 * k)))
        least = np.array([np.partition(sample_files.nearness(q), at)[at] for q in lists])
        sent = spark.sparkContext.broadcast((rows["vec_id"].to_numpy(), units, lists, least, pivots))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            names, asking, places, least, pivots = sent.value
            for ids, own in _shards(batches):
                own_files, parts = Files(orders(own, pivots, listed), len(pivots)), []
                for q in range(len(names)):
                    near = own_files.nearness(places[q])
                    x = np.flatnonzero((near >= max(least[q], 1)) & (ids != names[q]))
                    parts.append(_best(names, ids, np.full(len(x), q), x, (own[x] @ asking[q]).round(9), k))
                yield pd.DataFrame(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*parts)))))

        found = found.unionByName(vectors.mapInPandas(scan, out))
    found = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), "cosine", "rank")


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and directions of up to ``SHARD_ROWS`` rows, or a batch if that is more."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if kept and sum(map(len, kept)) + len(batch) > SHARD_ROWS:
            yield _shard(kept)
            kept = []
        kept.append(batch)
    if kept and sum(map(len, kept)):
        yield _shard(kept)


def _shard(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    rows = pd.concat(parts)
    return rows["vec_id"].to_numpy(), _matrix(rows["vec"])
