import numpy as np
import pytest

from graphloom.llm import neighbours as nb

SCHEMA = "vec_id long, vec array<float>, rank int, cosine string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)


def clustered(n=1500, size=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, size))
    return (centres[rng.integers(len(centres), size=n)] + 0.15 * rng.normal(size=(n, size))) * rng.uniform(0.5, 3, size=(n, 1))


def exact(vectors, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -2)
    return np.argsort(-near, axis=1, kind="stable")[:, :k], near


def test_recall_and_cosines(spark):
    vectors = clustered()
    best, near = exact(vectors, 5)
    rows = nb.neighbours(frame(spark, enumerate(vectors))).collect()
    assert all(abs(r["cosine"] - near[r["vec_id"], r["neighbour"]]) < 1e-5 for r in rows)
    got = {(r["vec_id"], r["neighbour"]) for r in rows}
    close = {(i, int(j)) for i in range(len(best)) for j in best[i] if near[i, j] >= 0.85}
    assert len(close & got) >= 0.99 * len(close) and got <= close
    ranks = sorted(r["rank"] for r in rows if r["vec_id"] == 0)
    assert ranks == list(range(1, len(ranks) + 1))


def test_recall_in_a_crowd(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 64))
    vectors[::3] = rng.normal(size=64) + 0.3 * rng.normal(size=(1000, 64))  # a third, each pair at about 0.92
    best, near = exact(vectors, 5)
    got = {tuple(r) for r in nb.close_pairs(nb.neighbours(frame(spark, enumerate(vectors))), 0.85).collect()}
    close = {(min(i, int(j)), max(i, int(j))) for i in range(len(best)) for j in best[i] if near[i, j] >= 0.85}
    assert len(close) > 2500 and got == close


def test_search_recall(spark, monkeypatch):
    vectors = np.random.default_rng(2).normal(size=(3000, 32))
    best, _ = exact(vectors, 5)
    df = frame(spark, enumerate(vectors))
    asked = df.filter("vec_id % 50 = 0")
    rows = nb.search(df, asked).collect()
    hits = sum(r["neighbour"] in best[r["vec_id"]] for r in rows)
    assert len(rows) == 300 and hits >= 0.9 * 300
    # neither the blocks of queries nor the shards change anything
    monkeypatch.setattr(nb, "QUERY_ROWS", 25)
    monkeypatch.setattr(nb, "SHARD_ROWS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    assert sorted(nb.search(df.repartition(7), asked).collect()) == sorted(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_recall_of_every_vector(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/name_vectors.parquet")
    table = {r["vec_id"]: np.array(r["vec"], dtype=float) for r in nb.usable(rows).collect()}
    ids = sorted(table)
    best, _ = exact(np.stack([table[i] for i in ids]), 5)
    want = {(i, ids[j]) for i, b in zip(ids, best) for j in b}
    got = {(r["vec_id"], r["neighbour"]) for r in nb.search(rows, rows).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_far_pairs_are_not_let_through_by_signs():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(20000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=a.shape)
    off -= np.einsum("id,id->i", off, a)[:, None] * a
    b = 0.85 * a + np.sqrt(1 - 0.85**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    differ = np.bitwise_count(nb._signs(a) ^ nb._signs(b)).sum(1)
    assert (differ > nb.most_signs(0.85)).mean() < 1e-3


def test_copies_cost_no_more_and_are_all_answered(spark):
    vectors = clustered(300)
    rows = [*enumerate(vectors), *((1000 + i, vectors[7] * (1 + i % 3)) for i in range(400)), (5, vectors[5])]
    got = {}
    for r in nb.neighbours(frame(spark, rows)).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert all(len(got[i]) == 5 for i in [7, *range(1000, 1400)])
    assert [n for _, n, _ in sorted(got[1399])] == [7, 1000, 1001, 1002, 1003]
    assert [n for _, n, _ in sorted(got[7])] == [1000, 1001, 1002, 1003, 1004]


def test_long_files_are_shared_out(spark, monkeypatch):
    vectors = clustered(600)
    whole = {tuple(r)[:2] for r in nb.neighbours(frame(spark, enumerate(vectors))).collect()}
    monkeypatch.setattr(nb, "FILE_ROWS", 20)
    assert {tuple(r)[:2] for r in nb.neighbours(frame(spark, enumerate(vectors))).collect()} == whole


@pytest.mark.parametrize("rows", [[], [(1, [1, 2])], [(1, None), (2, [0, 0]), (None, [1, 1])], [(1, []), (2, [float("nan"), 1])]])
def test_nothing_to_compare(spark, rows):
    assert nb.neighbours(frame(spark, rows)).count() == 0
    assert nb.search(frame(spark, rows), frame(spark, rows)).count() == 0


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1, 0]), (2, [1, 0.1]), (3, [1, 0, 0]), (4, None), (5, [0, 0]), (6, [float("inf"), 1])]
    assert sorted(tuple(r)[:2] for r in nb.neighbours(frame(spark, rows)).collect()) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in nb.close_pairs(nb.neighbours(frame(spark, rows)), 0.85).collect()] == [(1, 2)]
    longer = [*rows, (7, [1, 0, 0.1]), (8, [0, 1, 0])]  # each length for itself
    assert sorted(tuple(r)[:2] for r in nb.neighbours(frame(spark, longer)).collect()) == [(1, 2), (2, 1), (3, 7), (7, 3)]
    assert sorted(tuple(r)[:2] for r in nb.search(frame(spark, longer), frame(spark, longer[-2:]), 1).collect()) == [(7, 3), (8, 3)]


def test_footrule_by_definition():
    rng = np.random.default_rng(3)
    lists = np.array([rng.permutation(12)[:5] for _ in range(40)])
    place = [{p: r for r, p in enumerate(x)} for x in lists]
    files = nb.Files(lists, 12)
    for i in range(7):
        full = [sum(abs(place[i].get(p, 5) - x.get(p, 5)) for p in range(12)) for x in place]
        got = nb.nearness(np.repeat(lists[i : i + 1], 40, 0), lists, 12)
        assert [5 * 6 - 2 * int(g) for g in got] == full
        assert files.nearness(lists[i]).tolist() == got.tolist()


def test_alike_by_definition():
    sides = np.ascontiguousarray(nb._signs(clustered(300))).view(np.uint64)
    q, x = nb.alike(sides[:100], sides, 0.85)
    differ = np.bitwise_count(sides[:100, None] ^ sides[None]).sum(2)
    want = set(zip(*np.nonzero(differ <= nb.most_signs(0.85))))
    assert set(zip(q, x)) <= want and len(q) >= 0.99 * len(want)
