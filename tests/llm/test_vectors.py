import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import additive_ann, topk


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


@pytest.fixture(scope="module")
def odd(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=6).astype("f4").tolist(), 0) for i in range(300)]
    rows += [(i, [1.0, 2.0, 0.5, 0.0, 0.0, 1.0], 0) for i in range(300, 400)]  # copies
    rows += [(400, None, 0), (401, [], 0), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (403, [float("nan")] * 6, 0), (404, [float("inf")] + [0.0] * 5, 0)]
    rows += [(None, [1.0] * 6, 0), (500, [0.0] * 6, 0), (600, [1.0, 2.0], 0), (50, rows[50][1], 0)]
    return rows


def valid(rows, zero):
    return [(i, np.array(v, "f4").astype(float)) for i, v, _ in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and (zero or any(v))]


def test_top_k_is_exact(spark, odd):
    rows = [(i, np.floor(256 * v).astype(int)) for i, v in valid(odd + [(7, odd[7][1], 0), (7, odd[7][1], 0)], True)]
    want = []
    for q, v in dict(rows).items():
        if q % 50 == 0:
            near = sorted((-int(v @ w), i) for i, w in rows if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert sorted(map(tuple, topk.top_k(table(spark, odd + [(7, odd[7][1], 0), (7, odd[7][1], 0)])).collect())) == sorted(want)


def test_repeated_rows_take_ranks_of_their_own(spark):
    rows = table(spark, [(0, [1.0, 0.5], 0)] + [(3, [2.0, 1.0], 0)] * 3 + [(4, [1.0, 1.0], 0), (5, [-1.0, 1.0], 0)])
    assert [r.vec_id for r in sorted(topk.top_k(rows, k=4).collect(), key=lambda r: r["rank"])] == [3, 3, 3, 4]
    assert [r.vec_id for r in sorted(additive_ann.nearest(rows, k=4).collect(), key=lambda r: r["rank"])] == [4, 3, 3, 3]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_repeated_ids_hide_no_candidate(spark, k):
    """A query's id and others repeated far more than k times, with one vector and with several."""
    u, v, w = [1.0, 2.0, 0.5], [1.0, 1.5, 0.5], [-2.0, 1.0, 3.0]
    rows = [(0, u, 0)] * 20 + [(0, v, 0)] * 20 + [(50, v, 0)] * 3 + [(5, u, 0)] * 9 + [(9, u, 0)] * 2 + [(8, w, 0)] * 20 + [(100, w, 0)] * 20 + [(3, v, 0), (120, u, 0)]
    plain = [(i, np.array(x)) for i, x, _ in rows]
    single = {i: min((x for j, x, _ in rows if j == i)) for i, _, _ in rows}
    got: dict = {}
    for r in topk.top_k(table(spark, rows), k=k).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (0, 50, 100):
        want = sorted((-int(np.floor(256 * np.array(single[q])) @ np.floor(256 * x)), i) for i, x in plain if i != q)[:k]
        assert [got[q][n] for n in range(1, k + 1)] == [(i, -s) for s, i in want]
    near: dict = {}
    for r in additive_ann.nearest(table(spark, rows), k=k).collect():
        near.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in (0, 100):
        want = sorted((float(np.sqrt(((x - np.array(single[q])) ** 2).sum())), i) for i, x in plain if i != q)[:k]
        assert [near[q][n] for n in range(1, k + 1)] == [i for _, i in want]


def test_recall_on_the_given_table(spark):
    """Recall of 10 on the table's own vectors against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()]
    truth = {q: {i for _, i in near} for q, near in brute_nearest(x, 100, 10).items()}
    hits = sum(r.vec_id in truth[r.query_id] for r in additive_ann.nearest(rows).collect())
    assert hits / (10 * len(truth)) >= 0.95


def clustered(n, dims, centres, seed):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(centres, dims))[draw.integers(0, centres, n)] + 0.35 * draw.normal(size=(n, dims))).astype("f4")


def frame(spark, x, parts):
    flat = pa.array(x.reshape(-1), pa.float32())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), flat)
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": lists})).repartition(parts)


def test_bounds_hold_and_most_pairs_are_not_scored(spark):
    """On 30,000 clustered vectors the triangle inequality leaves less than half of the pairs, and nothing is lost."""
    x = clustered(30_000, 16, 10, 3)
    whole = np.floor(256 * x.astype(float))
    index = topk.PivotIndex(frame(spark, x, 4), copies=5)
    queries = topk.quantised(frame(spark, x, 4)).filter("vec_id % 50 = 0")
    got: dict = {}
    for r in index.search(queries, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    own = np.arange(0, 30_000, 50)
    products = whole[own] @ whole.T
    products[np.arange(len(own)), own] = -np.inf
    for q, row in zip(own.tolist(), products, strict=True):
        near = np.lexsort((np.arange(len(row)), -row))[:5]
        assert [got[q][k] for k in range(1, 6)] == [(int(i), int(row[i])) for i in near]
    share = index.scored.value / (len(own) * len(x))
    assert 0 < share < 0.5, share


def test_top_k_beyond_doubles(spark):
    rows = [(i, [float(2**22 + i), float(-(2**21) - i), 1.5], 0) for i in range(60)]
    quant = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows}
    got = topk.top_k(table(spark, rows)).collect()
    for q in (0, 50):
        want = sorted((-sum(a * b for a, b in zip(quant[q], w)), i) for i, w in quant.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in want]


def test_few_and_none(spark):
    few = table(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)])
    assert len(topk.top_k(few).collect()) == 2 and len(additive_ann.nearest(few).collect()) == 2
    assert topk.top_k(few.limit(0)).count() == 0 and additive_ann.nearest(few.limit(0)).count() == 0


def brute_nearest(rows, every, k):
    out = {}
    for q, v in dict(rows).items():
        if q % every == 0:
            out[q] = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)[:k]
    return out


def test_nearest_on_odd_rows(spark, odd):
    want = brute_nearest(valid(odd, False), 100, 10)
    got = additive_ann.nearest(table(spark, odd)).collect()
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [i for _, i in near]
        assert np.allclose([r.score for r in own], [s for s, _ in near], rtol=1e-12)
    assert {r.query_id for r in got} == set(want)


@pytest.mark.parametrize("shape", ["noise", "clusters"])
def test_recall_whatever_the_partitions(spark, shape):
    """20,000 vectors in 1, 8 and 211 partitions: recall of 10 against brute force, and one result for all layouts."""
    x = clustered(20_000, 64, 10, 5) if shape == "clusters" else np.random.default_rng(6).normal(size=(20_000, 64)).astype("f4")
    wide, queries = x.astype(float), np.arange(0, 20_000, 100)
    truth = {}
    for q in queries.tolist():
        away = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        away[q] = np.inf
        truth[q] = set(np.argsort(away)[:10].tolist())
    results = []
    for parts in (1, 8, 211):
        got: dict = {}
        for r in additive_ann.nearest(frame(spark, x, parts)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        results.append(got)
        assert sum(len(got[q] & truth[q]) for q in truth) / (10 * len(truth)) >= 0.95
    assert results[0] == results[1] == results[2]


def test_beam_search_improves_and_norms_are_those_of_the_sums():
    x = np.random.default_rng(2).normal(size=(500, 16))
    books = additive_ann.fit(x, 4, 32)
    errors = []
    for beam in (1, 8):
        codes, norm = books.encode(x, beam)
        sums = sum(books.words[m][codes[:, m]] for m in range(4))
        assert np.allclose((sums**2).sum(1), norm)
        errors.append(((x - sums) ** 2).sum())
    assert errors[1] < errors[0]


def hard(shape):
    """Rows whose near ones the codes can't tell apart: many tight groups, few of great length, many dimensions."""
    draw = np.random.default_rng(12)
    if shape == "tight":
        return (draw.normal(size=(12, 24))[draw.integers(0, 12, 6000)] + np.where(np.arange(6000) % 2, 1e-4, 1.0)[:, None] * draw.normal(size=(6000, 24))).astype("f4")
    if shape == "far":
        return (1000 + draw.normal(size=(6000, 24)) * np.exp(3 * draw.normal(size=(6000, 1)))).astype("f4")
    return draw.normal(size=(4000, 384)).astype("f4")


@pytest.mark.parametrize("shape", ["tight", "far", "wide"])
def test_the_nearest_are_exact_on_hard_rows(spark, shape):
    x = hard(shape)
    wide = x.astype(float)
    got: dict = {}
    for r in additive_ann.nearest(frame(spark, x, 5)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in range(0, len(x), 100):
        away = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        away[q] = np.inf
        near = np.lexsort((np.arange(len(x)), away))[:10]
        assert [got[q][k][0] for k in range(1, 11)] == near.tolist()
        assert np.allclose([got[q][k][1] for k in range(1, 11)], away[near], rtol=1e-12)


def test_most_rows_are_not_compared():
    """Of clustered vectors the codes' bounds leave less than a tenth for the exact comparison."""
    x = clustered(20_000, 64, 10, 5).astype(float)
    centre = x[:4000].mean(0)
    books = additive_ann.fit(x[:4000] - centre)
    scan = additive_ann.Scan(books, centre, np.arange(64), x[:64], 10, 200)
    for at in range(0, len(x), 2000):
        part = x[at : at + 2000]
        codes, norm, error = books.coded(part - centre, 4)
        scan.see(np.arange(at, at + 2000), codes.T, norm, error, part)
    assert scan.compared < 0.1 * 64 * len(x), scan.compared
