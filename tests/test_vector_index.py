import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphguard.operators import search, vector_index


@pytest.fixture(scope="module")
def clustered(spark):
    """1200 vectors in 40 loose clusters, some zero or missing, and every fiftieth as a query."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1200)] + [(1201, [0.0] * 16), (1202, None)]
    refs = spark.createDataFrame(rows, "ref_id long, ref_vec array<double>")
    return refs.filter("ref_id % 50 = 0").toDF("query_id", "query_vec"), refs


def ranked(df):
    return sorted((r.query_id, r.rank, r.ref_id, round(r.cosine, 6)) for r in df.collect())


def test_exact_answer_scores_a_part_of_the_pairs(clustered):
    queries, refs = clustered
    index = vector_index.fit_cells(refs)
    rows, pairs = vector_index.search_cells(queries, index, 5, 2, exact=True)
    assert ranked(rows) == ranked(search.vector_topk(queries, refs.filter("ref_vec is not null"), 5))
    assert index.sizes.sum() == 1201 and pairs.agg(F.sum("pairs")).first()[0] < 0.5 * 24 * 1201


def test_recall_with_a_fifth_of_the_pairs(clustered):
    queries, refs = clustered
    index = vector_index.fit_cells(refs)
    probes, recall = vector_index.tuned_probes(index, queries, 5)
    rows, pairs = vector_index.search_cells(queries, index, 5, probes)
    true = {(r.query_id, r.ref_id) for r in search.vector_topk(queries, refs.filter("ref_vec is not null"), 5).collect()}
    found = {(r.query_id, r.ref_id) for r in rows.collect()}
    assert len(true & found) / len(true) == pytest.approx(recall) and recall >= 0.9
    assert pairs.agg(F.sum("pairs")).first()[0] <= 0.2 * 24 * 1201


def test_lists_in_blocks(clustered, monkeypatch):
    queries, refs = clustered
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    monkeypatch.setattr(vector_index, "CHUNK", 5)
    index = vector_index.fit_cells(refs, cells=3)
    assert ranked(vector_index.search_cells(queries, index, 5, 1, exact=True)[0]) == ranked(search.vector_topk(queries, refs.filter("ref_vec is not null"), 5))


@pytest.mark.parametrize("probes, block", [(1, 65_536), (3, 20), (40, 65_536)])
def test_pairs_are_counted_without_scores(clustered, monkeypatch, probes, block):
    """What an exact search scores beyond the probed cells is known from residuals: no second or third search."""
    queries, refs = clustered
    monkeypatch.setattr(vector_index, "BLOCK", block)
    index = vector_index.fit_cells(refs, cells=12)
    want = [vector_index.search_cells(queries, index, 5, probes, exact)[1].agg(F.sum("pairs")).first()[0] for exact in (False, True)]
    calls, scored = [], vector_index._scored
    monkeypatch.setattr(vector_index, "_scored", lambda *a: calls.append(a[4:]) or scored(*a))
    assert list(vector_index.pairs_of(queries, index, 5, probes)) == want and calls == [(False,), (True, False)]
    # Plain counts: pairs in the probed cells, and those of the others that the triangle inequality leaves.
    lists = [(r.ref_id, r.cell, r.residual) for r in index.lists.collect()]
    rows = vector_index.search_cells(queries, index, 5, probes)[0].filter("rank = 5").collect()
    within = {r.query_id: max(2 - 2 * r.cosine, 0) ** 0.5 for r in rows}
    probed = exact = 0
    for q in queries.collect():
        d = vector_index.distances(vector_index.units([q.query_vec]), index.centroids)[0]
        near = set(sorted((k for k in range(12) if index.sizes[k]), key=lambda k: d[k])[:probes])
        inside = [cell in near for i, cell, _ in lists if i != q.query_id]
        probed += sum(inside)
        exact += sum(inside) + sum(abs(x - d[cell]) <= within.get(q.query_id, 2.0) + 1e-6 for i, cell, x in lists if i != q.query_id and cell not in near)
    assert want == [probed, exact]


def test_ids_may_be_names(clustered):
    queries, refs = (x.withColumn(c, F.concat(F.lit("v"), F.col(c))) for x, c in zip(clustered, ("query_id", "ref_id")))
    refs = refs.limit(300)
    found = vector_index.search_cells(queries, vector_index.fit_cells(refs, cells=4), 3, 1, exact=True)[0]
    assert ranked(found) == ranked(search.vector_topk(queries, refs.filter("ref_vec is not null"), 3))


def test_small_and_empty_tables(clustered):
    queries, refs = clustered
    for n in (0, 1, 2):
        few = refs.filter("ref_id in (50, 51)").orderBy("ref_id").limit(n)
        rows, _ = vector_index.search_cells(queries, vector_index.fit_cells(few), 5, 3, exact=True)
        assert rows.count() == {0: 0, 1: 23, 2: 47}[n]
    none = queries.limit(0)
    assert vector_index.search_cells(none, vector_index.fit_cells(refs), 5, 3, exact=True)[0].count() == 0


def test_tiles_keep_ties_odd_vectors_and_small_ids(spark, monkeypatch):
    """Against plain expressions: many equal vectors, missing and non-finite ones, tiles smaller than a tie."""
    from glyphguard.functions.vectors import dot, l2_normalize
    from glyphguard.operators import vector_tiles

    monkeypatch.setattr(vector_tiles, "WAITING", 30)
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(size=3).tolist()) for i in range(299, -1, -1)] + [(300, None), (301, [float("nan"), 1.0, 0.0]), (302, [0.0] * 3)]
    refs = spark.createDataFrame(rows, "ref_id long, ref_vec array<double>").repartition(3)
    queries = refs.filter("ref_id % 25 = 0").toDF("query_id", "query_vec")
    both = queries.crossJoin(refs).filter("query_id <> ref_id").withColumn("cosine", F.round(dot(l2_normalize(F.col("query_vec")), l2_normalize(F.col("ref_vec"))), 9))
    plain = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "ref_id"))).filter("rank <= 7")
    assert sorted(str(tuple(r)) for r in plain.select("query_id", "ref_id", "rank").collect()) == sorted(str(tuple(r)) for r in search.vector_topk(queries, refs, 7).select("query_id", "ref_id", "rank").collect())


def test_search_shuffles_no_pairs(clustered):
    """Tasks give k rows a query: no join of vectors is left in the plans."""
    queries, refs = clustered
    refs = refs.filter("ref_vec is not null")
    for found in (search.vector_topk(queries, refs, 5), search.vector_topk_lsh(queries, refs, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "MapInPandas" in plan


def test_plans_and_searches_carry_no_vector_a_pair(clustered):
    """What leaves the tasks are k rows a query and its count, and a plan is bits: no vector per query and cell."""
    queries, refs = clustered
    index = vector_index.fit_cells(refs)
    asks = queries.withColumn("within", F.lit(2.0))
    plans = vector_index._planned(asks, index, 20).collect()
    assert len(plans) == 24 and all(len(p.opened) == -(-len(index.centroids) // 8) for p in plans)
    found = vector_index._scored(asks, index, 20, 5, True)
    assert found.columns == ["query_id", "ref_id", "cosine", "pairs"]
    assert found.count() <= 24 * 6 * index.lists.rdd.getNumPartitions()
