import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from glyphguard.llm import op11_circulant_minhash as minhash
from glyphguard.llm import op12_shallot_kmeans as shallot
from glyphguard.llm import op13_hard_negatives as gnat
from glyphguard.llm.registry import QUERIES, SQL
from glyphguard.llm.whole_vectors import LIMIT, floors, inner, packed, squares, unpacked
from tests.test_oracles import duck, rows_of  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_circulant_minhash", "op12_shallot_kmeans", "op13_hard_negatives"])
def test_whole_query_as_sql(spark, duck, name):  # noqa: F811
    assert rows_of(QUERIES[name](spark, SMALL).toPandas()) == rows_of(duck.execute(SQL[name]).df())


# Near-duplicates


def sets_of(rows, n=3):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").encode().lower().decode())
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def classes(rows):
    """(doc_id, set size, component, kept) of every row, from all pairs of rows."""
    sets, root = sets_of(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and None not in (rows[i][0], rows[j][0]) and 100 * common >= 85 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i))), least.get(find(i)) == d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_edits_on_both_sides_of_the_threshold(spark):
    rng = random.Random(3)
    rows = []
    for doc_id in range(120):
        w = [f"w{doc_id % 4}x{i}" for i in range(80)]
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((doc_id + 1, " ".join(w[: rng.choice([70, 76, 80])])))
    rows += [(200, "A b c"), (201, "a B\tc"), (202, "a b"), (203, "A\nb"), (204, "a b c d"), (205, "a")]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == classes(rows)


def test_one_id_with_two_texts_stays_two_rows(spark):
    a, b = ([" ".join(f"{c}{i}" for i in range(k)) for k in (60, 60, 61)] for c in "ab")
    rows = [(3, a[0]), (6, a[1]), (6, b[0]), (9, b[1]), (20, b[2])]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == classes(rows)


def test_minhash_edges(spark, edge_docs, edge_rows):
    out = minhash.near_duplicates(edge_docs)
    assert found(out) == sorted((d, n, c, kept or d == "None") for d, n, c, kept in classes([r[:2] for r in edge_rows]))
    assert minhash.near_duplicates(edge_docs.limit(0)).count() == 0


def test_a_star_of_edits_counts_its_links(spark):
    """A hundred edits of one text: all join its class over it."""
    base = [f"t{i}" for i in range(200)]
    rows = [(1, " ".join(base))] + [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(2, 102)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in out} == {1} and sum(r.kept for r in out) == 1 and max(r.n_links for r in out) >= 50


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(5)
    agreed = []
    for _ in range(40):
        both = rng.integers(0, 1 << 63, 1000, np.uint64)
        a, b = minhash.signature(both[:900]), minhash.signature(both[100:])
        agreed.append((a == b).mean())
    assert abs(np.mean(agreed) - 0.8) < 0.02
    tokens = rng.integers(0, 1 << 63, 3 * minhash.WINDOW, np.uint64)
    parts = [minhash.signature(tokens[k :: 3]) for k in range(3)]
    assert (minhash.signature(tokens) == np.minimum.reduce(parts)).all()


# Clusters


def lloyd(rows, k=16, rounds=3):
    """vec_id, cluster, distance by plain assignment, and the centroids."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:k]]
    for at in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if at < rounds:
            for j in range(len(centroids)):
                if mine := [v for (_, v), (_, o) in zip(kept, own) if o == j]:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((i, o, d) for (i, _), (d, o) in zip(kept, own)), centroids


@pytest.mark.parametrize("spread", [0.05, 0.6, 3e5])
def test_shallot_equals_plain_assignment(spark, spread):
    """Tight and loose clusters, small numbers full of ties, and numbers beyond exact float products."""
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(0, 1 if spread < 10 else spread, (20, 64))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(0, spread, 64)]) for i in range(300)]
    rows += [(500 + i, [float(i % 2)] * 64) for i in range(40)]
    out, centroids, work = shallot.shallot_kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    plain, means = lloyd(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out.collect()) == plain and centroids.tolist() == means
    assert work[0] == 16 * len(rows) and all(w < 16 * len(rows) for w in work[1:])


def test_searches_agree_with_ties():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-2, 3, (400, 3)), rng.integers(-2, 3, (9, 3))
    first, second, da, db = shallot.full_search(x, c)
    start = [rng.permutation(9)[:2] for _ in x]
    a, b, ea, eb, _ = shallot.shallot_search(x, c, *np.array(start).T, *shallot.between(c))
    assert (a == first).all() and (b == second).all() and (ea == da).all() and (eb == db).all()


def test_cluster_edges(spark):
    good = [[float((i * j) % 5) for j in range(64)] for i in range(5)]
    rows = [(1, good[1]), (1, good[1]), (None, good[2]), (3, None), (4, []), (5, good[3][:63]), (6, [*good[3][:63], None]), (7, [*good[3][:63], float("nan")]), (8, [*good[3][:63], float("-inf")]), (9, [*good[3][:63], 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "'y' AS distance", "'z' AS v")
    out, centroids, _ = shallot.shallot_kmeans(df)
    assert sorted(str(r.vec_id) for r in out.collect()) == ["1", "1", "9", "None"] and len(centroids) == 4 and centroids.max() == LIMIT
    none, centroids, _ = shallot.shallot_kmeans(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance"] and not len(centroids)
    one, _, _ = shallot.shallot_kmeans(df.filter("vec_id = 1").limit(1))
    assert [(r.cluster, r.distance) for r in one.collect()] == [(0, 0)]


def test_whole_numbers():
    column = pa.array([[0.5, -0.5], [1.26], [], [1e300, -1e300]], pa.list_(pa.float64()))
    assert floors(column, 2, 4).tolist() == [[2, -2], [5, 0], [0, 0], [LIMIT, -LIMIT]]
    assert floors(column.slice(1, 2), 2, 4).tolist() == [[5, 0], [0, 0]]
    big = np.array([[LIMIT, -LIMIT], [3, 4]])
    assert inner(big, big).tolist() == [[2 * LIMIT**2, -LIMIT], [-LIMIT, 25]] and squares(big, big)[0, 1] == (LIMIT - 3) ** 2 + (LIMIT + 4) ** 2
    assert (unpacked(packed(big), 2) == big).all()


# Hard negatives


def mined(rows, every=100):
    kept = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v):
            kept[i] = min(kept.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in kept.values()), default=0)
    whole = {i: np.array([int(np.floor(256 * x)) for x in v] + [0] * (width - len(v)), object) for i, (_, v) in kept.items()}
    out = []
    for a in (i for i in kept if i % every == 0):
        ranked = sorted(((-int(whole[a] @ whole[i]), i) for i in kept if i != a))
        for ps, p in [(-s, i) for s, i in ranked if kept[i][0] == kept[a][0]][:5]:
            fit = [(-s, i) for s, i in ranked if kept[i][0] != kept[a][0] and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def clustered(n, seed, width=16, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, width))
    return [(i, [float(x) for x in centres[i % 12] + rng.normal(0, spread, width)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("ways, leaf_rows", [(4, 20), (16, 10_000)])
def test_hard_negatives_equal_all_scores(spark, ways, leaf_rows):
    rows = clustered(700, 2) + [(2000 + i, [0.5] * 16, i % 3) for i in range(60)]
    rows[300] = (300, [-x for x in rows[300][1]], rows[300][2])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = gnat.hard_negatives(df, ways=ways, leaf_rows=leaf_rows, sample=200)
    assert sorted(map(tuple, out.collect())) == mined(rows)


def test_leaves_are_split_and_chunked(spark, monkeypatch):
    monkeypatch.setattr(gnat, "BLOCK", 16)
    monkeypatch.setattr(gnat, "CHUNK", 2)
    rows = clustered(300, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, gnat.hard_negatives(df, every=20, leaf_rows=64, ways=4).collect())) == mined(rows, 20)


def test_plans_have_a_row_for_each_anchor(spark, monkeypatch):
    """Neither plans nor finds have a row for each leaf that an anchor opens (they had, with its vector)."""
    tables, cut = {}, gnat.cut

    def counted(df, name):
        out = cut(df, name)
        tables[name] = max(tables.get(name, 0), out.count())
        return out

    monkeypatch.setattr(gnat, "cut", counted)
    rows = clustered(400, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, gnat.hard_negatives(df, every=10, leaf_rows=8, ways=4).collect())) == mined(rows, 10)
    assert tables["seeds"] <= 40 and tables["wanted"] <= 40


def test_tiles_blocks_and_ties(spark, monkeypatch):
    """Blocks of anchors, tiles and sorts smaller than a run of equal vectors."""
    for name, n in (("ANCHORS", 3), ("CELLS", 20), ("WAITING", 7), ("OUT", 5), ("BLOCK", 8)):
        monkeypatch.setattr(gnat, name, n)
    rows = clustered(150, 5, width=3) + [(1000 - i, [0.5, 0.25, 1.0], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, gnat.hard_negatives(df, every=25, leaf_rows=32, ways=3).collect())) == mined(rows, 25)


def test_no_leaf_with_a_find_is_eliminated_and_most_others_are():
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v, _ in clustered(3000, 7)])
    nodes, leaves = gnat.build(x[::3], 8, 40)
    ranges: dict = {}
    own = gnat.place(nodes, x, ranges)
    for n in nodes:
        m = len(n.points)
        n.low, n.high, n.shortest, n.longest = np.zeros((m, m), np.int64), np.zeros((m, m), np.int64), np.full(m, gnat.FAR), np.zeros(m, np.int64)
    for (at, j), (low, high, shortest, longest) in ranges.items():
        n = nodes[at]
        n.low[:, j], n.high[:, j], n.shortest[j], n.longest[j] = low, high, shortest, longest
    a = x[:60]
    scores = inner(a, x)
    low = np.sort(scores, axis=1)[:, [-10]].astype(float)
    open_leaves = {(leaf, r) for leaf, rows, _ in gnat.reach(nodes, a, low, np.full_like(low, 1e18)) for r in rows.tolist()}
    needed = {(int(own[i]), r) for r in range(60) for i in np.flatnonzero(scores[r] >= low[r, 0])}
    assert needed <= open_leaves and len(open_leaves) < 0.5 * leaves * 60


def test_hard_negative_edges(spark):
    v = [1.0, 2.0]
    rows = [(100, v, 1), (100, v, 1), (1, v, 1), (2, [1.0], 2), (3, [0.5, 1.0], 2), (4, None, 2), (5, v, None), (None, v, 2), (6, [1.0, None], 2), (7, [float("nan"), 1.0], 2), (8, [], 2), (9, [0.5, 1.0], 3), (9, [0.5, 1.0], 3), (200, [-1.0, -2.0], 1), (300, [0.0, 0.0], 2), (400, [1e300, 0.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS leaf", "'y' AS anchor", "'z' AS score")
    fits = [r for r in rows if r[0] != 400]
    assert sorted(map(tuple, gnat.hard_negatives(df.filter("vec_id is null or vec_id <> 400")).collect())) == mined(fits)
    assert gnat.hard_negatives(df).count() >= 0
    assert gnat.hard_negatives(df.limit(0)).count() == 0
    assert gnat.hard_negatives(df.filter("vec_id = 1")).count() == 0
