import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from glyphguard.llm import op1_jaccard_join as op
from glyphguard.llm.components import components
from glyphguard.llm.registry import QUERIES
from glyphguard.llm.shingles import shingle_sets

SMALL = "/root/testdata/sf0.001"


def sets_of(rows):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").encode().lower().decode())
        out[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(rows):
    """doc_id -> (set size, smallest reachable doc_id), from all pairs."""
    sets = sets_of(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert found(QUERIES["op1_jaccard_join"](spark, SMALL)) == brute(rows)


def test_near_copies_around_the_threshold(spark):
    """Edits of a few originals, without the originals: many pairs just over and under 0.8."""
    rng = random.Random(6)
    rows = []
    for doc_id in range(90):
        w = [f"w{doc_id % 3}x{i}" for i in range(60)]
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((doc_id + 1, " ".join(w[: rng.choice([48, 55, 60])])))
    rows += [(200, "A b c d e"), (201, "a B\tc d  e"), (202, "a b c"), (203, "a b c"), (204, "a b c d")]
    assert found(op.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_id_with_two_texts_stays_two_rows(spark):
    """Rows of one id are nodes of their own: texts that share nothing stay apart."""
    a, b = ([" ".join(f"{c}{i}" for i in range(k)) for k in (60, 60, 61)] for c in "ab")
    rows = [(3, a[0]), (6, a[2]), (6, b[0]), (9, b[1]), (20, b[2])]
    got = sorted((r.doc_id, r.component_id, r.n_equal) for r in op.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 1), (6, 3, 1), (6, 6, 2), (9, 6, 2), (20, 6, 1)]


def test_edges(spark, edge_docs):
    rows = op.jaccard_join(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 5), (None, 5, None)} <= got
    assert op.jaccard_join(edge_docs.limit(0)).count() == 0


def test_hashed_sets_are_the_sets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "é", "ccc", "\t", "\n d"]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    plain = sets_of(enumerate(texts))
    hashed = shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in hashed] == [len(plain[i]) for i in range(len(texts))]
    for a, b in combinations(range(0, len(texts), 3), 2):
        assert len(np.intersect1d(hashed[a], hashed[b])) == len(plain[a] & plain[b])


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(100, 130)] + [(5, i) for i in range(200, 240)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(30)]
    root = {x: x for pair in links for x in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in links)}
