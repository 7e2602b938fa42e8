import random

import numpy as np

from glyphguard.llm import op2_decontamination as op
from glyphguard.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def plain_align(a, b):
    """Smith-Waterman by the book."""
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (1 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 14))], np.uint64) for _ in range(2))
        score, first, last = op.span(a, b)
        assert score == plain_align(a.tolist(), b.tolist())
        assert plain_align(a.tolist(), b[first:last].tolist()) == score


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def test_exact_edited_and_clean(spark):
    rng = random.Random(9)
    item = words(rng, 40)
    edited = [f"zz{i}" if i % 8 == 3 else w for i, w in enumerate(item) if i % 13]
    rows = [
        (1, " ".join(words(rng, 300) + item + words(rng, 300))),
        (2, " ".join(words(rng, 50)) + "\n" + ", ".join(edited).upper()),
        (3, " ".join(words(rng, 500) + item[:8])),
        (4, " ".join(words(rng, 200))),
        (5, " ".join(item)),
        (5, " ".join(item)),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(words(rng, 30))), (12, None), (13, ""), (14, "q1 q2")], ITEMS)
    found = sorted((r.doc_id, r.item_id, round(r.score, 2), r.start_word, r.end_word) for r in op.find_leaks(docs, bench).collect())
    assert [x[:2] for x in found] == [(1, 10), (2, 10), (5, 10), (5, 10)]
    assert found[0][2:] == (1.0, 300, 340) and 0.5 <= found[1][2] < 1 and found[2][2] == 1.0


def test_a_leak_in_most_documents_keeps_its_seeds(spark):
    rng = random.Random(2)
    item = words(rng, 25)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 60) + (item if i % 3 else []))) for i in range(60)], DOCS)
    found = {r.doc_id for r in op.find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], ITEMS)).collect()}
    assert found == {i for i in range(60) if i % 3}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    whole = sorted(map(str, QUERIES["op2_decontamination"](spark, SMALL).collect()))
    monkeypatch.setattr(op, "BLOCK_BYTES", 1500)
    assert sorted(map(str, QUERIES["op2_decontamination"](spark, SMALL).collect())) == whole and whole


def test_query_finds_every_whole_item(spark):
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op2_decontamination"](spark, SMALL).collect()}
    assert want <= set(got) and all(got[k] == 1.0 for k in want)
    assert {d for d, _ in got} - {d for d, _ in want} == set()


def test_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, "one two"), (2, "several words")], ITEMS)
    assert sorted((r.doc_id, r.item_id) for r in op.find_leaks(edge_docs, bench).collect()) == [(5, 1), (6, 1), (6, 1)]
    assert op.find_leaks(edge_docs.limit(0), bench).count() == op.find_leaks(edge_docs, bench.limit(0)).count() == 0


def test_edited_copies_are_those_of_exhaustive_alignment(spark):
    rng = random.Random(5)
    items = {size: words(rng, size) for size in (3, 5, 20, 40, 60)}
    rows, want = [], set()
    for item_id, item in items.items():
        copies = [["zz" if i % k == k - 1 else w for i, w in enumerate(item)] for k in (4, 5, 6)]  # one word of k replaced
        copies += [[x for i, w in enumerate(item) for x in ([w, "yy"] if i % k == k - 1 else [w])] for k in (2, 3)]  # a word put in after k
        copies += [[w for i, w in enumerate(item) if i % 5 != 4], item, item[: len(item) // 3]]
        copies += [[rng.choice("vwxyz") if rng.random() < 0.25 else w for w in item] for _ in range(12)]
        for copy in copies:
            rows.append((len(rows), " ".join(words(rng, 150) + copy + words(rng, 150))))
    # Words of items out of their order, and whole copies that make other n-grams common.
    rows += [(len(rows) + i, " ".join(rng.sample(items[20], 20) + items[60])) for i in range(20)]
    for doc_id, text in rows:
        for item_id, item in items.items():
            number = {w: i for i, w in enumerate(set(item))}
            score, _, _ = op.align(np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in text.split()]))
            if 2 * score >= len(item):
                want.add((doc_id, item_id, score / len(item)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], ITEMS)
    assert {(r.doc_id, r.item_id, r.score) for r in op.find_leaks(spark.createDataFrame(rows, DOCS), bench).collect()} == want and len(want) > 90


def test_no_n_gram_runs_from_one_text_into_the_next(spark):
    docs = spark.createDataFrame([(1, "a b q1"), (2, "q2 c d")], DOCS).coalesce(1)
    assert op.find_leaks(docs, spark.createDataFrame([(14, "q1 q2")], ITEMS)).count() == 0
