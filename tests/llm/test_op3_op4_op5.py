import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from glyphguard.llm import op3_token_counts as op3
from glyphguard.llm import op4_media as op4
from glyphguard.llm import op5_packing as op5
from glyphguard.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# Token counts


def test_trie_counts_are_plain_forward_counts(monkeypatch):
    rng = random.Random(4)
    pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -rng.randint(1, 6) for _ in range(40)}
    trie = op3.UnigramTrie(pieces, -9.0)
    long = "".join(rng.choice("abcdé中") for _ in range(3000))
    ends = [long[:n] for n in (200, 900, 900, 3000)] + [long[:500] + "b" + long[500:700]]
    assert trie.count_texts([" ".join(ends)])[0][1] == sum(op3.best_count("▁" + w, pieces, -9.0) for w in ends)
    words = ["".join(rng.choice("abcdé中😀\0") for _ in range(rng.choice([1, 3, 6, 10, 60]))) for _ in range(600)]
    texts = [" ".join(words[i : i + 7]) for i in range(0, 600, 7)] + ["", " \n "]
    want = [(len(t.split()), sum(op3.best_count("▁" + w, pieces, -9.0) for w in t.split())) for t in texts]
    assert trie.count_texts(texts) == want
    monkeypatch.setattr(op3, "MAX_WORDS", 20)
    assert trie.count_texts(texts) == want and [trie.count_texts([t])[0] for t in texts] == want


def test_token_count_query(spark):
    scores, byte_score = op3.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op3_token_counts"](spark, SMALL).collect()}
    texts = documents(spark)
    assert set(rows) == set(texts)
    for d in sorted(texts)[:12]:
        words = texts[d].split()
        assert rows[d] == (len(words), sum(op3.best_count("▁" + w, scores, byte_score) for w in words))


def test_token_count_edges(spark, edge_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = op3.count_tokens(edge_docs, path)
    assert out.columns.count("n_tokens") == 1 and out.count() == edge_docs.count() and op3.count_tokens(edge_docs.limit(0), path).count() == 0
    got = {r.doc_id: r.n_tokens for r in out.collect()}
    assert got[1] == got[2] == got[3] == 0 and got[5] == got[6] > 0
    assert {r.source: r.n_docs for r in op3.tokens_by_source(edge_docs, path).collect()}["b"] == 2


# Media


def grey(h, w, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w), np.uint8)


def bmp24(image):
    h, w, _ = image.shape
    stride = (w * 3 + 3) // 4 * 4
    body = b"".join((row[:, ::-1].tobytes()).ljust(stride, b"\0") for row in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_decoders():
    g, colour = grey(5, 7), np.random.default_rng(2).integers(0, 256, (4, 3, 3), np.uint8)
    assert (op4.decode(b"P5 # note\n7 5\n255\n" + g.tobytes()) == g).all()
    assert (op4.decode(b"P2\n7 5 255\n" + b" ".join(b"%d" % x for x in g.ravel())) == g).all()
    assert (op4.decode(b"P6\n3 4\n255\n" + colour.tobytes()) == colour).all()
    assert (op4.decode(bmp24(colour)) == colour).all()
    bits = (g > 128).astype(np.uint8)
    assert (op4.decode(b"P4\n7 5\n" + np.packbits(bits, axis=1).tobytes()) == bits).all()
    assert (op4.decode(b"P1\n7 5\n" + b"".join(b"%d" % x for x in bits.ravel())) == bits).all()
    wide = (g.astype(np.uint16) * 200).astype(">u2")
    assert (op4.decode(b"P5\n7 5\n65535\n" + wide.tobytes()) == wide).all()
    for bad in (b"", b"P5\n7 5\n255\n12", b"GIF89a", b"BM", b"P5\n7"):
        with pytest.raises((ValueError, struct.error, IndexError)):
            op4.decode(bad)


def test_bad_images_are_reported_not_raised(spark):
    rng = random.Random(8)
    bad = [b"P5 99999999999 99999999999 255\n1", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 2 1 9 1", b"P4 9999999999 9999999999\n", b"P1 99999999999 9 1", b"P5 " + b"9" * 5000]
    bad += [kind + b"\n0 1000000000000\n255\n" for kind in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6")] + [b"P1 0 5000000000", b"P6 3000000000 0 255\n"]
    worst = len(bad)
    whole = [b"P5\n7 5\n255\n" + grey(5, 7).tobytes(), bmp24(np.zeros((4, 3, 3), np.uint8))]
    bad += [rng.randbytes(rng.randint(1, 80)) for _ in range(100)] + [b"P%d " % rng.randint(1, 6) + rng.randbytes(40) for _ in range(100)]
    for _ in range(300):
        x = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(min(len(x), 60))] = rng.randrange(256)
        bad.append(bytes(x[: rng.randint(1, len(x))]))
    found = [r.media for r in op4.media_tiles(spark.createDataFrame([(x,) for x in bad], "image binary"), "image").collect()]
    assert len(found) == len(bad) and all(m.error and m.tile is None for m in found[:worst]) and all(bool(m.error) != bool(m.tile) for m in found)


def test_same_picture_same_hash_and_masked_bmp():
    bits = np.random.default_rng(5).integers(0, 2, (16, 18), np.uint8)
    as_bitmap = op4.decode(b"P1 18 16\n" + b" ".join(b"%d" % x for x in bits.ravel()))
    as_grey = op4.decode(b"P2 18 16 1\n" + b" ".join(b"%d" % (1 - x) for x in bits.ravel()))
    assert op4.difference_hash(op4.to_grey(as_bitmap)) == op4.difference_hash(op4.to_grey(as_grey)) != "0" * 16
    image = np.random.default_rng(6).integers(0, 256, (2, 3, 3), np.uint8)
    words = (image[..., 0].astype("<u4") << 24 | image[..., 1].astype("<u4") << 16 | image[..., 2].astype("<u4") << 8)[::-1]
    head = struct.pack("<IHHI", 66 + 24, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 32, 3, 24, 0, 0, 0, 0) + struct.pack("<III", 0xFF000000, 0xFF0000, 0xFF00)
    assert (op4.decode(b"BM" + head + words.tobytes()) == image).all()


def test_area_resize_is_the_mean_under_each_pixel(monkeypatch):
    monkeypatch.setattr(op4, "STRIP_ROWS", 3)
    for h, w, th, tw in ((12, 18, 4, 6), (7, 5, 3, 4), (1, 1, 2, 2), (3, 9, 8, 9)):
        g = grey(h, w)
        fine = np.repeat(np.repeat(g, th, 0), tw, 1).astype(float)
        want = fine.reshape(th, h, tw, w).mean((1, 3))
        assert np.allclose(op4.area_resize(g, th, tw), want)


def test_media_query_stores_every_byte(spark):
    texts = documents(spark)
    rows, kinds = QUERIES["op4_media"](spark, SMALL).collect(), set()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        whole = np.frombuffer(payload, np.uint8).reshape(-1, 576)
        kinds.add(len(whole) % 3)
        image = whole.reshape(-1, 192, 3) if len(whole) % 3 == 1 else whole
        tile = op4.to_npy(image)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(tile), hashlib.sha256(tile).hexdigest())
        g = image.astype(float) @ [0.299, 0.587, 0.114] if image.ndim == 3 else image.astype(float)
        if len(g) < 200:
            cells = np.round(np.repeat(np.repeat(g, 8, 0), 9, 1).reshape(8, len(g), 9, -1).mean((1, 3)), 6)
            clear = np.abs(np.diff(cells)) > 1e-5
            assert (np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).reshape(8, 8) == (np.diff(cells) > 0))[clear].all()
    assert kinds == {0, 1, 2}


def test_media_edges(spark, edge_docs):
    from pyspark.sql import functions as F

    rows = edge_docs.select("doc_id", op4.payload_of(F.col("text")).alias("p")).collect()
    sizes = {r.doc_id: len(r.p) for r in rows}
    assert sizes[1] == sizes[2] == 576 and all(n % 576 == 0 for n in sizes.values())
    exact = spark.createDataFrame([("x" * 576,)], "text string").select(op4.payload_of(F.col("text")).alias("p")).first().p
    assert bytes(exact) == b"x" * 576
    odd = spark.createDataFrame([(None, "z"), (bytearray(b"junk"), "z"), (bytearray(b"P5\n0 0\n255\n"), "z")], "image binary, media string")
    found = [r.media for r in op4.media_tiles(odd, "image").collect()]
    assert found[0] is None and found[1].error and found[1].tile is None and found[2].dhash is None and found[2].tile is not None
    assert op4.media_tiles(odd.limit(0), "image").count() == 0


# Packing


def test_binary_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        lengths = op5.binary_lengths(n, 4096)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
        assert all(x & (x - 1) == 0 for x in lengths) and len(set(lengths) - {4096}) == len([x for x in lengths if x < 4096])


def test_word_encoder_is_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, mine = Tokenizer.from_file(path), op5.WordEncoder(path)
    rng = random.Random(5)
    alphabet = [*"aBÉéß×÷ª  \x1c\x85\t\r\n'sS1９Å가😀‍.,!ÿŸİ", "<|endoftext|>", "'ll", "don't", "e\u0301", " ", "\n", *"«»¡¿‘’“”–—…•"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["中文字 " * 50 + "plain words\nund größere 中", "\n \n", "ends odd é中"]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    def coded(texts):
        ids, sizes = mine.encode(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    assert coded(texts) == want
    monkeypatch.setattr(op5, "CACHE_WORDS", 5)
    assert [coded([t])[0] for t in texts[:300]] == want[:300]


def check_packing(pieces, want):
    by_doc, seen = {}, set()
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 and r.sequence_id not in seen
        seen.add(r.sequence_id)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        raw = np.array(ids, "<u4")
        parts = sorted(by_doc[d], key=lambda r: r.start)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist() and sum(r.length for r in parts) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(raw[r.start : r.start + r.length].tobytes()) for r in parts)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: plain.encode(t, add_special_tokens=False).ids + [2] for d, t in documents(spark).items()}
    check_packing(QUERIES["op5_packing"](spark, SMALL).collect(), want)


def test_packing_edges(spark, edge_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = op5.pack(edge_docs, path)
    got = [(r.doc_id, r.length, r.doc_tokens) for r in pieces.collect()]
    assert got.count((1, 1, 1)) == got.count((2, 1, 1)) == 1 and len([x for x in got if x[0] == 6]) == 4
    assert sum(n for d, n, _ in got if d == 4) == 36001 and op5.pack(edge_docs.limit(0), path).count() == 0
    op5.write_buckets(pieces, f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").count() == len(got)
    with pytest.raises(ValueError):
        op5.pack(edge_docs, path, longest=3000)
    assert math.log2(max(n for _, n, _ in got)) == 12
