"""Exact round trips and library equality of the encoders, the media column, packing, Huffman files and top-k."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plainfit.llm import flac, huffman, packing, piece_bpe, queries, tokens, topk

ODD = ["", " ", "  a", "a  b ", "▁x", "héllo wörld 日本語 \x00\x01", "\n\n  foo \n bar", "🎉 emoji", "a\tb", "<|endoftext|> x", "foo<|endoftext|>bar  baz", "it's we'll  ΣΑΣ İstanbul", "<s> </s> <0x41>", "x" * 3000, "    deep   indent", "é á", "   ", "\n", "a \n b", "﻿bom", "ﬁ ½ ²", "ab\x1cc d\x85e", "anea.\nThe and, of!", None]


def docs(spark, texts):
    rows = [(i, t, "en", f"x{i}", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_tokens long")


def sf(spark, tmp_path, texts):
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(("kind", "name"), [(tokens.ByteBpe, "byte_bpe_50k.json"), (tokens.WordBpe, "word_bpe_49k.json")])
def test_ids_equal_the_library(kind, name):
    raw = open(public_tokenizers.path(name), "rb").read()
    mine, theirs = kind(raw, limit=5), Tokenizer.from_str(raw.decode())
    for text in ODD[:-1]:
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_equal_the_library(spark, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in piece_bpe.decode_pieces(piece_bpe.encode_pieces(docs(spark, ODD), path), path).collect()}
    for i, text in enumerate(ODD):
        ids = theirs.encode(text or "")
        assert list(got[i].ids) == ids
        assert got[i].decoded == theirs.decode(ids)
    digests = {r.doc_id: r for r in queries.op6_pieces(spark, sf(spark, tmp_path, ODD)).collect()}
    for i, text in enumerate(ODD):
        ids = theirs.encode(text or "")
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()


def test_flac_round_trip(spark, tmp_path):
    texts = [*ODD, "ab" * 4000, "\x00" * 3000, "".join(chr(97 + i * i % 26) for i in range(5000))]
    rows = {r.doc_id: r for r in queries.op2_flac(spark, sf(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        payload = flac.padded(text)
        assert rows[i].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].tail_crc32) == (len((text or "").encode()), len(payload), zlib.crc32(payload[-64:]))


def test_flac_lanes_equal_frame_by_frame_and_errors_show(spark):
    rng = np.random.default_rng(5)
    smooth = (np.cumsum(rng.integers(-3, 4, 5000)).clip(-100, 100) + 128).astype(np.uint8).tobytes()
    waves = (128 + 90 * np.sin(np.arange(4000) / 9)).astype(np.uint8).tobytes()
    for payload in (smooth, waves, rng.bytes(3000), b"a" * 64, bytes([0, 255] * 2000), b"ab" * 40 + b"\xff" * 30 + b"\0"):
        (stream,) = flac.encode([payload])
        channels, depth, total, _, at = flac.stream_info(stream)
        slow = []
        while at < len(stream):
            x, at = flac.decode_frame(stream, at, depth)
            slow.append(x[0])
        ((blocks, error),) = flac.decode([stream])
        assert error == "" and (channels, depth, total) == (1, 8, len(payload))
        assert np.concatenate([x[0] for _, x in blocks]).tolist() == np.concatenate(slow).tolist() == (np.frombuffer(payload, np.uint8).astype(int) - 128).tolist()
        assert [f for f, _ in blocks] == list(range(0, len(payload), flac.BLOCK))
    bad = bytearray(flac.encode([smooth])[0])
    bad[-9] ^= 16
    frame = spark.createDataFrame([(1, bytes(bad)), (2, None), (3, b"no"), (4, flac.encode([waves])[0])], "id long, media binary")
    got = flac.decode_flac(frame).collect()
    assert {r.id: r.error for r in got}.keys() == {1, 2, 3, 4}
    assert next(r.error for r in got if r.id == 1) == "frame checksum"
    assert [r.error for r in got if r.id in (2, 3)] == ["empty", "not FLAC"]
    assert sum(r.n_samples for r in got if r.id == 4) == 4000


def test_flac_escape_codes_and_stereo():
    """A hand-made stereo (left/side) stream with an escaped partition goes through the frame-by-frame decoder."""
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n - 1, -1, -1))
    left, right = list(range(10, 26)), [x - 3 for x in range(10, 26)]
    head = bytes([0xFF, 0xF8, 0x64, 0x82, 0x00, 15])
    put(0x08 << 1, 8), put(0, 2), put(0, 4), put(15, 4), put(7, 5)
    [put(x & 127, 7) for x in left]
    put(0, 8), put(3, 9)  # the side channel is constant and has a bit more
    bits += [0] * (-len(bits) % 8)
    frame = head + bytes([flac.crc_bytes(head, 8)]) + np.packbits(np.array(bits, np.uint8)).tobytes()
    frame += flac.crc_bytes(frame, 16).to_bytes(2)
    info = (16).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 1 << 41 | 7 << 36 | 16).to_bytes(8) + bytes(16)
    ((blocks, error),) = flac.decode([b"fLaC\x80\x00\x00\x22" + info + frame])
    assert error == "" and blocks[0][1].tolist() == [left, right]


def test_packing_places_every_token_once(spark, tmp_path):
    texts = [*ODD, *("word " * n for n in (1, 7, 300, 1023, 1024, 2500, 2500))]
    rows = queries.op8_packing(spark, sf(spark, tmp_path, texts)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(by_doc[i]) == -(-len(ids) // 1024)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def fewest(sizes, capacity):
    """Exact number of bins for a few sizes by search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_bin():
    rng = np.random.default_rng(1)
    for _ in range(300):
        capacity = int(rng.integers(5, 25))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 10))).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = packing.dominance(counts, capacity)
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        assert sum(m for _, m in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity), (capacity, sizes, fixed)
        assert sorted([s for p, m in fixed for s in p * m] + rest) == sorted(sizes)
        assert all(sum(p) <= capacity for p, _ in packing.best_fit(counts, capacity))


def test_huffman_files_round_trip(spark, tmp_path):
    texts = [*ODD, "the " * 9000, *ODD]
    got = {r.doc_id: r for r in queries.op10_huffman(spark, sf(spark, tmp_path, texts)).collect()}
    library, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_huffman_code_is_limited_complete_and_seekable():
    for limit in (4, 9, 16):
        counts = np.array([2**i for i in range(16)])
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) == 1
    plain = huffman.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 16)
    assert plain.tolist() == [4, 4, 3, 3, 3, 1]
    assert huffman.code_lengths(np.array([0, 3, 0])).tolist() == [0, 1, 0]
    code = huffman.Code(huffman.code_lengths(np.bincount(np.arange(3000) % 77)))
    ids = np.arange(3000) % 77
    block = code.encode(ids)
    a, b, c = code.decode([block, code.encode(ids[:0]), code.encode(ids[:257])])
    assert a.tolist() == ids.tolist() and not len(b) and c.tolist() == ids[:257].tolist()


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [1.0] * 3), (320, [2.0] * 3), (300, [0.5] * 8), (300, [0.5] * 8), (340, [1e200] * 8), (360, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    keep = topk.SHARD, topk.QUERIES
    topk.SHARD, topk.QUERIES = 32, 7
    try:
        got = topk.top_k(frame, 20, "vec_id", "embedding", lambda c: c % 20 == 0).collect()
    finally:
        topk.SHARD, topk.QUERIES = keep
    good = [(i, [max(-(2**62), min(2**62, int(np.floor(64 * x)) if abs(x) < 1e17 else 2**62)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:20])}
    assert {tuple(r) for r in got} == want
