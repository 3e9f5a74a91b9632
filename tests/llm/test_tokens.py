"""Piecewise encoding, bit packing and sequence packing against the tokenizer itself."""

import tempfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderleaf.llm import bitpack, packing
from cinderleaf.llm.tokens import PieceEncoder, public_path

KINDS = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ODD = [
    "", " ", "  ", "\n", " a  b\n c\t", "'s it's 's", "a\x01b \x01 c", "<|endoftext|> x", "!'s \x1c! x", " ,a ,'s",
    "́ e ́e", "日本 語!  ", "İ Σας ς", "a \n\n b", "trail  ", "x '", "a 's b", "3.5, 4,5. x.y, z.. ,.",
    "foo, bar  baz  qux", "a\0b \0 c", "Ünï, çode. ÉÉ", "don't. we'll, I'd", "a" * 300, "_a_, b_.",
]


@pytest.fixture(scope="module", params=KINDS, ids=["words", "bytes"])
def encoder(request):
    return PieceEncoder(public_path(request.param[0]), request.param[1])


def direct(encoder, text):
    return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_give_the_ids_of_the_text(encoder):
    texts = ODD + [a + b for a in ODD for b in ODD[:12]]
    assert encoder.encode(texts) == [direct(encoder, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAbé'’.,!-_3 \n\t  ́ß日")), max_size=40))
def test_any_text(text):
    for name, spaced in KINDS:
        key = (name, spaced)
        if key not in _MADE:
            _MADE[key] = PieceEncoder(public_path(name), spaced)
        assert _MADE[key].encode([text])[0] == direct(_MADE[key], text)


_MADE: dict = {}


def test_forgetting_changes_nothing(encoder):
    encoder.known.update((f"filler{i}" if encoder.spaced else f"filler{i}".encode(), b"") for i in range(710_000))
    assert encoder.encode(ODD) == [direct(encoder, t) for t in ODD]
    assert len(encoder.known) < 1000


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_shard_round_trip_and_random_access(width):
    chance = np.random.default_rng(width)
    docs = [chance.integers(0, 1 << width, n, dtype=np.uint64).astype("<u4") for n in (0, 3, 700, 0, 1, 90)]
    shard = bitpack.Shard(bitpack.pack_shard(docs, width, block=64))
    every = np.concatenate(docs)
    assert shard.n == len(every) and shard.width == width
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
    for a, b in [(0, 0), (63, 65), (64, 128), (5, 6), (0, len(every)), (len(every), len(every))]:
        assert (shard.ids(a, b) == every[a:b]).all()
    assert len(bitpack.pack_bits(every, width)) == -(-len(every) * width // 8)
    with pytest.raises(IndexError):
        shard.ids(0, len(every) + 1)


def test_empty_shard_and_wide_ids():
    assert bitpack.Shard(bitpack.pack_shard([], 16)).n == 0
    assert [bitpack.bits_needed(v) for v in (1, 2, 3, 49_408, 65_537)] == [1, 1, 2, 16, 17]
    with pytest.raises(ValueError):
        bitpack.pack_shard([np.array([70_000], "<u4")], 16)


ROWS = [(7, "some words, and more words"), (3, None), (5, ""), (None, "no id"), (3, "again"), (1, "x " * 3000)]
SCHEMA = "doc_id long, text string, ids string, start string, part string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("shard", [10, 1 << 20])
def test_write_and_read(spark, monkeypatch, shard):
    monkeypatch.setattr(bitpack, "SHARD_IDS", shard)
    path = tempfile.mkdtemp(prefix="run-") + "/packed"
    bitpack.write_packed(documents(spark, ROWS), path, public_path(KINDS[0][0]), 49_408, 2)
    encoder = PieceEncoder(*[public_path(KINDS[0][0]), False])
    start, expected = 0, []
    for i, t in in_order(ROWS):
        ids = np.append(np.frombuffer(direct(encoder, t or ""), "<u4"), np.array([2], "<u4"))
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    got = [tuple(r) for r in bitpack.read_packed(spark, path).orderBy("start").collect()]
    assert [(a, b, c, d, list(e)) for a, b, c, d, e in got] == expected


def test_write_and_read_nothing(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/packed"
    bitpack.write_packed(documents(spark, []), path, public_path(KINDS[0][0]), 49_408, 2)
    assert bitpack.read_packed(spark, path).collect() == []


def check_pieces(pieces, rows, capacity=1024):
    encoder = PieceEncoder(public_path(KINDS[1][0]), True)
    wanted = sorted(
        (np.append(np.frombuffer(direct(encoder, t or ""), "<u4"), np.array([0], "<u4")).tolist() for _, t in rows)
    )
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    if len(by_doc) == len(rows):
        found = []
        for own in by_doc.values():
            own.sort(key=lambda p: p["start"])
            ids = [i for p in own for i in p["ids"]]
            assert [p["start"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own])[:-1])
            assert all(p["doc_tokens"] == len(ids) for p in own)
            found.append(ids)
        assert sorted(found) == wanted
    assert sum(p["length"] for p in pieces) == sum(map(len, wanted))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_pieces(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(150)] + [(1000, None), (1001, "y " * 5000)]
    pieces = packing.pack(documents(spark, rows).repartition(3), public_path(KINDS[1][0]), 0, with_ids=True).collect()
    check_pieces(pieces, rows)


def test_pieces_of_repeats_nulls_and_nothing(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None)]
    pieces = packing.pack(documents(spark, rows), public_path(KINDS[1][0]), 0, with_ids=True).collect()
    check_pieces(pieces, rows)
    assert packing.pack(documents(spark, []), public_path(KINDS[1][0]), 0).collect() == []


def test_deal_balances_cost():
    lengths = np.random.default_rng(3).integers(1, 1024, 1500)
    placed, sizes, cost = packing.deal(lengths, 1024)
    assert sum(n for _, _, n, _, _ in placed) == lengths.sum() == sizes.sum()
    assert (sizes[sizes < 1024] & (sizes[sizes < 1024] - 1) == 0).all()
    full = cost[sizes == 1024]
    in_turn = [lengths[i : i + 3] for i in range(0, len(lengths), 3)]
    plain = np.array([(n + n * n / 1024).sum() for n in in_turn])
    assert full.std() < plain.std()
    assert len(placed) <= len(lengths) + len(sizes)  # a cut fills a sequence
