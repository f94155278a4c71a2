"""Packing: pieces against the tokenizer, an exact cover, and few sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fixtures_llm import make_docs
from terrastate.llm.common import tokenizer_path
from terrastate.llm.packing import IdEncoder, best_fit, cut_all, pack, packed_pieces, ranked_encoder, sequences

PATH = tokenizer_path("byte_bpe_50k.json")


def brute_pieces(rows, size):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(PATH), []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        first = len(ids) % size if len(ids) > size else len(ids)
        for k, n in enumerate(([first] if first else []) + [size] * (len(ids) // size if len(ids) > size else 0)):
            out.append((d, k, at, n, zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[at:at + n]))))
            at += n
        assert at == len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("flush,per_task,fan_in", [(200_000, 400_000, 8), (5, 7, 2)])
def test_pieces_cover_and_fill(spark, flush, per_task, fan_in):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "naïve", "x1", "a\nb"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(300, None), (301, ""), (302, "<|endoftext|> a"), (303, "a  b \n c"), (303, "a  b \n c"), (None, "null id"), (304, "w " * 900)]
    got = pack(spark, make_docs(spark, rows).repartition(3), PATH, size=64, flush=flush, per_task=per_task, fan_in=fan_in, slack=2).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == brute_pieces(rows, 64)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * total / 64 + 2


def test_empty_table(spark):
    assert pack(spark, make_docs(spark, []), PATH).collect() == []


def test_cut_and_best_fit():
    cuts = [c.tolist() for c in cut_all(np.array([5, 4, 8, 1]), 4)]
    assert list(zip(*cuts)) == [(0, 0, 0, 1), (0, 1, 1, 4), (1, 0, 0, 4), (2, 0, 0, 4), (2, 1, 4, 4), (3, 0, 0, 1)]
    bins, offsets, count = best_fit(np.array([6, 4, 5, 3, 2]), 10)
    assert count == 2 and bins.tolist() == [0, 0, 1, 1, 1] and offsets.tolist() == [0, 6, 0, 5, 8]


def test_ids_match_the_library_on_odd_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice("    ab\n\t\r'sve<é漢😀  　½²1") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    encoder = IdEncoder(PATH, cache_size=50)
    got = map(encoder.encode, texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("options", [{}, {"flush": 5, "per_task": 7, "fan_in": 2}, {"flush_tokens": 100}])
def test_ids_go_along_into_the_sequences(spark, options):
    from tokenizers import Tokenizer

    rng, t = random.Random(2), Tokenizer.from_file(PATH)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "naïve", "x1"]) for _ in range(rng.randint(0, 90)))) for i in range(100)]
    rows += [(300, None), (301, "w " * 900), (302, "same"), (302, "same"), (None, "null id")]
    pieces = packed_pieces(spark, make_docs(spark, rows).repartition(3), PATH, size=64, slack=2, **options).cache()
    got = pieces.collect()
    texts = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in rows}
    assert all(list(r.ids) == texts[r.doc_id][r.start:r.start + r.length] for r in got)
    assert sum(r.length for r in got) == sum(len(texts[d]) for d, _ in rows)
    packed = {r.sequence_id: (r.n_tokens, list(r.ids)) for r in sequences(pieces).collect()}
    assert len(packed) == len({r.sequence_id for r in got})
    for r in got:
        n, ids = packed[r.sequence_id]
        assert n == len(ids) <= 64 and ids[r.offset:r.offset + r.length] == list(r.ids)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_ids_match_the_library_on_words_of_the_corpus():
    import duckdb
    from tokenizers import Tokenizer

    texts = [t for t, in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    encoder, library = IdEncoder(PATH, cache_size=3_000), Tokenizer.from_file(PATH)
    assert ranked_encoder(library) is not None
    got = map(encoder.encode, texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_another_kind_of_vocabulary_is_not_ranked():
    from tokenizers import Tokenizer

    assert ranked_encoder(Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))) is None
