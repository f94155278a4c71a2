"""Two-tier token counts against the library itself."""

import random

import pytest

from fixtures_llm import make_docs
from terrastate.llm.common import tokenizer_path
from terrastate.llm.token_counts import PieceCounter, token_counts

MODEL = tokenizer_path("piece_bpe_32k.model")


def brute(rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return sorted(((d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t in rows), key=str)


def test_matches_the_library(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("    ab\n\t▁<s>é漢😀　eth") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a  "), (504, "</s> <unk> <0x0A>"), (505, "word " * 30_000), (505, "word "), (None, "x y")]
    for top in (0, 50):
        got = token_counts(spark, make_docs(spark, rows), MODEL, top=top)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert token_counts(spark, make_docs(spark, []), MODEL).collect() == []


@pytest.mark.parametrize("size", [0, 3, 1000])
def test_small_caches_change_nothing(size):
    texts = ["the cat sat", "the  cat\nsat ", " sat cat", "dog"] * 5
    counter = PieceCounter(MODEL, {"cat": 1}, cache_size=size)
    once = counter.count(texts)
    assert once == counter.count(texts) == [len(counter.model.encode(t)) for t in texts]
