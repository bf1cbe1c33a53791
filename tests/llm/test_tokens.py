import random

import pytest

from tracewell.llm import tokens
from tracewell.llm.pieces import Sizes, oversized, pieces, split_text

tokenizers = pytest.importorskip("tokenizers")
ENCODER = tokens.Encoder.load(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts():
    rng = random.Random(1)
    out = ["", " ", "a" * 3000, "=" * 4097, "ab" * 2000, "aaab" * 777, "<|endoftext|> x", "\x00\x01", "日本語" * 900, "🙂" * 500, "don't 's 'S", "\n\n\nNext", "x​ y", " " * 2000 + "x"]
    return out + ["".join(rng.choice("ab \n\t1é日🙂́'<|>") for _ in range(rng.randrange(400))) for _ in range(200)]


def test_ids_equal_the_library(library):
    for t, ids in zip(texts(), ENCODER.encode_batch(texts())):
        assert ids.tolist() == library(t), t[:50]


def test_operator(spark, library):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(10_000, None, 0)]
    got = {r.doc_id: list(r.ids) for r in tokens.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()}
    assert got == {i: library(t or "") for i, t, _ in rows}
    assert tokens.encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def check(text, library, sizes):
    found = split_text(text, ENCODER, sizes)
    assert (len(found) > 1) == (len(library(text)) > sizes.limit)
    if not text:
        assert found == []
        return found
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for k, (a, b, c, n, _) in enumerate(found):
        assert len(library(text[a:b])) == n <= sizes.limit
        if k:
            assert found[k - 1][1] == c and a <= c
            assert len(library(text[a:c])) <= sizes.overlap
    return found


def test_pieces_cover_the_text(library):
    rng = random.Random(8)
    small = Sizes(limit=60, overlap=8, least=20, window=3, every=8, reach=10)
    for t in [*texts(), *(" ".join(rng.choice(["word", "Other", "end.", "\n\n# Head\n", "\nline", "🙂🙂", "x" * 90]) for _ in range(rng.randrange(600))) for _ in range(60))]:
        check(t, library, small)
        check(t, library, Sizes())


def test_cuts_are_natural_and_stable(library):
    rng = random.Random(9)
    text = "\n\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(60)) + "." for _ in range(120))
    found = check(text, library, Sizes())
    assert {k for *_, k in found[1:]} == {"paragraph"}
    changed = text[:9000] + " one more sentence here. " + text[9000:]
    old, new = ({t[a:b] for a, b, *_ in check(t, library, Sizes())} for t in (text, changed))
    assert len(old - new) <= 3 < len(old)
    with pytest.raises(ValueError):
        Sizes(limit=10, overlap=10)


def test_pieces_operator(spark):
    long = "A sentence of a few words. " * 3000
    rows = [(1, long, 0), (2, "short", 0), (3, "", 0), (4, None, 0), (5, "x" * 40_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_no int")
    got = pieces(df).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in oversized(df).collect()} == {1, 5}
    assert all(r.text == (long if r.doc_id == 1 else "x" * 40_000)[r.char_start : r.char_end] for r in got)
    assert pieces(df.limit(0)).collect() == []
