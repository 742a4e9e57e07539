import random

import pytest

from emberline.llm import token_counts as tc

BITS = ["hello", " world", "'ll", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|end", "oftext|>", "é", "漢字", "😀", "12", "3.5", "...", "!?", "a" * 12, " " * 7, "'", "re", "x", " 't", "　", " "]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    made = ["".join(r.choice(BITS) for _ in range(r.randrange(1, 120))) for _ in range(80)]
    return [*made, None, "", " " * 300, "a" * 500, "<|endoftext|>" * 40, "ab " * 400, "x" * 200 + " yes " * 30, made[0], made[0]]


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 30), (1 << 15, 256)])
def test_counts_of_the_library(spark, texts, chunk, overlap):
    """Chunks cut words, special strings and runs of blanks; long runs widen the overlaps."""
    count = library(tc.default_path())
    df = spark.createDataFrame([(k % 90 if k != 5 else None, t, "n", 7) for k, t in enumerate(texts)], "doc_id long, text string, uid string, k int").repartition(3)
    got = sorted((tuple(r) for r in tc.token_counts(df, limit=60, chunk=chunk, overlap=overlap).collect()), key=str)
    want = [(k % 90 if k != 5 else None, len((t or "").encode()), n := count(t or ""), n > 60) for k, t in enumerate(texts)]
    assert got == sorted(want, key=str)
    assert tc.token_counts(df.limit(0), chunk=chunk, overlap=overlap).count() == 0


def test_splices_are_proven():
    """A boundary that two readings share, outside the guard, is one of the whole text too."""
    how, r = tc.Reader(tc.default_path()), random.Random(8)
    for _ in range(150):
        text = "".join(r.choice(BITS) for _ in range(60))
        _, true, _ = how.boundaries(text)
        a, b = sorted(r.sample(range(len(text)), 2))
        for start in (0, int(r.choice(true.tolist()))):
            if start < b:
                _, place, _ = how.boundaries(text[start:b])
                proven = place[place <= b - start - how.guard] + start
                assert set(proven.tolist()) <= set(true.tolist())
        _, place, _ = how.boundaries(text[a:])
        shared = [x for x in (place + a).tolist() if x in set(true.tolist())]
        if shared:
            assert [x for x in true.tolist() if x >= shared[0]] == [x for x in (place + a).tolist() if x >= shared[0]]


def test_chunks_cover_the_text():
    for n in (0, 1, 40, 41, 100, 1000):
        places = tc.cuts(n, 40, 16)
        assert places[0][0] == 0 and places[-1][1] == n
        assert all(b[0] == a[1] - 16 for a, b in zip(places, places[1:]))


def test_other_files_read_whole_texts(spark):
    """A vocabulary with a normaliser and a piece model: no chunk of theirs is proven."""
    import public_tokenizers
    import sentencepiece

    text = "Ünïcode and  SPACES <|endoftext|> " * 30
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = lambda path: dict(tc.token_counts(df, path, chunk=32, overlap=16).select("doc_id", "n_tokens").collect())
    assert got(word) == {1: library(word)(text), 2: 0}
    assert got(piece) == {1: len(sentencepiece.SentencePieceProcessor(model_file=piece).encode(text)), 2: 0}


def test_whole_documents(spark):
    """All of the smallest table, once more by the library itself."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    count = library(tc.default_path())
    want = sorted((r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 512) for r in rows)
    assert sorted(map(tuple, tc.op13_token_counts(spark, sf).collect())) == want
