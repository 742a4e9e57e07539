import corpus_pipeline
import pytest

from emberline.llm.queries import oracle_sql, queries


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "packing"]
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14)) and set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


def test_each_stage_does_its_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, folder).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = steps["near_duplicates"](spark, good, folder)
    assert one.columns == docs.columns
    texts = [r.text for r in one.collect()]
    assert len(texts) == len(set(texts)) < good.count()
    masked = steps["secrets"](spark, one, folder)
    assert masked.schema == docs.schema and masked.count() == len(texts)
    assert all(r.n_chars == len(r.text) for r in masked.collect())
    packed = steps["packing"](spark, masked, folder)
    assert packed.select("doc_id").distinct().count() == len(texts)


def test_stages_against_plain_python(spark, folder):
    """Ids and texts that each stage keeps, by rules written anew; the classifier's own
    scores are held against plain Python in test_learning."""
    import zlib

    import numpy as np
    import public_tokenizers
    from test_similarity import plain
    from tokenizers import Tokenizer

    from emberline.llm import quality, secret_scan

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, folder).cache()
    want = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.keep}
    assert {r.doc_id: r.text for r in good.collect()} == {i: texts[i] for i in want}
    rows = [(i, texts[i]) for i in sorted(want)]
    first = {r[2] for r, (_, t) in zip(plain(rows)[0], rows) if r[1]} | {i for i, t in rows if not t.strip()}
    one = steps["near_duplicates"](spark, good, folder).cache()
    assert {r.doc_id for r in one.collect()} == first
    masked = {r.doc_id: r.text for r in steps["secrets"](spark, one, folder).collect()}
    for i in first:
        out, at = "", 0
        for _, start, end in sorted(secret_scan.scan(texts[i])[1], key=lambda s: s[1]):
            if start >= at:
                out += texts[i][at:start] + "[secret]"
            at = max(at, end)
        assert masked[i] == out + texts[i][at:]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = steps["packing"](spark, steps["secrets"](spark, one, folder), folder).collect()
    for i, text in masked.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist() and sum(p.length for p in mine) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)


def test_edge_rows_pass_through(spark, docs, none):
    import os
    import tempfile

    d = tempfile.mkdtemp()
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    for rows in (docs, none):
        at = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, d)
            assert at.columns == rows.columns
        # the classifier has too few labels to reject any: of each text one row is left, whatever its id
        words = {tuple((r.text or "").lower().split()) for r in rows.collect()}
        left = [tuple((r.text or "").lower().split()) for r in at.collect()]
        assert len({w for w in left if w}) == len([w for w in left if w]) <= len(words)
        assert left.count(()) == sum(not (r.text or "").strip() for r in rows.collect())
        packed = corpus_pipeline.STAGES[-1][1](spark, at, d)
        assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
