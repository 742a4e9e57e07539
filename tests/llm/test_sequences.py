import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import bpe
from emberline.llm.common import shared_dir
from emberline.llm.packing import Packer, pack_documents, step_groups
from emberline.llm.token_files import Corpus, ShardReader, read_token_files, write_token_files

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text, end):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB \n\té1!.'s漢-_\r "), max_size=24), st.sampled_from(["", "<|endoftext|>", "'ll", "   "]))
def test_units_give_the_library_ids(text, more):
    text = text + more + text
    assert np.frombuffer(bpe.encoder().encode(text), "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tables_keep_two_generations():
    t = bpe._Table(lambda k: k * 2, 3)
    assert [t[k] for k in (1, 2, 3, 4, 1, 5, 6, 7)] == [2, 4, 6, 8, 2, 10, 12, 14]
    assert len(t) <= 3 and len(t.old) <= 3


def test_a_word_is_kept_once():
    enc = bpe.ByteEncoder(bpe.default_path())
    letters = "abcdefghij"
    words = [f"qu{a}{b}{c}" for a in letters for b in letters for c in letters]
    text = "".join(f" {w} {w}" for w in words)
    assert np.frombuffer(enc.encode("x" + text), "<u2").tolist() == LIBRARY.encode("x" + text, add_special_tokens=False).ids
    assert len(enc.units) + len(enc.pieces) == len(words) + 1  # and the first letter


def test_line_ends_and_marks_need_no_pattern():
    enc = bpe.ByteEncoder(bpe.default_path())
    found, plain = [], enc.split
    enc.split = lambda text: found.append(text) or plain(text)
    text = "a bc.\nDe fg,\nhi\njk lm! no\n\nPq é.\nRs"
    assert np.frombuffer(enc.encode(text), "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert found == ["a", " no\n\nPq"]


def test_token_files_round_trip(spark, docs, rows):
    folder = shared_dir(spark, "test-tokens")
    manifest = write_token_files(docs, folder, seq_len=64, shards=3)
    got = read_token_files(spark, folder, manifest).collect()
    assert len(got) == len(rows)
    want = sorted((i, crc(ids_of(t, 2))) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.ids_crc32) for r in got if r.doc_id is not None) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    known = [r.doc_id for r in got]
    assert known[:2] == [None, None] and known[2:] == sorted(known[2:])
    # sequences are found by their number, without reading others
    manifest = manifest.collect()
    shard = max(manifest, key=lambda m: m[3])
    reader = ShardReader(folder, shard.name)
    whole = reader.ids(0, shard[2])
    for i in (0, shard[3] // 2, shard[3] - 1):
        ids, mask = reader.sequence(i)
        real = whole[i * 64 : (i + 1) * 64]
        assert (ids[: len(real)] == real).all() and mask.sum() == len(real)
        assert not ids.flags.owndata and not mask.flags.owndata  # views of the file
    corpus = Corpus(folder, manifest)
    assert len(corpus) == sum(m.n_sequences for m in manifest)
    flat = [ids[mask] for ids, mask in map(corpus.sequence, range(len(corpus)))]
    every = np.concatenate(flat)
    assert [crc(every[r.start : r.start + r.n_tokens]) for r in got] == [r.ids_crc32 for r in got]


def test_token_files_of_no_documents(spark, none):
    folder = shared_dir(spark, "test-tokens")
    assert read_token_files(spark, folder, write_token_files(none, folder)).count() == 0


def check_pieces(pieces, rows):
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert sum(p.length for p in pieces) == sum(len(ids_of(t, 1)) for _, t in rows)


def test_packing(docs, rows):
    pieces = pack_documents(docs).collect()
    check_pieces(pieces, rows)
    for i, t in rows:
        if i is None or i == 3:
            continue
        at, ids = 0, ids_of(t, 1)
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_packing_of_no_documents(none):
    assert pack_documents(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60), st.sampled_from([3000, 1 << 20]))
def test_windows_are_full_and_ids_meet_once(lengths, pool):
    packer = Packer(pool_tokens=pool)
    for k, n in enumerate(lengths):
        packer.add(k, n)
    packer.finish()
    seen = {}
    for tier, window in packer.take():
        assert sum(n for _, _, n in window) == tier and tier <= 2048
        for key, start, n in window:
            seen.setdefault(key, []).append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, m in sorted(seen[k]):
            assert start == at
            at += m
        assert at == n


def test_step_groups_are_balanced():
    sizes = [2048] * 40 + [256] * 300 + [512] * 50
    groups = step_groups(sizes, 1 << 15)
    cost = [sum(s + s * s / 4096 for s, g in zip(sizes, groups) if g == k) for k in set(groups)]
    assert max(cost) < 1.1 * min(cost)


def test_step_groups_hold_across_short_texts(spark):
    rows = spark.createDataFrame([(k, "word " * (1 + k % 60)) for k in range(30_000)], "doc_id long, text string").coalesce(1)
    windows = {(p.sequence_id, p.tier, p.step_group) for p in pack_documents(rows, pool_tokens=1 << 15).collect()}
    size = {}
    for _, tier, group in windows:
        size[group] = size.get(group, 0) + tier
    by_group = [size[g] for g in sorted(size)]
    assert len(by_group) > 10 and max(by_group[:-1]) < 1.5 * min(by_group[:-1])


def test_tiers_must_be_powers_of_two():
    with pytest.raises(ValueError):
        Packer(tiers=(100,))
