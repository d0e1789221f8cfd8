"""Operators 2, 7 and 9 against the tokenizers library and naive packing."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from skeinlog.llm import best_fit, heap_bpe, rank_merge, vocab


@pytest.fixture(scope="module")
def library(vocabulary_file):
    return Tokenizer.from_file(vocabulary_file)


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(1)
    bits = ["a", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "日本", "١", "²", "'s", "'S", "'ll", "<|endoftext|>", "<|endof", "!!", "aaaaaaa", "hahaha", "́", "\U0001f600", "​", "the", "Ġ", "\x00", "﻿"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(1500)] + ["", " ", "a ", "a\n b", " a", "a" * 5000]


def test_counts_match_the_library(library, vocabulary_file, odd_texts):
    want = [len(e.ids) for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert [sum(c) for c in rank_merge._counter(vocabulary_file).lists(odd_texts)] == want


def test_ids_and_decoding_match_the_library(library, vocabulary_file, odd_texts):
    want = [e.ids for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    got = [i.tolist() for i in heap_bpe.encode_texts(vocabulary_file, odd_texts)]
    assert got == want
    v = vocab.load(vocabulary_file)
    assert [heap_bpe.decode(v, i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert [np.frombuffer(b"".join(c), "<i4").tolist() for c in rank_merge.id_coder(vocabulary_file).lists(odd_texts)] == want


def test_cut_ids_decode_with_replacement(library, vocabulary_file):
    v, ids = vocab.load(vocabulary_file), library.encode("\U0001f600 日本", add_special_tokens=False).ids
    for k in range(len(ids)):
        assert heap_bpe.decode(v, ids[:k]) == library.decode(ids[:k], skip_special_tokens=False)


def test_token_count_query(library, docs, rows, empty, vocabulary_file):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rank_merge.token_counts(docs, vocabulary_file).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in rows)
    assert rank_merge.token_counts(empty, vocabulary_file).collect() == []


def test_round_trip_query(library, docs, rows, empty, vocabulary_file):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def want(r):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        return (r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))

    assert Counter(tuple(r) for r in heap_bpe.round_trip(docs, vocabulary_file).collect()) == Counter(map(want, rows))
    assert heap_bpe.round_trip(empty, vocabulary_file).collect() == []


def test_encode_then_decode_documents(docs, rows, vocabulary_file):
    coded = heap_bpe.encode_documents(docs, vocabulary_file)
    back = Counter((r.doc_id, r.decoded) for r in heap_bpe.decode_documents(coded, vocabulary_file).collect())
    assert back == Counter((r[0], r[1] or "") for r in rows)


def naive_best_fit(sizes, capacity):
    rows = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rows if r >= size]
        if fits:
            rows[rows.index(min(fits))] -= size
        else:
            rows.append(capacity - size)
    return sorted(capacity - r for r in rows)


def test_best_fit_equals_a_search_over_all_rows():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.choice([1, 2, 7, 16, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randrange(60))]
        made = best_fit.best_fit(sizes, capacity)
        assert sorted(p for row in made for p in row) == list(range(len(sizes)))
        assert sorted(sum(sizes[p] for p in row) for row in made) == naive_best_fit(sizes, capacity)


def test_packing_loses_nothing(library, docs, rows, empty, vocabulary_file):
    capacity = 64
    packed = best_fit.packed(docs, best_fit.encoder(vocabulary_file), capacity=capacity, block_tokens=3000).cache()
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == capacity and r.n_tokens == r.cu_seqlens[-1] <= capacity
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.token_starts) == len(r.position_resets)
        assert not ids[r.n_tokens :].any()
    segments = best_fit.unpacked(packed).collect()
    got = Counter((s.doc_id, s.token_start, tuple(s.ids)) for s in segments)
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.update((r[0], at, tuple(ids[at : at + capacity])) for at in range(0, len(ids), capacity))
    assert got == want
    assert best_fit.packed(empty, best_fit.encoder(vocabulary_file)).collect() == []


def test_parts_of_several_pre_tokens_are_cut_once(vocabulary_file):
    table = rank_merge.pair_table(vocabulary_file)
    coder = rank_merge.IdCoder(rank_merge.load(vocabulary_file), lambda pieces: rank_merge.id_pieces(table, pieces), keep_all=True)
    find, cut = coder.find, []
    coder.find = lambda text: cut.append(text) or find(text)
    text = "it's a well-known part, isn't it?"
    first, n = coder.lists([text]), len(cut)
    assert n and coder.lists([text]) == first and len(cut) == n and coder.held
