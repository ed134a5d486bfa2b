"""Encoding, decoding and packing."""

import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import packing, tokenizer

TEXTS = [None, "", " ", "\n\n  x", "Hello, world! it's 12 o'clock", "<|endoftext|> plain", "नमस्ते दुनिया १२३", "a" * 5000, "  trailing  ", "日本語 🇮🇳 ﬁ\u202e", "Hello, world! it's 12 o'clock", "\t\x1c\x85x"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [3, 10**6])
def test_ids_and_round_trip(spark, reference, block):
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(2)
    got = tokenizer.encode_corpus(df, block_words=block)
    assert {r.doc_id or 0: r.ids for r in got.collect()} == {i: reference(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id or 0: r.text for r in tokenizer.decode_corpus(got).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id or 0: r.n_tokens for r in tokenizer.count_tokens(df, ["doc_id"], memo=2).collect()} == {i: len(reference(t)) for i, t in enumerate(TEXTS)}


def test_repeats_empty_and_text_ids(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, None)], "doc_id string, text string")
    assert sorted(len(r.ids) for r in tokenizer.encode_corpus(df).collect()) == [0, 2, 2]
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokenizer.decode_corpus(nulls).collect()} == {1: None, 2: ""}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_cut_is_whole_and_encodes_as_the_library(text):
    words = tokenizer.cutter()(text)
    assert "".join(words) == text


def test_every_character_is_cut_as_the_library_does(reference):
    cut, encode = tokenizer.cutter(), tokenizer.Vocabulary().encoder()
    rng = random.Random(1)
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for c in rng.sample(points, 3000) + list(range(0x300)) + list(range(0x2000, 0x2070)):
        t = f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}"
        assert [i for w in cut(t) for i in encode(w.encode())] == reference(t)


def plain_ffd(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for c, r in enumerate(room):
            if r >= sizes[i]:
                break
        else:
            c = len(room)
            room.append(capacity)
        out[i] = (c, capacity - room[c])
        room[c] -= sizes[i]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing_equals_the_plain_one(sizes):
    c, place, offset = packing.first_fit_decreasing(np.array(sizes, np.int64), 20)
    assert {i: (int(a), int(b)) for i, (a, b) in enumerate(zip(c, offset))} == plain_ffd(sizes, 20)
    assert len(set(zip(c.tolist(), place.tolist()))) == len(sizes)


def test_pack(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([None, 0, 1, 5, 40, 100, 101, 350])) for i in range(400)] + [(None, 7), (3, 9), (3, 9)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int").withColumnRenamed("x", "y")
    rows = packing.pack(df, capacity=100, group_items=60).collect()
    held, parts = {}, {}
    for r in rows:
        held.setdefault(r.container, []).append(r)
        parts.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    for c in held.values():
        at = 0
        for k, r in enumerate(sorted(c, key=lambda r: r.place)):
            assert r.place == k and r.offset == at
            at += r.n_tokens
        assert at <= 100
    for i, n in sizes:
        if i != 3 and n:
            got = sorted(parts[i])
            assert sum(x for _, x in got) == n and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and (n > 100 or len(got) == 1)
    assert not any(i in parts for i, n in sizes if not n and i != 3)
    report = packing.fill_report(packing.pack(df, capacity=100, group_items=60), 100).first()
    assert report.n_containers == len(held) and report.n_tokens == sum(n or 0 for _, n in sizes) and report.fill > 0.9
    assert packing.pack(df.limit(0)).count() == 0
