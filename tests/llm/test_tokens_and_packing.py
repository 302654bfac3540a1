import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldglass.llm import packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = "aaAbbcÉé'SsßñÑ \t\n\r\x0b\x1c\x85\xa0 漢字0123½²!?-_<|>\U0001f600́​ΣσİĲƏſK"


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD), packing.WordIds(WORD)


texts = st.lists(st.one_of(st.sampled_from(list(ODD)), st.sampled_from(["the", " they're", "<|endoftext|>", "<|startoftext|>", "\n\n", "thing"])), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_equal_the_library(byte_library, text):
    library, counter = byte_library
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_equal_the_library(word_library, text):
    library, words = word_library
    assert words.ids([text, None, text]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, "", text)]


def test_long_pretokens_and_full_memo(byte_library, monkeypatch):
    library, counter = byte_library
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 3)
    for text in ("ab" * 20_000, "one two three four five six", "=" * 5000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


DOCS = "text string, doc_id long, n_tokens long, piece int, length long, rank long, task long"


def docs(spark, *rows):
    return spark.createDataFrame([(t, i, 9, 9, 9, 9, 9) for i, t in rows], DOCS)


def test_count_tokens_edges(spark, rows):
    out = token_counts.count_tokens(docs(spark, (1, None), (2, ""), (None, "hello there"), (3, "x " * 3000), (3, "x " * 3000)), BYTE)
    assert rows(out) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 11, 2, False), (3, 6000, 3001, True), (3, 6000, 3001, True)], key=repr)
    assert token_counts.count_tokens(docs(spark), BYTE).count() == 0


def test_tree_finds_the_tightest_room():
    tree, held, rng = packing.Tree(64), Counter(), random.Random(1)
    for _ in range(3000):
        room = rng.randint(0, 64)
        if rng.random() < 0.5 and held[room]:
            held[room] -= 1
            tree.add(room, -1)
        else:
            held[room] += 1
            tree.add(room, 1)
        want = min((r for r, n in held.items() if n and r >= room), default=None)
        assert tree.tightest(room) == want


def brute_bins(lengths, capacity):
    """Best fit decreasing, one document at a time: the rooms that are left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120))
def test_plan_equals_one_at_a_time(lengths):
    bins = defaultdict(list)
    for length, _, n, first, offset in packing.plan(Counter(lengths), 40):
        for k in range(n):
            bins[first + k].append((offset, length))
    rooms = []
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        rooms.append(40 - end)
    assert sorted(rooms) == brute_bins(lengths, 40)


def test_pack_round_trip(spark):
    library = Tokenizer.from_file(WORD)
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["thing", "erthly", "of", "the,"]) for _ in range(rng.choice([0, 1, 5, 40, 900])))) for i in range(60)] + [(7, "thing"), (None, "of"), (99, None)]
    out = packing.pack(docs(spark, *data).repartition(3), WORD, capacity=256).collect()
    want = Counter()
    for i, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 256)):
            want[i, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 256
    assert len(bins) == len(brute_bins([r.length for r in out], 256))
    assert packing.pack(docs(spark), WORD).count() == 0
