"""Packing: ids against the tokenizers library, gapless sequences, few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from preflens.frames import ship
from preflens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", "the", "and", "ÉÀ", "ß", "12", "34", "!!", "'s", "<|endoftext|>", " ", "　", "日本", "😀", "\r\n", "\x1c", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)))
def test_ids_are_those_of_the_library(text):
    library = test_ids_are_those_of_the_library.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    assert np.frombuffer(packing.word_ids(PATH).ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_plan_fills_without_gap_or_overlap(counts):
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, lo, hi, first, per, offset in packing.plan_sequences(counts, 30):
        for r in range(lo, hi):
            ranks[length].append(r)
            bins[first + (r - lo) // per].append((offset + (r - lo) % per * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for content in bins.values():
        content.sort()
        assert content[0][0] == 0 and content[-1][0] + content[-1][1] <= 30
        assert all(a + n == b for (a, n), (b, _) in zip(content, content[1:], strict=False))
        assert sum(3 * n > 30 for _, n in content) <= 2
    tokens = sum(a * n for a, n in counts.items())
    if tokens:
        assert len(bins) <= 11 / 9 * max(tokens / 30, sum(n for a, n in counts.items() if 2 * a > 30)) + 2 + sum(n for a, n in counts.items() if 3 * a > 30) / 2


def test_pack_rows(spark, frame):
    ship(spark)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 40, 300])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (102, " ".join(word() for _ in range(4000))), (7, "twice"), (7, "twice")]
    rows = [(i, t, "x", 1) for i, t in rows]
    got = packing.pack(frame(rows, "doc_id long, text string, length string, piece int"), PATH, capacity=512).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) - 512 * ((len(ids) - 1) // 512)
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in sequences.values():
        content.sort()
        assert content[0][0] == 0 and sum(n for _, n in content) <= 512
        assert all(a + n == b for (a, n), (b, _) in zip(content, content[1:], strict=False))
    assert packing.pack(frame([], "doc_id long, text string"), PATH).collect() == []


def test_hot_length_is_ranked_in_parts(spark):
    pieces = spark.range(5000).selectExpr("id doc_id", "0 piece", "cast(id % 2 as long) length")
    got = packing.rank_in_length(pieces, pieces.groupBy("length").count(), ["doc_id", "piece"], rows=300).collect()
    for length in (0, 1):
        assert sorted(r["_rank"] for r in got if r["length"] == length) == list(range(2500))
