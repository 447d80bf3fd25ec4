"""The automaton against a dictionary; ids and decoded text against the tokenizers library."""

import gc
import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from preflens.frames import ship
from preflens.llm import transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [" ", "\n", "the", "And", "ÉÀ", "É", "ß", "İ", "ΣΑΣ", "12", "½", "²", "!!", "'s", "'S", "<|endoftext|>", "<|startoftext|>", " ", "日本", "😀", "\x1c", "\x85", "­", "_", "thE"]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5), max_size=60), st.lists(st.binary(min_size=1, max_size=5), max_size=20))
def test_automaton_numbers_words(tmp_path_factory, words, others):
    words = sorted(words)
    path = tmp_path_factory.mktemp("lexicon") / "file"
    path.write_bytes(transducer.pack_file(words, [[i, len(w)] for i, w in enumerate(words)]))
    lexicon = transducer.Lexicon(str(path))
    asked = words + others
    want = {w: i for i, w in enumerate(words)}
    assert lexicon.numbers(asked).tolist() == [want.get(w, -1) for w in asked]
    assert [lexicon.ids_of(i) for i in range(len(words))] == [[i, len(w)] for i, w in enumerate(words)]


def test_automaton_shares_suffixes():
    words = sorted(f"{a}{b}ing".encode() for a in "abcdef" for b in "xyz")
    assert len(transducer.build_automaton(words)["ends"]) == 6


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)))
def test_ids_are_those_of_the_library(text):
    work = test_ids_are_those_of_the_library.__dict__.setdefault("work", transducer.Encoder(transducer.rules(PATH), None))
    ids, shown = work.encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert list(map(int, ids.split())) == want
    assert shown == LIBRARY.decode(want, skip_special_tokens=False)


def test_corpus(spark, frame):
    ship(spark)
    rows = [(1, "The quick brown fox's den, the QUICK fox"), (2, None), (3, ""), (4, " \n\t "), (None, "no id"), (5, "Ünïcödé 12345 <|endoftext|> x" * 3000),
            (1, "repeated"), (1, "repeated")]
    df = frame([(*r, "clash", 3) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    for size in (3, 1000):
        assert sorted(map(tuple, transducer.encode_corpus(df, PATH, size=size).collect()), key=repr) == sorted(want, key=repr)
    assert transducer.encode_corpus(frame([]), PATH).collect() == []
    full = transducer.encode(df, PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == r["n_tokens"] for r in full)


def test_encoder_keeps_few_objects(tmp_path, monkeypatch):
    """A word is not a list or tuple of its own for the garbage collector, mapped arrays are plain, and a full memory changes nothing."""
    own, words = transducer.rules(PATH), [f"w{i}'s" for i in range(400)]
    parts = sorted({p for w in words[::2] for p in own.parts(w)})
    (tmp_path / "file").write_bytes(transducer.pack_file(parts, own.merge(parts)))
    lexicon = transducer.Lexicon(str(tmp_path / "file"))
    assert type(lexicon.ids) is np.ndarray
    plain, small = transducer.Encoder(own, None), transducer.Encoder(own, lexicon)
    want = plain.encode([" ".join(words)])
    assert small.encode([" ".join(words)]) == want
    monkeypatch.setattr(transducer, "CACHE_WORDS", 7)
    assert [small.encode([w])[0] for w in words] == [plain.encode([w])[0] for w in words]
    assert len(small.known) <= 7 and not any(map(gc.is_tracked, small.known.values()))
