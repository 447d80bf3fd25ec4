"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent pre-tokens of the corpus, found by a Spark count, are compiled with their ids into one automaton that shares
prefixes and suffixes. Numbers on its transitions add up to the number of the word, which addresses the ids. Executors get
the file from the shared folder, map it into memory, and walk it for all new words of a batch at once; words outside it are
merged exactly by the ranks of the vocabulary.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from preflens.llm.packing import byte_characters
from preflens.llm.store import most_frequent, share_file

LEXICON_WORDS = 65_536
CACHE_WORDS = 600_000
COUNTED_WORDS = 200_000
SLICE_CHARS = 2_000_000
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_WORD = regex.compile(r"\S+")


# ---------------------------------------------------------------- automaton


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal automaton of sorted distinct words: transitions by (state, byte), and how many words each one skips."""
    register: dict[tuple, int] = {}
    below: list[int] = []  # words that end at or under a state
    edges: list[tuple] = []
    path: list[list] = [[False, {}]]  # per letter of the last word: [final, byte -> state]

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            key = (final, tuple(out.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(below)
                below.append(final + sum(below[t] for t in out.values()))
                edges.append((final, tuple(out.items())))
            path[-1][1][last[len(path) - 1]] = state

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(last), len(word)) and last[shared] == word[shared]:
            shared += 1
        fold(shared)
        path.extend([False, {}] for _ in word[shared:])
        path[-1][0] = True
        last = word
    fold(0)
    final, out = path[0]
    edges.append((final, tuple(out.items())))  # the start is the last state
    keys, target, skip, ends = [], [], [], []
    for state, (final, out) in enumerate(edges):
        passed = int(final)
        ends.append(final)
        for byte, t in sorted(out):
            keys.append(state << 8 | byte)
            target.append(t)
            skip.append(passed)
            passed += below[t]
    return {"keys": np.array(keys, "<i8"), "target": np.array(target, "<i4"), "skip": np.array(skip, "<i4"), "ends": np.array(ends, "<i4")}


def pack_file(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton and the ids of its words as one file: a header line with the lengths, then the arrays."""
    parts = build_automaton(words)
    parts["first"] = np.cumsum([0, *map(len, ids)]).astype("<i4")
    parts["ids"] = np.array([i for x in ids for i in x], "<i4")
    head = json.dumps({k: [v.dtype.str, len(v)] for k, v in parts.items()}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(v.tobytes() + b"\0" * (-v.nbytes % 8) for v in parts.values())


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        at = len(head)
        for name, (kind, n) in json.loads(head).items():
            nbytes = n * np.dtype(kind).itemsize
            # A plain array over the mapped file: slices of a memmap object cost several times as much.
            setattr(self, name, np.asarray(np.memmap(path, kind, "r", at, (n,))) if n else np.zeros(0, kind))
            at += nbytes + -nbytes % 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, or -1; all words walk at once."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), len(self.ends) - 1, np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(size)
        step = 0
        while len(live):
            key = state[live] << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            live, at = live[known], at[known]
            number[live] += self.skip[at]
            state[live] = self.target[at]
            step += 1
            done = live[size[live] == step]
            done = done[self.ends[state[done]] == 1]
            out[done] = number[done]
            live = live[size[live] > step]
        return out

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.first[number]:self.first[number + 1]].tolist()


# ---------------------------------------------------------------- the tokenizer's own rules


class Rules:
    """Normaliser, word pattern, merges and token texts of a tokenizers file with word-end marks."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = PairTable(np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges], np.int64))
        self.joined = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.byte = byte_characters()
        self.letter = {b: c for c, b in self.byte.items()}
        self.inner = np.array([self.vocab[self.letter[b]] for b in range(256)], np.int64)
        self.final = np.array([self.vocab[self.letter[b] + self.end] for b in range(256)], np.int64)
        self.library = Tokenizer.from_file(path)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def normal(self, text: str) -> str:
        return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()

    def words(self, text: str) -> list[str]:
        """Parts between white space; the pattern never takes white space into a token."""
        return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()

    def parts(self, word: str) -> list[bytes]:
        """Pre-tokens of a word. Beyond Latin letters the library's own tables decide, as Unicode versions differ."""
        if word.isascii():
            return [p.encode() for p in self.pattern.findall(word.lower())]
        if max(word) < "\u0250":
            return [p.encode() for p in self.pattern.findall(self.normal(word))]
        library = self.library
        found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(word))
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in found]

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens: each joins its neighbours of lowest rank, leftmost first, until none is left; all at once."""
        out: list[list[int]] = [[]] * len(parts)
        if not parts:
            return out
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(size) - 1
        symbols[last] = self.final[data[last]]
        owner = np.arange(len(parts))
        start = last - size + 1
        none = len(self.pairs)
        while len(owner):
            length = np.diff(np.append(start, len(symbols)))
            rank = np.full(len(symbols), none)
            if len(symbols) > 1:
                rank[:-1] = self.pairs.find(symbols[:-1] << 20 | symbols[1:])
            rank[start + length - 1] = none
            best = np.minimum.reduceat(rank, start)
            done = best == none
            if done.any():
                inside = np.repeat(done, length)
                flat, cut = symbols[inside].tolist(), np.append(0, np.cumsum(length[done])).tolist()
                for i, word in enumerate(owner[done].tolist()):
                    out[word] = flat[cut[i]:cut[i + 1]]
                symbols, rank, owner, best, length = symbols[~inside], rank[~inside], owner[~done], best[~done], length[~done]
            if not len(owner):
                break
            chosen = rank == np.repeat(best, length)
            # In a run of equal pairs every other one joins.
            at = np.flatnonzero(chosen)
            head = np.append(True, np.diff(at) > 1)
            at = at[(at - np.repeat(at[head], np.diff(np.append(np.flatnonzero(head), len(at))))) % 2 == 0]
            symbols[at] = self.joined[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            first = np.cumsum(length) - length
            symbols = symbols[stay]
            start = (np.cumsum(stay) - stay)[first]
        return out


class PairTable:
    """Rank of a pair of symbols by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.bits = max(4, int(np.ceil(np.log2(4 * self.n + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.n, np.int64)
        self.probes = 0
        left, at = np.arange(self.n), self.place(keys)
        while len(left):
            self.probes += 1
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.ranks[at[put]] = keys[left[put]], left[put]
            wait = np.ones(len(left), bool)
            wait[put] = False
            left, at = left[wait], (at[wait] + 1) & ((1 << self.bits) - 1)

    def __len__(self) -> int:
        return self.n

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ranks; the number of pairs where there is none."""
        at = self.place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], self.n)
        left = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (got != -1)]
        return out


@functools.lru_cache(1)
def rules(path: str) -> Rules:
    return Rules(path)


@functools.lru_cache(1)
def encoder(path: str, lexicon: str | None) -> Encoder:
    return Encoder(rules(path), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


class Encoder:
    """Encodes texts; remembers the words of late, up to a bound."""

    def __init__(self, own: Rules, lexicon: Lexicon | None):
        self.own, self.lexicon = own, lexicon
        self.known: dict[str, str] = {}  # word -> ids as text
        self.shown: dict[str, str] = {}  # word -> its tokens' texts
        self.held: dict[int, str] = {}  # the same for numbers of the lexicon
        self.held_shown: dict[int, str] = {}

    def as_text(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), " ".join(map(self.own.text_of.__getitem__, ids))

    def texts(self, parts: list[bytes]) -> tuple[list[str], list[str]]:
        """Ids and tokens of each pre-token as text, from the automaton or merged."""
        numbers = self.lexicon.numbers(parts).tolist() if self.lexicon else [-1] * len(parts)
        for n in set(numbers).difference(self.held, (-1,)):
            self.held[n], self.held_shown[n] = self.as_text(self.lexicon.ids_of(n))
        ids, shown = list(map(self.held.get, numbers)), list(map(self.held_shown.get, numbers))
        left = [i for i, n in enumerate(numbers) if n < 0]
        for i, merged in zip(left, self.own.merge([parts[i] for i in left]), strict=True):
            ids[i], shown[i] = self.as_text(merged)
        return ids, shown

    def learn(self, words: set[str]) -> None:
        """Look the words up in the automaton together; merge what it does not hold."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            self.shown.clear()
            new = list(words)
        # One flat list: a list for each word would keep the garbage collector busy.
        parts, ends = [], []
        for word in new:
            parts += self.own.parts(word)
            ends.append(len(parts))
        ids, shown = self.texts(parts)
        at = 0
        for word, end in zip(new, ends, strict=True):
            if end - at == 1:
                self.known[word], self.shown[word] = ids[at], shown[at]
            else:
                self.known[word], self.shown[word] = " ".join(ids[at:end]), " ".join(shown[at:end])
            at = end

    def pieces(self, text: str) -> list[tuple[str, list[str]]]:
        """(special token or "", words) in order."""
        own = self.own
        if own.splitter is None or "<" not in text or not own.splitter.search(text):
            return [("", own.words(text))]
        return [(p, []) if p in own.special else ("", own.words(p)) for p in own.splitter.split(text) if p]

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by a space, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*(words for text in split for _, words in text)))
        out = []
        for text in split:
            ids, shown = [], []
            for special, words in text:
                if special:
                    ids.append(str(self.own.special[special]))
                    shown.append(special)
                else:
                    ids += filter(None, map(self.known.__getitem__, words))
                    shown += filter(None, map(self.shown.__getitem__, words))
            out.append((" ".join(ids), " ".join(shown)))
        return out


# ---------------------------------------------------------------- Spark jobs


def slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= SLICE_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts: counted in the tasks first, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").split())
                if len(counts) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, tokenizer: str, text_col: str = "text", size: int = LEXICON_WORDS) -> str | None:
    """Compile the most frequent words, ``size`` at most, of the corpus; returns the shared file's name (None if no word recurs).

    ``size`` bounds the file, not the work: every other word is merged where it occurs.
    """
    top = most_frequent(word_counts(df, text_col), size).collect()
    own = rules(tokenizer)
    words = sorted({p for r in top for p in own.parts(r["word"])})
    return share_file(df.sparkSession, pack_file(words, own.merge(words)), "lexicon") if words else None


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon: str | None = None, with_ids: bool = False) -> DataFrame:
    """Ids and decoded text of every text: id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds ids and decoded.

    Null and empty texts have no tokens; other columns are left aside; repeated rows stay. ``lexicon`` is the name that
    ``build_lexicon`` gives; without it every word is merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(tokenizer, lexicon)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            at = 0
            for texts in slices(t.as_py() for t in batch.column(1)):
                rows = work.encode(texts)
                columns = [
                    batch.column(0).slice(at, len(texts)), pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in rows], pa.int64()),
                    pa.array([digest(ids) for ids, _ in rows]), pa.array([digest(shown) for _, shown in rows]),
                ]
                if with_ids:
                    columns += [pa.array([list(map(int, ids.split())) for ids, _ in rows], pa.list_(pa.int32())), pa.array([s for _, s in rows], pa.string())]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON_WORDS) -> DataFrame:
    """Compile the corpus's lexicon, then encode and decode every text with it."""
    return encode(df, tokenizer, id_col, text_col, build_lexicon(df, tokenizer, text_col, size))
