"""Phrase collocations by dynamic itemset counting.

The texts are written once as numbered words. The corpus is cut into shards that are scanned in turn, again and again. Words are counted from the first scan on. A longer phrase
is counted from the scan after both its subphrases (without its last word, without its first word) have reached the threshold, so
lengths are counted side by side, and until it has seen each shard once. The scans end when nothing is under count any more.

Tasks learn from a Bloom filter which phrases are frequent. It only ever gains bits, so a phrase that it lets through, rightly or
not, is let through by all later scans: every counted phrase sees each shard exactly once and its count is exact; a full filter
costs time, not results.

Null text: no words. Null language: ``und``. Texts are read whole, about 1 MB at a time; repeated rows count each time; ties have
a defined order. Empty tables give empty results. Columns other than the text and the language are left aside.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.frames import top_k
from preflens.llm.store import drop_table, keep, new_path, release
from preflens.llm.words import _LOWER, _PLACE, hash_spans, mix, row_slices, text_bytes

#: Fixed values of the contract: threshold, words of the longest phrase, rows for each language, percent of a longer phrase.
MIN_COUNT, LONGEST, TOP, COVERED = 100, 5, 2000, 100
SHARDS = 3
SLICE = 1 << 20  # bytes of text that a task holds as arrays at a time; a longer text stays whole
LANGUAGES = 10_000  # so many word totals are broadcast, more are joined
MOST_BITS = 1 << 27  # 16 MB of filter; more frequent phrases than it can hold cost time, not results
_ALWAYS = 1 << 30  # "since" of rows that stay open
_CODED = "shard int, words binary, langs array<string>, word binary, lang binary, continues binary"
_COUNTS = "gram string, key long, n long"  # gram: language, tab, words
_KIND = np.zeros(256, np.uint8)  # 0 word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


class Words:
    """The words of a slice of texts by number, with their spelling, language and whether a word continues the piece of the one before."""

    def __init__(self, spelling: pa.Array, langs: pa.Array, word: np.ndarray, lang: np.ndarray, continues: np.ndarray):
        self.spelling, self.langs, self.word, self.lang, self.continues = spelling, langs, word, lang, continues
        self.hash, self.lang_hash = _hashes(spelling)[word], _hashes(langs)

    @classmethod
    def of_texts(cls, texts: pa.Array, langs: pa.Array) -> Words:
        data, offsets = text_bytes(texts)
        data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        last[:-1] &= ~inside[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(offsets, starts, "right") - 1
        piece = np.cumsum(kind == 2)[starts] if len(starts) else starts
        continues = np.zeros(len(starts) + 1, bool)
        continues[1:len(starts)] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        spelled = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(spelled), pa.py_buffer(data[inside]))
        words = words.dictionary_encode()
        langs = pc.fill_null(langs, "und").dictionary_encode()
        word, lang = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, langs))
        return cls(words.dictionary, langs.dictionary, word, lang[row], continues)

    @classmethod
    def of_row(cls, words: bytes, langs: list[str], word: bytes, lang: bytes, continues: bytes) -> Words:
        """Back from a row of the coded table."""
        spelling = pc.list_flatten(pc.split_pattern(pa.array([words.decode()], pa.large_string()), " "))
        number, of = (np.frombuffer(x, np.int32).astype(np.int64) for x in (word, lang))
        links = np.unpackbits(np.frombuffer(continues, np.uint8), count=len(number) + 1).view(bool)
        return cls(spelling, pa.array(langs, pa.large_string()), number, of, links)

    def row(self) -> tuple:
        return (" ".join(self.spelling.to_pylist()).encode(), self.langs.to_pylist(), self.word.astype(np.int32).tobytes(),
                self.lang.astype(np.int32).tobytes(), np.packbits(self.continues).tobytes())

    def __len__(self) -> int:
        return len(self.word)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the phrases of this length that start at the given words."""
        total = self.lang_hash[self.lang[at]] + np.uint64(length)
        for k in range(length):
            total += self.hash[at + k] * _PLACE[k]
        return mix(total)

    def counts(self, at: np.ndarray, length: int) -> pa.RecordBatch:
        """Rows of the counts table for the phrases that start there; equal numbers of equal words, so no hash decides."""
        size = len(self.spelling)
        number = self.lang[at] * size + self.word[at]
        for k in range(1, length):
            if k > 1:
                number = np.unique(number, return_inverse=True)[1]
            number = number * size + self.word[at + k]
        _, one, n = np.unique(number, return_index=True, return_counts=True)
        one = at[one]
        phrase = [self.spelling.take(pa.array(self.word[one + k])) for k in range(length)]
        return _batch(self.langs.take(pa.array(self.lang[one])), phrase, self.keys(one, length), n)

    def totals(self) -> pa.RecordBatch:
        """Number of words of each language, as phrases without words."""
        n = np.bincount(self.lang, minlength=len(self.langs))
        return _batch(self.langs, [pa.array([""] * len(n), pa.large_string())], np.zeros(len(n), np.uint64), n)


def _batch(lang, words, key, n) -> pa.RecordBatch:
    space, tab = pa.scalar(" ", pa.large_string()), pa.scalar("\t", pa.large_string())
    phrase = pc.binary_join_element_wise(*words, space) if len(words) > 1 else words[0]
    gram = pc.binary_join_element_wise(lang, phrase, tab)
    return pa.RecordBatch.from_arrays([gram.cast(pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["gram", "key", "n"])


def _hashes(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    return hash_spans(data, offsets[:-1], offsets[1:], lower=False)


def _holds(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(keys), bool)
    top, out = np.uint64(8 * len(bits) - 1), np.ones(len(keys), bool)
    for place in (keys & top, (keys >> np.uint64(32)) & top):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def _count_shard(shard: DataFrame, now, before, longest: int) -> DataFrame:
    """Counts of what this scan counts: words without ``before``, and phrases that the filter ``now`` lets through and ``before`` not yet."""

    def count(batches):
        filters = [None if b is None else b.value for b in (now, before)]
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                words = Words.of_row(*row)
                if filters[1] is None:
                    yield words.totals()
                    yield words.counts(np.arange(len(words)), 1)
                able = [np.ones(len(words) + 1, bool) for _ in filters]  # may a phrase of this length start here?
                able[0][-1] = able[1][-1] = False
                for length in range(2, longest + 1):
                    for a, bits in zip(able, filters):
                        at = np.flatnonzero(a)
                        a[at] = _holds(bits, words.keys(at, length - 1))
                        a[:-1] &= a[1:] & words.continues[1:] if length == 2 else a[1:]
                    if not able[0].any():
                        break
                    fresh = np.flatnonzero(able[0] & ~able[1])
                    if len(fresh):
                        yield words.counts(fresh, length)

    return shard.select("words", "langs", "word", "lang", "continues").mapInArrow(count, _COUNTS)


def _filter_bits(frequent: DataFrame, n_bits: int) -> np.ndarray:
    """The Bloom filter of the keys, built by the executors in pieces of 32,768 bits."""
    places = [part.bitwiseAND(F.lit(n_bits - 1)) + 1 for part in (F.col("key"), F.shiftrightunsigned("key", 32))]
    bit = frequent.select(F.explode(F.array(*places)).alias("bit"))
    pieces = bit.groupBy(F.bitmap_bucket_number("bit").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for piece, bits in pieces.collect():  # n_bits / 8 bytes at most
        found = np.frombuffer(bytes(bits), np.uint8)
        out[(piece - 1) * 4096:piece * 4096] = found
    return out


def in_shards(docs: DataFrame, shards: int, text: str, lang: str) -> tuple[DataFrame, str]:
    """The texts as numbered words, written once: rows dealt in turn to the shards, some thousand texts to a row of the table."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "shards")

    def code(batches):
        types = [pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for shard in range(shards):
                rows = pa.array(np.arange(shard, batch.num_rows, shards))
                langs, texts = (batch.column(i).cast(pa.large_string()).take(rows) for i in (0, 1))
                for lo, hi in row_slices(text_bytes(texts)[1], SLICE):
                    words = Words.of_texts(texts.slice(lo, hi - lo), langs.slice(lo, hi - lo))
                    if len(words):
                        row = [pa.array([x], t) for x, t in zip((shard, *words.row()), types)]
                        yield pa.RecordBatch.from_arrays(row, ["shard", "words", "langs", "word", "lang", "continues"])

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(code, _CODED).write.partitionBy("shard").parquet(path)
    return spark.read.schema(_CODED).parquet(path), path


def frequent_phrases(
    docs: DataFrame, min_count=MIN_COUNT, longest=LONGEST, shards=SHARDS, text="text", lang="lang", most_bits=MOST_BITS,
) -> DataFrame:
    """(lang, length, phrase, n): every phrase of at most ``longest`` words with ``min_count`` occurrences, and all words of a
    language as its phrase of length 0."""
    spark = docs.sparkSession
    table, path = in_shards(docs, shards, text, lang)
    size = table.agg(F.sum(F.octet_length("word"))).first()[0] or 0  # 4 bytes a word
    n_bits = 1 << 15
    while n_bits < min(most_bits, 4 * size // min_count):
        n_bits *= 2
    filters, state, step = [None], None, 0
    while True:
        now, before = filters[step], filters[step - shards] if step >= shards else None
        if step >= shards and before is None:  # the words are done
            before = np.zeros(n_bits // 8, np.uint8)
        sent = [None if bits is None else spark.sparkContext.broadcast(bits) for bits in (now, before)]
        since = F.when(F.endswith(F.col("gram"), F.lit("\t")), _ALWAYS).otherwise(step)
        found = _count_shard(table.filter(F.col("shard") == step % shards), *sent, longest).withColumn("since", since)
        if state is not None:
            found = found.unionByName(state)
        found = found.groupBy("gram").agg(F.sum("n").alias("n"), F.min("since").alias("since"), F.max("key").alias("key"))
        # A phrase first seen in this scan is complete after shards - 1 more of them at the latest.
        found = keep(found.filter((F.col("n") >= min_count) | (F.col("since") + (shards - 1) > step)), "phrases")
        if state is not None:
            drop_table(spark, state)
        state, step = found, step + 1
        known = _by_columns(state.filter(F.col("n") >= min_count))
        filters.append(_filter_bits(known.filter(F.col("length").between(1, longest - 1)), n_bits))
        for b in sent:
            if b is not None:
                b.unpersist()
        release(spark)
        older = filters[step - shards] if step >= shards else None
        if step >= shards and np.array_equal(filters[step], np.zeros_like(filters[step]) if older is None else older):
            break
    drop_table(spark, path)
    known = _by_columns(state.filter((F.col("n") >= min_count) | (F.col("since") == _ALWAYS)))
    return known.select("lang", "length", "phrase", "n")


def _by_columns(grams: DataFrame) -> DataFrame:
    phrase = F.substring_index("gram", "\t", -1)
    grams = grams.withColumns({"phrase": phrase, "lang": F.expr("left(gram, length(gram) - length(substring_index(gram, '\t', -1)) - 1)")})
    return grams.withColumn("length", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))


def best_cuts(counts: DataFrame) -> DataFrame:
    """(lang, length, phrase, a, l, r, n, score): every phrase of two words or more at the cut that scores lowest."""
    whole = counts.filter("length > 1").select("lang", "length", "phrase", F.col("n").alias("a"))
    parts = counts.filter("length > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(words, F.col("k") + 1, F.col("length")), " "))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    totals = counts.filter("length = 0").select("lang", "n")  # one row a language
    if totals.count() <= LANGUAGES:
        totals = F.broadcast(totals)
    cuts = cuts.join(totals, "lang")

    def wide(name: str) -> Column:
        return F.col(name).cast("decimal(18,0)")

    thousand = F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumns({"_up": wide("a") * wide("n") * thousand, "_down": wide("l") * wide("r")})  # 10^38 at most
    cuts = cuts.withColumn("score", F.expr("_up DIV _down"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "length", "phrase", "a", "n").agg(lowest)
    return best.select("lang", "length", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def without_covered(scored: DataFrame, percent: int = COVERED) -> DataFrame:
    """Phrases that no longer one holds with at least ``percent`` percent of their occurrences."""
    words = F.split("phrase", " ")
    longer = scored.filter("length > 2").select("lang", "length", words.alias("w"), F.col("a").alias("f"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    covered = scored.join(inner, ["lang", "phrase"], "left")
    return covered.filter(F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a"))).drop("f")


def mine(
    docs: DataFrame, min_count=MIN_COUNT, longest=LONGEST, top=TOP, percent=COVERED, shards=SHARDS, text="text", lang="lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of every language."""
    counts = frequent_phrases(docs, min_count, longest, shards, text, lang)
    scored = keep(best_cuts(counts), "collocations")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = top_k(without_covered(scored, percent), ["lang"], order, top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""WITH worded AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
  f AS MATERIALIZED (SELECT lang, m AS length, w AS phrase, count(*) AS n FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2),
      lambda i: array_to_string(w[i:i + m - 1], ' '))) AS w FROM worded, range(1, 6) l(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 100),
  total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY 1),
  parts AS (SELECT lang, length, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y
    FROM f, range(1, 5) g(k) WHERE k < length),
  cuts AS (SELECT p.lang, p.length, p.phrase, a, k, l.n AS l, r.n AS r, t.n, a::HUGEINT * 1000 * t.n // (l.n::HUGEINT * r.n) AS score
    FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = x JOIN f r ON r.lang = p.lang AND r.phrase = y JOIN total t ON t.lang = p.lang),
  cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
  inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f FROM (SELECT lang, a, length, string_split(phrase, ' ') AS w FROM cand),
      range(2, 5) s(m), range(1, 5) p(i) WHERE m < length AND i + m - 1 <= length GROUP BY 1, 2),
  kept AS (SELECT c.* FROM cand c LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * c.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang
    ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""
