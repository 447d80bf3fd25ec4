"""N-gram Jaccard join over prefix trees, and the components of its links.

A text's set of word shingles is ordered globally, shingles that recur a lot last. Two sets over the threshold share a shingle
of their short prefixes, so only prefixes are shuffled. Sets that share one are compared in blocks of bounded size: a block's
ordered sets form a trie, and each set walks it once, sharing the overlap counted on common paths and leaving subtrees that
the remaining lengths put out of reach.

Only connected components are asked for, so large groups need no all-pairs work: each document is first compared with the one pivot
that it shares most prefix shingles with (block mates are compared too), then with one other; groups that are connected by then
are done, and what is left, exactly, is compared across components. There, bit marks of the prefixes and short ones of the whole sets
bound how much two of them share before a pair leaves the join. Marks of whole sets, a bit or two a shingle, bound what a candidate pair shares, so only
texts of pairs that nearly link, or do, are shuffled and meet in a trie. Exact copies are one set from the start. No set, bucket or candidate is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import bit_table, drop_table, has_bit, keep, most_frequent, release
from preflens.llm.weighted import pack_texts
from preflens.llm.words import mix, row_slices, shingle_hashes, text_bytes, word_hashes

SIZE, PERCENT = 3, 90
#: Recurring shingles that get a rank at the end of the order; the others follow their hash. It shapes the work, not the result.
RANKED = 1 << 17
BLOCK_SETS, BLOCK_SHINGLES = 48, 400_000
HELD_SHINGLES = 4_000_000
SLICE_BYTES = 1 << 21
MARK_WORDS, WHOLE_WORDS = 4, 8  # 64-bit numbers that mark a prefix, and a whole set where rows of shingles meet
_TOP = np.uint64(1 << 63)


#: The rows of ``link`` with the default size and percent.
SQL = """
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS pos, len(words) AS n FROM texts
), runs AS (
  SELECT doc_id, n, pos, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, concat_ws(' ', a, b, c) AS shingle FROM runs WHERE pos <= n - 2 OR (n < 3 AND pos = 1)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), pairs AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sizes UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other
), tops AS (
  SELECT doc_id, min(other) AS top FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(t.top, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN tops t ON t.doc_id = d.doc_id
"""


# ---------------------------------------------------------------- ordered sets


def rank_table(ranked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Recurring shingles, given rarest first, in the order of their hash, and their ranks."""
    by_hash = np.argsort(ranked)
    return ranked[by_hash], by_hash


def ordered_sets(column: pa.Array, size: int, ranks: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, set elements of the rows in global order, offsets). ``ranks``: a ``rank_table``."""
    data, offsets = text_bytes(column)
    found, by_hash = ranks
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        words, at = word_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        shingles, at = shingle_hashes(words, at, size)
        keys = shingles >> np.uint64(1)
        if len(found) and len(keys):
            place = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            keys = np.where(found[place] == keys, _TOP | by_hash[place].astype(np.uint64), keys)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        order = np.lexsort((keys, row))
        keys, row = keys[order], row[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        yield lo, hi, keys[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=hi - lo))])


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that occur twice or more, rising, and how often. ``keys`` is sorted in place; little else is held."""
    keys.sort()
    edge = np.diff(keys[1:] == keys[:-1], prepend=False, append=False)
    at = np.flatnonzero(edge)  # first and last place of a run, in turn
    return keys[at[::2]], at[1::2] - at[::2] + 1


def recurring(df: DataFrame, text_col: str, size: int, limit: int = RANKED) -> np.ndarray:
    """The ``limit`` shingles in most texts among those that recur within a task, rarest first; all texts are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(HELD_SHINGLES, np.uint64), 0

        def found(keys):
            shingles, times = repeated(keys)
            return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(times)], names=["shingle", "n"])

        for batch in batches:
            for _, _, keys, _ in ordered_sets(batch.column(0), size, rank_table(np.zeros(0, np.uint64))):
                if n + len(keys) > len(held):
                    yield found(held[:n])
                    n = 0
                if len(keys) > len(held):  # one long text
                    yield found(keys)
                else:
                    held[n:n + len(keys)] = keys
                    n += len(keys)
        yield found(held[:n])

    counts = df.select(F.col(text_col).cast("string")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = most_frequent(counts, limit).orderBy("n", "shingle").toArrow()
    return top.column("shingle").to_numpy().view(np.uint64)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that a set of ``n`` needs with any partner."""
    return -(-percent * n // 100)


def parity_marks(keys: np.ndarray, cut: np.ndarray, words: int = MARK_WORDS) -> np.ndarray:
    """(rows, ``words``) numbers; a bit tells whether an odd count of the row's elements falls on it.

    Sets a and b share at most (|a| + |b| - d) / 2 elements if d bits of their marks differ.
    """
    rows, bits = len(cut) - 1, 64 * words
    at = np.repeat(np.arange(rows), np.diff(cut)) * bits + (mix(keys) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def set_marks(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of whole sets, one to two bits an element, and their offsets; a bit tells whether an odd count falls on it.

    Sizes are powers of two from 64 on, so the halves of a mark, xored, are the set's mark at half the size.
    """
    n = np.diff(at)
    bits = np.where(n > 0, np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)), 0)
    start = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(start[:-1], n) + (mix(keys) & np.repeat(np.maximum(bits, 1) - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=start[-1]) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64), start // 64


def with_sets(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, ranked) -> DataFrame:
    """(_id, _n, _key, _prefix, _marks, _whole, _wide): set size, digest of the set, the elements that any partner must share one of,
    their marks, marks of the whole set of fixed length and by its size."""

    def lists(marks):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * marks.shape[1]), pa.array(marks.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, keys, at in ordered_sets(batch.column(1), size, ranked.value):
                n = np.diff(at)
                length = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                cut = np.concatenate([[0], np.cumsum(length)])
                first = np.repeat(at[:-1] - cut[:-1], length) + np.arange(cut[-1])
                digests = [hashlib.blake2b(keys[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                prefix = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(keys[first].view(np.int64)))
                marks, whole = lists(parity_marks(keys[first], cut)), lists(parity_marks(keys, at, WHOLE_WORDS))
                wide, ends = set_marks(keys, at)
                wide = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(wide))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), prefix, marks, whole, wide],
                                                 names=["_id", "_n", "_key", "_prefix", "_marks", "_whole", "_wide"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, _n long, _key binary, _prefix array<long>, _marks array<long>, _whole array<long>, _wide array<long>")


# ---------------------------------------------------------------- the trie


class Trie:
    """Compressed trie of ordered sets: a branch holds the elements its sets share from a depth on."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.root = self.branch(order, 0)

    def branch(self, members: list[int], depth: int) -> tuple:
        """(elements, sets that end here, smaller branches, least size, longest rest below the elements)."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        n = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + (int(differ[0]) if len(differ) else n - depth)
        here, below, lo = [], [], 0
        while lo < len(members):
            s = self.sets[members[lo]]
            if len(s) == end:
                here.append(members[lo])
                lo += 1
                continue
            hi = lo + 1
            while hi < len(members) and self.sets[members[hi]][end] == s[end]:
                hi += 1
            below.append(self.branch(members[lo:hi], end))
            lo = hi
        sizes = [len(self.sets[m]) for m in members]
        return first[depth:end], here, below, min(sizes), max(sizes) - end

    def partners(self, x: np.ndarray, percent: int) -> list[int]:
        """Members whose Jaccard similarity with ``x`` is ``percent`` or more."""
        found = []
        stack = [(self.root, 0, 0)]  # (branch, place in x, overlap so far)
        while stack:
            (elements, here, below, least, rest), place, overlap = stack.pop()
            if len(elements):
                at = place + np.searchsorted(x[place:], elements)
                inside = at < len(x)
                overlap += int((x[at[inside]] == elements[inside]).sum())
                place = int(at[-1])
            needed = -(-percent * (len(x) + least) // (100 + percent))
            for member in here:
                if 100 * overlap >= percent * (len(x) + len(self.sets[member]) - overlap):
                    found.append(member)
            if below and overlap + min(len(x) - place, rest) >= needed:
                stack += [(b, place, overlap) for b in below]
        return found


def spanning_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the trie join of the sets connects: (node, smallest node)."""
    trie, top = Trie(sets), list(range(len(sets)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, x in enumerate(sets):
        for j in trie.partners(x, percent):
            a, b = find(i), find(j)
            if a != b:
                top[max(a, b, key=lambda k: nodes[k])] = min(a, b, key=lambda k: nodes[k])
    return [(nodes[i], nodes[find(i)]) for i in range(len(sets)) if nodes[find(i)] != nodes[i]]


# ---------------------------------------------------------------- Spark jobs


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int, ranked) -> DataFrame:
    """Links (a, b) found among candidate pairs (pivot, node, n), in blocks of bounded size that hold the pivot as well."""
    pairs = pairs.groupBy("pivot", "node").agg(F.max("n").alias("n"))
    sizes = pairs.groupBy("pivot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node")
    pivots = members.select("pivot", "block").distinct().withColumn("node", F.col("pivot"))
    wanted = members.unionByName(pivots)

    wanted = keep(wanted, "wanted")
    bits = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select("node").distinct(), "node"))

    @F.pandas_udf("boolean")
    def may_be_wanted(ids: pd.Series) -> pd.Series:
        return pd.Series(has_bit(bits.value, ids.to_numpy(np.int64).view(np.uint64)))

    # Texts that no pair needs stay where they are; others travel compressed, and become sets only where their block is joined.
    with_text = wanted.join(texts.filter(may_be_wanted("_id")), F.col("node") == F.col("_id")).select("pivot", "block", "node", "_text")
    packed = with_text.mapInArrow(pack_texts, "pivot long, block long, node long, _text binary")

    def join_block(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        column = pa.array([unpack(t).decode() for t in rows["_text"]], pa.large_string())
        sets = [keys[a:b] for _, _, keys, at in ordered_sets(column, size, ranked.value) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pd.DataFrame(spanning_links(rows["node"].tolist(), sets, percent), columns=["a", "b"], dtype=np.int64)

    return packed.groupBy("pivot", "block").applyInPandas(join_block, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the smallest node reachable. Labels spread and jump until none changes."""
    both = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).filter("u <> v").distinct(), "links")
    labels = keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        own = labels.select(F.col("node").alias("k"), F.col("label").alias("jump"))
        jumped = spread.join(own, spread.label == own.k).select("node", "old", F.least("label", "jump").alias("label"))
        step = keep(jumped, "labels")
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels


def may_link(pa_, na, pb, nb, percent: int):
    """Can two sets that share the element at these places reach the threshold?"""
    needed = F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1) >= needed)


def prefix_needed(na, nb, percent: int):
    """How many elements the prefixes of two linked sets share.

    Of the set whose prefix ends first, every prefix element that the other set holds is in the other's prefix too, so what
    is shared beyond the prefixes is at most the rest of that set.
    """
    rest = lambda n: F.ceil(percent * n / F.lit(100.0) - 1e-9) - 1
    return F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9) - F.greatest(rest(na), rest(nb))


def marks_allow(a, na, b, nb, percent: int):
    """Do the marks of two prefixes leave room for what linked sets share?"""
    length = lambda n: n - F.ceil(percent * n / F.lit(100.0) - 1e-9) + 1
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(MARK_WORDS)), F.lit(0))
    return length(na) + length(nb) - differ >= 2 * prefix_needed(na, nb, percent)


def whole_allow(a, na, b, nb, percent: int):
    """Do the marks of fixed length of two whole sets leave room for a link?"""
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(WHOLE_WORDS)), F.lit(0))
    return na + nb - differ >= 2 * F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)


def sets_allow(a, na, b, nb, percent: int):
    """Do the marks of two whole sets leave room for a link? The larger is halved once; sizes further apart rule nothing out."""
    xor = lambda x, y: x.bitwiseXOR(y)
    middle = lambda m: F.shiftright(F.size(m), 1)
    half = lambda m: F.zip_with(F.slice(m, F.lit(1), middle(m)), F.slice(m, middle(m) + 1, F.size(m)), xor)
    one = F.when(F.size(a) > F.size(b), half(a)).otherwise(a)
    two = F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    differ = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda total, d: total + d)
    needed = F.ceil(percent * (na + nb) / F.lit(100.0 + percent) - 1e-9)
    return (F.size(one) != F.size(two)) | (na + nb - differ >= 2 * needed)


def likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (pivot, node, n) whose marks (node, n, marks, wide) leave room for a link."""
    one, two = (marks.select(F.col("node").alias(c), *(F.col(m).alias(f"{m}{i}") for m in ("n", "marks", "wide"))) for i, c in enumerate(("pivot", "node")))
    both = pairs.select("pivot", "node").join(two, "node").join(one, "pivot")
    fits = [allow(F.col(f"{m}0"), F.col("n0"), F.col(f"{m}1"), F.col("n1"), percent) for m, allow in (("marks", marks_allow), ("wide", sets_allow))]
    return both.filter(fits[0] & fits[1]).select("pivot", "node", F.col("n1").alias("n"))


def one_pivot(star: DataFrame) -> DataFrame:
    """(pivot, node) of the pivot that a node of rows (pivot, node) meets under most shingles; of equals the smallest."""
    met = star.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy("node").agg(F.max_by("pivot", F.struct("times", -F.col("pivot"))).alias("pivot")).select("pivot", "node")


def shared_tokens(prefixes: DataFrame, bits) -> DataFrame:
    """(token, node, n, pos) of the elements of (node, n, prefix) whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            token = lists.flatten().to_numpy().view(np.uint64)
            n = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            found = np.flatnonzero(has_bit(bits.value, token))
            at = pa.array(row[found])
            yield pa.RecordBatch.from_arrays([pa.array(token[found].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos[found].astype(np.int32))],
                                             names=["token", "node", "n", "pos"])

    return prefixes.mapInArrow(run, "token long, node long, n long, pos int")


def link(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Two documents link when 100 * shared >= ``percent`` * united of their sets of ``size``-word shingles (A-Z lower-cased; fewer
    words are one shingle). The component id is the smallest id reachable over links, itself included. Null texts and texts
    without words have an empty set and link with nothing; a null id stays null and links with nothing; rows of equal id are
    one document; other columns are left aside.
    """
    spark = df.sparkSession
    ranked = spark.sparkContext.broadcast(rank_table(recurring(df, text_col, size)))  # RANKED numbers at most
    sets = keep(with_sets(df, id_col, text_col, size, percent, ranked), "sets")
    docs = keep(sets.select("_id", "_n", "_key"), "ids")
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_id is not null")
    classes = sets.filter("_id is not null and _n > 0").groupBy("_key").agg(F.min("_id").alias("node"), F.first("_n").alias("n"), F.first("_prefix").alias("prefix"), F.first("_marks").alias("marks"), F.first("_whole").alias("whole"), F.first("_wide").alias("wide"))
    full_classes = keep(classes, "classes")
    drop_table(spark, sets)
    classes = keep(full_classes.select("_key", "node"), "keys")
    marks = keep(full_classes.select("node", "n", "marks", "whole", "wide"), "marks")
    # A shared shingle of the prefixes brings documents together. Shingles are counted first, without their documents.
    twice = keep(full_classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("token"), "twice")
    tokens = shared_tokens(full_classes.select("node", "n", "prefix"), spark.sparkContext.broadcast(bit_table(twice, "token")))
    shared = tokens.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("first"), F.max("node").alias("last")).filter("first.node <> last")
    rows = keep(tokens.join(shared, "token").select("token", "node", "n", "pos", "first"), "shared")
    drop_table(spark, full_classes)
    drop_table(spark, twice)
    del tokens, shared, sets
    release(spark)

    def check(pairs: DataFrame) -> DataFrame:
        return verify(keep(pairs, "pairs"), texts, size, percent, ranked)

    # Rows of one id with different texts are one node.
    several = docs.filter("_id is not null and _n > 0").join(classes, "_key").groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("a", "b")
    star = rows.filter(F.col("node") != F.col("first.node")).filter(may_link(F.col("pos"), F.col("n"), F.col("first.pos"), F.col("first.n"), percent))
    star = one_pivot(star.select(F.col("first.node").alias("pivot"), "node"))
    links = keep(check(likely(star, marks, percent)).union(several), "links")
    release(spark)
    labels = components(links)

    def open_rows() -> DataFrame:
        """Rows of shingles whose documents are in several components yet."""
        now = rows.join(labels, "node", "left").select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
        left = now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
        return keep(now.join(left.select("token"), "token"), "open")

    # Another pivot, by hash, for each document of a group that is not connected yet.
    left = open_rows()
    if not left.isEmpty():
        by_hash = F.max_by(F.struct("node", "n", "pos", "label"), F.xxhash64("node", F.lit(1))).alias("p")
        pivots = left.groupBy("token").agg(by_hash)
        star = left.join(pivots, "token").filter(F.col("label") != F.col("p.label")).filter(may_link(F.col("pos"), F.col("n"), F.col("p.pos"), F.col("p.n"), percent))
        star = one_pivot(star.select(F.col("p.node").alias("pivot"), "node"))
        links = keep(links.union(check(likely(star, marks, percent))), "links")
        release(spark)
        labels = components(links)
        drop_table(spark, left)
        left = open_rows()
    # What is left: every pair across components that lengths, places and marks allow, and that meets under enough shingles.
    if not left.isEmpty():
        marked = left.join(marks.select("node", "marks", "whole"), "node")
        links = keep(links.union(check(likely(across(marked, percent), marks, percent))), "links")
        release(spark)
        labels = components(links)
    found = docs.join(classes, "_key", "left").join(labels, "node", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("label", "node", "_id"))
    return found.select(F.col("_id").cast(df.schema[id_col].dataType).alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"))


def across(rows: DataFrame, percent: int, block: int = 1_000) -> DataFrame:
    """Candidate pairs (pivot, node, n) of rows (token, node, n, pos, label, marks, whole) with different labels.

    A token's rows are cut into blocks, and each pair of blocks is a join key of its own, so a hot token is many small keys.
    Pairs that lengths, places or marks rule out do not leave the join, so those of a hot token that share only a few shingles
    are no rows; a pair that links passes under each shingle. Two sets of
    different labels meet under every shingle that their prefixes share, so the number of meetings is what the prefixes share.
    """
    blocks = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = rows.join(blocks, "token").withColumn("c", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    values = [F.col(c) for c in ("node", "n", "pos", "label", "marks", "whole")]
    # A pair of blocks i <= j: rows of block i on the left, rows of block j on the right.
    left = cut.select("token", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("blocks") - 1)).alias("j"), F.struct(*values).alias("a"))
    right = cut.select("token", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("i"), F.col("c").alias("j"), F.struct(*values).alias("b"))
    one, two = F.col("a"), F.col("b")
    fits = may_link(one["pos"], one["n"], two["pos"], two["n"], percent) & (one["label"] != two["label"])
    fits &= marks_allow(one["marks"], one["n"], two["marks"], two["n"], percent) & whole_allow(one["whole"], one["n"], two["whole"], two["n"], percent)
    pairs = left.join(right, ["token", "i", "j"]).filter(fits & ((F.col("i") < F.col("j")) | (one["node"] < two["node"])))
    met = pairs.groupBy(F.least(one["node"], two["node"]).alias("pivot"), F.greatest(one["node"], two["node"]).alias("node")).agg(
        F.count(F.lit(1)).alias("times"), F.max(F.greatest(one["n"], two["n"])).alias("n"), F.min(prefix_needed(one["n"], two["n"], percent)).alias("needed"))
    return met.filter(F.col("times") >= F.col("needed")).select("pivot", "node", "n")


def keep_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
) -> DataFrame:
    """Rows of ``df``, all columns, of the smallest id of each component (rows without words or id stay; repeated rows of one
    id count as one document and stay together)."""
    dropped = link(df, id_col, text_col, size, percent).filter(F.col("component_id") != F.col(id_col)).select(id_col).distinct()
    return df.join(dropped, id_col, "left_anti")
