"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words (A-Z lower-cased) as 64-bit hashes, weighted by their counts. For each of ``SAMPLES``
hash functions, gamma and uniform numbers mixed from the word's hash turn weights into sampling keys; the smallest key's (word,
level) is the sample. Two texts agree on a sample with the probability of their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger. The numbers are made once for each distinct word of a block of words.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.words import hash_spans, mix, row_slices, text_bytes, word_spans

SAMPLES = 64
SEED = 2024
SLICE_BYTES = 1 << 21
TERMS = 1 << 17  # terms whose distinct words are looked up at once
GATHER = 1 << 12  # terms whose keys are held at once
KEPT_WORDS = 1 << 16  # words whose keys a task remembers
TEXT_BYTES_PER_BUCKET = 4 << 20
MOST_BUCKETS = 10_000  # ranges; beyond 40 GB of text they grow, and tasks stream them


@functools.lru_cache(1)
def parameters(samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """Odd factors and offsets (2 x 2 x samples) of the hash functions."""
    draws = np.random.default_rng(seed).integers(0, 2**64, (2, 2, samples), dtype=np.uint64)
    draws[:, 0] |= np.uint64(1)
    return draws


def numbers(terms: np.ndarray, functions: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gamma(2, 1) numbers r, log of Gamma(2, 1) numbers c, uniform b for each word hash and sample; keys of weight 1."""
    x, y = (mix(terms[:, None] * factor + offset) for factor, offset in functions)
    uniform = lambda bits, shift: (((bits >> np.uint64(shift)) & np.uint64(0x7FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-23)
    r = -np.log(uniform(x, 40)) - np.log(uniform(x, 16))
    log_c = np.log(-np.log(uniform(y, 40)) - np.log(uniform(y, 16)))
    b = ((x & np.uint64(0xFFF)) << np.uint64(12) | y & np.uint64(0xFFF)).astype(np.float32) * np.float32(2**-24)
    return r, log_c, b, log_c - r * (1 - b)  # floor(0 / r + b) = 0


class Keys:
    """Keys of weight 1 of the words met lately. A memory of at most ``KEPT_WORDS`` words and those of one block: when it is full,
    the words of the block at hand stay, so frequent words are computed once. It changes no result."""

    def __init__(self, functions: np.ndarray):
        self.functions = functions
        self.words = np.zeros(0, np.uint64)
        self.table = np.zeros((0, functions.shape[2]), np.float32)

    def compute(self, words: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]), np.float32)
        for lo in range(0, len(words), 512):
            out[lo:lo + 512] = numbers(words[lo:lo + 512], self.functions)[3]
        return out

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A table of keys, and the place of each of the sorted distinct ``words`` in it."""
        at = np.searchsorted(self.words, words)
        known = np.zeros(len(words), bool)
        inside = at < len(self.words)
        known[inside] = self.words[at[inside]] == words[inside]
        new = np.flatnonzero(~known)
        keys = self.compute(words[new])
        if len(self.words) + len(new) > KEPT_WORDS:
            table = np.empty((len(words), keys.shape[1]), np.float32)
            table[known], table[new] = self.table[at[known]], keys
            self.words, self.table = words, table
        elif len(new):
            self.words, self.table = np.insert(self.words, at[new], words[new]), np.insert(self.table, at[new], keys, axis=0)
        return self.table, np.searchsorted(self.words, words)


def weighted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, weight) of the texts, ordered by row and hash."""
    starts, ends = word_spans(data, offsets)
    row, term = np.searchsorted(offsets, starts, "right") - 1, hash_spans(data, starts, ends)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else order
    return row[heads], term[heads], np.diff(np.append(heads, len(row)))


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES, memory: Keys | None = None) -> np.ndarray:
    """16-bit digest of the sample (term, level) for each row and hash function; 0 for a text without words."""
    functions = parameters(samples)
    memory = memory or Keys(functions)
    n = len(offsets) - 1
    best = np.full((n, samples), np.inf, np.float32)
    out = np.zeros((n, samples), np.uint16)
    row, term, weight = weighted_terms(data, offsets)
    for start in range(0, len(row), TERMS):
        block = slice(start, start + TERMS)
        words, terms = np.unique(term[block], return_inverse=True)
        table, place = memory.rows(words)
        place = place[terms]
        again, repeated = np.unique(terms[weight[block] > 1], return_inverse=True)
        r, log_c, b, _ = numbers(words[again], functions)
        many = np.flatnonzero(weight[block] > 1)
        for lo in range(0, len(terms), GATHER):
            hi = min(len(terms), lo + GATHER)
            rows = row[start + lo:start + hi]
            keys = table[place[lo:hi]]
            level = np.zeros(keys.shape, np.float32)
            first, last = np.searchsorted(many, [lo, hi])
            if last > first:
                at, which = many[first:last], repeated[first:last]
                rr, bb = r[which], b[which]
                level[at - lo] = np.floor(np.log(weight[start + at]).astype(np.float32)[:, None] / rr + bb)
                keys[at - lo] = log_c[which] - rr * (level[at - lo] - bb + 1)  # log of c / (y exp(r)), y = exp(r (level - b))
            heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            least = np.minimum.reduceat(keys, heads, axis=0)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(rows))))
            at, sample = np.nonzero(keys == least[group])
            digest = mix(term[start + lo + at] + np.uint64(0x9E3779B97F4A7C15) * (level[at, sample].astype(np.int64) + 1024).astype(np.uint64)) >> np.uint64(48)
            at, sample, digest = at[::-1], sample[::-1], digest[::-1]  # of equal keys the first term stays
            found = np.zeros(least.shape, np.uint16)
            found[group[at], sample] = digest
            owners = rows[heads]
            better = least < best[owners]
            best[owners] = np.where(better, least, best[owners])
            out[owners] = np.where(better, found, out[owners])
    return out


def sign(texts: list[str], memory: Keys | None = None) -> np.ndarray:
    memory = memory or Keys(parameters())
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    parts = [signatures(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], memory=memory) for lo, hi in row_slices(offsets, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: estimates the generalised Jaccard similarity (two empty texts: 1)."""
    return (a == b).mean(1)


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row: 4 hex digits a sample. Null counts as empty; equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Keys(parameters())
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                rows = signatures(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], memory=memory)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(as_text(rows))], names=[id_col, "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


# ---------------------------------------------------------------- each document and its neighbour


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compress the last column: it is all that the shuffle moves."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack(t.as_py().encode()) for t in batch.column(batch.num_columns - 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)


def hash_parts(n: int, last: bool = False) -> np.ndarray:
    """``n`` limits that part the signed 64-bit numbers evenly, and the highest number if ``last``."""
    return np.array([(i << 64) // (n + 1) - (1 << 63) for i in range(1, n + 1)] + [(1 << 63) - 1] * last, np.int64)


def with_neighbours(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """Rows (_bucket, _guest, _id, _h, _text), texts compressed, dealt into id ranges and sorted by descending id in each.

    A range also gets, as a guest, the first row of the next lower range (the lowest range: the very first row), so that every
    row finds its neighbour in its own range. One shuffle of the texts; the range limits are quantiles of the ids, and equal
    parts of the hashes of the texts for null ids and for an id that is several quantiles.
    """
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    points = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("_id", points, 10 * buckets) if points else F.lit(None), F.count(F.lit(1)), F.count("_id")).first()
    ids, times = np.unique(np.array(found[0] or [], np.int64), return_counts=True)
    # A row is over a limit if its (id, hash) is greater; the last limit of an id is over all its rows.
    parts = [hash_parts(int(n) if n > 1 else 0, last=True) for n in times]
    limit_ids, limit_hashes = np.repeat(ids, [len(p) for p in parts]), np.concatenate([np.zeros(0, np.int64), *parts])
    null_hashes = hash_parts((found[1] - found[2]) * buckets // max(1, found[1]))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, is_known: pd.Series, hashes: pd.Series) -> pd.Series:
        key, known, h = ids.to_numpy(np.int64), is_known.to_numpy(bool), hashes.to_numpy(np.int64)
        at, until = np.searchsorted(limit_ids, key), np.searchsorted(limit_ids, key, "right")
        for i in np.unique(at[until - at > 1]):
            rows = np.flatnonzero((at == i) & (until - at > 1))
            at[rows] = i + np.searchsorted(limit_hashes[i:until[rows[0]]], h[rows])
        return pd.Series(np.where(known, len(limit_ids) - at, len(limit_ids) + 1 + len(null_hashes) - np.searchsorted(null_hashes, h)))

    # Ranges are numbered from the highest ids on; null ids come last.
    rows = rows.withColumn("_bucket", range_of(F.coalesce("_id", F.lit(0)), F.col("_id").isNotNull(), F.xxhash64("_text")))
    order = F.struct(F.col("_id").isNotNull().alias("known"), "_id", F.xxhash64("_text").alias("h"))
    heads = sorted((r["_bucket"], r["head"]) for r in rows.groupBy("_bucket").agg(F.max(order).alias("head")).collect())  # a row per range
    if not heads:
        return rows.select("_bucket", "_id", F.lit(None).cast("binary").alias("_text"))
    previous = [(heads[i][1], heads[i - 1][0]) for i in range(len(heads))]  # the first range's head is the last one's guest
    key = F.struct("_id", F.xxhash64("_text").alias("h"))
    guests = df.sparkSession.createDataFrame([(h["_id"], h["h"], b) for h, b in previous], "_gid long, _gh long, _to int")
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (key["h"] == F.col("_gh"))
    # At most one guest for each range: a broadcast of `buckets` rows. Repeated rows send one copy.
    sent = rows.join(F.broadcast(guests), same).groupBy("_to", "_id").agg(F.first("_text").alias("_text"))
    sent = sent.select(F.col("_to").alias("_bucket"), F.lit(True).alias("_guest"), "_id", "_text")
    both = rows.select("_bucket", F.lit(False).alias("_guest"), "_id", "_text").unionByName(sent)
    packed = both.select("_bucket", "_guest", "_id", F.xxhash64("_text").alias("_h"), "_text").mapInArrow(pack_texts, "_bucket int, _guest boolean, _id long, _h long, _text binary")
    return packed.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "_guest", F.desc_nulls_last("_id"), F.desc("_h"))


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the last half of its code points (rounded down) replaced by as many first ones (or all) of the next
    document in descending id order; the last document's next is the first. Returns id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty, null ids come last, rows of equal id follow the
    hash of their text, one row alone is its own next, other columns are left aside.
    """
    if buckets is None:
        size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(1, int(size // TEXT_BYTES_PER_BUCKET)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Keys(parameters())
        waiting: list[tuple[int, int | None, str]] = []  # rows of the open range whose next is not seen yet, or not signed

        def flush(rows):
            """All but the last row have their next behind them."""
            texts = [r[2] for r in rows]
            edited = []
            for text, after in zip(texts, texts[1:], strict=False):
                half = len(text) // 2
                edited.append(text[:len(text) - half] + after[:half])
            # A text and its edited text lie side by side: their words are looked up together.
            signed = sign([t for pair in zip(texts, [*edited, ""], strict=True) for t in pair], memory)
            own, changed = signed[::2], signed[1:-1:2]
            return pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(as_text(own[:-1]), pa.string()),
                pa.array(as_text(changed), pa.string()), pa.array(likeness(own[:-1], changed)), pa.array(likeness(own[:-1], own[1:])),
            ], names=names)

        unpack, size = zstandard.ZstdDecompressor().decompress, 0
        for batch in batches:
            for bucket, key, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(packed).decode()
                if waiting and waiting[-1][0] != bucket:
                    if len(waiting) > 1:
                        yield flush(waiting)
                    waiting, size = [], 0
                waiting.append((bucket, key, text))
                size += len(text)
                if size > SLICE_BYTES and len(waiting) > 1:
                    yield flush(waiting)
                    waiting, size = waiting[-1:], len(text)
        if len(waiting) > 1:
            yield flush(waiting)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(df, id_col, text_col, buckets).select("_bucket", "_id", "_text").mapInArrow(run, schema)
