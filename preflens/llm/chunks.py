"""Substring deduplication with content-defined chunks.

A gear rolling hash over the last 16 bytes marks boundaries; a chunk ends with the word in which a mark falls, so chunks hold
whole words and depend on nearby text only: an insertion moves no boundary beyond it. Where marks are far apart, as in passages
of a short period, words of locally least hash end chunks too, and no chunk has over ``MOST_WORDS`` words. From and up to each chunk there is a run,
the fewest consecutive chunks that have ``min_words`` words; runs are compared by digest over the whole corpus. A run whose digest occurs
earlier, by document id and place, is a copy of that one passage and is taken out of the text. Shorter agreements, such as
common phrases, stay, also where they follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import drop_table, keep, release
from preflens.llm.words import _power, hash_spans, mix, row_slices, text_bytes, word_spans

WINDOW = 16
MARK_EVERY = 24  # bytes between marks, on average
MIN_WORDS = 16
MOST_WORDS = 12  # a longer chunk is cut at words of least hash, and after so many words at the latest
NEAR = 3  # words on each side that the hash of such a word is compared with
MOST_BITS = 1 << 28
SLICE_BYTES = 1 << 21
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gear_marks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the gear hash of the 16 bytes up to each byte is a mark; a row sees nothing of the row before it."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    at = np.arange(len(data)) + WINDOW * (row + 1)
    h = np.zeros(len(data) + WINDOW * (rows + 1), np.uint64)
    h[at] = _GEAR[data]
    step = 1
    while step < WINDOW:  # h = h * 2 + gear, as sums over windows of 2, 4, 8, 16 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint64(step))
        step *= 2
    return mix(h[at]) < np.uint64(2**64 // MARK_EVERY)


def least_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Whether no word of the same row has a lesser hash within ``NEAR`` words; of equal words in a row only the first."""
    at = np.arange(len(hashes)) + NEAR * (row + 1)
    h = np.full(len(hashes) + NEAR * (rows + 1), np.uint64(2**64 - 1))
    h[at] = hashes
    out = h[at - 1] != hashes
    for step in range(1, NEAR + 1):
        out &= (hashes <= h[at - step]) & (hashes <= h[at + step])
    return out


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words) of every chunk, and the chunk offsets of the rows."""
    starts, ends = word_spans(data, offsets)
    if not len(starts):
        return starts, ends, starts, np.zeros(len(offsets), np.int64)
    marks = np.concatenate([[0], np.cumsum(gear_marks(data, offsets))])
    row = np.searchsorted(offsets, starts, "right") - 1
    closes = marks[ends] > marks[starts]
    closes[:-1] |= row[1:] != row[:-1]
    closes[-1] = True
    for limit in ("least", "most"):
        last = np.flatnonzero(closes)
        words = np.diff(last, prepend=-1)
        if (words <= MOST_WORDS).all():
            break
        far = np.repeat(words > MOST_WORDS, words)
        if limit == "least":
            closes |= far & least_words(hash_spans(data, starts, ends, lower=False), row, len(offsets) - 1)
        else:
            place = np.arange(len(starts)) - np.repeat(last - words + 1, words)
            closes |= far & (place % MOST_WORDS == MOST_WORDS - 1)
    last = np.flatnonzero(closes)
    first = np.concatenate([[0], last[:-1] + 1])
    return starts[first], ends[last], last - first + 1, np.searchsorted(starts[first], offsets)


def run_spans(words: np.ndarray, cut: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and end (exclusive) of the shortest runs of ``min_words`` words: one from each chunk on, and one up to each
    chunk at which none of these ends. Runs of equal chunks lie inside one passage, and together they cover it."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = np.diff(cut)
    ends = np.searchsorted(total, total[:-1] + min_words)
    first = np.flatnonzero(ends <= np.repeat(cut[1:], n))
    ends = ends[first]
    ended = np.zeros(len(total), bool)
    ended[ends] = True
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    more = np.flatnonzero((back >= np.repeat(cut[:-1], n)) & ~ended[1:])
    first, ends = np.append(first, back[more]), np.append(ends, more + 1)
    order = np.lexsort((ends, first))
    return first[order], ends[order]


def run_digests(digests: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of each sequence of chunk digests; the space between chunks does not count."""
    up, down = _power(len(digests) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests * up[:len(digests)], dtype=np.uint64)])
    return mix((sums[ends] - sums[first]) * down[first] + (ends - first).astype(np.uint64))


def run_rows(df: DataFrame, min_words: int = MIN_WORDS, bits: np.ndarray | None = None) -> DataFrame:
    """(digest, _none, _id, _h, idx) of every run of rows (_none, _id, _h, _text); with ``bits``, of those whose bit is set."""
    shared = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for lo, hi in row_slices(offsets, SLICE_BYTES):
                part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                starts, ends, words, cut = chunk_spans(part, at)
                first, until = run_spans(words, cut, min_words)
                digest = run_digests(hash_spans(part, starts, ends, lower=False), first, until)
                runs = np.searchsorted(first, cut)
                n = np.diff(runs)
                row, idx = np.repeat(np.arange(lo, hi), n), np.arange(len(first)) - np.repeat(runs[:-1], n)
                if shared is not None:
                    at = digest & np.uint64(64 * len(shared.value) - 1)
                    found = np.flatnonzero(shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    digest, row, idx = digest[found], row[found], idx[found]
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(digest.view(np.int64)), *(batch.column(i).take(row) for i in range(3)), pa.array(idx.astype(np.int32)),
                ], names=["digest", "_none", "_id", "_h", "idx"])

    return df.mapInArrow(run, "digest long, _none boolean, _id long, _h long, idx int")


def repeated_runs(df: DataFrame, min_words: int) -> DataFrame:
    """(digest, _none, _id, _h, idx) of every run whose digest occurs twice, and of a few others.

    Digests are counted first, without their places. A bit for each repeated one, in a table of ``MOST_BITS`` at most, lets the
    tasks leave out the rows of other digests; one that shares its bit passes, so no repeated run is lost.
    """
    spark = df.sparkSession
    twice = keep(run_rows(df, min_words).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "repeated-runs")
    size = min(MOST_BITS, max(1 << 16, 1 << (16 * twice.count()).bit_length()))
    at = F.col("digest").bitwiseAND(F.lit(size - 1))
    words = twice.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(digest & 63 as int))")).alias("bits")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    found = keep(run_rows(df, min_words, bits), "runs")
    drop_table(spark, twice)
    release(spark)
    return found


def copies(rows: DataFrame) -> DataFrame:
    """(_none, _id, _h, _copies): places of the runs whose digest occurs earlier, for each text that has such runs.

    The first occurrence of a digest is combined before the shuffle; the join back splits hot digests.
    """
    place = F.struct("_none", "_id", "_h", "idx")
    first = rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "first")
    found = rows.join(first, F.col("digest") == F.col("same"))
    return found.filter(F.col("first") != place).groupBy("_none", "_id", "_h").agg(F.collect_set("idx").alias("_copies"))  # a text's own runs at most


def removed_spans(text: bytes, marked: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Byte ranges to take out: the union of the marked runs, up to the chunk that follows."""
    data = np.frombuffer(text, np.uint8)
    starts, _, words, cut = chunk_spans(data, np.array([0, len(data)]))
    first, ends = run_spans(words, cut, min_words)
    open_runs = np.zeros(len(starts) + 1, np.int64)
    np.add.at(open_runs, first[marked], 1)
    np.add.at(open_runs, ends[marked], -1)
    copy = np.append(False, np.cumsum(open_runs) > 0)
    edge = np.flatnonzero(copy[1:] != copy[:-1])
    bounds = np.append(starts, len(data))
    return [(int(bounds[a]), int(bounds[b])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dedupe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``df`` with the repeated passages taken out of the text, and the array ``removed`` of their byte
    ranges (start, end) in the old text.

    The first occurrence, by id (null last), stays. Null and empty texts stay as they are; very long texts are cut like others; rows
    equal in id and text are one document, so are rows without id whose texts are equal; a text that is all copies becomes empty.
    Ids must be whole numbers (they are cast to long). Other columns stay whatever their names; if the table has a column
    ``removed``, the ranges are in ``removed_``.
    """
    text = F.col(f"`{text_col}`").cast("string")
    # Rows without id are told apart by two hashes of their text.
    known = F.col(f"`{id_col}`").cast("long")
    none, key, h, marks, key2, h2, none2, spans_col = free_names(df, "_none", "_id", "_h", "_copies", "_id2", "_h2", "_none2", "removed")
    keyed = df.withColumns({none: known.isNull(), key: F.coalesce(known, F.xxhash64(F.lit(1), text)), h: F.xxhash64(text)})
    rows = keyed.filter(text.isNotNull()).select(F.col(none).alias("_none"), F.col(key).alias("_id"), F.col(h).alias("_h"), text.alias("_text"))
    dups = copies(repeated_runs(rows, min_words))
    dups = dups.select(F.col("_none").alias(none2), F.col("_id").alias(key2), F.col("_h").alias(h2), F.col("_copies").alias(marks))
    same = (F.col(none) == F.col(none2)) & (F.col(key) == F.col(key2)) & (F.col(h) == F.col(h2))
    joined = keyed.join(dups, same, "left").select(*[f"`{c}`" for c in df.columns], marks)
    names = joined.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at), [[] for _ in range(batch.num_rows)]
            marked = np.flatnonzero(batch.column(len(names) - 1).is_valid())
            if len(marked):
                new = texts.to_pylist()
                for i in marked.tolist():
                    raw = new[i].encode()
                    spans[i] = removed_spans(raw, np.asarray(batch.column(len(names) - 1)[i].as_py()), min_words)
                    if spans[i]:
                        keep_from = [0, *(b for _, b in spans[i])]
                        keep_to = [*(a for a, _ in spans[i]), len(raw)]
                        new[i] = b"".join(raw[a:b] for a, b in zip(keep_from, keep_to, strict=True)).decode()
                texts = pa.array(new, texts.type)
            pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [texts if i == at else batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pairs], names=[*names[:-1], spans_col])

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.withColumn(text_col, text).schema)
    return joined.withColumn(text_col, text).mapInArrow(run, f"{base}, {spans_col} array<struct<start:bigint,end:bigint>>")
