"""Best-fit packing by large-item matching: token pieces into sequences of a fixed capacity.

Documents over a third of the capacity are matched greedily, two to a sequence at most; smaller ones go, longest first, to
the tightest gap that holds them. Sequences depend on lengths only, so the driver plans on the histogram of lengths (at most
``capacity`` numbers, whatever the corpus) and gets, for each length, ranges of ranks with the sequences they fill. Spark
ranks the pieces inside each length, hot lengths in parts, and looks the rank up.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preflens.llm.store import keep

CAPACITY = 2048
ROWS_PER_RANK_TASK = 200_000
CACHE_WORDS = 250_000
_RUN = re.compile(r"\s \s")


@functools.lru_cache(2)
def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, as character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids, as little-endian 32-bit numbers, of the text " " + word; filled on demand, emptied at a bound."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.plain(" " + word)
        return ids

    def plain(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """White space and what follows it is encoded apart from the rest, so words can be looked up one by one.

        Only a run of white space with a space inside must stay whole; such texts are encoded in one piece.
        """
        if _RUN.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))

    def ids(self, text: str) -> bytes:
        if self.splitter is None or not self.splitter.search(text):
            return self.part(text)
        return b"".join(self.special.get(p) or self.part(p) for p in self.splitter.split(text) if p)


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. A text's ids end with ``end_id``; null counts as empty.

    Only a text of more than ``capacity`` ids is cut; all its pieces but the first are full.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n - capacity * ((n - 1) // capacity), n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(memoryview(ids)[4 * a:4 * b]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces per sequence, offset) from the histogram of lengths.

    The piece of rank r goes to sequence first + (r - first rank) // per at offset + ((r - first rank) % per) * length.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> (first sequence, number of sequences)
    open_gaps: list[int] = []
    sequences = 0

    def put(length, pieces, sequence, per, offset):
        slots.append((length, taken[length], taken[length] + pieces, sequence, per, offset))
        taken[length] += pieces

    def leave(gap, sequence, n):
        if gap and n:
            if gap not in gaps:
                bisect.insort(open_gaps, gap)
            gaps.setdefault(gap, []).append((sequence, n))

    large = sorted(x for x in counts if 3 * x > capacity and counts[x])
    left = {x: counts[x] for x in large}
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at else None
        if b is None:
            n = left[a]
            put(a, n, sequences, 1, 0)
        elif b == a:
            n = left[a] // 2
            put(a, 2 * n, sequences, 2, 0)
            left[a] -= n
        else:
            n = min(left[a], left[b])
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
            left[b] -= n
        left[a] -= n
        leave(capacity - a - (b or 0), sequences, n)
        sequences += n
        large = [x for x in large if left[x]] if not left[a] or (b and not left[b]) else large

    for s in sorted((x for x in counts if 3 * x <= capacity and counts[x]), reverse=True):
        c = counts[s]
        while c:
            at = bisect.bisect_left(open_gaps, s)
            if at == len(open_gaps):
                n = -(-c // (capacity // s))
                leave(capacity, sequences, n)
                sequences += n
                continue
            gap = open_gaps[at]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            per = gap // s
            full = min(n, c // per)
            if full:
                put(s, full * per, sequence, per, capacity - gap)
                leave(gap - per * s, sequence, full)
                c -= full * per
            if full < n:
                if c:  # fewer than per are left
                    put(s, c, sequence + full, c, capacity - gap)
                    leave(gap - c * s, sequence + full, 1)
                    leave(gap, sequence + full + 1, n - full - 1)
                    c = 0
                else:
                    leave(gap, sequence + full, n - full)
    return slots


def rank_in_length(pieces: DataFrame, counts: DataFrame, order: list[str], rows: int = ROWS_PER_RANK_TASK) -> DataFrame:
    """0-based ``_rank`` of each piece among those of its length; a length with more than ``rows`` pieces is ranked in parts."""
    parts = F.broadcast(counts.select("length", F.ceil(F.col("count") / rows).alias("_parts")))  # at most `capacity` rows
    cut = pieces.join(parts, "length").withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts"))).drop("_parts")
    sizes = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    # At most capacity + rows / ROWS_PER_RANK_TASK entries.
    return ranked.join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_part", "_before")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all texts with their sequence_id and their offset in it.

    Other columns of ``df`` are left aside. Null and empty texts are pieces of one token; repeated rows (and null ids) are
    packed each on its own; an empty table gives an empty table.
    """
    spark = df.sparkSession
    pieces = keep(token_pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    counts = pieces.groupBy("length").count()
    slots = plan_sequences({r["length"]: r["count"] for r in counts.collect()}, capacity)
    slot_table = spark.createDataFrame(
        slots, "length long, _from long, _to long, _sequence long, _per long, _offset long"
    )  # a few slots for each possible length: bounded by the capacity
    ranked = rank_in_length(pieces, counts, [id_col, "piece", "ids_crc32"])
    placed = ranked.join(F.broadcast(slot_table), "length").filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_per") * F.col("length")).cast("long").alias("offset"),
    )
