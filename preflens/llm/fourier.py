"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. Each task sums its normal equations, Spark adds them
up, and the driver solves a system whose size is the number of features. Scores are calibrated by pooling adjacent violators
over a fixed grid of score buckets. All labelled training rows take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import keep
from preflens.llm.words import hash_spans, mix, row_slices, text_bytes, word_spans

WAVES = 192
RIDGE = 1e-3
BUCKETS = 2_000
THRESHOLD = 0.3
SEED = 11
SLICE_BYTES = 1 << 21
STATISTICS = ("log_words", "word_length", "word_length_spread", "distinct", "distinct_pairs", "repeats", "upper", "digits", "symbols", "shouts", "stops", "lines", "beyond_ascii", "longest")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CLASSES = {"digits": _class(b"0123456789"), "symbols": _class(b"#*$%&|<>"), "shouts": _class(b"!"), "stops": _class(b".,;:?"), "lines": _class(b"\n")}


def statistics(column: pa.Array) -> np.ndarray:
    """Row per text, column per entry of ``STATISTICS``; zeros for a null or empty text. Whole texts are read."""
    data, offsets = text_bytes(column)
    out = []
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        n = hi - lo
        byte_row = np.repeat(np.arange(n), np.diff(at))
        count = lambda mask, row=byte_row: np.bincount(row, mask, n)
        starts, ends = word_spans(part, at)
        hashes = hash_spans(part, starts, ends, lower=False)
        row = np.searchsorted(at, starts, "right") - 1
        words = np.bincount(row, minlength=n)
        length = (ends - starts).astype(float)
        some, size = np.maximum(words, 1), np.maximum(np.diff(at), 1)
        mean = np.bincount(row, length, n) / some
        spread = np.sqrt(np.maximum(0, np.bincount(row, length**2, n) / some - mean**2))
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)

        def distinct(keys, rows):
            order = np.lexsort((keys, rows))
            k, r = keys[order], rows[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
            return np.bincount(r[new], minlength=n)

        same = row[1:] == row[:-1]
        pairs = mix(hashes[:-1] + mix(hashes[1:]))[same]
        n_pairs = np.maximum(words - 1, 1)
        # Latin capitals: A-Z, and the second byte of À-Þ.
        capital = (part >= 65) & (part <= 90)
        capital[1:] |= (part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E)
        shares = {k: count(table[part]) / size for k, table in _CLASSES.items()}
        out.append(np.stack([
            np.log1p(words), mean, spread, distinct(hashes, row) / some, distinct(pairs, row[1:][same]) / n_pairs,
            np.bincount(row[1:][same], hashes[1:][same] == hashes[:-1][same], n) / n_pairs,
            count(capital) / size, shares["digits"], shares["symbols"], shares["shouts"], shares["stops"], shares["lines"],
            count(part >= 128) / size, np.log1p(longest),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def with_vector(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)], names=[id_col, "x"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    seed: int = SEED
    waves: int = WAVES

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos features of the standardised statistics (bounded to 4 deviations), and a constant."""
        rng = np.random.default_rng(self.seed)
        width = x.shape[1]
        frequency = rng.normal(0, 1 / np.sqrt(width), (width, self.waves))
        phase = rng.uniform(0, 2 * np.pi, self.waves)
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / self.waves) * np.cos(z @ frequency + phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def isotonic(values: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (value, mean label), never falling."""
    blocks: list[list[float]] = []
    for v, s, n in zip(values.tolist(), ones.tolist(), counts.tolist(), strict=True):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, v = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], v]
    x = [v for b in blocks for v in (b[2], b[3])]
    y = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(x), np.array(y)


def fit(rows: DataFrame) -> Model | None:
    """Model of ``_y`` (0 or 1) from rows with ``x``; None without rows."""
    width = len(STATISTICS)
    stats = rows.select(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(width) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not stats["n"]:
        return None
    scale = np.array([stats[f"s{i}"] for i in range(width)])
    model = Model(np.array([stats[f"m{i}"] for i in range(width)]), np.where(scale > 1e-9, scale, 1))
    size = model.waves + 1
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.features(vectors(batch.column(0)))
            gram += z.T @ z
            moment += z.T @ np.asarray(batch.column(1), float)
        cells = np.concatenate([gram[upper], moment])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "v"])

    added = rows.select("x", F.col("_y").cast("double")).mapInArrow(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    cells = np.zeros(len(upper[0]) + size)
    cells[added.column("cell").to_numpy()] = added.column("v").to_numpy()
    gram = np.zeros((size, size))
    gram[upper] = cells[:len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    penalty = np.full(size, RIDGE * stats["n"] / size)
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(gram + np.diag(penalty + 1e-9), cells[len(upper[0]):])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, counts = np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            k = np.clip((model.raw(vectors(batch.column(0))) + 0.5) * BUCKETS / 2, 0, BUCKETS - 1).astype(int)
            ones += np.bincount(k, np.asarray(batch.column(1), float), BUCKETS)
            counts += np.bincount(k, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ones[at]), pa.array(counts[at])], names=["k", "ones", "n"])

    table = rows.select("x", F.col("_y").cast("double")).mapInArrow(buckets, "k int, ones double, n long").groupBy("k").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n")).orderBy("k").toArrow()
    centre = (table.column("k").to_numpy() + 0.5) * 2 / BUCKETS - 0.5
    model.knots = isotonic(centre, table.column("ones").to_numpy(), table.column("n").to_numpy())
    return model


def train(vectors_of: DataFrame, labels: DataFrame, chosen=None, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """Fit on the rows of (id, x) that have a label and meet ``chosen``; a row with both labels counts as 0."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("_y"))
    rows = vectors_of if chosen is None else vectors_of.filter(chosen)
    return fit(keep(rows.select(id_col, "x").join(known, id_col).select("x", "_y"), "labelled"))


def score_vectors(vectors_of: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of rows (id, x); 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=[id_col, "score"])

    kind = vectors_of.schema[id_col].dataType.simpleString()
    return vectors_of.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, score double")


def held_out_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row; rows whose id's crc32 modulo 5 is 0 do not teach (a null id does not either).

    Null and empty texts have a score too; repeated rows stay; other columns are left aside; without labels all scores are 0.5.
    """
    out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    table = keep(with_vector(df, id_col, text_col), "vectors")
    scored = score_vectors(table, train(table, labels, ~out, id_col), id_col)
    return scored.select(id_col, F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``df``, all columns, with a score of ``threshold`` or more; all labelled rows teach.

    Null texts score as empty ones; long texts are read whole; repeated rows and null ids stay or go by their text. Where no
    model can be learned all rows stay.
    """
    known = labels.select(id_col).distinct()
    model = train(with_vector(df.join(known, id_col, "left_semi"), id_col, text_col), labels, None, id_col)
    return filter_scored(df, model, text_col, threshold)


def filter_scored(df: DataFrame, model: Model | None, text_col: str, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            yield batch if model is None else batch.filter(pa.array(model.score(statistics(batch.column(at))) >= threshold))

    names = df.columns
    return df.mapInArrow(run, df.schema)
