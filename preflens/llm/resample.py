"""Importance resampling towards a target text collection, on hashed n-gram features.

Arrow kernels make the features: texts are lower-cased and split, the words are dictionary-encoded, an n-gram is the number of its
first words beside the shifted number of its last one, and only distinct n-grams are hashed. A bucket's gain is the logarithm of
its smoothed share in the target over that in the source; a document's weight is the mean gain of its features. Gumbel noise from
a hash of the id turns the weights into a draw without replacement.

Null text and text without words: no features, weight 0, never drawn. Null id: hashed like an empty one and last among ties.
Repeated rows are rows of their own. Long texts are hashed whole, about 4 MB at a time. Empty tables give empty results; columns
other than the id and the text are left aside, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preflens.llm.store import keep
from preflens.llm.words import row_slices, text_bytes

#: Fixed values of the contract: feature buckets, n-gram length, words a drawable document needs, percent drawn, seed of the noise.
BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_buckets(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``longest``: row and bucket of every n-gram of the texts, rows ascending."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_BETWEEN_WORDS)
    words, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(real).dictionary_encode()
    rows = rows.filter(real).to_numpy(zero_copy_only=False)
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [b" " + w for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    crc = np.array([zlib.crc32(w[1:]) for w in spelled], np.int64)  # of each distinct n-gram
    number = word
    yield rows, (crc % buckets)[number]
    for n in range(2, longest + 1):
        if len(word) < n:
            return
        inside = np.flatnonzero(rows[n - 1:] == rows[:len(rows) - n + 1])
        if n == 2:
            before = number
        else:
            before = np.full(len(word), -1, np.int64)
            before[at] = number
        at = inside
        distinct = pa.array(before[at] * len(spelled) + word[at + n - 1]).dictionary_encode()
        number = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, last = np.divmod(distinct.dictionary.to_numpy(zero_copy_only=False), max(1, len(spelled)))
        crc = np.array([zlib.crc32(spelled[w], c) for c, w in zip(crc[start].tolist(), last.tolist())], np.int64)
        yield rows[at], (crc % buckets)[number]


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    column = column.cast(pa.large_string())
    for lo, hi in row_slices(text_bytes(column)[1]):
        yield column.slice(lo, hi - lo)


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket; a task sends one row a bucket at most."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                for _, found in ngram_buckets(texts, longest, buckets):
                    n += np.bincount(found, minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(n[hit], pa.int64())], ["bucket", "n"])

    some = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return some.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) in thousandths of a nat, from two tables of counts."""
    both = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    both = both.na.fill(0, ["s", "t"])
    size = [F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0)) + buckets for counts in (source, target)]
    ratio = ((F.col("t") + 1).cast("double") * size[0]) / ((F.col("s") + 1).cast("double") * size[1])
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def document_weights(docs: DataFrame, gains: np.ndarray, doc_id="doc_id", text="text", longest=LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight): floored mean gain of each document's features."""
    kind = docs.schema[doc_id].dataType

    def weigh(batches):
        for batch in batches:
            words, features, total = [], [], []
            for texts in _slices(batch.column(1)):
                n = np.zeros((longest, len(texts)), np.int64)
                total.append(np.zeros(len(texts), np.int64))
                for k, (rows, found) in enumerate(ngram_buckets(texts, longest, len(gains))):
                    sums = np.concatenate([[0], np.cumsum(gains.take(found))])
                    edges = np.searchsorted(rows, np.arange(len(texts) + 1))
                    n[k] = np.diff(edges)
                    total[-1] += np.diff(sums[edges])
                words.append(n[0])
                features.append(n.sum(axis=0))
            words, features, total = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, features, total))
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x) for x in (words, features, weight))], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(weigh, f"id {kind.simpleString()}, n_words long, n_features long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``rank`` to the drawn rows of (id, n_words, ..., score), null for the others.

    Scores are whole numbers in a narrow range: logarithms of ratios and 32-bit noise, so a histogram of them is a table of bounded
    size. It tells how many rows stand above each score, and only rows of one score are sorted together.
    """
    able = F.col("n_words") >= min_words
    steps = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.expr(f"sum(_n) OVER () * {int(percent)} DIV 100")
    steps = steps.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"), wanted.alias("_wanted"))
    steps = steps.filter("_above < _wanted")
    steps = F.broadcast(steps.withColumnRenamed("score", "_score"))
    same = able & (F.col("score") == F.col("_score"))
    high = scored.join(steps, same)
    low = scored.join(steps, same, "left_anti").withColumn("rank", F.lit(None).cast("long"))
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight", "n_words")
    place = F.col("_above") + F.row_number().over(order)
    high = high.withColumn("rank", F.when(place <= F.col("_wanted"), place).cast("long"))
    return high.drop("_score", "_above", "_wanted").unionByName(low)


def resample(
    docs: DataFrame, target: DataFrame, doc_id="doc_id", text="text", target_text="text", percent=PERCENT, min_words=MIN_WORDS,
    longest=LONGEST, buckets=BUCKETS, seed=SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document; the drawn ones have a rank."""
    gains = np.zeros(buckets, np.int64)
    counted = [keep(bucket_counts(t, c, longest, buckets), "bucket-counts") for t, c in ((docs, text), (target, target_text))]
    for bucket, gain in bucket_gains(*counted, buckets).collect():  # at most one row a bucket
        gains[bucket] = gain
    weights = document_weights(docs, gains, doc_id, text, longest)
    scored = keep(weights.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "weights")
    out = draw(scored, percent, min_words)
    return out.select(F.col("id").alias(doc_id), "n_features", "weight", "score", "rank", "n_words")


#: The features, gains and draw in SQL; crc32 is folded over the bytes with a table made from its polynomial.
SQL = r"""WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  cut AS (SELECT 0 AS src, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
    UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
  worded AS MATERIALIZED (SELECT src, doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM cut),
  grams AS MATERIALIZED (SELECT src, doc_id, f, count(*) AS n FROM (SELECT src, doc_id, unnest(w) AS f FROM worded UNION ALL
    SELECT src, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1) GROUP BY ALL),
  hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(f)),
      lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT f FROM grams), crc_table),
  counted AS (SELECT bucket, coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE AS t
    FROM grams JOIN hashed USING (f) GROUP BY 1),
  gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS gain FROM counted),
  weighed AS (SELECT doc_id, sum(n)::BIGINT AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight
    FROM grams JOIN hashed USING (f) JOIN gains USING (bucket) WHERE src = 0 GROUP BY 1),
  scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
      coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM worded d LEFT JOIN weighed USING (doc_id) WHERE src = 0),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM ranked) THEN rank END AS rank, n_words
FROM scored s LEFT JOIN ranked USING (doc_id)"""
