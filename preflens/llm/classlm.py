"""Language-model scores from Brown class-based bigrams.

Words are counted over all training texts. The most frequent words, and groups of the others by their endings, start as items
that exchange clustering assigns to classes: each item in turn moves to the class that raises the likelihood of the class
bigrams most. Then every word of the corpus, whatever its count, moves by itself to the class under which its own neighbours are
likeliest, and the class bigrams are counted again. A text scores the sum of log10 P(class | class before) + log10 P(word | class).

Counting, moving, bigrams and look-ups are Spark jobs. The driver clusters a matrix of items x items, whose size is a parameter.
Counts and classes of frequent words travel as a broadcast of bounded size; all other words meet theirs in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import drop_table, keep, most_frequent, release
from preflens.llm.words import hash_spans, mix, row_slices, text_bytes, word_spans

ITEM_WORDS = 768  # frequent words that are clustered one by one
ENDINGS = 192  # groups of all other words
CLASSES = 48
SWEEPS = 8
LOCAL_WORDS = 1 << 17  # words whose counts are broadcast
PRIOR = 5.0  # weight of the class shares in the transitions
ADD = 0.1
HELD_WORDS = 3_000_000
WORDS_PER_PART = 2_000_000  # tokens whose words are moved by one task
SLICE_BYTES = 1 << 21
END = 0x5EED  # token after the last word, also the context of the first
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?|#$%&*\"')")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes, endings, row of each token); every row ends with ``END``."""
    data, offsets = text_bytes(column)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends = word_spans(part, at)
        words = np.searchsorted(starts, at)
        row = np.searchsorted(at, starts, "right") - 1
        tail = ends.copy()
        for _ in range(3):
            tail -= (tail - starts > 1) & _PUNCTUATION[part[tail - 1]] if len(tail) else 0
        last = _LOWER[part[tail - 1]].astype(np.uint64)
        before = _LOWER[part[np.maximum(tail - 2, starts)]].astype(np.uint64)
        ending = (mix(last << np.uint64(8) | before) % np.uint64(ENDINGS)).astype(np.int64)
        tokens = np.full(len(starts) + hi - lo, END, np.uint64)
        endings = np.zeros(len(tokens), np.int64)
        rows = np.zeros(len(tokens), np.int64)
        place = np.arange(len(starts)) + row
        tokens[place], endings[place], rows[place] = hash_spans(part, starts, ends), ending, row
        rows[words[1:] + np.arange(hi - lo)] = np.arange(hi - lo)
        yield lo, hi, tokens, endings, rows


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n, ending) of all tokens: counted in the tasks first, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            tokens = np.concatenate([t for t, _ in held]) if held else np.zeros(0, np.uint64)
            endings = np.concatenate([e for _, e in held]) if held else np.zeros(0, np.int64)
            held.clear()
            keys, first, n = np.unique(tokens, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(endings[first].astype(np.int32))], names=["word", "n", "ending"])

        for batch in batches:
            for _, _, tokens, endings, _ in token_rows(batch.column(0)):
                held.append((tokens, endings))
                if sum(len(t) for t, _ in held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = df.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, n long, ending int")
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.min("ending").alias("ending"))


class Items:
    """Words that are items of their own, the rest by ending. Item 0 is ``END``."""

    def __init__(self, words: np.ndarray):
        words = words[words != END]
        self.sorted = np.sort(np.append(words, np.uint64(END)))
        self.number = np.arange(1, len(self.sorted) + 1)
        end = int(np.searchsorted(self.sorted, np.uint64(END)))
        self.number[end + 1:] -= 1
        self.number[end] = 0
        self.words = len(self.sorted)
        self.size = self.words + ENDINGS

    def of(self, tokens: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, tokens), self.words - 1)
        return np.where(self.sorted[at] == tokens, self.number[at], self.words + endings)


def item_bigrams(df: DataFrame, text_col: str, items: Items) -> np.ndarray:
    """Matrix of how often an item follows another in all texts; at most items x items cells come to the driver."""
    shared = df.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        total = np.zeros(items.size**2, np.int64)
        for batch in batches:
            for _, _, tokens, endings, _ in token_rows(batch.column(0)):
                item = items.of(tokens, endings)
                before = np.append(0, item[:-1])  # the token before a text is END
                cells, n = np.unique(before * items.size + item, return_counts=True)
                total[cells] += n
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    table = df.select(F.col(text_col).cast("string")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(items.size**2)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(items.size, items.size)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(bigrams: np.ndarray, classes: np.ndarray, n_classes: int) -> float:
    """Log likelihood of the class bigrams, up to a term that no assignment changes."""
    member = np.eye(n_classes)[classes]
    f = member.T @ bigrams @ member
    return float(_plogp(f).sum() - _plogp(f.sum(0)).sum() - _plogp(f.sum(1)).sum())


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item: items, most frequent first, move to the class of highest likelihood until a sweep moves none."""
    n = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    classes = np.empty(n, np.int64)
    classes[order] = np.arange(n) % n_classes
    member = np.eye(n_classes)[classes]
    f = member.T @ bigrams @ member
    diagonal = np.arange(n_classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            row, column, own = bigrams[w], bigrams[:, w], bigrams[w, w]
            out = np.bincount(classes, row, n_classes)
            into = np.bincount(classes, column, n_classes)
            a = classes[w]
            if not out.sum() + into.sum():
                continue
            # Take the item out of its class.
            out[a] -= own
            into[a] -= own
            f[a] -= out
            f[:, a] -= into
            f[a, a] -= own
            gain = (_plogp(f + out[None, :]) - _plogp(f)).sum(1) + (_plogp(f.T + into[None, :]) - _plogp(f.T)).sum(1)
            d = f[diagonal, diagonal]
            gain += _plogp(d + out + into + own) - _plogp(d + out) - _plogp(d + into) + _plogp(d)
            left, right = f.sum(1), f.sum(0)
            # The row of the new class grows by all that follows the item, and by what the item adds to its column.
            gain -= _plogp(left + out.sum() + own + into) - _plogp(left) + _plogp(right + into.sum() + own + out) - _plogp(right)
            # Other classes' totals change with the item's neighbours, whichever class it joins.
            gain += (_plogp(left + into) - _plogp(left)) + (_plogp(right + out) - _plogp(right))
            b = int(gain.argmax())
            f[b] += out
            f[:, b] += into
            f[b, b] += own
            classes[w] = b
            moved += b != a
        if not moved:
            break
    return classes


def moved_words(df: DataFrame, text_col: str, items: Items, classes: np.ndarray, f: np.ndarray, n_tokens: int) -> DataFrame:
    """(word, class) of every word of the texts: the class under which its neighbours are likeliest, given the class bigrams ``f``
    of the items. Words that are items keep the class that the exchange gave them.

    Each word's neighbours are counted by class. A task sends the counts of a part of the words as one row of lists.
    """
    spark, n_classes, held = df.sparkSession, len(f), HELD_WORDS // 2
    parts = max(spark.sparkContext.defaultParallelism, -(-n_tokens // WORDS_PER_PART))
    shared = spark.sparkContext.broadcast((items, classes))
    share = (f.sum(0) + 0.5) / (f.sum() + 0.5 * n_classes)
    after = np.log((f + PRIOR * share) / (f.sum(1, keepdims=True) + PRIOR))
    # Rows: classes before a word, then those after it. A word's own share of its class falls as the class grows.
    gain = np.concatenate([after - np.log(f.sum(0) + 0.5), after.T])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, classes = shared.value
        words, cells = [], []

        def flush():
            if not words:
                return
            keys, at = np.unique(np.concatenate(words), return_inverse=True)
            cell, n = np.unique(at * (2 * n_classes) + np.concatenate(cells), return_counts=True)
            words.clear(), cells.clear()
            size = np.bincount(cell // (2 * n_classes), minlength=len(keys))
            part = (mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.concatenate([[0], np.cumsum(size)])
            entries = np.repeat(first[order] - np.concatenate([[0], np.cumsum(size[order])[:-1]]), size[order]) + np.arange(len(cell))
            each = np.bincount(part, minlength=parts)
            ends = np.concatenate([[0], np.cumsum(each)])
            upto = np.concatenate([[0], np.cumsum(size[order])])[ends]
            lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in (
                (ends, keys[order].view(np.int64)), (ends, size[order].astype(np.int16)),
                (upto, (cell % (2 * n_classes))[entries].astype(np.int16)), (upto, n[entries].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), *lists], names=["part", "word", "size", "cell", "n"])

        count = 0
        for batch in batches:
            for _, _, tokens, endings, _ in token_rows(batch.column(0)):
                own = classes[items.of(tokens, endings)]
                before = np.append(classes[0], own[:-1])  # the token before a text is END
                words += [tokens, tokens]
                cells += [before, n_classes + np.append(own[1:], own[:1])]
                count += len(tokens)
                if count > held:
                    yield from flush()
                    count = 0
        yield from flush()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, classes = shared.value
        got = [[batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(1, 5)] for batch in batches if batch.num_rows]
        if not got:
            return
        word, size, cell, n = (np.concatenate(x) for x in zip(*got, strict=True))
        keys, at = np.unique(word.view(np.uint64), return_inverse=True)
        for lo in range(0, len(keys), 50_000):  # some words at a time
            some = (at >= lo) & (at < lo + 50_000)
            entry = np.repeat(some, size)
            found = keys[lo:lo + 50_000]
            where = np.repeat(at[some] - lo, size[some]) * (2 * n_classes) + cell[entry]
            counts = np.bincount(where, n[entry], len(found) * 2 * n_classes).reshape(len(found), -1)
            best = (counts @ gain).argmax(1)
            place = items.of(found, np.zeros(len(found), np.int64))
            best = np.where(place < items.words, classes[place], best)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(best.astype(np.int16))], names=["word", "class"])

    packed = df.select(F.col(text_col).cast("string")).mapInArrow(run, "part int, word array<long>, size array<short>, cell array<short>, n array<int>")
    return packed.repartition(parts, "part").mapInArrow(move, "word long, class short")


def class_bigrams(df: DataFrame, text_col: str, local: np.ndarray, local_class: np.ndarray, rare: DataFrame, n_classes: int) -> np.ndarray:
    """How often a class follows another in all texts. Words that are not ``local`` meet their class in ``rare`` (word, class)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((local, local_class))

    def rows(word, other, cell, n):
        columns = [pa.nulls(len(cell), pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (word, other)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "other", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, local_class = shared.value
        total = np.zeros(n_classes**2, np.int64)
        for batch in batches:
            for _, _, tokens, _, _ in token_rows(batch.column(0)):
                tokens = np.append(np.uint64(END), tokens)  # the token before a text is END
                own = np.full(len(tokens), -1)
                if len(local):
                    at = np.minimum(np.searchsorted(local, tokens), len(local) - 1)
                    own = np.where(local[at] == tokens, local_class[at], -1)
                (first, second), (a, b) = (tokens[:-1], tokens[1:]), (own[:-1], own[1:])
                both, left, right, none = (a >= 0) & (b >= 0), (a < 0) & (b >= 0), (a >= 0) & (b < 0), (a < 0) & (b < 0)
                total += np.bincount(a[both] * n_classes + b[both], minlength=n_classes**2)
                # One word without a class yet, with the class before it or after it; then two of them.
                yield rows(second[right], None, a[right], np.ones(right.sum()))
                yield rows(first[left], None, n_classes + b[left], np.ones(left.sum()))
                yield rows(first[none], second[none], np.zeros(none.sum()), np.ones(none.sum()))
        cells = np.flatnonzero(total)
        yield rows(None, None, cells, total[cells])

    pairs = keep(df.select(F.col(text_col).cast("string")).mapInArrow(run, "word long, other long, cell int, n long"), "class-pairs")
    rare = rare.select("word", F.col("class").cast("int").alias("_c"))
    one = pairs.filter("word is not null and other is null").join(rare, "word")
    one = one.select(F.when(F.col("cell") < n_classes, F.col("cell") * n_classes + F.col("_c")).otherwise((F.col("_c") - 1) * n_classes + F.col("cell")).alias("cell"), "n")
    two = pairs.filter("other is not null").join(rare, "word").select(F.col("_c").alias("_b"), F.col("other").alias("word"), "n").join(rare, "word")
    cells = pairs.filter("word is null").select("cell", "n").unionByName(one).unionByName(two.select((F.col("_b") * n_classes + F.col("_c")).alias("cell"), "n"))
    table = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # classes x classes cells at most
    drop_table(spark, pairs)
    out = np.zeros(n_classes**2)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(n_classes, n_classes)


@dataclass
class Model:
    items: Items
    classes: np.ndarray  # of the items: of words that training lacks, by their endings
    transition: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of the emission denominators
    local: np.ndarray  # sorted hashes of frequent words
    local_n: np.ndarray
    local_class: np.ndarray
    total: int
    distinct: int


def train(df: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """Model of all texts of ``df``, and the table (word, n, class) of words that are not in the model."""
    spark = df.sparkSession
    counts = keep(token_counts(df, text_col), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    local = most_frequent(counts.select("word", "n"), LOCAL_WORDS).toArrow()
    words, n = local.column("word").to_numpy().view(np.uint64), local.column("n").to_numpy()
    order = np.lexsort((words, -n))
    items = Items(words[order][:ITEM_WORDS])
    bigrams = item_bigrams(df, text_col, items)
    classes = exchange(bigrams, CLASSES, SWEEPS)
    member = np.eye(CLASSES)[classes]
    moved = moved_words(df, text_col, items, classes, member.T @ bigrams @ member, int(total))
    known = keep(counts.select("word", "n").join(moved, "word"), "word-classes")
    drop_table(spark, counts)
    release(spark)
    least = int(n.min()) if len(n) else 1 << 62
    rare = known.filter(F.col("n") < least)  # a word is either broadcast or in this table
    local = known.filter(F.col("n") >= least).toArrow().sort_by("word")  # LOCAL_WORDS rows at most
    words, n, own = local.column("word").to_numpy().view(np.uint64), local.column("n").to_numpy(), local.column("class").to_numpy()
    by_hash = np.argsort(words)
    words, n, own = words[by_hash], n[by_hash], own[by_hash].astype(np.int64)
    f = class_bigrams(df, text_col, words, own, rare, CLASSES)
    release(spark)
    share = (f.sum(0) + 0.5) / (f.sum() + 0.5 * CLASSES)
    transition = np.log10((f + PRIOR * share) / (f.sum(1, keepdims=True) + PRIOR))
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in known.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows at most
        tokens[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    return Model(items, classes, transition, np.log10(tokens + ADD * (kinds + 1)), words, n, own, int(total), int(distinct)), rare


def score(df: DataFrame, model: Model, rare: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # LOCAL_WORDS counts and the class tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, tokens, endings, row in token_rows(batch.column(1)):
                rows = hi - lo
                cls = model.classes[model.items.of(tokens, endings)]
                if len(model.local):
                    at = np.minimum(np.searchsorted(model.local, tokens), len(model.local) - 1)
                    here = model.local[at] == tokens
                    cls = np.where(here, model.local_class[at], cls)
                    logs = np.bincount(row[here], np.log10(model.local_n[at[here]] + ADD), rows)
                else:
                    here, logs = np.zeros(len(tokens), bool), np.zeros(rows)
                sizes, away = np.bincount(row, minlength=rows), np.bincount(row[~here], minlength=rows)
                first = np.concatenate([[0], np.cumsum(sizes)])
                place = np.arange(len(tokens)) - first[row]
                upto = pa.array(np.append(0, np.cumsum(away)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, rows), pa.array(sizes), pa.array(np.bincount(row[here], minlength=rows)), pa.array(logs),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(cls.astype(np.int8))),
                    pa.ListArray.from_arrays(upto, pa.array(tokens[~here].view(np.int64))), pa.ListArray.from_arrays(upto, pa.array(place[~here].astype(np.int32))),
                ], names=[id_col, "n_tokens", "here", "logs", "classes", "away", "place"])

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Puts the classes of rare words in their places and adds the class path to the last column."""
        model = shared.value
        for batch in batches:
            sizes, found = (pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False) for i in (-3, -2))
            first = np.concatenate([[0], np.cumsum(sizes)])
            cls = batch.column(-3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cls[np.repeat(first[:-1], found) + batch.column(-2).flatten().to_numpy(zero_copy_only=False)] = batch.column(-1).flatten().to_numpy(zero_copy_only=False)
            before = np.append(model.classes[:1], cls[:-1])  # every text ends with END, which is item 0
            row = np.repeat(np.arange(batch.num_rows), sizes)
            scores = batch.column(5).to_numpy(zero_copy_only=False) + np.bincount(row, model.transition[before, cls] - model.spread[cls], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores)], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, here long, logs double, classes array<tinyint>, away array<long>, place array<int>")
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "token-sums")
    words = rows.select("_row", F.explode(F.arrays_zip("away", "place")).alias("_w")).select("_row", F.col("_w.away").alias("word"), F.col("_w.place").alias("place"))
    met = words.join(rare, "word").groupBy("_row").agg(
        F.sum(F.log10(F.col("n") + ADD)).alias("met_logs"), F.count(F.lit(1)).alias("met"), F.collect_list(F.struct("place", F.col("class").cast("tinyint").alias("class"))).alias("found"))
    both = rows.drop("away", "place").join(met, "_row", "left")
    known = F.col("here") + F.coalesce("met", F.lit(0))
    logs = F.col("logs") + F.coalesce("met_logs", F.lit(0.0)) + (F.col("n_tokens") - known) * float(np.log10(ADD))
    spread = float(np.log10(model.total + ADD * (model.distinct + 1)))
    summed = both.select(
        id_col, "n_tokens", known.cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * spread).alias("base_score"), logs.alias("score"), "classes", F.col("found.place").alias("place"), F.col("found.class").alias("class"),
    )
    return summed.mapInArrow(path, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose id's crc32 modulo 10 is 0 do not teach; a null id does. Null and empty texts are the end token alone; repeated
    rows count and score each; other columns are left aside; without training rows every word is unknown.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model, rare = train(df.filter(~out), text_col)
    scored = score(df, model, rare, id_col, text_col)
    return scored.select(id_col, out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
