"""Language identification with language-bitmask n-gram filters.

Training counts letter n-grams of each language over all its texts. The n-grams that make up a fair share of a language go into
one bit-sliced Bloom filter: a slot holds a bit for each language, and the AND of an n-gram's slots is the set of languages
that (may) contain it. A text's hits per language, corrected for the measured rate of false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import keep
from preflens.llm.words import mix, row_slices, text_bytes

SIZES = (2, 3, 4)
#: An n-gram belongs to a language when it is at least this share of the language's n-grams of its size, so a language has
#: at most 1 / SHARE of them for each size, whatever the corpus.
SHARE = 2e-5
PROBES = 3
SLOTS_PER_GRAM = 16
FLUSH_GRAMS = 300_000
SLICE_BYTES = 1 << 20
_tables: dict[str, np.ndarray] = {}
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all else."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables["letters"] = table
    return _tables["letters"]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and the rows' offsets in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """For row ranges: (first row, end row, letters per row, [(size, hashes, row of each)]).

    A word's n-grams count the border before and after it; all code points of all rows take part.
    """
    table = letter_table()
    data, offsets = text_bytes(column)
    for lo, hi in row_slices(offsets, SLICE_BYTES):
        points, at = code_points(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        # Every row gets a border in front of it; the last one ends with a border too.
        letters = np.zeros(len(points) + hi - lo + 1, np.uint64)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        letters[np.arange(len(points)) + row + 1] = table[points]
        owner = np.zeros(len(letters), np.int64)
        owner[np.arange(len(points)) + row + 1] = row
        owner[at[:-1] + np.arange(hi - lo)] = np.arange(hi - lo)
        owner[-1] = hi - lo - 1
        is_letter = letters > 0
        per_row = np.bincount(owner, is_letter, hi - lo).astype(np.int64)
        found = []
        for size in SIZES:
            if len(letters) < size:
                continue
            n = len(letters) - size + 1
            h = np.full(n, size, np.uint64)
            inside = np.ones(n, bool)
            for k in range(size):
                h += letters[k:k + n] * _MUL[k]
                if 0 < k < size - 1:  # borders only at the ends
                    inside &= is_letter[k:k + n]
            inside &= is_letter[:n] | is_letter[size - 1:]
            where = np.flatnonzero(inside)
            found.append((size, mix(h[where]), owner[where + (~is_letter[where]).astype(np.int64)]))
        yield lo, hi, per_row, found


def gram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, size, gram, n): counted in the tasks first, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for (lang, size), (keys, counts) in kept.items():
                n = len(keys)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n), pa.array(np.full(n, size, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts),
                ], names=["lang", "size", "gram", "n"])
            kept.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, _, found in grams(batch.column(0)):
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                for size, hashes, row in found:
                    for i, lang in enumerate(names):
                        keys, counts = np.unique(hashes[code[row] == i], return_counts=True)
                        old = kept.get((lang, size))
                        if old is not None:
                            both = np.concatenate([old[0], keys])
                            order = np.argsort(both, kind="stable")
                            both, n = both[order], np.concatenate([old[1], counts])[order]
                            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                            keys, counts = both[first], np.add.reduceat(n, first) if len(first) else n
                        kept[lang, size] = keys, counts.astype(np.int64)
                if sum(len(k) for k, _ in kept.values()) > FLUSH_GRAMS:
                    yield from flush()
        yield from flush()

    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return rows.mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class BitmaskFilter:
    """Bit-sliced Bloom filter: 64-language words per slot, ``PROBES`` slots per n-gram."""

    def __init__(self, langs: list[str], members: dict[int, np.ndarray]):
        self.langs = langs
        size = max([1, *map(len, members.values())])
        self.bits = max(10, int(np.ceil(np.log2(SLOTS_PER_GRAM * size))))
        self.slots = np.zeros((-(-len(langs) // 64), 1 << self.bits), np.uint64)
        for lang, keys in members.items():
            for at in self.places(keys):
                self.slots[lang // 64, at] |= np.uint64(1 << lang % 64)  # the same bit: order does not matter
        # Share of random n-grams that a language's bits claim.
        asked = mix(np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.false = np.array([self.hits(asked, lang).mean() for lang in range(len(langs))])

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        mask = np.uint64((1 << self.bits) - 1)
        return [((keys + np.uint64(k) * step) & mask).astype(np.int64) for k in range(PROBES)]

    def masks(self, keys: np.ndarray, word: int) -> np.ndarray:
        """Bit l of an entry: language 64 * word + l may contain the n-gram."""
        out = None
        for at in self.places(keys):
            out = self.slots[word, at] if out is None else out & self.slots[word, at]
        return out

    def hits(self, keys: np.ndarray, lang: int) -> np.ndarray:
        return (self.masks(keys, lang // 64) >> np.uint64(lang % 64)) & np.uint64(1) > 0

    def scores(self, found: list, rows: int) -> np.ndarray:
        """Per row and language: n-grams contained, each size as a share, corrected for false positives."""
        total = np.zeros((rows, len(self.langs)))
        for size, keys, row in found:
            n = np.maximum(np.bincount(row, minlength=rows), 1)
            for word in range(len(self.slots)):
                masks = self.masks(keys, word)
                for bit in range(min(64, len(self.langs) - 64 * word)):
                    lang = 64 * word + bit
                    inside = np.bincount(row, (masks >> np.uint64(bit)) & np.uint64(1), rows) / n
                    total[:, lang] += size * np.maximum(0, inside - self.false[lang]) / max(1e-9, 1 - self.false[lang])
        return total / sum(SIZES)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> BitmaskFilter | None:
    """Filter of the languages of ``df``; None when no row has a language. Ties go to the language with more n-grams."""
    counts = keep(gram_counts(df, text_col, lang_col), "gram-counts")
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    langs = [r["lang"] for r in totals.groupBy("lang").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    if not langs:
        return None
    fair = counts.join(F.broadcast(totals), ["lang", "size"]).filter(F.col("n") >= F.greatest(F.col("total") * share, F.lit(2)))
    rows = fair.select("lang", "gram").toArrow()  # at most languages * sizes / share rows
    lang, gram = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy().view(np.uint64)
    return BitmaskFilter(langs, {i: gram[lang == name] for i, name in enumerate(langs)})


def predict(df: DataFrame, model: BitmaskFilter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every text; score is the language's share of all languages' corrected hits.

    ``und`` and 0 for a null text, one without a letter, or an untrained model. A text without any hit gets the language with
    most training n-grams and score 0. Repeated rows stay; other columns are left aside.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages * sizes / share n-grams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, letters, found in grams(batch.column(1)):
                if model is None:
                    best, score, names = np.zeros(hi - lo, int), np.zeros(hi - lo), np.array(["und"], object)
                else:
                    scores = model.scores(found, hi - lo)
                    best, total = scores.argmax(1), scores.sum(1)
                    score = scores.max(1) / np.where(total > 0, total, 1)
                    names = np.array(model.langs, object)
                known = letters > 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.where(known, names[best], "und"), pa.string()), pa.array(np.where(known, score, 0.0)),
                ], names=[id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def crc_remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows whose id's crc32 modulo 3 is not 1 (a null id counts as not 1), predict all rows."""
    out = F.coalesce(crc_remainder(id_col, 3) == 1, F.lit(False))
    model = train(df.filter(~out), text_col, lang_col)
    return predict(df, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
