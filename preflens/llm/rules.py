"""Quality rules as a learned decision list, with DataFrame expressions only.

Statistics of whole texts are plain column expressions. Sequential covering learns from labelled statistics: a rule grows one
threshold condition at a time by FOIL gain, is pruned on rows set aside, and the rows it covers are taken out before the next
rule. A rule that does not prove itself there bars its first share and side, and another is grown, until none is left to try.
Every step is one small aggregation over bucket numbers. The list comes out as an ordered CASE expression whose branches
are readable, e.g. ``symbol_share > 0.02 and upper_share <= 0.4``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import keep

SAMPLE_ROWS = 50_000  # a list is learned from about so many labelled rows at most
QUANTILES = 24
MIN_PRECISION, MIN_COVER = 0.9, 3
WINDOW = 8
#: White space between words, the symbols that are counted, and the base thresholds.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = {
    "words": "cast(_s.n_words as double)",
    "chars_per_word": "_s.word_chars / greatest(_s.n_words, 1)",
    "symbol_share": "_s.n_symbols / greatest(_s.word_chars, 1)",
    "dup_line_share": "_s.n_dup_lines / greatest(_s.n_lines, 1)",
    "repeat_share": "_s.n_repeat_words / greatest(_s.n_words, 1)",
    "distinct_share": "_s.n_distinct / greatest(_s.n_words, 1)",
    "upper_share": "_s.n_upper / greatest(_s.word_chars, 1)",
    "exclaim_share": "_s.n_exclaim / greatest(_s.word_chars, 1)",
}


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the struct ``_s`` of statistics (all long) of the whole text; a null text counts as empty.

    Windows are compared by 64-bit hashes, built for every word position, and only texts that repeat one are sorted.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("_w", F.array_remove(F.split(text, SPACE), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines).withColumn("_j", F.array_join("_w", ""))
    n = F.size("_w")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    df = df.withColumn("_h", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    # In hash order, a window occurs again if a neighbour has its hash.
    last = F.size("_p") - 1
    again = lambda p, j: (
        F.coalesce(F.get("_p", j - 1)["x"] == p["x"], F.lit(False)) | ((j < last) & F.coalesce(F.get("_p", j + 1)["x"] == p["x"], F.lit(False)))
    )
    df = df.withColumn("_d", F.sort_array(F.transform(F.filter("_p", again), lambda p: p["i"])))
    steps = F.zip_with(F.slice("_d", 2, F.size("_d") - 1), F.slice("_d", 1, F.size("_d") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda total, x: total + x)
    without = lambda chars: F.length("_j") - F.length(F.translate("_j", chars, ""))
    counts = {
        "n_words": n, "word_chars": F.length("_j"), "n_symbols": without(SYMBOLS), "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")), "n_repeat_words": F.when(F.col("_p").isNotNull(), covered).otherwise(0),
        "n_distinct": F.size(F.array_distinct("_w")), "n_upper": F.length(F.regexp_replace("_j", r"[^\p{Lu}]+", "")), "n_exclaim": without("!"),
    }
    # A generator of one row keeps a filter on the statistics from being moved, and so repeated, into the steps above.
    one = F.explode(F.array(F.struct(*[c.cast("long").alias(k) for k, c in counts.items()])))
    return df.withColumn("_s", one).drop("_w", "_l", "_j", "_h", "_p", "_d")


def base_failed() -> Column:
    return F.expr(f"_s.n_words < {MIN_WORDS} or 100 * _s.n_repeat_words > {MAX_REPEAT_PERCENT} * _s.n_words")


@dataclass
class Rule:
    conditions: list[tuple[str, str, float]] = field(default_factory=list)  # (share, "> or <=", threshold)

    def text(self) -> str:
        return " and ".join(f"{name} {op} {value:.6g}" for name, op, value in self.conditions)

    def column(self) -> Column:
        test = F.lit(True)
        for name, op, value in self.conditions:
            share = F.expr(SHARES[name])
            test = test & (share > value if op == ">" else share <= value)
        return test


def verdict(rules: list[Rule]) -> Column:
    """Text of the first rule that rejects the row, else null."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), rule.text()) if out is None else out.when(rule.column(), rule.text())
    return F.lit(None).cast("string") if out is None else out


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """(id, _bad) of the ids to learn from: those with a label, or a share of them by hash, about ``sample_rows``.

    An id with both labels counts as rejected (label 0); null ids and labels are left out.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) == 0).alias("_bad"))
    rows = known.count()
    if rows > sample_rows:
        known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.lit(1 << 40)) < int(sample_rows / rows * (1 << 40)))
    return known


def learn(labelled: DataFrame, key: str, seed: int = 7) -> list[Rule]:
    """Decision list for ``_bad`` (boolean) from rows with ``_s``; the hash of ``key`` sets a third aside.

    The result is an ordered list of rejecting rules; it is empty without rows of both kinds or without a precise rule.
    """
    names = list(SHARES)
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    sample = labelled.select("_bad", (F.pmod(hashed, F.lit(3)) == 0).alias("_aside"), *[F.expr(SHARES[c]).alias(c) for c in names])
    sample = keep(sample, "labelled")
    # Thresholds: quantiles of all rows and of the rejected ones.
    points = [i / QUANTILES for i in range(QUANTILES)]
    of_bad = {c: F.percentile_approx(F.when(F.col("_bad"), F.col(c)), points, 10_000) for c in names}
    of_good = {c: F.percentile_approx(F.when(~F.col("_bad"), F.col(c)), [*points, 1.0], 10_000) for c in names}
    row = sample.agg(*[of_bad[c].alias(f"b_{c}") for c in names], *[of_good[c].alias(f"g_{c}") for c in names]).first()
    cuts = {c: sorted({x for p in "bg" for x in row[f"{p}_{c}"] or []}) for c in names}
    if not any(row[f"b_{c}"] for c in names) or not any(row[f"g_{c}"] for c in names):
        return []
    place = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts[c])), lambda t: F.col(c) > t))
    binned = keep(sample.select("_bad", "_aside", *[place(c).alias(c) for c in names]), "binned")

    def test(conditions) -> Column:
        out = F.lit(True)
        for c, op, k in conditions:
            out = out & (F.col(c) > k if op == ">" else F.col(c) <= k)
        return out

    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("share"), F.col(c).alias("bucket")) for c in names])).alias("e")

    def tally(rows: DataFrame):
        return rows.select("_bad", kinds).groupBy("e.share", "e.bucket").agg(F.count_if("_bad").alias("p"), F.count_if(~F.col("_bad")).alias("n")).collect()

    rules: list[Rule] = []
    left, barred, start = binned, set(), None
    while True:
        start = start or tally(left.filter(~F.col("_aside")))
        best = best_condition(start, cuts, barred)
        if best is None:
            break
        first, conditions = best[:2], []
        while best is not None:
            conditions.append(best)
            best = best_condition(tally(left.filter(~F.col("_aside") & test(conditions))), cuts)
        # Prune: the prefix that does best on the rows set aside.
        prefixes = [conditions[:i] for i in range(1, len(conditions) + 1)]
        tallies = [f(test(p) & b).alias(f"{k}{i}") for i, p in enumerate(prefixes) for k, b, f in (("p", F.col("_bad"), F.count_if), ("n", ~F.col("_bad"), F.count_if))]
        seen = left.filter("_aside").agg(*tallies).first()
        p, n, i = max(((seen[f"p{i}"], seen[f"n{i}"], i) for i in range(len(prefixes))), key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), -x[2]))
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            barred.add(first)
            continue
        rules.append(Rule([(c, op, cuts[c][k]) for c, op, k in prefixes[i]]))
        left, barred, start = left.filter(~test(prefixes[i])), set(), None
    return rules


def best_condition(counts, cuts: dict[str, list[float]], barred: frozenset | set = frozenset()) -> tuple[str, str, int] | None:
    """Condition of highest FOIL gain among the (share, side) that are not barred; bucket > k means a value over threshold k."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["share"], {})[r["bucket"]] = (r["p"], r["n"])
    if not by:
        return None
    any_share = next(iter(by.values()))
    p_all, n_all = (sum(x[i] for x in any_share.values()) for i in (0, 1))
    if not p_all or not n_all:
        return None
    before, best = math.log2(p_all / (p_all + n_all)), (1e-9, None)
    for share in sorted(by):
        p_low = n_low = 0
        for k in range(len(cuts[share])):
            p, n = by[share].get(k, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for op, p, n in (("<=", p_low, n_low), (">", p_all - p_low, n_all - n_low)):
                if p >= MIN_COVER and (share, op) not in barred:
                    best = max(best, (p * (math.log2(p / (p + n)) - before), (share, op, k)), key=lambda x: x[0])
    return best[1]


def learn_from(statistics: DataFrame, known: DataFrame, id_col: str = "doc_id") -> list[Rule]:
    """Learn from the rows that pass the base rules and have a known label."""
    return learn(statistics.filter(~base_failed()).select(id_col, "_s").join(known, id_col), id_col)


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, rule) of every row.

    Null and empty texts have no words and fail the base rules. Repeated rows stay, ids may be null, other columns are left
    aside. Without labels the base rules decide alone.
    """
    statistics = keep(with_statistics(df.select(id_col, text_col), text_col).select(id_col, "_s"), "statistics")
    rule = verdict(learn_from(statistics, known_labels(labels, id_col), id_col))
    out = statistics.select(id_col, *[F.col(f"_s.{c}").alias(c) for c in COUNTS], base_failed().alias("base_failed"), rule.alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns of whatever name, that the base rules and the learned list keep.

    Null, empty and very short texts fail the base rules. Repeated rows and null ids stay or go by their text. Without labels the base
    rules decide alone. While learning, only texts of known labels are read; ``SAMPLE_ROWS`` bounds the broadcast of their ids.
    """
    known = known_labels(labels, id_col)
    learned = with_statistics(df.select(id_col, text_col).join(F.broadcast(known.select(id_col)), id_col, "left_semi"), text_col)
    rule = verdict(learn_from(keep(learned.select(id_col, "_s"), "statistics"), known, id_col))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return with_statistics(rows, "_text").filter(~base_failed() & rule.isNull()).select("_row.*")
