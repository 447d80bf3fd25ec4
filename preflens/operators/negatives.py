"""Negative sampling without building the user x item product.

Items carry a dense index. A user with s seen items has N - s unseen ones; the p-th of them is found by
adding to p the number of seen items before it: by bisection in the user's sorted list of seen indices, or, for a
user of very many, by one running count over these and the drawn positions. So a draw costs one row, whatever the
size of the catalogue.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from preflens.frames import (
    ITEM, ROWS_PER_TASK, SEED, USER, lanes, rank_rows, running, same_keys, stable, top_k, unit_hash,
)
from preflens.operators.prep import index_ids

SPAN = 1_024  # numbers per lookup block
SEEN_IN_LIST, SEEN_PER_TASK = 4_096, 100_000  # seen items of a user in one list, of all users in one task
SENT_ITEMS = 1 << 23  # items of a catalogue that is broadcast
PRIME, ROUNDS, WALK = 2_147_483_647, 6, 16  # of the permutations: modulus of the round numbers, rounds, steps along a cycle
CELLS = 1 << 16  # of a histogram that finds the place of a row
SHIFT = 1_000_003  # prime; strides through the shifts of the circle of products


def _with_permutation(rows: DataFrame, pool: str, seed, keys: Sequence[str]) -> DataFrame:
    """Adds the columns of one random permutation of [0, pool) for every row: its sides and the numbers its rounds are made from."""
    side = F.ceil(F.sqrt(F.col(pool).cast("double"))).cast("long")
    rows = rows.withColumn("_a", side).withColumn("_b", F.expr(f"({pool} + _a - 1) DIV _a"))
    return rows.withColumns({f"_k{i}": F.floor(unit_hash(seed, *keys, F.lit(f"k{i}")) * (PRIME - 1)).cast("long") for i in range(1, 5)})


def _permuted(rows: DataFrame, place: str, pool: str, out: str) -> DataFrame:
    """Adds where the row's permutation sends a place of [0, pool).

    Format-preserving Feistel rounds on the rectangle _a x _b, the smallest near-square one with room for pool places: each round
    adds a number drawn from one coordinate to the other one, so places never collide. A place outside the pool walks on along its
    cycle; a step stays outside with a chance below 1 / sqrt(pool).
    """
    def drawn(x: str, r: str, even: str) -> tuple[str, str]:
        key, mix = f"((_k3 + {r} * _k4) % {PRIME})", f"(1 + (_k1 + {r} * _k2) % {PRIME - 1})"
        return f"((if({even}, {x} % _b, {x} DIV _b) * {mix} + {key}) % {PRIME})", key

    def moved(x: str, even: str, add: str) -> str:
        return f"if({even}, (({x} DIV _b + {add}) % _a) * _b + {x} % _b, ({x} DIV _b) * _b + ({x} % _b + {add}) % _b)"

    kept = [c for c in rows.columns if c not in ("_a", "_b", "_k1", "_k2", "_k3", "_k4")]
    rows = rows.withColumn("_x", F.col(place))
    for r in range(ROUNDS):  # a projection each, so that the rounds are compiled
        even = "true" if r % 2 == 0 else "false"
        first, key = drawn("_x", f"{r}L", even)
        rows = rows.withColumn("_t", F.expr(first)).withColumn("_x", F.expr(moved("_x", even, f"((_t * _t + {key}) % {PRIME})")))
    first, key = drawn("t", "q", "q % 2 = 0")
    again = f"aggregate(sequence(0L, {ROUNDS - 1}L), x, (t, q) -> {moved('t', 'q % 2 = 0', f'(({first} * {first} + {key}) % {PRIME})')})"
    walked = F.expr(f"if(_x < {pool}, _x, aggregate(sequence(1, {WALK}), _x, (x, i) -> if(x < {pool}, x, {again})))")
    return rows.select(*kept, walked.alias(out))


def known_places(seen: DataFrame, items: DataFrame, user=USER, item=ITEM) -> DataFrame:
    """(user, _s): index of each seen item of the catalogue."""
    return seen.select(user, item).distinct().join(items.select(item, F.col("index").alias("_s")), item).select(user, "_s")


def unseen_sizes(known: DataFrame, items: DataFrame, user=USER) -> DataFrame:
    """(user, n_seen, pool): seen items of the catalogue and what is left of it."""
    total = items.agg(F.count(F.lit(1))).scalar()
    sizes = known.groupBy(user).agg(F.count(F.lit(1)).alias("n_seen"))
    return sizes.withColumn("pool", total - F.col("n_seen"))


def unseen_items(
    draws: DataFrame, known: DataFrame, items: DataFrame, user=USER, item=ITEM, limit=ROWS_PER_TASK, sizes: DataFrame | None = None
) -> DataFrame:
    """Replace column ``p`` of the draws by the user's p-th unseen item; ``sizes`` (user, n) counts draws and seen items."""
    known = rank_rows(known, [user], [("_s", True)], "_i", limit=limit)
    carried = [c for c in draws.columns if c not in (user, "p")]
    marks = known.select(
        user, (F.col("_s") - F.col("_i") + 1).alias("p"), F.lit(0).alias("_draw"),
        *[F.lit(None).cast(draws.schema[c].dataType).alias(c) for c in carried],
    )
    rows = marks.unionByName(draws.select(user, F.col("p").cast("long"), F.lit(1).alias("_draw"), *carried))
    counted = running(rows, [user], [("p", True), ("_draw", True)], {"_before": 1 - F.col("_draw")}, limit=limit, sizes=sizes)
    placed = counted.filter("_draw = 1").withColumn("index", F.col("p") + F.col("_before"))
    return placed.join(items.select("index", item), "index").select(user, *carried, item)


def draw_unseen(need, seen, items, keys=(), seed=SEED, replace=False, user=USER, item=ITEM, limit=ROWS_PER_TASK):
    """``need`` (user, keys..., n): n unseen items for every row, numbered by ``j``.

    Without replacement n is cut to the number of unseen items, and the draws are the first n values of a random permutation of
    them: any n items are as likely as any others, neighbours included.
    """
    known = stable(known_places(seen, items, user, item))  # read for the sizes and for the places
    n = F.col("n") if replace else F.least(F.col("n"), F.col("pool"))

    def placed(sized: DataFrame) -> DataFrame:
        """Draws of the rows with their place p among the unseen items of the user."""
        drawn = sized.withColumn("_n", n).filter(F.col("_n") > 0)
        if not replace:
            drawn = _with_permutation(drawn, "pool", seed, [user, *keys])
        drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        if replace:
            return drawn.withColumn("p", F.floor(unit_hash(seed, user, *keys, "j") * F.col("pool")))
        return _permuted(drawn, "j", "pool", "p")

    counts = known.groupBy(user).agg(F.count(F.lit(1)).alias("_n"))
    rows, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    longest = min(limit, SEEN_IN_LIST)
    large = counts.filter(F.col("_n") > longest).select(user) if (most or 0) > longest else None
    listed, few = (known, need) if large is None else (same_keys(known, large, [user], "left_anti"), same_keys(need, large, [user], "left_anti"))
    parts = lanes(known.sparkSession, rows or 0, SEEN_PER_TASK)
    total = items.count()
    # The seen places of a user come as one sorted list; a draw finds its place in it by bisection.
    lists = listed.repartition(parts, user).groupBy(user).agg(F.sort_array(F.collect_list("_s")).alias("_marks"))
    lists = lists.select(user, F.transform("_marks", lambda s, i: s - i).alias("_marks"), (total - F.size("_marks")).cast("long").alias("pool"))
    drawn = placed(few.repartition(parts, user).join(lists, user).filter(F.col("pool") > 0))
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(min(most or 0, longest).bit_length()))] or [F.lit(1)])
    at = F.aggregate(steps, F.lit(0), lambda c, s: F.when((c + s <= F.size("_marks")) & (F.get("_marks", c + s - 1) <= F.col("p")), c + s).otherwise(c))
    drawn = drawn.withColumn("_at", at)
    out = _items_at(drawn.select(user, *keys, "j", (F.col("p") + F.col("_at")).alias("index")), items, total, item).select(user, *keys, "j", item)
    if large is None:
        return out
    known = same_keys(known, large, [user], "left_semi")
    sized = need.join(unseen_sizes(known, items, user), user).filter(F.col("pool") > 0)
    sizes = sized.groupBy(user).agg((F.sum(n) + F.first("n_seen")).alias("n"))
    more = unseen_items(placed(sized).select(user, *keys, "j", "p"), known, items, user, item, limit, sizes)
    return out.unionByName(more.select(*out.columns))


def _items_at(rows: DataFrame, items: DataFrame, total: int, item: str) -> DataFrame:
    """Adds the item of each ``index``. A catalogue of bounded size is sent to the rows, as lists of ``SPAN`` items.

    Every index has its item. The joins are outer ones, as the null check of an inner one would be pushed through all projections
    that make the index, each time with several copies of it.
    """
    if total > SENT_ITEMS:
        return rows.join(items.select("index", item), "index", "left")
    block = items.groupBy(F.expr(f"`index` DIV {SPAN}").alias("_block"))
    block = block.agg(F.sort_array(F.collect_list(F.struct(F.col("index").alias("at"), F.col(item).alias("item")))).alias("_items"))
    met = rows.withColumn("_block", F.expr(f"`index` DIV {SPAN}")).join(F.broadcast(block.select("_block", F.col("_items.item").alias("_items"))), "_block", "left")
    return met.withColumn(item, F.get("_items", F.expr(f"cast(`index` % {SPAN} as int)")))


def negative_feedback(df, ratio=1.0, seed=SEED, user=USER, item=ITEM, pos=1, neg=0, out="feedback", limit=ROWS_PER_TASK):
    """Positives plus max(round(n * ratio), 1) unseen items per user."""
    positives = df.select(user, item).distinct()
    n = F.greatest(F.bround(F.count(F.lit(1)) * F.lit(float(ratio)), 0).cast("long"), F.lit(1))
    need = positives.groupBy(user).agg(n.alias("n"))
    drawn = draw_unseen(need, positives, index_ids(positives, item), (), seed, False, user, item, limit)
    return positives.withColumn(out, F.lit(pos)).unionByName(drawn.select(user, item, F.lit(neg).alias(out)))


def negatives_per_positive(df, n_neg=4, replace=False, seed=SEED, user=USER, item=ITEM, out="label", limit=ROWS_PER_TASK):
    """Positives plus n_neg negatives for each; without replacement the user's unseen items are the bound."""
    positives = df.select(user, item).distinct()
    need = positives.groupBy(user).agg((F.count(F.lit(1)) * n_neg).alias("n"))
    drawn = draw_unseen(need, positives, index_ids(positives, item), (), seed, replace, user, item, limit)
    return positives.withColumn(out, F.lit(1)).unionByName(drawn.select(user, item, F.lit(0).alias(out)))


def loo_test_batches(train, test, n_neg=100, seed=SEED, user=USER, item=ITEM, limit=ROWS_PER_TASK) -> DataFrame:
    """Each test item of a user known from train, with n_neg items from neither table; one batch per test item."""
    positives = test.select(user, item).distinct().join(train.select(user).distinct(), user, "left_semi")
    positives = rank_rows(positives, [], [(user, True), (item, True)], "batch", limit=limit)
    positives = positives.withColumn("batch", F.col("batch") - 1)
    seen = train.select(user, item).union(test.select(user, item)).distinct()
    need = positives.select(user, "batch", F.lit(n_neg).cast("long").alias("n"))
    drawn = draw_unseen(need, seen, index_ids(train, item), ("batch",), seed, False, user, item, limit)
    rows = positives.withColumn("label", F.lit(1))
    return rows.unionByName(drawn.select(user, item, "batch", F.lit(0).alias("label")))


def bpr_triples(df, batch_size: int | None = None, seed=SEED, user=USER, item=ITEM, limit=ROWS_PER_TASK) -> DataFrame:
    """(user, pos, neg): for each drawn user one random seen and one random unseen item."""
    positives = df.select(user, item).distinct()
    if batch_size is not None:
        users = positives.select(user).distinct().orderBy(unit_hash(seed, user), user).limit(batch_size)
        positives = positives.join(users, user, "left_semi")
    first = F.min(F.struct(unit_hash(seed, user, item), F.col(item))).getField(item)
    pos = positives.groupBy(user).agg(first.alias("pos"))
    need = pos.select(user, F.lit(1).cast("long").alias("n"))
    neg = draw_unseen(need, positives, index_ids(df, item), (), seed, False, user, item, limit)
    return pos.join(neg.select(user, F.col(item).alias("neg")), user)


def _hot_items(freq: DataFrame, n: int, total: int, item: str) -> list:
    """Items that would come up again and again: the most frequent ones, as long as one has over 1 / 4n of what is left.

    Each takes that share of the rest away, so there are at most 4 n ln(total) + 1 of them.
    """
    hot, left = [], total
    for row in freq.orderBy(F.col("_n").desc(), item).limit(int(4 * n * math.log(total)) + 2).collect():
        if 4 * n * row["_n"] <= left:
            break
        hot.append(row)
        left -= row["_n"]
    return hot


def popularity_negatives(positives, history, n=4, keys=(USER, ITEM), seed=SEED, item=ITEM, cate="cate", draws=16):
    """n distinct items other than the positive, drawn without replacement in proportion to their frequency in ``history``.

    An exponential race: items arrive at the rate of their frequency, the first n different ones win. Arrivals of ordinary items
    are row numbers of ``history`` without the hot items, drawn with replacement; none of them has over 1 / 4n of these rows, so a
    draw is new with a chance above 2/3. Hot items (see ``_hot_items``) have one arrival time each. A key has n + 2 arrivals at first,
    ``draws`` if these leave it short, then 8 n + 64, which is the last step; more arrivals begin with the same ones. ``history`` has (item, cate).
    """
    keys = list(keys)
    rows = history.select(item, cate)
    freq = stable(rows.groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.min(cate).alias(cate)))
    n_items, total = freq.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if n > n_items - 1:
        raise ValueError(f"only {n_items} distinct items for {n} negatives")
    hot = _hot_items(freq, n, total, item)
    hot_table = freq.sparkSession.createDataFrame([tuple(r) for r in hot], freq.schema)
    cold, total = freq.join(F.broadcast(hot_table.select(item)), item, "left_anti"), total - sum(r["_n"] for r in hot)  # few rows
    # Item x owns as many of the numbers 0 .. total - 1 as it has rows; blocks of numbers make the lookup an equi-join.
    spans = running(cold, [], [(item, True)], {"_high": F.col("_n")}).withColumn("_low", F.col("_high") - F.col("_n"))
    blocks = F.sequence(F.floor(F.col("_low") / SPAN), F.floor((F.col("_high") - 1) / SPAN))
    spans = spans.select(F.col(item).alias("neg"), cate, "_low", "_high", F.explode(blocks).alias("_span"))

    def race(wanted: DataFrame, arrivals: int) -> DataFrame:
        js = wanted.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(arrivals - 1))))
        time = F.col("j").cast("double")
        if hot:
            time = F.sum(-F.ln(1 - unit_hash(seed, *keys, "j", F.lit("wait"))) / max(total, 1)).over(
                Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, 0))
        js = js.withColumn("_time", time).withColumn("_at", F.floor(unit_hash(seed, *keys, "j") * total))
        js = js.withColumn("_span", F.floor(F.col("_at") / SPAN))
        inside = (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))
        hit = js.join(spans, "_span").filter(inside).select(*keys, "neg", cate, "_time", F.lit(True).alias("_drawn"))
        if hot:
            known = F.array(*[F.struct(F.lit(r[item]).alias("neg"), F.lit(r[cate]).alias(cate), F.lit(float(r["_n"])).alias("_n")) for r in hot])
            each = wanted.withColumn("_hot", F.explode(known)).select(*keys, "_hot.*")
            wait = -F.ln(1 - unit_hash(seed, *keys, "neg", F.lit("hot"))) / F.col("_n")
            hit = hit.unionByName(each.select(*keys, "neg", cate, wait.alias("_time"), F.lit(False).alias("_drawn")))
        # All arrivals of a key meet once; the first n different ones are found in their list.
        other = F.when(F.col("neg") != F.col(item), F.struct("_time", "neg", cate))
        rows = hit.groupBy(*keys).agg(F.sort_array(F.collect_list(other)).alias("_l"), F.max(F.when(F.col("_drawn"), F.col("_time"))).alias("_last"))
        seen = rows.withColumn("_negs", F.col("_l.neg"))
        new = F.filter("_l", lambda x, i: F.array_position("_negs", x["neg"]) == i + 1)
        if hot and total and len(hot) < n_items:  # arrivals after the last drawn one are not known to be next
            new = F.filter(new, lambda x: x["_time"] <= F.col("_last"))
        return seen.select(*keys, F.slice(new, 1, n).alias("_l"))

    found, left = [], positives.select(*keys).distinct()
    for arrivals in sorted({min(n + 2, draws), draws}):  # most keys need hardly more than n
        done = stable(race(left, arrivals))
        full = F.size("_l") == n
        found.append(done.filter(full))
        left = done.filter(~full).select(*keys)
    lists = reduce(DataFrame.unionByName, [*found, race(left, 8 * n + 64)])
    out = lists.select(*keys, F.posexplode("_l").alias("_i", "_e"))
    return out.select(*keys, "_e.neg", F.col(f"_e.{cate}").alias(cate), (F.col("_i") + 1).cast("long").alias("rank"))


def impression_negatives(rows, ratio=4, pad=False, seed=SEED, imp="imp", item="item", label="label", limit=ROWS_PER_TASK):
    """Each clicked item with ``ratio`` not-clicked items of the same impression.

    A short list is walked round again, or with ``pad`` filled with null. Columns imp, pos, j, neg.
    """
    neg = rows.filter(F.col(label) == 0).select(imp, F.col(item).alias("neg"), unit_hash(seed, imp, item).alias("_h"))
    neg = rank_rows(neg, [imp], [("_h", True), ("neg", True)], "_i", "_n", limit)
    neg = neg.select(imp, "neg", (F.col("_i") - 1).alias("_i"), "_n")
    sizes = neg.filter("_i = 0").select(imp, "_n")
    pos = rows.filter(F.col(label) == 1).select(imp, F.col(item).alias("pos")).join(sizes, imp, "left" if pad else "inner")
    pos = pos.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ratio - 1))))
    at = F.pmod(F.floor(unit_hash(seed, imp, "pos") * F.col("_n")) + F.col("j"), F.col("_n"))
    pos = pos.withColumn("_i", F.when(F.col("j") < F.col("_n"), at) if pad else at).drop("_n")
    return pos.join(neg.drop("_n"), [imp, "_i"], "left").select(imp, "pos", "j", "neg")


# ---------------------------------------------------------------- edges


def pair_key(a, b) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def negative_edges(known, val, n: Column | int, seed=SEED, a="product1", b="product2", limit=ROWS_PER_TASK) -> DataFrame:
    """n distinct product pairs among the products of ``val`` that are no known edge; raises when fewer exist.

    Products stand in hash order on a circle; round r pairs each product with the one a given number of places ahead, another
    number in each round, so no pair comes twice. Enough rounds are made for n pairs even if they hit every known edge.
    """
    nodes = val.select(F.explode(F.array(a, b)).alias("node")).distinct()
    nodes = nodes.withColumn("_h", unit_hash(seed, "node"))
    nodes = stable(rank_rows(nodes, [], [("_h", True), ("node", True)], "_i", limit=limit).select("node", (F.col("_i") - 1).alias("_i")))
    edges = known.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).filter(F.col(a) != F.col(b)).distinct()
    inside = stable(edges.join(nodes.select(F.col("node").alias(a)), a, "left_semi").join(nodes.select(F.col("node").alias(b)), b, "left_semi"))
    m, taken = nodes.count(), inside.count()
    wanted = known.sparkSession.range(1).select(n).first()[0] if isinstance(n, Column) else int(n)
    free = m * (m - 1) // 2 - taken
    if wanted > free:
        raise ValueError(f"only {free} pairs without an edge for {wanted} negatives")
    if not wanted:
        return inside.limit(0)
    shifts = m // 2  # the last one of an even circle gives m / 2 pairs, the others m
    rounds = min(shifts, -(-(wanted + taken) // m) + 1)
    step = SHIFT if shifts % SHIFT else 1
    start = F.floor(unit_hash(seed, F.lit("round")) * shifts)
    drawn = nodes.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    ahead = 1 + F.pmod(start + F.col("_r") * step, F.lit(shifts))
    drawn = drawn.filter((2 * ahead < m) | (F.col("_i") < ahead))
    drawn = drawn.select(
        F.col("node").alias("_x"), (F.col("_r") * m + F.col("_i")).alias("_d"), F.pmod(F.col("_i") + ahead, F.lit(m)).alias("_j"),
    )
    other = nodes.select(F.col("node").alias("_y"), F.col("_i").alias("_j"))
    pairs = drawn.join(other, "_j").select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b), "_d")
    fresh = stable(pairs.join(inside, [a, b], "left_anti"))
    cell = F.floor(F.col("_d") / F.lit(-(-rounds * m // CELLS)))
    return cut_rows(fresh, cell, [("_d", True)], wanted, limit)[0].select(a, b)


def cut_rows(df: DataFrame, cell: Column, order: Sequence[tuple[str, bool]], n: int, limit: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """The first n rows of a checkpointed table in the given order, and the others, without a sort of the table.

    ``cell`` is a whole number from 0 to ``CELLS`` that rises with the order. Rows are counted by cell; cells before that of row n
    are taken whole, and only its own rows are ranked.
    """
    if n < 1:
        return df.limit(0), df
    counts = sorted((r["_c"], r["_n"]) for r in df.groupBy(cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).collect())  # CELLS rows
    before, last = 0, 0
    for last, size in counts:
        if before + size >= n:
            break
        before += size
    edge = stable(rank_rows(df.filter(cell == last), [], order, "_first", limit=limit))
    first, rest = (edge.filter((F.col("_first") <= n - before) == part).drop("_first") for part in (True, False))
    return df.filter(cell < last).unionByName(first), df.filter(cell > last).unionByName(rest)


def edge_split(edges, val_share=0.1, seen_only=False, seed=SEED, a="product1", b="product2", limit=ROWS_PER_TASK):
    """(train, val): val holds int(n * share) edges labelled 1 and as many negative ones labelled 0.

    With ``seen_only`` edges with a product that train lacks go back to train.
    """
    hashed = stable(edges.withColumn("_h", unit_hash(seed, a, b)))  # counted, and read by both parts and the negatives
    n_val = math.floor(hashed.count() * val_share)
    order = [("_h", True), (a, True), (b, True)]
    held, train = (part.drop("_h") for part in cut_rows(hashed, F.floor(F.col("_h") * CELLS), order, n_val, limit))
    if seen_only:
        nodes = train.select(F.col(a).alias("_x")).union(train.select(F.col(b).alias("_x"))).distinct()
        kept = held.join(nodes.withColumnRenamed("_x", a), a, "left_semi").join(nodes.withColumnRenamed("_x", b), b, "left_semi")
        train = edges.join(kept.select(a, b), [a, b], "left_anti")
        held = kept
    wanted = held.count()
    neg = negative_edges(hashed, held, wanted, seed, a, b, limit)
    val = held.select(a, b, F.lit(1).alias("edge")).unionByName(neg.select(a, b, F.lit(0).alias("edge")))
    return train, val


# ---------------------------------------------------------------- word statistics


def token_freq(tokens: DataFrame, token: str) -> DataFrame:
    return tokens.groupBy(token).agg(F.count(F.lit(1)).alias("freq"))


def negative_table(freq, size: int = 100_000_000, power=0.75, token="token") -> DataFrame:
    """Slots of each token in a negative-sampling table of the given size."""
    weight = F.pow(F.col("freq").cast("double"), F.lit(power))
    total = freq.agg(F.sum(weight)).scalar()
    return freq.select(token, F.bround(weight / total * size, 0).cast("long").alias("slots"))


def keep_prob(freq, sample=0.001, token="token") -> DataFrame:
    """Probability to keep a token as context: (sqrt(p / s) + 1) * s / p."""
    share = F.col("freq") / freq.agg(F.sum("freq")).scalar()
    return freq.select(token, ((F.sqrt(share / sample) + 1) * (sample / share)).alias("keep_prob"))
