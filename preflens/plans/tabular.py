"""Registered queries: parsing, text exports, sequence and tabular features."""

from __future__ import annotations

from pyspark.sql import functions as F

from preflens.frames import ITEM, PREDICTION, RATING, TIMESTAMP, USER, rank_rows, stable
from preflens.operators import candidates, features, rating, sequence, split, text, vectors
from preflens.plans import fixtures as fx
from preflens.plans.evaluation import rounded
from preflens.plans.fixtures import h, sql
from preflens.sources import ratings, records

QUERIES = {}
PAIR = '"userID", "itemID"'
VIEWS = {
    "behaviors": """SELECT l_orderkey AS imp, o_custkey AS "user", epoch(o_orderdate)::BIGINT AS "time", o_orderstatus AS status,
        coalesce(string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag = 'A'), '') AS clicks,
        string_agg(l_partkey || '-' || CAST(l_returnflag = 'R' AS INTEGER), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS impressions
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4""",
    "shown": """SELECT imp, "user", unnest(string_split(impressions, ' ')) AS x, unnest(range(len(string_split(impressions, ' ')))) AS pos
        FROM behaviors""",
    "lines": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount,
        CAST(l_quantity > 25 AS INTEGER) AS label FROM lineitem""",
    "steps": """SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp", event_id) AS pos,
        row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, event_id DESC) AS back FROM sequences""",
    "hist": """SELECT *, list("itemID") OVER w AS items, list("timestamp") OVER w AS times, list(cate) OVER w AS cates FROM sequences
        WINDOW w AS (PARTITION BY "userID" ORDER BY "timestamp", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "part_words": """SELECT p_partkey, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM
        (SELECT p_partkey, regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+') AS toks FROM part)""",
    "part_ids": """SELECT token, row_number() OVER (ORDER BY f) AS "index" FROM
        (SELECT token, min({'d': p_partkey, 'p': pos}) AS f FROM part_words GROUP BY 1)""",
    "part_arrays": """SELECT p.p_partkey, list(coalesce("index", 0) ORDER BY r.pos) AS a FROM part p CROSS JOIN range(3) r(pos)
        LEFT JOIN part_words w ON w.p_partkey = p.p_partkey AND w.pos = r.pos LEFT JOIN part_ids i ON i.token = w.token GROUP BY 1""",
}
_MAP = """SELECT value, row_number() OVER (ORDER BY value) AS code FROM (SELECT DISTINCT {0} AS value FROM lines)"""
VIEWS["flags"] = _MAP.format("l_returnflag")
VIEWS["statuses"] = _MAP.format("l_linestatus")
VIEWS["ffm"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(' ', label, '1:' || f.code || ':1',
      '2:' || (SELECT count(*) FROM flags) + s.code || ':1',
      '3:' || (SELECT count(*) FROM flags) + (SELECT count(*) FROM statuses) + 1 || ':' || l_suppkey,
      '4:' || (SELECT count(*) FROM flags) + (SELECT count(*) FROM statuses) + 2 || ':' || CAST(l_discount AS VARCHAR)) AS value
    FROM lines JOIN flags f ON f.value = l_returnflag JOIN statuses s ON s.value = l_linestatus"""


def add(name, text_=None, **views):
    def keep(run):
        QUERIES[name] = (run, sql(text_, **{**VIEWS, **views}) if text_ else None)
        return run

    return keep


def joined(name, out=None, sep=","):
    """An array column as text."""
    return F.array_join(F.col(name).cast("array<string>"), sep).alias(out or name)


# ---------------------------------------------------------------- ratings and items


@add("load_interactions", f"""SELECT CAST("userID" AS INTEGER) AS "userID", CAST("itemID" AS INTEGER) AS "itemID",
    CAST(rating AS FLOAT) AS rating, "timestamp" FROM interactions""")
def load_interactions(spark, sf):
    return ratings.cast_ratings(fx.interactions(spark, sf))


def _flags():
    return {f"g{i}": (F.pmod(F.col("p_partkey") * (i + 1) + F.col("p_size"), F.lit(5)) == 0).cast("int") for i in range(len(ratings.GENRES))}


@add("item_genres", "SELECT p_partkey, concat_ws('|', " + ", ".join(
    f"CASE WHEN (p_partkey * {i + 1} + p_size) % 5 = 0 THEN '{g.replace(chr(39), chr(39) * 2)}' END" for i, g in enumerate(ratings.GENRES)
) + ") AS genres FROM part")
def item_genres(spark, sf):
    part = fx.table(spark, sf, "part").withColumns(_flags())
    return part.select("p_partkey", ratings.genres(list(_flags())).alias("genres"))


@add("title_year", """SELECT p_partkey, p_name || ' (' || (1950 + p_size) || ')' AS title, CAST(1950 + p_size AS VARCHAR) AS "year" FROM part""")
def title_year(spark, sf):
    title = F.concat(F.col("p_name"), F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))
    part = fx.table(spark, sf, "part").select("p_partkey", title.alias("title"))
    return part.withColumn("year", ratings.title_year("title"))


@add("enrich_items", f"""SELECT {PAIR}, rating, p_name, p_brand FROM interactions LEFT JOIN part ON p_partkey = "itemID" """)
def enrich_items(spark, sf):
    items = fx.table(spark, sf, "part").select(F.col("p_partkey").alias(ITEM), "p_name", "p_brand")
    return ratings.enrich_items(fx.interactions(spark, sf), items).select(USER, ITEM, RATING, "p_name", "p_brand")


# ---------------------------------------------------------------- logs


def behaviors(spark, sf):
    """Orders as impressions: returned parts were clicked, accepted ones are the history."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    od = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    rows = li.join(od, F.col("l_orderkey") == F.col("o_orderkey"))
    cell = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lists = rows.groupBy("l_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").agg(F.sort_array(F.collect_list(cell)).alias("c"))
    clicked = F.transform(F.filter("c", lambda x: x["l_returnflag"] == "A"), lambda x: x["l_partkey"].cast("string"))
    mark = lambda x: F.concat(x["l_partkey"].cast("string"), F.when(x["l_returnflag"] == "R", "-1").otherwise("-0"))
    return lists.select(
        F.col("l_orderkey").alias("imp"), F.col("o_custkey").alias("user"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("time"),
        F.col("o_orderstatus").alias("status"), F.array_join(clicked, " ").alias("clicks"),
        F.array_join(F.transform("c", mark), " ").alias("impressions"),
    )


@add("parse_impressions", """SELECT imp, "user", replace(clicks, ' ', ',') AS clicks,
    array_to_string(list_transform(list_filter(string_split(impressions, ' '), lambda x: x LIKE '%-1'), lambda x: split_part(x, '-', 1)), ',') AS pos,
    array_to_string(list_transform(list_filter(string_split(impressions, ' '), lambda x: x LIKE '%-0'), lambda x: split_part(x, '-', 1)), ',') AS neg
    FROM behaviors""")
def parse_impressions(spark, sf):
    return records.parse_impressions(behaviors(spark, sf)).select("imp", "user", joined("clicks"), joined("pos"), joined("neg"))


@add("impression_rows", """SELECT imp, "user", pos, split_part(x, '-', 1) AS item, CAST(split_part(x, '-', 2) AS INTEGER) AS label FROM shown""")
def impression_rows(spark, sf):
    return records.impression_rows(behaviors(spark, sf))


@add("user_history", """SELECT CASE WHEN status = 'F' THEN 'train_' ELSE 'valid_' END || "user" AS "user",
    replace(arg_max(clicks, {'t': "time", 'i': imp}), ' ', ',') AS clicks FROM behaviors GROUP BY "user", status = 'F', CASE WHEN status = 'F' THEN 'train_' ELSE 'valid_' END""")
def user_history(spark, sf):
    b = behaviors(spark, sf)
    first = records.user_history(b.filter(F.col("status") == "F"), "train")
    return first.unionByName(records.user_history(b.filter(F.col("status") != "F"), "valid"))


@add("history_padded", """SELECT imp, array_to_string(list_concat(list_transform(range(5 - least(5, len(c))), lambda i: '0'), c[1:5]), ',') AS history
    FROM (SELECT imp, list_filter(string_split(clicks, ' '), lambda x: x <> '') AS c FROM behaviors)""")
def history_padded(spark, sf):
    parsed = records.parse_impressions(behaviors(spark, sf))
    out = parsed.withColumn("history", sequence.history_padded(parsed, "clicks", 5, "0"))
    return out.select("imp", joined("history"))


@add("json_project", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_project(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "props")
    return records.project_json(ev, "props", "k int")


@add("lower_strings", "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type FROM part")
def lower_strings(spark, sf):
    return records.lower_strings(fx.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"))


@add("clean_metadata", """SELECT doc_id, lang, source FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS b FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS a FROM documents) WHERE a = 1)) WHERE b = 1)
    WHERE text <> '' AND lang <> '' AND source <> '' AND length(trim(text)) > 0""")
def clean_metadata(spark, sf):
    docs = fx.table(spark, sf, "documents")
    kept = records.dedupe_then_dropna(docs, ["text", "n_chars"], ["text", "lang", "source"], "doc_id")
    return records.with_text(kept, "text", ["doc_id", "lang", "source"])


# ---------------------------------------------------------------- text exports


@add("export_vw_lines", f"""SELECT CAST(2 * round_even(CAST(floor(rating) AS BIGINT) / CAST(max(CAST(floor(rating) AS BIGINT)) OVER () AS DOUBLE), 0) - 1 AS BIGINT)
    || ' ' || (row_number() OVER (ORDER BY {PAIR}) - 1) || '|user ' || "userID" || ' |item ' || "itemID" AS value FROM train""")
def export_vw_lines(spark, sf):
    rows = rank_rows(fx.train(spark, sf), [], [(USER, True), (ITEM, True)], "row")
    return features.vw_lines(rows.withColumn("row", F.col("row") - 1), "row", USER, ITEM, RATING, logistic=True)


def _lines(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount",
        (F.col("l_quantity") > 25).cast("int").alias("label"),
    )


_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _ffm(spark, sf):
    return features.libffm_rows(_lines(spark, sf), ["l_returnflag", "l_linestatus", "l_suppkey", "l_discount"], "label", _KEY)


@add("libffm", "SELECT l_orderkey, l_linenumber, l_partkey, value FROM ffm")
def libffm(spark, sf):
    return _ffm(spark, sf)


@add("libffm_nulls", """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(' ', label, '1:' || f.code || ':1',
      '2:' || (SELECT count(*) FROM holes) + 1 || ':' || number) AS value FROM holed JOIN holes f ON f.value IS NOT DISTINCT FROM flag""",
     holed="""SELECT l_orderkey, l_linenumber, l_partkey, label, nullif(l_returnflag, 'N') AS flag,
       CASE WHEN l_suppkey % 3 <> 0 THEN l_suppkey END AS number FROM lines""",
     holes="SELECT value, row_number() OVER (ORDER BY value NULLS FIRST) AS code FROM (SELECT DISTINCT flag AS value FROM holed)")
def libffm_nulls(spark, sf):
    lines = _lines(spark, sf).withColumns({
        "flag": F.expr("nullif(l_returnflag, 'N')"), "number": F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))})
    return features.libffm_rows(lines, ["flag", "number"], "label", _KEY)


@add("parse_libffm", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(split_part(value, ' ', 1) AS DOUBLE) AS label, CAST(l_orderkey AS VARCHAR) AS impression,
    n - 2 AS field, CAST(split_part(split_part(value, ' ', n), ':', 2) AS BIGINT) - 1 AS "index",
    CAST(split_part(split_part(value, ' ', n), ':', 3) AS DOUBLE) AS value FROM ffm CROSS JOIN range(2, 6) r(n)""")
def parse_libffm(spark, sf):
    lines = _ffm(spark, sf).withColumn("value", F.concat("value", F.lit("%"), F.col("l_orderkey").cast("string")))
    parsed = features.parse_libffm(lines, "value", _KEY)
    return parsed.select(*_KEY, "label", "impression", F.explode("features").alias("_f")).select(*_KEY, "label", "impression", "_f.*")


@add("export_vectors", """SELECT vec_id || chr(9) || array_to_string(list_transform(v, lambda x: printf('%.4f', x)), ' ') AS value FROM vectors""")
def export_vectors(spark, sf):
    v = fx.vectors(spark, sf)
    return vectors.vector_lines(v.withColumn("v", F.transform("v", lambda x: F.format_string("%.4f", x))), "vec_id", "v")


# ---------------------------------------------------------------- sequences

_ORDER = [TIMESTAMP, "event_id"]


@add("instances", f"""SELECT 1 AS label, {PAIR}, "timestamp", coalesce(p_type, 'default_cat') AS cate FROM interactions LEFT JOIN part ON p_partkey = "itemID" """)
def instances(spark, sf):
    meta = fx.table(spark, sf, "part").select(F.col("p_partkey").alias(ITEM), F.col("p_type").alias("cate"))
    return sequence.instances(fx.interactions(spark, sf), meta)


def _history(spark, sf, **options):
    return sequence.expanding_history(fx.sequences(spark, sf), _ORDER, [ITEM, "cate", TIMESTAMP], **options)


@add("expanding_history", f"""SELECT event_id, {PAIR}, array_to_string(items, ',') AS items, array_to_string(cates, ',') AS cates FROM hist
    WHERE len(items) >= 1""")
def expanding_history(spark, sf):
    return _history(spark, sf).select("event_id", USER, ITEM, joined(f"history.{ITEM}", "items"), joined("history.cate", "cates"))


@add("recent_history", f"""SELECT event_id, {PAIR}, array_to_string(items[-10:], ',') AS items FROM hist WHERE len(items) >= 1""")
def recent_history(spark, sf):
    return _history(spark, sf, max_len=10).select("event_id", USER, ITEM, joined(f"history.{ITEM}", "items"))


def _parted(spark, sf):
    return split.leave_last_out(fx.sequences(spark, sf), _ORDER, min_rows=1)


@add("final_history", """SELECT event_id, part, array_to_string(items, ',') AS items FROM (
      SELECT h.event_id, items, CASE s.back WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS part
      FROM hist h JOIN steps s ON s.event_id = h.event_id WHERE s.back <= 3) WHERE len(items) >= 1""")
def final_history(spark, sf):
    out = sequence.final_history(_parted(spark, sf), _ORDER, [ITEM])
    return out.select("event_id", "part", joined(f"history.{ITEM}", "items"))


_DAYS = "ln(greatest(({}) / 86400.0::DOUBLE, 0.5))"
_TIMES = {
    "time_diff": "list_transform(range(1, len(times) + 1), lambda i: " + _DAYS.format('coalesce(times[i + 1], "timestamp") - times[i]') + ")",
    "time_from_first": "list_transform(range(1, len(times) + 1), lambda i: " + _DAYS.format('coalesce(times[i + 1], "timestamp") - times[1]') + ")",
    "time_to_now": "list_transform(times, lambda t: " + _DAYS.format('"timestamp" - t') + ")",
}
for _name, _expr in _TIMES.items():
    def _time(spark, sf, name=_name):
        out = _history(spark, sf).withColumn("times", F.col(f"history.{TIMESTAMP}"))
        out = out.withColumn("v", getattr(sequence, name)("times", TIMESTAMP))
        return rounded(out.select("event_id", F.posexplode("v").alias("place", "value")), "value")

    add(_name, f"""SELECT event_id, CAST(p - 1 AS INTEGER) AS place, round(v[p], 6) AS value FROM (
        SELECT event_id, v, unnest(range(1, len(v) + 1)) AS p FROM (SELECT event_id, {_expr} AS v FROM hist WHERE len(times) >= 1))""")(_time)


@add("pad_sequences", """SELECT event_id, array_to_string(list_concat(items[-20:], list_transform(range(20 - least(20, len(items))), lambda i: 0::BIGINT)), ',') AS items,
      least(20, len(items)) AS used FROM hist WHERE len(items) >= 3""")
def pad_sequences(spark, sf):
    out = _history(spark, sf).withColumn("items", F.col(f"history.{ITEM}"))
    out = sequence.pad_sequences(out, "items", 20, fill=0, min_len=3)
    used = F.aggregate("items_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("event_id", joined("items"), used.alias("used"))


@add("next_item_rows", f"""SELECT n."userID", n.slot, n.input, n.pos, p."itemID" AS neg FROM draws n
    JOIN (SELECT "itemID", row_number() OVER (ORDER BY "itemID") - 1 AS idx FROM (SELECT DISTINCT "itemID" FROM train)) p
    ON p.idx = n.p + (SELECT count(*) FROM taken t WHERE t."userID" = n."userID" AND t.t <= n.p)""",
     recent="""SELECT "userID", "itemID", lag("itemID") OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID" DESC) AS nxt,
       row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID" DESC) AS back FROM train""",
     taken="""SELECT s."userID", idx - (row_number() OVER (PARTITION BY s."userID" ORDER BY idx) - 1) AS t FROM train s JOIN
       (SELECT "itemID", row_number() OVER (ORDER BY "itemID") - 1 AS idx FROM (SELECT DISTINCT "itemID" FROM train)) p ON p."itemID" = s."itemID" """,
     draws=f"""SELECT r."userID", CAST(11 - back AS INTEGER) AS slot, "itemID" AS input, nxt AS pos, CAST(floor({h('42', 'r."userID"', '(back - 2)')}
       * ((SELECT count(DISTINCT "itemID") FROM train) - n)) AS BIGINT) AS p FROM recent r
       JOIN (SELECT "userID", count(*) AS n FROM train GROUP BY 1) c ON c."userID" = r."userID" WHERE back BETWEEN 2 AND 11""")
def next_item_rows(spark, sf):
    return sequence.next_item_rows(fx.train(spark, sf), [TIMESTAMP, ITEM], 10)


@add("attach_item_arrays", f"""SELECT {PAIR}, array_to_string(a, ',') AS item_array, array_to_string(list_transform(range(1, 4), lambda i:
      coalesce(array_to_string(past[i], ','), '0,0,0')), ';') AS history_arrays
    FROM test JOIN part_arrays c ON c.p_partkey = "itemID" JOIN (
      SELECT "userID" AS u, list(a ORDER BY back DESC) AS past FROM (
        SELECT *, row_number() OVER (PARTITION BY "userID" ORDER BY "timestamp" DESC, "itemID" DESC) AS back FROM train)
      JOIN part_arrays ON p_partkey = "itemID" WHERE back <= 3 GROUP BY 1) ON u = "userID" """)
def attach_item_arrays(spark, sf):
    names = fx.table(spark, sf, "part").select(F.col("p_partkey").alias(ITEM), text.words("p_name").alias("tokens"))
    arrays = text.padded_indices(names, ITEM, "tokens", text.word_index(names, ITEM, "tokens"), 3)
    out = sequence.attach_item_arrays(fx.test(spark, sf).select(USER, ITEM), fx.train(spark, sf), arrays, [TIMESTAMP, ITEM], 3, 3)
    past = F.array_join(F.transform("history_arrays", lambda a: F.array_join(a.cast("array<string>"), ",")), ";")
    return out.select(USER, ITEM, joined("item_array"), past.alias("history_arrays"))


# ---------------------------------------------------------------- encoders


@add("fold_rare", """SELECT CASE WHEN r <= floor(total * 0.99::DOUBLE) AND n > 30 THEN CAST(l_partkey AS VARCHAR) ELSE '<LESS>' END AS value,
      CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey) AS r, count(*) OVER () AS total
      FROM (SELECT l_partkey, count(*) AS n FROM lines GROUP BY 1)) GROUP BY 1""")
def fold_rare(spark, sf):
    rows = _lines(spark, sf)
    folded = features.fold_rare(rows, "l_partkey", features.frequent_values(rows, "l_partkey", 30))
    return folded.groupBy(F.col("l_partkey").alias("value")).agg(F.count(F.lit(1)).alias("n"))


_CODES = "SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) AS code FROM part GROUP BY 1"


@add("ordinal_encode", "SELECT p_partkey, code FROM part JOIN codes USING (p_type)", codes=_CODES)
def ordinal_encode(spark, sf):
    part = fx.table(spark, sf, "part")
    return features.ordinal_encode(part, "p_type", features.ordinal_map(part, "p_type", ["p_partkey"])).select("p_partkey", "code")


@add("bit_encode", "SELECT p_partkey, code, " + ", ".join(f"CAST((code >> {j}) & 1 AS INTEGER) AS bit{j}" for j in range(6))
     + " FROM part JOIN codes USING (p_type)", codes=_CODES)
def bit_encode(spark, sf):
    return features.bit_encode(ordinal_encode(spark, sf), "code", 6)


@add("target_encode", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(s / nullif(c, 0), 0), 6) AS t_mean,
      round(coalesce(c / nullif(i, 0), 0), 6) AS t_count FROM (
        SELECT *, coalesce(sum(label) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS s,
          count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS c,
          row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i
        FROM lines WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))""")
def target_encode(spark, sf):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    out = features.target_encode(_lines(spark, sf), "l_suppkey", "label", order)
    return rounded(out.select(*order, "t_mean", "t_count"), "t_mean", "t_count")


@add("target_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS t_mean, round(c, 6) AS t_count FROM lines JOIN
    (SELECT l_suppkey AS k, avg(label) AS m, count(*) / CAST((SELECT count(*) FROM lines) AS DOUBLE) AS c FROM lines GROUP BY 1) ON k = l_suppkey""")
def target_lookup(spark, sf):
    rows = _lines(spark, sf)
    out = features.target_lookup(rows, rows, "l_suppkey", "label")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t_mean", "t_count"), "t_mean", "t_count")


@add("encode_test", """SELECT "userID", "itemID", coalesce(code, -1) AS code, round(coalesce(m, 0), 6) AS t_mean, round(coalesce(c, 0), 6) AS t_count,
      round(coalesce(number, (SELECT avg(number) FROM coded)), 6) AS number FROM coded_test t
      LEFT JOIN (SELECT cat, row_number() OVER (ORDER BY min((\"userID\", \"itemID\"))) AS code FROM coded GROUP BY 1) o ON o.cat = t.cat
      LEFT JOIN (SELECT cat, avg(CAST(rating > 25 AS INTEGER)) AS m, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS c
        FROM coded GROUP BY 1) s ON s.cat = t.cat""".replace('\\"', '"'),
     kept="""SELECT cat FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cat) AS r, count(*) OVER () AS total FROM
       (SELECT "itemID" % 50 AS cat, count(*) AS n FROM train GROUP BY 1)) WHERE r <= floor(total * 0.99::DOUBLE) AND n > 10""",
     coded="""SELECT "userID", "itemID", rating, CASE WHEN "itemID" % 50 IN (SELECT cat FROM kept) THEN CAST("itemID" % 50 AS VARCHAR) ELSE '<LESS>' END AS cat,
       CASE WHEN "itemID" % 3 <> 0 THEN CAST("itemID" AS DOUBLE) END AS number FROM train""",
     coded_test="""SELECT "userID", "itemID", CASE WHEN "itemID" % 60 IN (SELECT cat FROM kept) THEN CAST("itemID" % 60 AS VARCHAR) ELSE '<LESS>' END AS cat,
       CASE WHEN "itemID" % 3 <> 0 THEN CAST("itemID" AS DOUBLE) END AS number FROM test""")
def encode_test(spark, sf):
    """Encoders made from train, applied to test, where some values are new."""
    number = F.when(F.col(ITEM) % 3 != 0, F.col(ITEM).cast("double"))
    train = fx.train(spark, sf).select(USER, ITEM, RATING, (F.col(ITEM) % 50).alias("cat"), number.alias("number"))
    test = fx.test(spark, sf).select(USER, ITEM, (F.col(ITEM) % 60).alias("cat"), number.alias("number"))
    kept = features.frequent_values(train, "cat", 10)
    filled = features.fill_mean(features.fold_rare(test, "cat", kept), "number", train)
    folded = features.fold_rare(train, "cat", kept).withColumn("label", (F.col(RATING) > 25).cast("int"))
    out = features.ordinal_encode(filled, "cat", features.ordinal_map(folded, "cat", [USER, ITEM]))
    out = features.target_lookup(folded, out, "cat", "label")
    return rounded(out.select(USER, ITEM, "code", "t_mean", "t_count", "number"), "t_mean", "t_count", "number")


@add("cross_hash", f'SELECT {PAIR}, CAST(floor({h("42", PAIR)} * 1000) AS INTEGER) AS "cross" FROM interactions')
def cross_hash(spark, sf):
    return features.cross_hash(fx.interactions(spark, sf), [USER, ITEM]).select(USER, ITEM, "cross")


@add("param_grid")
def param_grid(spark, sf):
    # Read in every round, so made once; predictions are read by the report and the count.
    train, test = (stable(part.select(USER, ITEM, RATING)) for part in (fx.train(spark, sf), fx.test(spark, sf)))

    def evaluate(rank, reg):
        pred = stable(candidates.als_predict(train, test, rank=rank, reg=reg))
        report = rating.rating_report(test, pred, ["rmse", "mae"], prediction=PREDICTION)
        return rounded(report.withColumn("n", pred.agg(F.count(F.lit(1))).scalar()), "rmse", "mae", digits=4)

    return features.sweep(features.parameter_grid({"rank": [4, 8], "reg": [0.05, 0.2]}), evaluate)


@add("param_grid_shape", """SELECT rank, reg, true AS fits, (SELECT count(*) FROM test WHERE "userID" IN (SELECT "userID" FROM train)
      AND "itemID" IN (SELECT "itemID" FROM train)) AS n FROM (VALUES (4, 0.05::DOUBLE), (4, 0.2::DOUBLE), (8, 0.05::DOUBLE), (8, 0.2::DOUBLE)) t(rank, reg)""")
def param_grid_shape(spark, sf):
    """One report per parameter set: as many scored pairs as have a known user and item, with errors that fit each other."""
    return param_grid(spark, sf).select("rank", "reg", ((F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0)).alias("fits"), "n")
