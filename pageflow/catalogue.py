"""Queries of the library's own operators on the shared test tables, and the same in DuckDB SQL.

The tables hold no scanned pages, so pages, boxes, characters, recognitions and pixels are derived from them by integer
arithmetic that any engine computes alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stages
from .functions import arrays, geometry, numbers, text
from .operators import confidence, datasets, decode, detect, evalstats, image_quality, layout, lm, raster, recognise, restoration, tiling
from .sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- derived frames -------------------------------------------------------------------------------------------------

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
BOX = f"""box AS (SELECT l_orderkey // 32 AS page, (row_number() OVER (PARTITION BY l_orderkey // 32 ORDER BY {_KEY}) - 1)::INT AS idx, ((l_partkey * 37) % 600)::INT AS x1, ((l_suppkey * 53 + l_linenumber * 101) % 600)::INT AS y1,
 ((l_partkey * 37) % 600 + 20 + floor(l_quantity))::INT AS x2, ((l_suppkey * 53 + l_linenumber * 101) % 600 + 20 + l_partkey % 41)::INT AS y2, l_extendedprice AS score, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, chr((12354 + l_partkey % 80)::INT) AS char FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """page, idx, corners, score, char from lineitem; about 128 boxes a page at every scale."""
    order = Window.partitionBy("page").orderBy(*_KEY.split(", "))
    raw = _table(spark, d, "lineitem").withColumn("page", F.expr("l_orderkey div 32"))
    x1, y1 = (F.col("l_partkey") * 37) % 600, (F.col("l_suppkey") * 53 + F.col("l_linenumber") * 101) % 600
    notation = F.concat(F.lit("U+"), F.hex(12354 + F.col("l_partkey") % 80))
    return raw.select(
        "page", (F.row_number().over(order) - 1).alias("idx"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), (x1 + 20 + F.floor("l_quantity")).cast("int").alias("x2"),
        (y1 + 20 + F.col("l_partkey") % 41).cast("int").alias("y2"), F.col("l_extendedprice").alias("score"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), text.code_point_char(notation).alias("char"),
    )


REC = "rec AS (SELECT user_id AS folder, event_id AS pos, event_type AS char, value / 500 AS prob FROM events)"


def recognitions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("user_id").alias("folder"), F.col("event_id").alias("pos"), F.col("event_type").alias("char"), (F.col("value") / 500).alias("prob"))


DEC = f"""{BOX}, dec AS (SELECT page, idx AS pos, chr((12354 + part % 80)::INT) AS gt, chr((12354 + CASE WHEN part % 7 = 0 THEN (part + 1) % 80 ELSE part % 80 END)::INT) AS greedy, chr((12354 + CASE WHEN (part + line) % 11 = 0 THEN (part + 2) % 80 ELSE part % 80 END)::INT) AS lm,
 chr((12354 + CASE WHEN (part + line) % 13 = 0 THEN (part + 2) % 80 ELSE part % 80 END)::INT) AS final, [chr((12354 + (part + (j * supp) % 5) % 80)::INT) FOR j IN [0, 1, 2, 3, 4]] AS topk_chars FROM box)"""


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """Characters with a true, a greedy, an LM and a final reading, and five candidates."""
    ch = lambda n: text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + n)))
    p, m, s = F.col("part"), F.col("line"), F.col("supp")
    pick = lambda wrong, k: ch(F.when(wrong, (p + k) % 80).otherwise(p % 80))
    top = F.array(*[ch((p + (j * s) % 5) % 80) for j in range(5)])
    return boxes(spark, d).select("page", F.col("idx").alias("pos"), ch(p % 80).alias("gt"), pick(p % 7 == 0, 1).alias("greedy"), pick((p + m) % 11 == 0, 2).alias("lm"), pick((p + m) % 13 == 0, 2).alias("final"), top.alias("topk_chars"))


PIX = f"pix AS (SELECT page AS image, (idx // 16)::INT AS y, (idx % 16)::INT AS x, (part % 256)::INT AS r, ((part * 7 + supp) % 256)::INT AS g, ((supp * 13 + line * 29) % 256)::INT AS b FROM box)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Small images, 16 pixels wide, from lineitem."""
    p, s, m = F.col("part"), F.col("supp"), F.col("line")
    return boxes(spark, d).select(F.col("page").alias("image"), F.floor(F.col("idx") / 16).cast("int").alias("y"), (F.col("idx") % 16).alias("x"), (p % 256).cast("int").alias("r"), ((p * 7 + s) % 256).cast("int").alias("g"), ((s * 13 + m * 29) % 256).cast("int").alias("b"))


SIZES = "sizes AS (SELECT p_partkey AS page, (500 + p_size * 37)::INT AS width, (400 + (p_partkey * 53) % 1700)::INT AS height FROM part)"


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").alias("page"), (500 + F.col("p_size") * 37).cast("int").alias("width"), (400 + (F.col("p_partkey") * 53) % 1700).cast("int").alias("height"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- confidence -----------------------------------------------------------------------------------------------------


@query(f"WITH {REC} SELECT count(*) AS total, count(DISTINCT char) AS distinct_chars, max(prob) AS max_conf, min(prob) AS min_conf, round(avg(prob), 6) AS mean_conf, round(median(prob), 6) AS median_conf, round(stddev_samp(prob), 6) AS std_conf FROM rec")
def conf_summary(spark, d):
    return _r(confidence.summary(recognitions(spark, d)), "mean_conf", "median_conf", "std_conf")


@query(f"""WITH {REC}, b(bin) AS (VALUES ('0.9-1.0'), ('0.8-0.9'), ('0.7-0.8'), ('0.6-0.7'), ('0.5-0.6'), ('0.0-0.5')),
c AS (SELECT CASE WHEN prob >= 0.9 THEN '0.9-1.0' WHEN prob >= 0.8 THEN '0.8-0.9' WHEN prob >= 0.7 THEN '0.7-0.8' WHEN prob >= 0.6 THEN '0.6-0.7' WHEN prob >= 0.5 THEN '0.5-0.6' ELSE '0.0-0.5' END AS bin, count(*) AS n FROM rec GROUP BY 1)
SELECT bin, coalesce(n, 0)::BIGINT AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM rec), 6)::DOUBLE AS percent FROM b LEFT JOIN c USING (bin)""")
def conf_histogram(spark, d):
    return _r(confidence.histogram(recognitions(spark, d)), "percent")


_FOLDER = "f AS (SELECT folder, count(*) AS n, round(avg(prob), 6) AS mean_conf, min(prob) AS min_conf, max(prob) AS max_conf FROM rec GROUP BY folder)"


@query(f"WITH {REC}, {_FOLDER} SELECT * FROM f ORDER BY n DESC, folder LIMIT 20")
def conf_by_folder_top20(spark, d):
    return _r(confidence.largest_folders(recognitions(spark, d)), "mean_conf")


@query(f"WITH {REC}, {_FOLDER} SELECT * FROM f ORDER BY min_conf, folder LIMIT 10")
def conf_worst10_folders(spark, d):
    return _r(confidence.weakest_folders(recognitions(spark, d)), "mean_conf")


@query(f"WITH {REC} SELECT * FROM rec WHERE prob < 0.5 ORDER BY prob, folder, pos LIMIT 30")
def low_conf_sorted30(spark, d):
    return confidence.low_confidence(recognitions(spark, d)).orderBy("prob", "folder", "pos").limit(30)


@query(f"WITH {REC} SELECT * FROM rec WHERE prob < 0.5 ORDER BY folder, pos LIMIT 30")
def low_conf_scan30(spark, d):
    return confidence.low_confidence(recognitions(spark, d)).orderBy("folder", "pos").limit(30)


@query(f"WITH {REC} SELECT count(*) FILTER (WHERE prob < 0.5) AS low, count(*) AS total, round(100.0 * count(*) FILTER (WHERE prob < 0.5) / count(*), 6)::DOUBLE AS percent FROM rec")
def low_conf_share(spark, d):
    return _r(confidence.low_confidence_share(recognitions(spark, d)), "percent")


@query(f"WITH {REC} SELECT char, count(*) AS n, round(avg(prob), 6) AS mean_conf, min(prob) AS min_conf, max(prob) AS max_conf FROM rec GROUP BY char")
def char_confidence(spark, d):
    return _r(confidence.by_char(recognitions(spark, d)), "mean_conf")


_CHARS = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS char, unnest(range(length(text))) AS pos FROM documents WHERE text <> '')"


def doc_chars(spark, d) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(text.characters(F.col("text"))).alias("pos", "char"))


@query("""WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text <> ''), chars AS (SELECT doc_id, unnest(range(len(cs))) AS pos, unnest(cs) AS char FROM c),
t AS (SELECT char, count(*) AS n, min(doc_id * 100000000 + pos) AS seen FROM chars GROUP BY char)
SELECT char, n, round(100.0 * n / (SELECT sum(n) FROM t), 6)::DOUBLE AS percent, (row_number() OVER (ORDER BY n DESC, seen))::INT AS rank FROM t ORDER BY n DESC, seen LIMIT 30""")
def char_freq_top30(spark, d):
    return _r(confidence.most_common(doc_chars(spark, d).select("char", (F.col("doc_id") * 100_000_000 + F.col("pos")).alias("ordinal")), 30), "percent")


@query("SELECT count(DISTINCT c) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')")
def distinct_chars(spark, d):
    return doc_chars(spark, d).agg(F.countDistinct("char").alias("n"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.char'), '?') AS char, coalesce(CAST(json_extract(props, '$.prob') AS DOUBLE), 0.0) AS prob, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_defaults(spark, d):
    parsed = _table(spark, d, "events").select("event_id", F.from_json("props", "char string, prob double, k bigint").alias("p"))
    return confidence.with_defaults(parsed.select("event_id", "p.char", "p.prob", F.coalesce("p.k", F.lit(-1)).alias("k")))


@query(f"WITH {REC}, f AS (SELECT DISTINCT folder FROM rec), a AS (SELECT c_custkey AS folder FROM customer UNION SELECT folder FROM f) SELECT a.folder, CASE WHEN f.folder IS NULL THEN 'failed' ELSE 'ok' END AS status FROM a LEFT JOIN f USING (folder)")
def folder_status(spark, d):
    """The listed folders are all customers and all folders with results."""
    rec = recognitions(spark, d)
    listed = _table(spark, d, "customer").select(F.col("c_custkey").alias("folder")).unionByName(rec.select("folder")).distinct()
    return confidence.folder_status(listed, rec)


@query(f"""WITH {REC}, {_FOLDER}, s AS (SELECT count(*) AS total, count(DISTINCT char) AS distinct_chars, round(avg(prob), 6) AS mean_conf, round(median(prob), 6) AS median_conf, count(*) FILTER (WHERE prob >= 0.9) AS top_bin FROM rec),
l AS (SELECT list(folder ORDER BY n DESC, folder) AS largest FROM (SELECT * FROM f ORDER BY n DESC, folder LIMIT 20)), w AS (SELECT list(folder ORDER BY min_conf, folder) AS weakest FROM (SELECT * FROM f ORDER BY min_conf, folder LIMIT 10)),
c AS (SELECT list(char ORDER BY n DESC, first) AS chars FROM (SELECT char, count(*) AS n, min({{'f': folder, 'p': pos}}) AS first FROM rec GROUP BY char ORDER BY n DESC, first LIMIT 30)), o AS (SELECT list(pos ORDER BY folder, pos) AS low FROM (SELECT * FROM rec WHERE prob < 0.5 ORDER BY folder, pos LIMIT 30))
SELECT * FROM s, l, w, c, o""")
def confidence_report(spark, d):
    """The report's document, read again."""
    listed = "array<struct<folder:bigint>>"
    schema = f"summary struct<total:bigint,distinct_chars:bigint,mean_conf:double,median_conf:double>, bins array<struct<bin:string,n:bigint>>, largest_folders {listed}, weakest_folders {listed}, most_common array<struct<char:string,rank:int>>, low_confidence array<struct<folder:bigint,pos:bigint>>"
    r = confidence.report(recognitions(spark, d)).select(F.from_json("report", schema).alias("r")).select("r.*")
    chars = F.transform(F.array_sort("most_common", lambda a, b: a["rank"] - b["rank"]), lambda c: c["char"])
    top = F.get(F.filter("bins", lambda b: b["bin"] == "0.9-1.0"), F.lit(0))["n"]
    low = F.transform(F.sort_array("low_confidence"), lambda x: x["pos"])
    out = r.select("summary.*", top.alias("top_bin"), F.col("largest_folders.folder").alias("largest"), F.col("weakest_folders.folder").alias("weakest"), chars.alias("chars"), low.alias("low"))
    return _r(out, "mean_conf", "median_conf")


# --- layout and tiles -----------------------------------------------------------------------------------------------

_ORDER = f"""{BOX}, m AS (SELECT page, greatest(floor(median(greatest(1, x2 - x1)) * 0.8)::INT, 5) AS gap FROM box GROUP BY page),
a AS (SELECT box.*, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, gap FROM box JOIN m USING (page)),
n AS (SELECT *, CASE WHEN abs(cx - lag(cx) OVER w) > gap THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY page ORDER BY cx DESC, idx)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY cx DESC, idx ROWS UNBOUNDED PRECEDING)::INT AS col_id FROM n),
ordered AS (SELECT page, idx, x1, y1, x2, y2, char, part, supp, line, col_id, (row_number() OVER (PARTITION BY page ORDER BY col_id, cy, idx) - 1)::INT AS pos FROM c)"""


@query(f"WITH {_ORDER} SELECT page, idx, col_id, pos FROM ordered")
def reading_order(spark, d):
    return layout.reading_order(boxes(spark, d)).select("page", "idx", "col_id", "pos")


def _islands_sql(a: str, b: str) -> str:
    return f"""WITH {BOX}, t AS (SELECT page, {a} * 16 AS s, {a} * 16 + {b} - {a} AS e FROM box), m AS (SELECT page, s, e, CASE WHEN s > max(e) OVER (PARTITION BY page ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM t WHERE e > s),
i AS (SELECT *, sum(nw) OVER (PARTITION BY page ORDER BY s, e ROWS UNBOUNDED PRECEDING)::INT AS island FROM m)
SELECT page, island, min(s) AS start, max(e) AS "end", count(*) AS members FROM i GROUP BY page, island"""


def _spread(spark, d, a: str, b: str) -> DataFrame:
    """Boxes of their own size on a page sixteen times as long, so that there are gaps."""
    return boxes(spark, d).select("page", (F.col(a) * 16).alias("s"), (F.col(a) * 16 + F.col(b) - F.col(a)).alias("e"))


@query(_islands_sql("y1", "y2"))
def projection_islands_y(spark, d):
    return layout.islands(_spread(spark, d, "y1", "y2"), ["page"], "s", "e")


@query(_islands_sql("x1", "x2"))
def projection_islands_x(spark, d):
    return layout.islands(_spread(spark, d, "x1", "x2"), ["page"], "s", "e")


@query()
def xy_cut_order(spark, d):
    return layout.xy_cut(boxes(spark, d))


_RAW = f"""{BOX}, raw AS (SELECT page, idx, (part * 37 % 1300) / 2.0 - 20 AS x, (supp * 53 % 1300) / 2.0 - 20 AS y, (part % 90) / 2.0 AS w, (supp % 90) / 2.0 AS h FROM box),
l AS (SELECT page, idx, x, y, w, h, least(greatest(round_even(x, 0)::INT, 0), 599) AS x1, least(greatest(round_even(y, 0)::INT, 0), 599) AS y1 FROM raw),
clamped AS (SELECT page, idx, x1, y1, greatest(least(round_even(x + w, 0)::INT, 600), x1 + 1) AS x2, greatest(least(round_even(y + h, 0)::INT, 600), y1 + 1) AS y2 FROM l)"""


def _clamped(spark, d) -> DataFrame:
    raw = boxes(spark, d).select("page", "idx", ((F.col("part") * 37 % 1300) / 2.0 - 20).alias("x"), ((F.col("supp") * 53 % 1300) / 2.0 - 20).alias("y"), ((F.col("part") % 90) / 2.0).alias("w"), ((F.col("supp") % 90) / 2.0).alias("h"))
    return raw.select("page", "idx", *[c.alias(n) for n, c in geometry.clamp_box(*[F.col(c) for c in "xywh"], F.lit(600), F.lit(600)).items()])


@query(f"WITH {_RAW} SELECT * FROM clamped")
def clamp_boxes(spark, d):
    return _clamped(spark, d)


@query(f"WITH {_RAW} SELECT page, printf('char_%04d.png', idx) AS char_id, x2 - x1 AS width, y2 - y1 AS height FROM clamped WHERE x2 - x1 >= 2 AND y2 - y1 >= 2")
def min_size_crops(spark, d):
    sized = _clamped(spark, d).select("page", F.format_string("char_%04d.png", F.col("idx")).alias("char_id"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return sized.where("width >= 2 AND height >= 2")


def _tiles_sql(pad: int) -> str:
    return f"""WITH {SIZES}, s AS (SELECT page, width + {2 * pad} AS w, height + {2 * pad} AS h FROM sizes), n AS (SELECT *, ceil(greatest(w - 640, 0) / 320.0)::INT AS nx, ceil(greatest(h - 640, 0) / 320.0)::INT AS ny FROM s),
y AS (SELECT *, unnest(range(ny + 1)) AS j FROM n), x AS (SELECT *, unnest(range(nx + 1)) AS i FROM y)
SELECT page, (j * (nx + 1) + i)::INT AS tile_idx, (i * 320 - {pad})::INT AS x0, (j * 320 - {pad})::INT AS y0, least(640, w - i * 320)::INT AS w, least(640, h - j * 320)::INT AS h FROM x"""


@query(_tiles_sql(320))
def tiles_padded(spark, d):
    return tiling.tiles(page_sizes(spark, d), pad=320)


@query(_tiles_sql(0))
def tiles_plain(spark, d):
    return tiling.tiles(page_sizes(spark, d))


@query(f"WITH {SIZES}, y AS (SELECT *, unnest(range(0, height, 64)) AS y0 FROM sizes), x AS (SELECT *, unnest(range(0, width, 64)) AS x0 FROM y) SELECT page, x0::INT AS x0, y0::INT AS y0, least(128, width - x0)::INT AS w, least(128, height - y0)::INT AS h FROM x")
def uniform_patches(spark, d):
    return tiling.uniform_patches(page_sizes(spark, d))


def _starts_sql(size: str) -> str:
    return f"list_distinct([greatest(0, least(i * coalesce(ceil(({size} - 500) / nullif(ceil({size} / 500.0) - 1, 0))::INT, 0), {size} - 500)) FOR i IN range(greatest(ceil({size} / 500.0)::INT, 1))])"


@query(f"WITH {SIZES}, y AS (SELECT *, unnest({_starts_sql('height')}) AS y0 FROM sizes) SELECT page, unnest({_starts_sql('width')})::INT AS x0, y0::INT AS y0 FROM y")
def adaptive_grid(spark, d):
    return tiling.adaptive_grid(page_sizes(spark, d), 500)


@query(f"""WITH {BOX}, g AS (SELECT page, idx, x1 * 2 AS x1, y1 * 2 AS y1, x2 * 2 AS x2, y2 * 2 AS y2 FROM box), t AS (SELECT (j * 3 + i)::INT AS tile_idx, i * 320 AS x0, j * 320 AS y0 FROM (SELECT unnest(range(3)) AS j), (SELECT unnest(range(3)) AS i)),
m AS (SELECT page, idx, tile_idx, greatest(x1 - x0, 0)::INT AS tx1, greatest(y1 - y0, 0)::INT AS ty1, least(x2 - x0, least(640, 1280 - x0))::INT AS tx2, least(y2 - y0, least(640, 1280 - y0))::INT AS ty2 FROM g, t
 WHERE (x1 + x2) / 2.0 >= x0 AND (x1 + x2) / 2.0 < x0 + least(640, 1280 - x0) AND (y1 + y2) / 2.0 >= y0 AND (y1 + y2) / 2.0 < y0 + least(640, 1280 - y0))
SELECT *, [tx1, ty1, tx2, ty1, tx2, ty2, tx1, ty2] AS polygon FROM m WHERE tx2 - tx1 >= 2 AND ty2 - ty1 >= 2""")
def tile_box_clip(spark, d):
    g = boxes(spark, d).select("page", "idx", *[(F.col(c) * 2).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(1280).alias("width"), F.lit(1280).alias("height"))
    placed = tiling.tiles_of_boxes(g).select("page", "idx", "tile_idx", *[F.col(c).cast("int").alias(c) for c in ("tx1", "ty1", "tx2", "ty2")])
    return placed.withColumn("polygon", geometry.polygon({k: F.col(f"t{k}") for k in ("x1", "y1", "x2", "y2")}))


@query(f"""WITH {BOX}, z AS (SELECT page, idx, x1, y1, x2, y2, 500 + part % 140 AS w, 500 + supp % 140 AS h FROM box)
SELECT page, idx FROM z WHERE floor((x1 + x2) / 2.0) BETWEEN floor(w * 0.25) AND floor(w * 0.75) AND floor((y1 + y2) / 2.0) BETWEEN floor(h * 0.25) AND floor(h * 0.75) AND x1 >= 0 AND y1 >= 0 AND x2 <= 560 AND y2 <= 560 AND x1 < x2 AND y1 < y2""")
def centre_zone_filter(spark, d):
    z = boxes(spark, d).withColumns({"w": 500 + F.col("part") % 140, "h": 500 + F.col("supp") % 140})
    return tiling.within_page(tiling.centre_zone(z), F.lit(560), F.lit(560)).select("page", "idx")


# --- detection ------------------------------------------------------------------------------------------------------

_IOU = "CASE WHEN least({a}x2, {b}x2) > greatest({a}x1, {b}x1) AND least({a}y2, {b}y2) > greatest({a}y1, {b}y1) THEN (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))::DOUBLE / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))) ELSE 0 END"


@query(f"""WITH {BOX}, g AS (SELECT page, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'idx': idx}} ORDER BY score DESC, idx) AS bs FROM box GROUP BY page),
k AS (SELECT page, unnest(list_reduce(bs[2:], lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {_IOU.format(a='k.', b='b.')} > 0.45)) > 0 THEN acc ELSE list_append(acc, b) END, bs[:1])) AS b FROM g)
SELECT page, b.idx AS idx, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM k""")
def nms_keep(spark, d):
    return detect.suppress(boxes(spark, d), ["page"], 0.45).select("page", "idx", "x1", "y1", "x2", "y2")


_MATCH = f"""{BOX}, t AS (SELECT page, idx, x1, y1, x2, y2, char FROM box WHERE part % 2 = 1), p AS (SELECT page, idx, x1 + part % 5 AS x1, y1 + supp % 5 AS y1, x2 + part % 5 AS x2, y2 + supp % 5 AS y2, chr((12354 + (part - (supp % 3 > 0)::INT) % 80)::INT) AS char, score / 110000 AS conf FROM box WHERE part % 2 = 0 OR part % 3 = 1),
pairs AS (SELECT t.page, t.idx AS t_idx, t.char AS t_char, p.idx AS p_idx, p.char AS p_char, p.conf AS p_conf, {_IOU.format(a='t.', b='p.')} AS iou FROM t JOIN p ON t.page = p.page AND t.x1 < p.x2 AND p.x1 < t.x2 AND t.y1 < p.y2 AND p.y1 < t.y2),
best AS (SELECT * FROM pairs WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY page, t_idx ORDER BY iou DESC, p_idx) = 1)"""


def _matching(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = boxes(spark, d)
    part, supp = F.col("part"), F.col("supp")
    shift = {"x1": part % 5, "y1": supp % 5, "x2": part % 5, "y2": supp % 5}
    t = b.where("part % 2 = 1").select("page", "idx", "x1", "y1", "x2", "y2", "char")
    char = text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + (part - (supp % 3 > 0).cast("int")) % 80)))
    p = b.where("part % 2 = 0 OR part % 3 = 1").select("page", "idx", *[(F.col(c) + s).cast("int").alias(c) for c, s in shift.items()], char.alias("char"), (F.col("score") / 110000).alias("conf"))
    return t, p, detect.candidate_pairs(t, p)


@query(f"WITH {_MATCH} SELECT page, t_idx, p_idx, round(iou, 6) AS iou FROM best")
def iou_match_gt(spark, d):
    return _r(detect.best_for_truth(_matching(spark, d)[2]).select("page", "t_idx", "p_idx", "iou"), "iou")


@query(f"""WITH {_MATCH}, bp AS (SELECT * FROM pairs WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY page, p_idx ORDER BY iou DESC, t_idx) = 1)
SELECT p.page, p.idx, bp.t_idx, coalesce(bp.t_char, '') AS gt_char, round(bp.iou, 6) AS iou FROM p LEFT JOIN bp ON p.page = bp.page AND p.idx = bp.p_idx""")
def iou_match_pred(spark, d):
    _, p, pairs = _matching(spark, d)
    return _r(detect.best_for_prediction(p, pairs).select("page", "idx", "t_idx", F.coalesce("t_char", F.lit("")).alias("gt_char"), "iou"), "iou")


@query(f"""WITH {_MATCH}, c AS (SELECT page, 1 AS g, 0 AS p, 0 AS ok FROM t UNION ALL SELECT page, 0, 1, 0 FROM p UNION ALL SELECT page, 0, 0, (t_char = p_char)::INT FROM best),
s AS (SELECT CASE WHEN grouping(page) = 1 THEN 'TOTAL' ELSE page::VARCHAR END AS image, sum(g)::BIGINT AS gt_count, sum(p)::BIGINT AS pred_count, sum(ok)::BIGINT AS correct FROM c GROUP BY ROLLUP (page)),
r AS (SELECT *, CASE WHEN gt_count > 0 THEN 100.0 * correct / gt_count ELSE 0 END::DOUBLE AS recall, CASE WHEN pred_count > 0 THEN 100.0 * correct / pred_count ELSE 0 END::DOUBLE AS precision FROM s)
SELECT image, gt_count, pred_count, correct, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1 FROM r""")
def f1_per_page_total(spark, d):
    t, p, pairs = _matching(spark, d)
    return _r(detect.f1_table(t, p, detect.best_for_truth(pairs)), "recall", "precision", "f1")


@query(f"""WITH {_MATCH} SELECT t_char = p_char AS is_ok, count(*) AS n, round(avg(p_conf), 6) AS mean_conf, round(median(p_conf), 6) AS median_conf, round(quantile_cont(p_conf, 0.9), 6) AS p90_conf, count(*) FILTER (WHERE p_conf < 0.5) AS below_half, count(*) FILTER (WHERE p_conf > 0.8) AS above_08 FROM best GROUP BY 1""")
def match_conf_stats(spark, d):
    return _r(detect.confidence_by_outcome(detect.best_for_truth(_matching(spark, d)[2])), "mean_conf", "median_conf", "p90_conf")


@query("WITH s AS (SELECT DISTINCT source FROM documents) SELECT a.source AS a, b.source AS b FROM s a, s b WHERE contains(a.source, b.source) OR contains(b.source, a.source)")
def image_name_substring(spark, d):
    names = _table(spark, d, "documents").select("source").distinct()
    a, b = names.select(F.col("source").alias("a")), names.select(F.col("source").alias("b"))
    return a.join(F.broadcast(b), detect.same_image(F.col("a"), F.col("b"), substring=True))  # a few dozen names


# --- alignment and accuracy -----------------------------------------------------------------------------------------


@query(f"""WITH {_ORDER}, truth AS (SELECT page, idx AS pos, char AS gt FROM box WHERE page % 5 <> 0 OR idx > 0), same AS (SELECT page FROM (SELECT page, count(*) AS b FROM ordered GROUP BY page) JOIN (SELECT page, count(*) AS t FROM truth GROUP BY page) USING (page) WHERE b = t)
SELECT page % 10 AS book, count(*) AS n, round(avg((char = gt)::INT), 6) AS greedy_acc FROM ordered SEMI JOIN same USING (page) JOIN truth USING (page, pos) GROUP BY 1""")
def align_accuracy(spark, d):
    b = boxes(spark, d)
    ordered = layout.reading_order(b).select("page", "pos", F.col("char").alias("greedy"))
    truth = b.where("page % 5 <> 0 OR idx > 0").select("page", F.col("idx").alias("pos"), F.col("char").alias("gt"))
    return _r(evalstats.accuracy(evalstats.align(ordered, truth).withColumn("book", F.col("page") % 10), ["book"]), "greedy_acc")


_STATUS = f"""{BOX}, pages AS (SELECT DISTINCT page FROM box), truth AS (SELECT page, idx FROM box WHERE page % 7 <> 0 AND (page % 5 <> 0 OR idx > 0)), bx AS (SELECT page FROM box WHERE page % 11 <> 0),
s AS (SELECT page, coalesce(nb, 0) AS n_boxes, coalesce(nt, 0) AS n_chars FROM pages LEFT JOIN (SELECT page, count(*) AS nb FROM bx GROUP BY page) USING (page) LEFT JOIN (SELECT page, count(*) AS nt FROM truth GROUP BY page) USING (page)),
st AS (SELECT *, CASE WHEN n_chars = 0 THEN 'no_text' WHEN n_boxes = 0 THEN 'no_boxes' WHEN n_boxes <> n_chars THEN 'length_mismatch' ELSE 'evaluated' END AS status FROM s)"""


@query(f"WITH {_STATUS} SELECT status, count(*) AS pages, sum(n_boxes)::BIGINT AS boxes, sum(n_chars)::BIGINT AS chars FROM st GROUP BY status")
def page_status(spark, d):
    b = boxes(spark, d)
    st = evalstats.page_status(b, b.where("page % 11 <> 0"), b.where("page % 7 <> 0 AND (page % 5 <> 0 OR idx > 0)"))
    return st.groupBy("status").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_boxes").alias("boxes"), F.sum("n_chars").alias("chars"))


_OUT = "CASE WHEN greedy = gt AND final = gt THEN 'ok' WHEN greedy <> gt AND final = gt THEN 'fix' WHEN greedy = gt THEN 'worse' ELSE 'bothx' END"


@query(f"""WITH {DEC}, o AS (SELECT {_OUT} AS o FROM dec), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE o = 'ok') AS ok, count(*) FILTER (WHERE o = 'fix') AS fix, count(*) FILTER (WHERE o = 'worse') AS worse, count(*) FILTER (WHERE o = 'bothx') AS bothx FROM o)
SELECT *, round(coalesce(fix / nullif(fix + bothx, 0), 0), 6)::DOUBLE AS repair_rate FROM c""")
def outcome_tally(spark, d):
    return _r(evalstats.outcome_tally(decoded(spark, d)), "repair_rate")


@query(f"""WITH {DEC}, o AS (SELECT *, {_OUT} AS o FROM dec), c AS (SELECT gt AS char_gt, count(*) AS "count", count(*) FILTER (WHERE o = 'ok') AS ok, count(*) FILTER (WHERE o = 'fix') AS fix, count(*) FILTER (WHERE o = 'worse') AS worse, count(*) FILTER (WHERE o = 'bothx') AS bothx,
 count(*) FILTER (WHERE greedy <> gt) AS greedy_err, count(*) FILTER (WHERE lm <> gt) AS kenlm_err, count(*) FILTER (WHERE final <> gt) AS final_err, count(*) FILTER (WHERE list_contains(topk_chars[1:3], gt)) AS "oracle_in_topK" FROM o GROUP BY gt HAVING count(*) >= 20)
SELECT *, round(greedy_err / "count", 6) AS greedy_miss_rate, round(kenlm_err / "count", 6) AS kenlm_miss_rate, round(final_err / "count", 6) AS final_miss_rate, round("oracle_in_topK" / "count", 6) AS oracle_rate, round(fix / "count", 6) AS fix_rate_total, round(worse / "count", 6) AS worse_rate_total, round(bothx / "count", 6) AS bothx_rate_total, round(coalesce(fix / nullif(fix + bothx, 0), 0), 6) AS repair_rate_char FROM c""")
def char_stats(spark, d):
    rates = ("greedy_miss_rate", "kenlm_miss_rate", "final_miss_rate", "oracle_rate", "fix_rate_total", "worse_rate_total", "bothx_rate_total", "repair_rate_char")
    return _r(evalstats.char_stats(decoded(spark, d), k=3, min_count=20), *rates)


@query(f"""WITH {DEC}, c AS (SELECT gt, final AS pred, count(*) AS "count", min(page * 100000 + pos) AS seen FROM dec GROUP BY 1, 2 HAVING count(*) >= 3) SELECT gt, pred, "count", (gt = pred)::INT AS is_correct FROM c ORDER BY "count" DESC, seen LIMIT 100""")
def confusion_top(spark, d):
    return evalstats.confusion(decoded(spark, d), min_pair=3, n=100)


@query(f"WITH {DEC}, k AS (SELECT unnest([1, 2, 3, 5]) AS k) SELECT k::INT AS k, count(*) FILTER (WHERE list_contains(topk_chars[1:k], gt)) AS hits, count(*) AS total, round(count(*) FILTER (WHERE list_contains(topk_chars[1:k], gt)) / count(*), 6) AS rate FROM dec, k GROUP BY k")
def oracle_at_k(spark, d):
    return _r(evalstats.oracle_at_k(decoded(spark, d), [1, 2, 3, 5]), "rate")


@query(f"WITH {DEC} SELECT page, pos, greedy || gt || lm || final AS label, CASE {_OUT} WHEN 'fix' THEN 'green' WHEN 'worse' THEN 'red' WHEN 'bothx' THEN 'yellow' ELSE 'grey' END AS colour FROM dec")
def annotation_table(spark, d):
    return evalstats.annotations(decoded(spark, d)).select("page", "pos", "label", "colour")


@query(f"""WITH {BOX}, b AS (SELECT page, count(*) AS bbox_n, count(*) FILTER (WHERE part % 17 = 0) AS unknown_n FROM box GROUP BY page), t AS (SELECT doc_id AS page, text, length(regexp_replace(text, '[\\s\\p{{Z}}\\x00-\\x1f\\x7f\\x85]', '', 'g')) AS gt_n FROM documents)
SELECT page, bbox_n, unknown_n, coalesce(gt_n, 0)::BIGINT AS gt_n, coalesce(gt_n, 0) = 0 AS blank, (bbox_n - coalesce(gt_n, 0))::BIGINT AS diff FROM b LEFT JOIN t USING (page)""")
def bbox_text_counts(spark, d):
    b = boxes(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("bbox_n"), F.count_if(F.col("part") % 17 == 0).alias("unknown_n"))
    t = documents(spark, d).select(F.col("doc_id").alias("page"), F.length(text.strip_invisible(F.col("text"))).cast("long").alias("gt_n"))
    both = b.join(t, "page", "left").withColumn("gt_n", F.coalesce("gt_n", F.lit(0).cast("long")))
    return both.withColumns({"blank": F.col("gt_n") == 0, "diff": F.col("bbox_n") - F.col("gt_n")})


# --- recognition ----------------------------------------------------------------------------------------------------

_COS = """w AS (SELECT label, k, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY label, k),
ws AS (SELECT label, list(v ORDER BY k) AS w FROM w GROUP BY label), c AS (SELECT vec_id, e.label, ws.label AS class_id, 16 * list_dot_product(embedding::DOUBLE[], w) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(w, w))) AS z FROM embeddings e, ws),
l AS (SELECT *, z - m - ln(sum(exp(z - m)) OVER (PARTITION BY vec_id)) AS logp FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM c)), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logp DESC, class_id) AS k FROM l)"""


def _topk(spark, d, k=5) -> DataFrame:
    e = _table(spark, d, "embeddings")
    return recognise.topk_candidates(e, recognise.class_weights(e), k)


@query(f"WITH {_COS} SELECT vec_id, k::INT AS k, class_id, round(logp, 5) AS logp FROM r WHERE k <= 3")
def cosine_topk(spark, d):
    flat = _topk(spark, d, 3).select("vec_id", F.posexplode("topk").alias("_k", "t"))
    return _r(flat.select("vec_id", (F.col("_k") + 1).alias("k"), F.col("t.class_id").alias("class_id"), F.col("t.logp").alias("logp")), "logp", digits=5)


@query(f"WITH {_COS} SELECT count(*) AS n, round(avg((label = class_id)::INT), 6) AS accuracy FROM r WHERE k = 1")
def cosine_greedy_acc(spark, d):
    return _topk(spark, d, 1).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.get("topk", F.lit(0))["class_id"] == F.col("label")).cast("int")), 6).alias("accuracy"))


@query(f'WITH {_COS} SELECT label AS gt, class_id AS pred, count(*) AS "count" FROM r WHERE k = 1 GROUP BY 1, 2')
def class_confusion(spark, d):
    return _topk(spark, d, 1).groupBy(F.col("label").alias("gt"), F.get("topk", F.lit(0))["class_id"].alias("pred")).agg(F.count(F.lit(1)).alias("count"))


@query(f"""WITH {BOX}, e AS (SELECT page, idx, chr((12354 + (part * j) % 3)::INT) AS char, -((part * (j + 1)) % 17) / 4.0 AS logp FROM box, (SELECT unnest([0, 1, 2, 3, 4]) AS j)) SELECT page, idx, char, max(logp)::DOUBLE AS logp FROM e GROUP BY page, idx, char""")
def best_logp_per_char(spark, d):
    ch = lambda n: text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + n)))
    p = F.col("part")
    top = F.array(*[F.struct(ch((p * j) % 3).alias("char"), (-((p * (j + 1)) % 17) / 4.0).alias("logp")) for j in range(5)])
    return boxes(spark, d).select("page", "idx", F.explode(arrays.best_by_char(top)).alias("t")).select("page", "idx", "t.*")


# --- text and language models ---------------------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g')) AS digest, length(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g')) AS n FROM documents")
def strip_ws(spark, d):
    clean = text.strip_white_space(F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x00-\x1f\x7f\x85\x{200b}-\x{200d}\x{2060}\x{feff}\x{ad}]', '', 'g')) AS digest FROM documents")
def strip_invisible(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.strip_invisible(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(list_reverse(string_split(coalesce(text, ''), ' ')), ' ')) AS by_token, md5(CASE WHEN coalesce(text, '') = '' THEN '' ELSE array_to_string(string_split(replace(text, ' ', ''), ''), ' ') END) AS spaced FROM documents WHERE contains(text, ' ')")
def reverse_join_chars(spark, d):
    docs = documents(spark, d).where(F.contains(F.col("text"), F.lit(" ")))
    return docs.select("doc_id", F.md5(text.reversed_text(F.col("text"))).alias("by_token"), F.md5(text.spaced(F.replace("text", F.lit(" "), F.lit("")))).alias("spaced"))


@query("SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')) AS n_e, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'th', ''))) // 2 AS n_th FROM documents")
def count_target(spark, d):
    return documents(spark, d).select("doc_id", text.count_of(F.col("text"), "e").alias("n_e"), text.count_of(F.col("text"), "th").alias("n_th"))


@query("SELECT p_partkey, chr((CASE WHEN p_partkey % 3 = 0 THEN 131083 ELSE 12354 END + p_partkey % 80)::INT) AS char, 'U+ZZ' || p_partkey AS kept FROM part")
def code_points(spark, d):
    p = F.col("p_partkey")
    n = F.when(p % 3 == 0, 131083).otherwise(12354) + p % 80
    return _table(spark, d, "part").select("p_partkey", text.code_point_char(F.concat(F.lit("U+"), F.hex(n))).alias("char"), text.code_point_char(F.concat(F.lit("U+ZZ"), p.cast("string"))).alias("kept"))


@query("SELECT doc_id, md5(array_to_string([substr(coalesce(text, ''), i * 80 + 1, 80) FOR i IN range(greatest(1, ceil(length(coalesce(text, '')) / 80.0)::INT))], chr(10))) AS digest FROM documents")
def wrapped_lines(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.wrapped(F.col("text"))).alias("digest"))


@query("""WITH n AS (SELECT page_id, printf('%d_%05d_%d', page_id % 7, page_id, page_id % 2) AS name, url FROM pages) SELECT page_id, name, split_part(name, '_', 1) AS book, page_id AS seq, page_id % 2 AS side, regexp_extract(url, '[^/]*$') AS base FROM n""")
def name_parts(spark, d):
    p = F.col("page_id")
    named = _table(spark, d, "pages").select("page_id", "url", F.format_string("%d_%05d_%d", p % 7, p, p % 2).alias("name"))
    seq, side = text.page_numbers(F.col("name"))
    return named.select("page_id", "name", text.book_of(F.col("name")).alias("book"), seq.alias("seq"), side.alias("side"), text.base_name(F.col("url")).alias("base"))


@query("""WITH n AS (SELECT page_id, 'p' || (page_id * 37 % 1000) || '_' || page_id || '.png' AS name FROM pages) SELECT name, (row_number() OVER (ORDER BY page_id * 37 % 1000, page_id))::INT AS rank FROM n""")
def natural_sort(spark, d):
    p = F.col("page_id")
    named = _table(spark, d, "pages").select(F.concat(F.lit("p"), p * 37 % 1000, F.lit("_"), p, F.lit(".png")).alias("name"))
    return datasets.dense_ids(named.withColumn("_k", text.natural_key(F.col("name"))), ["_k"], "rank", 1).select("name", F.col("rank").cast("int").alias("rank"))


@query("""WITH n AS (SELECT doc_id, coalesce(n_chars, 0) * coalesce(n_chars, 0) AS n FROM documents) SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM n""")
def human_sizes(spark, d):
    n = F.coalesce("n_chars", F.lit(0))
    return _table(spark, d, "documents").select("doc_id", text.human_size(n * n).alias("size"))


@query("""WITH c AS (SELECT string_split(text, '') AS cs FROM documents WHERE length(text) >= 3), g AS (SELECT unnest([cs[i] || ' ' || cs[i + 1] || ' ' || cs[i + 2] FOR i IN range(1, len(cs) - 1)]) AS gram FROM c) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def ngram_counts(spark, d):
    return lm.ngram_counts(documents(spark, d))


_BIGRAM = """b AS (SELECT w1, w2, count(*) AS n FROM (SELECT unnest(cs[:-2]) AS w1, unnest(cs[2:]) AS w2 FROM (SELECT string_split(text, '') AS cs FROM documents WHERE length(text) >= 2)) GROUP BY 1, 2)"""


@query(f"WITH {_BIGRAM} SELECT w1, w2, n, round(log10(n / sum(n) OVER (PARTITION BY w1)), 6) AS log10_p FROM b")
def bigram_logprob(spark, d):
    return _r(lm.bigram_logprob(documents(spark, d)), "log10_p")


def _decode_items(spark, d) -> DataFrame:
    ch = lambda n: text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + n)))
    p = F.col("part")
    top = F.array(*[F.struct(ch((p + j) % 20).alias("char"), (-((p * (j + 2)) % 13) / 4.0).alias("logp")) for j in range(3)])
    return boxes(spark, d).select("page", F.col("idx").alias("pos"), "part", top.alias("candidates"))


def _decode_bigrams(spark, d) -> DataFrame:
    chars = boxes(spark, d).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", (F.col("part") % 20).alias("p")))), lambda s: text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + s["p"])))), "").alias("text"))
    return lm.bigram_logprob(chars)


@query()
def beam_decode(spark, d):
    out = decode.beam_search(_decode_items(spark, d), _decode_bigrams(spark, d))
    return out.select("page", F.array_join("seq", "").alias("text"), F.round("score", 6).alias("score"))


def _decode_texts(spark, d) -> DataFrame:
    char = text.code_point_char(F.concat(F.lit("U+"), F.hex(12354 + F.col("part") % 20)))
    return boxes(spark, d).select("page", "idx", char.alias("c")).groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "c"))), lambda s: s["c"]), "").alias("text"))


@query()
def beam_decode_backoff(spark, d):
    """Order 3 with back-off, from the begin state on, estimated from the pages' own characters."""
    out = decode.beam_search_backoff(_decode_items(spark, d), lm.backoff_table(_decode_texts(spark, d)))
    return out.select("page", F.array_join("seq", "").alias("text"), F.round("score", 6).alias("score"))


@query()
def masked_rerank_text(spark, d):
    """One pass over greedy readings with a stand-in for a masked model that looks at the whole page: how often the
    candidate stands in its text."""
    import math

    load = lambda: lambda page, at, char: math.log(page.count(char) / len(page))
    out = decode.masked_rerank_text(decode.greedy(_decode_items(spark, d)), load)
    return out.select("page", "pos", "final", F.round("score", 6).alias("score"))


@query()
def masked_rerank(spark, d):
    """One pass over greedy readings, scored by how common the pair with the left neighbour is."""
    bigrams = _decode_bigrams(spark, d).select(F.col("w1").alias("left"), F.col("w2").alias("char"), "log10_p")
    scorer = lambda rows: rows.join(bigrams, ["left", "char"], "left").withColumn("mlm", F.coalesce("log10_p", F.lit(decode.FLOOR)))
    return decode.masked_rerank(decode.greedy(_decode_items(spark, d)), scorer).select("page", "pos", "greedy", "final")


@query()
def backoff_model(spark, d):
    return lm.backoff_table(documents(spark, d)).select("n", F.array_join("ctx", " ").alias("ctx"), "token", F.round("log10_p", 6).alias("log10_p"), F.round("log10_backoff", 6).alias("log10_backoff"))


@query("""WITH l AS (SELECT length(text) AS n FROM documents WHERE length(text) >= 10) SELECT count(*) AS num_texts, min(n)::INT AS min_len, max(n)::INT AS max_len, round(avg(n), 6) AS mean_len, (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM l) WHERE i = (SELECT count(*) // 2 + 1 FROM l))::INT AS median_len_approx FROM l""")
def corpus_meta(spark, d):
    return _r(lm.corpus_meta(documents(spark, d).where(F.length("text") >= 10)), "mean_len")


@query(r"SELECT doc_id, md5(array_to_string(list_reverse(string_split(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g'), '')), ' ')) AS digest FROM documents WHERE length(regexp_replace(coalesce(text, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]', '', 'g')) >= 20")
def training_corpus(spark, d):
    return lm.training_corpus(documents(spark, d), min_chars=20).select("doc_id", F.md5("text").alias("digest"))


@query(f"WITH {BOX} SELECT page, idx, coalesce(lag(char, 1) OVER w, '<s>') AS prev1, coalesce(lag(char, 2) OVER w, '<s>') AS prev2 FROM box WINDOW w AS (PARTITION BY page ORDER BY idx)")
def char_context(spark, d):
    return lm.context(boxes(spark, d).select("page", "idx", "char"), pos="idx").select("page", "idx", "prev1", "prev2")


# --- sets, splits, ids ----------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents SEMI JOIN pages ON doc_id = page_id ANTI JOIN labels USING (doc_id)")
def pending_work(spark, d):
    need = _table(spark, d, "pages").select(F.col("page_id").alias("doc_id"))
    return datasets.pending(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), "doc_id", [need])


@query("SELECT count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS remaining FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def work_progress(spark, d):
    return datasets.progress(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels"), "doc_id")


_SPLITS = {"train": ["src0", "src1", "src2", "src3", "src4"], "val": ["src5", "src6"], "test": ["src7", "src8", "src99"]}
_SPLIT_VALUES = ", ".join(f"('{s}', '{k}')" for s, ks in _SPLITS.items() for k in ks)


@query(f"SELECT split, count(*) AS n FROM documents JOIN (VALUES {_SPLIT_VALUES}) s(split, source) USING (source) GROUP BY split")
def split_membership(spark, d):
    return datasets.split_members(_table(spark, d, "documents").select("source"), _SPLITS, "source").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT split, source FROM (VALUES {_SPLIT_VALUES}) s(split, source) ANTI JOIN documents USING (source)")
def missing_ids(spark, d):
    return datasets.missing_members(_table(spark, d, "documents"), _SPLITS, "source")


@query("WITH h AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS r FROM h) SELECT doc_id, CASE WHEN r < greatest(1, floor((SELECT count(*) FROM h) * 0.1)) THEN 'val' ELSE 'train' END AS split FROM r")
def hash_split_90_10(spark, d):
    return datasets.validation_split(_table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("SELECT p_type AS cls, count(*) AS n, (row_number() OVER (ORDER BY p_type) - 1)::INT AS class_id, round(1.0 / count(*), 9)::DOUBLE AS weight FROM part GROUP BY p_type")
def class_index_weights(spark, d):
    return _r(datasets.class_index(_table(spark, d, "part").select(F.col("p_type").alias("cls"))), "weight", digits=9)


@query("""WITH c AS (SELECT p_type AS cls, (row_number() OVER (ORDER BY p_type) - 1) AS class_id, count(*) AS n FROM part GROUP BY p_type), m AS (SELECT p_type AS cls, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY ('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT, p_partkey) - 1 AS i FROM part),
r AS (SELECT id AS draw, ('0x' || substr(md5('0:class:' || id), 1, 15))::BIGINT % (SELECT count(*) FROM c) AS class_id, ('0x' || substr(md5('0:member:' || id), 1, 15))::BIGINT AS u FROM (SELECT unnest(range(1000)) AS id))
SELECT draw, cls, p_partkey FROM r JOIN c USING (class_id) JOIN m USING (cls) WHERE m.i = u % n""")
def weighted_draws(spark, d):
    members = _table(spark, d, "part").select(F.col("p_type").alias("cls"), "p_partkey")
    return datasets.weighted_draws(members, 1000, "p_partkey").select("draw", "cls", "p_partkey")


@query(f"WITH {BOX} SELECT page, idx, row_number() OVER (ORDER BY page, idx) - 1 AS id FROM box")
def global_ids(spark, d):
    return datasets.dense_ids(boxes(spark, d).select("page", "idx"), ["page", "idx"]).select("page", "idx", F.col("id").cast("long").alias("id"))


@query(f"WITH {REC}, f AS (SELECT folder::VARCHAR AS file, avg(prob) AS mean_conf, count(*)::DOUBLE AS n FROM rec GROUP BY folder) SELECT file, round(mean_conf, 6) AS mean_conf, round(n, 6) AS n FROM f UNION ALL SELECT 'MEAN', round(avg(mean_conf), 6), round(avg(n), 6) FROM f")
def mean_row(spark, d):
    rows = confidence.by_folder(recognitions(spark, d)).select(F.col("folder").alias("file"), "mean_conf", F.col("n").cast("double").alias("n"))
    return _r(image_quality.mean_row(rows), "mean_conf", "n")


@query("SELECT doc_id AS a, doc_id % 3 AS ext FROM documents WHERE doc_id % 3 < 2")
def file_priority(spark, d):
    ext = F.element_at(F.array(F.lit(".jpg"), F.lit(".png"), F.lit(".gif")), (F.col("doc_id") % 3 + 1).cast("int"))
    every = _table(spark, d, "documents").select("doc_id", ext.alias("ext"))
    more = every.where("doc_id % 3 = 0").withColumn("ext", F.lit(".PNG"))
    return datasets.pick_by_priority(every.unionByName(more), "doc_id", [".jpg", ".png"]).select(F.col("doc_id").alias("a"), F.when(F.col("ext") == ".jpg", 0).otherwise(1).cast("long").alias("ext"))


@query("""WITH r AS (SELECT user_id AS run, list({'e': event_id, 'v': value} ORDER BY event_id) AS es FROM events GROUP BY user_id),
f AS (SELECT run, list_reduce(list_prepend({'best': '-infinity'::DOUBLE, 'at': -1, 'bad': 0, 'stop': NULL::BIGINT, 'e': 0::BIGINT, 'v': 0.0::DOUBLE}, list_transform(es, lambda x: {'best': 0.0::DOUBLE, 'at': 0, 'bad': 0, 'stop': NULL::BIGINT, 'e': x.e, 'v': x.v::DOUBLE})), lambda a, x:
 CASE WHEN a.stop IS NOT NULL THEN a WHEN x.v > a.best + 5 THEN {'best': x.v, 'at': x.e::INT, 'bad': 0, 'stop': NULL::BIGINT, 'e': x.e, 'v': x.v}
 ELSE {'best': a.best, 'at': a.at, 'bad': a.bad + 1, 'stop': CASE WHEN a.bad + 1 >= 3 THEN x.e END, 'e': x.e, 'v': x.v} END) AS s FROM r)
SELECT run, s.best AS best, s.at AS best_epoch, s.stop::INT AS stop_epoch FROM f""")
def early_stopping(spark, d):
    runs = _table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), "value")
    return datasets.early_stop(runs, gain=5.0, patience=3)


def _coco(spark, d):
    b = boxes(spark, d).select("page", "idx", "x1", "y1", "x2", "y2")
    pages = b.select("page").distinct().withColumns({"width": F.lit(720), "height": F.lit(720)})
    return datasets.coco(pages, b)


@query(f"""WITH {BOX}, t AS (SELECT (j * 2 + i)::INT AS tile_idx, i * 320 AS x0, j * 320 AS y0, least(640, 720 - i * 320) AS w, least(640, 720 - j * 320) AS h FROM (SELECT unnest(range(2)) AS j), (SELECT unnest(range(2)) AS i)),
m AS (SELECT DISTINCT page, tile_idx, w, h FROM box, t WHERE (x1 + x2) / 2.0 >= x0 AND (x1 + x2) / 2.0 < x0 + w AND (y1 + y2) / 2.0 >= y0 AND (y1 + y2) / 2.0 < y0 + h AND least(x2 - x0, w) - greatest(x1 - x0, 0) >= 2 AND least(y2 - y0, h) - greatest(y1 - y0, 0) >= 2)
SELECT row_number() OVER (ORDER BY page, tile_idx) - 1 AS id, printf('%d_%03d.jpg', page, tile_idx) AS file_name, w::INT AS width, h::INT AS height FROM m""")
def coco_images(spark, d):
    return _coco(spark, d)[0].select(F.col("id").cast("long").alias("id"), "file_name", "width", "height")


@query(f"""WITH {BOX}, t AS (SELECT (j * 2 + i)::INT AS tile_idx, i * 320 AS x0, j * 320 AS y0, least(640, 720 - i * 320) AS w, least(640, 720 - j * 320) AS h FROM (SELECT unnest(range(2)) AS j), (SELECT unnest(range(2)) AS i)),
m AS (SELECT page, tile_idx, idx, greatest(x1 - x0, 0)::DOUBLE AS tx, greatest(y1 - y0, 0)::DOUBLE AS ty, (least(x2 - x0, w) - greatest(x1 - x0, 0))::DOUBLE AS tw, (least(y2 - y0, h) - greatest(y1 - y0, 0))::DOUBLE AS th FROM box, t
 WHERE (x1 + x2) / 2.0 >= x0 AND (x1 + x2) / 2.0 < x0 + w AND (y1 + y2) / 2.0 >= y0 AND (y1 + y2) / 2.0 < y0 + h AND least(x2 - x0, w) - greatest(x1 - x0, 0) >= 2 AND least(y2 - y0, h) - greatest(y1 - y0, 0) >= 2)
SELECT row_number() OVER (ORDER BY page, tile_idx, idx) - 1 AS id, dense_rank() OVER (ORDER BY page, tile_idx) - 1 AS image_id, [tx, ty, tw, th] AS bbox, tw * th AS area FROM m""")
def coco_annotations(spark, d):
    return _coco(spark, d)[1].select("id", "image_id", "bbox", "area")


# --- rasters --------------------------------------------------------------------------------------------------------

_LUMA = "0.299e0 * r + 0.587e0 * g + 0.114e0 * b"


@query(f"""WITH {BOX}, {PIX}, e AS (SELECT image, entropy(floor({_LUMA})::INT) AS entropy FROM pix GROUP BY image) SELECT image, round(kurtosis_pop(r) + 3, 5) AS "kurtosis_R", round(kurtosis_pop(g) + 3, 5) AS "kurtosis_G", round(kurtosis_pop(b) + 3, 5) AS "kurtosis_B", round(coalesce(stddev_pop(({_LUMA})::DOUBLE) FILTER (WHERE r > 100), stddev_pop(({_LUMA})::DOUBLE)), 5) AS brightness_std, round(any_value(entropy), 5) AS entropy FROM pix JOIN e USING (image) GROUP BY image""")
def no_reference_quality(spark, d):
    out = image_quality.no_reference(pixels(spark, d), background=F.col("r") > 100)
    return _r(out, "kurtosis_R", "kurtosis_G", "kurtosis_B", "brightness_std", "entropy", digits=5)


_OTSU = """h AS (SELECT image, r AS v, count(*) AS n FROM pix GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER lo AS w0, sum(n * v) OVER lo AS s0, sum(n) OVER al AS w, sum(n * v) OVER al AS s FROM h WINDOW lo AS (PARTITION BY image ORDER BY v ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY image)),
var AS (SELECT image, v, round(coalesce(w0 * (w - w0) * power(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 0), 3) AS q FROM s), otsu AS (SELECT image, v AS threshold FROM var QUALIFY row_number() OVER (PARTITION BY image ORDER BY q DESC, v) = 1)"""


@query(f"WITH {BOX}, {PIX}, {_OTSU} SELECT image, threshold FROM otsu")
def otsu_threshold(spark, d):
    return raster.otsu(pixels(spark, d).withColumn("v", F.col("r")))


@query(f"WITH {BOX}, {PIX}, {_OTSU} SELECT image, y, x, CASE WHEN EXISTS (SELECT 1 FROM pix q WHERE q.image = p.image AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.r <= threshold) THEN 0 ELSE 255 END AS m FROM pix p JOIN otsu USING (image)")
def otsu_mask_dilated(spark, d):
    p = pixels(spark, d).select("image", "y", "x", F.col("r").alias("v"))
    return raster.dilate(raster.binary_mask(p, raster.otsu(p))).select("image", "y", "x", "m")


@query("SELECT v::INT AS v, floor(pow(v / 255.0, 1 / 1.5) * 255.0)::INT AS out FROM (SELECT unnest(range(256)) AS v)")
def gamma_lut(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("v"), numbers.gamma(F.col("id")).alias("out"))


_PATCH = f"""{BOX}, {PIX}, patch AS (SELECT image, x - x % 4 - 4 * o AS x0, y - y % 8 AS y0, x % 4 + 4 * o AS px, y % 8 AS py, ((r + o * 50) % 256) AS v FROM pix, (SELECT unnest([0, 1]) AS o) WHERE x - x % 4 - 4 * o >= 0)"""


def _patches(spark, d) -> DataFrame:
    both = pixels(spark, d).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))
    x0 = F.col("x") - F.col("x") % 4 - 4 * F.col("o")
    return both.where(x0 >= 0).select("image", x0.alias("x0"), (F.col("y") - F.col("y") % 8).alias("y0"), (F.col("x") % 4 + 4 * F.col("o")).alias("px"), (F.col("y") % 8).alias("py"), ((F.col("r") + F.col("o") * 50) % 256).alias("v"))


@query(f"""WITH {_PATCH}, w AS (SELECT image, y0 + py AS y, x0 + px AS x, greatest(exp(-0.5 * pow((px - 3.5) / 2.0, 2)) * exp(-0.5 * pow((py - 3.5) / 2.0, 2)), 1e-6) AS w, v FROM patch) SELECT image, y, x, floor(sum(v * w) / greatest(sum(w), 1e-6) + 1e-9)::INT AS v FROM w GROUP BY image, y, x""")
def feather_blend(spark, d):
    return raster.feather_blend(_patches(spark, d), 8, 4)


@query(f"WITH {_PATCH} SELECT image, y0 + py AS y, x0 + px AS x, round(avg(v), 6) AS v FROM patch GROUP BY 1, 2, 3")
def overlap_average(spark, d):
    return _r(raster.overlap_average(_patches(spark, d)), "v")


@query(f"WITH {BOX}, {PIX} SELECT image, y, x, CASE WHEN b > 127 THEN r ELSE g END AS v FROM pix")
def red_composite(spark, d):
    p = pixels(spark, d)
    pick = lambda c, n: p.select("image", "y", "x", F.col(c).alias(n))
    return raster.composite(pick("g", "v"), pick("r", "v"), pick("b", "m"))


@query(f"""WITH {BOX}, {PIX}, e AS (SELECT image, CASE WHEN sum(b) = 0 THEN 0 ELSE sum(power((r - g) * CASE WHEN top > 1 THEN b / 255.0e0 ELSE b END, 2)) / sum(CASE WHEN top > 1 THEN b / 255.0e0 ELSE b END) END AS mse FROM pix JOIN (SELECT image, max(b) AS top FROM pix GROUP BY image) USING (image) GROUP BY image) SELECT image, round(mse, 5) AS mse, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025 / mse) END, 5) AS psnr FROM e""")
def psnr_masked(spark, d):
    p = pixels(spark, d)
    out = image_quality.psnr(p.select("image", "y", "x", F.col("r").alias("v"), F.col("b").alias("m")), p.select("image", "y", "x", F.col("g").alias("v")), mask=True)
    return _r(out, "mse", "psnr", digits=5)


@query(f"WITH {BOX}, {PIX} SELECT image, round(avg(abs(r - g)), 5) AS l1, round(avg(power(r - g, 2)), 5) AS mse, round(avg(sqrt(power(r - g, 2) + 1e-6)), 5) AS charbonnier FROM pix GROUP BY image")
def pixel_losses(spark, d):
    p = pixels(spark, d)
    return _r(image_quality.pixel_losses(p.select("image", "y", "x", F.col("r").alias("v")), p.select("image", "y", "x", F.col("g").alias("v"))), "l1", "mse", "charbonnier", digits=5)


@query(f"WITH {BOX}, {PIX} SELECT image, y, x, round((65.481 * r + 128.553 * g + 24.966 * b) / 255.0 + 16, 5)::DOUBLE AS yy, round((-37.797 * r - 74.203 * g + 112.0 * b) / 255.0 + 128, 5)::DOUBLE AS cb, round((112.0 * r - 93.786 * g - 18.214 * b) / 255.0 + 128, 5)::DOUBLE AS cr FROM (SELECT image, y, x, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM pix)")
def ycbcr(spark, d):
    yy, cb, cr = numbers.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return _r(pixels(spark, d).select("image", "y", "x", yy.alias("yy"), cb.alias("cb"), cr.alias("cr")), "yy", "cb", "cr", digits=5)


@query("WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, least(floor(16 * (least(greatest(l_quantity, 5), 45) - 5) / 40), 15)::INT AS q FROM lineitem) SELECT *, round((q + 0.5) * 40 / 16 + 5, 6)::DOUBLE AS back FROM q")
def quantise(spark, d):
    q = numbers.quantise(F.col("l_quantity"), 5.0, 45.0, 16)
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("q")).withColumn("back", F.round(numbers.dequantise(F.col("q"), 5.0, 45.0, 16), 6))


@query("SELECT i::INT AS step, round(CASE WHEN i <= 100 THEN 1e-4 + 1.0 * 0.5 * (0.01 - 1e-4) * (1 + cos(pi() * i / 100)) WHEN i <= 300 THEN 1e-4 + 0.5 * 0.5 * (0.01 - 1e-4) * (1 + cos(pi() * (i - 100) / 200)) ELSE 1e-4 + 0.25 * 0.5 * (0.01 - 1e-4) * (1 + cos(pi() * (i - 300) / 300)) END, 9) AS lr FROM (SELECT unnest(range(600)) AS i)")
def lr_cosine_restart(spark, d):
    lr = numbers.cosine_restart_rate(F.col("id"), 0.01, [100, 200, 300], [1.0, 0.5, 0.25], 1e-4)
    return spark.range(600).select(F.col("id").cast("int").alias("step"), F.round(lr, 9).alias("lr"))


@query("WITH RECURSIVE b AS (SELECT 0 AS t, 1 - 0.0001::DOUBLE AS a UNION ALL SELECT t + 1, a * (1 - (0.0001 + 0.0199 * (t + 1) / 99)) FROM b WHERE t < 99) SELECT t::INT AS t, round(a, 9) AS alpha FROM b")
def alpha_schedule(spark, d):
    alphas = numbers.cumulative_alphas(numbers.linear_betas(0.0001, 0.02, 100))
    return spark.range(1).select(F.posexplode(alphas).alias("t", "alpha")).select("t", F.round("alpha", 9).alias("alpha"))


@query(f"WITH {BOX}, {PIX}, c AS (SELECT image, r % 16 AS v, count(*) AS n FROM pix GROUP BY 1, 2) SELECT image, v AS mode FROM c QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC, v) = 1")
def channel_mode(spark, d):
    return raster.channel_mode(pixels(spark, d).select("image", (F.col("r") % 16).alias("v")), ["image"])


@query(f"WITH {BOX}, {PIX}, {_OTSU} SELECT image, coalesce(floor(median(r) FILTER (WHERE r > threshold))::INT, 255) AS r, coalesce(floor(median(g) FILTER (WHERE r > threshold))::INT, 255) AS g, coalesce(floor(median(b) FILTER (WHERE r > threshold))::INT, 255) AS b FROM pix JOIN otsu USING (image) GROUP BY image")
def background_median(spark, d):
    p = pixels(spark, d).withColumn("v", F.col("r"))
    return raster.background_median(p, raster.otsu(p))


@query(f"WITH {BOX}, {PIX}, n AS (SELECT image, abs(lead(r) OVER (PARTITION BY image, y ORDER BY x) - r) AS h, abs(lead(r) OVER (PARTITION BY image, x ORDER BY y) - r) AS v FROM pix) SELECT image, coalesce(sum(h), 0)::BIGINT AS horizontal, coalesce(sum(v), 0)::BIGINT AS vertical FROM n GROUP BY image")
def total_variation(spark, d):
    return raster.total_variation(pixels(spark, d).select("image", "y", "x", F.col("r").alias("v")))


_W = "w AS (SELECT i, exp(-power(i - 5, 2) / 4.5e0) / sum(exp(-power(i - 5, 2) / 4.5e0)) OVER () AS w FROM (SELECT unnest(range(11)) AS i))"
_SUMS = {"a": "a", "b": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}


@query(f"""WITH {BOX}, {PIX}, {_W}, p AS (SELECT image % 4 AS image, image // 4 * 16 + y AS y, x, r AS a, g AS b FROM pix), g AS (SELECT image, unnest(range((max(y) + 1)::BIGINT)) AS y FROM p GROUP BY image),
full_ AS (SELECT image, y, x, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM (SELECT image, y, unnest(range(16)) AS x FROM g) LEFT JOIN p USING (image, y, x)),
across AS (SELECT image, y, x - i AS x, {", ".join(f"sum(w * {e}) AS {n}" for n, e in _SUMS.items())} FROM full_ JOIN w ON x - i BETWEEN 0 AND 5 GROUP BY ALL),
both_ AS (SELECT image, y - i AS y, x, {", ".join(f"sum(w * {n}) AS {n}" for n in _SUMS)} FROM across JOIN w ON y - i >= 0 GROUP BY ALL HAVING count(*) = 11)
SELECT image, round(avg((2 * a * b + 6.5025e0) * (2 * (ab - a * b) + 58.5225e0) / ((a * a + b * b + 6.5025e0) * (aa - a * a + bb - b * b + 58.5225e0))), 6) AS ssim FROM both_ GROUP BY image""")
def ssim(spark, d):
    p = pixels(spark, d).select((F.col("image") % 4).alias("image"), (F.floor(F.col("image") / 4) * 16 + F.col("y")).cast("int").alias("y"), "x", "r", "g")
    return _r(image_quality.ssim(p.select("image", "y", "x", F.col("r").alias("v")), p.select("image", "y", "x", F.col("g").alias("v"))), "ssim")


@query()
def frechet_distance(spark, d):
    e = _table(spark, d, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    a, b = image_quality.moments(e.where("label % 2 = 0")), image_quality.moments(e.where("label % 2 = 1"))
    return spark.createDataFrame([(round(image_quality.frechet(*a, *b), 6),)], "distance double")


# --- further operators ----------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def page_selection(spark, d):
    return datasets.selected_pages(_table(spark, d, "documents"), " src1, ,src3 ", "source").select("doc_id")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_text FROM documents d")
def text_exists(spark, d):
    docs = _table(spark, d, "documents").select("doc_id")
    have, lack = datasets.with_text(docs, _table(spark, d, "labels"), "doc_id")
    return have.withColumn("has_text", F.lit(True)).unionByName(lack.withColumn("has_text", F.lit(False)))


@query(f"""WITH {SIZES}, s AS (SELECT page, width, height, least(384.0::DOUBLE / width, 384.0::DOUBLE / height) AS f FROM sizes), r AS (SELECT page, greatest(1, round_even(width * f, 0)::INT) AS w, greatest(1, round_even(height * f, 0)::INT) AS h, greatest(1, floor(width * f)::INT) AS tw, greatest(1, floor(height * f)::INT) AS th FROM s)
SELECT page, w, h, ((384 - w) // 2)::INT AS x0, ((384 - h) // 2)::INT AS y0, tw, th FROM r""")
def letterbox_sizes(spark, d):
    w, h, x0, y0 = geometry.letterbox(F.col("width"), F.col("height"), 384)
    tw, th, _, _ = geometry.letterbox(F.col("width"), F.col("height"), 384, "truncate")
    return page_sizes(spark, d).select("page", w.alias("w"), h.alias("h"), x0.alias("x0"), y0.alias("y0"), tw.alias("tw"), th.alias("th"))


@query(f"WITH {SIZES} SELECT page, ((128 - width % 128) % 128)::INT AS right_pad, ((128 - height % 128) % 128)::INT AS bottom_pad FROM sizes")
def pad_sizes(spark, d):
    return page_sizes(spark, d).select("page", geometry.pad_to_multiple(F.col("width"), 128).alias("right_pad"), geometry.pad_to_multiple(F.col("height"), 128).alias("bottom_pad"))


@query("""WITH s AS (SELECT unnest(range(600)) AS i), v AS (SELECT i, CASE WHEN i < 225 THEN 1 - i / 225 WHEN i < 375 THEN 0.2 ELSE 0.1 END * CASE WHEN i % 7 < 3 THEN (i % 7) / 3 ELSE 2 - (i % 7) / 3 END AS w FROM s)
SELECT i::INT AS step, round(0.01 * power(0.1, (i >= 100)::INT + (i >= 250)::INT), 9) AS multistep, round(0.01 * (1 - i / 600), 9) AS linear, round(CASE WHEN i < 50 THEN 0.01 * (i + 1) / 50 ELSE 0.001 + 0.5 * 0.009 * (1 + cos(pi() * (i - 50) / 550)) END, 9) AS warmup,
round(CASE WHEN i < 200 THEN 0.01 * power(0.1, (i >= 100)::INT) ELSE 0.005 * power(0.1, (i >= 250)::INT) END, 9) AS restart, round(0.01 * CASE WHEN i < 3 THEN greatest(w, 0.1) ELSE w END, 9) AS vibrate FROM v""")
def lr_schedules(spark, d):
    i = F.col("id")
    rates = {"multistep": numbers.multistep_rate(i, 0.01, [100, 250]), "linear": numbers.linear_rate(i, 0.01, 600), "warmup": numbers.warmup_cosine_rate(i, 0.01, 50, 600, 0.001), "restart": numbers.multistep_restart_rate(i, 0.01, [100, 250], 0.1, [200], [0.5]), "vibrate": numbers.vibrate_rate(i, 0.01, 600)}
    return _r(spark.range(600).select(i.cast("int").alias("step"), *[c.alias(n) for n, c in rates.items()]), *rates, digits=9)


@query(f"WITH {BOX}, q AS (SELECT page, idx, least(floor(255 * (least(greatest((x1 - 300) / 2.5e1 / 600, -2e-2), 2e-2) + 2e-2) / 4e-2), 254)::INT AS q FROM box) SELECT page, idx, q, round(((q + 5e-1) * 4e-2 / 255 - 2e-2) * 600, 6) AS back FROM q")
def flow_quantised(spark, d):
    q = numbers.quantised_flow((F.col("x1") - 300) / 25.0, F.lit(600))
    return boxes(spark, d).select("page", "idx", q.alias("q")).withColumn("back", F.round(numbers.dequantised_flow(F.col("q"), F.lit(600)), 6))


@query("SELECT event_id, floor(255.0 / (1 + exp(-(value / 100 - 2))))::INT AS m FROM events")
def soft_mask(spark, d):
    return _table(spark, d, "events").select("event_id", numbers.soft_mask(F.col("value") / 100 - 2).alias("m"))


@query(f"""WITH {DEC} SELECT page, pos, topk_chars[2] AS top2_char, round(0.5 / 2, 6)::DOUBLE AS top2_conf, topk_chars[5] AS top5_char, '' AS top6_char FROM dec""")
def flattened_candidates(spark, d):
    top = F.transform("topk_chars", lambda c, i: F.struct(c.alias("char"), (0.5 / (i + 1)).alias("prob")))
    flat = arrays.flattened_candidates(F.col("t"), 2, 6)
    out = decoded(spark, d).select("page", "pos", top.alias("t")).select("page", "pos", *[c.alias(n) for n, c in flat.items()])
    return _r(out.select("page", "pos", "top2_char", "top2_conf", "top5_char", "top6_char"), "top2_conf")


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'unexpected' ELSE 'shape' END AS status FROM part WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) OR (p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_size % 3 = 1)")
def key_difference(spark, d):
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3).alias("shape"))
    have = p.where("key % 5 <> 0")
    want = p.where("key % 7 <> 0").withColumn("shape", F.when(F.col("shape") == 1, 9).otherwise(F.col("shape")))
    return datasets.key_difference(have, want, "key", "shape")


@query("SELECT event_type AS metric, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def metric_means(spark, d):
    return _r(datasets.metric_means(_table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")), "mean")


@query("SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT lang FROM documents")
def union_distinct(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select(F.col("source").alias("name")).union(docs.select("lang")).distinct()


@query(f"WITH {BOX} SELECT page, idx, greatest(0, x1 - 40)::INT AS x1, greatest(0, y1 - 40)::INT AS y1, greatest(0, x2 - 40)::INT AS x2, greatest(0, y2 - 40)::INT AS y2 FROM box")
def polygon_boxes(spark, d):
    moved = {k: F.col(k) - 40 for k in ("x1", "y1", "x2", "y2")}
    return boxes(spark, d).select("page", "idx", *[c.alias(k) for k, c in geometry.polygon_box(geometry.polygon(moved)).items()])


@query("SELECT i::INT AS place, round(sum(w), 6) AS total FROM (SELECT unnest(range(37)) AS i, 1.0::DOUBLE AS w) GROUP BY i")
def resize_weights(spark, d):
    """The weights of every output place add up to one."""
    taps = spark.createDataFrame(raster.resize_taps(100, 37), "place int, source int, w double")
    return taps.groupBy("place").agg(F.round(F.sum("w"), 6).alias("total"))


@query("""WITH n AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT d.doc_id, d.lang, n.doc_id AS partner_doc_id, n.lang AS partner_lang FROM documents d JOIN n ON n.i = ('0x' || substr(md5('0:' || d.doc_id), 1, 15))::BIGINT % (SELECT count(*) FROM documents)""")
def random_partners(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    return datasets.random_partners(docs, docs, "doc_id")


@query(f"""WITH {BOX}, {PIX}, k AS (SELECT DISTINCT image, k FROM pix, (SELECT unnest([1, 2, 3]) AS k)), u AS (SELECT image, {', '.join(f"('0x' || substr(md5('0:' || image || ':' || k || ':{c}'), 1, 15))::BIGINT % 1000003 / 1000003.0e0 AS u{c}" for c in (1, 2, 3))} FROM k),
disc AS (SELECT image, u1 * 12 AS cy, u2 * 16 AS cx, 1 + u3 * 12 / 4 AS r FROM u), g AS (SELECT * FROM (SELECT unnest(range(12)) AS y), (SELECT unnest(range(16)) AS x))
SELECT DISTINCT image, y::INT AS y, x::INT AS x, 255 AS m FROM disc, g WHERE power(y - cy, 2) + power(x - cx, 2) <= power(r, 2)""")
def blob_masks(spark, d):
    return raster.blob_masks(pixels(spark, d), 12, 16)


@query(f"WITH {BOX}, {PIX} SELECT image, y, x, round((0.00456621e0 * r + 0.00625893e0 * b) * 255 - 222.921e0, 9) AS red, round((0.00456621e0 * r - 0.00153632e0 * g - 0.00318811e0 * b) * 255 + 135.576e0, 9) AS green, round((0.00456621e0 * r + 0.00791071e0 * g) * 255 - 276.836e0, 9) AS blue FROM pix")
def rgb_of_ycbcr(spark, d):
    back = numbers.rgb_of_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, d).select("image", "y", "x", *[F.round(c, 9).alias(n) for n, c in zip(("red", "green", "blue"), back, strict=True)])


@query(f"WITH {BOX}, {PIX} SELECT image, round(sum(abs(r - g) * b)::DOUBLE / nullif(sum(b), 0), 6) AS weighted, round(avg(abs(r - g)), 6) AS mean, sum(abs(r - g))::BIGINT AS total FROM pix GROUP BY image")
def loss_reductions(spark, d):
    loss = F.abs(F.col("r") - F.col("g"))
    out = pixels(spark, d).groupBy("image").agg(numbers.reduced(loss, F.col("b")).alias("weighted"), numbers.reduced(loss).alias("mean"), numbers.reduced(loss, how="sum").alias("total"))
    return _r(out, "weighted", "mean")


@query(f"WITH {SIZES}, c AS (SELECT page, unnest(range(0, 704, 64)) AS x0 FROM sizes), r AS (SELECT page, x0, unnest(range(0, 704, 64)) AS y0 FROM c) SELECT page, printf('%d_%d.png', x0, y0) AS name, x0::INT AS x0, y0::INT AS y0, (x0 + 64)::INT AS x1, (y0 + 64)::INT AS y1 FROM r")
def fixed_cut(spark, d):
    return tiling.fixed_cut(page_sizes(spark, d))


@query(f"WITH {BOX}, {PIX} SELECT image, sum((r > 128 OR g > 128)::INT)::BIGINT AS n FROM pix GROUP BY image")
def mask_union(spark, d):
    return pixels(spark, d).groupBy("image").agg(F.sum(raster.mask_union(F.col("r"), F.col("g"))).alias("n"))


@query("SELECT doc_id, source || '.png' AS name FROM documents WHERE NOT contains(source, '3') AND NOT suffix(source || '.png', '1.png')")
def underived_files(spark, d):
    files = _table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".png")).alias("name"))
    return datasets.without_derived(files, marks=["3"], endings=["1.png"])


# --- restoration ----------------------------------------------------------------------------------------------------


WHOLE = "whole AS (SELECT * FROM pix SEMI JOIN (SELECT image, y FROM pix WHERE x = 15) USING (image, y))"


def _whole(spark, d) -> DataFrame:
    """The pixels of full lines: a model gives back whole rectangles."""
    p = pixels(spark, d)
    return p.join(p.where("x = 15").select("image", "y"), ["image", "y"], "left_semi")


def _reference(spark, d) -> DataFrame:
    """Another version of the pixels: red and green change places, and blue is turned about."""
    return pixels(spark, d).select("image", "y", "x", F.col("g").alias("r"), F.col("r").alias("g"), (255 - F.col("b")).alias("b"))


@query(f"""WITH {BOX}, {PIX}, e AS (SELECT image, (2 * sum(power(r - g, 2)) + sum(power(2 * b - 255, 2))) / (3.0e0 * count(*)) AS mse, avg(power((65.481e0 - 128.553e0) * (r - g) / 255 + 24.966e0 * (2 * b - 255) / 255, 2)) AS luma FROM pix WHERE x >= 2 GROUP BY image)
SELECT image, round(20 * log10(255 / sqrt(mse)), 5) AS psnr, round(20 * log10(255 / sqrt(luma)), 5) AS psnr_luma FROM e""")
def psnr_colour(spark, d):
    a, b = pixels(spark, d), _reference(spark, d)
    on_luma = image_quality.psnr_colour(a, b, on_luma=True, left=2).withColumnRenamed("psnr", "psnr_luma")
    return _r(image_quality.psnr_colour(a, b, left=2).join(on_luma, "image"), "psnr", "psnr_luma", digits=5)


@query(f"""WITH {BOX}, {PIX}, {WHOLE}, o AS (SELECT dy, dx, CASE WHEN dx = 0 THEN 0 ELSE dx * (2 - abs(dy)) END AS kx, CASE WHEN dy = 0 THEN 0 ELSE dy * (2 - abs(dx)) END AS ky FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
n AS (SELECT image, y - dy AS y, x - dx AS x, sum(r * kx) AS rx, sum(r * ky) AS ry, sum(g * kx) AS gx, sum(g * ky) AS gy FROM whole, o GROUP BY 1, 2, 3)
SELECT image, round(avg(abs(sqrt(rx * rx + ry * ry + 1e-8) - sqrt(gx * gx + gy * gy + 1e-8))), 6) AS edge FROM n SEMI JOIN whole USING (image, y, x) GROUP BY image""")
def edge_loss(spark, d):
    p = _whole(spark, d)
    return _r(image_quality.edge_loss(p.select("image", "y", "x", F.col("r").alias("v")), p.select("image", "y", "x", F.col("g").alias("v"))), "edge")


@query(f"WITH {BOX}, {PIX}, e AS (SELECT image, avg(power(r - g, 2)) AS mse FROM pix GROUP BY image) SELECT round(avg(10 * log10(mse + 1e-8)), 6) AS loss FROM e")
def psnr_loss(spark, d):
    p = pixels(spark, d)
    losses = image_quality.pixel_losses(p.select("image", "y", "x", F.col("r").alias("v")), p.select("image", "y", "x", F.col("g").alias("v")))
    return losses.agg(F.round(F.avg(image_quality.psnr_loss(F.col("mse"))), 6).alias("loss"))


@query(f"WITH {BOX}, {PIX} SELECT p.image, i.idx, (p.y - i.y1)::INT AS y, (p.x - i.x1)::INT AS x, r, g, b FROM pix p JOIN (SELECT page AS image, idx, (x1 % 12)::INT AS x1, (y1 % 6)::INT AS y1 FROM box WHERE idx % 16 = 0) i ON p.image = i.image AND p.x >= x1 AND p.x < x1 + 4 AND p.y >= y1 AND p.y < y1 + 3")
def cropped_pixels(spark, d):
    x1, y1 = (F.col("x1") % 12).cast("int"), (F.col("y1") % 6).cast("int")
    small = boxes(spark, d).where("idx % 16 = 0").select(F.col("page").alias("image"), "idx", x1.alias("x1"), y1.alias("y1"), (x1 + 4).alias("x2"), (y1 + 3).alias("y2"))
    return restoration.cropped(pixels(spark, d), small)


@query(f"WITH {BOX}, {PIX}, o AS (SELECT image, r, row_number() OVER (PARTITION BY image ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY image) AS n FROM pix) SELECT image, r AS median FROM o WHERE i = n // 2")
def upper_median(spark, d):
    return restoration.upper_median(pixels(spark, d), ["image"], "r")


_MODES = ", ".join(f"m{c} AS (SELECT image, {c} AS m{c} FROM pix GROUP BY image, {c} QUALIFY row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, {c}) = 1)" for c in "rgb")


@query(f"WITH {BOX}, {PIX}, {_MODES} SELECT image, y, x, CASE WHEN (x + y) % 5 = 0 THEN mr ELSE r END AS r, CASE WHEN (x + y) % 5 = 0 THEN mg ELSE g END AS g, CASE WHEN (x + y) % 5 = 0 THEN mb ELSE b END AS b FROM pix JOIN mr USING (image) JOIN mg USING (image) JOIN mb USING (image)")
def masked_by_mode(spark, d):
    p = pixels(spark, d)
    return restoration.masked_by_mode(p, p.where((F.col("x") + F.col("y")) % 5 == 0).select("image", "y", "x", F.lit(1).alias("m")))


@query(f"WITH {BOX}, {PIX} SELECT image, y, x, " + ", ".join(f"CASE WHEN x % 3 = 0 THEN floor(0.5e0 * {c} + 0.5e0 * {v} + 1e-9)::INT ELSE {c} END AS {c}" for c, v in (("r", 130), ("g", 150), ("b", 160))) + " FROM pix")
def transparent_stain(spark, d):
    p = pixels(spark, d)
    return restoration.stained(p, p.select("image", "y", "x", F.when(F.col("x") % 3 == 0, 1).otherwise(0).alias("m")), (130, 150, 160), 0.5)


@query(f"""WITH {BOX}, {PIX}, w AS (SELECT image, max(x) AS w FROM pix GROUP BY image), back AS (SELECT image, y, w - x AS x, CASE WHEN (0.2125e0 * r + 0.7154e0 * g + 0.0721e0 * b) / 255 * 2 - 1 > 0 THEN 1.0e0 ELSE 0.5e0 END AS f FROM pix JOIN w USING (image))
SELECT image, y, x, floor(r * coalesce(f, 1))::INT AS r, floor(g * coalesce(f, 1))::INT AS g, floor(b * coalesce(f, 1))::INT AS b FROM pix LEFT JOIN back USING (image, y, x)""")
def mirror_ghost(spark, d):
    return restoration.mirror_ghost(pixels(spark, d))


def _load_negative():
    """A stand-in for a restoration model: the negative where the mask is."""
    return lambda image, mask: image * (1 - mask[:, :, None]) + (255 - image.astype(float)) * mask[:, :, None]


_NEGATIVE = ", ".join(f"CASE WHEN b > 127 THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb")


@query(f"WITH {BOX}, {PIX}, {WHOLE} SELECT image, y, x, {_NEGATIVE} FROM whole")
def patch_restoration(spark, d):
    """The stand-in looks at single pixels, so overlapping patches agree and the blend gives their value."""
    masked = _whole(spark, d).withColumn("m", (F.col("b") > 127).cast("int"))
    return restoration.restored_by_patches(masked, "negative", _load_negative, size=16, overlap=8)


_NEGATIVE_AGAIN = ", ".join(f"CASE WHEN m THEN 255 - floor(pow({c} / 255.0e0, 1 / 1.5e0) * 255.0e0)::INT ELSE floor(pow({c} / 255.0e0, 1 / 1.5e0) * 255.0e0)::INT END AS {c}" for c in "rgb")


@query(f"WITH {BOX}, {PIX}, {WHOLE}, first AS (SELECT image, y, x, b > 127 AS m, {_NEGATIVE} FROM whole) SELECT image, y, x, {_NEGATIVE_AGAIN} FROM first")
def two_stage_restoration(spark, d):
    masked = _whole(spark, d).withColumn("m", (F.col("b") > 127).cast("int"))
    return restoration.restored_in_stages(masked, [("negative", _load_negative)] * 2, size=16, overlap=8)


def _load_planes():
    """A stand-in for a model of four planes: white where the mask is."""
    return lambda planes: [planes[:, :, :3], planes[:, :, :3] + planes[:, :, 3:]]


@query(f"WITH {BOX}, {PIX}, {WHOLE}, h AS (SELECT image, max(y) + 1 AS h FROM whole GROUP BY image) SELECT image, y, x, " + ", ".join(f"CASE WHEN (x // 2 + y * 2 // h) % 2 = 0 THEN 255 ELSE {c} END AS {c}" for c in "rgb") + " FROM whole JOIN h USING (image)")
def mask_restoration(spark, d):
    """Masks of eight by two places, whatever the image's height."""
    p = _whole(spark, d)
    places = p.select("image").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mask = places.withColumn("m", F.when((F.col("x") + F.col("y")) % 2 == 0, 255).otherwise(0))
    return restoration.restored_with_mask(p, mask, "planes", _load_planes)


@query(f"WITH {BOX} SELECT page, idx, round(16 * cos(acos(least(greatest((part % 201 - 100) / 100.0e0, -1 + 1e-7), 1 - 1e-7)) + 0.3e0), 6) AS logit, round(0.5e0 - 0.5e0 * cos(pi() * (idx % 32) / 32), 9) AS ramp, round((part % 50) / 50.0e0 * (1 + 0.25e0 * (line % 2)), 9) AS boosted, round(sqrt(0.64e0) * (part % 7) + sqrt(0.36e0) * (supp % 5), 9) AS noised FROM box")
def model_formulas(spark, d):
    """Margin logits, ramps, text boosts and noised samples."""
    p = F.col("part")
    out = {"logit": numbers.margin_logit((p % 201 - 100) / 100.0), "ramp": numbers.cosine_ramp(F.col("idx") % 32, 32), "boosted": numbers.text_boost((p % 50) / 50.0, F.col("line") % 2), "noised": numbers.q_sample(p % 7, F.col("supp") % 5, F.lit(0.64))}
    return boxes(spark, d).select("page", "idx", *[F.round(c, 6 if n == "logit" else 9).alias(n) for n, c in out.items()])


@query(f"WITH {DEC} SELECT page, pos, topk_chars[1] AS greedy, topk_chars[1] || '(0.50), ' || topk_chars[2] || '(0.25), ' || topk_chars[3] || '(0.17)' AS label FROM dec")
def candidate_labels(spark, d):
    top = F.transform("topk_chars", lambda c, i: F.struct(c.alias("char"), (0.5 / (i + 1)).alias("prob")))
    out = decode.greedy(decoded(spark, d).drop("greedy").withColumn("candidates", top))
    return out.select("page", "pos", "greedy", text.candidates_label(F.col("candidates")).alias("label"))


@query("SELECT p_partkey, 'Brand#' || CASE WHEN p_size % 60 < 40 THEN (p_size % 60)::VARCHAR ELSE '?' END AS char FROM part")
def class_lookup(spark, d):
    classes = spark.range(40).select(F.col("id").cast("int").alias("class_id"), F.col("id").cast("string").alias("char"))
    items = _table(spark, d, "part").select("p_partkey", F.array(F.struct((F.col("p_size") % 60).cast("int").alias("class_id"), F.lit(-1.0).alias("logp"))).alias("topk"))
    named = recognise.with_characters(items, classes)
    return named.select("p_partkey", F.concat(F.lit("Brand#"), F.get("candidates", F.lit(0))["char"]).alias("char"))


@query(f"WITH {BOX}, {PIX} SELECT image, count(*) FILTER (WHERE r > 125) AS white, sum(255 - r)::BIGINT AS inverted, round(avg(0.299e0 * r + 0.587e0 * g + 0.114e0 * b), 6) AS grey FROM pix GROUP BY image")
def binarised(spark, d):
    p = pixels(spark, d)
    light = numbers.luma(F.col("r"), F.col("g"), F.col("b"))
    return p.groupBy("image").agg(F.count_if(raster.binarise(F.col("r")) == 255).alias("white"), F.sum(255 - F.col("r")).cast("long").alias("inverted"), F.round(F.avg(light), 6).alias("grey"))


@query("WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT i::INT AS i, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM e GROUP BY i")
def vector_moments(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("features"))
    mean, cov = image_quality.moments(e)
    return spark.createDataFrame([(i, round(float(mean[i]), 6), round(float(cov[i, i]), 6)) for i in range(len(mean))], "i int, mean double, variance double")


# --- files ----------------------------------------------------------------------------------------------------------


@query(f"WITH {BOX} SELECT 'U+' || printf('%X', 12354 + part % 80) AS \"Unicode\", page::VARCHAR AS \"Image\", x1::DOUBLE AS \"X\", y1::DOUBLE AS \"Y\", (x2 - x1)::DOUBLE AS \"Width\", (y2 - y1)::DOUBLE AS \"Height\", how FROM box, (SELECT unnest(['name', 'place']) AS how)")
def coordinate_files(spark, d):
    """Coordinates as CSV, read by column name and by place."""
    notation = F.concat(F.lit("U+"), F.hex(F.unhex(F.hex(12354 + F.col("part") % 80))))
    rows = boxes(spark, d).select(notation.alias("Unicode"), F.col("page").alias("Image"), F.col("x1").alias("X"), F.col("y1").alias("Y"), F.lit("B").alias("Block ID"), "idx", (F.col("x2") - F.col("x1")).alias("Width"), (F.col("y2") - F.col("y1")).alias("Height"))
    path = stages.new_folder(spark, "coordinates")
    rows.write.option("header", True).csv(path)
    return readers.coordinates(spark, path).withColumn("how", F.lit("name")).unionByName(readers.coordinates_by_position(spark, path).withColumn("how", F.lit("place")))


@query(f"WITH {REC} SELECT 'folder=' || folder AS folder, (row_number() OVER (PARTITION BY folder ORDER BY pos) - 1)::INT AS pos, char, prob FROM rec")
def recognition_files(spark, d):
    """One JSON list in each folder, read again."""
    item = F.struct("pos", F.struct("char", "prob").alias("p"))
    lists = recognitions(spark, d).groupBy("folder").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"])).alias("value"))
    path = stages.new_folder(spark, "recognitions")
    lists.write.partitionBy("folder").text(path)
    return readers.recognitions(spark, path, "part-*").select("folder", "pos", "char", "prob")


@query("WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i FROM part GROUP BY p_brand) SELECT i::INT AS class_id, p_brand AS unicode, p_brand AS char, how FROM c, (SELECT unnest(['list', 'map']) AS how)")
def class_files(spark, d):
    """Classes as lines and as one JSON object with numbers as keys."""
    names = datasets.class_index(_table(spark, d, "part").select(F.col("p_brand").alias("cls")))
    lines, object_ = stages.new_folder(spark, "class-list"), stages.new_folder(spark, "class-map")
    names.coalesce(1).sortWithinPartitions("class_id").select(F.col("cls").alias("value")).write.text(lines)
    names.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("class_id").cast("string"), "cls")))).alias("value")).write.text(object_)
    listed = readers.class_list(spark, lines).withColumn("how", F.lit("list"))
    return listed.unionByName(readers.class_map(spark, object_).withColumn("how", F.lit("map")))


@query("WITH t AS (SELECT 'source=' || source AS book_id, string_agg(coalesce(lang, '') || ' ' || doc_id, chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY source) SELECT book_id, md5(text) AS digest, strlen(text)::BIGINT AS size FROM t")
def page_text_files(spark, d):
    item = F.struct("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.col("doc_id").cast("string")).alias("t"))
    books = _table(spark, d, "documents").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n").alias("value"))
    path = stages.new_folder(spark, "page-texts")
    books.write.partitionBy("source").text(path)
    return readers.page_texts(spark, path).select("book_id", F.md5("text").alias("digest"), "size")


@query("SELECT chr(65279) || 'p_type,n' AS line UNION ALL SELECT p_type || ',' || count(*) FROM part GROUP BY p_type")
def csv_report_file(spark, d):
    path = stages.new_folder(spark, "report")
    sinks.csv_report(_table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), path, ["p_type"])
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)  # a text reader leaves the mark out
    return raw.select(F.explode(F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n")).alias("line"))


@query("SELECT '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS document FROM nation")
def json_array_file(spark, d):
    path = stages.new_folder(spark, "array")
    sinks.json_array(_table(spark, d, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"])
    return spark.read.text(path).withColumnRenamed("value", "document")


@query("SELECT p_partkey::VARCHAR AS key, p_partkey || '.png (' || p_size || ',' || p_size * 2 || ',3) 1' AS meta FROM part WHERE p_partkey IN (1, 7, 100)")
def store_files(spark, d):
    """An image store, asked for three keys."""
    path = stages.new_folder(spark, "store")
    size = F.col("p_size").cast("int")
    images = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.lit(b"").alias("data"), size.alias("h"), (size * 2).alias("w"), F.lit(3).alias("c"))
    sinks.image_store(images, path)
    return readers.store_get(spark, path, ["1", "7", "100", "none"]).select("key", "meta")


@query(f"SELECT split, count(*) AS n FROM documents JOIN (VALUES {_SPLIT_VALUES}) s(split, source) USING (source) GROUP BY split")
def split_files(spark, d):
    """Written once; the second call finds the files and keeps them."""
    path = stages.new_folder(spark, "split")
    members = datasets.split_members(_table(spark, d, "documents").select("doc_id", "source"), _SPLITS, "source")
    for _ in range(2):
        sinks.materialise_split(members, path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS num_texts, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, round(avg(length(text)), 6) AS mean_len, count(*) AS lines, least(20, count(*)) AS previewed FROM (SELECT lang || '-' || doc_id AS text FROM documents WHERE lang IS NOT NULL)")
def corpus_files(spark, d):
    path = stages.new_folder(spark, "corpus")
    lines = _table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("page"), F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("text"))
    sinks.corpus(lines, path)
    meta = spark.read.schema("num_texts long, min_len int, max_len int, mean_len double").json(f"{path}/meta")
    count = lambda p, name: spark.read.text(f"{path}/{p}").agg(F.count(F.lit(1)).alias(name))
    return _r(meta.crossJoin(count("text", "lines")).crossJoin(count("preview", "previewed")), "mean_len")  # one row each


@query("SELECT user_id::VARCHAR AS folder, count(*) AS n FROM events GROUP BY user_id")
def json_lines_files(spark, d):
    path = stages.new_folder(spark, "lines")
    sinks.json_lines(recognitions(spark, d), path)
    rows = spark.read.schema("folder string, pos long, char string, prob double").json(path)
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


# --- checks, runs and registered measures ---------------------------------------------------------------------------

_CHECK = f"""{BOX}, b AS (SELECT page, count(*) AS bbox_n FROM box GROUP BY page), t AS (SELECT doc_id AS page, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN chr(12288) || chr(8203) ELSE repeat('a? b' || chr(10), (doc_id * 7 % 60)::INT) END AS text FROM documents),
c AS (SELECT page, text, replace(replace(regexp_replace(text, '[\\r\\n]', '', 'g'), chr(12288), ' '), ' ', '') AS line FROM t), k AS (SELECT page, bbox_n, length(line) AS gt_n, length(line) - length(replace(line, '?', '')) AS target_n, CASE WHEN text = '' THEN 'size==0' WHEN page % 5 = 1 OR line = '' THEN 'only_whitespace/invisible' END AS blank_reason, bbox_n - length(line) AS diff, CASE WHEN bbox_n = length(line) THEN 'OK' ELSE 'NG' END AS status FROM b JOIN c USING (page))"""


def _checked(spark, d) -> DataFrame:
    n = F.col("doc_id")
    body = F.when(n % 5 == 0, "").when(n % 5 == 1, "\u3000\u200b").otherwise(F.expr("repeat('a? b\\n', int(doc_id * 7 % 60))"))
    texts = _table(spark, d, "documents").select(n.alias("page"), body.alias("text"))
    return evalstats.text_check(boxes(spark, d), texts).select("page", "bbox_n", "gt_n", "target_n", "blank_reason", "diff", "status")


@query(f"WITH {_CHECK} SELECT page, bbox_n, gt_n, target_n, CASE WHEN text_empty THEN 'size==0' ELSE blank_reason END AS blank_reason, diff, status FROM (SELECT k.*, (SELECT any_value(text = '') FROM c WHERE c.page = k.page) AS text_empty FROM k)")
def bbox_text_check(spark, d):
    return _checked(spark, d)


@query(f"WITH {_CHECK} SELECT count(*) FILTER (WHERE status = 'OK') AS matched, count(*) FILTER (WHERE status = 'NG') AS mismatched, count(*) FILTER (WHERE target_n > 0) AS target_pages, coalesce(sum(target_n), 0)::BIGINT AS targets, count(blank_reason) AS blank_pages FROM k")
def bbox_text_totals(spark, d):
    return evalstats.text_check_totals(_checked(spark, d))


@query("WITH n AS (SELECT CASE WHEN page_id % 4 = 0 THEN 'cover' || page_id ELSE 'b' END AS odd, printf('%d_%05d_%d', page_id % 7, page_id * 37 % 1000, page_id % 2 + 1) AS good, page_id FROM pages), m AS (SELECT CASE WHEN page_id % 4 = 0 THEN odd ELSE good END AS name, CASE WHEN page_id % 4 = 0 THEN 4611686018427387904 ELSE page_id * 37 % 1000 END AS seq, CASE WHEN page_id % 4 = 0 THEN 4611686018427387904 ELSE page_id % 2 + 1 END AS side, page_id FROM n) SELECT name, page_id, row_number() OVER (ORDER BY seq, side, name, page_id) - 1 AS place FROM m QUALIFY count(*) OVER (PARTITION BY name) = 1")
def page_order(spark, d):
    p = F.col("page_id")
    name = F.when(p % 4 == 0, F.concat(F.lit("cover"), p.cast("string"))).otherwise(F.format_string("%d_%05d_%d", p % 7, p * 37 % 1000, p % 2 + 1))
    named = _table(spark, d, "pages").select(name.alias("name"), "page_id")
    ranked = datasets.in_page_order(named, rank="place")
    single = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return ranked.join(single.select("name"), "name", "left_semi").select("name", "page_id", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, '/out/scans/' || source || '/' || doc_id AS folder, '/out/scans/' || source || '/' || doc_id || '/patches' AS patches, '/out/scans/' || source || '/' || doc_id || '/' || doc_id || '.png' AS result FROM documents")
def output_folders(spark, d):
    files = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/scans/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return datasets.output_tree(files, "/out", "/in/scans/").select("doc_id", "folder", "patches", "result")


@query("SELECT folder, '/out/RESULT_' || folder AS output, eta FROM (SELECT DISTINCT source AS folder FROM documents), (SELECT unnest(['0.5', '1.0']) AS eta) WHERE starts_with(folder, 'src1')")
def sweep_runs(spark, d):
    folders = _table(spark, d, "documents").select(F.col("source").alias("folder")).distinct()
    return datasets.sweep(folders, "src1", "/out/", [{"eta": "0.5"}, {"eta": "1.0"}]).select("folder", "output", F.col("settings")["eta"].alias("eta"))


@query(f"WITH {BOX}, {PIX} SELECT image, round(20 * log10(255 / sqrt((2 * sum(power(r - g, 2)) + sum(power(2 * b - 255, 2))) / (3.0e0 * count(*)))), 5) AS all_psnr, round(20 * log10(255 / sqrt(avg(power((65.481e0 - 128.553e0) * (r - g) / 255 + 24.966e0 * (2 * b - 255) / 255, 2)))), 5) AS luma_psnr FROM pix GROUP BY image")
def registered_metrics(spark, d):
    wanted = {"all_psnr": {"type": "psnr"}, "luma_psnr": {"type": "psnr", "on_luma": True}}
    return _r(image_quality.measured(pixels(spark, d), _reference(spark, d), wanted), *wanted, digits=5)


@query(f"WITH {BOX}, {PIX} SELECT image, round(sum(abs(r - g) * b)::DOUBLE / nullif(sum(b), 0), 6) AS absolute, round(avg(power(r - g, 2)), 6) AS squared, round(sum(sqrt(power(r - g, 2) + 1e-12)), 6) AS charbonnier FROM pix GROUP BY image")
def weighted_losses(spark, d):
    r, g = F.col("r"), F.col("g")
    out = pixels(spark, d).groupBy("image").agg(numbers.absolute_loss(r, g, F.col("b")).alias("absolute"), numbers.squared_loss(r, g).alias("squared"), numbers.charbonnier_loss(r, g, how="sum").alias("charbonnier"))
    return _r(out, "absolute", "squared", "charbonnier")
