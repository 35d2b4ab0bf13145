"""The registered queries over the engine's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import media as M
from ..operators import dedupe, fold, kernels, ordering, reassemble, resample, table_functions, tiles, transform, validate
from ..session import keep, new_path, table
from ..sources import catalog
from ..sources import media as media_source
from ..sources import pixels, sink, video
from ..streaming import first_seen as streams
from ..streaming import counters, landing, stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PATHS = ["a.JPG", "b.jpeg", "dir/c.mp4", "d.flv", "e.tiff", "f", "g.tar.png", "", "h.WebM", "x.y/z", "frame_00012.png", "shot7_x9.bmp", ".gif"]
_PATHS = ", ".join(f"('{p}')" for p in PATHS)
_SUFFIX = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '[^.](\.[^.]*[^.])$', 1))"
_KIND = f"CASE WHEN {_SUFFIX} IN ('.jpg','.jpeg','.png','.webp','.bmp','.gif') THEN 'image' WHEN {_SUFFIX} IN ('.mp4','.mov','.avi','.webm','.mkv','.flv') THEN 'video' END"
_STEM = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\.[^.]+$', '\1')"


def _literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(rf"""
WITH p AS (SELECT path FROM (VALUES {_PATHS}) t(path) UNION ALL SELECT regexp_replace(url, '[?#].*$', '') FROM pages)
SELECT path, {_KIND} AS kind, {_SUFFIX} AS suffix, {_STEM} AS stem FROM p""")
def q01_classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _literals(spark, [(p,) for p in PATHS], "path string").unionByName(table(spark, sf_dir, "pages").select(M.strip_query(F.col("url")).alias("path")))
    return paths.select("path", M.classify(F.col("path")).alias("kind"), M.suffix(F.col("path")).alias("suffix"), M.stem(F.col("path")).alias("stem"))


def _mapped(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", *dict.fromkeys((*cols, "text")))
    return dedupe.mapping(docs, "doc_id", dedupe.fingerprint(F.col("text")))


_MAPPED = "SELECT *, min(doc_id) OVER (PARTITION BY text) AS unique_id FROM documents"


@query(f"SELECT doc_id, unique_id, doc_id <> unique_id AS is_duplicate FROM ({_MAPPED})")
def q02_dedupe_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("doc_id", "unique_id", "is_duplicate")


@query(f"""
SELECT source, count(*) AS total, count(*) FILTER (WHERE doc_id = unique_id) AS unique_items, count(*) FILTER (WHERE doc_id <> unique_id) AS duplicates,
  count(*) FILTER (WHERE doc_id <> unique_id) * 100.0::DOUBLE / count(*) AS duplicate_percentage FROM ({_MAPPED}) GROUP BY source""")
def q03_dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.stats(_mapped(spark, sf_dir, "source"), "source")


@query(f"SELECT unique_id, doc_id AS member_id, n AS n_members FROM (SELECT *, count(*) OVER (PARTITION BY unique_id) AS n FROM ({_MAPPED})) WHERE n > 1")
def q04_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.groups(_mapped(spark, sf_dir), "doc_id")


@query(f"SELECT doc_id, unique_id, printf('frame_%05d.png', doc_id) AS output_name, doc_id <> unique_id AS is_duplicate FROM ({_MAPPED})")
def q05_processing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.plan(_mapped(spark, sf_dir), "doc_id", M.frame_name(F.col("doc_id")))


@query(f"SELECT doc_id, source, n_chars FROM ({_MAPPED}) WHERE doc_id = unique_id")
def q06_unique_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.work_list(_mapped(spark, sf_dir, "source", "n_chars")).select("doc_id", "source", "n_chars")


def _word_count(work: DataFrame) -> DataFrame:
    return work.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n_words"))


def _narrow(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The mapping from a narrow table of hashes: texts are read once for it."""
    prints = dedupe.fingerprints(table(spark, sf_dir, "documents"), "doc_id", "text", *cols)
    return dedupe.mapping(prints, "doc_id", F.col("sg_print"))


@query(f"SELECT d.doc_id, d.unique_id, len(string_split(r.text, ' '))::BIGINT AS n_words FROM ({_MAPPED}) d JOIN documents r ON r.doc_id = d.unique_id")
def q07_compute_once_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reassemble.compute_once(_narrow(spark, sf_dir), _word_count, "doc_id", ["n_words"], docs).select("doc_id", "unique_id", "n_words")


@query(f"""
SELECT d.doc_id, CASE WHEN d.unique_id % 3 = 0 THEN d.n_chars ELSE len(string_split(r.text, ' ')) END::BIGINT AS n_words, d.unique_id % 3 = 0 AS is_missing
FROM ({_MAPPED}) d JOIN documents r ON r.doc_id = d.unique_id""")
def q08_fanout_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results missing for some representatives: the item's own value stands in."""
    mapped = _narrow(spark, sf_dir, "n_chars")
    work = table(spark, sf_dir, "documents").select("doc_id", "text").join(dedupe.work_list(mapped).select("doc_id"), "doc_id", "left_semi")
    results = _word_count(work).where("doc_id % 3 <> 0").withColumnRenamed("doc_id", "unique_id")
    return reassemble.fan_out(mapped, results, ["n_words"], fallback={"n_words": F.col("n_chars")}).select("doc_id", "n_words", "is_missing")


def _expected(spark: SparkSession, sf_dir: str) -> int:
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0]
    return 0 if last is None else last + 1


_MISSING = "SELECT i AS doc_id FROM (SELECT unnest(range((SELECT max(doc_id) + 1 FROM documents))) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)"


@query(_MISSING)
def q09_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing(table(spark, sf_dir, "labels"), "doc_id", _expected(spark, sf_dir))


@query(f"""
WITH m AS ({_MISSING}) SELECT (SELECT count(*) FROM m) AS n_offenders, (SELECT string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id) FROM (SELECT doc_id FROM m ORDER BY doc_id LIMIT 10)) AS first_ids,
  greatest((SELECT count(*) FROM m) - 10, 0) AS n_more""")
def q09b_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.report(q09_missing_ids(spark, sf_dir), "doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q10_extra_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.extra(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"))


_ISLANDS = "SELECT min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM (SELECT DISTINCT doc_id FROM labels)) GROUP BY g"


@query(_ISLANDS)
def q11_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.islands(table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT coalesce(max(n), 0) AS prefix_length FROM ({_ISLANDS}) WHERE first_id = 0")
def q11b_contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.contiguous_prefix(table(spark, sf_dir, "labels"), "doc_id")


@query("""
SELECT conv_id, count(turn) AS n, greatest(max(turn) + 1, 0) - count(DISTINCT turn) FILTER (WHERE turn >= 0) AS n_missing, count(turn) - count(DISTINCT turn) AS n_repeated,
  min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AND count(turn) = count(DISTINCT turn) AS is_complete FROM conversations GROUP BY conv_id""")
def q12_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sequence_check(table(spark, sf_dir, "conversations"), "conv_id", "turn")


_VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_SUM = "list_reduce(list_prepend(0.0::DOUBLE, {0}), lambda a, x: a + x)"
_HASH = f"array_to_string(list_transform({{0}}, lambda x: CASE WHEN x > m THEN '01' ELSE '00' END), '')"


@query(f"SELECT vec_id, {_HASH.format('v')} AS frame_hash FROM (SELECT vec_id, v, {_SUM.format('v')} / len(v) AS m FROM ({_VECTORS}))")
def q13_avg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", A.average_hash(F.col("embedding")).alias("frame_hash"))


_GREY = "list_transform(range(len({0}) // 3), lambda i: {0}[i * 3 + 1] * 0.299::DOUBLE + {0}[i * 3 + 2] * 0.587::DOUBLE + {0}[i * 3 + 3] * 0.114::DOUBLE)"
_BITS = "list_transform(range((len(g) + 3) // 4 - 1, -1, -1), lambda j: lower(printf('%x', (coalesce(g[j * 4 + 1] > m, false)::INT + 2 * coalesce(g[j * 4 + 2] > m, false)::INT + 4 * coalesce(g[j * 4 + 3] > m, false)::INT + 8 * coalesce(g[j * 4 + 4] > m, false)::INT)::INT)))"


@query(f"""
WITH v AS ({_VECTORS}), g AS (SELECT vec_id, {_GREY.format('v')} AS g FROM v), m AS (SELECT vec_id, g, {_SUM.format('g')} / len(g) AS m FROM g)
SELECT vec_id, array_to_string({_BITS}, '') AS gray_hash FROM m""")
def q14_gray_hash_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", A.gray(F.col("embedding")).alias("g"))
    return vectors.select("vec_id", A.gray_hash(F.col("g")).alias("gray_hash"))


@query(f"""
WITH h AS (SELECT vec_id, {_HASH.format('v')} AS h FROM (SELECT vec_id, v, {_SUM.format('v')} / len(v) AS m FROM ({_VECTORS})))
SELECT vec_id, min(vec_id) OVER (PARTITION BY h) AS unique_id, vec_id <> min(vec_id) OVER (PARTITION BY h) AS is_duplicate FROM h""")
def q15_hash_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return dedupe.mapping(vectors, "vec_id", A.average_hash(F.col("embedding"))).select("vec_id", "unique_id", "is_duplicate")


_DIMS = "SELECT p_partkey, (256 + p_size * 40)::INT AS h, (320 + (p_partkey % 97) * 16)::INT AS w, p_size FROM part"


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (256 + F.col("p_size") * 40).cast("int").alias("h"), (320 + F.col("p_partkey") % 97 * 16).cast("int").alias("w"), "p_size")


@query(f"""
WITH d AS ({_DIMS}), s AS (SELECT *, h::BIGINT * w <= 512 * 512 AS small FROM d),
y AS (SELECT *, unnest(CASE WHEN small THEN [0] ELSE generate_series(0, h - 1, 480) END) AS y FROM s),
x AS (SELECT *, unnest(CASE WHEN small THEN [0] ELSE generate_series(0, w - 1, 480) END) AS x FROM y)
SELECT p_partkey, y::INT AS y, x::INT AS x, (CASE WHEN small THEN h ELSE least(y + 512, h) END)::INT AS y_end, (CASE WHEN small THEN w ELSE least(x + 512, w) END)::INT AS x_end FROM x""")
def q16_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.grid(_dims(spark, sf_dir), "h", "w").select("p_partkey", "y", "x", "y_end", "x_end")


@query("""
WITH s AS (SELECT DISTINCT p_size AS h, length(p_name)::INT AS w, length(p_type)::INT - 5 AS o FROM part), y AS (SELECT *, unnest(range(h)) AS y FROM s), g AS (SELECT *, unnest(range(w)) AS x FROM y),
r AS (SELECT *, o > 0 AND o <= least(h, w) AS fits,
  CASE WHEN x >= w - o THEN (CASE WHEN o > 1 THEN (w - 1 - x) / nullif(o - 1, 0)::DOUBLE ELSE 0 END) WHEN x < o THEN (CASE WHEN o > 1 THEN x / nullif(o - 1, 0)::DOUBLE ELSE 0 END) ELSE 1 END AS wx,
  (CASE WHEN y < o THEN (CASE WHEN o > 1 THEN y / nullif(o - 1, 0)::DOUBLE ELSE 0 END) ELSE 1 END) * (CASE WHEN y >= h - o THEN (CASE WHEN o > 1 THEN (h - 1 - y) / nullif(o - 1, 0)::DOUBLE ELSE 0 END) ELSE 1 END) AS wy,
  (CASE WHEN x >= w - o THEN (w - x) / (o + 1)::DOUBLE WHEN x < o THEN (x + 1) / (o + 1)::DOUBLE ELSE 1 END) * (CASE WHEN y < o THEN (y + 1) / (o + 1)::DOUBLE ELSE 1 END) * (CASE WHEN y >= h - o THEN (h - y) / (o + 1)::DOUBLE ELSE 1 END) AS safe FROM g)
SELECT h, w, o, y::INT AS y, x::INT AS x, round(CASE WHEN fits THEN wx * wy ELSE 1 END, 9) AS weight, round(CASE WHEN fits THEN safe ELSE 1 END, 9) AS edge_safe FROM r""")
def q17_weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of tiles as high as each part's size, as wide as its name and with an overlap by its type."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("h"), F.length("p_name").alias("w"), (F.length("p_type") - 5).alias("o")).distinct()
    cells = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    args = [F.col(c) for c in ("y", "x", "h", "w", "o")]
    return cells.select("h", "w", "o", "y", "x", F.round(tiles.weight_2d(*args), 9).alias("weight"), F.round(tiles.weight_2d(*args, edge_safe=True), 9).alias("edge_safe"))


@query(f"""
WITH t AS (SELECT vec_id, v, unnest(generate_series(0, len(v) - 1, 12)) AS s FROM ({_VECTORS})), e AS (SELECT *, least(s + 16, len(v)) - s AS n FROM t),
p AS (SELECT vec_id, s, n, unnest(range(n)) AS k, v FROM e),
w AS (SELECT vec_id, s + k AS pos, v[s + k + 1] * (1 + s / 100.0::DOUBLE) AS value, CASE WHEN n < 4 THEN 1.0 WHEN k >= n - 4 THEN (n - k) / 5.0::DOUBLE WHEN k < 4 THEN (k + 1) / 5.0::DOUBLE ELSE 1.0 END AS weight FROM p)
SELECT vec_id, pos::INT AS pos, round(sum(value * weight) / greatest(sum(weight), 1e-8), 6) AS value FROM w GROUP BY vec_id, pos""")
def q18_weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("v"))
    cut = v.withColumn("s", F.explode(tiles.starts(F.size("v"), 16, 4))).withColumn("n", F.least(F.col("s") + 16, F.size("v")) - F.col("s"))
    cells = cut.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    weight = F.when(F.col("n") < 4, 1.0).otherwise(tiles.weight_1d(F.col("k"), F.col("n"), F.lit(4), edge_safe=True))
    placed = cells.select("vec_id", (F.col("s") + F.col("k")).alias("pos"), (F.get("v", F.col("s") + F.col("k")) * (1 + F.col("s") / 100.0)).alias("value"), weight.alias("weight"))
    return tiles.blend(placed, ["vec_id", "pos"], "value", "weight").withColumn("value", F.round("value", 6))


DIMS = [(3840, 2160, 1080), (2880, 2160, 1080), (1920, 1080, 2160), (854, 480, 1080), (1920, 1080, 1080), (1280, 720, 2160), (640, 480, 0)]
_PASS = "CASE WHEN {t} <= 0 OR {h} < 1 THEN 1 ELSE greatest(1, (SELECT min(k) FROM range(0, 33) r(k) WHERE {h} * {s}::DOUBLE ** k >= {t})) END::INT"


@query(f"""
WITH d AS (SELECT * FROM (VALUES {", ".join(map(str, DIMS))}) t(w, h, target) UNION ALL SELECT w, h, (p_size * 60)::INT FROM ({_DIMS}))
SELECT w::INT AS w, h::INT AS h, target::INT AS target, {_PASS.format(t="target", h="h", s=2)} AS passes_2, {_PASS.format(t="target", h="h", s=4)} AS passes_4,
  (CASE WHEN target / 120.0 > 2 THEN ceil(ln(target / 120.0::DOUBLE) / ln(2) - 1e-9) ELSE 1 END)::INT AS image_passes FROM d""")
def q19_upscale_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literals(spark, DIMS, "w int, h int, target int").unionByName(_dims(spark, sf_dir).select("w", "h", (F.col("p_size") * 60).cast("int").alias("target")))
    h, t = F.col("h"), F.col("target")
    return rows.select("w", "h", "target", M.passes(h, t, 2).alias("passes_2"), M.passes(h, t, 4).alias("passes_4"), M.image_passes(t / 120.0, F.lit(2.0)).alias("image_passes"))


@query(f"""
WITH d AS (SELECT * FROM (VALUES {", ".join(map(str, DIMS))}) t(w, h, target) UNION ALL SELECT w, h, (p_size * 60)::INT FROM ({_DIMS}))
SELECT w::INT AS w, h::INT AS h, target::INT AS target, floor(target * (w::DOUBLE / h))::INT AS fit_width, floor(w * 1.5::DOUBLE)::INT AS scaled_width,
  (CASE WHEN target > 0 AND h > target THEN floor(w * (target::DOUBLE / h)) ELSE w END)::INT AS pre_width, (CASE WHEN target > 0 AND h > target THEN target ELSE h END)::INT AS pre_height FROM d""")
def q20_resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literals(spark, DIMS, "w int, h int, target int").unionByName(_dims(spark, sf_dir).select("w", "h", (F.col("p_size") * 60).cast("int").alias("target")))
    w, h, t = F.col("w"), F.col("h"), F.col("target")
    return rows.select("w", "h", "target", M.fit_height(w, h, t).alias("fit_width"), M.scaled(w, F.lit(1.5)).alias("scaled_width"), M.pre_downscale_width(w, h, t).alias("pre_width"), M.pre_downscale_height(h, t).alias("pre_height"))


@query("""
WITH s AS (SELECT s_suppkey, abs(s_acctbal) / 700 AS gb, 2 ** (s_suppkey % 6) AS scale FROM supplier)
SELECT s_suppkey, (CASE WHEN scale >= 16 THEN 128 WHEN scale >= 8 THEN 256 ELSE 512 END)::INT AS tile, (CASE WHEN gb < 5 THEN 1 WHEN gb < 7 THEN 3 WHEN gb < 10 THEN 5 WHEN gb < 12 THEN 6 ELSE 8 END)::INT AS slots FROM s""")
def q21_auto_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.auto_tile(F.pow(F.lit(2), F.col("s_suppkey") % 6)).alias("tile"), M.slots(F.abs("s_acctbal") / 700).alias("slots"))


def _shown(values: F.Column) -> F.Column:
    """Values to six places as text, equal in any engine."""
    return F.array_join(F.transform(values, lambda x: F.bround(x * 1000000).cast("long").cast("string")), ",")


_SHOWN = "array_to_string(list_transform({0}, lambda q: round_even(q * 1000000, 0)::BIGINT::VARCHAR), ',')"
_CLAMP = "greatest(least({0}, 1.0::DOUBLE), 0.0::DOUBLE)"


@query(f"SELECT vec_id, {_SHOWN.format('list_transform(v, lambda x: ' + _CLAMP.format('(x - m) * 1.5::DOUBLE + m') + ')')} AS pixels FROM (SELECT vec_id, v, {_SUM.format('v')} / len(v) AS m FROM ({_VECTORS}))")
def q22_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _shown(A.contrast(F.col("embedding"), 1.5)).alias("pixels"))


@query(f"""
WITH g AS (SELECT vec_id, v, list_transform(range(len(v) // 3), lambda i: v[i * 3 + 1] * 0.299::DOUBLE + v[i * 3 + 2] * 0.587::DOUBLE + v[i * 3 + 3] * 0.114::DOUBLE) AS g FROM ({_VECTORS}))
SELECT vec_id, {_SHOWN.format("list_transform(range(len(g) * 3), lambda i: " + _CLAMP.format("g[i // 3 + 1] * (1 - 1.25::DOUBLE) + v[i + 1] * 1.25::DOUBLE") + ")")} AS pixels FROM g""")
def q23_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _shown(A.saturation(F.col("embedding"), 1.25)).alias("pixels"))


_AROUND = " + ".join(f"(CASE WHEN i // 8 + {dy} BETWEEN 0 AND 7 AND i % 8 + {dx} BETWEEN 0 AND 7 THEN v[(i // 8 + {dy}) * 8 + i % 8 + {dx} + 1] ELSE 0 END)" for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


@query(f"""SELECT vec_id, {_SHOWN.format("list_transform(range(64), lambda i: " + _CLAMP.format(f"v[i + 1] * (9.0::DOUBLE + 8 * 0.5::DOUBLE) - ({_AROUND}) * 0.5::DOUBLE") + ")")} AS pixels,
  {_SHOWN.format("list_transform(range(64), lambda i: " + _CLAMP.format(f"v[i + 1] * (1.0::DOUBLE + 8 * 0.5::DOUBLE) - ({_AROUND}) * 0.5::DOUBLE") + ")")} AS normalised FROM ({_VECTORS})""")
def q24_sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", _shown(A.sharpen(v, 8, 0.5)).alias("pixels"), _shown(A.sharpen(v, 8, 0.5, normalised=True)).alias("normalised"))


@query(f"SELECT vec_id, array_to_string(list_transform(v, lambda x: round_even({_CLAMP.format('x')} * 255, 0)::INT::VARCHAR), ',') AS bytes FROM ({_VECTORS})")
def q25_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(A.quantise(F.col("embedding")).cast("array<string>"), ",").alias("bytes"))


@query(f"""
WITH o AS (SELECT vec_id, list_transform(v, lambda x, i: CASE WHEN (i - 1) % 10 <> label THEN x * 1.5::DOUBLE WHEN i % 3 = 0 THEN 'nan'::DOUBLE WHEN i % 3 = 1 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)),
s AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN isnan(x) THEN 0.0::DOUBLE WHEN x = 'inf' THEN 1.0 WHEN x = '-inf' THEN 0.0 ELSE x END) AS a, list_transform(v, lambda x: CASE WHEN isnan(x) THEN 0.5::DOUBLE WHEN x = 'inf' THEN 1.0 WHEN x = '-inf' THEN 0.0 ELSE x END) AS b FROM o)
SELECT vec_id, {', '.join(f"array_to_string(list_transform({c}, lambda x: round_even({_CLAMP.format('x')} * 255, 0)::INT::VARCHAR), ',') AS {name}" for c, name in (('a', 'tiled'), ('b', 'batch')))} FROM s""")
def q25b_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN and infinities at places that each vector's label names, replaced by both rules."""
    odd = lambda i: F.when(i % 3 == 2, float("nan")).when(i % 3 == 0, float("inf")).otherwise(float("-inf"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.doubles(F.col("embedding")), lambda x, i: F.when(i % 10 != F.col("label"), x * 1.5).otherwise(odd(i))).alias("v"))
    shown = lambda nan: F.array_join(A.quantise(F.col("v"), nan).cast("array<string>"), ",")
    return rows.select("vec_id", shown(0.0).alias("tiled"), shown(0.5).alias("batch"))


@query(f"""
WITH q AS (SELECT vec_id, list_transform(v, lambda x: round_even({_CLAMP.format('x')} * 255, 0)) AS q FROM ({_VECTORS}))
SELECT vec_id, array_to_string(list_transform(range(48), lambda k: round_even(q[k // 3 * 4 + 4] / 255.0::DOUBLE * q[k // 3 * 4 + k % 3 + 1] + (1 - q[k // 3 * 4 + 4] / 255.0::DOUBLE) * 255.0, 0)::INT::VARCHAR), ',') AS flat FROM q""")
def q26_alpha_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as 16 pixels of colour and alpha, over white."""
    bytes_of = table(spark, sf_dir, "embeddings").select("vec_id", A.quantise(F.col("embedding")).alias("q"))
    flat = A.let(F.col("q"), lambda q: F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: A.flatten_alpha(F.get(q, F.floor(k / 3).cast("int") * 4 + k % 3), F.get(q, F.floor(k / 3).cast("int") * 4 + 3))))
    return bytes_of.select("vec_id", F.array_join(flat.cast("array<string>"), ",").alias("flat"))


@query(f"""
WITH q AS (SELECT vec_id, list_transform(v, lambda x: round_even({_CLAMP.format('x')} * 255, 0)) AS q FROM ({_VECTORS})),
g AS (SELECT vec_id, q, (vec_id // 32 % 64 * 4)::INT AS top, (vec_id % 32 * 4)::INT AS side FROM q)
SELECT vec_id, array_to_string(list_transform(range(16), lambda k: round_even(q[k * 4 + 4] / 255.0::DOUBLE * q[k * 4 + 1] + (1 - q[k * 4 + 4] / 255.0::DOUBLE) * (CASE WHEN ((side + k % 4) // 16 + (top + k // 4) // 16) % 2 = 0 THEN 200 ELSE 170 END), 0)::INT::VARCHAR), ',') AS shown FROM g""")
def q27_checkerboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pieces of a wall, 4 x 4 pixels each, their first colour over the squares behind them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.quantise(F.col("embedding")).alias("q"), F.expr("cast(vec_id div 32 % 64 * 4 AS int)").alias("top"), F.expr("cast(vec_id % 32 * 4 AS int)").alias("side"))
    behind = lambda k: A.checkerboard(F.col("top") + F.floor(k / 4), F.col("side") + k % 4)
    shown = A.let(F.col("q"), lambda q: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: A.flatten_alpha(F.get(q, k * 4), F.get(q, k * 4 + 3), behind(k))))
    return rows.select("vec_id", F.array_join(shown.cast("array<string>"), ",").alias("shown"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch_id, ((row_number() OVER (ORDER BY event_id) - 1) // 50) % 3 = 0 AS is_checkpoint FROM events")
def q28_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = ordering.micro_batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 50)
    return batches.withColumn("is_checkpoint", ordering.every(F.col("batch_id"), 3))


@query("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events")
def q29_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.look_ahead(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id", "next_id")


@query("SELECT event_id, user_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ',') AS buffer FROM events")
def q30_sliding_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.sliding_buffer(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id", 5)
    return rows.withColumn("buffer", F.array_join(F.col("buffer").cast("array<string>"), ","))


@query("SELECT event_id, round(row_number() OVER (ORDER BY event_id) / (SELECT count(*) FROM events)::DOUBLE, 9) AS progress, round(0.2 + 0.6 * (row_number() OVER (ORDER BY event_id) / (SELECT count(*) FROM events)::DOUBLE), 9) AS scaled FROM events")
def q31_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ordering.progress(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return done.select("event_id", F.round("progress", 9).alias("progress"), F.round(ordering.scale_progress(F.col("progress"), 0.2, 0.6), 9).alias("scaled"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def q32_preview_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first hundred by id."""
    return ordering.first_rows(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", 100)


@query(r"""
WITH l AS (SELECT DISTINCT p_brand || '.pth' AS file FROM part WHERE p_size > 48 UNION SELECT DISTINCT p_name || '.safetensors' FROM part WHERE p_size = 1),
d AS (SELECT p_brand || '.pth' AS file, min(p_name) AS display_name, max(p_type) AS description FROM part GROUP BY p_brand),
p AS (SELECT l.file, coalesce(d.display_name, regexp_replace(l.file, '\.[^.]*$', '')) AS display_name, d.description, true AS is_local FROM l LEFT JOIN d USING (file))
SELECT * FROM p UNION ALL SELECT file, display_name, description, false FROM d WHERE file NOT IN (SELECT file FROM l) AND display_name NOT IN (SELECT display_name FROM p)""")
def q33_catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with an entry a brand against the files that there are: of large parts' brands, and of the smallest parts' names."""
    part = table(spark, sf_dir, "part")
    local = part.where("p_size > 48").select(F.concat("p_brand", F.lit(".pth")).alias("file")).union(part.where("p_size = 1").select(F.concat("p_name", F.lit(".safetensors")))).distinct()
    defaults = part.groupBy(F.concat("p_brand", F.lit(".pth")).alias("file")).agg(F.min("p_name").alias("display_name"), F.max("p_type").alias("description"))
    return catalog.available(local, defaults)


def _sql_value(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


def _sql_rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in rows)


_CODEC_NAMES = list(catalog.CODEC_SUFFIX)
_NAMES = "['" + "', '".join([*_CODEC_NAMES, "unknown"]) + "']"
_PROFILES = "['" + "', '".join(["High (Better)", "Main (8-bit)", "ProRes 422", "DNxHR HQ"]) + "']"
_FORMATS = "['" + "', '".join([x[0] for x in catalog.FRAME_FORMATS] + ["other"]) + "']"


@query(f"""
WITH p AS (SELECT p_partkey, {_NAMES}[p_partkey % 5 + 1] AS codec_label, {_PROFILES}[p_size % 4 + 1] AS profile_label, {_FORMATS}[p_partkey % 6 + 1] AS format_label FROM part),
c AS (SELECT * FROM (VALUES {_sql_rows(catalog.CODECS)}) t(codec_name, codec, alpha_support, profile_name, preset, cq, profile, pix_fmt, bitrate)),
f AS (SELECT * FROM (VALUES {_sql_rows(catalog.FRAME_FORMATS)}) t(name, format, compress_level, bits, quality))
SELECT p.p_partkey, c.codec, c.cq::INT AS cq, c.pix_fmt, f.format, f.quality::INT AS quality,
  CASE codec_label WHEN 'ProRes' THEN '.mov' WHEN 'DNxHD/DNxHR' THEN '.mov' ELSE '.mp4' END AS suffix
FROM p LEFT JOIN c ON c.codec_name = codec_label AND c.profile_name = profile_label JOIN f ON f.name = CASE WHEN format_label = 'other' THEN 'PNG - Normal (8-bit)' ELSE format_label END""")
def q34_codec_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        pick([*_CODEC_NAMES, "unknown"], F.col("p_partkey") % 5).alias("codec_label"),
        pick(["High (Better)", "Main (8-bit)", "ProRes 422", "DNxHR HQ"], F.col("p_size") % 4).alias("profile_label"),
        pick([x[0] for x in catalog.FRAME_FORMATS] + ["other"], F.col("p_partkey") % 6).alias("format_label"),
    )
    rows = catalog.with_frame_format(catalog.with_profile(parts, "codec_label", "profile_label"), "format_label")
    return rows.select("p_partkey", "codec", "cq", "pix_fmt", "format", "quality", catalog.codec_suffix(F.col("codec_label")).alias("suffix"))


NAME_TEXT = "x\n\n y \nz\n"


@query("""
WITH f AS (SELECT page_id AS input_ord, url FROM pages), n AS (SELECT * FROM (VALUES (0, 'x'), (1, 'y'), (2, 'z')) t(input_ord, name))
SELECT f.input_ord, f.url, n.name AS custom_name FROM f LEFT JOIN n USING (input_ord)""")
def q35_positional_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(1).select(F.posexplode(M.name_list(F.lit(NAME_TEXT))).alias("input_ord", "name"))
    return catalog.positional_names(table(spark, sf_dir, "pages").select(F.col("page_id").alias("input_ord"), "url"), names).select("input_ord", "url", "custom_name")


RATES = ["30000/1001", "25/1", "24", "bad", "1/0", "", "60/1/2", "12.5"]


@query(f"""
WITH r AS (SELECT unnest(RATES) AS rate UNION ALL SELECT unnest([p_size || '/' || (p_partkey % 7), p_size::VARCHAR, p_name, p_size || '/' || p_partkey || '/1', p_partkey || '/1001', p_size || '.5']) FROM part),
p AS (SELECT rate, string_split(rate, '/') AS s FROM r)
SELECT rate, round(coalesce(CASE WHEN len(s) = 1 THEN try_cast(s[1] AS DOUBLE) WHEN len(s) = 2 THEN try_cast(s[1] AS DOUBLE) / nullif(try_cast(s[2] AS DOUBLE), 0) END, 24.0), 6) AS fps FROM p""".replace("RATES", str(RATES)))
def q36_fps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates spelt from the columns of every part: fractions, numbers, words, and what isn't any of them."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    spelt = [F.concat(size, F.lit("/"), (F.col("p_partkey") % 7).cast("string")), size, F.col("p_name"), F.concat(size, F.lit("/"), key, F.lit("/1")), F.concat(key, F.lit("/1001")), F.concat(size, F.lit(".5"))]
    rates = table(spark, sf_dir, "part").select(F.explode(F.array(*spelt)).alias("rate")).unionByName(_literals(spark, [(r,) for r in RATES], "rate string"))
    return rates.select("rate", F.round(M.fps(F.col("rate")), 6).alias("fps"))


@query("""
WITH s AS (SELECT n FROM (VALUES (1023::BIGINT), (1024), (1048575), (1048576), (1073741824), (5000000000)) t(n) UNION ALL SELECT n_chars FROM documents)
SELECT n, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GB', n / 1073741824.0::DOUBLE) END AS size FROM s""")
def q37_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _literals(spark, [(n,) for n in (1023, 1024, 1048575, 1048576, 1073741824, 5000000000)], "n long").unionByName(table(spark, sf_dir, "documents").select(F.col("n_chars").alias("n")))
    return rows.select("n", M.human_size(F.col("n")).alias("size"))


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, n, string_agg(doc_id::VARCHAR, '; ' ORDER BY doc_id) AS messages, greatest(n - 10, 0) AS n_more FROM r WHERE rn <= 10 GROUP BY source, n""")
def q38_report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first ten documents of each source, and how many more there are."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("message"))
    return validate.message_lists(docs, "source", "doc_id", "message")


@query("""
SELECT event_type, ts::DATE AS day, count(*) AS n, round(date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE, 6) AS elapsed_s,
  round(count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6::DOUBLE, 0), 6) AS per_second FROM events GROUP BY event_type, ts::DATE""")
def q39_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("a").cast("timestamp"), F.col("b").cast("timestamp")) / F.lit(1e6)
    return sums.select("event_type", "day", "n", F.round(seconds, 6).alias("elapsed_s"), F.round(F.try_divide(F.col("n"), seconds), 6).alias("per_second"))


@query(f"SELECT vec_id, {_SHOWN.format('list_transform(range(len(v) // 4), lambda i: (v[i * 4 + 1] + v[i * 4 + 2] + v[i * 4 + 3] + v[i * 4 + 4]) / 4)')} AS pixels, NULL::VARCHAR AS error FROM ({_VECTORS})")
def q40_batch_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = kernels.apply(table(spark, sf_dir, "embeddings"), "box_down", "vec_id", "embedding")
    return got.select("vec_id", _shown(F.col("result")).alias("pixels"), "error")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _collected(spark: SparkSession, stream: DataFrame, name: str, *order: str) -> DataFrame:
    """Run a bounded stream to its end into the shared folder and read the result.

    With ``order`` each micro-batch is handed to an ordered sink.
    """
    base = new_path(spark, name)
    if order:
        # a batch that is run again replaces its own folder
        sink = streams.ordered_sink(lambda batch, i: batch.write.mode("overwrite").parquet(f"{base}/out/batch-{i}"), *order)
        writer, found = stream.writeStream.foreachBatch(sink), f"{base}/out/batch-*"
    else:
        writer, found = stream.writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/out"
    q = writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    ok, message = streams.run(q)
    if not ok:
        raise RuntimeError(message)
    return spark.read.schema(stream.schema).parquet(found)


@query("SELECT key, event_id, min(event_id) OVER (PARTITION BY key) AS unique_id, event_id <> min(event_id) OVER (PARTITION BY key) AS is_duplicate FROM (SELECT event_id, user_id::VARCHAR || '/' || event_type AS key FROM events)")
def q41_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _stream(spark, sf_dir).select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"))
    return _collected(spark, streams.first_seen(keyed, "key", "event_id"), "first-seen")


@query("SELECT event_id, event_type, printf('frame_%05d.png', event_id) AS output_name FROM events")
def q42_stream_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the ordered sink."""
    named = _stream(spark, sf_dir).select("event_id", "event_type", M.frame_name(F.col("event_id")).alias("output_name"))
    return _collected(spark, named, "ordered", "event_id")


@query("""
WITH m AS (SELECT unnest(['same', 'suffix', 'custom']) AS mode), p AS (SELECT page_id, 'v' || page_id AS name, mode FROM pages, m)
SELECT page_id, mode, CASE mode WHEN 'same' THEN name WHEN 'suffix' THEN name || '_up' ELSE CASE WHEN page_id % 2 = 0 THEN 'own' || page_id WHEN page_id % 3 = 0 THEN name ELSE 'shared' END END AS output_name FROM p""")
def q43_naming_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("v"), F.col("page_id").cast("string")).alias("name"), F.explode(F.array(*map(F.lit, ("same", "suffix", "custom")))).alias("mode"))
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" own"), F.col("page_id").cast("string")))
    shared = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.lit("shared"))
    return pages.select("page_id", "mode", M.output_name(F.col("mode"), F.col("name"), F.lit("_up"), own, shared).alias("output_name"))


LABELS = ["×1", "×2", "×16", "other", "FP16 (fast)", "fp32", "AUTO", "480p", "720p", "1080p", "Original"]


@query("""
WITH l AS (SELECT unnest(LABELS) AS label UNION ALL SELECT unnest(['×' || p_size, 'FP' || p_size || ' (fast)', 'fp' || p_size, p_size * 24 || 'p', p_type]) FROM part)
SELECT label, CASE WHEN label IN ('×1', '×2', '×3', '×4', '×8', '×16') THEN try_cast(replace(label, '×', '') AS DOUBLE) ELSE 2.0 END::DOUBLE AS factor, CASE WHEN lower(label) LIKE '%fp16%' THEN true WHEN lower(label) LIKE '%fp32%' THEN false END AS half,
  (CASE WHEN label LIKE '%480%' THEN 480 WHEN label LIKE '%720%' THEN 720 WHEN label LIKE '%1080%' THEN 1080 ELSE 0 END)::INT AS height FROM l""".replace("LABELS", str(LABELS)))
def q44_label_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels spelt from every part's size and type."""
    size, label = F.col("p_size").cast("string"), F.col("label")
    spelt = [F.concat(F.lit("×"), size), F.concat(F.lit("FP"), size, F.lit(" (fast)")), F.concat(F.lit("fp"), size), F.concat((F.col("p_size") * 24).cast("string"), F.lit("p")), F.col("p_type")]
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(*spelt)).alias("label")).unionByName(_literals(spark, [(x,) for x in LABELS], "label string"))
    return rows.select("label", M.scale_factor(label).alias("factor"), M.half_precision(label).alias("half"), M.downscale_limit(label).alias("height"))


@query(f"""SELECT doc_id, '{{"id":' || doc_id || ',"unique_id":' || unique_id || ',"output_path":"' || printf('frame_%05d.png', doc_id) || '","is_duplicate":' || (doc_id <> unique_id)::VARCHAR || '}}' AS manifest FROM ({_MAPPED})""")
def q45_manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.manifest(_mapped(spark, sf_dir), "doc_id", M.frame_name(F.col("doc_id")))


@query("""
WITH e AS (SELECT conv_id, count(*) AS expected, count(*) FILTER (WHERE turn % 4 <> 3 OR conv_id % 2 = 0) AS got FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE expected END AS expected, CASE WHEN conv_id % 5 = 0 THEN got + 1 WHEN conv_id % 11 = 0 THEN 0 ELSE got END AS got FROM e)
SELECT conv_id, CASE WHEN got = 0 THEN 'none' WHEN expected IS NULL OR expected = got THEN 'ok' WHEN got < expected THEN 'fewer' ELSE 'more' END AS status FROM s""")
def q46_extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = (F.col("turn") % 4 != 3) | (F.col("conv_id") % 2 == 0)
    sums = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("expected"), F.sum(seen.cast("long")).alias("got"))
    expected = F.when(F.col("conv_id") % 7 != 0, F.col("expected"))
    got = F.when(F.col("conv_id") % 5 == 0, F.col("got") + 1).when(F.col("conv_id") % 11 == 0, F.lit(0)).otherwise(F.col("got"))
    return sums.select("conv_id", media_source.extraction_status(expected, got).alias("status"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_size * 10 ELSE floor(p_size * 1.5 * 23.976::DOUBLE) END::BIGINT AS frames,
  CASE WHEN p_size % 3 + p_size % 2 > 1 THEN 'session/images' ELSE 'images' END AS folder FROM part""")
def q47_counts_and_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    packets = F.when((key % 3 != 0) & (key % 2 == 0), size * 10)
    duration = F.when(key % 3 != 0, size * F.lit(1.5))
    return table(spark, sf_dir, "part").select("p_partkey", media_source.frame_count(packets, duration, F.lit(23.976)).alias("frames"), M.output_folder(size % 3, size % 2, F.lit("image"), F.lit("session")).alias("folder"))


FRAMES = ["frame_00012.png", "frame_7_x.png", "shot9.png", "a_b_33.png", "none.png", "clip12_x9.png", "frame_100001.png"]


@query(r"""
WITH n AS (SELECT unnest(FRAMES) AS name UNION ALL SELECT unnest([printf('frame_%05d.png', vec_id), 'shot' || vec_id || '.png', 'a_b_' || vec_id || '.png', 'clip' || label || '_x' || vec_id || '.png', 'frame_' || vec_id || '_' || label || '.png']) FROM embeddings UNION ALL SELECT p_name || '.png' FROM part),
s AS (SELECT name, regexp_replace(name, '\.[^.]*$', '') AS stem FROM n)
SELECT name, coalesce(try_cast(nullif(regexp_extract(stem, '^[^_]*_(\d+)(?:_|$)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(stem, '(\d+)', 1), '') AS BIGINT)) AS frame_num FROM s""".replace("FRAMES", str(FRAMES)))
def q48_frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of names that every vector's id and label, and every part's name, are written into."""
    key, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    png = F.lit(".png")
    spelt = [M.frame_name(F.col("vec_id")), F.concat(F.lit("shot"), key, png), F.concat(F.lit("a_b_"), key, png), F.concat(F.lit("clip"), label, F.lit("_x"), key, png), F.concat(F.lit("frame_"), key, F.lit("_"), label, png)]
    names = table(spark, sf_dir, "embeddings").select(F.explode(F.array(*spelt)).alias("name")).unionByName(table(spark, sf_dir, "part").select(F.concat("p_name", png).alias("name"))).unionByName(_literals(spark, [(x,) for x in FRAMES], "name string"))
    return names.select("name", M.frame_number(F.col("name")).alias("frame_num"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q07_compute_once_fanout(spark, sf_dir)


@query(f"""
WITH n AS (SELECT count(*) AS l FROM ({_MAPPED}) WHERE doc_id = unique_id), m AS (SELECT count(DISTINCT unique_id) AS r FROM ({_MAPPED}))
SELECT l AS n_left, r AS n_right, l = r AS agrees FROM n, m""")
def q49_work_list_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list has as many items as there are representatives."""
    mapped = _mapped(spark, sf_dir)
    return validate.differs(dedupe.work_list(mapped), mapped.select("unique_id").distinct())


@query("""
WITH t AS (SELECT conv_id, turn // 4 AS segment, turn, role || ': ' || coalesce(text, '') AS line FROM conversations)
SELECT conv_id, segment::BIGINT AS segment, min(turn)::BIGINT AS first, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY turn, line)) AS digest FROM t GROUP BY conv_id, segment""")
def q50_ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in order, N to 1 by segments of four."""
    turns = table(spark, sf_dir, "conversations")
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    folded = fold.segments(turns, "conv_id", "turn", line, 4)
    return folded.select("conv_id", "segment", F.col("first").cast("long").alias("first"), "n", F.sha2(F.array_join("values", "\n"), 256).alias("digest"))


# tiles of 5 x 5 pixels with 2 in common over 8 x 8 images: starts 0, 3 and 6 on either axis
_RAMP = "(CASE WHEN {n} < 2 THEN 1 WHEN {p} >= {n} - 2 THEN ({n} - {p}) / 3.0::DOUBLE WHEN {p} < 2 THEN ({p} + 1) / 3.0::DOUBLE ELSE 1 END)"
_RAMP_Y = "(CASE WHEN {p} < 2 THEN ({p} + 1) / 3.0::DOUBLE ELSE 1 END) * (CASE WHEN {p} >= {n} - 2 THEN ({n} - {p}) / 3.0::DOUBLE ELSE 1 END)"
_TILES = f"""
WITH t AS (SELECT vec_id, v, y, x, least(y + 5, 8) - y AS h, least(x + 5, 8) - x AS w FROM ({_VECTORS}), (SELECT unnest([0, 3, 6]) AS y), (SELECT unnest([0, 3, 6]) AS x)),
c AS (SELECT *, i // w AS dy, i % w AS dx FROM (SELECT *, unnest(range(h * w)) AS i FROM t)),
p AS (SELECT vec_id, y + dy AS y, x + dx AS x, v[(y + dy) * 8 + x + dx + 1] * (1 + (y + x) / 100.0::DOUBLE) AS value,
  CASE WHEN least(h, w) < 2 THEN 1.0::DOUBLE ELSE {_RAMP.format(n='w', p='dx')} * {_RAMP_Y.format(n='h', p='dy')} END AS weight FROM c),
b AS (SELECT vec_id, y, x, sum(value * weight) / greatest(sum(weight), 1e-8) AS value FROM p GROUP BY vec_id, y, x)"""


@query(f"{_TILES} SELECT vec_id, y::INT AS y, x::INT AS x, round(value, 6) AS value FROM b")
def q51_tile_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over (y, x): tiles, a kernel that knows its tile, weighted recombination."""
    done = transform.single_pass(_squares(spark, sf_dir), "vec_id", "embedding", "h", "w", _by_tile, 5, 2)
    return transform.pixels(done, "vec_id").withColumn("value", F.round("value", 6))


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.lit(8).alias("h"), F.lit(8).alias("w"))


def _by_tile(tile: np.ndarray, y: int, x: int) -> np.ndarray:
    return tile * (1 + (y + x) / 100.0)


@query(f"""{_TILES},
g AS (SELECT vec_id, list(value ORDER BY y, x) AS v FROM b GROUP BY vec_id),
r AS (SELECT vec_id, list_transform(range(256), lambda i: v[(i // 16) // 2 * 8 + (i % 16) // 2 + 1]) AS v FROM g)
SELECT vec_id, array_to_string(list_transform(v, lambda q: round_even({_CLAMP.format('(q - m) * 1.5::DOUBLE + m')} * 10000, 0)::BIGINT::VARCHAR), ',') AS pixels FROM (SELECT vec_id, v, {_SUM.format('v')} / len(v) AS m FROM r)""")
def q52_composed_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, kernel, blend, resize and post-processing as one job."""
    done = transform.upscale(_squares(spark, sf_dir), "vec_id", "embedding", "h", "w", _by_tile, 1, 5, 2, target=F.lit(2), contrast=1.5, kind="nearest")
    shown = F.transform("values", lambda q: F.bround(q * 10000).cast("long").cast("string"))
    return done.select("vec_id", F.array_join(shown, ",").alias("pixels"))


# 8 x 8 frames of three channels from all 64 values
_FRAME = "flatten(list_transform(v, lambda x: [x, 1 - x, x * x]))"
_SAMPLED = f"list_transform(range(768), lambda i: f[((i // 48) // 2 * 8 + ((i // 3) % 16) // 2) * 3 + i % 3 + 1])"
_CHANNEL = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(256), lambda i: s[i * 3 + {0}])), lambda a, x: a + x) / 256"


def _frames(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    v = A.doubles(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", *cols, F.flatten(F.transform(v, lambda x: F.array(x, 1 - x, x * x))).alias("frame"))


@query(f"""
WITH f AS (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS})), s AS (SELECT vec_id, {_SAMPLED} AS s FROM f),
m AS (SELECT vec_id, s, [{', '.join(_CHANNEL.format(k) for k in (1, 2, 3))}] AS ms, {_GREY.format('s')} AS g FROM s), h AS (SELECT *, {_SUM.format('g')} / 256 AS m FROM m)
SELECT vec_id, array_to_string(list_transform(range(768), lambda i: CASE WHEN s[i + 1] > ms[i % 3 + 1] THEN '01' ELSE '00' END), '') AS frame_hash, array_to_string({_BITS}, '') AS gray_hash FROM h""")
def q53_frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both frame hashes at their full length: 1536 and 64 hex digits."""
    frame = F.col("frame")
    return _frames(spark, sf_dir).select("vec_id", A.frame_hash(frame, 8, 8).alias("frame_hash"), A.frame_gray_hash(frame, 8, 8).alias("gray_hash"))


@query(f"""
WITH f AS (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS}))
SELECT vec_id, 8 AS height, 8 AS width, list_sum(list_transform(f, lambda x: round_even({_CLAMP.format('x')} * 255, 0)::BIGINT))::BIGINT AS level, NULL::VARCHAR AS error FROM f""")
def q54_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames encoded as images and decoded again."""
    files = _frames(spark, sf_dir).select("vec_id", pixels.encode(F.col("frame"), 8, 8).alias("content"))
    level = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + F.bround(x * 255).cast("long"))
    return pixels.decode(files, "vec_id").select("vec_id", "height", "width", level.alias("level"), "error")


@query(f"""
WITH a AS (SELECT vec_id, list_transform(range(16), lambda i: v[i * 4 + 4]) AS a, v FROM ({_VECTORS}))
SELECT vec_id, {_SHOWN.format("flatten(list_transform(range(16), lambda i: [v[i * 4 + 1] / 2, v[i * 4 + 2] / 2, v[i * 4 + 3] / 2, a[i + 1]]))")} AS pixels FROM a""")
def q55_alpha_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha taken off, colours changed, alpha put back."""
    colours, alpha = A.split_alpha(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", _shown(A.join_alpha(F.transform(colours, lambda x: x / 2), alpha)).alias("pixels"))


@query("SELECT 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'total', (SELECT count(*) FROM documents) + (SELECT count(*) FROM pages)")
def q56_union_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.total(documents=table(spark, sf_dir, "documents"), pages=table(spark, sf_dir, "pages"))


@query("SELECT conv_id::VARCHAR AS conv_id, turn::BIGINT AS turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS released FROM conversations")
def q57_stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns released in order, by state that holds what is ahead of its turn."""
    turns = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(turns.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")
    return _collected(spark, stages.in_order(stream, "conv_id", "turn", "role"), "in-order")


@query("""
WITH p AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS place FROM pages), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM benchmark)
SELECT page_id, place, item_id FROM p LEFT JOIN b USING (place)""")
def q58_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th page with the n-th item; pages beyond the items have none."""
    pages = ordering.row_numbers(table(spark, sf_dir, "pages").select("page_id"), "page_id", "place")
    items = ordering.row_numbers(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", "place")
    return pages.join(items, "place", "left").select("page_id", "place", "item_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q59_still_to_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the labelled ones, taken as a buffer, don't hold yet."""
    return validate.absent(table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels"), "doc_id")


@query(r"""
SELECT p_partkey, CASE WHEN p_size >= 20 AND p_partkey % 2 = 0 THEN 'stream' ELSE 'batch' END AS mode, CASE WHEN p_size = 0 THEN NULL ELSE p_partkey::DOUBLE / p_size * 3 END AS speed_up,
  regexp_replace(p_name, '([^./])\.[^./]*$', '\1') || '.png' AS output_name FROM part""")
def q60_mode_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode by size, promised speed-up and output name of every part."""
    mode = M.streams_frames(F.lit(True), F.col("p_size"), F.col("p_partkey") % 2 == 0, F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(mode, "stream").otherwise("batch").alias("mode"), M.speed_up(F.col("p_partkey"), F.col("p_size"), F.lit(3)).alias("speed_up"), M.with_suffix(F.col("p_name"), ".png").alias("output_name"))


def _videos(spark: SparkSession, sf_dir: str, size: int, lost: Column, declared: Column) -> str:
    """A table of raw videos of ``size`` frames each, made from all vectors; ``lost`` frames are left out."""
    folder = new_path(spark, "videos")
    frames = _frames(spark, sf_dir, "label").withColumns({"video": F.expr(f"vec_id div {size}"), "frame_num": F.col("vec_id") % size})
    frames = frames.join(frames.groupBy("video").agg(F.sum(declared.cast("long")).alias("n")), "video")
    video.write_videos(frames, folder, F.col("video"), F.col("frame_num"), F.lit(8), F.lit(8), F.when(~lost, F.col("frame")), F.col("n"))
    return folder


def _level(scale: int = 255) -> Column:
    return F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + F.bround(x * scale).cast("long"))


_LEVEL = f"list_sum(list_transform({{0}}, lambda x: round_even({_CLAMP.format('x')} * {{1}}, 0)::BIGINT))::BIGINT"


@query(f"""
WITH f AS (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS}))
SELECT (vec_id // 16)::VARCHAR AS video, vec_id % 16 AS frame_num, 8 AS height, 8 AS width, {_LEVEL.format('f', 255)} AS level, NULL::VARCHAR AS error FROM f""")
def q61_video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N frames to a file and 1 file to N frames: every frame of every video that was written."""
    folder = _videos(spark, sf_dir, 16, F.lit(False), F.lit(True))
    return video.frames(spark, folder).select("video", "frame_num", "height", "width", _level().alias("level"), "error")


@query("""
WITH c AS (SELECT (vec_id // 4)::VARCHAR AS video, count(*) FILTER (WHERE label <> 0) AS expected, count(*) FILTER (WHERE label < 5) AS extracted FROM embeddings GROUP BY vec_id // 4)
SELECT video, expected, extracted, CASE WHEN extracted = 0 THEN 'none' WHEN expected = extracted THEN 'ok' WHEN extracted < expected THEN 'fewer' ELSE 'more' END AS status FROM c""")
def q62_extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file declares against the frames that are in it."""
    folder = _videos(spark, sf_dir, 4, F.col("label") >= 5, F.col("label") != 0)
    return media_source.extraction_report(video.headers(spark, folder), video.frames(spark, folder))


@query(f"""
WITH f AS (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS}) WHERE vec_id % 16 = 0)
SELECT (vec_id // 16)::VARCHAR AS video, {_LEVEL.format('f', 255)} AS level FROM f""")
def q63_video_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each video; the reader gets the filter."""
    folder = _videos(spark, sf_dir, 16, F.lit(False), F.lit(True))
    return video.first_frames(spark, folder).select("video", _level().alias("level"))


@query(f"""
WITH p AS (SELECT vec_id, label, {_FRAME} AS f, {_FORMATS}[label % 6 + 1] AS name FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)),
t AS (SELECT * FROM (VALUES {_sql_rows(catalog.FRAME_FORMATS)}) t(name, format, compress_level, bits, quality)),
c AS (SELECT vec_id, f, format, bits FROM p JOIN t ON t.name = CASE WHEN p.name = 'other' THEN 'PNG - Normal (8-bit)' ELSE p.name END)
SELECT vec_id::VARCHAR AS name, bits::INT AS bits, {_LEVEL.format('f', "(CASE WHEN bits = 16 THEN 65535 ELSE 255 END)")} AS level, NULL::VARCHAR AS error FROM c WHERE format = 'PNG'
UNION ALL SELECT vec_id::VARCHAR, NULL, NULL, 'no encoder for JPEG' FROM c WHERE format <> 'PNG'""")
def q64_image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the catalog's formats, saved as files, read again and decoded."""
    labels = F.element_at(F.array(*map(F.lit, [x[0] for x in catalog.FRAME_FORMATS] + ["other"])), F.col("label") % 6 + 1)
    frames = catalog.with_frame_format(_frames(spark, sf_dir, "label").withColumn("format_label", labels), "format_label")
    folder = new_path(spark, "images")
    images = keep(pixels.encode_as(frames, F.col("vec_id"), F.lit(8), F.lit(8), F.col("frame"), F.col("format"), F.col("compress_level"), F.col("bits")), "encoded")
    sink.write_files(images, folder)
    back = pixels.decode(sink.read_files(spark, folder), "path")
    deep = frames.select(F.col("vec_id").cast("string").alias("name"), "bits")
    decoded = back.select(M.stem(F.col("path")).alias("name"), "pixels", "error").join(deep, "name").select("name", "bits", F.when(F.col("bits") == 16, _level(65535)).otherwise(_level()).alias("level"), "error")
    return decoded.unionByName(images.where("error is not null").select("name", F.lit(None).cast("int").alias("bits"), F.lit(None).cast("long").alias("level"), "error"))


def _filter_sql(size: int, to: int, kind: str = "lanczos") -> str:
    """(o, i, w): the weight of place i for place o, as the filter is defined."""
    if kind == "bilinear":
        at = f"greatest((o + 0.5::DOUBLE) * {size / to!r} - 0.5, 0)"
        return f"SELECT o, least(i, {size - 1}) AS i, sum(w) AS w FROM (SELECT o, floor(a) AS i, 1 - (a - floor(a)) AS w FROM (SELECT o, {at} AS a FROM range({to}) r(o)) UNION ALL SELECT o, floor(a) + 1, a - floor(a) FROM (SELECT o, {at} AS a FROM range({to}) r(o))) GROUP BY o, least(i, {size - 1})"
    wide = max(size / to, 1.0)
    places = f"SELECT o, i, (i - c + 0.5) / {wide!r} AS d FROM (SELECT o, i, (o + 0.5::DOUBLE) * {size / to!r} AS c FROM range({to}) r(o), range({size}) s(i)) WHERE i >= floor(c - {3 * wide!r} + 0.5) AND i < floor(c + {3 * wide!r} + 0.5)"
    value = "CASE WHEN d = 0 THEN 1.0::DOUBLE WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0 END"
    return f"SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {value} AS w FROM ({places}))"


def _resized_sql(rows: str, weights: str, settle: str = "{0}") -> str:
    """``rows`` (vec_id, y, x, k, v) at another size: across, then down."""
    return f"SELECT vec_id, o AS y, x, k, {settle.format('sum(v * w)')} AS v FROM (SELECT vec_id, y, o AS x, k, {settle.format('sum(v * w)')} AS v FROM {rows} JOIN {weights} ON i = x GROUP BY ALL) JOIN {weights} ON i = y GROUP BY ALL"


_BYTE = "least(greatest(floor({0} + 0.5), 0), 255)"


@query(f"""
WITH wl AS ({_filter_sql(8, 16)}), wb AS ({_filter_sql(8, 16, 'bilinear')}),
p AS (SELECT vec_id, j // 24 AS y, (j // 3) % 8 AS x, j % 3 AS k, f[j + 1] AS v FROM (SELECT vec_id, f, unnest(range(192)) AS j FROM (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS})))),
b AS (SELECT vec_id, y, x, k, round_even({_CLAMP.format('v')} * 255, 0) AS v FROM p),
l AS ({_resized_sql('b', 'wl', _BYTE)}), h AS (SELECT vec_id, string_agg(CASE WHEN v > m THEN '01' ELSE '00' END, '' ORDER BY y, x, k) AS frame_hash FROM (SELECT *, avg(v) OVER (PARTITION BY vec_id, k) AS m FROM l) GROUP BY vec_id),
r AS ({_resized_sql('p', 'wb')}), q AS (SELECT vec_id, y, x, sum(v * [0.299::DOUBLE, 0.587, 0.114][k + 1]) AS g FROM r GROUP BY vec_id, y, x),
g AS (SELECT vec_id, list(g ORDER BY y, x) AS g, avg(g) AS m FROM q GROUP BY vec_id)
SELECT vec_id, frame_hash, array_to_string({_BITS}, '') AS gray_hash FROM h JOIN g USING (vec_id)""")
def q65_resized_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both frame hashes from frames that were resized by their filters."""
    return resample.frame_hashes(_frames(spark, sf_dir), "vec_id", F.col("frame"), F.lit(8), F.lit(8))


def _doubled(tile: np.ndarray, y: int, x: int) -> np.ndarray:
    return tile.repeat(2, 0).repeat(2, 1) * (1 + (y + x) / 100.0)


_RAMP_2 = "(CASE WHEN {n} < 4 THEN 1 WHEN {p} >= {n} - 4 THEN ({n} - {p}) / 5.0::DOUBLE WHEN {p} < 4 THEN ({p} + 1) / 5.0::DOUBLE ELSE 1 END)"
_RAMP_Y2 = "(CASE WHEN {p} < 4 THEN ({p} + 1) / 5.0::DOUBLE ELSE 1 END) * (CASE WHEN {p} >= {n} - 4 THEN ({n} - {p}) / 5.0::DOUBLE ELSE 1 END)"
_GREY_OF = "sum(v * [0.299::DOUBLE, 0.587, 0.114][k + 1]) OVER (PARTITION BY vec_id, y, x)"


@query(f"""
WITH wl AS ({_filter_sql(16, 24)}),
t AS (SELECT vec_id, f, y, x, least(y + 5, 8) - y AS h, least(x + 5, 8) - x AS w FROM (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS})), (SELECT unnest([0, 3, 6]) AS y), (SELECT unnest([0, 3, 6]) AS x)),
c AS (SELECT *, i // (2 * w) AS dy, i % (2 * w) AS dx FROM (SELECT *, unnest(range(4 * h * w)) AS i FROM t)),
p AS (SELECT vec_id, 2 * y + dy AS y, 2 * x + dx AS x, k, {_CLAMP.format('f[((y + dy // 2) * 8 + x + dx // 2) * 3 + k + 1] * (1 + (y + x) / 100.0::DOUBLE)')} AS v,
  {_RAMP_2.format(n='2 * w', p='dx')} * {_RAMP_Y2.format(n='2 * h', p='dy')} AS weight FROM c, (SELECT unnest([0, 1, 2]) AS k)),
b AS (SELECT vec_id, y, x, k, {_CLAMP.format('sum(v * weight) / greatest(sum(weight), 1e-8)')} AS v FROM p GROUP BY vec_id, y, x, k),
s AS (SELECT b.vec_id, b.y, b.x, b.k, b.v, CASE WHEN b.y BETWEEN 1 AND 14 AND b.x BETWEEN 1 AND 14 THEN (sum(n.v) + 4 * b.v) / 13 ELSE b.v END AS soft
  FROM b JOIN b n ON n.vec_id = b.vec_id AND n.k = b.k AND n.y BETWEEN b.y - 1 AND b.y + 1 AND n.x BETWEEN b.x - 1 AND b.x + 1 GROUP BY b.vec_id, b.y, b.x, b.k, b.v),
e AS (SELECT vec_id, y, x, k, {_CLAMP.format('soft + (v - soft) * 1.5::DOUBLE')} AS v FROM s),
m AS (SELECT *, avg(g) OVER (PARTITION BY vec_id) AS m FROM (SELECT *, {_GREY_OF} AS g FROM e)),
o AS (SELECT vec_id, y, x, k, {_CLAMP.format('m + (v - m) * 1.2::DOUBLE')} AS v FROM m),
z AS (SELECT vec_id, y, x, k, {_CLAMP.format('g + (v - g) * 1.1::DOUBLE')} AS v FROM (SELECT *, {_GREY_OF} AS g FROM o)),
r AS ({_resized_sql('z', 'wl')})
SELECT vec_id, 24 AS height, 24 AS width, string_agg(round_even(v * 10000, 0)::BIGINT::VARCHAR, ',' ORDER BY y, x, k) AS pixels, NULL::VARCHAR AS error FROM r GROUP BY vec_id""")
def q66_full_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames through tiles, a doubling kernel, blending, sharpness, contrast, colour, and a resize to three times."""
    frames = _frames(spark, sf_dir).withColumns({"h": F.lit(8), "w": F.lit(8)})
    done = transform.upscale(frames, "vec_id", "frame", "h", "w", _doubled, 2, 5, 2, target=F.lit(3), sharpness=0.5, contrast=1.2, colour=1.1, clip=True)
    shown = F.transform("values", lambda q: F.bround(q * 10000).cast("long").cast("string"))
    return done.select("vec_id", "height", "width", F.array_join(shown, ",").alias("pixels"), "error")


@query("""
WITH e AS (SELECT conv_id, length(string_agg(role, '')) // 8 AS m FROM conversations GROUP BY conv_id), c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 5 <> 3),
g AS (SELECT conv_id, min(i) AS gap FROM (SELECT conv_id, unnest(range(m + 200)) AS i FROM e) a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.turn = a.i) GROUP BY conv_id)
SELECT conv_id, m - count(turn) FILTER (WHERE turn < m) AS n_missing, count(turn) FILTER (WHERE turn >= m) AS n_extra, least(gap, m) AS prefix_length FROM e JOIN g USING (conv_id) LEFT JOIN c USING (conv_id) GROUP BY conv_id, m, gap""")
def q67_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, some of them lost, against the number that the roles' letters promise: missing, extra, and complete so far."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    expected = turns.groupBy("conv_id").agg(F.floor(F.sum(F.length("role")) / 8).alias("m"))
    return validate.completeness(turns.where("turn % 5 != 3"), expected, "conv_id", "turn", "m")


@query("""
WITH t AS (SELECT conv_id, turn FROM conversations WHERE length(coalesce(text, '')) % 3 <> 0)
SELECT conv_id, max(turn) + 1 - count(DISTINCT turn) AS n_missing FROM t GROUP BY conv_id""")
def q68_fold_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes that the folded conversations have where turns were lost, here those with texts of certain lengths."""
    turns = table(spark, sf_dir, "conversations").where(F.length(F.coalesce("text", F.lit(""))) % 3 != 0)
    return fold.gaps(fold.segments(turns, "conv_id", "turn", F.col("role"), 4), "conv_id")


_RESULTS = "SELECT event_id AS unique_id, ts, value FROM m WHERE event_id = unique_id AND value >= 5"


@query(f"""
WITH m AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS unique_id FROM events), r AS ({_RESULTS})
SELECT m.event_id, m.unique_id, CASE WHEN r.unique_id IS NULL THEN 'missing' WHEN m.event_id = m.unique_id THEN 'original' ELSE 'copy' END AS pass, r.value
FROM m LEFT JOIN r ON r.unique_id = m.unique_id AND r.ts BETWEEN m.ts - INTERVAL 5 DAY AND m.ts + INTERVAL 5 DAY""")
def q69_stream_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan and results as two streams whose rows come out of order, joined as they come; misses go to a folder of their own."""
    base = new_path(spark, "sink-stage")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    mapped = keep(dedupe.mapping(events, "event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type")), "sink-plan")
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a share each, so no task grows with the table
    # files by hash, so each holds rows of all times; the last of either side only moves the time on
    last = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 400 DAY")).alias("ts"))
    sides = {
        "plan": (mapped.select("event_id", "unique_id", "ts"), last.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("unique_id"), "ts")),
        "results": (mapped.where("event_id = unique_id AND value >= 5").select("unique_id", "ts", "value"), last.select(F.lit(-2).cast("long").alias("unique_id"), "ts", F.lit(0.0).alias("value"))),
    }
    streams_of = {}
    for name, (rows, end) in sides.items():
        for part, piece in enumerate([rows.where("unique_id % 2 = 1").repartition(n_files), rows.where("unique_id % 2 = 0").repartition(n_files), end.coalesce(1)]):
            piece.write.parquet(f"{base}/{name}/{part}")
        streams_of[name] = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", n_files).parquet(f"{base}/{name}")
    found = stages.with_results(streams_of["plan"], streams_of["results"], "ts", "200 DAY", "5 DAY")
    write = lambda rows, kind, i: rows.write.mode("overwrite").parquet(f"{base}/out/{kind}/batch-{i}")
    sink_of = stages.split_sink(write, lambda rows, i: write(rows, "missing", i))
    started = found.writeStream.foreachBatch(sink_of).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    ok, message = streams.run(started)
    if not ok:
        raise RuntimeError(message)
    return spark.read.schema(found.schema).parquet(*(f"{base}/out/{kind}/batch-*" for kind in ("originals", "copies", "missing"))).where("event_id >= 0")


@query(f"""
WITH f AS (SELECT vec_id, {_FRAME} AS f FROM ({_VECTORS})), b AS (SELECT vec_id, (SELECT min(vec_id) FROM embeddings WHERE label = 9) AS hole FROM embeddings)
SELECT vec_id AS index, CASE WHEN vec_id < hole THEN 'before the gap' ELSE 'after it' END AS part, {_LEVEL.format('f', 255)} AS level FROM f JOIN b USING (vec_id) ORDER BY vec_id""")
def q70_stream_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files dropped into a folder in two goes: the stream stops at the first gap until that is filled."""
    folder, base = new_path(spark, "landing"), new_path(spark, "landed")
    frames = _frames(spark, sf_dir, "label").withColumn("name", F.format_string("frame_%09d", "vec_id"))
    images = pixels.encode_as(frames, F.concat("name", F.when(F.col("label") == 9, "-late").otherwise("")), F.lit(8), F.lit(8), F.col("frame"), F.lit("PPM"), F.lit(None), F.lit(None))
    images = keep(images, "frames")
    parts = []
    for part, rows in (("before the gap", images.where("name NOT LIKE '%-late%'")), ("after it", images.where("name LIKE '%-late%'"))):
        sink.write_files(rows.select(F.regexp_replace("name", "-late", "").alias("name"), "content"), folder)
        out = f"{base}/{len(parts)}"
        spark.createDataFrame([], landing.SCHEMA).write.parquet(f"{out}/batch-none")  # a go without new files
        sink_of = streams.ordered_sink(lambda batch, i, out=out: batch.write.mode("overwrite").parquet(f"{out}/batch-{i}"), "index")
        ok, message = streams.run(landing.stream(spark, folder).writeStream.foreachBatch(sink_of).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
        if not ok:
            raise RuntimeError(message)
        parts.append(spark.read.schema(landing.SCHEMA).parquet(f"{out}/batch-*").withColumn("part", F.lit(part)))
    return pixels.decode(parts[0].unionByName(parts[1]).select(F.struct("index", "part").alias("id"), "content"), "id").select("id.index", "id.part", _level().alias("level"))


@query(ORACLES["q16_tile_grid"])
def q71_tiles_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile grid by a table function, called once for each size; sizes are joined to all that have them."""
    dims = _dims(spark, sf_dir).select("p_partkey", "h", "w")
    sizes = dims.select("h", "w").distinct()
    grids = table_functions.register(spark).sql("SELECT h, w, t.y, t.x, t.y_end, t.x_end FROM {sizes}, LATERAL tiles(h, w, 512, 32) t", sizes=sizes)
    return dims.join(grids, ["h", "w"]).select("p_partkey", "y", "x", "y_end", "x_end")


@query("""
SELECT conv_id::VARCHAR AS key, turn // 4 AS segment, min(turn) AS first, max(turn) AS last, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS numbers
FROM conversations GROUP BY conv_id, turn // 4""")
def q72_segments_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns folded in order by a table function over a partitioned table."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = table_functions.register(spark).sql("SELECT * FROM segments(TABLE(SELECT * FROM {turns}), 'conv_id', 'turn', 4)", turns=turns)
    return rows.withColumn("numbers", F.array_join(F.col("numbers").cast("array<string>"), ","))


@query("""
SELECT count(*) AS read, count(*) FILTER (WHERE value < 1) AS rejected, count(*) FILTER (WHERE value >= 1) AS written, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events""")
def q73_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's own counters: read and rejected by what it observes on the way, written by what its sink's job observes."""
    listener = counters.Counters()
    base = new_path(spark, "counted")
    number = lambda c: F.sum(c.cast("long"))
    seen = _stream(spark, sf_dir).observe("all", F.count("*").alias("read"), number(F.col("value") < 1).alias("rejected"), number(F.col("event_type") == "error").alias("errors"))
    kept = seen.where("value >= 1").observe("kept", F.count("*").alias("written"))
    spark.streams.addListener(listener)
    try:
        started = kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        ok, message = streams.run(started)
        if not ok:
            raise RuntimeError(message)
        found = listener.of(str(started.runId))
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([tuple(found.get(k, 0) for k in ("read", "rejected", "written", "errors"))], "read long, rejected long, written long, errors long")


@query("""
WITH f AS (SELECT vec_id // 8 AS session, vec_id, 'clip.' || vec_id AS stem, CASE WHEN label < 1 THEN 'video' WHEN label < 7 THEN 'image' END AS kind FROM embeddings)
SELECT session, coalesce(min_by(stem, vec_id) FILTER (WHERE kind = 'video'), min_by(stem, vec_id) FILTER (WHERE kind = 'image'), '') AS video_name,
  string_agg(stem, chr(10) ORDER BY vec_id) AS rename_list FROM f GROUP BY session""")
def q74_session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each session's video, and the list of its files to rename."""
    suffix = F.when(F.col("label") < 1, ".MP4").when(F.col("label") < 7, ".png").otherwise(".txt")
    files = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("session"), "vec_id", F.concat(F.lit("dir/clip."), F.col("vec_id").cast("string"), suffix).alias("path"))
    return media_source.session_names(files, "session", "vec_id")


_MEDIA = "SELECT vec_id, label, 'dir/clip.' || vec_id || CASE WHEN label < 1 THEN '.MP4' WHEN label < 7 THEN '.png' ELSE '.txt' END AS path, CASE WHEN label < 1 THEN 'video' WHEN label < 7 THEN 'image' END AS kind FROM embeddings"


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.when(F.col("label") < 1, ".MP4").when(F.col("label") < 7, ".png").otherwise(".txt")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("dir/clip."), F.col("vec_id").cast("string"), suffix).alias("path"))


@query(f"SELECT path, kind, row_number() OVER (PARTITION BY kind ORDER BY vec_id) AS at FROM ({_MEDIA}) WHERE kind IS NOT NULL")
def q75_split_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and videos with their places among their kind; what is neither is in none."""
    images, videos = media_source.split_by_kind(_media(spark, sf_dir), "path", "vec_id")
    return images.unionByName(videos).select("path", "kind", "at")


def _image_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files made of all vectors: PNG, PPM, and some that are no images."""
    folder = new_path(spark, "image-files")
    kind = F.when(F.col("label") % 2 == 0, "PNG").otherwise("PPM")
    rows = _frames(spark, sf_dir, "label")
    images = pixels.encode_as(rows.where("label < 8"), F.concat_ws("_", "label", "vec_id"), F.lit(8), F.lit(8), F.col("frame"), kind, F.lit(9), F.lit(8))
    others = rows.where("label >= 8").select(F.concat_ws("_", F.lit("x"), "vec_id").alias("name"), F.encode(F.col("vec_id").cast("string"), "UTF-8").alias("content"))
    sink.write_files(images.select("name", "content").unionByName(others), folder)
    return folder


@query("SELECT label || '_' || vec_id AS stem, 'image' AS kind FROM embeddings WHERE label < 8 AND label % 2 = 0")
def q76_suffix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one suffix; the pattern reaches the scan, and no content is read."""
    found = media_source.files(spark, _image_files(spark, sf_dir), ".png")
    return found.select(M.stem(F.col("path")).alias("stem"), "kind")


@query("""
SELECT CASE WHEN label < 8 THEN label || '_' || vec_id ELSE 'x_' || vec_id END AS stem, CASE WHEN label < 8 THEN 8 END AS height, CASE WHEN label < 8 THEN 8 END AS width,
  CASE WHEN label >= 8 THEN 'not a PPM or PNG image' END AS error FROM embeddings""")
def q77_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the first bytes of every file; what is no image has an error."""
    found = pixels.probe(sink.read_files(spark, _image_files(spark, sf_dir)), "path")
    return found.select(M.stem(F.col("path")).alias("stem"), "height", "width", "error")


@query("""
WITH v AS (SELECT event_id, unnest([props, event_type, '{"value": "' || user_id || '"}', CASE WHEN value > 10 THEN event_type END]) AS v, unnest([1, 2, 3, 4]) AS k FROM events)
SELECT event_id, k, coalesce(CASE WHEN trim(v) LIKE '{%' THEN json_extract_string(v, '$.value') ELSE v END, 'none') AS unwrapped FROM v""")
def q78_unwrapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as they come from a form: objects with a value, other objects, plain strings and nulls."""
    spelt = F.array("props", "event_type", F.concat(F.lit('{"value": "'), F.col("user_id").cast("string"), F.lit('"}')), F.when(F.col("value") > 10, F.col("event_type")))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(spelt).alias("k", "v"))
    return rows.select("event_id", (F.col("k") + 1).alias("k"), M.unwrap(F.col("v"), "none").alias("unwrapped"))


@query("SELECT strftime(ts, '%Y%m%d_%H%M%S') AS folder, count(*) AS n FROM events GROUP BY 1")
def q79_session_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the folder that a session of their second would have."""
    return table(spark, sf_dir, "events").groupBy(M.session_folder(F.col("ts")).alias("folder")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def q80_stream_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash stage of a stream over all documents."""
    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    return _collected(spark, stages.with_fingerprint(stream.select("doc_id", "text"), "text").select("doc_id", "fingerprint"), "hashed")


@query("""
WITH s AS (SELECT DISTINCT p_size AS h, length(p_name)::INT AS w, length(p_type)::INT - 5 AS o FROM part), y AS (SELECT *, unnest(range(h)) AS y FROM s), g AS (SELECT *, unnest(range(w)) AS x FROM y),
r AS (SELECT *, CASE WHEN o > 0 AND o <= least(h, w) THEN (CASE WHEN x >= w - o THEN (w - x) / (o + 1)::DOUBLE WHEN x < o THEN (x + 1) / (o + 1)::DOUBLE ELSE 1 END) * (CASE WHEN y < o THEN (y + 1) / (o + 1)::DOUBLE ELSE 1 END) * (CASE WHEN y >= h - o THEN (h - y) / (o + 1)::DOUBLE ELSE 1 END) ELSE 1 END AS v FROM g),
t AS (SELECT h, w, o, sum(v) AS v FROM r GROUP BY h, w, o)
SELECT p_partkey, round(v, 6) AS total FROM part JOIN t ON h = p_size AND w = length(p_name) AND o = length(p_type) - 5""")
def q81_shared_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's weights from a table that holds each distinct size once."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("h"), F.length("p_name").alias("w"), (F.length("p_type") - 5).alias("o"))
    maps = tiles.weight_table(part, "h", "w", "o", edge_safe=True)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return part.join(maps, ["h", "w", "o"]).select("p_partkey", F.round(total, 6).alias("total"))


@query(f"SELECT doc_id, unique_id FROM ({_MAPPED}) WHERE doc_id <> unique_id")
def q82_duplicates_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of duplicates alone."""
    return dedupe.duplicates_only(_mapped(spark, sf_dir), "doc_id")


@query(f"""
SELECT vec_id, array_to_string(list_transform(range(1, len(v) + 1), lambda i: floor(greatest(least(v[i] * 255 + (least(abs(v[len(v) + 1 - i]) * 2, 1.5::DOUBLE) - 1), 255.0::DOUBLE), 0.0::DOUBLE))::INT::VARCHAR), ',') AS bytes FROM ({_VECTORS})""")
def q83_dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with noise, here each vector's own values from its end on, so that the result is known."""
    noise = F.transform(F.reverse(A.doubles(F.col("embedding"))), lambda x: F.least(F.abs(x) * 2, F.lit(1.5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(A.dither(F.col("embedding"), noise).cast("array<string>"), ",").alias("bytes"))


@query(f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, CASE WHEN label <> 9 THEN {_SHOWN.format('flatten(list_transform(CASE WHEN label = 8 THEN v[1:32] ELSE v END, lambda x: [x, x]))')} END AS pixels, CASE WHEN label = 9 THEN 'null input' END AS error FROM v""")
def q84_kernel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in kernel over rows of two lengths, some of them with nulls: those report it and the others go on."""
    v = F.col("embedding")
    odd = F.when(F.col("label") == 9, F.transform(v, lambda x, i: F.when(i != 5, x))).when(F.col("label") == 8, F.slice(v, 1, 32)).otherwise(v)
    got = kernels.apply(table(spark, sf_dir, "embeddings").select("vec_id", odd.alias("v")), "nearest_up", "vec_id", "v")
    return got.select("vec_id", F.when(F.col("result").isNotNull(), _shown(F.col("result"))).alias("pixels"), "error")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch_id FROM events WHERE event_id % 2 = 0")
def q85_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream handed over in numbered batches; the last, short one is flushed with its micro-batch."""
    base = new_path(spark, "assembled")
    sink_of = stages.in_batches(lambda rows, i: rows.write.mode("overwrite").parquet(f"{base}/out/batch-{i}"), "event_id", 64)
    stream = _stream(spark, sf_dir).where("event_id % 2 = 0").select("event_id")
    ok, message = streams.run(stream.writeStream.foreachBatch(sink_of).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    if not ok:
        raise RuntimeError(message)
    return spark.read.schema("event_id long, batch_id long").parquet(f"{base}/out/batch-*")
