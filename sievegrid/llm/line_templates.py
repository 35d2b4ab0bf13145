"""Line dedup with a log-template tree, in DataFrame expressions only.

A line's path in the tree has a fixed depth: its number of words, then its first ``DEPTH``
words, in which words with digits count as variable.  A leaf holds the lines that share the
path.  In each leaf that at least ``min_texts`` lines reach, a word that stands at its place
in at least ``min_texts`` lines is constant and any other is a variable field; the template
is the sequence of constants and fields.  A template whose share of constants reaches
``min_constant`` recurs if at least ``min_texts`` distinct texts hold it, in surroundings as
varied: the distinct lines before it (or after it) must be at least ``min_spread`` of those
texts.  Thus license lines, notices and other boilerplate go, while the lines of a document
and its many copies, which always stand between the same neighbours, stay for the
operators that handle copies.

``boilerplate_lines``, the pipeline's rule, has no SQL to match and asks for no neighbours: a
template recurs if at least ``min_groups`` groups of near copies hold it.  A text counts as a
group of its own unless lines that recur make up more than half of its words; such texts are
near copies of others and count once for all that share one of their ``KIN`` rarest lines.
Words are counted by distinct texts, so exact copies don't count; and besides its own
template a line has that of its leaf's majority, whose constants are the words that more than
half of the leaf's texts have: a field stays a field however often its common values come.
Thus a large group of copies neither saves a notice nor makes one, and the lines in the midst
of a notice are judged as its edges are.

All lines of recurring templates are dropped; the others stay in order.  Null texts stay
null, empty texts and lines without words are never dropped; null ids are allowed; rows that
repeat both id and text count once and are all cleaned alike; empty tables give empty
results; texts of any length are whole; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

DEPTH = 3
MIN_TEXTS = 20
MIN_CONSTANT = 0.7
MIN_SPREAD = 0.5
MIN_GROUPS = 3
KIN = 4
BROADCAST_KEYS = 1 << 20  # rows of three numbers at most: 24 MB
_GAP = r"[\x20\x09-\x0D]+"
_FIELD = "<*>"


def _words(line: Column) -> Column:
    """The line's words, those with digits as variable fields."""
    words = F.filter(F.split(line, _GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"[0-9]"), F.lit(_FIELD)).otherwise(w))


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, th, ls, total): the lines and the number of words of every (id, text), each pair once."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    lines = rows.select("id", F.xxhash64("t").alias("th"), F.split("t", "\n").alias("ls"), F.size(F.filter(F.split("t", _GAP), lambda w: w != "")).alias("total"))
    # only rows that repeat both are shuffled to be told apart
    again = store.keep(lines.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th"), "repeated-rows")
    if again.isEmpty():
        return lines
    return lines.join(again, ["id", "th"], "left_anti").unionByName(lines.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))


def _with(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join with a stored table of keys, broadcast if it has few rows."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def _spot(leaf: Column, place: Column, word: Column) -> Column:
    return F.xxhash64(leaf, place, word)


def _key(token: Column, place: Column) -> list[Column]:
    """Two sums over a line's tokens that name its template, the same in any order."""
    part = F.xxhash64(place, token)
    return [F.bit_xor(part).alias("t1"), F.bit_xor(F.xxhash64(part, F.lit(1))).alias("t2")]


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_constant: float = MIN_CONSTANT, min_spread: float = MIN_SPREAD, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, at): the lines to drop; ``id`` and ``th`` name the row by id and text hash."""
    arrays = _lines(docs, text_col, id_col)
    # narrow first: leaves by hash, and the hashes of the neighbours
    leaf = F.transform("ls", lambda x: _leaf(x, depth))
    leaves = arrays.select(F.explode(leaf).alias("leaf")).where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts)
    leaves = store.keep(leaves.select("leaf"), "leaves")
    around = F.transform("ls", lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.xxhash64(F.get("ls", i - 1)).alias("before"), F.xxhash64(F.get("ls", i + 1)).alias("after")))
    lines = arrays.select("id", "th", F.explode(around).alias("x")).select("id", "th", "x.*").withColumn("leaf", _leaf(F.col("line"), depth))
    near = store.keep(_with(lines, leaves, ["leaf"], "left_semi"), "leaf-lines")
    words = near.select("id", "th", "at", "leaf", "before", "after", F.posexplode(_words(F.col("line"))).alias("place", "word")).withColumn("spot", _spot(F.col("leaf"), F.col("place"), F.col("word")))
    # frequent words of a place are constant
    constant = store.keep(words.groupBy("spot").agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select("spot", F.lit(1).alias("fixed")), "constants")
    # a line's words stay together where the constants are broadcast, so they are one row before they shuffle
    marked = _with(words, constant, ["spot"], "left")
    known = F.coalesce("fixed", F.lit(0)) * (F.col("word") != _FIELD).cast("int")
    token = F.when(F.col("fixed").isNotNull(), F.col("word")).otherwise(F.lit(_FIELD))
    templates = marked.groupBy("id", "th", "at", "leaf", "before", "after").agg(*_key(token, F.col("place")), F.sum(known).cast("int").alias("fixed"), F.count("*").cast("int").alias("n"))
    templates = store.keep(templates.where(F.col("fixed") >= min_constant * F.col("n")).drop("fixed", "n"), "templates")
    store.drop(near, constant)
    key = ["leaf", "t1", "t2"]
    # few templates have as many lines as it takes texts; only theirs are told apart
    often = store.keep(templates.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= min_texts).select(*key), "frequent")
    held = _with(templates, often, key, "left_semi")
    distinct = lambda c, name: held.select(*key, c).distinct().groupBy(*key).agg(F.count(c).alias(name))
    recurring = distinct("th", "texts").where(F.col("texts") >= min_texts).join(distinct("before", "b"), key).join(distinct("after", "a"), key)
    recurring = store.keep(recurring.where(F.greatest("a", "b") >= min_spread * F.col("texts")).select(*key), "recurring")
    return _with(templates, recurring, key, "left_semi").select("id", "th", "at")


def boilerplate_lines(docs: DataFrame, min_groups: int = MIN_GROUPS, min_constant: float = MIN_CONSTANT, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, at): the lines to drop, as ``recurring_lines``, by groups of near copies."""
    arrays = _lines(docs, text_col, id_col)
    leaves = arrays.select("th", F.explode(F.array_distinct(F.transform("ls", lambda x: _leaf(x, depth)))).alias("leaf")).where("leaf is not null")
    leaves = store.keep(leaves.groupBy("leaf").agg(F.countDistinct("th").alias("leaf_texts")).where(F.col("leaf_texts") >= min_groups), "leaves")
    lines = arrays.select("id", "th", "total", F.posexplode("ls").alias("at", "line")).withColumn("leaf", _leaf(F.col("line"), depth))
    near = store.keep(_with(lines, leaves, ["leaf"], "inner"), "leaf-lines")
    words = near.select("id", "th", "at", "leaf", "leaf_texts", "total", F.posexplode(_words(F.col("line"))).alias("place", "word")).withColumn("spot", _spot(F.col("leaf"), F.col("place"), F.col("word")))
    # a place's words by distinct texts: each text once, however many copies and lines have it
    constant = words.select("th", "spot").distinct().groupBy("spot").agg(F.count("*").alias("spot_texts")).where(2 * F.col("spot_texts") > min_groups)
    constant = store.keep(constant, "constants")
    marked = _with(words, constant, ["spot"], "left")
    marked = marked.withColumn("fixed", (F.col("spot_texts") >= min_groups).cast("int")).withColumn("most", (2 * F.col("spot_texts") > F.col("leaf_texts")).cast("int"))
    token = F.when(F.col("fixed") == 1, F.col("word")).otherwise(F.lit(_FIELD))
    plain = (F.col("word") != _FIELD).cast("int")
    templates = marked.groupBy("id", "th", "at", "leaf", "total").agg(
        *_key(token, F.col("place")),
        F.sum(F.coalesce("fixed", F.lit(0)) * plain).cast("int").alias("fixed"),
        F.sum(F.coalesce("most", F.lit(0)) * plain).cast("int").alias("most"),
        F.count("*").cast("int").alias("n"),
    )
    # a line has its own template, and that of its leaf's majority if it agrees with it
    own = F.when(F.col("fixed") >= min_constant * F.col("n"), F.struct("t1", "t2"))
    shared = F.when(F.col("most") >= min_constant * F.col("n"), F.struct(F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2")))
    templates = templates.select("id", "th", "at", "leaf", "total", "n", F.explode(F.array_compact(F.array(own, shared))).alias("t"))
    templates = store.keep(templates.select("id", "th", "at", "leaf", "total", "n", "t.*"), "templates")
    store.drop(near, constant)
    key = ["leaf", "t1", "t2"]
    # few templates have as many lines as it takes texts; only theirs go on
    often = store.keep(templates.groupBy(*key).agg(F.count("*").alias("lines")).where(F.col("lines") >= min_groups).select(*key), "frequent")
    # copies of a text end here: from now on a text is its hash
    held = store.keep(_with(templates, often, key, "left_semi").groupBy("th", "at", *key).agg(F.first("total").alias("total"), F.first("n").alias("n")), "held")
    common = store.keep(held.select("th", *key).distinct().groupBy(*key).agg(F.count("*").alias("texts")).where(F.col("texts") >= min_groups), "common")
    held = store.keep(_with(held, common, key, "inner"), "held-common")
    # texts that are mostly such lines are copies: only the first holder of all its rarest lines counts
    spots = held.groupBy("th", "at").agg(F.max("total").alias("total"), F.max("n").alias("n"), F.min(F.struct("texts", *key)).alias("k"))
    kin = spots.groupBy("th").agg(F.max("total").alias("total"), F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_set("k")), 1, KIN).alias("kin"))
    copies = store.keep(kin.where("2 * n > total").select("th", "kin"), "copies")
    firsts = copies.select("th", F.size("kin").alias("n"), F.explode("kin").alias("k")).groupBy("k").agg(F.min(F.struct("th", "n")).alias("x")).select("x.*")
    firsts = firsts.groupBy("th", "n").count().where("count = n")
    others = store.keep(copies.join(firsts, "th", "left_anti").select("th"), "others")
    recurring = held.join(others, "th", "left_anti").select("th", *key).distinct().groupBy(*key).agg(F.count("*").alias("groups")).where(F.col("groups") >= min_groups)
    recurring = store.keep(recurring.select(*key), "recurring")
    store.drop(held, copies, others)
    return _with(templates, recurring, key, "left_semi").select("id", "th", "at").distinct()


def _leaf(line: Column, depth: int) -> Column:
    """The leaf that a line reaches, null without words."""
    words = F.filter(F.split(line, _GAP), lambda w: w != "")
    first = F.transform(F.slice(words, 1, depth), lambda w: F.when(w.rlike(r"[0-9]"), F.lit(_FIELD)).otherwise(w))
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(F.size(words), first))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, find: Callable[..., DataFrame] = recurring_lines, **rules) -> DataFrame:
    """``docs`` with recurring lines dropped from the text, those that ``find`` gives.

    ``counts`` names two more columns: lines before, and lines dropped.
    """
    gone = find(docs, id_col=id_col, text_col=text_col, **rules)
    # one flag string a document: a mark at each dropped place
    spots = gone.groupBy(F.col("id").alias("sg_gone_id"), F.col("th").alias("sg_gone_th")).agg(F.array_sort(F.collect_list("at")).alias("sg_spots"))
    # the spots grow with the documents, so both sides shuffle, whatever the size of a sample
    spots = spots.hint("merge")
    columns = [docs[c] for c in docs.columns]
    text = F.col(text_col).cast("string")
    keyed = docs.select(*columns, F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("sg_id"), F.xxhash64(text).alias("sg_th"))
    joined = keyed.join(spots, (F.col("sg_id") == F.col("sg_gone_id")) & (F.col("sg_th") == F.col("sg_gone_th")), "left")
    lines = F.split(text, "\n")
    # gaps between dropped lines are copied as slices: work grows with the lines, not with their square
    edges = F.transform(F.concat(F.col("sg_spots"), F.array(F.size(lines))), lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("sg_spots", i - 1) + 1).alias("a"), x.alias("b")))
    kept = F.flatten(F.transform(F.filter(edges, lambda e: e["b"] > e["a"]), lambda e: F.slice(lines, e["a"] + 1, e["b"] - e["a"])))
    cleaned = F.when(F.col("sg_spots").isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size("sg_spots"), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)
