"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items are cut into windows of ten consecutive words (a shorter item is one window). A
window's tokens are its five-word shingles (all its words, where it has fewer than five). Since a
window must be contained whole, its necessary prefix is one token, and the rarest serves best:

1. one pass over the documents counts the shingles that any window has;
2. shingles are ordered by these counts; a window with a shingle that the corpus lacks can't occur, and
   of the others only the rarest shingle, the prefix, is joined with the documents in a second pass;
3. the shingle's place in the window and in the document fixes where the window would start; it
   has to lie inside the document (positional and length bounds);
4. the words at that place are compared with the window's words.

Only hits of prefixes are kept between steps, with the words around them. Up to ``MOST_BROADCAST``
shingles the benchmark's side is broadcast, and texts are never shuffled; beyond that positions and
hashes alone are, and the words around a hit are cut from the document afterwards.

Null and empty texts have no words (very long ones are read whole): such documents are clean, such items have no window. Repeated
documents are each reported. A document is its id and text, so equal ids with other texts stay
apart, and null ids are kept. Null item ids are listed as empty strings. Repeated items count as
often as they differ in id. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, table, text_of

WINDOW = 10
SHINGLE = 5
#: Hashes of shingles up to which they are broadcast.
MOST_BROADCAST = 1_000_000
#: Words of a document that are looked at together, so that no row of a very long text carries all of it.
PIECE = 512
#: Between words: ASCII other than digits and lower-case letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(df: DataFrame) -> Column:
    return F.array_remove(F.split(ascii_lower(text_of(df)), BETWEEN), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words, size): the windows of each item."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), words(benchmark).alias("w"))
    items = items.where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at")
    return items.select("item_id", "w", "n", at).select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("words"), F.col("n").alias("size")).distinct()


def _shingle(words: str, at: str, size: int) -> Column:
    """Hash of ``size`` words: plain array reads, so that it compiles into the scan's stage."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(words), F.col(at) + i) for i in range(size)])


def _shingles(df: DataFrame, words: str, size: int, *keep: str) -> DataFrame:
    rows = df.where(F.size(words) >= size)
    rows = rows.select(*keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - size)).alias("at"))
    return rows.withColumn("h", _shingle(words, "at", size))


def _union(parts: list[DataFrame], *names: str) -> DataFrame:
    out = parts[0].select(*names)
    for more in parts[1:]:
        out = out.unionByName(more.select(*names))
    return out


def _side(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= MOST_BROADCAST else hashes


def _positions(text: DataFrame, size: int, margin: int, *keep: str) -> DataFrame:
    """``keep``, at, h and the words around (``w``, from word ``first``) of each shingle of ``text``, by pieces of documents."""
    rows = text.where(F.size("w") >= size).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - size) / PIECE).cast("int"))).alias("c"))
    first = F.greatest(F.col("c") * PIECE - margin, F.lit(0))
    rows = rows.select(*keep, "c", (F.size("w") - size).alias("last"), first.alias("first"), F.slice("w", first + 1, F.lit(PIECE + size - 1 + 2 * margin)).alias("w"))
    at = F.sequence(F.col("c") * PIECE, F.least(F.col("c") * PIECE + PIECE - 1, F.col("last")))
    rows = rows.select(*keep, "first", "w", F.explode(at).alias("at")).withColumn("local", F.col("at") - F.col("first"))
    return rows.withColumn("h", _shingle("w", "local", size))


def _hits(text: DataFrame, chosen: DataFrame, sizes: list[int], margin: int) -> DataFrame:
    """(doc_id, th, h, at, first, around): places of chosen shingles with up to ``margin`` words before and after, from word ``first``."""
    side = _side(chosen)
    own = ["doc_id", "th", "at", "h", "first", "around"]

    def cut(rows: DataFrame, size: int) -> DataFrame:
        start = F.greatest(F.col("at") - margin, F.lit(0))
        return rows.select("doc_id", "th", "at", "h", start.alias("first"), F.slice("w", start - F.col("first") + 1, F.lit(2 * margin + size)).alias("around"))

    if side is not chosen:
        found = _union([cut(_positions(text, k, margin, "doc_id", "th").join(side, "h"), k) for k in sizes], *own)
    else:  # too many to send: the words stay behind
        places = _union([_positions(text, k, 0, "doc_id", "th").select("doc_id", "th", "at", "h").join(chosen, "h") for k in sizes], "doc_id", "th", "at", "h").distinct()
        spots = places.groupBy(F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), F.floor(F.col("at") / PIECE).alias("c")).agg(F.collect_list(F.struct("at", "h")).alias("spots"))  # of one piece
        held = text.join(spots, text["doc_id"].eqNullSafe(F.col("p_id")) & (text["th"] == F.col("p_th")))
        first = F.greatest(F.col("c") * PIECE - margin, F.lit(0)).cast("int")
        held = held.select("doc_id", "th", "spots", first.alias("first"), F.slice("w", first + 1, F.lit(PIECE + max(sizes) + 2 * margin)).alias("w"))
        found = cut(held.select("doc_id", "th", "first", "w", F.explode("spots").alias("x")).select("doc_id", "th", "first", "w", "x.at", "x.h"), max(sizes))
    return materialise(found, "decon-hits")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, start, size, wid) for each place of a window in a document, (wid, item_id)). th: hash of the text."""
    cut = materialise(windows(benchmark, window).withColumn("wid", F.sha2(F.array_join("words", " "), 256)), "decon-windows")
    members = cut.select("wid", "item_id")
    distinct = cut.select("wid", "words", "size").dropDuplicates(["wid"])
    sizes = [r[0] for r in distinct.select(F.least("size", F.lit(shingle))).distinct().collect()]  # at most ``shingle`` numbers
    of = [_shingles(distinct.where(F.least("size", F.lit(shingle)) == k), "words", k, "wid", "size") for k in sizes]
    tokens = of[0] if of else _shingles(distinct, "words", shingle, "wid", "size")
    for more in of[1:]:
        tokens = tokens.unionByName(more)
    tokens = materialise(tokens, "decon-tokens")
    listed = materialise(tokens.select("h").distinct(), "decon-shingles")
    text = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("th"), words(docs).alias("w"))
    seen = _union([_positions(text, k, 0) for k in sizes or [shingle]], "h").join(_side(listed), "h", "left_semi")
    seen = materialise(seen.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "decon-seen")
    rarest = Window.partitionBy("wid").orderBy("often", "h", "o")
    prefix = tokens.select("wid", "size", "words", "h", F.col("at").alias("o")).join(seen, "h", "left")
    prefix = prefix.withColumn("all", F.min(F.coalesce("often", F.lit(0))).over(Window.partitionBy("wid"))).where("all > 0")
    prefix = prefix.withColumn("r", F.row_number().over(rarest)).where("r = 1").select("wid", "size", "words", "h", "o")
    prefix = materialise(prefix, "decon-prefix")
    hits = _hits(text, materialise(prefix.select("h").distinct(), "decon-chosen"), sizes or [shingle], window - 1)
    start = F.col("at") - F.col("o")
    inside = F.slice("around", start - F.col("first") + 1, F.col("size"))
    pairs = hits.join(prefix, "h").where(start >= 0)
    pairs = pairs.where(inside == F.col("words")).select("doc_id", "th", start.alias("start"), "size", "wid")
    return materialise(pairs.distinct(), "decon-pairs"), members


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    pairs, members = occurrences(docs, benchmark, window, shingle)
    places = pairs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("at"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "at",
        zero,
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
    )["n"]
    places = places.select("doc_id", "th", covered.alias("n_hit"))
    items = pairs.select("doc_id", "th", "wid").distinct().join(members, "wid").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    found = places.join(items, same(places, items)).select(places["doc_id"], places["th"], "n_hit", "items")
    found = materialise(found.select(F.col("doc_id").alias("f_id"), F.col("th").alias("f_th"), "n_hit", "items"), "decon-found")
    base = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("th"), F.size(words(docs)).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["f_id"]) & (base["th"] == found["f_th"]), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    pairs, _ = occurrences(docs, benchmark)
    bad = pairs.select(F.col("doc_id").alias("b_id"), "th").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["b_id"]) & (F.xxhash64(text_of(docs)) == bad["th"]), "left_anti")


def query(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB: windows as joined words, places found by an equality join on ten-word (or item-sized) grams.
SQL = r"""
WITH lower AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), gram AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM lower, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, i, g.size, item_id FROM gram g JOIN win USING (size, words)
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM lower LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""
