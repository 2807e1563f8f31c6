"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's elements are its paragraphs (lines, and sentences in them with their end marks), each with
which of its occurrences it is, as a 64-bit digest of which the bits before the last are a check of
the others. A sketch has cells in three tables of equal size; an element goes into one cell of each,
which keeps a count and the XOR of digests. Cells of two versions subtract; peeling cells that hold a
single element recovers the digests that only one version has.

The fingerprint is the sketch of a size that follows from the text's own number of elements
(``size_of``: ``EACH`` cells an element at least), so it can be peeled by itself. Sizes are ``CELLS`` times
powers of ``GROWTH``, and a cell's number in its table is that at the next size, divided by ``GROWTH``: a
larger sketch folds into any smaller one. Two fingerprints are first compared at a quarter of the
smaller one's size, which is enough where half a text is the same. When peeling fails, or hardly a cell
is empty, it is retried at the next size; beyond the smaller text's size, its sketch there is that of
the elements peeled from it. So a likeness is a function of the two fingerprints. It is computed
from the elements, of which the sketches of all these sizes are made.

Sketches are kept sparse, as the sorted cells that aren't empty. Everything is an expression on one
row's arrays: n log n in the number of paragraphs, no Python and no shuffle. Only the edited texts
need a shuffle, one of the texts, to bring each document beside the next.

Null text counts as empty: no elements, and its fingerprint is that of no cells. Two empty texts are
alike (1). Very long texts have larger sketches. Repeated rows are each fingerprinted. In the order for
editing, equal ids are ordered by their text's hash; null ids come last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise, table, text_of

#: Cells of the smallest sketch, over all three tables, by how much sizes grow, and how many sizes there are.
CELLS, GROWTH, SIZES = 48, 4, 10
#: Cells of a fingerprint for each element, at least.
EACH = 4
#: Bits of a digest that check the rest; the last bit is free, for the side of a difference.
CHECK = 20
#: Rounds of peeling in which all single cells go at once.
ROUNDS = 24
PARAGRAPH = r"(?<=[.!?])\s+|\n"
_EMPTY = "array<bigint>"
#: By how many bits digests are rotated, so that a table's bits come first.
TURNS = (0, 15, 30)


def _runs(groups: Column) -> Column:
    """array<struct<first, size>> of the runs of equal numbers."""
    heads = F.filter(F.sequence(F.lit(1), F.size(groups)), lambda i: (i == 1) | (groups[i - 1] != F.get(groups, i - 2)))
    sized = let(heads, lambda h: F.transform(h, lambda first, i: F.struct(first.alias("first"), (F.coalesce(F.get(h, i + 1), F.size(groups) + 1) - first).alias("size"))))
    return F.when(F.size(groups) > 0, sized).otherwise(F.array().cast("array<struct<first:int,size:int>>"))


def digest(*parts: Column) -> Column:
    """A hash whose bits before the last follow from the others, so that a XOR of several digests hardly ever looks like one."""
    return let(F.shiftright(F.xxhash64(*parts), CHECK), lambda h: F.shiftleft(h, CHECK).bitwiseOR(_check(h)))


def _check(high: Column) -> Column:
    return F.xxhash64(high).bitwiseAND(F.lit((1 << CHECK) - 2))


def _is_digest(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << CHECK) - 1)) == _check(F.shiftright(key, CHECK))


def elements(text: Column) -> Column:
    """Sorted digests of the paragraphs, each with which of its occurrences it is."""
    parts = F.array_remove(F.transform(F.split(text, PARAGRAPH), F.trim), "")
    hashes = F.sort_array(F.transform(parts, lambda p: F.xxhash64(p)))
    each = lambda d: lambda r: F.transform(F.sequence(F.lit(1), r["size"]), lambda k: digest(d[r["first"] - 1], k))
    return F.sort_array(let(hashes, lambda d: F.flatten(F.transform(_runs(d), each(d)))))


def _turned(key: Column, turn: int) -> Column:
    return key if not turn else F.shiftleft(key, turn).bitwiseOR(F.shiftrightunsigned(key, 64 - turn))


def _cell(turned: Column, third: Column) -> Column:
    """The cell in a table of ``third`` cells: rises with the turned digest, and folds with the size."""
    return F.shiftright((F.shiftright(turned, 33) + (1 << 30)) * third, 31).cast("int")


def _table(keys: Column, third: Column, j: int) -> Column:
    """The cells of table ``j``. Keys whose last bit is set count as taken out. Digests turned and sorted are sorted by cell."""
    turn = TURNS[j]
    side = lambda r: F.shiftrightunsigned(r, turn).bitwiseAND(F.lit(1)).cast("int")
    turned = F.sort_array(F.transform(keys, lambda k: _turned(k, turn)))

    def sums(rs: Column, cs: Column) -> Column:
        def one(run: Column) -> Column:
            at = run["first"] - 1
            lone = F.struct(cs[at].alias("cell"), (1 - 2 * side(rs[at])).alias("n"), rs[at].alias("key"))
            add = lambda a, r: F.struct(a["cell"].alias("cell"), (a["n"] + 1 - 2 * side(r)).alias("n"), a["key"].bitwiseXOR(r).alias("key"))
            return F.when(run["size"] == 1, lone).otherwise(F.aggregate(F.slice(rs, run["first"] + 1, run["size"] - 1), lone, add))

        # turned back, and without the bit of the side
        back = lambda c: _turned(c["key"], (64 - turn) % 64).bitwiseAND(F.lit(-2))
        return F.transform(F.transform(_runs(cs), one), lambda c: F.struct((c["cell"] + third * j).alias("cell"), c["n"].alias("n"), back(c).alias("key")))

    return let(turned, lambda rs: let(F.transform(rs, lambda r: _cell(r, third)), lambda cs: sums(rs, cs)))


def _cells(keys: Column, cells: Column) -> Column:
    tables = let(F.floor(cells / 3).cast("int"), lambda third: F.concat(*[_table(keys, third, j) for j in range(3)]))
    return F.filter(tables, lambda c: (c["n"] != 0) | (c["key"] != 0))


def sketch(keys: Column, cells: int | Column = CELLS) -> Column:
    """The sparse sketch of ``keys``."""
    return _cells(keys, F.lit(cells) if isinstance(cells, int) else cells)


def subtract(a: Column, b: Column, cells: int | Column = CELLS) -> Column:
    """The sketch of the elements ``a`` minus that of ``b``: cells take the one's elements in and the other's out."""
    return _cells(F.concat(a, F.transform(b, lambda k: k.bitwiseOR(F.lit(1)))), F.lit(cells) if isinstance(cells, int) else cells)


def _without(cells: Column, plus: Column, minus: Column, third: Column) -> Column:
    """``cells`` after the elements ``plus`` are taken out and ``minus`` put in; cells with nothing left are dropped."""

    def three(sign: int):
        return lambda k: F.array(*[F.struct((_cell(_turned(k, t), third) + third * j).alias("cell"), F.lit(sign).alias("n"), k.alias("key")) for j, t in enumerate(TURNS)])

    def sums(u: Column) -> Column:
        at = lambda p: u[p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")]
        add = lambda a, p: F.struct(a["cell"].alias("cell"), (a["n"] + at(p)["n"]).alias("n"), a["key"].bitwiseXOR(at(p)["key"]).alias("key"))

        def one(p: Column, run: Column) -> Column:
            first = at(p[run["first"] - 1])
            return F.when(run["size"] == 1, first).otherwise(F.aggregate(F.slice(p, run["first"] + 1, run["size"] - 1), first, add))

        # numbers are sorted, of the cell and then of the place: rows compare slowly
        places = F.sort_array(F.transform(u, lambda x, i: F.shiftleft(x["cell"].cast("long"), 32).bitwiseOR(i.cast("long"))))
        return let(places, lambda p: F.transform(let(F.transform(p, lambda x: F.shiftright(x, 32)), _runs), lambda run: one(p, run)))

    changes = F.flatten(F.concat(F.transform(plus, three(-1)), F.transform(minus, three(1))))
    return F.filter(let(F.concat(cells, changes), sums), lambda c: (c["n"] != 0) | (c["key"] != 0))


def peel(difference: Column, cells: int | Column = CELLS) -> Column:
    """struct<cells, plus, minus>: what is left (nothing, if it went well), and digests only in the first or second."""
    cells = F.lit(cells) if isinstance(cells, int) else cells
    none = F.array().cast(_EMPTY)
    zero = F.struct(difference.alias("cells"), none.alias("plus"), none.alias("minus"))

    def step(s: Column, third: Column) -> Column:
        single = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & _is_digest(c["key"]))
        keys = lambda found, sign: F.array_distinct(F.transform(F.filter(found, lambda c: c["n"] == sign), lambda c: c["key"]))

        def take(f: Column) -> Column:
            left = _without(s["cells"], f["p"], f["m"], third)
            return F.struct(left.alias("cells"), F.concat(s["plus"], f["p"]).alias("plus"), F.concat(s["minus"], f["m"]).alias("minus"))

        go = lambda found: F.when(F.size(found) == 0, s).otherwise(let(F.struct(keys(found, 1).alias("p"), keys(found, -1).alias("m")), take))
        return F.when(F.size(s["cells"]) == 0, s).otherwise(let(single, go))

    rounds = F.array_repeat(F.floor(cells / 3).cast("int"), ROUNDS)  # each round is told the cells of a table
    return F.aggregate(rounds, zero, step)


def size_of(keys: Column) -> Column:
    """Cells of a fingerprint: the smallest size with ``EACH`` cells for each element (the largest, if there is none)."""
    out = F.lit(CELLS * GROWTH ** (SIZES - 1))
    for level in range(SIZES - 2, -1, -1):
        out = F.when(EACH * F.size(keys) <= CELLS * GROWTH**level, F.lit(CELLS * GROWTH**level)).otherwise(out)
    return out


def difference(a: Column, b: Column) -> Column:
    """struct<ok, plus, minus, left, cells>: digests only in ``a`` and only in ``b``, by sketches that grow until peeling succeeds.

    Sizes of fewer cells than the numbers of elements differ by can't succeed and are passed over. Should
    the largest fail (more than a million differing elements, or a cycle of hashes), ``ok`` is false and
    ``left`` counts the elements that its cells still hold at least.
    """
    none = F.array().cast(_EMPTY)
    zero = F.struct(F.lit(False).alias("ok"), none.alias("plus"), none.alias("minus"), F.lit(0).alias("left"), F.lit(0).alias("cells"))
    least = F.greatest(F.abs(F.size(a) - F.size(b)), F.least(size_of(a), size_of(b)))
    sizes = F.filter(F.array(*[F.lit(CELLS * GROWTH**k) for k in range(SIZES)]), lambda m: (m >= least) | (m == CELLS * GROWTH ** (SIZES - 1)))

    def attempt(s: Column, m: Column) -> Column:
        held = lambda r: F.ceil(F.aggregate(r["cells"], F.lit(0), lambda n, c: n + F.greatest(F.abs(c["n"]), F.lit(1))) / 3).cast("int")
        out = lambda r: F.struct((F.size(r["cells"]) == 0).alias("ok"), r["plus"].alias("plus"), r["minus"].alias("minus"), held(r).alias("left"), m.alias("cells"))
        full = lambda c: F.size(c) > 0.96 * m  # noqa: E731  over one element a cell, which can't be peeled
        left = lambda c: F.struct(c.alias("cells"), none.alias("plus"), none.alias("minus"))
        return F.when(s["ok"], s).otherwise(let(subtract(a, b, m), lambda c: let(F.when(full(c), left(c)).otherwise(peel(c, m)), out)))

    return F.aggregate(sizes, zero, attempt)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two element arrays from the recovered difference."""

    def ratio(d: Column) -> Column:
        both = F.size(a) + F.size(b)
        gone = F.least(F.size(d["plus"]) + F.size(d["minus"]) + d["left"], both)
        return F.when(both == 0, F.lit(1.0)).otherwise((both - gone) / (both + gone).cast("double"))

    return let(difference(a, b), ratio)


def printed(keys: Column) -> Column:
    """The fingerprint as text: number of elements, number of cells, then the cells as {cell, count, key}."""
    return let(size_of(keys), lambda m: F.concat_ws(":", F.size(keys).cast("string"), m.cast("string"), F.replace(sketch(keys, m).cast("string"), F.lit(" "))))


def with_next(docs: DataFrame, buckets: int | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text): each document beside the next by descending id (after the last: the first).

    also: columns of "text" that are computed once and come as the document's own and, as next_<name>, the next one's.

    Ids are cut into ranges of about equal counts, and each range is a window of its own. The last
    document of a range needs the first of the following range that has any: those few are sent to
    both. A row for each range is all that is looked at together.
    """
    spark, also = docs.sparkSession, also or {}
    own = docs.select("doc_id", text_of(docs).alias("text"))
    kept = ["doc_id", "text", *also]
    ids = own.select("doc_id")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>")  # fewer than ``buckets`` numbers
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda c: c < F.col("doc_id"))))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    rows = own.withColumn("b", bucket)
    # the first document of a bucket: largest id, then least hash
    head = rows.groupBy("b").agg(F.max("doc_id").alias("top"))
    tops = rows.alias("r").join(head.alias("h"), (F.col("r.b") == F.col("h.b")) & F.col("r.doc_id").eqNullSafe(F.col("h.top")))
    head = tops.groupBy(F.col("r.b").alias("b"), F.col("top")).agg(F.min(F.xxhash64("text")).alias("th"))
    ring = [r["b"] for r in head.select("b").collect()]  # at most ``buckets`` + 1 numbers
    ring.sort(reverse=True)
    before = {b: ring[i - 1] for i, b in enumerate(ring)}
    head = materialise(head, "iblt-heads")
    if not ring:
        none = own.withColumns(also).withColumn("next_text", F.lit(None).cast("string"))
        return none.withColumns({f"next_{c}": F.col(c) for c in also})
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("b"))
    marked = rows.join(head.select(F.col("b").alias("hb"), "top", "th").hint("broadcast"), (F.col("b") == F.col("hb")) & F.col("doc_id").eqNullSafe(F.col("top")) & (F.xxhash64("text") == F.col("th")), "left")
    places = F.when(F.col("hb").isNotNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")), F.struct(prior.alias("b"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest"))))
    dealt = marked.select("doc_id", "text", places.alias("p")).withColumns(also)
    dealt = dealt.select(*kept, F.explode("p").alias("p")).select(*kept, "p.b", "p.guest")
    w = Window.partitionBy("b").orderBy(F.col("guest"), *order)
    dealt = dealt.withColumns({"next_text": F.lead("text").over(w)} | {f"next_{c}": F.lead(c).over(w) for c in also})
    return dealt.where("guest = 0").select(*kept, "next_text", *[f"next_{c}" for c in also])


def edited(docs: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text, edited), and ``also`` as in ``with_next``: the latter half replaced by as much of the next document's beginning."""
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    return with_next(docs, also=also).withColumn("edited", text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(docs, {"a": elements(F.col("text"))})
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", elements(F.col("edited")).alias("e"), F.col("next_a").alias("x"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("a")).alias("fingerprint"),
        printed(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"),
        likeness(F.col("a"), F.col("x")).alias("near_next"),
    )


def query(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
