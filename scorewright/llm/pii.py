"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms around them.

Base spans are the leftmost non-overlapping matches of four patterns, checked after matching (ranges
of address parts, digit counts, Luhn). Each base value is a protected entity. A term (a word of four
or more letters, anywhere in a document that mentions the entity) reveals an entity e as far as knowing
the term t tells it: with document frequencies, PMI(t, e) = log2(P(e|t) / P(e)) against the
entity's information -log2 P(e). So that few documents don't pass for certainty, no floor but an
estimate decides: P(e|t) smoothed with ``PSEUDO`` documents at the rate P(e). Terms whose smoothed
PMI gives at least ``GENERALISE`` of the entity's information are generalised to their shape; if
their plain PMI gives ``REMOVE`` or more of it, they are removed. With ``everywhere``, as the query and the pipeline use it, that holds for all
occurrences of these terms in all documents. Without it only documents that mention the entity are
touched, so a document without personal data stays as it is.

Frequencies count all documents: words are summed by key before the shuffle, and texts are never
shuffled for counting. Equal texts are counted once, with their multiplicity. An entity is paired
only with words rare enough to reach ``GENERALISE`` if all its documents had them, which loses none.

Null and empty texts have no spans. Repeated rows are each reported; every row counts as a
document. Documents are told apart by id and text, null ids included. Extra columns are ignored, or
kept by ``sanitise``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, table, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Matches are those of the plain patterns. Runs are possessive and start only at their beginning
#: or at the last match's end: long runs then take linear time and no stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text without which no match is possible must contain.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
WORD = r"(?<![\p{L}\p{N}])\p{L}{4,}+(?!\p{N})"
#: Documents with the term, at the entity's own rate, added before P(e|t) is estimated.
PSEUDO = 1.0
GENERALISE = 0.9
REMOVE = 1.0
CHUNK = 64
#: Disclosing terms, of some dozens of bytes each, up to which their table is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 200_000
#: Disclosing terms of one text up to which its words are compared with them one by one; beyond that words are joined.
FEW = 64

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
WORDS = "array<struct<term:string,start:int,end:int>>"
TERMS = "array<struct<start:int,end:int,share:double>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    def total(d: Column) -> Column:
        digits = F.split(F.reverse(d), "")
        each = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
        return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    return let(_digits(v), lambda d: F.when(F.length(d).between(16, 19), total(d) % 10 == 0).otherwise(False))


def _small_parts(v: Column) -> Column:
    short = F.transform(F.split(v, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(short, lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, x.cast("int")).otherwise(999) <= 255))


CHECKS = {
    "email": None,
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>> of all matches, or those that ``keep`` accepts, in code points.

    The text between matches and the matches add up to the places. They are summed in chunks of
    ``CHUNK`` matches, so that very many matches take no quadratic time. Matches that are not kept
    only move the place: a list that grows is copied at each step.
    """

    def places(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, value: F.struct(F.length(gap).alias("0"), value.alias("1")))

        def chunked(s: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda c: F.slice(s, c * CHUNK + 1, F.lit(CHUNK)))

            def within(cs: Column) -> Column:
                width = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["0"] + F.length(x["1"])))
                starts = F.aggregate(width, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

                def spans(c: Column, start: Column) -> Column:
                    zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

                    def add(a: Column, x: Column) -> Column:
                        first = a["at"] + x["0"]
                        end = first + F.length(x["1"])
                        one = F.struct(first.alias("start"), end.alias("end"), x["1"].alias("value"))
                        more = F.concat(a["out"], F.array(one))
                        return F.struct(end.alias("at"), (F.when(keep(x["1"]), more).otherwise(a["out"]) if keep else more).alias("out"))

                    return F.aggregate(c, zero, add, lambda a: a["out"])

                return let(starts, lambda st: F.flatten(F.transform(cs, lambda c, i: spans(c, F.get(st, i)))))

            return let(chunks, within)

        return let(steps, chunked)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, places(m)).otherwise(none))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as listed and then by start."""
    none = F.array().cast(SPAN)

    def of(kind: str) -> Column:
        found = matches(text, PATTERNS[kind], CHECKS[kind])
        named = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        possible = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][\\x20-]?[0-9]")
        return F.when(possible, named).otherwise(none)

    return F.concat(*map(of, KINDS))


def _canonical(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _blanked(text: Column, base: Column) -> Column:
    """``text`` with the letters and digits of its base spans as zeros: places stay, and no word reaches into a span."""
    cuts = F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["end"])))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, c: Column) -> Column:
        first = F.greatest(a["at"], c["start"])
        blank = F.regexp_replace(F.substring(text, first + 1, c["end"] - first), r"[\p{L}\p{N}]", "0")
        piece = F.substring(text, a["at"] + 1, first - a["at"])
        return F.struct(F.greatest(a["at"], c["end"]).alias("at"), F.concat(a["out"], F.array(piece, blank)).alias("out"))

    return F.aggregate(cuts, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def _words(text: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<term, start, end>>: all words of ``text``, or those that ``keep`` accepts."""
    return F.transform(matches(text, WORD, keep), lambda m: F.struct(F.lower(m["value"]).alias("term"), m["start"], m["end"]))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, words) of each row: th is a hash of the text, base the base spans, words those outside of them if there are any."""
    rows = docs.select("doc_id", text_of(docs).alias("t")).withColumn("base", base_spans(F.col("t")))
    words = F.when(F.size("base") > 0, let(_blanked(F.col("t"), F.col("base")), lambda t: _words(t))).otherwise(F.array().cast(WORDS))
    return rows.select("doc_id", F.xxhash64("t").alias("th"), "base", words.alias("words"))


def _texts(found: DataFrame) -> DataFrame:
    """(th, n, entities, words): the distinct texts with base spans, n the rows that have them."""
    who = F.array_distinct(F.transform("base", lambda s: _canonical(s["kind"], s["value"])))
    some = found.where(F.size("base") > 0).select("th", who.alias("entities"), "words")
    return some.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.any_value("entities").alias("entities"), F.any_value("words").alias("words"))


def disclosures(docs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(entity, term, share): terms that give at least ``GENERALISE`` of the entity's information by the smoothed estimate; share: how much by the plain one."""
    mentioned = texts.select("th", "n", F.explode("entities").alias("entity"))
    entity_docs = mentioned.groupBy("entity").agg(F.sum("n").alias("ef")).where(F.col("ef") < total)
    words = F.array_distinct(F.transform(F.regexp_extract_all(text_of(docs), F.lit(WORD), F.lit(0)), F.lower))
    term_docs = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    terms = texts.select("th", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term")).join(term_docs, "term")
    rate = F.col("ef") / F.lit(float(max(1, total)))
    share = lambda given: F.log2(given / rate) / -F.log2(rate)
    smoothed = lambda joint: share((joint + PSEUDO * rate) / (F.col("tf") + PSEUDO))
    possible = smoothed(F.col("ef")) >= GENERALISE - 1e-9  # joint is ef at most
    pairs = mentioned.join(entity_docs, "entity").join(terms, "th").where(possible)
    both = pairs.groupBy("entity", "term", "ef", "tf").agg(F.sum("n").alias("joint")).where(smoothed(F.col("joint")) >= GENERALISE)
    plain = F.when(F.col("joint") == F.col("tf"), F.lit(1.0)).otherwise(share(F.col("joint") / F.col("tf")))
    return materialise(both.select("entity", "term", plain.alias("share")), "pii-disclosed")


def _elsewhere(docs: DataFrame, texts: DataFrame, terms: DataFrame, small: bool = False) -> DataFrame:
    """(th, term, start, end): occurrences of ``terms`` in the texts without base spans.

    small: ``terms`` can be broadcast. Words then meet them where the text is read, and only texts with one of them are shuffled.
    """
    rows = docs.select(text_of(docs).alias("t")).withColumn("th", F.xxhash64("t"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0)), F.lower))
    if small:
        terms = F.broadcast(terms)
        each = rows.withColumn("words", words).select("th", "t", F.explode_outer("words").alias("term")).join(terms, "term", "left_semi")
        held = each.groupBy("th").agg(F.collect_set("term").alias("found"), F.any_value("t").alias("t"))  # of one text
        held = held.join(texts.select("th"), "th", "left_anti")
    else:
        hits = rows.select("th", F.explode(words).alias("term")).join(terms, "term", "left_semi").groupBy("th").agg(F.collect_set("term").alias("found"))  # of one text
        hits = materialise(hits.join(texts.select("th"), "th", "left_anti"), "pii-hits")
        held = rows.join(hits, "th").dropDuplicates(["th"])
    own = lambda word: (F.size("found") > FEW) | F.array_contains("found", F.lower(word))
    held = held.select("th", _words(F.col("t"), own).alias("words"))
    # outer: of a plain explode Spark infers filters that find all words twice more; the join drops the nulls
    return held.select("th", F.explode_outer("words").alias("w")).select("th", "w.*").join(terms, "term", "left_semi").select("th", "term", "start", "end")


def term_spans(docs: DataFrame, found: DataFrame, everywhere: bool = False) -> DataFrame:
    """(x_th, terms): the spans that the method adds, sorted, for each text that has any.

    everywhere: in all texts, not only in those that mention the entity.
    """
    texts = materialise(_texts(found), "pii-texts")
    told = disclosures(docs, texts, found.count())
    words = texts.select("th", F.explode("words").alias("w")).select("th", "w.*")
    if everywhere:
        terms = materialise(told.groupBy("term").agg(F.max("share").alias("share")), "pii-told")
        small = terms.count() <= MOST_BROADCAST
        if small:
            terms = F.broadcast(terms)
        # a term of share 1 is in no document without the entity
        loose = terms.where(F.col("share") < 1).select("term")
        one = words.select("th", "term", "start", "end").unionByName(_elsewhere(docs, texts, loose, small)).join(terms, "term")
    else:
        mentioned = texts.select("th", F.explode("entities").alias("entity")).join(told, "entity")
        one = words.join(mentioned.groupBy("th", "term").agg(F.max("share").alias("share")), ["th", "term"])
    out = one.groupBy(F.col("th").alias("x_th")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    return materialise(out, "pii-terms")


def _with_terms(docs: DataFrame, everywhere: bool) -> DataFrame:
    found = materialise(detect(docs), "pii-found")
    extra = term_spans(docs, found, everywhere)
    out = found.join(extra, found["th"] == F.col("x_th"), "left")
    return out.select("doc_id", "th", "base", F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def spans(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans, n_term."""
    said = lambda kind, s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("base", lambda s: said(s["kind"], s))
    terms = F.transform("terms", lambda s: said(F.lit(TERM), s))
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    digest = F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256")
    return _with_terms(docs, everywhere).select("doc_id", *counts, digest, F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "X"), r"[^X]", "x")


def _rewrite(text: Column, cuts: Column) -> Column:
    """``text`` with each of ``cuts`` (start, end, to, null: its shape; sorted) replaced; a cut inside an earlier one is part of it."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, c: Column) -> Column:
        piece = F.substring(text, a["at"] + 1, c["start"] - a["at"])
        to = F.coalesce(c["to"], _shape(F.substring(text, c["start"] + 1, c["end"] - c["start"])))
        fresh = F.struct(c["end"].alias("at"), F.concat(a["out"], F.array(piece, to)).alias("out"))
        return F.when(c["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], c["end"]).alias("at"), a["out"].alias("out")))

    return F.aggregate(cuts, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """``docs`` with all spans of their texts masked, generalised or removed; ``n_chars``, if there, is counted anew."""
    found = _with_terms(docs, everywhere).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "th"])
    masks = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    base = F.transform("base", lambda s: F.struct(s["start"], s["end"], F.element_at(masks, s["kind"]).alias("to")))
    terms = F.transform("terms", lambda s: F.struct(s["start"], s["end"], F.when(s["share"] >= REMOVE, F.lit("")).alias("to")))
    cuts = found.select(F.col("doc_id").alias("x_id"), F.col("th").alias("x_th"), F.array_sort(F.concat(base, terms)).alias("x_cuts"))
    left = docs.select(*[docs[c].alias(f"d_{c}") for c in docs.columns])  # no column can clash with those of the cuts
    text = F.col("d_text").cast("string")
    out = left.join(cuts, F.col("d_doc_id").eqNullSafe(F.col("x_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("x_th")), "left")
    hit = F.col("x_cuts").isNotNull()
    clean = F.when(hit, _rewrite(text, F.col("x_cuts"))).otherwise(text)
    change = {"text": clean}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(hit, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d_n_chars"))
    return out.select(*[change.get(c, F.col(f"d_{c}")).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    return spans(table(spark, sf_dir, "documents"), everywhere=True)
