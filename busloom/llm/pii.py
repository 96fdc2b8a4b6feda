"""Personal data: patterns, and information-theoretic sanitisation of what reveals them. DataFrame functions only.

Base spans come from four patterns, checked for their digits. Their values are the protected entities. A term reveals an
entity as far as knowing the term lowers the entity's information: with counts over all documents, the point-wise mutual
information log(N * n(entity, term) / (n(entity) * n(term))) against the entity's information log(N / n(entity)). A term of a
document with the entity is sanitised there if that ratio reaches DISCLOSURE: it is generalised to its class (a word, a
number), or removed if it reveals the entity wholly (REMOVAL).

Chance is kept out by a test, not by a least count: if the documents that hold a term held the entity no more often than any
document does, would a of the term's n documents hold it? The binomial probability of that, by Chernoff's bound, times the
number of terms of the corpus must be below CHANCE. For the test, the entity's documents are counted as different texts, of
which near copies are one: a text counts as the first, by digest, of the entity's texts whose terms are like its own (a
Jaccard similarity of NEAR, estimated from the smallest hash in each of 128 bins). The term's other documents count as they
are. A single text proves nothing by this test, unless the corpus has far fewer terms than documents. The ratio is of documents, copies included.

Entities that stand in the same texts are judged once, as one class: a directory that is copied many times makes one class of
its addresses. Entities, and bands of near copies, that hold over a thousandth of the rows of a join are joined where they stand.
The terms of the whole corpus are counted first: their number is part of the test.

A null or empty text has no spans. Positions are code points, the end exclusive. Terms are runs of 0-9, a-z and non-ASCII,
lower-cased in A-Z, outside base spans. Patterns run in linear time: possessive quantifiers, and no start inside a run that
has failed already. Repeated rows give repeated results. Columns other than key and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hot_keys, spread_join

DISCLOSURE, REMOVAL = 0.9, 0.995
#: How many terms an entity may have by chance.
CHANCE = 0.01
MAX_BROADCAST_TEXTS = 100_000
#: Near copies: the similarity, and how many bits of a hash name its bin and its band of bins.
NEAR, BIN_BITS, BAND_BITS = 0.8, 7, 4
KINDS = ("email", "ip", "card", "phone")
#: Patterns as given, rewritten so that no run of characters is scanned twice. \G starts where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+(?<=[0-9])(?<!\+[0-9])",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return x.rlike(rf"^(?:{part}\.){{3}}{part}$")
    digits = F.regexp_replace(x, "[^0-9]++", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def _ranked(rank: int):
    return lambda s: s["rank"] == rank


def _placed(kind: str, pattern: str, text: str, matches: str, pieces: str) -> str:
    """SQL for array<struct<start,kind,end,value>> from the matches and the pieces between them, by one running sum.

    Results are gathered in blocks, as appending to one long array would copy it each time.
    """
    item = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
    rank = kind
    new = f"array(named_struct('start', a.at + length(x.p), 'rank', {rank}, 'end', a.at + length(x.p) + length(x.m), 'value', x.m))"
    zipped = f"arrays_zip({matches}, {pieces})"  # not in a lambda, which would make the pieces anew for each match
    zero = f"named_struct('at', 0L, 'full', cast(array() as array<{item}>), 'open', cast(array() as {item}))"
    step = f"""if(x.m is null, a, named_struct('at', a.at + length(x.p) + length(x.m),
        'full', if(size(a.open) >= 512, concat(a.full, array(a.open)), a.full),
        'open', if(size(a.open) >= 512, {new}, concat(a.open, {new}))))"""
    step = step.replace("x.m", f"x.{matches}").replace("x.p", f"x.{pieces}")
    return f"aggregate({zipped}, {zero}, (a, x) -> {step}, a -> concat(flatten(a.full), a.open))"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(df: DataFrame, text: str, pattern: str, rank: int, out: str, needs: Column) -> DataFrame:
    """df with out: all matches of a pattern as structs (start, rank, end, value)."""
    empty = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,value:string>>)"
    p = _quoted(pattern)
    df = df.withColumn("__m", F.when(needs, F.expr(f"regexp_extract_all({text}, {p}, 0)")))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.expr(f"split({text}, {p}, -1)")))
    return df.withColumn(out, F.when(F.size("__m") > 0, F.expr(_placed(str(rank), pattern, text, "__m", "__p"))).otherwise(F.expr(empty))).drop("__m", "__p")


def _needs(kind: str, text: Column) -> Column:
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20-]?+[0-9]){11}")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    return F.contains(text, F.lit(NEEDS[kind]))


def base(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and base: array of (start, rank of the kind, end, value), by start and kind."""
    df = documents.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    lists = []
    for rank, kind in enumerate(KINDS):
        df = _spans(df, "__text", PATTERNS[kind], rank, f"__{kind}", _needs(kind, F.col("__text")))
        lists.append(F.filter(f"__{kind}", _checked(kind)))
    return df.select("__key", "__text", F.array_sort(F.concat(*lists)).alias("base"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blanked(text: Column) -> Column:
    """The text in lower case with what looks like base spans turned to spaces (as a source of terms, not of positions).

    Most texts hold nothing that a pattern needs, and are only lower-cased.
    """
    out = _lower(text)
    for kind in KINDS:
        long = r"[0-9](?:[\x20-]?+[0-9]){11,}+"  # a shorter number is a term like any other
        out = F.regexp_replace(out, long if kind == "card" else PATTERNS[kind], " ")
    some = _needs("email", text) | _needs("phone", text) | _needs("ip", text) | _needs("card", text)
    return F.when(some, out).otherwise(_lower(text))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def term_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """h, n_t: the documents that hold each term of the corpus outside what looks like base spans, by the term's 64-bit hash. Pre-aggregated before its shuffle."""
    words = _terms(_blanked(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    return documents.select(F.explode(words).alias("term")).select(F.xxhash64("term").alias("h")).groupBy("h").agg(F.count("*").alias("n_t"))


def _bin(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def signatures(texts: DataFrame) -> DataFrame:
    """__digest, mins (the smallest hash of the terms in each bin) and keys (a hash of each band of bins that isn't empty) of __digest, __text."""
    hashes = F.array_sort(F.transform(_terms(_blanked(F.col("__text"))), lambda t: F.xxhash64(t)))
    first = lambda h, i: (i == 0) | (_bin(h, BIN_BITS) != _bin(F.get("h", i - 1), BIN_BITS))
    mins = texts.select("__digest", hashes.alias("h")).select("__digest", F.filter("h", first).alias("mins"))
    bands = [F.filter("mins", lambda h, b=b: _bin(h, BAND_BITS) == b) for b in range(1 << BAND_BITS)]
    keys = F.array_compact(F.array(*(F.when(F.size(x) > 0, F.xxhash64(F.lit(b), x)) for b, x in enumerate(bands))))
    return mins.select("__digest", "mins", keys.alias("keys"))


def different(per_text: DataFrame, texts: DataFrame) -> DataFrame:
    """per_text (class, __digest and more) with group: the digest of the text that a near copy counts as, within a class.

    Texts that agree on a band of bins are compared with the first of them only, so that n near copies make no n * n pairs.
    """
    own = checkpointed(signatures(texts))
    keys = checkpointed(per_text.select("class", "__digest").join(own.select("__digest", F.explode("keys").alias("band")), "__digest").select(F.struct("class", "band").alias("key"), "__digest"))
    firsts = checkpointed(keys.groupBy("key").agg(F.min("__digest").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    pairs = spread_join(keys, firsts.drop("n"), "key", hot_keys(firsts, "key", "n", keys.count())).filter("__digest != first").select(F.col("key.class").alias("class"), "__digest", "first").distinct()
    pairs = pairs.join(own.select("__digest", F.col("mins").alias("a")), "__digest")
    counted = checkpointed(pairs.groupBy("first").agg(F.count("*").alias("n")))
    leads = own.select(F.col("__digest").alias("first"), F.col("mins").alias("b"))
    pairs = spread_join(pairs, leads, "first", hot_keys(counted, "first", "n", keys.count()))
    bins = F.size(F.array_distinct(F.transform(F.array_union("a", "b"), lambda h: _bin(h, BIN_BITS))))
    near = pairs.filter(F.size(F.array_intersect("a", "b")) >= NEAR * bins).groupBy("class", "__digest").agg(F.min("first").alias("first"))
    return per_text.join(near, ["class", "__digest"], "left").withColumn("group", F.coalesce("first", "__digest")).drop("first")


def _surprise(a: Column, n: Column, rate: Column) -> Column:
    """The least -log of the probability that a or more of n hit, at a rate each (Chernoff's bound; exact if all hit)."""
    missed = F.when(n > a, (n - a) * F.log((n - a) / (n * (1 - rate)))).otherwise(0.0)
    return F.when(a > n * rate, a * F.log(a / (n * rate)) + missed).otherwise(0.0)


def _classes(rows: DataFrame, least: float, n: float) -> tuple[DataFrame, DataFrame]:
    """entity and class of the entities that some term might tell, and class, __digest, copies and n_e (documents) of each class.

    A class is the set of texts of its entities, told by two sums of hashes over them. A rate is 1 / n at least and digests are no
    fewer than different texts, so no term passes for an entity in fewer texts than are asked for here.
    """
    entities = F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity")
    held = checkpointed(rows.select("__digest", entities).groupBy("entity", "__digest").agg(F.count("*").alias("copies")))
    sums = [F.sum(F.xxhash64("__digest", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2)]
    named = held.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), F.md5(F.concat_ws(",", *sums, F.count("*")).cast("binary")).alias("class"))
    named = checkpointed(named.filter(F.col("texts") * math.log(max(n, 1.0)) > least))
    first = checkpointed(named.groupBy("class").agg(F.min("entity").alias("entity"), F.first("n_e").alias("n_e"), F.first("texts").alias("texts")))
    per_text = spread_join(held, first.drop("texts"), "entity", hot_keys(first, "entity", "texts", held.count())).select("class", "__digest", "copies", "n_e")
    return named.select("entity", "class"), checkpointed(per_text)


def disclosures(rows: DataFrame, documents: DataFrame, text: str, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """entity, term and ratio of what is disclosed, from counts over all documents. rows: base, __text and __digest of those with spans."""
    counts = checkpointed(term_counts(documents, text))
    n = float(documents.count())
    least = math.log(max(counts.count(), 1) / chance)  # the surprise that a term must come to, among so many terms
    named, per_text = _classes(rows, least, n)
    if per_text.isEmpty():
        return documents.sparkSession.createDataFrame([], "entity string, term string, ratio double")
    per_text = checkpointed(different(per_text, _wanted(rows, per_text)))
    rate = (F.col("texts") / (n - F.col("n_e") + F.col("texts"))).alias("rate")
    known = per_text.groupBy("class").agg(F.count_distinct("group").alias("texts"), F.first("n_e").alias("n_e"), F.count("*").alias("rows")).select("class", "texts", rate, "rows")
    known = checkpointed(known.filter(-F.col("texts") * F.log("rate") > least).drop("texts"))  # what a term in all of the texts, and nowhere else, comes to
    per_text = checkpointed(spread_join(per_text, known.drop("rows"), "class", hot_keys(known, "class", "rows", per_text.count())))
    texts = _wanted(rows, per_text).select("__digest", F.explode(_terms(_blanked(F.col("__text")))).alias("term"))
    termed = per_text.join(texts, "__digest")
    together = termed.groupBy("class", "term").agg(F.first("n_e").alias("n_e"), F.first("rate").alias("rate"), F.sum("copies").alias("n_et"), F.count_distinct("group").alias("texts"))
    # a term passes in no fewer texts than it would if it stood nowhere else
    together = checkpointed(together.filter(-F.col("texts") * F.log("rate") > least))
    ratio = F.log(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.nullif(F.log(F.lit(n) / F.col("n_e")), F.lit(0.0))
    counted = together.join(counts, F.xxhash64("term") == F.col("h"))
    surprise = _surprise(F.col("texts"), F.col("texts") + F.col("n_t") - F.col("n_et"), F.col("rate"))
    told = counted.filter(surprise > least).select("class", "term", ratio.alias("ratio")).filter(F.col("ratio") >= disclosure)
    return checkpointed(told.join(named, "class").select("entity", "term", "ratio"))


def _wanted(rows: DataFrame, per_text: DataFrame) -> DataFrame:
    """__digest and __text of the texts of per_text, once each. Beyond MAX_BROADCAST_TEXTS digests of 32 bytes the join is shuffled."""
    wanted = checkpointed(per_text.select("__digest").distinct())
    few = wanted.count() <= MAX_BROADCAST_TEXTS
    return rows.join(F.broadcast(wanted) if few else wanted, "__digest", "left_semi").dropDuplicates(["__digest"]).select("__digest", "__text")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, removal: float = REMOVAL, chance: float = CHANCE) -> DataFrame:
    """key, base, terms (start, rank, end, value; rank 4: generalised, 5: removed), all spans, and the text where there are any."""
    # one pass over the texts; those without spans aren't kept
    found = checkpointed(base(documents, key, text).select("__key", "base", F.when(F.size("base") > 0, F.col("__text")).alias("__text")))
    rows = found.filter(F.size("base") > 0).withColumn("__digest", F.md5("__text"))
    told = disclosures(rows, documents, text, disclosure, chance)
    per_doc = rows.select("__digest", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity")).distinct().join(told, "entity")
    per_doc = per_doc.groupBy("__digest", "term").agg(F.max("ratio").alias("ratio")).groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("told"))
    marked = rows.join(per_doc, "__digest", "left")
    # what a row is made of comes from its own text, so positions are found again only where terms are told
    lower = _lower(F.col("__text"))
    marked = _spans(marked.withColumn("__l", lower), "__l", WORD, 4, "__words", F.col("told").isNotNull())
    chosen = F.filter("__words", lambda w: F.map_contains_key(F.col("told"), w["value"]) & ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    chosen = F.transform(chosen, lambda w: F.struct(w["start"].alias("start"), F.when(F.element_at(F.col("told"), w["value"]) >= removal, 5).otherwise(4).alias("rank"), w["end"].alias("end"), w["value"].alias("value")))
    marked = marked.withColumn("terms", F.when(F.col("told").isNotNull(), chosen))
    spans = F.array_sort(F.concat("base", F.coalesce("terms", F.slice("base", 1, 0))))
    none = found.filter(F.size("base") == 0).select("__key", "__text", "base", F.col("base").alias("terms"), F.col("base").alias("all"))
    return marked.select("__key", "__text", "base", "terms", spans.alias("all")).unionByName(none)


NAMES = (*KINDS, "term", "term")


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for n in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def report(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, counts by kind, n_terms, base_sha256 and spans of every row of documents."""
    rows = scan(documents, key, text, **options)
    counts = [F.size(F.filter("base", _ranked(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return rows.select(F.col("__key").alias(key), *counts, (F.size("all") - F.size("base")).cast("long").alias("n_terms"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


def sanitize(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key and sanitized text: base spans become their kind in brackets, disclosing terms their class, or nothing at all."""
    some = scan(documents, key, text, **options)
    mark = F.expr("""aggregate(`all`, named_struct('at', 0L, 'out', ''), (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out),
        named_struct('at', s.end, 'out', concat(a.out, substring(__text, cast(a.at + 1 as int), cast(s.start - a.at as int)),
            case s.rank when 0 then '[EMAIL]' when 1 then '[IP]' when 2 then '[CARD]' when 3 then '[PHONE]' when 4 then if(s.value rlike '^[0-9]+$', '[NUMBER]', '[WORD]') else '' end))),
        a -> concat(a.out, substring(__text, cast(a.at + 1 as int))))""")
    changed = some.filter(F.size("all") > 0).select(F.col("__key").alias("__k"), mark.alias("__to"), "__text").distinct()
    own = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__was"))
    same = F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__was") == F.col("__text"))
    return own.join(changed, same, "left").select(F.col("__key").alias(key), F.coalesce("__to", "__was").alias("sanitized"))
