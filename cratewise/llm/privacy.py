"""Personal data, and terms that give it away.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. How strongly a term
reveals one is estimated from their co-occurrence in documents: an entity in n_e of N documents has the information
log(N / n_e); knowing that a document has the term, in n_t documents, of which n_both hold the entity too, leaves
log(n_t / n_both) of it. The share that is gone is what the term discloses, 0 to 1. Terms that disclose GENERALISE_AT
are generalised to the kind of the entity, those that disclose REMOVE_AT are removed, wherever they stand.

All four numbers count documents. A pair is estimated if its documents hold the entity in three contexts at
least (of 40 code points on both sides, told apart by 40-bit hashes), so that copies and near copies of one
passage aren't evidence of their own; or if the term is a part of the address itself (NAME letters or more), which
needs no further evidence. Whether there is a third context is told by sums, without a set of them: with the lowest hash
and the highest one, the sum of (hash - low) * (high - hash) is over 0 only if there is one between them.

Spans are code point offsets, the end exclusive. A null text is empty. Rows equal in id and text get equal
results, one each. Possessive patterns keep very long runs linear. Only doc_id and text are read, so other
columns may have any name. An empty table gives an empty result. A text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import broadcast_if_small, carried, materialise, texts

# Kinds in the order of the report, with their patterns. Possessive loops at a pattern's end and
# before a character outside their class match the same as greedy ones. The first two may only start where a
# run of their first characters starts, or where the last match ended, as a later start in a run can't match more.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A term is a word of three letters or digits at least that isn't a part of an address.
TERM = r"(?<![\p{L}\p{N}@%+_-])(?<![A-Za-z0-9]\.)\p{L}[\p{L}\p{N}]{2,}+(?![@%+_-]|\.[A-Za-z0-9])"
CONTEXT = 40
CONTEXT_BITS = 40
NAME = 4
GENERALISE_AT = 0.8
REMOVE_AT = 0.95
#: Entities, terms or documents that are broadcast; beyond, a shuffled join.
MOST_ENTITIES, MOST_TERMS, MOST_DOCS = 200_000, 200_000, 100_000
DOC = ["doc_id", "h", "n"]
EMAIL, CARD = KINDS.index("email"), KINDS.index("card")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of all matches of a pattern that matches no empty text, left to right."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("done"))

    def add(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece["0"])
        end = at + F.length(piece["1"])
        return F.struct(end.alias("at"), F.concat(state["done"], F.array(F.struct(at.alias("start"), end.alias("end"), piece["1"].alias("value")))).alias("done"))

    def placed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("0"), found.alias("1"))
        return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, start, add, lambda s: s["done"]))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """(kind, start, end, value) by kind, then start; kind is a place in KINDS."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    needs = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}

    def of(n: int, kind: str) -> Column:
        found = F.filter(F.when(needs[kind], matches(text, PATTERNS[kind])).otherwise(none), lambda m: valid(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(F.lit(n).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*(of(n, kind) for n, kind in enumerate(KINDS)))


def shown(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


#: Contexts of an entity: how many, their sum and that of their squares, the lowest and the highest.
WIDE = "decimal(38,0)"


def sums_of(contexts: Column) -> list[Column]:
    add = lambda square: F.aggregate(contexts, F.lit(0).cast(WIDE), lambda s, c: (s + (c.cast("decimal(18,0)") * c.cast("decimal(18,0)") if square else c)).cast(WIDE))
    return [F.size(contexts).cast("long").alias("times"), add(False).alias("total"), add(True).alias("squares"), F.array_min(contexts).alias("low"), F.array_max(contexts).alias("high")]


def added() -> list[Column]:
    return [F.sum("times").alias("times"), F.sum("total").cast(WIDE).alias("total"), F.sum("squares").cast(WIDE).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high")]


def third_context() -> Column:
    """Whether a context lies between the lowest and the highest hash."""
    low, high, n = (F.col(c).cast("decimal(18,0)") for c in ("low", "high", "times"))
    return F.col("total") * (low + high).cast("decimal(18,0)") - F.col("squares") > n * (low * high).cast("decimal(28,0)")


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, base: the spans of each row; entities: each of its entities with the sums of its contexts; and the
    distinct terms of rows that have spans."""
    text = F.col("text")
    lead = lambda s: F.greatest(s["start"] - CONTEXT, F.lit(0))
    around = lambda s: F.xxhash64(F.substring(text, lead(s) + 1, s["start"] - lead(s)), F.substring(text, s["end"] + 1, F.lit(CONTEXT)))
    entity = lambda s: F.when(s["kind"] >= CARD, F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"]))
    base = F.transform(base_spans(text), lambda s: F.struct(s["kind"].alias("kind"), entity(s).alias("entity"), around(s).bitwiseAND((1 << CONTEXT_BITS) - 1).alias("context"), s["start"].alias("start"), s["end"].alias("end")))

    def entities(spans: Column) -> Column:
        """Runs of the sorted spans, one for each entity."""

        def cut(own: Column, firsts: Column) -> Column:
            size = lambda k: F.coalesce(F.get(firsts, k + 1), F.size(own) + 1) - F.get(firsts, k)
            run = lambda f, k: bound(F.slice(own, f, size(k)), lambda x: F.struct(x[0]["kind"].alias("kind"), x[0]["entity"].alias("entity"), *sums_of(F.transform(x, lambda e: e["context"]))))
            return F.transform(firsts, run)

        new = lambda own: F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (F.get(own, i - 1)["kind"] != F.get(own, i - 2)["kind"]) | (F.get(own, i - 1)["entity"] != F.get(own, i - 2)["entity"]))
        return bound(F.array_sort(spans), lambda own: bound(new(own), lambda firsts: cut(own, firsts)))

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text", base.alias("base"))
    rows = rows.withColumns({"entities": F.when(F.size("base") > 0, entities(F.col("base"))), "terms": F.when(F.size("base") > 0, terms_of(text))})
    spans = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return materialise(rows.withColumn("base", spans).drop("text"), "privacy-base")


def pairs(base: DataFrame) -> DataFrame:
    """kind, entity, term, n_both, n_entity of all pairs with evidence."""
    each = base.where(F.size("base") > 0).select("terms", F.explode("entities").alias("e")).select("terms", "e.*")
    entities = materialise(each.groupBy("kind", "entity").agg(F.count("*").alias("n_entity"), *added()), "privacy-entities")
    often = broadcast_if_small(entities.where(third_context()).select("kind", "entity"), MOST_ENTITIES)
    sums = ["times", "total", "squares", "low", "high"]
    seen = each.join(often, ["kind", "entity"]).select("kind", "entity", *sums, F.explode("terms").alias("term"))
    seen = seen.groupBy("kind", "entity", "term").agg(F.count("*").alias("n_both"), *added()).where(third_context())
    parts = F.filter(F.split(F.substring_index("entity", "@", 1), r"[^\p{L}]+"), lambda p: F.length(p) >= NAME)
    own = each.where(F.col("kind") == EMAIL).select("kind", "entity", F.explode(F.array_intersect("terms", parts)).alias("term"))
    own = own.groupBy("kind", "entity", "term").agg(F.count("*").alias("n_both"))
    both = seen.drop(*sums).unionByName(own).groupBy("kind", "entity", "term").agg(F.max("n_both").alias("n_both"))
    return materialise(both.join(entities.select("kind", "entity", "n_entity"), ["kind", "entity"]), "privacy-pairs")


def disclosures(docs: DataFrame, base: DataFrame) -> DataFrame:
    """kind, entity, term, disclosed (0 to 1) of all pairs with evidence. Words are counted in each task before any is sent."""
    words = texts(docs).select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    content = F.log(F.lit(float(max(1, base.count()))) / F.col("n_entity"))
    left = F.log(F.col("n_term") / F.col("n_both"))
    disclosed = F.when(content > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - left / content))).otherwise(0.0)
    return pairs(base).join(words, "term").select("kind", "entity", "term", disclosed.alias("disclosed"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, base, terms: entities of each row, and (start, end, disclosed, kind) of all terms that disclose GENERALISE_AT or more of any."""
    base = find_base(docs)
    telling = disclosures(docs, base).where(F.col("disclosed") >= GENERALISE_AT).groupBy("term").agg(F.max(F.struct("disclosed", "kind")).alias("most"))
    telling = broadcast_if_small(materialise(telling, "privacy-telling"), MOST_TERMS)
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    words = texts(docs).select(key.alias("key"), F.explode(terms_of(F.col("text"))).alias("term"))
    hits = words.join(telling, "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "most"))).alias("found"))
    hits = broadcast_if_small(materialise(hits, "privacy-hits"), MOST_DOCS)
    rows = texts(docs).select(key.alias("own"), "text").join(hits, F.col("own").eqNullSafe(F.col("key"))).dropDuplicates(["own"]).select("own", spans_of(F.col("text"), F.col("found")).alias("terms"))
    joined = base.drop("terms", "entities").join(rows, F.struct(*DOC).eqNullSafe(F.col("own")), "left").drop("own")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast(SPANS)))


SPANS = "array<struct<start:int,end:int,disclosed:double,kind:int>>"


def spans_of(text: Column, found: Column) -> Column:
    """Where the terms of ``found`` (by term, what it discloses) stand in a text."""
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda t, p: t + F.length(p))

    def placed(x: Column) -> Column:
        words, gaps = x["words"], x["gaps"]
        at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.map_contains_key(found, F.lower(F.get(words, i - 1))))

        def span(i: Column) -> Column:
            word = F.get(words, i - 1)
            most = found[F.lower(word)]
            start = lambda n: F.struct(n.alias("start"), (n + F.length(word)).alias("end"), most["disclosed"].alias("disclosed"), most["kind"].alias("kind"))
            return bound(length(F.slice(gaps, F.lit(1), i)) + length(F.slice(words, F.lit(1), i - 1)), start)

        return F.when(F.size(words) > 0, F.transform(at, span)).otherwise(F.array().cast(SPANS))

    return bound(F.struct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("words"), F.split(text, TERM, -1).alias("gaps")), placed)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    found = find(docs)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    terms = F.transform("terms", lambda t: F.struct(F.lit(len(KINDS)).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(shown(base, KINDS), 256).alias("base_sha256"), shown(F.concat(base, terms), [*KINDS, "term"]).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with entities replaced by their kind, telling terms by the kind of what they tell, and wholly disclosing ones by nothing."""
    found = find(docs)
    names, related = (F.array(*(F.lit(f"[{k.upper()}{more}]") for k in KINDS)) for more in ("", " OWNER"))
    marks = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("mark"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["disclosed"] >= REMOVE_AT, "").otherwise(F.get(related, t["kind"])).alias("mark"))),
    )
    spans = found.select(F.struct(*DOC).alias("key"), F.array_sort(marks).alias("marks")).where(F.size("marks") > 0).dropDuplicates(["key"])
    text = F.coalesce("row.text", F.lit(""))
    own = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    joined = carried(docs).withColumn("own", own).join(spans, F.col("own").eqNullSafe(F.col("key")), "left")

    def add(state: Column, m: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(m["start"] - state["at"], F.lit(0)))
        return F.when(m["end"] <= state["at"], state).otherwise(F.struct(m["end"].alias("at"), F.concat(state["done"], gap, m["mark"]).alias("done")))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    clean = F.aggregate("marks", begin, add, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))
    row = F.col("row").withField("text", F.when(F.col("marks").isNull(), F.col("row.text")).otherwise(clean))
    return joined.select(row.alias("row")).select("row.*")
