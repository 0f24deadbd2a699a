"""Personal data by patterns, then information-theoretic sanitisation (SQL functions only).

Base: emails, IP addresses, payment cards and phone numbers by pattern. Each
value found is a protected entity. Over the whole corpus, document counts of
entities, terms and entity-term pairs (a term within ``WINDOW`` words of a
mention, however far they reach) give two measures of a term. Its share is the pointwise mutual information of
term and entity, divided by the entity's own information content; its certainty is the probability of the entity where the term is seen,
two to the mutual information less the information content. Both are 1 for a term that leaves no doubt. Where an entity is in
less than a thirteenth of all documents, the share reaches its limits wherever the certainty does; the certainty serves for the more frequent ones.
In documents that hold the entity, terms of which either measure is at or over its ``GENERALISE`` are generalised to their word
class, and at or over its ``REMOVE`` they are removed. Pairs of any support count; the
estimate of a pair seen in s different texts is discounted by s / (s + ``PRIOR``), so
few texts prove less than many, and a text and its exact copies prove as much as one.

Cases: null text is empty; a text without base spans is left as it is; repeated
rows get equal results; other columns are ignored and kept, whatever their names; empty
tables give no rows. Time is nearly linear in a text and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import spans as S
from corpuslens.llm.common import filled, materialise, read, unused

# A match can only begin where its first run of characters begins or where the
# match before it ended; said so, and with possessive loops, time is linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
# Of chains of digits only those of twelve and more can be cards; short numbers, of which a
# long text may hold very many, are no matches at all.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
BASE = ("email", "ip", "card", "phone")
TERM = r"(?<!\p{L})\p{L}{3,40}(?!\p{L})"

#: Words to each side of a mention, over the whole text.
WINDOW = 8
NO_MENTIONS = "CAST(array() AS array<struct<entity:string,terms:array<string>>>)"
PRIOR = 0.5
#: Least share and certainty.
GENERALISE = (0.8, 0.6)
REMOVE = (0.95, 0.9)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True where the digits of ``value`` pass the check-digit test."""
    digits = F.reverse(F.split(_digits(value), "(?<=.)(?=.)"))

    def term(d: Column, i: Column) -> Column:
        n = d.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(digits, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    def card(v: Column) -> Column:
        n = F.length(_digits(v))
        return F.when((n >= 12) & (n <= 19), luhn(v)).otherwise(False)

    return F.concat(
        S.find(text, EMAIL, "email", 0),
        S.find(text, IP, "ip", 1, lambda v: F.regexp_like(v, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        S.find(text, CARD, "card", 2, card),
        S.find(text, PHONE, "phone", 3, lambda v: F.length(_digits(v)).between(9, 15)),
    )


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def _near(spans: Column, terms: Column) -> Column:
    """For each span, the terms within WINDOW words of it: the last that end before it and the first that begin after it."""
    starts = F.transform(terms, lambda t: t["start"])

    def around(span: Column, below: Column, beyond: Column) -> Column:
        first = F.greatest(below - WINDOW, F.lit(1))  # one more, as the last one may reach into the span
        left = F.filter(F.slice(terms, first, F.greatest(below - first + 1, F.lit(0))), lambda t: t["end"] <= span["start"])
        left = F.slice(left, F.greatest(F.size(left) - WINDOW + 1, F.lit(1)), F.lit(WINDOW))
        right = F.slice(terms, beyond + 1, F.lit(WINDOW))
        return F.array_distinct(F.transform(F.concat(left, right), lambda t: F.lower(t["value"])))

    below = S.counts_below(starts, F.transform(spans, lambda s: s["start"]))
    beyond = S.counts_below(starts, F.transform(spans, lambda s: s["end"]))
    both = F.zip_with(below, beyond, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(spans, both, lambda s, n: F.struct(_entity(s).alias("entity"), around(s, n["a"], n["b"]).alias("terms")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __id, __text_key, __spans, __mentions (entity, nearby terms), __terms (hashes, where spans are); written once."""
    text = docs.select(F.col(id_col).alias("__id"), filled(text_col).alias("__text"))
    spans = text.withColumn("__spans", base_spans(F.col("__text")))
    terms = S.let(S.find(F.col("__text"), TERM, "term", 0), lambda t: S.let(F.col("__spans"), lambda own: _near(own, t)))
    mentions = F.when(F.size("__spans") > 0, terms).otherwise(F.expr(NO_MENTIONS))
    return materialise(
        spans.select(
            "__id", F.xxhash64("__text").alias("__text_key"), "__spans", mentions.alias("__mentions"),
            F.when(F.size("__spans") > 0, F.array_distinct(_terms(F.col("__text")))).alias("__terms"),
        ), "pii-scan"
    )


def disclosures(docs: DataFrame, scanned: DataFrame, text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """(entity, term, removes) of the pairs at or over ``GENERALISE``. All counts are of documents, over all documents.

    Mentions are grouped by text first, so copies of a text are one row with their
    number. Terms are counted before they meet the pairs: the join holds counts only.
    """
    held = scanned.filter(F.size("__spans") > 0)
    texts = held.groupBy("__text_key").agg(F.first("__mentions").alias("__mentions"), F.count("*").alias("copies"))
    mention = texts.select("__text_key", "copies", F.explode("__mentions").alias("m")).select("__text_key", "copies", "m.entity", "m.terms")
    seen = mention.select("__text_key", "copies", "entity", F.explode("terms").alias("term")).distinct()
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_pair"))
    pairs = materialise(pairs, "pii-pairs")
    entities = mention.select("entity", "__text_key", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    words = docs.select(F.explode(F.array_distinct(_terms(filled(text_col)))).alias("__term"))
    terms = words.groupBy("__term").agg(F.count("*").alias("n_term"))
    total = scanned.agg(F.count("*").alias("n_all"))
    joined = (
        pairs.join(entities, "entity")
        .withColumn("__term", F.xxhash64("term"))
        .join(terms, "__term")
        .crossJoin(F.broadcast(total))  # one row
    )
    sure = F.col("texts") / (F.col("texts") + prior)
    information = F.log2(F.col("n_all") / F.col("n_entity"))
    mutual = F.log2(sure * F.col("n_pair") * F.col("n_all") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, mutual / F.nullif(information, F.lit(0.0))).otherwise(0.0)  # an entity of all documents tells nothing
    certainty = sure * F.col("n_pair") / F.col("n_term")
    over = lambda least: (share >= least[0]) | (certainty >= least[1])
    out = joined.filter(over(GENERALISE)).select("entity", "term", over(REMOVE).alias("removes"))
    return materialise(out, "pii-disclosures")


def _flagged(text: Column, flags: Column) -> Column:
    """The words of ``text`` that are among ``flags`` (term, general), as spans of kind ``remove`` or ``general``.

    Words and flags are sorted together, so that each word follows the flag of its term: no word is held against all flags.
    """

    def spans(words: Column) -> Column:
        own = F.transform(words, lambda w, i: F.struct(F.lower(w["value"]).alias("term"), F.lit(1).alias("word"), i.alias("i"), F.lit(False).alias("general")))
        flag = F.transform(flags, lambda f: F.struct(f["term"].alias("term"), F.lit(0).alias("word"), F.lit(-1).alias("i"), f["general"].alias("general")))
        return S.let(F.array_sort(F.concat(flag, own)), lambda both: matched(words, both))

    def matched(words: Column, both: Column) -> Column:
        last = S.running(F.transform(both, lambda x, j: F.when(x["word"] == 0, j).otherwise(-1)), S.later, -1)
        paired = F.zip_with(both, last, lambda x, j: F.struct(x.alias("x"), F.element_at(both, F.greatest(j, F.lit(0)) + 1).alias("flag")))
        hits = F.filter(paired, lambda p: (p["x"]["word"] == 1) & (p["flag"]["word"] == 0) & (p["flag"]["term"] == p["x"]["term"]))

        def span(p: Column) -> Column:
            w, general = F.element_at(words, p["x"]["i"] + 1), p["flag"]["general"]
            kind, order = F.when(general, "general").otherwise("remove"), F.when(general, 5).otherwise(4)
            return F.struct(w["start"].alias("start"), order.alias("ord"), kind.alias("kind"), w["end"].alias("end"), w["value"].alias("value"))

        return F.transform(hits, span)

    return S.let(S.find(text, TERM, "term", 0), spans)


def term_spans(docs: DataFrame, scanned: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __text_key, __term_spans) of the documents with disclosing terms; kind ``remove`` or ``general``.

    Documents meet pairs by term: few entities can hold most of a term, but an
    entity of many documents can have terms without number. Which of them the document holds is a second join, by
    document and entity, so that no row carries all entities of its text.
    """
    held = scanned.filter(F.size("__spans") > 0)
    terms = held.select("__id", "__text_key", F.explode("__terms").alias("__term"))
    owns = held.select(F.col("__id").alias("__oid"), F.col("__text_key").alias("__okey"), F.explode("__mentions").alias("m")).select("__oid", "__okey", F.col("m.entity").alias("__entity"))
    near = terms.join(found.withColumn("__term", F.xxhash64("term")), "__term")
    on = near["__id"].eqNullSafe(owns["__oid"]) & (near["__text_key"] == owns["__okey"]) & (near["entity"] == owns["__entity"])
    per_doc = (
        near.join(owns, on, "left_semi")
        .groupBy("__id", "__text_key", "term")
        .agg(F.max("removes").alias("removes"))
        .groupBy("__id", "__text_key")
        .agg(F.collect_list(F.struct("term", (~F.col("removes")).alias("general"))).alias("__flags"))
    )
    texts = docs.select(F.col(id_col).alias("__id"), filled(text_col).alias("__text")).withColumn("__text_key", F.xxhash64("__text"))
    hit = texts.join(per_doc.hint("shuffle_hash"), (texts["__id"].eqNullSafe(per_doc["__id"])) & (texts["__text_key"] == per_doc["__text_key"]))
    return hit.select(texts["__id"], texts["__text_key"], _flagged(F.col("__text"), F.col("__flags")).alias("__term_spans")).dropDuplicates(["__id", "__text_key"])


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: __id, __text_key, __spans (base), __all (base and terms outside base spans)."""
    scanned = scan(docs, id_col, text_col)
    found = disclosures(docs, scanned, text_col)
    terms = materialise(term_spans(docs, scanned, found, id_col, text_col), "pii-term-spans")
    terms = terms.withColumnsRenamed({"__id": "__tid", "__text_key": "__tkey"})
    rows = scanned.join(terms, (scanned["__id"].eqNullSafe(terms["__tid"])) & (scanned["__text_key"] == terms["__tkey"]), "left")
    spans = S.outside(F.concat("__spans", F.coalesce("__term_spans", F.expr(S.EMPTY))), len(BASE))
    return rows.select("__id", "__text_key", "__spans", F.when(F.col("__term_spans").isNotNull(), spans).otherwise(F.col("__spans")).alias("__all"))


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with base spans replaced by ``[KIND]``, general terms by ``[TERM]``, removed terms by nothing."""

    def label(s: Column) -> Column:
        named = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "general", F.lit("[TERM]")).otherwise(named)

    return S.replaced(text, spans, label)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text sanitised; documents without personal data keep their text (null stays null)."""
    row_key, own_id, own_key, own_spans = (unused(x, docs.columns) for x in ("__row_key", "__own_id", "__own_key", "__own_spans"))
    spans = find_private(docs, id_col, text_col).filter(F.size("__all") > 0).dropDuplicates(["__id", "__text_key"])
    spans = spans.select(F.col("__id").alias(own_id), F.col("__text_key").alias(own_key), F.col("__all").alias(own_spans))
    rows = docs.withColumn(row_key, F.xxhash64(filled(text_col)))
    out = rows.join(spans, rows[id_col].eqNullSafe(spans[own_id]) & (rows[row_key] == spans[own_key]), "left")
    text = F.when(F.col(own_spans).isNotNull(), sanitised(F.col(text_col), F.col(own_spans))).otherwise(F.col(text_col))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op8_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_private(read(spark, sf_dir, "documents"))
    return rows.select(
        F.col("__id").alias("doc_id"),
        *(S.count_kind(F.col("__spans"), k).alias(f"n_{k}") for k in BASE),
        F.sha2(S.joined(F.col("__spans")), 256).alias("base_sha256"),
        S.joined(F.col("__all")).alias("spans"),
    )
