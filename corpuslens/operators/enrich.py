"""Entity resolution against a catalogue, its side tables, and the retry queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import jaccard, tokens
from corpuslens.operators.components import kept

STRONG, MODERATE = 0.8, 0.5
#: Scores are rounded to 3 places, so a moderate one begins by so much lower.
LEAST = MODERATE - 0.0005
#: Overlaps down to which candidates are looked for in turn. Close enough that a title without enough works over one has few
#: over the next, however many works there are: so the pairs that pass grow with the titles and not with their square.
STEPS = (0.7995, 0.6495, LEAST, 0.2495, 0.1595, 0.0995)
#: Queue reasons and their priorities.
PRIORITIES = {
    "OPENALEX_NOT_FOUND": 1,
    "OPENALEX_AMBIGUOUS": 2,
    "SEMANTIC_SCHOLAR_FALLBACK": 2,
    "HISTORICAL_CANDIDATE": 3,
    "HIGH_PRIORITY_PAPER": 4,
    "USER_FACING": 4,
    "PERIODIC_REFRESH": 5,
}


def surnames(names: Column) -> Column:
    """Last words of names, lower case, each once."""
    last = F.transform(names, lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1)))
    return F.array_distinct(F.filter(last, lambda x: x != ""))


def _best_of_batch(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Leaves the ``top`` rows of each own_key of a batch, by overlap and candidate_id: what a join makes for one key comes in one run."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = batch["own_key"].dictionary_encode().indices.to_numpy()
                order = np.lexsort((batch["candidate_id"].to_numpy(), -batch["overlap"].to_numpy(), key))
                at, new = np.arange(len(order)), np.append(True, np.diff(key[order]) != 0)
                yield batch.take(pa.array(order[at - np.maximum.accumulate(np.where(new, at, 0)) < top]))

    return best


def candidate_pairs(papers: DataFrame, catalogue: DataFrame, least: float = LEAST, top: int = 5, salts: int = 8, hot: int = 10_000) -> DataFrame:
    """(paper_id, candidate_id): the ``top`` works of each paper by title overlap, of all works with an overlap of ``least`` and over; 0: of all that share a token.

    None is missed: two titles of some overlap share a token of their prefixes, the rarest tokens of each that leave too few
    others for it. The overlap asked for falls by STEPS: a title that has ``top`` works over one step can gain none below it, so only
    the rest look further, and few titles ever meet by their most frequent tokens. Titles of equal tokens meet once, as
    one class; tokens that very many works hold are dealt over ``salts`` keys.
    """

    def classes(df: DataFrame, key: str, name: str) -> DataFrame:
        title = F.array_sort(tokens(F.col("normalized_title")))
        return df.select(key, title.alias(name)).withColumn(f"{name}_key", F.unhex(F.md5(F.array_join(name, " "))))

    own, other = kept(classes(papers, "paper_id", "own")), kept(classes(catalogue, "candidate_id", "other"))
    counts = other.select("other_key", "other").distinct().select(F.explode("other").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    # ranks rise with the number of works, so a title's tokens in order of rank are its rarest first
    ranked = kept(counts.repartitionByRange("df", "token").sortWithinPartitions("df", "token").withColumn("rank", F.monotonically_increasing_id()))
    hottest = ranked.filter(F.col("df") > hot).agg(F.min("rank")).first()[0]

    def sets(df: DataFrame, name: str) -> DataFrame:
        """(key, size, ranks): the classes; tokens that no work holds count in the size alone."""
        words = df.select(f"{name}_key", name).distinct().select(f"{name}_key", F.size(name).alias(f"{name}_size"), F.explode(name).alias("token"))
        known = words.join(ranked, "token").groupBy(f"{name}_key", f"{name}_size").agg(F.array_sort(F.collect_list("rank")).alias(f"{name}_ranks"))
        return kept(known)

    def prefixes(df: DataFrame, name: str, step: float, salt: Column) -> DataFrame:
        """A row a token of the prefix, with the number of the class's tokens from it on."""
        held = F.size(f"{name}_ranks")
        prefix = F.slice(f"{name}_ranks", F.lit(1), F.greatest(F.lit(0), F.least(held, held - F.ceil(F.col(f"{name}_size") * step).cast("int") + 1)))
        rows = df.select("*", F.posexplode(prefix).alias("place", "rank")).withColumn(f"{name}_left", held - F.col("place")).drop("place")
        return rows.withColumn("salt", salt)

    def first(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
        return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("place") <= top).drop("place")

    works = first(other.select("candidate_id", "other_key"), "other_key", "candidate_id").groupBy("other_key").agg(F.collect_list("candidate_id").alias("ids"))
    many = F.lit(False) if hottest is None else F.col("rank") >= hottest
    dealt = F.when(many, F.pmod(F.hash("own_key"), F.lit(salts))).otherwise(F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.when(many, F.lit(salts - 1)).otherwise(F.lit(0))))
    waiting, other_sets, best = sets(own, "own"), kept(sets(other, "other").join(works, "other_key")), None
    steps = [s for s in STEPS if s > least] + [least]
    for step in steps:
        left, right = prefixes(waiting, "own", step, dealt), prefixes(other_sets, "other", step, copies)
        # a pair counts where it first meets, at its rarest shared token; that leaves so many others at most
        most = F.least("own_left", "other_left")
        met = left.join(right, ["rank", "salt"]).filter(most >= step * (F.col("own_size") + F.col("other_size") - most))
        shared = met.select("own_key", "ids", "own_size", "other_size", "rank", F.explode(F.array(F.array_intersect("own_ranks", "other_ranks"))).alias("shared"))
        n = F.size("shared")
        scored = shared.filter(F.get("shared", F.lit(0)) == F.col("rank")).withColumn("overlap", n / (F.col("own_size") + F.col("other_size") - n))
        scored = scored.filter(F.col("overlap") >= step).select("own_key", F.explode("ids").alias("candidate_id"), "overlap")
        some = scored.mapInArrow(_best_of_batch(top), scored.schema)  # neither all pairs of a family of titles are sorted nor do they move
        found = first(some, "own_key", F.desc("overlap"), "candidate_id").select("own_key", "candidate_id")
        if step != steps[-1]:
            found = found.withColumn("n", F.count("*").over(Window.partitionBy("own_key"))).filter(F.col("n") == top).drop("n")
        found = kept(found)
        best = found if best is None else best.unionByName(found)
        if step != steps[-1]:
            waiting = kept(waiting.join(found.select("own_key").distinct(), "own_key", "left_anti"))
    return own.select("paper_id", "own_key").join(best, "own_key").select("paper_id", "candidate_id")


WORK = (
    "id string, title string, publication_year int, cited_by_count long, authorships array<struct<author struct<id string, display_name string>, "
    "institutions array<struct<id string, display_name string, country_code string>>>>, referenced_works array<string>, "
    "concepts array<struct<id string, display_name string>>, primary_location struct<landing_page_url string, pdf_url string, source struct<id string, display_name string, type string>>"
)


def read_works(payloads: DataFrame, key: str = "paper_id", body: str = "payload") -> DataFrame:
    """Catalogue works of JSON payloads, typed; a payload that is no JSON gives nulls. It is parsed once."""
    return payloads.select(key, F.explode(F.array(F.from_json(body, WORK))).alias("w")).select(key, "w.*")


def work_authors(works: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, position, author_id, author_name, institution_id): a row an author and institution, null without one."""
    authors = works.select(key, F.posexplode("authorships").alias("position", "a"))
    named = authors.select(key, (F.col("position") + 1).cast("long").alias("position"), "a.author.*", F.explode_outer("a.institutions").alias("i"))
    return named.select(key, "position", F.col("id").alias("author_id"), F.col("display_name").alias("author_name"), F.col("i.id").alias("institution_id"))


def concept_categories(works: DataFrame, stored: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(new categories: code, display_name; links: key, code, is_primary): concepts as categories of a second taxonomy, never primary."""
    concepts = works.select(key, F.explode("concepts").alias("c")).select(key, F.col("c.id").alias("code"), F.col("c.display_name").alias("display_name")).filter("code IS NOT NULL")
    new = concepts.groupBy("code").agg(F.min("display_name").alias("display_name")).join(stored.select("code"), "code", "left_anti")
    return new, concepts.select(key, "code").distinct().withColumn("is_primary", F.lit(False))


def institution_links(works: DataFrame, stored: DataFrame, linked: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(new institutions: institution_id, display_name, country_code; new links: key, author_id, institution_id), both without what is there.

    An institution without id goes by its name in small letters; without either it is left out, as is one of an author without id.
    Of several names of an institution the first by country and name stays.
    """
    authors = works.select(key, F.explode("authorships").alias("a")).select(key, F.col("a.author.id").alias("author_id"), F.explode("a.institutions").alias("i"))
    code = F.coalesce(F.nullif(F.trim("i.id"), F.lit("")), F.nullif(F.lower(F.trim("i.display_name")), F.lit("")))
    rows = authors.select(key, "author_id", code.alias("institution_id"), "i.display_name", "i.country_code").filter("institution_id IS NOT NULL AND author_id IS NOT NULL")
    first = F.min(F.struct(F.col("country_code").isNull().alias("none"), "country_code", "display_name")).alias("x")
    new = rows.groupBy("institution_id").agg(first).select("institution_id", "x.display_name", "x.country_code")
    links = rows.select(key, "author_id", "institution_id").distinct()
    return new.join(stored.select("institution_id"), "institution_id", "left_anti"), links.join(linked.select(*links.columns), links.columns, "left_anti")


def venue_links(works: DataFrame, stored: DataFrame, linked: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """(new venues: venue_id, display_name, type; new links: key, venue_id), both without what is there. A venue without type is ``unknown``."""
    place = F.col("primary_location.source")
    rows = works.select(key, place["id"].alias("venue_id"), place["display_name"].alias("display_name"), place["type"].alias("type")).filter(F.length("venue_id") > 0)
    first = F.min(F.struct(F.col("type").isNull().alias("none"), "type", "display_name")).alias("x")
    new = rows.groupBy("venue_id").agg(first).select("venue_id", "x.display_name", F.coalesce("x.type", F.lit("unknown")).alias("type"))
    links = rows.select(key, "venue_id").distinct()
    return new.join(stored.select("venue_id"), "venue_id", "left_anti"), links.join(linked.select(*links.columns), links.columns, "left_anti")


def score_candidates(pairs: DataFrame, papers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Evidence of each pair. The overlap is rounded to 3 places, and the rounded one decides."""
    p = papers.select("paper_id", F.col("normalized_title").alias("p_title"), F.col("year").alias("p_year"), F.col("authors").alias("p_authors"))
    c = catalogue.select("candidate_id", F.col("normalized_title").alias("c_title"), F.col("year").alias("c_year"), F.col("authors").alias("c_authors"))
    rows = pairs.join(p, "paper_id").join(c, "candidate_id")
    shared = F.array_sort(F.array_intersect(surnames(F.col("p_authors")), surnames(F.col("c_authors"))))
    return rows.select(
        "paper_id", "candidate_id",
        F.round(jaccard(tokens(F.col("p_title")), tokens(F.col("c_title"))), 3).alias("title_overlap"),
        (F.col("p_title") == F.col("c_title")).alias("exact_title"),
        F.coalesce(F.abs(F.col("p_year") - F.col("c_year")) <= 1, F.lit(False)).alias("year_match"),
        F.size(shared).cast("long").alias("author_overlap"), F.array_join(shared, ",").alias("shared_authors"),
    )


def match_tiers(papers: DataFrame, scored: DataFrame, tiers: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """(paper_id, status, method, confidence, candidate_id).

    ``tiers``: (method, rows of paper_id and candidate_id, confidence), tried in
    order before titles. One strong title matches; several, or any moderate one, are AMBIGUOUS.
    """
    strong = (F.col("exact_title") | (F.col("title_overlap") >= STRONG)) & (F.col("year_match") | (F.col("author_overlap") >= 1))
    titles = scored.groupBy("paper_id").agg(
        F.count_if(strong).alias("strong"), F.count_if(F.col("title_overlap") >= MODERATE).alias("moderate"),
        F.max(F.when(strong, F.struct("candidate_id", "exact_title"))).alias("best"),
    )
    rows = papers.select("paper_id").join(titles, "paper_id", "left")
    status, method, confidence, found = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")
    for k, (name, matches, sure) in enumerate(tiers):
        rows = rows.join(matches.groupBy("paper_id").agg(F.min("candidate_id").alias(f"t{k}")), "paper_id", "left")
        hit = F.col(f"t{k}").isNotNull() & status.isNull()
        method, confidence, found = F.when(hit, name).otherwise(method), F.when(hit, sure).otherwise(confidence), F.when(hit, F.col(f"t{k}")).otherwise(found)
        status = F.when(hit, "MATCHED").otherwise(status)
    one = status.isNull() & (F.col("strong") == 1)
    unclear = (F.col("strong") > 1) | (F.col("moderate") > 0)
    return rows.select(
        "paper_id",
        F.coalesce(status, F.when(one, "MATCHED").when(unclear, "AMBIGUOUS").otherwise("NOT_FOUND")).alias("status"),
        F.when(one, "title_candidate").otherwise(method).alias("method"),
        F.when(one, F.when(F.col("best.exact_title"), 0.85).otherwise(0.7)).otherwise(confidence).alias("confidence"),
        F.when(one, F.col("best.candidate_id")).otherwise(found).alias("candidate_id"),
    )


def id_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(paper_id, source, old_id, new_id) where the external id of a record changed."""
    rows = old.select("paper_id", "source", F.col("external_id").alias("old_id")).join(new.select("paper_id", "source", F.col("external_id").alias("new_id")), ["paper_id", "source"])
    return rows.filter("old_id <> new_id")


def consolidate(records: DataFrame) -> DataFrame:
    """Each record with its keeper: the newest of its (paper_id, source), by fetched_at then id."""
    keeper = records.groupBy("paper_id", "source").agg(F.max_by("record_id", F.struct("fetched_at", "record_id")).alias("keeper"))
    return records.join(keeper, ["paper_id", "source"]).withColumn("kept", F.col("record_id") == F.col("keeper"))


def daily_snapshots(metrics: DataFrame) -> DataFrame:
    """(paper_id, metric, day, value): the last value of each day; null values are no values."""
    rows = metrics.filter("value IS NOT NULL")
    return rows.groupBy("paper_id", "metric", F.to_date("captured_at").alias("day")).agg(F.max_by("value", F.struct("captured_at", "seq")).alias("value"))


def reference_edges(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(citing, external_id, cited): each reference once, resolved to a paper where one has the id; null ids are skipped."""
    own = references.filter("external_id IS NOT NULL").select("citing", "external_id").distinct()
    return own.join(papers.select("external_id", F.col("paper_id").alias("cited")), "external_id", "left").select("citing", "external_id", "cited")


def identity_links(authors: DataFrame, identities: DataFrame) -> DataFrame:
    """(author_id, identity): one identity an author and one author an identity, by equal name on a shared paper.

    Claims are ranked by paper and position, the order of a loop over papers; a claim
    holds if it is the first of its author and of its identity. Refused authors try
    again with what is left, until no claim is new. Each round settles the first claim at
    least, and claims are one a pair of author and identity; as many rounds as the longest chain of
    authors who each lose an identity to the one before, two or three as a rule.
    """
    claims = authors.join(identities, ["paper_id", "name"]).select("author_id", "identity", F.struct("paper_id", "position").alias("turn"))
    claims = claims.groupBy("author_id", "identity").agg(F.min("turn").alias("turn"))
    held = None
    while True:
        by_author, by_identity = Window.partitionBy("author_id").orderBy("turn", "identity"), Window.partitionBy("identity").orderBy("turn", "author_id")
        first = claims.withColumns({"a": F.row_number().over(by_author), "b": F.row_number().over(by_identity)})
        won = kept(first.filter("a = 1 AND b = 1").select("author_id", "identity"))
        held = won if held is None else held.unionByName(won)
        claims = kept(claims.join(won.select("author_id"), "author_id", "left_anti").join(won.select("identity"), "identity", "left_anti"))
        if claims.isEmpty():
            return held


def fold_queue(requests: DataFrame) -> DataFrame:
    """One row per (paper_id, source): best priority and its first reason, distinct reasons in order of arrival, full detail if ever asked for."""
    table = F.create_map(*[F.lit(x) for pair in PRIORITIES.items() for x in pair])
    rows = requests.withColumn("priority", table[F.col("reason")]).filter("priority IS NOT NULL")
    firsts = rows.groupBy("paper_id", "source", "reason", "priority").agg(F.min("seq").alias("seq"), F.max("full_detail").alias("full_detail"))
    return firsts.groupBy("paper_id", "source").agg(
        F.min("priority").alias("priority"), F.min_by("reason", F.struct("priority", "seq")).alias("reason"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]).alias("reasons"), F.max("full_detail").alias("full_detail"),
    )


def enqueue(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue after requests: open rows become PENDING, MATCHED and IN_PROGRESS ones stay, a strictly better priority sets the reason."""
    new = fold_queue(requests).toDF("paper_id", "source", "n_priority", "n_reason", "n_reasons", "n_full")
    rows = stored.join(new, ["paper_id", "source"], "full")
    better = F.coalesce(F.col("n_priority") < F.col("priority"), F.col("priority").isNull())
    asked = F.col("n_priority").isNotNull()
    fixed = F.col("status").isin("MATCHED", "IN_PROGRESS")
    return rows.select(
        "paper_id", "source",
        F.when(better, F.col("n_priority")).otherwise(F.col("priority")).alias("priority"),
        F.when(better, F.col("n_reason")).otherwise(F.col("reason")).alias("reason"),
        F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("n_reasons", F.array().cast("array<string>")))).alias("reasons"),
        (F.coalesce("full_detail", F.lit(False)) | F.coalesce("n_full", F.lit(False))).alias("full_detail"),
        F.when(asked & ~F.coalesce(fixed, F.lit(False)), "PENDING").otherwise(F.col("status")).alias("status"),
    )


def ready(queue: DataFrame, now: Column, limit: int = 25) -> DataFrame:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)
    return queue.filter(F.col("status").isin("PENDING", "RETRY_SCHEDULED") & due).orderBy("priority", "created_at", "paper_id").limit(limit)


def transition(outcome: Column, attempts: Column, age_days: Column, now: Column) -> Column:
    """struct(status, next_retry_at) after an attempt; ``attempts`` counts it."""
    retry = now + F.when(F.coalesce(age_days <= 30, F.lit(False)), F.expr("INTERVAL 5 DAYS")).otherwise(F.expr("INTERVAL 30 DAYS"))
    status = (
        F.when(outcome == "matched", "MATCHED").when(outcome == "ambiguous", "AMBIGUOUS").when(outcome == "not_found", "RETRY_SCHEDULED")
        .when(outcome == "temporary", F.when(attempts >= 5, "DEFERRED").otherwise("RETRY_SCHEDULED")).otherwise("FAILED")
    )
    at = F.when(outcome == "not_found", retry).when((outcome == "temporary") & (attempts < 5), now + F.expr("INTERVAL 4 HOURS"))
    return F.struct(status.alias("status"), at.alias("next_retry_at"))
