"""Queries C1-C22, K1, S1-S2: enrichment, queue, data quality and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import jaccard, search_text, tokens
from corpuslens.operators import enrich as R
from corpuslens.operators import ingest as I
from corpuslens.operators import quality as Q
from corpuslens.operators.components import kept
from corpuslens.plans.registry import query
from corpuslens.sources import views as W
from corpuslens.sources.files import read_drifting


@query("search_query_text", "SELECT page_id, trim(regexp_replace(regexp_replace(url, '[?*]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM pages")
def _(spark, d):
    return W.table(spark, d, "pages").select("page_id", search_text(F.col("url")).alias("q"))


OVERLAP = """CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"""
TOKENS = "list_distinct(list_filter(string_split({}, ' '), lambda t: t <> ''))"


@query(
    "title_jaccard",
    f"""SELECT paper_id, round({OVERLAP.format(a='a', b='b')}, 6) AS overlap FROM (SELECT p.paper_id, {TOKENS.format('p.title')} AS a, {TOKENS.format('q.title')} AS b
    FROM papers p JOIN papers q ON q.paper_id = p.paper_id + 1)""",
)
def _(spark, d):
    p = W.papers(spark, d).select("paper_id", "title")
    after = p.select((F.col("paper_id") - 1).alias("paper_id"), F.col("title").alias("other"))
    return p.join(after, "paper_id").select("paper_id", F.round(jaccard(tokens(F.col("title")), tokens(F.col("other"))), 6).alias("overlap"))


@query("surnames", "SELECT paper_id, string_agg(DISTINCT lower(list_last(string_split(display_name, '#'))), ',' ORDER BY lower(list_last(string_split(display_name, '#')))) AS names FROM authors GROUP BY paper_id")
def _(spark, d):
    rows = W.paper_authors(spark, d).select("paper_id", F.replace("display_name", F.lit("#"), F.lit("# ")).alias("name"))
    return rows.groupBy("paper_id").agg(F.array_join(F.array_sort(R.surnames(F.collect_list("name"))), ",").alias("names"))


def works(spark, d, lacking: bool = True) -> tuple[DataFrame, DataFrame]:
    """(papers, catalogue): entry id + 1,000,000 holds the title and authors of the next paper, its year shifted by id % 4.

    The whole catalogue has an entry for every paper. In one that is ``lacking`` every third paper is in no entry, so it is
    found by a near copy's title or not at all.
    """
    p = W.dated(spark, d).select("paper_id", F.col("title").alias("normalized_title"), F.year("o_orderdate").alias("year"))
    a = W.paper_authors(spark, d).groupBy("paper_id").agg(F.array_sort(F.collect_set("display_name")).alias("authors"))
    own = kept(p.join(a, "paper_id", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>"))))  # read by every step of a match
    held = own.filter("paper_id % 3 <> 0") if lacking else own
    catalogue = held.select((F.col("paper_id") + 999_999).alias("candidate_id"), "normalized_title", (F.col("year") + F.col("paper_id") % 4).alias("year"), "authors")
    return own, catalogue


def works_sql(held: str = "", least: str = " WHERE overlap >= 0.4995") -> str:
    """SQL of the match of all papers with a catalogue of those that are ``held``, by candidates of the ``least`` overlap."""
    return f"""own AS (SELECT d.paper_id, d.title, year(d.o_orderdate) AS y, coalesce((SELECT list_distinct(list(display_name)) FROM authors a WHERE a.paper_id = d.paper_id), []) AS names,
    {TOKENS.format('d.title')} AS toks FROM dated d),
    works AS (SELECT paper_id + 999999 AS candidate_id, title, y + paper_id % 4 AS y, names, toks FROM own{held}),
    pairs AS (SELECT DISTINCT p.paper_id, c.candidate_id FROM (SELECT paper_id, unnest(toks) AS token FROM own) p JOIN (SELECT candidate_id, unnest(toks) AS token FROM works) c USING (token)),
    placed AS (SELECT paper_id, candidate_id, row_number() OVER (PARTITION BY paper_id ORDER BY overlap DESC, candidate_id) AS place FROM
        (SELECT p.paper_id, candidate_id, {OVERLAP.format(a='o.toks', b='w.toks')} AS overlap FROM pairs p JOIN own o USING (paper_id) JOIN works w USING (candidate_id)){least}),
    scores AS (SELECT p.paper_id, candidate_id, round({OVERLAP.format(a='o.toks', b='w.toks')}, 3) AS title_overlap, o.title = w.title AS exact_title, abs(o.y - w.y) <= 1 AS year_match,
        len(list_intersect(list_distinct(list_transform(o.names, lambda n: lower(list_last(string_split(n, ' '))))), list_distinct(list_transform(w.names, lambda n: lower(list_last(string_split(n, ' '))))))) AS author_overlap
        FROM placed p JOIN own o USING (paper_id) JOIN works w USING (candidate_id) WHERE place <= 5),
    tiers AS (SELECT o.paper_id, count(s.candidate_id) FILTER (WHERE strong) AS strong, count(s.candidate_id) FILTER (WHERE title_overlap >= 0.5) AS moderate,
        max(s.candidate_id) FILTER (WHERE strong) AS best, max(exact_title) FILTER (WHERE strong) AS best_exact FROM own o
        LEFT JOIN (SELECT *, (exact_title OR title_overlap >= 0.8) AND (year_match OR author_overlap >= 1) AS strong FROM scores) s USING (paper_id) GROUP BY o.paper_id)"""


WHOLE, WORKS = works_sql(), works_sql(" WHERE paper_id % 3 <> 0")


def scored(spark, d, lacking: bool = True):
    own, catalogue = works(spark, d, lacking)
    return own, R.score_candidates(R.candidate_pairs(own, catalogue), own, catalogue)  # no match rests on a lower overlap


@query("candidate_pairs", f"WITH {WHOLE} SELECT paper_id, candidate_id FROM placed WHERE place <= 5")
def _(spark, d):
    return R.candidate_pairs(*works(spark, d, lacking=False))


@query("score_candidates", f"WITH {works_sql(least='')} SELECT paper_id, candidate_id, title_overlap, exact_title, year_match, author_overlap FROM scores")
def _(spark, d):
    own, catalogue = works(spark, d, lacking=False)
    return R.score_candidates(R.candidate_pairs(own, catalogue, least=0.0), own, catalogue).drop("shared_authors")


def match_a(works: str) -> str:
    return f"""WITH {works} SELECT paper_id, CASE WHEN paper_id % 10 = 0 OR strong = 1 THEN 'MATCHED' WHEN strong > 1 OR moderate > 0 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status,
    CASE WHEN paper_id % 10 = 0 THEN 'exact_doi' WHEN strong = 1 THEN 'title_candidate' END AS method,
    CASE WHEN paper_id % 10 = 0 THEN 1.0 WHEN strong = 1 THEN CASE WHEN best_exact THEN 0.85 ELSE 0.7 END END AS confidence,
    CASE WHEN paper_id % 10 = 0 THEN paper_id + 1000000 WHEN strong = 1 THEN best END AS candidate_id FROM tiers"""


def tier(own: DataFrame, rule: str) -> DataFrame:
    return own.filter(rule).select("paper_id", (F.col("paper_id") + 1_000_000).alias("candidate_id"))


def matched_a(spark, d, lacking: bool = True):
    own, scores = scored(spark, d, lacking)
    return R.match_tiers(own, scores, [("exact_doi", tier(own, "paper_id % 10 = 0"), 1.0)])


@query("match_tiered_a", match_a(WHOLE))
def _(spark, d):
    return matched_a(spark, d, lacking=False)


@query(
    "match_tiered_b",
    f"""WITH {WORKS} SELECT paper_id, CASE WHEN paper_id % 10 < 3 OR strong = 1 THEN 'MATCHED' WHEN strong > 1 OR moderate > 0 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status,
    CASE WHEN paper_id % 10 = 0 THEN 'exact_doi' WHEN paper_id % 10 = 1 THEN 'known_id' WHEN paper_id % 10 = 2 THEN 'exact_arxiv' WHEN strong = 1 THEN 'title_candidate' END AS method,
    CASE WHEN paper_id % 10 < 2 THEN 1.0 WHEN paper_id % 10 = 2 THEN 0.95 WHEN strong = 1 THEN CASE WHEN best_exact THEN 0.85 ELSE 0.7 END END AS confidence,
    CASE WHEN paper_id % 10 < 3 THEN paper_id + 1000000 WHEN strong = 1 THEN best END AS candidate_id FROM tiers""",
)
def _(spark, d):
    own, scores = scored(spark, d)
    tiers = [("exact_doi", tier(own, "paper_id % 10 = 0"), 1.0), ("known_id", tier(own, "paper_id % 10 = 1"), 1.0), ("exact_arxiv", tier(own, "paper_id % 10 = 2"), 0.95)]
    return R.match_tiers(own, scores, tiers)


def of_match_a(rest: str, works: str = WORKS) -> str:
    """SQL over the outcomes of the first catalogue's match."""
    return match_a(works).replace(f"{works} SELECT", f"{works}, outcome AS (SELECT", 1) + f") SELECT {rest}"


@query("match_summary", of_match_a("status, count(*) AS n, count(candidate_id) AS linked FROM outcome GROUP BY status", WHOLE))
def _(spark, d):
    return matched_a(spark, d, lacking=False).groupBy("status").agg(F.count("*").alias("n"), F.count("candidate_id").alias("linked"))


@query("fallback_candidates", of_match_a("paper_id FROM outcome WHERE status = 'NOT_FOUND'"))
def _(spark, d):
    return matched_a(spark, d).filter("status = 'NOT_FOUND'").select("paper_id")


@query("match_log", of_match_a("""paper_id, 'a' AS source, CASE WHEN paper_id % 4 = 0 THEN 1 ELSE 2 END AS attempt, CASE WHEN paper_id % 4 = 0 THEN 'FAILED' ELSE status END AS status,
    CASE WHEN paper_id % 4 <> 0 THEN candidate_id END AS candidate_id FROM outcome"""))
def _(spark, d):
    """Outcomes take the place of earlier attempts, which failed; every fourth paper has no new outcome."""
    from corpuslens.sources.io import upsert_latest

    outcome = matched_a(spark, d).filter("paper_id % 4 <> 0").select("paper_id", F.lit("a").alias("source"), F.lit(2).alias("attempt"), "status", "candidate_id")
    failed = W.papers(spark, d).select("paper_id", F.lit("a").alias("source"), F.lit(1).alias("attempt"), F.lit("FAILED").alias("status"), F.lit(None).cast("long").alias("candidate_id"))
    return upsert_latest(failed, outcome, ["paper_id", "source"], "attempt")


@query("id_change_history", "SELECT paper_id, category_code AS source, 'W' || paper_id AS old_id, 'W' || (paper_id + 1) AS new_id FROM papers WHERE paper_id % 6 = 0")
def _(spark, d):
    name = lambda c: F.concat(F.lit("W"), c.cast("string"))
    p = W.papers(spark, d).select("paper_id", F.col("category_code").alias("source"))
    old = p.withColumn("external_id", name(F.col("paper_id")))
    new = p.filter("paper_id % 2 = 0").withColumn("external_id", name(F.col("paper_id") + F.when(F.col("paper_id") % 3 == 0, 1).otherwise(0)))
    return R.id_changes(old, new)


@query(
    "consolidate_duplicates",
    """SELECT event_id AS record_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS keeper,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS kept FROM events""",
)
def _(spark, d):
    e = W.table(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("source"), F.col("ts").alias("fetched_at"))
    return R.consolidate(e).select("record_id", "keeper", "kept")


@query(
    "metric_snapshot_daily",
    """SELECT user_id AS paper_id, event_type AS metric, strftime(ts, '%Y-%m-%d') AS day, round(arg_max(value, (ts, event_id)), 6) AS value FROM events WHERE event_id % 9 <> 0 GROUP BY ALL""",
)
def _(spark, d):
    value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    m = W.table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("metric"), F.col("ts").alias("captured_at"), F.col("event_id").alias("seq"), value.alias("value"))
    return R.daily_snapshots(m).select("paper_id", "metric", W.day("day").alias("day"), F.round("value", 6).alias("value"))


@query(
    "reference_edges",
    """SELECT DISTINCT l_orderkey AS citing, 'W' || l_partkey AS external_id, p.paper_id AS cited FROM lineitem LEFT JOIN papers p ON p.paper_id = l_partkey WHERE l_partkey % 11 <> 0""",
)
def _(spark, d):
    key = F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("W"), F.col("l_partkey").cast("string")))
    refs = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("citing"), key.alias("external_id"))
    return R.reference_edges(refs, W.papers(spark, d).select("paper_id", F.concat(F.lit("W"), F.col("paper_id").cast("string")).alias("external_id")))


@query("author_identity_link")
def _(spark, d):
    """Authors by position; identities: each supplier under two ids, by odd and even papers. Rounds of claims have no plain SQL form."""
    a = W.paper_authors(spark, d).select("paper_id", "author_id", F.col("author_order").alias("position"), F.lower("display_name").alias("name"))
    i = a.select("paper_id", "name", F.concat_ws("-", F.lit("I"), F.col("author_id"), F.col("paper_id") % 2).alias("identity")).distinct()
    return R.identity_links(a, i)


@query(
    "institution_links",
    """SELECT DISTINCT paper_id, author_id, n_name AS institution FROM authors JOIN supplier ON author_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, d):
    s = W.table(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_nationkey").alias("n_nationkey"))
    n = W.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("institution"))
    return W.paper_authors(spark, d).select("paper_id", "author_id").join(s, "author_id").join(n, "n_nationkey").select("paper_id", "author_id", "institution").distinct()


@query("venue_links", "SELECT category_code AS venue, CASE WHEN CAST(substr(category_code, 4) AS BIGINT) % 3 = 0 THEN 'journal' ELSE 'unknown' END AS kind, count(*) AS papers FROM papers GROUP BY ALL")
def _(spark, d):
    kind = F.when(F.substring("category_code", 4, 10).cast("long") % 3 == 0, "journal")
    return W.papers(spark, d).groupBy(F.col("category_code").alias("venue"), F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count("*").alias("papers"))


def payloads(spark, d) -> DataFrame:
    """Catalogue works as JSON: each paper with its authors (every other one without institution), its lines' parts as references, and two concepts."""
    p = W.papers(spark, d)
    i = F.col("paper_id")
    w = lambda c: F.concat(F.lit("W"), c.cast("string"))
    concept = lambda n: F.struct(F.concat(F.lit("concept"), (i % n).cast("string")).alias("id"), F.concat(F.lit("Concept "), (i % n).cast("string")).alias("display_name"))
    a = W.paper_authors(spark, d).select("paper_id", "author_order", "author_id", "display_name")
    site = F.array(F.struct(F.concat(F.lit("I"), (F.col("author_id") % 5).cast("string")).alias("id"), F.lit("Site").alias("display_name"), F.lit("XX").alias("country_code")))
    author = F.struct(F.struct(F.concat(F.lit("A"), F.col("author_id").cast("string")).alias("id"), "display_name").alias("author"), F.when(F.col("author_id") % 2 == 0, site).alias("institutions"))
    authors = a.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("author_order", author.alias("x")))), lambda x: x["x"]).alias("authorships"))
    lines = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), w(F.col("l_partkey")).alias("ref"))
    cited = lines.groupBy("paper_id").agg(F.array_sort(F.collect_set("ref")).alias("referenced_works"))
    place = F.struct(
        F.concat(F.lit("http://host/"), i.cast("string")).alias("landing_page_url"), F.when(i % 3 == 0, F.concat(F.lit("http://host/pdf/"), i.cast("string"))).alias("pdf_url"),
        F.struct(F.col("category_code").alias("id"), F.upper("category_code").alias("display_name"), F.lit("journal").alias("type")).alias("source"),
    )
    body = F.struct(
        w(i).alias("id"), "title", F.year("o_orderdate").alias("publication_year"), (i % 40).alias("cited_by_count"), "authorships", "referenced_works",
        F.array(concept(3), concept(5)).alias("concepts"), place.alias("primary_location"),
    )
    return p.join(authors, "paper_id", "left").join(cited, "paper_id", "left").select("paper_id", F.to_json(body).alias("payload"))


@query(
    "read_payload_json",
    """SELECT paper_id, 'W' || paper_id AS id, CAST(year(o_orderdate) AS INTEGER) AS publication_year, paper_id % 40 AS cited_by_count, coalesce(n, 0) AS authors, coalesce(sites, 0) AS institutions, coalesce(refs, 0) AS refs,
    'concept' || (paper_id % 3) || ',concept' || (paper_id % 5) AS concepts, CASE WHEN paper_id % 3 = 0 THEN 'http://host/pdf/' || paper_id END AS pdf_url, category_code AS venue, first_name
    FROM papers LEFT JOIN (SELECT paper_id, count(*) AS n, count(*) FILTER (WHERE author_id % 2 = 0) AS sites, arg_min(display_name, author_order) AS first_name FROM authors GROUP BY paper_id) a USING (paper_id)
    LEFT JOIN (SELECT l_orderkey AS paper_id, count(DISTINCT l_partkey) AS refs FROM lineitem GROUP BY ALL) r USING (paper_id)""",
)
def _(spark, d):
    works = R.read_works(payloads(spark, d))
    authors = R.work_authors(works).groupBy("paper_id").agg(
        F.count("*").alias("authors"), F.count("institution_id").alias("institutions"), F.min_by("author_name", "position").alias("first_name")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return works.join(authors, "paper_id", "left").select(
        "paper_id", "id", "publication_year", "cited_by_count", zero(F.col("authors")).alias("authors"), zero(F.col("institutions")).alias("institutions"), zero(F.array_size("referenced_works")).alias("refs"),
        F.array_join(F.transform("concepts", lambda c: c["id"]), ",").alias("concepts"), F.col("primary_location.pdf_url").alias("pdf_url"), F.col("primary_location.source.id").alias("venue"), "first_name",
    )


@query(
    "concept_categories",
    """SELECT DISTINCT paper_id, code, false AS is_primary, code NOT IN ('concept0', 'concept1') AS is_new FROM (SELECT paper_id, 'concept' || unnest([paper_id % 3, paper_id % 5]) AS code FROM papers)""",
)
def _(spark, d):
    """Concepts of the works' payloads; two categories are stored already."""
    works = R.read_works(payloads(spark, d))
    new, links = R.concept_categories(works, spark.range(2).select(F.concat(F.lit("concept"), F.col("id").cast("string")).alias("code")))
    return links.join(new.select("code", F.lit(True).alias("is_new")), "code", "left").select("paper_id", "code", "is_primary", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query("publication_year", "SELECT paper_id, CAST(year(published) AS BIGINT) AS y FROM dated")
def _(spark, d):
    return W.dated(spark, d).select("paper_id", F.year("published").cast("long").alias("y"))


@query(
    "payload_drift",
    """SELECT event_id, CASE WHEN event_id % 5 NOT IN (3, 4) THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_id % 5 = 1 THEN 'u' || user_id END AS seen_by,
    CASE WHEN event_id % 5 = 2 THEN 'at={"hour":' || hour(ts) || '}' ELSE '' END AS unknown, CASE WHEN event_id % 5 = 4 THEN 'k: OBJECT<is: STRING>' ELSE '' END AS clashes, event_id % 5 <> 3 AS is_object FROM events""",
)
def _(spark, d):
    """Event payloads whose shape drifts: a nested field more, one that no one knows, one cut short, and one with another type."""
    e, i = W.table(spark, d, "events"), F.col("event_id") % 5
    start = F.expr("substring(props, 1, length(props) - 1)")
    body = (
        F.when(i == 1, F.concat(start, F.lit(', "by": {"id": "u'), F.col("user_id").cast("string"), F.lit('"}}')))
        .when(i == 2, F.concat(start, F.lit(', "at": {"hour": '), F.hour("ts").cast("string"), F.lit("}}")))
        .when(i == 3, start).when(i == 4, F.lit('{"k": {"is": "many"}}')).otherwise(F.col("props"))
    )
    rows = read_drifting(e.select("event_id", body.alias("payload")), {"k": ("$.k", "bigint"), "seen_by": ("$.by.id", "string")})
    unknown = F.array_join(F.transform(F.map_entries("unknown"), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")
    return rows.select("event_id", "k", "seen_by", unknown.alias("unknown"), F.array_join("clashes", ";").alias("clashes"), "is_object")


@query(
    "institution_dimension",
    """SELECT 'dimension' AS part, CAST(NULL AS BIGINT) AS paper_id, NULL AS author_id, institution_id, 'XX' AS country_code FROM (SELECT DISTINCT 'I' || (author_id % 5) AS institution_id FROM authors WHERE author_id % 2 = 0) WHERE institution_id <> 'I0'
    UNION ALL SELECT DISTINCT 'link', paper_id, 'A' || author_id, 'I' || (author_id % 5), NULL FROM authors WHERE author_id % 2 = 0 AND paper_id % 2 = 1""",
)
def _(spark, d):
    """Institutions of the payloads; one is stored already, and so are the links of even papers."""
    works = R.read_works(payloads(spark, d))
    stored = spark.range(1).select(F.concat(F.lit("I"), F.col("id").cast("string")).alias("institution_id"))
    linked = R.work_authors(works).filter("paper_id % 2 = 0 AND institution_id IS NOT NULL").select("paper_id", "author_id", "institution_id").distinct()
    new, links = R.institution_links(works, stored, linked)
    dimension = new.select(F.lit("dimension").alias("part"), F.lit(None).cast("long").alias("paper_id"), F.lit(None).cast("string").alias("author_id"), "institution_id", "country_code")
    return dimension.unionByName(links.select(F.lit("link").alias("part"), "paper_id", "author_id", "institution_id", F.lit(None).cast("string").alias("country_code")))


@query(
    "venue_dimension",
    """SELECT 'dimension' AS part, CAST(NULL AS BIGINT) AS paper_id, category_code AS venue_id, 'journal' AS type, upper(category_code) AS display_name FROM papers WHERE category_code <> 'src0' GROUP BY category_code
    UNION ALL SELECT 'link', paper_id, category_code, NULL, NULL FROM papers""",
)
def _(spark, d):
    """Venues of the payloads; one is stored already."""
    works = R.read_works(payloads(spark, d))
    stored = spark.range(1).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("venue_id"))
    new, links = R.venue_links(works, stored, spark.createDataFrame([], "paper_id long, venue_id string"))
    none = F.lit(None).cast("string")
    dimension = new.select(F.lit("dimension").alias("part"), F.lit(None).cast("long").alias("paper_id"), "venue_id", "type", "display_name")
    return dimension.unionByName(links.select(F.lit("link").alias("part"), "paper_id", "venue_id", none.alias("type"), none.alias("display_name")))


REASON = "CASE event_type WHEN 'signup' THEN 'HIGH_PRIORITY_PAPER' WHEN 'purchase' THEN 'OPENALEX_NOT_FOUND' WHEN 'view' THEN 'HISTORICAL_CANDIDATE' WHEN 'click' THEN 'USER_FACING' ELSE 'OPENALEX_AMBIGUOUS' END"


def requests(spark, d) -> DataFrame:
    return requests_of(W.table(spark, d, "events"))


def fold(where: str) -> str:
    return f"""SELECT paper_id, min(priority) AS priority, arg_min(reason, (priority, seq)) AS reason, list(reason ORDER BY seq) AS reasons, bool_or(full_detail) AS full_detail FROM (
    SELECT user_id AS paper_id, reason, CASE reason WHEN 'OPENALEX_NOT_FOUND' THEN 1 WHEN 'OPENALEX_AMBIGUOUS' THEN 2 WHEN 'HISTORICAL_CANDIDATE' THEN 3 ELSE 4 END AS priority,
    min(event_id) AS seq, bool_or(event_id % 40 = 0) AS full_detail FROM (SELECT *, {REASON} AS reason FROM events WHERE {where}) GROUP BY user_id, reason) GROUP BY paper_id"""


HELD = "CASE s.paper_id % 3 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'IN_PROGRESS' ELSE 'RETRY_SCHEDULED' END"


@query(
    "queue_enqueue",
    f"""SELECT coalesce(s.paper_id, n.paper_id) AS paper_id, CASE WHEN s.priority IS NULL OR n.priority < s.priority THEN n.priority ELSE s.priority END AS priority,
    CASE WHEN s.priority IS NULL OR n.priority < s.priority THEN n.reason ELSE s.reason END AS reason,
    array_to_string(list_concat(coalesce(s.reasons, []), list_filter(coalesce(n.reasons, []), lambda r: NOT list_contains(coalesce(s.reasons, []), r))), ',') AS reasons,
    coalesce(s.full_detail, false) OR coalesce(n.full_detail, false) AS full_detail,
    CASE WHEN n.paper_id IS NOT NULL AND (s.paper_id IS NULL OR s.paper_id % 3 = 2) THEN 'PENDING' ELSE {HELD} END AS status
    FROM ({fold('event_id % 2 = 0')}) s FULL JOIN ({fold('event_id % 2 = 1')}) n ON s.paper_id = n.paper_id""",
)
def _(spark, d):
    """Requests of odd events meet a queue that those of even ones left, partly matched or in work."""
    asked = requests(spark, d)
    held = F.when(F.col("paper_id") % 3 == 0, "MATCHED").when(F.col("paper_id") % 3 == 1, "IN_PROGRESS").otherwise("RETRY_SCHEDULED")
    stored = R.fold_queue(asked.filter("seq % 2 = 0")).withColumn("status", held)
    rows = R.enqueue(stored, asked.filter("seq % 2 = 1"))
    return rows.select("paper_id", "priority", "reason", F.array_join("reasons", ",").alias("reasons"), "full_detail", "status")


@query(
    "queue_ready",
    """SELECT o_orderkey AS paper_id, priority FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority FROM orders) WHERE o_orderstatus IN ('O', 'P')
    AND (o_custkey % 3 = 0 OR o_orderdate <= TIMESTAMP '1998-01-01') ORDER BY priority, o_orderdate, o_orderkey LIMIT 25""",
)
def _(spark, d):
    o = W.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "RETRY_SCHEDULED").otherwise("MATCHED")
    queue = o.select(
        F.col("o_orderkey").alias("paper_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderdate")).alias("next_retry_at"),
    )
    return R.ready(queue, F.lit("1998-01-01").cast("timestamp_ntz")).select("paper_id", "priority")


@query(
    "queue_transition",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'MATCHED' WHEN 'purchase' THEN 'AMBIGUOUS' WHEN 'view' THEN 'RETRY_SCHEDULED' WHEN 'click' THEN CASE WHEN event_id % 8 >= 5 THEN 'DEFERRED' ELSE 'RETRY_SCHEDULED' END ELSE 'FAILED' END AS status,
    CASE WHEN event_type = 'view' THEN CAST(epoch(ts) AS BIGINT) + 86400 * CASE WHEN user_id % 60 <= 30 THEN 5 ELSE 30 END WHEN event_type = 'click' AND event_id % 8 < 5 THEN CAST(epoch(ts) AS BIGINT) + 14400 END AS retry FROM (SELECT event_id, event_type, user_id, date_trunc('second', ts) AS ts FROM events)""",
)
def _(spark, d):
    kind = F.col("event_type")
    outcome = F.when(kind == "signup", "matched").when(kind == "purchase", "ambiguous").when(kind == "view", "not_found").when(kind == "click", "temporary").otherwise("permanent")
    now = F.date_trunc("second", F.col("ts").cast("timestamp"))
    rows = W.table(spark, d, "events").select("event_id", R.transition(outcome, F.col("event_id") % 8, F.col("user_id") % 60, now).alias("x"))
    return rows.select("event_id", "x.status", F.unix_seconds("x.next_retry_at").alias("retry"))


def broken(tbl: str, rule: str, rows: str, keys: list[str], having: str = "") -> str:
    key = " || ',' || ".join(f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys)
    return f"SELECT '{tbl}' AS tbl, '{rule}' AS rule, {key} AS key, count(*) AS n FROM {rows} GROUP BY ALL {having}"


TWICE = "HAVING count(*) > 1"
SNAPSHOTS = "(SELECT user_id AS paper_id, event_type AS metric, strftime(ts, '%Y-%m-%d') AS day FROM events)"
VERSION_ROWS = "(SELECT paper_id, version AS version_number, true AS is_latest FROM papers UNION ALL SELECT paper_id, 1, false FROM papers WHERE version > 1)"
REFERENCES = "(SELECT l_orderkey AS citing, l_partkey AS external_id FROM lineitem)"


@query(
    "constraint_violations",
    " UNION ALL ".join(
        [
            broken("categories", "unique code", "categories", ["code"], TWICE), broken("papers", "unique arxiv_id", "papers", ["arxiv_id"], TWICE),
            broken("papers", "merged_into_id in papers", "papers WHERE merged_into_id NOT IN (SELECT paper_id FROM papers)", ["merged_into_id"]),
            broken("papers", "merged or canonical", "papers WHERE is_canonical <> (merged_into_id IS NULL)", ["paper_id"]),
            broken("paper_versions", "unique paper_id,version_number", VERSION_ROWS, ["paper_id", "version_number"], TWICE),
            broken("paper_versions", "unique paper_id where is_latest", VERSION_ROWS + " WHERE is_latest", ["paper_id"], TWICE),
            broken("paper_authors", "unique paper_id,author_id", "authors", ["paper_id", "author_id"], TWICE),
            broken("paper_authors", "unique paper_id,author_order", "authors", ["paper_id", "author_order"], TWICE),
            broken("metric_snapshots", "unique paper_id,metric,day", SNAPSHOTS, ["paper_id", "metric", "day"], TWICE),
            broken("paper_references", "unique citing,external_id", REFERENCES, ["citing", "external_id"], TWICE),
            broken("assignments", "unique paper_id", "assignments", ["paper_id"], TWICE),
            broken("assignments", "membership in [0,1]", "assignments WHERE NOT membership BETWEEN 0 AND 1", ["paper_id"]),
            broken("assignments", "noise has no cluster", "assignments WHERE is_noise <> (cluster_id IS NULL)", ["paper_id"]),
            broken("assignments", "paper_id in papers", "assignments WHERE paper_id NOT IN (SELECT paper_id FROM papers)", ["paper_id"]),
            broken("lineitem", "unique l_orderkey,l_linenumber", "lineitem", ["l_orderkey", "l_linenumber"], TWICE),
        ]
    ),
)
def _(spark, d):
    k, p, lines, e = W.assignments(spark, d), W.papers(spark, d), W.table(spark, d, "lineitem"), W.table(spark, d, "events")
    versions = I.version_rows(p.select("paper_id", "version", F.col("o_orderdate").alias("published"), F.col("first_observed_at").alias("updated")))
    authors = W.paper_authors(spark, d)
    snapshots = e.select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("metric"), W.day("ts").alias("day"))
    references = lines.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("external_id"))
    rules = [
        Q.unique("categories", W.categories(spark, d), ["code"]), Q.unique("papers", p, ["arxiv_id"]),
        Q.refers("papers", p, "merged_into_id", "papers", p, "paper_id"), Q.holds("papers", p, "merged or canonical", F.col("is_canonical") == F.col("merged_into_id").isNull(), ["paper_id"]),
        Q.unique("paper_versions", versions, ["paper_id", "version_number"]), Q.unique("paper_versions", versions, ["paper_id"], "is_latest"),
        Q.unique("paper_authors", authors, ["paper_id", "author_id"]), Q.unique("paper_authors", authors, ["paper_id", "author_order"]),
        Q.unique("metric_snapshots", snapshots, ["paper_id", "metric", "day"]), Q.unique("paper_references", references, ["citing", "external_id"]),
        Q.unique("assignments", k, ["paper_id"]), Q.holds("assignments", k, "membership in [0,1]", F.col("membership").between(0, 1), ["paper_id"]),
        Q.holds("assignments", k, "noise has no cluster", F.col("is_noise") == F.col("cluster_id").isNull(), ["paper_id"]),
        Q.refers("assignments", k, "paper_id", "papers", p, "paper_id"), Q.unique("lineitem", lines, ["l_orderkey", "l_linenumber"]),
    ]
    return Q.report(rules)


@query("stream_queue", f"SELECT paper_id, priority, reason, array_to_string(reasons, ',') AS reasons, full_detail FROM ({fold('true')})")
def _(spark, d):
    from corpuslens.streaming.jobs import new_folder, queue_stream

    queue = queue_stream(spark, f"{d}/events.parquet", requests_of, new_folder(spark, "queue"))
    return queue.select("paper_id", "priority", "reason", F.array_join("reasons", ",").alias("reasons"), "full_detail")


#: Where the clock of numbered requests begins (2000-01-01): a stream's first watermark is the time 0, and what stands at it counts as late.
CLOCK_START = 946_684_800


@query("stream_queue_state", f"SELECT paper_id, priority, reason, array_to_string(reasons, ',') AS reasons, full_detail, 'PENDING' AS status FROM ({fold('true')})")
def _(spark, d):
    """The same requests, folded by keyed state with timers."""
    from corpuslens.streaming.jobs import new_folder
    from corpuslens.streaming.queue import run_queue

    def arrivals(events: DataFrame) -> DataFrame:
        asked = requests_of(events)
        at = F.timestamp_seconds(F.lit(CLOCK_START) + F.col("seq"))
        return asked.select("paper_id", "source", at.alias("ts"), "seq", F.lit("request").alias("kind"), "reason", F.lit(None).cast("double").alias("age_days"), "full_detail")

    queue, _ = run_queue(arrivals, f"{d}/events.parquet", new_folder(spark, "queue-state"), spark)
    return queue.select("paper_id", "priority", "reason", "reasons", "full_detail", "status")


def requests_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    reason = (
        F.when(kind == "signup", "HIGH_PRIORITY_PAPER").when(kind == "purchase", "OPENALEX_NOT_FOUND").when(kind == "view", "HISTORICAL_CANDIDATE")
        .when(kind == "click", "USER_FACING").otherwise("OPENALEX_AMBIGUOUS")
    )
    return events.select(F.col("user_id").alias("paper_id"), F.lit("s2").alias("source"), reason.alias("reason"), F.col("event_id").alias("seq"), (F.col("event_id") % 40 == 0).alias("full_detail"))


@query("stream_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def _(spark, d):
    """Arriving records, each stored once whatever is sent again."""
    from corpuslens.streaming.jobs import ingest_stream, new_folder

    stored = ingest_stream(spark, f"{d}/events.parquet", ["event_id"], new_folder(spark, "ingested"))
    return stored.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
