"""Registered queries: name, Spark callable, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The corpus views in SQL, each over the driver's tables and the views before it.
VIEWS = {
    "docs": """SELECT d.doc_id, d.text, d.source, o.o_orderdate,
        lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))) AS norm
        FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey""",
    "papers": """SELECT doc_id AS paper_id, strftime(o_orderdate, '%y%m') || '.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id,
        substr(norm, 1, 60) AS title, text AS abstract, source AS category_code,
        doc_id = min(doc_id) OVER (PARTITION BY text) AS is_canonical,
        CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN NULL ELSE min(doc_id) OVER (PARTITION BY text) END AS merged_into_id,
        o_orderdate + INTERVAL 7 DAY AS first_observed_at, o_orderdate, CAST(1 + doc_id % 3 AS BIGINT) AS version FROM docs""",
    "versions": "SELECT paper_id, 1 AS version_number, o_orderdate AS submitted_at FROM papers WHERE paper_id % 10 <> 0",
    "dated": """SELECT p.*, coalesce(v.submitted_at, p.first_observed_at) AS published
        FROM papers p LEFT JOIN versions v ON p.paper_id = v.paper_id AND v.version_number = 1""",
    "canonical": "SELECT * FROM dated WHERE is_canonical",
    "categories": """SELECT DISTINCT source AS code, source AS category_id,
        CASE WHEN CAST(substr(source, 4) AS BIGINT) % 2 = 0 THEN upper(source) END AS display_name FROM docs""",
    "authors": """SELECT l_orderkey AS paper_id, l_suppkey AS author_id, s_name AS display_name,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS author_order
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN docs ON l_orderkey = doc_id""",
    "embedded": """SELECT vec_id AS paper_id, embedding, label,
        CASE WHEN vec_id % 20 = 0 THEN 'FAILED' WHEN vec_id % 21 = 0 THEN 'PENDING' ELSE 'SUCCEEDED' END AS embedding_status,
        CASE WHEN vec_id % 23 = 0 THEN 'v0' ELSE 'v1' END AS model_version FROM embeddings""",
    "active": """SELECT e.paper_id, e.embedding, c.title, c.category_code, c.published, c.arxiv_id
        FROM embedded e JOIN canonical c USING (paper_id) WHERE e.embedding_status = 'SUCCEEDED' AND e.model_version = 'v1'""",
    "assignments": """SELECT paper_id, CASE WHEN paper_id % 8 = 0 THEN NULL ELSE label END AS cluster_id,
        CASE WHEN paper_id % 8 = 0 THEN 0.0 ELSE 1 - (paper_id % 10) / 20.0 END AS membership,
        paper_id % 8 = 0 AS is_noise, embedding[1:5] AS coords FROM embedded""",
    "cluster_labels": """SELECT CAST(i AS INTEGER) AS cluster_id, 'Cluster ' || i AS cluster_name, 'Papers of group ' || i AS short_description,
        'topic' || i || ', area' || (i % 3) AS keywords, CASE WHEN i = 9 THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS review_status
        FROM range(10) t(i)""",
    "clustered": """SELECT k.*, c.title, c.category_code, c.published, c.arxiv_id FROM assignments k JOIN canonical c USING (paper_id)""",
    "cohort_days": "SELECT DISTINCT CAST(published AS DATE) AS day FROM canonical WHERE year(o_orderdate) IN (1995, 2001)",
    "cohort_papers": "SELECT * FROM canonical WHERE year(o_orderdate) IN (1995, 2001)",
    "cohort_groups": """SELECT day, sum(fresh) OVER (ORDER BY day) AS grp FROM
        (SELECT day, CASE WHEN day - lag(day) OVER (ORDER BY day) > 30 THEN 1 ELSE 0 END AS fresh FROM cohort_days)""",
    "cohorts": """SELECT min(CASE WHEN grp = lo THEN day END) AS comparison_start, max(CASE WHEN grp = lo THEN day END) + 1 AS comparison_end,
        min(CASE WHEN grp = hi THEN day END) AS recent_start, max(CASE WHEN grp = hi THEN day END) + 1 AS recent_end
        FROM cohort_groups, (SELECT min(grp) AS lo, max(grp) AS hi FROM cohort_groups)""",
    "members": """SELECT 'category' AS entity_type, category_code AS entity_id, paper_id, published FROM cohort_papers
        UNION ALL SELECT 'cluster', CAST(cluster_id AS VARCHAR), p.paper_id, p.published
        FROM assignments k JOIN cohort_papers p USING (paper_id) WHERE NOT is_noise""",
    "counts": """SELECT entity_type, entity_id,
        count(*) FILTER (WHERE published >= recent_start AND published < recent_end) AS recent_count,
        count(*) FILTER (WHERE published >= comparison_start AND published < comparison_end) AS previous_count
        FROM members, cohorts GROUP BY ALL""",
    "totals": """SELECT *, sum(recent_count) OVER (PARTITION BY entity_type) AS recent_total,
        sum(previous_count) OVER (PARTITION BY entity_type) AS previous_total,
        max(recent_count) OVER (PARTITION BY entity_type) AS max_recent FROM counts""",
    "names": """SELECT 'category' AS entity_type, code AS entity_id, coalesce(display_name, code) AS entity_name FROM categories
        UNION ALL SELECT 'cluster', CAST(cluster_id AS VARCHAR), cluster_name FROM cluster_labels""",
    "runs": """SELECT event_id AS run_id, user_id AS kind, ts AS completed_at,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status FROM events""",
    "rates": """SELECT t.*, recent_count + previous_count AS total_papers,
        CASE WHEN previous_count > 0 THEN (recent_count - previous_count) / CAST(previous_count AS DOUBLE) WHEN recent_count = 0 THEN 0.0 END AS growth_rate,
        previous_count = 0 AND recent_count > 0 AS is_new_activity,
        recent_count / CAST(nullif(recent_total, 0) AS DOUBLE) AS recent_share, previous_count / CAST(nullif(previous_total, 0) AS DOUBLE) AS previous_share,
        (CASE WHEN recent_count > 0 THEN 0.5 ELSE 0 END) + (CASE WHEN previous_count > 0 THEN 0.5 ELSE 0 END) AS consistency,
        CASE WHEN recent_count > 0 THEN exp(-greatest(0, DATE '2001-08-10' - recent_end) / 90.0)
             WHEN previous_count > 0 THEN exp(-greatest(0, DATE '2001-08-10' - comparison_end) / 90.0) ELSE 0.0 END AS recency,
        (SELECT count(DISTINCT CAST(published AS DATE)) FROM cohort_papers WHERE published >= recent_start AND published < recent_end) AS recent_days
        FROM totals t, cohorts""",
    "scored": """SELECT *, recent_share - previous_share AS share_change,
        CASE WHEN growth_rate IS NULL THEN 0.5 ELSE (least(3.0, greatest(-1.0, growth_rate)) + 1) / 4 END AS growth_normalized,
        coalesce(recent_count / CAST(nullif(max_recent, 0) AS DOUBLE), 0.0) AS volume,
        CASE WHEN total_papers < 5 THEN 'Insufficient Data' WHEN is_new_activity AND recent_count >= 3 THEN 'Emerging'
             WHEN growth_rate BETWEEN -0.10 AND 0.10 AND previous_count >= 3 THEN 'Stable'
             WHEN growth_rate < -0.20 AND previous_count >= 3 THEN 'Cooling' ELSE 'Insufficient Data' END AS trend_class,
        CASE WHEN total_papers < 5 THEN 'INSUFFICIENT' WHEN previous_count < 3 OR least(recent_days, 90) / 90.0 < 0.10 THEN 'LOW' ELSE 'MEDIUM' END AS data_quality
        FROM rates""",
    "trend": """SELECT *, 0.5 * volume + 0.5 * growth_normalized AS momentum,
        CAST(round_even((25 * volume + 25 * growth_normalized + 15 * CASE WHEN share_change IS NULL THEN 0.5 ELSE (least(1.0, greatest(-1.0, share_change)) + 1) / 2 END
            + 15 * 0.5 + 10 * recency + 10 * consistency) * least(1.0, total_papers / 10.0), 0) AS BIGINT) AS trend_score FROM scored""",
}


def expand(body: str) -> str:
    """``body`` with the views that it names, and those that they name, before it."""
    import re

    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    ordered = [n for n in VIEWS if n in needed]
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    return (f"WITH {views}\n" if views else "") + body


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            SQL[name] = expand(body) if not body.upper().startswith("WITH ") else expand_with(body)
        return f

    return add


def expand_with(body: str) -> str:
    """A body that has views of its own: they go after the corpus views."""
    own = body[5:]
    full = expand(own)
    return full.replace("\n" + own, ",\n" + own) if full != own else body
