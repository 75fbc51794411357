"""SQL for the queries whose results SQL can state."""

from __future__ import annotations

_PAIRS = r"""
WITH occ AS (SELECT DISTINCT paper_no, trim(name, E' \t\r\n') AS name FROM (SELECT paper_no, unnest(authors) AS name FROM papers) WHERE trim(name, E' \t\r\n') <> ''),
total AS (SELECT count(DISTINCT paper_no) AS n FROM papers),
one AS (SELECT name, count(*) AS n FROM occ GROUP BY 1),
two AS (SELECT a.name AS author_a, b.name AS author_b, count(*) AS n FROM occ a JOIN occ b ON a.paper_no = b.paper_no AND a.name < b.name GROUP BY 1, 2),
pairs AS (SELECT author_a, author_b, two.n, a.n AS n_a, b.n AS n_b, total.n AS total FROM two JOIN one a ON author_a = a.name JOIN one b ON author_b = b.name CROSS JOIN total)
"""

_DOI = r"^[\s]*(?:https?://(?:www\.)?(?:dx\.)?doi\.org/|doi:\s*)?(10\.\d[\d.]*/\S*[^\s.,;:])[\s.,;:]*$"


def _plain(c: str) -> str:
    """SQL for a text without formatting; '1' marks it against null."""
    low = f"replace(lower({c}), '%2f', '/')"
    return f"'1' || CASE WHEN regexp_matches({low}, '{_DOI}') THEN regexp_extract({low}, '{_DOI}', 1) ELSE regexp_replace(lower({c}), '[\\p{{P}}\\p{{Z}}\\p{{Cf}}\\s]+', '', 'g') END"


ORACLE: dict[str, str] = {
    "p6_found": _PAIRS + "SELECT author_a, author_b FROM pairs WHERE n >= 5 AND n * total >= 3 * n_a * n_b",
    "p6_pairs": _PAIRS
    + """SELECT author_a, author_b, n, n_a, n_b, round(n::DOUBLE * total / (n_a::DOUBLE * n_b), 6) AS lift,
  round(((n + 0.5::DOUBLE) * (total - n_a - n_b + n + 0.5::DOUBLE)) / ((n_a - n + 0.5::DOUBLE) * (n_b - n + 0.5::DOUBLE)), 6) AS odds_ratio FROM pairs""",
    "p3_papers": f"""
WITH p AS (SELECT paper_no, coalesce({_plain('id')}, '0') || chr(31) || coalesce({_plain('doi')}, '0') || chr(31) || coalesce({_plain('title')}, '0') || chr(31) || coalesce({_plain('journal')}, '0') || chr(31) || coalesce(year::VARCHAR, '0') || chr(31) || coalesce(citations::VARCHAR, '0') || chr(31) || coalesce(len(authors)::VARCHAR || chr(30) || array_to_string(list_transform(authors, lambda a: coalesce({_plain('a')}, '0')), chr(30)), '0') AS k FROM papers),
c AS (SELECT k, min(paper_no) AS keep FROM p GROUP BY 1)
SELECT DISTINCT 'papers' AS tbl, keep AS keep_id, paper_no AS copy_id FROM p JOIN c USING (k) WHERE paper_no <> keep""",
    "p7_volume": """
WITH d AS (SELECT greatest(coalesce(n_tokens, 0), 0) AS n FROM documents)
SELECT sum(CASE WHEN n = 0 THEN 1 ELSE ceil(n / 4096.0) END)::BIGINT AS pieces, sum(n)::BIGINT AS tokens, count(*) FILTER (n > 4096) AS split, ceil(sum(n) / 4096.0)::BIGINT AS least_containers, true AS kept, true AS tight FROM d""",
}
