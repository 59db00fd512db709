"""ANSI SQL (DuckDB dialect) for the query catalogue.

Written from the definition of the views, not from the Spark expressions: the expected
normalized names follow from how the names were put together, groups are windows instead of
aggregates, and matching compares all pairs.
"""

from __future__ import annotations

# --- fixed values (results depend on them) -------------------------------------
_TITLE_PATTERNS = (
    (r"[:*_]in(nen)?\b", ""),
    (r"[(\[]\s*(all\s+gender|all\s+genders|alle\s+geschlechter)\s*[)\]]", " "),
    (r"[(\[]\s*(mwd|wmd|mfd|fmd|dmw|wdm|fmx|mwi|gn)\s*[)\]]", " "),
    (r"[(\[]?\s*[mwfdxign]\s*/\s*[mwfdxign]\s*(/\s*[mwfdxign]\s*)?[)\]]?", " "),
    (r"\(\s*\*\s*\)|\*", " "),
    (r"[^a-z0-9]+", " "),
)
_COMPANY_FORMS = ("gmbh  &&  co..  kg", "gmbh  &&  co  kg", "ag  &&  co..  kg", "ag  &&  co  kg", "co..  kg", "co  kg", "e..v..")
_COMPANY_WORDS = "'gmbh','mbh','ohg','gbr','kgaa','kg','gag','ag','se','ug','ev','gruppe','group','holding','deutschland','germany'"
_NAME_PATTERNS = (
    r"\ba/s\b", r"\baps\b", r"\bi/s\b", r"\bp/s\b", r"\bk/s\b", r"\bivs\b", r"\bamba\b", r"\ba\.m\.b\.a\.\b",
    r"\(vg\)", r"\(.*?\)", r"\bdanmark\b", r"\bdenmark\b", r"\bscandinavia\b", r"\bnordic\b", r"\bgroup\b",
    r"\bholding\b", r",\s*.*$",
)
_SPELLINGS = (("ø", "o"), ("æ", "ae"), ("å", "aa"), ("ö", "o"), ("ä", "ae"), ("ü", "u"))
# --- end of fixed values ---------------------------------------------------------

_POSTINGS = """
postings AS (
  SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_suppkey AS d, l_shipdate AS e, l_returnflag AS f,
    CASE l_linenumber WHEN 1 THEN 'stepstone' WHEN 2 THEN 'arbeitsagentur-search' WHEN 3 THEN ' linkedin '
      WHEN 4 THEN 'xing-search' WHEN 5 THEN 'indeed' WHEN 6 THEN 'freehire-search' WHEN 7 THEN 'monster' END AS portal,
    p_name || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ' (m/w/d)' WHEN 3 THEN '*' WHEN 4 THEN ' (gn)'
      WHEN 5 THEN ':in' WHEN 6 THEN ' (all genders)' WHEN 7 THEN ' m/w/d' END AS title,
    s_name || CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' AG' WHEN 3 THEN ' GmbH & Co. KG'
      ELSE ' Gruppe' END AS company,
    'https://jobs.example/' || l_partkey || '/' || l_suppkey || '/' || (l_orderkey % 10) AS url,
    'NATION_' || s_nationkey AS location, p_brand AS profile, CAST(l_shipdate AS DATE) AS day,
    CASE l_linenumber WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 1 THEN 6 ELSE 7 END AS rank,
    replace(lower(s_name), '#', ' ') AS c_norm, lower(p_name) AS t_norm
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT o_orderkey, 0, o_custkey, 0, o_orderdate, o_orderstatus, 'arbeitnow',
    CASE o_orderpriority WHEN '2-HIGH' THEN 'System/Network Engineer (m/w/d)'
      WHEN '3-MEDIUM' THEN 'Softwareentwickler für Großsysteme'
      WHEN '4-NOT SPECIFIED' THEN 'Ingénieur logiciel (all genders)'
      WHEN '5-LOW' THEN 'Da' || chr(173) || 'ta Engineer:in' END,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Kunde ' || o_custkey || ' GmbH & Co. KG' END,
    'https://board.example/' || o_orderkey, NULL, NULL, CAST(o_orderdate AS DATE), 1,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'kunde ' || o_custkey END,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'syste etwork engineer'
      WHEN '3-MEDIUM' THEN 'softwareentwickler fuer grosssysteme'
      WHEN '4-NOT SPECIFIED' THEN 'ingenieur logiciel'
      WHEN '5-LOW' THEN 'data engineer' ELSE '' END
  FROM orders
),
keyed AS MATERIALIZED (SELECT *, c_norm || '|' || t_norm AS k FROM postings)"""


def _winners(name: str, where: str = "true") -> str:
    """CTEs ``<name>`` (one row per key) and ``<name>_links`` (its other links)."""
    place = "{'rank': rank, 'a': a, 'b': b, 'c': c, 'd': d, 'e': e, 'f': f}"
    record = "{'title': title, 'company': company, 'location': location, 'profile': profile, 'day': \"day\"}"
    return f"""
{name}_pairs AS MATERIALIZED (SELECT k, portal, url, count(*) AS n, min(o) AS o, arg_min(r, o) AS r
    FROM (SELECT k, portal, url, {place} AS o, {record} AS r FROM keyed WHERE {where}) GROUP BY k, portal, url),
{name}_best AS MATERIALIZED (SELECT k, min(o) AS o, arg_min({{'portal': portal, 'url': url, 'r': r}}, o) AS w,
    CAST(sum(n) AS BIGINT) AS n_rows, count(*) - 1 AS n_alternates FROM {name}_pairs GROUP BY k),
{name} AS (SELECT k, w.portal AS portal, w.url AS url, w.r.title AS title, w.r.company AS company, w.r.location AS location,
    w.r.profile AS profile, w.r."day" AS "day", o.a AS a, n_rows, n_alternates FROM {name}_best),
{name}_links AS (SELECT p.k, p.portal, p.url, p.o, p.o.rank AS rank FROM {name}_pairs p JOIN {name}_best w ON p.k = w.k WHERE p.o <> w.o)"""


_POOL = f"WITH {_POSTINGS}, {_winners('win')}"
_SPLIT = (
    f"WITH {_POSTINGS}, {_winners('old', chr(34) + 'day' + chr(34) + ' < DATE ' + chr(39) + '1998-01-01' + chr(39))}, "
    f"{_winners('new', chr(34) + 'day' + chr(34) + ' >= DATE ' + chr(39) + '1998-01-01' + chr(39))}, "
    "stored AS (SELECT *, CASE WHEN portal = 'arbeitsagentur-search' THEN url ELSE k END AS stored_key FROM old)"
)
_NESTED = """places AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, portal, url) - 1 AS place FROM win_links),
nested AS (SELECT k, place // 1000 AS chunk_no, string_agg(portal || '@' || url, ' ' ORDER BY place) AS line,
    string_agg(portal, ', ' ORDER BY place) AS portals FROM places GROUP BY ALL)"""


def _escaped(x: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    )


# --- folded text ----------------------------------------------------------------------

_FOLDED = (
    "strip_accents(replace(replace(replace(replace(lower(translate(text, chr(173) || chr(8203), '')), "
    "'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'))"
)


def _title_norm(x: str) -> str:
    for pattern, put in _TITLE_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return f"trim({x})"


def _company_norm(x: str) -> str:
    """Whole-token removal without look-around: separators doubled, then tokens dropped."""
    x = f"regexp_replace(' ' || {x} || ' ', '([^a-z0-9])', '\\1\\1', 'g')"
    for form in _COMPANY_FORMS:
        x = "regexp_replace({}, '([^a-z0-9]){}([^a-z0-9])', '\\1\\2', 'g')".format(x, form.replace(".", r"\."))
    return f"array_to_string(list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda w: w NOT IN ({_COMPANY_WORDS})), ' ')"


# --- company names --------------------------------------------------------------------

def _noise(x: str) -> str:
    for pattern in _NAME_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def _ang(x: str) -> str:
    for src, dst in _SPELLINGS:
        x = f"replace({x}, '{src}', '{dst}')"
    return x


def _sides(name: str, column: str, source: str) -> str:
    clean = _noise(f"lower({column})")
    return f"""
{name}_n AS (SELECT *, regexp_replace({_noise(f'trim(lower({column}))')}, '[^a-zæøåöäü0-9]', '', 'g') AS norm,
    list_distinct(list_filter(regexp_extract_all({clean}, '[a-zæøåöäü0-9]+'), lambda w: length(w) > 1)) AS words FROM {source}),
{name} AS (SELECT *, {_ang('norm')} AS ang, list_distinct(list_transform(words, lambda w: {_ang('w')})) AS ang_words FROM {name}_n)"""


_SCORE = """CASE
  WHEN q.norm = '' OR n.norm = '' THEN 0
  WHEN q.norm = n.norm THEN 100
  WHEN contains(n.norm, q.norm) AND (NOT (length(q.norm) <= 4 AND 2 * length(q.norm) < length(n.norm)) OR list_has_any(q.words, n.words))
    THEN 80 + floor(10 * length(q.norm) / length(n.norm))
  WHEN contains(q.norm, n.norm) AND NOT (length(n.norm) <= 4 AND 2 * length(n.norm) < length(q.norm))
    THEN 80 + floor(10 * length(n.norm) / length(q.norm))
  WHEN q.ang = n.ang THEN 85
  WHEN (contains(n.ang, q.ang) OR contains(q.ang, n.ang)) AND (NOT (least(length(q.ang), length(n.ang)) <= 4
      AND 2 * least(length(q.ang), length(n.ang)) < greatest(length(q.ang), length(n.ang))) OR list_has_any(q.ang_words, n.ang_words)) THEN 75
  WHEN len(q.words) = 0 OR len(n.words) = 0 THEN 0
  WHEN NOT list_has_any(q.words, n.words) AND NOT list_has_any(q.ang_words, n.ang_words) THEN 0
  WHEN len(q.words) = 1 THEN 70
  ELSE floor(30 + (CASE WHEN list_has_any(q.words, n.words) THEN len(list_intersect(q.words, n.words))
      ELSE len(list_intersect(q.ang_words, n.ang_words)) END)::DOUBLE / len(q.words) * 40) END"""

_COMPANIES = """
companies AS (SELECT c_custkey AS ord,
    array_to_string(list_transform(string_split(CASE WHEN c_custkey % 3 = 0 THEN replace(replace(p_name, 'o', 'ø'), 'ae', 'æ') ELSE p_name END, ' '),
      lambda w: upper(w[1]) || w[2:]), ' ')
    || CASE WHEN c_custkey % 4 = 1 THEN '' ELSE ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END
    || CASE c_custkey % 5 WHEN 0 THEN ' A/S' WHEN 1 THEN ' Danmark ApS' WHEN 2 THEN '' WHEN 3 THEN ' (VG) Holding' ELSE ', Nordic branch' END AS company,
    CASE WHEN c_custkey % 7 <> 0 THEN 'København ' || c_nationkey END AS city
  FROM customer JOIN part ON c_custkey = p_partkey)"""
_QUERIES = """
searches AS (SELECT s_suppkey AS query_id,
    CASE s_suppkey % 5 WHEN 0 THEN p_name || ' machinery A/S' WHEN 1 THEN string_split(p_name, ' ')[2] WHEN 2 THEN p_name[1:3]
      WHEN 3 THEN upper(p_name) || ' Household Gruppe' ELSE p_name END AS query,
    CASE WHEN s_suppkey % 4 = 0 THEN 'kobenhavn ' || s_nationkey END AS city
  FROM supplier JOIN part ON s_suppkey = p_partkey)"""
_MATCHED = f"""WITH {_COMPANIES}, {_QUERIES}, {_sides('n', 'company', 'companies')}, {_sides('q', 'query', 'searches')},
matched AS (SELECT query_id, ord, company, CAST({_SCORE} AS INTEGER) AS score FROM q, n
  WHERE q.city IS NULL OR contains({_ang("lower(coalesce(n.city, ''))")}, q.city))"""

# --- profiles ---------------------------------------------------------------------------

_BRANDS = """
brands AS (SELECT p_brand AS id, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n, min(split_part(p_name, ' ', 1)) AS low,
    max(split_part(p_name, ' ', 2)) AS high, min(split_part(p_name, ' ', 2)) AS other FROM part GROUP BY p_brand)"""
_FLAGGED = f"""WITH {_POSTINGS}, {_BRANDS},
flagged AS (SELECT k.*, NOT (coalesce(n, 0) % 3 <> 0 AND contains(t_norm, coalesce(low, '')))
    AND (n IS NULL OR n % 2 <> 0 OR contains(t_norm, high) OR contains(t_norm, other)) AS keep
  FROM keyed k LEFT JOIN brands ON profile = id)"""
_REPORT = f"""{_FLAGGED},
listed AS (SELECT id, n FROM brands UNION ALL SELECT 'orders board', 3),
counts AS (SELECT coalesce(profile, 'orders board') AS profile, portal, count(*) AS n, count(*) FILTER (WHERE keep) AS kept FROM flagged GROUP BY ALL),
boards AS (SELECT DISTINCT portal FROM counts UNION ALL SELECT 'jobindex'),
report AS (
  SELECT id AS profile, b.portal,
    CASE WHEN b.portal = 'jobindex' THEN 'missing' WHEN b.portal = 'monster' THEN 'disabled'
      WHEN c.n IS NULL OR c.n % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN b.portal = 'jobindex' THEN 'not installed' WHEN b.portal = 'monster' THEN NULL
      WHEN c.n IS NULL THEN 'no result landed' WHEN c.n % 5 = 0 THEN 'timed out after 120s' END AS detail,
    CASE WHEN b.portal <> 'monster' AND c.n % 5 <> 0 THEN c.n END AS returned,
    CASE WHEN b.portal <> 'monster' AND c.n % 5 <> 0 THEN c.kept END AS kept
  FROM listed CROSS JOIN boards b LEFT JOIN counts c ON c.profile = id AND c.portal = b.portal WHERE listed.n % 5 <> 4
  UNION ALL SELECT id, NULL, 'disabled', NULL, NULL, NULL FROM listed WHERE n % 5 = 4)"""
_FANOUT = """
lists AS (SELECT *, CASE c_custkey % 6 WHEN 1 THEN ['arbeitsagentur-search', 'stepstone-search', 'xing-search']
    WHEN 2 THEN ['arbeitsagentur-search'] WHEN 3 THEN ['stepstone-search', 'freehire-search', 'xing-search']
    WHEN 4 THEN ['linkedin-search'] ELSE ['arbeitsagentur-search', 'stepstone-search'] END AS portals FROM customer),
pairs AS (SELECT l.*, portals[i] AS portal, CAST(i - 1 AS INTEGER) AS place FROM lists l, range(1, 4) r(i) WHERE i <= len(portals))"""

# --- sheets and data sets ------------------------------------------------------------------

_SHEET = """
sheet AS (SELECT 'sheet_' || c_nationkey AS sheet, CAST(c_custkey + 10 AS INTEGER) AS "row", c_name, c_mktsegment, c_acctbal,
    c_custkey AS k, c_nationkey % 3 AS shape FROM customer)"""

_HOLDERS = """
lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
docs AS (SELECT d.doc_id, d.source, d.lang, q, t FROM documents d LEFT JOIN lab USING (doc_id)),
both_sides AS (
  SELECT source AS company, 'ROLE ' || (doc_id % 10) AS role, doc_id, lang, CASE WHEN q = 1 THEN 'recorded' ELSE 'inferred' END AS provenance,
    (100.0 - (60 + coalesce(t, 0) * 20)) / 100 AS weight, 'tracked' AS source FROM docs WHERE doc_id % 3 = 0
  UNION ALL
  SELECT source, 'Role ' || (doc_id % 10), doc_id, lang, 'recorded', 0.4, 'ranked' FROM docs WHERE q = 1),
holders AS (SELECT *, row_number() OVER (PARTITION BY lower(company), lower(role)
    ORDER BY provenance DESC, source DESC, company, role, 'Skill ' || (doc_id % 13) || chr(1) || upper(lang), weight) AS rn FROM both_sides QUALIFY rn = 1)"""

_BENCH = """
g AS (SELECT c_nationkey, lower(c_mktsegment) AS seg, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY ALL),
b AS (SELECT 'NATION_' || c_nationkey AS company, seg, n, CASE WHEN n % 5 <> 0 THEN n END AS cnt,
    CASE WHEN n % 7 NOT IN (0, 1) THEN round(m / (SELECT avg(c_acctbal) FROM customer) * 100, 4) END AS idx
  FROM g WHERE n % 5 <> 0 OR n % 7 <> 1)"""

_OUTCOMES = """
notes AS (SELECT 'firm_' || conv_id || '_' || turn AS application, (conv_id + turn) AS n, turn FROM conversations),
outcomes AS (SELECT *, CASE n % 7 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'hired' WHEN 2 THEN 'offer_declined' WHEN 3 THEN 'rejected'
    WHEN 4 THEN 'no_response' WHEN 5 THEN 'interview_only' END AS status FROM notes)"""

ORACLES: dict[str, str] = {
    "dedup_pool": f"""{_POOL} SELECT k AS dedup_key, portal, title, company, url, location, n_rows, n_alternates FROM win""",
    "also_on_links": f"""{_POOL} SELECT k AS dedup_key, portal, url, rank FROM win_links""",
    "also_on_nested": f"""{_POOL}, {_NESTED} SELECT win.k AS dedup_key, CAST(coalesce(chunk_no, 0) AS INTEGER) AS chunk_no, line AS also_on
        FROM win LEFT JOIN nested ON win.k = nested.k""",
    "pool_stats": f"""WITH {_POSTINGS}, s AS (SELECT count(*) AS i, count(DISTINCT k) AS u FROM keyed)
        SELECT i AS input_records, u AS unique_jobs, i - u AS duplicates_collapsed, round_even(100.0 * (i - u) / i, 1)::DOUBLE AS redundancy_pct FROM s""",
    "strict_title_keys": f"""WITH {_POSTINGS} SELECT replace(k, 'syste etwork', 'system network') AS dedup_key, count(*) AS n FROM keyed GROUP BY 1""",
    "portal_priority": f"""WITH {_POSTINGS} SELECT portal, count(*) AS n, max(rank) AS rank FROM keyed GROUP BY portal""",
    "new_postings": f"""{_SPLIT} SELECT k AS dedup_key, portal, title, company, url FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k = new.k)""",
    "already_seen": f"""{_SPLIT} SELECT k AS dedup_key, portal, title, company, url FROM new SEMI JOIN old USING (k)""",
    "run_stats": f"""{_SPLIT}, s AS (SELECT CAST(sum(n_rows) AS BIGINT) AS i, count(*) AS u, count(*) FILTER (WHERE k IN (SELECT k FROM old)) AS seen FROM new)
        SELECT i AS input_records, u AS unique_jobs, u - seen AS "new", seen AS already_seen, i - u AS duplicates_collapsed,
          round_even(100.0 * (i - u) / i, 1)::DOUBLE AS redundancy_pct FROM s""",
    "seen_merge": f"""{_SPLIT} SELECT stored_key, title, company, url, '1997-12-31' AS first_seen, NULL::VARCHAR AS fit, 'new' AS status, portal FROM stored
        UNION ALL SELECT k, title, company, url, '1998-01-01', NULL, 'new', portal FROM new ANTI JOIN stored ON new.k = stored.stored_key""",
    "seen_merge_links": f"""{_SPLIT} SELECT k AS stored_key, portal, url FROM old_links UNION SELECT k, portal, url FROM new_links""",
    "rank_writeback": """WITH s AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id)
        SELECT CAST(d.doc_id AS VARCHAR) AS stored_key, CASE WHEN q IS NULL THEN 'new' ELSE 'ranked' END AS status,
          CAST(40 + q * 50 - t * 20 AS INTEGER) AS rank_score, CASE q WHEN 1 THEN 'apply' WHEN 0 THEN 'skip' END AS rank_verdict,
          CASE WHEN q IS NOT NULL THEN 'clear text' END AS strengths,
          CASE WHEN q = 0 THEN 'new gap,tone' WHEN q IS NULL AND d.doc_id % 2 = 0 THEN 'old gap' END AS gaps
        FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "seen_import": f"""{_POOL} SELECT k AS stored_key, title, company, url, '1997-12-31' AS first_seen,
        CASE n_rows % 3 WHEN 0 THEN '"strong"' WHEN 2 THEN '"7"' END AS fit, portal, CAST(n_rows AS INTEGER) AS rank_score, 1 AS n_also_on, url AS also_url FROM win""",
    "title_filters": f"""{_FLAGGED} SELECT profile, title, portal, count(*) AS n, count(*) FILTER (WHERE keep) AS kept FROM flagged GROUP BY ALL""",
    "literal_title_filters": f"""WITH {_POSTINGS} SELECT title, count(*) AS n FROM keyed WHERE NOT contains(t_norm, 'red') AND NOT contains(t_norm, 'grosssysteme')
        AND (contains(t_norm, 'ring') OR contains(t_norm, 'software entwickler') OR contains(t_norm, 'softwareentwickler') OR contains(t_norm, 'engineer')) GROUP BY title""",
    "run_report": f"""{_REPORT} SELECT * FROM report""",
    "problems": f"""{_REPORT} SELECT profile, portal, coalesce(detail, status) AS reason FROM report WHERE status IN ('failed', 'missing')""",
    "portal_fanout": f"""WITH {_FANOUT} SELECT c_name AS profile, portal, place FROM pairs""",
    "request_params": f"""WITH {_FANOUT},
        asked AS (SELECT *, CASE WHEN c_custkey % 4 <> 3 THEN 'NATION_' || c_nationkey END AS loc FROM pairs),
        flags AS (
          SELECT c_custkey AS id, portal, '--query' AS flag, c_mktsegment AS "value" FROM asked
          UNION ALL SELECT c_custkey, portal, '--jobage', CASE WHEN c_custkey % 5 = 0 THEN '1' ELSE '7' END FROM asked
          UNION ALL SELECT c_custkey, portal, '--limit', CASE WHEN portal = 'linkedin-search' AND c_custkey % 3 = 2 THEN '5' ELSE '25' END FROM asked
          UNION ALL SELECT c_custkey, portal, '--location', loc FROM asked WHERE loc IS NOT NULL AND portal <> 'freehire-search'
            AND NOT (portal = 'arbeitsagentur-search' AND c_custkey % 3 = 2)
          UNION ALL SELECT c_custkey, portal, '--city', CASE WHEN c_custkey % 3 = 1 THEN 'Munich' ELSE loc END FROM asked
            WHERE portal = 'freehire-search' AND (loc IS NOT NULL OR c_custkey % 3 = 1)
          UNION ALL SELECT c_custkey, portal, '--country', CASE WHEN c_custkey % 3 = 1 THEN 'DE' ELSE 'AT' END FROM asked WHERE portal = 'freehire-search'
          UNION ALL SELECT c_custkey, portal, '--lang', 'de' FROM asked WHERE portal = 'freehire-search'
          UNION ALL SELECT c_custkey, portal, '--remote', NULL FROM asked WHERE portal = 'xing-search' AND c_custkey % 3 = 1
          UNION ALL SELECT c_custkey, portal, '--radius', '30' FROM asked WHERE portal = 'xing-search' AND c_custkey % 3 = 1)
        SELECT c_name AS profile, a.portal, CASE WHEN a.portal = 'linkedin-search' AND loc IS NULL
          THEN 'profile ''' || c_name || ''': linkedin-search requires a location' END AS problem, flag, "value"
        FROM asked a JOIN flags f ON f.id = c_custkey AND f.portal = a.portal""",
    "profile_checks": """WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'twin-' || (c_custkey // 20) ELSE c_name END AS id FROM customer)
        SELECT id, 'error' AS severity, 'every profile needs an ''id''' AS message FROM p WHERE id = ''
        UNION ALL SELECT id, 'error', 'profile ''' || id || ''' needs a ''query'' or a ''location''' FROM p WHERE k % 20 = 12
        UNION ALL SELECT id, 'warning', 'profile ''' || id || ''' has a term that matches every title' FROM p WHERE k % 10 = 3
        UNION ALL SELECT id, 'error', 'duplicate profile id ''' || id || '''' FROM p WHERE id <> '' GROUP BY id HAVING count(*) > 1""",
    "history_upsert": f"""{_SPLIT}, both_loads AS (
          SELECT *, 'new' AS status FROM new UNION ALL SELECT *, 'old' FROM old ANTI JOIN new USING (k))
        SELECT k AS dedup_key, title, company, url, portal, strftime("day", '%Y-%m-%d') AS first_seen, status,
          CASE WHEN n_rows % 2 = 0 THEN '{{"score":' || n_rows || '}}' END AS fit, NULL::VARCHAR AS also_on, CAST(0 AS INTEGER) AS chunk_no FROM both_loads""",
    "recent_7d": f"""{_POOL} SELECT company, title, strftime("day", '%Y-%m-%d') AS first_seen, k AS dedup_key FROM win WHERE "day" >= DATE '2001-10-24'""",
    "per_portal": f"""{_POOL} SELECT portal, count(*) AS n FROM win GROUP BY portal""",
    "top_employers": f"""{_POOL} SELECT company, count(*) AS n FROM win GROUP BY company ORDER BY n DESC, company NULLS FIRST LIMIT 10""",
    "newest_first": f"""{_POOL} SELECT k AS stored_key, strftime("day", '%Y-%m-%d') AS first_seen, company FROM win ORDER BY "day" DESC, k LIMIT 25""",
    "shortlist": f"""{_POOL} SELECT k AS stored_key, strftime("day", '%Y-%m-%d') AS first_seen, portal FROM win WHERE portal <> 'indeed' ORDER BY "day" DESC, k LIMIT 25""",
    "request_cap": f"""WITH {_POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile, portal ORDER BY a, b, c, d, e, f) AS place
          FROM keyed WHERE "day" >= DATE '2001-10-24')
        SELECT profile, portal, CAST(place AS INTEGER) AS place, title, company, url FROM r WHERE place <= 25""",
    "digest_groups": f"""{_POOL} SELECT coalesce(profile, 'unassigned') AS profile, count(*) AS jobs, min(a) AS first_order FROM win GROUP BY 1""",
    "digest_rows": f"""{_POOL}, {_NESTED} SELECT win.k AS dedup_key, CAST(coalesce(chunk_no, 0) AS INTEGER) AS chunk_no,
          coalesce(profile, 'unassigned') AS profile, {_escaped('url')} AS url, 'also on ' || portals AS also_note,
          '  - ' || {_escaped("coalesce(title, '(untitled)')")} || ' — ' || {_escaped("coalesce(company, '—')")} || ' — '
            || coalesce(location, '—') || ' [' || portal || ']' AS line
        FROM win LEFT JOIN nested ON win.k = nested.k""",
    "html_escape": f"""SELECT page_id, {_escaped('html')} AS escaped, {_escaped('url')} AS link FROM pages""",
    "source_health": """SELECT 'board-' || (user_id % 50) AS portal, count(*) AS runs,
          count(*) FILTER (WHERE event_type = 'view' OR (event_type IN ('click', 'purchase') AND floor("value") = 0)) AS silent,
          count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS broken,
          CAST(CAST(max(ts) FILTER (WHERE event_type IN ('click', 'purchase') AND floor("value") > 0) AS DATE) AS VARCHAR) AS last_result
        FROM events GROUP BY 1""",
    "normalize_text": f"""SELECT doc_id, {_title_norm(_FOLDED)} AS title_norm FROM documents""",
    "normalize_company_text": f"""SELECT doc_id, {_company_norm(_FOLDED)} AS company_norm FROM documents""",
    "text_layer_check": r"""WITH f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat, n_chars // 3000 AS pages FROM documents)
        SELECT doc_id, CASE WHEN pages <> 0 THEN 'expected 0 page(s), found ' || pages
            WHEN length(flat) < 400 THEN 'text layer has ' || length(flat) || ' character(s); expected at least 400'
            WHEN NOT contains(flat, 'the') THEN 'text layer is missing required text: ''the'''
            WHEN NOT contains(flat, 'and') THEN 'text layer is missing required text: '' and   ''' END AS failure,
          CAST(length(flat) AS INTEGER) AS n_flat FROM f""",
    "sql_functions": f"""WITH {_POSTINGS} SELECT k AS dedup_key, count(*) AS n,
        CASE WHEN k LIKE 'supplier%' THEN 70 ELSE 0 END AS best FROM keyed GROUP BY k""",
    "company_search": f"""WITH {_COMPANIES}, one AS (SELECT 'Red Bolt Machinery A/S' AS query), {_sides('n', 'company', 'companies')},
        {_sides('q', 'query', 'one')}, m AS (SELECT ord, company, city, CAST({_SCORE} AS INTEGER) AS score FROM q, n
          WHERE contains({_ang("lower(coalesce(city, ''))")}, 'kobenhavn 1'))
        SELECT * FROM m WHERE score >= 30""",
    "company_match": f"""{_MATCHED} SELECT query_id, ord, company, score FROM matched WHERE score >= 30
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, company, ord) <= 10""",
    "company_top3": f"""{_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, company, ord) AS place
        FROM matched WHERE score >= 30) SELECT query_id, CAST(place AS INTEGER) AS place, ord, score FROM r WHERE place <= 3""",
    "company_counts": f"""{_MATCHED} SELECT query_id, count(*) AS n, max(score) AS best, count(*) FILTER (WHERE score <= 70) AS n_by_words
        FROM matched WHERE score >= 30 GROUP BY query_id""",
    "company_ranking": f"""{_MATCHED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, company, ord) AS place, ord, score
        FROM matched WHERE score >= 75""",
    "salary_benchmark": f"""WITH {_BENCH} SELECT company, upper(seg[1]) || seg[2:] AS label, coalesce(CAST(cnt AS VARCHAR), '-') AS count_shown,
          CASE WHEN idx IS NOT NULL THEN printf('%.1f', idx) WHEN n % 7 = 0 THEN 'withheld' ELSE 'N/A*' END AS index_shown,
          round(idx - 100, 4) AS diff_pct, CASE WHEN idx IS NULL THEN 'none' WHEN idx >= 100 THEN 'above' ELSE 'below' END AS side FROM b""",
    "salary_dataset": f"""WITH {_BENCH} SELECT company, seg AS category, round((idx - 80) / 80 * 100, 4) AS diff_pct, 'Index 80 = baseline' AS note FROM b""",
    "sheet_layouts": """WITH s AS (SELECT 'sheet_' || n_nationkey AS sheet, n_nationkey % 3 AS shape FROM nation),
        plan(shape, company_col, city_col, category, count_col, index_col) AS (VALUES
          (0, 0, 1, 'kvinder', 2, 3), (0, 0, 1, 'salary_index', NULL, 4),
          (1, 1, NULL, 'antal', 0, NULL), (1, 1, NULL, 'lønindeks', NULL, 2), (1, 1, NULL, 'notes', NULL, 3),
          (2, 0, NULL, 'it_support', 2, 1))
        SELECT sheet, 3 AS header_row, company_col, city_col, category, count_col, index_col FROM s JOIN plan USING (shape)""",
    "sheet_reshape": f"""WITH {_SHEET}
        SELECT sheet, "row", c_name AS company, c_mktsegment AS city, 'kvinder' AS category, k % 40 AS count, round(c_acctbal, 2) AS index FROM sheet WHERE shape = 0 AND k % 11 <> 0
        UNION ALL SELECT sheet, "row", c_name, '', 'antal', k % 50, NULL FROM sheet WHERE shape = 1
        UNION ALL SELECT sheet, "row", c_name, '', 'lønindeks', NULL, round(c_acctbal, 2) FROM sheet WHERE shape = 1
        UNION ALL SELECT sheet, "row", c_name, '', 'it_support', CASE WHEN k % 2 = 0 THEN k END, 1000.5 + k % 1000 FROM sheet WHERE shape = 2""",
    "parse_numbers": """SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN round(o_totalprice, 2)
          WHEN 2 THEN (o_orderkey % 900 + 1) * 1000 + 250.75 WHEN 5 THEN (o_orderkey % 900 + 1) * 1000 WHEN 7 THEN (o_orderkey % 90) * 100 END AS DOUBLE) AS number FROM orders""",
    "validate_issues": """WITH e AS (SELECT c_custkey AS k, c_custkey + 1 AS pos, 'companies[' || (c_custkey + 1) || ']' AS p FROM customer),
        twins AS (SELECT *, min(pos) OVER (PARTITION BY k // 100) AS first_pos FROM e WHERE k % 8 = 7)
        SELECT 'error' AS severity, pos, p AS path, p || ' must be an object' AS message FROM e WHERE k % 8 = 1
        UNION ALL SELECT 'error', pos, p || '.company', p || '.company must be a non-empty string' FROM e WHERE k % 8 = 2
        UNION ALL SELECT 'error', pos, p || '.city', p || '.city must be a string when provided' FROM e WHERE k % 8 = 3
        UNION ALL SELECT 'error', pos, p || '.categories', p || '.categories must be an object when provided' FROM e WHERE k % 8 = 4
        UNION ALL SELECT 'error', pos, p || '.categories.a', p || '.categories.a must be an object with ''count'' and/or ''index'' (got int)' FROM e WHERE k % 8 = 5
        UNION ALL SELECT 'error', pos, p || '.categories.b.count', p || '.categories.b.count must be a number (got str)' FROM e WHERE k % 8 = 5
        UNION ALL SELECT 'error', pos, p || '.categories.b.index', p || '.categories.b.index must be a number or string (got dict)' FROM e WHERE k % 8 = 5
        UNION ALL SELECT 'warning', pos, p || '.company', 'Duplicate company name ''Customer Twin ' || (k // 100) || ''' (companies[' || first_pos || '] and ' || p || ')'
          FROM twins WHERE pos > first_pos""",
    "dataset_import": """SELECT c_custkey + 1 AS pos, c_name AS company, 'C D' AS label, '4' AS count_shown, 'n/a' AS index_shown, NULL::DOUBLE AS diff_pct FROM customer WHERE c_custkey % 8 = 6
        UNION ALL SELECT c_custkey + 1, 'Customer Twin ' || (c_custkey // 100), 'E', '-', '110.5', 10.5 FROM customer WHERE c_custkey % 8 = 7""",
    "dup_names": """WITH n AS (SELECT p_partkey + 1 AS pos, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS company FROM part)
        SELECT pos, company, first_pos FROM (SELECT *, first_value(pos) OVER (PARTITION BY lower(company) ORDER BY pos) AS first_pos FROM n) WHERE pos > first_pos""",
    "envelope_parse": """WITH r AS (SELECT l_orderkey AS o, l_linenumber AS t, l_partkey AS c, l_suppkey AS u,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS nth FROM lineitem)
        SELECT o AS order_no, CAST(nth + CASE WHEN o % 6 = 2 THEN 3 ELSE 0 END AS INTEGER) AS pos,
          CASE WHEN t = 2 THEN 'own-board' ELSE 'board-' || (o % 4) END AS portal, 'board-' || (o % 4) AS asked_portal,
          CAST(t AS VARCHAR) AS title, CAST(c AS VARCHAR) AS company, CAST(u AS VARCHAR) AS url FROM r WHERE o % 6 < 4""",
    "result_files": """WITH r AS (SELECT l_orderkey // 400 AS d, l_linenumber AS t, l_partkey AS c, l_suppkey AS u,
            row_number() OVER (PARTITION BY l_orderkey // 400 ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS nth FROM lineitem)
        SELECT CAST(nth + CASE WHEN d % 6 = 2 THEN 3 ELSE 0 END AS INTEGER) AS pos, CASE WHEN t = 2 THEN 'own-board' ELSE 'board-' || (d % 4) END AS portal,
          'board-' || (d % 4) AS asked_portal, CAST(t AS VARCHAR) AS title, CAST(c AS VARCHAR) AS company, CAST(u AS VARCHAR) AS url FROM r WHERE d % 6 < 4""",
    "posting_files": """SELECT 'Firm ' || (item_id % 7) AS company, 'Engineer - Line ' || item_id AS title, text || chr(10) AS text FROM benchmark""",
    "outcome_files": """SELECT 'firm_' || s_suppkey AS application,
          (['in_progress', 'hired', 'offer_declined', 'rejected', 'no_response', 'interview_only'])[CAST(s_suppkey % 7 + 1 AS INTEGER)] AS status,
          s_suppkey % 7 = 6 AS status_unknown, '2025-0' || (s_suppkey % 9 + 1) || '-11' AS date_resolved,
          array_to_string((['Phone screen', 'Technical interview', 'Case interview', 'Final round', 'Offer received'])[1:CAST(s_suppkey % 6 AS INTEGER)], ',') AS stages
        FROM supplier""",
    "sheet_files": """WITH c AS (SELECT *, c_custkey AS k, 'sheet_' || c_nationkey || '_' || (c_custkey // 1000) AS sheet FROM customer)
        SELECT DISTINCT sheet, 1 AS "row", 'Company|City "of" seat|Text' AS cells FROM c
        UNION ALL SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY k) + 1 AS INTEGER),
          CASE k % 5 WHEN 0 THEN c_name WHEN 1 THEN '5" pipe ' || k WHEN 2 THEN 'say "hi"' || chr(10) || k WHEN 3 THEN 'a, ' || k ELSE '~' END
          || '|' || c_mktsegment || '|' || CASE k % 3 WHEN 0 THEN '6" rod' WHEN 1 THEN 'xtail' || k ELSE '~' END FROM c""",
    "posting_names": """SELECT 'Firm ' || (item_id % 7) AS company, 'Engineer - Line ' || item_id AS title, text FROM benchmark""",
    "outcome_documents": f"""WITH {_OUTCOMES} SELECT application, status, status IS NULL AS status_unknown, '2025-0' || (n % 9 + 1) || '-11' AS date_resolved,
        array_to_string((['Phone screen', 'Technical interview', 'Case interview', 'Final round', 'Offer received'])[1:turn + 1], ',') AS stages FROM outcomes""",
    "outcome_funnel": f"""WITH {_OUTCOMES} SELECT status, count(*) AS applications, count(*) FILTER (WHERE turn >= 0) AS phone_screen,
          count(*) FILTER (WHERE turn >= 1) AS technical_interview, count(*) FILTER (WHERE turn >= 2) AS case_interview,
          count(*) FILTER (WHERE turn >= 3) AS final_round, count(*) FILTER (WHERE turn >= 4) AS offer_received
        FROM outcomes WHERE status <> 'in_progress' GROUP BY status""",
    "gap_sources": f"""WITH {_HOLDERS} SELECT lower(company) AS company, lower(role) AS role, source, provenance, round(weight, 4)::DOUBLE AS weight FROM holders""",
    "skill_gaps": f"""WITH {_HOLDERS}, s AS (SELECT 'skill ' || (doc_id % 13) AS skill, weight, provenance FROM holders
          UNION ALL SELECT lower(lang), weight, provenance FROM holders)
        SELECT skill, round(sum(weight), 4)::DOUBLE AS weight, count(*) AS holders, CAST(bool_or(provenance = 'recorded') AS INTEGER) AS recorded,
          CAST(bool_or(provenance = 'inferred') AS INTEGER) AS inferred FROM s GROUP BY skill""",
    "gap_header": f"""WITH {_HOLDERS}, c AS (SELECT count(*) FILTER (WHERE source = 'tracked') AS tracked, count(*) FILTER (WHERE source = 'ranked') AS ranked FROM holders)
        SELECT tracked, ranked, tracked || ' tracked, ' || ranked || ' ranked' AS header FROM c""",
    "followups": """WITH a AS (SELECT user_id, DATE '2024-02-10' - CAST(max(ts) AS DATE) AS days, count(*) FILTER (WHERE event_type = 'error') AS sent FROM events GROUP BY user_id)
        SELECT user_id, CAST(days AS INTEGER) AS days_quiet, days >= 10 AND sent < 2 AS nudge_due, days >= 30 AS stale FROM a""",
    "write_roundtrip": f"""{_POOL} SELECT CASE length(k) % 3 WHEN 1 THEN '2025-01-31' ELSE '2025-02-10' END AS "day", count(*) AS postings,
        CAST(sum(n_rows) AS BIGINT) AS records FROM win WHERE length(k) % 3 <> 0 GROUP BY 1""",
    "incremental_stream": """WITH e AS (SELECT *, CAST(least(hour(ts) // 8, 2) AS INTEGER) AS wave FROM events),
        f AS (SELECT *, min(wave) OVER (PARTITION BY user_id, event_type) AS first_wave FROM e),
        g AS (SELECT user_id, event_type, wave, min(event_id) AS event_id, count(*) AS n_rows FROM f WHERE wave = first_wave GROUP BY ALL)
        SELECT 'user ' || user_id || '|' || event_type AS dedup_key, event_type AS title, 'User ' || user_id AS company, wave, event_id, n_rows FROM g""",
}
