"""The normalizations and the match score as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from feedloom.functions import names, text


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(start: str, steps: list[tuple[str, str]]) -> str:
    for pattern, put in steps:
        start = f"regexp_replace({start}, {_quote(pattern)}, {_quote(put)})"
    return start


def _functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, expression)."""
    matching, replacement, char_class, many = text._fold_tables()
    lowered = "lower(s)"
    for src, dst in text.UMLAUTS:
        lowered = f"replace({lowered}, {_quote(src)}, {_quote(dst)})"
    letters = f"translate({lowered}, {_quote(matching)}, {_quote(replacement)})"
    table = f"from_json({_quote(many)}, 'map<string,string>')"
    spelled = f"array_join(transform(split(s, ''), x -> coalesce(try_element_at({table}, x), x)), '')"
    markers = [("(?U)" + p, put) for p, put in (
        (text.GENDER_SUFFIX, ""), (text.GENDER_WORDED, " "), (text.GENDER_SLASHLESS, " "),
        (text.GENDER_SLASHED, " "), (text.GENDER_STAR, " "))]
    forms = [(p, " ") for p in text._legal_form_passes()[2]]
    noise = [("(?U)" + p, "") for p in names.NOISE_PATTERNS]
    angl = "lower(s)"
    for src, dst in names.SPELLING_VARIANTS:
        angl = f"replace({angl}, {_quote(src)}, {_quote(dst)})"
    short = "(length({a}) <= 4 AND length({a}) / length({b}) < 0.5)"
    touch = "(contains(n.ang, q.ang) OR contains(q.ang, n.ang))"
    ang_short = "(least(length(q.ang), length(n.ang)) <= 4 AND least(length(q.ang), length(n.ang)) / greatest(length(q.ang), length(n.ang)) < 0.5)"
    meet = "arrays_overlap(q.words, n.words)"
    parts = "STRUCT<norm: STRING, ang: STRING, words: ARRAY<STRING>, ang_words: ARRAY<STRING>>"
    return {
        "feed_letters": ("s STRING", "STRING", f"CASE WHEN octet_length(s) = length(s) THEN lower(s) ELSE {letters} END"),
        "feed_ligatures": ("s STRING", "STRING",
                           f"CASE WHEN octet_length(s) <> length(s) AND s RLIKE {_quote(char_class)} THEN {spelled} ELSE s END"),
        "feed_fold": ("s STRING", "STRING", "feed_ligatures(feed_letters(s))"),
        "feed_collapse": ("s STRING", "STRING", "trim(regexp_replace(s, '[^a-z0-9]+', ' '))"),
        "feed_title": ("s STRING", "STRING", f"feed_collapse({_chain('feed_fold(coalesce(s, ' + _quote('') + '))', markers)})"),
        "feed_company": ("s STRING", "STRING", f"feed_collapse({_chain('feed_fold(coalesce(s, ' + _quote('') + '))', forms)})"),
        "feed_key": ("company STRING, title STRING", "STRING", "concat(feed_company(company), '|', feed_title(title))"),
        "feed_anglicize": ("s STRING", "STRING", angl),
        "feed_name": ("s STRING", "STRING",
                      f"regexp_replace({_chain('trim(lower(s))', noise)}, {_quote('[^' + names.WORD + ']')}, '')"),
        "feed_words": ("s STRING", "ARRAY<STRING>",
                       f"array_distinct(filter(regexp_extract_all({_chain('lower(s)', noise)}, {_quote('([' + names.WORD + ']+)')}, 1), w -> length(w) > 1))"),
        "feed_parts": ("s STRING", parts,
                       "named_struct('norm', feed_name(s), 'ang', feed_anglicize(feed_name(s)), 'words', feed_words(s), "
                       "'ang_words', array_distinct(transform(feed_words(s), w -> " + angl.replace("(s)", "(w)") + ")))"),
        "feed_score_parts": (f"q {parts}, n {parts}", "INT", f"""
            CASE WHEN q.norm = '' OR n.norm = '' THEN 0
                 WHEN q.norm = n.norm THEN 100
                 WHEN contains(n.norm, q.norm) AND (NOT {short.format(a='q.norm', b='n.norm')} OR {meet})
                      THEN 80 + cast(length(q.norm) / length(n.norm) * 10 AS INT)
                 WHEN contains(q.norm, n.norm) AND NOT {short.format(a='n.norm', b='q.norm')}
                      THEN 80 + cast(length(n.norm) / length(q.norm) * 10 AS INT)
                 WHEN q.ang = n.ang THEN 85
                 WHEN {touch} AND (NOT {ang_short} OR arrays_overlap(q.ang_words, n.ang_words)) THEN 75
                 WHEN size(q.words) = 0 OR size(n.words) = 0 THEN 0
                 WHEN NOT {meet} AND NOT arrays_overlap(q.ang_words, n.ang_words) THEN 0
                 WHEN size(q.words) = 1 THEN 70
                 ELSE cast(30 + (CASE WHEN {meet} THEN size(array_intersect(q.words, n.words))
                                      ELSE size(array_intersect(q.ang_words, n.ang_words)) END) / size(q.words) * 40 AS INT)
            END"""),
        "feed_score": ("query STRING, name STRING", "INT", "feed_score_parts(feed_parts(coalesce(query, '')), feed_parts(coalesce(name, '')))"),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names.

    ``feed_title``, ``feed_company``, ``feed_key`` and ``feed_score`` are the ones to call;
    the others are their parts.
    """
    made = []
    for name, (params, kind, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        made.append(name)
    return made
