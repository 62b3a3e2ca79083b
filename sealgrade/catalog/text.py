"""Text preparation and feature detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealgrade import vocab as V
from sealgrade.catalog.common import K, q, values
from sealgrade.functions import text as T
from sealgrade.operators import features as FT, pagination as P
from sealgrade.sources import adapters as A

# word lists that occur in the given texts; the built-in ones hardly do
TEST_WORDS = FT.Vocabulary(
    filename_pii=("src1_", "_fr_"),
    filename_memo=("_de_", "src7"),
    form=("license", "public", "the of", "der die"),
    defense=("tion", "ing", "ment", "keit", "mente"),
    government=("copyright", "worth", "ación", "heit"),
    marketing=("the", "que", "und", "con", "menu"),
    technical=("ver", "der", "au", "http"),
)

D = """D AS (SELECT doc_id AS document_id,
  concat(source, '_', lang, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text,
  n_chars AS file_size, CAST(doc_id % 9 AS BIGINT) AS image_count FROM documents)"""

# pages of 2000 characters as a list
PAGES = f"""{D},
P AS (SELECT *, CASE WHEN NOT regexp_matches(text, '\\S') THEN ['[Empty file]'] ELSE
  list_transform(range(0, CAST(ceil(length(text) / 2000.0) AS BIGINT)),
    lambda i: substring(text, i * 2000 + 1, 2000)) END AS pages FROM D)"""


def _pages_sql(pages: str, source: str = "D") -> str:
    return (f"SELECT document_id, i AS page, md5(pages[i]) AS digest, length(pages[i]) AS n FROM "
            f"(SELECT document_id, {pages} AS pages FROM {source}), "
            f"unnest(range(1, len(pages) + 1)) AS u(i)")


def _digest(pages: DataFrame) -> DataFrame:
    return pages.select("document_id", "page", F.md5("text").alias("digest"), F.length("text").alias("n"))


def _docs(spark, sf):
    return A.documents(spark, sf)


def _with_pages(spark, sf):
    return _docs(spark, sf).withColumn("pages", T.char_pages(F.col("text")))


def _paragraphs(spark, sf):
    """Lines as paragraphs; those with a bar stand for tables."""
    lines = F.transform(F.split("text", "\n"), lambda t: F.struct(
        t.alias("text"), t.contains("|").alias("is_table")))
    return _docs(spark, sf).select("document_id", lines.alias("paragraphs"))


# list_reduce folds a list, so the page folds can be checked as such
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _fold_sql(overlap: int) -> str:
    kept = f"list_slice(list_append(a.open, x.t), -{overlap}, -1)" if overlap else "CAST([] AS VARCHAR[])"
    return f"""WITH {D},
I AS (SELECT document_id, list_transform(string_split(text, chr(10)), lambda s: {{
    't': CASE WHEN contains(s, '|') THEN s ELSE {_STRIP.format('s')} END, 'tab': contains(s, '|')}}) AS items
  FROM D),
N AS (SELECT document_id, list_transform(list_filter(items, lambda s: s.tab OR s.t <> ''), lambda s: {{
    't': s.t, 'tab': s.tab,
    'w': CASE WHEN s.tab THEN 0 ELSE len(regexp_extract_all(s.t, '\\S+')) END}}) AS items FROM I),
R AS (SELECT document_id, list_reduce(items, lambda a, x:
    CASE WHEN NOT x.tab AND a.used + x.w >= {{words}} THEN
      {{'pages': list_append(a.pages, array_to_string(list_append(a.open, x.t), chr(10))),
        'open': {kept}, 'used': CAST(0 AS BIGINT), 'fresh': CAST(0 AS BIGINT)}}
    ELSE {{'pages': a.pages, 'open': list_append(a.open, x.t), 'used': a.used + x.w,
        'fresh': a.fresh + 1}} END,
    {{'pages': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'used': CAST(0 AS BIGINT),
      'fresh': CAST(0 AS BIGINT)}}) AS r FROM N),
F AS (SELECT document_id, CASE WHEN r.fresh > 0 THEN
    list_append(r.pages, array_to_string(r.open, chr(10))) ELSE r.pages END AS p FROM R),
G AS (SELECT document_id, CASE WHEN len(p) = 0 THEN ['[No text content found]'] ELSE p END AS pages FROM F)
{_pages_sql('pages', 'G')}""".replace("{words}", "120")


_LINE_BUDGET = f"""WITH {D},
I AS (SELECT document_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda s: {_STRIP.format('s')}), lambda s: s <> '') AS items FROM D),
N AS (SELECT document_id, list_transform(items,
    lambda s: {{'t': s, 'c': greatest(1, length(s) // 80)}}) AS items FROM I),
R AS (SELECT document_id, list_reduce(items, lambda a, x:
    CASE WHEN a.used + x.c > 10 AND len(a.open) > 0 THEN
      {{'pages': list_append(a.pages, array_to_string(a.open, chr(10))), 'open': [x.t], 'used': x.c}}
    ELSE {{'pages': a.pages, 'open': list_append(a.open, x.t), 'used': a.used + x.c}} END,
    {{'pages': CAST([] AS VARCHAR[]), 'open': CAST([] AS VARCHAR[]), 'used': CAST(0 AS BIGINT)}}) AS r FROM N),
G AS (SELECT document_id, list_append(r.pages, array_to_string(r.open, chr(10))) AS pages FROM R
      WHERE len(r.open) > 0)
{_pages_sql('pages', 'G')}"""


def _sheets(spark, sf):
    """Order lines as sheets: one document per order, one sheet per return flag."""
    l = A.table(spark, sf, "lineitem")
    cells = F.array(
        F.col("l_partkey").cast("string"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")),
        F.col("l_suppkey").cast("string"))
    blank = F.array(F.lit(None).cast("string"), F.lit(""))
    rows = l.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("sheet"),
        F.ascii("l_returnflag").alias("sheet_no"), F.col("l_linenumber").alias("row_no"),
        F.when(F.col("l_linenumber") % 5 == 0, blank).otherwise(cells).alias("cells"))
    return P.sheet_pages(rows)


def _slides(spark, sf):
    c = A.table(spark, sf, "conversations")
    shapes = c.select(
        F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("slide"),
        F.posexplode(F.split(
            F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.col("text")), "\n"
        )).alias("shape_no", "text"))
    return P.slide_pages(shapes)


def _scored(spark, sf):
    """Users as documents, their events' values as page scores."""
    scores = A.table(spark, sf, "events").select(
        F.col("user_id").alias("document_id"), F.col("value").alias("score"))
    docs = A.documents(spark, sf).select("document_id")
    out = P.legibility(docs, scores, floor=25.0)
    return out.withColumns({
        "legibility_score": F.round("legibility_score", 6),
        "warnings": F.array_join("warnings", "|")})


def _raw_segments(spark, sf):
    """Cuts of the text, one that is not in it and an empty one."""
    text = F.col("text")
    raw = F.array(*[
        F.struct(t.alias("text"), c.alias("classification"), s.alias("confidence"),
                 F.lit(None).cast("array<string>").alias("keywords"),
                 F.lit(None).cast("string").alias("reasoning"))
        for t, c, s in (
            (F.substring(text, 1501, 80), F.lit("Public"), F.lit(0.9)),
            (F.lit("zz not there zz"), F.lit(None).cast("string"), F.lit(None).cast("double")),
            (F.lit(""), F.lit("Unsafe"), F.lit(0.1)),
            (F.substring(text, 4001, 50), F.lit("Confidential"), F.lit(0.7)))
    ])
    d = _docs(spark, sf).withColumn("_raw", raw)
    located = T.locate_segments(F.col("text"), F.col("_raw"))
    return d.select("document_id", F.posexplode(located).alias("pos", "s")).select(
        "document_id", "pos", "s.classification", "s.confidence", "s.page", "s.start_char", "s.end_char")


_LOCATED = f"""WITH {D},
S AS (SELECT document_id, 0 AS pos, text AS ft, substring(text, 1501, 80) AS t, 'Public' AS classification,
        0.9::DOUBLE AS confidence FROM D
      UNION ALL SELECT document_id, 1, text, 'zz not there zz', 'Public', 0.5 FROM D
      UNION ALL SELECT document_id, 2, text, '', 'Unsafe', 0.1 FROM D
      UNION ALL SELECT document_id, 3, text, substring(text, 4001, 50), 'Confidential', 0.7 FROM D),
L AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE strpos(ft, t) - 1 END AS st FROM S),
E AS (SELECT *, CASE WHEN st >= 0 THEN st + length(t) ELSE 0 END AS en FROM L)
SELECT document_id, pos, classification, confidence,
  CASE WHEN st >= 0 THEN least(st // 2000 + 1, 100) ELSE 1 END AS page,
  CASE WHEN st >= 0 THEN st ELSE pos * 100 END AS start_char,
  CASE WHEN en > st THEN en ELSE pos * 100 + 50 END AS end_char FROM E"""


def _keywords(spark, sf):
    v = A.verdicts(spark, sf)
    from sealgrade.operators.verdicts import with_all_keywords
    return with_all_keywords(v).select("document_id", F.array_join("all_keywords", ",").alias("keywords"))


_HEAD = "regexp_extract_all(lower({0}), '[a-z]{{5,}}')"


def _first(text: str, n: int) -> str:
    h = _HEAD.format(text)
    return f"list_slice(list_filter({h}, lambda w, p: list_position({h}, w) = p), 1, {n})"


_KEYWORDS = f"""WITH {K},
S AS (SELECT document_id, i, substring(full_text, i * 2000 + 1, 2000) AS t FROM K, unnest(range(0, segment_count)) AS u(i)),
W AS (SELECT document_id, unnest({_first('t', 3)}) AS w FROM S
      UNION ALL SELECT document_id, unnest({_first('t', 2)}) FROM S
      UNION ALL SELECT document_id, 'image' || i FROM K, unnest(range(0, image_count)) AS u(i)),
G AS (SELECT document_id, string_agg(DISTINCT w, ',' ORDER BY w) AS keywords FROM W GROUP BY ALL)
SELECT k.document_id, coalesce(keywords, '') AS keywords FROM K k LEFT JOIN G USING (document_id)"""

_CONTEXT_WORDS = ("license", "und")


def _kwic(spark, sf):
    hits = P.keyword_in_context(_docs(spark, sf), _CONTEXT_WORDS, radius=5)
    return hits.select("document_id", "keyword", "position", F.md5("context_window").alias("digest"))


_KWIC = f"""WITH {D}, T AS (SELECT document_id, regexp_extract_all(text, '\\S+') AS w FROM D),
H AS (SELECT document_id, w, i, k FROM T, unnest(range(1, len(w) + 1)) AS u(i),
  (SELECT unnest({values(*_CONTEXT_WORDS)}) AS k) WHERE contains(lower(w[i]), k))
SELECT document_id, k AS keyword, i - 1 AS position,
  md5(array_to_string(w[greatest(i - 5, 1):i + 5], ' ')) AS digest FROM H"""


def _features(spark, sf):
    return FT.detect_features(_docs(spark, sf).withColumnRenamed("text", "preview"), vocabulary=TEST_WORDS)


def _featured(name: str, query, sql: str) -> dict:
    return {name: (lambda s, sf: query(_features(s, sf)), sql)}


def _count(column: str, words) -> str:
    return " + ".join(f"CAST(contains({column}, {q(w)}) AS INTEGER)" for w in words)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def _pii(column: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(rx)}, 'i')" for rx in V.PII_PATTERNS.values()) + ")"


_v = TEST_WORDS
FEATURES = f"""{D},
F1 AS (SELECT document_id, lower(filename) AS name, image_count,
  text AS body,
  lower(coalesce(text, '')) AS low FROM D),
F2 AS (SELECT *, {_any('name', _v.filename_pii)} AS filename_pii,
  coalesce({_pii('body')}, false) AS pii_data, {_count('low', _v.form)} AS form_count,
  {_count('low', _v.defense)} AS defense_count, {_count('low', _v.government)} AS government_count,
  {_count('low', _v.marketing)} AS marketing_count, {_count('low', _v.technical)} AS technical_count FROM F1),
F3 AS (SELECT *, pii_data OR form_count >= 2 AS cp, filename_pii OR pii_data OR form_count >= 2 AS has_pii_indicators,
  defense_count >= 3 AS has_defense_keywords, government_count >= 1 AS has_government_markers,
  marketing_count >= 3 AS has_marketing_indicators, technical_count >= 2 AS has_technical_content FROM F2),
F4 AS (SELECT *, body IS NOT NULL AND body <> '' AND ((has_defense_keywords AND has_marketing_indicators)
    OR (has_pii_indicators AND (has_defense_keywords OR has_government_markers))) AS potential_multi_label,
  CAST(CASE WHEN cp THEN 30 ELSE 0 END + CASE WHEN has_defense_keywords THEN 40 ELSE 0 END
    + CASE WHEN has_government_markers THEN 20 ELSE 0 END - CASE WHEN has_marketing_indicators THEN 10 ELSE 0 END
    + CASE WHEN has_technical_content THEN 25 ELSE 0 END AS DOUBLE) AS sensitivity_score,
  CASE WHEN has_marketing_indicators AND NOT has_pii_indicators THEN 'marketing'
    WHEN has_pii_indicators AND contains(name, 'application') THEN 'form_with_pii'
    WHEN has_defense_keywords AND has_technical_content THEN 'technical_defense'
    WHEN has_government_markers THEN 'government'
    WHEN {_any('name', _v.filename_memo)} THEN 'internal_memo' ELSE 'unknown' END AS document_type FROM F3)"""

_FLAGS = (
    "has_pii_indicators", "has_defense_keywords", "has_government_markers",
    "has_marketing_indicators", "has_technical_content", "potential_multi_label",
)
_PLAN = """array_to_string(['pre_classification_analysis', 'quick_safety_check',
  CASE WHEN has_pii_indicators THEN 'pii_detection' END,
  CASE WHEN has_pii_indicators THEN 'pii_sensitivity_assessment' END,
  CASE WHEN has_defense_keywords THEN 'proprietary_detection' END,
  CASE WHEN has_defense_keywords THEN 'keyword_relevance_scoring' END,
  CASE WHEN has_defense_keywords AND has_technical_content THEN 'technical_specification_analysis' END,
  CASE WHEN has_government_markers THEN 'document_context_classification' END,
  CASE WHEN has_government_markers THEN 'government_source_verification' END,
  CASE WHEN has_marketing_indicators THEN 'marketing_content_analysis' END,
  CASE WHEN image_count > 5 THEN 'visual_content_analysis' END, 'classification_decision',
  'evidence_extraction', CASE WHEN potential_multi_label THEN 'multi_label_detection' END,
  'confidence_assessment'], ',')"""

_COUNTS = ("form_count", "defense_count", "government_count", "marketing_count", "technical_count")

_LEAD_IN = f"""WITH {FEATURES}
SELECT document_id, md5(concat('**DOCUMENT ANALYSIS REQUEST**', chr(10), 'Filename: ', full_name, chr(10),
  'Pages: 3', chr(10), 'Images: ', image_count, chr(10), chr(10), '**DETECTED FEATURES:**', chr(10),
  CASE WHEN has_pii_indicators THEN '- Contains PII indicators (forms, personal data)' || chr(10) ELSE '' END,
  CASE WHEN has_defense_keywords THEN '- Contains defense/military keywords' || chr(10) ELSE '' END,
  CASE WHEN has_government_markers THEN '- Contains government content markers' || chr(10) ELSE '' END,
  CASE WHEN has_technical_content THEN '- Contains technical specifications' || chr(10) ELSE '' END,
  '- Document type: ', document_type, chr(10),
  '- Sensitivity score: ', printf('%.1f', sensitivity_score), chr(10), chr(10),
  '**ANALYSIS PIPELINE:**', chr(10), 'Execute the following analysis steps in order:', chr(10), chr(10),
  array_to_string(list_transform(string_split({_PLAN}, ','), lambda s, i: '**Step ' || i || ': '
    || array_to_string(list_transform(string_split(s, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '**'), chr(10))
  )) AS lead_in FROM F4 JOIN (SELECT document_id, filename AS full_name FROM D) USING (document_id)"""


def _lead_in(features):
    from sealgrade.operators.verdicts import lead_in
    d = features.withColumn("page_count", F.lit(3))
    return lead_in(d).select("document_id", F.md5("lead_in").alias("lead_in"))


QUERIES = {
    "t01_pages_by_chars": (
        lambda s, sf: _digest(P.pages_by_chars(_docs(s, sf), ["document_id"])),
        f"WITH {PAGES} {_pages_sql('pages', 'P')}"),
    "t02_pages_by_words": (
        lambda s, sf: _digest(P.pages_by_words(_paragraphs(s, sf), ["document_id"], words=120)),
        _fold_sql(0)),
    "c05_pages_with_overlap": (
        lambda s, sf: _digest(P.pages_by_words(_paragraphs(s, sf), ["document_id"], words=120, overlap=2)),
        _fold_sql(2)),
    "t03_pages_by_lines": (
        lambda s, sf: _digest(P.pages_by_lines(_docs(s, sf), ["document_id"], lines=4)),
        f"""WITH {D}, S AS (SELECT document_id, string_split(text, chr(10)) AS l FROM D),
        G AS (SELECT document_id, list_transform(range(0, (len(l) - 1) // 4 + 1),
          lambda i: array_to_string(l[i * 4 + 1:i * 4 + 4], chr(10))) AS pages FROM S)
        {_pages_sql('pages', 'G')}"""),
    "t04_pages_by_line_budget": (
        lambda s, sf: _digest(P.pages_by_line_budget(
            _docs(s, sf).select("document_id", F.split("text", "\n").alias("paragraphs")),
            ["document_id"], lines=10)),
        _LINE_BUDGET),
    "t05_sheet_pages": (
        lambda s, sf: _sheets(s, sf),
        """WITH R AS (SELECT l_orderkey AS document_id, l_returnflag AS sheet, l_linenumber AS n,
          CASE WHEN l_linenumber % 5 <> 0 THEN concat(CAST(l_partkey AS VARCHAR), ' | ',
            CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) ELSE '' END, ' | ',
            CAST(l_suppkey AS VARCHAR)) END AS line FROM lineitem)
        SELECT document_id, ascii(sheet) AS sheet_no, '[Sheet: ' || sheet || ']' ||
          coalesce(chr(10) || string_agg(line, chr(10) ORDER BY n, line), '') AS text
        FROM R GROUP BY document_id, sheet"""),
    "t06_slide_pages": (
        lambda s, sf: _slides(s, sf),
        rf"""WITH S AS (SELECT conv_id AS document_id, turn + 1 AS slide, i, x[i] AS t FROM (
          SELECT *, string_split(CASE WHEN turn % 4 = 3 THEN '  ' ELSE text END, chr(10)) AS x
          FROM conversations), unnest(range(1, len(x) + 1)) AS u(i))
        SELECT document_id, slide, CASE WHEN count(*) FILTER (WHERE regexp_matches(t, '\S')) = 0
          THEN '[Slide ' || slide || ' - No text]' ELSE '[Slide ' || slide || ']' || chr(10) ||
          string_agg({_STRIP.format('t')}, chr(10) ORDER BY i) FILTER (WHERE regexp_matches(t, '\S'))
          END AS text FROM S GROUP BY document_id, slide"""),
    "t07_combined_text": (
        lambda s, sf: P.combined_text(_with_pages(s, sf)).select(
            "document_id", F.md5("combined_text").alias("digest")),
        f"""WITH {PAGES} SELECT document_id, md5(array_to_string(list_transform(pages,
        lambda p, i: 'Page ' || i || ':' || chr(10) || p),
        chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10))) AS digest FROM P"""),
    "t08_content_preview": (
        lambda s, sf: P.with_preview(
            _with_pages(s, sf), max_blocks=V.PREVIEW_BLOCKS, chars=V.PREVIEW_CHARS).select(
            "document_id", F.md5("preview").alias("digest")),
        f"""WITH {PAGES} SELECT document_id, md5(substring('Document Text Content:' || chr(10) || chr(10)
        || array_to_string(list_transform(pages, lambda p, i: 'Page ' || i || ':' || chr(10) || p),
        chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10)), 1, 1000)) AS digest FROM P"""),
    "t09_located_segments": (_raw_segments, _LOCATED),
    "t10_keyword_union": (_keywords, _KEYWORDS),
    "t11_keyword_in_context": (_kwic, _KWIC),
    "t12_metadata": (
        lambda s, sf: P.metadata(_with_pages(s, sf)).withColumn("warnings", F.array_join("warnings", "|")),
        f"""WITH {PAGES} SELECT document_id, filename, file_size, len(pages) AS page_count, image_count,
        true AS is_legible, 999.0::DOUBLE AS legibility_score, 'TXT' AS format, '' AS warnings FROM P"""),
    "t13_legibility": (
        _scored,
        f"""WITH {D}, M AS (SELECT user_id, avg(value) AS m, count(value) AS n FROM events GROUP BY ALL),
        S AS (SELECT document_id, coalesce(m, 0) AS m, coalesce(n, 0) AS n FROM D
              LEFT JOIN M ON document_id = user_id)
        SELECT document_id, round(m, 6) AS legibility_score, n AS scored_pages, m >= 25 AS is_legible,
        coalesce(array_to_string([CASE WHEN m < 25 THEN 'Low legibility detected (score: '
          || printf('%.2f', m) || ')' END,
          CASE WHEN n = 0 THEN 'Document has no pages' END], '|'), '') AS warnings FROM S"""),
    "f01_filename_hints": (
        lambda s, sf: _features(s, sf).select("document_id", "filename_pii"),
        f"WITH {FEATURES} SELECT document_id, filename_pii FROM F4"),
    "f02_pii_report": (
        lambda s, sf: FT.pii_report(_docs(s, sf)),
        f"""WITH {D} SELECT document_id, {', '.join(
            f"regexp_matches(text, {q(rx)}, 'i') AS {n}" for n, rx in V.PII_PATTERNS.items())},
        {_pii('text')} AS has_pii FROM D"""),
    "f02_pii_values": (
        lambda s, sf: FT.pii_values(_docs(s, sf)),
        f"WITH {D} " + " UNION ALL ".join(
            f"SELECT document_id, '{n}' AS pattern, unnest(regexp_extract_all(text, {q(rx)}, 0, 'i'))"
            f" AS value FROM D" for n, rx in V.PII_PATTERNS.items())),
    **_featured(
        "f03_f07_keyword_counts",
        lambda d: d.select("document_id", "pii_data", *_COUNTS),
        f"WITH {FEATURES} SELECT document_id, pii_data, {', '.join(_COUNTS)} FROM F4"),
    **_featured(
        "f08_f10_feature_flags",
        lambda d: d.select("document_id", *_FLAGS, "sensitivity_score", "document_type"),
        f"""WITH {FEATURES} SELECT document_id, {', '.join(_FLAGS)}, sensitivity_score, document_type
        FROM F4"""),
    **_featured(
        "f11_analysis_plan",
        lambda d: d.select("document_id", F.array_join("analysis_plan", ",").alias("plan")),
        f"WITH {FEATURES} SELECT document_id, {_PLAN} AS plan FROM F4"),
    **_featured(
        "f12_insight",
        lambda d: d.select(
            "document_id", "insight.document_type", "insight.sensitivity_score",
            "insight.recommended_review",
            F.array_join("insight.detected_features", ",").alias("detected_features")),
        f"""WITH {FEATURES} SELECT document_id, document_type, sensitivity_score,
        sensitivity_score >= 50 AS recommended_review, coalesce(array_to_string([{', '.join(
            f"CASE WHEN {n} THEN '{n}' END" for n in _FLAGS)}], ','), '') AS detected_features FROM F4"""),
    **_featured("m19_lead_in", _lead_in, _LEAD_IN),
}
