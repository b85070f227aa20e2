"""Text preparation and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions import text as T
from passagework.operators import chunking as C
from passagework.plans.registry import query, spread, table

# Pieces of SQL shared by the oracles.
SQL_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"
SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQL_SENTENCES = (
    r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),"
    r" lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
)


def sql_words(x: str) -> str:
    return SQL_WORDS.format(x)


def sql_strip(x: str) -> str:
    return SQL_STRIP.format(x)


# A text with paragraphs: the lines of a document joined by blank lines.
SQL_PARAGRAPHED = "replace(text, chr(10), chr(10) || chr(10))"
# A text with sections: a heading before every line.
SQL_SECTIONED = (
    "'# ' || source || chr(10) || replace(text, chr(10), chr(10) || '# ' || lang || chr(10))"
)


def documents(spark, folder):
    return spread(table(spark, folder, "documents"))


def paragraphed():
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def sectioned():
    heading = F.concat(F.lit("\n# "), F.col("lang"), F.lit("\n"))
    return F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.replace(F.col("text"), F.lit("\n"), heading))


SQL_CLEAN = (
    r"""regexp_replace(array_to_string(list_transform(list_filter(string_split(
replace(replace(regexp_replace(regexp_replace(regexp_replace({0}, '\n\s*\n', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g'),
'[^\p{{L}}\p{{N}}\p{{M}}_\s\-.,!?:;()\[\]{{}}"''/\\@#$%^&*+=<>|~`]', '', 'g'), chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(10)),
lambda l: length(l) < {1}), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g')"""
)


@query("clean_content", f"SELECT doc_id, {SQL_CLEAN.format('text', 'length(l) + 1')} AS content FROM documents")
def clean_content(spark, folder):
    return documents(spark, folder).select("doc_id", T.clean_content(F.col("text")).alias("content"))


@query("clean_content_short_lines", f"SELECT doc_id, {SQL_CLEAN.format('text', K.LONGEST_LINE)} AS content FROM documents")
def clean_content_short_lines(spark, folder):
    return documents(spark, folder).select("doc_id", T.clean_content(F.col("text"), K.LONGEST_LINE).alias("content"))


@query(
    "doc_metadata",
    f"""SELECT doc_id, len({sql_words('text')}) AS word_count, length(text) AS char_count,
    len(string_split(text, chr(10))) AS line_count FROM documents""",
)
def doc_metadata(spark, folder):
    m = T.document_metadata(F.col("text"))
    return documents(spark, folder).select("doc_id", *[m[c].alias(c) for c in ("word_count", "char_count", "line_count")])


@query(
    "doc_title",
    f"""SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)),
    lambda l: {sql_strip('l')}), lambda l: l <> '')[1:5],
    lambda l: length(l) > 10 AND length(l) < 200)[1] AS title FROM documents""",
)
def doc_title(spark, folder):
    return documents(spark, folder).select("doc_id", T.document_title(F.col("text")).alias("title"))


@query(
    "doc_keywords",
    f"""WITH w AS (SELECT doc_id, unnest({sql_words('lower(text)')}) AS word,
      generate_subscripts({sql_words('lower(text)')}, 1) AS pos FROM documents),
    g AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 4 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g)
    SELECT doc_id, rank, word AS keyword FROM r WHERE rank <= 10""",
)
def doc_keywords(spark, folder):
    keywords = F.posexplode(T.document_keywords(F.col("text"))).alias("i", "keyword")
    return documents(spark, folder).select("doc_id", keywords).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("rank"), "keyword"
    )


@query(
    "strip_html",
    r"""SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(html, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'),
    '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS body FROM pages""",
)
def strip_html(spark, folder):
    return spread(table(spark, folder, "pages")).select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("content_hash", "SELECT doc_id, md5(text) AS file_hash FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5("text").alias("file_hash"))


@query(
    "format_money",
    """SELECT s_suppkey, CASE WHEN v >= 1e9 THEN '$' || printf('%.1f', round(v/1e9, 1)) || ' billion'
      WHEN v >= 1e6 THEN '$' || printf('%.1f', round(v/1e6, 1)) || ' million'
      WHEN v >= 1e3 THEN '$' || printf('%.1f', round(v/1e3, 1)) || ' thousand'
      ELSE '$' || format('{:,}', CAST(round_even(v, 0) AS BIGINT)) END AS money,
      CASE WHEN v >= 1e12 THEN '$' || printf('%.1f', round(v/1e12, 1)) || ' trillion'
      WHEN v >= 1e9 THEN '$' || printf('%.1f', round(v/1e9, 1)) || ' billion'
      WHEN v >= 1e6 THEN '$' || printf('%.1f', round(v/1e6, 1)) || ' million'
      ELSE '$' || format('{:,}', CAST(round_even(v, 0) AS BIGINT)) END AS revenue
    FROM (SELECT s_suppkey, s_acctbal * power(10, s_suppkey % 10) AS v FROM supplier)""",
)
def format_money(spark, folder):
    value = F.col("s_acctbal") * F.pow(F.lit(10.0), F.col("s_suppkey") % 10)
    return table(spark, folder, "supplier").select(
        "s_suppkey", T.format_money(value).alias("money"), T.format_revenue(value).alias("revenue")
    )


@query(
    "clean_answers",
    r"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'colpali' ELSE 'text' END AS source_type,
      '### CSV: ' || source || ' - Entry ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10)
      || 'Key fields: lang: ' || lang || chr(10) || '--- Page ' || doc_id || ' ---' || chr(10)
      || '(from ' || source || ')' || chr(10) || ' ' || chr(10) || chr(10) || lang AS answer FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN source_type = 'colpali' THEN regexp_replace(t, '\(from [^)]+\)', '', 'g')
      ELSE t END, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS answer FROM (
      SELECT doc_id, source_type, regexp_replace(regexp_replace(regexp_replace(answer, '### CSV: [^-]+ - Entry \d+\n\n', '', 'g'),
      '\n\nKey fields: [^\n]+', '', 'g'), '--- Page \d+ ---\n?', '', 'g') AS t FROM a)""",
)
def clean_answers(spark, folder):
    nl = F.lit("\n")
    answer = F.concat(
        F.lit("### CSV: "), "source", F.lit(" - Entry "), "doc_id", nl, nl, "text", nl, nl,
        F.lit("Key fields: lang: "), "lang", nl, F.lit("--- Page "), "doc_id", F.lit(" ---"), nl,
        F.lit("(from "), "source", F.lit(")"), nl, F.lit(" "), nl, nl, "lang",
    )
    kind = F.when(F.col("doc_id") % 3 == 0, "colpali").otherwise("text")
    return documents(spark, folder).select("doc_id", T.clean_answer(answer, kind).alias("answer"))


@query(
    "parse_key_value_rows",
    """SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS key,
      unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer""",
)
def parse_key_value_rows(spark, folder):
    text = F.concat(
        F.lit("Row 1: Name: "), "c_name", F.lit(" | Segment: "), "c_mktsegment", F.lit("\nRow 2: Nation : "), "c_nationkey"
    )
    maps = table(spark, folder, "customer").select("c_custkey", F.explode(T.key_value_rows(text)).alias("m"))
    return maps.select("c_custkey", F.explode("m").alias("key", "value"))


@query(
    "page_split",
    rf"""SELECT doc_id, page, {sql_strip('l')} AS text FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
      generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)""",
)
def page_split(spark, folder):
    marked = F.array_join(
        F.transform(T.lines(F.col("text")), lambda l, i: F.concat(F.lit("--- Page "), i + 1, F.lit(" ---\n"), l)), "\n"
    )
    return (
        documents(spark, folder)
        .select("doc_id", F.explode(T.split_pages(marked)).alias("p"))
        .select("doc_id", F.col("p.page").cast("bigint").alias("page"), "p.text")
    )


def _sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


@query(
    "content_type_label",
    f"""SELECT doc_id, CASE WHEN {_sql_any('t', ['chart', 'graph', 'plot', 'figure', 'diagram'])} THEN
      CASE WHEN {_sql_any('t', ['time', 'performance', 'speed', 'latency'])} THEN 'performance_chart'
      WHEN {_sql_any('t', ['comparison', 'vs', 'versus', 'compared'])} THEN 'comparison_chart' ELSE 'data_chart' END
      WHEN {_sql_any('t', ['table', 'data', 'columns', 'rows'])} THEN 'data_table'
      WHEN {_sql_any('t', ['pipeline', 'workflow', 'architecture', 'diagram'])} THEN 'technical_diagram'
      ELSE 'document_page' END AS content_type
    FROM (SELECT doc_id, lower(text) || ['', ' chart', ' plot time', ' rows', ' workflow', ' graph'][1 + doc_id % 6] AS t FROM documents)""",
)
def content_type_label(spark, folder):
    hints = F.array(*[F.lit(x) for x in ["", " chart", " plot time", " rows", " workflow", " graph"]])
    text = F.concat("text", F.get(hints, (F.col("doc_id") % 6).cast("int")))
    return documents(spark, folder).select("doc_id", T.content_type_label(text).alias("content_type"))


SIZE, OVERLAP = 200, 40


@query(
    "chunk_fixed",
    f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS words FROM documents),
    k AS (SELECT doc_id, words, unnest(range(0, CAST(greatest(0, ceil((len(words) - {SIZE}) / {SIZE - OVERLAP}.0)) AS BIGINT) + 1)) AS k
          FROM w WHERE len(words) > 0),
    c AS (SELECT doc_id, k, array_to_string(words[k * {SIZE - OVERLAP} + 1 : k * {SIZE - OVERLAP} + {SIZE}], ' ') AS content,
          coalesce(length(array_to_string(words[1 : k * {SIZE - OVERLAP}], ' ')), 0) AS start_index FROM k)
    SELECT doc_id, k AS chunk_number, printf('token_chunk_%03d', k) AS chunk_id, content, start_index,
      start_index + length(content) AS end_index, len({sql_words('content')}) AS word_count FROM c""",
)
def chunk_fixed(spark, folder):
    return C.chunk(documents(spark, folder), strategy="fixed", size=SIZE, overlap=OVERLAP).drop("chunk_method")


def sql_packed(source: str, key: str, text: str, size: int) -> str:
    """Recursive greedy packing without overlap."""
    return f"""WITH RECURSIVE s AS (SELECT {key}, {SQL_SENTENCES.format(text)} AS ss FROM {source}),
    e AS (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s),
    n AS (SELECT {key}, s, i, len({sql_words('s')}) AS w FROM e),
    p AS (SELECT {key}, i, 0 AS chunk, w AS used FROM n WHERE i = 1
      UNION ALL
      SELECT n.{key}, n.i, CASE WHEN p.used + n.w > {size} THEN p.chunk + 1 ELSE p.chunk END,
        CASE WHEN p.used + n.w > {size} THEN n.w ELSE p.used + n.w END
      FROM p JOIN n ON n.{key} = p.{key} AND n.i = p.i + 1)
    SELECT p.{key}, p.chunk AS chunk_number, string_agg(n.s, ' ' ORDER BY n.i) AS content
    FROM p JOIN n ON n.{key} = p.{key} AND n.i = p.i GROUP BY p.{key}, p.chunk"""


@query("chunk_sentences", sql_packed("documents", "doc_id", "text", SIZE))
def chunk_sentences(spark, folder):
    chunks = C.chunk(documents(spark, folder), strategy="sentences", size=SIZE, overlap=0)
    return chunks.select("doc_id", "chunk_number", "content")


# Pieces end at . ! ? before any whitespace; acc[i] is the number of words before piece i (from 1), ends[j] the
# pieces up to sentence j. A chunk is the pieces from ``lo`` up to its first new sentence, then whole sentences.
SQL_OVERLAPPED = rf"""WITH RECURSIVE s AS (SELECT doc_id, {SQL_SENTENCES.format('text')} AS ss FROM documents),
  e AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS j FROM s),
  p0 AS (SELECT doc_id, j, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT doc_id, j, string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM e)),
  p1 AS (SELECT doc_id, j, p, row_number() OVER (PARTITION BY doc_id ORDER BY j, i) AS n, len({sql_words('p')}) AS w FROM p0),
  p2 AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS upto FROM p1),
  d AS (SELECT doc_id, list(p ORDER BY n) AS ps, list_concat([0], list(upto ORDER BY n)) AS acc FROM p2 GROUP BY doc_id),
  b AS (SELECT doc_id, list_concat([0], list(n ORDER BY j)) AS ends FROM (SELECT doc_id, j, max(n) AS n FROM p2 GROUP BY ALL) GROUP BY doc_id),
  t AS (SELECT s.doc_id, ss, ps, acc, ends FROM s JOIN d USING (doc_id) JOIN b USING (doc_id)),
  walk AS (SELECT doc_id, 1 AS j, 0 AS chunk, CAST(0 AS BIGINT) AS lo, 1 AS head FROM t
    UNION ALL
    SELECT doc_id, j + 1, CASE WHEN flush THEN chunk + 1 ELSE chunk END,
      CASE WHEN flush THEN lo + len(list_filter(acc[lo + 1 : ends[j + 1]], lambda x: acc[ends[j + 1] + 1] - x > {OVERLAP})) ELSE lo END,
      CASE WHEN flush THEN j + 1 ELSE head END
    FROM (SELECT walk.*, t.acc, t.ends, t.acc[t.ends[j + 2] + 1] - t.acc[lo + 1] > {SIZE} AS flush
      FROM walk JOIN t USING (doc_id) WHERE j < len(t.ss))),
  c AS (SELECT doc_id, chunk, any_value(lo) AS lo, any_value(head) AS head, max(j) AS tail FROM walk GROUP BY ALL)
  SELECT doc_id, chunk AS chunk_number, array_to_string(list_concat(ps[lo + 1 : ends[head]], ss[head : tail]), ' ') AS content,
    printf('sentence_chunk_%03d', chunk) AS chunk_id, chunk * {SIZE} AS start_index, (chunk + 1) * {SIZE} AS end_index,
    'sentences' AS chunk_method, acc[ends[tail + 1] + 1] - acc[lo + 1] AS word_count FROM c JOIN t USING (doc_id)"""


@query("chunk_sentences_overlap", SQL_OVERLAPPED)
def chunk_sentences_overlap(spark, folder):
    return C.chunk(documents(spark, folder), strategy="sentences", size=SIZE, overlap=OVERLAP)


# Without overlap the words of an oversized paragraph fill their chunks in turn, as the packed sentences do.
@query(
    "chunk_paragraphs",
    f"""WITH RECURSIVE para AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pi FROM (
      SELECT doc_id, list_filter(list_transform(string_split_regex({SQL_PARAGRAPHED}, '\\n\\s*\\n'),
        lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents)),
    pw AS (SELECT doc_id, pi, p, len({sql_words('p')}) AS w FROM para),
    piece AS (SELECT doc_id, pi, 1 AS si, p AS s, w, false AS big FROM pw WHERE w <= {SIZE}
      UNION ALL SELECT doc_id, pi, generate_subscripts(ss, 1), unnest(ss), 0, true FROM (
        SELECT doc_id, pi, {SQL_SENTENCES.format('p')} AS ss FROM pw WHERE w > {SIZE})),
    n AS (SELECT doc_id, pi, s, big, CASE WHEN big THEN len({sql_words('s')}) ELSE w END AS w,
      row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i FROM piece),
    walk AS (SELECT doc_id, i, 0 AS chunk, w AS used, big, pi FROM n WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, walk.chunk + CAST(brk AS INT), CASE WHEN brk THEN n.w ELSE walk.used + n.w END, n.big, n.pi
      FROM walk JOIN n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1,
      LATERAL (SELECT (walk.used + n.w > {SIZE}) OR ((n.big OR walk.big) AND n.pi <> walk.pi) AS brk))
    SELECT walk.doc_id, chunk AS chunk_number, CASE WHEN bool_or(n.big) THEN 'paragraphs_split' ELSE 'paragraphs' END AS chunk_method,
      CASE WHEN bool_or(n.big) THEN string_agg(n.s, ' ' ORDER BY n.i) ELSE string_agg(n.s, chr(10) || chr(10) ORDER BY n.i) END AS content
    FROM walk JOIN n USING (doc_id, i) GROUP BY walk.doc_id, chunk""",
)
def chunk_paragraphs(spark, folder):
    df = documents(spark, folder).select("doc_id", paragraphed().alias("text"))
    chunks = C.chunk(df, strategy="paragraphs", size=SIZE, overlap=0)
    return chunks.select("doc_id", "chunk_number", "chunk_method", "content")


@query(
    "chunk_semantic",
    f"""WITH RECURSIVE sec AS (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS pi FROM (
      SELECT doc_id, list_filter(list_transform(string_split(substr({SQL_SECTIONED}, 3), chr(10) || '# '),
        lambda x: {sql_strip("'# ' || x")}), lambda x: x <> '') AS l FROM documents)),
    pw AS (SELECT doc_id, pi, p, len({sql_words('p')}) AS w FROM sec),
    piece AS (SELECT doc_id, pi, 1 AS si, p AS s, w, false AS big FROM pw WHERE w <= 60
      UNION ALL SELECT doc_id, pi, generate_subscripts(ss, 1), unnest(ss), 0, true FROM (
        SELECT doc_id, pi, {SQL_SENTENCES.format('p')} AS ss FROM pw WHERE w > 60)),
    n AS (SELECT doc_id, pi, s, big, CASE WHEN big THEN len({sql_words('s')}) ELSE w END AS w,
      row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i FROM piece),
    walk AS (SELECT doc_id, i, 0 AS chunk, w AS used, pi FROM n WHERE i = 1
      UNION ALL SELECT n.doc_id, n.i, walk.chunk + CAST(brk AS INT), CASE WHEN brk THEN n.w ELSE walk.used + n.w END, n.pi
      FROM walk JOIN n ON n.doc_id = walk.doc_id AND n.i = walk.i + 1,
      LATERAL (SELECT (walk.used + n.w > 60) OR n.pi <> walk.pi AS brk))
    SELECT walk.doc_id, chunk AS chunk_number,
      CASE WHEN (SELECT count(*) FROM sec WHERE sec.doc_id = walk.doc_id) = 1 THEN 'paragraphs' ELSE 'semantic' END
        || CASE WHEN bool_or(n.big) THEN '_split' ELSE '' END AS chunk_method,
      string_agg(n.s, ' ' ORDER BY n.i) AS content
    FROM walk JOIN n USING (doc_id, i) GROUP BY walk.doc_id, chunk""",
)
def chunk_semantic(spark, folder):
    df = documents(spark, folder).select("doc_id", sectioned().alias("text"))
    chunks = C.chunk(df, strategy="semantic", size=60, overlap=0)
    return chunks.select("doc_id", "chunk_number", "chunk_method", "content")


@query(
    "chunk_structured",
    rf"""WITH e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
      SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
    c AS (SELECT e.doc_id, i, regexp_replace('### Sheet: ' || source || ' - Entry ' || i || chr(10) || chr(10) || '- ' || l, '\s+$', '') AS content
      FROM e JOIN documents d USING (doc_id))
    SELECT doc_id, i - 1 AS chunk_number, printf('data_entry_%03d', i) AS chunk_id, content,
      CAST(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY i) - length(content) AS BIGINT) AS start_index,
      CAST(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS end_index FROM c""",
)
def chunk_structured(spark, folder):
    entries = F.array_join(
        F.transform(
            T.lines(F.col("text")),
            lambda l, i: F.concat(F.lit("### Sheet: "), F.col("source"), F.lit(" - Entry "), i + 1, F.lit("\n\n- "), l),
        ),
        "\n",
    )
    df = documents(spark, folder).select("doc_id", entries.alias("text"))
    chunks = C.chunk(df, strategy="structured_data", size=SIZE, overlap=OVERLAP)
    return chunks.select("doc_id", "chunk_number", "chunk_id", "content", "start_index", "end_index")


@query(
    "pick_by_file_type",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sql_strip('l')}), lambda l: l <> '') AS ls FROM documents)
    SELECT doc_id, 'structured_data_entry' AS chunk_method, 1 AS chunks, 'src' || doc_id || '.csv_chunk_0' AS first_id FROM s WHERE doc_id % 2 = 0
    UNION ALL
    SELECT doc_id, CASE WHEN len(ls) = 1 THEN 'paragraphs' ELSE 'semantic' END, len(ls), 'src' || doc_id || '.txt_chunk_0' FROM s WHERE doc_id % 2 = 1""",
)
def pick_by_file_type(spark, folder):
    even = F.col("doc_id") % 2 == 0
    extension = F.when(even, ".csv").otherwise(".txt")
    as_sheet = F.concat(F.lit("### Sheet: s - Entry 1\n\n"), F.col("text"))
    as_sections = F.array_join(F.transform(T.stripped_lines(F.col("text")), lambda l: F.concat(F.lit("# "), l)), "\n")
    df = documents(spark, folder).select(
        "doc_id",
        extension.alias("extension"),
        F.concat(F.lit("src"), "doc_id", extension).alias("file"),
        F.when(even, as_sheet).otherwise(as_sections).alias("text"),
    )
    chunks = C.with_global_ids(C.chunk_by_file_type(df, size=10000, overlap=0, keep=("doc_id", "file")))
    return chunks.groupBy("doc_id", "chunk_method").agg(
        F.count("*").alias("chunks"), F.min("global_id").alias("first_id")
    )


SQL_PROFILE = f"""SELECT doc_id, length(t) AS total_length, len({sql_words('t')}) AS word_count,
  len(string_split(t, chr(10))) AS line_count,
  len(list_filter(string_split_regex(t, '\\n\\s*\\n'), lambda p: {sql_strip('p')} <> '')) AS paragraph_count,
  len(list_filter(string_split_regex(t, '[.!?]+'), lambda p: {sql_strip('p')} <> '')) AS sentence_count,
  len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches({sql_strip('l')}, '^#+\\s|^\\d+\\.\\s|^[A-Z\\s]{{5,}}:?$'))) AS heading_count,
  list_sum(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: len({sql_words('p')})))
    / greatest(len(string_split_regex(t, '\\n\\s*\\n')), 1) AS avg_paragraph_length,
  list_sum(list_transform(string_split_regex(t, '[.!?]+'), lambda p: len({sql_words('p')})))
    / greatest(len(string_split_regex(t, '[.!?]+')), 1) AS avg_sentence_length
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {SQL_PARAGRAPHED} ELSE {SQL_SECTIONED} END AS t FROM documents)"""


def _mixed(spark, folder):
    text = F.when(F.col("doc_id") % 2 == 0, paragraphed()).otherwise(sectioned())
    return documents(spark, folder).select("doc_id", text.alias("text"))


@query(
    "content_profile",
    f"""SELECT * REPLACE (round(avg_paragraph_length, 6) AS avg_paragraph_length, round(avg_sentence_length, 6) AS avg_sentence_length)
    FROM ({SQL_PROFILE})""",
)
def content_profile(spark, folder):
    p = _mixed(spark, folder).select("doc_id", C.content_profile(F.col("text")).alias("p")).select("doc_id", "p.*")
    return p.withColumns(
        {c: F.round(c, 6) for c in ("avg_paragraph_length", "avg_sentence_length")}
    )


@query(
    "recommend_strategy",
    f"""SELECT doc_id, CASE WHEN heading_count > 3 THEN 'semantic' WHEN avg_paragraph_length > 80.0 THEN 'sentences'
      WHEN paragraph_count > 5 AND avg_paragraph_length < 30.0 THEN 'paragraphs' ELSE 'sentences' END AS strategy
    FROM ({SQL_PROFILE})""",
)
def recommend_strategy(spark, folder):
    p = C.content_profile(F.col("text"))
    return _mixed(spark, folder).select("doc_id", C.recommend_strategy(p, 100).alias("strategy"))


@query(
    "chunk_quality",
    f"""WITH c AS ({sql_packed("documents", "doc_id", "text", SIZE)}),
    w AS (SELECT d.lang, len({sql_words('content')}) AS w, length(content) AS chars, content FROM c JOIN documents d USING (doc_id))
    SELECT lang, count(*) AS total_chunks, min(w) AS min_words, max(w) AS max_words, round(avg(w), 6) AS mean_words,
      count_if(w < {SIZE} * 0.5) AS under_half, count_if(w >= {SIZE} * 0.5 AND w <= {SIZE} * 1.5) AS optimal,
      count_if(w > {SIZE} * 1.5) AS over_half, count_if({sql_strip('content')} = '') AS empty_chunks,
      count_if(w < 10) AS very_short_chunks, round(avg(chars), 6) AS mean_chars,
      round(100.0 * count_if(w >= {SIZE} * 0.5 AND w <= {SIZE} * 1.5) / count(*), 1) AS quality_score
    FROM w GROUP BY lang""",
)
def chunk_quality(spark, folder):
    chunks = C.chunk(documents(spark, folder), strategy="sentences", size=SIZE, overlap=0, keep=("doc_id", "lang"))
    q = C.chunk_quality(chunks, SIZE, by=("lang",))
    return q.withColumns({"mean_words": F.round("mean_words", 6), "mean_chars": F.round("mean_chars", 6)})
