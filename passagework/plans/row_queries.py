"""Queries over structured rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.functions import text as T
from passagework.operators import rows as R
from passagework.plans.registry import query, table
from passagework.plans.text_queries import documents

SQL_MONEY = """CASE WHEN {0} >= 1e9 THEN '$' || printf('%.1f', round({0}/1e9, 1)) || ' billion'
  WHEN {0} >= 1e6 THEN '$' || printf('%.1f', round({0}/1e6, 1)) || ' million'
  WHEN {0} >= 1e3 THEN '$' || printf('%.1f', round({0}/1e3, 1)) || ' thousand'
  ELSE '$' || format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT)) END"""


def people(spark, folder):
    nation = table(spark, folder, "nation")
    return table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        F.when(F.col("c_acctbal") > 0, F.col("n_name")).alias("role"),
    )


@query(
    "describe_rows",
    """SELECT c_custkey, c_name || CASE WHEN c_acctbal > 0 THEN ' works as a ' || n_name ELSE '' END
      || ' in the ' || c_mktsegment || ' department.' AS description
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def describe_rows(spark, folder):
    df = people(spark, folder)
    return df.select("c_custkey", R.describe_row(["name", "department", "role"]).alias("description"))


@query(
    "describe_companies",
    f"""SELECT s_suppkey, s_name || ' with revenue of ' || {SQL_MONEY.format('(s_acctbal * 1000)')} || '.' AS description FROM supplier""",
)
def describe_companies(spark, folder):
    df = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_name").alias("Company"), (F.col("s_acctbal") * 1000).alias("Revenue")
    )
    return df.select("s_suppkey", R.describe_row(["Company", "Revenue"]).alias("description"))


@query(
    "describe_financials",
    f"""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name || ' generated ' || {SQL_MONEY.format('(s_acctbal * 10)')} || ' in revenue.'
      ELSE 'The data shows entity is ' || s_name || '.' END AS description FROM supplier""",
)
def describe_financials(spark, folder):
    df = table(spark, folder, "supplier").select(
        "s_suppkey", F.col("s_name").alias("entity"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") * 10).alias("sales")
    )
    return df.select("s_suppkey", R.describe_row(["entity", "sales"]).alias("description"))


@query(
    "describe_products",
    f"""SELECT p_partkey, p_name || ' is a ' || p_type || ' priced at ' || {SQL_MONEY.format('p_retailprice')} || '.' AS description FROM part""",
)
def describe_products(spark, folder):
    df = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("product"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price")
    )
    return df.select("p_partkey", R.describe_row(["product", "category", "price"]).alias("description"))


@query(
    "describe_generic_rows",
    """SELECT o_orderkey, 'The data shows o_orderkey is ' || o_orderkey || ', o_custkey is ' || o_custkey
      || ', o_orderstatus is ' || o_orderstatus || '.' AS description FROM orders""",
)
def describe_generic_rows(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return df.select("o_orderkey", R.describe_row(df.columns).alias("description"))


@query(
    "key_fields",
    """SELECT c_custkey, array_to_string(list_filter(['name: ' || c_name, 'department: ' || c_mktsegment,
      CASE WHEN c_acctbal > 0 THEN 'role: ' || n_name END], lambda x: x IS NOT NULL), ' | ') AS key_fields
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def key_fields(spark, folder):
    return people(spark, folder).select("c_custkey", R.key_fields(["name", "department", "role"]).alias("key_fields"))


SQL_ENTRIES = """WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS entry, * FROM customer)
    SELECT entry, '### CSV: customers - Entry ' || entry || chr(10) || chr(10) || c_name || ' in the ' || c_mktsegment || ' department.'
      || chr(10) || chr(10) || 'Key fields: name: ' || c_name || ' | department: ' || c_mktsegment || chr(10) AS content,
      greatest(n - {0}, 0) AS hidden_rows FROM r, n WHERE entry <= {0}"""


def _customers(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department")
    )


@query("row_entries", SQL_ENTRIES.format("n"))
def row_entries(spark, folder):
    return R.row_entries(_customers(spark, folder), "customers", "c_custkey")


@query("row_entries_first", SQL_ENTRIES.format("50"))
def row_entries_first(spark, folder):
    return R.row_entries(_customers(spark, folder), "customers", "c_custkey", max_rows=50)


@query(
    "table_profile",
    """WITH l AS (SELECT p_partkey, unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'note']) AS "column",
        unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR), NULL]) AS v FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY p_partkey) AS n FROM l WHERE v IS NOT NULL)
    SELECT c."column", c.n_rows, 5 AS n_columns, coalesce(s.samples, '(empty column)') AS samples
    FROM (SELECT "column", count(*) AS n_rows FROM l GROUP BY 1) c
    LEFT JOIN (SELECT "column", string_agg(left(v, 50), ', ' ORDER BY n) AS samples FROM r WHERE n <= 3 GROUP BY 1) s
    ON c."column" = s."column" """,
)
def table_profile(spark, folder):
    df = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", F.lit(None).cast("string").alias("note")
    )
    return R.table_profile(df, "p_partkey")


def sheets(spark, folder):
    """One structured text per document: a 'key: value' row per line of it."""
    row = F.transform(
        T.lines(F.col("text")),
        lambda x, i: F.concat(
            F.lit("Row "), i + 1, F.lit(": Company: "), F.col("source"), F.lit(" "), F.length(x) % 7,
            F.lit(" | Revenue: "), F.length(x) * 7919 + i, F.lit(" | Flag: "), F.col("lang"),
        ),
    )
    return documents(spark, folder).select("doc_id", F.array_join(row, "\n").alias("content"))


SQL_SHEETS = r"""(SELECT doc_id, i, source || ' ' || (n % 7) AS company, n * 7919 + i - 1 AS revenue,
  CAST(regexp_extract(source, '\d+') AS BIGINT) AS src, lang FROM (
  SELECT doc_id, source, lang, length(unnest(string_split(text, chr(10)))) AS n,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""


@query(
    "argmax_entity",
    f"""SELECT doc_id, arg_max(company, (amount, -i)) AS company, max(amount) AS amount FROM (
      SELECT *, greatest(revenue, i, src) AS amount FROM {SQL_SHEETS}) GROUP BY doc_id""",
)
def argmax_entity(spark, folder):
    best = sheets(spark, folder).select("doc_id", R.argmax_entity(F.col("content")).alias("b"))
    return best.select("doc_id", "b.company", "b.amount")


@query(
    "entity_list",
    f"""WITH f AS (SELECT doc_id, company, min(i) AS i FROM {SQL_SHEETS} GROUP BY ALL),
    l AS (SELECT doc_id, list(company ORDER BY i) AS names FROM f GROUP BY 1)
    SELECT doc_id, CASE WHEN len(names) = 1 THEN 'The company mentioned is ' || names[1] || '.'
      WHEN len(names) <= 3 THEN 'The companies mentioned are ' || array_to_string(names[:-2], ', ') || ' and ' || names[-1] || '.'
      ELSE 'The companies include ' || array_to_string(names[1:3], ', ') || ' and ' || (len(names) - 3) || ' others.' END AS answer FROM l""",
)
def entity_list(spark, folder):
    return sheets(spark, folder).select("doc_id", R.entity_list_answer(F.col("content")).alias("answer"))


@query("row_count", "SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents")
def row_count(spark, folder):
    return sheets(spark, folder).select("doc_id", R.row_count(F.col("content")).alias("n"))


@query("field_lookup", f"SELECT doc_id, i AS line, company, lang AS flag FROM {SQL_SHEETS}")
def field_lookup(spark, folder):
    """The fields of every line of every sheet."""
    lines = sheets(spark, folder).select("doc_id", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    return lines.select(
        "doc_id", (F.col("at") + 1).cast("bigint").alias("line"),
        R.field_value(F.col("text"), ["firm", "company"]).alias("company"),
        R.field_value(F.col("text"), ["flag"]).alias("flag"),
    )


@query(
    "structured_answer",
    f"""WITH b AS (SELECT doc_id, arg_max(company, (amount, -i)) AS company, max(amount) AS amount, count(*) AS n,
        arg_min(company, i) AS head, arg_min(revenue, i) AS head_revenue FROM (
      SELECT *, greatest(revenue, i, src) AS amount FROM {SQL_SHEETS}) GROUP BY doc_id),
    m AS (SELECT *, CASE WHEN amount >= 1e6 THEN '$' || printf('%.1f', round(amount / 1e6, 1)) || ' million' ELSE '$' || format('{{:,}}', amount) END AS money FROM b)
    SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN 'I found personnel data but couldn''t identify the specific person you''re asking about.'
      WHEN 1 THEN 'Based on the data, ' || company || ' has the highest revenue at ' || money || '.'
      WHEN 2 THEN 'The dataset contains ' || n || ' entries.'
      ELSE 'The data shows ' || head || ' with revenue of ' || CASE WHEN head_revenue >= 1e6 THEN '$' || printf('%.1f', round(head_revenue / 1e6, 1)) || ' million'
        ELSE '$' || format('{{:,}}', head_revenue) END || '.' END AS answer FROM m""",
)
def structured_answer(spark, folder):
    questions = F.array(*[F.lit(x) for x in ["Who is the manager?", "Highest revenue?", "How many?", "What does it show?"]])
    q = F.get(questions, (F.col("doc_id") % 4).cast("int"))
    return sheets(spark, folder).select("doc_id", R.structured_answer(F.col("content"), q).alias("answer"))
