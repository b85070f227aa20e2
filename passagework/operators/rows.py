"""Structured rows: profiles, descriptions, entries and look-ups in 'key: value' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import constants as K
from passagework.functions.text import contains_any, format_money, format_revenue, let, lines, strip
from passagework.sources.vector_store import assign_ids


def filled(column: str) -> Column:
    """The column as text; null when blank."""
    value = F.col(f"`{column}`").cast("string")
    return F.when(strip(value) != "", value)


def table_profile(df: DataFrame, order_by: str, samples: int = 3, width: int = 50, columns: list[str] | None = None) -> DataFrame:
    """Per column: row and column counts and the first non-null values in row order.

    Each partition keeps only its first ``samples`` values per column before
    anything is exchanged; rows are counted once for all columns.
    """
    names = columns or [c for c in df.columns if c != order_by]
    long = df.select(
        F.col(order_by).alias("_order"),
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)])
        ).alias("cell"),
    ).select("_order", "cell.*")
    first = Window.partitionBy("i", "column").orderBy("_order")
    head = (
        long.filter(F.col("v").isNotNull())
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= samples)
        .groupBy("i", "column")
        .agg(F.sort_array(F.collect_list(F.struct("n", F.substring("v", 1, width).alias("v")))).alias("vs"))
    )
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column string")
    return listed.join(head, ["i", "column"], "left").select(
        "column",
        df.agg(F.count("*").alias("n")).scalar().alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
        F.coalesce(F.array_join(F.transform("vs", lambda s: s["v"]), ", "), F.lit("(empty column)")).alias("samples"),
    )


def _field(columns: list[str], synonyms: list[str]) -> Column:
    """First filled value among the columns whose names contain a synonym."""
    hits = [filled(c) for s in synonyms for c in columns if s.lower() in c.lower()]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _optional(before: str, value: Column, after: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))


def first_filled(columns: list[str], separator: str, top: int = 3) -> Column:
    """Array of the first 'column<separator>value' texts of a row."""
    cells = F.array(*[F.concat(F.lit(c + separator), filled(c)) for c in columns])
    return F.slice(F.filter(cells, lambda x: x.isNotNull()), 1, top)


def _generic(columns: list[str]) -> Column:
    return let(
        first_filled(columns, " is "),
        lambda p: F.when(
            F.size(p) > 0, F.concat(F.lit("The data shows "), F.array_join(p, ", "), F.lit("."))
        ).otherwise("Data entry with multiple fields."),
    )


def describer_of(columns: list[str]) -> str:
    """Which describer fits, by exact column name."""
    lowered = {c.lower() for c in columns}
    for kind, names in K.DESCRIBER_COLUMNS.items():
        if lowered & set(names):
            return kind
    return "generic"


def describe_row(columns: list[str]) -> Column:
    """A sentence for the row; the columns are resolved once, from their names."""
    kind = describer_of(columns)
    generic = _generic(columns)
    if kind == "generic":
        return generic
    f = {name: _field(columns, syn) for name, syn in K.FIELD_SYNONYMS[kind].items()}
    main = f["main"]
    if kind == "person":
        tail = [
            _optional(" works as a ", f["role"]),
            _optional(" in the ", f["department"], " department"),
            _optional(" with ", f["experience"], " of experience"),
        ]
    elif kind == "company":
        tail = [
            _optional(" operates in the ", f["industry"], " industry"),
            _optional(" with revenue of ", format_money(f["revenue"])),
            _optional(" and employs ", format_money(f["employees"]), " people"),
        ]
    elif kind == "financial":
        revenue = format_money(f["revenue"])
        main = F.when(f["revenue"].isNotNull(), main)
        tail = [
            F.concat(F.lit(" generated "), revenue, F.lit(" in revenue")),
            _optional(" with ", format_money(f["profit"]), " profit"),
        ]
    else:
        tail = [
            _optional(" is a ", f["category"]),
            _optional(" priced at ", format_money(f["price"])),
        ]
    return F.coalesce(F.concat(main, *tail, F.lit(".")), generic)


def key_fields(columns: list[str]) -> Column:
    """First three filled 'column: value' pairs."""
    return F.array_join(first_filled(columns, ": "), " | ")


def row_entries(
    df: DataFrame,
    file: str,
    order_by: str,
    columns: list[str] | None = None,
    kind: str = "CSV",
    max_rows: int | None = None,
) -> DataFrame:
    """All rows as entry texts, or the first ``max_rows``; ``hidden_rows`` tells how many were left out."""
    names = columns or [c for c in df.columns if c != order_by]
    rows = df.select(F.struct("*").alias("row"), F.col(order_by).alias("_by"))
    if max_rows is None:
        numbered, hidden = assign_ids(rows, ["_by"], first_id=1), F.lit(0).cast("long")
    else:
        numbered = rows.orderBy("_by").limit(max_rows).withColumn("id", F.row_number().over(Window.orderBy("_by")))
        hidden = F.greatest(df.agg(F.count("*").alias("n")).scalar() - max_rows, F.lit(0))
    keys = key_fields(names)
    title = F.concat(F.lit(f"### {kind}: {file} - Entry "), F.col("entry"))
    return numbered.select(F.col("id").cast("int").alias("entry"), "row.*").select(
        "entry",
        F.concat(
            title, F.lit("\n\n"), describe_row(names), F.lit("\n\n"),
            F.when(keys != "", F.concat(F.lit("Key fields: "), keys, F.lit("\n"))).otherwise(""),
        ).alias("content"),
        hidden.alias("hidden_rows"),
    )


def field_value(line: Column, names: list[str]) -> Column:
    """Value after the first named 'field:' up to '|'; any letter case; '' when absent."""
    out = F.lit("")
    for name in reversed(names):
        found = F.regexp_extract(line, rf"(?is){name}:([^|]*)", 1)
        clean = strip(F.regexp_replace(strip(found), r"Row [123]:", ""))
        out = F.when(F.contains(F.lower(line), F.lit(name + ":")), clean).otherwise(out)
    return out


def largest_number(line: Column) -> Column:
    digits = F.regexp_extract_all(F.replace(line, F.lit(","), F.lit("")), F.lit(r"\d+"), 0)
    return F.coalesce(F.array_max(F.transform(digits, lambda d: d.cast("double"))), F.lit(0.0))


def _line_company(line: Column) -> Column:
    named = strip(F.substring_index(F.substring_index(F.substr(line, F.instr(line, "Company:") + 8), "Company:", 1), "|", 1))
    first = strip(F.regexp_replace(strip(F.substring_index(line, "|", 1)), r"Row [123]:", ""))
    return F.when(F.contains(line, F.lit("Company:")), named).when(
        F.contains(line, F.lit("|")), first
    ).otherwise("the company")


def argmax_entity(content: Column) -> Column:
    """Struct (company, amount) of the line with the largest number; the first of equals."""
    revenue_lines = F.filter(
        F.transform(lines(content), strip),
        lambda x: F.contains(F.lower(x), F.lit("revenue:")) | (F.contains(x, F.lit("|")) & F.rlike(x, F.lit(r"\d"))),
    )
    ranked = F.transform(revenue_lines, lambda x, i: F.struct(largest_number(x).alias("amount"), (-i).alias("i"), x.alias("line")))
    return let(
        F.array_max(ranked),
        lambda best: F.when(
            best.isNotNull(),
            F.struct(_line_company(best["line"]).alias("company"), best["amount"].alias("amount")),
        ),
    )


def revenue_answer(content: Column) -> Column:
    return let(
        argmax_entity(content),
        lambda b: F.when(
            b.isNotNull(),
            F.concat(F.lit("Based on the data, "), b["company"], F.lit(" has the highest revenue at "), format_revenue(b["amount"]), F.lit(".")),
        ).otherwise("I found financial data but couldn't determine the highest revenue."),
    )


def entity_list(content: Column) -> Column:
    """Distinct company values in order of appearance."""
    hits = F.filter(
        lines(content),
        lambda x: F.contains(F.lower(x), F.lit("company:"))
        | (F.contains(x, F.lit("|")) & F.contains(F.lower(x), F.lit("row"))),
    )
    return F.array_distinct(F.filter(F.transform(hits, lambda x: field_value(x, ["company", "name"])), lambda v: v != ""))


def entity_list_answer(content: Column) -> Column:
    def phrase(names):
        n = F.size(names)
        return (
            F.when(n == 0, "I found company data but couldn't extract the company names clearly.")
            .when(n == 1, F.concat(F.lit("The company mentioned is "), F.get(names, F.lit(0)), F.lit(".")))
            .when(
                n <= 3,
                F.concat(
                    F.lit("The companies mentioned are "), F.array_join(F.slice(names, 1, n - 1), ", "),
                    F.lit(" and "), F.get(names, n - 1), F.lit("."),
                ),
            )
            .otherwise(
                F.concat(
                    F.lit("The companies include "), F.array_join(F.slice(names, 1, 3), ", "),
                    F.lit(" and "), (n - 3).cast("string"), F.lit(" others."),
                )
            )
        )

    return let(entity_list(content), phrase)


def row_count(content: Column) -> Column:
    """Non-blank lines that mention a row."""
    return F.size(F.filter(lines(content), lambda x: (strip(x) != "") & F.contains(F.lower(x), F.lit("row"))))


def row_count_answer(content: Column, question: Column) -> Column:
    q, n = F.lower(question), row_count(content).cast("string")
    return (
        F.when(contains_any(q, ["employee", "person"]), F.concat(F.lit("There are "), n, F.lit(" employees in the dataset.")))
        .when(F.contains(q, F.lit("company")), F.concat(F.lit("There are "), n, F.lit(" companies listed.")))
        .otherwise(F.concat(F.lit("The dataset contains "), n, F.lit(" entries.")))
    )


PERSON_MARKS = ["name:", "employee:", "role:", "department:"]


def personnel_answer(content: Column, question: Column) -> Column:
    """The senior person asked for, else the first person with a role."""
    everything = lines(content)
    senior = F.filter(everything, lambda x: F.contains(F.lower(x), F.lit("senior")) & (field_value(x, ["name", "employee"]) != ""))
    people = F.filter(everything, lambda x: contains_any(F.lower(x), PERSON_MARKS))

    def full(x):
        role, dept = field_value(x, ["role", "position", "title"]), field_value(x, ["department", "dept"])
        return F.concat(
            field_value(x, ["name", "employee"]),
            F.when(role != "", F.concat(F.lit(" is the "), role)).otherwise(""),
            F.when(dept != "", F.concat(F.lit(" in the "), dept, F.lit(" department"))).otherwise(""),
            F.lit("."),
        )

    def short(x):
        name, role = field_value(x, ["name", "employee"]), field_value(x, ["role", "position"])
        return F.when(
            (name != "") & (role != ""),
            F.concat(F.lit("Based on the available data, "), name, F.lit(" works as a "), role, F.lit(".")),
        )

    return F.coalesce(
        F.when(F.contains(F.lower(question), F.lit("senior")), F.get(F.transform(F.slice(senior, 1, 1), full), F.lit(0))),
        F.get(F.transform(F.slice(people, 1, 1), short), F.lit(0)),
        F.lit("I found personnel data but couldn't identify the specific person you're asking about."),
    )


def structured_summary(content: Column) -> Column:
    """A sentence about the first non-blank line of structured content."""
    kept = F.filter(
        lines(content), lambda x: (strip(x) != "") & ~F.startswith(x, F.lit("Column"))
    )

    def phrase(ls):
        head = strip(F.get(ls, F.lit(0)))
        low = F.lower(head)
        name, role = field_value(head, ["name", "employee"]), field_value(head, ["role", "position"])
        dept = field_value(head, ["department", "dept"])
        person = F.when(
            name != "",
            F.concat(
                name,
                F.when(role != "", F.concat(F.lit(" works as a "), role)).otherwise(""),
                F.when(dept != "", F.concat(F.lit(" in the "), dept, F.lit(" department"))).otherwise(""),
            ),
        ).otherwise("")
        company, revenue = field_value(head, ["company", "name"]), field_value(head, ["revenue"])
        firm = F.when(
            company != "",
            F.concat(
                company,
                F.when(revenue != "", F.concat(F.lit(" with revenue of "), format_revenue(largest_number(revenue)))).otherwise(""),
            ),
        ).otherwise("")
        return (
            F.when(F.size(ls) == 0, "I found some data but couldn't interpret it clearly.")
            .when(contains_any(low, PERSON_MARKS), F.concat(F.lit("The data shows "), person, F.lit(".")))
            .when(contains_any(low, ["company:", "revenue:", "industry:"]), F.concat(F.lit("The data shows "), firm, F.lit(".")))
            .otherwise(
                F.concat(F.lit("The data contains information about "), F.size(ls).cast("string"), F.lit(" entries with various details."))
            )
        )

    return let(kept, phrase)


def structured_answer(content: Column, question: Column) -> Column:
    """Routes a data question over structured content by its words."""
    q = F.lower(question)
    return (
        F.when(contains_any(q, K.PERSONNEL_QUERY), personnel_answer(content, question))
        .when(F.contains(q, F.lit("highest")) & F.contains(q, F.lit("revenue")), revenue_answer(content))
        .when(contains_any(q, K.COMPANY_QUERY), entity_list_answer(content))
        .when(contains_any(q, K.COUNT_QUERY), row_count_answer(content, question))
        .otherwise(structured_summary(content))
    )
