from pyspark.sql import functions as F

from passagework.functions import query as Q
from passagework.functions import text as T
from passagework.operators import rows as R
from passagework.operators.chunking import content_profile


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_clean_content(spark):
    raw = "  a\t\tb \n \n\n c☃d\r\n" + "x" * 1000 + "\nlast—line "
    assert one(spark, T.clean_content(F.col("t"), 1000), t=raw) == "a b\n\ncd\nlastline"
    assert one(spark, T.clean_content(F.col("t")), t=raw) == "a b\n\ncd\n" + "x" * 1000 + "\nlastline"
    assert one(spark, T.clean_content(F.col("t")), t="") == ""


def test_metadata_title_keywords(spark):
    text = "short\n  A longer title line  \nalpha alpha betas betas betas gamma omega"
    m = one(spark, T.document_metadata(F.col("t")), t=text)
    assert (m.word_count, m.line_count, m.char_count) == (12, 3, len(text))
    assert m.title == "A longer title line"
    assert m.keywords == ["betas", "alpha", "short", "longer", "title", "gamma", "omega"]


def test_strip_html_decodes_all_entities(spark):
    assert one(spark, T.strip_html(F.col("t")), t="<p>a &lt;b&gt; &eacute;&#233;</p>\n x ") == "a <b> éé x"
    assert one(spark, T.strip_html(F.col("t"), unescape=False), t="<p>a&amp;b</p>") == "a&amp;b"


def test_money(spark):
    for value, want in {"469822000000": "$469.8 billion", "1,500": "$1.5 thousand", "12": "$12", "n/a": "n/a"}.items():
        assert one(spark, T.format_money(F.col("v")), v=value) == want
    assert one(spark, T.format_revenue(F.col("v")), v=2.5e12) == "$2.5 trillion"
    assert one(spark, T.format_revenue(F.col("v")), v=1500.0) == "$1,500"


def test_key_value_rows_last_key_wins(spark):
    text = "Row 1: Name: Ann | Role: Dev | Name: Bob\nRow 2: City: Rome"
    assert one(spark, T.key_value_rows(F.col("t")), t=text) == [{"role": "Dev", "name": "Bob"}, {"city": "Rome"}]


def test_pages(spark):
    text = "cover\n--- Page 1 ---\nfirst\n--- Page 2 ---\nsecond"
    assert [(p.page, p.text) for p in one(spark, T.split_pages(F.col("t")), t=text)] == [(1, "first"), (2, "second")]


def test_profile_counts_blank_pieces_in_averages(spark):
    p = one(spark, content_profile(F.col("t")), t="# Head\n\na b c. d e!\n\n")
    assert (p.paragraph_count, p.sentence_count, p.heading_count) == (2, 2, 1)
    assert p.avg_paragraph_length == 7 / 3
    assert p.avg_sentence_length == 7 / 3


INTENTS = [
    ("How to cancel a hotel booking?", "cancel", "hotel", True, 1.0, False),
    ("Modify air reservation", "modify", "air", True, 1.0, False),
    ("Book new car rental", "book", "car", True, 1.0, False),
    ("Handle no-show flight", "handle", "air", True, 1.0, True),
    ("Customer arrives late for hotel check-in", "handle", "hotel", True, 0.7, True),
    ("What to do when flight passenger no-shows?", "handle", "air", True, 0.7, True),
    ("How to escalate angry car rental customer?", "handle", "car", True, 0.7, True),
    ("What is the weather today?", None, None, False, 0.0, False),
    ("Air cancellation policy", "cancel", "air", True, 1.0, False),
    ("Hotel modification process", "handle", "hotel", True, 1.0, False),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(INTENTS)], "i int, q string")
    got = df.select("i", Q.extract_intent(F.col("q")).alias("x")).orderBy("i").collect()
    for r, want in zip(got, INTENTS):
        x = r.x
        assert (x.action, x.service, x.is_valid, round(x.confidence, 6), x.scenario_detected) == want[1:], want[0]


def test_query_expansion_and_type(spark):
    got = one(spark, Q.expand_query(F.col("q")), q="Who is the manager")
    assert got == "Who is the manager director manager supervisor team lead"
    assert one(spark, Q.expand_query(F.col("q")), q="hello") == "hello"
    kinds = {"what is the sum": "data_lookup", "what is rain": "factual", "how to swim": "procedural", "hi": "general"}
    for q, want in kinds.items():
        assert one(spark, Q.query_type(F.col("q")), q=q) == want


def test_describe_rows(spark):
    df = spark.createDataFrame(
        [("John Smith", "Engineering", "Senior Developer", "5 years"), ("", "HR", None, " ")],
        "Name string, Department string, Role string, Experience string",
    )
    cols = df.columns
    got = [r.x for r in df.select(R.describe_row(cols).alias("x")).collect()]
    assert got == [
        "John Smith works as a Senior Developer in the Engineering department with 5 years of experience.",
        "The data shows Department is HR.",
    ]
    keys = df.select(R.key_fields(cols).alias("x")).first().x
    assert keys == "Name: John Smith | Department: Engineering | Role: Senior Developer"


def test_describe_companies(spark):
    df = spark.createDataFrame([("Amazon", 469822000000), ("Microsoft", 168000000000)], "Company string, Revenue bigint")
    assert [r.x for r in df.select(R.describe_row(df.columns).alias("x")).collect()] == [
        "Amazon with revenue of $469.8 billion.", "Microsoft with revenue of $168.0 billion.",
    ]


def test_entries_tell_hidden_rows(spark):
    df = spark.range(60).selectExpr("id", "concat('c', id) as company")
    assert R.row_entries(df, "firms", "id").agg(F.min("entry"), F.max("entry"), F.count("*"), F.sum("hidden_rows")).first() == (1, 60, 60, 0)
    rows = R.row_entries(df, "firms", "id", max_rows=50).orderBy("entry").collect()
    assert len(rows) == 50 and {r.hidden_rows for r in rows} == {10}
    assert rows[0].content == "### CSV: firms - Entry 1\n\nc0.\n\nKey fields: company: c0\n"


def test_personnel_and_field_case(spark):
    text = "Row 1: Name: Ann | Role: Senior Dev | Department: IT\nRow 2: Name: Bo | Role: Clerk"
    assert one(spark, R.personnel_answer(F.col("t"), F.lit("who is the senior dev?")), t=text) == "Ann is the Senior Dev in the IT department."
    assert one(spark, R.personnel_answer(F.col("t"), F.lit("who is the clerk?")), t=text) == "Based on the available data, Ann works as a Senior Dev."
    assert one(spark, R.field_value(F.col("t"), ["role"]), t="ROLE: chief | x") == "chief"


def test_entities_are_decoded_once_and_whole(spark):
    texts = ["a &amp; b&quot;", "x &&&amp", "&amp;quot; &#38;amp; &#x41;&#66;", "&copy &nosuch; &;", "", None, "no entity", "&middot;&notit; end&amp"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.u for r in frame.select("k", T.html_unescape(F.col("t")).alias("u")).collect()}
    assert [got[k] for k in range(len(texts))] == ['a & b"', "x &&&amp", "&quot; &amp; AB", "&copy &nosuch; &;", "", None, "no entity", "\u00b7&notit; end&amp"]
