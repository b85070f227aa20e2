"""Word lists, thresholds and patterns that define the results."""

# Every character that counts as whitespace when a text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Text cleaning.
FORBIDDEN_CHARACTERS = r"""(?U)[^\w\s\-.,!?:;()\[\]{}"'/\\@#$%^&*+=<>|~`]"""
LONGEST_LINE = 1000
ENTITY = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

# Files.
SUPPORTED_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".txt", ".csv"]
TABULAR_EXTENSIONS = [".csv", ".xlsx", ".xls"]
UPLOAD_LIMIT_BYTES = 200 * 1024 * 1024

# Section headings, tested on stripped lines.
SECTION_PATTERNS = [
    r"(?Ud)^#{1,6}\s+.+$",
    r"(?Ud)^\d+\.\s+.+$",
    r"(?Ud)^[A-Z][A-Z\s]{3,}:?\s*$",
    r"(?Ud)^.{1,50}:$",
]
PROFILE_HEADING = r"(?Ud)^#+\s|^\d+\.\s|^[A-Z\s]{5,}:?$"
SHEET_ENTRY = r"(?s)### Sheet: [^\n]+ - Entry \d+\n\n.+?(?=### Sheet: [^\n]+ - Entry \d+|\z)"

# Row descriptions: exact column names that choose the describer, in order of priority.
DESCRIBER_COLUMNS = {
    "person": ["name", "employee", "person"],
    "company": ["company", "organization", "business"],
    "financial": ["revenue", "sales", "income", "profit"],
    "product": ["product", "item", "service"],
}
# Synonyms per field, searched as parts of column names.
FIELD_SYNONYMS = {
    "person": {
        "main": ["name", "employee", "person"],
        "role": ["role", "position", "title", "job"],
        "department": ["department", "dept", "division", "team"],
        "experience": ["experience", "years", "tenure"],
    },
    "company": {
        "main": ["company", "organization", "business", "name"],
        "industry": ["industry", "sector", "field"],
        "revenue": ["revenue", "sales", "income"],
        "employees": ["employees", "staff", "workforce"],
    },
    "financial": {
        "main": ["company", "name", "entity"],
        "revenue": ["revenue", "sales", "income"],
        "profit": ["profit", "earnings", "net_income"],
    },
    "product": {
        "main": ["product", "item", "service", "name"],
        "category": ["category", "type", "class"],
        "price": ["price", "cost", "value"],
    },
}

# Content type of a page.
CHART_CONTENT = ["chart", "graph", "plot", "figure", "diagram"]
PERFORMANCE_CONTENT = ["time", "performance", "speed", "latency"]
COMPARISON_CONTENT = ["comparison", "vs", "versus", "compared"]
TABLE_CONTENT = ["table", "data", "columns", "rows"]
PIPELINE_CONTENT = ["pipeline", "workflow", "architecture", "diagram"]

# Query flags used by the selection score.
CHART_QUERY = ["chart", "graph", "diagram", "figure", "visualization"]
PERFORMANCE_QUERY = ["time", "performance", "speed", "latency", "rate"]
EXPLICIT_CHART_QUERY = ["based on the chart", "from the chart"]

# Query expansion: (trigger words, [(second trigger words, added terms)]); the first second-level hit wins.
EXPANSIONS = [
    (
        ["who is", "who are", "person", "people"],
        [
            (["recruitment"], ["recruitment specialist", "hiring manager", "HR recruiter", "human resources"]),
            (
                ["senior dev", "senior developer"],
                ["senior developer", "lead developer", "principal engineer", "senior engineer"],
            ),
            (["manager"], ["manager", "supervisor", "team lead", "director"]),
        ],
    ),
    (
        ["time", "performance", "speed", "latency"],
        [
            (["retrieval"], ["retrieval time", "query performance", "search latency", "response time"]),
            (["colpali"], ["colpali", "visual embedding", "document processing", "pipeline performance"]),
        ],
    ),
    (
        ["chart", "graph", "diagram", "figure"],
        [([""], ["visualization", "chart data", "graph analysis", "performance metrics"])],
    ),
]

# Query type, tested in this order.
QUERY_TYPES = {
    "data_lookup": [
        "which", "what is the", "how many", "how much", "highest", "lowest", "most", "least",
        "revenue", "count", "number of",
    ],
    "procedural": ["how to", "steps", "process", "procedure", "method", "way to"],
    "factual": ["what is", "what are", "define", "explain", "describe", "tell me about"],
}

# Intent of a support query: actions and services, tested in this order.
SCENARIO_PHRASES = [
    "arrives late", "arrive late", "very late", "what if", "no-show",
    "complaint", "escalate", "problem", "issue", "angry", "unhappy",
]
ACTION_KEYWORDS = {
    "handle": [
        "arrives late", "arrive late", "very late", "comes late", "late arrival",
        "late for", "delayed arrival", "after hours",
        "handle", "handling", "manage", "process", "deal with", "address",
        "what if", "what to do", "how to handle", "what happens",
        "no-show", "no show", "noshow", "missed", "didn't show",
        "complaint", "complain", "unhappy", "angry", "upset",
        "problem", "issue", "trouble", "escalate", "escalation",
    ],
    "cancel": ["cancel", "cancellation", "cancelled", "cancelling", "void", "refund"],
    "modify": ["modify", "modification", "change", "update", "amend", "alter", "edit"],
    "book": ["book", "booking", "reserve", "reservation", "create", "new", "make"],
}
SERVICE_KEYWORDS = {
    "air": ["air", "flight", "airline", "aviation", "plane"],
    "hotel": ["hotel", "accommodation", "room", "stay", "lodging", "guest"],
    "car": ["car", "rental", "vehicle", "auto", "automobile"],
}
CONTEXT_KEYWORDS = {
    "booking": ["booking", "reservation", "ticket", "itinerary"],
    "no-show": ["no-show", "no show", "noshow", "missed", "didn't show"],
    "late-arrival": ["late", "delayed", "after hours", "very late"],
    "escalation": ["escalate", "escalation", "supervisor", "manager"],
    "waiver": ["waiver", "waive", "fee waiver", "refund", "exception"],
}
CONFIDENT_ACTIONS = {
    "cancel": ["cancel", "cancellation", "cancelled"],
    "modify": ["modify", "change", "update"],
    "book": ["book", "booking", "new"],
    "handle": ["handle", "manage", "process"],
}
CONFIDENT_SERVICES = {
    "air": ["flight", "airline", "air"],
    "hotel": ["hotel", "room", "accommodation"],
    "car": ["car", "rental", "vehicle"],
}

# Title terms of the staged intent search.
SEARCH_ACTIONS = {
    "cancel": ["cancel", "cancellation"],
    "modify": ["modification", "modify", "change"],
    "book": ["booking", "book", "new"],
    "handle": ["handling", "handle", "manage", "procedures", "process", "guidelines"],
}
SEARCH_SERVICES = {"air": ["air", "flight"], "hotel": ["hotel", "guest"], "car": ["car"]}
# Extra title terms of a 'handle' query: (words in the query, terms).
SEARCH_SCENARIOS = [
    (["late", "arrival"], ["late", "arrival", "check-in", "after hours"]),
    (["no-show", "missed"], ["no-show", "missed", "noshow"]),
    (["escalate"], ["escalation", "supervisor", "manager"]),
    (["complaint", "angry"], ["complaint", "customer service", "resolution"]),
]

# Terms of the intent relevance score.
RELEVANCE_ACTIONS = {
    "cancel": ["cancel", "cancellation", "refund", "void"],
    "modify": ["modification", "modify", "change", "update", "amend"],
    "book": ["booking", "book", "new", "reservation", "create"],
    "handle": ["handling", "handle", "manage", "process", "deal with"],
}
# Extra terms of a 'handle' scenario query; the first hit wins.
RELEVANCE_SCENARIOS = [
    (["late", "delayed"], ["late arrival", "delayed", "after hours", "grace period"]),
    (["no-show", "missed"], ["no-show", "missed", "absent", "failure to appear"]),
    (["escalate", "complaint"], ["escalation", "complaint", "supervisor", "manager"]),
]
RELEVANCE_SERVICES = {
    "air": ["air", "flight", "airline", "aviation"],
    "hotel": ["hotel", "accommodation", "room", "lodging"],
    "car": ["car", "rental", "vehicle", "auto"],
}
RELEVANCE_CONTEXTS = {
    "no-show": ["no-show", "missed", "absent"],
    "late-arrival": ["late", "delayed", "tardy"],
    "escalation": ["escalate", "supervisor", "manager"],
    "waiver": ["waiver", "waive", "exception"],
}
# Words in a title that speak for another action (optional check).
CONFLICTING_ACTIONS = {"book": ["cancel", "cancellation"], "cancel": ["book", "booking", "new"]}

# Article choice and answer sentences; services and actions tested in this order.
ANSWER_SERVICES = {
    "hotel": ["hotel", "accommodation", "room", "stay"],
    "air": ["air", "flight", "airline", "aviation"],
    "car": ["car", "rental", "vehicle", "auto"],
}
ANSWER_TITLE_ACTIONS = {
    "cancel": ["cancel", "cancellation", "refund", "void"],
    "modify": ["modify", "modification", "change", "update"],
    "book": ["book", "booking", "new", "create"],
    "handle": ["handle", "handling", "manage", "process"],
}
ANSWER_ACTIONS = {
    "cancel": ["cancel", "cancellation", "refund", "void", "terminate"],
    "modify": ["modify", "change", "update", "amend", "alter"],
    "book": ["book", "reserve", "create", "make", "new"],
    "handle": ["handle", "manage", "process", "deal with", "address"],
}
PROCEDURE_WORDS = ["step", "process", "follow", "ensure", "must", "should", "contact", "check"]
FLUFF_WORDS = ["purpose", "this article", "overview", "introduction", "general information"]
ACTION_LINE = (
    r"(?i)^(Contact|Call|Email|Visit|Check|Verify|Confirm|Review|Submit|Complete)"
)

# Answer extraction.
QUESTION_STOP_WORDS = ["what", "is", "are", "the", "a", "an", "define", "explain"]
DATA_LINE_WORDS = ["revenue", "count", "number", "total", "amount"]
STEP_WORDS = ["step", "phase", "first", "then", "next", "finally"]
PERSONNEL_QUERY = ["who is", "senior", "developer", "manager", "employee"]
COMPANY_QUERY = ["companies", "company", "organizations"]
COUNT_QUERY = ["how many", "count", "number of"]
EXCERPT_PUNCTUATION = ".,!?;:"

# Fixed texts.
NO_INFORMATION = (
    "I couldn't find any relevant information in the processed documents to answer your question."
)
NO_ANSWER = (
    "I found relevant information but encountered an issue generating the response. "
    "Please try rephrasing your question."
)

# Selection.
TEXT_SOURCE = "text"
PAGE_IMAGE_SOURCE = "colpali"
KNOWLEDGE_SOURCE = "salesforce"
MINIMUM_SCORES = {TEXT_SOURCE: 0.15, PAGE_IMAGE_SOURCE: 0.20, KNOWLEDGE_SOURCE: 0.2}
DEFAULT_MINIMUM_SCORE = 0.2

# Knowledge base records.
ARTICLE_FILTER = {"status": "Online", "language": "en_US", "record_type": "Product Documentation"}
ARTICLE_SOURCE = "Salesforce Knowledge Article"
CASE_SOURCE = "Salesforce Case"
DEFAULT_ARTICLES = 100
DEFAULT_CASES = 200
