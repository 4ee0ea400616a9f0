"""Fixed values.

Word lists, patterns, label tables, thresholds and texts whose exact content
decides the results.  They are stated here once, as plain text; every operator
takes them from here.
"""

# --- text ------------------------------------------------------------------

STOP_WORDS = [
    "error", "failed", "login", "user", "query", "server", "execute", "executing", "ssis", "package",
    "for", "the", "with", "from", "could", "not", "because", "property", "set", "correctly", "message",
    "reason", "reasons", "possible", "and", "was", "is", "are", "to", "in", "of", "on", "by", "sqlstate", "code",
]

SYNONYM_GROUPS = {
    "timeout": ["timed out", "time out", "hung", "freeze", "frozen"],
    "connection": ["connectivity", "network", "conn", "connect"],
    "permission": ["access denied", "unauthorized", "forbidden", "denied"],
    "failed": ["failure", "error", "exception", "fail"],
    "database": ["db", "sql", "table", "schema"],
    "login": ["logon", "signin", "authenticate", "auth"],
}

# Ordered (pattern, replacement) pairs of the error normalisation.
NORMALIZE_REWRITES = [
    (r"\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<guid>"),
    (r"[a-z]:\\(?:[^\\\r\n]+\\)*[^\\\r\n]+", "<path>"),
    (r"\bexec(?:ute)?\s+\[[^\]]+\]\.\[[^\]]+\]", "exec <proc>"),
    (r"\bexec(?:ute)?\s+\[[^\]]+\]", "exec <proc>"),
    (r"\bexec(?:ute)?\s+[a-z0-9_]+\.[a-z0-9_]+", "exec <proc>"),
    (r"\bexec(?:ute)?\s+[a-z0-9_]+", "exec <proc>"),
    (r"login failed for user\s+'[^']+'", "login failed for user '<user>'"),
    (r"\b[a-z0-9._-]+\\[a-z0-9.$_-]+\b", "<user>"),
    (r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "<user>"),
    (r"[^\w\s-]", " "),
    (r"\b\d+\b", "<num>"),
    (r"\s+", " "),
]

TOKEN_PATTERN = r"[a-z0-9\-]{4,}"

NUMBERED_STEP_PATTERN = r"^\d+[\.\)]"
BULLETS = ["\n•", "\n-", "\n*"]
ANSWER_LINE_PREFIXES = ["1.", "2.", "3.", "- "]

ERROR_CODE_PATTERN = r"(?:error|code)[\s:]*(\d+)"
FEATURE_KEYWORDS = [
    "connection", "timeout", "permission", "denied", "failed",
    "database", "network", "authentication", "invalid", "null",
]

# --- categories and labels ---------------------------------------------------

# First category with a contained word wins.
CATEGORIES = [
    ("network", ["connection", "network"]),
    ("security", ["permission", "denied"]),
    ("nullref", ["null", "reference"]),
    ("performance", ["timeout"]),
]
CATEGORY_DEFAULT = "general"

DASHBOARD_CATEGORIES = [
    ("Authentication", ["login"]),
    ("Connection", ["timeout"]),
    ("Security", ["permission"]),
    ("SQL Syntax", ["syntax"]),
    ("Concurrency", ["deadlock"]),
    ("Data Integrity", ["corrupt"]),
]
CLUSTER_LABELS = [
    ("Network", ["connection", "network"]),
    ("Security", ["permission", "denied"]),
    ("Performance", ["timeout"]),
    ("Data Issues", ["null"]),
]
LABEL_DEFAULT = "Other"


METHOD_NAMES = {
    "exact_match": "Exact Hash Match",
    "enhanced_fuzzy_keyword": "Fuzzy Keyword Search",
    "enhanced_fuzzy_search": "Comprehensive Fuzzy",
    "advanced_scalable_vector": "AI Vector Similarity",
    "pattern_match": "Pattern Recognition",
    "comprehensive_ml": "ML Prediction",
    "openai_enhanced": "AI Generated",
}
MODEL_NAMES = {
    "ml_prediction": "ML Classifier",
    "comprehensive_ml": "Neural Network",
    "enhanced_vector_fuzzy": "Vector + ML Hybrid",
    "exact_match": "Exact Hash Match",
    "enhanced_fuzzy_keyword": "Fuzzy Keyword Search",
    "enhanced_fuzzy_search": "Comprehensive Fuzzy",
    "advanced_scalable_vector": "AI Vector Similarity",
    "pattern_match": "Pattern Recognition",
    "openai_enhanced": "AI Generated",
}
FOUND_TEXTS = {
    "exact_match": "✅ Found: Exact match from knowledge base",
    "enhanced_fuzzy_keyword": "🔍 Found: Enhanced fuzzy keyword search (synonyms + N-grams)",
    "enhanced_fuzzy_search": "🎯 Found: Comprehensive fuzzy analysis (multiple similarity metrics)",
    "enhanced_vector_fuzzy": "🤖 Found: AI similarity with fuzzy preprocessing",
    "pattern_match": "📋 Found: Pattern recognition match",
    "ml_prediction": "🧠 Found: Machine learning prediction",
    "openai_enhanced": "🧠 Generated: AI consultation with context",
}
FOUND_TEXTS_SIMPLE = {
    "exact_match": "✅ Found: Exact match from knowledge base",
    "keyword_match": "🔍 Found: Keyword similarity search",
    "vector_similarity": "🤖 Found: AI similarity analysis",
    "pattern_match": "📋 Found: Pattern recognition match",
    "openai_enhanced": "🧠 Generated: AI consultation with context",
}
FOUND_DEFAULT = "📚 Found: Database search"
METHOD_INSIGHTS = {
    "enhanced_fuzzy_keyword": "Used synonym expansion to match related terms and N-gram analysis for partial matching",
    "enhanced_fuzzy_search": "Applied comprehensive fuzzy matching with Levenshtein distance and N-gram similarity",
    "enhanced_vector_fuzzy": "Combined AI semantic understanding with fuzzy text matching for optimal accuracy",
    "exact_match": "Perfect match found immediately - highest reliability",
    "pattern_match": "Recognized common error pattern",
    "ml_prediction": "Machine learning models predicted this solution based on error characteristics",
}
METHOD_INSIGHT_DEFAULT = "Standard database search"
CONFIDENCE_ADDENDA = {
    "enhanced_fuzzy_keyword": " | Enhanced with synonym expansion and N-gram analysis",
    "enhanced_fuzzy_search": " | Comprehensive fuzzy matching with multiple similarity metrics",
    "enhanced_vector_fuzzy": " | AI semantic analysis with fuzzy preprocessing",
}

# texts of insights, with the least confidence at which they are shown
UNUSUAL_WARNING = "This appears to be an unusual error. Consider consulting domain experts or checking for recent system changes."
TEMPLATE_INTRO = "Try this approach based on similar error patterns:\n"
TEMPLATE_SHOWN = 0.5
TREND_TEXT = ("This type of error (", ") is predicted to occur ~", " times in the next hour")
TREND_SHOWN = 0.7
NEURAL_ADDENDUM = (" Neural network: ", " confidence")
NEURAL_ADDENDUM_SHOWN = 0.8

# --- input checks -------------------------------------------------------------

SQL_INJECTION_PATTERN = "|".join([
    r"(\bunion\s+select\b)",
    r"(\binsert\s+into\b.*\bvalues\b)",
    r"(\bdelete\s+from\b)",
    r"(\bdrop\s+(table|database|schema)\b)",
    r"(\balter\s+(table|database)\b)",
    r"(\bcreate\s+(table|database|user)\b)",
    r"(\bgrant\s+)|(\brevoke\s+)",
    r"(;\s*(insert|delete|update|drop|create|alter))",
    r"('.*;\s*--)",
    r"(\bor\s+1\s*=\s*1\b)|(\band\s+1\s*=\s*1\b)",
])
ERROR_MESSAGE_PATTERN = (
    r"(error|failed|exception|invalid|cannot|unable to|timeout|overflow|"
    r"violation|constraint|permission denied|access denied|login failed|"
    r"step \[.*\] failed|executing the query.*failed|"
    r"possible failure reasons|arithmetic overflow)"
)
XSS_PATTERN = r"<script|javascript:|vbscript:|onload|onerror|onclick"
STRICT_SQL_PATTERN = (
    r"(\b(ALTER|CREATE|DELETE|DROP|EXEC(UTE)?|INSERT|MERGE|SELECT|UPDATE|UNION|USE)\b)|"
    r"(--|/\*|\*/|;|'|xp_|sp_)"
)
DANGEROUS_COMMANDS = [
    "xp_cmdshell", "sp_oacreate", "sp_oamethod", "openrowset", "bulk insert",
    "bcp", "sqlcmd", "osql", "opendatasource", "openquery",
]
DANGEROUS_COMMANDS_STRICT = [
    "xp_cmdshell", "sp_oacreate", "sp_oamethod", "openrowset", "bulk insert", "bcp", "sqlcmd", "osql",
]
# Ordered literal replacements of the sanitiser; the ampersand comes last.
SANITIZE_REPLACEMENTS = [
    ("--", "- -"), ("/*", "/ *"), ("*/", "* /"), (";", ","), ("'", "&#39;"),
    ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("&", "&amp;"),
]
MAX_QUERY_LENGTH = 4000
MAX_DAILY_QUERIES = 1000
RATE_LIMITED_TYPES = ["QUERY", "SEARCH"]

EVENT_SEVERITY = {
    "SQL_INJECTION_ATTEMPT": "HIGH",
    "DANGEROUS_COMMAND": "HIGH",
    "XSS_ATTEMPT": "MEDIUM",
    "RATE_LIMIT_EXCEEDED": "MEDIUM",
    "EXCESSIVE_LENGTH": "LOW",
    "ERROR_ANALYSIS": "INFO",
}
EVENT_SEVERITY_DEFAULT = "INFO"
EVENT_SEVERITY_STRICT = {
    "SQL_INJECTION_ATTEMPT": "HIGH",
    "DANGEROUS_COMMAND": "HIGH",
    "XSS_ATTEMPT": "MEDIUM",
    "RATE_LIMIT_EXCEEDED": "MEDIUM",
}
EVENT_SEVERITY_STRICT_DEFAULT = "LOW"
VERDICT_MESSAGES = {
    "EMPTY": "Input cannot be empty",
    "EXCESSIVE_LENGTH": "Input exceeds maximum length of 4000 characters",
    "SQL_INJECTION_ATTEMPT": "Input contains potentially dangerous SQL patterns",
    "XSS_ATTEMPT": "Input contains potentially dangerous script content",
    "DANGEROUS_COMMAND": "Input contains restricted commands",
    "RATE_LIMIT_EXCEEDED": "Rate limit exceeded. Please try again later.",
}
ACCEPTED_ERROR_DETAIL = "SQL error message analyzed"
ACCEPTED_QUERY_DETAIL = "Validation passed"

# --- scores -------------------------------------------------------------------

MIN_FEEDBACK = 5
CONFLICT_THRESHOLD = 0.3
HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.6
VECTOR_MIN_COSINE = 0.70
PROVEN_RATE = 0.7
UNIFIED_WEIGHTS = {"base": 0.4, "feedback": 0.3, "model": 0.2, "similarity": 0.1}

GUIDANCE_REASONS = [
    "low confidence solution",
    "complex multi-step solution",
    "unusual error pattern detected",
    "conflicting solution feedback exists",
    "unvalidated solution",
    "{category} issues often need diagnostic steps",
    "ML predicts solution may not work",
]
GUIDANCE_CATEGORIES = ["network", "security", "performance"]

# --- retrieval sizes ------------------------------------------------------------

FUZZY_CANDIDATES = 100
VECTOR_PAGE = 100
INDEX_LIMIT = 10
INDEX_LIMIT_SECURE = 5
SUGGESTION_ROWS = 5
TRAINING_ROWS = 1000
CACHE_HOURS = 24
LSH_TABLES = 3
LSH_SCALE = 100

# --- appended row defaults --------------------------------------------------------

FEEDBACK_DEFAULTS = {
    "solution_version": "1.0",
    "user_expertise": "intermediate",
    "resolution_time_minutes": 0,
    "environment_context": "unknown",
}
TEACH_NOTES_NEW = "Enhanced teaching with conflict detection"
TEACH_NOTES_MERGED = "Updated with enhanced teaching"
TEACH_SOURCE = "human_enhanced"
VERSION_CONFIDENCE = 0.8
TEACH_CONFLICT_RATE = 0.6

# --- models -----------------------------------------------------------------------

CLUSTER_COUNT = 10
ANOMALY_THRESHOLD = 0.95
RADIUS_FACTOR = 2.5
MIN_TRAINING_ROWS = 50
MIN_RETRAIN_ROWS = 100
RETRAIN_HOURS = 24
SMOOTHING_ALPHA = 0.3
SEASON_HOURS = 24

# --- troubleshooting trees ----------------------------------------------------------

TREE_SINGLE = "Apply this solution?"
TREE_ROOT = "This solution has {n} steps. Ready to begin?"
TREE_STEP = "Step {i}: {text}\n\nDid this work?"
TREE_DONE = "Solution complete! Please rate if it worked."
TREE_LAST_NO = "Try alternative approach or ask the assistant"
TREE_FAILED = "Step failed. Try alternative approach?"
TREE_RETURN = "Return to main window for alternatives"
TREE_CONTINUE = "Continue with step {i}"
TREE_LEAF = "Solution:"
TREE_DEFAULT_RATE = 0.5
TREE_UNKNOWN = [
    ("root", None, None, "No solution found in database. Ask the assistant?", None),
    ("yes", "root", "yes", TREE_LEAF, "Close this window and ask the assistant"),
    ("no", "root", "no", TREE_LEAF, "This error has been logged for future analysis"),
]
# category -> rows (node, parent, branch, question, solution); a solution of
# "{template} | text" takes the recommended template and falls back to the text.
CATEGORY_TREES = {
    "network": [
        ("root", None, None, "Is this a network/connection related error?", None),
        ("ping", "root", "yes", "Can you ping the target server?", None),
        ("port", "ping", "yes", "Is the required port open (telnet/nc test)?", None),
        ("ping_no", "ping", "no", TREE_LEAF,
         "1. Check network cable/WiFi\n2. Verify IP configuration\n3. Check DNS settings"),
        ("port_yes", "port", "yes", TREE_LEAF, "{template} | Restart the service and check logs"),
        ("port_no", "port", "no", TREE_LEAF,
         "1. Configure firewall rules\n2. Check port binding\n3. Verify service is listening"),
        ("root_no", "root", "no", TREE_LEAF, "This doesn't appear to be a network issue. Check other categories."),
    ],
    "security": [
        ("root", None, None, "Is this an authentication or permission issue?", None),
        ("cred", "root", "yes", "Have credentials been recently changed?", None),
        ("cred_yes", "cred", "yes", TREE_LEAF,
         "{template} | 1. Update connection string\n2. Clear credential cache\n3. Re-authenticate"),
        ("cred_no", "cred", "no", TREE_LEAF,
         "1. Check if account is locked\n2. Verify permissions\n3. Check group membership"),
        ("root_no", "root", "no", TREE_LEAF, "This doesn't appear to be a security issue. Check other categories."),
    ],
    "nullref": [
        ("root", None, None, "Is this a null reference or missing data error?", None),
        ("data", "root", "yes", "Is required data present in the database?", None),
        ("data_yes", "data", "yes", TREE_LEAF,
         "{template} | 1. Verify column names\n2. Check data types\n3. Review mapping configuration"),
        ("data_no", "data", "no", TREE_LEAF,
         "1. Check if data was deleted\n2. Verify data load process\n3. Check for failed imports"),
        ("root_no", "root", "no", TREE_LEAF,
         "This doesn't appear to be a null reference issue. Check other categories."),
    ],
    "performance": [
        ("root", None, None, "Is this a timeout or performance issue?", None),
        ("load", "root", "yes", "Is system under heavy load?", None),
        ("load_yes", "load", "yes", TREE_LEAF,
         "{template} | 1. Increase timeout values\n2. Scale resources\n3. Optimize queries"),
        ("load_no", "load", "no", TREE_LEAF,
         "1. Check for blocking queries\n2. Review execution plans\n3. Check network latency"),
        ("root_no", "root", "no", TREE_LEAF, "This doesn't appear to be a performance issue. Check other categories."),
    ],
    "general": [
        ("root", None, None, "Is the service/database currently accessible?", None),
        ("service", "root", "yes", "Is the service/database running?", None),
        ("service_yes", "service", "yes", TREE_LEAF,
         "{template} | 1. Review configuration files\n2. Check error logs\n3. Verify connectivity"),
        ("service_no", "service", "no", TREE_LEAF,
         "1. Start the service\n2. Check for startup errors\n3. Verify dependencies"),
        ("root_no", "root", "no", TREE_LEAF, "Unable to categorize. Try manual troubleshooting."),
    ],
}
