"""Lookup tables used by the operators.

Everything below the FIXED VALUES marker must equal the behaviour being
re-created (extension map, kinds, thresholds, labels, CWE lists, patterns,
knowledge base). Each table lives here once; the operators turn it into a
small broadcast DataFrame or a ``map`` literal, and ``sql_values`` prints
the same rows as a ``VALUES`` list for the independent SQL oracles.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the scanner being re-created; do not edit)
# ---------------------------------------------------------------------------

# file extension -> language (case-sensitive, last extension only, default 'unknown')
EXT_LANG = {
    ".py": "python", ".js": "javascript", ".java": "java", ".cpp": "cpp", ".c": "c",
    ".go": "go", ".rb": "ruby", ".php": "php", ".html": "html", ".css": "css",
    ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".swift": "swift",
    ".kt": "kotlin", ".rs": "rust", ".scala": "scala", ".sh": "bash", ".pl": "perl",
    ".r": "r", ".sql": "sql", ".lua": "lua", ".h": "c",
}

# definition kinds per language (default ['function_definition'])
KINDS_BY_LANG = {
    "python": ["function_definition", "class_definition", "lambda"],
    "javascript": ["function", "method_definition", "class_declaration", "lexical_declaration",
                   "variable_declarator", "arrow_function", "function_expression"],
    "java": ["method_declaration", "class_declaration", "field_declaration", "interface_declaration"],
    "cpp": ["function_definition", "class_specifier", "declaration", "struct_specifier",
            "enum_specifier", "namespace_definition", "template_declaration", "preproc_def",
            "preproc_if", "preproc_include", "lambda_expression"],
    "c": ["function_definition", "declaration", "struct_specifier", "enum_specifier", "preproc_def"],
    "go": ["function_declaration", "method_declaration", "type_declaration", "function_literal"],
    "php": ["function_definition", "method_declaration", "class_declaration"],
    "ruby": ["method", "class"],
    "rust": ["function_item", "struct_item", "enum_item", "trait_item", "impl_item", "mod_item",
             "macro_definition", "use_declaration", "const_item", "closure_expression"],
}
DEFAULT_KINDS = ["function_definition"]

# fallback chunker: lines per chunk by language (default 50)
FALLBACK_THRESHOLDS = {
    "python": 40, "javascript": 40, "java": 50, "cpp": 60, "c": 60, "go": 50,
    "php": 40, "ruby": 30, "html": 80, "sql": 100,
}
DEFAULT_THRESHOLD = 50

# language (lower-cased) -> rule-set name (default 'auto')
RULESET_BY_LANG = {
    "python": "python", "javascript": "javascript", "typescript": "typescript", "java": "java",
    "go": "go", "ruby": "ruby", "php": "php", "c": "c", "cpp": "cpp", "csharp": "csharp",
    "objectivec": "objectivec", "swift": "swift", "kotlin": "kotlin", "bash": "shell",
    "dockerfile": "dockerfile", "yaml": "yaml", "json": "json", "terraform": "terraform",
    "markdown": "markdown", "rust": "rust", "hcl": "hcl", "scala": "scala",
}
DEFAULT_RULESET = "auto"

# risk labels (compared case-insensitively); 'n/a' scores 0.0 here
RISK_LABELS = {"none": 0.0, "low": 1.0, "medium": 4.0, "high": 7.0, "critical": 9.0, "n/a": 0.0}

# severity buckets, inclusive bounds; values between two buckets fall in none
SEVERITY_BUCKETS = [("low", 0.0, 3.9), ("medium", 4.0, 6.9), ("high", 7.0, 8.9), ("critical", 9.0, 10.0)]

AGREEMENT_THRESHOLD = 0.7
BATCH_DELIMITER = "\n\n-----\n\n"
BATCH_MAX_CHARS = 4000
CACHE_TTL_SECONDS = 86400
CACHE_MAX_ENTRIES = 1000
RAG_LINES_PER_CHUNK = 20
RAG_TOP_K = 3
FILTERED_TOP_K = 5
CONTEXT_LIMIT = 5
SPLIT_SIZE = 512
SPLIT_OVERLAP = 64
SPLIT_SEPARATORS = ["\n\n", "\n", ";"]

CRITICAL_CWE = [
    "CWE-787", "CWE-79", "CWE-89", "CWE-78", "CWE-20", "CWE-125", "CWE-119", "CWE-798",
    "CWE-327", "CWE-862", "CWE-287", "CWE-416", "CWE-190", "CWE-502", "CWE-352", "CWE-434",
    "CWE-732", "CWE-918",
]
CWE_KEYWORDS = {
    "CWE-89": ["sql", "injection"],
    "CWE-78": ["command", "os"],
    "CWE-79": ["xss", "cross-site"],
    "CWE-787": ["overflow", "buffer", "memory"],
    "CWE-20": ["input", "validation"],
}
SAFE_PATTERNS = {
    "CWE-89": [r"execute\(.*%s", r"SqlParameter", r"PreparedStatement", r"pg-escape"],
    "CWE-78": [r"subprocess\.run\(.*shell=False", r"ProcessStartInfo\(.*UseShellExecute\s*=\s*false", r"execve\("],
    "CWE-79": [r"escape\(\)", r"HtmlEncode\(\)", r"DOMPurify\.sanitize\("],
}
BLACKLIST = {
    "CWE-78": ["system(", "popen(", "exec(", "ShellExecute("],
    "CWE-89": ["sql += ", "execute(", "raw_query("],
    "CWE-79": ["innerHTML", "document.write("],
}
WHITELIST = {
    "CWE-89": ["SQLAlchemy", "Hibernate", "Entity Framework"],
    "CWE-79": ["React", "DOMPurify", "OWASP Java Encoder"],
    "CWE-327": ["Bouncy Castle", "OpenSSL", "cryptography"],
}
TEST_MARKERS = [
    "# Test case for vulnerability fix",
    "// Vulnerability test",
    "describe('Security fix verification'",
    "@Test public void testVulnerabilityFix()",
]

# knowledge base: (kb_id, text, language, vulnerability_type, risk_level, remediation, example_fix, patterns)
KNOWLEDGE_BASE = [
    (1, "Buffer overflow via strcpy in C/C++", "c",
     "CWE-120: Buffer Copy Without Checking Size of Input", "High",
     "Use strncpy with proper bounds checking",
     "strncpy(dest, src, dest_size - 1); dest[dest_size - 1] = '\\0';",
     ["strcpy(", "gets("]),
    (2, "Code injection through eval in Python", "python",
     "CWE-94: Code Injection", "Critical",
     "Avoid eval with untrusted input, use safe parsers",
     "json.loads(sanitized_input)",
     ["eval(", "pickle.loads("]),
]

# failure record of the verdict parser
FAILED_RISK = "None"
FAILED_EXPLANATION = "Analysis failed"
DEFAULT_RISK = "Medium"
NO_DESCRIPTION = "No description"
UNKNOWN_LINE = "Unknown"
NO_ANALYSES_ERROR = "No valid analyses available"

# ---------------------------------------------------------------------------
# Own tables (not taken from anywhere; our re-aimed rule set and markers)
# ---------------------------------------------------------------------------

# rule table for the regex scan: (rule_id, lang or '*', regex, message, cwe, severity)
# regexes stay inside the common subset of Java regex and RE2 (no look-around, no \b)
RULES = [
    ("secret-assignment", "*", r"(?i)(secret|password|passwd|token|api[_-]?key)\s*[:=]\s*\S",
     "Hard-coded credential assigned in text", "CWE-798", "high"),
    ("email-address", "*", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
     "Personal e-mail address", "CWE-359", "medium"),
    ("ipv4-address", "*", r"(^|[^0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}([^0-9.]|$)",
     "Literal IPv4 address", "CWE-359", "low"),
    ("license-line", "*", r"(?i)(licensed under|released under|copyright|spdx-license-identifier)",
     None, None, "info"),
    ("py-eval", "python", r"(^|[^A-Za-z0-9_.])eval\(", "Use of eval on dynamic input", "CWE-95", "critical"),
    ("py-pickle", "python", r"pickle\.loads?\(", "Unpickling untrusted data", "CWE-502", "high"),
    ("c-strcpy", "c", r"(^|[^A-Za-z0-9_])strcpy\(", "Unbounded string copy", "CWE-120", "high"),
    ("c-gets", "c", r"(^|[^A-Za-z0-9_])gets\(", "Unbounded read into buffer", "CWE-242", "critical"),
    ("js-innerhtml", "javascript", r"\.innerHTML\s*=", "Assignment of markup from input", "CWE-79", "medium"),
    ("js-eval", "javascript", r"(^|[^A-Za-z0-9_.])eval\(", "Use of eval on dynamic input", "CWE-95", "high"),
]

# literal prefilters per rule: (case_insensitive, literals); a line is only
# tested with the regex when it contains one of the literals (every regex
# match contains one, so the hint never changes a result)
RULE_HINTS = {
    "secret-assignment": (True, ["secret", "password", "passwd", "token", "api"]),
    "email-address": (False, ["@"]),
    "license-line": (True, ["licensed under", "released under", "copyright", "spdx-license-identifier"]),
    "py-eval": (False, ["eval("]),
    "py-pickle": (False, ["pickle.load"]),
    "c-strcpy": (False, ["strcpy("]),
    "c-gets": (False, ["gets("]),
    "js-innerhtml": (False, [".innerHTML"]),
    "js-eval": (False, ["eval("]),
}

# severity label -> numeric risk used for scoring rule findings
SEVERITY_SCORE = {"info": 0.0, "low": 2.0, "medium": 5.0, "high": 7.5, "critical": 9.5}

# content-language markers: (lang, token); weight 1 each; ties broken by lang name
LANG_MARKERS = [
    ("en", "the"), ("en", "of"), ("en", "and"), ("en", "with"), ("en", "by"),
    ("fr", "le"), ("fr", "la"), ("fr", "des"), ("fr", "un"), ("fr", "dans"), ("fr", "du"), ("fr", "qui"),
    ("de", "der"), ("de", "die"), ("de", "von"), ("de", "dem"), ("de", "und"), ("de", "den"),
    ("es", "el"), ("es", "los"), ("es", "que"), ("es", "las"), ("es", "una"), ("es", "de"), ("es", "en"),
]

# extensions and names used to give code_corpus files a path
CORPUS_NAME_SUFFIXES = [
    ".py", ".js", ".c", ".h", ".tar.c", ".PY", ".tsx", ".jsx", ".rs", ".go", ".java", ".cpp",
    ".txt", "", ".rb", ".php", ".kt", ".sh", ".min.js", ".sql", ".lua", ".r", ".scala", ".swift",
]
# FIXED VALUES: file extensions that a source scan reads by default (must equal the established list)
SCAN_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".h", ".go", ".rb", ".php",
    ".html", ".css", ".rs", ".scala", ".kt", ".sh", ".pl", ".r", ".sql", ".lua",
]

# the characters Python's str.strip() removes (str.isspace), as one string
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# line breaks other than \n that str.splitlines() honours
OTHER_BREAKS_RE = r"[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# line-model split patterns (common subset of Java regex and RE2)
SPLITLINES_RE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
PY_WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_literal(v) -> str:
    """Render a Python value as a DuckDB/ANSI SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(sql_literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def sql_values(rows, columns) -> str:
    """A sub-select over ``VALUES`` rows with the given column names."""
    body = ", ".join("(" + ", ".join(sql_literal(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"
