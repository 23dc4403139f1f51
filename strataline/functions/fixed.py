"""Word lists, tables, patterns and thresholds that results depend on."""

from __future__ import annotations

# File types.
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx"]
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript"}
SKIPPED_FOLDERS = ["node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", "chroma_data", "generated_test_cases", "coverage"]
MOST_FILE_BYTES = 10 * 1024 * 1024

# Words that no search is made with.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "can", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "or", "and",
    "how", "what", "why", "when", "where", "which", "who", "whom",
    "this", "that", "these", "those", "it", "its", "i", "we", "you",
]

# How trivial commits begin.
TRIVIAL_PREFIXES = [
    "fix typo", "fix lint", "fixup", "wip", "merge branch", "merge pull request", "bump version", "update changelog",
    "chore:", "chore(", "style:", "style(", "docs:", "docs(", "ci:", "ci(", "test:", "test(", "revert ",
]

# Names that must not be used, keys that aren't keys, files that hold secrets.
RESERVED_NAMES = ["con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "lpt1", "lpt2", "lpt3"]
PLACEHOLDER_KEYS = ["your_api_key", "api_key_here", "xxx", "test", "placeholder"]
SENSITIVE_NAMES = [".env", ".env.local", ".env.production", "id_rsa", "id_ed25519"]
SENSITIVE_TOKENS = ["secret", "password", "private_key", "apikey", "api_key", "token"]

# What names promise.
PURPOSES = [
    (["get", "fetch", "retrieve"], "Retrieves or fetches data"),
    (["set", "update"], "Sets or updates data"),
    (["is", "has", "can"], "Performs a boolean check"),
    (["calculate", "compute"], "Performs calculations"),
    (["create", "build", "make"], "Creates or constructs objects"),
    (["validate", "check", "verify"], "Validates or checks conditions"),
    (["process", "handle"], "Processes or handles data"),
    (["init", "__init__"], "Initializes the object"),
]

# Control flow words of the two complexity estimates.
CONTROL_WORDS = ["if", "elif", "else", "for", "while", "try", "except", "catch", "switch", "case", "break", "continue", "return"]
TEST_CONTROL_WORDS = ["if ", "for ", "while ", "except ", "with "]

# Answers of language models.
CONFIDENCE = r"[Cc]onfidence:\s*([0-1](?:\.\d+)?)"
CITATION = r"\(([^)\s]+\.(?:py|ts|tsx|js|jsx)):(\d+)(?:-(\d+))?\)"

# Severities in their order, and what each costs of a score of 100.
SEVERITIES = ["critical", "high", "medium", "low"]
SEVERITY_WEIGHTS = {"critical": 25, "high": 10, "medium": 3, "low": 1}

# Rules as category, pattern, severity, message.
RULES = [
    ("pii_patterns", "password", "critical", "Potential password exposure - never log or hardcode passwords"),
    ("pii_patterns", "ssn", "critical", "Social Security Number detected - requires encryption"),
    ("pii_patterns", "social_security", "critical", "Social Security Number detected - requires encryption"),
    ("pii_patterns", "credit_card", "critical", "Credit card data detected - must be PCI-DSS compliant"),
    ("pii_patterns", "card_number", "critical", "Credit card data detected - must be PCI-DSS compliant"),
    ("pii_patterns", "cvv", "critical", "CVV code detected - never store CVV data"),
    ("secret_patterns", "api_key", "high", "API key should not be hardcoded - use environment variables"),
    ("secret_patterns", "api_secret", "high", "API secret should not be hardcoded - use environment variables"),
    ("secret_patterns", "secret_key", "high", "Secret key should not be hardcoded - use environment variables"),
    ("secret_patterns", "private_key", "high", "Private key detected - ensure proper key management"),
    ("secret_patterns", "access_token", "high", "Access token should not be hardcoded"),
    ("secret_patterns", "auth_token", "high", "Auth token should not be hardcoded"),
    ("gdpr_patterns", "user_email", "medium", "User email is PII - ensure GDPR compliance when logging"),
    ("gdpr_patterns", "email_address", "medium", "Email address is PII - ensure GDPR compliance when logging"),
    ("gdpr_patterns", "phone_number", "medium", "Phone number is PII - ensure GDPR compliance"),
    ("gdpr_patterns", "date_of_birth", "medium", "Date of birth is PII - ensure GDPR compliance"),
    ("gdpr_patterns", "home_address", "medium", "Home address is PII - ensure GDPR compliance"),
    ("hipaa_patterns", "patient_id", "critical", "Patient ID is PHI - HIPAA compliance required"),
    ("hipaa_patterns", "medical_record", "critical", "Medical record is PHI - HIPAA compliance required"),
    ("hipaa_patterns", "diagnosis", "high", "Health diagnosis data - HIPAA compliance required"),
    ("hipaa_patterns", "prescription", "high", "Prescription data - HIPAA compliance required"),
    ("dangerous_functions", "eval", "critical", "eval() is dangerous - can lead to code injection"),
    ("dangerous_functions", "exec", "critical", "exec() is dangerous - can lead to code injection"),
    ("dangerous_functions", "subprocess.call", "high", "subprocess.call with shell=True can be dangerous"),
    ("dangerous_functions", "os.system", "high", "os.system() can be dangerous - prefer subprocess with proper escaping"),
    ("logging_patterns", "print.*password", "critical", "Never print passwords to console/logs"),
    ("logging_patterns", "logger.*password", "critical", "Never log passwords"),
    ("logging_patterns", "logging.*password", "critical", "Never log passwords"),
]

# Patterns of the whole-text scans, as kind, pattern, message, severity.
_SECRET = r"""(?:api[_\-]?key|apikey|secret[_\-]?key|access[_\-]?token|auth[_\-]?token|private[_\-]?key)\s*=\s*["'][\w\-\/\+\.]{10,}["']"""
_PASSWORD = r"""(?:password|passwd|pwd)\s*=\s*["'][^"']{4,}["']"""
_BEARER = r"bearer\s+[a-zA-Z0-9\-._~+\/]{20,}"
_LOGGED = r"(?:log(?:ger)?\.(?:info|debug|warning|error|critical)|print)\s*\([^)]*(?:email|phone|ssn|social[_\s]security|credit[_\s]card)"
_LOGGED_SECRET = r"(?:log(?:ger)?\.(?:info|debug|warning|error|critical))\s*\([^)]*\b(?:password|passwd|token|secret)\b"
_QUERY_F = r"""(?:execute|cursor\.execute|query)\s*\(\s*f["']"""
SNIPPET_PATTERNS = [
    ("secret", _SECRET, "Hardcoded API key or secret detected"),
    ("secret", _PASSWORD, "Hardcoded password detected"),
    ("secret", _BEARER, "Hardcoded bearer token detected"),
    ("pii", _LOGGED, "PII exposure: sensitive field logged or printed"),
    ("dangerous_call", r"\beval\s*\(", "Use of eval() is a code injection risk"),
    ("sql_injection", _QUERY_F, "SQL injection risk: f-string used in query"),
]
REVIEW_PATTERNS = [
    ("secret", _SECRET, "Hardcoded API key / secret", "critical"),
    ("secret", _PASSWORD, "Hardcoded password", "critical"),
    ("secret", _BEARER, "Hardcoded bearer token", "high"),
    ("sql_injection", r"(?s)(?:execute|cursor\.execute|query)\s*\(.*?%\s*\w", "SQL injection risk: % string interpolation in query (use parameterised queries)", "high"),
    ("sql_injection", _QUERY_F, "SQL injection risk: f-string used to build query string", "high"),
    ("sql_injection", r"(?s)(?:execute|cursor\.execute|query)\s*\(.*?\.format\s*\(", "SQL injection risk: .format() used to build query string", "high"),
    ("path_traversal", r"open\s*\(\s*(?:request\b|body\b|params\b|args\b|data\b|user_input)", "Path traversal risk: user-controlled value passed directly to open()", "high"),
    ("path_traversal", r"os\.path\.(?:join|abspath)\s*\([^)]*(?:request\b|params\b|user_input)", "Path traversal risk: user-controlled value in os.path operation", "high"),
    ("pii", _LOGGED, "PII exposure: sensitive field logged or printed", "medium"),
    ("pii", _LOGGED_SECRET, "PII exposure: credential-like value in log call", "medium"),
]

# Checks as id, name, description, category, default severity.
CHECKS = [
    ("secrets", "Secrets & Credentials", "Hardcoded API keys, tokens, passwords, private keys", "security", "critical"),
    ("pii", "PII Detection", "Social Security Numbers, credit card data", "privacy", "high"),
    ("gdpr", "GDPR Compliance", "Personal data fields: email, phone, address, DOB", "privacy", "medium"),
    ("hipaa", "HIPAA Compliance", "Protected health information: patient data, medical records", "regulatory", "critical"),
    ("dangerous_funcs", "Dangerous Functions", "eval, exec, os.system, subprocess usage", "security", "critical"),
    ("sql_injection", "SQL Injection", "f-string / interpolation in database queries", "security", "high"),
]

#: Rules of our own for text without code: what the sample tables hold.
TEXT_RULES = [
    ("secret_patterns", r"token\s*=", "high", "Token in text"),
    ("pii_patterns", r"[\w.+-]+@[\w-]+\.[\w.]+", "medium", "E-mail address"),
    ("pii_patterns", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "low", "IPv4 address"),
    ("license_patterns", r"licensed|copyright", "low", "License or copyright line"),
]
