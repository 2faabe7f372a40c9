"""The word lists, patterns, labels and limits that decide results. Data only."""

# fixed values: path classes
GENERATED_DIRS = ["dist", "build", ".next", "coverage"]
VENDORED_DIRS = ["node_modules", "vendor"]
LOCKFILES = [
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock",
    "Pipfile.lock", "Cargo.lock", "Gemfile.lock", "composer.lock", "bun.lock", "bun.lockb",
]
MINIFIED_SUFFIXES = [".min.js", ".min.css", ".min.mjs", ".min.cjs"]
TEST_DIRS = ["test", "tests", "__tests__"]
DOC_DIRS = ["docs"]

# fixed values: filter reasons
GENERATED, VENDORED, LOCKFILE, MINIFIED, EXCLUDED = (
    "generated directory", "vendored dependency", "lockfile", "minified asset", "configured exclusion",
)

# fixed values: languages
LANGUAGE_OF_SUFFIX = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".dart": "dart",
    ".go": "go", ".md": "markdown", ".markdown": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
LANGUAGE_NAMES = {
    "python": "Python", "javascript": "JavaScript", "typescript": "TypeScript", "dart": "Dart", "go": "Go",
    "markdown": "Markdown", "yaml": "YAML", "json": "JSON",
}
EXTRACTOR_LANGUAGES = ["python", "javascript", "typescript"]

# fixed values: side effects
DATABASE, TRANSACTION, NETWORK, FILE_WRITE, MESSAGE = (
    "database write", "transaction boundary", "network call", "file write", "message publish",
)
EXTERNAL = [NETWORK, MESSAGE, FILE_WRITE]  # by priority
TRANSACTION_CALLS = ["atomic", "transaction"]
OWNED_TRANSACTION_CALLS = ["begin", "commit", "rollback"]
TRANSACTION_OWNERS = ["connection", "conn", "database", "db", "session", "transaction"]
DATABASE_CALLS = ["bulk_create", "bulk_update", "bulkcreate", "bulkupdate", "upsert"]
OWNED_DATABASE_CALLS = ["add", "create", "delete", "execute", "flush", "insert", "save", "update"]
DATABASE_OWNERS = [
    "connection", "conn", "cursor", "database", "db", "model", "objects", "query", "repo", "repository", "session",
]
NETWORK_ROOTS = [
    "aiohttp", "axios", "http", "httpclient", "httpx", "processor", "requests", "stripe", "urllib", "webhook", "webhooks",
]
NETWORK_CALLS = ["fetch", "request"]
NETWORK_METHODS = ["delete", "get", "head", "options", "patch", "post", "put", "request", "urlopen"]
NETWORK_OWNERS = ["api", "client"]
FILE_CALLS = ["appendfile", "createwritestream", "write_bytes", "write_text", "writefile"]
FILE_OWNERS = ["file", "fs", "handle", "output", "path", "stream", "writer"]
MESSAGE_CALLS = ["apply_async", "delay", "enqueue", "produce", "publish", "send_message", "sendmessage"]
DESCRIPTIONS = {
    DATABASE: "The changed code likely writes to a database.",
    TRANSACTION: "The changed code appears to cross a local transaction boundary; external operations may not share that boundary.",
    NETWORK: "The changed code likely makes a network or external service call.",
    FILE_WRITE: "The changed code likely writes to the local filesystem.",
    MESSAGE: "The changed code likely publishes or enqueues a message or job.",
}

# fixed values: answers
RECOVERY_TERMS = ["partial success", "retry", "retries", "recover", "reconcile", "compensat", "idempoten", "duplicate"]
SUPPORT_TERMS = ["assert", "check", "cover", "demonstrate", "evidence", "ensure", "prove", "return", "support", "verify"]
GENERIC_WORDS = ["app", "code", "file", "function", "index", "main", "source", "src", "test", "tests"]
LEADING_WORDS = ["add", "create", "fetch", "find", "get", "handle", "load", "process", "set", "update"]
UNCOVERED = (
    r"\b(?:(?:does|do|did|is|are|was|were) not (?:cover|test|verify|exercise)"
    r"|(?:doesnt|dont|didnt|isnt|arent|wasnt|werent) (?:cover|test|verify|exercise)"
    r"|not (?:covered|tested|verified)|un(?:covered|tested|verified)"
    r"|(?:missing|uncovered|unverified) (?:case|path|scenario|test|coverage)"
    r"|(?:no|lacks?) (?:test|coverage|evidence)|(?:remains?|still) (?:uncovered|untested|unverified))\b"
)
ROLLBACK = r"\b(?:rollback|roll back|rolls back|rolled back)\b"
UNDO = r"\b(?:undo(?:es|ne)?|revert(?:s|ed)?|reverse[ds]?|cancel(?:s|led)?)\b"
UNDONE = r"(?:undone|reverted|reversed|cancell?ed)"
PASSIVE = r"\b(?:is|gets|got|was|will be|would be)\s+"
EXTERNAL_PHRASES = ["external effect", "external operation"]
UNDO_NEGATION = (
    r"\b(?:cannot|cant|never|wont|not)"
    r"(?:\s+(?:actually|automatically|completely|directly|fully|itself|necessarily|possibly|reliably|able\s+to|guaranteed\s+to))?\s*$"
)
OBJECT_PREFIX = r"(?:(?:a|an|cited|external|likely|the|this|that)\s+)*"
TEST_VERB = r"\b(?:test|tests|tested|testing|exercise|exercises|exercised|exercising)\s+(?:the\s+)?"
CONTRACTION = r"\b(does|do|did|is|are|was|were|can|will)n['’]?t\b"

# fixed values: labels
STRONG, PARTIAL, GAP, UNCERTAIN = "Strong", "Partial", "Gap found", "Uncertain"
SUMMARIES = {
    STRONG: "This answer connects the relevant repository evidence and reasoning into useful review preparation.",
    PARTIAL: "This answer identifies repository-backed details; review preparation would benefit from the remaining connections below.",
    GAP: "This answer includes a repository-grounded claim to revisit before review.",
    UNCERTAIN: "The available branch evidence does not support a responsible comparison.",
}

# fixed values: declarations and calls in JavaScript and TypeScript (Java syntax)
NAME = r"[A-Za-z_$][\w$]*"
JS_FUNCTION = rf"^\s*(?:export\s+)?(?:default\s+)?(?:(async)\s+)?function\s+({NAME})"
JS_CLASS = rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({NAME})"
JS_ARROW = rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:(async)\s*)?(?:\([^)]*\)|{NAME})\s*(?::[^=]+)?=>"
JS_EXPORT = rf"^\s*export\s+(?:const|let|var)\s+({NAME})\s*="
JS_METHOD = (
    r"^\s*((?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*)"
    rf"({NAME})\s*\([^)]*\)\s*(?::[^{{]+)?\{{"
)
JS_IMPORT = r"""^\s*import\s+.+?\s+from\s+['"]([^'"]+)['"]"""
JS_IMPORT_ONLY = r"""^\s*import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""
NOT_CALLS = ["catch", "class", "for", "function", "if", "switch", "while"]

# fixed values: declarations after a hunk's header, tried in this order; each has groups (kind or nothing, name)
_WORD = r"[A-Za-z_]\w*"
HUNK_DECLARATIONS = [
    ("function", rf"^\s*(?:async\s+)?def\s+({_WORD})\s*\([^)]*\)\s*(?:->\s*[^:]+)?\s*:"),
    ("class", rf"^\s*class\s+({_WORD})\s*(?:\([^)]*\))?\s*:"),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function(?:\s*\*\s*|\s+)({NAME})\s*(?:<[^;={{}}()]*>)?\s*\([^)]*\)\s*(?::[^{{}};=]+)?\s*\{{"),
    ("class", rf"^\s*(?:export\s+)?(?:default\s+)?class\s+({NAME})(?=\s*(?:$|[{{<]|extends\b|implements\b))"),
    (None, r"^\s*(?:(?:abstract|base|data|final|internal|partial|private|protected|public|pub|sealed|static)\s+)*"
           rf"(class|enum|mixin|extension|struct|interface|trait|record)\s+({_WORD})\b(?=\s*(?:$|[{{(:<]|extends\b|implements\b|on\b|where\b|with\b))"),
    ("go type", rf"^\s*type\s+({_WORD})\s+(struct|interface)\b"),
    ("function", rf"^\s*func\s+(?:\([^)]*\)\s*)?({_WORD})\s*\([^)]*\)"),
    ("function", rf'^\s*(?:(?:async|const|extern(?:\s+"[^"]+")?|pub(?:\([^)]*\))?|unsafe)\s+)*fn\s+({_WORD})\s*(?:<[^;={{}}()]*>)?\s*\([^)]*\)'),
    ("function", r"^\s*(?:(?:abstract|actual|expect|external|final|inline|internal|open|operator|override|private|protected|public|suspend|tailrec)\s+)*"
                 rf"fun\s+(?:[A-Za-z_][\w?.<>]*\.)?({_WORD})\s*(?:<[^;={{}}()]*>)?\s*\([^)]*\)"),
    ("function", r"^\s*(?:(?:abstract|async|const|constexpr|extern|external|final|inline|internal|long|native|override|private|protected|public|short|"
                 r"signed|static|synchronized|unsigned|virtual)\s+)*[A-Za-z_][\w.:]*(?:\s*<[^;={}()]+>)?(?:\s*\[\s*\])*(?:\s*[?*&]+\s*|\s+)"
                 rf"({_WORD}(?:::{_WORD})*)\s*(?:<[^;={{}}()]*>)?\s*\([^;={{}}()]*\)\s*(?:(?:async|const|final|noexcept|override)\s*)*"
                 r"(?:(?:->|:)\s*[^;={}]+\s*)?(?:\{|=>|;)"),
]
EXTRACTED, FALLBACK = "language extractor", "hunk context fallback"

# fixed values: limits
PATCH_BYTES, TOTAL_PATCH_BYTES, CHANGED_FILES, METADATA_BYTES, RAW_FILES = 1_000_000, 16_777_216, 1_000, 16_777_216, 10_000
SOURCE_BYTES, EVIDENCE_PER_FILE, CALLS_SCANNED, EFFECTS = 256_000, 200, 5_000, 100
OPEN_LINES, OPEN_CHARS = 20, 4_096
