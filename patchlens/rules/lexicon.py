"""Word lists, caps, lookup texts. They must keep these values for results to match."""

# --- fixed values: label vocabularies -------------------------------------------------
APPROVED_TYPES = [
    "async_error", "null_pointer", "logic_error", "type_error", "api_misuse",
    "security_vulnerability", "off_by_one", "exception_handling", "resource_leak",
    "performance_issue", "input_validation", "state_management",
]
SEVERITIES = ["low", "medium", "high", "critical"]
COMPONENTS = [
    "frontend", "backend", "database", "network", "authentication", "authorization",
    "storage", "api", "ui", "filesystem", "configuration", "build_system", "unknown",
]
BASE_SEVERITY = {
    "security_vulnerability": "high", "resource_leak": "medium", "async_error": "medium",
    "null_pointer": "medium", "exception_handling": "medium", "type_error": "low",
    "logic_error": "medium", "off_by_one": "medium", "input_validation": "medium",
    "state_management": "low", "performance_issue": "low", "api_misuse": "low",
}

# --- fixed values: caps of the mining job ---------------------------------------------
CATEGORY_CAPS = {
    "state_management": 280, "logic_error": 250, "null_pointer": 160, "async_error": 90,
    "exception_handling": 70, "type_error": 50, "input_validation": 30, "api_misuse": 20,
    "security_vulnerability": 20, "performance_issue": 20, "off_by_one": 20, "resource_leak": 20,
}
DEFAULT_CATEGORY_CAP = 150
DEFAULT_PER_REPOSITORY = 4

# --- fixed values: commit message words -----------------------------------------------
FIX_WORDS = [
    "fix(es|ed)?", "bug(fix)?", "patch", "hotfix", "resolve(d)?", "issue", "error", "crash",
    "exception", "validation", "sanitize", "security", "prevent", "handle", "missing",
    "undefined", "null", "promise", "await", "leak", "bounds", "race", "async",
]
NON_FIX_WORDS = [
    "docs?", "readme", "license", "format", "prettier", "eslint", "lint", "style", "refactor",
    "rename", "merge", "release", "version", "dependency", "package", "npm", "yarn", "pnpm",
    "lockfile", "ci", "workflow",
]
BLOCKED_OWNERS = [
    "facebook", "google", "microsoft", "nestjs", "expressjs", "vercel", "reduxjs", "nodejs",
    "vuejs", "angular", "mongodb", "prisma", "sequelize", "typeorm", "axios", "fastify", "koa",
    "strapi", "helmet", "twitter", "netflix", "airbnb", "uber", "aws", "gcp",
]

# --- fixed values: path rules ---------------------------------------------------------
SOURCE_EXTENSIONS = ["js", "jsx", "ts", "tsx"]
IGNORED_DIRS = [
    "node_modules", "build", "dist", ".git", ".next", "out", "coverage", ".cache",
    "__pycache__", "public", "static", ".vscode", ".idea", "tmp", "temp", "vendor",
]
SCAN_IGNORED_DIRS = ["node_modules", ".git", "dist", "build", ".next", "coverage"]
IGNORED_NAMES = [
    r"\.test\.(js|jsx|ts|tsx)$", r"\.spec\.(js|jsx|ts|tsx)$", r"\.min\.js$", r"\.d\.ts$",
    r"setupTests", r"reportWebVitals", r"serviceWorker", r"sw\.js$", r"polyfill",
    r"webpack\.config", r"babel\.config", r"jest\.config", r"vite\.config",
    r"rollup\.config", r"\.stories\.",
]
# role, pattern on the lower-cased path; first match wins
FILE_ROLES = [
    ("hook", r"/hooks?/"),
    ("controller", r"/controllers?/"),
    ("route", r"/routes?/"),
    ("model", r"/models?/"),
    ("middleware", r"/middleware/"),
    ("store", r"/(store|redux|slices?|context)/"),
    ("config", r"/(config|settings)/"),
    ("component", r"/(components?|ui|views?|pages?)/"),
    ("utility", r"/(utils?|helpers?|lib|services?|api)/"),
    ("entry", r"/(index|main|app)\.(js|jsx|ts|tsx)$"),
]
HOOK_NAME = r"use[A-Z]"
HANDLER_PREFIXES = ["get", "post", "put", "patch", "delete", "handle"]
# component, substrings of the lower-cased path; first match wins
COMPONENT_WORDS = [
    ("authentication", ["auth", "jwt", "login", "passport", "oauth", "session"]),
    ("authorization", ["role", "acl", "permission", "guard", "policy"]),
    ("database", ["db", "database", "orm", "entity", "prisma", "typeorm", "mongoose", "mongo", "sql", "migration"]),
    ("ui", ["ui", "component", "view", "page", "css", "style", "react", "vue", "angular", "theme", "modal", "button"]),
    ("frontend", ["frontend", "client", "web", "public", "assets"]),
    ("filesystem", ["fs", "file"]),
    ("storage", ["disk", "storage", "upload", "path"]),
    ("api", ["api"]),
    ("network", ["net", "http", "socket", "fetch", "axios", "request", "endpoint"]),
    ("build_system", ["build", "webpack", "vite", "tsconfig", "package.json", "rollup", "babel", "gulp"]),
    ("configuration", ["config", "env", "settings", "option"]),
    ("backend", ["backend", "server", "core", "service", "controller", "handler"]),
]
METHOD_ROLES = {
    "frontend": "Frontend React Component / Hook",
    "route": "Backend Express Route Controller / Middleware",
    "model": "Database Mongoose Model / Schema",
    "service": "API Client Service / Network Boundary",
    "utility": "Utility / Data Transformer",
    "other": "Application Business Logic",
}
LINT_CATEGORIES = [
    ("security", ["security", "eval", "injection"]),
    ("react", ["hook", "react"]),
    ("async", ["async", "await", "promise"]),
    ("type", ["typescript", "type"]),
]

# --- fixed values: literals of the change signature and the structural score -----------
GUARD_LITERALS = [
    "if (", "if(", "?.", "=== null", "!== null", "=== undefined", "!== undefined", "typeof",
    "length >", "length ===",
]
ASYNC_LITERALS = ["await", "async", "Promise"]
COMPARISON_LITERALS = [">", "<", ">=", "<=", "===", "!==", "==", "!="]
CALL_LITERALS = ["fetch(", "axios.", "api.", "authenticate("]
DEEP_ACCESS_LITERALS = [".profile.", ".user.", ".data.items"]
DEFECT_WEIGHTS = {
    "unawaited_call": 0.25, "async_without_catch": 0.15, "inclusive_length_bound": 0.30,
    "hook_without_guard": 0.25, "deep_access": 0.20, "compare_if_return": 0.20,
}
DEFECT_CAP = 0.40

# --- fixed values: retrieval score, gate, cost, progress, grades ------------------------
VECTOR_WEIGHT = 0.40
TEXT_WEIGHT = 0.60
SCORE_GAIN = 1.5
SCORE_FLOOR = 0.05
SCORE_CEILING = 0.98
GATE_THRESHOLD = 0.50
SMALL_SCAN_METHODS = 3
SMALL_SCAN_SCORE = 0.88
COST_PER_CLEAN_METHOD = 0.003
PROGRESS_STEPS = 11
GRADE_POINTS = {"critical": 25, "major": 15, "minor": 5}
GRADE_LIMITS = {"C": 70, "B": 85}
TOKEN_PATTERN = r"\w+|[+\-*/=<>!&|?:.,]"
RETRIEVAL_TERMS = 1500

# --- fixed values: lookup texts per type ------------------------------------------------
DESCRIPTIONS = {
    "async_error": "Missing or incorrect handling of an asynchronous operation (e.g. unhandled Promise, missing await).",
    "null_pointer": "Missing null/undefined check before property access or function call.",
    "logic_error": "Flawed conditional expression or business logic calculation.",
    "type_error": "Mismatched type conversion or unsafe type assertion.",
    "api_misuse": "Incorrect API method signature or invalid configuration options.",
    "security_vulnerability": "Security flaw (e.g. un-sanitized input, missing authentication/authorization check).",
    "off_by_one": "Off-by-one boundary comparison error in loop or array indexing.",
    "exception_handling": "Missing try/catch block around risky runtime operation.",
    "resource_leak": "Unclosed database connection, socket, or uncleared timer/event listener.",
    "performance_issue": "Sub-optimal computation, missing memoization, or heavy unindexed query.",
    "input_validation": "Missing boundary validation or schema check on incoming parameters/body.",
    "state_management": "Stale React state closure or improper state mutation in hooks/reducers.",
}
SUGGESTED_FIXES = {
    "async_error": "Add `await` before Promise execution or return `.then()` / `.catch()` chain.",
    "null_pointer": "Add optional chaining (`?.`), nullish coalescing (`??`), or defensive `if (obj)` guard.",
    "logic_error": "Review boolean comparison operators (`===`, `!==`, `&&`, `||`) and branch logic.",
    "type_error": "Use explicit type casting/conversion (`Number()`, `String()`, or TS type guards).",
    "api_misuse": "Verify parameter signatures and option object properties against API documentation.",
    "security_vulnerability": "Apply input sanitization, parameterized queries, or authorization check.",
    "off_by_one": "Check loop condition bounds (`<` vs `<=`) or array index offsets (`i - 1`).",
    "exception_handling": "Wrap risky execution in `try { ... } catch (err) { ... }` block.",
    "resource_leak": "Call `.close()`, `.disconnect()`, `clearInterval()`, or handle cleanup in `finally`.",
    "performance_issue": "Apply `useMemo`, `useCallback`, debouncing, or database indexing.",
    "input_validation": "Validate req.body / req.params using schema validators (Joi, Zod, or type guards).",
    "state_management": "Use functional state updates (`prev => ...`) or include missing dependencies in hooks.",
}

# --- fixed values: framework signatures (dependency names, path patterns) ----------------
FRAMEWORKS = [
    ("react", ["react", "react-dom"], [r"(?i)\.jsx$", r"(?i)\.tsx$"]),
    ("redux", ["redux", "@reduxjs/toolkit", "react-redux"], []),
    ("reactQuery", ["@tanstack/react-query", "react-query"], []),
    ("mongoose", ["mongoose"], []),
    ("express", ["express"], []),
    ("next", ["next"], [r"(?i)/pages/", r"(?i)/app/"]),
    ("vite", ["vite"], [r"(?i)vite\.config"]),
    ("typescript", ["typescript"], [r"\.tsx?$"]),
    ("tailwind", ["tailwindcss"], []),
    ("axios", ["axios"], []),
    ("jwt", ["jsonwebtoken"], []),
    ("bcrypt", ["bcrypt", "bcryptjs"], []),
    ("socket", ["socket.io", "socket.io-client"], []),
    ("zustand", ["zustand"], []),
    ("prisma", ["prisma", "@prisma/client"], []),
]
LAYOUT_PATTERNS = {
    "front": r"(?i)^(frontend|client)/",
    "back": r"(?i)^(backend|server)/",
    "next": r"(?i)(/pages/|/app/page\.)",
    "react_file": r"(?i)\.jsx?$",
    "react_dir": r"(?i)/(components?|pages?|src)/",
    "express_dir": r"(?i)/(routes?|controllers?|middleware)/",
    "typescript": r"\.(ts|tsx)$",
}
# stack label, dependency names that switch it on
STACK_LABELS = [
    ("React 18", ["react"]),
    ("Express.js", ["express"]),
    ("MongoDB/Mongoose", ["mongodb", "mongoose"]),
    ("Next.js", ["next"]),
    ("Redux", ["redux", "@reduxjs/toolkit"]),
]
FULLSTACK_LABEL = "MERN Fullstack Architecture"
DEFAULT_STACK = "JavaScript / TypeScript"
FRONT_DIRS = r"(?i)(^|/)(frontend|client)/|^(ui|web)/"
BACK_DIRS = r"(?i)(^|/)(backend|server)/|^api/"

# --- fixed values: search topics ---------------------------------------------------------
GENERIC_TOPICS = [
    "topic:mern", "topic:express", "topic:react", "topic:nodejs", "topic:mongodb", "topic:nextjs",
    "topic:typescript", "topic:nest", "topic:fastify", "topic:gatsby", "topic:remix", "topic:koa",
    "topic:vue", "topic:nuxt", "topic:svelte", "topic:fullstack",
]
