"""Regex tables of the category scorer, as (category, pattern, flags) rows.

Flags: i = ignore case, s = dot matches newline. Tables are plain data: copy, edit, pass back in.
"""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    category: str
    pattern: str
    flags: str = ""


def _rules(table: dict[str, list]) -> list[Rule]:
    return [
        Rule(category, *(p if isinstance(p, tuple) else (p,)))
        for category, patterns in table.items()
        for p in patterns
    ]


# --- fixed values: current rules (12 categories, order breaks ties) -------------------
CATEGORY_RULES = _rules({
    "async_error": [
        r"\bawait\b", r"\.then\s*\(", (r"\bnew Promise\s*\(", "i"), r"\basync\s+function\b",
        r"\basync\s*\(", r"\.catch\s*\(",
    ],
    "exception_handling": [r"\btry\s*\{", r"\bcatch\s*\(", r"\bthrow\b", r"\bfinally\s*\{"],
    "null_pointer": [
        r"\?\.", r"!=\s*null", r"!==\s*null", r"!=\s*undefined", r"!==\s*undefined", r"\?\?",
        r"if\s*\(![a-zA-Z0-9_$.]+\)",
    ],
    "state_management": [
        (r"\buseeffect\b", "i"), (r"\busestate\b", "i"), (r"\busememo\b", "i"),
        (r"\busecallback\b", "i"), (r"\bdispatch\s*\(", "i"), (r"\bsetstate\s*\(", "i"),
        (r"\bcreateslice\b|\bcombine reducers\b|\breducer\s*\(", "i"), (r"\bzustand\b", "i"),
        (r"\bmobx\b|\bobservable\b|\baction\s*\(", "i"), (r"\brecoil\b", "i"),
    ],
    "security_vulnerability": [
        (r"\bsanitize\b", "i"), (r"\bescape(html)?\s*\(", "i"), (r"\bhelmet\b", "i"),
        (r"\bcors\s*\(", "i"), (r"\bjwt\.\w+\(|\bverify\s*\(.*token", "i"),
        (r"\bbcrypt\.\w+\(", "i"), (r"\bxss\b", "i"), (r"\bsql\s*inject", "i"),
        (r"\bnosql\s*inject", "i"),
        (r"req\.(body|params|query)[^\n]{0,80}(find|query|exec|\$where|eval)", "i"),
    ],
    "input_validation": [
        (r"\bvalidator\.\w+\(", "i"), (r"\bisvalid\w*\s*\(", "i"),
        (r"\bjoi\.\w+\(.*\)\.validate", "i"), (r"\bschema\.(parse|safeParse|validate)\s*\(", "i"),
        (r"\bzod\b.*\bparse\b", "i"), (r"\byup\.\w+\(.*\)\.validate", "i"),
        (r"\bz\.\w+\(\).*\.parse\(", "i"), (r"if\s*\(\s*!req\.(body|params|query)", "i"),
    ],
    "type_error": [
        (r"\bobjectid\b", "i"), r"\bparseint\s*\(", r"\bparsefloat\s*\(",
        r"\bas\s+[A-Z][a-zA-Z0-9_]*", r":\s*(string|number|boolean)\b", r"\.toString\s*\(",
        r"\bNumber\s*\(", r"\btypeof\s+\w+\s*[=!]==",
    ],
    "resource_leak": [
        r"\.close\s*\(", r"\.destroy\s*\(", r"\.disconnect\s*\(", r"\.unsubscribe\s*\(",
        (r"\bclearinterval\s*\(", "i"), (r"\bcleartimeout\s*\(", "i"),
        (r"\bremoveeventlistener\s*\(", "i"),
        (r"\bfinally\s*\{[^}]*(close|destroy|disconnect)", "is"),
        (r"\bredis\b.*(client|connection)", "i"), (r"\bpool\.(getConnection|end)\s*\(", "i"),
        (r"\bws\.close\s*\(", "i"), (r"MongoClient\.connect\s*\(", "i"),
    ],
    "off_by_one": [
        r"[<>]=?\s*\w+\.length", r"\.slice\s*\(", r"\.substring\s*\(",
        r"\[\s*i\s*[-+]\s*1\s*\]", (r"\bpage\s*\*\s*(limit|pagesize|page_size)\b", "i"),
        (r"\boffset\s*[-+]\s*1\b", "i"), r"for\s*\([^;]*;\s*\w+\s*<=\s*\w+\.length",
    ],
    "performance_issue": [
        (r"\busememo\s*\(", "i"), (r"\busecallback\s*\(", "i"), (r"\breact\.memo\s*\(", "i"),
        (r"\bdebounce\s*\(", "i"), (r"\bthrottle\s*\(", "i"), (r"\.createIndex\s*\(", "i"),
        r"\bReact\.lazy\s*\(", (r"\bfor\s*\([^)]*\)\s*\{[^}]*\bfor\s*\(", "s"),
    ],
    "api_misuse": [
        r"\bres\.status\s*\(\d+\)\.send\s*\(", r"\bres\.status\s*\(\d+\)\.json\s*\(",
        r"\baxios\.(get|post|put|delete|patch)\s*\(", r"\bfetch\s*\([^)]*\{\s*method",
        (r"\bgraphql`", "i"),
    ],
    "logic_error": [
        r"(===?|!==?)\s*(true|false|null|undefined|\d+)", r"\bif\s*\([^)]*(&&|\|\|)[^)]*\)",
    ],
})

# --- fixed values: older, looser rules of the heuristic miner ---------------------------
HEURISTIC_RULES = _rules({
    "async_error": [r"\bawait\b", r"\.then\s*\(", (r"\bpromise\b", "i"), r"\basync\s+function\b"],
    "exception_handling": [r"\btry\s*\{", r"\bcatch\s*\(", r"\bthrow\b", r"\bfinally\s*\{"],
    "null_pointer": [
        r"\?\.", r"!=\s*null", r"!==\s*null", r"!=\s*undefined", r"!==\s*undefined", r"\?\?",
        r"if\s*\(![a-zA-Z0-9_$.]+\)",
    ],
    "state_management": [
        (r"\buseeffect\b", "i"), (r"\busestate\b", "i"), (r"\busememo\b", "i"),
        (r"\busecallback\b", "i"), (r"\bdispatch\b", "i"), (r"\bsetstate\b", "i"),
        (r"\breducer\b", "i"), (r"\bzustand\b", "i"), (r"\bmobx\b", "i"), (r"\brecoil\b", "i"),
    ],
    "security_vulnerability": [
        (r"\bsanitize\b", "i"), (r"\bescape\b", "i"), (r"\bhelmet\b", "i"), (r"\bcors\b", "i"),
        (r"\bjwt\b", "i"), (r"\bbcrypt\b", "i"), (r"\bauth\b", "i"), (r"\bhash\b", "i"),
        (r"\bxss\b", "i"), (r"\bsql\s*inject", "i"),
    ],
    "input_validation": [
        (r"\bvalidator\b", "i"), (r"\bisvalid\b", "i"), r"\btypeof\b", r"\breq\.body\b",
        r"\breq\.params\b", r"\breq\.query\b", r"\bjoi\.\w+", r"\btrim\s*\(",
        (r"\bschema\b", "i"), (r"\bzod\b", "i"), r"\byup\.\w+", r"\bz\.\w+\(",
    ],
    "type_error": [
        (r"\bobjectid\b", "i"), r"\bparseint\b", r"\bparsefloat\b",
        r"\bas\s+[A-Z][a-zA-Z0-9_]*", r":\s*(string|number|boolean)\b", r"\btoString\s*\(",
        r"\bNumber\s*\(", r"\bString\s*\(",
    ],
    "resource_leak": [
        r"\bclose\s*\(", r"\bdestroy\s*\(", r"\bdisconnect\s*\(", r"\bunsubscribe\s*\(",
        (r"\bclearinterval\s*\(", "i"), (r"\bcleartimeout\s*\(", "i"),
        (r"\bremoveeventlistener\b", "i"), (r"\bfinally\s*\{.*(close|destroy|disconnect)", "is"),
        (r"\bredis\b", "i"), (r"\bconnection\s*pool\b", "i"), (r"\bsocket\.io\b", "i"),
        (r"\bws\.close\b", "i"),
    ],
    "off_by_one": [
        r"[<>]=?\s*\w+\.length", r"\bfor\s*\([^)]*[<>]=?", r"\+\+|--", r"\bslice\s*\(",
        r"\bsubstring\s*\(", r"\[\s*i\s*[-+]\s*1\s*\]", (r"\bpage\s*\*\s*limit\b", "i"),
        (r"\boffset\b", "i"),
    ],
    "performance_issue": [
        (r"\busememo\b", "i"), (r"\busecallback\b", "i"), r"\bmemo\s*\(", (r"\bdebounce\b", "i"),
        (r"\bthrottle\b", "i"), (r"\bcache\b", "i"),
        (r"\bindex(ed)?\b.*\bmongo|\.index\s*\(", "i"), (r"\bO\(n", "i"), (r"\blazy\b", "i"),
        r"\bReact\.lazy\b",
    ],
    "api_misuse": [
        (r"\boptions\b", "i"), (r"\bconfig\b", "i"), (r"\bheaders\b", "i"),
        r"\bmethod:\s*['\"]", r"\bres\.status\s*\(", r"\bres\.send\s*\(", r"\bres\.json\s*\(",
        r"\baxios\.\w+\(", (r"\bgraphql\b", "i"),
    ],
    "logic_error": [r"&&|\|\|", r"===?|!==?", r"\bif\s*\(", r"\belse\b"],
})
HEURISTIC_CAPS = {
    "logic_error": 310, "null_pointer": 226, "async_error": 227, "type_error": 197,
    "security_vulnerability": 192, "exception_handling": 254, "state_management": 299,
    "input_validation": 278, "off_by_one": 263, "api_misuse": 241, "performance_issue": 176,
    "resource_leak": 122,
}
# type: description, root cause, fix, pattern name
HEURISTIC_TEXTS = {
    "async_error": (
        "Missing or incorrect handling of an asynchronous operation.",
        "Asynchronous function executed without properly waiting for promise resolution.",
        "Added/corrected await or promise-chain handling.", "Async Handling Error"),
    "exception_handling": (
        "Missing or incomplete error handling around a risky operation.",
        "Unhandled runtime exception during execution.",
        "Wrapped risky operation in try/catch or added throw/finally handling.",
        "Missing Exception Guard"),
    "null_pointer": (
        "Missing null/undefined check before property access.",
        "Dereferencing potentially null or undefined value.",
        "Added null guard check / optional chaining / nullish coalescing.", "Missing Null Check"),
    "state_management": (
        "Incorrect React state update or hook dependency.",
        "Stale state closure or improper state mutation.",
        "Updated React state setter / hook dependencies.", "React State Error"),
    "security_vulnerability": (
        "Security vulnerability in request handling or auth.",
        "Potential unauthorized access or injection vulnerability.",
        "Applied sanitization, CORS, or authorization check.", "Security Vulnerability"),
    "input_validation": (
        "Missing input validation on payload or parameters.",
        "Invalid or un-sanitized user input processed by system.",
        "Added input boundary/schema check.", "Missing Input Validation"),
    "type_error": (
        "Mismatched type or unsafe type conversion.",
        "Type mismatch or implicit coercion failure.",
        "Added explicit type check or type conversion.", "Unsafe Type Conversion"),
    "resource_leak": (
        "Unclosed resource connection or event listener.",
        "Resource leak due to unreleased socket/timer/connection.",
        "Properly closed resource connection / cleared timer.", "Resource Leak"),
    "off_by_one": (
        "Off-by-one boundary comparison error.", "Incorrect loop bound or index comparison.",
        "Adjusted boundary index comparison operator.", "Off By One Error"),
    "performance_issue": (
        "Sub-optimal computation or un-memoized re-render.",
        "Performance degradation during heavy calculation.",
        "Applied memoization / optimization.", "Performance Bottleneck"),
    "api_misuse": (
        "Incorrect API method signature or invalid parameters.",
        "Misused library method arguments or options.",
        "Corrected method invocation argument signature.", "API Misuse"),
    "logic_error": (
        "Flawed condition or business logic calculation.", "Incorrect algorithm logic flow.",
        "Updated logical conditional expressions.", "Logic Error"),
}

# --- fixed values: signals any fix must show at least once ------------------------------
FIX_SIGNALS = [
    Rule("guard", r"\bif\s*\(", "i"),
    Rule("operator", r"\?\?|\?\.|!==?|===?"),
    Rule("nullish", r"\b(null|undefined)\b", "i"),
    Rule("async", r"\b(async|await|try|catch|throw|finally)\b", "i"),
    Rule("validation", r"\b(validate|validator|sanitize|schema|parse|check|isvalid)\b", "i"),
    Rule("bounds", r"\.length\b|\[\s*\w+\s*[-+]\s*1\s*\]|\.slice|\.substring"),
    Rule("cleanup", r"\b(close|destroy|unsubscribe|clearTimeout|clearInterval)\b", "i"),
    Rule("flow", r"\b(return|dispatch|setState|useState|useEffect)\b", "i"),
]

# --- fixed values: search topics per category -------------------------------------------
TOPIC_HINTS = {
    "exception_handling": [
        "topic:error-handling", "topic:try-catch", "topic:sentry", "topic:winston",
        "topic:logging", "topic:exception-handling", "topic:bunyan", "topic:pino"],
    "off_by_one": [
        "topic:pagination", "topic:array", "topic:infinite-scroll", "topic:slicing",
        "topic:pagination-component", "topic:table", "topic:datatable", "topic:carousel",
        "topic:virtual-list"],
    "state_management": [
        "topic:redux", "topic:react-hooks", "topic:context-api", "topic:zustand", "topic:mobx",
        "topic:recoil", "topic:state-management", "topic:jotai", "topic:valtio", "topic:pinia"],
    "api_misuse": [
        "topic:rest-api", "topic:api", "topic:axios", "topic:fetch-api", "topic:graphql",
        "topic:api-client", "topic:trpc", "topic:supertest", "topic:swr", "topic:react-query"],
    "input_validation": [
        "topic:express-validator", "topic:joi", "topic:zod", "topic:yup",
        "topic:form-validation", "topic:form", "topic:react-hook-form", "topic:formik",
        "topic:valibot"],
    "performance_issue": [
        "topic:performance", "topic:optimization", "topic:memoization", "topic:lazy-loading",
        "topic:caching", "topic:debounce", "topic:throttle", "topic:virtualization"],
    "resource_leak": [
        "topic:websocket", "topic:socket-io", "topic:database", "topic:redis",
        "topic:connection-pool", "topic:event-emitter", "topic:mongoose", "topic:knex",
        "topic:typeorm", "topic:prisma", "topic:pg", "topic:mysql"],
    "type_error": [
        "topic:typescript", "topic:type-checking", "topic:types", "topic:type-definitions"],
    "security_vulnerability": [
        "topic:security", "topic:authentication", "topic:jwt", "topic:oauth", "topic:passport",
        "topic:authorization", "topic:cors", "topic:helmet", "topic:xss", "topic:sanitization"],
    "async_error": [
        "topic:async", "topic:promises", "topic:async-await", "topic:rxjs", "topic:concurrency"],
}
