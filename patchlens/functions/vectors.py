"""Vector columns: array expressions and the two token-count extractors."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions.patterns import bind, found, java, occurrences

# --- fixed values: slot positions and patterns of the 64-slot extractor --------------------
# slot: pattern, literal that every match holds (None when there is no such literal)
SLOTS_64 = {
    2: (r"=>", "=>"), 3: (r"\bclass\b", "class"), 10: (r"\breturn\b", "return"),
    11: (r"\bif\b", "if"), 12: (r"\bfor\b|\bwhile\b", None), 17: (r"\bswitch\b", "switch"),
    18: (r"\bcase\b", "case"), 19: (r"\btry\b", "try"), 20: (r"\bcatch\b", "catch"),
    21: (r"\bthrow\b", "throw"), 38: (r"\bawait\b", "await"),
    47: (r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b", None),
    48: (r"['\"`](?:\\.|[^'\"`\n])*['\"`]", None), 49: (r"\b\d+(?:\.\d+)?\b", None),
    53: (r"\bimport\b", "import"), 54: (r"\bexport\b", "export"),
}
FUNCTION_SLOT, PROGRAM_SLOT, SIZE_SLOT, DEPTH_SLOT = 0, 57, 62, 63
FALLBACK_DEPTH, DEPTH_LIMIT = 2, 30
# --- fixed values: slot positions and patterns of the 120-slot extractor -------------------
SLOTS_120 = {
    2: (r"'.*?'|\".*?\"|`.*?`", None), 3: (r"\b\d+(\.\d+)?\b", None),
    4: (r"\b(true|false)\b", None), 5: (r"\bnull\b", "null"), 15: (r"=>", "=>"),
    18: (r"\b[a-zA-Z0-9_$]+\s*\(", "("), 19: (r"\?\.|[a-zA-Z0-9_$]+\.[a-zA-Z0-9_$]+", "."),
    20: (r"\?\.", "?."), 22: (r"typeof|instanceof|!|\+\+|--", None),
    24: (r"===|!==|==|!=|&&|\|\||<=|>=|<|>", None), 33: (r"\bawait\b", "await"),
    43: (r"\breturn\b", "return"), 47: (r"\bif\b", "if"), 51: (r"\btry\b", "try"),
    52: (r"\bcatch\b", "catch"), 53: (r"\bwhile\b", "while"), 55: (r"\bfor\b", "for"),
    58: (r"\bfunction\b", "function"), 61: (r"\bclass\b", "class"),
    89: (r"\bas\s+[a-zA-Z0-9_$]+", "as"),
}
BAG_SIZE, BLOCK_SLOT, SEEN_TYPES = 105, 39, 22
# slots repeated among the 15 closing numbers, after nodes, depth, half depth, seen types
REPEATED_120 = [58, 15, 61, 2, 3, 4, 5, 24, 22, 18, 19]


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def fit_dim(v: Column, n: int) -> Column:
    return F.slice(F.concat(v.cast("array<double>"), zeros(n)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def divided(v: Column, by: Callable[[Column], Column]) -> Column:
    """Elements over a number made from the whole vector, which is worked out once per row and not
    once per element. A divisor of 0 leaves the vector as it is."""
    def whole(t):
        return bind({"v": t["v"], "n": by(t["v"])}, lambda u: F.when(
            u["n"] != 0, F.transform(u["v"], lambda x: x / u["n"])).otherwise(u["v"]))

    return bind({"v": v.cast("array<double>")}, whole)


def l2_normalise(v: Column) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    return divided(v, norm)


def parse_vector(text: Column, n: int) -> Column:
    """JSON text to n numbers; anything else becomes zeros."""
    v = F.from_json(text, "array<double>")
    good = v.isNotNull() & (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull())
    return F.when(good, v).otherwise(zeros(n))


def delta_vector(after: Column, before: Column) -> Column:
    return F.zip_with(after, before, lambda a, b: a - b)


def is_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def concat_features(*blocks: Column) -> Column:
    return F.concat(*[b.cast("array<double>") for b in blocks])


def vector_stats(v: Column) -> Column:
    return F.struct(
        F.size(v).alias("length"),
        F.size(F.filter(v, lambda x: x != 0)).alias("nonzero"),
        F.transform(F.slice(v, 1, 8), lambda x: F.round(x, 4)).alias("head"))


def vector_json(v: Column, places: int = 8) -> Column:
    return F.to_json(F.transform(v, lambda x: F.round(x, places)))


def cosine(a: Column, b: Column, guard: float = 0.0) -> Column:
    """Cosine of two vectors; `guard` is added to each norm, 0 norms give 0."""
    size = (norm(a) + guard) * (norm(b) + guard)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def token_counts64(code: Column) -> dict[int, Column]:
    """Slot number to count column of the 64-slot extractor."""
    counts = {slot: occurrences(code, p, needs=lit) for slot, (p, lit) in SLOTS_64.items()}
    named = occurrences(code, r"\bfunction\b", needs="function")
    counts[FUNCTION_SLOT] = F.when(named > 0, named).otherwise(
        code.contains("=>").cast("int"))
    counts[PROGRAM_SLOT] = F.lit(1)
    return counts


def raw_vector64(counts: Column) -> Column:
    """Lay out the counts array, then size and depth, before scaling."""
    return F.concat(F.slice(counts, 1, SIZE_SLOT),
                    F.array(F.log1p(total(counts)), F.lit(min(FALLBACK_DEPTH, DEPTH_LIMIT) / DEPTH_LIMIT)))


def token_vector64(code: Column) -> Column:
    """Token counts by slot, log of their sum and nesting depth, scaled to unit length."""
    counts = token_counts64(code)
    slots = F.array(*[counts.get(i, F.lit(0)).cast("double") for i in range(SIZE_SLOT)])
    return l2_normalise(bind({"v": slots}, lambda t: raw_vector64(t["v"])))


def indent_depth(code: Column) -> Column:
    pads = F.transform(F.split(code, "\n"), lambda line: F.length(line)
                       - F.length(F.regexp_replace(line, java(r"^\s+"), "")))
    return F.floor(F.array_max(pads) / 2).cast("int") + 1


def _shape120(parts: Column) -> Column:
    """Bag, then closing numbers, from a struct of the counts, line count and depth."""
    bag, depth = parts["bag"], parts["depth"].cast("double")
    tail = [total(bag), depth, depth / 2, F.lit(float(SEEN_TYPES))]
    tail += [F.get(bag, F.lit(i)) for i in REPEATED_120]
    shape = F.concat(bag, F.array(*tail))
    return F.when(parts["blank"], zeros(BAG_SIZE + 15)).otherwise(shape)


def token_vector120(code: Column) -> Column:
    """Node-like token shares: 105 counts and 15 structural numbers over their sum."""
    counts = {slot: occurrences(code, p, needs=lit) for slot, (p, lit) in SLOTS_120.items()}
    counts[0] = F.lit(1)
    counts[BLOCK_SLOT] = F.size(F.split(code, "\n"))
    bag = F.array(*[counts.get(i, F.lit(0)).cast("double") for i in range(BAG_SIZE)])
    blank = code.isNull() | ~found(code, r"\S")
    parts = {"bag": bag, "depth": indent_depth(code), "blank": blank}
    return divided(bind(parts, _shape120), total)


def complexity_proxy(code: Column) -> Column:
    """Branch count, nesting depth and token count, read from the text."""
    branches = (
        occurrences(code, r"\b(if|for|while|catch)\b")
        + occurrences(code, r"\bdo\b\s*\{", needs="do")
        + occurrences(code, r"\?(?![.?:])", needs="?")
        + occurrences(code, r"&&|\|\||\?\?"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(acc, brace):
        now = F.greatest(F.lit(0), acc["now"] + F.when(brace == "{", 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(acc["top"], now).alias("top"))

    depth = F.aggregate(F.regexp_extract_all(code, F.lit(r"[{}]"), F.lit(0)), start, step,
                        lambda acc: acc["top"])
    return F.struct((branches + 1).alias("complexity"), (depth + 1).alias("max_depth"),
                    occurrences(code, r"\w+|[^\s\w]").alias("nodes"))


def geometry_slots(code: Column) -> Column:
    """Seven scaled shape numbers padded to 64."""
    def build(p):
        def capped(c, top):
            return F.least(c / top, F.lit(1.0))

        def every(pattern, by, lit):
            return occurrences(code, pattern, needs=lit) / by

        return F.concat(F.array(
            capped(p["nodes"], 100), capped(p["max_depth"], 20), capped(p["complexity"], 15),
            every(r"if\s*\(", 10, "if"), every(r"for\s*\(", 5, "for"),
            every(r"await\s+", 5, "await"), every(r"try\s*\{", 5, "try")), zeros(57))

    return bind({"p": complexity_proxy(code)}, lambda t: build(t["p"]))
