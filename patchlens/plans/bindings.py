"""Code-change tables derived from the driver's test tables, in Spark and in SQL.

The test tables hold prose, so common words are swapped for code tokens. Both forms apply the
same literal replacements to whole texts of all rows.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.rules import lexicon as L

# word -> code token, applied in this order
CODE_WORDS = [
    (". ", ".\n"), ("The ", "const the = (x) => { "), ("Of ", "function of(x) { "),
    ("And ", "} "), ("In ", "export "), ("Le ", "async function le(x) { "), ("La ", "} "),
    ("Der ", "const der = fetchAll(x); der "), ("El ", "async el(req, res) { "),
    (" the ", " await "), (" of ", " <= a.length "), (" and ", " if (!a.b) { "), (" in ", " => "),
    (" to ", " return "), (" is ", " !== null "), (" that ", " fetch( "),
    (" it ", " user.profile.email.name "), (" was ", " ?. "), (" with ", " try { "),
    (" on ", " } catch (e) "), (" as ", " as String "), (" are ", " useEffect( "),
    (" this ", " dispatch( "), (" from ", " function f( "), (" at ", " } // "), (" or ", " || "),
    (" an ", " parseInt( "), (" by ", " sanitize "), (" be ", " version "), (" for ", " for (i; i <= "),
    (" le ", " async "), (" la ", " .then( "), (" les ", " useMemo( "), (" des ", " validator.a( "),
    (" du ", " === true "), (" un ", " .close( "), (" et ", " && "), (" que ", " throw "),
    (" qui ", " const x = "), (" par ", " .slice( "), (" pour ", " typeof a === "),
    (" dans ", " cache "), (" der ", " class "), (" die ", " new Promise( "),
    (" und ", " setState( "), (" zu ", " res.status(500).json( "), (" den ", " headers: "),
    (" mit ", " axios.get( "), (" von ", " jwt.sign( "), (" ist ", " !== undefined "),
    (" de ", " switch "), (" el ", " case 1 "), (" los ", " import "), (" las ", " useState() .map( "),
    (" en ", " import 'x' "), (" del ", " config "), (" ein ", " x[i - 1] "), (" con ", " 12.5 "),
]
# part of a URL -> part of a source path, applied in this order
PATH_WORDS = [
    ("https://", ""), ("http://", ""), ("www.", "frontend/"), ("blog.", "backend/"),
    ("m.", "node_modules/"), ("example.com", "auth"), ("example.net", "Build"),
    ("example.org", "server"), ("/en/", "/src/components/"), ("/fr/", "/controllers/"),
    ("/es/", "/src/routes/"), ("/de/", "/hooks/"), (".html", ".jsx"),
    ("?page=2&ref=x", "/useThing.ts"), ("?utm_source=feed", ".test.js"), ("#top", ".tsx"),
]
OWNERS = ["facebook", "alice", "Google", "bob", "carol"]
TYPES = L.APPROVED_TYPES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_swap(expr: str, words: list[tuple[str, str]]) -> str:
    for old, new in words:
        expr = f"replace({expr}, {quote(old)}, {quote(new)})"
    return expr.replace("\n", "' || chr(10) || '")


def swap(column: Column, words: list[tuple[str, str]]) -> Column:
    pairs = [(old.encode(), new.encode()) for old, new in words]

    @F.arrow_udf("string")
    def swapped(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.cast(pa.binary()).to_pylist():
            if text is not None:
                for old, new in pairs:
                    text = text.replace(old, new)
            out.append(text)
        return pa.array(out, pa.binary()).view(pa.string())

    return swapped(column)


def pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(number, F.lit(len(values))).cast("int"))


def sql_pick(values: list[str], number: str) -> str:
    return f"([{', '.join(map(quote, values))}])[({number}) % {len(values)} + 1]"


class Tables:
    """Readers of one scale folder, with the derived tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self) -> DataFrame:
        """Documents over all cores."""
        return self.documents.repartition("doc_id")

    def snippets(self) -> DataFrame:
        d = self.texts()
        return d.select("doc_id", swap(F.col("text"), CODE_WORDS).alias("code"), "lang", "source")

    def pairs(self) -> DataFrame:
        """User turn as before-text, the following assistant turn as after-text."""
        c = self.conversations
        user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("_b"))
        answer = c.where("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_a"))
        p = F.col("pair_id")
        both = user.join(answer, ["conv_id", "turn"]).withColumn(
            "pair_id", F.col("conv_id") * 1000 + F.col("turn")).repartition("pair_id")
        number = F.col("conv_id") + F.col("turn")
        return both.select(
            "pair_id", "conv_id", "turn",
            F.when(p % 38 == 0, F.lit(None)).when(p % 19 == 0, F.lit("")).otherwise(swap(F.col("_b"), CODE_WORDS)).alias("before"),
            swap(F.when(p % 11 == 0, F.col("_b")).otherwise(F.col("_a")), CODE_WORDS).alias("after"),
            F.col("_a").alias("message"),
            F.concat(pick(OWNERS, F.col("conv_id")), F.lit("/repo"),
                     (F.col("conv_id") % 7).cast("string")).alias("repository"),
            F.concat(F.lit("src/"), pick(["api", "server", "ui", "pages"], number), F.lit("/f"),
                     F.col("turn").cast("string"),
                     pick([".js", ".ts", ".tsx", ".py"], F.col("conv_id"))).alias("file_path"),
            F.md5(p.cast("string")).alias("commit_hash"),
            pick(TYPES, number).alias("bug_type"),
            pick(L.SEVERITIES, F.col("conv_id")).alias("severity"))

    def paths(self) -> DataFrame:
        return self.pages.repartition("page_id").select("page_id", swap(F.col("url"), PATH_WORDS).alias("path"), "html")

    def steps(self) -> DataFrame:
        """Progress entries: user as scan, props number as step."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("user_id").alias("scan_id"), (k % L.PROGRESS_STEPS + 1).alias("step"), "ts",
            F.col("event_id").alias("id"), F.col("event_type").alias("title"))

    def ledger(self) -> DataFrame:
        """One method per event."""
        k = F.get_json_object("props", "$.k").cast("int")
        e = F.col("event_id")
        return self.events.select(
            F.col("user_id").alias("scan_id"), e.alias("method_id"),
            F.concat("event_type", F.lit(".js")).alias("file_path"), k.alias("complexity"),
            (e % 9).cast("int").alias("max_depth"), (F.col("value") >= 20).alias("suspicious"),
            pick(["Critical", "Major", "Minor"], e).alias("severity_level"))

    def patches(self) -> DataFrame:
        """A patch with one context line around each changed pair."""
        p = self.pairs().where("before IS NOT NULL")

        def lines(c):
            return F.size(F.split(F.col(c), "\n"))

        def marked(c, m):
            return F.concat(F.lit(m), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + m)))

        patch = F.concat(
            F.lit("@@ -10,"), (lines("before") + 2).cast("string"), F.lit(" +12,"),
            (lines("after") + 2).cast("string"), F.lit(" @@ top\n head line\n"),
            marked("before", "-"), F.lit("\n"), marked("after", "+"), F.lit("\n tail line"))
        return p.withColumns({"patch": patch, "additions": lines("after"),
                              "deletions": lines("before")})


def _cte(name: str, body: str) -> str:
    return f"{name} AS ({body})"


SNIPPETS = _cte("snippets", f"SELECT doc_id, {sql_swap('text', CODE_WORDS)} AS code, lang, source "
                            "FROM documents")
_N = "(a.conv_id + a.turn)"
_P = "(a.conv_id * 1000 + a.turn)"
PAIRS = _cte("pairs", f"""
SELECT {_P} AS pair_id, a.conv_id, a.turn,
  CASE WHEN {_P} % 38 = 0 THEN NULL WHEN {_P} % 19 = 0 THEN '' ELSE {sql_swap('a.text', CODE_WORDS)} END AS before,
  CASE WHEN {_P} % 11 = 0 THEN {sql_swap('a.text', CODE_WORDS)}
       ELSE {sql_swap('b.text', CODE_WORDS)} END AS after,
  b.text AS message,
  {sql_pick(OWNERS, 'a.conv_id')} || '/repo' || (a.conv_id % 7)::VARCHAR AS repository,
  'src/' || {sql_pick(['api', 'server', 'ui', 'pages'], _N)} || '/f' || a.turn::VARCHAR
    || {sql_pick(['.js', '.ts', '.tsx', '.py'], 'a.conv_id')} AS file_path,
  md5({_P}::VARCHAR) AS commit_hash,
  {sql_pick(TYPES, _N)} AS bug_type, {sql_pick(L.SEVERITIES, 'a.conv_id')} AS severity
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""")
PATHS = _cte("paths", f"SELECT page_id, {sql_swap('url', PATH_WORDS)} AS path, html FROM pages")
_K = "(props->>'k')::INT"
STEPS = _cte("steps", f"SELECT user_id AS scan_id, {_K} % {L.PROGRESS_STEPS} + 1 AS step, ts, "
                      "event_id AS id, event_type AS title FROM events")
LEDGER = _cte("ledger", f"""
SELECT user_id AS scan_id, event_id AS method_id, event_type || '.js' AS file_path,
  {_K} AS complexity, event_id % 9 AS max_depth, value >= 20 AS suspicious,
  {sql_pick(['Critical', 'Major', 'Minor'], 'event_id')} AS severity_level FROM events""")


# --- SQL pieces -----------------------------------------------------------------------------

def sql_fold(expr: str) -> str:
    """ASCII-only engines see letters outside ASCII as word characters."""
    return f"regexp_replace({expr}, '[^\\x00-\\x7F]', '_', 'g')"


def sql_found(expr: str, pattern: str, flags: str = "") -> str:
    mark = f"(?{flags})" if flags else ""
    return f"regexp_matches({expr}, {quote(mark + pattern)})"


def sql_times(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {quote(pattern)}))"


def sql_count(expr: str, literal: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {quote(literal)}, ''))) // {len(literal)})"


def sql_any(expr: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(x)})" for x in literals) + ")"


def sql_words(expr: str, words: list[str]) -> str:
    return sql_found(expr, r"\b(" + "|".join(words) + r")\b")


def sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sql_values(rows: list[tuple]) -> str:
    def one(x):
        return quote(x) if isinstance(x, str) else ("NULL" if x is None else str(x))

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
