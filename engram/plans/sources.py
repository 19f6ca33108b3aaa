"""Driver queries of sources, parsers, embedding texts and the numbers that only user interfaces compute."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import code as C
from engram.functions import embedding as EM
from engram.functions import text as X
from engram.operators import insights as I
from engram.operators import symbols as SY
from engram.operators import views as V
from engram.plans.insights import LINKS
from engram.plans.proxies import SYMBOLS_SQL, symbols
from engram.plans.registry import Plans, quoted
from engram.sources import code_files as CF
from engram.sources import transcripts as TS
from engram.sources.tables import table

P = Plans()

def rendered(template: str, **fields: str) -> Column:
    """A text with @names replaced by columns, given as SQL; the oracles fill the same names."""
    out = F.lit(template)
    for name, column in fields.items():
        out = F.replace(out, F.lit(f"@{name}"), F.expr(column).cast("string"))
    return out


@P.add(
    "SELECT role, CASE turn % 4 WHEN 1 THEN text || chr(10) || role ELSE text END AS content FROM conversations WHERE turn % 4 <> 3"
)
def jsonl_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a transcript line: plain, as a list of items, nested, and every fourth one broken."""
    text, item = F.col("text"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    listed = F.struct("role", F.struct(F.array(item(text), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), item(F.col("role"))).alias("content")).alias("message"))
    nested = F.struct(F.struct("role", F.struct(text.alias("text")).alias("content")).alias("message"))
    line = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct("role", text.alias("content")))).when(F.col("turn") % 4 == 1, F.to_json(listed)).when(F.col("turn") % 4 == 2, F.to_json(nested))
    return TS.decoded(table(spark, sf, "conversations").select(F.coalesce(line, F.concat(F.lit("not json "), text)).alias("value"))).select("role", "content")


@P.add("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS commit, CAST(o_custkey AS VARCHAR) AS author, strftime(o_orderdate, '%Y-%m-%d') AS date, p_brand || '/' || p_type || '.ts' AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits of a name-only log: a head and the files, with an empty line after the first one."""
    lines, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    files = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("p_brand", F.lit("/"), "p_type", F.lit(".ts")))).alias("files"))
    head = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    log = orders.join(files, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(head, F.lit("\n"), F.get("files", F.lit(0)), F.lit("\n\n"), F.array_join(F.slice("files", 2, 1 << 30), "\n")).alias("value"))
    return CF.commit_files(log).select("commit", "author", "date", "file")


@P.add("SELECT left(sha256(text), 12) AS checkpointId, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 7 END AS sessionIndex, CASE WHEN doc_id % 3 = 0 THEN 'metadata.json' ELSE 'full.jsonl' END AS file FROM documents WHERE doc_id % 5 <> 0")
def checkpoint_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of a checkpoint tree; every fifth lies elsewhere."""
    h = F.sha2("text", 256)
    folder = F.concat(F.lit("x/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 10), F.lit("/"))
    file = F.when(F.col("doc_id") % 3 == 0, "metadata.json").otherwise(F.concat((F.col("doc_id") % 7).cast("string"), F.lit("/full.jsonl")))
    path = F.when(F.col("doc_id") % 5 == 0, "x/readme.md").otherwise(F.concat(folder, file))
    return TS.checkpoints(table(spark, sf, "documents").select(path.alias("path"), F.lit("").alias("value"))).drop("value")


#: extension -> (source with @k for a part's key and @n for its size, [(symbol, type, parameters, calls)])
TEMPLATES = {
    "py": (
        "MAX_@k = @n\n\ndef load_@k(path: str, n: int = @n) -> str:\n    return open_@k(path)\n\nclass Store@k(Base):\n    async def get(self, key, *, a, b, c, d, e):\n        return find_@k(key)\n",
        [("MAX_@k", "constant", 0, ""), ("load_@k", "function", 2, "open_@k"), ("Store@k", "class", 0, "get,find_@k"), ("Store@k.get", "method", 6, "find_@k")],
    ),
    "ts": (
        "import { walk@k as go@k } from './tree@k';\n\n// Finds things.\nexport function locate@k<T extends Node>(name: string, opts: { a: number, b?: T } = {}) {\n  return find@k(go@k(name));\n}\n\n@Sealed('x, y')\nclass Tree@k {\n  private async root(a, b, c, d = [1, 2], e, f, g, h) {\n"
        "    return locate@k(this);\n  }\n}\n\nexport interface Node@k {\n  id: string;\n}\ntype Id@k = string;\nexport const LIMIT_@k: number = @n;\nconst pick@k = x => x;\n"
        "class Line@k {\n  open = \"{\";\n  first() { return one@k('}'); } second() { return two@k(`{${\"}\"}`); }\n}\n\nnamespace Space@k {\n  export function inner@k() {\n    // lost@k() {\n    return /[{]/.test(three@k(\"(\"));\n  }\n}\n\nfunction last@k() { /* { */ return four@k(); }\n",
        [("locate@k", "function", 2, "find@k,go@k"), ("Tree@k", "class", 0, "root,locate@k"), ("Tree@k.root", "method", 8, "locate@k"), ("Node@k", "interface", 0, ""), ("Id@k", "type", 0, ""), ("LIMIT_@k", "constant", 0, ""), ("pick@k", "function", 1, ""),
         ("Line@k", "class", 0, "first,one@k,second,two@k"), ("Line@k.first", "method", 0, "one@k"), ("Line@k.second", "method", 0, "two@k"), ("inner@k", "function", 0, "test,three@k"), ("last@k", "function", 0, "four@k")],
    ),
    "go": (
        "package main\n\nconst (\n\tLow@k = iota\n\thigh@k\n)\n\ntype (\n\tStore@k struct {\n\t\tn int\n\t}\n\tName@k string\n)\n\nvar count@k = @n\n\nfunc (s *Store@k) Get(k, l string, rest ...int) int {\n\treturn lookup@k(k)\n}\n\nfunc run@k(func(int) error) {\n\tstart@k()\n}\n"
        "\nfunc text@k() string {\n\ts := \"}\"\n\treturn s + `{` + join@k(s)\n}\n\n// }{ gone@k(\nfunc tail@k() interface{} { return wrap@k('{') }\n",
        [("Low@k", "constant", 0, ""), ("high@k", "constant", 0, ""), ("Store@k", "class", 0, ""), ("Name@k", "type", 0, ""), ("count@k", "variable", 0, ""), ("Store@k.Get", "method", 3, "lookup@k"), ("run@k", "function", 0, "start@k"), ("text@k", "function", 0, "join@k"), ("tail@k", "function", 0, "wrap@k")],
    ),
    "rs": (
        "pub struct Store@k {\n    n: i32,\n}\n\nimpl Store@k {\n    pub fn get(&self, key: &'static str) -> i32 {\n        self.n\n    }\n}\n\npub trait Reader@k {\n    fn read(&self);\n}\n\nasync fn helper@k<'a, T: Into<String>>(x: &'a T, y: Vec<(i32, T)>) {\n    work@k();\n}\n"
        "\nmod inner@k {\n    pub mod deep@k { pub const END_@k: &str = \"}\"; }\n    pub fn find@k(c: char) -> bool { c == '{' || seek@k(r#\"}\"{\"#) }\n}\n\n/* { /* } */ */ fn tail@k() { done@k(); }\n",
        [("Store@k", "class", 0, ""), ("Store@k.get", "method", 1, ""), ("Reader@k", "interface", 0, "read"), ("helper@k", "function", 2, "work@k"), ("END_@k", "constant", 0, ""), ("find@k", "function", 1, "seek@k"), ("tail@k", "function", 0, "done@k")],
    ),
    "txt": ("function no@k() {}", []),
}
EXTENSION = "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TEMPLATES)) + " END"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A source file for every part, in the language that its key gives."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.expr(EXTENSION).alias("ext"))
    text = None
    for ext, (template, _) in TEMPLATES.items():
        one = rendered(template, k="p_partkey", n="p_size")
        text = F.when(F.col("ext") == ext, one) if text is None else text.when(F.col("ext") == ext, one)
    return rows.select(F.concat(F.lit("a/f"), F.col("p_partkey").cast("string"), F.lit("."), "ext").alias("path"), text.alias("text"))


SYMBOL_ROWS = " UNION ALL ".join(f"SELECT '{ext}' AS ext, '{s}' AS symbol, '{t}' AS symbolType, {n} AS parameters, '{c}' AS calls" for ext, (_, found) in TEMPLATES.items() for s, t, n, c in found)
SYMBOLS_FOUND = f"found AS (SELECT 'a/f' || p_partkey || '.' || f.ext AS path, replace(symbol, '@k', p_partkey::VARCHAR) AS symbol, symbolType, CAST(parameters AS INT) AS parameters, replace(calls, '@k', p_partkey::VARCHAR) AS calls FROM part JOIN ({SYMBOL_ROWS}) f ON f.ext = {EXTENSION})"


@P.add(f"WITH {SYMBOLS_FOUND} SELECT path, symbol, symbolType, parameters FROM found")
def symbol_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of every part's file, with the number of parameters that their metadata names."""
    return SY.symbols_of(files(spark, sf)).select("path", "symbol", "symbolType", C.parameters(F.col("metadata")).alias("parameters"))


@P.add(f"WITH {SYMBOLS_FOUND} SELECT path, symbol, calls, CASE WHEN symbolType = 'function' AND contains(calls, 'go') THEN 'go' || replace(symbol, 'locate', '') || ':./tree' || replace(symbol, 'locate', '') ELSE '' END AS imports FROM found WHERE symbolType IN ('function', 'method')")
def calls_and_imports(spark: SparkSession, sf: str) -> DataFrame:
    return SY.symbols_of(files(spark, sf)).filter("symbolType in ('function', 'method')").select("path", "symbol", "calls", "imports")


@P.add(f"WITH {SYMBOLS_FOUND} SELECT path, symbol, 'high' AS severity FROM found WHERE parameters > 7 UNION ALL SELECT path, symbol, 'medium' FROM found WHERE parameters BETWEEN 6 AND 7")
def long_parameter_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The anti-pattern over parsed files of all languages."""
    rows = SY.symbols_of(files(spark, sf)).withColumn("_low", F.lower("body"))
    c = F.col
    return rows.select("path", "symbol", F.explode(C.detected(c("symbol"), c("path"), F.lit(""), c("body"), c("metadata"), c("_low"))).alias("p")).filter("p.pattern = 'LongParameterList'").select("path", "symbol", "p.severity")


SIGNATURES = {
    "py": ("load_@k", "function load_@k (path: str, n: int) -> str"), "ts": ("locate@k", "function locate@k <T: Node> (name: string, opts: { a: number, b?: T } = {})"),
    "go": ("Store@k.Get", "method Store@k.Get (k: string, l: string, rest: ...int) -> int"), "rs": ("Store@k.get", "method Store@k.get (key: &'static str) -> i32"),
}


@P.add("SELECT replace(symbol, '@k', p_partkey::VARCHAR) AS symbol, replace(signature, '@k', p_partkey::VARCHAR) AS signature FROM part JOIN (" + " UNION ALL ".join(f"SELECT '{e}' AS ext, '{s}' AS symbol, {quoted(g)} AS signature" for e, (s, g) in SIGNATURES.items()) + f") g ON g.ext = {EXTENSION}")
def signature_text(spark: SparkSession, sf: str) -> DataFrame:
    key, ext = F.regexp_extract("path", r"f(\d+)\.", 1), F.substring_index("path", ".", -1)
    rows = SY.symbols_of(files(spark, sf)).filter(reduce(lambda a, b: a | b, ((ext == e) & (F.col("symbol") == F.replace(F.lit(s), F.lit("@k"), key)) for e, (s, _) in SIGNATURES.items())))
    return rows.select("symbol", EM.signature(F.col("symbolType"), F.col("symbol"), F.col("metadata")).alias("signature"))


@P.add(f"WITH {SYMBOLS_SQL} SELECT id, left(symbolType || ' ' || symbol || ' in ' || list_extract(string_split(path, '/'), -1) || CASE WHEN calls = '' THEN '' ELSE chr(10) || chr(10) || 'calls: ' || array_to_string(string_split(calls, ',')[1:10], ', ') END || chr(10) || chr(10) || left(body, 1800), 4000) AS text FROM symbols")
def symbol_embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    none, c = F.lit(None).cast("string"), F.col
    return symbols(spark, sf).select("id", EM.symbol_text(c("symbolType"), c("symbol"), c("path"), none, F.lit(""), I.csv("calls"), F.array().cast("array<string>"), c("body")).alias("text"))


@P.add("SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents")
def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return EM.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("length"))


@P.add("SELECT doc_id, CAST(length(s) AS BIGINT) AS length, CAST(len([x FOR x IN regexp_split_to_array(s, '[.!?]+') IF trim(x) <> '']) AS BIGINT) AS sentences FROM (SELECT doc_id, left(text, 300) AS s FROM documents)")
def summary_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = X.summary_quality(F.left("text", F.lit(300)))
    return table(spark, sf, "documents").select("doc_id", q["length"].cast("long").alias("length"), q["sentences"].cast("long").alias("sentences"))


AXES = {
    "Health": "1 - dead / n", "Density": "least(n / files / 20, 1)", "Connectivity": "least(median / 10, 1)", "Diversity": "least(languages / 5, 1)", "Spread": "least(files / 50, 1)", "Simplicity": "simple / n", "Docs": "documented / n",
}


@P.add(
    f"{LINKS}, f AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT path)::DOUBLE AS files, count(DISTINCT language)::DOUBLE AS languages, count(*) FILTER (complexity <= 5)::DOUBLE AS simple, count(*) FILTER (documented)::DOUBLE AS documented, "
    "(SELECT median(total) FROM links)::DOUBLE AS median, (SELECT count(*) FROM symbols WHERE symbolType = 'function' AND symbol NOT IN (SELECT symbol FROM callers) AND symbol NOT IN (SELECT symbol FROM importers))::DOUBLE AS dead FROM symbols) "
    + " UNION ALL ".join(f"SELECT '{k}' AS axis, CAST(floor(({v}) * 100 + 0.5) AS BIGINT) AS value FROM f" for k, v in AXES.items())
)
def health_radar(spark: SparkSession, sf: str) -> DataFrame:
    """The seven axes of the health radar."""
    return V.health_axes(symbols(spark, sf))


@P.add(f"WITH {SYMBOLS_SQL} SELECT language, CASE WHEN p >= 90 THEN 'excellent' WHEN p >= 70 THEN 'good' WHEN p >= 50 THEN 'fair' WHEN p >= 30 THEN 'poor' ELSE 'critical' END AS band FROM (SELECT language, count(*) FILTER (calls <> '') * 100.0::DOUBLE / count(*) AS p FROM symbols GROUP BY language)")
def usage_bands(spark: SparkSession, sf: str) -> DataFrame:
    """The colour band of the share of each language's symbols that call others."""
    used = F.count_if(F.col("calls") != "") * 100.0 / F.count(F.lit(1))
    return symbols(spark, sf).groupBy("language").agg(V.band(used).alias("band"))


@P.add(f"WITH {SYMBOLS_FOUND} SELECT path, symbol, symbolType, parameters FROM found")
def symbols_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols of every part's file by the table function, from SQL."""
    SY.register_parser(spark)
    parameters = "coalesce(json_array_length(get_json_object(s.metadata, '$.parameters')), 0)"
    return spark.sql(f"SELECT f.path, s.symbol, s.symbolType, {parameters} AS parameters FROM {{files}} f, LATERAL parse_symbols(f.path, f.text) s", files=files(spark, sf))


@P.add("SELECT conv_id, length(CASE WHEN length(t) > 400 THEN left(t, 240) || chr(10) || '...[truncated]...' || chr(10) || right(t, 160) ELSE t END) AS chars FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY 1)")
def truncated_input(spark: SparkSession, sf: str) -> DataFrame:
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(t.alias("t")).select("conv_id", F.length(X.head_and_tail(F.col("t"), 400)).cast("long").alias("chars"))
