"""Driver queries of sessions, stores, lookups and code insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.operators import insights as I
from engram.operators import sessions as S
from engram.plans.proxies import SYMBOLS_SQL, symbols
from engram.plans.registry import Plans, quoted
from engram.sources import tables as T
from engram.sources.tables import table

P = Plans()
WITH = f"WITH {SYMBOLS_SQL}"

PAIRS_SQL = """pairs AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS pair, prompt, response FROM (
    SELECT conv_id, g, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS prompt, max(text) FILTER (role = 'assistant') AS response
    FROM (SELECT *, coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM conversations WHERE role IN ('user', 'assistant'))
    GROUP BY conv_id, g) WHERE prompt IS NOT NULL AND response IS NOT NULL)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return S.conversation_pairs(table(spark, sf, "conversations"))


@P.add(f"WITH {PAIRS_SQL} SELECT conv_id, CAST(pair AS BIGINT) AS pair, prompt, response FROM pairs")
def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


TRIM = r"'^\s+|\s+$', '', 'g'"
CLEAN = r"regexp_replace(regexp_replace(prompt, '\n{3,}', chr(10) || chr(10), 'g'), " + TRIM + ")"


@P.add(
    f"WITH {PAIRS_SQL} SELECT conv_id || '-0-' || pair AS id, {CLEAN} AS prompt, CASE WHEN length(response) > 4000 THEN left(response, 4000) || '...' ELSE response END AS response, "
    f"left('Question: ' || {CLEAN} || chr(10) || chr(10) || 'Answer: ' || left(response, 1500), 5000) AS embeddingText, '' AS language FROM pairs"
)
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return S.chunk_rows(pairs(spark, sf)).select("id", "prompt", "response", "embeddingText", "language")


LINES = r"[x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split({0}, chr(10))] IF x <> '']"
GOOD = "[x FOR x IN " + LINES + " IF length(x) > 15 AND NOT starts_with(x, '<')]"
FIRST = "coalesce(CASE WHEN length(" + GOOD + "[1]) > {1} THEN left(" + GOOD + "[1], {1}) || '...' ELSE " + GOOD + "[1] END, left(" + LINES + "[1], {1}), '')"


@P.add(f"WITH {PAIRS_SQL} SELECT conv_id, CAST(pair AS BIGINT) AS pair, left('Task: ' || {FIRST.format('prompt', 300)} || '. Approach: ' || {FIRST.format('response', 500)}, 500) AS summary FROM pairs")
def fallback_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("conv_id", "pair", X.fallback_summary(F.col("prompt"), F.col("response"), F.lit("")).alias("summary"))


@P.add("SELECT conv_id, left(sha256(string_agg(text, '' ORDER BY turn)), 16) AS contentHash FROM conversations GROUP BY conv_id")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return S.session_hashes(table(spark, sf, "conversations"))


# Texts made from the tables by expressions that both engines run.
TAGS = quoted(rf"(?i)<(?:{'|'.join(X.SYSTEM_TAGS)})[^>]*>[\s\S]*?</[^>]+>")
#: Turns as prompts: some within system tags, some with long gaps, with up to six lines of a file tree at the end.
PROMPT = """CASE turn % 3 WHEN 0 THEN '<user_info>os: ' || role || chr(10) || '</user_info>' WHEN 1 THEN '  <b>' || role || '</b>' || chr(10) || chr(10) || chr(10) || chr(10) ELSE '' END
  || CASE conv_id % 5 WHEN 0 THEN '<rules x=1>' || coalesce(text, '') || '</rules>' ELSE coalesce(text, '') || chr(10) || chr(10) || chr(10) || 'please' END || repeat(chr(10) || 'src/f.ts', CAST({files} AS INT))"""


@P.add(
    rf"SELECT conv_id, turn, CASE WHEN c <> '' THEN c ELSE left(raw, 500) END AS prompt FROM (SELECT conv_id, turn, raw, regexp_replace(regexp_replace(regexp_replace(kept, {TAGS}, '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {TRIM}) AS c "
    f"FROM (SELECT conv_id, turn, {PROMPT.format(files='conv_id % 7')} AS raw, {PROMPT.format(files='least(conv_id % 7, 3)')} AS kept FROM conversations))"
)
def clean_prompt(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(PROMPT.format(files="conv_id % 7"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clean_prompt(raw).alias("prompt"))


#: Documents as notes on changes, and as diffs.
NOTE = """coalesce(left(text, 120), '') || chr(10) || 'see src/' || source || '/f' || CAST(doc_id % 40 AS STRING) || '.py and pkg/' || lang || '/g' || CAST(doc_id % 3 AS STRING) || '.go' || CASE doc_id % 4 WHEN 0 THEN ', src/' || source || '/f' || CAST(doc_id % 40 AS STRING) || '.py'
  WHEN 1 THEN ' lib/node.js web/x.css' ELSE '' END || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'export function load' || CAST(doc_id AS STRING) || '() {}' || chr(10) || 'class Store' || CAST(doc_id % 9 AS STRING) || ' {}' || chr(10) || 'class Store1 {}' WHEN 1 THEN 'const total_' || CAST(doc_id AS STRING) || ' = 1' ELSE 'nothing' END"""
DIFF = """CASE doc_id % 4 WHEN 0 THEN '+ export const limit_' || CAST(doc_id AS STRING) || ' = 3' || chr(10) || '- let old_one = 1' || chr(10) || '+async function load() {}' WHEN 1 THEN '+++ b/' || lang WHEN 2 THEN coalesce(left(text, 80), '') ELSE '+interface Wide' || CAST(doc_id AS STRING) || ' {}' END"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.expr(NOTE).alias("body"), F.expr(DIFF).alias("diff"))


def found_sql(column: str, pattern: str, n: int) -> str:
    """The first n distinct matches, in order, joined."""
    every = f"[trim(x) FOR x IN regexp_extract_all({column}, {quoted(pattern)}, 1)]"
    return f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i)[1:{n}], ',')"


@P.add(f"SELECT doc_id, array_to_string([x FOR x IN string_split({found_sql('body', X.FILE_PATTERN, 1 << 20)}, ',') IF lower(x) NOT IN ({', '.join(map(quoted, X.NOT_FILES))})][1:20], ',') AS files FROM (SELECT doc_id, {NOTE} AS body FROM documents)")
def files_extract(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", F.array_join(X.files_changed(F.col("body")), ",").alias("files"))


@P.add(f"SELECT doc_id, {found_sql('body', X.SYMBOL_PATTERN, 30)} AS names, {found_sql('diff', X.ADDED_SYMBOL_PATTERN, 30)} AS added FROM (SELECT doc_id, {NOTE} AS body, {DIFF} AS diff FROM documents)")
def symbol_extract(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", F.array_join(X.symbols(F.col("body")), ",").alias("names"), F.array_join(X.added_symbols(F.col("diff")), ",").alias("added"))


@P.add(f"SELECT doc_id, {' OR '.join(f'contains(diff, {quoted(m)})' for m in X.CHANGE_MARKS)} AS changed FROM (SELECT doc_id, {DIFF} AS diff FROM documents)")
def code_change_detector(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select("doc_id", X.looks_like_change(F.col("diff")).alias("changed"))


@P.add("SELECT p_partkey AS id, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN '' WHEN a >= b AND a >= c THEN 'python' WHEN b >= c THEN 'go' ELSE 'typescript' END AS language FROM (SELECT p_partkey, p_size % 4 AS a, p_partkey % 3 AS b, p_partkey % 5 AS c FROM part)")
def language_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as notes that mention some Python, then some Go, then some TypeScript files."""
    named = lambda n, ext: F.when(F.expr(n) > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.expr(n).cast("int")), lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.lit(ext))))).otherwise("")
    body = F.concat_ws("\n", named("p_size % 4", ".py"), named("p_partkey % 3", ".go"), named("p_partkey % 5", ".ts"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.language_of(X.files_changed(body)).alias("language"))


@P.add("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR quality = 0")
def changed_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against an index of labelled ones whose hash is wrong where the quality is 0."""
    now = table(spark, sf, "documents").select("doc_id", X.content_hash(F.col("text")).alias("contentHash"))
    bad = table(spark, sf, "labels").select("doc_id", "quality")
    indexed = now.join(bad, "doc_id").select("doc_id", F.when(F.col("quality") == 0, F.lit("")).otherwise(F.col("contentHash")).alias("contentHash"))
    return S.new_or_changed(now, indexed, "doc_id")


@P.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_vs_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return T.without_keys(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@P.add("SELECT doc_id, n_chars, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, CAST(quality AS BIGINT), NULL FROM labels")
def upsert_view(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return T.upserted(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), new, "doc_id")


@P.add("SELECT doc_id, 'stale' AS state FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0) UNION ALL SELECT vec_id, 'missing' FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id NOT IN (SELECT doc_id FROM documents)")
def stale_missing(spark: SparkSession, sf: str) -> DataFrame:
    present = table(spark, sf, "embeddings").filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("doc_id"))
    return I.stale_and_missing(table(spark, sf, "documents"), present, "doc_id")


@P.add("SELECT doc_id, n_chars, lang, coalesce(NULL, 'transcript') AS source, CAST(0.7 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS version FROM documents")
def schema_migration(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as Y

    shape = Y.StructType([Y.StructField("doc_id", Y.LongType()), Y.StructField("n_chars", Y.LongType()), Y.StructField("lang", Y.StringType()), *(T.SOLUTIONS[c] for c in ("source", "confidence", "version"))])
    return T.migrated(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), shape, T.SOLUTION_DEFAULTS)


@P.add("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND contains(p_name, 'r')")
def filter_conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter("p_brand = 'Brand#2' and p_type = 'ECONOMY' and contains(p_name, 'r')").select(F.col("p_partkey").alias("id"))


FILES = "source || '/' || lang || '/' || doc_id"


@P.add(f"SELECT doc_id AS id FROM documents WHERE contains(lower({FILES}), '/en/1') ORDER BY doc_id LIMIT 20")
def search_by_file(spark: SparkSession, sf: str) -> DataFrame:
    from engram.plans.retrieval import chunks

    return T.capped(chunks(spark, sf).filter(F.contains(F.lower("files"), F.lit("/EN/1".lower()))), ["id"], ["id"], 20)


@P.add(f"SELECT doc_id AS id, CAST(row_number() OVER (ORDER BY doc_id % 60 DESC, doc_id) AS BIGINT) AS nth FROM documents WHERE contains({FILES}, 'src1/')")
def timeline_by_file(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from engram.plans.retrieval import chunks

    found = chunks(spark, sf).filter(F.contains("files", F.lit("src1/")))
    return found.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_last("timestamp"), "id")).cast("long").alias("nth"))


@P.add(f"{WITH} SELECT id FROM symbols WHERE ends_with(path, '/7.ts') ORDER BY id LIMIT 50")
def symbols_by_path_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return T.capped(symbols(spark, sf).filter(F.endswith("path", F.lit("/7.ts"))), ["id"], ["id"], 50)


@P.add(f"{WITH} SELECT id FROM symbols WHERE starts_with(symbol, '12') OR contains(symbol, '.12') ORDER BY id LIMIT 20")
def symbols_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return T.capped(symbols(spark, sf).filter(F.startswith("symbol", F.lit("12")) | F.contains("symbol", F.lit(".12"))), ["id"], ["id"], 20)


@P.add(f"{WITH} SELECT 'caller' AS relation, id FROM symbols WHERE list_contains(string_split(calls, ','), '12') UNION ALL SELECT 'importer', id FROM symbols WHERE contains(imports, '12:') UNION ALL SELECT 'callee', s.id FROM symbols s WHERE s.symbol IN (SELECT unnest(string_split(calls, ',')[1:10]) FROM symbols WHERE symbol = '12')")
def callers_callees_importers(spark: SparkSession, sf: str) -> DataFrame:
    """The three neighbourhoods of a symbol; callers by whole names, importers by substring."""
    rows = symbols(spark, sf)
    of = lambda r, d: d.select(F.lit(r).alias("relation"), "id")
    callees = rows.filter("symbol = '12'").select(F.explode(F.slice(I.csv("calls"), 1, 10)).alias("symbol"))
    return of("caller", rows.filter(F.array_contains(I.csv("calls"), "12"))).union(of("importer", rows.filter(F.contains("imports", F.lit("12:"))))).union(of("callee", rows.join(callees, "symbol", "left_semi")))


@P.add(f"SELECT * FROM (SELECT 'rows' AS kind, '' AS name, count(*) AS n FROM documents UNION ALL SELECT 'agents', '', count(DISTINCT source) FROM documents UNION ALL (SELECT 'file', source || '/' || lang, count(*) FROM documents GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10))")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return I.store_stats(table(spark, sf, "documents").select(F.col("source").alias("agent"), F.concat_ws("/", "source", "lang").alias("files")))


@P.add("SELECT p_brand AS path, count(*) AS n, max(p_partkey) AS modified FROM part GROUP BY 1 ORDER BY modified DESC, path LIMIT 10")
def recent_files(spark: SparkSession, sf: str) -> DataFrame:
    return I.recent_files(table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("lastModified")), 10)


@P.add("SELECT conv_id FROM (SELECT conv_id, max(turn) AS t FROM conversations GROUP BY 1) ORDER BY t DESC, conv_id LIMIT 10")
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t"))
    return last.orderBy(F.desc("t"), "conv_id").limit(10).select("conv_id")


@P.add(f"{WITH} SELECT symbolType AS value, count(*) AS n, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM symbols) + 0.5) AS BIGINT) AS percentage FROM symbols GROUP BY 1")
def type_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return I.distribution(symbols(spark, sf), "symbolType")


@P.add(f"{WITH} SELECT language AS value, count(*) AS n, CAST(floor(count(*) * 100.0 / (SELECT count(*) FROM symbols) + 0.5) AS BIGINT) AS percentage FROM symbols GROUP BY 1")
def language_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return I.distribution(symbols(spark, sf), "language")


@P.add(f"{WITH} SELECT path, count(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, path LIMIT 15")
def hot_files(spark: SparkSession, sf: str) -> DataFrame:
    return I.hot_files(symbols(spark, sf))


@P.add("SELECT doc_id AS symbol, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents ORDER BY lines DESC, symbol LIMIT 15")
def largest_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return I.largest(table(spark, sf, "documents").select(F.col("doc_id").alias("symbol"), F.col("text").alias("body")))


CALLERS = "callers AS (SELECT symbol, count(*) AS callers FROM (SELECT unnest(string_split(calls, ',')) AS symbol FROM symbols) WHERE symbol <> '' GROUP BY 1)"
IMPORTERS = "importers AS (SELECT symbol, count(*) AS importers FROM (SELECT split_part(unnest(string_split(imports, ',')), ':', 1) AS symbol FROM symbols) WHERE symbol IN (SELECT symbol FROM symbols) GROUP BY 1)"
LINKS = f"{WITH}, {CALLERS}, {IMPORTERS}, links AS (SELECT symbol, coalesce(callers, 0) AS callers, CASE WHEN calls = '' THEN 0 ELSE len(string_split(calls, ',')) END AS callees, coalesce(importers, 0) AS importers, coalesce(callers, 0) + CASE WHEN calls = '' THEN 0 ELSE len(string_split(calls, ',')) END + coalesce(importers, 0) AS total FROM symbols LEFT JOIN callers USING (symbol) LEFT JOIN importers USING (symbol))"


@P.add(f"{WITH}, {CALLERS} SELECT * FROM callers")
def caller_counts(spark: SparkSession, sf: str) -> DataFrame:
    return I.caller_counts(symbols(spark, sf))


@P.add(f"{WITH}, {IMPORTERS} SELECT * FROM importers")
def importer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return I.importer_counts(symbols(spark, sf))


@P.add(f"{WITH}, {CALLERS}, {IMPORTERS} SELECT id FROM symbols WHERE symbolType = 'function' AND symbol NOT IN (SELECT symbol FROM callers) AND symbol NOT IN (SELECT symbol FROM importers)")
def dead_code(spark: SparkSession, sf: str) -> DataFrame:
    return I.dead_code(symbols(spark, sf)).select("id")


@P.add(f"{LINKS} SELECT * FROM links ORDER BY total DESC, symbol LIMIT 15")
def most_connected(spark: SparkSession, sf: str) -> DataFrame:
    return I.most_connected(I.connections(symbols(spark, sf)))


@P.add(f"{LINKS} SELECT median(total)::DOUBLE AS median FROM links")
def median_connections(spark: SparkSession, sf: str) -> DataFrame:
    return I.median_connections(I.connections(symbols(spark, sf)))


@P.add(f"{LINKS} SELECT * FROM (SELECT * FROM links ORDER BY total DESC, symbol LIMIT 15) WHERE total >= greatest(3 * (SELECT median(total) FROM links), 5)")
def god_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return I.god_symbols(I.connections(symbols(spark, sf)))


@P.add(f"{WITH}, few AS (SELECT *, path AS p FROM symbols), {IMPORTERS} SELECT symbol, importers, CAST(floor(importers * 100.0 / f + 0.5) AS BIGINT) AS percentage FROM importers, (SELECT count(DISTINCT language) AS f FROM symbols) WHERE importers >= greatest(floor(f * 0.3 + 0.5), 3) ORDER BY importers DESC, symbol LIMIT 15")
def high_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """With languages for files, as no part is imported by 30 % of the paths."""
    return I.high_fan_in(symbols(spark, sf).withColumn("path", F.col("language")))


DIR = "array_to_string(list_filter_dirs, '/')"
DIRECTORY = "split_part(path, '/', 2) || '/' || split_part(path, '/', 3)"


@P.add(
    f"{WITH}, {CALLERS}, {IMPORTERS}, dead AS (SELECT id FROM symbols WHERE symbolType = 'function' AND symbol NOT IN (SELECT symbol FROM callers) AND symbol NOT IN (SELECT symbol FROM importers)) "
    f"SELECT {DIRECTORY} AS directory, count(*) AS symbols, floor(avg(complexity) * 10 + 0.5) / 10 AS complexity, count(d.id) AS dead, CAST(floor(count(*) FILTER (documented) * 100.0 / count(*) + 0.5) AS BIGINT) AS documented, "
    "string_agg(DISTINCT language, ',' ORDER BY language) AS languages, arg_min(symbol, (-complexity, symbol)) AS top FROM symbols s LEFT JOIN dead d ON s.id = d.id GROUP BY 1 ORDER BY symbols DESC, directory LIMIT 20"
)
def directory_insights(spark: SparkSession, sf: str) -> DataFrame:
    return I.directory_insights(symbols(spark, sf))


@P.add(
    f"{WITH} SELECT \"from\", \"to\", count(*) AS n FROM (SELECT {DIRECTORY} AS \"from\", split_part(unnest(string_split(imports, ',')), ':', 1) AS symbol FROM symbols) JOIN (SELECT symbol, {DIRECTORY} AS \"to\" FROM symbols) USING (symbol) "
    'WHERE "from" <> "to" GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20'
)
def cross_directory_edges(spark: SparkSession, sf: str) -> DataFrame:
    return I.cross_directory_imports(symbols(spark, sf))


@P.add(f"{WITH} SELECT floor(count(*) * 10.0 / count(DISTINCT path) + 0.5) / 10 AS average FROM symbols")
def avg_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return I.average_per_file(symbols(spark, sf))


@P.add(f"{WITH} SELECT CAST(floor(count(*) FILTER (documented) * 100.0 / count(*) + 0.5) AS BIGINT) AS percentage FROM symbols")
def doc_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return I.documentation_coverage(symbols(spark, sf))


@P.add("SELECT text AS path, lang AS symbol, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def exact_text_dups(spark: SparkSession, sf: str) -> DataFrame:
    return I.duplicate_rows(table(spark, sf, "documents").select(F.col("text").alias("path"), F.col("lang").alias("symbol")))


@P.add("SELECT min(l_partkey * 100000 + l_orderkey) AS id FROM (SELECT * FROM lineitem) GROUP BY l_orderkey, l_linenumber")
def dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100000 + F.col("l_orderkey")).alias("id"))
    return I.first_rows(rows, ["l_orderkey", "l_linenumber"], ["id"]).select("id")


@P.add("SELECT CAST(min(length(text)) AS BIGINT) AS least, CAST(floor(avg(length(text)) + 0.5) AS BIGINT) AS mean, CAST(max(length(text)) AS BIGINT) AS most FROM documents")
def embedding_text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return I.text_lengths(table(spark, sf, "documents"))


@P.add(f"{WITH}, present AS (SELECT DISTINCT path FROM symbols WHERE NOT ends_with(path, '/3.ts')) SELECT 'stale' AS issue, 'warning' AS severity, count(DISTINCT path) AS n FROM symbols WHERE path NOT IN (SELECT path FROM present)")
def index_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = symbols(spark, sf)
    return I.index_health(rows, rows.filter(~F.endswith("path", F.lit("/3.ts"))))


@P.add(f"{WITH} SELECT symbolType, count(*) AS n, array_to_string(list_sort(list(symbol))[1:5], ',') AS first FROM symbols GROUP BY 1")
def symbols_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return I.symbols_by_type(symbols(spark, sf))


@P.add(
    "WITH c AS (SELECT DISTINCT p_brand AS file, o_orderkey AS commit, o_custkey AS author, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY date DESC, commit) AS k FROM c) "
    "SELECT file, count(*) AS changes, count(DISTINCT author) AS authors, strftime(max(date), '%Y-%m-%d') AS last, string_agg(commit, ',' ORDER BY k) FILTER (k <= 5) AS recent FROM n GROUP BY file"
)
def git_file_metadata(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    commits = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = commits.select(F.col("p_brand").alias("file"), F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("date")).distinct()
    return I.file_metadata(rows).withColumn("last", F.date_format("last", "yyyy-MM-dd"))
