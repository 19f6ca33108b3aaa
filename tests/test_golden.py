"""Known values of ranking, risk, health, PageRank, co-change and transcripts."""

import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import code as C
from engram.functions import scoring, text, vectors
from engram.functions.embedding import embedded, from_cache, hashing_embedder
from engram.operators import cochange, evaluate, graph, retrieval, sessions, similarity, trends
from engram.operators import symbols as SY
from engram.sources import code_files, tables, transcripts
from engram.streaming import events as EV


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pagerank_of_the_sample_graph(spark):
    pairs = [("main", "parseFile"), ("main", "processData"), ("parseFile", "readFile"), ("parseFile", "parseJSON"), ("processData", "validate"), ("processData", "transform"), ("transform", "validate")]
    e = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, edgeType string")
    ranks = {r.vertex: r["rank"] for r in graph.pagerank(e).collect()}
    want = {"validate": 0.063652, "readFile": 0.034406, "parseJSON": 0.034406, "transform": 0.034406, "parseFile": 0.030536, "processData": 0.030536, "main": 0.021429}
    assert {k: round(v, 6) for k, v in ranks.items()} == want
    assert sum(ranks.values()) == pytest.approx(0.249370, abs=1e-5)


def test_multi_signal_scores(spark):
    rows = [("processData", 0.85, 2, 1.0), ("getData", 0.75, 60, 1 / 3), ("data", 0.70, 1, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, score double, age int, popularity double")
    exact = scoring.exact_name_score(F.col("symbol"), F.lit("data"))
    s = scoring.multi_signal(exact, F.col("score"), F.col("popularity"), scoring.freshness(F.col("age")), scoring.simplicity(F.lit(1)), scoring.context_score(F.lit("a"), None, None))
    assert {r.symbol: round(r.s, 5) for r in df.select("symbol", s.alias("s")).collect()} == {"processData": 0.60925, "data": 0.4885, "getData": 0.45375}


@pytest.mark.parametrize(
    "body_lines, cyc, changes, authors, doc, score, level",
    [(10, 1, 1, 1, 0.1, 16.0, "low"), (20, 5, 12, 3, 1.0, 43.0, "medium"), (131, 51, 45, 7, 0.3, 76.0, "high")],
)
def test_risk_scores(spark, body_lines, cyc, changes, authors, doc, score, level):
    f = C.risk_factors(F.lit(cyc), F.lit(changes), F.lit(authors), F.lit(body_lines), F.lit(doc))
    r = one(spark, C.risk_score(f).alias("s"))
    assert r.s == pytest.approx(score)
    assert one(spark, C.risk_level(F.lit(r.s)).alias("l")).l == level


def test_health_and_trends(spark):
    rows = [("2025-01-01", 150, 8.5, 0.65, 2, 5, 1), ("2025-01-02", 160, 7.2, 0.72, 1, 3, 1)]
    df = spark.createDataFrame(rows, "timestamp string, totalSymbols long, avgComplexity double, documentationCoverage double, deadCodeCount long, duplicateSymbolCount long, godSymbolCount long")
    c = F.col
    df = df.withColumn("healthScore", trends.health_score(c("avgComplexity"), c("documentationCoverage"), c("deadCodeCount"), c("duplicateSymbolCount"), c("godSymbolCount"), c("totalSymbols")))
    assert [r.healthScore for r in df.orderBy("timestamp").collect()] == [85, 90]
    report = {r.metric: r for r in trends.trend_report(df).collect()}
    assert report["healthScore"].change == pytest.approx(5.88, abs=0.01)
    assert report["avgComplexity"].change == pytest.approx(-15.29, abs=0.01)
    assert report["avgComplexity"].trend == "improving"


def test_recency_overlap_and_tokens(spark):
    r = one(
        spark,
        scoring.recency_boost(F.lit("2025-01-15 00:00:00"), "2025-01-15 00:00:00").alias("now"),
        scoring.recency_boost(F.lit("2025-01-01 00:00:00"), "2025-01-15 00:00:00").alias("half"),
        scoring.recency_boost(F.lit("nonsense"), "2025-01-15 00:00:00").alias("bad"),
        scoring.file_overlap(F.lit("src/a.ts,src/b.ts"), ["src/a.ts", "src/c.ts"]).alias("overlap"),
        text.tokens(F.lit("Fix a BUG, in the parser_x!")).alias("t"),
    )
    assert (r.now, r.half, r.bad, r.overlap) == (1, pytest.approx(0.5), 0, 0.5)
    assert r.t == ["fix", "bug", "the", "parser_x"]


@pytest.mark.parametrize(
    "query, intent",
    [("What changed in the last session?", "recent_change"), ("Explain the routing mechanism", "how_it_works"), ("Locate handleRequest method", "find_code"), ("Fix the authentication error", "debug"), ("database", "default")],
)
def test_intents(spark, query, intent):
    assert one(spark, scoring.query_intent(F.lit(query)).alias("i")).i == intent


def test_rank_fusion(spark):
    make = lambda *ids: spark.createDataFrame([(x, 1.0, i + 1) for i, x in enumerate(ids)], "id string, score double, rank long")
    got = retrieval.fused([make("a", "b"), make("b", "c")], 5).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    many = [make(*(f"{p}{i}" for i in range(20))) for p in "xy"]
    assert retrieval.fused(many, 5).count() == 5
    empty = make("a").filter("false")
    assert retrieval.fused([empty, empty], 5).count() == 0


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.cosine(a, a).alias("same"), vectors.cosine(a, b).alias("right"), vectors.cosine(a, F.array(F.lit(-3.0), F.lit(0.0))).alias("back"), vectors.cosine(a, zero).alias("none"))
    assert (r.same, r.right, r.back, r.none) == (1, 0, -1, 0)


def test_cochange_rules(spark):
    rows = [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b"), ("c2", "c"), ("c3", "a"), ("c4", "b"), ("c4", "c")]
    rules = {(r.file1, r.file2): (r.support, r.confidence) for r in cochange.pairs(spark.createDataFrame(rows, "commit string, file string")).collect()}
    assert rules == {("a", "b"): (0.5, 0.666667), ("b", "c"): (0.5, 0.666667), ("a", "c"): (0.25, 0.333333)}


def test_complexity(spark):
    body = "function f(a) {\n  if (a) {\n    for (const b of a) {\n      if (b && a) { g(b ? 1 : 2); }\n    }\n  }\n}"
    r = one(spark, C.cyclomatic(F.lit(body)).alias("cyc"), C.cognitive(F.lit(body)).alias("cog"))
    assert r.cyc == 1 + 3 + 1 + 1
    assert r.cog == 1 + 2 + 3 + 1 + (1 + 2)


def test_pairs_and_chunks(spark):
    turns = [(1, 0, "user", "Q1"), (1, 1, "user", "Q2 see src/a.ts and src/b.tsx"), (1, 2, "tool", "x"), (1, 3, "assistant", "A" * 5000), (1, 4, "user", "Q3"), (1, 5, "assistant", "A3"), (1, 6, "user", "last"), (2, 0, "assistant", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pairs = sessions.conversation_pairs(df)
    got = pairs.orderBy("pair").collect()
    assert [(r.pair, r.prompt[:6]) for r in got] == [(0, "Q1\n\nQ2"), (1, "Q3")]
    prompts = spark.createDataFrame([(2, "what is this"), (3, "")], "conv_id long, prompts string")
    chunks = {r.id: r for r in sessions.chunk_rows(pairs, prompts).collect()}
    assert set(chunks) == {"1-0-0", "1-0-1", "2-0-0"}
    assert len(chunks["1-0-0"].response) == 4003 and chunks["1-0-0"].language == "typescript"


def test_long_file_trees_are_cut(spark):
    raw = "look\n" + "\n".join(f"src/f{i}.ts" for i in range(6)) + "\nend"
    assert one(spark, text.clean_prompt(F.lit(raw)).alias("c")).c == "look\nsrc/f0.ts\nsrc/f1.ts\nsrc/f2.ts\nend"
    assert one(spark, text.clean_prompt(F.lit("<rules>all</rules>")).alias("c")).c == "<rules>all</rules>"


def test_upsert_and_migration(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int")
    assert sorted(tuple(r) for r in tables.upserted(old, new, "key").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    at = str(tmp_path / "t")
    tables.create_table(spark, at, tables.SOLUTIONS)
    assert tables.table_exists(spark, at) and not tables.table_exists(spark, at + "x")
    tables.append(tables.migrated(spark.createDataFrame([("x",)], "id string"), tables.SOLUTIONS, tables.SOLUTION_DEFAULTS), at)
    row = spark.read.parquet(at).first()
    assert (row.id, row.source, row.confidence, row.version) == ("x", "transcript", 0.7, 1)


def test_transcripts_and_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.jsonl").write_text('{"role":"user","content":"hi"}\nbroken\n{"role":"assistant","content":[{"type":"text","text":"yo"}]}\n')
    rows = transcripts.read_jsonl(spark, str(tmp_path / "s")).orderBy("nth").collect()
    assert [(r.role, r.content) for r in rows] == [("user", "hi"), ("assistant", "yo")]
    for name, body in {"a.py": "def f():\n    return g()\n", "node_modules/x.ts": "x", ".hidden/y.ts": "y", "sub/b.go": "func Run() {\n}\n", "c.txt": "no"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    files = code_files.source_files(spark, str(tmp_path / "tree"))
    assert sorted((r.path, r.language) for r in files.collect()) == [("a.py", "python"), ("sub/b.go", "go")]
    assert sorted(r.symbol for r in SY.symbols_of(files).collect()) == ["Run", "f"]
    (tmp_path / "golden.json").write_text(json.dumps([{"query": "q", "expectedKeywords": ["a"], "queryType": "debug"}]))
    assert transcripts.golden_set(spark, str(tmp_path / "golden.json")).first().keywords == ["a"]


def test_dedup_clusters_and_lsh(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.0, 1.0]), (4, [0.01, 0.999])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    ranked = df.withColumn("rank", F.col("id"))
    assert [r.id for r in retrieval.deduplicated(ranked).orderBy("rank").collect()] == [1, 3]
    pairs = similarity.similar_pairs(df, 0.9, tile=2)
    assert sorted((r.id1, r.id2) for r in pairs.collect()) == [(1, 2), (3, 4)]
    assert sorted((r.cluster, r.id) for r in similarity.star_clusters(pairs).collect()) == [(1, 1), (1, 2), (3, 3), (3, 4)]
    found = similarity.lsh_pairs(df, 2, 0.9, planes=4, tables=8)
    assert sorted((r.id1, r.id2) for r in found.collect()) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("cosine, tables", [(0.95, 4), (0.95, 32), (0.92, 48)])
def test_lsh_recall(spark, cosine, tables):
    """16 planes: pairs at a cosine are found as often as the angle says, and few others are looked at."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=(600, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    off = rng.normal(size=one.shape)
    off -= (off * one).sum(axis=1, keepdims=True) * one
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    two = (cosine + 0.001) * one + np.sqrt(1 - (cosine + 0.001) ** 2) * off
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([one, two]))], "id long, vector array<double>")
    found = {(r.id1, r.id2) for r in similarity.lsh_pairs(rows, 64, cosine, tables=tables).collect()}
    exact = {(r.id1, r.id2) for r in similarity.similar_pairs(rows, cosine).collect()}
    assert exact == {(i, i + 600) for i in range(600)} and found <= exact
    hit = 1 - (1 - (1 - np.arccos(cosine + 0.001) / np.pi) ** 16) ** tables
    assert len(found) / 600 == pytest.approx(hit, abs=0.07) and (tables == 4 or hit > 0.95)
    put = similarity.lsh_buckets(rows, 64, tables=tables).select("id", "table", "bucket")
    looked = put.alias("a").join(put.alias("b"), ["table", "bucket"]).filter("a.id < b.id").select("a.id", F.col("b.id").alias("o")).distinct().count()
    assert looked - len(found) < 0.01 * 1200 * 1199 / 2


def test_embedder_and_cache(spark):
    df = embedded(spark.createDataFrame([("a b",), ("a b",), ("",)], "embeddingText string"))
    got = [r.vector for r in df.collect()]
    assert got[0] == got[1] == pytest.approx(hashing_embedder("a b")) and not any(got[2])
    cache = df.filter("embeddingText <> ''").select(F.sha2("embeddingText", 256).alias("key"), "vector").distinct()
    hit, miss = from_cache(df.drop("vector"), cache)
    assert (hit.count(), miss.count()) == (2, 1)


def test_quality_of_results(spark):
    results = spark.createDataFrame([("m", "q", 1, "nothing"), ("m", "q", 2, "Alpha beta"), ("m", "q", 3, "alpha")], "mode string, query string, rank long, text string")
    golden = spark.createDataFrame([("q", ["alpha", "beta", "gamma"], "t")], "query string, keywords array<string>, queryType string")
    r = evaluate.quality(results, golden).first()
    assert (r.recall, r.mrr) == (pytest.approx(2 / 3, abs=1e-6), 0.5)
    assert evaluate.best_mode(evaluate.quality(results, golden)).first().mode == "m"


def test_streams_agree_with_batches(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = []
    EV.watch(EV.tumbling(stream, "1 hour", late="1 hour"), lambda b, i: got.extend(b.collect()), str(tmp_path / "c1")).awaitTermination()
    batch = {tuple(r) for r in EV.tumbling(df, "1 hour").collect()}
    assert got and {tuple(r) for r in got} <= batch
    once = []
    EV.watch(EV.first_by_key(stream, ["user_id", "event_type"]), lambda b, i: once.extend(b.collect()), str(tmp_path / "c2")).awaitTermination()
    assert len(once) == EV.first_by_key(df, ["user_id", "event_type"]).count()
    assert EV.sessions(df, "10 minutes").agg(F.sum("n")).first()[0] == 60


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcde"), min_size=1, max_size=4), min_size=1, max_size=6))
def test_support_never_exceeds_confidence(spark, commits):
    rows = [(i, f) for i, c in enumerate(commits) for f in c]
    for r in cochange.pairs(spark.createDataFrame(rows, "commit int, file string"), 0, 0).collect():
        assert r.support <= r.confidence <= 1


GO = """package main

const (
\tA = iota
\tb, c = 1, 2
)

var (
\tCache = map[string]int{
\t\t"x": 1,
\t}
\tmu sync.Mutex
)

type (
\tPoint struct {
\t\tX, Y int
\t}
\tReader interface {
\t\tRead(p []byte) (int, error)
\t}
\tID string
)

func Sum[T int | float64](a, b T, rest ...T) (T, error) {
\treturn a, nil
}

func (s *Store) Get(k string, f func(int, string) error) int { return 1 }
func f(int, string) {}
"""


def test_go_declarations():
    rows = {r[1]: r for r in SY.parse_symbols("a.go", GO)}
    kinds = {"A": "constant", "b": "constant", "Cache": "variable", "mu": "variable", "Point": "class", "Reader": "interface", "ID": "type", "Sum": "function", "Store.Get": "method", "f": "function"}
    assert {k: r[2] for k, r in rows.items()} == kinds
    assert rows["Cache"][3:5] == (9, 11) and rows["A"][7] and not rows["b"][7]
    assert json.loads(rows["Sum"][8]) == {
        "genericParams": [{"name": "T", "constraint": "int | float64"}], "parameters": [{"name": "a", "type": "T"}, {"name": "b", "type": "T"}, {"name": "rest", "type": "...T"}], "returnType": "(T, error)"
    }
    assert json.loads(rows["Store.Get"][8])["parameters"][1] == {"name": "f", "type": "func(int, string) error"}
    assert json.loads(rows["f"][8])["parameters"] == []


def test_script_and_rust_heads():
    script = """@Injectable({a: 1, b: 2})
export class Store<T extends Base = {}> extends X {
  private async load<K>(key: string, opts: { a: number, b?: string } = {}, cb?: (x: number) => void): Promise<Map<string, number>> {
    return find(key);
  }
}
export const useThing = (id: string, { a, b }: Props) => {
  useEffect(() => { go(id); }, [id, a.b]);
  return useMemo(() => [1, 2], [id]);
};
const one = x => x;
export async function many(a, b = "x, y", ...rest: string[]): Promise<void> {
  return;
}
"""
    rows = {r[1]: (r[2], r[3], r[4], json.loads(r[8] or "{}")) for r in SY.parse_symbols("a.ts", script)}
    assert rows["Store"][1:3] == (2, 6) and rows["Store"][3]["decorators"] == [{"name": "Injectable", "arguments": ["{a: 1, b: 2}"]}]
    load = rows["Store.load"][3]
    assert load["visibility"] == "private" and load["isAsync"] and load["genericParams"] == [{"name": "K"}] and load["returnType"] == "Promise<Map<string, number>>"
    assert [p["name"] for p in load["parameters"]] == ["key", "opts", "cb"] and load["parameters"][2]["isOptional"] and load["parameters"][1]["defaultValue"] == "{}"
    assert rows["useThing"][1:3] == (7, 10) and rows["useThing"][3]["hookDependencies"] == ["id", "a.b"]
    assert rows["one"][1:3] == (11, 11) and [p["name"] for p in rows["many"][3]["parameters"]] == ["a", "b", "rest"]
    rust = "pub(crate) async fn run<'a, T: Clone + Send>(x: &'a str, mut y: Vec<(i32, T)>) -> Result<T, Box<dyn Error>> where T: Y {\n    z()\n}\n"
    (row,) = SY.parse_symbols("a.rs", rust)
    assert json.loads(row[8]) == {
        "visibility": "crate", "isAsync": True, "genericParams": [{"name": "T", "constraint": "Clone + Send"}], "parameters": [{"name": "x", "type": "&'a str"}, {"name": "y", "type": "Vec<(i32, T)>"}],
        "returnType": "Result<T, Box<dyn Error>>",
    }


def test_calls_come_from_whole_bodies(spark):
    body = "export function big() {\n" + "  // filler line that says nothing\n" * 200 + "  last_call(1);\n}\n"
    row = SY.symbols_of(spark.createDataFrame([("a.ts", body)], "path string, text string")).first()
    assert row.calls == "last_call" and len(row.body) == SY.MAX_BODY


def test_recommendations_by_rule(spark):
    """Every rule alone: what it needs, its severity on both sides of its bound, and the row that says none applies."""
    from engram.operators.recommend import recommendations

    schemas = {
        "gods": "symbol string, total long, median double, n long", "fan_in": "symbol string, importers long, percentage long", "cross": "`from` string, `to` string, n long", "complex_": "symbol string, complexity long",
        "directories": "directory string, symbols long", "files": "path string, n long", "totals": "symbols long, average double, dead long, documented long", "largest": "symbol string, lines long", "clusters": "clusters long, members long",
    }
    quiet = {"totals": [(100, 2.0, 0, 90)], "clusters": [(0, 0)]}

    def found(**rows):
        frames = {k: spark.createDataFrame((quiet | rows).get(k, []), s) for k, s in schemas.items()}
        return {r.id: r.severity for r in recommendations(**frames).select("id", "severity").collect()}

    assert found() == {"rec-healthy": "info"}
    cases = [
        ("rec-god-object", {"gods": [("a", 40, 2.0, 4)]}, "critical", {"gods": [("a", 40, 2.0, 3)]}, "warning"),
        ("rec-fan-in", {"fan_in": [("a", 9, 51)]}, "critical", {"fan_in": [("a", 9, 50)]}, "warning"),
        ("rec-coupling", {"cross": [("a", "b", 21)]}, "warning", {"cross": [("a", "b", 11), ("c", "d", 10)]}, "info"),
        ("rec-complexity", {"complex_": [("a", 26)]}, "critical", {"complex_": [("a", 16), ("b", 3)]}, "warning"),
        ("rec-imbalance", {"directories": [("a", 51)]}, "warning", {"directories": [("a", 41)]}, "info"),
        ("rec-god-file", {"files": [("a", 11)]}, "warning", {"files": [("a", 11)], "totals": [(100, 3.0, 0, 90)]}, "info"),
        ("rec-dead-code", {"totals": [(100, 2.0, 31, 90)]}, "warning", {"totals": [(100, 2.0, 11, 90)]}, "info"),
        ("rec-duplication", {"clusters": [(2, 11)]}, "warning", {"clusters": [(2, 10)]}, "info"),
        ("rec-docs", {"totals": [(100, 2.0, 0, 9)]}, "warning", {"totals": [(100, 2.0, 0, 29)]}, "info"),
        ("rec-oversized", {"largest": [("a", 301)]}, "warning", {"largest": [("a", 151)]}, "info"),
    ]
    for name, strong, high, weak, low in cases:
        assert found(**strong) == {name: high} and found(**weak) == {name: low}
    below = {"cross": [("a", "b", 10)], "complex_": [("a", 15)], "directories": [("a", 40)], "files": [("a", 6)], "totals": [(100, 2.0, 10, 30)], "largest": [("a", 150)]}
    assert found(**below) == {"rec-healthy": "info"}


def test_session_files_feed_the_index(spark, tmp_path):
    """New transcript files come as a stream; a session that changes is replaced, one that doesn't keeps its rows."""
    from engram.operators import maintenance

    state = {"index": spark.createDataFrame([], "checkpointId string, contentHash string, body string")}

    def chunk(batch):
        hashes = sessions.session_hashes(batch, "checkpointId", "turn")
        return batch.join(hashes, "checkpointId").select("checkpointId", "contentHash", F.col("text").alias("body")), hashes

    def write(rows):
        state["index"] = spark.createDataFrame(rows.collect(), "checkpointId string, contentHash string, body string")

    def step(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("checkpointId", "turn", "text"), r, strict=True))) for r in rows))
        source = EV.session_files(spark, str(tmp_path / "in"), "checkpointId string, turn long, text string").drop("path")
        EV.watch(source, maintenance.sync_batch(lambda: state["index"], write, chunk), str(tmp_path / "at")).awaitTermination()
        return sorted((r.checkpointId, r.body) for r in state["index"].collect())

    assert step("1.json", [("a", 0, "x"), ("b", 0, "y")]) == [("a", "x"), ("b", "y")]
    assert step("2.json", [("a", 0, "x2"), ("a", 1, "more"), ("c", 0, "z")]) == [("a", "more"), ("a", "x2"), ("b", "y"), ("c", "z")]
    assert step("3.json", [("b", 0, "y")]) == [("a", "more"), ("a", "x2"), ("b", "y"), ("c", "z")]
