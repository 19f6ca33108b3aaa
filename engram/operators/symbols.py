"""Symbols of source files: a parser for each language, behind one table function.

Python files go through the language's own parser; the other languages through a lexer that masks what isn't code, and a
scanner of declarations over nested scopes, which reads their heads for metadata. Calls are taken from the masked text of
whole bodies, before they are cut for storage. Parsers are looked up by extension in PARSERS, to which others can be
added.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from engram.operators.lexing import Code, masked
from engram.operators.signatures import signature

# Words that look like calls but aren't.
KEYWORDS = (
    "if", "for", "while", "switch", "catch", "return", "throw", "new", "typeof", "instanceof", "void", "delete", "await", "import", "export", "from", "const", "let", "var", "function", "class", "interface", "type",
    "enum", "extends", "implements", "async", "yield", "super", "this", "true", "false", "null", "undefined", "try", "finally", "else", "case", "break", "continue", "default", "debugger", "with", "static", "abstract",
    "public", "private", "protected", "readonly", "override", "declare", "require", "module", "exports", "console", "process", "Array", "Object", "String", "Number", "Boolean", "Map", "Set", "Promise", "Error",
    "Math", "JSON", "Date", "RegExp", "Symbol", "parseInt", "parseFloat", "isNaN", "setTimeout", "setInterval", "clearTimeout",
)
#: Words that look like calls in the other languages.
NOT_CALLS = ("func", "fn", "go", "defer", "def", "match", "not", "and", "assert", "elif", "except", "print")
CALL = r"\b([a-zA-Z_]\w{2,})\s*\("
NAMED_IMPORT, DEFAULT_IMPORT = r"import\s+\{([^}]+)\}\s+from\s+[\"']([^\"']+)[\"']", r"import\s+(\w+)\s+from\s+[\"']([^\"']+)[\"']"
COLUMNS = "path string, symbol string, symbolType string, startLine int, endLine int, body string, doc string, exported boolean, metadata string"
#: Bodies are stored up to this length.
MAX_BODY = 3000


def calls(body: Column, own: Column, n: int = 30, others: Sequence[str] = ()) -> Column:
    """Names that a body calls: distinct, in order, keywords, other words given and its own name aside."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(CALL), F.lit(1)))
    return F.slice(F.array_except(found, F.array(own, *map(F.lit, [*KEYWORDS, *others]))), 1, n)


def imported(text: Column) -> Column:
    """array<struct(name, source)> of a file's named and default imports."""
    pair = lambda pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("source"))
    last = lambda raw: F.trim(F.element_at(F.split(F.trim(raw), r"\s+as\s+"), -1))
    named = F.flatten(F.transform(pair(NAMED_IMPORT), lambda p: F.transform(F.split(p["name"], ","), lambda x: F.struct(last(x).alias("name"), p["source"].alias("source")))))
    return F.filter(F.concat(named, pair(DEFAULT_IMPORT)), lambda x: x["name"] != "")


def resolved_imports(body: Column, called: Column, imports: Column, n: int = 30) -> Column:
    """name:source of imports that are called, in order of the calls, then of those that are mentioned."""
    text = lambda i: F.concat_ws(":", i["name"], i["source"])
    by_call = F.flatten(F.transform(called, lambda c: F.transform(F.filter(imports, lambda i: i["name"] == c), text)))
    mentioned = F.transform(F.filter(imports, lambda i: F.contains(body, i["name"])), text)
    return F.slice(F.array_union(by_call, mentioned), 1, n)


#: As COLUMNS without the path, then the body with all but code masked.
Row = tuple[str, str, int, int, str, str, bool, str | None, str]


def python_symbols(text: str) -> Iterator[Row]:
    """Functions, classes, methods as Class.name, and constants in capitals, with documentation and parameters."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines = text.split("\n")

    def row(node: ast.AST, name: str, kind: str, meta: dict | None) -> Row:
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        doc = ast.get_docstring(node) if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        if doc and meta is not None:
            meta["docstring"] = doc
        return name, kind, node.lineno, node.end_lineno or node.lineno, body, doc or "", not name.split(".")[-1].startswith("_"), json.dumps(meta) if meta else None, masked(body, "python")

    def about(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
        given = [a for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg not in ("self", "cls")]
        params = [{"name": a.arg} | ({"type": ast.unparse(a.annotation)} if a.annotation else {}) for a in given]
        out: dict = {"parameters": params, "isAsync": isinstance(node, ast.AsyncFunctionDef), "decorators": [ast.unparse(d) for d in node.decorator_list]}
        return out | ({"returnType": ast.unparse(node.returns)} if node.returns else {})

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield row(node, node.name, "function", about(node))
        elif isinstance(node, ast.ClassDef):
            yield row(node, node.name, "class", {"extends": [ast.unparse(b) for b in node.bases], "decorators": [ast.unparse(d) for d in node.decorator_list]})
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield row(inner, f"{node.name}.{inner.name}", "method", about(inner))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", target.id):
                    yield row(node, target.id, "constant", None)


def doc_above(lines: list[str], at: int) -> str:
    """The line comments right above a declaration, or the block comment that ends there."""
    out: list[str] = []
    i = at - 1
    while i >= 0 and re.match(r"\s*(//|#)", lines[i]):
        out.insert(0, re.sub(r"^\s*(///?|#)!?\s?", "", lines[i]))
        i -= 1
    if out or i < 0 or not lines[i].rstrip().endswith("*/"):
        return "\n".join(out)
    end = i
    while i > 0 and "/*" not in lines[i]:
        i -= 1
    return re.sub(r"\s*(/\*\*?|\*/|^\s*\*)\s?", " ", "\n".join(lines[i : end + 1]), flags=re.M).strip()


Kind = str | Callable[[Code, re.Match], str | None]


class Scanner:
    """A parser from (pattern with a group `name`, type) rules, tried in order wherever a declaration may begin.

    That is outside of all brackets, or directly inside a scope: a body of the types `scope` (a module, whose members are
    named as if they stood outside), `class` and `owner` (whose members the rules `methods` read and name after it). A
    type may be a function of the match. receiver: pattern with `of` and `name` for functions that name the type they
    belong to; groups: (pattern that opens a bracketed list of declarations, their rules). Types in `statements` end where
    a statement does, others with their block.
    """

    def __init__(self, language: str, rules: list[tuple[str, Kind]], exported: Callable[[str, str], bool], methods: str | None = None, receiver: str | None = None, groups: list[tuple[str, list[tuple[str, str]]]] = (), statements: Sequence[str] = ("type", "constant", "variable"), marks: str | None = None):
        self.language, self.exported, self.statements = language, exported, statements
        self.rules = [(re.compile(p), kind) for p, kind in rules]
        self.methods, self.receiver, self.marks = (re.compile(p) if p else None for p in (methods, receiver, marks))
        self.groups = [(re.compile(p), [(re.compile(q), kind) for q, kind in specs]) for p, specs in groups]

    def __call__(self, text: str) -> Iterator[Row]:
        code = Code(text, self.language)
        self_lines = text.split("\n")
        yield from self.members(code, self_lines, 0, len(text))

    def row(self, code: Code, lines: list[str], name: str, kind: str, at: int, end: int, of: str = "") -> Row:
        first, last, body = code.line(at), code.line(max(end - 1, at)), code.text[at:end]
        begins = code.starts[first]
        opens = not code.text[begins:at].strip()
        meta = signature(self.language, kind, name, body, "\n".join(lines[max(first - 20, 0) : first]) + "\n" + code.text[begins:at])
        return of + name, kind, first + 1, last + 1, body, doc_above(lines, first) if opens else "", self.exported(name, body), json.dumps(meta) if meta else None, code.code[at:end]

    def begins(self, code: Code, at: int, to: int) -> int:
        """The next place where a declaration may begin: past blanks, and past decorators and attributes."""
        while at < to:
            if code.code[at].isspace():
                at += 1
            elif self.marks and (m := self.marks.match(code.code, at)):
                at = m.end()
                if code.code[at - 1] in "([":
                    at = code.closes.get(at - 1, at) + 1
            else:
                break
        return at

    def further(self, code: Code, at: int, to: int) -> int:
        """The place after what begins at `at` and is no declaration: a line or statement, brackets stepped over."""
        while m := re.compile(r"[(\[{;}\n]").search(code.code, at, to):
            at = m.end()
            if m.group() in ";\n}":
                return at
            at = code.closes.get(m.start(), m.start()) + 1
        return to

    def members(self, code: Code, lines: list[str], at: int, to: int, of: str = "") -> Iterator[Row]:
        """The declarations between two places of one scope; `of` names the type that they belong to."""
        while (at := self.begins(code, at, to)) < to:
            end = at
            if of:
                if m := self.methods.match(code.code, at):
                    end = self.method_end(code, m)
                    if end and m["name"] not in ("constructor", "if", "for", "while", "switch", "catch", "return"):
                        yield self.row(code, lines, m["name"], "method", at, end, f"{of}.")
                at = end if end and end > at else self.further(code, at, to)
                continue
            if self.receiver and (m := self.receiver.match(code.code, at)):
                end = code.block_end(m.end())
                yield self.row(code, lines, m["name"], "method", at, end, f"{m['of']}.")
                at = end
                continue
            for pattern, specs in self.groups:
                if m := pattern.match(code.code, at):
                    end = code.closes.get(m.end() - 1, to)
                    yield from self.grouped(code, lines, specs, m.end(), end)
                    break
            else:
                for pattern, kind in self.rules:
                    if (m := pattern.match(code.code, at)) and (found := kind(code, m) if callable(kind) else kind):
                        end = yield from self.declared(code, lines, m, found, at)
                        break
            at = end + 1 if end > at and code.code[end - 1 : end] not in ("}", ";", "\n") else end if end > at else self.further(code, at, to)

    def method_end(self, code: Code, m: re.Match) -> int | None:
        """The place after a method's body; None for a call, a property or a method without one."""
        close = code.closes.get(m.end() - 1)
        if close is None:
            return None
        end = code.block_end(close + 1)
        head = code.code[close + 1 : end]
        return end if head.endswith("}") and re.match(r"\s*(?:\{|:|->|where\b)", head) else None

    def grouped(self, code: Code, lines: list[str], specs: list[tuple[re.Pattern, str]], at: int, to: int) -> Iterator[Row]:
        while (at := self.begins(code, at, to)) < to:
            end = min(code.statement_end(at), to)
            for pattern, kind in specs:
                if m := pattern.match(code.code, at):
                    yield self.row(code, lines, m["name"], kind, at, end)
                    break
            at = max(end, at + 1)

    def declared(self, code: Code, lines: list[str], m: re.Match, kind: str, at: int):
        """The rows of a declaration and, where it is a scope, of its members; gives the place after it."""
        binds = self.language == "script" and re.match(r"(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s", code.code[at : at + 40]) and kind != "enum"
        end = code.statement_end(m.end()) if kind in self.statements or binds else code.block_end(m.end() - (code.code[m.end() - 1] == "{"), 30 if kind == "interface" else 50)
        if kind not in ("owner", "scope"):
            yield self.row(code, lines, m["name"], kind, at, end)
        if kind in ("owner", "scope", "class") and (kind == "scope" or self.methods) and code.code[end - 1 : end] == "}":
            opens = next((p for p, q in code.closes.items() if q == end - 1), None)
            if opens is not None and opens >= at:
                yield from self.members(code, lines, opens + 1, end - 1, "" if kind == "scope" else m["name"])
        return end


def bound(code: Code, m: re.Match) -> str | None:
    """The type of a script's `const name`: by what stands behind its equals sign."""
    at = m.end()
    if re.compile(r"\s*[:!]").match(code.code, at):  # a type stands before
        while n := re.compile(r"[(\[{;=]").search(code.code, at):
            at = n.end()
            if n.group() == "=" and code.code[at : at + 1] != ">" and code.code[at - 2] not in "<>!=":
                at -= 1
                break
            if n.group() == ";":
                return None
            if n.group() in "([{":
                at = code.closes.get(n.start(), n.start()) + 1
    if not (n := re.compile(r"\s*=\s*").match(code.code, at)):
        return None
    at = n.end()
    if re.compile(r"(?:React\.)?(?:memo|forwardRef|lazy)\s*(?:<[^(]*>\s*)?\(").match(code.code, at):
        return "component"
    if re.compile(r"(?:async\s+)?(?:function\b|\w+\s*=>)").match(code.code, at):
        return "function"
    if n := re.compile(r"(?:async\s*)?(?:<[^()]*>\s*)?\(").match(code.code, at):
        close = code.closes.get(n.end() - 1)
        if close is not None and re.compile(r"\s*(?::[^=;]+)?=>").match(code.code, close + 1):
            return "function"
    return "constant" if m.group().startswith("export") else None


EXPORT = r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
PUB = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
ANGLES = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
script_symbols = Scanner(
    "script",
    [
        (EXPORT + r"(?:async\s+)?function\s*\*?\s*(?P<name>[a-z_$][\w$]*)", "function"),
        (EXPORT + r"(?:async\s+)?function\s*\*?\s*(?P<name>[A-Z][\w$]*)", "component"),
        (EXPORT + r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)", "class"),
        (EXPORT + r"interface\s+(?P<name>[\w$]+)", "interface"),
        (EXPORT + r"(?:const\s+)?enum\s+(?P<name>[\w$]+)", "enum"),
        (EXPORT + r"(?:namespace|module)\s+(?P<name>[\w$.]+)\s*\{", "scope"),
        (EXPORT + r"type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>\s*)?=", "type"),
        (EXPORT + r"(?:const|let)\s+(?P<name>[\w$]+)", bound),
    ],
    lambda name, body: body.startswith("export"),
    methods=r"(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set|declare)\s+)*\*?\s*(?P<name>[\w$#]+)\s*[?!]?\s*(?:<[^()]*>\s*)?\(",
    marks=r"@[\w.]+\(?",
)
go_symbols = Scanner(
    "go",
    [
        (r"func\s+(?P<name>\w+)", "function"),
        (r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b", "class"),
        (r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b", "interface"),
        (r"type\s+(?P<name>\w+)", "type"),
        (r"const\s+(?P<name>\w+)", "constant"),
        (r"var\s+(?P<name>\w+)", "variable"),
    ],
    lambda name, body: name[:1].isupper(),
    receiver=r"func\s+\(\s*\w*\s*\*?(?P<of>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<name>\w+)",
    groups=[
        (r"type\s*\(", [(r"(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+struct\b", "class"), (r"(?P<name>[A-Za-z_]\w*)(?:\[[^\]]*\])?\s+interface\b", "interface"), (r"(?P<name>[A-Za-z_]\w*)\s", "type")]),
        (r"const\s*\(", [(r"(?P<name>[A-Za-z_]\w*)", "constant")]),
        (r"var\s*\(", [(r"(?P<name>[A-Za-z_]\w*)", "variable")]),
    ],
)
rust_symbols = Scanner(
    "rust",
    [
        (PUB + r"(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"\0*\"\s+)?)*fn\s+(?P<name>\w+)", "function"),
        (PUB + r"struct\s+(?P<name>\w+)", "class"),
        (PUB + r"enum\s+(?P<name>\w+)", "enum"),
        (PUB + r"(?:unsafe\s+)?trait\s+(?P<name>\w+)", "interface"),
        (PUB + r"mod\s+(?P<name>\w+)\s*\{", "scope"),
        (PUB + r"type\s+(?P<name>\w+)", "type"),
        (PUB + r"const\s+(?P<name>\w+)", "constant"),
        (PUB + r"static\s+(?:mut\s+)?(?P<name>\w+)", "variable"),
        (rf"(?:unsafe\s+)?impl\s*(?:{ANGLES})?\s*(?:!?[\w:]+\s*(?:{ANGLES})?\s+for\s+)?(?:&\s*(?:'\w+\s+)?)?(?:\w+::)*(?P<name>\w+)", "owner"),
    ],
    lambda name, body: body.startswith("pub"),
    methods=PUB + rf"(?:default\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+(?:\"\0*\"\s+)?)*fn\s+(?P<name>\w+)\s*(?:{ANGLES})?\s*\(",
    marks=r"#!?\[",
)
PARSERS: dict[str, Callable[[str], Iterator[Row]]] = {
    ".py": python_symbols, ".pyi": python_symbols, ".go": go_symbols, ".rs": rust_symbols, ".ts": script_symbols, ".tsx": script_symbols, ".js": script_symbols, ".jsx": script_symbols,
}


Parsers = dict[str, Callable[[str], Iterator[Row]]]


def parse_symbols(path: str, text: str, more: Parsers | None = None) -> list[tuple]:
    """The symbols of a file as COLUMNS; none for an unknown extension. more: parsers of other extensions, or instead of ours."""
    parser = (PARSERS | (more or {})).get(re.search(r"(\.[^./]*)?$", path)[0])
    return [(path, *r) for r in parser(text or "")] if parser else []


def register_parser(spark: SparkSession, name: str = "parse_symbols", more: Parsers | None = None) -> None:
    """Make a table function known to SQL that gives the rows of a file's symbols, with whole bodies:
    SELECT ... FROM files f, LATERAL parse_symbols(f.path, f.text) s. Null paths and texts give no rows."""

    @udtf(returnType=COLUMNS.removeprefix("path string, "))
    class ParseSymbols:
        def eval(self, path: str, text: str) -> Iterator[tuple]:
            for r in parse_symbols(path or "", text, more):
                yield r[1:9]

    spark.udtf.register(name, ParseSymbols)


def symbols_of(files: DataFrame, more: Parsers | None = None) -> DataFrame:
    """Symbols (COLUMNS, id, summary, calls, imports) of files (path, text), file by file within each task.

    A file's imports travel with its symbols, so files are read once and nothing is joined; calls and imports are read
    from whole bodies, calls from their code alone.
    """
    names = [*(c.split()[0] for c in COLUMNS.split(", ")), "_code"]
    rows = files.select("path", "text", imported(F.col("text")).alias("_imports")).select("path", "text", F.to_json("_imports").alias("_imports"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(*r, i) for p, t, i in zip(b["path"], b["text"], b["_imports"], strict=True) for r in parse_symbols(p, t, more)]
            yield pd.DataFrame(made, columns=[*names, "_imports"])

    made = rows.mapInPandas(run, f"{COLUMNS}, _code string, _imports string").withColumn("_imports", F.from_json("_imports", "array<struct<name:string,source:string>>"))
    made = made.withColumn("_calls", calls(F.col("_code"), F.element_at(F.split("symbol", r"\."), -1), others=NOT_CALLS))
    summary = F.when(F.col("doc") != "", F.left("doc", F.lit(200))).otherwise(F.concat_ws(" ", "symbolType", "symbol"))
    kept = [F.left("body", F.lit(MAX_BODY)).alias("body") if c == "body" else F.col(c) for c in names[:-1]]
    return made.select(
        F.concat_ws(":", "path", "symbol", F.col("startLine").cast("string")).alias("id"), *kept, summary.alias("summary"), F.array_join("_calls", ",").alias("calls"),
        F.array_join(resolved_imports(F.col("body"), F.col("_calls"), F.col("_imports")), ",").alias("imports"),
    )


def parsed_against_index(parsed: DataFrame, indexed: DataFrame) -> DataFrame:
    """(symbol, indexed) of a file's parsed symbols."""
    known = indexed.select("symbol", F.lit(True).alias("_k")).distinct()
    return parsed.join(known, "symbol", "left").select("symbol", F.col("_k").isNotNull().alias("indexed"))
