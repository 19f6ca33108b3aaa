"""Text expressions: tokens, truncation, highlighting, extraction of files, symbols and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that results depend on. FILE_PATTERN tries longer extensions first, so that src/a.tsx
# is one path, where an order of ts before tsx would cut it to src/a.ts.
TOKEN_SPLIT = r"""[\s/.,;:!?()\[\]{}<>'"=+\-*&#@|\\`~^]+"""
#: What isn't in TOKEN_SPLIT, with blanks spelt out, which the JVM then looks up in a table.
TOKEN_CHARACTER = "[^" + TOKEN_SPLIT.removeprefix("[").removesuffix("]+").replace(r"\s", r" \t\n\x0B\f\r") + "]"
FILE_PATTERN = r"(?:^|\s)([\w/.-]*/[\w/.-]+\.(?:tsx|ts|json|jsx|js|md|css|html|py|go|rs))"
NOT_FILES = ["node.js", "next.js", "vue.js", "nuxt.js", "react.js", "angular.js", "express.js", "bun.js", "deno.js"]
SYMBOL_PATTERN = r"(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const|let)\s+(\w{3,})"
ADDED_SYMBOL_PATTERN = r"(?m)^\+\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const|let)\s+(\w{3,})"
QUERY_SYMBOL_PATTERN = r"(?:function|class|interface|type|const|let|var|export)\s+(\w{3,})"
CHANGED_LINE = r"^[+-]\s*(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const|let|import)\s"
CHANGE_MARKS = ["diff", "+++", "---", "Write to file", "Created file", "Modified file", "old_string", "new_string", "StrReplace", "Wrote to", "Updated file"]
SYSTEM_TAGS = (
    "system_reminder", "user_info", "rules", "agent_skills", "open_and_recently_viewed_files", "git_status", "agent_transcripts", "always_applied_workspace_rules", "always_applied_workspace_rule",
    "available_skills", "agent_skill", "mcp_file_system", "mcp_file_system_servers", "mcp_file_system_server", "terminal_files_information", "tone_and_style", "tool_calling", "making_code_changes",
    "citing_code", "inline_line_numbers", "task_management", "committing-changes-with-git", "creating-pull-requests", "managing-long-running-commands", "linter_errors",
    "no_thinking_in_code_or_commands", "mode_selection", "mermaid_syntax", "other-common-operations",
)
FILE_TREE_LINE = r"^[ │├└─\s]*[\w/.-]+\.(?:ts|tsx|js|jsx|json|md|css|py|go|rs)\s*$"
LANGUAGE_BY_EXTENSION = {".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".go": "go", ".rs": "rust"}
SUMMARY_FILE = r"(?:^|\s)([\w/.-]+\.(?:tsx|ts|jsx|js|py|go|rs))"


def tokens(text: Column) -> Column:
    """Lower-case tokens of three characters and more; repeats stay."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: F.length(t) > 2)


def token_count(low: Column) -> Column:
    """The number of tokens of a lower-case text, without making them."""
    return F.regexp_count(low, F.lit(f"{TOKEN_CHARACTER}{{3,}}+")).cast("long")


def term_count(low: Column, term: str) -> Column:
    """How often a token occurs in a lower-case text; the pattern is tried only where the text holds the term."""
    whole = F.regexp_count(low, F.lit(f"{re.escape(term)}(?!{TOKEN_CHARACTER})(?<!{TOKEN_CHARACTER}{re.escape(term)})"))
    return F.when(F.contains(low, F.lit(term)), whole).otherwise(0).cast("long")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def head_and_tail(text: Column, n: int, mark: str = "\n...[truncated]...\n") -> Column:
    """A long text as its first 60 %, a mark and its end, together n characters."""
    head = int(n * 0.6)
    tail = n - head
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def highlighted(text: Column, query: str) -> Column:
    """The query's words of two characters and more, marked."""
    words = [re.escape(w) for w in query.split() if len(w) > 1]
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else text


def files_changed(text: Column, n: int = 20) -> Column:
    """Distinct file paths in the order of their first mention."""
    found = F.transform(F.regexp_extract_all(text, F.lit(FILE_PATTERN), F.lit(1)), lambda x: F.trim(x))
    real = F.filter(found, lambda f: ~F.array_contains(F.array(*map(F.lit, NOT_FILES)), F.lower(f)))
    return F.slice(F.array_distinct(real), 1, n)


def symbols(text: Column, n: int = 30) -> Column:
    """Names declared in a text, once each, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(SYMBOL_PATTERN), F.lit(1))), 1, n)


def added_symbols(diff: Column, n: int = 30) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(diff, F.lit(ADDED_SYMBOL_PATTERN), F.lit(1))), 1, n)


def looks_like_change(text: Column) -> Column:
    out = F.lit(False)
    for mark in CHANGE_MARKS:
        out = out | F.contains(text, F.lit(mark))
    return out


def changed_lines(text: Column) -> Column:
    """The lines of a reply that add or remove declarations."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(CHANGED_LINE)), "\n")


def language_of(files: Column) -> Column:
    """The language of the most common extension; of equally common ones, the first seen."""
    extensions = F.filter(F.transform(files, lambda f: F.regexp_extract(f, r"(\.[^.]*)$", 1)), lambda e: e != "")
    once = F.array_distinct(extensions)
    counted = F.transform(once, lambda e, i: F.struct(F.size(F.filter(extensions, lambda x: x == e)).alias("n"), (-i).alias("first"), e.alias("e")))
    top = F.try_element_at(F.reverse(F.array_sort(counted)), F.lit(1))["e"]
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair))
    return F.coalesce(F.try_element_at(table, top), F.lit(""))


def clean_prompt(raw: Column) -> Column:
    """A prompt without system tags, with at most three lines of a file tree in a row and no long gaps; never empty if raw isn't."""
    tags = "|".join(SYSTEM_TAGS)
    text = F.regexp_replace(raw, rf"(?i)<(?:{tags})[^>]*>[\s\S]*?</[^>]+>", "")
    start = F.struct(F.lit(0).alias("run"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(F.trim(line).rlike(FILE_TREE_LINE), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.when(run > 3, acc["kept"]).otherwise(F.array_append(acc["kept"], line)).alias("kept"))

    kept = F.aggregate(F.split(text, "\n", -1), start, step, lambda acc: F.array_join(acc["kept"], "\n"))
    done = F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(done != "", done).otherwise(F.left(raw, F.lit(500)))


def first_meaningful_line(text: Column, n: int) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    good = F.try_element_at(F.filter(lines, lambda x: (F.length(x) > 15) & ~F.startswith(x, F.lit("<")) & ~F.startswith(x, F.lit("```"))), F.lit(1))
    return F.coalesce(truncated(good, n), F.left(F.try_element_at(lines, F.lit(1)), F.lit(n)), F.lit(""))


def fallback_summary(prompt: Column, response: Column, diff: Column) -> Column:
    task, approach = first_meaningful_line(prompt, 300), first_meaningful_line(response, 500)
    files = F.array_join(F.slice(F.array_distinct(F.regexp_extract_all(diff, F.lit(SUMMARY_FILE), F.lit(1))), 1, 5), ", ")
    some = lambda label, x: F.when(x != "", F.concat(F.lit(label), x))
    text = F.left(F.concat_ws(". ", some("Task: ", task), some("Approach: ", approach), some("Files: ", files)), F.lit(500))
    return F.when(text != "", text).otherwise(F.left(prompt, F.lit(300)))


def embedding_text(names: Column, prompt: Column, response: Column, diff: Column) -> Column:
    """What a chunk is embedded and searched by."""
    parts = [
        F.when(F.size(names) > 0, F.concat(F.lit("Symbols: "), F.array_join(names, ", "))),
        F.concat(F.lit("Question: "), prompt),
        F.concat(F.lit("Answer: "), F.left(response, F.lit(1500))),
        F.when(diff != "", F.concat(F.lit("Changes: "), F.left(diff, F.lit(500)))),
    ]
    return F.left(F.concat_ws("\n\n", *parts), F.lit(5000))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def directory_key(path: Column) -> Column:
    """The first two telling parts of a path, or the path."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", "..", "src"))
    key = F.array_join(F.slice(parts, 1, 2), "/")
    return F.when(key != "", key).otherwise(path)


def summary_quality(summary: Column) -> Column:
    """struct(length, sentences, files, names a symbol)."""
    sentences = F.size(F.filter(F.split(summary, r"[.!?]+"), lambda s: F.trim(s) != ""))
    files = F.slice(F.array_distinct(F.regexp_extract_all(summary, F.lit(SUMMARY_FILE), F.lit(1))), 1, 10)
    names = summary.rlike(r"\b(?:function|class|interface|method|component)\b")
    return F.struct(F.length(summary).alias("length"), sentences.alias("sentences"), F.size(files).alias("files"), names.alias("symbols"))
