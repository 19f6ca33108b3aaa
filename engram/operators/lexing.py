"""One pass over a source text that tells code from strings, templates, comments and regular expressions.

`masked` keeps every character's place. Comments become blanks, with their line ends. Of literals the marks stay and the
rest becomes `FILL`, line ends included, so that a literal never looks like code and never ends a line. Code inside
a template's `${}` counts as part of the template. Quotes that nothing closes are plain characters; templates, raw
strings and comments go on to the text's end.
"""

from __future__ import annotations

import re

FILL, MARKS = "\0", "\"'`/#"
#: Where code stops being plain, by language.
STOPS = {
    "script": re.compile(r"//|/\*|[\"'`/]"),
    "go": re.compile(r"//|/\*|[\"'`]"),
    "rust": re.compile(r"//|/\*|(?<!\w)b?r#*\"|\"|'"),
    "python": re.compile(r"#|\"\"\"|'''|[\"']"),
}
LINE_STRING = {q: re.compile(rf"(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'"}
LONG_STRING = {q: re.compile(rf"(?:\\.|[^{q}\\])*{q}", re.S) for q in "\"`"}
RUST_CHAR = re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'", re.S)
#: A slash after one of these begins a regular expression, after anything else it divides.
BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{;+\-*%~^>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|yield|await))\s*$")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
NESTED = re.compile(r"/\*|\*/")
TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
INNER = re.compile(r"//[^\n]*|/\*.*?\*/|[\"'`{}]", re.S)


def template_end(text: str, at: int) -> int:
    """The place after the template whose text begins at `at`; what its `${}` hold may be templates again."""
    inside: list[int] = [-1]  # -1 for the text of a template, else the braces that are open in the code of a `${}`
    while m := (TEMPLATE if inside[-1] < 0 else INNER).search(text, at):
        c, at = m.group(), m.end()
        if c == "`" and inside[-1] < 0:
            inside.pop()
            if not inside:
                return at
        elif c == "`":
            inside.append(-1)
        elif c == "${":
            inside.append(0)
        elif c == "{":
            inside[-1] += 1
        elif c == "}" and inside[-1]:
            inside[-1] -= 1
        elif c == "}":
            inside.pop()
        elif c in "\"'" and (found := LINE_STRING[c].match(text, at)):
            at = found.end()
    return len(text)


def masked(text: str, language: str) -> str:
    """The text of a language (script, go, rust, python) with everything but code masked; see above."""
    stops, out, at, done = STOPS[language], [], 0, 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while m := stops.search(text, at):
        a, c = m.start(), m.group()
        comment = False
        if c in ("//", "#"):
            end, comment = text.find("\n", a), True
            end = len(text) if end < 0 else end
        elif c == "/*":
            comment, depth, end = True, 1, a + 2
            while depth and (n := NESTED.search(text, end)):
                end = n.end()
                depth += 1 if n.group() == "/*" and language == "rust" else -1 if n.group() == "*/" else 0
            end = len(text) if depth else end
        elif c == "/":
            found = REGEX.match(text, a) if BEFORE_REGEX.search(text[max(done, a - 200, text.rfind("\n", 0, a) + 1) : a]) and text[a - 1 : a] != "<" else None
            if not found:
                at = a + 1
                continue
            end = found.end()
        elif c == "'" and language == "rust":
            found = RUST_CHAR.match(text, a)
            if not found:  # a lifetime
                at = a + 1
                continue
            end = found.end()
        elif language == "rust" and c.endswith('"') and len(c) > 1:
            close = '"' + "#" * c.count("#")
            end = text.find(close, m.end())
            end = len(text) if end < 0 else end + len(close)
        elif len(c) == 3:
            end = m.end()
            while (end := text.find(c, end)) >= 0 and text[end - 1] == "\\":
                end += 1
            end = len(text) if end < 0 else end + 3
        elif c == "`" and language == "script":
            end = template_end(text, m.end())
        elif c == "`":
            end = text.find("`", m.end())
            end = len(text) if end < 0 else end + 1
        else:
            found = (LONG_STRING if language == "rust" else LINE_STRING)[c].match(text, m.end())
            if not found:  # an apostrophe, or text that isn't done
                at = a + 1
                continue
            end = found.end()
        out.append(text[done:a])
        whole = text[a:end]
        last = whole[-1] if whole[-1] in MARKS or whole[-1].isalpha() else FILL
        out.append(blank(whole) if comment else (whole[0] + FILL * (len(whole) - 2) + last)[: len(whole)])
        at = done = end
    out.append(text[done:])
    return "".join(out)


OPENS = {"(": ")", "[": "]", "{": "}"}


def brackets(code: str) -> dict[int, int]:
    """For each opening bracket of masked code that is closed, the place of the one that closes it."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in OPENS:
            open_.append((OPENS[c], m.start()))
        elif any(c == want for want, _ in open_[-4:]):
            while open_:  # what was left open inside is given up
                want, at = open_.pop()
                if want == c:
                    out[at] = m.start()
                    break
    return out


class Code:
    """A source text with its masked form, its brackets and its lines."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.code = masked(text, language)
        self.closes = brackets(self.code)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        """The number, from 0, of the line that a place is on."""
        from bisect import bisect_right

        return bisect_right(self.starts, at) - 1

    def after_lines(self, at: int, n: int) -> int:
        """The end of the line n lines further on, or of the text."""
        k = self.line(at) + n + 1
        return self.starts[k] - 1 if k < len(self.starts) else len(self.text)

    def block_end(self, at: int, fallback: int = 50) -> int:
        """The place after the block that a declaration at `at` opens, or after its semicolon if it has none.

        Braces in parentheses (parameters) or before another brace, or a mark that goes on with a type, aren't its block.
        A block that is never closed ends `fallback` lines on.
        """
        i = at
        while m := re.compile(r"[(\[{;}]").search(self.code, i):
            p, c = m.start(), m.group()
            if c == ";":
                return p + 1
            if c == "}":
                return p
            close = self.closes.get(p)
            if close is None:
                break
            i = close + 1
            if c == "{" and not re.compile(r"[ \t]*(?:[{>|&\[])").match(self.code, i):
                return i
        return self.after_lines(at, fallback)

    def statement_end(self, at: int, fallback: int = 50) -> int:
        """The place after a statement: its semicolon, or the end of the line on which it is complete."""
        i = at
        while m := re.compile(r"[(\[{;)\]}\n]").search(self.code, i):
            p, c = m.start(), m.group()
            if c == ";":
                return p + 1
            if c in ")]}":
                return p
            if c in "([{":
                close = self.closes.get(p)
                if close is None:
                    return self.after_lines(at, fallback)
                i = close + 1
                continue
            i = p + 1
            if self.language == "rust" or re.search(r"(?:[=|&,(+\-*?:<.]|=>|\b(?:extends|return))\s*$", self.code[max(at, p - 40) : p]):
                continue
            if self.language == "script" and re.compile(r"\s*(?:[.|&?:=+*,]|=>)").match(self.code, i):
                continue
            return p
        return len(self.text)
