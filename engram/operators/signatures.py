"""What a declaration's head says: parameters, generics, result, visibility, decorators, hook dependencies.

A head is read by matching brackets, not by a grammar: it begins at the declaration's line and ends where its body does.
"""

from __future__ import annotations

import re

#: What opens and closes a text; Rust's lifetimes begin with a single quote as well, so it has the first only.
QUOTES, RUST_QUOTES = "\"`'", '"'
CLOSES = {"(": ")", "[": "]", "{": "}", "<": ">"}
VISIBLE = {"pub": "public", "pub(crate)": "crate", "pub(super)": "super"}
HOOK_CALL = re.compile(r"\b(?:useEffect|useMemo|useCallback)\s*\(")


def closing(text: str, at: int, quotes: str = QUOTES) -> int:
    """The place of the bracket that closes the one at `at`; the end of the text without one. Strings and arrows are stepped over."""
    open_, quote = [], ""
    i = at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in quotes:
            quote = c
        elif c in "([{" or c == "<" and text[at] == "<":
            open_.append(CLOSES[c])
        elif open_ and c == open_[-1] and not (c == ">" and text[i - 1] in "=-"):
            open_.pop()
            if not open_:
                return i
        i += 1
    return len(text)


def parts(text: str, at: str = ",", quotes: str = QUOTES) -> list[str]:
    """A text cut at a mark outside of all brackets."""
    out, depth, begin, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in quotes:
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}" or c == ">" and (not i or text[i - 1] not in "=-"):
            depth -= 1
        elif depth <= 0 and text.startswith(at, i):
            out.append(text[begin:i])
            begin = i + len(at)
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def generics(text: str, quotes: str = QUOTES) -> list[dict]:
    """Names and their bounds; lifetimes and defaults aside."""
    out = []
    for p in parts(text, quotes=quotes):
        name, *bound = re.split(r"\s+extends\s+|\s*:\s*", re.split(r"\s*(?<![=!<>])=(?![=>])", p)[0], maxsplit=1)
        if not name.startswith("'"):
            out.append({"name": name.strip()} | ({"constraint": bound[0].strip()} if bound else {}))
    return out


def script_parameter(text: str) -> dict:
    text = re.sub(r"^(?:@\w+(?:\([^)]*\))?\s*|(?:public|private|protected|readonly|override)\s+)+", "", text)
    whole, value = (re.split(r"(?<![=!<>])=(?![=>])", text, maxsplit=1) + [""])[:2]
    if whole.lstrip().startswith(("{", "[")):
        end = closing(whole, whole.index(whole.lstrip()[0])) + 1
        name, kind = whole[:end], whole[end:].lstrip().removeprefix("?").lstrip().removeprefix(":")
    else:
        name, _, kind = whole.partition(":")
    out = {"name": name.strip().removeprefix("...").rstrip("?").strip(), "isOptional": name.strip().endswith("?")}
    return out | ({"type": kind.strip()} if kind.strip() else {}) | ({"defaultValue": value.strip()} if value.strip() else {})


def go_parameters(text: str) -> list[dict]:
    """Names share the type that follows them; a list of types alone names nothing."""
    out, waiting = [], []
    for p in parts(text):
        name, _, kind = p.partition(" ")
        if re.fullmatch(r"\w+", name) and kind.strip():
            out += [{"name": n, "type": kind.strip()} for n in [*waiting, name]]
            waiting = []
        else:
            waiting.append(p)
    return out


def rust_parameter(text: str) -> dict | None:
    name, _, kind = text.partition(":")
    name = re.sub(r"^(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?", "", name.strip())
    return None if name == "self" else {"name": name, "type": kind.strip()}


def decorators(above: str) -> list[dict]:
    """The decorators on the lines right above, or right before, a declaration, from the first down."""
    out: list[dict] = []
    for line in reversed(above.split("\n")):
        if not line.strip():
            if out or line is not above.split("\n")[-1]:
                break
            continue
        found = []
        while m := re.match(r"\s*@([\w.]+)(\()?", line):
            to = closing(line, m.end() - 1) if m[2] else m.end() - 1
            found.append({"name": m[1]} | ({"arguments": parts(line[m.end() : to])} if m[2] else {}))
            line = line[to + 1 :]
        if line.strip():
            break
        out[:0] = found
    return out


def hook_dependencies(body: str) -> list[str]:
    out: list[str] = []
    for m in HOOK_CALL.finditer(body):
        given = parts(body[m.end() : closing(body, m.end() - 1)])
        if len(given) > 1 and given[1].startswith("["):
            out += parts(given[1][1:-1])
    return list(dict.fromkeys(out))


def signature(language: str, kind: str, name: str, body: str, above: str) -> dict | None:
    """The metadata of a declaration, from its text and that above it; None for kinds without any."""
    text = "\n".join(body.split("\n", 61)[:61])
    begin = re.search(rf"\b{re.escape(name)}\b", text)
    if not begin:
        return None
    before, rest = text[: begin.start()], text[begin.end() :]
    out: dict = {}
    quotes = RUST_QUOTES if language == "rust" else QUOTES
    callable_ = kind in ("function", "component", "method", "hook")
    if language == "go":
        if not callable_:
            return None
        if rest.startswith("["):
            to = closing(rest, 0)
            out["genericParams"], rest = [{"name": p.split()[0]} | ({"constraint": p.split(None, 1)[1]} if " " in p else {}) for p in parts(rest[1:to])], rest[to + 1 :]
        to = closing(rest, rest.find("("))
        out["parameters"] = go_parameters(rest[rest.find("(") + 1 : to])
        result = re.split(r"\s*(?<!interface)(?<!struct)\{", rest[to + 1 :], maxsplit=1)[0].strip()
        receiver = re.match(r"func\s+(\([^)]*\))", text)
        return out | ({"returnType": result} if result else {}) | ({"receiver": receiver[1]} if receiver else {})
    if language == "rust":
        visible = re.match(r"\s*(pub(?:\([^)]*\))?)", before)
        out["visibility"] = VISIBLE.get(visible[1].replace(" ", ""), "public") if visible else "private"
    else:
        if m := re.search(r"\b(public|private|protected)\b", before):
            out["visibility"] = m[1]
        if found := decorators(above):
            out["decorators"] = found
    if not callable_:
        generic = rest.lstrip()
        if generic.startswith("<"):
            out["genericParams"] = generics(generic[1 : closing(generic, 0, quotes)], quotes)
        return out or None
    if language == "rust":
        out["isAsync"] = bool(re.search(r"\basync\b", before))
    else:
        # What follows `name =` up to its parameters belongs to the head as well.
        given = re.match(r"\s*(?::[^=]*?)?=(?!>)\s*((?:React\.)?(?:memo|forwardRef|lazy)\s*\(\s*)?(async\b\s*)?(?:function\b\s*\*?\s*\w*\s*)?", rest)
        out["isAsync"] = bool(re.search(r"\basync\b", before)) or bool(given and given[2])
        rest = rest[given.end() :] if given else rest
    rest = rest.lstrip()
    if rest.startswith("<"):
        to = closing(rest, 0, quotes)
        out["genericParams"], rest = generics(rest[1:to], quotes), rest[to + 1 :].lstrip()
    if rest.startswith("("):
        to = closing(rest, 0, quotes)
        given_ = parts(rest[1:to], quotes=quotes)
        out["parameters"] = [p for p in map(rust_parameter, given_) if p] if language == "rust" else [script_parameter(p) for p in given_]
        rest = rest[to + 1 :].lstrip()
        if language == "rust" and rest.startswith("->"):
            out["returnType"] = re.split(r"\bwhere\b|[{;]", rest[2:], maxsplit=1)[0].strip()
        elif language != "rust" and rest.startswith(":"):
            out["returnType"] = re.split(r"=>|\{\s*$|\{\s*\n|;", rest[1:], maxsplit=1)[0].strip()
    elif m := re.match(r"(\w+)\s*=>", rest):
        out["parameters"] = [{"name": m[1], "isOptional": False}]
    if language == "script" and (found := hook_dependencies(body)):
        out["hookDependencies"] = found
    return out
