"""Source text to rows: functions, classes, imports and calls of one file, for five languages.

Python that is sound goes through the standard syntax tree. All else is read from tokens with
paired brackets by small machines that know which blocks hold statements, members or neither; an
error costs what it stands in, and the other entities stay.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.functions import udtf

from .tokens import Source, braced, python_lines

SNIPPET, DOCSTRING = 2000, 1000
#: Fixed value: ends a snippet that was cut.
CUT = "\n# ... truncated"
#: kind: function, class, import or call. For calls `name` is the callee and `owner` the caller.
SCHEMA = "kind string, pos int, name string, start_line int, end_line int, signature string, docstring string, snippet string, owner string, bases array<string>"


def _row(kind: str, pos: int, name: str, start: int, end: int, signature: str = "", docstring: str = "", snippet: str = "", owner: str | None = None, bases: list[str] | None = None) -> tuple:
    snippet = snippet if len(snippet) <= SNIPPET else snippet[:SNIPPET] + CUT
    return kind, pos, name, start, end, signature, docstring[:DOCSTRING], snippet, owner, bases or []


def _finish(functions: list[dict], classes: list[dict], imports: list[str], sites: list[tuple[str, int]], lines: list[str]) -> Iterator[tuple]:
    """Rows of what was found: methods get the last class around them, calls the shortest function around them, the first of equal ones."""
    for k, x in enumerate(classes):
        yield _row("class", k, x["name"], x["start"], x["end"], docstring=x.get("doc", ""), bases=x.get("bases"))
    opens: dict[int, list[int]] = {}
    for k, c in enumerate(classes):
        opens.setdefault(c["start"], []).append(k)
    for k, f in enumerate(functions):
        around = [c["name"] for c in classes if c["start"] <= f["start"] and f["end"] <= c["end"]]
        yield _row("function", k, f["name"], f["start"], f["end"], f.get("signature", ""), f.get("doc", ""), "\n".join(lines[f["start"] - 1 : f["end"]]), around[-1] if around else None)
    for k, name in enumerate(imports):
        yield _row("import", k, name, 0, 0)
    inside = _callers(functions, len(lines))
    for k, (name, line) in enumerate(sites):
        if caller := inside[line] if line < len(inside) else None:
            yield _row("call", k, name, line, line, owner=caller)


def _callers(functions: list[dict], lines: int) -> list[str | None]:
    """For each line the shortest function around it: long ones are laid down first, so shorter ones cover them."""
    out: list[str | None] = [None] * (lines + 2)
    for f in sorted(reversed(functions), key=lambda f: f["start"] - f["end"]):
        for line in range(f["start"], min(f["end"], lines) + 1):
            out[line] = f["name"]
    return out


# Python ---------------------------------------------------------------------------------------


def _python(content: str, tree: ast.Module) -> Iterator[tuple]:
    lines = content.split("\n")
    functions, classes, imports, sites = [], [], [], []
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    for n in nodes:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            end = max(n.lineno, n.body[0].lineno - 1) if n.body[0].lineno > n.lineno else n.lineno
            head = "\n".join(lines[n.lineno - 1 : end])
            functions.append({"name": n.name, "start": n.lineno, "end": n.end_lineno, "signature": head.strip().split(":\n")[0].rstrip(":").strip(), "doc": (ast.get_docstring(n) or "").strip()})
        elif isinstance(n, ast.ClassDef):
            classes.append({"name": n.name, "start": n.lineno, "end": n.end_lineno, "doc": (ast.get_docstring(n) or "").strip(), "bases": [b.id for b in n.bases if isinstance(b, ast.Name)]})
        elif isinstance(n, ast.Import):
            imports += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            imports.append(n.module)
        elif isinstance(n, ast.Call):
            name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
            if name:
                sites.append((name, n.lineno))
    return _finish(functions, classes, imports, sites, lines)


_PYTHON_WORDS = frozenset("if elif else while for in is not and or return yield lambda assert del raise await with as print exec from import except def class async".split())


def _python_tokens(content: str) -> Iterator[tuple]:
    """Python that has no syntax tree: headers by their words, blocks by their indentation."""
    src, lines = python_lines(content)
    functions, classes, imports, sites, open_blocks = [], [], [], [], []
    end = 0

    def close(indent: int) -> None:
        while open_blocks and open_blocks[-1][0] >= indent:
            open_blocks.pop()[1]["end"] = end

    for n, (first, after, indent) in enumerate(lines):
        close(indent)
        end = src.last_line(after - 1)
        words = src.words[first:after]
        k = first + (words[0] == "async" and len(words) > 1)
        named = src.word(k + 1) if k + 1 < after and src.kinds[k + 1] == "id" else None
        body = lines[n + 1] if n + 1 < len(lines) and lines[n + 1][2] > indent else None
        if src.words[k] in ("def", "class") and named:
            is_class, at = src.words[k] == "class", k + 2
            while at < after and src.words[at] == "[":  # type parameters
                at = src.pair.get(at, after) + 1
            bracket = at if at < after and src.words[at] == "(" and at in src.pair else None
            stop = src.pair[bracket] + 1 if bracket is not None else at
            colon = next((i for i in range(stop, after) if src.words[i] == ":" and src.kinds[i] == "p"), None)
            if (bracket is not None or is_class) and (colon is not None or body):
                doc = next((src.words[i] for i in (colon + 1 if colon is not None and colon + 1 < after else body[0] if body else after,) if i < len(src.kinds) and src.kinds[i] == "str"), "")
                doc = re.sub(r"^[a-zA-Z]{0,2}('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", doc).strip()
                held = {"name": named, "start": src.line_of(first), "end": end, "doc": doc}
                if is_class:
                    inner = range(bracket + 1, src.pair[bracket]) if bracket is not None else ()
                    held["bases"] = [src.words[i] for i in inner if src.kinds[i] == "id" and src.words[i - 1] in ("(", ",") and src.words[i + 1] in (")", ",")]
                    classes.append(held)
                else:
                    held["signature"] = content[src.at[first] : src.end((colon if colon is not None else after) - 1)].strip()
                    functions.append(held)
                open_blocks.append((indent, held))
        elif words[0] == "import":
            imports += re.findall(r"(?:^|,)\s*([\w.]+)", "".join(f" {w} " if w == "as" else w for w in words[1:]))
        elif words[0] == "from" and "import" in words and len(words) > 1 and src.kinds[first + 1] == "id":
            imports.append("".join(words[1 : words.index("import")]))
        for i in range(first, after - 1):
            if src.kinds[i] == "id" and src.words[i + 1] == "(" and src.words[i] not in _PYTHON_WORDS and src.word(i - 1) not in ("def", "class"):
                sites.append((src.words[i], src.line_of(i)))
    close(-1)
    return _finish(functions, classes, imports, sites, content.split("\n"))


# languages with braces ------------------------------------------------------------------------

_MODIFIERS = frozenset("public private protected static abstract final native synchronized transient volatile strictfp default sealed non".split())
_MEMBER_WORDS = frozenset("public private protected static async get set readonly abstract override declare accessor".split())
_NO_CALLS = {
    "java": frozenset("if for while switch catch return new else try do throw super this synchronized assert case yield instanceof".split()),
    "go": frozenset("if for switch select return go defer range case chan map interface struct type func else var const import package".split()),
    "javascript": frozenset("if for while switch catch return new else try do throw super function class await typeof delete void in of instanceof yield case import".split()),
}
_NO_CALLS["typescript"] = _NO_CALLS["javascript"]


class _Braced:
    """A walk over the blocks of one source, with a stack of those still to be read instead of recursion."""

    def __init__(self, content: str, language: str):
        self.src, self.content, self.language = braced(content, language), content, language
        self.functions, self.classes, self.imports = [], [], []
        self.named: set[int] = set()  # tokens that declare a name
        self.todo: list[tuple[int, int, str, str | None]] = []

    def rows(self) -> Iterator[tuple]:
        src = self.src
        self.todo.append((0, len(src.words), "top", None))
        step = {"java": self.java, "go": self.go}.get(self.language, self.script)
        while self.todo:
            step(*self.todo.pop())
        for held in (self.functions, self.classes):
            held.sort(key=lambda x: x["at"])
        return _finish(self.functions, self.classes, self.imports, self.calls(), self.content.split("\n"))

    def doc(self, first: int, kinds: tuple[str, ...] = ("/*", "//")) -> str:
        """The one comment that stands right before a token, spaces apart."""
        at = self.src.at[first]
        before = len(self.content[:at].rstrip())
        start = self.src.comments.get(before)
        if start is None:
            start = next((self.src.comments[e] for e in range(before, at + 1) if e in self.src.comments), None)
        raw = self.content[start:before] if start is not None else ""
        return raw.strip("/* \n\t") if raw.startswith(kinds) else ""

    def block(self, at: int) -> int:
        """The token that ends the block that begins with a token."""
        return self.src.pair.get(at, len(self.src.words) - 1)

    def function(self, name: int, first: int, body: int | None, last: int, doc: str = "") -> None:
        src = self.src
        self.named.add(name)
        stop = src.at[body] if body is not None else src.end(last)
        self.functions.append({"name": src.words[name], "at": src.at[first], "start": src.line_of(first), "end": src.last_line(last), "signature": self.content[src.at[first] : stop].strip(), "doc": doc})

    def a_class(self, name: int, first: int, last: int, bases: list[str], doc: str = "") -> None:
        self.named.add(name)
        self.classes.append({"name": self.src.words[name], "at": self.src.at[first], "start": self.src.line_of(first), "end": self.src.last_line(last), "bases": bases, "doc": doc})

    def after_new(self, at: int) -> bool:
        """Whether a dotted name that ends at a token follows `new`."""
        while at >= 2 and self.src.words[at - 1] == "." and self.src.kinds[at - 2] == "id":
            at -= 2
        return self.src.word(at - 1) == "new"

    def calls(self) -> list[tuple[str, int]]:
        src, words, no = self.src, self.src.words, _NO_CALLS[self.language]
        out = []
        for i in range(len(words) - 1):
            if src.kinds[i] != "id" or i in self.named or words[i] in no and src.word(i - 1) not in (".", "?.") or words[i].startswith("#"):
                continue
            follows = words[i + 1] == "(" or self.language == "typescript" and words[i + 1] == "<" and self.generic_call(i + 1)
            before = src.word(i - 1)
            if not follows or before in ("@", "function", "func", "class", "record") or before == "]" and self.language == "go" or self.after_new(i):
                continue
            if words[i] == "async" and src.word(src.pair.get(i + 1, i) + 1) == "=>":
                continue
            if before == "." and self.language == "java" and self.annotation(i):
                continue
            first = i
            while src.word(first - 1) in (".", "?.", "::") and first >= 2 and src.kinds[first - 2] in ("id", "str", "num"):
                first -= 2  # a call begins where its chain of names does
            out.append((words[i], src.line_of(first)))
        return out

    def annotation(self, at: int) -> bool:
        while at >= 2 and self.src.words[at - 1] == ".":
            at -= 2
        return self.src.word(at - 1) == "@"

    def generic_call(self, at: int) -> bool:
        depth = 0
        for i in range(at, min(at + 40, len(self.src.words))):
            word = self.src.words[i]
            depth += (word == "<") - (word == ">")
            if not depth:
                return self.src.word(i + 1) == "("
            if self.src.kinds[i] == "p" and word not in "<>,.[]|&{}:" or self.src.kinds[i] == "num":
                return False
        return False

    # Java

    def head(self, lo: int, hi: int) -> list[int]:
        """Tokens of a member's head without annotations and what stands in brackets; an opening bracket stands for its pair."""
        src, out, i = self.src, [], lo
        while i < hi:
            if src.words[i] == "@" and src.word(i + 1) != "interface":
                i += 2
                while src.word(i) == "." and i < hi:
                    i += 2
                if src.word(i) == "(":
                    i = self.block(i) + 1
                continue
            out.append(i)
            i = self.block(i) + 1 if src.words[i] in ("(", "[") and src.kinds[i] == "p" else i + 1
        return out

    def kind_of(self, head: list[int]) -> tuple[str, int] | None:
        """class, interface, enum or record, and the token of its name, if a head declares one."""
        src = self.src
        for i in head:
            if src.words[i] in ("class", "interface", "enum") and src.word(i - 1) != "." and i + 1 < len(src.kinds) and src.kinds[i + 1] == "id":
                return src.words[i], i + 1
            if src.words[i] == "record" and i + 1 < len(src.kinds) and src.kinds[i + 1] == "id" and src.word(i + 2) in ("(", "<"):
                return "record", i + 1
            if src.words[i] in ("=", "(") or src.kinds[i] == "p" and src.words[i] not in ("@", "<", ">", ",", "?", ".", "-", "&"):
                return None
        return None

    def method(self, head: list[int], owner: str | None) -> int | None:
        """The name's token, if a head declares a method: a name before parentheses, and a type before the name."""
        src = self.src
        for k, i in enumerate(head):
            if src.words[i] == "=":
                return None
            if src.words[i] == "(" and src.kinds[i] == "p":
                name = head[k - 1] if k else None
                if k < 2 or src.kinds[name] != "id" or src.words[name] == owner:
                    return None
                before = src.words[head[k - 2]]
                typed = src.kinds[head[k - 2]] == "id" and before not in _MODIFIERS and before not in ("return", "new", "throw", "else", "case") or before in (">", "[")
                return name if typed else None
        return None

    def java_type(self, kind: str, name: int, lo: int, at: int) -> None:
        """A declared type whose body begins at a token."""
        src, close = self.src, self.block(at)
        self.named.add(name)
        if kind == "class":
            words = src.words[name + 1 : at]
            bases = []
            depth, start = 0, None
            for k, w in enumerate([*words, "{"], name + 1):
                depth += (w == "<") - (w == ">")
                if start is None and w == "extends" and not depth:
                    start = k + 1
                elif start is not None and not depth and w in ("implements", "permits", "{"):
                    bases = [self.content[src.at[start] : src.end(k - 1)]] if k > start else []
                    break
            self.a_class(name, lo, close, bases, self.doc(lo, ("/*",)))
        self.todo.append((at + 1, close, "enum" if kind == "enum" else "type", src.words[name]))

    def java(self, lo: int, hi: int, kind: str, owner: str | None) -> None:
        src, i, start, constants = self.src, lo, lo, kind == "enum"
        while i < hi:
            word = src.words[i] if src.kinds[i] == "p" else ""
            if kind == "code":
                if word == "{":
                    declared = self.kind_of(self.head(start, i))
                    close = self.block(i)
                    if declared:
                        self.java_type(*declared, start, i)
                    else:
                        self.todo.append((i + 1, close, "type" if self.anonymous(i) else "code", None))
                    i = start = close + 1
                    continue
                if word == ";" or word == "}":
                    start = i + 1
                i += 1
                continue
            if word in ("(", "["):
                if constants or any(src.words[k] == "=" for k in self.head(start, i)):
                    self.todo.append((i + 1, self.block(i), "code", None))
                    if constants:
                        self.named.add(i - 1)
                i = self.block(i) + 1
                continue
            if word == "{":
                head, close = self.head(start, i), self.block(i)
                declared = self.kind_of(head)
                if constants and not declared:
                    self.todo.append((i + 1, close, "type", None))
                    i = close + 1
                    continue
                if declared:
                    self.java_type(*declared, start, i)
                elif any(src.words[k] == "=" for k in head):
                    self.todo.append((i + 1, close, "type" if self.anonymous(i) else "code", None))
                    i = close + 1
                    continue
                else:
                    name = self.method(head, owner)
                    if name is not None:
                        self.function(name, start, i, close, self.doc(start, ("/*",)))
                    for k in head:
                        if src.words[k] == "(":
                            self.named.add(k - 1)
                    self.todo.append((i + 1, close, "code", None))
                i = start = close + 1
                continue
            if word == "," and constants:
                start = i + 1
            if word == ";":
                head = self.head(start, i)
                if kind == "top" and head and src.words[head[0]] == "import":
                    words = [src.words[k] for k in head[1:] if src.words[k] != "static"]
                    name = "".join(words[:-2] if words[-2:] == [".", "*"] else words)
                    if "." in name:
                        self.imports.append(name)
                elif kind in ("type", "enum"):
                    name = self.method(head, owner)
                    if name is not None:
                        self.function(name, start, None, i)
                start, constants = i + 1, False
            i += 1

    def anonymous(self, brace: int) -> bool:
        """Whether a brace opens the body of `new A(...)`."""
        src = self.src
        at = src.pair.get(brace - 1, 0) - 1 if src.word(brace - 1) == ")" else -1
        if at >= 0 and src.words[at] == ">":
            depth = 0
            while at >= 0:
                depth += (src.words[at] == ">") - (src.words[at] == "<")
                at -= 1
                if not depth:
                    break
        return at >= 0 and src.kinds[at] == "id" and self.after_new(at)

    # Go

    def go(self, lo: int, hi: int, kind: str, owner: str | None) -> None:
        src, i = self.src, lo
        while i < hi:
            word, begins = src.words[i], i == 0 or src.words[i - 1] in (";", "{", "}") or src.first_on_line(i)
            if word == "func" and src.word(i + 1) and begins:
                at = i + 1
                method = src.words[at] == "("
                if method:
                    at = self.block(at) + 1
                if at < hi and src.kinds[at] == "id":
                    self.named.add(at)
                    body = self.go_body(at + 1, hi)
                    if not method:
                        self.function(at, i, body, self.block(body) if body is not None else at, self.doc(i))
                    i = at + 1
                    continue
            elif word == "type" and begins and i + 1 < hi:
                i = self.go_types(i, hi)
                continue
            elif word == "import" and begins:
                at = i + 1
                last = self.block(at) if src.word(at) == "(" else at + (src.kinds[at] != "str" if at < hi else 0)
                self.imports += [src.words[k].strip('"`') for k in range(at, min(last + 1, hi)) if src.kinds[k] == "str" and src.words[k].startswith('"')]
                i = last + 1
                continue
            i += 1

    def go_body(self, at: int, hi: int) -> int | None:
        """The brace that opens the body of a function whose parameters begin at a token; none where it has no body."""
        src = self.src
        while at < hi:
            word = src.words[at]
            if word == "{":
                if src.words[at - 1] not in ("interface", "struct"):
                    return at
                at = self.block(at)
            elif word in ("(", "["):
                at = self.block(at)
            elif src.first_on_line(at):
                return None
            at += 1
        return None

    def go_types(self, first: int, hi: int) -> int:
        """Read a type declaration, of several types if in parentheses; returns the token after it."""
        src = self.src
        group = src.words[first + 1] == "("
        at, last = first + 1 + group, self.block(first + 1) if group else None
        names, stop = [], last if group else hi
        while at < stop and src.kinds[at] == "id":
            name, at = at, at + 1
            if src.word(at) == "[" and src.word(self.block(at) + 1) not in ("", ")") and src.kinds[min(at + 1, hi - 1)] == "id" and src.line_of(self.block(at)) == src.line_of(name) and self.block(at) > at + 2:
                at = self.block(at) + 1  # type parameters
            if src.word(at) != "=":
                names.append(name)
            while at < stop:
                at = self.block(at) + 1 if src.words[at] in ("(", "[", "{") else at + 1
                if at >= stop or src.words[at] == ";" or src.first_on_line(at):
                    break
            if at < stop and src.words[at] == ";":
                at += 1
            if not group:
                break
        end = last if group else at - 1
        for name in names:
            self.a_class(name, first, end, [])
        for k in range(first, min(end + 1, hi) - 1):  # methods of an interface are no calls
            if src.kinds[k] == "id" and src.words[k + 1] == "(":
                self.named.add(k)
        return end + 1

    # JavaScript and TypeScript

    def declares(self, at: int) -> bool:
        """Whether a statement begins at a token, with `export`, `default`, `abstract` or `async` before it or not."""
        src = self.src
        if at == 0:
            return True
        before = src.words[at - 1]
        if before in ("export", "default", "abstract", "declare", "async") and src.kinds[at - 1] == "id":
            return self.declares(at - 1) or before in ("export", "default")
        if src.kinds[at - 1] == "p":
            return before in (";", "{", "}", ")")
        return before in ("else", "do") or src.first_on_line(at) and before not in _BEFORE_VALUE

    def types_end(self, at: int, hi: int) -> int | None:
        """The brace that opens a body behind parameters that end before a token; what follows a colon is a type and may hold braces."""
        src, wanted = self.src, False
        while at < hi:
            word = src.words[at]
            if word == "{" and src.kinds[at] == "p":
                if not wanted:
                    return at
                at, wanted = self.block(at), False
            elif word in ("(", "["):
                at, wanted = self.block(at), False
            elif word in (";", "}", ")", "="):
                return None
            elif src.kinds[at] == "p":
                wanted = word != ">"
            else:
                wanted = word in ("extends", "is", "keyof", "typeof", "infer", "asserts")
            at += 1
        return None

    def params(self, at: int, hi: int) -> int | None:
        """The parenthesis that opens parameters at a token, type parameters passed over."""
        src = self.src
        if src.word(at) == "<":
            depth = 0
            while at < hi:
                depth += (src.words[at] == "<") - (src.words[at] == ">")
                at += 1
                if not depth:
                    break
        return at if at < hi and src.words[at] == "(" and src.kinds[at] == "p" else None

    def member(self, at: int, hi: int) -> tuple[int, int, int] | None:
        """(first token, name, body) of a method that begins at a token."""
        src, first = self.src, at
        while at < hi and (src.words[at] in _MEMBER_WORDS or src.words[at] == "*") and src.word(at + 1) not in ("(", "<", "?", "=", ":", ",", ";"):
            at += 1
        if at >= hi or src.kinds[at] != "id" or src.words[at].startswith("#"):
            return None
        start = self.params(at + 1 + (src.word(at + 1) in ("?", "!")), hi)
        body = self.types_end(self.block(start) + 1, hi) if start is not None else None
        return (first, at, body) if body is not None else None

    def script(self, lo: int, hi: int, kind: str, owner: str | None) -> None:
        src, i, depth, fresh = self.src, lo, 0, kind in ("class", "object")
        known: dict[int, str] = {}
        while i < hi:
            word, sign = src.words[i], src.kinds[i] == "p"
            if kind == "class" and not depth and not fresh and src.first_on_line(i) and (src.kinds[i - 1] != "p" or src.words[i - 1] in (")", "]", "}")):
                fresh = True
            if fresh and not depth:
                if word == "@":
                    i += 2
                    while src.word(i) == ".":
                        i += 2
                    if src.word(i) == "(":
                        i = self.block(i) + 1
                    continue
                found = self.member(i, hi)
                fresh = False
                if found:
                    first, name, body = found
                    self.function(name, first, body, self.block(body), self.doc(first))
                    known[body] = "code"
                    i = name + 1
                    continue
                if kind == "class" and src.kinds[i] == "id" and word not in ("static",):
                    self.named.add(i)  # a field, or a signature without body
                    k = i
                    while src.words[k] in _MEMBER_WORDS and k + 1 < hi and src.kinds[k + 1] == "id":
                        k += 1
                        self.named.add(k)
            if sign and word in ("(", "["):
                depth += 1
            elif sign and word in (")", "]"):
                depth = max(0, depth - 1)
            elif sign and word == "{":
                close = self.block(i)
                inner = known.get(i) or self.braces(i, kind)
                if inner != "skip":
                    self.todo.append((i + 1, close, inner, None))
                else:
                    self.named.update(range(i, close))
                i = close + 1
                fresh = kind == "class" and not depth
                continue
            elif sign and not depth and (word == "," and kind == "object" or word == ";" and kind == "class"):
                fresh = True
            elif word == "function" and not sign and src.word(i - 1) != ".":
                star = src.word(i + 1) == "*"
                name = i + 1 + star
                start = self.params(name + (name < hi and src.kinds[name] == "id"), hi)
                body = self.types_end(self.block(start) + 1, hi) if start is not None else None
                if name < hi and src.kinds[name] == "id":
                    self.named.add(name)
                if body is not None:
                    known[body] = "code"
                    if not star and src.kinds[name] == "id" and self.declares(i):
                        first = i - 1 if src.word(i - 1) == "async" else i
                        doc = "" if src.word(first - 1) in ("export", "default") else self.doc(first)
                        self.function(name, first, body, self.block(body), doc)
            elif word == "class" and not sign and src.word(i - 1) != "." and src.word(i + 1) not in (":", "=", ",", ")", "("):
                body = self.heritage(i + 1, hi)
                if body is not None:
                    known[body] = "class"
                    name = i + 1
                    if src.kinds[name] == "id" and src.words[name] not in ("extends", "implements") and self.declares(i) and src.word(i - 1) != "abstract":
                        at = next((k for k in range(name + 1, body) if src.words[k] == "extends"), None)
                        plain = at is not None and self.language == "javascript" and at + 2 == body and src.kinds[at + 1] == "id"
                        doc = "" if src.word(i - 1) in ("export", "default") else self.doc(i)
                        self.a_class(name, i, self.block(body), [src.words[at + 1]] if plain else [], doc)
                    i = body
                    continue
            elif self.language == "typescript" and word in ("interface", "enum") and i + 1 < hi and src.kinds[i + 1] == "id" and src.word(i - 1) != ".":
                body = self.heritage(i + 2, hi)
                if body is not None:
                    known[body] = "skip"
                    i = body
                    continue
            elif word == "import" and kind == "top" and self.declares(i) and src.word(i + 1) not in ("(", "."):
                at = next((k for k in range(i + 1, min(i + 400, hi)) if src.kinds[k] == "str" or src.words[k] == ";"), None)
                if at is not None and src.kinds[at] == "str":
                    self.imports.append(src.words[at].strip("'\""))
                    i = at
            i += 1

    def heritage(self, at: int, hi: int) -> int | None:
        """The brace that opens a class body, behind names, type arguments and calls."""
        src, angle = self.src, 0
        while at < hi:
            word = src.words[at]
            if word == "{" and not angle:
                return at
            if word in ("(", "[", "{") and src.kinds[at] == "p":
                at = self.block(at)
            elif word in (";", "}", "=>"):
                return None
            angle = max(0, angle + (word == "<") - (word == ">"))
            at += 1
        return None

    def braces(self, at: int, kind: str) -> str:
        """What a brace opens that no declaration explains: statements, or the members of an object."""
        src = self.src
        before = src.word(at - 1)
        if at == 0 or before in (";", "{", "}", ")", "=>"):
            return "code"
        if before == ":":
            k = at - 2
            while k >= 0 and src.line_of(k) == src.line_of(at - 1) and src.words[k] not in ("case", "default"):
                k -= 1
            return "code" if kind != "object" and k >= 0 and src.words[k] in ("case", "default") else "object"
        if src.kinds[at - 1] == "p" and before != "]" or before in _BEFORE_VALUE:
            return "object"
        return "code"


_BEFORE_VALUE = frozenset("return typeof default yield await in of new void delete throw case extends".split())


def broken_line(language: str | None, content: str | None) -> int | None:
    """The line of the first error that had to be mended, or None."""
    if not content or language not in LANGUAGES:
        return None
    if language != "python":
        return braced(content, language).broken
    try:
        ast.parse(content)
    except SyntaxError as error:
        return error.lineno or 1
    except (ValueError, RecursionError, MemoryError):
        return 1
    return None


LANGUAGES = ("python", *_NO_CALLS)


def parse(language: str | None, content: str | None) -> list[tuple]:
    """Rows of SCHEMA; none for unknown languages. Text with errors gives what is found around them."""
    return parse_and_check(language, content)[0]


def parse_and_check(language: str | None, content: str | None) -> tuple[list[tuple], int | None]:
    """Rows of SCHEMA, and the line of the first error that had to be mended, or None; the text is read once."""
    if not content or language not in LANGUAGES:
        return [], None
    if language != "python":
        walk = _Braced(content, language)
        return list(walk.rows()), walk.src.broken
    line = None
    try:
        tree = ast.parse(content)
    except SyntaxError as error:
        line = error.lineno or 1
    except (ValueError, RecursionError, MemoryError):
        line = 1
    if line is None:
        # what is sound, but too deep to be walked, is read from tokens too
        try:
            return list(_python(content, tree)), None
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    return list(_python_tokens(content)), line


@udtf(returnType=f"{SCHEMA}, broken int")
class ParseSource:
    """Table function of (language, content): rows of SCHEMA, and in each the line of the first mended error, if any."""

    def eval(self, language: str, content: str):
        rows, line = parse_and_check(language, content)
        for row in rows:
            yield (*row, line)


#: What `entities` gives: the file, SCHEMA and the line of the first mended error.
ENTITIES = f"path string, language string, {SCHEMA}, broken int"


def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (path, language, content) to those of ENTITIES, in runs of about RUN rows."""
    columns: list[list] = [[] for _ in _ARROW.names]
    for part in parts:
        for path, language, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
            rows, line = parse_and_check(language, content)
            for row in rows:
                for column, value in zip(columns, (path, language, *row, line), strict=True):
                    column.append(value)
            if len(columns[0]) >= RUN:
                yield _made(columns)
    if columns[0]:
        yield _made(columns)


def _made(columns: list[list]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], _ARROW.names)
    for c in columns:
        c.clear()
    return out


RUN = 4096
_ARROW = pa.schema([(name, {"string": pa.string(), "int": pa.int32()}.get(kind, pa.list_(pa.string()))) for name, kind in (x.split() for x in ENTITIES.split(", "))])
