"""Source text to tokens with brackets paired, for languages with braces and for Python; errors are mended, never raised."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

_ID = r"[^\W\d][\w$]*|\$[\w$]*"
_NUMBER = r"\d[\w.]*"
_COMMENTS = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_SCAN = {
    "java": re.compile(rf"\s+|{_COMMENTS}|(?P<str>\"\"\"(?:\\.|(?!\"\"\").)*(?:\"\"\"|\Z)|{_QUOTED})|(?P<id>{_ID})|(?P<num>{_NUMBER})|(?P<p>->|::|.)", re.S),
    "go": re.compile(rf"\s+|{_COMMENTS}|(?P<str>`[^`]*(?:`|\Z)|{_QUOTED})|(?P<id>{_ID})|(?P<num>{_NUMBER})|(?P<p>:=|.)", re.S),
    "javascript": re.compile(rf"\s+|{_COMMENTS}|(?P<str>{_QUOTED})|(?P<id>#?(?:{_ID}))|(?P<num>{_NUMBER})|(?P<p>=>|\?\.(?!\d)|\.\.\.|&&|\|\||\?\?|.)", re.S),
    "python": re.compile(
        rf"[ \t\f]+|\\\r?\n|(?P<comment>#[^\n]*)|(?P<str>(?:[rRbBuUfFtT]{{1,2}})?(?:\"\"\"(?:\\.|(?!\"\"\").)*\"\"\"|'''(?:\\.|(?!''').)*'''|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))|(?P<line>\r?\n)|(?P<id>{_ID})|(?P<num>{_NUMBER})|(?P<p>->|:=|.)",
        re.S,
    ),
}
_SCAN["typescript"] = _SCAN["javascript"]
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: After these a slash begins a regular expression, as after most signs.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new instanceof do else yield await".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words that may begin a line within a block without being indented deeper than it.
_LABELS = frozenset(("case", "default"))


@dataclass
class Source:
    """Tokens (kind, text, place) of kinds id, num, str and p, comments by their end, and the other bracket of each one."""

    text: str
    kinds: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    comments: dict[int, int] = field(default_factory=dict)
    pair: dict[int, int] = field(default_factory=dict)
    #: Line of the first bracket that had no other, or None.
    broken: int | None = None

    def __post_init__(self) -> None:
        self.breaks = [m.start() for m in re.finditer("\n", self.text)]

    def line(self, place: int) -> int:
        return bisect.bisect_left(self.breaks, place) + 1

    def line_of(self, token: int) -> int:
        return self.line(self.at[token])

    def last_line(self, token: int) -> int:
        return self.line(self.end(token) - 1)

    def end(self, token: int) -> int:
        return self.at[token] + len(self.words[token])

    def word(self, token: int) -> str:
        return self.words[token] if 0 <= token < len(self.words) else ""

    def add(self, kind: str, word: str, at: int) -> None:
        self.kinds.append(kind)
        self.words.append(word)
        self.at.append(at)

    def indent(self, token: int) -> int:
        """Column of the first character of a token's line that is no space."""
        line = self.line_of(token)
        start = self.breaks[line - 2] + 1 if line > 1 else 0
        return len(self.text[start:]) - len(self.text[start:].lstrip(" \t")) if start + 200 > len(self.text) else len((part := self.text[start : start + 200])) - len(part.lstrip(" \t"))

    def first_on_line(self, token: int) -> bool:
        return token == 0 or self.line_of(token) > self.last_line(token - 1)


def braced(text: str, language: str) -> Source:
    """Tokens of Java, Go, JavaScript or TypeScript."""
    out, scan, script, at = Source(text), _SCAN[language], language in ("javascript", "typescript"), 0
    templates: list[int] = []  # depths of braces at which a template goes on
    depth = 0
    if not script or "/" not in text and "`" not in text:
        # no regular expressions and no templates, so each token begins where the last one ends
        kinds, words, places = out.kinds, out.words, out.at
        for m in scan.finditer(text):
            kind = m.lastgroup
            if kind == "comment":
                out.comments[m.end()] = m.start()
            elif kind:
                kinds.append(kind)
                words.append(m[0])
                places.append(m.start())
        at = len(text)
    while at < len(text):
        c = text[at]
        if script and c == "/" and _takes_regex(out) and (m := _REGEX.match(text, at)):
            out.add("str", m[0], at)
            at = m.end()
            continue
        if script and (c == "`" or c == "}" and templates and templates[-1] == depth):
            if c == "}":
                templates.pop()
                out.add("p", ")", at)
            end = _TEMPLATE.match(text, at + 1).end()
            out.add("str", text[at + (c == "}") : end], at + (c == "}"))
            if text[end : end + 2] == "${":
                templates.append(depth)
                out.add("p", "(", end + 1)
                at = end + 2
            else:
                at = end + 1
            continue
        m = scan.match(text, at)
        if m.lastgroup == "comment":
            out.comments[m.end()] = at
        elif m.lastgroup:
            out.add(m.lastgroup, m[0], at)
            depth += (m[0] == "{") - (m[0] == "}")
        at = m.end()
    _match(out, False)
    if out.broken:
        _match(out, True)
    return out


def _takes_regex(out: Source) -> bool:
    if not out.words:
        return True
    kind, word = out.kinds[-1], out.words[-1]
    if kind == "id":
        return word in _BEFORE_REGEX
    return kind == "p" and word not in (")", "]")


def _match(out: Source, by_indent: bool) -> None:
    """Pair the brackets.

    A closing bracket that is not the last open one's closes what it belongs to further out, and
    all within; parentheses do not close braces. What nothing closes ends with the text, or, by
    indent, before a line that is not indented deeper than the one that opened it.
    """
    out.pair, stack, broken = {}, [], None
    kinds = out.kinds
    for i, word in enumerate(out.words):
        if not by_indent and kinds[i] != "p":
            continue
        if by_indent and stack and word not in CLOSE and word not in _LABELS and out.first_on_line(i):
            column = out.indent(i)
            while stack and out.indent(stack[-1]) >= column and out.line_of(stack[-1]) < out.line_of(i) and not (word == "{" and out.words[stack[-1]] == "{"):
                out.pair[stack.pop()] = i - 1
        if kinds[i] != "p":
            continue
        if word in OPEN:
            stack.append(i)
        elif word in CLOSE:
            at = len(stack) - 1
            while at >= 0 and out.words[stack[at]] != CLOSE[word] and (word == "}" or out.words[stack[at]] != "{"):
                at -= 1
            if at < 0 or out.words[stack[at]] != CLOSE[word]:
                broken = broken or out.line_of(i)
                continue
            if at < len(stack) - 1:
                broken = broken or out.line_of(stack[-1])
            for inner in stack[at + 1 :]:
                out.pair[inner] = i - 1
            out.pair[stack[at]], out.pair[i] = i, stack[at]
            del stack[at:]
    for i in stack:
        broken = broken or out.line_of(i)
        out.pair[i] = len(out.words) - 1
    out.broken = out.broken or broken


#: Words with which a line of Python begins a statement, never a part of one.
_STATEMENTS = frozenset("def class import return raise pass try while finally except global nonlocal del assert break continue".split())


def python_lines(text: str) -> tuple[Source, list[tuple[int, int, int]]]:
    """Tokens, and logical lines as (first token, token after the last, indent).

    A line goes on within brackets; but one that begins with a statement's first word does not,
    so a bracket that was never closed costs its own line only.
    """
    out, lines, at, stack, first = Source(text), [], 0, [], 0
    while at < len(text):
        m = _SCAN["python"].match(text, at)
        if m.lastgroup == "line":
            rest = text[m.end() : m.end() + 400].lstrip(" \t")
            word = re.match(r"(?:async[ \t]+)?(\w*)", rest)[1]
            if not stack or word in _STATEMENTS:
                if stack:
                    out.broken, stack = out.broken or out.line_of(stack[0]), []
                if len(out.words) > first:
                    lines.append((first, len(out.words), out.indent(first)))
                    first = len(out.words)
        elif m.lastgroup in ("id", "num", "str", "p"):
            out.add(m.lastgroup, m[0], at)
            if m[0] in OPEN and m.lastgroup == "p":
                stack.append(len(out.words) - 1)
            elif m[0] in CLOSE and m.lastgroup == "p":
                if stack and out.words[stack[-1]] == CLOSE[m[0]]:
                    out.pair[stack[-1]] = len(out.words) - 1
                    stack.pop()
                else:
                    out.broken = out.broken or out.line(at)
        at = m.end()
    if len(out.words) > first:
        lines.append((first, len(out.words), out.indent(first)))
    return out, lines
