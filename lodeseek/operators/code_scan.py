"""Where source code can be cut: a scan that knows strings, comments and brackets.

For the languages with braces. A place is a line's start outside any string or comment,
with the number of brackets open there; a definition is a line that begins like one where
no bracket is open, with the comments and attributes just above it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LINE_COMMENT, BLOCK_COMMENT = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
#: A string within a line; one that isn't closed ends with the line.
STRING = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
CHAR = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
DIRECTIVE = r"^[ \t]*#(?:[^\n\\]|\\.)*"
#: A pattern literal: a slash where a value can begin.
PATTERN = r"(?<=[(,=:\[!&|?{};])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
#: Of each language what is read over, in the order in which it is tried.
OPAQUE = {
    "rust": [LINE_COMMENT, r'\bb?r(?P<fence>#*)".*?(?:"(?P=fence)|\Z)', r'"(?:[^"\\]|\\.)*(?:"|\Z)', r"'(?:[^'\\\n]|\\x..|\\u\{[^}\n]*\}|\\.)'"],
    "javascript": [LINE_COMMENT, BLOCK_COMMENT, STRING, CHAR, PATTERN],
    "java": [LINE_COMMENT, BLOCK_COMMENT, r'""".*?(?:"""|\Z)', STRING, CHAR],
    "c": [LINE_COMMENT, BLOCK_COMMENT, DIRECTIVE, STRING, CHAR],
    "cpp": [LINE_COMMENT, BLOCK_COMMENT, DIRECTIVE, r'\b(?:u8|[uUL])?R"(?P<fence>[^()\\\s]{0,16})\(.*?(?:\)(?P=fence)"|\Z)', STRING, r"(?<=[0-9a-fA-F])'(?=[0-9a-fA-F])", CHAR],
    "go": [LINE_COMMENT, BLOCK_COMMENT, r"`[^`]*(?:`|\Z)", STRING, CHAR],
}
OPAQUE["typescript"] = OPAQUE["javascript"]
#: What a scan stops at besides: templates and nested comments, which no pattern describes, brackets, line ends.
STOPS = {"rust": [r"(?P<nested>/\*)"], "javascript": ["(?P<template>`)"], "typescript": ["(?P<template>`)"]}
SCANS = {
    language: re.compile("|".join([*(f"(?:{p})" for p in opaque), *STOPS.get(language, []), r"(?P<open>[({\[])", r"(?P<close>[)}\]])", r"(?P<line>\n)"]), re.S | re.M)
    for language, opaque in OPAQUE.items()
}
ATTACHED = re.compile(r"[ \t]*(?://|/\*|@|#\[)")
#: Characters of a line, and those after it, in which a definition's beginning is looked for.
REACH = 500


@dataclass
class Places:
    """definitions: starts of those of the file; members: of statements one bracket deep; lines: of all lines outside strings and comments."""

    definitions: list[int]
    members: list[int]
    lines: list[int]


def _nested_end(text: str, at: int) -> int:
    """The end of a comment in which comments nest, from behind its first mark."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


TEMPLATE, EXPRESSION = re.compile(r"\\.|`|\$\{", re.S), re.compile(r"""`|[{}]|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)


def _template_end(text: str, at: int) -> int:
    """The end of a template literal, from behind its first mark; expressions in it can hold templates again."""
    inside: list[int] = [0]  # of each open template the braces open in its expression, 0 in its text
    while inside:
        m = (EXPRESSION if inside[-1] else TEMPLATE).search(text, at)
        if not m:
            return len(text)
        at, found = m.end(), m.group()
        if inside[-1]:
            if found == "`":
                inside.append(0)
            elif found in "{}":
                inside[-1] += 1 if found == "{" else -1
        elif found == "`":
            inside.pop()
        elif found == "${":
            inside[-1] = 1
    return at


def places(text: str, language: str, definition: str) -> Places:
    """definition: the pattern of a definition's beginning. Brackets that close nothing are read over."""
    scan, at, depth, starts = SCANS[language], 0, 0, [(0, 0)]
    while m := scan.search(text, at):
        at = max(m.end(), at + 1) if m.end() == m.start() else m.end()
        if m.lastgroup == "open":
            depth += 1
        elif m.lastgroup == "close":
            depth = max(0, depth - 1)
        elif m.lastgroup == "line":
            starts.append((at, depth))
        elif m.lastgroup == "nested":
            at = _nested_end(text, at)
        elif m.lastgroup == "template":
            at = _template_end(text, at)
    begins, definitions, members = re.compile(definition, re.M), [], []
    for i, (p, d) in enumerate(starts):
        if d > 1 or not (d or begins.match(text, p, p + REACH)):
            continue
        if d == 1:
            before = text[max(0, p - REACH) : p].rstrip()
            if before[-1:] in {"{", "}", ";"} and text[p : p + REACH].strip()[:1] not in {"", "}", ")", "]"}:
                members.append(p)
            continue
        first = i
        while first and starts[first - 1][1] == 0 and ATTACHED.match(text, starts[first - 1][0]) and text[max(0, starts[first][0] - 2)] not in "};":
            first -= 1
        definitions.append(starts[first][0])
    return Places(sorted(set(definitions)), members, [p for p, _ in starts])
