"""Chunkers: text, Markdown and code cut into pieces of a bounded number of tokens.

Each splits at the largest unit that fits: blank lines, lines, sentences, words,
characters; Markdown first at headings and fences, code first at top-level definitions,
then at what is one level deeper (of Python by its syntax tree, of other languages by a
scan that knows strings, comments and brackets).
Chunks are trimmed, in order, don't overlap and hold all that isn't white space.
Offsets are bytes into the trimmed text.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.slices import cuts
from . import code_scan

MAX_TOKENS = 512
TEXT_LEVELS = [r"\n[ \t]*\n\s*", r"\n", r"(?<=[.!?])\s+", r"\s+"]
MARKDOWN_LEVELS = [r"(?m)^(?=#{1,6} )", r"(?m)^(?=```)", *TEXT_LEVELS]
#: How top-level definitions begin.
DEFINITION = {
    "python": r"(?:@|def |class |async def )",
    "rust": r"(?:pub |fn |impl |struct |enum |trait |mod |#\[)",
    "javascript": r"(?:export |function |class |const |let |var |async )",
    "typescript": r"(?:export |function |class |const |let |interface |type |async )",
    "java": r"(?:public |private |protected |class |interface |enum |@)",
    "c": r"(?:\w[\w\s*]*\([^;]*$|struct |enum |typedef |#define )",
    "cpp": r"(?:\w[\w\s*:<>&]*\([^;]*$|class |struct |namespace |template|enum )",
    "go": r"(?:func |type |var |const )",
}


TOKEN = re.compile(r"\w+|[^\w\s]")


def count_words(text: str) -> int:
    """The default size: words and single punctuation marks."""
    return len(TOKEN.findall(text))


def levels_for(kind: str, language: str | None, text: str | None = None) -> list:
    """Patterns, largest units first; for code the places of its definitions before them."""
    if kind == "markdown":
        return MARKDOWN_LEVELS
    if kind == "code" and language == "python" and text is not None:
        tree = python_levels(text)
        if tree is not None:
            return [*tree, r"\n[ \t]*\n", r"\n", r"\s+"]
    if kind == "code" and language in code_scan.SCANS and text is not None:
        found = code_scan.places(text, language, DEFINITION[language])
        return [*(At(p) for p in (found.definitions, found.members, found.lines)), r"\n[ \t]*\n", r"\n", r"\s+"]
    if kind == "code" and language in DEFINITION:
        return [rf"(?m)^(?={DEFINITION[language]})", r"\n[ \t]*\n", r"\n", r"\s+"]
    return TEXT_LEVELS


def python_levels(text: str) -> list[str] | None:
    """The levels of a Python file by its syntax tree: statements of the module, then of classes and functions within, each
    with its decorators. None for a text that isn't Python."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines: list[set[int]] = [set(), set()]
    for node in tree.body:
        lines[0].add(min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]))
        for inner in getattr(node, "body", []):
            if isinstance(inner, ast.stmt):
                lines[1].add(min([inner.lineno, *(d.lineno for d in getattr(inner, "decorator_list", []))]))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    at = [sorted(starts[n - 1] for n in level if n <= len(starts)) for level in lines]
    return [At(places) for places in at if places]


class At:
    """Cuts at given places: stands for a compiled pattern among the levels."""

    def __init__(self, places: list[int]):
        self.places = places

    def ends(self, a: int, b: int) -> list[int]:
        return self.places[bisect_right(self.places, a) : bisect_left(self.places, b)]


def token_starts(tokenizer) -> Callable[[str], list[int]]:
    """Where the tokens of a text begin, special tokens left out, of a tokenizer of the tokenizers library."""
    return lambda text: sorted(a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets)


def token_count(tokenizer) -> Callable[[str], int]:
    """Tokens without special tokens; 0 for a text that can't be encoded."""

    def size(text: str) -> int:
        try:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)
        except Exception:  # the library raises nothing more special
            return 0

    return size


def split_by_tokens(text: str, levels: list[str], most: int, tokenizer) -> list[tuple[int, int]]:
    """Spans of at most `most` tokens each, see sized_by_tokens."""
    return [(a, b) for a, b, _ in sized_by_tokens(text, levels, most, tokenizer)]


def sized_by_tokens(text: str, levels: list[str], most: int, tokenizer) -> list[tuple[int, int, int]]:
    """Spans of at most `most` tokens each, and how many tokens each is: a text is encoded twice, whole and by its spans. Tokens are counted by where they begin in the whole text, and spans that
    hold more on their own, as a cut can part a token, are split again by their own count."""
    size, out = token_count(tokenizer), []
    for a, b in split(text, levels, most, starts=token_starts(tokenizer)(text)):
        n = size(text[a:b])
        if n <= most:
            out.append((a, b, n))
        else:
            out += [(a + x, a + y, size(text[a + x : a + y])) for x, y in split(text[a:b], [level for level in levels if not isinstance(level, At)], most, size)]
    return out


def split(
    text: str, levels: list[str], most: int = MAX_TOKENS, size: Callable[[str], int] | None = None, starts: list[int] | None = None
) -> list[tuple[int, int]]:
    """Spans (start, end) in characters. Neighbouring units of a level are joined while they fit.

    Without a size function the units that begin in a span are counted, by their starts in the whole
    text: words by default, of which no cut falls inside one.
    """
    if starts is None:
        starts = [] if size else [m.start() for m in TOKEN.finditer(text)]

    def measure(a: int, b: int) -> int:
        return size(text[a:b].strip()) if size else bisect_left(starts, b) - bisect_left(starts, a)

    def units(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if level == len(levels):
            return [(i, i + 1) for i in range(a, b)]
        found = levels[level].ends(a, b) if isinstance(levels[level], At) else [m.end() for m in re.compile(levels[level]).finditer(text, a, b) if a < m.end() < b]
        cuts = sorted({a, b, *found})
        return list(zip(cuts, cuts[1:]))

    def trimmed(a: int, b: int) -> tuple[int, int]:
        piece = text[a:b]
        return a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())

    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0)]
    while work:
        a, b, level = work.pop()
        a, b = trimmed(a, b)
        if a >= b:
            continue
        if measure(a, b) <= most or b - a == 1:
            out.append((a, b))
            continue
        todo, run = [], None
        for x, y in units(a, b, level):
            if run and measure(run[0], y) <= most:
                run = (run[0], y)
                continue
            if run:
                todo.append((*run, level + 1))
            run = (x, y)
        todo.append((*run, level + 1))
        work += todo[::-1]
    return out


def chunks(docs: DataFrame, most: int = MAX_TOKENS, tokenizer_path: str | None = None) -> DataFrame:
    """id, chunk_index, text, start_byte, end_byte, token_count. docs: id, path (may be null), text; blank texts give none.

    Sizes are words and punctuation marks, or with tokenizer_path (a file of the tokenizers
    library that executors can read) its tokens without special ones: the same tokenizer
    as that of the embedder keeps chunks from being cut there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path) if tokenizer_path else None
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in cuts(whole.column(3))):
            rows: list[tuple] = []
            for i, (kind, language, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                levels, at, place = levels_for(kind, language, text), 0, 0
                spans = sized_by_tokens(text, levels, most, tokenizer) if tokenizer else [(a, b, count_words(text[a:b])) for a, b in split(text, levels, most)]
                for n, (a, b, size) in enumerate(spans):
                    place += len(text[at:a].encode())
                    end = place + len(text[a:b].encode())
                    rows.append((i, n, text[a:b], place, end, size))
                    at, place = b, end
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[0] = batch.column(0).take(arrays[0])
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "chunk_index", "text", "start_byte", "end_byte", "token_count"])

    kind = docs.schema["id"].dataType.simpleString()
    text = T.trimmed(F.col("text")).alias("text")
    typed = docs.filter(T.has_text(F.col("text"))).select("id", F.coalesce(T.file_type(F.col("path")), F.lit("text")).alias("kind"), T.code_language(F.col("path")).alias("language"), text)
    return typed.mapInArrow(run, f"id {kind}, chunk_index int, text string, start_byte long, end_byte long, token_count long")


@cache
def _tokenizer(path: str):
    """Read once a process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
