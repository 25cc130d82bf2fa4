"""Splitting source files and texts into retrieval-sized chunks, and extracting imports.

Folds over the lines of one document need the piece built so far, so they run inside Arrow-batched
Python; documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.config import LIMITS

_SHAPE = "doc_id string, piece int, symbol_name string, symbol_type string, start_line int, end_line int, content string"
Piece = tuple  # (name, type, first line, last line, content)


def tokens(text: str) -> int:
    """A quarter of the UTF-16 units, rounded up."""
    return -(-units(text) // 4)


def text_chunks(text: str, least: int = LIMITS.min_chunk_tokens, most: int = LIMITS.max_chunk_tokens) -> list[Piece]:
    """Paragraphs joined greedily. Empty text has no chunk, a blank one a single module chunk.

    A paragraph is held until the next one; both are joined by a blank line unless that passes ``most``.
    A joined piece of at least ``least`` tokens is emitted. A single long paragraph is never split, and
    a piece ends as many lines after its start as its text has.
    """
    if not text:
        return []
    lines, blocks, start = text.split("\n"), [], None
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            start = i if start is None else start
        elif start is not None:
            blocks.append((start, "\n".join(lines[start:i])))
            start = None
    if not blocks:
        return [(None, "module", 1, len(lines), text)]
    out: list[Piece] = []

    def emit(at: int, body: str) -> None:
        out.append((None, "other", at + 1, at + 1 + body.count("\n"), body))

    held: tuple[int, str] | None = None
    for at, body in blocks:
        if held is None:
            held = (at, body)
            continue
        joined = f"{held[1]}\n\n{body}"
        if tokens(joined) > most:
            emit(*held)
            held = (at, body)
        elif tokens(joined) >= least:
            emit(held[0], joined)
            held = None
        else:
            held = (held[0], joined)
    if held is not None:
        emit(*held)
    return out


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def split_lines(piece: Piece, most: int = LIMITS.max_chunk_tokens) -> list[Piece]:
    """Pieces of whole lines, each closed once it has ``most`` tokens; all keep the symbol."""
    name, kind, first, _, content = piece
    out, held, at, size = [], [], first, -1
    for i, line in enumerate(content.split("\n")):
        held.append(line)
        size += units(line) + 1
        if -(-size // 4) >= most:
            out.append((name, kind, at, first + i, "\n".join(held)))
            held, at, size = [], first + i + 1, -1
    if held:
        out.append((name, kind, at, at + len(held) - 1, "\n".join(held)))
    return out


def merge_small(pieces: list[Piece], least: int = LIMITS.min_chunk_tokens, most: int = LIMITS.max_chunk_tokens) -> list[Piece]:
    """Left fold: neighbours of one type are joined if either is small and the result is not too long."""
    out: list[Piece] = []
    for p in pieces:
        if out:
            q = out[-1]
            joined = f"{q[4]}\n{p[4]}"
            if q[1] == p[1] and (tokens(q[4]) < least or tokens(p[4]) < least) and tokens(joined) <= most:
                out[-1] = (q[0] if q[0] is not None else p[0], q[1], q[2], p[3], joined)
                continue
        out.append(p)
    return out


def _python_symbols(text: str) -> list[Piece] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = text.split("\n")

    def harvest(body) -> list[Piece]:
        out: list[Piece] = []
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                piece = (node.name, kind, first, node.end_lineno, "\n".join(lines[first - 1 : node.end_lineno]))
                if tokens(piece[4]) <= LIMITS.max_chunk_tokens:
                    out.append(piece)
                else:
                    out += harvest(node.body) or split_lines(piece)
            else:
                for part in ("body", "orelse", "finalbody"):
                    out += harvest(x for x in getattr(node, part, []) if isinstance(x, ast.stmt))
                for handler in getattr(node, "handlers", []):
                    out += harvest(handler.body)
        return out

    return harvest(tree.body)


_JS_HEAD = re.compile(
    r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<fn>(?:async\s+)?function\s*\*?)|(?P<cls>class|interface|enum))\s+(?P<name>[A-Za-z_$][\w$]*)",
    re.M,
)
_JS_METHOD = re.compile(r"^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<name>[A-Za-z_$#][\w$]*)\s*(?:<[^>{}]*>)?\([^;{}]*\)[^;{}=]*\{", re.M)
_JS_WORDS = frozenset("if for while switch catch return function with".split())


def _js_close(text: str, at: int) -> int:
    """Place after the brace that closes the first one from ``at`` on; strings and comments are skipped."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                return n
        elif text.startswith("/*", i):
            i = text.find("*/", i)
            if i < 0:
                return n
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        i += 1
    return n


def _js_symbols(text: str) -> list[Piece]:
    breaks = [m.start() for m in re.finditer("\n", text)]

    def make(name, kind, start, end) -> Piece:
        return (name, kind, bisect_left(breaks, start) + 1, bisect_left(breaks, end) + 1, text[start:end])

    out, past = [], 0
    for m in _JS_HEAD.finditer(text):
        if m.start() < past:
            continue
        brace = text.find("{", m.end())
        end = _js_close(text, brace) if brace >= 0 else len(text)
        past = end
        piece = make(m["name"], "class" if m["cls"] else "function", m.start(), end)
        if tokens(piece[4]) <= LIMITS.max_chunk_tokens:
            out.append(piece)
            continue
        inner, inside = [], m.end()
        for k in _JS_METHOD.finditer(text, brace + 1, end) if m["cls"] else ():
            if k.start() < inside or k["name"] in _JS_WORDS:
                continue
            inside = _js_close(text, k.end() - 1)
            method = make(k["name"], "method", k.start(), inside)
            inner += [method] if tokens(method[4]) <= LIMITS.max_chunk_tokens else split_lines(method)
        out += inner or split_lines(piece)
    return out


GRAMMARS = {"py": "python", "ts": "script", "tsx": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "mts": "script", "cts": "script"}


def grammar(path: str) -> str | None:
    return GRAMMARS.get(path.rsplit(".", 1)[-1].lower())


def source_chunks(path: str, text: str) -> list[Piece]:
    """Symbols of a source file; paragraphs where there is no grammar, it fails, or the file is too long."""
    if not text:
        return []
    kind = grammar(path)
    if kind is None or tokens(text) * 4 > LIMITS.parse_units:
        return text_chunks(text)
    found = _python_symbols(text) if kind == "python" else _js_symbols(text)
    if found is None:
        return text_chunks(text)
    if not found:
        return [(None, "module", 1, text.count("\n") + 1, text)]
    return merge_small(found)


def chunked(docs: DataFrame, split: Callable[[str, str], list[Piece]]) -> DataFrame:
    """(doc_id, piece, ...) by ``split(path, text)`` over (doc_id, path, text); null texts have no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, path, text in zip(pdf["doc_id"], pdf["path"], pdf["text"]):
                if text is not None:
                    out += [(doc, i, *p) for i, p in enumerate(split(path or "", text))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "symbol_name", "symbol_type", "start_line", "end_line", "content"])

    return docs.select("doc_id", "path", "text").mapInPandas(run, _SHAPE)


def chunk_texts(docs: DataFrame) -> DataFrame:
    return chunked(docs, lambda _, text: text_chunks(text))


def chunk_sources(docs: DataFrame) -> DataFrame:
    return chunked(docs, source_chunks)


_FROM = re.compile(r"""(?:\bimport\s*\(\s*|\b(?:import|export)\b[^;'"`(){}]*?(?:\{[^}]*\}[^;'"`(){}]*?)?\bfrom\s*|\bimport\s*)(["'`])((?:(?!\1)[^\n\\])*)\1""")


def _blank_comments(text: str) -> str:
    return re.sub(r"/\*.*?\*/|(?<![:'\"`])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)


def imports_of(path: str, text: str) -> list[tuple[str, int]]:
    """(specifier, line) of a source file's imports; none without a grammar or where parsing fails."""
    kind = grammar(path)
    if kind == "script":
        plain = _blank_comments(text)
        return [(m.group(2), plain.count("\n", 0, m.start()) + 1) for m in _FROM.finditer(plain) if m.group(2)]
    if kind != "python":
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            out.append(("." * node.level + (node.module or ""), node.lineno))
    return [x for x in out if x[0]]


def extract_imports(docs: DataFrame) -> DataFrame:
    """(doc_id, path, specifier, line) over (doc_id, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, path, text in zip(pdf["doc_id"], pdf["path"], pdf["text"]):
                if path and text:
                    out += [(doc, path, s, line) for s, line in imports_of(path, text)]
            yield pd.DataFrame(out, columns=["doc_id", "path", "specifier", "line"])

    return docs.select("doc_id", "path", "text").mapInPandas(run, "doc_id string, path string, specifier string, line int")


def estimated(df: DataFrame, text: str = "content") -> DataFrame:
    from corvine.functions.scalars import token_estimate

    return df.withColumn("tokens", token_estimate(F.col(text)))
