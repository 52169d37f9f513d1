"""Splitting code at definitions: the Python grammar exactly, other languages by headers and braces.

Definitions that fit the budget are blocks; larger ones are split into their members;
small trivia between definitions are merged up to the budget. Blocks are exact spans
of lines. Languages without a scanner, and sources that don't parse, give windows.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions.chunking import guard, py_windows

# The heads of definitions per language family (kind by keyword).
HEADS = {
    "go": re.compile(r"^(?:(func)\s+(?:\([^)]*\)\s*)?(\w+)|(type)\s+(\w+))", re.M),
    "hcl": re.compile(r'^(\w+)\s+((?:"[^"]*"\s*|\w+\s*)*)\{', re.M),
    "javascript": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|enum|type)\*?\s+(\w+)|^(?:export\s+)?(const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", re.M),
    "rust": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|impl|mod)\s+(?:<[^>]*>\s*)?(\w+)", re.M),
    "java": re.compile(r"^(?:[\w@]+\s+)*(class|interface|enum|record)\s+(\w+)", re.M),
    "c": re.compile(r"^(?:[\w*&:<>,]+\s+)+\**(\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{|^(struct|enum|class|union)\s+(\w+)", re.M),
    "ruby": re.compile(r"^(def|class|module)\s+([\w.:?!]+)", re.M),
    "bash": re.compile(r"^(?:function\s+(\w[\w-]*)|(\w[\w-]*)\s*\(\))\s*(?:\(\))?\s*\{", re.M),
}
MEMBERS = {
    "javascript": re.compile(r"\s*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?([\w$#]+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::[^{};=]+)?\{"),
    "java": re.compile(r"\s*(?:[\w@<>\[\],.?]+\s+)*(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+|where\s[^{;]+|:\s*\w+\([^{;]*\)\s*)?(?:\{|=>)"),
    "rust": re.compile(r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default)\s+)*fn\s+(\w+)"),
    "c": re.compile(r"\s*(?:[\w*&:<>,~]+\s+)*[*&]*(~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?\{"),
    "ruby": re.compile(r"\s+def\s+([\w.:?!]+)"),
}
NO_MEMBERS = frozenset("if for while switch catch return else do try synchronized using lock foreach match loop new unless until".split())
FAMILY = {"typescript": "javascript", "tsx": "javascript", "cpp": "c", "csharp": "java"}
KINDS = {"func": "function", "fn": "function", "def": "function", "mod": "module", "record": "class", "union": "struct", "const": "function", "let": "function", "var": "function"}
CONTAINERS = frozenset(("class", "interface", "impl", "trait", "module", "struct", "enum"))
BLOCK = "array<struct<text string, symbol string, symbol_type string, symbol_path string, start_line int, end_line int>>"


@dataclass(frozen=True)
class Block:
    text: str
    symbol: str
    symbol_type: str
    symbol_path: str
    start_line: int
    end_line: int


def _count(text: str) -> int:
    return len(text.split())


def _window_blocks(lines: list[str], a: int, b: int, symbol: str, kind: str, path: str, size: int, overlap: int) -> list[Block]:
    text = "\n".join(lines[a - 1 : b])
    return [Block(w, symbol, kind, path, a, b) for w in py_windows(text, size, overlap)]


def plain_blocks(text: str, size: int, overlap: int) -> list[Block]:
    n = text.count("\n") + 1
    return [Block(w, "(file)", "file", "", 1, n) for w in py_windows(text, size, overlap)] if text.strip() else [Block(text, "(file)", "file", "", 1, n)]


def _split(lines, spans, a, b, path, size, overlap) -> list[Block]:
    """Blocks of lines a..b, of which ``spans`` (start, end, name, kind, members) are definitions."""
    out: list[Block] = []
    held: list[tuple[int, int]] = []

    def flush():
        if held:
            text = "\n".join(lines[held[0][0] - 1 : held[-1][1]])
            if text.strip():
                out.append(Block(text, "(module)", "module_top", path, held[0][0], held[-1][1]))
            held.clear()

    def trivia(x, y):
        while x <= y and not lines[x - 1].strip():
            x += 1
        while y >= x and not lines[y - 1].strip():
            y -= 1
        if x > y:
            return
        n = _count("\n".join(lines[x - 1 : y]))
        if n > size:
            flush()
            out.extend(_window_blocks(lines, x, y, "(module)", "module_top", path, size, overlap))
            return
        if held and sum(_count("\n".join(lines[p - 1 : q])) for p, q in held) + n > size:
            flush()
        held.append((x, y))

    at = a
    for s, e, name, kind, members in spans:
        trivia(at, s - 1)
        flush()
        if _count("\n".join(lines[s - 1 : e])) <= size:
            out.append(Block("\n".join(lines[s - 1 : e]), name, kind, path, s, e))
        elif members:
            inner = f"{path} > {name}" if path else name
            out.extend(_split(lines, members, s, e, inner, size, overlap))
        else:
            out.extend(_window_blocks(lines, s, e, name, kind, path, size, overlap))
        at = e + 1
    trivia(at, b)
    flush()
    return out


def _python_spans(body) -> list[tuple]:
    out = []
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((start, node.end_lineno, node.name, kind, _python_spans(node.body)))
    return out


def _brace_end(lines: list[str], start: int) -> int:
    depth, seen = 0, False
    for i in range(start - 1, len(lines)):
        bare = _bare(lines[i])
        depth += bare.count("{") - bare.count("}")
        seen = seen or "{" in bare
        if seen and depth <= 0:
            return i + 1
        if not seen and bare.rstrip().endswith(";"):
            return i + 1
    return len(lines)


def _members(lines: list[str], start: int, end: int, family: str) -> list[tuple]:
    """The functions one level below a definition; their heads may go over some lines."""
    out: list[tuple] = []
    if family not in MEMBERS:
        return out
    depth, i = 0, start
    while i <= end:
        inside = depth == 1 if family != "ruby" else start < i
        m = MEMBERS[family].match("\n".join(lines[i - 1 : i + 5])) if inside and lines[i - 1].strip() else None
        if m and m.group(1) not in NO_MEMBERS and not re.match(r"\s*(?:return|throw|new|await|yield)\b", lines[i - 1]):
            last = min(_ruby_end(lines, i) if family == "ruby" else _brace_end(lines, i), end)
            out.append((i, last, m.group(1), "function", []))
            i = last + 1
            continue
        bare = _bare(lines[i - 1])
        depth += bare.count("{") - bare.count("}")
        i += 1
    return out


def _bare(line: str) -> str:
    """The line without strings and comments."""
    return re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*|#.*", "", line)


def _ruby_end(lines: list[str], start: int) -> int:
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    return next((i + 1 for i in range(start, len(lines)) if lines[i].rstrip() == " " * indent + "end"), len(lines))


def _scanned_spans(text: str, lines: list[str], family: str) -> list[tuple]:
    out, last = [], 0
    for m in HEADS[family].finditer(text):
        start = text.count("\n", 0, m.start()) + 1
        if start <= last:
            continue
        got = [g for g in m.groups() if g]
        if family == "hcl":
            name, kind = " ".join([m.group(1), *re.findall(r'[\w.-]+', m.group(2) or "")]), "block"
        elif family == "bash" or (family == "c" and len(got) == 1):
            name, kind = got[0], "function"
        else:
            kind, name = KINDS.get(got[0], got[0]), got[-1]
        end = _ruby_end(lines, start) if family == "ruby" else _brace_end(lines, start)
        out.append((start, end, name, kind, _members(lines, start, end, family) if kind in CONTAINERS else []))
        last = end
    return out


def code_blocks(text: str, language: str, size: int = 500, overlap: int = 50) -> list[Block]:
    size, overlap = guard(size, overlap)
    lines = text.split("\n")
    family = FAMILY.get(language, language)
    spans: list[tuple] = []
    if language == "python":
        try:
            spans = _python_spans(ast.parse(text).body)
        except (SyntaxError, ValueError, RecursionError):
            spans = []
        structural = bool(text.strip())
    else:
        structural = family in HEADS
        spans = _scanned_spans(text, lines, family) if structural else []
    blocks = _split(lines, spans, 1, len(lines), "", size, overlap) if structural else []
    return [replace(b, text=b.text.rstrip("\n")) for b in blocks] or plain_blocks(text, size, overlap)


def code_blocks_udf(size: int = 500, overlap: int = 50):
    @F.pandas_udf(BLOCK)
    def run(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([[(b.text, b.symbol, b.symbol_type, b.symbol_path, b.start_line, b.end_line) for b in code_blocks(t or "", g or "", size, overlap)] for t, g in zip(text, language)])

    return run
