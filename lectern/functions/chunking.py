"""Chunkers: built-in expressions where they suffice, Arrow UDFs for greedy folds.

Overlaps that are not smaller than the size count as 0 and sizes below 1 as 1, so
every chunker ends. A text that fits keeps its white space; windows are joined by
single blanks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import trim, words

HEADING = re.compile(r"(?m)^(#{1,6})\s+(.+)$")
CHUNK = "array<struct<text string, title string, metadata string, chunk_index int>>"


def guard(size: int, overlap: int) -> tuple[int, int]:
    size = max(1, size)
    return size, overlap if 0 <= overlap < size else 0


def windows(text: Column, size: int | Column, overlap: int | Column) -> Column:
    """Array of word windows of a text; none for a blank text. The size may differ from row to row, then it must
    be above 0 and the overlap below it."""
    if isinstance(size, int):
        size, overlap = guard(size, overlap)
    step = size - overlap

    def split(w: Column) -> Column:
        last = F.greatest(F.ceil((F.size(w) - overlap) / step).cast("int") - 1, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size if isinstance(size, Column) else F.lit(size)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) <= size, F.array(text)).otherwise(cut)

    return F.transform(F.array(words(text)), split)[0]


def plain_chunks(text: Column, size: int, overlap: int) -> Column:
    """As windows of the trimmed text; a blank text is one empty chunk."""
    body = trim(F.coalesce(text, F.lit("")))
    return F.when(body == "", F.array(F.lit(""))).otherwise(windows(body, size, overlap))


def code_header(path: Column, start: Column, end: Column, language: Column, kind: Column, symbol_path: Column, name: Column) -> Column:
    """``[path:start-end] [lang] [type: path > name]``; anonymous names give way to the path alone."""
    named = F.when(name.startswith("("), F.coalesce(F.nullif(symbol_path, F.lit("")), name)).when(F.coalesce(symbol_path, F.lit("")) != "", F.concat(symbol_path, F.lit(" > "), name)).otherwise(name)
    return F.concat(F.lit("["), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("] ["), language, F.lit("] ["), kind, F.lit(": "), named, F.lit("]"))


def commit_header(repo: Column, path: Column, sha: Column, date: Column) -> Column:
    return F.concat(F.lit("["), repo, F.lit("/"), path, F.lit("] [commit: "), F.substring(sha, 1, 7), F.lit("] ["), F.substring(date, 1, 10), F.lit("]"))


def commit_chunks(header: Column, subject: Column, diff: Column, size: int, overlap: int) -> Column:
    """Subject and diff under the header; over the size less the words of the header, windows of as many words,
    50 at least."""
    body = F.concat(subject, F.lit("\n\n"), diff)
    left = F.lit(max(1, size)) - F.size(words(header))
    room = F.greatest(F.lit(50), left)
    lap = F.when(F.lit(max(0, overlap)) < room, F.lit(max(0, overlap))).otherwise(F.lit(0))
    cut = F.when(F.size(words(body)) <= left, F.array(body)).otherwise(windows(body, room, lap))
    return F.transform(cut, lambda x: F.concat(header, F.lit("\n"), x))


def py_windows(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = guard(size, overlap)
    w = text.split()
    if not w:
        return []
    if len(w) <= size:
        return [text]
    out, i = [], 0
    while True:
        out.append(" ".join(w[i : i + size]))
        if i + size >= len(w):
            return out
        i += size - overlap


def markdown_sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, body) of every section, the part before the first heading without path."""
    out, stack, at, path = [], [], 0, []
    for m in HEADING.finditer(text):
        out.append((path, text[at : m.start()].strip()))
        level = len(m.group(1))
        stack = [h for h in stack if h[0] < level] + [(level, m.group(2).strip())]
        path, at = [h[1] for h in stack], m.end()
    out.append((path, text[at:].strip()))
    return [(p, b) for p, b in out if b]


def chunk_markdown(text: str, title: str, size: int, overlap: int) -> list[dict]:
    import json

    text = text or ""
    if not text.strip():
        return [{"text": "", "title": title, "metadata": "", "chunk_index": 0}]
    sections = markdown_sections(text)
    if not sections:
        return [{"text": text.strip(), "title": title, "metadata": "", "chunk_index": 0}]
    out: list[dict] = []
    for path, body in sections:
        shown = " > ".join(path)
        prefix = f"[{shown}] " if shown else ""
        room = size - len(prefix.split())
        parts = [body] if len(body.split()) <= room else py_windows(body, room, overlap)
        for p in parts:
            out.append({"text": prefix + p, "title": title, "metadata": json.dumps({"heading_path": shown}, ensure_ascii=False) if shown else "", "chunk_index": len(out)})
    return out


def chunk_email(subject: str, body: str, size: int, overlap: int) -> list[dict]:
    subject, body = (subject or "").strip(), (body or "").strip()
    title = subject or "(no subject)"
    if not body:
        texts = [f"Subject: {subject}" if subject else ""]
    elif len(body.split()) <= size:
        texts = [body]
    else:
        texts, held, n = [], [], 0
        for p in (q.strip() for q in re.split(r"\n\s*\n", body)):
            if not p:
                continue
            w = len(p.split())
            if held and n + w > size:
                texts.append("\n\n".join(held))
                held, n = [], 0
            if w > size:
                texts += py_windows(p, size, overlap)
            else:
                held.append(p)
                n += w
        if held:
            texts.append("\n\n".join(held))
    return [{"text": t, "title": title, "metadata": "", "chunk_index": i} for i, t in enumerate(texts)]


def markdown_chunks(size: int, overlap: int):
    """Arrow UDF (text, title) to chunks."""

    @F.pandas_udf(CHUNK)
    def run(text: pd.Series, title: pd.Series) -> pd.Series:
        return pd.Series([chunk_markdown(t or "", n or "", size, overlap) for t, n in zip(text, title)])

    return run


def email_chunks(size: int, overlap: int):
    """Arrow UDF (subject, body) to chunks; feeds use it too."""

    @F.pandas_udf(CHUNK)
    def run(subject: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([chunk_email(s, b, size, overlap) for s, b in zip(subject, body)])

    return run


def part_chunks(parts: list[tuple[str, str, dict]], title: str, size: int, overlap: int) -> list[dict]:
    """Pages, chapters and a description, each (kind, text, metadata), under one running index."""
    import json

    out: list[dict] = []
    for kind, text, meta in parts:
        for p in py_windows(text.strip(), size, overlap) if text.strip() else []:
            out.append({"text": p, "title": f"{title} ({kind})", "metadata": json.dumps(meta, ensure_ascii=False), "chunk_index": len(out)})
    return out
