"""Repairing text from scanned pages: furniture, broken words, misread characters.

Furniture is found per book: keys of first and last lines are counted over all its
pages; opening lines of chapters give further keys. Then every page is read into its
words once, and all the rest works on that table. Words are counted over all pages;
words whose characters could be misread for one another share a key, and a word is
linked to the dominant words of its keys. Skip-gram vectors decide: for every single
occurrence of a linked word the words around it are compared with those around each
candidate and around the word elsewhere, and this, how often they occur and whether a
word can be spelled so make a score. A break sign at a line's end is a fault unless the
corpus writes the word with it.

The vectors are signed random projections of the skip-gram counts, with frequent
contexts subsampled, summed over the whole corpus in one pass instead of gradient steps.

Defined cases: null and blank pages have no line; rows without page or book are left out, a missing page number has no continuation; nulls in ``ocr`` and wrong values
don't matter, it is not consulted; repeated page numbers of a book are taken as
they come, the least page_id giving the continuation; a book of any length is
spread over tasks; every recurring key of it counts, and all of them are also
matched where a head is misread, by a join on pieces of the keys.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

DIM = 64
WINDOW = 3
SAMPLE = 1e-3  # contexts above this share of all words weigh less
SKETCH = 1 << 18  # counters of the word counts that weigh contexts; collisions only lower a weight
BLOOM = 1 << 22  # bits of the filter in front of the join with linked words; collisions only cost time
RATIO = 4  # a candidate occurs so many times as often as the word
SHARE = 8  # a dominant word has an eighth of the occurrences of its key, so a key has eight at most
CONTEXT, SHAPED, SHORT, ENOUGH = 10.0, 3.0, 1.3, 4.6  # what context, impossible shape and shortness add to log2 of the odds, and what is enough
SORTED = "merge"  # both sides of every join grow; a side that is small as Parquet, or before it is exploded, may not be sent to the driver
PAGES_AT_ONCE, WORDS_SUMMED = 1000, 20_000  # what a worker holds of pages, and of sums of contexts, at a time
NOISE = -0.05  # one window's projection errs by about 0.12, so its disagreement counts no more

# Kinds of words of a page.
WORD, SPELLED, BROKEN, HALF, BESIDES = range(5)  # as it stands, the hyphenated whole (counted only), a broken word (not counted), half of one (not counted), context only

# Characters that scanners take for one another, misread to true.
CLASSES = ("ec", "nu", "tfſ", "hb", "li1!I|", "o0", "a@", "s5", "vy", "gq", "B8")
PAIRS = (("cl", "d"), ("rn", "m"), ("vv", "w"), ("ii", "ü"))
VARIANTS = (("6", "b"), ("6", "é"), ("6", "ó"), ("6", "e"), ("5", "ä"), ("5", "S"), ("8", "B"), ("h", "li"), ("n", "ri"), ("b", "li"))
BREAKS = "-¬‐­‑"
SURE_BREAKS = "¬‐­"
ODD = re.compile(r"[0-9@!|]")
SHAPE = r"^\p{L}*\p{Ll}[0-9@!|I]\p{L}*$|^[0-9@!|]\p{Ll}{2,}$|^\p{L}+[@!|]\p{L}+$"  # no word is spelled so

IMPOSSIBLE = regex.compile(SHAPE)
SAME = str.maketrans({c: group[0] for group in CLASSES for c in group})
PAGE = r"(?:(?:page|seite|página|pagina|p|pp|s|pág|pag|folio|fol)\.?\s*)?"
PLAIN = str.maketrans("1!|I0@5ſ", "llllo" + "asf")
NUMBER = re.compile(r"(?i)^\W*" + PAGE + r"(?:[ivxlcdm1]{1,7}|[\dol!s]{1,4})\W*$")
OPENER = re.compile(r"^\s*(?:[^\W\d_]{4,10}\.?\s+)?(?:[\dlIO]{1,3}|[IVXLC]{1,6})\.?\s*$")
BESIDE = re.compile(r"^\s*(?:[\divxlcIVXLCoOS!5]{1,6}\s{2,}(\S.*?)|(\S.*?)\s{3,}[\divxlcIVXLCoOS!5]{1,6})\s*$")
SPACED = re.compile(r"^\s*(?:\S\s){3,}\s*\S(?:\s+\S)*\s*$")
PARTS = re.compile(r"[-'’]")
EDGE = ".,;:?()«»\"„“”‘…[]—–*"


FOLDED_PAIRS = tuple((a.translate(SAME), b.translate(SAME)) for a, b in PAIRS)


def canon(word: str) -> str:
    """Key that a word shares with what a scanner could make of it: single characters first, so that a pair one
    of whose characters is misread too is still a pair."""
    s = word.translate(PLAIN).translate(SAME).lower().translate(SAME)
    for a, b in FOLDED_PAIRS:
        s = s.replace(a, b)
    return s


def canon_variants(word: str) -> set[str]:
    """Keys of what else the word may be a misreading of."""
    got = set()
    for a, b in VARIANTS:
        at = word.find(a)
        while at >= 0:
            got.add(canon(word[:at] + b + word[at + 1 :]))
            at = word.find(a, at + 1)
    got.discard(canon(word))
    return got


def head_key(line: str) -> str:
    m = BESIDE.match(line)
    text = (m.group(1) or m.group(2)) if m else line
    return re.sub(r"[\W_]+", "", canon(re.sub(r"\s+", "", text).lower()))


def _running(line: str) -> bool:
    """Whether the line could be a head or foot: short, and not the end of a sentence or a broken word."""
    s = line.rstrip()
    return len(line) < 70 and s[-1:] not in ".,;:!?" + BREAKS


def _filled(lines: list[str]) -> list[int]:
    return [i for i, x in enumerate(lines) if x.strip()]


def opening(lines: list[str], rows: list[int]) -> int:
    """How many of the first lines open a chapter: its number and title, with a blank line behind."""
    if len(rows) >= 3 and OPENER.match(lines[rows[0]]) and not lines[rows[1]].rstrip().endswith((".", ",", ";")) and rows[1] == rows[0] + 1 and rows[2] > rows[1] + 1:
        return 2
    return 0


def page_keys(text: str) -> list[tuple[str, int]]:
    """Keys of the lines at the page's edges; weight 2 for a chapter's title."""
    lines = text.split("\n")
    rows = _filled(lines)
    if not rows:
        return []
    out = []
    opens = opening(lines, rows)
    if opens:
        out.append((head_key(lines[rows[1]]), 2))
    elif _running(lines[rows[0]]):
        out.append((head_key(lines[rows[0]]), 1))
    for i in rows[-2:]:
        if i > rows[0] and _running(lines[i]):
            out.append((head_key(lines[i]), 1))
    return [(k, n) for k, n in out if len(k) > 3]


def _alike(a: str, b: str) -> bool:
    """At most one in five characters apart, for keys of nearly one length."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 6:
        return False
    most = max(len(a), len(b)) // 5
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _pieces(size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a key of that size: one more than the most edits ``_alike`` allows it."""
    count = (size + 2) // 5 + 1
    ends = [size * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def key_pieces(key: str) -> list[str]:
    """What a key is looked up by: fewer edits than pieces leave one of them whole."""
    if len(key) < 6:
        return []
    return [f"{len(key)} {k} {key[a : a + n]}" for k, (a, n) in enumerate(_pieces(len(key)))]


def key_probes(key: str) -> list[str]:
    """The pieces of every key that is ``_alike``: left of a whole piece lie as many edits as it is shifted by
    at least, right of it as many as are left of the difference in length."""
    out: set[str] = set()
    for size in range(max(6, len(key) - 2), len(key) + 3) if len(key) >= 6 else ():
        most, longer = max(size, len(key)) // 5, len(key) - size
        for k, (a, n) in enumerate(_pieces(size)):
            for shift in range(-most, most + 1):
                if abs(shift) + abs(longer - shift) <= most and 0 <= a + shift <= len(key) - n:
                    out.add(f"{size} {k} {key[a + shift : a + shift + n]}")
    return sorted(out)


class _Asked(set):
    """Takes down the keys that are looked up in it, and has none of them."""

    def __contains__(self, key) -> bool:
        self.add(key)
        return False


def asked_keys(text: str) -> set[str]:
    """Keys of the lines for which it matters whether their key recurs; at most one at each edge."""
    asked = _Asked()
    furniture(text, asked)
    return {k for k in asked if len(k) > 3}


def furniture(text: str, keys: Collection[str]) -> list[int]:
    """Lines of the page that are running heads, feet or page numbers; ``keys``: those known to recur, also misread."""
    lines = text.split("\n")
    rows = _filled(lines)
    if not rows:
        return []
    known = lambda line: _running(line) and head_key(line) in keys
    out: list[int] = []
    top = rows[0]
    if not opening(lines, rows):
        for i in rows[:2]:
            line = lines[i]
            letters = [c for c in line if c.isalpha()]
            loud = len(letters) >= 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and len(line) < 70
            if NUMBER.match(line) or BESIDE.match(line) or SPACED.match(line) or loud or known(line):
                out.append(i)
                if not NUMBER.match(line):
                    break
            else:
                break
    for n, i in enumerate(reversed(rows)):
        if i == top or n > 1:
            break
        line = lines[i]
        if NUMBER.match(line) and n == 0:
            out.append(i)
        elif (BESIDE.match(line) and not line.startswith(" ")) or known(line):
            out.append(i)
            break
        else:
            break
    return sorted(set(out))


def _clean(token: str) -> str:
    return token.strip(EDGE)


def break_sign(line: str) -> str | None:
    """The break sign that ends the line inside a word, if any."""
    s = line.rstrip()
    if len(s) > 1 and s[-1] in BREAKS and s[-2].isalnum():
        return s[-1]
    return None


def words_of(token: str) -> list[str]:
    """Word parts of a token, at hyphens and apostrophes; plain numbers and links are none."""
    t = _clean(token)
    if not t or "/" in t or t.replace("-", "").replace("–", "").replace(".", "").replace(",", "").isdigit():
        return []
    if t.endswith("!") and not ODD.search(t[:-1]):
        t = t[:-1]
    return [p for p in PARTS.split(t) if sum(c.isalpha() for c in p) >= 1 and len(p) > 1]


PAGE = "page_id long, source_id long, page_number int, furniture array<int>, first_token string, open_line int, open_token string, open_before array<string>, words array<string>, lines array<int>, kinds array<int>, cuts array<int>, nexts array<int>, breaks array<struct<line_no: int, sign: string, joined: string, hyphened: string, lower: boolean>>"
PAGE_COLUMNS = [x.split()[0] for x in re.sub(r"<.*?>+", "", PAGE).split(", ")]


def _clean_tail(token: str) -> str:
    return token.rstrip(EDGE + "!")


def _broken(token: str, after: str, line: int, then: int) -> tuple[list[tuple], dict | None] | None:
    """Words and break of a token that goes on with ``after``, in the line ``then``, -1 on another page; None where it doesn't."""
    if not after or not (after[0].isalnum() or after[0] in "@!"):
        return None
    sign, a, b = token[-1], token[:-1].lstrip(EDGE), after
    head, tail = words_of(a), words_of(_clean_tail(b))
    lead, rest = PARTS.split(a)[-1].lstrip(EDGE), PARTS.split(_clean_tail(b))[0]
    out = [(w, line, BROKEN, len(lead), then) for w in words_of(lead + rest)] if lead and rest else []
    # what may be spelled with a hyphen counts as its halves too
    halves = sign == "-" and min(len(lead), len(rest)) >= 3
    out += [(w, line, HALF, 0, -1) for w in (head if halves else head[:-1])]
    if then >= 0:
        out += [(w, then, HALF, 0, -1) for w in (tail if halves else tail[1:])]
    a, b = re.split(r"['’]", a)[-1], re.split(r"['’]", _clean_tail(b))[0]
    if a[-1:].isdigit() and b[:1].isdigit():
        return out, None
    return out, {"line_no": line, "sign": sign, "joined": canon(a + b), "hyphened": canon(f"{a}-{b}"), "lower": b[:1].islower() or not b[:1].isupper()}


def _words(token: str, line: int, parts: dict[str, list[str]]) -> list[tuple]:
    got = parts.get(token)
    if got is None:
        got = parts[token] = words_of(token)
        if len(got) > 1 and "-" in token:
            parts[token] = got = [*got, None]
    if got and got[-1] is None:
        return [*((w, line, WORD, 0, -1) for w in got[:-1]), (_clean(token), line, SPELLED, 0, -1)]
    return [(w, line, WORD, 0, -1) for w in got]


def read_page(text: str, gone: Collection[int], parts: dict[str, list[str]] | None = None):
    """The page's words (word, line, kind, length of the first half, next line), its breaks, its first token, and
    (line, token, words before it) where the page ends inside a word. ``parts`` remembers the words of tokens."""
    parts = {} if parts is None else parts
    lines, skip = text.split("\n"), set(gone)
    body = [(i, line.split()) for i, line in enumerate(lines) if i not in skip and line.strip()]
    words: list[tuple] = []
    breaks: list[dict] = []
    last, carried = None, 0
    for k, (i, tokens) in enumerate(body):
        begin, end = carried, len(tokens)
        carried, broken = 0, None
        if break_sign(lines[i]) and end > begin:
            if k + 1 == len(body):
                last, end = (i, tokens[-1]), end - 1
            elif (broken := _broken(tokens[-1], body[k + 1][1][0], i, body[k + 1][0])) is not None:
                carried, end = 1, end - 1
        for t in tokens[begin:end]:
            words += _words(t, i, parts)
        if broken is not None:
            words += broken[0]
            breaks += [broken[1]] if broken[1] else []
    first = body[0][1][0] if body else None
    return words, breaks, first, (*last, [w for w, _, kind, _, _ in words[-2 * WINDOW :] if kind in (WORD, BROKEN)][-WINDOW:]) if last else None


def close_page(line: int, token: str, goes_on: str | None, parts: dict[str, list[str]]) -> tuple[list[tuple], list[dict]]:
    """Words and breaks of the last token of a page that ends with a break sign."""
    got = _broken(token, goes_on, line, -1) if goes_on else None
    if got is None:
        return _words(token, line, parts), []
    return got[0], [got[1]] if got[1] else []


def surroundings(batches: Iterator[pa.RecordBatch], weigh: np.ndarray, linked: np.ndarray, suspects: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of contexts of the linked words (word, v), and the context of each suspect (with its place and x)."""
    linked, suspects = np.unpackbits(linked).view(bool), np.unpackbits(suspects).view(bool)
    known: dict[str, int] = {}
    totals = np.zeros((0, DIM), "f4")

    def summed_up() -> pa.RecordBatch:
        return pa.record_batch([
            pa.array(list(known), pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(totals[: len(known)].ravel()), DIM).cast(pa.list_(pa.float32())),
            *(pa.nulls(len(known), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())),
        ], names=["word", "v", "page_id", "line_no", "cut", "next_line", "x"])

    for batch in (b.slice(k, PAGES_AT_ONCE) for b in batches for k in range(0, b.num_rows, PAGES_AT_ONCE)):
        column = batch.column("words")
        flat = column.flatten().dictionary_encode()
        if not len(flat):
            continue
        kinds, lines, cuts, nexts = (batch.column(c).flatten().to_numpy() for c in ("kinds", "lines", "cuts", "nexts"))
        page = np.repeat(batch.column("page_id").to_numpy(), column.value_lengths().to_numpy())
        spelled = flat.dictionary.to_pylist()
        lowered: dict[str, int] = {}
        fold = np.array([lowered.setdefault(w.lower(), len(lowered)) for w in spelled])
        crc = np.array([zlib.crc32(w.encode()) for w in lowered], np.int64)
        signs = np.unpackbits(np.array([xxhash.xxh3_64_intdigest(w) for w in lowered], np.uint64).view(np.uint8).reshape(-1, 8), axis=1).astype("f4") * 2 - 1
        signs *= weigh[crc % SKETCH][:, None]
        needed = linked[crc % BLOOM]
        suspect = suspects[np.array([zlib.crc32(w.encode()) for w in spelled], np.int64) % BLOOM]
        ids = flat.indices.to_numpy()
        inline = np.isin(kinds, (WORD, BROKEN, BESIDES))
        seq = np.flatnonzero(inline)
        code, at_page = fold[ids[seq]], page[seq]
        where = np.maximum(np.cumsum(inline) - 1, 0)  # a half takes the context of the word before it
        asked = np.flatnonzero(suspect[ids] & np.isin(kinds, (WORD, BROKEN, HALF)))
        summed = np.flatnonzero(needed[code] & (kinds[seq] == WORD))
        sums = np.zeros((len(lowered), DIM), "f4")
        for part in np.array_split(summed, len(summed) // 65536 + 1):
            if len(part):
                x = _around(part, code, at_page, signs)
                order = np.argsort(code[part], kind="stable")
                starts = np.flatnonzero(np.diff(code[part][order], prepend=-1))
                sums[code[part][order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        used = np.flatnonzero((sums != 0).any(1))
        names = list(lowered)
        at = np.array([known.setdefault(names[i], len(known)) for i in used], np.int64)
        if len(known) > len(totals):
            totals = np.concatenate([totals, np.zeros((2 * len(known) - len(totals), DIM), "f4")])
        totals[at] += sums[used]
        if len(known) > WORDS_SUMMED:
            yield summed_up()
            known, totals = {}, np.zeros((0, DIM), "f4")
        if len(asked):
            x = _around(where[asked], code, at_page, signs)
            yield pa.record_batch([
                pa.array([spelled[i] for i in ids[asked]], pa.string()), pa.nulls(len(asked), pa.list_(pa.float32())), pa.array(page[asked]), pa.array(lines[asked]), pa.array(cuts[asked]), pa.array(nexts[asked]),
                pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary()),
            ], names=["word", "v", "page_id", "line_no", "cut", "next_line", "x"])
    if known:
        yield summed_up()


def _around(at: np.ndarray, code: np.ndarray, page: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the signs of the words within the window around each position, of the same page."""
    x = np.zeros((len(at), DIM), "f4")
    for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
        other = np.clip(at + step, 0, len(code) - 1)
        x += signs[code[other]] * ((page[other] == page[at]) & (other == at + step))[:, None]
    return x


def slices(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The frames in pieces, so that lists made of a piece's texts stay small."""
    for frame in frames:
        for k in range(0, len(frame), rows):
            yield frame.iloc[k : k + rows]


def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best candidate of each occurrence, and whether it is misread; without candidate it is by its shape."""
    for frame in slices(frames, 5000):
        right, misread = [], []
        for word, n, x, own, candidates in frame[["word", "n", "x", "own_v", "candidates"]].itertuples(index=False):
            if candidates is None or not len(candidates):
                right.append(None)
                misread.append(True)
                continue
            x = np.frombuffer(x, "<f2").astype("f4")
            size = float(np.sqrt(x @ x))
            here, elsewhere = 0.0, None
            if own is not None and n > 1 and size:
                other = np.asarray(own["q"], "f4") * (own["size"] / 127) - x
                norm = float(np.sqrt(other @ other))
                if norm > 1e-3:
                    elsewhere = other / norm
                    here = max(float(elsewhere @ x) / size, 0.0)
            best = (-9.0, None)
            for c in candidates:
                there = against = 0.0
                if size and c["right_v"] is not None:
                    v = np.asarray(c["right_v"]["q"], "f4") / 127
                    there = max(float(v @ x) / size, NOISE)
                    # the word's own uses count against a candidate as far as they differ from the candidate's
                    against = here * (1 - max(float(v @ elsewhere), 0.0)) if here else 0.0
                best = max(best, (c["odds"] + CONTEXT * (there - against), c["right"]))
            right.append(best[1] if best[0] >= ENOUGH else None)
            misread.append(best[0] >= ENOUGH or bool(IMPOSSIBLE.match(word)))
        yield frame[["page_id", "line_no", "word", "cut", "next_line"]].assign(right=pd.Series(right, dtype="object", index=frame.index), misread=pd.Series(misread, dtype="bool", index=frame.index))


class Scans:
    def __init__(self, pages: DataFrame):
        self.spark = pages.sparkSession
        pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("source_id").cast("long").alias("source_id"), F.col("page_number").cast("int").alias("page_number"), "text").where(F.col("text").rlike(r"\S") & F.col("page_id").isNotNull() & F.col("source_id").isNotNull())
        self.texts = pages.select("page_id", "text")
        self.pages = self._read(pages, self._known_heads(pages))
        self._learn()

    def _known_heads(self, pages: DataFrame) -> DataFrame:
        """(page_id, known): keys of a page's edges that recur in its book, as they stand or misread."""

        def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = [(p, b, [{"key": k, "n": n} for k, n in page_keys(t)], sorted(asked_keys(t))) for p, b, t in frame[["page_id", "source_id", "text"]].itertuples(index=False)]
                yield pd.DataFrame(out, columns=["page_id", "source_id", "edges", "asked"])

        @F.pandas_udf("array<string>")
        def pieces(keys: pd.Series) -> pd.Series:
            return keys.map(key_pieces)

        @F.pandas_udf("array<string>")
        def probes(keys: pd.Series) -> pd.Series:
            return keys.map(key_probes)

        @F.pandas_udf("boolean")
        def alike(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([_alike(x, y) for x, y in zip(a, b)], dtype="bool")

        found = materialize(pages.select("page_id", "source_id", "text").mapInPandas(edges, "page_id long, source_id long, edges array<struct<key: string, n: int>>, asked array<string>"), "scan-edges")
        counts = found.select("source_id", F.explode("edges").alias("e")).groupBy("source_id", F.col("e.key").alias("key")).agg(F.sum("e.n").alias("n"))
        recurring = materialize(counts.where("n >= 2").select("source_id", "key"), "scan-heads")
        # a page's own keys are looked up among all keys of its book, those not found also for what they may be misread from
        asked = found.select("page_id", "source_id", F.explode("asked").alias("key"))
        odd = asked.select("source_id", "key").distinct().join(recurring.hint(SORTED), ["source_id", "key"], "left_anti")
        true = recurring.select("source_id", F.col("key").alias("true"), F.explode(probes("key")).alias("piece"))
        near = odd.select("source_id", "key", F.explode(pieces("key")).alias("piece")).join(true.hint(SORTED), ["source_id", "piece"]).select("source_id", "key", "true").distinct()
        near = near.where(alike("key", "true")).select("source_id", "key").distinct()
        return asked.join(recurring.unionByName(near).hint(SORTED), ["source_id", "key"], "left_semi").groupBy("page_id").agg(F.collect_set("key").alias("known"))

    def _read(self, pages: DataFrame, known: DataFrame) -> DataFrame:
        """Every page as its furniture, words and breaks, and as further rows the words broken at the ends of pages."""

        def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts: dict[str, list[str]] = {}
            for frame in slices(frames):
                rows = []
                for page_id, source_id, number, text, keys in frame[["page_id", "source_id", "page_number", "text", "known"]].itertuples(index=False):
                    gone = furniture(text, set(keys) if keys is not None else set())
                    words, breaks, first, last = read_page(text, gone, parts)
                    rows.append((page_id, source_id, None if pd.isna(number) else int(number), gone, first, *(last or (None, None, None)), *(list(x) for x in (zip(*words) if words else ((),) * 5)), breaks))
                if len(parts) > 500_000:
                    parts.clear()
                yield pd.DataFrame(rows, columns=PAGE_COLUMNS).astype({"page_number": "Int64", "open_line": "Int64"})

        def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for page_id, source_id, number, line, token, before, goes_on in frame[["page_id", "source_id", "page_number", "open_line", "open_token", "open_before", "goes_on"]].itertuples(index=False):
                    words, breaks = close_page(int(line), token, goes_on, {})
                    words = [(w, -1, BESIDES, 0, -1) for w in before] + words
                    rows.append((page_id, source_id, None if pd.isna(number) else int(number), [], None, None, None, None, *(list(x) for x in (zip(*words) if words else ((),) * 5)), breaks))
                yield pd.DataFrame(rows, columns=PAGE_COLUMNS).astype({"page_number": "Int64", "open_line": "Int64"})

        whole = materialize(pages.join(known.hint(SORTED), "page_id", "left").mapInPandas(read, PAGE), "scan-pages")
        following = whole.groupBy("source_id", (F.col("page_number") - 1).alias("page_number")).agg(F.min_by("first_token", "page_id").alias("goes_on"))
        ends = whole.where("open_token is not null").select("page_id", "source_id", "page_number", "open_line", "open_token", "open_before").join(following.hint(SORTED), ["source_id", "page_number"], "left").mapInPandas(close, PAGE)
        self.whole = whole
        return whole.unionByName(materialize(ends, "scan-page-ends"))

    def _learn(self) -> None:
        """Counts of words and keys, what words are linked to, and the misread occurrences with their corrections."""

        @F.pandas_udf("string")
        def key_of(words: pd.Series) -> pd.Series:
            return words.map(canon)

        @F.pandas_udf("array<string>")
        def other_keys(words: pd.Series) -> pd.Series:
            return words.map(lambda w: sorted({canon(w), *canon_variants(w)}))

        each = self.pages.select(F.explode(F.arrays_zip("words", "kinds")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.kinds").alias("kind")).where(F.col("kind") < HALF)
        counted = each.groupBy("word").agg(F.sum((F.col("kind") <= SPELLED).cast("long")).alias("n"))
        self.words = materialize(counted.withColumn("key", key_of("word")), "scan-words")
        self.keys = self.words.groupBy("key").agg(F.sum("n").alias("n"))
        # forms of one word in upper and lower case count together; the most frequent one stands for it
        forms = self.words.where("n > 0").groupBy("key", F.lower("word").alias("folded")).agg(F.max_by("word", F.struct("n", "word")).alias("right"), F.sum("n").alias("right_n"))
        lead = forms.join(self.keys.withColumnRenamed("n", "key_n").hint(SORTED), "key").where((F.col("right_n") >= 3) & (F.col("right_n") * SHARE >= F.col("key_n"))).select("key", "folded", "right", "right_n")
        rare = self.words.select("word", "n", F.col("word").rlike(SHAPE).alias("shaped"), F.explode(other_keys("word")).alias("key"))
        linked = rare.join(lead.hint(SORTED), "key").where(((F.lower("word") != F.col("folded")) | F.col("word").rlike("[a-zà-ÿ][A-Z]")) & (F.col("word") != F.col("right")) & (F.col("right_n") >= RATIO * F.col("n")))
        odds = F.log2(F.col("right_n") / F.greatest("n", F.lit(1))) + F.when(F.col("shaped"), SHAPED).otherwise(0.0) - F.when(F.length("word") <= 3, SHORT).otherwise(0.0)
        linked = linked.withColumn("odds", odds).groupBy("word", "right").agg(F.max("folded").alias("folded"), F.max("n").alias("n"), F.max("odds").alias("odds"))
        shaped = self.words.where(F.col("word").rlike(SHAPE)).select("word")
        self.linked = materialize(linked, "scan-linked")
        suspects = materialize(self.linked.select("word").unionByName(shaped).distinct(), "scan-suspects")
        self._contexts(suspects)
        vectors = self.vectors
        right = self.linked.join(vectors.select(F.col("word").alias("folded"), F.col("v").alias("right_v")).hint(SORTED), "folded", "left")
        candidates = right.groupBy("word").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("odds", "right", "right_v")), asc=False).alias("candidates"))
        known = suspects.join(candidates.hint(SORTED), "word", "left").join(vectors.select(F.col("word").alias("lower"), F.col("v").alias("own_v")).hint(SORTED), F.lower("word") == F.col("lower"), "left").select("word", "n", "own_v", "candidates")
        judged = self.occurrences.join(known.hint(SORTED), "word").mapInPandas(judge, "page_id long, line_no int, word string, cut int, next_line int, right string, misread boolean")
        self.misread = materialize(judged.where("misread").drop("misread"), "scan-misread")

    def _contexts(self, suspects: DataFrame) -> None:
        """Vectors of the linked words, and of the surroundings of each occurrence of a suspect."""
        spark = self.spark
        sketch = np.zeros(SKETCH)
        cells = self.words.groupBy(F.pmod(F.crc32(F.lower("word")), F.lit(SKETCH)).alias("cell")).agg(F.sum("n").alias("n")).toArrow()
        np.add.at(sketch, cells["cell"].to_numpy(), cells["n"].to_numpy())
        weigh = np.where(sketch >= 2, np.minimum(1.0, np.sqrt(SAMPLE * max(sketch.sum(), 1.0) / np.maximum(sketch, 1.0))), 0.0).astype("f4")

        def bits(words: DataFrame) -> np.ndarray:
            got = np.zeros(BLOOM, bool)
            got[words.select(F.pmod(F.crc32("w"), F.lit(BLOOM)).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
            return got

        linked = self.linked.select(F.explode(F.array(F.lower("word"), "folded")).alias("w"))
        shared = spark.sparkContext.broadcast((weigh, np.packbits(bits(linked)), np.packbits(bits(suspects.select(F.col("word").alias("w"))))))
        contexts = self.pages.select("page_id", "words", "kinds", "lines", "cuts", "nexts").mapInArrow(lambda batches: surroundings(batches, *shared.value), "word string, v array<float>, page_id long, line_no int, cut int, next_line int, x binary")
        contexts = materialize(contexts, "scan-contexts")
        sums = contexts.where("v is not null").groupBy("word").agg(*[F.sum(F.col("v")[d]).alias(f"v{d}") for d in range(DIM)])
        vectors = sums.select("word", F.array(*[F.col(f"v{d}") for d in range(DIM)]).alias("v"))
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        self.vectors = vectors.select("word", F.struct(size.alias("size"), F.transform("v", lambda x: F.coalesce(F.try_divide(x * 127, size), F.lit(0.0)).cast("tinyint")).alias("q")).alias("v"))
        self.occurrences = contexts.where("x is not null").select("word", "page_id", "line_no", "cut", "next_line", "x")

    def _broken_lines(self) -> DataFrame:
        """(page_id, line_no) of the lines that end inside a word."""
        breaks = self.pages.select("page_id", F.explode("breaks").alias("b")).select("page_id", "b.*")
        joined = self.keys.select(F.col("key").alias("joined"), F.col("n").alias("n_joined"))
        hyphened = self.keys.select(F.col("key").alias("hyphened"), F.col("n").alias("n_hyphened"))
        judged = breaks.join(joined.hint(SORTED), "joined", "left").join(hyphened.hint(SORTED), "hyphened", "left")
        n_joined, n_hyphened = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_hyphened", F.lit(0))
        return judged.where(F.col("sign").isin(list(SURE_BREAKS)) | F.when(n_joined != n_hyphened, n_joined > n_hyphened).otherwise(F.col("lower"))).select("page_id", "line_no")

    def faults(self) -> DataFrame:
        """(page_id, line_no, fault)."""
        later = (F.col("cut") > 0) & (F.expr("substring(word, 1, cut)") == F.expr("substring(right, 1, cut)"))
        glyphs = self.misread.withColumn("line_no", F.when(later, F.col("next_line")).otherwise(F.col("line_no"))).where("line_no >= 0")
        return (
            self.pages.select("page_id", F.explode("furniture").alias("line_no"), F.lit("furniture").alias("fault"))
            .unionByName(self._broken_lines().select("page_id", "line_no", F.lit("hyphen").alias("fault")))
            .unionByName(glyphs.select("page_id", "line_no", F.lit("glyph").alias("fault")).distinct())
        )

    def repaired(self) -> DataFrame:
        """(source_id, page_id, page_number, paragraph_no, paragraph): the text reflowed, without furniture,
        broken words joined and misread words corrected. A paragraph stands with the page it starts on and takes
        in the beginning of the next page where it goes on there; one that fills a page whole is cut after it."""
        right = self.misread.where("right is not null")
        # a correction is of a word in a line
        fixes = right.where("cut = 0").groupBy("page_id", F.concat_ws(" ", "line_no", "word").alias("at")).agg(F.min("right").alias("right")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "right"))).alias("fixes"))
        cut_lines = self._broken_lines().distinct()
        cuts = cut_lines.groupBy("page_id").agg(F.collect_set("line_no").alias("cuts"))
        # corrections of broken words: for the line that begins them, and over a page's end for the next page too
        halved = right.where("cut > 0").join(cut_lines.hint(SORTED), ["page_id", "line_no"])
        halved = materialize(halved.select("page_id", "line_no", "next_line", F.struct("word", "cut", "right").alias("fix")), "scan-halved")
        ends = halved.groupBy("page_id", "line_no").agg(F.min("fix").alias("fix")).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "fix"))).alias("ends"))
        pages = self.whole.select("page_id", "source_id", "page_number", "furniture")
        numbers = pages.drop("furniture").where("page_number is not null")
        # where page numbers repeat, the least page_id gives and takes, as with paragraphs
        giving = halved.where("next_line < 0").join(numbers.hint(SORTED), "page_id").groupBy("source_id", (F.col("page_number") + 1).alias("page_number")).agg(F.min_by("fix", "page_id").alias("begins"))
        begins = numbers.groupBy("source_id", "page_number").agg(F.min("page_id").alias("page_id")).join(giving.hint(SORTED), ["source_id", "page_number"]).select("page_id", "begins")
        whole = pages.join(self.texts.hint(SORTED), "page_id").join(fixes.hint(SORTED), "page_id", "left").join(cuts.hint(SORTED), "page_id", "left").join(ends.hint(SORTED), "page_id", "left").join(begins.hint(SORTED), "page_id", "left")

        def flow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    cut = set(map(int, r.cuts)) if r.cuts is not None else set()
                    parts, glue = reflow(r.text, set(map(int, r.furniture)), cut, dict(r.fixes) if r.fixes is not None else {}, dict(r.ends) if r.ends is not None else {}, r.begins)
                    for k, p in enumerate(parts):
                        # None: the paragraph ends here; else what parts it from the next page's beginning
                        tail = glue if k == len(parts) - 1 and not p.rstrip("\"'”»“)").endswith((".", "!", "?", "…", ":")) else None
                        out.append((r.source_id, r.page_id, r.page_number, k, p, tail))
                yield pd.DataFrame(out, columns=["source_id", "page_id", "page_number", "paragraph_no", "paragraph", "tail"])

        rows = materialize(whole.mapInPandas(flow, "source_id long, page_id long, page_number int, paragraph_no int, paragraph string, tail string"), "scan-paragraphs")
        heads = rows.where("paragraph_no = 0 and page_number is not null").groupBy("source_id", F.col("page_number").alias("next_number")).agg(F.min_by(F.struct("page_id", F.col("paragraph").alias("text")), "page_id").alias("head"))
        tails = rows.where("tail is not null and page_number is not null").withColumn("next_number", F.col("page_number") + 1)
        # one page of a number gives its beginning away, and to one page only
        giver = tails.groupBy("source_id", "next_number").agg(F.min("page_id").alias("page_id"))
        taken = tails.join(giver.hint(SORTED), ["source_id", "next_number", "page_id"]).join(heads.hint(SORTED), ["source_id", "next_number"]).select("page_id", F.col("head.page_id").alias("from_page"), F.col("head.text").alias("more"))
        # a page that is nothing but the middle of a paragraph keeps its text
        whole_pages = rows.where("paragraph_no = 0 and tail is not null").select(F.col("page_id").alias("from_page"))
        taken = taken.join(whole_pages.hint(SORTED), "from_page", "left_anti")
        out = rows.join(taken.select("page_id", "more").hint(SORTED), "page_id", "left").withColumn("paragraph", F.when(F.col("tail").isNotNull() & F.col("more").isNotNull(), F.concat("paragraph", "tail", "more")).otherwise(F.col("paragraph")))
        out = out.join(taken.select(F.col("from_page").alias("page_id"), F.lit(True).alias("given")).hint(SORTED), "page_id", "left")
        return out.where("given is null or paragraph_no > 0").select("source_id", "page_id", "page_number", "paragraph_no", "paragraph")


def _mended(fix) -> tuple[str, str, str, str]:
    """The halves of a broken word, and of what it is corrected to."""
    word, cut, right = fix["word"], int(fix["cut"]), fix["right"]
    at = cut if right[:cut] == word[:cut] else min(max(cut + len(right) - len(word), 0), len(right))
    return word[:cut], word[cut:], right[:at], right[at:]


def reflow(text: str, gone: set[int], cuts: set[int], fixes: dict[str, str], ends: dict | None = None, begins=None) -> tuple[list[str], str]:
    """Paragraphs of a page, parted by blank or indented lines, and what parts the last from what follows.
    ``fixes`` are corrections of whole words, by line and word, ``ends`` those of words broken at the end of a line, ``begins``
    that of a word broken at the end of the page before, each with word, length of the first half, and right."""
    paragraphs: list[str] = []
    glue, new = "", True
    ends = ends or {}
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if i in gone:
            continue
        if not line.strip():
            new = True
            continue
        tokens = line.split()
        ending = ends.get(i) if i in cuts else None
        shown = []
        for n, t in enumerate(tokens):
            parts = re.split(r"([-'’])", t)
            done = set()  # halves of corrected words are not looked up as words of their own
            if n == 0 and begins:
                _, half, _, good = _mended(begins)
                if parts[0].startswith(half):
                    parts[0] = good + parts[0][len(half) :]
                    done.add(0)
            if n == len(tokens) - 1 and ending:
                half, _, good, _ = _mended(ending)
                k, sign = (len(parts) - 3, "") if t.endswith("-") else (len(parts) - 1, t[-1])
                core = parts[k].removesuffix(sign)
                if core.endswith(half):
                    parts[k] = core.removesuffix(half) + good + sign
                    done.add(k)
            for k in range(0, len(parts), 2):
                core = parts[k].strip(EDGE)
                if k not in done and (fix := fixes.get(f"{i} {core}")) is not None:
                    parts[k] = parts[k].replace(core, fix)
            shown.append("".join(parts))
        begins = ending
        joined = " ".join(shown)
        if i in cuts:
            joined = joined.rstrip()[:-1]
        if paragraphs and not (new or line.startswith(("  ", "\t"))):
            paragraphs[-1] += glue + joined
        else:
            paragraphs.append(joined)
        glue = "" if i in cuts or break_sign(line) == "-" else " "
        new = False
    return paragraphs, glue
