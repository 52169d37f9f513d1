"""Sentence units of texts in any script, by a pushdown automaton.

A text falls into blocks at blank lines and into items at list marks. Within a
unit the automaton reads only events (terminators, quotes, brackets, blanks
between Thai letters); its stack holds the open quotes and brackets, and nothing
ends while it is not empty. Abbreviations are read backwards through a trie.

Defined cases: a null, empty or blank text has no sentence; rows without id are left out; a quote or bracket
that never closes in its unit is not opened; a unit without closing mark ends
with its last character that is not blank; offsets count code points, and the
cost grows linearly with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations. never = no sentence ends here; number = none if a number follows; maybe = what follows decides.
NEVER = "dr prof mr mrs ms st sr sra srta dra mme mlle messrs hr fr frau vgl bzw ca approx env aprox cf vs viz re ggf evtl inkl zzgl sog dipl ing rev gen col lt capt sgt gov sen rep hon mt ft डॉ श्री डा प्रो i.e e.g z.b d.h p.ex p.ej u.u o.ä s.o s.u".split()
NUMBER = "no nr núm num fig figs abb p pp s pág págs sect sec art tab bd kap vol vols ch chap ext n eq bl jg lfd cap §".split()
MAYBE = "etc usw al a.m p.m u.a ff jr inc ltd co corp usf ss".split()
WEEKDAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thurs fri sat sun".split())
ORDINAL_NEXT = frozenset(
    "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts jh jahrestag jan feb mrz apr jun jul aug sep sept okt nov dez".split()
)
SPEECH = frozenset(
    "said says asked asks cried cries shouted shouts wrote writes replied answered whispered muttered called added explained told remarked insisted yelled screamed exclaimed murmured observed laughed sighed continued "
    "fragte sagte rief schrieb antwortete meinte flüsterte erklärte demanda dit répondit cria écrivit ajouta murmura preguntó dijo respondió gritó exclamó escribió añadió".split()
)
CLOSER = {"“": "”", "„": "“", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", '"': '"', "‘": "’", "‚": "‘", "［": "］"}
CLOSERS = frozenset(CLOSER.values())
BRACKETS = frozenset("([{（【《〈［")
TERMINAL = frozenset(".!?…。！？｡।॥؟۔։።")
WIDE = frozenset("。！？｡।॥۔։።")
TAIL = frozenset("”»)]}）」』】")

BLANK_LINE = re.compile(r"\r?\n[^\S\n]*\n\s*|\r[^\S\r\n]*\r\s*")
MARK = re.compile(r"(?m)^[^\S\n]*(?:[-*•‣◦▪·–—+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)])[^\S\n]+(?=\S)")
EVENT = re.compile(r"[.!?…。！？｡।॥؟۔։።]+|[“„«»‹›「」『』()\[\]{}（）【】《》〈〉\"‘’‚”［］]|(?<=[ก-๙”])[^\S\n]+(?=[ก-๏“])")
WORD = re.compile(r"[^\W\d_][\w'’-]*")
NAME_VERB = re.compile(r"((?:[^\W\d_][\w'’.-]*\s+){1,4})")
CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
JA_PARTICLES = frozenset("とっはがをにでもの、")


def _trie() -> dict:
    root: dict = {}
    for kind, words in (("never", NEVER), ("number", NUMBER), ("maybe", MAYBE)):
        for w in words:
            node = root
            for ch in reversed(w):
                node = node.setdefault(ch, {})
            node["kind"] = kind
    return root


TRIE = _trie()


def _abbreviation(t: str, dot: int, lo: int) -> str | None:
    """Kind of the abbreviation that ends before the full stop at ``dot``."""
    node, j, kind = TRIE, dot - 1, None
    while j >= lo:
        ch = t[j]
        node = node.get(ch) or node.get(ch.lower())
        if node is None:
            break
        j -= 1
        if "kind" in node and (j < lo or not (t[j].isalnum() or t[j] == ".") or (node["kind"] != "maybe" and t[j] == "." and j == dot - 2)):
            kind = node["kind"]
    if kind:
        return kind
    # a single letter: an initial, or part of a dotted abbreviation
    if dot - 1 >= lo and t[dot - 1].isalpha() and (dot - 2 < lo or not t[dot - 2].isalnum()) and not CJK.match(t[dot - 1]):
        return "never"
    return None


def _starts(t: str, n: int, e: int) -> bool:
    """Whether a sentence can start at ``n``: anything but a lower-case word or closing punctuation."""
    while n < e and (t[n] in CLOSER or t[n] in "¿¡—–-'" or t[n].isspace()):
        n += 1
    if n >= e:
        return False
    ch = t[n]
    if ch.islower():
        word = WORD.match(t, n, e)
        return bool(word and any(c.isupper() for c in word.group()[1:]))
    return not (ch in CLOSERS or ch in ",;:.!?…、，；：%/")


def _cased_start(t: str, n: int, e: int) -> bool:
    """For a mark without a blank after it: a capitalised word or an opening mark."""
    ch = t[n]
    if ch in "“„«¿¡(「『" or ch == '"':
        return _starts(t, n + 1, e)
    return ch.isupper() and n + 1 < e and (t[n + 1].islower() or t[n + 1].isspace())


def _attributed(t: str, n: int, e: int) -> bool:
    """Whether speech that opened the sentence goes on: she said, asked Ann, 管理员问道."""
    ch = t[n]
    if ch in "—–-":
        n += 1
        while n < e and t[n].isspace():
            n += 1
        if n >= e:
            return True
        ch = t[n]
    if ch in CLOSER or ch in "¿¡" or not ch.isalpha():
        return ch in ",;:，、"
    if not (ch.islower() or ch.isupper()):
        return True
    if ch.islower():
        return not _starts(t, n, e)
    head = NAME_VERB.match(t, n, e)
    return bool(head) and any(w.strip(".,") in SPEECH for w in head.group(1).split()[1:])


def _unit(t: str, s: int, e: int, ends: list[int]) -> None:
    """Ends of the sentences of t[s:e], a block or a list item without outer blanks."""
    stack: list[tuple[str, str, int]] = []
    first, last = s, {}
    wide_text = None
    for m in EVENT.finditer(t, s, e):
        at, to = m.span()
        ch = t[at]
        if ch in TERMINAL:
            if stack:
                continue
            # an apostrophe-free tail of closing marks that nothing opened
            while to < e and t[to] in TAIL:
                to += 1
            n = to
            while n < e and t[n].isspace():
                n += 1
            if n >= e:
                break
            run = m.group()
            if any(c in WIDE for c in run):
                if t[n] in CLOSERS and t[n] not in CLOSER:
                    continue
            elif run[-1] == "…" or run.startswith(".."):
                if n == to or not _starts(t, n, e) or CJK.match(t[n]):
                    continue
            elif n == to:
                if not _cased_start(t, n, e) or run == "." and not (at > s and t[at - 1].isalnum()):
                    continue
                if run == "." and _abbreviation(t, at, first) == "never":
                    continue
                word_at = at
                while word_at > first and not t[word_at - 1].isspace():
                    word_at -= 1
                if "/" in t[word_at:at] or "@" in t[word_at:at]:
                    continue
            else:
                if not _starts(t, n, e):
                    continue
                if t[n] in "—–-" and not (n + 1 < e and (t[n + 1].isupper() or t[n + 1] in "¿¡«“\"")) and not (n + 2 < e and t[n + 1].isspace() and t[n + 2].isupper()):
                    continue
                if run == ".":
                    kind = _abbreviation(t, at, first)
                    if kind == "never":
                        continue
                    if kind == "number" and t[n].isdigit():
                        continue
                    if kind == "maybe":
                        word = WORD.match(t, n, e)
                        if word and t[at - 1] in "mM" and word.group().lower() in WEEKDAYS:
                            continue
                    if at - 1 >= s and t[at - 1].isdigit() and (at - 2 < s or t[at - 2].isspace() or at - 3 < s or t[at - 2].isdigit() and t[at - 3].isspace()):
                        word = WORD.match(t, n, e)
                        if word and word.group().lower() in ORDINAL_NEXT:
                            continue
        elif ch.isspace():  # between Thai letters
            if stack or t[at - 1] == "ๆ":
                continue
            to, n = at, m.end()
        else:
            closes = -1
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == ch:
                    closes = k
                    break
            if closes < 0:
                want = CLOSER.get(ch)
                if want is None or ch in "‘’" and at > s and t[at - 1].isalnum() or ch == "»" and not (at == s or t[at - 1].isspace()):
                    continue
                if want not in last:
                    last[want] = t.rfind(want, s, e)
                if last[want] > at:
                    stack.append((ch, want, at))
                continue
            if ch == "’" and to < e and t[to].isalnum():
                continue
            opener, _, opened = stack[closes]
            del stack[closes:]
            if stack:
                continue
            k = at - 1
            while k > opened and t[k].isspace():
                k -= 1
            if t[k] not in TERMINAL and not (t[k] in CLOSERS and k > opened and t[k - 1] in TERMINAL):
                continue
            while to < e and t[to] in TAIL:
                to += 1
            n = to
            while n < e and t[n].isspace():
                n += 1
            if n >= e:
                break
            leads = not any(c.isalnum() for c in t[first:opened])
            if opener in BRACKETS:
                if not leads or not _starts(t, n, e):
                    continue
            elif leads:
                if _attributed(t, n, e) or not _starts(t, n, e):
                    continue
            else:
                k = opened - 1
                while k > first and t[k].isspace():
                    k -= 1
                if CJK.match(t[n]):
                    if t[n] in JA_PARTICLES or t[k] not in ":：" and n == to:
                        continue
                elif not _starts(t, n, e) or n == to and not (t[n].isupper() or t[n] in CLOSER or t[n].isdigit()):
                    continue
        ends.append(to)
        first = n
    ends.append(e)


def sentence_ends(text: str | None) -> list[int]:
    """Offsets just behind each sentence of the text."""
    ends: list[int] = []
    if not text:
        return ends
    pos, size = 0, len(text)
    cuts = [m.span() for m in BLANK_LINE.finditer(text)]
    for lo, hi in [*cuts, (size, size)]:
        s, e = pos, lo
        pos = hi
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s == e:
            continue
        marks = [(max(m.start(), s), m.end()) for m in MARK.finditer(text, text.rfind("\n", 0, s) + 1, e)] if text[s] in "-*•‣◦▪·–—+(" or text[s].isalnum() else []
        if not marks or (len(marks) == 1 and text[s] in "–—" and marks[0][0] == s):
            _unit(text, s, e, ends)
            continue
        starts = [(s, s), *marks] if marks[0][0] > s else marks
        for k, (a, body) in enumerate(starts):
            z = starts[k + 1][0] if k + 1 < len(starts) else e
            while z > a and text[z - 1].isspace():
                z -= 1
            if z > body:
                _unit(text, body, z, ends)
            elif z > a:
                ends.append(z)
    return ends


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, list marks left to the item that follows."""
    out, at = [], 0
    for end in sentence_ends(text):
        while at < end and text[at].isspace():
            at += 1
        out.append((at, end))
        at = end
    return out


def sentence_ends_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, end_char): the end of every sentence; no exchange, one pass over the scan."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = sentence_ends(text)
                ids += [key] * len(got)
                ends += got
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "end_char": pa.array(ends, pa.int32())})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).mapInArrow(split, "id long, end_char int").withColumnRenamed("id", id_col)


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_no, start_char, end_char, sentence) for every sentence of every text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(sentence_spans(text)):
                    for col, v in zip(cols, (key, k, a, b, text[a:b])):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "sentence_no", "start_char", "end_char", "sentence"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).mapInArrow(split, "id long, sentence_no int, start_char int, end_char int, sentence string").withColumnRenamed("id", id_col)
