"""The lines of a mail that its sender wrote for it.

Per thread (the subject without reply marks) a generalised suffix automaton over
words takes in the whole bodies of its mails in order, quote marks stripped. What a
later mail has in common with an earlier one in ``LONG`` words or more is inherited,
however it is wrapped or marked; patterns (quote marks, wrapped tails, attributions,
header blocks) find what introduces it, and quotes of mails that are not at hand.

Then endings go that recur: with one sender, in ``LEAST`` of its different mails and
at the rate ``OWN``; with everybody, if ``SENDERS`` different senders have them, in
``SURE`` of their mails below a closing formula, name or rule, as paragraphs without sentence, or as
last ones of ``SENTENCE`` words or more, or if they recur with two senders. No
threshold is a share of the corpus, so more mails never bring an ending back.

Every thread is cut into segments of about ``SEGMENT`` mails by a hash of the id. A
segment has one automaton; what its mails inherit from other segments of the thread
comes from a join on hashes of ``LONG`` words in a row, which finds the same matches.
The result does not depend on ``SEGMENT``.

Defined cases: null and blank bodies have no line; line ends are CRLF, CR or LF,
numbering counts LF; mails without subject form no thread; rows without id are left
out; copies of a body in a thread are read once, inherit nothing from one another,
count once for their sender's endings, and have the lines of the copy with the least
id; null senders have no name to strip and no endings of their own.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

LONG = 16
SEGMENT = 400
OWN = 0.2
LEAST = 3
SENDERS = 4
SENTENCE = 6
SURE = 0.75

# Words of mail programs in the languages of the corpus.
REPLY = r"(?iu)^(?:\s*(?:re|fwd?|aw|wg|sv|vs|tr|rv|antw|ref|réf|i|r)\s*(?:\[\d+\])?\s*:)+\s*"
HEADER = re.compile(r"^\s*\*?(?:From|Sent|To|Subject|Date|Cc|Bcc|Reply-To|Von|Gesendet|An|Betreff|Datum|De|Envoyé|À|Objet|Date|Enviado el|Enviado|Para|Asunto|Fecha|Da|Inviato|A|Oggetto)\s?:\*?\s", re.I)
HEADER_FIRST = re.compile(r"^\s*\*?(?:From|Von|De|Da|Date|Datum|Sent|Subject|Betreff|Objet|Asunto)\s?:", re.I)
SEPARATOR = re.compile(r"^\s*(?:-{2,}\s*[^\W\d_][^-]*-{2,}|_{10,}|-{10,}|={10,}|Begin forwarded message:|Anfang der weitergeleiteten Nachricht:|Début du message réexpédié :|Début du message transféré :|Inicio del mensaje reenviado:)\s*$")
QUOTE = re.compile(r"^[ \t]{0,3}(?:[>|»]|[A-ZÄÖÜ]{1,4}>)[>|» \tA-Z]*")
QUOTED = re.compile(r"^[ \t]{0,3}(?:[>|»]|[A-ZÄÖÜ]{1,4}>)")
MARK = re.compile(r"[>|»]")
MARKS = re.compile(r"^[ \t]{0,3}(?:[A-ZÄÖÜ]{0,4}[>|»][ \t]?)+")
ATTRIBUTION = re.compile(
    r"(?:^\s*(?:On|Am|Le|El|Il|Op|Quoting|Zitat von|En|Citando a)\b.*|.*(?:<[^<>\s]+@[^<>\s]+>|\b(?:wrote|schrieb|écrit|escribió|writes|ha scritto)\b|\d{4}[-./]\d{1,2}[-./]\d{1,2}).*):\s*$", re.I | re.S
)
ATTRIBUTION_TAIL = re.compile(r"^\s*(?:<[^>]*>|wrote|schrieb|a écrit|escribió|[\d./-]+:|[\d. ]*\w+:|\"?[\w', -]+\"?\s*<)", re.I)
PHONE = re.compile(r"^\s*(?:[\w./]{1,12}[.:]?\s*)?\+?[\d()][\d\s()/.+-]{4,}$")
LINK = re.compile(r"^\s*<?(?:https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+)>?\s*$")
RULE = re.compile(r"^\s*(?:-{2,3}|—|–|_{3,}|-{5,}|={5,}|~{3,}|(?:\*\s*){3,}|#{3,})\s*$")
CLOSING = re.compile(
    r"^\s*(?:(?:kind|best|warm|many)?\s*(?:regards|wishes|greetings)|best|cheers|thanks(?: again)?|many thanks|thank you|yours(?: \w+)?|sincerely|all the best|take care|"
    r"(?:mit )?(?:freundlichen|besten|vielen|herzlichen|lieben)? ?grüßen?|(?:viele|beste|liebe|schöne|herzliche|freundliche) grüße|lg|vg|mfg|gruß|danke(?: und gruß)?|"
    r"cordialement|bien (?:à vous|cordialement)|à bientôt|amicalement|bonne journée|merci|salutations|"
    r"(?:un )?saludos?(?: cordial(?:es)?)?|gracias(?: y saludos)?|atentamente|un abrazo|cordialmente)\s*[,.!]?\s*$",
    re.I,
)
SIGNATURE = re.compile(r"^-- $")
POSTSCRIPT = re.compile(r"^\s*(?:P\.? ?(?:P\.? ?)?S\.?|N\.?B\.?|PD|P\.D\.)\s*[:.,-]?\s", re.I)
NAME = re.compile(r"^\s*[^\W\d_a-z][\w'’-]*\.?(?:\s+[^\W\d_a-z][\w'’.-]*){0,2}\s*,?\s*$")
GREETING = re.compile(r"^¶?(?:hi|hello|hey|dear|hallo|liebe[rs]?|guten (?:tag|morgen|abend)|sehr geehrte[rs]?|moin|salut|bonjour|bonsoir|cher|chère|hola|buen[oa]s|estimad[oa]s?|querid[oa]s?)\b", re.I)
LIST_FOOTER = re.compile(r"\b(?:mailing[- ]?list|mailingliste|liste de diffusion|lista de correo|unsubscribe|abbestellen)\b", re.I)
LIST = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")
SENTENCE_END = re.compile(r"[.!?…][\"'”’»“)\]\s]*$")
INITIALS = re.compile(r"^\s*(?:[^\W\d_a-zß-ÿ]\.\s*)+$")
WORDS = re.compile(r"[\w'’@./:-]*\w")
ENDS = (".", "!", "?", "…", "。", ":", ";", ",")


def thread_of(subject) -> F.Column:
    """Subject without reply marks, blank where there is none."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), REPLY, "")))


def split_lines(body: str) -> list[str]:
    return [line.rstrip("\r") for line in body.split("\n")]


def mark_quotes(lines: list[str], inherited: frozenset[int] | set[int] = frozenset()) -> list[bool]:
    """Which lines are quoted, introduce a quote or belong to a header block; ``inherited``: those known to be old."""
    n = len(lines)
    marked = [bool(QUOTED.match(x)) for x in lines]
    old, blank = list(marked), [not x.strip() for x in lines]
    # wrapped tails: no blank line between them and the quoted line they go on from
    for i in range(1, n):
        if not old[i] and not blank[i] and old[i - 1] and not (marked[i - 1] and not QUOTE.sub("", lines[i - 1]).strip()):
            old[i] = True
    quoted = list(marked)
    for i in inherited:
        old[i] = quoted[i] = True
    for i in range(n):
        if not quoted[i] or (i and quoted[i - 1]):
            continue
        j = i - 1
        while j >= 0 and blank[j] and i - j < 3:
            j -= 1
        if j < 0 or old[j] or blank[j]:
            continue
        top = j
        while top > 0 and j - top < 3 and not blank[top - 1] and not old[top - 1] and ATTRIBUTION_TAIL.match(lines[top]) and not re.match(r"^\s*(?:On|Am|Le|El|Quoting)\b", lines[top]):
            top -= 1
        for a in range(top, j + 1):
            if ATTRIBUTION.match("\n".join(lines[a : j + 1])) and (a == j or not ATTRIBUTION.match(lines[j]) or ATTRIBUTION_TAIL.match(lines[j])):
                for k in range(a, j + 1):
                    old[k] = True
                break
    # a raw header block: everything behind it is what was forwarded
    for i in range(n):
        if old[i] or not HEADER_FIRST.match(lines[i]):
            continue
        run = i + 1
        while run < n and HEADER.match(lines[run]):
            run += 1
        above = i - 1
        while above >= 0 and blank[above]:
            above -= 1
        parted = above >= 0 and bool(SEPARATOR.match(lines[above]))
        if run - i >= 2 or (parted and run < n):
            start = above if parted else i
            for k in range(start, n):
                old[k] = True
            break
    return old


def segments(lines: list[str], old: list[bool]) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of lines that are not old."""
    out, a = [], None
    for i in range(len(lines) + 1):
        if i < len(lines) and not old[i]:
            a = i if a is None else a
        elif a is not None:
            if any(lines[k].strip() for k in range(a, i)):
                out.append((a, i))
            a = None
    return out


def canonical(line: str) -> str:
    s = re.sub(r"https?://\S+", "URL", line.strip())
    s = re.sub(r"[\w.+-]+@[\w.-]+", "MAIL", s)
    return re.sub(r"\d+", "9", s)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_key(line: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(canonical(line)))


def lower_parts(lines: list[str], top: int, end: int) -> Iterator[tuple[int, int]]:
    """(line, key) of every part [line, end) of a paragraph; a key is of its words, however they are wrapped."""
    h = 0
    for i in range(end - 1, top - 1, -1):
        for w in reversed(lines[i].split()):
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w) + 1) & 0xFFFFFFFFFFFFFFFF
        yield i, _signed(h)


def _paragraph(lines: list[str], a: int, end: int) -> int:
    """First line of the paragraph that ends before ``end``, not above ``a``."""
    i = end
    while i > a and lines[i - 1].strip():
        i -= 1
    return i


def ending_candidates(lines: list[str], old: list[bool], names: set[str]) -> dict[int, tuple[int, bool, bool, bool]]:
    """What could recur, key to (line, whether it is a part of a paragraph, whether it counts or is looked up only,
    whether it looks like an ending): last lines, and the lower parts of paragraphs, of the mail's own parts. Whole
    paragraphs count, and what stands below an introducing line in them. An ending stands below a closing formula,
    rule or name, or is a paragraph without sentence, or the mail's last one and no short sentence."""
    got: dict[int, tuple[int, bool, bool, bool]] = {}
    parts = segments(lines, old)
    last = parts[-1][0] if parts else 0
    for a, b in parts:
        end, lowest, lines_below = b, b, 0
        here: list[tuple[int, int, bool, bool, bool]] = []
        while end > a:
            while end > a and not lines[end - 1].strip():
                end -= 1
            if end <= a:
                break
            top, i = _paragraph(lines, a, end), end
            if POSTSCRIPT.match(lines[top]):
                end = top
                continue
            # line by line, as long as they don't read as sentences
            while i > top and not LIST.match(lines[i - 1]) and (INITIALS.match(lines[i - 1]) or not SENTENCE_END.search(lines[i - 1])):
                i -= 1
            loose, bottom = i == top, not lines_below and a == last
            here += [(line_key(lines[k]), k, False, True, loose) for k in range(i, end) if not GREETING.match(lines[k])]
            bare = end  # without what patterns know, a list's footer below a notice
            while bare > top and (_introduces(lines[bare - 1], names) or _device(lines[bare - 1])):
                bare -= 1
            lines_below += bare - top
            for k, key in (*lower_parts(lines, top, end), *(lower_parts(lines, top, bare) if top < bare < end else ())):
                if not GREETING.match(lines[k]):
                    alone = k == top or _introduces(lines[k - 1], names)
                    here.append((key, k, True, alone, alone and (loose or bottom and sum(len(x.split()) for x in lines[k : k + SENTENCE]) >= SENTENCE)))
            lowest = next((k for k in range(top, end) if _introduces(lines[k], names)), lowest)
            # a notice may stand right below other ending lines
            if top < i < bare:
                break
            end = top
        for key, k, part, counts, sure in here:
            got[key] = (k, part, counts, sure or k > lowest)
    return got


def _device(line: str) -> bool:
    s = line.strip()
    return bool(PHONE.match(s) or LINK.match(s) or len(s) < 70 and LIST_FOOTER.search(s))


def _introduces(line: str, names: set[str]) -> bool:
    s = line.strip()
    return bool(CLOSING.match(s) or RULE.match(s)) or s.casefold().rstrip(",") in names


def sender_names(sender: str | None) -> set[str]:
    if not sender:
        return set()
    shown = re.sub(r"<[^>]*>", "", sender).replace('"', "").strip()
    if "," in shown:
        last, _, first = shown.partition(",")
        shown = f"{first.strip()} {last.strip()}"
    parts = shown.split()
    got = {shown.casefold()} | {p.casefold() for p in parts} | {f"{p[0]}." for p in (q.casefold() for q in parts) if p}
    if len(parts) > 1:
        got |= {"".join(p[0] for p in parts).casefold(), ". ".join(p[0] for p in parts).casefold() + ".", f"{parts[0]} {parts[-1][0]}.".casefold()}
    return got


def strip_endings(lines: list[str], old: list[bool], sender: str | None, known_lines: Collection[int] = (), known_parts: Collection[int] = ()) -> list[bool]:
    """``old`` with the endings of the mail's own parts marked too; known are lines that recur as endings, and
    those from which on the rest of their paragraph does."""
    out, names = list(old), sender_names(sender)

    def ending(i: int) -> bool:
        if _introduces(lines[i], names) or _device(lines[i]):
            return True
        return i in known_lines and not LIST.match(lines[i])

    parts = []
    for a, b in segments(lines, old):
        rule = next((k for k in range(a, b) if SIGNATURE.match(lines[k])), None)
        if rule is None:
            parts.append((a, b))
            continue
        # all below the rule is signature, up to a postscript that begins a paragraph
        after = next((k for k in range(rule + 1, b) if POSTSCRIPT.match(lines[k]) and not lines[k - 1].strip()), b)
        for k in range(rule, after):
            out[k] = True
        parts += [(a, rule), (after, b)]
    for a, b in parts:
        end, gone, kept = b, [], False
        while end > a:
            while end > a and not lines[end - 1].strip():
                end -= 1
            if end <= a:
                break
            top = _paragraph(lines, a, end)
            if POSTSCRIPT.match(lines[top]):  # new text behind the signature
                end, kept = top, True
                continue
            if top in known_parts:
                gone += range(top, end)
                end = top
                continue
            i = end
            while i > top:
                if ending(i - 1):
                    i -= 1
                elif NAME.match(lines[i - 1]) and i - 1 > a and (CLOSING.match(lines[i - 2]) or RULE.match(lines[i - 2])):
                    i -= 1
                elif (rule := next((k for k in range(i - 1, max(top, i - 7) - 1, -1) if RULE.match(lines[k])), None)) is not None and all(len(x) <= 70 for x in lines[rule + 1 : i]) and not any(x.rstrip().endswith((".", "!", "?")) and len(x) > 40 for x in lines[rule + 1 : i]):
                    i = rule
                else:
                    # the lower lines of a paragraph may be a known notice under the signature
                    cut = next((k for k in range(top, i) if k in known_parts), None)
                    if cut is None:
                        break
                    i = cut
            gone += range(i, end)
            if i > top:
                break
            end = top
        for k in gone:
            out[k] = True
    return out


class SuffixAutomaton:
    """Generalised suffix automaton over words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[str]) -> None:
        nxt, link, size, last = self.next, self.link, self.size, 0
        for w in words:
            if w in nxt[last]:
                q = nxt[last][w]
                if size[q] == size[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: str) -> int:
        nxt, link, size = self.next, self.link, self.size
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def lengths(self, words: list[str]) -> list[int]:
        """Of the longest match that ends with each word."""
        nxt, link, size, out, state, length = self.next, self.link, self.size, [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                length = size[state]
            if w in nxt[state]:
                state, length = nxt[state][w], length + 1
            else:
                length = 0
            out.append(length)
        return out

    def take_in(self, words: list[str], least: int, lengths: list[int]) -> None:
        """Add the stretches with a run of ``least`` words that is not known yet."""
        fresh = [k for k in range(least - 1, len(words)) if lengths[k] < least]
        begun = 0
        for n, k in enumerate(fresh):
            if n + 1 == len(fresh) or fresh[n + 1] != k + 1:
                self.add(words[fresh[begun] - least + 1 : k + 1])
                begun = n + 1


def covered(lengths: list[int], least: int) -> list[bool]:
    """Which words lie in a match of at least ``least`` words."""
    out, upto = [False] * len(lengths), 0
    for i, length in enumerate(lengths):
        if length >= least:
            for k in range(max(upto, i - length + 1), i + 1):
                out[k] = True
            upto = i + 1
    return out


def body_words(lines: list[str]) -> tuple[list[str], list[int]]:
    """The words of a body without its quote marks, and the line of each."""
    words, at = [], []
    for i, line in enumerate(lines):
        got = WORDS.findall(MARKS.sub("", line) if MARK.search(line, 0, 8) else line)
        words += got
        at += [i] * len(got)
    return words, at


def inherited_lines(lines: list[str], at: list[int], cover: list[bool]) -> tuple[set[int], dict[int, str]]:
    """Lines that are inherited whole, with wordless ones between them, and what is left of those that are in part."""
    if not any(cover):
        return set(), {}
    seen: dict[int, list[bool]] = {}
    for i, c in zip(at, cover):
        seen.setdefault(i, []).append(c)
    whole = {i for i, c in seen.items() if all(c)}
    filled = sorted(seen)
    for a, b in zip(filled, filled[1:]):
        if a in whole and b in whole:
            whole.update(k for k in range(a + 1, b) if lines[k].strip())
    rest = {}
    for i, c in seen.items():
        if i not in whole and any(c):
            head = MARKS.match(lines[i])
            text, kept, last = lines[i][head.end() if head else 0 :], [], 0
            for m, gone in zip(WORDS.finditer(text), c):
                if gone:
                    kept.append(text[last : m.start()])
                    last = m.end()
            rest[i] = re.sub(r"\s+", " ", "".join([*kept, text[last:]])).strip()
    return whole, rest


def slices(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The frames in pieces, so that lists made of a piece's mails stay small."""
    for frame in frames:
        for k in range(0, len(frame), rows):
            yield frame.iloc[k : k + rows]


def gram_hashes(words: list[str], seed: int) -> np.ndarray:
    """Of every ``LONG`` words in a row."""
    if len(words) < LONG:
        return np.empty(0, np.int64)
    codes = np.array([xxhash.xxh3_64_intdigest(w, seed=seed & 0xFFFFFFFF) for w in words], np.uint64)
    h = np.full(len(words) - LONG + 1, seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LONG):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(h)]
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _bodies(mails: DataFrame) -> DataFrame:
    """The mails with a text; ``address``: that of the sender, else what stands for it."""
    address = F.regexp_extract("sender", r"([^<>\s\"]+@[^<>\s\"]+)", 1)
    bodies = mails.select(F.col("mail_id").cast("long").alias("mail_id"), "subject", "sender", F.col("body_text").alias("body")).where(F.col("body").rlike(r"\S") & F.col("mail_id").isNotNull())
    return bodies.withColumn("address", F.lower(F.when(address != "", address).otherwise(F.trim("sender"))))


def _segments(bodies: DataFrame) -> DataFrame:
    """(mail_id, rep, same, thread, segment, parts) of every mail: ``same`` stands for its text whatever the blanks,
    ``rep`` is the copy that is read, parts are the segments of its thread, 0 where nothing can be inherited."""
    subject = thread_of(F.col("subject"))
    ids = materialize(bodies.select("mail_id", F.xxhash64(subject).alias("thread"), (subject == "").alias("alone"), F.xxhash64(F.regexp_replace("body", r"\s+", " ")).alias("same")), "mail-ids")
    first = ids.groupBy("thread", "alone", "same").agg(F.min("mail_id").alias("rep"))
    sizes = first.groupBy("thread", "alone").agg(F.count("*").alias("n"))
    parts = F.when(F.col("alone") | (F.col("n") < 2), 0).otherwise(F.ceil(F.col("n") / SEGMENT)).cast("int")
    segment = F.when(parts == 1, F.col("thread")).otherwise(F.xxhash64("thread", F.when(parts == 0, F.col("rep")).otherwise(F.pmod(F.xxhash64("rep"), parts))))
    read = first.join(sizes, ["thread", "alone"]).select("thread", "alone", "same", "rep", segment.alias("segment"), parts.alias("parts"))
    return materialize(ids.join(read, ["thread", "alone", "same"]).select("mail_id", "rep", "same", "thread", "segment", "parts"), "mail-segments")


def _across_segments(reps: DataFrame) -> DataFrame:
    """(mail_id, known): in threads of several segments, where runs of LONG words begin that an earlier mail has."""

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, at, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for mail_id, thread, body in frame[["mail_id", "thread", "body"]].itertuples(index=False):
                h = gram_hashes(body_words(split_lines(body))[0], int(thread))
                ids.append(np.full(len(h), mail_id))
                at.append(np.arange(len(h)))
                keys.append(h)
            yield pd.DataFrame({"mail_id": np.concatenate(ids), "at": np.concatenate(at).astype("int32"), "gram": np.concatenate(keys)})

    rows = reps.where("parts > 1").select("mail_id", "thread", "body").mapInPandas(grams, "mail_id long, at int, gram long")
    first = rows.groupBy("gram").agg(F.min("mail_id").alias("first"))
    return rows.join(first, "gram").where("first < mail_id").groupBy("mail_id").agg(F.collect_list("at").alias("known"))


READ = "mail_id long, sender string, address string, same long, body string, old array<int>, rest map<int,string>, endings array<struct<key: long, at: int, part: boolean, counts: boolean, sure: boolean>>"


def read_threads(bodies: DataFrame, segments_: DataFrame) -> DataFrame:
    """Every mail that is read, with its inherited and quoted lines and what could be its endings."""
    reps = bodies.select("mail_id", "sender", "address", "body").join(segments_.where("mail_id = rep").drop("rep"), "mail_id")
    known = _across_segments(reps)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sam = None, SuffixAutomaton()
        for frame in slices(frames):
            out = []
            for segment, parts, mail_id, sender, address, same, body, before in frame[["segment", "parts", "mail_id", "sender", "address", "same", "body", "known"]].itertuples(index=False):
                lines = split_lines(body)
                inherited, rest = set(), {}
                if parts:
                    if segment != current:
                        current, sam = segment, SuffixAutomaton()
                    words, at = body_words(lines)
                    lengths = sam.lengths(words)
                    cover = covered(lengths, LONG)
                    for k in before if before is not None else ():
                        cover[k : k + LONG] = [True] * LONG
                    inherited, rest = inherited_lines(lines, at, cover)
                    sam.take_in(words, LONG, lengths)
                old = mark_quotes(lines, inherited)
                endings = [{"key": key, "at": k, "part": part, "counts": counts, "sure": sure} for key, (k, part, counts, sure) in ending_candidates(lines, old, sender_names(sender)).items()]
                out.append((mail_id, sender, address, same, body, [i for i, o in enumerate(old) if o], rest, endings))
            yield pd.DataFrame(out, columns=["mail_id", "sender", "address", "same", "body", "old", "rest", "endings"])

    # a segment's mails lie together and in order, so they stream through its automaton; no group is gathered
    lined = reps.join(known, "mail_id", "left").repartition("segment").sortWithinPartitions("segment", "mail_id")
    return lined.select("segment", "parts", "mail_id", "sender", "address", "same", "body", "known").mapInPandas(stream, READ)


def recurring_endings(mails: DataFrame) -> DataFrame:
    """(mail_id, lines, parts): where endings begin that recur with the mail's sender or with everybody."""
    found = mails.select("mail_id", "address", "same", F.explode("endings").alias("e")).select("mail_id", "address", "same", "e.*")
    each = found.where("counts and address is not null").groupBy("address", "key", "same").agg(F.max(F.col("sure").cast("int")).alias("sure")).groupBy("address", "key").agg(F.count("*").alias("n"), F.avg("sure").alias("sure"))
    sent = mails.groupBy("address").agg(F.count_distinct("same").alias("sent"))
    each = each.join(sent, "address").withColumn("own", (F.col("n") >= LEAST) & (F.col("n") >= OWN * F.col("sent")))
    everywhere = each.groupBy("key").agg(F.count("*").alias("senders"), F.avg("sure").alias("sure"), F.count_if("own").alias("owners")).where(((F.col("senders") >= SENDERS) & (F.col("sure") >= SURE)) | (F.col("owners") >= 2))
    own = each.where("own").select("address", "key").join(everywhere, "key", "left_anti")
    known = found.join(everywhere.select("key"), "key", "left_semi").select("mail_id", "at", "part").unionByName(found.join(own, ["address", "key"], "left_semi").select("mail_id", "at", "part"))
    return known.groupBy("mail_id").agg(F.collect_set(F.when(~F.col("part"), F.col("at"))).alias("lines"), F.collect_set(F.when(F.col("part"), F.col("at"))).alias("parts"))


def new_text(mails: DataFrame) -> DataFrame:
    """(mail_id, line_no, line): the lines newly written by the sender; of a line that is inherited in part, what is left."""
    bodies = _bodies(mails)
    mails_read = _segments(bodies)
    threads = materialize(read_threads(bodies, mails_read), "mail-threads")

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            out = []
            for mail_id, sender, body, gone, rest, known_lines, known_parts in frame[["mail_id", "sender", "body", "old", "rest", "lines", "parts"]].itertuples(index=False):
                lines = split_lines(body)
                old = [False] * len(lines)
                for i in gone:
                    old[i] = True
                old = strip_endings(lines, old, sender, *(set(map(int, x)) if x is not None else () for x in (known_lines, known_parts)))
                left = dict(rest)
                kept = [i for i, x in enumerate(lines) if x.strip() and not old[i]]
                out.append((mail_id, kept, [left.get(i, lines[i]) for i in kept]))
            yield pd.DataFrame(out, columns=["rep", "line_no", "line"])

    found = threads.select("mail_id", "sender", "body", "old", "rest").join(recurring_endings(threads), "mail_id", "left").mapInPandas(final, "rep long, line_no array<int>, line array<string>")
    # every copy has the lines of the one that was read
    lines = found.join(mails_read.select("rep", "mail_id"), "rep").select("mail_id", F.explode(F.arrays_zip("line_no", "line")).alias("l"))
    return lines.select("mail_id", "l.line_no", "l.line")
