"""Sentence boundaries across languages and scripts.

The text is first cut into blocks: blank lines, fenced code (one unit with its
fences), headings, list items (the marker belongs to the first unit).  Within a
block the sentence-break property of each character decides, after the standard
rules (an ambiguous terminator before a digit or inside a word, before a lower
case continuation, before further terminators does not break), with three
additions: abbreviations of each language do not end a sentence, or only before
what can start one; nothing breaks inside a matched quotation or parenthesis, and
after one that closes with a terminator only what can start a sentence does; a
full stop whose space was lost breaks before a capitalised word; in Thai and Lao,
white space between two letters of the script is a boundary.  A line break inside
running text counts as a space.

Defined results
* offsets are code points, end exclusive, without surrounding white space or byte
  order marks; null, empty and blank texts give no unit;
* an unclosed fence reaches to the end of the text; quotation marks and brackets
  without a partner in their block are ordinary characters;
* texts may be of any length and are always read whole; equal texts give equal
  units; the language column is not used, since it can be wrong.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Abbreviations that never end a sentence, by language
NEVER = {
    "any": ["Dr", "Prof", "St", "cf", "vs", "max", "min", "resp", "incl", "excl", "ca"],
    "en": ["Mr", "Mrs", "Ms", "Messrs", "Rev", "Gen", "Lt", "Col", "Sgt", "Capt", "Maj", "Cmdr", "Adm", "Gov", "Sen", "Hon", "Supt", "Mt", "approx", r"e\.\s?g", r"i\.\s?e", "viz", "Jr"],
    "de": ["Hr", "Fr", "Nr", "Abb", "Abs", "Tab", "Kap", "bzw", "vgl", "evtl", "ggf", "inkl", "zzgl", "sog", "Ing", r"z\.\s*B", r"d\.\s*h", r"u\.\s*a", r"i\.\s*d\.\s*R", r"o\.\s*ä", r"s\.\s*o", r"z\.\s*T"],
    "fr": ["MM", "Mme", "Mlle", "env", "chap", r"p\.\s*ex", r"c\.-à-d"],
    "es": ["Sr", "Sra", "Srta", "Dra", "Ud", "Uds", "aprox", r"p\.\s*ej", r"EE\.\s*UU"],
    "ru": ["г", "гг", "рис", "стр", "см", "им", "ул", "табл", "гл", "напр", r"т\.\s*е", r"т\.\s*к", r"т\.\s*н"],
    "ar": ["د", "أ", "م", "ص"],
    "hi": ["डॉ", "श्री", "पृ", "सं", "प्रो"],
}
# those that end one only before a digit's absence: they stand before numbers
BEFORE_NUMBER = ["no", "No", "Nos", "nos", "Fig", "fig", "Figs", "Sec", "sec", "rev", "ver", "Vol", "vol", "pp", "ch", "Ch", "Eq", "eq", "Tab", "tab", "núm", "pág", "art", "Art", "№"]
# those that end one if the next word can start one
MAYBE = ["etc", "usw", "al", "Inc", "Ltd", "Corp", "Co", "GmbH", r"a\.\s?m", r"p\.\s?m", r"U\.\s?S", r"т\.\s*д", r"т\.\s*п", "др", "пр"]
# Signals of usual buses, which begin a sentence in lower case; a text's own names are those with an index
SIGNALS = frozenset(("sda", "scl", "mosi", "miso", "sck", "ss", "rdata", "wdata", "araddr", "awaddr", "tdata", "clk", "rst", "irq"))
_INDEXED = regex.compile(r"\b([a-z]{2,})\[\d")
MONTHS_BEFORE = regex.compile(r"(?:^|\s)(?:am|zum|vom|beim|im|ab|der|die|das|dem|den|des|zur|jeder|jedem|jeden|jede|jedes|ein(?:en|em|e)?|seit dem|bis zum)\s+\d{1,4}\Z")

_ABBREVIATION = regex.compile(
    r"(?<![\p{L}\p{N}_])(?<!(?<![\p{L}\p{N}_])\p{L}\.)(?:(?P<never>" + "|".join(sorted((a for s in NEVER.values() for a in s), key=len, reverse=True)) + r")|(?P<number>" + "|".join(BEFORE_NUMBER) + r")|(?P<maybe>" + "|".join(MAYBE) + r")|(?P<initial>\p{Lu}))\."
)
# the words that a listed abbreviation is made of: only after one of them is an abbreviation looked for
_PIECES = frozenset(w for a in (*(x for s in NEVER.values() for x in s), *BEFORE_NUMBER, *MAYBE) for w in regex.findall(r"[^\W\d_]+", a.replace(r"\s", " ")))
_LONGEST = max(map(len, _PIECES))
# what begins a sentence right after a full stop: a capitalised word, an initial or words in capitals
_GLUED = regex.compile(r"[¿¡]?(?:\p{Lu}\p{Ll}*(?:['’]\p{L}+)?[,:]?\s|\p{Lu}\.\s\p{Lu}|\p{Lu}{2,}\s)")
_BEFORE_GLUED = regex.compile(r"[\p{Ll}\p{N}\p{Lu})\]%\"»”]")
_TERMINATORS = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+(?:[\s ]?[\p{SB=STerm}\p{SB=ATerm}]+)*")
_CLOSERS = regex.compile(r"[\p{SB=Close}\"]*")
_THAI = regex.compile(r"(?<=[ก-ฺเ-๎])\s+(?=[ก-ฺเ-๎])|(?<=[ກ-ຽເ-ໍໜ-ໟ])\s+(?=[ກ-ຽເ-ໍໜ-ໟ])")
_FENCE = regex.compile(r"^[ \t]{0,3}(```+|~~~+)", regex.M)
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}[ \t]")
_ITEM = regex.compile(r"([ \t]*)(?:[-*+•‣◦–]|(\d{1,9}|[a-zA-Z])[.)])[ \t]+(?=\S)")
_LINE = regex.compile(r"[^\n]*\n?")
_IDENTIFIER = regex.compile(r"[a-z][a-z0-9]*(?:_[A-Za-z0-9]+)+|[a-z]+\d\w*|[a-z]+(?:[A-Z]\w*)+|[a-z]\w*(?:\[|\.\w)")
_WORD = regex.compile(r"[\p{L}\p{N}_]+")
_OPEN = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", "［": "］", "‹": "›"}
_CLOSE = frozenset(_OPEN.values()) | {"“"}
_PAIRED = regex.compile(r'["()\[\]{}«»“”„「」『』（）【】《》〈〉［］‹›]')
_GOES_ON = regex.compile(r"\s*[,;:，、；：)）]")
_LETTER = regex.compile(r"\p{L}")
_STRIP = "﻿"


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Outermost spans (start, end) of matched quotations and brackets, in order."""
    spans, stack, straight, wanted = [], [], None, Counter()
    for m in _PAIRED.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            if straight is None:
                straight = at
            else:
                spans.append((straight, at + 1))
                straight = None
        elif c in _CLOSE and wanted[c]:
            while stack:
                want, start = stack.pop()
                wanted[want] -= 1
                if want == c:
                    spans.append((start, at + 1))
                    break
        elif c in _OPEN:
            stack.append((_OPEN[c], at))
            wanted[_OPEN[c]] += 1
    spans.sort()
    outer: list[tuple[int, int]] = []
    for s, e in spans:
        if outer and s < outer[-1][1]:
            outer[-1] = (outer[-1][0], max(e, outer[-1][1]))
        else:
            outer.append((s, e))
    return outer


def _abbreviations(text: str) -> dict[int, str]:
    """Full stops that belong to an abbreviation, with the kind of it."""
    out: dict[int, str] = {}
    at = text.find(".")
    while at >= 0:
        begin, least = at, at - _LONGEST - 1
        while begin > 0 and begin > least and (text[begin - 1].isalpha() or text[begin - 1] in "ंःािीुूृेैोौ़्ॉॅ"):
            begin -= 1
        word = text[begin:at]
        if word in _PIECES or len(word) == 1 and word.isupper() or text[at - 1 : at] == "№":
            for m in _ABBREVIATION.finditer(text, max(0, at - 24), min(len(text), at + 16)):
                for i in range(m.start(), m.end()):
                    if text[i] == ".":
                        out[i] = "never"
                out[m.end() - 1] = m.lastgroup
        at = text.find(".", at + 1)
    return out


def _starts(text: str, at: int, names: frozenset[str] | set[str] = SIGNALS) -> str:
    """What stands at ``at``: upper, other (a caseless letter), name, lower, digit, mark or end."""
    n = len(text)
    while at < n and not (text[at].isalpha() or text[at].isdigit()):
        if text[at] in "¿¡«“\"「『‘„(（[—–-#*`'_" or text[at].isspace():
            at += 1
            continue
        return "mark"
    if at >= n:
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.isupper() or c.istitle():
        return "upper"
    if c.islower():
        if _IDENTIFIER.match(text, at):
            return "name"
        m = _WORD.match(text, at)
        return "name" if m.group() in names else "lower"
    return "other"


def _breaks(text: str, names: frozenset[str] | set[str] = SIGNALS) -> list[int]:
    """Offsets after which a sentence of a block ends; ``names`` are lower-case words that can start one."""
    out: list[int] = []
    enclosed, k = _enclosed(text), 0
    abbreviations = _abbreviations(text)
    n = len(text)
    for m in _TERMINATORS.finditer(text):
        start, end = m.span()
        while k < len(enclosed) and enclosed[k][1] <= start:
            k += 1
        run = m.group()
        inside = k < len(enclosed) and enclosed[k][0] < start
        close = _CLOSERS.match(text, end).end()
        if inside:
            # only a quotation that closes with this terminator can end the sentence
            if enclosed[k][1] > close or enclosed[k][1] <= end:
                continue
            close = _CLOSERS.match(text, enclosed[k][1]).end()
        elif k < len(enclosed) and enclosed[k][0] < close:
            close = enclosed[k][0] if enclosed[k][0] >= end else end
        after = text[close] if close < n else ""
        plain = run == "."
        strong = not plain and any(c not in ".․﹒．…" for c in run.strip())
        wide = not plain and any(c in "。！？｡．﹖﹗।॥؟۔።" or ord(c) > 0x2FFF for c in run)
        spaced = not after or after.isspace()
        if not spaced and not wide:
            # a lost space, unless the stop belongs to an abbreviation or a name
            glued = (after.isupper() or after in "¿¡") and not inside and abbreviations.get(start) in (None, "number", "maybe", "initial")
            if not (glued and start and _BEFORE_GLUED.match(text, start - 1) and _GLUED.match(text, close) and " " in text[max(0, start - 60) : start]):
                continue
        if not after:
            continue  # the end of the block
        nxt = _starts(text, close, names)
        if nxt == "end":
            continue
        if inside:
            if not spaced and nxt in ("other", "lower", "name", "upper", "digit"):
                continue
            if nxt in ("lower", "name", "mark"):
                continue
            if wide and not spaced:
                continue
            out.append(close)
            continue
        if nxt == "mark" and _GOES_ON.match(text, close):
            continue
        dots = not strong and (len(run.strip()) > 1 or "…" in run)
        if dots:
            if nxt == "upper" or (spaced and nxt == "other"):
                out.append(close)
            continue
        if strong:
            out.append(close)
            continue
        # one full stop
        kind = abbreviations.get(start)
        if kind == "never":
            continue
        if kind == "number" and nxt == "digit":
            continue
        if kind == "initial" and nxt == "upper":
            before = text[:start - 1].rstrip()[-1:] if start > 1 else ""
            if not before.isdigit():
                continue
        if kind == "maybe" and nxt not in ("upper", "name", "other"):
            continue
        if text[start - 1 : start].isdigit() and nxt == "upper" and MONTHS_BEFORE.search(text[max(0, start - 24) : start].replace("\n", " ")):
            continue
        if nxt == "lower":
            continue
        if nxt == "digit":
            follow = _LETTER.search(text, close)
            if follow and follow.group().islower() and kind is not None:
                continue
        out.append(close)
    k = 0
    for m in _THAI.finditer(text):
        while k < len(enclosed) and enclosed[k][1] <= m.start():
            k += 1
        if k == len(enclosed) or m.start() < enclosed[k][0]:
            out.append(m.start())
    return sorted(set(out))


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and (text[start].isspace() or text[start] in _STRIP):
        start += 1
    while end > start and (text[end - 1].isspace() or text[end - 1] in _STRIP):
        end -= 1
    return start, end


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, scan from) of each block; ``scan from`` is its end for one-unit blocks, else after a list marker."""
    at, n = 0, len(text)
    begin, lines = None, []  # the open paragraph
    item_no = None

    def paragraph():
        return (lines[0][0], lines[-1][1], lines[0][2]) if lines else None

    fence_end = None
    while at < n:
        m = _LINE.match(text, at)
        start, end = m.span()
        at = end
        line = text[start:end]
        bare = line.strip(" \t\r\n﻿")
        fence = _FENCE.match(text, start) if bare[:3] in ("```", "~~~") else None
        if fence:
            if lines:
                yield paragraph()
                lines = []
            mark = fence.group(1)
            close = regex.compile(rf"^[ \t]{{0,3}}{regex.escape(mark[0])}{{{len(mark)},}}[ \t]*\r?$", regex.M).search(text, end)
            fence_end = close.end() if close else n
            yield start, fence_end, fence_end
            at = fence_end
            item_no = None
            continue
        if not bare:
            if lines:
                yield paragraph()
                lines = []
            item_no = None
            continue
        offset = start + (1 if line.startswith("﻿") else 0)
        if _HEADING.match(text, offset):
            if lines:
                yield paragraph()
                lines = []
            yield start, end, end
            item_no = None
            continue
        item = _ITEM.match(text, offset)
        if item:
            number = item.group(2)
            if number is None:
                starts = not lines or item_no is not None or text[lines[-1][0] : lines[-1][1]].rstrip()[-1:] in ".:!?。：！？;"
            elif number.isdigit():
                starts = not lines if item_no is None else int(number) == item_no + 1
                starts = starts or (bool(lines) and item_no is None and int(number) == 1 and text[lines[-1][0] : lines[-1][1]].rstrip()[-1:] in ".:!?。：！？")
            else:
                starts = (not lines and number in "aA") if item_no is None else ord(number) == item_no + 1
            if starts:
                if lines:
                    yield paragraph()
                item_no = 0 if number is None else int(number) if number.isdigit() else ord(number)
                lines = [(start, end, item.end())]
                continue
        lines.append((start, end, start))
    if lines:
        yield paragraph()


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit of a text."""
    if not text:
        return []
    out = []
    names = SIGNALS.union(_INDEXED.findall(text)) if "[" in text else SIGNALS
    for start, end, scan in _blocks(text):
        if scan == end:
            span = _trim(text, start, end)
            if span[0] < span[1]:
                out.append(span)
            continue
        begin = start
        for cut in _breaks(text[scan:end], names):
            span = _trim(text, begin, scan + cut)
            if span[0] < span[1]:
                out.append(span)
            begin = scan + cut
        span = _trim(text, begin, end)
        if span[0] < span[1]:
            out.append(span)
    return out


def split_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every unit of ``docs(doc_id bigint, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, ends = [], [], []

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])
            ids.clear(), starts.clear(), ends.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = units(text)
                ids.extend([doc] * len(found))
                starts.extend(s for s, _ in found)
                ends.extend(e for _, e in found)
                if len(ids) > 50_000:
                    yield batch_of()
        yield batch_of()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, start_char int, end_char int")
