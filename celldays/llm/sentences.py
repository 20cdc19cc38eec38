"""Sentence units of the prose in notebook cells, in whatever language and script it is written.

A cell's lines form blocks: headings, list items, block quotes and paragraphs; fenced code, tables and image lines give none.
Within a block, scripts are treated by what they write:

* Spaced scripts and scripts with end marks: every terminator is a node of a lattice with two states, end and inner.
  Its score comes from the word before (abbreviation lexicon, initials, ordinals), what follows (case, code, digit, symbol) and the
  quotation or bracket it stands in, given where the sentence began; two ends always have a word between them. The best path is found by dynamic programming.
* Spaceless scripts without end marks (Thai, Lao): the runs on both sides of a gap are segmented by a word lattice over a dictionary,
  unknown letters at a cost, and the gap is classified: that such a gap ends a sentence is the prior, a final particle before it or an opening word
  after it confirms, a connector before it (a word that needs a continuation, found behind a known word) or a repetition mark after it overrules. Gaps are nodes of
  the same lattice.
* Spaceless scripts with end marks: as the first, but what follows a closing quotation continues the sentence.

Null and empty texts, null cells and cells of other types give no rows; bounds outside the text are cut to it. Repeated rows give
repeated sentences. Texts of any length are read whole; blocks are independent, so time is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celldays.session import spread

# Abbreviations in lower case, without the last period.
#: before a name or any other word, never at an end
TITLES = set("dr mr mrs ms prof st sr sra srta dra m mm mme mlle rev gen lt sgt mt δρ κ κα डॉ श्री सुश्री د أ م".split())
#: never at an end
INNER = set("e.g i.e vs approx cf al viz resp incl excl ca bzw vgl z.b d.h u.a aprox p.ej env p.ex π.χ βλ т.е т.к см ср им д-р р g.e ebd inkl z d u т д п π χ ej ex".split())
#: before a number or letter
NUMBERED = set("no nos nr fig figs tab tabs eq eqs sec secs app vol vols p pp ch chap art cap pág pag núm num abb abs kap s éq eq рис табл стр гл п εικ πίν σελ सं पृ".split())
#: before a day or year, or in a list of months
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec okt dez mär ene abr ago dic janv févr avr juil déc янв февр апр авг сент окт нояб дек".split())
#: at an end only where a new sentence begins
SOFT = set("etc usw u.s.w a.m p.m am pm т.д т.п др г гг в κ.λπ κλπ inc ltd co jr bc ad".split())
#: words before a German ordinal
BEFORE_ORDINAL = set("am im dem den der vom zum beim ab bis seit jeden jedem jeder".split())
GERMAN_MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez".split())
#: words that open a sentence after a single letter that may be an initial
OPENERS = set("the a an we in on it is if what why who how when where from see read never next note let's don't there this that these those as each nobody cells values column step then our".split())
#: names of columns that may open a sentence in lower case
COLUMNS = set("precip wind_speed tmax tmin rh_max rh_min vpd solar_rad spec_humidity aet pdsi fm100 ffmc dmc dc isi bui fwi erc burn_idx ignition_prob_clim elevation slope aspect_sin aspect_cos".split())
#: Thai and Lao words for the lattice, chosen by hand from everyday vocabulary: final particles and adverbs
FINAL = set("ครับ ค่ะ คะ จ้ะ จ้า นะ เถอะ แล้ว ด้วย เลย ซ้ำ ไหม มั้ย หรือไม่ ทั้งหมด ทั้งสิ้น เท่านั้น แรง ต่อไป อีก เสมอ มาก เช่นกัน ແລ້ວ ເດີ ເນາະ ບໍ່ ນຳ ອີກ".split())
#: connectors and prepositions, which need a continuation
CONNECTORS = set("และ หรือ ของ ใน ที่ ซึ่ง อัน กับ จาก โดย เพื่อ ว่า คือ เป็น ให้ ตาม ต่อ แก่ ระหว่าง เพราะ ถ้า เมื่อ ແລະ ຫຼື ຂອງ ໃນ ທີ່ ກັບ ຈາກ ໂດຍ ເພື່ອ ວ່າ ແມ່ນ ເປັນ ໃຫ້".split())
#: words that open a sentence
OPENING = set("ค่า ตาราง รุ่น เรา ผม ฉัน เขา ผล ผลลัพธ์ ทำไม อย่า ต่อไป ถ้า เมื่อ แต่ ดังนั้น จากนั้น นอกจากนี้ อย่างไรก็ตาม ข้อมูล ไฟล์ กราฟ โปรด กรุณา ทุก แต่ละ ພວກເຮົາ ຖ້າ ເມື່ອ ແຕ່ ດັ່ງນັ້ນ ຈາກນັ້ນ ກະລຸນາ".split())
#: other words, among them common ones that end like a connector
COMMON = set(
    "นี้ นั้น มี แถว หลังจาก ก่อนจาก กรอง ใช้ ไม่ ได้ จะ ก็ ต้อง ขึ้น ลง เพิ่มขึ้น ลดลง ลม ความชื้น กว่า มากกว่า น้อยกว่า ต่ำกว่า สูงกว่า ดีกว่า หน้าต่าง แก้ ปัญหา ขอบ กริด แสดง ภาพ ด้านล่าง ด้านบน ตัด ขาดหาย ออก เข้า อ่าน ก่อน หลัง จึง คำนวณ ค่าเฉลี่ย วาด รายเดือน รายวัน รายปี สุดท้าย แรก "
    "ว่างเปล่า รัน เซลล์ โหลด พื้นที่ หน้าที่ สถานที่ วันที่ จำเป็น เจ้าของ สิ่งของ ภายใน ต่อเนื่อง ทำ ไป มา อยู่ ดู รู้ คิด เห็น บอก เริ่ม จบ หยุด เปลี่ยน ลบ เก็บ เขียน ตรวจ สร้าง พบ วัน เดือน ปี คน ฝน ไฟ ป่า น้ำ ดิน อากาศ อุณหภูมิ จำนวน ใหม่ เก่า ใหญ่ เล็ก สูง ต่ำ ดี งาน ระบบ ตัวอย่าง วิธี การ ความ "
    "ຂໍ້ມູນ ຕາຕະລາງ ມີ ແຖວ ໃຊ້ ໄດ້ ຈະ ຕ້ອງ ອ່ານ ໄຟລ໌ ຄ່າ ນີ້ ນັ້ນ".split()
)
WORDS = FINAL | CONNECTORS | OPENING | COMMON
LONGEST = max(map(len, WORDS))
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
CLOSE = set(")]}）】」』》〉”“»›’\"'")
BRACKETS = set(")]}）】")

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"[ ]{0,3}#{1,6}(?=[ \t]|$)[ \t]*")
BULLET = re.compile(r"[ \t]*[-*+•][ \t]+")
ORDERED = re.compile(r"[ \t]*(\d{1,9})[.)][ \t]+")
QUOTE = re.compile(r"[ ]{0,3}>[ \t]?")
IMAGE = re.compile(r"[ \t]*(?:!\[[^\]]*\]\([^\s)]*\)?\s*$|<img\b)")
RULE = re.compile(r"[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|=+)\s*$")
MARK = re.compile(r"[.!?…。！？｡।॥؟۔።፧፨။។៕།༎;\u037e]+")
OWN_MARK = re.compile(r"[。！？｡।॥؟۔።፧፨။។៕།༎]")
SPAN = re.compile(r"[`$()\[\]{}（）【】「」『』《》〈〉“”„«»‹›\"]")
GAP = re.compile(r"(?<=[ก-໿])[ \t ]+(?=[ก-໿])")
RUN = re.compile(r"[ก-໿]+")
WORD = re.compile(r"\w")
BEFORE = re.compile(r"[^\s()\[\]{}\"“”„«»‘’（）]+$")
SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
OPEN = re.compile(r"[\"“„«‹‘'¿¡(\[\s]*")
NAME = re.compile(r"[^\W\d][\w.]*(\()?")
LOST = re.compile(r"[A-Z][a-z]*(?=[\s,])")
SMALL = re.compile(r"[a-z]{3}$")
GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the prose blocks of one cell, markup before them left out."""
    begin = end = -1
    kind, fence = "", ""
    for m in LINE.finditer(text):
        line, at = m.group(), m.start()
        if not line:
            break
        if fence:
            t = line.strip()
            if len(t) >= len(fence) and not t.strip(fence[0]):
                fence = ""
            continue
        f = FENCE.match(line)
        other = bool(f) or line.isspace() or line.lstrip(" \t").startswith("|") or bool(IMAGE.match(line)) or bool(RULE.match(line))
        head = None if other else HEADING.match(line)
        item = None if other or head else BULLET.match(line) or ORDERED.match(line)
        if item and kind == "text" and item.lastindex and item.group(1) != "1":
            item = None  # a wrapped line that begins with a number
        quote = None if other or head or item else QUOTE.match(line)
        new = other or head or item or (quote and kind != "quote")
        if new and begin >= 0:
            yield begin, end
            begin = -1
        if other:
            fence, kind = (f.group(1) if f else ""), ""
            continue
        mark = head or item or quote
        if begin < 0:
            begin = at + (mark.end() if mark else 0)
            kind = "head" if head else "item" if item else "quote" if quote else "text"
        end = m.end()
        if kind == "head":
            yield -begin - 1, end  # a heading is one sentence, marked by the sign
            begin, kind = -1, ""
    if begin >= 0:
        yield begin, end


def spans(t: str) -> list[tuple[int, int]]:
    """Matched quotations, brackets, code and formulas as (open, close) positions; what is never closed counts for nothing."""
    out, stack, skip = [], [], -1
    for m in SPAN.finditer(t):
        c, i = m.group(), m.start()
        if i <= skip:
            continue
        if c in "`$":
            end = t.find(c, i + 1)
            if end > 0 and (c == "`" or not t[i + 1].isspace() and not t[end - 1].isspace()):
                out.append((i, end))
                skip = end
            continue
        held = [k for k, (o, _) in enumerate(stack) if (PAIRS.get(o) or o) == c]
        if c == '"':
            before = t[i - 1] if i else " "
            opens = (before.isspace() or before in "([{（「:：") and i + 1 < len(t) and not t[i + 1].isspace() or not held and SPACELESS.match(before)
            if opens:
                stack = [x for x in stack if x[0] != '"']
                stack.append((c, i))
                continue
        if held:
            out.append((stack[held[-1]][1], i))
            del stack[held[-1] :]
        elif c in PAIRS:
            stack.append((c, i))
    return out


def starts_new(t: str, i: int) -> bool | None:
    """Whether what stands at i looks like the first word of a sentence; None where the script has no case."""
    i = OPEN.match(t, i).end()
    if i >= len(t):
        return True
    c = t[i]
    if c.isdigit() or c in "`$":
        return True
    kind = unicodedata.category(c)
    if kind in ("Lu", "Lt"):
        return True
    if kind == "Ll":
        m = NAME.match(t, i)
        w = m.group().rstrip("(.")
        return bool(m.group(1)) or w in COLUMNS or "_" in w or any(x.isdigit() for x in w)
    if kind == "So" or "\U0001f000" <= c <= "\U0001faff":
        return True
    return None if kind in ("Lo", "Mn", "Mc", "Lm") else False


def word_lattice(run: str) -> list[str]:
    """Cheapest path of dictionary words (cost 1) and unknown letters (cost 1.5 each) through a run without spaces."""
    n, cost, back = len(run), [0.0] + [1e9] * len(run), [0] * (len(run) + 1)
    for i in range(n):
        if cost[i] + 1.5 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 1.5, i
        for k in range(2, min(LONGEST, n - i) + 1):
            if run[i : i + k] in WORDS and cost[i] + 1 < cost[i + k]:
                cost[i + k], back[i + k] = cost[i] + 1, i
    out, i = [], n
    while i:
        out.append(run[back[i] : i])
        i = back[i]
    return out[::-1]


def run_before(t: str, at: int) -> str:
    """The whole run of Thai or Lao letters that ends at a place."""
    i = at
    while i and "ก" <= t[i - 1] <= "໿":
        i -= 1
    return t[i:at]


@lru_cache(maxsize=4096)
def run_ends(run: str) -> tuple[str, str, bool]:
    """First and last word of a run by its lattice, and whether the word before the last is known (or there is none)."""
    words = word_lattice(run)
    return words[0], words[-1], len(words) < 2 or words[-2] in WORDS


def gap_score(before: str, after: str) -> float:
    """Score of a gap between two runs of a script without end marks; above 0 it ends a sentence.

    That it does is the prior (1). A connector counts behind a known word only, as it may else be the end of a word that the dictionary lacks.
    """
    if after[0] in "ๆฯໆຯ":  # repetition and abbreviation marks stand after a space
        return -3.0
    _, last, known = run_ends(before)
    first = run_ends(after)[0]
    return 1.0 + 2.0 * (last in FINAL) + (first in OPENING) - 3.0 * (last in CONNECTORS and known)


def mark_score(t: str, m: re.Match, within: list[tuple[int, int]], closes: dict[int, int], low: int) -> tuple[float, int]:
    """(score, end) of one terminator run: above 0 it may end the sentence that began at ``low``, closing marks included."""
    p, r, run, n = m.start(), m.end(), m.group(), len(t)
    own, ask = bool(OWN_MARK.search(run)), "?" in run or "!" in run
    opened = []
    while r < n:  # closing marks, also those a script sets off by a space («  »)
        if r in closes:
            opened.append(closes[r])
            r += 1
        elif t[r].isspace() and t[r + 1 : r + 2] in ("»", "›") and r + 1 in closes:
            opened.append(closes[r + 1])
            r += 2
        elif t[r] in CLOSE and t[r] not in '"“':
            r += 1
        else:
            break
    if any(o < p and c >= r for o, c in within):
        return -9.0, r
    if not t[r:].strip():
        return 9.0, r
    glued = not t[r].isspace()
    if glued and not (own or ask and SPACELESS.match(t, r)):
        # a lost space: a word of small letters, one mark, a capitalised word
        if len(run) == 1 and not opened and r == m.end() and LOST.match(t, r) and SMALL.search(t, max(low, p - 3), p):
            return (4.0 if ask else word_score(t, p, r, low, True)), r
        return -9.0, r
    if set(run) <= {";", "\u037e"}:
        return (3.0 if GREEK.search(t, low, p) and not opened else -9.0), r
    new = starts_new(t, r)
    if opened and t[r - 1] in BRACKETS:
        if not WORD.search(t, low, min(opened)):
            return 3.0, r  # the whole sentence is bracketed
        if not new or glued:
            return -3.0, r
    elif opened:  # a quotation ends the sentence around it only where a new one begins
        return (3.0 if new and not glued else -3.0), r
    if own or ask:
        return 4.0, r
    if "…" in run or len(run) > 1:
        return (3.0 if new else -3.0), r
    return word_score(t, p, r, low, new), r


def word_score(t: str, p: int, r: int, low: int, new: bool | None) -> float:
    """Score of a single period at p by the word before it; new tells whether a sentence seems to begin at r."""
    w = BEFORE.search(t, max(low, p - 40), p)
    if not w:
        return 3.0
    word = re.split(r"[/'’]", w.group().lstrip("¿¡*_"))[-1]
    bare, upper = word.lower(), word[:1].isupper()
    m = NAME.match(t, OPEN.match(t, r).end())
    then = m.group().rstrip("(.") if m else ""
    if bare in SOFT or bare in ("д", "п") and re.search(r"т\.\s*$", t[low : w.start()]):
        return 2.0 if new else -3.0
    if bare in TITLES and (upper or not word[:1].islower()):
        return -4.0
    if bare in NUMBERED:
        x = OPEN.match(t, r).end()
        return -4.0 if t[x : x + 1].isdigit() or not new or len(then.split(".")[0]) == 1 else 1.0
    if bare in INNER or bare in MONTHS and (upper or not new):
        return -4.0
    if len(bare) == 1 and bare.isalpha():
        if "\u0600" <= bare <= "\u06ff":
            return -4.0
        if upper:  # an initial, unless a word follows that opens sentences
            return 1.0 if then.lower() in OPENERS and m.group() == then or new and not then else -3.0
        return 2.0 if new else -2.0
    if bare.isdigit() and len(bare) <= 2 and then:  # ordinals
        k = w.start()
        while k > low and t[k - 1].isspace():
            k -= 1
        prev = BEFORE.search(t, max(low, k - 24), k)
        if prev and prev.group().lower() in BEFORE_ORDINAL or then.lower() in GERMAN_MONTHS and then[0].isupper():
            return -3.0
    return 3.0


def best_path(t: str, nodes: list[tuple[int, re.Match | None, re.Match | None]]) -> list[int]:
    """Ends of the sentences of one block: the path of the greatest total score through the lattice of possible ends.

    A path takes nodes of positive score only, and between two of its ends stands a word. A node's score depends on where its sentence began, so every end
    before it that could still lead to a better total is tried, the latest first; of equal paths the one with the later ends is taken.
    """
    within = spans(t)
    closes = {c: o for o, c in within}
    ends: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # total, end, place of the end before; the first is the block's begin
    top = [0.0]  # the best total up to each place
    for at, gap, mark in nodes:
        best = None
        if gap:
            score, end = (-9.0 if any(o < at < c for o, c in within) else gap_score(run_before(t, at), RUN.match(t, gap.end()).group())), at
            limit = score
        else:
            limit = 4.0 if t[mark.end() :].strip() else 9.0
        for i in range(len(ends) - 1, -1, -1):
            total, low, _ = ends[i]
            if best and top[i] + limit <= best[0]:
                break
            if best and total + limit <= best[0]:
                continue
            if mark:
                score, end = mark_score(t, mark, within, closes, low)
            if score > 0 and (best is None or total + score > best[0]) and WORD.search(t, low, end):
                best = (total + score, end, i)
            if gap and score <= 0:
                break
        if best:
            ends.append(best)
            top.append(max(top[-1], best[0]))
    place = max(range(len(ends)), key=lambda i: (ends[i][0], i))
    out = []
    while place > 0:
        out.append(ends[place][1])
        place = ends[place][2]
    return out[::-1]


def segment(t: str) -> list[tuple[int, int]]:
    """Bounds of the sentences of one block."""
    nodes = [(m.start(), None, m) for m in MARK.finditer(t)]
    if GAP.search(t):
        nodes = sorted([*nodes, *((m.start(), m, None) for m in GAP.finditer(t))], key=lambda x: x[0])
    cuts = best_path(t, nodes) if nodes else []
    out, begin = [], 0
    for end in [*cuts, len(t)]:
        piece = t[begin:end]
        body = piece.strip()
        if body and (WORD.search(body) or any(unicodedata.category(c) == "So" for c in body)):
            a = begin + len(piece) - len(piece.lstrip())
            out.append((a, a + len(body)))
        elif body and out:  # marks without a word stay with the sentence before
            out[-1] = (out[-1][0], begin + len(piece.rstrip()))
        begin = end
    return out


def sentences(text: str, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """Bounds in text of the sentences of the cell text[begin:end]."""
    begin, end = max(0, begin), min(len(text), end)
    body = text[begin:end]
    for a, b in blocks(body):
        if a < 0:
            a = -a - 1
            piece = body[a:b]
            x = piece.strip()
            if x:
                s = begin + a + len(piece) - len(piece.lstrip())
                yield s, s + len(x)
            continue
        for s, e in segment(body[a:b]):
            yield begin + a + s, begin + a + e


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, first, last = [], [], []
        for i, (text, starts, ends) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
            for s, e in zip(starts or (), ends or (), strict=True):
                if s is None or e is None:
                    continue
                for x, y in sentences(text, s, e):
                    ids.append(i)
                    first.append(x)
                    last.append(y)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["id", "start_pos", "end_pos"])


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_col: str = "cells", cell_type: str = "markdown") -> DataFrame:
    """(id_col, start_pos, end_pos): one row per sentence; offsets are code points of the text, the end exclusive."""
    own = F.filter(cells_col, lambda c: c["cell_type"] == cell_type)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.transform(own, lambda c: c["start_pos"]).alias("starts"), F.transform(own, lambda c: c["end_pos"]).alias("ends"))
    kind = rows.schema["id"].dataType.simpleString()
    out = spread(rows).where("text is not null and size(starts) > 0").mapInArrow(_run, f"id {kind}, start_pos int, end_pos int")
    return out.withColumnRenamed("id", id_col)
