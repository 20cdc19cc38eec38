import random
from itertools import product

import pytest

import celldays.llm.sentences as module
from celldays.llm.sentences import MARK, WORD, best_path, mark_score, run_ends, sentence_units, sentences, spans


def cut(text):
    return [text[a:b] for a, b in sentences(text, 0, len(text))]


CASES = {
    "abbreviations": ("Dr. A. Moss saw it, e.g. at 3.5 mm. See Fig. 3 and Sec. 2.1. Next.", ["Dr. A. Moss saw it, e.g. at 3.5 mm.", "See Fig. 3 and Sec. 2.1.", "Next."]),
    "lower_case_openers": ("It is 3 p.m. plot() draws it. fwi is low. At 3 a.m. we stop.", ["It is 3 p.m.", "plot() draws it.", "fwi is low.", "At 3 a.m. we stop."]),
    "quotation": ('He says "It drifts. It stops." and left. The log says: "No." Why?', ['He says "It drifts. It stops." and left.', 'The log says: "No."', "Why?"]),
    "brackets": ("(One is late.) plot() waits (see Tab. 4). Done", ["(One is late.)", "plot() waits (see Tab. 4).", "Done"]),
    "ellipsis": ("Wait ... the rest. It falls… Then it ends. Hmm… no.", ["Wait ... the rest.", "It falls…", "Then it ends.", "Hmm… no."]),
    "german": ("Am 24. Mai, z. B. im Lauf Nr. 5, d. h. bald. „Leer. Neu.“ steht da. Seit dem 3. Okt. ruht es.", ["Am 24. Mai, z. B. im Lauf Nr. 5, d. h. bald.", "„Leer. Neu.“ steht da.", "Seit dem 3. Okt. ruht es."]),
    "russian": ("Порог, т. е. почти, и т. д. См. рис. 3. К 5 мая 2020 г. всё.", ["Порог, т. е. почти, и т. д.", "См. рис. 3.", "К 5 мая 2020 г. всё."]),
    "greek": ("Γιατί λείπει το a.md; Βλ. εικ. 3.", ["Γιατί λείπει το a.md;", "Βλ. εικ. 3."]),
    "chinese": ("他说：“没有。请等。”然后停了。“真的吗？”她问。", ["他说：“没有。请等。”然后停了。", "“真的吗？”她问。"]),
    "japanese": ("ログ「なし。再読。」と出る。えっ…値が同じ！次", ["ログ「なし。再読。」と出る。", "えっ…値が同じ！", "次"]),
    "thai": ("ผลลัพธ์แสดง ตารางมี 5 แถว อย่ารันซ้ำ", ["ผลลัพธ์แสดง", "ตารางมี 5 แถว", "อย่ารันซ้ำ"]),
    "thai_connector": ("เราใช้ข้อมูลของ ตารางนี้ อย่ารันซ้ำ", ["เราใช้ข้อมูลของ ตารางนี้", "อย่ารันซ้ำ"]),
    "thai_unknown_word_like_a_connector": ("ดูฌฌที่ ตารางนี้", ["ดูฌฌที่", "ตารางนี้"]),
    "thai_word_that_ends_like_a_connector": ("ดูพื้นที่ อ่านเจ้าของ ลบ", ["ดูพื้นที่", "อ่านเจ้าของ", "ลบ"]),
    "lao": ("ພວກເຮົາອ່ານຂໍ້ມູນ ໃຊ້ຕາຕະລາງຂອງ ໄຟລ໌ນີ້", ["ພວກເຮົາອ່ານຂໍ້ມູນ", "ໃຊ້ຕາຕະລາງຂອງ ໄຟລ໌ນີ້"]),
    "tibetan": ("ཀ་ཁ། ག་ང་།ཅ", ["ཀ་ཁ།", "ག་ང་།", "ཅ"]),
    "thai_repeat": ("ดีมาก ๆ ต่อไป", ["ดีมาก ๆ", "ต่อไป"]),
    "hindi": ('डॉ. व ने कहा, "नहीं है। फिर करें।" और रुका। बस', ['डॉ. व ने कहा, "नहीं है। फिर करें।" और रुका।', "बस"]),
    "blocks": ("# A. B\r\n\r\n1. one\r\n2. two. Three\n\n> said. Done\n\n| a. | b |\n|---|---|\n\n```python\nx = 1. Y\n```\n![p](data:x)\nA line\nbreaks. On", ["A. B", "one", "two.", "Three", "said.", "Done", "A line\nbreaks.", "On"]),
    "marks_only": ("... !\n\n—", []),
    "unclosed": ('A "quote that. Goes on. Ever', ['A "quote that.', "Goes on.", "Ever"]),
    "code": ("Use `is_ok? No. Yes` here. $p < .5. X$ is it.", ["Use `is_ok? No. Yes` here.", "$p < .5. X$ is it."]),
    "lost_space": ("It is half-empty.From here on. See a.Md now and v3.A b.", ["It is half-empty.", "From here on.", "See a.Md now and v3.A b."]),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert cut(text) == want


def test_the_classes_decide(monkeypatch):
    text, want = CASES["thai_connector"]
    monkeypatch.setattr(module, "gap_score", lambda before, after: 2.0)
    assert cut(text) != want
    monkeypatch.undo()
    monkeypatch.setattr(module, "word_lattice", list)  # letters instead of words
    run_ends.cache_clear()
    assert cut(text) != want
    monkeypatch.undo()
    run_ends.cache_clear()
    assert cut(text) == want


def every_path(t):
    """Best total by trying every subset of the nodes."""
    marks = list(MARK.finditer(t))
    within = spans(t)
    best = 0.0
    for chosen in product((False, True), repeat=len(marks)):
        total, low = 0.0, 0
        for m, c in zip(marks, chosen):
            if c:
                score, end = mark_score(t, m, within, {y: x for x, y in within}, low)
                if score <= 0 or not WORD.search(t, low, end):
                    break
                total, low = total + score, end
        else:
            best = max(best, total)
    return best


def test_the_path_is_the_best():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice(["Dr. ", "a", "B ", ". ", "? ", "! ", "... ", "(", ") ", '"', "Fig. 2 ", "etc. ", "plot() ", "It ", "。"]) for _ in range(14))
        marks = [(m.start(), None, m) for m in MARK.finditer(t)]
        within, total, low = spans(t), 0.0, 0
        for end in best_path(t, marks) if marks else []:
            total += max(s for m in MARK.finditer(t) if m.start() >= low for s, e in [mark_score(t, m, within, {y: x for x, y in within}, low)] if e == end)
            low = end
        assert abs(total - every_path(t)) < 1e-9, t


def test_rows(spark):
    cell = "cells array<struct<cell_no:int,cell_type:string,exec_count:int,start_pos:int,end_pos:int>>"
    text = "# %% [markdown]\n👩‍🚒 One. Two.\n# %% [code]\nx. Y."
    rows = [(1, text, [(0, "markdown", None, 16, 30), (1, "code", None, 43, 48)], "a"), (2, None, None, "b"), (3, "", [], "c"), (4, "A. B", None, "d"), (5, "One. Two", [(0, "markdown", None, None, 3), (1, "markdown", None, -5, 99)], "e"), (None, "Hi.", [(0, "markdown", None, 0, 3)], "f")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {cell}, starts string")
    got = sorted((r[0] or 0, r[1], r[2]) for r in sentence_units(df).collect())
    assert got == [(0, 0, 3), (1, 16, 24), (1, 25, 29), (5, 0, 4), (5, 5, 8)]
    assert sentence_units(df.limit(0)).count() == 0
