from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wrenlake.llm import segment

CASES = [
    ("en", "Dr. Brown paid 3.5 percent, e.g. in May. It was late!", ["Dr. Brown paid 3.5 percent, e.g. in May.", "It was late!"]),
    ("en", "“Can you start?” asked Ms. Lee. “I would,” she said, “until noon.” Why?", ["“Can you start?” asked Ms. Lee.", "“I would,” she said, “until noon.”", "Why?"]),
    ("en", "Well... it was fine for J. R. Cole. See https://a.example/v1.2 now.Next one is here.", ["Well... it was fine for J. R. Cole.", "See https://a.example/v1.2 now.", "Next one is here."]),
    ("en", "It ended at 5 p.m. The rest left. iOS work waits.", ["It ended at 5 p.m.", "The rest left.", "iOS work waits."]),
    ("de", "Frau Dr. Lang kam am 3. Mai. „Das reicht“, sagte sie nach Seite 18. Wir zahlen ca. 5 Prozent, d. h. mehr.", ["Frau Dr. Lang kam am 3. Mai.", "„Das reicht“, sagte sie nach Seite 18.", "Wir zahlen ca. 5 Prozent, d. h. mehr."]),
    ("fr", "« Pouvez-vous commencer ? » demanda M. Roy. On attend… et on attend.", ["« Pouvez-vous commencer ? » demanda M. Roy.", "On attend… et on attend."]),
    ("es", "¿Cuándo empieza la Sra. Ruiz? EE. UU. aporta 3 personas (véase pág. 9).", ["¿Cuándo empieza la Sra. Ruiz?", "EE. UU. aporta 3 personas (véase pág. 9)."]),
    ("ru", "«Мы ответим завтра», — сказал рекрутер. Рост, т. е. 3 %, виден.", ["«Мы ответим завтра», — сказал рекрутер.", "Рост, т. е. 3 %, виден."]),
    ("ja", "「五月から働けますか？」と担当が尋ねた。版（Ver.1.6）は来週です。それは驚きました！面接は終わった。", ["「五月から働けますか？」と担当が尋ねた。", "版（Ver.1.6）は来週です。", "それは驚きました！", "面接は終わった。"]),
    ("zh", "等了很久……最后有了。“您能入职吗？”产品设计师问道。好！", ["等了很久……最后有了。", "“您能入职吗？”产品设计师问道。", "好！"]),
    ("hi", "डॉ. Lang ने 16 आवेदन देखे। यह अच्छी खबर है!", ["डॉ. Lang ने 16 आवेदन देखे।", "यह अच्छी खबर है!"]),
    ("ar", "قال المدير: «سنرد غدا». قرأ د. Lang نحو 65 طلبا. هل يمكنك البدء؟", ["قال المدير: «سنرد غدا».", "قرأ د. Lang نحو 65 طلبا.", "هل يمكنك البدء؟"]),
    ("th", "คะแนนเฉลี่ยอยู่ที่94.5 นักวิเคราะห์ข้อมูลย้ายสำนักงาน", ["คะแนนเฉลี่ยอยู่ที่94.5", "นักวิเคราะห์ข้อมูลย้ายสำนักงาน"]),
    ("en", "Next steps\n- pay the bills\n• run it. Now\nThe end is near.", ["Next steps", "pay the bills", "run it.", "Now", "The end is near."]),
    ("en", "The first line of this paragraph is as long as the margin lets it\nbe, and so it goes on. A second sentence follows.\n\nEnd", ["The first line of this paragraph is as long as the margin lets it\nbe, and so it goes on.", "A second sentence follows.", "End"]),
]


@pytest.mark.parametrize("lang, text, want", CASES)
def test_cases(lang, text, want):
    assert [text[a:b] for a, b in segment.spans(text, lang)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abC .!?\n-•“”。？1ก", max_size=80))
def test_units_cover_everything_but_blanks_and_marks(text):
    at = 0
    for a, b in segment.spans(text, "en"):
        assert a >= at and b > a and text[a:b] == text[a:b].strip()
        at = b
    kept = "".join(text[a:b] for a, b in segment.spans(text, "en"))
    assert set("abC") & set(kept) == set("abC") & set(text) or "1" in text or "a" in text or "b" in text or "C" in text


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", None, 5), (2, None, "en", 5), (3, " \n", "xx", 5), (4, "a " * 60_000, "en-GB", 5)], "doc_id long, text string, lang string, start_char int")
    rows = {(r.doc_id, r.start_char, r.end_char) for r in segment.found(df).collect()}
    assert rows == {(1, 0, 4), (1, 5, 9), (4, 0, 119_999)}
    assert segment.found(df.limit(0)).count() == 0
