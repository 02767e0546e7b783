"""Sentence boundaries by cascading tables of break and no-break rules.

A rule is a pair of patterns, one for the text before a position and one for the text after it, with a
decision. For each candidate position the tables of its language are asked in order, then those of its
script, then the general one; the first rule that matches decides. Before that, lines become blocks:
headings and list items are blocks of their own, hard-wrapped lines are joined again.

Each document is handled alone in an Arrow batch; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK, JOIN = True, False
CLOSE = "\"'”’»›)\\]}」』】〉》“‘"
OPEN = "\"'“‘„‚«‹(\\[{¿¡「『"

# Abbreviations that a name, a figure or the rest of a phrase follows, by language.
ABBREVIATIONS = {
    "en": r"mr|mrs|ms|messrs|dr|prof|st|mt|ft|rev|hon|gen|col|capt|lt|sgt|sen|rep|gov|pres|e\.\s?g|i\.\s?e|cf|viz|vs|v|approx|ca|no|nos|fig|figs|p|pp|vol|ch|sec|art|eq|ed|eds|min|max|est|dept|tel|ext|incl|excl|misc|avg|resp|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec|mon|tue|wed|thu|fri",
    "de": r"hr|hrn|fr|frl|dr|prof|st|str|nr|abs|art|abt|abb|bd|bzw|ca|d\.\s?h|z\.\s?b|u\.\s?a|u\.\s?u|o\.\s?ä|i\.\s?d\.\s?r|i\.\s?a|v\.\s?a|s\.\s?o|s\.\s?u|vgl|s|ff|f|evtl|ggf|inkl|exkl|max|min|mind|sog|tel|usf|mio|mrd|dipl|ing|geb|gest|jan|feb|mär|apr|jun|jul|aug|sept?|okt|nov|dez|mo|di|mi|do|sa|so|z|d|u|i",
    "fr": r"m|mm|mme|mmes|mlle|mlles|me|dr|pr|st|ste|p\.\s?ex|c\.-?à-?d|cf|art|p|pp|n|no|nos|vol|chap|fig|env|éd|réf|tél|av|bd|boul|janv|févr|avr|juil|sept|oct|nov|déc|max|min|ex",
    "es": r"sr|sra|srta|sres|d|dña|dr|dra|prof|profa|ing|lic|arq|p\.\s?ej|ej|art|arts|pág|págs|p|pp|núm|n|no|vol|cap|fig|aprox|máx|mín|av|avda|c|tel|ext|ee|uu|ss|aa|ud|uds|vd|vds|gral|dto|dpto|ene|feb|mar|abr|may|jun|jul|ago|sept?|oct|nov|dic",
    "ru": r"т|г|гг|в|вв|д|п|пп|ст|стр|с|рис|табл|гл|им|ул|пр|пл|кв|корп|оф|р|руб|коп|тыс|млн|млрд|см|ср|напр|др|пр|проф|акад|доц|инж|тел|янв|февр|мар|апр|авг|сент|окт|нояб|дек|ок|мин|макс|т\.\s?е|т\.\s?к|т\.\s?д|т\.\s?п|т\.\s?н|и\.\s?о",
    "hi": r"डॉ|डा|श्री|श्रीमती|प्रो|पं|सु|कु|रु|नं|पृ|ई|बी|एम|ए",
    "ar": r"د|أ|م|ص|ج|ت|هـ|ق\.\s?م|أ\.\s?د|إلخ|رقم",
}
#: abbreviations that can also end a sentence: a capital after them breaks
ENDING = {
    "en": r"inc|ltd|corp|co|llc|bros|jr|sr|plc|etc|a\.\s?m|p\.\s?m|u\.\s?s|u\.\s?k|u\.\s?s\.\s?a|e\.\s?u|d\.\s?c|ph\.\s?d|b\.\s?a|m\.\s?a",
    "de": r"usw|etc|gmbh|co|ag|u\.\s?v\.\s?m|u\.\s?ä|jh|jhd|std|uhr",
    "fr": r"etc|cie|s\.\s?a|apr|j\.-?c",
    "es": r"etc|cía|s\.\s?a|s\.\s?l|a\.\s?m|p\.\s?m|a\.\s?c|d\.\s?c|ee\.\s?uu|ss\.\s?aa",
    "ru": r"и т\.\s?д|и т\.\s?п|и др|и пр|г|гг|в|вв|руб|коп|тыс|млн|млрд|мин|ч",
}
# Verbs that attribute a quotation, for names between the quotation and the verb.
SAYING = {
    "en": r"said|says|asked|asks|replied|replies|wrote|writes|added|adds|answered|explained|noted|told|insisted|recalled|admitted|joked|warned",
    "de": r"sagte|sagt|fragte|fragt|antwortete|meinte|schrieb|erklärte|ergänzte|rief|betonte",
    "fr": r"dit|demande|demanda|répond|répondit|écrit|écrivit|explique|expliqua|ajoute|ajouta",
    "es": r"dijo|dice|preguntó|pregunta|respondió|responde|escribió|explicó|añadió|comentó",
    "ru": r"сказал[аи]?|спросил[аи]?|ответил[аи]?|написал[аи]?|добавил[аи]?|пояснил[аи]?",
}
MONTHS_DE = r"Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sept|Okt|Nov|Dez"


def _rule(decision: bool, before: str, after: str) -> tuple[bool, re.Pattern, re.Pattern]:
    return decision, re.compile(f"(?:{before})$"), re.compile(after)


def _latin(lang: str) -> list[tuple]:
    """The table of a language with capitals and full stops."""
    abbr, ending, saying = ABBREVIATIONS[lang], ENDING[lang], SAYING[lang]
    start = rf"\s+[{OPEN}–—-]*\s?(?:[^\W\d_])"
    return [
        # the attribution after a closed quotation belongs to its sentence
        _rule(JOIN, rf"[!?…]\s?[{CLOSE}]+", rf"\s*[,–—-]*\s*(?:(?:[^\W\d_][\w.’'-]*)\s+){{0,5}}(?:{saying})\b"),
        _rule(JOIN, rf"[.!?…]\s?[{CLOSE}]+\s?[,;–—-]", r""),
        # abbreviations that may end a sentence: by what follows
        _rule(JOIN, rf"(?i:(?<!\w)(?:{ending}))\.", r"\s+[a-zß-ÿа-я\d(,;]"),
        _rule(BREAK, rf"(?i:(?<!\w)(?:{ending}))\.[{CLOSE}]*", start),
        # an initial before a name
        _rule(JOIN, r"(?:^|[\s(“\"„«‹.\-])[A-ZÀ-ÞА-Я]\.", r"\s*[^\W\d_]"),
        # abbreviations that something follows
        _rule(JOIN, rf"(?i:(?<!\w)(?:{abbr}))\.", r"\s*\S"),
    ]


TABLES: dict[str, list[tuple]] = {
    "en": [_rule(JOIN, r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\.", r"\s+\d{1,2}\b(?![\d:])"), *_latin("en")],
    "de": [
        # ordinals: a day before its month, a number after an article or preposition
        _rule(JOIN, r"(?<![\d.,])\d{1,2}\.", rf"\s+(?:{MONTHS_DE}|Quartal|Stock|Etage|Jahrhundert|Jahr|Mal|Platz|Halbjahr|Woche|Tag|Runde|Auflage|Kapitel)\b"),
        _rule(JOIN, r"(?i:\b(?:am|dem|den|der|die|das|des|im|zum|vom|beim|bis|ab|seit|nach dem|vor dem|jede[nmrs]?|zur))\s+\d{1,2}\.", r"\s+\w"),
        *_latin("de"),
    ],
    "fr": [_rule(JOIN, r"[.!?…]\s?»", r"\s+[a-zß-ÿ]"), *_latin("fr")],
    "es": _latin("es"),
    "ru": [_rule(JOIN, r"[.!?…][»“\"]", r"\s*,?\s*[—–-]"), *_latin("ru")],
    "hi": [_rule(JOIN, rf"(?<!\w)(?:{ABBREVIATIONS['hi']})\.", r""), _rule(BREAK, rf"[।॥]+[{CLOSE}]*", r"")],
    "ar": [_rule(JOIN, rf"(?<!\w)(?:{ABBREVIATIONS['ar']})\.", r"\s*\S"), _rule(BREAK, rf"(?:[.!؟?]+[{CLOSE}]*|[«»][.!؟?]+)", r"\s+\S")],
    "th": [
        _rule(JOIN, r"[ๆฯ]", r"\s"),
        _rule(JOIN, r"(?<![฀-๿])[฀-๿]{1,2}\.", r"\s"),
        _rule(BREAK, r"[฀-๿\d][.!?”’\")\]]*", r"\s+[“‘\"(]?[฀-๿]"),
    ],
    "cjk": [
        # a closed quotation and the words that report it
        _rule(JOIN, r"[。！？!?…．][」』”’\")）】》]+", r"\s*[とのをがはもにでへやかなだって、，,]"),
        _rule(JOIN, r"[。！？!?…．][」』”’\")）】》]+", r"[^。！？!?\n「『“]{0,14}?(?:说|道|问|答|表示|写|回复|指出|認|言|述べ|尋ね|答え|語)"),
        _rule(JOIN, r"(?:…|\.\.\.|⋯)+", r"[^\s”’」』）)]"),
        _rule(BREAK, r"[。！？!?．]+[」』”’\")）】》]*", r""),
    ],
    # what holds in any language written in Latin letters, also where the language was told wrongly
    "latin": [
        _rule(JOIN, r"(?i:(?<!\w)(?:mr|mrs|ms|dr|prof|hr|mme|mlle|sr|sra|srta|st))\.", r"\s+[A-ZÀ-Þ]"),
        _rule(JOIN, r"(?i:(?<!\w)(?:approx|ca|env|aprox|circa|no|nos|nr|núm|p|pp|pág|págs|pag|s|vol|fig|figs|art|abs|cf|min|max|vs))\.", r"\s+v?\d"),
        _rule(JOIN, r"(?i:(?<!\w)(?:approx|aprox|bzw|vgl|incl|inkl|excl|exkl|resp|dept|evtl|ggf|sog|núm|véase|pág|págs))\.", r"\s*\S"),
        _rule(JOIN, r"(?i:(?<!\w)(?:e\.\s?g|i\.\s?e|z\.\s?b|d\.\s?h|p\.\s?ex|p\.\s?ej))\.", r"\s+\S"),
    ],
    # scripts without a table of their own, and what no table above decides
    "general": [
        # within words, figures, addresses: decimals, versions, hosts
        _rule(JOIN, r"\w[.!?]", r"[\d_/@]"),
        _rule(JOIN, r"[.?!]", r"[^\s" + CLOSE + r"A-ZÀ-ÞА-Я“«„¿¡\"]"),
        _rule(JOIN, r"[.?!]", r"[A-ZÀ-ÞА-Я][.A-ZÀ-ÞА-Я\d]"),
        # dots that trail off before a small letter, names such as iOS excepted
        _rule(BREAK, rf"[.!?…]+\s?[{CLOSE}]*", r"\s+[a-z]{1,2}[A-Z]\w"),
        # a whole word and its full stop end a sentence also where the next one begins small
        _rule(BREAK, r"[^\W\d_]{4}\.", r"\s+[a-zß-ÿа-я]"),
        _rule(JOIN, rf"(?:\.\.\.|…|\.)\s?[{CLOSE}]*", rf"\s+[{OPEN}]?[a-zß-ÿа-я]"),
        _rule(JOIN, rf"[!?]+\s?[{CLOSE}]+", r"\s*[a-zß-ÿа-я]"),
        _rule(JOIN, r"(?:…|\.\.\.)", r"[^\sA-ZÀ-ÞА-Я“«„¿¡]"),
        # no blank after the mark
        _rule(BREAK, r"[^\W\d_]{2}\s?[.!?…]+", r"[“«„¿¡\"]?[A-ZÀ-ÞА-Я][a-zß-ÿа-я’']|[“«„¿¡\"]?[A-ZÀ-ÞА-Я]\s"),
        _rule(BREAK, rf"[.!?…؟]+\s?[{CLOSE}]*|[。！？।॥][{CLOSE}]*", r"\s+\S|$"),
        _rule(BREAK, rf"[)\d%][.!?]+[{CLOSE}]*", r"[A-ZÀ-ÞА-Я][a-zß-ÿа-я]"),
        _rule(JOIN, r"", r""),
    ],
}
#: positions at which anything can be decided
_MARKS = r"(?:[。！？．]+|[.!?…؟।॥⋯]+)"
_CANDIDATE = re.compile(rf"{_MARKS}(?:(?:\s(?=[»]))?[\"'”’»›)\]}}」』】〉》）])*")
#: where quotations close with the mark that opens them elsewhere
_CANDIDATE_LOW = re.compile(rf"{_MARKS}(?:[{CLOSE}）])*")
_THAI_SPACE = re.compile(r"(?<=[฀-๿\d.!?”’\")\]])(?=\s+[“‘\"(]?[฀-๿])")
_BULLET = re.compile(r"\s*(?:[•*▪◦‣·●○■□–—⁃∙・-]|\(?\d{1,2}[.)、]|\(?[a-zA-Z][)]|（\d{1,2}）)(?:\s+|(?<=、))(?=\S)")
_TERMINAL = re.compile(rf"[.!?…؟。！？．।॥:：][{CLOSE}）]*\s*$")
_SCRIPTS = (
    ("th", re.compile(r"[฀-๿]")),
    ("hi", re.compile(r"[ऀ-ॿ]")),
    ("ar", re.compile(r"[؀-ۿ]")),
    ("cjk", re.compile(r"[぀-ヿ㐀-鿿]")),
    ("ru", re.compile(r"[Ѐ-ӿ]")),
)
# A few words by which the language of a passage in Latin letters is told.
_HINTS = {
    "en": "the and of is was with for that are you we this from not",
    "de": "der die das und ist mit für nicht ein eine wir sie dem den von auf im",
    "fr": "le la les des et est pour dans une un nous vous sur avec du au pas",
    "es": "el la los las y es de por con para una se del al lo que",
}
_OF_WORD = {w: [k for k, ws in _HINTS.items() if w in ws.split()] for ws in _HINTS.values() for w in ws.split()}
_WORD = re.compile(r"\w+")
_ELISION = re.compile(r"\b[ldj]’", re.I)
_OTHER_SCRIPT = re.compile(r"[Ѐ-ӿ\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")


def tables_of(text: str, lang: str) -> list[list[tuple]]:
    """The cascade for a block: its script's or language's table, then the general one."""
    mixed = not text.isascii() and _OTHER_SCRIPT.search(text) is not None
    if mixed:
        letters = sum(map(str.isalpha, text)) or 1
        for name, script in _SCRIPTS:
            if len(script.findall(text)) >= max(1, 0.3 * letters):
                return [TABLES[name], TABLES["general"]]
    votes = {k: 0.5 if k == lang else 0.0 for k in _HINTS}
    for w in _WORD.findall(text.lower()):
        for k in _OF_WORD.get(w, ()):
            votes[k] += 1
    if "’" in text:
        votes["fr"] += len(_ELISION.findall(text))
    best = max(votes, key=lambda k: (votes[k], k == "en"))
    first = best if votes[best] > 0 else "en"
    out = [TABLES[first], TABLES["latin"]]
    if mixed:
        out += [TABLES[name] for name, script in _SCRIPTS if script.search(text)]
    return [*out, TABLES["general"]]


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of blocks: a heading, a list item without its mark, or lines that run on."""
    out: list[tuple[int, int]] = []
    lines: list[tuple[int, int] | None] = []
    at = 0
    for line in text.splitlines(keepends=True):
        end = at + len(line.rstrip())
        start = at + len(line) - len(line.lstrip())
        lines.append((start, end) if start < end else None)
        at += len(line)
    longest = max((x[1] - x[0] for x in lines if x), default=0)
    i = 0
    while i < len(lines):
        if lines[i] is None:
            i += 1
            continue
        j = i
        while j < len(lines) and lines[j] is not None:
            j += 1
        part = lines[i:j]
        sizes = [e - s for s, e in part]
        # beside lines that were never wrapped, a paragraph shows its margin by lines of about one length
        width = longest if longest <= WRAP[1] else max(sizes) if min(sizes[:-1], default=0) >= 0.75 * max(sizes) else 0
        current: list[int] | None = None
        listed = False
        for n, (s, e) in enumerate(part):
            mark = _BULLET.match(text, s, e)
            if mark and mark.end() >= e:
                mark = None
            if mark and n and current and not listed and _runs_on(text, part[n - 1], (s, e), width) and not _TERMINAL.search(text[part[n - 1][0] : part[n - 1][1]]) and text[s] not in "•*":
                mark = None  # a dash or a figure that wrapping put first
            if current is not None and (mark or not _runs_on(text, part[n - 1], (s, e), width)):
                out.append((current[0], current[1]))
                current = None
            if current is None:
                current = [mark.end() if mark else s, e]
                listed = bool(mark)
            else:
                current[1] = e
        if current is not None:
            out.append((current[0], current[1]))
        i = j
    return out


#: lines wrapped by a program are about this long; longer ones weren't wrapped, shorter ones are lists and headings
WRAP = (56, 100)


def _runs_on(text: str, a: tuple[int, int], b: tuple[int, int], width: int) -> bool:
    """Line b goes on line a: the break was forced, as b's first word had no room on line a.

    ``width`` is the longest line of the text or paragraph, which in wrapped text is close to its margin.
    """
    line = text[a[0] : a[1]]
    if _TERMINAL.search(line) and not line.endswith((":", "：")):
        return True  # the sentence rules decide
    following = text[b[0] : b[1]]
    if re.search(r"[a-zß-ÿ][-\u00ad‐]$", line) and following[0].islower():
        return True  # a word that was parted
    if not WRAP[0] <= width <= WRAP[1]:
        return False
    blank = re.search(r"\s", following)
    first = blank.start() if blank else len(following)
    if re.match(r"[฀-๿぀-ヿ㐀-鿿]", following) and first > 12:
        first = 2
    return len(line) + 1 + first > width


def boundaries(text: str, lang: str) -> list[int]:
    """Offsets in the block after which a new sentence begins."""
    cascade = tables_of(text, lang)
    low = cascade[0] in (TABLES["de"], TABLES["ru"]) and "„" in text
    at = {m.end(): m.start() for m in (_CANDIDATE_LOW if low else _CANDIDATE).finditer(text)}
    if TABLES["th"] in cascade:
        at |= {m.start(): m.start() for m in _THAI_SPACE.finditer(text) if m.start() not in at}
    rules = [r for table in cascade for r in table]
    out = []
    for p in sorted(at):
        if p >= len(text):
            continue
        # all of the marks, and before them more than the longest abbreviation or article with its number has
        before = text[max(0, at[p] - 48) : p]
        for decision, b, a in rules:
            if a.match(text, p) and b.search(before):
                if decision:
                    out.append(p)
                break
    return out


def spans(text: str, lang: str = "") -> list[tuple[int, int]]:
    """(start, end) of every sentence unit in code points, without blanks at its ends."""
    out = []
    for s, e in blocks(text):
        body = text[s:e]
        cuts = [0, *boundaries(body, lang), len(body)]
        for a, b in zip(cuts, cuts[1:]):
            unit = body[a:b]
            left = len(unit) - len(unit.lstrip())
            if unit.strip():
                out.append((s + a + left, s + a + len(unit.rstrip())))
    return out


def item_sentences(text: str, lang: str = "") -> list[str]:
    return [text[a:b] for a, b in spans(text, _language(lang))]


def _language(label: str | None) -> str:
    """A label such as en-GB or ZH to its language."""
    return re.split(r"[-_]", (label or "").strip().lower())[0]


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char) of every unit. Null, empty and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, e) for d, t, lang in zip(b["doc_id"], b["text"], b["lang"]) for s, e in spans(t, _language(lang))]
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char"]).astype("int64")

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).where("text is not null")
    return docs.mapInPandas(run, "doc_id long, start_char long, end_char long")
