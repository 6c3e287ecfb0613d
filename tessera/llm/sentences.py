"""Sentence boundaries across languages and scripts (problem 7).

Rules are ordered pairs of patterns: what stands before a position and what after it, and whether
that is a break.  They are organised as tables that cascade: the common exceptions, then a table
for each script that a text holds, then the common rest; the first rule that fits a position
decides it, and a position that none fits is no break.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


@dataclass(frozen=True)
class Rule:
    """``before`` ends and ``after`` begins at the position; ``inside`` covers a stretch, all of
    whose inner positions the rule decides."""

    breaks: bool
    before: str = ""
    after: str = ""
    inside: str = ""


def no(before: str, after: str = "") -> Rule:
    return Rule(False, before, after)


def yes(before: str, after: str = "") -> Rule:
    return Rule(True, before, after)


# Abbreviations with a period, by language.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Rev St Mt Jr Sr Messrs Hon Gen Col Capt Lt Sgt vs viz cf ca al approx dept est fig figs Fig Figs no No nos Nos vol Vol ch Ch sec Sec eq Eq p pp P Pp ed eds trans Inc Ltd Co Corp Bros Ave Blvd Rd Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun Tel tel ext e.g i.e".split()
# Abbreviations that may also end a sentence.
OPEN_ABBREVIATIONS = "etc a.m p.m A.M P.M U.S U.K E.U U.N Ph.D B.C A.D".split()
# Words with which an English sentence often begins and that aren't capitalised elsewhere.
STARTERS = "The A An My Our Your His Her Their We He She They It In On At For From After Before When While Why How What Where Who See Several About Please But And So Because If This That These Those There However Then Also Although Many Most Some Every Each Another Let Yesterday Today Tomorrow".split()
# Words that end in 다 or 요 and don't end a sentence.
KOREAN_MIDDLE = "보다 마다 다 모두다 바다 하다못해 게다 더하다 이다 중요 필요 주요 수요 소요 강요".split()

# Korean predicates of two syllables that end a sentence without a mark.
KOREAN_SHORT = "했다 였다 이다 있다 없다 된다 됐다 같다 준다 줬다 간다 갔다 온다 왔다 본다 봤다 난다 났다 산다 샀다 쓴다 썼다 안다 컸다 크다 작다 많다 좋다 싫다 높다 낮다 길다 짧다".split()
# Nouns of places, before which a word in 다 may be the place's name.
PLACES = "마을 광장 언덕 골목 나루 들판 쉼터 배움터 누리터 학습관 학교 공원 시장 동네 거리 도서관 초등학교 중학교 고등학교 센터".split()

END = r"[.!?。！？．｡।॥…‥]"
CLOSE = r"""["'”’»›)\]}）］｝」』】〉》]"""
#: A predicate's ending.  A word of two syllables in 다 must be a known predicate or follow an object,
#: a subject or a connective form, as it may be a name.  What a pattern asks of the text before its
#: last letter stands in lookbehinds, so that a search only stops at that letter.
KO_LINK = "[을를이가혀어아여고지게]"
KO_TWO = "|".join(KOREAN_SHORT)
KO_PREDICATE = rf"다(?:(?<=[가-힣]{{2}}다)|(?<=(?<![가-힣])(?:{KO_TWO}))(?!\s+(?:{'|'.join(PLACES)}))|(?<={KO_LINK}\s[가-힣]다))"
KO_POLITE = r"(?:[요죠](?<=[가-힣](?:[어아여해워와겨려져쳐껴봐돼래데네나까지죠세예]요|죠))|까(?<=습니까|니까|[을를일할될갈볼]까)|자(?<=[내보하쓰]자))"
KO_END = r"(?<=[가-힣]다|[가-힣](?:[어아여해워와겨려져쳐껴봐돼래데네나까지죠세예]요|죠)|습니까|니까|[을를일할될갈볼]까|[내보하쓰]자)"
LABEL = r"(?:\(?\d{1,3}[.)]|\(?[가나다라마바사아자차카타파하][.)]|[①-⑳㉠-㉻]|\(?[ivxIVX]{1,4}[.)]|[•·▪◦‣*\-–—])"
LINE = r"[\n\r\x0b\x0c\x85  ]"

SPANS = [
    Rule(False, inside=r"“[^“”\n\r]*”"),
    Rule(False, inside=r"‘[^‘’\n\r]*’(?![A-Za-z])"),
    Rule(False, inside=r"「[^「」\n\r]*」"),
    Rule(False, inside=r"『[^『』\n\r]*』"),
    Rule(False, inside=r"《[^《》\n\r]*》"),
    Rule(False, inside=r"«[^«»\n\r]*»"),
    Rule(False, inside=r"""(?<![\w"])"[^"\n\r]*"|"[^"\n\r]*"(?!\w*")"""),
    Rule(False, inside=r"(?<![\w'])'(?:[^'\n\r]|(?<=[A-Za-z])'(?=[A-Za-z]))+'(?![A-Za-z])"),
    Rule(False, inside=r"\((?:[^()\n\r]|\([^()\n\r]*\))*\)|（[^（）\n\r]*）|\[[^\[\]\n\r]*\]|【[^【】\n\r]*】|〈[^〈〉\n\r]*〉"),
    # what the end of the text cut off within speech or brackets
    Rule(False, inside=r"(?:“[^“”\n\r]*|「[^「」\n\r]*|『[^『』\n\r]*|(?<![:;])\([^()\n\r]*|（[^（）\n\r]*)\s*\Z"),
]

COMMON_FIRST = [
    yes("", LINE),
    yes(LINE),
    no(r"\d[.．,:]", r"\d"),
    no(rf"(?<![^\s.!?…。！？])(?<![A-Za-z\d]\.){LABEL}", r"\s"),
    no(r"", rf"(?:[”’»›)\]}}）］｝」』】〉》]|{END}|[,;:，、；：])"),
    no(r"(?<=[A-Za-z0-9_-])\.", r"[a-z0-9_-]"),
]

KOREAN = [
    no(r"\d\.", r"\s*[가-힣\d]"),
    no(rf"{CLOSE}", r"[가-힣]|\s+(?:이?라[고는며면]|하고|하며|하는|하던|했|라던)"),
    no(r"(?<![가-힣](?:[다요까죠자음함]))(?:\.{2,}|…+|‥+)"),
    no(r"(?<=\.{2}|…|‥)", r"(?:\s*하[고며는])"),
    no(rf"(?<![가-힣])(?:{'|'.join(KOREAN_MIDDLE)})", r"\s"),
    no(r"[가-힣](?:보다|마다)", r"\s"),
    no(r"(?<=다)", r"\s+(?:하[고며는더면]|해[도서]|고\s|는\s|며\s|라는|보니|싶|치고|시피|못해)"),
    yes(rf"{KO_END}[.!?…‥。！？~]+", r"[\"“'‘「『(]"),
    yes(rf"{KO_END}[.!?…‥。！？~]+{CLOSE}*", r"\S"),
    yes(rf"[가-힣)\]]{CLOSE}*[.!?。！？]+{CLOSE}*", r"\s"),
    yes(rf"[.!?。！？]+{CLOSE}+", r"\s+[가-힣]"),
    yes(r"(?<=[가-힣])[?!？！]+", r"[가-힣“\"'‘(]"),
    yes(r"[가-힣\d%][…‥]+|[가-힣\d%]\.{2,}", r"\s"),
    yes(KO_PREDICATE, r"\s"),
    yes(KO_POLITE, r"\s"),
]

LATIN = [
    no(rf"(?<![A-Za-z.])(?:{'|'.join(map(regex.escape, ABBREVIATIONS))})\.", r"\s"),
    no(rf"(?<![A-Za-z.])(?:{'|'.join(map(regex.escape, OPEN_ABBREVIATIONS))})\.", rf"\s+(?!(?:{'|'.join(STARTERS)})\s)"),
    no(r"(?<![A-Za-z])[A-Z]\.", r"\s?[A-Z]"),
    no(r"[.!?…]+[\"'”’)\]]*", r"\s+[a-z]"),
    no(r"(?<![.!?])[\"'”’)\]]+", r"\s"),
    yes(r"[A-Za-z0-9%)\]][.!?…]+[\"'”’)\]]*", r"\s"),
    yes(r"[a-z]{2}[.!?…]+[\"'”’)\]]*", r"[A-Z“\"‘(][a-z]"),
    yes(r"(?<=[a-z]{2}|\d)", rf"\s+(?:{'|'.join(STARTERS)})\s+[a-z]"),
]

CJK = [
    no(r"(?:^|(?<=[\s。！？]))(?:嗯|呃|啊|唉|哎|那个|这个|えっと|ええと|えーと|あの|うーん|その)[…‥]+"),
    no(r"[」』”’）)]+", r"(?:と|って|という|は|が|を|に|の|で|も|な|地|的|，|、)"),
    yes(r"[。！？!?｡]+[」』”’）)】》〉]*", r"[「『“‘（(【《〈\s]*[\n\r]"),
    no(r"(?<![。！？\s」』”])[「『“‘][^「」『』“”‘’\n\r]*[。！？!?]+[」』”’]+"),
    yes(r"[。！？｡]+[」』”’）)】》〉]*"),
    yes(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])[!?]+[」』”’）)】》〉]*"),
    yes(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])(?:[…‥]+|\.{3,})[」』”’）)】》〉]*"),
    yes(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])\.[」』”’）)】》〉]*", r"\s"),
    yes(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])", r"[ 　]+[\p{Han}\p{Hiragana}\p{Katakana}]{2}"),
]

THAI = [
    no(r"[ๆฯ]", r"\s"),
    no(r"[\p{Thai}]", r"\s+(?:ๆ|ฯ|และ|หรือ|แต่|เพราะ)"),
    yes(r"[\p{Thai}\d][.!?…]*[\"'”’)]*", r"\s+[\p{Thai}]"),
    yes(r"[\p{Thai}][.!?…]*[\"'”’)]*", r"\s+[^\s\d]"),
]

DEVANAGARI = [
    no(r"(?<![\p{Devanagari}])(?:डॉ|श्री|पं|प्रो|रु|सं)\.", r"\s"),
    yes(r"[।॥]+[\"'”’)]*"),
    yes(r"(?<=[\p{Devanagari}])[.!?…]+[\"'”’)]*", r"\s"),
]

COMMON_LAST = [
    no(r"[.]", r"\s+\p{Ll}"),
    yes(rf"[!?。！？।॥؟۔]+{CLOSE}*", r"\s"),
    yes(rf"(?<=[\p{{L}}\p{{M}}\p{{N}}%]{CLOSE}?)[.…]+{CLOSE}*", r"\s"),
]

TABLES: list[tuple[str, list[Rule]]] = [
    ("", SPANS),
    ("", COMMON_FIRST),
    (r"[가-힣]", KOREAN),
    (r"[A-Za-z]", LATIN),
    (r"[\p{Han}\p{Hiragana}\p{Katakana}]", CJK),
    (r"\p{Thai}", THAI),
    (r"\p{Devanagari}", DEVANAGARI),
    ("", COMMON_LAST),
]


def _compiled(tables=TABLES):
    out = []
    for needs, rules in tables:
        each = []
        for r in rules:
            if r.inside:
                each.append((r.breaks, regex.compile(r.inside), True))
            else:
                each.append((r.breaks, regex.compile(f"(?:{r.before})(?={r.after})" if r.after else f"(?:{r.before})", regex.M), False))
        out.append((regex.compile(needs) if needs else None, each))
    return out


_RULES = _compiled()
_CHAR = regex.compile(r"[\p{L}\p{N}]")


def boundaries(text: str) -> list[int]:
    """The positions of all breaks within a text."""
    decided: dict[int, bool] = {}
    for needs, rules in _RULES:
        if needs and not needs.search(text):
            continue
        for breaks, pattern, inside in rules:
            if inside:
                for m in pattern.finditer(text):
                    decided |= {x: breaks for x in range(m.start() + 1, m.end()) if x not in decided}
            else:
                for m in pattern.finditer(text, overlapped=False):
                    decided.setdefault(m.end(), breaks)
    return sorted(x for x, b in decided.items() if b and 0 < x < len(text))


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without blanks at either end."""
    if not text or not _CHAR.search(text):
        return []
    out = []
    at = 0
    for x in [*boundaries(text), len(text)]:
        part = text[at:x]
        kept = part.strip()
        if kept:
            start = at + len(part) - len(part.lstrip())
            out.append((start, start + len(kept)))
        at = x
    return out


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, sent_no, start_char, end_char (exclusive), in code points, of every sentence.

    Null and blank texts, and texts without any letter or digit, have no rows; any other character
    but blanks lies in a unit.  Rows that are repeated give their sentences as often.  No shuffle.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sent_no int, start_char int, end_char int"

    def run(batches):
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            rows, numbers, starts, ends = [], [], [], []
            for x, t in enumerate(texts):
                for n, (s, e) in enumerate(units(t)):
                    rows.append(x)
                    numbers.append(n)
                    starts.append(s)
                    ends.append(e)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), *(pa.array(v, pa.int32()) for v in (numbers, starts, ends))], names=[*keys, "sent_no", "start_char", "end_char"])

    return df.select(*keys, F.col(text).cast("string").alias("_text")).where("_text IS NOT NULL").mapInArrow(run, schema)


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, essay_id, trait, text, source of every essay text and trait feedback, once by key.

    Of deliveries that differ the one with the longest text stays, of equal ones any.
    """
    essays = table(spark, sf_dir, "essays").select(F.lit("text").alias("field"), "essay_id", F.lit("").alias("trait"), "text", "source")
    scores = table(spark, sf_dir, "trait_scores").select(F.lit("feedback").alias("field"), "essay_id", F.coalesce("trait", F.lit("")).alias("trait"), F.col("feedback").alias("text"), "source")
    both = essays.unionByName(scores).where("essay_id IS NOT NULL AND text IS NOT NULL")
    return both.groupBy("field", "essay_id", "trait").agg(F.max_by(F.struct("text", "source"), F.struct(F.char_length("text"), "text", "source")).alias("_r")).select("field", "essay_id", "trait", "_r.text", "_r.source")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, essay_id, trait, sent_no, start_char, end_char of every sentence."""
    return sentences(keyed_texts(spark, sf_dir), ["field", "essay_id", "trait"], "text")
