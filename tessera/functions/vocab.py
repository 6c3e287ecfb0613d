"""Fixed vocabularies.  The values are those of the data format and the published scheme."""

from __future__ import annotations

# The analytic traits in report order, and the rubric area of each.
TRAITS = ("task_1", "content_1", "content_2", "content_3", "organization_1", "organization_2", "expression_1", "expression_2")
TRAIT_AREA = {
    "task_1": "task", "content_1": "content", "content_2": "content", "content_3": "content",
    "organization_1": "organization", "organization_2": "organization", "expression_1": "expression", "expression_2": "expression",
}
AREA_OF_LETTER = {"1A": "task", "1B": "content", "1C": "organization", "1D": "expression"}
# The three trait types of the main contrast.
TRAIT_TYPE = {"expression_2": "surface", "organization_1": "discourse", "content_1": "content"}
SCORE_MIN, SCORE_MAX = 1, 5
PURPOSES = ("설명", "설득")

# Words by which feedback names a rubric area.
AREA_KEYWORDS = {
    "task": ("프롬프트", "과제", "요구", "맥락", "조건", "지시문", "수행", "충실", "탁월", "미흡", "반영"),
    "content": ("내용", "설명", "주장", "논제", "근거", "구체", "세부", "예시", "사실", "정보", "적절", "관련", "부합", "대상", "초점", "명료", "통일", "일관", "주제", "화제"),
    "organization": ("연결", "흐름", "전환", "구성", "문단", "서론", "본론", "결론", "구조", "체계", "조직", "단락"),
    "expression": ("어휘", "단어", "표현", "어법", "맞춤법", "문법", "띄어쓰기", "문장", "표기", "어미", "조사"),
}

# The feature families; their order breaks ties.
FAMILIES = ("meta", "morph_prop", "lex", "vocab_grade", "syn", "case_marker", "dis_nonSBERT", "dis_SBERT")
# Token sequences by which a rationale names a family.
FAMILY_KEYWORDS = {
    "meta": (("길이",), ("분량",), ("글", "길이"), ("문장", "수"), ("어절", "수")),
    "morph_prop": (("어미",), ("종결",), ("시제",), ("품사",), ("동사", "비율")),
    "lex": (("어휘",), ("단어", "선택"), ("표현", "다양"), ("어휘", "다양")),
    "vocab_grade": (("어휘", "등급"), ("초급", "어휘"), ("고급", "어휘"), ("어휘", "수준")),
    "syn": (("문장", "구조"), ("문법", "구조"), ("연결", "어미"), ("문장", "형식")),
    "case_marker": (("조사",), ("격조사",), ("조사", "사용"), ("어절", "결합")),
    "dis_nonSBERT": (("접속어",), ("연결어",), ("응집",), ("문단", "연결"), ("전개", "흐름")),
    "dis_SBERT": (("의미", "일관성"), ("주제", "유지"), ("내용", "흐름"), ("맥락", "연결"), ("문단", "일관성")),
}
# Families that fit an area first, second, and not at all.
AREA_FAMILIES = {
    "task": (("meta", "morph_prop"), ("syn",), ()),
    "content": (("lex", "dis_SBERT"), ("morph_prop",), ("meta",)),
    "organization": (("dis_SBERT", "dis_nonSBERT"), ("syn",), ("meta",)),
    "expression": (("syn", "morph_prop"), ("lex",), ("dis_SBERT",)),
}

# The tags of the ``feature`` map; the last is a count of sentences, not a tag.
MORPH_TAGS = (
    "일반 명사", "명사 파생 접미사", "보조사", "붙임표", "관형격 조사", "주격 조사", "부사격 조사", "동사 파생 접미사", "관형형 전성 어미", "목적격 조사",
    "동사 파생 접미사+종결 어미", "마침표, 물음표, 느낌표", "연결 어미", "보조 용언+선어말 어미+연결 어미", "구분자", "동사+연결 어미", "형용사", "숫자",
    "단위를 나타내는 명사", "동사", "보조 용언", "종결 어미", "동사+관형형 전성 어미", "의존 명사", "접속 부사", "긍정 지정사+관형형 전성 어미", "동사+종결 어미",
    "접속 조사", "일반 부사", "긍정 지정사", "형용사 파생 접미사+관형형 전성 어미", "명사형 전성 어미", "보조 용언+종결 어미", "대명사",
    "동사 파생 접미사+관형형 전성 어미", "수사", "관형사", "긍정 지정사+연결 어미", "동사 파생 접미사+연결 어미", "형용사+연결 어미+보조 용언+관형형 전성 어미",
    "동사+연결 어미+보조 용언", "문장수",
)
SENTENCES = "문장수"
# Families of tags; a composite tag counts in each of its families.
POS_FAMILIES = {
    "noun": ("일반 명사", "의존 명사", "단위를 나타내는 명사"),
    "verb": ("동사", "동사+연결 어미", "동사+종결 어미", "동사+관형형 전성 어미", "동사+연결 어미+보조 용언"),
    "adjective": ("형용사", "형용사+연결 어미+보조 용언+관형형 전성 어미", "형용사 파생 접미사+관형형 전성 어미"),
    "adverb": ("일반 부사", "접속 부사"),
    "pronoun": ("대명사",),
    "numeral": ("수사", "숫자"),
    "determiner": ("관형사",),
    "connective_ending": ("연결 어미", "동사+연결 어미", "동사 파생 접미사+연결 어미", "긍정 지정사+연결 어미"),
    "final_ending": ("종결 어미", "동사+종결 어미", "동사 파생 접미사+종결 어미", "보조 용언+종결 어미"),
    "adnominal_ending": ("관형형 전성 어미", "동사+관형형 전성 어미", "동사 파생 접미사+관형형 전성 어미", "긍정 지정사+관형형 전성 어미", "형용사 파생 접미사+관형형 전성 어미"),
}
# The case particles among the tags.
CASE_TAGS = {"subject": "주격 조사", "object": "목적격 조사", "adverbial": "부사격 조사", "vocative": "호격 조사", "quotative": "인용격 조사", "complement": "보격 조사", "genitive": "관형격 조사"}

# Tags and reasons that annotation records may hold.
EVIDENCE_TAGS = ("rubric_cue", "topic_frame", "structural_marker", "transition", "claim_or_thesis", "definition_or_concept", "content_detail", "factual_evidence", "example_case", "causal_reasoning", "lexical_choice", "grammatical_usage", "unspecified")
NULL_REASONS = ("insufficient_evidence", "rubric_ambiguous")
# The ordinal codes.
CODE_LEVEL = {"하": 0, "중": 1, "상": 2}
