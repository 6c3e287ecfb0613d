from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import consensus, encode, leaks, pairs, sentences, spans, splits, truncation

# ---------------------------------------------------------------- p3


def test_plain_id(spark):
    df = spark.createDataFrame([(" a-001 ",), ("A001",), ("unknown",), ("A0000",), ("-",), ("",), (None,), ("익명",)], "x string")
    assert [r[0] for r in df.select(splits.plain_id(df.x)).collect()] == ["A001", "A001"] + [None] * 6


def naive_components(edges):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(30)]
    df = spark.createDataFrame(edges + [(None, 1), (7, None)], "u long, v long")
    want = naive_components(edges) | {1: 1, 7: 7} | naive_components(edges)
    assert {x["id"]: x["group"] for x in splits.components(df).collect()} == want


def test_groups_regard_all_rows_of_a_key(spark):
    rows = [(1, "A-1", None), (1, None, None), (2, "a1 ", None), (3, "unknown", 2), (4, "unknown", 99), (5, "B2", None), (5, "A1", None), (None, "A1", 1), (6, "A000", None)]
    df = spark.createDataFrame(rows, "k long, who string, of long")
    assert {x["id"]: x["group"] for x in splits.groups_of_records(df, "k", ["who"], "of").collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 6: 6}


def test_no_records(spark):
    df = spark.createDataFrame([], "k long, who string, of long")
    assert splits.groups_of_records(df, "k", ["who"], "of").collect() == []
    assert splits.stratify(spark.createDataFrame([], "id long, group long, label string"), {"a": 1.0}, ["label"]).collect() == []


def test_chain_starts(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("d", "gone"), ("e", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), (None, "a")], "k string, p string")
    assert dict(splits.chain_starts(df, "k", "p").collect()) == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "e", "x": "x", "y": "x", "z": "x", "w": "x"}


def test_place_keeps_items_whole_and_shares():
    r = random.Random(3)
    items = [(i, {r.choice("abc"): r.randrange(1, 6), "z": 1}) for i in range(300)]
    totals = {k: sum(v.get(k, 0) for _, v in items) for k in "abcz"}
    got = splits.place(items, splits.lacking(totals, {"train": 0.8, "dev": 0.1, "test": 0.1}))
    assert set(got) == set(range(300))
    total = sum(sum(v.values()) for _, v in items)
    for s, p in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(sum(sum(v.values()) for i, v in items if got[i] == s) / total - p) < 0.02


def test_stratify(spark):
    rows = [(i, i // 3 if i < 900 else 5000, "abc"[i % 3] if i % 7 else None) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, group long, label string")
    got = dict(splits.stratify(df, {"x": 0.5, "y": 0.5}, ["label"]).collect())
    assert set(got) == {g for _, g, _ in rows}
    n = sum(got[g] == "x" for _, g, _ in rows)
    assert abs(n / 1200 - 0.5) < 0.02


def test_any_number_of_labels_keeps_the_shares(spark):
    df = spark.range(40_000).select("id", F.col("id").alias("group"), F.col("id").cast("string").alias("label"))
    n = {r[0]: r[1] for r in splits.stratify(df, {"x": 0.5, "y": 0.5}, ["label"]).groupBy("split_name").count().collect()}
    assert abs(n["x"] - 20_000) < 50 and n["x"] + n["y"] == 40_000


@pytest.mark.parametrize("task", [100_000, 500])
def test_small_components_are_spread_by_label_vector(spark, monkeypatch, task):
    monkeypatch.setattr(splits, "SWEEP", task)
    shares = {"train": 0.8, "dev": 0.1, "test": 0.1}
    group = F.when(F.col("id") < 4000, F.lit(0)).otherwise(1 + F.col("id") % 9000)  # one group holds a sixth of all
    df = spark.range(24_000).select("id", group.alias("group"), F.when(F.col("id") % 400 == 0, "rare").otherwise((F.col("id") % 5).cast("string")).alias("a"), (F.xxhash64("id") % 3).cast("string").alias("b"))
    split = splits.stratify(df, shares, ["a", "b"])
    rows = df.join(split, "group").cache()
    assert rows.count() == 24_000 and split.count() == df.select("group").distinct().count()
    for c in "ab":
        for r in rows.groupBy(c).pivot("split_name", list(shares)).count().collect():
            total = sum(r[s] or 0 for s in shares)
            assert all(abs((r[s] or 0) - p * total) <= max(6, 0.01 * total) for s, p in shares.items()), r


# ---------------------------------------------------------------- p4


def simulated(seed=0):
    r = np.random.default_rng(seed)
    truth = r.integers(1, 6, 600)
    rows = []
    for i, z in enumerate(truth):
        for j in r.choice(20, 4, replace=False):
            s = {0: r.integers(1, 6), 1: 6 - z + r.integers(-1, 2), 2: 3, 3: z + 1}.get(int(j), z + r.choice([-1, 0, 0, 0, 1]))
            rows.append((i, "t", f"r{j}", int(np.clip(s, 1, 5))))
    return truth, rows


@pytest.mark.parametrize("held", [500_000, 0])
def test_ability_and_consensus(spark, monkeypatch, held):
    monkeypatch.setattr(consensus, "BROADCAST_RATERS", held)
    monkeypatch.setattr(consensus, "CHUNK", 700)
    truth, rows = simulated()
    df = spark.createDataFrame(rows, "essay_id long, trait string, rater_id string, score int")
    fit = consensus.Fit(df, 60 if held else 12)
    assert 1 < fit.rounds < 60
    rel = {r.rater_id: r for r in fit.reliability().collect()}
    assert {k for k, r in rel.items() if not r.usable} == {"r0", "r1", "r2"}
    assert rel["r1"].ability < 0 < rel["r4"].ability and rel["r3"].severity > 0.3
    got = {r.essay_id: r for r in fit.consensus().collect()}
    assert np.mean([got[i].consensus == z for i, z in enumerate(truth)]) > 0.8
    assert len(got) == len(truth) and all(0 < r.certainty <= 1 for r in got.values())


def test_learned_abilities_decide(spark):
    """Without a round of learning no rater is told from the others."""
    df = spark.createDataFrame(simulated()[1], "essay_id long, trait string, rater_id string, score int")
    assert all(r.usable for r in consensus.Fit(df, 0).reliability().collect())
    # a noisy rater, who often errs by a level or two, is of use
    r = np.random.default_rng(4)
    truth = r.integers(1, 6, 800)
    rows = [(i, "t", f"r{j}", int(np.clip(z + (r.choice([-2, -1, -1, 0, 0, 1, 1, 2]) if j == 0 else r.choice([-1, 0, 0, 0, 1])), 1, 5))) for i, z in enumerate(truth) for j in range(3)]
    assert all(x.usable for x in consensus.Fit(spark.createDataFrame(rows, "essay_id long, trait string, rater_id string, score int")).reliability().collect())


def test_few_labels_flag_no_one(spark):
    df = spark.createDataFrame([(1, "t", "a", 5), (1, "t", "b", 1), (2, "t", "a", 1)], "essay_id long, trait string, rater_id string, score int")
    assert all(r.usable for r in consensus.Fit(df, 3).reliability().collect())


def test_no_labels(spark):
    fit = consensus.Fit(spark.createDataFrame([], "essay_id long, trait string, rater_id string, score int"), 2)
    assert fit.reliability().collect() == fit.consensus().collect() == []


def test_alpha(spark):
    rows = [(i, "t", f"r{j}", s) for i, ss in enumerate([(1, 2), (3, 3), (5, 4, 5), (2,)]) for j, s in enumerate(ss)]
    got = consensus.agreement(spark.createDataFrame(rows, "essay_id long, trait string, rater_id string, score int")).first()
    units = [[1, 2], [3, 3], [5, 4, 5]]
    flat = [x for u in units for x in u]
    do = sum(sum((a - b) ** 2 for a in u for b in u) / (len(u) - 1) for u in units) / len(flat)
    de = sum((a - b) ** 2 for a in flat for b in flat) / (len(flat) * (len(flat) - 1))
    assert got.alpha == pytest.approx(1 - do / de, abs=1e-6) and got.n_items == 3


# ---------------------------------------------------------------- p5


PROMPT = "평소 책에서 겪은 일을 바탕으로 급식을 떠올려 봅시다. 급식에 대해 주장하는 글을 쓰시오. 분량은 600자 안팎입니다."


def test_pair_checks():
    for t in (None, "", " 　​", "-", "···", "(내용 없음)", "N/A", "없음"):
        assert pairs.is_empty(t)
    assert not pairs.is_empty("네")
    parts = ["급식에 대해 주장하는글을 쓰시오.", "평소 책에서 겪은 일을 바탕으로 급식을 떠올려 봅시다."]
    assert pairs.is_copy(parts, pairs.copied(parts, PROMPT))
    more = [*parts, "나는 밥이 좋다."]
    assert pairs.is_copy(more, pairs.copied(more, PROMPT))
    more += ["국도 좋고 반찬도 좋다."]
    assert not pairs.is_copy(more, pairs.copied(more, PROMPT))
    assert pairs.other_language("This is about lunch.", PROMPT) and not pairs.other_language("U.S. 자료를 본다.", PROMPT)
    assert not pairs.other_language("...", PROMPT)


def sound(n, topics, first=1000):
    """Ordinary responses of a dozen sentences of their own."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("가나다라마바사아자차카타파하거너더러머버서어") for _ in range(r.randrange(2, 5)))
    return [(first + i, " ".join(" ".join(word() for _ in range(7)) + "다." for _ in range(12)), f"{topics[i % len(topics)]}에 대해 주장하는 글을 쓰시오.", topics[i % len(topics)]) for i in range(n)]


TOPICS = ["급식", "운동", "독서", "체육", "음악", "여행"]


def judged_defects(spark, rows, cut=()):
    df = spark.createDataFrame(rows, "essay_id long, text string, prompt string, topic string")
    return dict(pairs.defects(df, spark.createDataFrame([(c,) for c in cut], "essay_id long")).collect())


def test_defects(spark):
    rows = [(1, None, PROMPT, "급식"), (2, "Lunch at school is very good.", PROMPT, "급식"), (3, "급식은 맛있다.", None, None), (4, "급식은 맛있다. 그래서", PROMPT, "급식"), (5, "급식은 맛있다.", PROMPT, "급식"), (6, PROMPT, PROMPT, "급식")]
    rows += [(10 + i, f"저는 {t} 이야기를 펼치지 못하니 이만 줄입니다. 다음에 뵙겠습니다.", f"{t}에 대해 주장하는 글을 쓰시오.", t) for i, t in enumerate(TOPICS)]
    got = judged_defects(spark, rows + sound(60, TOPICS), (4, 1))
    assert got == {1: "empty", 2: "other_language", 4: "truncated", 6: "copy"} | {10 + i: "refusal" for i in range(6)}


def similarity(a, b):
    h = [set(pairs.trigrams([x])[0].tolist()) for x in (a, b)]
    return len(h[0] & h[1]) / len(h[0] | h[1])


def test_variants_of_a_template_are_found(spark):
    r = random.Random(5)
    words = ["".join(r.choice("가나다라마바사아자차카타파하거너더러머버서어") for _ in range(4)) for _ in range(400)]
    base = words[:8]
    variants = []
    while len(variants) < 30:
        v = " ".join(r.choice(words[8:]) if r.random() < 0.25 else w for w in base)
        if 0.52 <= similarity(" ".join(base), v) < 0.65 and len(sentences.units(v)) == 1:
            variants.append(v)
    rows = [(i, t + ".", f"{k}에 대해 주장하는 글을 쓰시오.", k) for i, (t, k) in enumerate(zip([" ".join(base)] * 6 + variants, ["급식", "운동", "독서"] * 12))]
    assert judged_defects(spark, rows + sound(100, TOPICS)) == {i: "refusal" for i in range(36)}


def test_tables_of_trigrams_are_not_broadcast(spark):
    texts = pairs.sketched(spark.createDataFrame([("가나다라마바사", False, 1), ("가나다라마바자", False, 2)], "text string, whole boolean, id long"))
    tops = texts.select(F.explode("bands").alias("band"), F.col("id").alias("rep"), F.size("grams").alias("size")).groupBy("band").agg(F.min("rep").alias("rep"), F.min("size").alias("size"))
    for held, n in ((tops.hint("merge"), 0), (F.broadcast(tops), 1)):
        near = pairs.similar(held, texts, texts)
        assert near._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == n
        assert (1, 1) in {tuple(x) for x in near.collect()}


def test_refusals_of_any_length(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("가나다라마바사아자차카타파하") for _ in range(3))
    long = [" ".join(word() for _ in range(8)) + "다." for _ in range(40)]
    rows = []
    for i in range(12):  # ten times what was once the longest refusal, each with a sentence of its own
        parts = [*long]
        parts[r.randrange(40)] = f"{TOPICS[i % 6]} {word()} {word()}다."
        rows.append((i, " ".join(parts), f"{TOPICS[i % 6]}에 대해 주장하는 글을 쓰시오.", TOPICS[i % 6]))
    assert len(pairs.bare(rows[0][1])) > 900
    assert judged_defects(spark, rows + sound(60, TOPICS)) == {i: "refusal" for i in range(12)}


def test_what_recurs_in_ordinary_responses_is_no_template(spark):
    rows = [(i, t if i % 9 else "오늘은 조사한 바를 차례로 적어 보았다.", p, k) for i, t, p, k in ((i, "오늘은 조사한 바를 차례로 적어 보았다. " + t, p, k) for i, t, p, k in sound(90, TOPICS))]
    assert judged_defects(spark, rows) == {}


def test_wording_alone_is_no_refusal(spark):
    texts = ["나는 앞으로 거짓말을 하지 않겠다.", "그 돈은 쓸 수 없다.", "이 주제로는 글을 쓸 수 없습니다.", "나는 조금 다르게 생각한다."]
    rows = [(i, t, f"{k}에 대해 주장하는 글을 쓰시오.", k) for i, (t, k) in enumerate(zip(texts, TOPICS))]
    rows += [(20 + i, "나는 급식이 맛있다고 생각한다.", "급식에 대해 주장하는 글을 쓰시오.", "급식") for i in range(8)]  # recurs, but within one topic
    assert judged_defects(spark, rows + sound(60, TOPICS)) == {}


def test_signatures_estimate_similarity():
    r = random.Random(3)
    a = "".join(r.choice("가나다라마바사") for _ in range(400))
    b = a[:340] + "".join(r.choice("가나다라마바사") for _ in range(60))
    (h, first), s = pairs.trigrams([a, b, ""]), similarity(a, b)
    low = np.stack([np.minimum.reduceat(pairs._mix(h * seed), first) for seed in pairs._SEEDS], axis=1)
    assert abs(np.mean(low[0] == low[1]) - s) < 0.2 and len(first) == 3
    assert set(pairs.whole_bands(h[: first[1]])) & set(pairs.whole_bands(h[first[1] : first[2]]))


def test_no_pairs(spark):
    df = spark.createDataFrame([], "essay_id long, text string, prompt string, topic string")
    assert pairs.defects(df, spark.createDataFrame([], "essay_id long")).collect() == []


# ---------------------------------------------------------------- p6


def test_endings():
    state = lambda t: truncation.ending(t)[0]
    for t in ("", "---", "그는 갔다.", "정말? ", "See it.”", "좋다。", "!"):
        assert state(t) == "whole", t
    for t in ("그는 갔다. 어�", "그는 학교에 가-", "삼촌은 “버렸다. 정말", "값은 15.", "그는 갔다. (1)", "See p.", "광장(계속"):
        assert state(t) == "cut", t
    assert state("그는 갔다. 그래서") == "ask"
    for n in (3, 10, 70, 700):
        assert state("그는 갔다. 그래서" + "." * n) == state("그는 갔다. 그래서" + "…" * n) == "ask"
        assert state("그는 갔다" + "!" * n) == "whole"


def test_below_equals_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("가나a") for _ in range(r.randrange(1, 7)))
    words = {(r.choice("xy"), word()): r.randrange(1, 9) for _ in range(300)} | {("x", "긴" * 500): 7, ("x", "긴" * 20_000): 5}
    asked = sorted({(r.choice("xyz"), word()) for _ in range(80)} | {("x", "긴" * 400), ("x", "긴" * 500), ("y", "긴"), ("x", "")})
    nodes = spark.createDataFrame([(*k, n) for k, n in words.items()], "before string, word string, n long")
    got = {(x.before, x.word): x.below for x in truncation.below(nodes, spark.createDataFrame(asked, "before string, word string"), ["before"]).collect()}
    assert got == {(b, w): sum(n for (c, v), n in words.items() if c == b and w and v.startswith(w) and v != w) for b, w in asked}


def test_trie_and_lengths_decide(spark):
    base = ["오늘 아침에 동생은 학교에서 새로운 책을 읽었다.", "우리는 함께 커다란 나무를 심었다.", "나는 그래서 기쁘다."]
    rows = [("text", i, "", " ".join(random.Random(i).sample(base, 2)), "s") for i in range(30)]
    rows += [("text", 100, "", "나는 그래서 기쁘다. 우리는 함께 커다", "s"), ("text", 101, "", "나는 그래서 기쁘다. 우리는 홀로 쿼", "s")]
    rows += [("text", 200 + i, "", ("나는 그래서 기쁘다. " * 5 + "".join(random.Random(i).choice("쿠켜츠프") for _ in range(90)))[:99], "t") for i in range(8)]
    df = spark.createDataFrame(rows, "field string, essay_id long, trait string, text string, source string")
    found = lambda **kw: {r.essay_id for r in truncation.truncated(df, **kw).where("truncated").collect()}
    piled = {200 + i for i in range(8)}
    # a prefix of a known word is cut; a word that no node holds is cut only at a limit
    assert found() == {100} | piled and found(trie=False) == piled and found(lengths=False) == {100}


def test_truncated(spark):
    base = ["오늘 아침에 동생은 학교에서 새로운 책을 읽었다.", "우리는 함께 커다란 나무를 심었다.", "The coach supported a borrowed tablet.", "나는 그래서 기쁘다."]
    rows = [("text", i, "", " ".join(random.Random(i).sample(base, 3)), "s") for i in range(60)]
    odd = {100: ("나는 그래서 기쁘다. 우리는 함께 커다", True), 101: ("나는 그래서 기쁘다. 우리는 함께", True), 102: ("나는 그래서 기쁘다. 우리는 함께 커다란 나무를 심었다", False), 103: ("The coach supported a borr", True), 104: ("The coach supported a borrowed tablet", False), 105: ("   ", False), 106: ("우리는 함께 커다란 나무를 심었다…", False), 107: ("우리는 함께 커다란…", True)}
    rows += [("text", k, "", t, None) for k, (t, _) in odd.items()]
    df = spark.createDataFrame(rows, "field string, essay_id long, trait string, text string, source string")
    got = {r.essay_id: r.truncated for r in truncation.truncated(df).collect()}
    assert {k: got[k] for k in odd} == {k: v for k, (_, v) in odd.items()}
    assert len(got) == len(rows) and not any(got[i] for i in range(60))


def test_copies_of_a_cut_text_are_found(spark):
    base = ["오늘 아침에 동생은 학교에서 새로운 책을 읽었다.", "우리는 함께 커다란 나무를 심었다.", "나는 그래서 기쁘다."]
    rows = [("text", i, "", " ".join(random.Random(i).sample(base, 2)), "s") for i in range(30)]
    rows += [("text", 100 + i, "", "나는 그래서 기쁘다. 그 옆에 새로", "s") for i in range(4)] + [("text", 200 + i, "", "매우 새로", "s") for i in range(4)]
    df = spark.createDataFrame(rows, "field string, essay_id long, trait string, text string, source string")
    assert {r.essay_id for r in truncation.truncated(df).where("truncated").collect()} == {100, 101, 102, 103}


def test_truncated_nothing(spark):
    df = spark.createDataFrame([], "field string, essay_id long, trait string, text string, source string")
    assert truncation.truncated(df).collect() == []


# ---------------------------------------------------------------- p7


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("나는 갔다. 너는 왔다!", ["나는 갔다.", "너는 왔다!"]),
        ("값은 3.5%다. 날짜는 2024. 5. 6. 오전이다.", ["값은 3.5%다.", "날짜는 2024. 5. 6. 오전이다."]),
        ("친구는 “버렸다. 정말 미안하다!” 하고 말했다. 끝.", ["친구는 “버렸다. 정말 미안하다!” 하고 말했다.", "끝."]),
        ("책(예: 춤, 환경 등. 마을 기준)은 줄었다", ["책(예: 춤, 환경 등. 마을 기준)은 줄었다"]),
        ("조금 지지했다 U.S. 자료와 견주면 다르다 음... 숲은 어렵다", ["조금 지지했다", "U.S. 자료와 견주면 다르다", "음... 숲은 어렵다"]),
        ("후배는 온다 나루에서 화해를 보았다.", ["후배는 온다 나루에서 화해를 보았다."]),
        ("정한다. 1. 수영을 더하세요.가. 책을 본다.", ["정한다.", "1. 수영을 더하세요.", "가. 책을 본다."]),
        ("첫 줄\n\n　둘째 줄 ", ["첫 줄", "둘째 줄"]),
        ("Mr. Kim met us at 7.30 a.m. since it rained. Why? \"Wait! Now.\" she said.", ["Mr. Kim met us at 7.30 a.m. since it rained.", "Why?", '"Wait! Now." she said.']),
        ("为什么？他说：“很好。别忘了！”然后走了。", ["为什么？", "他说：“很好。别忘了！”然后走了。"]),
        ("妹が「大事だ。忘れないで。」と言った。平均は8.3点だ。", ["妹が「大事だ。忘れないで。」と言った。", "平均は8.3点だ。"]),
        ("ฉันคิดว่าดี น้องชอบอ่าน", ["ฉันคิดว่าดี", "น้องชอบอ่าน"]),
        ("क्या यह है? औसत 4.1 था।", ["क्या यह है?", "औसत 4.1 था।"]),
        (None, []), ("", []), (" … ", []), ("?!", []),
    ],
)
def test_units(text, want):
    assert [text[a:b] for a, b in sentences.units(text)] == want


@pytest.mark.parametrize("frame", ["'{}' 하고 말했다.", "“{}” 하고 말했다.", "({})을 적었다.", "“{}", "「{}", "({}", "（{}"])
@pytest.mark.parametrize("n", [1, 30, 3000])
def test_speech_of_any_length_stays_whole(frame, n):
    assert len(sentences.units("나는 갔다. 그는 " + frame.format("밥은 맛있다. " * n + "국도 좋다."))) == 2


def test_apostrophes_are_no_quotations():
    t = "The dogs' owner isn't here. 'I don't know. Ask them.' she said. It's late."
    assert [t[a:b] for a, b in sentences.units(t)] == ["The dogs' owner isn't here.", "'I don't know. Ask them.' she said.", "It's late."]


def test_units_cover_all_but_blanks():
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice("가다. ?!“”\"'()1a。\n　…") for _ in range(r.randrange(60)))
        u = sentences.units(t)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in u)
        assert all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        if u:
            assert sum(b - a - sum(c.isspace() for c in t[a:b]) for a, b in u) == sum(not c.isspace() for c in t)


def test_long_text(spark):
    t = "나는 갔다. " * 20_000
    df = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (1, "또 갔다.", "x")], "k long, text string, sent_no string")
    assert sentences.sentences(df, ["k"], "text").count() == 20_001


# ---------------------------------------------------------------- p8


@pytest.fixture(scope="module")
def merges():
    return encode.Merges(f"{encode.TOKENIZERS}/byte_bpe_50k.json")


def test_encoding_equals_the_library(merges):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    r = random.Random(1)
    texts = ["", "a" * 999, "가나다 " * 50, "<|endoftext|>", "  \n\n x", "ab" * 300, "it's 12345", "日本語。", "​🙂é"]
    texts += ["".join(r.choice("aaabc 가나1.\n🙂") for _ in range(r.randrange(200))) for _ in range(100)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "thequickbrownfoxjumps" * 200, "".join(r.choice("가나다라힣쀍中文") for _ in range(900)), "".join(r.choice("ab") for _ in range(2000)), "-=" * 700]
    assert encode.encode_texts(texts, merges, {}) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_take_time_by_their_length(merges):
    import time

    r = random.Random(2)
    took = []
    for n in (10_000, 100_000):
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
        t = time.process_time()
        merges.encode([w])
        took.append(time.process_time() - t)
    assert took[1] < 30 * took[0] + 1


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hi", 0), (3, "hi", 0)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in encode.encode(df, "doc_id", "text").collect()) == [(1, []), (2, []), (3, [5303]), (3, [5303])]


# ---------------------------------------------------------------- p9


@pytest.mark.parametrize(("n", "routed"), [(5_000, 10_000), (7, 3)])
def test_leaks(spark, monkeypatch, n, routed):
    monkeypatch.setattr(leaks, "ITEMS", n)
    monkeypatch.setattr(leaks, "ROUTED", routed)
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("가나다라마바사아자차카타파하abcdef") for _ in range(r.randrange(2, 6))) for _ in range(n))
    items = [(i, text(30)) for i in range(40)] + [(50, None), (51, "short")]
    docs = []
    for d in range(200):
        t = text(r.choice([5, 60, 900]))
        if d % 3 == 0:
            b = items[d % 40][1]
            x = r.randrange(20)
            part = b[x : x + r.choice([40, 70, 90])]
            t = t[:50] + "".join(c.upper() + r.choice(["", "-", " "]) for c in part) + t[50:]
        docs.append((d, t))
    docs += [(900, None), (901, "")]
    index = leaks.Index(items[:40])
    want = set()
    for d, t in docs:
        b = leaks.bare(t)
        for i, it in index.items:
            if any(it[x : x + 50] in b for x in range(len(it) - 49)):
                want.add((d, i))
    df = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    got = df.collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and want
    own, texts = dict(items), dict(docs)
    assert all(x.run == leaks.longest_run(leaks.bare(own[x.item_id]), leaks.bare(texts[x.doc_id]), 50) for x in got)


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(d, "doc_id", "text", i, "item_id", "text").collect() == []


# ---------------------------------------------------------------- p10


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("가나다라마바사 abc.") for _ in range(n))
    notice, long_notice, passage = text(60), text(120), text(260)
    docs = []
    for d in range(120):
        t = text(r.randrange(0, 500))
        if d % 2:
            t = t[:40] + notice + t[40:]
        if d % 3 == 0:
            t += long_notice + text(30)
        if d % 17 == 0:
            t = passage[r.randrange(40) :] + t
        if d % 29 == 0:
            t += "가" * 300
        docs.append((d, t))
    docs += [(400 + d, docs[d][1]) for d in range(0, 120, 10)] + [(300, None), (301, ""), (302, docs[5][1])]
    return docs


def naive_pairs(docs, n):
    where = {}
    for d, t in docs:
        for x in range(len(t or "") - n + 1):
            where.setdefault(t[x : x + n], set()).add(d)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


@pytest.mark.parametrize(("hot", "context"), [(16, 64), (2, 2), (1, 1)])
def test_shared_pairs(spark, monkeypatch, hot, context):
    monkeypatch.setattr(spans, "HOT", hot)
    monkeypatch.setattr(spans, "HOT_CONTEXT", context)
    docs = corpus(4)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, id int")
    got = [tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == naive_pairs(docs, 200)


def test_shared_amount(spark):
    docs = corpus(6)
    got = {r.doc_id: r for r in spans.shared_amount(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    where = {}
    for d, t in docs:
        for x in range(len(t or "") - 199):
            where.setdefault(t[x : x + 200], set()).add(d)
    for d, t in docs:
        cover = np.zeros(len(t or ""), bool)
        for x in range(len(t or "") - 199):
            if len(where[t[x : x + 200]]) > 1:
                cover[x : x + 200] = True
        assert got[d].shared_chars == cover.sum() and got[d].n_chars == len(t or "")
    rep = {d: got[d].class_id for d, _ in docs}
    near = {(rep[a], rep[b]) for a, b in naive_pairs(docs, 200) if rep[a] != rep[b]}
    for d, _ in docs:
        assert got[d].n_links == len({x for p in near for x in p if rep[d] in p} - {rep[d]})


def test_a_span_of_many_texts_needs_no_pairs(spark):
    r = random.Random(1)
    own = lambda: "".join(r.choice("가나다라마바사 abc.") for _ in range(150))
    notice, other = "".join(r.choice("가나다라") for _ in range(260)), "".join(r.choice("가나다라") for _ in range(230))
    docs = [(d, own() + notice + own() + (other if d % 3 == 0 else "")) for d in range(900)] + [(1000, own() + other)]
    got = {x.doc_id: (x.shared_chars, x.n_links) for x in spans.shared_amount(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect()}
    # what stands before and after a span may agree by chance for some characters
    assert all(got[d][1] == (900 if d % 3 == 0 else 899) and 0 <= got[d][0] - (490 if d % 3 == 0 else 260) < 20 for d in range(900))
    assert got[1000][1] == 300 and 0 <= got[1000][0] - 230 < 10


def test_passages(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("가나다라마바사아자차카타파하 abcdefgh.") for _ in range(n))

    def altered(t, every):
        out = list(t)
        for x in range(every, len(t), every):
            out[x] = r.choice(["", "쀍", "쀍쀍"])
        return "".join(out)

    source = text(400)
    docs = [(d, text(300)) for d in range(50)] + [(100, text(90) + source + text(50)), (101, altered(source, 60) + text(200)), (102, text(100) + altered(source, 90)), (103, text(80) + altered(source, 7)), (104, text(300) + source[:150]), (105, None), (106, ""), (107, docs_7 := text(220)), (108, docs_7)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, begin int")
    got = {(x.doc_id, x.other_id): x for x in spans.passages(df, "doc_id", "text").collect()}
    assert {(101, 100), (102, 100), (108, 107)} <= set(got) <= {(101, 100), (102, 100), (102, 101), (108, 107)}
    x = got[101, 100]
    assert x.begin <= 10 and abs(x.end - 400) < 30 and abs(x.other_begin - 90) <= 10 and abs(x.other_end - 490) < 15 and x.matched > 370
    assert spans.passages(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_passages_are_found_in_all_pairs(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("가나다라마바사아자차카타파하 abcdefgh.") for _ in range(n))

    def altered(t, every):
        return "".join("쀍" if x % every == every - 1 else c for x, c in enumerate(t))

    one, two, phrases = text(260), text(300), [text(r.choice((20, 30, 40))) for _ in range(12)]
    docs = [
        (1, one[:120] + text(300)), (2, text(150) + one[120:]), (3, text(40) + one + text(30)), (4, one + text(60)),  # 1 and 2 hold each seed of 3 and 4
        (5, two), (6, altered(two, 31) + text(20)), (7, text(10) + altered(two, 27)),  # few or none of the stretches of 48 are left
        (8, two), (9, two), (10, (text(30) + "ab") * 3 + two[:210]),
        *((20 + d, "".join(r.choice(phrases) + text(r.choice((0, 5))) for _ in range(12))) for d in range(12)),
    ]
    got = sorted(tuple(x) for x in spans.passages(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").collect())
    want = []
    for a, ta in docs:
        for b, tb in docs:
            if a > b:
                x, y = spans.points(ta), spans.points(tb)
                for held in [[(0, 0, len(x))]] if ta == tb else spans.pieces(spans.segments(x, y, 200, 24)):
                    i, j, ie, je = *held[0][:2], held[-1][0] + held[-1][2], held[-1][1] + held[-1][2]
                    if ie - i >= 200 and (n := spans.matched(x, y, held)) >= 0.8 * max(ie - i, je - j):
                        want.append((a, i, ie, b, j, je, n))
    assert got == sorted(want)
    assert {(4, 3), (9, 8), (8, 5), (7, 5), (9, 7), (10, 9)} <= {(x[0], x[3]) for x in got}


def test_winnow_chooses_alike_in_every_span():
    r = np.random.default_rng(0)
    span = r.integers(0, 3, 200).astype(np.uint32)
    for _ in range(20):
        a = np.r_[r.integers(0, 3, r.integers(0, 99)), span, r.integers(0, 3, r.integers(0, 99))].astype(np.uint32)
        b = np.r_[r.integers(0, 3, r.integers(0, 99)), span].astype(np.uint32)
        assert set(spans.winnow(a)[0]) & set(spans.winnow(b)[0])


def test_chain():
    segs = [(0, 0, 10), (12, 11, 10), (11, 50, 5), (30, 24, 10)]
    score, best = spans.chain(segs)
    assert best == [0, 1, 3] and score == pytest.approx(30 - 0.05 * (2 + 1 + 8 + 3))
    assert spans.chain([]) == (0.0, [])


def test_queries_are_registered():
    from tessera.llm.queries import queries

    assert {f"p{n}_found" for n in (3, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= set(queries())
    assert json.dumps(sorted(queries()))


@pytest.mark.parametrize("n", [5_000, 1])
def test_leaks_with_clashing_names(spark, monkeypatch, n):
    monkeypatch.setattr(leaks, "ITEMS", n)
    t = "가나다라마바사아자차" * 6
    d = spark.createDataFrame([(1, t, 0), (None, t, 0)], "id long, text string, run int")
    i = spark.createDataFrame([(7, t), (7, t), (None, t)], "id long, text string")
    got = leaks.leaks(d, "id", "text", i, "id", "text").collect()
    assert {(r.id, r.item_id, r.run) for r in got} == {(1, 7, 60), (None, 7, 60)}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["p3_found", "p3_audit", "p4_agreement", "p10_found"])
def test_equals_sql(spark, name):
    from tessera.llm import queries
    from tests.oracle import compare, connect

    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None
