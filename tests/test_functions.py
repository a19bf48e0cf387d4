"""Scalar functions against plain Python on strings that are hard."""

import hashlib
import json
import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgeline.functions import answers, checklist, identity, prompts, text

STRINGS = [
    "", " ", None, "3 × 4 ÷ 2 − 1", "1,234,567 and 12,34", "４２ ｋｇ", "a b\u001cc", "Straße İstanbul ǅ", "3 = 4 ( x )", "In London, v2.0 costs .5 or 1e-3; 3-2, A1",
    "Élan Vital Élan abc Ab Abc", "x y", "ﬁne ①", "<think>no</think> yes #### 5", "<|User|> <<1+1=2>>", "٣ ١٢",
]


TIGHT = set(",.;:!?=+-*/^(){}[]")


def py_norm_v0(t):
    return " ".join(t.lower().split())


def word_like(c):
    return c.isalnum() or c == "_"


def py_norm_v1(t):
    """Word by word instead of by patterns."""
    t = unicodedata.normalize("NFKC", t).casefold().translate({0x2212: "-", 0xD7: "*", 0xF7: "/"})
    kept = []
    for i, c in enumerate(t):
        group = t[i + 1 : i + 4]
        in_number = i > 0 and t[i - 1].isdecimal() and len(group) == 3 and all(d.isdecimal() for d in group)
        if c != "," or not in_number or (i + 4 < len(t) and word_like(t[i + 4])):
            kept.append(c)
    out = ""
    for w in "".join(kept).split():
        out += w if not out or out[-1] in TIGHT or w[0] in TIGHT else " " + w
    return out


def py_template(t):
    def masked(m):
        w = m.group()
        return "<name>" if len(w) > 2 and w.isascii() and w.isalpha() and w == w.capitalize() else w

    named = re.sub(r"\w+", masked, unicodedata.normalize("NFKC", t))
    return py_norm_v1(re.sub(text.TEMPLATE_NUMBER.removeprefix("(?U)"), "<number>", named))


def same(got, f, strings=STRINGS):
    assert got == [None if s is None else f(s) for s in strings]


def test_norms(values):
    same([v for v in values(text.norm_v0, [s for s in STRINGS if s is None or "İ" not in s])], py_norm_v0, [s for s in STRINGS if s is None or "İ" not in s])
    same(values(text.norm_v1, STRINGS), py_norm_v1)
    same(values(text.template_norm, STRINGS), py_template)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=60))
def test_norm_v1_any_text(values, strings):
    same(values(text.norm_v1, strings), py_norm_v1, strings)


def test_norm_is_idempotent(values):
    once = values(text.norm_v1, [s for s in STRINGS if s])
    assert values(text.norm_v1, once) == once


def test_hashes(values):
    sha = lambda *p: "sha256:" + hashlib.sha256("\x1f".join(p).encode()).hexdigest()
    same(values(identity.content_hash, STRINGS), lambda s: sha("canonical-content", "norm-v1", py_norm_v1(s)))
    same(values(identity.template_fingerprint, STRINGS), lambda s: sha("template", "norm-v1", py_template(s)))
    same(values(lambda c: identity.message_hash(c, F.lit("user")), STRINGS), lambda s: sha("message", "norm-v1", "user", py_norm_v1(s)))
    same(values(identity.source_family, STRINGS), lambda s: sha("source-family", "norm-v1", s))
    assert values(lambda c: identity.row_id(c, F.lit(None), c, c), ["a"]) == [None]


def test_family_needs_one_kind_of_input(spark):
    df = spark.createDataFrame([("k", "", None), ("", "t", "s")], "k string, t string, s string")
    a, b = [r.v for r in df.select(identity.family_id(F.col("k"), F.col("t"), F.col("s")).alias("v")).collect()]
    assert a != b
    import pytest

    bad = spark.createDataFrame([("k", "t", "s")], df.schema)
    with pytest.raises(Exception, match="source key"):
        bad.select(identity.family_id(F.col("k"), F.col("t"), F.col("s"))).collect()


def test_constraint_signatures_agree(spark):
    items = [{"id": "b", "parameters": {"z": "é", "a": 'q"'}}, {"id": "a"}]
    want = json.dumps(sorted(({"id": i["id"], "parameters": i.get("parameters", {})} for i in items), key=lambda i: i["id"]), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    want = "sha256:" + hashlib.sha256(f"constraints\x1fnorm-v1\x1f{want}".encode()).hexdigest()
    df = spark.createDataFrame([(json.dumps(items), [(i["id"], i.get("parameters")) for i in items])], "j string, a array<struct<id:string,parameters:map<string,string>>>")
    r = df.select(identity.constraint_signature(F.col("j")).alias("j"), identity.constraint_signature_flat(F.col("a")).alias("a")).first()
    assert r.j == want and r.a == want


def test_prompt_shapes(values):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "x"}, {"role": "user", "content": "b"}], "question": "q"},
        {"example": {"question": "q", "choices": ["c"]}},
        {"example": {"question": " ", "premise": "p", "hypothesis": "h"}},
        {"en": "e", "am": "አ"},
        {"prompt": " ", "text": "t"},
        {"premise": "p", "hypothesis": "h"},
        {"premise": "p"},
        {"other": 1},
        {"question": 5, "input": "i"},
    ]
    got = values(prompts.prompt_v1, [json.dumps(r, ensure_ascii=False) for r in records])
    assert got == ["a\nb", 'q\n["c"]', "p\nh", "e\nአ", "t", "p\nh", "p", None, "i"]
    v0 = values(prompts.prompt_v0, [json.dumps(r, ensure_ascii=False) for r in records[:2]] + ['{"b": 1, "a": "x"}'])
    assert v0 == ["q", "q", '{"a":"x","b":1}']


def test_gold_and_prediction(spark):
    df = spark.createDataFrame([(None, '{"answer": " ", "target": "7"}'), ("5", None), (" ", "no json")], "a string, r string")
    assert [r.v for r in df.select(prompts.gold_answer(F.col("a"), F.col("r")).alias("v")).collect()] == ["7", "5", ""]


def test_normalize_answer(values):
    cases = {"a</think>b</think> is 1,234.": "1234", "-3.50 x": "-3.50", "none Here": "here", "": "", None: "", "  ": "", "1 2 3": "3"}
    assert values(answers.normalize_answer, list(cases)) == list(cases.values())


SOLUTIONS = {
    "3+2 = <<3+2=5>>5": "1. 3+2 = 5",
    "9*2 = $<<9*2=18>>18 dollars": "1. 9*2 = $18 dollars",
    "x = <<1+1=2>>3": "1. x = 2 (3)",
    "so <<4*4=16>> it is": "1. so 4*4 = 16 it is",
    "a = <<2*2=4>>": "1. a = 4",
    "1. one\ntwo\n\n\n\n#### 1,234": "1. one\n2. two\n3. ,234\n\nFinal answer: 1",
    "a=b c=<<1+2=3>>3.5": "1. a= b c= 3 (3.5)",
    "= <<1.5*2=3>>3.": "1. = 3.",
    "one\u2028 two\u000bthree \x85 7) four": "1. one\n2. two\n3. three\n7) four",
    "": "",
    "#### -7": "\n\nFinal answer: -7",
}


def test_clean_solution(values):
    assert values(answers.clean_solution, list(SOLUTIONS)) == list(SOLUTIONS.values())
    assert values(answers.clean_solution, [None]) == [""]


def test_spans_hint_wrong_diagnosis(spark, values):
    assert [[(s.expr, s.val) for s in v] for v in values(answers.spans, ["a << 1+1 = 2 >> <<3=3>>", "none"])] == [[("1+1", "2"), ("3", "3")], []]
    assert values(answers.wrong_answer, ["0", "5", "-1", "2.5", "0.0", None, "9" * 50, "x"]) == ["-1", "6", "0", "3.5", "-1.0", None, None, None]
    assert values(answers.final_answer, ["#### 1,234", "no", "#### -2.5"]) == ["1", None, "-2.5"]
    assert values(answers.final_answer_with_commas, ["#### 1,234"]) == ["1234"]
    df = spark.createDataFrame([("3 and 4", "<<3+4=7>>7 #### 7"), ("3 and 4", ""), ("none", None)], "q string, a string")
    rows = df.select(answers.hint(F.col("q"), F.col("a")).alias("h"), answers.diagnosis(F.col("q"), F.col("a")).alias("d")).collect()
    assert "3+4" in rows[0].h and "3 and 4" in rows[1].h and rows[2].h == answers.HINTS["general"]
    assert "8" in rows[0].d.user and rows[1].d is None and rows[2].d is None


def test_letters(values):
    assert values(answers.choice_letter, [" b) x", None, ""]) == ["B", "", ""]
    assert values(answers.gold_letter, ["0", "3", "4", "c", ""]) == ["A", "D", "4", "C", ""]


def test_number_mentions(values):
    f = lambda c: answers.mentions_number(c, F.lit("9"))
    cases = {"it is 9": True, "9.0 m": True, "Nine!": True, "18/2 of it": True, "19": False, "133": False, "9.5": False, "x9": False, "1/0": False, "９ km": True, "٣/٣ ٩": False, "": False}
    assert values(f, list(cases)) == list(cases.values())
    assert values(lambda c: answers.mentions_number(c, F.lit("1234")), ["so 1,234 left", "11,234"]) == [True, False]


def test_artifacts_and_previews(values):
    assert values(text.find_artifact, ["a </THINK> ####", "<|User|>", "none", None]) == ["</THINK>", "<|User|>", None, None]
    assert values(text.preview, ["x" * 300, None]) == ["x" * 240, ""]
    assert values(text.strip_think, ["a</think> b ", "c"]) == ["b", "c"]
    assert values(text.script_share, ["አአab", "", "12"]) == [0.5, 0.0, 0.0]


def test_protected_markup_comes_back(spark):
    cases = ["a <<1=1>> b #### 5 <<2=2>>", "none", "####", ""]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    marked, spans = text.protect(F.col("c"))
    rows = df.select(marked.alias("m"), spans.alias("s")).select("m", text.restore(F.col("m"), F.col("s")).alias("back")).collect()
    assert [r.back for r in rows] == cases and not any("##" in r.m or "<<" in r.m for r in rows)


def test_checks(values):
    positive = {
        "no_markup": "plain", "no_final_x": "x is", "no_final_a": "a is", "has_why": "BECAUSE", "has_question": "?", "has_two_questions": "??", "names_mistake": "Wrong",
        "has_hint": "divide", "mentions_turbine": "Turbine", "mentions_energy": "energy", "mentions_force_or_power": "power", "has_analogy": "like a", "has_misconception": "people think",
        "velocity_zero": "velocity is zero", "accel_nonzero": "acceleration still there", "completing_square": "complete the square", "has_final_formula": "over 2a, b²", "limiting_oxygen": "O2",
        "co2_33": "has 33 g", "line1_or_distribute": "distribute",
    }
    negative = {"no_markup": "#### 5", "no_final_x": "x = 5", "no_final_a": "A = -2", "co2_33": "133", "has_two_questions": "?", "velocity_zero": "velocity", "accel_nonzero": "acceleration is zero"}
    assert set(positive) == set(checklist.CHECKS) and len(positive) == 20
    for name, t in positive.items():
        assert values(lambda c, n=name: checklist.check(n, c), [t]) == [True], name
    for name, t in negative.items():
        assert values(lambda c, n=name: checklist.check(n, c), [t]) == [False], name
    assert values(lambda c: checklist.check("unknown", c), ["x"]) == [False]
    assert values(lambda c: checklist.check_named(F.lit("has_question"), c), ["?", None]) == [True, False]


def test_intents_and_maps(spark):
    r = spark.range(1).select(
        prompts.intent_allowed(F.lit("tell"), F.lit("reveal_step")).alias("a"),
        prompts.intent_allowed(F.lit("tell"), F.lit("encourage")).alias("b"),
        prompts.intent_allowed(F.lit("no"), F.lit("x")).alias("c"),
        prompts.sums_to(F.create_map(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.5))).alias("d"),
        prompts.same_keys(F.create_map(F.lit("a"), F.lit(1)), F.array(F.lit("a"), F.lit("a"))).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, False, True, True)
