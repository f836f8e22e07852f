import pytest
from polyquill.llm import lookalikes as L

BASE = {
    "English": ["the goat cheese and oat biscuit of the harvest supper"] * 50, "Greek": ["το κατσικίσιο τυρί και το ψάθινο καπέλο"] * 50, "Spanish": ["muñeca de trapo y té de menta en la calle"] * 50,
    "Arabic": ["تختار معظم العائلات حديقة المدرسة عندما يصل الضيوف في المساء ناي القصب كعك مربى"] * 50, "Persian": ["بیشتر خانواده‌ها کیک گردو و چای نعنا را انتخاب می‌کنند مربای آلبالو"] * 50,
    "Korean": ["할머니는 언제나 호박죽 곁에 연날리기을 두셨습니다 and more"] * 50, "Chinese": ["我的回答是年糕，可是表弟的回答是水饭。"] * 50, "Azerbaijani": ["Uşaqlar məktəbə getməzdən əvvəl külöş çörəyi bilirlər"] * 50, "Assamese": ["আলহী আহিলে বেছিভাগ পৰিয়ালে চাউলৰ পিঠা আগবঢ়ায়"] * 50,
}


@pytest.fixture(scope="module")
def rewriter(spark):
    rows = [(lang, t) for lang, ts in BASE.items() for t in ts]
    return L.learn(spark.createDataFrame(rows, "language string, text string"), tuple(BASE))


@pytest.mark.parametrize(("language", "text", "form"), [
    ("English", "\u00a0", " "), ("English", "\u200b\ufeff", ""),
    ("English", "oat biscuit", "oat biscuit"), ("English", "g​oat che­ese﻿", "goat cheese"), ("English", "ｏａｔ 12", "oat 12"), ("English", "gоat chеese", "goat cheese"), ("English", "аре", "ape"),
    ("English", "ﬁne ﬂute", "fine flute"), ("Spanish", "té de meñta", "té de meñta"), ("Greek", "τυρi και", "τυρι και"), ("Greek", "ψάθινο", "ψάθινο"), ("Persian", "كيك گردو", "کیک گردو"), ("Arabic", "حدیقة المدرسة", "حديقة المدرسة"),
    ("English", "بیشتر خانواده‌ها كیک گردو را انتخاب می‌کنند", "بیشتر خانواده‌ها کیک گردو را انتخاب می‌کنند"), ("Arabic", "ﺍﻝﻤﺪرسة", "المدرسة"), ("Korean", "호박죽", "호박죽"), ("Korean", "연날리기　을", "연날리기 을"), ("Chinese", "⽔饭", "水饭"), ("Azerbaijani", "kәnd", "kənd"), ("Arabic", "حديقة المد\u200cرسة عندما", "حديقة المدرسة عندما"),
])
def test_cases(rewriter, language, text, form):
    assert rewriter.rewrite(text, language) == form


@pytest.mark.parametrize(("language", "text"), [
    ("English", "plain text"), ("English", "naïve café ½ m² 👨‍👩‍👧 🙂"), ("English", "Москва река"), ("Greek", "village fair (τυρί)"), ("Persian", "می‌کنند طناب‌بازی"), ("Persian", "چای نعنا را انتخاب می\u200c"), ("Arabic", "مربى التين، كعك؟"), ("Chinese", "年糕，水饭。　好：？"),
    ("Chinese", "muñeca, té"), ("English", '{"answer": "\\u0627"}'), ("Spanish", "¿Qué té?"), ("Assamese", "পৰিয়ালে আগবঢ়ায়"), ("English", " "), ("English", ""), ("Korean", "plum jam 연"), ("Azerbaijani", "əöüşçğı İ"),
])
def test_no_cases(rewriter, language, text):
    assert rewriter.rewrite(text, language) == text


def test_union_find_is_transitive():
    u = L.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c")):
        u.union(a, b)
    assert [sorted(c) for c in u.classes()] == [["a", "b", "c", "d"]]


def test_frames(spark, rewriter):
    rows = [("answers", 1, 0, 0, "English", "g​oat"), ("answers", 1, 0, 1, None, None), ("response", 2, -1, -1, "unknown", "oat x"), ("response", 3, -1, -1, "English", "")]
    df = spark.createDataFrame(rows, "origin string, rec_id bigint, grp int, item int, language string, text string").selectExpr("*", "'z' AS form")
    assert {(r.rec_id, r.item, r.form) for r in L.rewrite(df, rewriter).collect()} == {(1, 0, "goat"), (1, 1, None), (2, -1, "oat x"), (3, -1, "")}
    assert L.rewrite(df, rewriter, changed_only=True).count() == 2
    empty = L.learn(df.limit(0), ("English",))
    assert empty.rewrite("gоat", "English") == "goat"


def test_answers(spark):
    ann = spark.createDataFrame([(1, "X", [(["a", None], None, 1), None, (None, ["e"], None), (["b"], None, None)]), (2, None, None)], "ann_id bigint, country string, annotations array<struct<answers:array<string>,en_answers:array<string>,count:bigint>>")
    countries = spark.createDataFrame([("X", "English")], "country string, language string")
    assert {(r.grp, r.item, r.text, r.language) for r in L.answer_texts(ann, countries).collect()} == {(0, 0, "a", "English"), (0, 1, None, "English"), (3, 0, "b", "English")}
