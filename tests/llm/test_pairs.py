"""Labelled pairs in 13 languages, of which no sentence stands in any table
(test_texts_are_in_no_table). Items and refusals are dealt in two halves by
position: the cutoffs of pairs.CUTOFFS were chosen on the first, the figures of
the README are those of the second."""

import os
import random

import pytest
from polyquill.llm import pairs
from polyquill.llm.pii_training import PLAIN_FRAMES

CODES = {"English": "en", "Spanish": "es", "Indonesian": "id", "Sundanese": "su", "Hausa": "ha", "Azerbaijani": "az", "Greek": "el", "Arabic": "ar", "Persian": "fa", "Korean": "ko", "Chinese": "zh", "Assamese": "as", "Amharic": "am"}
LANGUAGES = tuple(CODES)
ITEMS = {
    "en": ("a bicycle", "two pencils", "the post office", "wet paint", "chess"), "es": ("una bicicleta", "dos lápices", "la oficina de correos", "ajedrez"), "id": ("sebuah sepeda", "dua pensil", "kantor pos", "catur"), "su": ("hiji sapédah", "dua patlot", "kantor pos téa", "maén catur"),
    "ha": ("wani keke", "fensir biyu", "gidan waya", "dara da kati"), "az": ("bir velosiped", "iki karandaş", "poçt şöbəsi", "şahmat"), "el": ("ένα ποδήλατο", "δύο μολύβια", "το ταχυδρομείο", "σκάκι"), "ar": ("دراجة هوائية", "قلمان", "مكتب البريد", "الشطرنج"),
    "fa": ("یک دوچرخه", "دو مداد", "اداره پست", "شطرنج"), "ko": ("자전거 한 대", "연필 두 자루", "우체국", "바둑"), "zh": ("一辆自行车", "两支铅笔", "邮局", "象棋"), "as": ("এখন চাইকেল", "দুডাল পেঞ্চিল", "ডাকঘৰ", "দবা খেল"), "am": ("አንድ ብስክሌት", "ሁለት እርሳስ", "ፖስታ ቤት", "ቼዝ ጨዋታ"),
}
QUESTIONS = {
    "en": "Which tool does a clerk reach for first?", "es": "¿Qué herramienta usa primero un empleado?", "id": "Alat apa yang pertama dipakai seorang pegawai?", "su": "Parabot naon anu mimiti dipaké ku pagawé?", "ha": "Wane kayan aiki ma'aikaci yake fara ɗauka?", "az": "Məmur əvvəlcə hansı aləti götürür?", "el": "Ποιο εργαλείο παίρνει πρώτα ένας υπάλληλος;",
    "ar": "ما الأداة التي يستعملها الموظف أولا؟", "fa": "کارمند اول کدام ابزار را برمی‌دارد؟", "ko": "직원은 어떤 도구를 먼저 집습니까?", "zh": "职员先拿哪一件工具？", "as": "কৰ্মচাৰীয়ে প্ৰথমে কোনটো সঁজুলি লয়?", "am": "ሠራተኛ መጀመሪያ የትኛውን መሣሪያ ይይዛል?",
}
REFUSALS = {
    "en": ("Unfortunately I am not in a position to respond.", "It would be better to ask somebody else, I have no idea.", "My guidelines keep me from discussing such matters.", "I must decline.", "Honestly, I couldn't tell you.", "There is not enough context for me to reply.", "I'd prefer not to comment on politics.", "That falls outside what I can help with.", "We are unable to provide details.", "Forgive me, this request isn't something I can fulfil."),
    "es": ("Desconozco los detalles de ese asunto.", "Me temo que no sabría decirlo.", "Como IA no debo opinar sobre eso.", "Perdona, no tengo datos suficientes.", "Me niego a contestar.", "No estoy segura de la respuesta."),
    "id": ("Sayangnya saya belum bisa memberi komentar.", "Saya tidak memiliki data yang cukup.", "Saya kurang yakin soal itu.", "Saya menolak untuk menjawab.", "Entah, saya tidak mengetahui hal tersebut.", "Sebagai AI saya tidak boleh berpendapat."),
    "su": ("Punten, abdi teu nyaho.", "Abdi can tiasa ngabahas éta.", "Teu aya data nu cekap pikeun ngajawab.", "Abdi teu wani nyarios.", "Hampura, teu tiasa ngabantos.", "Abdi nolak ngajawab."),
    "ha": ("Ba na iya cewa komai game da wannan.", "Babu isasshen bayani a gare ni.", "Gafara, ban sani ba.", "Na ƙi amsa wannan.", "Ba mu san amsar ba.", "Ba zan yi magana ba a kan haka."),
    "az": ("Təəssüf ki, kömək edə bilmirəm.", "Buna cavab verməkdən imtina edirəm.", "Kifayət qədər məlumat yoxdur.", "Bunu deyə bilmərik, xəbərim yoxdur.", "Mən süni intellektəm, şərh edə bilmirəm.", "Əmin deyiləm."),
    "el": ("Δυστυχώς δεν είμαι σίγουρος.", "Αρνούμαι να σχολιάσω.", "Δεν διαθέτω αρκετά στοιχεία για να απαντήσω.", "Προτιμώ να μην μιλήσω για αυτό.", "Δεν θα μπορούσα να βοηθήσω εδώ.", "Αδυνατώ να απαντήσω."),
    "ar": ("للأسف لست متأكدا من الجواب.", "أرفض التعليق على هذا الأمر.", "أجهل تفاصيل ذلك.", "لا يسمح لي بإبداء الرأي.", "معذرة، لا أقدر على المساعدة هنا.", "ليس عندي بيانات كافية للرد على السؤال."),
    "fa": ("شرمنده، خبر ندارم و نمی‌دانم.", "مطمئن نیستم، نمی‌توانم کمک کنم.", "به عنوان هوش مصنوعی از پاسخ معذورم.", "داده کافی برای جواب ندارم.", "از پاسخ دادن خودداری می‌کنم.", "نمی‌خواهم نظر بدهم."),
    "ko": ("안타깝지만 저는 잘 모르겠습니다.", "관련 자료가 부족해서 설명하기 곤란합니다.", "그 부분은 말씀드릴 수 없네요.", "대답을 거절하겠습니다.", "미안하지만 도와드릴 수 없어요.", "판단하기 어렵습니다."),
    "zh": ("很遗憾，这方面我不太了解，没法答复。", "恕我难以评论。", "我不确定，也不方便讨论。", "这个不好说，缺乏资料。", "不好意思，帮不了这个忙，无法提供帮助。", "我拒绝回应。"),
    "as": ("মাফ কৰিব, মই সহায় কৰিব নোৱাৰোঁ।", "মই নাজানোঁ, আনক সোধক।", "মন্তব্য কৰিবলৈ অপাৰগ।", "জনাবলৈ মোৰ ওচৰত জ্ঞান নাই।", "মই ক'বলৈ অক্ষম।", "মই মন্তব্য নিবিচাৰোঁ দিব।"),
    "am": ("አዝናለሁ፣ ልረዳ አልችልም።", "በቂ እውቀት የለኝም ለመመለስ።", "እኔ አላውቅም፣ ሌላ ሰው ጠይቅ።", "መናገር አልተፈቀደልኝም።", "አስተያየት መስጠት አልፈልግም።", "እርግጠኛ አይደለሁም፣ መልስ የለም።"),
}
#: Sound answers with words of refusals.
HARMLESS = ("Sorry, no coffee is sold after six.", "I can't live without my bicycle.", "I don't know anybody who dislikes chess.", "No shop opens on Monday.", "Unfortunately the paint was wet.", "We have no car, so we cycle.", "Nothing is better than a sharp pencil.", "Pardon me, the answer is the post office.")
LABEL = {"en": "Answer", "es": "Respuesta", "ko": "답변", "fa": "پاسخ", "el": "Απάντηση", "zh": "回答"}


def half(items, k):
    return [x for i, x in enumerate(items) if i % 2 == k]


def sentences(code, k):
    return half([s for s in PLAIN_FRAMES[code] if "{" not in s and "@" not in s and len(s) > 12 and ":" not in s and "—" not in s], k)


def collection(k, n=6000, seed=1):
    """(resp_id, language, question, prompt, response) with their defects."""
    r = random.Random(seed + k)
    rows, truth = [], {}
    for i in range(n):
        lang = r.choice(LANGUAGES)
        c = CODES[lang]
        item = lambda x=c: r.choice(ITEMS[x])
        q, label = QUESTIONS[c], LABEL.get(c, "Answer")
        prompt = f"Be brief.\n\n{q}\n{label}:"
        sentence = lambda x=c: r.choice(sentences(x, k))
        good = r.choice((item(), item() + ".", f"{label}: {item()}", f'{{"answer": "{item()}"}}', sentence(), sentence(), f"1. {item()}\n2. {item()}", f"{item()}, {item()}", sentence() + " 🙂", f"{q}\n{item()}", f"**{item()}**", "18:45"))
        defects = set()
        roll = r.random()
        if roll < 0.04:
            good, defects = r.choice((None, "", " ", "...", "{}", '{"answer": ""}', "N/A", "None", "```json\n```", "—", "​")), {"empty"}
        elif roll < 0.09:
            whole = sentence() + " " + sentence()
            good = r.choice((whole[: r.randint(len(whole) * 2 // 3, len(whole) - 4)], f'["{item()}", "{item()[:3]}', f"1. {item()}\n2. {item()}\n3.", f"{item()} ({item()}", f'{{"answer": "{item()}', f"{item()}, {item()},"))
            defects = {"truncated"}
        elif roll < 0.14:
            s = r.choice(half(REFUSALS[c], k))
            good, defects = r.choice((s, f"{label}: {s}", f'{{"answer": "{s}"}}')), {"refusal"}
        elif roll < 0.18:
            good, defects = r.choice((q, f"{q} {q}", prompt, q.rstrip("?؟;？"), f"{q}\n{label}:")), {"copy"}
        elif roll < 0.22:
            good, defects = sentence(r.choice([x for x in CODES.values() if x != c])), {"other_language"}
        elif roll < 0.25 and lang == "English":
            good = r.choice(half(HARMLESS, k))
        rows.append((i, lang, q, prompt, good))
        truth[i] = (defects, lang)
    return rows, truth


SCHEMA = "resp_id bigint, language string, question string, prompt string, response string"
#: Least precision and recall on the second half.
LEAST = {"empty": (0.99, 0.99), "truncated": (0.9, 0.85), "refusal": (0.9, 0.85), "copy": (0.98, 0.98), "other_language": (0.95, 0.95)}


def figures(spark, k, cutoff):
    rows, truth = collection(k)
    got = {(r.resp_id, r.defect) for r in pairs.defects(spark.createDataFrame(rows, SCHEMA), LANGUAGES, None if cutoff is None else dict.fromkeys(pairs.DEFECTS, cutoff)).collect()}
    want = {(i, d) for i, (ds, _) in truth.items() for d in ds}
    return rows, truth, want, got


@pytest.fixture(scope="module")
def held_out(spark):
    return figures(spark, 1, None)


@pytest.mark.parametrize("defect", pairs.DEFECTS)
def test_held_out_precision_and_recall(held_out, defect):
    _, _, want, got = held_out
    w, g = ({x for x in s if x[1] == defect} for s in (want, got))
    precision, recall = LEAST[defect]
    assert len(w & g) >= precision * len(g) and len(w & g) >= recall * len(w), (defect, len(w), len(g), len(w & g))


def test_texts_are_in_no_table(data):
    import pyarrow.parquet as pq

    folder = data.replace("sf0.001", "sf0.1")
    whole = "\n".join({s for t, c in (("model_inference_results", "response"), ("model_inference_results", "question"), ("documents", "text")) for s in pq.read_table(f"{folder}/{t}.parquet", columns=[c]).column(0).to_pylist() if s}) if os.path.isdir(folder) else ""
    for s in (*HARMLESS, *QUESTIONS.values(), *(x for xs in REFUSALS.values() for x in xs)):
        assert s.rstrip(".。।።?？؟;") not in whole, s


def test_edges(spark):
    rows, _ = collection(0, 600)
    edge = [(9001, "English", None, None, None), (9001, "English", None, None, None), (9002, None, None, None, "kite flying"), (9003, "Klingon", "q", "p", "text"), (9004, "English", "What?", "What?", "x" * 30000), (9005, "English", "", "", "")]
    df = spark.createDataFrame(rows + edge, SCHEMA).selectExpr("*", "'x' AS defect", "1 AS empty")
    got = [(r.resp_id, r.defect) for r in pairs.defects(df, LANGUAGES).collect()]
    assert len(got) == len(set(got)) and (9001, "empty") in got and (9005, "empty") in got
    assert not {d for i, d in got if i in (9002, 9003)}
    assert pairs.defects(df.limit(0), LANGUAGES).count() == 0


def test_long_texts_take_linear_time():
    import time

    labeller = pairs.Labeller(pairs.Collection([], LANGUAGES))
    began = time.time()
    for text in ('"' * 30000 + "x", "a" + " " * 30000 + "b", "🙂" * 30000 + "x", "*" * 30000 + "a", "\n" * 30000 + "a", "(a " * 9000, "i do not " * 4000, "no puedo " * 4000, "답수" * 9000):
        labeller.votes("English", text, text, text)
    assert time.time() - began < 15


def test_statistics_do_not_depend_on_the_vocabulary():
    """A word's evidence is the same beside few and beside many other words."""
    few = [("word", x, "hearth" if x == "English" else "hogar", 500, 0) for x in ("English", "Spanish")] + [("total", x, "", 100_000, 0) for x in ("English", "Spanish")]
    many = few + [("word", x, f"{x}{i}", 12, 0) for x in ("English", "Spanish") for i in range(8000)]
    scores = [pairs.Collection(s, ("English", "Spanish")).margins(["hearth"], "Spanish")[0] for s in (few, many)]
    assert scores[0] == scores[1] > 2


def test_label_model_recovers_rates():
    r = random.Random(3)
    patterns = {}
    for _ in range(20000):
        y = r.random() < 0.1
        v = tuple(pairs.YES if r.random() < (0.9 if y else 0.02) else pairs.NO for _ in range(3))
        patterns[v] = patterns.get(v, 0) + 1
    m = pairs.LabelModel(3).fit(patterns)
    assert abs(m.prior - 0.1) < 0.02 and abs(m.table[1][0][pairs.YES] - 0.9) < 0.05
    assert m.posterior((1, 1, 2)) > 0.9 > 0.2 > m.posterior((1, 2, 2))
    assert m.posterior((0, 0, 0)) == pytest.approx(m.prior) and m.posterior((2, 2, 2)) < m.prior


@pytest.mark.parametrize(("text", "stop"), [("a b.", True), ("a b", False), ("a b. 🙂", True), ("a b. (½ kg)", True), ("a b. [m²]", True), ('say "a b."', True), ("年糕。", True), ("a (b)", False), ("", False), ("a,", False)])
def test_ends_with_stop(text, stop):
    assert pairs.ends_with_stop(text) is stop
