"""Personal information in free text (problem 8).

Generators with high recall propose overlapping spans: e-mail addresses, runs of
digits, street addresses with a number, runs of capitalised words, words after
labels, titles, speakers, cue words and dashes, entries of the name lexicon, and
surnames of scripts without blanks or capitals. For each kind, boosted trees
judge a span by its format and its context, and the spans above the kind's
threshold that overlap no better one stand. A text is cut into tokens once;
generators and features look tokens up in sets, so a text takes linear time.

There are no labelled texts, so the trees are fitted on the texts of
`pii_training` (TRAIN_TEXTS of them, a fixed bound), whose frames, names and
streets occur in no table. Whole frames and names are kept out to choose the
thresholds, and others to measure on (`Redactor.validation`). The trees see
whether a word is in the lexicon, not which word it is, so they do not depend
on the collection and are fitted once per process.

Defined results: null and empty texts give nothing; positions count code points
from 0; overlapping kinds are settled by the higher margin over the threshold;
repeated rows each give their spans. A run of more than six capitalised words
is proposed in all pieces of up to six words and as a whole.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyquill.llm.boosting import BoostedTrees
from polyquill.llm.pii_training import Maker, common_names

KINDS = ("email", "phone", "id", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Texts the trees are fitted on; as many again set thresholds and are measured.
TRAIN_TEXTS = 3000
SEED = 12

# Words that label each kind, by language (en es id su ha az el ar fa ko zh as am).
LABELS = {
    "email": "email|e-mail|mail|contact|reply-to|from|to|write to|mail me at|correo|correo electrónico|surel|surélék|imel|e-poçt|ηλεκτρονική διεύθυνση|البريد|البريد الإلكتروني|ایمیل|رایانامه|이메일|전자우편|邮箱|电子邮件|ইমেইল|ኢሜይል",
    "phone": "phone|tel|tel.|telephone|mobile|cell|call|call me|dial|text|ring|fax|whatsapp|number is|teléfono|móvil|celular|telepon|hp|waya|telefon|mobil|τηλέφωνο|κινητό|الهاتف|هاتف|جوال|تلفن|موبایل|전화번호|전화|휴대폰|电话|手机|ফোন|ফোন নম্বৰ|ስልክ|ስልክ ቁጥር",
    "id": "id|id no|id no.|id number|national number|national id|identity number|passport|passport number|passport no|passport no.|social security number|social security no|social security no.|ssn|taxpayer|licence|license|registered under|insurance no|tax no|número de identidad|documento|dni|nie|nomor ktp|ktp|nik|nomer ktp|lambar shaida|şəxsiyyət nömrəsi|αριθμός ταυτότητας|ταυτότητα|رقم الهوية|رقم بطاقة التعريف|شماره ملی|کد ملی|주민번호|주민등록번호|证件号|身份证|身份证号|পৰিচয় নম্বৰ|መታወቂያ ቁጥር",
    "address": "address|deliver to|send to|sent to|lives at|live at|moved to|home|dirección|domicilio|alamat|adireshi|ünvan|οδός|διεύθυνση|العنوان|نشانی|آدرس|주소|地址|住址|ঠিকনা|አድራሻ",
    "name": "name|interviewer|interviewee|annotator|speaker|signed|author|contact person|yours|regards|nombre|nama|ngaran|suna|ad|όνομα|الاسم|نام|이름|성명|姓名|名字|নাম|ስም",
    "other": "order|order no|order no.|invoice|table|version|form|round|checksum|question|page|chapter|section|costs|price|ticket|votes|room|bus|step|figure|item|parcel|batch|isbn|serial number|about|factura|faktur|faktura|فاکتور|الفاتورة|청구서|发票|চালান|ደረሰኝ|τιμολόγιο",
}
_WORDS = {k: frozenset(v.split()) for k, v in {
    # Words around names, by use.
    "title": "mr mrs ms miss mx dr prof professor sir madam captain father sister uncle aunt sr sra srta señor señora don doña profesor profesora doctor doctora bapak bapa ibu pak bu pa mang kang teh ceu malam malama alhaji hajiya mallam cənab xanım müəllim bəy κ κα κος κύριος κυρία κύριο τον την ο η السيد السيدة الأستاذ الأستاذة الدكتور الشيخ آقای خانم دکتر استاد ato አቶ ወይዘሮ ወይዘሪት ዶክተር শ্ৰী শ্ৰীমতী শ্ৰীমান ডাঃ",
    "kin": "neighbour neighbor friend cousin colleague teacher brother sister mother father uncle aunt husband wife son daughter tutor boss nephew niece grandmother grandfather landlord landlady vecino vecina amigo amiga hermano hermana primo prima tetangga teman saudara tatangga babaturan maƙwabcina maƙwabci abokina aboki qonşum dostum γειτόνισσά γείτονας φίλος φίλη μου جاري جارتي صديقي صديقتي أخي أختي همسایه‌ام همسایه دوستم دوست برادرم خواهرم 이웃 친구 邻居 朋友 同事 চুবুৰীয়া বন্ধু ጎረቤቴ ጓደኛዬ ወንድሜ እህቴ",
    "cue": "by with called named met to told asked dear and from for is am was me my llamo llaman llama con a conocí hablé bertemu hubungi saya jeung abdi panggih da sunana sunanta adım ilə adı λένε με στον στην اسمي اسمه اسمها التقيت با نام من 이름은 叫 নাম কালি ስሜ according thanks ask spoke introduced signed saw know belong via",
    "place": "in at near of on the en de di ka ti a στο στη στην από في من إلى در از 에서 在",
    "saint": "saint st san santa santo sankt the their this that these every",
    "verb": "said says told wrote writes answered asked asks thinks thought lives lived grew explained added noted marked sent sends brought recalled remembered believes claims reviewed read repeated confirmed insisted smiled laughed called checked agreed disagreed cooks repairs runs works drives taught teaches moved will has had was is can would and who signed knows likes wants came went left found gave took kept helped replied dice dijo me contó firmó trabaja vive mengatakan berkata pindah mengajar nyarios ya ta yana tana dedi deyir είπε λέει δουλεύει قال قالت يصلح گفت می‌گوید است 씨 님 씨가 씨를 선생님이 선생님 말했습니다 አለ አለች ክ'লে",
    "notpeople": "day soup bread rice stew cake tea pie oil trees street road lane close walk avenue island river festival feast fair market jam syrup salad sauce school church bridge company bank valley station park museum hotel university county bay hill lake mountain street's",
    "say": "said says told asked met قال قالت وقع تعمل التقيت",
    "particle": "de la del van von der bin ibn al el da dos di",
    "common": "the a an this that these those my our his her your their we i you he she it they in on at for from by with after before during when while since every most nobody everybody everyone which what who how why where as if it's to of and but or not no yes there here now then today yesterday tomorrow many few some any all each both please ask read see call write send deliver address reply have has had is are was were do does did can could will would should may might must let half about around although though because since until unless however meanwhile most nobody no-one someone several other another such only just even still also very more less than so up out into over under between through across yo mi mis el la los las un una unos es son en con por para cuando como donde desde nadie todos todo muchos saya kami kita mereka dan di ke yang ini itu untuk dengan pada kuring urang jeung nu ieu éta lamun ni na mu su da don idan wannan mən biz siz onlar bu o və üçün hər çox εγώ εμείς αυτός το τα οι ο η τον την στο στη και όταν κάθε πολλοί",
    "places": "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday mondays tuesdays sundays saturdays fridays english french german spanish korean chinese arabic greek easter christmas ramadan europe africa asia america england france germany spain italy portugal greece turkey russia china japan korea india iran egypt algeria nigeria ethiopia kenya indonesia mexico canada brazil peru chile norway sweden netherlands belgium poland london paris rome madrid berlin athens cairo tehran lagos abuja seoul beijing tokyo delhi oxford boston chicago",
}.items()}
#: After these a word of a script without capitals may be a name unheard of.
_STRONG_CUES = _WORDS["title"] | _WORDS["kin"] | _WORDS["say"] | frozenset("اسمي اسمه اسمها التقيت نام اسم 이름은 নাম ስሜ".split())
_CUES = frozenset().union(*(_WORDS[k] for k in ("title", "kin", "cue", "say")))
#: Common surnames of Korea and China, one syllable each.
KOREAN_SURNAMES = frozenset("김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진나엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용")
CHINESE_SURNAMES = frozenset("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文")
#: Characters around a name in Chinese text, and endings after one in Korean text.
_HAN_BEFORE, _HAN_AFTER = frozenset("和与跟给叫是问对找向由请同让见友居师给到"), frozenset("和与跟的说是在先女老同来去也都一住会要，。、：:！？ \n")
_KOREAN_ENDINGS = ("에게", "이가", "이는", "입니다", "이고", "이라고", "은", "는", "이", "가", "을", "를", "와", "과", "의", "도", "씨", "님")

# Street words.
_STREET_LAST = "street|st|road|rd|lane|ln|avenue|ave|close|walk|way|drive|dr|court|ct|terrace|square|place|pl|row|hill|gardens|crescent|mews|alley|boulevard|blvd|parkway|pkwy|circle|trail|grove|parade|view|rise|green|quay|wharf|highway|hwy|plaza|loop|park|pike|path|bend|heights"
_NUM = r"\d{1,5}[A-Za-z]?(?![\d])"
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_L = r"[^\W\d_][^\s\d,،.:;()\[\]]*"
_TOWN = rf"(?:,? {_CAP}(?: {_CAP})?(?:,? [A-Z]{{2}}(?: \d{{5}})?)?)"
_NUMBER_FIRST = re.compile(
    rf"(?:(?i:Flat|Apt\.?|Apartment|Unit|Suite|House)\s{_NUM},?\s)?(?i:No\.?\s)?{_NUM},?\s(?:[NSEW]\.?\s)?(?:{_CAP} ){{1,4}}(?i:{_STREET_LAST})\b\.?(?:,?\s(?i:Apt|Flat|Unit|Suite|#)\.?\s?{_NUM})?(?:,{_TOWN})?"
)
_STREET_FIRST_WORDS = frozenset("calle avenida avda av plaza paseo camino carrera carretera jl jalan gg gang οδός λεωφόρος λεωφ πλατεία titin layin lamba unguwar شارع طريق حي نهج خیابان کوچه بلوار میدان rue via".split())
_HOUSE_WORDS = frozenset("flat apt apartment unit suite no house".split())
_STREET_WORDS = _STREET_FIRST_WORDS | frozenset("gida lamba ঘৰ የቤት house küçəsi prospekti döngəsi küç pr".split())
_STREET_FIRST = re.compile(rf"{_L}\.?[ \xa0](?:{_L}[. \xa0،,]+){{0,5}}?(?:(?:No|Nº|nº|núm|رقم|شماره|پلاک|αρ)\.?[ \xa0]?)?{_NUM}(?:,[ \xa0]?(?:mənzil[ \xa0]|واحد[ \xa0])?{_NUM}\.?[ºª]?(?:[ \xa0][A-Z]\b)?|(?:,|،)[ \xa0](?:RT|RW|Désa|{_CAP})(?:[ /]{_CAP}|[ \xa0]\d+|/RW \d+)*)?", re.IGNORECASE)
_HOUSE_FIRST = re.compile(rf"(?:Gida(?: mai lamba)?|Lamba|ঘৰ নং|የቤት ቁጥር|House no\.?) {_NUM},? {_L}(?: {_L}){{0,3}}", re.IGNORECASE)
_AZERI = re.compile(r"(?:küçəsi|prospekti|döngəsi|küç\.|pr\.)\s\d{1,5}(?:,\s?mənzil\s\d+)?", re.IGNORECASE)
_KOREAN = re.compile(rf"(?:[가-힣]{{1,10}}(?:도|시|군|구|읍|면)\s){{0,4}}[가-힣0-9]{{1,12}}(?:로|길|동|번길)\s{_NUM}(?:번길 \d+)?(?:-\d+)?(?:,?\s\d+호)?")
_CHINESE = re.compile(r"(?:[一-鿿]{2,8}?(?:省|市|区|县|镇))*[一-鿿]{1,10}(?:路|街|巷|道|弄|大道)\d+号(?:\d+(?:单元|室|栋|楼|号))*")
_CHINESE_TOWN = re.compile(r"[一-鿿]{2,3}(?:省|市|县)")

_EMAIL = re.compile(
    r"(?<![^\W_])(?<![._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*"
    r"(?:[@＠]|\s?[\(\[{]\s?at\s?[\)\]}]\s?|\s(?:at|arroba)\s(?=[A-Za-z0-9-]+\s?(?:\.|[\(\[{]\s?dot\s?[\)\]}]|\sdot\s|\spunto\s)))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[\(\[{]\s?dot\s?[\)\]}]\s?|\s(?:dot|punto)\s)[A-Za-z0-9-]+)+",
    re.IGNORECASE,
)
_AT = re.compile(r"[@＠]|[\s(\[{](?:at|arroba)[\s)\]}]", re.IGNORECASE)
_DIGITS = re.compile(r"(?<![^\W_])(?:[A-Z]{1,3}\d{0,2}[- ]?)?(?:\+\s?|\((?=\+?\d{1,5}\)))?\d++(?:(?:[-. /]|\)[ -]?| ?\()\d++)*(?:[- ]?[A-Z])?(?![^\W_])")


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{chr(x)}-{chr(y)}" for x, y in out)


#: Tokens: 1 word with a capital, 2 other word of a script with capitals, 3 word
#: of a script without, 4 number, 5 line break, 6 any other mark.
_MARKS = _ranges([c for c in range(0x300, 0x3000) if unicodedata.category(chr(c))[0] == "M"])
_UPPER = _ranges([c for c in (*range(0x41, 0x590), *range(0x1E00, 0x2000)) if chr(c).isupper() or chr(c).istitle()])
_LOWER = _ranges([c for c in (*range(0x41, 0x590), *range(0x1E00, 0x2000)) if chr(c).isalpha() and not (chr(c).isupper() or chr(c).istitle())])
_REST = rf"[^\W\d_]*+(?:[{_MARKS}]++[^\W\d_]*+|['’\-‌](?=[^\W\d_])[^\W\d_]*+)*+"
_TOKEN = re.compile(rf"([{_UPPER}]{_REST})|([{_LOWER}]{_REST})|([^\W\d_]{_REST})|(\d+)|([\r\n]+)|(\S)")
_STOPS, _DASHES, _OPEN, _CLOSE = frozenset(".!?。।።؟？！…"), frozenset("—–-"), frozenset("(<[（「«\"“'‘*"), frozenset(")>]）」»\"”'’*")

Span = tuple[int, int, str, int, int, int]  # start, end, kind, generator, first and last token


class Tokens:
    """A text cut into tokens: starts, ends, kinds, and words in lower case."""

    __slots__ = ("end", "kind", "low", "n", "start", "text", "word")

    def __init__(self, text: str) -> None:
        self.text = text
        found = [(m.start(), m.end(), m.lastindex, m.group()) for m in _TOKEN.finditer(text)]
        self.start, self.end, self.kind, self.word = map(list, zip(*found, strict=True)) if found else ([], [], [], [])
        self.low = list(map(str.lower, self.word))
        self.n = len(found)


@cache
def _lexicon_index(lexicon: tuple[tuple[str, str], ...]) -> Index:
    """Lower-case entry -> bits (1 given, 2 family), and the length of the longest entry in Chinese characters."""
    bits: dict[str, int] = {}
    for name, role in lexicon:
        bits[name.lower()] = bits.get(name.lower(), 0) | (2 if role == "family" else 1)
    return bits, max((len(n) for n in bits if n and "㐀" <= n[0] <= "鿿"), default=0)


CAP, LOW, UNCASED, NUMBER, LINE, MARK = 1, 2, 3, 4, 5, 6


def _runs(t: Tokens) -> Iterator[list[int]]:
    """Runs of capitalised words, as lists of their tokens; initials with a stop,
    particles, or one comma may lie between."""
    n, word, kind, start, end = t.n, t.word, t.kind, t.start, t.end
    past = 0
    for i in [i for i, k in enumerate(kind) if k == CAP]:
        if i < past:
            continue
        run, j = [i], i
        while j + 1 < n:
            k = j + 1
            gap = start[k] - end[j]
            if gap == 0 and word[k] == "." and len(word[j]) == 1:
                j = k  # an initial
            elif gap == 1 and kind[k] == CAP:
                run.append(k)
                j = k
            elif gap == 1 and kind[k] == LOW and t.low[k] in _WORDS["particle"]:
                at = k
                while at + 1 < n and kind[at + 1] == LOW and t.low[at + 1] in _WORDS["particle"] and start[at + 1] - end[at] == 1:
                    at += 1
                if at + 1 < n and kind[at + 1] == CAP and start[at + 1] - end[at] == 1:
                    run.append(at + 1)
                    j = at + 1
                else:
                    break
            elif gap == 0 and word[k] == "," and k + 1 < n and kind[k + 1] == CAP and start[k + 1] - end[k] == 1:
                run.append(k + 1)
                j = k + 1
            else:
                break
        yield run
        past = run[-1] + 1


Index = tuple[dict[str, int], int]


def candidates(text: str, index: Index) -> tuple[Tokens, list[Span]]:
    """The tokens of a text and overlapping spans of all kinds; `index` of a
    lexicon as by _lexicon_index."""
    t = Tokens(text)
    bits, han = index
    out: list[Span] = []
    starts, ends, kind, word, low, n = t.start, t.end, t.kind, t.word, t.low, t.n

    def add(start: int, end: int, what: str, g: int) -> None:
        out.append((start, end, what, g, bisect.bisect_right(starts, start) - 1, bisect.bisect_left(ends, end)))

    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email", 0)
    numbers = [i for i, k in enumerate(kind) if k == NUMBER]
    if numbers:
        for m in _DIGITS.finditer(text):
            if sum(map(str.isdigit, m.group())) >= 3:
                start, end = m.span()
                if text[end - 2 : end - 1] == " " and text[end - 1].isalpha() and not text[start].isalpha():
                    end -= 2  # the next sentence's first letter
                add(start, end, "phone", 1)
                add(start, end, "id", 1)
        _addresses(t, numbers, add)
    seen = set()

    def name(a: int, b: int, g: int, start: int = -1, end: int = -1) -> None:
        """A name from token a to token b, or a part of them."""
        start, end = starts[a] if start < 0 else start, ends[b] if end < 0 else end
        if end == ends[b] and word[b][-2:] in ("'s", "’s"):
            end -= 2
        if (start, end) not in seen and text[start:end].lower() not in _ALL_LABELS:
            seen.add((start, end))
            out.append((start, end, "name", g, a, b))

    for run in _runs(t):
        many = len(run)
        plain = [low[i] in _WORDS["common"] and not (len(word[i]) == 1 and i + 1 < n and word[i + 1] == ".") for i in run]
        for i in range(many):
            if plain[i]:
                continue
            for k in range(i, min(i + 6, many)):
                if not plain[k]:
                    name(run[i], run[k], 13)
        if many > 6:
            name(run[0], run[-1], 13)
    for i in [i for i, k in enumerate(kind) if k == UNCASED]:
        w, c = word[i], word[i][0]
        before = low[i - 1] if i else ""
        fresh = i == 0 or kind[i - 1] == LINE or before in _STOPS or before in _DASHES or before in _OPEN or before in _CLOSE or starts[i] - ends[i - 1] > 1
        colon = before in ":：፡"
        cue = before in _STRONG_CUES and starts[i] - ends[i - 1] == 1
        more = [i]
        while len(more) < 4 and more[-1] + 1 < n and kind[more[-1] + 1] == UNCASED and starts[more[-1] + 1] - ends[more[-1]] == 1:
            more.append(more[-1] + 1)
        hit = bits.get(low[i])
        if before and before in "،,፣，" and (more[-1] + 1 == n or kind[more[-1] + 1] >= LINE):
            cue = True  # the last words of a line or sentence, as in a signature
        if colon or cue or hit or (fresh and (before in _DASHES or before in _OPEN)):
            for k in more:
                name(i, k, 10 if colon else 11 if cue else 12 if hit else 14)
        elif i + 1 < n and bits.get(low[i + 1]) and more[1:] == more[1:2]:
            name(i, i + 1, 12)
        if fresh:  # a speaker before a colon, a name alone on its line
            k = more[-1]
            if k + 1 < n and (word[k + 1] in ":：" or word[k + 1] == "<") or k + 1 == n or kind[k + 1] == LINE:
                name(i, k, 15)
        if "㐀" <= c <= "鿿":
            for p, x in enumerate(w):
                if x in CHINESE_SURNAMES or (han and any(w[p : p + z] in bits for z in range(1, han + 1))):
                    for z in (2, 3, 4):
                        if p + z <= len(w):
                            name(i, i, 16, starts[i] + p, starts[i] + p + z)
        elif "가" <= c <= "힣":
            if hit is None and (c in KOREAN_SURNAMES or c in bits or any(w.startswith(x) for x in (w[:2], w[:3], w[1:3], w[1:4]) if x in bits)):
                if 2 <= len(w) <= 5:
                    name(i, i, 17)
                for e in _KOREAN_ENDINGS:
                    if w.endswith(e) and 2 <= len(w) - len(e) <= 5:
                        name(i, i, 17, starts[i], ends[i] - len(e))
        elif cue or colon:
            for e in ("ক", "ৰ", "ে"):
                if w.endswith(e) and len(w) > 3:
                    name(i, i, 18, starts[i], ends[i] - len(e))
                if len(more) > 1 and word[more[1]].endswith(e):
                    name(i, more[1], 18, starts[i], ends[more[1]] - len(e))
        elif "ሀ" <= c <= "፿" and c in "ከለበየ" and len(w) > 2 and (i + 1 < n):
            name(i, i, 19, starts[i] + 1, ends[i])
            if len(more) > 1:
                name(i, more[1], 19, starts[i] + 1, ends[more[1]])
    return t, out


def _addresses(t: Tokens, numbers: list[int], add) -> None:  # noqa: ANN001
    """Street addresses, each looked for only where one of its words stands."""
    text, starts, low, word, n = t.text, t.start, t.low, t.word, t.n
    houses = {i for i, w in enumerate(low) if w in _HOUSE_WORDS}
    for i in sorted(houses | set(numbers)):
        m = _NUMBER_FIRST.match(text, starts[i])
        if m:
            add(m.start(), _before_sentence(t, m), "address", 2)
    for i in [i for i, w in enumerate(low) if w in _STREET_WORDS or w[-1] in "로길동"]:
        w = low[i]
        if w in _STREET_FIRST_WORDS:
            m = _STREET_FIRST.match(text, starts[i]) if i + 1 < n and (word[i + 1] != "." or w in ("jl", "gg", "av", "avda", "λεωφ")) else None
            if m:
                add(m.start(), m.end(), "address", 3)
                if i > 1 and word[i - 1] in ",،" and t.kind[i - 2] in (CAP, UNCASED):  # the town stands first
                    add(starts[i - 2], m.end(), "address", 9)
        if w in ("gida", "lamba", "ঘৰ", "የቤት", "house"):
            m = _HOUSE_FIRST.match(text, starts[i])
            if m:
                end = _before_sentence(t, m)
                add(m.start(), end, "address", 4)
                k = i - 2 if i > 1 and word[i - 1] in ",፣" and t.kind[i - 2] in (CAP, UNCASED) else -1
                if k >= 0:
                    add(starts[k], end, "address", 9)
                    if k and t.kind[k - 1] in (CAP, UNCASED) and starts[k] - t.end[k - 1] == 1:
                        add(starts[k - 1], end, "address", 9)
        if w in ("küçəsi", "prospekti", "döngəsi", "küç", "pr"):
            m = _AZERI.match(text, starts[i])
            k = i
            while m and k and i - k < 4 and t.kind[k - 1] == CAP and starts[k] - t.end[k - 1] == 1:
                k -= 1
                add(starts[k], m.end(), "address", 5)
            if m and k < i and k > 1 and word[k - 1] == "," and word[k - 2][0].isupper():
                add(starts[k - 2], m.end(), "address", 9)
        if w[-1] in "로길동" and i + 1 < n and t.kind[i + 1] == NUMBER:
            k = i
            while k and t.kind[k - 1] == UNCASED and word[k - 1][-1] in "도시군구읍면" and starts[k] - t.end[k - 1] == 1:
                k -= 1
            m = _KOREAN.match(text, starts[k])
            if m:
                add(m.start(), m.end(), "address", 6)
    if "号" in text:
        for m in _CHINESE.finditer(text):
            add(m.start(), m.end(), "address", 7)
            # In running text the town begins the address.
            for town in _CHINESE_TOWN.finditer(text, m.start(), m.end()):
                for z in (3, 4):
                    if town.end() - z > m.start():
                        add(town.end() - z, m.end(), "address", 7)


def _before_sentence(t: Tokens, m: re.Match) -> int:
    """An address ends before a capitalised word that begins a sentence."""
    at = bisect.bisect_left(t.end, m.end())
    if at < t.n and t.low[at] in _WORDS["common"] and t.word[at][0].isupper() and at and t.start[at] > m.start():
        return t.end[at - 1]
    return m.end()


class Covers:
    """E-mail and street address spans, asked whether one holds a given span."""

    def __init__(self, spans: list[Span]) -> None:
        held = sorted((s[0], s[1]) for s in spans if s[2] in ("email", "address"))
        self.starts = [s for s, _ in held]
        self.ends = list(itertools.accumulate((e for _, e in held), max))

    def hold(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start) - 1
        return i >= 0 and self.ends[i] >= end


_LABELS_BY_END: dict[str, list[tuple[str, int]]] = defaultdict(list)
for _i, _k in enumerate(LABELS):
    for _w in LABELS[_k].split("|"):
        _LABELS_BY_END[_w[-1]].append((_w, _i))


def label_before(text: str, start: int) -> tuple[int, int]:
    """Which label stands before a span (-1 none), and how it is joined: 0 by a
    blank, 1 by a colon, 2 by brackets or a comma."""
    before = text[max(0, start - 40) : start].lower()
    bare = before.rstrip(" \t ")
    joint = 0
    while bare and bare[-1] in ":：,(<\"[（-—":
        joint = 1 if bare[-1] in ":：" else joint or 2
        bare = bare[:-1].rstrip(" \t ")
    for cut in ((), (" is", " no", " number", "م", " الوطنية")):
        for c in cut:
            if bare.endswith(c):
                bare = bare[: -len(c)]
        for w, i in _LABELS_BY_END.get(bare[-1:], ()):
            if bare.endswith(w) and (len(bare) == len(w) or not bare[-len(w) - 1].isalnum() or w[0] > "⿿"):
                return i, joint
    return -1, joint


def _class(t: Tokens, i: int) -> int:
    """Kind of a neighbouring token."""
    if i < 0 or i >= t.n or t.kind[i] == LINE:
        return 0
    k, w = t.kind[i], t.word[i]
    if k <= NUMBER:
        return k + 1
    return 1 if w in _STOPS else 6 if w in ":：፡" else 7 if w in _DASHES else 8 if w == "<" else 9 if w in _OPEN else 10 if w in _CLOSE else 11 if w in ",،、，፣" else 12


def _number_features(t: Tokens, span: Span, covers: Covers) -> list[float]:
    start, end, _, _, a, b = span
    s = t.text[start:end]
    ds = [c for c in s if c.isdigit()]
    groups = [len(x) for x in re.findall(r"\d+", s)]
    letters = sum(map(str.isalpha, s))
    label, joint = label_before(t.text, start)
    first = str(int(ds[0])) if ds else ""
    one = "".join(ds[:4])
    nxt = t.low[b + 1] if b + 1 < t.n else ""
    return [
        float(len(ds)), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)), float(min(groups)), float(s[0] == "+"), float(s[:1] == "(" or "(" in s), float("-" in s), float("." in s), float(" " in s), float("/" in s),
        float(letters), float(s[0].isalpha()), float(s[-1].isalpha()), float(first == "0"), float(one[:2] == "00"), float(first == "1"), float(first == "9"), float(ds.count("0")), float(len(set(ds))),
        float(label), float(joint), float(label == 1), float(label == 2), float(label == 5), float(_class(t, a - 1)), float(_class(t, b + 1)),
        float(one[:2] in ("19", "20") and groups[0] == 4), float(covers.hold(start, end)), float(t.low[a - 1] in "$€£¥%№#" if a else 0), float(nxt in "%°€"), float(nxt[:1].isalpha() and nxt.islower()),
        float(bool(a) and t.kind[a - 1] < NUMBER and t.end[a - 1] == start), float(s[1:2].isalpha()), float(groups[1] if len(groups) > 1 else 0), float(groups[2] if len(groups) > 2 else 0),
    ]


def _address_features(t: Tokens, span: Span) -> list[float]:
    start, end, _, g, a, b = span
    s = t.text[start:end]
    label, joint = label_before(t.text, start)
    return [
        float(g), float(len(s)), float(sum(c.isdigit() for c in s)), float(s[0].isdigit()), float("," in s or "،" in s), float(label), float(joint), float(label == 3), float(_class(t, a - 1)), float(_class(t, b + 1)), float(b - a),
        float(t.kind[a] == NUMBER and len(t.word[a]) > 3), float(t.low[a - 1] in _WORDS["place"] if a else 0), float(t.low[a] in _WORDS["common"]), float(a > 0 and t.end[a - 1] == start and t.kind[a - 1] < NUMBER), float(starts_inside(t, a)),
    ]


def starts_inside(t: Tokens, a: int) -> bool:
    """A house word or number goes before, so the span begins too late."""
    return a > 1 and (t.low[a - 1] in ("no", "flat", "lamba", "house", ".") or (t.word[a - 1] in ",،" and t.kind[a - 2] == NUMBER))


def _name_features(t: Tokens, span: Span, bits: dict[str, int], covers: Covers, lows: frozenset[str]) -> list[float]:
    start, end, _, g, a, b = span
    low, word, n = t.low, t.word, t.n
    s = t.text[start:end]
    inner = [i for i in range(a, b + 1) if t.kind[i] < NUMBER]
    whole = start == t.start[a] and end == t.end[b]
    own = [low[i] for i in inner] if whole else [s.lower()] if a == b else [t.text[max(start, t.start[i]) : min(end, t.end[i])].lower() for i in inner]
    hits = [bits.get(w, 0) for w in own]
    c = s[0]
    cased = t.kind[a] != UNCASED
    before, after = low[a - 1] if a else "", low[b + 1] if b + 1 < n else ""
    if before == "." and a > 1 and low[a - 2] in _WORDS["title"]:
        before = low[a - 2]
    before2 = low[a - 2] if a > 1 else ""
    after2 = low[b + 2] if b + 2 < n else ""
    label, joint = label_before(t.text, start) if before in ":：፡" or before in _OPEN or before in _CUES or before in _NAME_LABELS else (-1, 0)
    prior, next_ = (13 if start > t.start[a] else _class(t, a - 1)), (13 if end < t.end[b] else _class(t, b + 1))
    starts = prior in (0, 1, 7, 8, 9, 10)
    left, right = t.text[start - 1 : start], t.text[end : end + 1]
    return [
        float(g), float(len(inner)), float(len(s)), float(cased), float("㐀" <= c <= "鿿"), float("가" <= c <= "힣"), float(prior), float(next_), float(label), float(joint),
        float(before in _WORDS["title"]), float(before in _WORDS["kin"]), float(before in _WORDS["cue"]), float(before in _WORDS["place"]), float(before in _WORDS["saint"] or own[0] in _WORDS["saint"]), float(before in _WORDS["say"]), float(before2 in _WORDS["kin"] or before2 in _WORDS["title"]), float(before2 in _WORDS["cue"]),
        float(after in _WORDS["verb"]), float(after2 in _WORDS["verb"]), float(after in _WORDS["notpeople"] or low[b] in _WORDS["notpeople"]), float(after.endswith("ed") and len(after) > 3), float(after.endswith("s")), float(after in ("who", "whose", "and")),
        float(sum(1 for h in hits if h)), float(sum(1 for h in hits if h & 1)), float(sum(1 for h in hits if h & 2)), float(bool(hits) and all(hits)),
        float(starts), float(any(w in _WORDS["places"] for w in own)), float(cased and any(w in lows for w in own)), float(s.isupper() and len(s) > 2), float(any(len(word[i]) == 1 for i in inner)), float("," in s),
        float(any(w in _WORDS["particle"] for w in own)), float(prior == 2 and left == " "), float(next_ == 2 and right == " "), float(covers.hold(start, end)), float("-" in s or "'" in s or "’" in s), float(len(own[0])), float(len(own[-1])),
        float(starts and next_ in (0, 6, 8)), float(next_ == 0), float(any(w in _WORDS["common"] for w in own)), float(t.text[start - 1 : start] in _HAN_BEFORE if start else 0), float(right in _HAN_AFTER), float(c in CHINESE_SURNAMES or c in KOREAN_SURNAMES), float(t.text[end : end + 2] in ("先生", "女士", "老师", " 씨", " 님", " 선") or right in "씨님"),
        float(low[a] in _CUES or low[a] in _ALL_LABELS), float(low[b] in _WORDS["verb"]), float(s.endswith(_KOREAN_ENDINGS)), float(right in "'’"), float(len(right) and right == "."), float(before in _DASHES and (a == 1 or t.kind[a - 2] == LINE or low[a - 2] in _STOPS)), float(prior == 11), float(next_ == 11), float(after in _WORDS["place"]), float(next_ == 4), float(after in _WORDS["common"]), float(before in _WORDS["common"]), float(sum(1 for h in hits if h) and starts),
    ]


_ALL_LABELS = frozenset(w for v in LABELS.values() for w in v.split("|"))
_NAME_LABELS = frozenset(w.split()[-1] for w in LABELS["name"].split("|"))


def features(t: Tokens, spans: list[Span], bits: dict[str, int]) -> Iterator[list[float]]:
    """Format and context of each span."""
    covers = Covers(spans)
    lows = frozenset(t.word)
    numbers: dict[int, list[float]] = {}
    for span in spans:
        kind = span[2]
        if kind == "name":
            yield _name_features(t, span, bits, covers, lows)
        elif kind == "address":
            yield _address_features(t, span)
        elif kind == "email":
            yield [float("@" in t.text[span[0] : span[1]]), float(span[1] - span[0]), float(t.text.count(".", span[0], span[1])), float(" " in t.text[span[0] : span[1]])]
        else:
            if span[0] not in numbers:
                numbers[span[0]] = _number_features(t, span, covers)
            yield numbers[span[0]]


def _examples(lexicon: tuple[tuple[str, str], ...], parts: set[int], texts: int, seed: int) -> tuple[dict[str, list], dict[str, list]]:
    """Features and labels of the candidates of made texts, by kind."""
    maker = Maker(random.Random(seed), parts, LABELS)
    x: dict[str, list] = {k: [] for k in KINDS}
    y: dict[str, list] = {k: [] for k in KINDS}
    index = _lexicon_index(lexicon)
    for _ in range(texts):
        text, spans, _ = maker.text()
        true = {(s, k): e for s, e, k in spans}
        t, found = candidates(text, index)
        for c, f in zip(found, features(t, found, index[0]), strict=True):
            end = true.get((c[0], c[2]))
            x[c[2]].append(f)
            # Rightly placed from start to end; of an address the end may be missing.
            y[c[2]].append(end is not None and (abs(end - c[1]) <= 1 or (c[2] == "address" and (end + c[0]) / 2 <= c[1] <= end + 24)))
    return x, y


@cache
def _models(texts: int, seed: int, parts: tuple[int, ...]) -> tuple[dict[str, BoostedTrees], dict[str, float]]:
    """Trees fitted on some parts of the frames, thresholds on part 2."""
    lexicon = Maker(random.Random(seed), {0}, LABELS).lexicon()
    x, y = _examples(lexicon, set(parts), texts, seed)
    hx, hy = _examples(lexicon, {2}, texts // 3, seed + 1)
    models, thresholds = {}, {}
    for k in KINDS:
        models[k] = BoostedTrees(trees=50, depth=5, rate=0.25).fit(np.array(x[k], np.float32), np.array(y[k], float))
        thresholds[k] = _threshold(models[k].predict(np.array(hx[k], np.float32)), np.array(hy[k], float))
    return models, thresholds


class Redactor:
    """Fitted trees and thresholds; finds spans and replaces them."""

    def __init__(self, lexicon: tuple[tuple[str, str], ...]) -> None:
        self.lexicon = tuple(sorted({*lexicon, *common_names()}))
        self.models: dict[str, BoostedTrees] = {}
        self.thresholds = dict.fromkeys(KINDS, 0.5)
        #: A lexicon too large to be sent: name, name_role.
        self.large: DataFrame | None = None

    def fit(self, texts: int = TRAIN_TEXTS, seed: int = SEED, parts: tuple[int, ...] = (0, 1, 3)) -> Redactor:
        """`parts` are those the trees see; measure only without part 3."""
        self.models, self.thresholds = _models(texts, seed, parts)
        return self

    def validation(self, texts: int = 1500, seed: int = SEED) -> dict[tuple[str, str], tuple[int, int, int]]:
        """(true spans, spans found, right ones) by kind and language, '' for
        all languages, on the frames, names and streets of part 3, which a fit
        with `parts` (0, 1) never saw. A span is right if its kind and start are."""
        lexicon = Maker(random.Random(seed), {0}, LABELS).lexicon()
        maker = Maker(random.Random(seed + 2), {3}, LABELS)
        held, self.lexicon = self.lexicon, lexicon
        out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        made = [maker.text() for _ in range(texts)]
        for (_, spans, lang), got in zip(made, self.find([m[0] for m in made]), strict=True):
            want, have = {(s, k) for s, _, k in spans}, {(s, k) for s, _, k in got}
            for i, found in enumerate((want, have, want & have)):
                for _, k in found:
                    out[k, lang][i] += 1
                    out[k, ""][i] += 1
        self.lexicon = held
        return {k: (v[0], v[1], v[2]) for k, v in out.items()}

    def find(self, texts: list[str | None], known: list[list[tuple[str, str]] | None] | None = None) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text, in order of start. `known`: of each
        text the entries of a large lexicon that occur in it."""
        index = _lexicon_index(self.lexicon)
        rows: dict[str, list] = {k: [] for k in KINDS}
        whose: dict[str, list] = {k: [] for k in KINDS}
        for i, text in enumerate(texts):
            if text:
                if known is not None:
                    index = _lexicon_index.__wrapped__((*self.lexicon, *(known[i] or ())))
                t, found = candidates(text, index)
                for c, f in zip(found, features(t, found, index[0]), strict=True):
                    rows[c[2]].append(f)
                    whose[c[2]].append((i, c))
        hits: list[list] = [[] for _ in texts]
        for k in KINDS:
            if rows[k]:
                p = self.models[k].predict(np.array(rows[k], np.float32))
                t = self.thresholds[k]
                for at in np.flatnonzero(p >= t):
                    i, c = whose[k][at]
                    hits[i].append(((p[at] - t) / (1 - t + 1e-9), c[1] - c[0], c))
        out = []
        for own in hits:
            chosen: list[tuple[int, int, str]] = []
            # E-mail and street addresses contain names and digits, never the other way round.
            # The longest of them that stands is the whole address.
            for _, _, (s, e, k, *_) in sorted(own, key=lambda h: (True, -round(h[0], 2), -h[1]) if h[2][2] not in ("email", "address") else (False, -h[1], -h[0])):
                at = bisect.bisect_left(chosen, (s,))
                if (at == 0 or chosen[at - 1][1] <= s) and (at == len(chosen) or e <= chosen[at][0]):
                    chosen.insert(at, (s, e, k))
            out.append(chosen)
        return out

    def redact(self, texts: list[str | None], known: list[list[tuple[str, str]] | None] | None = None) -> list[str | None]:
        """Texts with typed placeholders for their spans."""
        out: list[str | None] = []
        for text, spans in zip(texts, self.find(texts, known), strict=True):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s, e, k in spans:
                parts += (text[at:s], PLACEHOLDERS[k])
                at = e
            out.append("".join(parts) + text[at:])
        return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the cutoffs with the best F1, or nearly, the one next to a half."""
    cuts = np.linspace(0.05, 0.95, 91)
    tp = np.array([((p >= c) & (y == 1)).sum() for c in cuts], float)
    got = np.array([(p >= c).sum() for c in cuts], float)
    f1 = 2 * tp / np.maximum(1, got + y.sum())
    best = cuts[f1 >= f1.max() - 5e-3]
    return float(best[np.abs(best - 0.5).argmin()])


#: Lexicon entries that are sent to every executor; larger lexicons are joined.
LEXICON_HELD = 100_000


def learn(lexicon: DataFrame, texts: int = TRAIN_TEXTS, seed: int = SEED, held: int = LEXICON_HELD) -> Redactor:
    """The redactor for a name lexicon. One of more than `held` entries stays
    where it is: found() and redacted() then join it to the words of the texts."""
    entries = lexicon.where("name is not null").select("name", F.coalesce("name_role", F.lit("")).alias("name_role")).distinct()
    rows = entries.limit(held + 1).collect()
    if len(rows) <= held:
        return Redactor(tuple(sorted((r.name, r.name_role) for r in rows))).fit(texts, seed)
    redactor = Redactor(()).fit(texts, seed)
    redactor.large = entries
    return redactor


def lookups(text: str, longest: int = 8) -> set[str]:
    """All strings under which a text asks for a lexicon entry."""
    out = set()
    t = Tokens(text)
    for w, k in zip(t.low, t.kind, strict=True):
        out.add(w)
        if k == UNCASED:
            whole = "㐀" <= w[0] <= "鿿"
            out.update(w[i:j] for i in range(len(w) if whole else 2) for j in range(i + 1, min(len(w), i + longest) + 1))
            out.add(w[:-1])
    return out


def _texts(documents: DataFrame, redactor: Redactor) -> DataFrame:
    """doc_id, text, and where the lexicon is large its entries in the text."""
    docs = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    none = F.lit(None).cast("array<struct<name:string,role:string>>")
    if redactor.large is None:
        return docs.withColumn("known", none)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(h, w) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in lookups(text)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())], names=["h", "w"])

    asked = docs.where("text is not null").select(F.sha2("text", 256).alias("h"), "text").dropDuplicates(["h"]).mapInArrow(ask, "h string, w string")
    entries = redactor.large.select(F.lower("name").alias("w"), F.struct("name", F.col("name_role").alias("role")).alias("e"))
    hits = asked.join(entries, "w").groupBy("h").agg(F.collect_list("e").alias("known"))  # at most the entries within one text
    return docs.withColumn("h", F.sha2("text", 256)).join(hits, "h", "left").select("doc_id", "text", "known")


def _known(column: pa.Array) -> list | None:
    return None if column.null_count == len(column) else [None if v is None else [(e["name"], e["role"]) for e in v] for v in column.to_pylist()]


def _send(documents: DataFrame, redactor: Redactor) -> tuple[DataFrame, Broadcast]:
    texts = _texts(documents, redactor)
    plain = Redactor(())
    plain.lexicon, plain.models, plain.thresholds = redactor.lexicon, redactor.models, redactor.thresholds
    return texts, documents.sparkSession.sparkContext.broadcast(plain)


def found(documents: DataFrame, redactor: Redactor) -> DataFrame:
    """(doc_id, pii_kind, start_pos) of every occurrence; map-only but for a
    large lexicon."""
    texts, shared = _send(documents, redactor)
    arrow = pa.schema([("doc_id", pa.int64()), ("pii_kind", pa.string()), ("start_pos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                out: list[list] = [[], [], []]
                for doc, spans in zip(batch.column(0).to_pylist(), shared.value.find(batch.column(1).to_pylist(), _known(batch.column(2))), strict=True):
                    for s, _, k in spans:
                        for col, v in zip(out, (doc, k, s), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types, strict=True)], schema=arrow)

    return texts.mapInArrow(run, "doc_id bigint, pii_kind string, start_pos bigint")


def redacted(documents: DataFrame, redactor: Redactor) -> DataFrame:
    """(doc_id, text) with placeholders; map-only but for a large lexicon."""
    texts, shared = _send(documents, redactor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.redact(batch.column(1).to_pylist(), _known(batch.column(2))), pa.string())], names=["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id bigint, text string")
