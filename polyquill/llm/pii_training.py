"""Texts with known personal information, made for fitting the trees of `pii`.

All frames, names, streets and towns here were written for this module: none
is taken from a table (tests/llm/test_pii.py holds them against the tables).
They are dealt into four parts by position, whole: parts 0 and 1 fit the trees,
part 2 sets the thresholds, and part 3 is only measured on. A text mixes frames
of one language with frames of others now and then, as collections do.
"""

from __future__ import annotations

import random

PARTS = 4

# Names by language, given and family.
GIVEN = {
    "en": "James Oliver Emma Sophie Daniel Grace Thomas Helen Marcus Nadia Peter Julia Kevin Laura Brian Alice Eleanor Hugh Priya Simon Tessa Walter Diane Gareth",
    "es": "Lucía Javier Carmen Miguel Sofía Andrés Pilar Diego Marta Rafael Inés Gonzalo Beatriz Álvaro Noelia Ramiro",
    "id": "Budi Siti Agus Dewi Rizky Putri Andi Ratna Bambang Yuni Fajar Intan Hendra Wulan Joko Mega",
    "su": "Asep Euis Ujang Neng Dadang Cecep Tatang Yayah Encep Imas Dede Iis Kokom Engkos Nining Maman",
    "ha": "Aisha Musa Fatima Ibrahim Sani Hauwa Umar Zainab Bashir Halima Kabiru Rakiya Nasiru Amina Shehu Maryam",
    "az": "Elçin Leyla Rəşad Günel Orxan Nigar Vüqar Aynur Tural Sevinc Kamran Lalə Fərid Ülviyyə Samir Arzu",
    "el": "Γιώργος Μαρία Νίκος Ελένη Κώστας Κατερίνα Δημήτρης Σοφία Γιάννης Άννα Πέτρος Βασιλική Στέλιος Ειρήνη Μιχάλης Αγγελική",
    "ar": "محمد فاطمة أحمد خديجة يوسف سعاد كريم ليلى سمير نادية رشيد أمينة طارق زينب بلال حورية",
    "fa": "علی زهرا رضا مریم حسین نرگس امیر سارا مهدی لیلا کاوه پروین بهرام مینا داوود نسرین",
    "ko": "민준 서연 지훈 수빈 하은 도윤 예진 현우 은지 태호 유나 성민 미경 동현 소영 재석",
    "zh": "小明 伟 芳 建国 丽华 志强 秀英 军 敏 海燕 文博 静 雪梅 浩然 国栋 婷婷",
    "as": "ৰাহুল প্ৰিয়া অনুপ জুনমণি মনোজ ৰীতা দীপক মালবিকা হেমন্ত ভনিতা প্ৰণৱ নমিতা বিকাশ অঞ্জলি সুৰেশ ৰেখা",
    "am": "አበበ ሙሉጌታ ሰላም ትዕግስት ዮሐንስ ሀና ተስፋዬ መሠረት ዳዊት ብርቱካን ግርማ አልማዝ ሳሙኤል ገነት ኃይሉ ወይንሸት",
}
FAMILY = {
    "en": "Whitaker Johnson Bennett Carter Hughes Turner Collins Murphy Foster Patel Reynolds Sanders Douglas Fletcher Morgan O'Neill Okafor Lindqvist Castellano Novak Pritchard Abernathy Delaney Sheridan",
    "es": "Fernández García Morales Ortega Ruiz Navarro Delgado Castillo Gutiérrez Peña Salgado Iglesias Quintana Robles Vidal Aranda",
    "id": "Santoso Wijaya Hidayat Lestari Nugroho Saputra Kusuma Siregar Hartono Wibowo Pangestu Simanjuntak Rahman Utami Gunawan Setiawan",
    "su": "Sunandar Kurnia Suherman Permana Sutisna Rohendi Supriatna Hidayat Komara Sopandi Wiguna Nugraha Somantri Suryana Mulyana Rukmana",
    "ha": "Bello Abubakar Danjuma Garba Lawal Yusuf Aliyu Suleiman Tanko Gwarzo Dikko Ringim Mohammed Jibrin Hadejia Waziri",
    "az": "Məmmədov Əliyeva Hüseynov Quliyeva Həsənov İsmayılova Rzayev Kərimova Abbasov Vəliyeva Nəsirov Cəfərova Babayev Sultanova Əhmədov Məlikova",
    "el": "Παπαδόπουλος Γεωργίου Νικολάου Οικονόμου Βασιλείου Αντωνίου Παππάς Δημητρίου Κωνσταντίνου Μακρή Ιωάννου Καραγιάννη Αθανασίου Ζαχαρίου Λαμπράκης Σταύρου",
    "ar": "الحداد المنصوري بوزيد العمري حمدان الخطيب بلقاسم الشريف مراد التونسي زروقي السعيد بوعلام القاسمي عثماني رحماني",
    "fa": "احمدی رضایی کریمی محمدی موسوی حسینی جعفری صادقی نوری قاسمی رستمی باقری شریفی کاظمی طاهری یوسفی",
    "ko": "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황",
    "zh": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 马 朱 胡 林",
    "as": "বৰা শইকীয়া দাস কলিতা গগৈ বৰুৱা হাজৰিকা ডেকা চৌধুৰী নাথ ভূঞা মহন্ত শৰ্মা তালুকদাৰ ফুকন কোঁৱৰ",
    "am": "ከበደ ታደሰ ገብረማርያም ወልደሚካኤል አየለ ደምሴ መኮንን ተክሌ በቀለ ዘውዴ አለሙ ንጉሤ ሽፈራው ፈቃዱ ይልማ ጥላሁን",
}

#: Streets and towns; {n} is a number.
PLACES = {
    "en": (
        "{n} Oakfield Road, Bristol", "Flat {m}, {n} Station Parade, Leeds", "{n} Elm Tree Avenue, Norwich", "{n}A Victoria Terrace", "{n} N Maple Street Apt {m}, Denver", "{n} Lakeview Parkway, Austin", "Unit {m}, {n} Kingfisher Drive, Cardiff",
        "No. {n}, Chapel Hill, Dundee", "{n} Sycamore Crescent, Hull", "{n} E Jefferson Blvd, Dayton", "Apartment {m}, {n} Riverside Court, Cork", "{n} Windmill Lane", "{n} Cedar Ridge Circle, Boise", "Suite {m}, {n} Commerce Square, Tampa", "{n} Priory Gardens, Exeter", "House {m}, {n} Orchard Close, Truro",
    ),
    "es": ("Calle Mayor {n}, {m}.º A", "Avenida de la Constitución {n}", "Calle San Andrés, {n}, Valencia", "Plaza del Carmen {n}, {m}.º C", "Paseo de Gracia {n}", "Camino Viejo nº {n}", "Av. Insurgentes {n}", "Calle del Pozo núm. {n}, Cuenca"),
    "id": ("Jl. Merdeka No. {n}, Bandung", "Jalan Sudirman {n}, Jakarta", "Jl. Melati No. {n}, RT 0{k}/RW 0{k}", "Gang Mawar No. {n}", "Jalan Gajah Mada No. {n}, Semarang", "Jl. Diponegoro {n}", "Jl. Veteran Raya No. {n}, Malang", "Gg. Kelinci No. {n}"),
    "su": ("Jl. Asia Afrika No. {n}, Bandung", "Jalan Ciumbuleuit No. {n}", "Gang Kacapi No. {n}, Garut", "Jl. Pahlawan No. {n}, Désa Cibiru", "Jl. Siliwangi {n}, Tasikmalaya", "Gg. Sukamaju No. {n}", "Jalan Dago No. {n}", "Jl. Ahmad Yani No. {n}, RT 0{k}/RW 0{k}"),
    "ha": ("Titin Ahmadu Bello {n}, Kaduna", "Gida mai lamba {n}, Titin Kasuwa", "Layin Makaranta {n}", "Titin Zariya {n}, Kano", "Gida mai lamba {n}, Layin Asibiti", "Titin Gwamna {n}", "Lamba {n}, Titin Bauchi", "Gida {n}, Unguwar Rimi"),
    "az": ("Nizami küçəsi {n}, mənzil {m}", "Neftçilər prospekti {n}", "Bakı, Təbriz küçəsi {n}", "Füzuli küçəsi {n}", "Azadlıq prospekti {n}, mənzil {m}", "Xaqani küçəsi {n}", "Atatürk prospekti {n}", "Gəncə, Şah İsmayıl küçəsi {n}"),
    "el": ("Οδός Ερμού {n}, Αθήνα", "Λεωφόρος Κηφισίας {n}", "Οδός Αριστοτέλους {n}, Πάτρα", "Πλατεία Ομονοίας {n}", "Οδός Σόλωνος {n}", "Λεωφ. Συγγρού {n}, Αθήνα", "Οδός Τσιμισκή {n}, Θεσσαλονίκη", "Οδός Μεγάλου Αλεξάνδρου {n}"),
    "ar": ("شارع الاستقلال رقم {n}", "شارع ديدوش مراد {n}، الجزائر", "حي السلام رقم {n}", "طريق المطار {n}", "شارع الجمهورية رقم {n}، وهران", "حي النصر، رقم {n}", "شارع ابن خلدون {n}", "نهج الحرية رقم {n}"),
    "fa": ("خیابان آزادی، پلاک {n}", "خیابان ولیعصر، کوچه سوم، پلاک {n}", "بلوار کشاورز، پلاک {n}", "کوچه لاله، پلاک {n}", "تهران، خیابان انقلاب، پلاک {n}", "میدان ونک، پلاک {n}", "خیابان سعدی شماره {n}", "بلوار چمران، پلاک {n}، واحد {m}"),
    "ko": ("서울시 종로구 세종대로 {n}", "부산시 해운대로 {n}, {m}01호", "대전시 유성구 대학로 {n}", "인천시 남동구 예술로 {n}번길 {m}", "광주시 충장로 {n}, {m}02호", "수원시 팔달구 정조로 {n}", "강남구 테헤란로 {n}", "전주시 한옥길 {n}-{m}"),
    "zh": ("北京市朝阳区建国路{n}号", "上海市南京路{n}号{m}室", "广州市中山路{n}号", "成都市人民路{n}号{m}单元", "武汉市解放大道{n}号", "西安市长安街{n}号", "南京市鼓楼区汉口路{n}号{m}栋", "杭州市西湖区文三路{n}号"),
    "as": ("ঘৰ নং {n}, জি এছ ৰোড", "ঘৰ নং {n}, জ্যোতি পথ", "গুৱাহাটী, ঘৰ নং {n}, শান্তি পথ", "ঘৰ নং {n}, বিষ্ণু ৰাভা পথ", "ঘৰ নং {n}, কলেজ ৰোড", "ঘৰ নং {n}, মন্দিৰ পথ", "যোৰহাট, ঘৰ নং {n}, গড়আলি", "ঘৰ নং {n}, নেহৰু পথ"),
    "am": ("የቤት ቁጥር {n}, ቦሌ መንገድ", "የቤት ቁጥር {n}, የአራት ኪሎ መንገድ", "የቤት ቁጥር {n}, ፒያሳ", "አዲስ አበባ, የቤት ቁጥር {n}", "የቤት ቁጥር {n}, የጎጃም በር መንገድ", "ባሕር ዳር, የቤት ቁጥር {n}", "የቤት ቁጥር {n}, መገናኛ መንገድ", "የቤት ቁጥር {n}, የሐረር መንገድ"),
}

#: Sentences with one name.
NAME_FRAMES = {
    "en": (
        "Ms {} chairs the meeting.", "Nothing was heard of Mr {} after that.", "Thank Ms {}, please, for the flowers.", "Mr {}, our lawyer, has the file.",
        "We waited for {}, as usual.", "Nobody believed {} at first.", "I borrowed the ladder from {}.", "The winner is {}!",
        "Yesterday {} moved into the flat above ours.", "{} sent the list to everyone in the office.", "We were introduced to Mr {} at the conference.", "My cousin {} repairs old radios for a living.", "{} lives two doors down from the library.", "The letter was signed by {} and a witness.", "Have you met {}?", "Ask Mrs {} for the spare key.",
        "My name is {} and I teach chemistry.", "{} said the train would be late again.", "Our tutor, {}, corrected the essays.", "I spoke with {} about the contract.", "Best wishes, {}", "Dear {}, thank you for your letter.", "A friend of mine, {}, drove us home.", "Prof. {} will open the session.",
        "{} and her sister run the kiosk.", "The nurse called {} to the front desk.", "It was {} who found the dog.", "{}'s bicycle was stolen last night.", "Minutes taken by {}.", "Kind regards, {}", "{}: I think we should leave early.", "Please forward this to {} at the front office.",
        "{} was born near the coast in the sixties.", "Last week {} asked me for a favour.", "The keys belong to {}.", "According to {}, the bridge reopens soon.", "{} wrote a long reply to the landlord.", "I am {}, the new caretaker.", "Dr {} explained the results to us.", "When {} arrived, the hall was already full.",
    ),
    "es": (
        "Ayer hablé con {} sobre el viaje.", "Mi vecina {} trabaja en el hospital.", "{} me contó la historia completa.", "Me llamo {} y vivo en Madrid.", "La señora {} firmó el contrato.", "El profesor {} llegó tarde a clase.", "Un saludo, {}", "{} dice que no vendrá mañana.", "Conocí a {} en la universidad.", "Don {} reparte el correo.", "Mi hermano {} compró un coche.", "Pregúntale a {} por las llaves.",
    ),
    "id": ("Kemarin saya bertemu {} di kantor.", "Nama saya {} dan saya tinggal di Surabaya.", "Pak {} mengajar matematika.", "Tetangga saya {} memperbaiki sepeda.", "{} mengatakan rapat ditunda.", "Ibu {} menandatangani surat itu.", "Salam hangat, {}", "Teman saya, {}, mengantar kami pulang.", "{} pindah ke rumah baru.", "Tolong hubungi {} besok."),
    "su": ("Kamari kuring panggih jeung {} di kantor.", "Ngaran abdi {} ti Sumedang.", "Pa {} ngajar di sakola.", "Tatangga kuring, {}, ngomean sapédah.", "{} nyarios rapat ditunda.", "Bu {} nandatangan serat éta.", "Hormat kuring, {}", "Babaturan kuring {} nganteur urang balik."),
    "ha": ("Jiya na haɗu da {} a ofis.", "Sunana {} kuma ina zaune a Kano.", "Malam {} yana koyar da lissafi.", "Maƙwabcina {} yana gyaran keke.", "{} ya ce an ɗage taron.", "Malama {} ta sanya hannu a takardar.", "Naku, {}", "Abokina {} ya kai mu gida."),
    "az": ("Dünən ofisdə {} ilə görüşdüm.", "Mənim adım {} və Bakıda yaşayıram.", "Qonşum {} velosiped təmir edir.", "{} dedi ki, iclas təxirə salınıb.", "Cənab {} müqaviləni imzaladı.", "Hörmətlə, {}", "Dostum {} bizi evə apardı.", "Müəllim {} dərsə gecikdi."),
    "el": ("Χθες συνάντησα τον {} στο γραφείο.", "Με λένε {} και μένω στην Αθήνα.", "Ο κύριος {} υπέγραψε το συμβόλαιο.", "Η γειτόνισσά μου {} δουλεύει στο νοσοκομείο.", "{} είπε ότι η συνάντηση αναβλήθηκε.", "Με εκτίμηση, {}", "Ο φίλος μου {} μας πήγε σπίτι.", "Η κυρία {} διδάσκει χημεία."),
    "ar": ("التقيت أمس {} في المكتب.", "اسمي {} وأسكن في وهران.", "وقع السيد {} على العقد.", "جاري {} يصلح الدراجات.", "قال {} إن الاجتماع تأجل.", "مع التحية، {}", "صديقي {} أوصلنا إلى البيت.", "تعمل السيدة {} في المستشفى."),
    "fa": ("دیروز با {} در اداره صحبت کردم.", "نام من {} است و در شیراز زندگی می‌کنم.", "آقای {} قرارداد را امضا کرد.", "همسایه‌ام {} دوچرخه تعمیر می‌کند.", "{} گفت جلسه عقب افتاد.", "با احترام، {}", "دوستم {} ما را به خانه رساند.", "خانم {} شیمی درس می‌دهد."),
    "ko": ("어제 사무실에서 {} 씨를 만났습니다.", "제 이름은 {}이고 대구에 삽니다.", "{} 선생님이 수학을 가르칩니다.", "이웃 {} 씨가 자전거를 고칩니다.", "{}은 회의가 미뤄졌다고 말했습니다.", "{} 드림", "친구 {}이 우리를 집까지 데려다주었습니다.", "계약서에는 {} 님이 서명했습니다."),
    "zh": ("昨天我和{}在办公室见面。", "我叫{}，住在天津。", "{}先生签了合同。", "邻居{}会修自行车。", "{}说会议推迟了。", "此致敬礼，{}", "朋友{}送我们回家。", "{}老师教数学。", "请把钥匙交给{}。", "我们一起去找{}聊天。"),
    "as": ("কালি কাৰ্যালয়ত {}ক লগ পালোঁ।", "মোৰ নাম {} আৰু মই তেজপুৰত থাকোঁ।", "শ্ৰী {} চুক্তিত চহী কৰিলে।", "চুবুৰীয়া {} চাইকেল মেৰামতি কৰে।", "{} ক'লে যে সভা পিছুৱাই গ'ল।", "ইতি, {}", "বন্ধু {} আমাক ঘৰলৈ লৈ আহিল।", "শ্ৰীমতী {} গণিত পঢ়ায়।"),
    "am": ("ትናንት በቢሮ ከ{} ጋር ተገናኘሁ።", "ስሜ {} ነው፣ ሐዋሳ እኖራለሁ።", "አቶ {} ውሉን ፈረሙ።", "ጎረቤቴ {} ብስክሌት ይጠግናል።", "{} ስብሰባው ተራዘመ አለ።", "ከአክብሮት ጋር፣ {}", "ጓደኛዬ {} ወደ ቤት ወሰደን።", "ወይዘሮ {} ሒሳብ ያስተምራሉ።"),
}
#: Sentences around an e-mail address, a phone number, an identity number or a street address.
OTHER_FRAMES = {
    "email": (
        "You can reach the office at {} on weekdays.", "Please send your photos to {}, not by post.", "Questions? {}", "Forward invoices to {} only.", "The club answers under {} within a week.", "Escríbenos a {} para reservar.", "Kirim foto ke {} sebelum rapat.", "Στείλτε τις φωτογραφίες στο {} αύριο.",
        "أرسل الصور إلى {} غدا.", "عکس‌ها را به {} بفرستید.", "사진은 {} 로 보내 주세요.", "请把照片发到 {} 。",
    ),
    "phone": (
        "Dial {} and ask for the workshop.", "The plumber can be reached under {} until noon.", "If the gate is locked, ring {}.", "Reception: {}", "Leave a message at {}, please.", "Llámame al {} mañana.", "Hubungi saya di {} besok.", "Πάρε με στο {} το πρωί.", "اتصل بي على {} غدا.", "با شماره {} تماس بگیرید.", "{} 으로 연락 주세요.", "请打 {} 找我。", "Zəng edin: {}", "Kira ni a {} gobe.", "My brother's phone is {} now.", "Text {} when you get there.",
    ),
    "id": (
        "Her passport number is {} according to the file.", "The officer wrote down {} as his national identity number.", "Driver's licence {} expires in May.", "Taxpayer {} has not replied yet.", "She entered her social security number, {}, by mistake.", "Mi DNI es {} y caduca pronto.", "NIK saya {} sudah terdaftar.", "Ο αριθμός ταυτότητάς μου είναι {} .",
        "رقم بطاقتي الوطنية هو {} .", "کد ملی من {} است.", "제 주민등록번호는 {} 입니다.", "我的身份证号是 {} 。",
    ),
    "address": (
        "Her studio, {}, is for sale.", "The reading room, {}, opens late.", "We rent a cellar, {}, for the bicycles.", "My old school, {}, has a new roof.", "The parcel should go to {}.", "They moved to {} last spring.", "Come to {} at eight.", "The surgery at {} is closed on Mondays.", "Our new office is at {}.", "He was born at {}, above the bakery.", "Vivimos en {} desde enero.", "Saya tinggal di {} sejak kecil.", "Μένουμε στην {} από πέρυσι.", "نسكن في {} منذ سنة.", "ما در {} زندگی می‌کنیم.", "우리는 {} 에 살고 있습니다.", "我们住在{}。", "Biz {} ünvanında yaşayırıq.",
    ),
}
#: Sentences without personal information. {W} is an ordinary word with a capital, {num} a number that is no phone or identity number.
PLAIN_FRAMES = {
    "en": (
        "The committee met in Geneva on Tuesday.", "Every lorry has to stop at the border.", "Trains from Paris arrive at the North Station.", "{W} is sold by weight in most shops.", "We spent Easter in Portugal.", "Most of the documents are in French or German.", "Nobody in the village owns a tractor.", "The Ministry of Health published new rules.",
        "Carrots need water twice a day.", "During the winter the lake freezes.", "Her dress was made of {w} silk.", "Saint Martin's Day is a school holiday.", "The {W} Festival starts in June.", "{W} pie is served warm.", "They met in {W} Street near the bank.", "Buses to {W} Valley leave at noon.",
        "Invoice {num} is paid.", "The parcel {num} was lost.", "See section {num} of the manual.", "About {num} people voted.", "The museum was built in 1974.", "Room {num} is on the third floor.", "Follow @cityhall for news.", "It costs {num} in total.",
        "Although it rained, the match went on.", "Painting the fence took a week: two coats, one brush.", "Snow fell on the Alps.", "{W} oil burns slowly.", "At least five of the players were ill.", "Read the note: it is short.", "Dogs bark when the post comes.", "Chapter {num} deals with taxes.",
        "In {num} the fair drew {num} visitors.", "Volume {num} has {num} pages, maps included.", "Turnout was {num} between {num} and {num}.", "Stock fell to {num} units by March.", "Form {num} replaces form {num}.", "Her score was {num} points.", "Line {num} of the file is empty.", "Figure {num} shows the trend.",
        "Tomorrow, the roof will be painted.", "In spring, farmers plough the upper field.", "Without salt, bread tastes flat.", "Grandparents, parents and children shared one room.", "Cooks prefer {w} to butter.", "Our choir rehearses on Mondays.", "Bridges freeze before roads do.", "My uncle plays chess with the postman.",
        "Nobody told the driver where to turn.", "Her aunt keeps bees near Oxford.", "Their landlord raised the rent.", "Half the class was absent.", "To the left, you see the town hall.", "Passengers for Lisbon use gate {num}.", "A neighbour fed the cat.", "This recipe is from Bengal.",
        "Not everyone likes {w} tea.", "Whoever arrives first opens the shutters.", "Fishermen mend their nets in winter.", "Answers came from Kenya, Peru and Japan.", "Students asked for longer breaks.", "On {W} Hill the wind never stops.", "Around noon, shops pull down their blinds.", "Pupils wrote: more sport, fewer tests.",
        "By law, every cellar needs a drain.", "Under the table, the cat slept.", "Yes — a red one, with buttons.", "Kitchens in Rome are small.", "One of the clerks speaks Dutch.", "Old maps show a mill here.", "Teachers met the mayor in the library.", "Between meals, guests play cards.",
        "The Red Cross opened an office in Nairobi.", "Summer begins late in Norway.", "{W} trees line the road.", "One winner was drawn from {num} entries.", "Version {num} of the program is out.", "Good shoes matter more than a good map.", "Windows should stay closed at night.", "Bus {num} stops near {W} Bridge.",
        "Before lunch, the printer ran out of paper.", "Twelve boats left the harbour at dawn.", "English is taught from the first year.", "Batch {num} was recalled.", "Buy {w} or pears — whatever is ripe.", "What time does the bank close?", "The tour of {W} Island takes an hour.", "As far as I know, the lift is broken.",
    ),
    "es": ("La casa blanca — con jardín — está lejos.", "Mi tía guarda las llaves en la cocina.", "¿Dónde queda el parque de tu ciudad?", "Cuando nieva, los vecinos limpian la acera.", "El Ministerio de Salud publicó normas.", "Por la mañana bebemos café, por la noche té.", "La tienda vende zapatos — también cuerdas.", "El informe tiene {num} páginas, mapas incluidos.", "Votaron {num} personas en {num}.", "Los trenes de París llegan al norte.", "Cada camión para en la frontera.", "El museo abrió en 1974.", "La factura {num} está pagada.", "Nadie tiene tractor en la aldea.", "En invierno el lago se congela.", "Muchos documentos están en francés.", "Todos los perros ladran: llega el correo."),
    "id": ("Kakek saya memelihara ayam.", "Kakak saya bekerja di bank.", "Saya menunggu bus malam.", "Rumah putih — dengan kebun — jauh dari sini.", "Paman saya menyimpan kunci di dapur.", "Di mana taman di kotamu?", "Ketika banjir, tetangga saling membantu.", "Kementerian Kesehatan menerbitkan aturan.", "Pagi hari kami minum kopi, malam hari teh.", "Toko itu menjual sepatu — juga tali.", "Laporan itu memuat {num} halaman, termasuk peta.", "Sekitar {num} orang memilih.", "Kereta dari Paris tiba di utara.", "Setiap truk berhenti di perbatasan.", "Museum dibuka tahun 1974.", "Faktur {num} sudah dibayar.", "Sebagian besar dokumen berbahasa Prancis.", "Musim dingin danau membeku.", "Banyak orang menunggu bus: hujan lagi.", "Bengkel tutup hari Senin."),
    "su": ("Imah bodas — aya kebonna — jauh ti dieu.", "Paman kuring neundeun konci di dapur.", "Di mana taman di kota anjeun?", "Lamun caah, tatangga silih tulungan.", "Isuk-isuk urang nginum kopi, peuting entéh.", "Toko éta ngajual sapatu — tali ogé.", "Laporan éta {num} kaca, peta kaasup.", "Kira-kira {num} jalma milih.", "Karéta ti Paris datang ka kalér.", "Unggal treuk eureun di wates.", "Musium dibuka taun 1974.", "Faktur {num} geus dibayar.", "Loba jalma ngadagoan beus.", "Usum hujan jalan leueur.", "Béngkél tutup poé Senén.", "Anjing nyegog: tukang pos datang."),
    "ha": ("Farin gida — da lambu — yana nesa.", "Kawuna yana ajiye mabuɗi a kicin.", "Ina lambun birninku yake?", "Idan aka yi ambaliya, maƙwabta suna taimako.", "Da safe muna shan kofi, da dare kuma shayi.", "Kantin yana sayar da takalma — har da igiya.", "Rahoton yana da shafi {num}, har da taswira.", "Kimanin mutane {num} suka yi zaɓe.", "Jirgin ƙasa daga Paris ya iso arewa.", "Kowace mota tana tsayawa a iyaka.", "An buɗe gidan tarihi a 1974.", "An biya takarda {num}.", "Mutane da yawa suna jiran bas.", "Lokacin sanyi tafki yana daskarewa.", "Karnuka suna haushi: wasiƙa ta iso.", "Kantin yana rufe ranar Litinin."),
    "az": ("Ağ ev — bağçası ilə — uzaqdadır.", "Əmim açarları mətbəxdə saxlayır.", "Şəhərinizdə park haradadır?", "Qar yağanda qonşular yolu təmizləyir.", "Səhər qəhvə içirik, axşam çay.", "Mağaza ayaqqabı satır — ip də var.", "Hesabatda {num} səhifə var, xəritələr daxil.", "Təxminən {num} nəfər səs verdi.", "Parisdən gələn qatar şimala çatır.", "Hər yük maşını sərhəddə dayanır.", "Muzey 1974-cü ildə açılıb.", "Faktura {num} ödənilib.", "Çox adam avtobus gözləyir.", "Qışda göl donur.", "İtlər hürür: poçt gəldi.", "Sənədlərin çoxu fransızcadır."),
    "el": ("Το λευκό σπίτι — με κήπο — είναι μακριά.", "Ο θείος μου κρατά τα κλειδιά στην κουζίνα.", "Πού είναι το πάρκο στην πόλη σας;", "Όταν χιονίζει, οι γείτονες καθαρίζουν τον δρόμο.", "Το πρωί πίνουμε καφέ, το βράδυ τσάι.", "Το μαγαζί πουλά παπούτσια — και σχοινιά.", "Η αναφορά έχει {num} σελίδες, μαζί με χάρτες.", "Ψήφισαν περίπου {num} άτομα.", "Τα τρένα από το Παρίσι φτάνουν βόρεια.", "Κάθε φορτηγό σταματά στα σύνορα.", "Το μουσείο άνοιξε το 1974.", "Το τιμολόγιο {num} πληρώθηκε.", "Πολλοί περιμένουν το λεωφορείο.", "Τον Ιανουάριο η λίμνη παγώνει.", "Τα σκυλιά γαβγίζουν: ήρθε το ταχυδρομείο.", "Κανείς δεν έχει τρακτέρ."),
    "ar": ("غطاء الطاولة — غطاء الطاولة الأزرق", "كرسي (صغير) بجانب الباب.", "يزرع جيراننا الطماطم في الحديقة.", "ذهب أصدقائي إلى البحر مع الأطفال.", "أين تقع الحديقة في مدينتكم؟", "رسمت الطفلة بيتا — وشجرة كبيرة.", "قالت الصحف إن الطقس سيتحسن.", "السيدة المسنة تسكن قرب المحطة.", "نشرب القهوة صباحا، والشاي مساء.", "يبيع المحل الأحذية — والحبال أيضا.", "في التقرير {num} صفحة، مع الخرائط.", "صوت نحو {num} شخص.", "في الصباح (قبل العمل) نقرأ الجريدة.", "سأل المعلم عن الطقس ثم كتب على اللوح.", "تصل القطارات من باريس إلى الشمال.", "تقف كل شاحنة عند الحدود.", "افتتح المتحف سنة 1974.", "دفعت الفاتورة {num}.", "ينتظر كثير من الناس الحافلة.", "تتجمد البحيرة في يناير.", "معظم الوثائق بالفرنسية.", "الورشة مغلقة يوم الإثنين: عطلة."),
    "fa": ("میز کوچک (چوبی) کنار در است.", "پرده آبی — پرده سبز", "همسایه‌ها باغچه را آب می‌دهند.", "بچه‌ها با هم به کتابخانه رفتند.", "پارک شهر شما کجاست؟", "دوست خوب کم است — وقت هم کم است.", "آقای همسایه هر روز پیاده می‌رود.", "کارگران با کامیون آجر آوردند.", "صبح قهوه می‌نوشیم، شب چای.", "مغازه کفش می‌فروشد — طناب هم دارد.", "گزارش {num} صفحه دارد، با نقشه.", "حدود {num} نفر رأی دادند.", "صبح‌ها (پیش از کار) روزنامه می‌خوانیم.", "با قطار از شهر به روستا رفتیم.", "قطارهای پاریس به شمال می‌رسند.", "هر کامیون در مرز می‌ایستد.", "موزه در سال 1974 باز شد.", "فاکتور {num} پرداخت شد.", "خیلی‌ها منتظر اتوبوس هستند.", "دریاچه در دی یخ می‌زند.", "بیشتر مدارک به فرانسوی است.", "کارگاه دوشنبه بسته است: تعطیل."),
    "ko": ("주말마다 공기놀이 (5번)를 합니다.", "장보기 (매주)는 힘듭니다.", "아이는 노래하기 (합창)를 좋아합니다.", "우리 집 마당에는 석류나무 (한 그루)가 있습니다.", "고구마튀김 — 문어구이", "선물하기 (작은 것)는 어렵습니다.", "구두닦기 (7)를 배웁니다.", "저는 오래된 연필깎이 (12)를 모읍니다.", "우리는 한국에서 여러 나라로 이사를 갔습니다.", "이번 주에는 정말 조금 바쁩니다.", "모두가 오늘 전체 회의에 옵니다.", "문이 열리고 손님이 들어옵니다.", "여러 사람이 강을 건너 산으로 갔습니다.", "조용한 방에서 선물을 포장합니다.", "어머니는 시장에서 고구마를 삽니다.", "나무 밑에 남은 배가 있습니다.", "장마가 오면 지붕을 고쳐야 합니다.", "최근에는 서울과 부산을 오갑니다.", "안개: 운전은 위험합니다.", "여러분의 도시에서는 공원이 어디에 있습니까?", "아침에는 커피를, 저녁에는 차를 마십니다.", "가게는 구두를 팝니다 — 끈도 있습니다.", "보고서는 {num} 쪽이고, 지도도 있습니다.", "약 {num} 명이 투표했습니다.", "봄에는 바람이 불고, 가을에는 안개가 낍니다.", "정원 (작은 것) 옆에 우물이 있습니다.", "오늘은 서점에 갔고, 내일은 병원에 갑니다.", "한 번은 조용한 곳에서 쉬었습니다.", "파리에서 온 기차가 북쪽에 도착합니다.", "모든 트럭은 국경에서 멈춥니다.", "박물관은 1974년에 열렸습니다.", "청구서 {num} 는 지불되었습니다.", "많은 사람이 버스를 기다립니다.", "겨울에는 호수가 얼어붙습니다.", "서류는 대부분 프랑스어입니다.", "공장은 월요일에 쉽니다: 휴일."),
    "zh": ("黄色的雨伞放在门边。", "白天高温，晚上江边凉快。", "石头和方砖堆在田里。", "妈妈常常用金属锅煮汤。", "任何人都能申请，万一不行再说。", "老师和同学们安静地等车。", "毛衣、皮鞋、雨衣都要洗。", "夏季孟买很热。", "你们城市的公园在哪里？", "史书上没有记载这座桥。", "我和朋友们常去江边。", "邻居们给花园浇水。", "早上喝咖啡，晚上喝茶。", "商店卖鞋子 — 也卖绳子。", "报告有{num}页，包括地图。", "大约{num}人投票。", "春天刮风，秋天有雾。", "花园 (小的) 旁边有一口井。", "今天去书店，明天去医院，后天高考。", "方向不对，马上和司机说，别走石头路。", "巴黎来的火车到达北站。", "每辆卡车都在边境停下。", "博物馆建于1974年。", "发票 {num} 已付。", "很多人在等公共汽车。", "一月湖水结冰，孩子们高兴。", "大部分文件是法语，周末再看。", "工厂星期一休息：放假。"),
    "as": ("চুবুৰীয়াবোৰে বাগিচাত পানী দিয়ে।", "বন্ধু কেইজনে একেলগে পুথিভঁৰাললৈ গ'ল।", "আপোনালোকৰ চহৰত উদ্যান ক'ত আছে?", "ছবি এখন আঁকিলে — এজোপা গছো।", "নাম পঞ্জীয়ন বন্ধ হ'ল।", "ৰাতিপুৱা কফি খাওঁ, গধূলি চাহ।", "দোকানে জোতা বেচে — ৰছীও আছে।", "প্ৰতিবেদনখনত {num} পৃষ্ঠা আছে, মানচিত্ৰসহ।", "প্ৰায় {num} জনে ভোট দিলে।", "পেৰিছৰ পৰা ৰেল উত্তৰলৈ আহে।", "প্ৰতিখন ট্ৰাক সীমান্তত ৰয়।", "যাদুঘৰ 1974 চনত খোলা হ'ল।", "চালান {num} দিয়া হ'ল।", "বহুতে বাছলৈ ৰৈ আছে।", "শীতত হ্ৰদ গোট মাৰে।", "কাৰখানা সোমবাৰে বন্ধ: ছুটী।", "বেছিভাগ নথি ফৰাচীত।"),
    "am": ("ጎረቤቶች አትክልቱን ያጠጣሉ።", "ልጆቹ አብረው ወደ ቤተ መጻሕፍት ሄዱ።", "በከተማችሁ መናፈሻ የት ነው?", "ቤት ሣለች — ትልቅ ዛፍም።", "ከሰዓት በኋላ ከገበያ ተመለሱ።", "የአባቴ ወንድም ከብት ያረባል።", "ጠዋት ቡና እንጠጣለን፣ ማታ ሻይ።", "ሱቁ ጫማ ይሸጣል — ገመድም አለ።", "ሪፖርቱ {num} ገጽ አለው፣ ካርታ ጨምሮ።", "ወደ {num} ሰዎች ድምፅ ሰጡ።", "ከፓሪስ የሚመጣው ባቡር ሰሜን ይደርሳል።", "እያንዳንዱ የጭነት መኪና ድንበር ላይ ይቆማል።", "ሙዚየሙ በ1974 ተከፈተ።", "ደረሰኝ {num} ተከፍሏል።", "ብዙ ሰዎች አውቶቡስ ይጠብቃሉ።", "በክረምት ሐይቁ ይቀዘቅዛል።", "ፋብሪካው ሰኞ ዝግ ነው፡ በዓል።", "አብዛኛው ሰነድ በፈረንሳይኛ ነው።"),
}
#: Ordinary words that are also names, and some that are not.
WORDS = "Violet Daisy Olive Basil Heather Robin Jasmine Pearl Forest Summer Cotton Copper Maple Cherry Walnut Pepper".split()
#: # is a digit, @ a capital letter.
PHONES = ("+## ## #### ####", "+# ### ### ####", "(###) ###-####", "###.###.####", "###-####", "0#### ######", "00## #### ### ###", "0## #### ####", "###-##-## ##", "08##-####-####", "010-####-####", "02-###-####", "1##########", "+86 1## #### ####", "1##-####-####", "### ### ###", "+34 ### ## ## ##", "+### (##) ###-##-##", "+### ## ### ####", "0### ## ## ##", "0### ### ####", "+98 9## ### ####", "+213 ### ## ## ##", "0##/#######", "+###########", "(0##) #### ####", "+251 9# ### ####", "09#########", "+82 10 #### ####", "07### ######")
IDS = ("@@#######", "@@######@", "@@ ## ## ## @", "9########", "0########", "###-##-####", "@## ### ### @", "@@-#######", "####.####.####.####", "################", "######-#######", "#############", "##################", "@-#######-@", "########@", "@########", "########-@", "#########", "##########", "###########", "@@@########", "@ ######", "#################X", "##.###.###-#")
NUMBERS = ("####-####-##", "##-##-#", "#.##.#", "######", "20##-##-##", "#,###.##", "####-#####", "##.##.####", "########", "###-####-#", "##:##", "###", "20##-20##", "#/##/####", "##", "###,###", "978-#-##-######-#", "#####")
LABELLED = ("{l}: {}", "({l}: {})", "— {}", "{L}: {}", "{l} {}", "{L} - {}")
_SYLLABLES = "bra ten mi wy del kes tor lan ve dra hol mar sel fen co bri tal os be wil me had do ra ni ka lo su".split()
#: Letters that made-up names of scripts without capitals consist of.
_LETTERS = {"ar": "مسعدنيلارحكف", "fa": "مسیدنرالهکشپ", "ko": "가나다라마바사아자하", "zh": "昊彤宸菲翰瑶岩舒锦棠", "as": "মদনৰাকলপসতজ", "am": "መሰለበታነዳገሪ"}
_JOINT = {"zh": "", "ko": ""}


def part(items: tuple | list, k: set[int]) -> list:
    """The items dealt to the parts in k."""
    return [x for i, x in enumerate(items) if i % PARTS in k] or list(items)


def digits(r: random.Random, pattern: str) -> str:
    """A number by its pattern; published examples often have a group of zeros."""
    out = "".join(str(r.randint(0, 9)) if c == "#" else r.choice("ABCEGHJKLMNPRSTZ") if c == "@" else c for c in pattern)
    if r.random() < 0.25:
        runs = [i for i, c in enumerate(out) if c.isdigit()]
        for i in runs[: r.randint(2, 4)] if r.random() < 0.5 else runs[2 : r.randint(4, 6)]:
            out = out[:i] + "0" + out[i + 1 :]
    return out


class Maker:
    """Texts from the frames, names and places of some parts."""

    def __init__(self, r: random.Random, parts: set[int], labels: dict[str, str]) -> None:
        self.r, self.parts = r, parts
        self.labels = {k: part(v.split("|"), parts) for k, v in labels.items()}
        self.known: set[tuple[str, str]] = set()

    def lexicon(self) -> tuple[tuple[str, str], ...]:
        """What a name list would hold: half of the names and words."""
        if not self.known:
            pool = [(n, "given") for x in GIVEN.values() for n in x.split()] + [(n, "family") for x in FAMILY.values() for n in x.split()] + [(n, "given") for n in WORDS]
            self.known = set(random.Random(5).sample(pool, len(pool) // 2))
        return tuple(sorted(self.known))

    def invented(self, lang: str) -> str:
        r = self.r
        if lang in _LETTERS:
            return "".join(r.choice(_LETTERS[lang]) for _ in range(r.randint(1, 2) if lang == "zh" else r.randint(2, 4)))
        return "".join(r.sample(_SYLLABLES, r.randint(2, 3))).capitalize()

    def person(self, lang: str) -> str:
        r = self.r
        given = r.choice(part(GIVEN[lang].split(), self.parts)) if r.random() < 0.6 else self.invented(lang)
        family = r.choice(part(FAMILY[lang].split(), self.parts)) if r.random() < 0.6 or lang == "ko" else self.invented(lang)[:1] if lang == "zh" else self.invented(lang) + r.choice(("", "son", "by", "ez", "ov")) * (lang not in _LETTERS)
        if lang in _JOINT:
            return family + given
        if lang in _LETTERS:
            return given if r.random() < 0.25 else f"{given} {family}"
        name = r.choice((f"{given} {family}",) * 4 + (given,) * 4 + (f"{family}, {given}", f"{given[0]}. {family}", f"{given} {r.choice('ABDEKMOR')}. {family}", f"{given} {self.invented(lang)} {family}"))
        if lang == "es" and r.random() < 0.1:
            name = f"{given} de la {family}"
        return name.upper() if r.random() < 0.06 else name

    def email(self) -> str:
        r = self.r
        a, b = self.invented("en").lower(), self.invented("en").lower()
        user = r.choice((f"{a}{r.choice('._-+')}{b}", f"{a}{r.randint(1, 99)}", f"{a[0]}{b}"))
        host, top = self.invented("en").lower(), r.choice(("com", "org", "net", "info", "edu", "co.uk", "es", "test", "invalid"))
        mail = r.choice((f"{user}@{host}.{top}",) * 4 + (f"{user}[at]{host}[dot]{top}", f"{user} (at) {host}.{top}", f"{user} at {host} dot {top}"))
        return mail.upper() if r.random() < 0.1 else mail

    def value(self, kind: str, lang: str) -> str:
        r = self.r
        if kind == "name":
            return self.person(lang)
        if kind == "email":
            return self.email()
        if kind == "address":
            return r.choice(part(PLACES[lang], self.parts)).format(n=r.randint(1, 4800) if r.random() < 0.1 else r.randint(1, 260), m=r.randint(1, 30), k=r.randint(1, 9))
        return digits(r, r.choice(PHONES if kind == "phone" else IDS))

    def plain(self, lang: str) -> str:
        r = self.r
        w = r.choice([*WORDS, *(self.invented("en") for _ in range(4))])
        return r.choice(part(PLAIN_FRAMES[lang], self.parts)).format(W=w, w=w.lower(), num=digits(r, r.choice(NUMBERS)))

    def frame(self, kind: str, lang: str) -> str:
        r = self.r
        if kind == "name":
            roll = r.random()
            if roll < 0.15:
                label = r.choice(self.labels["name"])
                return r.choice(LABELLED[:4]).format("{}", l=label, L=label.capitalize())
            if roll < 0.25:
                return "{}: " + self.plain(lang)
            s = r.choice(part(NAME_FRAMES[lang], self.parts))
            return s.replace("{}", "{} <@>", 1) if r.random() < 0.12 and "{} " in s and "'s" not in s else s
        if r.random() < 0.6:
            label = r.choice(self.labels[kind])
            return r.choice(LABELLED).format("{}", l=label, L=label.capitalize())
        return r.choice(part(OTHER_FRAMES[kind], self.parts))

    def text(self) -> tuple[str, list[tuple[int, int, str]], str]:
        """A text, its spans, and its main language."""
        r = self.r
        main = r.choice(list(GIVEN)) if r.random() < 0.65 else "en"
        parts, spans, at = [], [], 0
        gap = r.choice((" ", " ", "\n", "\n\n", "\r\n", "\t", "  ", "\n "))
        for _ in range(r.randint(2, 9)):
            lang = main if r.random() < 0.9 else "en"
            if r.random() < 0.55:
                s = self.plain(lang)
            else:
                kind = r.choice(("email", "phone", "id", "address", "name", "name", "name"))
                value, s = self.value(kind, lang), self.frame(kind, lang)
                where = s.index("{}")
                spans.append((at + where, at + where + len(value), kind))
                s = s.replace("{}", value, 1)
                if "<@>" in s:
                    mail = self.email()
                    s = s.replace("<@>", f"<{mail}>")
                    spans.append((at + s.index(f"<{mail}>") + 1, at + s.index(f"<{mail}>") + 1 + len(mail), "email"))
            parts.append(s + gap)
            at += len(s) + len(gap)
        return "".join(parts), spans, main


def common_names() -> set[tuple[str, str]]:
    """(name, role) of the common names above, which any name list would hold."""
    return {(n, role) for by, role in ((GIVEN, "given"), (FAMILY, "family")) for ns in by.values() for n in ns.split() if len(n) > 1}


def sources() -> tuple[list[str], list[str]]:
    """(sentences with their places open, names streets and towns): what must
    not occur in any table. Words that label or are ordinary are left out."""
    frames = [f for by in (NAME_FRAMES, OTHER_FRAMES, PLAIN_FRAMES) for fs in by.values() for f in fs]
    names = [n for by in (GIVEN, FAMILY) for ns in by.values() for n in ns.split() if len(n) > 2]
    return frames, names + [p.format(n="", m="", k="") for ps in PLACES.values() for p in ps]
