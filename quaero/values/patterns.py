"""Regular expressions. All of them are fixed values: results depend on every branch.

They are read without regard to case and with Unicode word classes; see
``functions.text.uni``.
"""

# Fixed value: question intent.
DEADLINE_WORDS = (
    r"\b(termen\w*|deadline|срочн|срок|c[aâ]t\s+dureaz[aă]|cat\s+dureaza|zile\s+lucr|"
    r"[îi]n\s+c[aâ]t\s+timp|in\s+cat\s+timp)\b"
)
CONTACT_WORDS = (
    r"\b(contact|telefon|email|e-mail|adresa|adres[aă]|date\s+de\s+contact|"
    r"cum\s+(?:le|îi|o|ii)\s+(?:pot\s+)?contact|куда\s+звонить|телефон|адрес|контак)\b"
)
PERMIT_WORDS = r"autoriz|construir|urbanism|разрешен|permit|building|certificat\s+de\s+urban"
JOB_WORDS = (
    r"(?:concurs|vacant|angajar|ваканс|конкурс|job\s*opening|posturi?\s+vacant|"
    r"func[tț](?:ii|ia|ie|iei)?\s+(?:public|deschis|vacant)|"
    r"funct(?:ii|ia|ie|iei)?\s+(?:public|deschis|vacant)|"
    r"posturi?\s+(?:deschis|vacant)|ocuparea\s+func|locuri\s+de\s+munc[aă]|"
    r"\baplic[aă]|\baplica\b|candidat(?:ur[aă])?)"
)
LIST_WORDS = (
    r"\b(exist[aă]|deschis|deschise|list[aă]|care\s+sunt|ce\s+(?:func|concur|anunt|anunț|post)|"
    r"toate|c[aâ]te|cate|открыт|есть\s+ли|which\s+(?:jobs|vacancies|contests)|"
    r"what\s+(?:jobs|vacancies|positions)|la\s+care\s+pot|pot\s+(?:s[aă]\s+)?aplic|"
    r"unde\s+(?:pot\s+)?aplic|ce\s+posturi|enumer|spune[- ]mi\s+(?:toate|care))\b"
)
CURRENT_WORDS = (
    r"\b(acum|current|now|deschis|deschise|открыт|ast[aă]zi|astazi|în\s+prezent|in\s+prezent|"
    r"disponibil|active|ongoing|vacant[aăe]?|сейчас|текущ|актуаль|aplic|aplica|angajar)\b"
)
HOWTO_WORDS = r"\b(cum|how|как|pa[sș]i|procedure|procedur)\b"

# Fixed value: wider contact and current-state readings used next to the ones above.
WIDE_CONTACT_WORDS = (
    r"\b(contact|telefon|email|e-mail|adresa|adresă|date\s+de\s+contact|"
    r"cum\s+(?:le|îi|o)\s+(?:pot\s+)?contact|куда\s+звонить|телефон|адрес|контак)\b"
)
GATE_DEADLINE_WORDS = (
    r"\b(termen\w*|deadline|срочн|срок|cât\s+durează|cat\s+dureaza|zile\s+lucr|"
    r"în\s+cât\s+timp|in\s+cat\s+timp)\b"
)
GATE_CURRENT_WORDS = (
    r"\b(acum|current|now|deschis|открыт|сейчас|vacant[ăaе]?|funcți[ei].*vacant|angajar|job|"
    r"astăzi|astazi|aplic|aplica)\b"
)
RESEARCH_LIST_WORDS = (
    r"\b(exist[ăa]|deschis|list[ăa]|care\s+sunt|ce\s+concurs|toate|câte|cate|открыт|есть\s+ли|"
    r"pot\s+(?:să\s+)?aplic)\b"
)

# Fixed value: scope.
CITY_HINTS = (
    r"(?:primar|pretur|chi[sș]in[aă]u|municip|autoriz|urbanism|construir|certificat|peti[tț]|"
    r"sesizar|tax[aă]|impozit|parcaj|gunoi|salubriz|concurs|func[tț]i|vacant|angajar|dgaurf|"
    r"ghiseu|ghi[sș]eu|contact|telefon|adres[aă]|program\s+de\s+lucru|act\s+necesar|"
    r"dispozi[tț]|hot[aă]r[aâ]r|regulament|e-permis|locuin|botanica|buiucani|ciocana|"
    r"r[aâ][sș]can|centru\s+sector|gradinit|grădini[tț]|scol[aă]|școal|transport\s+public|"
    r"аптека|примар|претур|кишин|разрешен|налог|конкурс)"
)
AUTHORITY_WORDS = (
    r"prim[aă]ri|pretur|dgaurf|ghiseu\s+unic|ghi[sș]eu\s+unic|consiliul\s+municipal|city\s+hall|"
    r"municipal\s+council|примар|претур|городск(?:ая|ой)\s+администрац"
)
PUBLIC_SERVICE_WORDS = (
    r"autoriz|permis|certificat|peti[tț]|sesizar|tax[aă]|impozit|concurs|func[tț]i|vacant|"
    r"servici|program|contact|telefon|adres[aă]|acte|document|regulament|hot[aă]r[aâ]r|permit|"
    r"petition|tax|public\s+job|opening\s+hours|разрешен|документ|налог|конкурс|контакт|адрес|"
    r"услуг"
)
CIVIC_TOPIC_WORDS = (
    r"prim[aă]ri|pretur|dgaurf|autoriz|urbanism|peti[tț]|sesizar|impozit|parcaj|salubriz|concurs|"
    r"func[tț]i\s+public|transport\s+public|permit|petition|municipal\s+service|city\s+hall|"
    r"public\s+job|разрешен|примар|претур|налог|конкурс"
)
BUILDING_WORDS = r"constru|build|строит|постро|строитель"
PAPERWORK_WORDS = (
    r"acte|document|hârt|hart|autoriza|permis|aprobar|what\s+do\s+i\s+need|papers|approval|"
    r"permit|документ|бумаг|разрешен|что\s+нужно"
)
OFF_TOPIC_PHRASES = (
    r"(?:cine\s+(?:e[sș]ti|esti|sunt)\s+(?:tu|eu)|who\s+are\s+you|who\s+am\s+i|"
    r"ce\s+(?:e[sș]ti|esti)\s+tu|ce\s+e[sș]ti\s+\?|what\s+are\s+you|cum\s+te\s+cheam[aă]|"
    r"what\s+is\s+your\s+name|your\s+name|despre\s+tine|about\s+yourself|prezint[aă]-te|"
    r"introduce\s+yourself|как\s+тебя\s+зовут|кто\s+ты|что\s+ты\s+такое|cine\s+sunt\s+eu|"
    r"как\s+меня\s+зовут|кто\s+я|ce\s+(?:mi-ai|ti-am|ți-am|ti\s+am)\s+(?:scris|spus|zise)|"
    r"what\s+did\s+i\s+(?:say|write)|previous\s+message|istoric(ul)?\s+chat|îți\s+amintești|"
    r"iti\s+amintesti|remember\s+what|spune[- ]mi\s+o\s+glum[aă]|tell\s+me\s+a\s+joke|"
    r"re[tț]et[aă]|recipe|c[aâ]ntec|melodie|film\s+recomand|"
    r"scrie[- ]mi\s+(?:un\s+)?(?:cod|script|poem|eseu)|write\s+(?:me\s+)?(?:code|poem|essay)|"
    r"cum\s+s[aă]\s+fac\s+bani|crypto|bitcoin|investe[sș]te|vremea\s+la\s+(?!chi)|weather\s+in|"
    r"capitala\s+(?:fran[tț]|german|ital)|c[aâ]te\s+planete|who\s+is\s+elon|ce\s+este\s+python|"
    r"^(?:hello|salutare|salut|bun[aă]|hi|hey|добрый\s+день|привет)[\s!.?]*$)"
)
IDENTITY_PHRASES = (
    r"(?:cine\s+(?:e[sș]ti|esti)\s+tu|who\s+are\s+you|ce\s+(?:e[sș]ti|esti)\s+tu|"
    r"cum\s+te\s+cheam[aă]|what\s+is\s+your\s+name|despre\s+tine|prezint[aă]-te|"
    r"introduce\s+yourself|кто\s+ты|как\s+тебя\s+зовут|what\s+are\s+you|"
    r"ce\s+fel\s+de\s+(?:asistent|bot|ai))"
)
GATE_OFF_TOPIC_PHRASES = (
    r"(?:cine\s+sunt\s+eu|who\s+am\s+i|как\s+меня\s+зовут|кто\s+я"
    r"|ce\s+(?:mi-ai|ti-am|ți-am|ti\s+am)\s+(?:scris|spus|zise)"
    r"|what\s+did\s+i\s+(?:say|write)|previous\s+message|istoric(ul)?\s+chat"
    r"|îți\s+amintești|iti\s+amintesti|remember\s+what"
    r"|spune[- ]mi\s+o\s+glumă|tell\s+me\s+a\s+joke|cum\s+te\s+cheamă|what\s+is\s+your\s+name)"
)

# Fixed value: follow-ups and answer reuse.
FOLLOW_UP_OPENING = r"^\s*(?:dar|și|si|what\s+about|and|а\s+в)\b"
ENGLISH_FOLLOW_UP_OPENING = r"^\s*(?:what\s+about|and)\b"
REUSE_FOLLOW_UP = (
    r"^\s*(?:dar|și|si|and|what\s+about|а\s+в)\b|"
    r"\b(?:asta|acesta|aceasta|acelea|that|those|it)\b"
)
TIME_BOUND_WORDS = (
    r"\b(today|tomorrow|yesterday|latest|recent|currently|this\s+(?:week|month|year)|"
    r"ast[aă]zi|m[aâ]ine|ieri|ultim|recent|s[aă]pt[aă]m[aâ]n|luna\s+aceasta|anul\s+acesta|"
    r"сегодня|завтра|вчера|сейчас|последн|недел)\b"
)

# Fixed value: answers without evidence.
MISSING_ANSWER = (
    r"(?:\bnu\s+(?:am\s+|a\s+fost\s+|s-(?:a|au)\s+|au\s+fost\s+)?"
    r"(?:identificat[ăae]?|g[ăa]sit[ăae]?|disponibil[ăae]?)\b|"
    r"\binforma[țt]i(?:a|ile)\s+nu\s+(?:a\s+fost|au\s+fost|este|sunt)\b|"
    r"\bnu\s+exist[ăa]\s+(?:informa[țt]ii|detalii|date)\b|"
    r"\bnot\s+found\s+in\s+(?:the\s+)?(?:available\s+)?(?:municipal\s+)?corpus\b|"
    r"\bno\s+(?:current|matching|relevant|available)\s+(?:information|details|announcement)\b|"
    r"\bинформаци[яи]\s+не\s+найден\w*\b|\bstatus\s*[:=]\s*missing\b)"
)
MISSING_WORD = r"^(?:missing|lips[aă]|не\s+найдено|not\s+found\.?)$"
GENERIC_ASSISTANT = (
    r"(?:sunt\s+un\s+asistent|I\s+am\s+(?:an?\s+)?(?:AI\s+)?assistant"
    r"|pot\s+oferi\s+informații\s+despre\s+serviciile\s+publice"
    r"|для\s+того\s+чтобы\s+предоставить\s+точную"
    r"|vă\s+rog\s+să[- ]mi\s+specificați\s+ce\s+doriți)"
)
ANSWER_PLACEHOLDER = (
    r"(?:\[expire_date\]|\[featured_image\]|\[n\]|§LINK§[^§]*§?|"
    r"Disponibil[ăa]\s+pân[aă]\s+la\s*\[?[^\]\n]*\]?|Download is available until[^\n]*)"
)
EVIDENCE_PLACEHOLDER = r"\[expire_date\]|\[featured_image\]|Download is available until[^\n]*"
URL_IN_TEXT = r"https?://[^\s)>\]]+"
QUOTED_PHRASE = "[„\"«](.{4,80})[”\"»]"

# Fixed value: evidence rules.
CAPTCHA_SHELL = (
    r"confirm[aă]\s+c[aă]\s+nu\s+e[sș]ti\s+robot|captcha|cloudflare|just\s+a\s+moment|"
    r"attention\s+required|enable\s+javascript"
)
GENERIC_TITLES = ["acte", "pagina oficiala", "home", "acasa"]
PERMIT_BODY = r"autoriza|construire|certificat\s+de\s+urban|e-permis|dosar"
YEAR_BETWEEN = r"(?:/|[^0-9])(20\d{2})(?:/|[^0-9])"
YEAR_ALONE = r"(?<!\d)20\d{2}(?!\d)"
JOB_QUESTION_PARTS = r"concurs|func[tț]|vacant|aplic"
HOLIDAY_NOISE = (
    r"vacan[țt]e?[ai]?\s+de\s+var|gr[ăa]dini[țt]|copiilor\s+[îi]n\s+vacan"
)
HOLIDAY_NOISE_GATE = HOLIDAY_NOISE + r"|organizarea\s+activit"
REAL_VACANCY_NOISE = r"func[tț](?:iei|ia|ii)\s+public|ocuparea\s+func|anun[țt].{0,40}concurs"
PAST_EVENT = (
    r"s-a\s+desf[ăa][sș]urat|a\s+fost\s+desf|rezultatele\s+finale\s+vor\s+fi\s+anun|"
    r"desemnarea\s+[îi]nving|[îi]nving[aă]tori?(?:ului)?|a\s+avut\s+loc\s+etapa"
)
OPEN_CALL = (
    r"anun[țtăa].{0,40}concurs|depune(?:rea)?\s+dosar|până\s+(?:în|la)\s+data|se\s+prelung|"
    r"aviz\s+concurs|func[tț](?:iei|ia|ii)\s+public|posturi\s+vacante|"
    r"ocuparea\s+(?:unei\s+)?func|specialist"
)
VACANCY_TITLE = r"anun[țt]|concurs|vacant|aviz|posturi\s+vacante"
VACANCY_NOISE_FOR_CONTACT = (
    r"(funcț(?:ii|ia)\s+vacant|anunț\s+cu\s+privire|concurs(?:ului)?|ocuparea\s+funcț|"
    r"probei\s+scrise|interviului\s+în\s+cadrul)"
)

# Fixed value: intent affinity, pattern and weight.
AFFINITY = {
    "autorizatie": [
        (r"e-permis|autoriza[țt]ie\s+de\s+construire", 1.2),
        (r"certificat\s+de\s+urbanism|dgaurf|autourban", 0.9),
        (r"acte\s+necesare|dosarul?\s+trebuie|lista\s+actelor", 0.7),
        (r"autoriza|construir|urbanism", 0.35),
    ],
    "concurs": [
        (r"posturi\s+vacante|func[tț]ii\s+publice\s+vacante", 1.0),
        (r"anun[țt].{0,40}concurs|aviz\s+concurs|ocuparea\s+func", 0.85),
        (r"specialist|dosar|candidat", 0.35),
    ],
    "contact": [(r"contact|telefon|e-?mail|adresa", 0.8)],
}

# Fixed value: vacancy hubs.
HUB_YEAR = r"20(?:2[5-9]|[3-9]\d)"
HUB_JOB = r"ocuparea\s+func|specialist|depune(?:rea)?\s+dosar|anun[țt].{0,40}concurs"
HUB_PAGED_URL = r"[?&]page=\d+"
HUB_BODY = (
    r"anun[țt].{0,100}concurs|specialist|depune.{0,20}dosar|func[tț](?:iei|ia)\s+public|"
    r"ocuparea\s+func"
)
WINNER_TITLE = (
    r"\b(?:[îi]nving[aă]tor|desemnarea\s+[îi]nving|c[aâ][sș]tig[aă]tor|a\s+avut\s+loc\s+etapa)\b"
)
FINISHED_BODY = r"s-a\s+desf[ăa][sș]urat|rezultatele\s+finale\s+vor\s+fi"
STILL_OPEN_BODY = r"depune(?:rea)?\s+dosar|până\s+(?:în|la)\s+data|se\s+prelung"
HUB_URL_LIKE = ["%posturi-vacante%", "%functii-vacante%", "%posturi_vacante%"]
HUB_TITLE_LIKE = ["%posturi vacante%", "%funcții vacante%", "%functii vacante%", "%funcţii vacante%"]
HUB_TITLES = ["posturi vacante", "funcții vacante", "functii vacante", "funcţii vacante", "locuri vacante"]
NOISE_TITLE_LIKE = ["%vacanț%de var%", "%vacanta%de var%", "%grădini%", "%gradinit%", "%copiilor%"]
CONTEST_TITLE_LIKE = [
    "%concurs%", "%anunț%func%", "%anunt%func%", "%funcți%vacant%", "%functii%vacant%",
    "%funcţie%vacant%", "%funcție%vacant%", "%ocuparea%func%", "%posturi%vacant%",
]
CONTEST_URL_LIKE = ["%/concurs%"]
JOB_ONLY_TITLE_LIKE = ["%concurs%", "%vacant%", "%anunț%", "%anunt%"]
JOB_ONLY_URL_LIKE = ["%concurs%", "%vacant%"]
JOB_ONLY_CONTENT_LIKE = ["%ocuparea func%"]

# Fixed value: contact fields.
PHONE = (
    r"(?:\+?373[\s\-]?)?(?:0?\d{2})[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}"
    r"|(?:\(?0?\d{2}\)?[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2})"
)
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ADDRESS = r"(?:str\.|strada|bd\.|bulevardul|aleea)\s+[^\n,;]{3,60}"

# Fixed value: dates and durations.
DATE_MENTION = (
    r"\b(\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}-\d{2}-\d{2}|"
    r"\d{1,2}\s+(?:ianuarie|februarie|martie|aprilie|mai|iunie|iulie|august|septembrie|"
    r"octombrie|noiembrie|decembrie)\s+\d{4})\b"
)
DURATION_MENTION = (
    r"(\d+\s*(?:zile?\s+lucrătoare|zile|zile\s+calendaristice|working\s+days?|дней|"
    r"рабочих\s+дней))"
)
APPLICATION_CUE = (
    r"(?:termen(?:ul|ului)?(?:\s*[-–]?\s*limit[aă])?\s+(?:de\s+)?"
    r"(?:depunere|inscriere|înscriere|inregistrare|înregistrare)|"
    r"data\s*[-–]?\s*limit[aă]|data\s+depunerii\s+dosarelor|"
    r"depunerea\s+(?:dosarelor|candidaturilor)|dosarele\s+pot\s+fi\s+depuse|"
    r"p[aâ]n[aă]\s+la\s+(?:data\s+de\s+)?|application\s+deadline|apply\s+by|closing\s+date|"
    r"срок\s+подачи|при[её]м\s+документов\s+до)"
)

# Fixed value: numeric claims.
FEE_QUESTION = (
    r"\b(tax(?:a|ă|e|ei|ele|elor)|tarif\w*|cost\w*|fee|price|сколько\s+стоит|стоимость|тариф\w*)\b"
)
DURATION_QUESTION = (
    r"\b(termen\w*|durat\w*|c[aâ]t\s+dureaz[aă]|[îi]n\s+c[aâ]t\s+timp|how\s+long|deadline|"
    r"processing\s+time|срок\w*)\b"
)
DAYS_AMOUNT = r"\b(\d{1,3})\s*(?:de\s+)?(?:zile|zi|days?|дней|дня|день)\b"
MONEY_AMOUNT = r"\b(\d{1,6}(?:[.,]\d{1,2})?)\s*(?:lei|mdl|л(?:е|ё)ев)\b"
DURATION_CUE = r"termen|durat|eliber|emit|solu[tț]ion|proces|deadline|processing|срок|выдач"
FEE_CUE = r"tax|tarif|cost|plat|achit|fee|price|стоим|тариф|оплат"
CLAIM_QUALIFIER = (
    r"\b(urgent|urgen[tț][aă]|express|persoan[aă]\s+fizic[aă]|persoan[aă]\s+juridic[aă])\b"
)
WORKING_DAYS_TAIL = r"lucr|working|рабоч"
CALENDAR_DAYS_TAIL = r"calendar|календар"

# Fixed value: institutions, first match wins; ``None`` marks a named but unknown one.
INSTITUTION_RULES = [
    ("botanica", [r"botanic"]),
    ("buiucani", [r"buiucan"]),
    ("ciocana", [r"ciocan"]),
    ("rascani", [r"r[aâ][sș]can|рышкан"]),
    ("centru", [r"\bcentr[uŭ]|центр\b", r"pretur|претур"]),
    ("dgaurf", [r"dgaurf|urbanism|arhitect"]),
    ("primarie", [r"prim[aă]rie|примар"]),
]
PERMIT_OFFICE_WORDS = r"autoriz|urban|construir|dgaurf"

# Fixed value: document types, first match wins.
DOCUMENT_TYPES = [
    ("contact", ["contact", "telefon", "email", "adresa", "adresă"]),
    ("decizie", ["dispoziț", "disposi", "распоряж", "decizie", "hotărâre", "hotarare"]),
    ("regulament", ["regulament", "codul", "lege", "normativ", "e-permis", "pasaport"]),
    ("anunt", ["anunț", "anunt", "concurs", "vacant", "noutăț", "comunicat"]),
    ("document", [".pdf", "anexa", "formular", "ghid"]),
]
DOCUMENT_TYPE_DEFAULT = "pagina"

# Fixed value: dead pages.
DEAD_PAGE = (
    r"(?:404(\s*not\s*found|\s*error)?|page\s+not\s+found|not\s+found"
    r"|pagina\s+(nu\s+a\s+fost\s+g[aă]sit[aă]|lips[eă]ște|inexistent[aă])"
    r"|nu\s+a\s+fost\s+g[aă]sit[aă]|pagina\s+solicitat[aă]\s+nu\s+exist[aă]|erori?\s*404"
    r"|страница\s+не\s+найдена|не\s+найдена|документ\s+не\s+найден"
    r"|oops[!.,]?\s*nothing\s+was\s+found|this\s+page\s+doesn.?t\s+exist"
    r"|conteúdo\s+não\s+encontrado)"
)

# Fixed value: page text clean-up.
PLACEHOLDERS = [r"\[expire_date\]", r"\[featured_image\]", r"Download is available until\s*"]
READ_MORE_LINE = r"^(citește|citeste)\s+mai\s+mult$"
SHARE_LINE = r"^(?:distribuie:?|share:?)$"
FILE_SIZE_LINE = r"^\d+(?:\.\d+)?\s*(?:KB|MB|GB)$"
DOWNLOAD_LINE = (
    r"^(?:version|mărime fișier|marime fisier|file size|număr de descărcări|"
    r"numar de descarcari|download count|încărcare fișier|incarcare fisier|upload(?:ed)?|"
    r"ultimul update|last update|descarcă|download|\d+\s*fi[sș]ier\(e\)|\d+\s*file\(s\))\s*:?\s*$"
)
MENU_LINE = (
    r"^(Pretura|Pretor|Vicepretori|Organigrama|Galerie|PDCP|Achizi[tț]ii|Transparen[tț]a|"
    r"Activitatea|INSTITU[TŢ]II|Sectorul\s+\w+|Comisii\s+permanente|Aparatul\s+Preturii|"
    r"Secretarul-Preturii|Audien[tț]a\s+cet[aă][tț]enilor|Regulamente\s+[șs]i\s+atribu[tț]ii|"
    r"Servicii\s+prestate|Toate|Activit[aă][tț]i)$"
)
MENU_BLOB = (
    r"(?:DISPOZI[TȚ]IILE\s+PRETORULUI|Căutați\s+pe\s+Internet|"
    r"INTEGRITATE\s+[ȘŞ]I\s+ANTICORUP[TȚ]IE|ORGANELE\s+DE\s+DREPT|Func[tț]ii\s+vacante|"
    r"Declara[tț]ia\s+de\s+r[aă]spundere\s+managerial[aă]|"
    r"Transparen[tț]a\s+[iî]n\s+procesul\s+decizional|Lista\s+schemelor\s+de\s+amplasare|"
    r"Informa[tț]ia\s+privind\s+cheltuielile\s+efectuate)"
)
NUMBER_LINE = r"^\d{1,5}$"
# Fixed value: lines after which a page's own text has ended; early ones end it anywhere,
# the others only once 80 characters have gone by.
EARLY_END_LINES = [
    "POSTĂRI ASEMĂNATOARE", "Postări asemănătoare", "Related posts", "Comentarii", "Comments",
    "Tags:",
]
LATE_END_LINES = [
    "Alte știri care te interesează", "Alte stiri care te intereseaza", "Articole Recente",
    "Articole recente", "Vezi toate", "Distribuie:", "Share:", "Articolul următor",
    "Articolul anterior",
]
POLLUTED_CONTENT_LIKE = ["%DISPOZI%PRETORULUI%", "%Căutați pe Internet%", "%Cautati pe Internet%"]
POLLUTED_TITLE_LIKE = ["%cariera%"]

# Fixed value: pagination.
PAGING_ANCHOR = (
    r"(?:next|previous|prev|următor|urmator|înapoi|inapoi|înainte|inainte|mai\s+mult|"
    r"vezi\s+toate|toate\s+(?:anun|nout|știr|stir)|load\s*more|show\s*more|older|newer|"
    r"page\s*\d+|pagina\s*\d+|следующ|предыдущ|далее|назад|ещё|еще)"
)
PAGING_URL = r"([?&](page|paged|p)=\d+)|(/page/\d+)|(/pagina/\d+)"

# Fixed value: URLs inside style sheets and scripts.
ASSET_URLS = [
    r"""(?<![\w./-])(https?://[^\s"'<>\\)]+)""",
    r"""url\(\s*['"]?([^)'"\s]+)['"]?\s*\)""",
    r"""['"](/[a-zA-Z0-9][^'"]{2,240})['"]""",
    r"""(?:href|src|url|path|link|permalink|endpoint)\s*[:=]\s*['"]([^'"]+)['"]""",
]
USELESS_URL_PREFIXES = ["data:", "blob:", "javascript:", "mailto:", "tel:", "#"]
