"""Fixed values of the query and scoring rules, in their natural order.

Word lists and numbers here must equal those of the system whose results are matched.
"""

# Query types, tested in this order; the first with a contained pattern wins.
QUERY_TYPES = (
    ("list", ("какие есть", "какие бывают", "список", "перечисли", "перечень", "все варианты", "все способы",
              "все типы", "все виды", "какие каналы", "какие интеграции", "какие методы")),
    ("troubleshooting", ("ошибка", "не работает", "не могу", "проблема", "сбой", "не удаётся", "не удается",
                         "не получается", "почему не", "failed", "error", "issue", "баг", "bug", "не отображается",
                         "не приходит", "не отправляется", "зависает", "падает")),
    ("comparative", ("отличие", "отличается", "разница", "различие", "сравн", "лучше", "хуже", "vs", "versus", "или",
                     " чем ", "в отличие от", "по сравнению")),
    ("procedural", ("как настроить", "как создать", "как добавить", "как удалить", "как подключить", "как включить",
                    "как выключить", "как изменить", "пошагово", "пошаговая", "инструкция", "руководство", "настройка",
                    "конфигурация", "установка", "развёртывание", "развертывание", "интеграция с", "подключение")),
    ("factual", ("что такое", "что значит", "что означает", "определение", "где находится", "где расположен", "когда",
                 "сколько", "кто", "какой порт", "какой адрес", "какая версия")),
)
QUERY_PREFIXES = (("factual", ("что ", "где ", "когда ", "кто ", "сколько ")), ("procedural", ("как ",)))
DEFAULT_QUERY_TYPE = "exploratory"

# query_type, k, rerank_top_n, auto_merge, context_reserve, boost_multiplier.
STRATEGIES = (
    ("factual", 15, 3, False, 0.40, 1.0),
    ("procedural", 25, 6, True, 0.30, 1.2),
    ("comparative", 20, 5, False, 0.35, 1.0),
    ("troubleshooting", 30, 7, True, 0.30, 1.3),
    ("list", 10, 2, False, 0.25, 1.0),
    ("exploratory", 20, 5, True, 0.35, 1.0),
)

# Domain entities, and replacements in their order.
ENTITIES = ("арм агента", "арм супервайзера", "арм администратора", "api", "faq", "release notes", "чат-боты",
            "интеграция", "настройка", "конфигурация", "развертывание")
REPLACEMENTS = (("РН", "Release Notes"), ("рн", "Release Notes"), ("АРМ", "АРМ"), ("арм", "АРМ"), ("API", "API"),
                ("api", "API"), ("FAQ", "FAQ"), ("faq", "FAQ"))
CONJUNCTION, MOST_PARTS = " и ", 3

# Page boosts by words of the query, and group boosts (label, weight, synonyms).
PAGE_BOOSTS = (
    ("faq", 1.2, ("как", "что", "почему", "где", "когда", "зачем")),
    ("api", 1.1, ("api", "интеграция", "настройка", "конфигурация")),
    ("release_notes", 1.15, ("release notes", "обновление", "новая версия", "изменения")),
)
GROUP_BOOSTS = (
    ("арм администратора", 1.3, ("админ панель", "администратор")),
    ("арм агента", 1.25, ("оператор", "агент")),
    ("арм супервайзера", 1.25, ("супервайзер",)),
    ("api", 1.2, ("rest", "интеграция", "webhook")),
)

# Themes in order (theme_id, domain, section, platform, role), and routing words.
THEMES = (
    ("sdk_android", "sdk_docs", "sdk", "android", "integrator"),
    ("sdk_ios", "sdk_docs", "sdk", "ios", "integrator"),
    ("sdk_web", "sdk_docs", "sdk", "web", "integrator"),
    ("sdk_main", "sdk_docs", "sdk", "main", "integrator"),
    ("user_agent", "chatcenter_user_docs", "agent", None, "operator"),
    ("user_supervisor", "chatcenter_user_docs", "supervisor", None, "supervisor"),
    ("user_admin", "chatcenter_user_docs", "admin", None, "administrator"),
    ("user_api", "chatcenter_user_docs", "api", None, "integrator"),
    ("user_faq", "chatcenter_user_docs", "faq", None, "all"),
)
# Names of the themes, in the same order.
THEME_LABELS = (
    "SDK для Android", "SDK для iOS", "Web SDK", "SDK (общие материалы)", "АРМ агента", "АРМ супервайзера", "АРМ администратора",
    "API и интеграции", "FAQ / База знаний",
)
ROUTE_WORDS = {
    "android": ("android", "gradle", "apk", "kotlin", "java"),
    "ios": ("ios", "swift", "xcode", "cocoapods"),
    "web": ("javascript", "widget", "web", "iframe"),
    "admin": ("админ", "администратор", "тег", "теги", "тегирование", "label", "tag"),
    "agent": ("агент", "оператор"),
    "supervisor": ("супервайзер", "supervisor"),
    "api": ("api", "swagger", "rest", "webhook", "интеграция"),
}
DOMAIN_WORDS = {"sdk_docs": ("sdk",), "chatcenter_user_docs": ("арм", "рабочее место", "интерфейс")}
PLATFORM_SCORE, SECTION_SCORE, DOMAIN_SCORE, USER_SCORE, CLEAR_LEAD = 1.0, 0.7, 0.5, 0.5, 0.2
FILTER_TOP, FILTER_LEAD, FILTER_TOP_LLM = 0.85, 0.35, 0.9

# Boosts of a hit.
PAGE_TYPE_BOOST = {"overview": 1.15, "howto": 1.1, "faq": 1.05, "reference": 1.0, "changelog": 0.9}
SECTION_BOOST = {"sdk": 1.03, "agent": 1.0, "supervisor": 1.05, "admin": 1.03, "api": 1.02, "faq": 1.02}
PLATFORM_BOOST = {"android": 1.05, "ios": 1.05, "web": 1.03, "main": 1.0}
URL_BOOSTS = (
    (1.2, ("/start/", "/overview", "/introduction", "/what-is", "/about")),
    (1.1, ("/faq", "/guide", "/manual", "/help")),
    (1.05, ("/admin/", "/api/", "/sdk/", "/integration")),
    (0.85, ("/blog", "/release", "/version", "/changelog")),
)
TITLE_BOOSTS = (
    (1.15, ("что такое", "обзор", "введение", "начало работы", "возможности")),
    (1.1, ("настройка", "конфигурация", "установка")),
)
LENGTH_BOOST = (800, 5000, 1.1, 1.05)
STRUCTURE_BOOSTS = ((1.05, ("##", "###", "•", "1.", "2.", "3.")), (1.05, ("пример", "например", "как", "шаг")))
SOURCE_BOOST = {"docs-site": 1.05, "official-docs": 1.05, "main-docs": 1.05}
DEPTH_LIMIT, DEPTH_FACTOR = 5, 0.95
THEME_PRIMARY, THEME_SECONDARY = 1.08, 1.03
THEME_ADD_PRIMARY, THEME_ADD_OTHER = 0.08, 0.04

# Fusion, merging and context budgets.
RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 60, 0.5, 0.5
CONTEXT_TOKENS, RESERVE, FIRST_DOCS, FIRST_MOST, OTHER_MOST = 3000, 0.35, 2, 600, 400
MERGE_TOKENS = 1200
SPARSE_CAP = 1000
SOURCES_MOST, SOURCE_WORD = 5, 4

# Complexity words; documents for simple, complex and other queries.
SIMPLE_WORDS = ("что такое", "как называется", "где находится", "когда", "какие", "список", "перечисли", "перечень")
COMPLEX_WORDS = ("как настроить", "пошаговая инструкция", "подробно", "примеры")
DOC_COUNTS = (2, 7, 6)

# Heuristic answer scores.
STOP_WORDS = ("и", "в", "на", "с", "по", "для", "как", "что", "а", "но", "или")
EVASIVE = ("не могу помочь", "не знаю", "извините", "недостаточно информации")
EVASIVE_FAITH = ("не знаю", "не могу", "извините", "к сожалению")
DOMAIN_ANSWER = ("api", "метод", "настройка", "конфигурация", "использовать")
CALENDAR = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь",
            "декабрь", "понедельник", "вторник", "среда", "четверг", "пятница", "суббота", "воскресенье")

# Limiter windows (requests, seconds), breakers (failures, seconds).
LIMITS = ((10, 300), (3, 60))
BREAKERS = {"llm": (3, 30), "embedding": (5, 60), "search": (3, 30)}
EXPIRY_DAYS = 30
BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
# Fixed value: the title of a source that has none.
SOURCE_TITLE = "Источник"
