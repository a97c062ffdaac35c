"""Fixed values of team texts: the words, markers and line forms that decide what is a person, a role or a header.

All of them are defaults of parameters.
"""

# How a person's name is written, words that start none, and words that are no part of one.
NAME_FORM = r"^[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+){1,2}$"
PREPOSITIONS = ("из", "для", "по", "на", "в", "с", "от", "к", "у", "о", "об")
NO_NAME = (
    "telegram", "qdrant", "bertopic", "neo4j", "api", "cloud", "google", "colab", "посты", "пост", "из", "схема", "данные", "векторная", "бд", "пользовательский", "запрос", "новости", "темы", "граф",
    "сущности", "обработка", "пайплайн", "семантический", "поиск", "индексация", "кластеризация", "классификация", "дайджест", "дашборд", "backend", "frontend", "docker", "python", "redis", "postgres",
    "streamlit", "openai", "react", "slide", "канал", "каналы", "сообщение", "сообщения", "корпус", "чанк", "чанки", "эмбеддинг", "модель", "модели", "pipeline", "архитектура", "система", "платформа",
    "интерфейс", "прототип",
)
# What stands near a team, and what names a role.
CONTEXT_HINTS = ("команда проекта", "команда управления", "участники команды", "роли в проекте", "участник", "тимлид", "разработчик", "исполнитель", "помощник тимлида")
ROLE_MARKERS = (
    "тимлид", "помощник тимлида", "разработчик", "аналитик", "дизайнер", "frontend", "backend", "ml engineer", "data scientist", "qa", "project manager", "руководитель", "архитектор", "engineer", "devops",
    "лид", "тестирован", "стажер", "стажёр",
)
# The line under a header that is a role.
ROLE_HINTS = (
    "тимлид", "помощник", "project manager", "lead", "backend", "frontend", "devops", "qa", "архитектор", "разработчик", "лид", "руководитель", "engineer", "manager", "проект", "аналитик", "тестирован",
    "парсинг", "pipeline",
)
# Headers without names, lines that end a team section, and lists that are no group of persons.
PLAIN_HEADERS = ("команда проекта", "тимлид проекта", "участники команды проекта", "участники", "команда", "тимлид", "роли", "разработчики")
SECTION_ENDS = ("фраза проекта", "используемый технологический стек")
NO_GROUP = ("посты telegram", "из telegram", "qdrant cloud", "google colab", "qdrant", "bertopic", "neo4j", "схема обработки данных", "векторная бд")
GROUP_PREFIX = r"^(?:команда\s+данных|тимлиды?|участники|разработчики)\s*:\s*"
# Marks of team slides, of texts with a team, and of teams that are another's.
SLIDE_MARKS = ("команда проекта", "участники команды", "команда управления", "роли в проекте", "состав команды")
TEXT_MARKS = ("команда проекта", "участники команды", "команда управления", "роли в проекте", "тимлид:", "тимлид ", "помощник тимлида", "участники:", "разработчик:", "разработчики")
FALSE_MARKS = ("команды заказчика", "команда заказчика", "команда проекта достигла")
# Lines and sentences that name a person with a role.
LEAD, ASSISTANT = r"Тимлид\s*:\s*(.+?)(?:\n|$)", r"Помощник\s+тимлида\s*:\s*(.+?)(?:\n|$)"
LEAD_ROLE, ASSISTANT_ROLE = "Тимлид", "Помощник тимлида"
ROLE_LINE = r"^(Тимлид|Помощник\s+тимлида|Участник|Разработчик|Аналитик)\s*:\s*(.+)$"
SKIPPED_STARTS = ("команда проекта", "участники команды", "тимлид проекта")
# Marks of a team in noisy text, lines of it that are no persons, and words that were glued together or misread.
NOISY_MARKS = ("команда проекта", "тимлид проекта", "участники команды проекта", "участники команды", "помощник тимлида", "участники", "разработчики", "команда", "тимлид")
NOISY_NO_PERSON = ("qdrant", "telegram", "neo4j", "bertopic", "google colab", "streamlit", "backend", "frontend", "docker", "python", "redis", "postgres")
NOISE = r"[|`©®™•●▪◦·]+"
QUOTES = "[«»\"\"„‟'']"
GLUED = (
    (r"Тимлидпроекта", "Тимлид проекта"),
    (r"тимлидпроекта", "тимлид проекта"),
    (r"Тимлид\s*проекта\.", "Тимлид проекта"),
    (r"помошниктиылида", "помощник тимлида"),
    (r"помощниктилида", "помощник тимлида"),
    (r"помошник\s*тимлида", "помощник тимлида"),
    (r"помощник\s*тилида", "помощник тимлида"),
    (r"Участникикоманды", "Участники команды"),
    (r"участникикоманды", "участники команды"),
    (r"Командпроекта", "Команда проекта"),
    (r"командпроекта", "команда проекта"),
    (r"Командапроекта", "Команда проекта"),
    (r"командапроекта", "команда проекта"),
    (r"(Участники)\s*(команды)\s*(проекта)", "$1 $2 $3"),
)
# Roles and how they are written.
ROLES = {
    "тимлид": "тимлид",
    "тимлид проекта": "тимлид проекта",
    "помощник тимлида": "помощник тимлида",
    "помошник тимлида": "помощник тимлида",
    "разработчик": "разработчик",
    "архитектор": "архитектор",
    "аналитик": "аналитик",
    "аналитика": "аналитика",
    "разработка": "разработка",
    "парсинг": "парсинг",
    "данные": "данные",
}
