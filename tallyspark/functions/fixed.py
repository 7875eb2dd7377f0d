"""Word lists, tables and constants that results depend on. Plain data."""

from __future__ import annotations

# fixed values: marks that count as an apostrophe
APOSTROPHES = "’‘ʼ`´'"

# fixed values: words that do not count when names are compared
STOP_WORDS = [
    "з", "із", "зі", "та", "і", "й", "в", "у", "на", "до", "для", "при", "або", "по", "з'", "як", "що", "а", "не", "від", "під", "над", "о",
    "тощо", "т", "п", "тип", "типу", "шт", "мм", "см", "м", "кг",
]

# fixed values: Latin letters and the Cyrillic ones that look the same
LATIN, CYRILLIC = "iaeopcxy", "іаеорсху"

# fixed values: endings, in the order in which they are tried
ENDINGS = [
    "ювання", "ування", "ання", "ення", "ості", "ими", "ого", "ому", "их", "ах", "ям", "ями", "ів", "ей", "ою", "ій", "ий", "ая", "ої",
    "ом", "ем", "у", "ю", "а", "я", "и", "і", "е", "о",
]
LEAST_STEM = 4

# fixed values: units and the forms that mean them
UNIT_FORMS = {
    "м2": ["м2", "м²", "кв.м", "кв м", "м.кв", "м кв", "m2", "мкв", "квм", "кв"],
    "м3": ["м3", "м³", "куб.м", "куб м", "м.куб", "m3", "мкуб", "кубм", "куб"],
    "м": ["м", "мп", "м.п", "пог.м", "п.м", "м п", "погм", "пм", "пог м", "погонний метр"],
    "шт": ["шт", "штук", "штуки", "од", "одиниць"],
    "т": ["т", "тонн", "тонна"],
    "кг": ["кг"],
    "компл": ["к-т", "кт", "комплект", "компл", "комплектів", "к т"],
    "блок": ["блок", "блоків"],
    "грати": ["грати", "решітка"],
    "агрегат": ["агрегат", "агрегатів"],
    "кВт": ["квт", "kw"],
    "кінців": ["кінців", "кінець"],
    "лінія": ["лінія", "ліній"],
    "вимір": ["вимір", "вимірюв", "вимірювання"],
    "випроб": ["випроб", "випробування"],
    "точ": ["точ", "точка", "точок"],
    "струм-ч": ["струм-ч", "струм ч"],
    "фазув-ня": ["фазув-ня", "фазування", "фазув ня"],
    "маш-год": ["маш-год"],
    "люд-год": ["люд-год", "чол-год"],
    "місце": ["місце"],
    "об'єкт": ["об'єкт"],
    "система": ["система"],
    "%": ["%"],
}
UNIT_OF = {form: unit for unit, forms in UNIT_FORMS.items() for form in forms}

# fixed values: units that a bill of quantities may name
BILL_UNITS = [
    "шт", "м", "м2", "м3", "т", "кг", "к-т", "компл", "комплект", "блок", "грати", "агрегат", "квт", "кВт", "кінців", "лінія", "вимір.", "вимір",
    "випроб.", "випроб", "точ.", "точ", "струм-ч", "фазув-ня", "вимірюв.", "вимірюв", "м.п", "мп", "%", "маш-год", "люд-год", "місце", "система",
    "пара", "секція", "прилад", "апарат", "пристрій", "вузол", "проба", "фазув-ня.", "од", "штук", "пог.м", "кв.м", "куб.м", "канал", "стояк",
]

# fixed values: units that a price list may name
LIST_UNITS = [
    "м2", "м²", "кв.м", "кв. м", "м.кв", "м3", "м³", "куб.м", "м", "м.п", "мп", "пог.м", "пог. м", "шт", "шт.", "штука", "точка", "точок",
    "компл", "к-т", "комплект", "т", "кг", "л", "год", "година", "день", "місце", "секція", "панель", "лист", "рулон", "блок", "отвір", "стик",
    "вікно", "двері",
]

# fixed values: marks of works that take down, and of works that build
DEMOLITION = ["демонтаж", "розбиран", "зніман", "знят", "видален", "прибиран", "зрубуван", "збиван", "пробиван", "штроблен", "свердлен"]
INSTALL = [
    "улаштуван", "влаштуван", "установлен", "установк", "монтаж", "укладан", "укладк", "мурував", "мурован", "заповнен", "обклеюван", "поклейк",
    "фарбуван", "штукатурен", "шпаклюван", "шпаклівк", "опорядж", "утеплен", "ізоляц", "прокладан", "прокладк", "армуван", "накритт", "ґрунтуван",
    "грунтуван", "затирк", "обшивк", "заміна", "замін", "встановлен",
]

# fixed values: signs that a price is for work, or for material
LABOR_SIGNS = ["робот", "монтаж", "послуг", "укладанн", "влаштуванн", "улаштуванн", "демонтаж", "ціна за роботу", "вартість робіт", "майстер", "бригад"]
MATERIAL_SIGNS = ["матеріал", "купити", "доставка", "в наявності", "товар", "склад"]

# fixed values: factors of regions, in order, and of cities
REGIONS = {
    "Київ": 1.35, "Київська область": 1.18, "Львівська область": 1.14, "Одеська область": 1.12, "Дніпропетровська область": 1.10,
    "Харківська область": 1.04, "Івано-Франківська область": 1.08, "Закарпатська область": 1.09, "Волинська область": 1.02,
    "Рівненська область": 1.02, "Тернопільська область": 0.99, "Хмельницька область": 1.0, "Чернівецька область": 1.01,
    "Вінницька область": 1.02, "Житомирська область": 1.0, "Черкаська область": 1.0, "Кіровоградська область": 0.97,
    "Полтавська область": 1.0, "Сумська область": 0.96, "Чернігівська область": 0.96, "Миколаївська область": 1.03,
    "Херсонська область": 1.0, "Запорізька область": 1.02, "Донецька область": 1.05, "Луганська область": 1.05,
}
CITIES = {
    "Київ": 1.35, "Львів": 1.22, "Одеса": 1.18, "Дніпро": 1.15, "Харків": 1.08, "Полтава": 1.05, "Кременчук": 1.02, "Миргород": 0.98,
    "Лохвиця": 0.95, "Семенівка": 0.94, "Гадяч": 0.96, "Лубни": 0.98, "Вінниця": 1.05, "Житомир": 1.02, "Черкаси": 1.03, "Чернігів": 0.99,
    "Суми": 0.98, "Рівне": 1.04, "Луцьк": 1.03, "Тернопіль": 1.01, "Хмельницький": 1.02, "Ужгород": 1.11, "Івано-Франківськ": 1.1,
    "Чернівці": 1.03, "Кропивницький": 0.99, "Миколаїв": 1.05, "Херсон": 1.0, "Запоріжжя": 1.04, "Ковель": 0.98, "Біла Церква": 1.06,
    "Бровари": 1.12, "Ірпінь": 1.14,
}
BASE_REGION = "базовий регіон"

# fixed values: order of price sources by strategy, and labels of sources
STRATEGIES = {
    "site_first": ["history", "site", "catalog", "web"],
    "web_fallback": ["history", "site", "catalog", "web"],
    "history_first": ["history", "site", "web", "catalog"],
    "web_first": ["web", "history", "site", "catalog"],
    "catalog_only": ["catalog"],
}
DEFAULT_STRATEGY = "history_first"
SOURCE_LABELS = {
    "history": "історія (старі кошториси)", "site": "прайс сайту", "web": "інтернет", "catalog": "довідник", "manual": "ручне введення",
    "none": "не знайдено",
}

# fixed values: percentages and other settings where an object has none
SETTINGS = {"overhead_pct": 15, "profit_pct": 8, "admin_pct": 2, "risk_pct": 0, "vat_pct": 20}
HISTORY_WINDOW, CACHE_DAYS, QUERY_LIMIT, SITE_DAYS = 8, 14, 40, 30

# fixed values: limits of the matcher
MIN_SCORE, SEARCH_SCORE, CATEGORY_SCORE, CONFIDENT = 62.0, 55.0, 63.0, 80.0
UNIT_BONUS, UNIT_PENALTY, ACTION_PENALTY = 6.0, 14.0, 45.0
COVERAGE_SHARE, SIMILARITY_SHARE = 78.0, 22.0
