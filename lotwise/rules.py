"""Fixed values of the listing rules: word lists, lookup tables, constants.

Everything here is plain data.  The order inside a list matters wherever a
rule says "first hit wins", so the lists are kept as tuples.
"""

# --- fixed values: field vocabularies (source word -> stored word) ---------
FUEL_WORDS = (
    ("дизел", "diesel"), ("diesel", "diesel"), ("бензин", "petrol"), ("petrol", "petrol"),
    ("gasoline", "petrol"), ("газ", "lpg"), ("lpg", "lpg"), ("cng", "cng"),
    ("електро", "electric"), ("electric", "electric"), ("хибрид", "hybrid"), ("hybrid", "hybrid"),
)
GEARBOX_WORDS = (
    ("автоматична", "automatic"), ("automatic", "automatic"), ("auto", "automatic"),
    ("ръчна", "manual"), ("manual", "manual"),
    ("полуавтоматична", "semi-automatic"), ("semi-automatic", "semi-automatic"),
)
BODY_WORDS = (
    ("седан", "sedan"), ("sedan", "sedan"), ("хечбек", "hatchback"), ("hatchback", "hatchback"),
    ("комби", "wagon"), ("wagon", "wagon"), ("estate", "wagon"), ("джип", "suv"), ("suv", "suv"),
    ("кабрио", "convertible"), ("convertible", "convertible"), ("купе", "coupe"), ("coupe", "coupe"),
    ("ван", "van"), ("van", "van"), ("пикап", "pickup"), ("pickup", "pickup"),
)

# --- fixed values: currency rates to BGN -----------------------------------
FX_TO_BGN = (("BGN", 1.0), ("EUR", 1.96), ("USD", 1.80))

# --- fixed values: brand/model dictionary ----------------------------------
# (brand, model, stored brand, stored model, aliases)
BRAND_MODELS = (
    ("BMW", "X5", "bmw", "x5", ("x 5", "х5")),
    ("BMW", "320", "bmw", "320", ("3 series", "3-series")),
    ("BMW", "520", "bmw", "520", ("5 series", "5-series")),
    ("Mercedes", "C-Class", "mercedes-benz", "c-class", ("c class", "c-klasse")),
    ("Mercedes", "E-Class", "mercedes-benz", "e-class", ("e class", "e-klasse")),
    ("Mercedes", "S-Class", "mercedes-benz", "s-class", ("s class", "s-klasse")),
    ("Audi", "A4", "audi", "a4", ("а4",)),
    ("Audi", "A6", "audi", "a6", ("а6",)),
    ("Audi", "Q5", "audi", "q5", ("q 5",)),
    ("VW", "Golf", "volkswagen", "golf", ("голф",)),
    ("VW", "Passat", "volkswagen", "passat", ("пасат",)),
    ("VW", "Tiguan", "volkswagen", "tiguan", ("тигуан",)),
    ("Ford", "Focus", "ford", "focus", ("фокус",)),
    ("Ford", "Fiesta", "ford", "fiesta", ("фиеста",)),
    ("Toyota", "Corolla", "toyota", "corolla", ("корола",)),
    ("Toyota", "Yaris", "toyota", "yaris", ("ярис",)),
    ("Toyota", "RAV4", "toyota", "rav4", ("rav 4",)),
)

# --- fixed values: sources and plans ----------------------------------------
SOURCES = (  # name, base url, enabled, crawl interval in seconds
    ("mobile_bg", "https://www.mobile.bg", True, 120),
    ("cars_bg", "https://www.cars.bg", True, 180),
    ("olx_bg", "https://www.olx.bg", False, 300),
)
SOURCE_ALIASES = (  # spelling -> source name
    ("Mobile.bg", "mobile_bg"), ("mobile_bg", "mobile_bg"),
    ("Cars.bg", "cars_bg"), ("cars_bg", "cars_bg"),
    ("OLX.bg", "olx_bg"), ("olx_bg", "olx_bg"),
)
PLANS = (  # name, max_alerts, delay_minutes, daily_alert_cap, price_bgn
    ("Free", 3, 30, 10, 0.0),
    ("Premium", 10, 0, 50, 19.99),
    ("Pro", 999, 0, 999, 39.99),
)
DEFAULT_DAILY_CAP = 999

# --- fixed values: risk keywords (category, keyword) ------------------------
RISK_RED = (
    ("accident", ("катастрофирал", "катастрофа", "удар", "ударен", "повреди от катастрофа",
                  "accident", "crashed", "collision")),
    ("salvage", ("тотал", "дерегистриран", "бракуван", "на части",
                 "salvage", "totaled", "write-off", "for parts")),
    ("import", ("нов внос", "пресен внос", "американски внос", "от америка",
                "fresh import", "imported from")),
    ("mileage_doubt", ("реални километри", "неманипулиран километраж", "верен километраж",
                       "real mileage", "original mileage")),
    ("urgent", ("спешно", "бърза продажба", "зле ми са парите", "заминавам",
                "urgent", "quick sale", "need money")),
    ("cosmetic", ("драскотини", "вдлъбнатини", "нуждае се от бояджийски",
                  "scratches", "dents", "needs bodywork")),
)
RISK_POSITIVE = (
    ("maintenance", ("сервизна история", "редовно обслужвана", "на гаранция",
                     "service history", "well maintained", "under warranty")),
    ("ownership", ("първи собственик", "един собственик", "личен автомобил",
                   "first owner", "one owner", "personal use")),
    ("condition", ("перфектно състояние", "отлично състояние", "много запазена",
                   "perfect condition", "excellent condition", "well preserved")),
)

# --- fixed values: red-flag phrases and messages -----------------------------
FLAG_LEASING = ("лизинг", "лиз.", "leasing", "месечна вноска", "първоначална вноска",
                "авансово", "на вноски", "кредит", "финансиране")
FLAG_RIGHT_HAND = ("десен волан", "дясна кормилница", "right hand", "rhd", "английски",
                   "от англия", "japanese", "от япония")
FLAG_ABROAD = ("внос", "увоз", "германия", "deutschland", "франция", "италия", "холандия",
               "нидерландия", "czech", "чехия", "от чужбина", "на път", "идва", "очаква се")
FLAG_DAMAGE = ("катастрофирал", "удряна", "ударен", "счупен", "повредена", "за части",
               "за ремонт", "без документи", "без регистрация")
FLAG_URGENCY = ("спешно", "бърза продажба", "навлизам", "напускам държавата",
                "не отговарям на смс", "само обаждане", "последна цена")
FLAG_PREMIUM_WORDS = ("bmw", "mercedes", "audi", "lexus")
FLAG_TEXT = {
    "leasing": ("🚨 LEASING: Detected '", "' - not full price"),
    "right_hand": ("⚠️ RIGHT-HAND DRIVE: Detected '", "' - harder to sell"),
    "abroad": ("⚠️ NOT IN BULGARIA: Detected '", "' - hidden costs"),
    "damage": ("🚫 DAMAGE: Detected '", "' - avoid"),
    "too_cheap": "🚨 SUSPICIOUS: New premium car too cheap - possible leasing",
    "urgency": "⚠️ SUSPICIOUS: Multiple urgency phrases - possible scam",
}

# --- fixed values: premium brands and price expectations ---------------------
PREMIUM_BRANDS = ("mercedes-benz", "bmw", "audi", "lexus", "porsche")
# (highest age, premium low, premium high, other low, other high); None = any age
EXPECTED_PRICE = (
    (3, 25000, 50000, 18000, 35000),
    (5, 18000, 35000, 12000, 25000),
    (8, 12000, 25000, 8000, 18000),
    (None, 6000, 15000, 5000, 12000),
)
# (bracket, highest price, excellent, good, fair, mileage weight)
PRICE_BRACKETS = (
    ("budget", 10000, 20, 15, 10, 2.5),
    ("sweet_spot", 30000, 25, 20, 15, 2.0),
    ("premium", 60000, 15, 12, 8, 1.5),
    ("luxury", 150000, 10, 8, 5, 1.0),
)
BRACKET_FLOOR = 5000
OTHER_BRACKET = (15, 10, 5, 1.0)

# --- fixed values: alert vocabulary ------------------------------------------
ALERT_FUEL = (
    ("diesel", "diesel"), ("дизел", "diesel"), ("petrol", "petrol"), ("benzin", "petrol"),
    ("бензин", "petrol"), ("gasoline", "petrol"), ("hybrid", "hybrid"), ("хибрид", "hybrid"),
    ("electric", "electric"), ("електрически", "electric"), ("lpg", "lpg"), ("газ", "lpg"),
)
ALERT_GEARBOX = (
    ("automatic", "automatic"), ("автоматична", "automatic"), ("auto", "automatic"),
    ("manual", "manual"), ("ръчна", "manual"),
)
ALERT_BODY = (
    ("sedan", "sedan"), ("седан", "sedan"), ("hatchback", "hatchback"), ("хечбек", "hatchback"),
    ("suv", "suv"), ("джип", "suv"), ("wagon", "wagon"), ("комби", "wagon"), ("coupe", "coupe"),
    ("купе", "coupe"), ("convertible", "convertible"), ("кабрио", "convertible"), ("van", "van"),
    ("ван", "van"), ("pickup", "pickup"),
)
ALERT_CITIES = ("sofia", "софия", "plovdiv", "пловдив", "varna", "варна", "burgas", "бургас",
                "ruse", "русе", "stara zagora")

# --- fixed values: page vocabulary -------------------------------------------
PAGE_KEYS = {"brand": "Марка", "model": "Модел", "year": "Година", "first_reg": "Първа регистрация",
             "mileage": "Пробег", "fuel": "Гориво", "gearbox": "Скоростна кутия",
             "body": "Категория", "color": "Цвят", "region": "Населено място",
             "engine": "Двигател", "power": "Мощност"}
PAGE_FUEL = (("Дизел", "diesel"), ("Бензин", "petrol"), ("Газ", "gas"), ("ГАЗ", "gas"),
             ("Електро", "electric"), ("Хибрид", "hybrid"))
PAGE_GEARBOX = (("Автоматична", "automatic"), ("Ръчна", "manual"))
PAGE2_FUEL = (("Дизел", "Diesel"), ("Бензин", "Petrol"), ("Газ", "LPG/CNG"), ("ГАЗ", "LPG/CNG"),
              ("Електро", "Electric"), ("Хибрид", "Hybrid"))
PAGE2_GEARBOX = (("Автоматични", "Automatic"), ("Ръчни", "Manual"))
PAGE2_BODY = (("Хечбек", "Hatchback"), ("Седан", "Sedan"), ("Комби", "Estate"), ("Стейшън", "Estate"),
              ("Купе", "Coupe"), ("Джип", "SUV"), ("SUV", "SUV"), ("Ван", "Van"),
              ("Миниван", "Van"), ("Кабрио", "Convertible"))
PAGE2_FUEL_UPPER = (("ДИЗЕЛ", "Diesel"), ("DIESEL", "Diesel"), ("БЕНЗИН", "Petrol"),
                    ("PETROL", "Petrol"), ("GASOLINE", "Petrol"), ("ГАЗ", "LPG/CNG"),
                    ("LPG", "LPG/CNG"), ("CNG", "LPG/CNG"), ("ЕЛЕКТРО", "Electric"),
                    ("ELECTRIC", "Electric"), ("ХИБРИД", "Hybrid"), ("HYBRID", "Hybrid"))
MONTHS = ("Януари", "Февруари", "Март", "Април", "Май", "Юни", "Юли", "Август",
          "Септември", "Октомври", "Ноември", "Декември")
PAGE2_CITIES = ("София", "Пловдив", "Варна", "Бургас", "Русе", "Стара Загора", "Плевен", "Благоевград")
TITLE_BRANDS = (
    "Mercedes-Benz", "Mercedes", "Alfa Romeo", "Land Rover", "Range Rover", "Rolls-Royce",
    "Audi", "BMW", "VW", "Volkswagen", "Opel", "Ford", "Toyota", "Renault", "Peugeot", "Citroën",
    "Citroen", "Mazda", "Nissan", "Honda", "Hyundai", "Kia", "Škoda", "Skoda", "Seat", "Fiat",
    "Dacia", "Suzuki", "Mitsubishi", "Subaru", "Volvo", "Lexus", "Infiniti", "Porsche", "Jaguar",
    "Mini", "Smart", "Jeep", "Chevrolet", "Dodge", "Chrysler", "Cadillac", "Tesla", "Bentley",
)
DELETED_MARKERS = ("изтрита или не е активна", "deleted")
URL_EXCLUDED = ("users", "login", "register", "check-phone", "javascript:", "#", "/p-", "mailto:")
GENERIC_SLUGS = ("namira-se-v-balgariya", "page", "p-2", "p-3")

# --- fixed values: model-string vocabulary -----------------------------------
ENGINE_MARKERS = (("CDI", "diesel"), ("TDI", "diesel"), ("HDI", "diesel"), ("CDTI", "diesel"),
                  ("JTD", "diesel"), ("dCi", "diesel"), ("D", "diesel"), ("d", "diesel"),
                  ("i", "petrol"), ("TSI", "petrol"), ("TFSI", "petrol"), ("GTI", "petrol"))
ENGINE_STOP = ("CDI", "TDI", "HDI", "CDTI", "TSI", "TFSI", "GTI")
TRIM_STOP = ("USB", "NAVI", "GPS", "BT", "AUX", "MP3", "DVD")
TRIM_WORDS = ("xDrive", "Quattro", "4Motion", "AWD", "4WD", "Sport", "M Sport", "S Line", "AMG",
              "Elegance", "Avantgarde", "Executive", "USB", "NAVI", "GPS", "BT", "AUX")

# --- fixed values: real-time and legacy score vocabulary ---------------------
AUTOMATIC_WORDS = ("автоматична", "automatic")
ECO_WORDS = ("хибрид", "електричество", "hybrid", "electric")

# --- fixed values: default watch targets -------------------------------------
WATCH_TARGETS = (
    {"name": "All New Cars", "price_max": 100000, "year_min": 2015, "mileage_max": 150000},
    {"name": "Mercedes A-Class New", "price_max": 50000, "year_min": 2018, "mileage_max": 100000},
    {"name": "BMW 3 Series New", "price_max": 60000, "year_min": 2018, "mileage_max": 120000},
)

# --- fixed values: priority brands of the search work list --------------------
PRIORITY_BRANDS = ("Mercedes-Benz", "BMW", "Audi", "Volkswagen", "Toyota", "Ford", "Opel", "Skoda",
                   "Renault", "Hyundai", "Nissan", "Honda", "Peugeot", "Chevrolet", "Kia", "Mazda",
                   "Citroen", "Fiat", "Volvo", "Mitsubishi")
