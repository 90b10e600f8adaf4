"""Domain settings.

A :class:`Profile` carries every knob the pipeline needs (time zone, duration
cap, region dimension, alias map, excluded regions, calendar origins).  The
default profile holds the published values of the original alert data set; the
driver-table binding (``spanwise.sources.binding``) builds its own profile from a
rule so that the same operators run on the synthetic ``events`` table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the published data set's conventions for the
# results to match.  Kept together, in their natural order, as plain text.
# ---------------------------------------------------------------------------

LOCAL_TZ = "Europe/Kyiv"

# Region dimension: canonical name, English name, centroid latitude, longitude.
REGIONS = [
    ("Вінницька", "Vinnytsia", 49.23, 28.47),
    ("Волинська", "Volyn", 51.22, 24.69),
    ("Дніпропетровська", "Dnipropetrovsk", 48.46, 35.05),
    ("Донецька", "Donetsk", 48.03, 37.80),
    ("Житомирська", "Zhytomyr", 50.26, 28.66),
    ("Закарпатська", "Zakarpattia", 48.62, 22.29),
    ("Запорізька", "Zaporizhzhia", 47.84, 35.19),
    ("Івано-Франківська", "Ivano-Frankivsk", 48.92, 24.71),
    ("Київська", "Kyiv Oblast", 50.51, 30.81),
    ("Кіровоградська", "Kirovohrad", 48.51, 32.27),
    ("Луганська", "Luhansk", 48.57, 39.33),
    ("Львівська", "Lviv", 49.83, 23.99),
    ("Миколаївська", "Mykolaiv", 47.06, 31.99),
    ("Одеська", "Odesa", 46.48, 30.73),
    ("Полтавська", "Poltava", 49.59, 34.55),
    ("Рівненська", "Rivne", 50.62, 26.25),
    ("Сумська", "Sumy", 51.13, 33.41),
    ("Тернопільська", "Ternopil", 49.55, 25.59),
    ("Харківська", "Kharkiv", 49.99, 36.23),
    ("Херсонська", "Kherson", 46.64, 32.62),
    ("Хмельницька", "Khmelnytskyi", 49.42, 26.98),
    ("Черкаська", "Cherkasy", 49.44, 32.06),
    ("Чернівецька", "Chernivtsi", 48.30, 25.93),
    ("Чернігівська", "Chernihiv", 51.50, 31.30),
    ("м. Київ", "Kyiv (city)", 50.45, 30.52),
]

# Variant spelling -> canonical region name.
ALIASES = {
    "Вінницька область": "Вінницька",
    "Волинська область": "Волинська",
    "Дніпропетровська область": "Дніпропетровська",
    "Донецька область": "Донецька",
    "Житомирська область": "Житомирська",
    "Закарпатська область": "Закарпатська",
    "Запорізька область": "Запорізька",
    "Івано-Франківська область": "Івано-Франківська",
    "Київська область": "Київська",
    "Кіровоградська область": "Кіровоградська",
    "Луганська область": "Луганська",
    "Львівська область": "Львівська",
    "Миколаївська область": "Миколаївська",
    "Одеська область": "Одеська",
    "Полтавська область": "Полтавська",
    "Рівненська область": "Рівненська",
    "Сумська область": "Сумська",
    "Тернопільська область": "Тернопільська",
    "Харківська область": "Харківська",
    "Херсонська область": "Херсонська",
    "Хмельницька область": "Хмельницька",
    "Черкаська область": "Черкаська",
    "Чернівецька область": "Чернівецька",
    "Чернігівська область": "Чернігівська",
    "Київ": "м. Київ",
    "місто Київ": "м. Київ",
}

# Regions under near-permanent alert, removed before the interval union.
EXCLUDED_REGIONS = ["Луганська", "АР Крим", "Крим"]

# English-name overrides used when joining an external feature collection.
FEATURE_NAME_OVERRIDES = {"Kiev": "Київська", "Kiev City": "м. Київ"}

MAX_RAW_HOURS = 12  # a single raw record longer than this is capped before merging
COVER_START = "2022-02-24"  # origin of the day counter (local midnight)
OFFICIAL_START = "2022-03-15"  # first day of official coverage
MIN_EXPECTED_ROWS = 10_000  # quality floor on the episode count
RAW_NULL_TOKENS = ["", "None", "NaN", "null", "NA", "N/A", "n/a", "nan", "NULL", "<NA>", "#N/A", "#NA", "#N/A N/A",
                   "-nan", "-NaN", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN"]
NIGHT_START_HOUR = 20
NIGHT_END_HOUR = 6
DOW_SHORT = ["Пн", "Вт", "Ср", "Чт", "Пт", "Сб", "Нд"]  # Monday first
DOW_LONG = ["Понеділок", "Вівторок", "Середа", "Четвер", "П'ятниця", "Субота", "Неділя"]
LEVELS_BASE = ["oblast", "raion"]
LEVEL_FINE = "hromada"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Everything that differs between data sets."""

    tz: str = LOCAL_TZ
    cap_hours: float = MAX_RAW_HOURS
    regions: tuple = tuple(REGIONS)
    aliases: dict = field(default_factory=lambda: dict(ALIASES))
    excluded: tuple = tuple(EXCLUDED_REGIONS)
    cover_start: str = COVER_START
    official_start: str = OFFICIAL_START
    min_rows: int = MIN_EXPECTED_ROWS

    @property
    def cap_seconds(self) -> int:
        return int(round(self.cap_hours * 3600))

    @property
    def region_names(self) -> list[str]:
        return [r[0] for r in self.regions]


DEFAULT = Profile()
