"""The five-sentence sample of the Russian profile, with the lexicon that it needs and the hits that it has."""

from dataclasses import replace

from glossa.plans.analysis import CURATED, EXCLUSIONS, PARTS, PHRASES, THEMES, Analysis, Sources
from glossa.plans.profile import RUSSIAN

SENTENCES = (
    "Григорий подумал и долго думал о случившемся.",
    "Подумаешь, дерьмо какое — сказал он и махнул рукой.",
    "Наутро Григорий вспомнил разговор и восстановил в памяти детали; ему стало ясно, что это интрига.",
    "— Пораскинь мозгами и пойми, — сказал Ермаков.",
    "Гришка мысленно проговорил: «Ребячья игра».",
)
TEXT = "Книга первая\n" + "\n".join(SENTENCES[:4]) + "\nКнига вторая\n" + SENTENCES[4] + "\n"
SHA256 = "9acbe2e3d93130b3f751654dd77f35cf694986b57be786d9e998ae8b807ab723"
LEMMAS = {
    "подумал": "подумать", "думал": "думать", "подумаешь": "подумать", "вспомнил": "вспомнить", "восстановил": "восстановить", "памяти": "память", "стало": "стать", "пораскинь": "пораскинуть", "мозгами": "мозг",
    "пойми": "понять", "проговорил": "проговорить", "сказал": "сказать",
}
WORDS = (
    ("S1_001", "процесс размышления", "думать"), ("S1_002", "инициация мысли", "подумать"), ("S1_012", "мысленный акт/реплика", "мысленно"), ("S1_014", "память/воспоминание", "вспомнить"), ("S1_017", "понимание/ясность", "понять"),
    ("S1_020", "понимание/ясность", "ясно"), ("S1_023", "оценка/рассуждение", "пораскинуть"),
)
PATTERNS = (
    ("PHR_016", "долго думать", "CORE"), ("PHR_035", "мысленно проговорить", "EXTENDED"), ("PHR_047", "восстановить в память", "CORE"), ("PHR_048", "вспомнить разговор", "CORE"), ("PHR_061", "стать ясно", "CORE"),
    ("PHR_106", "пораскинуть мозг", "EXTENDED"), ("PHR_135", "думать о случившемся", "CORE"), ("PHR_351", "ему стать ясно", "CORE"),
)
#: hit_id, type, marker, sentence, first and last token, noise, inside phrase, counted, link, perspective, confidence
HITS = (
    (1, "PHRASE", "PHR_135", 0, 4, 6, False, "", True, "YES", "NARRATOR_ABOUT_HERO", "HIGH"), (2, "WORD", "S1_002", 0, 1, 1, False, "", True, "YES", "NARRATOR_ABOUT_HERO", "HIGH"),
    (3, "WORD", "S1_001", 0, 4, 4, False, "PHR_135", False, "YES", "NARRATOR_ABOUT_HERO", "HIGH"), (4, "WORD", "S1_002", 1, 0, 0, True, "", True, "PROBABLE", "NARRATOR_ABOUT_HERO", "MEDIUM"),
    (5, "PHRASE", "PHR_048", 2, 2, 3, False, "", True, "YES", "NARRATOR_ABOUT_HERO", "HIGH"), (6, "PHRASE", "PHR_047", 2, 5, 7, False, "", True, "YES", "NARRATOR_ABOUT_HERO", "HIGH"),
    (7, "PHRASE", "PHR_351", 2, 9, 11, False, "", True, "YES", "NARRATOR_ABOUT_HERO", "HIGH"), (8, "WORD", "S1_014", 2, 2, 2, False, "PHR_048", False, "YES", "NARRATOR_ABOUT_HERO", "HIGH"),
    (9, "WORD", "S1_020", 2, 11, 11, False, "PHR_351", False, "YES", "NARRATOR_ABOUT_HERO", "HIGH"), (10, "PHRASE", "PHR_106", 3, 0, 1, False, "", True, "PROBABLE", "OTHERS_TO_HERO", "LOW"),
    (11, "WORD", "S1_023", 3, 0, 0, False, "PHR_106", False, "PROBABLE", "OTHERS_TO_HERO", "LOW"), (12, "WORD", "S1_017", 3, 3, 3, False, "", True, "PROBABLE", "OTHERS_TO_HERO", "LOW"),
    (13, "PHRASE", "PHR_035", 4, 1, 2, False, "", True, "YES", "HERO_INNER_SPEECH", "HIGH"), (14, "WORD", "S1_012", 4, 1, 1, False, "PHR_035", False, "YES", "HERO_INNER_SPEECH", "HIGH"),
)
NESTED = (("PHR_016", 0, 3, 4, "PHR_135", 1), ("PHR_061", 2, 10, 11, "PHR_351", 2))


def sample(spark, docs=None, profile=None, exclusions=(("E1", "думать", "", r"^\s*Подумаешь[,!?.—\s]", "context", "1"),)) -> Analysis:
    docs = spark.createDataFrame([(0, TEXT)], "doc_id long, text string") if docs is None else docs
    curated = [(i, theme, unit, "WORD", "") for i, theme, unit in WORDS]
    phrases = [(i, pattern, pattern, "theme", "FAMILY", level, "manual", "1", "", "") for i, pattern, level in PATTERNS]
    sources = Sources(
        docs, spark.createDataFrame(curated, CURATED), spark.createDataFrame([(0, "думать")], "ord int, value string"), spark.createDataFrame(phrases, PHRASES), spark.createDataFrame([("память / воспоминание", "память/воспоминание")], THEMES),
        spark.createDataFrame(list(exclusions), EXCLUSIONS), spark.createDataFrame([(1, "Часть 1", 1, "Книга первая", 0, 10)], PARTS),
    )
    return Analysis(sources, profile or replace(RUSSIAN, lemmas=LEMMAS), keep=False)
