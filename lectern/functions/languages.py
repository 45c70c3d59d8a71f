"""Per-language conventions as a broadcast-sized dimension and as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line that opens the conclusion, words that announce a worked example, and the
# character block that a text must mostly use (None: any).
PRESETS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "English": ("Final answer:", ("for example", "e.g.", "for instance", "consider"), None),
    "Hebrew": ("תשובה סופית:", ("לדוגמה", "למשל", "לדוגמא"), r"\x{0590}-\x{05FF}"),
    "Arabic": ("الإجابة النهائية:", ("على سبيل المثال", "مثلاً", "مثلا"), r"\x{0600}-\x{06FF}"),
    "Russian": ("Окончательный ответ:", ("например", "к примеру", "рассмотрим"), r"\x{0400}-\x{04FF}"),
    "Spanish": ("Respuesta final:", ("por ejemplo", "p. ej.", "consideremos"), None),
    "French": ("Réponse finale :", ("par exemple", "p. ex.", "considérons"), None),
    "German": ("Endgültige Antwort:", ("zum beispiel", "z. b.", "z.b.", "beispielsweise", "betrachten wir"), None),
}
GENERIC: tuple[str, tuple[str, ...], str | None] = ("Final answer:", (), None)

#: Our own wording; {program}, {courses}, {final} and {language} are filled in.
PREAMBLES = {
    "English": "You teach the {program} program ({courses}). Reply in English only. Reason step by step, then close with a line starting '{final}' and a short answer.",
    "Hebrew": "אתה מלמד בתוכנית {program} ({courses}). השב בעברית בלבד. נמק צעד אחר צעד וסיים בשורה שמתחילה ב'{final}' עם תשובה קצרה.",
    "Arabic": "أنت تدرّس في برنامج {program} ({courses}). أجب بالعربية فقط. علّل خطوة بخطوة ثم اختم بسطر يبدأ بـ'{final}' وإجابة قصيرة.",
    "Russian": "Ты преподаёшь в программе {program} ({courses}). Отвечай только по-русски. Рассуждай по шагам и закончи строкой, начинающейся с '{final}', с кратким ответом.",
    "Spanish": "Enseñas en el programa {program} ({courses}). Responde solo en español. Razona paso a paso y termina con una línea que empiece con '{final}' y una respuesta corta.",
    "French": "Tu enseignes dans le programme {program} ({courses}). Réponds en français seulement. Raisonne pas à pas et termine par une ligne commençant par '{final}' et une réponse courte.",
    "German": "Du unterrichtest im Studiengang {program} ({courses}). Antworte nur auf Deutsch. Begründe Schritt für Schritt und schließe mit einer Zeile, die mit '{final}' beginnt, und einer kurzen Antwort.",
}
GENERIC_PREAMBLE = "You teach the {program} program ({courses}). Reply in {language} only. Reason step by step, then close with a line starting '{final}' and a short answer."


def presets(spark: SparkSession) -> DataFrame:
    """One row per known language: language, final_answer, example_markers, script."""
    rows = [(name, final, list(markers), script) for name, (final, markers, script) in PRESETS.items()]
    return spark.createDataFrame(rows, "language string, final_answer string, example_markers array<string>, script string")


def _pick(language: Column, values: dict[str, Column], default: Column) -> Column:
    out = default
    for name, value in values.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def final_answer(language: Column) -> Column:
    return _pick(language, {n: F.lit(p[0]) for n, p in PRESETS.items()}, F.lit(GENERIC[0]))


def example_markers(language: Column) -> Column:
    return _pick(language, {n: F.array(*map(F.lit, p[1])) for n, p in PRESETS.items()}, F.array().cast("array<string>"))


def preamble(language: Column, program: Column, courses: Column) -> Column:
    """The filled-in template of a language; course names are joined by its own comma."""
    names = F.when(language == "Arabic", F.array_join(courses, "، ")).otherwise(F.array_join(courses, ", "))
    text = _pick(language, {n: F.lit(t) for n, t in PREAMBLES.items()}, F.lit(GENERIC_PREAMBLE))
    for mark, value in (("{final}", final_answer(language)), ("{language}", language), ("{program}", program), ("{courses}", names)):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return text


def system_prompt(program: Column, course: Column, language: Column, style_note: Column, out_of_scope: Column) -> Column:
    """What a model that writes rows is told: course, language, form, style and what to leave out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("You write exercises for the course "), course, F.lit(" of the program "), program, F.lit(".")),
        F.concat(F.lit("Write in "), language, F.lit(". Answer with a JSON object of the keys instruction, rationale and output.")),
        F.concat(F.lit("The rationale has 3 to 5 numbered points and one worked example; the output sums it up and ends in '"), final_answer(language), F.lit("' style.")),
        F.when(F.coalesce(style_note, F.lit("")) != "", F.concat(F.lit("Style: "), style_note)),
        F.when(F.size(out_of_scope) > 0, F.concat(F.lit("Leave out: "), F.array_join(out_of_scope, "; "))),
    )


def user_prompt(topic: Column, recent: Column) -> Column:
    """The request for one topic, with questions that must not be asked again."""
    return F.concat_ws("\n", F.concat(F.lit("Topic: "), topic), F.when(F.size(recent) > 0, F.concat(F.lit("Already asked:\n- "), F.array_join(recent, "\n- "))))
