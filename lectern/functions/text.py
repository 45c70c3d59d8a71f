"""Text operators as Column builders: everything here runs inside the JVM.

Character classes are spelled out, because \\w and \\s differ between engines: WS is the white
space that trimming removes, LETTER a word character that is neither digit nor underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
POINT = r"(?:^|[\x09-\x0D ])([1-9])[.)][\x09-\x0D ]"
POINT_STRICT = r"(?:^|[\x09-\x0D ])([1-5])\.[\x09-\x0D ]"
CALCULATION = r"\d+[\x09-\x0D ]*[-+*/×=][\x09-\x0D ]*\d+"
CALCULATION_STRICT = r"\d+[\x09-\x0D ]*[-=][\x09-\x0D ]*\d+"
# Words that number a unit of teaching, in four scripts.
UNIT_WORDS = (
    "week|wk|lecture|lesson|session|class|unit|module|chapter|part|topic|day"
    "|שבוע|הרצאה|שיעור|מפגש|יחידה|פרק|נושא"
    "|أسبوع|الأسبوع|محاضرة|درس|وحدة|فصل"
    "|неделя|лекция|занятие|урок|тема|модуль"
)
UNIT_PREFIX = rf"(?iu)^\s*(?:{UNIT_WORDS})\s*#?\s*\d+[a-z]?\s*[:.)\-–—]\s*"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s*"


#: The characters of WS one by one.
_WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once, however often it uses them."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def stripped(c: Column) -> Column:
    """Without white space at both ends (Unicode white space, not only blanks)."""
    return F.btrim(c, F.lit(_WS_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(stripped(c) == "", F.lit(True))


def normalized(c: Column) -> Column:
    """For comparing: only letters, digits, underscores and single blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))


def points(c: Column) -> Column:
    return F.regexp_count(c, F.lit(POINT))


def points_strict(c: Column) -> Column:
    return F.regexp_count(c, F.lit(POINT_STRICT))


def point_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(POINT), F.lit(1))


def has_example(c: Column, markers: Column) -> Column:
    """A code fence, a calculation, or a word that announces an example."""
    low = F.lower(c)
    named = F.exists(markers, lambda m: F.contains(low, m))
    return F.contains(c, F.lit("```")) | c.rlike(CALCULATION) | named | F.contains(low, F.lit("for example")) | F.contains(low, F.lit("e.g."))


def has_example_strict(c: Column, marker: str = "לדוגמה") -> Column:
    return F.contains(c, F.lit(marker)) | F.contains(c, F.lit("```")) | c.rlike(CALCULATION_STRICT)


def first_point(c: Column) -> Column:
    """40 characters from behind the first ". " (from the start if there is none)."""
    return F.substring(F.element_at(F.split(c, r"\. ", 2), -1), 1, 40)


def script_ratio(c: Column, block: str) -> Column:
    """Characters of a block per letter, outside code fences; 1 without letters."""
    prose = F.regexp_replace(c, r"(?s)```.*?```", " ")
    letters = F.regexp_count(prose, F.lit(LETTER))
    inside = F.regexp_count(prose, F.lit(f"[{block}]"))
    return F.when(letters == 0, F.lit(1.0)).otherwise(inside.cast("double") / F.nullif(letters, F.lit(0)))


def cleaned(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\x00", ""), r"[ \t]+", " ")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def without_unit_prefix(c: Column) -> Column:
    """'Week 3: X' becomes 'X'; the text itself if nothing would be left."""
    rest = stripped(F.regexp_replace(c, UNIT_PREFIX, ""))
    return F.coalesce(F.nullif(rest, F.lit("")), stripped(c))


def distinct_ignoring_case(items: Column) -> Column:
    """The first of items that agree but for case, in order."""
    return F.aggregate(
        items, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.array_append(kept, x))
    )


def list_items(items: Column) -> Column:
    """Items without bullets, numbers and unit prefixes; blanks and repeats (but for case) dropped."""
    bare = F.transform(items, lambda x: without_unit_prefix(F.regexp_replace(x, BULLET, "")))
    return distinct_ignoring_case(F.filter(bare, lambda x: x.isNotNull() & (x != "")))


def list_of_text(c: Column) -> Column:
    return list_items(F.split(c, r"[\n;]"))


def titled(c: Column, most: int = 60) -> Column:
    """The first line, cut with an ellipsis beyond ``most`` characters."""
    line = stripped(F.split(F.coalesce(c, F.lit("")), r"\r?\n", 2)[0])
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, most), rf"{WS}+$", ""), F.lit("…")))


def text_direction(c: Column) -> Column:
    """'rtl' if at least a third as many words hold Hebrew letters as hold Latin ones only."""
    words = F.split(c, r"\s+")
    hebrew = F.size(F.filter(words, lambda w: w.rlike(r"[\x{0590}-\x{05FF}]")))
    latin = F.size(F.filter(words, lambda w: ~w.rlike(r"[\x{0590}-\x{05FF}]") & w.rlike("[A-Za-z]")))
    return F.when((hebrew > 0) & (hebrew * 3 >= latin), "rtl").otherwise("ltr")


def text_direction_by_runs(c: Column) -> Column:
    """The portable rule: runs of Hebrew or Arabic letters against runs of Latin ones, without code."""
    prose = F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), r"`[^`]*`", " ")
    right = F.regexp_count(prose, F.lit(r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}]+"))
    left = F.regexp_count(prose, F.lit("[A-Za-z]+"))
    return F.when((right > 0) & (right * 3 >= left), "rtl").otherwise("ltr")


def visible_prose(c: Column) -> Column:
    """Markdown without fences, inline code and formulas."""
    for pattern in (r"(?s)```.*?(?:```|$)", r"`[^`\n]*`", r"(?s)\$\$.*?\$\$", r"\$[^$\n]+\$"):
        c = F.regexp_replace(c, pattern, " ")
    return c


def without_thinking(c: Column) -> Column:
    """What follows the last </think>; nothing if a block never closes."""
    after = stripped(F.regexp_replace(c, r"(?s)^.*</think>", ""))
    return F.when(F.contains(c, F.lit("</think>")), after).when(F.contains(c, F.lit("<think>")), "").otherwise(stripped(c))


def normalized_math(c: Column) -> Column:
    r"""\( \) and \[ \] become $ and $$ outside fences and inline code."""
    mark = "\x01"
    code = r"(?s)(```.*?(?:```|$)|`[^`\n]*`)"
    parts = F.split(F.regexp_replace(c, code, f"{mark}$1{mark}"), mark)
    block = lambda x: F.regexp_replace(x, r"(?s)\\\[\s*(.+?)\s*\\\]", "\n\\$\\$\n$1\n\\$\\$\n")
    inline = lambda x: F.regexp_replace(x, r"(?s)\\\(\s*(.+?)\s*\\\)", "\\$$1\\$")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).otherwise(inline(block(x)))), "")


def snippet_parts(c: Column) -> Column:
    """A snippet cut at its markers: array of (text, whether it is a hit)."""
    parts = F.regexp_extract_all(c, F.lit("(?s)\x02[^\x03]*\x03|[^\x02]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_replace(p, "[\x02\x03]", "").alias("text"), p.startswith("\x02").alias("hit")))


def bytes_label(n: Column) -> Column:
    gb, mb, kb = (n / F.lit(float(1024**k)) for k in (3, 2, 1))
    return (
        F.when(n >= 1024**3, F.concat(F.format_string("%.1f", gb), F.lit(" GB")))
        .when(n >= 1024**2, F.concat(F.format_string("%.0f", mb), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.0f", kb), F.lit(" KB")))
    )


def duration_label(seconds: Column) -> Column:
    """'42s', '3m 5s', '2h 0m' or '1d 3h'; a dash for null."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    part = lambda size, within: F.floor(F.pmod(s, F.lit(within)) / F.lit(size)).cast("string")
    rest = F.pmod(s, F.lit(60))
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s >= 86400, F.concat(F.floor(s / F.lit(86400)).cast("string"), F.lit("d "), part(3600, 86400), F.lit("h")))
        .when(s >= 3600, F.concat(part(3600, 86400), F.lit("h "), part(60, 3600), F.lit("m")))
        .when(rest == 0, F.concat(part(60, 3600), F.lit("m")))
        .otherwise(F.concat(part(60, 3600), F.lit("m "), rest.cast("string"), F.lit("s")))
    )


def size_label(n: Column) -> Column:
    """Megabytes with one decimal, above a gigabyte gigabytes with two."""
    return F.when(n > 1 << 30, F.concat(F.format_string("%.2f", n / F.lit(float(1 << 30))), F.lit(" GB"))).otherwise(
        F.concat(F.format_string("%.1f", n / F.lit(float(1 << 20))), F.lit(" MB"))
    )


def markdown_html(c: Column) -> Column:
    """Paragraphs, '- ' lists, bold, code and links of a small Markdown subset as HTML."""

    def inline(x: Column) -> Column:
        x = F.regexp_replace(html_escaped(x), "`([^`]+)`", "<code>$1</code>")
        x = F.regexp_replace(x, r"\*\*([^*]+)\*\*", "<b>$1</b>")
        return F.regexp_replace(x, r"(https?://[^\s<)]+)", "<a href=\"$1\" target=\"_blank\" rel=\"noopener\">$1</a>")

    def block(x: Column) -> Column:
        lines = F.split(x, "\n")
        items = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("<li>"), inline(F.substring(line, F.lit(3), F.length(line))), F.lit("</li>"))), "")
        paragraph = F.array_join(F.transform(lines, inline), "<br>")
        return F.when(F.forall(lines, lambda line: line.startswith("- ")), F.concat(F.lit("<ul>"), items, F.lit("</ul>"))).otherwise(
            F.concat(F.lit("<p>"), paragraph, F.lit("</p>"))
        )

    return F.array_join(F.transform(F.split(c, r"\n{2,}"), block), "")


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def origins(c: Column) -> Column:
    """A comma-separated list as lower-case URL origins, '*' kept, in order without repeats."""
    items = F.transform(F.split(c, "[,\\s]+"), lambda x: F.when(x == "*", x).otherwise(F.lower(F.regexp_extract(x, r"(?i)^(https?://[^/\s]+)", 1))))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def metric_key(domain: Column) -> Column:
    return F.concat(F.lit("loss_"), F.replace(F.replace(F.lower(domain), F.lit(" "), F.lit("_")), F.lit("++"), F.lit("pp")))


def run_version(path: Column) -> Column:
    """The folder of a run's results, by the version in its output folder's name."""
    v = F.regexp_extract(path, r"qlora-(v\d+)", 1)
    return F.when(v == "", F.lit("eval_results")).otherwise(F.concat(F.lit("eval_results_"), v))


def model_size_b(model_id: Column) -> Column:
    """Billions of parameters named in a model id, else 7."""
    found = F.regexp_extract(model_id, r"(\d+(?:\.\d+)?)\s*[bB](?![a-zA-Z])", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(7.0))


def is_repo_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+$")


def is_plain_file_name(c: Column) -> Column:
    """A name without folders: not blank, no separators, not a dot name."""
    return F.coalesce(~is_blank(c) & ~c.rlike(r"[/\\:]") & ~c.isin(".", ".."), F.lit(False))


def error_message(c: Column) -> Column:
    """error.message, else message, else the first 300 characters of a response body."""
    return F.coalesce(F.get_json_object(c, "$.error.message"), F.get_json_object(c, "$.message"), F.substring(c, 1, 300))


def slug(c: Column, fallback: Column) -> Column:
    """Lower-case words of ASCII letters and digits joined by hyphens, at most 60 characters."""
    from lectern.functions.udfs import nfkd_ascii

    words = F.regexp_replace(F.regexp_replace(nfkd_ascii(c), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(F.lower(words), 1, 60), "-+$", ""), F.lit("")), fallback)
