"""Rules over question rows, as arrays of error messages.

Three profiles exist. ``platform`` is lenient in marks and numbers and checks the script; ``research``
demands exactly the five keys and strict marks; ``gold`` is ``research`` without the near-duplicate
rule and joins list fields by blanks. An empty array accepts a row. Missing keys end the checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import languages, text

KEYS = ("course_name", "domain", "instruction", "rationale", "output")
MIN_SCRIPT_RATIO = 0.4
MIN_QUESTION, MIN_SYNTHESIS, COPIED_PREFIX = 15, 30, 20


def _note(failed: Column, message: Column | str) -> Column:
    return F.when(failed, message if isinstance(message, Column) else F.lit(message))


def out_of_scope_errors(combined: Column, terms: Column) -> Column:
    """One message for each term that the whole row mentions, whatever its case."""
    low = F.lower(combined)
    named = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (t != "") & F.contains(low, F.lower(t)))
    return F.transform(named, lambda t: F.concat(F.lit("out of scope: "), t))


def script_error(combined: Column, language: Column) -> Column:
    """A message if the language has a script of its own and too few letters are in it."""
    out = F.lit(None).cast("string")
    for name, (_, _, block) in languages.PRESETS.items():
        if block:
            low = text.script_ratio(combined, block) < MIN_SCRIPT_RATIO
            out = F.when(language == name, _note(low, f"not written in {name}")).otherwise(out)
    return out


def _parts(points: Callable[[Column], Column], null_as: str | None) -> dict[str, Column]:
    """The three fields without outer white space, and what several rules need of them."""
    field = lambda k: F.col(k) if null_as is None else F.coalesce(F.col(k), F.lit(null_as))
    question, why, answer = (text.stripped(field(k)) for k in ("instruction", "rationale", "output"))
    return {"q": question, "w": why, "a": answer, "n": points(why), "first": text.first_point(why), "all": F.concat_ws("\n", question, why, answer)}


def platform_errors(language: Column, out_of_scope: Column) -> Column:
    missing = F.array_compact(F.array(*[_note(text.is_blank(F.col(k)), k) for k in ("instruction", "rationale", "output")]))

    def rules(p: Column) -> Column:
        found = F.array_compact(
            F.array(
                _note(F.length(p["q"]) < MIN_QUESTION, "instruction too short"),
                _note(~p["n"].between(3, 5), F.concat(F.lit("points: "), p["n"].cast("string"))),
                _note(~text.has_example(p["w"], languages.example_markers(language)), "no worked example"),
                _note(F.length(p["a"]) < MIN_SYNTHESIS, "output too short"),
                _note((F.length(p["first"]) >= COPIED_PREFIX) & F.contains(p["a"], p["first"]), "output copies the first point"),
            )
        )
        return F.concat(found, out_of_scope_errors(p["all"], out_of_scope), F.array_compact(F.array(script_error(p["all"], language))))

    checked = text.let(_parts(text.points, None), rules)
    return F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing: "), F.array_join(missing, ", ")))).otherwise(checked)


def research_errors(domain: Column, course: Column, forbidden: Column, keys: Column | None = None) -> Column:
    """``keys``: the row's own key set if it comes from JSON; a set other than KEYS ends the checks."""

    def rules(p: Column) -> Column:
        found = F.array_compact(
            F.array(
                _note(~F.col("domain").eqNullSafe(domain), "wrong domain"),
                _note(~F.col("course_name").eqNullSafe(course), "wrong course"),
                _note(F.length(p["q"]) < MIN_QUESTION, "instruction too short"),
                _note(~p["n"].between(3, 5), F.concat(F.lit("points: "), p["n"].cast("string"))),
                _note(~text.has_example_strict(p["w"]), "no worked example"),
                _note(F.length(p["a"]) < MIN_SYNTHESIS, "output too short"),
                _note((p["first"] != "") & F.contains(p["a"], p["first"]), "output copies the first point"),
            )
        )
        return F.concat(found, out_of_scope_errors(p["all"], forbidden))

    checked = text.let(_parts(text.points_strict, ""), rules)
    if keys is None:
        return checked
    exact = F.sort_array(keys).eqNullSafe(F.array(*[F.lit(k) for k in sorted(KEYS)]))
    return F.when(exact, checked).otherwise(F.array(F.lit("wrong keys")))


gold_errors = research_errors


def integrity_violations(rows: DataFrame, expected_domain: Column) -> DataFrame:
    """(row_idx, reason) of rows with a blank key or another domain than expected."""
    blank = F.array_compact(F.array(*[_note(text.is_blank(F.col(k)), F.lit(f"blank {k}")) for k in KEYS]))
    wrong = F.array_compact(F.array(_note(~F.col("domain").eqNullSafe(expected_domain), "wrong domain")))
    return rows.withColumn("reason", F.explode(F.concat(blank, wrong))).select("row_idx", "reason")


def require_clean(rows: DataFrame, expected_domain: Column) -> DataFrame:
    """``rows`` themselves; raises with the first violation if there is any."""
    first = integrity_violations(rows, expected_domain).orderBy("row_idx", "reason").limit(1).collect()
    if first:
        raise ValueError(f"row {first[0]['row_idx']}: {first[0]['reason']}")
    return rows


def training_class(prompt_ok: Column, length: Column, most: int) -> Column:
    """'bad' (a blank field or nothing to learn) before 'too_long' before 'kept'."""
    blank = F.lit(False)
    for k in ("instruction", "rationale", "output", "domain"):
        blank = blank | text.is_blank(F.col(k))
    return F.when(blank | ~prompt_ok, "bad").when(length > most, "too_long").otherwise("kept")


# The ranges of a job's numbers and its kinds of quantization.
RANGES = (("examples_per_course", 20, 3000), ("epochs", 1, 5), ("lora_r", 4, 64), ("max_seq_len", 256, 4096), ("generation_concurrency", 1, 16))
QUANTS = ("Q4_K_M", "Q5_K_M", "Q8_0")


def config_errors() -> Column:
    """Messages for a job's configuration columns."""
    rules = [
        _note(text.is_blank(F.col("program_name")), "program name is missing"),
        _note(~F.coalesce(text.is_repo_id(F.col("base_model")), F.lit(False)), "base model is no repository id"),
        _note(~F.coalesce(F.col("quant").isin(*QUANTS), F.lit(False)), "unknown quantization"),
        _note(~F.coalesce(F.col("learning_rate").between(1e-6, 1e-3), F.lit(False)), "learning_rate out of range"),
        _note(F.coalesce(F.trim("hf_repo"), F.lit("")).rlike(".") & ~F.coalesce(text.is_repo_id(F.trim("hf_repo")), F.lit(False)), "target is no repository id"),
    ]
    rules += [_note(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), f"{c} out of range") for c, lo, hi in RANGES]
    return F.array_compact(F.array(*rules))


def form_errors(sources: Column) -> Column:
    """What a form must hold before it is sent: a program, a model id, at least one source."""
    rules = [
        _note(text.is_blank(F.col("program_name")), "program name is missing"),
        _note(~F.coalesce(text.is_repo_id(F.col("base_model")), F.lit(False)), "base model is no repository id"),
        _note(F.coalesce(sources, F.lit(0)) < 1, "no source"),
    ]
    return F.array_compact(F.array(*rules))


def manifest_errors() -> Column:
    """Messages for a model manifest's columns: repo, revision, gguf, profile (which may be null)."""
    rules = [
        _note(~F.coalesce(text.is_repo_id(F.col("repo")), F.lit(False)), "bad repo"),
        _note(~F.coalesce(text.is_plain_file_name(F.col("gguf")) & F.lower("gguf").endswith(".gguf"), F.lit(False)), "bad gguf"),
        _note(F.col("profile").isNotNull() & ~text.is_plain_file_name(F.col("profile")), "bad profile"),
        _note((F.coalesce("revision", F.lit("")) == "") | F.col("revision").rlike(r"[/\\?#]"), "bad revision"),
    ]
    return F.array_compact(F.array(*rules))


def can_write(role: Column, everywhere: Column, grants: Column, user: Column) -> Column:
    """Whether a token may write: by its role, or, if that is fine-grained, by a permission everywhere
    or a grant (array of struct<kind, name, permissions>) on the user's own account."""
    may = lambda p: F.coalesce(F.array_contains(p, "repo.write"), F.lit(False))
    scoped = F.exists(F.coalesce(grants, F.array()), lambda g: (g["kind"] == "user") & (g["name"] == user) & may(g["permissions"]))
    return F.coalesce((role == "write") | ((role == "fineGrained") & (may(everywhere) | scoped)), F.lit(False))


def missing_keys(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def retry_class(code: Column, kind: Column) -> Column:
    """What to do after a failed call: 'fatal' for quota and access, 'retry' for passing faults."""
    return (
        F.when(kind.isin("insufficient_quota", "invalid_api_key") | code.isin(401, 403), "fatal")
        .when((code == 429) | code.between(500, 599) | kind.isin("timeout", "connection"), "retry")
        .otherwise("error")
    )
