"""Text functions and validation rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import arrays, languages, text
from lectern.functions.udfs import nfkd_ascii
from lectern.operators import validation

BASE = {
    "course_name": "Networks",
    "domain": "net",
    "instruction": "How does a handshake open a connection?",
    "rationale": "1. One side asks to open. 2. The other side agrees, 3 * 4 = 12 times at most. 3. Both sides may now send.",
    "output": "A connection opens once both sides have agreed to it in turn.",
}


def one(spark, column, **row):
    kinds = {int: "long", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("x")).first()["x"]


def platform(spark, language="English", terms=(), **changes):
    return one(spark, validation.platform_errors(F.lit(language), F.array(*map(F.lit, terms)).cast("array<string>")), **(BASE | changes))


def research(spark, terms=(), keys=None, **changes):
    k = None if keys is None else F.array(*map(F.lit, keys))
    return one(spark, validation.research_errors(F.lit("net"), F.lit("Networks"), F.array(*map(F.lit, terms)).cast("array<string>"), k), **(BASE | changes))


def test_the_base_row_passes(spark):
    assert platform(spark) == [] and research(spark) == [] and research(spark, keys=validation.KEYS) == []




@pytest.mark.parametrize(
    "changes,lenient,strict",
    [
        ({"rationale": "1. one. 2. two 3 = 3"}, ["points: 2"], ["points: 2"]),
        ({"rationale": "1. a 2. b 3. c 4. d 5. e 6. f, 1 = 1"}, ["points: 6"], []),
        ({"rationale": "1) a 2) b 3) c, 1 = 1"}, [], ["points: 0"]),
        ({"rationale": "5. a 6. b 7. c 8. d 9. e, 1 = 1"}, [], ["points: 1"]),
        ({"rationale": "x1. a y2. b z3. c, 1 = 1"}, ["points: 0"], ["points: 0"]),
        ({"rationale": "1. a 2. b 3 * 4 3. c"}, [], ["no worked example"]),
        ({"rationale": "1. a 2. b for example 3. c"}, [], ["no worked example"]),
        ({"rationale": "1. twelve chars 2. b 1 = 1 3. c", "output": "twelve chars 2. b 1 = 1 3. c stands here again"}, ["output copies the first point"], ["output copies the first point"]),
        ({"instruction": "short"}, ["instruction too short"], ["instruction too short"]),
        ({"output": "short"}, ["output too short"], ["output too short"]),
    ],
)
def test_mutants(spark, changes, lenient, strict):
    assert platform(spark, **changes) == lenient
    assert research(spark, **changes) == strict


def test_short_prefix_is_only_a_copy_for_the_strict_profile(spark):
    changes = {"rationale": "1. a 2. b 1 - 1 3. c", "output": "it holds that a 2. b 1 - 1 3. c, as was to be shown"}
    changes["rationale"] = "x. abc 1. a 2. b 1-1 3."  # the prefix is all behind the first mark
    changes["rationale"] = "1. a 1-1 2. b 3. tail"
    prefix = "a 1-1 2. b 3. tail"
    changes["output"] = f"so {prefix} it is, without any doubt"
    assert len(prefix) < 20
    assert "output copies the first point" not in platform(spark, **changes)
    assert "output copies the first point" in research(spark, **changes)


def test_terms_out_of_scope_give_one_message_each(spark):
    assert platform(spark, terms=("HANDSHAKE", "", "agreed", "absent")) == ["out of scope: HANDSHAKE", "out of scope: agreed"]
    assert len(research(spark, terms=("Handshake", "AGREED"))) == 2


def test_missing_keys_end_the_checks(spark):
    assert platform(spark, output="  ", instruction="") == ["missing: instruction, output"]
    assert research(spark, keys=("instruction", "rationale")) == ["wrong keys"]
    assert "wrong domain" in research(spark, domain="other")


def test_text_must_be_in_the_language_s_script(spark):
    assert platform(spark, "Hebrew") == ["not written in Hebrew"]
    hebrew = {"instruction": "איך נפתח חיבור בין שני צדדים?", "rationale": "1. צד אחד מבקש. 2. הצד השני מסכים, למשל 1 = 1. 3. שניהם שולחים.", "output": "חיבור נפתח אחרי ששני הצדדים הסכימו לכך זה אחר זה."}
    assert platform(spark, "Hebrew", **hebrew) == []


@pytest.mark.parametrize("body,ratio", [("שלום world עולם", 8 / 13), ("english only", 0.0), ("123 !?", 1.0), ("שלום ```some english code```", 1.0)])
def test_script_ratio(spark, body, ratio):
    assert one(spark, text.script_ratio(F.col("t"), r"\x{0590}-\x{05FF}"), t=body) == pytest.approx(ratio)


def test_script_ratio_may_exceed_one(spark):
    assert one(spark, text.script_ratio(F.col("t"), r"\x{0590}-\x{05FF}"), t="שָׁלוֹם") > 1


def test_a_mark_consumes_the_space_behind_it(spark):
    assert one(spark, text.points(F.col("t")), t="1. a = 2.\n3. x") == 2


@pytest.mark.parametrize(
    "function,given,wanted",
    [
        (text.normalized, "  A, b!\n C_d  ", "a b c_d"),
        (text.first_point, "no mark here", "no mark here"),
        (text.first_point, "1. " + "x" * 50, "x" * 40),
        (text.cleaned, "\x00a \t b\n\n\n\nc ", "a b\n\nc"),
        (text.without_unit_prefix, "Week 3: Chances", "Chances"),
        (text.without_unit_prefix, "Lecture 3 - ", "Lecture 3 -"),
        (text.without_unit_prefix, "שבוע 2: רקורסיה", "רקורסיה"),
        (text.titled, "first line\nsecond", "first line"),
        (text.titled, "x" * 80, "x" * 60 + "…"),
        (text.without_thinking, "<think>a</think> b", "b"),
        (text.without_thinking, "<think>a</think>b<think>c</think> d ", "d"),
        (text.without_thinking, "<think>never ends", ""),
        (text.without_thinking, " plain ", "plain"),
        (text.normalized_math, r"a \(x\) `\(y\)` \[z\]", "a $x$ `\\(y\\)` \n$$\nz\n$$\n"),
        (text.html_escaped, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"),
        (text.markdown_html, "a **b** `c`\nd\n\n- x\n- y", "<p>a <b>b</b> <code>c</code><br>d</p><ul><li>x</li><li>y</li></ul>"),
        (text.text_direction, "שלום to you", "rtl"),
        (text.text_direction, "one two three four שלום", "ltr"),
        (text.text_direction_by_runs, "مرحبا ```code code```", "rtl"),
        (text.metric_key, "Data C++", "loss_data_cpp"),
        (text.run_version, "out/qlora-v8-x", "eval_results_v8"),
        (text.error_message, '{"error": {"message": "no"}}', "no"),
        (text.error_message, "plain", "plain"),
        (text.visible_prose, "a `b` $c$ d", "a     d"),
    ],
)
def test_text_functions(spark, function, given, wanted):
    assert one(spark, function(F.col("t")), t=given) == wanted


@pytest.mark.parametrize("name,size", [("org/Model-1.5B-Instruct", 1.5), ("org/model2.0", 7.0), ("org/m-12b", 12.0), ("a/3bit", 7.0)])
def test_model_size(spark, name, size):
    assert one(spark, text.model_size_b(F.col("t")), t=name) == size


def test_lists_and_origins(spark):
    assert one(spark, text.list_of_text(F.col("t")), t="1. A\n- b;Week 3: a\n\n* c") == ["A", "b", "c"]
    assert one(spark, text.origins(F.col("t")), t="HTTP://A.b/c, *, junk http://a.b") == ["http://a.b", "*"]
    assert one(spark, text.snippet_parts(F.col("t")), t="a \x02hit\x03 b") == [("a ", False), ("hit", True), (" b", False)]


@pytest.mark.parametrize("seconds,label", [(None, "—"), (42.4, "42s"), (180.0, "3m"), (185.0, "3m 5s"), (7200.0, "2h 0m"), (97200.0, "1d 3h")])
def test_durations(spark, seconds, label):
    assert spark.createDataFrame([(seconds,)], "s double").select(text.duration_label(F.col("s"))).first()[0] == label


def test_file_and_repo_names(spark):
    names = ["a.gguf", "../a", "a/b", "..", " ", None]
    got = spark.createDataFrame([(n,) for n in names], "t string").select(text.is_plain_file_name(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert one(spark, text.is_repo_id(F.col("t")), t="o.r-g/m_1") and not one(spark, text.is_repo_id(F.col("t")), t="a/b/c")


def test_accents_and_slugs(spark):
    assert one(spark, nfkd_ascii(F.col("t")), t="Éa ß 漢") == "Ea  "
    assert one(spark, text.slug(F.col("t"), F.lit("none")), t="  Résumé & Co. ") == "resume-co"
    assert one(spark, text.slug(F.col("t"), F.lit("none")), t="漢字") == "none"


def test_preambles(spark):
    p = one(spark, languages.preamble(F.col("l"), F.lit("P"), F.array(F.lit("a"), F.lit("b"))), l="Arabic")
    assert "a، b" in p and "{" not in p
    assert "in Klingon only" in one(spark, languages.preamble(F.col("l"), F.lit("P"), F.array(F.lit("a"))), l="Klingon")
    assert languages.presets(spark).count() == 7


@pytest.mark.parametrize("prompt,full,labels", [([1, 2, 3], [1, 2, 3, 4, 5], [-100, -100, -100, 4, 5]), ([1, 2, 9], [1, 2, 3, 4], [-100, -100, 3, 4]), ([7], [1, 2], [1, 2]), ([1, 2, 3], [1, 2], [-100, -100])])
def test_masks(spark, prompt, full, labels):
    row = spark.createDataFrame([(prompt, full)], "p array<int>, f array<int>").select(arrays.masked_labels(F.col("p"), F.col("f")).alias("y"))
    row = row.select("y", arrays.is_trainable(F.col("y"), 5).alias("keep")).first()
    assert row["y"] == labels and row["keep"] == (5 in [x for x in labels if x != -100])


def test_json_as_text(spark):
    for given, wanted in [('["1. a","2. b"]', "1. a\n2. b"), ('"x"', "x"), ('{"k": 1}', '{"k": 1}'), ("3", "3"), ("null", None), ("not json", None)]:
        assert one(spark, arrays.as_text(F.col("t")), t=given) == wanted
    assert one(spark, arrays.as_text(F.col("t"), " ", True), t='[" a ", "b"]') == "a b"
    assert one(spark, arrays.is_key_set(F.col("t"), ["a", "b"]), t='{"b": 1, "a": 2}') is True
    assert one(spark, arrays.is_key_set(F.col("t"), ["a"]), t='{"b": 1, "a": 2}') is False


def test_array_helpers(spark):
    df = spark.createDataFrame([(["A", "b"], ["a", "c"])], "x array<string>, y array<string>")
    assert df.select(arrays.appended_if_new(F.col("x"), F.col("y"))).first()[0] == ["A", "b", "c"]
    m = spark.range(1).select(arrays.patched(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first()["m"]
    assert m == {"a": 1, "b": 3}
    assert spark.range(1).select(arrays.padded(F.array(F.lit(1)), F.lit(3), 0)).first()[0] == [1, 0, 0]
    assert spark.range(1).select(arrays.padded_length(F.lit(17))).first()[0] == 24


def test_grants_retries_and_classes(spark):
    tokens = [("write", None, None), ("read", ["repo.write"], None), ("fineGrained", ["repo.write"], None), ("fineGrained", [], [("user", "me", ["repo.write"])]), ("fineGrained", None, [("org", "me", ["repo.write"]), ("user", "you", ["repo.write"]), ("user", "me", [])])]
    g = spark.createDataFrame(tokens, "role string, e array<string>, g array<struct<kind:string,name:string,permissions:array<string>>>")
    assert [r[0] for r in g.select(validation.can_write(F.col("role"), F.col("e"), F.col("g"), F.lit("me"))).collect()] == [True, False, True, True, False]
    codes = spark.createDataFrame([(429, ""), (503, ""), (401, ""), (429, "insufficient_quota"), (400, ""), (0, "timeout")], "c int, k string")
    assert [r[0] for r in codes.select(validation.retry_class(F.col("c"), F.col("k"))).collect()] == ["retry", "retry", "fatal", "fatal", "error", "retry"]
    m = spark.createDataFrame([("o/r", "main", "a.gguf", "a.json"), ("x", "a/b", "../a.gguf", "../a.json"), ("o/r", "main", "a.gguf", None)], "repo string, revision string, gguf string, profile string")
    assert [len(r[0]) for r in m.select(validation.manifest_errors()).collect()] == [0, 4, 0]


def test_the_gate_names_the_first_violation(spark):
    rows = spark.createDataFrame([(0, *BASE.values()), (1, *(BASE | {"output": " "}).values())], "row_idx long, " + ", ".join(f"{k} string" for k in BASE))
    with pytest.raises(ValueError, match="row 1: blank output"):
        validation.require_clean(rows, F.lit("net"))
    assert validation.require_clean(rows.where("row_idx = 0"), F.lit("net")).count() == 1
