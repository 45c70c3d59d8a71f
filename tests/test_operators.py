"""Corpus, loss, judge, course, chat, search and job operators on hand-made rows and properties."""

import difflib
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import chat, corpus, courses, dedupe, jobs, judge, losses, search

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NAN = float("nan")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- near duplicates --------------------------------------------------------------------------


def normal(t):
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t)).strip().lower()


def naive(rows, second=True, threshold=0.72):
    kept, out = {}, {}
    for domain, idx, t in sorted(rows, key=lambda r: r[1]):
        best = (0.0, None)
        for i, other in kept.get(domain, []):
            a, b = (normal(other), normal(t)) if second else (normal(t), normal(other))
            r = difflib.SequenceMatcher(None, a, b).ratio()
            if r > best[0] or (best[1] is None and r >= threshold):
                best = (r, i)
        ok = best[0] < threshold
        out[(domain, idx)] = (ok, None if ok else best[1])
        if ok:
            kept.setdefault(domain, []).append((idx, t))
    return out


def questions():
    rng = random.Random(3)
    w = ["what", "is", "a", "stack", "queue", "heap", "graph", "tree", "sorting", "hash", "table", "why", "how"]
    rows = [("d%d" % (i % 3), i, " ".join(rng.choice(w) for _ in range(rng.randint(2, 8)))) for i in range(90)]
    rows += [("d0", 100, ""), ("d0", 101, "!!"), ("d1", 102, "How is a stack, really?"), ("d2", 103, "How is a stack, really?")]
    a, b = "ab" * 121 + "c", "ba" * 121 + "d"
    # alike beyond the first 150 characters, and alike there only
    head, tail = " ".join(f"w{i}x" for i in range(40)), " ".join(f"tail{i * i}" for i in range(40))
    rows += [("far", 300, head + tail), ("far", 301, head + tail + " end"), ("far", 302, head + tail[::-1] * 6), ("far", 303, "z" * 9000 + tail)]
    return rows + [("long", 200, a), ("long", 201, b)]


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=150), min_size=1, max_size=4), st.lists(st.text("abc", max_size=150), min_size=1, max_size=4))
def test_common_subsequences_in_step(a, b):
    code = lambda texts: [np.array([ord(c) - 97 for c in t], dtype=np.int32) for t in texts]
    pairs = np.array([(i, j) for i in range(len(a)) for j in range(len(b))])
    want = [common_subsequence(a[i], b[j]) for i, j in pairs]
    for narrow in (0, 64, 256):
        assert dedupe.longest_common(code(a), code(b), pairs, 3, narrow).tolist() == want


def test_bounds_leave_every_similar_pair(spark):
    df = spark.createDataFrame(questions(), "domain string, row_idx long, instruction string")
    left = {(r["a_idx"], r["b_idx"]) for r in dedupe.candidate_pairs(df).collect()}
    assert {(r["a_idx"], r["b_idx"]) for r in dedupe.similar_edges(df).collect()} <= left


@pytest.mark.parametrize("block_rows,block_chars", [(2048, 1 << 22), (3, 1 << 22), (2048, 40)])
def test_bounds_equal_a_plain_loop(spark, block_rows, block_chars):
    random.seed(5)
    letters = "aabcdé \U00010400\u4e00"
    texts = ["", None, " ", "x" * 70_000, "x" * 60_000, *("".join(random.choices(letters, k=random.choice([1, 2, 5, 9, 16, 17, 30]))) for _ in range(120))]
    rows = [("ab"[i % 2], i, t) for i, t in enumerate(texts)] + [(None, 1000, "a"), (None, 1001, "a")]
    df = spark.createDataFrame(rows, "domain string, row_idx long, instruction string")
    norm = [(d, i, normal(t)) for d, i, t in rows if d and t is not None]
    want = []
    for d, i, a in norm:
        for e, j, b in norm:
            total = len(a) + len(b)
            bounds = (2 * min(len(a), len(b)) / total, 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / total) if total else (1.0, 1.0)
            if d == e and i < j and min(bounds) >= 0.72:
                want.append((d, i, j, *bounds))
    got = dedupe.candidate_pairs(df, block_rows=block_rows, block_chars=block_chars)
    assert rows_of(got, "domain", "a_idx", "b_idx", "length_bound", "count_bound") == sorted(want, key=repr)
    # texts meet in blocks, never one pair at a time
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("second,block_rows", [(True, 1024), (False, 1024), (True, 7), (False, 7)])
def test_greedy_equals_the_plain_loop(spark, second, block_rows):
    rows = questions()
    df = spark.createDataFrame(rows, "domain string, row_idx long, instruction string")
    got = dedupe.greedy_accept(df, dedupe.similar_edges(df, candidate_is_second=second, block_rows=block_rows))
    assert {(r["domain"], r["row_idx"]): (r["accepted"], r["match_idx"]) for r in got.collect()} == naive(rows, second)


def test_exact_duplicates_and_leakage(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "row_idx long, instruction string")
    assert rows_of(dedupe.exact_duplicates(df), "instruction", "n", "row_ids") == [("a", 2, [0, 2])]
    gold = spark.createDataFrame([(1, "The cat, sat"), (2, "zzz")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "cat sat on"), (8, "the CAT sat")], "row_idx long, text string")
    assert rows_of(dedupe.leakage(gold, docs), "item_id", "row_idx", "jaccard") == [(1, 8, 1.0)]


# --- corpus -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n,research,platform", [(3, 1, 1), (10, 5, 2), (50, 20, 10), (400, 20, 20), (1200, 60, 60), (1, 0, 1)])
def test_validation_sizes(spark, n, research, platform):
    df = spark.range(n).select(F.lit("d").alias("domain"), F.col("id").alias("row_idx"))
    for is_platform, want in ((False, research), (True, platform)):
        parts = corpus.stratified_split(df, is_platform).groupBy("part").count().collect()
        assert dict(map(tuple, parts)).get("val", 0) == want


def test_weights_and_lengths(spark):
    df = spark.createDataFrame([("a", i) for i in range(900)] + [("b", i) for i in range(100)], "domain string, n_chars long")
    assert rows_of(corpus.domain_weights(df), "domain", "weight", "draws", "uniform") == [("a", 1.0, 1200, False), ("b", 3.0, 1200, False)]
    ten = spark.createDataFrame([("d", i) for i in range(1, 11)], "domain string, n_chars long")
    assert rows_of(corpus.length_stats(ten), "p50", "p95", "longest") == [(6, 10, 10)]


def test_weighted_draws_follow_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "row_idx long, weight double")
    draws = corpus.weighted_draws(df, 4000).groupBy("row_idx").count().collect()
    got = dict(map(tuple, draws))
    assert sum(got.values()) == 4000 and 2 not in got and abs(got[1] / 4000 - 0.75) < 0.05


@SLOW
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 4))
def test_stall_equals_the_loop(spark, accepted, limit):
    run, want = 0, None
    for i, ok in enumerate(accepted):
        run = 0 if ok else run + 1
        if run == limit:
            want = i
            break
    df = spark.createDataFrame([("d", i, ok) for i, ok in enumerate(accepted)], "domain string, pos int, accepted boolean")
    got = corpus.stall_points(df, limit).collect()
    assert [r["stalled_at"] for r in got] == ([] if want is None else [want])


def test_round_robin_uses_every_topic_in_each_pass(spark):
    t = spark.createDataFrame([("d", x) for x in "abc"], "domain string, topic string")
    got = corpus.round_robin(t, 7).collect()
    assert len(got) == 7
    for p in (0, 1):
        assert {r["topic"] for r in got if r["pass"] == p} == set("abc")


# --- losses -----------------------------------------------------------------------------------


def test_report_with_nan_and_unknown_domains(spark):
    items = spark.createDataFrame([("a", 1.0, 0.5), ("a", NAN, NAN), ("b", NAN, NAN), ("zz", 3.0, 1.5)], "domain string, base_loss double, ft_loss double")
    domains = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "domain string, place int")
    got = {r["domain"]: r for r in losses.loss_report(items, domains).collect()}
    assert (got["a"]["n"], got["a"]["base_loss"], got["a"]["delta"]) == (2, 1.0, 0.5) and got["a"]["base_ppl"] == round(math.e, 4)
    assert got["b"]["n"] == 1 and math.isnan(got["b"]["base_loss"]) and math.isnan(got["b"]["ft_ppl"])
    assert got["c"]["n"] == 0 and math.isnan(got["c"]["base_loss"])
    assert got["OVERALL"]["n"] == 4 and got["OVERALL"]["base_loss"] == 2.0 and "zz" not in got


# Published results of three runs: OVERALL losses and perplexities, base loss and the gains between runs.
OVERALL = {"r6": 0.643296, "r7": 0.589912, "r8": 0.558437}


def comparison(spark, rows, prior=("a",)):
    long = [(n, d, p, 4, b, loss, math.exp(loss)) for d, p, b, each in rows for n, loss in each.items()]
    runs = spark.createDataFrame(long, "run string, domain string, place int, n long, base_loss double, ft_loss double, ft_ppl double")
    return losses.compare_runs(runs, ["r6", "r7", "r8"], spark.createDataFrame([(p,) for p in prior], "domain string"))


def test_comparison_of_three_runs(spark):
    rows = [("a", 0, 0.9, {"r6": 0.5, "r7": 0.4, "r8": 0.4}), ("b", 1, 0.8, {"r6": 0.6, "r7": 0.7, "r8": 0.5}), ("OVERALL", 2**31 - 1, 0.859832, OVERALL)]
    got = {r["domain"]: r for r in comparison(spark, rows).collect()}
    o = got["OVERALL"]
    assert (o["gain_r7_over_r6"], o["gain_r8_over_r7"], o["gain_r8_over_r6"], o["best_run"]) == (0.053384, 0.031475, 0.084859, "r8")
    assert got["a"]["best_run"] == "r7" and got["b"]["best_run"] == "r8"  # equal losses: the first listed
    assert got["a"]["grp"] == "prior" and got["b"]["grp"] == "new"
    assert got["ALL_DOMAINS_MEAN"]["n"] == 8 and got["ALL_DOMAINS_MEAN"]["r8_loss"] == 0.45 and got["ALL_DOMAINS_MEAN"]["best_run"] == ""
    assert got["ALL_DOMAINS_MEAN"]["r8_ppl"] == round((math.exp(0.4) + math.exp(0.5)) / 2, 6)


def test_runs_that_disagree_are_refused(spark):
    rows = [("a", 0, 0.9, {"r6": 0.5, "r7": 0.4})]
    with pytest.raises(ValueError, match="differ"):
        comparison(spark, rows).count()
    bad = spark.createDataFrame([("r6", "a", 0, 4, 0.9, 0.5, 1.0), ("r7", "a", 0, 4, 0.95, 0.5, 1.0)], "run string, domain string, place int, n long, base_loss double, ft_loss double, ft_ppl double")
    with pytest.raises(ValueError, match="disagree"):
        losses.compare_runs(bad, ["r6", "r7"])


def test_early_stopping(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5.0, 4.0, 4.5, 4.6, 3.0, 3.5, 3.6, 3.7, 1.0])], "series string, step int, loss double")
    assert rows_of(losses.best_checkpoint(df, 3), "best_step", "best_loss", "stopped_at", "evaluations") == [(4, 3.0, 7, 8)]


# --- judge ------------------------------------------------------------------------------------


def judged(spark, answers, verdicts):
    subject = spark.createDataFrame([(i, a[0]) for i, a in enumerate(answers) if a[0] is not None], "idx int, answer string")
    theirs = spark.createDataFrame([("o", i, a[1]) for i, a in enumerate(answers) if a[1] is not None], "opponent string, idx int, answer string")
    v = spark.createDataFrame([("o", i, o, p, k) for k, (i, o, p) in enumerate(verdicts)], "opponent string, idx int, order string, points int, line int")
    return subject, theirs, v


def test_outcomes_follow_the_table(spark):
    table = [(1, 1, "win", 0), (1, 0, "win", 0), (1, -1, "tie", 1), (0, 0, "tie", 0), (0, -1, "loss", 0), (-1, -1, "loss", 0)]
    verdicts = [x for i, (a, b, *_) in enumerate(table) for x in ((i, judge.ORDERS[0], a), (i, judge.ORDERS[1], b))]
    n = len(table)
    answers = [("a", "bb")] * n + [("a", "b"), ("", ""), ("", "b"), ("a", ""), (None, "b")]
    verdicts += [(n, judge.ORDERS[0], 1), (0, judge.ORDERS[0], -1), (0, judge.ORDERS[0], 1)]
    got = rows_of(judge.outcomes(*judged(spark, answers, verdicts)), "idx", "outcome", "flip")
    want = [(i, o, f) for i, (_, _, o, f) in enumerate(table)] + [(n + 1, "tie", 0), (n + 2, "loss", 0), (n + 3, "win", 0)]
    assert got == sorted(want, key=repr)
    todo = rows_of(judge.worklist(*judged(spark, answers, verdicts)), "idx", "order")
    assert todo == [(n, judge.ORDERS[1])]


@SLOW
@given(st.lists(st.tuples(st.integers(-1, 1), st.integers(-1, 1)), min_size=1, max_size=12))
def test_swapping_sides_swaps_wins_and_losses(spark, points):
    def totals(sign):
        v = [x for i, (a, b) in enumerate(points) for x in ((i, judge.ORDERS[0], sign * a), (i, judge.ORDERS[1], sign * b))]
        r = judge.summary(judge.outcomes(*judged(spark, [("x", "y")] * len(points), v)), "opponent").first()
        return r["wins"], r["ties"], r["losses"], r["flips"]

    a, b = totals(1), totals(-1)
    assert a == (b[2], b[1], b[0], b[3]) and sum(a[:3]) == len(points)


def test_published_summary(spark):
    rows = [("base", "win", 0)] * 53 + [("base", "tie", 1)] * 25 + [("base", "loss", 0)] * 14
    s = judge.summary(spark.createDataFrame(rows, "opponent string, outcome string, flip int"), "opponent").first()
    assert (s["n"], s["win_rate"], s["win_or_tie_rate"], s["flips"]) == (92, 0.576, 0.848, 25)


def test_blind_sheet_covers_domains(spark):
    df = spark.createDataFrame([(i, f"d{i % 9}") for i in range(90)], "row_idx long, domain string")
    got = judge.blind_sheet(df, 20).collect()
    assert len(got) == 20 and len({r["domain"] for r in got}) == 9 and [r["sheet_id"] for r in sorted(got, key=lambda r: r["row_idx"])] == list(range(1, 21))
    assert {r["subject_is"] for r in got} == {"A", "B"}


# --- courses ----------------------------------------------------------------------------------


def outlines(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["doc_id"], r["course_name"], r["topics"]) for r in courses.outline_courses(df).orderBy("doc_id", "block").collect()]


def test_outlines(spark):
    weeks = "\n".join(f"week {i}: Topic {c}" for i, c in enumerate("abcdef"))
    wanted = [f"Topic {c}" for c in "abcdef"]
    hebrew = "שם הקורס: רשתות\n" + "\n".join(f"שבוע {i}: נושא {c}" for i, c in enumerate("אבגדה"))
    prose = "This text has sentences that go on and on for so long that no one could take any of them for a topic of a course. " * 3
    got = outlines(
        spark, weeks, "Intro to Things\n" + weeks, f"Course: One\n{weeks}\nCourse title - Two\n1. a\n2) b\n- c\n• d\n* e\n* E", hebrew, prose, "a\nb\nc\nd\ne", "# Course: X\n\nplain one\nWeek 1: m\nplain two\nthree\nfour;", "Course: Few\n- a\n- b"
    )
    assert got == [
        (0, "", wanted), (1, "Intro to Things", wanted), (2, "One", wanted), (2, "Two", ["a", "b", "c", "d", "e"]), (3, "רשתות", [f"נושא {c}" for c in "אבגדה"]),
        (5, "", list("abcde")), (6, "X", ["m", "plain one", "plain two", "three", "four"]),
    ]


def test_normalise_merge_and_suffix(spark):
    five = ["1. Sorting", "b", "c", "d", "e", "B"]
    raw = [
        ("s", 0, "Algorithms", "algo", None, "x", five, ["q"], " note "), ("s", 1, "ALGORITHMS", "algo", None, "", ["f", "b", "g", "h", "i"], ["p"], ""),
        ("s", 2, " ", None, None, "", five, None, None), ("s", 3, None, None, None, "", five, None, None), ("s", 4, "Short", "x", None, "", ["a", "b"], None, None),
    ]
    df = spark.createDataFrame(raw, "source string, pos int, course_name string, domain string, language string, summary string, topics array<string>, out_of_scope array<string>, style_note string")
    n = courses.normalised(df, F.lit("Program"))
    assert [(r["course_name"], r["domain"], r["topics"][0], r["style_note"]) for r in n.orderBy("pos").collect()] == [
        ("Algorithms", "algo", "Sorting", "note"), ("ALGORITHMS", "algo", "f", None), ("Program", "Program", "Sorting", None), ("Program 2", "Program 2", "Sorting", None)
    ]
    m = {r["course_name"]: r for r in courses.merged_courses(n).collect()}
    assert m["Algorithms"]["topics"] == ["Sorting", "b", "c", "d", "e", "f", "g", "h", "i"] and m["Algorithms"]["out_of_scope"] == ["p", "q"] and len(m) == 3


@pytest.mark.parametrize("labels,want", [(["X", "X 2", "X"], ["X", "X 2", "X 3"]), (["a", "A", "a"], ["a", "A 2", "a 3"]), (["Ä", "Ä"], ["Ä", "Ä 2"])])
def test_suffixes_skip_taken_names(spark, labels, want):
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(labels)], "program string, pos int, domain string")
    got = courses.unique_labels(df).orderBy("pos").collect()
    assert [r["domain"] for r in got] == want and len({r["slug"] for r in got}) == len(want)


# --- chat -------------------------------------------------------------------------------------


def convo(spark, turns):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")


def texts(df):
    return [(r["role"], r["text"]) for r in df.orderBy("turn").collect()]


def test_prompts(spark):
    turns = [("assistant", "hello"), ("user", "q1"), ("assistant", " "), ("user", "q1 again"), ("assistant", "a1")]
    assert texts(chat.prompts(convo(spark, turns), "P")) == [("user", "P\n\nq1\n\nq1 again"), ("assistant", "a1")]
    long = [("user", "x" * 300), ("assistant", "y" * 300), ("user", "latest")]
    assert texts(chat.prompts(convo(spark, long), context=200, max_tokens=100)) == [("user", "latest")]
    assert len(texts(chat.prompts(convo(spark, long[:2]), context=200, max_tokens=100))) == 2


@SLOW
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(0, 90))
def test_trimming_equals_the_loop(spark, sizes, budget):
    turns = [("user" if i % 2 == 0 else "assistant", "x" * n) for i, n in enumerate(sizes)]
    want = turns[:]
    while len(want) > 2 and sum(len(t) for _, t in want) > budget:
        want = want[2:]
    assert texts(chat.trimmed(convo(spark, turns), budget)) == want


def test_portable_trimming(spark):
    turns = [("user", "a" * 10), ("assistant", "b" * 10), ("user", "c" * 10), ("assistant", "d" * 10), ("user", "e" * 100)]
    assert texts(chat.trimmed_portable(convo(spark, turns), 50)) == [("user", "e" * 100)]
    assert [t[0] for _, t in texts(chat.trimmed_portable(convo(spark, turns), 125))] == ["c", "d", "e"]


def test_streams_cut_inside_a_character(spark):
    data = 'data: {"choices":[{"delta":{"content":"é"}}]}\r\ndata: {"choices":[{"delta":{"content":"b"}}]}\n\nevent: x\ndata: [DONE]\ndata: {"cut'.encode()
    at = data.index("é".encode()) + 1
    df = spark.createDataFrame([("s", 1, bytearray(data[at:])), ("s", 0, bytearray(data[:at]))], "stream string, seq int, bytes binary")
    payloads = chat.sse_payloads(df)
    assert [r["payload"] for r in payloads.orderBy("pos").collect()][-1] == "[DONE]" and payloads.count() == 3
    assert rows_of(chat.stream_text(payloads), "text", "done") == [("éb", True)]


# --- search -----------------------------------------------------------------------------------


def test_search(spark):
    m = spark.createDataFrame([(1, 1, "The SYN, ACK handshake opens it."), (2, 1, "acknowledge syn"), (3, 2, "a handshake—café style: handshake")], "message_id long, conv_id long, text string")
    c = spark.createDataFrame([(1, "one"), (2, "two")], "conv_id long, title string")
    find = lambda q: [(r["message_id"], r["snippet"]) for r in search.search(m, c, q).collect()]
    assert {i for i, _ in find("handshake")} == {1, 3}
    assert find("SYN-ACK") == [(1, "The \x02SYN, ACK\x03 handshake opens it.")]
    assert find('ACK" OR x') == [] and find("  ") == [] and {i for i, _ in find("CAFE")} == {3}
    index = search.build_index(m)
    new = search.updated_index(index, spark.createDataFrame([(1, "nothing here")], "message_id long, text string"), spark.createDataFrame([(3,)], "message_id long"))
    assert search.phrase_matches(new, ["handshake"]).count() == 0 and search.phrase_matches(new, ["nothing", "here"]).count() == 1
    assert rows_of(search.phrase_matches(search.build_index(spark.createDataFrame([(1, "a a a b")], "message_id long, text string")), ["a", "a"]), "hits", "first_pos") == [(2, 0)]


# --- jobs -------------------------------------------------------------------------------------


def test_smoothed_rate(spark):
    df = spark.createDataFrame([("s", float(t), i, float(d)) for i, (t, d) in enumerate([(0, 0), (2, 1), (6, 2), (12, 3)])], "series string, ts double, seq int, done double")
    assert jobs.smoothed_rate(df).first()["sec_per_unit"] == pytest.approx(2.855)


@SLOW
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), min_size=1, max_size=20))
def test_throttle_equals_the_loop(spark, samples):
    samples = sorted(samples, key=lambda s: s[0])
    last, want = None, []
    for i, (t, forced) in enumerate(samples):
        if forced or last is None or t - last >= 5:
            last = t
            want.append(i)
    df = spark.createDataFrame([("s", float(t), i, f) for i, (t, f) in enumerate(samples)], "series string, ts double, seq long, forced boolean")
    assert sorted(r["seq"] for r in jobs.throttled(df, 5.0).collect()) == want


def test_etas(spark):
    est = dict(zip(jobs.STAGE_NAMES, (10, 100, 1000, 100, 10, 1), strict=True))
    stages = [("j", s, {"ingest": "done", "generate": "running"}.get(s, "pending"), 10.0 if s == "generate" else None, None, float(e), 0.5 if s == "generate" else None) for s, e in est.items()]
    df = spark.createDataFrame(stages, "job_id string, stage string, status string, eta_s double, started_at double, estimate double, fraction double")
    job = lambda s: spark.createDataFrame([("j", s)], "job_id string, status string")
    assert [jobs.pipeline_eta(job(s), df, F.lit(0.0)).first()["eta"] for s in ("running", "succeeded", "failed", "awaiting_review")] == [1121, 0, None, None]
    assert jobs.overall_fraction(df).first()["fraction"] == round((10 + 50) / 1221, 4)


def test_queue(spark):
    rows = [("a", 1.0, "staging", "ingest", None, False, None), ("b", 2.0, "queued", "train", None, False, None), ("c", 3.0, "queued", "ingest", None, False, None), ("d", 0.5, "queued", "ingest", None, True, None), ("e", 0.1, "running", "train", "ingest", False, 0.0), ("f", 0.1, "running", "train", "train", False, None)]
    df = spark.createDataFrame(rows, "job_id string, created_at double, status string, next_stage string, current_stage string, cancel_requested boolean, heartbeat double").withColumn("worker_id", F.lit("w"))
    assert rows_of(jobs.claim_next(df, ["io", "gpu"]), "lane", "job_id") == [("gpu", "b"), ("io", "c")] and rows_of(jobs.claim_next(df, ["gpu"]), "job_id") == [("b",)]
    assert rows_of(jobs.stale(df, F.lit(3600.0), 60), "job_id") == [("e",), ("f",)]
    back = {r["job_id"]: r for r in jobs.requeued(df, F.lit(3600.0), 60).collect()}
    assert (back["e"]["status"], back["e"]["next_stage"], back["e"]["worker_id"]) == ("queued", "ingest", None) and back["b"]["worker_id"] == "w"


def test_devices(spark):
    t = "Available:\n  Vulkan0: AMD Radeon(TM) Graphics (16000 MiB, 1 free)\n  Vulkan1: NVIDIA X (11997 MiB, 1 MiB free)\nodd line"
    df = spark.createDataFrame([("two", t), ("one", "  CPU0: Thing (1 MiB)")], "host string, text string")
    found = jobs.devices(df)
    assert found.count() == 3 and rows_of(jobs.best_device(found), "host", "id") == [("two", "Vulkan1")]


def test_small_job_functions(spark):
    m = F.create_map(F.lit("ingest"), F.lit("done"), F.lit("generate"), F.lit("failed"))
    row = spark.range(1).select(
        jobs.first_unfinished(m).alias("f"), jobs.package_progress(F.lit("quantize"), F.lit(0.5)).alias("p"), jobs.backoff(F.lit(3), 2.0, 10.0).alias("b"), jobs.valid_job_id(F.lit("0123456789ab")).alias("v"), F.size(jobs.job_view(m)).alias("n")
    ).first()
    assert (row["f"], row["b"], row["v"], row["n"]) == ("generate", 10.0, True, 6) and row["p"] == pytest.approx(0.75)
    files = spark.createDataFrame([("r", 1, "a"), ("r", 1, "b"), ("r", 2, "a")], "run string, step int, name string")
    assert rows_of(jobs.complete_checkpoints(files, ["a", "b"]), "run", "step") == [("r", 1)]
    assert [r[0] for r in jobs.jobs_by_ids(spark.createDataFrame([("x", None), ("y", "z"), ("w", None)], "job_id string, replaced_by string"), ["w", "x", "w", "y"]).select("job_id").collect()] == ["w", "x"]
