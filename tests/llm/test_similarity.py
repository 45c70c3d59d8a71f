import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import blocks, passages
from lectern.llm.components import components
from lectern.llm.jaccard import jaccard_join, runs_for
from lectern.llm.lines import _meet, _meeting, allowed, dedupe_lines, segment_keys, within
from lectern.llm.passages import Sequence, _highest, _in_order, _sequence, _sequences, _several, common_stretches, compact_windows, near_stretches, rare_shingles, repeated_passages
from lectern.llm.shingles import MinHasher, mix, set_overlaps, shingle_set, word_hashes

SCHEMA = "doc_id long, text string, sig int, line string, lines long, key int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", None, 7) for r in rows], SCHEMA).repartition(parts)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


# --- shingles ---------------------------------------------------------------------------------


@given(st.text(alphabet="ab \t\nÉéİ\x85\xa0", max_size=40))
def test_words_are_runs_without_ascii_space(text):
    data = text.lower().encode()
    hashes, starts, ends = word_hashes(text)
    found = [data[s:e] for s, e in zip(starts, ends, strict=True)]
    assert found == data.split()
    assert len(set(hashes.tolist())) == len(set(found))


def test_word_hash_does_not_depend_on_place():
    a, b = word_hashes("one two three"), word_hashes("zero  two\nten one")
    assert a[0][1] == b[0][1] and a[0][0] == b[0][3] and a[0][2] != b[0][0]


def test_min_hashes_estimate_jaccard():
    rng = random.Random(0)
    w = words(rng, 400)
    other = w[:]
    for i in range(0, 400, 60):
        other[i] = "changed"
    x, y = shingle_set(" ".join(w)), shingle_set(" ".join(other))
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    hasher = MinHasher(1024)
    assert abs((hasher(x) == hasher(y)).mean() - exact) < 0.06
    assert set_overlaps([x, y], [y], columns=50)[:, 0].tolist() == [len(np.intersect1d(x, y)), len(y)]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_few_edges_are_settled_at_once(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(330)] + [(2000 + i, 2001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(2)
    context = spark.sparkContext
    context.setJobGroup("few-edges", "few-edges")
    few = components(df)
    jobs = len(context.statusTracker().getJobIdsForGroup("few-edges"))
    context.setLocalProperty("spark.jobGroup.id", None)
    rounds = components(df, few=0)
    assert sorted(few.collect()) == sorted(rounds.collect())
    assert jobs <= 6  # not some per round: a path of 300 edges takes many
    assert components(df.where("a > 9999")).collect() == []


# --- Jaccard join -----------------------------------------------------------------------------


def brute_jaccard(rows, threshold):
    sets = {}
    for i, text in rows:
        s = frozenset(shingles(text))
        if s:
            sets.setdefault(s, []).append(i)
    reps = list(sets)
    root, links = list(range(len(reps))), [0] * len(reps)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(reps)):
        for j in range(i):
            k = len(reps[i] & reps[j])
            if k and k >= threshold * (len(reps[i]) + len(reps[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    classes = {}
    for i, s in enumerate(reps):
        classes.setdefault(find(i), []).extend(sets[s])
    out = []
    for i, text in rows:
        s = frozenset(shingles(text))
        if not s:
            out.append((i, i, i, 1, 0))
        else:
            k = reps.index(s)
            out.append((i, low(classes[find(k)]), low(sets[s]), len(sets[s]), links[k]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(40):
        base = words(rng, rng.randint(30, 160))
        for _ in range(rng.randint(1, 4)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(99)
            rows.append((n, " ".join(copy)))
            n += 1
    hot = words(rng, 120)
    for k in range(90):  # a large group of near copies, and one of exact copies
        copy = hot[:]
        copy[k] = f"own{k}"
        rows.append((n + k, " ".join(copy)))
    n += 90
    rows += [(n + k, "the same text in every one of these rows again and again") for k in range(70)]
    n += 70
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "two words"), (n + 4, "Two  WORDS"), (None, "two words"), (None, None), (5, rows[5][1]), (6, "another text under an id seen before")]
    return rows


@pytest.mark.parametrize("leaf_rows,block_rows", [(64, 1024), (4, 16)])
def test_jaccard_join_equals_brute_force(spark, near_copies, leaf_rows, block_rows):
    got = jaccard_join(frame(spark, near_copies), leaf_rows=leaf_rows, block_rows=block_rows, broadcast_rows=0 if leaf_rows == 4 else 10**6)
    got = sorted([tuple(r) for r in got.select("doc_id", "class_id", "copy_of", "copies", "links").collect()], key=repr)
    assert got == brute_jaccard(near_copies, 0.8)


def test_jaccard_join_of_little(spark):
    assert jaccard_join(frame(spark, [])).count() == 0
    got = jaccard_join(frame(spark, [(1, None), (2, "")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["links"]) for r in got) == [(1, 1, 0), (2, 2, 0)]


def test_more_depth_needs_more_runs():
    assert 1 <= runs_for(0.8, 1, 0.99) <= runs_for(0.8, 4, 0.99) <= runs_for(0.8, 4, 0.9999)


# --- lines ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=24), st.text("abc", max_size=24), st.integers(0, 7))
def test_band_decides_as_the_whole_table_does(a, b, most):
    assert within(a, b, most) == (distance(a, b) <= most)


def brute_lines(rows):
    blank = lambda x: not x.strip(" \t\n\r\x0b\x0c")
    first = {}
    for i, text in sorted({(i, t) for i, t in rows if t is not None}):
        for p, line in enumerate(text.split("\n")):
            if not blank(line):
                first.setdefault(line, (i, p))
    near = set()
    for a in first:
        for b in first:
            if first[b] < first[a]:
                most = allowed(min(len(a), len(b)))
                if most and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                    near.add(a)
                    break
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0, 0))
            continue
        lines = text.split("\n")
        n = [p for p, x in enumerate(lines) if x in near]
        e = [p for p, x in enumerate(lines) if not blank(x) and x not in near and first[x] != (i, p)]
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in n and p not in e), len(lines), len(e), len(n)))
    return sorted(out, key=repr)


def edited(rng, line):
    for _ in range(rng.randint(0, min(3, 1 + allowed(len(line)))) if len(line) < 200 else rng.choice([0, 1, allowed(len(line)), allowed(len(line)) + 1])):
        k, at = rng.randrange(3), rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice("xyzé ") + line[at:] if k == 0 else line[:at] + line[at + 1 :] if k == 1 else line[:at] + rng.choice("xyz") + line[at + 1 :]
    return line


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([3, 9, 10, 11, 19, 20, 21, 22, 40, 90]))) for _ in range(60)]
    rows = []
    for i in range(70):
        rows.append((i, "\n".join(edited(rng, rng.choice(pool)) for _ in range(rng.randint(1, 7))) + rng.choice(["", "\n", "\n\n \n"])))
    rows += [(100 + i, "a line that every one of these has\n" + pool[i % 5]) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, " " * 30), (204, "x" * 1500 + "\n" + "x" * 1499 + "y")]
    got = dedupe_lines(frame(spark, rows)).select("doc_id", "text", "lines", "exact", "near").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_allowances_grow_with_length():
    assert [allowed(n) for n in (0, 9, 10, 19, 20, 215, 216, 511, 512, 1000, 8000, 10**6)] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 10, 50]


def test_lines_within_their_allowance_share_a_segment():
    rng = random.Random(12)
    for n in [10, 20, 30, 214, 215, 216, 217, 511, 512, 515, 999, 1000, 1003, 1731, 8004] * 6:
        a = "".join(rng.choice("abcdefgh é") for _ in range(n))
        b = a
        for _ in range(allowed(n)):
            k, at = rng.randrange(3), rng.randrange(len(b) + 1)
            b = b[:at] + (rng.choice("xyz") if k else "") + b[at + (k < 2) :]
        most = allowed(min(len(a), len(b)))
        if a == b or abs(len(a) - len(b)) > most or not within(a, b, most):
            continue
        (ka, _, pa), (kb, _, pb) = (segment_keys([x], set()) for x in (a, b))
        assert set(ka[~pa]) & set(kb[pb]) or set(ka[pa]) & set(kb[~pb]), (n, a, b)


def test_line_dedup_of_long_lines_with_a_changed_word(spark):
    rng = random.Random(14)
    lines = [" ".join(words(rng, n, 10_000)) for n in (40, 45, 80)]
    changed = [x[: len(x) // 2] + "abc" + x[len(x) // 2 + 3 :] for x in lines]
    rows = [(1, "\n".join(lines)), (2, "\n".join(changed))]
    rows += [(3 + i, "\n".join(edited(rng, rng.choice(lines)) for _ in range(3))) for i in range(8)]
    got = dedupe_lines(frame(spark, rows)).select("doc_id", "text", "lines", "exact", "near").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    assert {r["doc_id"]: r["near"] for r in got}[2] == 3


def test_line_dedup_keeps_other_columns_and_nulls(spark):
    rows = [(None, "the same line in two rows of null id"), (None, "the same line in two rows of null id"), (1, "the same line in two rows of null id")]
    got = dedupe_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "sig", "line", "key", "lines", "exact", "near", "chars", "kept_chars"]
    kept = sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=repr)
    assert kept == [(1, "the same line in two rows of null id"), (None, ""), (None, "")]
    assert dedupe_lines(frame(spark, [])).count() == 0


def test_line_keys_are_sorted_by_one_number_and_sent_once(spark):
    texts = ["a line of some words that is looked for", "another one", "x" * 300]
    rows = list(enumerate(texts))
    met = _meeting(frame(spark, rows), "text")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[key#\d+L ASC NULLS FIRST\]", plan), plan
    all_keys, fewer = (segment_keys(texts, set(), again=again) for again in (True, False))
    own = ~all_keys[2]
    assert set(fewer[0]) == set(all_keys[0]) and len(fewer[0]) == len(all_keys[0]) - own.sum()


def test_lines_meet_whatever_their_order_and_batches():
    rng = random.Random(15)
    for size in (1, 3, 7, 1000):
        rows = [(rng.randrange(40) << 1 | (rng.random() < 0.8), rng.randrange(6)) for _ in range(300)]
        rows += [(99 << 1, 3)] * 5 + [(98 << 1 | 1, x) for x in range(4)]
        rows.sort(key=lambda r: r[0])
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*b)], ["key", "line"]) for b in cut]
        got = [r for b in _meet(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
        groups = {}
        for k, h in rows:
            groups.setdefault(k >> 1, []).append((k & 1, h))
        wanted = {(k, h) for k, g in groups.items() if len({x for _, x in g}) > 1 and min(g)[0] == 0 for _, h in g}
        assert len(got) == len(set(got)) and set(got) == wanted
    assert list(_meet(iter([]))) == []


# --- passages ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80), st.integers(1, 9))
def test_compact_windows_cover_each_subsequence_once(values, window):
    h = np.array(values, dtype=np.uint64) << np.uint64(40)
    left, centre, right = compact_windows(h, window)
    for i in range(len(values)):
        for j in range(i + window - 1, len(values)):
            holds = [int(c) for l, c, r in zip(left, centre, right, strict=True) if l <= i <= c <= j <= r]
            assert len(holds) == 1 and values[holds[0]] == min(values[i : j + 1])


def test_windows_and_shingles_of_many_texts_are_those_of_each():
    rng = random.Random(6)
    texts = ["", "one", *(" ".join(words(rng, rng.randint(0, 90), 50)) + rng.choice(["", "\n", " "]) for _ in range(40)), " \n "]
    x, ends = _sequences(texts, 5)
    parts = np.split(x, ends[:-1])
    got = compact_windows(mix(x), 9, ends)
    at = 0
    wanted = [[], [], []]
    for t, part in zip(texts, parts, strict=True):
        assert part.tolist() == _sequence(t, 5).tolist()
        for w, v in zip(wanted, compact_windows(mix(part), 9), strict=True):
            w += (v + at).tolist()
        at += len(part)
    assert list(map(len, got)) == list(map(len, wanted)) and sorted(got[1].tolist()) == sorted(wanted[1])


def test_texts_that_differ_little_share_one_of_their_rarest_shingles():
    rng = np.random.default_rng(8)
    for _ in range(200):
        notice = rng.integers(0, 2**63, 30, dtype=np.uint64)
        around = rng.integers(0, 2**63, 60, dtype=np.uint64)
        near = np.concatenate([around[:8], notice, around[8:]])
        other = near.copy()
        at = rng.integers(0, 46)
        other[at : at + 5] = rng.integers(0, 2**63, 5, dtype=np.uint64)
        count = lambda x: np.where(np.isin(x, notice), 50, np.where(np.isin(x, near) & np.isin(x, other), 2, 1))
        a, b = (rare_shingles(x, count(x), np.array([20]), 46, 0.8) for x in (near, other))
        assert set(near[a].tolist()) & set(other[b].tolist())
        assert not len(rare_shingles(near, np.ones(90, np.int64), np.array([20]), 46, 0.8))


def test_a_text_of_one_shingle_has_few_windows():
    assert len(compact_windows(np.zeros(20_000, dtype=np.uint64), 46)[0]) < 2000


def passage_rows():
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randint(20, 300), 100_000))) for i in range(60)]
    passage, short = words(rng, 55, 100_000), words(rng, 40, 100_000)
    for i in range(100, 140):  # one passage in many texts; a shorter one is none
        rows.append((i, " ".join([*words(rng, rng.randint(0, 90), 100_000), *passage, *words(rng, 30, 100_000)])))
    for i in range(200, 206):
        rows.append((i, " ".join([*words(rng, 30, 100_000), *short, *words(rng, 30, 100_000)])))
    near = words(rng, 200, 100_000)
    changed = near[:]
    changed[100] = "changed"
    rows += [(300, " ".join(near)), (301, " ".join([*words(rng, 20, 100_000), *changed]))]
    whole = " ".join(words(rng, 80, 100_000))
    rows += [(400, whole), (401, whole), (402, whole), (None, whole)]
    rows += [(500, None), (501, ""), (502, "again " * 3000), (503, "again " * 3000 + "end"), (504, " ".join(words(rng, 30_000, 10**6)))]
    return rows


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_repeated_passages_are_found_and_others_left_alone(spark, broadcast_rows):
    rows = passage_rows()
    got = repeated_passages(frame(spark, rows), broadcast_rows=broadcast_rows).collect()
    where = {}
    for r in got:
        where.setdefault(r["doc_id"], []).append(r)
    text = {i: t.lower().split() for i, t in rows if t}
    grams = {}
    for i, w in text.items():
        for k in range(len(w) - 49):
            grams.setdefault(tuple(w[k : k + 50]), set()).add(i)
    for i, w in text.items():
        for k in range(len(w) - 49):
            if len(grams[tuple(w[k : k + 50])]) > 1:
                assert any(r["start_word"] <= k and k + 50 <= r["end_word"] for r in where[i]), (i, k)
    clean = set(range(60)) | set(range(200, 206)) | {500, 501, 504}
    assert not clean & set(where)
    assert {r["class_id"] for i in range(100, 140) for r in where[i]} == {100}
    assert {r["kind"] for i in (400, 401, 402, None) for r in where[i]} == {"copy"}
    span = where[300][0]
    assert span["end_word"] - span["start_word"] >= 195 and span["other_id"] == 301


def near_passage_rows(rng, n, first):
    """Pairs of texts with a passage of 50 to 60 words, one of them changed at any place of it;
    the parts' shingles have a similarity of 0.8 to 0.9."""
    rows = []
    for k in range(n):
        passage = words(rng, rng.randint(50, 60), 10**6)
        changed = passage[:]
        changed[rng.randrange(len(passage))] = f"changed{k}"
        for i, part in ((0, passage), (1, changed)):
            rows.append((first + 2 * k + i, " ".join([*words(rng, rng.randint(10, 60), 10**6), *part, *words(rng, rng.randint(10, 60), 10**6)])))
    return rows


def test_near_passages_of_fifty_to_sixty_words_are_found(spark):
    n = 400
    rows = near_passage_rows(random.Random(21), n, 0)
    got = repeated_passages(frame(spark, rows)).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    assert all(a // 2 == b // 2 for a, b in found)
    recall = sum((2 * k, 2 * k + 1) in found and (2 * k + 1, 2 * k) in found for k in range(n)) / n
    assert recall >= 0.98, recall
    assert all(r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8 for r in got)


@pytest.mark.parametrize("size,edits", [(50, 1), (60, 1), (80, 1), (100, 2), (150, 3), (200, 4)])
def test_near_passages_of_any_length_are_found(spark, size, edits):
    rng = random.Random(100 + size)
    n, rows, near = 150, [], []
    for k in range(n):
        passage = words(rng, size, 10**6)
        changed = passage[:]
        for at in rng.sample(range(size), edits):
            changed[at] = f"changed{k}"
        x, y = shingles(" ".join(passage)), shingles(" ".join(changed))
        near.append(len(x & y) >= 0.8 * len(x | y))
        for i, part in ((0, passage), (1, changed)):
            rows.append((2 * k + i, " ".join([*words(rng, rng.randint(10, 60), 10**6), *part, *words(rng, rng.randint(10, 60), 10**6)])))
    found = {(r["doc_id"], r["other_id"]) for r in repeated_passages(frame(spark, rows)).collect()}
    assert all(a // 2 == b // 2 for a, b in found)
    hits = [(2 * k, 2 * k + 1) in found for k in range(n) if near[k]]
    assert len(hits) > 100 and sum(hits) / len(hits) >= 0.95, sum(hits) / len(hits)


def test_near_pairs_among_members_that_are_not_near_their_leader(spark):
    rng = random.Random(77)
    base, rows = words(rng, 60, 10**6), []
    n = 40
    for k in range(n):  # all are 0.6 alike to the base or so; the two of a pair are near each other
        part = base[:]
        for at in (8 + k % 5, 30 + k % 7, 52 - k % 5):
            part[at] = f"slot{k}x{at}"
        for i in (0, 1):
            own = part[:]
            own[(20 if i else 41)] = f"own{k}x{i}" if i else own[41]
            rows.append((2 * k + i, " ".join([*words(rng, 30 + i, 10**6), *own, *words(rng, 30, 10**6)])))
    rows.append((1000, " ".join(base)))
    got = repeated_passages(frame(spark, rows)).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    text = {i: shingles(" ".join(t.split()[30 + i % 2 : 90 + i % 2])) for i, t in rows if i < 1000}
    pairs = [(2 * k, 2 * k + 1) for k in range(n) if len(text[2 * k] & text[2 * k + 1]) >= 0.8 * len(text[2 * k] | text[2 * k + 1])]
    assert len(pairs) > 30
    assert sum(a in {x for x, _ in found} and b in {x for x, _ in found} for a, b in pairs) >= 0.95 * len(pairs)


def test_common_stretches_with_a_change_at_any_place():
    rng = np.random.default_rng(5)
    for size in (46, 56):
        for at in range(size - 4):
            passage = rng.integers(0, 2**63, size, dtype=np.uint64)
            changed = passage.copy()
            changed[at : at + 5] = rng.integers(0, 2**63, 5, dtype=np.uint64)
            a, b = (np.concatenate([rng.integers(0, 2**63, 30, dtype=np.uint64), x, rng.integers(0, 2**63, 30, dtype=np.uint64)]) for x in (passage, changed))
            got = common_stretches(a, b, 46, 0.8)
            assert len(got) == 1 and got[0][1] - got[0][0] >= 46 and got[0][4] >= 0.8, (size, at, got)
            assert got[0][0] == got[0][2]


def test_hashes_of_equal_upper_bits_are_in_order():
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 9, 50), rng.integers(0, 1 << 63, 700), np.full(3, 7), np.zeros(0), np.array([1, 1 << 63, 0, 1])):
        x = x.astype(np.uint64)
        assert _in_order(x).tolist() == np.argsort(x, kind="stable").tolist()


def test_similarity_of_stretches_counts_each_repeated_shingle_once():
    rng = np.random.default_rng(6)
    met = 0
    for n in range(200):
        a = rng.integers(0, (30, 10**9)[n % 2], 120).astype(np.uint64)
        b = a.copy()
        b[rng.integers(0, 120, 4)] = rng.integers(0, 40, 4).astype(np.uint64)
        b = np.concatenate([b[:60], a[20:40], b[60:]]) if n % 3 else b
        for x, y in ((a, b), (b, a)):
            found = common_stretches(Sequence(x), Sequence(y), 46, 0.8)
            met += len(found)
            for s, e, u, v, j in found:
                p, q = set(x[s:e].tolist()), set(y[u:v].tolist())
                assert j == len(p & q) / len(p | q)
    assert met > 200


def test_every_place_of_a_passage_is_reported(spark):
    rng = random.Random(31)
    rows, places = [], {}
    for k in range(20):  # once in one text, three times in the other; hashes come in either order
        passage = words(rng, 60, 10**6)
        rows.append((2 * k, " ".join([*words(rng, 20, 10**6), *passage, *words(rng, 20, 10**6)])))
        text = []
        for _ in range(3):
            text += words(rng, 30, 10**6)
            places.setdefault(2 * k + 1, []).append(len(text))
            text += passage
        rows.append((2 * k + 1, " ".join([*text, *words(rng, 30, 10**6)])))
        places[2 * k] = [20]
    got = repeated_passages(frame(spark, rows)).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    for i, starts in places.items():
        assert sorted(found[i]) == [(s, s + 60) for s in starts], i


def test_pairs_around_a_short_common_notice_are_found(spark):
    rng = random.Random(41)
    notices, rows = [words(rng, 42, 10**6) for _ in range(8)], []
    n = 80
    for k in range(n):  # each pair shares 54 words around a notice of 42 that ten pairs have
        passage = [*words(rng, 6, 10**6), *notices[k % 8], *words(rng, 6, 10**6)]
        for i in (0, 1):
            rows.append((2 * k + i, " ".join([*words(rng, 30, 10**6), *passage, *words(rng, 30, 10**6)])))
    got = repeated_passages(frame(spark, rows), functions=2).collect()  # few functions: the notice alone has the minima
    found = {(r["doc_id"], r["other_id"]) for r in got}
    assert found == {(i, i ^ 1) for i in range(2 * n)}


def test_no_passages_in_nothing(spark):
    assert repeated_passages(frame(spark, [])).count() == 0
    assert repeated_passages(frame(spark, [(1, None), (2, "short")])).count() == 0
    assert zlib.crc32(b"") == 0


def test_texts_that_cannot_be_near_are_settled_without_a_search(monkeypatch):
    rng = np.random.default_rng(5)
    asked = []
    search = common_stretches
    monkeypatch.setattr(passages, "common_stretches", lambda *a: asked.append(a) or search(*a))
    a = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    b = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    b[50:85] = a[20:55]  # 35 of any 46 in common at most: three quarters
    assert near_stretches(Sequence(a), Sequence(b), 46, 0.8) == [] and not asked
    for kinds in (1 << 60, 90, 40):  # without repeats, with some, with many
        for _ in range(150):
            a, b = (rng.integers(0, kinds, int(n), dtype=np.uint64) for n in rng.integers(30, 160, 2))
            n = int(min(len(a), len(b), rng.integers(30, 90)))
            b[len(b) - n :] = a[:n]
            at = rng.integers(0, len(b), int(rng.integers(0, 10)))
            b[at] = rng.integers(0, 1 << 60, len(at), dtype=np.uint64)
            both = {*search(a, b, 46, 0.8)} | {(u, v, s, e, j) for s, e, u, v, j in search(b, a, 46, 0.8)}
            assert near_stretches(Sequence(a), Sequence(b), 46, 0.8) == sorted(both)


def test_highest_of_the_runs_that_hold_a_place():
    rng = np.random.default_rng(3)
    for n in (3, 5, 6, 23, 50):
        least = rng.integers(0, 99, max(0, n - 5 + 1), dtype=np.uint64)
        assert _highest(least, 5, n).tolist() == [max(least[max(0, p - 4) : p + 1].tolist(), default=0) for p in range(n)]


def test_keys_of_several_texts_are_kept_whatever_their_order():
    rows = [(1, 7), (1, 7), (2, 9), (2, 4), (2, 9), (3, 5), (4, 1), (4, 1), (4, 2)]
    for cut in range(1, 9):
        parts = [pa.RecordBatch.from_pydict({"k": [r[0] for r in p], "t": [r[1] for r in p]}) for p in (rows[:cut], rows[cut:])]
        got = [tuple(r.values()) for b in _several(2)(iter(parts)) for r in b.to_pylist()]
        assert got == [r for r in rows if r[0] in (2, 4)]


def test_blocks_bring_the_same_rows_to_the_same_part():
    rng = np.random.default_rng(3)
    rows = [[rng.integers(-(1 << 63), 1 << 63, n), np.arange(n), np.full(n, 7)] for n in (5, 0, 300, 41)]
    dealt = [*blocks.deal(iter(rows), 0, 6, rows=100)]
    assert sum(b.num_rows for b in dealt) <= 2 * 6
    of = {}
    for b in dealt:
        for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for key in np.frombuffer(data.as_py(), dtype=np.int64).reshape(3, -1)[0].tolist():
                assert of.setdefault(key, part) == part
    assert set(of.values()) == set(range(6))
    got = np.concatenate([*blocks.opened(iter(dealt), 3, rows=50)], axis=1)
    assert sorted(map(tuple, got.T.tolist())) == sorted(map(tuple, np.concatenate([np.stack(r) for r in rows], axis=1).T.tolist()))
    assert [*blocks.opened(iter([]), 3)] == [*blocks.deal(iter([]), 0, 6)] == []


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_shared_keys_are_those_of_two_texts_however_rows_come(size):
    rng = np.random.default_rng(size)
    rows = np.stack([rng.integers(-40, 40, 400), rng.integers(-6, 2, 400), rng.integers(0, 3, 400), rng.integers(0, 2, 400)])
    rows[1, rows[0] % 3 == 0] = 5  # these keys have one text
    got = [r for cols in blocks.shared_keys(iter([rows[:, i : i + size] for i in range(0, 400, size)])) for r in zip(*(c.tolist() for c in cols), strict=True)]
    texts = {}
    for k, t, *_ in rows.T.tolist():
        texts.setdefault(k, set()).add(t)
    assert set(got) == {tuple(r) for r in rows.T.tolist() if len(texts[r[0]]) > 1}
    one = np.array([[9], [1], [0], [0]])
    assert [*blocks.shared_keys(iter([one] * 5))] == []


def test_leaders_and_members_of_large_groups_wait_in_files():
    rng = np.random.default_rng(5)
    rows = np.stack([rng.integers(0, 20, 900), rng.integers(-50, 50, 900), rng.integers(3, 6, 900)])
    kept = blocks.Kept(iter(np.split(rows, 30, axis=1)), rows=100)
    assert len(kept.held) == 3 and kept.filed == 27
    assert (np.concatenate([*kept], axis=1) == rows).all() and (np.concatenate([*kept], axis=1) == rows).all()
    wanted = {}
    for k, t, s in rows.T.tolist():
        wanted.setdefault(k, []).append((s, t))
    for k, t, s, low, high, n in blocks.leaders(kept).T.tolist():
        assert (s, t) == min(wanted[k]) and n == len(wanted.pop(k))
        assert low <= t <= high
    assert not wanted
    assert blocks.leaders(iter([])).shape == (6, 0)


def test_passages_send_windows_in_blocks(spark, monkeypatch):
    """Each of some hundred windows a text was a row of exchanges, sorts and tables."""
    rows = passage_rows()
    sent = []
    monkeypatch.setattr(blocks, "exchanged", lambda df, parts, f=blocks.exchanged: sent.append(df) or f(df, parts))
    assert repeated_passages(frame(spark, rows)).count() > 0
    assert len(sent) == 3 and all(d.columns == ["part", "data"] for d in sent)
    assert sent[0].count() <= 3 * blocks.parts_of(sent[0]) * sent[0].rdd.getNumPartitions()
