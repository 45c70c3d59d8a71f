"""Near-duplicate lines by a segment-partition edit join.

Two different lines are near duplicates if their edit distance is at most ``allowed(length of the
shorter)``. A line of allowance t is cut into t + 1 segments; t edits leave one of them whole, so
a near line of the same or a little greater length holds that segment at a nearby place. Every
line indexes its segments under (length, which segment, content) and probes the substrings of
itself that could match a segment of a line of each length, at the places that the multi-match
rule leaves. Segments and substrings are hashed from prefix sums, a batch of texts at a time.

Keys under which an index and a probe of different lines meet keep their members. Members
get their lines back and are verified in the order of first occurrence, with a histogram bound
and then a banded bit-parallel edit distance. A line needs one earlier near line to be dropped, so
a verified group gives at most one row for each member, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import NUMBER_ROWS, stored
from lectern.llm.shingles import _power, mix

CHARS_PER_EDIT = 10
GROWTH = 8
_NOT_BLANK = "[^\\x09-\\x0D ]"


def shortest(edits: int) -> int:
    """The length from which a line is allowed ``edits`` edits: 10 and 20 for the first two, then
    ``GROWTH`` times their cube. A line of t edits needs about t ** 3 / 3 probes, so that probes stay in
    proportion to the characters of long lines too."""
    return CHARS_PER_EDIT * edits if edits < 3 else GROWTH * edits**3


def allowances(length: np.ndarray) -> np.ndarray:
    """``allowed`` of many lengths."""
    steps = [shortest(1)]
    while steps[-1] <= int(length.max(initial=0)):
        steps.append(shortest(len(steps) + 1))
    return np.searchsorted(np.array(steps), length, side="right")


def allowed(length: int) -> int:
    """Edits that a pair may have whose shorter line has ``length`` characters."""
    return int(allowances(np.array([length]))[0])


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most``: common ends are cut off, and
    the middle goes through a band of 2 * most + 1 diagonals kept as bits of one number."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:  # longest common beginning, by halving
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b, n = a[lo:], b[lo:], n - lo
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if len(a) > len(b):
        a, b = b, a
    if len(b) <= most or not a:
        return len(b) <= most
    # reach[e]: bit d is set if row i of a and column i + d - most of b can be reached with e edits
    width = 2 * most + 1
    full = (1 << width) - 1
    reach = [0] * (most + 1)
    for e in range(most + 1):
        reach[e] = sum(1 << (most + d) for d in range(e + 1))
    places: dict[str, int] = {}  # of each character of b, up to the end of the band
    for j, c in enumerate(b[:most]):
        places[c] = places.get(c, 0) | 1 << j
    for i, c in enumerate(a):
        if i + most < len(b):
            ahead = b[i + most]
            places[ahead] = places.get(ahead, 0) | 1 << (i + most)
        at = places.get(c, 0)
        same = (at >> (i - most) if i >= most else at << (most - i)) & full
        new = []
        for e in range(most + 1):
            bits = reach[e] & same  # equal characters: same diagonal
            if e:
                bits |= reach[e - 1] | (reach[e - 1] >> 1)  # replaced; left out of b
                bits |= new[e - 1] << 1  # put into b
            new.append(bits & full)
        reach = new
        if not reach[most]:
            return False
    end = most + len(b) - len(a)
    return any(r >> end & 1 for r in reach)


@cache
def _pieces(edits: int, again: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(how much longer the line is than the lines it looks for, segment, shift, is a probe) of all keys of a
    line: its own segments, and the substrings that the multi-match rule leaves; without ``again``, only those
    that are not its own segments (which may stand for both)."""
    own = [(0, i, 0, False) for i in range(edits + 1)]
    probes = [
        (longer, i, shift, True)
        for longer in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, longer - (edits - i)), min(i, longer + (edits - i)) + 1)
        if again or longer or shift
    ]
    longer, segment, shift, probe = (np.array(x) for x in zip(*own, *probes, strict=True))
    return longer, segment, shift, probe


def segment_keys(texts: list[str], seen: set[int], again: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line hash, is a probe) of all lines of ``texts`` whose hashes are not in ``seen`` yet; without
    ``again``, no probes that are a line's own segments."""
    lines, hashes = [], []
    for t in texts:
        for line in t.split("\n"):
            if len(line) >= CHARS_PER_EDIT:
                h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                if h not in seen:
                    seen.add(h)
                    lines.append(line)
                    hashes.append(h)
    none = np.zeros(0, dtype=np.int64)
    if not lines:
        return none, none, np.zeros(0, dtype=bool)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    start = np.cumsum(length) - length
    names = np.array(hashes, dtype=np.uint64).view(np.int64)
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _power("up", len(chars)), out=sums[1:])
    down = _power("down", len(chars) + 1)
    space = np.zeros(len(chars) + 1, dtype=np.int64)
    np.cumsum((chars == 32) | ((chars >= 9) & (chars <= 13)), out=space[1:])
    solid = space[start + length] - space[start] < length
    keys, owners, probes = [], [], []

    most = allowances(length)
    fewer = allowances(length - most)  # lengths of allowances lie further apart than edits reach
    for edits in np.unique(np.concatenate([most, fewer])).tolist():
        if not edits:
            continue
        longer, segment, shift, probe = _pieces(edits, again)
        rows = np.flatnonzero(solid & ((most == edits) | (fewer == edits)))
        step = max(1, 1_000_000 // len(longer))
        for some in (rows[k : k + step] for k in range(0, len(rows), step)):
            short = length[some][:, None] - longer
            base, more = np.divmod(short, edits + 1)
            size = base + (edits + 1 - segment <= more)  # the last segments take the remainder
            place = segment * base + np.maximum(0, segment - (edits + 1 - more)) + shift
            ok = (short >= shortest(edits)) & (short < shortest(edits + 1)) & (place >= 0) & (place + size <= length[some][:, None])
            which, piece = np.nonzero(ok)
            at = start[some][which] + place[ok]
            content = (sums[at + size[ok]] - sums[at]) * down[at]
            tag = (short[ok].astype(np.uint64) << np.uint64(20)) + segment[piece].astype(np.uint64)
            keys.append(mix(mix(content) ^ mix(tag)).view(np.int64))
            owners.append(names[some][which])
            probes.append(probe[piece])
    if not keys:
        return none, none, np.zeros(0, dtype=bool)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(probes)


def _once(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of (key, line), in order."""
    by = np.lexsort((h, k))
    k, h = k[by], h[by]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])[: len(k)]
    return k[new], h[new]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of keys under which an index meets a probe of another line. Rows (key, line) come in
    the order of keys, lines of one key in any order; the lowest bit of a key says that it is a probe's only.
    Keeps what the last key of a batch has for the next one."""
    k, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone = 0  # different rows kept of that key, when last counted

    def close(k: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        name = k >> 1
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(first, len(k)))
        several = np.logical_or.reduceat(h != np.repeat(h[first], size), first)
        ok = np.repeat(several & (k[first] & 1 == 0), size)  # a key's indexes, which probe too, come first
        return pa.RecordBatch.from_arrays([pa.array(v) for v in _once(name[ok], h[ok])], ["key", "line"])

    for batch in batches:
        k, h = (np.concatenate([v, batch.column(i).to_numpy()]) for i, v in enumerate((k, h)))
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1] & ~1))
        if last:
            yield close(k[:last], h[:last])
            k, h, alone = k[last:], h[last:], 0
        # a line comes from each task that reads it
        if len(k) > 2 * alone + (1 << 16):
            k, h = _once(k, h)
            alone = len(k)
    if len(k):
        yield close(k, h)


def _meeting(docs: DataFrame, text: str) -> DataFrame:
    """(key, line): the members of all keys under which an index meets a probe of another line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                k, h, p = segment_keys([t for t in batch.column(0).slice(a, 128).to_pylist() if t], seen, again=False)
                if len(seen) > 2_000_000:
                    seen.clear()  # lines may then be sent again; equal members fall together below
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array((k & ~1) | p), pa.array(h)], ["key", "line"])

    keyed = docs.select(F.col(text)).mapInArrow(emit, "key long, line long")
    # one number to sort by, which Spark sorts by its digits
    return keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(_meet, "key long, line long")


def _near_lines(members: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that have an earlier near line. ``lines``: h1, h2, line, first."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
            found = []
            bins = np.zeros((len(rows), 32), dtype=np.int16)
            size = np.array([len(r[3]) for r in rows])
            most = allowances(size)
            for i, r in enumerate(rows):
                chars = np.frombuffer(r[3].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                bins[i] = np.minimum(np.bincount(chars & 31, minlength=32), 30_000)
                if i:
                    edits = np.minimum(most[:i], most[i])  # each edit moves two counts at most
                    near = np.flatnonzero((np.abs(size[:i] - size[i]) <= edits) & (np.abs(bins[:i] - bins[i]).sum(axis=1) <= 2 * edits))
                    if any(within(rows[j][3], r[3], int(edits[j])) for j in near.tolist()):
                        found.append((r[1], r[2]))
            return found

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["h1", "h2"])

        held: list[tuple[int, int, int, str]] = []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += close(held)
                    held = []
                held.append(row)
            if len(out) > 1000:
                yield batch_of(out)
                out = []
        out += close(held)
        yield batch_of(out)

    placed = members.join(lines, F.col("line") == F.col("h1")).select("key", "h1", "h2", F.col("body"), "first")
    ordered = placed.repartition("key").sortWithinPartitions("key", "first", "h1", "h2").drop("first")
    return ordered.mapInArrow(verify, "h1 long, h2 long").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedupe_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", broadcast_rows: int = 500_000) -> DataFrame:
    """Drop every line that repeats an earlier one, exactly or within ``allowed`` edits: one from 10
    characters, two from 20, three from 216, and t from 8 * t ** 3.

    Lines are what newlines separate; order is that of ids (null last; then of the text's hash) and
    of places in a text. Of equal lines the first occurrence stays. A line is also dropped, with
    all its occurrences, if a near line (by ``allowed`` of the shorter one's length) first occurs
    earlier; that near line may itself be dropped for another one. Blank lines are always kept.

    Returns the columns of ``docs`` with ``text`` replaced by the lines kept, and ``lines``,
    ``exact`` and ``near`` (lines dropped as repeats and as near repeats), ``chars`` and
    ``kept_chars`` (characters in lines that are not blank, and in those kept); columns of ``docs``
    with these names are replaced. A null text stays null with no lines; an empty one has one
    blank line. Rows that repeat an id and a text are the same document: each keeps what the
    first keeps. Very long lines are compared whole. Empty input: no rows.
    """
    added = ("lines", "exact", "near", "chars", "kept_chars")
    own = [c for c in docs.columns if c.lower() not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    ident = [F.coalesce(F.col(row_id).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.col(row_id).isNull().alias("_null"), F.xxhash64(F.col(text)).alias("_th")]
    h1, h2 = F.xxhash64("body"), F.xxhash64(F.lit("second"), "body")
    split = docs.select(*ident, F.posexplode(_split(F.col(text))).alias("pos", "body")).where(F.col("body").rlike(_NOT_BLANK))
    order = F.struct("_null", "_id", "_th", "pos")
    occurrences, _ = stored(split.select("_id", "_null", "_th", "pos", h1.alias("h1"), h2.alias("h2")), "line-places")
    firsts, _ = stored(occurrences.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")), "line-firsts")
    members, _ = stored(_meeting(docs, text), "line-members", NUMBER_ROWS)
    wanted = _small(members.select(F.col("line").alias("h1")).distinct(), broadcast_rows)  # 8 bytes a row
    bodies = split.select(h1.alias("h1"), h2.alias("h2"), "body").join(wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.first("body").alias("body"))
    lines = bodies.join(firsts.select("h1", "h2", "first"), ["h1", "h2"])
    near, _ = stored(_near_lines(members, lines), "line-near")
    # only lines that occur twice or are near another can lose an occurrence
    marked = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where(F.col("near") | (F.col("first") != F.col("last")))
    marked, _ = stored(marked.select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-marked")
    lost = occurrences.join(marked, ["h1", "h2"]).where(F.col("near") | (order != F.col("first")))
    per_doc, _ = stored(
        lost.groupBy("_id", "_null", "_th").agg(
            F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("_near"), F.collect_set(F.when(~F.col("near"), F.col("pos"))).alias("_exact")
        ),
        "line-lost",
    )
    keyed = docs.select("*", *ident).join(per_doc, ["_id", "_null", "_th"], "left")
    gone = F.concat(F.coalesce("_near", F.array().cast("array<int>")), F.coalesce("_exact", F.array().cast("array<int>")))
    parts = _split(F.col(text))
    kept = F.when(F.size("_gone") == 0, parts).otherwise(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)))
    count = lambda lines: F.aggregate(
        lines, F.lit(0).cast("long"), lambda n, x: n + F.when(x.rlike(_NOT_BLANK), F.length(x)).otherwise(0)
    )
    whole = F.size("_gone") == 0
    built = keyed.withColumn("_gone", gone).withColumn("_kept", kept).withColumn("chars", count(parts))
    return built.select(
        *[F.when(whole | F.col(text).isNull(), F.col(text)).otherwise(F.concat_ws("\n", "_kept")).alias(text) if c == text else F.col(f"`{c}`") for c in own],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).alias("lines"),
        F.coalesce(F.size("_exact"), F.lit(0)).alias("exact"),
        F.coalesce(F.size("_near"), F.lit(0)).alias("near"),
        "chars",
        F.when(whole, F.col("chars")).otherwise(count(F.col("_kept"))).alias("kept_chars"),
    )
