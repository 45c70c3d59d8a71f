"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a short fixed lexicon, of a lexicon of words and of word beginnings
learned from labels, and of hits that show only after undoing look-alike characters; hits near
second-person words; the densest stretch; capitals, punctuation, digits and obfuscation rates.

Fitting uses a bounded sample of labelled rows (``max_labelled``). The sample is halved: each
half's features use the lexicon learned from the other half, so that chance words do not look
better than they are; scoring uses the lexicon of the whole sample. The isotonic calibration is
fitted on the values that trees give to the quarter of the sample that they have not seen; the
final trees see all of it. All documents are scored on their whole text in one scan without any
exchange.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop, stored

# Common insults and second-person words of four languages.
INSULTS = frozenset(
    """idiot idiots moron morons stupid loser losers pathetic worthless scum trash disgusting clown fool dumb
    imbécile crétin connard salaud débile minable ordure nul
    dummkopf trottel depp abschaum widerlich erbärmlich wertlos
    imbécil tonto estúpido basura asqueroso patético inútil payaso""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch euer
    tú ti tus usted ustedes vosotros""".split()
)
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

FEATURES = (
    "log_words", "fixed", "learned", "beginnings", "undone", "any", "log_hits", "weight", "second_person", "near_second_person",
    "densest", "kinds", "capitals", "all_caps", "exclamations", "questions", "punctuation", "digits", "obfuscated", "stretched",
)
BEGINNINGS = (4, 5, 6, 7)
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_INSIDE = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")

# What one word says, as bits of a code.
_SECOND, _FIXED, _LEARNED, _BEGINS, _UNDONE, _CAPS, _OBFUSCATED, _STRETCH = (1 << i for i in range(8))
_HIT = _FIXED | _LEARNED | _BEGINS | _UNDONE


class _Codes(dict):
    """raw word -> (code << 12 | weight in hundredths), computed once for each distinct word."""

    def __init__(self, words: dict[str, float], begins: dict[str, float]) -> None:
        super().__init__()
        self.words, self.begins = words, begins

    def __missing__(self, raw: str) -> int:
        core = _EDGES.sub("", raw)
        low = core.lower()
        code, weight = 0, 0.0
        if low in SECOND_PERSON:
            code |= _SECOND
        if low in INSULTS:
            code |= _FIXED
        if low in self.words:
            code |= _LEARNED
            weight = self.words[low]
        for n in BEGINNINGS:
            if len(low) > n and low[:n] in self.begins:
                code |= _BEGINS
                weight = max(weight, self.begins[low[:n]])
        if len(core) > 1 and core.isupper():
            code |= _CAPS
        if _INSIDE.search(core) or (core and not low.isalpha() and any(c.isalpha() for c in low) and any(c.isdigit() for c in low)):
            code |= _OBFUSCATED
            if not code & _HIT:
                plain = _NOT_LETTERS.sub("", low.translate(LOOK_ALIKES))
                if plain in INSULTS or plain in self.words:
                    code |= _UNDONE
        if _STRETCHED.search(low):
            code |= _STRETCH
        if len(self) > 300_000:
            self.clear()
        self[raw] = value = code << 12 | min(4095, int(weight * 100))
        return value


def features(text: str, codes: _Codes) -> list[float]:
    """The dense features of one whole text, in the order of ``FEATURES``."""
    raw = text.split()
    n = len(raw)
    letters = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    size = max(1, int(letters.sum()))
    upper, lower = int(letters[65:91].sum()), int(letters[97:123].sum())
    digits = int(letters[48:58].sum())
    punctuation = int(letters[33:48].sum() + letters[58:65].sum() + letters[91:97].sum() + letters[123:127].sum())
    if not n:
        return [0.0] * len(FEATURES)
    found = np.fromiter(map(codes.__getitem__, raw), dtype=np.int64, count=n)
    code = found >> 12
    hit = np.flatnonzero(code & _HIT)
    second = np.flatnonzero(code & _SECOND)
    near = densest = kinds = 0
    if len(hit):
        kinds = len({raw[i].lower() for i in hit.tolist()})
        densest = int((np.searchsorted(hit, hit + 50) - np.arange(len(hit))).max())
        if len(second):
            at = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hit), np.abs(second[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= 5).sum())
    rate = lambda bit: float(np.count_nonzero(code & bit)) / n
    return [
        math.log1p(n), rate(_FIXED), rate(_LEARNED), rate(_BEGINS), rate(_UNDONE), len(hit) / n, math.log1p(len(hit)),
        float((found[hit] & 4095).sum()) / 100 / n, len(second) / n, near / n, float(densest), float(kinds),
        upper / max(1, upper + lower), rate(_CAPS), int(letters[33]) / size, int(letters[63]) / size, punctuation / size, digits / size,
        rate(_OBFUSCATED), rate(_STRETCH),
    ]


class BoostedTrees:
    """Second-order boosting of histogram trees for the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 48, least: int = 8, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="higher")) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        width = self.bins + 1
        p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = math.log(p / (1 - p))
        raw = np.full(n, self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        least = min(self.least, max(1, n // 20))
        flat = binned + np.arange(m) * width
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * least:
                        continue
                    cells = flat[rows].ravel()
                    sums = [np.bincount(cells, np.repeat(v, m), m * width).reshape(m, width) for v in (g[rows], h[rows], np.ones(len(rows)))]
                    gl, hl, nl = (np.cumsum(s, axis=1)[:, :-1] for s in sums)
                    gt, ht, nt = g[rows].sum(), h[rows].sum(), len(rows)
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(nl < least) | (nt - nl < least)] = -1
                    j, b = divmod(int(gain.argmax()), width - 1)
                    if gain[j, b] <= 1e-6 or b >= len(self.cuts[j]):
                        continue
                    feature[k], cut[k] = j, self.cuts[j][b]
                    node[rows] = 2 * k + 1 + (binned[rows, j] > b)
            for k in np.unique(node):
                rows = node == k
                leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            raw += leaf[node]
            self.nodes.append((feature, cut, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.nodes:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean raw value, rate) of each pool, both rising."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # weight, sum of raw, sum of labels
    for r, label in zip(raw[order], y[order], strict=True):
        pools.append([1.0, float(r), float(label)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][0] >= pools[-1][2] / pools[-1][0]:
            w, s, t = pools.pop()
            pools[-1] = [pools[-1][0] + w, pools[-1][1] + s, pools[-1][2] + t]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


class ToxicityModel:
    """Lexicons, trees and calibration; small, and sent to the tasks as it is."""

    def __init__(self, words: dict[str, float], begins: dict[str, float], trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray], rate: float) -> None:
        self.words, self.begins, self.trees, self.knots, self.rate = words, begins, trees, knots, rate

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        raw = self.trees.raw(x)
        # a little of the uncalibrated probability keeps the order inside a flat stretch
        return 0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw))

    def scores(self, texts: list[str | None], codes: _Codes) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.calibrated(np.array([features(t or "", codes) for t in texts]))


def held_out(row_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _learned(counts: pd.DataFrame, toxic: int, clean: int, most: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that toxic texts have far more often than clean ones, with log odds."""
    t, c = counts["toxic"].to_numpy(), counts["clean"].to_numpy()
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    keep = (t >= 3) & (odds >= 2.0)
    best = counts[keep].assign(odds=odds[keep], gain=(t * odds)[keep]).sort_values(["gain", "term"], ascending=[False, True])
    words = best[best["kind"] == 0].head(most)
    begins = best[best["kind"] != 0].head(most)
    return dict(zip(words["term"], words["odds"], strict=True)), dict(zip(begins["term"], begins["odds"], strict=True))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, lexicon: int = 1500, text: str = "text", row_id: str = "doc_id") -> ToxicityModel:
    """Fit on at most ``max_labelled`` labelled rows that are not held out (chosen by hash).

    A doc with several labels is toxic if any is; rows with a null id or label are not used. With
    labels of one kind only, or none, the model returns that kind's rate (0 if none) for all.
    """
    known = (
        labels.where(F.col(row_id).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(row_id)))
        .groupBy(F.col(row_id).alias("_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    # ids of the sample: at most max_labelled rows of 12 bytes
    texts = docs.join(F.broadcast(known), F.col(row_id) == F.col("_id")).groupBy("_id", "toxic").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    sample, path = stored(texts.withColumn("half", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)).cast("int")), "toxic-sample")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for batch in batches:
            for body, toxic, half in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = {_EDGES.sub("", w).lower() for w in set(body.split())}
                found = {(0, w) for w in words if 1 < len(w) <= 30}
                found |= {(n, w[:n]) for n in BEGINNINGS for w in words if n < len(w) <= 60}
                seen.setdefault(2 * half + toxic, Counter()).update(found)
        keys = sorted(set().union(*seen.values())) if seen else []
        for a in range(0, len(keys), 50_000):
            some = keys[a : a + 50_000]
            columns = [pa.array([seen.get(i, {}).get(k, 0) for k in some], type=pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in some], type=pa.int32()), pa.array([k[1] for k in some], type=pa.string()), *columns],
                ["kind", "term", "clean0", "toxic0", "clean1", "toxic1"],
            )

    counted = sample.select("text", "toxic", "half").mapInArrow(terms, "kind int, term string, clean0 long, toxic0 long, clean1 long, toxic1 long")
    totals = counted.groupBy("kind", "term").agg(*[F.sum(c).alias(c) for c in ("clean0", "toxic0", "clean1", "toxic1")])
    common = totals.where(F.col("toxic0") + F.col("toxic1") >= 3).orderBy(F.desc(F.col("toxic0") + F.col("toxic1") - F.col("clean0") - F.col("clean1")), "kind", "term")
    table = common.limit(20 * lexicon).toPandas()  # bounded by the lexicon's size
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    n = lambda half, toxic: sizes.get((half, toxic), 0)
    of_half = [_learned(table.assign(toxic=table[f"toxic{i}"], clean=table[f"clean{i}"]), n(i, 1), n(i, 0), lexicon) for i in (0, 1)]
    whole = table.assign(toxic=table["toxic0"] + table["toxic1"], clean=table["clean0"] + table["clean1"])
    words, begins = _learned(whole, n(0, 1) + n(1, 1), n(0, 0) + n(1, 0), lexicon)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_Codes(*of_half[1]), _Codes(*of_half[0])]  # each half sees the other's lexicon
        for batch in batches:
            ids, bodies, toxic, half = (batch.column(i).to_pylist() for i in range(4))
            x = [features(b, codes[h]) for b, h in zip(bodies, half, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(toxic, type=pa.int32()), pa.array(x, type=pa.list_(pa.float64()))], ["_id", "toxic", "x"])

    rows = sample.select(F.col("_id").cast("long"), "text", "toxic", "half").mapInArrow(featured, "_id long, toxic int, x array<double>").toPandas()
    drop(docs.sparkSession, path)
    rows = rows.sort_values("_id")
    y = rows["toxic"].to_numpy(dtype=np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    if rate in (0.0, 1.0) or len(y) < 8:
        return ToxicityModel(words, begins, None, (np.zeros(1), np.zeros(1)), rate)
    x = np.stack(rows["x"].to_numpy())
    # four parts with the classes' shares; each row is calibrated by trees that have not seen it
    place = np.zeros(len(y), dtype=np.int64)
    for label in (0.0, 1.0):
        place[y == label] = np.arange(int((y == label).sum())) % 4
    raw = np.zeros(len(y))
    for part in range(4):
        rest = place != part
        if len(np.unique(y[rest])) < 2:
            rest = np.ones(len(y), dtype=bool)
        raw[place == part] = BoostedTrees().fit(x[rest], y[rest]).raw(x[place == part])
    return ToxicityModel(words, begins, BoostedTrees().fit(x, y), isotonic(raw, y), rate)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", row_id: str = "doc_id", **options: int) -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (0 to 1, higher: likelier toxic),
    ``predicted`` (1 if the score is at least ``threshold``) and ``held_out``; columns of ``docs``
    with these names are replaced.

    Scores depend on the text alone. A null text scores as an empty one. Repeated rows and ties
    are scored alike. Empty ``docs``: no rows.
    """
    model = train(docs, labels, text=text, row_id=row_id, **options)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _Codes(model.words, model.begins)
        for some in texts:
            parts = [model.scores(some.slice(a, 512).to_pylist(), codes) for a in range(0, len(some), 512)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted", "held_out")]
    return (
        docs.select(*own)
        .withColumn("score", score(F.col(text)))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .withColumn("held_out", held_out(F.col(row_id)))
    )
