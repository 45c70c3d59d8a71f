"""Packing documents into fixed windows by lexical retrieval.

Texts become token ids, and rows are put in the order of weighted min-hashes over each document's
tokens, rare ones (counted in all documents) first, so that documents that share rare words become
neighbours wherever they were stored. Tasks take ranges of that order; a key that very many
documents share is cut by the next one and, at last, by the row's hash. Each task cuts its rows into shards of bounded size. A shard gets an inverted index
with BM25 weights over token ids. A window starts with a seed document; the index returns the
seed's unused neighbours, best first, and those that fit fill the window. The best one that does
not fit is cut to close the gap, and its rest seeds the next window. Only a shard's last window can
stay short: it is split into sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import give_back, lean, stored
from lectern.llm.shingles import mix
from lectern.llm.tokens import word_encoder

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


class InvertedIndex:
    """Postings with BM25 weights over one shard's token ids."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(docs)
        unique = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in unique], dtype=np.int64)
        terms = np.concatenate([t for t, _ in unique])
        tf = np.concatenate([c for _, c in unique]).astype(np.float32)
        del unique
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        lengths = np.array([len(d) for d in docs], dtype=np.float32)
        # numbers of 16 bits, as most vocabularies have, are sorted by digits
        order = np.argsort(terms.astype(np.uint16) if int(terms.max()) < 1 << 16 else terms, kind="stable")
        held = terms[order]
        self.first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        self.df = np.diff(np.append(self.first, len(held)))
        del held
        idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        norm = (k1 * (1 - b + b * lengths / max(1.0, float(lengths.mean())))).astype(np.float32)
        self.place = np.empty(len(terms), dtype=np.int32)  # of each document's terms among all terms
        self.place[order] = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        weight = idf[self.place] * tf * np.float32(k1 + 1) / (tf + norm[owner])
        self.docs, self.weights = owner[order], weight[order]
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """The unused documents, best match with all terms of ``doc`` first, ties in the shard's order."""
        asked = self.place[self.starts[doc] : self.ends[doc]]
        asked = asked[self.df[asked] > 1]
        count = self.df[asked]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[asked], count)
        score = np.bincount(self.docs[at], self.weights[at], minlength=self.n)
        left = np.flatnonzero(unused)
        return left[np.argsort(-score[left], kind="stable")]


def key_tables(weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of three hashes: the place of every id in the order in which ids become keys (an id comes
    early with a chance in proportion to its ``weight``; ids of no weight are last), and the keys by place."""
    heavy = np.flatnonzero(weight > 0)
    tables = []
    for k in (1, 2, 3):
        name = mix(heavy.astype(np.uint64) + np.uint64(k << 32))
        chance = ((name >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        order = np.argsort(-np.log(chance) / weight[heavy], kind="stable")
        place = np.full(len(weight), len(heavy), dtype=np.int32)
        place[heavy[order]] = np.arange(len(heavy))
        tables.append((place, np.append((name[order] >> np.uint64(1)).astype(np.int64), 0)))
    return tables


def lexical_keys(docs: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Three weighted min-hashes over the ids of each document, by ``key_tables``; 0 if none of them has
    weight. An id's chance is the same for all documents that hold it, and equal sets have equal keys."""
    keys = np.zeros((len(docs), len(tables)), dtype=np.int64)
    size = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    some = np.flatnonzero(size)
    if len(some):
        ids = np.concatenate(docs)
        start = (np.cumsum(size) - size)[some]
        for k, (place, name) in enumerate(tables):
            keys[some, k] = name[np.minimum.reduceat(place[ids], start)]
    return keys


def forget_words() -> None:
    """Drop this worker's encoder, once all texts are encoded, and give its memory back before other work begins."""
    word_encoder.cache_clear()
    give_back()


class TokenCounts:
    """In how many of the documents added each token id is."""

    def __init__(self) -> None:
        self.n, self.last = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.rows = self.bytes = 0

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and (most := int(ids.max())) >= len(self.n):
            self.n, self.last = (np.concatenate([v, np.zeros(most + 1, dtype=np.int64)]) for v in (self.n, self.last))
        at = np.arange(len(ids))
        self.last[ids] = at  # of equal ids, one place stays
        self.n[ids[self.last[ids] == at]] += 1
        self.rows += 1
        self.bytes += 4 * len(ids) + 8

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts), with the number of documents under id -1 and the bytes of their rows under -2."""
        used = np.flatnonzero(self.n)
        return np.concatenate([[-1, -2], used]), np.concatenate([[self.rows, self.bytes], self.n[used]])


def _weights(told: DataFrame) -> tuple[np.ndarray, int]:
    """(``token_weights``, bytes of all rows) from tables of ``TokenCounts`` (id, n). What reaches the driver is
    one count for each id of the vocabulary."""
    found = told.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ids, n = found["id"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    rows, size = (int(n[ids == k].sum()) for k in (-1, -2))
    ids, n = ids[ids >= 0], n[ids >= 0]
    weight = np.zeros(int(ids.max()) + 1 if len(ids) else 1)
    weight[ids] = np.where(n > 1, np.log(np.maximum(rows / n, 1.0)) ** 2, 0.0)
    return weight, size


def token_weights(encoded: DataFrame) -> np.ndarray:
    """The squared inverse document frequency of every token id, from all documents; none for ids of a
    single document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TokenCounts()
        for batch in batches:
            for e in batch.column(0):
                counts.add(np.frombuffer(e.as_buffer(), dtype="<u4"))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in counts.table()], ["id", "n"])

    return _weights(encoded.select("ids").mapInArrow(lean(count), "id long, n long"))[0]


def split_points(keys: list[tuple], share: list[float], parts: int) -> list[tuple]:
    """The least keys of all but the first of ``parts`` ranges of about equal weight; ``share``: what each of
    ``keys`` stands for."""
    by = sorted(range(len(keys)), key=keys.__getitem__)
    total = np.cumsum([share[i] for i in by])
    at = np.searchsorted(total, np.arange(1, parts) * (total[-1] / parts)) if len(by) else []
    return sorted({keys[by[i]] for i in at})


def pack_shard(docs: list[np.ndarray], window: int) -> list[Piece]:
    """Place every token of every document in exactly one piece."""
    index = InvertedIndex(docs)
    sizes = [len(d) for d in docs]
    unused = np.ones(len(docs), dtype=bool)
    pieces: list[Piece] = []
    sequence, carried, at = 0, -1, 0
    placed: list[tuple[int, int, int]] = []
    while True:
        if carried < 0:
            left = np.flatnonzero(unused)
            if not len(left):
                return pieces
            carried, at = int(left[0]), 0
            unused[carried] = False
        room = window
        take = min(room, sizes[carried] - at)
        placed = [(carried, at, take)]
        room -= take
        seed, at = carried, at + take
        if at == sizes[carried]:
            carried, at = -1, 0
            if room:
                order = index.neighbours(seed, unused)
                cut = -1
                for d in order.tolist():
                    if sizes[d] <= room:
                        placed.append((d, 0, sizes[d]))
                        unused[d] = False
                        room -= sizes[d]
                        if not room:
                            break
                    elif cut < 0:
                        cut = d
                if room and cut >= 0:
                    placed.append((cut, 0, room))
                    unused[cut] = False
                    carried, at, room = cut, room, 0
        if not room:
            offset = 0
            for d, start, n in placed:
                pieces.append((d, start, n, sequence, offset))
                offset += n
            sequence += 1
        else:
            sequence = _tail(placed, window - room, sequence, pieces)


def _tail(placed: list[tuple[int, int, int]], total: int, sequence: int, pieces: list[Piece]) -> int:
    """Sequences of falling powers of two that hold a short window without padding."""
    size, offset = 1 << (total.bit_length() - 1), 0
    for d, start, n in placed:
        while n:
            take = min(n, size - offset)
            pieces.append((d, start, take, sequence, offset))
            start, n, offset = start + take, n - take, offset + take
            if offset == size:
                total -= size
                sequence, offset, size = sequence + 1, 0, 1 << (total.bit_length() - 1) if total else 0
    return sequence


_OUT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Of a task, beside its documents (kind 0): one row of its counts (1: ids in ``told``, counts in ``counts``), and
#: some of its documents (2: ids in ``told``, for how many bytes of rows each stands in ``share``).
_IDS = "doc_id long, ids binary, kind int, told binary, counts binary, share double"
_KEYED = "doc_id long, ids binary, h long, k1 long, k2 long, k3 long, part int"
_DRAWN = "k1 long, k2 long, k3 long, h long, share double"


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    window: int = 4096,
    end_id: int = 2,
    text: str = "text",
    row_id: str = "doc_id",
    shard_docs: int = 1024,
    shard_tokens: int = 1 << 20,
    task_bytes: int = 64 << 20,
    drawn_docs: int = 100,
) -> DataFrame:
    """Pieces of documents laid out in sequences of at most ``window`` tokens.

    A document's tokens are its text's ids (null text: none) and ``end_id``. One row per piece:
    doc_id, start (its document's tokens before it), length, doc_tokens (its document's),
    sequence_id, offset (gapless from 0 in each sequence) and ids (little-endian unsigned 32-bit).
    Sequences hold ``window`` tokens, but for a shard's last ones, whose lengths are powers of
    two; no token is padding. A shard holds up to ``shard_docs`` documents or ``shard_tokens``
    tokens, neighbours in the order of ``lexical_keys``; tasks take about ``task_bytes`` of ids
    (ranges of the order, told from ``drawn_docs`` documents of each encoding task; all documents are packed).

    An empty text is the single token ``end_id``. Repeated rows are packed once each; rows of null
    id keep a null id. Equal matches are taken in the shard's order, which ends with the row's id
    and ids, so ties are only between rows that are the same. Very long texts are cut over as many
    windows as they need. Other columns, whatever their names, play no part. Empty input: no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = word_encoder(vocabulary), TokenCounts()
        draw, drawn = np.random.default_rng(7), []

        def rows(doc_id: pa.Array, ids: list[bytes | None], kind: int, told: list[bytes | None], n: bytes | None = None, share: float | None = None) -> pa.RecordBatch:
            cols = [doc_id, pa.array(ids, pa.binary()), pa.array([kind] * len(ids), pa.int32()), pa.array(told, pa.binary())]
            cols += [pa.array([n] * len(ids), pa.binary()), pa.array([share] * len(ids), pa.float64())]
            return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _IDS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                encoded = [e.astype("<u4") for e in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                ids = [e.tobytes() for e in encoded]
                for i, e in enumerate(encoded):
                    counts.add(e)
                    # each of a task's documents is among those drawn with the same chance
                    to = len(drawn) if len(drawn) < drawn_docs else int(draw.integers(counts.rows))
                    if to < drawn_docs:
                        drawn[to : to + 1] = [(some.column(0)[i].as_py(), ids[i])]
                yield rows(some.column(0), ids, 0, [None] * len(ids))
            give_back()  # a task has many batches, and what one leaves behind would add up
        if drawn:
            used, n = (c.astype("<i8").tobytes() for c in counts.table())
            yield rows(pa.array([None], pa.int64()), [None], 1, [used], n)
            names, told = zip(*drawn, strict=True)
            yield rows(pa.array(names, pa.int64()), [None] * len(drawn), 2, list(told), None, counts.bytes / len(drawn))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c.as_buffer(), dtype="<i8")) for c in row], ["id", "n"])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Three keys of each document, and the range of all that it lies in."""
        forget_words()
        tables = key_tables(weight)
        for batch in batches:
            keys = lexical_keys([np.frombuffer(e.as_buffer(), dtype="<u4") for e in batch.column(1)], tables)
            part = [bisect_right(points, tuple(k)) for k in np.column_stack([keys, batch.column(2).to_numpy()]).tolist()]
            cols = [*batch.columns, *(pa.array(keys[:, i]) for i in range(3)), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _KEYED.split(", ")])

    def drawn_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        tables = key_tables(weight)
        for batch in batches:
            keys = lexical_keys([np.frombuffer(e.as_buffer(), dtype="<u4") for e in batch.column(1)], tables)
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), *batch.columns[2:]], [f.split()[0] for f in _DRAWN.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_words()
        base = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, tokens
            pieces = pack_shard(held, window)
            rows = [(ids[d], s, n, len(held[d]), base + q, o, held[d][s : s + n].tobytes()) for d, s, n, q, o in pieces]
            base += pieces[-1][3] + 1
            ids.clear(), held.clear()
            tokens = 0
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, type=pa.int64()) for c in cols[:6]), pa.array(cols[6], type=pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                held.append(np.append(np.frombuffer(e.as_buffer(), dtype="<u4"), np.uint32(end_id)))
                tokens += len(held[-1])
                if len(held) >= shard_docs or tokens >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    encoded, _ = stored(docs.select(F.col(row_id).cast("long"), F.col(text)).mapInArrow(lean(encode), _IDS), "pack-ids")
    weight, total = _weights(encoded.where("kind = 1").select("told", "counts").mapInArrow(lean(counted), "id long, n long"))
    h = F.xxhash64("doc_id", "ids").alias("h")
    # the ranges are told from documents that the tasks have drawn, so that no document has its keys made twice
    parts, points = int(total // task_bytes) + 1, []
    if parts > 1:
        some = encoded.where("kind = 2").select("doc_id", F.col("told").alias("ids"), "share").select("doc_id", "ids", h, "share")
        told = some.mapInArrow(lean(drawn_keys), _DRAWN).toPandas()
        points = split_points(list(zip(*(told[c].tolist() for c in ("k1", "k2", "k3", "h")), strict=True)), told["share"].tolist(), parts)
    dealt = encoded.where("kind = 0").select("doc_id", "ids", h).mapInArrow(lean(key), _KEYED).repartitionById(parts, F.col("part"))
    return dealt.sortWithinPartitions("k1", "k2", "k3", "h", "doc_id", "ids").select("doc_id", "ids").mapInArrow(lean(pack), _OUT)
