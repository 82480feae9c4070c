"""Encoding texts to the pieces of a public SentencePiece model, and decoding them.

The public model is of the BPE kind: a piece's score is the rank of its merge, and the encoding is what merging the
best adjacent pair again and again leaves. A best path by scores through the lattice of pieces is another encoding
(``lattice`` has it, for models whose scores are log probabilities), so merging is done here.

No piece reaches across the beginning of a run of spaces or across a line break or tab, so texts fall into chunks that
are encoded on their own. A task takes the distinct chunks of a few megabytes of text, all pairs of neighbours look up
the table of mergeable pairs by one sorted search, and each round merges every chunk's best pair at once. Nothing is
shuffled. Very long chunks are merged with a heap. The piece table is bounded by the vocabulary and goes along with the tasks.

Missing and empty texts have no pieces and decode to an empty text. Characters that are no piece become pieces of
bytes. The character U+2581 decodes as a space, as the model cannot tell it apart. Repeated rows are encoded each. The
columns ``ids`` and ``n_pieces`` (``decoded`` when decoding) are added or replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrow_words import pieces
from airloom.llm.text import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 512
NEVER = np.iinfo(np.int32).max


@dataclass(frozen=True)
class PieceTable:
    size: int
    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    pairs: np.ndarray  # sorted left * size + right
    merged: np.ndarray  # the piece a pair becomes
    rank: np.ndarray  # by piece: lower merges first
    byte_ids: np.ndarray  # by byte value
    spelled: list  # bytes by piece
    cuts: tuple  # bytes that no longer piece contains

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; rank NEVER where it is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        piece = np.where(hit, self.merged[at], -1)
        return np.where(hit, self.rank[piece], NEVER), piece


def load_pieces(path: str = MODEL) -> PieceTable:
    """The table of a model file; read with the public library, one row per vocabulary entry."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    rank = np.full(size, NEVER, np.int32)
    order = sorted(plain.values(), key=lambda i: (-model.get_score(i), i))
    rank[order] = np.arange(len(order), dtype=np.int32)
    pairs = sorted((plain[p[:k]] * size + plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain)
    chars = sorted((ord(p), i) for p, i in plain.items() if len(p) == 1)
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    spelled = [model.id_to_piece(i).replace(MARK, " ").encode() if model.id_to_piece(i) in plain else b"" for i in range(size)]
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    longer = "".join(p for p in plain if len(p) > 1)
    return PieceTable(
        size, np.array([c for c, _ in chars], np.int64), np.array([i for _, i in chars], np.int32), np.array([p for p, _ in pairs], np.int64),
        np.array([i for _, i in pairs], np.int32), rank, byte_ids, spelled, tuple(ord(c) for c in "\n\t\r" if c not in longer))


def _merge_rows(ids: np.ndarray, t: PieceTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges rows of equally many symbols to the end; returns the symbols left-aligned and how many are left."""
    n, width = ids.shape
    out, count = ids.copy(), np.full(n, width)
    rank, piece = t.merge_of(ids[:, :-1], ids[:, 1:])
    live = np.arange(n)
    column = np.arange(width - 1)
    while len(live):
        best = rank.argmin(1)
        rows = np.arange(len(live))
        go = rank[rows, best] < NEVER
        if not go.all():
            live, ids, rank, piece, best = live[go], ids[go], rank[go], piece[go], best[go]
            rows = rows[: len(live)]
        if not len(live):
            break
        new = piece[rows, best]
        moved = column[None, :] + (column[None, :] > best[:, None])
        ids[:, : width - 1] = np.take_along_axis(ids, moved, 1)
        ids[rows, best] = new
        count[live] -= 1
        # the pair that merged is gone; its neighbours change
        pad = np.full((len(live), 1), NEVER, rank.dtype)
        shift = column[None, :] + (column[None, :] >= best[:, None])
        rank = np.take_along_axis(np.hstack([rank, pad]), shift, 1)
        piece = np.take_along_axis(np.hstack([piece, pad]), shift, 1)
        for side in (-1, 0):
            at = best + side
            ok = (at >= 0) & (at + 1 < count[live])
            r, p = t.merge_of(ids[rows[ok], at[ok]], ids[rows[ok], at[ok] + 1])
            rank[rows[ok], at[ok]], piece[rows[ok], at[ok]] = r, p
        out[live] = ids
    return out, count


def _merge_long(ids: np.ndarray, t: PieceTable) -> np.ndarray:
    """The same for one long row, with a heap of pairs and links to the neighbours."""
    ids, n = ids.copy(), len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank, piece = t.merge_of(ids[:-1], ids[1:])
    at = np.flatnonzero(rank < NEVER)
    heap = list(zip(rank[at].tolist(), at.tolist(), ids[at].tolist(), ids[at + 1].tolist(), piece[at].tolist()))
    heapq.heapify(heap)
    alive = np.ones(n, bool)
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if a >= 0 and b < n:
                r, p = t.merge_of(ids[a : a + 1], ids[b : b + 1])
                if r[0] < NEVER:
                    heapq.heappush(heap, (int(r[0]), int(a), int(ids[a]), int(ids[b]), int(p[0])))
    return ids[alive]


def encode_chunks(chunks: pa.Array, t: PieceTable) -> pa.ListArray:
    """Piece ids of every chunk (spaces as they are)."""
    points = np.frombuffer("".join(chunks.to_pylist()).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.asarray(pc.utf8_length(chunks)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.minimum(np.searchsorted(t.chars, points), len(t.chars) - 1)
    symbols = np.where(t.chars[at] == points, t.char_ids[at], -1 - points)  # no piece: the code point below zero
    flat, owner, place = [], [], []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size > LONG:
            for r in rows:
                got = _merge_long(symbols[starts[r] : starts[r + 1]], t)
                flat.append(got), owner.append(np.full(len(got), r)), place.append(np.arange(len(got)))
            continue
        if not size:
            continue
        block = symbols[starts[rows][:, None] + np.arange(size)]
        out, count = _merge_rows(block, t) if size > 1 else (block, np.ones(len(rows), np.int64))
        keep = np.arange(size)[None, :] < count[:, None]
        flat.append(out[keep]), owner.append(np.repeat(rows, count)), place.append(np.broadcast_to(np.arange(size), out.shape)[keep])
    if not flat:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(sizes) + 1, np.int32)), pa.array([], pa.int32()))
    flat, owner, place = np.concatenate(flat), np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((place, owner))
    flat, owner = flat[order], owner[order]
    if (flat < 0).any():
        parts = [t.byte_ids[list(chr(-1 - v).encode())] for v in flat[flat < 0]]
        lengths = np.ones(len(flat), np.int64)
        lengths[flat < 0] = [len(p) for p in parts]
        full = np.repeat(flat, lengths)
        full[np.repeat(flat < 0, lengths)] = np.concatenate(parts)
        flat, owner = full, np.repeat(owner, lengths)
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))


def encode_batch(texts: pa.Array, t: PieceTable) -> pa.ListArray:
    """Piece ids of every text."""
    texts = pc.fill_null(texts, "")
    lead = pa.array(np.where(np.asarray(pc.equal(texts, "")).astype(bool), "", " ").astype(object), pa.string())
    led = pc.binary_join_element_wise(lead, texts, pa.scalar(""))
    ends = np.frombuffer(led.buffers()[1], np.int32)[led.offset : led.offset + len(led) + 1].astype(np.int64)
    data = np.frombuffer(led.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    space, cut = data == 0x20, np.isin(data, t.cuts)
    new = cut.copy()
    new[1:] |= (space[1:] & ~space[:-1]) | cut[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    begin = np.flatnonzero(new)
    offsets = np.append(begin, len(data)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    encoded = encode_chunks(coded.dictionary, t).take(coded.indices)
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(encoded)))]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes[np.searchsorted(begin, ends)].astype(np.int32)), encoded.flatten())


def decode_batch(ids: pa.ListArray, t: PieceTable) -> pa.Array:
    """Texts of lists of piece ids; bytes that are no UTF-8 become replacement characters."""
    ids = pc.fill_null(ids, [])
    parts = pa.array(t.spelled, pa.binary()).take(ids.flatten())
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(ids)))]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes), parts), pa.scalar(b""))
    return pa.array([x.decode("utf-8", "replace").removeprefix(" ") for x in joined.to_pylist()], pa.string())


def _mapped(df: DataFrame, columns: dict[str, str], model: str, make):
    """(frame without the new columns, schema with them, function from batches to batches)."""
    kept = df.drop(*columns)
    shared = load_pieces(model)
    sample = kept.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            yield make(b, shared)

    return kept, sample.schema, run


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """All columns, ``ids`` and ``n_pieces``."""
    def make(b, t):
        ids = encode_batch(b.column(text), t)
        return pa.RecordBatch.from_arrays([*b.columns, ids, pc.cast(pc.list_value_length(ids), pa.int64())], [*b.schema.names, "ids", "n_pieces"])

    kept, schema, run = _mapped(docs, {"ids": "array<int>", "n_pieces": "long"}, model, make)
    return kept.mapInArrow(lambda batches: run(batches, text), schema)


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """All columns and ``decoded``."""
    shared = load_pieces(model)
    kept = encoded.drop("decoded")
    schema = kept.select("*", F.lit(None).cast("string").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, decode_batch(b.column(ids), shared)], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """As ``encode``, with ``exact``: whether decoding gives the text again."""
    def make(b, t):
        ids = encode_batch(b.column(text), t)
        same = pc.equal(decode_batch(ids, t), pc.fill_null(b.column(text), ""))
        return pa.RecordBatch.from_arrays(
            [*b.columns, ids, pc.cast(pc.list_value_length(ids), pa.int64()), same], [*b.schema.names, "ids", "n_pieces", "exact"])

    kept, schema, run = _mapped(docs, {"ids": "array<int>", "n_pieces": "long", "exact": "boolean"}, model, make)
    return kept.mapInArrow(lambda batches: run(batches, text), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_pieces", "ids", "exact")
