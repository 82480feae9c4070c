"""Two tokenizers side by side: where their tokens end together, which tokens overlap, and how usual each overlap is.

A text is encoded twice, as a space and the text: by a byte-level BPE vocabulary (A) and by a SentencePiece model that
adds the space itself (B). Per text the ends of A's tokens in bytes are the keys of a dictionary to their places, and
so are B's. The keys both have, in order, slice both id lists into groups; within a slice every stretch between two
neighbouring ends is one link, the pair of tokens that cover it.

Links are counted over all documents. A task works on blocks of a few megabytes of text and keeps per block the distinct
pairs with their counts and, per link, the place of its pair among them, deflated. Pair counts are added up by an ordinary
aggregation, go back to the blocks that hold the pair, and each block adds up its documents. A pair shuffles once per
block that holds it, never once per link; nothing is collected, and a broadcast happens only where Spark measures it as small.

Missing and empty texts, and texts whose tokens do not spell them again byte by byte, have no tokens: all numbers zero,
``groups`` empty. Equal rows are aligned each. Only the columns doc_id and text are read, so further columns of any
name do no harm; a missing doc_id is kept as it is. An empty table gives an empty result. Spellings of special tokens
inside a text are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.llm.arrow_words import pieces
from airloom.llm.text import table
from airloom.session import written

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 4_000_000
LONG_BLANK = 10_000
#: Fixed value: how the byte-level vocabulary cuts a text before merging.
CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A pair of ids is one number: A's id times this, plus B's id.
PAIR = 1 << 32

BLOCKS = (
    "block long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, "
    "ids array<long>, links binary, pairs array<long>, times array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary: itself if printable, else the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_vocabulary(text: str) -> dict[bytes, int]:
    """Bytes of every ordinary token and its id; one entry per vocabulary line, so bounded by the file."""
    content = json.loads(text)
    special = {t["content"] for t in content.get("added_tokens", [])}
    symbol = byte_symbols()
    return {bytes(symbol[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}


_LONGS = pa.list_(pa.int64())
_BLOCK_SCHEMA = pa.schema([
    ("block", pa.int64()), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("groups", pa.list_(pa.string())),
    ("ids", _LONGS), ("links", pa.binary()), ("pairs", _LONGS), ("times", _LONGS),
])


class Encoders:
    """Both tokenizers in one task, from the small files the driver read, and what every id spells."""

    def __init__(self, vocabulary_text: str, model: bytes):
        import sentencepiece
        import tiktoken

        vocabulary = byte_vocabulary(vocabulary_text)
        self.vocabulary_text, self.patient = vocabulary_text, None
        self.bytes_bpe = tiktoken.Encoding("bytes", pat_str=CUTS, mergeable_ranks=vocabulary, special_tokens={})
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled = []
        for i in range(self.piece_bpe.get_piece_size()):
            piece = self.piece_bpe.id_to_piece(i)
            self.spelled.append(bytes([int(piece[3:5], 16)]) if self.piece_bpe.is_byte(i) else piece.replace("▁", " ").encode())
        ids = range(1 + max(vocabulary.values()))
        self.size_a, self.size_b = np.zeros(len(ids), np.int64), np.array([len(x) for x in self.spelled])
        for token, i in vocabulary.items():
            self.size_a[i] = len(token)
        # how an id is written inside and at the end of its side of a group, A's ids and then B's
        self.written = [f"{i}{mark}" for side, marks in ((ids, ",|"), (range(len(self.spelled)), ",;")) for mark in marks for i in side]

    def encode_bytes(self, whole: str) -> np.ndarray:
        """A's ids. The fast library cannot take very long runs of blanks; the other one, which can, gives the same ids."""
        if len(whole) <= LONG_BLANK or not re.search(rf"\s{{{LONG_BLANK}}}", whole):
            return self.bytes_bpe.encode_to_numpy(whole).astype(np.int64)
        if self.patient is None:
            from tokenizers import Tokenizer

            self.patient = Tokenizer.from_str(self.vocabulary_text)
            self.patient.encode_special_tokens = True
        return np.array(self.patient.encode(whole, add_special_tokens=False).ids, np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or nothing where a side does not spell the text. A merges the text's own bytes, so length tells."""
        whole = " " + text
        wanted, b = whole.encode(), self.piece_bpe.encode(text, num_threads=1)
        if b"".join(map(self.spelled.__getitem__, b)) != wanted:
            return None
        a = self.encode_bytes(whole)
        return (a, np.array(b, np.int64)) if int(self.size_a[a].sum()) == len(wanted) else None

    def group_text(self, a: np.ndarray, b: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups one after another, A's ids before B's."""
        before = [np.concatenate([[0], c[:-1]]) for c in cuts]
        group = [np.repeat(np.arange(len(c)), c - f) for c, f in zip(cuts, before)]
        codes = np.empty(len(a) + len(b), np.int64)
        last = [np.zeros(len(x), np.int64) for x in (a, b)]
        for c, mark in zip(cuts, last):
            mark[c - 1] = 1
        codes[np.arange(len(a)) + before[1][group[0]]] = a + last[0] * len(self.size_a)
        codes[np.arange(len(b)) + cuts[0][group[1]]] = b + last[1] * len(self.size_b) + 2 * len(self.size_a)
        return "".join(map(self.written.__getitem__, codes.tolist()))[:-1]


def end_places(sizes: np.ndarray) -> dict[int, int]:
    """Byte end of every token to its place; ends grow, so no key comes twice."""
    return dict(zip(np.cumsum(sizes).tolist(), range(len(sizes))))


def slices(ends_a: dict[int, int], ends_b: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places just behind each group on both sides, from the ends both have."""
    common = sorted(ends_a.keys() & ends_b.keys())
    return tuple(np.fromiter(map(e.__getitem__, common), np.int64, len(common)) + 1 for e in (ends_a, ends_b))


def expand_links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Pairs of ids whose bytes overlap, in text order.

    Between two neighbouring ends of either side lies one stretch, covered by one token of each. Slices begin and end at
    ends of both sides, so the stretches of all slices are those of the whole text.
    """
    ends = np.zeros(int(size_a.sum()), bool)
    ends[np.cumsum(size_a) - 1] = True
    ends[np.cumsum(size_b) - 1] = True
    stretch = np.flatnonzero(ends)
    return np.repeat(a, size_a)[stretch] * PAIR + np.repeat(b, size_b)[stretch]


def pack(numbers: np.ndarray) -> bytes:
    """Small whole numbers deflated byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, size: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=4 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(docs: DataFrame, vocabulary: str, model: bytes, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, task, made = None, TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text", BLOCK_BYTES):
            encoders = encoders or Encoders(vocabulary, model)
            rows, found = [], []
            for text in piece.column("text"):
                text = text.as_py()
                sides = encoders.encode(text) if text else None
                if sides is None:
                    rows.append((0, 0, 0, 0, ""))
                    continue
                a, b = sides
                size_a, size_b = encoders.size_a[a], encoders.size_b[b]
                cuts = slices(end_places(size_a), end_places(size_b))
                links = expand_links(a, b, size_a, size_b)
                spelled = encoders.group_text(a, b, cuts)
                found.append(links)
                rows.append((len(a), len(b), len(cuts[0]), len(links), hashlib.sha256(spelled.encode()).hexdigest() if digest else spelled))
            place, pairs = pd.factorize(np.concatenate(found) if found else np.zeros(0, np.int64))
            times = np.bincount(place, minlength=len(pairs))
            usual = np.argsort(-times, kind="stable")
            rank = np.empty(len(pairs), np.uint32)
            rank[usual] = np.arange(len(pairs), dtype=np.uint32)
            n_a, n_b, n_groups, n_links, groups = (list(c) for c in zip(*rows))
            ids = piece.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_pylist([{
                "block": (task << 33) + made, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups,
                "ids": ids.to_pylist(), "links": pack(rank[place]), "pairs": pairs[usual], "times": times[usual],
            }], schema=_BLOCK_SCHEMA)
            made += 1

    return docs.mapInArrow(run, BLOCKS)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """block, place, count, best of every pair a block holds: counts over all blocks, best where no A id has more with this B id."""
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count"))
    with_b = counts.withColumn("b", F.col("pair") % PAIR)
    most = with_b.groupBy("b").agg(F.max("count").alias("most"))  # one row per piece of the vocabulary
    judged = with_b.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return held.select("block", "place", "pair").join(judged, "pair").select("block", "place", "count", "best")


def _document_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RESULT.split(", ")]
    for batch in batches:
        for at in range(batch.num_rows):
            row = {n: batch.column(n)[at] for n in batch.schema.names}
            size = np.asarray(row["n_links"].values, np.int64)
            place = unpack(row["links"].as_py(), int(size.sum()))
            known = row["known"].values
            count = np.asarray(known.field("count"), np.int64)[place]
            best = np.asarray(known.field("best")).astype(np.int64)[place]
            ends = np.concatenate([[0], np.cumsum(size)])
            total, right = (np.concatenate([[0], np.cumsum(x)]) for x in (count, best))
            out = [row["ids"].values, *(row[n].values for n in ("n_a", "n_b", "n_groups", "n_links")),
                   pa.array(right[ends[1:]] - right[ends[:-1]]), pa.array(total[ends[1:]] - total[ends[:-1]]), row["groups"].values]
            yield pa.RecordBatch.from_arrays(out, names=names)


def align(docs: DataFrame, vocabulary_path: str = BYTE_VOCABULARY, model_path: str = PIECE_MODEL, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: token, group and link numbers, ``n_best`` and ``count_sum`` over the corpus, and the groups.

    With ``digest`` the column ``groups`` carries the SHA-256 of the groups and not their text.
    """
    with open(vocabulary_path, encoding="utf-8") as first, open(model_path, "rb") as second:
        vocabulary, model = first.read(), second.read()
    blocks = written(_blocks(docs.select(F.col("doc_id").cast("long"), "text"), vocabulary, model, digest), "align-blocks")
    # a block's pairs are at most its links, so the list is bounded by the block
    answers = _pair_counts(blocks).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))
    none = F.array().cast("array<struct<place:int,count:bigint,best:boolean>>")
    joined = blocks.drop("pairs", "times").join(answers, "block", "left").withColumn("known", F.coalesce("known", none)).drop("block")
    return joined.mapInArrow(_document_sums, RESULT)


def op13(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
