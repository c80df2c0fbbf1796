"""Best-fit packing of documents into fixed-length sequences.

Every document is tokenized once; its ids plus one end id are cut into pieces
of at most ``capacity`` tokens (only a longer document is cut, its first piece
may be shorter). The pieces go to the shared folder with their ids.

What is planned is the histogram of piece lengths, which has at most
``capacity`` rows however large the corpus is. Going from the longest length
down, an index of the available single lengths, pair sums and triple sums
gives a combination that fills the gap exactly; it is consumed in bulk, as
often as the availability counts allow. What has no exact complement is then
placed by best fit, again in bulk. The plan is a short list of (pattern of
lengths, copies).

Each piece has a rank among the pieces of its length: pieces are counted by
(length, salt), the counts are prefix-summed, and rows are numbered within one
(length, salt) cell, so a length that a third of all pieces have is dealt over
many tasks. The rank falls in one slot of the plan, which gives the sequence
and the place in it.

Defined results: null or empty text is one piece of the end id; repeated rows
are packed one by one; a table without rows gives no pieces; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, small_side, tidy

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are numbered in one group, about.
CELL_ROWS = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: how a byte-level BPE file of this kind cuts texts into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def added_tokens(path: str) -> dict[str, int]:
    """The file's added tokens, such as an end-of-text mark, by their text."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that take white space or need word borders are not supported")
    return {t["content"]: t["id"] for t in tokens}


def check_kind(data: dict) -> None:
    """Raises where a tokenizer file does more than byte-level merges of words cut by ``WORD_PATTERN``."""
    model, cutter = data["model"], data.get("pre_tokenizer") or {}
    asked = {name: model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")}
    if model.get("type", "BPE") != "BPE" or any(asked.values()):
        raise ValueError(f"not a plain BPE file: {model.get('type')}, {asked}")
    if data.get("normalizer"):
        raise ValueError("a tokenizer file with a normalizer is not supported")
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        raise ValueError(f"the words of this tokenizer file are cut in another way: {cutter}")


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file by its bytes; a token's id is its merge rank."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    check_kind(data)
    special = {t["content"] for t in data["added_tokens"]}
    return {bytes(byte_of[c] for c in token): n for token, n in data["model"]["vocab"].items() if token not in special}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; adds no token.

    The merges are done by tiktoken from the ranks of the given file: the same
    ids as the file's own library gives on its default settings, at a quarter
    of its time. The file's added tokens are found in the text, as that library
    does. Files of another kind are refused.
    """

    def __init__(self, path: str):
        import tiktoken

        self.bpe = tiktoken.Encoding("file", pat_str=WORD_PATTERN, mergeable_ranks=byte_ranks(path), special_tokens=added_tokens(path))

    def __call__(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a file, read once in a worker's life."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens, then n: all but the first are full."""
    first = (n - 1) % capacity + 1
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit): one row per piece."""
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(4, "little")

    def work(batches):
        encode = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    marks = cut(len(ids) // 4, capacity)
                    rows += [(doc, n, a, b - a, ids[4 * a : 4 * b]) for n, (a, b) in enumerate(zip(marks, marks[1:], strict=False))]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(work), "doc_id long, piece int, start long, length long, ids binary")


def _pair(have: np.ndarray, gap: int, top: int) -> tuple[int, int] | None:
    """Two available lengths of at most ``top`` that sum to ``gap``, the larger as large as can be."""
    if gap < 2:
        return None
    a = np.arange(min(gap - 1, top), (gap + 1) // 2 - 1, -1)
    if not len(a):
        return None
    fits = (have[a] > 0) & (have[gap - a] > 0) & ((2 * a != gap) | (have[a] > 1))
    return (int(a[k]), int(gap - a[k])) if len(a) and fits[k := int(fits.argmax())] else None


def exact_complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Up to three available lengths that sum to ``gap``."""
    if gap == 0:
        return ()
    if have[gap] > 0:
        return (gap,)
    if (pair := _pair(have, gap, gap)) is not None:
        return pair
    there = (have[: gap + 1] > 0).astype(np.int64)
    sums = np.convolve(there, there)[: gap + 1]  # number of pairs by their sum
    a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
    for one in a[(there[a] > 0) & (sums[gap - a] > 0)].tolist():
        have[one] -= 1
        pair = _pair(have, gap - one, one)
        have[one] += 1
        if pair is not None:
            return (one, *pair)
    return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Histogram of lengths -> (pattern of lengths, copies), every piece used once."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    for big in range(capacity, 0, -1):
        while have[big] > 0:
            have[big] -= 1
            found = exact_complement(have, capacity - big)
            have[big] += 1
            if found is None:
                break
            need = Counter((big, *found))
            times = min(int(have[x]) // k for x, k in need.items())
            for x, k in need.items():
                have[x] -= k * times
            plan.append(((big, *found), times))
    # residuals: longest first, each into the fullest open sequence that has room
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            gap = min((g for g, some in open_by_gap.items() if g >= length and some), default=None)
            if gap is None:
                per = min(capacity // length, left)
                times = left // per
                open_by_gap[capacity - per * length].append(((length,) * per, times))
                left -= per * times
                continue
            pattern, copies = open_by_gap[gap].pop()
            used = min(copies, left)
            if copies > used:
                open_by_gap[gap].append((pattern, copies - used))
            open_by_gap[gap - length].append(((*pattern, length), used))
            left -= used
    return plan + [x for gap in sorted(open_by_gap) for x in open_by_gap[gap]]


@dataclass(frozen=True)
class Slots:
    """The plan by length: slot k holds the pieces of global rank starts[k] and up."""

    first_rank: np.ndarray  # by length: rank of its first piece among all pieces, ordered by length
    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def slots(plan: list[tuple[tuple[int, ...], int]], counts: dict[int, int], capacity: int) -> Slots:
    first_rank = np.concatenate([[0], np.cumsum([counts.get(x, 0) for x in range(capacity + 1)])])[:-1]
    at, base, rows = first_rank.copy(), 0, []
    for pattern, copies in plan:
        offset = 0
        for length in pattern:
            rows.append((int(at[length]), base, offset))
            at[length] += copies
            offset += length
        base += copies
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return Slots(first_rank, table[:, 0], table[:, 1], table[:, 2])


def lay_out(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; gapless from 0 in each sequence."""
    light = cut_pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    counts = {r["length"]: r["n"] for r in light.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    table = slots(plan_packing(counts, capacity), counts, capacity)
    salted = light.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(total // CELL_ROWS + 1)).cast("int"))
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(small_side(base), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(frames):
        for f in frames:
            rank = f["rank"].to_numpy() + table.first_rank[f["length"].to_numpy()]
            k = np.searchsorted(table.starts, rank, side="right") - 1
            yield f.drop(columns="rank").assign(sequence_id=table.sequence[k] + rank - table.starts[k], offset=table.offset[k])

    return ranked.mapInPandas(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, layout): join them by doc_id and piece, or see ``sequences``."""
    cut_pieces = materialize(pieces(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")), "pack-pieces")
    return cut_pieces, lay_out(cut_pieces, capacity)


def sequences(cut_pieces: DataFrame, layout: DataFrame) -> DataFrame:
    """sequence_id, ids (binary): the packed sequences themselves, at most ``capacity`` ids each."""
    placed = layout.select("doc_id", "piece", "sequence_id", "offset").join(cut_pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(joined.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids")
    )


def crc_of_ids(ids) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit numbers; for tests."""
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def query(spark, sf_dir: str) -> DataFrame:
    """op1: where every piece of every document stands."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
