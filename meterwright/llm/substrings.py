"""Substring dedup by relative Lempel-Ziv parsing against blocks of all documents.

A window of 20 words is a duplicate if the same words also start earlier (in
order of doc_id, then of place). Documents are dealt into blocks of bounded
size; each block gets a reference, which is parsed against: the texts of all
earlier places, wherever they are, that its documents can refer to. A document
is factored greedily: at the next window that the reference's index knows, the
factor is extended word by word as long as document and reference agree.
Windows that cross the end of a factor are looked up on their own, and start
factors that overlap it. The words of the factors are the duplicate spans.

So that a block's reference holds what it needs and no more, it is put
together from an index of windows:

1. The index is sampled by content: of the five-word grams in a window, the one
   with the lowest hash is its anchor, and equal windows have equal anchors.
   Anchors of all documents are counted by hash; a batch that holds an anchor
   several times sends it once. Only anchors that occur twice or more go on.
2. Windows of such anchors are listed once for each block, with their earliest
   place in it. Among all blocks the earliest place of a window is what the
   others refer to: a passage that very many documents share meets as one row
   per block.
3. Each block asks for the places that its windows refer to; neighbouring ones
   are one excerpt. The excerpts are cut from the documents that hold them and
   sent to the block, where the parse compares words, not hashes.

Documents whose whole text equals an earlier one are one factor and are not
parsed.

Defined results: null text has no words; a text of fewer than 20 words keeps
all; a null doc_id comes before all others; rows with one doc_id are judged
row by row (equal places are not earlier than each other), equal rows alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import hex_digest, join_counted, materialize, release_memory, small_side, tidy
from ._words import first_of_equal, second_hashes, window_hashes, word_hashes, words_of

WINDOW = 20
GRAM = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 4_000_000
#: Requests for excerpts that are answered in one group.
REQUESTS = 50_000


def anchors(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hashes, for every window the place of its anchor): the leftmost lowest gram."""
    grams = window_hashes(hashes, gram)
    n = len(hashes) - window + 1
    if n <= 0:
        return grams, np.empty(0, dtype=np.int64)
    span = window - gram + 1
    at = np.empty(n, dtype=np.int64)
    for k in range(0, n, 4096):
        view = np.lib.stride_tricks.sliding_window_view(grams[k : k + 4096 + span - 1], span)
        at[k : k + 4096] = view.argmin(axis=1) + np.arange(k, k + len(view))
    return grams, at


_ANCHORS = "anchor long, salt int, weight int, doc_id long, tie long, place int"


def _scan(window: int, gram: int):
    def work(batches):
        for batch in (b.slice(k, 4000) for b in batches for k in range(0, b.num_rows, 4000)):
            found, places, owner = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                grams, at = anchors(word_hashes(words_of(text)), window, gram)
                at = np.unique(at)
                found.append(grams[at])
                places.append(at)
                owner.append(np.full(len(at), k))
            anchor, place, own = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (found, places, owner))
            first, held = first_of_equal(anchor)
            # one row speaks for an anchor of this batch; the others are known to be shared and go by themselves
            salt = np.where(first, 0, 1 + place).astype(np.int32)
            anchor = np.where(first, anchor.view(np.int64), own)
            ids, ties = batch.column(0), batch.column(1)
            for k in range(0, len(anchor), 200_000):
                s = slice(k, k + 200_000)
                rows = pa.array(own[s])
                columns = [anchor[s], salt[s], np.minimum(held[s], 2).astype(np.int32), ids.take(rows), ties.take(rows), place[s].astype(np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "salt", "weight", "doc_id", "tie", "place"])

    return work


_FIRST = np.iinfo(np.int64).min  # stands for a null doc_id in orderings
_WINDOWS = "win long, win2 long, block int, doc_id long, tie long, start int, n int"


def _tidy_group(work):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            release_memory()

    return run


def _windows(window: int, gram: int):
    """A block's texts and their shared anchors -> each window of such an anchor, with its earliest place in the block and its number there."""

    def work(texts: pa.Table, hits: pa.Table) -> pa.Table:
        asked = {(d, t): p for d, t, p in zip(hits["doc_id"].to_pylist(), hits["tie"].to_pylist(), hits["places"].to_pylist(), strict=True)}
        wins, wins2, starts, owner = [], [], [], []
        docs, ties = texts["doc_id"].to_pylist(), texts["tie"].to_pylist()
        for j, (doc, tie) in enumerate(zip(docs, ties, strict=True)):
            places = asked.get((doc, tie))
            if not places:
                continue
            hashes = word_hashes(words_of(texts["text"][j].as_py()))
            _, at = anchors(hashes, window, gram)
            hit = np.zeros(len(hashes) + 1, dtype=bool)
            hit[places] = True
            start = np.flatnonzero(hit[at])
            wins.append(window_hashes(hashes, window)[start])
            wins2.append(window_hashes(second_hashes(hashes), window)[start])
            starts.append(start)
            owner.append(np.full(len(start), j))
        win, win2, start, own = (np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((wins, np.uint64), (wins2, np.uint64), (starts, np.int64), (owner, np.int64)))
        order_of = np.array([_FIRST if d is None else d for d in docs], dtype=np.int64)
        order = np.lexsort((start, order_of[own], win2, win))
        win, win2, start, own = win[order], win2[order], start[order], own[order]
        head = np.ones(len(win), dtype=bool)
        head[1:] = (win[1:] != win[:-1]) | (win2[1:] != win2[:-1])
        n = np.diff(np.append(np.flatnonzero(head), len(win)))
        rows = pa.array(own[head])
        block = np.full(len(n), texts["block"][0].as_py() if len(texts) else 0, dtype=np.int32)
        columns = [win[head].view(np.int64), win2[head].view(np.int64), block, texts["doc_id"].take(rows), texts["tie"].take(rows), start[head].astype(np.int32), n.astype(np.int32)]
        return pa.table(dict(zip(("win", "win2", "block", "doc_id", "tie", "start", "n"), columns, strict=True)))

    return _tidy_group(work)


_EXCERPTS = "block int, ref_doc long, ref_start int, excerpt string"


def _cut(window: int):
    """A block's texts and what blocks ask of them -> excerpts, one for each run of neighbouring windows."""

    def work(texts: pa.Table, asked: pa.Table) -> pa.Table:
        row = {(d, t): k for k, (d, t) in enumerate(zip(texts["doc_id"].to_pylist(), texts["tie"].to_pylist(), strict=True))}
        out, words, last = [], [], None
        keys = zip(asked["doc_id"].to_pylist(), asked["tie"].to_pylist(), strict=True)
        for (k, key) in sorted(enumerate(keys), key=lambda x: row[x[1]]):
            if key != last:
                words, last = words_of(texts["text"][row[key]].as_py()), key
            starts = np.unique(asked["starts"][k].values.to_numpy(zero_copy_only=False))
            breaks = np.flatnonzero(np.diff(starts) != 1)
            for a, b in zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True):
                out.append((asked["to"][k].as_py(), key[0], a, b" ".join(words[a : b + window]).decode()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["block", "ref_doc", "ref_start", "excerpt"])

    return _tidy_group(work)


class Reference:
    """The reference of a block: excerpts and an index of all their windows, the earliest place of each."""

    def __init__(self, excerpts: list[tuple[int | None, int, str]], window: int):
        self.window = window
        self.docs = np.array([_FIRST if d is None else d for d, _, _ in excerpts], dtype=np.int64)
        self.firsts = np.array([s for _, s, _ in excerpts], dtype=np.int64)
        self.words = [words_of(t) for _, _, t in excerpts]
        self.hashes = [word_hashes(w) for w in self.words]
        keys = [window_hashes(h, window) for h in self.hashes]
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        at = np.concatenate([np.arange(len(k)) for k in keys]) if keys else which
        order = np.lexsort((self.firsts[which] + at, self.docs[which], key))
        order = order[np.append(True, key[order][1:] != key[order][:-1])[: len(order)]]
        self.key, self.which, self.at = key[order], which[order], at[order]

    def seeds(self, hashes: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts of a document's windows that the index holds at an earlier place, their rows of the index)."""
        wins = window_hashes(hashes, self.window)
        if not len(self.key) or not len(wins):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        row = np.minimum(np.searchsorted(self.key, wins), len(self.key) - 1)
        ref_doc, ref_start = self.docs[self.which[row]], self.firsts[self.which[row]] + self.at[row]
        earlier = (ref_doc < doc) | ((ref_doc == doc) & (ref_start < np.arange(len(wins))))
        start = np.flatnonzero((self.key[row] == wins) & earlier)
        return start, row[start]


def _agreeing(words: list[bytes], hashes: np.ndarray, i: int, other: list[bytes], other_hashes: np.ndarray, o: int) -> int:
    """How many words from place i and place o on are the same."""
    most, n, step = min(len(words) - i, len(other) - o), 0, 64
    while n < most:
        step = min(2 * step, most - n)
        same = hashes[i + n : i + n + step] == other_hashes[o + n : o + n + step]
        if not same.all():
            n += int(same.argmin())
            break
        n += step
    if words[i : i + n] != other[o : o + n]:  # unequal words of one hash
        n = next(k for k in range(n) if words[i + k] != other[o + k])
    return n


def parse(words: list[bytes], doc: int | None, reference: Reference) -> list[tuple[int, int, int | None, int]]:
    """Greedy factors (start, end, ref_doc, ref_start) of one document, each of a window or more."""
    hashes, window = word_hashes(words), reference.window
    own = int(_FIRST) if doc is None else doc
    starts, rows = reference.seeds(hashes, own)
    out, k = [], 0
    while k < len(starts):
        i, row = int(starts[k]), rows[k]
        which, at = reference.which[row], int(reference.at[row])
        n = _agreeing(words, hashes, i, reference.words[which], reference.hashes[which], at)
        if n < window:  # the index knew the hash, not the words
            k += 1
            continue
        ref_doc = int(reference.docs[which])
        out.append((i, i + n, None if ref_doc == _FIRST else ref_doc, int(reference.firsts[which]) + at))
        # the next one to look at is the first that crosses the end of this factor
        k = int(np.searchsorted(starts, i + n - window + 1))
    return out


_FACTORS = "array<struct<start:int,end:int,ref_doc:bigint,ref_start:int>>"
_PARSED = f"doc_id long, tie long, n_words long, n_removed long, kept string, factors {_FACTORS}"
_ARROW_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))


def _parsed(window: int):
    """A block's texts and its reference -> what is left of each text."""

    def work(texts: pa.Table, excerpts: pa.Table) -> pa.Table:
        reference = Reference(list(zip(excerpts["ref_doc"].to_pylist(), excerpts["ref_start"].to_pylist(), excerpts["excerpt"].to_pylist(), strict=True)), window)
        n_words, n_removed, kept, factors = [], [], [], []
        for j, doc in enumerate(texts["doc_id"].to_pylist()):
            words = words_of(texts["text"][j].as_py())
            found = parse(words, doc, reference)
            gone = np.zeros(len(words), dtype=bool)
            for start, end, _, _ in found:
                gone[start:end] = True
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words).decode())
            factors.append([dict(zip(("start", "end", "ref_doc", "ref_start"), x, strict=True)) for x in found])
        columns = [texts["doc_id"], texts["tie"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(factors, _ARROW_FACTORS)]
        return pa.table(columns, names=["doc_id", "tie", "n_words", "n_removed", "kept", "factors"])

    return _tidy_group(work)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tie"] == right["tie"])


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of the keyed documents."""
    return texts.join(small_side(keys), _same(texts, keys), "left_semi")


def find_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, tie of texts that equal one of a lower doc_id; doc_id, tie, times of other rows that are there several times; bytes of all texts)."""
    digest = hex_digest(F.coalesce("text", F.lit(""))).alias("h")
    light = materialize(_keyed(docs).select("doc_id", "tie", digest, F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")), "texts")
    first = light.groupBy("h").agg(F.min(F.struct("doc_id")).alias("f"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h", "rows", F.col("f.doc_id").alias("ref_doc"))
    total = light.count()
    copies = join_counted(light, materialize(first, "first-texts"), "h", "rows", total).where("doc_id > ref_doc or (ref_doc is null and doc_id is not null)").select("doc_id", "tie").distinct()
    copies = materialize(copies, "copies")
    several = light.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    several = several.join(small_side(copies), _same(several, copies), "left_anti")
    return copies, materialize(several, "repeated"), light.agg(F.sum("bytes")).first()[0] or 0


def factor_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tie of copies; doc_id, tie, times of repeated rows; doc_id, tie, n_words, n_removed, kept, factors of every
    other document that has words in common with itself or another one, once for all its rows)."""
    copies, several, size = find_copies(docs)
    texts = _keyed(docs)
    texts = texts.join(small_side(copies), _same(texts, copies), "left_anti")
    if several.limit(1).count():
        once = _only(texts, several).groupBy("doc_id", "tie").agg(F.first("text").alias("text"))
        texts = texts.join(small_side(several), _same(texts, several), "left_anti").unionByName(once)
    shared = texts.mapInArrow(tidy(_scan(window, gram)), _ANCHORS)
    shared = shared.withColumn("held", F.sum("weight").over(Window.partitionBy("anchor", "salt"))).where("held > 1")
    hits = materialize(shared.groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places")), "anchors")
    keys = hits.select("doc_id", "tie")
    blocks = int(-(-size // block_bytes)) or 1
    block = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(blocks)).cast("int").alias("block")
    asking = _only(texts, keys).select("doc_id", "tie", "text", block)
    windows = asking.groupBy("block").cogroup(hits.select("doc_id", "tie", "places", block).groupBy("block")).applyInArrow(_windows(window, gram), _WINDOWS)
    here = F.struct("doc_id", "start")
    first = F.min(F.struct("doc_id", "start", "tie")).over(Window.partitionBy("win", "win2"))
    windows = windows.withColumn("first", first).where((F.col("n") > 1) | (here > F.struct("first.doc_id", "first.start")))
    asked = windows.select(F.col("block").alias("to"), "first.*").groupBy("doc_id", "tie", "to").agg(F.collect_list("start").alias("starts"))
    asked = materialize(asked.select("doc_id", "tie", "to", "starts", block), "requests")
    # a block that very many others refer to answers them in several groups
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / REQUESTS).cast("int").alias("parts")).where("parts > 1")
    parts = small_side(materialize(parts, "parts"))
    salted = asked.join(parts, "block", "left").withColumn("salt", F.pmod("to", F.coalesce("parts", F.lit(1)))).drop("parts")
    holding = _only(texts, asked.select("doc_id", "tie").distinct()).select("doc_id", "tie", "text", block).join(parts, "block", "left")
    holding = holding.withColumn("salt", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)"))).drop("parts")
    excerpts = holding.groupBy("block", "salt").cogroup(salted.groupBy("block", "salt")).applyInArrow(_cut(window), _EXCERPTS)
    parsed = asking.groupBy("block").cogroup(excerpts.groupBy("block")).applyInArrow(_parsed(window), _PARSED)
    return copies, several, materialize(parsed, "parsed")


def _plain(window: int):
    """Texts without factors, and copies (all gone, if a window fits in)."""

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                n_words, n_removed, kept = [], [], []
                for text, copy in zip(part.column("text").to_pylist(), part.column("copy").to_pylist(), strict=True):
                    words = words_of(text)
                    gone = copy and len(words) >= window
                    n_words.append(len(words))
                    n_removed.append(len(words) if gone else 0)
                    kept.append(b"" if gone else b" ".join(words))
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return work


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    copies, several, parsed = factor_documents(docs, window, gram, block_bytes)
    marks = materialize(copies.select("doc_id", "tie", F.lit(True).alias("copy")).unionByName(parsed.select("doc_id", "tie", F.lit(False).alias("copy"))), "marked")
    keyed = _keyed(docs)
    marked = keyed.join(small_side(marks), _same(keyed, marks), "left").where("copy is null or copy").select(keyed["doc_id"], "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    plain = marked.mapInArrow(tidy(_plain(window)), "doc_id long, n_words long, n_removed long, kept string")
    times = parsed.join(small_side(several), _same(parsed, several), "left").select(parsed["doc_id"], "n_words", "n_removed", "kept", F.explode(F.expr("sequence(1, cast(coalesce(times, 1) as int))")))
    return plain.unionByName(times.drop("col"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: what is left of every document."""
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
