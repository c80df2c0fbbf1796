"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves.

A text is cut into paragraphs (lines with their line ends), each into leaves
of a few sentences; a leaf ends with a sentence whose own hash says so and a
section with a paragraph whose hash says so, so that they find their ends
again after an insertion. Every character is in one leaf. A leaf's hash is
that of its text, a paragraph's that of its leaves' hashes, a section's that of
its paragraphs', and the root's that of the sections' hashes: roots are equal
where texts are equal. The fingerprint writes the root and the leaves,

    ROOT:LEAF,LEAF;LEAF/LEAF;...

with ``/`` between sections, ``;`` between paragraphs, and a leaf as 16
hexadecimal digits and its size in base 36. The hashes in between follow from
the leaves, and reading a fingerprint works them out and checks the root.

Two trees are compared from the top: sections of equal hash are passed over
whole, then paragraphs of equal hash in what is left, then leaves. What stays
without a partner is where the texts differ. Likeness is the share of
characters that found a partner.

To fingerprint each document against the next by doc_id, documents are range
partitioned and sorted once; within a task the next row is at hand, and only
the last row of each task waits for the first row of the next one: as many
rows as there are partitions.

Defined results: null text is empty, an empty text has a root only, and two
empty texts are alike (1.0), while an empty and another text are not (0.0);
texts of the same leaves in another order are a little less than alike; rows
are ordered by doc_id (null first), then text, so ties and repeated rows follow
each other, and many rows of one doc_id are dealt over tasks by the beginning
of their text; one row alone is its own next document; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._common import materialize, tidy

#: Longest piece in characters where no sentence ends.
PIECE = 256
#: One piece in so many ends a leaf, and a leaf has at most so many pieces.
LEAF, MOST_PIECES = 3, 24
#: One paragraph in so many ends a section.
SECTION = 4
#: Leading characters of a text by which rows of one doc_id are dealt over tasks.
TIE_CHARS = 64

_PIECE = re.compile(rf"[^.!?\n]{{0,{PIECE}}}(?:[.!?]+\n?|\n)|[^.!?\n]{{1,{PIECE}}}")
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


class Node(NamedTuple):
    """A branch of the tree: its hash, characters below it, branches below it (none below a leaf)."""

    digest: int
    size: int
    below: tuple[Node, ...] = ()


def _joined(below: Iterable[Node]) -> Node:
    below = tuple(below)
    return Node(xxh3_64_intdigest(b"".join(n.digest.to_bytes(8, "big") for n in below)), sum(n.size for n in below), below)


def root(sections: list[Node]) -> str:
    """The hash over the sections' hashes, in hexadecimal."""
    return hashlib.blake2b(b"".join(n.digest.to_bytes(8, "big") for n in sections), digest_size=16).hexdigest()


def grow(text: str) -> list[Node]:
    """The sections of a text's tree."""
    sections, section, paragraph, pieces = [], [], [], []

    def end_section() -> None:
        sections.append(_joined(section))
        section.clear()

    def end_paragraph() -> None:
        section.append(_joined(paragraph))
        paragraph.clear()
        if section[-1].digest % SECTION == 0:
            end_section()

    def end_leaf() -> None:
        leaf = "".join(pieces)
        paragraph.append(Node(xxh3_64_intdigest(leaf), len(leaf)))
        pieces.clear()

    for piece in _PIECE.findall(text):
        pieces.append(piece)
        last = piece[-1] == "\n"
        if last or len(pieces) == MOST_PIECES or xxh3_64_intdigest(piece) % LEAF == 0:
            end_leaf()
            if last:
                end_paragraph()
    if pieces:
        end_leaf()
    if paragraph:
        end_paragraph()
    if section:
        end_section()
    return sections


def _base36(n: int) -> str:
    out = ""
    while True:
        n, d = divmod(n, 36)
        out = _DIGITS[d] + out
        if not n:
            return out


def write(sections: list[Node]) -> str:
    """A tree as fingerprint."""
    named = "/".join(";".join(",".join(f"{leaf.digest:016x}{_base36(leaf.size)}" for leaf in p.below) for p in s.below) for s in sections)
    return f"{root(sections)}:{named}"


def read(mark: str) -> list[Node]:
    """A fingerprint's tree; raises if the root is not that of the leaves."""
    name, _, body = mark.partition(":")
    leaf = lambda x: Node(int(x[:16], 16), int(x[16:], 36))
    sections = [_joined(_joined(map(leaf, p.split(","))) for p in s.split(";")) for s in body.split("/")] if body else []
    if root(sections) != name:
        raise ValueError("the root does not belong to these leaves")
    return sections


def fingerprint(text: str) -> str:
    return write(grow(text))


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """(start, node) branches of either side that have no partner of equal hash on the other, each partner used once."""
    here, there = Counter(n.digest for _, n in a), Counter(n.digest for _, n in b)
    both = here & there
    rest = []
    for side in (a, b):
        used = both.copy()
        left = []
        for at, n in side:
            if used[n.digest] > 0:
                used[n.digest] -= 1
            else:
                left.append((at, n))
        rest.append(left)
    return rest[0], rest[1]


def _opened(branches: list) -> list:
    """The branches below, each with its place in the text."""
    out = []
    for at, n in branches:
        for child in n.below:
            out.append((at, child))
            at += child.size
    return out


def differing(a: list[Node], b: list[Node]) -> tuple[list, list]:
    """Leaves of two trees without a partner, as (start, leaf): only branches that differ are opened."""
    left = _unmatched(_opened([(0, _joined(a))]), _opened([(0, _joined(b))]))
    for _ in range(2):
        left = _unmatched(_opened(left[0]), _opened(left[1]))
    return left


def _likeness(a: list[Node], b: list[Node]) -> float:
    if [n.digest for n in a] == [n.digest for n in b]:
        return 1.0
    gone, new = differing(a, b)
    total = sum(n.size for n in a) + sum(n.size for n in b)
    # the same leaves in another order are a little less than alike
    return min(1 - sum(n.size for _, n in gone + new) / total, 0.999999)


def likeness(a: str, b: str) -> float:
    """Share of two fingerprints' characters that lie in branches with a partner of equal hash: 0 to 1."""
    return _likeness(read(a), read(b))


def _spans(leaves: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for at, n in leaves:
        if out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + n.size)
        else:
            out.append((at, at + n.size))
    return out


def edits(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where two texts differ, from their fingerprints: (spans of the first without a partner, spans of the second), in
    code points. Where only the order differs, the spans between the common beginning and the common end."""
    trees = read(a), read(b)
    gone, new = differing(*trees)
    if gone or new or a == b:
        return _spans(gone), _spans(new)
    rows = [_opened(_opened(_opened([(0, _joined(t))]))) for t in trees]
    same = [x.digest == y.digest for (_, x), (_, y) in zip(*rows, strict=True)]
    if all(same):  # the leaves are the same, only their paragraphs or sections are not
        return _spans(rows[0]), _spans(rows[1])
    first, last = same.index(False), len(same) - same[::-1].index(False)
    return _spans(rows[0][first:last]), _spans(rows[1][first:last])


class _Document:
    def __init__(self, doc_id, text):
        self.doc_id, self.text = doc_id, text or ""
        self.tree = grow(self.text)


def _compared(doc: _Document, following: _Document) -> dict:
    n, half = len(doc.text), len(doc.text) // 2
    edited = doc.text[: n - half] + following.text[:half]
    changed = grow(edited)
    return {
        "doc_id": doc.doc_id,
        "n_chars": n,
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": write(doc.tree),
        "edited_fingerprint": write(changed),
        "near_edited": _likeness(doc.tree, changed),
        "near_next": _likeness(doc.tree, following.tree),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [(n, pa.int64() if t == "long" else pa.float64() if t == "double" else pa.string()) for n, t in (x.split() for x in _RESULT.split(", "))]
    + [("part", pa.int64()), ("first_text", pa.string()), ("last_text", pa.string())]
)


def _neighbours(batches):
    """Sorted documents -> a result for all but the last, and the first and last texts of the task."""
    part, before, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(k, 200).columns), strict=True):
                doc = _Document(doc_id, text)
                if before is None:
                    out.append({"doc_id": doc_id, "part": part, "first_text": doc.text})
                else:
                    out.append(_compared(before, doc))
                before = doc
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
            out = []
    if before is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": before.doc_id, "part": part, "last_text": before.text}], schema=_ARROW)


def _ends(batches):
    for batch in batches:
        rows = [_compared(_Document(d, a), _Document(None, b)) for d, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([_ARROW.field(k) for k in range(7)]))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its text with the later half
    taken from the next document's beginning, and the likenesses."""
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, TIE_CHARS))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    done = materialize(ordered.mapInArrow(tidy(_neighbours), f"{_RESULT}, part long, first_text string, last_text string"), "fingerprints")
    # one light row per task; the last task is followed by the first
    parts = done.where("first_text is not null").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    parts = parts.select("part", following.alias("next"))
    lasts = done.where("last_text is not null").select("part", "doc_id", "last_text").join(parts, "part")
    firsts = done.where("first_text is not null").select(F.col("part").alias("next"), "first_text")
    ends = lasts.join(firsts, "next").select("doc_id", "last_text", "first_text").mapInArrow(tidy(_ends), _RESULT)
    return done.where("part is null").drop("part", "first_text", "last_text").unionByName(ends)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document against its edited text and the next document."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
