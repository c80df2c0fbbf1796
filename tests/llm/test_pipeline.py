"""The stages one after another, and the registered queries against their SQL."""

import collections
import hashlib
import math
import random
import re

import corpus_pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == given.columns, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        assert docs.count() > 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert packed[["doc_id", "piece"]].drop_duplicates().doc_id.nunique() == docs.select("doc_id").distinct().count()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, spans string, hidden string, row string, copies int, salt int"


def odd_rows():
    """Nulls in every column, empty texts, repeated rows, equal texts, rows of one id, a long text."""
    extra = ("a", "b", "c", "d", 7, 8)
    text = "The river runs past the old mill and on to the sea, where boats lie. Mail anna.b@example.com or call."
    rows = [(k, f"{text} Number {'abcdefghij'[k % 10] * 3} {k}.", "en", "ab"[k % 2], 1, *extra) for k in range(8)]
    rows += [(20, "", "en", "a", 0, *extra), (21, None, None, None, None, *[None] * 6), (22, "123 !?", "de", "b", 6, *extra), (None, text, None, "a", 1, *extra), (None, None, "en", None, None, *extra)]
    rows += [rows[3]] * 4 + [(30, rows[5][1], "en", "b", 1, *extra), (5, "other words of the same id that differ from the first", "en", "b", 1, *extra), (40, "word " * 30_000, "en", None, 1, *extra)]
    return rows


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() > 0 and stage(spark, empty, "unused").count() == 0, name
    name, pack = corpus_pipeline.STAGES[-1]
    assert pack(spark, docs, "unused").count() >= docs.count() and pack(spark, empty, "unused").count() == 0


def test_stages_one_by_one_against_plain_versions(spark):
    from test_operators import brute_components

    from meterwright.llm import languages, packing, private

    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(map(str, map(tuple, df.collect())))
    # a text with a letter is of some language
    assert plain(stages["language_id"](spark, docs, "")) == sorted(str(r) for r in rows if languages.has_letter(r[1]))
    judged = brute_components([r[:2] for r in rows])
    stay = {str(r) for r, (_, _, c) in zip(rows, judged) if r[0] is not None and (c is None or c == r[0])}
    assert plain(stages["near_duplicates"](spark, docs, "")) == sorted([*stay, *(str(r) for r in rows if r[0] is None)])
    p = private.Permuter(private.DEFAULT_KEY)
    hidden = [(r[0], t := None if r[1] is None else private.pseudonymize(r[1], p)[0], *r[2:4], None if t is None else len(t), *r[5:]) for r in rows]
    assert plain(stages["private_values"](spark, docs, "")) == sorted(map(str, hidden))
    mixed = stages["mixing"](spark, docs, "").collect()
    assert {str(tuple(r)) for r in mixed} <= {str(r) for r in rows}
    packed = stages["packing"](spark, docs, "").toPandas()
    ids = sum(len(packing.encoder(packing.default_tokenizer())(r[1] or "")) // 4 + 1 for r in rows)
    assert packed.length.sum() == ids and (packed.groupby("sequence_id").length.sum() <= 1024).all()


def plain_mix(rows):
    """(source, size) -> how many rows the mix takes of that size: targets by sharing again until no source is above its cap, then steps of a running sum."""
    sizes = [(r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    names = sorted({s for s, _ in sizes}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    own = collections.Counter()
    for s, n in sizes:
        own[s] += n
    target, left, some = {}, sum(own.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in some) if some else 0
        full = {s for s in some if level * weight[s] >= 3 * own[s]}
        if not full:
            break
        target |= {s: 3.0 * own[s] for s in full}
        left -= sum(3 * own[s] for s in full)
        some -= full
    target |= {s: level * weight[s] for s in some}
    want, taken = collections.Counter(), collections.Counter()
    for s in names:
        rate = target[s] / own[s] if own[s] else 0.0
        start = int(hashlib.sha256(("mix-1:" + ("\0null" if s is None else s)).encode()).hexdigest()[:8], 16) / 2**32
        for rank, n in enumerate(sorted((n for t, n in sizes if t == s), reverse=True), 1):
            want[s, n] += math.floor(rank * rate + start) - math.floor((rank - 1) * rate + start)
    for (s, n), times in want.items():
        taken[s] += n * times
    assert all(abs(taken[s] - target[s]) <= max(n for t, n in sizes if t == s) for s in names)
    return +want


def test_mixing_stage_against_a_plain_mix(spark):
    rng = random.Random(11)
    words = "river mill sea boat harbour wind light stone field road".split()
    tail = ("a", "b", "c", "d", 7, 8)
    rows = [(k, " ".join(rng.choices(words, k=rng.choice((3, 20, 21, 80)))), "en", rng.choice(("news", "web", "web", "web", "books", None)), 1, *tail) for k in range(300)]
    # a small source is capped, one without words gives nothing, one is a single long text
    rows += [(400, "one two three", "en", "aa", 1, *tail), (401, "", "en", "empty", 0, *tail), (402, None, "en", "empty", 0, *tail), (403, "long " * 5000, "en", "zz", 1, *tail)]
    for given in (rows, odd_rows()):
        docs = spark.createDataFrame(given, SCHEMA)
        got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "").collect()]
        assert {str(r) for r in got} <= {str(r) for r in given}
        size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert collections.Counter((r[3], size(r[1])) for r in got) == plain_mix(given)
        # no row more than three times: equal rows share what they get
        before = collections.Counter(map(str, given))
        assert all(n <= 3 * before[r] for r, n in collections.Counter(map(str, got)).items())


def test_packing_stage_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from meterwright.llm import packing

    rows = [r for r in odd_rows() if r[0] != 40] + [(50, "packing of a long text, with numbers 1 2 3. " * 400, "en", "a", 1, *[None] * 6)]
    got = dict(corpus_pipeline.STAGES)["packing"](spark, spark.createDataFrame(rows, SCHEMA), "").toPandas()
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID]
        want.append((-1 if r[0] is None else r[0], len(ids)))
    pieces = got.assign(doc_id=got.doc_id.astype(object).where(got.doc_id.notna(), -1))
    assert sorted((int(d), int(n)) for d, n in pieces.groupby("doc_id").length.sum().items()) == sorted({d: sum(n for e, n in want if e == d) for d, _ in want}.items())
    # only texts of more than a sequence are cut, and all pieces but one of theirs are whole sequences
    assert set(pieces[pieces.piece > 0].doc_id) == {d for d, n in want if n > 1024} == {50}
    assert sorted(pieces[pieces.doc_id == 50].length)[1:] == [1024] * (len(pieces[pieces.doc_id == 50]) - 1)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum()[:-1]] and seq.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 1024) + 1
