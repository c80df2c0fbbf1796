"""Long inputs take time in proportion; rare lettered documents among many letterless ones are learned."""

import hashlib
import time

from pyspark.sql import functions as F

from meterwright.llm import chat, languages, private


def seconds(work, *args):
    began = time.perf_counter()
    work(*args)
    return time.perf_counter() - began


def values(n):
    kinds = ["4111 1111 1111 1111", "mail{k}@host.example", "10.0.{k}.7", "1984-02-29", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1112"]
    return " ; ".join(kinds[k % len(kinds)].format(k=k % 200) for k in range(n))


def test_many_private_values_of_one_text():
    p = private.Permuter("k")
    private.pseudonymize(values(100), p)
    short, long = values(8_000), values(32_000)
    assert seconds(private.pseudonymize, long, p) < 4 * 2.3 * max(seconds(private.pseudonymize, short, p), 0.05)
    new, spans = private.pseudonymize(short, p)
    assert len(spans) >= 8_000 * 4 // 6 and private.pseudonymize(new, p, back=True)[0] == short
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_taken_spans():
    spans = private.Taken([(2, 4, "x"), (7, 9, "y")])
    for start in range(11):
        for end in range(start + 1, 12):
            assert spans.meets(start, end) == any(start < e and s < end for s, e in ((2, 4), (7, 9)))


def test_many_turns_of_one_conversation(spark):
    def table(n):
        turn = F.col("id") % 2 == 0
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(turn, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<b> é & "), "id").alias("text"))
        done = chat.format_chat(rows).withColumn("turns", chat.read_back(F.col("formatted")))
        return done.withColumn("loss", chat.loss_text_of_turns(F.col("turns"), F.col("loss_turns")))

    digest = lambda n: table(n).select(F.sha2("loss", 256).alias("h"), F.size("turns").alias("n")).first()
    digest(100)
    times = [seconds(digest, n) for n in (20_000, 80_000)]
    assert times[1] < 4 * 2.3 * max(times[0], 0.5)
    assert digest(20_000) == (hashlib.sha256("".join(f"<b> é & {k}" for k in range(1, 20_000, 2)).encode()).hexdigest(), 20_000)


def test_text_of_loss_turns_is_that_of_the_spans(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), ("assistant", "<x>&amp;"), ("assistant", None), ("system", ""), ("assistant", "é\n</turn>")])] + [(2, 0, "user", "only")]
    done = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    both = done.select(chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("a"), chat.loss_text_of_turns(chat.read_back(F.col("formatted")), F.col("loss_turns")).alias("b"))
    assert {(r.a, r.b) for r in both.collect()} == {("<x>&amp;é\n</turn>",) * 2, ("", "")}


def test_letterless_documents_do_not_hide_a_language(spark):
    letterless = [(k, f"{k} 12.5 % ...", "es") for k in range(5000)]
    lettered = [(10_000 + k, "el perro come pan", "es") for k in range(40)] + [(20_000 + k, "the dog eats bread", "en") for k in range(300)]
    df = spark.createDataFrame(letterless + lettered + [(30_000, None, "es"), (30_001, "", "fr"), (30_002, "1", "de")], "doc_id long, text string, lang string")
    model = languages.fit(df, per_language=100)
    assert model.languages == ["en", "es"]
    out = languages.identify(df, model)
    assert {(r.doc_id // 10_000, r.lang_pred) for r in out.collect()} == {(0, "und"), (1, "es"), (2, "en"), (3, "und")}
