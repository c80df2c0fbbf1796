"""Language identification: family first, then one-versus-one linear SVMs.

A text is a vector of hashed character n-grams (one to three, lower case),
square-rooted and scaled to length one. A linear support vector machine for
each language family tells the families apart; within the winning family, one
machine for every pair of its languages votes, and margins break ties.

The machines are trained by dual coordinate descent on at most
``TRAIN_PER_LANGUAGE`` whole texts of each language, those of lowest hash of
their doc_id among the labelled documents outside the held-out fifth. A
histogram of the hashes by language tells up to where they are needed, so no
language's documents are sorted or shuffled as a whole. That bounded sample is
the only thing that meets in one task. Predicting reads every whole text once
and shuffles nothing.

Defined results: null text, or one without a letter, is ``und`` with score 0;
a null doc_id is neither held out nor trained on; a label without a lettered
text is not learned; with one learned language every lettered text is of that
language, without any it is ``und``; ties between languages go to the first by
name; a language's name may hold any characters; repeated rows are predicted
one by one; other columns pass through ``identify`` whatever their names, only
lang_pred and score are replaced.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, release_memory, tidy, unused

#: Most documents of a language that the machines are trained on.
TRAIN_PER_LANGUAGE = 600
#: Families of closely related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}
FEATURES = 4096
UNKNOWN = "und"
#: Leading bits of a document's hash that name its cell in the histogram of a language.
CELL_BITS = 12
#: Slope by which a margin becomes a score.
SLOPE = 3.0
#: Margin weight, epochs and seed of the training.
COST, EPOCHS, SEED = 10.0, 30, 7

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed counts of one to three characters, square-rooted, of length one."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    one = points * _A
    total = np.bincount((one ^ (one >> np.uint32(15))) % FEATURES, minlength=FEATURES)
    if len(points) > 1:
        two = one[:-1] * _C + points[1:] * _B
        total += np.bincount((two ^ (two >> np.uint32(13))) % FEATURES, minlength=FEATURES)
    if len(points) > 2:
        three = two[:-1] * _C + points[2:] * _A
        total += np.bincount((three ^ (three >> np.uint32(14))) % FEATURES, minlength=FEATURES)
    x = np.sqrt(total).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge), the last one for the bias; y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    # both sides weigh the same
    cost = np.where(y > 0, COST / max((y > 0).mean() * 2, 1e-9), COST / max((y < 0).mean() * 2, 1e-9))
    diagonal = (x * x).sum(axis=1) + 1 / (2 * cost)
    alpha, w, rng = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        moved = 0.0
        for k in rng.permutation(len(x)):
            gradient = y[k] * (x[k] @ w) - 1 + alpha[k] / (2 * cost[k])
            new = max(alpha[k] - gradient / diagonal[k], 0.0)
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-4:
            break
    return w


#: Machine of one family against all others, or of two languages of one family: ("family", name, None) or ("pair", name, name).
Name = tuple[str, str, str | None]


class Model:
    """Machines by name, and the learned languages."""

    def __init__(self, machines: dict[Name, np.ndarray], languages: list[str]):
        self.languages = sorted(languages)
        self.families = sorted({FAMILY_OF.get(x, x) for x in self.languages})
        self.members = {f: [x for x in self.languages if FAMILY_OF.get(x, x) == f] for f in self.families}
        names = sorted(machines, key=str)
        self.weights = np.stack([machines[n] for n in names], axis=1) if names else np.zeros((FEATURES + 1, 0))
        self.at = {n: k for k, n in enumerate(names)}

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        margins = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-SLOPE * margins))
        out, scores = [], []
        for margin, chance in zip(margins, sure, strict=True):
            family, score = self.families[0], 1.0
            if len(self.families) > 1:
                each = [margin[self.at["family", f, None]] for f in self.families]
                family = self.families[int(np.argmax(each))]
                score = float(chance[self.at["family", family, None]])
            votes = dict.fromkeys(self.members[family], 0)
            lead = dict.fromkeys(self.members[family], 0.0)
            for a, b in combinations(self.members[family], 2):
                k = self.at["pair", a, b]
                votes[a if margin[k] >= 0 else b] += 1
                lead[a] += margin[k]
                lead[b] -= margin[k]
            best = max(self.members[family], key=lambda x: (votes[x], lead[x]))
            for other in self.members[family]:
                if other != best:
                    a, b = sorted((best, other))
                    c = float(chance[self.at["pair", a, b]])
                    score = min(score, c if a == best else 1 - c)
            out.append(best)
            scores.append(score)
        return out, scores


def _train(texts: list[str], lang: list[str]) -> dict[Name, np.ndarray]:
    """Lettered texts and their languages -> machines; one language needs none."""
    x, lang = np.stack([features(t) for t in texts]), np.array(lang, dtype=object)
    family = np.array([FAMILY_OF.get(v, v) for v in lang], dtype=object)
    machines: dict[Name, np.ndarray] = {}
    names = sorted(set(family))
    for f in names if len(names) > 1 else ():
        machines["family", f, None] = train_svm(x, np.where(family == f, 1.0, -1.0))
    for f in names:
        for a, b in combinations(sorted(set(lang[family == f])), 2):
            some = (lang == a) | (lang == b)
            machines["pair", a, b] = train_svm(x[some], np.where(lang[some] == a, 1.0, -1.0))
    return machines


def draw_sample(light: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang) of distinct documents -> at most ``per_language`` of each language, those of lowest hash."""
    celled = light.withColumn("cell", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - CELL_BITS).cast("int"))
    counts = celled.groupBy("lang", "cell").agg(F.count(F.lit(1)).alias("n"))  # at most 2 ** CELL_BITS rows a language
    before = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < per_language)
    last = needed.groupBy("lang").agg(F.max("cell").alias("last"))  # one row a language
    near = celled.join(F.broadcast(last), "lang").where(F.col("cell") <= F.col("last"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("cell", F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("doc_id", "lang")


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Trains on a bounded sample of the labelled documents outside the held-out fifth."""
    open_rows = docs.where("crc32(cast(doc_id as string)) % 5 <> 0 and lang is not null").select(F.col("doc_id").cast("long"), "lang", "text")
    # drawn among lettered rows only, so that letterless ones do not use up the bound; of several rows of one document, the lowest label
    open_rows = open_rows.where(F.col("text").rlike(r"\p{L}"))
    light = open_rows.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    drawn = materialize(draw_sample(light, per_language), "drawn")
    sample = open_rows.join(F.broadcast(drawn), ["doc_id", "lang"], "left_semi")  # at most per_language rows a language

    def lettered(batches):
        for f in batches:
            yield f[[has_letter(t) for t in f["text"]]][["doc_id", "lang", "text"]].assign(model=0)

    def work(rows):
        rows = rows.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        texts, lang = rows["text"].tolist(), rows["lang"].tolist()
        out = [("language", x, None, b"") for x in sorted(set(lang))]
        out += [(*name, w.astype("<f8").tobytes()) for name, w in _train(texts, lang).items()]
        return pd.DataFrame(out, columns=["kind", "a", "b", "weights"])

    sample = sample.mapInPandas(tidy(lettered), "doc_id long, lang string, text string, model int")
    rows = sample.groupBy("model").applyInPandas(work, "kind string, a string, b string, weights binary").collect()  # one row a machine or language
    machines = {(r["kind"], r["a"], r["b"]): np.frombuffer(r["weights"], dtype="<f8") for r in rows if r["kind"] != "language"}
    return Model(machines, [r["a"] for r in rows if r["kind"] == "language"])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    model = model or fit(docs)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            there = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
            for k in range(0, len(there), 500):
                some = there[k : k + 500]
                for j, name, score in zip(some, *model.predict(np.stack([features(texts.iloc[j]) for j in some])), strict=True):
                    names[j], scores[j] = name, score
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        release_memory()

    guess = unused("guess", docs.columns)
    out = docs.withColumn(guess, predicted("text"))
    return out.withColumns({"lang_pred": F.col(guess)["lang_pred"], "score": F.col(guess)["score"]}).drop(guess)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    light = docs.select("doc_id", held.alias("held_out"), "text")
    return identify(light, model).select("doc_id", "held_out", "lang_pred", "score")
