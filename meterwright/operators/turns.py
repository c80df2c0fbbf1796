"""Rows and user turns: assignment, crossings, tags, merges of compaction agents, and compact conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import last_before
from .ledger import context_tokens

WARN_E8, DANGER_E8 = 80_000_000, 250_000_000


def row_to_turn(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The greatest user line at or before the row's line; compaction marks look one line further."""
    shifted = rows.withColumn("_at", F.col("line") + (F.col("is_mark").cast("int") if "is_mark" in rows.columns else 0))
    marks = users.select("sid", F.col("line").alias("user_line"), *[c for c in users.columns if c == "text"])
    payload = {"user_line": "turn"} | ({"text": "prompt"} if "text" in users.columns else {})
    return last_before(shifted, marks, ["sid"], "_at", "user_line", payload).drop("_at")


def turn_aggregate(rows: DataFrame) -> DataFrame:
    """Tokens, cost, calls, first context and the call with most context of each user turn."""
    calls = rows.where("turn is not null and (cost_e8 > 0 or input > 0)")
    return calls.groupBy("sid", "turn").agg(
        F.sum("input").alias("input"),
        F.sum("cc").alias("cc"),
        F.sum("cr").alias("cr"),
        F.sum("out").alias("out"),
        F.sum("cost_e8").alias("cost_e8"),
        F.count(F.lit(1)).alias("calls"),
        F.min_by(context_tokens(), "line").alias("first_context"),
        F.max(F.struct(context_tokens().alias("context"), (-F.col("line")).alias("l"), "cost_e8")).alias("p"),
        F.max(F.coalesce(F.array_contains("evt", "ctx_danger"), F.lit(False))).alias("ctx_danger"),
        F.max(F.coalesce(F.array_contains("evt", "ctx_warn"), F.lit(False))).alias("ctx_warn"),
        F.max(F.coalesce(F.array_contains("evt", "heuristic_resume"), F.lit(False))).alias("resume"),
    ).select("*", F.col("p.context").alias("peak_context"), F.col("p.cost_e8").alias("peak_cost_e8")).drop("p")


def turn_alerts(turns: DataFrame) -> DataFrame:
    """Flags of each turn; those without a mark, cost or context flag go (a resume flag alone keeps none)."""
    danger, warn = F.col("cost_e8") >= DANGER_E8, F.col("cost_e8") >= WARN_E8
    flags = F.array_compact(
        F.array(
            F.when(danger, "cost-danger").when(warn, "cost-warn"),
            F.when(F.col("ctx_danger"), "ctx-danger").when(F.col("ctx_warn"), "ctx-warn"),
            F.when(F.col("resume"), "resume-heuristic"),
        )
    )
    marked = F.col("has_mark") if "has_mark" in turns.columns else F.lit(False)
    return turns.withColumn("alert", F.array_join(flags, "+")).where(warn | F.col("ctx_danger") | F.col("ctx_warn") | marked)


def first_crossing(rows: DataFrame, pricing: DataFrame, default_window: int = 200_000) -> DataFrame:
    """Adds ctx_tag where the context level (35 %, 70 %) exceeds every earlier one of the session."""
    order = Window.partitionBy("sid").orderBy("ts_s", "line")
    model = F.last("model", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    known = rows.withColumn("_model", model).join(F.broadcast(pricing.select(F.col("model").alias("_model"), "context_window")), "_model", "left")
    share = context_tokens() / F.coalesce("context_window", F.lit(default_window))
    level = F.when((F.col("cost_e8") <= 0) & (F.col("input") <= 0), 0).when(F.col("_model").isNull(), 0).when(share >= 0.70, 2).when(share >= 0.35, 1).otherwise(0)
    known = known.withColumn("_level", level)
    before = F.coalesce(F.max("_level").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tag = F.when(F.col("_level") > F.col("_before"), F.when(F.col("_level") == 2, "ctx_danger").otherwise("ctx_warn"))
    return known.withColumn("_before", before).withColumn("ctx_tag", tag).drop("_model", "_level", "_before", "context_window")


def call_cost_band(rows: DataFrame) -> DataFrame:
    """W14."""
    return rows.withColumn("cost_tag", F.when(F.col("cost_e8") >= 100_000_000, "cost_danger").when(F.col("cost_e8") >= 50_000_000, "cost_warn"))


def resume_heuristic(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """A large write soon after the previous call, with no session mark between the two."""
    calls = rows.withColumn("_mark", F.lit(0))
    both = calls.unionByName(marks.select("sid", "ts_s", "line", F.lit(1).alias("_mark")), allowMissingColumns=True)
    order = Window.partitionBy("sid").orderBy("ts_s", "line")
    both = both.withColumn("_seen", F.sum("_mark").over(order))
    calls = both.where("_mark = 0")
    calls = calls.withColumns({"_last": F.lag("ts_s").over(order), "_then": F.coalesce(F.lag("_seen").over(order), F.lit(0))})
    is_resume = (F.col("_seen") == F.col("_then")) & (F.col("cc") >= 10000) & (F.col("cc") >= 2 * F.col("input")) & (F.coalesce("_last", F.lit(0)) > 0) & (F.col("ts_s") - F.col("_last") < 3600)
    return calls.withColumn("resume", is_resume).drop("_mark", "_seen", "_last", "_then")


def merge_compact_agents(marks: DataFrame, agents: DataFrame) -> DataFrame:
    """Of the agents of one parent and context size the dearest is added to the mark; dropped cost is told."""
    best = agents.groupBy("parent", "context").agg(F.max_by(F.struct("sid", "tokens", "cost_e8", "model"), F.struct("cost_e8", "sid")).alias("a"), F.sum("cost_e8").alias("all_e8"))
    joined = marks.join(best.withColumnRenamed("parent", "_p").withColumnRenamed("context", "_c"), (F.col("sid") == F.col("_p")) & (F.col("context") == F.col("_c")), "left")
    return joined.select(
        "sid", "line", "context", F.col("a.sid").alias("agent"), F.coalesce("a.cost_e8", F.lit(0)).alias("cost_e8"), F.coalesce("a.tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("all_e8") - F.col("a.cost_e8"), F.lit(0)).alias("dropped_e8")
    )


def attach_nearest(items: DataFrame, rows: DataFrame, key: str, time: str = "ts_s") -> DataFrame:
    """Each item's nearest row of its key in time; the earlier one wins a tie."""
    named = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), "line")
    base = items.withColumn("_k", F.col(key))
    back = last_before(base, named, ["_k"], time, "_t", {"_t": "_back_t", "line": "_back"}, ["line"])
    mirrored = named.withColumn("_t", -F.col("_t"))
    both = last_before(back.withColumn("_neg", -F.col(time)), mirrored, ["_k"], "_neg", "_t", {"_t": "_ahead_t", "line": "_ahead"}, ["line"])
    ahead = (F.col("_back_t").isNull()) | ((-F.col("_ahead_t") - F.col(time)) < (F.col(time) - F.col("_back_t")))
    return both.withColumn("nearest", F.when(ahead & F.col("_ahead").isNotNull(), F.col("_ahead")).otherwise(F.col("_back"))).drop("_k", "_neg", "_back", "_back_t", "_ahead", "_ahead_t")


#: Stretches of one session that are settled together.
STRETCHES = 64


def merge_nearest_once(marks: DataFrame, agents: DataFrame, most: int = 600) -> DataFrame:
    """Marks in order, each takes the nearest agent of its session that is still free, at most ``most`` seconds away.

    Sessions are cut where both sides together pause for longer than that. A stretch that has marks only or agents only
    has nothing to settle and goes no further; the others are settled in order, ``STRETCHES`` neighbouring ones in a
    grouped task; a mark finds the free times around it without a scan. Rows without a time meet nothing.
    """
    from bisect import bisect_right

    import pandas as pd

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        waiting: dict[int, list] = {}
        for a in right.sort_values(["ts_s", "agent"], ascending=False).itertuples(index=False):
            waiting.setdefault(a.ts_s, []).append(a.agent)
        times, out = sorted(waiting), []
        # place k + 1 stands for times[k]; used up times point on to the next one that may be free
        down, up = list(range(len(times) + 2)), list(range(len(times) + 2))

        def free(way: list[int], k: int) -> int:
            while way[k] != k:
                way[k] = way[way[k]]
                k = way[k]
            return k

        for m in left.sort_values(["ts_s", "line"]).itertuples(index=False):
            at = bisect_right(times, m.ts_s)
            near = [k for k in (free(down, at), free(up, at + 1)) if 0 < k <= len(times)]
            k = min(near, key=lambda k: (abs(times[k - 1] - m.ts_s), k), default=None)
            if k is not None and abs(times[k - 1] - m.ts_s) <= most:
                some = waiting[times[k - 1]]
                out.append((m.sid, m.line, some.pop()))
                if not some:
                    down[k], up[k] = k - 1, k + 1
        return pd.DataFrame(out, columns=["sid", "line", "agent"])

    both = marks.select("sid", "ts_s", "line", F.lit(None).cast("string").alias("agent"), F.lit(True).alias("mark"))
    both = both.unionByName(agents.select("sid", "ts_s", F.lit(None).cast("long").alias("line"), F.col("agent").cast("string"), F.lit(False).alias("mark"))).where("ts_s is not null")
    order = Window.partitionBy("sid").orderBy("ts_s")
    starts = F.coalesce((F.col("ts_s") - F.lag("ts_s").over(order) > most).cast("int"), F.lit(0))
    cut = both.withColumn("_new", starts).withColumn("_stretch", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))

    stretch = Window.partitionBy("sid", "_stretch")
    cut = cut.withColumn("_both", F.max("mark").over(stretch) & ~F.min("mark").over(stretch)).where("_both")
    cut = cut.withColumn("_group", F.floor(F.col("_stretch") / STRETCHES))

    def settled(rows: pd.DataFrame) -> pd.DataFrame:
        return settle(rows[rows["mark"]], rows[~rows["mark"]])

    return cut.select("sid", "_group", "ts_s", "line", "agent", "mark").groupBy("sid", "_group").applyInPandas(settled, "sid string, line long, agent string")


def group_turns(lines: DataFrame) -> DataFrame:
    """Replies belong to the user or system line before them; replies before any opener are dropped."""
    order = Window.partitionBy("sid").orderBy("line")
    opener = F.col("role").isin("user", "system")
    numbered = lines.withColumn("turn", F.sum(opener.cast("int")).over(order)).where("turn > 0")
    first = F.when(F.col("role").isin("user", "system"), F.struct("line", "role", "text"))
    return numbered.groupBy("sid", "turn").agg(
        F.min("line").alias("from_line"),
        F.max("line").alias("to_line"),
        F.min(first).alias("head"),
        F.array_sort(F.collect_list(F.when(~F.col("role").isin("user", "system"), F.struct("line", "text")))).alias("replies"),
    ).select("sid", "turn", "from_line", "to_line", F.col("head.role").alias("role"), F.col("head.text").alias("text"), "replies")


def restore_view(turns: DataFrame, boundary: DataFrame, keep: int = 24, head: int = 50) -> DataFrame:
    """Turns before the last boundary of their session; replies beyond the first and last ``keep`` are cut."""
    last = boundary.groupBy("sid").agg(F.max("line").alias("_end"))
    before = turns.join(last, "sid").where("from_line < _end").drop("_end")
    n = F.size("replies")
    cut = F.transform("replies", lambda r, k: F.when((k < keep) | (k >= n - keep), r["text"]).otherwise(F.substring(r["text"], 1, head)))
    return before.withColumn("replies", cut)


def budget_select(blocks: DataFrame, budget: int, heading: int = 0) -> DataFrame:
    """Newest first while the estimate fits; one token a block, the heading once."""
    order = Window.partitionBy("sid").orderBy(F.desc("line"))
    return blocks.withColumn("used", F.sum(F.col("tokens") + 1).over(order) + heading).where(F.col("used") <= budget)


def text_line_index(lines: DataFrame, chars: int = 120) -> DataFrame:
    """Line, role and the head of every spoken line."""
    return lines.where(F.col("role").isin("user", "assistant")).select("sid", "line", "role", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, chars).alias("head"))


#: Cells (words times queries) up to which a block of queries is one matrix in a task's memory, and turns that are scored at once.
QUERY_CELLS, TURN_BLOCK = 4_000_000, 256


def _words(text) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def topic_turns(turns: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Turns (id, text) ranked for queries (query, text) by tf-idf of the shared words; top k each.

    No word is a key of a join, however common it is. The words asked for are counted in one pass over the turns; in
    another each turn is multiplied with the queries, and a task gives its own best k of each query only. Queries come in
    blocks, each a matrix of bounded size, so there may be many of them: a block costs a pass.
    """
    asked = queries.select("query", F.explode(_words("text")).alias("word")).where("word <> ''").distinct()
    blocks = _query_blocks(asked)
    out = None
    for names, words, matrix in blocks:
        best = _scored(turns, names, words, matrix, k)
        out = best if out is None else out.unionByName(best)
    if out is None:
        return turns.select("id").join(queries.select("query").limit(0), F.lit(True)).select("query", "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _query_blocks(asked: DataFrame):
    """(query, word) rows, ordered by query and read bit by bit -> (queries, words, 0/1 matrix words x queries) of bounded size."""
    import numpy as np

    names: list = []
    held: list[tuple[int, str]] = []
    words: dict[str, int] = {}

    def block():
        matrix = np.zeros((len(words), len(names)))
        for q, w in held:
            matrix[words[w], q] = 1
        return list(names), list(words), matrix

    for r in asked.orderBy("query", "word").toLocalIterator():
        if not names or r["query"] != names[-1]:
            if names and (len(words) + 1000) * (len(names) + 1) > QUERY_CELLS:
                yield block()
                names, held, words = [], [], {}
            names.append(r["query"])
        words.setdefault(r["word"], len(words))
        held.append((len(names) - 1, r["word"]))
    if names:
        yield block()


def _scored(turns: DataFrame, names: list, words: list[str], matrix, k: int) -> DataFrame:
    """query, id, score: of every task the best k of each query, ties and all."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    known = pa.array(words)
    kind = turns.schema["id"].dataType.simpleString()

    def counts(batch):
        """Blocks of turns: (ids, turns x words counts)."""
        for start in range(0, batch.num_rows, TURN_BLOCK):
            some = batch.slice(start, TURN_BLOCK)
            lists = some.column("words")
            at = pc.index_in(lists.flatten(), value_set=known)
            row = np.repeat(np.arange(some.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            there = at.is_valid().to_numpy(zero_copy_only=False)
            cell = row[there] * len(words) + at.drop_null().to_numpy()
            yield some.column("id"), np.bincount(cell, minlength=some.num_rows * len(words)).reshape(some.num_rows, len(words))

    def holding(batches):
        total = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for _, n in counts(batch):
                total += (n > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total)], names=["word", "df"])

    listed = turns.select("id", _words("text").alias("words"))
    df = np.zeros(len(words))
    for r in listed.mapInArrow(holding, "word int, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():  # one row a word of the block
        df[r["word"]] = r["df"]
    weighted = matrix * np.log((turns.count() + 1) / (df + 1))[:, None]

    def best(batches):
        held: list = [[] for _ in names]
        for batch in batches:
            for ids, n in counts(batch):
                score, ids = n @ weighted, ids.to_pylist()
                shared = (n > 0) @ matrix > 0  # a turn without a word of the query has no score
                for q in range(len(names)):
                    rows = np.flatnonzero(shared[:, q])
                    held[q] = sorted([*held[q], *((-round(float(score[r, q]), 6), ids[r]) for r in rows)])[:k]
        for q, rows in enumerate(held):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(rows)), pa.array([i for _, i in rows]), pa.array([-s for s, _ in rows])], names=["query", "id", "score"])

    return listed.where("id is not null").mapInArrow(best, f"query {'string' if isinstance(names[0], str) else 'long'}, id {kind}, score double")
