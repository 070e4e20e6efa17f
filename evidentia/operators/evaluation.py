"""Scoreboards: rates with totals, nearest-rank percentiles, reasons, comparison with hand-checked truth and between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 0.005


def rates(rows: DataFrame, category: str, flags: dict[str, Column], total: str = "TOTAL") -> DataFrame:
    """category, n, and for each flag its count and its share, with one more row over all."""
    found = rows.select(category, *(x.alias(n) for n, x in flags.items())).rollup(category)
    out = found.agg(F.count(F.lit(1)).alias("n"), F.grouping(category).alias("_all"), *(F.count_if(F.col(n)).alias(n) for n in flags))
    out = out.withColumn(category, F.when(F.col("_all") == 1, total).otherwise(F.col(category))).drop("_all")
    return out.withColumns({f"{n}_share": F.col(n) / F.col("n") for n in flags})


def percentiles(rows: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """Nearest-rank percentiles: values that occur, at place ceil(p n)."""
    return rows.groupBy(*keys).agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points), F.max(value).alias("largest"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place floor(n / 2) from 0: of an even number of values the upper of the middle two, never their mean."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_k") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("upper_median"))


def reason_lists(rows: DataFrame, reason: str, key: str, shown: int = 5) -> DataFrame:
    """reason, n, first: how many keys have each reason, and the `shown` smallest of them. No list grows with a reason's rows."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(reason).orderBy(key)))
    first = ranked.where(F.col("_k") <= shown).groupBy(reason).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first"))
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n")).join(first, reason)


def near(a: Column, b: Column, eps: float = NEAR) -> Column:
    """Equal within eps; null where either is unknown."""
    return F.abs(a - b) <= eps


def against_oracle(readings: DataFrame, oracle: DataFrame, keys: list[str], value: str, truth: str, asserts_absence: str) -> DataFrame:
    """keys, verdict: correct, WRONG, not read, or silent where the oracle has nothing to say.

    A null truth with asserts_absence says that the drawing prints no such number, so any reading of it is wrong.
    """
    rows = oracle.join(readings, keys, "left")
    v, t = F.col(value), F.col(truth)
    verdict = (
        F.when(t.isNull() & F.col(asserts_absence), F.when(v.isNull(), "correct").otherwise("WRONG"))
        .when(t.isNull(), "silent")
        .when(v.isNull(), "not read")
        .when(near(v, t), "correct")
        .otherwise("WRONG")
    )
    return rows.select(*keys, v, t, verdict.alias("verdict"))


def run_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after as text: what changed between two runs, with (absent) for a side that lacks the key. Null equals null."""
    a = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    rows = a.join(b, keys, "full_outer").where(~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_in_a").eqNullSafe(F.col("_in_b"))))
    shown = lambda v, there: F.when(F.col(there).isNull(), "(absent)").otherwise(F.coalesce(F.col(v).cast("string"), F.lit("(null)")))
    return rows.select(*keys, shown("_a", "_in_a").alias("before"), shown("_b", "_in_b").alias("after"))


def spend(calls: DataFrame, keys: list[str], tokens_in: str, tokens_out: str, paid: Column, planned: int) -> DataFrame:
    """keys, calls, paid_calls, usd, projected: what was spent and what `planned` more calls would cost at its average."""
    from ..functions.text import usd

    cost = F.when(paid, usd(F.col(tokens_in), F.col(tokens_out))).otherwise(0.0)
    out = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(paid).alias("paid_calls"), F.sum(cost).alias("usd"))
    return out.withColumn("projected", F.when(F.col("paid_calls") > 0, F.col("usd") / F.col("paid_calls") * planned).otherwise(0.0))


def review_queue(rows: DataFrame, key: str, field: str, rank: str, blocking: Column, low: float = 0.5) -> DataFrame:
    """key, field, reason, place: what a person should look at, what blocks first, then in the fields' order."""
    reason = (
        F.when(F.col("value").isNotNull() & F.startswith("method", F.lit("vlm")) & F.col("citation").isNull(), "unverifiable")
        .when(F.col("method") == "vlm-drawing", "read-from-image")
        .when(F.startswith("method", F.lit("vlm")) & (F.coalesce(F.col("confidence"), F.lit(0.0)) <= low), "model-read")
    )
    found = rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).withColumn("blocking", F.coalesce(blocking, F.lit(False)))
    order = Window.partitionBy(key).orderBy(F.col("blocking").desc(), rank)
    return found.select(key, field, "reason", "blocking", F.row_number().over(order).alias("place"))


def usage_merged(a: Column, b: Column) -> Column:
    """The sum of two counts of which either may be unknown; null where both are."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def shared_kind(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys, kind: the one kind all failures of a key have, or null where they differ or there are none."""
    return rows.groupBy(*keys).agg(F.when(F.count_distinct(kind) == 1, F.min(kind)).alias(kind))


def charged(cached: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """keys, usd, calls, from_ledger: what was charged: the ledger's totals if it has attempts, else what the cache adds up to."""
    known = ledger.groupBy(*keys).agg(F.sum("usd").alias("_usd"), F.sum("attempts").alias("_n"))
    rows = cached.join(known, keys, "full_outer")
    use = F.coalesce(F.col("_n"), F.lit(0)) > 0
    return rows.select(*keys, F.when(use, F.col("_usd")).otherwise(F.coalesce("usd", F.lit(0.0))).alias("usd"), F.when(use, F.col("_n")).otherwise(F.coalesce("calls", F.lit(0))).alias("calls"), use.alias("from_ledger"))


def cache_census(entries: DataFrame, prompt: str, current: str) -> DataFrame:
    """reachable, stranded, unknown: cached answers to today's prompt, to another, and from before prompts were kept."""
    p = F.col(prompt)
    return entries.agg(F.count_if(p == current).alias("reachable"), F.count_if(p != current).alias("stranded"), F.count_if(p.isNull()).alias("unknown"))


def guard_counts(parts: DataFrame, guards: DataFrame, key: str, fired: str, costly: str) -> DataFrame:
    """guard, fires, costs: on how many parts each guard fires, and on how many of these something printed was thrown away."""
    hits = parts.select(F.explode(fired).alias("guard"), F.col(costly).alias("_c")).groupBy("guard").agg(F.count(F.lit(1)).alias("fires"), F.count_if("_c").alias("costs"))
    return guards.join(hits, "guard", "left").select("guard", F.coalesce("fires", F.lit(0)).alias("fires"), F.coalesce("costs", F.lit(0)).alias("costs"))


def flattened(records: DataFrame, key: str, paths: dict[str, Column]) -> DataFrame:
    """key, path, value: a record as rows of text, one for each path; unknown values read (null)."""
    pairs = F.array(*(F.struct(F.lit(p).alias("path"), F.coalesce(v.cast("string"), F.lit("(null)")).alias("value")) for p, v in paths.items()))
    return records.select(key, F.explode(pairs).alias("_p")).select(key, "_p.path", "_p.value")


def request_key(version: int, model: Column, prompt: Column, images: Column) -> Column:
    """The fingerprint of a request: version, model, prompt and images (array of page, kind, base64), so that a change of any asks anew."""
    seen = F.transform(images, lambda i: F.concat(F.lit("\n"), i["page"].cast("string"), F.lit(":"), i["kind"], F.lit(":"), F.length(i["base64"]).cast("string"), F.lit("\n"), i["base64"]))
    return F.sha2(F.concat(F.lit(f"v{version}\n"), model, F.lit("\n"), prompt, F.array_join(seen, "")), 256)


def stitched(answers: DataFrame, key: str, prompt: str) -> DataFrame:
    """key, stitched: did answers to more than one prompt go into a record."""
    return answers.groupBy(key).agg((F.count_distinct(prompt) > 1).alias("stitched"))


def reading_reason(pins: Column, count: Column, tables: Column, wrong_document: Column) -> Column:
    """Why a part of the hold-out could be read or not, in groups: the first rule that fits."""
    return (
        F.when(F.coalesce(wrong_document, F.lit(False)), "not a datasheet")
        .when((pins == 0) & (tables > 0), "a pinout for each package")
        .when((pins == 0) & count.isNull(), "no pins, no count")
        .when(pins == 0, "count but no pins")
        .when(count.isNull(), "pins but no count")
        .otherwise("read")
    )


def answered(records: DataFrame, fields: list[str], answer: str = "answer_", rounds: int = 4) -> DataFrame:
    """records with asked (rounds it took) and status, each round filling the first unknown field by what a customer would answer.

    ships: nothing is unknown any more; stuck: the next answer isn't known; asks: questions are left after all rounds.
    """
    rows = records.withColumn("asked", F.lit(0)).withColumn("_stuck", F.lit(False))
    for _ in range(rounds):  # as many projections as rounds: Catalyst makes one of them
        turn, filled = F.lit(None).cast("string"), {}
        for n in reversed(fields):
            turn = F.when(F.col(n).isNull(), F.lit(n)).otherwise(turn)
        known = F.lit(False)
        for n in fields:
            known = F.when(turn == n, F.col(answer + n).isNotNull()).otherwise(known)
        go = turn.isNotNull() & ~F.col("_stuck")
        filled = {n: F.when(go & (turn == n), F.col(answer + n)).otherwise(F.col(n)) for n in fields}
        rows = rows.withColumns(filled | {"asked": F.col("asked") + (go & known).cast("int"), "_stuck": F.col("_stuck") | (go & ~known)})
    left = F.lit(False)
    for n in fields:
        left = left | F.col(n).isNull()
    return rows.withColumn("status", F.when(F.col("_stuck"), "stuck").when(left, "asks").otherwise("ships")).drop("_stuck")


def scored(records: DataFrame, key: str, groups: dict[str, list[str]], required: list[str]) -> DataFrame:
    """key, for each group how many of its fields (structs value, citation) are filled, how many fields are cited, and whether the record ships."""
    known = lambda names: sum((F.col(f"{n}.value").isNotNull().cast("long") for n in names), F.lit(0))
    every = [n for names in groups.values() for n in names]
    cited = sum(((F.col(f"{n}.value").isNotNull() & F.col(f"{n}.citation").isNotNull()).cast("long") for n in every), F.lit(0))
    return records.select(key, *(known(names).alias(g) for g, names in groups.items()), cited.alias("cited"), (known(required) == len(required)).alias("ships"))


def declined(first: Column, second: Column, answered_: Column) -> Column:
    """Fields that either pass looked for in vain and none answered, each once."""
    return F.array_except(F.array_union(first, second), answered_)


def findings(config: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """key, rule, level: each rule a configuration breaks. rules: name -> (level, what breaks it)."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"))) for n, (level, test) in rules.items())))
    return config.select(key, F.explode(broken).alias("_f")).select(key, "_f.rule", "_f.level")


def first_answers(answers: DataFrame, keys: list[str], group_of: DataFrame, field: str, page: str) -> DataFrame:
    """keys, field, value, page: fields asked for in groups, each on one page; the first answer wins. Fields of no group are asked by themselves."""
    rows = answers.where(F.col("value").isNotNull()).join(group_of, field, "left").withColumn("_g", F.coalesce("group_no", F.lit(1_000_000)))
    return rows.groupBy(*keys, field).agg(F.min_by("value", F.struct("_g", page)).alias("value"), F.min(F.struct("_g", page)).getField(page).alias(page))
