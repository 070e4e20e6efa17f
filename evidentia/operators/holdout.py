"""What becomes of a record at the end: it ships, it would ship for a few answers, or it is refused; and the same from stored answers alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .footprint import chosen, judged

c = F.col
SHIPS = ["printed", "computed", "through-hole"]


def stand_ins() -> dict[str, Column]:
    """What a person with the part in hand would answer for each field that can be asked: what else the record says, else usual proportions."""
    positive = lambda n: F.when(c(n) > 0, c(n))
    body = F.coalesce(positive("body_length"), positive("body_width"), F.lit(3.0))
    pitch, pins = F.coalesce(positive("pitch"), F.lit(0.5)), F.coalesce(F.when(c("pin_count") > 0, c("pin_count")), F.lit(8))
    return {
        "pitch": pitch,
        "lead_sides": F.coalesce("lead_sides", F.when((pins % 4 == 0) & (pins >= 16), 4).otherwise(2)),
        "land_length": F.coalesce(positive("contact_max"), F.greatest(F.lit(0.4), F.least(F.lit(1.0), pitch * 1.2))),
        "land_width": F.greatest(F.lit(0.2), pitch * 0.55),
        "land_span": F.coalesce(positive("span_max"), body),
        "lead_diameter": F.lit(0.5),
        "thermal_length": F.coalesce(positive("thermal_length"), body * 0.6),
        "thermal_width": F.coalesce(positive("thermal_width"), body * 0.6),
    }


def least_asks(records: DataFrame, key: str, answers: dict[str, Column], judge: Callable[[DataFrame, str], DataFrame], ok: list[str]) -> DataFrame:
    """key, source, asked: what judge says of each record as it stands, and the fewest unknown fields whose answers make it one of `ok`, null where none do.

    Of equally many fields the first by the order of `answers`. Every set of a record's unknown fields is a bit mask and
    a row of its own, so all sets are judged at once in one pass, and no more rows come of a record than two to the
    number of fields. judge: (rows, their key) -> key, source.
    """
    bits = {f: 1 << k for k, f in enumerate(answers)}
    known = sum((F.when(c(f).isNotNull(), F.lit(b)).otherwise(F.lit(0)) for f, b in bits.items()), F.lit(0))
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << len(answers)) - 1)), lambda m: m.bitwiseAND(c("_known")) == 0)
    # the answers under each mask are worked out in the array, so that what judges them sees plain columns
    given = lambda m: F.struct(m.alias("_mask"), *(F.when(m.bitwiseAND(F.lit(b)) > 0, answers[f]).otherwise(c(f)).alias(f) for f, b in bits.items()))
    others = [x for x in records.columns if x not in bits]
    tried = records.withColumn("_known", known).select(*others, F.explode(F.transform(masks, given)).alias("_z")).select(*others, "_z.*")
    found = judge(tried.withColumn("_at", F.struct(key, "_mask")), "_at").select(c(f"_at.{key}").alias(key), c("_at._mask").alias("_mask"), "source")
    rank = F.struct(-F.bit_count("_mask"), F.reverse(F.lpad(F.bin("_mask"), len(answers), "0")), "_mask")
    best = found.groupBy(key).agg(F.max(F.when(c("_mask") == 0, c("source"))).alias("source"), F.max(F.when(c("source").isin(ok), rank)).alias("_b"))
    mask = c("_b._mask")
    asked = F.when(mask.isNotNull(), F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(b)) > 0, F.lit(f)) for f, b in bits.items()))))
    return best.select(key, "source", asked.alias("asked"))


def _sources(rows: DataFrame, key: str) -> DataFrame:
    return chosen(judged(rows, "formed_span", "formed_contact"), key)


def ship_outcomes(records: DataFrame, key: str) -> DataFrame:
    """key, ships, ships_answered, asked, why: what each record comes to. records: as footprint.judged and footprint.chosen want them.

    why: nothing for a record that ships; else what it needs (the fields of the cheapest ask), or why nothing helps.
    """
    rows = least_asks(records, key, stand_ins(), _sources, SHIPS)
    ships, helped = c("source").isin(SHIPS), (c("source") == "ask") & c("asked").isNotNull()
    why = F.when(ships, "").when(helped, F.concat(F.lit("needs "), F.array_join("asked", ","))).when(c("source") == "ask", "unsupported").otherwise(c("source"))
    return rows.select(key, ships.alias("ships"), (ships | helped).alias("ships_answered"), F.when(helped, F.size("asked")).otherwise(0).alias("asked"), why.alias("why"))


def store_answers(answers: DataFrame, path: str, batch: str) -> None:
    """Add a batch of answers to the store. A batch has a folder by its name, so one that is written again, after a failure or by a stream's retry, replaces itself and nothing else.

    For a stream: writeStream.foreachBatch(lambda df, n: store_answers(df, path, f"{name}-{n}")).
    """
    answers.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def latest_answers(answers: DataFrame, keys: list[str], fingerprint: str = "fingerprint", stored: str = "stored_at") -> DataFrame:
    """The answer stored last for each of keys and the fingerprint of its request, and of several requests the last one's. Repeated answers count once."""
    values = [x for x in answers.columns if x not in (*keys, stored, fingerprint)]
    last = F.max_by(F.struct(*values), F.struct(stored, fingerprint))
    return answers.groupBy(*keys).agg(last.alias("_v")).select(*keys, "_v.*")


def record_from_answers(answers: DataFrame, key: str, numbers: list[str], words: dict[str, list[str] | None], pairs: list[str]) -> DataFrame:
    """key and a column for each field: numbers; words (of those allowed, where some are); pairs as field_min and field_max; pins (array of numbers); pin_count, else the number of pins.

    answers: key, field, number, words, low, high, pins. One aggregate turns the long table into wide records.
    """
    of = lambda field, value: F.max(F.when(c("field") == field, c(value)))
    columns = [of(f, "number").alias(f) for f in numbers]
    for f, allowed in words.items():
        columns.append(F.when(of(f, "words").isin(allowed), of(f, "words")).alias(f) if allowed else of(f, "words").alias(f))
    for f in pairs:
        sound = (of(f, "low") > 0) & (of(f, "high") >= of(f, "low"))
        columns += [F.when(sound, of(f, "low")).alias(f"{f}_min"), F.when(sound, of(f, "high")).alias(f"{f}_max")]
    wide = answers.groupBy(key).agg(*columns, of("pins", "pins").alias("pins"), of("pin_count", "number").cast("int").alias("pin_count"))
    pins = F.filter("pins", lambda p: p.rlike("^[0-9]+$"))
    return wide.withColumns({"pins": pins, "pin_count": F.coalesce("pin_count", F.when(F.size(pins) > 0, F.size(pins)))})


def replayed(records: DataFrame, key: str) -> DataFrame:
    """key, status, detail: no-record (no pins or no count), ships, asks (and for what) or refused (and why), from records as answers give them."""
    built = F.coalesce((c("pin_count").isNotNull()) & (F.size("pins") > 0), F.lit(False))
    found = _sources(records.where(built), key)
    status = F.when(c("source").isin(SHIPS), "ships").when(c("source") == "ask", F.when(F.size("needs") > 0, "asks").otherwise("refused")).otherwise("refused")
    detail = F.when(status == "asks", F.array_join("needs", ",")).when(c("source") == "ask", "no land pattern").when(status == "refused", c("source")).otherwise("")
    none = records.where(~built).select(key, F.lit("no-record").alias("status"), F.lit("").alias("detail"))
    return found.select(key, status.alias("status"), detail.alias("detail")).unionByName(none)
