"""Record dumps: large text files of `Record: TYPE "id"` blocks -> records and effects.

The file is split at record headers rather than at lines, so Spark cuts even one huge dump into
parallel byte ranges and a row is a whole record. What crosses rows is small state: whether a text
block is still open (its contents may quote headers) and the dialogue topic an INFO belongs to. Both
are carried by `carry_last`, with the byte range a row came from as its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.text import strip_markup
from pulse.operators.blocked import BLOCK, carry_last
from pulse.operators.once import compute_once
from pulse.session import stored

SEPARATOR = "\nRecord: "
CONTAINER = "DIAL"

# Fixed patterns of the dump format.
HEADER = r'^(\S+?)[ \t]*(?:"(.*)")?[ \t]*$'
OPEN = r"^[ \t]+Text:[ \t]*\nSTART-+[ \t]*$"
CLOSED_BLOCK = rf"(?ms){OPEN}.*?^END-+[ \t]*$"
FIRST_END = r"(?ms)\A.*?^END-+[ \t]*$"
BLOCK_TEXT = rf"(?ms){OPEN}\n(.*?)^END-+[ \t]*$"
EFFECT_START = r"(?m)^(?=[ \t]+Effect(?:\[\d+\])?: .+ \(-?\d+\)[ \t]*$)"
EFFECT = r"^[ \t]+Effect(?:\[\d+\])?: (.+?) \((-?\d+)\)"
TARGET = r"(?m)^[ \t]+(Skill|Attribute): (?!Invalid )(.+?) \(\d+\)[ \t]*$"
RANGE = r"(?m)^[ \t]+Range: (.+?) \(-?\d+\)[ \t]*$"
DURATION = r"(?m)^[ \t]+Duration: (-?\d+)[ \t]*$"
MAGNITUDE = r"(?m)^[ \t]+Magnitude: (-?\d+)-(-?\d+)[ \t]*$"
NAME = r"(?m)^[ \t]+Name: (.*)$"
INLINE_TEXT = r"(?m)^[ \t]+Text: (.+)$"
DESCRIPTION = r"(?m)^[ \t]+Description: (.+)$"
IDENTITY = r"(?m)^[ \t]+(?:ID|Index): (.+?) \((-?\d+)\)[ \t]*$"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, pos, body): text between record headers, in file order."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("body"))


def _last(text: Column, pattern: str, group: int) -> Column:
    """Group of the last match, or null. A field printed twice keeps its last value."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def _or_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def _left_open(body: Column) -> Column:
    return F.regexp_replace(body, CLOSED_BLOCK, "").rlike(f"(?m){OPEN}")


def assemble(rows: DataFrame) -> DataFrame:
    """One row per true record: (file, pos, type, quoted_id, dial, body).

    A row whose preceding text leaves a block open is quoted content, not a record; it is put
    back into the record it was cut from.
    """
    rows = rows.withColumn("body", F.regexp_replace("body", "\r", ""))
    rows = rows.withColumn("body", F.regexp_replace("body", r"\ARecord: ", ""))
    ends = F.col("body").rlike(r"(?m)^END-+[ \t]*$")
    after_end = F.regexp_replace("body", FIRST_END, "")
    # what the row leaves behind, when that does not depend on how it began; most rows leave
    # the state as they found it and yield null
    settles = (F.when(ends, F.when(_left_open(after_end) == _left_open(F.col("body")),
                                   _left_open(F.col("body"))))
               .when(_left_open(F.col("body")), F.lit(True)))
    head = F.substring_index("body", "\n", 1)
    named = head.rlike(HEADER)
    # the regular expressions run once; what follows reads narrow columns of the written rows
    rows = stored(compute_once(rows, settles=settles).withColumns({
        "head_type": F.when(named, F.regexp_extract(head, HEADER, 1)),
        "head_id": F.when(named, F.regexp_extract(head, HEADER, 2))}), "dump-rows")
    stated = carry_last(rows.drop("body"), ["file"], "pos", {"inside": F.col("settles")})
    header = ~F.coalesce("inside", F.lit(False)) & F.col("head_type").isNotNull()
    typed = stated.withColumns({"type": F.when(header, F.col("head_type")),
                                "quoted_id": F.when(header, F.col("head_id"))})
    # a record row is never a container row, so counting the row itself changes nothing for it
    owned = carry_last(typed, ["file"], "pos", {
        "rec": F.when(F.col("type").isNotNull(), F.col("pos")),
        "dial": F.when(F.col("type") == CONTAINER, F.col("quoted_id"))}, inclusive=True)
    owned = owned.filter(F.col("rec").isNotNull()).select(
        "file", "pos", "rec", "type", "quoted_id", "dial")
    # a block still open at the end of its file has no text; what it quotes is left uncollected
    unclosed = rows.groupBy("file").agg(F.max_by("settles", F.when(
        F.col("settles").isNotNull(), F.col("pos"))).alias("open")).filter("open")
    ends = owned.groupBy("file").agg(F.max("rec").alias("last_rec")).join(unclosed, "file")
    pieces = (rows.select("file", "pos", "body").join(owned, ["file", "pos"])
              .join(ends.select("file", "last_rec"), "file", "left")
              .filter((F.col("pos") == F.col("rec")) | F.col("last_rec").isNull()
                      | (F.col("rec") < F.col("last_rec"))))
    in_order = F.sort_array(F.collect_list(F.struct("pos", "body")))
    return pieces.groupBy("file", F.col("rec").alias("pos")).agg(
        F.max("type").alias("type"), F.max("quoted_id").alias("quoted_id"),
        F.max(F.when(F.col("type").isNotNull(), F.col("dial"))).alias("dial"),
        F.array_join(F.transform(in_order, lambda p: p["body"]), SEPARATOR).alias("body"))


def parse(rows: DataFrame) -> DataFrame:
    """Assembled records with identity, name, text, their effects array and `outcome`
    (emitted / container / skipped)."""
    fields = F.regexp_replace(F.regexp_replace("body", CLOSED_BLOCK, ""), rf"(?ms){OPEN}.*\Z", "")
    dialogue = F.col("type") == "INFO"
    base = compute_once(assemble(rows), fields=fields)
    quoted = _or_null(F.col("quoted_id"))
    block = _last(F.col("body"), BLOCK_TEXT, 1)
    identity = F.when(quoted.isNull(), _first(F.col("fields"), IDENTITY, 2))
    base = compute_once(base, **{
        "name": F.when(dialogue, F.col("dial")).otherwise(F.coalesce(
            F.when(identity.isNotNull(), _first(F.col("fields"), IDENTITY, 1)),
            _or_null(_last(F.col("fields"), NAME, 1)))),
        "text": F.coalesce(_or_null(strip_markup(block)),
                           _or_null(_last(F.col("fields"), INLINE_TEXT, 1)),
                           _or_null(_first(F.col("fields"), DESCRIPTION, 1))),
        "effects": effect_structs(F.col("fields")),
        "identity": identity})
    own = F.coalesce(
        F.when(dialogue & (F.coalesce("dial", F.lit("")) != ""),
               F.concat("dial", F.lit("#"), "quoted_id")),
        quoted,
        F.concat("type", F.lit(":"), F.coalesce("identity", "name")))
    content = F.col("text").isNotNull() | F.col("name").isNotNull() | (F.size("effects") > 0)
    return (base.withColumn("record_id", own)
            .withColumn("outcome", F.when(F.col("type") == CONTAINER, "container")
                        .when(F.col("record_id").isNull() | ~content, "skipped")
                        .otherwise("emitted"))
            .withColumn("full_text", F.coalesce("text", "name", "record_id"))
            .select("file", "pos", "record_id", "type", "name", "full_text", "effects", "outcome",
                    F.regexp_count("fields", F.lit(r"(?m)^[ \t]+Effect(?:\[\d+\])?: ")).alias(
                        "effect_lines")))


def effect_structs(fields: Column) -> Column:
    """Effects in printed order. Sub-fields are found by key, because their indent varies."""
    sections = F.split(fields, EFFECT_START)
    printed = F.filter(sections, lambda s: s.rlike(EFFECT))

    def one(s: Column, i: Column) -> Column:
        return F.struct(
            i.alias("ordinal"), F.regexp_extract(s, EFFECT, 2).try_cast("int").alias("effect_id"),
            F.trim(F.regexp_extract(s, EFFECT, 1)).alias("effect_name"),
            F.lower(F.trim(_last(s, TARGET, 2))).alias("affected"),
            F.lower(_last(s, TARGET, 1)).alias("affected_kind"),
            _last(s, MAGNITUDE, 1).try_cast("int").alias("magnitude_min"),
            _last(s, MAGNITUDE, 2).try_cast("int").alias("magnitude_max"),
            _last(s, DURATION, 1).try_cast("int").alias("duration"),
            F.lower(F.trim(_last(s, RANGE, 1))).alias("range"))

    return F.transform(printed, one)


def records(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("outcome") == "emitted").select(
        "file", "record_id", "type", "name", "full_text")


def effects(parsed: DataFrame) -> DataFrame:
    return (parsed.filter(F.col("outcome") == "emitted")
            .select("record_id", F.explode("effects").alias("e")).select("record_id", "e.*"))


def conservation(parsed: DataFrame) -> DataFrame:
    """Nothing may vanish: headers = emitted + skipped + containers, effect lines = effects."""
    def n(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome).alias(outcome)

    return parsed.agg(
        F.count("*").alias("headers"), n("emitted"), n("skipped"), n("container"),
        F.coalesce(F.sum("effect_lines"), F.lit(0)).alias("effect_lines"),
        F.coalesce(F.sum(F.size("effects")), F.lit(0)).alias("effects"),
    ).withColumn("conserved", (
        F.col("headers") == F.col("emitted") + F.col("skipped") + F.col("container"))
        & (F.col("effect_lines") == F.col("effects")))
