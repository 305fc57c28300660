"""The given star-schema tables seen as telemetry, content records and a text corpus.

Every view is lazy and covers the whole of its tables. Column pruning removes what a query does
not use, down to the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators.blocked import dense_sequence
from pulse.operators.once import compute_once

EPOCH_DAY = "2024-01-01"


def _when(kind: str, value: Column) -> Column:
    return F.when(F.col("type") == kind, value)


def _id(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), n.cast("string"))


def _uuid(name: Column) -> Column:
    """A stable version-4-shaped uuid for a name."""
    h = F.md5(name.cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stamp(self, *names: str) -> int:
        """A number that changes when a file of these tables does: what is prepared from them is kept by it."""
        def files(name: str) -> DataFrame:
            return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.folder}/{name}.parquet")
        sums = [files(n).agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0] or 0 for n in names]
        return hash(tuple(sums))

    def texts(self, name: str, key: str) -> DataFrame:
        """A table of long texts. One that arrives as fewer splits than there are cores is spread
        first, because the work per row is large; a table of ordinary size is read as it lies."""
        rows = self.raw(name)
        cores = self.spark.sparkContext.defaultParallelism
        return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)

    # ---- telemetry ------------------------------------------------------------------------

    def feed(self) -> DataFrame:
        """Event rows with identity, clocks and the payload number `k`; no sequence yet."""
        k = F.get_json_object("props", "$.k").cast("int")
        ts = F.col("ts").cast("timestamp")
        day = F.datediff(ts, F.lit(EPOCH_DAY))
        return self.raw("events").select(
            "event_id", ts.alias("ts"), "event_type", "value", k.alias("k"), "user_id",
            F.col("user_id").cast("string").alias("install_id"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"),
                     F.floor(day / 3).cast("string")).alias("session_id"))

    def _envelope(self, mapping: dict[str, str], hot_rows: int | None) -> DataFrame:
        """`hot_rows=None` leaves out `seq` and `block`, and with them every shuffle."""
        k = F.col("k")
        kind = F.col("event_type")
        named = F.when(k % 25 == 24, "Heartbeat")
        for raw, name in mapping.items():
            named = named.when(kind == raw, name)
        rows = self.feed()
        if hot_rows is None:
            # the number is read by most columns; without a shuffle in between, each would parse it
            rows = compute_once(rows.withColumnRenamed("k", "_k"), k=F.col("_k")).drop("_k")
        else:
            rows = dense_sequence(rows, "session_id", "ts", "event_id", hot_rows=hot_rows)
        return (rows.withColumns({
                    "type": named,
                    "env": F.when(k % 10 == 0, "synthetic").when(k % 10 < 4, "dev")
                            .otherwise("prod"),
                    "mod_id": _id("mod", k % 3),
                    "received_at": F.timestamp_micros(
                        F.unix_micros("ts") + k.cast("long") * 1_000_000)}))

    def unordered(self) -> DataFrame:
        """Telemetry for questions in which the order inside a session plays no part."""
        return self.telemetry(hot_rows=None)

    def telemetry(self, hot_rows: int | None = 1_000_000) -> DataFrame:
        """Confrontations, areas and skill checks with their promoted payload columns."""
        k = F.col("k")
        check = "SkillCheckResolved"
        threshold = F.element_at(F.array(*[F.lit(t) for t in (25, 30, 40, 50, 60, 75, 100)]),
                                 (k % 7) + 1)
        skill_value = F.floor("value").cast("int")
        earned = skill_value >= threshold
        won = F.col("value") < 25
        confronted = F.col("type").isin("ConfrontationAttempted", "ConfrontationTopicEntered",
                                        "ConfrontationExited")
        return self._envelope({
            "click": "ConfrontationAttempted", "view": "AreaEntered",
            "purchase": "ConfrontationExited", "signup": "ConfrontationTopicEntered",
            "error": check}, hot_rows).withColumns({
                "suspect": F.when(confronted, _id("s", k % 2)),
                "topic": F.when(confronted & (F.col("type") != "ConfrontationExited"),
                                _id("t", F.floor(k / 2) % 2)),
                "kind": _when("ConfrontationTopicEntered",
                              F.element_at(F.array(F.lit("texture"), F.lit("fact"),
                                                   F.lit("pattern")), (k % 3) + 1)),
                "passed": _when("ConfrontationAttempted", won)
                          .when(F.col("type") == check, earned | (k % 50 == 7)),
                "reason": _when("ConfrontationAttempted", F.when(~won, _id("r", k % 4))),
                "completed": _when("ConfrontationExited", k % 2 == 0),
                "area": _when("AreaEntered", _id("area", k % 25)),
                "interior": _when("AreaEntered", k % 2 == 0),
                "check_id": _when(check, _id("chk_", k % 8)),
                "stat": _when(check, _id("st", k % 5)),
                "stat_kind": _when(check, F.when(k % 2 == 0, "skill").otherwise("attribute")),
                "threshold": _when(check, threshold),
                "skill_value": _when(check, skill_value),
                "trigger": _when(check, F.when(k % 10 == 9, "environment").otherwise("inspect")),
                "threshold_passed": _when(check, earned),
                "skill_route": _when(check, F.when(k % 3 == 0, _id("route", k % 4))),
            })

    def _payload(self) -> Column:
        """The promoted columns by key, in the order of keys that a variant has."""
        keys = ("suspect", "topic", "kind", "passed", "reason", "completed", "area", "interior",
                "check_id", "threshold", "skill_value", "trigger", "threshold_passed",
                "skill_route")
        named = {c: F.col(c) for c in keys} | {"skill": F.col("stat"), "stat_type": F.col("stat_kind")}
        return F.struct(*[named[key].alias(key) for key in sorted(named)])

    def with_payload(self, events: DataFrame) -> DataFrame:
        """Add the JSON payload the promoted columns come from (absent keys are left out)."""
        keys = ("suspect", "topic", "kind", "passed", "reason", "completed", "area", "interior",
                "check_id", "threshold", "skill_value", "trigger", "threshold_passed",
                "skill_route")
        return events.withColumn("data", F.to_json(F.struct(
            *[F.col(c) for c in keys], F.col("stat").alias("skill"),
            F.col("stat_kind").alias("stat_type"))))

    def exploration(self, hot_rows: int | None = 1_000_000) -> DataFrame:
        """A second reading of the feed: evidence, consumables, puzzles and displayed checks."""
        k = F.col("k")
        value = F.floor("value").cast("int")
        threshold = F.lit(20)
        shown = F.col("type").isin("SkillCheckDisplayed", "SkillCheckResolved")
        base = value - F.when(k % 3 == 0, 10).otherwise(0)
        return self._envelope({
            "click": "ConfrontationAttempted", "view": "EvidenceCollected",
            "purchase": "ItemConsumed", "signup": "SkillCheckDisplayed",
            "error": "SkillCheckResolved"}, hot_rows).withColumns({
                "evidence_id": _when("EvidenceCollected", _id("ev", k % 6)),
                "evidence_ids": _when("ConfrontationAttempted",
                                      F.array(_id("ev", k % 6), _id("ev", (k + 2) % 6))),
                "suspect": _when("ConfrontationAttempted", _id("s", k % 2)),
                "topic": _when("ConfrontationAttempted", _id("t", F.floor(k / 2) % 2)),
                "passed": _when("ConfrontationAttempted", F.col("value") < 25)
                          .when(F.col("type") == "SkillCheckResolved", value >= threshold),
                "item_id": _when("ItemConsumed", _id("part_", k)),
                "check_id": F.when(shown, _id("chk_", k % 4)),
                "display_group": _when("SkillCheckDisplayed", (k % 3).cast("int")),
                "threshold_met": _when("SkillCheckDisplayed", value >= threshold),
                "threshold": F.when(shown, threshold),
                "skill_value": _when("SkillCheckResolved", value),
                "base_value": _when("SkillCheckResolved", base),
                "stat": F.when(shown, _id("st", k % 5)),
            })

    def puzzles(self) -> DataFrame:
        """Clicks read as puzzle attempts."""
        return (self._envelope({"click": "PuzzleAttempted"}, 1_000_000)
                .filter(F.col("type") == "PuzzleAttempted")
                .withColumns({"puzzle_id": _id("pz", F.col("k") % 5),
                              "passed": F.col("value") < 25}))

    # ---- raw deliveries -----------------------------------------------------------------------

    def envelopes(self) -> DataFrame:
        """Telemetry as wire JSON: uuid identities, epoch milliseconds, payload object."""
        wire = F.to_json(F.struct(
            F.lit(1).alias("v"), "type", "seq", _uuid(F.col("install_id")).alias("install_id"),
            _uuid(F.col("session_id")).alias("session_id"), F.unix_millis("ts").alias("ts"),
            F.concat(F.lit(" "), F.upper("mod_id")).alias("mod_id"),
            self._payload().alias("data")))
        return self.telemetry().select("event_id", "k", "env", "received_at", "type", "ts",
                             wire.alias("json"))

    def log_lines(self) -> DataFrame:
        """A noisy at-least-once log: every event arrives twice, a minute apart, between an
        untagged line and a truncated one."""
        # the JSON is built below the explode, once per event
        copies = self.envelopes().select(
            "env", "received_at", "json",
            F.explode(F.array(*[F.lit(n) for n in range(4)])).alias("copy"))
        copy = F.col("copy")
        tag = F.concat(F.lit("[12:00:00.000 I] Global[scripts/x.lua]: OMWA1 "), F.col("json"))
        line = (F.when(copy == 2, "[12:00:00.100 I] Loading cell")
                .otherwise(F.substring(tag, F.lit(1), F.when(copy == 3, 60)
                                       .otherwise(F.length(tag)))))
        delay = F.when(copy == 1, 60_000_000).otherwise(0)
        return copies.select(line.alias("line"), F.timestamp_micros(
            F.unix_micros("received_at") + delay).alias("received_at"),
            F.concat(F.lit(" "), F.upper("env")).alias("env_header"))

    # ---- game content -----------------------------------------------------------------------

    def records(self) -> DataFrame:
        kinds = {"STANDARD": "ALCH", "SMALL": "INGR", "LARGE": "SPEL", "PROMO": "ENCH",
                 "ECONOMY": "INFO"}
        kind = F.lit(None).cast("string")
        for raw, name in reversed(kinds.items()):
            kind = F.when(F.col("p_type") == raw, name).otherwise(kind)
        return self.raw("part").select(
            _id("Part_", F.col("p_partkey")).alias("record_id"),
            F.col("p_brand").alias("source"), F.coalesce(kind, F.lit("BOOK")).alias("type"),
            F.col("p_name").alias("name"), F.col("p_name").alias("full_text"))

    def effects(self) -> DataFrame:
        p = F.col("p_partkey")
        n = p + F.col("ordinal")
        known = F.col("p_type") != "SMALL"
        return (self.raw("part").filter(F.col("p_type").isin("STANDARD", "SMALL", "LARGE", "PROMO"))
                .withColumn("ordinal", F.explode(F.sequence(F.lit(0), (p % 3).cast("int"))))
                .select(
                    _id("Part_", p).alias("record_id"), "ordinal",
                    F.when(n % 4 == 0, 17).otherwise(79).alias("effect_id"),
                    F.when(n % 4 == 0, "Drain Attribute").otherwise("Fortify Attribute")
                    .alias("effect_name"),
                    _id("st", n % 5).alias("affected"),
                    F.when(F.floor(p / 5) % 2 == 0, "skill").otherwise("attribute")
                    .alias("affected_kind"),
                    F.when(known, F.col("p_size")).alias("magnitude_min"),
                    F.when(known, (F.col("p_size") + p % 30).cast("int")).alias("magnitude_max"),
                    F.when(p % 6 == 0, 0).otherwise(30).alias("duration"),
                    F.lit("self").alias("range")))

    def sightings(self) -> DataFrame:
        """Single objects seen by the world survey, before the tally."""
        return self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            _id("area", F.col("s_nationkey")).alias("area"),
            (F.col("s_nationkey") % 2 == 0).alias("is_exterior"),
            F.lower(_id("Part_", F.col("l_partkey"))).alias("item_record_id"),
            F.col("l_quantity").cast("long").alias("count"))

    def dump_rows(self) -> DataFrame:
        """Parts, nations and regions printed as a record dump, cut at record headers."""
        def line(*parts: Column | str) -> Column:
            return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string")
                              for x in parts], F.lit("\n"))

        def effect(e: Column) -> Column:
            kind, n = F.initcap(e["affected_kind"]), F.substring(e["affected"], 3, 9)
            head = F.concat(e["effect_name"], F.lit(" ("), e["effect_id"].cast("string"),
                            F.lit(")"))
            indexed = F.concat(
                line("  Effect[", e["ordinal"], "]: ", head), line("    ", kind, ": ",
                     F.upper(e["affected"]), " (", n, ")"), line("    Range: Self (0)"),
                line("    Duration: ", e["duration"]),
                line("    Magnitude: ", e["magnitude_min"], "-", e["magnitude_max"]))
            flat = F.concat(
                line("  Effect: ", head),
                line("  Skill: ", F.when(kind == "Skill", F.concat(e["affected"], F.lit(" ("), n,
                     F.lit(")"))).otherwise("Invalid (-1)")),
                line("  Attribute: ", F.when(kind == "Attribute", F.concat(
                    e["affected"], F.lit(" ("), n, F.lit(")"))).otherwise("Invalid (-1)")))
            return F.when(e["magnitude_min"].isNull(), flat).otherwise(indexed)

        per_record = self.effects().groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct(
            "ordinal", "effect_id", "effect_name", "affected", "affected_kind", "magnitude_min",
            "magnitude_max", "duration"))).alias("effects"))
        parts = self.records().join(per_record, "record_id", "left")
        printed = F.array_join(F.transform(F.coalesce("effects", F.array()), effect), "")
        head = line(F.col("type"), ' "', F.col("record_id"), '"')
        name = line("  Name: ", F.col("name"))
        body = (F.when(F.col("type") == "INFO", F.concat(
                    line('DIAL "topic ', F.col("record_id"), '"'), F.lit("  Deleted: 0\nRecord: "),
                    head, line("  Text: ", F.col("full_text"))))
                .when(F.col("type") == "BOOK", F.concat(
                    head, name, line("  Text:"), line("START------"),
                    line("<DIV>", F.col("full_text"), "<BR>"), line('Record: NPC_ "quoted"'),
                    line("  Name: not a field"), line("END------")))
                .when(F.col("type") == "ENCH", F.concat(head, printed))
                .otherwise(F.concat(head, name, printed)))
        at = F.substring("record_id", 6, 20).cast("long")
        places = self.raw("nation").select(
            F.lit("places").alias("file"), F.col("n_nationkey").cast("long").alias("at"),
            F.concat(line("CELL"), line("  Name: ", F.col("n_name")), line("Record: LAND"),
                     line("  Coordinates: (1,2)")).alias("text"))
        skills = self.raw("region").select(
            F.lit("skills").alias("file"), F.col("r_regionkey").cast("long").alias("at"),
            F.concat(line("SKIL"), line("  ID: ", F.col("r_name"), " (", F.col("r_regionkey"), ")"),
                     line("  Description: About ", F.col("r_name"))).alias("text"))
        texts = parts.select(F.col("source").alias("file"), at.alias("at"), body.alias("text"))
        return (texts.unionByName(places).unionByName(skills)
                .select("file", "at", F.posexplode(F.split("text", "\nRecord: ")).alias("i", "body"))
                .select("file", F.floor(F.col("at") / 300).alias("block"),
                        (F.col("at") * 4 + F.col("i")).alias("pos"), "body"))

    def lines(self) -> DataFrame:
        """Search corpus without vectors: documents as records, their lines as chunks."""
        docs = self.documents()
        lines = (docs.select("doc_id", "record_id", "type", "name", "source",
                             F.posexplode(F.split("full_text", "\n")).alias("ordinal", "text"))
                 .filter(F.trim("text") != ""))
        return lines.select(
            F.concat("record_id", F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"),
            "doc_id", "record_id", "ordinal", "type", "name", "source", "text",
            F.sha2("text", 256).alias("text_hash"))

    def passages(self) -> DataFrame:
        """`lines` with their vectors.

        `vec_id = doc_id` embeds the first line of a document; other chunks have no vector yet.
        """
        vectors = self.raw("embeddings").select(
            F.col("vec_id").alias("doc_id"), F.lit(0).alias("ordinal"), "embedding")
        return self.lines().join(vectors, ["doc_id", "ordinal"], "left").select(
            "chunk_id", "record_id", "ordinal", "type", "name", "source", "text", "text_hash",
            "embedding")

    def documents(self) -> DataFrame:
        kind = (F.when(F.col("lang") == "en", "BOOK").when(F.col("lang") == "fr", "INFO")
                .when(F.col("lang") == "de", "CELL").otherwise("SKIL"))
        return self.texts("documents", "doc_id").select(
            "doc_id", _id("Doc_", F.col("doc_id")).alias("record_id"), "source",
            kind.alias("type"), F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
            .alias("name"), F.col("text").alias("full_text"))

    def vectors(self) -> DataFrame:
        """Chunk vectors on their own, for search that needs no text."""
        return self.raw("embeddings").select(
            F.concat(F.lit("Doc_"), F.col("vec_id").cast("string"), F.lit("#0")).alias("chunk_id"),
            F.col("vec_id"), "label", "embedding")

    def query_vectors(self) -> DataFrame:
        """The query set: every vector whose id is divisible by 20."""
        return self.raw("embeddings").filter(F.col("vec_id") % 20 == 0).select(
            _id("vec", F.col("vec_id")).alias("query_id"), F.col("embedding").alias("vector"))

    def label_vectors(self) -> DataFrame:
        """What each kind of stat is described by: the vector of the first member of a label."""
        return (self.raw("embeddings").groupBy("label")
                .agg(F.min_by("embedding", "vec_id").alias("vector"))
                .select(_id("label", F.col("label")).alias("label"), "vector"))

    def hybrid_queries(self) -> DataFrame:
        """`query_vectors` with a text, any word of which may match. A vector belongs to the first line of
        its document (chunk #0), so that line is the text; vectors without a document are not asked."""
        words = F.split(F.split("text", "\n")[0], " ")
        asked = self.raw("embeddings").filter(F.col("vec_id") % 20 == 0).select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        return asked.join(self.raw("documents").select("doc_id", "text"), "doc_id").select(
            _id("vec", F.col("doc_id")).alias("query_id"),
            F.array_join(words, " or ").alias("text"), "vector")

    def web_queries(self) -> DataFrame:
        """Every benchmark line rewritten as a phrase of its first two words, then its other words as
        alternatives, the last one excluded (when there are five)."""
        w = F.split("text", " ")
        rest = F.array_join(F.slice(w, 3, F.greatest(F.size(w) - 3, F.lit(1))), " or ")
        return self.benchmark_queries().select("query_id", F.when(F.size(w) >= 5, F.concat(
            F.lit('"'), w[0], F.lit(" "), w[1], F.lit('" '), rest, F.lit(" -"),
            F.element_at(w, -1))).otherwise(F.col("text")).alias("text"))

    def benchmark_queries(self) -> DataFrame:
        """Every line of every benchmark item as one search text."""
        return (self.raw("benchmark")
                .select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
                .filter(F.trim("text") != "")
                .select(F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit("-"),
                                 F.col("line").cast("string")).alias("query_id"), "text"))
