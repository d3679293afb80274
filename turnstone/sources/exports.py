"""Chat exports of two formats as events.

An export's conversations are rows with their JSON in a VARIANT column; every field may be missing
or of a wrong type and is then null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..operators.graph import cut
from .splitjson import read_objects


#: The file of a data export's folder (fixed value).
EXPORT_FILE = "conversations.json"


class UnknownExport(ValueError):
    pass


def read_exports(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(file, pos, convo, json) of the conversations in JSON files of any size: arrays, {"conversations": [...]}, or one conversation.

    path: a file, a data export's folder, of which conversations.json counts, or a folder of files. A file that is no
    whole JSON raises BrokenExport; with strict=False it is left out. convo is null where a conversation's own text is no JSON.
    """
    folder = spark.read.option("pathGlobFilter", EXPORT_FILE).text(path).inputFiles()
    return parsed(read_objects(spark, path, EXPORT_FILE if folder else None, strict))


def write_exports(convos: DataFrame, path: str, json: str = "json") -> None:
    """Conversations' JSON as export files: each task writes the array of its rows."""

    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([before + text], pa.string())], names=["value"])
                before = ","
        if before == ",":
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    convos.select(json).mapInArrow(array, "value string").write.text(path)


def parsed(objects: DataFrame) -> DataFrame:
    """(file, pos, convo, json) of rows with a conversation's json."""
    return objects.select("file", "pos", F.try_parse_json("json").alias("convo"), "json")


def conversations(texts: DataFrame) -> DataFrame:
    """(file, pos, convo, json) of rows (file, value) of JSON text, for small exports that are rows already; what is no JSON, or over a VARIANT's
    limit of 128 MiB, gives none: read_exports() has no limit. json: the conversation's own text, in which keys keep their order; a VARIANT sorts them."""
    whole = texts.select("file", "value", F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$.conversations", "array<variant>"), F.array("v"))
    plain = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.conversations"), "array<string>"), F.array("value"))
    rows = whole.where("v is not null").select("file", F.posexplode(F.arrays_zip(items.alias("convo"), plain.alias("json"))).alias("pos", "c"))
    return rows.select("file", "pos", F.col("c.convo").alias("convo"), F.col("c.json").alias("json")).where(F.schema_of_variant("convo").startswith("OBJECT"))


def _text(path: str, of: Column | str = "convo") -> Column:
    """A string field, null if it is none."""
    kind = F.schema_of_variant(F.try_variant_get(of, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(of, path, "string"))


def _number(path: str, of: Column | str = "convo") -> Column:
    kind = F.schema_of_variant(F.try_variant_get(of, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(of, path, "double"))


def _list(path: str, of: Column | str = "convo") -> Column:
    return F.try_variant_get(of, path, "array<variant>")


def detected(convos: DataFrame) -> DataFrame:
    """convos with format, from each conversation's shape: chatgpt, claude or null."""
    shape = lambda path: F.schema_of_variant(F.try_variant_get("convo", path, "variant"))
    return convos.withColumn("format", F.when(shape("$.mapping").startswith("OBJECT"), "chatgpt").when(shape("$.chat_messages").startswith("ARRAY"), "claude"))


def seconds_to_ms(s: Column) -> Column:
    """Whole milliseconds, halves up."""
    return F.floor(s * 1000 + 0.5).cast("long")


def iso_to_ms(s: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(s))


def newest(convos: DataFrame, created_ms: Column, most: int | None) -> DataFrame:
    """The `most` newest conversations; those without a time are oldest, and ties go by place."""
    if most is None:
        return convos
    return convos.orderBy(F.coalesce(created_ms, F.lit(0)).desc(), "file", "pos").limit(most)


def _active_thread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the nodes of each conversation's active thread, in order: up the parents from the current node, else down first
    children from the first root in the order of the file."""
    for batch in batches:
        nodes, flat = batch["nodes"], batch["nodes"].flatten()
        starts = [o.as_py() - nodes.offsets[0].as_py() for o in nodes.offsets]
        ids, parents, children = (flat.field(c).to_pylist() for c in ("id", "parent", "children"))
        taken, ends = [], [0]
        for lo, hi, current in zip(starts, starts[1:], batch["current"].to_pylist()):
            place = {ids[k]: k for k in range(lo, hi)}
            chain: dict[int, None] = {}
            if current in place:
                at = place[current]
                while at is not None and at not in chain:
                    chain[at] = None
                    at = place.get(parents[at])
                order = list(chain)[::-1]
            else:
                at = next((k for k in range(lo, hi) if not parents[k] or parents[k] not in place), None)
                while at is not None and at not in chain:
                    chain[at] = None
                    at = place.get(children[at][0]) if children[at] else None
                order = list(chain)
            taken += order
            ends.append(len(taken))
        thread = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(taken, pa.int64())))
        yield pa.RecordBatch.from_arrays([thread if name == "nodes" else batch[name] for name in batch.schema.names], names=batch.schema.names)


def parse_chatgpt(convos: DataFrame, now_ms: int, project: str | None = None, since: int | None = None, most: int | None = None) -> DataFrame:
    """Events (file, pos, turn, EVENT columns) of conversations that are message trees.

    Only user and assistant turns with text stay; hidden ones go. ts is the message's time, else the
    conversation's, else now_ms; the project is the given one or the title.
    """
    created = seconds_to_ms(_number("$.create_time"))
    rows = newest(convos, created, most)
    entry = F.from_json(F.get_json_object("json", "$.mapping"), "map<string,string>")
    nodes = F.transform(F.filter(F.map_entries(entry), lambda e: F.schema_of_variant(F.try_parse_json(e["value"])).startswith("OBJECT")), lambda e: _node(e["key"], F.try_parse_json(e["value"])))
    rows = rows.select("file", "pos", created.alias("created"), _text("$.title").alias("title"), _text("$.current_node").alias("current"), F.coalesce(nodes, F.array()).alias("nodes"))
    threads = rows.mapInArrow(_active_thread, rows.schema)
    turns = threads.select("file", "pos", "created", "title", F.posexplode("nodes").alias("turn", "n"))
    body = F.concat(F.filter("n.parts", lambda p: trim(p) != ""), F.filter(F.array("n.text"), lambda p: p.isNotNull() & (trim(p) != "")))
    events = turns.where(F.col("n.role").isin("user", "assistant") & ~F.coalesce("n.hidden", F.lit(False))).withColumn("text", trim(F.array_join(body, "\n"))).where("text <> ''")
    events = events.select(
        "file", "pos", "turn", F.lit("chatgpt").alias("source"), F.lit("chatgpt-web").alias("tool"), F.col("n.model").alias("model"),
        F.coalesce(seconds_to_ms(F.col("n.seconds")), "created", F.lit(now_ms)).alias("ts"),
        F.coalesce(F.lit(project).cast("string"), "title").alias("project"), F.col("n.role").alias("role"), "text", F.lit(None).cast("string").alias("kind"),
    )
    return events if since is None else events.where(F.col("ts") >= since)


def _node(key: Column, v: Column) -> Column:
    strings = lambda path: F.transform(_list(path, v), lambda c: _text("$", c))
    parts = F.filter(F.transform(_list("$.message.content.parts", v), lambda p: F.coalesce(_text("$", p), _text("$.text", p))), lambda p: p.isNotNull())
    hidden = F.schema_of_variant(F.try_variant_get(v, "$.message.metadata.is_visually_hidden_from_conversation", "variant")) == "BOOLEAN"
    return F.struct(
        key.alias("id"), _text("$.parent", v).alias("parent"), strings("$.children").alias("children"), _text("$.message.author.role", v).alias("role"),
        (F.coalesce(hidden, F.lit(False)) & F.coalesce(F.try_variant_get(v, "$.message.metadata.is_visually_hidden_from_conversation", "boolean"), F.lit(False))).alias("hidden"),
        _text("$.message.metadata.model_slug", v).alias("model"), _number("$.message.create_time", v).alias("seconds"),
        F.coalesce(parts, F.array().cast("array<string>")).alias("parts"), _text("$.message.content.text", v).alias("text"),
    )


def parse_claude(convos: DataFrame, now_ms: int, project: str | None = None, since: int | None = None, most: int | None = None) -> DataFrame:
    """Events (file, pos, turn, EVENT columns) of conversations that are message lists.

    A message's text is its text blocks, or else its flat text, and then the text of its attachments.
    """
    created = iso_to_ms(_text("$.created_at"))
    rows = newest(convos, created, most)
    title = F.coalesce(F.nullif(_text("$.name"), F.lit("")), F.nullif(_text("$.summary"), F.lit("")))
    turns = rows.select("file", "pos", created.alias("created"), title.alias("title"), F.posexplode(_list("$.chat_messages")).alias("turn", "m"))
    kept = lambda texts: F.filter(texts, lambda t: t.isNotNull() & (trim(t) != ""))
    blocks = F.filter(_list("$.content", F.col("m")), lambda b: F.coalesce(F.nullif(_text("$.type", b), F.lit("")), F.lit("text")) == "text")
    body = trim(F.array_join(kept(F.transform(blocks, lambda b: _text("$.text", b))), "\n"))
    body = F.coalesce(F.nullif(body, F.lit("")), trim(_text("$.text", F.col("m"))), F.lit(""))
    attached = F.transform(kept(F.transform(_list("$.attachments", F.col("m")), lambda a: _text("$.extracted_content", a))), trim)
    text = trim(F.array_join(F.concat(F.filter(F.array(body), lambda b: b != ""), F.coalesce(attached, F.array().cast("array<string>"))), "\n"))
    sender = _text("$.sender", F.col("m"))
    events = turns.where(sender.isin("human", "assistant")).withColumn("text", text).where("text <> ''")
    events = events.select(
        "file", "pos", "turn", F.lit("claude").alias("source"), F.lit("claude-web").alias("tool"), F.lit(None).cast("string").alias("model"),
        F.coalesce(iso_to_ms(_text("$.created_at", F.col("m"))), "created", F.lit(now_ms)).alias("ts"),
        F.coalesce(F.lit(project).cast("string"), "title").alias("project"), F.when(sender == "human", "user").otherwise("assistant").alias("role"), "text", F.lit(None).cast("string").alias("kind"),
    )
    return events if since is None else events.where(F.col("ts") >= since)


def formats(convos: DataFrame) -> DataFrame:
    """(file, format, n, n_odd): of every file its format, which its first conversation decides, its conversations, and how many of them have another shape."""
    known = detected(convos)
    first = F.min_by(F.struct("format"), "pos")["format"]
    per = known.groupBy("file", "format").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    per = per.groupBy("file").agg(first.alias("first"), F.sum("n").alias("n"), F.collect_list(F.struct("format", "n")).alias("by"))
    same = F.filter("by", lambda x: x["format"].eqNullSafe(F.col("first")))
    return per.select("file", F.col("first").alias("format"), "n", (F.col("n") - same[0]["n"]).alias("n_odd"))


def parse_exports(convos: DataFrame, now_ms: int, **options) -> DataFrame:
    """Events of conversations of both formats. A file's first conversation decides its format; if it has neither shape, UnknownExport is raised.

    Further conversations of another shape are left out; formats() counts them.
    """
    of = cut(formats(convos))
    unknown = [r.file for r in of.where("format is null").select("file").limit(5).collect()]
    if unknown:
        raise UnknownExport(f"the first conversation has neither a message tree nor a message list: {', '.join(map(str, unknown))}")
    known = detected(convos).join(of.select("file", F.col("format").alias("own")), "file").where("format = own").drop("own")
    return parse_chatgpt(known.where("format = 'chatgpt'").drop("format"), now_ms, **options).unionByName(parse_claude(known.where("format = 'claude'").drop("format"), now_ms, **options))
