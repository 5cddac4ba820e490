"""Event frames in JSON: parsing, and the tables that follow from a run of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.functions.topics import CONTENT, record_topic, shard
from kithgraph.operators.graph import distinct_edges
from kithgraph.schemas import EPOCH

#: Names of the public record collections.
LIKE, REPOST, POST, FOLLOW, BLOCK = "app.bsky.feed.like", "app.bsky.feed.repost", "app.bsky.feed.post", "app.bsky.graph.follow", "app.bsky.graph.block"
#: Parts of URIs of records that aren't posts.
NOT_POSTS = ("/app.bsky.feed.generator/", "/app.bsky.graph.starterpack/", "/app.bsky.graph.list/", "/app.bsky.labeler.service/")
#: Public self-labels of adult content.
ADULT = ("porn", "sexual", "nudity", "graphic-media", "nsfw")
#: Digits of record keys that hold a time.
DIGITS = "234567abcdefghijklmnopqrstuvwxyz"


def at_author(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^at://([^/]+)/[^/]+/[^/]+$", 1), F.lit(""))


def record_key(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"^at://[^/]+/[^/]+/([^/]+)$", 1), F.lit(""))


def key_seconds(key: Column) -> Column:
    """Seconds of a sortable record key: its first 11 digits to the base 32 are microseconds."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda k: (F.instr(F.lit(DIGITS), F.substring(key, k, F.lit(1))) - 1).cast("long"))
    micros = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 32 + d)
    return F.when(key.rlike(f"^[2-7a-j][{DIGITS}]{{12}}$"), F.floor(micros / 1_000_000))


def adult(record: Column) -> Column:
    """Whether a self-label of a record in JSON is one of ADULT."""
    return adult_labels(F.from_json(F.get_json_object(record, "$.labels.values"), "array<string>"))


def adult_labels(values: Column) -> Column:
    """Whether a self-label, an object's JSON or a bare string, is one of ADULT."""
    name = lambda x: F.lower(F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.val")).otherwise(x)))
    return F.coalesce(F.exists(F.filter(values, lambda x: x.isNotNull()), lambda x: F.coalesce(name(x).isin(*ADULT), F.lit(False))), F.lit(False))


def wanted(frames: DataFrame, collections: list[str], column: str = "value") -> DataFrame:
    """Frames of the collections; all of them if the list is empty."""
    return frames.where(F.get_json_object(column, "$.commit.collection").isin(*collections)) if collections else frames


def heartbeat(frames: DataFrame, column: str = "value") -> DataFrame:
    """frames with time_us, which even frames without events carry."""
    return frames.withColumn("time_us", F.get_json_object(column, "$.time_us").try_cast("long"))


#: What parse() reads of a frame.  A string field that holds an object is that object's JSON.
_LINK = "struct<uri:string>"
_RECORD = f"subject:string,reply:struct<root:{_LINK},parent:{_LINK}>,labels:struct<values:array<string>>,{CONTENT.replace(' array', ':array').replace(' string', ':string').replace('embed struct<', 'embed:struct<`$type`:string,record:struct<uri:string,record:' + _LINK + '>,')}"
FRAME = f"did string, time_us string, kind string, commit struct<operation:string,collection:string,rkey:string,record:struct<{_RECORD}>>"


def parse(frames: DataFrame, column: str = "value") -> DataFrame:
    """One row for each event of a JSON frame, in columns of schemas.EVENT_SCHEMA; others of frames stay.

    A frame is parsed once, into FRAME.  A post with an embedded record is its metadata and, after
    it, a quote.  Malformed frames, other collections and other operations give no rows.
    """
    f = frames.withColumn("__f", F.from_json(column, FRAME))
    commit = F.col("__f.commit")
    f = f.withColumns({"time_us": F.col("__f.time_us").try_cast("long"), "__did": F.col("__f.did"), "__op": F.lower(commit["operation"]), "__in": commit["collection"], "__key": commit["rkey"], "__rec": commit["record"]})
    f = f.where((F.col("__f.kind") == "commit") & (F.col("__did") != "") & F.col("__op").isin("create", "delete"))
    r = F.col("__rec")
    is_object = F.coalesce(r["subject"], F.lit("")).startswith("{")
    subject = F.when(is_object, F.coalesce(F.get_json_object(r["subject"], "$.uri"), F.get_json_object(r["subject"], "$.did"))).otherwise(r["subject"])
    own = F.concat(F.lit("at://"), F.col("__did"), F.lit("/"), F.col("__in"), F.lit("/"), F.col("__key"))
    ts = F.greatest(F.floor(F.coalesce("time_us", F.lit(0)) / 1_000_000), F.lit(EPOCH)).cast("long")
    kind = r["embed"]["$type"]
    quoted = F.coalesce(r["embed"]["record"]["record"]["uri"], r["embed"]["record"]["uri"])
    no = F.lit(None)

    def event(name: str, post: Column = no, other: Column = no, signal: int | None = None, **more: Column) -> Column:
        return F.struct(
            F.lit(name).alias("kind"), F.col("__did").alias("user"), post.cast("string").alias("post"), other.cast("string").alias("other"), F.lit(signal).cast("int").alias("signal"), ts.alias("ts"),
            more.get("root", no).cast("string").alias("root"), more.get("parent", no).cast("string").alias("parent"), more.get("nsfw", no).cast("boolean").alias("nsfw"), more.get("topic", no).cast("string").alias("topic"),
        )

    created, has = F.col("__op") == "create", r.isNotNull()
    post_like = subject.isNotNull() & ~subject.rlike("|".join(NOT_POSTS))
    meta = event("post", own, root=r["reply"]["root"]["uri"], parent=r["reply"]["parent"]["uri"], nsfw=adult_labels(r["labels"]["values"]), topic=record_topic(r))
    quote = F.when(kind.rlike(r"app\.bsky\.embed\.record(WithMedia)?(#.*)?$") & quoted.isNotNull(), event("interaction", quoted, signal=2))
    events = (
        F.when(F.col("__op") == "delete", F.array(event("delete", own)))
        .when(created & has & (F.col("__in") == LIKE) & post_like, F.array(event("interaction", subject, signal=1)))
        .when(created & has & (F.col("__in") == REPOST) & post_like, F.array(event("interaction", subject, signal=3)))
        .when(created & has & (F.col("__in") == POST), F.filter(F.array(meta, quote), lambda x: x.isNotNull()))
        .when(created & has & (F.col("__in") == FOLLOW) & subject.isNotNull(), F.array(event("follow", other=subject)))
        .when(created & has & (F.col("__in") == BLOCK) & subject.isNotNull(), F.array(event("block", other=subject)))
    )
    out = f.select("*", F.posexplode(events).alias("part", "__e"))
    return out.select(*[c for c in frames.columns if c != column], "time_us", "part", "__e.*")


def last_event(events: DataFrame, key: str) -> DataFrame:
    """The last event of each frame."""
    return events.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("part").desc()))).where("__r = 1").drop("__r")


def folded(events: DataFrame) -> dict[str, DataFrame]:
    """Tables after events with an arrival order `seq`: edges, meta, follows, blocks.

    Only deletions of posts act: they remove what came before them; later interactions revive a
    post.  Interactions keep their first time, metadata its last version.
    """
    gone = events.where((F.col("kind") == "delete") & F.col("post").contains(f"/{POST}/")).groupBy("post").agg(F.max("seq").alias("gone"))
    alive = lambda d: d.join(gone, "post", "left").where("gone is null or seq > gone").drop("gone")
    acts = alive(events.where("kind = 'interaction'").select(F.col("user").alias("user_id"), "post", "signal", "ts", "seq"))
    edges = distinct_edges(acts.withColumnRenamed("post", "post_id"))
    posts = alive(events.where("kind = 'post'").select("post", "user", "root", "parent", "ts", "nsfw", "topic", "seq"))
    latest = F.max(F.struct("seq", F.col("user").alias("author_id"), F.col("root").alias("root_id"), F.col("parent").alias("parent_id"), F.col("ts").alias("created_at"), F.col("nsfw").alias("is_nsfw"), "topic")).alias("m")
    meta = posts.groupBy(F.col("post").alias("post_id")).agg(latest).select("post_id", "m.author_id", "m.root_id", "m.parent_id", "m.created_at", "m.is_nsfw", "m.topic")
    links = lambda kind: events.where(F.col("kind") == kind).groupBy("user", "other").agg(F.min("seq").alias("seq"))
    return {"edges": edges, "meta": meta, "follows": links("follow"), "blocks": links("block")}


def with_orphans(edges: DataFrame, meta: DataFrame) -> DataFrame:
    """meta, and rows made from the URIs of posts that have edges but no row.

    Author: the URI's; time: that of its key where it isn't more than an hour after the first
    interaction, else the interaction's.
    """
    first = edges.groupBy("post_id").agg(F.min_by("ts", "seq").alias("ts"))
    lost = first.join(meta.select("post_id"), "post_id", "left_anti").where(at_author(F.col("post_id")).isNotNull())
    key = key_seconds(record_key(F.col("post_id")))
    made = lost.select("post_id", at_author(F.col("post_id")).alias("author_id"), F.coalesce(F.when(key <= F.col("ts") + 3600, key), F.col("ts")).cast("long").alias("created_at"))
    return meta.unionByName(made, allowMissingColumns=True)


def dictionary(values: DataFrame, column: str = "value") -> DataFrame:
    """Numbers for distinct strings: value, id = local * 64 + shard, dense inside each of 64 shards."""
    d = values.select(F.col(column).alias("value")).where("value is not null").distinct().withColumn("shard", shard(F.col("value")))
    local = F.row_number().over(Window.partitionBy("shard").orderBy("value")) - 1
    return d.select("value", (local.cast("long") * 64 + F.col("shard")).alias("id"))


def looked_up(rows: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the number of a string column in `name`, null for strings without one."""
    return rows.join(known.select(F.col("value").alias(column), F.col("id").alias(name)), column, "left")


def resolved(rows: DataFrame, known: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the string of a number column in `name`, null for unknown numbers."""
    return rows.join(known.select(F.col("id").alias(column), F.col("value").alias(name)), column, "left")
