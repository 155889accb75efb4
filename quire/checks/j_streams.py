"""Streams over the files of the given tables, run to their end, and corpus files read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.checks import check
from quire.plans import sessions
from quire.session import checkpoint_dir
from quire.sources.readers import text_corpus
from quire.sources.tables import table
from quire.streaming import streams as S
from quire.streaming.replay import arrivals, arrived, new_root, replay, run_batches, table_stream

_KEY = "concat(case event_type when 'click' then 'templates/' when 'view' then 'documents/2024/01/02/' else 'misc/' end, cast(user_id as {text}), '.docx')"


#: Files that events come in: by day of the month, but every fortieth event only with the last file.
_ARRIVAL = "case when event_id % 40 = 0 then 3 else {cast}((day(ts) - 1) / 8) end"


def arriving(spark, folder, root):
    """Events as a stream of four files; the first run sees two of them, the second goes on with the others."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival", F.expr(_ARRIVAL.format(cast="floor")).cast("int"))
    schema = events.drop("arrival").schema

    def run(stream, put):
        for numbers in (range(2), range(2, 4)):
            arrivals(events, "arrival", numbers, root)
            run_batches(stream(arrived(spark, root, schema)), put, root)

    return run


def keyed(events):
    return events.withColumn("key", F.expr(_KEY.format(text="string")))


@check(
    "ss01_activity_stream",
    "with a as (select *, cast(ts as date) as d, case event_type when 'click' then 'templates' when 'view' then 'generated' else 'other' end as b, " + _ARRIVAL.format(cast="floor") + " as f from events), "
    "edges as (select f, max(max(ts)) over (order by f rows between unbounded preceding and 1 preceding) - interval 1 day as edge from a group by f), "
    "l as (select d, b, coalesce(ts < edge, false) as late from a join edges using (f)) "
    "select day, count(*) filter (not late and b = 'templates') as templates, count(*) filter (not late and b = 'generated') as generated, count(*) filter (not late and b = 'other') as other, "
    "count(*) filter (not late) as count, count(*) filter (late) as late from (select cast(unnest(generate_series(date '2024-01-09', date '2024-02-05', interval 1 day)) as date) as day) s left join l on l.d = s.day group by 1",
)
def _(spark, folder):
    root = new_root(spark)
    arriving(spark, folder, root)(lambda events: keyed(events).select("key", "ts"), S.activity_sink(root))
    return S.activity_days(spark, root, "2024-02-05", 28)


@check(
    "ss01_activity_of_all_days",
    "select cast(ts as date) as day, case event_type when 'click' then 'templates' when 'view' then 'generated' else 'other' end as bucket, count(*) as n from events group by 1, 2",
)
def _(spark, folder):
    events = table_stream(spark, folder, "events").select(F.expr(_KEY.format(text="string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return replay(S.activity_stream(events))


@check(
    "ss02_latest_object_stream",
    f"select key, max(ts) as last_modified, max(struct_pack(ts := ts, etag := cast(event_id as varchar))).etag as etag from (select *, {_KEY.format(text='varchar')} as key from events) group by 1",
)
def _(spark, folder):
    root = new_root(spark)
    listed = lambda events: keyed(events).select("key", F.col("ts").alias("last_modified"), F.col("event_id").cast("string").alias("etag"))
    arriving(spark, folder, root)(listed, S.latest_sink(root))
    return S.latest_objects(spark, root)


@check(
    "ss02_listings_once",
    f"select key, cast(event_id as varchar) as etag, ts as last_modified from (select *, {_KEY.format(text='varchar')} as key from events)",
)
def _(spark, folder):
    # every listing comes twice in the same file
    events = table_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    listed = keyed(events).select("key", F.col("event_id").cast("string").alias("etag"), F.col("ts").alias("last_modified"))
    return replay(S.latest_object_stream(listed), "append")


def _purpose(of: str) -> str:
    return f"concat('Purpose: plan of {{n}}', {{nl}}, 'Venue: Room ', cast({of} as {{text}}))".replace("{n}", "the week")


_SAYS = (
    "case (conv_id + turn) % 7 when 0 then " + _purpose("conv_id") + " when 1 then concat('Room ', cast(turn as {text})) when 2 then 'Hello!' when 3 then repeat('a long line without fields. ', 12) "
    "when 4 then concat('Prepared by: Ada ', cast(turn as {text}), {nl}, 'nothing else here') when 6 then ' yes ' else text end"
)
FIELDS = ["purpose", "venue", "prepared_by", "owner"]


def turns(spark, folder):
    """Conversations whose users write notes, answers, greetings and what the table has."""
    return table(spark, folder, "conversations").withColumn("text", F.expr(_SAYS.format(text="string", nl="char(10)")))


_SESSIONS = (
    "with t as (select conv_id, turn, trim(said, ' ' || chr(10) || chr(9) || chr(13)) as said, (conv_id + turn) % 7 as k from (select *, " + _SAYS.format(text="varchar", nl="chr(10)") + " as said from conversations) c where role = 'user' and (conv_id + turn) % 7 <> 2), "
    "r as (select *, length(said) > 40 or contains(said, chr(10)) or length(said) - length(replace(said, '.', '')) >= 2 or length(said) - length(replace(said, ':', '')) >= 2 or length(said) - length(replace(said, '-', '')) >= 3 as notes from t), "
    "s as (select conv_id, turn, struct_pack(x := case when said <> '' and not (notes and length(said) > 200) then said else '' end, a := case when k = 0 then 'plan of the week' else '' end, b := case when k = 0 then 'Room ' || conv_id else '' end, "
    "c := case when k = 4 then 'Ada ' || turn else '' end, d := '') as v from r), "
    "f as (select conv_id, count(*) as turns, list_reduce(list_prepend(struct_pack(x := '', a := '', b := '', c := '', d := ''), list(v order by turn)), lambda p, q: struct_pack(x := '', "
    "a := case when q.a <> '' then q.a when p.a = '' then q.x else p.a end, "
    "b := case when q.b <> '' then q.b when p.b = '' and (q.a <> '' or p.a <> '') then q.x else p.b end, "
    "c := case when q.c <> '' then q.c when p.c = '' and (q.a <> '' or p.a <> '') and (q.b <> '' or p.b <> '') then q.x else p.c end, "
    "d := case when p.d = '' and (q.a <> '' or p.a <> '') and (q.b <> '' or p.b <> '') and (q.c <> '' or p.c <> '') then q.x else p.d end)) as g from s group by 1) "
    "select conv_id, turns, (g.a <> '')::bigint + (g.b <> '')::bigint + (g.c <> '')::bigint + (g.d <> '')::bigint as filled, "
    "concat_ws(',', case when g.a = '' then 'purpose' end, case when g.b = '' then 'venue' end, case when g.c = '' then 'prepared_by' end, case when g.d = '' then 'owner' end) as missing, "
    "case when g.a <> '' and g.b <> '' and g.c <> '' and g.d <> '' then 'ready' else 'clarifying' end as status, "
    "concat_ws('; ', case when g.a <> '' then 'purpose=' || g.a end, case when g.b <> '' then 'venue=' || g.b end, case when g.c <> '' then 'prepared_by=' || g.c end, case when g.d <> '' then 'owner=' || g.d end) as answers from f"
)


@check("cq25_session_answers", _SESSIONS)
def _(spark, folder):
    return sessions.session_answers(turns(spark, folder), FIELDS)


@check("ss03_session_stream", _SESSIONS)
def _(spark, folder):
    # the turns of a conversation come in shuffled files; a much later turn of another one closes all of them
    root = new_root(spark)
    stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60 + F.pmod(F.col("conv_id"), F.lit(50)))
    rows = turns(spark, folder).select("conv_id", "turn", "role", "text", stamp.alias("ts"), F.pmod(F.col("turn") * 2 + F.col("conv_id"), F.lit(3)).cast("int").alias("arrival"))
    late = rows.limit(1).select(F.lit(-1).cast("bigint").alias("conv_id"), "turn", F.lit("user").alias("role"), F.lit("yes").alias("text"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(3).alias("arrival"))
    arrivals(rows.unionByName(late), "arrival", range(4), root)
    sent = replay(S.session_stream(arrived(spark, root, rows.drop("arrival").schema), FIELDS), "update")
    return sessions.closing(sent.where("closed"), FIELDS)


@check("ss04_audit_stream", "select date_trunc('hour', ts) as hour, event_type as action, count(*) as n from events group by 1, 2")
def _(spark, folder):
    events = table_stream(spark, folder, "events").select(F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    return replay(S.audit_stream(events))


@check("ss04_audit_sink", "select event_id, user_id as template_id, event_type as action, ts from events")
def _(spark, folder):
    root = new_root(spark)
    told = lambda events: events.select("event_id", F.col("user_id").alias("template_id"), F.col("event_type").alias("action"), "ts")
    put = S.audit_sink(root)

    def twice(batch, number):
        # as after a lost commit: the same batch is written again
        put(batch, number)
        put(batch, number)

    arriving(spark, folder, root)(told, twice)
    return S.audit_events(spark, root, "event_id long, template_id long, action string, ts timestamp")


@check("sc08_text_corpus", "select lang, 'txt' as ext, sum(length(text) + 1)::bigint as chars from documents group by 1")
def _(spark, folder):
    root = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    table(spark, folder, "documents").select("text", "lang").write.partitionBy("lang").text(root)
    files = text_corpus(spark, root).select(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "ext", F.length("text").alias("n"))
    return files.groupBy("lang", "ext").agg(F.sum("n").alias("chars"))
