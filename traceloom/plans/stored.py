"""Queries over tables that are kept, and over what several machines or files hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import projects
from ..operators import activity, federation, fusion, repositories, transfer, vectors
from ..operators import records as rec
from ..scratch import scratch_path
from ..sinks.segments import Segments
from ..sinks.usage_cache import UsageCache
from ..sources import lines, probes
from ..streaming import counters
from .views import BASE_MS, RECORDS_SQL, USAGE_SQL, records, table, usage_events

# --- stored tables --------------------------------------------------------------------------------------------------


def segments_merge_on_read(spark, sf_dir):
    """Records appended by source, files of some conversations replaced by their answers alone, others removed, packed."""
    r = records(spark, sf_dir).select("source", "doc_id", "session_id", "role", "source_path")
    conv = F.floor(F.col("doc_id") / 1000)
    t = Segments(spark, scratch_path(spark, "segments"))
    t.append(r.filter("source = 'claude'"))
    t.append(r.filter("source = 'codex'"))
    t.replace_files(r.filter((conv % 5 == 0) & (F.col("role") == "assistant")), r.filter(conv % 5 == 0).select("source_path"))
    t.append(r.filter("source = 'pi'"))
    t.remove_files(r.filter(conv % 11 == 3).select("source_path"))
    t.compact(at_least=2)
    return t.read()


SEGMENTS_SQL = f"""WITH r AS (SELECT source, doc_id, session_id, role, source_path, doc_id // 1000 AS conv FROM ({RECORDS_SQL}))
SELECT source, doc_id, session_id, role, source_path FROM (
  SELECT * FROM r WHERE source <> 'pi' AND conv % 5 <> 0 UNION ALL SELECT * FROM r WHERE conv % 5 = 0 AND role = 'assistant' UNION ALL SELECT * FROM r WHERE source = 'pi') WHERE conv % 11 <> 3"""

LATE = BASE_MS + 15 * 86_400_000


def usage_cache_refresh(spark, sf_dir):
    """Each file's requests, with what its parent had used before it began. A first refresh comes before some files have
    their late events; the second computes only those and their forks."""
    n = F.regexp_extract("source_path", r"(\d+)", 1).cast("int")
    late = (n % 5 == 0) & (F.col("timestamp_ms") >= LATE)
    events = usage_events(spark, sf_dir).select("source_path", "session_id", n.alias("n"), "timestamp_ms", "output", "source_order")
    parent = F.when(F.col("n") % 3 == 1, F.concat(F.lit("s"), (F.col("n") - 1).cast("string")))
    done: list[DataFrame] = []

    def refresh(e: DataFrame) -> DataFrame:
        listing = e.groupBy("source_path", "session_id").agg(F.count("*").alias("size"), F.max("timestamp_ms").alias("modified"))

        def parents(paths: DataFrame) -> DataFrame:
            return e.join(paths, "source_path", "left_semi").select("source_path", parent.alias("parent_id")).filter("parent_id is not null").distinct()

        def compute(paths: DataFrame, needed: DataFrame) -> DataFrame:
            done.append(paths)
            own = e.join(paths, "source_path", "left_semi")
            began = own.groupBy("source_path").agg(F.min("timestamp_ms").alias("fork_ts"), F.first(parent).alias("parent_id"))
            of_parent = e.join(needed, "source_path", "left_semi").select("session_id", F.col("timestamp_ms").alias("ts"), "output")
            ground = counters.inherited(began.filter("parent_id is not null").withColumnRenamed("source_path", "source_order"), of_parent, ["output"]).select(F.col("source_order").alias("source_path"), F.col("output").alias("inherited"))
            total = own.groupBy("source_path").agg(F.count("*").alias("requests"), F.sum("output").alias("output"))
            return total.join(ground, "source_path", "left")

        return cache.refresh(listing, parents, compute)

    cache = UsageCache(spark, scratch_path(spark, "usage-cache"))
    refresh(events.filter(~late))
    rows = refresh(events)
    again = done[1].withColumn("computed_again", F.lit(True)) if len(done) > 1 else rows.select("source_path", F.lit(True).alias("computed_again")).limit(0)
    return rows.join(again, "source_path", "left").withColumn("computed_again", F.coalesce("computed_again", F.lit(False)))


CACHE_SQL = f"""WITH e AS (SELECT source_path, session_id, CAST(regexp_extract(source_path, '([0-9]+)', 1) AS INTEGER) AS n, timestamp_ms, output FROM ({USAGE_SQL})),
f AS (SELECT source_path, n, count(*) AS requests, CAST(sum(output) AS BIGINT) AS output, min(timestamp_ms) AS began, CASE WHEN n % 3 = 1 THEN 's' || (n - 1) END AS parent, count(*) FILTER (WHERE n % 5 = 0 AND timestamp_ms >= {LATE}) > 0 AS grown FROM e GROUP BY source_path, n)
SELECT f.source_path, f.requests, f.output, (SELECT max(e.output) FROM e WHERE e.session_id = f.parent AND e.timestamp_ms <= f.began) AS inherited,
       f.grown OR coalesce(p.grown, false) OR (f.parent IS NOT NULL AND p.n IS NULL) AS computed_again
FROM f LEFT JOIN f p ON f.parent = 's' || p.n"""


def vector_store(spark, sf_dir):
    """Vectors of one model, some of which come twice, then those of another, which drop the first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    v = vectors.VectorStore(spark, scratch_path(spark, "vectors"))
    v.add(e.filter("doc_id % 2 = 0"), "first", 64)
    v.add(e, "second", 64)
    v.add(e.filter("doc_id % 3 = 0"), "second", 64)
    return v.read().select("doc_id", F.lit(v.query_model("none")).alias("model"), F.size("embedding").alias("dims"))


VECTORS_SQL = "SELECT vec_id AS doc_id, 'second' AS model, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings"

# --- files and folders ----------------------------------------------------------------------------------------------


def _session_lines(spark, sf_dir) -> DataFrame:
    """A file a conversation: a line without a folder, one that names a folder, then turns that name session and folder."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = F.concat(F.lit("/home/kim/.claude/projects/-w-app/conv-"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    folder = F.concat(F.lit("/w/repo"), (F.col("conv_id") % 7).cast("string"), F.lit("/src/"), (F.col("turn") % 3).cast("string"))
    own = F.to_json(F.struct(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))).otherwise("other").alias("sessionId"), F.when(F.col("turn") > 0, folder).alias("cwd"), (F.col("conv_id") % 3 == 0).alias("isSidechain")))
    return c.select(name.alias("source_path"), F.col("turn").cast("long").alias("line_no"), own.alias("value"))


def probed_sessions(spark, sf_dir):
    return probes.probe_claude(_session_lines(spark, sf_dir))


_FOLDER = "'/w/repo' || (conv_id % 7) || '/src/' || (turn % 3)"
_PATH = "'/home/kim/.claude/projects/-w-app/conv-' || conv_id || '.jsonl'"
PROBED_SQL = f"""WITH l AS (SELECT conv_id, turn, {_FOLDER} AS cwd FROM conversations WHERE turn < 64),
f AS (SELECT conv_id, min(turn) FILTER (WHERE turn > 0) AS at FROM l GROUP BY conv_id)
SELECT {_PATH.replace("conv_id", "f.conv_id")} AS source_path, CASE WHEN f.conv_id % 2 = 0 THEN 'conv-' || f.conv_id ELSE 'other' END AS session_id, CAST(NULL AS VARCHAR) AS parent_session_id, l.cwd,
       coalesce(regexp_extract(l.cwd, '([^/]+)$', 1), 'w-app') AS project, CASE WHEN f.conv_id % 3 = 0 THEN 'sidechain' ELSE 'main' END AS conversation_kind
FROM f LEFT JOIN l ON l.conv_id = f.conv_id AND l.turn = f.at"""


def session_folders(spark, sf_dir):
    """Where each session was at work, and the repository that lies around it."""
    files = _session_lines(spark, sf_dir)
    sessions = files.select(F.lit("claude").alias("source"), lines.session_from_path(F.col("source_path")).alias("session_id"), "source_path").distinct()
    found = probes.session_folders(sessions, files)
    known = found.select(F.regexp_extract("cwd", r"^(/w/repo[0-4])/", 1).alias("root")).filter("root <> ''").distinct()
    known = known.withColumn("common_dir", F.when(F.col("root") < "/w/repo3", F.concat("root", F.lit("/.git"))).otherwise(F.lit("/git/shared")))
    return repositories.nearest(found, known).select("session_id", "cwd", "git_root", "repo_project", "resolution_status")


FOLDERS_SQL = f"""WITH l AS (SELECT conv_id, turn, {_FOLDER} AS cwd FROM conversations WHERE turn > 0),
s AS (SELECT c.conv_id, min_by(l.cwd, l.turn) AS cwd FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN l ON l.conv_id = c.conv_id GROUP BY c.conv_id),
r AS (SELECT *, nullif(regexp_extract(cwd, '^(/w/repo[0-4])/', 1), '') AS root FROM s)
SELECT 'conv-' || conv_id AS session_id, cwd, root AS git_root, CASE WHEN root IS NULL THEN NULL WHEN root < '/w/repo3' THEN substr(root, 4) ELSE 'shared' END AS repo_project, CASE WHEN root IS NULL THEN 'not-git' ELSE 'ok' END AS resolution_status FROM r"""


def project_names(spark, sf_dir):
    """Names of log folders of conversations, as they are decoded and as they are shown."""
    folder = F.element_at(F.array(*(F.lit(x) for x in ("src-", "", "dev-my-", "tools-"))), (F.col("conv_id") % 4 + 1).cast("int"))
    slug = F.concat(F.lit("-Users-kim-"), folder, F.lit("app"), (F.col("conv_id") % 9).cast("string"))
    return table(spark, sf_dir, "conversations").select(slug.alias("slug")).distinct().select("slug", projects.decode_slug(F.col("slug")).alias("project"), projects.display_project(F.col("slug")).alias("shown"))


NAMES_SQL = """WITH s AS (SELECT DISTINCT conv_id % 4 AS k, 'app' || (conv_id % 9) AS app FROM conversations)
SELECT '-Users-kim-' || ['src-', '', 'dev-my-', 'tools-'][k + 1] || app AS slug, [app, 'kim-' || app, 'my-' || app, 'kim-tools-' || app][k + 1] AS project, [app, '~/' || app, 'my-' || app, 'tools-' || app][k + 1] AS shown FROM s"""

# --- machines -------------------------------------------------------------------------------------------------------


def _machines(spark, sf_dir) -> dict:
    r = records(spark, sf_dir)
    return {m: (lambda s=s: r.filter(F.col("source") == s)) for m, s in (("desk", "claude"), ("local", "codex"), ("server", "pi"))}


_OF = "CASE source WHEN 'claude' THEN 'desk' WHEN 'codex' THEN 'local' ELSE 'server' END"


def federated_recent(spark, sf_dir):
    """The latest records of three machines; a fourth doesn't answer."""

    def down():
        raise ConnectionError("no answer")

    return federation.latest({**_machines(spark, sf_dir), "lost": down}, 25, ["doc_id"]).rows.select("machine", "ts", "doc_id")


RECENT_SQL = f"SELECT {_OF} AS machine, ts, doc_id FROM ({RECORDS_SQL}) ORDER BY ts DESC, doc_id, machine LIMIT 25"


def federated_activity(spark, sf_dir):
    """Records a day of the sessions asked for, each machine under its own keys."""
    parts = {m: (lambda f=f: f().withColumns({"day": F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd"), "n": F.lit(1)})) for m, f in _machines(spark, sf_dir).items()}
    keys = records(spark, sf_dir).filter(F.col("doc_id") % 7 == 0).select(F.when(F.col("source") == "pi", "desk").when(F.col("source") == "claude", "desk").otherwise("local").alias("machine"), "source", "session_id")
    return federation.activity(parts, keys, "day", "n").rows.select("day", "source", F.col("n").alias("records"))


ACTIVITY_SQL = f"""WITH r AS ({RECORDS_SQL}), k AS (SELECT DISTINCT source, session_id FROM r WHERE doc_id % 7 = 0 AND source <> 'pi')
SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS day, source, count(*) AS records FROM r SEMI JOIN k USING (source, session_id) GROUP BY ALL"""


def fused_order(spark, sf_dir):
    """Hits of three machines fused by rank, in the full order of their keys: many scores are equal."""
    parts = {m: f().filter("role = 'assistant'").select("source", "session_id", "source_path", "doc_id", "ts").orderBy("doc_id").limit(12) for m, f in _machines(spark, sf_dir).items()}
    fused = fusion.in_order(fusion.federate(parts, ["doc_id"], ["doc_id"]))
    return fused.limit(20).select("machine", "doc_id", F.round("score", 9).alias("score"))


FUSED_SQL = f"""WITH r AS (SELECT *, {_OF} AS machine FROM ({RECORDS_SQL}) WHERE role = 'assistant'), x AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY doc_id) - 1 AS rank FROM r)
SELECT machine, doc_id, round(1 / (60.0 + rank + 1), 9) AS score FROM x WHERE rank < 12 ORDER BY rank, ts DESC, machine, source, session_id, source_path, doc_id LIMIT 20"""


def distinct_sessions(spark, sf_dir):
    """A page of different sessions, from hits in which sessions stand many times."""
    hits = records(spark, sf_dir).select("session_id", "doc_id", F.length("text").alias("score"))
    order = [F.desc("score"), "doc_id"]
    return federation.distinct_page(lambda n: hits.orderBy(*order).limit(n), 15, order)


DISTINCT_SQL = f"SELECT session_id, doc_id, CAST(length(text) AS INTEGER) AS score FROM ({RECORDS_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC, doc_id) = 1 ORDER BY score DESC, doc_id LIMIT 15"

# --- texts and counts -----------------------------------------------------------------------------------------------


def compact_texts(spark, sf_dir):
    """Turns wrapped in the tags of a tool, as they are told to another one, and titles."""
    c = table(spark, sf_dir, "conversations")
    t, wrap = F.col("text"), lambda tag: F.concat(F.lit(f"<{tag}>"), F.col("text"), F.lit(f"</{tag}>"))
    k = F.col("turn") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("<Task-Notification> <summary> "), t, F.lit(" </summary><summary>other</summary>"))).when(k == 2, F.concat(wrap("command-name"), F.lit("\n"), F.lit("<command-message>go</command-message>")))
        .when(k == 4, F.concat(F.lit("<local-command-stdout>"), t)).when((k == 3) & (F.col("conv_id") % 2 == 0), F.concat(t, F.lit(" Operation\n aborted"))).when(k == 5, F.lit("Continue")).otherwise(t)
    )
    return c.select("conv_id", "turn", transfer.compact_text(F.col("role"), text).alias("told"), transfer.title_of(text).alias("title"))


_ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
COMPACT_SQL = f"""WITH c AS (SELECT *, turn % 6 AS k FROM conversations),
t AS (SELECT *, CASE WHEN k = 0 THEN '<Task-Notification> <summary> ' || text || ' </summary><summary>other</summary>' WHEN k = 2 THEN '<command-name>' || text || '</command-name>' || chr(10) || '<command-message>go</command-message>'
                     WHEN k = 4 THEN '<local-command-stdout>' || text WHEN k = 3 AND conv_id % 2 = 0 THEN text || ' Operation' || chr(10) || ' aborted' WHEN k = 5 THEN 'Continue' ELSE text END AS whole FROM c)
SELECT conv_id, turn, CASE WHEN role = 'user' AND k = 0 THEN '[Task notification] ' || {_ONE} WHEN role = 'user' AND k = 2 THEN '[Local command] ' || {_ONE} || ': go' WHEN role = 'user' AND k = 4 THEN '[Local command stdout]' WHEN role = 'user' AND k = 5 THEN '[User requested continuation]'
            WHEN role = 'assistant' AND k = 3 AND conv_id % 2 = 0 THEN '[Assistant error] Operation aborted' ELSE whole END AS told,
       CASE WHEN length(trim(split_part(whole, chr(10), 1))) > 120 THEN substr(trim(split_part(whole, chr(10), 1)), 1, 120) || '...' ELSE trim(split_part(whole, chr(10), 1)) END AS title FROM t"""


def visible_records(spark, sf_dir):
    """What a preview shows without tools: records of which every system turn is taken for a tool's, every 5th for a thought."""
    role = F.when(F.col("role") == "system", "tool_use").when(F.col("turn_id") % 5 == 4, "reasoning").otherwise(F.col("role"))
    return rec.visible(records(spark, sf_dir).withColumn("role", role)).select("doc_id", "role")


VISIBLE_SQL = f"SELECT doc_id, role FROM ({RECORDS_SQL}) WHERE role <> 'system' AND turn_id % 5 <> 4"


def tool_arguments(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *transfer.argument_hash(F.col("props")))


ARGUMENTS_SQL = "SELECT event_id, sha256(props) AS argument_sha256, CAST(octet_length(encode(props)) AS BIGINT) AS argument_bytes FROM events"


def diagnostics_merge(spark, sf_dir):
    """Counters of files added up by source: numbers, and maps by key."""
    e = usage_events(spark, sf_dir).groupBy("source", "source_path").agg(F.count_if("sidechain").alias("malformed_json_lines"), F.sum("reasoning").alias("orphan_tool_results"), F.collect_list("model").alias("models"))
    kinds = F.transform(F.array_sort(F.array_distinct("models")), lambda m: F.struct(m.alias("k"), F.size(F.filter("models", lambda x: x == m)).cast("long").alias("n")))
    merged = federation.merge_diagnostics(e.withColumn("unknown_semantic_types", F.map_from_entries(kinds)), ["source"])
    told = F.array_join(F.transform(F.array_sort(F.map_entries("unknown_semantic_types")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return merged.select("source", "malformed_json_lines", "orphan_tool_results", told.alias("kinds"))


DIAGNOSTICS_SQL = f"""WITH e AS ({USAGE_SQL}), k AS (SELECT source, string_agg(model || '=' || n, ',' ORDER BY model) AS kinds FROM (SELECT source, model, count(*) AS n FROM e GROUP BY ALL) GROUP BY source)
SELECT e.source, count(*) FILTER (WHERE sidechain) AS malformed_json_lines, CAST(sum(reasoning) AS BIGINT) AS orphan_tool_results, any_value(kinds) AS kinds FROM e JOIN k ON e.source = k.source GROUP BY e.source"""


def timeline_levels(spark, sf_dir):
    """Records by day in four levels of density."""
    days = records(spark, sf_dir).groupBy(F.floor((F.col("ts") - BASE_MS) / 86_400_000).alias("day")).agg(F.count("*").alias("value"))
    return activity.timeline_density(days, 4)


TIMELINE_SQL = f"""WITH d AS (SELECT (ts - {BASE_MS}) // 86400000 AS day, count(*) AS value FROM ({RECORDS_SQL}) GROUP BY 1), m AS (SELECT max(value) AS most FROM d)
SELECT day, value, CAST(CASE WHEN most = 1 THEN 1 ELSE ceil(value * 4 / most) END AS INTEGER) AS level FROM d, m"""

REGISTERED = {
    segments_merge_on_read: SEGMENTS_SQL, usage_cache_refresh: CACHE_SQL, vector_store: VECTORS_SQL, probed_sessions: PROBED_SQL, session_folders: FOLDERS_SQL, project_names: NAMES_SQL, federated_recent: RECENT_SQL,
    federated_activity: ACTIVITY_SQL, fused_order: FUSED_SQL, distinct_sessions: DISTINCT_SQL, compact_texts: COMPACT_SQL, visible_records: VISIBLE_SQL, tool_arguments: ARGUMENTS_SQL, diagnostics_merge: DIAGNOSTICS_SQL, timeline_levels: TIMELINE_SQL,
}
