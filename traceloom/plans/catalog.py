"""Registered queries over the driver's tables, each with the DuckDB SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, projects, text, times
from ..operators import activity, context, evaluate, fusion, inverted, reconcile, search, sessions, transfer, usage, vectors
from ..operators import records as rec
from ..operators.records import Filter
from ..streaming import counters
from . import dialects, stored
from .views import BASE_MS, RECORDS_SQL, USAGE_SQL, records, table, usage_events

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
NOW_MS = BASE_MS + 100 * 86_400_000


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- sessions -------------------------------------------------------------------------------------------------------

SESSIONS_SQL = f"""
r AS ({RECORDS_SQL}),
o AS (SELECT *, max(ts) OVER (PARTITION BY source, session_id, source_path ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
s AS (SELECT source, session_id, source_path, min(ts) AS started_at, max(ts) AS last_at, count(*) AS message_count,
             coalesce(max_by(project, doc_id) FILTER (WHERE (before IS NULL OR ts >= before) AND project <> ''), min_by(project, doc_id)) AS project
      FROM o GROUP BY source, session_id, source_path)"""


def _sessions(spark, sf_dir):
    return sessions.roll_up(records(spark, sf_dir))


@register(f"WITH {SESSIONS_SQL} SELECT * FROM s")
def sessions_rollup(spark, sf_dir):
    return _sessions(spark, sf_dir)


@register(f"WITH {SESSIONS_SQL} SELECT source, session_id, source_path, project, started_at, last_at, message_count FROM s WHERE source IN ('claude', 'pi') AND last_at >= {BASE_MS + 5 * 86_400_000} ORDER BY last_at DESC, source, session_id, source_path LIMIT 20")
def sessions_recent(spark, sf_dir):
    out = sessions.query(_sessions(spark, sf_dir), ["claude", "pi"], since=BASE_MS + 5 * 86_400_000, limit=20)
    return out.select("source", "session_id", "source_path", "project", "started_at", "last_at", "message_count")


@register(f"WITH {SESSIONS_SQL} SELECT source, session_id, source_path, min(started_at) AS started_at, max(last_at) AS last_at, CAST(sum(message_count) AS BIGINT) AS message_count, max_by(project, age) AS project FROM (SELECT *, 0 AS age FROM s WHERE message_count > 1 UNION ALL SELECT *, 1 AS age FROM s) GROUP BY source, session_id, source_path")
def sessions_merge(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    return sessions.merge(s.filter("message_count > 1"), s)


_SCOPED = "cwd AS (SELECT *, '/home/u' || CAST(started_at // 1000 % 5 AS VARCHAR) || CASE WHEN started_at // 1000 % 2 = 0 THEN '/App' ELSE '_x' END AS cwd, CASE WHEN started_at // 1000 % 7 = 0 THEN '/home/u1' END AS git_root FROM s)"


def _with_cwd(spark, sf_dir):
    sec = F.expr("started_at div 1000")
    five, two = sec % 5, sec % 2
    return _sessions(spark, sf_dir).withColumns({
        "cwd": F.concat(F.lit("/home/u"), five.cast("string"), F.when(two == 0, "/App").otherwise("_x")), "git_root": F.when(sec % 7 == 0, "/home/u1"),
    })


@register(f"WITH {SESSIONS_SQL}, {_SCOPED} SELECT source, session_id, cwd FROM cwd WHERE lower(cwd) = '/home/u1' OR starts_with(lower(cwd), '/home/u1/') OR git_root = '/home/u1'")
def sessions_under_folder(spark, sf_dir):
    return _with_cwd(spark, sf_dir).filter(sessions.under("/home/u1/")).select("source", "session_id", "cwd")


@register(f"WITH {SESSIONS_SQL}, {_SCOPED} SELECT doc_id, role FROM r WHERE EXISTS (SELECT 1 FROM cwd c WHERE c.source = r.source AND c.session_id = r.session_id AND c.source_path = r.source_path AND starts_with(lower(c.cwd), '/home/u2/'))")
def scope_semi_join(spark, sf_dir):
    scope = _with_cwd(spark, sf_dir).filter(F.lower("cwd").startswith("/home/u2/"))
    return rec.in_scope(records(spark, sf_dir), scope).select("doc_id", "role")


@register(f"WITH {SESSIONS_SQL} SELECT DISTINCT project FROM s WHERE project <> ''")
def distinct_projects(spark, sf_dir):
    return sessions.projects(_sessions(spark, sf_dir))


@register(f"WITH {SESSIONS_SQL} SELECT project, count(*) AS sessions, max(last_at) AS last_at, array_to_string(list_sort(list(last_at)), ',') AS times FROM s GROUP BY project")
def project_timeline(spark, sf_dir):
    return sessions.timeline(_sessions(spark, sf_dir)).withColumn("times", F.array_join(F.col("times").cast("array<string>"), ","))


@register(f"WITH {SESSIONS_SQL}, p AS (SELECT source, session_id, source_path, CASE WHEN last_at % 3 = 0 THEN 'repo-' || source WHEN last_at % 3 = 1 THEN '' END AS repo FROM s) SELECT r.doc_id, coalesce(nullif(p.repo, ''), r.project) AS project FROM r LEFT JOIN p ON r.source = p.source AND r.session_id = p.session_id AND r.source_path = p.source_path")
def repo_projects(spark, sf_dir):
    third = F.col("last_at") % 3
    s = _sessions(spark, sf_dir).withColumn("repo_project", F.when(third == 0, F.concat(F.lit("repo-"), F.col("source"))).when(third == 1, ""))
    return sessions.with_repo_project(records(spark, sf_dir), s).select("doc_id", "project")


@register(f"WITH r AS ({RECORDS_SQL}) SELECT source, session_id, left(min_by(text, doc_id) FILTER (WHERE role = 'user' AND trim(text) <> ''), 120) AS title, count(*) AS messages, count(*) FILTER (WHERE role = 'tool_use') AS tool_calls, count(*) FILTER (WHERE role = 'tool_result') AS tool_results FROM r GROUP BY source, session_id")
def transfer_stats(spark, sf_dir):
    return transfer.stats(records(spark, sf_dir))


# --- records --------------------------------------------------------------------------------------------------------


@register(f"WITH r AS ({RECORDS_SQL}) SELECT doc_id, source, role, ts FROM r WHERE role = 'user' AND source IN ('codex', 'pi', 'codex-session', 'codex-history') AND ts >= {BASE_MS} AND ts <= {BASE_MS + 40 * 86_400_000}")
def search_filters(spark, sf_dir):
    f = Filter(role="user", sources=("codex", "pi"), since=BASE_MS, until=BASE_MS + 40 * 86_400_000)
    return records(spark, sf_dir).filter(f.condition()).select("doc_id", "source", "role", "ts")


@register(f"WITH r AS ({RECORDS_SQL}) SELECT doc_id, ts, project FROM r WHERE source IN ('claude') ORDER BY ts DESC, doc_id LIMIT 25")
def recent_records(spark, sf_dir):
    return rec.recent(records(spark, sf_dir), 25, Filter(sources=("claude",))).select("doc_id", "ts", "project")


@register(f"WITH r AS ({RECORDS_SQL}), own AS (SELECT * FROM r WHERE session_id = 'conv-3') SELECT doc_id, turn_id, role, (SELECT count(*) FROM own) AS total, (SELECT min(ts) FROM own) AS first_ts, (SELECT max(ts) FROM own) AS last_ts, CASE WHEN (SELECT count(*) FROM own) > 4 THEN 4 END AS next_offset FROM own ORDER BY turn_id, ts, doc_id LIMIT 3 OFFSET 1")
def session_page(spark, sf_dir):
    return rec.session_page(records(spark, sf_dir), "conv-3", 1, 3).select("doc_id", "turn_id", "role", "total", "first_ts", "last_ts", "next_offset")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY length(text) DESC, ts DESC, doc_id) AS rank_in_session FROM r) SELECT doc_id, source, session_id, rank_in_session FROM x WHERE rank_in_session <= 2")
def per_session_topn(spark, sf_dir):
    hits = records(spark, sf_dir).withColumn("score", F.length("text"))
    return rec.top_per_session(hits, 2).select("doc_id", "source", "session_id", "rank_in_session")


@register(f"WITH r AS ({RECORDS_SQL}) SELECT doc_id FROM r WHERE role IN ('user', 'assistant') AND text <> ''")
def embeddable_records(spark, sf_dir):
    return rec.embeddable(records(spark, sf_dir)).select("doc_id")


@register(f"""WITH r AS ({RECORDS_SQL}), h AS (SELECT *, length(text) % 9 AS score, row_number() OVER (ORDER BY length(text) % 9 DESC, doc_id) AS ord, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(text, 10) END AS snippet FROM r WHERE role = 'assistant'),
t AS (SELECT *, max(score) OVER (PARTITION BY project) AS top FROM h)
SELECT project AS grp, count(*) AS hits, max(ts) AS last_ts, max(score) AS top_score, min_by(source, ord) AS source, max_by(source_path, ord) FILTER (WHERE score = top) AS source_path, max_by(snippet, ord) FILTER (WHERE score = top AND snippet <> '') AS snippet FROM t GROUP BY project""")
def hits_by_group(spark, sf_dir):
    h = records(spark, sf_dir).filter("role = 'assistant'").withColumns({"score": F.length("text") % 9, "snippet": F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 1, 10))})
    # best first, then by id: as one number, so that no task has to rank all rows
    h = h.withColumn("ord", (9 - F.col("score")).cast("long") * F.lit(10**15) + F.col("doc_id"))
    return sessions.group_hits(h.withColumn("grp", F.col("project")), "grp").drop("project")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT *, last_value(nullif(project, '') IGNORE NULLS) OVER (PARTITION BY source, session_id ORDER BY turn_id, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sticky FROM r) SELECT doc_id, sticky FROM x")
def sticky_metadata(spark, sf_dir):
    r = records(spark, sf_dir).withColumn("named", F.nullif("project", F.lit("")))
    return context.fill_forward(r, "named", "sticky", ["source", "session_id"], ["turn_id", "doc_id"]).select("doc_id", "sticky")


@register(f"WITH r AS ({RECORDS_SQL}) SELECT h.session_id, h.role, trim(h.text) AS text, h.ts // 1000 * 1000 AS ts FROM r h WHERE h.role = 'user' AND h.source = 'codex' AND NOT EXISTS (SELECT 1 FROM r o WHERE o.source = 'codex' AND o.role = 'assistant' AND o.session_id = h.session_id)")
def history_anti_join(spark, sf_dir):
    from ..sources import codex

    r = records(spark, sf_dir).filter("source = 'codex'")
    prompt = F.to_json(F.struct("session_id", "text", F.floor(F.col("ts") / 1000).alias("ts")))
    prompts = r.filter("role = 'user'").select(prompt.alias("value"), F.lit("/home/kim/.codex/history.jsonl").alias("source_path"), F.col("doc_id").alias("line_no"))
    return codex.history(prompts, r.filter("role = 'assistant'")).select("session_id", "role", "text", "ts")


# --- retrieval ------------------------------------------------------------------------------------------------------

QUERY = "the idiot of that"


def _bm25_sql(query: str = QUERY) -> str:
    q = ", ".join(f"('{t}')" for t in search.terms_of(query))
    return f"""
q(term) AS (VALUES {q}),
tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND length(x) <= 255) AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT tf.doc_id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(tok.t) / n.mean))) AS score
       FROM tf JOIN df ON tf.term = df.term JOIN tok ON tf.doc_id = tok.doc_id CROSS JOIN n GROUP BY tf.doc_id)"""


_indexes: dict[tuple[str, str], inverted.Index] = {}


def _index(spark, sf_dir) -> inverted.Index:
    """The index of a folder's documents, built when a session first asks for it."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _indexes:
        _indexes[name] = inverted.Index.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return _indexes[name]


def _hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), *more)


@register(f"WITH {_bm25_sql()} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    return _hits(_index(spark, sf_dir).top(QUERY, 20)).orderBy(F.desc("score"), "doc_id").limit(20)


_TS = f"({BASE_MS} + doc_id * 3600000)"


@register(f"WITH {_bm25_sql()} SELECT doc_id, round(score * (1 + exp(-ln(2) * greatest({NOW_MS} - {_TS}, 0) / 86400000.0 / 30.0)), 6) AS score FROM bm ORDER BY 2 DESC, doc_id LIMIT 20")
def bm25_recency(spark, sf_dir):
    ts = F.lit(BASE_MS) + F.col("key") * 3_600_000
    fresh = lambda found: found.withColumn("score", search.recency(F.col("score"), ts, NOW_MS))
    return _hits(_index(spark, sf_dir).top(QUERY, 20, fresh, 2.0)).orderBy(F.desc("score"), "doc_id").limit(20)


@register(f"WITH {_bm25_sql()}, x AS (SELECT bm.doc_id, d.source, row_number() OVER (PARTITION BY d.source ORDER BY round(score, 6) DESC, bm.doc_id) AS rank_in_source FROM bm JOIN documents d ON bm.doc_id = d.doc_id) SELECT * FROM x WHERE rank_in_source <= 3")
def bm25_top_per_source(spark, sf_dir):
    from pyspark.sql import Window

    hits = _hits(_index(spark, sf_dir).matches(QUERY)).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank_in_source", n).filter("rank_in_source <= 3").drop("score")


def _query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding)


_KNN = "knn AS (SELECT e.vec_id, e.label, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@register(f"WITH {_KNN} SELECT vec_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score FROM knn ORDER BY distance, vec_id LIMIT 10")
def knn_cosine(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@register(f"WITH {_KNN}, top AS (SELECT * FROM knn ORDER BY distance, vec_id LIMIT 50) SELECT t.vec_id, d.lang FROM top t JOIN documents d ON d.doc_id = t.vec_id WHERE d.lang = 'en'")
def knn_postfilter(spark, sf_dir):
    found = vectors.nearest(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), _query_vector(spark, sf_dir), 50)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return vectors.hits(found, docs, F.col("lang") == "en").select(F.col("doc_id").alias("vec_id"), "lang")


_LEX = "lex AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM (SELECT * FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 50))"
_SEM = "sem AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM (SELECT * FROM knn ORDER BY distance, vec_id LIMIT 50))"


@register(f"WITH {_bm25_sql()}, {_KNN}, {_LEX}, {_SEM}, f AS (SELECT doc_id, sum(1 / (60.0 + rank + 1)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem) GROUP BY doc_id) SELECT doc_id, round(score, 9) AS score FROM f ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    n = rec.candidates(10, hybrid=True)
    lex = _hits(_index(spark, sf_dir).top(QUERY, n)).orderBy(F.desc("score"), "doc_id").limit(n)
    sem = vectors.nearest(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), _query_vector(spark, sf_dir), n).select("doc_id", "distance")
    lists = fusion.ranked(lex, F.desc("score"), "doc_id").select("doc_id", "rank").unionByName(fusion.ranked(sem, "distance", "doc_id").select("doc_id", "rank"))
    out = fusion.fuse(lists, ["doc_id"]).withColumn("score", F.round("score", 9))
    return out.orderBy(F.desc("score"), "doc_id").limit(10)


_VIEWS = (QUERY, "stupid thing", "that was")
_N_VIEW = rec.candidates(20, views=3)


def _views_sql() -> str:
    """Each view's first hits by rounded score; a document's language comes from where its own score is highest."""
    views = ", ".join(f"v{k} AS (WITH {_bm25_sql(q)} SELECT {k} AS view, doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < {_N_VIEW})" for k, q in enumerate(_VIEWS))
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(_VIEWS)))
    return f"WITH {views}, f AS (SELECT v.doc_id, arg_max(d.lang, struct_pack(s := v.score, v := -view, r := -rank)) AS lang, sum(1 / (60.0 + rank + 1)) AS score FROM ({every}) v JOIN documents d ON d.doc_id = v.doc_id GROUP BY v.doc_id) SELECT doc_id, lang, round(score, 9) AS score FROM f ORDER BY round(score, 9) DESC, doc_id LIMIT 20"


@register(_views_sql())
def multiview_rrf(spark, sf_dir):
    lists = None
    for view, q in enumerate(_VIEWS):
        top = _hits(_index(spark, sf_dir).top(q, _N_VIEW)).orderBy(F.desc("score"), "doc_id").limit(_N_VIEW)
        part = fusion.ranked(top, F.desc("score"), "doc_id").withColumn("view", F.lit(view))
        lists = part if lists is None else lists.unionByName(part)
    lists = table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(lists), "doc_id")  # three lists of fixed length
    return fusion.fuse_views(lists, ["doc_id"], ["lang"]).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(20)


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT source AS machine, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) - 1 AS rank FROM r WHERE role = 'assistant') SELECT machine, doc_id, round(1 / (60.0 + rank + 1), 9) AS score FROM x WHERE rank < 10")
def federated_rrf(spark, sf_dir):
    r = records(spark, sf_dir).filter("role = 'assistant'").withColumn("score", F.length("text"))
    parts = {m: r.filter(F.col("source") == m).orderBy(F.desc("score"), "doc_id").limit(10) for m in ("claude", "codex", "pi")}
    return fusion.federate(parts, [F.desc("score"), "doc_id"], ["doc_id"]).select("machine", "doc_id", F.round("score", 9).alias("score"))


# --- context --------------------------------------------------------------------------------------------------------


@register(f"""WITH r AS ({RECORDS_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY source, session_id ORDER BY turn_id, ts, doc_id) AS pos FROM r),
a AS (SELECT source, session_id, doc_id AS anchor, pos AS anchor_at FROM o WHERE role = 'user' AND turn_id = 2)
SELECT a.anchor, o.doc_id, o.pos - a.anchor_at AS distance, CASE WHEN o.pos < a.anchor_at THEN 'before' WHEN o.pos > a.anchor_at THEN 'after' ELSE 'anchor' END AS relation
FROM o JOIN a ON o.source = a.source AND o.session_id = a.session_id WHERE o.pos - a.anchor_at BETWEEN -2 AND 1""")
def context_window(spark, sf_dir):
    anchors = (F.col("role") == "user") & (F.col("turn_id") == 2)
    return context.around(records(spark, sf_dir), anchors, 2, 1).select("anchor", "doc_id", F.col("distance").cast("long").alias("distance"), "relation")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT doc_id, contains(text, 'the') AS is_match, max(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY source, session_id ORDER BY turn_id, ts, doc_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM r) SELECT doc_id, is_match FROM x WHERE near = 1")
def match_neighbourhood(spark, sf_dir):
    return context.near_matches(records(spark, sf_dir), F.col("text").contains("the")).select("doc_id", "is_match")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT doc_id, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY source, session_id ORDER BY turn_id DESC, ts DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM r) SELECT doc_id FROM x WHERE behind < 2")
def last_user_turns(spark, sf_dir):
    return context.last_user_turns(records(spark, sf_dir), 2).select("doc_id")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT doc_id, row_number() OVER (PARTITION BY source, session_id ORDER BY turn_id DESC, ts DESC, doc_id DESC) AS n FROM r) SELECT doc_id FROM x WHERE n <= 3")
def tail_preview(spark, sf_dir):
    return context.tail(records(spark, sf_dir), 3).select("doc_id")


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT doc_id, role, text, lag(role) OVER w AS r0, lag(text) OVER w AS t0, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY source, session_id ORDER BY turn_id, ts, doc_id)) SELECT doc_id FROM x WHERE n = 1 OR NOT (r0 IS NOT DISTINCT FROM role AND t0 IS NOT DISTINCT FROM text)")
def consecutive_dedupe(spark, sf_dir):
    return transfer.drop_repeats(records(spark, sf_dir)).select("doc_id")


#: Without repeats, a message's pair with the next one is told n times in a row; where n is 3 or more, 2 * n messages are one pair.
COMPACTED_SQL = f"""WITH RECURSIVE r AS ({RECORDS_SQL}),
k AS (SELECT source, session_id, role, text, row_number() OVER w AS i FROM (SELECT *, lag(role) OVER w AS b_role, lag(text) OVER w AS b_text, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY source, session_id ORDER BY turn_id, ts, doc_id))
      WHERE n = 1 OR NOT (b_role IS NOT DISTINCT FROM role AND b_text IS NOT DISTINCT FROM text) WINDOW w AS (PARTITION BY source, session_id ORDER BY n)),
e AS (SELECT *, coalesce(struct_pack(a := role, b := text) = struct_pack(a := lead(role, 2) OVER w, b := lead(text, 2) OVER w) AND struct_pack(a := lead(role) OVER w, b := lead(text) OVER w) = struct_pack(a := lead(role, 3) OVER w, b := lead(text, 3) OVER w) AND lead(i, 3) OVER w IS NOT NULL, false) AS again FROM k WINDOW w AS (PARTITION BY source, session_id ORDER BY i)),
n AS (SELECT *, 1 + (min(CASE WHEN NOT again THEN i END) OVER (PARTITION BY source, session_id, i % 2 ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i) // 2 AS times FROM e),
s AS (SELECT *, CASE WHEN times >= 3 THEN 2 * times ELSE 1 END AS step FROM n),
p AS (SELECT source, session_id, i, step, times FROM s WHERE i = 1 UNION ALL SELECT s.source, s.session_id, s.i, s.step, s.times FROM p JOIN s ON s.source = p.source AND s.session_id = p.session_id AND s.i = p.i + p.step),
t AS (SELECT source, session_id, i, CASE WHEN step > 1 THEN times ELSE 1 END AS times FROM p UNION ALL SELECT source, session_id, i + 1, times FROM p WHERE step > 1)
SELECT t.source, t.session_id, row_number() OVER (PARTITION BY t.source, t.session_id ORDER BY t.i) - 1 AS "at", k.role, k.text, t.times FROM t JOIN k ON k.source = t.source AND k.session_id = t.session_id AND k.i = t.i"""


@register(COMPACTED_SQL)
def compacted_transcripts(spark, sf_dir):
    return transfer.compact(records(spark, sf_dir))


#: Conversations refer to each other in pairs and, every fifth, along a chain of ten: closures of several rounds.
@register(f"""WITH RECURSIVE r AS ({RECORDS_SQL}), e AS (SELECT doc_id, session_id AS identifier FROM r UNION SELECT doc_id, 'pair' || CAST(doc_id // 2000 AS VARCHAR) FROM r WHERE turn_id = 0 UNION SELECT doc_id, 'ten' || CAST(doc_id // 10000 AS VARCHAR) FROM r WHERE turn_id = 1 AND doc_id // 1000 % 5 = 0),
c(doc_id) AS (SELECT doc_id FROM r WHERE doc_id = 1000 UNION SELECT y.doc_id FROM c JOIN e x ON c.doc_id = x.doc_id JOIN e y ON x.identifier = y.identifier)
SELECT doc_id FROM c""")
def interaction_closure(spark, sf_dir):
    r, conv = records(spark, sf_dir), F.expr("doc_id div 1000")
    edges = r.select("doc_id", F.col("session_id").alias("identifier"))
    for name, size, on in (("pair", 2000, F.col("turn_id") == 0), ("ten", 10000, (F.col("turn_id") == 1) & (conv % 5 == 0))):
        edges = edges.union(r.filter(on).select("doc_id", F.concat(F.lit(name), F.expr(f"doc_id div {size}").cast("string"))))
    return context.closure(edges, r.filter("doc_id = 1000"), "doc_id")


def _framed_sql(*values: str) -> str:
    """Each value's length in eight bytes, the lowest first, and its bytes, in hexadecimal digits."""
    return " || ".join(f"printf('%02x%02x000000000000', octet_length(encode({v})) % 256, octet_length(encode({v})) // 256) || lower(hex(encode({v})))" for v in values)


@register(f"""WITH r AS ({RECORDS_SQL})
SELECT doc_id, 'rid1_' || sha256(unhex({_framed_sql("'version'", "'rid1'", "'source'", "source")} || CASE WHEN turn_id % 2 = 0 THEN {_framed_sql("'session'", "session_id", "'event'", "'e' || doc_id")} ELSE {_framed_sql("'session'", "session_id", "'source-path'", "source_path", "'turn'", "CAST(turn_id AS VARCHAR)")} END || {_framed_sql("'role'", "role", "'tool'", "''")})) AS record_id FROM r""")
def canonical_ids(spark, sf_dir):
    r = records(spark, sf_dir).withColumns({"event_id": F.when(F.col("turn_id") % 2 == 0, F.concat(F.lit("e"), F.col("doc_id").cast("string"))), "source_tool_use_id": F.lit(None).cast("string"), "tool_name": F.lit(None).cast("string")})
    return r.select("doc_id", ids.canonical_record_id().alias("record_id"))


# --- usage ----------------------------------------------------------------------------------------------------------

_RATES_SQL = "rates(base, family, r_input, r_w5, r_w1, r_read, r_output) AS (VALUES " + ", ".join(
    [f"('{m}', 'openai', {i}, {i}, {i}, {r}, {o})" for m, (i, r, o) in usage.OPENAI.items()] + [f"('{m}', 'anthropic', {i}, {w5}, {w1}, {r}, {o})" for m, (i, w5, w1, r, o) in usage.ANTHROPIC.items()]
) + ")"
_COST_SQL = f"""
e AS ({USAGE_SQL}), {_RATES_SQL},
p AS (SELECT e.*, r_input, r_w5, r_w1, r_read, r_output FROM e LEFT JOIN rates ON regexp_replace(lower(trim(model)), '-20[0-9-]*$', '') = base
      AND ((family = 'openai' AND (provider = '' OR contains(provider, 'openai') OR contains(provider, 'codex'))) OR (family = 'anthropic' AND (provider = '' OR contains(provider, 'anthropic'))))),
k AS (SELECT *, CAST(round(source_cost_usd * 1000000000) AS BIGINT) AS own,
             uncached_input * r_input + cache_read * r_read + (cache_write - least(cache_write_1h, cache_write)) * r_w5 + least(cache_write_1h, cache_write) * r_w1 + output * r_output AS calc FROM p),
c AS (SELECT *, coalesce(own, CASE WHEN NOT cost_authoritative THEN calc END) AS cost_nanos FROM k)"""


def _costed(spark, sf_dir):
    return usage.with_cost(usage.priced(usage_events(spark, sf_dir)), "auto")


@register(f"WITH {_COST_SQL} SELECT source, count(*) AS events, CAST(sum(uncached_input) AS BIGINT) AS uncached_input, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(output) AS BIGINT) AS output, CAST(sum(reasoning) AS BIGINT) AS reasoning, CAST(sum(uncached_input + cache_read + cache_write + output) AS BIGINT) AS total_tokens, CAST(coalesce(sum(cost_nanos), 0) AS BIGINT) AS cost_nanos, count(*) FILTER (WHERE cost_nanos IS NOT NULL) AS priced_events, count(*) FILTER (WHERE cost_nanos IS NULL) AS unpriced_events, count(*) FILTER (WHERE conservative_undercount) AS conservative_events FROM c GROUP BY source")
def usage_by_source(spark, sf_dir):
    return usage.report(_costed(spark, sf_dir))


@register(f"WITH {_COST_SQL} SELECT source_order, cost_nanos, calc AS catalog_nanos FROM c")
def usage_cost(spark, sf_dir):
    e = usage.priced(usage_events(spark, sf_dir))
    both = usage.with_cost(usage.with_cost(e, "reprice").withColumnRenamed("cost_nanos", "catalog_nanos"), "auto")
    return both.select("source_order", "cost_nanos", "catalog_nanos")


@register(f"WITH {_COST_SQL} SELECT 'local/' || source AS source, count(*) AS events FROM c GROUP BY source UNION ALL SELECT 'far/' || source, count(*) FROM c WHERE source <> 'pi' GROUP BY source")
def usage_federated(spark, sf_dir):
    c = _costed(spark, sf_dir)
    return usage.merge_reports({"local": usage.report(c), "far": usage.report(c.filter("source <> 'pi'"))}).select("source", "events")


@register(f"WITH e AS ({USAGE_SQL}) SELECT source_order FROM e WHERE timestamp_ms >= {BASE_MS + 86_400_000} AND timestamp_ms < {BASE_MS + 5 * 86_400_000} AND project = 'proj-3'")
def usage_filter(spark, sf_dir):
    return usage.select_events(usage_events(spark, sf_dir), BASE_MS + 86_400_000, BASE_MS + 5 * 86_400_000, "PROJ-3").select("source_order")


@register(f"WITH e AS ({USAGE_SQL}) SELECT session_id, round(sum(cache_read) / nullif(sum(uncached_input + cache_read + cache_write), 0), 9) AS hit_rate FROM e GROUP BY session_id HAVING sum(cache_read + cache_write) > 0")
def cache_hit_rate(spark, sf_dir):
    return usage.report(usage.with_cost(usage.priced(usage_events(spark, sf_dir))), "session_id").select("session_id", F.round(usage.hit_rate(), 9).alias("hit_rate")).filter("hit_rate is not null")


@register(f"""WITH e AS ({USAGE_SQL}), b AS (SELECT *, CASE WHEN source = 'opencode' THEN '' ELSE source_path END AS thread, cache_chain_excluded OR conservative_undercount AS reset, uncached_input + cache_read + cache_write AS prompt FROM e WHERE NOT sidechain AND session_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY source, session_id, thread ORDER BY timestamp_ms, source_path, source_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM b),
f AS (SELECT * FROM s WHERE NOT reset AND prompt > 0),
g AS (SELECT *, lag(prompt) OVER w AS pp, lag(coalesce(provider, '') || '|' || coalesce(model, '')) OVER w AS pm, lag(timestamp_ms) OVER w AS pts, coalesce(max(CASE WHEN cache_read + cache_write > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, session_id, thread, seg ORDER BY timestamp_ms, source_path, source_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM f WINDOW w AS (PARTITION BY source, session_id, thread, seg ORDER BY timestamp_ms, source_path, source_order))
SELECT source_order, greatest(least(pp, prompt) - cache_read, 0) AS missed_tokens, pm <> coalesce(provider, '') || '|' || coalesce(model, '') AS model_switch, pm = coalesce(provider, '') || '|' || coalesce(model, '') AND timestamp_ms - pts >= 300000 AS idle
FROM g WHERE pp IS NOT NULL AND (cache_read > 0 OR used = 1) AND prompt * 2 >= pp AND greatest(least(pp, prompt) - cache_read, 0) > 1024""")
def cache_waste(spark, sf_dir):
    return usage.cache_misses(usage_events(spark, sf_dir)).select("source_order", "missed_tokens", "model_switch", "idle")


@register("SELECT l_orderkey, l_linenumber, least(t, run) - least(t, run - q) AS capped FROM (SELECT l_orderkey, l_linenumber, q, t, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT l.*, CAST(l_quantity AS BIGINT) AS q, CAST(floor(o_totalprice / 1000) AS BIGINT) AS t FROM lineitem l JOIN orders ON l_orderkey = o_orderkey))")
def capped_allocation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("t"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return usage.cap_to_total(usage.dealt(li, ["l_orderkey"]).join(o, "l_orderkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"], "q", "t").select("l_orderkey", "l_linenumber", "capped")


@register("SELECT o_orderkey AS l_orderkey, CAST(greatest(floor(o_totalprice / 1000) - coalesce(q, 0), 0) AS BIGINT) AS residual FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE floor(o_totalprice / 1000) - coalesce(q, 0) > 0")
def residual_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("t"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    return usage.residuals(o, usage.dealt(li, ["l_orderkey"]), ["l_orderkey"], "q", "t")


@register(f"""WITH e AS ({USAGE_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY message_id, request_id ORDER BY CAST(sidechain AS INTEGER), CAST(contains(source_path, '/subagents/') AS INTEGER), uncached_input + cache_read + cache_write + output DESC, source_order DESC) AS n FROM e),
y AS (SELECT * FROM x WHERE message_id IS NULL OR n = 1), z AS (SELECT *, max(CASE WHEN sidechain THEN 0 ELSE 1 END) OVER (PARTITION BY message_id) AS main FROM y)
SELECT source_order FROM z WHERE message_id IS NULL OR NOT sidechain OR main = 0""")
def best_copy_dedupe(spark, sf_dir):
    return reconcile.best_claude(usage_events(spark, sf_dir)).select("source_order")


@register(f"WITH e AS ({USAGE_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY source_path, source_order) AS n FROM e) SELECT source_order FROM x WHERE source_record_id IS NULL OR n = 1")
def first_copy_dedupe(spark, sf_dir):
    return reconcile.first_by_record(usage_events(spark, sf_dir)).select("source_order")


_PARTS = ("input", "cached", "output", "reasoning")
#: A file's lines in turn, each against what the lines before it have paid (p_), their highest total (h_) and the latest totals.
COUNTERS_SQL = f"""
WITH RECURSIVE e AS ({USAGE_SQL}),
l AS (SELECT source_path, source_order, timestamp_ms AS ts, raw_input AS input, cache_read AS cached, output, reasoning, row_number() OVER (PARTITION BY source_path ORDER BY source_order) AS n FROM e),
t AS (SELECT *, input || ',' || cached || ',' || output || ',' || reasoning AS total, input = 0 AND cached = 0 AND output = 0 AND reasoning = 0 AS nothing FROM l),
s AS (
  SELECT source_path, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS met, false AS mixed, {", ".join(f"CAST(0 AS HUGEINT) AS {k}_{p}" for k in "phb" for p in _PARTS)} FROM (SELECT DISTINCT source_path FROM t)
  UNION ALL
  SELECT source_path, n, CASE WHEN idle THEN met ELSE list_append(met, total)[-64:] END, mixed OR (NOT idle AND ({" OR ".join(f"{p} < h_{p}" for p in _PARTS)})),
         {", ".join(f"p_{p} + bill_{p}" for p in _PARTS)}, {", ".join(f"CASE WHEN idle THEN h_{p} ELSE greatest(h_{p}, {p}) END" for p in _PARTS)}, {", ".join(f"bill_{p}" for p in _PARTS)}
  FROM (SELECT *, {", ".join(f"CASE WHEN idle THEN 0 ELSE greatest(0, {p} - greatest(p_{p}, CASE WHEN {p} >= h_{p} THEN h_{p} ELSE 0 END)) END AS bill_{p}" for p in _PARTS)}
        FROM (SELECT t.*, s.met, s.mixed, {", ".join(f"s.{k}_{p}" for k in "ph" for p in _PARTS)}, t.nothing OR list_contains(s.met, t.total) AS idle FROM s JOIN t ON t.source_path = s.source_path AND t.n = s.n + 1)))
SELECT s.source_path, t.source_order, t.ts, {", ".join(f"CAST(b_{p} AS BIGINT) AS {p}" for p in _PARTS)}, s.mixed FROM s JOIN t ON t.source_path = s.source_path AND t.n = s.n WHERE {" + ".join(f"b_{p}" for p in _PARTS)} > 0"""


@register(COUNTERS_SQL)
def counter_delta(spark, sf_dir):
    e = usage_events(spark, sf_dir).select("source_path", "source_order", F.col("timestamp_ms").alias("ts"), F.col("raw_input").alias("input"), F.col("cache_read").alias("cached"), "output", "reasoning")
    return counters.deltas(e)


@register(f"WITH e AS ({USAGE_SQL}), c AS (SELECT source_order, session_id, timestamp_ms FROM e WHERE source = 'claude'), p AS (SELECT session_id, timestamp_ms, raw_input, output FROM e WHERE source = 'codex') SELECT c.source_order, max(p.raw_input) AS raw_input, max(p.output) AS output FROM c JOIN p ON c.session_id = p.session_id AND p.timestamp_ms <= c.timestamp_ms GROUP BY c.source_order")
def asof_parent(spark, sf_dir):
    e = usage_events(spark, sf_dir)
    child = e.filter("source = 'claude'").select("source_order", F.col("session_id").alias("parent_id"), F.col("timestamp_ms").alias("fork_ts"))
    return counters.inherited(child, e.filter("source = 'codex'").withColumnRenamed("timestamp_ms", "ts"), ["raw_input", "output"])


# --- activity -------------------------------------------------------------------------------------------------------


@register(f"WITH e AS ({USAGE_SQL}) SELECT strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') AS date, source, CAST(sum(uncached_input + cache_read + cache_write + output) AS BIGINT) AS value FROM e GROUP BY 1, 2")
def activity_daily(spark, sf_dir):
    return activity.daily(usage_events(spark, sf_dir), "timestamp_ms", usage.total_tokens())


_SPAN = (BASE_MS, BASE_MS + 30 * 86_400_000)
_HIST = f"h AS (SELECT source, CAST(least(23, (timestamp_ms - {_SPAN[0]}) * 24 // {_SPAN[1] - _SPAN[0]}) AS INTEGER) AS bucket, count(*) AS value FROM e WHERE timestamp_ms BETWEEN {_SPAN[0]} AND {_SPAN[1]} GROUP BY 1, 2)"


@register(f"WITH e AS ({USAGE_SQL}), {_HIST} SELECT * FROM h")
def activity_histogram(spark, sf_dir):
    return activity.histogram(usage_events(spark, sf_dir), "timestamp_ms", *_SPAN, 24, ["source"])


@register(f"WITH e AS ({USAGE_SQL}), {_HIST}, b AS (SELECT bucket, CAST(sum(value) AS BIGINT) AS value FROM h GROUP BY bucket) SELECT bucket, value, CAST(ceil(value * 8.0 / (SELECT max(value) FROM b)) AS INTEGER) AS level FROM b")
def activity_density(spark, sf_dir):
    return activity.density(activity.histogram(usage_events(spark, sf_dir), "timestamp_ms", *_SPAN, 24), 8)


@register(f"""WITH e AS ({USAGE_SQL}), {_HIST}, r AS (SELECT *, sum(value) OVER (PARTITION BY bucket ORDER BY value DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(value) OVER (PARTITION BY bucket) AS al FROM h),
l AS (SELECT *, ceil(al * 8.0 / (SELECT max(al) FROM r)) AS lev FROM r) SELECT bucket, source, value, CAST(floor(run * lev / al) - floor((run - value) * lev / al) AS INTEGER) AS cells FROM l""")
def activity_stack(spark, sf_dir):
    return activity.stack(activity.histogram(usage_events(spark, sf_dir), "timestamp_ms", *_SPAN, 24, ["source"]), 8)


@register(f"WITH e AS ({USAGE_SQL}) SELECT project, CAST(sum(output) AS BIGINT) AS value FROM e GROUP BY project ORDER BY value DESC, project")
def group_totals(spark, sf_dir):
    return activity.totals(usage_events(spark, sf_dir), "project", "output")


# --- evaluation -----------------------------------------------------------------------------------------------------

_EVAL = """
res AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
q AS (SELECT d.source AS query_id, l.doc_id, max(CAST(l.quality + l.toxic AS DOUBLE)) AS relevance FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2),
top AS (SELECT r.query_id, r.doc_id, r.rank, coalesce(q.relevance, 0) AS relevance FROM res r LEFT JOIN q ON r.query_id = q.query_id AND r.doc_id = q.doc_id WHERE r.rank <= 20),
per AS (SELECT query_id, count(*) FILTER (WHERE relevance > 0) AS found, min(rank) FILTER (WHERE relevance > 0) AS first_rank, sum((pow(2, relevance) - 1) / log2(rank + 1)) AS dcg FROM top GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS positives, sum(CASE WHEN rank <= 20 THEN (pow(2, relevance) - 1) / log2(rank + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS rank FROM q WHERE relevance > 0) GROUP BY query_id),
m AS (SELECT i.query_id, coalesce(found, 0) / positives AS recall, coalesce(1.0 / first_rank, 0) AS reciprocal_rank, coalesce(dcg, 0) / idcg AS ndcg FROM ideal i LEFT JOIN per p ON i.query_id = p.query_id)"""


def _measures(spark, sf_dir):
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query_id"), "n_chars")
    results = docs.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    qrels = table(spark, sf_dir, "labels").join(docs, "doc_id").select("query_id", "doc_id", (F.col("quality") + F.col("toxic")).cast("double").alias("relevance"))
    return evaluate.measures(results, qrels, ["doc_id"], 20)


@register(f"WITH {_EVAL} SELECT query_id, round(recall, 9) AS recall, round(reciprocal_rank, 9) AS reciprocal_rank, round(ndcg, 9) AS ndcg FROM m")
def eval_measures(spark, sf_dir):
    return _measures(spark, sf_dir).select("query_id", *(F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@register(f"WITH {_EVAL} SELECT count(*) AS queries, round(avg(recall), 9) AS recall, round(avg(reciprocal_rank), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM m")
def eval_means(spark, sf_dir):
    return evaluate.means(_measures(spark, sf_dir)).select("queries", *(F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")))


@register(f"WITH r AS ({RECORDS_SQL}), x AS (SELECT project AS query_id, source, session_id, source_path, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS rank FROM r) SELECT query_id, count(DISTINCT (source, session_id, source_path)) AS sessions FROM x WHERE rank <= 30 GROUP BY query_id")
def unique_sessions(spark, sf_dir):
    from pyspark.sql import Window

    r = records(spark, sf_dir).withColumn("query_id", F.col("project"))
    return evaluate.unique_sessions(r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))), 30)


# --- scalar functions -----------------------------------------------------------------------------------------------


@register("SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE left(c, 77) || '...' END AS summary, CASE WHEN length(c) <= 60 THEN c ELSE left(c, 59) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.summarize(F.col("text"), 80).alias("summary"), text.snippet(F.col("text"), 60).alias("snippet"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN (epoch_us(ts) // 1000) // 1000 % 2 = 0 THEN (epoch_us(ts) // 1000) // 1000 * 1000 ELSE (epoch_us(ts) // 1000) END AS parsed_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS shown FROM events")
def json_and_times(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").withColumn("written", F.when(F.expr("unix_millis(cast(ts as timestamp)) div 1000 % 2 = 0"), F.expr("unix_millis(cast(ts as timestamp)) div 1000").cast("string")).otherwise(ms.cast("string")))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), times.parse_user_ts(F.col("written")).alias("parsed_ms"), times.format_ts(ms).alias("shown"))


@register("SELECT event_type || '.jsonl' AS source_path, count(*) AS lines, count(*) FILTER (WHERE props IS NULL) AS malformed, to_json(map([event_type], [count(*) FILTER (WHERE props IS NOT NULL)])) AS types, count(DISTINCT json_extract_string(props, '$.k')) AS versions FROM events GROUP BY event_type")
def structure_audit(spark, sf_dir):
    from ..sources import lines

    kind = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", '))
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(".jsonl")).alias("source_path"), F.concat(kind, F.substring("props", 2, 1 << 30)).alias("value"))
    found = lines.audit(e, version="$.k")
    return found.select("source_path", "lines", "malformed", F.to_json("types").alias("types"), F.size("versions").cast("long").alias("versions"))


@register(f"WITH e AS ({USAGE_SQL}) SELECT DISTINCT source_path, 'u' AS owner FROM e WHERE NOT regexp_matches(source_path, '^/u/1.*\\.jsonl$')")
def excluded_paths(spark, sf_dir):
    from ..sources import lines

    e = usage_events(spark, sf_dir).select("source_path").distinct()
    return e.filter(~lines.excluded(F.col("source_path"), ["/u/1*.jsonl"])).withColumn("owner", F.lit("u"))


@register("SELECT DISTINCT c_mktsegment, lower(trim(c_mktsegment)) AS key FROM customer")
def project_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", projects.project_key(F.col("c_mktsegment")).alias("key")).distinct()


# --- dialects and stored tables -------------------------------------------------------------------------------------------------------

for _query, _text in (dialects.REGISTERED | stored.REGISTERED).items():
    register(_text)(_query)
