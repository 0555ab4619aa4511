"""Registered retrieval queries (R-01..R-14) with DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.operators import retrieve as R
from emberwatch.operators.serve import mttr_col
from emberwatch.plans.catalog import register
from emberwatch.sources import adapters as A

WINDOW_S = 48 * 3600   # deployment search window (reference: 120 min)
BUDGET = 40            # token budget for the test corpus (reference: 4096); contents are ~5 tokens each
HIT_COLS = "query_id, chunk_id, doc_id, collection, score, rank"


def _dot(a: str, b: str) -> str:
    return (f"list_reduce(list_transform(generate_series(1, len({a})), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE), "
            "lambda x, y: x + y)")


_SCORE = f"({_dot('q.query_vec', 'c.embedding')} / (sqrt({_dot('q.query_vec', 'q.query_vec')}) * " \
         f"sqrt({_dot('c.embedding', 'c.embedding')})))"


def knn_sql(k: int, where: str = "TRUE", extra_cols: str = "") -> str:
    return f"""SELECT * FROM (
        SELECT q.query_id, q.q_service, q.q_type, q.affected_services, c.chunk_id, c.doc_id, c.collection,
               c.service_name, c.anomaly_type, c.content, {_SCORE} AS score {extra_cols}
        FROM vector_queries q, vectors c WHERE {where})
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ASC) <= {k}"""


def ranked(sql: str, part: str = "query_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY score DESC, chunk_id ASC)::BIGINT AS rank "
            f"FROM ({sql})")


def per_service_sql(k: int, where: str = "TRUE", window: bool = False) -> str:
    tw = f"AND c.epoch >= q.query_epoch - {WINDOW_S} AND c.epoch <= q.query_epoch" if window else ""
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id, svc ORDER BY score DESC, chunk_id ASC)::BIGINT AS rank
        FROM (SELECT q.query_id, q.svc, c.chunk_id, c.doc_id, c.collection, c.service_name, c.anomaly_type, c.content,
                     {_SCORE} AS score
              FROM (SELECT *, unnest(affected_services) AS svc FROM vector_queries) q
              JOIN vectors c ON c.service_name = q.svc {tw} WHERE {where})
        QUALIFY rank <= {k}"""


def best_per_doc_sql(hits: str, k: int = 5) -> str:
    first = f"SELECT * FROM ({hits}) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) = 1"
    return (f"SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
            f"rank ASC)::BIGINT AS rank FROM ({first})) WHERE rank <= {k}")


def boost_sql(hits: str, k: int = 5) -> str:
    s1 = (f"CASE WHEN list_has_any(affected_services, [service_name]) THEN least(1.0::DOUBLE, score + {K.SERVICE_BOOST}::DOUBLE) "
          "ELSE score END")
    s2 = f"CASE WHEN list_contains([anomaly_type], q_type) THEN least(1.0::DOUBLE, s1 + {K.TYPE_BOOST}::DOUBLE) ELSE s1 END"
    return f"""SELECT * FROM (SELECT * EXCLUDE (rank, score, s1, s2), s2 AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, rank ASC)::BIGINT AS rank
        FROM (SELECT *, {s2} AS s2 FROM (SELECT *, {s1} AS s1 FROM ({hits})))) WHERE rank <= {k}"""


_INC_FILTER = "c.collection = 'incidents' AND c.environment = 'production' AND c.resolved"


def gather_sql() -> str:
    inc = best_per_doc_sql(ranked(knn_sql(20, _INC_FILTER)))
    rb = boost_sql(ranked(knn_sql(10, "c.collection = 'runbooks'")))
    arch = per_service_sql(3, "c.collection = 'architecture'")
    dep = per_service_sql(5, "c.collection = 'deployments'", window=True)
    pm = ranked(knn_sql(5, "c.collection = 'postmortems'"))
    cols = "query_id, collection, chunk_id, doc_id, score, rank, content"
    return " UNION ALL ".join(f"SELECT {cols} FROM ({b})" for b in (inc, rb, arch, dep, pm))


def _q(spark, sf):
    return A.vector_queries(spark, sf)


def _c(spark, sf):
    return A.vectors(spark, sf)


_V = ("vectors", "vector_queries")


@register("r02_knn", A.with_adapters(f"SELECT {HIT_COLS} FROM ({ranked(knn_sql(5))})", *_V), doubles=("score",),
          bench=True)
def q_knn(spark, sf):
    return R.knn(_q(spark, sf), _c(spark, sf), k=5).select(*HIT_COLS.split(", "))


@register("r03_knn_filtered", A.with_adapters(
    f"SELECT {HIT_COLS} FROM ({ranked(knn_sql(5, _INC_FILTER))})", *_V), doubles=("score",))
def q_knn_filtered(spark, sf):
    c = _c(spark, sf).where(F.col("collection") == "incidents")
    return R.knn_filtered(_q(spark, sf), c, k=5, equal={"environment": "production", "resolved": True})\
            .select(*HIT_COLS.split(", "))


@register("r04_knn_in_time", A.with_adapters(
    f"SELECT query_id, svc, chunk_id, doc_id, collection, score, rank FROM ({per_service_sql(5, 'TRUE', True)})", *_V),
    doubles=("score",))
def q_knn_time(spark, sf):
    return R.knn_per_service(_q(spark, sf), _c(spark, sf), k=5, window_s=("query_epoch", "epoch", WINDOW_S))\
            .select("query_id", "svc", "chunk_id", "doc_id", "collection", "score", "rank")


@register("r05_best_per_doc", A.with_adapters(
    f"SELECT {HIT_COLS} FROM ({best_per_doc_sql(ranked(knn_sql(20, _INC_FILTER)))})", *_V), doubles=("score",))
def q_best_per_doc(spark, sf):
    c = _c(spark, sf).where(F.col("collection") == "incidents")
    hits = R.knn_filtered(_q(spark, sf), c, k=20, equal={"environment": "production", "resolved": True})
    return R.best_per_doc(hits, k=5).select(*HIT_COLS.split(", "))


@register("r06_boost", A.with_adapters(
    f"SELECT {HIT_COLS} FROM ({boost_sql(ranked(knn_sql(10, chr(99) + '.collection = ' + repr('runbooks'))))})", *_V),
    doubles=("score",))
def q_boost(spark, sf):
    c = (_c(spark, sf).where(F.col("collection") == "runbooks").withColumn("services", F.array("service_name"))
         .withColumn("anomaly_types", F.array("anomaly_type")))
    return R.boost(R.knn(_q(spark, sf), c, k=10), k=5).select(*HIT_COLS.split(", "))


@register("r07_knn_per_service", A.with_adapters(
    f"SELECT query_id, svc, chunk_id, doc_id, collection, score, rank FROM "
    f"({per_service_sql(3, chr(99) + '.collection = ' + repr('architecture'))})", *_V), doubles=("score",))
def q_per_service(spark, sf):
    c = _c(spark, sf).where(F.col("collection") == "architecture")
    return R.knn_per_service(_q(spark, sf), c, k=3).select("query_id", "svc", "chunk_id", "doc_id", "collection",
                                                           "score", "rank")


@register("r08_deployment_hits", A.with_adapters(
    f"SELECT query_id, svc, chunk_id, doc_id, collection, score, rank FROM "
    f"({per_service_sql(5, chr(99) + '.collection = ' + repr('deployments'), True)})", *_V), doubles=("score",))
def q_deploy_hits(spark, sf):
    c = _c(spark, sf).where(F.col("collection") == "deployments")
    return R.knn_per_service(_q(spark, sf), c, k=5, window_s=("query_epoch", "epoch", WINDOW_S))\
            .select("query_id", "svc", "chunk_id", "doc_id", "collection", "score", "rank")


@register("r09_postmortem_hits", A.with_adapters(
    f"SELECT {HIT_COLS} FROM ({ranked(knn_sql(5, chr(99) + '.collection = ' + repr('postmortems')))})", *_V),
    doubles=("score",))
def q_pm_hits(spark, sf):
    c = _c(spark, sf).where(F.col("collection") == "postmortems")
    return R.knn(_q(spark, sf), c, k=5).select(*HIT_COLS.split(", "))


@register("r10_tokens", A.with_adapters("SELECT chunk_id, length(content) // 4 AS tokens FROM vectors", "vectors"))
def q_tokens(spark, sf):
    from emberwatch.functions.columns import tokens
    return _c(spark, sf).select("chunk_id", tokens("content").alias("tokens"))


def budget_sql(hits: str, max_tokens: int) -> str:
    order = "[" + ", ".join(f"'{t}'" for t in K.BUDGET_ORDER) + "]"
    step = (f"lambda acc, it: CASE WHEN acc.stopped = it.tr THEN acc "
            f"WHEN acc.total + it.tokens <= {max_tokens} THEN {{'total': acc.total + it.tokens, 'stopped': acc.stopped, "
            f"'kept': list_append(acc.kept, it.chunk_id)}} "
            f"ELSE {{'total': acc.total, 'stopped': it.tr, 'kept': acc.kept}} END")
    init = "{'total': 0::BIGINT, 'stopped': -1::BIGINT, 'kept': []::BIGINT[]}"
    items = (f"SELECT query_id, list_reduce(list({{'tr': list_position({order}, collection)::BIGINT, 'rank': rank, "
             f"'chunk_id': chunk_id, 'tokens': (length(content) // 4)::BIGINT}} ORDER BY "
             f"list_position({order}, collection), rank, chunk_id), {step}, {init}).kept AS kept FROM ({hits}) GROUP BY 1")
    kept = ("SELECT query_id, unnest(kept) AS chunk_id, unnest(generate_series(0, len(kept) - 1))::BIGINT AS budget_pos "
            f"FROM ({items})")
    return (f"SELECT h.query_id, h.collection, h.chunk_id, h.score, h.rank, length(h.content) // 4 AS tokens, k.budget_pos "
            f"FROM ({hits}) h JOIN ({kept}) k ON k.query_id = h.query_id AND k.chunk_id = h.chunk_id")


def _gather(spark, sf):
    return R.gather(_q(spark, sf), _c(spark, sf), deploy_window_s=WINDOW_S)


@register("r11_budget", A.with_adapters(budget_sql(gather_sql(), BUDGET), *_V), doubles=("score",))
def q_budget(spark, sf):
    b = R.budget(_gather(spark, sf), max_tokens=BUDGET)
    return b.select("query_id", "collection", "chunk_id", "score", "rank", "tokens", "budget_pos")


@register("r13_gather", A.with_adapters(f"SELECT * FROM ({gather_sql()})", *_V), doubles=("score",), bench=True)
def q_gather(spark, sf):
    return _gather(spark, sf)


def _records(spark, sf, text_ids: bool = False) -> dict:
    """The source records behind the hits, with their real columns."""
    from emberwatch.operators.knowledge import meta_list
    from emberwatch.operators import knowledge as KN

    inc = A.incidents(spark, sf)
    pm = A.postmortems(spark, sf)
    first = F.element_at("affected_services", 1)
    resolved = pm.select(F.col("incident_id").alias("pid"), "executive_summary")
    incidents = inc.join(resolved, inc.id == resolved.pid, "left").select(
        "id", first.alias("service_name"), "severity", "anomaly_type", F.col("description").alias("symptoms"),
        F.col("top_root_cause").alias("root_cause"), F.col("executive_summary").alias("resolution"), mttr_col().alias("mttr_minutes"))
    modes = inc.groupBy(first.alias("service_name")).agg(
        F.sort_array(F.collect_set("anomaly_type")).alias("known_failure_modes"),  # a service's anomaly types: six
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" incidents on record")).alias("description"))
    meta = KN.front_matter(A.markdown_docs(spark, sf))
    runbooks = meta.select(F.regexp_extract("stem", r"([0-9]+)$", 1).cast("long").alias("doc_id"), F.col("meta")["title"].alias("title"),
                           meta_list("meta", "anomaly_types").alias("anomaly_types"), meta_list("meta", "services").alias("services"))
    deployments = A.deployments(spark, sf).withColumn(
        "deployed_at", F.date_format(F.timestamp_millis("deployed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    sections = KN.named_sections(pm.select("incident_id", "full_markdown"), key="incident_id", body="full_markdown")
    about = inc.select(F.col("id").alias("incident_id"), first.alias("service"))
    postmortems = (pm.select("incident_id", F.col("root_cause").alias("root_cause_category"))
                   .join(about, "incident_id").join(sections, "incident_id"))
    if text_ids:  # as the seeded store names its documents
        text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
        incidents, deployments, postmortems = text(incidents, "id"), text(deployments, "id"), text(postmortems, "incident_id")
        runbooks = meta.select(F.col("stem").alias("doc_id"), F.col("meta")["title"].alias("title"),
                               meta_list("meta", "anomaly_types").alias("anomaly_types"), meta_list("meta", "services").alias("services"))
    return {"incidents": incidents, "registry": A.registry(spark).join(modes, "service_name", "left"), "runbooks": runbooks,
            "deployments": deployments, "postmortems": postmortems}


def _py_list(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda s: '\'\'' || s || '\'\''), ', ') || ']'".replace("\\'", "'")


_META = "JOIN vectors v ON v.chunk_id = g.chunk_id"


def _evidence_sql(hits: str) -> str:
    """The evidence of every hit, written out from the tables (postmortem sections follow from the adapter's markdown)."""
    nl = "chr(10)"
    return f"""SELECT g.query_id, g.collection, g.chunk_id, g.rank, CASE g.collection
      WHEN 'incidents' THEN concat('Incident: ', i.id, {nl}, 'Service: ', i.affected_services[1], ' | Severity: ', i.severity,
           ' | Type: ', i.anomaly_type, {nl}, 'Symptoms: ', i.description, {nl}, 'Root Cause: ', i.top_root_cause, {nl},
           'Resolution: ', p.executive_summary, {nl}, 'MTTR: ', coalesce((CASE WHEN i.resolution_time IS NOT NULL THEN
             (round((i.resolution_time - i.detection_time) / 1000.0)::BIGINT // 60) END)::VARCHAR, '?'), ' minutes')
      WHEN 'runbooks' THEN concat('Runbook: ', CASE WHEN m.doc_id IS NOT NULL THEN 'doc ' || m.doc_id END, {nl}, 'For: ',
           CASE WHEN m.doc_id IS NULL THEN '[]' ELSE {_py_list('[' + A._TYPES6_SQL + '[(m.doc_id % 6) + 1]]')} END, ' on ',
           CASE WHEN m.doc_id IS NULL THEN '[]' ELSE {_py_list('[' + A._svc_sql('m.doc_id') + ']')} END, {nl}, {nl}, g.content)
      WHEN 'architecture' THEN concat('Service: ', v.service_name, {nl}, 'Team: ', r.team_owner, ' | Criticality: ', r.criticality,
           {nl}, 'SLA: P99 < ', coalesce(r.sla_p99_latency_ms::VARCHAR, '?'), 'ms, error rate < ',
           coalesce(r.sla_error_rate_pct::VARCHAR, '?'), '%', {nl}, 'On-call: ', r.on_call_rotation, {nl}, 'Downstream: ',
           {_py_list('coalesce(r.downstream_services, []::VARCHAR[])')}, {nl}, 'Description: ',
           CASE WHEN f.n IS NOT NULL THEN f.n::VARCHAR || ' incidents on record' END, {nl}, 'Known failure modes: ',
           {_py_list('coalesce(f.modes, []::VARCHAR[])')})
      WHEN 'deployments' THEN concat('Deployment: ', d.service_name, ' ', d.version, {nl}, 'Deployed at: ',
           strftime(make_timestamp(d.deployed_at * 1000), '%Y-%m-%dT%H:%M:%SZ'), ' by ', d.deployed_by, {nl}, 'Change type: ',
           d.change_type, {nl}, 'Description: ', d.description, {nl}, 'Known risks:', {nl},
           CASE WHEN len(d.known_risks) > 0 THEN array_to_string(list_transform(d.known_risks, lambda s: '  - ' || s), {nl})
                ELSE '  None flagged' END)
      ELSE concat('Postmortem: ', p.incident_id, {nl}, 'Service: ', CASE WHEN p.incident_id IS NOT NULL THEN i.affected_services[1] END,
           ' | Category: ', p.root_cause, {nl}, 'Contributing factors:', {nl},
           CASE WHEN p.incident_id IS NOT NULL THEN {nl} || '- factor ' || (p.incident_id % 7)::VARCHAR || {nl} END, {nl},
           'Preventative actions:', {nl},
           CASE WHEN p.incident_id IS NOT NULL THEN {nl} || {nl} || '- add alert ' || (p.incident_id % 5)::VARCHAR || {nl} || {nl} END)
      END AS evidence
    FROM ({hits}) g {_META} LEFT JOIN incidents i ON i.id = g.doc_id LEFT JOIN postmortems p ON p.incident_id = g.doc_id
    LEFT JOIN registry r ON r.service_name = v.service_name LEFT JOIN deployments d ON d.id = g.doc_id
    LEFT JOIN documents m ON m.doc_id = g.doc_id
    LEFT JOIN (SELECT affected_services[1] AS s, count(*) AS n, list_sort(list(DISTINCT anomaly_type)) AS modes
      FROM incidents GROUP BY 1) f ON f.s = v.service_name"""


_R12 = ("vectors", "vector_queries", "incidents", "postmortems", "registry", "deployments")


def _evidence(spark, sf):
    meta = _c(spark, sf).select("chunk_id", "service_name")
    return R.render(_gather(spark, sf).join(meta, "chunk_id"), **_records(spark, sf))


@register("r12_render", A.with_adapters(f"SELECT query_id, collection, chunk_id, evidence FROM ({_evidence_sql(gather_sql())})", *_R12))
def q_render(spark, sf):
    return _evidence(spark, sf).select("query_id", "collection", "chunk_id", "evidence")


RENDERED_BUDGET = 120  # tokens for one search's rendered evidence (reference: 4096; a text here has about 50)


@register("r11_budget_rendered", A.with_adapters(f"""
    SELECT query_id, collection, chunk_id, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id, collection
        ORDER BY rank, chunk_id) AS upto FROM (SELECT *, (length(evidence) // 4)::BIGINT AS tokens
            FROM ({_evidence_sql(gather_sql())}))) WHERE upto <= {RENDERED_BUDGET}""", *_R12))
def q_budget_rendered(spark, sf):
    """One request is one search: evidence is rendered first, then cut to the budget per (incident, type)."""
    b = R.budget(_evidence(spark, sf), max_tokens=RENDERED_BUDGET, group=["query_id", "collection"], text="evidence")
    return b.select("query_id", "collection", "chunk_id", "tokens")


def _unit_vectors(rows):
    assert rows and all(abs(r.norm - 1) < 1e-3 or r.norm == 0 for r in rows), "vectors of other than unit length"


@register("r01_embed", check=_unit_vectors)
def q_embed(spark, sf):
    from emberwatch.operators.knowledge import runbook_chunks
    chunks = runbook_chunks(A.markdown_docs(spark, sf)).select("point_id", "chunk")  # whole; `content` is the cut payload
    model = R.embed_fit(chunks, text="chunk")
    e = R.embed(chunks, model)
    return e.select("point_id", F.size("embedding").cast("long").alias("dims"),
                    F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


def _five_each(rows):
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r["rank"])
    assert by and all(sorted(v) == [1, 2, 3, 4, 5] for v in by.values()), "a query with other than five ranked hits"


def _recall(rows):
    assert rows and sum(r.recall_at_5 for r in rows) / len(rows) >= 0.95, "recall below 0.95"


@register("r14_knn_approx", check=_five_each)
def q_knn_approx(spark, sf):
    return R.knn_approx(_q(spark, sf), _c(spark, sf), k=5).select("query_id", "chunk_id", "score", "rank")


@register("r14_recall", check=_recall)
def q_recall(spark, sf):
    """R-14 quality: per query, the share of the exact top-5 (R-02) that the LSH top-5 also returns."""
    exact = R.knn(_q(spark, sf), _c(spark, sf), k=5).select("query_id", "chunk_id")
    approx = R.knn_approx(_q(spark, sf), _c(spark, sf), k=5).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    j = exact.join(approx, ["query_id", "chunk_id"], "left")
    return j.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall_at_5"))
