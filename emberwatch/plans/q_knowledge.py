"""Registered knowledge-preparation queries (K-01..K-11) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.operators import knowledge as KN
from emberwatch.operators.serve import mttr_col
from emberwatch.plans.catalog import register
from emberwatch.sources import adapters as A

_SENT = "chr(1114109)"  # U+10FFFD, a private-use sentinel for the section split


def strip_sql(x: str) -> str:
    return f"trim({x}, {KN.WS_SQL})"


_FM_SQL = f"""SELECT stem, text, closed,
        CASE WHEN closed THEN substr(text, 4, p - 1) END AS fm,
        CASE WHEN closed THEN {strip_sql('substr(text, p + 6)')} ELSE text END AS body
    FROM (SELECT stem, text, starts_with(text, '---') AND strpos(substr(text, 4), '---') > 0 AS closed,
                 strpos(substr(text, 4), '---') AS p FROM markdown_docs)"""

_ENTRIES_SQL = f"""SELECT *, list_transform(
        list_filter(regexp_split_to_array(fm, '{KN.LINES_RE}'), lambda l: contains(l, ':')),
        lambda l: {{'key': {strip_sql("split_part(l, ':', 1)")},
                   'value': trim({strip_sql("substr(l, strpos(l, ':') + 1)")}, '"')}})
        AS entries FROM ({_FM_SQL})"""


def _meta(key: str) -> str:
    return f"list_filter(entries, lambda e: e.key = '{key}')[-1].value"


def _meta_list(key: str) -> str:
    raw = _meta(key)
    return (f"CASE WHEN starts_with({raw}, '[') AND json_valid({raw}) THEN from_json({raw}, '[\"VARCHAR\"]') "
            "ELSE []::VARCHAR[] END")


@register("k01_front_matter", A.with_adapters(f"""
    SELECT stem, {_meta('title')} AS title, {_meta_list('services')} AS services,
           {_meta_list('anomaly_types')} AS anomaly_types, {_meta('lang')} AS lang, {_meta('source')} AS source,
           CASE WHEN closed THEN len(list_distinct(list_transform(entries, lambda e: e.key))) ELSE 0 END::BIGINT
               AS n_meta, body
    FROM ({_ENTRIES_SQL})""", "markdown_docs"))
def q_front_matter(spark, sf):
    fm = KN.front_matter(A.markdown_docs(spark, sf))
    return fm.select("stem", F.col("meta")["title"].alias("title"), KN.meta_list("meta", "services").alias("services"),
                     KN.meta_list("meta", "anomaly_types").alias("anomaly_types"), F.col("meta")["lang"].alias("lang"),
                     F.col("meta")["source"].alias("source"), F.size(F.map_keys("meta")).cast("long").alias("n_meta"),
                     "body")


_SECS_SQL = f"""SELECT stem, body, row_number() OVER (PARTITION BY stem ORDER BY i)::BIGINT AS sec_no, section FROM (
        SELECT stem, body, unnest(generate_series(1, len(parts))) AS i, {strip_sql('unnest(parts)')} AS section
        FROM (SELECT stem, body, string_split(regexp_replace(body, '(?m)^(#{{2,3}} )', {_SENT} || '\\1', 'g'),
                                                {_SENT}) AS parts FROM ({_FM_SQL})))
    WHERE section <> ''"""


@register("k02_sections", A.with_adapters(f"SELECT stem, sec_no, section FROM ({_SECS_SQL})", "markdown_docs"))
def q_sections(spark, sf):
    fm = KN.front_matter(A.markdown_docs(spark, sf)).select("stem", "body")
    s = KN.sections(fm)
    from pyspark.sql import Window
    w = Window.partitionBy("stem").orderBy("section_idx")
    return s.select("stem", F.row_number().over(w).cast("long").alias("sec_no"), "section")


def _pack_sql(max_tokens: int = 400) -> str:
    lim = 4 * max_tokens
    nl2 = "chr(10) || chr(10)"
    step = (f"lambda acc, p: CASE WHEN length(acc.cur) + length(p) <= {lim} "
            f"THEN {{'chunks': acc.chunks, 'cur': {strip_sql(f'acc.cur || {nl2} || p')}}} "
            f"ELSE {{'chunks': CASE WHEN acc.cur <> '' THEN list_append(acc.chunks, acc.cur) ELSE acc.chunks END, "
            f"'cur': p}} END")
    red = f"list_reduce(string_split(section, {nl2}), {step}, {{'chunks': []::VARCHAR[], 'cur': ''}})"
    per_sec = f"""SELECT stem, body, sec_no, CASE WHEN length(section) <= {lim} THEN [section]
                  ELSE (CASE WHEN r.cur <> '' THEN list_append(r.chunks, r.cur) ELSE r.chunks END) END AS pieces
           FROM (SELECT *, {red} AS r FROM ({_SECS_SQL}))"""
    chunks = f"""SELECT stem, (row_number() OVER (PARTITION BY stem ORDER BY sec_no, sub) - 1)::BIGINT AS chunk_index,
                        chunk FROM (SELECT stem, sec_no, unnest(generate_series(1, len(pieces))) AS sub,
                                           unnest(pieces) AS chunk FROM ({per_sec}))"""
    return f"""SELECT * FROM ({chunks})
        UNION ALL
        SELECT stem, 0::BIGINT AS chunk_index, substr(body, 1, 1600) AS chunk FROM ({_FM_SQL})
        WHERE stem NOT IN (SELECT stem FROM ({chunks}))"""


def _packed(spark, sf):
    fm = KN.front_matter(A.markdown_docs(spark, sf)).select("stem", "body")
    return KN.pack(fm)


@register("k03_pack", A.with_adapters(_pack_sql(), "markdown_docs"))
def q_pack(spark, sf):
    return _packed(spark, sf)


_NONBLANK = f"{strip_sql('chunk')} <> ''"


@register("k04_doc_hash", A.with_adapters(
    f"SELECT stem, chunk_index, substr(sha256(stem || ':chunk' || chunk_index::VARCHAR), 1, 16) AS doc_hash "
    f"FROM ({_pack_sql()}) WHERE {_NONBLANK}", "markdown_docs"))
def q_doc_hash(spark, sf):
    return KN.runbook_chunks(A.markdown_docs(spark, sf)).select("stem", "chunk_index", "doc_hash")


def uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('{K.NAMESPACE_DNS_HEX}') || encode({name}))"
    var = f"substr('0123456789abcdef', (((strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) & 3) | 8) + 1, 1)"
    return (f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {var} "
            f"|| substr({h}, 18, 3) || '-' || substr({h}, 21, 12))")


@register("k05_point_id", A.with_adapters(
    f"SELECT stem, chunk_index, {uuid5_sql('doc_hash')} AS point_id FROM ("
    f"SELECT stem, chunk_index, substr(sha256(stem || ':chunk' || chunk_index::VARCHAR), 1, 16) AS doc_hash "
    f"FROM ({_pack_sql()}) WHERE {_NONBLANK})", "markdown_docs"))
def q_point_id(spark, sf):
    return KN.runbook_chunks(A.markdown_docs(spark, sf)).select("stem", "chunk_index", "point_id")


_INC_SRC_SQL = """SELECT i.id AS incident_id, i.anomaly_type, i.affected_services[1] AS service_name, i.severity,
        i.description AS symptoms_observed, i.top_root_cause AS root_cause, p.executive_summary AS resolution_steps
    FROM incidents i LEFT JOIN postmortems p ON p.incident_id = i.id"""


def _inc_src(spark, sf):
    inc = A.incidents(spark, sf)
    pm = A.postmortems(spark, sf).select(F.col("incident_id").alias("pid"), "executive_summary")
    j = inc.join(pm, inc.id == pm.pid, "left")
    return j.select(F.col("id").alias("incident_id"), "anomaly_type",
                    F.element_at("affected_services", 1).alias("service_name"), "severity",
                    F.col("description").alias("symptoms_observed"), F.col("top_root_cause").alias("root_cause"),
                    F.col("executive_summary").alias("resolution_steps"), (F.col("status") == "RESOLVED").alias("resolved"),
                    mttr_col().alias("mttr_minutes"))


@register("k06_incident_chunks", A.with_adapters(f"""
    SELECT incident_id, chunk_type, substr(text, 1, 800) AS content,
           substr(sha256(incident_id::VARCHAR || ':' || chunk_type), 1, 16) AS doc_hash
    FROM (SELECT incident_id, unnest(['summary', 'symptoms', 'root_cause', 'resolution']) AS chunk_type,
                 unnest([concat_ws(' ', incident_id::VARCHAR, coalesce(anomaly_type, ''), coalesce(service_name, ''),
                                   coalesce(severity, ''), coalesce(symptoms_observed, '')),
                         coalesce(symptoms_observed, ''), coalesce(root_cause, ''),
                         coalesce(resolution_steps, '')]) AS text
          FROM ({_INC_SRC_SQL}))
    WHERE {strip_sql('text')} <> ''""", "incidents", "postmortems"))
def q_incident_chunks(spark, sf):
    return KN.incident_chunks(_inc_src(spark, sf)).select("incident_id", "chunk_type", "content", "doc_hash")


_LINES_SQL = f"""SELECT incident_id, unnest(generate_series(1, len(parts))) AS ln, unnest(parts) AS line FROM (
        SELECT incident_id, CASE WHEN regexp_matches(full_markdown, '(?:{KN.LINES_RE})\\z')
                                 THEN parts[1:len(parts) - 1] ELSE parts END AS parts
        FROM (SELECT incident_id, full_markdown, regexp_split_to_array(full_markdown, '{KN.LINES_RE}') AS parts
              FROM postmortems))"""


@register("k07_named_sections", A.with_adapters(f"""
    SELECT p.incident_id, coalesce(s.contributing_factors, '') AS contributing_factors,
           coalesce(s.preventative_actions, '') AS preventative_actions
    FROM postmortems p LEFT JOIN (
        SELECT incident_id,
               coalesce(string_agg(line || chr(10), '' ORDER BY ln) FILTER (WHERE state = 'contributing_factors'), '')
                   AS contributing_factors,
               coalesce(string_agg(line || chr(10), '' ORDER BY ln) FILTER (WHERE state = 'preventative_actions'), '')
                   AS preventative_actions
        FROM (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY ln
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state
              FROM (SELECT *, CASE WHEN contains(line, 'Contributing Factor') THEN 'contributing_factors'
                                   WHEN contains(line, 'Preventative') OR contains(line, 'Action')
                                       THEN 'preventative_actions'
                                   WHEN starts_with(line, '## ') THEN 'none' END AS marker
                    FROM ({_LINES_SQL})))
        WHERE marker IS NULL AND state IN ('contributing_factors', 'preventative_actions')
        GROUP BY incident_id) s ON s.incident_id = p.incident_id""", "postmortems"))
def q_named_sections(spark, sf):
    pm = A.postmortems(spark, sf).select("incident_id", "full_markdown")
    return KN.named_sections(pm, key="incident_id", body="full_markdown")


@register("k08_embedding_text", A.with_adapters("""
    SELECT id, substr(concat_ws(' ', service_name, version, change_type, description,
        'risks:[' || array_to_string(list_transform(known_risks, lambda s: '''' || s || ''''), ', ') || ']'), 1, 800)
        AS content FROM deployments""", "deployments"))
def q_embedding_text(spark, sf):
    return KN.deployment_text(A.deployments(spark, sf)).select("id", "content")


@register("k09_upsert_chunks", A.with_adapters(
    f"SELECT {uuid5_sql('doc_hash')} AS point_id, 'runbooks' AS collection, doc_hash, stem, substr(chunk, 1, 800) AS content FROM ("
    f"SELECT stem, chunk, substr(sha256(stem || ':chunk' || chunk_index::VARCHAR), 1, 16) AS doc_hash "
    f"FROM ({_pack_sql()}) WHERE {_NONBLANK})", "markdown_docs"))
def q_upsert_chunks(spark, sf):
    """A store seeded from an older, longer text of every other document, then re-seeded twice with today's."""
    docs = A.markdown_docs(spark, sf)
    columns = ["point_id", "collection", "doc_hash", "stem", "content"]
    older = docs.where(F.crc32("stem") % 2 == 0).withColumn(
        "text", F.concat("text", F.repeat(F.lit("\n\n## Old section\n\nwords that are gone by now"), 80)))
    chunks = KN.runbook_chunks(docs).select(*columns)
    store = KN.upsert_chunks(spark.createDataFrame([], chunks.schema), KN.runbook_chunks(older).select(*columns))
    return KN.upsert_chunks(KN.upsert_chunks(store, chunks), chunks)



@register("k10_iso_epoch", A.with_adapters("""
    SELECT event_id, coalesce(epoch(try_cast(replace(iso, 'Z', '+00:00') AS TIMESTAMPTZ)), 0.0) AS epoch_s
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not-a-date' WHEN event_type = 'signup' THEN NULL
                                ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS iso FROM events)""", ),
          doubles=("epoch_s",))
def q_iso_epoch(spark, sf):
    from emberwatch.functions.columns import iso_epoch
    from emberwatch.sources.tables import table
    ev = table(spark, sf, "events")
    iso = (F.when(F.col("event_type") == "error", F.lit("not-a-date"))
            .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
            .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))))
    return ev.select("event_id", iso_epoch(iso).alias("epoch_s"))


_REPR = "'[' || array_to_string(list_transform({x}, lambda s: chr(39) || s || chr(39)), ', ') || ']'"
_ARCH_SQL = f"""SELECT service_name AS doc, substr(service_name || '  team:' || team_owner || ' criticality:' || criticality
    || ' downstream:' || {_REPR.format(x='downstream_services')} || ' failure_modes:[] sla_p99:' || sla_p99_latency_ms::VARCHAR
    || 'ms error_rate_sla:' || sla_error_rate_pct::VARCHAR || '%', 1, 800) AS content FROM registry"""
_DEP_SQL = f"""SELECT id::VARCHAR AS doc, substr(concat_ws(' ', service_name, version, change_type, description,
    'risks:' || {_REPR.format(x='known_risks')}), 1, 800) AS content FROM deployments"""
_PM_SQL = """SELECT p.incident_id::VARCHAR AS doc, substr(p.incident_id::VARCHAR || ' ' || i.affected_services[1] || ' '
    || p.root_cause || ' ' || chr(10) || '- factor ' || (p.incident_id % 7)::VARCHAR || chr(10) || ' ' || chr(10) || chr(10)
    || '- add alert ' || (p.incident_id % 5)::VARCHAR || chr(10) || chr(10), 1, 800) AS content
    FROM postmortems p JOIN incidents i ON i.id = p.incident_id"""
_SEED_SQL = f"""
    SELECT 'runbooks' AS collection, stem || ':chunk' || chunk_index::VARCHAR AS key, substr(chunk, 1, 800) AS content
    FROM ({_pack_sql()}) WHERE {_NONBLANK}
    UNION ALL
    SELECT 'incidents', incident_id::VARCHAR || ':' || chunk_type, substr(text, 1, 800) FROM (
      SELECT incident_id, unnest(['summary', 'symptoms', 'root_cause', 'resolution']) AS chunk_type,
             unnest([concat_ws(' ', incident_id::VARCHAR, coalesce(anomaly_type, ''), coalesce(service_name, ''),
                               coalesce(severity, ''), coalesce(symptoms_observed, '')),
                     coalesce(symptoms_observed, ''), coalesce(root_cause, ''), coalesce(resolution_steps, '')]) AS text
      FROM ({_INC_SRC_SQL})) WHERE {strip_sql('text')} <> ''
    UNION ALL SELECT 'architecture', doc, content FROM ({_ARCH_SQL})
    UNION ALL SELECT 'deployments', doc, content FROM ({_DEP_SQL})
    UNION ALL SELECT 'postmortems', doc, content FROM ({_PM_SQL})"""


@register("k11_seed", A.with_adapters(
    f"SELECT collection, {uuid5_sql('doc_hash')} AS chunk_id, doc_hash, content, 256::BIGINT AS dims "
    f"FROM (SELECT *, substr(sha256(key), 1, 16) AS doc_hash FROM ({_SEED_SQL}))",
    "markdown_docs", "incidents", "postmortems", "registry", "deployments"), bench=True)
def q_seed(spark, sf):
    """The stored points of all five collections with their vectors."""
    store, _, _ = KN.seed_store(spark, sf)
    return store.select("collection", "chunk_id", "doc_hash", "content", F.size("embedding").cast("long").alias("dims"))


_LABELS = {"incidents": "Incident: ", "runbooks": "Runbook: ", "architecture": "Service: ", "deployments": "Deployment: ", "postmortems": "Postmortem: "}


def _searched(rows):
    by = {}
    for r in rows:
        by.setdefault(r.query_id, {}).setdefault(r.collection, []).append(r)
    assert by, "no request found anything"
    for hits in by.values():
        assert {"incidents", "runbooks", "architecture", "postmortems"} <= set(hits), "a collection without hits"
        for kind, found in hits.items():
            assert kind == "deployments" or sorted(h.rank for h in found) == list(range(1, len(found) + 1))
            assert all(h.evidence_head.startswith(_LABELS[kind]) for h in found), "evidence of another kind"
            assert any(h.tokens for h in found), "nothing fits the budget"
            if kind in ("incidents", "postmortems"):
                assert all(h.evidence_head.startswith(f"{_LABELS[kind]}{h.doc_id}\n") for h in found), "evidence of another record"


@register("k11_search", check=_searched)
def q_seed_search(spark, sf):
    """Seed, embed, store, search, render, budget: all open incidents ask all five collections, each with its own text; the
    hits are rendered from their records and cut to the token budget (`tokens` is null beyond it). Requests that a search
    cannot tell apart are searched and rendered once, and every incident gets their rows."""
    from emberwatch.operators import retrieve as R
    from emberwatch.plans import q_retrieve as QR
    from emberwatch.session import stage

    store, model, _ = KN.seed_store(spark, sf)
    still_open = (A.incidents(spark, sf).where(F.col("status") == "DETECTING")
                  .select(F.col("id").alias("query_id"), "anomaly_type", "affected_services", "description",
                          F.floor(F.col("detection_time") / 1000).cast("long").alias("query_epoch")))
    asked = stage(R.embed(R.request_texts(still_open).withColumnRenamed("query_text", "text"), model, out="query_vec").drop("text"), "asked")
    requests, members = R.alike(asked)
    hits = stage(R.gather(stage(requests, "requests"), store, deploy_window_s=48 * 3600, also=["service_name"]), "hits")
    found = R.gather_evidence(hits.where(F.col("chunk_id").isNotNull()), **QR._records(spark, sf, text_ids=True))
    found = stage(found.select(F.col("query_id").alias("same_as"), "collection", "chunk_id", "doc_id", "rank",
                               F.substring("evidence", 1, 60).alias("evidence_head"), "tokens"), "evidence").alias("f")
    to = (F.col("m.collection") == F.col("f.collection")) & F.col("m.same_as").eqNullSafe(F.col("f.same_as"))
    return members.alias("m").join(found, to).select("query_id", "f.collection", "chunk_id", "doc_id", "rank", "evidence_head", "tokens")
