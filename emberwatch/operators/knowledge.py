"""Knowledge preparation K-01..K-11: front matter, section split, paragraph packing, hashing, stable
ids, chunk builders and the idempotent upsert. Everything is a per-row expression except K-07
(one window over a document's lines) and K-09 (a keyed anti join), so a corpus of any size is split
across tasks by document and no document is ever cut short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions.columns import doc_hash, point_id
from emberwatch.operators.tables import _first_per_key

# Fixed value: the characters Python's str.strip() removes (str.isspace), in code point order.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
WS_SQL = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)  # the same set as a DuckDB string expression
SECTION_RE = r"(?md)(?=^#{2,3} )"
# Fixed value: the line breaks Python's str.splitlines() splits on.
LINES_RE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def pystrip(c: Column) -> Column:
    """Python's str.strip(): trim the whitespace set from both ends (no regex scan of the text)."""
    return F.trim(c, F.lit(WS_CHARS))


def front_matter(df: DataFrame, *, text: str = "text") -> DataFrame:
    """K-01: `---` front matter -> meta map<string,string> and body; unclosed or missing -> empty map.
    Keys and values are stripped, values lose surrounding double quotes; the last duplicate key wins."""
    t = F.col(text)
    has = t.startswith("---")
    end = F.locate("---", t, 4)  # 1-based position of the closing marker searched from offset 3
    closed = has & (end > 0)
    fm = F.substring(t, F.lit(4), end - 4)
    body = pystrip(F.substring(t, end + 3, 1 << 30))
    lines = F.filter(F.split(fm, LINES_RE), lambda l: l.contains(":"))
    entries = F.transform(lines, lambda l: F.struct(
        pystrip(F.substring_index(l, ":", 1)).alias("key"),
        F.trim(pystrip(F.substring(l, F.instr(l, ":") + 1, 1 << 30)), F.lit('"')).alias("value")))
    # keep the last occurrence of each key (Python dict assignment order)
    uniq = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1 << 30),
                                                     lambda x: x["key"] == e["key"]))
    meta = F.when(closed, F.map_from_entries(uniq)).otherwise(F.create_map().cast("map<string,string>"))
    return df.withColumn("meta", meta).withColumn("body", F.when(closed, body).otherwise(t))


def meta_list(meta_col: str, key: str) -> Column:
    """A list-valued front-matter field (JSON array text) as array<string>; absent or not a list -> []."""
    raw = F.col(meta_col).getItem(key)
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def sections(df: DataFrame, *, body: str = "body") -> DataFrame:
    """K-02: split before `## ` / `### ` line starts; sections are stripped, empty ones dropped.
    Adds `section_idx` (position among all pieces) and `section`."""
    parts = F.split(F.col(body), SECTION_RE)
    return (df.select("*", F.posexplode(parts).alias("section_idx", "__raw"))
              .withColumn("section", pystrip(F.col("__raw"))).drop("__raw")
              .where(F.col("section") != ""))


def _pack_expr(section: Column, max_tokens: int) -> Column:
    limit = F.lit(4 * max_tokens)
    paras = F.split(section, "\n\n")
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def step(acc, p):
        fits = (F.length(acc["cur"]) + F.length(p)) <= limit
        merged = pystrip(F.concat(acc["cur"], F.lit("\n\n"), p))
        flushed = F.when(acc["cur"] != "", F.concat(acc["chunks"], F.array(acc["cur"]))).otherwise(acc["chunks"])
        return F.when(fits, F.struct(acc["chunks"].alias("chunks"), merged.alias("cur")))\
                .otherwise(F.struct(flushed.alias("chunks"), p.alias("cur")))

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["chunks"], F.array(acc["cur"]))).otherwise(acc["chunks"])

    packed = F.aggregate(paras, init, step, finish)
    return F.when(F.length(section) <= limit, F.array(section)).otherwise(packed)


def chunk_array(body: Column, max_tokens: int = 400) -> Column:
    """K-02 + K-03 as one per-document expression: the non-empty stripped sections, each kept whole when
    it fits (chars/4 <= max_tokens) or packed greedily by paragraph, flattened in document order; a
    document with no chunk falls back to its first 1600 characters. Row-local: no shuffle, no join."""
    secs = F.filter(F.transform(F.split(body, SECTION_RE), lambda x: pystrip(x)), lambda x: x != "")
    pieces = F.flatten(F.transform(secs, lambda x: _pack_expr(x, max_tokens)))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.substring(body, 1, 1600)))


def pack(df: DataFrame, *, max_tokens: int = 400, key: str = "stem", body: str = "body") -> DataFrame:
    """K-02 + K-03: one row per chunk with `chunk_index` (0-based, in document order) and `chunk`;
    the other columns of `df` (except the body) are carried along."""
    rest = [c for c in df.columns if c != body]
    return df.select(*rest, F.posexplode(chunk_array(F.col(body), max_tokens)).alias("chunk_index", "chunk"))\
             .withColumn("chunk_index", F.col("chunk_index").cast("long"))


def with_ids(df: DataFrame, name: Column) -> DataFrame:
    """K-04 + K-05: doc_hash of the name and the UUIDv5 point id of that hash."""
    return df.withColumn("doc_hash", doc_hash(name)).withColumn("point_id", point_id(F.col("doc_hash")))


def runbook_chunks(docs: DataFrame, *, max_tokens: int = 400) -> DataFrame:
    """Runbook markdown -> chunk rows with payload columns (K-01..K-05, K-08)."""
    fm = front_matter(docs)
    meta = fm.select("stem", "body",
                     F.coalesce(F.col("meta")["runbook_id"], F.col("stem")).alias("runbook_id"),
                     F.coalesce(F.col("meta")["title"], F.col("stem")).alias("title"),
                     meta_list("meta", "anomaly_types").alias("anomaly_types"),
                     meta_list("meta", "services").alias("services"),
                     meta_list("meta", "tags").alias("tags"))
    out = pack(meta, max_tokens=max_tokens).where(pystrip(F.col("chunk")) != "")
    out = with_ids(out, F.concat(F.col("stem"), F.lit(":chunk"), F.col("chunk_index").cast("string")))
    return out.withColumn("content", F.substring("chunk", 1, 800)).withColumn("collection", F.lit("runbooks"))


def incident_chunks(inc: DataFrame) -> DataFrame:
    """K-06: four chunks per incident (summary, symptoms, root cause, resolution); blank ones dropped.
    `inc` has incident_id, anomaly_type, service_name, severity, symptoms_observed, root_cause,
    resolution_steps, resolved, mttr_minutes."""
    iid = F.col("incident_id").cast("string")
    summary = F.concat_ws(" ", iid, F.coalesce("anomaly_type", F.lit("")), F.coalesce("service_name", F.lit("")),
                          F.coalesce("severity", F.lit("")), F.coalesce("symptoms_observed", F.lit("")))
    kinds = F.array(
        F.struct(F.lit("summary").alias("chunk_type"), summary.alias("text")),
        F.struct(F.lit("symptoms").alias("chunk_type"), F.coalesce("symptoms_observed", F.lit("")).alias("text")),
        F.struct(F.lit("root_cause").alias("chunk_type"), F.coalesce("root_cause", F.lit("")).alias("text")),
        F.struct(F.lit("resolution").alias("chunk_type"), F.coalesce("resolution_steps", F.lit("")).alias("text")))
    out = inc.select("*", F.inline(kinds)).where(pystrip(F.col("text")) != "")
    out = with_ids(out, F.concat(iid, F.lit(":"), F.col("chunk_type")))
    return out.withColumn("content", F.substring("text", 1, 800)).withColumn("collection", F.lit("incidents"))


def named_sections(df: DataFrame, *, key: str = "stem", body: str = "body") -> DataFrame:
    """K-07: contributing factors / preventative actions by line state. A line containing
    'Contributing Factor' opens factors, one containing 'Preventative' or 'Action' opens actions,
    a line starting with '## ' closes; other lines append to the open section (with a newline)."""
    parts = F.split(F.col(body), LINES_RE)
    # like splitlines(): a final line break does not start another (empty) line
    parts = F.when(F.col(body).rlike(r"(?:" + LINES_RE + r")\z"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    lines = df.select(key, F.posexplode(parts).alias("ln", "line"))
    marker = (F.when(F.col("line").contains("Contributing Factor"), "contributing_factors")
               .when(F.col("line").contains("Preventative") | F.col("line").contains("Action"), "preventative_actions")
               .when(F.col("line").startswith("## "), "none"))
    w = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("marker", marker).withColumn("state", F.last("marker", ignorenulls=True).over(w))
    content = lines.where(F.col("marker").isNull() & F.col("state").isin("contributing_factors",
                                                                          "preventative_actions"))
    agg = content.groupBy(key).agg(
        *[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("state") == s, F.struct("ln", "line")))),
                                   lambda x: F.concat(x["line"], F.lit("\n"))), "").alias(s)
          for s in ("contributing_factors", "preventative_actions")])
    return df.select(key).join(agg, key, "left").select(
        key, F.coalesce("contributing_factors", F.lit("")).alias("contributing_factors"),
        F.coalesce("preventative_actions", F.lit("")).alias("preventative_actions"))


def py_list_repr(arr: Column) -> Column:
    """Python's repr of a list of plain strings: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "),
                    F.lit("]"))


def deployment_text(dep: DataFrame, *, chars: int = 800) -> DataFrame:
    """K-08 (deployments): '{service} {version} {change_type} {description} risks:{known_risks}': `full_text`, and capped as
    `content`."""
    txt = F.concat_ws(" ", "service_name", "version", "change_type", "description",
                      F.concat(F.lit("risks:"), py_list_repr(F.col("known_risks"))))
    return dep.withColumn("full_text", txt).withColumn("content", F.substring("full_text", 1, chars))


def architecture_text(reg: DataFrame, *, chars: int = 800) -> DataFrame:
    """K-08 (architecture) from registry rows; `description` and `known_failure_modes` are used where the registry has
    them. `full_text` is whole, `content` capped."""
    col = lambda c, d: F.coalesce(F.col(c), d) if c in reg.columns else d
    none = F.array().cast("array<string>")
    txt = F.concat(
        F.col("service_name"), F.lit(" "), col("description", F.lit("")), F.lit(" team:"), F.col("team_owner"),
        F.lit(" criticality:"), F.col("criticality"), F.lit(" downstream:"), py_list_repr(F.col("downstream_services")),
        F.lit(" failure_modes:"), py_list_repr(col("known_failure_modes", none)), F.lit(" sla_p99:"),
        F.col("sla_p99_latency_ms").cast("string"),
        F.lit("ms error_rate_sla:"), F.col("sla_error_rate_pct").cast("string"), F.lit("%"))
    return reg.withColumn("full_text", txt).withColumn("content", F.substring("full_text", 1, chars))


def postmortem_text(pm: DataFrame, *, chars: int = 800) -> DataFrame:
    """K-08 (postmortems): '{incident} {service} {category} {contributing factors} {preventative actions}': `full_text`, and
    capped as `content`. `pm` has incident_id, service, root_cause_category, full_markdown."""
    sections = named_sections(pm.select("incident_id", "full_markdown"), key="incident_id", body="full_markdown")
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    txt = F.concat(s("incident_id"), F.lit(" "), s("service"), F.lit(" "), s("root_cause_category"), F.lit(" "),
                   s("contributing_factors"), F.lit(" "), s("preventative_actions"))
    return pm.join(sections, "incident_id").withColumn("full_text", txt).withColumn("content", F.substring("full_text", 1, chars))


def upsert_chunks(store: DataFrame, chunks: DataFrame, *, doc: str = "stem") -> DataFrame:
    """K-09: upsert of whole documents. Every point of a document in `chunks` is replaced by its new one (all payload
    columns), points whose chunk no longer exists go, other documents stay. A re-run changes nothing. A store without
    the document column replaces point by point."""
    doc = doc if doc in store.columns else "point_id"
    ids = [c for c in ("collection", "point_id") if c in store.columns]  # a point's id is unique within its collection
    new = _first_per_key(chunks.select(*store.columns), ids, None, last=False)
    return store.join(new.select(doc).distinct(), doc, "left_anti").select(*store.columns).unionByName(new)


POINT_COLUMNS = ("collection", "chunk_id", "doc_id", "doc_hash", "service_name", "anomaly_type", "environment", "resolved",
                 "epoch", "content", "text")


def seed_points(spark, sf_dir: str) -> DataFrame:
    """K-11: the points of all five collections: ids, the payload columns that searches filter on, `content` (the stored
    payload, cut) and `text` (the whole text that is embedded)."""
    from emberwatch.operators.serve import mttr_col
    from emberwatch.sources import adapters as A

    inc = A.incidents(spark, sf_dir)
    pm = A.postmortems(spark, sf_dir)
    first = F.element_at("affected_services", 1)
    pmj = pm.select(F.col("incident_id").alias("pid"), "executive_summary")
    src = inc.join(pmj, inc.id == pmj.pid, "left").select(
        F.col("id").alias("incident_id"), "anomaly_type", first.alias("service_name"),
        "severity", F.col("description").alias("symptoms_observed"), F.col("top_root_cause").alias("root_cause"),
        F.col("executive_summary").alias("resolution_steps"), (F.col("status") == "RESOLVED").alias("resolved"),
        mttr_col().alias("mttr_minutes"), "detection_time")
    about = inc.select(F.col("id").alias("incident_id"), first.alias("service"), "anomaly_type")
    pmt = postmortem_text(pm.join(about, "incident_id").withColumn("root_cause_category", F.col("root_cause")))
    none = lambda t: F.lit(None).cast(t)

    def points(df, name, doc, service, kind=none("string"), resolved=none("boolean"), epoch=none("long"), *, text):
        return df.select(F.lit(name).alias("collection"), F.col("point_id").alias("chunk_id"), doc.cast("string").alias("doc_id"),
                         "doc_hash", service.alias("service_name"), kind.alias("anomaly_type"), F.lit("production").alias("environment"),
                         resolved.alias("resolved"), epoch.cast("long").alias("epoch"), "content",
                         text.alias("text"))

    parts = [
        points(runbook_chunks(A.markdown_docs(spark, sf_dir)), "runbooks", F.col("stem"), F.element_at("services", 1),
               F.element_at("anomaly_types", 1), text=F.col("chunk")),
        points(incident_chunks(src), "incidents", F.col("incident_id"), F.col("service_name"), F.col("anomaly_type"),
               F.col("resolved"), F.floor(F.col("detection_time") / 1000), text=F.col("text")),
        points(with_ids(architecture_text(A.registry(spark)), F.col("service_name")), "architecture", F.col("service_name"),
               F.col("service_name"), text=F.col("full_text")),
        points(with_ids(deployment_text(A.deployments(spark, sf_dir)), F.col("id").cast("string")), "deployments", F.col("id"),
               F.col("service_name"), epoch=F.floor(F.col("deployed_at") / 1000), text=F.col("full_text")),
        points(with_ids(pmt, F.col("incident_id").cast("string")), "postmortems", F.col("incident_id"), F.col("service"),
               F.col("anomaly_type"), text=F.col("full_text")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*POINT_COLUMNS)


def changed_points(points: DataFrame, store: DataFrame) -> DataFrame:
    """The points that a store does not hold yet with the same text (`text_hash`)."""
    return points.join(store.select("collection", "chunk_id", "text_hash"), ["collection", "chunk_id", "text_hash"], "left_anti")


def _single_points(points: DataFrame) -> DataFrame:
    """One point for each id of a collection, the first by its other columns. Ids that come more than once are found by a
    hash of the id alone; only their rows, if there are any, are shuffled whole."""
    from emberwatch.session import stage

    ids = ["collection", "chunk_id"]
    marked = points.withColumn("__id", F.xxhash64(*ids))
    again = stage(marked.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id"), "repeated-ids")
    if again.isEmpty():
        return points
    some = marked.join(again, "__id", "left_semi").drop("__id")
    return marked.join(again, "__id", "left_anti").drop("__id").unionByName(_first_per_key(some, ids, None, last=False))


def seed_store(spark, sf_dir: str, store: DataFrame | None = None, model=None, points: DataFrame | None = None):
    """K-11: chunk, embed, upsert. Returns the store with vectors (`embedding`) and the hash of the embedded text
    (`text_hash`) beside the payload columns, the fitted embedder, and how many points were embedded.

    With an older store and its embedder, only points whose text changed are embedded; unchanged ones keep their vectors,
    and points whose chunk or document no longer exists go. The embedder's document frequencies stay those of its fit
    until a seed without `model`, which fits anew and embeds every point, so that vectors of one store always belong to
    one fit."""
    from emberwatch.operators.retrieve import embed, embed_fit
    from emberwatch.session import stage

    points = seed_points(spark, sf_dir) if points is None else points
    points = _single_points(points)
    # half a SHA-256, as bytes: a hash is compared with that of the same point only
    points = points.withColumn("text_hash", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)))
    if store is None or model is None:
        # fit and embedding each compute the points anew: a staged copy would be as large as the store itself
        model = embed_fit(points.select("text"), text="text", features=256)
        # in the order that the store's folders are written in, before the vectors make the rows wide
        fresh = stage(embed(points.sortWithinPartitions("collection"), model).drop("text"), "store", by=["collection"])
        return fresh, model, fresh.count()
    points = stage(points, "points")
    new = stage(embed(changed_points(points, store), model), "embedded")
    kept = store.join(points.select("collection", "chunk_id", "text_hash"), ["collection", "chunk_id", "text_hash"], "left_semi")
    vectors = kept.select("collection", "chunk_id", "embedding").unionByName(new.select("collection", "chunk_id", "embedding"))
    # payload columns come from the new points, vectors from wherever they are valid
    out = points.join(vectors, ["collection", "chunk_id"]).select(*store.columns)
    return stage(out, "store", by=["collection"]), model, new.count()
