"""Retrieval R-01..R-14: embeddings, exact cosine top-k (plain, filtered, time-ranged, per service),
best chunk per document, boosted re-rank, token budget, evidence rendering and the five-way gather.

Exact top-k is a block search (`blocksearch`): queries and corpus are dealt to blocks, each pair of blocks meets in one
Arrow cogroup that keeps k rows per query, and a window keeps the first k of all meetings; filtered searches add the
filter key (service, time cell) to the key of the meeting.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import tokens
from emberwatch.operators.blocksearch import search
from emberwatch.operators.knowledge import py_list_repr

def dot(a: Column, b: Column) -> Column:
    """Sequential dot product in double precision (a left fold, so the result is reproducible)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def _top_k(scored: DataFrame, k: int, *, part: Sequence[str] = ("query_id",), id_col: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col(id_col).asc())
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def knn(q: DataFrame, corpus: DataFrame, *, k: int, qvec: str = "query_vec", cvec: str = "embedding",
        query_blocks: int | None = None, corpus_blocks: int | None = None, stay: bool = False) -> DataFrame:
    """R-02: exact cosine top-k per query; ties broken by chunk_id. A stated query set against all rows, in blocks (with
    `stay`, the queries come to the rows)."""
    return _top_k(search(q, corpus, k=k, qvec=qvec, cvec=cvec, query_blocks=query_blocks, corpus_blocks=corpus_blocks, stay=stay), k)


def knn_filtered(q: DataFrame, corpus: DataFrame, *, k: int, equal: dict[str, object],
                 qvec: str = "query_vec", cvec: str = "embedding", stay: bool = False) -> DataFrame:
    """R-03: top-k among corpus rows whose payload equals the given values (filter before the join)."""
    c = corpus
    for col, val in equal.items():
        c = c.where(F.col(col) == F.lit(val))
    return knn(q, c, k=k, qvec=qvec, cvec=cvec, stay=stay)


def knn_per_service(q: DataFrame, corpus: DataFrame, *, k: int = 3, services: str = "affected_services",
                    qvec: str = "query_vec", cvec: str = "embedding",
                    window_s: tuple[str, str, int] | None = None, corpus_blocks: int | None = None) -> DataFrame:
    """R-07 (and R-04/R-08 with `window_s`): one search per (query, affected service) with service
    equality. window_s = (query time col, corpus time col, seconds) keeps corpus rows with
    query_t - seconds <= t <= query_t. There are few services, so the blocks of both sides (and the time cells, as wide
    as the window) split them further."""
    asked = q.select("*", F.explode(services).alias("svc"))
    found = search(asked, corpus, k=k, qvec=qvec, cvec=cvec, on=[("svc", "service_name")], within=window_s, corpus_blocks=corpus_blocks)
    return _top_k(found, k, part=("query_id", "svc"))


def best_per_doc(hits: DataFrame, *, doc: str = "doc_id", k: int = 5) -> DataFrame:
    """R-05: from a ranked hit list keep the first (best) chunk of each document, then the top k
    by score, keeping the original rank order on ties."""
    w1 = Window.partitionBy("query_id", doc).orderBy("rank")
    best = hits.withColumn("__r", F.row_number().over(w1)).where("__r = 1").drop("__r")
    w2 = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return best.withColumn("rank", F.row_number().over(w2).cast("long")).where(F.col("rank") <= k)


def boost(hits: DataFrame, *, service: float = K.SERVICE_BOOST, type_: float = K.TYPE_BOOST, k: int = 5,
          q_services: str = "affected_services", q_type: str = "q_type",
          c_services: str = "services", c_types: str = "anomaly_types") -> DataFrame:
    """R-06: +service boost when the chunk shares a service with the request, +type boost when it lists
    the request's anomaly type, each capped at 1; re-rank (stable on the original rank), keep k."""
    s = F.col("score")
    s = F.when(F.arrays_overlap(F.col(q_services), F.col(c_services)), F.least(F.lit(1.0), s + F.lit(service))).otherwise(s)
    s = F.when(F.array_contains(F.col(c_types), F.col(q_type)), F.least(F.lit(1.0), s + F.lit(type_))).otherwise(s)
    out = hits.withColumn("score", s)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def budget(hits: DataFrame, *, max_tokens: int = K.MAX_TOKENS, order: Sequence[str] = K.BUDGET_ORDER,
           group: str | Sequence[str] = "query_id", text: str = "content", kind: str = "collection") -> DataFrame:
    """R-11: token budget of each request (`group`). Types in fixed order, an unknown type counts as architecture;
    within a type stop at the first chunk that overflows; later types may still fit. Per request the hit list is
    already k-bounded, so the fold runs over a short array. Returns the kept hits with `tokens` and `budget_pos`."""
    group = [group] if isinstance(group, str) else list(group)
    known = F.array(*[F.lit(t) for t in order])
    type_rank = F.when(F.array_contains(known, F.col(kind)), F.array_position(known, F.col(kind))).otherwise(
        F.lit(list(order).index("architecture") + 1).cast("long"))
    prepared = hits.withColumn("tokens", tokens(text)).withColumn("__tr", type_rank)
    per = prepared.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("__tr", "rank", "chunk_id", "tokens")))
                                      .alias("items"))
    init = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("stopped"),
                    F.array().cast(f"array<{hits.schema['chunk_id'].dataType.simpleString()}>").alias("kept"))

    def step(acc, it):
        blocked = acc["stopped"] == it["__tr"]
        fits = acc["total"] + it["tokens"] <= max_tokens
        keep = F.struct((acc["total"] + it["tokens"]).alias("total"), acc["stopped"].alias("stopped"),
                        F.concat(acc["kept"], F.array(it["chunk_id"])).alias("kept"))
        stop = F.struct(acc["total"].alias("total"), it["__tr"].cast("long").alias("stopped"), acc["kept"].alias("kept"))
        return F.when(blocked, acc).when(fits, keep).otherwise(stop)

    kept = per.select(*group, F.posexplode(F.aggregate("items", init, step)["kept"]).alias("budget_pos", "chunk_id"))
    return prepared.drop("__tr").join(kept, [*group, "chunk_id"])


def render(hits: DataFrame, incidents: DataFrame, registry: DataFrame, runbooks: DataFrame, deployments: DataFrame,
           postmortems: DataFrame) -> DataFrame:
    """R-12: evidence text per collection, from the columns of the source records (hits are k-bounded, the
    records are joined on their ids):

    incidents (id, service_name, severity, anomaly_type, symptoms, root_cause, resolution, mttr_minutes),
    registry (service_name, team_owner, criticality, sla_*, on_call_rotation, downstream_services, description,
    known_failure_modes), runbooks (doc_id, title, anomaly_types, services), deployments (id, service_name, version,
    deployed_by, change_type, description, known_risks, deployed_at) and postmortems (incident_id, service,
    root_cause_category, contributing_factors, preventative_actions). A field that is missing is empty."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"__{tag}_{c}") for c in df.columns])

    j = (hits.join(side(incidents, "i"), F.col("doc_id") == F.col("__i_id"), "left")
         .join(side(registry, "a"), F.col("service_name") == F.col("__a_service_name"), "left")
         .join(side(runbooks, "r"), F.col("doc_id") == F.col("__r_doc_id"), "left")
         .join(side(deployments, "d"), F.col("doc_id") == F.col("__d_id"), "left")
         .join(side(postmortems, "p"), F.col("doc_id") == F.col("__p_incident_id"), "left"))
    s = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    names = lambda c: py_list_repr(F.coalesce(F.col(c), F.array().cast("array<string>")))
    incident_txt = F.concat(
        F.lit("Incident: "), s("__i_id"), F.lit("\nService: "), s("__i_service_name"), F.lit(" | Severity: "), s("__i_severity"),
        F.lit(" | Type: "), s("__i_anomaly_type"), F.lit("\nSymptoms: "), s("__i_symptoms"), F.lit("\nRoot Cause: "),
        s("__i_root_cause"), F.lit("\nResolution: "), s("__i_resolution"), F.lit("\nMTTR: "), s("__i_mttr_minutes", "?"),
        F.lit(" minutes"))
    runbook_txt = F.concat(F.lit("Runbook: "), s("__r_title"), F.lit("\nFor: "), names("__r_anomaly_types"),
                           F.lit(" on "), names("__r_services"), F.lit("\n\n"), s("content"))
    arch_txt = F.concat(
        F.lit("Service: "), s("service_name"), F.lit("\nTeam: "), s("__a_team_owner"), F.lit(" | Criticality: "),
        s("__a_criticality"), F.lit("\nSLA: P99 < "), s("__a_sla_p99_latency_ms", "?"), F.lit("ms, error rate < "),
        s("__a_sla_error_rate_pct", "?"), F.lit("%\nOn-call: "), s("__a_on_call_rotation"), F.lit("\nDownstream: "),
        names("__a_downstream_services"), F.lit("\nDescription: "), s("__a_description"), F.lit("\nKnown failure modes: "),
        names("__a_known_failure_modes"))
    risks = F.when(F.size(F.coalesce(F.col("__d_known_risks"), F.array().cast("array<string>"))) > 0, F.array_join(
        F.transform("__d_known_risks", lambda r: F.concat(F.lit("  - "), r)), "\n")).otherwise(F.lit("  None flagged"))
    deploy_txt = F.concat(F.lit("Deployment: "), s("__d_service_name"), F.lit(" "), s("__d_version"), F.lit("\nDeployed at: "),
                          s("__d_deployed_at"), F.lit(" by "), s("__d_deployed_by"), F.lit("\nChange type: "),
                          s("__d_change_type"), F.lit("\nDescription: "), s("__d_description"), F.lit("\nKnown risks:\n"), risks)
    pm_txt = F.concat(F.lit("Postmortem: "), s("__p_incident_id"), F.lit("\nService: "), s("__p_service"),
                      F.lit(" | Category: "), s("__p_root_cause_category"), F.lit("\nContributing factors:\n"),
                      s("__p_contributing_factors"), F.lit("\nPreventative actions:\n"), s("__p_preventative_actions"))
    txt = (F.when(F.col("collection") == "incidents", incident_txt)
            .when(F.col("collection") == "runbooks", runbook_txt)
            .when(F.col("collection") == "architecture", arch_txt)
            .when(F.col("collection") == "deployments", deploy_txt)
            .otherwise(pm_txt))
    return j.select(*hits.columns, txt.alias("evidence"))


def gather(q: DataFrame, corpus: DataFrame, *, deploy_window_s: int = 120 * 60, also: Sequence[str] = ()) -> DataFrame:
    """R-13: the five searches for a batch of incident requests, unioned by name:
    (with a `collection` column in `q`, each search takes its own request row)
    incidents (filtered resolved+production, top 20 -> best per doc -> 5), runbooks (top 10 -> boost -> 5),
    architecture (per service, 3), deployments (per service in the time window, 5), postmortems (5). `also`: further
    columns of the corpus that hits carry."""
    cols = ["query_id", "collection", "chunk_id", "doc_id", "score", "rank", "content", *also]
    own = "collection" in q.columns  # a request text, and so a vector, per search

    def coll(name):
        return corpus.where(F.col("collection") == name).drop("text", "text_hash", "doc_hash")  # only what hits carry meets the queries

    def asked(name):
        return q.where(F.col("collection") == name).drop("collection") if own else q

    inc = best_per_doc(knn_filtered(asked("incidents"), coll("incidents"), k=20, equal={"environment": "production", "resolved": True}, stay=True),
                       k=5).withColumn("collection", F.lit("incidents"))
    rb = knn(asked("runbooks"), coll("runbooks").withColumn("services", F.array("service_name"))
                                .withColumn("anomaly_types", F.array("anomaly_type")), k=10, stay=True)
    rb = boost(rb, k=5).withColumn("collection", F.lit("runbooks"))
    arch = knn_per_service(asked("architecture"), coll("architecture"), k=3).withColumn("collection", F.lit("architecture"))
    dep = knn_per_service(asked("deployments"), coll("deployments"), k=5, window_s=("query_epoch", "epoch", deploy_window_s))\
        .withColumn("collection", F.lit("deployments"))
    pm = knn(asked("postmortems"), coll("postmortems"), k=5, stay=True).withColumn("collection", F.lit("postmortems"))
    out = inc.select(*cols)
    for part in (rb, arch, dep, pm):
        out = out.unionByName(part.select(*cols))
    return out


def gather_evidence(hits: DataFrame, *, max_tokens: int = K.MAX_TOKENS, **records: DataFrame) -> DataFrame:
    """R-13 as it is asked for: the hits of each search are rendered from their source records (`render`), then cut to the
    token budget of that search. All hits with `evidence`, and `tokens` of those that fit (null: over the budget)."""
    rendered = render(hits, **records)
    kept = budget(rendered, max_tokens=max_tokens, group=["query_id", "collection"], text="evidence")
    return rendered.join(kept.select("query_id", "collection", "chunk_id", "tokens"), ["query_id", "collection", "chunk_id"], "left")


def request_texts(incidents: DataFrame) -> DataFrame:
    """R-13: the five request texts of an incident (query_id, anomaly_type, affected_services, description,
    query_epoch), one row per collection to search."""
    kind, services = F.col("anomaly_type"), F.array_join("affected_services", " ")
    about = F.concat(kind, F.lit(" "), F.coalesce("description", F.lit("")))
    texts = [("incidents", about), ("runbooks", F.concat(about, F.lit(" troubleshooting"))),
             ("architecture", F.concat(services, F.lit(" architecture dependencies"))),
             ("deployments", F.concat(services, F.lit(" recent deployment"))),
             ("postmortems", F.concat(kind, F.lit(" recurring contributing factors")))]
    rows = F.array(*[F.struct(F.lit(name).alias("collection"), t.alias("query_text")) for name, t in texts])
    return incidents.select("query_id", kind.alias("q_type"), "affected_services", "query_epoch", F.inline(rows))


#: What a search of each collection reads of a request beside its vector.
_READS = {"incidents": [], "runbooks": ["q_type", "affected_services"], "architecture": ["affected_services"],
          "deployments": ["affected_services", "query_epoch"], "postmortems": []}


HELD_KINDS = 1 << 16  # kinds of requests whose ids are broadcast; more are joined


def alike(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (query_id, collection, query_vec, q_type, affected_services, query_epoch) that their search cannot tell
    apart: the rows of one request of each kind (the smallest query_id), and all requests as (query_id, collection,
    same_as). Requests are embedded texts, and many incidents say the same; each is searched once."""
    from emberwatch.session import stage

    read = [F.when(F.col("collection").isin(*[c for c, used in _READS.items() if name in used]), F.col(name)).alias(name)
            for name in ("q_type", "affected_services", "query_epoch")]
    own = asked.select("query_id", "collection", "query_vec", *read)
    # 128 bits stand for what is asked, so that vectors are neither shuffled nor compared as such
    what = ["query_vec", "q_type", "affected_services", "query_epoch"]
    digest = F.struct(F.xxhash64(*what).alias("a"), F.xxhash64(F.lit(1), *what).alias("b"))
    per = stage(own.groupBy("query_id", "collection").agg(F.sort_array(F.collect_list(digest)).alias("ask")), "asks")
    kinds = stage(per.groupBy("collection", "ask").agg(F.min("query_id").alias("same_as")), "kinds")
    members = per.join(kinds, ["collection", "ask"]).select("query_id", "collection", "same_as")
    first = kinds.select(F.col("same_as").alias("__q"), F.col("collection").alias("__c"))
    first = F.broadcast(first) if first.count() <= HELD_KINDS else first
    requests = own.join(first, F.col("query_id").eqNullSafe(F.col("__q")) & (F.col("collection") == F.col("__c")), "left_semi")
    return requests.select("query_id", "collection", *what), members


def embed_fit(docs: DataFrame, *, text: str = "content", features: int = 1 << 12):
    """R-01: a distributed text embedder: RegexTokenizer -> HashingTF -> IDF -> Normalizer(L2).
    IDF is fitted with one aggregation over the corpus; the output vectors are unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__idf"),
        Normalizer(inputCol="__idf", outputCol="__vec", p=2.0),
    ])
    return pipe.fit(docs)


def embed(df: DataFrame, model, *, out: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    t = model.transform(df)
    return t.withColumn(out, vector_to_array("__vec", "float32")).drop("__tok", "__tf", "__idf", "__vec")


class InvertedFile:
    """R-14: an inverted-file index. Coarse centroids are fitted by Spark's k-means (as many as the square root of the
    row count, at most `CENTROIDS`), every row is stored under the cell of its nearest centroid, partitioned by cell,
    and a query searches the rows of its `probes` nearest cells exactly. The stored lists are read again by every
    search.

    `probes` is the least number of cells with which a bounded, documented sample of the rows (`SAMPLE` of them, asked
    as queries against all rows) finds `recall` of its exact neighbours. Where a query's cells hold fewer than k rows it
    is searched exactly instead, so every query gets k rows whenever the corpus has them."""

    CENTROIDS = 4_096
    SAMPLE = 256

    def __init__(self, corpus: DataFrame, *, k: int, recall: float = 0.97, cvec: str = "embedding", row_id: str = "chunk_id"):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        from emberwatch.session import stage

        self.cvec, self.row_id = cvec, row_id
        norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
        # a cell is a direction: rows and queries are compared as unit vectors
        self._unit = lambda v, out: (lambda df: df.withColumn("__n", norm(v)).where("__n > 0").withColumn(
            out, array_to_vector(F.transform(v, lambda x: x.cast("double") / F.col("__n")))).drop("__n"))
        rows = corpus.select(row_id, cvec).where(F.col(cvec).isNotNull())
        n = rows.count()
        self.cells = max(1, min(self.CENTROIDS, int(n**0.5)))
        units = self._unit(cvec, "features")(rows)
        model = KMeans(k=self.cells, seed=11, maxIter=8, initMode="random", predictionCol="cell").fit(units) if n else None
        self.centres = [c.tolist() for c in model.clusterCenters()] if model else []  # at most CENTROIDS of them
        listed = model.transform(units).drop("features") if model else rows.withColumn("cell", F.lit(0))
        # a few files a cell, not one from every task that holds rows of it
        self.lists = stage(listed.repartition("cell", F.pmod(F.xxhash64(row_id), F.lit(4))), "ivf-lists", by=["cell"])
        sample = self.lists.orderBy(F.xxhash64(row_id)).limit(self.SAMPLE).select(F.col(row_id).alias("query_id"), F.col(cvec).alias("query_vec"))
        self.probes = self._fitted(stage(sample, "ivf-sample"), k, recall) if n else 1

    def nearest_cells(self, q: DataFrame, qvec: str, n: int) -> DataFrame:
        """The query with each of its n nearest cells (`cell`) and the cell's place (`order`, from 0)."""
        centres = np.array(self.centres)

        @F.pandas_udf("array<int>")
        def near(vectors: pd.Series) -> pd.Series:
            x = np.array([np.asarray(v, np.float64) for v in vectors]).reshape(len(vectors), -1)
            far = (centres * centres).sum(1) - 2 * (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
            return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)))

        usable = q.where(F.col(qvec).isNotNull() & F.exists(qvec, lambda x: x != 0))
        return usable.select("*", F.posexplode(near(qvec)).alias("order", "cell_of"))

    def _fitted(self, sample: DataFrame, k: int, recall: float) -> int:
        exact = knn(sample, self.lists.select(F.col(self.row_id).alias("chunk_id"), F.col(self.cvec).alias("embedding"), "cell"), k=k)
        order = self.nearest_cells(sample, "query_vec", self.cells).select("query_id", F.col("cell_of").alias("cell"), "order")
        found = exact.join(order, ["query_id", "cell"]).groupBy("order").agg(F.count(F.lit(1)).alias("n")).orderBy("order").collect()
        total, seen = sum(r["n"] for r in found), 0
        for r in found:  # at most CENTROIDS rows
            seen += r["n"]
            if seen >= recall * total:
                return r["order"] + 1
        return self.cells

    def candidates(self, q: DataFrame, qvec: str = "query_vec") -> DataFrame:
        """query_id, n: how many rows lie in the cells that a query probes."""
        sizes = self.lists.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("cell", "cell_of")
        return self.nearest_cells(q, qvec, self.probes).join(sizes, "cell_of").groupBy("query_id").agg(F.sum("n").alias("n"))

    def search(self, q: DataFrame, *, k: int, qvec: str = "query_vec") -> DataFrame:
        """query_id, chunk_id, score, rank: the k best rows of the cells that each query probes."""
        from emberwatch.session import stage

        asked = self.nearest_cells(q.select("query_id", qvec), qvec, self.probes).drop("order")
        rows = self.lists.select(F.col(self.row_id).alias("chunk_id"), F.col(self.cvec).alias("embedding"), "cell")
        found = search(asked, rows, k=k, qvec=qvec, on=[("cell_of", "cell")])
        # read three times below, and a search is the costly part: it runs once
        near = stage(_top_k(found.select("query_id", "chunk_id", "score"), k), "ivf-near")
        whole = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        short = q.select("query_id", qvec).join(whole, "query_id", "left_anti")
        rest = knn(stage(short, "ivf-short"), rows.drop("cell"), k=k, qvec=qvec)
        return near.join(whole, "query_id", "left_semi").select("query_id", "chunk_id", "score", "rank").unionByName(
            rest.select("query_id", "chunk_id", "score", "rank"))


def knn_approx(q: DataFrame, corpus: DataFrame, *, k: int, recall: float = 0.97, qvec: str = "query_vec", cvec: str = "embedding",
               index: InvertedFile | None = None) -> DataFrame:
    """R-14: approximate top-k by an inverted file, built over the corpus or given (one index serves many searches)."""
    index = index or InvertedFile(corpus, k=k, recall=recall, cvec=cvec)
    return index.search(q, k=k, qvec=qvec)
