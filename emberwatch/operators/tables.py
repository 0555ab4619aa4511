"""Table maintenance as DataFrame operators (S-02, S-05..S-08, S-11, S-13): replay, cursor reads,
insert-if-absent, column-subset upsert and the partial-update fold. All are joins/aggregations keyed
on the table key, so they shuffle once on that key and never gather a table on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(df: DataFrame, since_ms: int, until_ms: int | None = None, *, service: str | None = None,
           ts: str = "ts", limit: int | None = None) -> DataFrame:
    """S-02: rows with since <= ts <= until (until defaults to since + 1 h), optional service equality.
    Where `ts` is computed from a stored time, bound that at the source too (the adapters' since_ms, until_ms), so
    that the bound reaches the scan. `limit` keeps the first rows in (ts, event_id) order."""
    end = until_ms if until_ms is not None else since_ms + 3_600_000
    out = df.where((F.col(ts) >= F.lit(since_ms)) & (F.col(ts) <= F.lit(end)))
    if service is not None:
        out = out.where(F.col("source_service") == F.lit(service))
    if limit is not None:
        out = out.orderBy(ts, *(["event_id"] if "event_id" in df.columns else [])).limit(int(limit))
    return out


def read_since(df: DataFrame, cursor: tuple, *, order: Sequence[str] = ("deployed_at", "id"),
               limit: int = 50) -> DataFrame:
    """S-05: rows strictly after `cursor` in `order`, first `limit` of them (the new cursor is the
    max of `order` over the result, see `cursor_of` and `Cursor`)."""
    a, b = order
    ca, cb = cursor
    after = (F.col(a) > F.lit(ca)) | ((F.col(a) == F.lit(ca)) & (F.col(b) > F.lit(cb)))
    return df.where(after).orderBy(a, b).limit(int(limit))


def cursor_of(batch: DataFrame, *, order: Sequence[str] = ("deployed_at", "id")) -> tuple | None:
    """The cursor behind a page: the largest `order` columns of its rows, None for an empty page."""
    last = batch.agg(F.max(F.struct(*order)).alias("cursor")).first()["cursor"]
    return None if last is None else tuple(last)


class Cursor:
    """S-05, I-08: a stored position in a table ordered by two columns, for paging that resumes where it stopped.

    Every commit adds one small file with the position under the next number; a file counts when its folder is complete,
    so a reader sees the old position or the new one, never half of either. A page that was read but not committed is
    read again after a restart; whoever stores pages under `number` (as insert_if_absent or a folder per page does) keeps
    every row once."""

    def __init__(self, spark, path: str, *, order: Sequence[str] = ("deployed_at", "id"), start: tuple = (0, 0)):
        self.spark, self.path, self.order, self.start = spark, path, tuple(order), tuple(start)

    def _load(self) -> tuple[int, tuple]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = fs_path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = []
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith("page=") and fs.exists(fs_path(status.getPath(), "_SUCCESS")):
                    done.append(int(name[5:]))
        if not done:
            return 0, self.start
        row = self.spark.read.json(f"{self.path}/page={max(done)}").first()
        return max(done), tuple(row[f"c{i}"] for i in range(len(self.order)))

    @property
    def number(self) -> int:
        """How many pages are committed; the next page has this number."""
        return self._load()[0]

    def next_page(self, df: DataFrame, *, limit: int = 50) -> DataFrame:
        return read_since(df, self._load()[1], order=self.order, limit=limit)

    def commit(self, page: DataFrame) -> bool:
        """Move behind the rows of this page; False if it is empty (nothing moves)."""
        at = cursor_of(page, order=self.order)
        if at is None:
            return False
        number = self._load()[0] + 1
        row = self.spark.createDataFrame([at], ", ".join(f"c{i} {page.schema[c].dataType.simpleString()}" for i, c in enumerate(self.order)))
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/page={number}")
        return True


def _first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] | None, last: bool) -> DataFrame:
    if not order:  # a fixed choice all the same: by the other columns
        order = [f.name for f in rows.schema if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    if not order:
        return rows.dropDuplicates(list(keys))
    cols = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*cols)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def insert_if_absent(target: DataFrame, rows: DataFrame, *, keys: Sequence[str],
                     order: Sequence[str] | None = None) -> DataFrame:
    """S-06: ON CONFLICT DO NOTHING. New rows whose key exists are dropped (left anti join);
    duplicates inside the batch keep the first in `order`. Returns the new table state."""
    fresh = _first_per_key(rows.select(*target.columns), keys, order, last=False)
    fresh = fresh.join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh)


def upsert_columns(target: DataFrame, rows: DataFrame, *, keys: Sequence[str], update_cols: Sequence[str],
                   order: Sequence[str] | None = None) -> DataFrame:
    """S-07: ON CONFLICT (keys) DO UPDATE SET only `update_cols`; unmatched rows insert whole.
    A full outer join on the key; the last row per key in `order` wins inside the batch."""
    new = _first_per_key(rows.select(*target.columns), keys, order, last=True)
    t = target.withColumn("__old", F.lit(True)).alias("t")
    n = new.withColumn("__new", F.lit(True)).alias("n")
    j = t.join(n, list(keys), "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.when(F.col("t.__old"), F.col(f"t.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return j.select(*out)


def apply_updates(base: DataFrame, updates: DataFrame, *, keys: Sequence[str], seq: str | Sequence[str],
                  allowed: Sequence[str]) -> DataFrame:
    """S-08: fold a partial-update log into a snapshot. Only allow-listed columns apply; a null in the
    log means "not set by this update"; per column the latest non-null write (by `seq`) wins.
    `max_by` aggregates partially on the map side, so the shuffle carries one row per key and task."""
    seq_cols = [seq] if isinstance(seq, str) else list(seq)
    order = F.struct(*seq_cols) if len(seq_cols) > 1 else F.col(seq_cols[0])
    cols = [c for c in allowed if c in updates.columns and c in base.columns]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"__u_{c}") for c in cols]
    last = updates.groupBy(*keys).agg(*aggs)
    j = base.join(last, list(keys), "left")
    return j.select(*[F.coalesce(F.col(f"__u_{c}"), F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in base.columns])


def audit_rows(df: DataFrame, *, incident_col: str, agent: str, event_type: str,
               payload_cols: Sequence[str], created_col: str) -> DataFrame:
    """S-11: audit-log rows (incident_id, agent_name, event_type, payload JSON, created_at)."""
    return df.select(
        F.col(incident_col).alias("incident_id"),
        F.lit(agent).alias("agent_name"),
        F.lit(event_type).alias("event_type"),
        F.to_json(F.struct(*payload_cols)).alias("payload"),
        F.col(created_col).alias("created_at"),
    )


def deployment_rows(events: DataFrame) -> DataFrame:
    """S-13: raw deployment event -> deployments table row, renamed fields with defaults."""
    return events.select(
        F.coalesce(F.col("source_service"), F.lit("")).alias("service_name"),
        F.coalesce(F.col("version"), F.lit("")).alias("version"),
        F.coalesce(F.col("deployed_by"), F.lit("ci-cd-pipeline")).alias("deployed_by"),
        F.coalesce(F.col("change_type"), F.lit("CODE")).alias("change_type"),
        F.coalesce(F.col("git_sha"), F.lit("")).alias("git_sha"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.coalesce(F.col("known_risks"), F.array().cast("array<string>")).alias("known_risks"),
        F.coalesce(F.col("timestamp"), F.lit(0)).cast("long").alias("deployed_at"),
    )
