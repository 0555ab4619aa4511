"""Sharding by a hierarchical weighted hash tree.

A topology lists its shards with region, rack and weight. A key descends region -> rack -> shard; at each level
every child makes a weighted hash draw ``ln(u(key, child)) / weight`` and the largest draw wins. A node's weight is
the sum of its shards' weights, so a changed weight alters only the draws of that node and its ancestors: keys move
into subtrees that gained weight or out of subtrees that lost it, and no others.

Everything is an expression over the key column (no shuffle); only the slot numbers need one, over narrow rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import hash_bucket, hex_fraction, numbered, table

SLOT_BUCKETS = 4096


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float


BASE = 8             # shards that form the tree of racks and regions; every later one is a region of its own
ATTEMPTS = 64        # draws in the tree for fewer shards than it has


def topology(shards: int, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """Equal-weight shards: the first BASE of them `per_rack` to a rack and `racks` to a region; every later one stands
    in a region of its own, so that one more shard moves keys only into itself."""
    return [Shard(s // (per_rack * racks), s // per_rack, s, 1.0) if s < BASE else Shard(1_000_000 + s, 1_000_000 + s, s, 1.0)
            for s in range(shards)]


def _winner(key: Column, kind: str, children: Column) -> Column:
    """The child of the largest weighted draw; equal draws go to the larger node number."""
    def draw(child):
        u = hex_fraction(F.concat(key, F.lit(f"|{kind}|"), child["node"].cast("string")))
        return F.struct((F.log(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_max(F.transform(children, draw))["node"]


def _children(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight"))
                     for n, w in sorted(weights.items())])


def place(key: Column, shards: list[Shard]) -> Column:
    """Shard number of a string key (null keys share one marker key). Weights must be positive."""
    if not shards or any(s.weight <= 0 for s in shards):
        raise ValueError("a topology needs shards of positive weight")
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for s in shards:
        regions[s.region] = regions.get(s.region, 0.0) + s.weight
        inner = racks.setdefault(s.region, {})
        inner[s.rack] = inner.get(s.rack, 0.0) + s.weight
        leaves.setdefault(s.rack, {})[s.shard] = s.weight

    def table_of(groups):
        return F.create_map(*[c for n, w in sorted(groups.items()) for c in (F.lit(n), _children(w))])

    key = F.coalesce(key, F.lit("\\N"))
    region = _winner(key, "region", _children(regions))
    rack = _winner(key, "rack", F.element_at(table_of(racks), region))
    return _winner(key, "shard", F.element_at(table_of(leaves), rack))


def place_among(key: Column, shards: int) -> Column:
    """Shard of a key among `shards` equal shards, decided by the key and that count alone. From `shards` to one more,
    for any count, keys move only into the new shard: below BASE a key takes the first of its draws in the whole tree
    that names a shard there is (or, after ATTEMPTS misses, the best of a flat draw)."""
    if shards >= BASE:
        return place(key, topology(shards))
    key = F.coalesce(key, F.lit("\\N"))
    again = F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS - 1)), lambda t: place(F.concat(key, F.lit("|"), t.cast("string")), topology(BASE)))
    drawn = F.concat(F.array(place(key, topology(BASE))), again)
    return F.coalesce(F.get(F.filter(drawn, lambda s: s < shards), F.lit(0)), _winner(key, "flat", _children({s: 1.0 for s in range(shards)})))


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None,
                    slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Place every document.

    Returns doc_id, size (UTF-8 bytes of the text + 1), text_crc32, law ('key'), shard, slot (gapless from 0 within
    the shard), grown_shard (its shard under `grown`, else null). Null text counts as no bytes (size 1, crc 0); rows
    with a null doc_id all take the marker key's shard; repeated rows each get a slot of their own; other columns
    are ignored; an empty table gives no rows."""
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, shards).cast("int").alias("shard"),
        (place(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    # by id and text, so neither rows without an id nor many rows of one id share a bucket
    bucket = hash_bucket(F.concat(F.lit("slot|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), F.lit("|"),
                                  F.col("text_crc32").cast("string")), slot_buckets)
    out = numbered(rows, ["shard"], bucket, ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), topology(8), topology(9))


def _sql_pick(kind: str, nodes: list[tuple[int, float]]) -> str:
    draws = ", ".join(
        "{'draw': ln((('0x' || substr(md5(k || '|%s|%d'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / %s,"
        " 'node': %d}" % (kind, n, float(w), n) for n, w in sorted(nodes))
    return f"list_max([{draws}]).node"


def _sql_place(shards: list[Shard]) -> str:
    def total(rows, field):
        out: dict[int, float] = {}
        for s in rows:
            out[getattr(s, field)] = out.get(getattr(s, field), 0.0) + s.weight
        return list(out.items())

    arms = []
    for region, _ in sorted(total(shards, "region")):
        own = [s for s in shards if s.region == region]
        inner = " ".join(f"WHEN {rack} THEN {_sql_pick('shard', total([s for s in own if s.rack == rack], 'shard'))}"
                         for rack, _ in sorted(total(own, "rack")))
        arms.append(f"WHEN {region} THEN (CASE {_sql_pick('rack', total(own, 'rack'))} {inner} END)")
    return f"(CASE {_sql_pick('region', total(shards, 'region'))} {' '.join(arms)} END)"


#: The checksum table is made by its rule; the fold runs over the bytes of each text.
ORACLE = f"""
WITH bits AS (SELECT i AS byte, list_reduce(list_prepend(i::BIGINT, range(8)),
         lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
       FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY byte) AS tab FROM bits),
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '\\N') AS k FROM documents),
bytes AS (SELECT *, hex(encode(text)) AS h FROM d),
sums AS (SELECT doc_id, k, strlen(text) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc),
placed AS (SELECT *, {_sql_place(topology(8))} AS shard, {_sql_place(topology(9))} AS grown_shard,
  ('0x' || substr(md5('slot|' || k || '|' || text_crc32::VARCHAR), 1, 7))::BIGINT % {SLOT_BUCKETS} AS b FROM sums)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY b, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard::INT AS grown_shard
FROM placed
"""
