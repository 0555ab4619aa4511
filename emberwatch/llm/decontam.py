"""Benchmark decontamination by template windows.

Texts become word tokens and are read in two ways. In the template reading numbers, names (mixed-case words, wherever
they stand) and units (after a number, or a currency sign) turn into typed placeholders, and all other words are
lower-cased; a run of name words is one placeholder, and so is a number with its unit, so values of other lengths keep
all positions. In the literal reading every token stands for itself, in lower case.

Windows of `window` consecutive tokens of either reading are hash-joined between documents and benchmark items: the
template finds questions whose numbers, names or units were exchanged, the literal reading verbatim copies whatever their
capitals, also of items that say too little as templates. Matches of one document, item and reading whose diagonals
(document position less item position) lie within DRIFT of each other make an alignment, so words may be inserted or left
out between its windows. Its placeholders must be filled consistently: the same benchmark value always by the same
document value. An item is found when an alignment covers enough of it (a share, or RUN tokens) and its slots agree. An
item of fewer than SHORT tokens says nothing inside a text; it is found where it is the whole document.

Native expressions only. A document is tokenised once. A window can only match where each of its tokens stands in some
benchmark window, so a bit table of fixed size over those tokens (collected: BITS bits) tells where windows are hashed at
all, inside the row, and another one over the benchmark's windows lets only possible matches out of the row; the exact
join and the slot checks see those alone. The tables are literals, and the driver keeps them in every plan and its text,
so they stand there as rarely as can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import barrier, staged, table

WINDOW = 8
LEAST = 5            # tokens of an item that has templates
SHORT = 3            # items of fewer tokens must be the whole document
LITERALS = 5         # plain words a template window of full length needs (in shorter windows all but two)
COVERAGE = 0.5       # share of an item's tokens that an alignment covers ...
RUN = 60             # ... or that many of them
DRIFT = 16           # diagonals of one alignment lie this near to each other
CONSISTENT = 0.75    # share of its slot values that are filled the same everywhere
BITS = 1 << 19
PROBES = 3           # bits per window; 20 * (PROBES - 1) + 19 is below 64
HELD = 1 << 16       # benchmark windows that every task holds; more are joined by a shuffle

#: Units that count as such after a number.
UNITS = ("%", "mm", "cm", "dm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "second", "seconds", "min",
         "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "inch", "inches", "feet", "foot", "yard", "yards", "mile", "miles", "pound", "pounds", "ounce", "ounces",
         "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "meter", "meters",
         "metre", "metres", "liter", "liters", "litre", "litres", "gram", "grams", "kilometer", "kilometers", "hz", "khz",
         "w", "kw", "v", "a", "n", "j", "kj", "pa")

#: Code points of scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han); each letter is a token.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
#: ASCII letters, which the first class has anyway, come first in it as they are the quickest to test.
_TOKEN = f"[a-zA-Z[\\p{{L}}\\p{{M}}&&[^{_UNSPACED}]]]+|[{_UNSPACED}&&[\\p{{L}}\\p{{M}}]]|[0-9]+(?:[.,][0-9]+)*|[%$€£]"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), 0)


def _number(x: Column) -> Column:
    return (x < ":") & (x >= "0")  # words fail the first test


def _plain(kind: Column) -> Column:
    """Whether it is a word: placeholders begin with '#', no word begins with less than a letter."""
    return kind >= "A"


def kinds(raw: Column) -> Column:
    """What every raw token is: '#n', '#u', '#p' or the word in lower case. `raw` must be a plain column."""
    units = F.array(*[F.lit(u) for u in UNITS])
    low = F.lower
    return F.transform(raw, lambda x, i: (
        F.when(x < "A", F.when(_number(x), F.lit("#n")).otherwise(F.lit("#u")))  # digits, % and $
        .when(_number(F.get(raw, i - 1)) & F.array_contains(units, low(x)), F.lit("#u"))  # null before the first
        .when(low(x) == x, F.when(x.isin("€", "£"), F.lit("#u")).otherwise(x))
        .when(F.upper(x) == x, low(x)).otherwise(F.lit("#p"))))


def _starts(raw: Column, kind: Column) -> Column:
    """Positions of the raw tokens that begin a template token: all but further words of a name, a number's unit, and a
    currency's number. Both must be plain columns."""
    def goes_on(i: Column) -> Column:
        k, before = F.get(kind, i), F.get(kind, i - 1)
        return ((k == "#p") & (before == "#p")) | ((k == "#u") & (before == "#n")) | ((k == "#n") & F.get(raw, i - 1).isin("$", "€", "£"))

    return F.filter(F.sequence(F.lit(0), F.size(kind) - 1), lambda i: _plain(F.get(kind, i)) | (i == 0) | ~goes_on(i))


def read(df: DataFrame, keys: list) -> DataFrame:
    """Keys, raw (tokens), kind (of each) and at (where template tokens begin) of every text with a token."""
    # every column reads the one before it several times, so each is computed once per row
    out = barrier(df.select(*keys, "text"), "raw", raw_tokens(F.col("text"))).drop("text").where(F.size("raw") > 0)
    out = barrier(out, "kind", kinds(F.col("raw")))
    return barrier(out, "at", _starts(F.col("raw"), F.col("kind")))


def template_tokens(kind: Column, at: Column, wrap=lambda x: x) -> Column:
    """The template token at every position `at` (a currency with its number counts as the number). `kind` must be a
    plain column."""
    return F.transform(at, lambda i: wrap(F.when((F.get(kind, i) == "#u") & (F.coalesce(F.get(kind, i + 1), F.lit("")) == "#n"), F.lit("#n"))
                                          .otherwise(F.get(kind, i))))


def values(raw: Column, at: Column, first: Column, size: Column) -> Column:
    """What stands at `size` template tokens from number `first` on."""
    begin = lambda j: F.get(at, first + j)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.array_join(
        F.slice(raw, begin(j) + 1, F.coalesce(begin(j + 1), F.size(raw)) - begin(j)), " "))


def template_codes(kind: Column, at: Column) -> Column:
    return template_tokens(kind, at, F.xxhash64)


def literal_codes(raw: Column, kind: Column) -> Column:
    """Hash of every token as it is written, but for its case (a plain token's kind is just that); never that of a template
    token."""
    return F.transform(kind, lambda k, i: F.xxhash64(F.when(_plain(k), k).otherwise(F.lower(F.get(raw, i))), F.lit(1)))


def window_hash(codes: str, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(codes, start + j) for j in range(size)])


def with_windows(df: DataFrame, codes: str, size: int, out: str) -> DataFrame:
    """Adds `out`: the hash of every window of `size` codes."""
    n = F.size(codes) - size + 1
    return barrier(df, out, F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: window_hash(codes, i, size)))
                   .otherwise(F.array().cast("array<bigint>")))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, literal, n_tokens, size, ipos, h, of (its codes), b_raw, b_tok of every window of every item in both readings; an item
    shorter than the window is one window of its own size. Template windows need enough plain words."""
    items = read(benchmark.where(F.col("text").isNotNull()), ["item_id"])
    items = barrier(barrier(items, "codes", template_codes(F.col("kind"), F.col("at"))), "words", literal_codes(F.col("raw"), F.col("kind")))
    items = staged(items.withColumn("tok", template_tokens(F.col("kind"), F.col("at"))), "benchmark-items")
    size_of = lambda c: F.least(F.size(c), F.lit(window))
    sizes = items.select(F.explode(F.array(F.struct(size_of("codes").alias("size"), F.lit(False).alias("literal")),
                                           F.struct(size_of("words").alias("size"), F.lit(True).alias("literal")))).alias("x"))
    used = sorted((r.size, r.literal) for r in sizes.select("x.*").where("size > 0").distinct().collect())  # at most 2 x window
    texts = F.array().cast("array<string>")
    empty = items.where(F.lit(False)).select("item_id", F.lit(False).alias("literal"), F.lit(0).alias("n_tokens"), F.lit(0).alias("size"),
                                             F.lit(0).alias("ipos"), F.lit(0).cast("long").alias("h"), F.array().cast("array<bigint>").alias("of"), texts.alias("b_raw"), texts.alias("b_tok"))
    parts = [empty]
    for size, literal in used:
        source = "words" if literal else "codes"
        n = F.size(source)
        part = with_windows(items.where(n == size if size < window else n >= size), source, size, "hs")
        part = part.select("item_id", F.lit(literal).alias("literal"), n.alias("n_tokens"), F.lit(size).alias("size"), "raw", "at", "tok", source,
                           F.posexplode("hs").alias("ipos", "h")).withColumn("of", F.slice(source, F.col("ipos") + 1, F.col("size")))
        if literal:
            parts.append(part.select("item_id", "literal", "n_tokens", "size", "ipos", "h", "of", texts.alias("b_raw"), texts.alias("b_tok")))
            continue
        part = part.select("item_id", "literal", "n_tokens", "size", "ipos", "h", "of", values(F.col("raw"), F.col("at"), F.col("ipos"), F.col("size")).alias("b_raw"),
                           F.slice("tok", F.col("ipos") + 1, F.col("size")).alias("b_tok"))
        plain = F.size(F.filter("b_tok", lambda t: ~F.startswith(t, F.lit("#"))))
        parts.append(part.where((F.col("n_tokens") >= LEAST) & (plain >= (LITERALS if size >= WINDOW else size - 2))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _bit(h: Column, probe: int) -> Column:
    return F.shiftrightunsigned(h, 20 * probe).bitwiseAND(F.lit(BITS - 1))


def bit_table(hashes: DataFrame, probes: int = PROBES) -> Column:
    """A literal array of BITS // 64 words with `probes` bits set for every h."""
    bits = hashes.select(F.explode(F.array(*[_bit(F.col("h"), p) for p in range(probes)])).alias("bit"))
    words = [0] * (BITS // 64)
    for r in bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v")).collect():  # at most BITS // 64 rows
        words[r.w] = r.v
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def _has(bits: Column, word: Column, at: Column) -> Column:
    return F.getbit(F.get(bits, word.bitwiseAND(F.lit(BITS // 64 - 1)).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def maybe(h: Column, bits: Column) -> Column:
    """Whether the bit table has all bits of h."""
    return F.forall(F.array(*[F.shiftrightunsigned(h, 20 * p) for p in range(PROBES)]), lambda x: _has(bits, F.shiftrightunsigned(x, 6), x))


def places(codes: str, tokens: Column) -> Column:
    """Positions of the codes that the bit table `tokens` may have, ascending. One bit tells: tokens are few, and this is
    asked of every token of every text."""
    return F.when(F.size(codes) > 0, F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: _has(
        tokens, F.shiftrightunsigned(F.get(codes, i), 6), F.get(codes, i)))).otherwise(F.array().cast("array<int>"))


def starts_of(spots: str, size: int) -> Column:
    """Where `size` positions in a row begin. `spots`: a column of ascending positions."""
    return F.filter(F.transform(spots, lambda i, k: F.when(F.get(spots, k + (size - 1)) == i + (size - 1), i)), lambda i: i.isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE,
                 consistent: float = CONSISTENT) -> DataFrame:
    """Benchmark items found in documents.

    Returns one row per document text and item: doc_id, text_crc32 (of the text), item_id, literal (the reading of the
    best alignment: the one that covers the largest share, then the literal one, then the smaller diagonals), n_windows
    (of the item that match on it), covered and item_tokens (tokens of that reading), n_slots (distinct placeholder
    values of the item on it), n_consistent (filled by one value), n_changed (filled by another value than the item's).
    Null and empty texts hold nothing, nor do items without a token; repeated rows are reported once; other columns are
    ignored, whatever their names; texts of any length are read whole; an empty table gives no rows."""
    known = staged(benchmark_windows(benchmark, window), "benchmark-windows")
    used = sorted((r.size, r.literal) for r in known.select("size", "literal").distinct().collect())  # at most 2 x window
    bits, tokens = bit_table(known.select("h")), bit_table(known.select(F.explode("of").alias("h")), 1)
    known = known.drop("of")
    known = F.broadcast(known) if known.count() <= HELD else known  # else the windows found are shuffled with what fills them
    rows = read(docs.where(F.col("text").isNotNull()), ["doc_id", F.crc32("text").alias("text_crc32")])
    if any(not literal for _, literal in used):
        rows = barrier(rows, "codes", template_codes(F.col("kind"), F.col("at")))
    if any(literal for _, literal in used):
        rows = barrier(rows, "words", literal_codes(F.col("raw"), F.col("kind")))

    for source in sorted({"words" if literal else "codes" for _, literal in used}):
        rows = barrier(rows, f"{source}_in", places(source, tokens))
    none = F.array().cast("array<struct<size:int,literal:boolean,pos:int,h:bigint>>")

    def window(source: str, size: int, literal: bool):
        return lambda i: F.struct(F.lit(size).alias("size"), F.lit(literal).alias("literal"), i.alias("pos"), window_hash(source, i, size).alias("h"))

    found = [none]
    for size, literal in used:
        source = "words" if literal else "codes"
        windows = F.transform(starts_of(f"{source}_in", size), window(source, size, literal))
        found.append(F.when(F.size(source) == size, windows).otherwise(none) if size < SHORT else windows)
    # behind a barrier, or the filter that Spark infers for an explode would make all of it a second time
    rows = barrier(rows, "hits", F.filter(F.concat(*found), lambda x: maybe(x["h"], bits)))
    seen = rows.select("doc_id", "text_crc32", "raw", "at", F.explode("hits").alias("x")).select(
        "doc_id", "text_crc32", "x.*", F.when(~F.col("x.literal"), values(F.col("raw"), F.col("at"), F.col("x.pos"), F.col("x.size"))).alias("d_raw"))
    # rows may come more than once, if documents or items do: everything below is a set, a minimum or a maximum of them
    hits = staged(seen.join(known, ["h", "size", "literal"]).withColumn("diag", F.col("pos") - F.col("ipos")), "template-hits")
    # diagonals within DRIFT of each other lie in one band, as every band overlaps the next by half
    band = F.floor(F.col("diag") / DRIFT)
    hits = hits.withColumn("band", F.explode(F.array(band, band + 1)))
    key = ["doc_id", "text_crc32", "item_id", "literal", "band"]
    # covered tokens: each window adds what the next one does not begin with (lists of an item's length)
    spots = F.sort_array(F.collect_set("ipos"))
    lines = (hits.groupBy(*key).agg(spots.alias("at"), F.max("size").alias("size"), F.max("n_tokens").alias("item_tokens"))
             .withColumn("covered", F.aggregate(F.transform("at", lambda p, i: F.least(
                 F.col("size"), F.coalesce(F.get(F.col("at"), i + 1), p + F.col("size")) - p)), F.lit(0), lambda a, x: a + x))
             .select(*key, F.size("at").cast("long").alias("n_windows"), F.col("covered").cast("long"),
                     F.col("item_tokens").cast("long")))
    slots = (hits.where(~F.col("literal"))
             .select(*key, F.explode(F.filter(F.arrays_zip("b_tok", "b_raw", "d_raw"), lambda x: F.startswith(x["b_tok"], F.lit("#")))).alias("s"))
             .groupBy(*[F.col(c) for c in key], F.col("s.b_raw").alias("value"))
             .agg(F.min("s.d_raw").alias("lo"), F.max("s.d_raw").alias("hi"))
             .groupBy(*key).agg(F.count(F.lit(1)).alias("n_slots"), F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("n_consistent"),
                                F.count(F.when((F.col("lo") != F.col("value")) | (F.col("hi") != F.col("value")), 1)).alias("n_changed")))
    same = [lines[c].eqNullSafe(slots[c]) for c in key]
    numbers = ["n_windows", "covered", "item_tokens", "n_slots", "n_consistent", "n_changed"]
    judged = lines.join(slots, same, "left").select(
        *[lines[c] for c in (*key, *numbers[:3])], *[F.coalesce(slots[c], F.lit(0)).cast("long").alias(c) for c in numbers[3:]])
    good = judged.where(((F.col("covered") >= F.col("item_tokens") * coverage) | (F.col("covered") >= RUN))
                        & (F.col("n_consistent") >= F.col("n_slots") * consistent))
    best = F.max(F.struct((F.col("covered") / F.col("item_tokens")).alias("share"), "literal", (-F.col("band")).alias("d"), *numbers)).alias("m")
    return good.groupBy(*key[:3]).agg(best).select(*key[:3], *[F.col(f"m.{c}").alias(c) for c in ("literal", *numbers)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` (all columns) in which no benchmark item is found."""
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("bad_id"), F.col("text_crc32").alias("bad_crc")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.crc32("text").alias("crc"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("crc") == F.col("bad_crc")), "left_anti").select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_crc32")


def _oracle() -> str:
    """The same rules over lists of tokens, windows compared as texts."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    spaced = f"(?:[^\\P{{L}}{_UNSPACED}]|[^\\P{{M}}{_UNSPACED}])+"  # letters and marks of all other scripts
    token = f"{spaced}|[{_UNSPACED}]|[0-9]+(?:[.,][0-9]+)*|[%$€£]"
    sizes = ", ".join(f"({n})" for n in range(1, WINDOW + 1))
    number = lambda x: f"({x} >= '0' AND {x} < ':')"

    def tokens(source: str, key: str) -> str:
        return f"""SELECT {key}, raw, list_transform(raw, lambda x: lower(x)) AS words,
      list_transform(beg, lambda i: CASE WHEN kind[i] = '#u' AND coalesce(kind[i + 1], '') = '#n' THEN '#n' ELSE kind[i] END) AS tok,
      list_transform(beg, lambda i, j: array_to_string(raw[i:coalesce(beg[j + 1], len(raw) + 1) - 1], ' ')) AS val
    FROM (SELECT *, list_filter(range(1, len(raw) + 1), lambda i: NOT coalesce(i > 1 AND ((kind[i] = '#p' AND kind[i - 1] = '#p')
        OR (kind[i] = '#u' AND kind[i - 1] = '#n') OR (kind[i] = '#n' AND raw[i - 1] IN ('$', '€', '£'))), false)) AS beg
      FROM (SELECT *, list_transform(raw, lambda x, i: CASE WHEN {number('x')} THEN '#n' WHEN x IN ('$', '€', '£') THEN '#u'
          WHEN i > 1 AND {number('raw[i - 1]')} AND list_contains([{units}], lower(x)) THEN '#u'
          WHEN lower(x) <> x AND upper(x) <> x THEN '#p' ELSE lower(x) END) AS kind
        FROM (SELECT {key}, regexp_extract_all(text, '{token}') AS raw FROM {source} WHERE text IS NOT NULL)))"""

    def windows(of: str, source: str, key: str, literal: str) -> str:
        vals = f"CAST([] AS VARCHAR[]) AS {of}_raw" if literal == "true" else f"val[p + 1:p + size] AS {of}_raw"
        return f"""SELECT {key}, {literal} AS literal, len(t) AS n_tokens, size, p AS {of}pos, t[p + 1:p + size] AS {of}_tok, {vals}
    FROM (SELECT *, unnest(range(0, len(t) - size + 1)) AS p FROM (SELECT *, {'words' if literal == 'true' else 'tok'} AS t FROM {source}),
      {'sizes WHERE len(t) = size OR (size = ' + str(WINDOW) + ' AND len(t) > size)' if of == 'b' else
       f"(SELECT DISTINCT size FROM bw WHERE literal = {literal}) WHERE len(t) >= size AND (size >= {SHORT} OR len(t) = size)"})"""

    return f"""
WITH numbered AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents WHERE text IS NOT NULL),
d AS ({tokens('numbered', 'k')}),
b AS ({tokens('benchmark', 'item_id')}),
sizes(size) AS (VALUES {sizes}),
bw AS ({windows('b', 'b', 'item_id', 'true')}
  UNION ALL SELECT * FROM ({windows('b', 'b', 'item_id', 'false')})
  WHERE n_tokens >= {LEAST} AND len(list_filter(b_tok, lambda t: NOT starts_with(t, '#'))) >= CASE WHEN size >= {WINDOW} THEN {LITERALS} ELSE size - 2 END),
dw AS ({windows('d', 'd', 'k', 'true')} UNION ALL {windows('d', 'd', 'k', 'false')}),
hits AS (SELECT DISTINCT k, item_id, dw.literal, bw.n_tokens, bw.size, bpos, dpos - bpos AS diag, b_tok, b_raw, d_raw
  FROM dw JOIN bw ON dw.size = bw.size AND dw.literal = bw.literal AND array_to_string(d_tok, ' ') = array_to_string(b_tok, ' ')),
banded AS (SELECT *, floor(diag / {DRIFT}) + unnest([0, 1]) AS band FROM hits),
places AS (SELECT DISTINCT k, item_id, literal, band, n_tokens, size, bpos FROM banded),
spans AS (SELECT *, least(size, coalesce(lead(bpos) OVER (PARTITION BY k, item_id, literal, band ORDER BY bpos) - bpos, size)) AS adds FROM places),
lines AS (SELECT k, item_id, literal, band, count(*) AS n_windows, sum(adds) AS covered, any_value(n_tokens) AS item_tokens FROM spans GROUP BY ALL),
slot AS (SELECT k, item_id, literal, band, b_raw[j] AS value, d_raw[j] AS filled
  FROM (SELECT *, unnest(range(1, size + 1)) AS j FROM banded WHERE NOT literal) WHERE starts_with(b_tok[j], '#')),
by_value AS (SELECT k, item_id, literal, band, value, min(filled) AS lo, max(filled) AS hi FROM slot GROUP BY ALL),
slots AS (SELECT k, item_id, literal, band, count(*) AS n_slots, count(*) FILTER (lo = hi) AS n_consistent,
  count(*) FILTER (lo <> value OR hi <> value) AS n_changed FROM by_value GROUP BY ALL),
judged AS (SELECT l.*, coalesce(n_slots, 0) AS n_slots, coalesce(n_consistent, 0) AS n_consistent, coalesce(n_changed, 0) AS n_changed
  FROM lines l LEFT JOIN slots USING (k, item_id, literal, band)),
best AS (SELECT *, row_number() OVER (PARTITION BY k, item_id ORDER BY covered::DOUBLE / item_tokens DESC, literal DESC, band) AS r FROM judged
  WHERE (covered >= item_tokens * {COVERAGE} OR covered >= {RUN}) AND n_consistent >= n_slots * {CONSISTENT})
SELECT DISTINCT doc_id, item_id, literal, n_windows::BIGINT AS n_windows, covered::BIGINT AS covered, item_tokens::BIGINT AS item_tokens,
  n_slots::BIGINT AS n_slots, n_consistent::BIGINT AS n_consistent, n_changed::BIGINT AS n_changed
FROM best JOIN numbered USING (k) WHERE r = 1
"""


ORACLE = _oracle()
