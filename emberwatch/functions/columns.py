"""Column-level functions. All are built-in Spark expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch import constants as K

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_ms(col: str | Column) -> Column:
    """Epoch milliseconds of a timestamp without zone (the test tables), independent of the session zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH_NTZ), c)


def ntz_from_ms(col: str | Column) -> Column:
    """Epoch ms back to a zone-less timestamp (UTC wall clock)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_add("MILLISECOND", c, F.expr(_EPOCH_NTZ))


def detect_level(line: str | Column) -> Column:
    """I-01: log level from free text; FATAL/PANIC, then ERROR/EXCEPTION/STACKTRACE, then WARN, else INFO."""
    u = F.upper(F.col(line) if isinstance(line, str) else line)
    return (
        F.when(u.contains("FATAL") | u.contains("PANIC"), "FATAL")
        .when(u.contains("ERROR") | u.contains("EXCEPTION") | u.contains("STACKTRACE"), "ERROR")
        .when(u.contains("WARN"), "WARN")
        .otherwise("INFO")
    )


def service_label(labels: str | Column) -> Column:
    """I-03: service <- labels.service, else app, else job, else 'unknown'."""
    m = F.col(labels) if isinstance(labels, str) else labels
    return F.coalesce(m.getItem("service"), m.getItem("app"), m.getItem("job"), F.lit("unknown"))


def anomaly_score(z: str | Column) -> Column:
    """D-08: min(1, z / 10)."""
    c = F.col(z) if isinstance(z, str) else z
    return F.least(F.lit(1.0), c / F.lit(10.0))


def tokens(text: str | Column) -> Column:
    """R-10: token estimate, characters div 4."""
    c = F.col(text) if isinstance(text, str) else text
    return F.floor(F.length(c) / F.lit(K.CHARS_PER_TOKEN)).cast("long")


def band(conf: str | Column) -> Column:
    """F-03: confidence band, >= .80 HIGH, .50-.79 MEDIUM, < .50 LOW."""
    c = F.col(conf) if isinstance(conf, str) else conf
    return F.when(c >= 0.80, "HIGH").when(c >= 0.50, "MEDIUM").otherwise("LOW")


def time_label(ms: str | Column) -> Column:
    """N-06: epoch ms -> 'yyyy-MM-dd HH:mm:ss UTC'; 0 or null -> 'N/A'. Session-zone independent."""
    c = F.col(ms) if isinstance(ms, str) else ms
    text = F.concat(F.date_format(ntz_from_ms(c), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return F.when(c.isNull() | (c == 0), F.lit("N/A")).otherwise(text)


def doc_hash(text: str | Column) -> Column:
    """K-04: first 16 hex characters of SHA-256 of the UTF-8 text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(F.sha2(c, 256), 1, 16)


def point_id(name: str | Column) -> Column:
    """K-05: RFC 4122 UUID version 5 of `name` in the DNS namespace, as canonical text."""
    c = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(K.NAMESPACE_DNS_HEX)), F.encode(c, "UTF-8")))
    # version nibble 5 in char 13; variant bits 10xx in char 17
    variant = F.lower(F.conv(
        (F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def iso_epoch(text: str | Column) -> Column:
    """K-10: ISO-8601 text -> epoch seconds (double); bad or missing -> 0."""
    c = F.col(text) if isinstance(text, str) else text
    ts = F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))
    return F.coalesce(F.unix_micros(ts) / F.lit(1e6), F.lit(0.0))


def fill(template: str, ctx: dict[str, Column]) -> Column:
    """N-02: the template with every `{{key}}` replaced by the context column's text (a missing value reads None). A
    placeholder without a context column stays as it is; what is filled in is not searched for placeholders again."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    cells = [F.lit(p) if i % 2 == 0 else F.coalesce(ctx[p].cast("string"), F.lit("None")) if p in ctx else F.lit("{{" + p + "}}")
             for i, p in enumerate(parts)]
    return F.concat(*cells)


def exec_summary(markdown: str | Column) -> Column:
    """N-03: non-empty lines after '## Executive Summary' up to the next '##' line, stripped and space-joined."""
    c = F.col(markdown) if isinstance(markdown, str) else markdown
    lines = F.split(c, "\n")
    start = F.array_position(F.transform(lines, lambda l: l.startswith("## Executive Summary")), True)
    after = F.when(start > 0, F.slice(lines, start.cast("int") + 1, F.size(lines))).otherwise(F.array())
    stop = F.array_position(F.transform(after, lambda l: l.startswith("##")), True)
    body = F.when(stop > 0, F.slice(after, 1, stop.cast("int") - 1)).otherwise(after)
    from emberwatch.operators.knowledge import pystrip

    kept = F.filter(F.transform(body, lambda l: pystrip(l)), lambda l: l != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, " "), F.lit(" "))).otherwise(F.lit(""))
