"""Scalar expressions (SCL, FLT21): columns in, columns out, no Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IdError
from ..schema import EDGE_RULES, NODE_TYPES, READ_TYPES, RISKS, WRITE_TYPES


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column | str, values: dict[str, object], otherwise: object = None) -> Column:
    """A CASE ladder over a small dict."""
    key = col(key)
    ladder = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(key == next(iter(values)), F.lit(next(iter(values.values())))))
    return ladder.otherwise(F.lit(otherwise)) if otherwise is not None else ladder


# ------------- node ids


def node_id(node_type: Column | str, namespace: Column | str, name: Column | str) -> Column:
    return F.concat_ws(":", col(node_type), col(namespace), col(name))


def id_part(id_: Column | str, k: int) -> Column:
    """Part k (0 type, 1 namespace, 2 name) of ``type:namespace:name``; the name may hold colons."""
    return F.element_at(F.split(col(id_), ":", 3), k + 1)


def valid_segment(c: Column | str) -> Column:
    """Non-empty, without a colon, at most 256 bytes."""
    c = col(c)
    return F.coalesce((F.length(c) > 0) & ~F.contains(c, F.lit(":")) & (F.octet_length(c) <= 256), F.lit(False))


def valid_id(id_: Column | str) -> Column:
    parts = F.split(col(id_), ":", 3)
    return F.coalesce((F.size(parts) == 3) & F.element_at(parts, 1).isin(*NODE_TYPES) & (F.length(F.element_at(parts, 2)) > 0) & (F.length(F.element_at(parts, 3)) > 0), F.lit(False))


def make_id(node_type: str, namespace: str, name: str) -> str:
    """The same check on the driver: raises IdError."""
    if node_type not in NODE_TYPES:
        raise IdError(f"unknown node type {node_type!r}")
    for part in (namespace, name):
        if not part or ":" in part or len(part.encode()) > 256:
            raise IdError(f"malformed segment {part!r}")
    return f"{node_type}:{namespace}:{name}"


# ------------- attributes


def attr(name: str, attributes: Column | str = "attributes") -> Column:
    """An attribute if it is a string, else null (tag-strict)."""
    v = F.element_at(col(attributes), name)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def attr_equals(name: str, value: object, attributes: Column | str = "attributes") -> Column:
    """Tag-strict equality: integer 1 is neither 1.0 nor "1" (FLT8)."""
    v = F.element_at(col(attributes), name)
    tag = F.schema_of_variant(v)
    if value is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    kind = {bool: ("boolean", tag == "BOOLEAN"), int: ("bigint", tag == "BIGINT"), float: ("double", tag.isin("DOUBLE", "FLOAT") | tag.startswith("DECIMAL")), str: ("string", tag == "STRING")}[type(value)]
    return F.coalesce(kind[1] & (F.try_variant_get(v, "$", kind[0]) == F.lit(value)), F.lit(False))


# ------------- staleness


def age_seconds(updated_at: Column | str, as_of: Column) -> Column:
    return as_of.cast("timestamp").cast("double") - col(updated_at).cast("double")


def age_days(updated_at: Column | str, as_of: Column) -> Column:
    """Whole 24-hour periods."""
    return F.floor(age_seconds(updated_at, as_of) / 86400).cast("bigint")


def is_stale(updated_at: Column | str, days: int, as_of: Column) -> Column:
    """Older than ``days``; never when days is 0 (FLT16)."""
    return F.lit(days > 0) & (age_seconds(updated_at, as_of) > days * 86400)


def staleness(updated_at: Column | str, as_of: Column) -> Column:
    """today, yesterday, days, weeks from 7, months from 30 (SCL1)."""
    d = age_days(updated_at, as_of)

    def units(n: Column, one: str, many: str) -> Column:
        return F.when(n == 1, F.lit(f"1 {one} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {many} ago")))

    return F.when(d <= 0, "today").when(d == 1, "yesterday").when(d < 7, units(d, "day", "days")).when(d < 30, units(F.floor(d / 7), "week", "weeks")).otherwise(units(F.floor(d / 30), "month", "months"))


# ------------- relevance and budget


def decay(edge_type: Column | str) -> Column:
    return lookup(edge_type, {t: r[2] for t, r in EDGE_RULES.items()})


def detail_level(score: Column | str) -> Column:
    s = col(score)
    return F.when(s > 0.7, "Full").when(s > 0.4, "Summary").otherwise("Minimal")


def relevance_tag(score: Column | str) -> Column:
    s = col(score)
    return F.when(s > 0.8, "HIGH").when(s > 0.5, "MEDIUM").otherwise("LOW")


def tokens_approx(text: Column | str) -> Column:
    """Tokens where no vocabulary is at hand: a quarter of the characters, rounded up (D12)."""
    return F.ceil(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("bigint")


def node_tokens(score: Column | str, name_tokens: Column, attributes: Column, has_context: Column) -> Column:
    """Estimate by detail level (SCL5)."""
    level = detail_level(score)
    full = 100 + 2 * name_tokens + 15 * attributes + F.when(has_context, 50).otherwise(0)
    return F.when(level == "Full", full).when(level == "Summary", 50 + name_tokens).otherwise(10 + name_tokens).cast("bigint")


EDGE_TOKENS = 30
DOCUMENT_TOKENS = 100


# ------------- display


def sanitize(id_: Column | str, dots: bool = False) -> Column:
    chars = ":-/." if dots else ":-/"
    return F.translate(col(id_), chars, "_" * len(chars))


def escape_label(label: Column | str) -> Column:
    out = F.translate(col(label), "\"[]{}", "'()()")
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def edge_label(edge_type: Column | str) -> Column:
    return lookup(edge_type, {t: r[3] for t, r in EDGE_RULES.items()})


def diagram_label(edge_type: Column | str) -> Column:
    return lookup(edge_type, {t: r[4] for t, r in EDGE_RULES.items()})


def evidence_text(evidence: Column | str, most: int = 3) -> Column:
    """The first few in backticks, then "+N more"; a dash if there are none (SRT6)."""
    e = F.coalesce(col(evidence), F.array().cast("array<string>"))
    shown = F.array_join(F.transform(F.slice(e, 1, most), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    more = F.when(F.size(e) > most, F.concat(F.lit(" +"), (F.size(e) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(e) == 0, "-").otherwise(F.concat(shown, more))


# ------------- access


def access_mode(edge_type: Column | str) -> Column:
    """read, write or owner (SCL14); null for other types."""
    t = col(edge_type)
    return F.when(t.isin(*READ_TYPES), "read").when(t.isin(*WRITE_TYPES), "write").when(t == "OWNS", "owner")


def risk(a_writes: Column, b_writes: Column) -> Column:
    return F.when(a_writes & b_writes, "High").when(a_writes | b_writes, "Medium").otherwise("Low")


def risk_rank(r: Column | str) -> Column:
    return lookup(r, {"High": 3, "Medium": 2, "Low": 1})


def confidence(r: Column | str) -> Column:
    return lookup(r, RISKS)


def coupling_reason(r: Column | str, resource: Column | str) -> Column:
    q = F.concat(F.lit("'"), col(resource), F.lit("'"))
    return (
        F.when(col(r) == "High", F.concat(F.lit("Both services write to shared resource "), q, F.lit(" - potential race conditions")))
        .when(col(r) == "Medium", F.concat(F.lit("Services share resource "), q, F.lit(" (one writes, one reads) - schema changes affect both")))
        .otherwise(F.concat(F.lit("Services share read access to "), q, F.lit(" - changes to data may affect both")))
    )


def risk_from_reason(reason: Column | str) -> Column:
    """The text heuristic kept for compatibility (SCL10): generated High reasons read as Medium."""
    r = F.lower(col(reason))
    return F.when(r.contains("high") | r.contains("multiple writers"), "High").when(r.contains("medium") | r.contains("write"), "Medium").otherwise("Low")


def resource_from_reason(reason: Column | str) -> Column:
    """The word after "shared " or "via ", else a dash (SCL11)."""
    shared, via = F.regexp_extract(col(reason), r"shared ([^ ,)]+)", 1), F.regexp_extract(col(reason), r"via ([^ ,)]+)", 1)
    return F.when(shared != "", shared).when(via != "", via).otherwise("-")


def queue_name(url: Column | str) -> Column:
    return F.element_at(F.split(col(url), "/"), -1)


def owner_repo(text: Column | str) -> Column:
    """struct(owner, repo) of ``owner/repo``, null unless exactly one slash parts two names (SCL24)."""
    parts = F.split(col(text), "/")
    ok = (F.size(parts) == 2) & (F.element_at(parts, 1) != "") & (F.element_at(parts, 2) != "")
    return F.when(ok, F.struct(F.element_at(parts, 1).alias("owner"), F.element_at(parts, 2).alias("repo")))


def glob_to_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if c in r"\.^$+{}()|[]" else c
        i += 1
    return f"^{out}$"
