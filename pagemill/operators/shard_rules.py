"""Strict validation of shards from their JSON text.

A shard is parsed to a VARIANT, so every value keeps the type that the text gives it: ``5`` is an integer,
``5.0``, ``"5"`` and ``true`` are not. Each rule names the place that breaks it (``pages[3].block_count``). All rules are
judged, not only the first one that is broken; rules on parts that aren't there say nothing. A shard is judged
in its own row, without a shuffle.

Not text of a JSON object: null, other JSON, what can't be parsed, and objects that repeat a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ledger import COUNTS, STATUSES, SUMMARY_LIMIT, USAGE_FIELDS

# Names in shards.
KIND = "page-ir-shard"
ARRAYS = ("blocks", "objects", "continuity", "uncertainties")
SNAPSHOTS = ("style_profile_sha256", "document_ir_sha256")


#: What is read of a shard, in one pass: parts of a fixed kind have their type (null where they are of another kind); what must be an integer or
#: a string stays VARIANT. Statuses, kinds and digests are read as text, as no other value's text is one; of arrays whose items don't matter the items are null.
RECORD = ", ".join([f"{f}: variant" for f in ("page", "route", "reason", "next_action", *COUNTS)] + ["status: string"] + [f"{f}: array<map<string, boolean>>" for f in ARRAYS])
SHARD = ", ".join(
    [f"{f}: variant" for f in ("schema_version", "batch_id", "reason", "next_action", "detail_artifact", *SNAPSHOTS)] + [f"{f}: array<variant>" for f in ("owned_pages", "context_pages", "artifacts")]
    + ["kind: string", "status: string", f"pages: array<struct<{RECORD}>>", "source: struct<sha256: string, size_bytes: variant, page_count: variant>", "usage: map<string, variant>",
       "worker_summary: struct<text: variant, owned_page_count: variant, blocked_page_count: variant, uncertain_page_count: variant>"]
)
FINDINGS = "array<struct<rule_id:string,detail:string>>"


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def whole(v: Column) -> Column:
    """The value of an integer; null for anything else, integers beyond 64 bits among it."""
    return F.when(kind_of(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def string(v: Column) -> Column:
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string"))


def absent(v: Column) -> Column:
    """Neither there nor anything but null."""
    return v.isNull() | F.is_variant_null(v)


def filled(text: Column) -> Column:
    """Whether a string has more than white space; what is no string has not."""
    return ~tx.is_blank(text)


def natural(v: Column) -> Column:
    return F.coalesce(whole(v) >= 0, F.lit(False))


def broken(test: Column, rule: Column | str, place: Column | str) -> Column:
    """A finding where the test holds, else null."""
    rule, place = (F.lit(x) if isinstance(x, str) else x for x in (rule, place))
    return F.when(F.coalesce(test, F.lit(False)), F.struct(rule.alias("rule_id"), place.alias("detail")))


def place(name: str, i: Column) -> Column:
    return F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))


def _none() -> Column:
    return F.array().cast(FINDINGS)


def _where(test: Column, found: Column) -> Column:
    """Findings that are only worked out where there are any: functions over items are dear."""
    return F.coalesce(F.when(test, found), _none())


def _known(keys: Column, kind: str) -> Column:
    """The different values of an array without nulls; none of a null array."""
    return F.array_except(F.coalesce(keys, F.array().cast(f"array<{kind}>")), F.array(F.lit(None).cast(kind)))


def _has_null(keys: Column, known: Column) -> Column:
    return F.size(F.array_distinct(keys)) > F.size(known)


def placed(keys: Column, own: Column | None = None) -> Column:
    """An array's values with their places, sorted, so equal ones lie side by side; null where none repeats. ``own`` are those that count, if not all."""
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.array_sort(F.transform(keys if own is None else own, lambda k, i: F.struct(k.alias("key"), i.alias("i")))))


def repeats(sorted_keys: Column, rule: str, at) -> Column:
    """A finding for each value that an earlier one of the array equals; ``at(i)`` is its place. Nulls don't repeat."""
    found = F.transform(sorted_keys, lambda x, j: broken((j > 0) & (F.get(sorted_keys, j - 1)["key"] == x["key"]), rule, at(x["i"])))
    return _where(sorted_keys.isNotNull(), found)


def page_list(items: Column, numbers: Column, known: Column, sorted_pages: Column, name: str) -> list[Column]:
    """Findings on a list of page numbers; ``numbers`` are its items, null where they are none or out of bounds."""
    odd = F.transform(numbers, lambda x, i: broken(x.isNull(), "page-number", place(name, i)))
    return [F.array(broken(items.isNull(), "page-list", name)), _where(_has_null(numbers, known), odd), repeats(sorted_pages, "repeated-page", lambda i: place(name, i))]


def in_bounds(items: Column, last: Column) -> Column:
    """The page numbers of a list; null where they are none, or out of bounds."""
    return F.transform(F.transform(items, whole), lambda x: F.when((x > 0) & (x <= last), x))


def blockers(v: Column, status: Column, at) -> list[Column]:
    """What blocked and omitted work must say."""
    return [
        broken(status.isin("blocked", "omitted-with-reason") & ~filled(string(v["reason"])), "reason", at("reason")),
        broken((status == "blocked") & ~filled(string(v["next_action"])), "next-action", at("next_action")),
    ]


def read_records(records: Column, version: Column) -> Column:
    """What the rules on several records look at of each: its page, and whether it has anything uncertain."""

    def one(r: Column) -> Column:
        uncertain = F.when(version == 2, whole(r["uncertainty_count"]) > 0).otherwise(F.size(r["uncertainties"]) > 0)
        return F.struct(r.isNotNull().alias("object"), whole(r["page"]).alias("page"), F.coalesce(uncertain, F.lit(False)).alias("uncertain"))

    return F.transform(records, one)


def list_findings(records: Column, lost: Column, sorted_pages: Column) -> list[Column]:
    """Findings on the list of page records; ``lost`` are owned pages without one."""
    missing = F.transform(lost, lambda p: broken(F.lit(True), "missing-record", p.cast("string")))
    again = repeats(sorted_pages, "repeated-record", lambda i: F.concat(place("pages", i), F.lit(".page")))
    return [F.array(broken(records.isNull(), "record-list", "pages")), _where(records.isNotNull() & (F.size(lost) > 0), missing), again]


def record_rows(records: Column, read: Column, foreign: Column, found: Column) -> Column:
    """An array with the shard's own findings first and then an item for each record; ``foreign`` are pages of records that aren't owned (mostly none)."""
    nothing = lambda kind: F.lit(None).cast(kind)
    strange = lambda x: (F.size(foreign) > 0) & (x["page"] > 0) & F.array_contains(foreign, x["page"])
    rest = F.zip_with(records, read, lambda r, x: F.struct(r.alias("r"), x["page"].alias("page"), strange(x).alias("strange"), nothing(FINDINGS).alias("found")))
    first = F.array(F.struct(nothing(f"struct<{RECORD}>").alias("r"), nothing("bigint").alias("page"), nothing("boolean").alias("strange"), found.alias("found")))
    return F.concat(first, F.coalesce(rest, F.slice(first, 1, 0)))


def record_findings(item: Column, i: Column, version: Column) -> Column:
    """Findings on one page record."""
    r, name = item["r"], place("pages", i)
    at = lambda f: F.concat(name, F.lit("."), F.lit(f) if isinstance(f, str) else f)
    own = F.array(
        broken(~F.coalesce(item["page"] > 0, F.lit(False)), "record-page", at("page")), broken(item["strange"], "record-not-owned", at("page")), broken(~filled(string(r["route"])), "route", at("route")),
        broken(~F.coalesce(r["status"].isin(*STATUSES), F.lit(False)), "page-status", at("status")), *blockers(r, r["status"], at),
    )
    odd = F.when(version == 2, F.array(*[F.when(~natural(r[f]), f) for f in COUNTS])).when(version == 1, F.array(*[F.when(r[f].isNull(), f) for f in ARRAYS]))
    odd = F.transform(_known(odd, "string"), lambda f: F.struct(F.when(version == 2, "page-count").otherwise("page-array").alias("rule_id"), at(f).alias("detail")))
    return F.when(r.isNull(), F.array(broken(F.lit(True), "record-object", name))).otherwise(F.concat(own, odd))


def summary_findings(whole_shard: Column, summary: Column, records: Column, statuses: Column, version: Column) -> Column:
    """The worker's summary against the records as read, and their statuses."""
    count = lambda values, x: F.when(values.isNull(), 0).otherwise(F.size(values) - F.size(F.array_remove(values, x)))
    counted = {"owned_page_count": count(records["object"], True), "blocked_page_count": count(statuses, "blocked"), "uncertain_page_count": count(records["uncertain"], True)}
    there, text = summary.isNotNull(), string(summary["text"])
    none = F.when(~there, absent(F.try_variant_get(whole_shard, "$.worker_summary", "variant")))
    out = [
        broken((version == 2) & none, "summary-absent", "worker_summary"), broken(~none, "summary-object", "worker_summary"),
        broken(there & ~filled(text), "summary-text", "worker_summary.text"), broken(there & (F.length(text) > SUMMARY_LIMIT), "summary-length", "worker_summary.text"),
    ]
    for f, n in counted.items():
        declared = F.when(there, whole(summary[f]))
        rule = F.when(there & ~F.coalesce(declared >= 0, F.lit(False)), "summary-count").when(there & (declared != n), "summary-mismatch")
        out.append(broken(rule.isNotNull(), rule, f"worker_summary.{f}"))
    return F.array(*out)


def usage_findings(whole_shard: Column, usage: Column) -> list[Column]:
    at = lambda f: F.try_element_at(usage, F.lit(f))
    unknown = F.array_except(F.map_keys(usage), F.array(*[F.lit(f) for f in USAGE_FIELDS]))
    odd = F.transform(unknown, lambda k: broken(F.lit(True), "usage-field", F.concat(F.lit("usage."), k)))
    types = [broken(at(f).isNotNull() & ~natural(at(f)), "usage-count", f"usage.{f}") for f in USAGE_FIELDS]
    more = broken(whole(at("cached_input_tokens")) > whole(at("input_tokens")), "cached-over-input", "usage.cached_input_tokens")
    none = F.when(usage.isNull(), absent(F.try_variant_get(whole_shard, "$.usage", "variant")))
    return [F.array(broken(~none, "usage-object", "usage"), *types, more), _where(F.size(unknown) > 0, odd)]


def _inside(path: Column) -> Column:
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def _plain(path: Column) -> Column:
    """A path without empty and ``.`` steps, as it is listed."""
    return F.array_join(F.array_remove(F.array_remove(F.split(path, "/"), ""), "."), "/")


def artifact_findings(texts: Column, paths: Column, known: Column, sorted_paths: Column, detail: Column, version: Column) -> list[Column]:
    """Paths of artifacts in the project, each once, the detail of compact shards among them; ``texts`` are the items that are strings."""
    odd = F.transform(texts, lambda x, i: F.coalesce(broken(~filled(x), "artifact-text", place("artifacts", i)), broken(~_inside(x), "artifact-outside", place("artifacts", i))))
    rest = F.coalesce(broken(~filled(detail), "detail-text", "detail_artifact"), broken(~_inside(detail), "detail-outside", "detail_artifact"), broken(~F.array_contains(known, _plain(detail)), "detail-not-listed", "detail_artifact"))
    again = repeats(sorted_paths, "repeated-artifact", lambda i: place("artifacts", i))
    return [F.array(broken(texts.isNull(), "artifact-list", "artifacts"), F.when(version == 2, rest)), _where(_has_null(paths, known), odd), again]


def source_findings(source: Column, sha256: Column, size_bytes: Column, page_count: Column) -> Column:
    """The source's identity, and whether it is the expected one."""
    sha, size, pages = source["sha256"], whole(source["size_bytes"]), whole(source["page_count"])
    there = source.isNotNull()
    good = [F.coalesce(tx.is_digest(sha), F.lit(False)), F.coalesce(size > 0, F.lit(False)), F.coalesce(pages > 0, F.lit(False))]
    same = sha.eqNullSafe(sha256) & size.eqNullSafe(size_bytes.cast("bigint")) & pages.eqNullSafe(page_count.cast("bigint"))
    return F.array(
        broken(~there, "source-object", "source"), broken(there & ~good[0], "source-digest", "source.sha256"), broken(there & ~good[1], "source-size", "source.size_bytes"),
        broken(there & ~good[2], "source-pages", "source.page_count"), broken(there & good[0] & good[1] & good[2] & ~same, "source-mismatch", "source"),
    )


def strict_violations(shards: DataFrame, key: str = "shard", text: str = "text", sha256: str = "sha256", size_bytes: str = "size_bytes", page_count: str = "page_count") -> DataFrame:
    """``entity, entity_key, rule_id, detail`` of every broken rule; the detail is its place in the shard.

    Each row of ``shards`` has a shard's JSON text and the identity of the source that it must be of.
    """
    c = F.col
    v, s, version, last = c("__v"), c("__s"), c("__version"), c("__last")
    rows = shards.select(c(key).cast("string").alias("__key"), F.try_parse_json(text).alias("__v"), c(sha256).alias("__sha"), c(size_bytes).alias("__size"), c(page_count).cast("bigint").alias("__last"))
    rows = rows.withColumn("__s", F.try_variant_get(v, "$", f"struct<{SHARD}>"))
    # functions over items are not compiled: they read a few scalars, and look for places only where something is wrong
    rows = rows.select("*", whole(s["schema_version"]).alias("__version"), in_bounds(s["owned_pages"], last).alias("__owned_pages"), in_bounds(s["context_pages"], last).alias("__context_pages"), F.transform(s["artifacts"], string).alias("__texts"))
    rows = rows.select("*", read_records(s["pages"], version).alias("__read"), F.transform("__texts", lambda x: F.when(filled(x) & _inside(x), _plain(x))).alias("__paths"))
    lists = {"__owned_pages": c("__owned_pages"), "__context_pages": c("__context_pages"), "__pages": c("__read")["page"], "__paths": c("__paths")}
    rows = rows.select("*", *[_known(x, "string" if n == "__paths" else "bigint").alias(f"{n}_known") for n, x in lists.items()])
    positive = F.transform(lists["__pages"], lambda p: F.when(p > 0, p))
    rows = rows.select(
        "*", *[placed(x, positive if n == "__pages" else None).alias(f"{n}_at") for n, x in lists.items()], F.array_except("__pages_known", "__owned_pages_known").alias("__foreign"),
        F.array_except("__owned_pages_known", "__pages_known").alias("__lost"),
    )
    status = s["status"]
    head = F.array(
        broken(~F.coalesce(version.isin(1, 2), F.lit(False)), "schema-version", "schema_version"), broken(~F.coalesce(s["kind"] == KIND, F.lit(False)), "kind", "kind"),
        broken(~F.coalesce(tx.is_batch_id(tx.strip(string(s["batch_id"]))), F.lit(False)), "batch-id", "batch_id"), broken(F.size("__owned_pages") == 0, "no-pages", "owned_pages"),
        *[broken(~absent(s[f]) & ~F.coalesce(tx.is_digest(string(s[f])), F.lit(False)), "snapshot-digest", f) for f in SNAPSHOTS],
        broken(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "status", "status"), *blockers(s, status, lambda f: f),
    )
    parts = [head, source_findings(s["source"], c("__sha"), c("__size"), last)]
    for f in ("owned_pages", "context_pages"):
        parts += page_list(s[f], c(f"__{f}"), c(f"__{f}_known"), c(f"__{f}_at"), f)
    parts += list_findings(c("__read"), c("__lost"), c("__pages_at"))
    parts += [summary_findings(v, s["worker_summary"], c("__read"), s["pages"]["status"], version), *usage_findings(v, s["usage"])]
    parts += artifact_findings(c("__texts"), c("__paths"), c("__paths_known"), c("__paths_at"), string(s["detail_artifact"]), version)
    every = F.when(s.isNotNull(), F.concat(*parts)).otherwise(F.array(broken(F.lit(True), "json-object", "")))
    # each record in a row of its own, the shard's own findings in another: rules on records are compiled, too
    found = rows.select("__key", "__version", s["pages"].alias("__records"), "__read", "__foreign", every.alias("__found"))
    found = found.select("__key", "__version", F.posexplode(record_rows(c("__records"), c("__read"), c("__foreign"), c("__found"))).alias("__i", "__item"))
    own = F.when(c("__i") == 0, c("__item")["found"]).otherwise(record_findings(c("__item"), c("__i") - 1, version))
    found = found.select("__key", own.alias("__every"))
    return found.select(F.lit("shard").alias("entity"), c("__key").alias("entity_key"), F.explode("__every").alias("f")).where("f is not null").select("entity", "entity_key", "f.rule_id", "f.detail")


def violations_by_rule(found: DataFrame) -> DataFrame:
    """How many findings and shards a rule has, for a report."""
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_distinct("entity_key").alias("shards"))


#: Every rule, for reports that also name those that nothing breaks.
RULES = (
    "json-object", "schema-version", "kind", "batch-id", "no-pages", "snapshot-digest", "status", "reason", "next-action", "source-object", "source-digest", "source-size", "source-pages", "source-mismatch",
    "page-list", "page-number", "repeated-page", "record-list", "record-object", "record-page", "repeated-record", "record-not-owned", "route", "page-status", "page-count", "page-array", "missing-record",
    "summary-absent", "summary-object", "summary-text", "summary-length", "summary-count", "summary-mismatch", "usage-object", "usage-field", "usage-count", "cached-over-input",
    "artifact-list", "artifact-text", "artifact-outside", "repeated-artifact", "detail-text", "detail-outside", "detail-not-listed",
)


def merge_ready(shards: DataFrame, found: DataFrame, key: str = "shard") -> DataFrame:
    """The shards that break no rule."""
    bad = found.select(F.col("entity_key").alias("__bad")).distinct()
    return shards.join(bad, F.col(key).cast("string") == F.col("__bad"), "left_anti")
