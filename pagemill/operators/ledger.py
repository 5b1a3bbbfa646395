"""Shards of page records: validation, summaries, and the idempotent merge into a ledger.

Violations are rows ``entity, entity_key, rule_id, detail``; a merge that has any adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# The statuses that a page record may have, and the limit of a worker's summary.
STATUSES = ("pending", "in-progress", "rebuilt", "blocked", "omitted-with-reason")
SUMMARY_LIMIT = 1200
USAGE_FIELDS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens", "duration_ms", "retry_count")
COUNTS = ("block_count", "object_count", "continuity_count", "uncertainty_count")


def violations(df: DataFrame, entity: str, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows for each rule (its test is true where it is broken, with what to say)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("rule_id"), detail.cast("string").alias("detail"))) for name, (test, detail) in rules.items()]))
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("entity_key"), F.explode(found).alias("v")).select("entity", "entity_key", "v.rule_id", "v.detail")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ownership_conflicts(owned: DataFrame, batch: str = "batch_id", page: str = "page") -> DataFrame:
    """Pages that several batches own: how many, and the first and last of them."""
    found = owned.groupBy(page).agg(F.count_distinct(batch).alias("batches"), F.min(batch).alias("first_batch"), F.max(batch).alias("last_batch"))
    return found.where("batches > 1")


def missing_records(owned: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Owned pages without a record."""
    return owned.select(*on).join(records.select(*on), on, "left_anti")


def unexpected_records(owned: DataFrame, records: DataFrame, on: list[str]) -> DataFrame:
    """Records of pages that aren't owned."""
    return missing_records(records, owned, on)


def reconcile(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What only one side has, with ``problem`` missing or extra."""
    a, b = expected.select(*on).distinct().withColumn("__a", F.lit(1)), present.select(*on).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, on, "full_outer").where("__a is null or __b is null")
    return both.select(*on, F.when(F.col("__a").isNull(), "extra").otherwise("missing").alias("problem"))


def identity_mismatches(seen: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows whose identity differs from the expected one (nulls are values), with the fields that differ."""
    both = seen.alias("s").join(expected.alias("e"), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"s.{f}").eqNullSafe(F.col(f"e.{f}")), F.lit(f)) for f in fields]))
    return both.select(key, F.array_join(differ, ",").alias("fields")).where("fields <> ''")


def snapshot_consistency(digests: DataFrame, keys: list[str], digest: str, order: str) -> DataFrame:
    """For each key the number of different digests (nulls aside), the first one by ``order``, and whether they agree."""
    out = digests.groupBy(*keys).agg(F.count_distinct(digest).alias("digests"), F.min_by(digest, F.when(F.col(digest).isNotNull(), F.col(order))).alias("adopted"))
    return out.withColumn("consistent", F.col("digests") <= 1)


def shard_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status (zero where none), sums of counts, uncertain pages, and whether a review is due."""
    status = [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES]
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    out = records.groupBy(*keys).agg(F.count("*").alias("owned_page_count"), *status, *sums, F.count_if(F.col("uncertainty_count") > 0).alias("uncertain_page_count"))
    return out.withColumn("review_required", (F.col("blocked") > 0) | (F.col("uncertain_page_count") > 0))


def normalise_records(shards: DataFrame) -> DataFrame:
    """Page records of both shard versions: version 1 has arrays, version 2 has counts.

    ``shards`` has ``schema_version, batch_id, pages`` with the fields of both; see ``sources.files.SHARD``.
    """
    page = shards.select("batch_id", "schema_version", F.explode("pages").alias("p"))
    compact = F.col("schema_version") == 2
    arrays = {"block_count": "blocks", "object_count": "objects", "continuity_count": "continuity", "uncertainty_count": "uncertainties"}
    counts = [F.when(compact, F.col(f"p.{c}")).otherwise(F.size(f"p.{a}")).cast("long").alias(c) for c, a in arrays.items()]
    return page.select("batch_id", "schema_version", "p.page", "p.route", "p.status", "p.reason", "p.next_action", *counts)


def shard_violations(shards: DataFrame, page_count: int) -> DataFrame:
    """Every broken rule of shards read with ``sources.files.read_shards``."""
    blocked, omitted = F.col("status") == "blocked", F.col("status") == "omitted-with-reason"
    compact = F.col("schema_version") == 2
    pages, context = F.coalesce("owned_pages", F.array().cast("array<int>")), F.coalesce("context_pages", F.array().cast("array<int>"))
    usage_keys = F.coalesce(F.json_object_keys("usage_json"), F.array().cast("array<string>"))
    allowed = F.array(*map(F.lit, USAGE_FIELDS))
    beyond = F.filter(F.concat(pages, context), lambda p: p.isNull() | (p < 1) | (p > page_count))
    rules = {
        "corrupt-record": (F.col("_corrupt_record").isNotNull(), F.col("_corrupt_record")),
        "schema-version": (~F.coalesce(F.col("schema_version").isin(1, 2), F.lit(False)), F.col("schema_version")),
        "batch-id": (~F.coalesce(tx.is_batch_id(F.col("batch_id")), F.lit(False)), F.col("batch_id")),
        "source-digest": (~F.coalesce(tx.is_digest(F.col("source.sha256")), F.lit(False)), F.col("source.sha256")),
        "status": (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("status")),
        "blocker-fields": (blocked & (~tx.is_concrete(F.col("reason")) | ~tx.is_concrete(F.col("next_action"))), F.col("status")),
        "omission-reason": (omitted & ~tx.is_concrete(F.col("reason")), F.col("status")),
        "no-pages": (F.size(pages) == 0, F.lit("")),
        "page-bounds": (F.size(beyond) > 0, F.array_join(F.transform(beyond, lambda p: p.cast("string")), ",")),
        "repeated-page": (F.size(F.array_distinct(pages)) < F.size(pages), F.lit("")),
        "owned-in-context": (F.arrays_overlap(pages, context), F.lit("")),
        "repeated-artifact": (F.size(F.array_distinct("artifacts")) < F.size("artifacts"), F.lit("")),
        "artifact-path": (F.exists("artifacts", lambda a: a.startswith("/") | F.array_contains(F.split(a, "/"), "..")), F.lit("")),
        "snapshot-digest": (~F.coalesce(tx.is_digest(F.col("style_profile_sha256")), F.lit(True)) | ~F.coalesce(tx.is_digest(F.col("document_ir_sha256")), F.lit(True)), F.lit("")),
        "detail-artifact": (compact & ~F.coalesce(F.array_contains("artifacts", F.col("detail_artifact")), F.lit(False)), F.col("detail_artifact")),
        "summary-length": (F.length("worker_summary.text") > SUMMARY_LIMIT, F.length("worker_summary.text")),
        "usage-fields": (F.size(F.array_except(usage_keys, allowed)) > 0, F.array_join(F.sort_array(F.array_except(usage_keys, allowed)), ", ")),
        "usage-type": (F.col("usage_json").isNotNull() & reduce(lambda a, b: a | b, [F.array_contains(usage_keys, f) & (F.col(f"usage.{f}").isNull() | (F.col(f"usage.{f}") < 0)) for f in USAGE_FIELDS]), F.lit("")),
        "cached-over-input": (F.col("usage.cached_input_tokens") > F.col("usage.input_tokens"), F.lit("")),
    }
    own = violations(shards, "shard", F.col("batch_id"), rules)
    records = normalise_records(shards)
    owned = shards.select("batch_id", F.explode("owned_pages").alias("page"))

    def rows(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit("page").alias("entity"), F.col("batch_id").cast("string").alias("entity_key"), F.lit(rule).alias("rule_id"), F.col("page").cast("string").alias("detail"))

    per_page = violations(records, "page", F.concat_ws("/", "batch_id", F.col("page").cast("string")), {
        "status": (~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.col("status")),
        "route": (tx.is_blank(F.col("route")), F.col("route")),
        "blocker-fields": ((F.col("status") == "blocked") & (~tx.is_concrete(F.col("reason")) | ~tx.is_concrete(F.col("next_action"))), F.col("status")),
        "count-type": (reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.col(c) < 0) for c in COUNTS]), F.lit("")),
    })
    on = ["batch_id", "page"]
    parts = [own, per_page, rows(missing_records(owned, records, on), "missing-page-record"), rows(unexpected_records(owned, records, on), "unexpected-page-record"), rows(duplicate_keys(records, on), "repeated-page-record")]
    declared = shards.where("worker_summary is not null").select("batch_id", "worker_summary").join(shard_summary(records, ["batch_id"]), "batch_id")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"worker_summary.{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in ("owned_page_count", "blocked_page_count", "uncertain_page_count")]))
    declared = declared.withColumnRenamed("blocked", "blocked_page_count").withColumn("f", F.array_join(wrong, ",")).where("f <> ''")
    parts.append(declared.select(F.lit("shard").alias("entity"), F.col("batch_id").cast("string").alias("entity_key"), F.lit("summary-mismatch").alias("rule_id"), F.col("f").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def match_ledger(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """New batches with ``action``: add, skip (the ledger has the same content) or conflict (it has another).

    The content is the shard's digest and, where both tables have them, the list of ``artifacts``.
    """
    fields = ["shard_sha256", *(["artifacts"] if "artifacts" in new.columns and "artifacts" in ledger.columns else [])]
    old = ledger.select("batch_id", F.struct(*fields).alias("__old"), F.lit(True).alias("__there"))
    both = new.join(old, "batch_id", "left")
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"__old.{f}")) for f in fields])
    return both.withColumn("action", F.when(F.col("__there").isNull(), "add").when(same, "skip").otherwise("conflict")).drop("__old", "__there")


def merge_violations(new: DataFrame, ledger: DataFrame, touched: bool = False) -> DataFrame:
    """What forbids a merge of ``new`` (batch_id, shard_sha256, owned_pages) into ``ledger``.

    Where both tables have them, all batches must also agree in the source's identity (``source_sha256``, null is a
    value) and in each snapshot (``style_profile_sha256, document_ir_sha256``, nulls aside). With ``touched``, only pages that new
    batches own are looked at in the ledger: faults that it already has aren't told again.
    """
    matched = match_ledger(new, ledger)
    conflict = matched.where("action = 'conflict'").select(F.lit("batch").alias("entity"), F.col("batch_id").cast("string").alias("entity_key"), F.lit("content-conflict").alias("rule_id"), F.lit("").alias("detail"))
    repeated = duplicate_keys(new, ["batch_id"]).select(F.lit("batch").alias("entity"), F.col("batch_id").cast("string").alias("entity_key"), F.lit("repeated-batch").alias("rule_id"), F.col("n").cast("string").alias("detail"))
    own = matched.where("action = 'add'").select("batch_id", F.explode("owned_pages").alias("page"))
    before = ledger.select("batch_id", F.explode("owned_pages").alias("page"))
    owned = (before.join(own.select("page"), "page", "left_semi").select("batch_id", "page") if touched else before).unionByName(own)
    # two batches are one of least and one of greatest number: nothing is kept for each batch of a page, as it would be to count them
    twice = owned.groupBy("page").agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch")).where("first_batch < last_batch")
    twice = twice.select(F.lit("page").alias("entity"), F.col("page").cast("string").alias("entity_key"), F.lit("owned-twice").alias("rule_id"), F.concat_ws(",", F.col("first_batch").cast("string"), F.col("last_batch").cast("string")).alias("detail"))
    parts = [conflict, repeated, twice]
    every = [f for f in ("source_sha256", "style_profile_sha256", "document_ir_sha256") if f in new.columns and f in ledger.columns]
    for field in every:
        rows = ledger.select(field).unionByName(new.select(field))
        value = F.coalesce(field, F.lit("none")) if field == "source_sha256" else F.col(field)
        unlike = rows.agg(F.min(value).alias("first"), F.max(value).alias("last")).where("first < last")
        parts.append(unlike.select(F.lit("ledger").alias("entity"), F.lit(field).alias("entity_key"), F.lit("identity-conflict" if field == "source_sha256" else "snapshot-conflict").alias("rule_id"), F.concat_ws(",", "first", "last").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def ledger_additions(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """The batches to append."""
    return match_ledger(new, ledger).where("action = 'add'").drop("action")


def upsert(kept: DataFrame, changed: DataFrame, keys: list[str], inherit: list[str] = ()) -> DataFrame:
    """Rows of ``changed`` in place of those with the same key; columns in ``inherit`` fall back to the old value where null."""
    old, new = kept.alias("o"), changed.withColumn("__new", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    cols = []
    for c in kept.columns:
        new_value = F.coalesce(f"n.{c}", f"o.{c}") if c in inherit or c in keys else F.col(f"n.{c}")
        cols.append(F.when(F.col("n.__new"), new_value).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, on, "full_outer").select(*cols)


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a grouped maximum: no task gathers a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    value = F.struct(*rest)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("__v")).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in rest])


def rebind_paths(records: DataFrame, moved: DataFrame, key: list[str]) -> DataFrame:
    """Records with the new path of a source whose content is the same."""
    return records.join(moved.select(*key, F.col("path").alias("__path")), key, "left").withColumn("path", F.coalesce("__path", "path")).drop("__path")


def uniform_or(df: DataFrame, keys: list[str], column: str, mixed: Column) -> DataFrame:
    """The value that all rows of a key share, or ``mixed``."""
    out = df.groupBy(*keys).agg(F.count_distinct(column).alias("__n"), F.min(column).alias(column))
    return out.select(*keys, F.when(F.col("__n") == 1, F.col(column)).otherwise(mixed).alias(column))


def evidence_map(pages: DataFrame, keys: list[str]) -> DataFrame:
    """A map from page to record for each key, as manifests have it."""
    rest = [c for c in pages.columns if c not in (*keys, "page")]
    return pages.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("page").cast("string").alias("key"), F.struct(*rest).alias("value"))))).alias("page_records"))


def ledger_row(batches: DataFrame) -> DataFrame:
    """Ledger rows as JSON; fields without a value are left out."""
    return batches.select("batch_id", F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("record"))


def artifact_digests(shards: DataFrame, files: DataFrame) -> DataFrame:
    """``batch_id, position, path, sha256`` of shards' artifacts, from a listing ``path, sha256``; a missing file has no digest."""
    named = shards.select("batch_id", F.posexplode("artifacts").alias("position", "path"))
    return named.join(files.select("path", "sha256"), "path", "left").select("batch_id", "position", "path", "sha256")


def missing_artifacts(shards: DataFrame, files: DataFrame) -> DataFrame:
    return artifact_digests(shards, files).where("sha256 is null").select(F.lit("shard").alias("entity"), F.col("batch_id").cast("string").alias("entity_key"), F.lit("missing-artifact").alias("rule_id"), F.col("path").alias("detail"))


def same_artifacts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Whether batches list the same artifacts with the same digests in the same order; one without any on a side differs."""
    lists = [x.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("position", "path", "sha256"))).alias(n)) for x, n in ((new, "a"), (old, "b"))]
    return lists[0].join(lists[1], "batch_id", "full_outer").select("batch_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def output_conflicts(selected: DataFrame, present: DataFrame, on: list[str], force: bool = False) -> DataFrame:
    """Selected pages whose outputs are there already; none if they are to be replaced."""
    found = selected.join(present.select(*on), on, "left_semi")
    return found.limit(0) if force else found


def invalidate(records: DataFrame, identities: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records of sources whose identity is still the same; those of changed sources go, in every table alike."""
    changed = identity_mismatches(records.select(key, *fields).distinct(), identities, key, fields).select(key)
    return records.join(changed, key, "left_anti")


def only_candidate(candidates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The candidate of each key, where there is exactly one."""
    found = candidates.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(column).alias(column))
    return found.where("__n = 1").drop("__n")


def folder_order(paths: DataFrame, deepest_first: bool = False) -> DataFrame:
    """Paths by depth, then by name."""
    depth = F.size(F.split("path", "/"))
    return paths.orderBy(depth.desc() if deepest_first else depth, "path")


def listed(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Different values of a key in order, joined for a message."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(column)), ", ").alias(column))
