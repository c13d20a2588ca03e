"""Index build: a source tree to a snapshot of tables, every stage a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import resolve, search, vectors
from ..sources import extensions, metadata, modules
from ..sources.snapshot import Store
from ..streaming import incremental


def module_rows(files: DataFrame) -> dict[str, DataFrame]:
    """What single modules hold, calls unresolved: every table is keyed by ``rel_path``."""
    parts = modules.classify_path(F.col("inner_path"))
    mods = files.select("rel_path", "extension", F.octet_length("content").cast("long").alias("size"), *[c.alias(n) for n, c in parts.items()]).withColumn("id", F.xxhash64("rel_path"))
    parsed = modules.parse_all(files)
    methods = parsed["methods"].withColumn("module_id", F.xxhash64("rel_path")).withColumn("method_key", resolve.method_key(F.col("rel_path"), F.col("name"))).withColumn("id", F.xxhash64("rel_path", "name", "line"))
    regions = parsed["regions"].withColumn("module_id", F.xxhash64("rel_path"))
    return {"modules": mods, "methods": methods, "regions": regions, "calls": parsed["calls"]}


def resolved_calls(rows: dict[str, DataFrame]) -> DataFrame:
    mods, methods = rows["modules"], rows["methods"]
    calls = rows["calls"].withColumn("caller_module", F.col("rel_path"))
    common = mods.select(F.col("rel_path").alias("module"), "extension", F.when(F.col("category") == "CommonModules", F.col("object_name")).alias("common_name"))
    resolved = resolve.resolve(calls, methods.select(F.col("rel_path").alias("module"), "name", "is_export"), common)
    resolved = resolved.withColumn("caller_key", resolve.method_key(F.col("rel_path"), F.col("caller")))
    return resolved.drop("caller_module")


def module_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    rows = module_rows(extensions.read_modules(spark, root))
    return rows | {"calls": resolved_calls(rows)}


def metadata_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    parsed = metadata.parse_all(metadata.read_xml(spark, root))
    attributes = parsed["attributes"]
    references = attributes.select(F.col("object_name").alias("source_object"), F.col("category").alias("source_category"), F.explode("attr_types").alias("type"), F.col("attr_name").alias("used_in"), "file")
    references = references.withColumn("ref_object", T.normalize_type(F.col("type"))).where(F.contains("ref_object", F.lit("."))).withColumn("ref_kind", F.lit("attribute_type")).drop("type")
    return {
        "object_attributes": attributes, "role_rights": parsed["rights"], "form_elements": parsed["forms"], "dcs_datasets": parsed["datasets"],
        "event_subscriptions": parsed["handlers"], "metadata_references": references, "predefined_items": parsed["predefined"], "parse_errors": parsed["errors"],
    }


def named_entities(methods: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, kind, name, place, synonym): everything that has a name."""
    none = F.lit(None).cast("string")
    objects = attributes.groupBy("object_name").agg(F.min("category").alias("place"))
    return (
        methods.select("id", F.lit("method").alias("kind"), "name", F.col("rel_path").alias("place"), none.alias("synonym"))
        .unionByName(attributes.select(F.xxhash64("file", "ts_name", "attr_name").alias("id"), F.lit("attribute").alias("kind"), F.col("attr_name").alias("name"), F.col("object_name").alias("place"), F.col("attr_synonym").alias("synonym")))
        .unionByName(objects.select(F.xxhash64(F.lit("object"), "object_name").alias("id"), F.lit("object").alias("kind"), F.col("object_name").alias("name"), "place", none.alias("synonym")))
    )


def semantic_tables(methods: DataFrame, attributes: DataFrame) -> dict[str, DataFrame]:
    """Token weights, and a quantised vector for everything that has a name."""
    named = named_entities(methods, attributes)
    tokens = named.select("id", F.explode(T.tokenize_name(F.concat_ws(" ", "name", "synonym"))).alias("token"))
    idf = search.token_idf(tokens, "id", "token")
    made = vectors.entity_vectors(tokens, "id", "token", idf).withColumnRenamed("entity", "__id")
    return {"semantic_tokens": idf, "semantic_vectors": named.join(made, F.col("id") == F.col("__id")).drop("__id")}


def build(spark: SparkSession, source: str, index: str, commit: str | None = None) -> Store:
    """Read ``source``, write a snapshot under ``index`` and make it current; the build marker keeps others out."""
    store = Store(spark, index)
    with store.building():
        tables = module_tables(spark, source) | metadata_tables(spark, source)
        tables |= semantic_tables(tables["methods"], tables["object_attributes"])
        store.write(tables, {"source_path": source, "git_commit": commit, "incremental": 0})
    return store


def update(spark: SparkSession, source: str, index: str, changed: DataFrame, commit: str | None = None) -> Store:
    """A snapshot in which the rows of the changed modules (``rel_path``) are those of their files now; a file that is gone leaves no rows.

    Only changed files are read and parsed.  All calls are resolved again, since a name that appears or goes changes calls of other
    modules; names, weights and vectors follow the new methods.
    """
    store = Store(spark, index)
    with store.building():
        now = store.current()
        if now is None:
            raise incremental.Refused("there is no snapshot to update")
        keys = changed.select("rel_path").distinct()
        files = extensions.read_modules(spark, source).join(F.broadcast(keys), "rel_path", "left_semi") if keys.limit(10_001).count() <= 10_000 else extensions.read_modules(spark, source).join(keys, "rel_path", "left_semi")
        fresh = module_rows(files)
        old = {t: store.read(t) for t in now["tables"]}
        rows = {t: incremental.upsert(old[t].select(fresh[t].columns), fresh[t], "rel_path", keys) for t in fresh}
        tables = old | rows | {"calls": resolved_calls(rows)}
        tables |= semantic_tables(tables["methods"], tables["object_attributes"])
        store.write(tables, {"source_path": source, "git_commit": commit or now.get("git_commit"), "incremental": now.get("incremental", 0) + 1})
    return store
