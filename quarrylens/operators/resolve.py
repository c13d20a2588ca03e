"""Resolution of call names: a cascade of left joins on lower-cased keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("local", "common_module", "object_manager", "platform_var", "platform_global", "unknown")
UNRESOLVABLE = ("platform_var", "platform_global")
#: Collections of managers at the head of a call (fixed values).
MANAGER_ROOTS = (
    "справочники", "документы", "регистрысведений", "регистрынакопления", "регистрыбухгалтерии", "регистрырасчета", "обработки", "отчеты", "планывидовхарактеристик",
    "планысчетов", "планывидоврасчета", "перечисления", "бизнеспроцессы", "задачи", "планыобмена", "константы", "последовательности", "журналыдокументов",
)


def method_key(module, name):
    return F.concat(module, F.lit("::"), F.lower(name))


def resolve(calls: DataFrame, methods: DataFrame, modules: DataFrame, manager_roots: tuple[str, ...] = MANAGER_ROOTS) -> DataFrame:
    """``calls`` (caller_module, callee_name, ...) with resolution, callee_key and confidence.

    ``methods``: (module, name, is_export); ``modules``: (module, common_name: null unless a common module) and, where there
    are extensions, ``extension`` (null for the base).  A name belongs to the base's module if it has one, else to the first of the extensions'.
    Undotted names: own module, else a name defined nowhere is the platform's, else unknown.  Dotted: a common
    module's name before the dot, else a manager root, else a variable of the platform.
    """
    parts = calls.withColumn("__dot", F.instr("callee_name", ".")).withColumn("__head", F.lower(F.substring_index("callee_name", ".", 1))).withColumn("__tail", F.lower(F.element_at(F.split("callee_name", r"\."), -1)))
    own = methods.select(F.col("module").alias("__om"), F.lower("name").alias("__on")).distinct().withColumn("__own", F.lit(True))
    anywhere = methods.select(F.lower("name").alias("__an")).distinct().withColumn("__any", F.lit(True))
    extends = F.col("extension").isNotNull() if "extension" in modules.columns else F.lit(False)
    common = modules.where("common_name IS NOT NULL").select(F.lower("common_name").alias("__cn"), F.struct(extends.alias("e"), "module").alias("m")).groupBy("__cn").agg(F.min("m")["module"].alias("__cm"))
    exported = methods.groupBy(F.col("module").alias("__em"), F.lower("name").alias("__en")).agg(F.max("is_export").alias("__ex"))
    joined = (
        parts.join(own, (F.col("caller_module") == F.col("__om")) & (F.col("__tail") == F.col("__on")), "left")
        .join(anywhere, F.col("__tail") == F.col("__an"), "left")
        .join(common, F.col("__head") == F.col("__cn"), "left")
        .join(exported, (F.col("__cm") == F.col("__em")) & (F.col("__tail") == F.col("__en")), "left")
    )
    plain = F.col("__dot") == 0
    found = F.when(plain & F.col("__own"), "local").when(plain & F.col("__any").isNull(), "platform_global").when(plain, "unknown")
    found = found.when(F.col("__cm").isNotNull(), "common_module").when(F.col("__head").isin(*manager_roots), "object_manager").otherwise("platform_var")
    key = F.when(plain & F.col("__own"), method_key(F.col("caller_module"), F.col("__tail"))).when(~plain & F.col("__ex").isNotNull(), method_key(F.col("__cm"), F.col("__tail")))
    confidence = F.when(plain & F.col("__own"), 1.0).when(~plain & (F.col("__ex") == 1), 1.0).when(~plain & F.col("__ex").isNotNull(), 0.6).otherwise(0.0)
    return joined.select(*calls.columns, found.alias("resolution"), key.alias("callee_key"), confidence.alias("confidence"))


def coverage(resolved: DataFrame) -> DataFrame:
    """(total, resolved, resolvable, pct_of_all, pct_of_resolvable)."""
    total = F.count(F.lit(1))
    done = F.count_if(F.col("callee_key").isNotNull())
    able = F.count_if(~F.col("resolution").isin(*UNRESOLVABLE))
    return resolved.agg(total.alias("total"), done.alias("resolved"), able.alias("resolvable")).select(
        "*", F.round(100 * F.col("resolved") / F.nullif("total", F.lit(0)), 1).alias("pct_of_all"), F.round(100 * F.col("resolved") / F.nullif("resolvable", F.lit(0)), 1).alias("pct_of_resolvable")
    )
