"""Extensions of a source tree: neighbours ``ext`` and ``cfe`` of the source folder, through Hadoop's file system."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metadata, modules

#: Folders beside the source that hold extensions (fixed values).
HOLDERS = ("ext", "cfe")
SCHEMA = "extension string, purpose string, name_prefix string, rel_root string, root string"


def _manifest(text: str | None, folder: str) -> tuple[str, str | None, str | None]:
    """Name, purpose and prefix of names; the folder's name where the manifest says none."""
    try:
        top = next(iter(ET.fromstring(text or "")), None)
    except ET.ParseError:
        top = None
    properties = metadata.child(top, "Properties") if top is not None else None
    own = lambda tag: metadata.text_of(metadata.child(properties, tag)) if properties is not None else None
    return own("Name") or folder, own("ConfigurationExtensionPurpose"), own("NamePrefix")


def discover(spark: SparkSession, source: str) -> DataFrame:
    """(extension, purpose, name_prefix, rel_root, root): one row for each extension; a holder with a manifest of its own is one extension.

    The list is read on the driver: a tree has few extensions, each with one small manifest.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    above, rows = fs.makeQualified(path).getParent(), []
    for holder in HOLDERS:
        folder = jvm.org.apache.hadoop.fs.Path(above, holder)
        if not fs.exists(folder):
            continue
        alone = fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "Configuration.xml"))
        roots = [folder] if alone else sorted((s.getPath() for s in fs.listStatus(folder) if s.isDirectory()), key=lambda p: p.getName())
        for root in roots:
            manifest = jvm.org.apache.hadoop.fs.Path(root, "Configuration.xml")
            text = spark.read.text(manifest.toString(), wholetext=True).first()[0] if fs.exists(manifest) else None
            rows.append((*_manifest(text, root.getName()), f"../{holder}" if alone else f"../{holder}/{root.getName()}", root.toString()))
    return spark.createDataFrame(rows, SCHEMA)


def read_modules(spark: SparkSession, source: str) -> DataFrame:
    """(rel_path, content, extension, inner_path) of the base's modules (extension null) and of all extensions' (paths begin with ``../``); inner_path lies inside the own dump."""
    out = modules.read_modules(spark, source).withColumns({"extension": F.lit(None).cast("string"), "inner_path": F.col("rel_path")})
    for e in discover(spark, source).collect():
        own = modules.read_modules(spark, e["root"]).withColumns({"extension": F.lit(e["extension"]), "inner_path": F.col("rel_path")})
        out = out.unionByName(own.withColumn("rel_path", F.concat(F.lit(e["rel_root"] + "/"), "rel_path")))
    return out
