import collections

import pytest
from pyspark.sql import functions as F

from quarrylens.api import Project, across
from quarrylens.plans.build import build, update
from quarrylens.sources import extensions
from tests.test_sources import XML

TOOLS = """Procedure Do(A) Export
  Inner();
EndProcedure
Procedure Inner()
EndProcedure
"""
FORM = """#Region Handlers
Procedure OnOpen()
  Tools.Do(1);
  Tools.Do(1, 2);
  Tools.Nothing();
  Message("x");
EndProcedure
#EndRegion
"""


PREDEFINED = """<PredefinedData xmlns:v8="u"><Item><Name>Group</Name><Code>01</Code><IsFolder>true</IsFolder><ChildItems><Item><Name>Main</Name><Code>02</Code><Description>The main one</Description>
<Type><v8:Type>d4p1:EnumRef.X</v8:Type></Type><IsFolder>false</IsFolder></Item></ChildItems></Item><Item><Code>03</Code></Item></PredefinedData>"""


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dump")
    for path, text in {"CommonModules/Tools/Ext/Module.bsl": TOOLS, "Catalogs/Goods/Forms/Item/Ext/Form/Module.bsl": FORM, "Catalogs/Goods.xml": XML, "Catalogs/Goods/Ext/Predefined.xml": PREDEFINED, "Catalogs/Broken.xml": "<a>"}.items():
        file = root / "src" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    build(spark, str(root / "src"), f"file://{root}/index", "abc")
    return Project(spark, f"file://{root}/index")


def test_built_tables(project):
    assert project.store.current()["git_commit"] == "abc" and project.store.count("methods") == 3 and project.store.count("nothing") == -1
    got = {(r.callee_name, r.resolution) for r in project.table("calls").collect()}
    assert got == {("Inner", "local"), ("Tools.Do", "common_module"), ("Tools.Nothing", "common_module"), ("Message", "platform_global")}
    row = project.coverage().first()
    assert (row.total, row.resolved, row.resolvable) == (5, 3, 4)


def test_signals_of_find(project):
    """Vectors and phrases find what the words of the name do not say; each signal comes from its own source."""
    rows = {(r.kind, r.name): r for r in project.candidates("Tools.Do Inner").groupBy("kind", "name").agg(*[F.max(c).alias(c) for c in ("exact", "bm25", "semantic", "idf", "degree")]).collect()}
    assert rows["method", "Inner"].semantic > 0.3 and rows["method", "Inner"].idf > 0 and rows["method", "Inner"].degree > 0
    assert rows["method", "OnOpen"].semantic < rows["method", "Inner"].semantic
    parts = {(r.kind, r.name) for r in project.candidates("nne").where("bm25 > 0").collect()}
    assert parts == {("method", "Inner")}
    assert project.candidates("nn").where("bm25 > 0").count() == 0
    assert project.candidates("Inner", "method", 100).where("semantic > 0").count() == 0
    vectors = project.table("semantic_vectors").collect()
    assert {(r.kind, r.name) for r in vectors} == {("method", "Do"), ("method", "Inner"), ("method", "OnOpen"), ("object", "Goods"), ("attribute", "Code"), ("attribute", "Qty")} and all(len(r.vector) == 1024 for r in vectors)


def test_predefined_items_and_unreadable_files(project):
    got = {r.name: (r.owner, r.category, r.code, r.is_folder, r.types) for r in project.table("predefined_items").collect()}
    assert got == {"Group": ("Goods", "Catalogs", "01", True, []), "Main": ("Goods", "Catalogs", "02", False, ["EnumRef.X"])}
    assert [r.file.rsplit("/", 1)[1] for r in project.table("parse_errors").collect()] == ["Broken.xml"]


def test_questions(project, spark):
    assert {(r.name, r.hop) for r in project.callers("inner").collect()} == {("Do", 1), ("OnOpen", 2)}
    assert project.impact("Do").first().risk == "medium"
    assert project.find("do").first().name == "Do"
    assert [(r.name, r.region) for r in project.outline("Form/Module.bsl").collect()] == [("OnOpen", "Handlers")]
    assert {r.issue for r in project.lint().collect()} == {"unknown_method", "too_many_arguments"}
    card = project.object_card("GOODS")
    assert card["attributes"].count() == 2 and card["similar"].first().name == "Goods"
    rows, summary = project.changed_radius(spark.createDataFrame([("CommonModules/Tools/Ext/Module.bsl",)], "path string"))
    assert summary.first().risk == "CRITICAL" and rows.count() == 1
    assert project.sql("SELECT count(*) AS n FROM methods").first().n == 3
    out = across({"a": project, "b": Project(spark, "file:///nonexistent/index")}, lambda p: p.coverage())
    assert out["a"].count() == 1 and isinstance(out["b"], Exception)


MANIFEST = "<MetaDataObject><Configuration uuid='1'><Properties><Name>Patch</Name><NamePrefix>p_</NamePrefix></Properties></Configuration></MetaDataObject>"


def test_extensions_and_updates(spark, tmp_path):
    """The base's module keeps its name, an extension's takes a free one; an update reads the changed modules only and equals a build."""
    files = {
        "src/CommonModules/Tools/Ext/Module.bsl": TOOLS, "src/Catalogs/Goods/Forms/Item/Ext/Form/Module.bsl": FORM, "src/Catalogs/Goods.xml": XML,
        "ext/P/Configuration.xml": MANIFEST, "ext/P/CommonModules/Tools/Ext/Module.bsl": "Procedure Other() Export\nEndProcedure", "ext/P/CommonModules/More/Ext/Module.bsl": "Procedure Go() Export\n  Tools.Do(1);\n  More.Go();\nEndProcedure",
        "cfe/Configuration.xml": "<broken", "cfe/CommonModules/Lone/Ext/Module.bsl": "Procedure One() Export\nEndProcedure",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.extension: (r.name_prefix, r.rel_root) for r in extensions.discover(spark, str(tmp_path / "src")).collect()}
    assert found == {"Patch": ("p_", "../ext/P"), "cfe": (None, "../cfe")}
    index = f"file://{tmp_path}/index"
    store = build(spark, str(tmp_path / "src"), index)
    own = {r.rel_path: (r.category, r.object_name, r.extension) for r in store.read("modules").collect()}
    assert own["../ext/P/CommonModules/More/Ext/Module.bsl"] == ("CommonModules", "More", "Patch") and own["../cfe/CommonModules/Lone/Ext/Module.bsl"] == ("CommonModules", "Lone", "cfe")
    keys = {r.callee_name: r.callee_key for r in store.read("calls").where("rel_path LIKE '%More%'").collect()}
    assert keys == {"Tools.Do": "CommonModules/Tools/Ext/Module.bsl::do", "More.Go": "../ext/P/CommonModules/More/Ext/Module.bsl::go"}

    (tmp_path / "src/CommonModules/Tools/Ext/Module.bsl").write_text("Procedure Nothing() Export\nEndProcedure")
    (tmp_path / "cfe/CommonModules/Lone/Ext/Module.bsl").unlink()
    (tmp_path / "src/CommonModules/New/Ext").mkdir(parents=True)
    (tmp_path / "src/CommonModules/New/Ext/Module.bsl").write_text("Procedure A()\n  Tools.Nothing();\nEndProcedure")
    changed = spark.createDataFrame([("CommonModules/Tools/Ext/Module.bsl",), ("../cfe/CommonModules/Lone/Ext/Module.bsl",), ("CommonModules/New/Ext/Module.bsl",)], "rel_path string")
    updated = update(spark, str(tmp_path / "src"), index, changed)
    whole = build(spark, str(tmp_path / "src"), f"file://{tmp_path}/other")
    for name in ("modules", "methods", "regions", "calls", "semantic_tokens", "semantic_vectors"):
        rows = [collections.Counter(map(str, s.read(name).select(sorted(s.read(name).columns)).collect())) for s in (updated, whole)]
        assert rows[0] == rows[1] and rows[0], name
    assert updated.current()["incremental"] == 1
    assert {r.callee_key for r in updated.read("calls").where("callee_name = 'Tools.Nothing'").collect()} == {"CommonModules/Tools/Ext/Module.bsl::nothing"}
    assert updated.read("calls").where("callee_name = 'Tools.Do' AND callee_key IS NOT NULL").count() == 0
    kept = updated.kept("methods")
    assert updated.kept("methods") is kept and kept.storageLevel.useMemory
    updated.sidecar("practices", spark.range(3))
    updated.sidecar("practices", spark.range(5))
    assert updated.read_sidecar("practices", "id long").count() == 5 and updated.read_sidecar("none", "id long") is None
