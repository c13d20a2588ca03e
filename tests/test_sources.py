import time

import pytest

from quarrylens.plans import sqlguard
from quarrylens.sources import git, metadata, modules
from quarrylens.sources.snapshot import Store
from quarrylens.streaming import incremental

MODULE = '''// header
#Region Public
Procedure Run(A, Val B = "x(1)") Export
    // Hidden(1)
    Helper.Do(A, , "a,b(c)");
    If A Then
        Message("Go(1)");
    EndIf;
EndProcedure
#EndRegion
&Around("Old")
Функция Считать()
    Возврат Сумма(1);
КонецФункции
Outside();
'''


def test_parse_module():
    out = modules.parse_module(MODULE)
    assert [(m["name"], m["type"], m["is_export"], m["line"], m["end_line"], m["override_of"]) for m in out["methods"]] == [("Run", "Procedure", 1, 3, 9, None), ("Считать", "Function", 0, 12, 14, "Old")]
    assert out["calls"] == [("Run", "Helper.Do", 5, 3), ("Run", "Message", 7, 1), ("Считать", "Сумма", 13, 1)]
    assert out["regions"] == [("Public", 2, 10)]
    assert modules.complexity("If a And b Then\n For i = 1 To 2 Do\n EndDo;\nEndIf;") == (4, 2)
    assert modules.normalize_source("﻿a\r\nb\rc".encode()) == "a\nb\nc"


def test_long_calls_and_signatures():
    query = "\n".join(f"    |  Field{i}, (a{i}" for i in range(60))
    names = ",\n".join(f"  P{i} = 1" for i in range(50))
    text = f'Procedure Long(\n{names}\n) Export\n  Run("\n{query}\n    |", A,\n' + "\n" * 40 + '  Other(B, [1, 2], C), D);\nEndProcedure\nFunction Open(A,\n'
    out = modules.parse_module(text)
    assert [(m["name"], m["is_export"], m["params"].count("=")) for m in out["methods"]] == [("Long", 1, 50), ("Open", 0, 0)]
    assert [(name, n) for _, name, _, n in out["calls"]] == [("Run", 4), ("Other", 3)]
    assert modules.parse_module("Procedure P()\n  F(G(), , );\n  H( );\nEndProcedure")["calls"] == [("P", "F", 2, 3), ("P", "G", 2, 0), ("P", "H", 3, 0)]


def test_read_and_parse_files(spark, tmp_path):
    (tmp_path / "dump" / "CommonModules" / "Tools" / "Ext").mkdir(parents=True)
    (tmp_path / "dump" / "CommonModules" / "Tools" / "Ext" / "Module.bsl").write_text(MODULE)
    files = modules.read_modules(spark, str(tmp_path / "dump"))
    assert files.first().rel_path == "CommonModules/Tools/Ext/Module.bsl"
    assert modules.parse(files, "calls").count() == 3
    parts = modules.classify_path(files["rel_path"])
    row = files.select(parts["category"].alias("c"), parts["object_name"].alias("o"), parts["module_type"].alias("t")).first()
    assert tuple(row) == ("CommonModules", "Tools", "Module")


XML = """<MetaDataObject><Catalog uuid="1"><Properties><Name>Goods</Name></Properties><ChildObjects>
<Attribute uuid="2"><Properties><Name>Code</Name><Synonym><item><content>The code</content></item></Synonym><Type><Type>xs:string</Type><StringQualifiers><Length>9</Length></StringQualifiers></Type></Properties></Attribute>
<TabularSection uuid="3"><Properties><Name>Rows</Name></Properties><ChildObjects><Attribute uuid="4"><Properties><Name>Qty</Name><Type><Type>xs:decimal</Type></Type></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Catalog></MetaDataObject>"""


def test_parse_metadata(spark):
    files = spark.createDataFrame([("Goods.xml", XML.encode()), ("bad.xml", b"<x>")], "file string, content binary")
    rows = metadata.parse(files, "attributes").collect()
    assert [(r.object_name, r.attr_name, r.attr_synonym, r.attr_types, r.attr_kind, r.ts_name, r.length) for r in rows] == [("Goods", "Code", "The code", ["String"], "attribute", None, 9), ("Goods", "Qty", None, ["Number"], "ts_attribute", "Rows", None)]
    role = b"<Rights><object><name>Catalog.Goods</name><right><name>Read</name><value>true</value></right><right><name>Edit</name><value>false</value></right></object></Rights>"
    rights = metadata.parse(spark.createDataFrame([("x/Roles/Clerk/Ext/Rights.xml", role)], "file string, content binary"), "rights").collect()
    assert [(r.role_name, r.object_name, r.right_name) for r in rights] == [("Clerk", "Catalog.Goods", "Read")]
    assert metadata.split_handler("CommonModule.M.P") == ("M", "P") and metadata.split_handler("M.P") == (None, None)


BAD_SQL = [
    "", "DROP TABLE t", "SELECT 1; SELECT 2", "SELECT 1 /* x */; DELETE FROM t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM pragma_table_info('t')", "SET a = b", "SHOW TABLES", "EXPLAIN SELECT 1",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('java.lang.System', 'getenv')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM text.`file:///etc/passwd`", "SELECT * FROM spark_catalog.default.t",
    "WITH a AS (SELECT reflect('x', 'y') AS r) SELECT * FROM a", "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/x`)", "SELECT (SELECT max(reflect('x', 'y')))", "SELECT 1 WHERE 1 IN (SELECT id FROM json.`/x`)", "SELECT input_file_name()", "SELECT * FROM VALUES (reflect('a', 'b'))", "SELECT upper(lower(try_reflect('a', 'b')))",
]


@pytest.mark.parametrize("bad", BAD_SQL)
def test_guard_rejects(spark, bad):
    with pytest.raises(sqlguard.Rejected):
        sqlguard.validate(spark, bad)


GOOD_SQL = [
    "SELECT id, row_number() OVER (PARTITION BY id % 2 ORDER BY id) AS n FROM guard_t WHERE id IN (SELECT max(id) FROM guard_t) -- delete\n;", "WITH a AS (SELECT id, count(*) AS n FROM guard_t GROUP BY id HAVING count(*) > 0) SELECT a.id, b.n FROM a JOIN a AS b ON a.id = b.id ORDER BY 1 LIMIT 3",
    "SELECT CASE WHEN id > 1 THEN 'drop table' ELSE replace('a', 'x', 'y') END AS s FROM guard_t UNION ALL SELECT 'z'", "SELECT x FROM (SELECT explode(array(1, 2)) AS x) LATERAL VIEW explode(array(x)) t AS y", "SELECT * FROM VALUES (1, 2), (3, 4) AS v(a, b)", "SELECT * FROM range(3)", "SELECT coalesce(sum(id), 0) AS s FROM guard_t WHERE EXISTS (SELECT 1)",
]


@pytest.mark.parametrize("good", GOOD_SQL)
def test_guard_accepts(spark, good):
    spark.range(3).createOrReplaceTempView("guard_t")
    assert sqlguard.run(spark, good).count() >= 1


def test_guard_hints(spark):
    spark.range(3).createOrReplaceTempView("guard_t")
    assert sqlguard.run(spark, "SELECT id FROM guard_t", 2).count() == 2
    with pytest.raises(sqlguard.Rejected, match="columns: guard_t: id"):
        sqlguard.run(spark, "SELECT nothing FROM guard_t")


def test_the_marker_is_kept_fresh(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    with store.building(every_s=0.3):
        assert not store.lock(stale_s=2)
        time.sleep(3)
        assert not store.lock(stale_s=2)  # older than that, but still beating
    assert store.lock(stale_s=2) and not store.lock(stale_s=2)
    time.sleep(2.5)
    assert store.lock(stale_s=2)  # nobody beats it


def test_paths_begin_below_the_whole_root(spark, tmp_path):
    root = tmp_path / "src" / "x" / "src"
    (root / "M").mkdir(parents=True)
    (root / "M" / "Module.bsl").write_text("Procedure A()\nEndProcedure")
    for name in (str(root), f"file://{root}/"):
        assert [r.rel_path for r in modules.read_modules(spark, name).collect()] == ["M/Module.bsl"]


def test_snapshot_is_swapped_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None and store.count("a") == -1
    store.write({"a": spark.range(3)}, {"commit": "x"}, "snapshot=1")
    store.write({"a": spark.range(5)}, snapshot="snapshot=2")
    assert store.count("a") == 5 and store.current()["snapshot"] == "snapshot=2"
    with pytest.raises(KeyError):
        store.read("b")
    assert store.lock() and not store.lock()
    store.unlock()
    assert store.lock()


def test_stream_refuses_metadata_and_keeps_the_batch(spark, tmp_path):
    root, check = tmp_path / "in", tmp_path / "check"
    root.mkdir()
    (root / "a.bsl").write_text("x")
    (root / "b.xml").write_text("<x/>")
    seen = []
    stream = incremental.file_stream(spark, str(root))
    with pytest.raises(Exception):
        incremental.apply_batches(stream, lambda df, i: seen.append(df.count()), f"file://{check}").start().awaitTermination()
    assert seen == []
    with pytest.raises(Exception, match="full build"):  # the refused batch is still queued
        incremental.apply_batches(incremental.file_stream(spark, str(root)), lambda df, i: seen.append(df.count()), f"file://{check}").start().awaitTermination()
    assert seen == []
    incremental.apply_batches(incremental.file_stream(spark, str(root), "*.bsl"), lambda df, i: seen.append(df.count()), f"file://{tmp_path}/other").start().awaitTermination()
    assert seen == [1]
    assert incremental.poll_interval_ms(1_000_000) == 60_000


def test_upsert_deletes_touched_rows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    out = incremental.upsert(old, old.where("k = 2").selectExpr("k", "'B' v"), "k", old.where("k IN (2, 3)"))
    assert {tuple(r) for r in out.collect()} == {(1, "a"), (2, "B")}


def test_git_head(tmp_path):
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    assert git.head(str(tmp_path)) is None
    (tmp_path / ".git" / "packed-refs").write_text("abc refs/heads/main\n")
    assert git.head(str(tmp_path)) == "abc"


def events_in(*lines):
    from quarrylens.sources import events

    return list(events.events_of("\n".join(["Procedure P(Val Item, Other = 1)", *lines, "EndProcedure"])))


def test_events_know_their_blocks():
    found = events_in("Try", "While More() Do", "A();", "EndDo;", "Except", "If B() Then C(); ElsIf D() Then E(); Else F(); EndIf;", "EndTry;", "Try G(); EndTry;", "EndDo; H();")
    assert [(e["name"], e["flags"], e["try_id"]) for e in found] == [
        ("More", "CT", 1), ("A", "LT", 1), ("B", "CX", 1), ("C", "BX", 1), ("D", "CX", 1), ("E", "BX", 1), ("F", "BX", 1), ("G", "T", 2), ("H", "", None),
    ]


def test_events_know_their_arguments():
    (e,) = events_in('Call("a""b" // a note, (', ' "c", 2.5, Item.Size, Undefined, Fifth);')
    assert e["args"] == [{"kind": "S", "value": '"a""b""c"'}, {"kind": "N", "value": "2.5"}, {"kind": "D", "value": "size"}, {"kind": "=", "value": "undefined"}] and e["first_kind"] == "S"
    outer, inner = events_in("Call(Inner(1, 2)[0], , (3));")
    assert [a["kind"] for a in outer["args"]] == ["E", "-", "E"] and inner["parent"] == "Call" and inner["line"] == 1
    assert [a["kind"] for a in events_in("Call(Inner(1));")[0]["args"]] == ["C"]
    assert events_in("Call();")[0]["args"] == [] and events_in("Call(, A);")[0]["args"][0]["kind"] == "-"
    assert events_in("Call(True);")[0]["first_kind"] == "=true"


def test_events_know_who_joins_and_who_surrounds_them():
    found = events_in('Text = "a" + Say(Item.Get(), Name()) + Rows[0].Last();', "New Map; Raise;", "Broken(A, Open(")
    assert [(e["name"], e["parent"], e["concat"]) for e in found] == [
        ("Say", "", True), ("param:Item.Get", "Say", False), ("Name", "Say", False), ("*.Last", "", False), ("Новый Map", "", False), ("ВызватьИсключение", "", False), ("Broken", "", False), ("Open", "Broken", False),
    ]


def test_events_of_odd_modules(spark):
    from quarrylens.sources import events

    rows = [("a", b"Procedure P(\nSay(1);\nEndProcedure"), ("b", b""), ("c", None), ("d", "Процедура П() Экспорт\nСообщить(\"x\n|y\");\nКонецПроцедуры".encode())]
    found = events.events(spark.createDataFrame(rows, "rel_path string, content binary")).collect()
    assert [(r.rel_path, r.method, r.name, r.line) for r in found if r.rel_path != "a"] == [("d", "П", "Сообщить", 2)]
