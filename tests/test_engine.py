import random
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions import helpers
from quernstone.functions import search as S
from quernstone.functions.expressions import parse
from quernstone.plans.numbering import numbered
from quernstone.sources.formats import csv_lines, dump, load_dump, read_csv
from quernstone.sources.jdbc import read_jdbc, write_jdbc
from quernstone.sources.tables import Database
from quernstone.streaming.changes import ChangeLog, listen, windowed


def ids(q):
    return sorted(r["id"] for r in q.exec())


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "", 0.0, [1, 2]), (2, None, None, None), (3, "Ab", 5.0, [2, 2]), (4, "ab\n", float("nan"), [])], "id long, s string, x double, a array<int>"))
    return d


@pytest.mark.parametrize(("where", "want"), [
    (["s", "=", "NULL"], [1, 2]), (["s", "=", "NOT NULL"], [3, 4]), (["s", "!=", "Ab"], [1, 2, 4]), (["s", "LIKE", "ab%"], [3, 4]), (["s", "LIKE", "a_"], [3]), (["s", "NOT LIKE", "a%"], [1, 2]), (["s", "LIKE", "a.%"], []),
    (["x", ">", 1], [3, 4]), (["x", "NOT IN", [0.0]], [2, 3, 4]), (["a", "INCLUDES", 2], [1, 3]), (["a", "NOT INCLUDES", 2], [2, 4]), (["a", "INTERSECT ALL", [1, 2]], [1]), (["a", "=", [1, 2]], [1]), (["a", "NOT INTERSECT", [1]], [2, 3, 4]),
    (["x", "NOT BETWEEN", [0, 5]], [1, 3, 4]), ([["id", "=", 1], "OR", ["id", "=", 2], "AND", ["id", ">", 1]], [2]), (["x", "IN", []], []),
])
def test_where(db, where, want):
    assert ids(db.query("t").where(where)) == want


def test_wrong_conditions(db):
    for where in (["s", "IN", "x"], ["s", "NEAR", 1], ["nothing", "=", 1]):
        with pytest.raises(ValueError):
            db.query("t").where(where).df()


def test_expressions(db):
    with pytest.raises(ValueError):
        parse("F(a")
    r = db.query("t").where(["id", "=", 3]).select(["REPLACE(s, 'A', \"b,'\") AS r", "CONCAT_WS('-', s, NULL, 'z') AS c", "IF(x >= 5, 'y', 'n') AS i", "DIV(1, 0) AS d", "ROUND(-2.5) AS n", "a[1] AS e"]).exec()[0]
    assert r == {"r": "b,'b", "c": "Ab--z", "i": "y", "d": None, "n": -2.0, "e": 2}


def test_aggregates_take_null_as_zero(db):
    r = db.query("t").where(["id", "<", 4]).select(["COUNT(s) AS s", "COUNT(x) AS x", "AVG(x) AS a", "MIN(x) AS m"]).exec()[0]
    assert r == {"s": 1, "x": 1, "a": 5 / 3, "m": 0.0}


def test_model_and_mutations(spark):
    d = Database(spark)
    d.create_table("u", {"id:int": {"pk": True, "ai": True}, "name:string": {"notNull": True}, "age:int": {"min": 0, "default": 7}, "born:int": {"immutable": True}}, indexes={"name:string": {"unique": True, "ignore_case": True}})
    d.upsert("u", spark.createDataFrame([("a", "3.6", 1), ("b", "x", 2)], "name string, age string, born int"))
    d.upsert("u", spark.createDataFrame([(1, "c", 9)], "id int, name string, born int"))
    assert sorted(map(tuple, d.rows("u").collect())) == [(1, "c", 4, 1), (2, "b", 0, 2)]
    with pytest.raises(ValueError):
        d.upsert("u", spark.createDataFrame([("B",)], "name string"))
    with pytest.raises(Exception, match="too small"):
        d.upsert("u", spark.createDataFrame([("z", -1)], "name string, age int"))
        d.rows("u").collect()


def test_foreign_keys(spark):
    d = Database(spark)
    d.attach("p", spark.createDataFrame([(1,), (2,)], "id long"))
    d.attach("c", spark.createDataFrame([(1, 1), (2, 2)], "cid long, p long"))
    d.tables["c"].indexes = {"p:int": {"foreignKey": {"target": "p.id", "onDelete": "RESTRICT"}}}
    with pytest.raises(ValueError):
        d.delete("p", ["id", "=", 1])
    d.tables["c"].indexes["p:int"]["foreignKey"]["onDelete"] = "SET_NULL"
    d.delete("p", ["id", "=", 1])
    assert sorted(map(tuple, d.rows("c").select("cid", "p").collect())) == [(1, None), (2, 2)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a"b', True), ("c,\nd", False), (None, True)], "s string, b boolean")
    lines = [r["line"] for r in csv_lines(df).orderBy("at").collect()]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    assert sorted(map(str, read_csv(spark, str(tmp_path / "x.csv")).collect())) == sorted(map(str, df.collect()))
    dump({"x": df}, str(tmp_path / "d"))
    assert load_dump(spark, ["x"], str(tmp_path / "d"))["x"].count() == 3


def test_stems():
    for w, s in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic", "adjustment": "adjust", "controlling": "control", "sky": "sky"}.items():
        assert S.stem(w) == s


def test_tokens_and_scores(spark):
    assert S.normalise("1/4 of 1,000 big-cats!") == ["0.2500", "of", "1000.0000", "big", "cats"]
    df = spark.createDataFrame([(1, "quick brown foxes"), (2, "quick red brown fox"), (3, None), (4, "brown")], "id long, s string")
    got = {r["id"]: r["score"] for r in S.search(df, "id", "s", ["quick brown"], "english-stem", most=2).collect()}
    assert got == {1: 0, 2: 1, 4: 2}


def test_changes_reach_a_listener(spark, tmp_path):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a")], "id long, s string"))
    log = ChangeLog(spark, str(tmp_path / "log"))
    d.changes.append(log)
    d.upsert("t", spark.createDataFrame([(2, "b")], "id long, s string"))
    seen = []
    for _ in range(2):
        listen(log, ["t"], lambda: d.rows("t"), lambda df: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [2]


def test_windows_on_a_stream(spark, data, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*")
    q = windowed(events, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_rows_are_numbered_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7).orderBy("v")
    assert [(r["v"], r["n"]) for r in numbered(df, "n").orderBy("v").collect()] == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), "n").count() == 0
    d = Database(spark)
    d.create_table("k", {"id:int": {"pk": True, "ai": True}, "v:int": {}})
    d.upsert("k", spark.range(40).select(F.when(F.col("id") == 39, 500).alias("id"), F.col("id").alias("v")).repartition(5))
    assert sorted(r["id"] for r in d.rows("k").collect()) == [*range(1, 40), 500]


def test_graph_of_repeated_and_null_parents(spark):
    d = Database(spark)
    d.attach("p", spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (2, 5, "a"), (3, None, "b"), (4, 9, None)], "id int, k int, s string"))
    d.attach("c", spark.createDataFrame([(10, 5), (11, 5), (12, None)], "cid int, k int"))
    for on in (["p.k", "=", "c.k"], lambda df: F.col("`p.k`") == F.col("`c.k`")):
        got = d.query("p").graph({"key": "kids", "with": {"table": "c"}, "on": on, "select": ["cid"], "orderBy": ["cid DESC"]}).exec()
        kids = lambda i: [[k["cid"] for k in r["kids"]] for r in got if r["id"] == i]  # noqa: B023, E731
        assert (kids(1), kids(2), kids(4)) == ([[11, 10]], [[11, 10]] * 2, [[]]) and len(got) == 5


def test_transactions_paths_presets_and_versions(spark):
    d, told, moved = Database(spark), [], []
    d.attach("t", spark.createDataFrame([(1, ("x", 1)), (2, ("y", 2))], "id int, a struct<b: string, c: int>"))
    d.changes.append(lambda name, what, rows: told.append(what))
    d.on_path("t", "a.c", lambda rows: moved.extend(map(tuple, rows.collect())))
    with pytest.raises(ZeroDivisionError), d.transaction():
        d.delete("t", ["id", "=", 1])
        raise ZeroDivisionError
    assert d.rows("t").count() == 2 and not told
    with d.transaction():
        d.update("t", {"a.c": 7}, ["id", "=", 1])
        d.update("t", {"a.b": "z"}, ["id", "=", 2])
        assert not told
    assert told == ["upsert", "upsert"] and moved == [(1, 1, 7)]
    d.define("from", lambda db, least: db.query("t").where(["id", ">=", least]), {"least:int": {"default": 1}})
    assert ids(d.preset("from", least="1.6")) == [2] and ids(d.preset("from")) == [1, 2]
    with pytest.raises(ValueError):
        d.preset("from", most=1)
    d.migrate(3, lambda db, v: v + 1)
    assert d.version == 3
    with pytest.raises(ValueError):
        d.migrate(4, lambda db, v: v)


def test_helpers(spark):
    r = spark.createDataFrame([("hELLO  wörld!",)], "s string").select(helpers.title_case(F.col("s")), helpers.slug(F.col("s"))).first()
    assert tuple(r) == ("Hello  wörld!", "hello-wrld")
    assert [x["n"] for x in helpers.every(spark, 10, 5, 1).collect()] == [1, 6, 11]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write_jdbc(spark.range(100).select(F.col("id").alias("ID"), (F.col("id") % 7).alias("V")), url, "T", "overwrite", parts=2, **driver)
    df = read_jdbc(spark, url, "T", key="ID", parts=4, **driver)
    assert df.rdd.getNumPartitions() == 4 and df.where("V = 3").count() == 14
    assert read_jdbc(spark, url, "T", **driver).agg(F.sum("ID")).first()[0] == 4950


def test_search_survives_long_numbers_and_fractions():
    assert S.normalise("1" * 400 + "/2") == ["1" * 400 + "2"] and S.normalise("9" * 5000) == ["9" * 5000]
    assert S.normalise("12,345.5 7/0 1/3") == ["12345.5000", "70", "0.3333"]


def test_search_in_conditions(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "quick brown foxes", "x"), (2, "quick red brown fox", None), (3, None, "quick brown"), (4, "brown", "y"), (5, "quick brown", "z")], "id long, s string, t string"))
    for term, op, n, want in (("quick brown", "=", 0, [1, 5]), ("quick brown", "<=", 1, [1, 2, 5]), ("quick brown", "<", 3, [1, 2, 4, 5]), ("quick brown", ">", 0, [2, 4, 5]), ("brown", "=", 0, [1, 2, 4, 5]), ("brown", "<=", 0, [1, 2, 4, 5]), ("brown", "<", 3, [4]), ("brown", "!=", 0, [4])):
        assert ids(d.query("t").where([f"SEARCH(s, '{term}', 'tokenizer:english-stem')", op, n])) == want, (term, op, n)
    assert ids(d.query("t").where(["SEARCH(*, 'quick brown')", "=", 0])) == [1, 3, 5]
    got = {r["id"]: r["score"] for r in d.query("t").select(["id", "SEARCH(s, 'quick brown', 'red') AS score"]).exec()}
    assert got == {1: 0, 2: 0, 3: None, 4: 2, 5: 0}
    d.tables["t"].indexes = {"s:string": {"search": {"tokenizer": "english-stem"}}, "t:string": {"search": True}}
    d.custom("rebuild search", "t")
    found = lambda *a, **k: sorted(map(tuple, d.tables["t"].search.search(*a, **k).collect()))
    assert found(["quick brown"]) == [(1, 0), (3, 0), (5, 0)] and found(["quick brown"], column="s") == [(1, 0), (5, 0)]
    d.delete("t", ["id", "=", 1])
    d.upsert("t", [{"id": 5, "s": "slow", "t": None}, {"id": 6, "s": "quick, brown!", "t": "a"}])
    assert found(["quick brown"]) == [(3, 0), (6, 0)] and found(["quick brown"], "<=", 1) == [(2, 1), (3, 0), (6, 0)] and found(["SLOW", "slow"]) == [(5, 0)]


def test_tokens_of_many_texts_are_those_of_each():
    gaps, drop = re.compile(r"[-_\[\](){}\r\n\t]"), re.compile(r"(?<![0-9])\.|[^A-Za-z0-9_\s.]")
    rnd = random.Random(3)
    signs = "abeZ19 .,/-_[](){}\r\n\t\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff\u00c9\u00df\u03a3\u0130\0!'"
    texts = ["".join(rnd.choices([*signs, "the ", "quick ", "1/2", "1,000.5", "12."], k=rnd.randrange(30))) for _ in range(3000)] + ["", None, " . ", "a" * 5000]
    for t in texts:
        low = (t or "").lower()
        assert S.normalise(t) == drop.sub("", gaps.sub(" ", S._digits.sub(lambda m: S._number(m[0], 4), low))).split()
    for mode in ("words", "english", "english-stem", "english-meta"):
        known = S.Tokens(mode)
        text, w, places = S.grouped(texts, known)
        got = sorted(zip(text.tolist(), w.to_pylist(), places.to_pylist(), strict=True))
        assert got == sorted((i, w, p) for i, t in enumerate(texts) for w, p in S.places(t, mode, known).items())
        assert len(S.grouped([None, "..."], known)[0]) == 0


def test_changes_leave_a_stored_index_as_it_is(spark):
    d = Database(spark)
    words = ["quick", "brown", "fox", "the", "slow", None]
    rnd = random.Random(5)
    row = lambda k: {"id": k, "s": " ".join(filter(None, rnd.choices(words, k=4))), "t": rnd.choice(words)}
    d.attach("t", spark.createDataFrame([row(f"k{i}") for i in range(40)], "id string, s string, t string"))
    d.tables["t"].indexes = {"s:string": {"search": {"tokenizer": "words"}}, "t:string": {"search": True}}
    frame, most = d.rebuild_search("t").frame, S.SearchIndex.MOST
    for i in range(most + 3):
        if i % 3 == 2:
            d.delete("t", ["id", "IN", [f"k{i}", f"k{i + 20}"]])
        else:  # new rows, patches of all columns, of one, and by null
            d.upsert("t", [row(f"k{i}"), row(f"n{i}"), {"id": f"k{i + 1}", "t": "quick brown"}, {"id": f"k{i + 2}", "s": None}])
    for c in ("u", "v"):  # columns that were not there
        d.upsert("t", [{"id": f"k{i}", c: "new", "s": "quick brown"} for i in (5, 6)])
    assert d.tables["t"].search.frame is frame and len(d.tables["t"].search.changes) <= most
    anew = S.SearchIndex.built(d.rows("t"), "id", ["s", "t"], "words")
    for op, n in (("=", 0), ("<=", 1), (">", 0)):
        got, want = (sorted(map(tuple, x.search(["quick brown", "slow"], op, n).collect())) for x in (d.tables["t"].search, anew))
        assert got == want and got


def test_upserts_patch_in_order_and_by_null(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, s string, x double"))
    left = lambda: sorted(map(tuple, d.rows("t").collect()), key=str)
    d.upsert("t", [{"id": 1, "s": None}])
    assert left() == [(1, None, 1.0), (2, "b", 2.0)]
    d.upsert("t", [{"id": 2, "s": "c"}, {"id": 2, "x": 5.0}, {"id": 3, "s": "n", "x": None}, {"id": 2, "s": None}])
    assert left() == [(1, None, 1.0), (2, None, 5.0), (3, "n", None)]
    d.upsert("t", spark.createDataFrame([(1, "p"), (1, "q"), (4, "r")], "id long, s string").coalesce(1))
    assert left() == [(1, "q", 1.0), (2, None, 5.0), (3, "n", None), (4, "r", None)]


def test_plans_of_changed_tables_stay_short(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a")], "id long, s string"))
    for i in range(12):
        d.upsert("t", [{"id": i, "s": str(i)}])
    assert d.rows("t").count() == 12 and d.tables["t"].df._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") <= 4


def test_time_to_live(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, s string"))
    d.query("t").upsert([{"id": 1}, {"id": 5, "s": "e"}]).ttl(-1).exec()
    d.query("t").upsert([{"id": 2}]).ttl(-1, ["s"]).exec()
    d.query("t").upsert([{"id": 3}]).ttl(1000).exec()
    left = lambda: sorted(map(tuple, d.rows("t").collect()))
    assert left() == [(2, None), (3, "c"), (4, "d")]
    assert 900 < d.expires("t", 3).first()["seconds"] <= 1000 and d.expires("t", 4).count() == 0
    d.clear_ttl("t", 3)
    assert d.expires("t", 3).count() == 0
    d.sweep("t")
    assert sorted(map(tuple, d.tables["t"].df.collect())) == [(2, None), (3, "c"), (4, "d")] and d.expires("t", 2).count() == 0


def test_events_hooks_and_envelopes(spark, tmp_path):
    from quernstone.sources.tables import Cancelled

    d, told = Database(spark), []
    d.listen_to("*", lambda e: told.append((e["event"], e["target"])))
    d.listen_to("change", lambda e: told.append(("change", sorted(r["s"] for r in e["old"].collect()))), "t")
    log = ChangeLog(spark, str(tmp_path / "log"))
    d.listen_to("change", log.event)
    d.connect()
    d.attach("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string"))
    assert d.query("t").where(["id", "=", 1]).exec(events=True)[0]["result"] == {"id": 1, "s": "a"}
    d.query("t").where(["id", "=", 1]).upsert({"s": "z"}).exec()
    d.query("t").delete().where(["id", "=", 2]).exec()
    assert told == [("connect", "main"), ("ready", "main"), ("select", "t"), ("upsert", "t"), ("change", ["a"]), ("delete", "t"), ("change", ["b"])]
    assert sorted((r["op"], r["row"], r["old"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("delete", '{"id":2,"s":"b"}', '{"id":2,"s":"b"}'), ("upsert", '{"id":1,"s":"z"}', '{"id":1,"s":"a"}')]
    order = []
    d.on("addRow", lambda rows, name: order.append("low") or rows.where("id > 0"))
    d.on("addRow", lambda rows, name: order.append("high") or rows, priority=5)

    def refuse(rows, name):
        raise Cancelled

    d.upsert("t", [{"id": -1, "s": "q"}, {"id": 7, "s": "r"}])
    assert order == ["high", "low"] and ids(d.query("t")) == [1, 7]
    d.on("deleteRow", refuse)
    with pytest.raises(Cancelled):
        d.delete("t")
    d.off("deleteRow", refuse)
    d.delete("t")
    d.on("customQuery", lambda answer, action, table, args: (action, table, args) if action == "dance" else answer)
    assert d.custom("dance", "t", fast=True) == ("dance", "t", {"fast": True})
    with pytest.raises(ValueError):
        d.custom("sing", "t")


def test_databases_and_drops(spark):
    from quernstone.sources.tables import Databases

    all_ = Databases(spark)
    d = all_.create("one")
    all_.create("two")
    assert all_.names() == ["one", "two"] and all_.current.name == "two" and all_.use("one") is d
    all_.drop("two")
    with pytest.raises(KeyError):
        all_.use("two")
    for how, left in (("CASCADE", []), ("SET_NULL", [(1, None), (2, None)])):
        d.attach("p", spark.createDataFrame([(1,), (2,)], "id long"))
        d.attach("c", spark.createDataFrame([(1, 1), (2, 2)], "cid long, p long"))
        d.tables["c"].indexes = {"p:int": {"foreignKey": {"target": "p.id", "onDelete": how}}}
        d.drop("p")
        assert sorted(tuple(r) for r in d.rows("c").select("cid", "p").collect()) == left and "p" not in d.tables
        with pytest.raises(Exception, match="p"):
            d.sql("SELECT * FROM p").collect()
    for name, model in (("1x", {"id:int": {}}), ("select", {"id:int": {}}), ("ok", {"id:geo": {"pk": True}}), ("ok", {"a:int": {"pk": True}, "b:int": {"pk": True}})):
        with pytest.raises(ValueError):
            d.create_table(name, model)


def test_sql_that_cannot_be_read(spark):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a")], "id long, s string"))
    for text in ("UPDATE t", "INSERT INTO t (id) VALUES (1, 2)", "MERGE INTO t USING t ON 1 = 1 WHEN SOMETIMES THEN DELETE", "DELETE t", "ALTER TABLE t DROP COLUMN id", "CREATE SOMETHING x"):
        with pytest.raises(ValueError):
            d.sql(text)


def test_sql_tables_from_nothing(spark, tmp_path):
    d = Database(spark)
    d.sql("CREATE TABLE p (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(20) NOT NULL UNIQUE, ok BOOLEAN DEFAULT true, w DOUBLE DEFAULT 1.5)")
    d.sql("CREATE TABLE IF NOT EXISTS c (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES p (id) ON DELETE CASCADE)")
    d.sql("INSERT INTO p (name) VALUES ('x'), ('y')")
    d.sql("INSERT INTO c VALUES (1, 1), (2, 2), (3, 1)")
    assert sorted(map(tuple, d.rows("p").collect())) == [(1, "x", True, 1.5), (2, "y", True, 1.5)]
    with pytest.raises(ValueError):
        d.sql("INSERT INTO p (name) VALUES ('x')")
    d.sql("DELETE FROM p WHERE id = 1")
    assert [tuple(r) for r in d.rows("c").collect()] == [(2, 2)]
    d.sql("ALTER TABLE p ADD COLUMN z INT DEFAULT 4")
    d.sql("ALTER TABLE p RENAME COLUMN z TO zz")
    d.sql("ALTER TABLE p DROP COLUMN ok")
    d.sql("CREATE UNIQUE INDEX i ON p (w)")
    assert [r.asDict() for r in d.rows("p").collect()] == [{"id": 2, "name": "y", "w": 1.5, "zz": 4}] and d.tables["p"].indexes["w:string"]["unique"]
    (tmp_path / "f.csv").write_text('"a","b","c"\n"1",true,"{""q"": [1,2]}"\n"2",false,"{""q"": [3]}"\n')
    assert [tuple(r) for r in d.sql(f"SELECT a, b, c.q[0] AS q FROM '{tmp_path}/f.csv' WHERE b").collect()] == [("1", True, 1)]
    assert [tuple(r) for r in d.sql(f"SELECT TOP 1 a FROM CSV('{tmp_path}/f.csv') ORDER BY a DESC UNION ALL SELECT TOP 1 name FROM p ORDER BY name").collect()] == [("2",), ("y",)]
    d.sql("DROP TABLE p")
    assert d.show_tables().first()[0] == "c" and d.rows("c").count() == 0


def test_adapter(spark, tmp_path):
    from quernstone.sources.adapter import adapted, register_adapter

    def read(options, part):
        yield from ((part * 10 + i, f"v{part}") for i in range(3))

    def write(options, rows):
        import uuid

        with open(f"{options['to']}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{r.id},{r.v}\n" for r in rows)

    register_adapter(spark, "mine", "id long, v string", lambda options: range(int(options["parts"])), read, write)
    df = adapted(spark, "mine", parts="4")
    assert df.count() == 12 and df.where("v = 'v2'").count() == 3 and df.rdd.getNumPartitions() == 4
    df.write.format("mine").option("to", str(tmp_path)).mode("append").save()
    assert sum(len(f.read_text().splitlines()) for f in tmp_path.iterdir()) == 12


def test_listening_query_and_builder(spark, tmp_path):
    d = Database(spark)
    d.attach("t", spark.createDataFrame([(1, "a")], "id long, s string"))
    d.attach("u", spark.createDataFrame([(1, 5)], "uid long, n long"))
    log = ChangeLog(spark, str(tmp_path / "log"))
    d.changes.append(log)
    q = d.query("t").join({"type": "inner", "with": {"table": "u"}, "on": ["t.id", "=", "u.uid"]})
    assert q.tables() == ["t", "u"]
    d.query("x").into("u").upsert([{"uid": 2, "n": 6}]).exec()
    d.query("x").on("t").upsert([{"id": 2, "s": "b"}]).exec()
    seen = []
    q.listen(log, lambda df: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == [2]
    pages = [sorted(r["id"] for r in p.collect()) for p in d.query("x").from_("t").order_by(["id ASC"]).cache("k", page=1)]
    assert pages == [[1], [2]]
    d.views["by"] = lambda db, n: db.query("t").where(["id", "=", n])
    assert ids(d.view("by", n=2)) == [2]


def test_distances_are_narrowed_by_a_box(spark):
    d = Database(spark)
    places = [(i, ((i * 7) % 179 - 89.5, (i * 13) % 360 - 180.0)) for i in range(3000)]
    d.attach("t", spark.createDataFrame(places, "id long, at struct<lat: double, lon: double>"))
    for lat, lon, most in ((40, 175, 2500), (-89, 0, 900), (0, 0, 500), (10, -179, 1200), (60, 20, 15_000)):
        for op in ("<", "<="):
            q = d.query("t").where([f"CROW(at, {lat}, {lon})", op, most])
            far = d.query("t").select(["id", f"CROW(at, {lat}, {lon}) AS km"]).df()
            assert ids(q) == sorted(r["id"] for r in far.where(f"km {op} {most}").collect())
    plan = d.query("t").where(["CROW(at, 40, 100)", "<", 50]).df()._jdf.queryExecution().optimizedPlan().toString()
    assert "lat" in plan and ">= 39.5" in plan


def test_class_text():
    space = {}
    text = helpers.class_text("User", {"id:int": {"pk": True}, "tags:string[]": {}, "at:geo": {}, "home:obj": {"model": {"city:string": {}}}, "*": {}})
    exec("from __future__ import annotations\nfrom dataclasses import dataclass\n" + text, space)  # noqa: S102
    assert space["User"](id=1, tags=["a"]).home is None and space["UserHome"](city="x").city == "x"


def test_connectors(spark):
    from quernstone.sources.connectors import options_of, read_store

    assert options_of("mongodb", uri="mongodb://h", database="d", table="t") == ("mongodb", {"connection.uri": "mongodb://h", "database": "d", "collection": "t"})
    assert options_of("scylladb", uri="h", database="k", table="t", split="9")[1] == {"spark.cassandra.connection.host": "h", "keyspace": "k", "table": "t", "split": "9"}
    with pytest.raises(ValueError):
        options_of("paper")
    with pytest.raises(Exception, match=r"(?i)mongodb"):  # this box has no connector
        read_store(spark, "mongodb", uri="mongodb://h", table="t")
