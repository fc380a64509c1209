"""Plans: what is scanned, joined, shuffled and pruned; and joins against brute force."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from quadweave import Mapping, parent, ref, table, template, triples_map
from quadweave.errors import MappingError
from quadweave.plans.rewrite import invert_template

V = "http://example.org/"
BASE = "http://example.com/base/"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("people") / "p")
    spark.range(1000).select(
        "id", F.concat(F.lit("n "), "id").alias("name"), (F.col("id") % 7).alias("boss"), F.lit("x").alias("unused")
    ).write.parquet(path)
    return spark.read.parquet(path)


PEOPLE = table("people", unique=["id"])


def person():
    item = triples_map("p", PEOPLE, template("p/{id}"), classes=V + "Person")
    return item.add(V + "name", ref("name")).add(V + "boss", template("p/{boss}"))


def test_one_scan_and_only_needed_columns(spark, people):
    plan = plan_of(Mapping.of(person()).run(spark, {"people": people}))
    assert plan.count("FileScan") == 1 and "unused" not in plan and "Exchange" not in plan


def test_select_prunes_branches_and_columns(spark, people):
    frame = Mapping.of(person()).select(predicates=[V + "name"]).run(spark, {"people": people})
    assert "boss" not in plan_of(frame) and frame.count() == 1000
    frame = Mapping.of(person()).select(classes=[V + "Other"], predicates=[V + "boss"]).run(spark, {"people": people})
    assert {r.p for r in frame.select("p").distinct().collect()} == {V + "boss"}


def test_select_filters_what_only_rows_can_tell(spark, people):
    item = triples_map("p", PEOPLE, template("p/{id}")).add(template(V + "b{boss}"), ref("name"), template(V + "g{boss}"))
    mapping = Mapping.of(item)
    assert mapping.select(predicates=[V + "b3"]).run(spark, {"people": people}).count() == 143
    assert mapping.select(graphs=[V + "g3"]).run(spark, {"people": people}).count() == 143
    assert mapping.select(graphs=[None]).run(spark, {"people": people}).count() == 0


def test_subject_lookup_reaches_the_scan(spark, people):
    frame = Mapping.of(person()).run(spark, {"people": people}, subject=BASE + "p/42")
    assert "EqualTo(id,42)" in plan_of(frame)
    assert sorted(r.o for r in frame.collect()) == [BASE + "p/0", V + "Person", "n 42"]
    for other in ("p/042", "q/42", "p/42/", "p/"):
        assert Mapping.of(person()).run(spark, {"people": people}, subject=BASE + other).count() == 0


@settings(max_examples=200, deadline=None)
@given(st_.lists(st_.text(alphabet="abc-/_. é%", min_size=0, max_size=4), min_size=2, max_size=2))
def test_template_inversion_finds_the_values(values):
    from urllib.parse import quote

    term = template("http://x/{a}/y-/{b}")
    iri = "http://x/{}/y-/{}".format(*[quote(v, safe="-._~") for v in values])
    assert invert_template(term, BASE, iri) == {"a": values[0], "b": values[1]}


def test_ambiguous_templates_are_not_inverted():
    assert invert_template(template("http://x/{a}-{b}"), BASE, "http://x/1-2-3") is True
    assert invert_template(template("{a}"), BASE, BASE + "1") is True


def test_distinct_needs_no_shuffle_with_a_declared_key(spark, people):
    assert "Exchange" not in plan_of(Mapping.of(person()).run(spark, {"people": people}, distinct=True))
    other = triples_map("p", table("people"), template("p/{id}"), classes=V + "Person")
    assert "Exchange" in plan_of(Mapping.of(other).run(spark, {"people": people}, distinct=True))


@pytest.mark.parametrize(
    "extra",
    [
        lambda: person().add(V + "name", ref("boss")),  # same predicate twice
        lambda: triples_map("p", PEOPLE, template("p/{boss}"), classes=V + "Person"),  # no key in the subject
        lambda: triples_map("p", PEOPLE, template("p/{boss}{id}"), classes=V + "Person"),  # 1|23 and 12|3
        lambda: person().add(template(V + "{name}"), ref("boss")),  # predicate known per row only
    ],
)
def test_distinct_is_kept_where_copies_are_possible(spark, people, extra):
    assert "Exchange" in plan_of(Mapping.of(extra()).run(spark, {"people": people}, distinct=True))


def test_same_subjects_in_two_maps_keep_distinct(spark, people):
    both = Mapping.of(person(), triples_map("q", PEOPLE, template("p/{id}"), classes=V + "Person"))
    frame = both.run(spark, {"people": people}, distinct=True)
    assert frame.count() == 3000


# --- joins -------------------------------------------------------------------------------------


def test_existence_join_moves_keys_only(spark, people):
    child = triples_map("c", table("people"), template("p/{id}")).add(V + "boss", parent("b", ("boss", "id")))
    frame = Mapping.of(child, triples_map("b", table("people"), template("p/{id}"))).run(spark, {"people": people})
    plan = plan_of(frame)
    assert "LeftSemi" in plan and "HashAggregate" not in plan
    assert frame.count() == 1000


def test_self_join_on_a_key_is_no_join(spark, people):
    child = triples_map("c", PEOPLE, template("p/{id}")).add(V + "same", parent("b", ("id", "id")))
    frame = Mapping.of(child, triples_map("b", PEOPLE, template("n/{name}"))).run(spark, {"people": people})
    assert "Join" not in plan_of(frame) and frame.count() == 1000


def brute_force(children, parents, subject):
    result = []
    for child in children:
        found = {subject(p) for p in parents if None not in (child["k"], p["k"]) and str(child["k"]) == str(p["k"])}
        result += [(child["id"], s) for s in found]
    return sorted(result)


@pytest.mark.parametrize("child_type, parent_type", [("int", "int"), ("string", "int"), ("int", "bigint"), ("string", "string")])
def test_joins_against_brute_force(spark, child_type, parent_type):
    """A third of all rows share one key on the child side; keys repeat and are missing on both sides."""
    rng = random.Random(5)
    children = [{"id": i, "k": None if i % 10 == 0 else 3 if i % 3 == 0 else rng.randrange(30)} for i in range(300)]
    parents = [{"name": f"n{i % 25}", "k": None if i % 9 == 0 else rng.randrange(30)} for i in range(80)]
    child = spark.createDataFrame(children, "id int, k int").withColumn("k", F.col("k").cast(child_type))
    mother = spark.createDataFrame(parents, "name string, k int").withColumn("k", F.col("k").cast(parent_type))
    mapping = Mapping.of(
        triples_map("c", table("c"), template("c/{id}")).add(V + "p", parent("p", ("k", "k"))),
        triples_map("p", table("p"), template("p/{name}")),
    )
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            rows = mapping.run(spark, {"c": child, "p": mother}).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        got = sorted((int(r.s.rpartition("/")[2]), r.o[len(BASE) :]) for r in rows)
        assert got == brute_force(children, parents, lambda p: f"p/{p['name']}")


def test_multi_valued_join_key(spark):
    child = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id int, ks array<string>")
    mother = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "k string, name string")
    mapping = Mapping.of(
        triples_map("c", table("c"), template("c/{id}")).add(V + "p", parent("p", ("ks", "k"))),
        triples_map("p", table("p"), template("p/{name}")),
    )
    rows = mapping.run(spark, {"c": child, "p": mother}).collect()
    assert sorted(r.o for r in rows) == [BASE + "p/A", BASE + "p/B"]


def test_parent_without_join_needs_the_same_source(spark, people):
    mapping = Mapping.of(
        triples_map("c", table("people"), template("c/{id}")).add(V + "p", parent("p")),
        triples_map("p", table("other"), template("p/{id}")),
    )
    with pytest.raises(MappingError, match="sources differ"):
        mapping.run(spark, {"people": people, "other": people})


def test_two_predicates_and_two_graphs_on_a_join(spark, people):
    child = triples_map("c", PEOPLE, template("p/{id}"))
    child = child.add([V + "a", V + "b"], parent("b", ("boss", "id")), [V + "g", V + "h"])
    frame = Mapping.of(child, triples_map("b", PEOPLE, template("n/{name}"))).run(spark, {"people": people})
    got = {(r.p, r.g): r["count"] for r in frame.groupBy("p", "g").count().collect()}
    assert got == {key: 1000 for key in itertools.product([V + "a", V + "b"], [V + "g", V + "h"])}


def test_hot_join_keys_are_split(spark, tmp_path):
    """A third of the child rows share one key: the sort-merge join reads that partition in pieces."""
    settings_ = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    spark.range(0, 300_000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k")
    ).write.parquet(str(tmp_path / "c"))
    spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")).write.parquet(
        str(tmp_path / "p")
    )
    mapping = Mapping.of(
        triples_map("c", table("c"), template("c/{id}")).add(V + "p", parent("p", ("k", "k"))),
        triples_map("p", table("p"), template("p/{name}")),
    )
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        frame = mapping.run(
            spark, {"c": spark.read.parquet(str(tmp_path / "c")), "p": spark.read.parquet(str(tmp_path / "p"))}
        )
        rows = frame.groupBy("o").count().orderBy(F.desc("count")).limit(1).collect()
        assert rows[0]["count"] == 100_200 and frame.count() == 300_000
        frame.write.format("noop").mode("overwrite").save()
        frame.collect()
        assert "skew=true" in plan_of(frame)
    finally:
        for key in settings_:
            spark.conf.unset(key)


def test_join_shuffles_source_columns_not_terms(spark, people):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        child = triples_map("c", PEOPLE, template("p/{id}")).add(V + "boss", parent("b", ("boss", "id")))
        frame = Mapping.of(child, triples_map("b", PEOPLE, template("n/{name}"))).run(spark, {"people": people})
        plan = plan_of(frame)
        assert plan.count("Exchange") == 2 and plan.index("concat(") < plan.index("SortMergeJoin")
        assert "concat(" not in plan[plan.index("SortMergeJoin") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distinct_is_taken_on_source_columns(spark, people):
    item = triples_map("p", table("people"), template("p/{boss}"), classes=V + "Boss")
    frame = Mapping.of(item).run(spark, {"people": people}, distinct=True)
    assert frame.count() == 7 and "Exchange hashpartitioning(boss#" in plan_of(frame)
    # A limit is taken on what is generated, copies included.
    assert Mapping.of(item).run(spark, {"people": people}, distinct=True, limit=1000).count() == 7


def test_iris_that_meet_at_the_base_are_one(spark):
    frame = spark.createDataFrame([("x",), (BASE + "x",), ("y",)], "u string")
    mapping = Mapping.of(triples_map("t", table("t", unique=["u"]), ref("u", term_type="iri"), classes=V + "T"))
    assert mapping.run(spark, {"t": frame}).count() == 3
    assert mapping.run(spark, {"t": frame}, distinct=True).count() == 2
    child = triples_map("c", table("t"), template("c/{u}")).add(V + "p", parent("p", ("k", "k")))
    frame = frame.withColumn("k", F.lit(1))
    both = Mapping.of(child, triples_map("p", table("t"), ref("u", term_type="iri")))
    assert both.run(spark, {"t": frame}).count() == 3 * 2


def test_parent_join_on_a_key_with_several_values(spark):
    child = spark.createDataFrame([(1, ["a", "b"])], "id int, ks array<string>")
    owner = spark.createDataFrame([("a",), ("c",)], "k string")
    mapping = Mapping.of(
        triples_map("owner", table("owner"), template("p/{k}"), classes="http://example.org/P"),
        triples_map("child", table("child"), template("c/{id}")).add("http://example.org/in", parent("owner", ("ks", "k"))),
    )
    rows = mapping.run(spark, {"owner": owner, "child": child}).where("p = 'http://example.org/in'").collect()
    assert [r.o.rsplit("/", 2)[-2:] for r in rows] == [["p", "a"]]


# --- parents joined onto the child's scan ------------------------------------------------------


@pytest.fixture(scope="module")
def ferries(spark, tmp_path_factory):
    """Trips with a ferry, two ports (some unknown or missing) and a captain; tables on disk, so that plans show scans."""
    root = tmp_path_factory.mktemp("ferries")
    trips = spark.range(400).select(
        F.col("id").alias("trip"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 9).alias("ferry"),
        (F.col("id") % 13).alias("start"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 13).alias("end"),
        F.concat(F.lit("note "), F.col("id")).alias("note"),
    )
    ports = spark.range(10).select(F.col("id").alias("port"), F.concat(F.lit("port "), "id").alias("title"))
    boats = spark.range(8).select(F.col("id").alias("boat"), F.when(F.col("id") != 3, F.concat(F.lit("b"), "id")).alias("sign"))
    tables = {}
    for name, frame in (("trips", trips), ("ports", ports), ("boats", boats)):
        frame.write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    return tables


TRIPS, PORTS, BOATS = table("trips", unique=["trip"]), table("ports", unique=["port"]), table("boats", unique=["boat"])


def ferry_mapping(*, boats=BOATS):
    return Mapping.of(
        triples_map("trip", TRIPS, template("trip/{trip}"), classes=V + "Trip")
        .add(V + "note", ref("note"))
        .add(V + "start", parent("port", ("start", "port")))
        .add([V + "end", V + "last"], parent("port", ("end", "port")), [V + "g1", V + "g2"])
        .add(V + "boat", parent("boat", ("ferry", "boat")))
        .add(V + "known", parent("exists", ("start", "port")))
        .add(V + "itself", parent("self", ("trip", "trip"))),
        triples_map("port", PORTS, template("port/{title}")),
        triples_map("exists", PORTS, template("p/{port}")),
        triples_map("boat", boats, template("boat/{sign}")),
        triples_map("self", TRIPS, template("self/{note}")),
    )


def ferry_statements():
    found = []
    for i in range(400):
        s = f"{BASE}trip/{i}"
        found += [(s, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", V + "Trip", None), (s, V + "note", f"note {i}", None)]
        found.append((s, V + "itself", f"{BASE}self/note%20{i}", None))
        if i % 13 < 10:
            found += [(s, V + "start", f"{BASE}port/port%20{i % 13}", None), (s, V + "known", f"{BASE}p/{i % 13}", None)]
            if i % 5:
                found += [
                    (s, V + p, f"{BASE}port/port%20{i % 13}", V + g) for p in ("end", "last") for g in ("g1", "g2")
                ]
        if i % 11 and i % 9 < 8 and i % 9 != 3:
            found.append((s, V + "boat", f"{BASE}boat/b{i % 9}", None))
    return sorted(found, key=str)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_parents_share_one_scan_of_the_child(spark, ferries, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        frame = ferry_mapping().run(spark, ferries, base_iri=BASE)
        found = sorted(map(tuple, frame.select("s", "p", "o", "g").collect()), key=str)
        plan = plan_of(frame)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == ferry_statements()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("/trips]") == 1 and initial.count("LeftOuter") == 4 and "Union" not in initial


def test_joins_on_one_key_distribute_the_child_once(spark, ferries):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(ferry_mapping().run(spark, ferries))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # of the child for start, end and ferry, where start serves two joins; of every parent once
    assert plan.count("Exchange hashpartitioning(start") == 1 and plan.count("Exchange hashpartitioning") == 7


def test_a_parent_without_a_key_stays_apart(spark, ferries):
    frame = ferry_mapping(boats=table("boats")).run(spark, ferries, base_iri=BASE)
    assert sorted(map(tuple, frame.select("s", "p", "o", "g").collect()), key=str) == ferry_statements()
    assert plan_of(frame).split("Initial Plan")[-1].count("/trips]") == 2


def test_a_lookup_by_subject_narrows_the_shared_scan(spark, ferries):
    frame = ferry_mapping().run(spark, ferries, base_iri=BASE, subject=f"{BASE}trip/7")
    assert frame.count() == sum(s == f"{BASE}trip/7" for s, *_ in ferry_statements()) > 5
    assert "EqualTo(trip,7)" in plan_of(frame)


def test_a_constant_parent_needs_its_row(spark, ferries):
    item = triples_map("trip", TRIPS, template("trip/{trip}")).add(V + "note", ref("note"))
    item = item.add(V + "start", parent("any", ("start", "port")))
    mapping = Mapping.of(item, triples_map("any", PORTS, template("harbour")))
    found = mapping.run(spark, ferries, base_iri=BASE).where(F.col("p") == V + "start")
    assert {r.o for r in found.collect()} == {BASE + "harbour"} and found.count() == sum(i % 13 < 10 for i in range(400))
