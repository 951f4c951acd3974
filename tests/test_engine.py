import duckdb
import pytest

from weft import queries as core
from weft.catalog import Overrides
from weft.engine import Engine, Hooks, Options
from weft.functions.cost import Budget, Estimator, bucket, saturating_sum
from weft.functions.policy import User
from weft.gql.normalize import normalize
from weft.gql.syntax import GraphQLError, parse
from weft.gql.validate import Limits

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def engine(spark):
    return core.engine(spark, SF)


def cell(x):
    if x is None or x != x:
        return "~"
    return repr(float(x)) if isinstance(x, int | float) else str(x)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(core.ORACLES[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())


def test_golden_plans(engine):
    r = engine.query("{ orders { o_orderkey customer { c_name nation { n_name } } lineItems { part { shipping } } } }")
    assert r.explain() == "\n".join([
        "Root orders: [Order!]! from SALES",
        "  Scan SALES.Order [o_orderkey, o_custkey]",
        "  Object customer as Customer on {'o_custkey': 'c_custkey'}",
        "    Key SALES.Customer [c_custkey]",
        "    KeyJoin ACCOUNTS.Customer on (c_custkey) [c_name, c_nationkey]",
        "    Object nation as Nation on {'c_nationkey': 'n_nationkey'}",
        "      Key ACCOUNTS.Nation [n_nationkey]",
        "      KeyJoin GEO.Nation on (n_nationkey) [n_name]",
        "  NestList lineItems as LineItem on {'o_orderkey': 'l_orderkey'}",
        "    Scan SALES.LineItem [l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity]",
        "    Object part as Part on {'l_partkey': 'p_partkey'}",
        "      Key SALES.Part [p_partkey]",
        "      KeyJoin CATALOG.Part on (p_partkey) [p_retailprice, p_size]",
        "      KeyJoin STOCK.Part on (p_partkey) []",
        "      Compute shipping in STOCK from (p_retailprice, p_size)",
    ])


def test_provides_reads_no_other_source(engine):
    r = engine.query("{ events { user { c_custkey c_name } } }")
    assert r.reads == 1 and "Join" not in r.df._jdf.queryExecution().executedPlan().toString()


def test_overrides_move_the_read(spark):
    for flags, source in ((frozenset(), "CATALOG"), (frozenset({"brand_in_stock"}), "STOCK")):
        r = core.engine(spark, SF, Options(overrides=Overrides(flags))).query("{ parts { p_brand } }")
        assert ("KeyJoin STOCK" in r.explain()) == (source == "STOCK")


def test_shared_roots_are_merged_by_their_order(spark):
    e = core.engine(spark, SF)
    plan = e.query("{ skus { p_partkey p_name p_size } }").explain()
    assert plan == "\n".join(["Root skus: [Sku!]! from CATALOG", "  Scan CATALOG.Sku [p_partkey, p_name]", "  KeyJoin STOCK.Sku on (p_partkey) [p_size]"])
    assert e.query("{ skus { p_size } }").reads == 1
    e.root("stock", "skus")  # nothing to merge by
    with pytest.raises(GraphQLError) as x:
        e.query("{ skus { p_name p_size } }")
    assert x.value.code == "UNPLANNABLE"


def test_value_errors_below_lists(spark):
    e = Engine(spark, "type Query { boxes: [Box!]! } type Box { id: Int tones: [Tone] many: [[Tone!]] tone: Tone! inner: [Box] } enum Tone { LOW HIGH }")
    rows = spark.createDataFrame([(1, ["LOW", "bad", None], [["odd"], None, ["HIGH"]], "bad", None), (2, None, None, "LOW", 1)], "id int, tones array<string>, many array<array<string>>, tone string, up int")
    e.source("main", "Box", rows).root("main", "boxes", ("id",)).link("main", "Box.inner", {"id": "up"})
    r = e.query("{ boxes { id tones many tone inner { t: tone } } }")
    got = {(x.path, x.value, x.n) for x in e.value_errors(r, "boxes").collect()}
    assert got == {("boxes.tones", "bad", 1), ("boxes.many", "odd", 1), ("boxes.tone", "bad", 1)}


def test_the_operation_without_refused_fields(spark):
    e = core.engine(spark, SF)
    o = Options(operation_filter=lambda t, f: f not in ("r_name", "n_name"))
    got = e.allowed("query Q($k: Int) { regions { r_name nations { n_name } } customers(c_custkey: $k) { c_name nation { n_name region { r_regionkey } } } }", {"k": 1}, o)
    assert got.split() == "query Q { customers(c_custkey: 1) { c_name nation { region { r_regionkey } } } }".split()


def test_filters_reach_the_scan(engine):
    plan = engine.query("{ customers(c_custkey: 3) { c_name } }").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,3)" in plan and "c_acctbal" not in plan.split("ReadSchema")[1]


def test_json_keeps_nulls(engine):
    assert engine.query("{ documents { doc_id quality } }").json().filter("json LIKE '%\"quality\":null%'").count() > 0


def test_policy_errors_and_rejection(spark):
    r = core.engine(spark, SF).query("{ customers { c_acctbal } }")
    assert [(e.code, e.path) for e in r.errors] == [("UNAUTHORIZED_FIELD_OR_TYPE", ("Customer", "c_acctbal"))] and r.errors_frame(spark).count() == 1
    with pytest.raises(GraphQLError):
        core.engine(spark, SF, Options(reject_unauthorized=True)).query("{ customers { c_acctbal } }")
    assert core.engine(spark, SF, Options(user=User(True, frozenset({"admin"})))).query("{ customers { c_acctbal } }").errors == []


def test_budgets(spark):
    text = "{ customers(first: 2) { orders { o_orderkey } } }"
    with pytest.raises(GraphQLError) as e:
        core.engine(spark, SF, Options(budget=Budget(most=5))).query(text)
    assert e.value.code == "COST_ESTIMATED_TOO_EXPENSIVE"
    assert core.engine(spark, SF, Options(budget=Budget(most=5, enforce=False))).query(text).estimated_cost == 2 * (1 + 10 * 2)
    for name in ("SALES", "sales"):  # the one read is left out: a list that must not be null takes its customer along
        r = core.engine(spark, SF, Options(budget=Budget(per_source={name: 1}))).query("{ customers(first: 2) { c_custkey orders { o_orderkey } } }")
        assert [(e.code, e.path) for e in r.errors] == [("COST_SOURCE_TOO_EXPENSIVE", ("customers", "orders"))] and [tuple(x) for x in r.df.collect()] == [(None, None)] * 2
    r = core.engine(spark, SF, Options(budget=Budget(per_source={"accounts": 0}))).query(text)
    assert r.frames == {} and r.errors[0].path == ("customers",)
    with pytest.raises(GraphQLError):
        core.engine(spark, SF, Options(budget=Budget(per_source={"nowhere": 1}))).query(text)
    with pytest.raises(GraphQLError) as e:
        core.engine(spark, SF).subscribe("subscription { eventAdded { event_id } }", options=Options(budget=Budget(most=0)))
    assert e.value.code == "COST_ESTIMATED_TOO_EXPENSIVE"
    with pytest.raises(GraphQLError):
        core.engine(spark, SF).subscribe("subscription { eventAdded { event_id } }", options=Options(budget=Budget(per_source={"activity": 0})))


def test_cache_never_widens_access(spark):
    """Each answer is the same cold, and warm after a more permissive call."""
    e, text = core.engine(spark, SF), "{ customers { c_acctbal nation { region { r_name } } } }"
    admin = Options(user=User(True, frozenset({"admin"})))
    assert e.query(text, options=admin).errors == [] and len(e.query(text).errors) == 1
    for o in (Options(reject_unauthorized=True), Options(limits=Limits(depth=1)), Options(user=User(), limits=Limits(aliases=0, depth=2))):
        with pytest.raises(GraphQLError):
            e.query(text, options=o)
    e.rules = (lambda c: ["no"],)
    e.rules[0].__name__ = "never"
    with pytest.raises(GraphQLError):
        e.query(text, options=admin)
    e.rules = ()
    assert e.prepare(text, options=admin) is e.prepare(text, options=admin) and e.counters["plan_cache_hits"] >= 1
    before = e.prepare(text, options=admin)
    e.source("accounts", "Customer", f"{SF}/customer.parquet")  # other sources: another plan
    assert e.prepare(text, options=admin) is not before
    stream = "subscription { eventAdded { event_id } }"
    prints = [e.fingerprint(stream, options=o) for o in (Options(), admin, Options(operation_filter=lambda t, f: True), Options(operation_filter=lambda t, f: False), Options(overrides=Overrides(frozenset({"x"}))), Options(user=User(True)))]
    assert len(set(prints)) == len(prints) and e.fingerprint(stream, options=admin) == prints[1]


def test_frames_are_cached_apart(spark, tmp_path):
    """A repeated operation is not lowered again; its frames share no execution, and a changed table,
    user, budget or session setting gives a frame of its own."""
    e = core.engine(spark, SF)
    lowered = []
    plain = e.lower
    e.lower = lambda *a, **k: lowered.append(a) or plain(*a, **k)
    text = "{ customers(first: 3) { c_custkey c_acctbal orders(last: 1) { o_orderkey } } }"
    one, two = e.query(text).df, e.query(text).df
    assert len(lowered) == 1 and one is not two and one.collect() == two.collect()
    assert one._jdf.queryExecution() != two._jdf.queryExecution()
    assert all(r.c_acctbal is None for r in one.collect())
    full = e.query(text, options=Options(user=User(True, frozenset({"read:balance"})))).df
    assert len(lowered) == 2 and all(r.c_acctbal is not None for r in full.collect())
    cut = e.query(text, options=Options(budget=Budget(per_source={"sales": 0}))).df
    assert len(lowered) == 3 and all(r.orders is None for r in cut.collect())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        e.query(text)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(lowered) == 4
    assert all(r.c_acctbal is None for r in e.query(text).df.collect()) and len(lowered) == 4
    spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey > 100").write.parquet(str(tmp_path / "c"))
    e.source("accounts", "Customer", str(tmp_path / "c"), unique=("c_custkey",))
    assert [r.c_custkey for r in e.query(text).df.collect()] == [101, 102, 103] and len(lowered) == 5


def test_costs_add_up(spark):
    for text in ("{ customers(first: 3) { c_custkey nation { n_name region { r_name } } orders(first: 2) { firstFlag lineItems { part { shipping } } } } }", "{ pieces { doc_id quality } }", "{ parts(first: 2) { shippingBand p_brand } }"):
        r = core.engine(spark, SF, Options(budget=Budget(default_list_size=4))).query(text)
        assert r.estimated_cost == sum(r.cost_by_source.values()) == sum(r.cost_by_fetch.values()) >= r.shape_cost > 0


def test_reentry_is_bounded(spark, monkeypatch):
    from weft.operators import lower

    monkeypatch.setattr(lower, "REENTRY", 50)
    e = core.engine(spark, SF)
    assert len(e.query("{ regions { query { nations { n_name } } } }").df.first().query.nations) == 25
    assert len(e.query("{ regions { query { orders(first: 7) { o_orderkey } } } }").df.first().query.orders) == 7
    with pytest.raises(GraphQLError) as x:
        e.query("{ regions { query { orders { o_orderkey } } } }")
    assert x.value.code == "UNBOUNDED_REENTRY"


def test_estimates():
    sdl = """type Query { book: Book books(limit: Int): [Book!]! @listSize(slicingArguments: ["limit"]) best: [Book!]! @listSize(assumedSize: 5)
      page(first: Int): Page @listSize(slicingArguments: ["first"], sizedFields: ["items"]) any(q: In): Int }
    type Page { items: [Book!]! total: Int } type Mutation { touch: Int make: Book }
    type Book { title: String @cost(weight: 3) author: Person publisher: Firm } type Person { name: String } type Firm { address: Place } type Place @cost(weight: 5) { zip: String }
    input In { a: Int @cost(weight: 2) more: [In!] }"""
    from weft.catalog import Catalog

    c = Catalog(sdl)

    def cost(text):
        op = normalize(c, parse(text), None, {})
        return Estimator(c).operation(op.kind, op.selections)

    assert cost("{ book { author { name } publisher { address { zip } } } }") == 8
    assert cost("{ best { author { name } publisher { address { zip } } } }") == 40
    assert cost("{ books(limit: 3) { author { name } publisher { address { zip } } } }") == 24
    assert cost("{ page(first: 5) { items { author { name } publisher { address { zip } } } total } }") == 41
    assert cost("{ book { title } }") == 4 and cost("mutation { touch }") == 10 and cost("mutation { make { author { name } } }") == 12
    assert cost("{ any(q: {a: 1, more: [{a: 2}, {}]}) }") == 3 + 2 + 2
    with pytest.raises(GraphQLError):
        cost("{ books { title } }")


def test_saturating_and_buckets(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(saturating_sum(F.lit(2**63 - 1), F.lit(5)).alias("s"), bucket(F.lit(51)).alias("b"), bucket(F.lit(99999)).alias("over")).first()
    assert (r.s, r.b, r.over) == (2**63 - 1, 200, None)


NODES = """
enum join__Graph { A @join__graph(name: "a") B @join__graph(name: "b") C @join__graph(name: "c") }
type Query { things: [Thing!]! @join__field(graph: A) again: Again @join__field(graph: A) shapes: [Shape!] @join__field(graph: A) }
type Again @join__type(graph: A) { id: Int query: Query }
type Thing @join__type(graph: A, key: "id") @join__type(graph: B, key: "id") @join__type(graph: B, key: "org { no } sku") @join__type(graph: C, key: "org { no } sku") {
  id: Int! @join__field(graph: A) @join__field(graph: B) sku: String @join__field(graph: B) @join__field(graph: C) b: String @join__field(graph: B) c: String @join__field(graph: C) must: String! @join__field(graph: C) shape: Shape @join__field(graph: A) }
union Shape @join__type(graph: A) @join__unionMember(graph: A, member: "Circle") @join__unionMember(graph: A, member: "Square") = Circle | Square
type Circle @join__type(graph: A, key: "id") { id: Int! size: Int }
type Square @join__type(graph: A, key: "id") { id: Int! size: Int }
"""


@pytest.fixture
def nodes(spark):
    e = Engine(spark, NODES)
    a = spark.createDataFrame([(1, "Circle", 10), (2, "Square", 20), (3, None, None)], "id int, kind string, shape_id int")
    b = spark.createDataFrame([(1, 7, "x", "b1"), (2, 8, "y", "b2")], "id int, no int, sku string, b string")
    c = spark.createDataFrame([(7, "x", "c1", "m")], "no int, sku string, c string, must string")
    e.source("a", "Thing", a).source("b", "Thing", b, {"org.no": "no"}).source("c", "Thing", c, {"org.no": "no"})
    e.source("a", "Circle", spark.createDataFrame([(10, 5)], "id int, size int")).source("a", "Square", spark.createDataFrame([(20, 2**40)], "id int, size long"))
    e.source("a", "Again", spark.createDataFrame([(1,)], "id int"))
    e.link("a", "Thing.shape", {"shape_id": "id"}, tag="kind").root("a", "things", ("id",)).root("a", "again").root("a", "shapes", ("id",))
    return e


def test_two_hops_by_a_nested_key(nodes):
    r = nodes.query("{ things { id c } }")
    assert "KeyJoin B.Thing on (id) [org.no, sku]\n  KeyJoin C.Thing on (org.no, sku) [c]" in r.explain()
    assert {(x.id, x.c) for x in r.df.collect()} == {(1, "c1"), (2, None), (3, None)}


def test_null_in_a_required_field_takes_the_object(nodes):
    rows = [tuple(x) for x in nodes.query("{ things { id must } }").df.collect()]
    assert sorted(rows, key=str) == [(1, "m"), (None, None), (None, None)]
    assert nodes.query("{ things { id must } }", options=Options(root_nulls="spec")).df.count() == 0


def test_clashing_types_get_fields_of_their_own(nodes):
    rows = nodes.query("{ things { id shape { __typename ... on Circle { size } ... on Square { size } } } }").df.collect()
    by = {r.id: r.shape for r in rows}
    assert (by[1]["__typename"], by[1].size__Circle, by[2].size__Square, by[3]) == ("Circle", 5, 2**40, None)
    assert nodes.query("{ shapes { __typename ... on Circle { id } } }").df.count() == 2


def test_back_to_the_root(nodes):
    row = nodes.query("{ again { id query { things { id } } } }").df.first()
    assert len(row.query.things) == 3


def test_hooks_stored_operations_and_cache(spark, nodes):
    class Log(Hooks):
        def __init__(self):
            self.seen = []

        def on_parse(self, text):
            self.seen.append("parse")

        def on_source(self, source, type_name, df):
            return df.filter("id = 1") if type_name == "Thing" and source == "A" else None

        def on_execute(self, key, df):
            self.seen.append(key)

    nodes.store({"t": "{ things { id } }"})
    assert nodes.query(id="t").df.count() == 3 and nodes.prepare(id="t") is nodes.prepare(id="t")
    nodes.hooks.append(log := Log())
    assert nodes.query(id="t").df.count() == 1 and log.seen == ["parse", "things"]
    with pytest.raises(GraphQLError):
        nodes.query(id="nope")


def test_unplannable_and_introspection(nodes, engine):
    nodes.registry.tables.pop(("C", "Thing"))
    with pytest.raises(GraphQLError):
        nodes.query("{ things { c } }")
    got = engine.query('{ __type(name: "Nation") { kind name fields { name type { kind name ofType { name } } } } __schema { queryType { name } } }').introspection
    assert got["__type"]["fields"][0] == {"name": "n_nationkey", "type": {"kind": "NON_NULL", "name": None, "ofType": {"name": "Int"}}} and got["__schema"]["queryType"] == {"name": "Query"}
    with pytest.raises(GraphQLError):
        engine.query("{ __schema { queryType { name } } }", options=Options(introspection=False))


def test_lookups_take_one_row_of_each_key(nodes, spark):
    twice = spark.createDataFrame([(1, 7, "x", "b1"), (1, 7, "x", "b0"), (2, 8, "y", "b2")], "id int, no int, sku string, b string")
    nodes.source("b", "Thing", twice, {"org.no": "no"}).source("a", "Circle", spark.createDataFrame([(10, 5), (10, 4)], "id int, size int"))
    assert sorted((r.id, r.b, r.shape and r.shape.size__Circle) for r in nodes.query("{ things { id b shape { ... on Circle { size } ... on Square { size } } } }").df.collect()) == [(1, "b0", 4), (2, "b2", None), (3, None, None)]


def test_unordered_slices_hold(nodes, spark):
    nodes.source("a", "Again", spark.createDataFrame([(i,) for i in range(9)], "id int"))
    assert nodes.query("{ again { id } }").df.count() == 9


def test_listeners_share_a_stream_and_errors_stop_it(spark, tmp_path):
    e = core.engine(spark, SF)
    text = "subscription { eventAdded { event_id } }"
    key, heard = e.fingerprint(text), [[], []]
    go = lambda i: e.subscriptions.listen(key, e.subscribe(text), f"file://{tmp_path}/c", lambda b, n: heard[i].append(b.count()), available_now=False)
    assert go(0) is go(1)
    e.subscriptions.running[key].processAllAvailable()
    assert sum(heard[0]) == 1000 >= sum(heard[1])

    def bad(batch, number):
        raise ValueError("broken")

    q = e.subscriptions.listen("other", e.subscribe(text), f"file://{tmp_path}/d", bad)
    with pytest.raises(Exception, match="broken"):
        q.awaitTermination()
    assert e.subscriptions.error("other")[0] == "SUBSCRIPTION_ERROR" and not q.isActive
    e.reload(core.SDL)
    assert e.subscriptions.error(key) == ("SUBSCRIPTION_SCHEMA_RELOAD", "the schema was replaced")


def test_reload_ends_subscriptions(spark, tmp_path):
    e = core.engine(spark, SF)
    text = "subscription { eventAdded { event_id } }"
    q = e.subscriptions.start(e.fingerprint(text), e.subscribe(text), f"file://{tmp_path}/c", name="sub_rows", available_now=False)
    assert e.subscriptions.start(e.fingerprint(text), e.subscribe(text), f"file://{tmp_path}/c") is q
    q.processAllAvailable()
    assert spark.table("sub_rows").count() == 1000
    e.reload(core.SDL)
    assert not q.isActive and e.subscriptions.running == {}
