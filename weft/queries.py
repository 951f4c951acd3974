"""The test tables as a federation of sources, and the registered queries over it.

Results are flattened to scalar columns; lists are compared as exploded rows, counts or sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import cache, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalog import Catalog, Overrides
from weft.engine import Engine, Hooks, Options
from weft.functions import usage
from weft.functions.cost import BUCKETS, Budget, Estimator
from weft.functions.introspect import Introspection
from weft.functions.policy import User
from weft.gql.normalize import normalize
from weft.gql.syntax import GraphQLError, document_hash, parse, parse_selections, print_document
from weft.gql.validate import Limits, validate
from weft.storage import shared_dir

SDL = """
schema { query: Query mutation: Mutation subscription: Subscription }
directive @authenticated on FIELD_DEFINITION | OBJECT
directive @requiresScopes(scopes: [[String!]!]!) on FIELD_DEFINITION | OBJECT
enum join__Graph {
  GEO @join__graph(name: "geo") ACCOUNTS @join__graph(name: "accounts") CATALOG @join__graph(name: "catalog")
  SALES @join__graph(name: "sales") ACTIVITY @join__graph(name: "activity") CORPUS @join__graph(name: "corpus")
  RATINGS @join__graph(name: "ratings") VECTORS @join__graph(name: "vectors") STOCK @join__graph(name: "stock") SHIPPING @join__graph(name: "shipping") CHATS @join__graph(name: "chats")
}
enum Status { O F }
enum EventType { view signup purchase error click }
scalar JSON
type Query {
  regions: [Region!]! @join__field(graph: GEO)
  nations: [Nation!]! @join__field(graph: GEO)
  customers(c_custkey: Int, c_mktsegment: String, first: Int, last: Int): [Customer!]! @join__field(graph: ACCOUNTS) @listSize(slicingArguments: ["first"], requireOneSlicingArgument: false)
  parties: [Party!]! @join__field(graph: ACCOUNTS)
  suppliers: [Supplier!]! @join__field(graph: CATALOG)
  parts(first: Int, last: Int, p_partkey: Int): [Part!]! @join__field(graph: CATALOG) @listSize(slicingArguments: ["first"], requireOneSlicingArgument: false)
  orders(first: Int, o_orderkey: Int): [Order!]! @join__field(graph: SALES) @listSize(slicingArguments: ["first"], requireOneSlicingArgument: false)
  events(event_type: EventType, first: Int): [Event!]! @join__field(graph: ACTIVITY)
  documents: [Document!]! @join__field(graph: CORPUS)
  pieces: [Piece!]! @join__field(graph: CORPUS)
  scores: [Piece]! @join__field(graph: RATINGS)
  notes: [Note!]! @join__field(graph: RATINGS)
  turns: [Turn!]! @join__field(graph: CHATS)
  embeddings: [Embedding!]! @join__field(graph: VECTORS)
  skus(first: Int): [Sku!]! @join__field(graph: CATALOG) @join__field(graph: STOCK)
}
type Mutation { reprice(percent: Int!): [Part!]! @join__field(graph: CATALOG) }
type Subscription { eventAdded(event_type: EventType): Event! @join__field(graph: ACTIVITY) }
type Region @join__type(graph: GEO, key: "r_regionkey") { r_regionkey: Int! r_name: String nations: [Nation!]! query: Query @join__field(graph: GEO) }
type Nation @join__type(graph: GEO, key: "n_nationkey") @join__type(graph: ACCOUNTS, key: "n_nationkey", resolvable: false) @join__type(graph: CATALOG, key: "n_nationkey", resolvable: false) {
  n_nationkey: Int! n_name: String @join__field(graph: GEO) region: Region @join__field(graph: GEO)
}
union Party @join__type(graph: ACCOUNTS) @join__unionMember(graph: ACCOUNTS, member: "Customer") @join__unionMember(graph: ACCOUNTS, member: "Supplier") = Customer | Supplier
type Customer @join__type(graph: ACCOUNTS, key: "c_custkey") @join__type(graph: SALES, key: "c_custkey") @join__type(graph: ACTIVITY, key: "c_custkey") {
  c_custkey: Int!
  c_name: String @join__field(graph: ACCOUNTS) @join__field(graph: ACTIVITY, external: true)
  c_acctbal: Float @join__field(graph: ACCOUNTS) @requiresScopes(scopes: [["read:balance"], ["admin"]])
  c_mktsegment: String @join__field(graph: ACCOUNTS)
  nation: Nation @join__field(graph: ACCOUNTS)
  orders(first: Int, last: Int, o_orderstatus: String): [Order!]! @join__field(graph: SALES) @listSize(slicingArguments: ["first"], assumedSize: 10, requireOneSlicingArgument: false)
  events: [Event!]! @join__field(graph: ACTIVITY)
}
type Supplier @join__type(graph: CATALOG, key: "s_suppkey") @join__type(graph: ACCOUNTS, key: "s_suppkey") @join__type(graph: SALES, key: "s_suppkey", resolvable: false) {
  s_suppkey: Int! s_name: String @join__field(graph: CATALOG) @join__field(graph: ACCOUNTS) s_acctbal: Float @join__field(graph: CATALOG) @join__field(graph: ACCOUNTS) nation: Nation @join__field(graph: CATALOG)
}
type Part @join__type(graph: CATALOG, key: "p_partkey") @join__type(graph: SALES, key: "p_partkey", resolvable: false) @join__type(graph: STOCK, key: "p_partkey") {
  p_partkey: Int!
  p_name: String @join__field(graph: CATALOG)
  p_brand: String @join__field(graph: CATALOG, usedOverridden: true, overrideLabel: "brand_in_stock") @join__field(graph: STOCK, override: "catalog", overrideLabel: "brand_in_stock")
  p_type: String @join__field(graph: CATALOG, usedOverridden: true, overrideLabel: "percent(40)") @join__field(graph: STOCK, override: "catalog", overrideLabel: "percent(40)")
  p_container: String @join__field(graph: CATALOG, usedOverridden: true) @join__field(graph: STOCK, override: "catalog")
  p_size: Int @join__field(graph: CATALOG)
  p_retailprice: Float @join__field(graph: CATALOG)
  shipping: Int @join__field(graph: STOCK, requires: "p_retailprice p_size")
  shippingBand: String @join__field(graph: STOCK, requires: "shipping")
}
type Sku @join__type(graph: CATALOG) @join__type(graph: STOCK) { p_partkey: Int! p_name: String @join__field(graph: CATALOG) p_size: Int @join__field(graph: STOCK) }
type Order @join__type(graph: SALES, key: "o_orderkey") @join__type(graph: SHIPPING, key: "o_orderkey") @cost(weight: 2) {
  o_orderkey: Int! o_orderstatus: String @join__field(graph: SALES) status: Status @join__field(graph: SALES) o_orderpriority: String @join__field(graph: SALES) customer: Customer @join__field(graph: SALES) lineItems(first: Int): [LineItem!]! @join__field(graph: SALES) @listSize(assumedSize: 4)
  firstFlag: String @join__field(graph: SHIPPING)
}
type LineItem @join__type(graph: SALES) { l_linenumber: Int! l_quantity: Float l_returnflag: String part: Part supplier: Supplier }
type Event @join__type(graph: ACTIVITY, key: "event_id") { event_id: Int! event_type: EventType value: Float props: JSON user: Customer @join__field(graph: ACTIVITY, provides: "c_name") }
type Document @join__type(graph: CORPUS, key: "doc_id") @join__type(graph: RATINGS, key: "doc_id") {
  doc_id: Int! lang: String @join__field(graph: CORPUS) source: String @join__field(graph: CORPUS) n_chars: Int @join__field(graph: CORPUS) quality: Int @join__field(graph: RATINGS) toxic: Int @join__field(graph: RATINGS)
}
type Rating @join__type(graph: RATINGS, key: "doc_id") { doc_id: Int! quality: Int! }
type Note @join__type(graph: RATINGS, key: "doc_id") { doc_id: Int! rating: Rating strict: [Rating!] }
interface Piece @join__type(graph: CORPUS, key: "doc_id") @join__type(graph: RATINGS, key: "doc_id", isInterfaceObject: true) {
  doc_id: Int! @join__field(graph: CORPUS) @join__field(graph: RATINGS) n_chars: Int @join__field(graph: CORPUS) quality: Int @join__field(graph: RATINGS)
}
type EnglishPiece implements Piece @join__implements(graph: CORPUS, interface: "Piece") @join__type(graph: CORPUS, key: "doc_id") { doc_id: Int! n_chars: Int source: String quality: Int @join__field }
type OtherPiece implements Piece @join__implements(graph: CORPUS, interface: "Piece") @join__type(graph: CORPUS, key: "doc_id") { doc_id: Int! n_chars: Int lang: String quality: Int @join__field }
type Turn @join__type(graph: CHATS, key: "conv_id turn") @join__type(graph: CORPUS, key: "conv_id turn") { conv_id: Int! turn: Int! role: String @join__field(graph: CHATS) size: Int @join__field(graph: CORPUS) }
type Embedding @join__type(graph: VECTORS, key: "vec_id") { vec_id: Int! label: Int embedding: [Float] }
"""


@cache
def _catalog() -> Catalog:
    return Catalog(SDL)


def engine(spark: SparkSession, sf_dir: str, options: Options | None = None) -> Engine:
    e = Engine(spark, _catalog(), options)
    at = lambda name: f"{sf_dir}/{name}.parquet"
    read = lambda name: lambda s: s.read.parquet(at(name))
    e.source("geo", "Region", at("region"), unique=("r_regionkey",)).source("geo", "Nation", at("nation"), unique=("n_nationkey",))
    e.link("geo", "Region.nations", {"r_regionkey": "n_regionkey"}, ("n_nationkey",))
    e.link("geo", "Nation.region", {"n_regionkey": "r_regionkey"})
    e.root("geo", "regions", ("r_regionkey",)).root("geo", "nations", ("n_nationkey",))
    e.source("accounts", "Customer", at("customer"), unique=("c_custkey",)).link("accounts", "Customer.nation", {"c_nationkey": "n_nationkey"})
    e.source("accounts", "Supplier", at("supplier"), unique=("s_suppkey",))
    e.root("accounts", "customers", ("c_custkey",)).root("accounts", "parties")
    e.source("catalog", "Part", at("part"), {"p_container": "concat('C', p_size)"}, unique=("p_partkey",)).source("catalog", "Supplier", at("supplier"), unique=("s_suppkey",))
    e.link("catalog", "Supplier.nation", {"s_nationkey": "n_nationkey"})
    e.root("catalog", "parts", ("p_partkey",)).root("catalog", "suppliers", ("s_suppkey",)).root("catalog", "reprice", ("p_partkey",), where=lambda args: F.lit(True))
    e.source("catalog", "Sku", at("part"), unique=("p_partkey",)).source("stock", "Sku", lambda s: s.read.parquet(at("part")).filter("p_partkey % 2 = 0"), {"p_size": "p_size + 100"}, unique=("p_partkey",))
    e.root("catalog", "skus", ("p_partkey",)).root("stock", "skus", ("p_partkey",))
    # its own values of the overridden fields, so that results tell the owners apart
    e.source("stock", "Part", at("part"), {"p_brand": "concat('S-', p_brand)", "p_type": "upper(p_type)", "p_container": "concat('S', p_size)"}, unique=("p_partkey",))
    e.resolver("stock", "Part.shipping")(lambda c, a: F.when(c["p_retailprice"] > 1000, F.lit(0)).otherwise(F.floor(c["p_size"] / 2)).cast("long"))
    e.resolver("stock", "Part.shippingBand")(lambda c, a: F.when(c["shipping"] == 0, "free").when(c["shipping"] < 10, "low").otherwise("high"))
    e.source("shipping", "Order", lambda s: s.read.parquet(at("lineitem")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("firstFlag")))  # several rows an order
    e.source("sales", "Order", at("orders"), {"status": "o_orderstatus"}, unique=("o_orderkey",)).source("sales", "LineItem", at("lineitem"))
    e.link("sales", "Order.customer", {"o_custkey": "c_custkey"}).link("sales", "Customer.orders", {"c_custkey": "o_custkey"}, ("o_orderkey",))
    e.link("sales", "Order.lineItems", {"o_orderkey": "l_orderkey"}, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    e.link("sales", "LineItem.part", {"l_partkey": "p_partkey"}).link("sales", "LineItem.supplier", {"l_suppkey": "s_suppkey"})
    e.root("sales", "orders", ("o_orderkey",))
    e.source("activity", "Event", lambda s: s.read.parquet(at("events")).withColumn("u_name", F.format_string("Customer#%09d", "user_id")))
    e.link("activity", "Event.user", {"user_id": "c_custkey"}, carries={"u_name": "c_name"}).root("activity", "events", ("event_id",)).root("activity", "eventAdded", ("event_id",))
    e.registry.stream("activity", "Event", lambda s: s.readStream.schema(s.read.parquet(at("events")).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("u_name", F.format_string("Customer#%09d", "user_id")))
    e.source("corpus", "Document", at("documents"), unique=("doc_id",)).root("corpus", "documents", ("doc_id",))
    e.source("ratings", "Document", at("labels"), unique=("doc_id",)).source("ratings", "Rating", at("labels"), unique=("doc_id",)).source("ratings", "Note", read("documents"))
    e.source("ratings", "Piece", at("labels"), unique=("doc_id",)).root("ratings", "scores", ("doc_id",))
    e.link("ratings", "Note.rating", {"doc_id": "doc_id"}).link("ratings", "Note.strict", {"doc_id": "doc_id"}).root("ratings", "notes", ("doc_id",))
    e.source("ratings", "Rating", lambda s: s.read.parquet(at("labels")).withColumn("quality", F.when(F.col("quality") == 1, 1)))
    e.source("corpus", "EnglishPiece", lambda s: s.read.parquet(at("documents")).filter("lang = 'en'"), unique=("doc_id",))
    e.source("corpus", "OtherPiece", lambda s: s.read.parquet(at("documents")).filter("lang <> 'en'"), unique=("doc_id",)).root("corpus", "pieces", ("doc_id",))
    e.source("chats", "Turn", at("conversations"), unique=("conv_id", "turn")).source("corpus", "Turn", lambda s: s.read.parquet(at("conversations")).select("conv_id", "turn", F.length("text").alias("size")), unique=("conv_id", "turn"))
    e.root("chats", "turns", ("conv_id", "turn"))
    e.source("vectors", "Embedding", at("embeddings")).root("vectors", "embeddings", ("vec_id",))
    return e


@lru_cache(maxsize=8)
def opened(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine for a session and a folder: its tables are opened once, like views. For queries
    that change nothing of it."""
    return engine(spark, sf_dir)


def _run(text: str, *columns: str, options: Options | None = None, variables: dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = opened(spark, sf_dir).query(text, variables, options=options).df
        return df.selectExpr(*columns) if columns else df

    return query


def _exploded(text: str, arrays: list[str], *columns: str, options: Options | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """arrays: each a path; explodes into columns x0, x1, ..."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = opened(spark, sf_dir).query(text, options=options).df
        for i, a in enumerate(arrays):
            df = df.withColumn(f"x{i}", F.explode(a))
        return df.selectExpr(*columns)

    return query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' names and nations, over three sources."""
    return QUERIES["entity_chain"](spark, sf_dir)


def _estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = engine(spark, sf_dir).query("{ customers(first: 3) { c_custkey nation { n_name } orders(first: 2) { o_orderkey lineItems { l_quantity } } } }")
    return spark.createDataFrame([(r.shape_cost,)], "cost long")


def _with_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = engine(spark, sf_dir).query("{ customers(first: 3) { c_custkey nation { n_name } orders(first: 2) { o_orderkey firstFlag } } }")
    return spark.createDataFrame([("total", r.estimated_cost), *r.cost_by_source.items()], "source string, cost long")


def _partial_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHIPPING is over its budget: its field is null, the rest of the answer stays."""
    r = engine(spark, sf_dir, Options(budget=Budget(per_source={"shipping": 0}, default_list_size=1))).query("{ orders { o_orderkey firstFlag customer { c_name } } }")
    return r.df.select("o_orderkey", "firstFlag", "customer.c_name")


def _by_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = opened(spark, sf_dir)
    r = e.query("{ customers { nation { n_name } orders { o_orderkey firstFlag } } }")
    return e.cost_by_fetch(r, "customers")


def _two_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots of one mutation: the first one's rows are those from before the second ran."""
    e = _with_reprice(spark, sf_dir)
    r = e.query("mutation { a: reprice(percent: 10) { p_partkey p_retailprice } b: reprice(percent: 20) { p_partkey p_retailprice } }")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
    a, b = (r.frames[k].select("p_partkey", F.col("p_retailprice").alias(k)) for k in "ab")
    return a.join(b, "p_partkey").select("p_partkey", cents("a"), cents("b"))


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = opened(spark, sf_dir)
    r = e.query("{ customers { c_custkey orders { o_orderkey lineItems { l_quantity } } } }")
    return e.actual_cost(r, "customers").select("c_custkey", "actual_cost")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.histogram(_actual(spark, sf_dir), F.col("actual_cost"), BUCKETS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rollup(_events(spark, sf_dir), "event_type", F.col("props"), F.col("event_type") != "error", "event_id")


def _first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sample_records(_events(spark, sf_dir).select("event_id", "user_id"), "user_id", ["event_id"], 0.0)


def _first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.aggregate_values(_events(spark, sf_dir), "user_id", "event_type", ["event_id"])
    return out.select("user_id", "first", "last", F.size("append").cast("long").alias("n"), F.array_join("append", ",").alias("append"))


def _cache_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 600).alias("age"), (F.col("event_type") == "error").alias("no_store"), (F.col("event_type") == "purchase").alias("private"))
    return usage.cache_control(rows, "user_id", "age", "no_store", "private")


def _schema_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    texts = ["{ customers { c_name } }", "{ customers { c_name nation { n_name } } }", "{ nations { n_name } }"]
    records = None
    for t in texts:
        r = e.usage_record(t, e.query(t))
        records = r if records is None else records.unionByName(r)
    return usage.coordinate_usage(records, "coordinates", "hash")


def _introspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Introspection(engine(spark, sf_dir).catalog).types_frame(spark)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store({"regions-1": "{ regions { r_regionkey r_name } }"}).query(id="regions-1").df


def _op_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Options(operation_filter=_no_names)
    return engine(spark, sf_dir, o).query("{ nations { n_nationkey n_name region { r_regionkey r_name } } }").df.select("n_nationkey", "n_name", "region.r_regionkey", "region.r_name")


def _no_names(type_name: str, field: str) -> bool:
    return (type_name, field) != ("Region", "r_name")


def _with_reprice(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)

    @e.mutation("reprice")
    def reprice(percent: int) -> None:
        old = spark.read.parquet(f"{sf_dir}/part.parquet")
        e.source("catalog", "Part", old.withColumn("p_retailprice", F.round(F.col("p_retailprice") * (100 + percent) / 100, 2)))

    return e


def _mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_reprice(spark, sf_dir).query("mutation { reprice(percent: 10) { p_partkey p_retailprice } }").df.select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))


def _subscription(spark: SparkSession, sf_dir: str, where: str = "") -> DataFrame:
    """The stream run to its end; its rows read back from a Parquet sink."""
    e = engine(spark, sf_dir)
    text = f"subscription {{ eventAdded{where} {{ event_id event_type user {{ c_custkey c_mktsegment }} }} }}"
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    df = e.subscribe(text).select("event_id", "event_type", "user.c_custkey", "user.c_mktsegment")
    e.subscriptions.start(e.fingerprint(text), df, f"{top}/state", sink="parquet", options={"path": f"{top}/rows"}).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{top}/rows")


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """What the engine answers before any table is read; the SQL beside it states it in full."""
    return spark.createDataFrame(rows, schema)


#: rule -> an operation that breaks it, and one like it that does not
RULE_CASES = {
    "UniqueOperationNames": ("query A { regions { r_name } } query A { nations { n_name } }", "query A { regions { r_name } } query B { nations { n_name } }"),
    "LoneAnonymousOperation": ("{ regions { r_name } } query B { nations { n_name } }", "query B { nations { n_name } }"),
    "SingleFieldSubscriptions": ("subscription { a: eventAdded { event_id } b: eventAdded { event_id } }", "subscription { a: eventAdded { event_id } }"),
    "KnownTypeNames": ("query($a: Nope) { orders(first: $a) { o_orderkey } }", "query($a: Int) { orders(first: $a) { o_orderkey } }"),
    "FragmentsOnCompositeTypes": ("{ orders { ... on Status { x } } }", "{ orders { ... on Order { o_orderkey } } }"),
    "VariablesAreInputTypes": ("query($a: Region) { orders(first: $a) { o_orderkey } }", "query($a: Int!) { orders(first: $a) { o_orderkey } }"),
    "LeafFieldSelections": ("{ regions }", "{ regions { r_name } }"),
    "FieldsOnCorrectType": ("{ regions { nope } }", "{ regions { __typename } }"),
    "UniqueFragmentNames": ("{ regions { ...F } } fragment F on Region { r_name } fragment F on Region { r_name }", "{ regions { ...F } } fragment F on Region { r_name }"),
    "KnownFragmentNames": ("{ regions { ...F } }", "{ regions { ...F } } fragment F on Region { r_name }"),
    "NoUnusedFragments": ("{ regions { r_name } } fragment F on Region { r_name }", "{ regions { ...F } } fragment F on Region { r_name }"),
    "NoFragmentCycles": ("{ regions { ...F } } fragment F on Region { nations { region { ...F } } }", "{ regions { ...F } } fragment F on Region { nations { region { r_name } } }"),
    "UniqueVariableNames": ("query($a: Int, $a: Int) { orders(first: $a) { o_orderkey } }", "query($a: Int, $b: Int) { orders(first: $a, o_orderkey: $b) { o_orderkey } }"),
    "NoUndefinedVariables": ("{ orders(first: $a) { o_orderkey } }", "query($a: Int) { orders(first: $a) { o_orderkey } }"),
    "NoUnusedVariables": ("query($a: Int) { regions { r_name } }", "query { regions { r_name } }"),
    "VariablesInAllowedPosition": ("query($a: String) { orders(first: $a) { o_orderkey } }", "query($a: Int = 2) { orders(first: $a) { o_orderkey } }"),
    "KnownArgumentNames": ("{ orders(nope: 1) { o_orderkey } }", "{ orders(first: 1) { o_orderkey } }"),
    "UniqueArgumentNames": ("{ orders(first: 1, first: 2) { o_orderkey } }", "{ orders(first: 1, o_orderkey: 2) { o_orderkey } }"),
    "ProvidedRequiredArguments": ("mutation { reprice { p_partkey } }", "mutation { reprice(percent: 1) { p_partkey } }"),
    "KnownDirectives": ("{ regions { r_name @nope } }", "{ regions { r_name @skip(if: true) } }"),
    "UniqueDirectivesPerLocation": ("{ regions { r_name @skip(if: true) @skip(if: false) } }", "{ regions { r_name @skip(if: true) @include(if: false) } }"),
    "UniqueInputFieldNames": ("{ orders(first: {a: 1, a: 2}) { o_orderkey } }", "{ orders(first: 1) { o_orderkey } }"),
    "ValuesOfCorrectType": ('{ orders(first: "x") { o_orderkey } }', "{ events(event_type: click) { event_id } }"),
    "PossibleFragmentSpreads": ("{ regions { ... on Part { p_partkey } } }", "{ parties { ... on Customer { c_custkey } } }"),
    "OverlappingFieldsCanBeMerged": ("{ regions { x: r_name x: r_regionkey } }", "{ regions { x: r_name x: r_name } }"),
}


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of validation: whether it finds the operation that breaks it, and what else is found in the one that does not."""

    def codes(text: str) -> list[str]:
        try:
            return [e.code for e in validate(_catalog(), parse(text))]
        except GraphQLError as e:
            return [e.code]

    return _rows(spark, "rule string, found boolean, others string", [(rule, rule in codes(bad), ",".join(codes(good))) for rule, (bad, good) in RULE_CASES.items()])


def _access_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals, each twice after an answer to the same text without limits: the second time plans are cached."""
    e = engine(spark, sf_dir)
    text = "{ customers(first: 2) { a: c_name c_acctbal @skip(if: false) nation { n_name } } }"
    options = {
        "none": Options(), "depth": Options(limits=Limits(depth=2)), "depth_met": Options(limits=Limits(depth=3)), "aliases": Options(limits=Limits(aliases=0)),
        "directives": Options(limits=Limits(directives=0)), "tokens": Options(limits=Limits(tokens=5)), "reject": Options(reject_unauthorized=True),
        "reject_admin": Options(reject_unauthorized=True, user=User(True, frozenset({"admin"}))), "budget": Options(budget=Budget(most=3)), "budget_met": Options(budget=Budget(most=4)),
    }
    out = []
    for name, o in options.items():
        for n in (1, 2):
            try:
                answer = ",".join(x.code for x in e.query(text, options=o).errors) or "answer"
            except GraphQLError as x:
                answer = "refused " + x.code
            out.append((name, n, answer))
    return _rows(spark, "name string, n int, answer string", out)


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation as it is printed, in normal form, without what the user may not see; its hash; a plan."""
    e = opened(spark, sf_dir)
    text = "query Q($k: Int = 3, $yes: Boolean!) { regions { r_name ... on Region { r_regionkey @include(if: $yes) } } customers(c_custkey: $k) { ...F c_acctbal } } fragment F on Customer { nation { n_name } nation { n_nationkey @skip(if: $yes) } }"
    one = lambda x: " ".join(x.split())
    plan = e.query("{ orders { o_orderkey customer { c_name nation { n_name } } } }").explain()
    rows = [("printed", one(print_document(parse("{a(x:[1,2],y:{z:E}) @d{b:c}}")))), ("normal", one(e.print(text, {"yes": True}))), ("allowed", one(e.allowed(text, {"yes": True})))]
    rows += [("hash", document_hash(parse("{regions{r_name}}")))] + [(f"plan {i}", line.strip()) for i, line in enumerate(plan.splitlines())]
    return _rows(spark, "what string, text string", rows)


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates that follow from weights, list sizes, sized fields, input objects and mutations."""
    c = Catalog("""type Query { book: Book books(limit: Int): [Book!]! @listSize(slicingArguments: ["limit"]) best: [Book!]! @listSize(assumedSize: 5)
      page(first: Int): Page @listSize(slicingArguments: ["first"], sizedFields: ["items"]) any(q: In): Int }
    type Page { items: [Book!]! total: Int } type Mutation { touch: Int make: Book }
    type Book { title: String @cost(weight: 3) author: Person publisher: Firm } type Person { name: String } type Firm { address: Place } type Place @cost(weight: 5) { zip: String }
    input In { a: Int @cost(weight: 2) more: [In!] }""")
    book = "{ author { name } publisher { address { zip } } }"
    texts = {"object": f"{{ book {book} }}", "assumed": f"{{ best {book} }}", "sliced": f"{{ books(limit: 3) {book} }}", "sized": f"{{ page(first: 5) {{ items {book} total }} }}", "weight": "{ book { title } }", "mutation": "mutation { touch }",
             "mutation_object": "mutation { make { author { name } } }", "input": "{ any(q: {a: 1, more: [{a: 2}, {}]}) }", "skipped": "{ book { title @skip(if: true) author { name } } }"}
    out = []
    for name, text in texts.items():
        op = normalize(c, parse(text), None, {})
        out.append((name, Estimator(c).operation(op.kind, op.selections)))
    return _rows(spark, "name string, cost long", out)


def _value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = opened(spark, sf_dir)
    r = e.query("{ orders { o_orderkey status } customers { orders { status } } events { event_type } }")
    a, b, c = (e.value_errors(r, k) for k in ("orders", "customers", "events"))
    return a.unionByName(b).unionByName(c)


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = opened(spark, sf_dir)
    r = e.query("{ orders(first: 3) { o_orderkey status } customers { c_custkey c_acctbal } __schema { queryType { name } } }")
    return r.envelope(spark, e.value_errors(r, "customers"))


class _OnlyAsia(Hooks):
    def __init__(self):
        self.seen: list[str] = []

    def on_init(self, engine):
        self.seen.append("init")

    def on_params(self, variables, options):
        self.seen.append("params")
        return {"k": 2} | variables, options

    def on_parse(self, text):
        self.seen.append("parse")
        return text.replace("NAME", "r_name")

    def on_validate(self, doc, errors):
        self.seen.append("validate")

    def on_analysis(self, op):
        self.seen.append("analysis")

    def on_plan(self, plans):
        self.seen.append("plan")

    def on_source(self, source, type_name, df):
        self.seen.append(f"source {type_name}")
        return df.filter("r_name = 'ASIA'") if type_name == "Region" else None

    def on_execute(self, key, df):
        self.seen.append(f"execute {key}")

    def on_error(self, error):
        self.seen.append("error")

    def on_reload(self, sdl):
        self.seen.append("reload")

    def on_shutdown(self):
        self.seen.append("shutdown")


def _hooked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).use(_OnlyAsia()).query("query($k: Int) { nations { n_nationkey region { NAME } } orders(first: $k) { o_orderkey } }").frames["nations"].select("n_nationkey", "region.r_name")


def _hook_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook = _OnlyAsia()
    e = engine(spark, sf_dir).use(hook)
    e.query("{ nations { region { NAME } } }")
    try:
        e.query("{ nope }")
    except GraphQLError:
        pass
    e.reload(SDL)
    e.close()
    return _rows(spark, "step int, stage string", list(enumerate(hook.seen)))


def _other_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source put in the place of another: it offers two regions only."""
    e = engine(spark, sf_dir).source("geo", "Region", lambda s: s.read.parquet(f"{sf_dir}/region.parquet").filter("r_regionkey < 2"))
    return e.query("{ nations { n_nationkey region { r_name } } }").df.select("n_nationkey", "region.r_name")


class _NorthOnly:
    def table(self, source: str, type_name: str, plain: DataFrame) -> DataFrame:
        return plain.filter("r_regionkey = 3") if type_name == "Region" else plain


def _executor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads of one source through an executor of its own; other sources stay."""
    e = engine(spark, sf_dir).executor("geo", _NorthOnly())
    return e.query("{ customers { c_custkey nation { n_name region { r_name } } } }").df.select("c_custkey", "nation.n_name", "nation.region.r_name")


def _usage_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = opened(spark, sf_dir)
    text = "query Names { regions { r_name } }"
    return e.usage_record(text, e.query(text)).withColumn("coordinates", F.array_join("coordinates", ","))


ITEMS = """
enum join__Graph { A @join__graph(name: "a") B @join__graph(name: "b") C @join__graph(name: "c") }
type Query { items: [Item!]! @join__field(graph: A) }
type Item @join__type(graph: A, key: "id") @join__type(graph: B, key: "id") @join__type(graph: B, key: "org { no } sku") @join__type(graph: C, key: "org { no } sku") {
  id: Int! @join__field(graph: A) @join__field(graph: B) sku: String @join__field(graph: B) @join__field(graph: C) tag: String @join__field(graph: C) shape: Shape @join__field(graph: A)
  pairs: [[Int!]] @join__field(graph: A) strict: [[Int!]!] @join__field(graph: A)
  label(style: String = "long"): String @join__field(graph: A)
  area: Int @join__field(graph: B, requires: "shape { ... on Circle { size } ... on Square { size } }")
  sign: String @join__field(graph: B, requires: "label(style: \\"short\\")") }
union Shape @join__type(graph: A) @join__unionMember(graph: A, member: "Circle") @join__unionMember(graph: A, member: "Square") = Circle | Square
type Circle @join__type(graph: A, key: "id") { id: Int! size: Int }
type Square @join__type(graph: A, key: "id") { id: Int! size: Int }
"""
_PAIRS = "array(array(p_size, nullif(p_size % 2, 1)), array(1))"


def _items(text: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """Parts as items of three sources; the third knows them by another key than the first."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark, ITEMS)
        part = f"{sf_dir}/part.parquet"
        e.source("a", "Item", part, {"id": "p_partkey", "kind": "if(p_size % 2 = 1, 'Circle', 'Square')", "pairs": _PAIRS, "strict": _PAIRS}, unique=("id",)).root("a", "items", ("id",))
        e.source("b", "Item", part, {"id": "p_partkey", "org.no": "p_size", "sku": "p_name"}, unique=("id",)).source("c", "Item", part, {"org.no": "p_size", "sku": "p_name", "tag": "p_type"})
        e.source("a", "Circle", part, {"id": "p_partkey", "size": "p_size"}, unique=("id",)).source("a", "Square", part, {"id": "p_partkey", "size": "p_partkey"}, unique=("id",))
        e.link("a", "Item.shape", {"id": "id"}, tag="kind")
        e.resolver("a", "Item.label")(lambda c, args: F.lit("S" if args.get("style") == "short" else "L"))
        e.resolver("b", "Item.area")(lambda c, args: F.coalesce(3 * c["shape"]["size__Circle"], c["shape"]["size__Square"] * c["shape"]["size__Square"]).cast("long"))
        e.resolver("b", "Item.sign")(lambda c, args: F.concat(F.lit("<"), c["label"], F.lit(">")))
        return e.query(text).df.selectExpr(*columns)

    return query


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an engine counts over five requests, of which one repeats and two are refused."""
    e = engine(spark, sf_dir)
    for text in ("{ regions { r_name } }", "{ regions { r_name } }", "{ nope }", "{ nations { n_name } }", "{ __schema { queryType { name } } }"):
        try:
            e.query(text, options=Options(introspection=False))
        except GraphQLError as x:
            e.counters[x.code] += 1
    return _rows(spark, "counter string, n long", sorted(e.counters.items()))


_ADMIN = Options(user=User(True, frozenset({"read:balance"})))
_NO_SALES = Options(budget=Budget(per_source={"sales": 0}, default_list_size=1))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "root_scan": _run("{ regions { r_regionkey r_name } }"),
    "root_arg_filter": _run("query($k: Int) { customers(c_custkey: $k) { c_custkey c_name c_mktsegment } }", variables={"k": 7}),
    "root_first": _run("{ parts(first: 5) { p_partkey p_name } }"),
    "root_last": _run("{ parts(last: 5) { p_partkey p_name } }"),
    "root_first_last": _run("{ customers(first: 20, last: 3) { c_custkey } }"),
    "entity_duplicate_key": _run("{ orders { o_orderkey firstFlag } }"),
    "slice_last": _exploded("{ customers { c_custkey orders(last: 2) { o_orderkey } } }", ["orders"], "c_custkey", "x0.o_orderkey AS o_orderkey"),
    "slice_first_last": _exploded("{ customers { c_custkey orders(first: 5, last: 2) { o_orderkey } } }", ["orders"], "c_custkey", "x0.o_orderkey AS o_orderkey"),
    "root_reentry": _exploded("{ regions { r_regionkey query { parts(first: 3) { p_partkey p_name } } } }", ["query.parts"], "r_regionkey", "x0.p_partkey AS p_partkey", "x0.p_name AS p_name"),
    "interface_object_root": _run("{ scores { __typename doc_id quality ... on EnglishPiece { source } ... on OtherPiece { lang } } }", "__typename AS typename", "doc_id", "quality", "source", "lang"),
    "override_full": _run("{ parts { p_partkey p_container } }"),
    "mutation_two_roots": _two_mutations,
    "cost_with_lookups": _with_lookups,
    "partial_budget": _partial_budget,
    "cost_by_fetch": _by_fetch,
    "alias_fields": _run("{ customers { id: c_custkey label: c_name again: c_name } }"),
    "same_field_two_args": _run("{ customers { c_custkey open: orders(o_orderstatus: \"O\") { o_orderkey } done: orders(o_orderstatus: \"F\") { o_orderkey } } }", "c_custkey", "cast(size(open) as bigint) AS n_open", "cast(size(done) as bigint) AS n_done"),
    "enum_guard": _run("{ orders { o_orderkey status } }"),
    "typename": _run("{ nations { __typename n_nationkey } }", "__typename AS typename", "n_nationkey"),
    "entity_join": _run("{ orders { o_orderkey customer { c_custkey c_name } } }", "o_orderkey", "customer.c_custkey AS c_custkey", "customer.c_name AS c_name"),
    "entity_chain": _run("{ orders { o_orderkey customer { c_name nation { n_name region { r_name } } } } }", "o_orderkey", "customer.c_name AS c_name", "customer.nation.n_name AS n_name", "customer.nation.region.r_name AS r_name"),
    "entity_two_paths": _exploded("{ orders { o_orderkey customer { nation { n_name } } lineItems { l_linenumber supplier { s_suppkey nation { n_name } } } } }", ["lineItems"], "o_orderkey", "x0.l_linenumber AS l_linenumber", "x0.supplier.s_suppkey AS s_suppkey", "customer.nation.n_name AS customer_nation", "x0.supplier.nation.n_name AS supplier_nation"),
    "entity_composite_key": _run("{ turns { conv_id turn role size } }", "conv_id", "turn", "role", "cast(size as bigint) AS size"),
    "partial_entity": _run("{ documents { doc_id lang quality toxic } }"),
    "list_field": _exploded("{ customers { c_custkey orders { o_orderkey o_orderstatus } } }", ["orders"], "c_custkey", "x0.o_orderkey AS o_orderkey", "x0.o_orderstatus AS o_orderstatus"),
    "empty_list": _run("{ orders { o_orderkey lineItems { l_linenumber } } }", "o_orderkey", "cast(size(lineItems) as bigint) AS n_items"),
    "nested_list": _exploded("{ customers { c_custkey orders { o_orderkey lineItems { l_linenumber l_quantity part { p_name } } } } }", ["orders", "x0.lineItems"], "c_custkey", "x0.o_orderkey AS o_orderkey", "x1.l_linenumber AS l_linenumber", "x1.l_quantity AS l_quantity", "x1.part.p_name AS p_name"),
    "list_order": _run("{ customers { c_custkey orders { o_orderkey } } }", "c_custkey", "array_join(orders.o_orderkey, ',') AS keys"),
    "list_slice": _exploded("{ customers { c_custkey orders(first: 2) { o_orderkey } } }", ["orders"], "c_custkey", "x0.o_orderkey AS o_orderkey"),
    "requires_compute": _run("{ parts { p_partkey shipping } }"),
    "requires_chain": _run("{ parts { p_partkey shippingBand } }"),
    "requires_nested": _exploded("{ orders { o_orderkey lineItems { part { p_partkey shipping } } } }", ["lineItems"], "o_orderkey", "x0.part.p_partkey AS p_partkey", "x0.part.shipping AS shipping"),
    "provides_skip_join": _run("{ events { event_id user { c_custkey c_name } } }", "event_id", "user.c_custkey AS c_custkey", "user.c_name AS c_name"),
    "override_flag": _run("{ parts { p_partkey p_brand } }", options=Options(overrides=Overrides(flags=frozenset({"brand_in_stock"})))),
    "override_off": _run("{ parts { p_partkey p_brand } }"),
    "override_percent": _run("{ parts { p_partkey p_type } }", options=Options(overrides=Overrides(percentage=12.5))),
    "interface_object": _run("{ pieces { __typename doc_id quality } }", "__typename AS typename", "doc_id", "quality"),
    "union_list": _run("{ parties { __typename ... on Customer { c_custkey c_name } ... on Supplier { s_suppkey s_name } } }", "__typename AS typename", "coalesce(c_custkey, s_suppkey) AS id", "coalesce(c_name, s_name) AS name"),
    "union_partial": _run("{ parties { ... on Supplier { s_suppkey s_name } } }", "s_suppkey", "s_name"),
    "type_guard": _run("{ pieces { doc_id ... on EnglishPiece { source } ... on OtherPiece { lang } } }", "doc_id", "source", "lang"),
    "fragments": _run("query { customers { ...who ... on Customer { c_mktsegment } } } fragment who on Customer { c_custkey nation { ...where } } fragment where on Nation { n_name }", "c_custkey", "c_mktsegment", "nation.n_name AS n_name"),
    "skip_include": _run("query($yes: Boolean!, $no: Boolean!) { nations { n_nationkey n_name @include(if: $yes) region @skip(if: $yes) { r_name } again: n_name @include(if: $no) } }", variables={"yes": True, "no": False}),
    "null_bubble_object": _run("{ notes { doc_id rating { doc_id quality } } }", "doc_id", "rating.quality AS quality", "rating IS NULL AS gone"),
    "null_bubble_list": _run("{ notes { doc_id strict { quality } } }", "doc_id", "strict IS NULL AS gone", "cast(coalesce(size(strict), -1) as bigint) AS n"),
    "auth_mask": _run("{ customers { c_custkey c_acctbal } }"),
    "auth_pass": _run("{ customers { c_custkey c_acctbal } }", options=_ADMIN),
    "op_filter": _op_filter,
    "est_cost": _estimated,
    "actual_cost": _actual,
    "cost_buckets": _buckets,
    "usage_rollup": _rollup,
    "usage_first_seen": _first_seen,
    "aggregate_first_last": _first_last,
    "cache_policy": _cache_policy,
    "schema_usage": _schema_usage,
    "json_scalar": _run("{ events { event_id props } }", "event_id", "cast(get_json_object(props, '$.k') as bigint) AS k"),
    "introspect_types": _introspect,
    "stored_operation": _stored,
    "mutation_reprice": _mutation,
    "sub_enrich": _subscription,
    "sub_filter": lambda spark, sf_dir: _subscription(spark, sf_dir, "(event_type: purchase)"),
    "shared_root": _run("{ skus { p_partkey name: p_name p_size } }"),
    "shared_root_one_source": _run("{ skus(first: 4) { p_partkey p_size } }"),
    "entity_alternative_keys": _items("{ items { id tag } }", "id", "tag"),
    "requires_fragments": _items("{ items { id area } }", "id", "area"),
    "requires_arguments": _items("{ items { id sign label } }", "id", "sign", "label"),
    "clashing_types": _items("{ items { id shape { __typename ... on Circle { size } ... on Square { size } } } }", "id", "shape.__typename AS typename", "shape.size__Circle AS circle", "shape.size__Square AS square"),
    "null_nested_list": _items("{ items { id pairs strict } }", "id", "pairs[0] IS NULL AS gone", "cast(size(pairs) as bigint) AS n", "strict IS NULL AS all_gone"),
    "engine_counters": _counters,
    "validation_rules": _rules,
    "access_and_limits": _access_cases,
    "printed_forms": _printed,
    "cost_formulas": _formulas,
    "value_errors": _value_errors,
    "envelope": _envelope,
    "hook_source": _hooked,
    "hook_calls": _hook_calls,
    "source_override": _other_table,
    "source_executor": _executor,
    "usage_record": _usage_record,
    "condition_algebra": _run("query($yes: Boolean!, $no: Boolean!) { nations { n_nationkey ...F @include(if: $yes) ... @skip(if: $no) { same: n_nationkey ... @include(if: $no) { never: n_nationkey } } } } fragment F on Nation { n_name @skip(if: $no) region @include(if: $yes) { r_name @skip(if: $yes) r_regionkey } gone: n_name @include(if: $yes) @skip(if: $yes) }", "n_nationkey", "same", "n_name", "region.r_regionkey AS r_regionkey", "size(map_keys(from_json(to_json(struct(*)), 'map<string,string>'))) AS n_keys", variables={"yes": True, "no": False}),
    "empty_object": _run("query($yes: Boolean!) { nations { n_nationkey region { r_name @skip(if: $yes) } } }", "n_nationkey", "region IS NULL AS gone", variables={"yes": True}),
    "null_root_row": _run("{ customers { c_custkey orders { o_orderkey } } }", "c_custkey", "orders IS NULL AS gone", options=_NO_SALES),
    "null_root_list": _run("{ customers { c_custkey orders { o_orderkey } } }", "c_custkey", "orders IS NULL AS gone", options=replace(_NO_SALES, root_nulls="spec")),
    "leaf_list": _run("{ embeddings { vec_id label embedding } }", "vec_id", "label", "cast(size(embedding) as bigint) AS dim"),
}

_EVENT_JOIN = "SELECT event_id, event_type, c_custkey, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"
_COST = """SELECT c_custkey, CAST(1 + coalesce(sum(2 + coalesce(n, 0)), 0) AS BIGINT) AS actual_cost FROM customer
LEFT JOIN (SELECT o_custkey, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey GROUP BY c_custkey"""
_SHIPPING = "CASE WHEN p_retailprice > 1000 THEN 0 ELSE CAST(floor(p_size / 2) AS BIGINT) END"
_BAD_STATUS = "SELECT '{path}' AS path, o_orderstatus AS value, 'INVALID_ENUM_VALUE' AS code, 'not a value of Status: ' || o_orderstatus AS message, count(*) AS n FROM {rows} WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY o_orderstatus"

ORACLES: dict[str, str] = {
    "root_scan": "SELECT r_regionkey, r_name FROM region",
    "root_arg_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7",
    "root_first": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5",
    "root_last": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 5",
    "root_first_last": "SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20) ORDER BY c_custkey DESC LIMIT 3",
    "entity_duplicate_key": "SELECT o_orderkey, (SELECT min(l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS firstFlag FROM orders",
    "slice_last": "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 2",
    "slice_first_last": "SELECT c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS m FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 5) WHERE m <= 2",
    "root_reentry": "SELECT r_regionkey, p_partkey, p_name FROM region, (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 3)",
    "interface_object_root": "SELECT CASE WHEN lang = 'en' THEN 'EnglishPiece' WHEN lang <> 'en' THEN 'OtherPiece' END AS typename, d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN quality END AS quality, CASE WHEN lang = 'en' THEN source END AS source, CASE WHEN lang <> 'en' THEN lang END AS lang FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "override_full": "SELECT p_partkey, 'S' || p_size AS p_container FROM part",
    "mutation_two_roots": "SELECT p_partkey, CAST(round(round(p_retailprice * 110 / 100, 2) * 100) AS BIGINT) AS a, CAST(round(round(p_retailprice * 120 / 100, 2) * 100) AS BIGINT) AS b FROM part",
    # customers 3 and their names; 3 nations looked up; 30 orders of weight 2, each looked up for its flag
    "cost_with_lookups": "SELECT * FROM (VALUES ('total', CAST(3 + 3 + 3 + 60 + 60 AS BIGINT)), ('ACCOUNTS', 3 + 3), ('GEO', 3), ('SALES', 60), ('SHIPPING', 60)) t(source, cost)",
    "partial_budget": "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS firstFlag, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    # nothing was estimated for the list root, as no list size is known: one lookup each
    "cost_by_fetch": """SELECT path, source, actual, estimated, actual - estimated AS delta FROM (VALUES
        ('customers', 'ACCOUNTS', (SELECT count(*) FROM customer), 0), ('customers.nation', 'ACCOUNTS', (SELECT count(*) FROM customer), 0), ('customers.nation', 'GEO', (SELECT count(*) FROM customer), 1),
        ('customers.orders', 'SALES', (SELECT 2 * count(*) FROM orders JOIN customer ON o_custkey = c_custkey), 0), ('customers.orders', 'SHIPPING', (SELECT 2 * count(*) FROM orders JOIN customer ON o_custkey = c_custkey), 2)) t(path, source, actual, estimated)""",
    "alias_fields": "SELECT c_custkey AS id, c_name AS label, c_name AS again FROM customer",
    "same_field_two_args": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done FROM customer",
    "enum_guard": "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS status FROM orders",
    "typename": "SELECT 'Nation' AS typename, n_nationkey FROM nation",
    "entity_join": "SELECT o_orderkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "entity_chain": "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "entity_two_paths": "SELECT o_orderkey, l_linenumber, s_suppkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey",
    "entity_composite_key": "SELECT conv_id, turn, role, length(text) AS size FROM conversations",
    "partial_entity": "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "list_field": "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey",
    "empty_list": "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_items FROM orders",
    "nested_list": "SELECT c_custkey, o_orderkey, l_linenumber, l_quantity, p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey",
    "list_order": "SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "list_slice": "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 2",
    "requires_compute": f"SELECT p_partkey, {_SHIPPING} AS shipping FROM part",
    "requires_chain": f"SELECT p_partkey, CASE WHEN s = 0 THEN 'free' WHEN s < 10 THEN 'low' ELSE 'high' END AS shippingBand FROM (SELECT p_partkey, {_SHIPPING} AS s FROM part)",
    "requires_nested": f"SELECT o_orderkey, p_partkey, {_SHIPPING} AS shipping FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey",
    "provides_skip_join": "SELECT event_id, c_custkey, c_name FROM events LEFT JOIN customer ON user_id = c_custkey",
    "override_flag": "SELECT p_partkey, 'S-' || p_brand AS p_brand FROM part",
    "override_off": "SELECT p_partkey, p_brand FROM part",
    "override_percent": "SELECT p_partkey, upper(p_type) AS p_type FROM part",
    "interface_object": "SELECT CASE WHEN lang = 'en' THEN 'EnglishPiece' ELSE 'OtherPiece' END AS typename, d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "union_list": "SELECT 'Customer' AS typename, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier",
    "union_partial": "SELECT CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS VARCHAR) AS s_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "type_guard": "SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS source, CASE WHEN lang <> 'en' THEN lang END AS lang FROM documents",
    "fragments": "SELECT c_custkey, c_mktsegment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "skip_include": "SELECT n_nationkey, n_name FROM nation",
    "null_bubble_object": "SELECT d.doc_id, CASE WHEN quality = 1 THEN quality END AS quality, coalesce(quality, 0) <> 1 AS gone FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "null_bubble_list": "SELECT d.doc_id, coalesce(quality = 0, false) AS gone, CAST(CASE WHEN quality = 0 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "auth_mask": "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer",
    "auth_pass": "SELECT c_custkey, c_acctbal FROM customer",
    "op_filter": "SELECT n_nationkey, n_name, r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "est_cost": "SELECT CAST(3 * (1 + 1 + 10 * (2 + 4 * 1)) AS BIGINT) AS cost",
    "actual_cost": _COST,
    "cost_buckets": f"SELECT CASE WHEN actual_cost <= 0 THEN 0 WHEN actual_cost <= 10 THEN 10 WHEN actual_cost <= 50 THEN 50 WHEN actual_cost <= 200 THEN 200 WHEN actual_cost <= 1000 THEN 1000 WHEN actual_cost <= 5000 THEN 5000 WHEN actual_cost <= 10000 THEN 10000 END AS bucket, count(*) AS n FROM ({_COST}) GROUP BY 1",
    "usage_rollup": "SELECT event_type, arg_min(props, event_id) AS body, count(*) AS n, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_ok FROM events GROUP BY event_type",
    "usage_first_seen": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1",
    "aggregate_first_last": "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS append FROM events GROUP BY user_id",
    "cache_policy": "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 0 ELSE min(event_id % 600) END AS max_age, bool_or(event_type = 'error') AS no_store, bool_or(event_type = 'purchase') AS private FROM events GROUP BY user_id",
    "schema_usage": "SELECT * FROM (VALUES ('Customer.c_name', 2, 2), ('Customer.nation', 1, 1), ('Nation.n_name', 2, 2), ('Query.customers', 2, 2), ('Query.nations', 1, 1)) t(coordinate, n, n_operations)",
    "json_scalar": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "introspect_types": """SELECT * FROM (VALUES ('Customer', 'OBJECT', 7, 0), ('Document', 'OBJECT', 6, 0), ('Embedding', 'OBJECT', 3, 0), ('EnglishPiece', 'OBJECT', 4, 0), ('Event', 'OBJECT', 5, 0), ('EventType', 'ENUM', 0, 0), ('JSON', 'SCALAR', 0, 0),
        ('LineItem', 'OBJECT', 5, 0), ('Mutation', 'OBJECT', 1, 0), ('Nation', 'OBJECT', 3, 0), ('Note', 'OBJECT', 3, 0), ('Order', 'OBJECT', 7, 0), ('OtherPiece', 'OBJECT', 4, 0), ('Part', 'OBJECT', 9, 0), ('Party', 'UNION', 0, 2), ('Piece', 'INTERFACE', 3, 2),
        ('Query', 'OBJECT', 15, 0), ('Sku', 'OBJECT', 3, 0), ('Rating', 'OBJECT', 2, 0), ('Region', 'OBJECT', 4, 0), ('Status', 'ENUM', 0, 0), ('Subscription', 'OBJECT', 1, 0), ('Supplier', 'OBJECT', 4, 0), ('Turn', 'OBJECT', 4, 0)) t(type_name, kind, n_fields, n_possible)""",
    "stored_operation": "SELECT r_regionkey, r_name FROM region",
    "mutation_reprice": "SELECT p_partkey, CAST(round(round(p_retailprice * 110 / 100, 2) * 100) AS BIGINT) AS cents FROM part",
    "sub_enrich": _EVENT_JOIN,
    "sub_filter": f"{_EVENT_JOIN} WHERE event_type = 'purchase'",
    "shared_root": "SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 END AS p_size FROM part",
    "shared_root_one_source": "SELECT p_partkey, p_size + 100 AS p_size FROM part WHERE p_partkey % 2 = 0 ORDER BY p_partkey LIMIT 4",
    "entity_alternative_keys": "SELECT x.p_partkey AS id, tag FROM part x LEFT JOIN (SELECT p_size, p_name, min(p_type) AS tag FROM part GROUP BY ALL) y ON x.p_size = y.p_size AND x.p_name = y.p_name",
    "requires_fragments": "SELECT p_partkey AS id, CAST(CASE WHEN p_size % 2 = 1 THEN 3 * p_size ELSE p_partkey * p_partkey END AS BIGINT) AS area FROM part",
    "requires_arguments": "SELECT p_partkey AS id, '<S>' AS sign, 'L' AS label FROM part",
    "clashing_types": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN 'Circle' ELSE 'Square' END AS typename, CASE WHEN p_size % 2 = 1 THEN p_size END AS circle, CASE WHEN p_size % 2 = 0 THEN p_partkey END AS square FROM part",
    "null_nested_list": "SELECT p_partkey AS id, p_size % 2 = 1 AS gone, CAST(2 AS BIGINT) AS n, p_size % 2 = 1 AS all_gone FROM part",
    "engine_counters": "SELECT counter, CAST(n AS BIGINT) AS n FROM (VALUES ('requests', 5), ('errors', 2), ('plan_cache_hits', 1), ('plan_cache_misses', 4), ('FieldsOnCorrectType', 1), ('INTROSPECTION_DISABLED', 1)) t(counter, n)",
    "validation_rules": "SELECT rule, true AS found, '' AS others FROM (VALUES " + ", ".join(f"('{r}')" for r in RULE_CASES) + ") t(rule)",
    "access_and_limits": """SELECT name, n, answer FROM (VALUES ('none', 'UNAUTHORIZED_FIELD_OR_TYPE'), ('depth', 'refused LIMIT_EXCEEDED'), ('depth_met', 'UNAUTHORIZED_FIELD_OR_TYPE'), ('aliases', 'refused LIMIT_EXCEEDED'),
        ('directives', 'refused LIMIT_EXCEEDED'), ('tokens', 'refused TOKEN_LIMIT_EXCEEDED'), ('reject', 'refused UNAUTHORIZED_FIELD_OR_TYPE'), ('reject_admin', 'answer'),
        ('budget', 'refused COST_ESTIMATED_TOO_EXPENSIVE'), ('budget_met', 'refused COST_ESTIMATED_TOO_EXPENSIVE')) t(name, answer), (VALUES (1), (2)) u(n)""",
    "printed_forms": """SELECT * FROM (VALUES ('printed', '{ a(x: [1, 2], y: {z: E}) @d { b: c } }'),
        ('normal', 'query Q($k: Int = 3, $yes: Boolean!) { regions { r_name r_regionkey } customers(c_custkey: 3) { nation { n_name } c_acctbal } }'),
        ('allowed', 'query Q { regions { r_name r_regionkey } customers(c_custkey: 3) { nation { n_name } } }'), ('hash', sha256('{ regions { r_name } }')),
        ('plan 0', 'Root orders: [Order!]! from SALES'), ('plan 1', 'Scan SALES.Order [o_orderkey, o_custkey]'), ('plan 2', 'Object customer as Customer on {''o_custkey'': ''c_custkey''}'), ('plan 3', 'Key SALES.Customer [c_custkey]'),
        ('plan 4', 'KeyJoin ACCOUNTS.Customer on (c_custkey) [c_name, c_nationkey]'), ('plan 5', 'Object nation as Nation on {''c_nationkey'': ''n_nationkey''}'), ('plan 6', 'Key ACCOUNTS.Nation [n_nationkey]'),
        ('plan 7', 'KeyJoin GEO.Nation on (n_nationkey) [n_name]')) t(what, text)""",
    # a book: author 1, publisher 1, its place 5, itself 1
    "cost_formulas": "SELECT name, CAST(cost AS BIGINT) AS cost FROM (VALUES ('object', 1 + 1 + 1 + 5), ('assumed', 5 * 8), ('sliced', 3 * 8), ('sized', 1 + 5 * 8), ('weight', 1 + 3), ('mutation', 10), ('mutation_object', 10 + 1 + 1), ('input', 3 + 2 + 2), ('skipped', 1 + 1)) t(name, cost)",
    "value_errors": f"{_BAD_STATUS.format(path='orders.status', rows='orders')} UNION ALL {_BAD_STATUS.format(path='customers.orders.status', rows='customer JOIN orders ON o_custkey = c_custkey')}",
    "envelope": """SELECT 'data' AS part, 'orders' AS key, '{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus IN ('O', 'F') THEN '"' || o_orderstatus || '"' ELSE 'null' END || '}' AS json FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)
        UNION ALL SELECT 'data', 'customers', '{"c_custkey":' || c_custkey || ',"c_acctbal":null}' FROM customer UNION ALL SELECT 'data', '__schema', '{"queryType":{"name":"Query"}}'
        UNION ALL SELECT 'errors', 'Customer.c_acctbal', '{"code":"UNAUTHORIZED_FIELD_OR_TYPE","message":"Customer.c_acctbal","path":["Customer","c_acctbal"]}'
        UNION ALL SELECT 'extensions', 'cost', '{"bySource":{"ACCOUNTS":0,"SALES":6},"estimated":6}'""",
    "hook_source": "SELECT n_nationkey, CASE WHEN r_name = 'ASIA' THEN r_name END AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "hook_calls": """SELECT * FROM (VALUES (0, 'init'), (1, 'params'), (2, 'parse'), (3, 'validate'), (4, 'analysis'), (5, 'plan'), (6, 'source Nation'), (7, 'source Region'), (8, 'execute nations'),
        (9, 'params'), (10, 'parse'), (11, 'validate'), (12, 'error'), (13, 'reload'), (14, 'shutdown')) t(step, stage)""",
    "source_override": "SELECT n_nationkey, CASE WHEN r_regionkey < 2 THEN r_name END AS r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "source_executor": "SELECT c_custkey, n_name, CASE WHEN r_regionkey = 3 THEN r_name END AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "usage_record": "SELECT sha256('query Names { regions { r_name } }') AS hash, 'query Names { regions { r_name } }' AS body, 'Names' AS name, 'Query.regions,Region.r_name' AS coordinates, CAST(0 AS BIGINT) AS estimated_cost, true AS ok",
    "condition_algebra": "SELECT n_nationkey, n_nationkey AS same, n_name, r_regionkey, 4 AS n_keys FROM nation LEFT JOIN region ON n_regionkey = r_regionkey",
    "empty_object": "SELECT n_nationkey, n_regionkey IS NULL AS gone FROM nation",
    # orders must not be null, so they take their customer along, and with the spec's rule the whole list
    "null_root_row": "SELECT CAST(NULL AS BIGINT) AS c_custkey, true AS gone FROM customer",
    "null_root_list": "SELECT c_custkey, true AS gone FROM customer WHERE false",
    "leaf_list": "SELECT vec_id, label, len(embedding) AS dim FROM embeddings",
}

__all__ = ["ORACLES", "QUERIES", "SDL", "engine", "flagship", "parse_selections"]
