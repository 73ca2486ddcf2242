"""Edges of dynamic dispatch, proposed by rules over nodes, static edges and unresolved references.

A rule is a function from a Graph to (source, target); RULES names them in order of registration. `compose` keeps the first
rule's edge per source and target and leaves out what a heuristic edge says already. Further rules are registered with `rule`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborweft.operators.resolve import capped

# Fan-out caps (new targets of a dispatcher and event, callers of a field and callable, pairs of a receiver);
# last parts of callees that send, register, collect and walk; emitters of devices; kinds.
EVENT_CAP, CALLBACK_CAP, CLOSURE_CAP = 6, 40, 8
SENDS, LISTENS, COLLECTS, WALKS = ("emit", "dispatch"), ("on", "addListener", "addEventListener"), ("append", "add"), ("forEach", "each")
DEVICES = ("DeviceEventEmitter", "NativeEventEmitter")
RENDERED, HANDLERS, CALLABLE, MEMBERS = ("function", "class", "component"), ("function", "method", "class", "component"), ("function", "method"), ("method", "function")


@dataclass(frozen=True)
class Graph:
    """nodes (id, kind, name, qualified_name, file_path, language), edges (source, target, kind, provenance, metadata), refs
    (from_node_id, reference_name, reference_kind, callee_expr, arguments, file_path, language): only unresolved ones."""

    nodes: DataFrame
    edges: DataFrame
    refs: DataFrame

    def of(self, *kinds: str) -> DataFrame:
        return self.nodes.filter(F.col("kind").isin(*kinds))

    def links(self, kind: str) -> DataFrame:
        return self.edges.filter((F.col("kind") == kind) & F.col("source").isNotNull() & F.col("target").isNotNull()).select("source", "target").distinct()

    def calls(self) -> DataFrame:
        """Calls with callee, receiver (all but the last part, null without a dot) and verb (the last part)."""
        callee = F.when(F.coalesce("callee_expr", F.lit("")) != "", F.col("callee_expr")).otherwise(F.col("reference_name"))
        c = self.refs.filter("reference_kind = 'calls' and from_node_id is not null").withColumn("callee", callee)
        verb = F.substring_index("callee", ".", -1)
        return c.withColumn("verb", verb).withColumn("receiver", F.when(F.col("callee").contains("."), F.expr("substring(callee, 1, length(callee) - length(substring_index(callee, '.', -1)) - 1)")))


RULES: dict[str, Callable[[Graph], DataFrame]] = {}


def rule(name: str):
    def put(fn):
        RULES[name] = fn
        return fn

    return put


def _argument(edges: DataFrame) -> Column:
    return F.get_json_object("metadata", "$.refArgs[0]")


def _static(g: Graph) -> DataFrame:
    return g.edges.filter("kind = 'references' and coalesce(provenance, '') = '' and source <> target").withColumn("arg", _argument(g.edges))


def _into(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return e.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("source", "target").distinct()


def contained(g: Graph, kinds: tuple) -> DataFrame:
    """(owner, member, name) of the members that a container holds."""
    m = g.of(*kinds).select(F.col("id").alias("target"), "name")
    return g.links("contains").join(m, "target").select(F.col("source").alias("owner"), F.col("target").alias("member"), "name")


@rule("react-render")
def react_render(g: Graph) -> DataFrame:
    """A method that calls setState, to the render method of its class."""
    m = contained(g, ("method",))
    callers = g.calls().filter("verb = 'setState' and receiver is not null").select(F.col("from_node_id").alias("member")).distinct()
    own = m.join(callers, "member").select("owner", F.col("member").alias("source"))
    return own.join(m.filter("name = 'render'").select("owner", F.col("member").alias("target")), "owner").filter("source <> target").select("source", "target").distinct()


@rule("jsx-render")
def jsx_render(g: Graph) -> DataFrame:
    """Y2: a static reference marked as JSX, to a function, class or component."""
    return _into(_static(g).filter(F.col("arg").startswith("jsx:")), g.of(*RENDERED))


@rule("vue-handler")
def vue_handler(g: Graph) -> DataFrame:
    """Other static references of Vue components, to what can handle an event."""
    vue = g.of("component").filter("language = 'vue'").select(F.col("id").alias("source")).distinct()
    return _into(_static(g).filter(~F.coalesce(F.col("arg"), F.lit("")).startswith("jsx:")).join(vue, "source", "left_semi"), g.of(*HANDLERS))


def _channel(calls: DataFrame, sends: Column, listens: Column) -> DataFrame:
    """Dispatch sites meet registrations of the same event name, the first argument; at most EVENT_CAP new targets per event and
    dispatcher, least first. Only one more registration than the cap can matter (one may be the dispatcher), so a hot name is
    cut before the join."""
    ev = calls.withColumn("event", F.get("arguments", 0)).filter("event is not null and event <> ''")
    disp = ev.filter(sends).select("event", F.col("from_node_id").alias("source")).distinct()
    reg = capped(ev.filter(listens).select("event", F.col("from_node_id").alias("target")).distinct(), ["event"], ["target"], EVENT_CAP + 1)
    return capped(disp.join(reg, "event").filter("source <> target"), ["event", "source"], ["target"], EVENT_CAP).select("source", "target").distinct()


@rule("rn-event-channel")
def device_events(g: Graph) -> DataFrame:
    """As event-emitter, for the emitters of devices; runs first, so its name stands on the edge."""
    device = F.coalesce(F.substring_index("receiver", ".", -1).isin(*DEVICES), F.lit(False))
    return _channel(g.calls(), (device & F.col("verb").isin(*SENDS)) | (F.col("verb") == "sendEvent"), device & F.col("verb").isin(*LISTENS))


@rule("event-emitter")
def event_emitter(g: Graph) -> DataFrame:
    """Y5."""
    dotted = F.col("receiver").isNotNull()
    return _channel(g.calls(), dotted & F.col("verb").isin(*SENDS), dotted & F.col("verb").isin(*LISTENS))


@rule("callback")
def callback(g: Graph) -> DataFrame:
    """Callables put into a field (references marked field:) meet the calls of that field; at most CALLBACK_CAP callers
    per field and callable, least first."""
    put = g.edges.filter("kind = 'references' and target is not null").withColumn("arg", _argument(g.edges)).filter(F.col("arg").startswith("field:") & (F.length("arg") > 6))
    put = put.select(F.expr("substring(arg, 7)").alias("verb"), "target").distinct()
    calls = capped(g.calls().select("verb", F.col("from_node_id").alias("source")).distinct(), ["verb"], ["source"], CALLBACK_CAP + 1)  # one may be the callable itself
    return capped(calls.join(put, "verb").filter("source <> target"), ["verb", "target"], ["source"], CALLBACK_CAP).select("source", "target").distinct()


@rule("closure-collection")
def closure_collection(g: Graph) -> DataFrame:
    """Handlers put into a collection (arg: arguments of append and add) meet the places that walk the same receiver; at
    most CLOSURE_CAP pairs per receiver, least first."""
    c = g.calls().filter("receiver is not null")
    args = F.filter(F.coalesce("arguments", F.array().cast("array<string>")), lambda a: a.startswith("arg:") & (F.length(a) > 4))
    put = c.filter(F.col("verb").isin(*COLLECTS)).select("receiver", F.explode(F.transform(args, lambda a: F.lower(F.substring(a, 5, 1 << 20)))).alias("key")).distinct()
    handlers = put.join(g.nodes.select(F.lower("name").alias("key"), F.col("id").alias("target")).distinct(), "key").select("receiver", "target").distinct()
    handlers = capped(handlers, ["receiver"], ["target"], CLOSURE_CAP + 1)
    walks = capped(c.filter(F.col("verb").isin(*WALKS)).select("receiver", F.col("from_node_id").alias("source")).distinct(), ["receiver"], ["source"], CLOSURE_CAP + 1)
    return capped(walks.join(handlers, "receiver").filter("source <> target"), ["receiver"], ["source", "target"], CLOSURE_CAP).select("source", "target").distinct()


def _same_member(g: Graph, kind: str, members: tuple, up: DataFrame | None = None) -> DataFrame:
    m = contained(g, members)
    up = (g.links(kind) if up is None else up).toDF("sub", "base")
    j = up.join(m.select(F.col("owner").alias("base"), F.col("member").alias("source"), "name"), "base").join(m.select(F.col("owner").alias("sub"), F.col("member").alias("target"), "name"), ["sub", "name"])
    return j.filter("source <> target").select("source", "target").distinct()


@rule("interface-impl")
def interface_impl(g: Graph) -> DataFrame:
    """An interface's method to the method of the same name in what implements it."""
    return _same_member(g, "implements", ("method",))


@rule("cpp-override")
def cpp_override(g: Graph) -> DataFrame:
    """A C++ base's member to the member of the same name in what extends it."""
    base = g.nodes.filter("language = 'cpp'").select(F.col("id").alias("target")).distinct()
    return _same_member(g, "extends", MEMBERS, g.links("extends").join(base, "target", "left_semi").select("source", "target"))


def tails(path: Column) -> Column:
    """All endings of a path at its slashes, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


@rule("gin-middleware-chain")
def middleware_chain(g: Graph) -> DataFrame:
    """Routes of a Go file to the middleware that the same file puts into use; file paths count as the same where one
    ends with the other. The suffix join is two equi-joins on the endings of the paths."""
    args = F.filter(F.coalesce("arguments", F.array().cast("array<string>")), lambda a: a.startswith("arg:") & (F.length(a) > 4))
    use = g.calls().filter("language = 'go' and verb = 'Use' and file_path is not null").select(F.col("file_path").alias("path"), F.explode(F.transform(args, lambda a: F.lower(F.substring(a, 5, 1 << 20)))).alias("key")).distinct()
    routes = g.of("route").filter("language = 'go' and file_path is not null").select(F.col("id").alias("source"), F.col("file_path").alias("route_path")).distinct()
    files, paths = use.select("path").distinct(), routes.select("route_path").distinct()
    a = files.join(paths.select("route_path", F.explode(tails(F.col("route_path"))).alias("path")), "path").select("path", "route_path")
    b = paths.join(files.select("path", F.explode(tails(F.col("path"))).alias("route_path")), "route_path").select("path", "route_path")
    same = a.union(b).distinct()
    fn = g.of(*CALLABLE).filter("language = 'go'").select(F.lower("name").alias("key"), F.col("id").alias("target")).distinct()
    return use.join(same, "path").join(routes, "route_path").join(fn, "key").filter("source <> target").select("source", "target").distinct()


@rule("mybatis-java-xml")
def mapper_statement(g: Graph) -> DataFrame:
    """A Java interface's method to the XML statement 'namespace.Interface.statement' of its name."""
    xml = g.nodes.filter("language = 'xml' and qualified_name like '%.%.%'").select(F.col("id").alias("target"), "name", F.element_at(F.split("qualified_name", r"\."), -1).alias("last"), F.element_at(F.split("qualified_name", r"\."), -2).alias("iface")).filter("last = name")
    java = g.of("interface").filter("language = 'java'").groupBy(F.col("name").alias("iface")).agg(F.max("id").alias("owner"))
    m = contained(Graph(g.nodes.filter("language = 'java'"), g.edges, g.refs), ("method",)).select("owner", "name", F.col("member").alias("source"))
    return java.join(m, "owner").join(xml, ["iface", "name"]).select("source", "target").distinct()


def compose(g: Graph, rules: dict[str, Callable[[Graph], DataFrame]] | None = None) -> DataFrame:
    """(source, target, synthesized_by) of all rules: the first rule in order wins; a heuristic edge is not said again. Edges of
    this kind are stored with kind calls and provenance heuristic."""
    all_: DataFrame | None = None
    for i, (name, fn) in enumerate((rules or RULES).items()):
        t = fn(g).select("source", "target", F.struct(F.lit(i).alias("o"), F.lit(name).alias("by")).alias("x"))
        all_ = t if all_ is None else all_.union(t)
    old = g.edges.filter("provenance = 'heuristic'").select("source", "target").distinct()
    return all_.groupBy("source", "target").agg(F.min("x").alias("x")).select("source", "target", F.col("x.by").alias("synthesized_by")).join(old, ["source", "target"], "left_anti")


