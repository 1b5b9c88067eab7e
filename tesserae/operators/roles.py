"""Role inference: seed rules on a node's own evidence, then refinement along inheritance to a fixed point."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.schema import KEY
from tesserae.storage import Steps, fresh_path, stored

# Precedence among roles, strongest first, and annotation names.
PRECEDENCE = ("EXTERNAL", "PERSISTENCE", "INFRASTRUCTURE", "APPLICATION", "DOMAIN", "PRESENTATION")
CONTROLLER = "org.springframework.stereotype.Controller"
SERVICE = "org.springframework.stereotype.Service"
SIGNAL = "struct<rule:string,role:string,rationale:string>"


def rank(role: Column) -> Column:
    """Place in PRECEDENCE; roles outside it come last."""
    at = F.array_position(F.array(*[F.lit(r) for r in PRECEDENCE]), role)
    return F.when(at > 0, at).otherwise(F.lit(1 << 30))


@dataclass(frozen=True)
class SeedRule:
    """A rule on one node: when its condition holds it proposes role. evidence picks the records it rests on."""

    name: str
    role: str
    condition: Callable[[], Column]
    rationale: Callable[[], Column]

    def signal(self) -> Column:
        return F.when(self.condition(), F.struct(F.lit(self.name).alias("rule"), F.lit(self.role).alias("role"), self.rationale().alias("rationale")))


def evidence_rule(name: str, role: str, matches: Callable[[Column], Column]) -> SeedRule:
    """A rule that fires when some evidence record matches; the first such record is its rationale."""
    return SeedRule(name, role, lambda: F.exists("evidence", matches), lambda: F.get(F.filter("evidence", matches), F.lit(0))["description"])


def annotated(adapter: str, annotation: str) -> Callable[[Column], Column]:
    """Evidence of adapter whose annotation attribute is the full name, or whose description shows the simple one."""
    mention = "@" + annotation.rpartition(".")[2]
    return lambda e: (e["source_adapter"] == adapter) & (F.coalesce(F.try_element_at(e["attributes"], F.lit("annotation")) == annotation, F.lit(False)) | F.coalesce(e["description"].contains(mention), F.lit(False)))


SEED_RULES = (
    evidence_rule("persistence-by-spring-data-adapter", "PERSISTENCE", lambda e: e["source_adapter"] == "spring-data"),
    evidence_rule("presentation-by-spring-controller-annotation", "PRESENTATION", annotated("spring", CONTROLLER)),
    evidence_rule("application-by-spring-service-annotation", "APPLICATION", annotated("spring", SERVICE)),
    SeedRule("domain-by-data-node-type", "DOMAIN", lambda: F.col("type") == "DATA", lambda: F.lit("node type is DATA")),
    SeedRule("infrastructure-by-config-node-type", "INFRASTRUCTURE", lambda: F.col("type") == "CONFIG", lambda: F.lit("node type is CONFIG")),
)


def winner(signals: Column) -> Column:
    """The role of the signal with the best precedence, the first of equals; UNKNOWN without one."""
    best = F.array_min(F.transform(signals, lambda s, i: F.struct(rank(s["role"]).alias("rank"), i.alias("i"), s["role"].alias("role"))))
    return F.coalesce(best["role"], F.lit("UNKNOWN"))


def seeded(nodes: DataFrame, rules: Sequence[SeedRule] = SEED_RULES) -> DataFrame:
    """nodes with signals, sorted by rule name, and role by precedence; a role that a node had is ignored."""
    signals = F.filter(F.array(*[r.signal() for r in sorted(rules, key=lambda r: r.name)]), lambda s: s.isNotNull()) if rules else F.array().cast(f"array<{SIGNAL}>")
    return nodes.withColumn("signals", signals).withColumn("role", winner(F.col("signals")))


INHERIT = "graph-inherit-role-from-extends-or-implements-target"


def inherit_from_supertypes(roles: DataFrame, edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidates (key, id, rule, role, rationale) from resolved EXTENDS and IMPLEMENTS targets that became known in fresh.

    A node stays UNKNOWN only while none of its supertypes is known, so the targets of the last pass are all there are.
    """
    up = edges.where(F.col("relation").isin("EXTENDS", "IMPLEMENTS") & F.col("src_resolved") & F.col("dst_resolved"))
    known = fresh.where("role <> 'UNKNOWN'").select(*KEY, F.col("id").alias("dst_id"), "role")
    found = up.select(*KEY, F.col("src_id").alias("id"), "dst_id", "relation", F.col("edge_seq")).join(known, [*KEY, "dst_id"])
    return found.select(*KEY, "id", F.lit(INHERIT).alias("rule"), "role", F.concat(F.lit("inherits role from "), "relation", F.lit(" target "), "dst_id").alias("rationale"), "edge_seq")


def _chains(up: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What chains of one supertype each give, and the edges of the nodes that hang on more than one.

    (key, id, added, role, pass) for nodes that reach a known node through nodes with one supertype each, and up less what is settled here.
    A node's pointer goes to its supertype first, and then, round by round, to where its target's pointer goes, so a chain of any depth
    takes as many rounds as its length has binary digits. Chains that end without a role, and circles, settle without one.
    """
    steps = Steps(up.sparkSession, "roles")
    node = [*KEY, "id"]
    single = up.groupBy(*KEY, "src_id").agg(F.count("*").alias("n"), F.first("dst_id").alias("dst_id"), F.first("relation").alias("relation")).where("n = 1")
    single = stored(single.select(*KEY, F.col("src_id").alias("id"), F.col("dst_id").alias("above"), "relation"), "roles")
    moving = steps.keep("moving", single.select(*node, F.col("above").alias("at"), F.lit(1).alias("hops")))
    longest = moving.count().bit_length()
    for _ in range(longest + 1):  # what still moves after so many rounds goes in circles
        further = moving.select(*KEY, F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        moved = moving.join(further, [*KEY, "at"], "left")
        moving = steps.keep("moving", moved.select(*node, F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("jumped")))
        if moving.where("jumped").isEmpty():
            break
    known = base.where("role <> 'UNKNOWN'").select(*KEY, F.col("id").alias("at"), "role")
    settled = moving.where("not jumped").join(known, [*KEY, "at"]).join(single, node)
    signal = F.struct(F.lit(INHERIT).alias("rule"), "role", F.concat(F.lit("inherits role from "), "relation", F.lit(" target "), "above").alias("rationale"))
    settled = stored(settled.select(*node, F.array(signal).alias("added"), "role", F.col("hops").cast("int").alias("pass")), "roles")
    several = up.groupBy(*KEY, "src_id").agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.col("src_id").alias("id"))
    hanging = moving.where("not jumped").join(several.withColumnRenamed("id", "at"), [*KEY, "at"], "left_semi").select(*node).union(several)
    rest = stored(up.join(hanging.select(*KEY, F.col("id").alias("src_id")).distinct(), [*KEY, "src_id"], "left_semi"), "roles")
    steps.drop("moving")
    return settled, rest


def refined(nodes: DataFrame, edges: DataFrame, rules: Sequence[SeedRule] = SEED_RULES, refine: Callable = inherit_from_supertypes, max_passes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with final role, signals and pass, passes per graph).

    Roles flow from known to UNKNOWN nodes only, all of a pass reading the roles before it. Chains of one supertype each are
    settled first, by doubling; only nodes that hang on several supertypes go pass by pass. The frontier of a pass is
    what the last one made known, so each pass costs one join with the inheritance edges that lead into the frontier.
    The loop ends with the first pass after which nothing is known that wasn't before it, doubled chains included; max_passes
    bounds the passes, the number of nodes in any case. Rules of one's own always go pass by pass.
    """
    spark = nodes.sparkSession
    # the rules are asked once: what they give is stored with all that the nodes have
    nodes = stored(seeded(nodes, rules), "roles")
    base = nodes.select(*KEY, "id", "role", "signals")
    inherits = edges.where(F.col("relation").isin("EXTENDS", "IMPLEMENTS") & F.col("src_resolved") & F.col("dst_resolved")).select(*KEY, "edge_seq", "src_resolved", "src_id", "dst_resolved", "dst_id", "relation")
    # only edges that lead out of unknown nodes can matter
    unknown = base.where("role = 'UNKNOWN'").select(*KEY, F.col("id").alias("src_id"))
    up = stored(inherits.join(unknown, [*KEY, "src_id"], "left_semi"), "roles")
    schema = f"subject_id string, scan_id string, id string, added array<{SIGNAL}>, role string"
    chained = spark.createDataFrame([], schema + ", pass int")
    if refine is inherit_from_supertypes:
        chained, up = _chains(up, base)
    deepest = chained.agg(F.coalesce(F.max("pass"), F.lit(0))).first()[0]
    too_many = lambda n: max_passes is not None and n > max_passes
    # each pass is a folder of one table, which tells the next ones what is known by now
    path, written = fresh_path(spark, "passes"), False
    fresh, passes, gained = base.select(*KEY, "id", "role"), 0, spark.createDataFrame([], schema + ", pass int")
    while not up.isEmpty():
        signals = refine(base, up, fresh)
        if passes:
            signals = signals.join(gained.select(*KEY, "id"), [*KEY, "id"], "left_anti")
        each = F.array_sort(F.collect_list(F.struct("rule", "edge_seq", "role", "rationale")))
        won = signals.groupBy(*KEY, "id").agg(F.transform(each, lambda s: F.struct(s["rule"].alias("rule"), s["role"].alias("role"), s["rationale"].alias("rationale"))).alias("added"))
        # a chain that ends in a node with several supertypes has its own pass in the loop; a settled one has it already
        won = won.join(chained.select(*KEY, "id"), [*KEY, "id"], "left_anti")
        won.withColumn("role", winner(F.col("added"))).where("role <> 'UNKNOWN'").write.parquet(f"{path}/pass={passes + 1}")
        written = True
        won = spark.read.schema(schema).parquet(f"{path}/pass={passes + 1}")
        if won.isEmpty() and passes >= deepest:
            break
        passes += 1
        if too_many(passes):
            break
        if max_passes is None and passes > deepest + 1 and passes > nodes.count():
            raise RuntimeError(f"role refinement did not settle within {passes} passes")
        fresh = won.select(*KEY, "id", "role").union(chained.where(F.col("pass") == passes).select(*KEY, "id", "role"))
        gained = spark.read.schema(schema + ", pass int").parquet(path)
    if too_many(max(passes, deepest)):
        raise RuntimeError(f"role refinement did not settle within {max_passes} passes")
    columns = [*KEY, "id", "added", F.col("role").alias("gained"), "pass"]
    gained = chained.select(*columns).unionByName((spark.read.schema(schema + ", pass int").parquet(path) if written else gained).select(*columns))
    out = nodes.join(gained, [*KEY, "id"], "left")
    out = out.withColumn("signals", F.concat("signals", F.coalesce("added", F.array().cast(f"array<{SIGNAL}>")))).withColumn("role", F.coalesce("gained", "role"))
    counts = nodes.select(*KEY).distinct().join(gained.groupBy(*KEY).agg(F.max("pass").cast("long").alias("passes")), KEY, "left").select(*KEY, F.coalesce("passes", F.lit(0)).alias("passes"))
    return out.drop("added", "gained").withColumn("pass", F.coalesce("pass", F.lit(0))), counts


def histogram(nodes: DataFrame) -> DataFrame:
    """(key, role, nodes) with the commonest role first."""
    return nodes.groupBy(*KEY, "role").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "role")
