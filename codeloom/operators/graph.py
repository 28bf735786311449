"""Call, type and unit graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.skew import ranked
from codeloom.session import Scratch

# the reference's caps, for the queries that show what it shows; edges are whole without them
CODE_CAP = 4_000
NAMES_CAP = 50
CANDIDATES = 8
CALLERS = 16

# fixed values: words before a parenthesis that are no calls, and names too common to link
KEYWORDS = """
begin end if then else while do for to downto case of repeat until try except finally var const type class record procedure function constructor destructor
property array set packed object interface implementation uses unit program library inherited nil result true false and or not xor div mod shl shr in is
as with goto label exports threadvar resourcestring out override virtual overload reintroduce message dynamic abstract sealed final published private
protected public strict deprecated experimental platform unsafe
""".split()
COMMON = """
length setlength copy free create add delete insert remove clear exit inc dec trim uppercase lowercase inttostr strtoint strtofloat floattostr assigned
freeandnil format pos new dispose getmem freemem write writeln read readln move fillchar comparestr sametext contains indexof tostring getenumerator
first last count value name text execute open close destroy release update
""".split()


def called_names(code: Column, own: Column, capped: bool = False) -> Column:
    """Distinct lower-case names before a parenthesis, without keywords and the own bare name, in order. Capped: at most 50, of the first 4000 characters."""
    code = F.coalesce(code, F.lit(""))
    names = F.regexp_extract_all(F.lower(F.substring(code, 1, CODE_CAP) if capped else code), F.lit(r"\b([a-z_]\w*)\s*\("), F.lit(1))
    names = F.array_distinct(F.filter(names, lambda n: ~n.isin(KEYWORDS) & (n != F.coalesce(own, F.lit("")))))
    return F.slice(names, 1, NAMES_CAP) if capped else names


def name_index(chunks: DataFrame, capped: bool = False) -> DataFrame:
    """collection, bare, id: the chunks that a name may mean, one per unit (a method before others, then the least id). Capped: the eight whose units have the least first ids."""
    c = chunks.where(F.col("kind").isin("method", "decl", "type")).select("collection", "unit", T.bare_name(F.col("name")).alias("bare"), "id", "kind").where("bare <> ''")
    best = F.min(F.struct((F.col("kind") != "method").cast("int").alias("o"), "id")).alias("b")
    g = c.groupBy("collection", "unit", "bare").agg(best, F.min("id").alias("first_id")).select("collection", "bare", F.col("b.id").alias("id"), "first_id")
    if capped:
        w = Window.partitionBy("collection", "bare").orderBy("first_id")
        g = g.withColumn("cand_ord", F.row_number().over(w)).where(F.col("cand_ord") <= CANDIDATES)
    return g.select("collection", "bare", "id")


def call_edges(chunks: DataFrame, capped: bool = False) -> DataFrame:
    """collection, caller_id, callee_id, name of each resolved call; callers are methods. Common names are not resolved, none calls itself.

    All calls of the whole code, with all candidates; capped: with the reference's caps on text, names and candidates.
    """
    m = chunks.where("kind = 'method'").select("collection", F.col("id").alias("caller_id"), F.explode(called_names(F.col("code"), T.bare_name(F.col("name")), capped)).alias("bare"))
    m = m.where(~F.col("bare").isin(COMMON))
    e = m.join(name_index(chunks, capped), ["collection", "bare"]).where("caller_id <> id")
    return e.groupBy("collection", "caller_id", F.col("id").alias("callee_id")).agg(F.min("bare").alias("name"))


def called_by(edges: DataFrame, cap: int | None = CALLERS) -> DataFrame:
    """collection, callee_id, n_callers, callers: the first callers by id, at most ``cap`` (None: all), and how many there are."""
    if cap is None:
        return edges.groupBy("collection", "callee_id").agg(F.count(F.lit(1)).alias("n_callers"), F.array_sort(F.collect_list("caller_id")).alias("callers"))
    w = Window.partitionBy("collection", "callee_id").orderBy("caller_id")
    first = edges.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).groupBy("collection", "callee_id").agg(F.array_sort(F.collect_list("caller_id")).alias("callers"))
    return edges.groupBy("collection", "callee_id").agg(F.count(F.lit(1)).alias("n_callers")).join(first, ["collection", "callee_id"])


def symbol_edges(chunks: DataFrame) -> DataFrame:
    """collection, edge, child, parent, child_id, parent_id from the parents that type chunks name.

    The first parent is inherited, the others implemented; an interface (I and a capital) inherits from all, a Rust type
    implements all. One edge per (child, parent, edge): the last by chunk id. parent_id is the least id of a type of that name in the collection, null outside.
    """
    t = chunks.where("kind = 'type'").select("collection", "id", "lang", F.trim("name").alias("child_name"), F.posexplode("extends_list").alias("pos", "parent_name"))
    t = t.withColumn("child", F.lower("child_name")).withColumn("parent", F.lower(F.trim("parent_name"))).where("child <> '' and parent <> '' and child <> parent")
    inherits = F.col("child_name").rlike("^I[A-Z]") | (F.col("pos") == 0)
    t = t.withColumn("edge", F.when(F.coalesce(F.col("lang") == "rust", F.lit(False)), "implements").when(inherits, "inherits").otherwise("implements"))
    e = t.groupBy("collection", "edge", "child", "parent").agg(F.max("id").alias("child_id"))
    ids = chunks.where("kind = 'type'").groupBy("collection", F.lower(F.trim("name")).alias("parent")).agg(F.min("id").alias("parent_id"))
    return e.join(ids, ["collection", "parent"], "left")


def unit_uses(chunks: DataFrame) -> DataFrame:
    """collection, unit, used of each import of a unit head, distinct."""
    return chunks.where("kind = 'unithead'").select("collection", "unit", F.explode("uses_list").alias("used")).where("used is not null").distinct()


def resolve_units(uses: DataFrame, units: DataFrame) -> DataFrame:
    """uses with target: the unit whose stem is the whole name, else its last dotted segment, else its last path segment; null if none. Several units of one stem: the least."""
    s = units.groupBy("collection", F.lower(T.stem(F.col("unit"))).alias("stem")).agg(F.min("unit").alias("target"))
    keys = [F.lower("used"), F.lower(F.element_at(F.split("used", "[.]"), -1)), F.lower(F.element_at(F.split("used", "/"), -1))]
    out = uses
    for i, k in enumerate(keys):
        out = out.withColumn("stem", k).join(s.withColumnRenamed("target", f"t{i}"), ["collection", "stem"], "left").drop("stem")
    return out.select("collection", "unit", "used", F.coalesce("t0", "t1", "t2").alias("target"))


def unit_dependencies(deps: DataFrame) -> DataFrame:
    """collection, unit, n_uses, n_used_by from resolved links; a unit that neither uses nor is used has no row."""
    d = deps.where("target is not null and target <> unit")
    a = d.groupBy("collection", "unit").agg(F.count_distinct("target").alias("n_uses"))
    b = d.groupBy("collection", F.col("target").alias("unit")).agg(F.count_distinct("unit").alias("n_used_by"))
    return a.join(b, ["collection", "unit"], "full").fillna(0, ["n_uses", "n_used_by"])


def topological_layers(deps: DataFrame) -> DataFrame:
    """collection, unit, layer, place: foundations first, by name inside a layer; units on or behind a cycle come last with layer -1.

    Each round takes the units all of whose dependencies are placed, until none can be taken; there is one round per layer.
    """
    kept = Scratch(deps.sparkSession, "layers")
    none = F.lit("\x00")  # a null collection is one of its own
    d = kept.put(deps.where("target is not null and target <> unit").select(F.coalesce("collection", none).alias("collection"), "unit", "target").distinct(), "links")
    units = kept.put(d.select("collection", "unit").union(d.select("collection", F.col("target").alias("unit"))).distinct(), "left")
    left, links, layer = units, d, 0
    while True:
        waiting = links.select("collection", "unit").distinct()
        now = kept.put(left.join(waiting, ["collection", "unit"], "left_anti"), f"layers/layer={layer}")
        if now.isEmpty():
            break
        left = kept.put(left.join(now, ["collection", "unit"], "left_anti"), f"left{layer}")
        links = kept.put(links.join(now.select("collection", F.col("unit").alias("target")), ["collection", "target"], "left_anti"), f"links{layer}")
        kept.drop(*([f"left{layer - 1}", f"links{layer - 1}"] if layer else ["left", "links"]))
        layer += 1
    placed = deps.sparkSession.read.schema("collection string, unit string, layer int").parquet(f"{kept.base}/layers")
    all_ = left.withColumn("layer", F.lit(-1)).unionByName(placed).withColumn("collection", F.nullif("collection", none))
    return ranked(all_, ["collection"], [F.when(F.col("layer") < 0, 2**31 - 1).otherwise(F.col("layer")), F.lower("unit"), F.col("unit")])


def impact(changed: DataFrame, chunks: DataFrame, edges: DataFrame, parents: DataFrame) -> DataFrame:
    """collection, id, reason: what a change of units (collection, unit) reaches outside them.

    ``caller``: chunks that call a changed method; ``subtype``: types whose parent is a changed type.
    """
    hit = chunks.join(changed.select("collection", "unit").distinct(), ["collection", "unit"], "left_semi").select("collection", "id", "kind", F.lower(F.trim("name")).alias("name"))
    callers = edges.join(hit.where("kind = 'method'").select("collection", F.col("id").alias("callee_id")), ["collection", "callee_id"], "left_semi").select("collection", F.col("caller_id").alias("id"), F.lit("caller").alias("reason"))
    subs = parents.join(hit.where("kind = 'type'").select("collection", F.col("name").alias("parent")), ["collection", "parent"], "left_semi").select("collection", F.col("child_id").alias("id"), F.lit("subtype").alias("reason"))
    return callers.union(subs).distinct().join(hit.select("collection", "id"), ["collection", "id"], "left_anti")


def references(chunks: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """collection, name, n_definitions, n_textual, n_callers: per name, chunks that define it, that only mention it, and distinct callers of its methods."""
    c = chunks.select("collection", "id", "kind", T.bare_name(F.col("name")).alias("bare"), F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("code", F.lit(""))), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))).alias("words"))
    n = names.select("collection", F.lower("name").alias("name")).distinct()
    defs = c.join(n, (c["collection"] == n["collection"]) & (c["bare"] == n["name"])).select(n["collection"], n["name"], c["id"], c["kind"])
    words = c.select("collection", "id", "bare", F.explode("words").alias("name")).where("bare is null or bare <> name").join(n, ["collection", "name"], "left_semi")
    text = words.groupBy("collection", "name").agg(F.count(F.lit(1)).alias("n_textual"))
    m = defs.where("kind = 'method'").select("collection", F.col("name").alias("def_name"), F.col("id").alias("callee_id"))
    callers = edges.select("collection", "caller_id", "callee_id").join(m, ["collection", "callee_id"]).groupBy("collection", F.col("def_name").alias("name")).agg(F.count_distinct("caller_id").alias("n_callers"))
    d = defs.groupBy("collection", "name").agg(F.count(F.lit(1)).alias("n_definitions"))
    return n.join(d, ["collection", "name"], "left").join(text, ["collection", "name"], "left").join(callers, ["collection", "name"], "left").fillna(0, ["n_definitions", "n_textual", "n_callers"])
