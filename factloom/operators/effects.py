"""What a function does to the world: effect classes of outside calls, its own
writes, what its handlers let through, and what its callers inherit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import dotted_prefixes
from .graph import effect_fold
from .lineage import settled
from .resolve import call_edges

# fixed values: classes of outside names; a name covers all below it, a leading dot a method of any receiver
CATALOG = {
    "pure": "len frozenset set tuple list dict str int float bool range enumerate zip map filter sorted reversed repr isinstance hasattr min max sum abs any all"
    " os.path urllib.parse collections dataclasses functools itertools re math operator typing copy json.loads json.dumps",
    "logs": "print breakpoint logging warnings .debug .info .warning .error .critical .exception",
    "reads-world": "open input socket sqlite3 glob urllib redis os.environ os.getenv os.listdir os.stat time.time datetime.datetime.now random"
    " .read .read_text .read_bytes .readlines .recv .fetchall .fetchone",
    "writes-world": "os.makedirs os.mkdir os.rename os.replace shutil.copy shutil.move tempfile .write .write_text .write_bytes .mkdir .commit .send",
    "writes-process": "os.chdir os.putenv os.environ.update sys.setrecursionlimit sys.path.append sys.path.insert locale.setlocale signal.signal",
    "blocks": "time.sleep asyncio.sleep select.select .join .acquire .wait",
    "spawns": "subprocess os.system os.fork os.exec multiprocessing threading.Thread concurrent.futures",
    "mutates-receiver": ".append .extend .insert .add .update .pop .remove .clear .discard .setdefault .sort .reverse .popitem",
    "returns-container": ".keys .values .items .split .splitlines .copy",
    "off-machine": "requests httpx boto3 socket urllib.request smtplib paramiko ftplib grpc aiohttp",
    "deletes": "os.remove os.unlink os.rmdir shutil.rmtree .unlink .rmdir",
}
WORLD = ("logs", "reads-world", "writes-world", "writes-process", "blocks", "spawns", "off-machine", "deletes")
SPENDS = ("reads-world", "writes-world", "blocks", "spawns", "off-machine", "deletes")


def catalog(spark: SparkSession, rows: dict[str, str] | None = None) -> DataFrame:
    """(key, effect) of outside names."""
    pairs = [(k, effect) for effect, names in (rows or CATALOG).items() for k in names.split()]
    return spark.createDataFrame(pairs, "key string, effect string")


def classified(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls with their ``effects``: those of the longest listed prefix of the target,
    else of its last part as a method, else none.  calls needs ``target``."""
    named = names.groupBy("key").agg(F.sort_array(F.collect_set("effect")).alias("effects"))
    distinct = calls.where("target is not null").select("target").distinct()
    last = F.concat(F.lit("."), F.substring_index("target", ".", -1))
    method = F.when(F.col("target").contains("."), F.array(last)).otherwise(F.expr("cast(array() as array<string>)"))
    keys = distinct.select("target", F.posexplode(F.concat(dotted_prefixes(F.col("target")), method)).alias("k", "key"))
    best = keys.join(F.broadcast(named), "key").groupBy("target").agg(F.min_by("effects", "k").alias("effects"))
    return calls.join(best, "target", "left")


def own_writes(facts: DataFrame) -> DataFrame:
    """(symbol, root, kind, line, own): what a function's body writes.

    ``global``: a module name it rebinds; ``self``: an attribute of its object;
    ``param``: an attribute of a parameter, or a parameter that a method changes;
    own tells that the written thing was made by the function itself."""
    kind = lambda k: facts.where(F.col("kind") == k)
    params = kind("param").select("symbol", F.col("name").alias("root"), F.element_at("items", 1).alias("how"))
    made = kind("ref").where("value = 'store'").select("symbol", F.col("name").alias("root")).distinct().withColumn("local", F.lit(True))
    rebound = kind("global").select("symbol", F.col("name").alias("root"), "line").join(made, ["symbol", "root"], "left_semi")
    globals_ = rebound.select("symbol", "root", F.lit("global").alias("kind"), "line", F.lit(False).alias("own"))
    stored = kind("ref").where("value = 'attr-store'").select("symbol", F.substring_index(F.element_at("items", 1), ".", 1).alias("root"), F.col("name").alias("attr"), "line")
    changed = CATALOG["mutates-receiver"].replace(".", "").split()
    parts = F.split("name", r"\.")
    called = kind("call").where((F.size(parts) > 1) & F.element_at(parts, -1).isin(*changed)).select("symbol", F.element_at(parts, 1).alias("root"), F.lit(None).cast("string").alias("attr"), "line")
    on_param = stored.union(called).join(params, ["symbol", "root"]).join(made, ["symbol", "root"], "left")
    what = F.when(F.col("how") == "self", "self").otherwise("param")
    return globals_.union(on_param.select("symbol", "root", what.alias("kind"), "line", F.coalesce("local", F.lit(False)).alias("own")))


def own_effects(facts: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """(node, atoms, unknown): effect atoms of a function's own body: ``io:<class>``
    of outside calls, ``gw:<name>``, ``sw`` and ``pw:<name>`` of its writes; unknown
    if it calls what neither the repository nor the catalog holds."""
    calls = classified(resolved.where("resolution <> 'resolved'"), names)
    told = calls.select(F.col("scope").alias("node"), F.explode("effects").alias("e")).where(F.col("e").isin(*WORLD)).select("node", F.concat(F.lit("io:"), "e").alias("atom"))
    w = own_writes(facts).where("not own")
    module = facts.where("kind = 'symbol'").select("symbol", "module").distinct()
    atom = F.when(F.col("kind") == "global", F.concat(F.lit("gw:"), "module", F.lit("."), "root")).when(F.col("kind") == "self", F.lit("sw")).otherwise(F.concat(F.lit("pw:"), "root"))
    written = w.join(module, "symbol").select(F.col("symbol").alias("node"), atom.alias("atom"))
    atoms = told.union(written).groupBy("node").agg(F.sort_array(F.collect_set("atom")).alias("atoms"))
    params = facts.where("kind = 'param'").select(F.col("symbol").alias("scope"), F.col("name").alias("head")).distinct()
    lost = calls.where("effects is null").withColumn("head", F.substring_index("name", ".", 1))
    opaque = lost.where("resolution = 'unresolved'").join(params, ["scope", "head"], "left_anti").select(F.col("scope").alias("node")).distinct().withColumn("unknown", F.lit(True))
    every = facts.where("kind = 'symbol' and value in ('function', 'method')").select(F.col("symbol").alias("node")).distinct()
    out = every.join(atoms, "node", "left").join(opaque, "node", "left")
    return out.select("node", F.coalesce("atoms", F.expr("cast(array() as array<string>)")).alias("atoms"), F.coalesce("unknown", F.lit(False)).alias("unknown"))


def summaries(facts: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """(node, atoms, unknown): own effects with those of everything called.  Writes
    to its own object or parameters stay with the function: a caller may own them."""
    own = settled(own_effects(facts, resolved, names))
    carried = own.withColumn("atoms", F.filter("atoms", lambda a: ~(a.startswith("pw:") | (a == "sw"))))
    kept = own.select("node", F.filter("atoms", lambda a: a.startswith("pw:") | (a == "sw")).alias("kept"))
    out = effect_fold(call_edges(resolved), carried).join(kept, "node", "left")
    return out.select("node", F.sort_array(F.array_union("atoms", F.coalesce("kept", F.expr("cast(array() as array<string>)")))).alias("atoms"), "unknown")


def handler_outcomes(facts: DataFrame) -> DataFrame:
    """(symbol, caught, outcomes): what the handlers of a function do with each type
    they catch: raise again, raise another, give a default, go on, or handle."""
    h = facts.where("kind = 'handler'").select("symbol", F.explode("items").alias("caught"), F.col("value").alias("outcome"))
    return h.groupBy("symbol", "caught").agg(F.sort_array(F.collect_set("outcome")).alias("outcomes"))


def spends(facts: DataFrame, resolved: DataFrame, names: DataFrame) -> DataFrame:
    """(symbol, line, target, effects): calls that cost time or leave the machine;
    calls on a parameter are the caller's."""
    calls = classified(resolved.where("resolution <> 'resolved'"), names)
    costly = calls.withColumn("effects", F.array_intersect("effects", F.array(*map(F.lit, SPENDS)))).where(F.size("effects") > 0)
    params = facts.where("kind = 'param'").select(F.col("symbol").alias("scope"), F.col("name").alias("head")).distinct()
    rows = costly.withColumn("head", F.substring_index("name", ".", 1)).join(params, ["scope", "head"], "left_anti")
    return rows.select(F.col("scope").alias("symbol"), "line", "target", "effects")
