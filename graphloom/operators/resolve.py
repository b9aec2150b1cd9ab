"""Call sites to symbols, imports to files: range, band and cascade joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.tables import materialize

LOOK_BACK = 60
#: Confidence of each way of resolution where it finds more than one symbol (fixed values).
CONFIDENCE = {"class_scoped": 0.78, "typed": 0.84, "alias_typed": 0.83, "owner": 0.79, "receiver_scoped": 0.75, "same_file": 0.80, "import_scoped": 0.70, "any": 0.50}
SELF = ("", "self", "cls", "this")


def enclosing(calls: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """For each call (file_path, line) the smallest symbol around its line, by span, then start and id.

    Each line with a call is looked up once, however many calls it has. The file is the equi key; the lines are a range
    condition on it. Of symbols with one range in a file only the least is looked at.
    """
    places = calls.select("file_path", "line").distinct()
    around = symbols.groupBy(F.col("file_path").alias("_f"), "start_line", "end_line").agg(F.min("id").alias("caller_id"))
    inside = (F.col("file_path") == F.col("_f")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_line"), F.col("caller_id"))
    # an aggregate with partial results instead of a window over every candidate
    best = places.join(around, inside).groupBy("file_path", "line").agg(F.min(size)["caller_id"].alias("caller_id"))
    best = materialize(calls.sparkSession, best, "enclosing")  # its size then says how calls are joined to it
    return calls.select(*keys, "file_path", "line").distinct().join(best, ["file_path", "line"]).select(*keys, "file_path", "line", "caller_id")


def look_back(calls: DataFrame, assignments: DataFrame, window: int = LOOK_BACK) -> DataFrame:
    """Types assigned to a call's receiver in the lines before it: (call_id, hint)."""
    a = assignments.select(F.col("file_path").alias("_f"), F.col("receiver").alias("_r"), F.col("line").alias("_l"), F.col("type_name").alias("hint"))
    near = (F.col("file_path") == F.col("_f")) & (F.col("receiver") == F.col("_r")) & (F.col("_l") < F.col("line")) & (F.col("_l") >= F.col("line") - window)
    return calls.join(a, near).select("call_id", "hint").distinct()


def _gathered(rows: DataFrame | None, key: str, value: str, name: str) -> DataFrame | None:
    return None if rows is None else rows.groupBy(key).agg(F.collect_set(value).alias(name))


def _asks(calls: DataFrame, symbols: DataFrame, aliases: DataFrame, type_hints: DataFrame | None, import_hints: DataFrame | None) -> DataFrame:
    """(call_id, way, names, keys): what each way asks of a call's targets, who have one of the names and one of the keys."""
    texts, nothing = "array<string>", F.array().cast("array<string>")
    receiver = F.lower(F.trim(F.coalesce("receiver", F.lit(""))))
    base = calls.select("call_id", "caller_id", "callee", F.coalesce("receiver", F.lit("")).alias("receiver_raw"), receiver.alias("receiver"), "file_path")
    caller = symbols.select(F.col("id").alias("caller_id"), F.col("kind").alias("caller_kind"), F.col("qualified_name").alias("caller_qname"))
    base = base.join(caller, "caller_id")
    for rows, key, value, name in ((type_hints, "call_id", "hint", "types"), (import_hints, "file_path", "hint", "hints")):
        own = _gathered(rows, key, value, name)
        base = base.withColumn(name, nothing) if own is None else base.join(own, key, "left").withColumn(name, F.coalesce(name, nothing))
    of_receiver = aliases.groupBy("file_path", F.col("alias").alias("receiver_raw")).agg(F.collect_set("original").alias("alias_types"))
    base = base.join(of_receiver, ["file_path", "receiver_raw"], "left").withColumn("alias_types", F.coalesce("alias_types", nothing))
    of_callee = aliases.groupBy("file_path", F.col("alias").alias("callee")).agg(F.collect_set("original").alias("originals"))
    base = base.join(of_callee, ["file_path", "callee"], "left")

    tokens = lambda c: F.array_sort(F.array_distinct(F.flatten(F.transform(c, scalar.type_tokens))))
    one = lambda hit, c: F.when(hit & c.isNotNull(), F.array(c))
    own_class = F.regexp_replace("caller_qname", "\\.[^.]*$", "")
    itself = F.col("receiver").isin(*SELF)
    keys = [
        one((F.col("caller_kind") == "method") & itself, own_class),
        tokens("types"),
        tokens("alias_types"),
        one(~itself, F.col("receiver")),
        one(~itself, F.col("receiver")),
        one(F.lit(True), F.col("file_path")),
        F.array_sort(F.filter("hints", lambda h: h != "")),
        F.array(F.lit("")),
    ]
    names = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("callee"), F.coalesce("originals", nothing)), lambda n: n.isNotNull())))
    ways = F.array(*[F.struct(F.lit(i).alias("way"), F.coalesce(k, nothing).cast(texts).alias("keys")) for i, k in enumerate(keys)])
    return base.select("call_id", names.alias("names"), F.explode(F.filter(ways, lambda w: F.size(w["keys"]) > 0)).alias("w")).select("call_id", "w.way", "names", "w.keys")


def _hits(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(way, name, key, target_id): the symbols of each name that a way's key finds. ``wanted`` has distinct (way, name, key).

    Keys are equi keys but for two ways: parts of a qualified name (by their first segment) and hints, which may be any
    text and are compared once for each name and hint, not for each call.
    """
    s = symbols.select("name", F.col("id").alias("target_id"), "kind", "qualified_name", F.col("file_path").alias("target_file")).where("name IS NOT NULL")
    method, segments = F.col("kind") == "method", F.split("qualified_name", "\\.")
    owner = scalar.method_owner(F.col("qualified_name"))
    nothing = F.array().cast("array<string>")
    of_method = lambda c: F.when(method, F.coalesce(c, nothing)).otherwise(nothing)
    above = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), lambda _, i: F.array_join(F.slice(segments, F.lit(1), i + 1), "."))
    tokens = scalar.type_tokens(owner)
    found = [F.array_distinct(of_method(F.when(F.size(segments) > 1, above))), of_method(tokens), of_method(tokens), of_method(F.array(owner)), nothing, F.filter(F.array("target_file"), lambda f: f.isNotNull()), nothing, F.array(F.lit(""))]
    of_way = lambda i, k: F.transform(k, lambda v: F.struct(F.lit(i).alias("way"), v.alias("key")))
    pairs = F.flatten(F.array(*[of_way(i, k) for i, k in enumerate(found)]))
    plain = s.select("name", "target_id", F.explode(pairs).alias("p")).select("p.way", "name", "p.key", "target_id")

    inner = F.array_distinct(of_method(F.when(F.size(segments) > 2, F.slice(segments, F.lit(2), F.size(segments) - 2))))
    parts = s.select("name", "target_id", "qualified_name", F.explode(inner).alias("first"))
    scoped = wanted.where("way = 4").withColumn("first", F.get(F.split("key", "\\."), F.lit(0))).join(parts, ["name", "first"])
    scoped = scoped.where(F.contains("qualified_name", F.concat(F.lit("."), F.col("key"), F.lit("."))))
    ends = reduce(lambda a, b: a | b, [F.endswith("target_file", F.concat(F.lit("/"), F.col("key"), F.lit(x))) for x in (".py", ".ts", ".go")])
    hinted = wanted.where("way = 6").join(s, "name").where(F.contains("qualified_name", F.col("key")) | ends)
    columns = ["way", "name", "key", "target_id"]
    return plain.join(wanted, ["way", "name", "key"], "left_semi").select(columns).unionByName(scoped.select(columns)).unionByName(hinted.select(columns))


def resolve_calls(calls: DataFrame, symbols: DataFrame, aliases: DataFrame | None = None, type_hints: DataFrame | None = None, import_hints: DataFrame | None = None) -> DataFrame:
    """(call_id, target_id, strategy, confidence) for calls with caller_id, callee, receiver and file_path.

    ``aliases`` (file_path, alias, original), ``type_hints`` (call_id, hint) and ``import_hints`` (file_path, hint) are
    optional. Every candidate gets the first of eight strategies that it satisfies; the best strategy of a call wins,
    and a sole winner is certain.

    Calls that ask the same of their targets share one search, and only winners are joined to calls: the work grows with
    calls, symbols and results, not with the pairs of calls and symbols of one name.
    """
    spark = calls.sparkSession
    aliases = aliases if aliases is not None else spark.createDataFrame([], "file_path string, alias string, original string")
    asks, ask = _asks(calls, symbols, aliases, type_hints, import_hints), ["way", "names", "keys"]
    asked = asks.select(ask).distinct().withColumn("name", F.explode("names")).withColumn("key", F.explode("keys"))
    hits = _hits(asked.select("way", "name", "key").distinct(), symbols)
    found = materialize(spark, asked.join(hits, ["way", "name", "key"]).select(*ask, "target_id").distinct(), "targets")
    # a number for each ask that finds something, in order of the ways; the least of a call's is its best
    number = F.shiftleft(F.col("way").cast("bigint"), 56) + F.monotonically_increasing_id()
    numbers = materialize(spark, found.groupBy(ask).agg(F.count("*").alias("n")).withColumn("number", number), "asks")
    best = asks.join(numbers.drop("n"), ask).groupBy("call_id").agg(F.min("number").alias("number"))
    # a call's targets of its best way satisfy no better one, as that would have won
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("way") + 1)
    confidence = F.when(F.col("n") == 1, 1.0).otherwise(pick(CONFIDENCE.values()))
    targets = found.join(numbers, ask).select("number", "target_id", pick(CONFIDENCE).alias("strategy"), confidence.alias("confidence"))
    return best.join(targets, "number").select("call_id", "target_id", "strategy", "confidence")


def call_edges(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """One CALLS edge for each caller, target and line."""
    rows = calls.select("call_id", "caller_id", "file_path", "line").join(resolved, "call_id")
    edges = rows.groupBy(F.col("caller_id").alias("source_id"), F.col("target_id"), F.col("line").alias("line_number")).agg(F.min("file_path").alias("file_path"), F.max("confidence").alias("confidence"))
    return edges.select("source_id", "target_id", F.lit("symbol").alias("source_type"), F.lit("symbol").alias("target_type"), F.lit("CALLS").alias("relationship"), "file_path", "line_number", "confidence")


TS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def import_candidates(imports: DataFrame, go_module: str | None = None) -> DataFrame:
    """(candidate, pos, prefix) of each import: paths to try in order; ``prefix`` asks for the first file below.

    ``imports`` has import_id, file_path, language and module_name.
    """
    module, path = F.col("module_name"), F.col("file_path")
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    join = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))
    dots = F.length(module) - F.length(F.regexp_replace(module, "^\\.+", ""))
    up = F.regexp_replace(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)).cast("int")), "/$", "")
    suffix = F.replace(F.regexp_replace(module, "^\\.+", ""), F.lit("."), F.lit("/"))
    near = scalar.normal_path(join(folder, join(up, suffix)))
    python = F.when(dots > 0, near).otherwise(F.replace(module, F.lit("."), F.lit("/")))
    ts = scalar.normal_path(join(folder, module))
    nothing = F.array().cast("array<string>")
    go_rest = F.lit(None).cast("string") if go_module is None else F.when(F.startswith(module, F.lit(go_module)), F.regexp_replace(F.substr(module, F.lit(len(go_module) + 1)), "^/+", ""))
    package = F.replace(F.regexp_replace(module, "\\.\\*$", ""), F.lit("."), F.lit("/"))
    language = F.col("language")
    exact = (
        F.when((language == "python") & (module != ""), F.array(F.concat(python, F.lit(".py")), F.concat(python, F.lit("/__init__.py"))))
        .when((language == "java") & ~F.endswith(module, F.lit(".*")), F.array(F.concat(package, F.lit(".java"))))
        .when((language == "typescript") & F.startswith(module, F.lit(".")), F.array(*[F.concat(ts, F.lit(e)) for e in TS_ENDINGS]))
        .otherwise(nothing)
    )
    below = (
        F.when((language == "java") & F.endswith(module, F.lit(".*")), package)
        .when((language == "go") & F.startswith(module, F.lit(".")), ts)
        .when(language == "go", go_rest)
    )
    return imports.select("*", exact.alias("exact"), below.alias("below"))


def resolve_imports(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(imports with target_path, external ones). ``files`` has path.

    A prefix is an equi join on every folder above a file; the first path below it wins.
    """
    asked = import_candidates(imports, go_module)
    exact = asked.select("import_id", F.posexplode("exact").alias("pos", "path")).join(files.select("path"), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("target_path"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ending = F.when(F.endswith("path", F.lit(".java")), "java").when(F.endswith("path", F.lit(".go")), "go")
    above = files.select("path", ending.alias("language")).where("language IS NOT NULL").select("path", "language", F.explode(folders).alias("below")).groupBy("language", "below").agg(F.min("path").alias("path"))
    by_prefix = asked.where("below IS NOT NULL").select("import_id", "language", "below").join(above, ["language", "below"]).select("import_id", F.col("path").alias("target_path"))
    found = exact.unionByName(by_prefix)
    return imports.join(found, "import_id"), imports.join(found, "import_id", "left_anti")


def unresolved_share(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """How many calls found no symbol."""
    hit = resolved.select("call_id").distinct().withColumn("hit", F.lit(1))
    return calls.join(hit, "call_id", "left").agg(F.count("*").alias("calls"), F.sum(F.coalesce("hit", F.lit(0))).alias("resolved"))

