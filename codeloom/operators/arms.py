"""Candidate arms of call resolution, as routes.

A route says where a call may lead: a file (its path, or how its path ends) and the
member wanted there. Arms only make routes; one pair of joins, shared by all arms,
finds the files and the members. So no arm scans files or symbols by itself, and
every theta condition on names or paths is an equi-join on an exploded form.

Routes have call_id, to_path, exact, wanted, line and match_rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import ascii_lower, dotted_suffixes
from codeloom.operators import resolve
from codeloom.operators.scratch import materialize_bounded

ROUTE = ("call_id", "to_path", "exact", "wanted", "line", "match_rank")
SCOPES = ("using", "namespace")


def _head(name: str | Column) -> Column:
    return F.substring_index(name, ".", 1)


def _rest(name: str | Column) -> Column:
    """What follows the first dot; null without one."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(F.instr(c, ".") > 0, F.substr(c, F.instr(c, ".") + 1))


def _as_path(dotted: Column) -> Column:
    return F.replace(dotted, F.lit("."), F.lit("/"))


def _route(df: DataFrame, path: Column, wanted: Column, rank: int, exact: bool = False, line: str | Column = "line") -> DataFrame:
    at = F.col(line) if isinstance(line, str) else line
    routes = df.select("call_id", path.alias("to_path"), F.lit(exact).alias("exact"), wanted.alias("wanted"), at.alias("line"), F.lit(rank).alias("match_rank"))
    return routes.filter("to_path is not null and wanted is not null and wanted <> ''").distinct()


def find_members(routes: DataFrame, files: DataFrame, symbols: DataFrame, ended: bool = True) -> DataFrame:
    """Candidates of routes: the file's symbols whose name or qualified name is, or ends with, the wanted member. Without ``ended`` all routes are exact."""
    f = files.select(F.col("id").alias("_file"), F.col("path").alias("callee_file"))
    placed = routes.filter("exact").join(f, F.col("to_path") == F.col("callee_file")).select(*ROUTE, "_file", "callee_file")
    if ended:
        placed = placed.unionByName(resolve.path_suffix_join(routes.filter("not exact"), "to_path", f, "callee_file").select(*ROUTE, "_file", "callee_file"))
    found = _members(materialize_bounded(placed), symbols)
    return found.select("call_id", "callee_file", "qualified_name", F.col("line").alias("dependency_line"), "start_line", "match_rank")


def _members(placed: DataFrame, symbols: DataFrame, *more: str) -> DataFrame:
    """``placed`` (_file, wanted, ...) with each symbol of the file that is called so, or whose qualified name ends so."""
    endings = F.array_distinct(F.concat(dotted_suffixes(ascii_lower(F.col("qualified_name"))), F.array(ascii_lower(F.col("name")))))
    s = symbols.select(F.col("file_id").alias("_owner"), "name", "qualified_name", "start_line", *more, F.explode_outer(endings).alias("_ending"))
    found = placed.join(s, (F.col("_file") == F.col("_owner")) & (ascii_lower(F.col("wanted")) == F.col("_ending")))
    return found.filter((F.col("name") == F.col("wanted")) | (F.col("qualified_name") == F.col("wanted")) | (F.length("qualified_name") > F.length("wanted")))


# --- direct imports ----------------------------------------------------------------------


def direct_candidates(calls: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names, aliases and namespace aliases of direct imports; rank 0 by alias, 1 by name, 2 otherwise.

    A call is routed to each file that its own file imports, with the name that is wanted
    there; files and members are then found by equality, so no call meets a symbol of
    another name.
    """
    own = calls.filter("callee_file is null").select(F.col("id").alias("call_id"), F.col("source_file_id").alias("src"), "callee", F.col("line").alias("call_line"))
    d = deps.filter("resolved_file is not null").select(
        F.col("source_file_id").alias("dep_src"), F.col("resolved_file").alias("to_path"), F.col("local_alias").alias("alias"), F.col("imported_symbol").alias("imported"), "kind", "language", "line"
    )
    joined = own.join(d, own["src"] == d["dep_src"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    alias, callee, imported = F.col("alias"), F.col("callee"), F.col("imported")
    go, rust, csharp = (yes(F.col("language") == x) for x in ("go", "rust", "csharp"))
    dotted = yes(ascii_lower(callee).startswith(F.concat(ascii_lower(alias), F.lit("."))))
    plain = F.when(go, yes(alias == ".")).when(rust, yes(imported == "*") & (alias.isNull() | (alias == callee))).otherwise(True)
    renamed = yes(alias == callee) & imported.isNotNull() & ~go & ~(rust & (imported == "*"))
    through = dotted & ~(go & alias.isin("_", "."))
    required = ascii_lower(callee).startswith("require.") & yes(F.col("line") == F.col("call_line")) & ~go & ~rust
    by_name = F.when(csharp & (F.col("kind") == "using_static"), 0).when(csharp & F.col("kind").isin("using", "namespace"), 2).otherwise(1)
    way = lambda fits, wanted, exact, loose: F.when(fits, F.struct(wanted.alias("wanted"), exact.alias("exact_rank"), F.lit(loose).alias("loose_rank")))
    ways = F.array(
        way(plain, callee, by_name, 2), way(renamed, imported, F.lit(0), 0),
        way(through, F.substr(callee, F.length(alias) + 2), F.lit(0), 0), way(required, F.substr(callee, F.lit(9)), F.lit(0), 0),
    )
    routes = joined.select("call_id", "to_path", "line", (go | rust).alias("strict"), go.alias("functions"), F.explode(F.array_compact(ways)).alias("w"))
    keys = ["call_id", "to_path", "strict", "functions", "wanted", "exact_rank", "loose_rank"]
    routes = routes.select("call_id", "to_path", "line", "strict", "functions", "w.*").filter("wanted is not null and wanted <> ''").groupBy(*keys).agg(F.min("line").alias("line"))
    f = files.select(F.col("id").alias("_file"), F.col("path").alias("callee_file"))
    placed = routes.join(f, F.col("to_path") == F.col("callee_file"))
    found = _members(placed, symbols.withColumn("_function", F.col("kind") == "function") if "kind" in symbols.columns else symbols.withColumn("_function", F.lit(True)), "_function")
    same = F.col("name") == F.col("wanted")
    found = found.filter((~F.col("strict") | same) & (~F.col("functions") | F.col("_function")))
    rank = F.when(same, F.col("exact_rank")).otherwise(F.col("loose_rank"))
    return found.select("call_id", "callee_file", "qualified_name", F.col("line").alias("dependency_line"), "start_line", rank.alias("match_rank"))


# --- Java and C#: files by package and type ------------------------------------------


def _open(calls: DataFrame, language: str) -> DataFrame:
    return calls.filter((F.col("language") == language) & F.col("callee_file").isNull()).select(F.col("id").alias("call_id"), F.col("source_file_id").alias("src"), "caller", "callee")


def _deps(deps: DataFrame, language: str, *kinds: str) -> DataFrame:
    own = deps.filter((F.col("language") == language) & F.col("kind").isin(*kinds))
    return own.select(F.col("source_file_id").alias("dep_src"), "target", "resolved_file", F.col("local_alias").alias("alias"), F.col("imported_symbol").alias("imported"), "line")


def _settled(routes: list[DataFrame]) -> list[DataFrame]:
    """``routes`` as one that is written: what reads it has a short plan, however many joins each took."""
    return [materialize_bounded(reduce(DataFrame.unionByName, routes))]


def java_routes(calls: DataFrame, deps: DataFrame) -> list[DataFrame]:
    """Class.member by a wildcard import, or in the call's own package."""
    own = _open(calls, "java").filter("instr(callee, '.') > 1")
    out = []
    for kind, package in (("import", F.when(F.col("target").endswith(".*"), F.expr("left(target, length(target) - 2)"))), ("package", F.col("target"))):
        d = _deps(deps, "java", kind).withColumn("_package", package).filter("_package is not null and (instr(target, '.') > 0 or resolved_file is null)")
        joined = own.join(d, own["src"] == d["dep_src"])
        out.append(_route(joined, F.concat(_as_path(F.col("_package")), F.lit("/"), _head("callee"), F.lit(".java")), _rest("callee"), 0))
    return _settled(out)


def _scoped(df: DataFrame, key: str, kind: str, deps: DataFrame) -> DataFrame:
    """``df`` with ``scope``, each namespace that the file ``key`` is in or uses, for types without a dot of their own."""
    scopes = _deps(deps, "csharp", *SCOPES).select(F.col("dep_src").alias("_scope_src"), F.col("target").alias("scope")).distinct()
    return df.join(scopes, df[key] == scopes["_scope_src"]).withColumn("_file_end", F.concat(_as_path(F.col("scope")), F.lit("/"), F.col(kind), F.lit(".cs"))).drop("_scope_src")


def _qualified(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.instr(kind, ".") > 0).withColumn("_file_end", F.concat(_as_path(F.col(kind)), F.lit(".cs")))


def _aliased(df: DataFrame, key: str, kind: str, deps: DataFrame) -> DataFrame:
    """``df`` with the file of the type that a using alias of the same name stands for; ``kind`` becomes that type."""
    a = _deps(deps, "csharp", "using_alias").select(F.col("dep_src").alias("_alias_src"), F.col("target").alias("_real"), F.col("alias").alias("_name"))
    joined = df.join(a, (df[key] == a["_alias_src"]) & (df[kind] == a["_name"]))
    return joined.withColumn("_file_end", F.concat(_as_path(F.col("_real")), F.lit(".cs"))).withColumn(kind, F.col("_real")).drop("_alias_src", "_real", "_name")


def _files_ending(df: DataFrame, files: DataFrame) -> DataFrame:
    """``df`` with owner_id and owner_file of the files whose paths end with ``_file_end``."""
    f = files.select(F.col("id").alias("owner_id"), F.col("path").alias("owner_file"))
    return resolve.path_suffix_join(materialize_bounded(df), "_file_end", f, "owner_file")


def bound_calls(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """Calls on a local whose type is known: call_id, src, type, tail (after the local, and after a wrapper's member), line."""
    own = _open(calls, "csharp").withColumn("_local", _head("callee")).filter("instr(callee, '.') > 0")
    b = _deps(deps, "csharp", "type_binding").filter("alias is not null")
    joined = own.join(b, (own["src"] == b["dep_src"]) & (ascii_lower(own["_local"]) == ascii_lower(b["alias"])))
    tail = _rest("callee")
    unwrapped = F.col("imported").isNotNull() & (F.col("imported") != "*") & ascii_lower(tail).startswith(F.concat(ascii_lower(F.col("imported")), F.lit(".")))
    return joined.select("call_id", "src", F.col("target").alias("type"), F.when(unwrapped, F.substr(tail, F.length("imported") + 2)).otherwise(tail).alias("tail"), "line")


def _ends_with(name: Column, end: Column) -> Column:
    return (name == end) | ascii_lower(name).endswith(F.concat(F.lit("."), ascii_lower(end)))


def property_parts(bound: DataFrame, deps: DataFrame, files: DataFrame) -> DataFrame:
    """Bound calls through a property: call_id, owner_id, owner_file, property_type, tail, line."""
    chained = bound.filter("instr(tail, '.') > 0")
    shapes = [_scoped(chained, "src", "type", deps), _qualified(chained, "type"), _aliased(chained, "src", "type", deps)]
    keep = ["call_id", "type", "tail", "line", "_file_end"]
    owners = _files_ending(reduce(DataFrame.unionByName, [s.select(*keep) for s in shapes]), files)
    p = _deps(deps, "csharp", "property_type").filter("alias is not null and imported is not null").select(
        F.col("dep_src").alias("_p_src"), F.col("target").alias("property_type"), F.col("alias").alias("_p_name"), F.col("imported").alias("_p_owner")
    )
    joined = owners.join(p, (owners["owner_id"] == p["_p_src"]) & (_head(owners["tail"]) == p["_p_name"]))
    fits = joined.filter(_ends_with(F.col("type"), F.col("_p_owner")))
    return fits.select("call_id", "owner_id", "owner_file", "property_type", _rest("tail").alias("tail"), "line")


def csharp_routes(calls: DataFrame, deps: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Qualified statics, namespaces, base calls, properties, typed locals and extension methods."""
    own = _open(calls, "csharp")
    end, out = F.col("_file_end"), []
    dotted = own.filter("instr(callee, '.') > 0")

    # A static member by its full name.
    parts = F.split("callee", r"\.", -1)
    full = dotted.filter(F.size(parts) > 2)
    out.append(_route(full, F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.lit(".cs")), F.element_at(parts, -1), 0, line=F.lit(0).cast("long")))

    # A type of the file's own namespace.
    n = _deps(deps, "csharp", "namespace")
    same = dotted.filter("instr(callee, '.') > 1").join(n, dotted["src"] == n["dep_src"])
    out.append(_route(same, F.concat(_as_path(F.col("target")), F.lit("/"), _head("callee"), F.lit(".cs")), _rest("callee"), 1))

    # base.member: in the base type, or in its own base type.
    b = _deps(deps, "csharp", "base_type").filter("alias is not null or imported is not null")
    b = b.select("dep_src", F.col("target").alias("type"), F.coalesce("alias", "imported").alias("_class"), "line")
    based = dotted.filter("lower(callee) like 'base.%'").join(b, dotted["src"] == b["dep_src"])
    # The class may itself be nested in a scope of the caller's qualified name.
    based = based.filter(ascii_lower(F.col("caller")).startswith(F.concat(ascii_lower(F.col("_class")), F.lit("."))) | (F.instr(ascii_lower(F.col("caller")), F.concat(F.lit("."), ascii_lower(F.col("_class")), F.lit("."))) > 0))
    based = materialize_bounded(based.withColumn("wanted", _rest("callee")).select("call_id", "src", "type", "wanted", "line"))
    for shape in (_scoped(based, "src", "type", deps), _qualified(based, "type")):
        out.append(_route(shape, end, F.col("wanted"), 0))
    single = based.filter("instr(wanted, '.') = 0")
    keep = ["call_id", "wanted", "_file_end"]
    near = _scoped(single.filter("instr(type, '.') = 0"), "src", "type", deps).select(*keep).unionByName(_qualified(single, "type").select(*keep))
    owners = materialize_bounded(_files_ending(near, files).select("call_id", "wanted", "owner_id"))
    upper = owners.join(b.select(F.col("dep_src").alias("_up"), F.col("type"), "line"), F.col("owner_id") == F.col("_up"))
    out.append(_route(_scoped(upper, "owner_id", "type", deps), end, F.col("wanted"), 1))

    out = _settled(out)

    # Owner.Property.member of a static owner.
    p = _deps(deps, "csharp", "property_type").filter("alias is not null and imported is not null")
    p = p.select(F.col("dep_src").alias("owner_id"), F.col("target").alias("type"), F.concat("imported", F.lit("."), "alias").alias("_chain"), "line")
    three = full.withColumn("_owner", F.substring_index("callee", ".", 2)).withColumn("wanted", _rest(_rest("callee")))
    static = three.join(p, F.col("_owner") == F.col("_chain")).select("call_id", "owner_id", "type", "wanted", "line")
    for shape in (_scoped(static, "owner_id", "type", deps), _qualified(static, "type")):
        out.append(_route(shape, end, F.col("wanted"), 0))

    out = _settled(out)

    # Typed locals, and their properties.
    bound = materialize_bounded(bound_calls(calls, deps))
    for shape in (_scoped(bound, "src", "type", deps), _qualified(bound, "type"), _aliased(bound, "src", "type", deps)):
        out.append(_route(shape, end, F.col("tail"), 0))
    via = materialize_bounded(property_parts(bound, deps, files))
    out.append(_route(via, F.col("owner_file"), F.concat("property_type", F.lit("."), "tail"), 0, exact=True))
    last = via.filter("instr(tail, '.') = 0")
    for shape in (_scoped(last, "owner_id", "property_type", deps), _qualified(last, "property_type")):
        out.append(_route(shape, end, F.col("tail"), 0))

    out = _settled(out)

    # Extension methods of files that the call's file uses.
    e = _deps(deps, "csharp", "extension_method").filter("alias is not null").select(F.col("dep_src").alias("_e_src"), F.col("target").alias("_on"), F.col("alias").alias("_method"), "line")
    f = files.select(F.col("id").alias("_e_file"), F.col("path").alias("_e_path"))
    u = _deps(deps, "csharp", *SCOPES).filter("resolved_file is not null").select(F.col("dep_src").alias("_u_src"), F.col("resolved_file").alias("_u_to"))
    used = u.join(f, u["_u_to"] == f["_e_path"]).join(e, F.col("_e_file") == F.col("_e_src")).select("_u_src", "_e_path", "_on", "_method", F.col("line").alias("_e_line"))
    typed = bound.join(used, (bound["src"] == used["_u_src"]) & (bound["tail"] == used["_method"]))
    typed = typed.filter(_ends_with(F.col("_on"), F.col("type")) | _ends_with(F.col("type"), F.col("_on")))
    out.append(_route(typed, F.col("_e_path"), F.col("tail"), 1, exact=True, line="_e_line"))
    out = _settled(out)
    named = dotted.join(used, (dotted["src"] == used["_u_src"]) & (F.substring_index(dotted["callee"], ".", -1) == used["_method"]))
    named = named.filter(_ends_with(F.col("callee"), F.concat("_on", F.lit("."), "_method")))
    out.append(_route(named, F.col("_e_path"), F.col("_method"), 2, exact=True, line="_e_line"))
    return _settled(out)


# --- names that files pass on ----------------------------------------------------------


def imported_names(calls: DataFrame, deps: DataFrame) -> DataFrame:
    """What an open call is called in each file that its own file imports: call_id, at, wanted, line, language.

    The callee itself; the imported name behind an alias; the tail behind a namespace
    alias; the imported name and the tail behind the alias of a namespace.
    """
    own = calls.filter("callee_file is null").select(F.col("id").alias("call_id"), F.col("source_file_id").alias("src"), "callee")
    d = deps.filter("resolved_file is not null").select(
        F.col("source_file_id").alias("dep_src"), F.col("resolved_file").alias("at"), F.col("local_alias").alias("alias"), F.col("imported_symbol").alias("imported"), "line", "language"
    )
    joined = own.join(d, own["src"] == d["dep_src"])
    dotted = F.col("alias").isNotNull() & ascii_lower(F.col("callee")).startswith(F.concat(ascii_lower(F.col("alias")), F.lit(".")))
    tail = F.substr("callee", F.length("alias") + 2)
    star = F.coalesce(F.col("imported") == "*", F.lit(False))
    names = F.array_compact(
        F.array(
            F.col("callee"),
            F.when((F.col("alias") == F.col("callee")) & F.col("imported").isNotNull() & ~star, F.col("imported")),
            F.when(dotted & star, tail),
            F.when(dotted & ~star & F.col("imported").isNotNull(), F.concat("imported", F.lit("."), tail)),
        )
    )
    return joined.select("call_id", "at", F.explode(F.array_distinct(names)).alias("wanted"), "line", "language").distinct()


def pass_on(state: DataFrame, deps: DataFrame, kinds: tuple[str, ...], files: DataFrame) -> DataFrame:
    """``state`` (call_id, at, wanted, line) one file further, along edges of ``kinds``.

    A named edge takes the names that begin with its alias to the imported name; an edge
    without an alias, or of '*', passes every name on as it is.
    """
    f = files.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
    e = deps.filter(F.col("kind").isin(*kinds) & F.col("resolved_file").isNotNull()).select(
        F.col("source_file_id").alias("_via"), F.col("resolved_file").alias("_to"), F.col("local_alias").alias("_alias"), F.col("imported_symbol").alias("_imported")
    )
    e = e.join(f, e["_via"] == f["_id"]).select("_path", "_to", "_alias", "_imported")
    named = state.join(e.filter("_alias is not null"), (F.col("at") == F.col("_path")) & (_head("wanted") == F.col("_alias")))
    rest = _rest("wanted")
    new = F.when(F.col("_imported") == "*", rest).when(rest.isNull(), F.coalesce("_imported", "_alias")).otherwise(F.concat(F.coalesce("_imported", "_alias"), F.lit("."), rest))
    named = named.withColumn("_new", new).filter("_new is not null")
    whole = state.join(e.filter("_alias is null"), F.col("at") == F.col("_path")).withColumn("_new", F.col("wanted"))
    return named.unionByName(whole).select("call_id", F.col("_to").alias("at"), F.col("_new").alias("wanted"), "line", F.col("_path").alias("via")).distinct()


def reexport_routes(calls: DataFrame, deps: DataFrame, files: DataFrame) -> list[tuple[DataFrame, bool]]:
    """Routes one and two files further; True marks globs of Rust, which count only if unambiguous."""
    names = materialize_bounded(imported_names(calls, deps))
    out: list[tuple[DataFrame, bool]] = []
    script = names.filter(F.col("language") != "rust").drop("language")
    rust = names.filter(F.col("language") == "rust").drop("language")
    named = deps.filter("kind <> 'rust_reexport' or local_alias is not null")
    globs = deps.filter("kind = 'rust_reexport' and local_alias is null")
    one = materialize_bounded(pass_on(script, deps, ("export_alias",), files))
    space = pass_on(script, deps, ("export_namespace",), files)
    two = pass_on(one.drop("via"), deps, ("export_alias",), files).unionByName(pass_on(one.drop("via"), deps.filter("local_alias is not null"), ("export_namespace",), files))
    rust_one = materialize_bounded(pass_on(rust, named, ("rust_reexport",), files))
    rust_two = pass_on(rust_one.drop("via"), named, ("rust_reexport",), files)
    glob_one = pass_on(rust, globs, ("rust_reexport",), files)
    glob_two = pass_on(rust_one.drop("via"), globs, ("rust_reexport",), files)
    for state, rank, ambiguous in ((one, -1, False), (space, -1, False), (two, -2, False), (rust_one, -1, False), (rust_two, -2, False), (glob_one, -1, True), (glob_two, -2, True)):
        out.append((_route(state, F.col("at"), F.col("wanted"), rank, exact=True), ambiguous))
    return out


def unambiguous(candidates: DataFrame) -> DataFrame:
    """Candidates of calls that lead to one file only."""
    one = resolve.unique_targets(candidates, "call_id", "callee_file")
    return candidates.join(one, ["call_id", "callee_file"], "left_semi")


# --- what is still open --------------------------------------------------------------


def include_closure_calls(calls: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, callee_file) of C and C++ calls with one file among all that they include, directly or not."""
    own = calls.filter(F.col("callee_file").isNull() & F.col("language").isin("c", "cpp")).select(F.col("id").alias("call_id"), F.col("source_file_id").alias("src"), "callee")
    f = files.select(F.col("id").alias("dst"), F.col("path").alias("_path"))
    inc = deps.filter((F.col("kind") == "include") & F.col("language").isin("c", "cpp") & F.col("resolved_file").isNotNull())
    edges = inc.join(f, inc["resolved_file"] == f["_path"]).select(F.col("source_file_id").alias("src"), "dst")
    # The closure is over files, not over calls, and only from files with open calls.
    reach = resolve.closure(edges, own.select(F.col("src").alias("start")).distinct()).filter("start <> node")
    s = symbols.select(F.col("file_id").alias("_file"), F.col("name").alias("_name")).distinct()
    hit = own.join(reach, F.col("src") == F.col("start")).join(s, (F.col("node") == F.col("_file")) & (F.col("callee") == F.col("_name")))
    hit = hit.join(f, F.col("node") == F.col("dst")).select("call_id", F.col("_path").alias("callee_file"))
    return resolve.unique_targets(hit, "call_id", "callee_file")


def _directory(path: str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def go_package_calls(calls: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, callee_file): the one file of an imported package's folder that has the function."""
    own = _open(calls, "go")
    d = deps.filter("language = 'go' and local_alias is not null and local_alias <> '_' and resolved_file is not null").select(
        F.col("source_file_id").alias("dep_src"), F.col("local_alias").alias("alias"), _directory("resolved_file").alias("_dir")
    )
    member = F.when(F.col("alias") == ".", F.col("callee")).when(_head("callee") == F.col("alias"), _rest("callee"))
    wanted = own.join(d, own["src"] == d["dep_src"]).withColumn("_member", member).filter("_member is not null and instr(_member, '.') = 0")
    f = files.filter("language = 'go'").select(F.col("id").alias("_id"), F.col("path").alias("callee_file"), _directory("path").alias("_folder"))
    s = symbols.filter("kind = 'function'").select(F.col("file_id").alias("_file"), F.col("name").alias("_name"))
    offered = f.join(s, f["_id"] == s["_file"]).select("callee_file", "_folder", "_name").distinct()
    hit = wanted.join(offered, (F.col("_dir") == F.col("_folder")) & (F.col("_member") == F.col("_name")))
    return resolve.unique_targets(hit, "call_id", "callee_file")


def _module_files(base: Column, dotted: Column) -> Column:
    """Files of the longest, then ever shorter, leading part of a dotted path below ``base``."""
    parts = F.split(dotted, r"\.", -1)
    below = lambda n: F.concat_ws("/", F.when(base != "", base), F.array_join(F.slice(parts, 1, n), "/"))
    sizes = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.flatten(F.transform(sizes, lambda n: F.array(F.concat(below(n), F.lit(".rs")), F.concat(below(n), F.lit("/mod.rs")))))


def _first_with_member(df: DataFrame, base: Column, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``df`` (call_id, tail) to the first module file below ``base`` that has the tail's last part as a symbol."""
    rows = df.select("call_id", F.substring_index("tail", ".", -1).alias("_member"), F.posexplode(_module_files(base, F.col("tail"))).alias("pos", "_path"))
    f = files.select(F.col("id").alias("_id"), F.col("path").alias("callee_file"))
    s = symbols.select(F.col("file_id").alias("_file"), F.col("name").alias("_name")).distinct()
    hit = rows.join(f, rows["_path"] == f["callee_file"]).join(s, (F.col("_id") == F.col("_file")) & (F.col("_member") == F.col("_name")))
    return hit.groupBy("call_id").agg(F.min_by("callee_file", "pos").alias("callee_file"))


def rust_qualified_calls(calls: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, callee_file) of crate., self. and super. calls."""
    f = files.select(F.col("id").alias("_src"), F.col("path").alias("_from"))
    own = _open(calls, "rust").filter(_head("callee").isin("crate", "self", "super")).join(f, F.col("src") == F.col("_src"))
    stem = F.regexp_extract("_from", r"([^/]*)\.rs$", 1)
    folder = _directory("_from")
    here = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.regexp_replace("_from", r"\.rs$", ""))
    crate = F.regexp_extract("_from", "^((?:.*/)?src)/", 1)
    base = F.when(_head("callee") == "crate", F.when(crate != "", crate).otherwise(folder)).when(_head("callee") == "self", here).otherwise(F.regexp_replace(here, "/?[^/]*$", ""))
    return _first_with_member(own.withColumn("tail", _rest("callee")).withColumn("_base", base), F.col("_base"), files, symbols)


def rust_module_calls(calls: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_id, callee_file) of calls through an imported module, with a path below it."""
    own = _open(calls, "rust")
    d = _deps(deps, "rust", "use").filter("alias is not null and resolved_file is not null")
    joined = own.join(d, (own["src"] == d["dep_src"]) & (_head("callee") == d["alias"])).withColumn("tail", _rest("callee")).filter("instr(tail, '.') > 0")
    base = F.regexp_replace("resolved_file", r"(/?mod)?\.rs$", "")
    return _first_with_member(joined.withColumn("_base", base), F.col("_base"), files, symbols)


def resolve_calls(calls: DataFrame, deps: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All calls with callee_file and confidence: ranked arms first, then the resolvers of what is still open.

    Later resolvers only see calls that earlier ones left open; confidences never fall.
    """
    calls = materialize_bounded(resolve.reset_calls(calls, files))
    open_calls, members = resolve.representatives(calls)
    members = materialize_bounded(members)
    # A handful of names; arms of languages that no open call is written in are left out.
    spoken = {r["language"] for r in open_calls.select("language").distinct().collect()}
    direct = materialize_bounded(direct_candidates(open_calls, deps, files, symbols))
    plain = java_routes(open_calls, deps) if "java" in spoken else []
    plain += csharp_routes(open_calls, deps, files) if "csharp" in spoken else []
    passed = reexport_routes(open_calls, deps, files) if spoken & {"javascript", "typescript", "tsx", "rust"} else []
    named = [r for r, glob in passed if not glob]
    plain += [r for at in range(0, len(named), 2) for r in _settled(named[at : at + 2])]
    arms = [direct, *[unambiguous(materialize_bounded(find_members(*_settled([r]), files, symbols, ended=False))) for r, glob in passed if glob]]
    arms += [materialize_bounded(find_members(reduce(DataFrame.unionByName, plain), files, symbols))] if plain else []
    winners = materialize_bounded(resolve.best_candidates(arms))
    c_like = open_calls.filter(F.col("language").isin("c", "cpp")).select(F.col("id").alias("call_id"))
    winners = resolve.drop_ambiguous(winners, direct.join(c_like, "call_id", "left_semi"))
    done = resolve.apply_winners(calls, resolve.of_members(winners, members), 0.72)
    late = (
        ({"c", "cpp"}, lambda c: include_closure_calls(c, deps, files, symbols), 0.68),
        ({"go"}, lambda c: go_package_calls(c, deps, files, symbols), 0.72),
        ({"rust"}, lambda c: rust_qualified_calls(c, files, symbols), 0.76),
        ({"rust"}, lambda c: rust_module_calls(c, deps, files, symbols), 0.74),
    )
    for languages, resolver, confidence in late:
        if spoken & languages:
            done = materialize_bounded(done)
            done = resolve.apply_winners(done, resolver(done), confidence)
    return done
