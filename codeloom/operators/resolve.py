"""Call resolution: name joins, candidate arms, the winner for each call, closures.

An arm is a function that gives candidates (call_id, callee_file, qualified_name,
dependency_line, start_line, match_rank); arms are united and one grouped minimum
picks the winner, without a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import ascii_lower, basename, dotted_prefixes, dotted_suffixes
from codeloom.operators.scratch import bounded, materialize, materialize_bounded, materialize_counted

CANDIDATE = ("call_id", "callee_file", "qualified_name", "dependency_line", "start_line", "match_rank")


def suffix_join(left: DataFrame, left_key: str, right: DataFrame, right_name: str) -> DataFrame:
    """Pairs where ``right_name`` equals ``left_key`` or ends with '.' and it, letters in either case.

    The names on the right are exploded into their dotted suffixes, so the join is on
    equality; the number of rows grows by the dots of a name.
    """
    suffixes = right.withColumn("_suffix", F.explode_outer(dotted_suffixes(ascii_lower(F.col(right_name)))))
    keyed = left.withColumn("_key", ascii_lower(F.col(left_key)))
    pairs = keyed.join(suffixes, keyed["_key"] == suffixes["_suffix"])
    # A name that equals the key must equal it exactly; only the dotted form folds case.
    return pairs.filter((F.length(left_key) < F.length(right_name)) | (F.col(left_key) == F.col(right_name))).drop("_key", "_suffix")


def prefix_join(left: DataFrame, left_name: str, right: DataFrame, right_key: str) -> DataFrame:
    """Pairs where ``left_name`` begins with ``right_key`` and a dot."""
    prefixes = left.withColumn("_prefix", F.explode(dotted_prefixes(ascii_lower(F.col(left_name)))))
    keyed = right.withColumn("_key", ascii_lower(F.col(right_key)))
    return prefixes.join(keyed, prefixes["_prefix"] == keyed["_key"]).drop("_key", "_prefix")


def path_suffix_join(left: DataFrame, left_suffix: str, files: DataFrame, path: str = "path") -> DataFrame:
    """Pairs where ``path`` ends with ``left_suffix``.

    The suffix may begin inside a part of the path; the parts after that are whole. Folders
    with such parts, each once however many files they stand for, are found by those parts and
    by every ending of the part before; files are then found by their folders. All joins are
    on equality, so names that very many paths or suffixes have do not meet all of each other.
    A suffix without a slash is compared with every ending of the file name.
    """
    parts = F.split(ascii_lower(F.col(left_suffix)), "/", -1)
    whole = F.size(parts) - 1
    own = left.withColumn("_n", whole).withColumn("_tail", F.when(whole > 0, F.xxhash64(F.array_join(F.slice(parts, 2, F.greatest(whole, F.lit(1))), "/")))).withColumn("_first", F.element_at(parts, 1))
    steps = F.split(ascii_lower(F.col(path)), "/", -1)
    ending = lambda n: F.struct(n.alias("n"), F.xxhash64(F.array_join(F.slice(steps, F.size(steps) - n + 1, n), "/")).alias("tail"), F.element_at(steps, -n - 1).alias("before"))
    counts = F.filter(F.sequence(F.lit(1), F.size(steps)), lambda n: n < F.size(steps))
    tails = files.withColumn("_end", F.explode(F.transform(counts, ending)))
    asked = own.filter("_n > 0").select(F.col("_n").alias("_gn"), F.col("_tail").alias("_gtail")).distinct()
    groups = tails.select(F.col("_end.n").alias("_gn"), F.col("_end.tail").alias("_gtail"), F.col("_end.before").alias("_before")).distinct().join(asked, ["_gn", "_gtail"], "left_semi")
    groups = groups.withColumn("_inside", F.explode(F.transform(F.sequence(F.lit(1), F.length("_before") + 1), lambda i: F.substr("_before", i))))
    placed = own.join(groups, (F.col("_n") == F.col("_gn")) & (F.col("_tail") == F.col("_gtail")) & (F.col("_first") == F.col("_inside"))).drop("_gn", "_gtail", "_inside")
    found = placed.join(tails, (F.col("_n") == F.col("_end.n")) & (F.col("_tail") == F.col("_end.tail")) & (F.col("_before") == F.col("_end.before")))
    found = found.filter(ascii_lower(F.col(path)).endswith(ascii_lower(F.col(left_suffix)))).drop("_end", "_before")
    names = files.withColumn("_name", basename(ascii_lower(F.col(path))))
    endings = names.withColumn("_end", F.explode(F.transform(F.sequence(F.lit(1), F.length("_name")), lambda i: F.substr("_name", i)))).drop("_name")
    bare = own.filter("_n = 0").join(endings, ascii_lower(F.col(left_suffix)) == F.col("_end")).drop("_end")
    return found.unionByName(bare).drop("_n", "_tail", "_first")


#: Names in a word of bits, words of a row, and names that are numbered in one task.
NAME_BITS, NAME_WORDS, NAME_ROWS = 64, 4, 1_000_000


def unambiguous_globs(globs: DataFrame, names: DataFrame) -> DataFrame:
    """Glob re-exports that alone offer a name in their file.

    ``globs`` has file and target, ``names`` target and name; gives (file, name, target).
    Names are numbered and travel as sets of bits, so that a glob moves a row for every 256
    neighbouring names and not one for each; bits that two targets of a file have are taken out.
    """
    distinct = names.select("name").distinct()
    count = distinct.count()  # one number reaches the driver
    numbered = distinct.repartitionByRange(max(1, -(-count // NAME_ROWS)), "name").withColumn("_id", F.monotonically_increasing_id())
    row = NAME_BITS * NAME_WORDS
    word, bit = F.floor(F.col("_id") % row / NAME_BITS).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(_id % {NAME_BITS} as int))").alias("_bit")
    numbered = materialize(numbered.select(F.col("name").alias("_name"), F.floor(F.col("_id") / row).alias("_block"), word, bit))
    words = [f"_w{i}" for i in range(NAME_WORDS)]
    own = names.join(numbered, names["name"].eqNullSafe(numbered["_name"])).groupBy("target", "_block").agg(
        *[F.bit_or(F.when(F.col("_word") == i, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)]
    )
    offered = globs.select("file", "target").repartition("target").distinct().join(own, "target")
    sets = offered.groupBy("file", "_block").agg(F.collect_list(F.struct("target", *words)).alias("_sets"))
    none = F.struct(F.lit(0).cast("long").alias("any"), F.lit(0).cast("long").alias("more"))

    def twice(w: str):
        step = lambda s, x: F.struct(s["any"].bitwiseOR(x[w]).alias("any"), s["more"].bitwiseOR(s["any"].bitwiseAND(x[w])).alias("more"))
        return F.aggregate("_sets", none, step)["more"].alias(f"_more{w}")

    sets = sets.select("file", "_block", "_sets", *[twice(w) for w in words]).withColumn("s", F.explode("_sets"))
    bits = F.array(*[F.col(f"s.{w}").bitwiseAND(F.bitwise_not(f"_more{w}")) for w in words])
    alone = sets.select("file", "_block", F.col("s.target").alias("target"), bits.alias("_bits")).filter(F.exists("_bits", lambda b: b != 0))
    table = numbered.groupBy("_block").agg(F.collect_list(F.struct("_word", "_bit", "_name")).alias("_names"))
    named = alone.join(F.broadcast(table) if count <= 200_000 else table, "_block")
    fits = F.filter("_names", lambda n: F.get("_bits", n["_word"]).bitwiseAND(n["_bit"]) != 0)
    return named.select("file", F.explode(F.transform(fits, lambda n: n["_name"])).alias("name"), "target")


#: What one call must share with another for both to have the same target; C# also looks at the caller, a ``require`` at its line.
_ALIKE = ("source_file_id", "language", "callee", "_who", "_at")


def representatives(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One open call for all that are alike, and (call_id, rep) of every open call.

    A name is usually called many times in a file; arms look for it once.
    """
    own = calls.filter("callee_file is null").select(
        "id", "source_file_id", "language", "callee", F.when(F.col("language") == "csharp", F.col("caller")).alias("_who"),
        F.when(ascii_lower(F.col("callee")).startswith("require."), F.col("line")).alias("_at"),
    )
    reps = materialize_bounded(own.groupBy(*_ALIKE).agg(F.min("id").alias("rep")))
    r = reps.select(F.col("rep"), *[F.col(c).alias(f"_r_{c}") for c in _ALIKE])
    alike = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in _ALIKE])
    members = own.join(r, alike).select(F.col("id").alias("call_id"), "rep")
    return reps.select(F.col("rep").alias("id"), "source_file_id", "language", F.col("_who").alias("caller"), "callee", F.lit(None).cast("string").alias("callee_file"), F.col("_at").alias("line")), members


def of_members(winners: DataFrame, members: DataFrame) -> DataFrame:
    """``winners`` (call_id of a representative, ...) for every call that it stands for."""
    w = winners.withColumnRenamed("call_id", "_rep")
    return members.join(w, members["rep"] == w["_rep"]).drop("rep", "_rep")


def best_candidates(arms: list[DataFrame]) -> DataFrame:
    """The winner for each call: lowest rank, shortest qualified name, first line, first path."""
    united = reduce(DataFrame.unionByName, arms)
    order = F.struct("match_rank", F.length("qualified_name"), "dependency_line", "start_line", "callee_file")
    return united.groupBy("call_id").agg(F.min_by("callee_file", order).alias("callee_file"), F.min("match_rank").alias("match_rank"))


def ambiguous_calls(candidates: DataFrame) -> DataFrame:
    """(call_id, n) of the calls that have candidates in more than one file."""
    return candidates.groupBy("call_id").agg(F.count_distinct("callee_file").alias("n")).filter("n > 1")


def drop_ambiguous(winners: DataFrame, candidates: DataFrame) -> DataFrame:
    """Winners without the calls that have candidates in more than one file."""
    return winners.join(ambiguous_calls(candidates), "call_id", "left_anti")


def unique_targets(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value, and that value. Minimum and maximum stand in for the set."""
    one = candidates.groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return one.filter(F.col("_low") == F.col("_high")).select(key, F.col("_low").alias(value))


def apply_winners(calls: DataFrame, winners: DataFrame, confidence: float = 0.72) -> DataFrame:
    """Calls with their winner; the confidence never falls."""
    w = winners.select(F.col("call_id").alias("_call"), F.col("callee_file").alias("_found"))
    joined = calls.join(w, calls["id"] == w["_call"], "left")
    return joined.withColumn("confidence", F.when(F.col("_found").isNotNull(), F.greatest("confidence", F.lit(confidence))).otherwise(F.col("confidence"))).withColumn(
        "callee_file", F.coalesce("callee_file", "_found")
    ).drop("_call", "_found")


def reset_calls(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Forget every target outside the call's own file, as each resolution starts from extraction."""
    f = files.select(F.col("id").alias("_id"), F.col("path").alias("_own"))
    joined = calls.join(f, calls["source_file_id"] == f["_id"], "left")
    foreign = F.col("callee_file").isNotNull() & (F.col("callee_file") != F.col("_own"))
    return joined.withColumn("confidence", F.when(foreign, 0.55).otherwise(F.col("confidence"))).withColumn(
        "callee_file", F.when(~F.coalesce(foreign, F.lit(False)), F.col("callee_file"))
    ).drop("_id", "_own")


def closure(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(start, node): everything that edges (src, dst) reach from ``starts`` (start), cycles included.

    Semi-naive: only nodes new to a start go on; each round is written to the shared
    folder, so lineage stays short and a lost executor costs a re-read.
    """
    e = edges.select("src", "dst").distinct()
    seen, rows = materialize_counted(starts.select("start", F.col("start").alias("node")).distinct())
    frontier = seen
    for _ in range(most_rounds):
        step = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier, new = materialize_counted(step.join(seen, ["start", "node"], "left_anti"))
        if not new:
            return seen
        rows += new
        seen = bounded(seen.unionByName(frontier), rows)
    raise RuntimeError(f"closure has not ended after {most_rounds} rounds")


def walk_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth, via): shortest depth, 1 to ``depth``, at which a node is met, and the first node that leads there.

    Only nodes that no shorter walk has met go on, and each level is written to the
    shared folder, so a cycle is walked once and plans do not nest.
    """
    e = edges.select("src", "dst").distinct()
    frontier, found = starts.select("start", F.col("start").alias("node")).distinct(), None
    for d in range(1, depth + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        if found is not None:
            step = step.join(found.select("start", "node"), ["start", "node"], "left_anti")
        level = materialize(step.select("start", "node", F.lit(d).alias("depth"), "via"))
        found = level if found is None else found.unionByName(level)
        frontier = level.select("start", "node")
        if d < depth and frontier.isEmpty():
            break
    return found


def walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): shortest depth, 1 to ``depth``, at which a node is met."""
    return walk_paths(edges, starts, depth).drop("via")
