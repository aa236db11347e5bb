"""The tools of the engine as methods of a project; each gives a DataFrame.

Arguments are checked here and a bad one is a ValueError; the operators below trust
what they get.
"""

from __future__ import annotations

import os
import subprocess
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import __version__
from codeloom.functions.names import ascii_lower
from codeloom.operators import context, graph, index, incremental, lookup, overview, planning, resolve, semantic
from codeloom.operators.scratch import materialize
from codeloom.sources import backend as backends
from codeloom.sources import records, services, tree

EDGE = ("source_file", "target", "resolved_file", "kind", "language", "line")
# Words of a task that name nothing, and words that are looked for together: fixed values.
STOP_WORDS = frozenset("the and for with from into that this when what where which how why add fix make use change update remove does should can please code file files function".split())
ALIASES = (("route", "routing", "router", "routes"), ("auth", "authentication", "login"), ("settings", "config", "configuration"))
#: Base scores of context candidates by source: ours, as no rule of the kind is documented.
CONTEXT_SCORES = {"seed_file": 100, "task_location": 95, "symbol_definition": 90, "type_relation": 70, "call_graph": 65, "reference": 50, "semantic": 45, "dependency": 40, "fallback": 30}
MAX_LOCATIONS = 16
#: Lines of a chunk that vectors or terms are looked up in, if the project has none yet, and chunks that a context takes.
CHUNK_LINES, CONTEXT_CHUNKS = 40, 12


def required_text(name: str, value: object) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value


def text_list(name: str, value: object, most: int | None = None) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) and v for v in value):
        raise ValueError(f"{name} must be a list of non-empty strings")
    if most is not None and len(value) > most:
        raise ValueError(f"{name} takes at most {most} entries")
    return list(value)


def at_least(name: str, value: object, least: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return value


def parse_location(text: str) -> tuple[str, int | None, int | None]:
    """'path:line[:col]', 'path#Lstart-Lend' or a plain path."""
    import re

    m = re.fullmatch(r"(.+?)#L(\d+)(?:-L?(\d+))?", text) or re.fullmatch(r"(.+?):(\d+)(?::\d+)?", text)
    if not m:
        return text, None, None
    start = int(m[2])
    end = int(m[3]) if m.lastindex == 3 else start
    if start < 1 or end < start:
        raise ValueError(f"bad line range in {text!r}")
    return m[1], start, end


def task_terms(task: str, most: int = 8) -> list[str]:
    """Words of a task that may name something: at least 3 letters, no stop words, with their aliases."""
    import re

    words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", task)]
    found = [w for w in words if len(w) >= 3 and w not in STOP_WORDS]
    for group in ALIASES:
        if any(w in group for w in found):
            found += group
    return list(dict.fromkeys(found))[:most]


def _git(root: str, *args: str) -> bytes | None:
    try:
        got = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout if got.returncode == 0 else None


def git_head(root: str) -> str | None:
    head = _git(root, "rev-parse", "HEAD")
    return head.decode().strip() if head else None


def is_dirty(root: str) -> bool:
    return bool(_git(root, "status", "--porcelain"))


def repository_fingerprint(root: str) -> str | None:
    """Digest of HEAD, of the working tree's difference to it and of untracked files; None outside of a repository."""
    import hashlib

    parts = [_git(root, "rev-parse", "HEAD"), _git(root, "diff", "--binary", "HEAD"), _git(root, "ls-files", "--others", "--exclude-standard", "-z")]
    if any(p is None for p in parts):
        return None
    digest = hashlib.sha256(b"\0".join(parts))
    for name in sorted(filter(None, parts[2].split(b"\0"))):
        with open(os.path.join(os.fsencode(root), name), "rb") as f:
            digest.update(b"\0" + name + b"\0" + f.read())
    return digest.hexdigest()


def freshness(indexed: str | None, current: str | None, forced: bool = False) -> str:
    """Whether an index may be used: forced, non_git, missing, match or changed."""
    if forced:
        return "forced"
    if current is None:
        return "non_git"
    if indexed is None:
        return "missing"
    return "match" if indexed == current else "changed"


@dataclass
class Project:
    """A source tree and its index."""

    spark: SparkSession
    root: str
    store: str | None = None
    _index: index.Index | None = field(default=None, repr=False)
    _vectors: DataFrame | None = field(default=None, repr=False)
    _chunks: DataFrame | None = field(default=None, repr=False)

    # --- index ---------------------------------------------------------------------

    def index_project(self, force: bool = False) -> DataFrame:
        """Index the tree, only what changed since the last run unless forced; one row of counts, scope, duration and freshness.

        With a store the last run may be one of another session; freshness says whether the
        repository is still as it was then.
        """
        began = time.perf_counter()
        current = repository_fingerprint(self.root)
        fresh = freshness(self.stored("repository"), current, force)
        previous = None if force else self._index
        if previous is None and not force and self.store:
            previous = index.open_index(self.spark, self.store)
        found = index.index_tree(self.spark, self.root, previous)
        if self.store and found is not previous:
            found = index.select_previous(found, self.store)
        if self.store and current and self.stored("repository") != current:
            records.write_manifest(self.spark, self.store, (records.read_manifest(self.spark, self.store) or {}) | {"repository": current})
        self._index = found
        scope = index.tree_scope(self.root)
        report = self._index.report().first().asDict()
        row = (*report.values(), scope.include, scope.exclude, int(1000 * (time.perf_counter() - began)), fresh)
        return self.spark.createDataFrame([row], ", ".join(f"{k} long" for k in report) + ", include array<string>, exclude array<string>, duration_ms long, freshness string")

    @property
    def tables(self) -> index.Index:
        if self._index is None:
            self.index_project()
        return self._index

    @property
    def edges(self) -> DataFrame:
        return self.tables.dependencies.select(*EDGE)

    def _texts(self) -> DataFrame:
        """(path, language, text) of the indexed files, under the scope of the index."""
        texts = tree.read_tree(self.spark, self.root, index.tree_scope(self.root)).select("path", "language", "text").filter("text is not null")
        return texts.join(self.tables.files.select("path"), "path", "left_semi")

    def file_metadata(self, file: str) -> DataFrame:
        """The index's row of a file."""
        return self.tables.files.filter(F.col("path") == required_text("file", file))

    def stored(self, key: str) -> str | None:
        """A value that the store keeps beside its tables, by key."""
        return (records.read_manifest(self.spark, self.store) or {}).get(key) if self.store else None

    # --- overview and lookups -----------------------------------------------------------

    def project_overview(self) -> dict[str, DataFrame]:
        t, e = self.tables, self.edges
        return {
            "totals": overview.totals(t.files, t.symbols, e, t.calls),
            "languages": overview.languages(t.files),
            "top_directories": overview.top_directories(t.files),
            "main_directories": overview.main_directories(t.files, t.symbols),
            "symbol_kinds": overview.symbol_kinds(t.symbols),
            "entrypoints": overview.entrypoints(t.files, t.symbols),
            "dependencies": graph.summary(e),
            "top_external": graph.top_external(e),
            "top_relations": graph.top_relations(e),
            "calls": overview.call_summary(t.calls),
        }

    def overview_text(self) -> str:
        """One sentence of the overview, for people."""
        o = self.project_overview()
        totals = o["totals"].first().asDict() | {"type_relation": o["dependencies"].first()["type_relation"]}
        language, directory = o["languages"].first(), o["top_directories"].first()
        return overview.summary_text(totals, language["language"] if language else None, directory["directory"] if directory else None)

    def recommended_next_tools(self) -> DataFrame:
        """(priority, tool, reason) of what to ask next, by what the overview has."""
        o = self.project_overview()
        source = o["entrypoints"].filter("role = 'source'").first()
        edges, calls = o["dependencies"].first(), o["calls"].first()
        rows = [(10, "context_pack", f"start at {source['path']}" if source else "no source entrypoint was found; start at indexed source files")]
        if edges["edges"]:
            rows.append((30, "dependency_graph", f"edges of {source['path']}" if source else "relations of modules and packages"))
        if edges["type_relation"]:
            rows.append((25, "dependency_graph", f"{edges['type_relation']} type relations to check before a contract changes"))
        if source:
            rows.append((40, "impact_analysis", f"what a change of {source['path']} reaches"))
        elif calls["edges"]:
            rows.append((40, "callers", "call edges, as there is no source entrypoint"))
        rows.append((80, "config_status", "commands that validate a change"))
        return self.spark.createDataFrame(rows, "priority int, tool string, reason string").orderBy("priority", "reason")

    def symbol_search(self, query: str, limit: int = 20) -> DataFrame:
        return lookup.symbol_search(self.tables.symbols, required_text("query", query), at_least("limit", limit, 1))

    def file_outline(self, file: str, locations: list[tuple[int, int]] | None = None) -> DataFrame:
        own = self.tables.symbols.filter(F.col("path") == required_text("file", file))
        return lookup.outline(own, locations).orderBy("start_line", "end_line", "qualified_name")

    def dependency_graph(self, files=None, languages=None, kinds=None, limit: int = 500, offset: int = 0) -> dict[str, DataFrame]:
        """A page, and the summary and tops of the same filtered edges."""
        e = graph.filter_edges(self.edges, text_list("files", files), text_list("languages", languages), text_list("kinds", kinds))
        return {
            "edges": graph.page(e, list(graph.EDGE_ORDER), at_least("limit", limit, 1), at_least("offset", offset, 0)),
            "summary": graph.summary(e),
            "nodes": graph.node_count(e),
            "top_sources": graph.top(e, "source_file", "source_file"),
            "top_targets": graph.top(e, "target", "target"),
            "top_external": graph.top_external(e),
            "top_relations": graph.top_relations(e),
        }

    def callers(self, symbol: str, limit: int = 50) -> DataFrame:
        return lookup.callers(self.tables.calls, required_text("symbol", symbol), at_least("limit", limit, 1))

    def callees(self, symbol: str, limit: int = 50) -> DataFrame:
        return lookup.callees(self.tables.calls, required_text("symbol", symbol), at_least("limit", limit, 1))

    def find_references(self, symbol: str, limit: int = 100, include_definitions: bool = False) -> DataFrame:
        return lookup.find_references(self._texts(), required_text("symbol", symbol), at_least("limit", limit, 1), include_definitions)

    # --- chunks and vectors ----------------------------------------------------------

    @staticmethod
    def _provider(name: str | None) -> str | None:
        """A known provider; 'env' is the one that the environment sets, which is made known."""
        if name == "env":
            found = services.provider_from_env()
            if found is None:
                return None
            name = found[0]
            semantic.PROVIDERS[name] = found[1:]
        if name is not None and name not in semantic.PROVIDERS:
            raise ValueError(f"unknown provider {name!r}")
        return name

    def semantic_index(self, chunk_lines: int = 80, provider: str | None = "local-hash", explain: bool = False) -> DataFrame | dict:
        """Chunk the tree, embed the chunks that have no vector yet; one row of counts, and the changes if asked for."""
        provider = self._provider(provider)
        desired = materialize(semantic.chunk_windows(self._texts().withColumnRenamed("path", "file"), at_least("chunk_lines", chunk_lines, 1)))
        stored = self._chunks if self._chunks is not None else desired.limit(0)
        diff = materialize(incremental.chunk_diff(stored, desired))
        counts = incremental.diff_counts(diff, desired)
        self._chunks = desired
        changes = diff.orderBy("file", "start_line", "end_line", "change")
        answer = lambda row: {"counts": row, "changes": changes} if explain else row
        if provider is None:
            return answer(counts.withColumn("generated", F.lit(0)).withColumn("vector_status", F.lit("provider_not_configured")))
        key, model = incremental.CHUNK_KEY, semantic.PROVIDERS[provider][0]
        kept = incremental.kept_vectors(self._vectors, diff) if self._vectors is not None else None
        missing = incremental.missing_vectors(desired, kept, provider, model, key) if kept is not None else desired
        new = materialize(semantic.embed(missing.select(*key, "text"), key, provider, services.batch_size()))
        self._vectors = materialize(new.unionByName(kept)) if kept is not None else new
        return answer(counts.join(F.broadcast(new.agg(F.count("*").alias("generated")))).withColumn("vector_status", F.lit("embeddings_indexed")))

    def embedding_status(self, provider: str | None = "local-hash") -> DataFrame:
        """One row: provider, batch size, chunks, vectors and what is missing; no service is asked."""
        provider, batch = self._provider(provider), services.batch_size()
        n = 0 if self._chunks is None else self._chunks.count()
        have = 0
        if self._vectors is not None and provider is not None:
            have = semantic.vector_counts(self._chunks, self._vectors, provider, semantic.PROVIDERS[provider][0], 0).first()["vectors"]
        status = "disabled" if provider is None else "not_indexed" if not n else "complete" if have >= n else "incomplete"
        return self.spark.createDataFrame([(provider or "disabled", batch, n, have, n - have, status)], "provider string, batch int, chunks long, vectors long, missing long, status string")

    def semantic_search(self, query: str, limit: int = 20, provider: str = "local-hash") -> DataFrame:
        """Nearest chunks to the query's vector; by terms where there are no vectors."""
        required_text("query", query), at_least("limit", limit, 1)
        if self._chunks is None:
            self.semantic_index(provider=None)
        if self._vectors is None:
            return lookup.chunks_matching(self._chunks, query.split(), limit)
        provider = self._provider(provider)
        vector = semantic.PROVIDERS[provider][1]([query])[0].tolist()
        rows = self._vectors.withColumn("chunk", F.concat_ws(":", "file", "start_line", "end_line"))
        return semantic.vector_search(rows, vector, "chunk", "vector", limit)

    # --- planning ----------------------------------------------------------------------

    def _evidence(self, symbols: list[str], files: list[str], depth: int) -> DataFrame:
        """(file, reason, score) rows of all kinds of evidence about the seeds."""
        t, e, parts = self.tables, self.edges, []
        seed_files = self.spark.createDataFrame([(f,) for f in files], "file string")
        known = t.files.select(F.col("path").alias("file"))
        parts.append(planning.evidence(seed_files.join(known, "file", "left_semi"), "seed_file"))
        names = [s.lower() for s in symbols]
        named = lambda c: self._any_name(c, names)
        own = t.symbols.filter(named(F.col("qualified_name")) | F.lower("name").isin(*names)) if names else t.symbols.limit(0)
        own = materialize(own.select(F.col("path").alias("file"), "name", "qualified_name").distinct())
        parts.append(planning.evidence(own, "seed_definition"))
        parts.append(planning.evidence(t.symbols.join(seed_files, t.symbols["path"] == seed_files["file"], "left_semi"), "seed_file_symbol", "path"))
        seeds = materialize(seed_files.union(own.select("file")).distinct())
        edges = e.filter("resolved_file is not null")
        out = edges.join(seeds, edges["source_file"] == seeds["file"], "left_semi")
        parts.append(planning.evidence(out, "dependency_target", "resolved_file"))
        into = edges.join(seeds, edges["resolved_file"] == seeds["file"], "left_semi")
        parts.append(planning.evidence(into.filter("kind <> 'base_type'"), "dependency_source", "source_file"))
        parts.append(planning.evidence(into.filter("kind = 'base_type'"), "type_relation_source", "source_file"))
        if names:
            calls = t.calls.filter(named(F.col("callee")))
            parts.append(planning.evidence(calls, "direct_caller"))
            made = t.calls.filter(named(F.col("caller")))
            parts.append(planning.evidence(made, "callee_source"))
            parts.append(planning.evidence(made.filter("callee_file is not null"), "callee_target", "callee_file"))
            for found in self._references(symbols):
                parts.append(planning.evidence(found.filter("kind <> 'definition'"), "text_reference", "path"))
        if depth > 1:
            start = seeds.select(F.col("file").alias("start"))
            importers = edges.select(F.col("resolved_file").alias("src"), F.col("source_file").alias("dst"))
            parts.append(planning.decayed(resolve.walk(importers, start, depth).filter("depth > 1"), "importer", planning.IMPORTER_DECAY))
            callers = t.calls.filter("callee_file is not null and callee_file <> file").select(F.col("callee_file").alias("src"), F.col("file").alias("dst"))
            parts.append(planning.decayed(resolve.walk(callers, start, depth).filter("depth > 1"), "caller", planning.CALLER_DECAY))
        united = parts[0]
        for p in parts[1:]:
            united = united.unionByName(p)
        return united

    def _references(self, symbols: list[str]) -> list[DataFrame]:
        """Lines that name each symbol; the tree is read once for all of them."""
        named = F.lit(False)
        for s in symbols:
            named = named | F.contains("text", F.lit(s))
        texts = materialize(self._texts().filter(named)) if symbols else None
        return [lookup.reference_lines(texts, s) for s in symbols]

    @staticmethod
    def _any_name(column, names: list[str]):
        fits = F.lit(False)
        for n in names:
            fits = fits | (ascii_lower(column) == n) | ascii_lower(column).endswith("." + n)
        return fits

    def impact_paths(self, files: list[str], depth: int = 1) -> DataFrame:
        """(kind, depth, from, to, file, line): how a change of ``files`` walks to callers and importers."""
        start = self.spark.createDataFrame([(f,) for f in text_list("files", files)], "start string")
        t, out = self.tables, None
        importers = self.edges.filter("resolved_file is not null").select(F.col("resolved_file").alias("src"), F.col("source_file").alias("dst"), "line")
        callers = t.calls.filter("callee_file is not null and callee_file <> file").select(F.col("callee_file").alias("src"), F.col("file").alias("dst"), "line")
        for kind, e in (("importer", importers), ("caller", callers)):
            first = e.groupBy(F.col("src").alias("_src"), F.col("dst").alias("_dst")).agg(F.min("line").alias("line"))
            walked = resolve.walk_paths(e, start, at_least("depth", depth, 1))
            found = walked.join(first, (walked["via"] == first["_src"]) & (walked["node"] == first["_dst"]))
            found = found.select(F.lit(kind).alias("kind"), "depth", F.col("via").alias("from"), F.col("node").alias("to"), F.col("node").alias("file"), "line")
            out = found if out is None else out.unionByName(found)
        return out.orderBy("depth", "kind", "from", "to")

    def impact_analysis(self, symbols=None, files=None, limit: int = 50, depth: int = 1, evidence_limit: int = 20, format: str = "full") -> dict[str, DataFrame]:
        """Files that a change of the seeds reaches, with scores, and the risk over all of them.

        ``format`` 'summary' cuts files and their reasons to ``evidence_limit``; counts are
        taken before any cut.
        """
        symbols, files = text_list("symbols", symbols), text_list("files", files)
        if not symbols and not files:
            raise ValueError("impact_analysis needs symbols or files")
        if format not in ("full", "summary"):
            raise ValueError("format must be full or summary")
        most = at_least("evidence_limit", evidence_limit, 1)
        found = materialize(self._evidence(symbols, files, at_least("depth", depth, 1)))
        scores = materialize(planning.impact_scores([found]))
        ranked = scores.orderBy(F.desc("score"), "file").limit(at_least("limit", limit, 1))
        risk = planning.impact_risk(scores, depth)
        counts = scores.agg(F.count("*").alias("files")).join(F.broadcast(found.agg(F.count("*").alias("evidence"), F.count_distinct("reason").alias("reasons"))))
        out = {
            "files": ranked,
            "evidence": found.orderBy(F.desc("score"), "file", "reason").limit(most),
            "breakdown": found.groupBy("reason").agg(F.count("*").alias("n"), F.sum("score").alias("score")),
            "counts": counts,
            "risk": risk,
            "paths": self.impact_paths(files, depth) if files else None,
            "checks": self.suggested_checks(scores),
            "review": self._review(risk, depth, ranked),
        }
        if format == "summary":
            out["files"] = ranked.limit(most).withColumn("reasons", F.slice("reasons", 1, most))
            out["paths"] = out["paths"].limit(most) if files else None
        return {k: v for k, v in out.items() if v is not None}

    def _review(self, risk: DataFrame, depth: int, ranked: DataFrame) -> DataFrame:
        """(topic, detail) of what a reviewer should look at: the risk, the depth, index errors, the first file."""
        r, top, errors = risk.first(), ranked.first(), self.tables.errors.count()
        rows = [("risk", f"{r['risk']} risk over {r['files']} files")]
        rows += [("depth", f"indirect evidence up to depth {depth}")] if depth > 1 else []
        rows += [("errors", f"{errors} files could not be read or parsed")] if errors else []
        rows += [("top_file", top["file"])] if top else []
        return self.spark.createDataFrame(rows, "topic string, detail string")

    def suggested_checks(self, scores: DataFrame) -> DataFrame:
        """(rank, command, reason): focused tests first, then checks of the configuration that fit any file reached, then commands of the ecosystem."""
        config = tree.load_config(self.root)
        tests = [r["file"] for r in scores.filter(F.col("file").rlike(r"(^|/)tests?/|(^|/)test_|_test\.|\.(test|spec)\.")).orderBy(F.desc("score"), "file").limit(5).collect()]
        rows = [(f"pytest {f}" if f.endswith(".py") else f"run the tests of {f}", "focused test") for f in tests]
        checks = [c for c in config.checks if c.get("command")]
        if checks:
            language = self.tables.files.select(F.col("path").alias("file"), "language")
            fits = lambda c: F.col("file").startswith(c.get("path_prefix", "")) & (F.lit("language" not in c) | (F.col("language") == c.get("language")))
            hit = scores.join(language, "file", "left").agg(*[F.coalesce(F.max(fits(c)), F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks)]).first()
            rows += [(c["command"], f"configured for {c.get('path_prefix') or c.get('language') or 'all files'}") for i, c in enumerate(checks) if hit[i]]
        commands = config.test_commands or tree.test_commands(os.listdir(self.root))
        rows += [(c, "configured" if config.test_commands else "detected") for c in commands]
        rows = [(i + 1, *r) for i, r in enumerate(dict.fromkeys(rows))]
        return self.spark.createDataFrame(rows, "rank int, command string, reason string")

    def seeds_of(self, task: str, seed_files=None, seed_symbols=None) -> tuple[str, list[str], list[str]]:
        """(strategy, files, symbols) to begin with: what is named, what the task names, or an entrypoint.

        What comes later in this order is looked for only if nothing before it was found.
        """
        import re

        files, symbols = text_list("seed_files", seed_files, MAX_LOCATIONS), text_list("seed_symbols", seed_symbols)
        found: dict[str, object] = dict.fromkeys(("explicit", "task_path", "path_indexed", "task_match", "entrypoint", "source_file"))
        known = self.tables.files
        if files or symbols:
            found["explicit"] = "named"
        else:
            for token in re.findall(r"[\w./-]+\.\w+", task):
                indexed = not known.filter(F.col("path") == token).isEmpty()
                if indexed or os.path.exists(os.path.join(self.root, token)):
                    found |= {"task_path": token, "path_indexed": indexed}
                    break
        if not any(found.values()):
            found["task_match"] = self._task_match(task)
        if not any(found.values()):
            entry = overview.entrypoints(known, self.tables.symbols).filter("role = 'source'").first()
            found["entrypoint"] = entry["path"] if entry else None
        if not any(found.values()):
            first = known.orderBy("path").first()
            found["source_file"] = first["path"] if first else None
        row = self.spark.createDataFrame([tuple(found.values())], "explicit string, task_path string, path_indexed boolean, task_match string, entrypoint string, source_file string")
        got = planning.infer_seed(row).first()
        if got["strategy"] == "explicit":
            return "explicit", files, symbols
        return got["strategy"], [got["seed"]] if got["seed"] and got["strategy"] != "auto_task_path_unindexed" else [], []

    def _task_match(self, task: str) -> str | None:
        """The file that the words of a task fit best, by its path and its symbols."""
        terms = task_terms(task)
        if not terms:
            return None
        score = F.lit(0)
        for t in terms:
            score = score + F.when(F.lower("path").contains(t), 2).otherwise(0)
        named = self.tables.symbols.filter(F.lower("name").isin(*terms)).groupBy("path").agg(F.count("*").alias("_n"))
        best = self.tables.files.join(named, "path", "left").withColumn("_score", score + F.coalesce("_n", F.lit(0))).filter("_score > 0")
        row = best.orderBy(F.desc("_score"), "path").first()
        return row["path"] if row else None

    def _context_parts(self, task: str, locations: list[tuple[str, int | None, int | None]], symbols: list[str]) -> list[DataFrame]:
        """Ranges of every source of context around the seeds."""
        t, e, score = self.tables, self.edges.filter("resolved_file is not null"), CONTEXT_SCORES
        seeds = self.spark.createDataFrame(locations, "file string, start_line long, end_line long")
        ranged = seeds.filter("start_line is not null")
        whole = seeds.filter("start_line is null").select("file").join(t.files.select(F.col("path").alias("file"), F.col("line_count").alias("end_line")), "file")
        parts = [context.ranges(ranged, "task_location", score["task_location"]), context.ranges(whole.withColumn("start_line", F.lit(1)), "seed_file", score["seed_file"])]
        names = [x.lower() for x in symbols]
        own = t.symbols.filter(self._any_name(F.col("qualified_name"), names) | F.lower("name").isin(*names)) if names else t.symbols.limit(0)
        own = materialize(own.select(F.col("path").alias("file"), "start_line", "end_line"))
        parts.append(context.ranges(own, "symbol_definition", score["symbol_definition"]))
        files = materialize(seeds.select("file").union(own.select("file")).distinct())
        into = e.join(files, e["resolved_file"] == files["file"], "left_semi")
        parts.append(context.around(into.filter("kind = 'base_type'"), "type_relation", score["type_relation"], file="source_file"))
        parts.append(context.around(into.filter("kind <> 'base_type'"), "dependency", score["dependency"], file="source_file"))
        parts.append(context.heads(e.join(files, e["source_file"] == files["file"], "left_semi").select("resolved_file").distinct(), "dependency", score["dependency"], "resolved_file"))
        if names:
            parts.append(context.around(t.calls.filter(self._any_name(F.col("callee"), names)), "call_graph", score["call_graph"]))
            made = t.calls.filter(self._any_name(F.col("caller"), names) & F.col("callee_file").isNotNull())
            made = made.select(F.col("callee_file").alias("_file"), F.substring_index("callee", ".", -1).alias("_name")).distinct()
            called = made.join(t.symbols, (made["_file"] == t.symbols["path"]) & (made["_name"] == t.symbols["name"]))
            parts.append(context.ranges(called, "call_graph", score["call_graph"], file="_file"))
            parts += [context.around(r.filter("kind <> 'definition'"), "reference", score["reference"], file="path") for r in self._references(symbols)]
        else:
            calls = t.calls.join(files.withColumnRenamed("file", "callee_file"), "callee_file", "left_semi").filter("callee_file <> file")
            parts.append(context.around(calls, "call_graph", score["call_graph"]))
        if self._vectors is not None:
            near = self.semantic_search(task, CONTEXT_CHUNKS).select(F.split("chunk", ":").alias("_c"))
            near = near.select(F.concat_ws(":", F.slice("_c", 1, F.size("_c") - 2)).alias("file"), F.element_at("_c", -2).alias("start_line"), F.element_at("_c", -1).alias("end_line"))
            parts.append(context.ranges(near, "semantic", score["semantic"]))
        else:
            if self._chunks is None:
                self.semantic_index(CHUNK_LINES, provider=None)
            parts.append(context.ranges(lookup.chunks_matching(self._chunks, task_terms(task), CONTEXT_CHUNKS), "fallback", score["fallback"]))
        return parts

    def context_pack(self, task: str, seed_files=None, seed_symbols=None, token_budget: int = 6000) -> dict:
        """What to read first for a task: ranked ranges of lines under a token budget, and what was left out."""
        required_text("task", task)
        budget = at_least("token_budget", token_budget, 1)
        strategy, files, symbols = self.seeds_of(task, seed_files, seed_symbols)
        locations = [parse_location(f) for f in files]
        out = {"strategy": strategy, "seed_files": [f for f, _, _ in locations], "seed_symbols": symbols, "applied_budget": max(budget, planning.LEAST_BUDGET)}
        if not files and not symbols:
            return out | {"status": "blocked_no_seed"}
        wants_tests = any(t.startswith("test") for t in task_terms(task))
        in_test = F.col("file").rlike(r"(^|/)tests?/|(^|/)test_|_test\.|\.(test|spec)\.")
        boost = F.when(in_test, 30 if wants_tests else -30).otherwise(0)
        for t in task_terms(task):
            boost = boost + F.when(F.lower("file").contains(t), 5).otherwise(0)
        sized = self.tables.files.select(F.col("path").alias("file"), "line_count")
        candidates = materialize(context.candidates(self._context_parts(task, locations, symbols), sized, boost))
        cut = materialize(planning.budget_cut(candidates, budget))
        selected = cut.filter("selected")
        # A range that is too long for the budget alone is trimmed to it.
        if selected.isEmpty() and not cut.isEmpty():
            room = max(budget, planning.LEAST_BUDGET) // context.TOKENS_PER_LINE
            selected = planning.trim_ranges(cut.filter("rank = 1"), room).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
            selected = materialize(selected.withColumn("tokens", F.col("lines") * context.TOKENS_PER_LINE).withColumn("selected", F.lit(True)))
        own = context.by_file(selected).join(sized, "file")
        all_files = context.by_file(cut.select("file", "rank", "score", "lines", "tokens"))
        counts = cut.agg(F.count_distinct("file").alias("candidates"), F.count("*").alias("candidate_ranges"))
        counts = counts.join(F.broadcast(selected.agg(F.count_distinct("file").alias("selected"), F.count("*").alias("selected_ranges"))))
        counts = counts.withColumn("raised", F.lit(budget < planning.LEAST_BUDGET)).withColumn("exhausted", F.col("selected_ranges") < F.col("candidate_ranges"))
        lines = self.tables.files.agg(F.sum("line_count").alias("baseline")).join(F.broadcast(selected.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("selected"))))
        mix = planning.source_mix(selected.select("file", F.explode("sources").alias("source")))
        return out | {
            "status": "ok",
            "files": own.orderBy("rank"),
            "ranges": selected.select("file", "start_line", "end_line", "rank", "score", "sources", "lines", "tokens").orderBy("file", "start_line"),
            "locations": context.location_map(selected),
            "omitted": planning.omitted(all_files, own),
            "continuation": planning.continuation(counts),
            "plan": planning.reading_plan(mix),
            "read_less": planning.read_less(lines),
        }

    def agent_route(self, task: str, seed_files=None, seed_symbols=None, token_budget: int = 6000, backend: list[str] | None = None) -> dict:
        """Index, overview, context and impact in one answer, with what an external backend says about it."""
        report = self.index_project().first().asDict()
        pack = self.context_pack(task, seed_files, seed_symbols, token_budget)
        files = [r["file"] for r in pack["files"].limit(16).collect()] if "files" in pack else []
        row = [(files[0] if files else None, files, backend)]
        agree = planning.agreement(self.spark.createDataFrame(row, "first_file string, selected array<string>, backend array<string>")).first()
        score = {"explicit": 90, "auto_task_path": 85, "auto_task_match": 70, "auto_entrypoint": 50, "auto_source_fallback": 30}.get(pack["strategy"], 0)
        score = 0 if not files else score - (20 if agree["agreement"] == "conflict" else 0)
        warnings = [w for w, there in (("no_seed", not files), ("backend_conflict", agree["agreement"] == "conflict"), ("index_errors", report["errors"] > 0)) if there]
        return {
            "index": report,
            "overview": self.project_overview(),
            "context": pack,
            "impact": self.impact_analysis(files=files[:1]) if files else None,
            "first_file": files[0] if files else None,
            "agreement": agree["agreement"],
            "quality_score": score,
            "quality_level": "high" if score >= 80 else "medium" if score >= 50 else "low" if score else "blocked",
            "warnings": warnings,
            "steps": ["index_project", "project_overview", "context_pack", "impact_analysis"],
        }

    def agent_first_read(
        self, task: str, seed_files=None, seed_symbols=None, token_budget: int = 6000, backend_command: list[str] | None = None, backend_json: str | None = None,
        backend_file: str | None = None, backend_head: str | None = None, force: bool = False, deadline: float = 30.0,
    ) -> dict:
        """The compact answer for a first read: where to begin, its ranges, and what an external backend says.

        The backend's answer comes from a command, a JSON text or a file; a command gets
        the one word of the task that tells most as its last argument. ``backend_head`` is
        the commit that the backend indexed.
        """
        required_text("task", task)
        command = text_list("backend_command", backend_command)
        if command:
            command = [*command, services.search_pattern(task_terms(task)) or task]
        evidence = backends.evidence(command, backend_json, backend_file, backends.COMPACT, deadline)
        self.index_project()
        pack = self.context_pack(task, seed_files, seed_symbols, token_budget)
        files = [r["file"] for r in pack["files"].limit(backends.COMPACT).collect()] if "files" in pack else []
        named = [c["file"] for c in evidence.candidates] if evidence else None
        agree = planning.agreement(self.spark.createDataFrame([(files[0] if files else None, files, named)], "first_file string, selected array<string>, backend array<string>")).first()
        current = repository_fingerprint(self.root)
        state = None
        if evidence:
            cached = self.stored("backend_fingerprint")
            there = {r["path"] for r in self.tables.files.filter(F.col("path").isin(*named)).select("path").collect()} if named else set()
            head = git_head(self.root)
            state = backends.freshness(
                current, cached, forced=force, head=head, indexed_head=backend_head, dirty=is_dirty(self.root), indexed=bool(named), lost=len(set(named) - there)
            )
            if self.store and current and state in ("forced", "cached", "changed", "head_match"):
                kept = records.read_manifest(self.spark, self.store) or {}
                records.write_manifest(self.spark, self.store, kept | {"backend_fingerprint": current})
        return {
            "status": pack["status"],
            "strategy": pack["strategy"],
            "first_file": files[0] if files else None,
            "files": files,
            "ranges": pack.get("ranges"),
            "backend": None if evidence is None else {"provider": evidence.provider, "candidates": evidence.candidates, "total": evidence.total, "omitted": evidence.omitted, "freshness": state},
            "agreement": agree["agreement"],
            "next": "read_ranges" if files else "name_a_seed",
        }

    def config_init(self, force: bool = False) -> str:
        """Write a sample configuration; the path that was written."""
        return tree.write_config(self.root, force)

    def config_status(self) -> DataFrame:
        return tree.config_status(self.spark, self.root)

    @staticmethod
    def version() -> str:
        return __version__


#: Tools by the names under which they are called from outside.
TOOLS = (
    "agent_first_read", "agent_route", "callees", "callers", "config_status", "context_pack", "dependency_graph", "embedding_status", "file_outline",
    "find_references", "impact_analysis", "index_project", "project_overview", "semantic_index", "semantic_search", "symbol_search", "version",
)
