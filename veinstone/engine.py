"""The catalogue as one object: a store, and the operators applied to its tables.

Reads return DataFrames; changes are transforms whose results are committed together as one version. The
states that records pass through are arguments of the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinstone.functions.code_text import code_hash
from veinstone.functions.schema import KEYS, TABLES
from veinstone.operators import catalog, contracts, graph, merge, mining, stats, verify
from veinstone.sources.code_tree import IGNORED, scan_directory, syntax_errors
from veinstone.sources.commits import commits
from veinstone.sources.store import Store


class InvalidContract(ValueError):
    """The document breaks rules; problems holds them."""

    def __init__(self, problems: list[tuple[str, str, str]]) -> None:
        super().__init__("; ".join(f"{place}: {message}" for _, place, message in problems))
        self.problems = problems


class Engine:
    def __init__(self, spark: SparkSession, root: str, clock: Column | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.now = (F.current_timestamp() if clock is None else clock).cast("timestamp_ntz")

    # reads

    def contract(self, function_id: str) -> DataFrame:
        """The contract of a function with its artifact's name, path and status."""
        artifacts = self.store.read("artifacts").select("function_id", "function_name", "file_path", "status")
        return catalog.lookup(self.store.read("contracts"), "function_id", function_id).join(artifacts, "function_id")

    def contracts(self, function_ids: Iterable[str]) -> DataFrame:
        return catalog.lookup_many(self.store.read("contracts"), "function_id", function_ids)

    def contract_page(self, min_confidence: float = 0.0, status: str | None = None, path_prefix: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of contracts with total, number of invariants and summary, newest first."""
        artifacts = catalog.where_all(self.store.read("artifacts"), {"status": status}, {"file_path": None if path_prefix is None else f"{path_prefix}%"})
        hits = catalog.where_all(self.store.read("contracts"), at_least={"confidence_score": F.lit(float(min_confidence))}).join(artifacts.select("function_id", "file_path", "status"), "function_id")
        paged = catalog.page_with_total(hits, [("updated_at", "desc"), ("function_id", "asc")], limit, offset)
        return paged.withColumns({"n_invariants": catalog.list_size("contract_json", "invariants"), "summary": catalog.shortened(catalog.text_field("contract_json", "intent_summary"), 100)})

    def search(self, pattern: str, limit: int = 10) -> DataFrame:
        joined = self.store.read("contracts").join(self.store.read("artifacts").select("function_id", "function_name"), "function_id")
        return catalog.search(joined, pattern, "function_name", "function_id", limit)

    def suggestions(self, function_id: str, limit: int = 5) -> DataFrame:
        path, _, name = function_id.partition("::")
        return catalog.similar(self.store.read("artifacts"), name or path, path, "function_name", "file_path", "function_id", limit)

    def edges(self) -> DataFrame:
        rows = self.store.read("dependencies").select(F.col("caller_id").alias("caller"), F.col("callee_id").alias("callee"))
        return graph.distinct_edges(rows)

    def dependencies(self, function_id: str, depth: int = 2) -> DataFrame:
        """node, depth, relationship, and whether it has an artifact and a contract."""
        start = self.spark.createDataFrame([(function_id,)], "node string")
        found = graph.dependency_graph(self.edges(), start, max(1, min(5, depth))).withColumnRenamed("node", "function_id")
        found = catalog.with_existence(found, self.store.read("artifacts"), "function_id", "has_artifact")
        return catalog.with_existence(found, self.store.read("contracts"), "function_id", "has_contract")

    def missing_contracts(self, function_id: str, depth: int = 2) -> DataFrame:
        ids = lambda t: self.store.read(t).select(F.col("function_id").alias("node"))
        return graph.missing_records(self.edges(), self.spark.createDataFrame([(function_id,)], "node string"), ids("artifacts"), ids("contracts"), depth)

    def status(self) -> DataFrame:
        return stats.count_by(self.store.read("artifacts"), "status")

    def confidence(self) -> DataFrame:
        return stats.buckets(self.store.read("contracts"), "confidence_score", [0.5, 0.7, 0.9], ["low", "moderate", "good", "high"])

    def history(self, function_id: str | None = None, commit_prefix: str | None = None, pattern: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        rows = catalog.where_all(self.store.read("learning_history"), {"function_id": function_id, "pattern_type": pattern}, {"commit_sha": None if commit_prefix is None else f"{commit_prefix}%"})
        return catalog.page(rows, [("created_at", "desc"), ("id", "asc")], limit, offset)

    # changes

    def scan(self, directory: str, new_status: str, changed_status: str, ignored: Sequence[str] = IGNORED) -> dict[str, int]:
        """Merges a source tree: unchanged code stays untouched, new and changed functions go to the queue; returns the numbers of each outcome."""
        found = scan_directory(self.spark, directory, ignored)
        delta = found.select(
            "function_id", "file_path", F.col("qualified_name").alias("function_name"), "signature", "body", code_hash(F.col("body"), F.col("language")).alias("code_hash"),
            "language", "start_line", "end_line", "parent", F.lit(new_status).alias("status"), self.now.alias("created_at"), self.now.alias("updated_at"),
        )
        delta = graph.cut(delta)
        old = self.store.read("artifacts")
        outcome = graph.cut(merge.classify(old, delta, KEYS["artifacts"], "code_hash"))
        moved = outcome.filter("outcome in ('new', 'changed')")
        fresh = delta.join(moved, "function_id").withColumn("status", F.when(F.col("outcome") == "changed", changed_status).otherwise(F.col("status"))).select(*old.columns)
        queue = self.store.read("queue")
        items = moved.select(
            "function_id", F.when(F.col("outcome") == "new", 100).otherwise(50).alias("priority"), F.lit("PENDING").alias("status"), F.when(F.col("outcome") == "new", "NEW").otherwise("HASH_MISMATCH").alias("reason"),
            F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("string").alias("error_message"), self.now.alias("created_at"), self.now.alias("updated_at"),
        )
        base = self.store.version()
        self.store.commit({"artifacts": merge.upsert(old, fresh, KEYS["artifacts"], ["created_at"]), "queue": merge.upsert(queue, items, KEYS["queue"], ["attempts", "max_attempts", "created_at", "error_message"])}, base)
        return {r.outcome: r.n for r in stats.count_by(outcome, "outcome").collect()}

    def scan_errors(self, directory: str, ignored: Sequence[str] = IGNORED) -> DataFrame:
        return syntax_errors(self.spark, directory, ignored)

    def save_contract(self, function_id: str, document: str, score: float, status: str, script: str | None = None) -> int:
        """Validates and stores a contract and sets its artifact's status in one commit."""
        if problems := contracts.problems(document):
            raise InvalidContract(problems)
        artifacts = self.store.read("artifacts")
        if not catalog.lookup(artifacts, "function_id", function_id).head(1):
            raise KeyError(function_id)
        row = self.spark.createDataFrame([(function_id, document, float(score), script)], "function_id string, contract_json string, confidence_score float, verification_script string")
        row = row.withColumns({"created_at": self.now, "updated_at": self.now})
        hit = F.col("function_id") == function_id
        changed = merge.update_where(artifacts.withColumn("__hit", hit), F.col("__hit"), {"status": F.lit(status), "updated_at": self.now}).drop("__hit")
        return self.store.commit({"contracts": merge.upsert(self.store.read("contracts"), row, KEYS["contracts"], ["created_at"]), "artifacts": changed})

    def add_edges(self, edges: DataFrame) -> int:
        rows = edges.select(F.col("caller").alias("caller_id"), F.col("callee").alias("callee_id"), self.now.alias("created_at"))
        return self.store.commit({"dependencies": merge.insert_ignore(self.store.read("dependencies"), rows, KEYS["dependencies"])})

    def append(self, table: str, rows: DataFrame) -> int:
        """Adds rows to a table whose key is an id, numbering them after the greatest one."""
        old = self.store.read(table)
        numbered = merge.with_ids(old, rows.withColumn("id", F.lit(None).cast("int")), "id").withColumn("id", F.col("id").cast("int"))
        return self.store.commit({table: old.unionByName(numbered.select(*old.columns))})

    def learn(self, repo: str, start: str | None = None) -> DataFrame:
        """commit_sha, file_path, hunk, pattern and confidence of the bug-fix commits of a repository."""
        fixes = commits(self.spark, repo, start, bug_fixes_only=True)
        hunks = mining.hunk_sides(mining.diff_hunks(fixes, "commit_sha", "diff")).filter("trim(added) <> trim(removed)")
        best = mining.best_pattern(mining.pattern_scores(F.col("added"), F.col("removed")))
        return hunks.select("commit_sha", F.col("new_path").alias("file_path"), "hunk", best.alias("b")).select("commit_sha", "file_path", "hunk", "b.pattern", "b.confidence")

    def verify(self, function_id: str, pairs: DataFrame, output: str, inputs: Sequence[str]) -> DataFrame:
        """pairs checked against the invariants of the function's contract."""
        found = self.contract(function_id).select(F.from_json("contract_json", "invariants array<struct<name:string,logic:string,criticality:string>>").alias("c")).head()
        if found is None:
            raise KeyError(function_id)
        rules = [verify.Invariant(i.name, i.logic or "", i.criticality or "MEDIUM") for i in (found.c.invariants if found.c else None) or []]
        return verify.check_rows(pairs, output, inputs, rules)


__all__ = ["Engine", "InvalidContract", "TABLES"]
