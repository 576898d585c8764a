"""Sinks with a commit protocol: rows as JSON lines with a Markdown scorecard, all or nothing (SK6, SK10).

``df.write.format("scorecard").option("title", ...).mode("overwrite").save(path)``

Each task writes a hidden file of its own and tells the driver its name and its counts. Only when all tasks are done are the files of
those tasks (not those of lost or repeated attempts) given their names, in a folder of their own with the scorecard; then one rename
puts the new ``CURRENT.json`` in place of the old one. Until that moment readers see the old rows, and a job that fails takes its files
away again. Counts of tasks are summed, so that the scorecard needs no second pass; its examples are the first ones by field and
document, at most ``EXAMPLES`` of a task.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

EXAMPLES = 25
NEEDED = ("doc_id", "field", "category", "outcome", "gold", "extracted", "evidence_ok")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, rows, counts by category and outcome, correct ones with evidence, first examples."""

    path: str
    rows: int
    counts: dict
    backed: int
    wrong: list
    invented: list


def scorecard(title: str, parts: list[Part]) -> str:
    """The Markdown of all parts."""
    counts: Counter = Counter()
    for p in parts:
        counts.update(p.counts)
    n = sum(counts.values())
    by = Counter()
    for (_, outcome), c in counts.items():
        by[outcome] += c
    right = by["correct"] + by["correct_abstention"]
    backed = sum(p.backed for p in parts)
    percent = lambda a, b: f"{100 * a / b:.0f}%" if b else "0%"
    out = [
        f"# {title}", "", f"{n} fields scored.", "", f"- Right, abstentions included: **{percent(right, n)}** ({right}/{n})", f"- Missed: **{by['missed']}**", f"- Wrong: **{by['wrong']}**",
        f"- Invented: **{by['hallucinated']}**", f"- Right values with evidence: {backed}/{by['correct']}" + (f" ({percent(backed, by['correct'])})" if by["correct"] else ""),
        "", "| Category | Scored | Right | Missed | Wrong | Invented |", "| --- | --: | --: | --: | --: | --: |",
    ]
    for category in sorted({c for c, _ in counts}, key=str):
        of = {o: c for (k, o), c in counts.items() if k == category}
        out.append(f"| {category} | {sum(of.values())} | {of.get('correct', 0) + of.get('correct_abstention', 0)} | {of.get('missed', 0)} | {of.get('wrong', 0)} | {of.get('hallucinated', 0)} |")
    for head, rows in (("Invented values", [x for p in parts for x in p.invented]), ("Wrong values", [x for p in parts for x in p.wrong])):
        if rows:
            out += ["", f"## {head}", "", *(f"- `{field}` [{doc}]: {extracted!r}, gold {gold!r}" for field, doc, gold, extracted in heapq.nsmallest(EXAMPLES, rows, key=lambda r: tuple(map(str, r))))]
    return "\n".join(out) + "\n"


class ScorecardWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        missing = [c for c in NEEDED if c not in schema.names]
        if missing:
            raise ValueError(f"a scorecard needs the columns {', '.join(missing)}")
        self.path, self.title, self.overwrite = options["path"], options.get("title", "Scorecard"), overwrite
        self.folder = f"results-{uuid.uuid4().hex}"

    def open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> Part:
        fs, root = self.open()
        fs.create_dir(f"{root}/{self.folder}", recursive=True)
        path = f"{root}/{self.folder}/.{uuid.uuid4().hex}"
        counts: Counter = Counter()
        backed, rows, first = 0, 0, {"wrong": [], "hallucinated": []}
        with fs.open_output_stream(path) as out:
            for r in iterator:
                out.write((json.dumps(r.asDict(True), ensure_ascii=False, default=str) + "\n").encode("utf-8", "replace"))
                counts[r["category"], r["outcome"]] += 1
                rows += 1
                backed += bool(r["outcome"] == "correct" and r["evidence_ok"])
                if r["outcome"] in first:
                    held = first[r["outcome"]]
                    held.append((r["field"], r["doc_id"], r["gold"], r["extracted"]))
                    if len(held) > 8 * EXAMPLES:
                        first[r["outcome"]] = heapq.nsmallest(EXAMPLES, held, key=lambda x: tuple(map(str, x)))
        return Part(path, rows, dict(counts), backed, *(heapq.nsmallest(EXAMPLES, first[o], key=lambda x: tuple(map(str, x))) for o in ("wrong", "hallucinated")))

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = self.open()
        folder = f"{root}/{self.folder}"
        fs.create_dir(folder, recursive=True)
        current = f"{root}/CURRENT.json"
        there = fs.get_file_info(current).type == pafs.FileType.File
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{root} holds a scorecard already")
        parts = [m for m in messages if m is not None]
        for n, p in enumerate(parts):
            fs.move(p.path, f"{folder}/part-{n:05d}.jsonl")
        for f in fs.get_file_info(pafs.FileSelector(folder)):
            if f.base_name.startswith("."):
                fs.delete_file(f.path)  # of an attempt that was lost or came second
        with fs.open_output_stream(f"{folder}/summary.md") as out:
            out.write(scorecard(self.title, parts).encode())
        with fs.open_output_stream(f"{root}/.{self.folder}") as out:
            out.write(json.dumps({"folder": self.folder, "rows": sum(p.rows for p in parts)}).encode())
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("results-") and f.base_name != self.folder]
        fs.move(f"{root}/.{self.folder}", current)  # the commit
        for path in old:
            fs.delete_dir(path)

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = self.open()
        if fs.get_file_info(f"{root}/{self.folder}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.folder}")


class Scorecard(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scorecard"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ScorecardWriter(self.options, schema, overwrite)


def write_scorecard(rows: DataFrame, path: str, title: str = "Scorecard") -> None:
    """SK6, SK10: rows (doc_id, field, category, outcome, gold, extracted, evidence_ok and others) as JSON lines with a scorecard."""
    rows.sparkSession.dataSource.register(Scorecard)
    rows.write.format("scorecard").option("title", title).mode("overwrite").save(path)


def read_scorecard(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, str]:
    """The rows and the Markdown of the last write that was committed."""
    folder = spark.read.json(f"{path}/CURRENT.json").first()["folder"]
    text = spark.read.text(f"{path}/{folder}/summary.md", wholetext=True).first()[0]
    return spark.read.schema(schema).json(f"{path}/{folder}/part-*.jsonl"), text
