"""Folders of one file a document, as Spark data sources: transcripts, and the triage folder.

`spark.dataSource.register` makes both available as formats. Tasks write below a hidden folder of their own job; the
commit moves finished files to their names, an abort deletes them, so a failed write leaves nothing and a task that is
run again overwrites only its own attempt. Readers list names once and read files in tasks, `files_per_task` at a time;
a folder that does not exist is empty. Paths may be of any file system that pyarrow knows (file, hdfs, s3, ...).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

# Endings of each format, of triage records, manifests and full transcripts; length of an excerpt.
ENDINGS = {"markdown": ".md", "text": ".txt"}
RECORD, MANIFEST, TRANSCRIPT = ".json", ".md", ".txt"
EXCERPT = 500
PENDING = ".pending-"

ITEM = (
    "stem string, file string, reason string, held_at string, backend string, best struct<engine:string, score:double>, "
    "candidates array<struct<backend:string, score:double, transcript:string>>, record string, manifest string"
)
HELD = (
    "file string, stem string, reason string, held_at string, backend string, "
    "candidates array<struct<backend:string, score:double, text:string>>, version string"
)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def names(path: str) -> list[str]:
    """File names in a folder, sorted, hidden ones left out; none if there is no such folder."""
    system, folder = located(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))


def stem(name: str) -> str:
    return posixpath.splitext(name)[0]


def content(system: fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as f:
        return f.read().decode("utf-8")


def file_name(name: str) -> str:
    """A name that stays in its folder."""
    if not name or name.startswith(".") or "/" in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FolderWriter(DataSourceWriter):
    """Writes the files that `files(row)` gives; `refuse` (the error mode) finds names that are there already."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.pending = f"{PENDING}{uuid.uuid4().hex}"

    def files(self, row: Row) -> Iterator[tuple[str, str]]:
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, folder = located(self.path)
        task = TaskContext.get()
        own = f"{folder}/{self.pending}/{task.partitionId()}-{task.attemptNumber()}"
        system.create_dir(own, recursive=True)
        done = []
        for row in iterator:
            for name, text in self.files(row):
                with system.open_output_stream(f"{own}/{file_name(name)}") as f:
                    f.write(text.encode("utf-8"))
                done.append(f"{own}/{name}")
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = located(self.path)
        written = [path for m in messages if m for path in m.names]
        new = {posixpath.basename(path) for path in written}
        if len(new) < len(set(written)):
            self.abort(messages)
            raise ValueError("two documents would have the same file")
        if not self.overwrite and (there := sorted(new & set(names(self.path)))):
            self.abort(messages)
            raise ValueError(f"there already: {there[:5]}")
        for path in written:
            target = f"{folder}/{posixpath.basename(path)}"
            if self.overwrite and system.get_file_info(target).type == fs.FileType.File:
                system.delete_file(target)
            system.move(path, target)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = located(self.path)
        if system.get_file_info(f"{folder}/{self.pending}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.pending}")


@dataclass
class Names(InputPartition):
    names: list[str]


class FolderReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def wanted(self) -> list[str]:
        raise NotImplementedError

    def partitions(self) -> list[InputPartition]:
        own = self.wanted()
        return [Names(own[at : at + self.per_task]) for at in range(0, len(own), self.per_task)] or [Names([])]


class Transcripts(DataSource):
    """(stem, format, text): one Markdown or text file a document. A Markdown file opens with its stem as title.

    Writing: option `overwrite` ("true") replaces files of the same name; otherwise they are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "stem string, format string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TranscriptReader(self.options["path"], int(self.options.get("files_per_task", "1000")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TranscriptWriter(self.options["path"], overwrite or self.options.get("overwrite") == "true")


class TranscriptWriter(FolderWriter):
    def files(self, row: Row) -> Iterator[tuple[str, str]]:
        kind = row["format"] or "markdown"
        if kind not in ENDINGS:
            raise ValueError(f"unknown format {kind!r}; known: {sorted(ENDINGS)}")
        body = (row["text"] or "").strip()
        yield f"{row['stem']}{ENDINGS[kind]}", f"# {row['stem']}\n\n{body}\n" if kind == "markdown" else f"{body}\n"


class TranscriptReader(FolderReader):
    def wanted(self) -> list[str]:
        return [n for n in names(self.path) if posixpath.splitext(n)[1] in ENDINGS.values()]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, folder = located(self.path)
        kinds = {ending: kind for kind, ending in ENDINGS.items()}
        for name in partition.names:
            kind, text = kinds[posixpath.splitext(name)[1]], content(system, f"{folder}/{name}")
            title = f"# {stem(name)}\n\n"
            yield stem(name), kind, (text.removeprefix(title) if kind == "markdown" else text).removesuffix("\n")


class Triage(DataSource):
    """The triage folder. Read: one row an item, that is a record, or a manifest that has none beside it. Written: for
    every held file a record, a manifest with a score table and excerpts, and the full transcript of each candidate."""

    @classmethod
    def name(cls) -> str:
        return "triage"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema: StructType) -> DataSourceReader:
        return TriageReader(self.options["path"], int(self.options.get("files_per_task", "1000")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TriageWriter(self.options["path"], overwrite or self.options.get("overwrite") == "true")


class TriageWriter(FolderWriter):
    def files(self, row: Row) -> Iterator[tuple[str, str]]:
        own = [c for c in row["candidates"] or []]
        scored = [c for c in own if c["score"] is not None]
        best = max(scored, key=lambda c: c["score"], default=None)  # the first of equal ones
        transcript = {c["backend"]: f"{row['stem']}.{c['backend']}{TRANSCRIPT}" for c in own}
        record = {
            **{k: row[k] for k in ("file", "stem", "reason", "held_at", "backend")},
            "best": best and {"engine": best["backend"], "score": best["score"]},
            "candidates": [{"backend": c["backend"], "score": c["score"], "transcript": transcript[c["backend"]]} for c in own],
            "version": row["version"],
        }
        yield f"{row['stem']}{RECORD}", json.dumps(record, ensure_ascii=False, indent=2) + "\n"
        table = [f"| {c['backend']} | {c['score']:.4f} |" for c in scored]
        excerpts = [line for c in own for line in (f"### {c['backend']}", "", (c["text"] or "").strip()[:EXCERPT].replace("\n", " "), "")]
        yield f"{row['stem']}{MANIFEST}", "\n".join([f"# {row['stem']}", "", "## Quality scores", "", "| Backend | Score |", "|---|---|", *table, "", "## Transcript excerpts", "", *excerpts])
        for c in own:
            yield transcript[c["backend"]], c["text"] or ""


class TriageReader(FolderReader):
    def wanted(self) -> list[str]:
        """Records, manifests without one, and of those the file that is held beside them: `manifest name/held name`."""
        every = names(self.path)
        records = {n for n in every if n.endswith(RECORD)}
        manifests = {n for n in every if n.endswith(MANIFEST)}
        beside: dict[str, str] = {}
        for n in every:
            if n not in manifests:
                beside.setdefault(stem(n), n)
        return [*sorted(records)] + [f"{m}/{beside.get(stem(m), stem(m))}" for m in sorted(manifests) if stem(m) + RECORD not in records]

    def read(self, partition: Names) -> Iterator[tuple]:
        system, folder = located(self.path)
        for name in partition.names:
            if "/" in name:
                manifest, held = name.split("/")
                yield stem(manifest), held, f"held before records were written; see {manifest}", "", None, None, [], None, manifest
                continue
            item, own = json.loads(content(system, f"{folder}/{name}")), stem(name)
            best = item.get("best")
            manifest = own + MANIFEST if system.get_file_info(f"{folder}/{own}{MANIFEST}").type == fs.FileType.File else None
            candidates = [(c.get("backend", "?"), c.get("score"), c.get("transcript", "")) for c in item.get("candidates") or []]
            yield (item.get("stem", own), item.get("file", own), item.get("reason", ""), item.get("held_at", ""), item.get("backend"),
                   best and (best.get("engine"), best.get("score")), candidates, name, manifest)


def register(spark) -> None:
    for source in (Transcripts, Triage):
        spark.dataSource.register(source)
