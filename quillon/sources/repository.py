"""Version-control repositories and folders as tables.

Commit metadata, references and trees are listed with the ``git`` program on
the driver and written as tables; blobs, the bulk, are read by tasks in batches
of object names, so the repository must be on storage that all executors see.
A snapshot is written once as parquet and queried many times.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

COMMITS = "oid string, short_id string, message string, author string, ts long, parents array<string>"
SEPARATOR = "\x1f"
FIELDS = SEPARATOR.join(("%H", "%P", "%an", "%at", "%B"))


class RepositoryNotFound(FileNotFoundError):
    pass


def git(repo: str, *args: str, text: bool = True, stdin: bytes | None = None):
    done = subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace") if text else done.stdout


def discover(path: str) -> str:
    """The folder itself, or the nearest one above it, that holds a repository."""
    at = Path(path).resolve()
    for folder in (at, *at.parents):
        if (folder / ".git").exists() or (folder / "HEAD").is_file() and (folder / "objects").is_dir():
            return str(folder)
    raise RepositoryNotFound(path)


def known_start(repo: str, start: str) -> bool:
    """Whether a walk can begin: false for the HEAD of a repository without commits; any other unknown name is an error."""
    if start == "--all" or resolve(repo, start) is not None:
        return True
    if start == "HEAD":
        return False
    raise ValueError(f"commit not found: {start}")


def commit_ids(repo: str, start: str, limit: int | None) -> list[str]:
    """Ids of the commits reachable from a start, newest first by time."""
    if not known_start(repo, start):
        return []
    return git(repo, "rev-list", "--date-order", *([f"-n{limit}"] if limit is not None else []), start, "--").split()


def commit_rows(listed: str) -> list[tuple]:
    """Rows of the commits that git listed by ``FIELDS``."""
    rows = []
    for entry in listed.split("\0"):
        if entry.count(SEPARATOR) >= 4:
            oid, parents, author, ts, message = entry.split(SEPARATOR, 4)
            rows.append((oid, oid[:7], message.strip(), author, int(ts), parents.split()))
    return rows


def commits(spark: SparkSession, repo: str, start: str = "HEAD", limit: int | None = None) -> DataFrame:
    """The commits reachable from a start (``--all`` for all references), newest first by time; the newest ``limit`` of them.

    None while HEAD has no commit; an unknown start is an error.
    """
    raw = git(repo, "log", "-z", f"--format={FIELDS}", "--date-order", *([f"-n{limit}"] if limit is not None else []), start, "--") if known_start(repo, start) else ""
    return spark.createDataFrame(commit_rows(raw), COMMITS)


def resolve(repo: str, name: str) -> str | None:
    """The commit id that any name git knows stands for (``HEAD~1``, ``x^2``, annotated tags)."""
    try:
        return git(repo, "rev-parse", "--verify", "-q", "--end-of-options", f"{name}^{{commit}}").strip()
    except subprocess.CalledProcessError:
        return None


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """(oid, ref): HEAD and the short name of every reference, peeled to commits."""
    rows = []
    try:
        rows.append((git(repo, "rev-parse", "--verify", "-q", "HEAD").strip(), "HEAD"))
    except subprocess.CalledProcessError:
        pass
    for line in git(repo, "for-each-ref", "--format=%(objectname) %(*objectname) %(refname:short)").splitlines():
        first, _, rest = line.partition(" ")
        peeled, _, name = rest.partition(" ")
        rows.append((peeled or first, name))
    return spark.createDataFrame(rows, "oid string, ref string")


def branch(spark: SparkSession, repo: str) -> DataFrame:
    """One row of the current branch; none while it has no commit."""
    try:
        head = git(repo, "rev-parse", "--verify", "-q", "HEAD").strip()
    except subprocess.CalledProcessError:
        return spark.createDataFrame([], "name string, head_oid string, head_short string, upstream string, ahead long, behind long")
    name = git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    name = f"(detached {head[:7]})" if name == "HEAD" else name
    try:
        upstream = git(repo, "rev-parse", "--abbrev-ref", "--symbolic-full-name", "@{upstream}").strip()
        behind, ahead = map(int, git(repo, "rev-list", "--left-right", "--count", "@{upstream}...HEAD").split())
    except subprocess.CalledProcessError:
        upstream, ahead, behind = None, 0, 0
    return spark.createDataFrame([(name, head, head[:7], upstream, ahead, behind)], "name string, head_oid string, head_short string, upstream string, ahead long, behind long")


def tree_rows(oid: str, listed: str) -> Iterator[dict]:
    """Rows of the files that git listed of one commit's tree."""
    for line in listed.split("\0"):
        if "\t" in line:
            meta, path = line.split("\t", 1)
            _, kind, sha, size = meta.split()
            if kind == "blob":
                yield {"oid": oid, "path": path, "blob_sha": sha, "size": int(size)}


def tree_entries(commit_rows: DataFrame, repo: str) -> DataFrame:
    """(oid, path, blob_sha, size) of every file of every commit, listed by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for oid in batch.column(0).to_pylist():
                rows = list(tree_rows(oid, git(repo, "ls-tree", "-r", "-l", "-z", oid)))
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("oid", pa.string()), ("path", pa.string()), ("blob_sha", pa.string()), ("size", pa.int64())]))

    return commit_rows.select("oid").mapInArrow(run, "oid string, path string, blob_sha string, size long")


def blobs(entries: DataFrame, repo: str, cap: int) -> DataFrame:
    """(blob_sha, content) of the distinct blobs within the cap; one git process a task reads them."""
    schema = pa.schema([("blob_sha", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as server:
            for batch in batches:
                for sha in batch.column(0).to_pylist():
                    server.stdin.write(sha.encode() + b"\n")
                    server.stdin.flush()
                    head = server.stdout.readline().split()
                    if len(head) == 3:
                        body = server.stdout.read(int(head[2]))
                        server.stdout.read(1)
                        yield pa.RecordBatch.from_pylist([{"blob_sha": sha, "content": body}], schema=schema)
            server.stdin.close()

    return entries.filter(F.col("size") <= cap).select("blob_sha").distinct().mapInArrow(run, "blob_sha string, content binary")


def changed_files(commit_rows: DataFrame, repo: str) -> DataFrame:
    """(parent, oid, path, status, old_path) against each commit's only parent, similar files as renames; one git process a batch."""
    names = {"A": "added", "D": "removed", "R": "renamed"}
    schema = pa.schema([(c, pa.string()) for c in ("parent", "oid", "path", "status", "old_path")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            asked = "".join(f"{oid}\n" for oid in parents).encode()
            parts = git(repo, "diff-tree", "--stdin", "-r", "-M", "-z", "--name-status", stdin=asked).split("\0")
            rows, oid, i = [], None, 0
            while i < len(parts) and parts[i]:
                if parts[i] in parents:  # the commit that the following entries belong to
                    oid, i = parts[i], i + 1
                    continue
                code = parts[i][:1]
                two = code in ("R", "C")
                path, old = (parts[i + 2], parts[i + 1]) if two else (parts[i + 1], None)
                rows.append({"parent": parents[oid], "oid": oid, "path": path, "status": names.get(code, "modified"), "old_path": old if code == "R" else None})
                i += 3 if two else 2
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = commit_rows.filter(F.size("parents") == 1).select("oid", F.col("parents")[0].alias("parent"))
    return own.mapInArrow(run, "parent string, oid string, path string, status string, old_path string")


def snapshot(spark: SparkSession, repo: str, cap: int, start: str = "HEAD", limit: int | None = None) -> dict[str, DataFrame]:
    """All tables of a repository: the newest ``limit`` commits from a start, and trees of these and their parents alone."""
    root = discover(repo)
    ship_package(spark)
    own = commits(spark, root, start, limit)
    ends = own.select("oid").unionByName(own.filter(F.size("parents") == 1).select(F.col("parents")[0].alias("oid"))).distinct()
    entries = tree_entries(ends, root)
    return {"commits": own, "refs": refs(spark, root), "branch": branch(spark, root), "tree_entries": entries, "blobs": blobs(entries, root, cap), "changed_files": changed_files(own, root)}


def working_changes(spark: SparkSession, repo: str) -> DataFrame:
    """(path, status, old_path) of index and work tree against HEAD; untracked files are added, ignored ones left out."""
    parts, rows, i = git(repo, "status", "--porcelain=v1", "-z", "-uall", "--renames").split("\0"), [], 0
    while i < len(parts) and parts[i]:
        code, path, old = parts[i][:2], parts[i][3:], None
        i += 1
        if "R" in code:
            old, i = parts[i], i + 1
        status = "renamed" if "R" in code else "removed" if "D" in code else "added" if "A" in code or code == "??" else "modified"
        rows.append((path, status, old))
    return spark.createDataFrame(rows, "path string, status string, old_path string")


def working_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, size) of the files below a folder, repository files left out."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.replace("file:", "").replace(".", r"\."), "")
    return files.select(path.alias("path"), "content", F.col("length").alias("size")).filter(~F.col("path").startswith(".git/"))


def project_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, parent, name, is_dir) of a folder, folders first, each by name."""
    rows = []
    for at, folders, files in os.walk(folder):
        folders[:] = [f for f in folders if f != ".git"]
        parent = os.path.relpath(at, folder)
        rows += [(os.path.normpath(f"{parent}/{n}"), parent, n, True) for n in folders] + [(os.path.normpath(f"{parent}/{n}"), parent, n, False) for n in files]
    return spark.createDataFrame(rows, "path string, parent string, name string, is_dir boolean").orderBy("parent", F.desc("is_dir"), "name")


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Folders, then schematics of one folder, the latter marked if a repository holds them."""
    try:
        discover(folder)
        tracked = True
    except RepositoryNotFound:
        tracked = False
    tree = project_tree(spark, folder).filter("parent = '.'")
    return tree.filter(F.col("is_dir") | F.lower("name").endswith(".sch")).withColumn("in_repository", ~F.col("is_dir") & F.lit(tracked))


def symbol_paths(environment: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """State and folders of the symbol library named by the environment: not_configured, misconfigured or found."""
    env = os.environ if environment is None else environment
    root, kit = env.get("PDK_ROOT"), env.get("PDK")
    if not root or not kit:
        return "not_configured", []
    folder = Path(root) / kit / "libs.tech" / "xschem"
    return ("found", [str(folder)]) if folder.is_dir() else ("misconfigured", [str(folder)])


def start_file(folder: str = ".", home: str | None = None) -> str | None:
    """The schematic editor's start file: of the folder, else of the home folder."""
    for at in (Path(folder), Path(home) if home else Path.home()):
        if (at / ".xschemrc").exists():
            return str(at / ".xschemrc")
    return None


def device_library(environment: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """State and folder of the device library below TOOLS: not_configured, misconfigured or found."""
    tools = (os.environ if environment is None else environment).get("TOOLS")
    if not tools:
        return "not_configured", []
    folder = Path(tools) / "xschem/share/xschem/xschem_library/devices"
    return ("found" if folder.exists() else "misconfigured"), [str(folder)]


def environment_report(spark: SparkSession, repo: str) -> DataFrame:
    """(item, ok, detail) of what the engine needs around it; symbols are there if any of three places has them."""
    from shutil import which

    from ..functions.predicates import DRIVERS

    try:
        found = (True, discover(repo))
    except RepositoryNotFound:
        found = (False, repo)
    start = start_file()
    (kit, kit_at), (tools, tools_at) = symbol_paths(), device_library()
    rows = [("repository", *found), ("start_file", start is not None, start or ""), ("symbol_library", kit == "found", ", ".join([kit, *kit_at])), ("device_library", tools == "found", ", ".join([tools, *tools_at]))]
    rows += [("symbols", start is not None or "found" in (kit, tools), ""), ("git", which("git") is not None, which("git") or "")]
    rows += [(f"driver:{name}", True, f".{ext}") for ext, name in DRIVERS]
    return spark.createDataFrame(rows, "item string, ok boolean, detail string")
