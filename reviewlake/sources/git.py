"""Git repositories as a change feed.

Three steps, each a job over many repositories whose result is a table in the shared folder:

1. ``pinned``: a row for each repository with the object ids of what is compared, and its configuration. All that
   follows reads at these ids, so commits made meanwhile change nothing.
2. ``read_changes``: one ``git diff`` for each repository gives the changed files and their patches, so the two cannot
   belong to different commits. The file filter and the patch budget hold while Git's output arrives: of patches that
   are filtered, or that cross a limit, no more is held than what had come before that was known.
3. ``read_sources``: the contents that extraction needs, by blob. A repository's blobs are dealt over tasks by some
   thousands, each with one ``git cat-file``, so a large repository is read by many.

A repository that fails, at whatever step, is a row of ``failures`` and leaves the others alone. A working tree has no
object id; its contents are read in step 2, right after the diff.
"""

from __future__ import annotations

import json
import os
import stat
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from itertools import chain
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FAILURE, BaseNotFound, CollectionFailed, DetachedHead, GitFailed, NotARepository, ReviewError, failure_row
from ..functions import lexicon as L
from ..functions.paths import Filter
from ..functions.staging import cut
from . import config

STATUS = {"A": "added", "D": "deleted", "M": "modified", "T": "modified", "R": "renamed"}
CONFIG_FILE = ".reviewlake.yml"
BLOBS_A_TASK = 2000

#: How changes are listed, whatever the user's configuration says.
DIFF = (
    "-c", "diff.noprefix=false", "-c", "diff.mnemonicPrefix=false", "-c", "diff.orderFile=/dev/null", "-c", "diff.suppressBlankEmpty=false", "-c", "diff.interHunkContext=0",
    "diff", "--raw", "-z", "--no-abbrev", "--patch", "--no-color", "--no-ext-diff", "--no-textconv", "--find-renames", "--submodule=short", "--unified=80", "--full-index",
)


@dataclass(frozen=True)
class Repo:
    """What to compare: the checked-out branch of a repository with a base (main or master if there is none named)."""

    review_id: int
    root: str
    base: str | None = None
    include_uncommitted: bool | None = None
    questions: int | None = None
    follow_up: bool | None = None
    executable: str = "git"


def _environment() -> dict[str, str]:
    return os.environ | {"LC_ALL": "C", "LANG": "C", "GIT_OPTIONAL_LOCKS": "0"}


def git(root: str, *args: str, ok: tuple[int, ...] = (0,), executable: str = "git") -> bytes:
    try:
        p = subprocess.run([executable, "-C", root, *args], capture_output=True, env=_environment(), check=False)
    except OSError as e:
        raise GitFailed("Git could not be started.", "Install Git and make it reachable.", str(e)) from e
    if p.returncode not in ok:
        raise GitFailed(f"`git {_command(args)}` failed.", "See the details.", p.stderr.decode(errors="replace").strip())
    return p.stdout


def streamed(root: str, *args: str, size: int = 65_536, executable: str = "git") -> Iterator[bytes]:
    """What Git prints, bit by bit. Whoever stops reading ends the process."""
    with tempfile.TemporaryFile() as errors:
        try:
            p = subprocess.Popen([executable, "-C", root, *args], stdout=subprocess.PIPE, stderr=errors, env=_environment())
        except OSError as e:
            raise GitFailed("Git could not be started.", "Install Git and make it reachable.", str(e)) from e
        try:
            while data := p.stdout.read(size):
                yield data
            if p.wait():
                errors.seek(0)
                raise GitFailed(f"`git {_command(args)}` failed.", "See the details.", errors.read().decode(errors="replace").strip())
        finally:
            if p.poll() is None:
                p.kill()
                p.wait()
            p.stdout.close()


def _command(args: tuple[str, ...]) -> str:
    """The name of Git's command, after settings of this call."""
    i = 0
    while args[i] == "-c":
        i += 2
    return args[i]


def _text(b: bytes) -> str:
    """Text of bytes; what is not UTF-8 is replaced, since Spark strings hold no other bytes."""
    return b.decode("utf-8", "replace")


def detect(root: str, executable: str = "git") -> tuple[str, str]:
    """(root, current branch)."""
    try:
        top = _text(git(root, "rev-parse", "--show-toplevel", executable=executable)).strip()
    except GitFailed as e:
        raise NotARepository("This folder is in no Git repository.", "Run inside a repository.", e.details) from e
    branch = _text(git(top, "branch", "--show-current", executable=executable)).strip()
    if not branch:
        raise DetachedHead("HEAD is detached.", "Check out a branch.")
    return top, branch


def base_branch(root: str, wanted: str | None, executable: str = "git") -> str:
    """The wanted base if it exists, else main or master."""
    exists = lambda ref: bool(git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}", ok=(0, 1, 128), executable=executable).strip())
    if wanted is not None:
        if not wanted.strip() or wanted.startswith("-") or not exists(wanted):
            raise BaseNotFound(f"There is no base `{wanted}`.", "Name an existing branch.")
        return wanted
    for ref in ("main", "master"):
        if exists(ref):
            return ref
    raise BaseNotFound("Neither main nor master exists.", "Name the base branch.")


def merge_base(root: str, base: str, target: str, executable: str = "git") -> str:
    found = [x for x in _text(git(root, "merge-base", base, target, ok=(0, 1), executable=executable)).splitlines() if x.strip()]
    if not found:
        raise CollectionFailed("The branches have no common history.", "Choose a related base.")
    return found[0].strip()


@dataclass(frozen=True)
class Changed:
    """A changed file, with the mode and blob of its new side."""

    path: str
    old_path: str | None
    status: str
    mode: str
    blob: str


def parse_metadata(data: bytes, most: int = L.RAW_FILES) -> list[Changed]:
    """The files of NUL-separated raw records."""
    fields = data.split(b"\0") if data else []
    out, i = [], 0
    while i < len(fields):
        head = _text(fields[i]).split(" ")  # old mode, new mode, old blob, new blob, status
        code = head[-1][:1]
        n = 2 if code == "R" else 1
        if len(head) != 5 or not head[0].startswith(":") or code not in STATUS or i + n >= len(fields):
            raise CollectionFailed("Changed-file metadata is malformed.", details=" ".join(head))
        names = [_text(x) for x in fields[i + 1 : i + 1 + n]]
        out.append(Changed(names[-1], names[0] if n == 2 else None, STATUS[code], head[1], head[3]))
        i += 1 + n
        if len(out) > most:
            raise CollectionFailed(f"More than {most:,} files changed.", "Compare with a nearer base.")
    return out


def read_metadata(chunks: Iterable[bytes], most: int = L.METADATA_BYTES, end: bytes = b"\0\0") -> tuple[bytes, bytes]:
    """(metadata, what was read after it); it ends at two NULs. The limit holds while it is read."""
    held, seen = bytearray(), 0
    for c in chunks:
        held += c
        at = held.find(end, max(0, seen - len(end) + 1))
        seen = len(held)
        if (at if at >= 0 else seen) > most:
            break
        if at >= 0:
            return bytes(held[:at]), bytes(held[at + len(end) :])
    if not held:
        return b"", b""
    raise CollectionFailed("Changed-file metadata is incomplete or too large.", "Compare with a nearer base.", f"limit {most:,} bytes")


def read_patches(chunks: Iterable[bytes], wanted: Callable[[int], bool] = lambda i: True, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES) -> Iterator[tuple[bytes | None, str | None]]:
    """(patch, limit) of each file, each patch from a line "diff --git " on.

    The budget is greedy in Git's order: a patch that crosses a limit is left out whole and takes nothing from it, and
    its limit is named ("file", or "aggregate" for what the patches before it have left). No more of it is held than
    had come when it crossed. Patches that are not wanted are (None, None), take nothing, and are not held.
    """
    marker = b"\ndiff --git "
    tail, i, held, n, why, left = bytearray(b"\n"), -1, [], 0, None, total

    def take(part: bytes) -> None:
        nonlocal n, why
        if why is not None or not wanted(i):
            return
        n += len(part)
        if n > min(per_file, left):
            why = "file" if per_file <= left else "aggregate"
            held.clear()
        else:
            held.append(part)

    def done() -> tuple[bytes | None, str | None]:
        nonlocal held, n, why, left
        out = (None, why) if why is not None or not wanted(i) else (b"".join(held), None)
        left -= 0 if out[0] is None else n
        held, n, why = [], 0, None
        return out

    for c in chunks:
        tail += c
        at = 0
        while (found := tail.find(marker, at)) >= 0:
            if i >= 0:
                take(bytes(tail[at : found + 1]))
                yield done()
            i, at = i + 1, found + 1
        safe = max(at, len(tail) - len(marker) + 1)  # a marker may begin in what is left
        if i >= 0:
            take(bytes(tail[at:safe]))
        del tail[:safe]
    if i >= 0:
        take(bytes(tail))
        yield done()


def split_output(data: bytes, most_metadata: int = L.METADATA_BYTES) -> tuple[bytes, list[bytes]]:
    """(metadata, patches) of output that is at hand."""
    meta, rest = read_metadata([data] if data else [], most_metadata)
    return meta, [p for p, _ in read_patches([rest])]


def _notes(path: str, most: int) -> tuple[str, str, str, str]:
    """What is said of a source that is large, special, missing, or no text."""
    quoted = json.dumps(path)
    return (
        f"Skipped source analysis for {quoted} because it exceeds {most:,} bytes.", f"Skipped source analysis for {quoted} because it is not a regular file.",
        f"Source for {quoted} was unavailable.", f"Source for {quoted} is not UTF-8 text.",
    )


def _decoded(data: bytes, not_text: str) -> tuple[str | None, str | None]:
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, not_text


def read_working(root: str, path: str, most: int = L.SOURCE_BYTES) -> tuple[str | None, str | None]:
    """(content, note) of a file of the working tree: one of them."""
    large, special, missing, not_text = _notes(path, most)
    full = Path(root, path)
    if not full.resolve().is_relative_to(Path(root).resolve()) or full.is_symlink():
        return None, special
    try:
        s = full.stat()
    except OSError:
        return None, missing
    if not stat.S_ISREG(s.st_mode):
        return None, special
    return (None, large) if s.st_size > most else _decoded(full.read_bytes(), not_text)


def read_blobs(root: str, wanted: Iterable[tuple[str, str, str]], most: int = L.SOURCE_BYTES, executable: str = "git") -> Iterator[tuple[str, str | None, str | None]]:
    """(path, content, note) of (path, mode, blob). Links, other special files and large files are not read.

    One process reads all, and one file is held at a time.
    """
    reader = None
    try:
        for path, mode, blob in wanted:
            large, special, missing, not_text = _notes(path, most)
            if not mode.startswith("100"):
                yield path, None, special
                continue
            if reader is None:
                reader = subprocess.Popen([executable, "-C", root, "cat-file", "--batch-command"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=_environment())
            ask = lambda what, blob=blob: (reader.stdin.write(f"{what} {blob}\n".encode()), reader.stdin.flush(), reader.stdout.readline().split())[2]
            answer = ask("info")
            if answer[1:2] == [b"missing"]:
                yield path, None, missing
            elif len(answer) != 3:
                raise GitFailed("`git cat-file` failed.", "See the details.", _text(b" ".join(answer)))
            elif int(answer[2]) > most:
                yield path, None, large
            else:
                data = reader.stdout.read(int(ask("contents")[2]))
                reader.stdout.read(1)
                yield path, *_decoded(data, not_text)
    finally:
        if reader is not None:
            reader.stdin.close()
            reader.kill()
            reader.wait()
            reader.stdout.close()


def read_source(root: str, revision: str, path: str, working_tree: bool, most: int = L.SOURCE_BYTES) -> tuple[str | None, str | None]:
    """(content, note) of one file: one of them."""
    if working_tree:
        return read_working(root, path, most)
    head, sep, _ = git(root, "--literal-pathspecs", "ls-tree", "-z", "--full-tree", revision, "--", path).partition(b"\t")
    if not sep:
        return None, _notes(path, most)[2]
    mode, _, blob = _text(head).split()
    return next(read_blobs(root, [(path, mode, blob)], most))[1:]


def has_source(status: str, path: str) -> bool:
    """Whether a changed file's content is read: it is there, and of a language that symbols are extracted from."""
    return status != "deleted" and L.LANGUAGE_OF_SUFFIX.get(Path(path).suffix.lower()) in L.EXTRACTOR_LANGUAGES


PINS = (
    "review_id long, repo_root string, current_branch string, base_branch string, merge_base string, source_revision string, includes_uncommitted boolean, "
    f"exclude array<string>, n_questions int, follow_up boolean, report_path string, executable string, failure {FAILURE}"
)


def pin(repo: Repo) -> dict:
    """The row of PINS of a repository; what the caller says goes before what its configuration says."""
    out = {"review_id": repo.review_id, "executable": repo.executable}
    try:
        root, branch = detect(repo.root, repo.executable)
        o = config.resolve(config.load(Path(root) / CONFIG_FILE), base=repo.base, questions=repo.questions, include_uncommitted=repo.include_uncommitted, directory=Path(root))
        base = base_branch(root, o.base, repo.executable)
        revision = _text(git(root, "rev-parse", "--verify", "--end-of-options", "HEAD^{commit}", executable=repo.executable)).strip()
        return out | {
            "repo_root": root, "current_branch": branch, "base_branch": base, "merge_base": merge_base(root, base, revision, repo.executable), "source_revision": revision,
            "includes_uncommitted": o.include_uncommitted, "exclude": list(o.exclude), "n_questions": o.questions, "follow_up": repo.follow_up is not False, "report_path": str(o.report_path),
        }
    except ReviewError as e:
        return out | {"failure": failure_row(e)}


def pinned(spark: SparkSession, repos: list[Repo] | DataFrame) -> DataFrame:
    """A row of PINS for each repository (a list, or rows with the fields of Repo), written to the shared folder."""
    fields = "review_id long, root string, base string, include_uncommitted boolean, questions int, follow_up boolean, executable string"
    rows = repos if isinstance(repos, DataFrame) else spark.createDataFrame([tuple(asdict(r).values()) for r in repos], fields)

    def pins(batches):
        for pdf in batches:
            of = lambda r: {k: None if not isinstance(v, str) and pd.isna(v) else v for k, v in r.items()}
            yield _frame([pin(Repo(**of(r))) for r in pdf.to_dict("records")], PINS)

    return cut(_spread(rows).mapInPandas(pins, PINS))


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame with all columns of the schema (failure, the last, has fields of its own), nulls where a row has none."""
    names = [c.split()[0] for c in schema.partition("failure ")[0].split(", ") if c] + ["failure"]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _spread(rows: DataFrame) -> DataFrame:
    """Repositories dealt over as many tasks as the cluster runs at once, four times over: some take longer than others."""
    return rows.repartition(max(1, 4 * rows.sparkSession.sparkContext.defaultParallelism), "review_id")


CHANGES = f"review_id long, relation string, file_ord int, path string, old_path string, status string, mode string, blob string, text string, note string, failure {FAILURE}"


def changes(pin: dict, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES) -> Iterator[dict]:
    """The rows of CHANGES of one pinned repository, from one diff; a failure's row is the last."""
    of = lambda relation, **x: {"review_id": pin["review_id"], "relation": relation, **x}
    root, executable = pin["repo_root"], pin["executable"]
    ends = [pin["merge_base"]] if pin["includes_uncommitted"] else [pin["merge_base"], pin["source_revision"]]
    try:
        out = streamed(root, *DIFF, *ends, "--", executable=executable)
        meta, rest = read_metadata(out)
        listed, n = parse_metadata(meta), 0
        yield from (of("file", file_ord=i, **asdict(f)) for i, f in enumerate(listed))
        low = Filter(pin["exclude"])
        wanted = [low.reason(f.path, f.old_path) is None for f in listed]
        for i, (patch, limit) in enumerate(read_patches(chain([rest], out), lambda i: i >= len(wanted) or wanted[i], per_file, total)):
            n += 1
            if i < len(wanted) and wanted[i]:
                yield of("patch", file_ord=i, text=None if patch is None else _text(patch), note=limit)
        if len(listed) != n:
            raise CollectionFailed("Changed files and patches do not match.", details=f"{len(listed)} files, {n} patches")
        if pin["includes_uncommitted"]:
            for f, w in zip(listed, wanted, strict=True):
                if w and has_source(f.status, f.path):
                    content, note = read_working(root, f.path)
                    yield of("source", path=f.path, text=content, note=note)
    except ReviewError as e:
        yield of("failure", failure=failure_row(e))


def _flushed(rows: Iterable[dict], schema: str, size: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """Rows as frames of some megabytes at most, but for a row that is larger."""
    got, n = [], 0
    for r in rows:
        got.append(r)
        n += 200 + len(r.get("text") or "")
        if n > size:
            yield _frame(got, schema)
            got, n = [], 0
    if got:
        yield _frame(got, schema)


def read_changes(pins: DataFrame, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES) -> DataFrame:
    """The rows of CHANGES of all sound pins, written to the shared folder: each repository is read once."""

    def read(batches):
        for pdf in batches:
            for p in pdf.to_dict("records"):
                yield from _flushed(changes(p, per_file, total), CHANGES)

    return cut(_spread(pins.filter("failure is null").drop("failure")).mapInPandas(read, CHANGES))


def read_sources(files: DataFrame, pins: DataFrame, most: int = L.SOURCE_BYTES, blobs_a_task: int = BLOBS_A_TASK) -> DataFrame:
    """review_id, path, content, note, failure from kept files (review_id, file_ord, path, status, mode, blob), read by
    blob at the pinned revision and written to the shared folder. Blobs of one repository are dealt by ``blobs_a_task``."""

    def read(batches):
        for pdf in batches:
            for (review, root, executable), g in pdf.groupby(["review_id", "repo_root", "executable"], sort=False):
                try:
                    rows = [{"review_id": review, "path": p, "text": c, "note": n} for p, c, n in read_blobs(root, zip(g["path"], g["mode"], g["blob"], strict=True), most, executable)]
                except ReviewError as e:
                    rows = [{"review_id": review, "failure": failure_row(e)}]
                yield from _flushed(rows, out)

    out = f"review_id long, path string, text string, note string, failure {FAILURE}"
    at = pins.filter("not includes_uncommitted").select("review_id", "repo_root", "executable")
    wanted = files.join(at, "review_id").withColumn("piece", F.floor(F.col("file_ord") / blobs_a_task))
    dealt = wanted.repartition(max(1, 4 * files.sparkSession.sparkContext.defaultParallelism), "review_id", "piece").sortWithinPartitions("review_id", "file_ord")
    return cut(dealt.select("review_id", "repo_root", "executable", "path", "mode", "blob").mapInPandas(read, out)).withColumnRenamed("text", "content")


def feed(spark: SparkSession, repos: list[Repo] | DataFrame, per_file: int = L.PATCH_BYTES, total: int = L.TOTAL_PATCH_BYTES):
    """The change feed of repositories, for plans.review: reviews, files, patches, sources, settings and failures.

    Each repository is compared once, at object ids found before. Rows of one that failed are left out of all but
    failures.
    """
    from ..functions import paths as P
    from ..operators import filtering
    from ..plans.review import Feed

    pins = pinned(spark, repos)
    rows = read_changes(pins, per_file, total)
    failed = pins.filter("failure is not null").select("review_id", "failure").unionByName(rows.filter("relation = 'failure'").select("review_id", "failure"))
    sound = lambda df: df.join(failed.select("review_id"), "review_id", "left_anti")
    settings = sound(pins).select("review_id", "exclude", "n_questions", "follow_up", "report_path")
    of = lambda relation: sound(rows.filter(F.col("relation") == relation))
    files = of("file").select("review_id", "file_ord", "path", "old_path", "status", F.lit(None).cast("string").alias("language"), "mode", "blob")
    kept = filtering.with_filter_reason(files, settings=settings).filter("filter_reason is null and status <> 'deleted'")
    blobs = read_sources(kept.filter(P.has_extractor(F.col("path"), F.lit(None).cast("string"))), pins)
    late = blobs.filter("failure is not null").select("review_id", "failure").dropDuplicates(["review_id"])
    sources = of("source").select("review_id", "path", F.col("text").alias("content"), "note").unionByName(blobs.filter("failure is null").select("review_id", "path", "content", "note"))
    reviews = sound(pins).drop("exclude", "n_questions", "follow_up", "report_path", "executable", "failure")
    patches = of("patch").select("review_id", "file_ord", F.col("text").alias("patch"), F.col("note").alias("limit_reason"))
    return Feed(reviews, files.drop("mode", "blob"), patches, sources, settings, failed.unionByName(late).select("review_id", "failure.*"))
