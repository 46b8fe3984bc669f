"""Staging of sources: archives, repositories, downloads, and a paged web interface as a Spark data source.

Staging runs on the driver, once for each source, before anything is scanned; what is there already is left alone.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.checks import Violation
from .readers import check_names


def present(path: str, kind: str) -> bool:
    """Whether a source of a kind (repository, archive or folder) was staged before."""
    at = Path(path)
    return (at / ".git").exists() if kind == "repository" else at.is_file() and at.stat().st_size > 0 if kind == "archive" else at.is_dir() and any(at.iterdir())


def repository(url: str, path: str, revision: str | None = None, run: Callable = subprocess.run) -> str:
    """A shallow clone, unless it is there; the commit that is checked out, which must be ``revision`` if one is named."""
    if not present(path, "repository"):
        run(["git", "clone", "--quiet", "--depth", "1", "--", url, path], check=True)
    head = run(["git", "-C", path, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    if revision is not None and head != revision:
        raise Violation(f"{path} is at {head}, not at {revision}")
    return head


def download(url: str, path: str, timeout: float = 60.0) -> None:
    """A file, unless it is there; it appears under its name only when it is whole."""
    if present(path, "archive"):
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.part-{os.getpid()}"
    with urllib.request.urlopen(url, timeout=timeout) as source, open(part, "wb") as out:  # noqa: S310
        shutil.copyfileobj(source, out, 1 << 20)
    os.replace(part, path)


def unpack(archive: str, folder: str) -> None:
    """A zip's files, unless the folder holds something; names that leave it, and links, raise before anything is written."""
    if present(folder, "folder"):
        return
    with zipfile.ZipFile(archive) as z:
        check_names([(i.filename, (i.external_attr >> 16) & 0o170000 == 0o120000) for i in z.infolist()])
        Path(folder).parent.mkdir(parents=True, exist_ok=True)
        fresh = tempfile.mkdtemp(dir=Path(folder).parent)
        z.extractall(fresh)
    if Path(folder).is_dir():
        os.rmdir(folder)
    os.replace(fresh, folder)


def get_json(url: str, attempts: int = 5, wait: float = 1.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An answer as JSON; when the server is busy (429, 5xx) it is asked again, after twice the time each time."""
    for n in range(attempts):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if n + 1 == attempts or (error.code != 429 and error.code < 500):
                raise
        sleep(wait * 2**n)
    raise AssertionError("unreachable")


class PagedPages(DataSource):
    """``spark.read.format("paged_pages")``: pages of wikis that answer in pieces, each with the token of the next.

    Options: ``url`` (the interface's address), ``start`` (title prefixes, comma-separated: each is read by a task of its own), ``limit``
    (pages of a prefix, a feature of the source), ``batch``, ``wait`` (seconds before the first retry). Titles that come again
    within a prefix are left out; rows come by (title, pageid).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_pages"

    def schema(self) -> str:
        return "pageid long, title string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader({k.lower(): v for k, v in dict(self.options).items()})


class _Prefix(InputPartition):
    def __init__(self, prefix: str):
        self.prefix = prefix


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Prefix(p) for p in self.options.get("start", "").split(",")]

    def read(self, partition: _Prefix) -> Iterator[tuple]:
        limit, batch, wait = int(self.options.get("limit", "500")), int(self.options.get("batch", "50")), float(self.options.get("wait", "1"))
        ask = {"action": "query", "format": "json", "generator": "allpages", "gapprefix": partition.prefix, "gaplimit": str(batch), "prop": "extracts", "explaintext": "1"}
        token: dict[str, str] = {}
        seen: dict[str, tuple] = {}
        while len(seen) < limit:
            answer = get_json(f"{self.options['url']}?{urllib.parse.urlencode(ask | token)}", wait=wait)
            for page in answer.get("query", {}).get("pages", {}).values():
                if page.get("extract"):
                    seen.setdefault(page["title"], (int(page["pageid"]), page["title"], page["extract"]))
            if "continue" not in answer:
                break
            token = {k: str(v) for k, v in answer["continue"].items()}
        yield from sorted(seen.values(), key=lambda p: (p[1], p[0]))[:limit]
