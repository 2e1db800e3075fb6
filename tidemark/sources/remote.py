"""Documents over HTTP as a Spark data source: all paths at one pinned version, dealt over tasks.

A task gets its paths one after the other. What may pass (a server's error, too many requests, no
connection, a body cut short) is tried again, after growing pauses; what stays wrong is told in the
row's ``problem``. So a task never fails for a source's sake, one that is run again makes the same
rows, and :func:`fetch` can name every bad source at once. A version is pinned before
anything is read, so no document comes from another one than the rest.
"""

from __future__ import annotations

import contextlib
import http.client
import http.server
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .files import SourceError

AGENT = "tidemark"
TIMEOUT, RETRIES, PAUSE = 30.0, 3, 0.5
#: Paths that a task reads.
EACH = 1
#: Problems that an error names.
NAMED = 20
_HINTS = {403: "rate limit or no access", 404: "moved or renamed"}


def get(url: str, timeout: float = TIMEOUT, retries: int = RETRIES, pause: float = PAUSE) -> bytes:
    """The body at url; a SourceError says what was wrong."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            hint = f" ({_HINTS[e.code]})" if e.code in _HINTS else ""
            said, passes = f"GET {url}: {e.code} {e.reason}{hint}", e.code >= 500 or e.code == 429
        except (OSError, http.client.HTTPException) as e:
            said, passes = f"GET {url}: {getattr(e, 'reason', None) or e or type(e).__name__}", True
        if not passes or attempt == retries:
            raise SourceError(said)
        time.sleep(pause * 2**attempt)
    raise AssertionError


def text_at(url: str, **how) -> str:
    """The text at url; an empty one isn't data."""
    body = get(url, **how)
    if not body.strip():
        raise SourceError(f"GET {url}: the body is empty")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError(f"GET {url}: no UTF-8 ({e.reason})") from None


def head(url: str, shortest: int = 7, **how) -> str:
    """The version that a JSON document at url names as its ``sha``."""
    try:
        found = json.loads(get(url, **how))["sha"]
    except (ValueError, KeyError, TypeError):
        raise SourceError(f"{url} names no version") from None
    if not isinstance(found, str) or len(found) < shortest:
        raise SourceError(f"{url} names no plausible version: {found!r}")
    return found


@dataclass
class Paths(InputPartition):
    paths: list[str]


class RemoteTexts(DataSource):
    """Format ``tidemark_remote``: source, text, problem.

    Options: url, with ``{version}`` and ``{path}``; version; paths, a JSON list; each, how many a
    task reads; timeout, retries and pause in seconds.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_remote"

    def schema(self) -> str:
        return "source string, text string, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.version = options["url"], options.get("version", "")
        self.paths, self.each = json.loads(options["paths"]), int(options.get("each", EACH))
        self.how = {"timeout": float(options.get("timeout", TIMEOUT)), "retries": int(options.get("retries", RETRIES)), "pause": float(options.get("pause", PAUSE))}

    def partitions(self) -> list[Paths]:
        return [Paths(self.paths[i : i + self.each]) for i in range(0, max(1, len(self.paths)), self.each)]

    def read(self, partition: Paths) -> Iterator[tuple]:
        quoted = lambda s: urllib.parse.quote(s, safe="/")
        for path in partition.paths:
            try:
                yield path, text_at(self.url.replace("{version}", quoted(self.version)).replace("{path}", quoted(path)), **self.how), None
            except SourceError as e:
                yield path, None, str(e)


def read(spark: SparkSession, url: str, version: str, paths: list[str], **options) -> DataFrame:
    """source, text, problem of each path, read anew whenever it's evaluated."""
    spark.dataSource.register(RemoteTexts)
    return spark.read.format(RemoteTexts.name()).options(url=url, version=version, paths=json.dumps(paths), **options).load()


def fetch(spark: SparkSession, url: str, version: str, paths: list[str], made: list[str] | None = None, **options) -> DataFrame:
    """source, text of all paths, read once into the shared folder; every source that can't be read is named in one error."""
    got = files.kept(read(spark, url, version, paths, **options), "remote", made)
    bad = [r[0] for r in got.filter("problem IS NOT NULL").orderBy("source").select("problem").limit(NAMED + 1).collect()]
    if bad:
        raise SourceError("; ".join(bad[:NAMED]) + "; and more" * (len(bad) > NAMED))
    return got.select("source", "text")


@dataclass(frozen=True)
class Remote:
    """Where documents are: a url with {version} and {path}, and one that names the newest version."""

    url: str
    head: str | None = None

    def version(self) -> str:
        if not self.head:
            raise SourceError("neither a version nor a url that names the newest one is given")
        return head(self.head)

    def documents(self, spark: SparkSession, version: str, sources=files.SOURCES, vocabulary: str | None = files.VOCABULARY, made: list[str] | None = None) -> DataFrame:
        """source, text of the expected files at one version."""
        return fetch(spark, self.url, version, [s.path for s in sources] + ([vocabulary] if vocabulary else []), made)


def is_remote(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


@contextlib.contextmanager
def served(spark: SparkSession, folder: str, name=lambda path: path, host: str | None = None) -> Iterator[str]:
    """The url under which the driver hands out the files below folder, one GET a file; a folder stands for its part files.

    A mirror for clusters without another way out, and for tests. name turns a url's path into a file's.
    """
    jvm = spark._jvm

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            fs, p = files._fs(spark, f"{folder}/{name(urllib.parse.unquote(self.path.lstrip('/')))}")
            there = fs.exists(p)
            found = sorted((s.getPath() for s in fs.listStatus(p)), key=str) if there else []
            parts = [f for f in found if not f.getName().startswith(("_", "."))] if there and fs.getFileStatus(p).isDirectory() else found
            self.send_response(200 if there else 404)
            self.end_headers()
            for f in parts:
                stream = fs.open(f)
                self.wfile.write(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
                stream.close()

        def log_message(self, *_) -> None:
            pass

    server = http.server.ThreadingHTTPServer((host or spark.conf.get("spark.driver.host"), 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://{server.server_address[0]}:{server.server_address[1]}"
    finally:
        server.shutdown()
        server.server_close()
