"""Remote sources against a server of our own."""

import http.server
import json
import os
import threading

import pytest

from test_sync import ROWS, write
from tidemark.operators.match import OriginError
from tidemark.plans.sync import resolve_origins, sync
from tidemark.sources import files, remote


class Server:
    """Answers by path: a text, bytes, a status, or a list of these, one a request; others are 404."""

    def __init__(self):
        self.answers, self.asked, lock = {}, [], threading.Lock()
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                with lock:
                    outer.asked.append(self.path)
                    found = outer.answers.get(self.path, 404)
                    if isinstance(found, list):
                        found = found.pop(0) if len(found) > 1 else found[0]
                if isinstance(found, int):
                    self.send_error(found)
                    return
                body = found.encode() if isinstance(found, str) else found
                self.send_response(200)
                if body == b"cut":
                    self.send_header("Content-Length", "100")
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()
    s.http.server_close()


def test_all_paths_of_one_version(spark, server):
    server.answers = {"/v7/a.md": "A é", "/v7/d%20x/b.md": "B", "/v8/a.md": "newer"}
    df = remote.read(spark, server.url + "/{version}/{path}", "v7", ["a.md", "d x/b.md"])
    assert df.rdd.getNumPartitions() == 2
    want = [("a.md", "A é", None), ("d x/b.md", "B", None)]
    assert sorted(map(tuple, df.collect())) == want == sorted(map(tuple, df.collect()))
    assert sorted(set(server.asked)) == ["/v7/a.md", "/v7/d%20x/b.md"]
    both = remote.read(spark, server.url + "/{version}/{path}", "v7", ["a.md", "d x/b.md"], each=2)
    assert both.rdd.getNumPartitions() == 1 and sorted(map(tuple, both.collect())) == want
    assert remote.read(spark, server.url + "/{version}/{path}", "v7", []).count() == 0
    n = len(server.asked)
    kept = remote.fetch(spark, server.url + "/{version}/{path}", "v7", ["a.md"])
    server.answers["/v7/a.md"] = "changed after the read"
    assert [r["text"] for r in kept.collect()] == ["A é"] == [r["text"] for r in kept.collect()] and len(server.asked) == n + 1


def test_every_bad_source_is_named(spark, server):
    server.answers = {"/a": 403, "/c": "", "/d": b"\xff\xfe", "/e": 500, "/f": " \n", "/g": "good"}
    with pytest.raises(files.SourceError) as e:
        remote.fetch(spark, server.url + "/{path}", "v", list("abcdefg"), retries=1, pause=0.01)
    said = str(e.value).split("; ")
    assert [x.split(": ", 1)[1].split(" ")[0] for x in said] == ["403", "404", "the", "no", "500", "the"]
    assert "rate limit" in said[0] and "moved or renamed" in said[1]
    assert server.asked.count("/e") == 2 and server.asked.count("/a") == server.asked.count("/b") == 1


def test_what_passes_is_tried_again(spark, server):
    server.answers = {"/a": [500, 429, "at last"], "/b": [b"cut", "whole"]}
    got = remote.fetch(spark, server.url + "/{path}", "v", ["a", "b"], pause=0.01)
    assert sorted(r["text"] for r in got.collect()) == ["at last", "whole"]
    with pytest.raises(files.SourceError, match="GET http://127.0.0.1:9/x"):
        remote.get("http://127.0.0.1:9/x", timeout=2, retries=0)


def test_newest_version(server):
    server.answers = {"/head": json.dumps({"sha": "abcdef0123"}), "/short": '{"sha": "abc"}', "/none": "{}", "/list": "[]", "/text": "x", "/number": '{"sha": 12345678}'}
    assert remote.head(server.url + "/head") == "abcdef0123"
    for bad in ("short", "none", "list", "text", "number", "gone"):
        with pytest.raises(files.SourceError):
            remote.head(f"{server.url}/{bad}", retries=0)
    with pytest.raises(files.SourceError):
        remote.Remote(server.url).version()


def publish(server, folder, version):
    for s in (*(x.path for x in files.SOURCES), files.VOCABULARY):
        with open(f"{folder}/{os.path.basename(s)}", encoding="utf-8") as f:
            server.answers[f"/{version}/{s}"] = f.read()
    server.answers["/head"] = json.dumps({"sha": version})


def test_sync_and_origins_without_a_folder(spark, server, tmp_path, monkeypatch):
    root, docs = str(tmp_path / "data"), str(tmp_path / "docs")
    write(docs, ROWS)
    publish(server, docs, "version-1")
    source = remote.Remote(server.url + "/{version}/{path}", server.url + "/head")
    out = sync(spark, root, source, "2024-02-01")
    assert out.version == "version-1" and out.counts["added"] == len(ROWS)
    asked = len(server.asked)
    assert sync(spark, root, source, "2024-02-02").skipped and server.asked[asked:] == ["/head"]  # nothing is downloaded

    write(docs, [("Acme", "Two Sum II", "problems/two-sum", "Coding"), *ROWS[1:]])
    publish(server, docs, "version-2")
    del server.answers["/version-2/formats/sql.md"]
    with pytest.raises(files.SourceError, match="404"):
        sync(spark, root, source, "2024-02-02")
    assert files.read_meta(spark, f"{root}/meta.json")["version"] == "version-1"
    publish(server, docs, "version-2")

    from tidemark import cli, session

    monkeypatch.setattr(session, "local_session", lambda: spark)
    assert cli.main(["sync", "--data", root, "--remote", source.url, "--head", source.head, "--today", "2024-02-03"]) == 0
    assert files.read_meta(spark, f"{root}/meta.json")["version"] == "version-2"
    assert cli.main(["sync", "--data", root, "--remote", source.url, "--sha", "version-9"]) == 1

    server.answers["/catalogue"] = json.dumps({"stat_status_pairs": [{"stat": {"question__title": "Two Sum II", "question__title_slug": "two-sum-ii"}, "difficulty": {"level": 2}, "paid_only": True}]})
    assert resolve_origins(spark, root, server.url + "/catalogue") == (1, 1, True)
    server.answers |= {"/empty": '{"stat_status_pairs": []}', "/broken": "{"}
    for bad in ("gone", "empty", "broken"):
        with pytest.raises(OriginError):
            resolve_origins(spark, root, f"{server.url}/{bad}")
    assert cli.main(["origins", "--data", root, "--catalog", server.url + "/gone"]) == 1
