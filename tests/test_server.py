"""Statements over HTTP, and results by batch."""

import http.client
import json
import threading

import pytest

from rillstone.server import Server
from rillstone.service import Metrics, Service


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("server")
    (folder / "t.csv").write_text("".join(f"{i},{'NaN' if i == 7 else i / 2}\n" for i in range(2500)))
    s = Server(Service(spark, str(folder / "data")), port=0)
    s.folder = folder
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def ask(server, text):
    c = http.client.HTTPConnection(*server.server_address, timeout=120)
    c.request("POST", "/", text.encode())
    lines = [json.loads(x) for x in c.getresponse().read().splitlines()]
    c.close()
    return lines


def test_statements_and_selects(server):
    made = ask(server, f'create source t (a int64, x float64) with "csv://{server.folder}/t.csv"')
    assert made == [{"columns": ["action", "success"], "rows": [["create source", True]]}]
    *parts, end = ask(server, "select a, x from t where a >= 100")
    assert [len(p["rows"]) for p in parts] == [1000, 1000, 400] and parts[0]["rows"][0] == [100, 50.0]
    assert (end["metrics"]["input_rows"], end["metrics"]["output_rows"]) == (2500, 2400)
    assert ask(server, "select a, x from t where a = 7")[0]["rows"] == [[7, "nan"]]
    assert [list(a) for a in ask(server, "select a from t where a < 0")] == [["metrics"]]
    assert ask(server, "show sources")[0]["rows"][0][0] == "t"


def test_errors_are_answers(server):
    for text in ("", "select", "select a from nothing", "delete sink nothing"):
        (answer,) = ask(server, text)
        assert list(answer) == ["error"] and answer["error"]


def test_clients_side_by_side(server):
    got = [None] * 4
    threads = [threading.Thread(target=lambda i=i: got.__setitem__(i, ask(server, f"select count(a) as n, f.ref(a, {i}) as r from t"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for i, answer in enumerate(got):
        rows = [r for p in answer[:-1] for r in p["rows"]]
        assert rows == [[k + 1, k - i if k >= i else None] for k in range(2500)]


def test_a_reader_may_stop_early(server):
    batches = server.service.batches("select a from t", 10)
    assert len(next(batches)[1]) == 10
    batches.close()
    assert isinstance(list(server.service.batches("select a from t", 5000))[-1], Metrics)
