"""Statements over HTTP: ``python -m rillstone.server --data-dir data --host 127.0.0.1 --port 33001``.

A statement is the body of a POST to ``/``. The answer is one JSON object a line, sent as it comes: ``{"columns", "rows"}`` by
batch, then ``{"metrics"}``; other statements give one batch; ``{"error"}`` ends an answer that fails. A client that goes away
cancels its statement. There is no authentication and statements read and write files, so the default is this machine only.
"""

from __future__ import annotations

import argparse
import json
import math
import threading
import uuid
from collections.abc import Iterator
from dataclasses import asdict
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .errors import RillError
from .service import Metrics, Service
from .sql.parser import Select, parse_statement


def cell(x):
    """A value as JSON: times in ISO form, floats that JSON lacks and other values as text."""
    if isinstance(x, float) and not math.isfinite(x):
        return str(x)
    if x is None or isinstance(x, bool | int | float | str):
        return x
    return x.isoformat() if isinstance(x, date) else str(x)


class Server(ThreadingHTTPServer):
    """Serves one Service; selects run side by side, other statements one at a time."""

    daemon_threads = True

    def __init__(self, service: Service, host: str = "127.0.0.1", port: int = 33001):
        self.service, self.changes = service, threading.Lock()
        super().__init__((host, port), Handler)

    def answers(self, text: str) -> Iterator[dict]:
        try:
            if isinstance(parse_statement(text), Select):
                for part in self.service.batches(text):
                    if isinstance(part, Metrics):
                        yield {"metrics": asdict(part)}
                    else:
                        yield {"columns": part[0], "rows": [[cell(x) for x in r] for r in part[1]]}
                return
            with self.changes:
                df = self.service.execute(text)
                rows = df.collect()  # a row, or a definition each
            yield {"columns": df.columns, "rows": [[cell(x) for x in r] for r in rows]}
        except GeneratorExit:
            raise
        except RillError as e:
            yield {"error": str(e)}
        except Exception as e:  # what Spark reports while a statement runs
            yield {"error": f"{type(e).__name__}: {e}"}


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    server: Server

    def do_POST(self) -> None:
        text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8", "replace")
        context, tag = self.server.service.spark.sparkContext, uuid.uuid4().hex
        context.addJobTag(tag)
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        answers = self.server.answers(text)
        try:
            for a in answers:
                line = json.dumps(a).encode() + b"\n"
                self.wfile.write(b"%x\r\n%s\r\n" % (len(line), line))
            self.wfile.write(b"0\r\n\r\n")
        except (BrokenPipeError, ConnectionResetError):
            context.cancelJobsWithTag(tag)
            self.close_connection = True
        finally:
            answers.close()
            context.removeJobTag(tag)

    def log_message(self, *_) -> None:
        pass


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--data-dir", default="data")
    args.add_argument("--host", default="127.0.0.1")
    args.add_argument("--port", type=int, default=33001)
    given = args.parse_args()
    service = Service(SparkSession.builder.getOrCreate(), given.data_dir)
    server = Server(service, given.host, given.port)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        server.server_close()
        service.close()


if __name__ == "__main__":
    main()
