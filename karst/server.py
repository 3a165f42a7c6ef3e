"""The engine behind HTTP: GET / and /health, POST /retrieve and /generate, on the standard library's server.

A service holds one session and one engine: two functions from a JSON object to a JSON object.  What a
caller did wrong is 400, what went wrong here 500, too many waiting requests 503, all with a detail; health is 200 or 503.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from karst.sources.providers import DETAIL


class Busy(RuntimeError):
    """More requests are waiting than the queue holds."""


class Coalescer:
    """Requests that arrive together, as one batch: a function of one request over a function of many.

    many: a list of JSON objects -> as many results, each an object or an exception, which is its caller's alone.  A batch
    begins with the request that waits longest and takes what comes within ``gather`` seconds, ``batch`` of them at most;
    while it runs, the next requests wait, ``waiting`` of them at most.  A batch that fails as a whole is done again request by request.
    """

    def __init__(self, many: Callable[[list[dict]], list], *, batch: int = 32, waiting: int = 256, gather: float = 0.02):
        if batch < 1 or waiting < 1:
            raise ValueError("batch and waiting must be 1 or more")
        self.many, self.batch, self.gather = many, batch, gather
        self._queue: queue.Queue = queue.Queue(waiting)
        self._closed = threading.Event()
        self._thread = threading.Thread(target=self._serve, daemon=True)
        self._thread.start()

    def __call__(self, body: dict) -> dict:
        if self._closed.is_set():
            raise Busy("the server is closing")
        reply: Future = Future()
        try:
            self._queue.put_nowait((body, reply))
        except queue.Full:
            raise Busy("too many requests are waiting") from None
        return reply.result()

    def _next(self) -> list[tuple[dict, Future]]:
        try:
            taken = [self._queue.get(timeout=0.2)]
        except queue.Empty:
            return []
        until = time.monotonic() + self.gather
        while len(taken) < self.batch:
            try:
                taken.append(self._queue.get(timeout=max(until - time.monotonic(), 0.0)) if time.monotonic() < until else self._queue.get_nowait())
            except queue.Empty:
                break
        return taken

    def _done(self, bodies: list[dict]) -> list:
        try:
            found = self.many(bodies)
            if len(found) != len(bodies):
                raise RuntimeError(f"{len(found)} results for {len(bodies)} requests")
            return found
        except Exception as e:
            return [e] if len(bodies) == 1 else [self._done([b])[0] for b in bodies]

    def _serve(self) -> None:
        while True:
            taken = self._next()
            if not taken and self._closed.is_set():
                return
            for (_, reply), found in zip(taken, self._done([b for b, _ in taken]) if taken else [], strict=True):
                reply.set_exception(found) if isinstance(found, Exception) else reply.set_result(found)

    def close(self) -> None:
        """No further requests; those that wait are answered."""
        self._closed.set()
        self._thread.join()


class _Server(ThreadingHTTPServer):
    request_queue_size = 256
    daemon_threads = True


class Service:
    """A server with its lifetime; as a context manager it closes what it opened itself, and nothing else."""

    def __init__(self, retrieve: Callable[[dict], dict], generate: Callable[[dict], dict], healthy: Callable[[], bool] = lambda: True, *, host: str = "127.0.0.1", port: int = 8000, close: Callable[[], None] | None = None):
        self.routes = {"/retrieve": retrieve, "/generate": generate}
        self.healthy, self._close = healthy, close
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _send(self, status: int, value: dict) -> None:
                body = json.dumps(value, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:
                path = self.path.split("?")[0].rstrip("/") or "/"
                if path == "/":
                    self._send(200, {"name": "karst", "endpoints": ["/health", *service.routes]})
                elif path == "/health":
                    try:
                        well = service.healthy()
                    except Exception:
                        well = False
                    self._send(200 if well else 503, {"status": "ok" if well else "unavailable"})
                else:
                    self._send(404, {"detail": "not found"})

            def do_POST(self) -> None:
                run = service.routes.get(self.path.split("?")[0].rstrip("/"))
                if run is None:
                    return self._send(404, {"detail": "not found"})
                try:
                    value = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
                    if not isinstance(value, dict):
                        raise ValueError("the body must be a JSON object")
                    self._send(200, run(value))
                except Busy as e:
                    self._send(503, {"detail": str(e)})
                except ValueError as e:
                    self._send(400, {"detail": str(e)[:DETAIL]})
                except Exception as e:
                    self._send(500, {"detail": f"{type(e).__name__}: {e}"[:DETAIL]})

            def log_message(self, *args) -> None:
                pass

        self.server = _Server((host, port), Handler)
        self.port = self.server.server_address[1]
        self._thread: threading.Thread | None = None

    def start(self) -> Service:
        """Serves in the background; a second start does nothing."""
        if self._thread is None:
            self._thread = threading.Thread(target=self.server.serve_forever, daemon=True)
            self._thread.start()
        return self

    def close(self) -> None:
        if self._thread is not None:
            self.server.shutdown()
            self._thread.join()
            self._thread = None
        self.server.server_close()
        if self._close:
            self._close()

    def __enter__(self) -> Service:
        return self.start()

    def __exit__(self, *error) -> None:
        self.close()
