"""Frames pushed over HTTP: a small server lands them as files, from which ``readers.frame_files`` streams them."""

from __future__ import annotations

import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from fathomline.functions import frames

#: Where frames are posted to and the largest body that is taken. Fixed values.
ROUTE, LARGEST = "/v1/frames", 16 << 20


class FrameServer:
    """Answers 204 to a frame that it has landed in ``folder``, 400 to bytes that aren't one, 405 to anything but a POST,
    413 to a body that is too large and 404 to other paths. A file gets its name only when it is whole."""

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0):
        os.makedirs(folder, exist_ok=True)

        class Handler(BaseHTTPRequestHandler):
            def answer(self, status: int) -> None:
                self.send_response(status)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def do_POST(self) -> None:
                if self.path != ROUTE:
                    return self.answer(404)
                try:
                    size = int(self.headers.get("Content-Length", ""))
                except ValueError:
                    return self.answer(400)
                if size > LARGEST:
                    self.close_connection = True
                    return self.answer(413)
                body = self.rfile.read(size)
                try:
                    frames.decode(body)
                except frames.FrameError:
                    return self.answer(400)
                path = os.path.join(folder, uuid.uuid4().hex)
                with open(path + ".part", "wb") as f:
                    f.write(body)
                os.replace(path + ".part", path + ".plmp")
                self.answer(204)

            def refuse(self) -> None:
                self.answer(405 if self.path == ROUTE else 404)

            do_GET = do_PUT = do_DELETE = do_HEAD = do_PATCH = refuse

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.server.server_address[1]}{ROUTE}"
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)

    def __enter__(self) -> FrameServer:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()
