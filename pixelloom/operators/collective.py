"""Sums over the tasks of a barrier stage.

The tasks form a ring of connections. A vector is cut into as many chunks as
there are tasks; each chunk travels once around the ring while it is summed and
once more to be handed out, so a task sends and receives twice the vector, however
many tasks there are, and all get the same bits. Nothing passes through the
driver but the addresses. If a task is lost, its neighbours' connections break,
they fail too, and Spark starts the whole barrier stage anew.
"""

from __future__ import annotations

import secrets
import socket
import threading

import numpy as np
from pyspark import BarrierTaskContext

#: Seconds that a task waits for a neighbour: a step of the slowest one must fit.
PATIENCE = 600


def exactly(link: socket.socket, n: int) -> bytearray:
    held, at = bytearray(n), 0
    view = memoryview(held)
    while at < n:
        got = link.recv_into(view[at:])
        if not got:
            raise ConnectionError("a neighbour in the ring has gone")
        at += got
    return held


class Ring:
    """The task's place among all tasks of its barrier stage."""

    def __init__(self, context: BarrierTaskContext) -> None:
        self.rank, self.size = context.partitionId(), len(context.getTaskInfos())
        self.left = self.right = None
        if self.size == 1:
            return
        host = context.getTaskInfos()[self.rank].address.rsplit(":", 1)[0]
        with socket.create_server(("", 0), backlog=2) as server:
            server.settimeout(PATIENCE)
            told = context.allGather(f"{host} {server.getsockname()[1]} {secrets.token_hex(16)}")
            to, port, _ = told[(self.rank + 1) % self.size].split()
            # the first task's secret opens all connections of this attempt
            key = bytes.fromhex(told[0].split()[2])
            self.right = socket.create_connection((to, int(port)), PATIENCE)
            self.right.sendall(key)
            while self.left is None:
                link, _ = server.accept()
                link.settimeout(PATIENCE)
                if secrets.compare_digest(bytes(exactly(link, len(key))), key):
                    self.left = link
                else:
                    link.close()
        for link in (self.left, self.right):
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def passed(self, chunk: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Sends a chunk to the right and returns the one from the left, at the same time."""
        broken: list[Exception] = []

        def send() -> None:
            try:
                self.right.sendall(chunk.tobytes())
            except OSError as error:
                broken.append(error)

        sender = threading.Thread(target=send)
        sender.start()
        got = np.frombuffer(exactly(self.left, like.nbytes), like.dtype)
        sender.join()
        if broken:
            raise ConnectionError("a neighbour in the ring has gone") from broken[0]
        return got

    def total(self, vector: np.ndarray) -> np.ndarray:
        """The sum of all tasks' vectors; every task must call it equally often."""
        if self.size == 1:
            return vector
        chunks = np.array_split(np.asarray(vector, float), self.size)
        for k in range(self.size - 1):
            at = (self.rank - k - 1) % self.size
            chunks[at] = chunks[at] + self.passed(chunks[(self.rank - k) % self.size], chunks[at])
        for k in range(self.size - 1):
            at = (self.rank - k) % self.size
            chunks[at] = self.passed(chunks[(self.rank - k + 1) % self.size], chunks[at])
        return np.concatenate(chunks)

    def close(self) -> None:
        for link in (self.left, self.right):
            if link is not None:
                link.close()
