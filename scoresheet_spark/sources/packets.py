"""Packets to devices: a JSON line to each client that connects."""

from __future__ import annotations

import socket
import threading

from pyspark.sql import DataFrame

from ..operators.blueprint import packet_json


class PacketServer:
    """Sends one packet to every client and closes the connection. Listens on one address, the local one unless told otherwise."""

    def __init__(self, packet: DataFrame, host: str = "127.0.0.1", port: int = 0, backlog: int = 5) -> None:
        row = packet_json(packet).first()
        if row is None:
            raise ValueError("no student is on the roster of this group")
        self.line = row[0].encode() + b"\n"
        self.sent = 0
        self.socket = socket.create_server((host, port), backlog=backlog)
        self.address = self.socket.getsockname()
        self.thread = threading.Thread(target=self._serve, daemon=True)

    def start(self) -> PacketServer:
        self.thread.start()
        return self

    def _serve(self) -> None:
        while True:
            try:
                client, _ = self.socket.accept()
            except OSError:  # stopped
                return
            with client:
                try:
                    client.sendall(self.line)
                    self.sent += 1
                except OSError:  # a client that has gone; others still get theirs
                    continue

    def stop(self) -> None:
        try:
            self.socket.shutdown(socket.SHUT_RDWR)
        except OSError:
            pass
        self.socket.close()
        self.thread.join(5)
