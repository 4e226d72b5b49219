"""ABIF bytes in the published layout: what the reader takes, for exchange and for round trips."""

from __future__ import annotations

import struct

import numpy as np

#: Element types of the published layout: byte, char, int16, pascal string.
BYTE, CHAR, SHORT, PSTRING = 1, 2, 4, 18


def abif_bytes(channels: np.ndarray, dyes: str = "GATC", bases: str = "", quality: list[int] = (), places: list[int] = (), name: str = "", first: int = 1) -> bytes:
    """channels: 4 x N whole numbers in the order of `dyes`, written as DATA first .. first + 3."""
    items: list[tuple[bytes, int, int, int, bytes]] = []
    for k, row in enumerate(np.asarray(channels)):
        items.append((b"DATA", first + k, SHORT, 2, np.asarray(row).astype(">i2").tobytes()))
    items.append((b"FWO_", 1, CHAR, 1, dyes.encode()))
    for tag, kind, size, value in ((b"PBAS", CHAR, 1, bases.encode()), (b"PCON", BYTE, 1, bytes(quality)), (b"PLOC", SHORT, 2, np.array(places, ">u2").tobytes())):
        if value:
            items.append((tag, 2, kind, size, value))
    if name:
        items.append((b"SMPL", 1, PSTRING, 1, bytes([len(name)]) + name.encode()))
    body, entries, at = [], [], 128
    for tag, number, kind, size, value in items:
        inline = len(value) <= 4
        where = value.ljust(4, b"\0") if inline else struct.pack(">i", at)
        entries.append(struct.pack(">4sihhii", tag, number, kind, size, len(value) // size, len(value)) + where + struct.pack(">i", 0))
        if not inline:
            body.append(value)
            at += len(value)
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiiii", b"tdir", 1, 1023, 28, len(entries), 28 * len(entries), at, 0)
    return head.ljust(128, b"\0") + b"".join(body) + b"".join(entries)
