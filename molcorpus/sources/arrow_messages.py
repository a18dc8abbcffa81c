"""The messages of an Arrow stream, found by their heads alone.

A stream is a sequence of messages: the schema, dictionaries, record batches. Each begins with the
size of its metadata, which tells the size of its body, so that bodies can be passed over.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

SCHEMA, DICTIONARY, BATCH = 1, 2, 3
CONTINUES = 0xFFFFFFFF


@dataclass
class Message:
    kind: int
    start: int
    size: int


def whole(raw: bytes, at: int, size: int, signed: bool = False) -> int:
    return int.from_bytes(raw[at : at + size], "little", signed=signed)


def message_head(metadata: bytes) -> tuple[int, int]:
    """Kind and size of the body: the fields 1 and 3 of the flat table that the metadata is."""
    table = whole(metadata, 0, 4)
    fields = table - whole(metadata, table, 4, signed=True)
    known = whole(metadata, fields, 2)

    def field(number: int, size: int) -> int:
        at = 4 + 2 * number
        offset = whole(metadata, fields + at, 2) if at < known else 0
        return whole(metadata, table + offset, size) if offset else 0

    return field(1, 1), field(3, 8)


def messages(source, size: int) -> Iterator[Message]:
    """All messages of a stream of so many bytes; an error if the last one is not whole."""
    at = 0
    while at < size:
        source.seek(at)
        head = source.read(min(8, size - at))
        length, prefix = whole(head, 0, 4), 4  # older streams begin with the size itself
        if length == CONTINUES:
            length, prefix = whole(head, 4, 4), 8
        if len(head) >= prefix and length == 0:
            return
        if len(head) < prefix or at + prefix + length > size:
            raise ValueError(f"the stream is cut off in a message at byte {at}")
        source.seek(at + prefix)
        kind, body = message_head(source.read(length))
        end = at + prefix + length + body
        if end > size:
            raise ValueError(f"the stream is cut off in a message at byte {at}")
        yield Message(kind, at, end - at)
        at = end


def ranges_of_share(source, size: int, part: int, parts: int) -> list[tuple[int, int]]:
    """What a share reads: the schema, the dictionaries before its last batch, and the batches that
    begin in its part of the bytes. Empty without such batches."""
    low, high = size * part // parts, size * (part + 1) // parts
    found: list[tuple[int, int]] = []
    last = 0
    for message in messages(source, size):
        own = message.kind == BATCH and low <= message.start < high
        if message.start >= high and message.kind == BATCH and part + 1 < parts:
            break  # later bytes belong to other shares
        if own or message.kind in (SCHEMA, DICTIONARY):
            found.append((message.start, message.size))
        if own:
            last = len(found)
    return found[:last]


class Ranges(io.RawIOBase):
    """Some ranges of a source, read as if they were all of a file."""

    def __init__(self, source, ranges: list[tuple[int, int]]):
        self.source, self.ranges, self.done = source, list(ranges), 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while self.ranges and self.done == self.ranges[0][1]:
            self.ranges.pop(0)
            self.done = 0
        if not self.ranges:
            return 0
        start, size = self.ranges[0]
        self.source.seek(start + self.done)
        piece = self.source.read(min(len(buffer), size - self.done))
        buffer[: len(piece)] = piece
        self.done += len(piece)
        return len(piece)
