"""Octet-counted frames: ``LENGTH SP MESSAGE`` end to end on a byte stream."""

from __future__ import annotations


class FramingError(ValueError):
    """The stream cannot be read on; its connection is to be closed."""


def decode_frames(leftover: bytes, data: bytes, limit: int = 1_000_000) -> tuple[list[bytes], bytes]:
    """(complete frames, bytes that begin the next). FramingError on a bad length or one over ``limit``."""
    data, at, frames = leftover + data, 0, []
    digits = len(str(limit))
    while at < len(data):
        space = data.find(b" ", at, at + digits + 1)
        head = data[at : space if space >= 0 else at + digits + 1]
        if not head.isdigit() or head[:1] == b"0":
            raise FramingError(f"bad frame length {head[:20]!r}")
        if int(head) > limit or len(head) > digits:
            raise FramingError(f"frame of {int(head)} bytes, the limit is {limit}")
        if space < 0 or len(data) < space + 1 + int(head):
            break
        frames.append(data[space + 1 : space + 1 + int(head)])
        at = space + 1 + int(head)
    return frames, data[at:]


def encode_frame(message: bytes) -> bytes:
    return str(len(message)).encode() + b" " + message


def datagram(data: bytes) -> list[bytes]:
    """A datagram is one frame."""
    return [data]
