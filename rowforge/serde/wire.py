"""Numbers on the wire, limits and errors of the record format."""

from __future__ import annotations

import struct

MAX_COUNT, MAX_SCHEMAS, MAX_NULLABLE, MAX_DEPTH, MAX_PACKED_BOOLEANS = 1 << 20, 1024, 16, 64, 16

F64, I64, U32 = struct.Struct("<d"), struct.Struct("<q"), struct.Struct("<I")
#: The layouts of fixed-width field types.
FIXED = {
    "boolean": struct.Struct("<?"), "int8": struct.Struct("<b"), "int16": struct.Struct("<h"), "int32": struct.Struct("<i"),
    "uint8": struct.Struct("<B"), "uint16": struct.Struct("<H"), "uint32": U32, "float64": F64, "bigint": I64, "date": F64,
}


class CodecError(ValueError):
    """A value that can't be written, or bytes that can't be read."""


def varint(n: int) -> bytes:
    if not 0 <= n <= 0xFFFFFFFF:
        raise CodecError(f"{n} is no unsigned 32-bit number")
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(buf):
            raise CodecError("varint read past the end")
        b = buf[at]
        at += 1
        if shift == 28:
            if b & 0x80:
                raise CodecError("varint of more than 5 bytes")
            return (value | (b & 0x0F) << 28) & 0xFFFFFFFF, at
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def varint_size(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


def zigzag(n: int) -> int:
    return (n << 1 ^ n >> 31) & 0xFFFFFFFF


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def take(buf: bytes, at: int, n: int, what: str) -> int:
    """The end of n bytes from a place on, which must be there."""
    if at + n > len(buf):
        raise CodecError(f"truncated {what} at offset {at}")
    return at + n


def read(layout: struct.Struct, buf: bytes, at: int, what: str = "value"):
    take(buf, at, layout.size, what)
    return layout.unpack_from(buf, at)[0]
