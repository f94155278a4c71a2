"""A plain per-record reader of the wire format: the oracle of the batch decode."""


WIRE_VARINT, WIRE_LEN = 0, 2


class WireError(ValueError):
    pass


def _read_varint(buf: bytes, pos: int) -> tuple[int, int]:
    result = shift = 0
    while True:
        if pos >= len(buf):
            raise WireError("truncated varint")
        b = buf[pos]
        pos += 1
        result |= (b & 0x7F) << shift
        if not b & 0x80:
            return result, pos
        shift += 7
        if shift >= 70:
            raise WireError("varint too long")


def decode_fields(buf: bytes) -> dict[int, int | bytes]:
    """Last value wins per field number (proto3 merge rule for scalars)."""
    pos, out = 0, {}
    while pos < len(buf):
        key, pos = _read_varint(buf, pos)
        field, wire = key >> 3, key & 7
        if field == 0:
            raise WireError("field number 0")
        if wire == WIRE_VARINT:
            out[field], pos = _read_varint(buf, pos)
        elif wire == WIRE_LEN:
            n, pos = _read_varint(buf, pos)
            if pos + n > len(buf):
                raise WireError("truncated length-delimited field")
            out[field] = buf[pos:pos + n]
            pos += n
        elif wire == 1:
            if pos + 8 > len(buf):
                raise WireError("truncated fixed64")
            pos += 8
        elif wire == 5:
            if pos + 4 > len(buf):
                raise WireError("truncated fixed32")
            pos += 4
        else:
            raise WireError(f"unsupported wire type {wire}")
    return out


def decode_leaderboard(buf: bytes) -> list[tuple[str, int]]:
    """Test helper: the (country, score) entries of a leaderboard reply."""
    out, pos = [], 0
    while pos < len(buf):
        key, pos = _read_varint(buf, pos)
        n, pos = _read_varint(buf, pos)
        f = decode_fields(buf[pos:pos + n])
        pos += n
        out.append((f.get(1, b"").decode("utf-8"), f.get(2, 0)))
    return out
