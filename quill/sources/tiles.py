"""Vector tiles: the attributes of their features, read from the protocol-buffer wire format."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field; lengths that run over the end raise an error."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if wire == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data):
                raise ValueError("not a vector tile")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _value(data: bytes):
    for number, x in _fields(data):
        if number == 1:
            return x.decode("utf-8", "replace")
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", x)[0]
        if number == 4:
            return x - (1 << 64) if x >> 63 else x
        if number == 5:
            return x
        if number == 6:
            return (x >> 1) ^ -(x & 1)
        if number == 7:
            return bool(x)
    return None


def features(tile: bytes) -> Iterator[tuple[str, dict]]:
    """(layer, attributes) of each feature."""
    for number, layer in _fields(tile):
        if number != 3:
            continue
        name, keys, values, found = "", [], [], []
        for n, x in _fields(layer):
            if n == 1:
                name = x.decode("utf-8", "replace")
            elif n == 2:
                found.append(x)
            elif n == 3:
                keys.append(x.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(x))
        for feature in found:
            tags: list[int] = []
            for n, x in _fields(feature):
                if n == 2:
                    at = 0
                    while at < len(x):
                        tag, at = _varint(x, at)
                        tags.append(tag)
            yield name, {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}


def tile_text(tile: bytes) -> str:
    """A line "capa layer | name: value | name: value." for each feature with attributes, each line once: features recur on
    several zoom levels."""
    lines: dict[str, None] = {}
    for layer, attributes in features(tile):
        cells = [f"{k}: {v}".strip() for k, v in attributes.items() if str(v).strip() not in ("", "None", "nan")]
        if cells:
            lines[f"capa {layer} | {' | '.join(cells)}."] = None
    return "\n".join(lines)
