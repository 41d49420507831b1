"""Pieces of SQL that oracles of several operators share."""

from __future__ import annotations


def crc32_sql(codes: str) -> str:
    """SQL for the unsigned crc32 of a list of byte values: eight shifts follow each byte, -1 marks a shift."""
    steps = f"list_concat([4294967295::BIGINT], flatten(list_transform({codes}, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    shift = "CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce({steps}, lambda a, e: {shift}), 4294967295)"


def utf8_codes(text: str) -> str:
    """SQL for the byte values of a text's UTF-8 form."""
    return f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
