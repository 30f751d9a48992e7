"""crc32 in DuckDB SQL, which has no such function: for the SQL of queries only."""

#: The table of the reflected polynomial 0xEDB88320, as list `t` of 256 longs.
CRC_TABLE = "(SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n)))"


def crc32(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a string, where CRC_TABLE is joined."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"
