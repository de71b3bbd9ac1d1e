"""Character classes that regular expressions of Java, and of RE2, read alike.

Built-in classes differ between engines (Java's ``\\s`` is ASCII, its
``\\p{IsLatin}`` and ``\\p{IsHan}`` hold more than named letters), so these are
plain ranges. A test compares them with the Unicode database.
"""

from __future__ import annotations

# Code points that count as white space.
WS_RANGES = "9-D 1C-20 85-85 A0-A0 1680-1680 2000-200A 2028-2029 202F-202F 205F-205F 3000-3000"
# Letters whose name contains LATIN.
LATIN_RANGES = (
    "41-5A 61-7A C0-D6 D8-F6 F8-2AF 1D00-1D25 1D62-1D65 1D6B-1D77 1D79-1D9A 1E00-1EFF 2071-2071 207F-207F 2090-209C "
    "2184-2184 2C2E-2C2E 2C5E-2C5E 2C60-2C7C 2C7E-2C7F A722-A76F A771-A787 A78B-A7CA A7D0-A7D1 A7D3-A7D3 A7D5-A7D9 "
    "A7F5-A7F7 A7FA-A7FF AB30-AB5A AB60-AB64 AB66-AB68 FB00-FB06 FF21-FF3A FF41-FF5A 1DF00-1DF1E 1DF25-1DF2A"
)
# Characters whose name contains CJK UNIFIED IDEOGRAPH or CJK COMPATIBILITY IDEOGRAPH.
HAN_RANGES = (
    "3400-4DBF 4E00-9FFF F900-FA6D FA70-FAD9 1F210-1F212 1F214-1F23B 1F240-1F248 20000-2A6DF 2A700-2B739 2B740-2B81D "
    "2B820-2CEA1 2CEB0-2EBE0 2EBF0-2EE5D 2F800-2FA1D 30000-3134A 31350-323AF"
)
# Control characters other than tab, line feed and carriage return.
CONTROL_RANGES = "0-8 B-C E-1F 7F-9F"


def parse_ranges(ranges: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b, 16)) for a, b in (r.split("-") for r in ranges.split())]


def inner(ranges: str) -> str:
    """The inside of a bracket expression."""
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in parse_ranges(ranges))


def characters(ranges: str) -> str:
    return "".join(chr(c) for a, b in parse_ranges(ranges) for c in range(a, b + 1))


WS_CHARACTERS, LATIN_CHARACTERS = characters(WS_RANGES), characters(LATIN_RANGES)
WS = f"[{inner(WS_RANGES)}]"
NOT_WS = f"[^{inner(WS_RANGES)}]"
LATIN = f"[{inner(LATIN_RANGES)}]"
HAN = f"[{inner(HAN_RANGES)}]"
CONTROL = f"[{inner(CONTROL_RANGES)}]"
#: Breaks of physical lines; CRLF is one.
LINE_BREAK = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
STRIP = f"^{WS}+|{WS}+\\z"
EDGE_START, EDGE_END = f"\\A{WS}+", f"{WS}+\\z"
