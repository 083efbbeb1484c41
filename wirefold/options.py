"""Options of from_protobuf: names are case-insensitive."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from wirefold import errors

MODES = ("", "drop", "binary", "fail", "recursive")
#: Copies of a recursive message that an unlimited schema unrolls; the field below holds raw bytes.
UNROLL = 3


@dataclass(frozen=True)
class Options:
    mode: str = "FAILFAST"
    depth: int = -1
    recursion: str = ""
    unroll: int = UNROLL

    @classmethod
    def of(cls, given: Mapping[str, str] | None) -> Options:
        by = {str(k).lower(): v for k, v in (given or {}).items()}
        raw = by.get("recursive.fields.max.depth", -1)
        try:
            depth = int(raw)
        except (TypeError, ValueError):
            raise errors.bad_depth(raw) from None
        if not -1 <= depth <= 10:
            raise errors.bad_depth(depth)
        recursion = str(by.get("recursive.fields.mode", "")).lower()
        if recursion not in MODES:
            raise errors.bad_mode(recursion)
        if recursion == "recursive" and depth >= 0:
            raise errors.bad_combination(depth)
        return cls(str(by.get("mode", "FAILFAST")).upper(), depth, recursion, int(by.get("recursive.fields.unroll", UNROLL)))

    def permissive(self, function: str = "from_protobuf") -> bool:
        """Whether a malformed message becomes null; asked only when one is met, as an unknown mode is an error only then."""
        if self.mode not in ("PERMISSIVE", "FAILFAST"):
            raise errors.parse_mode(self.mode, function)
        return self.mode == "PERMISSIVE"
