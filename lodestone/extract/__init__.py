"""Per-language extractors: source text to symbols, imports, exports, calls and references."""

from lodestone.extract.registry import EXTRACTORS, extract, register

__all__ = ["EXTRACTORS", "extract", "register"]
