"""Vocabulary files of the tokenising operators."""

from __future__ import annotations

import base64
import json


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints as itself, any other as the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a .tiktoken rank file or a byte-level .json vocabulary whose ids follow its merges."""
    if path.endswith(".json"):
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def load_added(path: str) -> dict[str, int]:
    """The added tokens of a byte-level .json vocabulary, which stand for themselves wherever a text holds them. Those that take in white space or letters around them aren't known here."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    odd = [t["content"] for t in added if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if odd:
        raise ValueError(f"added tokens with rules of their own: {odd}")
    return {t["content"]: t["id"] for t in added}
