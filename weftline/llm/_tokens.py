"""Token ids of the public byte-level BPE, cached per Python worker.

``byte_bpe_50k.json`` defines the ids: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``,
where the string of a special token inside a text is that token. Its rank twin ``byte_bpe_50k.tiktoken`` gives the same
ids about four times faster and is used where it lies beside the file (tests hold the two equal)."""

from __future__ import annotations

import base64
import json
import os

import numpy as np

_cache: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _added(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("added_tokens") or []


def encoder(path: str):
    """A function from a text to its ids (uint16 array)."""
    if path not in _cache:
        ranks = path.removesuffix(".json") + ".tiktoken"
        added = _added(path)
        simple = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
        if path.endswith(".json") and os.path.exists(ranks) and simple:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t["content"]: t["id"] for t in added}
            enc = tiktoken.Encoding("weftline", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

            def encode(text: str) -> np.ndarray:
                if any(s in text for s in special):
                    return np.asarray(enc.encode(text, allowed_special="all"), np.uint16)
                return np.asarray(enc.encode_ordinary(text), np.uint16)

            _cache[path] = encode
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            if tok.get_vocab_size() > 65536:
                raise ValueError("ids over 16 bits")
            _cache[path] = lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, np.uint16)
    return _cache[path]
