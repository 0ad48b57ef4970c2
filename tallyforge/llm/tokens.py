"""Token ids of whole texts with a public byte-level BPE."""

from __future__ import annotations

import json
import re

import numpy as np

#: Texts of these characters only are split alike by every Unicode version, for U+00C0 to U+024F are letters but for two
#: signs. They take the fast encoder; others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ɏ]*+")
#: How byte-level vocabularies split; a fixed value of the format.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out[chr(b if prints else spare)] = b
        spare += not prints
    return out


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, the same as the tokenizer's own.

    Where the file is a plain byte-level BPE whose merges come in the order of the ids that they make, plain texts go
    through a rank-based encoder of the same vocabulary, several times as fast.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = self._ranked(path)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        byte, vocab = byte_of(), model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        if made != sorted(made) or len(plain) != 256 + len(set(made)) or max(vocab[c] for c in byte) > min(made):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in plain.items()}
        return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        for i, t in enumerate(texts):
            if self.fast and _PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                out[i] = self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.asarray(ids.ids, "<u4").tobytes()
        return out
