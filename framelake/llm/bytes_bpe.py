"""Byte-level BPE ids of whole texts, and pre-token boundaries of chunks.

A byte-level file whose merges are numbered in the order of their ranks is the same as a table of ranks, which the
tiktoken library merges several times faster than the tokenizers library. Other files, and texts that hold a special
string, go through the tokenizers library.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

from framelake.llm.bpe import byte_alphabet, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
#: Fixed value: how byte-level files split texts, written so that runs don't backtrack.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._ranks = self._by_ranks(spec)

    @staticmethod
    def _by_ranks(spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and not spec["post_processor"] and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = plain and not any(model.get(k) for k in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "ignore_merges", "byte_fallback"))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        if not plain or made != sorted(set(made)) or len(model["vocab"]) != 256 + len(made):
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encoded(self, text: str) -> list[int]:
        if self._ranks is None or (self._special and self._special.search(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return array("I", self.encoded(text)).tobytes()

    def boundaries(self, text: str) -> tuple[list[int], list[int], int]:
        """Starts of the pre-tokens of a text, the tokens before each of them, and the tokens in all."""
        e = self.library.encode(text, add_special_tokens=False)
        special = set(self.special.values())
        starts, counts, last, was = [], [], None, False
        for n, (i, word, (start, _)) in enumerate(zip(e.ids, e.word_ids, e.offsets, strict=True)):
            if n == 0 or word != last or i in special or was:
                starts.append(start)
                counts.append(n)
            last, was = word, i in special
        return starts, counts, len(e.ids)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def load(tokenizer: str = BYTE_BPE) -> ByteBpe:
    return byte_bpe(tokenizer_path(tokenizer))
