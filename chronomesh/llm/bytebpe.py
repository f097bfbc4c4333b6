"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

tiktoken runs the file's vocabulary, whose ids are its merge ranks, about five times as fast as
the tokenizers library and gives the same ids. Texts that hold a string of the file's added tokens,
texts it refuses, and all texts under a file with a normalizer, another pre-tokenizer, or options
of its model that tiktoken has not, go to that library. Plain ids take strings of added tokens as ordinary text.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import cached_property, lru_cache

#: The format's pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_symbol() -> dict[str, int]:
    """Byte that each printable stand-in of the format stands for: itself, or 256 and up in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path) as f:
            said = json.load(f)
        byte, self.added = byte_of_symbol(), [t["content"] for t in said["added_tokens"]]
        model = said["model"]
        vocab = model["vocab"]
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        self.data = {rank: bytes(byte[s] for s in token) for token, rank in vocab.items() if all(s in byte for s in token)}
        self.by_rank = self.plain(said) and merged == list(range(min(merged, default=0), min(merged, default=0) + len(merged)))
        if self.by_rank:
            ranks = {bytes(byte[s] for s in token): rank for token, rank in vocab.items() if token not in self.added}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def plain(said: dict) -> bool:
        """Whether the file asks for nothing but the byte-level pre-tokenizer and merges."""
        before, model = said.get("pre_tokenizer") or {}, said["model"]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        single = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in said["added_tokens"])
        return byte_level and model.get("type") == "BPE" and not odd and single and not said.get("normalizer") and not said.get("truncation")

    @cached_property
    def slow(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str, plain: bool = False) -> bytes:
        """Ids as unsigned 32-bit numbers in the machine's (little-endian) order."""
        if self.by_rank and (plain or not any(a in text for a in self.added)):
            try:
                return bytes(self.fast.encode_to_tiktoken_buffer(text, set()))
            except BaseException as e:  # a panic of the library is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        self.slow.encode_special_tokens = plain
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
