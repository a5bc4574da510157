"""Ids of byte-level BPE as the tokenizers library gives them, from the faster tiktoken where both must agree."""

from __future__ import annotations

import json
import re

import numpy as np

#: A longer run without white space, or of white space, goes to the library, whose time grows less with it.
LONGEST = 1000
_LONG = re.compile(rf"\S{{{LONGEST}}}|\s{{{LONGEST}}}")
#: Fixed value: how byte-level BPE cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shown_bytes() -> dict[str, int]:
    """The byte behind each character of a token: printable ones are shown as they are, the others, in order, from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ByteBpe:
    """A tokenizer file; ``special``: whether special strings inside texts get their own ids.

    The same merges are done by rank if the file says nothing else: words by
    ``PATTERN``, no normalizer, merges in the order of their ids.
    """

    def __init__(self, path: str, special: bool):
        self.path, self.library = path, None
        shown = shown_bytes()
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        model, cut = plan["model"], plan["pre_tokenizer"] or {}
        added = plan["added_tokens"]
        names = {t["content"] for t in added}
        ranks = {bytes(map(shown.__getitem__, t)): k for t, k in model["vocab"].items() if t not in names}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        same = (
            model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and plan["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True)
            and merged == sorted(merged) and len(merged) + 256 == len(ranks)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and not t["special"] for t in added))
        #: The bytes of each token.
        self.octets = {k: t for t, k in ranks.items()} | {t["id"]: t["content"].encode() for t in added}
        self.keeps_special, self.special = special, {t["content"] for t in added} if special else set()
        self.fast = None
        if same:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _LONG.search(text):
            return np.array(self._loaded().encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=())

    def _loaded(self):
        if self.library is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
            import tokenizers

            self.library = tokenizers.Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.keeps_special
        return self.library
